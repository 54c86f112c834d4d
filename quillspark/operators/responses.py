"""Reading a model's batch answer: which text belongs to which headline.

Pure Python on one batch of a few stories; DataFrames call it through Arrow in
:mod:`quillspark.operators.summaries`. An answer is read in three steps that know
nothing of each other:

* :func:`entries` cuts the lines into entries: a mark (``STORY_n`` or ``n.``) with its
  number, the words beside it and the lines below it.
* :func:`fits` scores every entry against every headline, as one table.
* :func:`places` turns the table into slots by rules on sets of claims.

Rules. A story entry claims the headline it fits best, if it fits well enough; of several
claims the first counts, and the slot that bears a later one's number stays empty. An
item claims likewise, else the slot of its number. Without headlines numbers alone
decide, items before stories. Without entries the answer is paragraphs or one text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from difflib import SequenceMatcher

#: A headline quoted beside a mark, a summary's words, and an item's text count from here on.
QUOTED, COVERED, ITEM = 0.7, 0.3, 0.15
#: Words that can quote a headline where no sign ends the quotation.
_QUOTE_WORDS = range(4, 11)

_BREAK = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9\"'])")
_TITLE = re.compile(r"[^:.!?]{1,80}:\s+(?=\S)")


@dataclass(frozen=True)
class Entry:
    """``story``: marked STORY_n (counted from 0), else an item (counted from 1); ``slot``: where its number points."""

    story: bool
    slot: int
    beside: str
    below: tuple[str, ...]

    @property
    def quote(self) -> str:
        return self.beside.partition("=")[0].strip() if "=" in self.beside else ""

    @property
    def told(self) -> str:
        """The entry's own text: what follows the quotation, the lines below a heading, or the heading's line."""
        if self.story:
            text = self.beside.partition("=")[2] if "=" in self.beside else self.beside
            return text.strip() or " ".join(self.below)
        return " ".join(self.below) or _TITLE.sub("", self.beside, count=1)


def _mark(line: str) -> tuple[bool, int, str] | None:
    """(story, slot, rest) of a line that begins an entry."""
    bare = line.strip().lstrip("#").strip().lstrip("*").strip()
    story = bare[:5].lower() == "story"
    rest = bare[5:].lstrip("_- ") if story else bare
    digits = rest[: len(rest) - len(rest.lstrip("0123456789"))]
    rest = rest[len(digits) :]
    if not digits or len(digits) > 6 or (not story and rest[:1] not in (".", ")")):
        return None
    if not story and digits.strip("0") and rest[1:2].isdigit():
        return None  # a decimal number
    return story, int(digits) if story else max(int(digits) - 1, 0), rest.lstrip(" \t.):|" if story else ".)").strip()


def entries(lines: list[str]) -> list[Entry]:
    """All entries of an answer; lines before the first mark belong to none."""
    starts = [(n, m) for n, m in enumerate(map(_mark, lines)) if m]
    ends = [n for n, _ in starts[1:]] + [len(lines)]
    cut = lambda lo, hi: tuple(x.strip() for x in lines[lo:hi] if x.strip())
    return [Entry(story, slot, rest.strip("* "), cut(n + 1, end)) for (n, (story, slot, rest)), end in zip(starts, ends)]


def three_sentences(text: str) -> str:
    """Single spaces, no doubled full stop, at most three sentences."""
    flat = " ".join((text or "").split()).replace("..", ".").strip()
    return " ".join(_BREAK.split(flat)[:3])


def _tidy(text: str) -> str:
    text = text.replace("**", "").strip()
    return three_sentences(text[8:] if text[:8].lower() == "summary:" else text)


def _bag(text: str, least: int = 4) -> frozenset[str]:
    return frozenset(w for w in re.findall(r"\b[a-z]+\b", text.lower()) if len(w) >= least)


def _alike(a: str, b: str) -> float:
    flat = lambda t: " ".join(t.lower().split())
    return SequenceMatcher(None, flat(a), flat(b)).ratio()


def _share(part: frozenset[str], of: frozenset[str]) -> float:
    return len(part & of) / len(of) if of else 0.0


def _quoted_start(text: str, bags: list[frozenset[str]]) -> tuple[int, list[float]] | None:
    """The shortest beginning of an unsigned text that quotes a headline: its words, and how much of it each headline has."""
    words = text.split()
    for n in _QUOTE_WORDS if len(words) > 8 else ():
        own = _bag(" ".join(words[:n]))
        row = [_share(bag, own) for bag in bags]
        if n < len(words) and max(row, default=0.0) >= COVERED:
            return n, row
    return None


def fits(found: list[Entry], headlines: list[str]) -> list[tuple[list[float], str]]:
    """For each entry how well it fits each headline (0: not at all) and the text it brings."""
    bags = [_bag(h) for h in headlines]
    table = []
    for e in found:
        text = e.told
        if e.story:
            # the surest kind of likeness that reaches its bound decides
            quoted = [_alike(e.quote, h) if e.quote else 0.0 for h in headlines]
            covered = [_share(_bag(text[:150]), bag) for bag in bags]
            start = None
            for row, bound in ((quoted, QUOTED), (covered, COVERED)):
                if max(row, default=0.0) >= bound:
                    break
            else:
                start = _quoted_start(e.beside, bags)
                row, bound = (start[1], COVERED) if start else ([], 1.0)
            if start:
                text = " ".join(e.beside.split()[start[0] :])
        else:
            whole = " ".join([e.beside, *e.below])
            row, bound = [_share(_bag(whole), bag) for bag in bags], ITEM
            if max(row, default=0.0) < QUOTED:
                row = [max(share, _alike(e.beside, h)) for share, h in zip(row, headlines)]
        table.append(([s if s >= bound else 0.0 for s in row] or [0.0] * len(headlines), _tidy(text)))
    return table


def _best(row: list[float]) -> int | None:
    top = max(row, default=0.0)
    return row.index(top) if top > 0 else None


def places(found: list[Entry], table: list[tuple[list[float], str]], count: int) -> dict[int, str]:
    """Slots with their texts."""
    claims = {k: j for k, (row, text) in enumerate(table) if text and (j := _best(row)) is not None and j < count}
    stories = [k for k in claims if found[k].story]
    first = {claims[k]: k for k in reversed(stories)}
    second = [k for k in stories if first[claims[k]] != k]
    out: dict[int, str] = {}
    for j, k in sorted(first.items(), key=lambda x: x[1]):
        # a slot kept empty by an earlier second claim sends its own claim to its number
        kept = any(found[s].slot == j for s in second if s < k)
        slot = found[k].slot if kept and found[k].slot < count else j
        out.setdefault(slot, table[k][1])
    closed = set(out) | {found[k].slot for k in second}
    for k, e in enumerate(found):
        if not e.story and table[k][1]:
            slot = next((s for s in (claims.get(k), e.slot) if s is not None and s < count and s not in closed), None)
            if slot is not None:
                out[slot] = table[k][1]
                closed.add(slot)
    return out


def _by_number(found: list[Entry], count: int) -> dict[int, str]:
    """Items, then stories, at their numbers; of equal numbers of one kind the last."""
    out: dict[int, str] = {}
    for story in (True, False):
        out |= {e.slot: _tidy(e.told) for e in found if e.story == story and e.slot < count}
    return out


def _unmarked(lines: list[str], count: int) -> dict[int, str]:
    """One text without its introduction, or paragraphs that begin with "Summary of"."""
    if count == 1:
        return {0: three_sentences(" ".join(x for x in lines if not x.strip().startswith(("Here are", "***"))))}
    at = [n for n, x in enumerate(lines) if x.strip().lower().startswith("summary") and ":" in x]
    return {k: three_sentences(" ".join(lines[lo:hi])) for k, (lo, hi) in enumerate(zip(at, [*at[1:], len(lines)])) if k < count}


def _exchanged(texts: list[str], headlines: list[str]) -> list[str]:
    """Neighbours change places, from left to right, where each fits the other's headline better."""
    bags, out = [_bag(h, 3) for h in headlines], list(texts)
    for i, (a, b) in enumerate(zip(bags, bags[1:])):
        if i + 1 < len(out) and a and b and out[i] and out[i + 1]:
            x, y = _bag(out[i], 3), _bag(out[i + 1], 3)
            if _share(x, b) > _share(x, a) and _share(y, a) > _share(y, b):
                out[i], out[i + 1] = out[i + 1], out[i]
    return out


def read_batch_answer(answer: str | None, count: int, headlines: list[str] | None = None) -> list[str]:
    """``count`` summaries, "" where the answer has none for a story.

    Headlines must be texts; an empty one is fitted by nothing. Story entries that fit no
    headline at all leave every slot empty.
    """
    lines = (answer or "").splitlines()
    found = entries(lines)
    if not found:
        slots = _unmarked(lines, count) if answer else {}
    elif not headlines:
        slots = _by_number(found, count)
    else:
        table = fits(found, headlines)
        stories = [row for e, (row, _) in zip(found, table) if e.story]
        slots = {} if stories and not any(map(any, stories)) else places(found, table, count)
    texts = [slots.get(k, "") for k in range(count)]
    return _exchanged(texts, headlines) if headlines else texts
