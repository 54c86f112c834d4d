"""Personal data: high-recall generators propose spans, boosted trees and calibrated thresholds choose.

Base spans follow fixed patterns and checks and are always kept. Beyond them,
generators propose spans of the same kinds in other notations (spelled-out
addresses, national telephone numbers, IPv6 and defanged addresses, cards with other
separators) and values that are given to names; they are wide and overlap each other.
Each candidate has features of its format and of the text around it.

Trees are boosted on candidates whose labels are known without looking at features:
into the texts of a bounded sample of documents made-up values are planted, personal
ones in many notations and look-alikes (dates, times, versions, placeholders, ordinary
sentences), and the generators run over the result. A candidate is true if it is a
planted personal value from end to end; all others that touch what was planted are
not, so wrong ends are learned as well. Base matches and matches that fail their checks
join them, drawn for each kind and label on its own, so that a rare kind is found in a
corpus of any size. The documents of a third of the sample calibrate the scores, and for
each kind the threshold is the least score down to which the share of true ones is
``PRECISION`` or more; a kind with few true ones, or without such a score, has the
threshold of all kinds together. A chosen span may hold or cross base spans (a secret with a
card number in it) but does not lie within one; of overlapping chosen ones the likeliest
stays.

Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from bisect import bisect_right
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .trees import Boosted, boost, sigmoid
from .workspace import arrow_map, discard, materialize

#: Documents that train the trees: those with the least hashes of their ids for planting, and for each kind and label of base matches.
TRAIN_DOCS = 500
#: Values of each kind that are planted into a document of the sample, and as many look-alikes.
PLANTED = 4
#: Candidates that a document gives for one kind and label, spread over its length.
TRAIN_CANDIDATES = 4
PRECISION = 0.98
#: Held-out true candidates below which a kind has the threshold of all kinds.
LEAST_TRUE = 5

KINDS = ("email", "ip", "card", "phone", "secret")
_ORDER = {k: i for i, k in enumerate(KINDS)}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a number's match reaches its run's end, so the next one cannot start inside a run
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans that pass their checks, and matches that fail them."""
    good, bad = [], []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            good.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            ok = all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))
            (good if ok else bad).append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = _only_digits(m.group())
                ok = 14 <= len(d) <= 19 and luhn(d)
                (good if ok else bad).append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                ok = 10 <= len(_only_digits(m.group())) <= 15
                (good if ok else bad).append(("phone", *m.span()))
    return sorted(good, key=lambda s: (s[1], _ORDER[s[0]])), bad


# ---------------------------------------------------------------- candidates
_AT = re.compile(r"\s?[(\[{<]\s?(?:at|AT|At|@)\s?[)\]}>]\s?|[ ](?:at|AT|@)[ ]")
_LABEL = r"[A-Za-z0-9-]++"
_SPELT = re.compile(_LABEL + r"(?:(?:\s?[(\[{<]\s?(?:dot|DOT|Dot|\.)\s?[)\]}>]\s?|[ ](?:dot|DOT)[ ]|\.)" + _LABEL + ")+")
_NATIONAL = re.compile(r"(?<![0-9+.-])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,5}\)?[ .-]?[ ./-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9+.-])0[1-9](?:[ .-][0-9]{2}){4}(?![0-9])")
_SPACED = re.compile(r"(?<![0-9])[0-9]{4}([^0-9A-Za-z\s-]|[ ]{2,3}|\t|\u00a0)[0-9]{4}(?:\1[0-9]{4}){2}(?![0-9])|(?<![0-9])[0-9]{4}([._/|])[0-9]{6}\2[0-9]{5}(?![0-9])")
_V6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_DEFANGED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?[0-9]{1,3}){3}(?![0-9])")
_CREDENTIAL = re.compile(r"(?i)pass(?:word|wd|phrase|code)?s?$|pwd|token|secret|credential|(?:api|access|private|auth|encryption|signing)[_.-]?key|auth$")
_OPEN = re.compile(r"\s*[\"']?")
# a value reaches its run's end, however long
_VALUE = re.compile(r"[^\s\"',;]{6,}+")
# the last of each in a run: a value that looks random has digits, letters and nothing else but a few signs
_LASTS = {"other": re.compile(r"(?s)[^A-Za-z0-9+/_.=-](?=[A-Za-z0-9+/_.=-]*+$)"), "digit": re.compile(r"[0-9](?=[^0-9]*+$)"), "letter": re.compile(r"[A-Za-z](?=[^A-Za-z]*+$)")}
_IN_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")


def _name_before(text: str, at: int) -> str:
    """The name to the left of a sign at ``at``; white space and a quotation mark may stand between."""
    end = at
    while end > 0 and text[end - 1].isspace():
        end -= 1
    if end > 0 and text[end - 1] in "\"'":
        end -= 1
    start = end
    while start > 0 and text[start - 1] in _IN_NAME:
        start -= 1
    return text[start:end]


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Candidates in other notations; they may overlap base spans and each other."""
    out = []
    for m in _AT.finditer(text) if "at" in text or "AT" in text or "@" in text else ():
        start = m.start()
        while start > 0 and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and (d := _SPELT.match(text, m.end())):
            out.append(("email", start, d.end()))
            # a sentence may go on without a space
            cut = text.rfind(".", m.end(), d.end())
            if cut > 0 and _SPELT.fullmatch(text, m.end(), cut):
                out.append(("email", start, cut))
    if _DIGIT.search(text):
        out += [("phone", *m.span()) for m in _NATIONAL.finditer(text)]
        out += [("card", *m.span()) for m in _SPACED.finditer(text)]
        if ":" in text:
            out += [("ip", *m.span()) for m in _V6.finditer(text)]
        if "[" in text or "(" in text or "{" in text:
            out += [("ip", *m.span()) for m in _DEFANGED.finditer(text)]
    for sign in "=:":
        out += _given(text, sign)
    return out


def _given(text: str, sign: str):
    """Values that are given to names by a sign; of a run of value characters each is looked at once.

    A credential's value reaches its run's end, and names within it are part of it; so is
    the value of another name that looks random, but credentials within it still count.
    """
    at, run_end, random_found = text.find(sign), -1, False
    while at >= 0:
        nxt = at + 1
        name = _name_before(text, at)
        start = _OPEN.match(text, nxt).end() if name else nxt
        if name and start >= run_end:
            run = _VALUE.match(text, start)
            # the last characters of the run that are not of a random value, digits and letters
            run_end, random_found = (run.end(), False) if run else (start, True)
            last = {c: run.start() + m.start() for c, p in _LASTS.items() if (m := p.search(run.group()))} if run else {}
        if name and run_end - start >= 6:
            credential = _CREDENTIAL.search(name)
            alike = not random_found and run_end - start >= 16 and last.get("other", -1) < start <= min(last.get("digit", -1), last.get("letter", -1))
            if credential or alike:
                yield "secret", start, run_end
                end = run_end
                while text[end - 1] in ".)]}!?" and end - start > 6:
                    end -= 1
                if end < run_end:
                    yield "secret", start, end
                random_found = True
            if credential:
                nxt = run_end
        at = text.find(sign, nxt)


#: What is written in the place of a credential (some of the planted look-alikes, too).
_STANDS = ("unknown", "required", "undefined", "changeme", "********", "optional", "xxxxxxxx", "redacted", "<token>", "${SECRET}", "expired", "missing", "invalid", "your-key-here", "<your-password>", "%(secret)s", "{{token}}", "disabled", "enabled", "default", "string", "example", "placeholder", "not-set")
_PLACEHOLDER = re.compile(r"(?i)(?:" + "|".join(w for w in _STANDS if w.isalpha()) + r"|[*x._-]++|<.*>|\$?\{+[^{}]*\}+|%[(]?[a-z_]+[)]?[a-z%]|your[_-].*)[.!?)\]]*")
_HINTS = [re.compile(p, re.I) for p in (r"mail|contact|@|write|reach", r"\bip\b|server|host|addr|node|gateway", r"card|visa|credit|account|paid|charge", r"phone|tel|call|fax|mobile|dial|reach", r"version|v\.?\s?$|date|page|\bno\b|isbn|order|total|\$|€|\bon\b|lines?\b|score|chapter|mac|time|\bat\b")]
_TLD = re.compile(r"(?:com|org|net|edu|gov|io|info|[a-z]{2})$")
FEATURES = 43
_DOT_WORD = re.compile(r"(?i)[ (\[{<]dot[ )\]}>]")


def _entropy(span: str) -> float:
    n = len(span)
    return -sum(c / n * math.log2(c / n) for c in (span.count(x) for x in set(span))) if n else 0.0


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    span = text[start:end]
    digits = _only_digits(span)
    letters = sum(c.isalpha() for c in span)
    upper = sum("A" <= c <= "Z" for c in span)
    groups = [len(g) for g in re.split(r"[^0-9]+", span) if g]
    before, after = text[max(0, start - 28) : start], text[end : end + 12]
    prev, nxt = before[-1:], after[:1]
    parts = re.split(r"[^0-9]+", span)
    octets = len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    tail = re.search(r"[A-Za-z]+$", span)
    local = re.split(r"[^A-Za-z0-9._%+-]", span, maxsplit=1)[0]
    sign = before.rstrip(" \t\n\"'")
    # no longer a look back than a credential's name
    name = _name_before(text[max(0, start - 100) : start], len(text[max(0, start - 100) : start].rstrip(" \t\n\"'")) - 1) if kind == "secret" and sign[-1:] in ("=", ":") else ""
    size = max(len(span), 1)
    return [
        *(float(kind == k) for k in KINDS),
        float(end - start),
        float(len(digits)),
        float(letters),
        float(len(span) - len(digits) - letters),
        float(len(groups)),
        float(groups[-1] if groups else 0),
        float(groups[0] if groups else 0),
        float(14 <= len(digits) <= 19 and luhn(digits)),
        float(octets),
        float(span.startswith("+")),
        float("(" in span),
        float(len(tail.group()) if tail else 0),
        float(bool(tail) and bool(_TLD.fullmatch(tail.group()))),
        float("@" in span),
        float(sum(c in "([{<" for c in span)),
        float(len(_DOT_WORD.findall(span))),
        float(span.count(".")),
        float(span.count(":")),
        float("::" in span),
        float(any(c in "abcdefABCDEF" for c in span)),
        float(any(c in "._%+-" or c.isdigit() for c in local)),
        len(set(span)) / size,
        _entropy(span[:256]),
        len(digits) / size,
        upper / size,
        float(max(map(len, re.findall(r"[a-z]+", span)), default=0)),
        float(prev.isalnum()),
        float(nxt.isalnum()),
        float(nxt in ("", " ", "\n", '"', "'", ",", ";")),
        float(span[-1:].isalnum()),
        float(sum(c.isdigit() for c in before[-12:]) + sum(c.isdigit() for c in after)),
        float(bool(_CREDENTIAL.search(name))),
        float(bool(_PLACEHOLDER.fullmatch(span))),
        *(float(bool(h.search(before))) for h in _HINTS),
    ]


# ---------------------------------------------------------------- examples
_HEX, _BASE = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_NAMES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "Password", "TOKEN", "db.password", "aws_secret", "credential", "x-auth-token", "private_key")
_OTHER_NAMES = ("color", "title", "date", "version", "id", "name", "url", "path", "file", "checksum", "commit", "build", "ref", "note", "status", "model", "uuid", "sha1")
_TLDS = ("com", "org", "net", "de", "fr", "es", "io", "co.uk", "example.com")


def _digits_of(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng: random.Random, n: int, valid: bool) -> str:
    d = str(rng.randint(3, 6)) + _digits_of(rng, n - 2)
    check = next(c for c in "0123456789" if luhn(d + c))
    return d + (check if valid else str((int(check) + rng.randint(1, 9)) % 10))


def _planted(rng: random.Random, kind: str, true: bool, words: list[str]) -> tuple[str, str, str]:
    """(what comes before, a personal value or a look-alike, what comes after)."""
    pick, word = rng.choice, lambda: rng.choice(words)
    lead = ""
    if kind == "email":
        if true:
            local = pick((f"{word()}.{word()}", f"{word()}{rng.randint(1, 99)}", word(), f"{word()}_{word()}", f"{word()}.{rng.randint(1, 99)}"))
            at = pick((" [at] ", " (at) ", " at ", "[at]", "(at)", " [AT] ", " @ ", " <at> "))
            dot = pick((".", ".", " [dot] ", " (dot) ", " dot ", "[dot]", "(dot)", " [DOT] ")) if at != " @ " else "."
            host = pick((f"{word()}.{pick(_TLDS)}", f"mail{rng.randint(1, 9)}.{word()}.{pick(_TLDS)}"))
            return pick(("", "mail ", "contact: ", "write to ")), local + at + host.replace(".", dot), pick((" ", " ", ", ", ". "))
        return "", pick((f"{word()} at {word()}.{word().capitalize()}", f"{word()} at {word()}.{word()}", f"{word()} at {rng.randint(1, 12)}.{rng.randint(10, 59)}", f"{word()} [at] {word()}")), " "
    if kind == "phone":
        d = _digits_of(rng, 10)
        if true:
            forms = (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"{d[:3]} {d[3:6]} {d[6:]}", f"0{d[:2]}/{d[2:9]}", f"0{rng.randint(1, 9)} {d[:2]} {d[2:4]} {d[4:6]} {d[6:8]}", f"00{rng.randint(30, 49)} {d[:3]} {d[3:6]} {d[6:]}")
            return pick(("", "call ", "tel. ", "phone: ", "fax ", "mobile ")), pick(forms), pick((" ", " ", ", ", ". "))
        forms = (f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{d[:2]}.{d[2:5]}.{d[5:8]}", f"{rng.randint(1900, 2030)} {rng.randint(1900, 2030)} {rng.randint(1900, 2030)}", f"{rng.randint(1, 9)}00-{rng.randint(1, 9)}00-{rng.randint(1, 9)}00", f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}", f"978-{d[0]}-{d[1:3]}-{d[3:9]}-{d[9]}", f"{d[:2]},{d[2:5]} {d[5:8]}", f"{d[:3]}-{d[3:6]}")
        return pick(("", "pages ", "isbn ", "in ", "order ", "from ")), pick(forms), pick((" ", ", "))
    if kind == "card":
        sep = pick(".._//|·*") if rng.random() < 0.8 else pick(("  ", "\u00a0"))
        if rng.random() < 0.2 and sep in "._/|":
            d = _card(rng, 15, true)
            groups = (d[:4], d[4:10], d[10:])
        else:
            d = _card(rng, 16, true)
            groups = (d[:4], d[4:8], d[8:12], d[12:])
        return pick(("", "card ", "visa ", "paid with ") if true else ("", "no ", "order ", "from ")), sep.join(groups), pick((" ", ", "))
    if kind == "ip":
        if true:
            h = [f"{rng.getrandbits(16):x}" for _ in range(8)]
            o = [str(rng.randint(0, 255)) for _ in range(4)]
            return pick(("", "host ", "from ", "server ")), pick((":".join(h), f"{h[0]}:{h[1]}::{h[2]}", f"fe80::{h[0]}:{h[1]}:{h[2]}:{h[3]}", pick(("[.]", "(.)", "[dot]", "{.}")).join(o), f"{h[0]}:{h[1]}:{h[2]}::{h[4]}:{h[5]}")), pick((" ", ", "))
        two = lambda: f"{rng.randint(0, 59):02}"
        mac = ":".join(f"{rng.getrandbits(8):02x}" for _ in range(6))
        return pick(("", "at ", "mac ", "time ")), pick((f"{rng.randint(0, 23)}:{two()}:{two()}", f"{two()}:{two()}:{two()}:{two()}", f"{rng.randint(1, 9)}:{rng.randint(1, 9)}:{rng.randint(1, 9)}", mac, "[.]".join(str(rng.randint(256, 999)) for _ in range(4)))), pick((" ", ", "))
    sign, mark = pick(("=", ": ", " = ", ":", ": ")), pick(("", "", '"', "'"))
    n = pick((6, 7, 8, 10, 12, 16, 20, 32, 40, 64, 120, 400))
    value = pick((lambda: "".join(pick(_HEX) for _ in range(n)), lambda: "".join(pick(_BASE) for _ in range(n)), lambda: (word() + word() + word())[: max(n, 8)].ljust(6, "a"), lambda: f"{word()[:6]}{_digits_of(rng, 3)}!".rjust(7, "z"), lambda: "-".join("".join(pick(_HEX) for _ in range(k)) for k in (8, 4, 4, 4, 12)), lambda: ".".join("".join(pick(_BASE[:62] + "_-") for _ in range(n)) for _ in range(3))))
    own = value()
    if rng.random() < 0.25:
        # values that hold what a base pattern finds
        held = pick((lambda: _card(rng, 16, True), lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: f"{word()}{rng.randint(1, 9)}@{word()}.{word()}.{pick(_TLDS)}", lambda: "+1" + _digits_of(rng, 10)))()
        own = pick((own[:12] + "-" + held + "-" + word(), pick(_BASE[:26]) + held + "!" + own[:8], word() + held + pick(("ZZ", "_x", "-q", "!x")) + str(rng.randint(1, 99))))
    if true:
        return pick(_NAMES) + sign + mark, own, mark + pick((" ", "\n", ", ") if not mark else (" ", ", "))
    if rng.random() < 0.45:
        return pick(_NAMES) + sign + mark, pick(_STANDS), mark + pick((" ", " ", ". ", ", "))
    return pick(_OTHER_NAMES) + sign + mark, own, mark + " "


_WORDS = re.compile(r"[a-z]{2,12}")


def planted_examples(text: str, rng: random.Random, times: int = PLANTED):
    """(label, text around, kind, start, end) of the generators' candidates where made-up values were planted into ``text``."""
    words = _WORDS.findall(text[: 1 << 14]) or ["word"]
    for kind in KINDS:
        for true in (True, False):
            for _ in range(times):
                at = text.find(" ", rng.randrange(len(text) + 1)) + 1
                lead, value, tail = _planted(rng, kind, true, words)
                left = text[max(0, at - 60) : at]
                start = len(left) + len(lead)
                whole = left + lead + value + tail + text[at : at + 60]
                covered = Covered(base_spans(whole)[0])
                for s in proposals(whole):
                    if s[1] < start + len(value) and start < s[2] and s not in covered:
                        yield int(true and s == (kind, start, start + len(value))), whole, *s


def _labelled(text: str) -> dict[tuple[str, int], list[tuple[str, int, int]]]:
    """Base matches, and matches that fail their checks, by kind and label."""
    good, bad = base_spans(text)
    out: dict[tuple[str, int], list[tuple[str, int, int]]] = {}
    for s in good:
        out.setdefault((s[0], 1), []).append(s)
    for s in bad:
        out.setdefault((s[0], 0), []).append(s)
    return out


def _bit(kind: str, y: int) -> int:
    return 1 << (2 * _ORDER[kind] + y)


#: The stratum of documents that values are planted into.
_PLANT = 1 << 2 * len(KINDS)


def _strata(batches):
    """(k, strata) of the documents with base matches or failing ones: a bit for each kind and label."""
    for batch in batches:
        bits = [sum(_bit(*g) for g in _labelled(t)) for t in pc.fill_null(batch.column(1), "").to_pylist()]
        some = pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.int32())], names=["k", "strata"])
        yield some.filter(pa.array([b > 0 for b in bits], pa.bool_()))


def _examples(batches):
    """(label, third, features) of a sample's candidates in the strata asked for."""
    for batch in batches:
        xs, ys, thirds = [], [], []
        for text, strata in zip(pc.fill_null(batch.column(0), "").to_pylist(), batch.column(1).to_pylist()):
            seed, had = zlib.crc32(text.encode()), len(xs)
            for (kind, y), found in _labelled(text).items():
                if strata & _bit(kind, y):
                    step = max(len(found) / TRAIN_CANDIDATES, 1)
                    for n in range(min(len(found), TRAIN_CANDIDATES)):
                        xs.append(features(text, *found[int(n * step)]))
                        ys.append(y)
            if strata & _PLANT:
                for y, whole, *s in planted_examples(text, random.Random(seed)):
                    xs.append(features(whole, *s))
                    ys.append(y)
            thirds += [seed % 3] * (len(xs) - had)
        yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(thirds, pa.int32()), pa.array([np.array(x).tobytes() for x in xs], pa.binary())], names=["y", "third", "x"])


class Selector:
    """Trees, the calibration of their scores, and each kind's threshold."""

    def __init__(self, model: Boosted, slope: float, shift: float, thresholds: dict[str, float]):
        self.model, self.slope, self.shift, self.thresholds = model, slope, shift, thresholds

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.model.raw(x) + self.shift)


def _threshold(p: np.ndarray, true: np.ndarray) -> float | None:
    """The least score down to which the share of true ones is ``PRECISION``; None without one or with few true ones."""
    order = np.argsort(-p, kind="stable")
    ps, ts = p[order], true[order]
    fit = np.flatnonzero(np.cumsum(ts) >= PRECISION * np.arange(1, len(ts) + 1))
    if not len(fit) or ts.sum() < LEAST_TRUE:
        return None
    # halfway to the next lower score, so that a gap between the classes is shared
    low = ps[fit[-1] + 1] if fit[-1] + 1 < len(ps) else 0.0
    return max(float(ps[fit[-1]] + low) / 2, 0.5)


def fit_selector(x: np.ndarray, y: np.ndarray, hold: np.ndarray) -> Selector:
    """Boosts on the candidates that are not held out, calibrates and sets thresholds on the others."""
    if not len(y) or y.min() == y.max():
        return Selector(Boosted(0.0, []), 1.0, 0.0, {k: 2.0 for k in KINDS})
    if min((~hold).sum(), hold.sum()) < 10 or y[~hold].min() == y[~hold].max():
        # a handful of documents: all of them train and calibrate
        hold = np.ones(len(y), bool)
        model = boost(x, y, rounds=100, depth=4, rate=0.2)
    else:
        model = boost(x[~hold], y[~hold], rounds=100, depth=4, rate=0.2)
    raw, yh = model.raw(x[hold]), y[hold].astype(float)
    # a logistic curve through the held-out scores, with the usual smoothed targets
    pos, neg = yh.sum(), len(yh) - yh.sum()
    goal = np.where(yh > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * raw + b)
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - goal) * raw).sum(), (p - goal).sum()])
        h = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        a, b = a - float(np.clip(d[0], -1, 1)), b - float(np.clip(d[1], -1, 1))
    p = sigmoid(a * raw + b)
    # where even all kinds are too few to count, what is likelier true than not
    pooled = _threshold(p, yh) or 0.5
    thresholds = {kind: _threshold(p[own], yh[own]) or pooled for kind, own in ((kind, x[hold][:, k] > 0) for k, kind in enumerate(KINDS))}
    return Selector(model, a, b, thresholds)


def train_selector(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Selector:
    """Fits on at most ``train_docs`` documents a stratum, those with the least hashes of their ids; without any, nothing is added to base spans.

    Rows without an id are not drawn; of rows with one id the least text. Equal tables give equal selectors.
    """
    docs = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("k IS NOT NULL")
    held = arrow_map(docs, _strata, docs.select("k", F.lit(0).alias("strata")).schema)
    held = materialize(held.groupBy("k").agg(F.bit_or("strata").alias("strata")), "pii-strata")
    least = (F.xxhash64("k"), F.col("k"))
    picks = [docs.where("t <> ''").groupBy("k").agg(F.lit(_PLANT).alias("strata")).orderBy(*least).limit(train_docs)]
    for bit in (1 << n for n in range(2 * len(KINDS))):
        own = held.where(F.col("strata").bitwiseAND(bit) > 0).select("k")
        picks.append(own.orderBy(*least).limit(train_docs).withColumn("strata", F.lit(bit)))
    chosen = reduce(DataFrame.union, picks).groupBy("k").agg(F.bit_or("strata").alias("strata"))
    sample = docs.join(F.broadcast(chosen), "k").groupBy("k", "strata").agg(F.min("t").alias("t")).select("t", "strata")
    got = arrow_map(sample, _examples, "y int, third int, x binary").toArrow()
    discard(held)
    x = np.frombuffer(b"".join(got.column("x").to_pylist())).reshape(-1, FEATURES)
    y, third = (got.column(c).to_numpy().astype(np.int64) for c in ("y", "third"))
    # one order, however the rows came
    order = np.lexsort([third, y, *x.T])
    return fit_selector(x[order], y[order], third[order] == 0)


class Covered:
    """Spans that lie within a base span, which says all that they could say."""

    def __init__(self, base: list[tuple[str, int, int]]):
        order = sorted((b, e) for _, b, e in base)
        self.starts = [b for b, _ in order]
        self.ends = list(accumulate((e for _, e in order), max))

    def __contains__(self, span: tuple[str, int, int]) -> bool:
        k = bisect_right(self.starts, span[1])
        return k > 0 and self.ends[k - 1] >= span[2]


def find_spans(texts: list[str], selector: Selector) -> tuple[list[list], list[list]]:
    """Base spans and all spans of each text, by start, then kind.

    An added span may hold or cross base spans, but never lies within one or overlaps another added one.
    """
    base, extra, xs, owner = [], [], [], []
    for t in texts:
        good, _ = base_spans(t)
        base.append(good)
        covered = Covered(good)
        for s in proposals(t):
            if s not in covered:
                extra.append(s)
                xs.append(features(t, *s))
                owner.append(len(base) - 1)
    spans = [list(b) for b in base]
    if extra:
        p = selector.scores(np.array(xs))
        taken: dict[int, tuple[list[int], list[int]]] = {}
        # likeliest first, then the longer, then the earlier one
        for k in sorted(range(len(extra)), key=lambda k: (owner[k], -p[k], extra[k][1] - extra[k][2], extra[k][1], _ORDER[extra[k][0]])):
            kind, start, end = extra[k]
            if p[k] < selector.thresholds[kind]:
                continue
            starts, ends = taken.setdefault(owner[k], ([], []))
            at = bisect_right(starts, start)
            if (at == 0 or ends[at - 1] <= start) and (at == len(starts) or starts[at] >= end):
                starts.insert(at, start)
                ends.insert(at, end)
                spans[owner[k]].append(extra[k])
        for k in set(owner):
            spans[k].sort(key=lambda s: (s[1], _ORDER[s[0]]))
    return base, spans


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, or run of overlapping spans, replaced by the kind of the longest one in brackets."""
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, start, end = spans[k]
        longest = end - start
        k += 1
        while k < len(spans) and spans[k][1] < end:
            if spans[k][2] - spans[k][1] > longest:
                kind, longest = spans[k][0], spans[k][2] - spans[k][1]
            end = max(end, spans[k][2])
            k += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]]) if out else text


_COUNTS = ("n_email", "n_ip", "n_card", "n_phone")


def _scan(selector):
    def run(batches):
        sel = selector.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                base, spans = find_spans(pc.fill_null(part.column(1), "").to_pylist(), sel)
                counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS[:4]]
                sha = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, sha, pa.array([joined(s) for s in spans], pa.string()), pa.array([len(s) for s in spans], pa.int64())], names=["doc_id", *_COUNTS, "base_sha256", "spans", "n_spans"])

    return run


def personal_data(docs: DataFrame, selector: Selector) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of each row.

    A null text is empty, an empty text has no spans; rows stay as they are, repeated or
    without an id. ``n_spans`` counts all spans, base and added. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(selector)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(rows, _scan(shared), "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_sha256 string, spans string, n_spans long")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return personal_data(docs, train_selector(docs))


def _redacted(at_text: int, at_chars: int, selector):
    def run(batches):
        sel = selector.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(at_text).to_pylist()
                _, spans = find_spans([t or "" for t in texts], sel)
                new = [None if t is None else redact(t, s) for t, s in zip(texts, spans)]
                cols = list(part.columns)
                cols[at_text] = pa.array(new, pa.string())
                if at_chars >= 0:
                    old = part.column(at_chars).to_pylist()
                    cols[at_chars] = pa.array([n if not s else len(t) for n, s, t in zip(old, spans, new)], pa.int64())
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return run


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: spans are replaced by their kinds, n_chars follows; rows and other columns stay. A null text stays null."""
    shared = spark.sparkContext.broadcast(train_selector(docs))
    cols = docs.columns
    chars = cols.index("n_chars") if "n_chars" in cols else -1
    if chars >= 0:
        docs = docs.withColumn("n_chars", F.col("n_chars").cast("long"))
    return arrow_map(docs, _redacted(cols.index("text"), chars, shared), docs.schema)
