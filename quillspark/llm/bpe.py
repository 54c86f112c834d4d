"""Byte-level BPE: pre-tokenisation without regex, cached pair merging, decoding by offsets.

Pre-tokenisation. Code points become classes by one table look-up (letter, number,
space, white space, other, and apostrophes that a contraction follows); a class
also tells whether a run of white space ends there. A small automaton over these
classes says where pieces start. Its transition functions compose associatively,
so the states of all positions come from a blocked scan: the functions of all
blocks are composed side by side, one pass over the blocks carries the state
across, and a second side-by-side pass fills in the states.

Merging. Equal pieces are merged once: pieces of a slice are told apart by
hashes, found in a bounded cache, and the rest are merged together, a step of
all pieces at a time (the lowest rank first, leftmost on ties); long pieces use
a heap. The ids of a slice with their offsets are what decoding needs: bytes are
gathered from one table of all tokens' bytes.

The rank file's place is a parameter; it is read on the executors from the
installed package of public tokenizers and never copied.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vector import Kept, mix, prefix_hash, ragged_index, span_hash, text_slices
from .workspace import arrow_map, extended

#: Ids and pieces (as a power of two) that the cache of merged pieces holds before it starts anew: some 25 MB.
CACHE_IDS, CACHE_BITS = 3_000_000, 19
_LONG = 48

# ---------------------------------------------------------------- classes
_LETTER, _NUMBER, _OTHER, _BLANK, _SPACE, _RESET = range(6)
# with what follows: white space inside a run, its last one before something solid, and apostrophes
_C_LETTER, _C_NUMBER, _C_OTHER, _C_INNER, _C_LASTBLANK, _C_LASTSPACE, _C_SHORT, _C_LONG, _C_RESET = range(9)

#: Code points with the property White_Space (fixed values).
_WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# states: B begins anew, L N O inside a run, M inside white space, P a space that the next run takes in, K2 K1 code points of a contraction still to come
_B, _L, _N, _O, _M, _P, _K2, _K1 = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """step[class, state] is the next state, cut[class, state] whether a piece starts at this code point."""
    step, cut = np.zeros((9, 8), np.uint8), np.zeros((9, 8), bool)
    runs = {_C_LETTER: _L, _C_NUMBER: _N, _C_OTHER: _O, _C_SHORT: _O, _C_LONG: _O}
    for c in range(9):
        for s in range(8):
            if c == _C_RESET:
                to, new = _B, True
            elif s == _K2:
                to, new = _K1, False
            elif s == _K1:
                to, new = _B, False
            elif c in (_C_SHORT, _C_LONG) and s not in (_O, _P):
                to, new = (_K1 if c == _C_SHORT else _K2), True
            elif c in runs:
                to = runs[c]
                new = s not in (to, _P)
            elif c == _C_INNER:
                to, new = _M, s != _M
            else:
                to, new = (_B if c == _C_LASTBLANK else _P), True
            step[c, s], cut[c, s] = to, new
    return step, cut


_STEP, _CUT = _automaton()
_tables: dict[str, np.ndarray] = {}


def _classes() -> np.ndarray:
    if "class" not in _tables:
        t = np.full(0x110000, _OTHER, np.uint8)
        for cp in range(0x110000):
            kind = unicodedata.category(chr(cp))[0]
            if kind == "L":
                t[cp] = _LETTER
            elif kind == "N":
                t[cp] = _NUMBER
        t[list(_WHITE)] = _BLANK
        t[0x20] = _SPACE
        _tables["class"] = t
    return _tables["class"]


def _scan(cls: np.ndarray, block: int = 128) -> np.ndarray:
    """The state before each position, by composing the transition functions of blocks."""
    n = len(cls)
    rows = -(-n // block)
    grid = np.full(rows * block, _C_RESET, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    table = _STEP.reshape(-1)
    whole = np.repeat(np.arange(8, dtype=np.uint8)[:, None], rows, axis=1)
    for k in range(block):
        whole = table[(grid[k].astype(np.intp) << 3) + whole]
    into = np.empty(rows, np.uint8)
    state = _B
    for r, col in enumerate(whole.T.tolist()):
        into[r] = state
        state = col[state]
    out = np.empty((block, rows), np.uint8)
    for k in range(block):
        out[k] = into
        into = table[(grid[k].astype(np.intp) << 3) + into]
    return out.T.reshape(-1)[:n]


def piece_starts(cps: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Marks the code points at which a piece starts; ``doc_start`` marks the first ones of texts."""
    n = len(cps)
    kind = _classes()[cps]
    white = (kind == _BLANK) | (kind == _SPACE)
    last = np.ones(n, bool)
    last[:-1] = ~white[1:]
    ends = np.ones(n, bool)
    ends[:-1] = doc_start[1:]
    cls = np.array([_C_LETTER, _C_NUMBER, _C_OTHER, _C_LASTBLANK, _C_LASTSPACE, _C_RESET], np.uint8)[kind]
    cls[white & (~last | ends)] = _C_INNER
    mark = np.flatnonzero(cps == 0x27)
    if len(mark):
        # code points after each apostrophe, 0 beyond its text
        one = np.where(ends[mark], 0, cps[np.minimum(mark + 1, n - 1)])
        two = np.where(ends[mark] | ends[np.minimum(mark + 1, n - 1)], 0, cps[np.minimum(mark + 2, n - 1)])
        short = np.isin(one, [ord(x) for x in "stmd"])
        long_ = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        cls[mark[short]] = _C_SHORT
        cls[mark[long_]] = _C_LONG
    # a reset before each text: its class sequence starts anew
    at = np.flatnonzero(doc_start)
    spread = np.full(n + len(at), _C_RESET, np.uint8)
    place = np.arange(n) + np.cumsum(doc_start)
    spread[place] = cls
    state = _scan(spread)[place]
    return _CUT[cls, state] | doc_start


# ---------------------------------------------------------------- merging
class _Pieces:
    """Ids of pieces by their hashes: an open-addressing table, half full at most, probed side by side."""

    def __init__(self, bits: int = CACHE_BITS + 1, ids: int = 1 << 16):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.first, self.size = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.pool = np.zeros(ids, np.int32)
        self.count = self.used = 0

    def fits(self, pieces: int, ids: int) -> bool:
        return self.count + pieces <= len(self.keys) // 2 and self.used + ids <= max(CACHE_IDS, len(self.pool))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        at = (keys >> self.shift).astype(np.int64)
        got = self.keys[at]
        out = np.where(got == keys, at, -1)
        wait = np.flatnonzero((got != keys) & (got != 0))
        while len(wait):
            at[wait] = (at[wait] + 1) & self.mask
            got = self.keys[at[wait]]
            same = got == keys[wait]
            out[wait[same]] = at[wait[same]]
            wait = wait[~same & (got != 0)]
        return out

    def add(self, keys: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        """Distinct new keys with the numbers of their ids, and all ids."""
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(self.used, len(flat)) + len(flat), np.int32)])
        first = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + len(flat)] = flat
        at = (keys >> self.shift).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            some, won = np.unique(at[free], return_index=True)
            won = free[won]
            self.keys[some], self.first[some], self.size[some] = keys[won], first[won], sizes[won]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask
        self.count += len(keys)
        self.used += len(flat)


class Vocabulary:
    """Ranks of byte strings, and everything built from them."""

    def __init__(self, path: str):
        with open(path, "rb") as fh:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, fh)}
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for t, r in ranks.items():
            tokens[r] = t
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.lens)])
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        left, right, rank = [], [], []
        for t, r in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        key = np.array(left, np.int64) << 20 | np.array(right, np.int64)
        self._table(key, np.array(rank, np.int32))
        digits = [b"%d" % k for k in range(size)]
        self.digit_lens = np.array([len(d) for d in digits], np.int64)
        self.digit_at = np.concatenate([[0], np.cumsum(self.digit_lens)])
        self.digit_blob = np.frombuffer(b"".join(digits), np.uint8)
        self.pairs: dict[int, int] | None = None
        self.pieces = _Pieces()

    def _table(self, key: np.ndarray, rank: np.ndarray) -> None:
        """An open-addressing table of pairs, a quarter full; probed side by side."""
        bits = max(4, int(4 * max(len(key), 1)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, 1 << 30, np.int32)
        at = self._slot(key)
        left = np.arange(len(key))
        while len(left):
            free = self.slots[at[left]] < 0
            some, first = np.unique(at[left[free]], return_index=True)
            won = left[free][first]
            self.slots[some] = key[won]
            self.values[some] = rank[won]
            done = np.zeros(len(key), bool)
            done[won] = True
            left = left[~done[left]]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, 2**30 where there is none."""
        key = (a << 20) | b
        at = self._slot(key)
        got = self.slots[at]
        out = np.where(got == key, self.values[at], 1 << 30)
        wait = np.flatnonzero((got != key) & (got >= 0))
        while len(wait):
            at[wait] = (at[wait] + 1) & self.mask
            got = self.slots[at[wait]]
            same = got == key[wait]
            out[wait[same]] = self.values[at[wait[same]]]
            wait = wait[~same & (got >= 0)]
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Lowest rank first, leftmost on ties, with a heap and a linked list."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        if self.pairs is None:
            used = self.slots >= 0
            self.pairs = dict(zip(self.slots[used].tolist(), self.values[used].tolist()))
        pairs = self.pairs
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := pairs.get(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (s := pairs.get(r << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (s, i, r, ids[k]))
            h = prv[i]
            if h >= 0 and (s := pairs.get(ids[h] << 20 | r)) is not None:
                heapq.heappush(heap, (s, h, ids[h], r))
        return np.array([x for x in ids if x >= 0], np.int32)

    def merge_many(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> list[np.ndarray]:
        """Ids of each span, spans of one length merged together a step at a time."""
        out: list[np.ndarray] = [None] * len(starts)
        for size in np.unique(lens).tolist():
            which = np.flatnonzero(lens == size)
            if size > _LONG:
                for w in which.tolist():
                    out[w] = self.merge_long(data[starts[w] : starts[w] + size].tobytes())
                continue
            for lo in range(0, len(which), 8192):
                part = which[lo : lo + 8192]
                ids = self.byte[data[starts[part][:, None] + np.arange(size)]]
                count = np.full(len(part), size)
                if size > 1:
                    self._merge(ids, count)
                for w, row, c in zip(part.tolist(), ids.astype(np.int32), count.tolist()):
                    out[w] = row[:c].copy()
        return out

    def _merge(self, ids: np.ndarray, count: np.ndarray) -> None:
        none = 1 << 30
        rank = self.rank_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        live = np.arange(len(ids))
        width = ids.shape[1]
        while True:
            best = rank[live].argmin(axis=1)
            low = rank[live, best]
            has = low < none
            live, best, low = live[has], best[has], low[has]
            if not len(live):
                return
            # the merged pair becomes one token, everything after it moves left
            cols = np.arange(width - 1)
            src = np.minimum(cols + (cols > best[:, None]), width - 1)
            sub = np.take_along_axis(ids[live], src, axis=1)
            at = np.arange(len(live))
            sub[at, best] = low
            ids[live, : width - 1] = sub
            rk = np.full((len(live), width - 1), none)
            rk[:, : width - 2] = np.take_along_axis(rank[live], np.minimum(cols[: width - 2] + (cols[: width - 2] >= best[:, None]), width - 2), axis=1)
            count[live] -= 1
            c = count[live]
            rk[np.arange(width - 1)[None, :] >= (c - 1)[:, None]] = none
            new = best > 0
            rk[at[new], best[new] - 1] = self.rank_of(sub[at[new], best[new] - 1], low[new].astype(np.int64))
            new = best < c - 1
            rk[at[new], best[new]] = self.rank_of(low[new].astype(np.int64), sub[at[new], best[new] + 1])
            rank[live] = rk

    def encode_slice(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, each text's first id, each piece's first byte and first id.

        The ends of the last two are one past the last piece.
        """
        if not len(data):
            z = np.zeros(1, np.int64)
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64), z, z
        lead = (data & 0xC0) != 0x80
        first_byte = np.flatnonzero(lead)
        cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        doc = np.zeros(len(data) + 1, bool)
        doc[offs] = True
        mark = piece_starts(cps, doc[:-1][first_byte])
        starts = first_byte[mark]
        ends = np.append(starts[1:], len(data))
        # 0 marks a free place of the cache
        keys = np.maximum(span_hash(prefix_hash(data), starts, ends), np.uint64(1))
        at = self.pieces.find(keys)
        if (at < 0).any():
            self._merged(keys, np.flatnonzero(at < 0), data, starts, ends)
            at = self.pieces.find(keys)
            if (at < 0).any():
                # the cache started anew
                self._merged(keys, np.flatnonzero(at < 0), data, starts, ends)
                at = self.pieces.find(keys)
        pieces = self.pieces
        per = pieces.size[at].astype(np.int64)
        ids = pieces.pool[ragged_index(pieces.first[at].astype(np.int64), per)]
        id_at = np.concatenate([[0], np.cumsum(per)])
        first = id_at[np.searchsorted(starts, offs)]
        return ids, first, np.append(starts, len(data)), id_at

    def _merged(self, keys: np.ndarray, miss: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Merges the missing pieces and adds them to the cache, which starts anew when it is full."""
        uniq, first = np.unique(keys[miss], return_index=True)
        at = miss[first]
        got = self.merge_many(data, starts[at], ends[at] - starts[at])
        sizes = np.array([len(g) for g in got], np.int64)
        flat = np.concatenate(got)
        if not self.pieces.fits(len(uniq), len(flat)):
            # a slice of one very long text can need a larger one
            self.pieces = _Pieces(max(CACHE_BITS + 1, (4 * len(keys)).bit_length()))
        self.pieces.add(uniq, sizes, flat)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, gathered from the tokens' bytes."""
        ids = np.asarray(ids, np.int64)
        return self.blob[ragged_index(self.at[ids], self.lens[ids])]

    def digits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each id in decimal with a space before it, and where each begins (one more at the end)."""
        lens = self.digit_lens[ids] + 1
        at = np.concatenate([[0], np.cumsum(lens)])
        out = np.full(at[-1], 32, np.uint8)
        solid = np.ones(at[-1], bool)
        solid[at[:-1]] = False
        out[solid] = self.digit_blob[ragged_index(self.digit_at[ids], self.digit_lens[ids])]
        return out, at


_loaded = Kept(Vocabulary)


def vocabulary(path: str | None = None) -> Vocabulary:
    """The vocabulary of a rank file, kept by a worker while its tasks use it. None: byte_bpe_50k."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return _loaded.get(path)


def _encode(path: str | None):
    def run(batches):
        voc = vocabulary(path)
        for batch in batches:
            ids, starts, flat = [np.zeros(1, np.int64)], [], []
            total = 0
            piece_n, piece_at, piece_id = [np.zeros(1, np.int64)], [], []
            for _, _, data, offs in text_slices(batch.column(0)):
                tok, first, p_byte, p_id = voc.encode_slice(data, offs)
                flat.append(tok)
                ids.append(first[1:] + total)
                total += len(tok)
                bounds = np.searchsorted(p_byte[:-1], offs)
                piece_n.append(np.diff(bounds))
                owner = np.repeat(np.arange(len(offs) - 1), np.diff(bounds))
                piece_at.append(p_byte[:-1] - offs[:-1][owner])
                piece_id.append(p_id[:-1] - first[:-1][owner])
            flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
            cuts = np.concatenate(ids).astype(np.int32)
            pieces = np.cumsum(np.concatenate(piece_n)).astype(np.int32)
            wrap = lambda cut, xs: pa.ListArray.from_arrays(pa.array(cut), pa.array((np.concatenate(xs) if xs else np.zeros(0)).astype(np.int32)))
            cols = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat)), wrap(pieces, piece_at), wrap(pieces, piece_id)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(1, batch.num_columns)), *cols], names=[*batch.schema.names[1:], "ids", "piece_bytes", "piece_ids"])

    return run


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array of ints), ``piece_bytes`` and ``piece_ids``.

    The last two are the first byte and the first id of each piece within its text,
    so any range of bytes can be decoded from a part of the ids. A null or empty
    text has empty arrays. Columns of these names are replaced, all others kept.
    """
    keep = [c for c in docs.columns if c not in ("ids", "piece_bytes", "piece_ids")]
    schema = extended(docs.select(*keep).schema, "ids array<int>, piece_bytes array<int>, piece_ids array<int>")
    return arrow_map(docs.select(F.col(text_col).alias("__text"), *keep), _encode(path), schema)


def decode(tokens: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """``tokens`` with the bytes of each array of ids (binary); null or empty arrays give no bytes."""
    keep = [c for c in tokens.columns if c != out_col]

    def run(batches):
        voc = vocabulary(path)
        for batch in batches:
            col = batch.column(0)
            out = [voc.decode(np.array(x.as_py() or [], np.int64)).tobytes() for x in col]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.binary())], names=[*batch.schema.names[1:], out_col])

    return arrow_map(tokens.select(F.col(ids_col).alias("__ids"), *keep), run, tokens.select(*keep).schema.add(out_col, "binary"))


_DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(path: str | None, with_ids: bool = False):
    """Encodes, then decodes the ids, slice by slice; bytes do not leave the worker, ids only if asked for."""

    def run(batches):
        voc = vocabulary(path)
        for batch in batches:
            n, a, b, all_ids = [], [], [], []
            for lo, hi, data, offs in text_slices(batch.column(1)):
                ids, first, _, _ = voc.encode_slice(data, offs)
                text, at = voc.digits(ids)
                back = voc.decode(ids)
                back_at = np.concatenate([[0], np.cumsum(voc.lens[ids])])[first].tolist()
                cut = at[first].tolist()
                n.append(np.diff(first))
                if with_ids:
                    all_ids.append(ids)
                text, back = text.tobytes(), back.tobytes()
                for d in range(hi - lo):
                    a.append(hashlib.sha256(text[cut[d] + 1 : cut[d + 1]]).hexdigest())
                    b.append(hashlib.sha256(back[back_at[d] : back_at[d + 1]]).hexdigest())
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            cols, names = [batch.column(0), pa.array(n), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cuts = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                cols.append(pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row.

    A null or empty text has no tokens and the digests of nothing; rows stay as they are,
    repeated or without an id; an empty table gives an empty table. Other columns are ignored.
    """
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), _digests(path), _DIGEST)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` by the ranks of byte_bpe_50k. Odd rows as in :func:`token_digests`."""
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last one: the corpus as tokens, a row for each document.

    doc_id, n_tokens, digests of the ids and of the bytes they decode to, and ``ids`` (array
    of ints). Odd rows as in :func:`token_digests`.
    """
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), _digests(None, True), _DIGEST + ", ids array<int>")
