"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Plan, for documents as sets of word shingles and a similarity of ``percent`` / 100:

1. Shingles are counted in a table of cells, about one for every two shingles of the
   corpus but at most ``2**MOST_BITS``. The order of shingles is (binary logarithm of
   the cell's count, hash): rare first. It is one total order for all documents, so a
   link cannot hide: two sets that reach the similarity share a shingle of their
   prefixes. A coarse count only makes prefixes less selective, never wrong.
2. The prefix shingles alone, six bytes each and packed by range, are exchanged once;
   those that occur more than once are marked in a bit table of bounded size. Two
   shingles of one bit are both kept, so the table never drops a shared one.
3. One pass over the texts then gives a row for each document (set size and a 128-bit
   key of its set) with the marked part of its prefix and the counts of its shingles by
   part of the hash space. Equal sets are one node from here on, however many copies
   there are; a document with several texts has several nodes.
4. A bucket is a prefix shingle that several nodes share. Buckets are not expanded
   into pairs: in each round a bucket's members that are not yet connected to its leader
   are held against its leader, then a few pivots, so members already known to be
   connected are never compared again. The pairs of a round pass the length,
   positional and suffix filters and are verified once, on the whole sets. What is
   open after the rounds is paired whole: in buckets of up to ``SMALL`` nodes every
   member with every other, in larger ones only members that agree on a whole part of
   the hash space (see :func:`_part_keys`), which similar sets must.
5. Components are found by star contractions; the keys of sets lead back to documents.

The suffix filter compares how many shingles of the two sets fall in each part of
the hash space; the summed differences are a lower bound of the symmetric
difference. The join itself uses 16 parts; pairs that are left are held to 256
parts before any whole text is sent to them. For that, a pair's texts meet at one of
its two nodes, whose own text is sent once for ``GROUP`` partners.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .vector import distinct_sets, mix, trim
from .workspace import arrow_map, bounded_broadcast, discard, materialize

#: Cells of the count table, as powers of two. Levels take half a byte a cell, so
#: what is broadcast is 32 MiB at most; a fuller table orders less sharply. The bit
#: table of shared shingles has twice as many bits, 16 MiB at most.
LEAST_BITS, MOST_BITS = 20, 26
_CHUNK = 1 << 16
_PARTS, _FINE = 16, 256
#: Pivots that a bucket with more members offers in each round after its leader.
PIVOTS = (16, 256)
#: Members of a bucket that are paired with each other after these rounds.
SMALL = 8192
#: Partners of a node whose texts meet in one group.
GROUP = 128
#: Distinct sets that a task remembers, so that copies next to each other are sent once.
_SEEN = 1 << 15

_HIST = [f"h{k}" for k in range(_PARTS)]


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a set that does not depend on an order."""
    a = mix(s ^ np.uint64(0x6A09E667F3BCC908)).sum(dtype=np.uint64)
    b = mix(s + np.uint64(0xBB67AE8584CAA73B)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


# ---------------------------------------------------------------- counts
def _pack_counts(counts: np.ndarray):
    """The non-empty chunks of a count table: a byte of gap for each cell in use, then the counts above 1."""
    for k in range(0, len(counts), _CHUNK):
        part = counts[k : k + _CHUNK]
        at = np.flatnonzero(part)
        if len(at):
            gap = np.diff(at, prepend=-1) - 1
            skip = gap // 255
            body = np.full(len(at) + int(skip.sum()), 255, np.uint8)
            body[np.cumsum(skip + 1) - 1] = gap % 255
            more = np.flatnonzero(part[at] > 1)
            yield k // _CHUNK, np.uint32(len(body)).tobytes() + body.tobytes() + more.astype(np.uint16).tobytes() + part[at][more].tobytes()


def _add_counts(into: np.ndarray, packed: bytes) -> None:
    n = int(np.frombuffer(packed, np.uint32, 1)[0])
    body = np.frombuffer(packed, np.uint8, n, 4).astype(np.int64)
    at = (np.cumsum(np.where(body == 255, 255, body + 1)) - 1)[body < 255]
    rest = len(packed) - 4 - n
    more = np.frombuffer(packed, np.uint16, rest // 3, 4 + n)
    c = np.ones(len(at), np.int64)
    c[more] = np.frombuffer(packed, np.uint8, rest // 3, 4 + n + 2 * (rest // 3))
    into[at] += c


def _count_cells(counts: np.ndarray, cells: list[np.ndarray]) -> None:
    if cells:
        u, c = np.unique(np.concatenate(cells), return_counts=True)
        u = u.astype(np.int64)
        counts[u] = np.minimum(counts[u] + c, 255).astype(np.uint8)


def _packed_rows(packed, name: str, rows: int = 16):
    """Batches (chunk, ``name``) of (chunk, bytes)."""
    chunks, data = [], []
    for c, b in packed:
        chunks.append(c)
        data.append(b)
        if len(chunks) == rows:
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(data, pa.binary())], names=["chunk", name])
            chunks, data = [], []
    if chunks:
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(data, pa.binary())], names=["chunk", name])


def _counted(words: int, bits: int):
    """The shingle counts of a task's documents."""

    def run(batches):
        counts = np.zeros(1 << bits, dtype=np.uint8)
        pending, held = [], 0
        for batch in batches:
            for _, s in distinct_sets(batch.column(0), words):
                pending.append(s >> np.uint64(64 - bits))
                held += len(s)
                if held > 1 << 19:
                    _count_cells(counts, pending)
                    pending, held = [], 0
        _count_cells(counts, pending)
        del pending
        yield from _packed_rows(_pack_counts(counts), "counts")

    return run


def _merged(first, add, done):
    """Runs over (chunk, bytes) that arrive grouped: ``add`` each to ``first()``, then ``done`` gives a chunk's bytes."""

    def chunks(batches):
        now, total = None, None
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if chunk != now:
                    if now is not None:
                        yield now, done(total)
                    now, total = chunk, first()
                add(total, packed.as_py())
        if now is not None:
            yield now, done(total)

    return lambda batches: _packed_rows(chunks(batches), "out")


def _by_chunk(rows: DataFrame, function):
    """(chunk, bytes) that ``function`` makes of each chunk; the chunks spread over as many tasks as a shuffle has."""
    got = arrow_map(rows.repartition("chunk").sortWithinPartitions("chunk"), function, "chunk int, out binary").toArrow()
    for chunk, out in zip(got.column(0), got.column(1)):
        yield chunk.as_py(), out.as_buffer()


def _rarity(counts: DataFrame, bits: int, load: float) -> np.ndarray:
    """Binary logarithms of all cells' counts, two a byte; 2**(MOST_BITS - 1) bytes at the driver at most.

    ``load``: shingles a cell. Beyond two they are noise that every cell has: counts
    are taken in units of half the load, so common shingles still stand out.
    """
    unit = max(1.0, load / 2)

    def done(total):
        level = np.minimum(np.log2(np.maximum(total / unit, 1)), 15).astype(np.uint8)
        return (level[::2] | level[1::2] << 4).tobytes()

    out = np.zeros(1 << (bits - 1), np.uint8)
    half = _CHUNK // 2
    for chunk, level in _by_chunk(counts, _merged(lambda: np.zeros(_CHUNK, np.int64), _add_counts, done)):
        out[chunk * half : (chunk + 1) * half] = np.frombuffer(level, np.uint8)
    return out


def _levels(table: np.ndarray, s: np.ndarray, bits: int) -> np.ndarray:
    cell = (s >> np.uint64(64 - bits)).astype(np.int64)
    return (table[cell >> 1] >> ((cell & 1) << 2).astype(np.uint8)) & 15


# ---------------------------------------------------------------- prefixes
def needed_overlap(a: int, b: int, percent: int) -> int:
    """The least intersection of sets of these sizes with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def _prefix(s: np.ndarray, percent: int, level: np.ndarray, bits: int) -> np.ndarray:
    """The prefix of a set, rarest first."""
    n = len(s)
    size = n - -(-percent * n // 100) + 1
    cls = _levels(level, s, bits).astype(np.uint64)
    # ties of the shortened hash keep the order of the whole hash
    return s[np.argsort((cls << np.uint64(58)) | (s >> np.uint64(6)), kind="stable")[:size]]


class _Seen:
    """Set keys that a task has met; forgets when full, which costs a repeated row only."""

    def __init__(self):
        self.keys: set[tuple[int, int]] = set()

    def new(self, key: tuple[int, int]) -> bool:
        if key in self.keys:
            return False
        if len(self.keys) >= _SEEN:
            self.keys.clear()
        self.keys.add(key)
        return True


_TOKEN_BYTES = 6


def _range_bits(marks: int) -> int:
    """Ranges of hashes (chunks of the bit table) as a power of two."""
    return marks - _CHUNK.bit_length() + 1


def _packed_tokens(tokens: np.ndarray, ranges: int):
    """(chunk, bytes): the sorted tokens of each range, the bits below the range's in six bytes; at most two of equal ones."""
    t = np.sort(tokens)
    if len(t) > 2:
        t = t[np.concatenate([[True, True], t[2:] != t[:-2]])]
    chunk = (t >> np.uint64(64 - ranges)).astype(np.int64)
    low = (t << np.uint64(ranges)) >> np.uint64(64 - 8 * _TOKEN_BYTES)
    body = low.view(np.uint8).reshape(-1, 8)[:, :_TOKEN_BYTES]
    at = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(t) else np.zeros(0, np.int64)
    for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(t)]):
        yield int(chunk[lo]), body[lo:hi].tobytes()


def _prefix_tokens(words: int, percent: int, rarity, bits: int, ranges: int):
    """The prefix shingles of a task's sets, packed by range."""

    def run(batches):
        level, seen = rarity.value, _Seen()
        pending, held = [], 0
        for batch in batches:
            for _, s in distinct_sets(batch.column(0), words):
                if len(s) and seen.new(_set_key(s)):
                    pending.append(_prefix(s, percent, level, bits))
                    held += len(pending[-1])
                    if held > 1 << 21:
                        yield from _packed_rows(_packed_tokens(np.concatenate(pending), ranges), "tokens")
                        pending, held = [], 0
        if pending:
            yield from _packed_rows(_packed_tokens(np.concatenate(pending), ranges), "tokens", 64)

    return run


def _shared_bits(tokens: DataFrame, marks: int) -> np.ndarray:
    """A bit for each range of hashes in which a prefix shingle occurs twice; 2**marks / 8 bytes at the driver."""

    def done(parts):
        raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, _TOKEN_BYTES)
        low = np.zeros((len(raw), 8), np.uint8)
        low[:, :_TOKEN_BYTES] = raw
        low = np.sort(low.view(np.uint64).ravel())
        bit = np.zeros(_CHUNK, bool)
        bit[(low[1:][low[1:] == low[:-1]] >> np.uint64(8 * _TOKEN_BYTES - 16)).astype(np.int64)] = True
        return np.packbits(bit, bitorder="little").tobytes()

    out = np.zeros(1 << (marks - 3), np.uint8)
    for chunk, bits in _by_chunk(tokens, _merged(list, list.append, done)):
        out[chunk * _CHUNK // 8 : (chunk + 1) * _CHUNK // 8] = np.frombuffer(bits, np.uint8)
    return out


_SET = "doc_id long, digest long, n long, k1 long, k2 long, tokens array<long>, places array<int>, fine binary, " + ", ".join(f"{h} short" for h in _HIST)
_SET_NAMES = [x.split()[0] for x in _SET.split(", ")]


def _sets(words: int, percent: int, rarity, bits: int, shared, marks: int):
    """A row for each document: size and key; for the first of equal sets with marked shingles also those and its shape."""

    def run(batches):
        level, marked, seen = rarity.value, shared.value, _Seen()
        for batch in batches:
            rows = batch.num_rows
            n = np.zeros(rows, np.int64)
            k1, k2 = n.copy(), n.copy()
            have = np.zeros(rows, bool)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            tokens, places, fine = [], [], []
            for row, s in distinct_sets(batch.column(2), words):
                if not len(s):
                    continue
                n[row] = len(s)
                k1[row], k2[row] = key = _set_key(s)
                if not known[row] or not seen.new(key):
                    continue
                p = _prefix(s, percent, level, bits)
                bit = p >> np.uint64(64 - marks)
                hit = np.flatnonzero((marked[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
                if len(hit):
                    have[row] = True
                    tokens.append(p[hit].view(np.int64))
                    places.append(hit.astype(np.int32))
                    fine.append(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=_FINE))
            size = np.zeros(rows, np.int64)
            size[have] = [len(t) for t in tokens]
            cuts = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            none = pa.array(~have)
            lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(v) if v else np.zeros(0), t), mask=none) for v, t in ((tokens, pa.int64()), (places, pa.int32()))]
            # counts are cut off at a byte: the differences stay lower bounds
            shape = np.zeros((rows, _FINE), np.int64)
            if fine:
                shape[have] = fine
            coarse = np.minimum(shape.reshape(rows, _PARTS, -1).sum(axis=2), 32767).astype(np.int16)
            packed = [f.tobytes() if h else None for f, h in zip(np.minimum(shape, 255).astype(np.uint8), have)]
            cols = [pa.array(n), pa.array(k1), pa.array(k2), *lists, pa.array(packed, pa.binary()), *(pa.array(coarse[:, k], mask=~have) for k in range(_PARTS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=_SET_NAMES)

    return run


# ---------------------------------------------------------------- pairs
def _close_enough(percent: int):
    """Keeps the pairs (a, b, sizes, fine counts) whose fine counts leave room for the similarity."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, _FINE).astype(np.int16) for k in (4, 5))
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            need = -(-percent * total // (100 + percent))
            keep = np.abs(x - y).sum(axis=1, dtype=np.int64) <= total - 2 * need
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(words: int, percent: int):
    """(a, b) of the members that reach the similarity with the head of their group; rows come by group, heads first."""

    def run(batches):
        group, head = None, None
        for batch in batches:
            key, salt, member, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            a, b = [], []
            for row, s in distinct_sets(batch.column(4), words):
                own = (key[row], salt[row])
                if not member[row]:
                    group, head = own, s
                elif own == group:
                    both = np.sort(np.concatenate([head, s]))
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= percent * (len(both) - common):
                        a.append(int(node[row]))
                        b.append(int(key[row]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _length(p_n: Column, q_n: Column, percent: int) -> Column:
    return (p_n * 100 >= q_n * percent) & (q_n * 100 >= p_n * percent)


def _need(p_n: Column, q_n: Column, percent: int) -> Column:
    return F.ceil(F.lit(percent) * (p_n + q_n) / F.lit(100 + percent))


def _pairs(probe: DataFrame, pivots: DataFrame, percent: int, keys: tuple[str, ...] = ("token",)) -> DataFrame:
    """Pairs (a: member, b: pivot) of one key in different components that pass the length, positional and suffix filters."""
    p = probe.select(*keys, *(F.col(c).alias(f"p_{c}") for c in probe.columns if c not in keys))
    q = pivots.select(*keys, *(F.col(c).alias(f"q_{c}") for c in pivots.columns if c not in keys))
    p_n, q_n = F.col("p_n"), F.col("q_n")
    need = _need(p_n, q_n, percent)
    positional = F.least(p_n - F.col("p_place"), q_n - F.col("q_place")) >= need
    apart = sum((F.abs(F.col(f"p_h{k}").cast("int") - F.col(f"q_h{k}").cast("int")) for k in range(_PARTS)), F.lit(0))
    on = F.col("p_comp") != F.col("q_comp")
    for k in keys:
        on = on & (p[k] == q[k])
    return p.join(q, on & _length(p_n, q_n, percent) & positional & (apart <= p_n + q_n - 2 * need)).select(F.col("p_node").alias("a"), F.col("q_node").alias("b")).distinct()


def _part_keys(words: int, percent: int, hot, marks: int):
    """(node, part, key) for whole sets: parts of the hash space on which similar sets agree.

    Let two sets of sizes a <= b reach the similarity. With a in the class c, they differ in
    at most D = :func:`_most_apart` shingles, so of P = 2 D + 1 parts they agree on D + 1 or
    more, also when the shingles of hot buckets are left out of both. A set emits a key for
    each part that is not empty, for its own class and those of the smaller partners it may
    have. Two sets whose agreeing parts are all empty have D + 1 empty parts or more each;
    such a set emits the keys of its whole parts as well, hot shingles and empty parts too.
    """

    def run(batches):
        marked = hot.value
        for batch in batches:
            node, part, key = [], [], []

            def emit(row, s, c, kind, every):
                p = 2 * _most_apart(c, percent) + 1
                at = (mix(s) % np.uint64(p)).astype(np.int64)
                sums = np.zeros(p, np.uint64)
                np.add.at(sums, at, mix(s + np.uint64(2 * c + kind)))
                empty = np.bincount(at, minlength=p) == 0
                use = np.arange(p) if every else np.flatnonzero(~empty)
                node.append(np.full(len(use), ids[row]))
                part.append(use + ((2 * c + kind) << 40))
                key.append(sums[use].view(np.int64))
                return int(empty.sum())

            ids = batch.column(0).to_pylist()
            for row, s in distinct_sets(batch.column(1), words):
                n = len(s)
                if not n:
                    continue
                bit = s >> np.uint64(64 - marks)
                cold = s[((marked[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1) == 0]
                for c in range(_size_class(-(-n * percent // 100)), _size_class(n) + 1):
                    if emit(row, cold, c, 0, False) > _most_apart(c, percent):
                        emit(row, s, c, 1, True)
            cols = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (node, part, key)]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "part", "key"])

    return run


def _size_class(n: int) -> int:
    """The class c of a size: class_start(c) <= n < class_start(c + 1)."""
    c = max(int(np.log(max(n, 1)) / np.log(1.25)) - 2, 0)
    while _class_start(c + 1) <= n:
        c += 1
    return c


def _class_start(c: int) -> int:
    return max(int(np.ceil(1.25**c)), c + 1)


def _most_apart(c: int, percent: int) -> int:
    """The largest symmetric difference of linked sets whose smaller one is of class ``c``."""
    return (_class_start(c + 1) - 1) * (100 - percent) // percent


def _bit_table(tokens: DataFrame, marks: int) -> np.ndarray:
    """A bit for each range of hashes that holds one of the column ``token``; 2**marks / 8 bytes at the driver at most."""
    bit = F.shiftrightunsigned("token", 64 - marks)
    words = tokens.select(F.shiftright(bit, 6).alias("at"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(token, {64 - marks}) & 63 AS INT))").alias("bit"))
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (marks - 6), np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


# ---------------------------------------------------------------- the join
class _Join:
    """What the rounds of a join share: whole texts, nodes and their buckets."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, members: DataFrame, words: int, percent: int, repeated: bool):
        self.docs, self.nodes, self.members = docs, nodes, members
        self.words, self.percent, self.repeated = words, percent, repeated
        self.comp: DataFrame | None = None
        #: Links so far; a component table has two nodes for each at most.
        self.links = 0

    def texts(self, asks: DataFrame, rows: int) -> DataFrame:
        """``asks`` (rep, digest and others), about ``rows`` of them, with the texts of these documents."""
        docs = self.docs
        if self.repeated:
            # of repeated rows one is sent, however many there are
            ends = asks.select(F.col("rep").alias("doc_id"), "digest").distinct()
            docs = docs.join(bounded_broadcast(ends, rows), ["doc_id", "digest"], "left_semi").groupBy("doc_id", "digest").agg(F.min("text").alias("text"))
        return docs.withColumnRenamed("doc_id", "rep").join(bounded_broadcast(asks, rows), ["rep", "digest"])

    def verified(self, pairs: DataFrame) -> int:
        """Verifies the pairs (a, b) and adds the links to the components; the number of links."""
        shape = self.nodes.select("node", "n", "fine")
        a, b = (shape.withColumnsRenamed({"node": x, "n": f"{x}_n", "fine": f"{x}_fine"}) for x in "ab")
        close = pairs.join(a, "a").join(b, "b").where(_length(F.col("a_n"), F.col("b_n"), self.percent))
        close = materialize(arrow_map(close.select("a", "b", "a_n", "b_n", "a_fine", "b_fine"), _close_enough(self.percent), "a long, b long"), "setjoin-pairs")
        count = close.count()
        if not count:
            discard(close)
            return 0
        salts = F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("salts")
        heads = close.groupBy(F.col("b").alias("key")).agg(salts)
        partners = close.select(F.col("a").alias("node"), F.col("b").alias("key")).join(heads, "key")
        partners = partners.select("key", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("member"), "node")
        heads = heads.select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"), F.col("key").alias("node"))
        asks = partners.union(heads).join(self.nodes.select("node", "rep", "digest"), "node")
        rows = self.texts(asks, 2 * count).select("key", "salt", "member", "node", "text")
        rows = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "member")
        links = materialize(arrow_map(rows, _verify(self.words, self.percent), "a long, b long"), "setjoin-links")
        discard(close)
        grown = links.count()
        if grown:
            old, known = self.comp, 2 * self.links
            self.links += grown
            self.comp = connected_components(links if old is None else links.union(old.select("node", "component")), "setjoin-components", known + grown)
            if old is not None:
                discard(old)
        discard(links)
        return grown

    def state(self) -> DataFrame:
        """The members that can still have untested pairs, with their components: a leader has met all, and so has a second one."""
        rest = self.members.where("size > 2 AND node <> lead").drop("lead", "lead_n", "lead_place", "size")
        if self.comp is None:
            return rest.withColumn("comp", F.col("node"))
        return rest.join(self.comp, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")

    def open_buckets(self) -> tuple[DataFrame, int]:
        """(token, main, size) of the buckets whose members but the leader are not all connected, written, and the largest size.

        ``main`` is the component with most members: of two unconnected members one at least is outside it.
        """
        parts = self.state().groupBy("token", "comp").agg(F.count("*").alias("part"))
        found = parts.groupBy("token").agg(F.max_by("comp", "part").alias("main"), F.sum("part").alias("size"), F.count("*").alias("parts"))
        found = materialize(found.where("parts > 1").select("token", "main", "size"), "setjoin-open")
        return found, found.agg(F.max("size")).first()[0] or 0

    def run(self) -> DataFrame | None:
        """(node, component) of the nodes that links connect; None without a link."""
        percent, shape = self.percent, self.nodes.select("node", *_HIST)
        cols = ["token", "node", "n", "place", "comp", *_HIST]
        positional = F.least(F.col("n") - F.col("place"), F.col("lead_n") - F.col("lead_place")) >= _need(F.col("n"), F.col("lead_n"), percent)
        first = self.members.where((F.col("node") != F.col("lead")) & _length(F.col("n"), F.col("lead_n"), percent) & positional)
        self.verified(first.select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct())
        found, most = self.open_buckets()
        for width in PIVOTS:
            if most <= width:
                continue
            # a pivot is a member with a small hash for its bucket's size: no ranking of a hot bucket
            large = self.state().join(found.where(F.col("size") > width), "token").join(shape, "node")
            rank = (F.shiftrightunsigned(F.xxhash64("node"), 1) / F.lit(float(1 << 63))) * F.col("size")
            pivots = large.where(rank < width).select(*cols)
            self.verified(_pairs(large.where(F.col("comp") != F.col("main")).select(*cols), pivots, percent))
            discard(found)
            found, most = self.open_buckets()
        if most:
            small = self.state().join(found.where(F.col("size") <= SMALL), "token").join(shape, "node")
            pairs = _pairs(small.where(F.col("comp") != F.col("main")).select(*cols), small.select(*cols), percent)
            if most > SMALL:
                pairs = pairs.union(self.agreeing(found.where(F.col("size") > SMALL), shape)).distinct()
            self.verified(pairs)
        discard(found)
        return self.comp

    def agreeing(self, large: DataFrame, shape: DataFrame) -> DataFrame:
        """Pairs of nodes of one large open bucket that agree on a part of the hash space."""
        spark, marks = large.sparkSession, MOST_BITS + 1
        hot = spark.sparkContext.broadcast(_bit_table(large, marks))
        held = self.state().join(large, "token").select("token", "node", "n", "place", "comp", (F.col("comp") != F.col("main")).alias("outside"))
        nodes = materialize(held.select("node").distinct(), "setjoin-hot")
        texts = self.texts(nodes.join(self.nodes.select("node", "rep", "digest"), "node"), nodes.count()).select("node", "text")
        keys = materialize(arrow_map(texts, _part_keys(self.words, self.percent, hot, marks), "node long, part long, key long"), "setjoin-parts")
        hot.destroy()
        rows = keys.join(held, "node").join(shape, "node")
        pairs = materialize(_pairs(rows.where("outside").drop("outside"), rows.drop("outside"), self.percent, ("token", "part", "key")), "setjoin-agreeing")
        discard(keys, nodes)
        return pairs


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs``.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets
    of distinct ``words``-word shingles; ``component_id`` is the smallest doc_id
    that links reach. A document of fewer words has one shingle, its whole
    sequence; a null, empty or blank text has none and links with nothing (its
    component is its own doc_id). Rows with equal doc_id count as one document
    with links of all its texts; rows with a null doc_id link with nothing and
    have a null component. An empty table gives an empty table. Only ids and texts
    are read, so clashing names of other columns do not matter.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    known = docs.where("doc_id IS NOT NULL")
    # about six bytes a word
    shingles = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    bits = min(max(int(shingles // 2).bit_length(), LEAST_BITS), MOST_BITS)
    marks = bits + 1
    send = spark.sparkContext.broadcast
    level = send(_rarity(arrow_map(docs.select("text"), _counted(words, bits), "chunk int, counts binary"), bits, shingles / (1 << bits)))
    trim()
    shared = send(_shared_bits(arrow_map(known.select("text"), _prefix_tokens(words, percent, level, bits, _range_bits(marks)), "chunk int, tokens binary"), marks))
    sets = materialize(arrow_map(docs, _sets(words, percent, level, bits, shared, marks), _SET), "setjoin-sets")
    level.destroy()
    shared.destroy()
    del level, shared
    trim()

    solid = sets.where("n > 0 AND doc_id IS NOT NULL")
    least = F.struct("doc_id", "digest")
    reps = solid.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.min_by("digest", least).alias("digest"), F.count("*").alias("copies"))
    nodes = sets.where("tokens IS NOT NULL").drop("doc_id", "digest").dropDuplicates(["k1", "k2"]).join(reps.drop("copies"), ["k1", "k2"])
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "setjoin-nodes")
    per_id = solid.groupBy("doc_id").agg(F.count("*").alias("rows"), *(f(k).alias(f"{k}{e}") for k in ("k1", "k2") for e, f in (("m", F.min), ("x", F.max))))
    differ = F.expr("k1m <> k1x OR k2m <> k2x")
    most, several = per_id.agg(F.max("rows"), F.count_if(differ)).first()

    posted = nodes.select("node", "n", F.explode(F.arrays_zip("tokens", "places")).alias("t")).select(F.col("t.tokens").alias("token"), "node", "n", F.col("t.places").alias("place"))
    leads = posted.groupBy("token").agg(F.min("node").alias("lead"), F.min_by("n", "node").alias("lead_n"), F.min_by("place", "node").alias("lead_place"), F.count("*").alias("size"))
    members = materialize(posted.join(leads.where("size > 1"), "token"), "setjoin-members")
    comp = _Join(known, nodes, members, words, percent, bool(most and most > 1)).run()
    discard(members)

    # components by document: the least one of all that hold a set of the component
    copied = reps.where("copies > 1").select("k1", "k2", F.col("rep").alias("component"))
    if comp is not None:
        held = comp.join(nodes.select("node", "rep", "k1", "k2"), "node")
        first = held.groupBy("component").agg(F.min("rep").alias("first"))
        linked = held.join(first, "component").select("k1", "k2", F.col("first").alias("component"))
        copied = copied.join(linked, ["k1", "k2"], "left_anti").union(linked)
    named = materialize(copied, "setjoin-named")
    discard(nodes, *([comp] if comp is not None else []))
    rows = sets.select("doc_id", "n", "k1", "k2")
    out = rows.join(bounded_broadcast(named, named.count()), ["k1", "k2"], "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    if several:
        # the sets of one document link
        ties = out.where("n_shingles > 0").join(per_id.where(differ).select("doc_id"), "doc_id", "left_semi")
        tied = connected_components(ties.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")), "setjoin-tied")
        tied = tied.select(F.col("node").alias("component_id"), F.col("component").alias("tied"))
        out = out.join(bounded_broadcast(tied, tied.count()), "component_id", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("tied", "component_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: 3-word shingles, a Jaccard similarity of 0.9. Odd rows as in :func:`jaccard_components`."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=90)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: near duplicates by five-word shingles and a similarity of 0.8; the smallest doc_id of each component stays.

    Rows with a null doc_id stay. Of rows with one doc_id, the first by text stays.
    Columns of any name are kept as they are.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    comp = jaccard_components(docs.select("doc_id", "text"))
    fate = materialize(comp.groupBy("doc_id").agg(F.max(F.col("component_id") < F.col("doc_id")).alias("goes"), F.count("*").alias("rows")).where("doc_id IS NOT NULL AND (goes OR rows > 1)"), "setjoin-fate")
    count, twice = fate.agg(F.count("*"), F.count_if(F.expr("rows > 1 AND NOT goes"))).first()
    once = docs.join(bounded_broadcast(fate.select("doc_id"), count), "doc_id", "left_anti").select(*names)
    if not twice:
        return once
    again = docs.join(bounded_broadcast(fate.where("rows > 1 AND NOT goes").select("doc_id"), twice), "doc_id", "left_semi")
    row = F.struct(F.col("text").alias("by"), F.struct(*names).alias("row"))
    first = again.groupBy("doc_id").agg(F.min(row).alias("least")).select("least.row.*")
    return once.union(first.select(*names))


ORACLE_OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh
  FROM d),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  SELECT reach.doc_id, both_ways.y FROM reach JOIN both_ways ON reach.r = both_ways.x),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.sh) AS n_shingles, comp.component_id FROM s JOIN comp USING (doc_id)
"""
