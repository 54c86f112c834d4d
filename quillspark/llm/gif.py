"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames and colour histograms.

LZW is sequential within a frame, so frames are coded side by side: step k of the
loop handles the k-th code (or sample) of every frame of a slice at once. When
decoding, a table entry is a place and a length in the frame's own output (what a
code stands for always occurs there as one stretch), so nothing is chained and a
step is one gather. When encoding, entries sit in one open-addressing table a frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vector import ragged_index
from .workspace import arrow_map, extended

SIDE = 24
TILE = SIDE * SIDE
DELAY_CS = 10
HIST_BINS = 8
#: Frames that are coded side by side.
_FRAMES = 4096
_GREY = bytes(b for k in range(256) for b in (k, k, k))


# ---------------------------------------------------------------- encoding
def _code_bits(n: int, size: int) -> np.ndarray:
    """Bit offsets of n codes after the first clear code; widths depend on nothing but a code's number."""
    first = (1 << size) + 2
    table = first + np.maximum(np.arange(n) - 1, 0)
    width = np.minimum(np.maximum(np.floor(np.log2(table)).astype(np.int64) + 1, size + 1), 12)
    return size + 1 + np.concatenate([[0], np.cumsum(width)])


def lzw_encode(samples: np.ndarray, size: int = 8) -> list[bytes]:
    """LZW data of every row of ``samples`` (frames x samples, values under 2**size).

    The table of a frame is never cleared after its start and stops growing at 4096 entries.
    """
    out: list[bytes] = []
    for lo in range(0, len(samples), _FRAMES):
        out += _encode_block(np.ascontiguousarray(samples[lo : lo + _FRAMES].T), size)
    return out


def _encode_block(cols: np.ndarray, size: int) -> list[bytes]:
    n, f = cols.shape
    clear, first = 1 << size, (1 << size) + 2
    bits = max(6, int(2 * min(n, 4096)).bit_length())
    keys = np.full(f << bits, -1, np.int32)
    vals = np.zeros(f << bits, np.int16)
    base = np.arange(f, dtype=np.int64) << bits
    mask = (1 << bits) - 1
    codes = np.zeros((n + 2, f), np.int16)
    count = np.zeros(f, np.int64)
    nxt = np.full(f, first, np.int64)
    cur = cols[0].astype(np.int64)
    every = np.arange(f)
    for k in range(1, n):
        b = cols[k].astype(np.int64)
        key = (cur << 8) | b
        spot = (key * 0x9E3779B1 >> 13) & mask
        at = base + spot
        got = keys[at]
        wait = np.flatnonzero((got != key) & (got >= 0))
        while len(wait):
            spot[wait] = (spot[wait] + 1) & mask
            at[wait] = base[wait] + spot[wait]
            g = keys[at[wait]]
            got[wait] = g
            wait = wait[(g != key[wait]) & (g >= 0)]
        new = got < 0
        cur_new = np.where(new, b, vals[at])
        w = np.flatnonzero(new)
        codes[count[w], w] = cur[w]
        count[w] += 1
        room = w[nxt[w] < 4096]
        keys[at[room]] = key[room]
        vals[at[room]] = nxt[room]
        nxt[room] += 1
        cur = cur_new
    codes[count, every] = cur
    count += 1
    codes[count, every] = clear + 1
    count += 1
    most = int(count.max())
    offs = _code_bits(most, size)
    data = np.zeros((int(offs[-1] + 7) // 8 + 3, f), np.uint8)
    data[0], data[1] = clear & 255, clear >> 8
    for j in range(most):
        at, shift = int(offs[j]) >> 3, int(offs[j]) & 7
        v = np.where(count > j, codes[j].astype(np.int64) << shift, 0)
        data[at] |= (v & 255).astype(np.uint8)
        data[at + 1] |= (v >> 8 & 255).astype(np.uint8)
        if shift > 4:
            data[at + 2] |= (v >> 16).astype(np.uint8)
    rows = np.ascontiguousarray(data.T)
    ends = ((offs[count] + 7) >> 3).tolist()
    return [rows[k, :e].tobytes() for k, e in enumerate(ends)]


def _sub_blocks(data: bytes) -> bytes:
    out = b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255))
    return out + b"\0"


def build_gif(width: int, height: int, palette: bytes, frames: list[dict], loops: int = 0) -> bytes:
    """A GIF89a of frames (data: LZW bytes; optional left, top, width, height, delay, disposal, transparent, palette, interlace, size)."""
    bits = max(1, (len(palette) // 3 - 1).bit_length()) if palette else 1
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, (0x80 if palette else 0) | 0x70 | (bits - 1), 0, 0)]
    if palette:
        out.append(palette.ljust(3 << bits, b"\0"))
    if len(frames) > 1:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loops) + b"\0")
    for f in frames:
        t = f.get("transparent")
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", f.get("disposal", 1) << 2 | (t is not None), f.get("delay", DELAY_CS), t or 0) + b"\0")
        own = f.get("palette")
        flags = 0x40 if f.get("interlace") else 0
        if own:
            flags |= 0x80 | (max(1, (len(own) // 3 - 1).bit_length()) - 1)
        out.append(b"," + struct.pack("<HHHHB", f.get("left", 0), f.get("top", 0), f.get("width", width), f.get("height", height), flags))
        if own:
            out.append(own.ljust(6 << (flags & 7), b"\0"))
        out += [bytes([f.get("size", 8)]), _sub_blocks(f["data"])]
    return b"".join([*out, b";"])


# ---------------------------------------------------------------- decoding
@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    interlace: bool
    palette: np.ndarray
    delay: int
    disposal: int
    transparent: int
    size: int
    data: bytes


@dataclass
class Movie:
    width: int
    height: int
    frames: list[Frame] = field(default_factory=list)


def parse_gif(raw: bytes) -> Movie | None:
    """The screen and the frames of a GIF; None if it is none. What a cut file still has is kept."""
    if len(raw) < 13 or raw[:6] not in (b"GIF87a", b"GIF89a"):
        return None
    width, height, flags = struct.unpack_from("<HHB", raw, 6)
    at = 13
    shared = np.zeros((256, 3), np.uint8)

    def table(at: int, flags: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        got = np.frombuffer(raw[at : at + 3 * n], np.uint8)
        pal = np.zeros((256, 3), np.uint8)
        pal[: len(got) // 3] = got[: len(got) // 3 * 3].reshape(-1, 3)
        return pal, at + 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(raw) and raw[at]:
            parts.append(raw[at + 1 : at + 1 + raw[at]])
            at += 1 + raw[at]
        return b"".join(parts), at + 1

    if flags & 0x80:
        shared, at = table(at, flags)
    movie, delay, disposal, transparent = Movie(width, height), 0, 0, -1
    while at < len(raw):
        kind = raw[at]
        if kind == 0x21 and at + 1 < len(raw):
            body, end = blocks(at + 2)
            if raw[at + 1] == 0xF9 and len(body) >= 4:
                packed, delay, t = struct.unpack_from("<BHB", body)
                disposal, transparent = packed >> 2 & 7, t if packed & 1 else -1
            at = end
        elif kind == 0x2C and at + 10 < len(raw):
            left, top, w, h, fl = struct.unpack_from("<HHHHB", raw, at + 1)
            at += 10
            pal = shared
            if fl & 0x80:
                pal, at = table(at, fl)
            size = raw[at] if at < len(raw) else 8
            data, at = blocks(at + 1)
            movie.frames.append(Frame(left, top, w, h, bool(fl & 0x40), pal, delay, disposal, transparent, min(max(size, 1), 11), data))
            delay, disposal, transparent = 0, 0, -1
        else:
            break
    return movie


def lzw_decode(streams: list[tuple[int, bytes, int]]) -> list[np.ndarray]:
    """Samples of each stream (code size, data, number of samples); what a cut or broken stream lacks is 0."""
    out: list[np.ndarray] = [None] * len(streams)
    # streams of like lengths go side by side
    order = sorted(range(len(streams)), key=lambda k: (streams[k][0], streams[k][2], len(streams[k][1])))
    lo = 0
    while lo < len(order):
        size, _, samples = streams[order[lo]]
        hi, budget = lo, 0
        while hi < len(order) and hi - lo < _FRAMES and streams[order[hi]][0] == size and streams[order[hi]][2] <= 2 * samples + 64 and (budget == 0 or budget < 1 << 23):
            budget += streams[order[hi]][2] + 64
            hi += 1
        part = [streams[k] for k in order[lo:hi]]
        for k, s in zip(order[lo:hi], _decode_block(size, [p[1] for p in part], np.array([p[2] for p in part], np.int64))):
            out[k] = s
        lo = hi
    return out


def _decode_block(size: int, datas: list[bytes], samples: np.ndarray) -> list[np.ndarray]:
    f = len(datas)
    clear, first = 1 << size, (1 << size) + 2
    lens = np.array([len(d) for d in datas], np.int64)
    raw = np.frombuffer(b"".join(d + b"\0\0\0\0" for d in datas), np.uint8)
    bit = (np.cumsum(lens + 4) - lens - 4) * 8
    last_bit = bit + lens * 8
    out_at = np.cumsum(samples) - samples
    out_end = out_at + samples
    out = np.zeros(int(samples.sum()), np.uint8 if size <= 8 else np.uint16)
    entries = int(min(4096, first + (lens.max() * 8 // (size + 1) if f else 0) + 2))
    e_start, e_len = np.zeros(f * entries, np.int64), np.zeros(f * entries, np.int32)
    width, nxt = np.full(f, size + 1, np.int64), np.full(f, first, np.int64)
    prev_at, prev_len = np.zeros(f, np.int64), np.zeros(f, np.int64)
    pos = out_at.copy()
    live = np.flatnonzero((samples > 0) & (lens > 0))
    while len(live):
        bt, wd = bit[live], width[live]
        at = bt >> 3
        code = ((raw[at].astype(np.int64) | raw[at + 1].astype(np.int64) << 8 | raw[at + 2].astype(np.int64) << 16) >> (bt & 7)) & ((1 << wd) - 1)
        bit[live] = bt + wd
        ok = (bt + wd <= last_bit[live]) & (code != clear + 1)
        reset = ok & (code == clear)
        if reset.any():
            r = live[reset]
            width[r], nxt[r], prev_len[r] = size + 1, first, 0
        go = ok & ~reset
        s, c = live[go], code[go]
        pl, nx = prev_len[s], nxt[s]
        literal = c < clear
        # an entry must exist, or be the one that this step adds
        fine = literal | ((c < nx) & (c >= first)) | ((c == nx) & (pl > 0) & (nx < 4096))
        if not fine.all():
            s, c, pl, nx, literal = s[fine], c[fine], pl[fine], nx[fine], literal[fine]
        add = (pl > 0) & (nx < entries)
        a = s[add]
        e_start[a * entries + nx[add]] = prev_at[a]
        e_len[a * entries + nx[add]] = pl[add] + 1
        nx = nx + add
        nxt[s] = nx
        width[s] = np.where((nx >= (1 << width[s])) & (width[s] < 12), width[s] + 1, width[s])
        dst = pos[s]
        e = s * entries + np.minimum(c, entries - 1)
        src = np.where(literal, 0, e_start[e])
        n = np.where(literal, 1, e_len[e]).astype(np.int64)
        m = np.minimum(n, out_end[s] - dst)
        lit = literal & (m > 0)
        out[dst[lit]] = c[lit]
        cp = ~literal & (m > 0)
        if cp.any():
            i = ragged_index(src[cp], m[cp])
            o = ragged_index(dst[cp], m[cp])
            out[o] = out[i]
            # an entry added in this very step ends with its own first sample
            own = cp & (src + n - 1 == dst) & (m == n)
            out[dst[own] + n[own] - 1] = out[dst[own]]
        prev_at[s], prev_len[s] = dst, n
        pos[s] = dst + m
        alive = np.zeros(f, bool)
        alive[live[reset]] = True
        alive[s[pos[s] < out_end[s]]] = True
        live = live[alive[live]]
    return [out[x:y] for x, y in zip(out_at.tolist(), out_end.tolist())]


def _rows_of(height: int) -> np.ndarray:
    """Rows of an interlaced frame in the order in which they are stored."""
    return np.concatenate([np.arange(s, height, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))]).astype(np.int64)


def compose(movie: Movie, samples: list[np.ndarray]) -> np.ndarray:
    """The screen after each frame: frames x height x width x 3; outside of frames it is black."""
    h, w, frames = movie.height, movie.width, movie.frames
    if frames and all(f.width == w and f.height == h and not (f.left or f.top or f.interlace) and f.transparent < 0 and f.palette is frames[0].palette for f in frames):
        return frames[0].palette[np.stack(samples)].reshape(-1, h, w, 3)
    screen = np.zeros((h, w, 3), np.uint8)
    out = np.zeros((len(frames), h, w, 3), np.uint8)
    for k, (f, s) in enumerate(zip(frames, samples)):
        before = screen.copy() if f.disposal == 3 else None
        img = s.reshape(f.height, f.width)
        if f.interlace:
            straight = np.empty_like(img)
            straight[_rows_of(f.height)] = img
            img = straight
        y, x = max(0, min(f.height, h - f.top)), max(0, min(f.width, w - f.left))
        img = img[:y, :x]
        area = screen[f.top : f.top + y, f.left : f.left + x]
        shown = img != f.transparent if f.transparent >= 0 else np.ones(img.shape, bool)
        area[shown] = f.palette[np.minimum(img, 255)][shown]
        out[k] = screen
        if f.disposal == 2:
            area[:] = 0
        elif f.disposal == 3:
            screen = before
    return out


def decode_gifs(raws: list[bytes | None]) -> list[tuple[Movie | None, np.ndarray]]:
    """Movies and their composed screens; (None, no frames) for what is no GIF."""
    movies = [parse_gif(r) if r is not None else None for r in raws]
    streams = [(f.size, f.data, f.width * f.height) for m in movies if m for f in m.frames]
    samples = lzw_decode(streams)
    out, at = [], 0
    for m in movies:
        if m is None:
            out.append((None, np.zeros((0, 0, 0, 3), np.uint8)))
            continue
        own = samples[at : at + len(m.frames)]
        at += len(m.frames)
        out.append((m, compose(m, own) if own else np.zeros((0, m.height, m.width, 3), np.uint8)))
    return out


def histograms(pixels: np.ndarray) -> np.ndarray:
    """Counts of 3 channels x HIST_BINS of pixels (any shape x 3)."""
    flat = (pixels.reshape(-1, 3) >> 5).astype(np.int64) + np.arange(3) * HIST_BINS
    return np.bincount(flat.ravel(), minlength=3 * HIST_BINS).reshape(3, HIST_BINS)


def _batches_of(column: pa.Array, limit: int = 2 << 20):
    """(first, values) of stretches of a binary column, about ``limit`` bytes each."""
    first, held, part = 0, 0, []
    for k, v in enumerate(column):
        b = v.as_py()
        part.append(b)
        held += len(b or b"")
        if held >= limit:
            yield first, part
            first, held, part = k + 1, 0, []
    if part:
        yield first, part


_FRAME = "frame_index int, start_ms long, delay_ms long, width int, height int, pixels binary, hist_r array<int>, hist_g array<int>, hist_b array<int>"


def _frame_rows(batches):
    names = [x.split()[0] for x in _FRAME.split(", ")]
    ints = pa.list_(pa.int32())
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), ints, ints, ints]
    for batch in batches:
        for first, part in _batches_of(batch.column(0)):
            cols, owner = [[] for _ in names], []
            for k, (movie, screens) in enumerate(decode_gifs(part)):
                at = 0
                for j in range(len(screens)):
                    delay, hist = movie.frames[j].delay * 10, histograms(screens[j])
                    for c, v in zip(cols, (j, at, delay, movie.width, movie.height, screens[j].tobytes(), *hist.tolist())):
                        c.append(v)
                    owner.append(first + k)
                    at += delay
            keep = [batch.column(i).take(pa.array(owner, pa.int64())) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[*batch.schema.names[1:], *names])


def gif_frames(media: DataFrame, media_col: str = "media") -> DataFrame:
    """A row for each frame of each GIF: the other columns, then the frame's time, screen (RGB) and histograms.

    Null, empty or foreign bytes give no rows; of a cut GIF the frames it has, missing
    samples 0. Columns with a frame column's name are dropped.
    """
    new = [x.split()[0] for x in _FRAME.split(", ")]
    keep = [c for c in media.columns if c != media_col and c not in new]
    return arrow_map(media.select(F.col(media_col).alias("__media"), *keep), _frame_rows, extended(media.select(*keep).schema, _FRAME))


def _store(batches):
    """Each text's bytes, padded, as one grey GIF of TILE-sized frames."""
    for batch in batches:
        column = batch.column(0)
        n_bytes, media = [], []
        for _, part in _batches_of(column):
            padded, frames = [], []
            for b in part:
                b = b or b""
                n_bytes.append(len(b))
                frames.append(max(1, -(-len(b) // TILE)))
                padded.append(b.ljust(frames[-1] * TILE, b"\xff"))
            data = lzw_encode(np.frombuffer(b"".join(padded), np.uint8).reshape(-1, TILE))
            at = 0
            for n in frames:
                media.append(build_gif(SIDE, SIDE, _GREY, [{"data": d} for d in data[at : at + n]]))
                at += n
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n_bytes, pa.int64()), pa.array(media, pa.binary())], names=[*batch.schema.names[1:], "n_bytes", "media"])


def texts_as_gifs(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, n_bytes and media: the text's UTF-8 bytes, padded with 255 to frames of 24 x 24 samples.

    A null text is empty; an empty text is one frame of padding. Kept columns named as the new ones give way.
    """
    keep = tuple(c for c in keep if c not in ("n_bytes", "media"))
    schema = docs.select(*keep).schema.add("n_bytes", "long").add("media", "binary")
    return arrow_map(docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__b"), *keep), _store, schema)


_DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digests(batches):
    names = [x.split()[0] for x in _DIGEST.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        cols = [[] for _ in names]
        for _, part in _batches_of(batch.column(0)):
            for raw, (movie, screens) in zip(part, decode_gifs(part)):
                if movie is None:
                    for c in cols:
                        c.append(None)
                    continue
                # a grey sample is any one of its channels
                payload = screens[..., 0].tobytes()
                hist = histograms(screens)
                time = sum(f.delay for f in movie.frames) * 10
                feature = f"frames={len(screens)};ms={time};" + ";".join(f"{c}={','.join(map(str, h))}" for c, h in zip("rgb", hist.tolist()))
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature)
                for c, v in zip(cols, row):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[*batch.schema.names[1:], *names])


def gif_digests(media: DataFrame) -> DataFrame:
    """Reads GIFs of texts back: digests of payload and stored bytes, and a histogram feature.

    Null, empty or foreign bytes have nulls. Columns with a new column's name are dropped,
    all others kept.
    """
    keep = [c for c in media.columns if c != "media" and c not in [x.split()[0] for x in _DIGEST.split(", ")]]
    schema = media.select(*keep).schema
    for x in _DIGEST.split(", "):
        schema = schema.add(*x.split())
    return arrow_map(media.select("media", *keep), _digests, schema)


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, stored as GIFs and read back; a row each, null and empty texts are one frame of padding."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return gif_digests(texts_as_gifs(docs))
