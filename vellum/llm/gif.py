"""GIF media columns: lossless storage of bytes as 8-bit samples, and a GIF decoder.

``write_gif`` stores bytes as colour indices of frames 192 samples wide, as LZW code
streams with growing code widths and a fresh table when the old one is full.
``read_frames`` decodes any stream of the format: code streams, palettes, interlace,
delays, transparency and disposal; it gives one composed frame after another.
``decode_frames`` stores them as rows with times and colour histograms.

Scale: every stage is a narrow pass over Arrow batches.  A task holds one batch, one
file and the canvas of one frame.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, kept_columns, named

WIDTH, FRAME_ROWS, DELAY_CS, BINS = 192, 2048, 4, 4
#: Codes are up to 12 bits wide.
MAX_CODES = 4096


@dataclass
class Frame:
    left: int
    top: int
    indices: np.ndarray  # height x width, as stored
    palette: np.ndarray  # colours x 3
    delay_cs: int
    transparent: int  # -1: none
    disposal: int
    canvas: np.ndarray  # height x width x 4, of the whole image, with this frame shown


def colour_cube() -> np.ndarray:
    """256 colours: three bits of red and green, two of blue, spread over 0 to 255."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85], 1).astype(np.uint8)


def _blocks(data: bytes) -> bytes:
    """Length-prefixed sub-blocks and the end mark."""
    whole = len(data) // 255
    a = np.frombuffer(data, np.uint8)
    body = np.full((whole, 256), 255, np.uint8)
    body[:, 1:] = a[: whole * 255].reshape(whole, 255)
    rest = data[whole * 255 :]
    return body.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


@functools.lru_cache(maxsize=64)
def _run_widths(min_size: int) -> np.ndarray:
    """Widths of the codes behind a clear code, while the table grows."""
    return _widths(MAX_CODES - (1 << min_size), min_size)[1:]


_FULL = np.full(MAX_CODES, 12)


def _widths(n: int, min_size: int) -> np.ndarray:
    """Bits of the first ``n`` codes of a run (its clear code included): the k-th is read with the table
    of k - 2 added codes, and the width grows when the table has filled it."""
    size = (1 << min_size) + 2 + np.maximum(np.arange(n) - 2, 0)
    return np.clip(np.frexp(size)[1], min_size + 1, 12)


def _packed(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes as bits, low ones first."""
    ends = np.cumsum(widths)
    bits = np.zeros(int(ends[-1]) + 7 & ~7, np.uint8)
    starts = ends - widths
    for b in range(12):
        has = widths > b
        bits[starts[has] + b] = codes[has] >> b & 1
    return np.packbits(bits, bitorder="little").tobytes()


def lzw_encode(samples: bytes, min_size: int = 8) -> bytes:
    """The LZW code stream of ``samples``; a clear code stands first and whenever the table is full."""
    clear = 1 << min_size
    # codes are held eight bits higher, where a sample can be added to them
    codes: list[int] = [clear << 8]
    runs = [0]  # where runs begin
    put = codes.append
    first, full = clear + 2 << 8, MAX_CODES << 8
    table: dict[int, int] = {}
    find = table.get
    if samples:
        held, free_code = samples[0] << 8, first
        for s in samples[1:]:
            longer = find(key := held + s)
            if longer is not None:
                held = longer
                continue
            put(held)
            held = s << 8
            if free_code != full:
                table[key] = free_code
                free_code += 256
            else:
                runs.append(len(codes))
                put(clear << 8)
                table.clear()
                free_code = first
        put(held)
    put(clear + 1 << 8)
    edges = [*runs, len(codes)]
    widths = np.concatenate([_widths(b - a, min_size) for a, b in zip(edges, edges[1:], strict=False)])
    # a later clear code still has the width of the run that it ends
    for a in runs[1:]:
        widths[a] = 12
    return _packed(np.array(codes, np.int64) >> 8, widths)


def _unpacked(data: np.ndarray, at: int, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of these widths from bit ``at`` on, as far as the data goes, and the bits at which they end."""
    widths = widths[: (8 * len(data) - at) // 9 + 1] if widths[0] > 8 else widths
    ends = at + np.cumsum(widths)
    n = int(np.searchsorted(ends, 8 * (len(data) - 2), "right"))  # data has two bytes behind its last
    starts, widths = ends[:n] - widths[:n], widths[:n]
    byte = starts >> 3
    three = data[byte].astype(np.uint32) | data[byte + 1].astype(np.uint32) << 8 | data[byte + 2].astype(np.uint32) << 16
    return three >> (starts & 7) & ((1 << widths) - 1), ends[:n]


def lzw_decode(data: bytes, min_size: int, count: int) -> np.ndarray:
    """Up to ``count`` samples of a code stream; samples that it lacks are 0.

    The k-th code after a clear code has a width that follows from k alone, so the codes
    of a run are unpacked at once; a run ends with a clear or end code.
    """
    clear, end = 1 << min_size, (1 << min_size) + 1
    padded = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(2, np.uint8)])
    got = np.zeros(count, np.uint8)
    fresh = True
    at = done = 0
    while done < count:
        codes, ends = _unpacked(padded, at, _run_widths(min_size) if fresh else _FULL)
        if not len(codes):
            break
        stops = np.flatnonzero(codes >> 1 == clear >> 1)
        n = int(stops[0]) if len(stops) else len(codes)
        at = int(ends[n] if len(stops) else ends[-1])
        run = codes[:n].astype(np.int64)
        if fresh:
            starts, sizes, text = _grown(run, clear)
            out = text
        else:  # the table is full
            out = _looked_up(run, clear, starts, sizes, text)
        take = min(len(out), count - done)
        got[done : done + take] = out[:take]
        done += take
        fresh = len(stops) > 0
        if fresh and codes[n] == end:
            break
    return got


def _grown(run: np.ndarray, clear: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the codes of a fresh run stand for: where each one's samples begin, how many they are, and the samples.

    The entry that a code adds is what it stands for and the sample behind that.  So a code that
    isn't a literal copies from where an earlier one's samples begin, one sample more than those are;
    lengths and sources are found by following these references, doubling the stride.
    """
    n = len(run)
    at = np.arange(n)
    literal = run < clear
    earlier = run - (clear + 2)
    if (~literal & (earlier >= at)).any():
        raise ValueError("code outside the table")
    to = np.where(literal, at, earlier)
    sizes, far = np.where(literal, 0, 1), to
    while (beyond := far[far]).tobytes() != far.tobytes():
        sizes = sizes + sizes[far]
        far = beyond
    sizes = sizes + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    total = int(ends[-1]) if n else 0
    source = np.arange(total) + np.repeat(starts[to] - starts, sizes)
    text = np.zeros(total, np.uint8)
    text[starts[literal]] = run[literal]
    while (beyond := source[source]).tobytes() != source.tobytes():
        source = beyond
    return starts, sizes, text[source]


def _looked_up(run: np.ndarray, clear: int, starts: np.ndarray, sizes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """What codes stand for by the full table that a fresh run has left."""
    literal = run < clear
    entry = np.where(literal, 0, run - (clear + 2))
    if (entry >= len(starts) - 1).any():
        raise ValueError("code outside the table")
    long = np.where(literal, 1, sizes[entry] + 1)
    ends = np.cumsum(long)
    total = int(ends[-1]) if len(run) else 0
    source = np.arange(total) + np.repeat(starts[entry] - (ends - long), long)
    out = text[np.minimum(source, len(text) - 1)]
    out[(ends - long)[literal]] = run[literal]
    return out


def write_gif(samples: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """An animation whose frames, in order, hold ``samples`` (a multiple of ``width``); each is cleared before the next."""
    rows = len(samples) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0), colour_cube().tobytes()]
    for top in range(0, rows, frame_rows):
        high = min(frame_rows, rows - top)
        part = samples[top * width : (top + high) * width]
        out += [
            b"\x21\xf9\x04", struct.pack("<BHB", 2 << 2, delay_cs, 0), b"\0",
            b"\x2c", struct.pack("<HHHHB", 0, 0, width, high, 0), b"\x08", _blocks(lzw_encode(part)),
        ]
    return b"".join([*out, b"\x3b"])


class _Reader:
    """A place in the bytes of a file."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        got = self.data[self.at : self.at + n]
        if len(got) < n:
            raise ValueError("the file ends early")
        self.at += n
        return got

    def palette(self, flags: int) -> np.ndarray:
        return np.frombuffer(self.take(3 * (2 << (flags & 7))), np.uint8).reshape(-1, 3)

    def blocks(self) -> bytes:
        parts = []
        while size := self.take(1)[0]:
            parts.append(self.take(size))
        return b"".join(parts)


def _row_order(height: int) -> np.ndarray:
    """Rows of an interlaced frame in stored order: every 8th from 0 and 4, every 4th from 2, every 2nd from 1."""
    return np.concatenate([np.arange(a, height, step) for a, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


#: Pixels at most of a screen, and of a frame: a header of a few bytes must not ask for gigabytes.
MAX_PIXELS = 1 << 24


def read_frames(data: bytes) -> Iterator[Frame]:
    """Frames of a GIF, each with the canvas after palette, transparency and the disposal of those before.

    A screen or frame of more than ``MAX_PIXELS`` is refused, before memory is taken for it.
    """
    r = _Reader(data)
    if r.take(6) not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack("<HHBBB", r.take(7))
    if width * height > MAX_PIXELS:
        raise ValueError("screen too large")
    shared = r.palette(flags) if flags & 0x80 else np.zeros((256, 3), np.uint8)
    canvas = np.zeros((height, width, 4), np.uint8)
    plain = (0, -1, 0)  # delay, transparent index, disposal
    delay, clear_index, disposal = plain
    while r.at < len(data) and (kind := r.take(1)) != b"\x3b":
        if kind == b"\x21":
            label, body = r.take(1), r.blocks()
            if label == b"\xf9":
                f, delay, t = struct.unpack("<BHB", body[:4])
                disposal, clear_index = f >> 2 & 7, t if f & 1 else -1
            continue
        if kind != b"\x2c":
            raise ValueError("unknown block")
        left, top, w, h, f = struct.unpack("<HHHHB", r.take(9))
        if w * h > MAX_PIXELS:
            raise ValueError("frame too large")
        colours = r.palette(f) if f & 0x80 else shared
        min_size = r.take(1)[0]
        if not 2 <= min_size <= 8:
            raise ValueError("no such code size")
        px = lzw_decode(r.blocks(), min_size, w * h).reshape(h, w)
        if f & 0x40:
            px = px[np.argsort(_row_order(h))]
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        inside = px[: area.shape[0], : area.shape[1]]
        opaque = np.hstack([colours, np.full((len(colours), 1), 255, np.uint8)]).view(np.uint32)[:, 0]
        solid = opaque[np.minimum(inside, len(colours) - 1)]
        whole = area.view(np.uint32)[:, :, 0]  # a pixel's four bytes at once
        whole[...] = solid if clear_index < 0 else np.where(inside != clear_index, solid, whole)
        yield Frame(left, top, px, colours, delay, clear_index, disposal, canvas.copy())
        if disposal == 2:
            area[...] = 0
        elif disposal == 3:
            canvas = before
        delay, clear_index, disposal = plain


def histogram(canvas: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Visible pixels of a composed frame by colour: ``bins`` equal ranges of red, by green, by blue."""
    share = np.arange(256) * bins >> 8
    red, green, blue = (part[canvas[:, :, k]] for k, part in enumerate((share * bins**2, share * bins, share)))
    return np.bincount((red + green + blue)[canvas[:, :, 3] > 0], minlength=bins**3)


_UNREADABLE = (ValueError, IndexError, struct.error)
_KINDS = "frame int, start_ms long, delay_ms long, left int, top int, width int, height int, histogram array<bigint>, rgba binary"


def decode_frames(media: DataFrame, column: str = "media") -> DataFrame:
    """One row per frame of each GIF: ``frame, start_ms, delay_ms, left, top, width, height,
    histogram, rgba`` behind the other columns.

    Input columns with those names are replaced.  A null, empty or unreadable value gives
    no rows (an unreadable end, or a frame beyond ``MAX_PIXELS``: none from there on).
    """
    kinds = T.StructType.fromDDL(_KINDS)
    keep = [c for c in kept_columns(media, kinds.names) if c != column]
    (stored,) = free(keep, "media")
    source = media.select(*named(keep), F.col(f"`{column}`").cast("binary").alias(stored))
    schema = T.StructType([*source.schema.fields[:-1], *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary())
        for b in batches:
            for r, value in enumerate(b.column(len(keep))):
                start = 0
                try:
                    for k, f in enumerate(read_frames(value.as_py() or b"")):
                        height, width = f.canvas.shape[:2]
                        one = [k, start, f.delay_cs * 10, f.left, f.top, width, height, histogram(f.canvas).tolist(), f.canvas.tobytes()]
                        start += f.delay_cs * 10
                        arrays = [b.column(i).slice(r, 1) for i in range(len(keep))]
                        arrays += [pa.array([v], t) for v, t in zip(one, types, strict=True)]
                        yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *kinds.names])
                except _UNREADABLE:
                    continue

    return source.mapInArrow(run, schema)


def payload(text: str | None) -> tuple[int, bytes]:
    """Unpadded size, and the UTF-8 bytes with blanks up to a positive multiple of WIDTH."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def store_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: each text's unpadded size, and the text as a GIF.  A null text counts as empty.

    Equal texts give equal files; a text is encoded once per Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str | None, tuple[int, bytes]] = {}
            rows = []
            for value in b.column(1):
                text = value.as_py()
                if text not in seen:
                    n, data = payload(text)
                    seen[text] = n, write_gif(data)
                rows.append(seen[text])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([m for _, m in rows], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_back(data: bytes) -> tuple[int, str, int, int, str, str]:
    """Of a stored file: samples, their SHA-256, the CRC-32 of the last 16, bytes and SHA-256 of the file, and a
    feature: frames, milliseconds, and pixels of all composed frames by colour."""
    digest, total, tail, frames, ms = hashlib.sha256(), 0, b"", 0, 0
    colours = np.zeros(BINS**3, np.int64)
    for f in read_frames(data):
        samples = f.indices.tobytes()
        digest.update(samples)
        total, tail, frames, ms = total + len(samples), (tail + samples)[-16:], frames + 1, ms + f.delay_cs * 10
        colours += histogram(f.canvas)
    feature = f"frames={frames};ms={ms};colours={','.join(map(str, colours.tolist()))}"
    return total, digest.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature


def features(stored: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)`` of
    :func:`store_texts`, all but the first two from the decoded and composed frames of the files."""
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[bytes, tuple] = {}
            rows = []
            for value in b.column(2):
                data = value.as_py()
                if data not in seen:
                    seen[data] = read_back(data)
                rows.append(seen[data])
            made = [pa.array([row[k] for row in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
