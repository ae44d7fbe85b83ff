"""BPE encoding and decoding with content-defined chunk reuse.

Every text is cut into chunks where a rolling hash over its UTF-8 bytes hits a
mask, so a passage that many documents share yields the same chunks wherever it
stands.  A chunk is encoded once per worker and reused from a bounded memory
(workers live across tasks).  Cuts fall anywhere, also inside a word, so the
encodings of neighbours need not agree at a join.  Each join is repaired by
re-encoding a window: the bytes over the cut up to white space on either side,
and one word beyond.  The window's ids must begin and end with the ids that its
neighbours have for those words; if they don't, the window takes its neighbours
in and is encoded again, until the ids agree or the text ends.

Inside a new chunk the words are looked up in a second bounded memory, so the
library's merge loop runs once per distinct word; windows have a third one.

Scale: one narrow pass without shuffle; memory is bounded by the three caches and
one Arrow batch.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, kept_columns, named

#: Bytes that decide a cut, mean chunk length in bytes (a power of two), and bounds of the three memories (twice that of words).
WINDOW, MEAN_CHUNK, MAX_CHUNKS, MAX_WORDS, MAX_JOINS = 16, 512, 40_000, 300_000, 100_000
#: UTF-8 bytes of texts whose new words are encoded in one call.
GROUP_BYTES = 1 << 20

_GEAR = np.random.default_rng(42).integers(0, 2**32, 256, dtype=np.uint32)


def rolling_cuts(data: np.ndarray, mean: int = MEAN_CHUNK) -> np.ndarray:
    """Positions after which ``data`` (UTF-8 bytes) is cut; never inside a character."""
    if len(data) <= WINDOW:
        return np.empty(0, np.int64)
    h = _GEAR[data]
    span = 1
    while span < WINDOW:  # the hash at i covers bytes i-WINDOW+1 .. i; doubling adds the window before it
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    hit = (h >> np.uint32(8)) & np.uint32(mean - 1) == 0
    hit[:-1] &= data[1:] & 0xC0 != 0x80
    hit[-1] = False
    return np.flatnonzero(hit) + 1


Value = tuple[int, str, str]
#: Last word before a join, the bytes over it, first word behind it.
Window = tuple[bytes, bytes, bytes]
_BLANK = b" \t\n\r\x0b\x0c"


class Chunk:
    """``head`` and ``tail`` are the bytes outside its outermost white space; between them lie whole words.

    A chunk without white space (not ``inner``) is all head.
    """

    __slots__ = ("first", "head", "inner", "last", "middle", "tail", "value", "words")

    def __init__(self, data: bytes):
        self.value: Value | None = None
        self.words: list[bytes] | None = None
        words = data.split()
        self.inner = bool(data) and (len(words) != 1 or len(words[0]) != len(data))
        self.head, self.tail, self.middle, self.first, self.last = data, b"", b"", b"", b""
        if not self.inner:
            return
        self.head = b"" if data[0] in _BLANK else words.pop(0)
        self.tail = b"" if data[-1] in _BLANK else words.pop()
        self.middle = data[len(self.head) : len(data) - len(self.tail)]
        self.words = words
        if words:
            self.first, self.last = words[0], words[-1]


class ChunkCodec:
    """Encodes and decodes texts in groups; ``text -> (n, ids, decoded)``.

    A piece's value is ``(n, ids text, decoded text)``, both joined by spaces: the
    tokenizer's file names no decoder, so the decoded text of a document is the join of
    those of its pieces.  ``asked`` and ``reused`` count bytes of chunks, all and those
    that were known already.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        #: Without a decoder, decoding joins these by one space.
        self.tokens = [self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
        self.words: dict[bytes, Value] = {}
        self.older: dict[bytes, Value] = {}
        self.chunks: dict[bytes, Chunk] = {}
        self.joins: dict[Window, Value] = {}
        self.asked = self.reused = 0

    def _ids(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece on its own, all in few calls."""
        found: list[list[int]] = [[] for _ in pieces]
        for start in range(0, len(pieces), 20_000):
            part = pieces[start : start + 20_000]
            e = self.tok.encode([p.decode() for p in part], is_pretokenized=True, add_special_tokens=False)
            for k, i in zip(e.word_ids, e.ids, strict=True):
                found[start + k].append(i)
        return found

    def _value(self, ids: list[int]) -> Value:
        return len(ids), " ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids])

    def _learn(self, wanted: list[bytes]) -> None:
        """Have the values of ``wanted`` in ``words``.  When that is full it becomes the older memory, from which
        words still in use come back, so frequent ones are never encoded again."""
        known, older = self.words, self.older
        missing = {w for w in wanted if w and w not in known}
        known.update({w: older[w] for w in missing if w in older})
        new = [w for w in missing if w not in known]
        if len(known) + len(new) > MAX_WORDS:
            self.older, self.words = known, {w: known[w] for w in wanted if w in known}
        for w, ids in zip(new, self._ids(new), strict=True):
            self.words[w] = self._value(ids)

    def _agrees(self, ids: list[int], left: bytes, right: bytes) -> list[int] | None:
        """Ids between those of both neighbours; null if the window's ends aren't theirs."""
        a = self.words[left] if left else (0, "")
        b = self.words[right] if right else (0, "")
        end = len(ids) - b[0]
        if a[0] > end or " ".join(map(str, ids[: a[0]])) != a[1] or " ".join(map(str, ids[end:])) != b[1]:
            return None
        return ids[a[0] : end]

    def _repair(self, windows: set[Window]) -> None:
        """Encode windows; those that agree with both neighbours are known from here on."""
        new = list(windows)
        if len(self.joins) + len(new) > MAX_JOINS:
            self.joins = {}
        for w, ids in zip(new, self._ids([b" ".join(filter(None, w)) for w in new]), strict=True):
            between = self._agrees(ids, w[0], w[2])
            if between is not None:
                self.joins[w] = self._value(between)

    def _grown(self, plan: list[Chunk | Window], joins: dict[Window, Value]) -> list[Value]:
        """Values of a text of which some window disagrees: each such window takes in the chunks beside it,
        with the joins behind them, until it agrees; one that covers the text has nothing to disagree with."""
        k = 0
        while k < len(plan):  # joins stand at even places
            if plan[k] not in joins:
                low, high = max(0, k - 2), min(len(plan), k + 3)
                inside = b"".join([x.middle if isinstance(x, Chunk) else x[1] for x in plan[low:high]])
                window = (plan[low - 1].last if low else b"", inside, plan[high].first if high < len(plan) else b"")
                self._learn([window[0], window[2]])
                between = self._agrees(self._ids([b" ".join(filter(None, window))])[0], window[0], window[2])
                plan[low:high] = [window]
                k = low
                if between is None:
                    continue
                joins[window] = self._value(between)
            k += 2
        return [x.value if isinstance(x, Chunk) else joins[x] for x in plan]

    def encode(self, group: list[tuple[bytes, np.ndarray]]) -> list[Value]:
        """Of texts with their cuts."""
        chunks = self.chunks
        fresh: dict[bytes, Chunk] = {}
        plans: list[list] = []
        wanted: list[bytes] = []
        for text, cuts in group:
            edges = [0, *cuts.tolist(), len(text)]
            plan: list = []
            window: list[bytes] = []  # what the joins so far have left open
            for a, b in zip(edges, edges[1:], strict=False):
                key = text[a:b]
                self.asked += b - a
                chunk = chunks.get(key) or fresh.get(key)
                if chunk is None:
                    chunk = fresh[key] = Chunk(key)
                    wanted += chunk.words or ()
                else:
                    self.reused += b - a
                window.append(chunk.head)
                if chunk.inner:
                    plan += [b"".join(window), chunk]
                    window = [chunk.tail]
            plan.append(b"".join(window))
            for k in range(0, len(plan), 2):  # joins stand between chunks, at the start and at the end
                left = plan[k - 1].last if k else b""
                right = plan[k + 1].first if k + 1 < len(plan) else b""
                plan[k] = (left, plan[k], right)
            plans.append(plan)
        # a join between white spaces, or at an end of the text, has no word that a cut went through
        windows = {w for plan in plans for w in plan[::2] if w[1]}
        joins = {w: self.joins[w] for w in windows if w in self.joins}
        missing = windows - joins.keys()
        for left, _, right in missing:
            wanted += (left, right)
        self._learn(wanted)
        self._repair(missing)
        joins |= {w: self.joins[w] for w in missing if w in self.joins}
        known = self.words
        for chunk in fresh.values():
            if chunk.inner:
                chunk.value = _join([known[w] for w in chunk.words])
                chunk.words = None
        if len(chunks) + len(fresh) > MAX_CHUNKS:
            self.chunks = chunks = {}
        chunks.update((k, c) for k, c in fresh.items() if len(k) <= 16 * MEAN_CHUNK)
        out = []
        for plan in plans:
            joins |= {w: (0, "", "") for w in plan[::2] if not w[1]}
            agreed = all(w in joins for w in plan[::2])
            out.append(_join([joins[x] if type(x) is tuple else x.value for x in plan] if agreed else self._grown(plan, joins)))
        return out


def _join(parts: list[Value]) -> Value:
    parts = [p for p in parts if p[0]]
    return sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])


_codecs: dict[str, ChunkCodec] = {}


def _codec(path: str) -> ChunkCodec:
    if path not in _codecs:
        _codecs[path] = ChunkCodec(path)
    return _codecs[path]


#: Between an ASCII letter or digit and a stop or comma that ends a word.
_STOP = re.compile(rb"(?<=[a-z0-9])(?=[.,](?:[ \n]|\Z))")


def plain_bytes(text: str | None) -> bytes:
    """UTF-8 bytes that encode alike but repeat more: ASCII capitals in lower case, and a blank before
    stops and commas, where a token ends anyway.

    The tokenizer composes characters (NFC) before it lowers them, so a capital before a
    byte outside ASCII, which may be a combining mark, stays as it is.  Texts that may
    hold a special token stay whole.
    """
    raw = (text or "").encode()
    if b"<|" in raw:
        return raw
    if raw.isascii():
        return _STOP.sub(b" ", raw.lower())
    data = np.frombuffer(raw, np.uint8).copy()
    capital = (data >= 65) & (data <= 90)
    capital[:-1] &= data[1:] < 128
    data[capital] += 32
    return _STOP.sub(b" ", data.tobytes())


def _groups(column: pa.Array) -> Iterator[list[tuple[bytes, np.ndarray]]]:
    """UTF-8 bytes and cuts of each value, in groups of about GROUP_BYTES; a null is empty."""
    group, size = [], 0
    for value in column:
        text = plain_bytes(value.as_py())
        group.append((text, rolling_cuts(np.frombuffer(text, np.uint8))))
        size += len(text)
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode_decode(docs: DataFrame, tokenizer_path: str, column: str = "text", digests: bool = False) -> DataFrame:
    """Append ``n_tokens``, ``ids`` (decimal, joined by a space) and ``decoded`` to the other columns of ``docs``.

    The values equal ``encode(text, add_special_tokens=False)`` and ``decode(ids,
    skip_special_tokens=False)`` of the tokenizers library.  A null text counts as
    empty; an empty text has no ids and decodes to the empty string.  The input's
    column is dropped; input columns with an output's name are replaced.  With
    ``digests`` the two texts come as SHA-256 (``ids_sha256``, ``decoded_sha256``)
    so they need not leave the task.
    """
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    keep = [c for c in kept_columns(docs, new) if c != column]
    (text_name,) = free(keep, "text")
    source = docs.select(*named(keep), F.col(column).alias(text_name))
    schema = T.StructType(source.schema.fields[:-1])
    for n, t in zip(new, ("long", "string", "string"), strict=True):
        schema = schema.add(n, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokenizer_path)
        for batch in batches:
            text = batch.column(len(keep))
            got = [value for group in _groups(text) for value in codec.encode(group)]
            if digests:
                got = [(n, *(hashlib.sha256(x.encode()).hexdigest() for x in xs)) for n, *xs in got]
            cols = [batch.column(i) for i in range(len(keep))]
            cols += [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *new])

    return source.mapInArrow(run, schema)
