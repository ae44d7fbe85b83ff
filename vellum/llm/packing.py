"""Best-fit packing of token sequences by patterns fitted with non-negative least squares.

1. Tokenize every document in place (no shuffle); only lengths and checksums leave the task.
2. Cut documents over the limit; the remainder comes first, the rest fills whole sequences.
3. Histogram of piece lengths: at most ``limit`` rows, whatever the input's size.
4. On that histogram: enumerate patterns of one to three lengths, fit repeat counts
   by non-negative least squares, round down, and pack the residual counts best-fit.
   The work depends on the limit alone, not on the number of documents.
5. Give the k-th piece of a length the k-th slot of that length.  Ranks are taken
   within (length, salt); a length has SALTS salts, and more if it has over RANK_ROWS
   pieces for each, so a length that a third of all pieces share is split at any size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free, kept_columns, materialize, named

LIMIT, END_ID, SALTS, RANK_ROWS, MAX_WORDS = 1024, 2, 64, 500_000, 400_000
#: Runs of white space that the pattern's look-ahead would need too deep a stack for; sought at a run's start only.
_LONG_BLANK = re.compile(r"(?<!\s)\s{100000}")

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Byte-level BPE through ranks; the bytes of the ids as little-endian unsigned 32-bit numbers.

    A token never spans the place before a single space that stands between two
    characters other than white space.  Texts are cut there and each word with its
    leading space is encoded once per worker (bounded memory).  A text with 100,000
    white spaces in a row goes to the tokenizers library as a whole.
    """

    def __init__(self, tokenizer_path: str):
        import json

        import tiktoken

        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = _byte_letters()
        ranks = {bytes(raw[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        from public_tokenizers import PATTERN

        self.enc = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.memo: dict[str, bytes] = {}
        self.path, self.library = tokenizer_path, None

    def _by_library(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, text: str) -> bytes:
        return np.array(self.enc.encode(text, allowed_special="all"), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if len(text) >= 100_000 and _LONG_BLANK.search(text):
            return self._by_library(text)
        first, *rest = text.split(" ")
        if not rest:
            return self._ids(text)
        memo = self.memo
        got = [memo.get(p) for p in rest]
        if None in got or not first or first[-1].isspace():
            if not first or first[-1].isspace() or any(
                not p or p[0].isspace() or p[-1].isspace() for p, g in zip(rest, got, strict=True) if g is None
            ):
                return self._glued([first, *rest])
            if len(memo) > MAX_WORDS:
                memo.clear()
            for k, p in enumerate(rest):
                if got[k] is None:
                    if (g := memo.get(p)) is None:
                        g = memo[p] = self._ids(" " + p)
                    got[k] = g
        return self._ids(first) + b"".join(got)

    def _glued(self, parts: list[str]) -> bytes:
        """Pieces whose border isn't between two visible characters are encoded together."""
        out, run = [], parts[0]
        for p in parts[1:]:
            if run and not run[-1].isspace() and p and not p[0].isspace():
                out.append(self._word(run))
                run = " " + p
            else:
                run += " " + p
        return b"".join([*out, self._word(run)])

    def _word(self, run: str) -> bytes:
        if run[:1] == " " and (g := self.memo.get(run[1:])) is not None:
            return g
        return self._ids(run)


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def token_pieces(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of each document's ids and the end id.

    A null text counts as empty (one piece with the end id).  Documents with more
    than ``limit`` ids are cut; the first piece takes the remainder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoders.get(tokenizer_path)
        if enc is None:
            enc = _encoders[tokenizer_path] = WordEncoder(tokenizer_path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py() or "") + end
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    size = (n % limit or limit) if not piece else limit
                    rows.append((doc, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, piece = at + size, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def patterns(counts: np.ndarray, limit: int) -> np.ndarray:
    """Rows of up to three lengths (0: none) that fill a sequence, or nearly.

    For every length with pieces: its best partner for a pair, and for triples that
    length with each of a grid of second lengths and the largest third that fits.
    """
    have = np.flatnonzero(counts)
    have = have[have > 0]
    if not len(have):
        return np.empty((0, 3), np.int64)
    below = np.zeros(limit + 1, np.int64)  # largest length with pieces up to here
    below[have] = have
    below = np.maximum.accumulate(below)
    grid = have[np.unique(np.linspace(0, len(have) - 1, 24).astype(int))]
    rows = {(limit, 0, 0)} if counts[limit] else set()
    for a in have.tolist():
        if b := int(below[limit - a]):
            rows.add((*sorted((a, b), reverse=True), 0))
        for g in grid.tolist():
            if a + g < limit and (c := int(below[limit - a - g])):
                rows.add(tuple(sorted((a, g, c), reverse=True)))
    fit = [r for r in rows if limit - sum(r) <= limit // 64]
    return np.array(sorted(fit), np.int64).reshape(-1, 3)


def fit_repeats(counts: np.ndarray, rows: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative repeats ``x`` near the least of ``|A x - counts|^2``, by multiplicative updates.

    ``A`` has for each pattern how often it uses each length.  The updates keep
    ``x`` non-negative and never raise the error; three indexed sums stand for ``A``.
    """
    if not len(rows):
        return np.empty(0)
    used = rows > 0

    def times(x):  # A x
        out = np.zeros(len(counts))
        for k in range(3):
            np.add.at(out, rows[used[:, k], k], x[used[:, k]])
        return out

    def back(y):  # A^T y
        return sum(np.where(used[:, k], y[rows[:, k]], 0.0) for k in range(3))

    want = back(counts.astype(float))
    x = np.full(len(rows), counts.sum() / (2 * len(rows)))
    for _ in range(rounds):
        x *= want / np.maximum(back(times(x)), 1e-12)
    return x


def plan_sequences(counts: np.ndarray, limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """``[(lengths, repeats)]`` that use up ``counts`` (pieces by length, 0..limit) exactly."""
    left = counts.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[limit]:
        plan.append(((limit,), int(left[limit])))
        left[limit] = 0
    rows = patterns(left, limit)
    x = fit_repeats(left, rows)
    tight = np.lexsort((-x, limit - rows.sum(1))) if len(rows) else []
    for k in tight:  # rounded down, tightest first; never more than the pieces left
        need = np.bincount(rows[k][rows[k] > 0], minlength=limit + 1)
        n = int(min([np.floor(x[k]), *(left[l] // need[l] for l in np.flatnonzero(need))]))
        if n > 0:
            plan.append((tuple(int(v) for v in rows[k] if v), n))
            left -= n * need
    # residual: best fit, longest first, whole runs of equal pieces and equal gaps at a time
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for size in range(limit, 0, -1):
        n = int(left[size])
        for gap in sorted(g for g in gaps if g >= size):
            while n and gaps.get(gap):
                held, many = gaps[gap].pop()
                put = min(gap // size, n)  # as many as fit: then no smaller gap has to be looked at again
                take = min(n // put, many)
                if many > take:
                    gaps[gap].append((held, many - take))
                gaps.setdefault(gap - put * size, []).append((held + (size,) * put, take))
                n -= put * take
            if not n:
                break
        per = limit // size
        if n >= per:
            gaps.setdefault(limit - per * size, []).append(((size,) * per, n // per))
        if n % per:
            gaps.setdefault(limit - (n % per) * size, []).append(((size,) * (n % per), 1))
    plan += [x for held in gaps.values() for x in held]
    return plan


def _slots(counts: np.ndarray, limit: int) -> tuple[np.ndarray, ...]:
    """The plan as runs of slots in order of (length, first rank): length, first rank, sequence of that rank, offset.

    Slot ``rank`` of a run from rank ``low`` in sequence ``first`` is in sequence ``first + rank - low``.
    """
    runs, at, ranks = [], 0, np.zeros(limit + 1, np.int64)
    for lengths, n in plan_sequences(counts, limit):
        offset = 0
        for size in lengths:
            runs.append((size, int(ranks[size]), at, offset))
            ranks[size] += n
            offset += size
        at += n
    return tuple(np.array(sorted(runs), np.int64).reshape(-1, 4).T.copy())


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Append ``sequence_id`` and ``offset`` to ``pieces``, placing every row exactly once.

    ``pieces`` is read twice, so pass a written table; columns of an output's name are
    replaced.  Only the histogram (at most ``limit`` rows) is gathered.  The plan, some
    runs of slots per pattern, depends on ``limit`` alone and goes to the tasks.
    """
    columns = kept_columns(pieces, ["sequence_id", "offset"])
    salts, salt, k, base = free(columns, "salts", "salt", "k", "base")
    pieces = pieces.select(*named(columns))
    sizes = pieces.groupBy("length").agg(F.count("*").alias("n"))
    counts = np.zeros(limit + 1, np.int64)
    for r in sizes.collect():
        counts[r["length"]] = r["n"]
    low, first_rank, first_sequence, offset = _slots(counts, limit)
    # one row a length; salts come in equal order on every run: they depend on the row alone
    dealt = sizes.select("length", F.greatest(F.lit(SALTS), F.ceil(F.col("n") / RANK_ROWS)).alias(salts))
    salted = pieces.join(F.broadcast(dealt), "length").withColumn(
        salt, F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col(salts))).drop(salts)
    # at most SALTS rows a length, and one for RANK_ROWS pieces
    tallies = salted.groupBy("length", salt).agg(F.count("*").alias(base))
    before = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    tallies = tallies.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("length", salt).orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = salted.withColumn(k, nth).join(tallies, ["length", salt]).select(*named(columns), F.col("length").cast("long").alias(salt), (F.col(k) + F.col(base)).alias(k))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.searchsorted(low, np.arange(limit + 2))  # first run of each length
        for b in batches:
            length, rank = (np.asarray(b.column(i)) for i in (len(columns), len(columns) + 1))
            run = np.empty(len(length), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                run[at] = starts[size] + np.searchsorted(first_rank[starts[size] : starts[size + 1]], rank[at], "right") - 1
            made = [pa.array(first_sequence[run] + rank - first_rank[run]), pa.array(offset[run])]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], *made], names=[*columns, "sequence_id", "offset"])

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """Tokenize, cut and pack whole documents; see :func:`token_pieces` and :func:`pack`.

    Repeated rows are packed once each.  An empty table gives an empty table.  Columns
    other than doc_id and text are ignored; a null doc_id is a document like any other.
    """
    return pack(materialize(token_pieces(docs, tokenizer_path, limit), "pieces"), limit)
