"""Vector code compression: product codes whose codebooks a reduction tree fits.

Vectors become integers and lie in the shared folder as columnar blocks, a NumPy row for
each component.  Each round is one ``treeAggregate`` over the blocks: a task accumulates
squared distances component by component, adds its parts into int64 tensors of sums and
counts with ``np.add.at``, and the tensors merge through a tree.  What reaches the driver is
one tensor of (parts, entries, part width), whatever the number of rows.  All arithmetic is
on integers, so neither the number of blocks nor their order changes a result.

Rows whose vector is null, empty, or holds a null or non-finite component are dropped; so
are rows whose width isn't that of the smallest id of a width that the parts divide.  Repeated rows
count as often as they occur, null ids come last, fewer rows than entries make fewer
entries, and an empty table gives no rows.  Other columns pass; ``code`` and ``error`` are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, kept_columns, materialize, named
from .vectors import finite, integers, matrix, of_one_width

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK_VALUES = 1 << 20  # 4 MB a block
TREE_FANOUT = 64
#: Labels whose sums are broadcast; with more of them the sums are joined by a shuffle.
MANY_LABELS = 100_000


def _columnar(width: int):
    step = max(1, BLOCK_VALUES // width)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(0), width)
            found = [np.ascontiguousarray(rows[k : k + step].T).tobytes() for k in range(0, len(rows), step)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["columns"])

    return pack


def nearest(columns: np.ndarray, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each part its nearest entries (ties to the lower index) and their squared distances.

    ``columns`` is (width, rows), ``books`` (parts, entries, part width).
    """
    parts, entries, wide = books.shape
    for p in range(parts):
        distance = np.zeros((entries, columns.shape[1]), np.int64)
        for j in range(wide):
            gap = columns[p * wide + j].astype(np.int64)[None, :] - books[p, :, j][:, None]
            distance += gap * gap
        best = distance.argmin(axis=0)
        yield best, distance[best, np.arange(len(best))]


def fit(df: DataFrame, id: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """Codebooks of shape (parts, entries, part width) from all usable rows; no rows: no entries."""
    order = [F.col(id).asc_nulls_last(), F.col(vector)]
    rows, width = of_one_width(df.select(id, vector).filter(finite(F.col(vector))), vector, order, PARTS)
    wide = width // PARTS
    seeds = rows.orderBy(*order).limit(ENTRIES).select(integers(F.col(vector), SCALE).alias("v")).collect()
    books = np.array([r.v for r in seeds], np.int64).reshape(len(seeds), PARTS, wide).transpose(1, 0, 2)
    if not seeds:
        return books
    packed = rows.select(integers(F.col(vector), SCALE).alias("v")).mapInArrow(_columnar(width), "columns binary")
    blocks = materialize(packed, "part-blocks").rdd
    depth = max(2, math.ceil(math.log(max(2, blocks.getNumPartitions()), TREE_FANOUT)))

    for _ in range(ROUNDS):
        now = books

        def add(total, block, now=now):
            columns = np.frombuffer(block.columns, np.int32).reshape(width, -1)
            for p, (best, _) in enumerate(nearest(columns, now)):
                np.add.at(total[0][p], best, columns[p * wide : (p + 1) * wide].T)
                np.add.at(total[1][p], best, 1)
            return total

        zero = np.zeros(now.shape, np.int64), np.zeros(now.shape[:2], np.int64)
        sums, counts = blocks.treeAggregate(zero, add, lambda a, b: (a[0] + b[0], a[1] + b[1]), depth)
        used = counts[..., None] > 0
        books = np.where(used, sums // np.maximum(counts, 1)[..., None], now)  # // goes down
    return books


def encode(df: DataFrame, books: np.ndarray, vector: str = "embedding") -> DataFrame:
    """Usable rows with ``code`` (two hexadecimal digits a part) and ``error`` (the squared distance to what the code stands for)."""
    width = books.shape[0] * books.shape[2]
    keep = kept_columns(df, ["code", "error"])
    (ints,) = free(keep, "__ints")
    rows = df.filter(finite(F.col(vector)) & (F.size(vector) == width))
    rows = rows.select(*named(keep), integers(F.col(vector), SCALE).alias(ints))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{k:02x}" for k in range(256)])
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = matrix(batch.column(batch.num_columns - 1), width).T
            found = list(nearest(columns, books))
            code = digits[found[0][0]]
            for best, _ in found[1:]:
                code = np.char.add(code, digits[best])
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(code.tolist(), pa.string()), pa.array(error)], names=schema.names
            )

    return rows.mapInArrow(mapped, schema)


def decode(codes: DataFrame, books: np.ndarray, code: str = "code") -> DataFrame:
    """Append ``decoded``, the components that ``code`` stands for (null: null)."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in part]) for part in books])
    at = F.transform(
        F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda p: F.conv(F.substring(F.col(code), p * 2 + 1, F.lit(2)), 16, 10).cast("int")
    )
    picked = F.zip_with(entries, at, lambda part, k: F.get(part, k))
    return codes.select(*named(kept_columns(codes, ["decoded"])), F.flatten(picked).alias("decoded"))


def fingerprint(books: np.ndarray) -> str:
    """SHA-256 of all components in order, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def digest(df: DataFrame) -> DataFrame:
    """Fit on and encode ``df(vec_id, embedding, label)``; errors also summed over equal labels."""
    rows = df.select("vec_id", "embedding", "label")
    books = fit(rows)
    coded = materialize(encode(rows, books).drop("embedding"), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    if sums.count() <= MANY_LABELS:
        sums = F.broadcast(sums)
    sums = sums.withColumnRenamed("label", "__label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256")
    )
