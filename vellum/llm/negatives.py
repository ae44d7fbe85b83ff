"""Hard-negative mining with a pivot table.

Every vector x of squared length at most M is augmented by ``sqrt(M - |x|^2)``, an anchor q by 0.
Then ``|x' - q'|^2 = M + |q|^2 - 2 q.x``: the largest inner product is the nearest neighbour.
The distances of each row to a few pivots are stored beside it.  By the triangle inequality
they bracket the row's distance to an anchor, hence its score; only rows whose bracket can
still matter are scored, in integers.  Results are exact whatever the pivots.

Rows lie in groups of bounded size, anchors in blocks; every block visits every group (anchors
are a stated query set) as a stream of one sorted shuffle, so a task holds one group and one block.
Labels are no partition key: a label that a third of all rows share changes nothing.

Rows without id or label, without vector, or with a null or non-finite component take no part; nor
do rows whose width isn't that of the smallest id.  Rows that repeat an id are rows of their own: an
anchor's "other rows" are all but itself.  Equal scores and ids give equal result rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import finite, integers, matrix, of_one_width

PIVOTS, PIVOT_SAMPLE = 8, 1024
#: Components in a group of rows (128 MB as doubles, whatever the width), anchors in a block.
GROUP_VALUES, ANCHORS_PER_BLOCK = 1 << 24, 1 << 10
EXACT_DOUBLE = 1 << 53


def pivots_of(sample: np.ndarray, longest: int) -> np.ndarray:
    """Rows of ``sample`` that lie far from each other in augmented space: each next one is the farthest from those before."""
    x = sample.astype(np.float64)
    x = np.hstack([x, np.sqrt(np.maximum(0, longest - (x * x).sum(1)))[:, None]])
    chosen, gap = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(PIVOTS, len(x)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def to_pivots(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances in augmented space, (pivots, rows)."""
    y = np.hstack([x.astype(np.float64), extra[:, None]])
    squared = (y * y).sum(1)[None, :] + (pivots * pivots).sum(1)[:, None] - 2 * pivots @ y.T
    return np.sqrt(np.maximum(0, squared))


def brackets(anchor: np.ndarray, stored: np.ndarray, pivots: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of every row's inner product with ``anchor``, a little wide for rounding."""
    total = longest + float((anchor.astype(np.float64) ** 2).sum())
    own = to_pivots(anchor[None, :], np.zeros(1), pivots)
    near = np.abs(stored - own).max(axis=0)
    far = (stored + own).min(axis=0)
    slack = 1 + 1e-7 * total
    return (total - far * far) / 2 - slack, (total - near * near) / 2 + slack


def _largest(values: np.ndarray, k: int) -> float:
    """The k-th largest value; without so many, minus infinity."""
    return -np.inf if len(values) < k else -np.partition(-values, k - 1)[k - 1]


class Group:
    """Rows of one group with their stored distances."""

    def __init__(self, blocks: list, width: int, pivots: np.ndarray, longest: int):
        join = lambda i, kind: np.concatenate([np.frombuffer(b[i], kind) for b in blocks])
        self.rows, self.ids, self.labels = (join(i, np.int64) for i in range(3))
        self.kind = np.float64 if longest < EXACT_DOUBLE else np.int64  # no sum of products exceeds the longest square
        self.x = join(3, np.int32).reshape(-1, width).astype(self.kind)
        self.stored = np.hstack([np.frombuffer(b[4], np.float64).reshape(len(pivots), -1) for b in blocks])
        self.pivots, self.longest = pivots, longest

    def best(self, anchor: np.ndarray, allowed: np.ndarray, k: int, low: float, high: float, bounds) -> list[tuple]:
        """The first k allowed rows with scores from low to high: (row, id, score)."""
        lower, upper = bounds
        sure = lower[allowed & (lower >= low) & (upper <= high)]  # these have scores in range, unseen
        check = np.flatnonzero(allowed & (upper >= max(low, _largest(sure, k))) & (lower <= high))
        scores = (self.x[check] @ anchor.astype(self.kind)).astype(np.int64)
        fits = (scores >= low) & (scores <= high)
        check, scores = check[fits], scores[fits]
        top = scores >= _largest(scores, k)
        check, scores = check[top], scores[top]
        order = np.lexsort((self.ids[check], -scores))[:k]
        return [(int(self.rows[i]), int(self.ids[i]), int(s)) for i, s in zip(check[order], scores[order], strict=True)]


def pivot_table(df: DataFrame, groups: int, width: int, pivots: np.ndarray, longest: int) -> DataFrame:
    """``df(row, id, label, v)`` as blocks ``(group, rows, ids, labels, vectors, stored)``; a partition is a group."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"), width)
            extra = np.sqrt(np.maximum(0, longest - (x.astype(np.float64) ** 2).sum(1)))
            cells = [*(b.column(c).to_numpy().astype(np.int64) for c in ("row", "id", "label")), x, to_pivots(x, extra, pivots)]
            yield pa.RecordBatch.from_arrays(
                [b.column("group").slice(0, 1), *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cells)],
                names=["group", "rows", "ids", "labels", "vectors", "stored"],
            )

    # rows are dealt in turn, then numbered by the partition that holds them
    dealt = df.repartition(groups).withColumn("group", F.spark_partition_id())
    return materialize(dealt.mapInArrow(pack, "group int, rows binary, ids binary, labels binary, vectors binary, stored binary"), "pivot-table")


def _visits(table: DataFrame, anchors: RDD, groups: int, width: int, pivots: np.ndarray, longest: int, work) -> RDD:
    """``work(anchor, group)`` for every anchor and every group: rows of both sides meet by group, the group's rows first."""

    def blocks(rows: Iterator) -> Iterator[list]:
        block: list = []
        for r in rows:
            block.append(tuple(r))
            if len(block) == ANCHORS_PER_BLOCK:
                yield block
                block = []
        if block:
            yield block

    def scan(items: Iterator) -> Iterator[tuple]:
        at, waiting, group = None, [], None
        for (g, kind), item in items:
            if g != at:
                at, waiting, group = g, [], None
            if kind == 0:
                waiting.append(item)
                continue
            if group is None and waiting:
                group, waiting = Group(waiting, width, pivots, longest), []
            if group is not None:  # else a group without rows
                for anchor in item:
                    yield from work(anchor, group)

    rows = table.rdd.map(lambda r: ((r.group, 0), tuple(r)[1:]))
    visits = anchors.mapPartitions(blocks).flatMap(lambda b: (((g, 1), b) for g in range(groups)))
    return rows.union(visits).repartitionAndSortWithinPartitions(groups, lambda key: key[0]).mapPartitions(scan)


def mine(
    df: DataFrame, anchors: Column, id: str = "vec_id", label: str = "label", vector: str = "embedding", *,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
) -> DataFrame:
    """For each row that ``anchors`` holds for and each of its first ``positives`` rows of the same label, the first ``negatives``
    rows of another label whose score is ``low`` to ``high`` percent of the positive's."""
    spark = df.sparkSession
    some = df.filter(F.col(id).isNotNull() & F.col(label).isNotNull() & finite(F.col(vector)))
    some, width = of_one_width(some, vector, [F.col(id), F.col(vector)])
    ints = some.select(
        F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"), integers(F.col(vector), scale).alias("v"),
    )
    # the number of a row tells it from its copies; it is written, so a lost executor can't change it
    rows = materialize(ints.withColumn("row", F.monotonically_increasing_id()), "vectors")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    n, longest = rows.agg(F.count("*"), F.coalesce(F.max(square), F.lit(0))).first()
    sample = rows.orderBy(F.xxhash64("v"), "row").limit(PIVOT_SAMPLE).select("v").collect()
    groups = max(1, -(-n * width // GROUP_VALUES), min(2 * spark.sparkContext.defaultParallelism, n // 512))
    pivots = pivots_of(np.array([r.v for r in sample], np.int64), longest) if sample else np.zeros((0, 1))
    table = pivot_table(rows.select("row", "id", "label", "v"), groups, width, pivots, longest)
    asking = rows.filter("anchor").select("row", "id", "label", "v")

    def alike(anchor, group: Group):
        row, _, own, v = anchor
        v = np.array(v, np.int64)
        allowed = (group.labels == own) & (group.rows != row)
        found = group.best(v, allowed, positives, -np.inf, np.inf, brackets(v, group.stored, pivots, longest))
        return [(row, *x) for x in found]

    def first(found: DataFrame, by: list[str], k: int) -> DataFrame:
        """A key has at most k rows of each group."""
        window = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "found")
        return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)

    pairs = spark.createDataFrame(
        _visits(table, asking.rdd, groups, width, pivots, longest, alike), "row long, found long, id long, score long", verifySchema=False
    )
    pairs = materialize(first(pairs, ["row"], positives), "positives")
    wanted = asking.join(pairs.groupBy("row").agg(F.collect_set("score").alias("scores")), "row")

    def different(anchor, group: Group):
        row, _, own, v, scores = anchor
        v = np.array(v, np.int64)
        bounds = brackets(v, group.stored, pivots, longest)
        for s in scores:
            least, most = -(-low * s // 100), high * s // 100
            if least <= most:
                for x in group.best(v, group.labels != own, negatives, least, most, bounds):
                    yield row, s, *x

    hard = spark.createDataFrame(
        _visits(table, wanted.rdd, groups, width, pivots, longest, different),
        "row long, positive_score long, found long, id long, score long", verifySchema=False,
    )
    hard = first(hard, ["row", "positive_score"], negatives)
    pairs = pairs.select("row", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = asking.select("row", F.col("id").alias("anchor_id"))
    return hard.join(pairs, ["row", "positive_score"]).join(named, "row").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
