"""Structured Streaming form of the change stream: keyed upserts.

A batch writes the objects that it has rows of, in a folder of its own, and nothing else; a batch that
is repeated after a failure overwrites its folder.  The table is the least (or greatest) value of
each object over all folders, so folders may be read in any order and folded at any time.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import complete, forget, scratch

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DIGITS = 12


@contextlib.contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries that start here keep their state in RocksDB, not on the heap."""
    had = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, had) if had else spark.conf.unset(_PROVIDER)


def first_changes(
    spark: SparkSession, path: str, kinds: Sequence[str], kind: str = "activity", key: str = "id", order: str = "seq",
    table: str | None = None, state: str | None = None, files_per_batch: int | None = None,
) -> DataFrame:
    """First of ``kinds`` per object ``key``, over everything available by now.

    Files arrive in any order, so the state holds the smallest ``order`` of each object
    rather than the first row seen.  State grows with the objects, output with the batches'
    objects.  With a ``table`` and a ``state`` folder a later call takes in new files only.
    Rows without key or order are no changes.
    """
    rows = _rows(spark, path, files_per_batch)
    wanted = rows.filter(F.col(kind).isin(*kinds) & F.col(key).isNotNull() & F.col(order).isNotNull())
    return _taken(wanted.groupBy(key).agg(F.min(order).alias(order)), table, state, key, order, F.min)


def last_rows(
    spark: SparkSession, path: str, key: str, order: str, values: Sequence[str],
    table: str | None = None, state: str | None = None, files_per_batch: int | None = None,
) -> DataFrame:
    """``(key, order, values)`` of each key's row with the greatest ``order``, over everything available by now.

    Stamps of bundles as they are seen, say: the catalogue is then refreshed by the keys that have one.
    Of rows of one order the greatest values count; grows and resumes as :func:`first_changes` does.
    """
    rows = _rows(spark, path, files_per_batch).filter(F.col(key).isNotNull() & F.col(order).isNotNull())
    last = rows.groupBy(key).agg(F.max(F.struct(order, *values)).alias("last"))
    return _taken(last, table, state, key, "last", F.max).select(key, "last.*")


def _rows(spark: SparkSession, path: str, files_per_batch: int | None) -> DataFrame:
    """A stream of the rows of a Parquet folder or file."""
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    return source.parquet(path) if folder else source.parquet(path.rpartition("/")[0], pathGlobFilter=path.rpartition("/")[2])


def _taken(grouped: DataFrame, table: str | None, state: str | None, key: str, value: str, keep: Callable) -> DataFrame:
    """Run ``grouped(key, value)`` over what is there, write each batch's keys, and read the table."""
    spark = grouped.sparkSession
    table, state = table or scratch(spark, "changes"), state or scratch(spark, "changes-state")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch-{number:0{_DIGITS}d}")

    with _state_on_disk(spark):
        run = grouped.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(put)
        run.trigger(availableNow=True).start().awaitTermination()
    return current(spark, table, key, value, grouped.schema, keep)


def _folders(spark: SparkSession, table: str) -> tuple[str | None, list[str]]:
    """The newest fold that was written to its end, and the batches behind it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
    whole = [n for n in names if complete(spark, f"{table}/{n}")]
    folds = [n for n in whole if n.startswith("upto-")]
    last = folds[-1].removeprefix("upto-") if folds else ""
    return (folds[-1] if folds else None), [n for n in whole if n.startswith("batch-") and n.removeprefix("batch-") > last]


def current(spark: SparkSession, table: str, key: str, order: str, schema: StructType | str, keep: Callable = F.min) -> DataFrame:
    """The table ``(key, order)`` as the batches so far leave it: of a key's values the one that ``keep`` keeps."""
    fold, batches = _folders(spark, table)
    paths = [f"{table}/{n}" for n in ([fold] if fold else []) + batches]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths).groupBy(key).agg(keep(order).alias(order))


def fold(spark: SparkSession, table: str, key: str, order: str, schema: StructType | str, keep: Callable = F.min) -> int:
    """Put all batches so far into one folder; how many it took in.

    The new folder is whole before the old ones go; a reader that listed those must read again.
    """
    before, batches = _folders(spark, table)
    if not batches:
        return 0
    last = batches[-1].removeprefix("batch-")
    current(spark, table, key, order, schema, keep).write.mode("overwrite").parquet(f"{table}/upto-{last}")
    for n in ([before] if before else []) + batches:
        forget(spark, f"{table}/{n}")
    return len(batches)
