"""Tables that cut lineage, in the folder that all machines of a cluster share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir`` (or the context's checkpoint folder).

    A temporary folder of this machine stands in where neither is set and the master is
    local.  On several machines a local folder would be read in part without an error, so
    there it raises instead.  The folder is removed when the process ends.
    """
    app = spark.sparkContext.applicationId
    if app in _roots:
        return _roots[app]
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        _roots[app] = f"{shared.rstrip('/')}/vellum-{app}"
        atexit.register(_quietly_forget, spark, _roots[app])
    elif spark.sparkContext.master.startswith("local"):
        own = tempfile.mkdtemp(prefix="vellum-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _roots[app] = f"file://{own}"
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _roots[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    A lost executor then costs a reread, not a recomputation of everything above.
    """
    path = path or scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task that makes many rows of each.
EACH = 20_000


def spread(df: DataFrame, by: list[str], each: int = 0) -> DataFrame:
    """``df`` dealt by ``by`` into a partition per ``each`` rows, for rows that become many further on.

    A small file is one split, whatever its rows grow to, and AQE joins small partitions: a number that is asked for stays.
    """
    return df.repartition(max(1, -(-df.count() // (each or EACH))), *by)


def bucketed(df: DataFrame, label: str, by: list[str]) -> DataFrame:
    """Write ``df`` in buckets of ``by``, sorted, and read it again: joins on ``by`` need no shuffle of it.

    There are as many buckets as shuffle partitions.  The catalogue knows the table only while it is
    opened here; what is returned reads the files.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(count, *by)  # as buckets are: a file a bucket
    dealt.write.bucketBy(count, *by).sortBy(*by).option("path", scratch(spark, label)).format("parquet").saveAsTable(name)
    table = spark.table(name).select("*")
    table.schema  # noqa: B018  resolves the files before the name goes
    spark.sql(f"DROP TABLE {name}")
    return table


class Known:
    """A growing set of rows by key, in bucketed tables: what a round adds is one more table.

    Asking which rows are new joins each table in its buckets, without moving it.  When there are
    ``LEVELS`` of equal rank they are put into one of the next, so a row is written again only
    logarithmically often and there are few tables.
    """

    LEVELS = 4

    def __init__(self, label: str, by: list[str]):
        self.label, self.by = label, by
        self.tables: list[list[DataFrame]] = [[]]

    def add(self, rows: DataFrame) -> DataFrame:
        """Write ``rows``; they come back as a table."""
        table = bucketed(rows, self.label, self.by)
        self.tables[0].append(table)
        for rank in range(len(self.tables)):
            if len(self.tables[rank]) < self.LEVELS:
                break
            if rank + 1 == len(self.tables):
                self.tables.append([])
            self.tables[rank + 1].append(bucketed(_union(self.tables[rank]), self.label, self.by))
            self.tables[rank] = []
        return table

    def without(self, rows: DataFrame) -> DataFrame:
        """``rows`` whose key isn't there yet."""
        for table in self.tables_in_order():
            rows = rows.join(table.select(*self.by), self.by, "left_anti")
        return rows

    def all(self) -> DataFrame:
        return _union(self.tables_in_order())

    def tables_in_order(self) -> list[DataFrame]:
        """The tables, those of many rows first."""
        return [t for rank in reversed(self.tables) for t in rank]


def _union(tables: list[DataFrame]) -> DataFrame:
    found = tables[0]
    for t in tables[1:]:
        found = found.unionByName(t)
    return found


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def forget(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _quietly_forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        forget(spark, path)
