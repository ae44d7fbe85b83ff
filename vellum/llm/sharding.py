"""Two-pass external shuffle into shards.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash of
the record; pass two permutes each bucket with a seeded Fisher-Yates shuffle.
Shards are chosen by key (highest random weight): the document id and the number
of shards decide alone, and one more shard takes rows only into itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rank import ranked_by
from .common import free, kept_columns, materialize, named

#: Shuffle partitions at most; beyond, some hold several buckets, one after another.
SHARDS, BUCKET_BYTES, SEED, MAX_PARTITIONS = 8, 8 << 20, 42, 100_000
#: Equal rows (one key, one text) of which more are dealt over several buckets; keys of such rows sent to all tasks.
HOT_ROWS, MAX_BROADCAST = 64, 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the highest hash of (key, shard); a null key is a key like any other."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    weights = F.array(*[F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("w"), F.lit(s).alias("s")) for s in range(shards)])
    return F.array_max(weights)["s"]


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation: position i swaps with a random position up to i, from the end."""
    order = np.arange(n)
    picks = rng.integers(0, np.arange(1, n + 1)) if n else np.empty(0, np.int64)
    out = order.tolist()
    for i in range(n - 1, 0, -1):
        j = int(picks[i])
        out[i], out[j] = out[j], out[i]
    return np.array(out, np.int64)


def shuffle_into_shards(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS,
    bucket_bytes: int = BUCKET_BYTES, seed: int = SEED,
) -> DataFrame:
    """All rows of ``docs`` with ``shard``, ``bucket``, ``place`` (in the bucket, from 0) and ``grown_shard``.

    The bucket count follows the input's bytes, and the shuffle has a partition for each,
    so a bucket fits a task's memory at any size.  A record's bucket depends on its key,
    its text's checksum and the seed: copies of one text with different keys spread
    evenly, so no group of equal texts can overfill a bucket.  Of equal rows (same key and
    text), numbered in the order of their other columns, each HOT_ROWS go to another bucket.
    So neither the files of the table nor how often a row occurs moves any other row.  Within a bucket rows are first ordered by key and checksum, so the
    permutation doesn't depend on arrival order.  Input columns named like an output are
    replaced; a null key is a key like any other, a null text counts as empty.
    """
    columns = kept_columns(docs, ["shard", "grown_shard", "bucket", "place"])
    docs = docs.select(*named(columns))
    total = docs.agg(F.sum(size_of(F.col(text)))).first()[0] or 0
    buckets = max(1, -(-total // (bucket_bytes * shards)))
    crc, k, salt, hot = free([*columns, "shard", "bucket", "place", "grown_shard"], "crc", "k", "salt", "hot")
    keyed = docs.withColumns({
        crc: F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")), k: F.coalesce(F.col(key).cast("string"), F.lit("null")),
    })
    many = materialize(keyed.groupBy(k, crc).agg(F.count("*").alias(hot)).filter(F.col(hot) > HOT_ROWS).select(k, crc), "hot-rows")
    n = many.count()
    keyed = keyed.withColumn(salt, F.lit(0).cast("long")) if not n else _dealt(keyed, F.broadcast(many) if n <= MAX_BROADCAST else many, k, crc, salt)
    scattered = keyed.select(
        *named(columns),
        shard_of(F.col(key), shards, seed).cast("int").alias("shard"), shard_of(F.col(key), shards + 1, seed).cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), k, crc, salt), F.lit(buckets)).cast("long").alias("bucket"), F.col(crc),
    ).repartition(min(shards * buckets, MAX_PARTITIONS), "shard", "bucket")
    schema = scattered.drop(crc).withColumn("place", F.lit(0).cast("long")).schema
    names = [f.name for f in schema]

    def permute(rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows.select([key, crc]), sort_keys=[(key, "ascending"), (crc, "ascending")])
        first = {c: rows.column(c)[0].as_py() for c in ("shard", "bucket")}
        rng = np.random.default_rng([seed, first["shard"], first["bucket"]])
        rows = rows.take(order).take(pa.array(fisher_yates(rows.num_rows, rng)))
        return rows.append_column("place", pa.array(np.arange(rows.num_rows))).select(names)

    return scattered.groupBy("shard", "bucket").applyInArrow(permute, schema)


def _dealt(rows: DataFrame, many: DataFrame, k: str, crc: str, salt: str) -> DataFrame:
    """``rows`` with a number for each HOT_ROWS rows of one key and checksum; 0 for the first of them, and where there are no more."""
    plain = [f"c{i}" for i in range(len(rows.columns))]  # the ranks' own columns can't clash with these
    back = dict(zip(plain, rows.columns, strict=True))
    hot = rows.join(many, [k, crc], "left_semi").select(*named(rows.columns)).toDF(*plain)
    at = {name: c for c, name in back.items()}
    hashed = [c for c, t in hot.dtypes if "map<" not in t and "variant" not in t]
    numbered = ranked_by(hot, [at[k], at[crc]], [F.xxhash64(*hashed)], "number")
    numbered = numbered.select(*[F.col(c).alias(name) for c, name in back.items()], F.floor((F.col("number") - 1) / HOT_ROWS).cast("long").alias(salt))
    return rows.join(many, [k, crc], "left_anti").select(*named(rows.columns), F.lit(0).cast("long").alias(salt)).unionByName(numbered)


def with_slots(shuffled: DataFrame) -> DataFrame:
    """Append ``slot``: the place in the shard, gapless from 0, buckets in order.

    ``shuffled`` is read twice, so pass a written table.  The bucket sizes are one
    row per memory-sized bucket; they are summed by window over each shard.
    """
    columns = kept_columns(shuffled, ["slot"])
    (base,) = free(columns, "base")
    sizes = shuffled.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    w = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias(base))
    return shuffled.select(*named(columns)).join(before, ["shard", "bucket"]).withColumn("slot", F.col(base) + F.col("place")).drop(base)


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """Write the shuffled rows as one folder per shard and bucket, rows in shuffled order.

    A bucket lies whole in one partition, which is sorted by bucket and place: the order
    that the writer asks for by itself is met, so it sorts nothing anew.
    """
    shuffle_into_shards(docs, **how).sortWithinPartitions("shard", "bucket", "place").write.partitionBy("shard", "bucket").parquet(path)


def digest(docs: DataFrame) -> DataFrame:
    """Sizes, checksums and places of all rows, derived after the shuffle from the moved texts."""
    moved = shuffle_into_shards(docs).select(
        "doc_id", size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "bucket", "place", "grown_shard",
    )
    return with_slots(materialize(moved, "shards")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
