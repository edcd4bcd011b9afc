"""What several operators of this subpackage share."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker takes in hand at once.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only where none is set and all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.tidelog.ownSharedDir", None)
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="tidelog-")
            spark.conf.set("spark.tidelog.ownSharedDir", named)
            spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidelog/{spark.sparkContext.applicationId}"


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{_own_dir(spark)}/{what}-{uuid.uuid4().hex}"


def drop_tables(spark: SparkSession) -> None:
    """Delete all tables that this application's calls have written; results not yet read need them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_dir(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remember(key) -> dict:
    """A dict kept by this Python process over tasks, as long as they ask for the same key: one operator's memory at a time."""
    kept = sys.__dict__.setdefault("_tidelog_kept", {})
    if key not in kept:
        kept.clear()
    return kept.setdefault(key, {})


class Memo:
    """Values computed once for each key, as long as it stays in use: when `most` keys are young, those not asked
    for since the last such time are forgotten. Only speed depends on `most`."""

    def __init__(self, compute, most: int):
        self.compute, self.most, self.young, self.old = compute, most, {}, {}

    def one(self, key):
        v = self.young.get(key)
        return self.holding({key})[key] if v is None else v

    def holding(self, keys: set) -> dict:
        """A dict with all of the keys; compute gets the list of the unknown ones and gives their values."""
        new = keys.difference(self.young)
        if len(self.young) + len(new) > self.most:
            self.old, self.young, new = self.young, {}, keys
        old, young = self.old, self.young
        unknown = []
        for k in new:
            v = old.get(k)
            if v is None:
                unknown.append(k)
            else:
                young[k] = v
        if unknown:
            young.update(zip(unknown, self.compute(unknown), strict=True))
        return young


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python workers in batches of at most so many rows, so that long texts don't fill them."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of `column` each (one longer text stands alone)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def attach_stats(df: DataFrame, keys: list[str], by: Column, salts: int = 64, **stats: tuple[str, str]) -> DataFrame:
    """Give each row its group's statistics; no task holds a whole group.

    stats: name=(kind, column) with kind max, min, sum or count. Groups are summed in two steps and joined
    again by (keys, salt), so that a hot group's rows are dealt over up to `salts` tasks. The list of
    salts that a group carries has at most `salts` entries. Keys must not be null.
    """
    agg = {"max": F.max, "min": F.min, "sum": F.sum, "count": lambda c: F.count(F.lit(1))}
    again = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.sum}
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    parts = salted.groupBy(*keys, "_salt").agg(*[agg[k](F.col(c)).alias(n) for n, (k, c) in stats.items()])
    whole = parts.groupBy(*keys).agg(*[again[k](F.col(n)).alias(n) for n, (k, _) in stats.items()], F.collect_set("_salt").alias("_salts"))
    return salted.join(whole.withColumn("_salt", F.explode("_salts")).drop("_salts"), [*keys, "_salt"]).drop("_salt")


def filter_positions(h: Column, bits: int) -> tuple[Column, Column]:
    """The two bits that a 64-bit hash has in a Bloom filter of 2**bits bits, one in each half."""
    half = (1 << (bits - 1)) - 1
    return h.bitwiseAND(F.lit(half)), F.shiftrightunsigned(h, 64 - bits + 1).bitwiseAND(F.lit(half)) + F.lit(half + 1)


def filter_words(hashes: DataFrame, bits: int, twice: bool = False) -> DataFrame:
    """A Bloom filter of column h as rows (word, mask): 64 bits a row, so at most 2**bits / 64 rows.

    twice: keep only bits that two rows or more have set.
    """
    at = hashes.select(F.explode(F.array(*filter_positions(F.col("h"), bits))).alias("p"))
    at = at.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n > 1") if twice else at
    return at.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("mask"))


def maybe_in(df: DataFrame, h: Column, words: DataFrame, bits: int, name: str) -> DataFrame:
    """Add the boolean `name`: false only if h is surely not in the filter.

    The filter is broadcast: at most 2**bits / 64 rows of two longs, whatever the input's size.
    """
    p, q = filter_positions(h, bits)
    df = df.withColumn("_p", p).withColumn("_q", q)
    for at, word, mask in (("_p", "_w1", "_m1"), ("_q", "_w2", "_m2")):
        df = df.join(F.broadcast(words.select(F.col("word").alias(word), F.col("mask").alias(mask))), F.shiftright(at, 6) == F.col(word), "left")
    hit = lambda mask, at: F.coalesce(F.expr(f"shiftright({mask}, cast({at} & 63 as int)) & 1"), F.lit(0)) == 1
    return df.withColumn(name, hit("_m1", "_p") & hit("_m2", "_q")).drop("_p", "_q", "_w1", "_w2", "_m1", "_m2")


def bitmap_of(words: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter as an array of 2**bits bits, for Python workers."""
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    got = words.toArrow()  # at most 2**bits / 64 rows
    bitmap[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    return bitmap


def in_bitmap(h: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """maybe_in for an array of unsigned hashes."""
    half = np.uint64((1 << (bits - 1)) - 1)
    p, q = h & half, ((h >> np.uint64(64 - bits + 1)) & half) + half + np.uint64(1)
    bit = lambda x: (bitmap[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1)
    return (bit(p) & bit(q)).astype(bool)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the rows (u, v): rows (node, root), root the smallest node reachable.

    Large-star and small-star steps by turns until nothing changes. Nodes without an edge don't appear.
    Each round is written to the shared folder, so a lost executor costs one round at most.
    """
    both = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen = written(both, "edges"), None
    for _ in range(rounds):
        wide = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = attach_stats(wide, ["u"], F.col("v"), m=("min", "v")).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        small = attach_stats(large.distinct(), ["u"], F.col("v"), m=("min", "v"))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = written(small.where("u <> v").distinct(), "edges")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
