"""The canonical event relation, and the log's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import millis

#: Columns that every operator can count on; the others of a log record are null when absent.
LOG_SCHEMA = (
    "topic string, partition int, seq long, at_ms long, event_time_ms long, key string, payload string, "
    "headers map<string,string>, message_id string, _corrupt_record string"
)

#: Arrivals that are numbered together.
BLOCK = 1 << 20


def number(df: DataFrame, by: list[str], order: list, name: str = "seq") -> DataFrame:
    """Sequence numbers from 1 in each group, in the given order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def to_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.parquet as topics: topic, partition, arrival, at_ms, event_time_ms, key, value, props, message_id.

    No window is needed for this much, so filters reach the scan; `sequenced` adds seq.
    """
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = millis("ts")
    return raw.select(
        F.concat(F.lit("events."), "event_type").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("arrival"),
        at.alias("at_ms"), at.alias("event_time_ms"), F.col("user_id").cast("string").alias("key"), "value", "props",
        F.get_json_object("props", "$.k").alias("message_id"),
    )


def sequenced(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds seq, the place of a row in its topic and partition by arrival, without sorting a topic in one task.

    Rows are numbered within blocks of `block` arrivals, and a block begins where the counts of those before it end.
    There is one count for each topic, partition and block, summed in each task before the shuffle.
    """
    by = ["topic", "partition"]
    at = F.floor(F.col("arrival") / block)
    counts = events.groupBy(*by, at.alias("_block")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*by, "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    rows = number(events.withColumn("_block", at), [*by, "_block"], ["arrival"]).join(offsets, [*by, "_block"])
    return rows.withColumn("seq", F.col("_before") + F.col("seq")).select(*events.columns, "seq")


def with_payload(events: DataFrame) -> DataFrame:
    """Adds payload, the VARIANT {value, props}."""
    return events.withColumn("payload", F.parse_json(F.concat(F.lit('{"value":'), F.col("value").cast("string"), F.lit(',"props":'), "props", F.lit("}"))))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (gzip or plain), one record a line; a malformed line is kept in _corrupt_record."""
    return spark.read.schema(LOG_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("ignoreCorruptFiles", True).json(path)


def good_records(log: DataFrame) -> DataFrame:
    """Real messages: well-formed, and numbered from 1 (0 marks control rows)."""
    return log.where(F.col("_corrupt_record").isNull() & (F.col("seq") >= 1)).drop("_corrupt_record")


def corrupt_lines(log: DataFrame) -> DataFrame:
    return log.cache().agg(F.count_if(F.col("_corrupt_record").isNotNull()).alias("corrupt_lines"))


def append_log(events: DataFrame, path: str) -> None:
    """Append to the log, a folder for each topic, so that a topic's scan reads only its own files."""
    events.write.mode("append").partitionBy("topic").parquet(path)


def export_topic(events: DataFrame, topic: str, path: str) -> None:
    """JSON lines {seq, payload, key, timestamp} of one topic."""
    events.where(F.col("topic") == topic).select("seq", F.to_json(F.struct("value", "props")).alias("payload"), "key", F.col("at_ms").alias("timestamp")).write.mode("overwrite").json(path)


def import_topic(spark: SparkSession, path: str, topic: str) -> DataFrame:
    """Exported lines under another topic, numbered anew from 1 in their old order."""
    rows = spark.read.schema("seq long, payload string, key string, timestamp long").json(path)
    return number(rows.select(F.lit(topic).alias("topic"), F.col("seq").alias("old_seq"), "payload", "key", F.col("timestamp").alias("at_ms")), ["topic"], ["old_seq"])
