"""Delivery: retries and dead letters, calendar windows, schedules, expiry, priorities and latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import Cron

DAY_MS = 86_400_000
#: Weights of the named subscriber priorities.
PRIORITIES = {"high": 4, "normal": 2, "low": 1}


def retries(df: DataFrame, attempt: Column, failed_at: Column, instant: int, ladder: list[int]) -> DataFrame:
    """Adds retry_at and dead: `instant` retries at once, then one for each rung of the ladder, then none."""
    rung = attempt - instant
    wait = F.when(rung <= 0, F.lit(0))
    for k, ms in enumerate(ladder, 1):
        wait = wait.when(rung == k, F.lit(ms))
    return df.withColumn("retry_at", failed_at + wait).withColumn("dead", rung > len(ladder))


def dead_letters(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows to go on with, and dead ones with their reason for a second sink."""
    return df.where(~F.col("dead")), df.where("dead").withColumn("reason", reason)


def release_at(at_ms: Column, windows: list[dict]) -> Column:
    """When a row may be delivered: at once within a window, else at the first opening within eight days, else null.

    windows: start and end as HH:MM, zone, days (0: Sunday). A window that ends before it starts belongs to the day
    it starts on; equal ends mean the whole day. The session's time zone must be UTC.
    """
    minute = lambda text: int(text[:2]) * 60 + int(text[3:])
    now, found = F.timestamp_millis(at_ms), []
    for w in windows:
        zone, a, b = w.get("zone", "UTC"), minute(w["start"]), minute(w["end"])
        a, b = (0, 1440) if a == b else (a, b)
        local = F.from_utc_timestamp(now, zone)
        for k in range(-1, 9):
            day = F.date_add(local.cast("date"), k)
            start, end = (F.timestamp_seconds(F.unix_date(day).cast("long") * 86_400 + m * 60) for m in (a, b if b > a else b + 1440))
            fits = (end > local) if w.get("days") is None else (end > local) & (F.dayofweek(day) - 1).isin(*w["days"])
            opens = F.greatest(F.unix_millis(F.to_utc_timestamp(start, zone)), at_ms)
            found.append(F.when(fits & (opens <= F.floor(at_ms / 60_000) * 60_000 + 8 * DAY_MS), opens))
    return F.least(*found)


def occurrences(spark: SparkSession, cron: str, after_ms: int, until_ms: int) -> DataFrame:
    """(at_ms) of every occurrence with after < at <= until; days are filtered first, then dealt into times."""
    c = Cron(cron)
    days = spark.range(after_ms // DAY_MS, until_ms // DAY_MS + 1).select(F.date_from_unix_date(F.col("id").cast("int")).alias("day"), (F.col("id") * DAY_MS).alias("ms"))
    in_month = F.last_day("day") == F.col("day") if c.last_day else F.dayofmonth("day").isin(*c.day)
    in_week = (F.dayofweek("day") - 1).isin(*c.weekday)
    both = c.any_weekday or c.any_day and not c.last_day
    days = days.where(F.month("day").isin(*c.month) & ((in_month & in_week) if both else (in_month | in_week)))
    times = F.array(*[F.lit((h * 60 + m) * 60_000) for h in sorted(c.hour) for m in sorted(c.minute)])
    return days.select("ms", F.explode(times).alias("time")).select((F.col("ms") + F.col("time")).alias("at_ms")).where((F.col("at_ms") > after_ms) & (F.col("at_ms") <= until_ms))


def expiring_soon(queue: DataFrame, by: list[str], now_ms: int, deadline: str, threshold_ms: int) -> DataFrame:
    """Queues whose head has at most threshold_ms left to live, and does live."""
    head = queue.groupBy(*by).agg(F.min_by(F.struct("arrival", deadline), "arrival").alias("h"))
    return head.select(*by, "h.arrival", (F.col(f"h.{deadline}") - now_ms).alias("left_ms")).where(f"left_ms > 0 and left_ms <= {threshold_ms}")


def subscriber_order(df: DataFrame, subscriber: str, weight: Column) -> DataFrame:
    """Adds the round in which a row is handed over: each round takes `weight` rows of each subscriber."""
    place = F.row_number().over(Window.partitionBy(subscriber).orderBy("arrival"))
    return df.withColumn("round", F.ceil(place / weight).cast("long"))


def slow_start_rate(elapsed_ms: Column, initial: float, ramp_ms: int, target: float | None = None, strategy: str = "linear") -> Column:
    """Rows a second that a new subscriber may get: from initial to the target, or to twice the initial; null: no limit."""
    t = F.greatest(elapsed_ms, F.lit(0)) / ramp_ms
    end = 2.0 * initial if target is None else float(target)
    ramp = initial + (end - initial) * t if strategy == "linear" else initial * F.pow(F.lit(end / initial), t)
    return F.when(elapsed_ms >= ramp_ms, F.lit(target).cast("double")).otherwise(ramp)


def ack_latency(accepted: DataFrame, acked: DataFrame, slo_ms: int) -> DataFrame:
    """Round trips of accepted rows that were acknowledged, with their misses of the objective."""
    both = accepted.join(acked.select("topic", "arrival", "acked_ms"), ["topic", "arrival"])
    return both.withColumn("ms", F.greatest(F.col("acked_ms") - F.col("at_ms"), F.lit(0))).withColumn("missed", F.col("ms") > slo_ms)


def lag_watermark(queue: DataFrame, delivered: DataFrame, by: list[str], now_ms: int) -> DataFrame:
    """Rows not delivered yet, and the age of the oldest of them, for each queue."""
    waiting = queue.join(delivered.select("arrival"), "arrival", "left_anti")
    return waiting.groupBy(*by).agg(F.count(F.lit(1)).alias("depth"), F.greatest(F.lit(now_ms) - F.min("at_ms"), F.lit(0)).alias("lag_ms"))


def dwell(delivered: DataFrame, by: list[str], since_ms: int) -> DataFrame:
    """How long rows delivered since then had waited: number, median, 95th and 99th percentile and maximum."""
    rows = delivered.where(F.col("delivered_ms") >= since_ms).withColumn("_w", F.greatest(F.col("delivered_ms") - F.col("at_ms"), F.lit(0)))
    at = lambda p: F.expr(f"cast(percentile_disc({p}) within group (order by _w) as double)")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("_w").alias("max"))


def drops(journal: DataFrame, n: int, **only: str) -> DataFrame:
    """The last n entries of a drop journal with the given topic, subscriber or reason, oldest first."""
    rows = journal
    for column, value in only.items():
        rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc("arrival")).limit(n).orderBy("arrival")


def transformed(df: DataFrame, steps: list) -> DataFrame:
    """The steps (DataFrame -> DataFrame) one after the other, in the order of their registration."""
    for step in steps:
        df = df.transform(step)
    return df
