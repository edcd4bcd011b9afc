"""Scans, gates, state, windows, joins and topic algebra as compositions of built-in operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import topic_matches
from ..functions.scalars import stable_hash
from ..sources.events import BLOCK
from ..sources.shared import written
from .blocked import beside, numbered, running

#: Milliseconds of two merged topics that are numbered together.
MERGE_MS = 600_000

# ---- scans ----


def since_seq(log: DataFrame, topic: str, cursor: int) -> DataFrame:
    return log.where((F.col("topic") == topic) & (F.col("seq") > cursor))


def seek(log: DataFrame, topic: str, cursor: int | None = None, reset: str = "earliest") -> DataFrame:
    """Rows of a topic behind a stored cursor. Without one, or with one past the end, reset says where to begin: with
    all that is kept (earliest), or behind it (latest)."""
    if reset not in ("earliest", "latest"):
        raise ValueError("reset is earliest or latest")
    rows = log.where(F.col("topic") == topic)
    end = rows.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_end"))  # one row, met in the plan
    begin = F.lit(0) if reset == "earliest" else F.col("_end")
    start = begin if cursor is None else F.when(F.col("_end") < cursor, begin).otherwise(cursor)
    return rows.join(F.broadcast(end.select(start.alias("_from"))), F.col("seq") > F.col("_from")).drop("_from")


def since_time(log: DataFrame, topic: str, at_ms: int) -> DataFrame:
    return log.where((F.col("topic") == topic) & (F.col("at_ms") > at_ms))


def poll(log: DataFrame, topic: str, cursor: int, n: int, now_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """A page of the next n rows that have not expired."""
    rows = since_seq(log, topic, cursor)
    rows = rows if ttl_ms is None else rows.where(F.col("at_ms") + ttl_ms > now_ms)
    return rows.orderBy("seq").limit(n)


def lookback(log: DataFrame, n: int, now_ms: int | None = None, age_ms: int | None = None) -> DataFrame:
    """Each topic's last n rows, of those at most age_ms old."""
    rows = log if age_ms is None else log.where(F.col("at_ms") >= now_ms - age_ms)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("seq")))).where(F.col("_r") <= n).drop("_r")


def retained(log: DataFrame, value: str = "value") -> DataFrame:
    """The latest row of each topic, without topics whose latest value is empty."""
    return log.groupBy("topic").agg(F.max_by(F.struct("seq", "at_ms", value), "seq").alias("r")).select("topic", "r.*").where(F.col(value).isNotNull())


def replay_range(log: DataFrame, topic: str, first: int, last: int, key: str | None = None, speed: float = 1.0) -> DataFrame:
    """Rows first to last, both included, with the pause before each when replayed at `speed`."""
    rows = log.where((F.col("topic") == topic) & F.col("seq").between(first, last))
    rows = rows if key is None else rows.where(F.col("key") == key)
    rows = beside(rows, ["topic"], ["seq"], "_before", F.col("at_ms"))
    return rows.withColumn("wait_ms", F.coalesce((F.col("at_ms") - F.col("_before")) / speed, F.lit(0.0))).drop("_before")


def gap_repair(log: DataFrame, delivered: DataFrame) -> DataFrame:
    """Rows of the log that are missing downstream."""
    return log.join(delivered.select("topic", "seq"), ["topic", "seq"], "left_anti")


def sequence_gaps(delivered: DataFrame, by: list[str]) -> DataFrame:
    rows = beside(delivered, by, ["seq"], "_before", F.col("seq"))
    return rows.withColumn("missing", F.col("seq") - F.col("_before") - 1).where("missing > 0").drop("_before")


def outbox_lag(outbox: DataFrame, cursor: int, now_ms: int) -> DataFrame:
    return outbox.where(F.col("seq") > cursor).agg(F.count(F.lit(1)).alias("pending"), (F.lit(now_ms) - F.min("at_ms")).alias("oldest_ms"))


def outbox_read(outbox: DataFrame, cursor: int, limit: int) -> DataFrame:
    """The first rows that the cursor has not acknowledged, in order."""
    return outbox.where(F.col("seq") > cursor).orderBy("seq").limit(limit)


def acknowledge(cursor: Column, acked: Column) -> Column:
    """The cursor after an acknowledgement: it never goes back."""
    return F.greatest(cursor, acked)


def due(delayed: DataFrame, now_ms: int) -> DataFrame:
    """Delayed rows that may be delivered, by due time and then by order of scheduling."""
    return delayed.where(F.col("deliver_at") <= now_ms).orderBy("deliver_at", "arrival")


# ---- gates ----


def resolve_rules(df: DataFrame, rules: list[tuple[str, object]], name: str) -> DataFrame:
    """The value of the rule for each row's topic: an exact topic beats patterns, then the earliest wins."""
    exact = [(p, v) for p, v in rules if "*" not in p]
    value = F.lit(None)
    for p, v in [*reversed([r for r in rules if "*" in r[0]]), *reversed(exact)]:
        value = F.when(topic_matches(F.col("topic"), p), F.lit(v)).otherwise(value)
    return df.withColumn(name, value)


def alive(now_ms: Column, at: Column, ttl: Column, deadline: Column | None = None) -> Column:
    """Not expired: strictly before at + ttl, and before a hard deadline."""
    end = at + ttl if deadline is None else F.least(at + ttl, deadline)
    return F.coalesce(now_ms < end, F.lit(True))


def sampled(ident: Column, rate: float, critical: Column | None = None) -> Column:
    """A repeatable sample by identifier; critical rows are always in it."""
    keep = F.pmod(stable_hash(ident), F.lit(1_000_000)) < int(rate * 1_000_000)
    return keep if critical is None else keep | critical


def delivered_sample(seq: Column, rate: int = 1) -> Column:
    """What a subscriber with a delivery sample rate gets: each topic's sequence numbers that the rate divides."""
    if rate < 1:
        raise ValueError("a delivery sample rate is a positive whole number")
    return seq % rate == 0


def first_gate(gates: list[tuple[str, Column]]) -> Column:
    """The name of the first gate that refuses (its column is true), null if all admit."""
    return reduce(lambda rest, g: F.when(g[1], g[0]).otherwise(rest), reversed(gates), F.lit(None).cast("string"))


def version_gate(version: Column, current: int, retired_at: dict[int, int], now_ms: Column, grace_ms: int) -> Column:
    """ok, grace, expired or unknown; the end of the grace belongs to it."""
    out = F.when(version == current, "ok")
    for v, at in retired_at.items():
        out = out.when((version == v) & (now_ms <= at + grace_ms), "grace").when(version == v, "expired")
    return out.otherwise("unknown")


def migration_path(steps: set[tuple[int, int]], start: int, end: int) -> list[int] | None:
    """The fewest hops from one version to another."""
    paths = [[start]]
    seen = {start}
    while paths:
        path = paths.pop(0)
        if path[-1] == end:
            return path
        for a, b in sorted(steps):
            if a == path[-1] and b not in seen:
                seen.add(b)
                paths.append([*path, b])
    return None


def migrate(value: Column, start: int, end: int, steps: dict) -> Column:
    """The composed column functions of the shortest path; null if there is none."""
    path = migration_path(set(steps), start, end)
    return F.lit(None) if path is None else reduce(lambda c, hop: steps[hop](c), zip(path, path[1:], strict=False), value)


def redact(df: DataFrame, column: str, paths: list[str], mask: str = "***") -> DataFrame:
    """Replace fields of a struct by a mask; paths that don't exist are left out."""
    from pyspark.sql.types import StructType

    def there(kind, names):
        return not names or isinstance(kind, StructType) and names[0] in kind.names and there(kind[names[0]].dataType, names[1:])

    for p in paths:
        if there(df.schema[column].dataType, p.split(".")):
            df = df.withColumn(column, F.col(column).withField(p, F.lit(mask)))
    return df


def acl(df: DataFrame, rules: list[tuple[str, str, str]]) -> Column:
    """Whether a principal may use a topic: the first rule (principal, pattern, allow|deny) that fits, else no."""
    out = F.lit(False)
    for who, pattern, verdict in reversed(rules):
        fits = topic_matches(F.col("topic"), pattern) & (F.lit(who == "*") | (F.col("principal") == who))
        out = F.when(fits, verdict == "allow").otherwise(out)
    return out


def atomic(df: DataFrame, batch: str, index: str, refused: str) -> DataFrame:
    """All rows of a batch are admitted or none; the first refused entry is named."""
    w = Window.partitionBy(batch)
    return df.withColumn("admitted", ~F.max(refused).over(w)).withColumn("first_refused", F.min(F.when(F.col(refused), F.col(index))).over(w))


# ---- state ----


def ktable(log: DataFrame, value: str = "value", prefix: str = "") -> DataFrame:
    """Latest value, seq and version (number of updates) for each topic and key; rows without a key are ignored."""
    keyed = log.where(F.col("key").isNotNull() & F.col("key").startswith(prefix))
    return keyed.groupBy("topic", "key").agg(F.max_by(value, "seq").alias("value"), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("version"))


def changelog(log: DataFrame, value: str = "value") -> DataFrame:
    w = Window.partitionBy("topic", "key").orderBy("seq")
    return log.where("key is not null").withColumn("old_value", F.lag(value).over(w)).withColumn("version", F.row_number().over(w).cast("long"))


def compact(log: DataFrame, max_keyless: int | None = None) -> DataFrame:
    """The latest row of each key, and the last max_keyless rows without one."""
    newest = Window.partitionBy("topic", "key").orderBy(F.desc("seq"))
    keep = F.when(F.col("key").isNotNull(), F.col("_r") == 1).otherwise(F.lit(True) if max_keyless is None else F.col("_r") <= max_keyless)
    return log.withColumn("_r", F.row_number().over(newest)).where(keep).drop("_r")


def key_ttl(table: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """Compacted rows with those last written before now - ttl marked as tombstones of seq 0."""
    gone = F.col("at_ms") < now_ms - ttl_ms
    return table.withColumn("tombstone", gone).withColumn("seq", F.when(gone, F.lit(0)).otherwise(F.col("seq")).cast("long"))


def retain(log: DataFrame, cutoff_ms: int | None = None, max_rows: int | None = None) -> DataFrame:
    out = log if cutoff_ms is None else log.where(F.col("at_ms") >= cutoff_ms)
    return out if max_rows is None else lookback(out, max_rows)


# ---- windows ----


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def as_text(c: Column) -> Column:
    """A number without a fraction is written without one."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def fold_of(kind: str, value: str = "value", order: str = "arrival") -> Column:
    v = finite(F.col(value))
    kinds = {
        "count": lambda: F.count(F.lit(1)).cast("double"), "sum": lambda: F.sum(v), "avg": lambda: F.avg(v), "min": lambda: F.min(v), "max": lambda: F.max(v),
        "last": lambda: F.max_by(value, order),
        "concat": lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, as_text(F.col(value)).alias("t")))), lambda x: x.t), ""),
    }
    if kind not in kinds:
        raise ValueError(f"no such aggregate: {kind}")
    return kinds[kind]()


def _counted(kind: str, value: str) -> Column:
    return F.count(finite(F.col(value))) if kind in ("sum", "avg", "min", "max") else F.count(F.lit(1))


def tumbling(df: DataFrame, kind: str, width_ms: int, by: list[str] = (), value: str = "value", at: str = "at_ms") -> DataFrame:
    """window_start, window_end, count, value for each window aligned to the epoch; numeric kinds count finite
    numbers only, and a window without any gives no row."""
    start = (F.floor(F.col(at) / width_ms) * width_ms).cast("long")
    out = df.groupBy(*by, start.alias("window_start")).agg(_counted(kind, value).alias("count"), fold_of(kind, value).alias("value"))
    return out.where("count > 0").withColumn("window_end", F.col("window_start") + width_ms)


def hopping(df: DataFrame, width_ms: int, slide_ms: int, by: list[str] = (), at: str = "at_ms") -> DataFrame:
    """Counts for each window start that is a multiple of the slide."""
    last = F.floor(F.col(at) / slide_ms) * slide_ms
    starts = F.transform(F.sequence(F.lit(0), F.lit(width_ms // slide_ms - 1)), lambda k: (last - k * slide_ms).cast("long"))
    return df.select(*by, F.explode(starts).alias("window_start")).groupBy(*by, "window_start").agg(F.count(F.lit(1)).alias("count"))


def sessions(df: DataFrame, gap_ms: int, kind: str = "count", by: list[str] = ("key",), value: str = "value", at: str = "at_ms") -> DataFrame:
    """Sessions broken where two rows lie gap_ms or more apart; the end is the last row's time."""
    w = Window.partitionBy(*by).orderBy(at, "arrival")
    new = F.when(F.col(at) - F.lag(at).over(w) >= gap_ms, 1).otherwise(0)
    numbered = df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w))
    return numbered.groupBy(*by, "session").agg(F.min(at).alias("session_start"), F.max(at).alias("session_end"), _counted(kind, value).alias("count"), fold_of(kind, value).alias("value")).drop("session").where("count > 0")


def watermarked(df: DataFrame, lateness_ms: int, order: str = "arrival", t: str = "event_time_ms", width: int = BLOCK) -> DataFrame:
    """Adds the watermark before each row and whether the row is late; late rows stay. width: a block's, in units of order."""
    rows = running(df, ["topic"], [order], width, before=True, watermark=("max", F.col(t) - lateness_ms))
    return rows.withColumn("late", F.coalesce(F.col(t) < F.col("watermark"), F.lit(False)))


def released(df: DataFrame, lateness_ms: int, order: str = "arrival", t: str = "event_time_ms", width: int = BLOCK, span_ms: int = 1 << 20) -> DataFrame:
    """Adds released, the place of a row in its topic when each waits until the watermark has reached it: EventTimeBuffer
    without a limit to the hold, by blocks. width: a block's, in units of order; span_ms: a block's of times.

    A waiting row goes out with the first row that lifts the watermark to its time. That hangs on the time alone, so it is
    looked up once for each time, and a block of times has two rows for each millisecond at most.
    """
    at, top = F.col(t), F.col("_top")
    rows = written(running(df, ["topic"], [order], width, before=True, _top=("max", at)), "watermarks")
    waits = at.isNotNull() & F.coalesce(at > top - lateness_ms, F.lit(True))
    lifts = rows.where(at.isNotNull() & F.coalesce(at > top, F.lit(True))).select("topic", (lateness_ms - at).alias("_back"), F.lit(0).alias("_asks"), F.col(order).alias("_step"))
    asks = rows.where(waits).select("topic", (-at).alias("_back")).distinct().select("topic", "_back", F.lit(1).alias("_asks"), F.lit(None).cast("long").alias("_step"))
    found = running(lifts.unionByName(asks), ["topic"], ["_back", "_asks"], span_ms, _first=("min", F.col("_step"))).where("_asks = 1")
    found = found.select(F.col("topic").alias("_t"), F.col("_back").alias("_b"), "_first")
    met = rows.join(found, F.col("topic").eqNullSafe(F.col("_t")) & (F.coalesce(-at, F.col(order)) == F.col("_b")), "left")
    step = F.when(waits, F.coalesce("_first", F.lit((1 << 63) - 1))).otherwise(F.col(order))
    met = written(met.select(*df.columns, step.alias("_step")), "releases")
    return numbered(met, ["topic"], ["_step", t, "arrival"], "released", width).drop("_step")


def idle_advances(df: DataFrame, idle_ms: int) -> DataFrame:
    """One row for each silence of idle_ms or more after a timed row."""
    rows = beside(df, ["topic"], ["arrival"], "next_at_ms", F.col("at_ms"), following=True)
    return rows.where(F.col("event_time_ms").isNotNull() & (F.col("next_at_ms") - F.col("at_ms") >= idle_ms))


# ---- joins ----


def join_late(window_ms: int) -> Column:
    """Whether a row of a join comes when its whole window has passed."""
    return F.col("ts") < F.col("now") - window_ms


def stream_join(left: DataFrame, right: DataFrame, window_ms: int, how: str = "inner", drop_late: bool = True, max_buffered: int | None = None) -> DataFrame:
    """Windowed join in order of arrival on key: the earlier row's time lies in [later - window, later].

    Sides have arrival, key, ts, now. The time range becomes an equality of window numbers, so that a pair
    search reads two windows and not a key's whole history. `left` adds a row without a partner for each left
    row that had none when it came; a later partner still gives its pair. Rows late on arrival (join_late)
    take no part. With max_buffered a side's older rows are forgotten: those of which the probe has seen that many
    newer ones.
    """
    sides = [df.where(~join_late(window_ms)) if drop_late else df for df in (left, right)]
    both = reduce(DataFrame.unionByName, [df.select(F.coalesce("key", F.lit("")).alias("key"), "arrival", "ts", "now", F.lit(k).alias("_s")) for k, df in enumerate(sides)])
    if max_buffered:
        so_far = Window.partitionBy("key").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("_0", F.count_if(F.col("_s") == 0).over(so_far)).withColumn("_1", F.count_if(F.col("_s") == 1).over(so_far))
    else:
        both = both.withColumn("_0", F.lit(0)).withColumn("_1", F.lit(0))

    def side(k: int, name: str) -> DataFrame:
        return both.where(F.col("_s") == k).select("key", *[F.col(c).alias(f"{name}_{c}") for c in ("arrival", "ts", "now")], F.col(f"_{k}").alias(f"{name}_n"), F.col(f"_{1 - k}").alias(f"{name}_seen"))

    left_, right_ = side(0, "l"), side(1, "r")

    def meet(early: DataFrame, late_: DataFrame, e: str, p: str) -> DataFrame:
        e_b = early.withColumn("_b", F.floor(F.col(f"{e}_ts") / window_ms))
        p_b = late_.withColumn("_b", F.explode(F.array(F.floor(F.col(f"{p}_ts") / window_ms), F.floor(F.col(f"{p}_ts") / window_ms) - 1)))
        before = F.col(f"{e}_arrival") < F.col(f"{p}_arrival")
        inside = F.col(f"{e}_ts").between(F.col(f"{p}_ts") - window_ms, F.col(f"{p}_ts")) & (F.col(f"{e}_ts") >= F.col(f"{p}_now") - window_ms)
        return e_b.join(p_b, ["key", "_b"]).where(before & inside).drop("_b")

    r_first, l_first = meet(right_, left_, "r", "l"), meet(left_, right_, "l", "r")
    if max_buffered:
        r_first = r_first.where(F.col("l_seen") - F.col("r_n") < max_buffered)
        l_first = l_first.where(F.col("r_seen") - F.col("l_n") < max_buffered)
    same = left_.join(right_, ["key"]).where("l_arrival = r_arrival")
    columns = ["key", "l_arrival", "r_arrival", "l_ts", "r_ts"]
    pairs = r_first.select(columns).unionByName(l_first.select(columns)).unionByName(same.select(columns))
    pairs = pairs.withColumn("window_start", F.greatest("l_ts", "r_ts") - window_ms)
    if how == "inner":
        return pairs
    alone = left_.join(r_first.select("l_arrival").distinct(), "l_arrival", "left_anti")
    nothing = F.lit(None).cast("long")
    return pairs.unionByName(alone.select("key", "l_arrival", nothing.alias("r_arrival"), "l_ts", nothing.alias("r_ts"), (F.col("l_ts") - window_ms).alias("window_start")))


def route(df: DataFrame, routes: list[tuple[str, str, Column | None]]) -> DataFrame:
    """The rows and, once each, their copies on other topics; a copy isn't routed on, nor to its own topic."""
    out = df.withColumn("routed_from", F.lit(None).cast("string"))
    for src, dst, when in routes:
        hit = topic_matches(F.col("topic"), src) & (F.col("topic") != dst) & (F.lit(True) if when is None else when)
        out = out.unionByName(df.where(hit).withColumn("routed_from", F.col("topic")).withColumn("topic", F.lit(dst)))
    return out


def last_writer_wins(df: DataFrame, clock: str = "hlc") -> DataFrame:
    """Keyed rows whose clock is newer than all before them; rows without a key are kept."""
    before = F.max(clock).over(Window.partitionBy("topic", "key").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_m", before).where(F.col("key").isNull() | F.col("_m").isNull() | (F.col(clock) > F.col("_m"))).drop("_m")


def correlate(requests: DataFrame, replies: DataFrame, timeout_ms: int) -> DataFrame:
    """Each request with its first reply within the timeout, or timed out."""
    got = replies.select("correlation_id", F.col("at_ms").alias("reply_ms"))
    hit = requests.join(got, "correlation_id", "left").withColumn("reply_ms", F.when(F.col("reply_ms").between(F.col("at_ms"), F.col("at_ms") + timeout_ms), F.col("reply_ms")))
    return hit.groupBy("correlation_id", "at_ms").agg(F.min("reply_ms").alias("reply_ms")).withColumn("timed_out", F.col("reply_ms").isNull())


# ---- topic algebra ----


def _renumbered(df: DataFrame, order: list[str], width: int = BLOCK) -> DataFrame:
    return numbered(df.drop("seq"), ["topic", "partition"], order, "seq", width)


def fork(log: DataFrame, src: str, dst: str, from_seq: int | None = None, from_time: int | None = None, keyed_latest: bool = False) -> DataFrame:
    """A topic's rows after a cursor, under another name and numbered anew."""
    rows = log.where(F.col("topic") == src)
    rows = rows if from_seq is None else rows.where(F.col("seq") > from_seq)
    rows = rows if from_time is None else rows.where(F.col("at_ms") > from_time)
    rows = compact(rows) if keyed_latest else rows
    return _renumbered(rows.withColumn("old_seq", F.col("seq")).withColumn("topic", F.lit(dst)), ["old_seq"])


def merge(log: DataFrame, a: str, b: str, dst: str) -> DataFrame:
    """Two topics as one, by time; at equal times the first source goes first."""
    rows = log.where(F.col("topic").isin(a, b)).withColumn("source", F.col("topic")).withColumn("_k", F.when(F.col("topic") == a, 0).otherwise(1))
    return _renumbered(rows.withColumn("topic", F.lit(dst)).withColumn("old_seq", F.col("seq")), ["at_ms", "_k", "old_seq"], MERGE_MS).drop("_k")


def split(log: DataFrame, src: str, predicate: Column, yes: str, no: str) -> DataFrame:
    """A topic as two: rows that meet the predicate, and all others."""
    rows = log.where(F.col("topic") == src).withColumn("split_source", F.lit(src)).withColumn("old_seq", F.col("seq"))
    return _renumbered(rows.withColumn("topic", F.when(F.coalesce(predicate, F.lit(False)), yes).otherwise(no)), ["old_seq"])
