"""Delivery order, metrics, assignment and audit as compositions of built-in operators."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import stable_hash
from ..sources.shared import written
from .blocked import beside, numbered, running

# ---- order of delivery ----

# Lanes in order, and their weights.
LANES = {"urgent": 8, "normal": 2, "bulk": 1}


def lane_number(lane: Column) -> Column:
    out = F.lit(len(LANES))
    for i, name in reversed(list(enumerate(LANES))):
        out = F.when(lane == name, i).otherwise(out)
    return out


def edf_order(df: DataFrame) -> list[Column]:
    """By lane, then rows with a deadline (earliest first), then by arrival."""
    return [lane_number(F.col("lane")), F.asc_nulls_last("deadline_ms"), F.col("arrival")]


def missed_deadline(deadline: Column, handoff: Column) -> Column:
    """Whether a row was handed over at its deadline or later; such rows are delivered all the same."""
    return F.coalesce(deadline <= handoff, F.lit(False))


def lane_order(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rounds of 8 urgent, 2 normal and 1 bulk row: `round` and the place within it."""
    rn = F.row_number().over(Window.partitionBy(*by, "lane").orderBy("arrival"))
    weight = F.lit(1)
    for name, w in LANES.items():
        weight = F.when(F.col("lane") == name, w).otherwise(weight)
    return df.withColumn("rn", rn).withColumn("round", F.ceil(F.col("rn") / weight)).withColumn("lane_no", lane_number(F.col("lane")))


def fair_order(df: DataFrame, weight: int = 1) -> DataFrame:
    """Deficit round robin over topics in order of first appearance: `round` and `first`."""
    first = df.groupBy("topic").agg(F.min("arrival").alias("first"))
    return numbered(df, ["topic"], ["arrival"], "rn").join(first, "topic").withColumn("round", F.ceil(F.col("rn") / weight))


def fair_budget(df: DataFrame, budget: int, weight: int = 1) -> DataFrame:
    """What deficit round robin hands over with a budget of so many rows."""
    return fair_order(df, weight).orderBy("round", "first", "rn").limit(budget)


def barrier_epochs(df: DataFrame, is_barrier: Column, by: list[str]) -> DataFrame:
    """The number of the last barrier before each row; barriers themselves drop out."""
    marked = df.withColumn("_b", is_barrier)
    return running(marked, by, ["arrival"], before=True, epoch=("sum", F.col("_b").cast("long"))).where(~F.col("_b")).drop("_b")


def micro_batches(df: DataFrame, size: int, by: list[str]) -> DataFrame:
    return numbered(df, by, ["arrival"], "batch").withColumn("batch", F.ceil(F.col("batch") / size))


def bounded_queue(df: DataFrame, capacity: int, policy: str, by: list[str]) -> DataFrame:
    """What a burst leaves in a queue: drop-oldest keeps its end, drop-newest its beginning."""
    order = F.desc("arrival") if policy == "drop-oldest" else F.asc("arrival")
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_r") <= capacity).drop("_r")


# ---- metrics ----


def rates(df: DataFrame, now_ms: int, windows: dict[str, int]) -> DataFrame:
    """Rows a second over trailing windows (name -> ms), both ends included, for each topic."""
    return df.groupBy("topic").agg(*[(F.count_if(F.col("at_ms").between(now_ms - w, now_ms)) / (w / 1000)).alias(n) for n, w in windows.items()])


def top(df: DataFrame, by: str, tie: str, n: int = 10) -> DataFrame:
    """The n largest that aren't zero, ties by name."""
    return df.where(F.col(by) > 0).orderBy(F.desc(by), tie).limit(n)


def summary(df: DataFrame, by: list[str], value: str, order: str, last: int | None = 1024) -> DataFrame:
    """n, min, max, mean, p50, p95, p99 (nearest rank) of the last samples, negative ones as 0."""
    rows = df.withColumn("_v", F.greatest(F.col(value), F.lit(0.0)))
    if last:
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_r") <= last)
    rank = lambda q: F.expr(f"percentile_disc({q}) within group (order by _v)").alias(f"p{round(q * 100)}")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.avg("_v").alias("mean"), rank(0.5), rank(0.95), rank(0.99))


def histogram(df: DataFrame, value: Column, bounds: list[int], by: list[str] = ()) -> DataFrame:
    """count, sum, cumulative buckets le_<bound>, and p50 and p99 as the first bound that reaches their rank."""
    v = df.withColumn("_v", value)
    agg = [F.count(F.lit(1)).alias("count"), F.sum("_v").alias("sum"), *[F.count_if(F.col("_v") <= b).alias(f"le_{b}") for b in bounds]]
    out = v.groupBy(*by).agg(*agg)
    for name, q in (("p50", 0.5), ("p99", 0.99)):
        at = F.lit(None).cast("long")
        for b in reversed(bounds):
            at = F.when(F.col(f"le_{b}") >= F.ceil(F.lit(q) * F.col("count")), F.lit(b).cast("long")).otherwise(at)
        out = out.withColumn(name, at)
    return out


def group_lag(assigned: DataFrame, committed: DataFrame, by: list[str], threshold: int) -> DataFrame:
    a, c = assigned.groupBy(*by).agg(F.max("seq").alias("assigned")), committed.groupBy(*by).agg(F.max("seq").alias("committed"))
    out = a.join(c, by, "left").withColumn("committed", F.coalesce("committed", F.lit(0)))
    return out.withColumn("lag", F.col("assigned") - F.col("committed")).withColumn("over", F.col("lag") > threshold)


def runs(df: DataFrame, by: list[str], order: str, when: Column) -> DataFrame:
    """Adds run: how many rows up to this one, in a row, meet the condition."""
    rows = numbered(df.withColumn("_ok", when), by, [order], "_n")
    rows = running(rows, by, [order], _last=("max", F.when(~F.col("_ok"), F.col("_n"))))
    return rows.withColumn("run", F.col("_n") - F.coalesce("_last", F.lit(0))).drop("_ok", "_n", "_last")


def edges(df: DataFrame, by: list[str], order: str, when: Column) -> DataFrame:
    """Rows at which a condition becomes true."""
    rows = beside(df.withColumn("_c", when), by, [order], "_p", F.col("_c"))
    return rows.where(F.col("_c") & ~F.coalesce("_p", F.lit(False))).drop("_c", "_p")


def forecast(df: DataFrame, by: list[str], t: str, lag: str, limit: float, last: int = 64, least: int = 4) -> DataFrame:
    """Least squares over the last samples: slope, intercept, fit and the time to `limit`; null unless it rises and is below."""
    rows = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(t)))).where(F.col("_r") <= last)
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(lag, t).alias("slope"), F.regr_intercept(lag, t).alias("intercept"), F.coalesce(F.regr_r2(lag, t), F.lit(1.0)).alias("r2"), F.max_by(lag, t).alias("now"), F.max(t).alias("t"))
    eta = (limit - F.col("intercept")) / F.col("slope") - F.col("t")
    return out.withColumn("eta", F.when((F.col("n") >= least) & (F.col("slope") > 0) & (F.col("now") < limit), F.greatest(eta, F.lit(0.0))))


# The decision that goes with a reason; all other reasons hold.
SCALING = {"lag-above-threshold": "scale_up", "drained-idle": "scale_down"}


def scaling_reason(lag_p99: Column, watermark: Column, rate: Column, high_lag: float = 1000, high_rate: float = 1, idle_lag: float = 10, idle_rate: float = 0.1) -> Column:
    """Why a consumer should grow, shrink or stay. The lag is the p99, or the watermark where there is none.

    Lag strictly above high_lag with a rate of high_rate or more asks for more; a p99 and a watermark within idle_lag with
    a rate strictly below idle_rate for less. A missing watermark counts as drained; a missing rate confirms nothing.
    """
    lag = F.coalesce(lag_p99, watermark)
    idle = (lag_p99 <= idle_lag) & (F.coalesce(watermark, F.lit(0)) <= idle_lag) & (rate < idle_rate)
    over = F.when(rate.isNull(), "no-rate-data").when(rate >= high_rate, "lag-above-threshold").otherwise("lag-high-rate-dropping")
    return F.when(lag.isNull(), "no-data").when(lag > high_lag, over).when(idle, "drained-idle").otherwise("lag-normal")


def scaling_signal(reason: Column) -> Column:
    out = F.lit("hold")
    for why, signal in SCALING.items():
        out = F.when(reason == why, signal).otherwise(out)
    return out


def diagnose(checks: DataFrame) -> DataFrame:
    """critical if a check fails, degraded if one warns, else healthy; checks has check, verdict (ok, warn, fail)."""
    worst = F.max(F.when(F.col("verdict") == "fail", 2).when(F.col("verdict") == "warn", 1).otherwise(0))
    return checks.agg(F.element_at(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("critical")), worst + 1).alias("health"))


# Kinds of actions, the one that reaches least first.
REMEDIES = ("resume-subscriber", "prune-linger-windows", "rebalance-group")


def remediation(degraded: DataFrame, lingering: DataFrame, skewed: DataFrame, most: int = 10) -> DataFrame:
    """kind, target and place of at most `most` actions.

    Degraded subscribers (subscriber_id, auto_resume_armed) are resumed unless they resume by themselves, groups
    (group_id, expired_windows) with expired handoff windows lose these, and groups (group_id, partitions, members)
    with fewer members than partitions are balanced anew.
    """
    plans = (degraded.where("not auto_resume_armed").select(F.col("subscriber_id").alias("target")), lingering.where("expired_windows > 0").select(F.col("group_id").alias("target")), skewed.where("members < partitions").select(F.col("group_id").alias("target")))
    out = None
    for k, (kind, plan) in enumerate(zip(REMEDIES, plans, strict=True)):
        part = plan.select(F.lit(k).alias("reach"), F.lit(kind).alias("kind"), "target")
        out = part if out is None else out.unionByName(part)
    first = out.orderBy("reach", "target").limit(most)
    return first.withColumn("place", F.row_number().over(Window.orderBy("reach", "target")).cast("long")).drop("reach")  # `most` rows


def exposition(metrics: DataFrame) -> DataFrame:
    """Prometheus text lines of rows (name, labels map, value)."""
    text = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e.key, F.lit('="'), F.replace(F.replace(e.value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))), ",")
    return metrics.select(F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), text, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("line"))


def hotspots(df: DataFrame, threshold: int = 100, n: int = 10) -> DataFrame:
    """Keys with at least `threshold` outstanding rows, the deepest first."""
    return df.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("depth")).where(F.col("depth") >= threshold).orderBy(F.desc("depth"), "key").limit(n)


# ---- assignment ----


def rendezvous(df: DataFrame, item: str, members: list[str]) -> Column:
    """The member with the greatest hash of item and member: few move when members come or go."""
    scored = F.array(*[F.struct(F.substring(F.sha2(F.concat(F.col(item).cast("string"), F.lit("\0"), F.lit(m)), 256), 1, 16).alias("s"), F.lit(m).alias("m")) for m in members])
    return F.array_max(scored)["m"]


def _score(item: str, member: str) -> str:
    return hashlib.sha256(f"{item}\0{member}".encode()).hexdigest()[:16]


def zone_aware_member(df: DataFrame, item: str, zones: dict[str, list[str]]) -> Column:
    """The best member of the best zone that has members, as a column."""
    live = {z: ms for z, ms in zones.items() if ms}
    zone, member = rendezvous(df, item, list(live)), F.lit(None).cast("string")
    for z, ms in live.items():
        member = F.when(zone == z, rendezvous(df, item, ms)).otherwise(member)
    return member


def lag_aware_member(df: DataFrame, item: str, members: list[str], lags: dict[str, float]) -> Column:
    """The member with the least lag, the greatest hash among equals; one without a sample counts as the worst."""
    worst = float(max(lags.values(), default=0))
    scored = F.array(*[F.struct(F.lit(-float(lags.get(m, worst))).alias("l"), F.substring(F.sha2(F.concat(F.col(item).cast("string"), F.lit("\0"), F.lit(m)), 256), 1, 16).alias("s"), F.lit(m).alias("m")) for m in members])
    return F.array_max(scored)["m"]


def zone_aware(item: str, zones: dict[str, list[str]]) -> str | None:
    """The best member of the best zone that has members."""
    live = sorted((z for z, ms in zones.items() if ms), key=lambda z: _score(item, z), reverse=True)
    return max(zones[live[0]], key=lambda m: _score(item, m)) if live else None


def lag_aware(item: str, members: list[str], lags: dict[str, float]) -> str:
    """The member with the least lag; one without a sample counts as the worst; none known: rendezvous."""
    worst = max(lags.values(), default=0)
    return min(sorted(members, key=lambda m: _score(item, m), reverse=True), key=lambda m: lags.get(m, worst))


def sticky(items: list[str], members: list[str], previous: dict[str, str], weights: dict[str, float] | None = None) -> dict[str, str]:
    """Keeps owners up to their share of the items (largest remainders), then fills who is furthest below."""
    members = sorted(members)
    total = sum((weights or {}).get(m, 1) for m in members)
    exact = {m: len(items) * (weights or {}).get(m, 1) / total for m in members}
    target = {m: int(exact[m]) for m in members}
    for m in sorted(members, key=lambda m: (target[m] - exact[m], m))[: len(items) - sum(target.values())]:
        target[m] += 1
    out: dict[str, str] = {}
    load = dict.fromkeys(members, 0)
    for i in sorted(items):
        if (m := previous.get(i)) in load and load[m] < target[m]:
            out[i], load[m] = m, load[m] + 1
    for i in sorted(set(items) - set(out)):
        m = min(members, key=lambda m: (load[m] >= target[m], load[m] - target[m], m))
        out[i], load[m] = m, load[m] + 1
    return out


def round_robin(df: DataFrame, members: list[str], by: list[str]) -> DataFrame:
    place = F.pmod(F.col("_n") - 1, F.lit(len(members))).cast("int")
    return numbered(df, by, ["arrival"], "_n").withColumn("member", F.element_at(F.array(*map(F.lit, members)), place + 1)).drop("_n")


def partition_of(key: Column, n: int, explicit: Column | None = None) -> Column:
    """An explicit partition, else by the key's hash, else 0."""
    own = F.coalesce(F.pmod(stable_hash(key), F.lit(n)).cast("int"), F.lit(0))
    own = F.when(key.isNull(), 0).otherwise(own)
    return own if explicit is None else F.coalesce(explicit, own)


# ---- audit ----

GENESIS = "0" * 64


def chain(df: DataFrame, by: list[str], order: str, body: Column) -> DataFrame:
    """Adds content_hash, and prev_hash, the hash of the row before."""
    out = df.withColumn("content_hash", F.sha2(body, 256))
    return beside(out, by, [order], "prev_hash", F.col("content_hash")).withColumn("prev_hash", F.coalesce("prev_hash", F.lit(GENESIS)))


def verify_chain(df: DataFrame, by: list[str], order: str, body: Column) -> DataFrame:
    """For each chain its rows and the index of the first that is broken: by content first, then by its link."""
    rows = numbered(beside(df, by, [order], "_link", F.col("content_hash")), by, [order], "_i").withColumn("_i", F.col("_i") - 1)
    link = F.col("prev_hash") == F.coalesce("_link", F.lit(GENESIS))
    rows = rows.withColumn("_why", F.when(F.sha2(body, 256) != F.col("content_hash"), "content").when(~link, "link"))
    first = F.min(F.when(F.col("_why").isNotNull(), F.struct("_i", "_why")))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), first.alias("b")).select(*by, "n", F.col("b._i").cast("long").alias("broken_at"), F.col("b._why").alias("reason"))


def audit_query(log: DataFrame, topic: str | None = None, publisher: str | None = None, since: int | None = None, until: int | None = None, limit: int | None = None) -> DataFrame:
    """Journal rows by topic, publisher and [since, until); a limit keeps the latest."""
    out = log
    for c in ([F.col("topic") == topic] if topic else []) + ([F.col("publisher_id") == publisher] if publisher else []) + ([F.col("at_ms") >= since] if since is not None else []) + ([F.col("at_ms") < until] if until is not None else []):
        out = out.where(c)
    return out if limit is None else out.orderBy(F.desc("at_ms"), F.desc("arrival")).limit(limit)


def lineage_check(hops: Column, topic: Column, most: int = 32) -> Column:
    """cycle if the topic occurs before the run of itself at the end, else depth if there are too many hops, else null."""
    n = F.size(hops)
    tail = F.aggregate(F.reverse(hops), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, h: F.struct((a.n + (a.on & (h == topic)).cast("int")).alias("n"), (a.on & (h == topic)).alias("on")), lambda a: a.n)
    return F.when(F.exists(F.slice(hops, F.lit(1), n - tail), lambda h: h == topic), "cycle").when(n >= most, "depth")


def append_hop(hops: Column, topic: Column) -> Column:
    return F.array_append(hops, topic)


def tail_sample(spans: DataFrame, interesting: Column, rate: float) -> DataFrame:
    """All spans of traces with an interesting one, and a repeatable share of the others."""
    w = Window.partitionBy("trace_id")
    keep = F.max(interesting).over(w) | (F.pmod(F.xxhash64("trace_id"), F.lit(1_000_000)) < int(rate * 1_000_000))
    return spans.withColumn("_k", keep).where("_k").drop("_k")


def span_depths(spans: DataFrame) -> DataFrame:
    """Each span's depth below its root, by pointers that double: as many rounds as the depth has binary digits.

    Spans whose root is missing, and those in or below a cycle, have none and drop out.
    """
    now = spans.select("trace_id", "span_id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    left = None
    while True:
        now = written(now, "spans")
        rest = now.where("up is not null").count()
        if rest == left or not rest:
            return now.where("up is null").select("trace_id", "span_id", F.col("depth").cast("int").alias("depth"))
        left = rest
        above = now.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("upper"), F.col("depth").alias("more"), F.lit(True).alias("met"))
        now = now.join(above, ["trace_id", "up"], "left").where("up is null or met")
        now = now.select("trace_id", "span_id", F.when(F.col("up").isNotNull(), F.col("upper")).alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))


def trace_query(spans: DataFrame, trace_id: str | None = None, since: int | None = None, until: int | None = None, limit: int | None = None) -> DataFrame:
    """Archived spans by trace and [since, until) of at_ms; a limit keeps the latest."""
    return audit_query(spans if trace_id is None else spans.where(F.col("trace_id") == trace_id), since=since, until=until, limit=limit)


def config_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys whose value was added, removed or changed."""
    both = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), "key", "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("change", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed"))
