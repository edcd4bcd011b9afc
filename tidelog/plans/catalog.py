"""The catalog of queries over the driver's tables, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import crypto, filterexpr, graphql, patterns, scalars
from ..functions.filterexpr import PlainField, compile_filter
from ..operators import analytics as A
from ..operators import bloom, folds
from ..operators import core as C
from ..operators import delivery as D
from ..operators.folds import ordered_fold
from ..sources.events import number, sequenced, to_events, with_payload
from ..streaming import stateful

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
HOUR = 3_600_000
#: events as the canonical relation.
EV = """ev as (select 'events.' || event_type as topic, event_id as arrival, row_number() over (partition by event_type order by event_id) as seq,
 epoch_us(ts) // 1000 as at_ms, cast(user_id as varchar) as key, value, props, json_extract_string(props, '$.k') as message_id from events)"""


def query(sql: str | None = None, ev: bool = True):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = (f"with {EV}{',' if sql.lstrip().startswith('+') else ''} " + sql.lstrip().removeprefix("+")) if ev else sql
        return f

    return add


def events(spark: SparkSession, sf: str) -> DataFrame:
    return to_events(spark, sf)


def log(spark: SparkSession, sf: str) -> DataFrame:
    return sequenced(to_events(spark, sf))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def now_of(df: DataFrame) -> int:
    return df.agg(F.max("at_ms")).first()[0]


def r2(c, name: str):
    return F.round(c, 4).alias(name)


@query("select topic, floor(at_ms / 3600000)::bigint * 3600000 as window_start, count(*) as count, round(sum(value), 4) as value from ev where value > 50 group by 1, 2")
def flagship(spark, sf):
    rows = events(spark, sf).where(patterns.topic_matches(F.col("topic"), "events.*")).where(compile_filter("value > 50", columns={"value": PlainField(F.col("value"), float)}))
    return C.tumbling(rows, "sum", HOUR, ["topic"]).select("topic", "window_start", "count", r2("value", "value"))


# ---- predicates and projections ----
@query("select arrival, topic from ev where regexp_matches(topic, '^events\\.[^.]+$') and (topic like '%.click' or topic like '%.view')")
def topic_match(spark, sf):
    return events(spark, sf).where(patterns.topic_matches(F.col("topic"), "events.*") & patterns.any_matches(F.col("topic"), ["**.click", "events.view"])).select("arrival", "topic")


@query("select arrival, topic from ev where topic <> 'events.error'")
def composite_match(spark, sf):
    return events(spark, sf).where(patterns.composite_matches(F.col("topic"), ["events.**"], ["*.error"])).select("arrival", "topic")


@query("select arrival, value from ev where (value >= 100 and value < 200) or cast(json_extract(props, '$.k') as int) = 7")
def filter_expr_range(spark, sf):
    return with_payload(events(spark, sf)).where(compile_filter("(value >= 100 && value < 200) || props.k == 7")).select("arrival", "value")


@query("select arrival from ev where not regexp_matches(topic, '^events\\.p') or value > 400.5")
def filter_expr_regex(spark, sf):
    cols = {"topic": PlainField(F.col("topic"), str)}
    return with_payload(events(spark, sf)).where(compile_filter("!(topic =~ /^events\\.p/) || value > 400.5", columns=cols)).select("arrival")


def _mixed_payload():
    return F.parse_json(F.when(F.col("arrival") % 7 == 0, "{}").when(F.col("arrival") % 7 == 1, '{"k":null}').when(F.col("arrival") % 7 == 2, '{"k":"5"}').otherwise(F.col("props")))


def mixed(spark, sf):
    return events(spark, sf).withColumn("payload", _mixed_payload())


_MIXED_SQL = "+ m as (select *, case arrival % 7 when 0 then '{}' when 1 then '{\"k\":null}' when 2 then '{\"k\":\"5\"}' else props end as j from ev) "


@query(_MIXED_SQL + "select arrival from m where not coalesce(json_type(j, '$.k') not in ('NULL','VARCHAR') and cast(json_extract_string(j, '$.k') as double) = 5, false)")
def filter_expr_missing_ne(spark, sf):
    return mixed(spark, sf).where(compile_filter("k != 5")).select("arrival")


@query(_MIXED_SQL + "select arrival from m where json_type(j, '$.k') is not null and json_type(j, '$.k') <> 'NULL' or json_type(j, '$.k') = 'NULL'")
def filter_expr_exists(spark, sf):
    return mixed(spark, sf).where(compile_filter("exists(k)")).select("arrival")


@query(_MIXED_SQL + "select arrival, case when at_ms >= 0 and arrival >= 5000 then 2 when arrival >= 1000 then 1 else 0 end as stamp from m where case when arrival >= 5000 then json_type(j, '$.k') = 'NULL' when arrival >= 1000 then coalesce(json_type(j, '$.k') = 'VARCHAR' and json_extract_string(j, '$.k') = '5', false) else true end")
def filter_versions(spark, sf):
    stamp, keep = filterexpr.filter_versions([(1000, 'k == "5"'), (5000, "k == null")], F.col("arrival"))
    return mixed(spark, sf).withColumn("stamp", stamp).where(keep).select("arrival", "stamp")


@query("select o_orderkey as id from orders join customer on c_custkey = o_custkey where c_mktsegment = 'BUILDING' and o_orderstatus <> 'F' and starts_with(o_orderpriority, '1')", ev=False)
def header_eq(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.withColumn("headers", F.create_map(F.lit("tenant"), "c_mktsegment", F.lit("status"), "o_orderstatus", F.lit("p"), "o_orderpriority"))
    return rows.where(filterexpr.header_filter([("tenant", "eq", "BUILDING"), ("status", "ne", "F"), ("p", "prefix", "1")])).select(F.col("o_orderkey").alias("id"))


@query("select arrival, key from ev where key >= '11' and key < '14'")
def key_range(spark, sf):
    return events(spark, sf).where(filterexpr.key_range(F.col("key"), "11", "14")).select("arrival", "key")


@query("select arrival, round(value * 2, 4) as doubled, cast(json_extract(props, '$.k') as int) as k from ev")
def project_payload(spark, sf):
    return events(spark, sf).select("arrival", r2(F.col("value") * 2, "doubled"), F.from_json("props", "k int")["k"].alias("k"))


@query("select c_custkey as id, '***' as name, '***' as segment, c_acctbal as balance from customer", ev=False)
def redact_fields(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.struct(F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_mktsegment").alias("segment")).alias("profile")).alias("user"), F.col("c_acctbal").alias("balance")).alias("p"))
    return C.redact(rows, "p", ["user.name", "user.profile.segment", "user.none"]).select(F.col("c_custkey").alias("id"), "p.user.name", "p.user.profile.segment", "p.balance")


@query("select arrival, topic, row_number() over (partition by topic order by arrival) as seq from ev where value > 20")
def schema_gate_seq(spark, sf):
    return sequenced(events(spark, sf).where("value > 20")).select("arrival", "topic", "seq")


@query("select arrival, case when arrival % 4 = 3 then 'ok' when arrival % 4 = 2 then 'grace' when arrival % 4 = 1 then 'expired' else 'unknown' end as verdict from ev")
def schema_version_gate(spark, sf):
    gate = C.version_gate(F.col("arrival") % 4, 3, {2: 1000, 1: 100}, F.lit(1500), 500)
    return events(spark, sf).select("arrival", gate.alias("verdict"))


@query("select arrival, case arrival % 3 when 0 then (value + 1) * 10 when 1 then value * 10 else value end as migrated from ev")
def schema_migration(spark, sf):
    steps = {(1, 2): lambda c: c + 1, (2, 4): lambda c: c * 10, (1, 3): lambda c: c, (3, 5): lambda c: c, (5, 4): lambda c: c}
    version = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), (F.col("arrival") % 3 + 1).cast("int"))
    migrated = F.col("value")
    for v in (1, 2):
        migrated = F.when(version == v, C.migrate(F.col("value"), v, 4, steps)).otherwise(migrated)
    return events(spark, sf).select("arrival", migrated.alias("migrated"))


@query("select arrival, length(props) as bytes from ev where length(props) <= 8")
def size_gate(spark, sf):
    return events(spark, sf).select("arrival", F.octet_length("props").cast("long").alias("bytes")).where("bytes <= 8")


@query("+ n as (select max(at_ms) as now from ev) select arrival from ev, n where now < least(at_ms + case when topic = 'events.click' then 30 * 86400000::bigint when arrival % 10 = 0 then 90 * 86400000::bigint else 60 * 86400000::bigint end, at_ms + 80 * 86400000::bigint)")
def ttl_filter(spark, sf):
    day = 86_400_000
    rows = C.resolve_rules(events(spark, sf), [("events.*", 60 * day), ("events.click", 30 * day)], "rule")
    ttl = F.when((F.col("arrival") % 10 == 0) & (F.col("topic") != "events.click"), F.lit(90 * day)).otherwise(F.col("rule"))
    return rows.where(C.alive(F.lit(now_of(rows)), F.col("at_ms"), ttl, F.col("at_ms") + 80 * day)).select("arrival")


@query("select topic, case topic when 'events.view' then 3 when 'events.click' then 1 else 2 end as rule, count(*) as n from ev group by all")
def rule_resolution(spark, sf):
    rows = C.resolve_rules(events(spark, sf), [("events.click", 1), ("events.*", 2), ("**", 9), ("events.view", 3)], "rule")
    return rows.groupBy("topic", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("select arrival from ev where topic in ('events.click', 'events.view') and key <> '5' or key = '7'")
def acl_allow(spark, sf):
    rows = events(spark, sf).withColumn("principal", F.col("key"))
    return rows.where(C.acl(rows, [("7", "**", "allow"), ("5", "**", "deny"), ("*", "events.click", "allow"), ("*", "events.view", "allow")])).select("arrival")


@query("select arrival, 'acme/' || replace(topic, 'events.', 'e.') as topic from ev where topic = 'events.error'")
def namespace_alias(spark, sf):
    rows = events(spark, sf).where("topic = 'events.error'")
    return rows.select("arrival", F.concat(F.lit("acme/"), patterns.rename_template(F.col("topic"), "events.*", "e.$1")).alias("topic"))


@query("select arrival, case when topic = 'events.error' then 'acl' when value < 20 then 'schema' when length(props) > 8 then 'size' when arrival % 11 = 0 then 'pressure' end as gate from ev")
def admission_first_gate(spark, sf):
    gates = [("acl", F.col("topic") == "events.error"), ("schema", F.col("value") < 20), ("size", F.octet_length("props") > 8), ("pressure", F.col("arrival") % 11 == 0)]
    return events(spark, sf).select("arrival", C.first_gate(gates).alias("gate"))


@query("select arrival, arrival // 8 as batch, bool_and(value >= 20) over (partition by arrival // 8) as admitted, min(case when value < 20 then arrival % 8 end) over (partition by arrival // 8) as first_refused from ev")
def atomic_batches(spark, sf):
    rows = events(spark, sf).withColumn("batch", F.floor(F.col("arrival") / 8)).withColumn("i", F.col("arrival") % 8).withColumn("refused", F.col("value") < 20)
    return C.atomic(rows, "batch", "i", "refused").select("arrival", "batch", "admitted", "first_refused")


#: stable_hash in SQL.
_HASH = "('0x' || substr(md5({}), 1, 15))::bigint"


@query(f"select arrival, topic from ev where topic = 'events.error' or {_HASH.format('arrival::varchar')} % 1000000 < 200000")
def sampling(spark, sf):
    return events(spark, sf).where(C.sampled(F.col("arrival"), 0.2, F.col("topic") == "events.error")).select("arrival", "topic")


# ---- scans ----
@query("select arrival, seq from ev where topic = 'events.click' and seq > 100")
def scan_since_seq(spark, sf):
    return C.since_seq(log(spark, sf), "events.click", 100).select("arrival", "seq")


@query("select arrival, at_ms from ev where topic = 'events.view' and at_ms > (select min(at_ms) + 864000000 from ev)")
def scan_since_time(spark, sf):
    rows = events(spark, sf)
    return C.since_time(rows, "events.view", rows.agg(F.min("at_ms")).first()[0] + 864_000_000).select("arrival", "at_ms")


@query("select arrival, seq from ev where topic = 'events.view' and seq > 50 order by seq limit 25")
def poll_page(spark, sf):
    return C.poll(log(spark, sf), "events.view", 50, 25).select("arrival", "seq")


@query("+ r as (select *, coalesce(at_ms - lag(at_ms) over (order by seq), 0) / 2.0 as wait_ms from ev where topic = 'events.click' and key in ('3', '12', '40') and key = '12' and seq between 20 and 1500) select arrival, seq, wait_ms from r")
def replay_range_key(spark, sf):
    return C.replay_range(log(spark, sf), "events.click", 20, 1500, "12", 2.0).select("arrival", "seq", "wait_ms")


@query("select arrival, topic from ev qualify row_number() over (partition by topic order by seq desc) <= 7")
def lookback_n(spark, sf):
    return C.lookback(log(spark, sf), 7).select("arrival", "topic")


@query("select topic, max(seq) as seq, max(at_ms) as at_ms, arg_max(value, seq) as value from ev where topic <> 'events.error' group by 1")
def retained_snapshot(spark, sf):
    rows = log(spark, sf).withColumn("value", F.when(F.col("topic") != "events.error", F.col("value")))
    return C.retained(rows).select("topic", "seq", "at_ms", "value")


@query("select topic, seq, arrival from ev where arrival % 13 = 0")
def gap_repair(spark, sf):
    rows = log(spark, sf)
    return C.gap_repair(rows, rows.where("arrival % 13 <> 0")).select("topic", "seq", "arrival")


@query("+ d as (select topic, seq, seq - lag(seq) over (partition by topic order by seq) - 1 as missing from ev where arrival % 13 <> 0) select topic, seq, missing from d where missing > 0")
def seq_gaps(spark, sf):
    return C.sequence_gaps(log(spark, sf).where("arrival % 13 <> 0"), ["topic"]).select("topic", "seq", "missing")


@query("select count(*) as pending, (select max(at_ms) from ev) - min(at_ms) as oldest_ms from ev where topic = 'events.purchase' and seq > 300")
def outbox_lag(spark, sf):
    rows = log(spark, sf)
    return C.outbox_lag(rows.where("topic = 'events.purchase'"), 300, now_of(rows))


@query("select arrival, at_ms + (arrival % 5) * 3600000 as deliver_at from ev where at_ms + (arrival % 5) * 3600000 <= (select min(at_ms) + 1000000000 from ev)")
def delayed_due(spark, sf):
    rows = events(spark, sf).withColumn("deliver_at", F.col("at_ms") + (F.col("arrival") % 5) * HOUR)
    return C.due(rows, rows.agg(F.min("at_ms")).first()[0] + 1_000_000_000).select("arrival", "deliver_at")


@query("select topic, count(*) as pending, min(at_ms + (arrival % 5) * 3600000) as next_due from ev group by 1")
def delayed_stats(spark, sf):
    return events(spark, sf).groupBy("topic").agg(F.count(F.lit(1)).alias("pending"), F.min(F.col("at_ms") + (F.col("arrival") % 5) * HOUR).alias("next_due"))


# ---- state ----
_LATEST = "select topic, key, arg_max(value, seq) as value, max(seq) as seq, count(*) as version from ev where key is not null {} group by 1, 2"


@query(_LATEST.format(""))
def ktable_latest(spark, sf):
    return C.ktable(log(spark, sf))


@query(_LATEST.format("and starts_with(key, '1')"))
def ktable_scan_prefix(spark, sf):
    return C.ktable(log(spark, sf), prefix="1")


@query("select arrival, lag(value) over w as old_value, value as new_value, row_number() over w as version from ev window w as (partition by topic, key order by seq)")
def changelog(spark, sf):
    return C.changelog(log(spark, sf)).select("arrival", "old_value", F.col("value").alias("new_value"), "version")


@query("+ k as (select *, case when arrival % 9 <> 0 then key end as k2 from ev), r as (select *, row_number() over (partition by topic, k2 order by seq desc) as n from k) select arrival, topic, k2 as key from r where k2 is not null and n = 1 or k2 is null and n <= 20")
def keyed_compaction(spark, sf):
    rows = log(spark, sf).withColumn("key", F.when(F.col("arrival") % 9 != 0, F.col("key")))
    return C.compact(rows, 20).select("arrival", "topic", "key")


@query("+ l as (select * from ev qualify row_number() over (partition by topic, key order by seq desc) = 1) select topic, key, at_ms < (select max(at_ms) from ev) - 604800000 as tombstone, case when at_ms < (select max(at_ms) from ev) - 604800000 then 0 else seq end as seq from l")
def key_ttl(spark, sf):
    rows = log(spark, sf)
    return C.key_ttl(C.compact(rows), now_of(rows), 604_800_000).select("topic", "key", "tombstone", "seq")


@query("select arrival from ev where at_ms >= (select max(at_ms) from ev) - 864000000 qualify row_number() over (partition by topic order by seq desc) <= 100")
def retention_age(spark, sf):
    rows = log(spark, sf)
    return C.retain(rows, now_of(rows) - 864_000_000, 100).select("arrival")


@query()
def retention_bytes(spark, sf):
    rows = log(spark, sf).select("topic", "arrival", F.expr("1 + pmod(arrival * 37, 101)").alias("bytes"), (-F.col("seq")).alias("newest"))
    return ordered_fold(rows, ["topic"], ["newest"], lambda: folds.GreedyBytes(5000), "topic string, arrival long, bytes long, kept boolean").where("kept").select("arrival", "bytes")


@query()
def store_bounded(spark, sf):
    return ordered_fold(log(spark, sf).select("topic", "key", "value", "seq"), ["topic"], ["seq"], lambda: folds.BoundedStore(40), "topic string, key string, value double, seq long, version long")


@query()
def compare_and_set(spark, sf):
    rows = log(spark, sf).select("topic", "key", "arrival", F.col("value").cast("string").alias("value"), F.when(F.col("arrival") % 3 != 0, F.floor(F.col("arrival") / 2500)).cast("long").alias("expected_version"), F.lit(None).cast("string").alias("expected_value"))
    return ordered_fold(rows, ["topic", "key"], ["arrival"], folds.CompareAndSet, "topic string, key string, arrival long, applied boolean, version long")


# ---- windows ----
def _tumble(kind: str, sql: str):
    def f(spark, sf):
        return C.tumbling(log(spark, sf), kind, 6 * HOUR, ["topic"]).select("topic", "window_start", "window_end", "count", "value" if kind == "concat" else F.round("value", 9).alias("value"))

    f.__name__ = f"tumbling_{kind}"
    query(f"select topic, at_ms // 21600000 * 21600000 as window_start, at_ms // 21600000 * 21600000 + 21600000 as window_end, count(*) as count, {sql} as value from ev group by 1, 2, 3")(f)


for _kind, _sql in {
    "count": "count(*)::double", "sum": "round(sum(value), 9)", "avg": "round(avg(value), 9)", "min": "min(value)", "max": "max(value)", "last": "arg_max(value, arrival)",
    "concat": "string_agg(case when value = floor(value) then cast(value::bigint as varchar) else cast(value as varchar) end, '' order by arrival)",
}.items():
    _tumble(_kind, _sql)

_SESS = "+ s as (select *, case when at_ms - lag(at_ms) over (partition by key order by at_ms, arrival) >= 28800000 then 1 else 0 end as n from ev), t as (select *, sum(n) over (partition by key order by at_ms, arrival) as session from s) select key, min(at_ms) as session_start, max(at_ms) as session_end, count(*) as count, {} as value from t group by key, session"


@query(_SESS.format("count(*)::double"))
def session_count(spark, sf):
    return C.sessions(events(spark, sf), 8 * HOUR)


@query(_SESS.format("round(sum(value), 4)"))
def session_sum(spark, sf):
    return C.sessions(events(spark, sf), 8 * HOUR, "sum").select("key", "session_start", "session_end", "count", r2("value", "value"))


@query("select topic, at_ms // 3600000 * 3600000 - k * 3600000 as window_start, count(*) as count from ev, range(4) r(k) group by 1, 2")
def hopping_count(spark, sf):
    return C.hopping(events(spark, sf), 4 * HOUR, HOUR, ["topic"])


def disordered(spark, sf):
    """Arrivals out of event-time order."""
    order = F.col("arrival") + F.pmod(F.col("arrival") * 37, F.lit(31))
    return events(spark, sf).withColumn("order", order * 100_000_000 + F.col("arrival"))


_DIS = "+ d as (select *, (arrival + (arrival * 37) % 31) * 100000000 + arrival as o from ev), w as (select *, max(at_ms) over (partition by topic order by o rows between unbounded preceding and 1 preceding) - 3600000 as wm from d) "


@query(_DIS + "select arrival, topic, wm as watermark, coalesce(at_ms < wm, false) as late from w")
def watermark_late(spark, sf):
    return C.watermarked(disordered(spark, sf), HOUR, "order", width=100_000_000 << 20).select("arrival", "topic", "watermark", "late")


@query("+ i as (select *, lead(at_ms) over (partition by topic order by arrival) as next_at_ms from ev) select arrival, topic, next_at_ms from i where next_at_ms - at_ms >= 3600000")
def watermark_idle(spark, sf):
    return C.idle_advances(events(spark, sf), HOUR).select("arrival", "topic", "next_at_ms")


@query()
def event_time_release(spark, sf):
    rows = disordered(spark, sf).select("topic", "order", "arrival", "event_time_ms")
    return C.released(rows, HOUR, "order", width=100_000_000 << 20).select("topic", "arrival", "event_time_ms", "released")


# ---- joins ----
def _sides(spark, sf):
    rows = events(spark, sf).select("topic", "arrival", "key", F.col("at_ms").alias("ts"), F.col("at_ms").alias("now"))
    return rows.where("topic = 'events.view'"), rows.where("topic = 'events.purchase'")


_PAIRS = "l as (select * from ev where topic = 'events.view'), r as (select * from ev where topic = 'events.purchase'), p as (select l.key, l.arrival as l_arrival, r.arrival as r_arrival, l.at_ms as l_ts, r.at_ms as r_ts, greatest(l.at_ms, r.at_ms) - 86400000 as window_start from l join r on l.key = r.key and (r.arrival < l.arrival and r.at_ms between l.at_ms - 86400000 and l.at_ms or l.arrival < r.arrival and l.at_ms between r.at_ms - 86400000 and r.at_ms))"


@query(f"+ {_PAIRS} select * from p")
def stream_join_inner(spark, sf):
    return C.stream_join(*_sides(spark, sf), 24 * HOUR)


@query(f"+ {_PAIRS} select * from p union all select key, arrival, null, at_ms, null, at_ms - 86400000 from l where not exists (select 1 from p where p.l_arrival = l.arrival and p.r_arrival < l.arrival)")
def stream_join_left(spark, sf):
    return C.stream_join(*_sides(spark, sf), 24 * HOUR, "left")


@query(f"+ {_PAIRS} select p.* from p where case when r_arrival < l_arrival then (select count(*) from r where r.key = p.key and r.arrival > p.r_arrival and r.arrival < p.l_arrival) else (select count(*) from l where l.key = p.key and l.arrival > p.l_arrival and l.arrival < p.r_arrival) end < 1")
def stream_join_bounded(spark, sf):
    return C.stream_join(*_sides(spark, sf), 24 * HOUR, max_buffered=1)


def _late_sides(spark, sf):
    """Rows that come up to 30 hours after their time."""
    return [side.withColumn("now", F.col("ts") + F.pmod(F.col("arrival") * 37, F.lit(31)) * HOUR) for side in _sides(spark, sf)]


_LATE = "n as (select *, at_ms + (arrival * 37) % 31 * 3600000 as now from ev where topic in ('events.view', 'events.purchase')), k as (select * from n where at_ms >= now - 86400000), l as (select * from k where topic = 'events.view'), r as (select * from k where topic = 'events.purchase')"


@query(f"+ {_LATE} select topic, count(*) as late from n where at_ms < now - 86400000 group by 1")
def join_late_counts(spark, sf):
    left, right = _late_sides(spark, sf)
    return left.unionByName(right).where(C.join_late(24 * HOUR)).groupBy("topic").agg(F.count(F.lit(1)).alias("late"))


@query(f"+ {_LATE} select l.key, l.arrival as l_arrival, r.arrival as r_arrival, l.at_ms as l_ts, r.at_ms as r_ts, greatest(l.at_ms, r.at_ms) - 86400000 as window_start from l join r on l.key = r.key and (r.arrival < l.arrival and r.at_ms between l.at_ms - 86400000 and l.at_ms and r.at_ms >= l.now - 86400000 or l.arrival < r.arrival and l.at_ms between r.at_ms - 86400000 and r.at_ms and l.at_ms >= r.now - 86400000)")
def stream_join_late(spark, sf):
    return C.stream_join(*_late_sides(spark, sf), 24 * HOUR)


@query(f"+ {_PAIRS} select p.* from p where case when r_arrival < l_arrival then (select count(*) from r where r.key = p.key and r.arrival > p.r_arrival and r.arrival < p.l_arrival) else (select count(*) from l where l.key = p.key and l.arrival > p.l_arrival and l.arrival < p.r_arrival) end < 3")
def stream_join_bounded_three(spark, sf):
    return C.stream_join(*_sides(spark, sf), 24 * HOUR, max_buffered=3)


@query("select arrival, topic, null::varchar as routed_from from ev union all select arrival, 'alerts', topic from ev where topic = 'events.error' and value > 100 union all select arrival, 'money', topic from ev where topic = 'events.purchase'")
def route_forward(spark, sf):
    return C.route(events(spark, sf), [("events.error", "alerts", F.col("value") > 100), ("*.purchase", "money", None), ("events.view", "events.view", None)]).select("arrival", "topic", "routed_from")


@query("+ h as (select *, row(at_ms - (arrival * 37) % 20000000, arrival % 3, 'n' || (arrival % 2)) as c from ev), m as (select *, max(c) over (partition by topic, key order by arrival rows between unbounded preceding and 1 preceding) as b from h) select arrival from m where b is null or c > b")
def hlc_lww(spark, sf):
    clock = scalars.hlc(F.col("at_ms") - F.pmod(F.col("arrival") * 37, F.lit(20_000_000)), F.col("arrival") % 3, F.concat(F.lit("n"), (F.col("arrival") % 2).cast("string")))
    return C.last_writer_wins(events(spark, sf).withColumn("hlc", clock)).select("arrival")


_RPC = "+ q as (select arrival as correlation_id, at_ms from ev where topic = 'events.click'), a as (select arrival - 1 - arrival % 3 as correlation_id, at_ms from ev where topic = 'events.view') , j as (select q.correlation_id, q.at_ms, min(case when a.at_ms between q.at_ms and q.at_ms + 1200000 then a.at_ms end) as reply_ms from q left join a using (correlation_id) group by 1, 2) "


def _rpc(spark, sf):
    rows = events(spark, sf)
    asked = rows.where("topic = 'events.click'").select(F.col("arrival").alias("correlation_id"), "at_ms")
    return C.correlate(asked, rows.where("topic = 'events.view'").select((F.col("arrival") - 1 - F.col("arrival") % 3).alias("correlation_id"), "at_ms"), 1_200_000)


@query(_RPC + "select correlation_id, at_ms, reply_ms from j where reply_ms is not null")
def rpc_match(spark, sf):
    return _rpc(spark, sf).where("not timed_out").drop("timed_out")


@query(_RPC + "select correlation_id from j where reply_ms is null")
def rpc_timeout(spark, sf):
    return _rpc(spark, sf).where("timed_out").select("correlation_id")


# ---- topic algebra ----
@query("select arrival, row_number() over (order by seq) as seq, seq as old_seq from ev where topic = 'events.click' and seq > 40")
def topic_fork(spark, sf):
    return C.fork(log(spark, sf), "events.click", "copy", from_seq=40).select("arrival", "seq", "old_seq")


@query("+ l as (select * from ev where topic = 'events.click' qualify row_number() over (partition by key order by seq desc) = 1) select arrival, key, row_number() over (order by seq) as seq from l")
def topic_fork_keyed_latest(spark, sf):
    return C.fork(log(spark, sf), "events.click", "copy", keyed_latest=True).select("arrival", "key", "seq")


@query("select arrival, topic as source, row_number() over (order by at_ms, case topic when 'events.view' then 0 else 1 end, seq) as seq from ev where topic in ('events.view', 'events.error')")
def topic_merge(spark, sf):
    return C.merge(log(spark, sf), "events.view", "events.error", "both").select("arrival", "source", "seq")


@query("select arrival, case when value > 250 then 'dear' else 'cheap' end as topic, row_number() over (partition by value > 250 order by seq) as seq from ev where topic = 'events.purchase'")
def topic_split(spark, sf):
    return C.split(log(spark, sf), "events.purchase", F.col("value") > 250, "dear", "cheap").select("arrival", "topic", "seq")


# ---- folds ----
_ROW = "topic string, message_id string, arrival long, at_ms long, admitted boolean"
_DEDUP = """+ o as (select *, row_number() over (partition by {0} order by arrival) as n from ev), d(ident, n, kept, admitted, arrival) as (
 select {1}, n, at_ms, true, arrival from o where n = 1 union all
 select d.ident, o.n, case when o.at_ms - d.kept >= 259200000 then o.at_ms else d.kept end, o.at_ms - d.kept >= 259200000, o.arrival from d join o on {1} = d.ident and o.n = d.n + 1) select arrival from d where admitted"""


@query(_DEDUP.format("topic, message_id", "topic || '/' || message_id"))
def dedup_idempotent(spark, sf):
    rows = events(spark, sf).select("topic", "message_id", "arrival", "at_ms")
    return ordered_fold(rows, ["topic", "message_id"], ["arrival"], lambda: folds.Dedup(72 * HOUR), _ROW).where("admitted").select("arrival")


@query(_DEDUP.format("topic, props", "topic || '/' || props"))
def dedup_content(spark, sf):
    rows = events(spark, sf).select("topic", F.sha2("props", 256).alias("message_id"), "arrival", "at_ms")
    return ordered_fold(rows, ["topic", "message_id"], ["arrival"], lambda: folds.Dedup(72 * HOUR), _ROW).where("admitted").select("arrival")


for _name in ("dedup_idempotent", "dedup_content"):
    _SQL[_name] = _SQL[_name].replace("with ev", "with recursive ev", 1)


def fold_sql(rows: str, first: str, then: str, out: str, lets: str = "o.*, d.*") -> str:
    """A fold in SQL. rows: k, n, arrival and what steps need; first and then: the state after the first and after each
    further row, the latter over (o.*, d's state, lets); out: what is selected of the states d."""
    return (f"with recursive {EV}, o as materialized ({rows}), d as (select {first} from o where n = 1 union all select {then} from (select {lets} from d join o on o.k = d.k_ and o.n = d.n_ + 1)) {out}")


def _by(key: str, more: str = "") -> str:
    return f"select {key} as k, row_number() over (partition by {key} order by arrival) as n, arrival, at_ms, topic, key as own{more} from ev"


def _bucket_sql(key: str, rate: float, burst: float, cap: str | None = None) -> str:
    r, b = f"'{rate!r}'::double", f"'{burst!r}'::double"
    return fold_sql(
        _by(key), f"k as k_, n as n_, arrival, {b} - 1 as tokens, at_ms as last, true as admitted", "k as k_, n as n_, arrival, t - (t >= 1)::int as tokens, greatest(last, at_ms) as last, t >= 1 as admitted",
        "select arrival, admitted from d", f"o.*, d.last, least({b}, d.tokens + greatest(o.at_ms - d.last, 0) * {r} / 1000) as t",
    )


def sql_of(name: str, sql: str) -> None:
    _SQL[name] = sql


def _limited(by: str, rate: float, burst: float):
    def f(spark, sf):
        keys = {"publisher": F.col("key"), "namespace": F.substring("topic", 1, 8), "everything": F.lit(0)}
        rows = events(spark, sf).select(keys.get(by, F.col(by) if by in ("topic", "key") else None).alias("bucket"), "arrival", "at_ms")
        return ordered_fold(rows, ["bucket"], ["arrival"], lambda: folds.TokenBucket(rate, burst), "arrival long, admitted boolean")

    return f


for _name, _by_sql, _key, _rate, _burst in (
    ("topic", "topic", "topic", 1 / 3600, 5.0), ("key", "key", "key", 1 / 43200, 2.0), ("publisher", "key", "publisher", 1 / 86400, 3.0),
    ("namespace", "substr(topic, 1, 8)", "namespace", 1 / 1800, 4.0), ("global", "1", "everything", 1 / 900, 10.0),
):
    _f = _limited(_key, _rate, _burst)
    _f.__name__ = f"rate_limit_{_name}"
    query()(_f)
    sql_of(_f.__name__, _bucket_sql(_by_sql, _rate, _burst))


@query()
def sliding_limit(spark, sf):
    rows = events(spark, sf).select("topic", "arrival", "at_ms")
    return ordered_fold(rows, ["topic"], ["arrival"], lambda: folds.SlidingLimit(10, 12 * HOUR), "topic string, arrival long, at_ms long, admitted boolean").where("admitted").select("arrival")


def _sequences(spark, sf, names: dict[str, str], steps, within: int):
    met = F.array_compact(F.array(*[F.when(F.col("topic") == t, n) for n, t in names.items()]))
    rows = events(spark, sf).select("key", "arrival", "at_ms", met.alias("steps")).where("size(steps) > 0")
    out = ordered_fold(rows, ["key"], ["arrival"], lambda: folds.Sequence(steps, within), "key string, start_ms long, at_ms long, duration_ms long, events array<long>")
    return out.select("key", "start_ms", "at_ms", "duration_ms", F.array_join(F.col("events").cast("array<string>"), ",").alias("events"))


@query("+ m as (select a.key, a.at_ms as start_ms, a.arrival as x, min(b.arrival) as y from ev a join ev b on a.key = b.key and b.arrival > a.arrival and b.topic = 'events.purchase' and b.at_ms <= a.at_ms + 86400000 where a.topic = 'events.view' group by 1, 2, 3) select m.key, start_ms, ev.at_ms, ev.at_ms - start_ms as duration_ms, x || ',' || y as events from m join ev on arrival = y")
def cep_two_step(spark, sf):
    return _sequences(spark, sf, {"a": "events.view", "b": "events.purchase"}, [("a", None), ("b", None)], 24 * HOUR)


@query("""+ m as (select a.key, a.at_ms as start_ms, a.arrival as x, min(b.arrival) as y from ev a join ev b on a.key = b.key and b.arrival > a.arrival and b.topic = 'events.click' and b.at_ms <= a.at_ms + 172800000 where a.topic = 'events.view' group by 1, 2, 3),
 n as (select m.key, start_ms, x, y, min(c.arrival) as z from m join ev c on m.key = c.key and c.arrival > y and c.topic = 'events.purchase' and c.at_ms <= start_ms + 172800000 group by 1, 2, 3, 4) select n.key, start_ms, ev.at_ms, ev.at_ms - start_ms as duration_ms, x || ',' || y || ',' || z as events from n join ev on arrival = z""")
def cep_three_step(spark, sf):
    return _sequences(spark, sf, {"a": "events.view", "b": "events.click", "c": "events.purchase"}, [("a", None), ("b", None), ("c", None)], 48 * HOUR)


@query("select key, at_ms as start_ms, at_ms + 43200000 as at_ms, 43200000::bigint as duration_ms, cast(arrival as varchar) as events from ev a where topic = 'events.signup' and not exists (select 1 from ev b where b.key = a.key and b.topic = 'events.purchase' and b.arrival > a.arrival and b.at_ms < a.at_ms + 43200000)")
def cep_absence(spark, sf):
    return _sequences(spark, sf, {"a": "events.signup", "b": "events.purchase"}, [("a", None), ("b", 12 * HOUR)], 24 * HOUR)


@query()
def failure_regime(spark, sf):
    rows = events(spark, sf).select("key", "topic", "arrival", (F.pmod(F.floor(F.col("arrival") / 1000), F.lit(3)) * 3 > F.pmod(F.col("arrival") * 7919, F.lit(10))).cast("int").alias("failed"))
    return ordered_fold(rows, ["topic"], ["arrival"], folds.Regime, "topic string, arrival long, direction string, mean_before double, score double")


@query()
def partition_health(spark, sf):
    rows = events(spark, sf).select((F.col("arrival") % 4).alias("p"), "arrival", "at_ms", (F.pmod(F.floor(F.col("arrival") / 300), F.lit(3)) == 0).alias("failed"))
    return ordered_fold(rows, ["p"], ["arrival"], lambda: folds.PartitionHealth(cooldown_ms=HOUR), "p long, arrival long, at_ms long, failed boolean, healthy boolean").select("p", "arrival", "healthy")


@query("select key as source, rn - 1 as clock, arrival from (select *, row_number() over (partition by key order by arrival) as rn from ev)")
def causal_order(spark, sf):
    w = Window.partitionBy("key").orderBy("arrival")
    rows = events(spark, sf).select(F.col("key").alias("source"), (F.row_number().over(w) - 1).cast("long").alias("clock"), "arrival")
    shuffled = rows.withColumn("o", F.col("arrival") - 200 * (F.col("arrival") % 3))
    return ordered_fold(shuffled, ["source"], ["o"], folds.Causal, "source string, clock long, arrival long")


@query()
def json_patches(spark, sf):
    w = Window.partitionBy("key").orderBy("arrival")
    rows = events(spark, sf).select("key", "arrival", F.row_number().over(w).cast("long").alias("n"), F.col("value").cast("string").alias("v"))
    rows = rows.withColumn("version", F.when(F.col("n") % 17 == 5, F.col("n") + 1).otherwise(F.col("n")))
    full = F.col("n") % 10 == 1
    rows = rows.withColumn("value", F.when(full, F.concat(F.lit('{"v":'), "v", F.lit("}")))).withColumn("ops", F.when(~full, F.concat(F.lit('[{"op":"replace","path":"/v","value":'), "v", F.lit("}]"))))
    return ordered_fold(rows, ["key"], ["arrival"], folds.Patches, "key string, arrival long, verdict string, version long, doc string")


# ---- order ----
def _lane():
    return F.when(F.col("o_orderpriority").substr(1, 1).isin("1", "2"), "urgent").when(F.col("o_orderpriority").startswith("3"), "normal").otherwise("bulk")
_LANE_SQL = "case when o_orderpriority[1] in ('1', '2') then 'urgent' when o_orderpriority[1] = '3' then 'normal' else 'bulk' end"


def _orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("arrival"), F.col("o_custkey").alias("customer"), _lane().alias("lane"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") * 7919 % 100_003).alias("deadline_ms"))


@query(f"select o_orderkey as arrival, row_number() over (partition by o_custkey order by case {_LANE_SQL} when 'urgent' then 0 when 'normal' then 1 else 2 end, case when o_orderkey % 3 = 0 then o_orderkey * 7919 % 100003 end nulls last, o_orderkey) as place from orders", ev=False)
def edf_order(spark, sf):
    rows = _orders(spark, sf)
    return rows.select("arrival", F.row_number().over(Window.partitionBy("customer").orderBy(*A.edf_order(rows))).cast("long").alias("place"))


@query(f"with l as (select o_orderkey as arrival, o_custkey, {_LANE_SQL} as lane from orders), r as (select *, row_number() over (partition by o_custkey, lane order by arrival) as rn from l) select arrival, lane, ceil(rn / case lane when 'urgent' then 8 when 'normal' then 2 else 1 end)::bigint as round from r", ev=False)
def lane_order(spark, sf):
    return A.lane_order(_orders(spark, sf), ["customer"]).select("arrival", "lane", F.col("round").cast("long").alias("round"))


@query("+ f as (select *, min(arrival) over (partition by topic) as first from ev) select arrival, ceil(seq / 2.0)::bigint as round from f")
def drr_order(spark, sf):
    return A.fair_order(events(spark, sf), 2).select("arrival", F.col("round").cast("long").alias("round"))


@query("+ b as (select *, topic = 'events.signup' as bar from ev), e as (select *, coalesce(sum(bar::int) over (partition by key order by arrival rows between unbounded preceding and 1 preceding), 0)::bigint as epoch from b) select arrival, epoch from e where not bar")
def barrier_epochs(spark, sf):
    return A.barrier_epochs(events(spark, sf), F.col("topic") == "events.signup", ["key"]).select("arrival", "epoch")


@query("select topic, ceil(seq / 50.0)::bigint as batch, count(*) as n, min(arrival) as first from ev group by 1, 2")
def micro_batches(spark, sf):
    return A.micro_batches(events(spark, sf), 50, ["topic"]).groupBy("topic", F.col("batch").cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("arrival").alias("first"))


@query("select arrival, 'oldest' as policy from ev qualify row_number() over (partition by key order by arrival desc) <= 5 union all (select arrival, 'newest' from ev qualify row_number() over (partition by key order by arrival) <= 5)")
def queue_policies(spark, sf):
    rows = events(spark, sf)
    keep = lambda p: A.bounded_queue(rows, 5, f"drop-{p}", ["key"]).select("arrival", F.lit(p).alias("policy"))
    return keep("oldest").unionByName(keep("newest"))


# ---- metrics ----
@query("+ n as (select max(at_ms) as now from ev) select topic, count(*) filter (at_ms >= now - 86400000) / 86400.0 as r1d, count(*) filter (at_ms >= now - 604800000) / 604800.0 as r7d from ev, n group by 1")
def publish_rates(spark, sf):
    rows = events(spark, sf)
    return A.rates(rows, now_of(rows), {"r1d": 86_400_000, "r7d": 604_800_000})


@query("+ n as (select max(at_ms) as now from ev) select topic, round(count(*) filter (at_ms >= now - 604800000) / 604800.0, 9) as rate from ev, n group by 1 having count(*) filter (at_ms >= now - 604800000) > 0 order by rate desc, topic limit 3")
def hot_topics(spark, sf):
    rows = events(spark, sf)
    return A.top(A.rates(rows, now_of(rows), {"rate": 604_800_000}), "rate", "topic", 3).select("topic", F.round("rate", 9).alias("rate"))


@query("+ l as (select topic, greatest(value - 20, 0) as v from ev qualify row_number() over (partition by topic order by arrival desc) <= 1024) select topic, count(*) as n, round(min(v), 4) as min, round(max(v), 4) as max, round(avg(v), 6) as mean, round(quantile_disc(v, 0.5), 4) as p50, round(quantile_disc(v, 0.95), 4) as p95, round(quantile_disc(v, 0.99), 4) as p99 from l group by 1")
def latency_summary(spark, sf):
    got = A.summary(events(spark, sf).withColumn("ms", F.col("value") - 20), ["topic"], "ms", "arrival")
    return got.select("topic", "n", r2("min", "min"), r2("max", "max"), F.round("mean", 6).alias("mean"), *[r2(c, c) for c in ("p50", "p95", "p99")])


@query("+ b as (select topic, count(*) as count, round(sum(value), 2) as sum, count(*) filter (value <= 100) as le_100, count(*) filter (value <= 250) as le_250, count(*) filter (value <= 500) as le_500 from ev group by 1) select *, case when le_100 >= ceil(.5 * count) then 100 when le_250 >= ceil(.5 * count) then 250 when le_500 >= ceil(.5 * count) then 500 end::bigint as p50, case when le_100 >= ceil(.99 * count) then 100 when le_250 >= ceil(.99 * count) then 250 when le_500 >= ceil(.99 * count) then 500 end::bigint as p99 from b")
def payload_histogram(spark, sf):
    return A.histogram(events(spark, sf), F.col("value"), [100, 250, 500], ["topic"]).withColumn("sum", F.round("sum", 2))


@query()
def quantiles_tdigest(spark, sf):
    return events(spark, sf).groupBy("topic").agg(F.percentile_approx("value", [0.5, 0.95, 0.99], 1000).alias("q")).select("topic", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"))


@query("+ c as (select topic, max(seq) as committed from ev where arrival <= 800 group by 1) select topic, max(seq) as assigned, coalesce(any_value(committed), 0) as committed, max(seq) - coalesce(any_value(committed), 0) as lag, max(seq) - coalesce(any_value(committed), 0) > 30 as over from ev left join c using (topic) group by 1")
def group_lag(spark, sf):
    rows = log(spark, sf)
    return A.group_lag(rows, rows.where("arrival <= 800"), ["topic"], 30)


@query("+ c as (select topic, arrival, value > 100 as ok, sum(case when value > 100 then 0 else 1 end) over (partition by topic order by arrival) as g from ev) select arrival from c qualify ok and sum(ok::int) over (partition by topic, g order by arrival) = 3")
def lag_slo_runs(spark, sf):
    return A.runs(events(spark, sf), ["topic"], "arrival", F.col("value") > 100).where("run = 3").select("arrival")


@query("select arrival from (select arrival, value > 300 as c, lag(value > 300) over (partition by topic order by arrival) as p from ev) where c and not coalesce(p, false)")
def lag_threshold_edges(spark, sf):
    return A.edges(events(spark, sf), ["topic"], "arrival", F.col("value") > 300).select("arrival")


@query("+ s as (select topic, seq::double as t, seq * 2 + (arrival * 37) % 5 as lag from ev qualify row_number() over (partition by topic order by seq desc) <= 64) select topic, count(*) as n, round(regr_slope(lag, t), 4) as slope, round(regr_r2(lag, t), 4) as r2, round(greatest((1e7 - regr_intercept(lag, t)) / regr_slope(lag, t) - max(t), 0), 0) as eta from s group by 1")
def lag_forecast(spark, sf):
    rows = log(spark, sf).select("topic", F.col("seq").cast("double").alias("t"), (F.col("seq") * 2 + (F.col("arrival") * 37) % 5).cast("double").alias("lag"))
    return A.forecast(rows, ["topic"], "t", "lag", 1e7).select("topic", "n", r2("slope", "slope"), r2("r2", "r2"), F.round("eta", 0).alias("eta"))


@query("""+ p as (select key, case when arg_max(topic, arrival) <> 'events.error' then max(value) end as p99, case when any_value(key)::int % 10 > 0 then min(value) end as wm, case when any_value(key)::int % 7 > 0 then count(*) end as rate from ev group by 1),
 r as (select key, case when coalesce(p99, wm) is null then 'no-data' when coalesce(p99, wm) > 450 then case when rate is null then 'no-rate-data' when rate >= 64 then 'lag-above-threshold' else 'lag-high-rate-dropping' end
 when p99 <= 440 and coalesce(wm, 0) <= 440 and rate < 70 then 'drained-idle' else 'lag-normal' end as reason from p) select key, reason, case reason when 'lag-above-threshold' then 'scale_up' when 'drained-idle' then 'scale_down' else 'hold' end as signal from r""")
def autoscale_signal(spark, sf):
    per = events(spark, sf).groupBy("key").agg(F.max("value").alias("m"), F.min("value").alias("w"), F.count(F.lit(1)).alias("n"), F.max_by("topic", "arrival").alias("last"))
    p99, watermark = F.when(F.col("last") != "events.error", F.col("m")), F.when(F.col("key").cast("int") % 10 > 0, F.col("w"))
    reason = A.scaling_reason(p99, watermark, F.when(F.col("key").cast("int") % 7 > 0, F.col("n")), 450, 64, 440, 70)
    return per.select("key", reason.alias("reason"), A.scaling_signal(reason).alias("signal"))


@query("select * from (values (1, 'no-data', 'hold'), (2, 'lag-normal', 'hold'), (3, 'no-rate-data', 'hold'), (4, 'lag-above-threshold', 'scale_up'), (5, 'lag-high-rate-dropping', 'hold'), (6, 'drained-idle', 'scale_down'), (7, 'lag-normal', 'hold'), (8, 'lag-normal', 'hold'), (9, 'lag-normal', 'hold'), (10, 'lag-above-threshold', 'scale_up')) t(id, reason, signal)", ev=False)
def autoscale_boundaries(spark, sf):
    """Lag at the threshold is normal, a rate at the idle rate isn't idle, a bare watermark counts but never shrinks."""
    rows = [(1, None, None, 5.0), (2, 1000.0, 0.0, 5.0), (3, 1001.0, 0.0, None), (4, 1001.0, 0.0, 1.0), (5, 1001.0, 0.0, 0.9), (6, 10.0, 10.0, 0.09), (7, 10.0, 10.0, 0.1), (8, 10.0, 11.0, 0.0), (9, None, 5.0, 0.0), (10, None, 1001.0, 2.0)]
    df = spark.createDataFrame(rows, "id int, p99 double, wm double, rate double")
    reason = A.scaling_reason(F.col("p99"), F.col("wm"), F.col("rate"))
    return df.select("id", reason.alias("reason"), A.scaling_signal(reason).alias("signal"))


_CHECKS = "c as (select substr(topic, 8) as name, case when max(value) > 490 and substr(topic, 8) = 'click' then 'fail' when avg(value) > 0 and topic < 'events.p' then 'warn' else 'ok' end as verdict from ev group by topic)"


def _checks(spark, sf):
    per = events(spark, sf).groupBy("topic").agg(F.max("value").alias("m"), F.avg("value").alias("a"))
    verdict = F.when((F.col("m") > 490) & (F.col("topic") == "events.click"), "fail").when((F.col("a") > 0) & (F.col("topic") < "events.p"), "warn").otherwise("ok")
    return per.select(F.substring("topic", 8, 99).alias("check"), verdict.alias("verdict"))


@query(f"+ {_CHECKS} select case when bool_or(verdict = 'fail') then 'critical' when bool_or(verdict = 'warn') then 'degraded' else 'healthy' end as health from c")
def doctor(spark, sf):
    return A.diagnose(_checks(spark, sf))


@query("""+ d as (select 0 as reach, 'resume-subscriber' as kind, key as target from ev where topic = 'events.error' group by key having count(*) >= 2 and key::int % 3 <> 0),
 l as (select 1, 'prune-linger-windows', topic from ev where value > 490 group by topic), s as (select 2, 'rebalance-group', topic from ev group by topic having count(distinct key) < 1000000),
 p as (select *, row_number() over (order by reach, target) as place from (select * from d union all select * from l union all select * from s)) select kind, target, place from p where place <= 100""")
def remediation_plan(spark, sf):
    rows = events(spark, sf)
    degraded = rows.where("topic = 'events.error'").groupBy(F.col("key").alias("subscriber_id")).agg(F.count(F.lit(1)).alias("consecutive_failures")).where("consecutive_failures >= 2")
    lingering = rows.groupBy(F.col("topic").alias("group_id")).agg(F.count_if(F.col("value") > 490).alias("expired_windows"))
    skewed = rows.groupBy(F.col("topic").alias("group_id")).agg(F.count_distinct("key").alias("members")).withColumn("partitions", F.lit(1_000_000))
    return A.remediation(degraded.withColumn("auto_resume_armed", F.col("subscriber_id").cast("int") % 3 == 0), lingering, skewed, 100)


@query("select 'events_total{topic=\"' || topic || '\"} ' || count(*) as line from ev group by topic")
def prometheus_lines(spark, sf):
    per = events(spark, sf).groupBy("topic").agg(F.count(F.lit(1)).alias("value"))
    return A.exposition(per.select(F.lit("events_total").alias("name"), F.create_map(F.lit("topic"), "topic").alias("labels"), "value"))


@query("select key, count(*) as depth from ev group by 1 having count(*) >= 10 order by depth desc, key limit 10")
def key_hotspots(spark, sf):
    return A.hotspots(events(spark, sf), 10)


@query("select topic, key, count(*) as published, round(sum(length(props))::double, 0) as bytes from ev group by 1, 2")
def counters(spark, sf):
    return events(spark, sf).groupBy("topic", "key").agg(F.count(F.lit(1)).alias("published"), F.sum(F.octet_length("props")).cast("double").alias("bytes"))


@query("select arrival, (sum(length(props)) over (partition by key order by arrival))::bigint as used, sum(length(props)) over (partition by key order by arrival) > 200 as over_quota from ev")
def tenant_quota(spark, sf):
    used = F.sum(F.octet_length("props")).over(Window.partitionBy("key").orderBy("arrival"))
    return events(spark, sf).select("arrival", used.cast("long").alias("used"), (used > 200).alias("over_quota"))


@query("select props, '[\"k\"]' as paths, count(*) as n from ev group by 1")
def payload_fingerprint(spark, sf):
    paths = F.to_json(F.array_sort(F.json_object_keys("props")))
    return events(spark, sf).groupBy("props").agg(F.count(F.lit(1)).alias("n")).select("props", paths.alias("paths"), "n")


# ---- assignment ----
@query("select arrival, ['a', 'b', 'c'][(seq - 1) % 3 + 1] as member from ev")
def partition_round_robin(spark, sf):
    return A.round_robin(events(spark, sf), ["a", "b", "c"], ["topic"]).select("arrival", "member")


@query("select key, arg_max(m, substr(sha256(key || chr(0) || m), 1, 16)) as member from (select distinct key from ev), (values ('a'), ('b'), ('c')) t(m) group by 1")
def partition_rendezvous(spark, sf):
    keys = events(spark, sf).select("key").distinct()
    return keys.select("key", A.rendezvous(keys, "key", ["a", "b", "c"]).alias("member"))


@query(f"select arrival, case when arrival % 5 = 0 then 3 else {_HASH.format('key')} % 16 end::int as partition from ev")
def partition_by_key(spark, sf):
    return events(spark, sf).select("arrival", A.partition_of(F.col("key"), 16, F.when(F.col("arrival") % 5 == 0, 3)).alias("partition"))


# ---- audit ----
@query("+ h as (select topic, arrival, seq, sha256(arrival || ':' || props) as c from ev), p as (select *, lag(case when arrival % 4001 = 17 then 'bad' else c end) over (partition by topic order by arrival) as b, coalesce(lag(c) over (partition by topic order by arrival), repeat('0', 64)) as want from h), v as (select topic, seq - 1 as i, case when arrival % 4001 = 17 then 'content' when b = 'bad' then 'link' end as why from p) select topic, count(*) as n, min(case when why is not null then i end) as broken_at, arg_min(why, case when why is not null then i end) as reason from v group by 1")
def audit_chain_verify(spark, sf):
    body = F.concat(F.col("arrival").cast("string"), F.lit(":"), "props")
    chained = A.chain(events(spark, sf), ["topic"], "arrival", body)
    spoilt = chained.withColumn("content_hash", F.when(F.col("arrival") % 4001 == 17, "bad").otherwise(F.col("content_hash")))
    return A.verify_chain(spoilt, ["topic"], "arrival", body)


@query("select arrival from ev where topic = 'events.view' and key = '9' and at_ms >= (select min(at_ms) from ev) + 86400000 and at_ms < (select max(at_ms) from ev) order by at_ms desc, arrival desc limit 5")
def audit_query(spark, sf):
    rows = events(spark, sf).withColumn("publisher_id", F.col("key"))
    low, high = rows.agg(F.min("at_ms"), F.max("at_ms")).first()
    return A.audit_query(rows, "events.view", "9", low + 86_400_000, high, 5).select("arrival")


@query("select arrival, case when arrival % 5 = 4 then 'cycle' when arrival % 5 = 3 then 'depth' end as verdict, case arrival % 5 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 5 else 4 end as hops from ev")
def lineage_depth(spark, sf):
    t = F.col("topic")
    hops = F.element_at(F.array(F.array(F.lit("x")), F.array(F.lit("x"), t), F.array(F.lit("x"), t, t), F.array(*map(F.lit, "abcde")), F.array(t, F.lit("y"), t, t)), (F.col("arrival") % 5 + 1).cast("int"))
    return events(spark, sf).select("arrival", A.lineage_check(hops, t, 5).alias("verdict"), F.size(hops).alias("hops"))


@query("select arrival from ev qualify max((topic = 'events.error' and value > 300)::int) over (partition by key || '/' || at_ms // 86400000) = 1")
def tail_sample(spark, sf):
    rows = events(spark, sf).withColumn("trace_id", F.concat("key", F.lit("/"), F.floor(F.col("at_ms") / 86_400_000).cast("string")))
    return A.tail_sample(rows, (F.col("topic") == "events.error") & (F.col("value") > 300), 0.0).select("arrival")


@query("select depth, count(*) as n from (select case when arrival % 7 = 0 then 0 else arrival % 7 end as depth from ev) group by 1")
def span_depths(spark, sf):
    spans = events(spark, sf).select(F.floor(F.col("arrival") / 7).alias("trace_id"), F.col("arrival").alias("span_id"), F.when(F.col("arrival") % 7 != 0, F.col("arrival") - 1).alias("parent_id"))
    return A.span_depths(spans).groupBy(F.col("depth").cast("long").alias("depth")).agg(F.count(F.lit(1)).alias("n"))


@query("select k as key, o as old, n as new, case when o is null then 'added' when n is null then 'removed' else 'changed' end as change from (select coalesce(a.key, b.key) as k, a.v as o, b.v as n from (select key, min(value) as v from ev where arrival % 50 <> 1 and key < '3' group by 1) a full join (select key, max(value) as v from ev where key > '12' group by 1) b on a.key = b.key) where o is distinct from n")
def config_drift(spark, sf):
    rows = events(spark, sf)
    old, new = rows.where("arrival % 50 <> 1 and key < '3'").groupBy("key").agg(F.min("value").alias("value")), rows.where("key > '12'").groupBy("key").agg(F.max("value").alias("value"))
    return A.config_drift(old, new).select("key", "old", "new", "change")


@query("select n::bigint as attempt, least(60000, 500 * pow(2, n - 1))::bigint as delay_ms from range(1, 13) t(n)")
def redelivery_backoff(spark, sf):
    return spark.range(1, 13).select(F.col("id").alias("attempt"), scalars.redelivery_delay(F.col("id"), 500, 60_000).alias("delay_ms"))


# ---- subscriptions, signatures, delivery ----
_GQL = """subscription Big($least: String) { events(topic: "events.*", filter: $least) { topic key seq } }"""


@query("select topic, key, seq from ev where value >= 150 and cast(json_extract(props, '$.k') as int) < 50")
def graphql_subscription(spark, sf):
    return graphql.subscribe(with_payload(log(spark, sf)), _GQL, {"least": "value >= 150 && props.k < 50"})


@query("select arrival, 'mirror.' || replace(topic, 'events.', '') || '.eu' as topic from ev")
def mirror_rename(spark, sf):
    return events(spark, sf).select("arrival", patterns.rename_template(F.col("topic"), "events.*", "mirror.$1.eu").alias("topic"))


@query("select arrival, round(value * 2 + 1, 4) as value from ev where value > 300")
def transform_chain(spark, sf):
    steps = [lambda d: d.where("value > 300"), lambda d: d.withColumn("value", F.col("value") * 2), lambda d: d.withColumn("value", F.col("value") + 1)]
    return D.transformed(events(spark, sf), steps).select("arrival", r2("value", "value"))


@query("select arrival, key, row_number() over (partition by key order by arrival) as key_seq from ev")
def key_sequence(spark, sf):
    return number(events(spark, sf), ["key"], ["arrival"], "key_seq").select("arrival", "key", "key_seq")


@query("select topic, arrival from ev qualify row_number() over (partition by topic order by arrival desc) <= 40")
def retention_entries(spark, sf):
    return C.retain(log(spark, sf), max_rows=40).select("topic", "arrival")


@query("select arrival, at_ms + case arrival % 7 when 2 then 1000 when 3 then 5000 when 4 then 30000 when 5 then null when 6 then null else 0 end as retry_at, arrival % 7 >= 5 as dead from ev")
def retry_ladder(spark, sf):
    rows = D.retries(events(spark, sf), (F.col("arrival") % 7 + 1).cast("int"), F.col("at_ms"), 2, [1000, 5000, 30_000])
    return rows.select("arrival", "retry_at", "dead")


@query("select arrival, case when value > 250 then 'nack' else 'timeout' end as reason from ev where arrival % 7 >= 5")
def dead_letter_split(spark, sf):
    rows = D.retries(events(spark, sf), (F.col("arrival") % 7 + 1).cast("int"), F.col("at_ms"), 2, [1000, 5000, 30_000])
    return D.dead_letters(rows, F.when(F.col("value") > 250, "nack").otherwise("timeout"))[1].select("arrival", "reason")


@query("select topic, count(*) as n, count(*) filter (arrival * 37 % 500 > 400) as missed, quantile_disc(arrival * 37 % 500, 0.99)::double as p99 from ev where arrival % 9 <> 0 group by 1")
def ack_latency_slo(spark, sf):
    rows = events(spark, sf)
    acked = rows.where("arrival % 9 <> 0").withColumn("acked_ms", F.col("at_ms") + F.col("arrival") * 37 % 500)
    got = D.ack_latency(rows, acked, 400)
    missed = got.groupBy("topic").agg(F.count_if("missed").alias("missed"))
    return A.summary(got, ["topic"], "ms", "arrival", last=None).join(missed, "topic").select("topic", "n", "missed", F.col("p99").cast("double").alias("p99"))


@query("""+ g as (select topic, unnest(['acl', 'schema', 'size']) as gate, unnest([value / 100, value / 50, 5.0 + arrival % 3]) as ms from ev)
 select topic, gate, count(*) as n, round(quantile_disc(ms, 0.99), 4) as p99 from g group by 1, 2 order by p99 desc, topic, gate limit 5""")
def admission_latency(spark, sf):
    ms = {"acl": F.col("value") / 100, "schema": F.col("value") / 50, "size": F.lit(5.0) + F.col("arrival") % 3}
    rows = events(spark, sf).select("topic", "arrival", F.explode(F.create_map(*[x for k, v in ms.items() for x in (F.lit(k), v)])).alias("gate", "ms"))
    return A.summary(rows, ["topic", "gate"], "ms", "arrival", last=None).orderBy(F.desc("p99"), "topic", "gate").limit(5).select("topic", "gate", "n", r2("p99", "p99"))


@query("select topic, count(*) as n, max(greatest(arrival * 13 % 90 - 10, 0))::double as max, quantile_disc(greatest(arrival * 13 % 90 - 10, 0), 0.5)::double as p50 from ev group by 1")
def schedule_skew(spark, sf):
    rows = events(spark, sf).withColumn("skew", F.col("arrival") * 13 % 90 - 10)
    return A.summary(rows, ["topic"], "skew", "arrival", last=None).select("topic", "n", F.col("max").cast("double").alias("max"), F.col("p50").cast("double").alias("p50"))


@query("select topic, count(*) as depth, (select max(at_ms) from ev) - min(at_ms) as lag_ms from ev where arrival % 17 = 3 group by 1")
def lag_watermark(spark, sf):
    rows = events(spark, sf)
    return D.lag_watermark(rows, rows.where("arrival % 17 <> 3"), ["topic"], now_of(rows))


@query("select arrival, reason from (select arrival, topic, case arrival % 3 when 0 then 'ttl' when 1 then 'queue' else 'rate' end as reason from ev) where topic = 'events.view' and reason = 'queue' order by arrival desc limit 30")
def drop_journal(spark, sf):
    reason = F.element_at(F.array(F.lit("ttl"), F.lit("queue"), F.lit("rate")), (F.col("arrival") % 3 + 1).cast("int"))
    return D.drops(events(spark, sf).withColumn("reason", reason), 30, topic="events.view", reason="queue").select("arrival", "reason")


@query("select arrival, ceil(seq / case topic when 'events.purchase' then 4.0 when 'events.view' then 1.0 else 2.0 end)::bigint as round from ev")
def subscriber_priority(spark, sf):
    weight = F.when(F.col("topic") == "events.purchase", D.PRIORITIES["high"]).when(F.col("topic") == "events.view", D.PRIORITIES["low"]).otherwise(D.PRIORITIES["normal"])
    return D.subscriber_order(events(spark, sf), "topic", weight).select("arrival", "round")


@query("+ q as (select topic, arg_min(at_ms + 86400000 * (1 + arrival % 3), arrival) - (select min(at_ms) + 100000000 from ev) as left_ms, min(arrival) as arrival from ev group by 1) select * from q where left_ms > 0 and left_ms <= 172800000")
def expiring_soon(spark, sf):
    rows = events(spark, sf).withColumn("deadline_ms", F.col("at_ms") + 86_400_000 * (1 + F.col("arrival") % 3))
    return D.expiring_soon(rows, ["topic"], rows.agg(F.min("at_ms")).first()[0] + 100_000_000, "deadline_ms", 172_800_000)


@query("""select arrival, (select min(greatest(epoch_ms(s), at_ms)) from (select make_timestamp(at_ms * 1000) as t, date_trunc('day', make_timestamp(at_ms * 1000)) + to_days(k::int) + interval 9 hour as s from range(-1, 9) r(k))
 where dayofweek(s) between 1 and 5 and s + interval 8 hour > t) as release_ms from ev""")
def delivery_windows(spark, sf):
    window = {"start": "09:00", "end": "17:00", "days": {1, 2, 3, 4, 5}}
    return events(spark, sf).select("arrival", D.release_at(F.col("at_ms"), [window]).alias("release_ms"))


@query("select epoch_ms(t) as at_ms from range(timestamp '2024-02-01', timestamp '2024-03-05', interval 1 minute) r(t) where minute(t) in (0, 20, 40) and hour(t) between 8 and 10 and dayofweek(t) between 1 and 5 and t > timestamp '2024-02-01'", ev=False)
def cron_occurrences(spark, sf):
    return D.occurrences(spark, "*/20 8-10 * * MON-FRI", 1_706_745_600_000, 1_709_596_799_999)


_KEYS = {"k1": b"first secret", "k2": b"second secret" * 8}


def _hmac_sql(message: str, secret: bytes) -> str:
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = ("unhex('" + bytes(b ^ p for b in key).hex() + "')" for p in (0x36, 0x5C))
    return f"sha256({outer} || unhex(sha256({inner} || {message})))"


_BASE_SQL = "(encode(topic) || unhex('00') || encode(seq::varchar) || encode(props))"


@query(f"select topic, seq, {_hmac_sql(_BASE_SQL, _KEYS['k2'])} as sig from ev")
def sign_messages(spark, sf):
    return log(spark, sf).select("topic", "seq", crypto.hmac_sha256(crypto.signing_base(F.col("topic"), F.col("seq"), F.col("props")), _KEYS["k2"]).alias("sig"))


@query("select topic, seq, arrival % 10 not in (3, 4) as valid from ev")
def verify_signatures(spark, sf):
    base = crypto.signing_base(F.col("topic"), F.col("seq"), F.col("props"))
    kid = F.when(F.col("arrival") % 10 == 3, "gone").when(F.col("arrival") % 2 == 0, "k1").otherwise("k2")
    sig = F.when(kid == "k1", crypto.hmac_sha256(base, _KEYS["k1"])).otherwise(crypto.hmac_sha256(base, _KEYS["k2"]))
    rows = log(spark, sf).withColumn("kid", kid).withColumn("sig", F.when(F.col("arrival") % 10 == 4, F.upper(sig)).otherwise(sig))
    return rows.select("topic", "seq", crypto.verify(base, F.col("kid"), F.col("sig"), _KEYS).alias("valid"))


@query("select arrival, case when arrival % 4 <> 0 then props end as text from ev")
def encryption_round_trip(spark, sf):
    old, new = b"0123456789abcdef", b"fedcba9876543210"
    rows = events(spark, sf).withColumn("kid", F.when(F.col("arrival") % 4 == 0, "old").otherwise("new"))
    rows = rows.withColumn("data", F.when(F.col("kid") == "old", crypto.encrypt(F.col("props"), old)).otherwise(crypto.encrypt(F.col("props"), new)))
    return rows.select("arrival", crypto.decrypt(F.col("data"), F.col("kid"), {"new": new}).alias("text"))


@query("select arrival from ev where key in (select key from ev where arrival % 97 = 5)")
def bloom_semi_join(spark, sf):
    """The filter thins the rows before the exact join, which is the authority."""
    rows = events(spark, sf)
    wanted = rows.where("arrival % 97 = 5").select("key").distinct()
    words = bloom.sizing(100_000, 0.01)[0] // 64
    thinned = bloom.annotate(rows, F.col("key"), bloom.build(wanted, F.col("key"), words), words).where("maybe")
    return thinned.join(wanted, "key", "left_semi").select("arrival")


_LATE_SQL = "select arrival, at_ms < max(at_ms) over (partition by topic order by (arrival + (arrival * 37) % 11), arrival rows between unbounded preceding and 1 preceding) - case topic when 'events.view' then 0 else 3600000 end as late from ev"


@query(f"select arrival, coalesce(late, false) as late from ({_LATE_SQL})")
def allowed_lateness(spark, sf):
    rows = C.resolve_rules(events(spark, sf), [("events.*", HOUR), ("events.view", 0)], "lateness")
    order = Window.partitionBy("topic").orderBy(F.col("arrival") + F.col("arrival") * 37 % 11, "arrival").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("arrival", F.coalesce(F.col("at_ms") < F.max("at_ms").over(order) - F.col("lateness"), F.lit(False)).alias("late"))


@query()
def circuit_breaker(spark, sf):
    rows = events(spark, sf).select("topic", "arrival", "at_ms", (F.col("value") > 300).alias("degraded"))
    return ordered_fold(rows, ["topic"], ["arrival"], lambda: folds.CircuitBreaker(3, 24 * HOUR), "topic string, arrival long, admitted boolean, state string")


@query()
def slow_start(spark, sf):
    rows = events(spark, sf).select("topic", "arrival", "at_ms")
    return ordered_fold(rows, ["topic"], ["arrival"], lambda: folds.SlowStart(1 / 7200, 240 * HOUR, 1 / 1800), "topic string, arrival long, admitted boolean")


@query()
def sessions_bounded(spark, sf):
    rows = events(spark, sf).select("topic", "key", "arrival", "at_ms")
    return ordered_fold(rows, ["topic"], ["arrival"], lambda: folds.BoundedSessions(8 * HOUR, 20), "key string, session_start long, session_end long, count long")


# ---- streams ----
def _stream(spark, sf):
    """events.parquet as a stream of the canonical relation; its few columns are read from the file's own schema."""
    raw = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.select(F.concat(F.lit("events."), "event_type").alias("topic"), F.col("event_id").alias("arrival"), F.col("ts").cast("timestamp").alias("ts"), scalars.millis("ts").alias("at_ms"), F.col("user_id").cast("string").alias("key"), F.get_json_object("props", "$.k").alias("message_id"))


@query("+ w as (select topic, at_ms // 21600000 * 21600000 as window_start, count(*) as count from ev group by 1, 2) select * from w where window_start + 21600000 <= (select max(at_ms) - 3600000 from ev)")
def stream_windows(spark, sf):
    """Tumbling windows of a stream that its watermark has closed."""
    got = stateful.windowed_counts(_stream(spark, sf), "6 hours", "1 hour", ["topic"])
    return stateful.run_available(got.select("topic", F.unix_millis("window.start").alias("window_start"), "count"), "stream-windows")


@query()
def stream_dedup(spark, sf):
    """The fold of dedup_idempotent with its state kept by the stream."""
    rows = _stream(spark, sf).select("topic", "message_id", "arrival", "at_ms")
    got = stateful.stream_fold(rows, ["topic", "message_id"], ["arrival"], lambda: folds.Dedup(72 * HOUR), _ROW)
    return stateful.run_available(got, "stream-dedup").where("admitted").select("arrival")


_SQL["stream_dedup"] = _SQL["dedup_idempotent"]


@query()
def stream_rate_limit(spark, sf):
    """The fold of rate_limit_topic with its state kept by the stream."""
    rows = _stream(spark, sf).select("topic", "arrival", "at_ms")
    got = stateful.stream_fold(rows, ["topic"], ["arrival"], lambda: folds.TokenBucket(1 / 3600, 5.0), "topic string, arrival long, at_ms long, admitted boolean")
    return stateful.run_available(got, "stream-rate-limit").select("arrival", "admitted")


@query()
def stream_cep(spark, sf):
    """The fold of cep_two_step with its state kept by the stream."""
    met = F.array_compact(F.array(F.when(F.col("topic") == "events.view", "a"), F.when(F.col("topic") == "events.purchase", "b")))
    rows = _stream(spark, sf).select("key", "arrival", "at_ms", met.alias("steps")).where("size(steps) > 0")
    got = stateful.stream_fold(rows, ["key"], ["arrival"], lambda: folds.Sequence([("a", None), ("b", None)], 24 * HOUR), "key string, start_ms long, at_ms long, duration_ms long, events array<long>")
    out = stateful.run_available(got, "stream-cep")
    return out.select("key", "start_ms", "at_ms", "duration_ms", F.array_join(F.col("events").cast("array<string>"), ",").alias("events"))


_SQL["stream_cep"] = _SQL["cep_two_step"]


@query("select l.key, l.arrival as l_arrival, r.arrival as r_arrival from ev l join ev r on l.key = r.key and l.topic = 'events.view' and r.topic = 'events.purchase' join events a on a.event_id = l.arrival join events b on b.event_id = r.arrival and b.ts >= a.ts and b.ts <= a.ts + interval 6 hours")
def stream_pairs(spark, sf):
    """A join of two streams within six hours."""
    left, right = (_stream(spark, sf).where(f"topic = 'events.{t}'").select("key", "arrival", "ts") for t in ("view", "purchase"))
    got = stateful.stream_pairs(left, right, "6 hours")
    return stateful.run_available(got, "stream-pairs").select(F.col("l_key").alias("key"), "l_arrival", "r_arrival")


# ---- relational ----
_JOINS = {"inner": "select c_custkey as id, count(*) as n, round(sum(o_totalprice), 2) as total from customer join orders on o_custkey = c_custkey group by 1", "left": "select c_custkey as id, count(o_orderkey) as n, round(coalesce(sum(o_totalprice), 0), 2) as total from customer left join orders on o_custkey = c_custkey group by 1", "left_semi": "select c_custkey as id from customer where exists (select 1 from orders where o_custkey = c_custkey)", "left_anti": "select c_custkey as id from customer where not exists (select 1 from orders where o_custkey = c_custkey)"}


def _join(how: str):
    def f(spark, sf):
        c, o = table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_totalprice")
        if how in ("left_semi", "left_anti"):
            return c.join(o, "id", how)
        if how == "inner":
            return c.join(o, "id").groupBy("id").agg(F.count("o_orderkey").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
        return c.join(o, "id", "left").groupBy("id").agg(F.count("o_orderkey").alias("n"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))

    return f


for _how, _sql in _JOINS.items():
    _f = _join(_how)
    _f.__name__ = f"join_{_how.removeprefix('left_')}"
    query(_sql, ev=False)(_f)


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by rollup (l_returnflag, l_linestatus)", ev=False)
def rollup(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)", ev=False)
def cube(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


def _keys(spark, sf):
    rows = events(spark, sf)
    return rows.where("topic = 'events.signup' and value > 250").select("key"), rows.where("topic = 'events.purchase' and value > 250").select("key")


for _name, _op in {"union": "union all", "intersect": "intersect", "except": "except"}.items():

    def _f(spark, sf, name=_name):
        a, b = _keys(spark, sf)
        return {"union": a.union, "intersect": a.intersect, "except": a.subtract}[name](b)

    _f.__name__ = f"set_{_name}"
    query(f"select key from ev where topic = 'events.signup' and value > 250 {_op} select key from ev where topic = 'events.purchase' and value > 250")(_f)


@query("select o_custkey as id, o_orderkey as orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders qualify place <= 3", ev=False)
def rank_topk(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("orderkey"), "place")


@query()
def approx_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"))


# ---- the folds' oracles ----
sql_of("sliding_limit", fold_sql(
    _by("topic"), "k as k_, n as n_, arrival, [at_ms] as times, true as ok", "k as k_, n as n_, arrival, case when len(kept) < 10 then list_append(kept, at_ms) else kept end as times, len(kept) < 10 as ok",
    "select arrival from d where ok", "o.*, list_filter(d.times, lambda x: x >= o.at_ms - 43200000) as kept",
))
sql_of("retention_bytes", fold_sql(
    "select topic as k, row_number() over (partition by topic order by arrival desc) as n, arrival, 1 + arrival * 37 % 101 as bytes from ev", "k as k_, n as n_, arrival, bytes, 5000 - bytes as room, true as kept",
    "k as k_, n as n_, arrival, bytes, case when bytes <= room then room - bytes else room end as room, bytes <= room as kept", "select arrival, bytes from d where kept", "o.*, d.room",
))
sql_of("compare_and_set", fold_sql(
    "select topic || '/' || key as k, row_number() over (partition by topic, key order by arrival) as n, topic, key, arrival, case when arrival % 3 <> 0 then arrival // 2500 end as expected from ev",
    "k as k_, n as n_, topic, key, arrival, (expected is null or expected = 0) as applied, (expected is null or expected = 0)::bigint as version",
    "k as k_, n as n_, topic, key, arrival, (expected is null or expected = was) as applied, was + (expected is null or expected = was)::bigint as version", "select topic, key, arrival, applied, version from d", "o.*, d.version as was",
))
sql_of("store_bounded", f"""with {EV}, u as (select topic, key, value, seq, lag(seq) over (partition by topic, key order by seq) as prev from ev),
 c as (select u.topic, u.key, u.seq, count(distinct x.key) as others from u join ev x on x.topic = u.topic and x.seq > u.prev and x.seq < u.seq group by 1, 2, 3),
 e as (select u.*, sum((prev is null or coalesce(others, 0) >= 40)::int) over (partition by u.topic, u.key order by u.seq) as life from u left join c using (topic, key, seq)),
 v as (select topic, key, value, seq, row_number() over (partition by topic, key, life order by seq) as version, row_number() over (partition by topic, key order by seq desc) as back from e)
 select topic, key, value, seq, version from v where back = 1 qualify row_number() over (partition by topic order by seq desc) <= 40""")
sql_of("event_time_release", f"""with {EV}, w as (select topic, arrival, at_ms, row_number() over (partition by topic order by arrival + (arrival * 37) % 31, arrival) as i from ev),
 m as (select *, max(at_ms) over (partition by topic order by i) - 3600000 as mark, max(at_ms) over (partition by topic order by i rows between unbounded preceding and 1 preceding) - 3600000 as before from w),
 r as (select a.topic, a.arrival, a.at_ms, a.i, case when a.at_ms < a.before then a.i else min(b.i) end as step from m a left join m b on b.topic = a.topic and b.i >= a.i and b.mark >= a.at_ms group by a.topic, a.arrival, a.at_ms, a.i, a.before)
 select topic, arrival, at_ms as event_time_ms, row_number() over (partition by topic order by step nulls last, at_ms, arrival) as released from r""")
sql_of("failure_regime", fold_sql(
    _by("topic", ", (arrival // 1000 % 3 * 3 > arrival * 7919 % 10)::int::double as x"), "k as k_, n as n_, arrival, null::double as mean, 1 as seen, x as total, 0::double as up, 0::double as down, null::varchar as direction, null::double as mean_before, null::double as score",
    """k as k_, n as n_, arrival, case when mean is null and seen = 49 then (total + x) / 50 when mean is null or up1 > 5 or down1 > 5 then null else mean end as mean, case when mean is null and seen < 49 then seen + 1 else 0 end as seen,
 case when mean is null and seen < 49 then total + x else 0 end as total, case when mean is null then 0 else up1 end as up, case when mean is null then 0 else down1 end as down,
 case when mean is null then null when up1 > 5 then 'up' when down1 > 5 then 'down' end as direction, mean as mean_before, case when up1 > 5 then up1 else down1 end as score""",
    "select k_ as topic, arrival, direction, mean_before, score from d where direction is not null", "o.*, d.mean, d.seen, d.total, greatest(0::double, d.up + o.x - d.mean - 0.05::double / 2) as up1, greatest(0::double, d.down + d.mean - o.x - 0.05::double / 2) as down1",
))
sql_of("partition_health", fold_sql(
    _by("arrival % 4", ", (arrival // 300 % 3 = 0)::int as failed"), "k as k_, n as n_, arrival, [failed] as last, true as healthy, 1 - failed as streak, 0::bigint as since",
    """k as k_, n as n_, arrival, case when up then [] else last1 end as last, case when down then false when up then true else healthy end as healthy, case when down then 0 else streak1 end as streak, case when down then at_ms else since end as since""",
    "select k_ as p, arrival, healthy from d",
    "*, healthy and len(last1) >= 5 and list_sum(last1) >= 0.5 * len(last1) as down, not healthy and streak1 >= 3 and at_ms - since >= 3600000 as up from (select o.*, d.healthy, d.since, list_append(d.last, o.failed)[-20:] as last1, case when o.failed = 1 then 0 else d.streak + 1 end as streak1",
).replace("and o.n = d.n_ + 1))", "and o.n = d.n_ + 1)))"))
sql_of("circuit_breaker", fold_sql(
    _by("topic", ", value > 300 as bad"), "k as k_, n as n_, arrival, bad::int as streak, null::bigint as opened, true as admitted",
    "k as k_, n as n_, arrival, case when shut then streak when bad then streak + 1 else 0 end as streak, case when shut then opened when bad and (opened is not null or streak + 1 >= 3) then at_ms end as opened, not shut as admitted",
    "select k_ as topic, arrival, admitted, case when opened is null then 'closed' else 'open' end as state from d", "o.*, d.streak, d.opened, coalesce(o.at_ms - d.opened < 86400000, false) as shut",
))
_I, _T = f"'{1 / 7200!r}'::double", f"'{1 / 1800!r}'::double"
sql_of("slow_start", fold_sql(
    _by("topic"), f"k as k_, n as n_, arrival, {_I} as tokens, at_ms as began, at_ms as last, false as admitted", "k as k_, n as n_, arrival, t - (t >= 1)::int as tokens, began, greatest(at_ms, last) as last, t >= 1 as admitted", "select k_ as topic, arrival, admitted from d",
    f"*, least(greatest(1::double, rate), tokens + greatest(0, at_ms - last) * rate / 1000) as t from (select o.*, d.tokens, d.began, d.last, case when o.at_ms - d.began >= 864000000 then {_T} else {_I} + ({_T} - {_I}) * (greatest(0, o.at_ms - d.began)::double / 864000000) end as rate",
).replace("and o.n = d.n_ + 1))", "and o.n = d.n_ + 1)))"))


_SQL["stream_rate_limit"] = _SQL["rate_limit_topic"]


# ---- delivery to one subscriber ----
@query("select arrival, seq from ev where seq % 3 = 0")
def delivery_sample_rate(spark, sf):
    return log(spark, sf).where(C.delivered_sample(F.col("seq"), 3)).select("arrival", "seq")


@query()
def dedup_subscriber(spark, sf):
    """A subscriber's window of the last 30 identifiers; every eleventh delivery is a redelivery."""
    rows = events(spark, sf).select("topic", "message_id", "arrival", "at_ms", (F.col("arrival") % 11 == 0).alias("again"))
    return ordered_fold(rows, ["topic"], ["arrival"], lambda: folds.Dedup(10**15, max_entries=30, exempt="again"), "topic string, message_id string, arrival long, at_ms long, again boolean, admitted boolean").where("admitted").select("arrival")


sql_of("dedup_subscriber", fold_sql(
    _by("topic", ", message_id as ident, arrival % 11 = 0 as again"), "k as k_, n as n_, arrival, case when again then []::varchar[] else [ident] end as kept, true as admitted",
    "k as k_, n as n_, arrival, case when again or list_contains(kept, ident) then kept else list_append(kept, ident)[-30:] end as kept, again or not list_contains(kept, ident) as admitted", "select arrival from d where admitted", "o.*, d.kept",
))


@query("""+ s as (select key, arrival, row_number() over (partition by key order by arrival) as key_seq, arrival % 5 = 2 as skipped from ev), t as (select *, arrival + arrival * 37 % 31 * 40 as came, row_number() over (order by arrival + arrival * 37 % 31 * 40, arrival) as place from s)
 select key, key_seq, max(place) over (partition by key order by key_seq) as released_at from t qualify not skipped""")
def keyed_reorder(spark, sf):
    """Deliveries that come out of the order of their keys' numbers; a fifth are filtered and only let others pass."""
    rows = events(spark, sf).withColumn("key_seq", F.row_number().over(Window.partitionBy("key").orderBy("arrival")).cast("long")).withColumn("came", F.col("arrival") + F.col("arrival") * 37 % 31 * 40)
    place = rows.select("arrival", F.row_number().over(Window.orderBy("came", "arrival")).cast("long").alias("place"))
    rows = rows.join(place, "arrival").select("key", "key_seq", F.col("place").alias("arrival"), (F.col("arrival") % 5 == 2).alias("skipped"))
    return ordered_fold(rows, ["key"], ["arrival"], folds.KeyReorder, "key string, key_seq long, arrival long, released_at long").select("key", "key_seq", "released_at")


@query(fold_sql(
    f"select o_custkey as k, 1 as n, count(*) filter (lane = 'urgent') as u, count(*) filter (lane = 'normal') as m, count(*) filter (lane = 'bulk') as b from (select *, {_LANE_SQL} as lane from orders) group by 1 union all select -1, 0, 0, 0, 0",
    "k as k_, 0 as n_, u, m, b, 0 as starved, null::varchar as lane", "1", "select 1",
).split(", d as")[0].split(EV + ", ")[1].join(["with recursive ", """, d as (select k, 0 as n, u, m, b, 0 as starved, null::varchar as lane from o where n = 1 union all
 select k, n + 1, u - (lane1 = 'urgent')::int, m - (lane1 = 'normal')::int, b - (lane1 = 'bulk')::int, case when b = 0 or lane1 = 'bulk' then 0 else starved + 1 end, lane1 from
 (select *, case when b > 0 and (u > 0 or m > 0) and starved + 1 >= 3 then 'bulk' when u > 0 then 'urgent' when m > 0 then 'normal' else 'bulk' end as lane1 from d where u + m + b > 0))
 select k as customer, n as round, lane from d where n > 0"""]), ev=False)
def lane_drain(spark, sf):
    """Rounds of one row for each customer, with a guard of three rounds."""
    rows = _orders(spark, sf).select("customer", "arrival", "lane")
    return ordered_fold(rows, ["customer"], ["arrival"], lambda: folds.LaneDrain(1, A.LANES, 3), "customer long, arrival long, lane string, round long, place long").select("customer", "round", "lane")


@query("select arrival from ev where key || '/' || at_ms // 86400000 = (select min(key || '/' || at_ms // 86400000) from ev) and at_ms >= (select min(at_ms) from ev) order by at_ms desc, arrival desc limit 20")
def trace_archive(spark, sf):
    spans = events(spark, sf).withColumn("trace_id", F.concat("key", F.lit("/"), F.floor(F.col("at_ms") / 86_400_000).cast("string")))
    first, since = spans.agg(F.min("trace_id"), F.min("at_ms")).first()
    return A.trace_query(spans, first, since=since, limit=20).select("arrival")


_ZONES = {"east": ["a", "b"], "north": [], "west": ["c", "d", "e"]}


@query("""+ k as (select distinct key from ev), z as (select key, arg_max(z, substr(sha256(key || chr(0) || z), 1, 16)) as zone from k, (values ('east'), ('west')) t(z) group by 1)
 select key, arg_max(m, substr(sha256(key || chr(0) || m), 1, 16)) as member from z join (values ('east', 'a'), ('east', 'b'), ('west', 'c'), ('west', 'd'), ('west', 'e')) t(zone, m) using (zone) group by 1""")
def partition_zone_aware(spark, sf):
    keys = events(spark, sf).select("key").distinct()
    return keys.select("key", A.zone_aware_member(keys, "key", _ZONES).alias("member"))


@query("+ k as (select distinct key from ev) select key, arg_max(m, substr(sha256(key || chr(0) || m), 1, 16)) as member from k, (values ('b'), ('c')) t(m) group by 1")
def partition_lag_aware(spark, sf):
    """a lags most, d has no sample and counts as it does, b and c lag alike."""
    keys = events(spark, sf).select("key").distinct()
    return keys.select("key", A.lag_aware_member(keys, "key", ["a", "b", "c", "d"], {"a": 9.0, "b": 2.0, "c": 2.0}).alias("member"))


# ---- cursors, shapes and waits ----
@query("""+ e as (select topic, arrival, seq from ev where topic = 'events.click') select 'stored' as how, arrival from e where seq > 100 union all select 'past the end', arrival from e union all select 'none', arrival from e""")
def seek_reset(spark, sf):
    """A cursor that counts; one past the end and none at all begin anew; with latest the same two find nothing."""
    rows, out = log(spark, sf), None
    for how, cursor, reset in (("stored", 100, "latest"), ("past the end", 10**12, "earliest"), ("none", None, "earliest"), ("past the end, latest", 10**12, "latest"), ("none, latest", None, "latest")):
        part = C.seek(rows, "events.click", cursor, reset).select(F.lit(how).alias("how"), "arrival")
        out = part if out is None else out.unionByName(part)
    return out


@query("select arrival, seq, greatest(300, seq) as cursor from ev where topic = 'events.purchase' and seq > 300 order by seq limit 40")
def outbox_read(spark, sf):
    return C.outbox_read(log(spark, sf).where("topic = 'events.purchase'"), 300, 40).select("arrival", "seq", C.acknowledge(F.lit(300), F.col("seq")).alias("cursor"))


@query("select o_orderkey as id from orders join customer on c_custkey = o_custkey where regexp_matches(c_mktsegment, '^(AUTO|MACH)') and regexp_matches(o_orderpriority, '[35]-')", ev=False)
def header_regex(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.withColumn("headers", F.create_map(F.lit("tenant"), "c_mktsegment", F.lit("p"), "o_orderpriority"))
    return rows.where(filterexpr.header_filter([("tenant", "regex", "^(AUTO|MACH)"), ("p", "regex", "[35]-")])).select(F.col("o_orderkey").alias("id"))


@query("select o_orderkey as arrival, coalesce(case when o_orderkey % 3 = 0 then o_orderkey * 7919 % 100003 end <= o_orderkey * 31 % 100003, false) as missed from orders", ev=False)
def edf_missed(spark, sf):
    return _orders(spark, sf).select("arrival", A.missed_deadline(F.col("deadline_ms"), F.col("arrival") * 31 % 100_003).alias("missed"))


@query("+ f as (select *, min(arrival) over (partition by topic) as first from ev) select arrival from f order by ceil(seq / 3.0), first, seq limit 200")
def drr_budget(spark, sf):
    return A.fair_budget(events(spark, sf), 200, 3).select("arrival")


@query("select topic, count(*) as n, quantile_disc(arrival * 13 % 997, 0.5)::double as p50, quantile_disc(arrival * 13 % 997, 0.95)::double as p95, quantile_disc(arrival * 13 % 997, 0.99)::double as p99, max(arrival * 13 % 997) as max from ev where at_ms + arrival * 13 % 997 >= (select min(at_ms) + 86400000 from ev) group by 1")
def dwell_percentiles(spark, sf):
    rows = events(spark, sf)
    first = rows.agg(F.min("at_ms")).first()[0]
    return D.dwell(rows.withColumn("delivered_ms", F.col("at_ms") + F.col("arrival") * 13 % 997), ["topic"], first + 86_400_000)


@query("select arrival, case arrival % 3 when 0 then 'c' when 1 then '' else 'c,d' end as added, case arrival % 3 when 0 then '' when 1 then 'b' else 'a,b' end as removed from ev")
def fingerprint_drift(spark, sf):
    new = F.element_at(F.array(F.array(*map(F.lit, "abc")), F.array(F.lit("a")), F.array(*map(F.lit, "dc"))), (F.col("arrival") % 3 + 1).cast("int"))
    drift = scalars.path_drift(F.array(F.lit("b"), F.lit("a")), new)
    return events(spark, sf).select("arrival", F.array_join(drift["added"], ",").alias("added"), F.array_join(drift["removed"], ",").alias("removed"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
