"""Subscriptions, signatures, filters and delivery, against small cases and plain Python."""

import hashlib
import hmac
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelog.functions import crypto, graphql
from tidelog.functions.scalars import Cron, next_open
from tidelog.operators import bloom, delivery, folds
from tidelog.sources.events import sequenced


def test_subscription_documents():
    want = graphql.parse_subscription('subscription S($f: String) { events(topic: "a.*", filter: $f) { seq topic, seq } } # end', {"f": "x > 1"})
    assert want == graphql.Subscription("a.*", "x > 1", ("seq", "topic"))
    two = 'query Q { a { seq } } subscription S { e(topic: "t") { key } }'
    assert graphql.parse_subscription(two, operation="S").fields == ("key",)
    for bad in (
        "{ e { seq } }", two, 'subscription { e(topic: "t") { nope } }', 'subscription { e(topic: "t", x: 1) { seq } }', "subscription { e { seq } }", 'subscription { e(topic: "") { seq } }',
        'subscription { e(topic: "t") }', 'subscription { e(topic: $t) { seq } }', 'subscription { e(topic: "t") { seq { a } } }', 'subscription { e(topic: "t") { seq }', "", "subscription { e ? }",
    ):
        with pytest.raises(ValueError):
            graphql.parse_subscription(bad)


def test_signatures(spark):
    rows = spark.createDataFrame([("t", 1, "wire"), ("", 20, ""), ("té", 3, "é")], "topic string, seq long, wire string")
    for secret in (b"", b"key", b"k" * 64, b"long" * 40):
        plain = crypto.hmac_sha256(crypto.signing_base(F.col("topic"), F.col("seq"), F.col("wire")), secret)
        named = crypto.hmac_sha256(crypto.signing_base(F.col("topic"), F.col("seq"), F.col("wire"), F.lit("p1")), secret)
        for r in rows.select("*", plain.alias("a"), named.alias("b")).collect():
            t, s, w = r.topic.encode(), str(r.seq).encode(), r.wire.encode()
            assert r.a == hmac.new(secret, t + b"\0" + s + w, hashlib.sha256).hexdigest()
            assert r.b == hmac.new(secret, t + b"\0" + s + b"\0p1\0" + w, hashlib.sha256).hexdigest()
    assert crypto.key_active(None, 5, 0) and crypto.key_active(10, 20, 10) and not crypto.key_active(10, 21, 10)


def test_encryption(spark):
    rows = spark.createDataFrame([("text",), ("",), (None,)], "text string")
    sealed = rows.withColumn("data", crypto.encrypt(F.col("text"), b"0123456789abcdef"))
    keys = {"a": b"0123456789abcdef", "b": b"fedcba9876543210"}
    got = sealed.select("text", *[crypto.decrypt(F.col("data"), F.lit(k), keys).alias(k) for k in ("a", "b", "c")]).collect()
    assert [(r.text, r.a, r.b, r.c) for r in got] == [(t, t, None, None) for t in ("text", "", None)]


def test_bloom_filter(spark):
    assert bloom.sizing(1000, 0.01) == (9586, 7) and bloom.sizing(1, 0.5)[0] == 64
    rows = spark.range(4000).select(F.col("id").cast("string").alias("v")).union(spark.createDataFrame([(None,)], "v string"))
    words = bloom.build(rows.where("cast(v as long) % 4 = 0 or v is null"), F.col("v"), 400)
    got = {r.v: r.maybe for r in bloom.annotate(rows, F.col("v"), words, 400).collect()}
    assert len(got) == 4001 and not got[None] and all(got[str(i)] for i in range(0, 4000, 4))
    assert sum(got[str(i)] for i in range(4000) if i % 4) < 300
    none = bloom.build(rows.limit(0), F.col("v"), 400)
    assert not bloom.annotate(rows, F.col("v"), none, 400).where("maybe").count()


@pytest.mark.parametrize(
    "windows",
    [
        [{"start": "09:00", "end": "17:30", "zone": "Europe/Berlin", "days": {1, 3}}],
        [{"start": "22:00", "end": "02:00", "days": {5}}, {"start": "12:00", "end": "12:01"}],
        [{"start": "06:00", "end": "06:00", "days": {0}}],
    ],
)
def test_release_times(spark, windows):
    times = [1_700_000_000_000 + i * 9_876_543 for i in range(60)]
    rows = spark.createDataFrame([(t,) for t in times], "t long").select("t", delivery.release_at(F.col("t"), windows).alias("at"))
    plain = [{**w, "days": w.get("days")} for w in windows]
    assert {r.t: r["at"] for r in rows.collect()} == {t: next_open(t, plain) for t in times}


@pytest.mark.parametrize("cron", ["*/20 8-10 * * MON-FRI", "0 0 L * *", "30 6 1,15 * 0", "5 4 29 2 *"])
def test_occurrences(spark, cron):
    after = 1_706_700_000_000
    until, want, c = after + 60 * 86_400_000, [], Cron(cron)
    at = c.next_after(after)
    while at is not None and at <= until:
        want.append(at)
        at = c.next_after(at)
    assert sorted(r.at_ms for r in delivery.occurrences(spark, cron, after, until).collect()) == want


def feed(fold, rows):
    return [x for r in rows for x in fold.step(r)]


def test_circuit_breaker():
    seen = [(0, True), (1, False), (2, True), (3, True), (4, False), (1002, True), (1003, True), (1004, False), (2003, False), (2004, True)]
    got = feed(folds.CircuitBreaker(2, 1000), [{"at_ms": t, "degraded": d} for t, d in seen])
    assert [r["admitted"] for r in got] == [True, True, True, True, False, False, True, False, True, True]
    assert [r["state"] for r in got] == ["closed"] * 3 + ["open"] * 5 + ["closed"] * 2


def test_slow_start():
    got = feed(folds.SlowStart(2, 1000, 10), [{"at_ms": t} for t in (0, 0, 0, 500, 500, 500, 500, 2000)])
    assert [r["admitted"] for r in got] == [True, True, False, True, True, True, False, True]
    free = feed(folds.SlowStart(1, 1000), [{"at_ms": t} for t in (0, 0, 1000, 1000, 1000)])
    assert [r["admitted"] for r in free] == [True, False, True, True, True]


def test_slow_start_rate(spark):
    e = F.col("id")
    got = spark.range(0, 1001, 500).select(*[delivery.slow_start_rate(e, 2, 1000, t, s).alias(f"c{i}") for i, (t, s) in enumerate([(10, "linear"), (None, "linear"), (8, "exponential"), (None, "exponential")])]).collect()
    assert [tuple(None if x is None else round(x, 6) for x in r) for r in got] == [(2, 2, 2, 2), (6, 3, 4, round(2 * 2**0.5, 6)), (10, None, 8, None)]


def test_bounded_sessions():
    fold = folds.BoundedSessions(10_000, 2)
    got = feed(fold, [{"key": k, "at_ms": i} for i, k in enumerate("abac")])
    assert got == [{"key": "b", "session_start": 1, "session_end": 1, "count": 1}]
    assert fold.finish() == [{"key": "a", "session_start": 0, "session_end": 2, "count": 2}, {"key": "c", "session_start": 3, "session_end": 3, "count": 1}]
    assert [r["count"] for r in feed(folds.BoundedSessions(100, 9), [{"key": "a", "at_ms": t} for t in (0, 99, 199)])] == [2]


def test_numbering_in_blocks(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("topic"), F.lit(0).alias("partition"), (F.col("id") * 7 - 50).alias("arrival"))
    got = sequenced(rows, 64).collect()
    for topic in "ab":
        own = sorted((r.arrival, r.seq) for r in got if r.topic == topic)
        assert [s for _, s in own] == list(range(1, len(own) + 1))
    assert sequenced(rows.limit(0)).count() == 0


def test_retries_and_dead_letters(spark):
    rows = delivery.retries(spark.range(1, 6), F.col("id"), F.lit(100), 2, [10, 20])
    assert [(r.retry_at, r.dead) for r in rows.orderBy("id").collect()] == [(100, False), (100, False), (110, False), (120, False), (None, True)]
    alive, dead = delivery.dead_letters(rows, F.lit("nack"))
    assert alive.count() == 4 and dead.first().reason == "nack"


def test_expiring_heads(spark):
    at = int((datetime(2024, 1, 1, tzinfo=UTC) + timedelta(hours=1)).timestamp() * 1000)
    rows = spark.createDataFrame([("a", 1, at + 50), ("a", 2, at + 1), ("b", 3, at), ("c", 4, at + 500)], "topic string, arrival long, deadline long")
    assert [tuple(r) for r in delivery.expiring_soon(rows, ["topic"], at, "deadline", 100).collect()] == [("a", 1, 50)]
