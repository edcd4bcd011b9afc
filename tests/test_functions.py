import random
import re

import pytest
from pyspark.sql import functions as F

from tidelog.functions import filterexpr as X
from tidelog.functions import patterns as P
from tidelog.functions import scalars as S

# Pattern, topic, whether it matches.
TRUTH = [
    ("market.btc", "market.btc", True), ("market.btc", "market.eth", False), ("market.*", "market.btc", True), ("market.*", "market", False),
    ("market.*", "market.btc.trades", False), ("market.**", "market", True), ("market.**", "market.btc.trades", True), ("market.**", "marketplace.btc", False),
    ("**.trades", "trades", True), ("**.trades", "market.btc.trades", True), ("**.trades", "tradesx", False), ("market.**.trades", "market.trades", True),
    ("market.**.trades", "market.btc.quotes", False), ("**.**.trades", "trades", True), ("market.**.**", "market.a.b", True), ("*", "a.b.c", True), ("**", "a", True),
    ("price.usd+", "price.usd", False), ("a+b", "aab", False), ("a(b)", "a(b)", True), ("a.b", "a+b", False),
]


@pytest.mark.parametrize("pattern,topic,expected", TRUTH)
def test_patterns(pattern, topic, expected):
    assert bool(re.search(P.to_regex(pattern), topic)) is expected
    assert not expected or topic.startswith(P.literal_prefix(pattern))


def test_patterns_in_spark(spark):
    for pattern, topic, expected in TRUTH:
        assert spark.range(1).select(P.topic_matches(F.lit(topic), pattern)).first()[0] is expected
    got = spark.range(1).select(P.rename_template(F.lit("a.b.c"), "a.*.c", "x.$1"), P.composite_matches(F.lit("a.b"), ["a.*", "**.b"], ["z"], "all"), P.composite_matches(F.lit("a.b"), ["a.*"], ["*.b"])).first()
    assert tuple(got) == ("x.b", True, False)


# Expression, payload, whether it holds.
FILTERS = [
    ("a == 1", '{"a":1}', True), ("a == 1", '{"a":1.0}', True), ("a == 1", '{"a":"1"}', False), ("a == '1'", '{"a":"1"}', True), ("a == 1", "{}", False),
    ("a != 1", "{}", True), ("a != 1", '{"a":null}', True), ("a == null", '{"a":null}', True), ("a == null", "{}", False), ("a != null", "{}", True),
    ("a > 1", '{"a":2}', True), ("a > 1", '{"a":"2"}', False), ("a >= 'b'", '{"a":"b"}', True), ("a < true", '{"a":false}', False), ("a == true", '{"a":true}', True),
    ("exists(a)", '{"a":null}', True), ("a.b exists", '{"a":{}}', False), ("a.b[1].c == 'x'", '{"a":{"b":[0,{"c":"x"}]}}', True), ("a[0] == 1", '{"a":{"0":1}}', False),
    ("a =~ /^x+y/", '{"a":"xxyz"}', True), ("a =~ /Y/i", '{"a":"xxyz"}', True), ("a =~ /1/", '{"a":1}', False), ("!(a == 1)", "{}", True), ("!exists(a) || a > 3", '{"a":4}', True),
    ("a == 1 && b == 2 || c == 3", '{"c":3}', True), ("a == 1 && (b == 2 || c == 3)", '{"c":3}', False), ("a == 'it\\'s \\u0041'", '{"a":"it\'s A"}', True), ("a == -1.5e1", '{"a":-15}', True),
    ("a.exists == 1", '{"a":{"exists":1}}', True), ("a < '😀'", '{"a":"\\uFFFD"}', False),
]


def test_filters(spark):
    rows = spark.createDataFrame([(i, p) for i, (_, p, _) in enumerate(FILTERS)], "i int, p string").withColumn("payload", F.parse_json("p")).cache()
    for i, (text, payload, expected) in enumerate(FILTERS):
        assert rows.where(F.col("i") == i).select(X.compile_filter(text)).first()[0] is expected, (text, payload)


@pytest.mark.parametrize("text", ["", "a", "a ==", "a == b", "== 1", "(a == 1", "a == 1)", "a = 1", "a == 'x", "a == '\\q'", "a =~ 'x'", "a =~ /x/g", "a =~ /(/", "a[b] == 1", "a..b == 1", "exists a", "a == 01", "a == 1 b", "x" * 70_000])
def test_bad_filters(text):
    with pytest.raises(ValueError):
        X.compile_filter(text)


def test_header_and_key_filters(spark):
    rows = spark.createDataFrame([(1, {"tenant": "acme"}, "m"), (2, {"tenant": "other"}, "a"), (3, None, None), (4, {"x": "y"}, "z")], "id int, headers map<string,string>, key string")
    ids = lambda c: [r.id for r in rows.where(c).orderBy("id").collect()]
    assert ids(X.header_filter([("tenant", "eq", "acme")])) == [1] and ids(X.header_filter([("tenant", "ne", "acme")])) == [2]
    assert ids(X.header_filter([("tenant", "prefix", "ac"), ("tenant", "regex", "m")])) == [1]
    assert ids(X.key_range(F.col("key"), "m")) == [1, 4] and ids(X.key_range(F.col("key"), None, "m")) == [2] and ids(X.key_range(F.col("key"))) == [1, 2, 4]


def test_cron():
    at = 1_704_067_200_000  # Monday, 1 January 2024
    hour = 3_600_000
    assert S.Cron("*/15 * * * *").next_after(at) == at + 900_000 and S.Cron("0 0 * * *").next_after(at) == at + 24 * hour
    assert S.Cron("30 6 L * *").next_after(at) == at + 30 * 24 * hour + 6 * hour + 1_800_000
    assert S.Cron("0 12 * * SUN").next_after(at) == at + 6 * 24 * hour + 12 * hour and S.Cron("0 0 31 FEB *").next_after(at) is None
    for bad in ("* * * *", "60 * * * *", "5-1 * * * *", "*/0 * * * *", "x * * * *"):
        with pytest.raises(ValueError):
            S.Cron(bad)


def test_delivery_windows():
    at = 1_704_067_200_000
    assert S.in_delivery_window(at + 9 * 3_600_000, "09:00", "17:00") and not S.in_delivery_window(at + 17 * 3_600_000, "09:00", "17:00")
    assert S.in_delivery_window(at + 3_600_000, "22:00", "06:00", days={0}) and not S.in_delivery_window(at + 3_600_000, "22:00", "06:00", days={1})
    assert S.in_delivery_window(at, "05:00", "05:00") and S.next_open(at, [{"start": "09:00", "end": "10:00"}]) == at + 9 * 3_600_000


def test_json_helpers():
    assert S.field_paths({"a": [{"b": 1}, 2], "c": {}}) == ["a", "a[]", "a[].b", "c"]
    assert S.fingerprint([]) == "811c9dc5" and S.fnv1a32(b"a") == 0xE40C292C
    doc = {"a": {"b~/": [1, 2]}}
    assert S.apply_patch(doc, [{"op": "add", "path": "/a/b~0~1/-", "value": 3}, {"op": "remove", "path": "/a/b~0~1/0"}]) == {"a": {"b~/": [2, 3]}} and doc == {"a": {"b~/": [1, 2]}}
    for bad in ({"op": "move", "path": "/a"}, {"op": "replace", "path": "/z", "value": 1}, {"op": "remove", "path": "a"}):
        with pytest.raises(ValueError):
            S.apply_patch(doc, [bad])
    assert S.hlc_tick((5, 2), 4) == (5, 3) and S.hlc_tick((5, 2), 9) == (9, 0) and S.hlc_tick((5, 2), 4, (7, 1)) == (7, 2)


def test_traceparent(spark):
    good, zero = "00-" + "a" * 32 + "-" + "b" * 16 + "-01", "00-" + "0" * 32 + "-" + "b" * 16 + "-01"
    got = spark.range(1).select(S.traceparent(F.lit(good))["span_id"], S.traceparent(F.lit(zero))).first()
    assert got[0] == "b" * 16 and got[1] is None


def test_regexes_agree_with_segments():
    def brute(p, t):
        if not p:
            return not t
        if p[0] == "**":
            return any(brute(p[1:], t[k:]) for k in range(len(t) + 1))
        return bool(t) and p[0] in ("*", t[0]) and brute(p[1:], t[1:])

    rnd = random.Random(4)
    for _ in range(3000):
        p, t = [rnd.choice(["a", "b", "*", "**"]) for _ in range(rnd.randint(2, 5))], [rnd.choice("ab") for _ in range(rnd.randint(1, 5))]
        assert bool(re.search(P.to_regex(".".join(p)), ".".join(t))) is brute(p, t), (p, t)
