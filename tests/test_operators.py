import os

import pytest
from pyspark.sql import functions as F

from tidelog.operators import analytics as A
from tidelog.operators import core as C
from tidelog.operators import folds
from tidelog.sources import events as E
from tidelog.streaming import stateful


def feed(fold, rows):
    return [x for r in rows for x in fold.step(r)] + fold.finish()


def test_dedup_restarts_at_its_end():
    rows = [{"message_id": "m", "at_ms": t} for t in (0, 999, 1000, 1500, 2000)] + [{"message_id": "", "at_ms": 1}]
    assert [r["admitted"] for r in feed(folds.Dedup(1000), rows)] == [True, False, True, False, True, True]


def test_token_bucket_and_sliding_limit():
    rows = [{"at_ms": 0}] * 7 + [{"at_ms": 100}]
    assert [r["admitted"] for r in feed(folds.TokenBucket(10, 5), rows)] == [True] * 5 + [False] * 2 + [True]
    assert [r["admitted"] for r in feed(folds.SlidingLimit(2, 10), [{"at_ms": t} for t in (0, 5, 10, 11)])] == [True, True, False, True]


def row(arrival, at, *steps, key="k"):
    return {"key": key, "arrival": arrival, "at_ms": at, "steps": list(steps)}


def test_sequences():
    two = lambda: folds.Sequence([("t", None), ("t", None)], 100)
    assert len(feed(two(), [row(1, 0, "t"), row(2, 1, "t")])) == 1 and len(feed(two(), [row(i, i, "t") for i in range(3)])) == 2
    assert [m["events"] for m in feed(folds.Sequence([("a", None), ("b", None)], 100), [row(1, 0, "a"), row(2, 5, "a"), row(3, 100, "b")])] == [[1, 3], [2, 3]]
    assert feed(folds.Sequence([("a", None), ("b", None)], 100), [row(1, 0, "a"), row(3, 101, "b")]) == []
    absent = lambda: folds.Sequence([("a", None), ("b", 80)], 100)
    assert [m["at_ms"] for m in feed(absent(), [row(1, 0, "a"), row(2, 80, "b")])] == [80] and feed(absent(), [row(1, 0, "a"), row(2, 79, "b")]) == []
    assert [m["at_ms"] for m in feed(absent(), [row(1, 0, "a")])] == [80]
    with pytest.raises(ValueError):
        folds.Sequence([("a", 5)], 100)


def test_regime_and_health():
    rows = [{"topic": "t", "arrival": i, "failed": int(i >= 60)} for i in range(90)]
    got = feed(folds.Regime(), rows)
    assert [(x["direction"], x["arrival"]) for x in got] == [("up", 65)]
    healthy = [x["healthy"] for x in feed(folds.PartitionHealth(window=4, least=4, share=0.5, recover=2, cooldown_ms=0), [{"failed": f, "at_ms": 0} for f in (0, 0, 1, 1, 0, 0, 1)])]
    assert healthy == [True, True, True, False, False, True, True]


def test_causal_and_event_time():
    rows = [{"source": "s", "clock": c, "arrival": i} for i, c in enumerate((0, 2, 1, 0, 4, 5))]
    assert [(x["clock"]) for x in feed(folds.Causal(), rows)] == [0, 1, 2, 0]
    rows = [{"topic": "t", "arrival": i, "event_time_ms": t, "at_ms": i} for i, t in enumerate((10, 30, 20, None, 5, 60))]
    assert [x["arrival"] for x in feed(folds.EventTimeBuffer(15), rows)] == [0, 3, 4, 2, 1, 5]


def test_cas_patches_store_bytes():
    rows = [{"topic": "t", "key": "k", "arrival": i, "value": v, "expected_version": e, "expected_value": x} for i, (v, e, x) in enumerate((("1", 0, None), ("2", 0, None), ("3", 1, "1.0"), ("4", None, "9")))]
    assert [(r["applied"], r["version"]) for r in feed(folds.CompareAndSet(), rows)] == [(True, 1), (False, 1), (True, 2), (False, 2)]
    patch = '[{"op":"replace","path":"/v","value":2}]'
    rows = [{"key": "k", "arrival": i, "version": n, "value": v, "ops": o} for i, (n, v, o) in enumerate(((1, None, patch), (1, '{"v":1}', None), (2, None, patch), (2, None, patch), (4, None, patch), (3, None, '[{"op":"remove","path":"/z"}]')))]
    assert [r["verdict"] for r in feed(folds.Patches(), rows)] == ["gap", "full", "applied", "stale", "gap", "failed"]
    rows = [{"topic": "t", "key": k, "value": i, "seq": i} for i, k in enumerate("abca")]
    assert [(r["key"], r["version"]) for r in feed(folds.BoundedStore(2), rows)] == [("c", 1), ("a", 1)]
    assert [r["kept"] for r in feed(folds.GreedyBytes(10), [{"bytes": b} for b in (6, 7, 4)])] == [True, False, True]


def test_redaction_and_gates(spark):
    df = spark.range(1).select(F.struct(F.struct(F.lit("e").alias("email"), F.lit("n").alias("name")).alias("user")).alias("p"))
    assert C.redact(df, "p", ["user.email", "user.none.x", "zip"]).first().p.user.asDict() == {"email": "***", "name": "n"}
    assert C.migration_path({(1, 2), (2, 3), (1, 3)}, 1, 3) == [1, 3] and C.migration_path(set(), 1, 2) is None
    late = spark.range(1).select(C.alive(F.lit(10), F.lit(0), F.lit(10)), C.alive(F.lit(9), F.lit(0), F.lit(10)), C.alive(F.lit(5), F.lit(0), F.lit(10), F.lit(5))).first()
    assert tuple(late) == (False, True, False)


def test_sessions_break_at_the_gap(spark):
    df = spark.createDataFrame([("k", t, i, 1.0) for i, t in enumerate((0, 0, 50, 60))], "key string, at_ms long, arrival long, value double")
    assert sorted(r["count"] for r in C.sessions(df, 50).collect()) == [2, 2]


def test_numeric_windows_skip_what_is_no_number(spark):
    df = spark.createDataFrame([(0, 0, 10.0), (1, 1, float("nan")), (2, 2, None), (3, 3, 20.0), (4, 200, float("inf"))], "arrival long, at_ms long, value double")
    assert [(r["count"], r["value"]) for r in C.tumbling(df, "sum", 100).collect()] == [(2, 30.0)]
    with pytest.raises(ValueError):
        C.fold_of("median")


def test_assignments(spark):
    members = ["a", "b", "c"]
    before = A.sticky([str(i) for i in range(9)], members, {})
    after = A.sticky([str(i) for i in range(9)], ["a", "b"], before)
    assert sorted(list(before.values()).count(m) for m in members) == [3, 3, 3] and sum(before[i] == after[i] for i in before if before[i] != "c") == 6
    weighted = A.sticky([str(i) for i in range(8)], members, {}, {"a": 2})
    assert [list(weighted.values()).count(m) for m in members] == [4, 2, 2]
    df = spark.range(20).select(F.col("id").cast("string").alias("p"))
    assert all(r.m == max(members, key=lambda m: A._score(r.p, m)) for r in df.select("p", A.rendezvous(df, "p", members).alias("m")).collect())
    assert A.zone_aware("1", {"x": [], "y": ["m"]}) == "m" and A.lag_aware("1", members, {"a": 5, "b": 1}) == "b"


def test_log_files(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text('{"topic":"t","seq":1,"at_ms":5,"key":"k"}\nnot json\n{"topic":"t","seq":0}\n')
    log = E.read_log(spark, str(tmp_path / "log"))
    assert E.good_records(log.cache()).count() == 1 and E.corrupt_lines(log).first()[0] == 1
    sf = "/root/testdata/sf0.001"
    if os.path.isdir(sf):
        rows = E.sequenced(E.to_events(spark, sf))
        E.export_topic(rows, "events.click", str(tmp_path / "out"))
        back = E.import_topic(spark, str(tmp_path / "out"), "copy")
        assert back.count() == rows.where("topic = 'events.click'").count() and back.agg(F.min("seq")).first()[0] == 1
        E.append_log(rows, str(tmp_path / "table"))
        assert spark.read.parquet(str(tmp_path / "table")).where("topic = 'events.view'").count() == rows.where("topic = 'events.view'").count()


def test_stream_fold_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"m{i % 7}", i, i * 10) for i in range(300)], "message_id string, arrival long, at_ms long")
    schema = "message_id string, arrival long, at_ms long, admitted boolean"
    make = lambda: folds.Dedup(200)
    batch = folds.ordered_fold(rows, ["message_id"], ["arrival"], make, schema).where("admitted")
    for k in range(3):
        rows.where(f"arrival div 100 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stateful.stream_fold(stream, ["message_id"], ["arrival"], make, schema)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(schema).parquet(str(tmp_path / "out")).where("admitted")
    assert sorted(r.arrival for r in got.collect()) == sorted(r.arrival for r in batch.collect())


class Group:
    """Stands for a stream, and for the state of its one key."""

    exists = False

    def groupBy(self, *keys):
        return self

    def applyInPandasWithState(self, update, *_):
        return update

    def update(self, value):
        self.value = value


def test_stream_fold_holds_no_group(spark, monkeypatch):
    """Four times the rows of one key take no more memory, and come in order from whatever number of files."""
    import random
    import tracemalloc

    import pandas as pd

    monkeypatch.setattr(stateful, "RUN_BYTES", 1 << 17, raising=False)
    monkeypatch.setattr(stateful, "FAN", 3, raising=False)
    monkeypatch.setattr(stateful, "OUT_ROWS", 1_000, raising=False)
    update = stateful.stream_fold(Group(), ["topic"], ["arrival"], lambda: folds.TokenBucket(1.0, 5.0), "topic string, arrival long, at_ms long, admitted boolean")

    def run(n):
        numbers = list(range(n))
        random.Random(2).shuffle(numbers)
        frames = (pd.DataFrame({"topic": "t", "arrival": numbers[i : i + 500], "at_ms": [k * 300 for k in numbers[i : i + 500]]}) for i in range(0, n, 500))
        tracemalloc.start()
        rows = admitted = 0
        fold = folds.TokenBucket(1.0, 5.0)
        for frame in update(("t",), frames, Group()):
            want = [fold.step({"at_ms": (rows + i) * 300})[0]["admitted"] for i in range(len(frame))]
            assert list(frame["arrival"]) == list(range(rows, rows + len(frame))) and list(frame["admitted"]) == want
            rows, admitted = rows + len(frame), admitted + sum(want)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == n and 0 < admitted < n
        return peak - 40 * n  # the list of numbers

    run(1_000)
    assert run(40_000) < 2 * run(10_000)


def test_stream_order_keeps_values(monkeypatch):
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(stateful, "RUN_BYTES", 1)
    monkeypatch.setattr(stateful, "FAN", 2)
    parts = [([3.0, None], ["b", "z"]), ([1.0, 3.0], [None, "a"]), ([2.0, None], ["c", "y"])]
    frames = (pd.DataFrame({"o": o, "p": p, "steps": [np.array(["x"], dtype=object), None]}) for o, p in parts)
    got = list(stateful._in_order(frames, ["o", "p"]))
    assert [(r["o"], r["p"]) for r in got] == [(1, None), (2, "c"), (3, "a"), (3, "b"), (None, "y"), (None, "z")]
    assert [r["steps"] for r in got] == [["x"], ["x"], None, ["x"], None, None] and list(stateful._in_order(iter(()), ["o"])) == []


def test_plans_stay_lean(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    from tidelog.plans import catalog

    plan = catalog.flagship(spark, sf)._jdf.queryExecution().toString()
    assert "GreaterThan(value,50.0)" in plan.split("PushedFilters")[-1]
    assert "props" not in plan.split("ReadSchema")[-1]


def test_blocked_windows(spark):
    """Running values and neighbours by blocks are those of a window, whatever the width, null keys and values included."""
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tidelog.operators.blocked import beside, numbered, running

    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None]), k * rnd.choice([1, 3]) * 1000 + k, rnd.choice([None, rnd.randint(-50, 50)])) for k in range(400)]
    df = spark.createDataFrame(rows, "topic string, o long, v long").repartition(3)
    up, back = Window.partitionBy("topic").orderBy("o"), Window.partitionBy("topic").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("topic", "o", F.row_number().over(up).alias("n"), F.max("v").over(back).alias("m"), F.coalesce(F.sum("v").over(up.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("s"), F.lag("v").over(up).alias("p"), F.lead("v").over(up).alias("q"))
    for width in (1, 5_000, 1 << 40):
        got = numbered(df, ["topic"], ["o"], "n", width)
        got = running(got, ["topic"], ["o"], width, before=True, m=("max", F.col("v")))
        got = running(got, ["topic"], ["o"], width, s=("sum", F.col("v")))
        got = beside(beside(got, ["topic"], ["o"], "p", F.col("v"), width), ["topic"], ["o"], "q", F.col("v"), width, following=True)
        assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_event_time_buffer_looks_only_at_due_rows():
    """A row doesn't cost a pass over all that wait, whichever of the two ways out the others take."""
    reads = 0

    class Row(dict):
        def __getitem__(self, name):
            nonlocal reads
            reads += 1
            return super().__getitem__(name)

    n = 3_000
    for fold in (folds.EventTimeBuffer(10**9, 10**15), folds.EventTimeBuffer(10**9, 10), folds.EventTimeBuffer(0, 10**15)):
        reads, rows = 0, [Row(topic="t", arrival=i, event_time_ms=(i * 37) % n + (10 * n if i == 0 and fold.hold == 10 else 0), at_ms=i) for i in range(n)]
        got = feed(fold, rows)
        assert sorted(x["released"] for x in got) == list(range(1, n + 1)) and reads <= 20 * n
        assert not fold.rows and len(fold.times) <= 64 and len(fold.ages) <= 64
    held = [{"topic": "t", "arrival": i, "event_time_ms": t, "at_ms": a} for i, (t, a) in enumerate(((50, 0), (40, 1), (45, 8), (60, 10), (200, 12)))]
    fold = folds.EventTimeBuffer(100, 9)
    assert [[x["arrival"] for x in fold.step(r)] for r in held] == [[], [], [], [1, 0], [2, 3]] and [x["arrival"] for x in fold.finish()] == [4]


def test_released_by_blocks_equals_the_fold(spark):
    import random

    rnd = random.Random(11)
    rows = [(rnd.choice(["a", "b", None]), k * 100 + k, rnd.choice([None, *[k + rnd.randint(-40, 40)] * 6, k // 50 * 50])) for k in range(500)]
    df = spark.createDataFrame(rows, "topic string, arrival long, event_time_ms long").repartition(3)
    for late in (0, 25):
        want = []
        for topic in ("a", "b", None):
            want += feed(folds.EventTimeBuffer(late, 10**15), [{"topic": t, "arrival": a, "event_time_ms": e, "at_ms": a} for t, a, e in rows if t == topic])
        for width, span in ((1, 1), (7_000, 30), (1 << 40, 1 << 40)):
            got = C.released(df, late, width=width, span_ms=span).select("topic", "arrival", "event_time_ms", "released")
            assert sorted(map(tuple, got.collect()), key=repr) == sorted((tuple(x.values()) for x in want), key=repr)


def test_no_task_sorts_a_topic(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    from tidelog.plans import catalog

    queries = catalog.queries()
    for name in ("watermark_late", "watermark_idle", "topic_fork", "topic_merge", "topic_split", "replay_range_key", "seq_gaps", "barrier_epochs", "micro_batches", "lag_slo_runs", "lag_threshold_edges", "partition_round_robin", "audit_chain_verify", "drr_order"):
        plan = queries[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if " Window " in f" {line.strip(' +-:|')} " and "Window [" in line]
        assert windows and all("_block" in line for line in windows), name


def test_span_depths(spark):
    from tidelog.operators.analytics import span_depths

    rows = [(1, k, k - 1 if k else None) for k in range(40)] + [(2, 0, None), (2, 1, 0), (2, 2, 0), (2, 3, 9), (2, 4, 5), (2, 5, 4), (2, 6, 5), (3, 1, 1)]
    df = spark.createDataFrame(rows, "trace_id long, span_id long, parent_id long")
    got = {(r.trace_id, r.span_id): r.depth for r in span_depths(df).collect()}
    assert got == {(1, k): k for k in range(40)} | {(2, 0): 0, (2, 1): 1, (2, 2): 1}


def test_lane_drain_and_reorder():
    from tidelog.operators import folds

    drain = folds.LaneDrain(8, {"urgent": 8, "normal": 2, "bulk": 1}, 3)
    for k, lane in enumerate(["urgent"] * 40 + ["bulk"] * 3 + ["normal"] * 2):
        drain.step({"lane": lane, "arrival": k})
    out = drain.finish()
    rounds = [[r["lane"] for r in out if r["round"] == n] for n in range(1, 8)]
    assert rounds[:2] == [["urgent"] * 8] * 2 and rounds[2] == ["bulk"] + ["urgent"] * 7 and rounds[5] == ["bulk", "urgent", "normal", "normal", "bulk"]
    fold, got = folds.KeyReorder(), []
    for seq, skipped in ((3, False), (1, True), (5, False), (2, False), (4, False), (2, False)):
        got.append([r["key_seq"] for r in fold.step({"key": "k", "key_seq": seq, "arrival": seq, "skipped": skipped})])
    assert got == [[], [], [], [2, 3], [4, 5], [2]]


def test_sketches_are_near(spark):
    """Approximate quantiles and distinct counts against exact ones."""
    from pyspark.sql import functions as F

    rows = [((k * 7919) % 20_011 / 3.0, k % 4_000) for k in range(20_000)]
    df = spark.createDataFrame(rows, "v double, k long")
    got = df.agg(F.percentile_approx("v", [0.5, 0.95, 0.99], 1000).alias("q"), F.approx_count_distinct("k").alias("n")).first()
    exact = sorted(v for v, _ in rows)
    assert all(abs(q - exact[int(p * len(exact))]) <= 0.002 * exact[-1] for q, p in zip(got.q, (0.5, 0.95, 0.99), strict=True))
    assert abs(got.n - 4_000) <= 0.15 * 4_000
