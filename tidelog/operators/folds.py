"""Operators that need ordered state for each key, in batch and (see streaming) in streams."""

from __future__ import annotations

import json
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.scalars import apply_patch


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], make: Callable[[], object], schema: str) -> DataFrame:
    """Feed each key's rows in order to an object of `make`: its step(row) and finish() return output rows.

    Rows stream through a task sorted by key, so memory holds one key's state and one batch, not a group.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, rows = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if state is None or own != key:
                    rows += state.finish() if state else []
                    key, state = own, make()
                rows += state.step(row)
                if len(rows) > 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=out)
                    rows = []
        rows += state.finish() if state else []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


class Fold:
    def finish(self) -> list[dict]:
        return []


class Dedup(Fold):
    """Keeps a row if its key was not kept within the last window; the window restarts when a row is kept, and
    has passed exactly at its end. With max_entries the oldest kept id is forgotten first. Rows whose column `exempt`
    is true (redeliveries to a subscriber) pass, and are not remembered."""

    def __init__(self, window_ms: int, ident: str = "message_id", at: str = "at_ms", max_entries: int | None = None, exempt: str | None = None):
        self.window_ms, self.ident, self.at, self.most, self.exempt, self.kept = window_ms, ident, at, max_entries, exempt, OrderedDict()

    def step(self, row: dict) -> list[dict]:
        ident, now = row[self.ident], row[self.at]
        if not ident or self.exempt and row[self.exempt]:  # no identifier: never a duplicate
            return [row | {"admitted": True}]
        last = self.kept.get(ident)
        fresh = last is None or now - last >= self.window_ms
        if fresh:
            self.kept.pop(ident, None)
            self.kept[ident] = now
            if self.most and len(self.kept) > self.most:
                self.kept.popitem(last=False)
        return [row | {"admitted": fresh}]


class TokenBucket(Fold):
    """Admits a row if a token is left. The bucket starts full and refills by `rate` a second, up to `burst`."""

    def __init__(self, rate: float, burst: float | None = None, at: str = "at_ms"):
        self.rate, self.cap, self.at = rate, burst if burst is not None else max(1.0, rate), at
        self.tokens, self.last = self.cap, None

    def step(self, row: dict) -> list[dict]:
        now = row[self.at]
        if self.last is not None and now > self.last:
            self.tokens = min(self.cap, self.tokens + (now - self.last) * self.rate / 1000)
        self.last = now if self.last is None else max(self.last, now)
        ok = self.tokens >= 1
        self.tokens -= ok
        return [row | {"admitted": bool(ok)}]


class SlidingLimit(Fold):
    """Admits at most `most` rows in any trailing window, both ends included."""

    def __init__(self, most: int, window_ms: int, at: str = "at_ms"):
        self.most, self.window_ms, self.at, self.times = most, window_ms, at, deque()

    def step(self, row: dict) -> list[dict]:
        now = row[self.at]
        while self.times and self.times[0] < now - self.window_ms:
            self.times.popleft()
        ok = len(self.times) < self.most
        if ok:
            self.times.append(now)
        return [row | {"admitted": ok}]


class Sequence(Fold):
    """Complex events: steps (name, absent_ms or None) matched in order by rows whose `steps` lists the names they meet.

    Each partial takes a row once; a row may advance several partials and then start one. Partials older than
    within_ms go first. A step with absent_ms is met if no such row comes before that long has passed, which holds
    exactly at its deadline; the first step can't be one.
    """

    def __init__(self, steps: list[tuple[str, int | None]], within_ms: int, max_partials: int = 10_000, at: str = "at_ms"):
        if not steps or steps[0][1] is not None:
            raise ValueError("a sequence begins with a step that is present")
        self.steps, self.within_ms, self.most, self.at, self.partials = steps, within_ms, max_partials, at, []

    def _emit(self, p: dict, at: int) -> dict:
        return {"key": p["key"], "start_ms": p["start"], "at_ms": at, "duration_ms": at - p["start"], "events": p["events"]}

    def _settle(self, p: dict, now: int | None, out: list[dict]) -> bool:
        """Pass over absence steps whose deadline has come; whether the partial lives on."""
        while self.steps[p["step"]][1] is not None:
            wait = self.steps[p["step"]][1]
            deadline = p["armed"] + wait
            if now is not None and now < deadline:
                return True
            if deadline - p["start"] > self.within_ms:
                return False
            p["step"], p["armed"] = p["step"] + 1, deadline
            if p["step"] == len(self.steps):
                out.append(self._emit(p, deadline))
                return False
        return now is not None

    def step(self, row: dict) -> list[dict]:
        now, names, out, kept = row[self.at], set(row["steps"] or ()), [], []
        for p in self.partials:
            if not self._settle(p, now, out) or now - p["start"] > self.within_ms:
                continue
            name, absent = self.steps[p["step"]]
            if name not in names:
                kept.append(p)
            elif absent is None:
                p = p | {"step": p["step"] + 1, "events": [*p["events"], row["arrival"]], "armed": now}
                if p["step"] == len(self.steps):
                    out.append(self._emit(p, now))
                else:
                    kept.append(p)
        if self.steps[0][0] in names:
            p = {"key": row["key"], "start": now, "step": 1, "events": [row["arrival"]], "armed": now}
            if len(self.steps) == 1:
                out.append(self._emit(p, now))
            else:
                kept.append(p)
        self.partials = kept[-self.most :]
        return out

    def finish(self) -> list[dict]:
        out: list[dict] = []
        for p in self.partials:
            self._settle(p, None, out)
        return out


class Regime(Fold):
    """Two-sided CUSUM over 0/1 outcomes. The first `warmup` outcomes set the mean; after an alarm a whole
    settling window sets it anew."""

    def __init__(self, delta: float = 0.05, limit: float = 5.0, warmup: int = 50, window: int = 50, value: str = "failed"):
        self.delta, self.limit, self.value, self.window = delta, limit, value, window
        self.need, self.seen, self.mean, self.up, self.down, self.settling = warmup, [], None, 0.0, 0.0, False

    def step(self, row: dict) -> list[dict]:
        x, before = float(row[self.value]), self.mean
        if self.mean is None:
            self.seen.append(x)
            if len(self.seen) < self.need:
                return []
            self.mean = sum(self.seen) / len(self.seen)
            self.seen, self.need, self.up, self.down = [], self.window, 0.0, 0.0
            self.settling = False
            return []
        self.up = max(0.0, self.up + x - before - self.delta / 2)
        self.down = max(0.0, self.down + before - x - self.delta / 2)
        if self.up <= self.limit and self.down <= self.limit:
            return []
        rising = self.up > self.limit
        self.mean, self.settling = None, True
        return [{"topic": row.get("topic"), "arrival": row.get("arrival"), "direction": "up" if rising else "down", "mean_before": before, "score": self.up if rising else self.down}]


class PartitionHealth(Fold):
    """Unhealthy once the failure share of the last `window` outcomes reaches `share` (with `least` seen); healthy
    again after `recover` successes in a row, not before the cooldown has passed."""

    def __init__(self, window: int = 20, least: int = 5, share: float = 0.5, recover: int = 3, cooldown_ms: int = 0, value: str = "failed", at: str = "at_ms"):
        self.share, self.least, self.recover, self.cooldown_ms, self.value, self.at = share, least, recover, cooldown_ms, value, at
        self.last, self.healthy, self.streak, self.since = deque(maxlen=window), True, 0, 0

    def step(self, row: dict) -> list[dict]:
        failed, now = bool(row[self.value]), row[self.at]
        self.last.append(failed)
        self.streak = 0 if failed else self.streak + 1
        if self.healthy and len(self.last) >= self.least and sum(self.last) >= self.share * len(self.last):
            self.healthy, self.since, self.streak = False, now, 0
        elif not self.healthy and self.streak >= self.recover and now - self.since >= self.cooldown_ms:
            self.healthy = True
            self.last.clear()
        return [row | {"healthy": self.healthy}]


class CompareAndSet(Fold):
    """Sets a key's value if the expected version (null: any) and value (null: any) are its own; no row is version 0."""

    def __init__(self):
        self.version, self.value = 0, None

    def step(self, row: dict) -> list[dict]:
        ok = row["expected_version"] in (None, self.version) and (row["expected_value"] is None or self.version > 0 and json.loads(row["expected_value"]) == json.loads(self.value))
        if ok:
            self.version, self.value = self.version + 1, row["value"]
        return [{"topic": row["topic"], "key": row["key"], "arrival": row["arrival"], "applied": ok, "version": self.version}]


class Patches(Fold):
    """Full values and JSON patches by version: a patch applies to the version before its own; an older one is
    stale, a newer one a gap."""

    def __init__(self):
        self.version, self.doc = 0, None

    def step(self, row: dict) -> list[dict]:
        if row["ops"] is None:
            self.version, self.doc, verdict = row["version"], json.loads(row["value"]), "full"
        elif row["version"] <= self.version:
            verdict = "stale"
        elif row["version"] > self.version + 1 or self.doc is None:
            verdict = "gap"
        else:
            try:
                self.doc, self.version, verdict = apply_patch(self.doc, json.loads(row["ops"])), row["version"], "applied"
            except (ValueError, KeyError, IndexError, TypeError):
                verdict = "failed"
        doc = None if self.doc is None else json.dumps(self.doc, sort_keys=True, separators=(",", ":"))
        return [{"key": row["key"], "arrival": row["arrival"], "verdict": verdict, "version": self.version, "doc": doc}]


class Causal(Fold):
    """Delivers a source's rows by clock from 0: early ones wait, those behind go out at once; when more than
    max_wait wait, the oldest of them is dropped."""

    def __init__(self, max_wait: int = 1000):
        self.next, self.wait, self.most = 0, {}, max_wait

    def _out(self, row: dict) -> dict:
        return {"source": row["source"], "clock": row["clock"], "arrival": row["arrival"]}

    def step(self, row: dict) -> list[dict]:
        clock, out = row["clock"], []
        if clock < self.next:
            return [self._out(row)]
        if clock > self.next:
            self.wait[clock] = row
            if len(self.wait) > self.most:
                del self.wait[min(self.wait, key=lambda c: self.wait[c]["arrival"])]
            return []
        out.append(self._out(row))
        self.next += 1
        while self.next in self.wait:
            out.append(self._out(self.wait.pop(self.next)))
            self.next += 1
        return out


class KeyReorder(Fold):
    """Gives a key's rows out in the order of key_seq from 1: early ones wait for those before them. A row whose
    `skipped` is true (filtered, shed, expired or cancelled) is not given out, but those behind it need not wait; one
    behind the order already given out goes out at once."""

    def __init__(self):
        self.next, self.wait = 1, {}

    def _out(self, row: dict, at: int) -> list[dict]:
        return [] if row["skipped"] else [{"key": row["key"], "key_seq": row["key_seq"], "arrival": row["arrival"], "released_at": at}]

    def step(self, row: dict) -> list[dict]:
        if row["key_seq"] < self.next:
            return self._out(row, row["arrival"])
        self.wait[row["key_seq"]], out = row, []
        while self.next in self.wait:
            out += self._out(self.wait.pop(self.next), row["arrival"])
            self.next += 1
        return out


class LaneDrain(Fold):
    """Drains a subscriber's queue of lanes in rounds of `budget` rows: passes of 8 urgent, 2 normal and 1 bulk while
    the budget lasts. A bulk lane that waits and gives nothing for `guard` rounds gives one row ahead of the next; a
    queue of one lane is drained plainly."""

    def __init__(self, budget: int, lanes: dict[str, int], guard: int = 10):
        self.budget, self.lanes, self.guard, self.rows = budget, lanes, guard, {name: deque() for name in lanes}

    def step(self, row: dict) -> list[dict]:
        self.rows[row["lane"]].append(row)
        return []

    def finish(self) -> list[dict]:
        out, n, starved, last = [], 0, 0, list(self.lanes)[-1]
        while any(self.rows.values()):
            n, left, taken = n + 1, self.budget, []
            waiting, one = bool(self.rows[last]), sum(map(bool, self.rows.values())) == 1

            def take(name: str, most: int) -> int:
                some = min(most, len(self.rows[name]))
                taken.extend(self.rows[name].popleft() for _ in range(some))
                return some

            if waiting and not one and starved + 1 >= self.guard:
                left -= take(last, 1)
            while left > 0 and any(self.rows.values()):
                for name, weight in self.lanes.items():
                    left -= take(name, left if one else min(weight, left))
            starved = 0 if not waiting or any(r["lane"] == last for r in taken) else starved + 1
            out += [r | {"round": n, "place": k + 1} for k, r in enumerate(taken)]
        return out


class EventTimeBuffer(Fold):
    """Releases rows in event-time order once the watermark has reached them or they were held max_hold_ms; late
    rows and those without a time pass at once. Ties go by arrival; what is left goes out at the end.

    Waiting rows are found by two heaps, of event times and of times of arrival, so that a row costs the logarithm of
    those that wait. A row that left by one heap is dead in the other; once most of a heap is dead, it is built anew."""

    def __init__(self, lateness_ms: int = 0, max_hold_ms: int = 60_000):
        self.lateness, self.hold, self.top, self.order = lateness_ms, max_hold_ms, None, 0
        self.rows, self.seen, self.times, self.ages = {}, 0, [], []

    def _out(self, row: dict) -> dict:
        self.order += 1
        return {"topic": row["topic"], "arrival": row["arrival"], "event_time_ms": row["event_time_ms"], "released": self.order}

    def _dead(self, heap: list[tuple]) -> bool:
        return bool(heap) and heap[0][-1] not in self.rows

    def _lean(self, heap: list[tuple]) -> list[tuple]:
        if len(heap) <= 2 * len(self.rows) + 64:
            return heap
        heap = [x for x in heap if x[-1] in self.rows]
        heapify(heap)
        return heap

    def _due(self, now: int | None) -> list[dict]:
        due = []
        while self.rows and (now is None or self._dead(self.times) or self.times[0][0] <= self.top - self.lateness):
            *_, n = heappop(self.times)
            if n in self.rows:
                due.append(self.rows.pop(n))
        held = False
        while self.ages and (self._dead(self.ages) or now is not None and now - self.ages[0][0] >= self.hold):
            _, n = heappop(self.ages)
            if n in self.rows:
                due.append(self.rows.pop(n))
                held = True
        if held:
            due.sort(key=lambda r: (r["event_time_ms"], r["arrival"]))
        self.times, self.ages = self._lean(self.times), self._lean(self.ages)
        return [self._out(r) for r in due]

    def step(self, row: dict) -> list[dict]:
        t, at = row["event_time_ms"], row["at_ms"]
        if t is None or self.top is not None and t < self.top - self.lateness:
            return [self._out(row)]
        self.seen += 1
        self.rows[self.seen] = row
        heappush(self.times, (t, row["arrival"], self.seen))
        heappush(self.ages, (at, self.seen))
        self.top = t if self.top is None else max(self.top, t)
        return self._due(at)

    def finish(self) -> list[dict]:
        return self._due(None)


class GreedyBytes(Fold):
    """Rows, newest first, that fit the bytes left; one that doesn't is skipped, and older ones may still fit."""

    def __init__(self, most: int):
        self.left = most

    def step(self, row: dict) -> list[dict]:
        fits = row["bytes"] <= self.left
        self.left -= row["bytes"] if fits else 0
        return [row | {"kept": fits}]


class BoundedStore(Fold):
    """Latest value for each key of a topic, at most max_keys of them: the least recently updated goes, and starts
    at version 1 when it comes back."""

    def __init__(self, max_keys: int):
        self.most, self.rows = max_keys, OrderedDict()

    def step(self, row: dict) -> list[dict]:
        if row["key"] is None:
            return []
        old = self.rows.pop(row["key"], None)
        self.rows[row["key"]] = {"topic": row["topic"], "key": row["key"], "value": row["value"], "seq": row["seq"], "version": old["version"] + 1 if old else 1}
        if len(self.rows) > self.most:
            self.rows.popitem(last=False)
        return []

    def finish(self) -> list[dict]:
        return list(self.rows.values())


class CircuitBreaker(Fold):
    """closed: after `most` rows in a row that found every subscriber degraded, open. open: rows are refused until the
    probe interval has passed; the next one is admitted as the probe, and closes or re-opens by what it finds."""

    def __init__(self, most: int, probe_ms: int, degraded: str = "degraded", at: str = "at_ms"):
        self.most, self.probe_ms, self.degraded, self.at = most, probe_ms, degraded, at
        self.streak, self.opened = 0, None

    def step(self, row: dict) -> list[dict]:
        now, bad = row[self.at], bool(row[self.degraded])
        if self.opened is not None and now - self.opened < self.probe_ms:
            return [row | {"admitted": False, "state": "open"}]
        self.streak = self.streak + 1 if bad else 0
        reopen = bad and (self.opened is not None or self.streak >= self.most)
        self.opened = now if reopen else None
        return [row | {"admitted": True, "state": "open" if reopen else "closed"}]


class SlowStart(Fold):
    """Delivers a row if the ramp has a token for it; tokens refill at the ramp's rate, and keep one second's worth."""

    def __init__(self, initial: float, ramp_ms: int, target: float | None = None, strategy: str = "linear", at: str = "at_ms"):
        self.initial, self.ramp_ms, self.target, self.strategy, self.at = initial, ramp_ms, target, strategy, at
        self.tokens, self.start, self.last = float(initial), None, None

    def rate(self, now: int) -> float:
        t, end = max(0, now - self.start) / self.ramp_ms, 2 * self.initial if self.target is None else self.target
        if t >= 1:
            return float("inf") if self.target is None else float(self.target)
        return self.initial + (end - self.initial) * t if self.strategy == "linear" else self.initial * (end / self.initial) ** t

    def step(self, row: dict) -> list[dict]:
        now = row[self.at]
        self.start, before = (now, now) if self.start is None else (self.start, self.last)
        rate = self.rate(now)
        self.last = max(now, before)
        if rate == float("inf"):
            return [row | {"admitted": True}]
        self.tokens = min(max(1.0, rate), self.tokens + max(0, now - before) * rate / 1000)
        ok = self.tokens >= 1
        self.tokens -= ok
        return [row | {"admitted": bool(ok)}]


class BoundedSessions(Fold):
    """Counts of sessions by key, of which at most `most` are open over all keys: the one that was active the longest
    ago is given out when another needs its place. A row at exactly the gap begins a new session."""

    def __init__(self, gap_ms: int, most: int = 1024, ident: str = "key", at: str = "at_ms"):
        self.gap_ms, self.most, self.ident, self.at, self.open = gap_ms, most, ident, at, OrderedDict()

    def _out(self, key: str) -> dict:
        start, end, n = self.open.pop(key)
        return {self.ident: key, "session_start": start, "session_end": end, "count": n}

    def step(self, row: dict) -> list[dict]:
        key, now, out = row[self.ident], row[self.at], []
        while self.open and now - next(iter(self.open.values()))[1] >= self.gap_ms:
            out.append(self._out(next(iter(self.open))))
        if key not in self.open and len(self.open) >= self.most:
            out.append(self._out(next(iter(self.open))))
        start, _, n = self.open.pop(key, (now, now, 0))
        self.open[key] = (start, now, n + 1)
        return out

    def finish(self) -> list[dict]:
        return [self._out(k) for k in list(self.open)]
