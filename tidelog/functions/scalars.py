"""Scalar functions that Spark doesn't have under one name."""

from __future__ import annotations

import json
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# The offset basis and prime of the 32-bit FNV hash.
FNV_OFFSET, FNV_PRIME = 0x811C9DC5, 0x01000193


def stable_hash(x: Column) -> Column:
    """A hash of 60 bits that any system with MD5 can tell: of the value as text, its first 15 hexadecimal digits."""
    return F.conv(F.substring(F.md5(x.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def millis(ts: str | Column) -> Column:
    """Epoch milliseconds of a timestamp without zone, read as UTC."""
    return F.unix_millis((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def fnv1a32(data: bytes, start: int = FNV_OFFSET) -> int:
    h = start
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFF
    return h


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def field_paths(value) -> list[str]:
    """Sorted distinct paths of a JSON value's fields; the members of a list stand under `[]`."""
    found: set[str] = set()

    def walk(v, path: str) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                found.add(p := f"{path}.{k}" if path else k)
                walk(x, p)
        elif isinstance(v, list):
            for x in v:
                walk(x, f"{path}[]")
                if not isinstance(x, (dict, list)):
                    found.add(f"{path}[]")

    walk(value, "")
    return sorted(found)


def path_drift(old: Column, new: Column) -> Column:
    """Paths that a payload's shape has gained and lost, each sorted."""
    return F.struct(F.array_sort(F.array_except(new, old)).alias("added"), F.array_sort(F.array_except(old, new)).alias("removed"))


def fingerprint(paths: list[str]) -> str:
    """FNV-1a over the paths, each closed by 0xff, as eight hexadecimal digits."""
    h = FNV_OFFSET
    for p in paths:
        h = fnv1a32(p.encode() + b"\xff", h)
    return f"{h:08x}"


def pointer(text: str) -> list[str]:
    """The tokens of a JSON pointer."""
    if text and not text.startswith("/"):
        raise ValueError(f"not a JSON pointer: {text!r}")
    return [t.replace("~1", "/").replace("~0", "~") for t in text.split("/")[1:]]


def apply_patch(doc, ops: list[dict]):
    """RFC 6902's add, remove and replace, in order; a bad step raises and leaves doc as it was."""
    doc = json.loads(json.dumps(doc))
    for op in ops:
        if op["op"] not in ("add", "remove", "replace"):
            raise ValueError(f"unsupported op {op['op']!r}")
        tokens = pointer(op["path"])
        if not tokens:
            if op["op"] == "remove":
                raise ValueError("the whole document can't be removed")
            doc = op["value"]
            continue
        at = doc
        for t in tokens[:-1]:
            at = at[int(t)] if isinstance(at, list) else at[t]
        last = tokens[-1]
        if isinstance(at, list):
            i = len(at) if last == "-" and op["op"] == "add" else int(last)
            if i < 0 or i > len(at) or i == len(at) and op["op"] != "add":
                raise ValueError(f"no such index {last}")
            if op["op"] == "add":
                at.insert(i, op["value"])
            elif op["op"] == "remove":
                del at[i]
            else:
                at[i] = op["value"]
        else:
            if op["op"] != "add" and last not in at:
                raise ValueError(f"no such member {last}")
            if op["op"] == "remove":
                del at[last]
            else:
                at[last] = op["value"]
    return doc


# Names that a cron field may use.
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
DAYS = ["SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT"]


class Cron:
    """Five fields in UTC: minute, hour, day of month (L: the last), month, day of week (0 or 7: Sunday)."""

    def __init__(self, text: str):
        fields = text.split()
        if len(fields) != 5:
            raise ValueError(f"five fields are needed: {text!r}")
        self.last_day = fields[2].upper() == "L"
        spans = ((0, 59, []), (0, 23, []), (1, 31, []), (1, 12, MONTHS), (0, 7, DAYS))
        self.any_day, self.any_weekday = fields[2] == "*", fields[4] == "*"
        minute, hour, day, month, weekday = (set() if k == 2 and self.last_day else self._field(f, *spans[k]) for k, f in enumerate(fields))
        self.minute, self.hour, self.day, self.month, self.weekday = minute, hour, day, month, {d % 7 for d in weekday}

    @staticmethod
    def _field(text: str, low: int, high: int, names: list[str]) -> set[int]:
        def value(s: str) -> int:
            n = names.index(s.upper()) + (low if low else 0) if s.upper() in names else int(s)
            if not low <= n <= high:
                raise ValueError(f"{s} is not within {low} to {high}")
            return n

        out: set[int] = set()
        for part in text.split(","):
            span, _, step = part.partition("/")
            a, _, b = span.partition("-")
            first = low if a == "*" else value(a)
            last = high if a == "*" or step and not b else value(b) if b else first
            if last < first or step and int(step) < 1:
                raise ValueError(f"bad range {part!r}")
            out.update(range(first, last + 1, int(step or 1)))
        return out

    def _day_fits(self, d: datetime) -> bool:
        in_month = (d + timedelta(days=1)).day == 1 if self.last_day else d.day in self.day
        in_week = (d.weekday() + 1) % 7 in self.weekday
        if self.any_weekday or (self.any_day and not self.last_day):
            return in_month and in_week
        return in_month or in_week

    def next_after(self, at_ms: int) -> int | None:
        """The first occurrence strictly later, or None if there is none within five years."""
        d = datetime.fromtimestamp(at_ms // 60_000 * 60, UTC) + timedelta(minutes=1)
        end = d + timedelta(days=5 * 366)
        while d < end:
            if d.month not in self.month or not self._day_fits(d):
                d = (d + timedelta(days=1)).replace(hour=0, minute=0)
            elif d.hour not in self.hour:
                d = (d + timedelta(hours=1)).replace(minute=0)
            elif d.minute not in self.minute:
                d += timedelta(minutes=1)
            else:
                return int(d.timestamp()) * 1000
        return None


def in_delivery_window(at_ms: int, start: str, end: str, zone: str = "UTC", days: set[int] | None = None) -> bool:
    """Whether a time is in HH:MM-HH:MM of a zone; overnight windows belong to the day they begin on; equal ends: the whole day."""
    d = datetime.fromtimestamp(at_ms / 1000, ZoneInfo(zone))
    now, a, b = d.hour * 60 + d.minute, *(int(x[:2]) * 60 + int(x[3:]) for x in (start, end))
    today = (d.weekday() + 1) % 7
    allowed = lambda day: days is None or day in days
    if a == b:
        return allowed(today)
    if a < b:
        return a <= now < b and allowed(today)
    return now >= a and allowed(today) or now < b and allowed((today + 6) % 7)


def next_open(at_ms: int, windows: list[dict]) -> int | None:
    """The first minute from at_ms on that is in one of the windows, within eight days."""
    if any(in_delivery_window(at_ms, **w) for w in windows):
        return at_ms
    minute = at_ms // 60_000 * 60_000
    for k in range(1, 8 * 24 * 60 + 1):
        if any(in_delivery_window(minute + k * 60_000, **w) for w in windows):
            return minute + k * 60_000
    return None


def hlc(pt: Column, logical: Column, node: Column) -> Column:
    """A hybrid logical clock's reading; structs compare field by field, as the clock orders them."""
    return F.struct(pt.alias("pt"), logical.alias("l"), node.alias("node"))


def hlc_tick(last: tuple[int, int], now: int, remote: tuple[int, int] | None = None) -> tuple[int, int]:
    """The next reading (pt, l) after a local event, or after a remote reading came in."""
    pt = max(last[0], now, remote[0] if remote else 0)
    counters = [x[1] for x in (last, remote) if x and x[0] == pt]
    return pt, max(counters) + 1 if counters else 0


def redelivery_delay(attempt: Column, base_ms: int, cap_ms: int) -> Column:
    """min(cap, base * 2^(attempt - 1))."""
    return F.least(F.lit(cap_ms).cast("double"), F.lit(base_ms) * F.pow(F.lit(2.0), attempt - 1)).cast("long")


def traceparent(text: Column) -> Column:
    """version, trace, span and flags of a traceparent header, null if malformed."""
    pattern = "^([0-9a-f]{2})-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})$"
    good = text.rlike(pattern) & ~text.rlike("^..-0{32}") & ~text.rlike("-0{16}-..$") & ~text.startswith("ff")
    return F.when(good, F.struct(*[F.regexp_extract(text, pattern, i).alias(n) for i, n in ((2, "trace_id"), (3, "span_id"), (4, "flags"))]))
