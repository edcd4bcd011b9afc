"""Chat formatting with linked tool calls."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_stats, bounded_batches, slices, written

#: Calls and needs of a conversation that are ordered in one task; larger conversations are ordered in rounds, one
#: for each step of their longest chain.
LOCAL_CALLS = 5_000
_PARSED = "conv_id long, turn long, part int, kind string, call_id string, valid boolean, needs array<string>, json string"
_ARROW = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.string()]
# JSON schema's names of types, and what stands for them here.
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float)}
_LONE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, and letters as they are; half a surrogate pair stays an escape."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


def _finite(text: str) -> float:
    value = float(text)
    return value if abs(value) != float("inf") else _refuse(text)


def loads(text: str):
    """The value of a JSON text; ValueError or RecursionError if it isn't one, or is nested too deep to be read or written."""
    value = json.loads(text, parse_constant=_refuse, parse_float=_finite)
    json.dumps(value)
    return value


def identifier(value: str) -> str:
    """The identifier as text that can be stored: as it is, or its JSON where it holds half a surrogate pair or begins with a quote."""
    return json.dumps(value) if value[:1] == '"' or _LONE.search(value) else value


def _is(value, kind) -> bool:
    if isinstance(value, bool) and kind in ("integer", "number"):
        return False
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(kind, str) and isinstance(value, TYPES.get(kind, ()))


def _plain(value):
    """A number as the integer that it equals, if any; compared by canonical JSON, true is then not 1, and 1.0 is."""
    return json.loads(json.dumps(value), parse_float=lambda x: int(float(x)) if float(x).is_integer() else float(x))


def fits(value, schema) -> bool:
    """Whether a value meets a schema's type (or types), enum, required, properties, additionalProperties and items.

    A schema may be true or false for anything or nothing; a type without a meaning fits nothing; other keywords are ignored.
    """
    todo = [(value, schema)]
    while todo:
        value, schema = todo.pop()
        if schema is True:
            continue
        if not isinstance(schema, dict):
            return False
        if "type" in schema and not any(_is(value, k) for k in (schema["type"] if isinstance(schema["type"], list) else [schema["type"]])):
            return False
        if "enum" in schema and canonical(_plain(value)) not in {canonical(_plain(x)) for x in schema["enum"]}:
            return False
        if isinstance(value, dict):
            own = schema.get("properties", {})
            if any(k not in value for k in schema.get("required", ())):
                return False
            more = schema.get("additionalProperties", True)
            todo += [(v, own.get(k, more)) for k, v in value.items()]
        elif isinstance(value, list):
            todo += [(v, schema.get("items", True)) for v in value]
    return True


def _needs(value) -> set[str]:
    """Calls whose results the arguments refer to, as {"$result": id}."""
    found, todo = set(), [value]
    while todo:
        value = todo.pop()
        if isinstance(value, dict):
            if isinstance(value.get("$result"), str):
                found.add(identifier(value["$result"]))
            todo += value.values()
        elif isinstance(value, list):
            todo += value
    return found


def parse(role: str | None, text: str | None, schemas: dict) -> list[tuple]:
    """(kind, call_id, valid, needs, json) for each part of a turn.

    An assistant's text that is {"tool_calls": [{"id", "name", "arguments"}...]} is a part for each call; a
    tool's text {"tool_call_id", "content"} is a result; anything else is a message.
    """
    try:
        value = loads(text) if text and text.lstrip()[:1] == "{" and role in ("assistant", "tool") else None
    except (ValueError, RecursionError):
        value = None
    if role == "assistant" and isinstance(value, dict) and isinstance(calls := value.get("tool_calls"), list) and calls and all(isinstance(c, dict) for c in calls):
        out = []
        for c in calls:
            name, arguments, own = c.get("name"), c.get("arguments"), isinstance(c.get("id"), str)
            ok = own and isinstance(name, str) and name in schemas and isinstance(arguments, dict) and fits(arguments, schemas[name])
            out.append(("call", identifier(c["id"]) if own else None, ok, sorted(_needs(arguments)), canonical({"role": role, "tool_call": {"arguments": arguments, "id": c.get("id"), "name": name}})))
        return out
    if role == "tool" and isinstance(value, dict) and isinstance(value.get("tool_call_id"), str):
        return [("result", identifier(value["tool_call_id"]), True, [], canonical({"content": value.get("content"), "role": role, "tool_call_id": value["tool_call_id"]}))]
    return [("message", None, True, [], canonical({"content": text, "role": role}))]


def _parse(schemas: dict):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for conv, turn, role, text in zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                    rows += [(conv, turn, place, *p) for place, p in enumerate(parse(role, text, schemas))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], ["conv_id", "turn", "part", "kind", "call_id", "valid", "needs", "json"])

    return run


def levels(calls: dict[str, tuple[int | None, list[str]]]) -> dict[str, tuple[int, int | None]]:
    """call -> (level, turn at the earliest), from call -> (turn, needs); calls in or behind a cycle are left out."""
    needs = {c: {n for n in own if n in calls} for c, (_, own) in calls.items()}
    users: dict[str, list[str]] = {}
    for c, own in needs.items():
        for n in own:
            users.setdefault(n, []).append(c)
    lacks = {c: len(own) for c, own in needs.items()}
    done = {c: (0, calls[c][0]) for c, n in lacks.items() if not n}
    todo = list(done)
    for c in todo:
        for user in users.get(c, ()):
            lacks[user] -= 1
            if not lacks[user]:
                own = [done[n] for n in needs[user]]
                turns = [t for t in (calls[user][0], *(t for _, t in own)) if t is not None]
                done[user] = 1 + max(x for x, _ in own), max(turns, default=None)
                todo.append(user)
    return done


_DONE = "conv_id long, call_id string, call_turn long, level int"


def _order(batches):
    """Rows sorted by conv_id: the levels of one conversation's calls after another."""
    rows = ((c, i, t, n) for b in batches for c, i, t, n in zip(*(b.column(x).to_pylist() for x in ("conv_id", "call_id", "call_turn", "needs")), strict=True))
    for conv, own in groupby(rows, lambda r: r[0]):
        found = levels({i: (t, n) for _, i, t, n in own})
        if found:
            ids, both = list(found), list(found.values())
            yield pa.RecordBatch.from_arrays([pa.array([conv] * len(ids), pa.int64()), pa.array(ids), pa.array([t for _, t in both], pa.int64()), pa.array([x for x, _ in both], pa.int32())], ["conv_id", "call_id", "call_turn", "level"])


def _in_rounds(calls: DataFrame) -> DataFrame:
    """Levels of the calls of conversations too large for a task: each round settles those whose needs are settled.

    A need meets its call in the one round after that call's; only calls that still wait are written again.
    """
    key = ["conv_id", "call_id"]
    edges = calls.select(*key, F.explode(F.array_distinct("needs")).alias("need")).join(calls.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_semi")
    edges = written(edges, "needs")
    counts = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("lacks"))
    waiting = calls.select(*key, "call_turn").join(counts, key, "left").select(*key, "call_turn", F.coalesce("lacks", F.lit(0)).cast("long").alias("lacks"))
    waiting, level, done = written(waiting, "waiting"), 0, []
    while True:
        new = waiting.where("lacks = 0").select(*key, "call_turn", F.lit(level).alias("level"))
        if new.isEmpty():
            break
        done.append(new)
        met = edges.join(new.select("conv_id", F.col("call_id").alias("need"), F.col("call_turn").alias("t")), ["conv_id", "need"])
        met = met.groupBy(*key).agg(F.count(F.lit(1)).alias("met"), F.max("t").alias("t"))
        waiting = waiting.where("lacks > 0").join(met, key, "left").select(*key, F.greatest("call_turn", "t").alias("call_turn"), (F.col("lacks") - F.coalesce("met", F.lit(0))).alias("lacks"))
        waiting, level = written(waiting, "waiting"), level + 1
    out = calls.select(*key, "call_turn", F.lit(0).alias("level")).limit(0)
    for part in done:
        out = out.union(part)
    return out


def format_chats(turns: DataFrame, schemas: dict | None = None, local: int = LOCAL_CALLS, salts: int = 16) -> DataFrame:
    """conv_id, turn, part, kind, call_id, linked, valid, level, place_turn, json: a row for each part of each turn.

    Calls and results meet in a hash join by (conv_id, identifier). A result's place is not before its call's,
    nor a call's before those whose results its arguments refer to: sort a conversation by (place_turn,
    level, turn, part). level is 0 for messages and independent calls, one more than the deepest need for a call, and
    one half step (2 level + 1 for results, 2 level for the rest) keeps results behind calls. Calls in or behind a
    cycle have a null level and aren't valid; so are calls without a known schema, or whose arguments don't fit it.

    A conversation with at most `local` calls and needs is ordered within one task, a larger one in rounds over all
    tasks; both give the same. Messages go straight through.

    A null text is a message with null content; text that isn't JSON, holds a number beyond double precision's range,
    or is nested too deep to be read is a message; half a surrogate pair stays an escape. Null conv_id and turn are
    kept, and a null conv_id never links; of calls that share an identifier the first (turn, part) counts, a null turn
    first; a result without a call isn't linked; repeated rows appear each; no rows give no rows; other columns are
    ignored.
    """
    bounded_batches(turns.sparkSession)
    parsed = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(_parse(schemas or {}), _PARSED)
    parsed = written(parsed, "turns")
    key = ["conv_id", "call_id"]
    calls = parsed.where("kind = 'call' and call_id is not null and conv_id is not null").groupBy(*key).agg(F.min(F.struct("turn", "part", "needs")).alias("c"))
    calls = calls.select(*key, F.col("c.turn").alias("call_turn"), F.col("c.needs").alias("needs"), F.size("c.needs").alias("n"))
    calls = written(attach_stats(calls, ["conv_id"], F.col("call_id"), n_calls=("count", "n"), n_needs=("sum", "n")), "calls")
    alone = calls.where("n_needs = 0").select(*key, "call_turn", F.lit(0).alias("level"))
    small = calls.where((F.col("n_needs") > 0) & (F.col("n_calls") + F.col("n_needs") <= local)).select(*key, "call_turn", "needs")
    done = alone.union(small.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(_order, _DONE))
    large = calls.where((F.col("n_needs") > 0) & (F.col("n_calls") + F.col("n_needs") > local)).select(*key, "call_turn", "needs")
    if not large.isEmpty():
        done = done.union(_in_rounds(written(large, "large")))
    # a conversation's parts with one identifier are dealt over salts
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    results = parsed.where("kind = 'result'").select(*key).distinct().withColumn("answered", F.lit(True))
    known = done.join(results, key, "left").select(*key, "call_turn", "level", F.lit(True).alias("met"), "answered", salt)
    parts = parsed.where("kind <> 'message'").withColumn("salt", F.pmod(F.xxhash64("turn", "part", "json"), F.lit(salts)).cast("int"))
    out = parts.join(known, [*key, "salt"], "left")
    messages = parsed.where("kind = 'message'").select(*parsed.columns, *(F.lit(None).cast(out.schema[c].dataType).alias(c) for c in ("call_turn", "level", "met", "answered")))
    out = messages.unionByName(out.drop("salt"))
    met = F.coalesce("met", F.lit(False))
    level = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "call", 2 * F.col("level")).otherwise(F.coalesce(2 * F.col("level") + 1, F.lit(1)))
    return out.select(
        "conv_id", "turn", "part", "kind", "call_id",
        F.when(F.col("kind") == "result", met).when(F.col("kind") == "call", F.coalesce("answered", F.lit(False))).alias("linked"),
        (F.col("valid") & ((F.col("kind") != "call") | met)).alias("valid"), level.cast("int").alias("level"),
        F.greatest("turn", F.coalesce("call_turn", "turn")).alias("place_turn"), "json",
    )
