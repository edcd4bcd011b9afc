"""Topic patterns: `*` is one segment, `**` any number of them; a lone `*` is any topic."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache
def to_regex(pattern: str) -> str:
    """An anchored regular expression that Java and RE2 read alike."""
    if pattern in ("*", "**"):
        return "^.*$"
    parts = pattern.split(".")
    squeezed = [p for i, p in enumerate(parts) if p != "**" or i == 0 or parts[i - 1] != "**"]
    if squeezed == ["**"]:
        return "^.*$"
    out = ""
    for i, p in enumerate(squeezed):
        if p == "**":
            # with the dot that goes with it: no segment leaves no dot behind
            out += r"([^.]+\.)*" if i == 0 else r"(\.[^.]+)*"
        else:
            dot = r"\." if i and not (i == 1 and squeezed[0] == "**") else ""
            out += dot + (r"[^.]+" if p == "*" else re.escape(p))
    return f"^{out}$"


@lru_cache
def literal_prefix(pattern: str) -> str:
    """What every matching topic begins with, up to the first wildcard."""
    out = []
    for p in pattern.split("."):
        if p in ("*", "**"):
            # one segment needs its dot; any number of them may need none
            return ".".join(out) + ("." if p == "*" and out else "")
        out.append(p)
    return pattern


def topic_matches(topic: Column, pattern: str) -> Column:
    """A literal is compared; a wildcard adds a prefix test, which the scan can use, to the expression."""
    if literal_prefix(pattern) == pattern:
        return topic == pattern
    prefix = literal_prefix(pattern)
    full = topic.rlike(to_regex(pattern))
    return topic.startswith(prefix) & full if prefix else full


def any_matches(topic: Column, patterns: list[str]) -> Column:
    return _fold([topic_matches(topic, p) for p in patterns], lambda a, b: a | b, False)


def composite_matches(topic: Column, include: list[str], exclude: list[str] = (), mode: str = "any") -> Column:
    """Any or all of the included patterns, and none of the excluded ones."""
    hits = [topic_matches(topic, p) for p in include]
    inside = _fold(hits, lambda a, b: a | b, False) if mode == "any" else _fold(hits, lambda a, b: a & b, True)
    return inside & ~any_matches(topic, list(exclude))


def _fold(columns: list[Column], f, empty: bool) -> Column:
    out = columns[0] if columns else F.lit(empty)
    for c in columns[1:]:
        out = f(out, c)
    return out


def rename_template(topic: Column, pattern: str, template: str) -> Column:
    """The topic under another name: $1, $2 ... stand for what the pattern's wildcards matched."""
    groups = "^" + r"\.".join("(.*)" if p == "**" else "([^.]+)" if p == "*" else re.escape(p) for p in pattern.split(".")) + "$"
    return F.when(topic.rlike(groups), F.regexp_replace(topic, groups, template))
