"""A small predicate language over payloads, compiled to a column.

or := and ("||" and)*      and := unary ("&&" unary)*      unary := "!" unary | primary
primary := "(" or ")" | "exists" "(" path ")" | path "exists" | path op literal
op := == != > >= < <= =~   path := name ("." name | "[" digits "]")*

Logic has two values: a missing field makes every comparison false but `!=`, which it makes true. Types are
never converted. A JSON null exists and equals null. Errors are raised when compiled, never when evaluated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LENGTH = 65_536
_TOKEN = re.compile(r"""\s*(?:(?P<name>[A-Za-z_$][A-Za-z0-9_$]*)|(?P<number>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<op>\|\||&&|==|!=|=~|>=|<=|[<>!().\[\]]))""", re.S)
_REGEX = re.compile(r"\s*/((?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+)/([a-z]*)")
# Escapes of string literals.
_ESCAPES = {"\\": "\\", "'": "'", '"': '"', "n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}


@dataclass(frozen=True)
class Node:
    kind: str  # or, and, not, exists, compare
    args: tuple


def _unescape(text: str, at: int) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1], 16))
        if m[2] not in _ESCAPES:
            raise ValueError(f"bad escape \\{m[2]} at {at}")
        return _ESCAPES[m[2]]

    return re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", one, text, flags=re.S)


class Parser:
    def __init__(self, text: str):
        if not isinstance(text, str) or len(text) > MAX_LENGTH:
            raise ValueError(f"an expression has at most {MAX_LENGTH} characters")
        self.text, self.at = text, 0

    def fail(self, what: str):
        raise ValueError(f"{what} at {self.at}")

    def peek(self) -> tuple[str, str]:
        m = _TOKEN.match(self.text, self.at)
        return (m.lastgroup, m[m.lastgroup]) if m else ("end", "")

    def take(self, kind: str | None = None, value: str | None = None) -> str:
        m = _TOKEN.match(self.text, self.at)
        if not m or kind and m.lastgroup != kind or value is not None and m[m.lastgroup] != value:
            self.fail(f"expected {value or kind or 'more'}")
        self.at = m.end()
        return m[m.lastgroup]

    def parse(self) -> Node:
        out = self.either()
        if self.text[self.at :].strip():
            self.fail("unexpected text")
        return out

    def either(self) -> Node:
        out = self.both()
        while self.peek() == ("op", "||"):
            self.take()
            out = Node("or", (out, self.both()))
        return out

    def both(self) -> Node:
        out = self.unary()
        while self.peek() == ("op", "&&"):
            self.take()
            out = Node("and", (out, self.unary()))
        return out

    def unary(self) -> Node:
        if self.peek() == ("op", "!"):
            self.take()
            return Node("not", (self.unary(),))
        return self.primary()

    def primary(self) -> Node:
        if self.peek() == ("op", "("):
            self.take()
            out = self.either()
            self.take("op", ")")
            return out
        if self.peek() == ("name", "exists"):
            self.take()
            self.take("op", "(")
            path = self.path()
            self.take("op", ")")
            return Node("exists", (path,))
        path = self.path()
        if self.peek() == ("name", "exists"):
            self.take()
            return Node("exists", (path,))
        op = self.take("op")
        if op == "=~":
            m = _REGEX.match(self.text, self.at)
            if not m:
                self.fail("expected a regular expression")
            if set(m[2]) - set("imsu") or len(set(m[2])) < len(m[2]):
                self.fail(f"unsupported flags {m[2]!r}")
            self.at = m.end()
            try:
                re.compile(m[1])
            except re.error as e:
                self.fail(f"bad regular expression ({e})")
            return Node("compare", (path, op, (f"(?{flags})" if (flags := m[2].replace("u", "")) else "") + m[1]))
        if op not in ("==", "!=", ">", ">=", "<", "<="):
            self.fail(f"{op} is no comparison")
        return Node("compare", (path, op, self.literal()))

    def path(self) -> tuple[str | int, ...]:
        out: list[str | int] = [self.take("name")]
        while True:
            kind, value = self.peek()
            if (kind, value) == ("op", "."):
                self.take()
                out.append(self.take("name"))
            elif (kind, value) == ("op", "["):
                self.take()
                digits = self.take("number")
                if not digits.isdigit():
                    self.fail("an index has digits only")
                out.append(int(digits))
                self.take("op", "]")
            else:
                return tuple(out)

    def literal(self):
        kind, value = self.peek()
        start = self.at
        self.take()
        if kind == "number":
            return float(value)
        if kind == "string":
            return _unescape(value[1:-1], start)
        if kind == "name" and value in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[value]
        self.at = start
        self.fail("expected a literal")


class VariantField:
    """A path in a VARIANT column."""

    def __init__(self, payload: str, path: tuple):
        self.json_path = "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path)
        self.payload = payload
        self.value = F.try_variant_get(F.col(payload), self.json_path, "variant")
        self.kind = F.schema_of_variant(self.value)

    def exists(self) -> Column:
        return self.value.isNotNull()

    def is_null(self) -> Column:
        return F.is_variant_null(self.value)

    def of(self, kind: type) -> Column:
        """The value if it is of that kind, else null."""
        fits = {float: self.kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), str: self.kind == "STRING", bool: self.kind == "BOOLEAN"}[kind]
        return F.when(fits, F.try_variant_get(F.col(self.payload), self.json_path, {float: "double", str: "string", bool: "boolean"}[kind]))


class PlainField:
    """A column of a known type: the predicate stays plain, so that it reaches the scan."""

    def __init__(self, column: Column, kind: type):
        self.column, self.kind = column, kind

    def exists(self) -> Column:
        return self.column.isNotNull()

    def is_null(self) -> Column:
        return F.lit(False)

    def of(self, kind: type) -> Column:
        return self.column if kind is self.kind else F.lit(None)


def _compare(field, op: str, literal) -> Column:
    plain = isinstance(field, PlainField) and (field.kind is type(literal) or op == "=~" and field.kind is str)

    def sure(c: Column) -> Column:
        """Two-valued; for a plain column in a form that the scan understands."""
        return field.exists() & c if plain else F.coalesce(c, F.lit(False))

    if op in ("==", "!="):
        equal = field.is_null() if literal is None else field.of(type(literal)) == F.lit(literal)
        return sure(equal) if op == "==" else ~sure(equal)
    if op == "=~":
        return sure(field.of(str).rlike(literal))
    if literal is None or isinstance(literal, bool):
        return F.lit(False)
    value, other = field.of(type(literal)), F.lit(literal)
    if isinstance(literal, str) and (not literal.isascii() or isinstance(field, VariantField)):
        value, other = F.encode(value, "UTF-16BE"), F.encode(other, "UTF-16BE")  # order of UTF-16 code units
    test = {">": value > other, ">=": value >= other, "<": value < other, "<=": value <= other}[op]
    return sure(test & ~F.isnan(value) if isinstance(literal, float) else test)


def compile_filter(text: str, payload: str = "payload", columns: dict[str, PlainField] | None = None) -> Column:
    """A boolean column, never null. `columns` names first segments that are plain columns."""
    known = columns or {}

    def field(path: tuple):
        return known[path[0]] if len(path) == 1 and path[0] in known else VariantField(payload, path)

    def build(n: Node) -> Column:
        if n.kind == "or":
            return build(n.args[0]) | build(n.args[1])
        if n.kind == "and":
            return build(n.args[0]) & build(n.args[1])
        if n.kind == "not":
            return ~build(n.args[0])
        if n.kind == "exists":
            return field(n.args[0]).exists()
        return _compare(field(n.args[0]), *n.args[1:])

    return build(Parser(text).parse())


def filter_versions(versions: list[tuple[int, str]], at: Column, **how) -> tuple[Column, Column]:
    """(stamp, keep) for versions [(created_at_ms, expression)...]: a row is stamped with the last version created
    by its time, 0 before the first, and kept if that version's predicate holds; version 0 keeps all."""
    stamp, keep = F.lit(0), F.lit(True)
    for n, (created, text) in enumerate(versions, 1):
        now = at >= created
        stamp, keep = F.when(now, n).otherwise(stamp), F.when(now, compile_filter(text, **how)).otherwise(keep)
    return stamp, keep


def header_filter(rules: list[tuple[str, str, str]], headers: str = "headers") -> Column:
    """All rules (name, eq|ne|prefix|regex, value); a missing header fails every one, ne too."""
    out = F.lit(True)
    for name, op, value in rules:
        h = F.try_element_at(F.col(headers), F.lit(name))
        test = {"eq": h == value, "ne": h != value, "prefix": h.startswith(value), "regex": h.rlike(value)}[op]
        out = out & h.isNotNull() & F.coalesce(test, F.lit(False))
    return out


def key_range(key: Column, start: str | None = None, end: str | None = None) -> Column:
    """[start, end) of keys; rows without a key never match."""
    out = key.isNotNull()
    out = out & (key >= start) if start is not None else out
    return out & (key < end) if end is not None else out
