"""Rule conditions: expression trees that compile to Catalyst columns.

A condition is data: build it with the small algebra here or read it from JSON.  Compiling
gives the value (NULL stands for "absent") and the names of the fields that were looked at,
which, as ``and`` and ``or`` stop early, depends on the row.  All rules of a run are
compiled into one projection; nothing is interpreted per row.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPARISONS = ("==", "!=", ">", ">=", "<", "<=")
_NONE: list[str] = []


@dataclass(frozen=True)
class Condition:
    """A node as the JSON object that stores it."""

    node: dict

    def to_json(self) -> str:
        return json.dumps(self.node, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Condition:
        return Condition(json.loads(text))

    def _compare(self, op: str, other: Any) -> Condition:
        return Condition({"type": "comparison", "operator": op, "left": self.node, "right": _node(other)})

    def __gt__(self, other: Any) -> Condition:
        return self._compare(">", other)

    def __ge__(self, other: Any) -> Condition:
        return self._compare(">=", other)

    def __lt__(self, other: Any) -> Condition:
        return self._compare("<", other)

    def __le__(self, other: Any) -> Condition:
        return self._compare("<=", other)

    def equals(self, other: Any) -> Condition:
        return self._compare("==", other)

    def differs(self, other: Any) -> Condition:
        return self._compare("!=", other)

    def _arith(self, op: str, other: Any) -> Condition:
        return Condition({"type": "arith", "operator": op, "left": self.node, "right": _node(other)})

    def __add__(self, other: Any) -> Condition:
        return self._arith("+", other)

    def __sub__(self, other: Any) -> Condition:
        return self._arith("-", other)

    def __mul__(self, other: Any) -> Condition:
        return self._arith("*", other)

    def __truediv__(self, other: Any) -> Condition:
        return self._arith("/", other)

    def __invert__(self) -> Condition:
        return Condition({"type": "not", "operand": self.node})

    def in_set(self, values: list) -> Condition:
        return call("in_set", self, values)

    def given(self) -> Condition:
        return call("not_null", self)

    def malformed(self) -> Condition:
        return call("field_error", self)

    def upper(self) -> Condition:
        return call("upper", self)

    def lower(self) -> Condition:
        return call("lower", self)


def _node(x: Any) -> dict:
    return x.node if isinstance(x, Condition) else {"type": "literal", "value": x}


def call(name: str, *args: Any) -> Condition:
    return Condition({"type": "func", "name": name, "args": [_node(a) for a in args]})


def all_of(*parts: Condition) -> Condition:
    return Condition({"type": "and", "operands": [p.node for p in parts]})


def any_of(*parts: Condition) -> Condition:
    return Condition({"type": "or", "operands": [p.node for p in parts]})


def field(name: str) -> Condition:
    return Condition({"type": "field", "name": name})


def now() -> Condition:
    return Condition({"type": "context", "name": "now"})


def source_system() -> Condition:
    return Condition({"type": "context", "name": "source_system"})


def days_between(a: Condition, b: Condition) -> Condition:
    return call("days_between", a, b)


class fields:  # noqa: N801  reads as a namespace
    """``fields().credit_score`` is the field of that name."""

    def __getattr__(self, name: str) -> Condition:
        return field(name)


@dataclass(frozen=True)
class Binding:
    """Where a record's fields are: kinds by name, and columns for value, scope and malformedness."""

    kinds: dict[str, str]
    value: Callable[[str], Column]
    in_scope: Callable[[str], Column]
    malformed: Callable[[str], Column]
    source: Column
    now: Column
    #: What was given for a malformed field and what was expected: struct<raw, expected>.
    error: Callable[[str], Column] | None = None


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.NumericType):
        return "num"
    return "ts" if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "str"


def clock(at: dt.datetime | str) -> Column:
    """The evaluation time, always given and never the time of execution."""
    return F.lit(at.isoformat() if isinstance(at, dt.datetime) else at).cast("timestamp")


def plain(df: DataFrame, at: dt.datetime | str, source: Column | None = None) -> Binding:
    """Bind the columns of any table: all declared, none malformed."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema}
    return Binding(kinds, F.col, lambda _: F.lit(True), lambda _: F.lit(False), F.lit(None).cast("string") if source is None else source, clock(at))


@dataclass(frozen=True)
class Compiled:
    value: Column
    kind: str  # num, str, bool, ts, list or null
    touched: Column
    literal: Any = None


def _array(names: list[str]) -> Column:
    return F.array(*map(F.lit, names)).cast("array<string>")


def truth(c: Compiled) -> Column:
    """Python's truth of a value; NULL stays NULL."""
    if c.kind == "bool":
        return c.value
    if c.kind == "num":
        return c.value != 0
    return F.length(c.value) > 0 if c.kind == "str" else F.when(c.value.isNotNull(), F.lit(True))


def _union(parts: list[Compiled]) -> Column:
    return reduce(F.array_union, [p.touched for p in parts], _array(_NONE))


def as_time(c: Compiled) -> Column:
    """ISO text or time as a timestamp; NULL if it is neither."""
    if c.kind == "ts":
        return c.value.cast("timestamp")
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    return F.when(c.value.rlike(iso), F.try_to_timestamp(c.value)) if c.kind == "str" else F.lit(None).cast("timestamp")


class Compiler:
    def __init__(self, binding: Binding):
        self.b = binding

    def compile(self, node: dict) -> Compiled:
        kind = node.get("type")
        make = getattr(self, f"_{kind}", None) if kind in ("literal", "field", "context", "comparison", "arith", "not", "and", "or", "func") else None
        if make is None:
            raise ValueError(f"unknown node type: {kind!r}")
        return make(node)

    def _literal(self, node: dict) -> Compiled:
        v = node.get("value")
        if isinstance(v, list):
            return Compiled(F.lit(True), "list", _array(_NONE), v)
        kind = "null" if v is None else "bool" if isinstance(v, bool) else "num" if isinstance(v, (int, float)) else "str"
        return Compiled(F.lit(v), kind, _array(_NONE), v)

    def _field(self, node: dict) -> Compiled:
        name = node["name"]
        if name not in self.b.kinds:
            return Compiled(F.lit(None).cast("string"), "str", _array([name]))
        value = F.when(self.b.in_scope(name) & ~self.b.malformed(name), self.b.value(name))
        return Compiled(value, self.b.kinds[name], _array([name]))

    def _context(self, node: dict) -> Compiled:
        known = {"now": (self.b.now, "ts"), "source_system": (self.b.source, "str"), "batch_id": (F.lit(None).cast("string"), "str")}
        if node["name"] not in known:
            raise ValueError(f"unknown context: {node['name']!r}")
        value, kind = known[node["name"]]
        return Compiled(value, kind, _array(_NONE))

    def _comparison(self, node: dict) -> Compiled:
        op = node["operator"]
        if op not in COMPARISONS:
            raise ValueError(f"unknown operator: {op!r}")
        a, b = self.compile(node["left"]), self.compile(node["right"])
        touched = _union([a, b])
        if "null" in (a.kind, b.kind) or "list" in (a.kind, b.kind):
            return Compiled(F.lit(None).cast("boolean"), "bool", touched)
        x, y = a.value, b.value
        kinds = {a.kind, b.kind}
        if kinds == {"bool", "num"}:  # True is 1
            x, y = (c.value.cast("int") if c.kind == "bool" else c.value for c in (a, b))
        elif kinds == {"ts", "str"}:
            x, y = as_time(a), as_time(b)
        elif len(kinds) > 1:
            # different types are unequal and have no order
            there = x.isNotNull() & y.isNotNull()
            value = F.when(there, F.lit(op == "!=")) if op in ("==", "!=") else F.lit(None).cast("boolean")
            return Compiled(value, "bool", touched)
        value = {"==": x == y, "!=": x != y, ">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[op]
        return Compiled(value, "bool", touched)

    def _arith(self, node: dict) -> Compiled:
        op = node["operator"]
        a, b = self.compile(node["left"]), self.compile(node["right"])
        if op not in "+-*/" or len(op) != 1:
            raise ValueError(f"unknown operator: {op!r}")
        if {a.kind, b.kind} - {"num", "bool", "null"}:
            raise ValueError("arithmetic needs numbers")
        x, y = (c.value.cast("double") if op == "/" or c.kind == "null" else c.value.cast("int") if c.kind == "bool" else c.value for c in (a, b))
        value = {"+": lambda: F.try_add(x, y), "-": lambda: F.try_subtract(x, y), "*": lambda: F.try_multiply(x, y), "/": lambda: F.try_divide(x, y)}[op]()
        return Compiled(value, "num", _union([a, b]))

    def _not(self, node: dict) -> Compiled:
        a = self.compile(node["operand"])
        return Compiled(~truth(a), "bool", a.touched)

    def _chain(self, node: dict, stop: bool) -> Compiled:
        """Kleene logic from left to right; what follows a deciding operand isn't touched."""
        parts = [self.compile(x) for x in node["operands"]]
        if not parts:
            return Compiled(F.lit(not stop), "bool", _array(_NONE))
        truths = [truth(p) for p in parts]
        value = reduce((lambda x, y: x | y) if stop else (lambda x, y: x & y), truths)
        touched = parts[-1].touched
        for p, t in zip(reversed(parts[:-1]), reversed(truths[:-1]), strict=True):
            touched = F.array_union(p.touched, F.when(t.eqNullSafe(F.lit(stop)), _array(_NONE)).otherwise(touched))
        return Compiled(value, "bool", touched)

    def _and(self, node: dict) -> Compiled:
        return self._chain(node, False)

    def _or(self, node: dict) -> Compiled:
        return self._chain(node, True)

    def _func(self, node: dict) -> Compiled:
        name, args = node["name"], node.get("args", [])
        if name in ("not_null", "field_error"):
            return self._about_field(name, args[0])
        parts = [self.compile(a) for a in args]
        touched = _union(parts)
        if name == "in_set":
            col, wanted = parts[0], parts[1].literal or []
            same = {"num": (int, float), "bool": (bool, int, float), "str": str}.get(col.kind, ())
            members = [v for v in wanted if isinstance(v, same) and (col.kind == "bool" or not isinstance(v, bool))]
            value = col.value.cast("int").isin([int(v) for v in members]) if col.kind == "bool" else col.value.isin(members)
            return Compiled(value if members else F.when(col.value.isNotNull(), F.lit(False)), "bool", touched)
        if name in ("upper", "lower"):
            return Compiled(getattr(F, name)(text_of(parts[0].value, parts[0].kind)), "str", touched)
        if name == "days_between":
            micros = F.unix_micros(as_time(parts[0])) - F.unix_micros(as_time(parts[1]))
            return Compiled(F.floor(micros / 86_400_000_000), "num", touched)
        raise ValueError(f"unknown function: {name!r}")

    def _about_field(self, name: str, arg: dict) -> Compiled:
        if arg.get("type") != "field":
            if name == "field_error":
                raise ValueError("field_error needs a field")
            part = self.compile(arg)
            return Compiled(F.when(part.value.isNotNull(), F.lit(True)), "bool", part.touched)
        f = arg["name"]
        if f not in self.b.kinds:
            return Compiled(F.lit(None).cast("boolean"), "bool", _array([f]))
        error = self.b.malformed(f)
        # a malformed cell was given, a blank one wasn't
        value = error | self.b.value(f).isNotNull() if name == "not_null" else error
        return Compiled(F.when(self.b.in_scope(f), value), "bool", _array([f]))


def text_of(value: Column, kind: str = "str") -> Column:
    """A value as Python prints it: whole doubles end in .0 and have no exponent below 1e16."""
    if kind != "double":
        return value.cast("string")
    whole = F.concat(value.cast("decimal(38,0)").cast("string"), F.lit(".0"))
    short = value.cast("string")
    plain_ = F.regexp_replace(value.cast("decimal(38,9)").cast("string"), r"0+$", "")
    return F.when((value == F.floor(value)) & (F.abs(value) < 1e16), whole).when(short.contains("E") & (F.abs(value) >= 1) & (F.abs(value) < 1e16), plain_).otherwise(short)


def verdict(c: Compiled) -> Column:
    """pass, fail, or not_applicable if the condition's value is absent."""
    t = truth(c)
    return F.when(t.isNull(), "not_applicable").when(t, "pass").otherwise("fail")


_SLOT = re.compile(r"\{(\w+)\}")


def rendered(template: str, values: Callable[[str], Column]) -> Column:
    """A message with each ``{field}`` filled in; a dash where the field has no value."""
    parts: list[Column] = []
    at = 0
    for m in _SLOT.finditer(template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(values(m[1]), F.lit("—"))]
        at = m.end()
    if re.search(r"[{}]", _SLOT.sub("", template)):  # not a template: as it stands
        return F.lit(template)
    return F.concat(*parts, F.lit(template[at:]))
