"""Types of the expression language, their text form, and how they satisfy, match and map to Spark types."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import types as S

SCALARS = ("nulltype", "bool", "int", "float", "string", "path", "range_expr", "any", "noreturn")
_VARIABLE = re.compile(r"T[1-3]?$")


@dataclass(frozen=True)
class ExprType:
    """A scalar code, ``list`` of one parameter, ``union`` of several, or ``var`` with its name as code parameter."""

    code: str
    params: tuple = ()

    def __str__(self) -> str:
        if self.code == "list":
            return f"list[{self.params[0]}]"
        if self.code == "union":
            rest = [p for p in self.params if p != NULL]
            if len(rest) == 1 and len(self.params) == 2:
                return f"{rest[0]}?"
            return " | ".join(map(str, self.params))
        return self.params[0] if self.code == "var" else self.code

    @property
    def item(self) -> ExprType:
        return self.params[0]


NULL, BOOL, INT, FLOAT, STRING, PATH, RANGE, ANY, NORETURN = (ExprType(c) for c in SCALARS)


def list_of(item: ExprType) -> ExprType:
    return ExprType("list", (item,))


def union(*members: ExprType) -> ExprType:
    """Flattened, without repeats, in the order of their text; ``noreturn`` adds nothing; a single member is itself."""
    flat: dict[str, ExprType] = {}
    for m in members:
        for x in m.params if m.code == "union" else (m,):
            if x != NORETURN:
                flat[str(x)] = x
    if not flat:
        return NORETURN
    ordered = tuple(flat[k] for k in sorted(flat))
    return ordered[0] if len(ordered) == 1 else ExprType("union", ordered)


def optional(t: ExprType) -> ExprType:
    return union(t, NULL)


def without_null(t: ExprType) -> ExprType:
    return union(*[p for p in t.params if p != NULL]) if t.code == "union" else t


class TypeSyntaxError(ValueError):
    """A type or signature that can't be read."""


def parse_type(text: str) -> ExprType:
    """``list[int] | nulltype``, ``string?``, ``T1`` and so on."""
    found, rest = _alternatives(text.strip())
    if rest:
        raise TypeSyntaxError(f"unexpected {rest!r} in type {text!r}")
    return found


def _alternatives(text: str) -> tuple[ExprType, str]:
    members = []
    while True:
        one, text = _primary(text.lstrip())
        text = text.lstrip()
        while text.startswith("?"):
            one, text = optional(one), text[1:].lstrip()
        members.append(one)
        if not text.startswith("|"):
            return union(*members), text
        text = text[1:]


def _primary(text: str) -> tuple[ExprType, str]:
    m = re.match(r"[A-Za-z_][A-Za-z_0-9]*", text)
    if not m:
        raise TypeSyntaxError(f"expected a type at {text!r}")
    name, rest = m[0], text[m.end() :]
    if name == "list":
        if not rest.startswith("["):
            raise TypeSyntaxError("list needs an item type")
        item, rest = _alternatives(rest[1:])
        if not rest.startswith("]"):
            raise TypeSyntaxError(f"expected ] at {rest!r}")
        return list_of(item), rest[1:]
    if _VARIABLE.match(name):
        return ExprType("var", (name,)), rest
    if name in SCALARS:
        return ExprType(name), rest
    raise TypeSyntaxError(f"unknown type {name!r}")


@dataclass(frozen=True)
class Signature:
    params: tuple[ExprType, ...]
    result: ExprType

    def __str__(self) -> str:
        return f"({', '.join(map(str, self.params))}) -> {self.result}"


def parse_signature(text: str) -> Signature:
    """``(list[T1], int) -> T1``."""
    m = re.match(r"\s*\((.*)\)\s*->\s*(.+)$", text, re.S)
    if not m:
        raise TypeSyntaxError(f"not a signature: {text!r}")
    params, depth, start = [], 0, 0
    body = m[1]
    for i, c in enumerate(body + ","):
        depth += (c == "[") - (c == "]")
        if c == "," and not depth:
            if body[start:i].strip():
                params.append(parse_type(body[start:i]))
            start = i + 1
    return Signature(tuple(params), parse_type(m[2]))


def satisfies(have: ExprType, want: ExprType) -> bool:
    """Whether a value of one type may stand where another is asked for, without conversion."""
    if have == want or want == ANY or have == NORETURN:
        return True
    if have.code == "union":
        return all(satisfies(p, want) for p in have.params)
    if want.code == "union":
        return any(satisfies(have, p) for p in want.params)
    return have.code == want.code == "list" and (have.item == NULL or satisfies(have.item, want.item))


def matches(have: ExprType, want: ExprType, bound: dict[str, ExprType]) -> bool:
    """Whether a type fits a pattern with variables; a variable keeps its first type."""
    if want.code == "var":
        name = want.params[0]
        if name in bound:
            return bound[name] == have or satisfies(have, bound[name])
        bound[name] = have
        return True
    if have.code == want.code == "list":
        return matches(have.item, want.item, bound) if has_variables(want) else satisfies(have, want)
    if want.code == "union" and has_variables(want):
        return any(matches(have, p, bound) for p in want.params)
    return satisfies(have, want)


def has_variables(t: ExprType) -> bool:
    return t.code == "var" or any(isinstance(p, ExprType) and has_variables(p) for p in t.params)


def substitute(t: ExprType, bound: dict[str, ExprType]) -> ExprType:
    if t.code == "var":
        return bound.get(t.params[0], NULL)
    if t.code == "list":
        return list_of(substitute(t.item, bound))
    return union(*[substitute(p, bound) for p in t.params]) if t.code == "union" else t


def common_item(items: list[ExprType]) -> ExprType | None:
    """The item type of a list of such values: int and float give float, path and string give string; None if they don't mix."""

    def both(a: ExprType | None, b: ExprType) -> ExprType | None:
        if a is None or a == b:
            return a
        if {a, b} == {INT, FLOAT}:
            return FLOAT
        if {a, b} == {PATH, STRING}:
            return STRING
        if a.code == b.code == "list":
            if NULL in (a.item, b.item):
                return b if a.item == NULL else a
            inner = both(a.item, b.item)
            return inner and list_of(inner)
        return None

    return reduce(both, items[1:], items[0]) if items else NULL


RANGE_STRUCT = S.StructType([S.StructField("ranges", S.ArrayType(S.StructType([S.StructField(n, S.LongType()) for n in ("start", "end", "step")]))), S.StructField("contiguous", S.BooleanType())])


def spark_type(t: ExprType) -> S.DataType:
    simple = {"nulltype": S.NullType(), "bool": S.BooleanType(), "int": S.LongType(), "float": S.DoubleType(), "string": S.StringType(), "path": S.StringType(), "range_expr": RANGE_STRUCT, "noreturn": S.NullType()}
    if t.code == "list":
        return S.ArrayType(spark_type(t.item) if t.item != NULL else S.StringType())
    if t.code == "union":
        rest = without_null(t)
        if rest.code != "union":
            return spark_type(rest)
        raise TypeError(f"a column can't hold {t}")
    if t.code in simple:
        return simple[t.code]
    raise TypeError(f"a column can't hold {t}")


def from_spark(kind: S.DataType, metadata: dict | None = None) -> ExprType:
    """The type of a column. A string column with ``path_format`` metadata is a path."""
    if isinstance(kind, S.StringType):
        return PATH if metadata and "path_format" in metadata else STRING
    if isinstance(kind, S.BooleanType):
        return BOOL
    if isinstance(kind, (S.ByteType, S.ShortType, S.IntegerType, S.LongType)):
        return INT
    if isinstance(kind, (S.FloatType, S.DoubleType)):
        return FLOAT
    if isinstance(kind, S.NullType):
        return NULL
    if isinstance(kind, S.ArrayType):
        return list_of(from_spark(kind.elementType, metadata))
    if isinstance(kind, S.StructType) and [f.name for f in kind.fields] == ["ranges", "contiguous"]:
        return RANGE
    raise TypeError(f"no expression type for {kind.simpleString()}")
