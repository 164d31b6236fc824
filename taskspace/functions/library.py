"""The function library: each overload is a builder of Columns. Python runs only where a row says so (path algebra, literals
of other languages, range text)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import ranges
from ..types import FLOAT, INT, NORETURN, NULL, PATH, RANGE, STRING, ExprType, common_item, list_of, spark_type, without_null
from . import paths, text
from .registry import MISSING, Context, Library, Typed

LIBRARY = Library()
define = LIBRARY.register


def long(v: int) -> Column:
    return F.lit(v).cast("long")


def fail(message: str | Column, kind: str) -> Column:
    return F.raise_error(F.lit(message) if isinstance(message, str) else message).cast(kind)


def guard(bad: Column, message: str, value: Column, kind: str) -> Column:
    """value, or an error where bad holds; the value isn't evaluated there."""
    return F.when(bad, fail(message, kind)).otherwise(value)


def finite(c: Column) -> Column:
    return guard(F.isnan(c) | (F.abs(c) == float("inf")), "Float operation gave no finite number", F.when(c == 0, F.lit(0.0)).otherwise(c), "double")


def whole(c: Column) -> Column:
    """A float without a fraction as a 64-bit integer."""
    return guard((c >= 9223372036854775808.0) | (c < -9223372036854775808.0), "Integer overflow", c.cast("long"), "bigint")


def literal(s: Column) -> Column:
    """A regular expression that matches a text literally."""
    return F.concat(F.lit(r"\Q"), F.replace(s, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


# -- arithmetic -------------------------------------------------------------------------------------------------------
@define("__add__", "(int, int) -> int")
def add(ctx, a):
    return a[0].col + a[1].col


@define("__add__", "(float, float) -> float")
def add_float(ctx, a):
    return finite(a[0].col + a[1].col)


@define("__add__", "(string, string) -> string", "(path, string) -> path")
def add_text(ctx, a):
    return F.concat(a[0].col, a[1].col)


@define("__add__", "(string, range_expr) -> string")
def add_text_range(ctx, a):
    return F.concat(a[0].col, ranges.display(a[1].col))


@define("__add__", "(range_expr, string) -> string")
def add_range_text(ctx, a):
    return F.concat(ranges.display(a[0].col), a[1].col)


def as_list(t: Typed) -> Typed:
    """A list or range as a list; a nullable one as if it were there."""
    return Typed(list_of(INT), ranges.expand(t.col)) if without_null(t.type) == RANGE else Typed(without_null(t.type), t.col, t.const, t.text, t.elements)


@define("__add__", "(range_expr, range_expr) -> list[int]", "(list[T1], range_expr) -> list[T2]", "(range_expr, list[T1]) -> list[T2]", "(list[T1], list[T2]) -> list[T3]")
def add_lists(ctx, a):
    x, y = map(as_list, a)
    if NULL in (x.type.item, y.type.item):
        return x if y.type.item == NULL else y
    item = common_item([x.type.item, y.type.item])
    if item is None:
        raise TypeError(f"cannot concatenate {x.type} and {y.type}")
    kind = spark_type(list_of(item))
    return Typed(list_of(item), F.concat(x.col.cast(kind), y.col.cast(kind)))


@define("__sub__", "(int, int) -> int")
def sub(ctx, a):
    return a[0].col - a[1].col


@define("__sub__", "(float, float) -> float")
def sub_float(ctx, a):
    return finite(a[0].col - a[1].col)


@define("__mul__", "(int, int) -> int")
def mul(ctx, a):
    return a[0].col * a[1].col


@define("__mul__", "(float, float) -> float")
def mul_float(ctx, a):
    return finite(a[0].col * a[1].col)


@define("__mul__", "(string, int) -> string")
def mul_text(ctx, a):
    return F.repeat(a[0].col, F.greatest(a[1].col, long(0)).cast("int"))


@define("__mul__", "(list[T1], int) -> list[T1]")
def mul_list(ctx, a):
    return F.flatten(F.array_repeat(a[0].col, F.greatest(a[1].col, long(0)).cast("int")))


@define("__truediv__", "(int, int) -> float", "(float, float) -> float")
def truediv(ctx, a):
    x, y = (v.col.cast("double") for v in a)
    return guard(y == 0, "Division by zero", finite(x / y), "double")


@define("__truediv__", "(path, string) -> path", "(path, path) -> path")
def path_join(ctx, a):
    return paths.over(lambda p, c, f=ctx.path_format: paths.join(p, c, f), "string", a[0].col, a[1].col)


@define("__floordiv__", "(int, int) -> int")
def floordiv(ctx, a):
    x, y = a[0].col, a[1].col
    rest = x % y
    lower = F.when((rest != 0) & ((rest < 0) != (y < 0)), long(1)).otherwise(long(0))
    return guard(y == 0, "Division by zero", F.call_function("div", x, y) - lower, "bigint")


@define("__floordiv__", "(float, float) -> int")
def floordiv_float(ctx, a):
    x, y = a[0].col, a[1].col
    quotient = x / y
    return guard(y == 0, "Division by zero", guard((quotient >= 9223372036854775808.0) | (quotient < -9223372036854775808.0), "Integer overflow", F.floor(quotient), "bigint"), "bigint")


@define("__mod__", "(int, int) -> int")
def mod(ctx, a):
    x, y = a[0].col, a[1].col
    rest = x % y
    return guard(y == 0, "Division by zero", rest + F.when((rest != 0) & ((rest < 0) != (y < 0)), y).otherwise(long(0)), "bigint")


@define("__mod__", "(float, float) -> float")
def mod_float(ctx, a):
    x, y = a[0].col, a[1].col
    rest = x % y
    return guard(y == 0, "Division by zero", finite(rest + F.when((rest != 0) & ((rest < 0) != (y < 0)), y).otherwise(0.0)), "double")


@define("__pow__", "(int, int) -> float | int")
def power(ctx, a):
    """Exact for exponents from 0; a negative literal exponent gives a float. A negative exponent known only at run time is an
    error, as a column has one type."""
    base, n = a[0].col, a[1].col
    exact = F.aggregate(F.array_repeat(base, F.least(F.greatest(n, long(0)), long(64)).cast("int")), long(1), lambda acc, x: acc * x)
    # beyond 64 factors only 0, 1 and -1 stay within 64 bits
    odd = F.when(n % 2 == 0, long(1)).otherwise(base)
    value = F.when((n > 64) & (F.abs(base.cast("double")) <= 1), F.when(base == 0, long(0)).otherwise(odd)).when(n > 64, fail("Integer overflow", "bigint")).otherwise(exact)
    if isinstance(a[1].const, int) and a[1].const < 0:
        return Typed(FLOAT, guard(base == 0, "Zero cannot be raised to a negative power", finite(F.pow(base.cast("double"), n.cast("double"))), "double"))
    if a[1].const is not MISSING:
        return Typed(INT, value)
    return Typed(INT, guard(n < 0, "A negative exponent needs a literal", value, "bigint"))


@define("__pow__", "(float, float) -> float")
def power_float(ctx, a):
    return guard((a[0].col == 0) & (a[1].col < 0), "Zero cannot be raised to a negative power", finite(F.pow(a[0].col, a[1].col)), "double")


@define("__neg__", "(int) -> int")
def neg(ctx, a):
    return -a[0].col


@define("__neg__", "(float) -> float")
def neg_float(ctx, a):
    return F.when(a[0].col == 0, F.lit(0.0)).otherwise(-a[0].col)


@define("__pos__", "(int) -> int", "(float) -> float")
def pos(ctx, a):
    return a[0].col


@define("__not__", "(bool) -> bool")
def not_(ctx, a):
    return ~a[0].col


# -- comparison -------------------------------------------------------------------------------------------------------
def exact_compare(op: str, i: Column, f: Column) -> Column:
    """int op float without rounding the int."""
    low, high = f < -9223372036854775808.0, f >= 9223372036854775808.0
    inside = ~low & ~high
    floor = F.when(inside, F.floor(F.when(inside, f).otherwise(0.0)))
    even = f == F.floor(F.when(inside, f).otherwise(0.5)).cast("double")
    if op == "==":
        return F.when(inside & even, i == floor).otherwise(False)
    less = F.when(low, False).when(high, True).when(even, i < floor).otherwise(i <= floor)
    at_most = F.when(low, False).when(high, True).otherwise(i <= floor)
    return {"<": less, "<=": at_most, ">": ~at_most, ">=": ~less}[op]


_FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "=="}


def equal(x: Column, y: Column, s: ExprType, t: ExprType) -> Column:
    """Value equality of two types: exact between int and float, by items between lists and ranges, false across others."""
    if NULL in (s, t):
        return F.lit(True) if s == t else (y if s == NULL else x).isNull()
    optional_ = "union" in (s.code, t.code)
    s, t = without_null(s), without_null(t)
    if {s, t} == {INT, FLOAT}:
        i, f = (x, y) if s == INT else (y, x)
        out = exact_compare("==", i, f)
    elif s == t == RANGE:
        out = (x["ranges"] == y["ranges"]) | (ranges.expand(x) == ranges.expand(y))
    elif s == t or {s, t} == {STRING, PATH}:
        out = x == y
    elif s.code == "list" and t == RANGE:
        return equal(x, ranges.expand(y), s, list_of(INT))
    elif t.code == "list" and s == RANGE:
        return equal(ranges.expand(x), y, list_of(INT), t)
    elif s.code == t.code == "list":
        if NULL in (s.item, t.item):
            return (F.size(x) == 0) & (F.size(y) == 0)
        pairs = F.zip_with(x, y, lambda p, q: equal(p, q, s.item, t.item))
        out = (F.size(x) == F.size(y)) & F.forall(pairs, lambda p: F.coalesce(p, F.lit(False)))
    else:
        return F.lit(False)
    return F.coalesce(out, x.isNull() & y.isNull()) if optional_ else out


def ordered(op: str, x: Column, y: Column, s: ExprType, t: ExprType) -> Column:
    s, t = without_null(s), without_null(t)
    native = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y} if s == t or {s, t} == {STRING, PATH} else {}
    if {s, t} == {INT, FLOAT}:
        return exact_compare(op, x, y) if s == INT else exact_compare(_FLIP[op], y, x)
    if native and (s.code in ("int", "float", "string", "path") or s.code == "list"):
        return native[op]
    if s.code == t.code == "list" and {s.item, t.item} == {INT, FLOAT}:
        # the first items that differ decide, else the lengths
        first = F.try_element_at(F.filter(F.zip_with(x, y, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda r: r["p"].isNotNull() & r["q"].isNotNull() & ~equal(r["p"], r["q"], s.item, t.item)), F.lit(1))
        sizes = {"<": F.size(x) < F.size(y), "<=": F.size(x) <= F.size(y), ">": F.size(x) > F.size(y), ">=": F.size(x) >= F.size(y)}[op]
        return F.when(first.isNotNull(), ordered(op, first["p"], first["q"], s.item, t.item)).otherwise(sizes)
    raise TypeError(f"Cannot compare {s} and {t}")


def exact_literals(a: list[Typed]) -> list[Typed]:
    """Beside a float, an int literal that a float holds exactly is that float: a plain comparison, which scans can push down."""
    kinds = [t.type for t in a]
    if set(kinds) != {INT, FLOAT}:
        return a
    i = kinds.index(INT)
    v = a[i].const
    if not isinstance(v, int) or abs(v) > 1 << 53:
        return a
    return [Typed(FLOAT, F.lit(float(v)), float(v)) if k == i else t for k, t in enumerate(a)]


@define("__eq__", "(T1, T2) -> bool")
def eq(ctx, a):
    a = exact_literals(a)
    return equal(a[0].col, a[1].col, a[0].type, a[1].type)


@define("__ne__", "(T1, T2) -> bool")
def ne(ctx, a):
    a = exact_literals(a)
    return ~equal(a[0].col, a[1].col, a[0].type, a[1].type)


for _name, _op in (("__lt__", "<"), ("__le__", "<="), ("__gt__", ">"), ("__ge__", ">=")):

    @define(_name, "(T1, T2) -> bool")
    def compare(ctx, a, op=_op):
        a = exact_literals(a)
        return ordered(op, a[0].col, a[1].col, a[0].type, a[1].type)


@define("__contains__", "(string, string) -> bool")
def contains_text(ctx, a):
    return F.contains(a[0].col, a[1].col)


@define("__contains__", "(range_expr, T1) -> bool")
def contains_range(ctx, a):
    kind, v = without_null(a[1].type), a[1].col
    if kind == INT:
        return ranges.contains(a[0].col, v)
    if kind == FLOAT:
        return F.when((v == F.floor(v)) & (F.abs(v) < 4.6e18), ranges.contains(a[0].col, v.cast("long"))).otherwise(False)
    return F.lit(False)


@define("__contains__", "(list[T1], T2) -> bool")
def contains_list(ctx, a):
    item, v = without_null(a[0].type).item, a[1]
    if item == NULL:
        return F.lit(False)
    if item == without_null(v.type) and v.type.code != "union" and item.code in ("int", "string", "bool", "path"):
        return F.coalesce(F.array_contains(a[0].col, v.col), F.lit(False))
    return F.exists(a[0].col, lambda x: equal(x, v.col, item, v.type))


@define("__not_contains__", "(string, string) -> bool", "(range_expr, T1) -> bool", "(list[T1], T2) -> bool")
def not_contains(ctx, a):
    kind = without_null(a[0].type).code
    return ~{"string": contains_text, "range_expr": contains_range}.get(kind, contains_list)(ctx, a)


# -- subscripts and slices --------------------------------------------------------------------------------------------
def bounded(c: Column, size: Column, i: Column, what: str, kind: str, get) -> Column:
    at = F.when(i < 0, i + size).otherwise(i)
    return guard((at < 0) | (at >= size), f"Index out of range for {what}", get(at), kind)


@define("__getitem__", "(string, int) -> string")
def char_at(ctx, a):
    s = a[0].col
    return bounded(s, F.length(s), a[1].col, "string", "string", lambda at: F.substring(s, (at + 1).cast("int"), F.lit(1)))


@define("__getitem__", "(range_expr, int) -> int")
def range_at(ctx, a):
    return ranges.get(a[0].col, a[1].col)


@define("__getitem__", "(list[T1], int) -> T1")
def item_at(ctx, a):
    x = a[0].col
    return bounded(x, F.size(x), a[1].col, "list", spark_type(without_null(a[0].type).item).simpleString(), lambda at: F.try_element_at(x, (at + 1).cast("int")))


def slice_indexes(size: Column, start: Typed, stop: Typed, step: Typed) -> Column:
    """The 0-based positions of a slice, as an array."""
    n = size.cast("long")
    absent = lambda t: t.type == NULL
    by = long(1) if absent(step) else step.col
    up = by > 0
    clip = lambda c: F.when(c < 0, F.greatest(c + n, F.when(up, long(0)).otherwise(long(-1)))).otherwise(F.least(c, F.when(up, n).otherwise(n - 1)))
    first = F.when(up, long(0)).otherwise(n - 1) if absent(start) else clip(start.col)
    last = F.when(up, n).otherwise(long(-1)) if absent(stop) else clip(stop.col)
    some = F.when(up, first < last).otherwise(first > last)
    final = F.when(up, last - 1).otherwise(last + 1)
    indexes = F.when(some, F.sequence(first, final, F.when(some, by).otherwise(long(1)))).otherwise(F.array().cast("array<bigint>"))
    return guard(by == 0, "Slice step cannot be zero", indexes, "array<bigint>")


_BOUND = "int | nulltype, int | nulltype, int | nulltype"


@define("__getitem__", f"(string, {_BOUND}) -> string")
def slice_text(ctx, a):
    s = a[0].col
    return F.array_join(F.transform(slice_indexes(F.length(s), *a[1:]), lambda i: F.substring(s, (i + 1).cast("int"), F.lit(1))), "")


@define("__getitem__", f"(list[T1], {_BOUND}) -> list[T1]")
def slice_list(ctx, a):
    x = a[0].col
    if a[3].type == NULL and all(t.type == NULL or (isinstance(t.const, int) and t.const >= 0) for t in a[1:3]):
        start = 0 if a[1].type == NULL else a[1].const
        size = F.greatest(F.size(x) - start, F.lit(0)) if a[2].type == NULL else F.lit(max(0, a[2].const - start))
        return F.slice(x, F.lit(start + 1), size)
    return F.transform(slice_indexes(F.size(x), *a[1:]), lambda i: F.try_element_at(x, (i + 1).cast("int")))


@define("__getitem__", f"(range_expr, {_BOUND}) -> range_expr | list[int]")
def slice_range(ctx, a):
    """A literal slice without a negative step stays a range; others are lists."""
    bounds = [None if t.type == NULL else t.const for t in a[1:]]
    if isinstance(a[0].const, ranges.RangeExpr) and MISSING not in bounds:
        got = a[0].const.slice(*bounds)
        return Typed(RANGE, got.column(), got) if isinstance(got, ranges.RangeExpr) else Typed(list_of(INT), F.array(*[long(v) for v in got]).cast("array<bigint>"))
    values = ranges.expand(a[0].col)
    picked = F.transform(slice_indexes(F.size(values), *a[1:]), lambda i: F.try_element_at(values, (i + 1).cast("int")))
    if bounds[2] is None or (bounds[2] is not MISSING and bounds[2] > 0):
        return Typed(RANGE, F.when(F.size(picked) == 0, ranges.RangeExpr([]).column()).otherwise(ranges.compress_column(picked)))
    return Typed(list_of(INT), picked)


# -- numbers and list aggregates --------------------------------------------------------------------------------------
for _name, _pick, _of_list in (("min", F.least, F.array_min), ("max", F.greatest, F.array_max)):

    @define(_name, "(int, int) -> int", "(float, float) -> float", "(int, int, int) -> int", "(float, float, float) -> float")
    def extreme(ctx, a, pick=_pick):
        return pick(*[t.col for t in a])

    @define(_name, "(list[int]) -> int", "(list[float]) -> float")
    def extreme_of(ctx, a, of=_of_list, name=_name):
        return guard(F.size(a[0].col) == 0, f"{name}() of an empty list", of(a[0].col), spark_type(without_null(a[0].type).item).simpleString())

    @define(_name, "(range_expr) -> int")
    def extreme_of_range(ctx, a, name=_name):
        return ranges.minimum(a[0].col) if name == "min" else ranges.maximum(a[0].col)

    @define(_name, "(list[nulltype]) -> noreturn")
    def extreme_of_nothing(ctx, a, name=_name):
        return Typed(NORETURN, fail(f"{name}() of an empty list", "string"))


@define("floor", "(int) -> int")
@define("ceil", "(int) -> int")
def same_int(ctx, a):
    return a[0].col


@define("floor", "(float) -> int")
def floor(ctx, a):
    return guard((a[0].col >= 9223372036854775808.0) | (a[0].col < -9223372036854775808.0), "Integer overflow", F.floor(a[0].col), "bigint")


@define("ceil", "(float) -> int")
def ceil(ctx, a):
    return guard((a[0].col >= 9223372036854775808.0) | (a[0].col < -9223372036854775808.0), "Integer overflow", F.ceil(a[0].col), "bigint")


@define("round", "(float) -> int")
def round_to_int(ctx, a):
    return whole(F.rint(a[0].col))


@define("round", "(float, int) -> float | int")
def round_float(ctx, a):
    """Half to even on x * 10^n in binary. With a positive literal n the text keeps n decimals."""
    x, n = a[0].col, a[1].col
    scale = F.pow(F.lit(10.0), F.abs(n).cast("double"))
    up = F.when(scale == float("inf"), x).otherwise(F.rint(x * scale) / scale)
    down = F.when(n <= -309, F.lit(0.0)).otherwise(F.rint(x / scale) * scale)
    value = finite(F.when(n >= 0, up).otherwise(down))
    shown = None
    if isinstance(a[1].const, int) and a[1].const > 0:
        shown = F.format_string(f"%.{min(a[1].const, 1074)}f", value)
    return Typed(FLOAT, value, text=shown)


@define("round", "(int, int) -> int")
def round_int(ctx, a):
    x, n = a[0].col, a[1].col
    scale = F.pow(F.lit(10.0), (-n).cast("double"))
    return F.when(n >= 0, x).when(n <= -20, long(0)).otherwise(whole(F.rint(x.cast("double") / scale) * scale))


@define("sum", "(list[int]) -> int")
def sum_ints(ctx, a):
    return F.aggregate(a[0].col, long(0), lambda acc, x: acc + x)


@define("sum", "(list[float]) -> float")
def sum_floats(ctx, a):
    return finite(F.aggregate(a[0].col, F.lit(0.0), lambda acc, x: acc + x))


@define("sum", "(list[nulltype]) -> int")
def sum_nothing(ctx, a):
    return Typed(INT, long(0), 0)


@define("sum", "(range_expr) -> int")
def sum_range(ctx, a):
    return ranges.total(a[0].col)


@define("abs", "(int) -> int", "(float) -> float")
def absolute(ctx, a):
    return F.abs(a[0].col)


@define("any", "(list[bool]) -> bool")
def any_(ctx, a):
    return F.exists(a[0].col, lambda x: x)


@define("any", "(list[nulltype]) -> bool")
def any_nothing(ctx, a):
    return F.lit(False)


@define("all", "(list[bool]) -> bool")
def all_(ctx, a):
    return F.forall(a[0].col, lambda x: x)


@define("all", "(list[nulltype]) -> bool")
def all_nothing(ctx, a):
    return F.lit(True)


@define("len", "(string) -> int", "(path) -> int")
def len_text(ctx, a):
    return F.length(a[0].col).cast("long")


@define("len", "(range_expr) -> int")
def len_range(ctx, a):
    return ranges.length(a[0].col)


@define("len", "(list[T1]) -> int")
def len_list(ctx, a):
    return F.size(a[0].col).cast("long")


# -- strings ----------------------------------------------------------------------------------------------------------
@define("upper", "(string) -> string")
def upper(ctx, a):
    return F.upper(a[0].col)


@define("lower", "(string) -> string")
def lower(ctx, a):
    return F.lower(a[0].col)


for _name, _regex, _trim in (("strip", r"(?U)^\s+|\s+\z", F.btrim), ("lstrip", r"(?U)^\s+", F.ltrim), ("rstrip", r"(?U)\s+\z", F.rtrim)):

    @define(_name, "(string) -> string")
    def strip(ctx, a, regex=_regex):
        return F.regexp_replace(a[0].col, regex, "")

    @define(_name, "(string, string) -> string")
    def strip_set(ctx, a, trim=_trim):
        return F.when(a[1].col == "", a[0].col).otherwise(trim(a[0].col, a[1].col))


@define("startswith", "(string, string) -> bool")
def startswith(ctx, a):
    return F.startswith(a[0].col, a[1].col)


@define("endswith", "(string, string) -> bool")
def endswith(ctx, a):
    return F.endswith(a[0].col, a[1].col)


@define("replace", "(string, string, string) -> string")
def replace(ctx, a):
    return guard(a[1].col == "", "replace() needs a text to look for", F.replace(a[0].col, a[1].col, a[2].col), "string")


def split_by(s: Column, sep: Column, limit: Column | None) -> Column:
    n = F.lit(-1) if limit is None else F.when(limit < 0, F.lit(-1)).otherwise(F.least(limit, long(2147483646)).cast("int") + 1)
    return guard(sep == "", "empty separator", F.split(s, literal(sep), n), "array<string>")


@define("split", "(string) -> list[string]")
@define("rsplit", "(string) -> list[string]")
def split_space(ctx, a):
    return F.filter(F.split(a[0].col, r"(?U)\s+"), lambda x: x != "")


@define("split", "(string, string) -> list[string]", "(string, string, int) -> list[string]")
def split(ctx, a):
    return split_by(a[0].col, a[1].col, a[2].col if len(a) > 2 else None)


@define("rsplit", "(string, string) -> list[string]", "(string, string, int) -> list[string]")
def rsplit(ctx, a):
    parts = split_by(F.reverse(a[0].col), F.reverse(a[1].col), a[2].col if len(a) > 2 else None)
    return F.transform(F.reverse(parts), lambda x: F.reverse(x))


def found_at(s: Column, sub: Column) -> Column:
    return F.instr(s, sub).cast("long") - 1


def found_last(s: Column, sub: Column) -> Column:
    back = F.instr(F.reverse(s), F.reverse(sub)).cast("long")
    return F.when(back == 0, long(-1)).otherwise(F.length(s) - F.length(sub) - back + 1)


for _name, _find in (("find", found_at), ("rfind", found_last)):

    @define(_name, "(string, string) -> int")
    def find(ctx, a, of=_find, name=_name):
        return guard(a[1].col == "", f"{name}() needs a text to look for", of(a[0].col, a[1].col), "bigint")

    @define(_name.replace("find", "index"), "(string, string) -> int")
    def index(ctx, a, of=_find, name=_name.replace("find", "index")):
        at = of(a[0].col, a[1].col)
        return guard(a[1].col == "", f"{name}() needs a text to look for", guard(at < 0, f"{name}(): substring not found", at, "bigint"), "bigint")


@define("count", "(string, string) -> int")
def count(ctx, a):
    s, sub = a[0].col, a[1].col
    return guard(sub == "", "count() needs a text to look for", F.call_function("div", (F.length(s) - F.length(F.replace(s, sub, F.lit("")))).cast("long"), F.length(sub).cast("long")), "bigint")


@define("removeprefix", "(string, string) -> string")
def removeprefix(ctx, a):
    s, p = a[0].col, a[1].col
    return F.when(F.startswith(s, p), F.substring(s, F.length(p) + 1, F.length(s))).otherwise(s)


@define("removesuffix", "(string, string) -> string")
def removesuffix(ctx, a):
    s, p = a[0].col, a[1].col
    return F.when(F.endswith(s, p), F.substring(s, F.lit(1), F.length(s) - F.length(p))).otherwise(s)


for _name, _regex in (("isdigit", r"^[0-9]+\z"), ("isalpha", r"^\p{IsAlphabetic}+\z"), ("isalnum", r"^[\p{IsAlphabetic}\p{N}]+\z"), ("isspace", r"(?U)^\s+\z")):

    @define(_name, "(string) -> bool")
    def is_kind(ctx, a, regex=_regex):
        return a[0].col.rlike(regex)


for _name, _kind in (("isupper", "IsUppercase"), ("islower", "IsLowercase")):

    @define(_name, "(string) -> bool")
    def is_case(ctx, a, kind=_kind):
        return F.regexp_replace(a[0].col, r"\P{IsAlphabetic}", "").rlike(rf"^\p{{{kind}}}+\z")


@define("isascii", "(string) -> bool")
def isascii(ctx, a):
    return F.octet_length(a[0].col) == F.length(a[0].col)


@define("title", "(string) -> string")
def title(ctx, a):
    """Upper case after anything that is neither letter nor number, lower case elsewhere."""

    def one(s: str) -> str:
        out, start = [], True
        for c in s:
            out.append(c.upper() if start else c.lower())
            start = not c.isalnum()
        return "".join(out)

    return paths.over(one, "string", a[0].col)


@define("capitalize", "(string) -> string")
def capitalize(ctx, a):
    s = a[0].col
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.length(s))))


def padding(s: Column, w: Column) -> Column:
    return F.greatest(w - F.length(s), long(0)).cast("int")


@define("ljust", "(string, int) -> string")
def ljust(ctx, a):
    return F.concat(a[0].col, F.repeat(F.lit(" "), padding(a[0].col, a[1].col)))


@define("rjust", "(string, int) -> string")
def rjust(ctx, a):
    return F.concat(F.repeat(F.lit(" "), padding(a[0].col, a[1].col)), a[0].col)


@define("center", "(string, int) -> string")
def center(ctx, a):
    s, w = a[0].col, a[1].col
    pad = padding(s, w)
    left = F.shiftright(pad, 1) + pad.bitwiseAND(w.cast("int")).bitwiseAND(F.lit(1))
    return F.concat(F.repeat(F.lit(" "), left), s, F.repeat(F.lit(" "), pad - left))


@define("zfill", "(string, int) -> string", "(int, int) -> string", "(float, int) -> string")
def zfill(ctx, a):
    s = shown(a[0])
    sign = F.when(s.rlike("^[-+]"), F.substring(s, 1, 1)).otherwise("")
    return F.concat(sign, F.repeat(F.lit("0"), padding(s, a[1].col)), F.substring(s, F.length(sign) + 1, F.length(s)))


# -- lists ------------------------------------------------------------------------------------------------------------
@define("sorted", "(list[T1]) -> list[T1]")
def sorted_(ctx, a):
    return F.array_sort(a[0].col)


@define("reversed", "(list[T1]) -> list[T1]")
def reversed_(ctx, a):
    return F.reverse(a[0].col)


@define("unique", "(list[T1]) -> list[T1]")
def unique(ctx, a):
    return F.array_distinct(a[0].col)


@define("flatten", "(list[nulltype]) -> list[nulltype]", "(list[T1]) -> list[T1]")
def flatten(ctx, a):
    inner = without_null(a[0].type).item
    return Typed(inner, F.flatten(a[0].col)) if inner.code == "list" else a[0]


@define("join", "(list[string], string) -> string", "(list[path], string) -> string", "(list[nulltype], string) -> string")
def join(ctx, a):
    return F.array_join(F.transform(a[0].col, lambda x: x.cast("string")), a[1].const) if a[1].const is not MISSING else F.aggregate(F.slice(a[0].col, 2, F.greatest(F.size(a[0].col), F.lit(1))), F.coalesce(F.try_element_at(a[0].col, F.lit(1)), F.lit("")), lambda acc, x: F.concat(acc, a[1].col, x))


@define("range", "(int) -> list[int]", "(int, int) -> list[int]", "(int, int, int) -> list[int]")
def range_(ctx, a):
    start = a[0].col if len(a) > 1 else long(0)
    stop = a[1].col if len(a) > 1 else a[0].col
    step = a[2].col if len(a) > 2 else long(1)
    some = F.when(step > 0, start < stop).otherwise(start > stop)
    values = F.when(some, F.sequence(start, stop - F.signum(step).cast("long"), F.when(some, step).otherwise(long(1)))).otherwise(F.array().cast("array<bigint>"))
    return guard(step == 0, "range() step cannot be zero", values, "array<bigint>")


@define("list", "(range_expr) -> list[int]")
def list_(ctx, a):
    return ranges.expand(a[0].col)


@define("range_expr", "(string) -> range_expr")
def range_of_text(ctx, a):
    if isinstance(a[0].const, str):
        found = ranges.RangeExpr.parse(a[0].const)
        return Typed(RANGE, found.column(), found)
    return ranges.parse_column(a[0].col)


@define("range_expr", "(list[int]) -> range_expr")
def range_of_list(ctx, a):
    return ranges.compress_column(a[0].col)


@define("range_expr", "(list[nulltype]) -> noreturn")
def range_of_nothing(ctx, a):
    return Typed(NORETURN, fail("Cannot create an empty range expression", "string"))


# -- conversion -------------------------------------------------------------------------------------------------------
def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+\z", "")


def parse_int(s: Column) -> Column:
    value = F.when(trimmed(s).rlike(r"^[+-]?[0-9]+\z"), trimmed(s).try_cast("bigint"))
    return F.when(s.isNull(), F.lit(None).cast("bigint")).otherwise(F.coalesce(value, fail(F.concat(F.lit("Cannot convert '"), s, F.lit("' to int")), "bigint")))


def parse_float(s: Column) -> Column:
    good = trimmed(s).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z")
    value = F.when(good, trimmed(s).try_cast("double"))
    return F.when(s.isNull(), F.lit(None).cast("double")).otherwise(finite(F.coalesce(value, fail(F.concat(F.lit("Cannot convert '"), s, F.lit("' to float")), "double"))))


def float_to_int(c: Column) -> Column:
    return guard(c != F.rint(c), "Cannot convert to int: not a whole number", whole(c), "bigint")


@define("int", "(int) -> int")
@define("float", "(float) -> float")
@define("bool", "(bool) -> bool")
def identity(ctx, a):
    return a[0].col


@define("int", "(float) -> int")
def int_of_float(ctx, a):
    return float_to_int(a[0].col)


@define("int", "(string) -> int")
def int_of_text(ctx, a):
    return parse_int(a[0].col)


@define("float", "(int) -> float")
def float_of_int(ctx, a):
    return a[0].col.cast("double")


@define("float", "(string) -> float")
def float_of_text(ctx, a):
    return parse_float(a[0].col)


def shown(t: Typed) -> Column:
    """The display text of a value."""
    return t.text if t.text is not None else text.display(t.col, t.type)


@define("string", "(int) -> string", "(float) -> string", "(bool) -> string", "(string) -> string", "(path) -> string", "(nulltype) -> string", "(range_expr) -> string", "(list[T1]) -> string")
def string(ctx, a):
    return shown(a[0])


def parse_bool(s: Column) -> Column:
    low = F.lower(s)
    # The words for true and false.
    return F.when(low.isin("true", "yes", "on", "1"), True).when(low.isin("false", "no", "off", "0"), False).when(s.isNull(), F.lit(None).cast("boolean")).otherwise(fail(F.concat(F.lit("Cannot convert '"), s, F.lit("' to bool")), "boolean"))


@define("bool", "(int) -> bool", "(float) -> bool")
def bool_of_number(ctx, a):
    return a[0].col != 0


@define("bool", "(string) -> bool")
def bool_of_text(ctx, a):
    return parse_bool(a[0].col)


@define("bool", "(nulltype) -> bool")
def bool_of_null(ctx, a):
    return F.lit(False)


@define("bool", "(path) -> noreturn", "(list[T]) -> noreturn")
def bool_of_others(ctx, a):
    raise TypeError(f"Cannot convert {a[0].type} to bool")


@define("fail", "(string) -> noreturn")
def fail_(ctx, a):
    return Typed(NORETURN, F.raise_error(a[0].col).cast("string"))


# -- regular expressions ----------------------------------------------------------------------------------------------
_FORBIDDEN = re.compile(r"\(\?(?:[=!]|<[=!])")


def checked_pattern(t: Typed) -> str:
    """A literal pattern of the portable subset: no look-around, back references, or anchors and escapes of one engine only."""
    p = t.const
    if not isinstance(p, str):
        raise TypeError("a regular expression must be a literal")
    if not p:
        raise ValueError("Empty regex pattern is not allowed")
    bare = re.sub(r"\\\\", "", p)
    if _FORBIDDEN.search(bare) or re.search(r"\\[1-9zZ]|\\[xuU]\{|\(\?P=", bare):
        raise ValueError(f"Regex pattern uses a feature that is not portable: {p!r}")
    re.compile(p)
    return re.sub(r"\(\?P<", "(?<", p)


def groups(pattern: str) -> int:
    return re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern)).groups


def match_groups(s: Column, pattern: str) -> Column:
    found = F.array(*[F.regexp_extract(s, pattern, i) for i in range(groups(pattern) + 1)])
    return F.when(s.rlike(pattern), found)


@define("re_match", "(string, string) -> list[string]?")
def re_match(ctx, a):
    return match_groups(a[0].col, f"^(?:{checked_pattern(a[1])})")


@define("re_search", "(string, string) -> list[string]?")
def re_search(ctx, a):
    return match_groups(a[0].col, checked_pattern(a[1]))


@define("re_findall", "(string, string) -> list[string]", "(string, string) -> list[list[string]]")
def re_findall(ctx, a):
    p = checked_pattern(a[1])
    n = groups(p)
    if n < 2:
        return Typed(list_of(STRING), F.regexp_extract_all(a[0].col, F.lit(p), F.lit(n)))
    each = F.arrays_zip(*[F.regexp_extract_all(a[0].col, F.lit(p), F.lit(i)).alias(f"g{i}") for i in range(1, n + 1)])
    return Typed(list_of(list_of(STRING)), F.transform(each, lambda r: F.array(*[r[f"g{i}"] for i in range(1, n + 1)])))


@define("re_sub", "(string, string, string) -> string")
def re_sub(ctx, a):
    if isinstance(a[2].const, str) and re.search(r"\\[0-9]|\\g<|\$[0-9{]", a[2].const):
        raise ValueError("Group references in replacement strings are not supported")
    quoted = F.replace(F.replace(a[2].col, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.regexp_replace(a[0].col, F.lit(checked_pattern(a[1])), quoted)


@define("re_split", "(string, string) -> list[string]", "(string, string, int) -> list[string]")
def re_split(ctx, a):
    p = checked_pattern(a[1])
    if len(a) == 2:
        return F.split(a[0].col, p, -1)
    n = a[2].col
    return F.when(n < 0, F.array(a[0].col)).otherwise(F.split(a[0].col, F.lit(p), F.when(n <= 0, F.lit(-1)).otherwise(F.least(n, long(2147483646)).cast("int") + 1)))


@define("re_escape", "(string) -> string")
def re_escape(ctx, a):
    return F.regexp_replace(a[0].col, r"([\\.+*?()|\[\]{}^$#&\-~])", r"\\$1")


# -- paths ------------------------------------------------------------------------------------------------------------
@define("path", "(string) -> path")
def path(ctx, a):
    return paths.over(lambda p, f=ctx.path_format: paths.normalise(p, f), "string", a[0].col)


@define("path", "(list[string]) -> path")
def path_of_parts(ctx, a):
    return paths.over(lambda p, f=ctx.path_format: paths.from_parts(p, f), "string", a[0].col)


@define("as_posix", "(path) -> string")
def as_posix(ctx, a):
    return F.translate(a[0].col, "\\", "/")


for _name in ("with_name", "with_stem", "with_suffix"):

    @define(_name, "(path, string) -> path")
    def with_part(ctx, a, of=getattr(paths, _name)):
        return paths.over(lambda p, x, f=ctx.path_format: of(p, x, f), "string", a[0].col, a[1].col)


@define("with_number", "(path, int) -> path", "(string, int) -> string")
def with_number(ctx, a):
    return paths.over(lambda p, n, f=ctx.path_format: paths.with_number(p, int(n), f), "string", a[0].col, a[1].col)


@define("is_absolute", "(path) -> bool")
def is_absolute(ctx, a):
    local = r"^[A-Za-z]:[\\/]" if ctx.path_format == "WINDOWS" else "^/"
    return a[0].col.rlike(rf"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://.*|^//|^\\\\|{local}")


@define("is_relative_to", "(path, path) -> bool", "(path, string) -> bool")
def is_relative_to(ctx, a):
    p, b = a[0].col, a[1].col
    if ctx.path_format == "WINDOWS":
        return paths.over(lambda x, y: paths.is_relative_to(x, y, "WINDOWS"), "boolean", p, b)
    next_ = F.substring(p, F.length(b) + 1, F.lit(1))
    return F.startswith(p, b) & ((p == b) | b.rlike(r"[/\\]\z") | next_.isin("/", "\\"))


@define("relative_to", "(path, path) -> path", "(path, string) -> path")
def relative_to(ctx, a):
    if ctx.path_format == "WINDOWS":
        return paths.over(lambda x, y: paths.relative_to(x, y, "WINDOWS"), "string", a[0].col, a[1].col)
    rest = F.regexp_replace(F.substring(a[0].col, F.length(a[1].col) + 1, F.length(a[0].col)), r"^/*\\*", "")
    return F.when(is_relative_to(ctx, a), F.when(rest == "", ".").otherwise(rest)).otherwise(fail(F.concat(F.lit("relative_to failed: '"), a[0].col, F.lit("' is not relative to '"), a[1].col, F.lit("'")), "string"))


def map_path(ctx, a):
    out = a[0].col
    for r in reversed(ctx.rules):
        out = F.coalesce(paths._rule_column(a[0].col, r, ctx.path_format), out)
    return out


#: Functions that only a host with mapping rules has.
HOST = Library()
HOST.register("apply_path_mapping", "(string) -> path")(map_path)

for _name, _kind in (("name", "string"), ("stem", "string"), ("suffix", "string"), ("suffixes", "list[string]"), ("parent", "path"), ("parts", "list[string]")):

    @define(f"__property_{_name}__", f"(path) -> {_kind}")
    def path_property(ctx, a, name=_name, kind=_kind, of=getattr(paths, _name)):
        if ctx.path_format == "POSIX" and name in ("name", "stem", "suffix"):
            return paths.posix_property(name, a[0].col)
        return paths.over(lambda p, f=ctx.path_format: of(p, f), "array<string>" if kind.startswith("list") else "string", a[0].col)


# -- literals of other languages --------------------------------------------------------------------------------------
_ANY = ["int", "float", "string", "bool", "path", "nulltype", "list[T1]", "range_expr"]
for _name, _kinds in (("repr_json", _ANY), ("repr_py", _ANY), ("repr_pwsh", _ANY), ("repr_sh", ["string", "path", "list[string]", "list[path]", "list[nulltype]"]), ("repr_cmd", ["string", "path", "list[string]", "list[path]", "list[nulltype]"])):

    @define(_name, *[f"({k}) -> string" for k in _kinds])
    def represent(ctx, a, of=text.REPRS[_name]):
        t = without_null(a[0].type)
        if t == NULL:
            return F.lit(of(None))
        if a[0].text is not None:
            return a[0].text
        if t == RANGE:
            return represent_with(of, ranges.display(a[0].col), str)
        return represent_with(of, a[0].col, {"int": int, "float": float, "bool": bool}.get(t.code, text.plain))


def represent_with(of, c: Column, convert) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([of(None) if v is None or (isinstance(v, float) and v != v) else of(convert(v)) for v in values], dtype=object)

    return run(c)


def conversion(t: Typed, want: ExprType, context: Context) -> Typed:
    """Give a value another type: the wide table of targets (int and float, text to scalars, scalars to text, lists by item)."""
    have, goal = without_null(t.type), without_null(want)
    if have == goal or goal.code == "any" or t.type == NULL or have == NORETURN:
        return t if t.type != NULL else Typed(want, t.col.cast(spark_type(goal)) if goal.code not in ("any", "union") else t.col)
    if goal.code == "union":
        for member in sorted(goal.params, key=lambda m: (m.code != have.code, m == STRING)):
            try:
                return conversion(t, member, context)
            except TypeError:
                continue
        raise TypeError(f"Cannot coerce {t.type} to {want}")
    table = {
        ("int", "float"): lambda c: c.cast("double"),
        ("float", "int"): float_to_int,
        ("string", "int"): parse_int,
        ("string", "float"): parse_float,
        ("string", "bool"): parse_bool,
        ("path", "string"): lambda c: c,
        ("string", "path"): lambda c: paths.over(lambda p, f=context.path_format: paths.normalise(p, f), "string", c),
    }
    if (have.code, goal.code) in table:
        return Typed(goal, table[have.code, goal.code](t.col))
    if have == STRING and goal == RANGE:
        return Typed(RANGE, range_of_text(context, [t]).col if t.const is not MISSING else ranges.parse_column(t.col))
    if goal == STRING and have.code in ("int", "float", "bool", "range_expr"):
        return Typed(STRING, shown(t))
    if have == RANGE and goal == list_of(INT):
        return Typed(goal, ranges.expand(t.col))
    if have.code == goal.code == "list":
        if have.item == NULL:
            return Typed(goal, t.col.cast(spark_type(goal)))
        return Typed(goal, F.transform(t.col, lambda x: conversion(Typed(have.item, x), goal.item, context).col))
    raise TypeError(f"Cannot coerce {t.type} to {want}")


__all__ = ["HOST", "LIBRARY", "conversion", "shown"]
