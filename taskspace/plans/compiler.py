"""Expressions and format strings to typed Spark Columns.

The language is a subset of Python's expression grammar: Python's own parser reads it on the driver, a static pass gives each
node a type and picks an overload, and the result is a Column that Catalyst optimises with the rest of the plan. Nothing is
interpreted row by row.
"""

from __future__ import annotations

import ast
import keyword
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import library
from ..functions.registry import MISSING, Context, Library, Typed
from ..ranges import RangeExpr
from ..types import BOOL, FLOAT, INT, NORETURN, NULL, PATH, RANGE, STRING, ExprType, common_item, from_spark, list_of, parse_type, spark_type, union, without_null

#: Limits of an expression's text, depth and symbols.
MAX_SOURCE = 64 * 1024
MAX_DEPTH = 64
MAX_SYMBOLS = 100_000

_BINARY = {ast.Add: "__add__", ast.Sub: "__sub__", ast.Mult: "__mul__", ast.Div: "__truediv__", ast.FloorDiv: "__floordiv__", ast.Mod: "__mod__", ast.Pow: "__pow__"}
_COMPARE = {ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__", ast.In: "__contains__", ast.NotIn: "__not_contains__"}
_CONSTANTS = {"true": True, "True": True, "false": False, "False": False, "null": None, "None": None}
_KEYWORD_MARK = "_kw_"


class ExpressionError(ValueError):
    """An expression that can't be read, typed or compiled."""


class Symbols:
    """Dotted names to columns: ``Param.Frame`` to a Column of a type. Inner tables are looked up before outer ones."""

    def __init__(self, *tables: Mapping[str, Typed]):
        self.tables = list(tables) or [{}]

    @classmethod
    def of(cls, df: DataFrame, prefix: str = "", **renamed: str) -> Symbols:
        """Every column of a frame under its own name, below ``prefix``; or under the names given by keyword."""
        out = {}
        for f in df.schema.fields:
            try:
                out[prefix + renamed.get(f.name, f.name)] = Typed(from_spark(f.dataType, f.metadata), _as(f.name, from_spark(f.dataType, f.metadata)))
            except TypeError:
                continue
        return cls(out)

    def set(self, name: str, value: Typed) -> None:
        """Add a name; a name can't be both a value and a table of names."""
        table = self.tables[0]
        if any(n.startswith(name + ".") or name.startswith(n + ".") for n in table):
            raise ExpressionError(f"'{name}' is both a value and a table")
        if len(table) >= MAX_SYMBOLS:
            raise ExpressionError("too many symbols")
        table[name] = value

    def get(self, name: str) -> Typed | None:
        return next((t[name] for t in self.tables if name in t), None)

    def has_table(self, name: str) -> bool:
        return any(n.startswith(name + ".") for t in self.tables for n in t)

    def names(self) -> list[str]:
        return sorted({n for t in self.tables for n in t})

    def inner(self, table: Mapping[str, Typed]) -> Symbols:
        return Symbols(table, *self.tables)

    def merged(self, other: Symbols) -> Symbols:
        """One table with the other's values where both have a name."""
        flat = {}
        for t in [*reversed(self.tables), *reversed(other.tables)]:
            flat.update(t)
        return Symbols(flat)


def _as(name: str, t: ExprType) -> Column:
    c = F.col(f"`{name}`")
    return c.cast(spark_type(t)) if t in (INT, FLOAT) or t.code == "list" else c


def constant(value) -> Typed:
    """A Python value as a literal of the language."""
    if value is None:
        return Typed(NULL, F.lit(None), None)
    if isinstance(value, bool):
        return Typed(BOOL, F.lit(value), value)
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise ExpressionError("Integer overflow")
        return Typed(INT, F.lit(value).cast("long"), value)
    if isinstance(value, float):
        return Typed(FLOAT, F.lit(value), value)
    if isinstance(value, str):
        return Typed(STRING, F.lit(value), value)
    if isinstance(value, RangeExpr):
        return Typed(RANGE, value.column(), value)
    if isinstance(value, (list, tuple)):
        return list_value([constant(v) for v in value])
    raise ExpressionError(f"no literal for {value!r}")


def list_value(items: list[Typed]) -> Typed:
    """A list of values: promoted to one item type, two levels deep at most, without nulls."""
    if not items:
        return Typed(list_of(NULL), F.array().cast("array<string>"), elements=[])
    kinds = [t.type for t in items]
    if any(k == NULL or (k.code == "union" and NULL in k.params) for k in kinds):
        raise ExpressionError("null is not allowed in a list")
    item = common_item(kinds)
    if item is None:
        raise ExpressionError(f"list items are of different types: {', '.join(sorted(set(map(str, kinds))))}")
    if item.code == "list" and item.item.code == "list":
        raise ExpressionError("lists nest two levels at most")
    want = spark_type(item) if item != NULL else None
    cols = [t.col if t.type == item or want is None else t.col.cast(want) for t in items]
    return Typed(list_of(item), F.array(*cols), elements=items)


@dataclass
class Parsed:
    """An expression's tree and what it refers to."""

    source: str
    tree: ast.expr
    symbols: set[str] = field(default_factory=set)
    functions: set[str] = field(default_factory=set)


def parse(source: str) -> Parsed:
    """Read an expression and check that it stays within the language."""
    if len(source.encode()) > MAX_SOURCE:
        raise ExpressionError("expression is too long")
    text = source.strip()
    if not text:
        raise ExpressionError("empty expression")
    # attributes may be named like Python's keywords
    marked = re.sub(r"\.\s*(" + "|".join(keyword.kwlist) + r")\b", lambda m: f".{_KEYWORD_MARK}{m[1]}", text)
    try:
        tree = ast.parse(f"({marked}\n)", mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise ExpressionError(f"cannot read expression {text!r}: {getattr(e, 'msg', e)}") from None
    _check(tree, 0)
    out = Parsed(text, tree)
    _collect(tree, frozenset(), out)
    return out


_ALLOWED = (ast.BoolOp, ast.BinOp, ast.UnaryOp, ast.IfExp, ast.Compare, ast.Call, ast.Constant, ast.Attribute, ast.Subscript, ast.Name, ast.List, ast.Slice, ast.ListComp)


def _check(node: ast.AST, depth: int) -> None:
    if depth > MAX_DEPTH:
        raise ExpressionError("expression is nested too deeply")
    if isinstance(node, ast.expr):
        if not isinstance(node, _ALLOWED):
            raise ExpressionError(f"{type(node).__name__} is not part of the language")
        if isinstance(node, ast.Constant) and not isinstance(node.value, (int, float, str, bool, type(None))):
            raise ExpressionError(f"{type(node.value).__name__} literals are not part of the language")
        if isinstance(node, ast.Constant) and node.kind:
            raise ExpressionError("string prefixes are not part of the language")
        if isinstance(node, ast.BinOp) and type(node.op) not in _BINARY or isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Invert):
            raise ExpressionError(f"operator {type(node.op).__name__} is not part of the language")
        if isinstance(node, ast.Compare) and any(type(o) not in _COMPARE for o in node.ops):
            raise ExpressionError("'is' is not part of the language")
        if isinstance(node, ast.Call) and (node.keywords or any(isinstance(a, ast.Starred) for a in node.args)):
            raise ExpressionError("keyword and starred arguments are not part of the language")
        if isinstance(node, ast.ListComp) and (len(node.generators) != 1 or len(node.generators[0].ifs) > 1 or node.generators[0].is_async or not isinstance(node.generators[0].target, ast.Name)):
            raise ExpressionError("a comprehension has one for with one name and at most one if")
    for child in ast.iter_child_nodes(node):
        _check(child, depth + isinstance(child, ast.expr))


def _dotted(node: ast.expr) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (owner := _dotted(node.value)):
        return f"{owner}.{node.attr.removeprefix(_KEYWORD_MARK)}"
    return None


def _collect(node: ast.AST, local: frozenset, out: Parsed) -> None:
    if isinstance(node, ast.Call):
        if isinstance(node.func, ast.Name):
            out.functions.add(node.func.id)
        elif isinstance(node.func, ast.Attribute):
            out.functions.add(node.func.attr)
            _collect(node.func.value, local, out)
        for a in node.args:
            _collect(a, local, out)
        return
    if isinstance(node, (ast.Name, ast.Attribute)) and (name := _dotted(node)):
        if name.split(".")[0] not in local and name not in _CONSTANTS:
            out.symbols.add(name)
        return
    if isinstance(node, ast.ListComp):
        g = node.generators[0]
        _collect(g.iter, local, out)
        for part in (node.elt, *g.ifs):
            _collect(part, local | {g.target.id}, out)
        return
    for child in ast.iter_child_nodes(node):
        _collect(child, local, out)


class Compiler:
    """Compiles parsed expressions against symbols.

    ``path_format`` is that of path values; ``rules`` are mapping rules, with which ``apply_path_mapping`` exists; ``functions``
    adds overloads to the library.
    """

    def __init__(self, symbols: Symbols, path_format: str = "POSIX", rules: list | None = None, functions: Library | None = None):
        self.symbols = symbols
        self.context = Context(path_format, rules)
        self.library = library.LIBRARY if rules is None else library.LIBRARY.merged(library.HOST)
        if functions:
            self.library = self.library.merged(functions)

    def expression(self, source: str | Parsed, target: str | ExprType | None = None) -> Typed:
        parsed = parse(source) if isinstance(source, str) else source
        try:
            out = self.node(parsed.tree, self.symbols)
            if target is not None:
                out = self.coerce(out, parse_type(target) if isinstance(target, str) else target)
            return out
        except TypeError as e:
            raise ExpressionError(f"{e} in {parsed.source!r}") from None

    def coerce(self, value: Typed, target: ExprType) -> Typed:
        return library.conversion(value, target, self.context)

    # one method for each kind of node
    def node(self, n: ast.expr, s: Symbols) -> Typed:
        return getattr(self, f"_{type(n).__name__.lower()}")(n, s)

    def _constant(self, n: ast.Constant, s: Symbols) -> Typed:
        out = constant(n.value)
        if out.type == FLOAT:
            if n.value in (float("inf"), float("-inf")) or n.value != n.value:
                raise ExpressionError("Float literal is not finite")
        return out

    def _name(self, n: ast.Name, s: Symbols) -> Typed:
        found = s.get(n.id)
        if found is not None:
            return found
        if n.id in _CONSTANTS:
            return constant(_CONSTANTS[n.id])
        raise ExpressionError(unknown("name", n.id, s.names()))

    def _attribute(self, n: ast.Attribute, s: Symbols) -> Typed:
        name = _dotted(n)
        if name:
            found = s.get(name)
            if found is not None:
                return found
            owner = name.rpartition(".")[0]
            if s.get(owner) is None and (s.has_table(owner) or s.get(name.split(".")[0]) is None and "." in owner):
                if not any(s.get(".".join(name.split(".")[:i])) for i in range(1, name.count(".") + 1)):
                    raise ExpressionError(unknown("name", name, s.names()))
        value = self.node(n.value, s)
        return self.call(f"__property_{n.attr.removeprefix(_KEYWORD_MARK)}__", [value], method=True)

    def _unaryop(self, n: ast.UnaryOp, s: Symbols) -> Typed:
        if isinstance(n.op, ast.USub) and isinstance(n.operand, ast.Constant) and isinstance(n.operand.value, (int, float)) and not isinstance(n.operand.value, bool):
            return constant(-n.operand.value)
        op = {ast.Not: "__not__", ast.USub: "__neg__", ast.UAdd: "__pos__"}[type(n.op)]
        return self.call(op, [self.node(n.operand, s)])

    def _binop(self, n: ast.BinOp, s: Symbols) -> Typed:
        return self.call(_BINARY[type(n.op)], [self.node(n.left, s), self.node(n.right, s)])

    def _boolop(self, n: ast.BoolOp, s: Symbols) -> Typed:
        out = self.node(n.values[0], s)
        for v in n.values[1:]:
            out = self._either(out, self.node(v, s), isinstance(n.op, ast.And))
        return out

    def _either(self, x: Typed, y: Typed, and_: bool) -> Typed:
        """An operand, not a truth value: only null and false are falsy. The right one is evaluated only where it decides."""
        nullable = x.type == NULL or x.type.code == "union" and NULL in x.type.params
        if x.type == NULL:
            return x if and_ else y
        if without_null(x.type) != BOOL and not nullable:
            return y if and_ else x
        falsy = x.col.isNull() if without_null(x.type) != BOOL else ~F.coalesce(x.col, F.lit(False))
        # an or gives its left operand only where that is truthy, so not as null
        left = x.type if and_ else without_null(x.type)
        kind, (a, b) = self._joined(replace(x, type=left), y)
        return Typed(kind, F.when(falsy, a).otherwise(b) if and_ else F.when(falsy, b).otherwise(a))

    def _joined(self, x: Typed, y: Typed) -> tuple[ExprType, tuple[Column, Column]]:
        """The type of a value that is one of two, and their Columns in that type."""
        kind = union(x.type, y.type)
        bare = without_null(kind)
        if bare.code == "union":
            item = common_item(list(bare.params))
            if item is None:
                raise TypeError(f"a column can't hold {kind}")
            kind = union(item, NULL) if NULL in kind.params else item
            bare = item
        want = spark_type(bare)
        fit = lambda t: t.col if without_null(t.type) == bare else t.col.cast(want)
        return kind, (fit(x), fit(y))

    def _compare(self, n: ast.Compare, s: Symbols) -> Typed:
        operands = [self.node(v, s) for v in [n.left, *n.comparators]]
        parts = []
        for op, x, y in zip(n.ops, operands[:-1], operands[1:], strict=True):
            name = _COMPARE[type(op)]
            parts.append(self.call(name, [y, x] if "contains" in name else [x, y]).col)
        out = parts[-1]
        for p in reversed(parts[:-1]):
            out = F.when(p, out).otherwise(False)
        return Typed(BOOL, out)

    def _ifexp(self, n: ast.IfExp, s: Symbols) -> Typed:
        test = self.node(n.test, s)
        if test.type != BOOL:
            raise TypeError(f"a condition is a bool, not {test.type}")
        if isinstance(test.const, bool):
            return self.node(n.body if test.const else n.orelse, s)
        kind, (a, b) = self._joined(self.node(n.body, s), self.node(n.orelse, s))
        return Typed(kind, F.when(test.col, a).otherwise(b))

    def _call(self, n: ast.Call, s: Symbols) -> Typed:
        args = [self.node(a, s) for a in n.args]
        if isinstance(n.func, ast.Name):
            name, method = n.func.id, False
        elif isinstance(n.func, ast.Attribute):
            name, method = n.func.attr.removeprefix(_KEYWORD_MARK), True
            args.insert(0, self.node(n.func.value, s))
        else:
            raise ExpressionError("only functions can be called")
        if name.startswith("__"):
            raise ExpressionError(f"{name} cannot be called directly")
        if name not in self.library.table:
            raise ExpressionError(unknown("function", name, [f for f in self.library.table if not f.startswith("__")]))
        return self.call(name, args, method)

    def call(self, name: str, args: list[Typed], method: bool = False) -> Typed:
        overload, want, result = self.library.resolve(name, [a.type for a in args], method)
        args = [a if without_null(a.type) == w or a.type == w or w.code in ("union", "any", "var") else self.coerce(a, w) for a, w in zip(args, want, strict=True)]
        out = overload.build(self.context, args)
        return out if isinstance(out, Typed) else Typed(result, out)

    def _list(self, n: ast.List, s: Symbols) -> Typed:
        return list_value([self.node(v, s) for v in n.elts])

    def _subscript(self, n: ast.Subscript, s: Symbols) -> Typed:
        value = self.node(n.value, s)
        if isinstance(n.slice, ast.Slice):
            bounds = [constant(None) if b is None else self.node(b, s) for b in (n.slice.lower, n.slice.upper, n.slice.step)]
            return self.call("__getitem__", [value, *bounds])
        if value.type == PATH:
            raise TypeError("a path has no items")
        return self.call("__getitem__", [value, self.node(n.slice, s)])

    def _listcomp(self, n: ast.ListComp, s: Symbols) -> Typed:
        g = n.generators[0]
        source = library.as_list(self.node(g.iter, s))
        if source.type.code != "list":
            raise TypeError(f"cannot iterate over {source.type}")
        item, kept = source.type.item, source.col
        inner = lambda c: s.inner({g.target.id: Typed(item, c)})
        if g.ifs:
            test = self.node(g.ifs[0], inner(F.lit(None).cast(spark_type(item))))
            if test.type != BOOL:
                raise TypeError(f"a condition is a bool, not {test.type}")
            kept = F.filter(kept, lambda c: self.node(g.ifs[0], inner(c)).col)
        shape = self.node(n.elt, inner(F.lit(None).cast(spark_type(item))))
        if shape.type.code == "list" and shape.type.item.code == "list":
            raise ExpressionError("lists nest two levels at most")
        return Typed(list_of(shape.type), F.transform(kept, lambda c: self.node(n.elt, inner(c)).col))


def unknown(what: str, name: str, known: Iterable[str]) -> str:
    """The message for a name that isn't there, with the nearest one that is (at most five edits away; of equals the first)."""
    near = sorted((edits(name, k), k) for k in known)
    hint = f" Did you mean '{near[0][1]}'?" if near and near[0][0] <= 5 and near[0][0] < max(len(name), 1) else ""
    return f"unknown {what} '{name}'.{hint}"


def edits(a: str, b: str) -> int:
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


# -- format strings ---------------------------------------------------------------------------------------------------
def segments(template: str) -> list[tuple[bool, str]]:
    """(is an expression, text) of a string with ``{{ }}`` parts. Quotes inside an expression may hold braces."""
    out, at = [], 0
    while True:
        start = template.find("{{", at)
        if start < 0:
            if template[at:]:
                out.append((False, template[at:]))
            return out
        if start > at:
            out.append((False, template[at:start]))
        i, quote = start + 2, None
        while i < len(template):
            c = template[i]
            if quote:
                if c == "\\":
                    i += 1
                elif c == quote:
                    quote = None
            elif c in "'\"":
                quote = c
            elif template.startswith("}}", i):
                break
            i += 1
        else:
            raise ExpressionError(f"'{{{{' without '}}}}' in {template!r}")
        out.append((True, template[start + 2 : i]))
        at = i + 2


def escape(text: str) -> str:
    """A format string that shows a text as it is."""
    return text.replace("{{", '{{ "{{" }}')


def resolve(template: str, compiler: Compiler, target: str | ExprType | None = None) -> Typed:
    """A format string as a value: a single expression keeps its type, mixtures are strings in which null is empty."""
    parts = segments(template)
    if len(parts) == 1 and parts[0][0]:
        return compiler.expression(parts[0][1], target)
    shown = []
    for is_expr, text in parts:
        if not is_expr:
            shown.append(F.lit(text))
            continue
        value = compiler.expression(text)
        nullable = value.type == NULL or value.type.code == "union"
        column = library.shown(value) if value.type != NULL else F.lit("")
        shown.append(F.when(value.col.isNull(), "").otherwise(column) if nullable and value.type != NULL else F.coalesce(F.when(value.col.isNotNull(), column), F.lit("")) if value.type != NULL else column)
    out = Typed(STRING, F.concat(*shown) if shown else F.lit(""), template if all(not e for e, _ in parts) else MISSING)
    return compiler.coerce(out, parse_type(target) if isinstance(target, str) else target) if target is not None else out


def accessed(template: str) -> set[str]:
    """The symbols that a format string refers to."""
    return set().union(*[parse(t).symbols for e, t in segments(template) if e])


def complexity(template: str) -> int:
    """How many nodes its expressions have."""
    return sum(1 for e, t in segments(template) if e for n in ast.walk(parse(t).tree) if isinstance(n, ast.expr))


def validate(template: str, types: Mapping[str, ExprType | str], path_format: str = "POSIX", rules: list | None = None) -> ExprType:
    """The type that a format string would have, without a row to evaluate; errors as in compilation."""
    table = {}
    for name, t in types.items():
        kind = parse_type(t) if isinstance(t, str) else t
        table[name] = Typed(kind, F.lit(None).cast(spark_type(kind)))
    return resolve(template, Compiler(Symbols(table), path_format, rules)).type


def let(df: DataFrame, bindings: Iterable[str], symbols: Symbols | None = None, prefix: str = "") -> DataFrame:
    """Add ``name = expression`` bindings to a frame, one after another; later ones see earlier ones."""
    for b in bindings:
        name, eq, expr = b.partition("=")
        name = name.strip()
        if not eq or not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
            raise ExpressionError(f"not a binding: {b!r}")
        own = Symbols.of(df, prefix)
        value = Compiler(own.merged(symbols) if symbols else own).expression(expr)
        if value.type == PATH:
            df = df.withColumn(name, value.col).withMetadata(name, {"path_format": "POSIX"})
        else:
            df = df.withColumn(name, value.col)
    return df


def select(df: DataFrame, expressions: Mapping[str, str], keep: Iterable[str] = (), functions: Library | None = None, **options) -> DataFrame:
    """Columns ``keep`` of a frame and one for each named expression over its columns."""
    compiler = Compiler(Symbols.of(df), functions=functions, **options)
    return df.select(*keep, *[compiler.expression(e).col.alias(n) for n, e in expressions.items()])


def where(df: DataFrame, condition: str, **options) -> DataFrame:
    """The rows where a bool expression over the columns holds."""
    return df.where(Compiler(Symbols.of(df), **options).expression(condition, BOOL).col)


def function(name: str, *signatures: str, into: Library | None = None) -> Callable:
    """Register a function of Columns for expressions: ``@function("twice", "(int) -> int")`` over ``lambda x: x * 2``."""
    library_ = into if into is not None else Library()

    def add(build: Callable[..., Column]):
        library_.register(name, *signatures)(lambda ctx, args: build(*[a.col for a in args]))
        build.library = library_
        return build

    return add


__all__ = ["Compiler", "ExpressionError", "NORETURN", "Parsed", "Symbols", "accessed", "complexity", "constant", "edits", "escape", "function", "let", "parse", "resolve", "segments", "select", "validate", "where"]
