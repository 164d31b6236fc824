"""Overloads of the expression language: registration by signature text and resolution at compile time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column

from ..types import FLOAT, INT, NORETURN, PATH, STRING, ExprType, Signature, has_variables, matches, parse_signature, satisfies, substitute, union, without_null

MISSING = object()


@dataclass
class Typed:
    """A compiled expression: its type and Column, and where known its constant and the text it is shown as."""

    type: ExprType
    col: Column
    const: object = MISSING
    text: Column | None = None
    elements: list | None = None


@dataclass
class Context:
    """What functions may depend on besides their arguments."""

    path_format: str = "POSIX"
    rules: list | None = None


@dataclass
class Overload:
    signature: Signature
    build: Callable[[Context, list[Typed]], Column | Typed]


class NoOverload(TypeError):
    """No signature of a function takes these arguments."""


@dataclass
class Library:
    table: dict[str, list[Overload]] = field(default_factory=dict)

    def register(self, name: str, *signatures: str):
        """Register a builder under one or more signatures; it gets the context and the typed arguments."""

        def add(build):
            self.table.setdefault(name, []).extend(Overload(parse_signature(s), build) for s in signatures)
            return build

        return add

    def merged(self, other: Library) -> Library:
        """The overloads of both; those of ``other`` come after."""
        return Library({n: [*self.table.get(n, []), *other.table.get(n, [])] for n in {**self.table, **other.table}})

    def resolve(self, name: str, args: list[ExprType], method: bool = False) -> tuple[Overload, list[ExprType], ExprType]:
        """(overload, types that the arguments must have, result): exact signatures first, then those that take int for float
        or path for string (never for a method's receiver), then generic ones."""
        if name not in self.table:
            raise NoOverload(f"unknown function {name}()")
        asked = [union(without_null(a)) if a.code == "union" else a for a in args]
        same = [o for o in self.table[name] if len(o.signature.params) == len(args)]
        for way in ("exact", "coerced", "generic"):
            for o in same:
                generic = any(has_variables(p) for p in o.signature.params)
                if generic != (way == "generic"):
                    continue
                bound: dict[str, ExprType] = {}
                want = []
                for i, (p, full, have) in enumerate(zip(o.signature.params, args, asked, strict=True)):
                    if generic:
                        fits = matches(have, p, bound)
                        want.append(have)
                    else:
                        fits = satisfies(full, p) or satisfies(have, p)
                        target = p
                        if not fits and way == "coerced" and not (method and i == 0):
                            fits = coercible(have, p)
                        want.append(target if p.code != "union" else have)
                    if not fits:
                        break
                else:
                    return o, want, substitute(o.signature.result, bound)
        raise NoOverload(f"{name}() does not take ({', '.join(map(str, args))})")

    def static_type(self, name: str, args: list[ExprType], method: bool = False) -> ExprType:
        return self.resolve(name, args, method)[2]

    def property_type(self, name: str, owner: ExprType) -> ExprType:
        return self.static_type(f"__property_{name}__", [owner])


def coercible(have: ExprType, want: ExprType) -> bool:
    if (have, want) in ((INT, FLOAT), (PATH, STRING)):
        return True
    return have.code == want.code == "list" and coercible(have.item, want.item)


def with_type(t: Typed, kind: ExprType) -> Typed:
    return replace(t, type=kind)


__all__ = ["Context", "Library", "MISSING", "NoOverload", "Overload", "Typed", "coercible", "with_type", "NORETURN", "STRING"]
