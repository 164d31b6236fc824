"""Integer range expressions: ``1-10:2,20``.

On the driver a :class:`RangeExpr` stays symbolic. In a frame a range is a struct of ascending (start, end, step) triples and
a display flag; the Column functions below work on that without expanding it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import RANGE_STRUCT

#: Values stay below this magnitude, and an expression has at most so many sub-ranges.
VALUE_LIMIT = 1 << 62
MAX_RANGES = 10_000


class RangeError(ValueError):
    """A range expression that can't be read, overlaps, or leaves the domain."""


@dataclass(frozen=True)
class IntRange:
    start: int
    end: int
    step: int = 1

    @classmethod
    def of(cls, start: int, end: int, step: int = 1) -> IntRange:
        """Ascending, with the end that is reached. A range must not point away from its end."""
        if step == 0:
            raise RangeError("Step must not be zero")
        if max(abs(start), abs(end), abs(step)) >= VALUE_LIMIT:
            raise RangeError("Integer overflow in range expression")
        if (end - start) * step < 0:
            raise RangeError(f"range {start}-{end} does not go in the direction of its step {step}")
        last = start + (end - start) // step * step
        low, high = min(start, last), max(start, last)
        return cls(low, high, abs(step) if low != high else 1)

    def __len__(self) -> int:
        return (self.end - self.start) // self.step + 1

    def __str__(self) -> str:
        if self.start == self.end:
            return str(self.start)
        if self.end == self.start + self.step:
            return f"{self.start},{self.end}"
        return f"{self.start}-{self.end}" + (f":{self.step}" if self.step != 1 else "")


class RangeExpr:
    def __init__(self, ranges: Iterable[IntRange], contiguous: bool = False):
        self.ranges = tuple(ranges)
        self.contiguous = contiguous
        self._ends = list(accumulate(len(r) for r in self.ranges))

    @classmethod
    def parse(cls, text: str) -> RangeExpr:
        text = text.strip(" \t\n\r\f\v")
        if not text:
            raise RangeError("Empty expression")
        found = []
        for part in text.split(","):
            m = re.fullmatch(r"[ \t\n\r\f]*(-?[0-9]+)[ \t\n\r\f]*(?:-[ \t\n\r\f]*(-?[0-9]+)[ \t\n\r\f]*(?::[ \t\n\r\f]*(-?[0-9]+)[ \t\n\r\f]*)?)?", part)
            if not m:
                raise RangeError(f"Trailing comma in range expression: {text!r}" if not part.strip() else f"Expected a range, not {part.strip()!r}, in {text!r}")
            start, end = int(m[1]), int(m[2] if m[2] is not None else m[1])
            if m[3] is None and start > end:
                raise RangeError(f"Descending range {start}-{end} requires a negative step")
            found.append(IntRange.of(start, end, int(m[3]) if m[3] is not None else 1))
            if len(found) > MAX_RANGES:
                raise RangeError(f"Range expression has too many sub-ranges (> {MAX_RANGES})")
        return cls.union(found)

    @classmethod
    def union(cls, ranges: Iterable[IntRange]) -> RangeExpr:
        """Sorted; neighbours of one step that continue each other merge; overlaps are errors."""
        ordered = sorted(ranges, key=lambda r: (r.start, r.end))
        if not ordered:
            raise RangeError("Range expression cannot be empty")
        if len(ordered) > MAX_RANGES:
            raise RangeError(f"Range expression has too many sub-ranges ({len(ordered)}); maximum is {MAX_RANGES}")
        out = ordered[:1]
        for r in ordered[1:]:
            last = out[-1]
            if last.step == r.step and last.end + r.step == r.start:
                out[-1] = IntRange(last.start, r.end, r.step)
            elif r.start <= last.end:
                raise RangeError(f"Range expression has overlapping ranges: {last} and {r}")
            else:
                out.append(r)
        return cls(out)

    @classmethod
    def from_values(cls, values: Iterable[int]) -> RangeExpr:
        """The shortest greedy runs of two or more sorted distinct values."""
        v = sorted(set(values))
        if any(abs(x) >= VALUE_LIMIT for x in v):
            raise RangeError("Integer overflow in range expression")
        return cls(IntRange(*r) for r in runs(v, 2))

    def __len__(self) -> int:
        return self._ends[-1] if self._ends else 0

    def __iter__(self) -> Iterator[int]:
        for r in self.ranges:
            yield from range(r.start, r.end + 1, r.step)

    def __getitem__(self, i: int) -> int:
        n = len(self)
        at = i + n if i < 0 else i
        if not 0 <= at < n:
            raise IndexError(f"Index {i} out of range for range expression of length {n}")
        k = bisect_right(self._ends, at)
        r = self.ranges[k]
        return r.start + (at - (self._ends[k - 1] if k else 0)) * r.step

    def __contains__(self, value: object) -> bool:
        return any(r.start <= value <= r.end and (value - r.start) % r.step == 0 for r in self.ranges)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, RangeExpr) and (self.ranges == other.ranges or (len(self) == len(other) and all(a == b for a, b in zip(self, other, strict=True))))

    __hash__ = None

    def slice(self, start: int | None, stop: int | None, step: int | None) -> RangeExpr | list[int]:
        """A forward slice stays a range; a backward one is a list."""
        chosen = range(len(self))[start:stop:step]
        if (step or 1) < 0:
            return [self[i] for i in chosen]
        out, before = [], 0
        for r in self.ranges:
            n = len(r)
            first = max(0, -(-(before - chosen.start) // chosen.step)) if len(chosen) else 0
            here = range(chosen.start + first * chosen.step, min(chosen.stop, before + n), chosen.step) if len(chosen) else ()
            if len(here):
                a, z = r.start + (here[0] - before) * r.step, r.start + (here[-1] - before) * r.step
                out.append(IntRange(a, z, r.step * chosen.step if a != z else 1))
            before += n
        return RangeExpr(out)

    def __str__(self) -> str:
        if self.contiguous and len(self.ranges) == 1 and (self.ranges[0].step == 1 or len(self) == 1):
            return f"{self.ranges[0].start}-{self.ranges[0].end}"
        return ",".join(map(str, self.ranges))

    def row(self) -> tuple:
        return [(r.start, r.end, r.step) for r in self.ranges], self.contiguous

    def column(self) -> Column:
        """The range as a literal struct."""
        items = [F.struct(*[F.lit(v).cast("long").alias(n) for n, v in (("start", r.start), ("end", r.end), ("step", r.step))]) for r in self.ranges]
        ranges = F.array(*items) if items else F.array().cast(RANGE_STRUCT["ranges"].dataType)
        return F.struct(ranges.alias("ranges"), F.lit(self.contiguous).alias("contiguous"))


def runs(values: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Greedy arithmetic runs of at least ``least`` sorted values, others alone. 2 is the rule of range expressions, 3 that of
    chunk texts."""
    i = 0
    while i < len(values):
        j = i + 1
        if j < len(values):
            step = values[j] - values[i]
            if step < VALUE_LIMIT:
                while j + 1 < len(values) and values[j + 1] - values[j] == step:
                    j += 1
                if j - i + 1 >= least:
                    yield values[i], values[j], step
                    i = j + 1
                    continue
        yield values[i], values[i], 1
        i += 1


def chunk_text(values: list[int]) -> str:
    """The text of a chunk of separate values: runs of three or more are ranges."""
    out = []
    for a, z, step in runs(sorted(set(values)), 3):
        out.append(str(a) if a == z else f"{a}-{z}" + (f":{step}" if step != 1 else ""))
    return ",".join(out)


# -- ranges as columns ------------------------------------------------------------------------------------------------
def length(c: Column) -> Column:
    return F.aggregate(c["ranges"], F.lit(0).cast("long"), lambda n, r: n + 1 + _div(r["end"] - r["start"], r["step"]))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def contains(c: Column, value: Column) -> Column:
    return F.exists(c["ranges"], lambda r: value.between(r["start"], r["end"]) & ((value - r["start"]) % r["step"] == 0))


def expand(c: Column) -> Column:
    """All values, as an array; for ranges that are small. Large ones belong in :mod:`taskspace.operators.space`."""
    return F.flatten(F.transform(c["ranges"], lambda r: F.sequence(r["start"], r["end"], r["step"])))


def total(c: Column) -> Column:
    """The sum in closed form, checked: an overflow of 64 bits is an error."""
    wide = lambda x: x.cast("decimal(38,0)")
    part = lambda r: wide((_div(r["end"] - r["start"], r["step"]) + 1).cast("decimal(19,0)") * (r["start"] + r["end"]).cast("decimal(19,0)")) / F.lit(2)
    return F.aggregate(c["ranges"], F.lit(0).cast("decimal(38,0)"), lambda n, r: wide(n + wide(part(r)))).cast("long")


def minimum(c: Column) -> Column:
    return F.element_at(c["ranges"], 1)["start"]


def maximum(c: Column) -> Column:
    return F.element_at(c["ranges"], -1)["end"]


def get(c: Column, index: Column) -> Column:
    """The value at an index, negative from the end; out of bounds is an error."""
    n = length(c)
    at = F.when(index < 0, index + n).otherwise(index)
    start = F.struct(at.alias("left"), F.lit(None).cast("long").alias("v"))

    def step(acc: Column, r: Column) -> Column:
        size = _div(r["end"] - r["start"], r["step"]) + 1
        here = acc["v"].isNull() & (acc["left"] >= 0) & (acc["left"] < size)
        return F.struct((acc["left"] - size).alias("left"), F.when(here, r["start"] + acc["left"] * r["step"]).otherwise(acc["v"]).alias("v"))

    found = F.aggregate(c["ranges"], start, step)["v"]
    return F.when((at >= 0) & (at < n), found).otherwise(F.raise_error(F.lit("Index out of range")).cast("long"))


def display(c: Column) -> Column:
    """The text of a range column."""

    def one(r: Column) -> Column:
        a, z, s = r["start"].cast("string"), r["end"].cast("string"), r["step"]
        stepped = F.concat(a, F.lit("-"), z, F.when(s != 1, F.concat(F.lit(":"), s.cast("string"))).otherwise(""))
        return F.when(r["start"] == r["end"], a).when(r["end"] == r["start"] + s, F.concat(a, F.lit(","), z)).otherwise(stepped)

    plain = F.array_join(F.transform(c["ranges"], one), ",")
    only = F.element_at(c["ranges"], 1)
    solid = c["contiguous"] & (F.size(c["ranges"]) == 1) & ((F.try_element_at(c["ranges"], F.lit(1))["step"] == 1) | (length(c) == 1))
    return F.when(solid, F.concat(only["start"].cast("string"), F.lit("-"), only["end"].cast("string"))).otherwise(plain)


def parse_column(text: Column) -> Column:
    """Range structs of a text column; a text that isn't a range is an error, null stays null."""
    @F.pandas_udf(RANGE_STRUCT)
    def parse(texts: pd.Series) -> pd.DataFrame:
        rows = [RangeExpr.parse(t).row() if isinstance(t, str) else (None, None) for t in texts]
        return pd.DataFrame({"ranges": [[{"start": a, "end": z, "step": s} for a, z, s in r[0]] if r[0] is not None else None for r in rows], "contiguous": [r[1] for r in rows]})

    return F.when(text.isNotNull(), parse(text))


def compress_column(values: Column) -> Column:
    """Range structs of a column of integer arrays; an empty array is an error."""
    @F.pandas_udf(RANGE_STRUCT)
    def compress(lists: pd.Series) -> pd.DataFrame:
        rows = [RangeExpr.from_values(map(int, x)).row() if x is not None else (None, None) for x in lists]
        if any(r[0] == [] for r in rows):
            raise RangeError("Cannot create an empty range expression")
        return pd.DataFrame({"ranges": [[{"start": a, "end": z, "step": s} for a, z, s in r[0]] if r[0] is not None else None for r in rows], "contiguous": [r[1] for r in rows]})

    return F.when(values.isNotNull(), compress(values))
