"""Task parameter spaces as lazily generated frames.

A space is a tree of products ``A * B`` and associations ``(A, B)`` over dimensions. Its tasks are the integers below its
length; each dimension's value is index arithmetic on that integer, so that a space of any size is ``spark.range`` and
projections: random access, slices and order come for free, and nothing is enumerated on the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import ranges
from ..ranges import RangeExpr

#: The longest combination text, and the most values that a list dimension has.
MAX_COMBINATION = 1280
MAX_LIST = 1024
INT_MAX = (1 << 63) - 1


class SpaceError(ValueError):
    """A parameter space that can't be built."""


@dataclass(frozen=True)
class Chunks:
    default: int
    target_seconds: int = 0
    contiguous: bool = False

    @property
    def adaptive(self) -> bool:
        return self.target_seconds > 0


@dataclass(frozen=True)
class Dimension:
    """A named dimension: INT, FLOAT, STRING or PATH values as a list or, for ints, a range; or CHUNK[INT]."""

    name: str
    type: str
    values: Sequence | RangeExpr
    chunks: Chunks | None = None

    def __post_init__(self):
        if not len(self.values):
            raise SpaceError(f"{self.name} has no values")
        if not isinstance(self.values, RangeExpr) and len(self.values) > MAX_LIST:
            raise SpaceError(f"{self.name} has more than {MAX_LIST} values")

    def __len__(self) -> int:
        if not self.chunks:
            return len(self.values)
        return len(chunk_plan(self.values, self.chunks.default, self.chunks.contiguous))


# -- chunks -----------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Island:
    """A run of consecutive values, cut into ``count`` chunks of ``small`` or, at ``extra`` evenly spread slots, one more."""

    start: int
    length: int
    count: int
    small: int
    extra: int
    first: int  #: number of its first chunk


@dataclass
class ChunkPlan:
    """Chunks by number, without a list of them."""

    total: int
    values: Sequence | RangeExpr
    islands: list[Island] = field(default_factory=list)
    size: int = 0

    def __len__(self) -> int:
        return self.total


def spread(length: int, size: int) -> tuple[int, int, int]:
    """(chunks, small size, how many chunks have one more) of a contiguous run."""
    count = -(-length // size)
    if count >= length:
        return count, 1, 0
    return (count, length, 0) if count <= 1 else (count, length // count, length % count)


def consecutive(values: Sequence[int] | RangeExpr) -> list[tuple[int, int]]:
    """(start, length) of the runs of consecutive integers, ascending."""
    if isinstance(values, RangeExpr):
        parts = []
        for r in values.ranges:
            parts += [(r.start, len(r))] if r.step == 1 else [(v, 1) for v in range(r.start, r.end + 1, r.step)]
    else:
        parts = [(v, 1) for v in sorted(set(values))]
    out: list[tuple[int, int]] = []
    for start, n in parts:
        if out and out[-1][0] + out[-1][1] == start:
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append((start, n))
    return out


def chunk_plan(values: Sequence[int] | RangeExpr, size: int, contiguous: bool) -> ChunkPlan:
    if size < 1:
        raise SpaceError("a chunk has at least one task")
    if not contiguous:
        return ChunkPlan(-(-len(values) // size), values, size=size)
    islands, first = [], 0
    for start, n in consecutive(values):
        count, small, extra = spread(n, size)
        islands.append(Island(start, n, count, small, extra, first))
        first += count
    return ChunkPlan(first, values, islands, size)


def chunk_bounds(island: Island, i: int) -> tuple[int, int]:
    """(first, last) value of an island's chunk, in closed form."""
    before = lambda k: k * island.small + min(-(-k * island.extra // island.count), island.extra)
    return island.start + before(i), island.start + before(i + 1) - 1


def contiguous_chunks(df: DataFrame, start: str, length: str, size: int) -> DataFrame:
    """For rows that are islands (start, length): one row a chunk, with ``chunk`` (its number in the island), ``first`` and
    ``last``. A chunk's bounds follow from its number, so no row depends on another."""
    n, d = F.col(length), F.lit(size).cast("long")
    div = lambda a, b: F.call_function("div", a, b)
    count = div(n + d - 1, d)
    small = F.when(count >= n, 1).when(count <= 1, n).otherwise(div(n, count)).cast("long")
    extra = F.when((count >= n) | (count <= 1), 0).otherwise(n % count).cast("long")
    shaped = df.withColumn("_count", count).withColumn("_small", small).withColumn("_extra", extra).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_count") - 1)))
    before = lambda k: k * F.col("_small") + F.least(div(k * F.col("_extra") + F.col("_count") - 1, F.col("_count")), F.col("_extra"))
    return shaped.withColumn("first", F.col(start) + before(F.col("chunk"))).withColumn("last", F.col(start) + before(F.col("chunk") + 1) - 1).drop("_count", "_small", "_extra")


#: Values a bucket when a column is ordered piece by piece, about.
BUCKET = 1 << 16


def islands(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Runs of consecutive integers of a column: ``start`` and ``length``, for each group of ``by``.

    Gaps are found in buckets of 2^16 values. Only a run that touches the border of its bucket goes on to buckets of 2^40
    values, and from there to its whole group: two rows a bucket at most. So no task orders a group of unbounded size, with
    or without groups. Repeated values count once; null values are in no run.
    """
    runs = df.select(*by, F.col(value).cast("long").alias("end")).where(F.col("end").isNotNull()).distinct().withColumn("start", F.col("end"))
    done = None
    for bits in (16, 40, None):
        keys = [*by] if bits is None else [*by, "_b"]
        at = runs if bits is None else runs.withColumn("_b", F.shiftright("start", bits))
        order = Window.partitionBy(*keys).orderBy("start")
        fresh = F.when(F.lag("end").over(order) + 1 == F.col("start"), 0).otherwise(1)
        at = at.withColumn("_s", F.sum(fresh).over(order)).groupBy(*keys, "_s").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        if bits is None:
            whole = at
        else:
            # the value before the run, or the one after it, is in another bucket
            border = (F.shiftright(F.col("start") - 1, bits) != F.col("_b")) | (F.shiftright(F.col("end") + 1, bits) != F.col("_b"))
            whole, runs = at.where(~border), at.where(border).select(*by, "start", "end")
        whole = whole.select(*by, "start", (F.col("end") - F.col("start") + 1).alias("length"))
        done = whole if done is None else done.union(whole)
    return done


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "decimal")


def ranked(df: DataFrame, value: str, by: Sequence[str], into: str, total: str) -> DataFrame:
    """Add the place of each row in its group by ``value`` (``into``, from 0, nulls first) and the group's rows (``total``).

    Exact numbers are dealt into buckets between their least and greatest, BUCKET rows each if evenly spread. Buckets keep the order,
    so a place is the rows of the buckets before, from a small table of counts, and the place in the bucket: no task orders
    a group. Values of other types are ordered a group at a time.
    """
    if dict(df.dtypes)[value].split("(")[0] not in _NUMBERS:
        w = Window.partitionBy(*by)
        return df.withColumn(total, F.count("*").over(w)).withColumn(into, (F.row_number().over(w.orderBy(value)) - 1).cast("long"))
    number = F.col(value).cast("double")
    low, high, rows = (F.min(number), F.max(number), F.count("*").cast("double"))
    span = df.agg(F.struct(low.alias("low"), (high - low).alias("width"), F.ceil(rows / BUCKET).cast("double").alias("n")).alias("span")).select("span").scalar()
    # divided by the width first: the share stays within 0 to 1, and the same value always falls into the same bucket
    share = F.when(F.col("_span.width") > 0, (number - F.col("_span.low")) / F.col("_span.width")).otherwise(0.0)
    dealt = df.withColumn("_span", span).withColumn("_bucket", F.when(number.isNotNull(), F.floor(share * F.col("_span.n"))).otherwise(-1).cast("long")).drop("_span")
    sizes = dealt.groupBy(*by, "_bucket").agg(F.count("*").alias("_rows"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_rows").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = [f"_by{i}" for i in range(len(by))]
    offsets = sizes.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col("_bucket").alias("_of"), before.alias("_before"), F.sum("_rows").over(group).alias(total))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(value)) - 1)
    on = F.col("_bucket") == F.col("_of")
    for c, n in zip(by, names, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(n))
    return own.join(offsets, on).withColumn(into, (F.col("_own") + F.col("_before")).cast("long")).drop("_bucket", "_own", "_of", "_before", *names)


def static_chunks(df: DataFrame, value: str, size: int, by: Sequence[str] = ()) -> DataFrame:
    """Number the rows' chunks of about ``size`` separate values in order; the first chunks take what is over, one each."""
    n, i = F.col("_n"), F.col("_i")
    count = F.call_function("div", n + size - 1, F.lit(size).cast("long"))
    small, extra = F.call_function("div", n, count), n % count
    wide = extra * (small + 1)
    chunk = F.when(i < wide, F.call_function("div", i, small + 1)).otherwise(extra + F.call_function("div", i - wide, F.greatest(small, F.lit(1))))
    return ranked(df, value, by, "_i", "_n").withColumn("chunk", chunk).drop("_i", "_n")


# -- combination expressions ------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Node:
    """``leaf`` of a dimension, ``product`` or ``association`` of nodes."""

    kind: str
    parts: tuple = ()
    name: str = ""


_TOKEN = re.compile(r"\s*([A-Za-z_][A-Za-z0-9_]*|[*(),])")


def parse_combination(text: str, names: Sequence[str]) -> Node:
    """The tree of a combination such as ``A * (B, C)``; each name must occur exactly once."""
    if len(text) > MAX_COMBINATION:
        raise SpaceError(f"a combination has at most {MAX_COMBINATION} characters")
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise SpaceError(f"unexpected {text[at:].strip()[:1]!r} in combination {text!r}")
        tokens.append(m[1])
        at = m.end()
    used: list[str] = []

    def product(i: int) -> tuple[Node, int]:
        part, i = element(i)
        parts = [part]
        while i < len(tokens) and tokens[i] == "*":
            part, i = element(i + 1)
            parts.append(part)
        return (parts[0] if len(parts) == 1 else Node("product", tuple(parts))), i

    def element(i: int) -> tuple[Node, int]:
        if i >= len(tokens):
            raise SpaceError(f"combination {text!r} ends too early")
        if tokens[i] == "(":
            part, i = product(i + 1)
            parts = [part]
            while i < len(tokens) and tokens[i] == ",":
                part, i = product(i + 1)
                parts.append(part)
            if i >= len(tokens) or tokens[i] != ")":
                raise SpaceError(f"unbalanced parentheses in combination {text!r}")
            if len(parts) < 2:
                raise SpaceError("an association has at least two terms")
            return Node("association", tuple(parts)), i + 1
        if tokens[i] in "*,)":
            raise SpaceError(f"unexpected {tokens[i]!r} in combination {text!r}")
        used.append(tokens[i])
        return Node("leaf", name=tokens[i]), i + 1

    tree, end = product(0)
    if end != len(tokens):
        raise SpaceError(f"unexpected {tokens[end]!r} in combination {text!r}")
    unknown = [n for n in used if n not in names]
    if unknown:
        raise SpaceError(f"combination names {unknown[0]!r}, which is no parameter")
    twice = [n for n in used if used.count(n) > 1]
    if twice:
        raise SpaceError(f"combination names {twice[0]!r} more than once")
    missing = [n for n in names if n not in used]
    if missing:
        raise SpaceError(f"combination leaves out {missing[0]!r}")
    return tree


# -- the space --------------------------------------------------------------------------------------------------------
class Space:
    """A parameter space. ``combination`` defaults to the product of all dimensions in their order, the last fastest.

    ``chunk_size`` overrides the default size of all chunked dimensions and turns adaptive ones into fixed ones. An
    adaptive dimension is innermost; its space has no fixed length (``len`` is 0) and is planned by :class:`Adaptive`.
    """

    def __init__(self, dimensions: Sequence[Dimension] = (), combination: str | None = None, chunk_size: int | None = None):
        dims = []
        for d in dimensions:
            if d.chunks and chunk_size:
                d = Dimension(d.name, d.type, d.values, Chunks(chunk_size, 0, d.chunks.contiguous))
            dims.append(d)
        self.dimensions = {d.name: d for d in dims}
        if len(self.dimensions) != len(dims):
            raise SpaceError("two dimensions have one name")
        if sum(1 for d in dims if d.chunks) > 1:
            raise SpaceError("at most one dimension has chunks")
        names = list(self.dimensions)
        product = Node("product", tuple(Node("leaf", name=n) for n in names)) if len(names) > 1 else Node("leaf", name=names[0]) if names else Node("product")
        self.combination = combination
        self.tree = parse_combination(combination, names) if combination else product
        self.adaptive = next((d for d in dims if d.chunks and d.chunks.adaptive), None)
        self._check(self.tree)
        if self.adaptive:
            self.tree = self._innermost(self.tree, self.adaptive.name)
        self.length = 0 if self.adaptive else self._length(self.tree)

    def _check(self, node: Node) -> None:
        for p in node.parts:
            self._check(p)
        if node.kind == "association":
            if any(self.dimensions[n].chunks for n in leaves(node)):
                raise SpaceError("a chunked dimension can't be associated")
            lengths = {self._length(p) for p in node.parts}
            if len(lengths) > 1:
                raise SpaceError("associated terms have different lengths")

    def _innermost(self, node: Node, name: str) -> Node:
        if node.kind != "product":
            return node
        rest = [p for p in node.parts if name not in leaves(p)]
        return Node("product", (*rest, *[p for p in node.parts if name in leaves(p)]))

    def _length(self, node: Node) -> int:
        if node.kind == "leaf":
            return len(self.dimensions[node.name])
        if node.kind == "association":
            return self._length(node.parts[0])
        n = math.prod(self._length(p) for p in node.parts)
        if n > INT_MAX:
            raise SpaceError("a space has fewer than 2^63 tasks")
        return n

    def __len__(self) -> int:
        return self.length

    @property
    def names(self) -> list[str]:
        return list(self.dimensions)

    def at(self, index: int) -> dict:
        """The task of an index, negative from the end."""
        if self.adaptive:
            raise SpaceError("an adaptive space has no random access")
        i = index + self.length if index < 0 else index
        if not 0 <= i < self.length:
            raise IndexError(index)
        out: dict = {}
        self._at(self.tree, i, out)
        return {n: out[n] for n in self.dimensions}

    def _at(self, node: Node, i: int, out: dict) -> None:
        if node.kind == "leaf":
            d = self.dimensions[node.name]
            out[node.name] = chunk_value(chunk_plan(d.values, d.chunks.default, d.chunks.contiguous), i) if d.chunks else d.values[i]
        elif node.kind == "association":
            for p in node.parts:
                self._at(p, i, out)
        else:
            for p in reversed(node.parts):
                n = self._length(p)
                self._at(p, i % n, out)
                i //= n

    def tasks(self, spark: SparkSession, start: int = 0, stop: int | None = None, partitions: int | None = None) -> DataFrame:
        """``task_index`` and a column for each dimension, of all tasks or of those from start to before stop."""
        if self.adaptive:
            raise SpaceError("an adaptive space is planned task by task")
        last = self.length if stop is None else min(stop, self.length)
        rows = spark.range(start, last, 1, partitions) if partitions else spark.range(start, last)
        cols = self.columns(F.col("id"))
        return rows.select(F.col("id").alias("task_index"), *[cols[n].alias(n) for n in self.dimensions])

    def columns(self, index: Column) -> dict[str, Column]:
        """Each dimension's value at a task index."""
        out: dict[str, Column] = {}
        self._columns(self.tree, index, out)
        return out

    def _columns(self, node: Node, i: Column, out: dict[str, Column]) -> None:
        if node.kind == "leaf":
            out[node.name] = leaf_column(self.dimensions[node.name], i)
        elif node.kind == "association":
            for p in node.parts:
                self._columns(p, i, out)
        else:
            below = 1
            for p in reversed(node.parts):
                n = self._length(p)
                at = F.call_function("div", i, F.lit(below).cast("long")) if below > 1 else i
                self._columns(p, at % F.lit(n).cast("long"), out)
                below *= n

    def contains(self, df: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
        """The rows of df that are tasks of the space: native predicates on the dimensions' columns, associations by equal
        positions, chunks as texts of values that the range holds."""
        names = {n: (columns or {}).get(n, n) for n in self.dimensions}
        return df.where(self._contains(self.tree, names)) if self.dimensions else df

    def _contains(self, node: Node, names: Mapping[str, str]) -> Column:
        if node.kind == "association":
            singles = [n for p in node.parts for n in leaves(p)]
            where = [positions(self.dimensions[n], F.col(f"`{names[n]}`")) for n in singles]
            common = where[0]
            for w in where[1:]:
                common = F.array_intersect(common, w)
            return F.size(common) > 0
        if node.kind == "product":
            out = F.lit(True)
            for p in node.parts:
                out = out & self._contains(p, names)
            return out
        d, c = self.dimensions[node.name], F.col(f"`{names[node.name]}`")
        if d.chunks:
            whole = RangeExpr(d.values.ranges) if isinstance(d.values, RangeExpr) else RangeExpr.from_values(d.values)
            members = ranges.expand(ranges.parse_column(c.cast("string")))
            return F.forall(members, lambda v: ranges.contains(whole.column(), v))
        if isinstance(d.values, RangeExpr):
            return ranges.contains(d.values.column(), c)
        return c.isin(*d.values)


def leaves(node: Node) -> list[str]:
    return [node.name] if node.kind == "leaf" else [n for p in node.parts for n in leaves(p)]


def positions(d: Dimension, c: Column) -> Column:
    """The positions at which a dimension has a value, as an array."""
    if isinstance(d.values, RangeExpr):
        at, before = F.array().cast("array<bigint>"), 0
        for r in d.values.ranges:
            inside = c.between(r.start, r.end) & ((c - r.start) % r.step == 0)
            at = F.when(inside, F.array(F.call_function("div", (c - r.start).cast("long"), F.lit(r.step).cast("long")) + before)).otherwise(at)
            before += len(r)
        return at
    by: dict = {}
    for i, v in enumerate(d.values):
        by.setdefault(v, []).append(i)
    out = F.array().cast("array<bigint>")
    for v, found in by.items():
        out = F.when(c == F.lit(v), F.array(*[F.lit(i).cast("long") for i in found])).otherwise(out)
    return out


def leaf_column(d: Dimension, i: Column) -> Column:
    """A dimension's value at a position: arithmetic for ranges, an array literal for lists, text for chunks."""
    if d.chunks:
        return chunk_column(chunk_plan(d.values, d.chunks.default, d.chunks.contiguous), i)
    if isinstance(d.values, RangeExpr):
        return range_at(d.values, i)
    kind = {"INT": "bigint", "FLOAT": "double"}.get(d.type, "string")
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in d.values]), (i + 1).cast("int"))


def range_at(r: RangeExpr, i: Column) -> Column:
    """The i-th value: arithmetic over few sub-ranges, or a literal of (start, step, first position) triples for many."""
    if len(r.ranges) > 16:
        return ranges.get(r.column(), i)
    out, before = None, len(r)
    for part in reversed(r.ranges):
        before -= len(part)
        value = F.lit(part.start).cast("long") + (i - before) * part.step
        out = value if out is None else F.when(i < before + len(part), value).otherwise(out)
    return out


def chunk_value(plan: ChunkPlan, i: int) -> str:
    if plan.islands:
        k = next(x for x in reversed(plan.islands) if x.first <= i)
        return "{}-{}".format(*chunk_bounds(k, i - k.first))
    n, count = len(plan.values), plan.total
    a, z = i * (n // count) + min(i, n % count), (i + 1) * (n // count) + min(i + 1, n % count)
    return ranges.chunk_text([plan.values[j] for j in range(a, z)])


def chunk_column(plan: ChunkPlan, i: Column) -> Column:
    if plan.islands:
        item = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in (("start", k.start), ("count", k.count), ("small", k.small), ("extra", k.extra), ("first", k.first))]) for k in plan.islands])
        own = F.element_at(F.filter(item, lambda k: k["first"] <= i), -1)
        before = lambda k: k * own["small"] + F.least(F.call_function("div", k * own["extra"] + own["count"] - 1, own["count"]), own["extra"])
        k = i - own["first"]
        return F.concat((own["start"] + before(k)).cast("string"), F.lit("-"), (own["start"] + before(k + 1) - 1).cast("string"))
    n, count = len(plan.values), plan.total
    edge = lambda k: k * (n // count) + F.least(k, F.lit(n % count).cast("long"))
    a, z = edge(i), edge(i + 1)
    values = plan.values if isinstance(plan.values, RangeExpr) else RangeExpr.from_values(plan.values)
    solid = len(values.ranges) == 1 and values.ranges[0].step == 1
    if solid:
        start = values.ranges[0].start
        low, high = start + a, start + z - 1
        return F.when(a + 1 == z, low.cast("string")).when(a + 2 == z, F.concat(low.cast("string"), F.lit(","), high.cast("string"))).otherwise(F.concat(low.cast("string"), F.lit("-"), high.cast("string")))
    members = F.transform(F.sequence(a, z - 1), lambda j: range_at(values, j))
    return chunk_text_column(members)


def chunk_text_column(values: Column) -> Column:
    """The text of chunks given as arrays of integers."""
    @F.pandas_udf("string")
    def text(lists: pd.Series) -> pd.Series:
        return pd.Series([ranges.chunk_text([int(v) for v in x]) for x in lists])

    return text(values)


# -- adaptive chunks --------------------------------------------------------------------------------------------------
#: Tasks during which a size grows slowly, and the share of the size before in it.
SETTLING, INERTIA = 10, 0.75


def next_size(size: int, done: int, seconds: float, values: int, target: float, longest: int) -> int:
    """The chunk size after ``done`` tasks that took ``seconds`` for ``values`` values together."""
    mean = seconds / values if values else 0.0
    ideal = target / mean if mean > 0 else float(longest)
    if done < SETTLING and ideal > size:
        ideal = INERTIA * size + (1 - INERTIA) * ideal
    return max(1, int(ideal))


def adaptive_chunks(finished: DataFrame, by: str, order: str, seconds: str, values: str, default: int, target: float, length: int) -> DataFrame:
    """The chunk that follows each finished task (by, order, its seconds and count of values) over a dimension of ``length`` values:
    (by, order, size, first, end), where the first chunk, of ``default`` values, was given out before any task ended.

    The size is the target over the mean time of a value so far; while fewer than ten tasks have ended, one that would grow is blended
    75 to 25 with the size before; at least 1. ``first`` and ``end`` (exclusive) are positions; both are ``length`` once nothing is left.
    A null time or count counts as 0; a null ``by`` is a group. From the tenth task on a size follows from running sums alone, so a row
    looks back at nine numbers.
    """
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    took, count = F.sum(F.coalesce(F.col(seconds).cast("double"), F.lit(0.0))).over(w), F.sum(F.coalesce(F.col(values).cast("long"), F.lit(0))).over(w)
    told = finished.select(by, order, took.alias("_took"), count.alias("_count"), F.row_number().over(w).alias("_done"))
    ideal = F.when((F.col("_took") > 0) & (F.col("_count") > 0), F.lit(float(target)) / (F.col("_took") / F.col("_count"))).otherwise(F.lit(float(length)))
    told = told.withColumn("_ideal", ideal)
    first = F.collect_list(F.when(F.col("_done") < SETTLING, F.col("_ideal"))).over(w)

    def blend(size: Column, ideal: Column) -> Column:
        return F.greatest(F.lit(1.0), F.floor(F.when(ideal > size, INERTIA * size + (1 - INERTIA) * ideal).otherwise(ideal)).cast("double"))

    size = F.when(F.col("_done") < SETTLING, F.aggregate(first, F.lit(float(default)), blend)).otherwise(F.greatest(F.lit(1.0), F.floor("_ideal").cast("double"))).cast("long")
    sized = told.withColumn("size", size)
    start = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.lit(default)
    at = F.least(start, F.lit(length)).cast("long")
    return sized.select(by, order, "size", at.alias("first"), F.least(at + F.col("size"), F.lit(length)).cast("long").alias("end"))


class Adaptive:
    """Chunk sizes that follow task times, for one caller that runs tasks one by one and asks for the next. Many runs at once are
    :func:`adaptive_chunks` and, as tasks end, :func:`taskspace.streaming.chunks.chunk_stream`."""

    def __init__(self, space: Space):
        if not space.adaptive:
            raise SpaceError("no dimension is adaptive")
        self.dimension = space.adaptive
        others = [d for d in space.dimensions.values() if d.name != self.dimension.name]
        self.outer = Space(others)
        self.order = space.names
        self.size = self.dimension.chunks.default
        self.done = self.values = 0
        self.seconds = 0.0
        self.task = self.position = 0

    def record(self, seconds: float, values: int) -> int:
        """Take in a finished task's time and value count; the size of chunks from now on."""
        self.done += 1
        self.seconds += seconds
        self.values += values
        self.size = next_size(self.size, self.done, self.seconds, self.values, self.dimension.chunks.target_seconds, len(self.dimension.values))
        return self.size

    def next(self) -> dict | None:
        """The next task, or None: the rest of the innermost dimension first, then the next combination of the others."""
        v = self.dimension.values
        if self.position >= len(v):
            self.position, self.task = 0, self.task + 1
        if self.task >= max(1, len(self.outer)):
            return None
        out = self.outer.at(self.task) if len(self.outer.dimensions) else {}
        end = self.position + 1
        while end < len(v) and end - self.position < self.size and not (self.dimension.chunks.contiguous and v[end] != v[end - 1] + 1):
            end += 1
        members = [v[i] for i in range(self.position, end)]
        self.position = end
        out[self.dimension.name] = f"{members[0]}-{members[-1]}" if self.dimension.chunks.contiguous else ranges.chunk_text(members)
        return {n: out[n] for n in self.order}
