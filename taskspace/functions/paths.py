"""Path algebra for POSIX, Windows and URI paths: pure functions, and Arrow functions over columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import PurePosixPath, PureWindowsPath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_URI = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*://[^/]*)(?:/(.*))?", re.S)
#: Fixed value: the widest number padding.
MAX_PADDING = 32


class PathError(ValueError):
    """A path operation that has no result."""


def is_uri(p: str) -> bool:
    return bool(_URI.fullmatch(p))


def _uri(p: str) -> tuple[str, list[str]]:
    m = _URI.fullmatch(p)
    return m[1], m[2].split("/") if m[2] else []


def _pure(p: str, fmt: str):
    return PureWindowsPath(p) if fmt == "WINDOWS" else PurePosixPath(p)


def normalise(p: str, fmt: str) -> str:
    """As a path is written: empty and ``.`` parts dropped, ``..`` kept; URIs verbatim."""
    return p if is_uri(p) else str(_pure(p, fmt))


def name(p: str, fmt: str) -> str:
    if is_uri(p):
        parts = _uri(p)[1]
        return parts[-1] if parts else ""
    return _pure(p, fmt).name


def split_suffix(n: str) -> tuple[str, str]:
    """(stem, suffix) of a name: a last dot counts if it is neither first nor last."""
    i = n.rfind(".")
    return (n[:i], n[i:]) if 0 < i < len(n) - 1 else (n, "")


def stem(p: str, fmt: str) -> str:
    return split_suffix(name(p, fmt))[0]


def suffix(p: str, fmt: str) -> str:
    return split_suffix(name(p, fmt))[1]


def suffixes(p: str, fmt: str) -> list[str]:
    n = name(p, fmt)
    return [] if n.endswith(".") else ["." + x for x in n.lstrip(".").split(".")[1:]]


def parent(p: str, fmt: str) -> str:
    if is_uri(p):
        authority, parts = _uri(p)
        return "/".join([authority, *parts[:-1]])
    return str(_pure(p, fmt).parent)


def parts(p: str, fmt: str) -> list[str]:
    if is_uri(p):
        authority, rest = _uri(p)
        return [authority, *rest]
    return list(_pure(p, fmt).parts)


def join(p: str, child: str, fmt: str) -> str:
    """A child below a path; an absolute child, or a URI, stands for itself."""
    if is_uri(child):
        return child
    if is_uri(p):
        authority, rest = _uri(p)
        if rest and not rest[-1]:
            rest = rest[:-1]
        return "/".join([authority, *rest, child])
    return str(_pure(p, fmt) / child)


def from_parts(items: Iterable[str], fmt: str) -> str:
    items = list(items)
    if not items:
        return "."
    out = normalise(items[0], fmt)
    for x in items[1:]:
        out = join(out, x, fmt)
    return out


def is_absolute(p: str, fmt: str) -> bool:
    if is_uri(p) or p[:2] in ("//", "\\\\"):
        return True
    return bool(re.match(r"[A-Za-z]:[\\/]", p)) if fmt == "WINDOWS" else p.startswith("/")


def _valid_name(n: str, fmt: str) -> bool:
    return n not in ("", ".") and "/" not in n and not (fmt == "WINDOWS" and "\\" in n)


def _named(p: str, new: str, fmt: str, what: str) -> str:
    if not name(p, fmt):
        raise PathError(f"{what}: '{p}' has an empty name")
    if not _valid_name(new, fmt):
        raise PathError(f"{what}: Invalid name '{new}'")
    if is_uri(p):
        return f"{parent(p, fmt)}/{new}"
    up = parent(p, fmt)
    if up == ".":
        return f".\\{new}" if fmt == "WINDOWS" and re.match(r"[A-Za-z]:", new) else new
    tight = up.endswith("/") or fmt == "WINDOWS" and (up.endswith("\\") or re.fullmatch(r"[A-Za-z]:", up))
    return up + ("" if tight else "\\" if fmt == "WINDOWS" else "/") + new


def with_name(p: str, n: str, fmt: str) -> str:
    return _named(p, n, fmt, "with_name")


def with_stem(p: str, s: str, fmt: str) -> str:
    if not _valid_name(s, fmt) and s != "":
        raise PathError(f"with_stem: Invalid name '{s}'")
    end = suffix(p, fmt)
    if s == "" and end:
        raise PathError(f"with_stem: '{p}' has a non-empty suffix")
    return _named(p, s + end, fmt, "with_stem")


def with_suffix(p: str, s: str, fmt: str) -> str:
    if s and (not s.startswith(".") or s == "." or "/" in s or (fmt == "WINDOWS" and "\\" in s)):
        raise PathError(f"with_suffix: Invalid suffix '{s}'")
    return _named(p, stem(p, fmt) + s, fmt, "with_suffix")


def padded(number: int, width: int) -> str:
    return f"{number:0{width}d}"


def numbered(s: str, number: int) -> str:
    """A stem with its frame number replaced: %d or %0Nd, else the last run of #, else trailing digits, else appended."""

    def width(n: int) -> int:
        if n > MAX_PADDING:
            raise PathError(f"with_number: padding width {n} exceeds maximum of {MAX_PADDING}")
        return n

    head, mark, tail = s.rpartition("%")
    if mark and tail == "d":
        return f"{head}{number}"
    if mark and re.fullmatch(r"0.*d", tail, re.S):
        return head + padded(number, width(int(tail[1:-1]) if re.fullmatch(r"\+?[0-9]+", tail[1:-1]) else 1))
    hashes = re.match(r"(?s)(.*?)(#+)[^#]*\Z", s)
    if hashes:
        return hashes[1] + padded(number, width(len(hashes[2])))
    digits = re.search(r"[0-9]+\Z", s)
    if digits:
        return s[: digits.start()] + padded(number, len(digits[0]))
    return f"{s}_{padded(number, 4)}"


def with_number(p: str, number: int, fmt: str) -> str:
    if not name(p, fmt):
        raise PathError(f"with_number: '{p}' has an empty name")
    s, end = split_suffix(name(p, fmt))
    new = numbered(s, number) + end
    return f"{parent(p, fmt)}/{new}" if is_uri(p) else _named(p, new, fmt, "with_number")


def _starts(p: str, base: str, fmt: str) -> bool:
    if fmt == "WINDOWS" and not is_uri(p):
        fold = lambda x: x.replace("/", "\\").lower()
        return fold(p).startswith(fold(base))
    return p.startswith(base)


def is_relative_to(p: str, base: str, fmt: str) -> bool:
    """Whether a path is a base or below it, at a component's border."""
    return _starts(p, base, fmt) and (len(p) == len(base) or base[-1:] in ("/", "\\") or p[len(base) : len(base) + 1] in ("/", "\\"))


def relative_to(p: str, base: str, fmt: str) -> str:
    if not is_relative_to(p, base, fmt):
        raise PathError(f"relative_to failed: '{p}' is not relative to '{base}'")
    return p[len(base) :].lstrip("/").lstrip("\\") or "."


# -- mapping rules ----------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Rule:
    """Paths below ``source``, read in its format, move below ``destination``."""

    source_format: str
    source: str
    destination: str

    def apply(self, p: str, fmt: str = "POSIX") -> str | None:
        sep = "\\" if fmt == "WINDOWS" else "/"
        if self.source_format == "URI":
            (a, x), (b, y) = _authority(self.source), _authority(p)
            if a.lower() != b.lower() or not y.startswith(x) or y[len(x) :][:1] not in ("", "/"):
                return None
            rest, closed = y[len(x) :].split("/")[1:], p.endswith("/")
        else:
            windows = self.source_format == "WINDOWS"
            seps = r"[/\\]" if windows else "/"
            rooted = lambda s: s.startswith("/") or (windows and s.startswith("\\"))
            have, want = ([x for x in re.split(seps, s) if x] for s in (p, self.source))
            fold = _ascii_lower if windows else str
            if rooted(self.source) != rooted(p) or [fold(x) for x in have[: len(want)]] != [fold(x) for x in want]:
                return None
            rest, closed = have[len(want) :], bool(re.search(seps + r"\Z", p))
        out = self.destination + "".join(sep + x for x in rest)
        return out + sep if closed and not out.endswith(sep) else out


def _ascii_lower(s: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in s)


def _authority(u: str) -> tuple[str, str]:
    m = re.match(r"(?s)(.*?://[^/]*)(.*)", u)
    return (m[1], m[2]) if m else ("", u)


def longest_first(rules: Iterable[Rule]) -> list[Rule]:
    """By descending length of the source in bytes; equal ones keep their order."""
    return sorted(rules, key=lambda r: -len(r.source.encode()))


def apply_rules(p: str, rules: Iterable[Rule], fmt: str = "POSIX") -> str:
    for r in rules:
        found = r.apply(p, fmt)
        if found is not None:
            return found
    return p


def rules_from_json(rows: Iterable[dict]) -> list[Rule]:
    """Rules of a ``path_mapping_rules`` list, longest first."""
    return longest_first(Rule(r["source_path_format"].upper(), r["source_path"], r["destination_path"]) for r in rows)


def map_paths(df: DataFrame, path: str, rules: Iterable[Rule], into: str = "mapped", fmt: str = "POSIX") -> DataFrame:
    """Add the mapped path: the first rule that fits, in native expressions for POSIX and URI sources."""
    p = F.col(path)
    mapped = p
    for r in reversed(list(rules)):
        mapped = F.coalesce(_rule_column(p, r, fmt), mapped)
    return df.withColumn(into, mapped)


def _rule_column(p: Column, r: Rule, fmt: str) -> Column:
    sep = "\\" if fmt == "WINDOWS" else "/"
    lit, empty = F.lit, F.lit("")
    if r.source_format == "WINDOWS":
        return over(lambda x: r.apply(x, fmt), "string", p)
    if r.source_format == "URI":
        authority, rest_of = _authority(r.source)
        found = F.regexp_extract(p, r"(?s)^(.*?://[^/]*)", 1)
        tail = F.substring(p, F.length(found) + 1, F.length(p))
        fits = (F.lower(found) == authority.lower()) & F.startswith(tail, lit(rest_of))
        rest = F.substring(tail, lit(len(rest_of) + 1), F.length(tail))
        fits = fits & ((rest == "") | F.startswith(rest, lit("/")))
        out = F.concat(lit(r.destination), rest if sep == "/" else F.replace(rest, lit("/"), lit(sep)))
    else:
        want = [x for x in r.source.split("/") if x]
        have = F.filter(F.split(p, "/"), lambda x: x != "")
        head = F.slice(have, 1, len(want)) if want else F.array().cast("array<string>")
        same = F.lit(True) if not want else (F.size(have) >= len(want)) & (head == F.array(*[lit(x) for x in want]))
        fits = same & (F.startswith(p, lit("/")) == r.source.startswith("/"))
        rest = F.when(F.size(have) > len(want), F.slice(have, len(want) + 1, F.greatest(F.size(have), lit(1)))).otherwise(F.array().cast("array<string>"))
        out = F.concat(lit(r.destination), F.array_join(F.transform(rest, lambda x: F.concat(lit(sep), x)), ""))
    closed = F.endswith(p, lit("/")) & ~F.endswith(out, lit(sep))
    return F.when(fits, F.concat(out, F.when(closed, lit(sep)).otherwise(empty)))


# -- rules as a table -------------------------------------------------------------------------------------------------
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _steps(p: Column, kind: str) -> tuple[Column, Column]:
    """(what must be the same besides, the parts of a path that a rule of a format compares); null where the format can't fit."""
    if kind == "URI":
        head = F.regexp_extract(p, r"(?s)^(.*?://[^/]*)", 1)
        return F.when(head != "", F.lower(head)), F.split(F.substring(p, F.length(head) + 1, F.length(p)), "/", -1)
    same = p if kind == "POSIX" else F.translate(p, _CAPITALS + "\\", _SMALL + "/")
    return F.when(F.startswith(same, F.lit("/")), "/").otherwise(""), F.filter(F.split(same, "/", -1), lambda x: x != "")


def _key(p: Column, kind: str, depth: Column) -> Column:
    besides, parts_ = _steps(p, kind)
    return F.concat(F.lit(kind[0]), besides, F.lit("\u0001"), F.array_join(F.slice(parts_, F.lit(1), depth), "\u0001"))


def map_by_rules(df: DataFrame, path: str, rules: DataFrame, into: str = "mapped", fmt: str = "POSIX") -> DataFrame:
    """Add the path that the first fitting rule gives, or the path itself: :func:`map_paths` with the rules in a table of any size.

    ``rules`` has source_format, source, destination and position. Rules go longest source (in bytes) first, then by position, then by
    destination; ones with a null are left out. A path asks for its beginnings, only of as many parts as some rule of the format has, and these meet the
    rules in one join on the whole beginning. A null path stays null; repeated paths are matched once. An existing column named like
    the output is replaced.
    """
    listed = rules.select(F.upper("source_format").alias("kind"), "source", "destination", "position").dropna(subset=["kind", "source", "destination"])
    source = F.col("source")
    per = {k: _steps(source, k) for k in ("POSIX", "WINDOWS", "URI")}
    depth = F.when(F.col("kind") == "URI", F.size(per["URI"][1])).when(F.col("kind") == "WINDOWS", F.size(per["WINDOWS"][1])).otherwise(F.size(per["POSIX"][1]))
    listed = listed.withColumn("depth", depth)
    key = F.when(F.col("kind") == "URI", _key(source, "URI", F.col("depth"))).when(F.col("kind") == "WINDOWS", _key(source, "WINDOWS", F.col("depth"))).when(F.col("kind") == "POSIX", _key(source, "POSIX", F.col("depth")))
    rank = F.struct((-F.octet_length("source")).alias("size"), F.col("position"), F.col("destination"))
    first = listed.withColumn("key", key).where("key is not null").groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "kind", "depth")).alias("rule"))
    # a number for each count of parts that rules of a format have
    depths = listed.agg(*[F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("depth")))).alias(k) for k in per])
    asked = df.select(F.col(path).alias("_p")).where("_p is not null").distinct()

    def beginnings(kind: str) -> Column:
        many = F.size(_steps(F.col("_p"), kind)[1])
        return F.transform(F.filter(F.col(kind), lambda d: d <= many), lambda d: _key(F.col("_p"), kind, d))

    found = asked.select("_p", *[depths.select(k).scalar().alias(k) for k in per]).select("_p", F.explode(F.concat(*map(beginnings, per))).alias("key")).join(first, "key").groupBy("_p").agg(F.min("rule").alias("_rule"))
    p, sep = F.col("_p"), "\\" if fmt == "WINDOWS" else "/"
    kind, want, to = F.col("_rule.kind"), F.col("_rule.depth"), F.col("_rule.rank.destination")
    have = F.when(kind == "URI", per_path(p, "URI")).when(kind == "WINDOWS", per_path(p, "WINDOWS")).otherwise(per_path(p, "POSIX"))
    rest = F.slice(have, want + 1, F.greatest(F.size(have), F.lit(1)))
    out = F.concat(to, F.array_join(F.transform(rest, lambda x: F.concat(F.lit(sep), x)), ""))
    closed = (F.endswith(p, F.lit("/")) | ((kind == "WINDOWS") & F.endswith(p, F.lit("\\")))) & ~F.endswith(out, F.lit(sep))
    mapped = found.select("_p", F.when(closed, F.concat(out, F.lit(sep))).otherwise(out).alias("_mapped"))
    kept = df.drop(into) if into != path else df
    return kept.join(mapped, F.col(path) == F.col("_p"), "left").withColumn(into, F.coalesce("_mapped", F.col(path))).drop("_p", "_mapped", "_rule")


def per_path(p: Column, kind: str) -> Column:
    """The parts of a path as they are written."""
    if kind == "WINDOWS":
        return F.filter(F.split(F.translate(p, "\\", "/"), "/", -1), lambda x: x != "")
    return _steps(p, kind)[1]


# -- over columns -----------------------------------------------------------------------------------------------------
def over(f: Callable, kind: str, *cols: Column) -> Column:
    """An Arrow function that applies f to each row; null in, null out."""

    @F.pandas_udf(kind)
    def run(first: pd.Series, *more: pd.Series) -> pd.Series:
        out = []
        for row in zip(first, *more, strict=True):
            out.append(None if any(x is None or x is pd.NA or (isinstance(x, float) and x != x) for x in row) else f(*row))
        return pd.Series(out, dtype=object) if kind not in ("boolean", "bigint") else pd.Series(out)

    return run(*cols)


def posix_property(prop: str, p: Column) -> Column:
    """name, stem and suffix of POSIX and URI paths in native expressions; paths are taken to be normalised."""
    n = F.regexp_extract(F.regexp_replace(p, r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", ""), r"(?s)([^/]*)\z", 1)
    n = F.when(p.isNull(), F.lit(None).cast("string")).when(p == ".", "").otherwise(n)
    if prop == "name":
        return n
    has = n.rlike(r"(?s)^.+\.[^.]+\z")
    cut = F.regexp_extract(n, r"(?s)^(.+)\.[^.]+\z", 1)
    return F.when(has, cut).otherwise(n) if prop == "stem" else F.when(has, F.substring(n, F.length(cut) + 1, F.length(n))).otherwise(F.when(n.isNotNull(), ""))
