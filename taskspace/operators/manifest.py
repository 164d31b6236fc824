"""The manifest algebra: file trees as two frames, files and dirs, with diff, compose, filter, subtree, partition and join.

Everything that grows with a tree is a frame; a manifest's header is a few values on the driver. Directory relations (below,
ancestor of) are equi-joins on exploded ancestors, never prefix comparisons of all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("size", T.LongType()), T.StructField("mtime", T.LongType()), T.StructField("chunk_hashes", T.ArrayType(T.StringType())), T.StructField("symlink_target", T.StringType()), T.StructField("runnable", T.BooleanType()), T.StructField("deleted", T.BooleanType())])
DIRS = T.StructType([T.StructField("path", T.StringType()), T.StructField("deleted", T.BooleanType())])
#: Hash one chunk a file, and the default chunk of 256 MiB.
WHOLE_FILE = -1
DEFAULT_CHUNK = 256 * 1024 * 1024
#: The longest chain of links that is followed.
MAX_LINKS = 64
POLICIES = ("COLLAPSE_ESCAPING", "COLLAPSE_ALL", "EXCLUDE_ESCAPING", "EXCLUDE_ALL", "PRESERVE", "TRANSITIVE_INCLUDE_TARGETS")


class ManifestError(ValueError):
    """A manifest that isn't valid, or an operation that its arguments don't allow."""


@dataclass(frozen=True)
class Manifest:
    """``style`` is abs or rel, ``kind`` full or diff."""

    files: DataFrame
    dirs: DataFrame
    style: str = "rel"
    kind: str = "full"
    hash_alg: str = "xxh128"
    chunk_size: int = WHOLE_FILE
    parent_hash: str | None = None
    declared_size: int | None = None

    @classmethod
    def of(cls, files: DataFrame, dirs: DataFrame | None = None, **header) -> Manifest:
        """From frames that may lack columns; those are null or false."""
        have = set(files.columns)
        cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) if f.name not in ("runnable", "deleted") else (F.coalesce(F.col(f.name), F.lit(False)) if f.name in have else F.lit(False)).alias(f.name) for f in FILES.fields]
        dirs = dirs if dirs is not None else files.sparkSession.createDataFrame([], DIRS)
        deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in dirs.columns else F.lit(False)
        return cls(files.select(*cols), dirs.select("path", deleted.alias("deleted")), **header)

    @property
    def spark(self):
        return self.files.sparkSession

    def total_size(self) -> int:
        """The declared size where an operation keeps it, else the sum over live files that aren't links."""
        return self.declared_size if self.declared_size is not None else total_size(self.files)

    def with_files(self, files: DataFrame, dirs: DataFrame | None = None, **header) -> Manifest:
        return replace(self, files=files.select(*FILES.names), dirs=(self.dirs if dirs is None else dirs).select(*DIRS.names), declared_size=None, **header)

    def clear_hashes(self) -> Manifest:
        regular = F.col("symlink_target").isNull() & ~F.col("deleted")
        return self.with_files(self.files.withColumn("hash", F.when(~regular, F.col("hash"))).withColumn("chunk_hashes", F.when(~regular, F.col("chunk_hashes"))))


def live() -> Column:
    return ~F.col("deleted") & F.col("symlink_target").isNull()


def total_size(files: DataFrame) -> int:
    return files.agg(F.coalesce(F.sum(F.when(live(), F.col("size"))), F.lit(0))).first()[0]


def hashed(files: DataFrame) -> bool | None:
    """Whether any regular live file has a hash; None without such files."""
    return files.where(live()).agg(F.bool_or(F.col("hash").isNotNull() | F.col("chunk_hashes").isNotNull())).first()[0]


# -- paths ------------------------------------------------------------------------------------------------------------
#: How absolute paths begin: a root, a share, or a drive with its root.
ABSOLUTE = r"^(/|\\\\|[A-Za-z]:[\\/])"


def is_absolute(p: Column) -> Column:
    return p.rlike(ABSOLUTE)


def normalise(p: Column) -> Column:
    """``.`` and empty parts dropped, ``..`` resolved against the part before it; the root has no parent."""
    drive = F.regexp_extract(p, r"^([A-Za-z]:)", 1)
    slashed = F.translate(F.substring(p, F.length(drive) + 1, F.length(p)), "\\", "/")
    rooted = F.startswith(slashed, F.lit("/"))
    parts = F.filter(F.split(slashed, "/"), lambda x: (x != "") & (x != "."))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        up = (x == "..") & last.isNotNull() & (last != "..")
        return F.when(up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when((x == "..") & rooted & (F.size(acc) == 0), acc).otherwise(F.array_append(acc, x))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    out = F.concat(drive, F.when(rooted, "/").otherwise(""), joined)
    return F.when(out == "", ".").otherwise(out)


def normalise_text(p: str) -> str:
    """The same on the driver."""
    m = re.match(r"[A-Za-z]:", p)
    drive, rest = (m[0], p[2:]) if m else ("", p)
    rest = rest.replace("\\", "/")
    rooted, out = rest.startswith("/"), []
    for x in rest.split("/"):
        if x in ("", "."):
            continue
        if x == ".." and out and out[-1] != "..":
            out.pop()
        elif x != ".." or not rooted:
            out.append(x)
    return drive + ("/" if rooted else "") + "/".join(out) or "."


def parent_of(p: Column) -> Column:
    """The directory of a path: ``/`` for its entries, empty for names alone."""
    up = F.regexp_extract(p, r"(?s)^(.*)/[^/]*\z", 1)
    return F.when(~F.contains(p, F.lit("/")), "").when((up == "") & F.startswith(p, F.lit("/")), "/").otherwise(up)


def ancestors(p: Column) -> Column:
    """The proper ancestors of a path, from the top: of ``a/b/c`` those are ``a`` and ``a/b``, of ``/a/b`` also ``/``."""
    parts = F.split(p, "/")
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    named = F.transform(made, lambda x: F.when(x == "", "/").otherwise(x))
    return F.when(F.size(parts) > 1, F.filter(named, lambda x: x != p)).otherwise(F.array().cast("array<string>"))


def below(p: Column, top: str) -> Column:
    """The path relative to a directory, null for others and for the directory itself."""
    if top in ("", "."):
        return F.when(p != ".", p)
    lead = top if top.endswith("/") else top + "/"
    return F.when(F.startswith(p, F.lit(lead)) & (F.length(p) > len(lead)), F.substring(p, F.lit(len(lead) + 1), F.length(p)))


# -- filter -----------------------------------------------------------------------------------------------------------
def filter_manifest(m: Manifest, files: Column | Callable[[DataFrame], Column] | None = None, dirs: Column | None = None) -> Manifest:
    """The entries that predicates keep; the parent's hash stays."""
    keep = files(m.files) if callable(files) and not isinstance(files, Column) else files
    return m.with_files(m.files if keep is None else m.files.where(keep), m.dirs if dirs is None else m.dirs.where(dirs))


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: ``*`` and ``?`` cross slashes, ``[...]`` and ``[!...]`` are classes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = end
        else:
            out += re.sub(r"([\\.+^$|(){}\[\]*?])", r"\\\1", c)
        i += 1
    return rf"(?s)^(?:{out})\z"


def glob_filter(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Any include (or none given) and no exclude."""
    hit = lambda globs: path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))
    out = hit(include) if include else F.lit(True)
    return out & ~hit(exclude) if exclude else out


# -- diff -------------------------------------------------------------------------------------------------------------
def entries_differ(p: str, c: str, ignore_hashes: bool = False, ignore_runnable: bool = False) -> Column:
    """Whether two file structs differ: by link or not, link target, size, mtime, hashes, runnable."""
    x, y = F.col(p), F.col(c)
    apart = lambda n: ~x[n].eqNullSafe(y[n])
    linked = x["symlink_target"].isNotNull()
    regular = apart("size") | apart("mtime")
    if not ignore_hashes:
        regular = regular | apart("hash") | apart("chunk_hashes")
    if not ignore_runnable:
        regular = regular | apart("runnable")
    return F.when(linked != y["symlink_target"].isNotNull(), True).when(y["symlink_target"].isNotNull(), apart("symlink_target")).otherwise(regular)


def deleted_file(path: Column) -> list[Column]:
    return [path.alias("path"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in FILES.fields[1:6]], F.lit(False).alias("runnable"), F.lit(True).alias("deleted")]


def diff(parent: Manifest, current: Manifest, ignore_hashes: bool = False, preserve_runnable: bool = False, parent_hash: str | None = None) -> Manifest:
    """What turns parent into current: new, modified and deleted entries. One full outer join on path for files, one for
    dirs. Hashed and unhashed manifests can't be compared unless hashes are ignored."""
    if not ignore_hashes:
        a, b = hashed(parent.files), hashed(current.files)
        if a is not None and b is not None and a != b:
            raise ManifestError("cannot diff a hashed manifest against an unhashed one when hashes count")
    old = parent.files.select(F.col("path").alias("_p"), F.struct(*FILES.names).alias("old"))
    new = current.files.select(F.col("path").alias("_c"), F.struct(*FILES.names).alias("new"))
    both = old.join(new, F.col("_p") == F.col("_c"), "full_outer")
    gone = F.col("_c").isNull()
    changed = F.when(F.col("_p").isNull(), True).when(gone, True).otherwise(entries_differ("old", "new", ignore_hashes, preserve_runnable))
    cols = []
    for f, dead in zip(FILES.fields, deleted_file(F.col("_p")), strict=True):
        value = F.col("new")[f.name]
        if f.name == "runnable" and preserve_runnable:
            value = F.when(F.col("_p").isNotNull() & F.col("new.symlink_target").isNull(), F.col("old.runnable")).otherwise(value)
        cols.append(F.when(gone, dead).otherwise(value).alias(f.name))
    files = both.where(changed).select(*cols)
    before, after = parent.dirs.select("path").distinct(), current.dirs.select("path").distinct()
    fresh = current.dirs.join(before, "path", "left_anti").select("path", "deleted")
    lost = before.join(after, "path", "left_anti").select("path", F.lit(True).alias("deleted"))
    return Manifest(files, fresh.union(lost), parent.style, "diff", parent.hash_alg, parent.chunk_size, parent_hash)


def ordered_files(files: DataFrame) -> DataFrame:
    """Live before deleted, then by path."""
    return files.orderBy("deleted", "path")


def ordered_dirs(dirs: DataFrame) -> DataFrame:
    """Live ones by path; deleted ones by descending length in bytes, then path, so that children come before parents."""
    return dirs.orderBy("deleted", F.when(F.col("deleted"), -F.octet_length("path")), "path")


# -- compose ----------------------------------------------------------------------------------------------------------
def _cut(df: DataFrame) -> DataFrame:
    """End a lineage that grows with each diff, in the folder that all executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _with_parents(nodes: DataFrame) -> DataFrame:
    """All ancestors of a frame's paths."""
    return nodes.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()


def _check_chunks(first: Manifest, others: Iterable[Manifest]) -> None:
    for m in others:
        if m.chunk_size != first.chunk_size:
            raise ManifestError(f"file_chunk_size_bytes mismatch: {first.chunk_size} and {m.chunk_size}")


def _tops(paths: DataFrame, tops: DataFrame) -> DataFrame:
    """(path, top) for each of a frame's paths and every one of ``tops`` (path) that it is or is below. Paths ask only for ancestors of as many
    parts as some top has, in one join."""
    parts = lambda p: F.size(F.split(p, "/"))
    depths = tops.agg(F.collect_set(parts(F.col("path")))).scalar()
    asked = paths.select("path", depths.alias("_depths")).select("path", F.explode(F.filter(F.concat(ancestors(F.col("path")), F.array("path")), lambda x: F.array_contains("_depths", parts(x)))).alias("top"))
    return asked.join(tops.select(F.col("path").alias("top")), "top", "left_semi")


def compose(base: Manifest, diffs: Sequence[Manifest], checkpoint_every: int = 8) -> Manifest:
    """A full manifest with diffs applied in order.

    The tree is a set of nodes (path, file or null). Of each diff, deleted files take whatever is below them, deleted dirs
    go if nothing is left in them (children before parents), then files replace nodes and dirs are added. Every ancestor
    of a node is a dir, also one that files have left.

    All diffs are one pass: of a path the last entry counts if no deletion at or above it came after, and a dir is there if anything
    was added at or below it since. Whether a deleted dir is empty depends on what came before, so what lies at or below such
    dirs, and only that, goes through the diffs in turn.
    """
    _check_chunks(base, diffs)
    if not diffs:
        diffs = [Manifest.of(base.files.limit(0), kind="diff")]
    none = F.lit(None).cast(FILES).alias("entry")
    added = kills = emptied = None
    join = lambda a, b: b if a is None else a.union(b)
    for i, d in enumerate([base, *diffs]):
        live, dirs = d.files.where(~F.coalesce("deleted", F.lit(False))), d.dirs.where(~F.coalesce("deleted", F.lit(False)))
        added = join(added, live.select("path", F.struct(*FILES.names).alias("entry"), F.lit(2 * i + 1).alias("at")).union(dirs.select("path", none, F.lit(2 * i + 1))))
        if i:
            kills = join(kills, d.files.where("deleted").select("path", F.lit(2 * i).alias("at")))
            emptied = join(emptied, d.dirs.where("deleted").select("path"))
    at_or_above = added.select("entry", "at", F.posexplode(F.concat(F.array("path"), ancestors(F.col("path")))).alias("_k", "path")).select("path", "at", F.when(F.col("_k") == 0, F.col("entry")).alias("entry"))
    own = F.when(F.col("entry").isNotNull(), F.col("at"))
    last = at_or_above.groupBy("path").agg(F.max("at").alias("at"), F.max(own).alias("file_at"), F.max_by("entry", own).alias("entry"))
    kills = kills.groupBy("path").agg(F.max("at").alias("at"))
    killed = _tops(last, kills).join(kills.select(F.col("path").alias("top"), F.col("at").alias("killed")), "top").groupBy("path").agg(F.max("killed").alias("killed"))
    state = last.join(killed, "path", "left").withColumn("killed", F.coalesce("killed", F.lit(0)))
    nodes = state.where("at > killed").select("path", F.when(F.col("file_at") > F.col("killed"), F.col("entry")).alias("entry"))
    emptied = emptied.distinct()
    if not emptied.isEmpty():
        held = lambda df: df.join(_tops(df, emptied).select("path").distinct(), "path", "left_semi")
        nodes = nodes.join(_tops(nodes, emptied).select("path").distinct(), "path", "left_anti").union(_in_turn(base, diffs, held, checkpoint_every))
    out = nodes.where("entry is not null").select("entry.*")
    dirs = nodes.where("entry is null").select("path", F.lit(False).alias("deleted"))
    return Manifest(out.select(*FILES.names), dirs, base.style, "full", base.hash_alg, base.chunk_size)


def _in_turn(base: Manifest, diffs: Sequence[Manifest], held: Callable[[DataFrame], DataFrame], checkpoint_every: int) -> DataFrame:
    """Nodes after one diff after another, of the part of the tree that ``held`` leaves."""
    entry = F.struct(*FILES.names).alias("entry")
    none = F.lit(None).cast(FILES).alias("entry")
    files = base.files.select("path", entry)
    up = held(_with_parents(files.select("path").union(base.dirs.select("path"))))
    nodes = _latest(held(files).union(held(base.dirs.select("path", none))).union(up.select("path", none)).withColumn("rank", F.when(F.col("entry").isNotNull(), 1).otherwise(0)))
    for i, d in enumerate(diffs):
        dead = d.files.where("deleted").select("path").distinct()
        nodes = nodes.join(_tops(nodes, dead).select("path").distinct(), "path", "left_anti")
        nodes = _drop_empty(nodes, d.dirs.where("deleted").select("path").distinct())
        added = d.files.where(~F.col("deleted")).select("path", entry)
        extra = d.dirs.where(~F.col("deleted")).select("path")
        up = held(_with_parents(added.select("path").union(extra)).union(extra).distinct())
        ranked = nodes.withColumn("rank", F.lit(1)).union(held(added).withColumn("rank", F.lit(2))).union(up.select("path", none, F.lit(0).alias("rank")))
        nodes = _latest(ranked)
        if (i + 1) % checkpoint_every == 0 and i + 1 < len(diffs):
            nodes = _cut(nodes)
    return nodes


def _latest(ranked: DataFrame) -> DataFrame:
    """One node a path: the one of highest rank."""
    return ranked.groupBy("path").agg(F.max_by("entry", "rank").alias("entry"))


def _drop_empty(nodes: DataFrame, dirs: DataFrame) -> DataFrame:
    """Nodes without those of ``dirs`` that hold no file and nothing but such dirs: the rest that stays is never below one.

    A dir goes if every node at or below it is itself a dir to be deleted; that is one join and one aggregation, where
    deleting level by level would take one pass a level.
    """
    marked = nodes.join(dirs.withColumn("_gone", F.lit(True)), "path", "left")
    stays = marked.where(F.col("_gone").isNull() | F.col("entry").isNotNull()).select(F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("path")).distinct()
    gone = dirs.join(stays, "path", "left_anti")
    return nodes.join(gone, "path", "left_anti")


def compose_diffs(diffs: Sequence[Manifest]) -> Manifest:
    """Diffs in order as one diff. A path that ends deleted and without children is both a deleted file and a deleted dir; a
    deleted dir with live entries below it is live again."""
    if not diffs:
        raise ManifestError("cannot compose empty list of diffs")
    _check_chunks(diffs[0], diffs[1:])
    # each event of a path with its place: deletions before additions within a diff
    events = None
    for i, d in enumerate(diffs):
        none = F.lit(None).cast(FILES)
        rows = [
            d.files.where("deleted").select("path", none.alias("entry"), F.lit(3 * i).alias("at"), F.lit("delete").alias("what")),
            d.dirs.where("deleted").select("path", none.alias("entry"), F.lit(3 * i).alias("at"), F.lit("delete").alias("what")),
            d.files.where(~F.col("deleted")).select("path", F.struct(*FILES.names).alias("entry"), F.lit(3 * i + 1).alias("at"), F.lit("file").alias("what")),
            d.dirs.where(~F.col("deleted")).select("path", none.alias("entry"), F.lit(3 * i + 2).alias("at"), F.lit("dir").alias("what")),
        ]
        for r in rows:
            events = r if events is None else events.union(r)
    last = events.groupBy("path").agg(
        F.max_by("what", "at").alias("last"),
        F.max(F.when(F.col("what") == "delete", F.col("at"))).alias("deleted_at"),
        F.max(F.when(F.col("what") == "file", F.col("at"))).alias("file_at"),
        F.max_by("entry", F.when(F.col("what") == "file", F.col("at"))).alias("entry"),
    )
    kept = F.col("file_at").isNotNull() & (F.coalesce("deleted_at", F.lit(-1)) < F.col("file_at"))
    own = last.select("path", F.when(kept, F.col("entry")).alias("entry"), (F.col("last") == "delete").alias("deleted"))
    up = own.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().join(own.select("path"), "path", "left_anti")
    nodes = own.union(up.select("path", F.lit(None).cast(FILES).alias("entry"), F.lit(False).alias("deleted")))
    has = lambda rows: rows.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    with_live = has(nodes.where(F.col("entry").isNotNull() & ~F.col("deleted"))).withColumn("_live", F.lit(True))
    with_any = has(nodes).withColumn("_child", F.lit(True))
    state = nodes.join(with_live, "path", "left").join(with_any, "path", "left")
    state = state.withColumn("deleted", F.col("deleted") & F.col("_live").isNull())
    alive = state.where(F.col("entry").isNotNull() & ~F.col("deleted")).select("entry.*")
    dead = state.where(F.col("deleted") & (F.col("entry").isNotNull() | F.col("_child").isNull())).select(*deleted_file(F.col("path")))
    dirs = state.where("entry is null").select("path", "deleted")
    return Manifest(alive.select(*FILES.names).union(dead), dirs, diffs[0].style, "diff", diffs[0].hash_alg, diffs[0].chunk_size, diffs[0].parent_hash)


# -- links ------------------------------------------------------------------------------------------------------------
def resolve_links(files: DataFrame) -> DataFrame:
    """(target, entry): what each link target stands for, over chains of up to MAX_LINKS links; cycles, long chains and targets
    that aren't listed are left out. Chains are followed by doubling, so a chain of n links takes log n joins."""
    hop = files.where("symlink_target is not null").select(F.col("path").alias("link"), F.col("symlink_target").alias("target"), F.lit(1).alias("steps"))
    for _ in range(6):
        nxt = hop.select(F.col("link").alias("_l"), F.col("target").alias("_t"), F.col("steps").alias("_n"))
        hop = hop.join(nxt, F.col("target") == F.col("_l"), "left").select("link", F.coalesce("_t", "target").alias("target"), (F.col("steps") + F.coalesce("_n", F.lit(0))).alias("steps"))
    real = files.where("symlink_target is null").select(F.col("path").alias("_real"), F.struct(*FILES.names).alias("entry"))
    targets = files.where("symlink_target is not null").select(F.col("symlink_target").alias("target")).distinct()
    direct = targets.join(real, F.col("target") == F.col("_real")).select("target", "entry")
    via = targets.join(hop.select(F.col("link").alias("_l"), F.col("target").alias("_t"), "steps"), F.col("target") == F.col("_l")).where(F.col("steps") < MAX_LINKS)
    return direct.union(via.join(real, F.col("_t") == F.col("_real")).select("target", "entry"))


def _dir_targets(links: DataFrame, files: DataFrame) -> DataFrame:
    """(link, target, inside): every listed file below the target of a link."""
    tops = links.select(F.col("path").alias("link"), F.col("symlink_target").alias("target"), "rel")
    inside = files.select(F.explode(ancestors(F.col("path"))).alias("target"), F.struct(*FILES.names).alias("inside"))
    return tops.join(inside, "target")


def _moved(entry: str, path: Column) -> list[Column]:
    return [path.alias("path"), *[F.col(f"{entry}.{n}").alias(n) for n in FILES.names[1:]]]


def subtree(m: Manifest, top: str, policy: str = "COLLAPSE_ESCAPING") -> Manifest:
    """The part below a directory, with paths relative to it.

    Links: COLLAPSE_ALL replaces all by what they point to, EXCLUDE_ALL drops them; the ESCAPING policies keep links to
    inside (made relative) and collapse or drop the others. A link to a directory becomes the files below it. Targets that
    aren't listed, and cycles, are dropped.
    """
    if policy not in POLICIES[:4]:
        raise ManifestError(f"symlink_policy {policy} is not supported for subtree")
    prefix = normalise_text(top)
    if prefix not in (".", ""):
        one = m.files.select("path").union(m.dirs.select("path")).limit(1).collect()
        if one:
            manifest_abs = bool(re.match(r"(/|\\\\|[A-Za-z]:[\\/])", one[0][0]))
            top_abs = bool(re.match(r"(/|\\\\|[A-Za-z]:[\\/])", prefix))
            if manifest_abs != top_abs:
                raise ManifestError(f"subtree path '{prefix}' and the manifest's paths are of different kinds")
    inside = m.files.withColumn("rel", below(F.col("path"), prefix)).where("rel is not null")
    plain = inside.where("symlink_target is null").select(F.col("rel").alias("path"), *FILES.names[1:])
    links, parts = inside.where("symlink_target is not null"), [plain]
    if policy != "EXCLUDE_ALL":
        own = below(F.col("symlink_target"), prefix)
        if policy.endswith("ESCAPING"):
            stay = links.withColumn("_t", own).where("_t is not null")
            parts.append(stay.select(F.col("rel").alias("path"), "hash", "size", "mtime", "chunk_hashes", F.col("_t").alias("symlink_target"), "runnable", "deleted"))
            links = links.where(own.isNull())
        if policy.startswith("COLLAPSE"):
            resolved = resolve_links(m.files)
            spread = _dir_targets(links, m.files)
            rest = F.substring(F.col("inside.path"), F.length("target") + 2, F.length("inside.path"))
            path = F.concat("rel", F.lit("/"), rest)
            if policy == "COLLAPSE_ALL":
                parts.append(spread.where("inside.symlink_target is null").select(*_moved("inside", path)))
                deep = spread.where("inside.symlink_target is not null").withColumn("_path", path)
                parts.append(deep.join(resolved.withColumnRenamed("target", "_rt"), F.col("inside.symlink_target") == F.col("_rt")).select(*_moved("entry", F.col("_path"))))
            else:
                parts.append(spread.select(*_moved("inside", path)))
            single = links.join(spread.select(F.col("link").alias("path")).distinct(), "path", "left_anti")
            parts.append(single.select("rel", "symlink_target").join(resolved, F.col("symlink_target") == F.col("target")).select(*_moved("entry", F.col("rel"))))
    files = parts[0]
    for p in parts[1:]:
        files = files.unionByName(p)
    dirs = m.dirs.select(below(F.col("path"), prefix).alias("path"), "deleted").where("path is not null")
    return m.with_files(files, dirs, style="rel", parent_hash=None)


# -- join, partition --------------------------------------------------------------------------------------------------
def join_prefix(m: Manifest, prefix: str, style: str = "abs") -> Manifest:
    """A relative manifest below a directory; its total size stays as declared, the parent's hash goes."""
    if m.style != "rel":
        raise ManifestError("only a relative manifest can be joined to a prefix")
    lead = normalise_text(prefix)
    at = lambda c: normalise(F.concat(F.lit(lead + "/"), c)) if lead != "." else normalise(c)
    files = m.files.withColumn("path", at(F.col("path"))).withColumn("symlink_target", at(F.col("symlink_target")))
    return replace(m, files=files, dirs=m.dirs.withColumn("path", at(F.col("path"))), style=style, parent_hash=None)


def _component_prefix(parts: Column, low: Column, high: Column) -> Column:
    """The common leading components of the least and the greatest of a set of component arrays, which is that of all."""
    n = F.least(F.size(low), F.size(high))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ~F.try_element_at(low, i).eqNullSafe(F.try_element_at(high, i)))
    keep = F.coalesce(F.try_element_at(same, F.lit(1)) - 1, n)
    joined = F.array_join(F.slice(low, 1, F.greatest(keep, F.lit(0))), "/")
    return F.when((keep == 1) & (F.element_at(low, 1) == ""), "/").otherwise(joined)


def longest_common_prefix(dirs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``root``, the longest common directory of a frame's paths, for each group: two aggregates and no collection."""
    parts = F.split(F.col("path"), "/")
    found = dirs.groupBy(*by).agg(F.min(parts).alias("_lo"), F.max(parts).alias("_hi"), F.count("*").alias("_n"))
    only = F.array_join("_lo", "/")
    return found.select(*by, F.when(F.col("_lo") == F.col("_hi"), only).otherwise(_component_prefix(parts, F.col("_lo"), F.col("_hi"))).alias("root"))


def common_root(m: Manifest) -> str | None:
    """The deepest directory that holds everything: files count with their parent, dirs without entries with themselves.
    ``.`` where relative paths share none, and a drive's root with its slash."""
    parent = F.coalesce(parent_of(F.col("path")), F.lit(""))
    tops = m.files.where(~F.col("deleted")).select(parent.alias("path")).union(m.dirs.where(~F.col("deleted")).select("path"))
    row = longest_common_prefix(tops).first()
    if row is None or row["root"] is None:
        return None
    return row["root"] + "/" if re.fullmatch("[A-Za-z]:", row["root"]) else row["root"] or "."


def group_into_roots(paths: DataFrame) -> DataFrame:
    """``root``: one for all paths if they share a directory, else one for each first component."""
    first = F.regexp_extract("path", r"(?s)^(/?[^/]*)", 1)
    whole = longest_common_prefix(paths)
    groups = longest_common_prefix(paths.withColumn("_first", first), ["_first"]).select("root").distinct()
    shared = whole.where((F.col("root") != "") & (F.col("root") != "/"))
    return shared if not shared.isEmpty() else groups


def assign_roots(files: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Add ``root``: the one of a few roots that a path is at or below, by an equi-join with exploded ancestors."""
    check_roots(roots)
    spark = files.sparkSession
    keyed = files.withColumn("_top", F.explode(F.concat(ancestors(F.col("path")), F.array(F.col("path"), F.lit(".")))))
    named = spark.createDataFrame([(r,) for r in roots], "root string")
    return keyed.join(named, F.col("_top") == F.col("root")).drop("_top")


def check_roots(roots: Sequence[str]) -> None:
    """Roots must not lie in each other."""
    known = set(roots)
    for r in roots:
        parts = r.split("/")
        for i in range(1, len(parts)):
            if "/".join(parts[:i]) in known:
                raise ManifestError(f"root '{r}' is a subpath of root '{'/'.join(parts[:i])}'")


def partition(m: Manifest, roots: Sequence[str] = (), referenced: Sequence[str] = (), policy: str = "COLLAPSE_ESCAPING") -> list[tuple[str, Manifest]]:
    """A manifest for each root: the given ones in order, then automatic ones for what they leave, sorted. Roots and referenced
    paths must be absolute or relative as the manifest's paths are; an empty manifest takes either."""
    if policy not in POLICIES[:4]:
        raise ManifestError(f"symlink_policy {policy} is not supported for partition")
    named = [*roots, *referenced]
    style = m.files.select("path").union(m.dirs.select("path")).select(is_absolute(F.col("path"))).first() if named else None
    for p in named if style else ():
        if bool(re.match(ABSOLUTE, p)) != style[0]:
            raise ManifestError(f"'{p}' is {'relative' if style[0] else 'absolute'}, but the manifest's paths aren't")
    given = [normalise_text(r) for r in roots]
    check_roots(given)
    tops = m.files.select(parent_of(F.col("path")).alias("path")).union(m.dirs.select("path")).distinct()
    if referenced:
        tops = tops.union(m.spark.createDataFrame([(normalise_text(p),) for p in referenced], "path string"))
    tops = tops.withColumn("path", F.when(F.col("path") == "", ".").otherwise(F.col("path")))
    if given:
        held = assign_roots(tops, given).select("path").distinct()
        rest = tops.join(held, "path", "left_anti")
        found = [] if rest.isEmpty() else [r[0] for r in group_into_roots(rest).collect()]
    else:
        row = longest_common_prefix(tops).first()
        found = [] if row is None or row["root"] is None else [row["root"] or "."]
    every = given + [r for r in sorted(found) if r not in given]
    return [(r, subtree(m, r, policy)) for r in every]


# -- validation -------------------------------------------------------------------------------------------------------
def violations(m: Manifest) -> DataFrame:
    """(path, problem) of entries that a manifest can't hold; empty for a valid one."""
    c = F.col
    n = F.size("chunk_hashes")
    regular = live()
    problem = lambda bad, text: F.when(bad, F.lit(text))
    want_abs = m.style == "abs"
    checks = [
        problem(c("path").isNull() | (c("path") == ""), "empty path"),
        problem(is_absolute(c("path")) != want_abs, "path style does not match the manifest"),
        problem(c("deleted") & F.lit(m.kind == "full"), "deleted entry in a full manifest"),
        problem(c("deleted") & (c("hash").isNotNull() | c("size").isNotNull() | c("mtime").isNotNull() | c("chunk_hashes").isNotNull() | c("symlink_target").isNotNull() | c("runnable")), "deleted entry with other fields"),
        problem(c("hash").isNotNull() & c("chunk_hashes").isNotNull(), "both hash and chunkhashes"),
        problem(c("symlink_target").isNotNull() & (c("hash").isNotNull() | c("chunk_hashes").isNotNull() | c("runnable")), "symlink with file fields"),
        problem(regular & (c("size").isNull() | (c("size") < 0)), "file without size"),
        problem(regular & (c("mtime").isNull() | (c("mtime") < 0)), "file without mtime"),
        problem(regular & c("chunk_hashes").isNotNull() & F.lit(m.chunk_size <= 0), "chunkhashes without chunks"),
        problem(regular & c("chunk_hashes").isNotNull() & (n != F.ceil(c("size") / F.lit(max(m.chunk_size, 1)))), "wrong number of chunkhashes"),
        problem(regular & c("hash").isNotNull() & (c("size") > m.chunk_size) & F.lit(m.chunk_size > 0), "hash of a file that needs chunkhashes"),
    ]
    rows = m.files.select("path", F.explode(F.array_compact(F.array(*checks))).alias("problem"))
    names = m.files.select("path").union(m.dirs.select("path"))
    twice = names.groupBy("path").count().where("count > 1").select("path", F.lit("duplicate path").alias("problem"))
    return rows.union(twice)


def validate(m: Manifest) -> Manifest:
    bad = violations(m).orderBy("path", "problem").limit(1).collect()
    if bad:
        raise ManifestError(f"{bad[0]['path']}: {bad[0]['problem']}")
    return m


def latest_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row for each key, the one of highest order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
