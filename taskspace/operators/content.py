"""Content of file trees: scans, hashes, caches and transfer plans.

Each step is a relation: what to hash is a left join with the hash cache, what to upload the distinct hashes without those
that the store has, what to download a full join of wanted and present paths. Only reading, hashing and writing bytes run
Python, in the tasks, against folders that all executors see.
"""

from __future__ import annotations

import os
import re
import stat
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Tables
from ..sources.object_store import file_system, make_store, write_objects
from .manifest import FILES, WHOLE_FILE, Manifest, ManifestError, _cut, below, hashed, latest_wins, live, normalise, normalise_text

#: Fixed value: days after which a note that an object exists is looked at again.
CHECK_DAYS = 30
CACHE_KEYS = ["path", "alg", "range_start", "range_end"]


# -- hashing ----------------------------------------------------------------------------------------------------------
def hash_bytes(content: Column) -> Column:
    """xxh3-128 as 32 lower-case hex digits."""

    @F.pandas_udf("string")
    def run(parts: pd.Series) -> pd.Series:
        import xxhash

        return pd.Series([None if p is None else xxhash.xxh3_128_hexdigest(p) for p in parts])

    return run(content)


def hash_text(text: Column) -> Column:
    return hash_bytes(F.encode(text, "UTF-8"))


def chunk_rows(files: DataFrame, chunk_size: int) -> DataFrame:
    """One row a chunk of a live file: ``range_start`` and ``range_end`` (-1: to the end). Empty files have one chunk."""
    if chunk_size == WHOLE_FILE:
        return files.where(live()).select("*", F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("range_start"), F.lit(-1).cast("long").alias("range_end"))
    n = F.greatest(F.ceil(F.col("size") / F.lit(chunk_size)).cast("int"), F.lit(1))
    rows = files.where(live()).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    start = F.col("chunk").cast("long") * chunk_size
    one = F.col("size") <= chunk_size
    return rows.withColumn("range_start", start).withColumn("range_end", F.when(one, F.lit(-1).cast("long")).otherwise(F.least(start + chunk_size, F.col("size"))))


def read_and_hash(chunks: DataFrame) -> DataFrame:
    """Add ``digest`` of each chunk's bytes, read from shared storage in the tasks, a megabyte at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            out = []
            for path, a, z in zip(batch["path"], batch["range_start"], batch["range_end"], strict=True):
                h, left = xxhash.xxh3_128(), (z - a if z >= 0 else None)
                with open(path, "rb") as f:
                    f.seek(a)
                    while left is None or left > 0:
                        block = f.read(1 << 20 if left is None else min(1 << 20, left))
                        if not block:
                            break
                        h.update(block)
                        left = None if left is None else left - len(block)
                out.append(h.hexdigest())
            yield batch.assign(digest=out)

    schema = chunks.select("path", "chunk", "range_start", "range_end").schema.simpleString()[7:-1]
    return chunks.select("path", "chunk", "range_start", "range_end").mapInPandas(run, schema + ",digest:string")


def fresh(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks with ``cached``: the cache's hash where it was taken at the file's very mtime, else null."""
    known = cache.select("path", "alg", "range_start", "range_end", F.col("hash").alias("_hash"), F.col("mtime").alias("_mtime"))
    joined = chunks.join(known, CACHE_KEYS, "left")
    return joined.withColumn("cached", F.when(F.col("_mtime") == F.col("mtime"), F.col("_hash"))).drop("_hash", "_mtime")


def hash_manifest(m: Manifest, cache: DataFrame | None = None, chunk_size: int | None = None) -> tuple[Manifest, DataFrame, DataFrame]:
    """(hashed manifest, new cache rows, statistics) of an unhashed absolute manifest. A file is read only if some chunk of it
    isn't fresh in the cache. Files of one chunk get a hash, others the list of their chunks'."""
    if hashed(m.files):
        raise ManifestError("the manifest has hashes already")
    size = m.chunk_size if chunk_size is None else chunk_size
    chunks = chunk_rows(m.files.select("path", "size", "mtime", "symlink_target", "deleted"), size).withColumn("alg", F.lit(m.hash_alg))
    empty = m.spark.createDataFrame([], "path string, alg string, range_start long, range_end long, hash string, mtime long")
    looked = fresh(chunks, cache if cache is not None else empty)
    whole = looked.groupBy("path").agg(F.bool_and(F.col("cached").isNotNull()).alias("skip"))
    read = read_and_hash(looked.join(whole.where(~F.col("skip")), "path", "left_semi"))
    done = looked.join(read.select("path", "chunk", "digest"), ["path", "chunk"], "left").withColumn("hash", F.coalesce("digest", "cached"))
    per = done.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("chunk", "hash"))).alias("_c"), F.bool_and(F.col("digest").isNull()).alias("_skipped"))
    hashes = F.transform("_c", lambda c: c["hash"])
    single = F.size("_c") == 1
    named = per.select("path", F.when(single, F.element_at(hashes, 1)).alias("_h"), F.when(~single, hashes).alias("_hs"))
    files = m.files.drop("hash", "chunk_hashes").join(named, "path", "left").withColumnRenamed("_h", "hash").withColumnRenamed("_hs", "chunk_hashes")
    rows = done.where("digest is not null").select("path", "alg", "range_start", "range_end", "hash", "mtime")
    stats = statistics(per.join(m.files.select("path", "size"), "path"), "_skipped")
    return m.with_files(files, chunk_size=size), rows, stats


def statistics(work: DataFrame, skipped: str) -> DataFrame:
    """One row: files and bytes in all, done and skipped, and progress in percent."""
    s = F.col(skipped)
    sums = work.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.count_if(s).alias("skipped_files"), F.coalesce(F.sum(F.when(s, F.col("size"))), F.lit(0)).alias("skipped_bytes"))
    out = sums.withColumn("processed_files", F.col("total_files") - F.col("skipped_files")).withColumn("processed_bytes", F.col("total_bytes") - F.col("skipped_bytes"))
    return out.withColumn("progress", F.when(F.col("total_bytes") == 0, 100.0).otherwise(100.0 * (F.col("processed_bytes") + F.col("skipped_bytes")) / F.col("total_bytes")))


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str] = CACHE_KEYS) -> DataFrame:
    """A table with rows put in, replacing those of the same keys."""
    both = table.withColumn("_at", F.lit(0)).unionByName(rows.withColumn("_at", F.lit(1)))
    return latest_wins(both, keys, "_at").drop("_at")


def recently_seen(keys: DataFrame, notes: DataFrame, now: Column | None = None) -> DataFrame:
    """Keys with ``last_seen`` where a note of it is younger than CHECK_DAYS, else null."""
    at = now if now is not None else F.current_timestamp()
    young = notes.where(F.col("last_seen") > at - F.expr(f"interval {CHECK_DAYS} days"))
    return keys.join(young, "key", "left")


# -- transfer plans ---------------------------------------------------------------------------------------------------
def objects(*manifests: Manifest) -> DataFrame:
    """(hash, alg, size): the distinct content of manifests, by whole hashes and chunk hashes; the largest size seen."""
    out = None
    for m in manifests:
        part = m.files.where(live())
        whole = part.where("hash is not null").select("hash", F.lit(m.hash_alg).alias("alg"), "size")
        chunks = part.where("chunk_hashes is not null").select(F.posexplode("chunk_hashes").alias("i", "hash"), "size").select("hash", F.lit(m.hash_alg).alias("alg"), F.least(F.lit(max(m.chunk_size, 1)).cast("long"), F.col("size") - F.col("i") * F.lit(max(m.chunk_size, 1)).cast("long")).alias("size"))
        for p in (whole, chunks):
            out = p if out is None else out.union(p)
    return out.groupBy("hash", "alg").agg(F.max("size").alias("size"))


def missing(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Wanted objects that a store lacks."""
    return wanted.join(present.select("hash", "alg"), ["hash", "alg"], "left_anti")


def existing(wanted: DataFrame, present: DataFrame) -> DataFrame:
    return wanted.join(present.select("hash", "alg"), ["hash", "alg"], "left_semi")


def sync_plan(manifests: Sequence[Manifest], source: DataFrame, target: DataFrame) -> DataFrame:
    """(hash, alg, size, action): copy, skip (the target has it) or absent (the source lacks it)."""
    wanted = objects(*manifests)
    flag = lambda t, n: t.select("hash", "alg").distinct().withColumn(n, F.lit(True))
    joined = wanted.join(flag(source, "_s"), ["hash", "alg"], "left").join(flag(target, "_t"), ["hash", "alg"], "left")
    return joined.withColumn("action", F.when(F.col("_t"), "skip").when(F.col("_s"), "copy").otherwise("absent")).drop("_s", "_t")


def sync_objects(plan: DataFrame, source: str, target: str) -> int:
    """Carry out the copies of a plan between two store folders; how many there were. A copy is renamed into place, so a task
    that runs again does no harm."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        (read, here), (write, there) = file_system(source), file_system(target)
        for batch in batches:
            for h, a in zip(batch["hash"], batch["alg"], strict=True):
                part = f"{there}/.{h}.{a}.{uuid.uuid4().hex}"
                with read.open_input_stream(f"{here}/{h}.{a}") as f, write.open_output_stream(part) as to:
                    while block := f.read(1 << 20):
                        to.write(block)
                write.move(part, f"{there}/{h}.{a}")
                n += 1
        yield pd.DataFrame({"n": [n]})

    make_store(target)
    todo = plan.where("action = 'copy'").select("hash", "alg")
    return todo.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def object_key(hash_: Column, alg: Column) -> Column:
    return F.concat(hash_, F.lit("."), alg)


def list_store(spark: SparkSession, folder: str) -> DataFrame:
    """(hash, alg, size, path) of the objects in a store, a folder on any file system that Spark reads."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("size"))
    name = F.substring_index("path", "/", -1)
    return files.select(F.substring_index(name, ".", 1).alias("hash"), F.substring_index(name, ".", -1).alias("alg"), "size", "path")


def read_objects(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The content of wanted objects."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.substring_index("path", "/", -1)
    content = files.select(F.substring_index(name, ".", 1).alias("hash"), F.substring_index(name, ".", -1).alias("alg"), "content")
    return wanted.join(content, ["hash", "alg"])


def hash_upload(m: Manifest, folder: str, cache: DataFrame | None = None) -> tuple[Manifest, DataFrame]:
    """Hash a manifest and put what the store lacks into it; (hashed manifest, statistics). Each content goes once."""
    full, _, _ = hash_manifest(m, cache)
    make_store(folder)
    lacking = missing(objects(full), list_store(m.spark, folder))
    per = full.files.where(live()).select("path", "size", F.coalesce(F.col("chunk_hashes"), F.array("hash")).alias("hs"))
    pieces = per.select("path", "size", F.posexplode("hs").alias("i", "hash")).withColumn("alg", F.lit(m.hash_alg))
    todo = pieces.join(lacking.select("hash", "alg"), ["hash", "alg"], "left_semi").groupBy("hash", "alg").agg(F.min(F.struct("path", "i")).alias("at"))
    chunk = full.chunk_size

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for h, a, path, i in batch.itertuples(index=False):
                with open(path, "rb") as f:
                    if chunk > 0:
                        f.seek(i * chunk)
                    yield pd.DataFrame({"hash": [h], "alg": [a], "content": [f.read(chunk if chunk > 0 else -1)]})

    sent = todo.select("hash", "alg", "at.path", "at.i").mapInPandas(load, "hash string, alg string, content binary")
    count = write_objects(sent, folder)
    stats = full.files.where(live()).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).withColumn("uploaded_objects", F.lit(count))
    return full, stats


def download_plan(m: Manifest, present: DataFrame, conflict: str = "OVERWRITE", links: str = "PRESERVE", beside: DataFrame | None = None) -> DataFrame:
    """(path, action, new_path) for each entry: write, skip, copy (to a free name), link, delete or mkdir.

    ``present`` is (path, size, mtime) of what is there. SKIP leaves existing paths, OVERWRITE replaces those that differ,
    CREATE_COPY writes beside them, under the first number that neither ``present``, the manifest nor ``beside`` (path), other
    names in the target folders, has.
    """
    if conflict not in ("SKIP", "OVERWRITE", "CREATE_COPY"):
        raise ManifestError(f"unknown conflict policy {conflict}")
    there = present.select(F.col("path").alias("_p"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    joined = m.files.join(there, F.col("path") == F.col("_p"), "left")
    same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime"))
    exists = F.col("_p").isNotNull()
    action = F.when(F.col("deleted"), F.when(exists, "delete").otherwise("skip")).when(F.col("symlink_target").isNotNull(), F.lit("link" if links == "PRESERVE" else "skip")).when(~exists, "write").when(same, "skip")
    action = action.otherwise({"SKIP": "skip", "OVERWRITE": "write", "CREATE_COPY": "copy"}[conflict])
    files = joined.select("path", action.alias("action"))
    taken = present.select("path").union(m.files.where(live()).select("path")).union(m.dirs.where(~F.col("deleted")).select("path"))
    numbers = _copy_numbers(taken if beside is None else taken.union(beside.select("path")))
    copies = files.where("action = 'copy'").select("path")
    counted = copies.join(numbers, "path").withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy("n")))
    used = counted.where("n = _r").groupBy("path").agg(F.max("n").alias("n"))
    free = copies.join(used, "path", "left").select("path", copy_name(F.col("path"), F.coalesce("n", F.lit(0)) + 1).alias("new_path"))
    dirs = m.dirs.select("path", F.when(F.col("deleted"), "delete").otherwise("mkdir").alias("action"))
    return files.join(free, "path", "left").unionByName(dirs.withColumn("new_path", F.lit(None).cast("string")))


def _copy_numbers(taken: DataFrame) -> DataFrame:
    """(path, n), each once, for the taken paths that are copy n of a path."""
    found = []
    for suffix in (r"(\.[^./]+)", "()"):
        pattern = r"(?s)^((?:.*/)?[^/]+) \((\d+)\)" + suffix + r"\z"
        parts = [F.regexp_extract("_q", pattern, i) for i in (1, 2, 3)]
        named = taken.select(F.col("path").alias("_q")).where(F.col("_q").rlike(pattern))
        found.append(named.select("_q", F.concat(parts[0], parts[2]).alias("path"), parts[1].try_cast("long").alias("n")))
    return found[0].union(found[1]).where((F.col("n") > 0) & (copy_name(F.col("path"), F.col("n")) == F.col("_q"))).select("path", "n").distinct()


def copy_name(path: Column, n: Column) -> Column:
    """``name (1).ext``, ``name (2).ext`` and so on."""
    folder = F.regexp_extract(path, r"(?s)^(.*/)?", 0)
    name = F.substring(path, F.length(folder) + 1, F.length(path))
    has = name.rlike(r"(?s)^.+\.[^.]+\z")
    stem = F.when(has, F.regexp_extract(name, r"(?s)^(.+)\.[^.]+\z", 1)).otherwise(name)
    return F.concat(folder, stem, F.lit(" ("), n.cast("string"), F.lit(")"), F.substring(name, F.length(stem) + 1, F.length(name)))


def link_levels(links: DataFrame) -> DataFrame:
    """(path, target, level) for links (path, target): links of level 0 point to something else than a listed link, others are one above the link
    they point to. Null is the level of links that never leave such links: those in cycles, and those that lead there.

    Chains are followed by doubling, so a chain of n links takes log n joins, and no link comes to the driver. A path has one target.
    """
    n, reach = links.count(), 1
    tables, kept = Tables(links.sparkSession), Tables(links.sparkSession)
    try:
        hop = tables.keep(links.select("path", "target", F.col("target").alias("_at"), F.lit(1).alias("_far")))
        while True:
            on = hop.select(F.col("path").alias("_at"), F.col("_at").alias("_next"), F.col("_far").alias("_more"))
            moved = hop.join(on, "_at", "left").select("path", "target", F.coalesce("_next", "_at").alias("_at"), (F.col("_far") + F.coalesce("_more", F.lit(0))).alias("_far"), F.col("_next").isNotNull().alias("_on"))
            hop = tables.keep(moved)
            if reach > n or hop.where("_on").isEmpty():
                return kept.keep(hop.select("path", "target", F.when(~F.col("_on"), F.col("_far") - 1).alias("level")))
            hop = hop.drop("_on")
            reach *= 2
    finally:
        tables.close()


def make_links(links: DataFrame) -> int:
    """Make links (path, target) on shared storage, in tasks: level by level, so that a link comes after the one it points to, and cycles
    last. What is at a path is replaced. The number of links."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, target in zip(batch["path"], batch["target"], strict=True):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                try:
                    os.symlink(target, path)
                except FileExistsError:
                    os.unlink(path)
                    os.symlink(target, path)
            yield pd.DataFrame({"n": [len(batch)]})

    if links.isEmpty():
        return 0
    ordered = link_levels(links)
    made = 0
    for level in [*range((ordered.agg(F.max("level")).first()[0] or 0) + 1), None]:
        now = ordered.where(F.col("level").eqNullSafe(F.lit(level)))
        made += now.select("path", "target").mapInPandas(make, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return made


def download(m: Manifest, folder: str, conflict: str = "OVERWRITE") -> DataFrame:
    """Carry a plan out for an absolute manifest on shared storage: (action, count). Contents come from a store folder."""
    paths = m.files.select("path").union(m.dirs.select("path"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p in batch["path"]:
                if os.path.lexists(p) and not (os.path.isdir(p) and not os.path.islink(p)):
                    s = os.lstat(p)
                    rows.append((p, s.st_size, s.st_mtime_ns // 1000))
            yield pd.DataFrame(rows, columns=["path", "size", "mtime"])

    present = paths.mapInPandas(look, "path string, size long, mtime long")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d in batch["folder"]:
                if os.path.isdir(d):
                    yield pd.DataFrame({"path": pd.Series([os.path.join(d, name) for name in os.listdir(d)], dtype=object)})

    folders = m.files.select(F.regexp_extract("path", r"(?s)^(.*/)?", 0).alias("folder")).distinct()
    beside = folders.mapInPandas(listed, "path string") if conflict == "CREATE_COPY" else None
    plan = download_plan(m, present, conflict, beside=beside)
    todo = plan.where("action in ('write', 'copy', 'delete', 'mkdir')").join(m.files.select("path", "hash", "chunk_hashes", "mtime", "runnable"), "path", "left")
    alg = m.hash_alg

    def act(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: dict[str, int] = {}
        system, store = file_system(folder)
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.action == "copy" and not isinstance(r.new_path, str):
                    raise ManifestError(f"no free name for a copy of {r.path}")
                to = r.new_path or r.path
                if r.action == "mkdir":
                    os.makedirs(to, exist_ok=True)
                elif r.action == "delete":
                    if os.path.isdir(to) and not os.path.islink(to):
                        with_entries = os.listdir(to)
                        if not with_entries:
                            os.rmdir(to)
                    elif os.path.lexists(to):
                        os.unlink(to)
                else:
                    os.makedirs(os.path.dirname(to), exist_ok=True)
                    part = f"{to}.{os.getpid()}.part"
                    with open(part, "wb") as f:
                        for h in r.chunk_hashes if r.chunk_hashes is not None else [r.hash]:
                            with system.open_input_stream(f"{store}/{h}.{alg}") as source:
                                while block := source.read(1 << 20):
                                    f.write(block)
                    os.replace(part, to)
                    if r.runnable:
                        os.chmod(to, os.stat(to).st_mode | stat.S_IXUSR)
                    os.utime(to, ns=(int(r.mtime) * 1000,) * 2)
                done[r.action] = done.get(r.action, 0) + 1
        yield pd.DataFrame({"action": pd.Series(list(done), dtype=object), "n": pd.Series(list(done.values()), dtype="int64")})

    counts = todo.select("path", "new_path", "action", "hash", "chunk_hashes", "mtime", "runnable").mapInPandas(act, "action string, n long").groupBy("action").agg(F.sum("n").alias("n")).collect()
    links = make_links(m.files.where("symlink_target is not null and not deleted").select("path", F.col("symlink_target").alias("target")))
    return m.spark.createDataFrame([(r["action"], r["n"]) for r in counts] + [("link", links)], "action string, n long")


# -- collection -------------------------------------------------------------------------------------------------------
def collect(spark: SparkSession, dirs: Iterable[str] = (), files: Iterable[str] = (), policy: str = "COLLAPSE_ESCAPING", optional_files: Iterable[str] = ()) -> Manifest:
    """An absolute manifest of directories and files on shared storage: one level of directories a pass, listed in the tasks.
    Links aren't followed while listing; the policy then decides about them."""
    rows = None
    level = spark.createDataFrame([(normalise_text(d),) for d in dirs], "path string").distinct()
    seen_dirs = level

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d in batch["path"]:
                with os.scandir(d) as it:
                    for e in it:
                        s = e.stat(follow_symlinks=False)
                        link = os.readlink(e.path) if e.is_symlink() else None
                        out.append((e.path, e.is_dir(follow_symlinks=False), s.st_size, s.st_mtime_ns // 1000, link, bool(s.st_mode & ANY_EXEC)))
            yield pd.DataFrame(out, columns=["path", "dir", "size", "mtime", "link", "exec"])

    kind = "path string, dir boolean, size long, mtime long, link string, exec boolean"
    while not level.isEmpty():
        found = _cut(level.mapInPandas(scan, kind))
        rows = found if rows is None else rows.union(found)
        level = found.where("dir").select("path")
        seen_dirs = seen_dirs.union(level)
    extra = []
    for required, names in ((True, files), (False, optional_files)):
        for f in names:
            p = normalise_text(f)
            if not os.path.lexists(p):
                if required:
                    raise ManifestError(f"file not found: {p}")
                continue
            s = os.lstat(p)
            extra.append((p, False, s.st_size, s.st_mtime_ns // 1000, os.readlink(p) if os.path.islink(p) else None, bool(s.st_mode & ANY_EXEC)))
    more = spark.createDataFrame(extra, kind)
    rows = more if rows is None else rows.union(more)
    flat = _cut(rows.where("not dir").dropDuplicates(["path"]))
    held = seen_dirs.distinct()
    links, plain = flat.where("link is not null").withColumn("link", _absolute("path", "link")), flat.where("link is null")
    if policy.endswith("ESCAPING"):
        inside = links.join(plain.unionByName(links).select(F.col("path").alias("link")), "link", "left_semi").select(*flat.columns)
        for top in dirs:
            under = below(F.col("link"), normalise_text(top)).isNotNull() | (F.col("link") == normalise_text(top))
            inside = inside.unionByName(links.where(under))
        stay = inside.dropDuplicates(["path"])
    else:
        stay = links if policy in ("PRESERVE", "TRANSITIVE_INCLUDE_TARGETS") else links.limit(0)
    entries = plain.unionByName(stay)
    if policy.startswith("COLLAPSE"):
        found, more_dirs = _collapsed(links.join(stay, "path", "left_anti").select("path"))
        entries, held = entries.unionByName(found.select(*flat.columns)), held.union(more_dirs).distinct()
    elif policy == "TRANSITIVE_INCLUDE_TARGETS":
        entries = entries.unionByName(_targets(links, flat.select("path").union(held), scan, kind))
    linked = F.col("link").isNotNull()
    entries = entries.dropDuplicates(["path"]).select("path", F.when(~linked, F.col("size")).alias("size"), F.when(~linked, F.col("mtime")).alias("mtime"), F.col("link").alias("symlink_target"), (~linked & F.col("exec")).alias("runnable"))
    return Manifest.of(entries, held, style="abs", kind="full")


#: Any of the three execute bits makes a file runnable.
ANY_EXEC = stat.S_IXUSR | stat.S_IXGRP | stat.S_IXOTH


def _absolute(path: str, link: str) -> Column:
    """Where a link points to, one hop, as a normal absolute path."""
    parent = F.regexp_extract(path, r"(?s)^(.*)/[^/]*\z", 1)
    return F.when(F.startswith(F.col(link), F.lit("/")), normalise(F.col(link))).otherwise(normalise(F.concat(parent, F.lit("/"), F.col(link))))


def _collapsed(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, directories) that stand in place of links: the file that a link leads to, or all below the directory.

    One level of directories a pass, listed in the tasks. Links met below stay links, to the same place of the copy, if they lead
    into the directory of the outermost link; others are replaced in turn. Broken links are dropped, and so is a link that
    was followed on the way to itself.
    """
    names = ["kind", "path", "dir", "size", "mtime", "link", "exec", "real", "root", "top", "chain"]
    schema = "kind string, path string, dir boolean, size long, mtime long, link string, exec boolean, real string, root string, top string, chain array<string>"

    def plain(kind, path, s, link=None):
        return (kind, path, kind == "dir", s and s.st_size, s and s.st_mtime_ns // 1000, link, bool(s and s.st_mode & ANY_EXEC), None, None, None, None)

    def open_(path, real, root, top, chain):
        return ("open", path, True, None, None, None, False, real, root, top, chain)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p in batch["path"]:
                if os.path.isfile(p):
                    out.append(plain("file", p, os.stat(p)))
                elif os.path.isdir(p):
                    real = os.path.realpath(p)
                    out.append(open_(p, real, real, p, [p]))
            yield pd.DataFrame(out, columns=names)

    def inner(r, e):
        at = f"{r.path}/{e.name}"
        if e.is_symlink():
            leads = os.path.realpath(e.path)
            if leads == r.root or leads.startswith(f"{r.root}/"):
                if os.path.lexists(leads):
                    yield plain("link", at, None, r.top + leads[len(r.root) :])
            elif os.path.isdir(leads):
                if e.path not in r.chain:
                    yield open_(at, leads, r.root, r.top, [*r.chain, e.path])
            elif os.path.isfile(leads):
                yield plain("file", at, os.stat(leads))
        elif e.is_dir(follow_symlinks=False):
            yield plain("dir", at, None)
            yield open_(at, e.path, r.root, r.top, list(r.chain))
        elif e.is_file(follow_symlinks=False):
            yield plain("file", at, e.stat())

    def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                with os.scandir(r.real) as it:
                    for e in it:
                        out += inner(r, e)
            yield pd.DataFrame(out, columns=names)

    found = _cut(links.mapInPandas(first, schema))
    every = found
    while not found.where("kind = 'open'").isEmpty():
        found = _cut(found.where("kind = 'open'").mapInPandas(level, schema))
        every = every.unionByName(found)
    return every.where("kind in ('file', 'link')"), every.where("kind = 'dir'").select("path")


def _targets(links: DataFrame, known: DataFrame, scan, kind: str) -> DataFrame:
    """Entries that links lead to, directories with all below them, and on through the links among those; a level a pass."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p in batch["path"]:
                if os.path.lexists(p):
                    s = os.lstat(p)
                    out.append((p, stat.S_ISDIR(s.st_mode), s.st_size, s.st_mtime_ns // 1000, os.readlink(p) if stat.S_ISLNK(s.st_mode) else None, bool(s.st_mode & ANY_EXEC)))
            yield pd.DataFrame(out, columns=["path", "dir", "size", "mtime", "link", "exec"])

    asked = _cut(links.select(F.col("link").alias("path")).distinct().join(known, "path", "left_anti"))
    seen, every, fresh = known.union(asked), None, _cut(asked.mapInPandas(look, kind))
    while not fresh.isEmpty():
        fresh = fresh.withColumn("link", F.when(F.col("link").isNotNull(), _absolute("path", "link")))
        every = fresh if every is None else every.unionByName(fresh)
        leads = fresh.where("link is not null").select(F.col("link").alias("path")).distinct().join(seen, "path", "left_anti")
        listed = fresh.where("dir").select("path").mapInPandas(scan, kind).join(seen, "path", "left_anti")
        fresh = _cut(leads.mapInPandas(look, kind).unionByName(listed).dropDuplicates(["path"]))
        seen = _cut(seen.union(leads).union(fresh.select("path")).distinct())
    return links.limit(0) if every is None else every.where("not dir")


# -- display ----------------------------------------------------------------------------------------------------------
#: Units of sizes, in steps of 1000 (fixed values).
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB", "EB")


def human_size(size: Column) -> Column:
    """At most two decimals, without zeros at the end, in the first unit in which the rounded number is below 1000."""
    out = None
    for i in range(len(SIZE_UNITS) - 1, -1, -1):
        value = size.cast("double")
        for _ in range(i):
            value = value / F.lit(1000.0)
        rounded = F.floor(value * 100 + 0.5).cast("double") / 100
        shown = F.concat(F.regexp_replace(rounded.cast("string"), r"\.0$", ""), F.lit(f" {SIZE_UNITS[i]}"))
        out = shown if out is None else F.when(rounded < 1000, shown).otherwise(out)
    return out


def embedded_text(text: Column, line_ends: str = "AUTO", windows: bool = False) -> Column:
    """Line ends of an embedded file: LF, CRLF, or the platform's with AUTO. A lone carriage return stays."""
    lf = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    crlf = line_ends == "CRLF" or (line_ends == "AUTO" and windows)
    return F.replace(lf, F.lit("\n"), F.lit("\r\n")) if crlf else lf


def safe_name(text: str) -> str:
    """A file name from any text."""
    return re.sub(r"[^A-Za-z0-9._-]", "_", text)

