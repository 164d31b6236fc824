"""Canonical manifest texts of any size, written and read by tasks.

A text is made of pieces, one an entry, in the order of the format. :func:`write_manifest` sorts them in the cluster and writes them
as text files whose bytes in order are the canonical text; :func:`read_manifest` reads such a folder, or one file, by ranges of bytes.
The driver sees a manifest's header only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.manifest import DEFAULT_CHUNK, WHOLE_FILE, Manifest, ManifestError, ancestors, is_absolute, live, subtree, validate
from ..session import Tables
from .object_store import file_system

# Versions and names of the formats.
V2023 = "2023-03-03"
SPECS = {
    "absolute-manifest-snapshot-beta-2025-12": ("abs", "full"),
    "absolute-manifest-diff-beta-2025-12": ("abs", "diff"),
    "relative-manifest-snapshot-beta-2025-12": ("rel", "full"),
    "relative-manifest-diff-beta-2025-12": ("rel", "diff"),
}
HASH_ALG = "xxh128"
#: Bytes of a text that one task reads.
SPLIT = 32 << 20
#: The most bytes that a canonical text's head, or one entry, may have.
LONGEST = 256 << 20
#: JSON's short escapes.
ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def utf16_order(column: str = "path") -> Column:
    """The order of canonical manifests: by UTF-16 code units."""
    return F.encode(F.col(column), "UTF-16BE")


def json_text(s: Column) -> Column:
    """A string as JSON in ASCII: other characters as ``\\uXXXX``, those beyond the basic plane as two. Null stays null."""
    for raw, escape in ESCAPES:
        s = F.replace(s, F.lit(raw), F.lit(escape))
    runs = F.regexp_extract_all(s, F.lit(r"[\x20-\x7f]+|[^\x20-\x7f]+"), F.lit(0))
    units = lambda x: F.lower(F.regexp_replace(F.hex(F.encode(x, "UTF-16BE")), "(.{4})", r"\\u$1"))
    coded = F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^[\x20-\x7f]"), x).otherwise(units(x))), "")
    return F.concat(F.lit('"'), F.when(s.rlike(r"^[\x20-\x7f]*\z"), s).otherwise(coded), F.lit('"'))


def _number(c: str) -> Column:
    return F.col(c).cast("string")


def _object(**members: Column) -> Column:
    """An object of members in the order of their names, null ones left out, without its last brace."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), members[k]) for k in sorted(members)]))


def _places(df: DataFrame, id_: str, into: str) -> DataFrame:
    """Gapless numbers from 0 in the order of an id whose upper bits name a partition: one small row a partition is summed up."""
    part = F.shiftright(id_, 33)
    sizes = df.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"), F.min(id_).alias("_low"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = df.withColumn("_part", part).join(sizes.select("_part", "_low", before.alias("_before")), "_part")
    return numbered.withColumn(into, F.col("_before") + F.col(id_) - F.col("_low")).drop("_part", "_low", "_before", id_)


# -- encoding ---------------------------------------------------------------------------------------------------------
def with_all_dirs(m: Manifest) -> DataFrame:
    """The dirs of a manifest and all ancestors of its entries."""
    own = m.dirs.select("path", "deleted")
    entries = m.files.select("path").union(m.dirs.select("path"))
    implied = entries.select(F.explode(ancestors(F.col("path"))).alias("path")).where(~F.col("path").isin("", "/", ".")).distinct().select("path", F.lit(False).alias("deleted"))
    return own.union(implied).groupBy("path").agg(F.max("deleted").alias("deleted"))


def _referred(df: DataFrame, dirs: DataFrame, path: str, into: str) -> DataFrame:
    """``$i/name`` where a path's parent is the i-th dir, else the path."""
    parent = F.regexp_extract(path, r"(?s)^(.*)/[^/]*\z", 1)
    index = dirs.select(F.col("path").alias("_parent"), F.col("place").alias("_index"))
    named = F.concat(F.lit("$"), F.col("_index").cast("string"), F.lit("/"), F.substring_index(path, "/", -1))
    return df.withColumn("_up", parent).join(index, F.col("_up") == F.col("_parent"), "left").withColumn(into, F.coalesce(named, F.col(path))).drop("_up", "_parent", "_index")


def entries_v2023(m: Manifest) -> tuple[DataFrame, dict]:
    """Entries (section, key, text) of a relative manifest in the flat format and its header: links collapsed, dirs and deletions dropped.
    Every file must be hashed and no link absolute. The total of a diff is that of the files left."""
    if m.chunk_size != WHOLE_FILE:
        raise ManifestError(f"the flat format hashes whole files (chunk size {WHOLE_FILE}), not chunks of {m.chunk_size}")
    bad = m.files.where(is_absolute(F.col("symlink_target"))).limit(1).collect()
    if bad:
        raise ManifestError(f"the link '{bad[0]['path']}' has the absolute target '{bad[0]['symlink_target']}'")
    rows = subtree(m, ".", "COLLAPSE_ALL").files.where(live())
    bare = rows.where("hash is null").limit(1).collect()
    if bare:
        raise ManifestError(f"the file '{bare[0]['path']}' has no hash")
    null = F.lit("null")
    text = _object(hash=json_text(F.col("hash")), mtime=F.coalesce(_number("mtime"), null), path=json_text(F.col("path")), size=F.coalesce(_number("size"), null))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return rows.select(F.lit(1).alias("section"), utf16_order().alias("key"), text.alias("text")), {"hashAlg": m.hash_alg, "manifestVersion": V2023, "paths": [], "totalSize": total}


def entries_v2025(m: Manifest, tables: Tables) -> tuple[DataFrame, dict]:
    """Entries of a manifest in the format with indexed directories, dirs (section 0) before files (1), and its header."""
    ordered = tables.keep(with_all_dirs(m).orderBy("path").withColumn("_id", F.monotonically_increasing_id()))
    dirs = tables.keep(_places(ordered, "_id", "place"))
    flag = lambda c: F.when(c, F.lit("true"))
    named = _referred(dirs, dirs, "path", "name")
    first = named.select(F.lit(0).alias("section"), F.encode("path", "UTF-8").alias("key"), _object(name=json_text(F.col("name")), delete=flag(F.col("deleted"))).alias("text"))
    plain = m.files.where("symlink_target is null").withColumn("_target", F.lit(None).cast("string"))
    links = _referred(m.files.where("symlink_target is not null"), dirs, "symlink_target", "_target").select(plain.columns)
    files = _referred(plain.unionByName(links), dirs, "path", "name")
    content = ~F.col("deleted") & F.col("symlink_target").isNull()
    hashed, chunked = F.col("hash").isNotNull(), F.col("chunk_hashes").isNotNull()
    chunks = F.concat(F.lit("["), F.array_join(F.transform("chunk_hashes", json_text), ","), F.lit("]"))
    text = _object(
        name=json_text(F.col("name")),
        hash=json_text(F.col("hash")),
        chunkhashes=F.when(~hashed, chunks),
        symlink=F.when(~hashed & ~chunked, F.concat(F.lit('{"name":'), json_text(F.col("_target")), F.lit("}"))),
        size=F.when(content, _number("size")),
        mtime=F.when(content, _number("mtime")),
        runnable=flag(content & F.col("runnable")),
        delete=flag(F.col("deleted")),
    )
    header = {"dirs": [], "files": [], "fileChunkSizeBytes": m.chunk_size, "hashAlg": m.hash_alg, "specificationVersion": next(s for s, k in SPECS.items() if k == (m.style, m.kind)), "totalSize": m.total_size()}
    if m.parent_hash is not None:
        header["parentManifestHash"] = m.parent_hash
    return first.unionByName(files.select(F.lit(1).alias("section"), utf16_order().alias("key"), text.alias("text"))), header


def pieces(m: Manifest, version: str, tables: Tables) -> DataFrame:
    """One column of texts in order, each of which lacks the brace that ends it; joined with braces they are the canonical text.
    ``version`` is 2023 or 2025. Two entries with the path that comes first are an error."""
    entries, header = entries_v2023(m) if version == "2023" else entries_v2025(m, tables)
    entries = tables.keep(entries)
    first = {r["section"]: r for r in entries.groupBy("section").agg(F.min("key").alias("key")).collect()}
    parts = re.split(r"(?<=\[)(?=\])", json.dumps(header, sort_keys=True, separators=(",", ":")), maxsplit=1 if version == "2023" else 2)
    starts = {1: parts[0]} if version == "2023" else {0: parts[0], 1: ("" if 0 in first else parts[0]) + parts[1]}
    end = ("" if 1 in first else starts[1]) + parts[-1]
    lead = F.lit(",")
    for s, r in first.items():
        at = (F.col("section") == s) & (F.col("key") == F.lit(bytes(r["key"])))
        if entries.where(at).count() > 1:
            raise ManifestError("duplicate path: " + bytes(r["key"]).decode("utf-16-be" if s else "utf-8"))
        lead = F.when(at, F.lit(starts[s])).otherwise(lead)
    last = m.spark.createDataFrame([(2, b"", end[:-1])], entries.schema)
    return entries.withColumn("text", F.concat(lead, "text")).unionByName(last).orderBy("section", "key").select("text")


def write_manifest(m: Manifest, folder: str, version: str = "2025") -> None:
    """Write a manifest's canonical text as the files of a new folder, in order: their bytes one after the other are the text."""
    tables = Tables(m.spark)
    try:
        pieces(m, version, tables).write.option("lineSep", "}").text(folder)
    finally:
        tables.close()


def encode(m: Manifest, version: str) -> str:
    """The canonical text of a manifest that fits the driver."""
    tables = Tables(m.spark)
    try:
        return "".join(r[0] + "}" for r in pieces(m, version, tables).toLocalIterator())
    finally:
        tables.close()


def encode_v2023(m: Manifest) -> str:
    return encode(m, "2023")


def encode_v2025(m: Manifest) -> str:
    return encode(m, "2025")


# -- decoding ---------------------------------------------------------------------------------------------------------
#: Where an entry begins, and where a list of them ends. Quotes within strings are escaped, and no letter follows a string, so
#: neither can be part of a string.
BEGIN = re.compile(rb'(?:(?<=\},)|(?<=\[))\{"(?=[a-z])')
END = re.compile(rb'\}(?=\],"[A-Za-z])')


class _Bytes:
    """The files of one text as a single run of bytes."""

    def __init__(self, files: list[tuple[str, int]]):
        self.files = files

    def read(self, start: int, end: int) -> bytes:
        out, at = [], 0
        for path, size in self.files:
            low, high = max(start - at, 0), min(end - at, size)
            if low < high:
                fs, name = file_system(path)
                with fs.open_input_file(name) as f:
                    f.seek(low)
                    out.append(f.read(high - low))
            at += size
        return b"".join(out)


def _files(path: str) -> list[tuple[str, int]]:
    """The files of a text in order, with sizes: one file, or a folder's by the number of their part."""
    from pyarrow import fs

    system, name = file_system(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise ManifestError(f"there is no manifest at {path}")
    found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(name)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    scheme = path[: len(path) - len(name)] if path.endswith(name) else ""
    number = lambda f: int((re.match(r"part-(\d+)", f.base_name) or [0, 0])[1])
    return [(scheme + f.path, f.size) for f in sorted(found, key=lambda f: (number(f), f.base_name))]


class ManifestPieces(DataSource):
    """Format ``manifest_pieces``: the entries of a canonical text. ``id`` keeps their order, its upper bits name the range of bytes;
    ``rest`` is the part of the header after an entry that ends a list, or before the first (``id`` -1)."""

    @classmethod
    def name(cls) -> str:
        return "manifest_pieces"

    def schema(self) -> str:
        return "id bigint, text string, rest string"

    def reader(self, schema):
        return _PieceReader(self.options["path"], int(self.options.get("split", SPLIT)))


class _PieceReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.files, self.split = _files(path), split
        self.size = sum(s for _, s in self.files)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(max(-(-self.size // self.split), 1))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """Entries that begin in this range of bytes, read on to their ends."""
        number = partition.value
        source, start, end = _Bytes(self.files), number * self.split, min((number + 1) * self.split, self.size)
        low, high = max(start - 2, 0), min(end + (64 << 10), self.size)
        data = source.read(low, high)
        inside = lambda m: m.start() + low >= start
        while high < self.size and not any(m.start() + low >= end for m in BEGIN.finditer(data, max(end - low - 2, 0))):
            if high - end > LONGEST:
                raise ManifestError(f"no entry of a canonical text begins within {LONGEST} bytes after byte {end}")
            more = min(high + max(high - end, 1 << 20), self.size)
            data, high = data + source.read(high, more), more
        begins = [m.start() for m in BEGIN.finditer(data) if inside(m)]
        own = [b for b in begins if b + low < end]
        rows: list[tuple] = [(-1, None, data[: begins[0] if begins else None].decode())] if number == 0 else []
        for i, b in enumerate(own):
            stop = begins[i + 1] if i + 1 < len(begins) else len(data)
            tail = END.search(data, b, stop)
            text, rest = (data[b : tail.end()], data[tail.end() : stop].decode()) if tail else (data[b:stop].rstrip(b","), None)
            rows.append(((number << 33) + i, text.decode(), rest))
        for i in range(0, len(rows), 8192):
            ids, texts, rests = zip(*rows[i : i + 8192], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(rests, pa.string())], ["id", "text", "rest"])


ENTRY = "name string, path string, hash string, size bigint, mtime bigint, chunkhashes array<string>, symlink struct<name: string>, runnable boolean, delete boolean"
_LEAD = r"(?s)^\$([0-9]+)/(.*)\z"


def _check_references(df: DataFrame, column: str) -> None:
    """A name with a slash is absolute or refers to a dir."""
    name = F.col(column)
    bad = df.where(F.contains(name, F.lit("/")) & ~F.startswith(name, F.lit("/")) & ~name.rlike(_LEAD)).select(column).limit(1).collect()
    if bad:
        raise ManifestError(f"'{bad[0][0]}' is neither a name nor $N/name")


def _expanded(df: DataFrame, column: str, dirs: DataFrame) -> DataFrame:
    """``$i/name`` in a column replaced by the path of dir i; an index that no dir has is an error."""
    name = F.col(column)
    lead = name.rlike(_LEAD)
    known = dirs.select(F.col("place").alias("_place"), F.col("path").alias("_dir"))
    found = df.where(lead).withColumn("_ref", F.regexp_extract(name, _LEAD, 1).cast("long")).join(known, F.col("_ref") == F.col("_place"), "left")
    unknown = F.raise_error(F.concat(F.lit("no dir for "), name)).cast("string")
    full = found.withColumn(column, F.coalesce(F.concat(F.col("_dir"), F.lit("/"), F.regexp_extract(name, _LEAD, 2)), unknown)).select(df.columns)
    return df.where(~lead | name.isNull()).unionByName(full)


def _dir_paths(dirs: DataFrame, tables: Tables) -> DataFrame:
    """(place, path, deleted) of dirs (place, name, deleted) whose names refer to dirs before them: each round doubles the known part
    of a path, so there are as many as the depth has binary digits."""
    lead = F.col("name").rlike(_LEAD)
    state = tables.keep(dirs.select("place", "deleted", F.when(lead, F.regexp_extract("name", _LEAD, 1).cast("long")).alias("up"), F.when(lead, F.regexp_extract("name", _LEAD, 2)).otherwise(F.col("name")).alias("path")))
    bad = state.where(F.col("up") >= F.col("place")).limit(1).collect()
    if bad:
        raise ManifestError(f"dir {bad[0]['place']} refers to dir {bad[0]['up']}, which isn't before it")
    while not state.where("up is not null").isEmpty():
        above = state.select(F.col("place").alias("_place"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        moved = state.where("up is not null").join(above, F.col("up") == F.col("_place")).select("place", "deleted", F.col("_up").alias("up"), F.concat("_path", F.lit("/"), "path").alias("path"))
        state = tables.keep(state.where("up is null").unionByName(moved))
    return state.select("place", "path", "deleted")


def read_manifest(spark: SparkSession, path: str, as_diff: bool = False, split: int = SPLIT, tables: Tables | None = None) -> Manifest:
    """A manifest from a canonical text: a file, or a folder as :func:`write_manifest` leaves it. Ranges of ``split`` bytes are read
    at the same time. ``as_diff`` reads the flat format as a diff. Other JSON is an error. Its tables in the shared folder are those of
    ``tables``, or stay until the driver ends."""
    tables = tables or Tables(spark)
    _files(path)
    spark.dataSource.register(ManifestPieces)
    found = tables.keep(spark.read.format("manifest_pieces").option("split", str(split)).load(path))
    around = found.where("rest is not null").orderBy("id").select("id", "rest").limit(4).collect()
    try:
        header = json.loads("".join(r["rest"] for r in around))
    except ValueError as e:
        raise ManifestError(f"not a canonical manifest: {e}") from None
    if header.get("hashAlg") != HASH_ALG:
        raise ManifestError(f"unknown hash algorithm {header.get('hashAlg')!r}")
    size = header.get("totalSize")
    if not isinstance(size, int) or isinstance(size, bool) or size < 0:
        raise ManifestError("totalSize is missing or no size")
    if any(header.get(k) for k in ("dirs", "files", "paths")):
        raise ManifestError("not a canonical manifest: entries aren't in canonical form")
    rows = found.where("text is not null").select("id", F.from_json("text", ENTRY, {"mode": "FAILFAST"}).alias("e")).select("id", "e.*")
    no = [F.coalesce(F.col(c), F.lit(False)).alias(n) for c, n in (("runnable", "runnable"), ("delete", "deleted"))]
    if "manifestVersion" in header:
        if header["manifestVersion"] != V2023:
            raise ManifestError(f"unknown manifestVersion '{header['manifestVersion']}'")
        lacking = rows.where("path is null or hash is null or size is null or mtime is null or size < 0 or mtime < 0").limit(1).collect()
        if lacking:
            raise ManifestError(f"an entry lacks its path, hash, size or mtime: {lacking[0]['path']}")
        files = rows.select("path", "hash", "size", "mtime", F.lit(None).cast("array<string>").alias("chunk_hashes"), F.lit(None).cast("string").alias("symlink_target"), F.lit(False).alias("runnable"), F.lit(False).alias("deleted"))
        return validate(Manifest.of(files, style="rel", kind="diff" if as_diff else "full", chunk_size=WHOLE_FILE, hash_alg=HASH_ALG, declared_size=size))
    spec = header.get("specificationVersion")
    if spec not in SPECS:
        raise ManifestError(f"unknown specificationVersion: {spec}")
    if not rows.where("name is null").isEmpty():
        raise ManifestError("an entry lacks its name")
    _check_references(rows, "name")
    border = next((r["id"] for r in around if '"files":[' in r["rest"]), -1)
    dirs = _dir_paths(_places(rows.where(F.col("id") <= border), "id", "place").select("place", "name", no[1]), tables)
    listed = rows.where(F.col("id") > border).select("name", "hash", "size", "mtime", F.col("chunkhashes").alias("chunk_hashes"), F.col("symlink.name").alias("symlink_target"), *no)
    _check_references(listed, "symlink_target")
    files = _expanded(_expanded(listed, "name", dirs), "symlink_target", dirs).withColumnRenamed("name", "path")
    style, kind = SPECS[spec]
    return validate(Manifest.of(files, dirs.select("path", "deleted"), style=style, kind=kind, chunk_size=header.get("fileChunkSizeBytes", DEFAULT_CHUNK), hash_alg=HASH_ALG, parent_hash=header.get("parentManifestHash"), declared_size=size))
