"""Reading and writing manifests as canonical JSON: the flat 2023 format and the drafts with indexed directories.

A corpus of documents is decoded as a frame (:func:`decode_frame`), one document that fits the driver by :func:`decode`, which takes
any JSON. Canonical texts of any size are written and read by :mod:`.manifest_text`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.manifest import DEFAULT_CHUNK, DIRS, FILES, WHOLE_FILE, Manifest, ManifestError, total_size, validate
from .manifest_text import HASH_ALG, SPECS, V2023, encode_v2023, encode_v2025, json_text, read_manifest, utf16_order, with_all_dirs, write_manifest  # noqa: F401

def canonical_json(value) -> str:
    """Sorted keys, no spaces, ASCII escapes."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


# -- decoding ---------------------------------------------------------------------------------------------------------
def expand(name: str, dirs: dict[int, str]) -> str:
    """The path of ``$i/name``."""
    lead, slash, rest = name.partition("/")
    if not slash or not lead:
        return name
    if not lead.startswith("$"):
        raise ManifestError(f"Invalid path format '{name}': paths with '/' must use $N/ reference")
    if not re.fullmatch(r"\$[0-9]+", lead):
        raise ManifestError(f"Invalid directory reference '{name}': expected $N/component format")
    if int(lead[1:]) not in dirs:
        raise ManifestError(f"Invalid directory reference '{name}': index {lead[1:]} not found")
    return f"{dirs[int(lead[1:])]}/{rest}"


def _need(d: dict, key: str, kind: type, what: str = ""):
    v = d.get(key)
    if not isinstance(v, kind) or isinstance(v, bool) or (kind is int and v < 0):
        raise ManifestError(f"{what or 'manifest'} missing or invalid {key}")
    return v


def rows_v2023(data: dict) -> list[tuple]:
    if data.get("manifestVersion") != V2023:
        raise ManifestError(f"expected manifestVersion '{V2023}', got '{data.get('manifestVersion')}'")
    return [(_need(p, "path", str, "path entry"), _need(p, "hash", str, "path entry"), _need(p, "size", int, "path entry"), _need(p, "mtime", int, "path entry"), None, None, False, False) for p in _need(data, "paths", list)]


def rows_v2025(data: dict) -> tuple[list[tuple], list[tuple]]:
    dirs: dict[int, str] = {}
    found = []
    for i, d in enumerate(data.get("dirs") or []):
        dirs[i] = expand(_need(d, "name", str, "dir entry"), dirs)
        found.append((dirs[i], bool(d.get("delete", False))))
    files = []
    for f in data.get("files") or []:
        link = (f.get("symlink") or {}).get("name")
        files.append((expand(_need(f, "name", str, "file entry"), dirs), f.get("hash"), f.get("size"), f.get("mtime"), f.get("chunkhashes"), expand(link, dirs) if link is not None else None, bool(f.get("runnable", False)), bool(f.get("delete", False))))
    return files, found


def decode(spark: SparkSession, text: str, as_diff: bool = False) -> Manifest:
    """A manifest from its JSON text; the format follows from its keys. ``as_diff`` reads the flat format as a diff."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise ManifestError(f"Invalid JSON: {e}") from None
    if data.get("hashAlg") != HASH_ALG:
        raise ManifestError(f"unknown hash algorithm {data.get('hashAlg')!r}")
    size = _need(data, "totalSize", int)
    if "manifestVersion" in data:
        files, dirs = rows_v2023(data), []
        header = {"style": "rel", "kind": "diff" if as_diff else "full", "chunk_size": WHOLE_FILE}
    else:
        spec = data.get("specificationVersion")
        if spec not in SPECS:
            raise ManifestError(f"Unknown specificationVersion: {spec}")
        files, dirs = rows_v2025(data)
        header = {"style": SPECS[spec][0], "kind": SPECS[spec][1], "chunk_size": data.get("fileChunkSizeBytes", DEFAULT_CHUNK), "parent_hash": data.get("parentManifestHash")}
    return validate(Manifest(spark.createDataFrame(files, FILES), spark.createDataFrame(dirs, DIRS), hash_alg=HASH_ALG, declared_size=size, **header))


def decode_frame(documents: DataFrame, text: str = "value", keep: Iterable[str] = ()) -> DataFrame:
    """File rows of a frame of manifest texts, with columns ``keep``. Flat documents decode natively; those with indexed
    directories by an Arrow function, as an index refers to entries before it."""
    keep = list(keep)
    schema = "struct<manifestVersion: string, paths: array<struct<path: string, hash: string, size: bigint, mtime: bigint>>>"
    parsed = documents.withColumn("_m", F.from_json(F.col(text), schema))
    flat = parsed.where("_m.manifestVersion is not null").select(*keep, F.explode("_m.paths").alias("p"))
    none = [F.lit(None).cast(FILES[n].dataType).alias(n) for n in ("chunk_hashes", "symlink_target")]
    first = flat.select(*keep, "p.path", "p.hash", "p.size", "p.mtime", *none, F.lit(False).alias("runnable"), F.lit(False).alias("deleted"))
    kind = "array<" + FILES.simpleString().replace("struct<", "struct<", 1) + ">"

    @F.pandas_udf(kind)
    def decoded(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(FILES.names, r, strict=True)) for r in rows_v2025(json.loads(t))[0]] for t in texts])

    rest = parsed.where("_m.manifestVersion is null").select(*keep, F.explode(decoded(F.col(text))).alias("p")).select(*keep, *[f"p.{n}" for n in FILES.names])
    return first.unionByName(rest)


def declared_and_actual(m: Manifest) -> tuple[int, int]:
    """The size that a manifest states and that of its entries."""
    return m.total_size(), total_size(m.files)
