"""Canonical manifest texts of any size: against Python's JSON, by small ranges of bytes, and back."""

import json
import os

import pytest
from pyspark.sql import functions as F

from taskspace.operators import manifest
from taskspace.operators.manifest import Manifest, ManifestError
from taskspace.sources import manifest_codec as codec
from taskspace.sources import manifest_text as texts

ODD = ["plain", "", 'q"uo\\te', "é￮\U0001f600x", "\x00\x01\x1f\b\f\n\r\t", "a},{", '[{"hash', 'x}],"files":[{"a', "}", " /", "$1", "tab\there"]


def whole(folder):
    return b"".join(open(p, "rb").read() for p, _ in texts._files(str(folder)))


def rows_of(m):
    return sorted(map(repr, m.files.select(*manifest.FILES.names).collect())), sorted(map(repr, m.dirs.select("path", "deleted").collect()))


def test_json_text_is_that_of_python(spark):
    got = spark.createDataFrame([(i, s) for i, s in enumerate([*ODD, None])], "i int, s string").select("s", texts.json_text(F.col("s")).alias("j")).collect()
    assert all(r["j"] == (None if r["s"] is None else json.dumps(r["s"])) for r in got) and len(got) == len(ODD) + 1


def tree(spark, kind="full", **header):
    """Names that look like the format itself, links, chunks and deletions, at depths of 1 to 40."""
    names = [s.replace("/", "_").replace("\x00", "0") for s in ODD if s not in ("", "$1")]
    files = [(f"d{i % 3}/{n}/{n}{i}", f"h{i}", i, 5 * i, None, None, i % 2 == 0, False) for i, n in enumerate(names)]
    files += [("/".join(["deep"] * 40) + "/end", None, 150, 9, ["c1", "c2"], None, False, False), ("top", "h", 0, 0, None, None, False, False)]
    files += [("link", None, None, None, None, f"d0/{names[0]}/{names[0]}0", False, False)]
    if kind == "diff":
        files += [("gone/f", None, None, None, None, None, False, True)]
    dirs = [("empty/one", False)] + ([("gone/dir", True)] if kind == "diff" else [])
    return Manifest(spark.createDataFrame(files, manifest.FILES), spark.createDataFrame(dirs, manifest.DIRS), style="rel", kind=kind, chunk_size=100, **header)


@pytest.mark.parametrize("split", [90, texts.SPLIT])
@pytest.mark.parametrize("kind", ["full", "diff"])
def test_round_trip_by_ranges_of_bytes(spark, tmp_path, kind, split):
    m = tree(spark, kind, parent_hash="[]p" if kind == "diff" else None)
    texts.write_manifest(m, str(tmp_path / "m"))
    text = whole(tmp_path / "m").decode()
    data = json.loads(text)
    assert codec.canonical_json(data) == text == codec.encode_v2025(m)
    back = texts.read_manifest(spark, str(tmp_path / "m"), split=split)
    plain = codec.decode(spark, text)
    assert rows_of(back) == rows_of(plain) and (back.style, back.kind, back.chunk_size, back.parent_hash, back.declared_size) == ("rel", kind, 100, m.parent_hash, m.total_size())
    assert rows_of(back)[0] == rows_of(m)[0]
    one = tmp_path / "one.json"
    one.write_text(text)
    assert rows_of(texts.read_manifest(spark, str(one), split=split)) == rows_of(plain)


def test_flat_format_of_snapshots_and_diffs(spark, tmp_path):
    m = tree(spark)
    flat = Manifest(m.files.where("chunk_hashes is null and size is not null or symlink_target is not null"), m.dirs, kind="diff")
    gone = flat.with_files(flat.files.unionByName(spark.createDataFrame([("gone", None, None, None, None, None, False, True)], manifest.FILES)))
    texts.write_manifest(gone, str(tmp_path / "m"), "2023")
    text = whole(tmp_path / "m").decode()
    paths = [p["path"] for p in json.loads(text)["paths"]]
    assert codec.canonical_json(json.loads(text)) == text and paths == sorted(paths, key=lambda p: p.encode("utf-16-be")) and "link" in paths and "gone" not in paths
    assert json.loads(text)["totalSize"] == sum(p["size"] for p in json.loads(text)["paths"])
    back = texts.read_manifest(spark, str(tmp_path / "m"), as_diff=True, split=50)
    assert back.kind == "diff" and rows_of(back) == rows_of(codec.decode(spark, text, as_diff=True))
    with pytest.raises(ManifestError):
        codec.encode_v2023(flat.with_files(flat.files.withColumn("hash", F.lit(None).cast("string"))))


def test_empty_manifests(spark, tmp_path):
    for version, dirs in (("2023", []), ("2025", []), ("2025", [("only", False)])):
        m = Manifest(spark.createDataFrame([], manifest.FILES), spark.createDataFrame(dirs, manifest.DIRS))
        folder = str(tmp_path / f"{version}{len(dirs)}")
        texts.write_manifest(m, folder, version)
        back = texts.read_manifest(spark, folder, split=10)
        assert rows_of(back) == rows_of(m) and codec.canonical_json(json.loads(whole(folder))) == whole(folder).decode()


def test_what_is_no_canonical_manifest_is_an_error(spark, tmp_path):
    head = '{"dirs":[%s],"fileChunkSizeBytes":-1,"files":[%s],"hashAlg":"xxh128","specificationVersion":"relative-manifest-snapshot-beta-2025-12","totalSize":0}'
    bad = ["", "{", head % ('{"name":"$0/a"}', ""), head % ("", '{"name":"$3/a"}'), head % ("", '{"name":"x/a"}'), head % ("", '{"hash":"h"}'), head % ("", ' {"name": "a"}'), head.replace("xxh128", "md5") % ("", "")]
    for i, text in enumerate(bad):
        path = os.path.join(tmp_path, f"{i}.json")
        with open(path, "w") as f:
            f.write(text)
        with pytest.raises(Exception):  # noqa: B017  an index without a dir is found by a task
            texts.read_manifest(spark, path).files.collect()
    with pytest.raises(ManifestError):
        texts.read_manifest(spark, str(tmp_path / "none"))
    twice = Manifest(spark.createDataFrame([("a", "h", 1, 1, None, None, False, False)] * 2, manifest.FILES), spark.createDataFrame([], manifest.DIRS))
    with pytest.raises(ManifestError):
        codec.encode_v2025(twice)
