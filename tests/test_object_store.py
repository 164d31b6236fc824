"""The store of objects by hash: ranges of bytes, addresses, failed tasks, upload and download through it."""

import os

import pytest
from pyspark.sql import functions as F

from taskspace.operators import content, manifest
from taskspace.operators.manifest import Manifest
from taskspace.sources import object_store as store

BLOBS = {"a1": b"", "b2": b"x", "c3": bytes(range(256)) * 40, "d4": b"\x00" * 1000}


def frame(spark, blobs=BLOBS, copies=3):
    return spark.createDataFrame([(h, "xxh128", b) for h, b in blobs.items()] * copies, "hash string, alg string, content binary").repartition(4)


@pytest.mark.parametrize("address", ["{}", "file://{}"])
def test_objects_are_read_back_by_ranges(spark, tmp_path, address):
    folder = address.format(tmp_path / "s")
    assert store.write_objects(frame(spark), folder) == len(BLOBS) and store.write_objects(frame(spark), folder) == len(BLOBS)
    assert sorted(os.listdir(tmp_path / "s")) == sorted(f"{h}.xxh128" for h in BLOBS)
    rows = store.read_ranges(spark, folder, 1000).collect()
    got = {h: b"".join(bytes(r["content"]) for r in sorted((r for r in rows if r["hash"] == h), key=lambda r: r["start"])) for h in BLOBS}
    assert got == BLOBS and {r["alg"] for r in rows} == {"xxh128"} and all(r["size"] == len(BLOBS[r["hash"]]) and len(r["content"]) <= 1000 for r in rows)
    assert len(rows) == 1 + 1 + 11 + 1


def test_a_failed_job_leaves_whole_objects_only_and_may_run_again(spark, tmp_path):
    folder = str(tmp_path / "s")
    with pytest.raises(Exception, match="Failed renaming"):
        store.write_objects(frame(spark, BLOBS | {"no/such/dir": b"none"}), folder)
    left = os.listdir(folder)
    assert not [n for n in left if n.startswith(".")]
    assert all(open(os.path.join(folder, n), "rb").read() == BLOBS[n[:2]] for n in left)
    assert store.write_objects(frame(spark), folder) == len(BLOBS) and len(os.listdir(folder)) == len(BLOBS)


def test_upload_and_download_by_address(spark, tmp_path):
    source, folder = tmp_path / "in", f"file://{tmp_path}/store"
    source.mkdir()
    texts = {"a": b"same", "b": b"same", "c": b"c" * 2500}
    for n, b in texts.items():
        (source / n).write_bytes(b)
    m = Manifest.of(spark.createDataFrame([(str(source / n), len(b), int((source / n).stat().st_mtime_ns // 1000)) for n, b in texts.items()], "path string, size long, mtime long"), style="abs", chunk_size=1000)
    full, stats = content.hash_upload(m, folder)
    full = full.with_files(full.files.persist())
    distinct = len({b[i : i + 1000] for b in texts.values() for i in range(0, len(b), 1000)})
    assert stats.first()["uploaded_objects"] == distinct == 3
    for n in texts:
        (source / n).unlink()
    counts = {r["action"]: r["n"] for r in content.download(full, folder).collect()}
    assert counts["write"] == 3 and {n: (source / n).read_bytes() for n in texts} == texts
    other = f"file://{tmp_path}/other"
    plan = content.sync_plan([full], content.list_store(spark, folder), content.list_store(spark, folder).limit(0))
    assert content.sync_objects(plan, folder, other) == distinct and sorted(os.listdir(tmp_path / "other")) == sorted(os.listdir(tmp_path / "store"))
    assert manifest.total_size(full.files) == sum(map(len, texts.values()))
