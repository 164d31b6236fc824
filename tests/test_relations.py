"""Ranges, parameter spaces, manifests, job models, content and directives."""

import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from taskspace import ranges
from taskspace.functions import paths
from taskspace.operators import content, manifest, model, space
from taskspace.operators.manifest import Manifest, ManifestError
from taskspace.plans import registry
from taskspace.ranges import IntRange, RangeError, RangeExpr
from taskspace.sources import manifest_codec as codec
from taskspace.streaming import directives as d

# -- ranges -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text,values", [("1-5", [1, 2, 3, 4, 5]), ("1-10:2", [1, 3, 5, 7, 9]), ("1-3,10-12", [1, 2, 3, 10, 11, 12]), ("-3 - 2", [-3, -2, -1, 0, 1, 2]), ("10-1:-3", [1, 4, 7, 10]), (" 5 , 1 ", [1, 5]), ("1-3,4-6", [1, 2, 3, 4, 5, 6])])
def test_range_values(text, values):
    r = RangeExpr.parse(text)
    assert list(r) == values and len(r) == len(values) and [r[i] for i in range(-len(r), len(r))] == values + values
    assert all((v in r) == (v in values) for v in range(-5, 25))
    for s in itertools.product([None, -2, 0, 1, 3], [None, -1, 2, 9], [None, 1, 2, 3, -1, -2]):
        assert list(r.slice(*s)) == values[slice(*s)]


@pytest.mark.parametrize("text", ["1-5,3-7", "1-5:0", "", "5-1", "1,", ",1", "a", "1--", "1 2", f"{1 << 62}"])
def test_range_errors(text):
    with pytest.raises(RangeError):
        RangeExpr.parse(text)


def test_range_runs():
    assert str(RangeExpr.from_values([1, 5, 7, 9])) == "1,5,7,9"
    assert ranges.chunk_text([1, 5, 7, 9]) == "1,5-9:2"
    assert str(RangeExpr.from_values([1, 2, 3, 5, 7, 8, 9])) == "1-3,5,7,8,9" and ranges.chunk_text([1, 2, 3, 5, 7, 8, 9]) == "1-3,5,7-9"
    assert str(RangeExpr([IntRange(5, 5)], contiguous=True)) == "5-5"


def test_range_columns(spark):
    texts = ["1-10:3,20", "5", "-3-2", "1-1000000:7"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("r", ranges.parse_column(F.col("t")))
    got = df.select(ranges.display(F.col("r")), ranges.length(F.col("r")), ranges.total(F.col("r")), ranges.get(F.col("r"), F.lit(-1)), ranges.contains(F.col("r"), F.lit(5))).collect()
    for row, t in zip(got, texts, strict=True):
        r = RangeExpr.parse(t)
        assert tuple(row) == (str(r), len(r), sum(r), r[-1], 5 in r)


# -- spaces -----------------------------------------------------------------------------------------------------------
def test_space_order_and_access(spark):
    dims = [space.Dimension("A", "INT", RangeExpr.parse("1-3,7")), space.Dimension("B", "STRING", ["x", "y"]), space.Dimension("C", "INT", [5, 6])]
    s = space.Space(dims, "A * (B, C)")
    want = [{"A": a, "B": b, "C": c} for a in [1, 2, 3, 7] for b, c in [("x", 5), ("y", 6)]]
    assert len(s) == 8 and [s.at(i) for i in range(8)] == want and s.at(-1) == want[-1]
    rows = [r.asDict() for r in s.tasks(spark).orderBy("task_index").collect()]
    assert [{k: r[k] for k in "ABC"} for r in rows] == want
    assert [r["task_index"] for r in s.tasks(spark, 3, 5).collect()] == [3, 4]
    tasks = spark.createDataFrame([(1, "x", 5), (1, "x", 6), (4, "x", 5), (7, "y", 6)], "A long, B string, C long")
    assert [tuple(r) for r in s.contains(tasks).collect()] == [(1, "x", 5), (7, "y", 6)]


def test_huge_space_is_lazy(spark):
    s = space.Space([space.Dimension(n, "INT", RangeExpr.parse("1-1000000:3")) for n in "ABC"])
    n = 333334
    assert len(s) == n**3 and s.at(n**3 - 1) == {"A": 1000000, "B": 1000000, "C": 1000000}
    assert s.tasks(spark, n**3 - 2).count() == 2
    assert [r["task_index"] for r in space.Space().tasks(spark).collect()] == [0]


@pytest.mark.parametrize("text", ["A * ", "A * B)", "(A)", "(A, B", "A", "A * A", "A * X", "A , B", "(A, B) *", "A ** B"])
def test_bad_combinations(text):
    with pytest.raises(space.SpaceError):
        space.parse_combination(text, ["A", "B"])


@pytest.mark.parametrize("text,size,contiguous,want", [("1,10-12,18-50", 10, True, ["1-1", "10-12", "18-26", "27-34", "35-42", "43-50"]), ("1-10", 4, False, ["1-4", "5-7", "8-10"]), ("1-10:2", 2, False, ["1,3", "5,7", "9"]), ("1-9:4,20", 3, False, ["1,5", "9,20"]), ("5", 3, True, ["5-5"]), ("1-3,4-6", 2, True, ["1-2", "3-4", "5-6"])])
def test_chunks(spark, text, size, contiguous, want):
    s = space.Space([space.Dimension("X", "CHUNK[INT]", RangeExpr.parse(text), space.Chunks(size, 0, contiguous))])
    assert [s.at(i)["X"] for i in range(len(s))] == want
    assert [r["X"] for r in s.tasks(spark).orderBy("task_index").collect()] == want


def test_chunk_spread_is_the_slot_rule():
    for n in range(1, 60):
        for size in range(1, 20):
            count, small, extra = space.spread(n, size)
            sizes = [small] * count
            for i in range(extra):
                sizes[(i * count) // extra] += 1
            island = space.Island(0, n, count, small, extra, 0)
            bounds = [space.chunk_bounds(island, i) for i in range(count)]
            assert [z - a + 1 for a, z in bounds] == sizes and bounds[0][0] == 0 and bounds[-1][1] == n - 1


def test_islands(spark):
    rng = random.Random(1)
    values = sorted(set(rng.randrange(-70_000, 200_000) for _ in range(3000)) | set(range(65_530, 65_540)))
    got = sorted(tuple(r) for r in space.islands(spark.createDataFrame([(v,) for v in values], "v long"), "v").collect())
    assert got == space.consecutive(values)


def test_islands_across_borders_and_groups(spark):
    big = 1 << 40
    values = [*range(-70_000, 140_000), 200_000, 200_002, *range(big - 2, big + 3), -big, -big - 1, (1 << 62) + 1]
    df = spark.createDataFrame([(g, v) for g in "ab" for v in values[g == "b" :]] + [("a", None), ("a", 200_000)], "g string, v long")
    assert sorted(tuple(r) for r in space.islands(df.where("g = 'a'"), "v").collect()) == space.consecutive(sorted(values))
    got = sorted(tuple(r) for r in space.islands(df, "v", ["g"]).collect())
    assert got == sorted([("a", *r) for r in space.consecutive(sorted(values))] + [("b", *r) for r in space.consecutive(sorted(values[1:]))])
    assert space.islands(df.limit(0), "v").count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_static_chunks_in_pieces(spark, monkeypatch, kind):
    monkeypatch.setattr(space, "BUCKET", 7)
    rng = random.Random(3)
    rows = [(g, rng.randrange(-50, 1 << 40)) for g in ("x", "y", None) for _ in range({"x": 103, "y": 5, None: 31}[g])]
    df = spark.createDataFrame(rows, "g string, v long").select("g", F.lpad(F.col("v").cast("string"), 20, "0").alias("v") if kind == "string" else "v")
    for by in (["g"], []):
        groups: dict = {}
        for r in space.static_chunks(df, "v", 10, by).collect():
            groups.setdefault(r["g"] if by else 0, []).append((r["v"], r["chunk"]))
        for members in groups.values():
            n = len(members)
            count = -(-n // 10)
            small, extra = divmod(n, count)
            assert [c for _, c in sorted(members)] == [c for c in range(count) for _ in range(small + (c < extra))]
        assert sum(map(len, groups.values())) == len(rows)
    assert space.static_chunks(df.limit(0), "v", 10, ["g"]).count() == 0


def test_numbered_chunks_have_no_task_for_a_group(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    plan = space.static_chunks(df, "id", 10, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Subquery")[0]


def test_adaptive_chunks():
    dims = [space.Dimension("A", "STRING", ["x", "y"]), space.Dimension("F", "CHUNK[INT]", RangeExpr.parse("1-20"), space.Chunks(2, 10, True))]
    s = space.Space(dims)
    assert len(s) == 0
    plan = space.Adaptive(s)
    assert plan.next() == {"A": "x", "F": "1-2"}
    assert plan.record(2.0, 2) == int(0.75 * 2 + 0.25 * 10)
    seen = []
    while (t := plan.next()) is not None:
        seen.append(t)
    assert seen[-1]["A"] == "y" and seen[-1]["F"].endswith("20")
    assert len(space.Space(dims, chunk_size=5)) == 8


# -- manifests --------------------------------------------------------------------------------------------------------
def files(spark, rows):
    """Rows of (path, hash, size, mtime) or (path, link)."""
    full = [(r[0], *r[1:], None, None, False, False) if len(r) == 4 else (r[0], None, None, None, None, r[1], False, False) for r in rows]
    return Manifest(spark.createDataFrame(full, manifest.FILES), spark.createDataFrame([], manifest.DIRS))


def as_set(m):
    return {(r["path"], r["hash"], r["deleted"]) for r in m.files.collect()}, {(r["path"], r["deleted"]) for r in m.dirs.collect()}


def random_tree(rng):
    return [(f"{rng.choice('abc')}/{rng.choice('de')}/{rng.randrange(4)}", f"h{rng.randrange(9)}", 1, 1) for _ in range(8)]


def test_diff_then_compose_is_the_identity(spark):
    rng = random.Random(2)
    for _ in range(3):
        one, two = (files(spark, {r[0]: r for r in random_tree(rng)}.values()) for _ in range(2))
        assert as_set(manifest.compose(one, [manifest.diff(one, two)]))[0] == as_set(two)[0]


def test_diff(spark):
    one = files(spark, [("a/x", "h1", 1, 1), ("a/y", "h2", 1, 1), ("b", "h3", 1, 1)])
    two = files(spark, [("a/x", "h1", 1, 1), ("b", "h9", 1, 1), ("c", "h4", 1, 1)])
    assert as_set(manifest.diff(one, two))[0] == {("a/y", None, True), ("b", "h9", False), ("c", "h4", False)}
    with pytest.raises(ManifestError):
        manifest.diff(one, two.clear_hashes())
    assert as_set(manifest.diff(one.clear_hashes(), two.clear_hashes()))[0] == {("a/y", None, True), ("c", None, False)}
    with_dirs = Manifest(one.files, spark.createDataFrame([("a", False), ("e", False)], manifest.DIRS))
    assert as_set(manifest.diff(with_dirs, two))[1] == {("a", True), ("e", True)}


def test_compose_dirs_and_deletions(spark):
    base = files(spark, [("a/b/x", "h", 1, 1), ("c", "h", 1, 1)])
    dead = base.with_files(spark.createDataFrame([("a/b/x", None, None, None, None, None, False, True)], manifest.FILES), spark.createDataFrame([("a/b", True), ("a", True)], manifest.DIRS), kind="diff")
    out = as_set(manifest.compose(base, [dead]))
    assert out == ({("c", "h", False)}, set())
    keep = dead.with_files(dead.files, spark.createDataFrame([("a/b", True)], manifest.DIRS))
    assert as_set(manifest.compose(base, [keep]))[1] == {("a", False)}
    both = manifest.compose_diffs([dead, files(spark, [("a/z", "h2", 1, 1)])])
    assert as_set(both) == ({("a/b/x", None, True), ("a/b", None, True), ("a/z", "h2", False)} - {("a/b", None, True)}, {("a/b/x", True), ("a/b", True), ("a", False)})


def test_subtree_links(spark):
    m = files(spark, [("d/real", "h1", 1, 1), ("d/in", "d/real"), ("d/out", "e/far"), ("e/far", "h2", 2, 2), ("e/sub/f", "h3", 3, 3), ("d/dir", "e/sub"), ("d/lost", "nowhere"), ("d/c1", "d/c2"), ("d/c2", "d/c1"), ("d/chain", "d/in")])
    rows = lambda p: {(r["path"], r["hash"], r["symlink_target"]) for r in manifest.subtree(m, "d", p).files.collect()}
    real = {("real", "h1", None)}
    outer = {("out", "h2", None), ("dir/f", "h3", None)}
    inner = {("in", None, "real"), ("c1", None, "c2"), ("c2", None, "c1"), ("chain", None, "in")}
    assert rows("EXCLUDE_ALL") == real and rows("EXCLUDE_ESCAPING") == real | inner
    assert rows("COLLAPSE_ESCAPING") == real | inner | outer
    assert rows("COLLAPSE_ALL") == real | outer | {("in", "h1", None), ("chain", "h1", None)}
    with pytest.raises(ManifestError):
        manifest.subtree(m, "d", "PRESERVE")


def test_partition_and_roots(spark):
    m = files(spark, [("/p/a/1", "h", 1, 1), ("/p/b/2", "h", 2, 2), ("/q/c/3", "h", 3, 3)])
    m = Manifest(m.files, m.dirs, style="abs")
    assert [(r, s.files.count()) for r, s in manifest.partition(m, ["/q"])] == [("/q", 1), ("/p", 2)]
    assert [r for r, _ in manifest.partition(m)] == ["/"] and manifest.common_root(m) == "/"
    with pytest.raises(ManifestError):
        manifest.check_roots(["/p", "/p/a"])


def test_paths_and_globs(spark):
    rows = [("a/./b/../c", "a/c"), ("/../x", "/x"), ("../x", "../x"), ("", "."), ("C:\\a\\..\\b", "C:/b"), ("a//b/", "a/b")]
    got = spark.createDataFrame(rows, "p string, w string").select(manifest.normalise(F.col("p")), "w").collect()
    assert all(g == w for g, w in got) and all(manifest.normalise_text(p) == w for p, w in rows)
    names = ["a/b.txt", "a.txt", "x[1].py", "b.py"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    keep = lambda i, e=(): {r[0] for r in df.where(manifest.glob_filter(F.col("p"), i, e)).collect()}
    assert keep(["*.txt"]) == {"a/b.txt", "a.txt"} and keep([], ["*.py"]) == {"a/b.txt", "a.txt"} and keep(["[!a]*"]) == {"x[1].py", "b.py"} and keep(["?.py"]) == {"b.py"}


def test_codec_round_trips(spark):
    m = files(spark, [("b/é", "h1", 1, 5), ("a", "h2", 2, 6), ("b/\U0001f600", "h3", 3, 7), ("b/￮", "h4", 4, 8)])
    text = codec.encode_v2023(m)
    assert text.startswith('{"hashAlg":"xxh128","manifestVersion":"2023-03-03","paths":[{"hash":"h2","mtime":6,"path":"a","size":2}')
    assert [p["path"] for p in json.loads(text)["paths"]] == ["a", "b/é", "b/\U0001f600", "b/￮"] and "\\ud83d" in text
    back = codec.decode(spark, text)
    assert as_set(back)[0] == as_set(m)[0] and codec.encode_v2023(back) == text
    linked = m.with_files(m.files.union(files(spark, [("l", "b/é")]).files), spark.createDataFrame([("e/f", False)], manifest.DIRS))
    v25 = codec.encode_v2025(linked)
    assert [x["name"] for x in json.loads(v25)["dirs"]] == ["b", "e", "$1/f"]
    again = codec.decode(spark, v25)
    assert {r["symlink_target"] for r in again.files.collect()} == {None, "b/é"} and codec.encode_v2025(again) == v25
    rows = codec.decode_frame(spark.createDataFrame([(1, text), (2, v25)], "k int, value string"), keep=["k"])
    assert {(r["k"], r["n"]) for r in rows.groupBy("k").agg(F.count("*").alias("n")).collect()} == {(1, 4), (2, 5)}
    for bad in ["{", '{"hashAlg":"md5"}', '{"hashAlg":"xxh128","totalSize":1,"specificationVersion":"x"}']:
        with pytest.raises(ManifestError):
            codec.decode(spark, bad)


def test_validation(spark):
    m = files(spark, [("a", "h", 1, 1), ("/abs", "h", 1, 1), ("a", "h", 1, 1)])
    found = {(r["path"], r["problem"]) for r in manifest.violations(m).collect()}
    assert found == {("/abs", "path style does not match the manifest"), ("a", "duplicate path")}
    with pytest.raises(ManifestError):
        manifest.validate(m)


# -- content ----------------------------------------------------------------------------------------------------------
def test_collect_hash_upload_download(spark, tmp_path):
    import xxhash

    src, store, out = tmp_path / "src", tmp_path / "store", tmp_path / "out"
    (src / "d").mkdir(parents=True)
    (src / "a.bin").write_bytes(b"x" * 2500)
    (src / "d" / "b.txt").write_bytes(b"hello")
    (src / "d" / "c.txt").write_bytes(b"hello")
    os.symlink(src / "a.bin", src / "d" / "l")
    m = content.collect(spark, [str(src)], policy="PRESERVE")
    assert m.files.count() == 4 and m.dirs.count() == 2
    hashed, rows, stats = content.hash_manifest(m)
    got = {os.path.basename(r["path"]): r["hash"] for r in hashed.files.collect()}
    assert got["a.bin"] == xxhash.xxh3_128_hexdigest(b"x" * 2500) and got["b.txt"] == got["c.txt"] and got["l"] is None
    assert rows.count() == 3 and stats.first()["processed_files"] == 3
    again = content.hash_manifest(m, rows)
    assert again[2].first()["skipped_files"] == 3 and again[1].count() == 0
    chunked = content.hash_manifest(m, chunk_size=1000)[0]
    assert {len(r["chunk_hashes"] or []) for r in chunked.files.collect()} == {0, 3}
    up, first = content.hash_upload(m, str(store))
    assert first.first()["uploaded_objects"] == 2 and content.hash_upload(m, str(store))[1].first()["uploaded_objects"] == 0
    assert content.list_store(spark, str(store)).count() == 2
    plan = content.sync_plan([up], content.list_store(spark, str(store)), content.list_store(spark, str(store)).limit(0))
    assert content.sync_objects(plan, str(store), str(tmp_path / "other")) == 2 and len(os.listdir(tmp_path / "other")) == 2
    moved = up.with_files(up.files.withColumn("path", F.replace("path", F.lit(str(src)), F.lit(str(out)))).withColumn("symlink_target", F.replace("symlink_target", F.lit(str(src)), F.lit(str(out)))), up.dirs.withColumn("path", F.replace("path", F.lit(str(src)), F.lit(str(out)))))
    os.makedirs(out)
    content.download(moved, str(store))
    assert (out / "d" / "c.txt").read_bytes() == b"hello" and (out / "a.bin").read_bytes() == b"x" * 2500 and os.readlink(out / "d" / "l") == str(out / "a.bin")
    (out / "d" / "c.txt").write_bytes(b"other")
    plan = {os.path.basename(r["path"]): (r["action"], r["new_path"]) for r in content.download_plan(moved, spark.createDataFrame([(str(out / "d" / "c.txt"), 5, 1)], "path string, size long, mtime long"), "CREATE_COPY").collect()}
    assert plan["c.txt"] == ("copy", str(out / "d" / "c (1).txt")) and plan["b.txt"][0] == "write"


def test_copies_get_the_first_free_name(spark, tmp_path):
    """More than 64 taken names, and names that the manifest does not have, neither are overwritten nor end in the original."""
    src, store = tmp_path / "src", tmp_path / "store"
    src.mkdir()
    names = ["a.txt", "b", "x.y (1)"]
    for name in names:
        (src / name).write_bytes(b"new")
    m = content.hash_upload(content.collect(spark, [str(src)], policy="PRESERVE"), str(store))[0]
    m = m.with_files(*[spark.createDataFrame(f.collect(), f.schema) for f in (m.files, m.dirs)])  # as they are now
    for name in names:
        (src / name).write_bytes(b"mine")
    for i in range(1, 71):
        (src / f"a ({i}).txt").write_bytes(b"kept")
    for name in ("b (1)", "b (03)", "b (4)", "x (1).y (1)", "x.y (1) (1)"):
        (src / name).write_bytes(b"kept")
    (src / "b (2)").mkdir()
    before = set(os.listdir(src))
    content.download(m, str(store), "CREATE_COPY")
    assert set(os.listdir(src)) - before == {"a (71).txt", "b (3)", "x (2).y (1)"}
    assert all((src / n).read_bytes() == b"new" for n in ("a (71).txt", "b (3)", "x (2).y (1)"))
    assert all((src / n).read_bytes() in (b"mine", b"kept") for n in before if n != "b (2)")


def test_links_are_made_level_by_level(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "real").write_text("here")
    (tmp_path / "d1").write_text("in the way")
    pairs = [("a", "b"), ("b", "c"), ("c", "real"), ("d1", "c"), ("d2", "c"), ("x", "y"), ("y", "x"), ("to_x", "x"), ("self", "self"), ("sub/far", "nowhere"), *[(f"l{i}", f"l{i + 1}") for i in range(30)]]
    links = spark.createDataFrame([(at(p), at(t)) for p, t in pairs], "path string, target string")
    level = {os.path.relpath(r["path"], tmp_path): r["level"] for r in content.link_levels(links).collect()}
    assert level == {"a": 2, "b": 1, "c": 0, "d1": 1, "d2": 1, "x": None, "y": None, "to_x": None, "self": None, "sub/far": 0, **{f"l{i}": 29 - i for i in range(30)}}
    assert content.make_links(links) == len(pairs) == content.make_links(links)
    assert all(os.readlink(at(p)) == at(t) for p, t in pairs) and open(at("a")).read() == "here"
    assert content.make_links(links.limit(0)) == 0 and content.link_levels(links.limit(0)).count() == 0


def test_names_of_embedded_files(spark):
    df = spark.createDataFrame([("a\r\nb\nc\rd",)], "t string")
    assert df.select(content.embedded_text(F.col("t"), "LF"), content.embedded_text(F.col("t"), "CRLF")).first()[:] == ("a\nb\nc\rd", "a\r\nb\r\nc\rd")


# -- models -----------------------------------------------------------------------------------------------------------
RUN = {"actions": {"onRun": {"command": "x", "args": ["{{Task.Param.F}}"]}}}
TEMPLATE = {"specificationVersion": model.JOB_VERSION, "name": "n {{Param.S}}", "parameterDefinitions": [{"name": "S", "type": "STRING", "default": "é", "maxLength": 2}, {"name": "N", "type": "INT", "default": 5, "minValue": 1}], "steps": [{"name": "A", "parameterSpace": {"taskParameterDefinitions": [{"name": "F", "type": "INT", "range": "1-{{Param.N}}"}]}, "script": RUN}, {"name": "B", "dependencies": [{"dependsOn": "A"}], "bash": "echo"}]}


def test_job(spark):
    t = model.decode_job(json.dumps(TEMPLATE))
    job = model.create_job(spark, t, {"N": "3"})
    assert job.name == "n é" and [len(s.space) for s in job.steps] == [3, 1]
    assert job.steps[1].script["embeddedFiles"][0]["filename"] == "script.sh"
    rows = model.action_frame(job, "A", job.step("A").space.tasks(spark)).orderBy("task_index").collect()
    assert [list(r["args"]) for r in rows] == [["1"], ["2"], ["3"]]
    assert model.summary(spark, job)[0].first()["tasks"] == 4
    with pytest.raises(model.ModelError, match="at most 2"):
        model.create_job(spark, t, {"N": 3}, max_tasks=2)
    with pytest.raises(model.ModelError, match="(?s)is not defined.*less than"):
        model.create_job(spark, t, {"N": 0, "X": 1})
    # é is one character of two bytes: a definition counts characters, a job bytes
    with pytest.raises(model.ModelError, match="length 3"):
        model.create_job(spark, t, {"S": "éa"})


@pytest.mark.parametrize("change,what", [({"steps": []}, "not empty"), ({"extra": 1}, "unknown field"), ({"steps": [{"name": "A", "script": RUN, "dependencies": [{"dependsOn": "Z"}]}]}, "unknown step"), ({"steps": [{"name": "A", "script": {}}]}, "onRun"), ({"extensions": ["NOPE"]}, "unsupported"), ({"parameterDefinitions": [{"name": "1x", "type": "INT"}]}, "invalid name"), ({"parameterDefinitions": [{"name": "X", "type": "BOOL"}]}, "EXPR"), ({"parameterDefinitions": [{"name": "X", "type": "INT", "minValue": 3, "maxValue": 1}]}, "greater"), ({"steps": [{"name": "A", "script": RUN, "dependencies": [{"dependsOn": "B"}]}, {"name": "B", "bash": "x", "dependencies": [{"dependsOn": "A"}]}]}, "cycle|unknown name")])
def test_bad_templates(spark, change, what):
    with pytest.raises(model.ModelError, match=what):
        model.decode({**TEMPLATE, **change})


def test_yaml_booleans_are_strict():
    assert model.load("a: yes\nb: true\nc: on\nd: 2020-01-01\n") == {"a": "yes", "b": True, "c": "on", "d": "2020-01-01"}


def test_merging():
    a = [{"name": "X", "type": "INT", "minValue": 1, "maxValue": 9, "allowedValues": [1, 5, 9], "default": 5}]
    b = [{"name": "X", "type": "INT", "minValue": 3, "allowedValues": [5, 9, 11]}]
    assert model.merge_definitions(b, [a])[0] == {"name": "X", "type": "INT", "minValue": 3, "maxValue": 9, "allowedValues": [5, 9], "default": 5}
    with pytest.raises(model.ModelError, match="differ"):
        model.merge_definitions([{"name": "X", "type": "FLOAT"}], [a])
    with pytest.raises(model.ModelError, match="no common"):
        model.merge_definitions([{"name": "X", "type": "INT", "allowedValues": [2]}], [a])


def test_order_and_closure(spark):
    assert model.step_order([("a", ["c"]), ("b", []), ("c", [])]) == ["c", "a", "b"]
    with pytest.raises(model.ModelError, match="a -> b -> a"):
        model.step_order([("a", ["b"]), ("b", ["a"])])
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("z", "a")], "step string, depends_on string")
    assert {tuple(r) for r in model.closure(edges, spark.createDataFrame([("a",)], "n string")).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert tuple(model.degrees(edges).first()) == (2, 2)


def test_values_and_requirements(spark):
    p = {"name": "L", "type": "LIST[INT]", "minLength": 1, "item": {"minValue": 2}}
    assert model.value_problems(p, "[2, 3]") == [] and model.value_problems(p, [1]) == ["item 0: 1 is less than 2"] and model.value_problems(p, []) != []
    assert model.parameter_arguments(["A=1", '{"B": 2}', "A=3"]) == {"A": "3", "B": 2}
    s = space.Space([space.Dimension("F", "INT", [1, 2])])
    assert model.task_arguments(["F=2"], s) == {"F": 2} and model.task_list(spark, '[{"F": 1}]', s).first()[0] == 1
    with pytest.raises(model.ModelError):
        model.task_arguments(["F=2", "F=1", "G=1"], s)
    workers = spark.createDataFrame([(1, {"amount.worker.vcpu": 4.0}, {"attr.worker.os.family": ["linux"]}), (2, {"amount.worker.vcpu": 1.0}, {"attr.worker.os.family": ["linux"]}), (3, {}, {})], "id int, amounts map<string,double>, attributes map<string,array<string>>")
    need = {"amounts": [{"name": "amount.worker.vcpu", "min": 2}], "attributes": [{"name": "attr.worker.os.family", "anyOf": ["linux"]}]}
    assert [r["id"] for r in model.meets(workers, need).collect()] == [1] and model.check_requirements(need) == []
    assert model.check_requirements({"amounts": [{"name": "bad", "min": 1}]}) != []
    sent = model.to_transport({"A.B": ("int", 5), "C": ("list[float]", [1.5]), "R": ("range_expr", "1-3")})
    assert json.loads(sent)["A.B"] == {"type": "int", "value": "5"} and model.from_transport(sent).names() == ["A.B", "C", "R"]
    assert model.describe_parameters(model.Template("job", TEMPLATE))[0]["required"] is False


# -- paths ------------------------------------------------------------------------------------------------------------
def test_mapping_rules(spark):
    rules = paths.rules_from_json([{"source_path_format": "POSIX", "source_path": "/a", "destination_path": "/x"}, {"source_path_format": "posix", "source_path": "/a/b", "destination_path": "/y"}, {"source_path_format": "WINDOWS", "source_path": "C:\\Data", "destination_path": "/w"}, {"source_path_format": "URI", "source_path": "s3://Bucket/p", "destination_path": "/s"}])
    cases = [("/a/b/c", "/y/c"), ("/a/c/", "/x/c/"), ("/ab", "/ab"), ("c:/DATA/f", "/w/f"), ("S3://bucket/p/q", "/s/q"), ("s3://bucket/P/q", "s3://bucket/P/q"), ("a/b", "a/b"), ("/a", "/x")]
    assert [paths.apply_rules(p, rules) for p, _ in cases] == [w for _, w in cases]
    got = paths.map_paths(spark.createDataFrame(cases, "p string, w string"), "p", rules).collect()
    assert [r["mapped"] for r in got] == [w for _, w in cases]
    assert paths.with_name("C:foo", "x", "WINDOWS") == "C:x" and paths.parts("C:\\a\\b", "WINDOWS") == ["C:\\", "a", "b"] and paths.join("C:\\a", "b", "WINDOWS") == "C:\\a\\b"
    for bad in [lambda: paths.with_name("/", "x", "POSIX"), lambda: paths.with_name("s3://b", "x", "POSIX"), lambda: paths.with_suffix("a", "x", "POSIX")]:
        with pytest.raises(paths.PathError):
            bad()


# -- directives -------------------------------------------------------------------------------------------------------
P = d.PREFIX
LINES = [
    (f"{P}progress: 50.0", "progress", None, False), (f"{P}progress: 150", "progress", d.PROGRESS_ERROR, False), (f"{P}progress: NaN", "progress", d.PROGRESS_ERROR, False), (f"{P}progress:50.0", None, None, False), (f"{P}status: ", None, None, False),
    (f"{P}env: foo=bar", "env", None, False), (f"{P}env: foo", "env", d.SET_ERROR, True), (f'{P}env: "A=x\\ny"', "env", None, False), (f"{P}env:foo=bar", None, "near", True), (f" {P}ENV: a=b", None, "near", True), (f"{P}unset_env: 1F", "unset_env", d.UNSET_ERROR, True), (f"{P}unset_env: F", "unset_env", None, False), (f"{P}fail: bad", "fail", None, False), ("plain", None, None, False), (f"{P}redacted_env: S=secret", "redacted_env", None, False), (f"{P}redacted_env: oops", "redacted_env", d.SET_ERROR, False), (f"{P}session_runtime_loglevel: debug", "session_runtime_loglevel", None, False), (f"{P}unknown: x", None, None, False),
]


def frame(spark, texts, session="s"):
    return spark.createDataFrame([(session, i, t) for i, t in enumerate(texts)], "session_id string, seq long, line string")


def test_directive_lines(spark):
    rows = d.parse(frame(spark, [x[0] for x in LINES])).orderBy("seq").collect()
    for r, (line, kind, error, cancel) in zip(rows, LINES, strict=True):
        assert (r["kind"], r["cancel"]) == (kind, cancel), line
        assert (r["error"] is not None) if error == "near" else r["error"] == error, line
    assert rows[7]["value"] == "x\ny" and rows[5]["name"] == "foo" and rows[0]["number"] == 50.0 and rows[16]["number"] == 10.0
    off = d.parse(frame(spark, [f"{P}redacted_env: oops"]), redactions=False).first()
    assert off["cancel"] and d.malformed(f"{P}env:x") and not d.malformed("env")


def test_redaction_in_batch_and_stream(spark, tmp_path):
    texts = ["before abc", f"{P}redacted_env: T=abc", "an abcabc here", f'{P}redacted_env: "M=one\\nmid\\nlast"', "mid", "the last one", f"{P}progress: 5", f"{P}fail: bad"]
    want = ["before abc", f"{P}redacted_env: T={d.MASK}", f"an {d.MASK} here", f'{P}redacted_env: "M={d.MASK}', d.MASK, f"the {d.MASK} {d.MASK}", f"{P}progress: 5", f"{P}fail: bad"]
    lines = frame(spark, texts)
    assert [r["shown"] for r in d.redacted(d.parse(lines)).orderBy("seq").collect()] == want
    lines.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
    d.run_available(d.status_stream(stream, every_line=True), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert [r["shown"] for r in got] == want and got[-1]["progress"] == 5.0 and got[-1]["fail_message"] == "bad"
    status = d.action_status(d.parse(lines)).first()
    assert status["state"] == "FAILED" and status["log_level"] == 20
    assert d.redact("xaxb", ["xa", "ax"], []) == f"{d.MASK}b"


def test_environment_layers(spark):
    lines = frame(spark, [f"{P}env: A=1", f"{P}env: B=2", f"{P}unset_env: A", f"{P}env: B=3"])
    base = spark.createDataFrame([("s", "A", "0"), ("s", "C", "9")], "session_id string, name string, value string")
    assert {(r["name"], r["value"]) for r in d.environment(d.parse(lines), base).collect()} == {("B", "3"), ("C", "9")}


def test_session_states(spark):
    events = [("enter", "e"), ("success", None), ("run", None), ("success", None), ("exit", "x"), ("exit", "e"), ("success", None), ("run", None), ("end", None)]
    df = spark.createDataFrame([("s", i, w, n) for i, (w, n) in enumerate(events)], "session_id string, seq long, what string, name string")
    got = [(r["state"], r["error"] is None) for r in d.session_states(df).orderBy("seq").collect()]
    assert got == [("RUNNING", True), ("READY", True), ("RUNNING", True), ("READY", True), ("READY", False), ("RUNNING", True), ("READY_ENDING", True), ("READY_ENDING", False), ("ENDED", True)]


# -- command surface --------------------------------------------------------------------------------------------------
def test_commands(spark):
    from taskspace import api

    assert api.check(TEMPLATE)["status"] == "success" and api.check({**TEMPLATE, "steps": []})["problems"]
    assert {r["step"]: r["tasks"] for r in api.summary(spark, TEMPLATE, {"N": 4}).collect()} == {"A": 4, "B": 1}
    assert api.run(spark, TEMPLATE, "A", maximum_tasks=2).count() == 2
    assert [list(r["args"]) for r in api.run(spark, TEMPLATE, "A", tasks=[{"F": 5}]).collect()] == [["5"]]
    with pytest.raises(model.ModelError):
        api.run(spark, TEMPLATE, "A", tasks=[{"F": 6}])
    assert api.order(spark, TEMPLATE) == ["A", "B"] and api.order(spark, TEMPLATE, "A") == ["A"]
    assert api.parameters(TEMPLATE)[1]["name"] == "N"
    assert json.loads(api.render(api.summary(spark, TEMPLATE), "json"))[0]["step"] == "A" and "step: A" in api.render(api.summary(spark, TEMPLATE)) and "tasks: 5" in api.render(api.summary(spark, TEMPLATE), "yaml")


# -- collected links, sizes, roots, closures ------------------------------------------------------------------------------
@pytest.fixture
def linked_tree(tmp_path):
    """A collected folder ``in`` with links to inside, to a file and a folder outside, in a circle and to nothing."""
    inside, out = tmp_path / "in", tmp_path / "out"
    (inside / "sub").mkdir(parents=True)
    (out / "deep").mkdir(parents=True)
    (inside / "sub" / "a.txt").write_text("a")
    (out / "b.txt").write_text("bb")
    os.chmod(out / "b.txt", 0o654)
    (out / "deep" / "c.txt").write_text("ccc")
    (inside / "near").symlink_to("sub/a.txt")
    (inside / "far").symlink_to(out / "b.txt")
    (inside / "tree").symlink_to(out)
    (inside / "gone").symlink_to(tmp_path / "nothing")
    (out / "deep" / "back").symlink_to(out / "b.txt")
    (out / "deep" / "home").symlink_to(inside)
    return tmp_path


def links_of(spark, top, policy):
    m = content.collect(spark, [f"{top}/in"], policy=policy)
    rows = m.files.collect()
    assert len({r["path"] for r in rows}) == len(rows)
    short = lambda p: p and p.removeprefix(f"{top}/")
    return {short(r["path"]): short(r["symlink_target"]) or r["size"] for r in rows}, m


def test_link_policies_of_collect(spark, linked_tree):
    own = {"in/sub/a.txt": 1}
    near, away = {"in/near": "in/sub/a.txt"}, {"in/far": "out/b.txt", "in/tree": "out", "in/gone": "nothing"}
    assert links_of(spark, linked_tree, "PRESERVE")[0] == own | near | away
    assert links_of(spark, linked_tree, "EXCLUDE_ALL")[0] == own
    assert links_of(spark, linked_tree, "EXCLUDE_ESCAPING")[0] == own | near
    found, m = links_of(spark, linked_tree, "COLLAPSE_ESCAPING")
    below_home = {"in/tree/deep/home/sub/a.txt": 1, "in/tree/deep/home/near": 1, "in/tree/deep/home/far": "in/tree/b.txt", "in/tree/deep/home/tree": "in/tree"}
    copied = {"in/far": 2, "in/tree/b.txt": 2, "in/tree/deep/c.txt": 3, "in/tree/deep/back": "in/tree/b.txt"} | below_home
    assert found == own | near | copied
    assert {r["path"].removeprefix(f"{linked_tree}/") for r in m.dirs.collect()} >= {"in", "in/sub", "in/tree/deep", "in/tree/deep/home/sub"}
    assert {r["path"] for r in m.files.where("runnable").collect()} == {f"{linked_tree}/in/far", f"{linked_tree}/in/tree/b.txt"}
    assert links_of(spark, linked_tree, "COLLAPSE_ALL")[0] == own | {"in/near": 1} | copied
    targets = {"out/b.txt": 2, "out/deep/c.txt": 3, "out/deep/back": "out/b.txt", "out/deep/home": "in"}
    assert links_of(spark, linked_tree, "TRANSITIVE_INCLUDE_TARGETS")[0] == own | near | away | targets


def test_sizes_in_words(spark):
    want = {0: "0 B", 999: "999 B", 1000: "1 KB", 1500: "1.5 KB", 999_994: "999.99 KB", 999_999: "1 MB", 1_234_567: "1.23 MB", 10**15: "1 PB", 3 * 10**18: "3 EB"}
    df = spark.createDataFrame([(k,) for k in want], "n long")
    assert {r[0]: r[1] for r in df.select("n", content.human_size(df["n"])).collect()} == want


def test_common_roots(spark):
    def root(*paths):
        df = spark.createDataFrame([(p, 1, 1) for p in paths], "path string, size long, mtime long")
        return manifest.common_root(manifest.Manifest.of(df, style="abs" if paths[0][0] == "/" or ":" in paths[0] else "rel"))

    assert [root("a.txt", "d/b.txt"), root("d/a", "d/e/b"), root("C:/a", "C:/d/b"), root("/x/a", "/y"), root("x/a")] == [".", "d", "C:/", "/", "x"]


def test_closure_of_long_and_wide_graphs(spark):
    long = spark.createDataFrame([(f"s{i}", f"s{i + 1}") for i in range(300)], "step string, depends_on string")
    got = {r["name"]: r["depth"] for r in model.closure(long, spark.createDataFrame([("s100",)], "n string")).collect()}
    assert got == {f"s{i}": i - 100 for i in range(100, 301)}
    wide = [(f"n{i}_{x}", f"n{i + 1}_{y}") for i in range(8) for x in "ab" for y in "ab"]
    assert model.closure(spark.createDataFrame(wide, "step string, depends_on string"), spark.createDataFrame([("n0_a",)], "n string")).count() == 17
    with pytest.raises(model.ModelError, match="cycle"):
        model.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "step string, depends_on string"), spark.createDataFrame([("a",)], "n string"))


@pytest.mark.parametrize("name", ["human_size", "job_summary", "manifest_common_root"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "orders", "documents"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()[list(want.columns)]
    rows = lambda f: sorted(tuple(str(v) for v in r) for r in f.itertuples(index=False))
    assert rows(got) == rows(want)


def test_partition_wants_paths_of_the_manifest_s_style(spark):
    def of(*paths):
        return Manifest.of(spark.createDataFrame([(p, 1, 1) for p in paths], "path string, size long, mtime long"), style="abs" if paths and paths[0][0] == "/" else "rel")

    for m, options in ((of("a/b"), {"roots": ["/a"]}), (of("/a/b"), {"roots": ["a"]}), (of("/a/b"), {"referenced": ["c"]}), (of("a/b"), {"referenced": ["C:/c"]})):
        with pytest.raises(ManifestError, match="aren't"):
            manifest.partition(m, **options)
    assert [r for r, _ in manifest.partition(of("/a/b"), ["/a"], ["/c/d"])] == ["/a", "/c/d"]
