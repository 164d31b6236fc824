"""Composition of many diffs against a plain walk through them."""

import random

import pytest

from taskspace.operators import manifest
from taskspace.operators.manifest import Manifest


def above(p):
    steps = p.split("/")
    return ["/".join(steps[:k]) for k in range(1, len(steps))]


def composed_by_hand(base, diffs):
    """base: (files {path: hash}, dirs); a diff: (files {path: hash or None}, dirs {path: deleted})."""
    nodes = dict.fromkeys([a for p in [*base[0], *base[1]] for a in above(p)] + list(base[1]))
    nodes |= base[0]
    for files, dirs in diffs:
        dead = {p for p, h in files.items() if h is None}
        nodes = {p: h for p, h in nodes.items() if not dead & {p, *above(p)}}
        for p in sorted((p for p, gone in dirs.items() if gone), key=lambda p: -len(p)):
            if p in nodes and nodes[p] is None and not any(q.startswith(p + "/") for q in nodes):
                del nodes[p]
        for p, h in files.items():
            if h is not None:
                nodes[p] = h
        live = [p for p, gone in dirs.items() if not gone]
        for p in live + [a for q in [*live, *(p for p, h in files.items() if h is not None)] for a in above(q)]:
            nodes.setdefault(p, None)
    return {(p, h) for p, h in nodes.items() if h is not None}, {p for p, h in nodes.items() if h is None}


def frames(spark, files, dirs):
    rows = [(p, h, 1, 1, None, None, False, h is None) for p, h in files.items()]
    return Manifest(spark.createDataFrame(rows, manifest.FILES), spark.createDataFrame(list(dirs.items()), manifest.DIRS))


@pytest.mark.parametrize("seed,with_dirs", [(1, True), (3, False)])
def test_many_diffs_are_those_in_turn(spark, seed, with_dirs):
    rng = random.Random(seed)
    path = lambda: "/".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    base = {path(): f"h{i}" for i in range(25)}, {path(): False for _ in range(4)}
    base = base[0], {p: g for p, g in base[1].items() if p not in base[0]}
    diffs = []
    for k in range(5 if with_dirs else 16):
        files = {path(): (None if rng.random() < 0.4 else f"d{k}") for _ in range(6)}
        dirs = {path(): rng.random() < 0.7 for _ in range(6)} if with_dirs else {path(): False for _ in range(2)}
        diffs.append((files, {p: g for p, g in dirs.items() if p not in files}))
    out = manifest.compose(frames(spark, *base), [frames(spark, *d) for d in diffs], checkpoint_every=2)
    got = {(r["path"], r["hash"]) for r in out.files.collect()}, {r["path"] for r in out.dirs.collect()}
    assert got == composed_by_hand(base, diffs)


def test_the_plan_does_not_grow_with_the_diffs(spark):
    base = frames(spark, {"a/b": "h", "c": "h"}, {})
    one = frames(spark, {"a/b": None, "d/e": "x"}, {})
    exchanges = [manifest.compose(base, [one] * n).files._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for n in (2, 16)]
    assert exchanges[0] == exchanges[1]
