"""Approximate nearest neighbours by inner product: one hierarchical navigable small-world graph a shard, results merged.

Inner products become distances by one more coordinate, the square root of the shard's largest squared norm less the
vector's own. A graph is flat arrays: for each layer an n x m table of neighbour numbers, -1 where there are fewer. Vectors
are inserted and searched in batches, so that one step of all searches of a batch is a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, splitmix

#: Distinct vectors in a shard, about; a group of that size is what one task holds.
SHARD_ROWS = 8192
#: Query vectors that are searched together in one task.
QUERY_BLOCK = 8192


@dataclass
class Graph:
    x: np.ndarray  #: n x (d + 1) float32, with the added coordinate
    layers: list[np.ndarray]  #: neighbour tables; a layer's rows are numbered as vectors are
    entry: int


def augment(v: np.ndarray) -> np.ndarray:
    norms = (v.astype(np.float64) ** 2).sum(1)
    return np.hstack([v, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]]).astype(np.float32)


def _distances(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of q (b x d) to the vectors ids (b x k); infinite for -1."""
    d = x[np.maximum(ids, 0)] - q[:, None, :]
    out = np.einsum("bkd,bkd->bk", d, d)
    out[ids < 0] = np.inf
    return out


def search_layer(x: np.ndarray, table: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ef nearest found for each query: (numbers, distances), nearest first, -1 and infinity where there are fewer."""
    b = len(q)
    seen = np.zeros((b, len(x) + 1), bool)
    seen[:, -1] = True
    rows = np.arange(b)[:, None]
    ids = np.full((b, ef), -1)
    dist = np.full((b, ef), np.inf, np.float32)
    k = min(ef, start.shape[1])
    ids[:, :k] = start[:, :k]
    dist[:, :k] = _distances(x, ids[:, :k], q)
    seen[rows, ids[:, :k]] = True
    done = ids < 0
    active = np.arange(b)
    while len(active):
        a_dist = np.where(done[active], np.inf, dist[active])
        pick = np.argpartition(a_dist, wide, axis=1)[:, :wide] if wide < ef else np.argsort(a_dist, 1)
        open_ = np.isfinite(np.take_along_axis(a_dist, pick, 1))
        live = open_.any(1)
        active, pick, open_ = active[live], pick[live], open_[live]
        if not len(active):
            break
        at = active[:, None]
        done[at, pick] = True
        from_ = np.where(open_, ids[at, pick], -1)
        near = np.where(from_[:, :, None] >= 0, table[from_], -1).reshape(len(active), -1)
        near = np.where(seen[at, near], -1, near)
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        full = (near >= 0).sum(1).max()
        if full:
            near = -np.sort(-near, 1)[:, :full]
        else:
            continue
        seen[at, near] = True
        all_ids = np.hstack([ids[active], near])
        all_dist = np.hstack([dist[active], _distances(x, near, q[active])])
        all_done = np.hstack([done[active], near < 0])
        top = np.argpartition(all_dist, ef - 1, axis=1)[:, :ef]
        ids[active] = np.take_along_axis(all_ids, top, 1)
        dist[active] = np.take_along_axis(all_dist, top, 1)
        done[active] = np.take_along_axis(all_done, top, 1)
    order = np.argsort(dist, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def choose(x: np.ndarray, ids: np.ndarray, dist: np.ndarray, m: int) -> np.ndarray:
    """Of candidates, nearest first, up to m that are nearer to the vector than to one chosen before; then the nearest others."""
    b, k = ids.shape
    v = x[np.maximum(ids, 0)]
    sq = (v * v).sum(2)
    gap = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros((b, k), bool)
    near = np.full((b, k), np.inf, np.float32)  # distance of each candidate to the nearest chosen one
    count = np.zeros(b, int)
    for j in range(k):
        take = (ids[:, j] >= 0) & (count < m) & (dist[:, j] < near[:, j])
        chosen[:, j] = take
        count += take
        near = np.where(take[:, None], np.minimum(near, gap[:, :, j]), near)
    rank = np.where(ids < 0, 3, np.where(chosen, 0, 1))
    order = np.argsort(rank, 1, kind="stable")[:, :m]
    out = np.take_along_axis(ids, order, 1)
    if out.shape[1] < m:
        out = np.hstack([out, np.full((b, m - out.shape[1]), -1)])
    return out


def _link_back(x: np.ndarray, table: np.ndarray, new: np.ndarray) -> None:
    """Add each new vector to the lists of its neighbours; lists that overflow are chosen anew."""
    m = table.shape[1]
    to = table[new]
    src = np.repeat(new, m)[to.ravel() >= 0]
    dst = to.ravel()[to.ravel() >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
    widest = int(count.max()) if len(count) else 0
    for a in range(0, len(nodes), 512):
        part, f, c = nodes[a : a + 512], first[a : a + 512], count[a : a + 512]
        more = np.full((len(part), widest), -1)
        slot = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        more[np.repeat(np.arange(len(part)), c), slot] = src[np.repeat(f, c) + slot]
        both = np.hstack([table[part], more])
        both = np.where(both == part[:, None], -1, both)
        both.sort(1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        dist = _distances(x, both, x[part])
        by = np.argsort(dist, 1, kind="stable")[:, : 3 * m]
        both, dist = np.take_along_axis(both, by, 1), np.take_along_axis(dist, by, 1)
        table[part] = choose(x, both, dist, m)


def build(v: np.ndarray, m: int = 16, ef: int = 64, batch: int = 256) -> Graph:
    """The graph of distinct vectors. Levels come from hashes of their numbers, so a rebuild gives the same graph."""
    x = augment(v)
    n = len(x)
    u = (splitmix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    level = np.minimum((-np.log(np.maximum(u, 1e-300)) / np.log(m)).astype(int), 8)
    order = np.argsort(-level, kind="stable")  # upper layers are complete before lower ones take their vectors
    top = int(level[order[0]])
    layers = [np.full((n, 2 * m if i == 0 else m), -1) for i in range(top + 1)]
    entry = int(order[0])
    at = 1
    while at < n:
        size = min(batch, at, n - at)
        new = order[at : at + size]
        start = np.full((size, 1), entry)
        for i in range(top, -1, -1):
            inside = level[new] >= i
            found, dist = search_layer(x, layers[i], x[new], start, ef if inside.any() else 1)
            start = found[:, :4] if found.shape[1] >= 4 else found
            start = np.where(start < 0, start[:, :1], start)
            mine = np.flatnonzero(inside)
            if not len(mine):
                continue
            own = new[mine]
            sq = (x[own] ** 2).sum(1)
            mutual = sq[:, None] + sq[None, :] - 2 * x[own] @ x[own].T
            np.fill_diagonal(mutual, np.inf)
            k = min(len(own) - 1, 2 * m)
            ids, d = found[mine], dist[mine]
            if k > 0:
                pick = np.argpartition(mutual, k - 1, 1)[:, :k]
                ids, d = np.hstack([ids, own[pick]]), np.hstack([d, np.take_along_axis(mutual, pick, 1)])
            by = np.argsort(d, 1, kind="stable")[:, :ef]
            width = layers[i].shape[1]
            layers[i][own] = choose(x, np.take_along_axis(ids, by, 1), np.take_along_axis(d, by, 1), min(m, width)) if width == m else np.hstack([choose(x, np.take_along_axis(ids, by, 1), np.take_along_axis(d, by, 1), m), np.full((len(own), width - m), -1)])
            _link_back(x, layers[i], own)
        at += size
    return Graph(x, layers, entry)


def search(g: Graph, q: np.ndarray, k: int, ef: int) -> np.ndarray:
    """Numbers of the k nearest found to each query (b x d, without the added coordinate), nearest first, -1 for none."""
    q = np.hstack([q, np.zeros((len(q), 1))]).astype(np.float32)
    start = np.full((len(q), 1), g.entry)
    for table in g.layers[:0:-1]:
        start = search_layer(g.x, table, q, start, 4, 1)[0]
        start = np.where(start < 0, start[:, :1], start)
    return search_layer(g.x, g.layers[0], q, start, max(ef, k))[0][:, :k]


def usable(v: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    good = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    return v.isNotNull() & F.forall(v, good) & F.exists(v, lambda c: F.coalesce(c, F.lit(0)) != 0)


def _least_ids(rows: DataFrame, key: list[str], id_: str, k: int) -> DataFrame:
    """For each key its k smallest ids. Groups are taken by ranges of ids first, so that no group grows with the table."""
    at = rows.select(*key, F.col(id_).alias("_id"), F.array(F.col(id_)).alias("ids"))
    for bits in (12, 24, None):
        by = key if bits is None else [*key, F.shiftright("_id", bits).alias("_r")]
        at = at.groupBy(*by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k).alias("ids"))
        at = at.select(*key, F.element_at("ids", 1).alias("_id"), "ids")
    return at.select(*key, "ids")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_: str = "vec_id", vector: str = "embedding", m: int = 16, ef: int = 128, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest found, by largest inner product in double precision, of each row where ``is_query`` holds.

    Returns query_id, rank (from 1), the neighbour's ``id_`` and score. Every usable row but the query's own is a candidate;
    ties go to the smaller id; fewer candidates give fewer rows. Vectors that are null, zero, or hold null or non-finite
    components take no part; vectors of different lengths are never compared. Equal vectors are one node of a graph and
    are named by their k + 1 smallest ids, of which no answer can hold more; vectors are told apart by 128 bits of hashes. Of
    all shards' answers a query's k + 1 best nodes are kept before their ids are listed. Ids are taken to be unique; a null id takes no part.
    """
    rows = cut(vectors.where(usable(F.col(vector)) & F.col(id_).isNotNull()).select(F.col(id_).alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("ask")).withColumn("node", F.xxhash64("v")).withColumn("twin", F.xxhash64(F.reverse("v"), F.lit("twin"))))
    same = ["node", "twin"]
    nodes = cut(rows.groupBy(*same).agg(F.first("v").alias("v"), F.max("ask").alias("ask")))
    shards = max(1, -(-nodes.count() // shard_rows))
    placed = nodes.withColumn("shard", F.pmod(F.col("node"), F.lit(shards)).cast("int")).withColumn("dim", F.size("v"))
    asked = nodes.where("ask")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = F.pmod(F.shiftright("node", 7), F.lit(blocks)).cast("int")
    def index_shard(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(same, kind="stable").reset_index(drop=True)
        graph = build(np.stack(part["v"].to_numpy()).astype(np.float32), m)
        flat = np.hstack(graph.layers).astype(np.int32)
        return part.assign(number=np.arange(len(part), dtype=np.int32), entry=graph.entry, layers=len(graph.layers), links=list(flat))

    kind = dict(vectors.dtypes)[vector]
    graphs = cut(placed.select("dim", "shard", "node", "twin", "v").groupBy("dim", "shard").applyInPandas(index_shard, f"dim int, shard int, node long, twin long, v {kind}, number int, entry int, layers int, links array<int>"))

    def answer(there: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        if not len(there) or not len(here):
            return pd.DataFrame({**{c: pd.Series(dtype="int64") for c in ("query", "query_twin", *same)}, "score": pd.Series(dtype="float64")})
        there = there.sort_values("number", kind="stable")
        v, q = np.stack(there["v"].to_numpy()), np.stack(here["v"].to_numpy())
        flat, entry, count = np.stack(there["links"].to_numpy()).astype(np.int64), int(there["entry"].iloc[0]), int(there["layers"].iloc[0])
        graph = Graph(augment(v), np.split(flat, [2 * m + i * m for i in range(count - 1)], axis=1), entry)
        nodes_, asked_, out = there[same].to_numpy(), here[same].to_numpy(), []
        for a in range(0, len(q), 128):
            found = search(graph, q[a : a + 128].astype(np.float32), k + 1, ef)
            hit = found >= 0
            score = np.einsum("bkd,bd->bk", v[np.maximum(found, 0)].astype(np.float64), q[a : a + 128].astype(np.float64))
            by, near = asked_[a : a + 128][np.nonzero(hit)[0]], nodes_[found[hit]]
            out.append(pd.DataFrame({"query": by[:, 0], "query_twin": by[:, 1], "node": near[:, 0], "twin": near[:, 1], "score": score[hit]}))
        return pd.concat(out)

    index = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = asked.select(F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"), *same, "v")
    key = ["dim", "shard", "block"]
    found = index.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(answer, "query long, query_twin long, node long, twin long, score double")
    named = found.join(_least_ids(rows, same, "id", k + 1), same)
    asker = ["query", "query_twin"]
    # a node that k + 1 others precede, by score and least id, can name no answer
    first = F.row_number().over(Window.partitionBy(*asker).orderBy(F.col("score").desc(), F.element_at("ids", 1)))
    near = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("less"), i.alias("id"))).alias("near")
    best = named.withColumn("_first", first).where(F.col("_first") <= k + 1).select(*asker, near)
    best = best.groupBy(*asker).agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    who = rows.where("ask").select(F.col("id").alias("query_id"), F.col("node").alias("query"), F.col("twin").alias("query_twin"))
    own = who.join(best, asker).select("query_id", F.slice(F.filter("near", lambda s: s["id"] != F.col("query_id")), 1, k).alias("near"))
    listed = own.select("query_id", F.posexplode("near").alias("rank", "near"))
    return listed.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("near.id").alias(id_), (-F.col("near.less")).alias("score"))
