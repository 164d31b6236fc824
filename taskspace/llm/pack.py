"""Token ids in packed binary rows: best-fit-decreasing with a segment tree over remaining capacities.

Each task packs its own documents, in windows of a bounded number of tokens, so nothing is shuffled and memory is bounded.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import giving_back

#: Fixed value: the published pre-tokenisation pattern of the byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens that a task holds before it packs them.
HELD_TOKENS = 2_000_000


def read_ranks(spark, path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken vocabulary file (base64 token, space, rank a line), on any store that Spark reads; at most a few MB."""
    raw = spark.read.text(path, wholetext=True).first()[0].encode()
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


class Tree:
    """Segment tree over capacities 0..size: finds the smallest capacity of at least a need that some bin still has."""

    def __init__(self, size: int):
        self.leaves = 1 << max(1, (size + 1 - 1).bit_length())
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, bin_: int) -> None:
        self.bins[capacity].append(bin_)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, bin) of the tightest fit, removed from the tree; None if nothing fits."""
        i = need + self.leaves
        if need >= self.leaves:
            return None
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        bin_ = self.bins[capacity].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, bin_


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers; every size is 1 to capacity. Items go longest first (ties in order), each into the fullest bin that holds it."""
    tree, bins = Tree(capacity), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = tree.take(size)
        if found is None:
            room, b = capacity, len(bins)
            bins.append([])
        else:
            room, b = found
        bins[b].append(i)
        if room > size:
            tree.add(room - size, b)
    return bins


def pack(docs: DataFrame, ranks: dict[bytes, int], pattern: str, length: int = 2048, pad: int | None = None) -> DataFrame:
    """Packed rows of docs (doc_id, text).

    Returns shard and row (the task's number and its row's, from 0), ``ids`` (``length`` little-endian unsigned integers of
    ``id_bytes`` bytes, 2 where all ids fit and else 4, padded with ``pad``, by default the first free id), n_tokens (without padding), ``cu_seqlens`` (0 and the cumulative lengths of the
    row's segments), ``resets`` (for each segment the position id of its first token: 0, or where a split document goes on),
    ``doc_ids`` and ``parts`` (the segment's document and its number in it), all aligned. Position ids follow: see
    :func:`positions`. A document longer than ``length`` tokens is split into full pieces and a rest: joining the pieces of
    a document by part gives back its ids. Null and empty texts have no token and no segment. Rows that repeat a doc_id are
    packed each.
    """
    if length < 1:
        raise ValueError("length must be at least 1")
    fill = max(ranks.values(), default=-1) + 1 if pad is None else pad
    kind = "<u2" if max(fill, *ranks.values(), 0) < 1 << 16 else "<u4"
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks_, pattern_ = shared.value
        encode = tiktoken.Encoding("vocabulary", pat_str=pattern_, mergeable_ranks=ranks_, special_tokens={})._core_bpe.encode_ordinary
        shard, row = TaskContext.get().partitionId(), 0

        def packed(pieces: list[tuple]) -> pd.DataFrame:
            nonlocal row
            sizes = np.array([len(p[2]) for p in pieces])
            out = []
            for items in best_fit_decreasing(sizes, length):
                ids = np.full(length, fill, kind)
                cu = np.concatenate([[0], np.cumsum(sizes[items])])
                for i, a in zip(items, cu, strict=False):
                    ids[a : a + len(pieces[i][2])] = pieces[i][2]
                out.append((shard, row, ids.tobytes(), int(kind[2]), int(cu[-1]), cu.tolist(), [pieces[i][3] for i in items], [pieces[i][0] for i in items], [pieces[i][1] for i in items]))
                row += 1
            return pd.DataFrame(out, columns=["shard", "row", "ids", "id_bytes", "n_tokens", "cu_seqlens", "resets", "doc_ids", "parts"])

        held: list[tuple] = []
        tokens = 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if not isinstance(text, str) or not text:
                    continue
                ids = np.array(encode(text), kind)
                held += [(None if doc_id is None else int(doc_id), k, ids[a : a + length], a) for k, a in enumerate(range(0, len(ids), length))]
                tokens += len(ids)
                if tokens >= HELD_TOKENS:
                    yield packed(held)
                    held, tokens = [], 0
        if held:
            yield packed(held)

    schema = "shard int, row long, ids binary, id_bytes int, n_tokens int, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, parts array<int>"
    return docs.select(docs["doc_id"].cast("string"), "text").mapInPandas(giving_back(run), schema)


def positions(cu_seqlens, resets, length: int) -> np.ndarray:
    """Position ids of a packed row: each segment counts up from its reset; padding is 0."""
    out = np.zeros(length, np.int64)
    for a, z, r in zip(cu_seqlens[:-1], cu_seqlens[1:], resets, strict=True):
        out[a:z] = np.arange(r, r + z - a)
    return out
