"""Benchmark decontamination by greedy string tiling.

Test items and documents share seeds (runs of ``min_match`` words); for each such pair the longest non-overlapping common
runs are marked, longest first, found by running Karp-Rabin hashes; a document is contaminated where the marked runs cover
at least ``threshold`` of an item's words, in whatever order they come.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import multipliers, shingles, splitmix, utf8, word_hashes

#: Words of items that go to the tasks in one block; larger benchmarks take several blocks, each over all documents.
BLOCK_WORDS = 500_000


def running_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``size`` words, modulo 2^64: each follows from the last by one word in, one out."""
    base = int(multipliers(64)[63])
    powers = np.empty(len(words) + 1, np.uint64)
    powers[0] = 1
    powers[1:] = np.uint64(base)
    powers = np.multiply.accumulate(powers)
    inverse = np.full(len(words) + 1, pow(base, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[:-1], dtype=np.uint64)])
    return splitmix((total[size:] - total[:-size]) * inverse[: len(words) - size + 1])


def tiles(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, words): maximal common runs, longest first, that overlap in neither text."""
    doc_free, item_free = np.ones(len(doc), bool), np.ones(len(item), bool)
    found: list[tuple[int, int, int]] = []
    size = min(len(doc), len(item))
    while size >= min_match:
        where = defaultdict(list)
        item_run = np.flatnonzero(np.convolve(item_free, np.ones(size, int), "valid") == size)
        for i, h in zip(item_run, running_hashes(item, size)[item_run], strict=True):
            where[int(h)].append(int(i))
        doc_run = np.flatnonzero(np.convolve(doc_free, np.ones(size, int), "valid") == size) if where else []
        if len(doc_run):
            hashes = running_hashes(doc, size)[doc_run]
            keep = np.isin(hashes, np.array(list(where), np.uint64))
            for d, h in zip(doc_run[keep], hashes[keep], strict=True):
                for i in where[int(h)]:
                    if doc_free[d : d + size].all() and item_free[i : i + size].all() and (doc[d : d + size] == item[i : i + size]).all():
                        doc_free[d : d + size] = item_free[i : i + size] = False
                        found.append((int(d), i, size))
                        break
        size = _next_size(doc, item, doc_free, item_free, size - 1, min_match)
    return found


def _next_size(doc: np.ndarray, item: np.ndarray, doc_free: np.ndarray, item_free: np.ndarray, most: int, least: int) -> int:
    """The longest free common run of at most ``most`` words, by bisection over sizes; below ``least`` if there is none.

    A common run of a size contains common runs of all smaller sizes, so bisection is exact.
    """

    def common(size: int) -> bool:
        if size > min(len(doc), len(item)):
            return False
        a = running_hashes(doc, size)[np.convolve(doc_free, np.ones(size, int), "valid") == size]
        b = running_hashes(item, size)[np.convolve(item_free, np.ones(size, int), "valid") == size]
        return bool(np.isin(b, a).any())

    low, high = least - 1, most
    while low < high:
        mid = (low + high + 1) // 2
        if common(mid):
            low = mid
        else:
            high = mid - 1
    return low


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items as word hashes, in blocks of BLOCK_WORDS words (a longer item is a block of its own), read one after another."""
    block: list[tuple[int, np.ndarray]] = []
    held = 0
    for row in items.select("item_id", "text").where("item_id is not null").toLocalIterator():
        words = word_hashes(utf8([row["text"]]))[0]
        if block and held + len(words) > BLOCK_WORDS:
            yield block
            block, held = [], 0
        if len(words):
            block.append((row["item_id"], words))
            held += len(words)
    if block:
        yield block


def _matcher(shared, threshold: float, min_match: int):
    """The function that finds the items of one block in texts."""

    @F.pandas_udf("array<struct<item_id: long, words: int, covered: int, coverage: double>>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        block_, keys, owners, sizes = shared.value
        for part in parts:
            out = []
            texts = utf8(part)
            for first in range(0, len(texts), 256):
                for words in word_hashes(texts[first : first + 256]):
                    near: set[int] = set()
                    for size in sizes:
                        if len(words) >= size:
                            h = np.unique(shingles(words, size))
                            at = np.searchsorted(keys, h)
                            hit = h[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == h)]
                            for x in hit:
                                near.update(owners[np.searchsorted(keys, x) : np.searchsorted(keys, x, "right")].tolist())
                    rows = []
                    for i in sorted(near):
                        item_id, item = block_[i]
                        covered = sum(t[2] for t in tiles(words, item, min(min_match, len(item))))
                        if covered >= threshold * len(item):
                            rows.append({"item_id": item_id, "words": len(item), "covered": covered, "coverage": covered / len(item)})
                    out.append(rows)
            yield pd.Series(out)

    return of


def contaminated_by(docs: DataFrame, items: DataFrame, threshold: float = 0.5, min_match: int = 5, text: str = "text") -> Column | None:
    """A column of docs, array<struct<item_id, words, covered, coverage>>: the items that the whole text contains."""
    spark, column = docs.sparkSession, None
    for block in _blocks(items):
        seeds: list[np.ndarray] = []
        for _, words in block:
            seeds.append(shingles(words, min(min_match, len(words))))
        owner = np.repeat(np.arange(len(block)), [len(s) for s in seeds])
        flat = np.concatenate(seeds)
        order = np.argsort(flat, kind="stable")
        short = sorted({min(min_match, len(words)) for _, words in block})
        shared = spark.sparkContext.broadcast((block, flat[order], owner[order], short))

        found = _matcher(shared, threshold, min_match)(F.col(text))
        column = found if column is None else F.concat(column, found)
    return column


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.5, min_match: int = 5) -> DataFrame:
    """Add ``items`` (array of item_id, words, covered, coverage) and ``contaminated`` (any item) to docs.

    Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased. Null or empty texts and texts without a common seed have no items;
    items without a word, or with a null id, match nothing; items shorter than ``min_match`` words must occur whole;
    repeated items each count. Documents stay in their tasks: nothing is shuffled.
    """
    found = contaminated_by(docs, items, threshold, min_match)
    none = F.array().cast("array<struct<item_id: long, words: int, covered: int, coverage: double>>")
    out = docs.drop("items", "contaminated").withColumn("items", none if found is None else found)
    return out.withColumn("contaminated", F.size("items") > 0)
