"""Exact substring deduplication of bytes with a sampled, range-partitioned suffix sort.

A byte is removed if a ``length``-byte string over it also starts earlier (in a smaller document, or before in the same
one). Only windows that can repeat become suffixes:

1. Every window of ``length`` bytes names the least of its ``seed``-byte hashes as its anchor; equal windows name equal
   anchors. Runs of windows with one anchor form a block, of 35 windows or so.
2. Blocks whose anchor's hash occurs once hold no repeated window. Of blocks with equal bytes all but the first are
   repeated as a whole. What is left are the first blocks of their bytes whose anchor also occurs in blocks of other bytes.
3. Their windows are the suffixes. Sampled splitters range-partition them by leading bytes (those of their anchor, which
   equal windows share, so that a block moves once), each bucket is put in order by multikey quicksort, bytes before place,
   and a window equal to the one before it also starts earlier. Windows around an anchor that more than ``CROWD``
   different blocks share are range-partitioned one by one, by bytes and place; there the first of a bucket is compared
   with the end of the bucket before.

Places order windows after their bytes, so a string that a third of all documents hold is spread over as many buckets as
it fills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest as digest64

from .common import Stored, cut, multipliers, splitmix, utf8, utf8_each

LENGTH, SEED = 100, 32


def seed_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of ``seed`` bytes."""
    m = multipliers(64)
    value = splitmix(np.arange(256, dtype=np.uint64) + np.uint64(1))[data]
    # doubling: the hash of 2k bytes from those of its halves
    h, k, total, done = value, 1, None, 0
    while k <= seed:
        if seed & k:
            part = h[done : done + len(data) - seed + 1]
            total = part * m[k & 31] if total is None else total * m[33] + part * m[k & 31]
            done += k
        if k * 2 <= seed:
            h = h[: len(h) - k] * m[40] + h[k:] * m[41]
            h ^= h >> np.uint64(29)
        k *= 2
    return splitmix(total)


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """The first position of the least (in its upper 40 bits) of each run of ``width`` hashes.

    Positions ride in the lower 24 bits, so that one minimum finds both; long texts go in overlapping pieces.
    """
    most = 1 << 24
    if len(h) > most:
        pieces = [sliding_argmin(h[a : a + most], width) + a for a in range(0, len(h) - width + 1, most - width + 1)]
        return np.concatenate(pieces)
    least = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    return (least & np.uint64(0xFFFFFF)).astype(np.int64)


def blocks(data: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, first window, windows, anchor's offset from the first window) of the blocks of a text."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    h = seed_hashes(data, seed)
    at = sliding_argmin(h, length - seed + 1)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    count = np.diff(np.append(first, len(at)))
    return h[at[first]], first, count, at[first] - first


def _text_blocks(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """Rows of blocks: anchor, doc_id, sub, at (first << 16 | the anchor's offset << 8 | windows), digest of (bytes, anchor's offset)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: list[list[np.ndarray]] = [[], [], [], [], []]
            rows = 0
            for doc_id, sub, raw in zip(batch["doc_id"], batch["sub"], utf8_each(batch["text"]), strict=True):
                anchor, first, count, offset = blocks(np.frombuffer(raw, np.uint8), length, seed)
                if not len(anchor):
                    continue
                held[0].append(anchor.view(np.int64))
                held[1].append(np.full(len(anchor), doc_id, np.int64))
                held[2].append(np.full(len(anchor), sub, np.int64))
                held[3].append(first << 16 | offset << 8 | count)
                ends = (first + count + length - 1).tolist()
                held[4].append(np.array([digest64(raw[i:j], seed=k) for i, j, k in zip(first.tolist(), ends, offset.tolist(), strict=True)], np.uint64).view(np.int64))
                rows += len(anchor)
                if rows > 100_000:
                    yield pd.DataFrame({n: np.concatenate(h) for n, h in zip(names, held, strict=True)})
                    held, rows = [[], [], [], [], []], 0
            if rows:
                yield pd.DataFrame({n: np.concatenate(h) for n, h in zip(names, held, strict=True)})

    names = ["anchor", "doc_id", "sub", "at", "digest"]
    return texts.mapInPandas(run, ", ".join(f"{n} long" for n in names))


def multikey_quicksort(keys: np.ndarray, order: np.ndarray | None = None, depth: int = 0) -> np.ndarray:
    """Row numbers of ``keys`` (n x words of big-endian uint64) in lexicographic order, stable.

    Three-way: rows are split by one word around a pivot into less, equal and greater; the equal part goes on with the
    next word. Small parts are ordered by a stable sort of their remaining words. Iterative, so depth has no limit.
    """
    n, width = keys.shape
    order = np.arange(n) if order is None else order
    out, at = np.empty(n, np.int64), 0
    stack = [(order, depth)]
    while stack:
        part, d = stack.pop()
        if len(part) <= 1 or d == width:
            out[at : at + len(part)] = part
            at += len(part)
            continue
        if len(part) <= 4096:
            rest = keys[part, d:]
            part = part[np.lexsort(rest.T[::-1])]
            out[at : at + len(part)] = part
            at += len(part)
            continue
        word = keys[part, d]
        sample = np.sort(word[:: max(1, len(word) // 101)])
        pivot = sample[len(sample) // 2]
        stack.append((part[word > pivot], d))
        stack.append((part[word == pivot], d + 1))
        stack.append((part[word < pivot], d))
    return out


def _sorted_buckets(ranged: DataFrame, length: int) -> DataFrame:
    """Order the suffixes of each bucket, a partition of rows (bytes, doc_id, sub, at) that stand for the suffixes at ``at``
    and on, as many as bytes has windows. One row a suffix that equals the one before it in its bucket (kind 0), and the
    bucket's first (1) and last (2) suffix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        raw = rows["bytes"].to_numpy()
        count = np.array([len(b) - length + 1 for b in raw])
        owner = np.repeat(np.arange(len(rows)), count)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        doc, sub, at = (rows[c].to_numpy()[owner] for c in ("doc_id", "sub", "at"))
        at = at + step
        flat = np.frombuffer(b"".join(raw), np.uint8)
        where = np.repeat(np.cumsum(count + length - 1) - (count + length - 1), count) + step
        place = np.lexsort([at, sub, doc])
        wide = -(-length // 8) * 8
        view = np.zeros((len(place), wide), np.uint8)
        view[:, :length] = np.lib.stride_tricks.sliding_window_view(flat, length)[where[place]]
        keys = view.view(">u8").astype(np.uint64)
        order = multikey_quicksort(keys)
        keys, place = keys[order], place[order]
        same = np.flatnonzero((keys[1:] == keys[:-1]).all(1)) + 1
        bucket = TaskContext.get().partitionId()
        for kind, i in ((0, place[same]), (1, place[:1]), (2, place[-1:])):
            window = [flat[w : w + length].tobytes() for w in where[i]] if kind else None
            yield pd.DataFrame({"kind": kind, "bucket": bucket, "doc_id": doc[i], "sub": sub[i], "at": at[i], "window": window})

    return ranged.select("bytes", "doc_id", "sub", "at").mapInPandas(run, "kind int, bucket int, doc_id long, sub long, at int, window binary")


#: Suffixes in a bucket, about.
BUCKET = 100_000
#: Anchors with more different blocks than this have their windows partitioned one by one.
CROWD = 1000
#: Buckets whose ends meet in one task.
ENDS = 1 << 14


def _repeated(rows: DataFrame) -> Stored:
    """anchor, n: the anchors of more than one row, with their numbers of rows. They are written, so that the join back to the rows
    is between plain shuffles, of which adaptive execution splits the partition of an anchor that a third of all rows name."""
    return Stored(rows.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), release=True)


def _across(ends: DataFrame) -> DataFrame:
    """Add ``previous``, the tail of the bucket before that has any, to rows (bucket, head, tail), of ENDS buckets at a time:
    only the last tail of each such run of buckets is ordered in one task."""
    runs = ends.withColumn("run", F.floor(F.col("bucket") / ENDS))
    last = runs.groupBy("run").agg(F.max_by("tail", "bucket").alias("tail"))
    before = last.select("run", F.lag("tail").over(Window.orderBy("run")).alias("earlier"))
    inside = F.lag("tail").over(Window.partitionBy("run").orderBy("bucket"))
    return runs.withColumn("inside", inside).join(before, "run").withColumn("previous", F.coalesce("inside", "earlier"))


def _edge_bytes(texts: DataFrame, edges: DataFrame, length: int, seed: int) -> DataFrame:
    """The bytes of blocks: crowd, lead (the anchor's own bytes), bytes, doc_id, sub, at."""
    wanted = edges.groupBy("doc_id", "sub").agg(F.collect_list(F.struct("at", "crowd")).alias("edges"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["crowd", "lead", "bytes", "doc_id", "sub", "at"]
        for batch in batches:
            held: list[tuple] = []
            for doc_id, sub, raw, found in zip(batch["doc_id"], batch["sub"], utf8_each(batch["text"]), batch["edges"], strict=True):
                for e in found:
                    first, offset, windows = e["at"] >> 16, e["at"] >> 8 & 0xFF, e["at"] & 0xFF
                    held.append((e["crowd"], raw[first + offset : first + offset + seed], raw[first : first + windows + length - 1], doc_id, sub, first))
                if len(held) > 20_000:
                    yield pd.DataFrame(held, columns=cols)
                    held = []
            yield pd.DataFrame(held, columns=cols)

    return texts.join(wanted, ["doc_id", "sub"]).mapInPandas(run, "crowd boolean, lead binary, bytes binary, doc_id long, sub long, at int")


def repeated_windows(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """(doc_id, sub, first, windows): runs of windows that also start earlier, of texts (doc_id, sub, text)."""
    if length - seed + 1 > 255:
        raise ValueError("length may exceed seed by 254 bytes at most")
    every = Stored(_text_blocks(texts, length, seed))
    often = _repeated(every.df)
    kept = Stored(every.df.join(often.df.select("anchor").hint("shuffle_hash"), "anchor"), release=True)
    often.drop()
    again = kept.df
    every.drop()
    by_bytes = Stored(again.groupBy("anchor", "digest").agg(F.min(F.struct("doc_id", "sub", "at")).alias("rep"), F.count("*").alias("n")), release=True)
    twice = by_bytes.df.where("n > 1").select("anchor", "digest", "rep")
    copies = again.join(twice, ["anchor", "digest"]).where(~F.struct("doc_id", "sub", "at").eqNullSafe(F.col("rep"))).select("doc_id", "sub", "at")
    several = _repeated(by_bytes.df)
    edges = by_bytes.df.join(several.df.select("anchor", (F.col("n") > CROWD).alias("crowd")), "anchor").select("rep.*", "crowd")
    near = Stored(_edge_bytes(texts, edges, length, seed), release=True)
    several.drop()
    wanted = near.df
    # windows of equal bytes share the bytes of their anchor, so a bucket of whole leads needs no neighbour
    sizes = {r["crowd"]: r["count"] for r in wanted.groupBy("crowd").count().collect()}
    calm = wanted.where("not crowd")
    n = max(8, sizes.get(False, 0) * (length - seed) // 2 // BUCKET)
    alone = _sorted_buckets(calm.repartitionByRange(n, "lead"), length).where("kind = 0")
    # many blocks around one anchor: each window goes by its own bytes and place, and buckets meet at their ends
    place = lambda i: F.struct(F.substring("bytes", i + 1, F.lit(length)).alias("bytes"), (F.col("at") + i).cast("int").alias("at"))
    each = wanted.where("crowd").select("doc_id", "sub", F.explode(F.transform(F.sequence(F.lit(0), F.octet_length("bytes") - length), place)).alias("w")).select("w.bytes", "doc_id", "sub", "w.at")
    names = ["doc_id", "sub", "at"]
    found = alone.select(names)
    if sizes.get(True):
        m = max(8, sizes[True] * (length - seed) // 2 // BUCKET)
        ordered = cut(_sorted_buckets(each.repartitionByRange(m, "bytes", "doc_id", "sub", "at"), length))
        # one row a bucket: a bucket's first suffix against the last of the bucket before it that has any
        head, tail = F.when(F.col("kind") == 1, F.struct("window", "doc_id", "sub", "at")), F.when(F.col("kind") == 2, F.col("window"))
        ends = ordered.where("kind > 0").groupBy("bucket").agg(F.max(head).alias("head"), F.max(tail).alias("tail"))
        across = _across(ends).where("previous = head.window").select("head.doc_id", "head.sub", "head.at")
        found = found.union(ordered.where("kind = 0").select(names)).union(across)
    single = found.select("doc_id", "sub", F.col("at").alias("first"), F.lit(1).alias("windows"))
    runs = copies.select("doc_id", "sub", F.shiftright("at", 16).cast("int").alias("first"), F.col("at").bitwiseAND(F.lit(0xFF)).cast("int").alias("windows"))
    out = cut(runs.union(single), release=True)
    for stored in (kept, by_bytes, near):
        stored.drop()
    return out


def covered(first: np.ndarray, windows: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal (from, to) byte runs under windows of ``length`` bytes that start in the given runs."""
    out: list[tuple[int, int]] = []
    for i in np.argsort(first, kind="stable"):
        a, z = int(first[i]), int(first[i] + windows[i] - 1 + length)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def with_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, text, ``spans`` of every row of docs: array<struct<from, to>>, the byte runs to remove, maximal and in order.

    Null texts count as empty; texts shorter than ``length`` bytes have no spans. A null doc_id comes before all others.
    Rows that repeat a doc_id with different texts come in the order of a hash of their bytes; exact repeats of a row
    start at the same place, so neither starts earlier, and both get the same spans.
    """
    keyed = docs.select("doc_id", "text").withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    ids = docs.select("doc_id")
    unique = ids.agg(F.count("*") == F.count_distinct("doc_id")).first()[0]
    keyed = keyed.withColumn("_sub", F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = keyed.select(F.col("_id").alias("doc_id"), F.col("_sub").alias("sub"), "text")
    if not unique:  # exact repeats of a row are one text
        texts = texts.dropDuplicates(["doc_id", "sub"])
    runs = repeated_windows(texts, length, seed).groupBy("doc_id", "sub").agg(F.collect_list(F.struct("first", "windows")).alias("runs"))

    @F.pandas_udf("array<struct<from: int, to: int>>")
    def merged(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([covered(np.array([r["first"] for r in runs_]), np.array([r["windows"] for r in runs_]), length) if runs_ is not None else [] for runs_ in part], dtype=object).map(lambda spans: [{"from": a, "to": z} for a, z in spans])

    spans = runs.select(F.col("doc_id").alias("_d"), F.col("sub").alias("_s"), merged("runs").alias("spans"))
    joined = keyed.join(spans, (F.col("_id") == F.col("_d")) & (F.col("_sub") == F.col("_s")), "left")
    return joined.select("doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<from: int, to: int>>")).alias("spans"))


def kept_bytes(raw: bytes, spans) -> bytes:
    """What is left of a text without its spans."""
    at, out = 0, []
    for s in spans:
        out.append(raw[at : s["from"]])
        at = s["to"]
    return b"".join([*out, raw[at:]])


def digests(spanned: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of rows of (doc_id, text, spans)."""

    @F.pandas_udf("string")
    def sha(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256(kept_bytes(t, s)).hexdigest() for t, s in zip(utf8(text), spans, strict=True)])

    text = F.coalesce("text", F.lit(""))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["to"] - s["from"]))
    return spanned.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), sha("text", "spans").alias("kept_sha256"))
