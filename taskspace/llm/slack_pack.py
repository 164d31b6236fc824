"""Packing all documents into as few sequences as can be found, by minimum bin slack over the lengths of their pieces.

What a sequence can hold depends on lengths alone, of which there are no more than the capacity. So the plan is made from the count of
pieces of each length, however many pieces there are: around the longest piece left, a bitset of the sums that the other lengths can
reach finds the fullest combination, which is taken out as often as the counts allow. Pieces are numbered within their length and find
their sequence and place in the plan by that number.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored

#: Ends a document.
END = 1
#: Different words whose ids a worker keeps, some 200 MB.
KEPT_WORDS = 1 << 20
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long"


def fullest(counts: list[int], lengths: list[int], room: int) -> dict[int, int]:
    """How many of each length fill ``room`` best; of combinations as full, one with longer lengths. ``lengths`` fall and have counts."""
    usable = [x for x in lengths if x <= room]
    mask = (1 << (room + 1)) - 1
    reach, stages = 1, [1]
    for k, x in enumerate(usable):
        left, step = min(counts[x], room // x), 1
        while left:
            many = min(step, left)
            reach |= (reach << (x * many)) & mask
            left -= many
            step *= 2
        stages.append(reach)
        if reach >> room & 1:
            usable = usable[: k + 1]
            break
    total, found = reach.bit_length() - 1, {}
    for k in range(len(usable) - 1, -1, -1):
        x = usable[k]
        while not stages[k] >> total & 1:
            found[x] = found.get(x, 0) + 1
            total -= x
    return found


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how many sequences, how many pieces of each length in one of them), until no piece is left. Each entry uses up a length at least
    down to less than one sequence takes, so the plan's size is bounded by the lengths and not by the pieces."""
    left = [0] * (capacity + 1)
    for x, n in counts.items():
        left[x] = n
    lengths = [x for x in range(capacity, 0, -1) if left[x]]
    out = []
    while lengths:
        longest = lengths[0]
        left[longest] -= 1
        held = fullest(left, [x for x in lengths if left[x]] if not left[longest] else lengths, capacity - longest)
        left[longest] += 1
        held[longest] = held.get(longest, 0) + 1
        times = min(left[x] // n for x, n in held.items())
        for x, n in held.items():
            left[x] -= n * times
        out.append((times, held))
        lengths = [x for x in lengths if left[x]]
    return out


class Places:
    """Sequence and offset of the nth piece of a length, as a plan has them."""

    def __init__(self, made: list[tuple[int, dict[int, int]]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for times, held in made:
            offset = 0
            for x in sorted(held, reverse=True):
                first = used.get(x, 0)
                rows.setdefault(x, []).append((first, held[x], sequence, offset))
                used[x] = first + held[x] * times
                offset += x * held[x]
            sequence += times
        self.rows = {x: np.array(r, np.int64).T for x, r in rows.items()}
        self.sequences = sequence

    def find(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(nth), np.int64), np.empty(len(nth), np.int64)
        order = np.argsort(length, kind="stable")
        edges = np.flatnonzero(np.diff(length[order], prepend=-1))
        for a, z in zip(edges, [*edges[1:], len(order)], strict=True):
            at = order[a:z]
            x = int(length[at[0]])
            first, each, base, start = self.rows[x]
            k = np.searchsorted(first, nth[at], "right") - 1
            past = nth[at] - first[k]
            sequence[at] = base[k] + past // each[k]
            offset[at] = start[k] + past % each[k] * x
        return sequence, offset


_STOP = re.compile("(?<=[A-Za-z])([.,])(?= )")
#: Of the worker: a vocabulary's content, and its ids_of. Words that one task has met need no look at them in the next.
_last: list = [None, None]


def ids_of(vocabulary: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids as little-endian unsigned 32-bit bytes, without the end.

    The vocabulary's pre-tokeniser drops white space, never reaches across it, and ends a run of letters before a stop. So ids are
    looked up for each stretch between spaces, tabs, line ends and such stops, once for every stretch that is kept. Words of ASCII
    letters pass its normaliser and pre-tokeniser as their small letters and go to its model at once.
    """
    if _last[0] == vocabulary:
        return _last[1]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    model = tokenizer.model
    kept: dict[str, bytes] = {"": b""}

    def learn(words: set[str]) -> None:
        if len(kept) + len(words) > KEPT_WORDS:
            kept.clear()
            kept[""] = b""
        plain = [w for w in words if w.isascii() and w.isalpha()]
        for w in plain:
            ids = [t.id for t in model.tokenize(w.lower())]
            kept[w] = struct.pack(f"<{len(ids)}I", *ids)
        other = [w for w in words if w not in kept]
        for a in range(0, len(other), 4096):
            for w, e in zip(other[a : a + 4096], tokenizer.encode_batch_fast(other[a : a + 4096], add_special_tokens=False), strict=True):
                kept[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def of(texts: list[str]) -> list[bytes]:
        split = [_STOP.sub(r" \1", t.replace("\n", " ").replace("\t", " ").replace("\r", " ")).split(" ") for t in texts]
        found = [list(map(kept.get, s)) for s in split]
        gaps = [[k for k, x in enumerate(f) if x is None] if None in f else [] for f in found]
        learn({s[k] for s, g in zip(split, gaps, strict=True) for k in g})
        for s, f, g in zip(split, found, gaps, strict=True):
            for k in g:
                f[k] = kept[s[k]]
        return list(map(b"".join, found))

    _last[:] = vocabulary, of
    return of


def pieces(docs: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, and the task's number and the piece's number among those of
    its length there. ``vocabulary`` is the content of a tokenizer's JSON file; a few MB."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        of, task = ids_of(shared.value), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                out: list[tuple] = []
                for doc_id, ids in zip(part["doc_id"].to_pylist(), of([t or "" for t in part["text"].to_pylist()]), strict=True):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[a : a + 4 * capacity]
                        n = len(own) // 4
                        out.append((doc_id, k, a // 4, n, zlib.crc32(own), task, int(seen[n])))
                        seen[n] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECES)


def read_vocabulary(spark, path: str) -> str:
    """A tokenizer's JSON file, on any store that Spark reads; at most a few MB."""
    return spark.read.text(path, wholetext=True).first()[0]


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096) -> DataFrame:
    """Where each piece of docs (doc_id, text) goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of its whole text and then END; a null or empty text has END alone. Only documents longer than
    ``capacity`` are cut, into full pieces (numbered from 0, with ``start`` of their ids before) and a rest, so joining the pieces of a
    document gives back its ids. Sequences are numbered from 0 and filled from offset 0 without a gap. Rows that repeat an id or a
    text, or have no id, are packed each; other columns are not read. An empty table gives no row.

    Pieces are written once to the shared folder. Their counts a length (``capacity`` numbers at most) make the plan on the driver;
    counts a task and length, summed up in order, number the pieces of a length without any task holding a length.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = docs.sparkSession
    made = Stored(pieces(docs, vocabulary, capacity)).df
    counts = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    places = Places(plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    shared = spark.sparkContext.broadcast(places)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                nth = b["nth"].to_numpy() + b["before"].to_numpy()
                sequence, offset = shared.value.find(b["length"].to_numpy(), nth)
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["piece"], b["start"], b["length"].cast(pa.int64()), b["ids_crc32"], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    so_far = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    before = counts.select(F.col("task").alias("t"), F.col("length").alias("l"), so_far.alias("before"))
    numbered = made.join(before, (F.col("task") == F.col("t")) & (F.col("length") == F.col("l"))).drop("t", "l")
    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
