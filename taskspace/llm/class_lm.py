"""Brown class-based bigram language model: exchange clustering, class transitions, word emissions.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased, and one end after them. Every word that occurs
``least`` times in training has a class. The ``vocab`` most frequent words, the core, are clustered by exchange on the driver
(its input is bounded by vocab squared). Then each other word goes to the class that raises the bigram likelihood most to
first order, by its pair counts with the classes of its neighbours: the ``lexicon`` most frequent ones in passes that are
repeated with the classes so found, the rest once. Rarer words form one class of their own, which also stands for unseen
words; the end is a class as well.

The driver and the tasks hold the lexicon only, about 30 bytes a word. All other words are placed and looked up in the frame:
tasks deal their hashes, packed, to ranges, which hand class and count back to the block of texts they came from. Words outside
the lexicon are told apart by 64-bit hashes. Class transitions are counted over all training texts with all classes known.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, utf8, word_hashes

#: Distinct words that a task counts before it hands its counts on.
HELD_WORDS = 400_000
#: Tokens whose pairs are counted at once.
RUN = 1 << 20


def tokens(text: bytes) -> list[bytes]:
    """bytes.lower and bytes.split treat exactly A-Z and 0x20, 0x09-0x0D."""
    return text.lower().split()


def crc_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) of a frame with a text column, counted in tasks before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for text in utf8(batch["text"]):
                held.update(tokens(text))
                if len(held) > HELD_WORDS:
                    yield pd.DataFrame({"word": list(held), "c": list(held.values())})
                    held = Counter()
        yield pd.DataFrame({"word": pd.Series(list(held), dtype=object), "c": pd.Series(list(held.values()), dtype="int64")})

    return texts.select("text").mapInPandas(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """Words by their hashes alone. Row 0 is the end, row i the i-th of ``keys``; -1 stands for a word that is not listed."""

    def __init__(self, keys: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.row = keys[order], (order + 1).astype(np.int32)

    def __len__(self) -> int:
        return len(self.keys)

    def __contains__(self, word: bytes) -> bool:
        return bool(self.rows(word_hashes([word])[0])[0] > 0)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.row[at], np.int32(-1))


def encoded(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(ids): runs of texts as the bytes of 32-bit rows of the lexicon; each text is 0 and then its words."""
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 500):
                found = word_hashes(utf8(batch["text"].iloc[first : first + 500]))
                ends = np.cumsum([0, *[len(h) for h in found]])[:-1]
                yield pd.DataFrame({"ids": [np.insert(shared.value.rows(np.concatenate(found)), ends, 0).astype(np.int32).tobytes()]})

    return texts.select("text").mapInPandas(run, "ids binary")


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """The rows of encoded texts, with the end before the first and after the last word of each text."""
    for batch in batches:
        for ids in batch["ids"]:
            row = np.append(np.frombuffer(ids, np.int32), np.int32(0))
            for first in range(0, len(row) - 1, RUN):
                yield row[max(0, first - 1) : first + RUN + 1], min(first, 1)


def count_pairs(ids: DataFrame, of: np.ndarray, size: int) -> DataFrame:
    """(pair, c): how often ``of`` of a row i is followed by that of a row j, as i * size + j. The last entry of ``of`` is
    for unlisted words."""
    shared = ids.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, before in _runs(batches):
            to = shared.value[row[before:]].astype(np.int64)
            pairs, c = np.unique(to[:-1] * size + to[1:], return_counts=True)
            yield pd.DataFrame({"pair": pairs, "c": c.astype(np.int64)})

    return ids.mapInPandas(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))


def placing(table: np.ndarray) -> np.ndarray:
    """What a class from 2 on gains, by class pairs ``table``, for each neighbour on the right (first half) and left of a word."""
    with_one = table + 1.0 / len(table)
    logs = np.log(with_one)
    return np.concatenate([logs.T - np.log(with_one.sum(1)), logs - np.log(with_one.sum(0))])[:, 2:]


def place(ids: DataFrame, of: np.ndarray, core: int, table: np.ndarray) -> pd.DataFrame:
    """(row, class) of each listed word after the first ``core``: the class from 2 on that raises the bigram likelihood most
    to first order, given its neighbours' classes ``of`` and the class pairs ``table``. Equal ones: the first."""
    shared, k, weight = ids.sparkSession.sparkContext.broadcast(of), len(table), placing(table)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, before in _runs(batches):
            cls = shared.value[row].astype(np.int64)
            after, at = row[before:-1].astype(np.int64), np.flatnonzero(row[before:-1] > core) + before
            right = after[at - before] * (2 * k) + cls[at + 1]
            left = after[at - before] * (2 * k) + k + cls[at - 1]
            pairs, c = np.unique(np.concatenate([right, left]), return_counts=True)
            yield pd.DataFrame({"row": (pairs // (2 * k)).astype(np.int32), "slot": (pairs % (2 * k)).astype(np.int32), "c": c.astype(np.int64)})

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 2000):
                part = batch.iloc[first : first + 2000]
                seen = np.zeros((len(part), 2 * k))
                if len(part):
                    np.add.at(seen, (np.repeat(np.arange(len(part)), part["slots"].map(len)), np.concatenate(part["slots"].to_list())), np.concatenate(part["cs"].to_list()))
                    yield pd.DataFrame({"row": part["row"].to_numpy(), "class": (2 + np.argmax(seen @ weight, 1)).astype(np.int32)})

    pairs = ids.mapInPandas(count, "row int, slot int, c long").repartition("row").groupBy("row", "slot").agg(F.sum("c").alias("c"))
    return pairs.groupBy("row").agg(F.collect_list("slot").alias("slots"), F.collect_list("c").alias("cs")).mapInPandas(best, "row int, class int").toPandas()


def exchange(pairs: np.ndarray, counts: np.ndarray, size: int, classes: int, sweeps: int = 3) -> np.ndarray:
    """Class of each id. 0 (end) and 1 (other words) keep classes 0 and 1; ids from 2 on, most frequent first, start
    in class 2 + i mod (classes - 2) and move, one by one, to the class that raises the bigram likelihood most."""
    small = np.int16 if size < 1 << 15 else np.int32
    cls = np.concatenate([[0, 1], 2 + np.arange(size - 2) % max(1, classes - 2)]).astype(np.int64)

    def neighbours(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each id the slice of its neighbours on one side, those neighbours and how often they are."""
        order = np.argsort(own, kind="stable")
        return np.searchsorted(own[order], np.arange(size + 1)), other[order], counts[order]

    left, right = (pairs // size).astype(small), (pairs % size).astype(small)
    l_from, l_other, l_count = neighbours(left, right)
    r_from, r_other, r_count = neighbours(right, left)
    table = np.bincount(cls[left] * classes + cls[right], counts, classes * classes).reshape(classes, classes)
    del left, right

    def g(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    for _ in range(sweeps):
        moved = 0
        for w in range(2, size):
            out_, in_ = slice(l_from[w], l_from[w + 1]), slice(r_from[w], r_from[w + 1])
            own = float(l_count[out_][l_other[out_] == w].sum())
            after = np.bincount(cls[l_other[out_]], l_count[out_], classes)
            before = np.bincount(cls[r_other[in_]], r_count[in_], classes)
            a = cls[w]
            after[a] -= own
            before[a] -= own
            table[a, :] -= after
            table[:, a] -= before
            table[a, a] -= own
            rows, cols = table.sum(1), table.sum(0)
            n_out, n_in = after.sum() + own, before.sum() + own
            gain = (g(table + after) - g(table)).sum(1) + (g(table.T + before) - g(table.T)).sum(1)
            d = np.diag(table)
            gain += g(d + after + before + own) - g(d + after) - g(d + before) + g(d)
            gain -= g(rows + n_out) - g(rows) + g(cols + n_in) - g(cols)
            b = 2 + int(np.argmax(gain[2:]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            cls[w] = b
            table[b, :] += after
            table[:, b] += before
            table[b, b] += own
        if not moved:
            break
    return cls


@dataclass
class Model:
    lexicon: Lexicon  #: word to row of the arrays below; 0 is the end
    cls: np.ndarray
    emit: np.ndarray  #: log10 P(word | class)
    base: np.ndarray  #: log10 of the add-one unigram
    step: np.ndarray  #: log10 P(class | class before)
    n: int
    v: int
    other_n: int  #: tokens of the words that are not listed, and how many words those are
    other_v: int
    counts: np.ndarray  #: how often each row of the arrays is
    weight: np.ndarray  #: see placing()


def _head(counts: DataFrame, most: int | None, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the words with ``least`` occurrences, by falling count. With ``most``, of the most frequent so many; of words with
    the same count those with the least hashes. The driver takes one number for each different count, one for each of 4096 ranges of
    hashes, and then no more than those words and one range."""
    held, cut, room = 0, least - 1, 0
    for r in counts.where(F.col("c") >= least).groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toLocalIterator() if most is not None else ():
        if held + r["n"] > most:
            cut, room = r["c"], most - held
            break
        held += r["n"]
    x = F.xxhash64("word")
    kept = counts.where(F.col("c") > cut).select("word", "c", F.lit(0).cast("long").alias("x"))
    if room:
        part = F.shiftrightunsigned(x.bitwiseXOR(F.lit(-(1 << 63))), 52)
        tied, border, seen = counts.where(F.col("c") == cut), -1, 0
        for r in sorted(tied.groupBy(part.alias("part")).count().collect()):
            border, seen = r["part"], seen + r["count"]
            if seen >= room:
                break
        kept = kept.union(tied.where(part <= border).select("word", "c", x))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"key": word_hashes([b" ".join(batch["word"])])[0].view(np.int64), "c": batch["c"].to_numpy(), "x": batch["x"]})

    found = kept.mapInPandas(hashed, "key long, c long, x long").toPandas()
    keys, c = found["key"].to_numpy(np.int64).view(np.uint64), found["c"].to_numpy(np.int64)
    if room:
        tied_at = np.flatnonzero(c == cut)
        over = tied_at[np.argsort(found["x"].to_numpy(np.int64)[tied_at], kind="stable")[room:]]
        keys, c = np.delete(keys, over), np.delete(c, over)
    order = np.lexsort((keys, -c))
    return keys[order], c[order]


def transitions(table: np.ndarray, strength: float = 5.0) -> np.ndarray:
    """log10 P(class | class before) from pair counts, smoothed with ``strength`` tokens dealt as all classes are."""
    prior = (table.sum(0) + 1) / (table.sum() + len(table))
    return np.log10((table + strength * prior) / (table.sum(1, keepdims=True) + strength))


def train(texts: DataFrame, counts: DataFrame, vocab: int, lexicon: int | None, classes: int, least: int = 1, passes: int = 2) -> Model:
    """Fit on ``texts`` (training documents only) and their word counts. An empty corpus gives a uniform model."""
    docs = texts.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = total[0] + docs, total[1] + (1 if docs else 0)
    keys, c = _head(counts, lexicon, least)
    listed, words = len(keys), Lexicon(keys)
    del keys
    k = min(vocab, listed)
    size = k + 2
    stored = Stored(encoded(texts, words))
    ids = stored.df
    # the end, the core from 2 on, and 1 for the others, listed or not
    core = np.ones(listed + 2, np.int32)
    core[0] = 0
    core[1 : k + 1] = np.arange(2, size)
    found = count_pairs(ids, core, size).select(F.col("pair").cast("int" if size * size < 1 << 31 else "long"), "c").toPandas()
    pairs, pc = found["pair"].to_numpy(), found["c"].to_numpy(np.int64)
    del found
    classes = max(3, min(classes, size))
    of = exchange(pairs, pc, size, classes)
    table = np.bincount(of[pairs // size] * classes + of[pairs % size], pc, classes * classes).reshape(classes, classes)
    del pairs, pc
    cls = of[core].astype(np.int16)
    for _ in range(passes if listed > k else 0):
        placed = place(ids, cls, k, table)
        cls[placed["row"].to_numpy()] = placed["class"].to_numpy()
        del placed
        again = count_pairs(ids, cls, classes).toPandas()
        table = np.bincount(again["pair"].to_numpy(np.int64), again["c"].to_numpy(np.int64), classes * classes).reshape(classes, classes)
    stored.drop()
    step = transitions(table)
    other_n, other_v = int(n - docs - c.sum()), int(v - (1 if docs else 0) - listed)
    cls = cls[:-1]
    mine = np.concatenate([[docs], c]).astype(np.float64)
    mass = np.bincount(cls, mine, classes)
    with np.errstate(divide="ignore", invalid="ignore"):
        emit = np.log10(mine / mass[cls])
    emit[0] = 0.0
    base = np.log10((mine + 1) / (n + v + 1))
    return Model(words, cls, emit, base, step, n, v, other_n, other_v, mine, placing(table))


#: Texts whose words are dealt together, their bytes unless it is one text, and bytes of text for which there is a range of hashes.
BLOCK_TEXTS, BLOCK_BYTES, RANGE_BYTES = 2000, 16 << 20, 8 << 20


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(part of the batch, word hashes of its texts one after the other, where each text ends)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        size = max(1, min(BLOCK_TEXTS, int(np.searchsorted(ends, before + BLOCK_BYTES, "right")) - first))
        part = batch.slice(first, size)
        first += size
        found = [h for a in range(0, part.num_rows, 100) for h in word_hashes(utf8(part["text"].slice(a, 100).to_pylist()))]
        yield part, np.concatenate(found), np.cumsum([len(h) for h in found])


def _by_range(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, np.ndarray]]:
    """(range, places in keys) of the ranges that have any."""
    place = (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    edges = np.flatnonzero(np.diff(place[order], prepend=-1))
    for a, z in zip(edges, np.append(edges, len(order))[1:], strict=True):
        yield int(place[order[a]]), order[a:z]


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def tail_words(texts: DataFrame, model: Model, ranges: int, least: int) -> DataFrame:
    """(range, keys, counts, cls): for each range of hashes the training words outside the lexicon, sorted, packed in arrays, with
    the class that their neighbours' classes speak for most; 1 for those below ``least``."""
    shared, k = texts.sparkSession.sparkContext.broadcast(model), model.weight.shape[0] // 2
    kinds = {"range": pa.int64(), "keys": pa.binary(), "slots": pa.binary()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for _, hashes, ends in _blocks(batch):
                rows = m.lexicon.rows(hashes)
                cls = np.where(rows >= 0, m.cls[np.maximum(rows, 0)], 1).astype(np.uint16)
                after, before = np.append(cls, np.uint16(0))[1:], np.append(np.uint16(0), cls)[:-1]
                inner = ends[(ends > 0) & (ends < len(cls))]
                after[np.append(inner, len(cls))[: len(cls)] - 1] = 0
                before[inner] = 0
                tail = np.flatnonzero(rows < 0)
                slots = np.stack([after[tail], before[tail] + np.uint16(k)], 1)
                yield _batch([(r, hashes[tail[at]].tobytes(), slots[at].tobytes()) for r, at in _by_range(hashes[tail], ranges)], kinds)

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        weight = shared.value.weight
        keys, which, c = np.unique(np.frombuffer(b"".join(part["keys"]), np.uint64), return_inverse=True, return_counts=True)
        slots = np.frombuffer(b"".join(part["slots"]), np.uint16).reshape(-1, 2).astype(np.int64)
        slots, starts = slots[np.argsort(which, kind="stable")], np.append(0, np.cumsum(c))
        cls = np.ones(len(keys), np.uint16)
        for first in range(0, len(keys), 2000):
            own = c[first : first + 2000]
            at = np.repeat(np.arange(len(own)) * 2 * k, own)[:, None] + slots[starts[first] : starts[first + len(own)]]
            seen = np.bincount(at.ravel(), minlength=len(own) * 2 * k).reshape(-1, 2 * k)
            cls[first : first + 2000] = np.where(own >= least, 2 + np.argmax(seen @ weight, 1), 1)
        return pd.DataFrame({"range": [part["range"].iat[0]], "keys": [keys.tobytes()], "counts": [c.astype(np.int64).tobytes()], "cls": [cls.tobytes()]})

    dealt = texts.select("text").mapInArrow(deal, "range long, keys binary, slots binary")
    return dealt.groupBy("range").applyInPandas(choose, "range long, keys binary, counts binary, cls binary")


RESOLVED = {"range": pa.int64(), "block": pa.int64(), "keys": pa.binary(), "at": pa.binary(), "counts": pa.binary(), "cls": pa.binary(), "ids": pa.list_(pa.string()), "held": pa.binary(), "ends": pa.binary(), "sums": pa.binary()}
CHAINS = "doc_id string, held_out boolean, n_tokens long, n_known long, base double, logs double, chain binary"


def chains(docs: DataFrame, model: Model, tail: DataFrame, ranges: int) -> DataFrame:
    """For each text the classes of its words (packed), how many tokens training knows, the base score, and the sum of log10 of
    the words' counts (and one more in the class of other words)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"{n} {'long' if t == pa.int64() else 'binary' if t == pa.binary() else 'array<string>'}" for n, t in RESOLVED.items())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, number = shared.value, TaskContext.get().partitionId() << 32
        logs = np.log10(np.maximum(m.counts, 1))
        for batch in batches:
            for part, hashes, ends in _blocks(batch):
                rows = m.lexicon.rows(hashes)
                known = rows >= 0
                cls = np.where(known, m.cls[np.maximum(rows, 0)], 1).astype(np.uint16)
                tail_at = np.flatnonzero(~known).astype(np.uint32)
                owner = np.searchsorted(ends, np.flatnonzero(known), "right")
                sums = np.stack([np.bincount(owner, x, len(ends)) for x in (None, m.base[rows[known]], logs[rows[known]])])
                own = (-1 - number, number, None, None, None, cls.tobytes(), part["doc_id"].to_pylist(), np.array(part["held_out"].to_pylist(), bool).tobytes(), ends.astype(np.int64).tobytes(), sums.astype(np.float64).tobytes())
                keys = hashes[tail_at]
                dealt = [(r, number, keys[at].tobytes(), tail_at[at].tobytes(), *[None] * 6) for r, at in _by_range(keys, ranges)]
                yield _batch([own, *dealt], RESOLVED)
                number += 1

    def look(part: pd.DataFrame) -> pd.DataFrame:
        if part["range"].iat[0] < 0:
            return part
        words, asked = part[part["block"].isna()], part[part["block"].notna()]
        keys = np.frombuffer(b"".join(words["keys"]), np.uint64)
        counts, cls = (np.append(np.frombuffer(b"".join(words[c]), t), t(x)) for c, t, x in (("counts", np.int64, 0), ("cls", np.uint16, 1)))
        out = []
        for _, r in asked.iterrows():
            mine = np.frombuffer(r["keys"], np.uint64)
            at = np.searchsorted(keys, mine)
            if len(keys):
                at = np.where(keys[np.minimum(at, len(keys) - 1)] == mine, at, len(keys))
            out.append((r["range"], r["block"], None, r["at"], counts[at].tobytes(), cls[at].tobytes(), None, None, None, None))
        return pd.DataFrame(out, columns=list(RESOLVED))

    def join(part: pd.DataFrame) -> pd.DataFrame:
        m = shared.value
        own, rest = part[part["range"] < 0].iloc[0], part[part["range"] >= 0]
        ends = np.frombuffer(own["ends"], np.int64)
        chain, sums = np.frombuffer(own["cls"], np.uint16).copy(), np.frombuffer(own["sums"], np.float64).reshape(3, -1).copy()
        at, c = np.frombuffer(b"".join(rest["at"]), np.uint32), np.frombuffer(b"".join(rest["counts"]), np.int64)
        chain[at] = np.frombuffer(b"".join(rest["cls"]), np.uint16)
        owner = np.searchsorted(ends, at, "right")
        for i, x in enumerate((c > 0, np.log10((c + 1) / (m.n + m.v + 1)), np.log10(c + (chain[at] == 1)))):
            sums[i] += np.bincount(owner, x, len(ends))
        starts = np.append(0, ends[:-1])
        packed = [chain[a:z].tobytes() for a, z in zip(starts, ends, strict=True)]
        return pd.DataFrame({"doc_id": list(own["ids"]), "held_out": np.frombuffer(own["held"], bool), "n_tokens": ends - starts + 1, "n_known": sums[0].astype(np.int64) + (m.n > 0), "base": sums[1] + m.base[0], "logs": sums[2], "chain": packed})

    dealt = docs.select(F.col("doc_id").cast("string"), "held_out", "text").mapInArrow(deal, schema)
    return dealt.unionByName(tail, allowMissingColumns=True).groupBy("range").applyInPandas(look, schema).where("block is not null").groupBy("block").applyInPandas(join, CHAINS)


def _steps(chain: bytes) -> np.ndarray:
    """The classes of a text with the end on both sides."""
    return np.concatenate([[0], np.frombuffer(chain, np.uint16), [0]]).astype(np.int64)


def class_pairs(found: DataFrame, classes: int) -> np.ndarray:
    """How often a class follows another in chains."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for first in range(0, len(batch), 500):
                row = np.concatenate([[0], *[_steps(c)[1:] for c in batch["chain"].iloc[first : first + 500]]])
                table += np.bincount(row[:-1] * classes + row[1:], minlength=len(table))
        at = np.flatnonzero(table)
        yield pd.DataFrame({"pair": at, "c": table[at]})

    got = found.select("chain").mapInPandas(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toPandas()
    return np.bincount(got["pair"].to_numpy(np.int64), got["c"].to_numpy(np.int64), classes * classes).reshape(classes, classes)


def class_masses(tail: DataFrame) -> dict[int, tuple[int, int]]:
    """For each class the tokens and words that it has outside the lexicon."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c, cls in zip(batch["counts"], batch["cls"], strict=True):
                own = pd.DataFrame({"c": np.frombuffer(c, np.int64), "cls": np.frombuffer(cls, np.uint16).astype(np.int64)})
                yield own.groupby("cls")["c"].agg(["sum", "count"]).reset_index().set_axis(["cls", "n", "v"], axis=1)

    summed = tail.select("counts", "cls").mapInPandas(run, "cls long, n long, v long").groupBy("cls").agg(F.sum("n"), F.sum("v"))
    return {r[0]: (r[1], r[2]) for r in summed.collect()}


def score(docs: DataFrame, training: DataFrame, model: Model, least: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score of every row of docs (doc_id, text, held_out)."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges, classes = max(1, -(-size // RANGE_BYTES)), len(model.step)
    tail = Stored(tail_words(training, model, ranges, least), release=True)
    found = Stored(chains(docs, model, tail.df, ranges), release=True)
    mass = np.bincount(model.cls, model.counts, classes)
    other = 0, 0
    for cls, (n, v) in class_masses(tail.df).items():
        mass[cls] += n
        other = (n, v) if cls == 1 else other
    tail.drop()
    logs = np.log10(np.maximum(mass, 1))
    logs[0], logs[1] = 0.0, np.log10(sum(other) + 1)
    step = transitions(class_pairs(found.df.where("not held_out"), classes))
    shared = docs.sparkSession.sparkContext.broadcast((logs, step))

    @F.pandas_udf("double")
    def path(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        logs, step = shared.value
        for part in parts:
            yield pd.Series([step[row[:-1], row[1:]].sum() - logs[row].sum() for row in map(_steps, part)], dtype="float64")

    kind = dict(docs.dtypes)["doc_id"]
    return found.df.select(F.col("doc_id").cast(kind), "held_out", "n_tokens", "n_known", F.col("base").alias("base_score"), (F.col("logs") + path("chain")).alias("score"))


def class_lm_scores(docs: DataFrame, held_out: Column, vocab: int = 1024, lexicon: int = 1 << 16, classes: int = 64, least: int = 3) -> DataFrame:
    """Score every document (doc_id, text) with a model learnt from those where ``held_out`` is false.

    Every word with ``least`` occurrences in training has a class; ``lexicon`` says how many are held by each task.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score (class bigram), both
    log10 of the text's probability. Null and empty texts are one end token. Repeated rows are scored each; a null mark is
    false. Texts of any length are scored whole. Without any training document every word is unknown and the model is uniform.
    docs is read several times and must give the same rows in the same order (a stored table, not a sample).
    """
    marked = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = marked.where(~F.col("held_out"))
    counts = Stored(count_words(training))
    model = train(training, counts.df, vocab, lexicon, classes, least)
    counts.drop()
    scored = score(marked, training, model, least)
    return scored.withColumn("train_tokens", F.lit(model.n).cast("long"))
