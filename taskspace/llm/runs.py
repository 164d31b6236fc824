"""Periodic runs of words in every text, by the Lyndon roots of the runs.

Every run has a Lyndon root with respect to an order of the words or to its reverse. A stack scanned right to left gives the longest
Lyndon factor at each word under both orders; its two ends are extended left and right as far as words a factor's length apart are
the same. Suffixes are compared, and ends extended, by binary search over rolling hashes, and what the hashes find is compared word
by word. Words are scanned only where runs can be: in stretches of windows that recur near by, which every run lies in whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, multipliers, splitmix, word_hashes

#: The prime and the base of the rolling hashes.
PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51
#: Words compared one by one before hashes are asked.
NEAR = 8

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_OUT = pa.struct([("n_words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.string())])


class Lce:
    """Longest common extensions of a sequence of word numbers, to the right and to the left of two places."""

    def __init__(self, ids: list[int]):
        self.ids, self.n = ids, len(ids)
        self.raw = np.array(ids, np.uint32).tobytes()
        self.sums: list[int] = []
        self.powers: list[int] = []
        #: by distance d the last stretch (a, z) known to have the same words d apart; it ends at z for good
        self.known: dict[int, tuple[int, int]] = {}

    def _hash(self) -> None:
        total, power = 0, 1
        self.sums, self.powers = [0], [1]
        for x in self.ids:
            total = (total * BASE + x + 1) % PRIME
            power = power * BASE % PRIME
            self.sums.append(total)
            self.powers.append(power)

    def _same(self, i: int, j: int, size: int) -> bool:
        s = self.sums
        return (s[i + size] - s[j + size] - (s[i] - s[j]) * self.powers[size]) % PRIME == 0

    def _search(self, most: int, least: int, same) -> int:
        """The largest size from least to most for which ``same`` holds, as it does up to there."""
        low, step = least, NEAR
        while low < most:
            size = min(most, low + step)
            if not same(size):
                high = size
                while high - low > 1:
                    size = (low + high) // 2
                    low, high = (size, high) if same(size) else (low, size)
                return low
            low, step = size, 2 * step
        return low

    def _verified(self, i: int, j: int, size: int) -> int:
        """``size``, if the words of both places are the same one by one; else where they first differ."""
        raw = self.raw
        if raw[4 * i : 4 * (i + size)] == raw[4 * j : 4 * (j + size)]:
            return size
        return next(k for k in range(size) if self.ids[i + k] != self.ids[j + k])

    def right(self, i: int, j: int) -> int:
        """How many words from i on are those from j on, i < j."""
        ids, d, most = self.ids, j - i, self.n - j
        found = self.known.get(d)
        if found and found[0] <= i <= found[1]:
            return found[1] - i
        near = min(NEAR, most)
        for k in range(near):
            if ids[i + k] != ids[j + k]:
                if k:
                    self.known[d] = i, i + k
                return k
        size = near
        if found and i < found[0] <= i + near:
            size = found[1] - i
        elif near < most:
            if not self.sums:
                self._hash()
            size = self._search(most, near, lambda m: self._same(i, j, m))
            # a stretch that was verified before and reaches into this one needs no second look
            if found and i < found[0] <= i + size:
                head = found[0] - i
                size = found[1] - i if self._verified(i, j, head) == head else self._verified(i, j, head)
            else:
                size = self._verified(i, j, size)
        if size:
            self.known[d] = i, i + size
        return size

    def left(self, i: int, j: int) -> int:
        """How many words before i are those before j, i < j."""
        ids = self.ids
        near = min(NEAR, i)
        for k in range(1, near + 1):
            if ids[i - k] != ids[j - k]:
                return k - 1
        if near == i:
            return near
        if not self.sums:
            self._hash()
        size = self._search(i, near, lambda m: self._same(i - m, j - m, m))
        if self.raw[4 * (i - size) : 4 * i] == self.raw[4 * (j - size) : 4 * j]:
            return size
        return next(k for k in range(size) if ids[i - k - 1] != ids[j - k - 1])


def runs_of(ids: list[int], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` words, and of twice its period, by start and then period."""
    n, lce = len(ids), Lce(ids)
    found: set[tuple[int, int, int]] = set()
    for reverse in (False, True):
        stack: list[int] = []
        last: dict[int, tuple[int, int]] = {}
        for i in range(n - 1, -1, -1):
            x, r = ids[i], 0
            while stack:
                j = stack[-1]
                if x != ids[j]:
                    r = 0
                    if (x > ids[j]) != reverse:
                        break
                else:
                    r = lce.right(i, j)
                    # a suffix is more than each of its prefixes, in both orders
                    if j + r == n or (ids[i + r] > ids[j + r]) != reverse:
                        break
                stack.pop()
            j = stack[-1] if stack else n
            stack.append(i)
            before = i > 0 and ids[i - 1] == ids[j - 1]
            if j == n:
                r = 0
            if not before and r < j - i:
                continue
            p = j - i
            seen = last.get(p)
            if seen and seen[0] <= i <= seen[1]:
                continue  # another root of the run seen last
            start = i - lce.left(i, j) if before else i
            last[p] = start, i + r
            length = i + r + p - start
            if length >= max(least, 2 * p):
                found.add((start, length, p))
    return sorted(found, key=lambda t: (t[0], t[2]))


def _recurring(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def zones(words: list[np.ndarray], window: int) -> list[list[tuple[int, int]]]:
    """For each text's word hashes the stretches (first, end) that can hold runs.

    A run of ``length`` and period q repeats each of its windows of up to length - q words q words apart, and such windows cover it.
    So runs lie in stretches covered by windows that recur in the text, and in such a stretch a window recurs.
    """
    sizes = np.array([len(w) for w in words])
    flat = np.concatenate([*words, np.zeros(window, np.uint64)])
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    n = len(owner)
    at = np.flatnonzero(np.arange(n) + window <= ends[owner])
    out: list[list[tuple[int, int]]] = [[] for _ in words]
    if not len(at):
        return out
    m = multipliers(window + 1)
    sums = np.zeros(n, np.uint64)
    for k in range(window):
        sums += flat[k : n + k] * m[k]
    seed = m[window]
    of = owner
    for last in (False, True):
        at = at[_recurring(splitmix(splitmix(sums[at]) + of[at].astype(np.uint64) * seed))]
        if not len(at):
            return out
        if last:
            break
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
        cover = np.cumsum(change)[:n] > 0
        first = cover & ~(np.concatenate([[False], cover[:-1]]) & (owner == np.concatenate([[-1], owner[:-1]])))
        of = np.cumsum(first)  # the number of the stretch, from 1
    held = np.unique(of[at])
    firsts = np.flatnonzero(first)[held - 1]
    stop = cover & ~(np.concatenate([cover[1:], [False]]) & (owner == np.concatenate([owner[1:], [-1]])))
    lasts = np.flatnonzero(stop)[held - 1]
    begins = ends - sizes
    for a, z in zip(firsts.tolist(), lasts.tolist(), strict=True):
        t = int(owner[a])
        out[t].append((a - int(begins[t]), z + 1 - int(begins[t])))
    return out


def found_in(texts: list[bytes], least: int = 12) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """For each text its count of words, its runs and what is left when each run is cut down to its first period."""
    for a, z in grouped(texts):
        part = texts[a:z]
        for text, stretches in zip(part, zones(word_hashes(part, fold=False), -(-least // 2)), strict=True):
            words = text.split()
            runs: list[tuple[int, int, int]] = []
            for first, end in stretches:
                number: dict[bytes, int] = {}
                ids = [number.setdefault(w, len(number)) for w in words[first:end]]
                runs += [(first + s, length, p) for s, length, p in runs_of(ids, least)]
            n = len(words)
            if runs:
                gone = np.zeros(n + 1, np.int64)
                for s, length, p in runs:
                    gone[s + p] += 1
                    gone[s + length] -= 1
                words = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
            yield n, runs, b" ".join(words)


def _finder(least: int):
    @F.arrow_udf("struct<n_words: long, runs: array<struct<start: long, length: long, period: long>>, collapsed: string>")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            counts, offsets, rows, left = [], [0], [], []
            for first in range(0, len(part), 256):
                texts = [t or b"" for t in part.slice(first, 256).cast(pa.binary()).to_pylist()]
                for n, runs, kept in found_in(texts, least):
                    counts.append(n)
                    rows += runs
                    offsets.append(len(rows))
                    left.append(kept)
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_RUNS.value_type)))
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), runs, pa.array(left, pa.binary()).cast(pa.string())], fields=list(_OUT))

    return of


def with_runs(docs: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """Add ``n_words``, ``runs`` (array of start, length, period, by start and then period) and ``collapsed`` to docs.

    Words are ``[^\\x20\\x09-\\x0D]+`` as they are, numbered from 0. A run is a stretch of words that are the same ``period`` words
    apart, for the smallest such period, of at least ``least`` words and of twice the period, and that no word beside it extends.
    ``collapsed`` holds the words, joined by one space, that no run has after its first period. Null and empty texts have no word, no
    run and an empty ``collapsed``. Whole texts count, however long; rows are independent, so that repeated rows and ids are fine and
    nothing is shuffled. Other columns are kept; those with an output's name are replaced.
    """
    if least < 2:
        raise ValueError("a run has at least two words")
    out = docs.drop("n_words", "runs", "collapsed") if text not in ("n_words", "runs", "collapsed") else docs
    found = _finder(least)(F.col(text))
    name = "_found" + "_" * max(map(len, out.columns))
    return out.withColumn(name, found).withColumns({k: F.col(f"{name}.{k}") for k in ("n_words", "runs", "collapsed")}).drop(name)
