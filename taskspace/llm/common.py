"""Shared helpers: durable cuts of lineage, row identities and vectorised text hashing."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir

MASK = (1 << 64) - 1


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a file tree on whatever store it is on; a missing one is fine."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Stored:
    """A frame written to the shared folder; ``df`` reads it back, ``drop()`` removes it early.

    With ``release`` the shuffle files behind it are let go at once, rather than when the driver next collects garbage.
    """

    def __init__(self, df: DataFrame, release: bool = False):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/taskspace-{uuid.uuid4().hex}"
        # a marker of success has no reader here
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        atexit.register(self.drop)
        if release:
            del df
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()

    def drop(self) -> None:
        try:
            drop_path(self.spark, self.path)
        except Exception:  # noqa: BLE001  the session may have ended
            pass


def cut(df: DataFrame, release: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors."""
    return Stored(df, release).df


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for internal columns: the given ones behind more underscores than any column of the frame begins with."""
    mark = "_"
    while any(c.startswith(mark) for c in df.columns):
        mark += "_"
    return [mark + n for n in names]


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 over uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_table: list[np.ndarray] = [np.zeros(0, np.uint64)]


def multipliers(n: int) -> np.ndarray:
    """n odd pseudo-random 64-bit numbers, the same on every machine."""
    if len(_table[0]) < n:
        size = max(1024, 1 << int(n - 1).bit_length())
        _table[0] = splitmix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _table[0][:n]


#: ASCII A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The bytes that separate words: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A pseudo-random number for each byte, capitals as their small letters.
_VALUE = splitmix(LOWER.astype(np.uint64) + np.uint64(1))
#: The same with capitals as they are.
_CASED = splitmix(np.arange(256, dtype=np.uint64) + np.uint64(1))


def grouped(texts: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of at most ``most`` bytes together; a longer text is a run of its own."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and their inverses."""
    if len(_powers[0]) < n:
        size = max(1 << 21, n)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            _powers[i] = np.multiply.accumulate(full)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[bytes], fold: bool = True) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words ``[^\\x20\\x09-\\x0D]+``, in order, A-Z lower-cased unless ``fold`` is false."""
    value = _VALUE if fold else _CASED
    out: list[np.ndarray] = []
    for a, z in grouped(texts):
        raw = np.frombuffer(b"\n".join([*texts[a:z], b""]), np.uint8)
        edge = np.flatnonzero(np.diff(~SPACE[raw], prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        up, down = powers(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(value[raw] * up, out=total[1:])
        hashed = splitmix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        bounds = np.cumsum([0, *[len(t) + 1 for t in texts[a:z]]])
        cuts = np.searchsorted(starts, bounds)
        out += [hashed[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words in order; of the whole sequence where there are fewer; none without words."""
    if not len(words):
        return words
    m = multipliers(n + 1)
    if len(words) < n:
        return splitmix(np.array([(words * m[: len(words)]).sum() + np.uint64(len(words))], np.uint64))
    size = len(words) - n + 1
    total = np.full(size, n, np.uint64)
    for i in range(n):
        total += words[i : i + size] * m[i]
    return splitmix(total)


def utf8(texts) -> list[bytes]:
    """UTF-8 bytes of a column's values, nulls as empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def utf8_each(texts) -> Iterator[bytes]:
    """The same one by one, for loops that need no list."""
    for t in texts:
        yield t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""


def give_back() -> None:
    """Return to the system what a task has freed: a Python worker that waits for its next task keeps it otherwise."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def giving_back(run: Callable) -> Callable:
    """A function over batches, that gives memory back at the end of its task."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole
