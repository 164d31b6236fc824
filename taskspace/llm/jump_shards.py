"""Jump consistent hashing: stable keys to shards without a ring table, in DataFrame expressions only.

The generator of the published algorithm is ``k = k * 2862933555777941757 + 1 (mod 2^64)``; the product is built from
16- and 32-bit limbs because ANSI arithmetic refuses to wrap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unused

#: Fixed value: the multiplier of the published algorithm.
MULTIPLIER = 2862933555777941757
_LOW, _HIGH = MULTIPLIER & 0xFFFFFFFF, MULTIPLIER >> 32
_M32 = 0xFFFFFFFF


def _long(v: int) -> Column:
    return F.lit(v).cast("long")


def _times32(x: Column, y: int) -> Column:
    """x * y mod 2^32 for 0 <= x, y < 2^32."""
    low, high = x.bitwiseAND(_long(0xFFFF)), F.shiftrightunsigned(x, 16)
    return (low * _long(y) + F.shiftleft((high * _long(y)).bitwiseAND(_long(0xFFFF)), 16)).bitwiseAND(_long(_M32))


def next_key(k: Column) -> Column:
    """k * MULTIPLIER + 1 mod 2^64, in signed longs that never overflow."""
    low, high = k.bitwiseAND(_long(_M32)), F.shiftrightunsigned(k, 32)
    first = low.bitwiseAND(_long(0xFFFF)) * _long(_LOW) + _long(1)
    middle = F.shiftrightunsigned(low, 16) * _long(_LOW) + F.shiftrightunsigned(first, 16)
    product = F.shiftleft(middle, 16).bitwiseOR(first.bitwiseAND(_long(0xFFFF)))
    top = (F.shiftrightunsigned(product, 32) + _times32(high, _LOW) + _times32(low, _HIGH)).bitwiseAND(_long(_M32))
    return F.shiftleft(top, 32).bitwiseOR(product.bitwiseAND(_long(_M32)))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a long key. Adding a shard moves keys only into the new one.

    The walk takes ln(shards) steps on average and at most ``shards``; it is given as many as that up to 4096 shards,
    and beyond them so many that running out is impossible in practice, in which case the row fails rather than be misplaced.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    steps = shards if shards <= 4096 else 4096
    start = F.struct(key.alias("k"), _long(-1).alias("b"), _long(0).alias("j"))

    def step(acc: Column, _: Column) -> Column:
        k = next_key(acc["k"])
        j = F.floor((acc["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftrightunsigned(k, 33) + 1).cast("double"))).cast("long")
        return F.when(acc["j"] < shards, F.struct(k.alias("k"), acc["j"].alias("b"), j.alias("j"))).otherwise(acc)

    done = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    found = done["b"].cast("int")
    return found if steps == shards else F.when(done["j"] >= shards, found).otherwise(F.raise_error(F.lit("jump hash did not end")).cast("int"))


def assign_shards(df: DataFrame, key: str, shards: int, into: str = "shard", grown: str | None = "grown_shard") -> DataFrame:
    """Add the shard of each row, and with ``grown`` the one it has when one shard is appended.

    Keys that aren't integers are hashed to 64 bits first. A null key counts as 0. Equal keys share a shard; other columns
    are kept as they are (an existing column named like an output is replaced).
    """
    kind = dict(df.dtypes)[key]
    number = F.col(key).cast("long") if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(F.col(key))
    number = F.coalesce(number, F.lit(0).cast("long"))
    out = df.withColumn(into, jump_hash(number, shards))
    return out.withColumn(grown, jump_hash(number, shards + 1)) if grown else out


def with_slots(df: DataFrame, shard: str, order: list[str], buckets: int, into: str = "slot") -> DataFrame:
    """Number the rows of each shard 0, 1, 2, ... without a gap.

    A shard is split into hashed buckets of ``order``; a small table of bucket sizes gives each bucket its offset and a
    window numbers rows inside a bucket, so no task holds a shard. Rows equal in all of ``order`` get their slots in any order.
    """
    bucket, rows, of, b, before, own = unused(df, "bucket", "rows", "shard", "b", "before", "own")
    spread = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = spread.groupBy(shard, bucket).agg(F.count("*").alias(rows))
    so_far = F.coalesce(F.sum(rows).over(Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col(shard).alias(of), F.col(bucket).alias(b), so_far.alias(before))
    numbered = spread.withColumn(own, F.row_number().over(Window.partitionBy(shard, bucket).orderBy(*order)) - 1)
    joined = numbered.join(offsets, (F.col(shard) == F.col(of)) & (F.col(bucket) == F.col(b)), "left")
    return joined.withColumn(into, (F.col(own) + F.col(before)).cast("long")).drop(bucket, own, of, b, before)
