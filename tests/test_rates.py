"""Sliding rates in batch and as a stream, and adaptive chunk sizes, against plain folds."""

import datetime as dt
import random
import tempfile

import pytest

from taskspace.operators import space
from taskspace.streaming import chunks
from taskspace.streaming import directives as d


def rates_by_hand(samples, window):
    """For each (seconds, amount) the slope from the last sample at or before the window's start, with (0, 0) before all."""
    out, seen = [], []
    for t, v in sorted(samples):
        t0, v0 = max([x for x in seen if x[0] <= t - window], default=(0.0, 0.0))
        out.append((t, v, (v - v0) / (t - t0) if t > t0 else 0.0))
        seen.append((t, v))
    return out


def test_sliding_rate(spark):
    rng = random.Random(1)
    groups = {g: [(round(rng.uniform(0, span), rng.choice([0, 2])), float(rng.randrange(100))) for _ in range(n)] for g, span, n in (("a", 50, 60), ("b", 3000, 300), (None, 5000, 40), ("c", 0.1, 5), ("d", 1, 1), ("e", 100_000, 30))}
    rows = [(g, t, v) for g, s in groups.items() for t, v in s] + [("a", None, 1.0), ("a", 3.0, None)]
    df = spark.createDataFrame(rows, "g string, t double, v double")
    for window in (12.0, 1.5):
        got = [tuple(r) for r in d.sliding_rate(df, "g", "t", "v", window).collect()]
        assert sorted((r for r in got if r[3] is not None), key=repr) == sorted(((g, *r) for g, s in groups.items() for r in rates_by_hand(s, window)), key=repr)
        assert sum(r[3] is None for r in got) == 2
    plan = d.sliding_rate(df, "g", "t", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert d.sliding_rate(spark.createDataFrame([("x", 1.0, 10.0), ("x", 2.0, 30.0)], df.schema), "g", "t", "v").orderBy("t").toPandas()["rate"].tolist() == [10.0, 15.0]


def test_rate_stream_over_restarts_and_late_rows(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    zero = dt.datetime(2024, 1, 1)
    schema = "g string, at timestamp, v long"
    rng = random.Random(2)
    samples = [(g, s, s * 3 + rng.randrange(5)) for g in "ab" for s in sorted(rng.sample(range(200), 60))]
    parts = [[x for x in samples if a <= x[1] < a + 50] for a in (0, 50, 100, 150)]
    parts[1].append(("a", 49, 7))  # within the delay
    parts[3].append(("a", 3, 1000))  # later than the watermark: dropped
    for k, part in enumerate(parts):
        rng.shuffle(part)
        spark.createDataFrame([(g, zero + dt.timedelta(seconds=s), v) for g, s, v in part], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")
        d.run_available(d.rate_stream(stream, "g", "at", "v", 12.0, "10 seconds"), f"{root}/out", f"{root}/state")
    epoch = zero.replace(tzinfo=dt.UTC).timestamp()
    top = max(s for _, s, _ in samples)
    kept = samples + [("a", 49, 7)]
    want = [(g, *r) for g in "ab" for r in rates_by_hand([(epoch + s, float(v)) for h, s, v in kept if h == g], 12.0) if r[0] <= epoch + top - 10]
    assert sorted(map(tuple, spark.read.parquet(f"{root}/out").collect())) == sorted(want)


def chunks_by_hand(tasks, default, target, length):
    size, took, count, position, out = default, 0.0, 0, default, []
    for done, (s, n) in enumerate(tasks, 1):
        took, count = took + (s or 0), count + (n or 0)
        ideal = target / (took / count) if took and count else length
        size = max(1, int(0.75 * size + 0.25 * ideal if done < 10 and ideal > size else ideal))
        out.append((size, min(position, length), min(min(position, length) + size, length)))
        position += size
    return out


def test_adaptive_chunks_over_batches_and_in_one(spark):
    rng = random.Random(3)
    tasks = {g: [(rng.choice([0.0, 0.5, 4.0, None]), rng.choice([1, 3, None])) for _ in range(n)] for g, n in (("a", 30), ("b", 9), (None, 12), ("c", 1))}
    rows = [(g, i, s, n) for g, own in tasks.items() for i, (s, n) in enumerate(own)]
    want = sorted(((g, i, *c) for g, own in tasks.items() for i, c in enumerate(chunks_by_hand(own, 3, 10.0, 60))), key=repr)
    schema = "g string, i long, s double, n long"
    args = ("g", "i", "s", "n", 3, 10.0, 60)
    assert sorted(map(tuple, space.adaptive_chunks(spark.createDataFrame(rows, schema), *args).collect()), key=repr) == want
    root = tempfile.mkdtemp(prefix="spark-")
    for a, z in ((0, 5), (5, 11), (11, 30)):
        spark.createDataFrame([r for r in rows if a <= r[1] < z], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        d.run_available(chunks.chunk_stream(spark.readStream.schema(schema).parquet(f"{root}/in"), *args), f"{root}/out", f"{root}/state")
    assert sorted(map(tuple, spark.read.parquet(f"{root}/out").collect()), key=repr) == want


@pytest.mark.parametrize("name", ["sliding_rate", "rate_stream", "adaptive_chunks", "adaptive_chunk_stream"])
def test_rate_queries(same_as_sql, name):
    same_as_sql(name)
