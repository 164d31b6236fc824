"""Adaptive chunks as keyed stream state: each finished task gives its run the next chunk."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.space import next_size

_STATE = "done long, seconds double, count long, size long, position long"


def chunk_stream(finished: DataFrame, by: str, order: str, seconds: str, values: str, default: int, target: float, length: int) -> DataFrame:
    """:func:`taskspace.operators.space.adaptive_chunks` over a stream of finished tasks: (by, order, size, first, end), a row for each as it
    arrives. State of a key is five numbers. Tasks of one batch are taken by ``order``, batches as they come."""
    kinds = dict(finished.dtypes)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done, took, count, size, position = state.get if state.exists else (0, 0.0, 0, default, default)
        rows = pd.concat(list(batches)).sort_values("_order", kind="stable")
        out = []
        for at, s, n in zip(rows["_order"], rows["_seconds"], rows["_values"], strict=True):
            done, took, count = done + 1, took + float(s), count + int(n)
            size = next_size(size, done, took, count, target, length)
            first = min(position, length)
            out.append((key[0], at, size, first, min(first + size, length)))
            position += size
        state.update((done, took, count, size, position))
        yield pd.DataFrame(out, columns=[by, order, "size", "first", "end"])

    rows = finished.select(by, F.col(order).alias("_order"), F.coalesce(F.col(seconds).cast("double"), F.lit(0.0)).alias("_seconds"), F.coalesce(F.col(values).cast("long"), F.lit(0)).alias("_values"))
    return rows.groupBy(by).applyInPandasWithState(fold, f"{by} {kinds[by]}, {order} {kinds[order]}, size long, first long, end long", _STATE, "append", "NoTimeout")
