"""Mixing sources to target weights by iterative proportional fitting, and sampling by calibrated probabilities."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, unused

#: Cells of the marginals' cross table up to which the driver fits them; more are fitted by aggregations.
DRIVER_CELLS = 200_000
TOPICS = 8
#: Stands for null among the values of a dimension.
NULL = "\u0000"


def token_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def topic(text: Column, topics: int = TOPICS) -> Column:
    """A coarse topic: among words of seven or more characters, the hashed group that has most of them (the first of
    equals); -1 for texts without such words."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: F.length(w) >= 7)
    groups = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(topics)).cast("int"))
    marks = F.array_join(F.transform(groups, lambda g: F.chr(g + 65)), "")
    counts = F.array(*[F.struct((F.length(marks) - F.length(F.replace(marks, F.lit(chr(65 + i))))).alias("n"), F.lit(-i).alias("g")) for i in range(topics)])
    best = F.array_max(counts)
    return F.when(best["n"] > 0, -best["g"]).otherwise(-1)


def tempered(shares: Mapping, power: float) -> dict:
    """Targets between natural shares (power 1) and equal ones (power 0)."""
    raised = {k: v**power for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def rake(cells: pd.DataFrame, targets: Mapping[str, Mapping], sweeps: int = 50, tolerance: float = 1e-9) -> np.ndarray:
    """Token weights of cells (one column a dimension, and tokens) whose shares meet the targets in every dimension.

    Each sweep scales the cells of a value by target over share, one dimension after another. Values without a target, or
    without a token, keep no weight; targets of values that no cell has are spread over the others in proportion.
    """
    w = cells["tokens"].to_numpy(np.float64).copy()
    coded = {d: pd.factorize(cells[d]) for d in targets}
    for d, t in targets.items():
        codes, values = coded[d]
        w[~np.array([x in t for x in values], bool)[codes]] = 0
    for _ in range(sweeps):
        worst = 0.0
        for d, t in targets.items():
            codes, values = coded[d]
            now = np.bincount(codes, w, len(values))
            aim = np.array([t.get(x, 0.0) for x in values]) * (now > 0)
            if not aim.sum():
                return np.zeros(len(w))
            aim /= aim.sum()
            share = now / now.sum()
            factor = np.divide(aim, share, out=np.zeros(len(values)), where=share > 0)
            worst = max(worst, float(np.abs(share - aim).max()))
            w *= factor[codes]
        if worst < tolerance:
            break
    return w / w.sum() if w.sum() else w


def rake_frame(cells: DataFrame, targets: Mapping[str, DataFrame], sweeps: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """The same fit, with the same stop, by aggregations, for cross tables that no driver should hold: cells with ``weight``.
    Targets are frames of (the dimension, ``aim``)."""
    aimed = cells
    for d, t in targets.items():
        aimed = aimed.join(t.select(d), d, "left_semi")
    at = Stored(aimed.select(*cells.columns, F.col("tokens").cast("double").alias("weight")))
    for _ in range(sweeps):
        worst = 0.0
        for d, t in targets.items():
            sums = Stored(at.df.groupBy(d).agg(F.sum("weight").alias("now")).where("now > 0").join(t, d))
            aims, held = sums.df.agg(F.sum("aim"), F.sum("now")).first()
            if not aims:
                return at.df.where(F.lit(False))
            share, aim = F.col("now") / held, F.col("aim") / aims
            worst = max(worst, sums.df.agg(F.max(F.abs(share - aim))).first()[0])
            new = Stored(at.df.join(sums.df.select(d, (aim / share).alias("factor")), d).withColumn("weight", F.col("weight") * F.col("factor")).select(at.df.columns))
            for old in (sums, at):
                old.drop()
            at = new
        if worst < tolerance:
            break
    return at.df


def sampling_rates(tokens: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """For each cell the probability of keeping a document: in proportion to weight over tokens, at most 1, scaled so that
    the expected tokens are ``budget``, or all of the weighted cells' if the budget is larger."""
    ratio = np.divide(weights, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    usable = tokens * (ratio > 0)
    if budget >= usable.sum():
        return (ratio > 0).astype(np.float64)
    low, high = 0.0, 1.0 / ratio[ratio > 0].min()
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * ratio) * tokens).sum() < budget else (low, mid)
    return np.minimum(1, high * ratio)


def uniform(doc_id: Column, seed: int) -> Column:
    """A number from 0 to below 1 that the id and the seed decide."""
    return F.shiftrightunsigned(F.xxhash64(doc_id.cast("string"), F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))


def mixed(docs: DataFrame, keep: float = 0.5, powers: Mapping[str, float] | None = None, targets: Mapping[str, Mapping] | None = None, seed: int = 7) -> DataFrame:
    """Add n_tokens, topic, ``weight`` (the share of the mix's tokens aimed at for the document's cell), ``rate`` (its probability) and
    ``sampled`` to every row of docs (doc_id, text, lang, source).

    Marginals are source, lang and topic. Targets default to natural token shares raised to ``powers`` (0.5 each) and
    scaled; ``keep`` is the share of tokens to keep. Null is a value like others. Documents without a word have weight 0
    and rate 0 and aren't sampled. Rows that repeat a doc_id fall together if they are of one cell. An empty table gives an
    empty result. Only one row a cell leaves the tasks; documents aren't shuffled unless cells are too many for the driver.
    """
    dims = ["source", "lang", "topic"]
    text = F.col("text")
    full = docs.drop("n_tokens", "topic", "weight", "rate", "sampled").withColumn("n_tokens", token_count(text)).withColumn("topic", topic(text).cast("string"))
    named = [F.coalesce(F.col(d).cast("string"), F.lit(NULL)).alias(d) for d in dims]
    by_cell = Stored(full.where("n_tokens > 0").groupBy(*named).agg(F.sum("n_tokens").alias("tokens"))).df
    powers = {d: 0.5 for d in dims} | dict(powers or {})
    given = {d: {NULL if k is None else str(k): v for k, v in t.items()} for d, t in (targets or {}).items()}
    if by_cell.count() <= DRIVER_CELLS:
        cells = by_cell.toPandas()
        aims = {d: given.get(d) or tempered(cells.groupby(d)["tokens"].sum().to_dict(), powers[d]) for d in dims}
        tokens = cells["tokens"].to_numpy(np.float64)
        weights = rake(cells, aims)
        rows = list(zip(*[cells[d] for d in dims], weights.tolist(), sampling_rates(tokens, weights, keep * tokens.sum()).tolist(), strict=True))
        rates = docs.sparkSession.createDataFrame(rows, ", ".join(f"{d} string" for d in dims) + ", weight double, rate double")
    else:
        frames = {d: docs.sparkSession.createDataFrame(list(given[d].items()), f"{d} string, aim double") if d in given else by_cell.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), powers[d]).alias("aim")) for d in dims}
        raked = rake_frame(by_cell, frames).where("weight > 0")
        all_tokens = by_cell.agg(F.sum("tokens")).first()[0]
        total, high = raked.agg(F.sum("weight"), F.max(F.col("tokens") / F.col("weight"))).first()
        low, ratio = 0.0, F.col("weight") / F.col("tokens")
        for _ in range(100):
            mid = (low + high) / 2
            got = raked.agg(F.sum(F.least(F.lit(1.0), ratio * mid) * F.col("tokens"))).first()[0]
            low, high = (mid, high) if got < keep * all_tokens else (low, mid)
        rates = raked.select(*dims, (F.col("weight") / total).alias("weight"), F.least(F.lit(1.0), ratio * high).alias("rate"))
    cell = unused(full, *dims)
    found = rates.select(*[F.col(d).alias(c) for d, c in zip(dims, cell, strict=True)], "weight", "rate")
    on = [F.coalesce(F.col(d).cast("string"), F.lit(NULL)) == F.col(c) for d, c in zip(dims, cell, strict=True)]
    out = full.join(found, on[0] & on[1] & on[2], "left").drop(*cell)
    none = F.col("n_tokens") == 0
    rate = F.when(none, 0.0).otherwise(F.coalesce("rate", F.lit(0.0)))
    return out.withColumn("weight", F.when(none, 0.0).otherwise(F.coalesce("weight", F.lit(0.0)))).withColumn("rate", rate).withColumn("sampled", uniform(F.col("doc_id"), seed) < F.col("rate"))
