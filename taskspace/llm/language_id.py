"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams are hashed to ``2**bits`` features; a feature's value is its share of the text's n-grams times its
inverse document frequency. Document frequencies come from all learnable documents. The weights are fitted on the driver by
follow-the-regularised-leader with elastic-net penalties on a bounded sample of them (``sample`` distinct texts for each language,
those with the smallest hashes; a documented bound), and a temperature is then calibrated on another bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import giving_back, multipliers, splitmix, unused

ORDERS = 3
UNKNOWN = "und"


def features(text: str, bits: int) -> np.ndarray:
    """The feature of each character n-gram of a whole text, lower-cased, with a space before and after it."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    code = np.where(code < 33, np.uint64(32), code)
    m, found = multipliers(8), []
    for n in range(1, ORDERS + 1):
        if len(code) < n:
            break
        h = np.full(len(code) - n + 1, n, np.uint64)
        for i in range(n):
            h += code[i : i + len(h)] * m[i]
        found.append((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits))
    return np.concatenate(found).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  #: features x languages
    bias: np.ndarray
    temperature: float
    bits: int

    def table(self) -> np.ndarray:
        return (SCALE * self.idf[:, None] * self.weights).astype(np.float32)


#: Shares of n-grams are small numbers; this brings features near 1.
SCALE = 10.0


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def document_frequencies(texts: DataFrame, bits: int) -> np.ndarray:
    """For each feature the number of texts that hold it; the sum of one bounded vector a task. The last entry counts texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, mark = np.zeros((1 << bits) + 1, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for text in batch["text"]:
                mark[:] = 0
                mark[features(text, bits)] = 1
                total[:-1] += mark
                total[-1] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"f": at, "n": total[at]})

    found = texts.select("text").mapInPandas(giving_back(run), "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((1 << bits) + 1)
    out[found["f"].to_numpy(np.int64)] = found["n"]
    return out


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, k: int, epochs: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Weights by per-coordinate FTRL-proximal. Row ``size`` of the state is the bias."""
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    order = np.argsort(splitmix(np.arange(len(rows), dtype=np.uint64) + np.uint64(11)))
    for _ in range(epochs):
        for r in order:
            at, value = rows[r]
            at, value = np.append(at, size), np.append(value, 1.0)
            w = weights(at)
            s = value @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[r]] -= 1
            grad = value[:, None] * p
            g2 = grad * grad
            sigma = (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / alpha
            z[at] += grad - sigma * w
            n[at] += g2
    final = weights(np.arange(size + 1))
    return final[:-1], final[-1]


def vector(text: str, idf: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    f = features(text, bits)
    at, c = np.unique(f, return_counts=True)
    return at, SCALE * c / len(f) * idf[at]


def least_hashes(labelled: DataFrame, most: int) -> DataFrame:
    """(lang, _r, text): for each language its ``most`` distinct texts with the smallest hashes, or all if there are fewer."""
    hashed = labelled.select("lang", "text", F.xxhash64("text", "lang").alias("_h"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("_h"))
    # copies fall together first; then hashes are ranked in slices, so that no task ranks a whole language
    slices = hashed.select("lang", "_h").distinct().withColumn("_s", F.pmod("_h", F.lit(64)))
    first = slices.withColumn("_r", rank("lang", "_s")).where(F.col("_r") <= most)
    least = first.withColumn("_r", rank("lang")).where(F.col("_r") <= most).select("lang", "_h", "_r")
    return hashed.join(F.broadcast(least), ["lang", "_h"]).groupBy("lang", "_r").agg(F.min("text").alias("text"))


def train(labelled: DataFrame, bits: int = 15, sample: int = 200, epochs: int = 4) -> Model | None:
    """Fit on rows of (text, lang), both non-null, texts with a letter. None if there are none."""
    df = document_frequencies(labelled, bits)
    if not df[-1]:
        return None
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    ranked = least_hashes(labelled, 2 * sample)
    schema = "lang string, r int, at array<int>, value array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, r, text in zip(batch["lang"], batch["_r"], batch["text"], strict=True):
                at, value = vector(text, idf, bits)
                yield pd.DataFrame({"lang": [lang], "r": [r], "at": [at.astype(np.int32)], "value": [value.astype(np.float32)]})

    got = ranked.select("lang", "_r", "text").mapInPandas(run, schema).toPandas().sort_values(["lang", "r"])
    langs = sorted(set(got["lang"]))
    y = np.array([langs.index(x) for x in got["lang"]])
    rows = list(zip(got["at"], got["value"], strict=True))
    fit = (got["r"] % 2 == 1).to_numpy()
    del got
    w, bias = ftrl([r for r, f in zip(rows, fit, strict=True) if f], y[fit], 1 << bits, len(langs), epochs)
    held = [i for i in range(len(rows)) if not fit[i]]
    logits = np.array([rows[i][1] @ w[rows[i][0]] + bias for i in held]).reshape(-1, len(langs))
    return Model(langs, idf, w, bias, temperature(logits, y[held]), bits)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits with the least negative log-likelihood on a grid of powers; 1 without rows."""
    if not len(logits):
        return 1.0

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    grid = 2.0 ** np.arange(-4, 4.25, 0.25)
    return float(min(grid, key=lambda t: (loss(t), t)))


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (its calibrated probability) to docs from the text alone.

    A null text, one without a letter, or an untrained model gives ``und`` and score 1. Outputs replace columns of the same name.
    """
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(1.0))
    shared = docs.sparkSession.sparkContext.broadcast((model.table(), model))

    @F.pandas_udf("lang_pred string, score double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table, m = shared.value
        for part in parts:
            langs, scores = [], []
            for t in part:
                if not isinstance(t, str):
                    langs.append(UNKNOWN)
                    scores.append(1.0)
                    continue
                f = features(t, m.bits)
                s = (table[f].mean(0, dtype=np.float64) + m.bias) / m.temperature
                p = np.exp(s - s.max())
                p /= p.sum()
                best = int(np.argmax(p))
                langs.append(m.langs[best])
                scores.append(float(p[best]))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    letters = has_letter(F.col(text))
    found = of(F.when(letters, F.col(text)))
    (p,) = unused(docs, "p")
    out = docs.withColumn(p, found)
    return out.withColumn("lang_pred", F.when(letters, F.col(f"{p}.lang_pred")).otherwise(UNKNOWN)).withColumn("score", F.when(letters, F.col(f"{p}.score")).otherwise(1.0)).drop(p)


def labelled_rows(docs: DataFrame, learnable: Column) -> DataFrame:
    """The (text, lang) rows to learn from: text with a letter, non-null lang."""
    return docs.where(learnable & F.col("lang").isNotNull() & has_letter(F.col("text"))).select("text", "lang")


def identify(docs: DataFrame, learnable: Column, bits: int = 15, sample: int = 200, epochs: int = 4) -> DataFrame:
    """Train on the rows of docs where ``learnable`` holds, then predict every row. Empty tables give an empty result."""
    return predict(docs, train(labelled_rows(docs, learnable), bits, sample, epochs))
