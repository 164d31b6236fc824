"""From raw documents to packed training rows: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskspace.llm import decontaminate, language_id, mix, ngram_join, pack
from taskspace.llm.common import cut
from taskspace.llm.queries import TOKENIZER, table

#: Documents go whose language is called with a calibrated probability less than this share of the way from chance to certainty.
LEAST_MARGIN = 0.2


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no recognisable language go: without a letter, without text, or called with too little certainty."""
    model = language_id.train(language_id.labelled_rows(docs, F.lit(True)))
    chance = 1 / len(model.langs) if model else 1.0
    judged = language_id.predict(docs, model)
    sure = F.col("score") >= chance + LEAST_MARGIN * (1 - chance)
    return judged.where((F.col("lang_pred") != language_id.UNKNOWN) & sure).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, that with the smallest id stays; rows without an id stay. Of rows
    that repeat an id and its text one stays; different texts under one id stay both."""
    found = ngram_join.ngram_components(docs, n=5, percent=80)
    firsts = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(firsts, "doc_id").select(*docs.columns, F.xxhash64("text").alias(mark := "_text" + "_" * max(map(len, docs.columns))))
    return named.dropDuplicates(["doc_id", mark]).select(docs.columns).union(docs.where("doc_id is null").select(docs.columns))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item's words in common runs go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(docs.columns)


def to_target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample half of the tokens, with sources, languages and topics nearer to equal shares."""
    return mix.mixed(docs, keep=0.5).where("sampled").select(docs.columns)


def to_packed_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in packed rows of 2048."""
    return pack.pack(docs, pack.read_ranks(spark, f"file://{TOKENIZER}"), pack.PATTERN)


STAGES = [
    ("language_id", by_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmarks),
    ("mix_sources", to_target_mix),
    ("pack_tokens", to_packed_ids),
]

#: Models, graph components and bin packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
