"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import class_lm, conversation_repair, decontaminate, hnsw, jump_shards, language_id, mix, ngram_join, pack, runs, slack_pack, suffix_dedup, url_filter

#: Where the vocabulary files of public tokenizers are; callers of :mod:`pack` give their own.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
WORD_TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
#: (host, path, verdict) of the url query.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"))
    placed = jump_shards.assign_shards(docs, "doc_id", 16)
    slotted = jump_shards.with_slots(placed, "shard", ["doc_id", "text_crc32", "size"], buckets=256)
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = class_lm.crc_remainder(F.col("doc_id"), 4) == 2
    return language_id.identify(docs, ~held).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix.mixed(docs).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "rate", "sampled")


def op5_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"), pack.read_ranks(spark, f"file://{TOKENIZER}"), pack.PATTERN)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.transform("items", lambda i: i["item_id"]).alias("item_ids"), F.coalesce(F.array_max(F.transform("items", lambda i: i["coverage"])), F.lit(0.0)).alias("coverage"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.with_spans(table(spark, sf_dir, "documents")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("select * from values " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + " as rules(host, path, verdict)")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op10_class_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return class_lm.class_lm_scores(docs, class_lm.crc_remainder(F.col("doc_id"), 7) == 2)


def op11_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slack_pack.pack(table(spark, sf_dir, "documents"), slack_pack.read_vocabulary(spark, f"file://{WORD_TOKENIZER}"), 4096)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with the damage of this query, by crc32(conv_id:turn) % 20 (null: one space): 0 takes the row (``there`` is false), 1 empties its
    text, 2 takes the text's ``.!?``, 3 repeats the row and 4 makes its role user."""
    space = F.lit(" ")
    k = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.select("conv_id", "turn", F.when(k == 4, "user").otherwise(role).alias("role"), F.when(k == 1, "").when(k == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (k != 0).alias("there"), F.explode(F.sequence(F.lit(1), F.when(k == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.with_sha256(*conversation_repair.repair_parts(rows, F.col("there")))


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the periods of this query: with h = crc32(doc_id as text) and g = h // 10, where h % 10 is 0, word i >= a becomes
    word a + (i - a) % p, for a = g % n and p = 1 + (n - a) // (3 + g % 8), n words. Other texts, nulls included, stay."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    n = F.size("_words").cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    own = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at("_words", (F.when(i < a, i).otherwise(a + F.pmod(i - a, p)) + 1).cast("int")))
    hit = docs.withColumn("_words", F.when(h % 10 == 0, words).otherwise(F.array().cast("array<string>")))
    return hit.withColumn("text", F.when(F.size("_words") > 0, F.array_join(own, " ")).otherwise(F.col("text"))).drop("_words")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.with_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    text = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", (-F.col("best.n")).alias("length"), "best.period", F.floor(1000 * -F.col("best.n") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_hnsw_search, op2_jump_hash_shards, op3_language_id, op4_mix_sources, op5_pack_tokens, op6_ngram_jaccard_join, op7_benchmark_decontamination, op8_suffix_array_dedup, op9_url_filter, op10_class_lm_score, op11_min_bin_slack, op12_conversation_repair, op13_periodic_runs, pipeline]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    urls = f"""
with rules(h, p, v) as (values {rules}),
located as (
  select page_id, case when strpos(url, '://') > 0 then translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages)
select page_id, host, path,
  (select h || p from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc, length(h) desc, h || p desc limit 1) as rule,
  coalesce((select v from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc, length(h) desc, h || p desc limit 1), 'allow') as verdict
from located"""
    join = """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from words),
tokens as (select doc_id, len(s) as n, unnest(s) as t from sets),
pairs as (
  select a.doc_id as x, b.doc_id as y from tokens a join tokens b on a.t = b.t and a.doc_id < b.doc_id
  and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
links as (select x, y from pairs union select y, x from pairs),
reach as (select doc_id as x, doc_id as y from sets union select r.x, l.y from reach r join links l on r.y = l.x)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r.y) as component_id
from sets s join reach r on s.doc_id = r.x group by s.doc_id, len(s.s)"""
    return {"op9_url_filter": urls, "op6_ngram_jaccard_join": join}
