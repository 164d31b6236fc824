"""Each operator against a plain version of its contract, on the smallest tables and on hard small cases."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskspace.llm import class_lm, decontaminate, hnsw, jump_shards, language_id, mix, ngram_join, pack, queries, suffix_dedup, url_filter


def docs_of(spark, rows, extra=False):
    if extra:
        return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, sequence string, node string, spans string")
    return spark.createDataFrame(rows, "doc_id long, text string")


def read_docs(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def words_of(text):
    return (text or "").encode().lower().split()


# -- 2 ----------------------------------------------------------------------------------------------------------------
def jump(key, n):
    key, b, j = key % (1 << 64), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_follows_the_published_walk(spark):
    rng = random.Random(1)
    keys = [0, 1, -1, (1 << 63) - 1, -(1 << 63), *[rng.randrange(-(1 << 63), 1 << 63) for _ in range(300)]]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 17, 1000):
        got = {r[0]: r[1] for r in df.select("k", jump_shards.jump_hash(df["k"], n).alias("s")).collect()}
        assert got == {k: jump(k, n) for k in keys}


def test_shards_query(spark, sf):
    got = queries.op2_jump_hash_shards(spark, sf).collect()
    texts = dict(read_docs(spark, sf))
    assert len(got) == len(texts)
    slots = collections.defaultdict(list)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["shard"] == jump(r["doc_id"], 16) and r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_tables(spark):
    df = spark.createDataFrame([(None, 1), (5, 1), (5, 1), (6, None)], "doc_id long, size long")
    out = jump_shards.with_slots(jump_shards.assign_shards(df, "doc_id", 3), "shard", ["doc_id", "size"], 4).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert sum(map(len, by.values())) == 4 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert jump_shards.assign_shards(df.limit(0), "doc_id", 3).count() == 0
    assert {r["shard"] for r in jump_shards.assign_shards(spark.createDataFrame([("a",), ("a",)], "k string"), "k", 9).collect()}.__len__() == 1


# -- 9 ----------------------------------------------------------------------------------------------------------------
def judged(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else "allow"


def test_url_rules(spark, sf):
    urls = [None, "", "no scheme", "http://", "http://org", "http://org/", "HTTP://WWW.Example.ORG/es/x", "http://example.org/es", "http://xexample.org/en/1", "http://a.example.org/en/12?x#y", "http://a.com/fr/?q", "http://com/de/", "x://É.COM/FR/", "a://b://c/d", "http://example.org/es/://x", "http://..org/\n/x", "http://example.org?/es/"]
    urls += [r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls * 2)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = url_filter.judge(pages, rules).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(r["url"]), r["url"]
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_bloom_filter_never_misses(spark):
    rules = spark.createDataFrame([(f"h{i}.net", f"/{i}") for i in range(3000)], "host string, path string")
    key = url_filter._key(rules["host"], rules["path"])
    words = url_filter.bloom_filter(rules, "host", "path", 64).scalar()
    assert rules.where(~url_filter.maybe_listed(key, words, 64)).count() == 0
    assert url_filter.blocks_for(5) == 64 and url_filter.blocks_for(100_000) == 4096 and url_filter.blocks_for(1 << 40) == url_filter.LARGEST
    sparse = url_filter.bloom_filter(rules.limit(100), "host", "path", 64).scalar()
    assert rules.where(url_filter.maybe_listed(key, sparse, 64)).count() < 200


# -- 6 ----------------------------------------------------------------------------------------------------------------
def components_by_hand(rows, n, percent):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def near_copies(rng, count, words, edits, start=0):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    for k in range(count):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(words)] = f"e{rng.randrange(9999)}"
        yield start + k, " ".join(w)


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_ngram_components(spark, sf, n, percent):
    rng = random.Random(3)
    rows = read_docs(spark, sf)
    rows += [(10_000 + k, t) for k, t in near_copies(rng, 60, 200, 9)] + [(20_000 + k, t) for k, t in near_copies(rng, 40, 40, 3)]
    rows += [(30_000 + i, "same words again") for i in range(30)] + [(31_000, None), (31_001, ""), (31_002, " \t\n"), (31_003, "Word"), (31_004, "word "), (31_005, "a b"), (31_006, "A\x0bB"), (31_007, "a b c"), (5, "a b c"), (5, "a b c")]
    common = "the very common line that many documents share without being alike at all "
    rows += [(40_000 + i, common + " ".join(f"q{rng.randrange(10**6)}" for _ in range(30))) for i in range(60)]
    rng.shuffle(rows)
    got = sorted(((r[0], r[1], r[2]) for r in ngram_join.ngram_components(docs_of(spark, rows, True), n, percent).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == components_by_hand(rows, n, percent)


def test_ngram_components_of_nothing(spark):
    assert ngram_join.ngram_components(docs_of(spark, []), 3, 90).count() == 0
    rows = [(None, "a b c d"), (7, "a b c d"), (None, None), (3, "x")]
    got = ngram_join.ngram_components(docs_of(spark, rows), 3, 90).collect()
    assert sorted((r["n_shingles"], str(r["component_id"])) for r in got) == [(0, "None"), (1, "3"), (2, "7"), (2, "7")]


def test_chains_become_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200) if i != 120], "a long, b long")
    nodes = spark.range(205).withColumnRenamed("id", "doc_id")
    got = {r["doc_id"]: r["component"] for r in ngram_join.components(nodes, links).collect()}
    assert got == {i: 0 if i <= 120 else 121 if i <= 200 else i for i in range(205)}


# -- 8 ----------------------------------------------------------------------------------------------------------------
def dedup_by_hand(rows, length=100):
    seen, out = set(), []
    at = {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            else:
                seen.add(w)
        at[d, t] = gone
    for d, t in rows:
        raw, gone = np.frombuffer((t or "").encode(), np.uint8), at[d, t]
        out.append((d, len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [1000, 3, 0])
def test_suffix_dedup(spark, sf, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "BUCKET", 50)
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "ENDS", 3)
    rng = random.Random(5)
    rows = read_docs(spark, sf)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(230))
    rows += [(10_000 + i, f"{i} " * 3 + passage[rng.randrange(40) : 150 + rng.randrange(80)] + f" {i * 7}") for i in range(80)]
    rows += [(11_000 + i, passage) for i in range(30)] + [(12_000, None), (12_001, ""), (12_002, "x" * 99), (12_003, "x" * 100), (12_004, "x" * 350), (12_005, "é" * 120), (12_006, "ab" * 400), (12_007, passage + passage + "zz" + passage), (12_007, passage + passage + "zz" + passage), (None, passage[:180])]
    got = suffix_dedup.digests(suffix_dedup.with_spans(docs_of(spark, rows, True)))
    got = sorted((tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    want = dedup_by_hand(rows)
    assert [g for g, w in zip(got, want) if g != w] == [w for g, w in zip(got, want) if g != w]
    assert suffix_dedup.digests(suffix_dedup.with_spans(docs_of(spark, []))).count() == 0


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 3, (20_000, 4)).astype(np.uint64)
    keys[:9000] = keys[0]
    order = suffix_dedup.multikey_quicksort(keys)
    assert [tuple(k) + (int(i),) for k, i in zip(keys[order], order)] == sorted(tuple(k) + (i,) for i, k in enumerate(keys.tolist()))


# -- 10 ---------------------------------------------------------------------------------------------------------------
def test_class_lm(spark, sf):
    rows = read_docs(spark, sf) + [(90_001, None), (90_002, ""), (90_003, "neverseen neverseen2"), (90_001, "twice"), (90_001, "twice")]
    got = class_lm.class_lm_scores(docs_of(spark, rows), class_lm.crc_remainder(F.col("doc_id"), 7) == 2, vocab=300, lexicon=700, classes=16).collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    c = collections.Counter()
    for d, t in rows:
        if not held(d):
            c.update([*words_of(t), None])
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for d, t in rows:
        tokens = [*words_of(t), None]
        want[d, held(d), len(tokens), sum(x in c for x in tokens), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens), 6)] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    unseen = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)
    assert all(r["score"] < 0 for r in got)
    empty = docs_of(spark, [])
    assert class_lm.class_lm_scores(empty, empty["doc_id"] == 1).count() == 0


def test_class_lm_probabilities_sum_to_one(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(30))) for i in range(40)]
    df = docs_of(spark, rows)
    counts = class_lm.count_words(df)
    m = class_lm.train(df, counts, vocab=8, lexicon=12, classes=5)
    c = {bytes(r["word"]): r["c"] for r in counts.collect()}
    np.testing.assert_allclose((10.0**m.step).sum(1), 1)
    for k in range(m.step.shape[0]):
        mass = sum(10 ** m.emit[i] for i in range(len(m.cls)) if m.cls[i] == k)
        if k == 1:  # the other words: those outside the lexicon, and one share for all unseen words
            mass += sum(n + 1 for w, n in c.items() if w not in m.lexicon) / (m.other_n + m.other_v + 1)
            assert abs(mass + 1 / (m.other_n + m.other_v + 1) - 1) < 1e-9
        elif mass:
            assert abs(mass - 1) < 1e-9


def test_words_outside_the_core_find_their_classes(spark):
    """Four kinds of words take turns; with the 40 most frequent as core, each of the 200 rarer ones falls into a class of its kind."""
    rng = random.Random(12)
    kinds = [[f"{x}{i}" for i in range(10)] + [f"{x}rare{i}" for i in range(50)] for x in "abcd"]
    rows = [(d, " ".join(rng.choice(kinds[i % 4][:10] if rng.random() < 0.6 else kinds[i % 4][10:]) for i in range(100))) for d in range(200)]
    df = docs_of(spark, rows)
    got = class_lm.class_lm_scores(df, df["doc_id"] % 5 == 0, vocab=40, classes=12).where("held_out").collect()
    assert all(r["score"] > r["base_score"] + 40 for r in got)
    m = class_lm.train(df, class_lm.count_words(df), 40, 1000, 12)
    held = [{int(m.cls[m.lexicon.rows(class_lm.word_hashes([w.encode()])[0])[0]]) for w in x} for x in kinds]
    assert m.other_n == m.other_v == 0 and sum(map(len, held)) == len(set().union(*held)) and 1 not in set().union(*held)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(4)
    hidden = rng.integers(0, 4, 60)
    jump_ = rng.dirichlet(np.ones(4) * 0.2, 4)
    text, k = [], 0
    for _ in range(20_000):
        k = rng.choice(4, p=jump_[k])
        text.append(2 + rng.choice(np.flatnonzero(hidden == k)))
    text = np.array(text)
    pairs, c = np.unique(text[:-1] * 62 + text[1:], return_counts=True)

    def likelihood(cls):
        t = np.zeros((6, 6))
        np.add.at(t, (cls[pairs // 62], cls[pairs % 62]), c)
        g = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return g(t) - g(t.sum(0)) - g(t.sum(1))

    start = np.concatenate([[0, 1], 2 + np.arange(60) % 4])
    assert likelihood(class_lm.exchange(pairs, c.astype(float), 62, 6, sweeps=5)) > likelihood(start) + 100


# -- 3 ----------------------------------------------------------------------------------------------------------------
def test_language_id(spark, sf):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op3_language_id(spark, sf).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in held) >= 0.9 * len(held)
    odd = docs_of(spark, [(1, None), (2, ""), (3, "123 !?"), (4, "the and of the")])
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(language_id.labelled_rows(table, table["doc_id"] >= 0))
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(odd, model).collect()}
    assert out[1] == out[2] == out[3] == ("und", 1.0) and out[4][0] == "en"
    assert {r["lang_pred"] for r in language_id.predict(odd, None).collect()} == {"und"}
    assert language_id.train(language_id.labelled_rows(table.limit(0), table["doc_id"] >= 0)) is None


# -- 7 ----------------------------------------------------------------------------------------------------------------
def test_tiles_find_reordered_passages():
    words = lambda s: np.array([hash(w) % (1 << 62) for w in s.split()], np.uint64)
    item = "a b c d e f g h i j k l m n o p"
    doc = "x i j k l m n o p y y a b c d e f g h z"
    assert sorted(decontaminate.tiles(words(doc), words(item), 5)) == [(1, 8, 8), (11, 0, 8)]
    assert decontaminate.tiles(words("a b c d"), words(item), 5) == []
    assert decontaminate.tiles(words("a a a a a a a"), words("a a a a a"), 5) == [(0, 0, 5)]


def test_decontamination(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = {r["item_id"]: r["text"] for r in items.collect()}
    first = texts[0].split()
    half = len(first) // 2
    rows = [(1, " ".join(["lead", "in", *first[half:], "and", *first[:half]]).upper()), (2, " ".join(first[:4])), (3, None), (4, ""), (5, "one two three"), (6, texts[1]), (6, texts[1])]
    extra = spark.createDataFrame([(900, "one two three", 1), (901, None, 1), (None, "x", 1), (902, " ", 1)], "item_id long, text string, doc_id int")
    docs = docs_of(spark, rows).withColumn("items", F.col("doc_id"))
    got = {r["doc_id"]: [i["item_id"] for i in r["items"]] for r in decontaminate.decontaminate(docs, items.unionByName(extra, allowMissingColumns=True)).collect()}
    assert 0 in got[1] and got[2] == [] and got[3] == [] and got[4] == [] and got[5] == [900] and 1 in got[6]
    assert decontaminate.decontaminate(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
    flagged = {r["doc_id"] for r in queries.op7_benchmark_decontamination(spark, sf).where("contaminated").collect()}
    low = {i: " ".join(t.lower().split()) for i, t in texts.items()}
    whole = {d for d, t in read_docs(spark, sf) if any(x in " ".join((t or "").lower().split()) for x in low.values())}
    assert whole and whole <= flagged


def test_blocks_of_items_add_up(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    sets = lambda: sorted((r["doc_id"], sorted(i["item_id"] for i in r["items"])) for r in decontaminate.decontaminate(docs, items).collect())
    whole = sets()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 400)
    assert sets() == whole


# -- 4 ----------------------------------------------------------------------------------------------------------------
def test_mix_meets_its_targets(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mix.mixed(docs).collect()
    assert len(rows) == docs.count()
    cells = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in rows if r["n_tokens"]}
    tokens = collections.Counter()
    for r in rows:
        tokens[r["lang"]] += r["n_tokens"]
        assert r["n_tokens"] == len(words_of(r["text"]))
    assert abs(sum(cells.values()) - 1) < 1e-9
    aim = mix.tempered({k: v / sum(tokens.values()) for k, v in tokens.items()}, 0.5)
    for lang, share in aim.items():
        assert abs(sum(w for (s, l, t), w in cells.items() if l == lang) - share) < 1e-3
    kept = sum(r["rate"] * r["n_tokens"] for r in rows)
    assert abs(kept - 0.5 * sum(tokens.values())) < 0.01 * sum(tokens.values())
    monkeypatch.setattr(mix, "DRIVER_CELLS", 0)
    wide = {r["doc_id"]: r for r in mix.mixed(docs).collect()}
    assert all(abs(wide[r["doc_id"]]["weight"] - r["weight"]) < 1e-3 for r in rows)
    assert abs(sum(r["rate"] * r["n_tokens"] for r in wide.values()) - kept) < 0.02 * kept


def test_mix_of_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, weight string"
    rows = [(1, "aaaaaaaa b", None, None, "w"), (2, None, "en", "s", "w"), (3, "", "en", None, "w"), (None, "b b b", "en", "s", "w"), (1, "aaaaaaaa b", None, None, "w")]
    out = mix.mixed(spark.createDataFrame(rows, schema), keep=1.0).collect()
    assert len(out) == 5 and sorted(r["n_tokens"] for r in out) == [0, 0, 2, 2, 3]
    assert [r["rate"] for r in out if not r["n_tokens"]] == [0, 0] and all(r["rate"] == 1 for r in out if r["n_tokens"])
    assert mix.mixed(spark.createDataFrame([], schema)).count() == 0


# -- 5 ----------------------------------------------------------------------------------------------------------------
def test_best_fit_decreasing_is_the_plain_one():
    rng = np.random.default_rng(7)
    for capacity in (1, 2, 7, 64, 100):
        sizes = rng.integers(1, capacity + 1, 300)
        bins, room = [], []
        for i in np.argsort(-sizes, kind="stable"):
            fits = [r for r in range(len(room)) if room[r] >= sizes[i]]
            b = min(fits, key=lambda r: room[r], default=None)
            if b is None:
                bins.append([])
                room.append(capacity)
                b = len(bins) - 1
            bins[b].append(int(i))
            room[b] -= sizes[i]
        got = pack.best_fit_decreasing(sizes, capacity)
        assert len(got) == len(bins) and sorted(x for b in got for x in b) == list(range(300))
        assert sorted(sum(sizes[b]) for b in got) == sorted(sum(sizes[b]) for b in bins)


def test_pack_round_trip(spark, sf):
    import tiktoken

    ranks = pack.read_ranks(spark, f"file://{queries.TOKENIZER}")
    rows = read_docs(spark, sf) + [(7_000, None), (7_001, ""), (7_002, "<|endoftext|> ünï 漢字 " * 900), (7_003, "a"), (None, "no id")]
    length = 512
    got = pack.pack(docs_of(spark, rows), ranks, pack.PATTERN, length).collect()
    enc = tiktoken.Encoding("t", pat_str=pack.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = collections.defaultdict(dict)
    for r in got:
        ids = np.frombuffer(r["ids"], f"<u{r['id_bytes']}")
        assert len(ids) == length and r["cu_seqlens"][-1] == r["n_tokens"] and (ids[r["n_tokens"] :] == max(ranks.values()) + 1).all()
        pos = pack.positions(r["cu_seqlens"], r["resets"], length)
        for a, z, s, d, p in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["resets"], r["doc_ids"], r["parts"]):
            pieces[d][p] = ids[a:z].tolist()
            assert s == p * length and pos[a:z].tolist() == list(range(s, s + z - a))
    assert {d: sum((x[p] for p in sorted(x)), []) for d, x in pieces.items()} == {d: enc.encode_ordinary(t) for d, t in rows if t}
    assert pack.pack(docs_of(spark, []), ranks, pack.PATTERN).count() == 0


# -- 1 ----------------------------------------------------------------------------------------------------------------
def nearest_by_hand(rows, every, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            near = sorted(((-float(q @ v), j) for j, v in good if j != i and len(v) == len(q)))[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def test_hnsw(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = collections.defaultdict(list)
    for r in queries.op1_hnsw_search(spark, sf).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    want = nearest_by_hand(rows, 20, 20)
    assert set(got) == set(want) and all([x[2] for x in v] == list(range(1, 21)) for v in got.values())
    hits = sum(len({x[0] for x in got[q]} & {x[0] for x in want[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want)
    exact = {(q, j): s for q, near in want.items() for j, s in near}
    assert all(abs(exact[q, j] - s) < 1e-12 for q, v in got.items() for j, s, _ in v if (q, j) in exact)


def test_hnsw_recall_over_shards_and_layers(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 24))
    v = (centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 24))).astype(np.float32)
    v *= rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = hnsw.nearest(df, df["vec_id"] % 20 == 0, 10, shard_rows=1000).collect()
    exact = v.astype(np.float64) @ v.astype(np.float64).T
    np.fill_diagonal(exact, -np.inf)
    top = np.argsort(-exact, 1)[:, :10]
    assert sum(r["vec_id"] in top[r["query_id"]] for r in got) >= 0.9 * len(got) and len(got) == 1500


def test_hnsw_of_odd_vectors(spark):
    rng = random.Random(9)
    hot = [1.0, 2.0, 0.0]
    rows = [(i, hot) for i in range(60)] + [(60 + i, [rng.random() for _ in range(3)]) for i in range(40)]
    rows += [(100, None), (101, []), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 2.0]), (104, [float("nan"), 1.0, 1.0]), (105, [float("inf"), 1.0, 1.0]), (106, [1.0, 1.0]), (None, hot), (120, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in hnsw.nearest(df, df["vec_id"] % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = nearest_by_hand(rows, 20, 20)
    assert {q: [j for j, _ in v] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}
    assert hnsw.nearest(df.limit(0), df["vec_id"] % 20 == 0).count() == 0


def test_copies_do_not_starve_a_language(spark):
    """Copies of a few texts neither drive other texts of their language from the sample nor the language from the model."""
    few = spark.createDataFrame([("el tiempo pasa y nada queda",), ("la casa de mi padre",), ("los niños juegan",)], "text string")
    copies = few.crossJoin(spark.range(3000)).select("text", F.lit("es").alias("lang"))
    other = spark.createDataFrame([(f"the house of number {i} and the time", "en") for i in range(60)] + [("the same again",  "en")] * 4000, "text string, lang string")
    assert language_id.train(copies, sample=5) is not None  # no row of the only language was left
    m = language_id.train(copies.union(other), sample=5)
    assert m.langs == ["en", "es"]
    got = language_id.predict(few, m).collect()
    assert {r["lang_pred"] for r in got} == {"es"}
    held = language_id.least_hashes(copies.union(other), 10).collect()
    assert collections.Counter(r["lang"] for r in held) == {"es": 3, "en": 10} and len({r["text"] for r in held}) == 13


# -- pipeline ---------------------------------------------------------------------------------------------------------
def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    odd = [(9_000, None, None, None, 0), (9_001, "", "en", "s", 0), (9_002, "123 456", "en", "s", 7)]
    at = spark.createDataFrame([tuple(r) for r in docs] + odd, schema)
    by_lang = p.by_language(spark, at, sf)
    kept = [tuple(r) for r in by_lang.collect()]
    assert {r[0] for r in kept} == {r["doc_id"] for r in docs}
    unique = p.one_of_each_group(spark, by_lang, sf)
    groups = components_by_hand([(r[0], r[1]) for r in kept], 5, 80)
    assert {r["doc_id"] for r in unique.collect()} == {c for _, _, c in groups} and unique.columns == at.columns
    clean = p.without_benchmarks(spark, unique, sf)
    assert clean.columns == at.columns and clean.count() < unique.count()
    sampled = p.to_target_mix(spark, clean, sf)
    assert 0 < sampled.count() < clean.count() and sampled.columns == at.columns
    packed = p.to_packed_ids(spark, sampled, sf).collect()
    assert {d for r in packed for d in r["doc_ids"]} == {r["doc_id"] for r in sampled.collect()}


def test_language_cut_is_above_chance(spark, sf, monkeypatch):
    """With two learned languages, a call at 0.55 goes and one at 0.65 stays."""
    import corpus_pipeline as p

    model = language_id.Model(["de", "en"], None, None, None, 1.0, 15)
    monkeypatch.setattr(language_id, "train", lambda *a, **b: model)
    monkeypatch.setattr(language_id, "predict", lambda docs, *a: docs.withColumn("lang_pred", F.lit("en")).withColumn("score", F.when(F.col("doc_id") == 1, 0.55).otherwise(0.65)))
    docs = spark.createDataFrame([(1, "co to jest", "en"), (2, "what is this", "en")], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in p.by_language(spark, docs, sf).collect()] == [2]


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_listed_tokens_of_similar_sets_meet(percent):
    """The first p tokens from rare to frequent have one in common whose ranks leave room for what must be shared, and neither the
    further orders nor the parities rule the pair out, for sets at the very threshold."""
    rng = random.Random(6)
    for _ in range(400):
        common = rng.randrange(1, 60)
        apart = common * 100 // percent - common
        left = rng.randrange(apart + 1)
        tokens = rng.sample(range(1, 10**6), common + apart)
        x, y = set(tokens[: common + left]), set(tokens[:common] + tokens[common + left :])
        df = {t: rng.randrange(1, 5) for t in tokens}
        need = -(-(len(x) + len(y)) * percent // (100 + percent))
        kept = []
        for s in (x, y):
            ranked = sorted(s, key=lambda t: (df[t], t))[: ngram_join.prefix_size(len(s), percent)]
            kept.append({t for rank, t in enumerate(ranked) if len(s) - rank >= need})
        assert kept[0] & kept[1]
        a, b = (ngram_join.splitmix(np.array(sorted(s), np.uint64)) for s in (x, y))
        keys, bits = [ngram_join.order_keys(s, percent) for s in (a, b)], [ngram_join.parities(s) for s in (a, b)]
        assert ngram_join.differences(*bits) <= apart
        assert ngram_join.possible(len(a), len(b), *keys, *bits, percent)


def test_class_lm_score_by_hand(spark):
    """Every word has a class: the score is the sum of log10 P(class | class before) + log10 P(word | class), token by token."""
    rng = random.Random(21)
    rows = [(d, " ".join(f"w{min(rng.randrange(1, 400), rng.randrange(1, 400))}" for _ in range(rng.randrange(60)))) for d in range(120)] + [(500, None), (501, "neverseen w1"), (500, "w1 w2")]
    df = docs_of(spark, rows)
    out = rng.randrange(5)
    marked = df.withColumn("held_out", df["doc_id"] % 5 == out)
    got = class_lm.class_lm_scores(df, df["doc_id"] % 5 == out, vocab=30, lexicon=60, classes=8).collect()
    training = marked.where("not held_out")
    counts = class_lm.count_words(training)
    model = class_lm.train(training, counts, 30, 60, 8, 3)
    c = {bytes(r["word"]): r["c"] for r in counts.collect()}
    tail = {}
    for r in class_lm.tail_words(training, model, 3, 3).collect():
        tail |= dict(zip(np.frombuffer(r["keys"], np.uint64).tolist(), zip(np.frombuffer(r["counts"], np.int64).tolist(), np.frombuffer(r["cls"], np.uint16).tolist())))
    cls = {}
    for w, n in c.items():
        h = class_lm.word_hashes([w])[0]
        at = int(model.lexicon.rows(h)[0])
        cls[w] = int(model.cls[at]) if at > 0 else tail[int(h[0])][1]
        assert at > 0 or tail[int(h[0])][0] == n
        assert (cls[w] == 1) == (n < 3)
    assert len(tail) == len(c) - len(model.lexicon) > 50
    mass, others = collections.Counter(), sum(x == 1 for x in cls.values())
    for w, n in c.items():
        mass[cls[w]] += n
    table = np.zeros((8, 8))
    chain = lambda t: [0, *(cls.get(w, 1) for w in words_of(t)), 0]
    for d, t in rows:
        if d % 5 != out:
            for a, b in zip(chain(t)[:-1], chain(t)[1:]):
                table[a, b] += 1
    prior = (table.sum(0) + 1) / (table.sum() + 8)
    step = np.log10((table + 5 * prior) / (table.sum(1, keepdims=True) + 5))
    want = []
    for d, t in rows:
        total = sum(step[a, b] for a, b in zip(chain(t)[:-1], chain(t)[1:]))
        for w in words_of(t):
            total += math.log10(c[w] / mass[cls[w]]) if cls.get(w, 1) > 1 else math.log10((c.get(w, 0) + 1) / (mass[1] + others + 1))
        want.append((d, round(total, 6)))
    assert sorted((r["doc_id"], round(r["score"], 6)) for r in got) == sorted(want)


def test_columns_that_clash_with_internal_names(spark):
    names = ["_h", "_p", "_v", "__h", "_lang", "_source", "_topic", "_shard", "_b", "_bucket", "_own", "_before", "_rows"]
    extra = [F.lit(i).alias(n) for i, n in enumerate(names)]
    docs = spark.createDataFrame([(1, "some words here", "en", "a"), (2, "noch mehr", None, None), (2, "noch mehr", None, None), (3, "x " * 50_000, "en", "a"), (4, None, "de", "b")], "doc_id long, text string, lang string, source string").select("*", *extra)
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    pages = docs.withColumn("url", F.lit("http://a.org/x"))
    for out in (url_filter.judge(pages, rules), mix.mixed(docs), jump_shards.with_slots(jump_shards.assign_shards(docs, "doc_id", 3), "shard", ["doc_id"], 4), language_id.identify(docs, F.lit(True))):
        assert out.count() == 5 and set(names) < set(out.columns)
        assert [tuple(r) for r in out.select(*names).distinct().collect()] == [tuple(range(len(names)))]


def test_raking_in_frames_is_the_driver_s(spark):
    rng = random.Random(8)
    cells = [(f"s{i}", f"l{j}", f"t{k}", rng.randrange(1, 500)) for i in range(4) for j in range(3) for k in range(5) if rng.random() < 0.8]
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    aims = {"source": {f"s{i}": 1.0 + i for i in range(4)}, "lang": {f"l{i}": 1.0 for i in range(3)}, "topic": {f"t{i}": 2.0 for i in range(4)}}
    table = frame.toPandas()
    by_hand = dict(zip(zip(table["source"], table["lang"], table["topic"]), mix.rake(table, aims)))
    got = mix.rake_frame(frame, {d: spark.createDataFrame(list(t.items()), f"{d} string, aim double") for d, t in aims.items()}).collect()
    total = sum(r["weight"] for r in got)
    assert all(abs(r["weight"] / total - by_hand[r["source"], r["lang"], r["topic"]]) < 1e-6 for r in got)
    assert sum(x > 0 for x in by_hand.values()) == len(got)
