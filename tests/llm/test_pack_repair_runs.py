"""Packing by minimum bin slack, repair of conversations and periodic runs against plain versions of their contracts."""

import collections
import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskspace.llm import conversation_repair, queries, runs, slack_pack

SPACES = " \t\n\x0b\f\r"


def rows_of(spark, sf, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*columns).collect()]


# -- 11 ---------------------------------------------------------------------------------------------------------------
def test_fullest_combination_is_the_fullest():
    rng = random.Random(1)
    for _ in range(200):
        room = rng.randrange(1, 40)
        counts = [0] * (room + 1)
        for _ in range(rng.randrange(1, 20)):
            counts[rng.randrange(1, room + 1)] += 1
        sums = {0}
        for x, n in enumerate(counts):
            for _ in range(n):
                sums |= {s + x for s in sums if s + x <= room}
        held = slack_pack.fullest(counts, [x for x in range(room, 0, -1) if counts[x]], room)
        assert sum(x * n for x, n in held.items()) == max(sums) and all(n <= counts[x] for x, n in held.items())


def test_plan_takes_every_piece_and_its_size_is_that_of_the_lengths():
    rng = random.Random(2)
    for pieces in (500, 5_000_000):
        counts = collections.Counter(min(4096, max(1, int(rng.lognormvariate(5.5, 1)))) for _ in range(5000))
        counts = {x: n * pieces // 5000 + 1 for x, n in counts.items()}
        plan = slack_pack.plan(counts, 4096)
        got = collections.Counter()
        for times, held in plan:
            assert sum(x * n for x, n in held.items()) <= 4096
            got.update({x: n * times for x, n in held.items()})
        assert got == counts and len(plan) < 6000
        assert sum(t for t, _ in plan) <= 1.01 * -(-sum(x * n for x, n in counts.items()) // 4096) + 1


def packed_right(got, rows, capacity, tokenizer):
    want = collections.Counter()
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[a : a + capacity], "<u4")
            want[doc_id, k, a, len(own), zlib.crc32(own.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by), -(-sum(r["length"] for r in got) // capacity)


def test_packing(spark, sf):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.WORD_TOKENIZER)
    sequences, bound = packed_right(queries.op11_min_bin_slack(spark, sf).collect(), rows_of(spark, sf, "documents", "doc_id", "text"), 4096, tokenizer)
    assert sequences <= bound + 1
    rng = random.Random(3)
    odd = [None, "", " \n\t ", "<|endoftext|>", "a<|endoftext|>. b", "it's  IT'S we'll", "é ́x a\xa0b c​d", "\x1c\x1d x\x0bb\x0cc\x85d", "İstanbul ǅ \xdf", "1234 5.", "日本語", "a.b, c.. d", "word " * 30_000, "x" * 5000]
    odd += ["".join(rng.choice("aaBb..,,1'<|> \t\n\r\x0b́\xe9日st ll") for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [*enumerate(odd), (None, "no id"), (1, "again"), (1, "again")]
    df = spark.createDataFrame([(i, t, 7, "x", 1) for i, t in rows], "doc_id long, text string, length long, task string, before int").repartition(5)
    vocabulary = slack_pack.read_vocabulary(spark, f"file://{queries.WORD_TOKENIZER}")
    for capacity in (4096, 16, 1):
        packed_right(slack_pack.pack(df, vocabulary, capacity).collect(), rows if capacity > 1 else rows, capacity, tokenizer)
    assert slack_pack.pack(df.limit(0), vocabulary).count() == 0


# -- 12 ---------------------------------------------------------------------------------------------------------------
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def repaired_by_hand(rows):
    """rows: (turn, role, text) in order. Cheapest edits first, then least audit."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(SPACES)
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    todo, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, kept = heapq.heappop(todo)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            break
        for role in ("user", "assistant"):
            if (state, role[0]) in STEP:
                heapq.heappush(todo, (cost + 3, audit + "I", i, STEP[state, role[0]], (*kept, f"{role}:")))
        if i < len(rows):
            _, role, text = rows[i]
            extra = 3 * (faults[i] == "t")
            heapq.heappush(todo, (cost + 4, audit + "D", i + 1, state, kept))
            if faults[i] not in ("b", "d"):
                for own, letter, price in ((role, "K", 0), ("user", "R", 3), ("assistant", "R", 3)):
                    if (state, own[:1]) in STEP:
                        heapq.heappush(todo, (cost + price + extra, audit + letter, i + 1, STEP[state, own[:1]], (*kept, f"{own}:{text}")))
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()


def damaged_by_hand(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        own = out[conv]
        k = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            text = "" if k == 1 else text.translate(str.maketrans("", "", ".!?")) if k == 2 else text
            own += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return {c: repaired_by_hand(sorted(v, key=lambda r: (r[0] is not None, r[0] or 0))) for c, v in out.items()}


def repaired_rows(df):
    found = conversation_repair.with_sha256(*conversation_repair.repair_parts(queries.damaged(df), F.col("there"))).collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: tuple(r)[1:] for r in found}


def test_repair_query(spark, sf):
    got = queries.op12_conversation_repair(spark, sf).collect()
    want = damaged_by_hand(rows_of(spark, sf, "conversations", "conv_id", "turn", "role", "text"))
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want


def odd_conversations():
    rng = random.Random(4)
    rows = {}
    for c in range(150):
        for t in range(rng.randrange(1, 9)):
            turn = rng.choice([None, t, t, t, t + 5])
            rows[c, turn] = (c or None, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice([f"a{t}.", f"b{t}", "", " \n", "same!", None, f"q{t}?"]))
    rows |= {("long", t): (1000, t, ("user", "assistant")[t % 2], f"turn {t % 70}.") for t in range(600)}
    rows["wide", 0] = (1001, 0, "user", "word " * 50_000)
    return list(rows.values())


@pytest.mark.parametrize("limit", [4096, 3, 1])
def test_blocks_repair_as_whole_conversations_do(spark, monkeypatch, limit):
    monkeypatch.setattr(conversation_repair, "LONG_ROWS", limit)
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "conv_id long, turn long, role string, text string, block int, tie string")
    assert repaired_rows(df) == damaged_by_hand(rows)


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repair(df).count() == 0
    gone = spark.createDataFrame([(7, 0, "user", "Hi.")], df.schema)
    row = conversation_repair.repair(gone, F.lit(False)).first()
    assert (row["conv_id"], row["gaps"], row["illegal"], row["cost"], row["audit"], row["messages"]) == (7, 0, 0, 0, "", [])
    same = spark.createDataFrame([(7, 0, "user", "Hi.")] * 3 + [(7, None, "assistant", "Ho!")], df.schema)
    row = conversation_repair.repair(same).first()
    assert (row["duplicate"], row["audit"], row["cost"]) == (2, "IKKDDI", 14)


# -- 13 ---------------------------------------------------------------------------------------------------------------
def runs_by_hand(w, least=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            part = w[a : i + q]
            if i > a and len(part) >= max(least, 2 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((a, len(part), q))
            i = max(i, a + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_by_hand():
    rng = random.Random(5)
    for _ in range(1500):
        n, k = rng.randrange(0, 60), rng.choice([1, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), 1 + rng.randrange(max(1, n // 2))
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        for least in (2, 12):
            assert runs.runs_of(w, least) == runs_by_hand(w, least), (w, least)
        assert next(runs.found_in([" ".join("abcde"[x] for x in w).encode()]))[1] == runs_by_hand(w), w


def test_hashes_that_collide_are_found_out(monkeypatch):
    """With every hash the same, what the hashes find is still compared word by word, so that no run is too long."""
    monkeypatch.setattr(runs.Lce, "_same", lambda self, i, j, size: True)
    w = [*range(40), *range(40), 7, *range(13)] * 2
    assert all(w[s + q : s + n] == w[s : s + n - q] for s, n, q in runs.runs_of(w))


def digest_of(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w and doc_id is not None:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = runs_by_hand(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    text = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return len(found), *first, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()


def test_runs_query(spark, sf):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, sf).collect()}
    want = {i: digest_of(i, t) for i, t in rows_of(spark, sf, "documents", "doc_id", "text") if len((t or "").split()) < 1500}
    assert {i: got[i] for i in want} == want


def test_runs_of_odd_texts(spark, tmp_path):
    texts = [None, "", " \n ", "a", "A a " * 20, "a\xa0b c " * 9, "la " * 60_000, " ".join(map(str, range(30_000))) + " x y" * 10]
    rows = [(i, t, 1, "mine") for i, t in enumerate(texts)] + [(None, "a " * 30, 1, ""), (3, "a", 1, ""), (3, "a", 1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string")
    got = runs.with_runs(df).collect()
    assert len(got) == len(rows) and all(r["runs"] == [] and r["collapsed"] == "" for r in got if r["text"] in (None, "", " \n "))
    by = {r["text"]: r for r in got}
    assert [tuple(x) for x in by["la " * 60_000]["runs"]] == [(0, 60_000, 1)] and by["la " * 60_000]["collapsed"] == "la"
    assert [tuple(x) for x in by["A a " * 20]["runs"]] == [(0, 40, 2)] and by["A a " * 20]["collapsed"] == "A a"
    assert [tuple(x) for x in by[texts[-1]]["runs"]] == [(30_000, 20, 2)]
    df.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_periodic_runs(spark, str(tmp_path)).count() == 0
    spark.createDataFrame([(i, t) for i, t, *_ in rows if t is None or len(t) < 1000], "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect():
        if r["doc_id"] not in (None, 3):
            assert tuple(r)[1:] == digest_of(r["doc_id"], texts[r["doc_id"]])


# -- mended operators -------------------------------------------------------------------------------------------------
def test_words_of_one_count_are_not_dropped_together(spark):
    from taskspace.llm import class_lm

    words = [(f"w{i}".encode(), 5) for i in range(1200)] + [(f"v{i}".encode(), 9) for i in range(10)]
    df = spark.createDataFrame(words, "word binary, c long")
    for most, want in ((1000, 1000), (10, 10), (11, 11), (5, 5), (1210, 1210), (5000, 1210), (None, 1210)):
        keys, c = class_lm._head(df, most, 1)
        assert len(keys) == len(set(keys.tolist())) == want and (c[:10] == 9).all()
    again = class_lm._head(df.repartition(7), 1000, 1)
    assert (again[0] == class_lm._head(df, 1000, 1)[0]).all()


def test_blocks_of_texts_are_bounded(spark, monkeypatch):
    import pyarrow as pa

    from taskspace.llm import class_lm

    monkeypatch.setattr(class_lm, "BLOCK_BYTES", 100)
    texts = ["a b " * 10, None, "", "c " * 200, "d", "e " * 30]
    found = list(class_lm._blocks(pa.record_batch({"text": pa.array(texts)})))
    assert [x for part, _, _ in found for x in part["text"].to_pylist()] == texts
    assert all(part.num_rows == 1 or sum(len(x or "") for x in part["text"].to_pylist()) <= 100 for part, _, _ in found)
    assert [int(n) for _, _, ends in found for n in np.diff(ends, prepend=0)] == [len((x or "").split()) for x in texts]


def test_long_hosts_are_judged_at_once(spark):
    from taskspace.llm import url_filter

    host = ".".join("ab" for _ in range(40_000))
    urls = [f"http://{host}.example.org/es/x", f"http://{host}.com/fr/", f"http://{host}/", "http://" + "." * 5000 + "org/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()}
    assert got == {0: ("example.org/es/", "block"), 1: ("com/fr/", "allow"), 2: (None, "allow"), 3: ("org/", "allow")}
