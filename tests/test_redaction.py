"""Redaction of a batch against the plain rule, line by line."""

import random

from taskspace.streaming import directives as d


def shown_by_hand(rows):
    """rows: (session, seq, line)."""
    out = []
    for s, n, line in rows:
        values, whole = [], []
        for s2, n2, x in rows:
            if s2 == s and n is not None and (n2 is None or n2 < n) and x and x.startswith(f"{d.PREFIX}redacted_env: "):
                payload = x.removeprefix(f"{d.PREFIX}redacted_env: ")
                v, ls = d.secrets_of(payload.partition("=")[2] if "=" in payload else None, payload)
                values, whole = values + v, whole + ls
        secret = line is not None and line.startswith(f"{d.PREFIX}redacted_env: ")
        out.append((s, n, None if line is None else d.redact_env_line(line, line.removeprefix(f"{d.PREFIX}redacted_env: ")) if secret else line if n is None else d.redact(line, values, whole)))
    return out


def shown(spark, rows):
    df = spark.createDataFrame(rows, "session_id string, seq long, line string")
    return [(r["session_id"], r["seq"], r["shown"]) for r in d.redacted(d.parse(df)).collect()]


def test_redaction_is_the_plain_one(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for s in ("a", "b", None, "none"):
        for n in range(60):
            text = "".join(rng.choice("abé ") for _ in range(rng.randrange(1, 12))).strip() or "x"
            secret = s != "none" and rng.random() < 0.2
            rows.append((s, n, f"{d.PREFIX}redacted_env: T={text[:3]}" if secret else f"say {text}"))
    rows += [("a", 100, None), ("a", None, "say aba"), ("a", 101, "say aba"), ("a", 101, "say aba"), ("b", -5, "say aba"), (None, None, f"{d.PREFIX}redacted_env: T=a")]
    for size in (1 << 14, 4):
        monkeypatch.setattr(d, "LINES", size)
        assert sorted(shown(spark, rows), key=repr) == sorted(shown_by_hand(rows), key=repr)
    assert shown(spark, [("q", 1, "plain")]) == [("q", 1, "plain")]


def test_thousands_of_secrets_in_one_session(spark):
    rows = [("s", i, f"{d.PREFIX}redacted_env: T{i}=secret{i:05d}") for i in range(5000)] + [("s", 5000 + i, f"has secret{i:05d} and secret{4999 - i:05d}!") for i in range(5000)]
    got = {n: x for _, n, x in shown(spark, rows)}
    assert all(got[5000 + i] == f"has {d.MASK} and {d.MASK}!" for i in range(5000)) and got[3] == f"{d.PREFIX}redacted_env: T3={d.MASK}"


def test_redaction_query(same_as_sql):
    same_as_sql("redact_lines")
