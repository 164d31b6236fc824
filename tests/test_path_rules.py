"""Path rules as a table against the plain rules."""

import random

import pytest

from taskspace.functions import paths


@pytest.mark.parametrize("fmt", ["POSIX", "WINDOWS"])
def test_rules_of_a_table_are_the_plain_ones(spark, fmt):
    rng = random.Random(7)
    word = lambda: rng.choice(["a", "B", "b", "é", "É", "c.d"])
    rules = []
    for i in range(60):
        kind = rng.choice(["POSIX", "WINDOWS", "URI"])
        steps = [word() for _ in range(rng.randrange(0, 4))]
        if kind == "URI":
            source = rng.choice(["s3://b", "S3://B", "file://"]) + "".join("/" + s for s in steps) + rng.choice(["", "", "/"])
        else:
            source = rng.choice(["/", "", "\\" if kind == "WINDOWS" else "/"]) + rng.choice(["/", "\\" if kind == "WINDOWS" else "//"]).join(steps) + rng.choice(["", "/"])
        rules.append((kind, source, f"{rng.choice(['/to', 'D:', 'x/', 's3://n'])}{i}", i))
    rules = [r for r in rules if r[1]]
    cases = [None, "", "/", "a", "s3://b", "no://"]
    for _ in range(400):
        head = rng.choice(["/", "", "\\", "s3://b/", "S3://b", "file:///", "//"])
        cases.append(head + "".join(word() + rng.choice(["/", "/", "\\", "//"]) for _ in range(rng.randrange(0, 5))) + rng.choice(["", word()]))
    cases.append("/a" * 5000)
    table = spark.createDataFrame([*rules, ("POSIX", None, "/x", 1), (None, "/a", "/x", 1)], "source_format string, source string, destination string, position int")
    plain = paths.longest_first([paths.Rule(*r[:3]) for r in rules])
    df = spark.createDataFrame([(i, p, "mine") for i, p in enumerate(cases * 2)], "i long, p string, mapped string")
    got = paths.map_by_rules(df, "p", table, fmt=fmt).collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        assert r["mapped"] == (None if r["p"] is None else paths.apply_rules(r["p"], plain, fmt)), r["p"]
    assert {r["mapped"] for r in paths.map_by_rules(df, "p", table.limit(0)).collect()} == set(cases)
    plan = paths.map_by_rules(df, "p", table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_path_rules_query(same_as_sql):
    same_as_sql("path_rules")
