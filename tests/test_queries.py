"""Registered queries against their SQL, on the smallest tables."""

import pytest

from taskspace.plans import registry


@pytest.mark.parametrize("name", ["json_canonical", "manifest_encode", "manifest_round_trip", "str_index", "path_edits", "range_lists", "manifest_compose_diffs", "manifest_compose", "manifest_diff", "expr_compare_chain"])
def test_queries_equal_their_sql(same_as_sql, name):
    same_as_sql(name)


def test_no_oracle_is_without_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_list_slice_index_keeps_the_sign_of_what_rounds_to_zero(spark, tmp_path):
    """As text, since -0.0 equals 0.0 as a number: values about half of the last decimal, ties, zeros of both signs."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = [[-1e-7, 1e-7, -4.9e-7, -5.1e-7, 4.9e-7, 5.1e-7, -0.0, 0.0], [0.0078125, -0.0078125, -1e-45, -1.5, float("inf"), float("-inf"), float("nan"), 3e38], [-1e-7, None, -0.0], None]
    path = f"{tmp_path}/embeddings.parquet"
    pq.write_table(pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32()))}), path)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}'")
    want = con.execute(registry.ORACLES["list_slice_index"]).fetchall()
    got = [tuple(r) for r in registry.QUERIES["list_slice_index"](spark, str(tmp_path)).collect()]
    assert "-0.0" in repr(want) and sorted(map(repr, got)) == sorted(map(repr, want))
