"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import time

from taskspace.operators import content
from taskspace.plans import registry
from taskspace.session import session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["expr_arith", "expr_floor_mod", "fmt_resolve", "str_find_count", "str_split_join", "list_ops", "list_aggs", "regex_suite", "range_compress", "chunk_static", "chunk_contiguous", "space_product", "manifest_from_docs", "manifest_diff", "manifest_compose", "cache_sync_plan", "param_merge", "directive_parse", "action_status_fold", "path_props", "xxh_hash"]


def timed(run) -> float:
    """The median of three runs after one to warm up, each writing every row to nowhere."""
    took = []
    for _ in range(4):
        t = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - t)
    return round(statistics.median(took[1:]), 3)


def main() -> None:
    spark = session("bench", master=f"local[{CPUS}]", shuffle_partitions=int(CPUS), spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = {n: timed(lambda n=n: registry.QUERIES[n](spark, SF)) for n in NAMES}
    docs = registry.table(spark, SF, "documents").select("text").repartition(int(CPUS)).cache()
    size = docs.selectExpr("sum(octet_length(text))").first()[0] / 1e6
    hashing = timed(lambda: docs.select(content.hash_text(docs["text"]).alias("h")))
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf"), "hash_mb_per_s": round(size / hashing, 1)}))


if __name__ == "__main__":
    main()
