"""Headline queries on $BENCH_SF_DIR, local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from visitframe.plans.catalog import CATALOG
from visitframe.session import local_session

QUERIES = [
    "code_prob_r2", "code_triples", "frequent_codes", "stay_codes", "trim", "discretized",
    "token_table", "roundtrip", "sequence_model", "ngram_4", "ngram_compare", "tfidf", "rouge",
    "corr_ffill", "features", "auroc", "vector_nnaa", "prdc",
    "nearest_record", "record_nnaa", "code_statistics_r2", "identifiability",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = local_session(cpus, "visitframe-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in QUERIES:
        start = time.perf_counter()
        CATALOG[name].plan(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
