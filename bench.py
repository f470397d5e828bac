"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from rankflow.operators import compose, ordering
from rankflow.queries import QUERIES
from rankflow.seq import Seq
from rankflow.session import session

HEADLINE = [
    "transform_unary", "transform_zip", "for_each_axpy", "reverse", "rotate", "stable_partition", "reduce_sum", "reduce_ordered", "dot_product", "histogram",
    "vec_plus", "scan_sum", "scan_max", "is_sorted", "minmax_element", "stable_sort", "merge", "shuffle_seeded", "fork_join_tuple", "workhint_tree",
]


def timed(make, repeats: int) -> float:
    """Median seconds of whole runs after one warm-up; results are computed and thrown away."""
    took = []
    for _ in range(repeats + 1):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return statistics.median(took[1:])


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = session("bench", spark__master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    found = {name: timed(lambda f=QUERIES[name]: f(spark, sf_dir), repeats) for name in HEADLINE}
    # the two workloads with a published size: a sort of 1,048,576 integers, and 10 queens
    ints = Seq(spark.range(1 << 20).selectExpr("id as pos", "cast(hash(id) as int) as value"), length=1 << 20)
    found["sort_1m_ints"] = timed(lambda: ordering.sort(ints).df, repeats)
    found["nqueens_10"] = timed(lambda: compose.nqueens(spark, 10), repeats)
    spark.stop()
    print(json.dumps({"metric": "median seconds of all headline queries, summed", "value": round(sum(found.values()), 3), "unit": "sec", "queries": {k: round(v, 3) for k, v in found.items()}, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
