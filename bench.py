"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from engram.catalog import all_queries
from engram.session import local_session, release

HEADLINE = ["w_01", "c_09", "sc_07", "sc_15", "sc_39", "sc_43", "sc_51", "flt_02", "a_01", "a_13", "a_15", "w_12", "j_03", "j_05", "j_06", "c_04",
            "ex_05", "g_02", "g_05", "g_10", "st_06_sliding", "p_01", "p_03", "p_05"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    # small local inputs: let shuffles keep enough partitions for every core
    spark = local_session(cores, int(cores) * 2, **{"spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"})
    queries = all_queries()
    queries["a_01"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    seconds = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        release(spark)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
