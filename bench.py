"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tripleweave import plans

NAMES = ["flagship", "bgp_star", "bgp_chain", "bgp_multi_candidate", "optional", "minus", "exists", "path_seq", "path_plus", "aggregates", "group_concat", "rdf_quads"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times, planned = plans.queries(), {}, {}
    for name in NAMES:
        best = []
        for _ in range(2):  # the first run warms up
            t = time.perf_counter()
            df = queries[name](spark, sf)
            p = time.perf_counter() - t
            df.write.format("noop").mode("overwrite").save()
            best.append((time.perf_counter() - t, p))
        times[name], planned[name] = (round(x, 3) for x in best[-1])
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "planning": planned, "sf": sf}))


if __name__ == "__main__":
    main()
