"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line (cold and warm seconds, warm ones count)."""

import json
import os
import time

from pyspark.sql import SparkSession

from gridloom.queries import QUERIES

HEADLINE = ["reduce_sparse_sum_by_k", "reduce_sparse_sum_by_ij", "reduce_sparse_var_by_k", "reduce_dense_which_max_by_k", "sparse_plus_sparse", "voxel_apply_median", "slice_apply_median", "pack_int16", "codec_dense_int16_little", "reorient_turn_dense", "events_sum_by_day"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for name in HEADLINE:
        for times in (cold, warm):
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
