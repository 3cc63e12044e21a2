"""Times the headline queries: one JSON line. The second run of each counts."""

import json
import os
import time

from pyspark.sql import SparkSession

from quillon import registry

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["profile_numeric", "summary_stats", "missing_values", "cardinality", "top_values", "patterns", "distributions", "outliers_iqr", "outliers_zscore", "corr_pearson", "corr_spearman", "drift_numeric", "quality_score", "dup_summary", "dedup_first", "key_composite", "fill_auto", "fill_ffill", "label_encode", "auto_cast", "load_upsert_changed", "load_scd2", "load_cdc_soft"]

if __name__ == "__main__":
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    made, out = registry.queries(), {}
    for name in NAMES:
        took = []
        for _ in range(2):
            t = time.perf_counter()
            made[name](spark, SF).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t)
        out[name] = round(took[-1], 3)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": SF}))
