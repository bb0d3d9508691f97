"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1); BENCH_CPUS: cores (default all).
Every query is run to the end (rows go to the noop sink).  ``fused_profile`` and
``one_job_per_rule`` compute the same metrics of lineitem, the latter with one
job per rule, which is how checks are usually scripted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tablemend.functions import predicates as P  # noqa: E402
from tablemend.model import ColumnRule  # noqa: E402
from tablemend.operators.profile import expand, profile  # noqa: E402
from verification.catalog import load_all  # noqa: E402

HEADLINE = [
    "profile_completeness_lineitem",
    "profile_row_duplicates",
    "profile_key_duplicates",
    "profile_dataset",
    "validate_conditions",
    "validate_medications",
    "fk_orphans_null_counts",
    "fk_orphans_nonnull_ci",
    "fk_orphans_star",
    "event_after_parent_date",
    "shipped_before_ordered",
    "semantic_suggested_codes",
    "inject_conditions",
    "correct_table_conditions",
    "repair_fk_chained_conditions",
    "correct_and_repair_conditions",
    "post_correction_metrics",
    "report_dimension_pct",
]


def session(cpus: str) -> SparkSession:
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def drain(df) -> None:
    df.write.mode("overwrite").format("noop").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "*"))
    catalog = load_all()
    # Start-up of the session and its code paths is not part of any query.
    drain(catalog["domain_violations"].run(spark, sf_dir))

    times = {name: timed(lambda: drain(catalog[name].run(spark, sf_dir))) for name in HEADLINE}

    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rules = expand(lineitem, [ColumnRule("7S", "missing", P.is_null), ColumnRule("6", "empty", P.null_or_empty)])
    times["fused_profile"] = timed(lambda: profile(lineitem, "lineitem", rules).collect())
    times["one_job_per_rule"] = timed(lambda: [profile(lineitem, "lineitem", [r]).collect() for r in rules])

    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(times[n] for n in HEADLINE), 3),
        "unit": "sec",
        "queries": {name: round(t, 3) for name, t in times.items()},
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
