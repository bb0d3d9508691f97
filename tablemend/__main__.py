"""The steps of a quality run from the command line.

    python -m tablemend inject   <originals> <corrupted>
    python -m tablemend profile  <base> <metrics> [--layout formats|files|parts]
    python -m tablemend validate <base> <metrics> --as-of 2025-01-01
    python -m tablemend repair   <corrupted> <linked> <report>
    python -m tablemend correct  <corrupted> <corrected> <metrics> --as-of 2025-01-01 [--keep-keys]
    python -m tablemend report   <metrics> <report>
    python -m tablemend compare  <metrics before> <metrics after> <comparison>

Metrics are kept as Parquet tables, reports as JSON; ``repair`` writes its log to <report>-fixes.  On a cluster, submit this file with the
package as --py-files.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession

from tablemend.operators import report as R
from tablemend.operators.inject import inject_dataset
from tablemend.operators.integrity_report import integrity_report
from tablemend.operators.metrics import union_all
from tablemend.operators.repair import fix_log, repair_integrity
from tablemend.plans import pipeline, synthea
from tablemend.sources import metric_store
from tablemend.sources.discovery import discover
from tablemend.sources.sinks import FORMAT_CYCLE, export_json, stage_dataset, write_corrupted, write_dataset


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tablemend", description="data quality runs")
    steps = parser.add_subparsers(dest="step", required=True)

    def step(name: str, *paths: str) -> argparse.ArgumentParser:
        sub = steps.add_parser(name)
        for path in paths:
            sub.add_argument(path)
        sub.add_argument("--layout", default="formats", choices=("formats", "files", "parts"))
        sub.add_argument("--as-of", default=dt.date.today().isoformat(), help="the date that counts as today")
        return sub

    step("inject", "base", "out").add_argument("--formats", default=",".join(FORMAT_CYCLE))
    step("profile", "base", "metrics")
    step("validate", "base", "metrics")
    step("repair", "base", "out", "report")
    step("correct", "base", "out", "metrics").add_argument(
        "--keep-keys", action="store_true", help="leave foreign keys as they are")
    step("report", "metrics", "out")
    step("compare", "before", "after", "out")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    spark = SparkSession.builder.appName(f"tablemend {args.step}").getOrCreate()
    specs = synthea.specs(args.as_of)

    def tables():
        return discover(spark, args.base, args.layout)

    if args.step == "inject":
        write_corrupted(inject_dataset(tables(), synthea.INJECTION), args.out, args.formats.split(","))
    elif args.step == "profile":
        metric_store.write_metrics(pipeline.profile_dataset(tables(), specs, isolate=True), args.metrics)
    elif args.step == "validate":
        metric_store.write_metrics(pipeline.validate_dataset(tables(), specs, isolate=True), args.metrics)
    elif args.step == "repair":
        ds = tables()
        metric_store.write_metrics(fix_log(ds, specs), f"{args.report.rstrip('/')}-fixes")
        linked = stage_dataset(repair_integrity(ds, specs), args.out)
        export_json(integrity_report(linked, specs).coalesce(1), args.report)
    elif args.step == "correct":
        ds, keys = tables(), not args.keep_keys
        staging = f"{args.out.rstrip('/')}-marked"
        corrected, log = pipeline.correct_with_log(ds, specs, staging, repair=keys)
        saved = write_dataset(corrected, args.out, "csv")
        after = pipeline.assess_corrected(corrected, specs, pipeline.MISSING_FK if keys else None, isolate=True)
        metric_store.write_metrics(union_all([log, saved, after]), args.metrics)
        export_json(metric_store.read_metrics(spark, args.metrics).coalesce(1), f"{args.metrics.rstrip('/')}-json")
    elif args.step == "report":
        stored = metric_store.read_metrics(spark, args.metrics)
        shares = R.dimension_share(stored)
        for title, frame in (
            ("severity", R.severity(shares)), ("matrix", R.matrix(shares, fill=True)),
            ("dimensions", R.dimension_ranking(shares)), ("tables", R.table_ranking(shares)),
            ("errors_by_dimension", R.by_dimension(stored)), ("errors_by_table", R.by_table(stored)),
            ("top_rules", R.top_rules(stored)),
        ):
            export_json(frame.coalesce(1), f"{args.out.rstrip('/')}/{title}")
    else:
        before, after = (metric_store.read_metrics(spark, p) for p in (args.before, args.after))
        export_json(R.before_after(before, after).coalesce(1), args.out)


if __name__ == "__main__":
    main()
