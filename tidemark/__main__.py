"""Command line: build every mart from users and events and export them.

    python -m tidemark --users PATH --events PATH --out DIR [--apps CSV] [--input-format csv]
"""

from __future__ import annotations

import argparse
import sys

from tidemark.plans import catalog, kpis, propensity, quality
from tidemark.session import cluster_session
from tidemark.sources import schemas
from tidemark.sources.export import manifest_of, write_marts
from tidemark.sources.staging import release, stage
from tidemark.sources.tables import list_tables, read_raw_catalog, read_table, register, require_tables
from tidemark.warehouse import Warehouse


def main() -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("--users", required=True)
    parser.add_argument("--events", required=True)
    parser.add_argument("--apps", help="raw app catalogue, CSV with a header")
    parser.add_argument("--out", required=True)
    parser.add_argument("--input-format", choices=("parquet", "csv"), default="parquet")
    parser.add_argument("--output-format", choices=("parquet", "csv"), default="csv")
    parser.add_argument("--no-model", action="store_true")
    parser.add_argument("--trees", type=int, default=propensity.N_TREES)
    parser.add_argument("--strict", action="store_true", help="exit with 1 if a quality check failed")
    args = parser.parse_args()

    spark = cluster_session()
    inputs = {
        "users": read_table(spark, args.users, schemas.USERS, args.input_format),
        "events": read_table(spark, args.events, schemas.EVENTS, args.input_format),
    }
    if args.apps:
        inputs["raw_apps"] = read_raw_catalog(spark, args.apps, schemas.RAW_CATALOG)
    register(inputs)
    require_tables(spark, ["users", "events", *(["raw_apps"] if args.apps else [])])
    warehouse = Warehouse(inputs["users"], inputs["events"], n_trees=args.trees)
    marts = warehouse.marts()
    importances = None
    if not args.no_model:
        marts |= warehouse.model_marts()
        importances = marts["model_feature_importance"]
        marts["kpi_summary"] = kpis.with_top_feature(marts["kpi_summary"], importances)
    if args.apps:
        marts["apps"] = catalog.catalog_clean(inputs["raw_apps"])
    marts["quality_report"] = warehouse.quality_report(marts, importances)
    marts["quality_report"] = stage(marts["quality_report"], "quality_report")
    list_tables(spark).show(truncate=False)
    exported = write_marts(marts, args.out, args.output_format)
    manifest_of(spark, exported).show(len(exported), truncate=False)
    n_checks, failures = marts["quality_report"].count(), quality.failed(marts["quality_report"])
    print(f"{n_checks - len(failures)} of {n_checks} quality checks passed")
    for check, n_bad in failures:
        print(f"failed: {check} ({n_bad})")
    release(spark)
    return int(bool(failures) and args.strict)


if __name__ == "__main__":
    sys.exit(main())
