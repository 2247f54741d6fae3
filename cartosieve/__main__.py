"""python -m cartosieve validate PATH | convert PATH OUT | profiles | report PATH"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from cartosieve.plans import api, report
from cartosieve.plans.profiles import PROFILES
from cartosieve.sources import readers


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cartosieve")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("validate", help="check a layer and summarise what was found")
    one.add_argument("path")
    one.add_argument("--profile", default="generic_quick", choices=sorted(PROFILES))
    one.add_argument("--output", help="folder for the issues")
    one.add_argument("--format", default="json", choices=["json", "csv"])
    one.add_argument("--fail-on-error", action="store_true", help="exit with 2 if there are issues")
    two = commands.add_parser("convert", help="write a layer in another form")
    two.add_argument("path")
    two.add_argument("output")
    two.add_argument("--format", default="geojson", choices=["geojson", "csv", "parquet"])
    commands.add_parser("profiles", help="list the profiles and their checks")
    three = commands.add_parser("report", help="summarise issues written before")
    three.add_argument("path")
    args = parser.parse_args(argv)
    if args.command == "profiles":
        for name, profile in sorted(PROFILES.items()):
            print(f"{name}: {', '.join(profile.checks)}")
        return 0
    spark = SparkSession.builder.appName("cartosieve").getOrCreate()
    if args.command == "validate":
        result = api.validate(spark, args.path, args.profile)
        found = result.issues().persist()
        print(report.text_summary(found))
        if args.output:
            report.write_report(found, args.output, args.format)
        return 2 if args.fail_on_error and not found.isEmpty() else 0
    if args.command == "convert":
        readers.write_layer(readers.load_layer(spark, args.path)[0], args.output, args.format)
        return 0
    rows = report.read_report(spark, args.path)
    for row in rows.groupBy("problem_name", "severity").count().orderBy("problem_name").collect():  # bounded by the catalog
        print(f"{row['problem_name']} ({row['severity']}): {row['count']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
