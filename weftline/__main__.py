"""python -m weftline --base https://example.com --responses captured.parquet --out tables

Builds the tables of one site from captured responses and writes them as
Parquet, with report.json and report.txt on the driver's side. Exit status: 0
clean, 1 findings with --strict, 2 no page at all.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from weftline.operators.checks import report_text, search_path_error
from weftline.operators.classify import exit_code
from weftline.rules import PROFILES, Site, load_rules


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="weftline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--base", required=True, help="scheme and host of the site")
    p.add_argument("--responses", required=True, help="Parquet of captured responses")
    p.add_argument("--out", required=True, help="folder of the tables")
    p.add_argument("--own-host", action="append", default=[], help="another host of the site")
    p.add_argument("--exclude", action="append", default=[], help="pattern of paths left out")
    p.add_argument("--target", default="", help="scheme and host the mirror will live at")
    p.add_argument("--profile", action="append", choices=list(PROFILES), help="vendor profile, all by default")
    p.add_argument("--include-linked", action="store_true", help="list pages that only links lead to")
    p.add_argument("--search-path", default="/search/")
    p.add_argument("--strict", action="store_true")
    args = p.parse_args(argv)
    if why := search_path_error(args.search_path):
        p.error(f"--search-path {why}")
    return args


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    from weftline.plans.site import site_tables

    args = arguments(argv)
    site = Site(args.base.rstrip("/"), tuple(args.own_host), tuple(args.exclude), args.target, load_rules(tuple(args.profile) if args.profile else None), args.include_linked)
    spark = SparkSession.builder.appName("weftline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    seeds = spark.createDataFrame([(f"{site.base}/", "sitemap")], "url string, source string")
    tables = site_tables(spark.read.parquet(args.responses), seeds, site)
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{args.out}/{name}")
    row = spark.read.parquet(f"{args.out}/report").first().asDict()
    os.makedirs(args.out, exist_ok=True)
    with open(f"{args.out}/report.json", "w") as f:
        json.dump(row, f, indent=1)
    with open(f"{args.out}/report.txt", "w") as f:
        f.write(report_text(row))
    return 2 if not row["pages_ok"] else exit_code(row["pages_failed"], 0, args.strict)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
