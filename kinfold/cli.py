"""Command line: scan, list, export, sort, delete."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinfold.functions import formats
from kinfold.operators import report, sorter, survivors
from kinfold.plans.classification import classified
from kinfold.plans.scan import ScanConfig, scan_summary
from kinfold.sources.files import walk
from kinfold.sources.store import SessionStore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinfold")
    p.add_argument("--store")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("paths", nargs="+")
    s.add_argument("--types", default="image,document,video,archive,code")
    s.add_argument("--threshold", type=float, default=0.95)
    s.add_argument("--name", default="scan")
    s.add_argument("--no-recursive", action="store_true")
    s.add_argument("--merge-session", type=int)
    s.add_argument("--similarity", default="exact")
    s = sub.add_parser("list")
    s.add_argument("session", type=int, nargs="?")
    s.add_argument("--type")
    s = sub.add_parser("export")
    s.add_argument("session", type=int)
    s.add_argument("output")
    s.add_argument("--format", default="csv")
    s = sub.add_parser("sort")
    s.add_argument("paths", nargs="+")
    s.add_argument("--destination", required=True)
    s.add_argument("--classify", action="store_true")
    s.add_argument("--execute", action="store_true")
    s = sub.add_parser("delete")
    s.add_argument("session", type=int)
    s.add_argument("--keep", default="newest")
    s.add_argument("--execute", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("kinfold").getOrCreate()
    store = SessionStore(spark, args.store)
    if args.command == "scan":
        cfg = ScanConfig(categories=tuple(args.types.split(",")), threshold=args.threshold, recursive=not args.no_recursive, name=args.name, similarity=args.similarity)
        seen = scan_summary(spark, args.paths, store, cfg, args.merge_session)
        print("\n".join([f"session {seen.session}", *seen.lines()]))
    elif args.command == "list" and args.session is None:
        for row in store.sessions().select(formats.session_line(F.col("id"), F.col("status"), F.col("created_at"), F.col("name")).alias("line")).toLocalIterator():
            print(row.line)
    elif args.command == "list":
        own = store.session(args.session)
        print(f"Session {own.id}: {own.name} ({own.status})")
        groups = report.of_category(store.groups(args.session), args.type)
        h = report.histogram(groups, "similarity_score").first()
        print(f"  95-100%: {h.above_95} groups\n  80-95%:  {h.from_80} groups\n  60-80%:  {h.from_60} groups" + (f"\n  <60%:    {h.below_60} groups" if h.below_60 else ""))
        lines = groups.select("id", F.lit(-1).cast("long").alias("e"), formats.group_line(F.col("id"), F.col("file_type"), F.col("similarity_score")).alias("line"))
        files = store.session_entries(args.session).join(groups.select(F.col("id").alias("group_id")), "group_id", "left_semi").select(F.col("group_id").alias("id"), F.col("id").alias("e"), F.concat(F.lit("  "), F.col("file_path"), F.lit(" ("), formats.megabytes(F.col("file_size")), F.lit(")")).alias("line"))
        for row in lines.unionByName(files).orderBy("id", "e").select("line").toLocalIterator():
            print(row.line)
    elif args.command == "export":
        groups = store.groups(args.session)
        report.export(groups, store.session_entries(args.session).drop("file_type", "similarity_score"), args.output, args.format, args.session)
    elif args.command == "sort":
        files = walk(spark, args.paths, prune=False).filter("status = 'found'")
        sub = None
        if args.classify:
            got = classified(spark, files, args.paths, store)
            files, sub = files.join(got.select("path", "sub_category"), "path", "left"), F.col("sub_category")
        plan = sorter.destinations(files, args.destination, sub)
        print(sorter.stats(plan).first().asDict())
        if args.execute:
            print(f"moved {sorter.move_files(sorter.resolve(plan)).filter('moved').count()}")
    else:
        entries = store.session_entries(args.session).withColumn("modified", F.timestamp_seconds(F.col("modified_time").cast("long")))
        plan = survivors.delete_plan(entries.drop("similarity_score", "file_type"), store.groups(args.session), args.keep)
        if args.execute:
            for row in survivors.delete_files(plan).groupBy("deleted").count().collect():  # two rows at most
                print(f"{'deleted' if row.deleted else 'failed'} {row['count']}")
        else:
            for row in plan.select("action").toLocalIterator():
                print(row.action)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
