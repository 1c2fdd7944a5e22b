"""python -m catalumen organize | query | issues | diagnose | inspect | bench"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalumen.operators import logs, pipeline, reports
from catalumen.operators.catalog import known_sparse, metadata_of, occurrences_last
from catalumen.runtime import build_session, cut, remove, shared_table
from catalumen.sources import diagnostics, listing, scan, sinks
from catalumen.sources.snapshots import Catalog


def log_errors(what: DataFrame) -> None:
    """Logs the paths that couldn't be read, a partition at a time."""
    for row in what.toLocalIterator():
        logging.warning("Failed to scan %s: %s", row.path, row.error)


def organize(a: argparse.Namespace) -> int:
    spark = build_session(cpus=a.max_workers or "*")
    os.makedirs(a.dest, exist_ok=True)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO, handlers=[logging.FileHandler(os.path.join(a.dest, "organizer.log")), logging.StreamHandler(sys.stdout)])
    logging.getLogger("py4j").setLevel(logging.WARNING)
    cat = Catalog(spark, a.db or os.path.join(a.dest, "catalog"))
    if a.report:
        return report(cat, a)
    seen = cat.table("file_occurrences")
    if a.dialect == "v1" and seen is not None:
        cat.write({"file_occurrences": seen.limit(0)})  # a log of each run
    for root, seed in [(r, True) for r in a.seed or []] + [(a.src, False)]:
        files, seen = cat.table("files"), cat.table("file_occurrences")
        known = known_sparse(files, seen) if files is not None else None
        skips = listing.skip_list(spark, a.skip_dirs_file, root if a.dialect == "v1" else None) if a.skip_dirs_file else None
        if a.dialect == "v1" and not seed:
            inside = spark.createDataFrame([(os.path.abspath(a.dest),)], "skip_dir string")
            skips = inside if skips is None else skips.unionByName(inside)
        logging.info("scanning %s", root)
        pipeline.ingest(cat, scan.scan(spark, root, seed, known, skips, a.dialect, a.use_phash, errors=log_errors), a.dialect)
    files = cat.table("files")
    refs = scan.embedded_references(spark, files.filter("type = 'psd'"))
    pipeline.link(cat, refs, a.dialect)
    pipeline.plan(cat, os.path.abspath(a.dest), a.dialect)
    files = cat.table("files")
    # moving is done once, while its result is written; whatever is asked of it then is read back
    kept = shared_table(spark, "moved")
    sinks.move_files(files, a.move, a.dry_run).write.parquet(kept)
    moved = spark.read.parquet(kept)
    for status, n in moved.groupBy("status").count().collect():
        logging.info("%s: %s", status, n)
    if not a.dry_run and a.dialect == "v2":
        base = cat.version()
        seen = cat.table("file_occurrences", base)
        made = sinks.moved_occurrences(moved, files).select(*seen.columns)
        cat.write({"file_occurrences": occurrences_last(seen.unionByName(made))}, base=base)
    remove(spark, kept)
    if a.dialect == "v1":
        exports(cat, a.dest)
    if a.copy_report:
        sinks.write_report(reports.copy_report(cat.table("file_occurrences"), files), "copy", a.copy_report)
    return 0


def exports(cat: Catalog, dest: str) -> None:
    """The three reports of a v1 run: raw files without outputs, files of unknown types, layered documents without source."""
    files, meta = cat.table("files"), metadata_of(cat.table("media_metadata"))
    out = reports.unprocessed_raws(files, meta, cat.table("raw_outputs")).withColumn("has_output", F.lit(False))
    sinks.write_report(out, "unprocessed", os.path.join(dest, "unprocessed_raws.csv"))
    dates = files.select("id", "first_seen_at", "last_seen_at")
    sinks.write_report(reports.unknown_files(files).join(dates, "id"), "unknown", os.path.join(dest, "unknown_files.csv"))
    sinks.write_report(reports.unlinked_psds(files, meta, cat.table("psd_source_links")), "unlinked", os.path.join(dest, "unlinked_psds.csv"))


def report(cat: Catalog, a: argparse.Namespace) -> int:
    if not cat.version():
        print("no catalogue", file=sys.stderr)
        return 1
    records = cut(scan.scan(cat.spark, a.src, force_full=True, errors=log_errors, keep_unread=True).select(F.col("orig_path").alias("path"), "hash", "error"))
    told = reports.source_report(records.select("path", "hash"), cat.table("files"), cat.table("file_occurrences"))
    sinks.write_report(reports.with_notes(told, records), "source", a.report_csv)
    return 0


def show(df: DataFrame) -> None:
    """Prints rows as they come, a partition at a time."""
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def query(a: argparse.Namespace) -> int:
    cat = Catalog(build_session(), a.db, must_exist=True)
    files, meta = cat.table("files"), metadata_of(cat.table("media_metadata"))
    links = cat.table("raw_outputs")
    links = links if links is not None else cat.spark.createDataFrame([], "raw_file_id long, output_file_id long, link_method string, confidence int")
    if a.unprocessed_raws:
        show(reports.unprocessed_raws(files, meta, links).orderBy(F.asc_nulls_first("capture_datetime"), "raw_file_id"))
    elif a.unknown_files:
        show(reports.unknown_files(files).orderBy("ext", "orig_path"))
    else:
        raw = a.raw_id
        if a.raw_path:
            hit = reports.find_raw(files, cat.spark.createDataFrame([(a.raw_path,)], "path string")).head()
            raw = hit["raw_file_id"] if hit else None
        if raw is None or files.filter((F.col("id") == raw) & (F.col("type") == "raw")).isEmpty():
            print("no such raw file")
            return 1
        show(files.filter(F.col("id") == raw).join(meta.withColumnRenamed("file_id", "id"), "id", "left"))
        show(reports.raw_details(files, meta, links).filter(F.col("raw_file_id") == raw).orderBy(F.asc_nulls_first("capture_datetime"), "output_file_id"))
    return 0


def issues(a: argparse.Namespace) -> int:
    spark = build_session()
    unknown = listing.unknown_paths(spark, a.unknown_csv) if a.unknown_csv else spark.createDataFrame([], "path string")
    out = a.out or os.path.join(os.path.dirname(os.path.abspath(a.log)), "metadata_issues_summary.csv")
    sinks.write_report(logs.issue_summary(listing.log_lines(spark, a.log), unknown), "issues", out)
    return 0


def diagnose(a: argparse.Namespace) -> int:
    diagnostics.video_diagnostic(build_session(), os.path.abspath(a.dir)).orderBy("file", "tool").write.mode("overwrite").csv(a.out, header=True, emptyValue="")
    return 0


def inspect(a: argparse.Namespace) -> int:
    show(diagnostics.inspect_file(build_session(), a.file).orderBy(F.desc("about_camera"), "track", "tag"))
    return 0


def bench(a: argparse.Namespace) -> int:
    results = []
    for workers in a.workers:
        times = []
        for _ in range(a.repeats):
            spark = build_session(cpus=workers)
            cat = Catalog(spark, tempfile.mkdtemp(prefix="bench-", dir=a.db_dir)) if a.db_dir else None
            began = time.perf_counter()
            skips = spark.createDataFrame([(a.skip_dest,)], "skip_dir string") if a.skip_dest else None
            records = scan.scan(spark, a.src, skips=skips, dialect="v1", pictures=a.use_phash)
            if cat is not None:  # the upserts and their writing are timed too
                pipeline.ingest(cat, records, "v1")
            else:
                records.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
            spark.stop()
        results.append({"workers": workers, "times": times, "cold": times[0], "warm_avg": sum(times[1:]) / len(times[1:]) if times[1:] else None})
    with open(a.output, "w") as f:
        json.dump({"src": a.src, "skip_dest": a.skip_dest, "use_phash": a.use_phash, "repeats": a.repeats, "workers": a.workers, "results": results}, f, indent=2)
    return 0


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="catalumen")
    sub = p.add_subparsers(required=True)
    o = sub.add_parser("organize")
    o.add_argument("src"), o.add_argument("dest")
    o.add_argument("--seed", "--seed-output", action="append"), o.add_argument("--max-workers", type=int), o.add_argument("--db"), o.add_argument("--skip-dirs-file"), o.add_argument("--copy-report")
    o.add_argument("--report-csv", default="source_report.csv"), o.add_argument("--dialect", choices=["v1", "v2"], default="v2")
    for flag in ("--move", "--dry-run", "--report", "--use-phash"):
        o.add_argument(flag, action="store_true")
    o.add_argument("-v", "--verbose", action="store_true"), o.set_defaults(run=organize)
    q = sub.add_parser("query")
    q.add_argument("--db", required=True)
    one = q.add_mutually_exclusive_group(required=True)
    one.add_argument("--unprocessed-raws", action="store_true"), one.add_argument("--raw-id", type=int), one.add_argument("--raw-path"), one.add_argument("--unknown-files", action="store_true")
    q.set_defaults(run=query)
    i = sub.add_parser("issues")
    i.add_argument("--log", required=True), i.add_argument("--unknown-csv"), i.add_argument("--out"), i.set_defaults(run=issues)
    d = sub.add_parser("diagnose")
    d.add_argument("dir", nargs="?", default="."), d.add_argument("out", nargs="?", default="video_metadata_report.csv"), d.set_defaults(run=diagnose)
    n = sub.add_parser("inspect")
    n.add_argument("file"), n.set_defaults(run=inspect)
    b = sub.add_parser("bench")
    b.add_argument("src"), b.add_argument("--skip-dest"), b.add_argument("--workers", type=int, nargs="+", default=[1, 2, 4, 8]), b.add_argument("--repeats", type=int, default=3)
    b.add_argument("--use-phash", action="store_true"), b.add_argument("--db-dir"), b.add_argument("--output", default="bench_scan_results.json"), b.set_defaults(run=bench)
    a = p.parse_args(args)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
