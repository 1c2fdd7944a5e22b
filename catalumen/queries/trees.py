"""Sources and sinks over real files: a tree made of all texts is listed, scanned and copied; reports and logs are written and read.

Files are made on the executors, in the shared folder, which must be a file system that all of them mount. They are
removed again once the result is checkpointed.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalumen.functions import times
from catalumen.operators import catalog, links, logs, reports
from catalumen.queries import reporting, scalars, sql
from catalumen.queries import tags as made_tags
from catalumen.runtime import cut, remove, shared_table, spread, table
from catalumen.sources import listing, scan, sinks

#: Folder, beginning of the name and extension of a text's file, each in turns of its doc_id.
FOLDERS = ["2019/05", "A b", "2021-03-04", "skip", "skip not", "deep/er/20200229", ""]
NAMES = ["img_", "Doc ", "copy of ", "._x", "DSC_", "_copy-"]
KINDS = [".jpg", ".DNG", ".mp4", ".psd", ".tif", ".xmp", ".txt", "", ".tar.gz"]
#: Bytes from which a text's file counts as large.
LARGE = 300
#: Time of change of the files of texts without a date.
UNDATED = 1_500_000_000
SKIPS = "# folders to leave out\n\nskip # and all below\n/nowhere/else\n"


def _shared_path(spark: SparkSession) -> str:
    path = shared_table(spark, "tree").removeprefix("file://").removeprefix("file:")
    if not path.startswith("/"):
        raise RuntimeError("the shared folder must be a mounted file system for this query")
    return path


def make_tree(spark: SparkSession, d: str) -> str:
    """Writes one file for each text that isn't null, with the time at which it was posted, and a list of skips beside."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % n + 1).cast("int"))
    root = _shared_path(spark)
    name = F.concat(pick(NAMES, len(NAMES)), F.col("doc_id").cast("string"), pick(KINDS, len(KINDS)))
    path = F.concat_ws("/", F.lit(f"{root}/src"), F.nullif(pick(FOLDERS, len(FOLDERS)), F.lit("")), name)
    at = F.coalesce(F.unix_seconds(F.col("posted_at").cast("timestamp")), F.lit(UNDATED))
    rows = table(spark, d, "documents").filter("text is not null").select(path.alias("path"), F.encode("text", "UTF-8").alias("content"), at.alias("at"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content, t in zip(b["path"], b["content"], b["at"], strict=True):
                os.makedirs(os.path.dirname(p), exist_ok=True)
                with open(p, "wb") as f:
                    f.write(content)
                os.utime(p, (t, t))
            yield pd.DataFrame({"n": [len(b)]})

    os.makedirs(f"{root}/src", exist_ok=True)
    spread(rows).mapInPandas(write, "n long").agg(F.sum("n")).collect()
    with open(f"{root}/skips.txt", "w") as f:
        f.write(SKIPS)
    return root


def _over_tree(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query of what `make` gives for a made tree's root."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        root = make_tree(spark, d)
        try:
            return cut(make(spark, root))
        finally:
            remove(spark, root)

    return run


def _relative(path: str, root: str) -> Column:
    return F.substring(path, F.lit(len(root) + 2), F.length(path))


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """All files in walking order."""
    rows = scan.with_sequence(listing.list_files(spark, f"{root}/src"))
    return rows.select(_relative("path", f"{root}/src").alias("path"), "name", "size_bytes", F.col("mtime").cast("long").alias("mtime"), "seq")


def _scanned(dialect: str) -> Callable[[SparkSession, str], DataFrame]:
    """Records of all files: v1 leaves out the listed folder, in v2 relative entries of the list match nothing."""

    def make(spark: SparkSession, root: str) -> DataFrame:
        src = f"{root}/src"
        skips = listing.skip_list(spark, f"{root}/skips.txt", src if dialect == "v1" else None)
        rows = scan.scan(spark, src, skips=skips, dialect=dialect, least=LARGE)
        return rows.select(_relative("orig_path", src).alias("path"), "seq", "hash", "sparse_hash", "hash_is_sparse", "type", "ext", "orig_name", "size_bytes", "name_score", times.iso(F.col("capture_datetime")).alias("local"))

    return make


def _moved(spark: SparkSession, root: str) -> DataFrame:
    """Every file copied, then asked for again: status and size at either time, and the occurrence that is recorded."""
    rows = listing.list_files(spark, f"{root}/src").select(F.xxhash64("path").alias("id"), F.col("path").alias("orig_path"), F.concat(F.lit(f"{root}/out/"), F.col("name")).alias("dest_path"))
    rows, out = cut(rows), None
    for n in (1, 2):
        kept = f"{root}/moved-{n}"
        sinks.move_files(rows).write.parquet(kept)
        moved = spark.read.parquet(kept)
        told = sinks.moved_occurrences(moved, rows.select("id", F.lit(False).alias("is_seed"), F.lit(None).cast("long").alias("size_bytes"), F.lit("h").alias("hash"), F.lit(None).cast("string").alias("sparse_hash")))
        one = moved.join(told.select(F.col("path").alias("dest_path"), F.col("size_bytes").alias("recorded")), "dest_path", "left")
        one = one.select(F.lit(n).alias("run"), _relative("orig_path", f"{root}/src").alias("path"), _relative("dest_path", f"{root}/out").alias("dest"), "status", "size_bytes", F.col("mtime").cast("long").alias("mtime"), "recorded")
        out = one if out is None else out.unionByName(one)
    return out


def written(df: DataFrame, report: str) -> DataFrame:
    """A report as it is read back from the CSV files that it was written to: all columns texts, empty ones null."""
    spark = df.sparkSession
    path = shared_table(spark, "report")
    sinks.write_report(df, report, path)
    out = cut(spark.read.csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))
    remove(spark, path)
    return out


def csv_source_report(spark: SparkSession, d: str) -> DataFrame:
    return written(reports.with_notes(reporting.source_report_occurrences(spark, d)), "source")


def csv_copy_report(spark: SparkSession, d: str) -> DataFrame:
    return written(reporting.copy_report(spark, d), "copy")


def csv_unprocessed(spark: SparkSession, d: str) -> DataFrame:
    return written(reporting.unprocessed(spark, d).withColumn("has_output", F.lit(False)), "unprocessed")


def csv_unknown_files(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files")
    return written(reports.unknown_files(files).join(files.select("id", "first_seen_at", "last_seen_at"), "id"), "unknown")


def csv_unlinked_psds(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files")
    return written(reports.unlinked_psds(files, catalog.metadata_of(table(spark, d, "media_metadata")), links.psd_links(files, dialect="v1")), "unlinked")


def csv_log_issues(spark: SparkSession, d: str) -> DataFrame:
    """An organizer's log and a list of unknown files, both written and read from files, summed up in a written report."""
    lines, unknown = made_tags.organizer_log(spark, d)
    log, listed = shared_table(spark, "log"), shared_table(spark, "unknown")
    lines.write.text(log)
    unknown.select(F.col("path").alias("Orig_Path"), F.lit(1).alias("size_bytes")).write.csv(listed, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    out = written(logs.issue_summary(listing.log_lines(spark, log), listing.unknown_paths(spark, listed)), "issues")
    remove(spark, log), remove(spark, listed)
    return out


QUERIES = {
    "tree_listing": _over_tree(_listed),
    "tree_scan_v1": _over_tree(_scanned("v1")),
    "tree_scan_v2": _over_tree(_scanned("v2")),
    "tree_moves": _over_tree(_moved),
} | {f.__name__: f for f in (csv_source_report, csv_copy_report, csv_unprocessed, csv_unknown_files, csv_unlinked_psds, csv_log_issues)}


def _pick(values: list[str]) -> str:
    return f"[{', '.join(repr(v) for v in values)}][doc_id % {len(values)} + 1]"


_TREE = f"""a AS (SELECT doc_id, encode(text) AS blob, octet_length(encode(text)) AS size_bytes, coalesce(floor(epoch(posted_at))::BIGINT, {UNDATED}) AS mtime, {_pick(FOLDERS)} AS folder,
  {_pick(NAMES)} || doc_id || {_pick(KINDS)} AS name FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, CASE WHEN folder = '' THEN name ELSE folder || '/' || name END AS path, CASE WHEN folder = '' THEN []::VARCHAR[] ELSE string_split(folder, '/') END AS dirs FROM a),
tree AS (SELECT *, list_append(list_transform(dirs, lambda x: '1' || lower(x) || chr(0) || x), '0' || lower(name) || chr(0) || name) AS key FROM b)"""
_FIRST = scalars.SQL["content_fingerprints"].split("SELECT doc_id, ")[1].split(" FROM documents")[0].replace("octet_length(encode(text))", "size_bytes").replace("encode(text)", "blob")


def _scan_sql(dialect: str) -> str:
    kept = "WHERE folder <> 'skip'" if dialect == "v1" else ""
    day = scalars.SQL["date_from_path"].split("SELECT path, ", 2)[2].rsplit("::VARCHAR AS day", 1)[0]
    score = scalars.SQL[f"name_score_{dialect}"].split("SELECT id, ")[1].rsplit(" FROM files", 1)[0].replace("::INTEGER AS score", "")
    local = f"coalesce({day}::TIMESTAMP, make_timestamp(mtime * 1000000))" if dialect == "v1" else "make_timestamp(mtime * 1000000)"
    return f"""WITH {_TREE}, s AS (SELECT *, string_split(path, '/') AS parts, name AS orig_name, row_number() OVER (ORDER BY key) AS seq, {_FIRST} FROM tree {kept}),
f AS (SELECT *, size_bytes < {LARGE} OR row_number() OVER (PARTITION BY size_bytes < {LARGE}, sparse_hash ORDER BY seq) > 1 AS has_full FROM s)
SELECT path, seq, CASE WHEN has_full THEN full_hash END AS hash, CASE WHEN size_bytes >= {LARGE} THEN sparse_hash END AS sparse_hash, NOT has_full AS hash_is_sparse, {sql.kind('orig_name', dialect == 'v2')} AS type,
  lower({sql.suffix('orig_name')}) AS ext, orig_name, size_bytes, ({score})::INTEGER AS name_score, strftime({local}, '%Y-%m-%dT%H:%M:%S') AS local FROM f"""


def _texts(query: str, headings: dict[str, str], **casts: str) -> str:
    """A query's columns as the texts that a CSV report holds, empty ones null."""
    return f"SELECT {', '.join(f'''nullif({casts.get(c, f'{c}::VARCHAR')}, '') AS {chr(34)}{h}{chr(34)}''' for c, h in headings.items())} FROM ({query})"


_MILLIS = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%g')"
_NOTED = f"""SELECT path, status, file_type, CASE WHEN status <> 'Duplicate' THEN dest_path ELSE '' END AS dest_path, canonical_path,
 CASE status WHEN 'Not In Catalog' THEN 'Pending Import' WHEN 'Scheduled Copy/Move' THEN 'Active Record' WHEN 'Indexed (No Dest)' THEN 'No destination assigned' ELSE note END AS note FROM ({reporting.SQL['source_report_occurrences']})"""
SQL = {
    "tree_listing": f"WITH {_TREE} SELECT path, name, size_bytes, mtime, row_number() OVER (ORDER BY key) AS seq FROM tree",
    "tree_scan_v1": _scan_sql("v1"),
    "tree_scan_v2": _scan_sql("v2"),
    "tree_moves": f"""WITH {_TREE} SELECT 1 AS run, path, name AS dest, 'copied' AS status, size_bytes, mtime, size_bytes AS recorded FROM tree
UNION ALL SELECT 2, path, name, 'present', size_bytes, mtime, NULL FROM tree""",
    "csv_source_report": _texts(_NOTED, sinks.REPORTS["source"]),
    "csv_copy_report": _texts(reporting.SQL["copy_report"], sinks.REPORTS["copy"]),
    "csv_unprocessed": _texts(f"SELECT *, false AS has_output FROM ({reporting.SQL['unprocessed']})", sinks.REPORTS["unprocessed"]),
    "csv_unknown_files": _texts(
        f"SELECT u.*, first_seen_at, last_seen_at FROM ({reporting.SQL['unknown_files']}) u JOIN files USING (id)", sinks.REPORTS["unknown"],
        first_seen_at=_MILLIS.format("first_seen_at"), last_seen_at=_MILLIS.format("last_seen_at"),
    ),
    "csv_unlinked_psds": _texts(reporting.SQL["unlinked_psds"], sinks.REPORTS["unlinked"]),
    "csv_log_issues": _texts(made_tags.SQL["log_issues_organizer"], sinks.REPORTS["issues"]),
}
