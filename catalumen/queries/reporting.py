"""Reports over the whole catalogue and over log texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalumen.functions.fingerprints import full_hash
from catalumen.operators import links, logs, reports
from catalumen.operators.catalog import metadata_of
from catalumen.queries import linking, sql
from catalumen.runtime import table

#: Issues in the log lines of the text tables, with the pattern of each: the same kinds as in organizer logs.
LINE_ISSUES = {
    "exif_read_failed": r" (?:DEBUG|INFO|WARNING|ERROR) tag block of (.+) unreadable at offset",
    "no_exif_tags": r" (?:DEBUG|INFO|WARNING|ERROR) (.+) carries no tags",
    "using_filesystem_time": r" (?:DEBUG|INFO|WARNING|ERROR) capture time of (.+) taken from the file clock",
    "mediainfo_failed": r" (?:DEBUG|INFO|WARNING|ERROR) video probe of (.+) timed out after",
    "phash_failed": r" (?:DEBUG|INFO|WARNING|ERROR) picture hash of (.+) skipped, decoder gave up",
    "image_size_failed": r" (?:DEBUG|INFO|WARNING|ERROR) size of (.+) unknown, header cut at",
}


def _meta(spark: SparkSession, d: str) -> DataFrame:
    return metadata_of(table(spark, d, "media_metadata"))


def source_report(spark: SparkSession, d: str) -> DataFrame:
    """Status of each path of the incoming scans."""
    listing = table(spark, d, "file_records").filter("orig_path is not null").groupBy(F.col("orig_path").alias("path")).agg(F.max(full_hash(F.col("hash"))).alias("hash"))
    return reports.source_report(listing, table(spark, d, "files"), table(spark, d, "file_occurrences"))


def source_report_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Status of each path that was ever seen."""
    listing = table(spark, d, "file_occurrences").filter("path is not null").groupBy("path").agg(F.max(full_hash(F.col("hash"))).alias("hash"))
    return reports.source_report(listing, table(spark, d, "files"), table(spark, d, "file_occurrences"))


def copy_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.copy_report(table(spark, d, "file_occurrences"), table(spark, d, "files"))


def unprocessed(spark: SparkSession, d: str) -> DataFrame:
    return reports.unprocessed_raws(table(spark, d, "files"), _meta(spark, d), table(spark, d, "raw_outputs"))


def raw_details(spark: SparkSession, d: str) -> DataFrame:
    return reports.raw_details(table(spark, d, "files"), _meta(spark, d), table(spark, d, "raw_outputs"))


def raw_by_path(spark: SparkSession, d: str) -> DataFrame:
    """The raw file at each path that was ever seen or planned."""
    wanted = table(spark, d, "file_occurrences").select("path").unionByName(table(spark, d, "files").select(F.col("dest_path").alias("path")))
    return reports.find_raw(table(spark, d, "files"), wanted)


def unknown_files(spark: SparkSession, d: str) -> DataFrame:
    return reports.unknown_files(table(spark, d, "files"))


def orphan_psds(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files")
    return links.without_link(files.filter("type = 'psd'").select("id", "orig_name"), links.psd_links(files), "id", "psd_file_id")


def unlinked_psds(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files")
    return reports.unlinked_psds(files, _meta(spark, d), links.psd_links(files, dialect="v1"))


def counters(spark: SparkSession, d: str) -> DataFrame:
    return reports.counters(table(spark, d, "files"), table(spark, d, "raw_outputs"), table(spark, d, "raw_sidecars"))


def log_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues per path in all texts, read line by line, and whether the catalogue holds the path as an unknown file."""
    lines = table(spark, d, "documents").select(F.explode(F.split("text", r"\r?\n")).alias("value"))
    unknown = table(spark, d, "files").filter("type = 'other' and orig_path is not null").select(F.col("orig_path").alias("path"))
    return logs.issue_summary(lines, unknown, issues=LINE_ISSUES)


QUERIES = {f.__name__: f for f in (source_report, source_report_occurrences, copy_report, unprocessed, raw_details, raw_by_path, unknown_files, orphan_psds, unlinked_psds, counters, log_issues)}


def _source(listing: str) -> str:
    return f"""WITH l AS ({listing}),
bp AS (SELECT path, file_id AS path_id FROM file_occurrences WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY seen_at DESC NULLS LAST, file_id DESC NULLS LAST) = 1),
bh AS (SELECT {sql.full_hash('hash')} AS h, min(id) AS hash_id FROM files GROUP BY 1),
x AS (SELECT l.path, {sql.kind(sql.name('l.path'), False)} AS file_type, path_id, hash_id, coalesce(path_id, hash_id) AS file_id FROM l LEFT JOIN bp USING (path) LEFT JOIN bh USING (h)),
y AS (SELECT x.*, f.orig_path AS canonical, f.dest_path AS dest, coalesce(f.orig_path = x.path, false) AS own FROM x LEFT JOIN files f ON f.id = x.file_id),
z AS (SELECT *, CASE WHEN file_type = 'other' AND path_id IS NOT NULL THEN 'Indexed (Ignored Type)' WHEN file_type = 'other' THEN 'Skipped' WHEN file_id IS NULL THEN 'Not In Catalog'
  WHEN own AND dest IS NOT NULL THEN 'Scheduled Copy/Move' WHEN own THEN 'Indexed (No Dest)' ELSE 'Duplicate' END AS status FROM y)
SELECT path, status, file_type, CASE WHEN status IN ('Scheduled Copy/Move', 'Duplicate') THEN coalesce(dest, '') ELSE '' END AS dest_path,
  CASE WHEN status = 'Duplicate' THEN coalesce(canonical, '') ELSE '' END AS canonical_path,
  CASE WHEN file_type = 'other' THEN 'Unsupported extension' WHEN status = 'Duplicate' THEN 'Duplicate of ID ' || file_id || CASE WHEN path_id IS NOT NULL THEN ' (path_lookup)' ELSE ' (content_hash)' END ELSE '' END AS note FROM z"""


_CASES = " ".join(f"WHEN regexp_matches(v, '{p}') THEN '{k}'" for k, p in LINE_ISSUES.items())
_PATHS = " ".join(f"WHEN regexp_matches(v, '{p}') THEN regexp_extract(v, '{p}', 1)" for p in LINE_ISSUES.values())
SQL = {
    "source_report": _source(f"SELECT orig_path AS path, max({sql.full_hash('hash')}) AS h FROM file_records WHERE orig_path IS NOT NULL GROUP BY 1"),
    "source_report_occurrences": _source(f"SELECT path, max({sql.full_hash('hash')}) AS h FROM file_occurrences WHERE path IS NOT NULL GROUP BY 1"),
    "copy_report": """WITH k AS (SELECT hash, type, dest_path AS dest, orig_path AS canonical, true AS known FROM files WHERE hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hash ORDER BY id DESC) = 1),
x AS (SELECT o.path, coalesce(o.is_seed, false) AS is_seed, o.hash, k.type, coalesce(dest, '') AS dest, canonical, known FROM file_occurrences o LEFT JOIN k USING (hash)),
y AS (SELECT *, CASE WHEN known IS NULL THEN 'unknown' WHEN type = 'other' THEN 'skipped_other' WHEN path IS DISTINCT FROM canonical THEN 'duplicate' WHEN dest <> '' THEN 'copied' ELSE 'pending' END AS status FROM x)
SELECT path, coalesce(type, '') AS type, is_seed, status, dest AS dest_path, CASE WHEN status = 'duplicate' THEN dest ELSE '' END AS duplicate_of, hash FROM y""",
    "unprocessed": f"WITH {sql.META} SELECT id AS raw_file_id, coalesce(dest_path, '') AS raw_path, capture_datetime, coalesce(camera_model, '') AS camera_model FROM files LEFT JOIN meta ON id = file_id WHERE type = 'raw' AND id NOT IN (SELECT raw_file_id FROM raw_outputs WHERE raw_file_id IS NOT NULL)",
    "raw_details": f"WITH {sql.META} SELECT raw_file_id, output_file_id, type, coalesce(dest_path, orig_path) AS output_path, capture_datetime, camera_model, link_method, confidence FROM raw_outputs JOIN files ON id = output_file_id LEFT JOIN meta ON file_id = id WHERE raw_file_id IS NOT NULL AND type IN ('jpeg', 'psd', 'video', 'tiff')",
    "raw_by_path": """WITH w AS (SELECT DISTINCT path FROM (SELECT path FROM file_occurrences UNION ALL SELECT dest_path FROM files) WHERE path IS NOT NULL),
r AS (SELECT id, 0 AS rank, dest_path AS place FROM files WHERE type = 'raw' UNION ALL SELECT id, 1, orig_path FROM files WHERE type = 'raw')
SELECT path, id AS raw_file_id FROM w JOIN r ON place IN (path, replace(path, chr(92), '/')) QUALIFY row_number() OVER (PARTITION BY path ORDER BY rank, id) = 1""",
    "unknown_files": "SELECT id, ext, orig_path, coalesce(size_bytes, 0) AS size_bytes, coalesce(is_seed, false) AS is_seed FROM files WHERE type = 'other'",
    "orphan_psds": f"SELECT id, orig_name FROM files WHERE type = 'psd' AND id NOT IN (SELECT psd_file_id FROM ({linking.SQL['psd_stem_link_v2']}))",
    "unlinked_psds": f"WITH {sql.META} SELECT id, orig_name, orig_path, dest_path, capture_datetime, camera_model FROM files LEFT JOIN meta ON id = file_id WHERE type = 'psd' AND id NOT IN (SELECT psd_file_id FROM ({linking.SQL['psd_stem_link_v1']}))",
    "counters": """SELECT 'files_' || coalesce(type, 'untyped') AS counter, count(*) AS n FROM files GROUP BY 1 UNION ALL SELECT 'output_links', count(*) FROM raw_outputs UNION ALL SELECT 'sidecar_links', count(*) FROM raw_sidecars""",
    "log_issues": f"""WITH v AS (SELECT unnest(regexp_split_to_array(text, '\\r?\\n')) AS v FROM documents), i AS (SELECT CASE {_CASES} END AS issue, CASE {_PATHS} END AS path FROM v)
SELECT path, CASE WHEN path IN (SELECT orig_path FROM files WHERE type = 'other' AND orig_path IS NOT NULL) THEN 1 ELSE 0 END AS in_unknown_files,
  string_agg(DISTINCT issue, ';' ORDER BY issue) AS issues FROM i WHERE issue IS NOT NULL GROUP BY path""",
}
