"""Destination plans over the whole catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalumen.functions.times import flexible_time
from catalumen.operators.catalog import metadata_of
from catalumen.operators.links import psd_links, sidecar_links
from catalumen.operators.timestamps import utc_text
from catalumen.plans import destinations as plans
from catalumen.queries import linking, sql
from catalumen.runtime import table


def dated(spark: SparkSession, d: str) -> DataFrame:
    """id, width, height, at: the capture time, else that of the file by its least plausible change time."""
    meta = metadata_of(table(spark, d, "media_metadata")).select(F.col("file_id").alias("id"), "capture_datetime", "width", "height")
    clock = table(spark, d, "file_occurrences").filter("mtime > 0 and mtime < 4102444800").groupBy(F.col("file_id").alias("id")).agg(F.min("mtime").alias("mtime"))
    second = F.rtrim(utc_text(F.floor("mtime")), F.lit("Z")).try_cast("timestamp_ntz")
    rows = table(spark, d, "files").select("id").join(meta, "id", "left").join(clock, "id", "left")
    return rows.select("id", "width", "height", F.coalesce(flexible_time(F.col("capture_datetime")), second).alias("at"))


def group_main_resized(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "files").filter("type = 'jpeg' and orig_name is not null").select("id", "orig_name").join(dated(spark, d), "id").filter("at is not null")
    return plans.main_and_resized(rows).select("id", "group_stem", "is_main", "first_id")


def resized_name(spark: SparkSession, d: str) -> DataFrame:
    """The name that each picture would have as a resized one."""
    rows = table(spark, d, "files").filter("type = 'jpeg' and orig_name is not null").select("id", "orig_name").join(dated(spark, d), "id").filter("at is not null")
    return rows.select("id", plans.dated_name(F.col("orig_name"), F.col("at"), plans.resized_middle(F.col("width"), F.col("height"))).alias("name"))


def dest_names(spark: SparkSession, d: str) -> DataFrame:
    """Folder and dated name of primary files, before clashes are numbered."""
    rows = table(spark, d, "files").filter(F.col("type").isin(plans.PRIMARY) & F.col("orig_name").isNotNull()).select("id", "type", "orig_name").join(dated(spark, d), "id").filter("at is not null")
    return rows.select("id", plans.folder(F.col("type"), F.col("at"), "/organized").alias("folder"), plans.dated_name(F.col("orig_name"), F.col("at")).alias("name"))


def dest_plan(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files")
    return plans.plan_destinations(files, dated(spark, d), linked_psds=psd_links(files))


def dest_plan_v1(spark: SparkSession, d: str) -> DataFrame:
    return plans.plan_destinations(table(spark, d, "files"), dated(spark, d), dialect="v1")


def sidecar_dest(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files")
    return plans.sidecar_destinations(sidecar_links(files), files.select("id", "dest_path"), files)


def sidecar_dest_v1(spark: SparkSession, d: str) -> DataFrame:
    """The same with clashes numbered."""
    files = table(spark, d, "files")
    return plans.sidecar_destinations(sidecar_links(files), files.select("id", "dest_path"), files, "v1")


def psd_dest_v2(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files")
    return plans.psd_destinations(files.filter("type = 'psd'").select("id", "orig_name"), psd_links(files), files.select("id", "dest_path"))


def psd_dest_v1(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files")
    psds = files.filter("type = 'psd'").select("id", "orig_name").join(dated(spark, d).select("id", "at"), "id")
    return plans.psd_destinations(psds, psd_links(files, dialect="v1"), files.select("id", "dest_path"), "v1")


def pending_moves(spark: SparkSession, d: str) -> DataFrame:
    present = table(spark, d, "file_occurrences").select("path")
    return plans.pending_moves(table(spark, d, "files").select("id", "dest_path"), present)


QUERIES = {f.__name__: f for f in (group_main_resized, resized_name, dest_names, dest_plan, dest_plan_v1, sidecar_dest, sidecar_dest_v1, psd_dest_v2, psd_dest_v1, pending_moves)}

_AT = "strftime(taken_at, '%Y-%m-%d_%H-%M-%S')"
_STEM, _EXT = sql.stem("orig_name"), sql.suffix("orig_name")
_JPEG = f"WITH {sql.PLANNED}, j AS (SELECT *, {sql.normal_stem(_STEM)} AS group_stem, date_trunc('second', taken_at) AS sec FROM dated WHERE type = 'jpeg' AND orig_name IS NOT NULL AND taken_at IS NOT NULL) "
_LINK = f"""WITH s AS (SELECT {sql.normal_stem(_STEM)} AS key, type, id FROM files WHERE type IN ('raw', 'jpeg') AND orig_name IS NOT NULL),
p AS (SELECT id AS psd_file_id, orig_name, {sql.psd_stem(_STEM)} AS key FROM files WHERE type = 'psd' AND orig_name IS NOT NULL),
l AS (SELECT psd_file_id, p.orig_name, s.id AS source_file_id FROM p JOIN s USING (key) QUALIFY row_number() OVER (PARTITION BY psd_file_id ORDER BY s.type DESC, s.id DESC) = 1)"""

SQL = {
    "group_main_resized": _JPEG + """SELECT id, group_stem, row_number() OVER (PARTITION BY group_stem, sec ORDER BY coalesce(width, 0)::BIGINT * coalesce(height, 0) DESC, id) = 1 AS is_main,
 min(id) OVER (PARTITION BY group_stem, sec) AS first_id FROM j""",
    "resized_name": _JPEG + f"SELECT id, {_STEM} || '_resized' || CASE WHEN width <> 0 AND height <> 0 THEN '_' || width || 'x' || height ELSE '' END || '_' || {_AT} || {_EXT} AS name FROM j",
    "dest_names": f"""WITH {sql.PLANNED} SELECT id, '/organized/' || CASE WHEN type = 'raw' THEN 'raw' ELSE 'output' END || strftime(taken_at, '/%Y/%Y-%m') AS folder, {_STEM} || '_' || {_AT} || {_EXT} AS name
 FROM dated WHERE type IN ('raw', 'video', 'tiff') AND orig_name IS NOT NULL AND taken_at IS NOT NULL""",
    "sidecar_dest": f"""WITH f AS (SELECT *, {sql.parent('orig_path')} AS dir, lower({sql.stem(sql.name('orig_path'))}) AS st FROM files WHERE orig_path IS NOT NULL)
SELECT s.id AS sidecar_file_id, {sql.parent('r.dest_path')} || '/' || {sql.stem(sql.name('r.dest_path'))} || {sql.suffix('s.orig_name')} AS dest_path FROM f r JOIN f s USING (dir, st)
WHERE r.type = 'raw' AND s.type = 'sidecar' AND r.dest_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY r.id) = 1""",
    "psd_dest_v2": _LINK + f""" SELECT psd_file_id, regexp_replace({sql.parent('dest_path')}, '(?i)(^|/)raw(/|$)', '\\1output\\2') || '/' || l.orig_name AS dest_path FROM l JOIN files f ON f.id = l.source_file_id WHERE dest_path IS NOT NULL""",
    "pending_moves": "SELECT id, dest_path FROM files WHERE dest_path IS NOT NULL AND dest_path NOT IN (SELECT path FROM file_occurrences WHERE path IS NOT NULL)",
    "psd_dest_v1": f"""WITH RECURSIVE {sql.PLANNED}, s AS (SELECT {sql.normal_stem(_STEM, 'v1')} AS key, type, id FROM files WHERE type IN ('raw', 'jpeg') AND orig_name IS NOT NULL),
p AS (SELECT id, orig_name, taken_at, {sql.psd_stem(_STEM, 'v1')} AS key FROM dated WHERE type = 'psd'),
l AS (SELECT p.id, s.id AS source_file_id FROM p JOIN s USING (key) QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY s.type, s.id) = 1),
q AS (SELECT p.id, p.orig_name, coalesce({sql.parent('f.dest_path')}, 'output/' || strftime(taken_at, '%Y/%Y-%m') || '/unlinked-psds') AS folder FROM p LEFT JOIN l USING (id) LEFT JOIN files f ON f.id = l.source_file_id),
wants AS (SELECT id, folder, orig_name AS want, 0 AS pass, '' AS kind, 0 AS first_id FROM q WHERE folder IS NOT NULL AND orig_name IS NOT NULL),
taken AS (SELECT folder, want AS name FROM wants WHERE false), {sql.numbered(' ({})')}
SELECT id AS psd_file_id, folder || '/' || name AS dest_path FROM named""",
}


def _plan(dialect: str) -> str:
    where = "'/organized/' || CASE WHEN type = 'raw' THEN 'raw' ELSE 'output' END || strftime(taken_at, '/%Y/%Y-%m')"
    plain = f"{_STEM} || '_' || {_AT} || {_EXT}"
    resized = f"{_STEM} || '_resized' || CASE WHEN width <> 0 AND height <> 0 THEN '_' || width || 'x' || height ELSE '' END || '_' || {_AT} || {_EXT}"
    there = "orig_name IS NOT NULL AND taken_at IS NOT NULL"
    loose = f"UNION ALL SELECT id, {where}, {plain}, 2, '', id FROM dated WHERE type = 'psd' AND {there} AND id NOT IN (SELECT psd_file_id FROM ({SQL_LINKS}))" if dialect == "v2" else ""
    taken = f"SELECT {sql.parent('dest_path')} AS folder, {sql.name('dest_path')} AS name FROM files WHERE dest_path IS NOT NULL AND id NOT IN (SELECT id FROM wants)" if dialect == "v2" else "SELECT folder, want AS name FROM wants WHERE false"
    return f"""WITH RECURSIVE {sql.PLANNED}, j AS (SELECT *, {sql.normal_stem(_STEM, dialect)} AS group_stem, date_trunc('second', taken_at) AS sec FROM dated WHERE type = 'jpeg' AND {there}),
g AS (SELECT *, row_number() OVER (PARTITION BY group_stem, sec ORDER BY coalesce(width, 0)::BIGINT * coalesce(height, 0) DESC, id) = 1 AS is_main, min(id) OVER (PARTITION BY group_stem, sec) AS first_id FROM j),
wants AS (SELECT id, {where} AS folder, {plain} AS want, 0 AS pass, type AS kind, id AS first_id FROM dated WHERE type IN ('raw', 'video', 'tiff') AND {there}
  UNION ALL SELECT id, {where}, CASE WHEN is_main THEN {plain} ELSE {resized} END, 1, '', first_id FROM g {loose}),
taken AS ({taken}), {sql.numbered()}
SELECT id, folder || '/' || name AS dest_path FROM named"""


SQL_LINKS = f"SELECT psd_file_id FROM ({linking.SQL['psd_stem_link_v2']})"
SQL |= {
    "dest_plan": _plan("v2"),
    "dest_plan_v1": _plan("v1"),
    "sidecar_dest_v1": f"""WITH RECURSIVE one AS ({SQL['sidecar_dest']}),
wants AS (SELECT sidecar_file_id AS id, {sql.parent('dest_path')} AS folder, {sql.name('dest_path')} AS want, 0 AS pass, '' AS kind, 0 AS first_id FROM one WHERE dest_path IS NOT NULL),
taken AS (SELECT {sql.parent('dest_path')} AS folder, {sql.name('dest_path')} AS name FROM files WHERE dest_path IS NOT NULL AND id NOT IN (SELECT id FROM wants)), {sql.numbered()}
SELECT id AS sidecar_file_id, folder || '/' || name AS dest_path FROM named""",
}
