"""Links between files, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalumen.functions.content import picture_value
from catalumen.functions.times import flexible_time, local_seconds
from catalumen.operators import links
from catalumen.operators.catalog import metadata_of
from catalumen.queries import sql
from catalumen.runtime import cut, table


def captures(spark: SparkSession, d: str) -> DataFrame:
    """Files with their metadata; at: the capture time in seconds of its own clock."""
    meta = metadata_of(table(spark, d, "media_metadata")).withColumnRenamed("file_id", "id")
    rows = table(spark, d, "files").select("id", "type", "orig_name").join(meta, "id", "left")
    return rows.withColumn("at", local_seconds(flexible_time(F.col("capture_datetime"))))


def sidecar_link(spark: SparkSession, d: str) -> DataFrame:
    return links.sidecar_links(table(spark, d, "files"))


def sidecar_link_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return links.sidecar_links_of_occurrences(table(spark, d, "file_occurrences"), table(spark, d, "files"))


def sidecar_index(spark: SparkSession, d: str) -> DataFrame:
    return links.sidecar_index(table(spark, d, "file_occurrences"), table(spark, d, "files"))


def digit_core_time_link(spark: SparkSession, d: str) -> DataFrame:
    return links.by_name_and_time(captures(spark, d))


def time_camera_band_link(spark: SparkSession, d: str) -> DataFrame:
    return links.by_time_and_camera(captures(spark, d))


def phash_band_link(spark: SparkSession, d: str) -> DataFrame:
    return links.by_picture(captures(spark, d))


def phash_band_link_bits(spark: SparkSession, d: str) -> DataFrame:
    """Outputs that look like the raw file, at most 30 s apart: hashes differ in at most 5 bits. A raw file's hash is that of
    its catalogued output of the smallest id that has one."""
    rows = cut(captures(spark, d).select("id", "type", "phash", "at"))
    outs = rows.select(F.col("id").alias("output_file_id"), "phash").filter(picture_value(F.col("phash")).isNotNull())
    met = table(spark, d, "raw_outputs").select("raw_file_id", "output_file_id").join(outs, "output_file_id")
    raw = met.groupBy("raw_file_id").agg(F.min_by("phash", "output_file_id").alias("raw_phash"))
    return links.by_picture(rows, raw)


def link_priority_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(captures(spark, d))
    return links.merge_links(links.by_name_and_time(rows), links.by_time_and_camera(rows), links.by_picture(rows))


def psd_stem_link_v1(spark: SparkSession, d: str) -> DataFrame:
    return links.psd_links(table(spark, d, "files"), dialect="v1")


def psd_stem_link_v2(spark: SparkSession, d: str) -> DataFrame:
    return links.psd_links(table(spark, d, "files"))


QUERIES = {f.__name__: f for f in (sidecar_link, sidecar_link_occurrences, sidecar_index, digit_core_time_link, time_camera_band_link, phash_band_link, phash_band_link_bits, link_priority_merge, psd_stem_link_v1, psd_stem_link_v2)}

_OUT = "('jpeg', 'psd', 'video', 'tiff')"
_CORE = f"regexp_replace({sql.stem('orig_name')}, '[^0-9]', '', 'g')"
_SIDES = f"""WITH {sql.CAPTURES},
x AS (SELECT *, {_CORE} AS core, epoch(date_trunc('second', taken_at))::BIGINT AS s FROM captures),
raws AS (SELECT * FROM x WHERE type = 'raw'), outs AS (SELECT * FROM x WHERE type IN {_OUT}),
p1 AS (SELECT DISTINCT r.id AS raw_file_id, o.id AS output_file_id, 'filename_time' AS link_method, 100 AS confidence FROM raws r JOIN outs o ON r.capture_datetime = o.capture_datetime AND r.core = o.core WHERE r.core <> '' AND r.capture_datetime <> ''),
p2 AS (SELECT DISTINCT r.id AS raw_file_id, o.id AS output_file_id, 'time_camera' AS link_method, 90 AS confidence FROM raws r JOIN outs o ON r.camera_model = o.camera_model AND abs(r.s - o.s) <= 2 WHERE r.camera_model <> ''),
p3 AS (SELECT DISTINCT r.id AS raw_file_id, o.id AS output_file_id, 'phash' AS link_method, 70 AS confidence FROM raws r JOIN outs o ON o.s BETWEEN r.s - 30 AND r.s + 30 WHERE o.phash <> '')
"""


def _psd(dialect: str) -> str:
    last = "DESC" if dialect == "v2" else "ASC"
    return f"""WITH s AS (SELECT {sql.normal_stem(sql.stem('orig_name'), dialect)} AS key, type, id FROM files WHERE type IN ('raw', 'jpeg') AND orig_name IS NOT NULL),
p AS (SELECT id AS psd_file_id, {sql.psd_stem(sql.stem('orig_name'), dialect)} AS key FROM files WHERE type = 'psd' AND orig_name IS NOT NULL)
SELECT psd_file_id, s.id AS source_file_id, 100 AS confidence, 'stem' AS link_method FROM p JOIN s USING (key)
QUALIFY row_number() OVER (PARTITION BY psd_file_id ORDER BY s.type {last}, s.id {last}) = 1"""


SQL = {
    "sidecar_link": f"""WITH f AS (SELECT id, type, {sql.parent('orig_path')} AS dir, lower({sql.stem(sql.name('orig_path'))}) AS st FROM files WHERE orig_path IS NOT NULL)
SELECT DISTINCT r.id AS raw_file_id, s.id AS sidecar_file_id FROM f r JOIN f s USING (dir, st) WHERE r.type = 'raw' AND s.type = 'sidecar'""",
    "sidecar_link_occurrences": f"""WITH f AS (SELECT DISTINCT f.id, type, {sql.parent('path')} AS dir, lower({sql.stem(sql.name('path'))}) AS st FROM file_occurrences o JOIN files f ON f.id = o.file_id WHERE path IS NOT NULL)
SELECT DISTINCT r.id AS raw_file_id, s.id AS sidecar_file_id FROM f r JOIN f s USING (dir, st) WHERE r.type = 'raw' AND s.type = 'sidecar'""",
    "sidecar_index": f"""WITH f AS (SELECT DISTINCT f.id, type, {sql.parent('path')} AS dir, lower({sql.stem(sql.name('path'))}) AS stem FROM file_occurrences o JOIN files f ON f.id = o.file_id WHERE path IS NOT NULL AND type IN ('raw', 'sidecar'))
SELECT dir, stem, count(*) FILTER (WHERE type = 'raw') AS raws, count(*) FILTER (WHERE type = 'sidecar') AS sidecars FROM f GROUP BY dir, stem""",
    "digit_core_time_link": _SIDES + "SELECT * FROM p1",
    "time_camera_band_link": _SIDES + "SELECT * FROM p2",
    "phash_band_link": _SIDES + "SELECT * FROM p3",
    "phash_band_link_bits": _SIDES
    + f""", h AS (SELECT id, ('0x' || {sql.phash('phash')})::UBIGINT AS v FROM captures WHERE {sql.phash('phash')} IS NOT NULL),
rh AS (SELECT raw_file_id, arg_min(v, output_file_id) AS v FROM raw_outputs JOIN h ON h.id = output_file_id GROUP BY raw_file_id)
SELECT p3.* FROM p3 JOIN rh USING (raw_file_id) JOIN h ON h.id = output_file_id WHERE bit_count(xor(rh.v, h.v)) <= 5""",
    "link_priority_merge": _SIDES + "SELECT * FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) QUALIFY row_number() OVER (PARTITION BY raw_file_id, output_file_id ORDER BY confidence DESC) = 1",
    "psd_stem_link_v1": _psd("v1"),
    "psd_stem_link_v2": _psd("v2"),
}
