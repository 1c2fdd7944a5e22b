"""Links and destinations of layered documents that are derived from the catalogue's own pictures.

The catalogue's layered documents share no stem with their sources at small scales. So each raw file and picture gets a
document named after it, in one of several spellings; those of the last spelling are known by embedded names only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalumen.functions.paths import stem
from catalumen.operators import links, reports
from catalumen.operators.catalog import metadata_of
from catalumen.plans import destinations
from catalumen.queries import sql
from catalumen.runtime import cut, table

#: Ids of the derived documents come after all others.
FIRST = 10_000_000_000
ENDINGS = ["", "_edit", "-final", "_v2", " (3)", "_working", "_lone"]


def _ending() -> Column:
    return F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("id") % len(ENDINGS) + 1).cast("int"))


def with_documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(files, references): all files and the derived documents; the names that the latter embed."""
    files = table(spark, d, "files").select("id", "type", "orig_name", "orig_path", "dest_path")
    sources = files.filter(F.col("type").isin("raw", "jpeg") & F.col("orig_name").isNotNull())
    made = sources.select((F.col("id") + FIRST).alias("id"), F.lit("psd").alias("type"), F.concat(stem(F.col("orig_name")), _ending(), F.lit(".psd")).alias("orig_name"), F.concat(F.lit("/made/"), "orig_name").alias("orig_path"), F.lit(None).cast("string").alias("dest_path"))
    lone = sources.filter(_ending() == ENDINGS[-1]).select((F.col("id") + FIRST).alias("psd_file_id"), F.posexplode(F.array(F.lit("none.jpg"), F.col("orig_name"))).alias("pos", "name"))
    return files.unionByName(made), lone


def _links(spark: SparkSession, d: str, dialect: str) -> tuple[DataFrame, DataFrame]:
    files, names = with_documents(spark, d)
    return files, cut(links.psd_links(files, names, dialect))


def layered_links_v1(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d, "v1")[1]


def layered_links_v2(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d, "v2")[1]


def layered_dest_v2(spark: SparkSession, d: str) -> DataFrame:
    files, told = _links(spark, d, "v2")
    return destinations.psd_destinations(files.filter("type = 'psd'").select("id", "orig_name"), told, files.select("id", "dest_path"))


def layered_dest_v1(spark: SparkSession, d: str) -> DataFrame:
    """Documents are dated by rule, a day for each id."""
    files, told = _links(spark, d, "v1")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 400).cast("int")).cast("timestamp_ntz")
    return destinations.psd_destinations(files.filter("type = 'psd'").select("id", "orig_name", day.alias("at")), told, files.select("id", "dest_path"), "v1")


def layered_orphans(spark: SparkSession, d: str) -> DataFrame:
    files, told = _links(spark, d, "v2")
    return links.without_link(files.filter("type = 'psd'").select("id", "orig_name"), told, "id", "psd_file_id")


def layered_unlinked(spark: SparkSession, d: str) -> DataFrame:
    files, told = _links(spark, d, "v1")
    return reports.unlinked_psds(files, metadata_of(table(spark, d, "media_metadata")), told)


QUERIES = {f.__name__: f for f in (layered_links_v1, layered_links_v2, layered_dest_v1, layered_dest_v2, layered_orphans, layered_unlinked)}

_STEM = sql.stem("orig_name")
_SOURCES = "FROM files WHERE type IN ('raw', 'jpeg') AND orig_name IS NOT NULL"
_MADE = f"""lf AS (SELECT id, type, orig_name, orig_path, dest_path FROM files
  UNION ALL SELECT id + {FIRST}, 'psd', {_STEM} || {ENDINGS}[id % {len(ENDINGS)} + 1] || '.psd', '/made/' || orig_name, NULL {_SOURCES}),
refs AS (SELECT id + {FIRST} AS psd_file_id, unnest([0, 1]) AS pos, unnest(['none.jpg', orig_name]) AS name {_SOURCES} AND id % {len(ENDINGS)} = {len(ENDINGS) - 1})"""


def _linked(dialect: str) -> str:
    last = "DESC" if dialect == "v2" else "ASC"
    inner = sql.normal_stem(sql.stem("name") if dialect == "v2" else "name", dialect)
    whole = sql.normal_stem("orig_name" if dialect == "v1" else _STEM, dialect)
    return f"""{_MADE},
s AS (SELECT {sql.normal_stem(_STEM, dialect)} AS key, {whole} AS inner_key, type, id FROM lf WHERE type IN ('raw', 'jpeg') AND orig_name IS NOT NULL),
direct AS (SELECT p.id AS psd_file_id, s.id AS source_file_id FROM (SELECT id, {sql.psd_stem(_STEM, dialect)} AS key FROM lf WHERE type = 'psd' AND orig_name IS NOT NULL) p JOIN s USING (key)
  QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY s.type {last}, s.id {last}) = 1),
embedded AS (SELECT psd_file_id, s.id AS source_file_id FROM (SELECT psd_file_id, pos, {inner} AS inner_key FROM refs WHERE psd_file_id NOT IN (SELECT psd_file_id FROM direct)) r JOIN s USING (inner_key)
  QUALIFY row_number() OVER (PARTITION BY psd_file_id ORDER BY pos {last}, s.type {last}, s.id {last}) = 1),
links AS (SELECT *, 100 AS confidence, 'stem' AS link_method FROM direct UNION ALL SELECT *, 95, 'smart_object' FROM embedded)"""


SQL = {
    "layered_links_v1": f"WITH {_linked('v1')} SELECT * FROM links",
    "layered_links_v2": f"WITH {_linked('v2')} SELECT * FROM links",
    "layered_dest_v2": f"""WITH {_linked('v2')} SELECT psd_file_id, regexp_replace({sql.parent('s.dest_path')}, '(?i)(^|/)raw(/|$)', '\\1output\\2') || '/' || p.orig_name AS dest_path
 FROM links JOIN lf p ON p.id = psd_file_id JOIN lf s ON s.id = source_file_id WHERE s.dest_path IS NOT NULL""",
    "layered_dest_v1": f"""WITH RECURSIVE {_linked('v1')},
q AS (SELECT p.id, p.orig_name, coalesce({sql.parent('s.dest_path')}, 'output/' || strftime(DATE '2020-01-01' + (p.id % 400)::INT, '%Y/%Y-%m') || '/unlinked-psds') AS folder
  FROM lf p LEFT JOIN links ON psd_file_id = p.id LEFT JOIN lf s ON s.id = source_file_id WHERE p.type = 'psd'),
wants AS (SELECT id, folder, orig_name AS want, 0 AS pass, '' AS kind, 0 AS first_id FROM q WHERE orig_name IS NOT NULL),
taken AS (SELECT folder, want AS name FROM wants WHERE false), {sql.numbered(' ({})')}
SELECT id AS psd_file_id, folder || '/' || name AS dest_path FROM named""",
    "layered_orphans": f"WITH {_linked('v2')} SELECT id, orig_name FROM lf WHERE type = 'psd' AND id NOT IN (SELECT psd_file_id FROM links)",
    "layered_unlinked": f"WITH {sql.META}, {_linked('v1')} SELECT id, orig_name, orig_path, dest_path, capture_datetime, camera_model FROM lf LEFT JOIN meta ON id = file_id WHERE type = 'psd' AND id NOT IN (SELECT psd_file_id FROM links WHERE confidence >= 95)",
}
