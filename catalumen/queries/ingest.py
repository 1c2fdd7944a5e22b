"""Catalogue upserts over whole scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalumen.functions.paths import file_name, parent
from catalumen.operators import catalog
from catalumen.queries import sql
from catalumen.runtime import table


def dedup_canonical(spark: SparkSession, d: str) -> DataFrame:
    return catalog.canonical(table(spark, d, "file_records"))


def dedup_strict(spark: SparkSession, d: str) -> DataFrame:
    return catalog.canonical(table(spark, d, "file_records"), strict=True).select("content", "copies", "first_seq", "orig_path")


def metadata_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.metadata_last(table(spark, d, "file_records"))
    return rows.withColumns({"capture_datetime": F.date_format("capture_datetime", "yyyy-MM-dd HH:mm:ss"), "aspect_ratio": F.round("aspect_ratio", 9)})


def occurrence_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.occurrences_last(table(spark, d, "file_occurrences"))
    return rows.select("path", "file_id", "hash", "size_bytes", F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss").alias("seen"))


def occurrence_append(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of the catalogue and of the incoming records, per path."""
    new = table(spark, d, "file_records").select(F.col("orig_path").alias("path"), F.coalesce("hash", "sparse_hash").alias("hash"), "is_seed")
    every = catalog.append_occurrences(table(spark, d, "file_occurrences").select("path", "file_id", "hash", "is_seed"), new)
    return every.groupBy("path").agg(F.count(F.lit(1)).alias("seen"), F.count("file_id").alias("catalogued"))


def known_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return catalog.known_sparse(table(spark, d, "files"), table(spark, d, "file_occurrences"))


def hashing_plan(spark: SparkSession, d: str) -> DataFrame:
    return catalog.hashing_plan(table(spark, d, "file_records"), known_fingerprints(spark, d))


def used_names(spark: SparkSession, d: str) -> DataFrame:
    dest = F.col("dest_path")
    names = table(spark, d, "files").filter(dest.isNotNull()).select(parent(dest).alias("folder"), file_name(dest).alias("name")).distinct()
    return names.groupBy("folder").agg(F.count(F.lit(1)).alias("names"))


def file_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the scan's contents: the catalogue's where it has the content, new ones after them."""
    have = table(spark, d, "files").withColumn("content", catalog.identity()).filter("content is not null").groupBy("content").agg(F.min("id").alias("id"))
    rows = catalog.canonical(table(spark, d, "file_records")).select("content", "first_seq")
    return catalog.assign_ids(rows, have).select("content", "id")


QUERIES = {f.__name__: f for f in (dedup_canonical, dedup_strict, metadata_last_wins, occurrence_upsert, occurrence_append, known_fingerprints, hashing_plan, used_names, file_ids)}

_F, _S = sql.full_hash("hash"), sql.sparse_hash("sparse_hash")
_R = f"r AS (SELECT * EXCLUDE (hash, sparse_hash), {_F} AS hash, {_S} AS sparse_hash FROM file_records), k AS (SELECT *, coalesce(sparse_hash, hash) AS content FROM r WHERE coalesce(sparse_hash, hash) IS NOT NULL)"
_BEST = "(coalesce(is_seed, false)::INT, coalesce(name_score, -2147483647), -record_id)"
_KNOWN = f"known AS (SELECT DISTINCT s AS sparse_hash FROM (SELECT {_S} AS s FROM files UNION ALL SELECT {sql.sparse_hash('hash')} FROM file_occurrences WHERE hash_is_sparse) WHERE s IS NOT NULL)"

SQL = {
    "dedup_canonical": f"""WITH {_R},
b AS (SELECT content, orig_name, orig_path, is_seed, name_score FROM k QUALIFY row_number() OVER (PARTITION BY content ORDER BY {_BEST} DESC) = 1),
f AS (SELECT content, type, ext, size_bytes FROM k QUALIFY row_number() OVER (PARTITION BY content ORDER BY record_id) = 1),
a AS (SELECT content, arg_min(hash, record_id) FILTER (WHERE hash IS NOT NULL) AS hash, arg_min(sparse_hash, record_id) FILTER (WHERE sparse_hash IS NOT NULL) AS sparse_hash,
  count(*) AS copies, min(record_id) AS first_seq, min(scanned_at) AS first_seen_at, max(scanned_at) AS last_seen_at FROM k GROUP BY content)
SELECT * FROM a JOIN b USING (content) JOIN f USING (content)""",
    "dedup_strict": f"""WITH r AS (SELECT * EXCLUDE (hash, sparse_hash), coalesce({_F}, {_S}) AS content FROM file_records)
SELECT content, count(*) AS copies, min(record_id) AS first_seq, arg_max(coalesce(orig_path, chr(0)), {_BEST}) AS orig_path FROM r WHERE content IS NOT NULL GROUP BY content""",
    "metadata_last_wins": f"""WITH {_R}
SELECT content, strftime(capture_datetime, '%Y-%m-%d %H:%M:%S') AS capture_datetime, camera_model, lens_model, width, height, duration_sec, phash,
  CASE WHEN width <> 0 AND height <> 0 THEN round(width::DOUBLE / height, 9) END AS aspect_ratio
FROM k WHERE type IN ('raw', 'jpeg', 'video', 'psd', 'tiff') QUALIFY row_number() OVER (PARTITION BY content ORDER BY record_id DESC) = 1""",
    "occurrence_upsert": """SELECT path, file_id, hash, size_bytes, strftime(seen_at, '%Y-%m-%d %H:%M:%S') AS seen FROM file_occurrences WHERE path IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY path ORDER BY seen_at DESC NULLS LAST, coalesce(file_id, -1) DESC, coalesce(hash, '') DESC, coalesce(size_bytes, -1) DESC) = 1""",
    "occurrence_append": """SELECT path, count(*) AS seen, count(file_id) AS catalogued FROM (SELECT path, file_id FROM file_occurrences UNION ALL SELECT orig_path, NULL FROM file_records) GROUP BY path""",
    "known_fingerprints": f"WITH {_KNOWN} SELECT sparse_hash FROM known",
    "hashing_plan": f"""WITH {_KNOWN}, r AS (SELECT record_id, {_S} AS sparse_hash FROM file_records),
n AS (SELECT record_id, sparse_hash, row_number() OVER (PARTITION BY sparse_hash ORDER BY record_id) = 1 AS first_sight FROM r WHERE sparse_hash IS NOT NULL)
SELECT record_id, sparse_hash, first_sight, NOT first_sight OR sparse_hash IN (SELECT sparse_hash FROM known) AS needs_full FROM n""",
    "used_names": f"SELECT {sql.parent('dest_path')} AS folder, count(DISTINCT {sql.name('dest_path')}) AS names FROM files WHERE dest_path IS NOT NULL GROUP BY 1",
    "file_ids": f"""WITH {_R}, have AS (SELECT coalesce({_S}, {_F}) AS content, min(id) AS id FROM files WHERE coalesce({_S}, {_F}) IS NOT NULL GROUP BY 1),
c AS (SELECT content, min(record_id) AS s FROM k GROUP BY content)
SELECT c.content, coalesce(have.id, (SELECT max(id) FROM have) + row_number() OVER (PARTITION BY have.id IS NULL ORDER BY s)) AS id FROM c LEFT JOIN have USING (content)""",
}
