"""Expressions over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalumen.functions import content, paths, times
from catalumen.functions.constants import CAMERA_NAMES
from catalumen.queries import sql
from catalumen.runtime import table



def _files(**columns: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: table(spark, d, "files").select("id", *(make().alias(k) for k, make in columns.items()))


def _stem() -> Column:
    return paths.stem(F.col("orig_name"))


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    n = paths.file_name(F.col("path"))
    return table(spark, d, "file_occurrences").select("path", n.alias("name"), paths.stem(n).alias("stem"), paths.suffix(n).alias("suffix"), paths.parent(F.col("path")).alias("parent"))


def clean_paths(spark: SparkSession, d: str) -> DataFrame:
    quoted = F.concat(F.lit(' "'), F.regexp_replace("path", "/", "//"), F.lit('/" '))
    return table(spark, d, "file_occurrences").select("path", paths.clean_path(quoted).alias("clean"))


def skip_subtree(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences outside the scan roots that have no zone or lie in another root."""
    roots = table(spark, d, "scan_roots").select(F.col("root_path").alias("skip_dir"), "time_zone")
    zoneless = roots.filter("time_zone is null").select("skip_dir")
    return paths.outside(table(spark, d, "file_occurrences").select("path", "file_id"), zoneless.unionByName(paths.nested(roots.select("skip_dir"))))


def _texts(make: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: table(spark, d, "media_metadata").select("file_id", F.col("capture_datetime").alias("text"), times.iso(make(F.col("capture_datetime"))).alias("local"))


def aspect_ratio(spark: SparkSession, d: str) -> DataFrame:
    sized = (F.col("width") != 0) & (F.col("height") != 0)
    return table(spark, d, "media_metadata").select("file_id", "width", "height", F.when(sized, F.round(F.col("width") / F.col("height"), 9)).alias("ratio"))


def date_from_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_occurrences").select("path", times.date_from_path(F.col("path")).cast("string").alias("day"))


def duration_parse(spark: SparkSession, d: str) -> DataFrame:
    s = F.floor("duration_sec").cast("long")
    clock = F.concat_ws(":", (s / 3600).cast("long").cast("string"), F.lpad((s / 60 % 60).cast("int").cast("string"), 2, "0"), F.lpad((s % 60).cast("string"), 2, "0"))
    rows = table(spark, d, "media_metadata").filter("duration_sec >= 0")
    return rows.select("file_id", clock.alias("clock"), times.clock_seconds(clock).alias("seconds"))


def fingerprints(block: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        raw = F.encode(F.col("text"), "UTF-8")
        return table(spark, d, "documents").filter("text is not null").select("doc_id", content.full_fingerprint(raw).alias("full_hash"), content.sparse_fingerprint(raw, block).alias("sparse_hash"))

    return run


def shorten_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", paths.shorten(F.col("text")).alias("short"))


def phash_distance(spark: SparkSession, d: str) -> DataFrame:
    """Bits by which each output's hash differs from its raw file's fellow outputs' first one; hashes count however spelt."""
    value = content.picture_value(F.col("phash"))
    # as unsigned numbers hashes sort like their digits
    order = F.lpad(F.hex(value), 16, "0")
    media = table(spark, d, "media_metadata").filter(value.isNotNull()).groupBy("file_id").agg(F.min(F.struct(order.alias("o"), value.alias("v"))).alias("h"))
    links = table(spark, d, "raw_outputs").join(media, F.col("output_file_id") == F.col("file_id"))
    first = links.groupBy("raw_file_id").agg(F.min("h").alias("first"))
    return links.join(first, "raw_file_id").select("raw_file_id", "output_file_id", content.hamming(F.col("h.v"), F.col("first.v")).cast("int").alias("bits"))


QUERIES = {
    "path_parts": path_parts,
    "classify": _files(scanned=lambda: paths.file_type(F.col("orig_name")), reported=lambda: paths.file_type(F.col("orig_name"), False)),
    "name_score_v1": _files(score=lambda: paths.name_score(_stem(), "v1")),
    "name_score_v2": _files(score=lambda: paths.name_score(_stem(), "v2")),
    "normalize_stem_v1": _files(stem=lambda: paths.normal_stem(_stem(), "v1")),
    "normalize_stem_v2": _files(stem=lambda: paths.normal_stem(_stem(), "v2")),
    "psd_suffix_strip_v1": _files(stem=lambda: paths.psd_stem(_stem(), "v1")),
    "psd_suffix_strip_v2": _files(stem=lambda: paths.psd_stem(_stem(), "v2")),
    "digit_core": _files(core=lambda: paths.digit_core(_stem())),
    "clean_paths": clean_paths,
    "skip_subtree": skip_subtree,
    "exif_date_parse": _texts(times.exif_time),
    "flexible_date_parse": _texts(times.flexible_time),
    "media_date_zone": _texts(lambda c: times.media_time(c, "Etc/GMT-9")),
    "date_from_path": date_from_path,
    "duration_parse": duration_parse,
    "aspect_ratio": aspect_ratio,
    "content_fingerprints": fingerprints(4096),
    "sparse_fingerprint": fingerprints(64),
    "shorten_values": shorten_values,
    "phash_distance": phash_distance,
}


def _score(dialect: str) -> str:
    s = f"lower({sql.stem('orig_name')})"
    camera = " OR ".join(f"regexp_matches({s}, '{p}')" for p in CAMERA_NAMES)
    copy = f"contains({s}, 'copy')" if dialect == "v2" else f"regexp_matches({s}, '(^|[^\\p{{L}}\\p{{N}}_])copy([^\\p{{L}}\\p{{N}}_]|$)')"
    letters, digits = (f"length(regexp_replace({s}, '[^\\p{{{c}}}]', '', 'g'))" for c in ("L", "Nd"))
    score = f"CASE WHEN {camera} THEN -5 ELSE 0 END + CASE WHEN {copy} THEN -4 ELSE 0 END + CASE WHEN contains({s}, ' ') THEN 2 ELSE 0 END + CASE WHEN contains({s}, '-') OR contains({s}, '_') THEN 1 ELSE 0 END + CASE WHEN {letters} > {digits} THEN 2 ELSE 0 END"
    return f"SELECT id, (CASE WHEN orig_name IS NOT NULL THEN {score}{f' + CASE WHEN length({s}) >= 12 THEN 1 ELSE 0 END' if dialect == 'v1' else ''} END)::INTEGER AS score FROM files"


def _fingerprints(block: int) -> str:
    size, blob = "octet_length(encode(text))", "encode(text)"
    middle = f"CASE WHEN {size} > {3 * block} THEN {blob}[{size} // 2 + 1:{size} // 2 + {block}] ELSE ''::BLOB END"
    last = f"CASE WHEN {size} > {2 * block} THEN {blob}[{size} - {block - 1}:{size}] ELSE ''::BLOB END"
    return f"SELECT doc_id, sha256({blob}) AS full_hash, 's-' || sha256(encode({size}::VARCHAR) || {blob}[1:{block}] || {middle} || {last}) AS sparse_hash FROM documents WHERE text IS NOT NULL"


_N = sql.name("path")
_STEM = sql.stem("orig_name")
_YEAR, _MONTH = "^(19|20)\\d{2}$", "^(0[1-9]|1[0-2])$"


def _day(pattern: str) -> str:
    g = [f"regexp_extract(p, '{pattern}', {i})" for i in (1, 2, 3)]
    return f"list_filter(list_transform(parts, lambda p: CASE WHEN regexp_matches(p, '{pattern}') THEN try_cast({g[0]} || '-' || lpad({g[1]}, 2, '0') || '-' || lpad({g[2]}, 2, '0') AS DATE) END), lambda x: x IS NOT NULL)[1]"


SQL = {
    "path_parts": f"SELECT path, {_N} AS name, {sql.stem(_N)} AS stem, {sql.suffix(_N)} AS suffix, {sql.parent('path')} AS parent FROM file_occurrences",
    "classify": f"SELECT id, {sql.kind('orig_name', True)} AS scanned, {sql.kind('orig_name', False)} AS reported FROM files",
    "name_score_v1": _score("v1"),
    "name_score_v2": _score("v2"),
    "normalize_stem_v1": f"SELECT id, {sql.normal_stem(_STEM, 'v1')} AS stem FROM files",
    "normalize_stem_v2": f"SELECT id, {sql.normal_stem(_STEM)} AS stem FROM files",
    "psd_suffix_strip_v1": f"SELECT id, {sql.psd_stem(_STEM, 'v1')} AS stem FROM files",
    "psd_suffix_strip_v2": f"SELECT id, {sql.psd_stem(_STEM)} AS stem FROM files",
    "digit_core": f"SELECT id, regexp_replace({_STEM}, '[^0-9]', '', 'g') AS core FROM files",
    "clean_paths": "SELECT path, regexp_replace(regexp_replace(path, '/+', '/', 'g'), '(.)/$', '\\1') AS clean FROM file_occurrences",
    "skip_subtree": """SELECT path, file_id FROM file_occurrences o WHERE NOT EXISTS (SELECT 1 FROM scan_roots r
 WHERE (time_zone IS NULL OR EXISTS (SELECT 1 FROM scan_roots q WHERE starts_with(rtrim(r.root_path, '/'), rtrim(q.root_path, '/') || '/'))) AND (o.path = rtrim(root_path, '/') OR starts_with(o.path, rtrim(root_path, '/') || '/')))""",
    "exif_date_parse": r"""SELECT file_id, capture_datetime AS text, CASE WHEN regexp_matches(capture_datetime, '^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$')
 THEN strftime(try_cast(regexp_replace(capture_datetime, '^(\d{4}):(\d{2}):', '\1-\2-') AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') END AS local FROM media_metadata""",
    "flexible_date_parse": f"SELECT file_id, capture_datetime AS text, strftime({sql.flexible_time('capture_datetime')}, '%Y-%m-%dT%H:%M:%S') AS local FROM media_metadata",
    "media_date_zone": f"SELECT file_id, capture_datetime AS text, strftime({sql.flexible_time('capture_datetime')} + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') AS local FROM media_metadata",
    "date_from_path": f"""WITH s AS (SELECT path, string_split(path, '/') AS parts FROM file_occurrences)
SELECT path, coalesce({_day('^((?:19|20)[0-9]{2})[-_]([0-9]{1,2})[-_]([0-9]{1,2})$')}, {_day('^((?:19|20)[0-9]{2})([0-9]{2})([0-9]{2})$')},
  list_filter(list_transform(range(1, len(parts) + 1), lambda i: CASE WHEN regexp_matches(parts[i], '{_YEAR}') THEN
    CASE WHEN regexp_matches(parts[i + 1], '{_MONTH}') THEN try_cast(parts[i] || '-' || parts[i + 1] || '-01' AS DATE)
         WHEN i > 1 AND regexp_matches(parts[i - 1], '{_MONTH}') THEN try_cast(parts[i] || '-' || parts[i - 1] || '-01' AS DATE) END END), lambda x: x IS NOT NULL)[1],
  list_filter(list_transform(parts, lambda p: CASE WHEN regexp_matches(p, '{_YEAR}') THEN try_cast(p || '-01-01' AS DATE) END), lambda x: x IS NOT NULL)[1])::VARCHAR AS day FROM s""",
    "duration_parse": """SELECT file_id, (s // 3600)::VARCHAR || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock, s::DOUBLE AS seconds
 FROM (SELECT file_id, floor(duration_sec)::BIGINT AS s FROM media_metadata WHERE duration_sec >= 0 AND NOT isnan(duration_sec))""",
    "aspect_ratio": "SELECT file_id, width, height, CASE WHEN width <> 0 AND height <> 0 THEN round(width::DOUBLE / height, 9) END AS ratio FROM media_metadata",
    "content_fingerprints": _fingerprints(4096),
    "sparse_fingerprint": _fingerprints(64),
    "shorten_values": "SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 57) || '...' ELSE text END AS short FROM documents",
    "phash_distance": f"""WITH m AS (SELECT file_id, min({sql.phash('phash')}) AS p FROM media_metadata WHERE {sql.phash('phash')} IS NOT NULL GROUP BY file_id),
l AS (SELECT raw_file_id, output_file_id, p FROM raw_outputs JOIN m ON output_file_id = file_id),
f AS (SELECT raw_file_id, min(p) AS first_hash FROM l GROUP BY raw_file_id)
SELECT raw_file_id, output_file_id, bit_count(xor(('0x' || p)::UBIGINT, ('0x' || first_hash)::UBIGINT))::INTEGER AS bits FROM l JOIN f USING (raw_file_id)""",
}
