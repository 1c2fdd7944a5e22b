"""Metadata from tag maps, tool outputs and organizer logs that are made from the catalogue's own values.

No media files come with the catalogue. So each metadata row is dressed as what a reader or a tool would have given for it,
in turns of its file_id, and each file as a line that an organizer would have logged about it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalumen.functions import tags, times
from catalumen.operators import logs
from catalumen.queries import sql
from catalumen.runtime import table
from catalumen.sources.diagnostics import tag_rows


def _turn(n: int, k: int, value: Column | str) -> Column:
    """The value for rows whose turn it is, else null."""
    return F.when(F.col("file_id") % n == k, F.col(value) if isinstance(value, str) else value)


def _map(**named: Column) -> Column:
    return F.create_map(*(x for k, v in named.items() for x in (F.lit(k.replace("__space__", " ")), v.cast("string"))))


def _millis() -> Column:
    return F.when(F.col("duration_sec") >= 0, F.floor(F.col("duration_sec") * 1000).cast("long"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "media_metadata").filter("file_id is not null")


def exif_tags(spark: SparkSession, d: str) -> DataFrame:
    """Date, camera and lens by the tags' order of trust, stripped and not."""
    second = F.concat(F.lit("2011:12:13 14:15:"), F.lpad((F.col("file_id") % 60).cast("string"), 2, "0"))
    made = _map(EXIF__space__DateTimeOriginal=_turn(3, 0, "capture_datetime"), EXIF__space__DateTimeDigitized=_turn(2, 0, second), Image__space__DateTime=_turn(5, 0, F.lit("2001:02:30 00:00:00")), Image__space__Model=F.concat(F.lit(" "), "camera_model", F.lit(" ")), EXIF__space__LensModel=F.col("lens_model"))
    rows = _rows(spark, d).select("file_id", tags.image_metadata(made).alias("a"), tags.image_metadata(made, strip=False).alias("b"))
    return rows.select("file_id", times.iso(F.col("a.capture_datetime")).alias("local"), F.col("a.camera_model").alias("camera"), F.col("a.lens_model").alias("lens"), F.col("b.camera_model").alias("raw_camera"))


def general_tags() -> Column:
    at = "capture_datetime"
    return _map(recorded_date=_turn(5, 0, at), encoded_date=_turn(5, 1, at), tagged_date=_turn(5, 2, at), file_last_modification_date=_turn(5, 3, at), duration=_turn(2, 0, _millis()), performer=_turn(4, 0, "camera_model"), device_model=_turn(4, 1, "camera_model"), encoded_library=_turn(4, 2, "camera_model"))


def tool_json() -> Column:
    at = "capture_datetime"
    made = _map(CreateDate=_turn(4, 0, at), CreationDate=_turn(4, 1, at), DateTimeOriginal=_turn(4, 2, at), MediaCreateDate=F.col(at), Duration=_millis(), Model=_turn(3, 0, "camera_model"), CameraModelName=_turn(3, 1, "camera_model"), Make=F.lit("Maker"), ImageWidth=F.col("width"), ImageHeight=F.col("height"), ComposedImageWidth=F.lit(7), ComposedImageHeight=F.lit(8))
    return F.when(F.col("file_id") % 6 != 5, F.to_json(F.array(made)))


def video_tags_v2(spark: SparkSession, d: str) -> DataFrame:
    """The container's date, duration and camera, or where it has neither date nor duration the tool's."""
    rows = _rows(spark, d).select("file_id", tags.video_metadata(general_tags(), tags.tool_tags(tool_json())).alias("v"))
    return rows.select("file_id", times.iso(F.col("v.capture_datetime")).alias("local"), F.col("v.duration_sec").alias("seconds"), F.col("v.camera_model").alias("camera"))


def video_tags_v1(spark: SparkSession, d: str) -> DataFrame:
    """The same in the older dialect: local dates as they are, others from UTC to a zone nine hours ahead."""
    at = "capture_datetime"
    made = _map(file_creation_date__local=_turn(4, 0, at), file_creation_date=_turn(4, 1, at), recorded_date=_turn(4, 2, at), encoded_date=F.col(at), duration=_turn(2, 0, _millis()), performer=_turn(4, 0, "camera_model"), encoder=_turn(4, 1, "camera_model"))
    rows = _rows(spark, d).select("file_id", tags.general_track_v1(made, "Etc/GMT-9").alias("v"))
    return rows.select("file_id", times.iso(F.col("v.capture_datetime")).alias("local"), F.col("v.duration_sec").alias("seconds"), F.col("v.camera_model").alias("camera"))


def video_diagnostic_rows(spark: SparkSession, d: str) -> DataFrame:
    """Three rows for each metadata row: what each of three tools says."""
    at = "capture_datetime"
    video = _map(width=F.col("width"), height=F.col("height"), format=F.lit("AVC"))
    stream = F.struct(F.lit("video").alias("codec_type"), F.col("width").cast("string").alias("width"), F.col("height").cast("string").alias("height"), F.lit("h264").alias("codec_name"), F.create_map(F.lit("creation_time"), F.col(at)).alias("tags"))
    sound = F.struct(F.lit("audio").alias("codec_type"), F.lit(None).cast("string").alias("width"), F.lit(None).cast("string").alias("height"), F.lit("aac").alias("codec_name"), F.create_map(F.lit("x"), F.lit("y")).alias("tags"))
    fmt = F.struct(_millis().cast("string").alias("duration"), F.create_map(F.lit("date"), _turn(2, 0, at)).alias("tags"))
    probe = F.when(F.col("file_id") % 7 != 0, F.to_json(F.struct(fmt.alias("format"), F.array(sound, stream).alias("streams"))))
    rows = _rows(spark, d).select("file_id", F.inline(tags.diagnose(general_tags(), video, probe, tool_json())))
    return rows.select("file_id", "tool", *tags.DIAGNOSTIC)


def inspected_tags(spark: SparkSession, d: str) -> DataFrame:
    """All tags of the general track, long values cut, and whether a tag's name tells of a camera."""
    long = F.repeat(F.col("capture_datetime"), 4)
    made = F.map_concat(general_tags(), F.create_map(F.lit("Comment"), long))
    rows = _rows(spark, d).select(F.col("file_id").cast("string").alias("file"), F.lit("General").alias("track"), F.map_filter(made, lambda k, v: v.isNotNull()).alias("tags"))
    return tag_rows(rows)


#: What an organizer logs about a file, in turns of its id: the line around the path, with the issue that it tells of.
LINES = [
    ("EXIF read failed for ", ": bad offset", "exif_read_failed"),
    ("No EXIF tags found for ", "", "no_exif_tags"),
    ("No EXIF date found for ", " (tags tried: a, b)", "no_exif_date"),
    ("Using filesystem mtime as capture_datetime for ", "", "using_filesystem_time_image"),
    ("MediaInfo.parse failed for ", ": no library", "mediainfo_failed"),
    ("No usable video metadata found for ", "; will fall back to filesystem time.", "no_video_metadata"),
    ("Using filesystem mtime as capture_datetime for video ", "", "using_filesystem_time_image"),
    ("pHash computation failed for ", ": truncated", "phash_failed"),
    ("Failed to get image size for ", ": truncated", "image_size_failed"),
    ("EXIF tags present but no datetime in ", "", None),
    ("copied ", "", None),
]


def organizer_log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(value; path): an organizer's log with a line for each file, and the paths of files of unknown types."""
    files = table(spark, d, "files").filter("orig_path is not null")
    turn = (F.col("id") % len(LINES) + 1).cast("int")
    around = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in LINES)), turn)
    lines = files.select(F.concat(F.lit("2024-01-02 03:04:05 WARNING "), around(0), "orig_path", around(1)).alias("value"))
    return lines, files.filter("type = 'other'").select(F.col("orig_path").alias("path"))


def log_issues_organizer(spark: SparkSession, d: str) -> DataFrame:
    """Issues per path of such a log, by the organizer's own nine patterns."""
    return logs.issue_summary(*organizer_log(spark, d))


QUERIES = {f.__name__: f for f in (exif_tags, video_tags_v2, video_tags_v1, video_diagnostic_rows, inspected_tags, log_issues_organizer)}


def _exif(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, '^\\d{{4}}:\\d{{2}}:\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}}$') THEN try_cast(regexp_replace({t}, '^(\\d{{4}}):(\\d{{2}}):', '\\1-\\2-') AS TIMESTAMP) END"


def _case(n: int, k: int, value: str = "capture_datetime") -> str:
    return f"CASE WHEN file_id % {n} = {k} THEN nullif({value}, '') END"


_MS = "CASE WHEN duration_sec >= 0 AND NOT isnan(duration_sec) THEN floor(duration_sec * 1000)::BIGINT END"
_ISO = "'%Y-%m-%dT%H:%M:%S'"
_M = "m AS (SELECT * FROM media_metadata WHERE file_id IS NOT NULL)"
_GENERAL = [_case(5, k) for k in range(4)]
_TOOL = "file_id % 6 <> 5"
_TOOL_DATES = [*(_case(4, k) for k in range(3)), "nullif(capture_datetime, '')"]
_TOOL_CAMERA = f"coalesce({_case(3, 0, 'camera_model')}, {_case(3, 1, 'camera_model')}, 'Maker')"
_PERFORMER = f"coalesce({', '.join(_case(4, k, 'camera_model') for k in range(3))})"
_NULL = "NULL::VARCHAR"


_ISSUES = ", ".join("NULL" if x[2] is None else f"'{x[2]}'" for x in LINES)
#: A path that a pattern ends at its first colon.
_SHORT = [i for i, x in enumerate(LINES) if x[1].startswith(": ")]
SQL = {
    "exif_tags": f"""WITH {_M} SELECT file_id, strftime(coalesce({_exif(_case(3, 0))}, CASE WHEN file_id % 2 = 0 THEN make_timestamp(2011, 12, 13, 14, 15, (file_id % 60)::DOUBLE) END), {_ISO}) AS local,
 nullif(trim(camera_model), '') AS camera, nullif(trim(lens_model), '') AS lens, ' ' || camera_model || ' ' AS raw_camera FROM m""",
    "video_tags_v2": f"""WITH {_M}, a AS (SELECT file_id, coalesce({', '.join(map(sql.flexible_time, _GENERAL))}) AS ga, CASE WHEN file_id % 2 = 0 THEN ({_MS}) / 1000.0 END AS gd, {_PERFORMER} AS gc,
  CASE WHEN {_TOOL} THEN coalesce({', '.join(map(sql.flexible_time, _TOOL_DATES))}) END AS ta, CASE WHEN {_TOOL} THEN ({_MS})::DOUBLE END AS td, CASE WHEN {_TOOL} THEN {_TOOL_CAMERA} END AS tc FROM m),
b AS (SELECT *, ga IS NOT NULL OR coalesce(gd, 0) <> 0 AS g, ta IS NOT NULL OR coalesce(td, 0) <> 0 AS t FROM a)
SELECT file_id, strftime(CASE WHEN g THEN ga WHEN t THEN ta END, {_ISO}) AS local, (CASE WHEN g THEN gd WHEN t THEN td END)::DOUBLE AS seconds, CASE WHEN g THEN gc WHEN t THEN tc END AS camera FROM b""",
    "video_tags_v1": f"""WITH {_M} SELECT file_id, strftime(coalesce({sql.flexible_time(_case(4, 0))}, {sql.flexible_time('capture_datetime')} + INTERVAL 9 HOUR), {_ISO}) AS local,
 (CASE WHEN file_id % 2 = 0 THEN ({_MS}) / 1000.0 END)::DOUBLE AS seconds, coalesce({_case(4, 0, 'camera_model')}, {_case(4, 1, 'camera_model')}) AS camera FROM m""",
    "video_diagnostic_rows": f"""WITH {_M}
SELECT file_id, 'mediainfo' AS tool, coalesce({', '.join(_GENERAL)}) AS capture_datetime, (CASE WHEN file_id % 2 = 0 THEN ({_MS}) / 1000.0 END)::DOUBLE::VARCHAR AS duration_sec, width::VARCHAR AS width, height::VARCHAR AS height,
  'AVC' AS codec, coalesce({_case(4, 0, 'camera_model')}, {_case(4, 1, 'camera_model')}) AS camera_model, '' AS notes FROM m
UNION ALL SELECT file_id, 'ffprobe', CASE WHEN p THEN coalesce({_case(2, 0)}, nullif(capture_datetime, '')) END, CASE WHEN p THEN ({_MS})::DOUBLE::VARCHAR END, CASE WHEN p THEN width::VARCHAR END, CASE WHEN p THEN height::VARCHAR END,
  CASE WHEN p THEN 'h264' END, {_NULL}, CASE WHEN p THEN '' ELSE 'no output' END FROM (SELECT *, file_id % 7 <> 0 AS p FROM m)
UNION ALL SELECT file_id, 'exiftool', CASE WHEN {_TOOL} THEN coalesce({', '.join(_TOOL_DATES[:3])}) END, CASE WHEN {_TOOL} THEN ({_MS})::DOUBLE::VARCHAR END,
  CASE WHEN NOT {_TOOL} THEN NULL WHEN width IS NOT NULL AND height IS NOT NULL THEN width::VARCHAR ELSE '7' END, CASE WHEN NOT {_TOOL} THEN NULL WHEN width IS NOT NULL AND height IS NOT NULL THEN height::VARCHAR ELSE '8' END,
  {_NULL}, CASE WHEN {_TOOL} THEN coalesce({_case(3, 0, 'camera_model')}, {_case(3, 1, 'camera_model')}) END, CASE WHEN {_TOOL} THEN '' ELSE 'no output' END FROM m""",
    "inspected_tags": f"""WITH {_M}, t AS (
  SELECT file_id, unnest(['recorded_date', 'encoded_date', 'tagged_date', 'file_last_modification_date', 'duration', 'performer', 'device_model', 'encoded_library', 'Comment']) AS tag,
    unnest([{', '.join(_GENERAL)}, CASE WHEN file_id % 2 = 0 THEN ({_MS})::VARCHAR END, {', '.join(_case(4, k, 'camera_model') for k in range(3))}, nullif(repeat(capture_datetime, 4), '')]) AS v FROM m)
SELECT file_id::VARCHAR AS file, 'General' AS track, tag, CASE WHEN length(v) > 60 THEN left(v, 57) || '...' ELSE v END AS value, tag IN ('performer', 'device_model') AS about_camera FROM t WHERE v IS NOT NULL""",
    "log_issues_organizer": f"""WITH f AS (SELECT *, [{_ISSUES}][id % {len(LINES)} + 1] AS issue FROM files WHERE orig_path IS NOT NULL),
-- a pattern takes a path of one character at least
p AS (SELECT issue, CASE WHEN id % {len(LINES)} = 6 THEN 'video ' || orig_path WHEN id % {len(LINES)} IN ({', '.join(map(str, _SHORT))}) THEN split_part(orig_path, ':', 1) ELSE orig_path END AS path FROM f WHERE issue IS NOT NULL AND orig_path <> ''),
c AS (SELECT issue, {{clean_p}} AS path FROM p),
u AS (SELECT DISTINCT {{clean_o}} AS path FROM f WHERE type = 'other')
SELECT path, CASE WHEN path IN (SELECT path FROM u) THEN 1 ELSE 0 END AS in_unknown_files, string_agg(DISTINCT issue, ';' ORDER BY issue) AS issues FROM c GROUP BY path""",
}


def _clean(c: str) -> str:
    bare = f"trim(trim(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '\"'), '''')"
    flat = f"regexp_replace(regexp_replace({bare}, '/+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g')"
    return f"coalesce(nullif(regexp_replace({flat}, '(.)/\\.?$', '\\1'), ''), '.')"


SQL["log_issues_organizer"] = SQL["log_issues_organizer"].format(clean_p=_clean("path"), clean_o=_clean("orig_path"))
