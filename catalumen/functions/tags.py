"""Capture metadata from the tag maps that media tools give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalumen.functions.constants import EXIF_DATE_TAGS
from catalumen.functions.times import clock_seconds, exif_time, flexible_time, media_time


def _tag(tags: Column, name: str) -> Column:
    """A tag's value; missing and empty ones are null."""
    return F.nullif(F.try_element_at(tags, F.lit(name)), F.lit(""))


def _first(tags: Column, *names: str) -> Column:
    return F.coalesce(*(_tag(tags, n) for n in names))


def _first_time(read: Callable[[Column], Column], texts: list[Column]) -> Column:
    """The first of several texts that can be read; the reading is written and compiled once for all."""
    return F.get(F.filter(F.transform(F.array(*texts), read), lambda t: t.isNotNull()), F.lit(0))


def _result(at: Column, duration: Column, camera: Column) -> Column:
    return F.struct(at.alias("capture_datetime"), duration.alias("duration_sec"), camera.alias("camera_model"))


def image_metadata(tags: Column, strip: bool = True) -> Column:
    """struct<capture_datetime, camera_model, lens_model>: the first date that can be read, in order of trust."""
    clean = F.trim if strip else (lambda c: c)
    date = _first_time(exif_time, [_tag(tags, t) for t in EXIF_DATE_TAGS])
    return F.struct(date.alias("capture_datetime"), F.nullif(clean(_tag(tags, "Image Model")), F.lit("")).alias("camera_model"), F.nullif(clean(_tag(tags, "EXIF LensModel")), F.lit("")).alias("lens_model"))


def general_track(tags: Column) -> Column:
    """v2: of a container's general track, with the duration in milliseconds."""
    date = _first_time(flexible_time, [_tag(tags, n) for n in ("recorded_date", "encoded_date", "tagged_date", "file_last_modification_date")])
    return _result(date, _tag(tags, "duration").try_cast("double") / 1000, _first(tags, "performer", "device_model", "encoded_library"))


def general_track_v1(tags: Column, zone: str) -> Column:
    """v1: creation before modification before legacy dates; UTC ones as local time of the zone."""
    names = ["file_creation_date", "file_last_modification_date"]
    pairs = [(_tag(tags, n + end), F.lit(bool(end))) for n in names for end in ("__local", "")]
    pairs += [(_tag(tags, n), F.lit(False)) for n in ("recorded_date", "encoded_date", "tagged_date")]
    read = lambda x: F.when(x["local"], media_time(x["text"], zone, local=True)).otherwise(media_time(x["text"], zone))
    date = _first_time(read, [F.struct(text.alias("text"), local.alias("local")) for text, local in pairs])
    return _result(date, _tag(tags, "duration").try_cast("double") / 1000, _first(tags, "performer", "encoder"))


def tool_tags(json: Column) -> Column:
    """The first object of a tool's JSON array as a map of texts; null if there is none."""
    return F.get(F.from_json(json, "array<map<string,string>>"), F.lit(0))


def exif_tool(tags: Column) -> Column:
    date = _first_time(flexible_time, [_tag(tags, n) for n in ("CreateDate", "CreationDate", "DateTimeOriginal", "MediaCreateDate")])
    return _result(date, _tag(tags, "Duration").try_cast("double"), _first(tags, "Model", "CameraModelName", "Make"))


def video_metadata(general: Column, tool: Column) -> Column:
    """The general track's, or where that has neither date nor duration, the tool's. A duration of 0 is none."""
    says = lambda c: c["capture_datetime"].isNotNull() | F.coalesce(c["duration_sec"] != 0, F.lit(False))
    # bound once in an array, as written out each use of them would be computed and compiled again
    both = F.array(general_track(general), exif_tool(tool))
    none = _result(F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("double"), F.lit(None).cast("string"))
    return F.coalesce(F.get(F.filter(both, says), F.lit(0)), none)


DIAGNOSTIC = ["capture_datetime", "duration_sec", "width", "height", "codec", "camera_model", "notes"]


def _row(tool: str, at: Column, duration: Column, width: Column, height: Column, codec: Column, camera: Column, note: Column) -> Column:
    values = [at, duration.cast("string"), width, height, codec, camera, F.coalesce(note, F.lit(""))]
    return F.struct(F.lit(tool).alias("tool"), *(v.alias(n) for n, v in zip(DIAGNOSTIC, values, strict=True)))


def diagnose(general: Column, video: Column, probe_json: Column, tool_json: Column) -> Column:
    """array of three structs: what each of three tools says of a video, as texts, and what kept it from saying more.

    general, video: tag maps of those tracks. probe_json: the probe's format and streams. tool_json: a tool's array.
    """
    none = F.lit(None).cast("string")
    first = _row("mediainfo", _first(general, "recorded_date", "encoded_date", "tagged_date", "file_last_modification_date"), _tag(general, "duration").try_cast("double") / 1000, _tag(video, "width"), _tag(video, "height"), _tag(video, "format"), _first(general, "performer", "encoder", "device_model"), F.when(general.isNull(), "no tags"))
    shape = "struct<format:struct<duration:string,tags:map<string,string>>,streams:array<struct<codec_type:string,width:string,height:string,codec_name:string,tags:map<string,string>>>>"
    probe = F.from_json(probe_json, shape)
    made = lambda tags: _first(tags, "creation_time", "com.apple.quicktime.creationdate", "date")
    streams = probe.getField("streams")
    stream_dates = F.filter(F.transform(streams, lambda s: made(s["tags"])), lambda x: x.isNotNull())
    stream = F.get(F.filter(streams, lambda s: s["codec_type"] == "video"), F.lit(0))
    fmt = probe.getField("format")
    second = _row("ffprobe", F.coalesce(made(fmt.getField("tags")), F.get(stream_dates, F.lit(0))), fmt.getField("duration").try_cast("double"), stream.getField("width"), stream.getField("height"), stream.getField("codec_name"), none, F.when(probe_json.isNull(), "no output"))
    tags = tool_tags(tool_json)
    sized = _tag(tags, "ImageWidth").isNotNull() & _tag(tags, "ImageHeight").isNotNull()
    side = lambda k: F.when(sized, _tag(tags, "Image" + k)).otherwise(_tag(tags, "ComposedImage" + k))
    third = _row("exiftool", _first(tags, "CreateDate", "CreationDate", "DateTimeOriginal", "FileModifyDate"), clock_seconds(_tag(tags, "Duration")), side("Width"), side("Height"), none, _first(tags, "Model", "CameraModelName"), F.when(tool_json.isNull(), "no output"))
    return F.array(first, second, third)


#: Parts of a tag's name that tell of a camera: fixed values.
CAMERA_WORDS = ["performer", "device_model", "encoder", "make", "model", "camera", "product", "device", "equipment_model", "host_computer"]


def about_camera(name: Column) -> Column:
    return F.lower(name).rlike("|".join(CAMERA_WORDS))
