"""From a directory tree to file records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalumen.functions.constants import SPARSE_FROM
from catalumen.functions.paths import file_type, name_score, stem, suffix
from catalumen.functions.tags import general_track_v1, image_metadata, tool_tags, video_metadata
from catalumen.functions.times import date_from_path
from catalumen.operators.catalog import hashing_plan
from catalumen.operators.timestamps import utc_text
from catalumen.runtime import cut
from catalumen.sources import kernels
from catalumen.sources.diagnostics import ask
from catalumen.sources.listing import list_files

_READ = "hash string, sparse_hash string, tags map<string,string>, width int, height int, phash string, tool string, error string"
#: The command line of the tool that reads what movie_head doesn't; numbers and dates as they are.
_TOOL = ["exiftool", "-j", "-n"]


def _reader(least: int, force_full: bool, pictures: bool, fallback: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, kind, size in zip(b["path"], b["type"], b["size_bytes"], strict=True):
                full = sparse = width = height = phash = tool = error = None
                tags: dict[str, str] = {}
                try:
                    full, sparse = kernels.fingerprint(path, int(size), least, force_full)
                except OSError as e:
                    error = str(e)
                try:
                    if kind == "video":
                        tags = kernels.movie_head(path)
                    elif kind in ("raw", "jpeg", "tiff", "psd"):
                        found, width, height = kernels.image_head(path)
                        tags = {k: str(v) for k, v in found.items()}
                    if pictures and kind in ("jpeg", "tiff"):
                        phash = kernels.picture_hash(path)
                except Exception:  # noqa: BLE001  a broken header is a file without tags
                    tags = tags or {}
                if fallback and kind == "video" and error is None and "encoded_date" not in tags and tags.get("duration", "0") == "0":
                    try:
                        tool = ask(_TOOL, path)
                    except (OSError, ValueError):  # it can't be run, or prints no text
                        tool = None
                rows.append((full, sparse, tags, width, height, phash, tool, error))
            out = pd.DataFrame(rows, columns=["hash", "sparse_hash", "tags", "width", "height", "phash", "tool", "error"])
            out[["width", "height"]] = out[["width", "height"]].astype("Int32")
            yield pd.concat([b.reset_index(drop=True), out], axis=1)

    return read


def _hash_rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for path in b["path"]:
            try:
                out.append(kernels.full_hash(path))
            except OSError:
                out.append(None)
        yield b[["seq"]].assign(full=out)


def with_sequence(listing: DataFrame) -> DataFrame:
    """Adds seq, the place in walking order, from 1: ranks within range partitions, offset by their counts."""
    ordered = cut(listing.repartitionByRange("order_key").withColumn("_p", F.spark_partition_id()))
    sizes = ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_p", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row per partition
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("order_key"))
    return ordered.withColumn("rank", rank).join(F.broadcast(before), "_p").withColumn("seq", F.col("before") + F.col("rank")).drop("_p", "rank", "before", "order_key")


def scan(spark: SparkSession, root: str, is_seed: bool = False, known_sparse: DataFrame | None = None, skips: DataFrame | None = None, dialect: str = "v2", pictures: bool = False, least: int = SPARSE_FROM, force_full: bool = False, zone: str | None = None, errors: Callable[[DataFrame], None] | None = None, keep_unread: bool = False) -> DataFrame:
    """File records of a tree, with seq in walking order.

    Files that can't be read are left out, or with keep_unread kept with an error text in a column more; errors is
    called with them, and with the directories that can't be read (path, error).

    Two stages: sparse fingerprints of large files first; the full hash only where the sparse one is known already
    (known_sparse: sparse_hash) or belongs to an earlier file of the scan. Capture time: the tags', in v1 else the one
    that the path tells, else the file's. Sizes and picture hashes are kept in v1 only. Videos: v1 takes the container's
    UTC dates as local time of zone (the driver's own, if none is given); v2 asks exiftool, where it is installed, about
    those whose container tells neither date nor duration.
    """
    kind = file_type(F.col("name"), resource_forks=dialect == "v2")
    listing = with_sequence(list_files(spark, root, skips, errors)).withColumn("type", kind).repartition(spark.sparkContext.defaultParallelism * 2)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listing.schema) + ", " + _READ
    first = cut(listing.mapInPandas(_reader(least, force_full, pictures and dialect == "v1", dialect == "v2"), shape))
    if errors is not None:
        errors(first.filter("error is not null").select("path", "error"))
    if not keep_unread:
        first = first.filter("error is null")
    known = known_sparse if known_sparse is not None else spark.createDataFrame([], "sparse_hash string")
    again = hashing_plan(first, known, "seq").filter("needs_full").select("seq")
    rest = first.filter("hash is null").select("seq", "path").join(again, "seq", "left_semi").mapInPandas(_hash_rest, "seq long, full string")
    rows = first.join(rest, "seq", "left").withColumn("hash", F.coalesce("hash", "full"))
    image = image_metadata(F.col("tags"), strip=dialect == "v2")
    if dialect == "v1":
        movie = general_track_v1(F.col("tags"), zone or spark.sparkContext._jvm.java.time.ZoneId.systemDefault().getId())
    else:
        movie = video_metadata(F.col("tags"), tool_tags(F.col("tool")))
    video = F.col("type") == "video"
    clock = F.rtrim(utc_text(F.floor("mtime")), F.lit("Z")).try_cast("timestamp_ntz")
    told = F.when(video, movie.getField("capture_datetime")).otherwise(image.getField("capture_datetime"))
    by_path = [date_from_path(F.col("path")).cast("timestamp_ntz")] if dialect == "v1" else []
    sized = F.lit(dialect == "v1") & F.col("type").isin("jpeg", "psd", "tiff")
    return rows.select(
        "seq", "hash", "sparse_hash", F.col("hash").isNull().alias("hash_is_sparse"), "type", F.lower(suffix(F.col("name"))).alias("ext"),
        F.col("name").alias("orig_name"), F.col("path").alias("orig_path"), "size_bytes", F.lit(is_seed).alias("is_seed"),
        name_score(stem(F.col("name")), dialect).alias("name_score"), "mtime", F.coalesce(told, *by_path, clock).alias("capture_datetime"),
        F.when(video, movie.getField("camera_model")).otherwise(image.getField("camera_model")).alias("camera_model"), image.getField("lens_model").alias("lens_model"),
        F.when(sized, F.col("width")).alias("width"), F.when(sized, F.col("height")).alias("height"), movie.getField("duration_sec").alias("duration_sec"), "phash", *(["error"] if keep_unread else []),
    )


def embedded_references(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """(psd_file_id, pos, name) of pictures embedded in layered documents. documents: id, orig_path."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, path in zip(b["id"], b["orig_path"], strict=True):
                try:
                    rows += [(i, n, name) for n, name in enumerate(kernels.embedded_names(path))]
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["psd_file_id", "pos", "name"])

    return documents.select("id", "orig_path").filter("orig_path is not null").mapInPandas(read, "psd_file_id long, pos int, name string")
