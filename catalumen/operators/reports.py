"""Status reports over the catalogue. Built from joins and one when-chain each; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalumen.functions.fingerprints import full_hash
from catalumen.functions.paths import file_name, file_type
from catalumen.operators.links import OUTPUT_TYPES, without_link
from catalumen.runtime import cut, skew_join


def _missing_flag(on: str) -> Column:
    return F.col(on).isNotNull().cast("int")


def source_report(listing: DataFrame, files: DataFrame, occurrences: DataFrame) -> DataFrame:
    """path, status, file_type, dest_path, canonical_path, note of each listed file.

    listing: path, hash (full). A file is known by its path among the occurrences, else by its full hash; both
    lookups are reduced to one row per key first. Order of the states: other types first (indexed or skipped), then not
    in the catalogue, then canonical with or without a destination, else duplicate.
    """
    kind = file_type(file_name(F.col("path")), resource_forks=False)
    by_path = occurrences.filter("path is not null").groupBy("path").agg(F.max_by("file_id", F.struct("seen_at", "file_id")).alias("path_id"))
    by_hash = files.select(full_hash(F.col("hash")).alias("h"), "id").filter("h is not null").groupBy("h").agg(F.min("id").alias("hash_id"))
    rows = listing.select("path", full_hash(F.col("hash")).alias("h")).withColumn("file_type", kind)
    rows = cut(rows.join(by_path, "path", "left"))  # read several times
    open_ = rows.filter("path_id is null and file_type <> 'other' and h is not null")
    met = skew_join(open_, by_hash, ["h"], "left")
    rest = rows.filter("not (path_id is null and file_type <> 'other' and h is not null)").withColumn("hash_id", F.lit(None).cast("long"))
    found = cut(met.select(*rest.columns).unionByName(rest).withColumn("file_id", F.coalesce("path_id", "hash_id")))
    known = files.select(F.col("id").alias("file_id"), F.col("orig_path").alias("canonical"), F.col("dest_path").alias("dest"))
    both = found.filter("file_id is null").withColumns({"canonical": F.lit(None).cast("string"), "dest": F.lit(None).cast("string")})
    both = both.unionByName(skew_join(found.filter("file_id is not null"), known, ["file_id"], "left").select(*both.columns))
    canonical = F.coalesce(F.col("canonical") == F.col("path"), F.lit(False))
    other = F.col("file_type") == "other"
    status = (
        F.when(other & F.col("path_id").isNotNull(), "Indexed (Ignored Type)")
        .when(other, "Skipped")
        .when(F.col("file_id").isNull(), "Not In Catalog")
        .when(canonical & F.col("dest").isNotNull(), "Scheduled Copy/Move")
        .when(canonical, "Indexed (No Dest)")
        .otherwise("Duplicate")
    )
    way = F.when(F.col("path_id").isNotNull(), "path_lookup").otherwise("content_hash")
    out = both.withColumn("status", status)
    duplicate = F.col("status") == "Duplicate"
    return out.select(
        "path", "status", "file_type",
        F.when(F.col("status").isin("Scheduled Copy/Move", "Duplicate"), F.coalesce("dest", F.lit(""))).otherwise("").alias("dest_path"),
        F.when(duplicate, F.coalesce("canonical", F.lit(""))).otherwise("").alias("canonical_path"),
        F.when(other, "Unsupported extension").when(duplicate, F.concat(F.lit("Duplicate of ID "), F.col("file_id").cast("string"), F.lit(" ("), way, F.lit(")"))).otherwise("").alias("note"),
    )


def with_notes(report: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """source_report() with a note for every state, and no destination for duplicates, as the CSV report has them.

    listing: path, error. Files that couldn't be read, and are known by no path, have the state Error.
    """
    note = F.when(F.col("status") == "Not In Catalog", "Pending Import").when(F.col("status") == "Scheduled Copy/Move", "Active Record").when(F.col("status") == "Indexed (No Dest)", "No destination assigned").otherwise(F.col("note"))
    out = report.withColumns({"note": note, "dest_path": F.when(F.col("status") == "Duplicate", "").otherwise(F.col("dest_path"))})
    if listing is None:
        return out
    failed = listing.filter("error is not null").groupBy("path").agg(F.min("error").alias("error"))
    met = out.join(failed, "path", "left")
    error = F.col("error").isNotNull() & (F.col("status") == "Not In Catalog")
    return met.withColumns({"note": F.when(error, F.concat(F.lit("Hash failed: "), "error")).otherwise(F.col("note")), "status": F.when(error, "Error").otherwise(F.col("status"))}).select(*report.columns)


def copy_report(occurrences: DataFrame, files: DataFrame) -> DataFrame:
    """path, type, is_seed, status, dest_path, duplicate_of, hash of each occurrence, by its hash.

    A hash that several files have counts for the one of the largest id. The empty file's hash, of which there are as
    many occurrences as you like, is joined apart as a hot key.
    """
    known = files.filter("hash is not null").groupBy("hash").agg(F.max(F.struct("id", "type", "dest_path", "orig_path")).alias("f")).select("hash", "f.type", F.col("f.dest_path").alias("dest"), F.col("f.orig_path").alias("canonical"), F.lit(True).alias("known"))
    rows = occurrences.select("path", F.coalesce("is_seed", F.lit(False)).alias("is_seed"), "hash")
    met = skew_join(rows, known, ["hash"], "left")
    dest = F.coalesce("dest", F.lit(""))
    status = (
        F.when(F.col("known").isNull(), "unknown")
        .when(F.col("type") == "other", "skipped_other")
        .when(~F.col("path").eqNullSafe(F.col("canonical")), "duplicate")
        .when(dest != "", "copied")
        .otherwise("pending")
    )
    return met.withColumn("status", status).select("path", F.coalesce("type", F.lit("")).alias("type"), "is_seed", "status", dest.alias("dest_path"), F.when(F.col("status") == "duplicate", dest).otherwise("").alias("duplicate_of"), "hash")


def unprocessed_raws(files: DataFrame, metadata: DataFrame, raw_outputs: DataFrame) -> DataFrame:
    """Raw files without an output, with their destination, capture text and camera. metadata: a row per file_id."""
    raws = files.filter("type = 'raw'").select("id", "dest_path")
    open_ = without_link(raws, raw_outputs, "id", "raw_file_id")
    return open_.join(metadata.select(F.col("file_id").alias("id"), "capture_datetime", "camera_model"), "id", "left").select(F.col("id").alias("raw_file_id"), F.coalesce("dest_path", F.lit("")).alias("raw_path"), "capture_datetime", F.coalesce("camera_model", F.lit("")).alias("camera_model"))


def raw_details(files: DataFrame, metadata: DataFrame, raw_outputs: DataFrame) -> DataFrame:
    """Linked outputs of each raw file with type, path, capture text, camera and link."""
    outs = files.filter(F.col("type").isin(OUTPUT_TYPES)).select(F.col("id").alias("output_file_id"), "type", F.coalesce("dest_path", "orig_path").alias("output_path"))
    meta = metadata.select(F.col("file_id").alias("output_file_id"), "capture_datetime", "camera_model")
    return raw_outputs.filter("raw_file_id is not null").join(outs, "output_file_id").join(meta, "output_file_id", "left").select("raw_file_id", "output_file_id", "type", "output_path", "capture_datetime", "camera_model", "link_method", "confidence")


def find_raw(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, raw_file_id): the raw file at each wanted path, by destination before original path, smallest id."""
    raws = files.filter("type = 'raw'")
    asked = wanted.select("path").filter("path is not null").distinct().select("path", F.explode(F.array_distinct(F.array("path", F.translate("path", "\\", "/")))).alias("at"))
    places = raws.select("id", F.lit(0).alias("rank"), F.col("dest_path").alias("at")).unionByName(raws.select("id", F.lit(1).alias("rank"), F.col("orig_path").alias("at"))).filter("at is not null")
    return asked.join(places, "at").groupBy("path").agg(F.min(F.struct("rank", "id")).alias("r")).select("path", F.col("r.id").alias("raw_file_id"))


def unknown_files(files: DataFrame) -> DataFrame:
    return files.filter("type = 'other'").select("id", "ext", "orig_path", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), F.coalesce("is_seed", F.lit(False)).alias("is_seed"))


def unlinked_psds(files: DataFrame, metadata: DataFrame, psd_links: DataFrame, least: int = 95) -> DataFrame:
    """Layered documents without a source link of sufficient confidence."""
    psds = files.filter("type = 'psd'").select("id", "orig_name", "orig_path", "dest_path")
    open_ = without_link(psds, psd_links, "id", "psd_file_id", F.col("confidence") >= least)
    return open_.join(metadata.select(F.col("file_id").alias("id"), "capture_datetime", "camera_model"), "id", "left")


def counters(files: DataFrame, raw_outputs: DataFrame, raw_sidecars: DataFrame) -> DataFrame:
    """One row per counter: files by type, and links."""
    by_type = files.groupBy(F.concat(F.lit("files_"), F.coalesce("type", F.lit("untyped"))).alias("counter")).agg(F.count(F.lit(1)).alias("n"))
    for name, df in (("output_links", raw_outputs), ("sidecar_links", raw_sidecars)):
        by_type = by_type.unionByName(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("counter"), "n"))
    return by_type
