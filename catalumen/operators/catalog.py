"""Catalogue upserts: content identity, canonical rows, metadata, occurrences. All are mergeable aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalumen.functions.constants import MEDIA_TYPES
from catalumen.functions.fingerprints import full_hash, sparse_hash
from catalumen.runtime import skew_join

METADATA = ["capture_datetime", "camera_model", "lens_model", "width", "height", "duration_sec", "phash"]


def identity(strict: bool = False) -> Column:
    """What makes rows one content: the sparse hash where there is one, else the full hash. With `strict` the other
    way about, which keeps large files apart whose sparse hashes are equal by chance."""
    full, sparse = full_hash(F.col("hash")), sparse_hash(F.col("sparse_hash"))
    return F.coalesce(full, sparse) if strict else F.coalesce(sparse, full)


def canonical(records: DataFrame, seq: str = "record_id", seen: str = "scanned_at", strict: bool = False) -> DataFrame:
    """One row per content: the file that it goes by, and what the catalogue keeps of it.

    Name and path come from the best row by (is_seed, name_score), the first one among equals; type, extension and
    size from the first row; each fingerprint from the first row that has it; times are the first and last sight.
    Records without a readable fingerprint are left out. Null flags count as false, null scores rank last. Every part
    is a mergeable aggregate, so a content that a third of all records share is reduced before its shuffle.
    """
    order = F.col(seq)
    best = F.struct(F.coalesce("is_seed", F.lit(False)), F.coalesce("name_score", F.lit(-(2**31) + 1)), -order)
    full, sparse = full_hash(F.col("hash")), sparse_hash(F.col("sparse_hash"))
    first = lambda c, when=None: F.min(F.when(when if when is not None else F.lit(True), F.struct(order.alias("o"), c.alias("v")))).getField("v")
    return (
        records.withColumn("content", identity(strict))
        .filter("content is not null")
        .groupBy("content")
        .agg(
            F.max_by(F.struct("orig_name", "orig_path", "is_seed", "name_score"), best).alias("b"),
            first(full, full.isNotNull()).alias("hash"),
            first(sparse, sparse.isNotNull()).alias("sparse_hash"),
            first(F.struct("type", "ext", "size_bytes")).alias("f"),
            F.count(F.lit(1)).alias("copies"),
            F.min(seq).alias("first_seq"),
            F.min(seen).alias("first_seen_at"),
            F.max(seen).alias("last_seen_at"),
        )
        .select("content", "hash", "sparse_hash", "f.type", "f.ext", "b.orig_name", "b.orig_path", "f.size_bytes", "b.is_seed", "b.name_score", "copies", "first_seq", "first_seen_at", "last_seen_at")
    )


def metadata_last(records: DataFrame, seq: str = "record_id", strict: bool = False) -> DataFrame:
    """Capture metadata per content: the last media record's, even where another record is canonical."""
    return (
        records.withColumn("content", identity(strict))
        .filter(F.col("content").isNotNull() & F.col("type").isin(MEDIA_TYPES))
        .groupBy("content")
        .agg(F.max_by(F.struct(*METADATA), F.col(seq)).alias("m"))
        .select("content", "m.*")
        .withColumn("aspect_ratio", F.when((F.col("width") != 0) & (F.col("height") != 0), F.col("width") / F.col("height")))
    )


def occurrences_last(occurrences: DataFrame) -> DataFrame:
    """One row per path: its last sight; among equal times the largest file_id, then the largest hash."""
    order = F.struct("seen_at", F.coalesce("file_id", F.lit(-1)), F.coalesce("hash", F.lit("")), F.coalesce("size_bytes", F.lit(-1)))
    kept = [c for c in occurrences.columns if c != "path"]
    return occurrences.filter("path is not null").groupBy("path").agg(F.max_by(F.struct(*kept), order).alias("o")).select("path", "o.*")


def append_occurrences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Occurrences of earlier and new scans, without a key."""
    return old.unionByName(new, allowMissingColumns=True)


def known_sparse(files: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Distinct sparse fingerprints of the catalogue and of sparse occurrences."""
    seen = occurrences.filter("hash_is_sparse").select(sparse_hash(F.col("hash")).alias("sparse_hash"))
    return files.select(sparse_hash(F.col("sparse_hash")).alias("sparse_hash")).unionByName(seen).filter("sparse_hash is not null").distinct()


def hashing_plan(records: DataFrame, known: DataFrame, seq: str = "record_id") -> DataFrame:
    """(seq, sparse_hash, first_sight, needs_full): a file needs its full hash where its sparse one is known already,
    from the catalogue or an earlier record of the scan."""
    rows = records.select(seq, sparse_hash(F.col("sparse_hash")).alias("sparse_hash")).filter("sparse_hash is not null")
    first = rows.groupBy("sparse_hash").agg(F.min(seq).alias("first"))
    first = first.join(known.select("sparse_hash").distinct().withColumn("known", F.lit(True)), "sparse_hash", "left")
    met = skew_join(rows, first, ["sparse_hash"])
    is_first = F.col(seq) == F.col("first")
    return met.select(seq, "sparse_hash", is_first.alias("first_sight"), (~is_first | F.coalesce("known", F.lit(False))).alias("needs_full"))


def metadata_of(media: DataFrame) -> DataFrame:
    """One metadata row per file_id, whichever rows were merged: the largest by its texts and sizes."""
    kept = ["capture_datetime", "camera_model", "lens_model", "width", "height", "phash"]
    order = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in kept))
    return media.filter("file_id is not null").groupBy("file_id").agg(F.max_by(F.struct(*kept), order).alias("m")).select("file_id", "m.*")


def assign_ids(contents: DataFrame, existing: DataFrame, least: int = 0) -> DataFrame:
    """Adds id: the catalogue's for known contents; new ones go on after the largest id in order of first_seq.

    existing: content, id. least: the largest id in use, where rows without a content have one too. Ranks are made per range partition and offset by counts, so that no single task sorts all.
    """
    top = max(least, existing.agg(F.coalesce(F.max("id"), F.lit(0))).head()[0])
    known = contents.join(existing.select("content", "id"), "content")
    new = contents.join(existing, "content", "left_anti").repartitionByRange("first_seq").sortWithinPartitions("first_seq").withColumn("_p", F.spark_partition_id())
    counts = new.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    ranked = new.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("first_seq", "content")))
    return known.unionByName(ranked.join(offsets.select("_p", "before"), "_p").withColumn("id", F.lit(top) + F.col("before") + F.col("_r")).select(*known.columns))
