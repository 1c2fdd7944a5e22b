"""Links between files: sidecars, outputs of raw files, sources of layered documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalumen.functions.constants import CONFIDENCE
from catalumen.functions.content import hamming, picture_value
from catalumen.functions.paths import digit_core, file_name, normal_stem, parent, psd_stem, stem
from catalumen.runtime import block_join, settled

OUTPUT_TYPES = ["jpeg", "psd", "video", "tiff"]


def band_join(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, width: int) -> DataFrame:
    """Pairs with equal `on` and |left_at - right_at| <= width, in whole units; nulls match nothing.

    An equi join on `on` and stretches of `width` units: a left row looks in its own stretch and both neighbours, so
    that a key with many rows is spread over its stretches, and no pair is compared that lies farther apart than two.
    A stretch that very many rows share, such as that of a clock that was never set, is joined in blocks.
    """
    step = max(1, width)
    a = left.filter(F.col(left_at).isNotNull()).withColumn("_s", F.explode(F.array(*(F.floor(F.col(left_at) / step) + i for i in (-1, 0, 1)))))
    b = right.filter(F.col(right_at).isNotNull()).withColumn("_s", F.floor(F.col(right_at) / step))
    a, b = a.withColumn("_ia", F.xxhash64(*left.columns)), b.withColumn("_ib", F.xxhash64(*right.columns))
    return block_join(a, b, [*on, "_s"], "_ia", "_ib").filter(F.abs(F.col(left_at) - F.col(right_at)) <= width).drop("_s", "_ia", "_ib")


def sidecar_links(files: DataFrame) -> DataFrame:
    """(raw_file_id, sidecar_file_id): same directory and lower-case stem."""

    def side(kind: str, name: str) -> DataFrame:
        p = F.col("orig_path")
        return files.filter((F.col("type") == kind) & p.isNotNull()).select(F.col("id").alias(name), parent(p).alias("dir"), F.lower(stem(file_name(p))).alias("stem"))

    return side("raw", "raw_file_id").join(side("sidecar", "sidecar_file_id"), ["dir", "stem"]).select("raw_file_id", "sidecar_file_id").distinct()


def sidecar_links_of_occurrences(occurrences: DataFrame, files: DataFrame) -> DataFrame:
    """The same from all paths at which the files were seen."""
    kinds = files.filter(F.col("type").isin("raw", "sidecar")).select(F.col("id").alias("file_id"), "type")
    p = F.col("path")
    seen = occurrences.filter("path is not null").select("file_id", parent(p).alias("dir"), F.lower(stem(file_name(p))).alias("stem")).distinct().join(kinds, "file_id")
    raw = seen.filter("type = 'raw'").select("dir", "stem", F.col("file_id").alias("raw_file_id"))
    side = seen.filter("type = 'sidecar'").select("dir", "stem", F.col("file_id").alias("sidecar_file_id"))
    return raw.join(side, ["dir", "stem"]).select("raw_file_id", "sidecar_file_id").distinct()


def sidecar_index(occurrences: DataFrame, files: DataFrame) -> DataFrame:
    """(dir, stem, raws, sidecars): how many raw files and sidecars were seen under each directory and lower-case stem."""
    kinds = files.filter(F.col("type").isin("raw", "sidecar")).select(F.col("id").alias("file_id"), "type")
    p = F.col("path")
    seen = occurrences.filter("path is not null").select("file_id", parent(p).alias("dir"), F.lower(stem(file_name(p))).alias("stem")).distinct().join(kinds, "file_id")
    return seen.groupBy("dir", "stem").agg(F.count_if(F.col("type") == "raw").alias("raws"), F.count_if(F.col("type") == "sidecar").alias("sidecars"))


def _timed(captures: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(raw_file_id, key, raw_at) and (output_file_id, key, output_at) of the files with a time, each once."""
    rows = settled(captures.filter(F.col("type").isin("raw", *OUTPUT_TYPES) & F.col("at").isNotNull()).select("id", "type", key, "at"))

    def side(kinds: list[str], name: str, at: str) -> DataFrame:
        return rows.filter(F.col("type").isin(kinds)).select(F.col("id").alias(name), key, F.col("at").alias(at)).distinct()

    return side(["raw"], "raw_file_id", "raw_at"), side(OUTPUT_TYPES, "output_file_id", "output_at")


def _named(pairs: DataFrame, method: str) -> DataFrame:
    return pairs.select("raw_file_id", "output_file_id", F.lit(method).alias("link_method"), F.lit(CONFIDENCE[method]).alias("confidence"))


# captures: id, type, orig_name, capture_datetime, camera_model, phash, at (local seconds). Rows of one id may differ in
# type and name; time, camera and hash are its own, so that a band join of distinct sides gives every pair once.


def by_name_and_time(captures: DataFrame) -> DataFrame:
    """Same capture text, and the same digits in the stem, at least one."""
    rows = captures.select("id", "type", "capture_datetime", digit_core(stem(F.col("orig_name"))).alias("core")).filter("capture_datetime <> '' and core <> ''")
    raws = rows.filter("type = 'raw'").select(F.col("id").alias("raw_file_id"), "capture_datetime", "core")
    outs = rows.filter(F.col("type").isin(OUTPUT_TYPES)).select(F.col("id").alias("output_file_id"), "capture_datetime", "core")
    return _named(raws.join(outs, ["capture_datetime", "core"]).select("raw_file_id", "output_file_id").distinct(), "filename_time")


def by_time_and_camera(captures: DataFrame, seconds: int = 2) -> DataFrame:
    """Same camera, and at most so many seconds apart."""
    raws, outs = _timed(captures.filter("camera_model <> ''"), "camera_model")
    return _named(band_join(raws, outs, ["camera_model"], "raw_at", "output_at", seconds), "time_camera")


def by_picture(captures: DataFrame, raw_hashes: DataFrame | None = None, seconds: int = 30, bits: int = 5) -> DataFrame:
    """At most so many seconds apart, for outputs with a picture hash, of which at most `bits` bits differ from the raw
    file's (raw_hashes: raw_file_id, raw_phash). Without raw_hashes every such output counts as alike, which is how
    catalogues that keep no hash of raw files have been linked."""
    raws, outs = _timed(captures.filter("type = 'raw' or phash <> ''"), "phash")
    raws = raws.drop("phash")
    if raw_hashes is None:
        return _named(band_join(raws, outs.drop("phash"), [], "raw_at", "output_at", seconds), "phash")
    raws = raws.join(raw_hashes.select("raw_file_id", picture_value(F.col("raw_phash")).alias("raw_value")).filter("raw_value is not null"), "raw_file_id")
    outs = outs.select("output_file_id", "output_at", picture_value(F.col("phash")).alias("value")).filter("value is not null")
    pairs = band_join(raws, outs, [], "raw_at", "output_at", seconds).filter(hamming(F.col("raw_value"), F.col("value")) <= bits)
    return _named(pairs.select("raw_file_id", "output_file_id").distinct(), "phash")


def merge_links(*links: DataFrame) -> DataFrame:
    """One row per pair: the link of the highest confidence, the greatest method among equals.

    Links go by their place in that order, as a number is aggregated without a sort.
    """
    order = sorted((c, m) for m, c in CONFIDENCE.items())
    place = reduce(lambda known, i: known.when(F.col("link_method") == order[i][1], F.lit(i)), range(1, len(order)), F.when(F.col("link_method") == order[0][1], F.lit(0)))
    every = reduce(DataFrame.unionByName, (x.select("raw_file_id", "output_file_id", place.alias("place")) for x in links))
    best = every.groupBy("raw_file_id", "output_file_id").agg(F.max("place").alias("place"))
    method, confidence = (F.get(F.array(*(F.lit(x[i]) for x in order)), F.col("place")) for i in (1, 0))
    return best.select("raw_file_id", "output_file_id", method.alias("link_method"), confidence.alias("confidence"))


def psd_links(files: DataFrame, references: DataFrame | None = None, dialect: str = "v2") -> DataFrame:
    """(psd_file_id, source_file_id, confidence, link_method): one source per layered document.

    By the stem first; documents without such a source by the names of embedded pictures (references: psd_file_id,
    pos, name). v2 keeps the last source in order of (type, id), v1 the first, and v1 compares embedded names with
    their extension. Confidence 100 and 95.
    """
    last = dialect == "v2"
    pick = F.max if last else F.min
    sources = files.filter(F.col("type").isin("raw", "jpeg") & F.col("orig_name").isNotNull()).select(F.struct("type", "id").alias("source"), "orig_name")
    keyed = sources.select(normal_stem(stem(F.col("orig_name")), dialect).alias("key"), "source").groupBy("key").agg(pick("source").alias("source"))
    documents = files.filter("type = 'psd' and orig_name is not null").select(F.col("id").alias("psd_file_id"), psd_stem(stem(F.col("orig_name")), dialect).alias("key"))
    direct = documents.join(keyed, "key").select("psd_file_id", F.col("source.id").alias("source_file_id"), F.lit(100).alias("confidence"), F.lit("stem").alias("link_method"))
    if references is None:
        return direct
    name = F.col("name") if dialect == "v1" else stem(F.col("name"))
    whole = sources.select(normal_stem(F.col("orig_name"), dialect).alias("key"), "source").groupBy("key").agg(pick("source").alias("source")) if dialect == "v1" else keyed
    embedded = (
        references.join(direct, "psd_file_id", "left_anti")
        .select("psd_file_id", "pos", normal_stem(name, dialect).alias("key"))
        .join(whole, "key")
        .groupBy("psd_file_id")
        .agg(pick(F.struct("pos", "source")).alias("s"))
        .select("psd_file_id", F.col("s.source.id").alias("source_file_id"), F.lit(95).alias("confidence"), F.lit("smart_object").alias("link_method"))
    )
    return direct.unionByName(embedded)


def without_link(rows: DataFrame, links: DataFrame, key: str, link_key: str, condition: Column | None = None) -> DataFrame:
    """Rows that no link (that meets the condition) names."""
    those = links if condition is None else links.filter(condition)
    return rows.join(those.select(F.col(link_key).alias(key)).distinct(), key, "left_anti")
