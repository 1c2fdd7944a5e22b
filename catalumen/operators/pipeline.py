"""The organizing run: records into a catalogue, links, destinations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalumen.functions.times import local_seconds
from catalumen.operators import catalog, links
from catalumen.operators.timestamps import utc_text
from catalumen.plans import destinations
from catalumen.runtime import cut, skew_join
from catalumen.sources.snapshots import Catalog, Conflict

FILES = ["id", "hash", "sparse_hash", "type", "ext", "orig_name", "orig_path", "dest_path", "size_bytes", "is_seed", "name_score", "first_seen_at", "last_seen_at"]


def ingest(cat: Catalog, records: DataFrame, dialect: str = "v2", tries: int = 5) -> None:
    """Merges a scan (seq unique within it) into the catalogue: files, metadata and occurrences, one new snapshot.

    The catalogue's own rows count as records that came before, so merging is the same aggregate as a first scan. Catalogued
    rows without a readable fingerprint stay as they are. Rows that turn out to be one content become the one of the
    smallest id, and metadata, occurrences and links of the others go to it. If another writer comes first, the merge
    is made again upon what that one wrote.
    """
    now = F.current_timestamp()
    scan = cut(records.withColumns({"seen": now, "capture_datetime": F.date_format("capture_datetime", "yyyy-MM-dd'T'HH:mm:ss")}))
    for left in reversed(range(tries)):
        base = cat.version()
        try:
            cat.write(*_merge(cat, base, scan, dialect), base=base)
            return
        except Conflict:
            if not left:
                raise


def _merge(cat: Catalog, base: int, scan: DataFrame, dialect: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The tables that a scan changes in a snapshot, and the rows that it appends."""
    shape = ["seq", "hash", "sparse_hash", "type", "ext", "orig_name", "orig_path", "size_bytes", "is_seed", "name_score", "seen"]
    old, rows = cat.table("files", base), scan.select(*shape)
    if old is None:
        kept, moved = None, None
        have = scan.sparkSession.createDataFrame([], "content string, id long")
    else:
        known = cut(old.withColumn("content", catalog.identity()))
        top = known.agg(F.coalesce(F.max("id"), F.lit(0))).head()[0]
        again = known.filter("content is not null").select((F.col("id") - top - 1).alias("seq"), *shape[1:-1], F.explode(F.array("first_seen_at", "last_seen_at")).alias("seen"))
        rows = again.unionByName(rows)
        have = cut(known.filter("content is not null").groupBy("content").agg(F.min("id").alias("id")))
        kept = known.filter("content is null").select(*FILES)
        moved = cut(known.select("content", F.col("id").alias("was")).join(have, "content").filter("was <> id").select("was", F.col("id").alias("now")))
    merged = cut(catalog.canonical(rows, "seq", "seen"))
    numbered = cut(catalog.assign_ids(merged, have, 0 if old is None else top))
    if old is None:
        files = numbered.withColumn("dest_path", F.lit(None).cast("string")).select(*FILES)
    else:
        files = numbered.join(old.select("id", "dest_path"), "id", "left").select(*FILES).unionByName(kept)
    ids = numbered.select("content", "id")
    meta = catalog.metadata_last(scan, "seq").join(ids, "content").withColumnRenamed("id", "file_id").drop("content")
    previous = cat.table("media_metadata", base)
    if previous is not None:
        one = _one_each(_remapped(previous, moved, "file_id"), previous.columns)
        meta = one.join(meta.select("file_id"), "file_id", "left_anti").unionByName(meta.select(*previous.columns))
    # a content with very many files: its id is broadcast
    seen = skew_join(scan.withColumn("content", catalog.identity()), ids, ["content"]).select(F.col("orig_path").alias("path"), F.col("id").alias("file_id"), "is_seed", F.col("seen").alias("seen_at"), "mtime", "size_bytes", F.coalesce("hash", "sparse_hash").alias("hash"), F.col("hash").isNull().alias("hash_is_sparse"))
    out, more = {"files": cut(files), "media_metadata": cut(meta)}, {}
    before = cat.table("file_occurrences", base)
    changed = moved is not None and not moved.isEmpty()
    if changed and before is not None:
        before = _remapped(before, moved, "file_id")
    if dialect == "v2" or before is None or changed:
        every = seen if before is None else before.unionByName(seen.select(*before.columns))
        out["file_occurrences"] = cut(catalog.occurrences_last(every) if dialect == "v2" else every)
    else:
        more["file_occurrences"] = seen.select(*before.columns)
    for name, ends in (("raw_sidecars", ["raw_file_id", "sidecar_file_id"]), ("raw_outputs", ["raw_file_id", "output_file_id"]), ("psd_source_links", ["psd_file_id", "source_file_id"])):
        links_ = cat.table(name, base) if changed else None
        if links_ is not None:
            for end in ends:
                links_ = _remapped(links_, moved, end)
            out[name] = cut(links_.dropDuplicates(ends[:1] if name == "psd_source_links" else ends))
    return out, more


def _remapped(rows: DataFrame, moved: DataFrame | None, column: str) -> DataFrame:
    """rows with the ids in a column that became others (moved: was, now) replaced."""
    if moved is None:
        return rows
    met = skew_join(rows, moved.withColumnRenamed("was", column), [column], "left")
    return met.withColumn(column, F.coalesce("now", column)).select(*rows.columns)


def _one_each(media: DataFrame, columns: list[str]) -> DataFrame:
    """One metadata row per file where several ids became one: whichever is largest as a whole."""
    rest = [c for c in columns if c != "file_id"]
    return media.groupBy("file_id").agg(F.max(F.struct(*rest)).alias("m")).select("file_id", *(f"m.{c}" for c in rest)).select(*columns)


def link(cat: Catalog, references: DataFrame | None = None, dialect: str = "v2") -> None:
    """Replaces the link tables by those of the present files."""
    base = cat.version()
    files, media = cat.table("files", base), cat.table("media_metadata", base)
    out = {"psd_source_links": links.psd_links(files, references, dialect)}
    if dialect == "v2":
        out["raw_sidecars"] = links.sidecar_links(files)
    else:
        out["raw_sidecars"] = links.sidecar_links_of_occurrences(cat.table("file_occurrences", base), files)
        rows = cut(files.select("id", "type", "orig_name").join(catalog.metadata_of(media).withColumnRenamed("file_id", "id"), "id", "left").withColumn("at", local_seconds(F.col("capture_datetime").try_cast("timestamp_ntz"))))
        out["raw_outputs"] = links.merge_links(links.by_name_and_time(rows), links.by_time_and_camera(rows), links.by_picture(rows))
    cat.write(out, base=base)


def plan(cat: Catalog, root: str, dialect: str = "v2") -> None:
    """Sets dest_path of all files that have one to come: primary files and pictures, then sidecars and layered ones.

    A file without a capture time goes by the change time of its path among the occurrences, and without that by now.
    """
    base = cat.version()
    files, media, psds, seen = (cat.table(t, base) for t in ("files", "media_metadata", "psd_source_links", "file_occurrences"))
    clock = seen.filter("mtime is not null").groupBy(F.col("path").alias("orig_path")).agg(F.max("mtime").alias("mtime"))
    second = F.rtrim(utc_text(F.floor("mtime")), F.lit("Z")).try_cast("timestamp_ntz")
    told = F.col("capture_datetime").try_cast("timestamp_ntz")
    meta = catalog.metadata_of(media).withColumnRenamed("file_id", "id")
    at = cut(files.select("id", "orig_path").join(meta, "id", "left").join(clock, "orig_path", "left").select("id", "width", "height", F.coalesce(told, second, F.localtimestamp()).alias("at")))
    made = cut(destinations.plan_destinations(files, at, root, dialect, psds))
    side = destinations.sidecar_destinations(cat.table("raw_sidecars", base), made, files, dialect).withColumnRenamed("sidecar_file_id", "id")
    layered = files.filter("type = 'psd'").select("id", "orig_name").join(at.select("id", "at"), "id", "left")
    docs = destinations.psd_destinations(layered, psds, made, dialect).withColumnRenamed("psd_file_id", "id")
    docs = docs.join(made.select("id"), "id", "left_anti")
    every = made.unionByName(side).unionByName(docs).withColumnRenamed("dest_path", "new_path")
    cat.write({"files": files.join(every, "id", "left").withColumn("dest_path", F.coalesce("new_path", "dest_path")).select(*FILES)}, base=base)
