"""Destination paths: dated names, main and resized pictures, collision-free numbering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalumen.functions.paths import normal_stem, parent, stem, suffix
from catalumen.functions.times import stamp
from catalumen.runtime import LEAST_HOT, cut, settled, skew_join, split_rank

PRIMARY = ["raw", "video", "tiff"]


def dated_name(name: Column, at: Column, middle: Column | str = "") -> Column:
    m = F.lit(middle) if isinstance(middle, str) else middle
    return F.concat(stem(name), m, F.lit("_"), stamp(at), suffix(name))


def folder(kind: Column, at: Column, root: str) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), F.when(kind == "raw", "raw").otherwise("output"), F.lit("/"), F.date_format(at, "yyyy"), F.lit("/"), F.date_format(at, "yyyy-MM"))


def resized_middle(width: Column, height: Column) -> Column:
    known = (width != 0) & (height != 0)
    return F.concat(F.lit("_resized"), F.when(known, F.concat(F.lit("_"), width.cast("string"), F.lit("x"), height.cast("string"))).otherwise(""))


def main_and_resized(pictures: DataFrame, dialect: str = "v2") -> DataFrame:
    """Adds group_stem, is_main and first_id: among pictures of one normal stem and second, the largest is main, the
    smallest id among equals; nulls count as no pixels.

    pictures: id, orig_name, at, width, height. The largest is found by a mergeable aggregate and joined back, so a
    stem and second that a third of all pictures share meets in no task's window.
    """
    pixels = F.coalesce("width", F.lit(0)).cast("long") * F.coalesce("height", F.lit(0))
    rows = pictures.withColumn("group_stem", normal_stem(stem(F.col("orig_name")), dialect)).withColumn("group_at", F.date_trunc("second", "at"))
    best = rows.groupBy("group_stem", "group_at").agg(F.max(F.struct(pixels.alias("p"), (-F.col("id")).alias("i"))).alias("b"), F.min("id").alias("first_id"))
    return rows.join(best, ["group_stem", "group_at"]).withColumn("is_main", F.col("id") == -F.col("b.i")).drop("b", "group_at")


def number_names(wanted: DataFrame, taken: DataFrame | None = None, style: str = "_{}", order: tuple[str, ...] = ("id",)) -> DataFrame:
    """(id, folder, name): the wanted name, or the first free numbered one, in the given order within each folder.

    wanted: id (unique), folder, want and the order columns, without nulls. taken: folder, name. A family is a folder's
    names that are equal without their numbers; only members of one family can clash. Families of one row that aren't
    taken, nearly all, keep their names without more ado. In a family of one wanted name that isn't taken, a row's number
    is its rank, which many tasks find where a name is hot. Families of several names, where a numbered form may be some
    other row's wanted name, are settled in order, one task per family; unrelated names of a folder never meet in a task.
    """
    before, after = style.split("{}")
    number = rf"({_literal(before)}\d+{_literal(after)})+\z"
    family = F.concat(F.regexp_replace(stem(F.col("want")), number, ""), suffix(F.col("want")))
    rows = settled(wanted.select("id", "folder", "want", *(c for c in order if c != "id")).withColumn("family", family))
    every = rows.select("folder", "family", "want", F.lit(0).alias("old"))
    used = None
    if taken is not None:
        used = taken.select("folder", F.col("name").alias("want")).filter("folder is not null and want is not null").distinct().withColumn("family", family)
        every = every.unionByName(used.select("folder", "family", "want", F.lit(1).alias("old")))
    kinds = every.groupBy("folder", "family").agg(F.count(F.lit(1)).alias("n"), F.max("old").alias("met"), (F.min("want") == F.max("want")).alias("single"))
    clashes = cut(kinds.filter("n > 1").select("folder", "family", "n", (F.col("single") & (F.col("met") == 0)).alias("plain")))
    most = clashes.agg(F.coalesce(F.max("n"), F.lit(0))).head()[0]
    clashes = clashes.drop("n")
    marked = cut(skew_join(rows, clashes, ["folder", "family"], "left", hot=[] if most <= LEAST_HOT else None))
    alone = marked.filter("plain is null").select("id", "folder", F.col("want").alias("name"))
    ranked = split_rank(marked.filter("plain").select("folder", "want", *order), ["folder", "want"], list(order))
    rank = F.col("rank")
    numbered = F.concat(stem(F.col("want")), F.lit(before), rank.cast("string"), F.lit(after), suffix(F.col("want")))
    fast = alone.unionByName(ranked.select("id", "folder", F.when(rank == 0, F.col("want")).otherwise(numbered).alias("name")))

    slow = marked.filter("not plain").drop("plain").withColumn("old", F.lit(False))
    if used is not None:
        slow = slow.unionByName(used.join(clashes.filter("not plain").select("folder", "family"), ["folder", "family"], "left_semi").withColumn("old", F.lit(True)), allowMissingColumns=True)
    sort = list(order)

    def settle(g: pd.DataFrame) -> pd.DataFrame:
        names = set(g.loc[g["old"], "want"])
        next_: dict[str, int] = {}
        new = g[~g["old"]].sort_values(sort)
        out = []
        for want in new["want"]:
            got = want
            if got in names:
                head, _, tail = want.rpartition(".")
                head, tail = (head, "." + tail) if head and tail else (want, "")
                n = next_.get(want, 1)
                while (got := f"{head}{before}{n}{after}{tail}") in names:
                    n += 1
                next_[want] = n + 1
            names.add(got)
            out.append(got)
        return pd.DataFrame({"id": new["id"].astype("int64"), "folder": new["folder"], "name": out})

    return fast.unionByName(slow.groupBy("folder", "family").applyInPandas(settle, "id long, folder string, name string"))


def _literal(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


def plan_destinations(files: DataFrame, captures: DataFrame, root: str = "/organized", dialect: str = "v2", linked_psds: DataFrame | None = None) -> DataFrame:
    """(id, dest_path) of raw, video, tiff and jpeg files and, in v2, of layered documents without a link.

    captures: id, at (local time), width, height. A file's own present destination doesn't count as taken, so planning
    again changes nothing. Order of numbering: the other types by (type, id), pictures by their group's first id,
    layered documents last. v1 starts without taken names. Files without a time or name have no plan.
    """
    rows = files.filter("orig_name is not null").join(captures, "id").filter("at is not null")

    def wants(kind: DataFrame, name: Column, pass_: int, by: Column, first: str = "id") -> DataFrame:
        where = folder(F.col("type"), F.col("at"), root)
        return kind.select("id", where.alias("folder"), name.alias("want"), F.lit(pass_).alias("pass"), by.alias("by"), F.col(first).alias("first"))

    plain = dated_name(F.col("orig_name"), F.col("at"))
    pictures = main_and_resized(rows.filter("type = 'jpeg'").select("id", "type", "orig_name", "at", "width", "height"), dialect)
    middle = F.when(F.col("is_main"), "").otherwise(resized_middle(F.col("width"), F.col("height")))
    every = wants(rows.filter(F.col("type").isin(PRIMARY)), plain, 0, F.col("type"))
    every = every.unionByName(wants(pictures, dated_name(F.col("orig_name"), F.col("at"), middle), 1, F.lit(""), "first_id"))
    taken = None
    if dialect == "v2":
        loose = rows.filter("type = 'psd'")
        if linked_psds is not None:
            loose = loose.join(linked_psds.select(F.col("psd_file_id").alias("id")).distinct(), "id", "left_anti")
        every = cut(every.unionByName(wants(loose, plain, 2, F.lit(""))))
        others = files.filter("dest_path is not null").join(every.select("id"), "id", "left_anti")
        taken = others.select(parent(F.col("dest_path")).alias("folder"), F.regexp_extract("dest_path", r"[^/]*\z", 0).alias("name"))
    named = number_names(every, taken, order=("pass", "by", "first", "id"))
    return named.select("id", F.concat("folder", F.lit("/"), "name").alias("dest_path"))


def sidecar_destinations(links: DataFrame, destinations: DataFrame, sidecars: DataFrame, dialect: str = "v2") -> DataFrame:
    """(sidecar_file_id, dest_path): a raw file's destination under the sidecar's extension, of the first raw file.

    v1 numbers clashes, "_n" in order of the sidecars' ids, among each other and with the destinations that are there;
    in v2 sidecars of one name share their destination.
    """
    raws = destinations.select(F.col("id").alias("raw_file_id"), "dest_path").filter("dest_path is not null")
    pairs = links.join(raws, "raw_file_id").join(sidecars.select(F.col("id").alias("sidecar_file_id"), suffix(F.col("orig_name")).alias("ext")), "sidecar_file_id")
    name = F.regexp_extract("dest_path", r"[^/]*\z", 0)
    path = F.concat(parent(F.col("dest_path")), F.lit("/"), stem(name), F.col("ext"))
    first = pairs.groupBy("sidecar_file_id").agg(F.min_by(path, "raw_file_id").alias("dest_path"))
    if dialect == "v2":
        return first
    split = lambda df: df.select("*", parent(F.col("dest_path")).alias("folder"), F.regexp_extract("dest_path", r"[^/]*\z", 0).alias("want"))
    first = cut(split(first.filter("dest_path is not null").withColumnRenamed("sidecar_file_id", "id")))
    there = raws.select(F.col("raw_file_id").alias("id"), "dest_path")
    if "dest_path" in sidecars.columns:
        there = there.unionByName(sidecars.filter("dest_path is not null").select("id", "dest_path"))
    taken = split(there.join(first.select("id"), "id", "left_anti")).select("folder", F.col("want").alias("name"))
    named = number_names(first.select("id", "folder", "want"), taken)
    return named.select(F.col("id").alias("sidecar_file_id"), F.concat("folder", F.lit("/"), "name").alias("dest_path"))


def psd_destinations(psds: DataFrame, links: DataFrame, destinations: DataFrame, dialect: str = "v2") -> DataFrame:
    """(psd_file_id, dest_path) of layered documents by their source's destination.

    v2: the source's folder with its first component raw turned to output, names as they are. v1: the source's folder
    itself, clashes numbered " (n)", and documents without a source's destination (column at) go to the relative folder
    output/Y/Y-MM/unlinked-psds.
    """
    sources = destinations.select(F.col("id").alias("source_file_id"), F.col("dest_path").alias("source_path")).filter("source_path is not null")
    rows = psds.withColumnRenamed("id", "psd_file_id").join(links.select("psd_file_id", "source_file_id"), "psd_file_id", "left").join(sources, "source_file_id", "left")
    if dialect == "v2":
        parts = F.split(parent(F.col("source_path")), "/")
        at = F.array_position(F.transform(parts, F.lower), "raw")
        turned = F.transform(parts, lambda p, i: F.when(i + 1 == at, "output").otherwise(p))
        return rows.filter("source_path is not null").select("psd_file_id", F.concat(F.array_join(turned, "/"), F.lit("/"), "orig_name").alias("dest_path"))
    loose = F.concat(F.lit("output/"), F.date_format("at", "yyyy"), F.lit("/"), F.date_format("at", "yyyy-MM"), F.lit("/unlinked-psds"))
    wanted = rows.select(F.col("psd_file_id").alias("id"), F.coalesce(parent(F.col("source_path")), loose).alias("folder"), F.col("orig_name").alias("want"))
    named = number_names(wanted.filter("folder is not null and want is not null"), None, " ({})")
    return named.select(F.col("id").alias("psd_file_id"), F.concat("folder", F.lit("/"), "name").alias("dest_path"))


def pending_moves(plan: DataFrame, present: DataFrame) -> DataFrame:
    """Planned rows whose destination isn't there yet. present: path."""
    return plan.filter("dest_path is not null").join(present.select(F.col("path").alias("dest_path")).distinct(), "dest_path", "left_anti")
