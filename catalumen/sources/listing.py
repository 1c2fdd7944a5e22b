"""Directory trees and skip lists as DataFrames."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalumen.functions.paths import outside
from catalumen.runtime import cut

_ENTRY = "path string, name string, is_dir boolean, size_bytes long, mtime double, order_key array<string>, error string"
#: Levels of a tree that are listed at most; deeper ones are an error, not cut.
MOST_LEVELS = 200


def list_files(spark: SparkSession, root: str, skips: DataFrame | None = None, errors: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """path, name, size_bytes, mtime, order_key of all files under root, which all executors must see.

    Level by level: one job lists all directories of a depth on the executors, so neither a huge tree nor a huge
    directory is held by the driver. Links aren't followed, subtrees of skips (skip_dir) are never entered. Directories and
    entries that can't be read are passed over; errors is called with them (path, error). order_key sorts as a walk does that takes a directory's files before its
    subdirectories, names without case.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for folder, key in zip(b["path"], b["order_key"], strict=True):
                rows = []
                try:
                    with os.scandir(folder) as entries:
                        for e in entries:
                            try:
                                is_dir = e.is_dir(follow_symlinks=False)
                                if not is_dir and not e.is_file(follow_symlinks=False):
                                    continue
                                s = e.stat(follow_symlinks=False)
                            except OSError as x:
                                rows.append((e.path, e.name, False, None, None, [], str(x)))
                                continue
                            rows.append((e.path, e.name, is_dir, None if is_dir else s.st_size, s.st_mtime, [*key, ("1" if is_dir else "0") + e.name.lower() + "\0" + e.name], None))
                except OSError as x:
                    rows.append((folder, os.path.basename(folder), False, None, None, [], str(x)))
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "name", "is_dir", "size_bytes", "mtime", "order_key", "error"]).astype({"size_bytes": "Int64", "mtime": "Float64"})

    def prune(rows: DataFrame) -> DataFrame:
        return rows if skips is None else outside(rows, skips)

    level = prune(spark.createDataFrame([(os.path.abspath(root), [])], "path string, order_key array<string>"))
    found = spark.createDataFrame([], _ENTRY)
    for _ in range(MOST_LEVELS):
        entries = cut(prune(level.mapInPandas(read, _ENTRY)))
        if errors is not None:
            errors(entries.filter("error is not null").select("path", "error"))
        found = found.unionByName(entries.filter("not is_dir and error is null"))
        level = entries.filter("is_dir").select("path", "order_key").repartition(spark.sparkContext.defaultParallelism)
        if level.isEmpty():
            return found.drop("is_dir", "error")
    raise RuntimeError(f"{root} has more than {MOST_LEVELS} levels")


def skip_list(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """skip_dir of a list file: comments after # and blank lines off. With a root, relative entries lie under it (v1);
    without one they are kept as they are (v2) and match no absolute path. A missing file is logged and lists nothing (v1);
    without a root it is an error."""
    if root is not None and not readable(spark, path):
        logging.error("skip list not found: %s", path)
        return spark.createDataFrame([], "skip_dir string")
    line = F.trim(F.split("value", "#")[0])
    entries = spark.read.text(path).select(line.alias("skip_dir")).filter("skip_dir <> ''")
    if root is not None:
        absolute = F.col("skip_dir").startswith("/")
        entries = entries.select(F.when(absolute, F.col("skip_dir")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col("skip_dir"))).alias("skip_dir"))
    return entries.distinct()


def readable(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def unknown_paths(spark: SparkSession, path: str) -> DataFrame:
    """Distinct paths of a CSV with a column orig_path, else path, in any case; without one, no rows."""
    try:
        rows = spark.read.csv(path, header=True)
    except Exception as e:  # a missing file is an empty list
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string")
    named = {c.strip().lower(): c for c in rows.columns}
    column = named.get("orig_path") or named.get("path")
    if column is None:
        return spark.createDataFrame([], "path string")
    return rows.select(F.col(f"`{column}`").alias("path")).filter("path <> ''").distinct()
