"""CSV reports and the mover of files."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of each report and their headings.
REPORTS = {
    "source": {"path": "Source Path", "status": "Status", "file_type": "File Type", "dest_path": "Destination Path", "canonical_path": "Canonical Source (If Duplicate)", "note": "Notes"},
    "copy": {c: c for c in ("path", "type", "is_seed", "status", "dest_path", "duplicate_of", "hash")},
    "unprocessed": {c: c for c in ("raw_file_id", "raw_path", "capture_datetime", "camera_model", "has_output")},
    "unknown": {"id": "file_id", **{c: c for c in ("ext", "orig_path", "size_bytes", "is_seed", "first_seen_at", "last_seen_at")}},
    "unlinked": {"id": "psd_id", "orig_name": "psd_name", **{c: c for c in ("orig_path", "dest_path", "capture_datetime", "camera_model")}},
    "issues": {c: c for c in ("path", "in_unknown_files", "issues")},
}


def write_report(df: DataFrame, report: str, path: str) -> None:
    """Writes a report as quoted CSV files with a header, in the order of its first column."""
    columns = REPORTS[report]
    df.select(*(F.col(c).alias(h) for c, h in columns.items())).orderBy(F.col(next(iter(columns.values()))).asc_nulls_first()).write.mode("overwrite").csv(path, header=True, emptyValue="", quoteAll=False, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def move_files(plan: DataFrame, move: bool = False, dry_run: bool = False) -> DataFrame:
    """Copies or moves each planned file on the executors: id, orig_path, dest_path, status, mtime, size_bytes.

    plan: id, orig_path, dest_path. Existing destinations are left alone (present), so a task that runs again does no
    harm: files are copied to a temporary name beside their destination and renamed there. Errors are told by file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, source, dest in zip(b["id"], b["orig_path"], b["dest_path"], strict=True):
                status, mtime, size = "pending", None, None
                try:
                    if os.path.exists(dest):
                        status = "present"
                    elif not dry_run:
                        os.makedirs(os.path.dirname(dest), exist_ok=True)
                        part = f"{dest}.{uuid.uuid4().hex}.part"
                        shutil.copy2(source, part)
                        os.replace(part, dest)
                        if move:
                            os.unlink(source)
                        status = "moved" if move else "copied"
                    if os.path.exists(dest):
                        s = os.stat(dest)
                        mtime, size = s.st_mtime, s.st_size
                except OSError as e:
                    status = f"error: {e.strerror}"
                rows.append((i, source, dest, status, mtime, size))
            yield pd.DataFrame(rows, columns=["id", "orig_path", "dest_path", "status", "mtime", "size_bytes"]).astype({"mtime": "Float64", "size_bytes": "Int64"})

    todo = plan.select("id", "orig_path", "dest_path").filter("orig_path is not null and dest_path is not null")
    return todo.mapInPandas(run, "id long, orig_path string, dest_path string, status string, mtime double, size_bytes long")


def moved_occurrences(moved: DataFrame, files: DataFrame) -> DataFrame:
    """Occurrences of the destinations that were made: path, file_id, is_seed, mtime, size_bytes, hash, hash_is_sparse."""
    done = moved.filter(F.col("status").isin("copied", "moved")).select(F.col("id"), F.col("dest_path").alias("path"), "mtime", F.col("size_bytes").alias("written"))
    known = files.select("id", "is_seed", F.col("size_bytes").alias("known_size"), "hash", "sparse_hash")
    rows = done.join(known, "id").withColumn("h", F.coalesce("hash", "sparse_hash")).filter("h is not null")
    return rows.select("path", F.col("id").alias("file_id"), "is_seed", F.current_timestamp().alias("seen_at"), "mtime", F.coalesce("known_size", "written").alias("size_bytes"), F.col("h").alias("hash"), F.col("hash").isNull().alias("hash_is_sparse"))
