"""A catalogue of parquet tables in snapshots: a manifest names each table's folders, and a numbered pointer the manifest."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ["files", "media_metadata", "file_occurrences", "raw_sidecars", "raw_outputs", "psd_source_links"]
VERSION = 2


class Conflict(RuntimeError):
    """Another writer made the next snapshot first; nothing was written over. Read again, and write again."""


class Catalog:
    """Reads and replaces the catalogue's tables. All paths go through Hadoop's file systems, so any shared one will do.

    A snapshot is a manifest: table -> folders. Tables that a write doesn't touch keep their folders, and rows can be
    appended as one folder more, so that a write costs what it writes. Snapshot n becomes visible by the pointer n, which is
    created exclusively: of two writers that saw the same snapshot the second fails with Conflict.
    """

    def __init__(self, spark: SparkSession, path: str, must_exist: bool = False) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if must_exist and self.version() == 0:
            raise FileNotFoundError(f"no catalogue at {path}")

    def _read(self, name: str) -> str:
        f = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return bytes(f.readAllBytes()).decode()
        finally:
            f.close()

    def _create(self, name: str, text: str) -> None:
        """A new file with this content; FileExistsError if there is one."""
        where = self._path(f"{self.path}/{name}")
        self._fs.mkdirs(where.getParent())
        if self._fs.getScheme() == "file":
            # the local file system's own create isn't exclusive
            with open(os.open(where.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644), "w") as f:
                f.write(text)
            return
        try:
            out = self._fs.create(where, False)
        except Exception as e:
            if "AlreadyExists" in str(e) or self._fs.exists(where):
                raise FileExistsError(name) from e
            raise
        out.write(bytearray(text.encode()))
        out.close()

    def _pointers(self) -> list[int]:
        where = self._path(f"{self.path}/pointers")
        names = [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        """The number of the present snapshot, 0 without one. A pointer counts once it names its manifest."""
        return next((n for n in reversed(self._pointers()) if self._read(f"pointers/{n:08d}")), 0)

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        """table -> folders of a snapshot, of the present one if no number is given."""
        n = self.version() if version is None else version
        return json.loads(self._read(self._read(f"pointers/{n:08d}")))["tables"] if n else {}

    def table(self, name: str, version: int | None = None) -> DataFrame | None:
        folders = self.manifest(version).get(name)
        return self.spark.read.parquet(*(f"{self.path}/{f}" for f in folders)) if folders else None

    def write(self, tables: dict[str, DataFrame], append: dict[str, DataFrame] | None = None, base: int | None = None) -> int:
        """Makes the snapshot after `base` (the present one): tables replaced, rows appended, all else taken over.

        Give as base the version that the tables were made from. Readers of older snapshots are not disturbed, a failed
        write leaves the pointers as they were, and a snapshot that another writer made after base is a Conflict.
        """
        base = self.version() if base is None else base
        named = dict(self.manifest(base))
        for kept, given in ((False, tables), (True, append or {})):
            for name, df in given.items():
                folder = f"data/{name}-{uuid.uuid4().hex}"
                df.write.parquet(f"{self.path}/{folder}")
                named[name] = [*(named.get(name, []) if kept else []), folder]
        manifest = f"manifests/{uuid.uuid4().hex}.json"
        self._create(manifest, json.dumps({"form": VERSION, "tables": named}))
        number = base + 1
        while True:
            try:
                self._create(f"pointers/{number:08d}", manifest)
                return number
            except FileExistsError:
                if self._read(f"pointers/{number:08d}"):
                    raise Conflict(f"another writer made snapshot {number} first") from None
                number += 1  # the pointer of a writer that died before it named its manifest
