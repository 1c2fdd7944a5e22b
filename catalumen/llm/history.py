"""Problem 4: new batches against everything accepted before, by content-defined chunks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalumen.functions.fingerprints import counts, full_hash, sparse_hash
from catalumen.llm.chunks import chunk
from catalumen.runtime import block_join, cut, cut_hot, hot_hashes, remove, settled, shared_dir, shared_table, skew_join, spread, table

#: Chunk sizes for fingerprints of 32 bytes: 8 bytes are 64 bits, so unequal fingerprints share no chunk by chance.
FINGERPRINT = {"least": 8, "bits": 2, "most": 16}
#: Chunk sizes for texts, and the share of a text's bytes that one accepted text must hold for it to be a near-duplicate.
TEXT = {"least": 8, "bits": 3, "most": 64}
COVERAGE = 0.8
#: Rows of the chunk table for which one part is planned; a power of two of parts, fixed when a history begins.
PART_ROWS = 2_000_000
MOST_PARTS = 4096
#: Raised when stored histories of older code can't be read by this one.
FORM = 1
#: The chunk-to-content table. A content is known by its 64-bit id; total is its length; part is the chunk's prefix.
TABLE = "chunk long, bytes int, id long, total int, batch int"


def chunk_rows(contents: DataFrame, **sizes: int) -> DataFrame:
    """TABLE rows of a table of distinct (content binary, batch int).

    bytes counts a chunk once for each time the content has it.
    """

    def cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [bytes(x) for x in b["content"]]
            row, length, value = chunk(texts, **sizes)
            g = pd.DataFrame({"row": row, "chunk": value, "bytes": length}).groupby(["row", "chunk"], as_index=False)["bytes"].sum()
            at = g["row"].to_numpy()
            total = np.array([len(t) for t in texts], dtype=np.int64)[at]
            yield pd.DataFrame({"chunk": g["chunk"], "bytes": g["bytes"], "id": b["id"].to_numpy()[at], "total": total, "batch": b["batch"].to_numpy()[at]})

    return contents.filter("content is not null").select("content", "batch", content_id(F.col("content")).alias("id")).mapInPandas(cuts, TABLE)


def content_id(content: Column) -> Column:
    return F.xxhash64(content)


class History:
    """The persistent chunk-to-content table of all accepted contents, in a folder that all executors share.

    Each append is a step: a folder of its own, partitioned by the leading bits of the chunk, that counts from the
    moment its write is complete. match() reads only the parts that the new contents' looked-up chunks fall into, and
    append() only adds files, so nothing accepted is chunked, read or written again. A path whose history exists goes on
    from there; without a path the history is a new one.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, coverage: float = 1.0, rows: int = 0, parts: int | None = None, **sizes: int) -> None:
        self.spark, self.coverage, self.sizes = spark, coverage, sizes or FINGERPRINT
        self.path = path or shared_table(spark, "history")
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        shape = self._hadoop(f"{self.path}/shape.json")
        if not self._fs.exists(shape):
            wanted = parts or min(MOST_PARTS, 1 << (max(1, -(-rows // PART_ROWS)) - 1).bit_length())
            self._fs.mkdirs(self._hadoop(self.path))
            out = self._fs.create(shape, True)
            out.write(bytearray(json.dumps({"parts": wanted, "sizes": self.sizes, "form": FORM}).encode()))
            out.close()
        text = self._fs.open(shape)
        told = json.loads(bytes(text.readAllBytes()))
        text.close()
        if told["form"] != FORM or told["sizes"] != self.sizes:
            raise ValueError(f"the history at {self.path} has another form or other chunk sizes")
        self.parts: int = told["parts"]

    def steps(self) -> list[str]:
        """Names of the complete appends, in order."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop(self.path)) if s.isDirectory()]
        return sorted(n for n in names if n.startswith("step=") and self._fs.exists(self._hadoop(f"{self.path}/{n}/_SUCCESS")))

    def has(self, step: str) -> bool:
        return f"step={step}" in self.steps()

    def part(self, column: Column) -> Column:
        return F.pmod(F.shiftrightunsigned(column, 40), F.lit(self.parts)).cast("int")

    def append(self, contents: DataFrame, step: str | None = None) -> None:
        """Adds distinct (content, batch) rows; nulls and empty contents add nothing."""
        self.append_chunks(chunk_rows(contents, **self.sizes), step)

    def append_chunks(self, rows: DataFrame, step: str | None = None) -> None:
        """Adds TABLE rows as a step; one of the same name is replaced, so that a repeated append does no harm."""
        step = step or f"{len(self.steps()):06d}"
        placed = rows.withColumn("part", self.part(F.col("chunk")))
        if self.parts > 1:
            placed = placed.repartition("part")
        placed.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/step={step}")

    def table(self, parts: list[int] | None = None, steps: list[str] | None = None) -> DataFrame:
        """All rows, or those of some parts and steps: other folders aren't opened."""
        steps = self.steps() if steps is None else steps
        shape = TABLE + ", part int, step string"
        if not steps:
            return self.spark.createDataFrame([], shape)
        df = self.spark.read.schema(shape).option("basePath", self.path).parquet(*(f"{self.path}/{s}" for s in steps))
        return df if parts is None else df.filter(F.col("part").isin(parts))

    def match(self, contents: DataFrame) -> DataFrame:
        """(id, known, total, shared, batch): pairs of a new and a known content that share enough of the longer one's bytes."""
        return self.match_chunks(chunk_rows(contents, **self.sizes))

    def match_chunks(self, rows: DataFrame, steps: list[str] | None = None) -> DataFrame:
        """match() of TABLE rows, whose batch doesn't matter here, against some steps.

        A known content that shares enough of a new one shares some of any set of its chunks that holds more than the
        rest of its bytes. So only such a set is looked up: the content's rarest chunks among the new contents, for full
        cover a single one. Candidates thus come from few parts and few rows; those chunks that the history too has
        often are passed over for the content's next ones where there are any. Byte totals of the candidates are then
        summed over all chunks, with the history's rows of the candidates only.
        """
        new = settled(rows.drop("batch"))
        often_new = hot_hashes(new, ["chunk"])
        known, often_known = self._met(new, steps)
        often = new.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).join(known.groupBy("chunk").agg(F.count(F.lit(1)).alias("m")), "chunk", "left")
        rare_first = Window.partitionBy("id").orderBy("m", "n", "chunk").rowsBetween(Window.unboundedPreceding, -1)
        needed = (
            skew_join(new, often, ["chunk"], hot=often_new)
            .withColumn("m", F.coalesce("m", F.lit(0)))
            .withColumn("before", F.coalesce(F.sum("bytes").over(rare_first), F.lit(0)))
            .filter(F.col("before") <= (1 - self.coverage) * F.col("total"))
            .filter("m > 0")
        )
        alike = F.least("total", "held") >= self.coverage * F.greatest("total", "held")
        pairs = block_join(needed.select("chunk", "id", "total"), known.select("chunk", "known", "batch", "held"), ["chunk"], "id", "known", hot=sorted({*often_new, *often_known})).filter(alike).select("id", "known", "batch").distinct()
        ways = pairs.join(new.select("id", "chunk", "bytes", "total"), "id").join(known, ["known", "batch", "chunk"])
        met = ways.groupBy("id", "known", "batch", "total", "held").agg(F.sum(F.least("bytes", "has")).alias("shared"))
        return met.filter(F.col("shared") >= self.coverage * F.greatest("total", "held")).select("id", "known", "total", "shared", "batch")

    def _met(self, new: DataFrame, steps: list[str] | None) -> tuple[DataFrame, list[int]]:
        """(chunk, known, batch, has, held) of the history's rows whose chunk a new content has, from those chunks' parts; and
        its hot chunks."""
        wanted = cut(new.select("chunk").distinct())
        parts = sorted(r[0] for r in wanted.select(self.part(F.col("chunk")).alias("p")).distinct().collect())  # MOST_PARTS at most
        held = self.table(parts, steps).select("chunk", F.col("id").alias("known"), "batch", F.col("bytes").alias("has"), F.col("total").alias("held"))
        rows, (often,) = cut_hot(held.join(wanted, "chunk", "left_semi"), [["chunk"]])
        return rows, often

    def absorb(self, rows: DataFrame, step: str | None = None) -> DataFrame:
        """Checks TABLE rows of new contents against the history, and adds those of contents that nothing covers.

        Gives match_chunks()'s rows, cut. Repeated, with the same step, it gives the same: the step's own rows don't count.
        """
        own = f"step={step}" if step else None
        found = cut(self.match_chunks(rows, [s for s in self.steps() if s != own]))
        if own is None or own not in self.steps():
            self.append_chunks(rows.join(found.select("id").distinct(), "id", "left_anti").select(*rows.columns), step)
        return found

    def delete(self) -> None:
        remove(self.spark, self.path)


def signature(spark: SparkSession, *paths: str) -> str:
    """A short name of the files under paths as they are now: by place, length and time of change."""
    jvm, told = spark.sparkContext._jvm, []
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        told += [f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in (fs.listStatus(where) if fs.exists(where) else [])]
    return hashlib.sha256("\n".join(sorted(told)).encode()).hexdigest()[:16]


def _contents(df: DataFrame, batch: str) -> DataFrame:
    """(record_id where there is one, batch, kind, content) for each fingerprint of rows that count, as bytes."""
    full, sparse = full_hash(F.col("hash")), sparse_hash(F.col("sparse_hash"))
    both = F.array(
        F.struct(F.lit("full").alias("kind"), F.unhex(full).alias("content")),
        F.struct(F.lit("sparse").alias("kind"), F.concat(F.lit(b"s-"), F.unhex(F.substring(sparse, 3, 64))).alias("content")),
    )
    ids = [c for c in ("record_id",) if c in df.columns]
    rows = df.filter(counts(F.col("size_bytes"))).select(F.expr(batch).cast("int").alias("batch"), *ids, F.explode(both).alias("x"))
    return rows.select("batch", *ids, "x.kind", "x.content").filter("content is not null")


def known_records(files: DataFrame, records: DataFrame, path: str | None = None) -> DataFrame:
    """(record_id, match_kind) of the records whose content was accepted before their batch.

    The history is at `path`, where the catalogue (step files, batch 0) and the batches (step records) stay stored: a
    second run finds them there and chunks and adds nothing but what is new. Each distinct fingerprint of the records is
    chunked once. Those that the history has not are added under the batch that brought them first, then all are
    matched with that step too; a later batch meets a content if its batch number is smaller than its own, so that
    all batches are one step with the same answers as batch after batch. Without a path the history is deleted at the end.
    Equality of the matched ids is checked last, as full cover ignores order.

    Fingerprints that are null or broken, and rows of size 0 on either side, don't count; null batch numbers match
    nothing; repeated records come out once; empty tables give no rows; other columns are ignored.
    """
    spark = records.sparkSession
    history = History(spark, path, rows=0 if path is None else 6 * files.count())
    if not history.has("files"):
        history.append(_contents(files, "0").groupBy("content").agg(F.min("batch").alias("batch")), "files")
    rows = settled(_contents(records, "batch_no"))
    first = rows.groupBy("content").agg(F.min("batch").alias("batch"))
    new = cut(chunk_rows(first.withColumn("batch", F.coalesce("batch", F.lit(2**31 - 1))), **history.sizes))
    before = history.absorb(new, "records")
    own = history.match_chunks(new, ["step=records"])
    seen = before.select("id", "known", "batch").unionByName(own.select("id", "known", "batch")).filter("id = known")
    since = cut(seen.groupBy("id").agg(F.min("batch").alias("since")))
    if path is None:
        history.delete()
    records_of = rows.select("record_id", "batch", "kind", content_id(F.col("content")).alias("id"))
    return skew_join(records_of, since, ["id"]).filter("since < batch").groupBy("record_id").agg(F.min("kind").alias("match_kind"))


def near_documents(documents: DataFrame, batch: Column, coverage: float = COVERAGE, path: str | None = None) -> DataFrame:
    """(doc_id, batch, known_id, shared, total, coverage), one row per document with a text and a batch, batch after batch.

    known_id: of the accepted documents of earlier batches, the one that shares most of the text's bytes, if at least
    `coverage` of the longer of both, the earliest batch among equals; null for an accepted text. A text that is accepted joins the
    history, one that isn't doesn't. Runs of white space count as one space, outer ones not at all. Texts that are then
    equal are one content, known by the smallest doc_id of their first batch; those of one batch don't meet each other.
    Batches are taken in order; there must be few of them (a loop each).

    Null and blank texts and null batches have no row; repeated rows count once; no document gives no rows; other
    columns are ignored.
    """
    spark = documents.sparkSession
    even = F.btrim(F.regexp_replace("text", r"(?U)\s+", " "))
    rows = documents.select("doc_id", F.encode(even, "UTF-8").alias("content"), batch.cast("int").alias("batch"))
    rows = settled(rows.filter("length(content) > 0 and batch is not null and doc_id is not null"))
    each = rows.select("doc_id", "batch", content_id(F.col("content")).alias("id")).distinct()
    history = History(spark, path, coverage, **TEXT)
    texts = spread(cut(rows.groupBy("content", "batch").agg(F.min("doc_id").alias("first"))))
    chunks = cut(chunk_rows(texts.select("content", "batch"), **TEXT))
    names = cut(texts.select(content_id(F.col("content")).alias("known"), F.col("batch").alias("known_batch"), "first"))
    out = None
    for b in sorted(r[0] for r in chunks.select("batch").distinct().collect()):
        found = history.absorb(chunks.filter(F.col("batch") == b), f"batch{b:09d}")
        best = found.groupBy("id", "total").agg(F.max_by(F.struct("known", F.col("batch").alias("known_batch")), F.struct("shared", -F.col("batch"), -F.col("known"))).alias("k"), F.max("shared").alias("shared"))
        one = best.select("id", F.lit(b).alias("batch"), "k.known", "k.known_batch", "shared", "total")
        out = one if out is None else out.unionByName(one)
    if path is None:
        history.delete()
    if out is None:
        return spark.createDataFrame([], "doc_id long, batch int, known_id long, shared long, total int, coverage double")
    told = out.join(names, ["known", "known_batch"]).select("id", "batch", F.col("first").alias("known_id"), "shared", "total")
    met = each.join(told, ["id", "batch"], "left")
    return met.select("doc_id", "batch", "known_id", "shared", "total", (F.col("shared") / F.col("total")).alias("coverage"))


def _kept(spark: SparkSession, sf_dir: str, *names: str) -> str:
    """Where the history of these tables, as they are now, is kept."""
    return f"{shared_dir(spark).rstrip('/')}/p4-history-{FORM}-{signature(spark, *(f'{sf_dir}/{n}.parquet' for n in names))}"


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return known_records(table(spark, sf_dir, "files"), table(spark, sf_dir, "file_records"), _kept(spark, sf_dir, "files", "file_records"))


def p4_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per batch: records, and how many of them were known by full and by sparse hash."""
    records = table(spark, sf_dir, "file_records")
    found = p4_found(spark, sf_dir)
    return (
        records.select("record_id", "batch_no")
        .join(found, "record_id", "left")
        .groupBy("batch_no")
        .agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("match_kind") == "full").alias("known_full"), F.count_if(F.col("match_kind") == "sparse").alias("known_sparse"))
    )


def p4_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in batches by the year in which they were posted, each against all accepted before."""
    return near_documents(table(spark, sf_dir, "documents"), F.year("posted_at")).select("doc_id", "batch", "known_id", "shared", "total")


QUERIES = {"p4_found": p4_found, "p4_batches": p4_batches, "p4_near": p4_near}
_FOUND = r"""
WITH b AS (
  SELECT 0 AS batch, NULL AS record_id, hash, sparse_hash FROM files WHERE size_bytes IS NULL OR size_bytes <> 0
  UNION ALL SELECT batch_no, record_id, hash, sparse_hash FROM file_records WHERE size_bytes IS NULL OR size_bytes <> 0),
r AS (
  SELECT batch, record_id, CASE WHEN regexp_full_match(h, '[0-9a-f]{64}') THEN h END AS f,
         CASE WHEN regexp_full_match(s, 's-[0-9a-f]{64}') THEN s END AS p
  FROM (SELECT *, lower(trim(hash, E' \t\r\n')) AS h, lower(trim(sparse_hash, E' \t\r\n')) AS s FROM b)),
ff AS (SELECT f, min(batch) AS since FROM r WHERE f IS NOT NULL GROUP BY f),
pp AS (SELECT p, min(batch) AS since FROM r WHERE p IS NOT NULL GROUP BY p),
found AS (
  SELECT record_id, CASE WHEN ff.since < batch THEN 'full' ELSE 'sparse' END AS match_kind
  FROM r LEFT JOIN ff USING (f) LEFT JOIN pp USING (p)
  WHERE record_id IS NOT NULL AND (ff.since < batch OR pp.since < batch))
"""

SQL = {
    "p4_found": _FOUND + "SELECT record_id, match_kind FROM found",
    "p4_batches": _FOUND
    + """SELECT batch_no, count(*) AS records, count(*) FILTER (WHERE match_kind = 'full') AS known_full,
 count(*) FILTER (WHERE match_kind = 'sparse') AS known_sparse FROM file_records LEFT JOIN found USING (record_id) GROUP BY batch_no""",
}
