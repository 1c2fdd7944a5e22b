"""Problem 5: whether a key occurred before, by sharded quotient filters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalumen.functions.fingerprints import sparse_hash
from catalumen.llm.history import signature
from catalumen.runtime import shared_dir, shared_table, table

#: Bits of a stored remainder.
REMAINDER_BITS = 32
#: Keys of the history for which one shard is planned, and shards at least: fixed, so that a stored filter fits any cluster.
SHARD_KEYS = 1_000_000
LEAST_SHARDS = 16
#: Raised when stored filters of older code can't be read by this one.
FORM = 1
#: Rows that a task reduces at once before it sends anything.
LOCAL_ROWS = 2_000_000


@dataclass
class QuotientFilter:
    """Sorted remainders with one occupied bit per quotient and one run-end bit per remainder, all packed.

    A key's low q + r bits split into a quotient of q bits and a remainder of r; equal pairs are stored once. It
    takes r + 1 bits a key and 1 bit a quotient, and answers yes for a strange key with probability of about
    keys / 2 ** (q + r).
    """

    q: int
    r: int
    occupied: np.ndarray
    run_ends: np.ndarray
    remainders: np.ndarray

    @staticmethod
    def build(keys: np.ndarray, q: int, r: int = REMAINDER_BITS) -> QuotientFilter:
        """Of any uint64 keys, in any order, repeats allowed."""
        return QuotientFilter._of_sorted(np.unique(keys & np.uint64((1 << (q + r)) - 1)), q, r)

    @staticmethod
    def _of_sorted(short: np.ndarray, q: int, r: int) -> QuotientFilter:
        quotient = (short >> np.uint64(r)).astype(np.int64)
        occupied = np.zeros(1 << q, dtype=bool)
        occupied[quotient] = True
        last = np.ones(len(short), dtype=bool)
        last[:-1] = quotient[1:] != quotient[:-1]
        kind = np.uint8 if r <= 8 else np.uint16 if r <= 16 else np.uint32
        return QuotientFilter(q, r, np.packbits(occupied), np.packbits(last), (short & np.uint64((1 << r) - 1)).astype(kind))

    def __len__(self) -> int:
        return len(self.remainders)

    def size(self) -> int:
        return self.occupied.nbytes + self.run_ends.nbytes + self.remainders.nbytes

    def keys(self) -> np.ndarray:
        """The stored quotient-remainder words, ascending, restored from the run metadata."""
        ends = np.unpackbits(self.run_ends, count=len(self)).astype(bool)
        run = np.cumsum(ends) - ends
        quotients = np.flatnonzero(np.unpackbits(self.occupied))
        return (quotients[run].astype(np.uint64) << np.uint64(self.r)) | self.remainders.astype(np.uint64)

    @staticmethod
    def merge(filters: list[QuotientFilter], q: int, r: int = REMAINDER_BITS) -> QuotientFilter:
        """One filter of all keys, by merging the sorted words."""
        words = [f.keys() for f in filters] or [np.empty(0, np.uint64)]
        whole = np.sort(np.concatenate(words), kind="stable")  # runs are sorted already: a merge
        keep = np.ones(len(whole), dtype=bool)
        keep[1:] = whole[1:] != whole[:-1]
        return QuotientFilter._of_sorted(whole[keep], q, r)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        short = keys & np.uint64((1 << (self.q + self.r)) - 1)
        quotient = (short >> np.uint64(self.r)).astype(np.int64)
        remainder = (short & np.uint64((1 << self.r) - 1)).astype(self.remainders.dtype)
        bits = np.unpackbits(self.occupied)
        rank = np.cumsum(bits, dtype=np.int64)
        run_end = np.flatnonzero(np.unpackbits(self.run_ends, count=len(self)))
        found = np.zeros(len(keys), dtype=bool)
        live = np.flatnonzero(bits[quotient])
        run = rank[quotient[live]] - 1
        at = np.where(run > 0, run_end[run - 1] + 1, 0)
        end = run_end[run]
        while len(live):
            found[live[self.remainders[at] == remainder[live]]] = True
            go = (at < end) & ~found[live]
            live, at, end = live[go], at[go] + 1, end[go]
        return found

    def pack(self) -> bytes:
        """Remainders, and the quotients of their sorted words as gaps of one to nine bytes: in proportion to the keys,
        however many quotients are empty. The bitmaps are made again by unpack()."""
        words = self.keys() >> np.uint64(self.r)
        gaps = np.diff(words, prepend=np.uint64(0))
        head = np.array([self.q, self.r, len(self)], dtype=np.int64)
        return head.tobytes() + self.remainders.tobytes() + varints(gaps)

    @staticmethod
    def unpack(blob: bytes) -> QuotientFilter:
        q, r, n = np.frombuffer(blob, np.int64, 3).tolist()
        kind = np.dtype(np.uint8 if r <= 8 else np.uint16 if r <= 16 else np.uint32)
        remainders = np.frombuffer(blob, kind, n, 24)
        quotients = np.cumsum(read_varints(np.frombuffer(blob, np.uint8, offset=24 + n * kind.itemsize)), dtype=np.uint64)
        return QuotientFilter._of_sorted((quotients << np.uint64(r)) | remainders.astype(np.uint64), q, r)


def varints(values: np.ndarray) -> bytes:
    """uint64 values as bytes of 7 bits, low ones first; the high bit of a byte says that more follow."""
    size = np.ones(len(values), dtype=np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << (7 * k)) if 7 * k < 64 else 0
    out = np.empty(int(size.sum()), dtype=np.uint8)
    at = np.cumsum(size) - size
    for k in range(int(size.max(initial=0))):
        live = size > k
        more = (size[live] > k + 1).astype(np.uint8) << 7
        out[at[live] + k] = ((values[live] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes()


def read_varints(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    begin = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    nth = np.arange(len(data)) - np.repeat(begin, ends - begin + 1)
    parts = (data & 127).astype(np.uint64) << (7 * nth).astype(np.uint64)
    return np.add.reduceat(parts, begin) if len(ends) else np.empty(0, np.uint64)


@dataclass(frozen=True)
class Layout:
    """2 ** shard_bits shards by a key's top bits; in each a filter of q + r low bits."""

    shard_bits: int
    q: int
    r: int = REMAINDER_BITS

    @staticmethod
    def of(keys: int, least_shards: int = LEAST_SHARDS, r: int = REMAINDER_BITS) -> Layout:
        shards = max(least_shards, -(-keys // SHARD_KEYS), 1)
        bits = (shards - 1).bit_length()
        each = max(1, keys >> bits)
        return Layout(bits, min(64 - bits - r, max(8, each.bit_length())), r)

    def shard(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.shard_bits)).astype(np.int64) if self.shard_bits else np.zeros(len(keys), np.int64)

    def short(self, keys: np.ndarray) -> np.ndarray:
        """What of a key a shard's filter can tell apart: its words are equal if these are."""
        return keys & np.uint64((1 << (self.q + self.r)) - 1)

    def wrong_rate(self, keys: int) -> float:
        """Expected share of wrong yes answers for strange keys, with this many keys stored in all."""
        return keys / 2.0 ** (self.shard_bits + self.q + self.r)


def _split(layout: Layout, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions), with the positions in any order."""
    shard = layout.shard(keys)
    order = np.argsort(shard, kind="stable")
    names, begin = np.unique(shard[order], return_index=True)
    for name, part in zip(names.tolist(), np.split(order, begin[1:]), strict=True):
        yield name, part


def _gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches joined up to LOCAL_ROWS rows."""
    held: list[pd.DataFrame] = []
    n = 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= LOCAL_ROWS:
            yield pd.concat(held)
            held, n = [], 0
    if n:
        yield pd.concat(held)


def history_filters(keys: DataFrame, layout: Layout) -> DataFrame:
    """(shard, filter): a small filter of each task's keys for each shard; hot keys shrink before the shuffle."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _gather(batches):
            k = np.unique(b["key"].to_numpy(np.int64).view(np.uint64))
            parts = [(s, QuotientFilter.build(k[at], layout.q, layout.r).pack()) for s, at in _split(layout, k)]
            yield pd.DataFrame(parts, columns=["shard", "filter"])

    return keys.mapInPandas(build, "shard long, filter binary")


def local_leaders(records: DataFrame, layout: Layout) -> DataFrame:
    """(shard, keys, ids, repeats): each task's first record of each key, packed by shard.

    A record whose key has a smaller record_id in the same task is known to repeat: only its id travels on, to the
    shards in turn, so that a hot key's records are spread over all of them.
    """
    shards = 1 << layout.shard_bits

    def lead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = TaskContext.get().partitionId()
        for b in _gather(batches):
            k, i = b["key"].to_numpy(np.int64).view(np.uint64), b["id"].to_numpy(np.int64)
            order = np.lexsort((i, k))
            k, i = k[order], i[order]
            first = np.ones(len(k), dtype=bool)
            first[1:] = (k[1:] != k[:-1])
            again = i[~first]
            k, i = k[first], i[first]
            out = [(s, k[at].tobytes(), i[at].tobytes(), b"") for s, at in _split(layout, k)]
            for n, part in enumerate(np.array_split(again, shards)):
                if len(part):
                    out.append(((turn + n) % shards, b"", b"", part.tobytes()))
            yield pd.DataFrame(out, columns=["shard", "keys", "ids", "repeats"])

    return records.mapInPandas(lead, "shard long, keys binary, ids binary, repeats binary")


def seen_before(history: DataFrame, records: DataFrame, layout: Layout) -> DataFrame:
    """(record_id) of the records whose key is in the history or in a record of smaller id.

    history: key long, or filters (shard, filter) as SeenKeys keeps them. records: key long, id long. Keys are 64-bit
    hashes; null keys must be left out. Memory of a task: one shard's filter, about r + 3 bits for each key of it, and that
    shard's new keys.
    """

    def answer(past: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        known = QuotientFilter.merge([QuotientFilter.unpack(x) for x in past["filter"]], layout.q, layout.r)
        k = np.frombuffer(b"".join(new["keys"]), np.uint64)
        i = np.frombuffer(b"".join(new["ids"]), np.int64)
        order = np.lexsort((i, layout.short(k)))
        k, i = k[order], i[order]
        yes = np.zeros(len(k), dtype=bool)
        if len(known):
            yes = known.contains(k)
        word = layout.short(k)
        yes[1:] |= word[1:] == word[:-1]  # the filter of the records before it would say so
        return pd.DataFrame({"record_id": np.concatenate([i[yes], np.frombuffer(b"".join(new["repeats"]), np.int64)])})

    filters = history if "filter" in history.columns else history_filters(history, layout)
    return filters.groupBy("shard").cogroup(local_leaders(records, layout).groupBy("shard")).applyInPandas(answer, "record_id long")


class SeenKeys:
    """Filters of all keys seen so far, one row a shard, in a folder that all executors share.

    Versions are folders that count once their write is complete; absorb() merges new keys into the newest one's
    filters and writes the next. Neither earlier keys nor their hashes are read again. The layout is fixed at the start,
    for as many keys as are expected; more keys make answers wrong more often, as wrong_rate() tells.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, expected: int = 0) -> None:
        self.spark, self.path = spark, path or shared_table(spark, "seen")
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._hadoop(self.path))
        told = [n for n in self._names() if n.startswith("layout-")]
        if not told:
            made = Layout.of(expected)
            told = [f"layout-{FORM}-{made.shard_bits}-{made.q}-{made.r}"]
            self._fs.mkdirs(self._hadoop(f"{self.path}/{told[0]}"))
        form, *bits = map(int, told[0].split("-")[1:])
        if form != FORM:
            raise ValueError(f"the filters at {self.path} have another form")
        self.layout = Layout(*bits)

    def _names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._hadoop(self.path)))

    def version(self) -> int:
        """The newest complete version, 0 without one."""
        done = [n for n in self._names() if n.startswith("v") and self._fs.exists(self._hadoop(f"{self.path}/{n}/_SUCCESS"))]
        return int(done[-1][1:]) if done else 0

    def filters(self) -> DataFrame:
        """(shard, filter) of the newest version."""
        shape = "shard long, filter binary"
        n = self.version()
        return self.spark.read.schema(shape).parquet(f"{self.path}/v{n:08d}") if n else self.spark.createDataFrame([], shape)

    def absorb(self, keys: DataFrame) -> None:
        """Adds keys (key long, without nulls); keys that are there already change nothing."""
        layout = self.layout

        def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            one = QuotientFilter.merge([QuotientFilter.unpack(x) for x in group["filter"]], layout.q, layout.r)
            return pd.DataFrame({"shard": [key[0]], "filter": [one.pack()]})

        parts = self.filters().unionByName(history_filters(keys, layout))
        parts.groupBy("shard").applyInPandas(merge, "shard long, filter binary").write.mode("overwrite").parquet(f"{self.path}/v{self.version() + 1:08d}")

    def seen(self, records: DataFrame) -> DataFrame:
        """(record_id) of the records whose key was absorbed, or is in a record of smaller id."""
        return seen_before(self.filters(), records, self.layout)


def key_of(column: Column) -> Column:
    return F.xxhash64(sparse_hash(column))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[SeenKeys, DataFrame, int]:
    """Filters of the catalogue's keys as the tables are now, made once; the records; and how many rows both have."""
    files, records = table(spark, sf_dir, "files"), table(spark, sf_dir, "file_records")
    counted = sparse_hash(F.col("sparse_hash")).isNotNull()
    new = records.filter(counted & F.col("record_id").isNotNull()).select(key_of(F.col("sparse_hash")).alias("key"), F.col("record_id").alias("id"))
    stored = files.count() + records.count()
    where = f"{shared_dir(spark).rstrip('/')}/p5-seen-{FORM}-{signature(spark, f'{sf_dir}/files.parquet', f'{sf_dir}/file_records.parquet')}"
    keys = SeenKeys(spark, where, stored)
    if not keys.version():
        keys.absorb(files.filter(counted).select(key_of(F.col("sparse_hash")).alias("key")))
    return keys, new, stored


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose sparse hash counts and occurred before; nulls and broken hashes never do.

    Empty tables give no rows; rows repeated as a whole repeat their key; other columns are ignored.
    """
    keys, new, _ = _sides(spark, sf_dir)
    return keys.seen(new)


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: answers, true and false ones against an exact check, and the measured and the derived rate of error.

    The exact check finds each hash's first record by a mergeable minimum; it is for this report only.
    """
    keys, new, stored = _sides(spark, sf_dir)
    files, records = table(spark, sf_dir, "files"), table(spark, sf_dir, "file_records")
    h = sparse_hash(F.col("sparse_hash")).alias("h")
    # a hash's non-first records are as many as its records less one, unless the catalogue has it
    past = files.select(h).filter("h is not null").distinct().withColumn("past", F.lit(1))
    per = records.select(h, "record_id").filter("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    exact = per.join(past, "h", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.sum(F.when(F.col("past") == 1, F.col("n")).otherwise(F.col("n") - 1)), F.lit(0)).alias("seen_exact"))
    told = keys.seen(new).agg(F.count(F.lit(1)).alias("seen_told"))
    both = exact.withColumn("seen_told", F.lit(0).cast("long")).unionByName(told.withColumns({"records": F.lit(0).cast("long"), "seen_exact": F.lit(0).cast("long")}))
    one = both.agg(*(F.sum(c).alias(c) for c in ("records", "seen_exact", "seen_told")))
    strange, wrong = F.col("records") - F.col("seen_exact"), F.col("seen_told") - F.col("seen_exact")  # no known key is missed
    return one.withColumns({"measured_rate": F.when(strange > 0, wrong / strange).otherwise(0.0), "derived_rate": F.lit(keys.layout.wrong_rate(stored))})


QUERIES = {"p5_found": p5_found, "p5_rates": p5_rates}

_SEEN = r"""
WITH r AS (SELECT record_id, lower(trim(sparse_hash, E' 	
')) AS p FROM file_records),
k AS (SELECT record_id, p, row_number() OVER (PARTITION BY p ORDER BY record_id) AS n FROM r WHERE regexp_full_match(p, 's-[0-9a-f]{64}')),
s AS (SELECT record_id FROM k WHERE n > 1 OR p IN (SELECT lower(trim(sparse_hash, E' 	
')) FROM files WHERE sparse_hash IS NOT NULL)),
t AS (SELECT (SELECT count(*) FROM files) + (SELECT count(*) FROM file_records) AS n),
b AS (SELECT n, ceil(log2(greatest(""" + str(LEAST_SHARDS) + ", ceil(n / " + str(SHARD_KEYS) + """.0))))::INT AS shard_bits FROM t),
l AS (SELECT n, shard_bits, least(64 - shard_bits - """ + str(REMAINDER_BITS) + """, greatest(8, 1 + floor(log2(greatest(1, n >> shard_bits)))::INT)) AS q FROM b)
"""
SQL = {
    "p5_found": _SEEN + "SELECT record_id FROM s",
    # no wrong answer is expected: keys * derived rate is far below 1
    "p5_rates": _SEEN + f"""SELECT (SELECT count(*) FROM k) AS records, (SELECT count(*) FROM s) AS seen_exact, (SELECT count(*) FROM s) AS seen_told,
 0.0::DOUBLE AS measured_rate, n / pow(2.0, shard_bits + q + {REMAINDER_BITS}) AS derived_rate FROM l""",
}
