"""Session, table access, lineage cuts and skew-safe joins shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Most rows that a table may have to be broadcast as a whole after its count is known.
BROADCAST_ROWS = 10_000


def build_session(app: str = "catalumen", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session with the settings that the operators are written for; conf goes over them.

    Under spark-submit, or with another master in conf, only those settings are made that any cluster needs: memory,
    cores, shuffle partitions and the shared folder stay the cluster's own. Else it is a local session.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ
    if not submitted and conf.get("spark.master", "local").startswith("local"):
        settings |= {
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": "8",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        }
    spark = SparkSession.builder.appName(app).config(map=settings | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, once; they needn't have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_catalumen_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="catalumen-"), "catalumen.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(home):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
    sc.addPyFile(path)
    sc._catalumen_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; a cluster session is refused, as a
    machine-local folder would lose data with its machine.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir()
    if not path and not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="catalumen-")
    if not current:
        sc.setCheckpointDir(path)
        conf = sc._jsc.sc().conf()
        if not conf.contains("spark.cleaner.referenceTracking.cleanCheckpoints"):
            # a checkpoint's files go once no plan refers to it any more
            conf.set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return path or current


def shared_table(spark: SparkSession, stem: str) -> str:
    """A path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Plan nodes that cost more than reading and projecting rows: fixed names of Spark's logical plans.
_COSTLY = re.compile(r"\b(Join|Aggregate|Window|MapInPandas|MapInArrow|FlatMap\w+|Generate|Sort|Distinct|Deduplicate|Repartition\w*|RebalancePartitions)\b")


def bare(df: DataFrame) -> bool:
    """Whether df only reads and projects rows."""
    return _COSTLY.search(df._jdf.queryExecution().optimizedPlan().toString()) is None


def settled(df: DataFrame) -> DataFrame:
    """df itself where it only reads and projects rows, else its checkpoint: for plans that are read several times."""
    return df if bare(df) else cut(df)


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Within it, plans whose generated methods the JVM would only interpret, over 8,000 bytes of code, run as split ones.

    For wide projections of many patterns; what runs within must be eager, as a cut is.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table of the shared folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def parallelism(spark: SparkSession) -> int:
    """Tasks that are worth having at least: the cores, or the shuffle partitions where more."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """Repartitions a scan with fewer splits than cores, so that Python work on it uses all of them.

    A plan that does more than to read and project is cut first: its number of partitions is known only once it ran.
    """
    df = settled(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts df if it has at most `rows` rows; beyond that leaves the join to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A key is hot with more than this share of its side's rows: at most 2 / HOT keys are taken for hot, whatever the data.
HOT = 0.002
#: Rows that any hot key has at least.
LEAST_HOT = 1000
#: Tasks at most for the meeting blocks of hot keys, of which each has one if they are fewer.
CELL_TASKS = 10_000


def _sketch(on: list[str], share: float, name: str) -> Column:
    """A mergeable sketch of fixed size of the keys' 64-bit hashes, which misses none above the share; null keys don't count.

    4 / share counters (32 KB a task at most) err by less than half the share, so that at most 2 / share keys can seem hot.
    """
    there = reduce(and_, (F.col(c).isNotNull() for c in on))
    key = F.when(there, F.xxhash64(*on))
    return F.call_function("approx_top_k", key, F.lit(int(2 / share)), F.lit(int(4 / share))).alias(name)


def _hot(top: list | None, rows: int, share: float, least: int) -> list[int]:
    return sorted(r["item"] for r in top or [] if r["item"] is not None and r["count"] > max(least, int(rows * share)))


def hot_hashes(df: DataFrame, on: list[str], share: float = HOT, least: int = LEAST_HOT) -> list[int]:
    """64-bit hashes of the keys that hold more than `share` of df's rows and more than `least`; null keys don't count.

    One pass with a mergeable sketch of frequent items: nothing is shuffled but the tasks' sketches.
    """
    told = df.na.drop("any", None, on).agg(_sketch(on, share, "top"), F.count(F.lit(1)).alias("n")).head()
    return _hot(told["top"], told["n"], share, least)


def cut_hot(df: DataFrame, ons: list[list[str]], share: float = HOT, least: int = LEAST_HOT) -> tuple[DataFrame, list[list[int]]]:
    """cut(), and hot_hashes() of each of several keys, found in the same pass."""
    told = Observation()
    out = cut(df.observe(told, F.count(F.lit(1)).alias("n"), *(_sketch(on, share, f"top{i}") for i, on in enumerate(ons))))
    for _ in range(100):  # metrics come a moment after the action; each look waits a tenth of a second at most
        if told._jo.getRowOrEmpty().isDefined():
            seen = told.get
            return out, [_hot(seen[f"top{i}"], seen["n"], share, least) for i in range(len(ons))]
    return out, [hot_hashes(out, on, share, least) for on in ons]  # a plan that lost its metrics


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", share: float = HOT, hot: list[int] | None = None) -> DataFrame:
    """Joins left with right, in which `on` is unique, without sending a hot key of left to one task.

    Keys with more than `share` of left's rows, 2 / share at most: their rows of right are broadcast. All other keys
    are joined by shuffle; rows with a null key, which match nothing, are neither shuffled nor compared. `how` is
    inner, left or left_semi. hot: the hashes of the hot keys, where hot_hashes() gave them before.
    """
    if hot is None:
        left, hot = (left, hot_hashes(left, on, share)) if bare(left) else _only(cut_hot(left, [on], share))
    elif hot:
        left = settled(left)
    there = left.na.drop("any", None, on)
    if not hot:
        out = there.join(right, on, how)
    else:
        is_hot, right = F.xxhash64(*on).isin(hot), settled(right)
        out = there.filter(~is_hot).join(right, on, how).unionByName(there.filter(is_hot).join(F.broadcast(right.filter(is_hot)), on, how))
    if how != "left":
        return out
    added = [f for f in right.schema if f.name not in on]
    lost = left.filter(reduce(or_, (F.col(c).isNull() for c in on)))
    return out.unionByName(lost.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in added)))


def _only(told: tuple[DataFrame, list[list[int]]]) -> tuple[DataFrame, list[int]]:
    return told[0], told[1][0]


def block_join(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, rows: int = 2_000, hot: list[int] | None = None) -> DataFrame:
    """Inner join of two sides that both may have hot keys: every pair comes out once, no task gets a key as a whole.

    Keys with more than `rows` rows on a side that are hot there are cut into blocks by the hash of the side's id; each
    block meets each block of the other side as a key of its own. All other keys are joined by shuffle. hot: the hashes
    of the hot keys of either side, where they are known before.
    """
    if hot is None:
        left, one = (left, hot_hashes(left, on, least=rows)) if bare(left) else _only(cut_hot(left, [on], least=rows))
        right, two = (right, hot_hashes(right, on, least=rows)) if bare(right) else _only(cut_hot(right, [on], least=rows))
        hot = sorted({*one, *two})
    elif hot:
        left, right = settled(left), settled(right)
    a, b = left.na.drop("any", None, on), right.na.drop("any", None, on)
    if not hot:
        return a.join(b, on)
    is_hot = F.xxhash64(*on).isin(hot)

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.filter(is_hot).groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))

    grid = cut(blocks(a, "_ka").join(blocks(b, "_kb"), on))  # 4 / HOT rows at most
    met = grid.agg(F.sum(F.col("_ka").cast("long") * F.col("_kb"))).head()[0] or 1
    tasks, grid = min(met, CELL_TASKS), F.broadcast(grid)

    def cells(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        met = df.filter(is_hot).join(grid, on)
        mine = F.pmod(F.xxhash64(key, F.lit(7)), F.col("_k" + own)).cast("int").alias("_" + own)
        cut_up = met.select(*df.columns, mine, F.explode(F.sequence(F.lit(0), F.col("_k" + other) - 1)).alias("_" + other))
        return cut_up.repartition(tasks, *on, "_a", "_b")  # a fixed number: by their few bytes all cells would go to one task

    warm = cells(a, left_id, "a", "b").join(cells(b, right_id, "b", "a"), [*on, "_a", "_b"]).drop("_a", "_b")
    cold = a.filter(~is_hot).join(b.filter(~is_hot), on)
    return cold.union(warm)  # columns in one order; both sides may have others of the same name


def split_rank(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Adds each row's rank from 0 within its keys, in an order without ties; a hot key is ranked by many tasks.

    Rows are cut into ranges of (keys, order) and ranked within these; a key that goes on into later ranges, of which
    each range has one at most, is offset by its rows in the ranges before.
    """
    ranged = cut(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    later = cut(counts.withColumn("_before", before).filter("_before is not null").drop("_n"))  # a row per range at most
    local = F.row_number().over(Window.partitionBy("_p", *keys).orderBy(*order)) - 1
    met = ranged.withColumn("_r", local).join(F.broadcast(later), [*keys, "_p"], "left")
    return met.withColumn(name, (F.col("_r") + F.coalesce("_before", F.lit(0))).cast("long")).select(*df.columns, name)


def blank(column: Column | str) -> Column:
    """True for null, empty and all-white text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(~c.rlike(r"(?U)[^\s]"), F.lit(True))


def default_dir() -> str:
    return os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
