"""Problem 8: mixing sources to target weights by hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalumen.llm.tokens import token_counts
from catalumen.runtime import bounded_broadcast, cut, table

#: Bits of the hash that one level of histograms resolves.
LEVEL_BITS = 12


def source_key(column: Column) -> Column:
    """Lower case, outer white space off, blanks and hyphens as one underscore; null stays null."""
    return F.regexp_replace(F.regexp_replace(F.lower(column), r"(?U)^\s+|\s+$", ""), r"(?U)[\s_-]+", "_")


def targets_of(mix: DataFrame) -> DataFrame:
    """(source, share, max_repeats): one row per usable target; shares are weights over their sum.

    Targets that are spelt differently but are one source add their weights, under the smaller cap. Null or negative
    weights and caps count as 0.
    """
    clean = mix.select(source_key(F.col("source")).alias("source"), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("long").alias("cap"))
    one = clean.filter("source is not null").groupBy("source").agg(F.sum("weight").alias("weight"), F.min("cap").alias("cap"))
    total = one.agg(F.sum("weight")).head()[0] or 1.0
    return one.select("source", (F.col("weight") / F.lit(total)).alias("share"), "cap")


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, share, cap, available, docs, budget, base, rest) for each source that has a target or documents.

    The total is the largest one at which every target with documents meets its share within its cap; a given total
    may exceed that, and then capped sources fall short and say so. base: times that each document is used; rest:
    tokens still to be had from documents used once more.
    """
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count(F.lit(1)).alias("docs"))
    rows = targets.join(have, "source", "full").fillna(0, ["share", "cap", "available", "docs"])
    live = (F.col("share") > 0) & (F.col("cap") > 0) & (F.col("available") > 0)
    one = rows.filter(live).agg(F.sum("share").alias("s"), F.min(F.col("cap") * F.col("available") / F.col("share")).alias("t")).head()
    reach = one["s"] or 1.0
    most = (one["t"] or 0.0) * reach
    size = float(most if total is None else total)
    out = rows.withColumn("budget", F.when(live, F.least(F.lit(size) * F.col("share") / reach, (F.col("cap") * F.col("available")).cast("double"))).otherwise(0.0))
    out = out.withColumn("budget", F.floor(F.col("budget") + 1e-6))
    base = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0)
    return out.withColumn("base", base.cast("long")).withColumn("rest", F.col("budget") - F.col("base") * F.col("available"))


def thresholds(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, below): the documents whose hash is under `below` hold as many tokens as fit in the source's rest.

    Histograms of tokens by source and leading hash bits; each level bins only the documents of the bucket in which
    the budget runs out, so that a level is one pre-aggregated pass over ever fewer rows and nothing is sorted.
    Sets are nested: a larger rest keeps all that a smaller one takes. Documents of equal hash go together.
    """
    left = plan.filter("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("low"))
    rows, done, shift = sizes, None, 60
    while shift > 0:
        shift -= LEVEL_BITS
        bins = (
            rows.join(bounded_broadcast(left), "source")
            .filter(F.shiftright(F.col("hash") - F.col("low"), min(60, shift + LEVEL_BITS)) == 0)
            .filter(F.col("hash") >= F.col("low"))
            .groupBy("source", "rest", "low", F.shiftright(F.col("hash") - F.col("low"), shift).alias("bin"))
            .agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
        )
        running = F.sum("tokens").over(Window.partitionBy("source").orderBy("bin"))  # 2 ** LEVEL_BITS rows a source at most
        at = F.min_by(F.struct("bin", "tokens", "docs", "running"), F.when(F.col("running") > F.col("rest"), F.col("bin")))
        met = cut(bins.withColumn("running", running).groupBy("source", "rest", "low").agg(at.alias("at")))
        # without a bucket that exceeds the rest all rows of this range fit
        low = F.when(F.col("at").isNull(), F.col("low") + F.lit(1 << (shift + LEVEL_BITS))).otherwise(F.col("low") + F.shiftleft(F.col("at.bin"), shift))
        step = met.select("source", F.when(F.col("at").isNull(), F.lit(0)).otherwise(F.col("rest") - F.col("at.running") + F.col("at.tokens")).alias("rest"), low.alias("low"), F.coalesce(F.col("at.docs"), F.lit(0)).alias("docs"))
        ended = step.filter("docs <= 1" if shift else "true").select("source", F.col("low").alias("below"))
        done = ended if done is None else done.unionByName(ended)
        left = step.filter("docs > 1").select("source", "rest", "low")
        if left.isEmpty():
            break
    return done


def mix(documents: DataFrame, mix_targets: DataFrame, total: int | None = None, seed: int = 42, report: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(use, report). use: doc_id, source, n_tokens, repeats (1 or more) of each document of the mixture.
    report: source, target_share, max_repeats, docs, available_tokens, used_tokens, actual_share, all sources; a pass
    of its own, left out where it isn't asked for.

    Documents of a null source or one without a target aren't used; a target without documents has an actual share
    of 0, and the others keep their proportions. Null and empty texts have no tokens and are used as often as their
    source's other documents under the threshold. Rows repeated as a whole count each. Empty tables give no use.
    """
    spark = documents.sparkSession
    counted = token_counts(documents.select("doc_id", source_key(F.col("source")).alias("source"), "text"), ["doc_id", "source"])
    # 60 bits, so that sums and shifts stay positive
    sizes = cut(counted.withColumn("hash", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 4)))
    known = sizes.filter("source is not null")
    plan = cut(budgets(known, targets_of(mix_targets), total))
    marks = bounded_broadcast(cut(plan.join(thresholds(known, plan), "source", "left").select("source", "base", F.coalesce("below", F.lit(0)).alias("below"))))
    use = (
        known.join(marks, "source")
        .withColumn("repeats", F.col("base") + (F.col("hash") < F.col("below")).cast("long"))
        .filter("repeats > 0")
        .select("doc_id", "source", "n_tokens", "repeats")
    )
    if not report:
        return use, None
    used = use.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"))
    whole = use.agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t")).head()[0] or 0
    share = F.col("used_tokens") / F.lit(float(whole)) if whole else F.lit(0.0)
    told = (
        plan.join(used, "source", "left")
        .fillna(0, ["used_tokens"])
        .select("source", F.col("share").alias("target_share"), F.col("cap").alias("max_repeats"), "docs", F.col("available").alias("available_tokens"), "budget", "used_tokens", share.alias("actual_share"))
    )
    return use, told


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), report=False)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
