"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalumen.runtime import cut, hot_hashes, skew_join


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """One row (node, component) for each node of the edges; component is the smallest node id in it.

    Min-label hooking with pointer jumping: the rounds grow with the logarithm of the diameter. Each round
    pre-aggregates its messages per receiver and ends in a reliable checkpoint; nothing is collected. A node with very
    many edges and a label of very many nodes are joined as hot keys, so that no task gets them whole.
    Edges with a null end are ignored, loops keep their node; no edges give no rows.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u is not null and v is not null")
    both = cut(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    hubs = hot_hashes(both, ["u"])
    labels = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")).withColumnRenamed("u", "n"))
    weight = _weight(labels)
    for _ in range(most_rounds):
        near = skew_join(both, labels.withColumnRenamed("n", "u"), ["u"], hot=hubs).groupBy("v").agg(F.min("l").alias("m"))
        told = near.join(labels, near.v == labels.n).select("n", "l", "m")
        hooked = cut(
            told.select(F.explode(F.array(F.struct("n", F.least("l", "m").alias("l")), F.struct(F.col("l").alias("n"), F.least("l", "m").alias("l")))).alias("x"))
            .select("x.n", "x.l")
            .groupBy("n")
            .agg(F.min("l").alias("l"))
        )
        up = hooked.select(F.col("n").alias("l"), F.col("l").alias("ll"))
        labels = cut(skew_join(hooked, up, ["l"]).select("n", F.least("l", "ll").alias("l")))
        before, weight = weight, _weight(labels)
        if weight == before:
            return labels.select(F.col("n").alias("node"), F.col("l").alias("component"))
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def _weight(labels: DataFrame) -> int | None:
    """The exact sum of all labels: they only ever fall, so that an equal sum means that none changed."""
    return labels.agg(F.sum(F.col("l").cast("decimal(38,0)"))).head()[0]
