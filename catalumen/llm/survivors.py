"""Problem 2: duplicate groups of catalogue rows and the best representative of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalumen.functions.fingerprints import counts, full_hash, sparse_hash
from catalumen.operators.components import connected_components
from catalumen.runtime import blank, cut, table

#: Later than any score: a null score ranks last.
_LAST = 2**62


def rank_key() -> Column:
    """The order of survivors as one comparable struct, the best row first; id makes it total."""
    complete = ~blank("orig_path") & ~blank("orig_name")
    return F.struct(
        F.when(complete, 0).otherwise(1).alias("incomplete"),
        F.when(F.coalesce(F.col("is_seed"), F.lit(False)), 0).otherwise(1).alias("unseeded"),
        F.coalesce(-F.col("name_score").cast("long"), F.lit(_LAST)).alias("low_score"),
        F.col("first_seen_at").isNull().cast("int").alias("undated"),
        F.col("first_seen_at").alias("first_seen_at"),
        F.col("id").alias("id"),
    )


def content_rows(files: DataFrame) -> DataFrame:
    """Rows that take part, with node: the full hash, or the sparse hash where there is no full one."""
    return (
        files.filter(counts(F.col("size_bytes")))
        .select(rank_key().alias("rank"), full_hash(F.col("hash")).alias("full"), sparse_hash(F.col("sparse_hash")).alias("sparse"), *(F.col(c).alias(f"v_{c}") for c in ("orig_path", "orig_name", "is_seed", "name_score")))
        .withColumn("node", F.coalesce("full", "sparse"))
        .filter("node is not null")
    )


def _first_filled(name: str, filled: Column) -> Column:
    return F.min(F.when(filled, F.struct("rank", F.col(name).alias("value")))).alias(name)


def _tops(rows: DataFrame, fields: bool) -> DataFrame:
    """Per node: row count, first id, best rank, and with `fields` the best filled value of each field.

    All are mergeable aggregates, so that a node that holds a third of all rows is reduced before the shuffle.
    """
    aggs = [F.count(F.lit(1)).alias("n"), F.min("rank.id").alias("first_id"), F.min("rank").alias("rank")]
    if fields:
        aggs += [
            _first_filled("v_orig_path", ~blank("v_orig_path")),
            _first_filled("v_orig_name", ~blank("v_orig_name")),
            _first_filled("v_is_seed", F.col("v_is_seed").isNotNull()),
            _first_filled("v_name_score", F.col("v_name_score").isNotNull()),
        ]
    return rows.groupBy("node").agg(*aggs)


def duplicate_groups(files: DataFrame, fields: bool = False) -> DataFrame:
    """One row per node of a group: group (its smallest id), and the node's aggregates.

    Full hashes are nodes; a sparse hash is a node only where a row has no full hash, as only such rows link by
    sparse hash. Edges are the distinct (full, sparse) pairs that meet such a node. Nodes without an edge are
    groups already; the others are labelled by connected components over their first ids.
    """
    rows = content_rows(files)
    tops = cut(_tops(rows, fields))
    pairs = rows.filter("full is not null and sparse is not null").select("full", "sparse").distinct()
    ids = tops.select("node", "first_id")
    edges = (
        pairs.join(ids.withColumnsRenamed({"node": "sparse", "first_id": "b"}), "sparse")
        .join(ids.withColumnsRenamed({"node": "full", "first_id": "a"}), "full")
        .select("a", "b")
    )
    labels = connected_components(edges).select(F.col("node").alias("first_id"), F.col("component"))
    return tops.join(labels, "first_id", "left").withColumn("group", F.coalesce("component", "first_id")).drop("component")


def survivors(files: DataFrame) -> DataFrame:
    """(first_id, survivor_id) of each group of two or more rows.

    The survivor is the first row of the group's window in rank order. Each node sends its best row only, so no
    group's rows meet in one task; Spark's group limit keeps one row per group and task before that shuffle too.

    Nulls in any ranked column rank last, null fingerprints and rows of size 0 take no part, equal ranks fall to
    the smaller id; an empty table gives no rows; other columns are ignored whatever their names.
    """
    nodes = duplicate_groups(files)
    sizes = nodes.groupBy("group").agg(F.sum("n").alias("n")).filter("n > 1").select("group")
    order = Window.partitionBy("group").orderBy("rank")
    best = nodes.select("group", "rank").withColumn("at", F.row_number().over(order)).filter("at = 1")
    return best.join(sizes, "group").select(F.col("group").alias("first_id"), F.col("rank.id").alias("survivor_id"))


def golden_records(files: DataFrame) -> DataFrame:
    """Per group of two or more rows one built record: each field from the best-ranked row that has it filled."""
    nodes = duplicate_groups(files, fields=True)
    fields = ("orig_path", "orig_name", "is_seed", "name_score")
    return (
        nodes.groupBy("group")
        .agg(F.sum("n").alias("copies"), *(F.min(f"v_{c}").alias(f"v_{c}") for c in fields))
        .filter("copies > 1")
        .select(F.col("group").alias("first_id"), "copies", *(F.col(f"v_{c}.value").alias(c) for c in fields))
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(table(spark, sf_dir, "files"))


def p2_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden_records(table(spark, sf_dir, "files"))


QUERIES = {"p2_found": p2_found, "p2_golden": p2_golden}

_ROWS = r"""
WITH RECURSIVE r AS (
  SELECT *, CASE WHEN regexp_full_match(h, '[0-9a-f]{64}') THEN h END AS f,
            CASE WHEN regexp_full_match(s, 's-[0-9a-f]{64}') THEN s END AS p
  FROM (SELECT *, lower(trim(hash, E' \t\r\n')) AS h, lower(trim(sparse_hash, E' \t\r\n')) AS s FROM files)
  WHERE size_bytes IS NULL OR size_bytes <> 0),
k AS (SELECT *, coalesce(f, p) AS node,
        row_number() OVER (ORDER BY CASE WHEN regexp_matches(orig_path, '\S') AND regexp_matches(orig_name, '\S') THEN 0 ELSE 1 END,
          CASE WHEN is_seed THEN 0 ELSE 1 END, name_score DESC NULLS LAST, first_seen_at ASC NULLS LAST, id) AS rk
      FROM r WHERE coalesce(f, p) IS NOT NULL),
e AS (SELECT DISTINCT f AS a, p AS b FROM k WHERE f IS NOT NULL AND p IN (SELECT p FROM k WHERE f IS NULL)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c(node, other) AS (SELECT a, a FROM u UNION SELECT c.node, u.b FROM c JOIN u ON c.other = u.a),
l AS (SELECT node, min(other) AS comp FROM c GROUP BY node),
g AS (SELECT k.*, coalesce(l.comp, k.node) AS grp FROM k LEFT JOIN l USING (node))
"""

SQL = {
    "p2_found": _ROWS + "SELECT min(id) AS first_id, arg_min(id, rk) AS survivor_id FROM g GROUP BY grp HAVING count(*) > 1",
    "p2_golden": _ROWS
    + r"""SELECT min(id) AS first_id, count(*) AS copies,
 arg_min(orig_path, rk) FILTER (WHERE regexp_matches(orig_path, '\S')) AS orig_path,
 arg_min(orig_name, rk) FILTER (WHERE regexp_matches(orig_name, '\S')) AS orig_name,
 arg_min(is_seed, rk) FILTER (WHERE is_seed IS NOT NULL) AS is_seed,
 arg_min(name_score, rk) FILTER (WHERE name_score IS NOT NULL) AS name_score
FROM g GROUP BY grp HAVING count(*) > 1""",
}
