"""Problem 1: pictures that differ by small edits, by a prefix-tree join of their perceptual hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalumen.runtime import block_join, cut, cut_hot, hot_hashes, parallelism, skew_join, table

#: Most differing bits, and the largest ratio of two shapes.
BITS, SHAPE = 5, 1.02
#: Rows of one tree that a task holds; larger trees are cut into blocks and joined block by block.
TREE_ROWS = 200_000
#: Node pairs expanded at once.
PAIRS = 1_000_000
#: Rows of a class, or of a hash, that meet others as one block.
BLOCK_ROWS = 2_000
#: Pairs of files of two classes up to which these are expanded by plain joins.
CELL = 10_000


def read_phash(column: Column) -> Column:
    """The 64-bit value of a usable picture hash: 16 hex digits, not all the same; null for anything else."""
    c = F.regexp_replace(F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")), "^0x", "")
    usable = c.rlike(r"^[0-9a-f]{16}\z") & ~c.rlike(r"^(.)\1{15}\z")
    # conv() to base -10 gives the signed value of 64 bits
    return F.when(usable, F.conv(c, 16, -10).cast("long"))


def segments(bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, width) of bits + 1 nearly equal segments of a 64-bit hash."""
    n = bits + 1
    ends = [64 * (i + 1) // n for i in range(n)]
    return [(a, b - a) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _rotate(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    first = first.astype(np.uint64)
    return (x << first) | np.where(first > 0, x >> (np.uint64(64) - first) % np.uint64(64), np.uint64(0))


class Tree:
    """A prefix tree over sorted words of one rotation: level k has a node for each distinct prefix of k + 1 grams.

    A gram is (segment, value); the rotation fixes the global order of grams. Nodes are ranges of the level below.
    """

    def __init__(self, words: np.ndarray, depths: list[int]) -> None:
        self.words = words  # ascending, distinct
        self.prefix, self.begin = [], []
        for depth in depths:
            p = words >> np.uint64(64 - depth)
            at = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.empty(0, np.int64)
            self.prefix.append(p[at])
            self.begin.append(np.append(at, len(p)))

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children, on the next level, of nodes."""
        low, high = self.begin[level][node], self.begin[level][node + 1]
        below = self.begin[level + 1]
        first = np.searchsorted(below, low)
        return first, np.searchsorted(below, high) - first


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = count.sum()
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def tree_join(a: np.ndarray, b: np.ndarray, widths: list[int], bits: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of words of a and b that differ in at most `bits` bits, with every prefix of k grams in at most
    floor(k * bits / grams): by the cycle lemma each close pair meets these bounds in at least one rotation.

    Walks pairs of nodes from the roots down: all pairs below two nodes share the prefixes' distance, and a pair of
    nodes beyond its level's bound is dropped with all below it. With `same`, a is b and pairs come out once.
    """
    depths = np.cumsum(widths).tolist()
    n = len(widths)
    bound = [k * bits // n for k in range(1, n + 1)]
    left = Tree(a, depths)
    right = left if same else Tree(b, depths)
    # level 0: equal first grams
    common, x, y = np.intersect1d(left.prefix[0], right.prefix[0], assume_unique=True, return_indices=True)
    stack = [(0, x, y)] if len(common) else []
    while stack:
        level, x, y = stack.pop()
        if level == n - 1:
            yield left.words[left.begin[level][x]], right.words[right.begin[level][y]]
            continue
        if level == 0 and bound[1] == 1:
            nx, ny = _siblings(left, right, widths[1])
            if same:
                keep = nx <= ny
                nx, ny = nx[keep], ny[keep]
            stack.append((1, nx, ny))
            continue
        fx, cx = left.children(level, x)
        fy, cy = right.children(level, y)
        size = cx * cy
        if size.sum() > PAIRS and len(x) > 1:
            half = np.searchsorted(np.cumsum(size), size.sum() // 2)
            half = min(max(1, half), len(x) - 1)
            stack += [(level, x[:half], y[:half]), (level, x[half:], y[half:])]
            continue
        for lo in range(0, int(size.sum()) or 0, 4 * PAIRS) if len(x) == 1 else (0,):
            k = np.arange(lo, min(int(size.sum()), lo + 4 * PAIRS)) if len(x) == 1 else _ranges(np.zeros_like(size), size)
            owner = np.zeros(len(k), np.int64) if len(x) == 1 else np.repeat(np.arange(len(x)), size)
            nx, ny = fx[owner] + k // np.maximum(cy[owner], 1), fy[owner] + k % np.maximum(cy[owner], 1)
            near = np.bitwise_count(left.prefix[level + 1][nx] ^ right.prefix[level + 1][ny]) <= bound[level + 1]
            if same:
                near &= nx <= ny
            if near.any():
                stack.append((level + 1, nx[near], ny[near]))


def _siblings(left: Tree, right: Tree, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of level-1 nodes under equal first grams whose second grams differ in at most one bit."""
    xs, ys = [], []
    for flip in [0, *(1 << i for i in range(width))]:
        want = left.prefix[1] ^ np.uint64(flip)
        at = np.searchsorted(right.prefix[1], want)
        hit = at < len(right.prefix[1])
        hit[hit] = right.prefix[1][at[hit]] == want[hit]
        xs.append(np.flatnonzero(hit))
        ys.append(at[hit])
    return np.concatenate(xs), np.concatenate(ys)


def _meets(a: np.ndarray, b: np.ndarray, widths: list[int], bits: int) -> np.ndarray:
    """Whether the pair meets all prefix bounds in this rotation."""
    n, ok = len(widths), np.ones(len(a), dtype=bool)
    for k, depth in enumerate(np.cumsum(widths).tolist(), 1):
        ok &= np.bitwise_count((a ^ b) >> np.uint64(64 - depth)) <= k * bits // n
    return ok


def close_hashes(hashes: DataFrame, bits: int = BITS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(ha, hb) of each pair of different values of hashes.h (distinct longs) that differ in at most `bits` bits.

    Each hash is sent once per rotation to the shard of its (rotation, first gram); a shard joins the trees of all
    its first grams at once. First grams are at most (bits + 1) * 2 ** 11, so the counts of those that hold more than
    `tree_rows` hashes are read by the driver; such trees are cut into blocks, and each pair of blocks is a shard
    of its own. A pair that meets the bounds in several rotations comes out in the first of them only.
    """
    spark = hashes.sparkSession
    parts = segments(bits)
    order = [[w for _, w in parts[s:] + parts[:s]] for s in range(len(parts))]
    firsts = np.array([f for f, _ in parts])
    grams = F.array(*(F.struct(F.lit(s).alias("s"), F.shiftrightunsigned(F.shiftleft(F.col("h"), f), 64 - w).alias("g")) for s, (f, w) in enumerate(parts)))
    rows = hashes.filter("h is not null").select("h", F.explode(grams).alias("x")).select("h", "x.s", "x.g")
    counts = cut(rows.groupBy("s", "g").agg(F.count(F.lit(1)).alias("n")))
    shards = max(parallelism(spark), int((counts.agg(F.sum("n")).head()[0] or 0) // tree_rows) * 2)
    big = {(r.s, r.g): -(-r.n // tree_rows) for r in counts.filter(F.col("n") > tree_rows).collect()}
    home = F.pmod(F.xxhash64("s", "g"), F.lit(shards)).cast("int")
    if big:
        blocks = F.broadcast(spark.createDataFrame([(s, g, k) for (s, g), k in big.items()], "s int, g long, k int"))
        cutup = rows.join(blocks, ["s", "g"]).withColumn("own", F.pmod(F.xxhash64("h"), F.col("k")).cast("int"))
        cutup = cutup.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
            "h", "s", F.concat_ws("-", "s", "g", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), (F.col("own") > F.col("other")).alias("second")
        )
        small = rows.join(blocks, ["s", "g"], "left_anti")
        sent = small.select("h", "s", home.cast("string").alias("shard"), F.lit(False).alias("second")).unionByName(cutup)
    else:
        sent = rows.select("h", "s", home.cast("string").alias("shard"), F.lit(False).alias("second"))

    def join(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        ends = key[0].split("-")[2:]
        apart = len(ends) == 2 and ends[0] != ends[1]
        h, s, second = b["h"].to_numpy(np.int64).view(np.uint64), b["s"].to_numpy(), b["second"].to_numpy(bool)
        for r in np.unique(s).tolist():
            first = firsts[r]
            mine = s == r
            words = _rotate(h, np.full(len(h), first))
            a = np.unique(words[mine & ~second])
            c = np.unique(words[mine & second]) if apart else a
            for x, y in tree_join(a, c, order[r], bits, not apart):
                go = x != y
                x, y = x[go], y[go]
                back = np.full(len(x), (64 - first) % 64)
                x, y = _rotate(x, back), _rotate(y, back)
                early = np.zeros(len(x), dtype=bool)
                for q in range(r):
                    turn = np.full(len(x), firsts[q])
                    early |= _meets(_rotate(x, turn), _rotate(y, turn), order[q], bits)
                out_a.append(x[~early])
                out_b.append(y[~early])
        return pd.DataFrame({"ha": np.concatenate(out_a).view(np.int64), "hb": np.concatenate(out_b).view(np.int64)})

    return sent.groupBy("shard").applyInPandas(join, "ha long, hb long")


def picture_rows(media: DataFrame) -> DataFrame:
    """Distinct (file_id, h, r): hash and shape of the rows that take part, cut."""
    usable = media.filter("file_id is not null and width > 0 and height > 0").select(
        "file_id", read_phash(F.col("phash")).alias("h"), (F.greatest("width", "height").cast("double") / F.least("width", "height")).alias("r")
    )
    return cut(usable.filter("h is not null").distinct())


def picture_classes(rows: DataFrame) -> DataFrame:
    """(h, r, files): classes of exact copies by hash and shape, cut. rows: picture_rows()."""
    return cut(rows.groupBy("h", "r").agg(F.count(F.lit(1)).alias("files")))


def class_pairs(classes: DataFrame, bits: int = BITS, shape: float = SHAPE, block: int = BLOCK_ROWS) -> DataFrame:
    """(ha, ra, hb, rb): pairs of different classes whose hashes and shapes are close, in one direction each.

    Close pairs of hashes come from the prefix-tree join; classes of one hash are close if their shapes are. A hash of
    very many shapes is joined in blocks.
    """
    hashes = classes.select("h").distinct()
    several = classes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    far = close_hashes(hashes, bits).unionByName(several.select(F.col("h").alias("ha"), F.col("h").alias("hb")))
    far, (often_a, often_b) = cut_hot(far, [["ha"], ["hb"]], least=block)
    shapes = hot_hashes(classes, ["h"], least=block)
    left = block_join(far, classes.select(F.col("h").alias("ha"), F.col("r").alias("ra")), ["ha"], "hb", "ra", block, sorted({*often_a, *shapes}))
    both = block_join(left, classes.select(F.col("h").alias("hb"), F.col("r").alias("rb")), ["hb"], "ha", "rb", block, sorted({*often_b, *shapes}))
    alike = F.greatest("ra", "rb") / F.least("ra", "rb") <= shape
    return both.filter(alike & ((F.col("ha") != F.col("hb")) | (F.col("ra") < F.col("rb")))).select("ha", "ra", "hb", "rb")


def same_pictures(media: DataFrame, bits: int = BITS, shape: float = SHAPE, salt_rows: int = BLOCK_ROWS) -> DataFrame:
    """(file_id_a, file_id_b), smaller first: files whose hashes and shapes are close, each pair once.

    Pairs of classes are expanded to their files, on both sides in blocks of salt_rows files, so that no task holds
    a class as a whole. Rows with a null file, an unusable hash, or a width or height that is null or not above 0
    take no part; a file with several rows is close by any of them; repeated rows count once; an empty table gives no
    rows; other columns are ignored.
    """
    rows = picture_rows(media)
    classes = picture_classes(rows)
    own = classes.filter("files > 1").select(F.col("h").alias("ha"), F.col("r").alias("ra"), F.col("h").alias("hb"), F.col("r").alias("rb"))
    pairs = class_pairs(classes, bits, shape, salt_rows).unionByName(own)
    several = rows.groupBy("file_id").agg((F.count(F.lit(1)) > 1).alias("several"))  # only such files meet twice
    rows = cut(rows.join(several, "file_id"))
    side = lambda x: rows.select(F.col("h").alias(f"h{x}"), F.col("r").alias(f"r{x}"), F.col("file_id").alias(f"f{x}"), F.col("several").alias(f"s{x}"))
    size = lambda x: classes.select(F.col("h").alias(f"h{x}"), F.col("r").alias(f"r{x}"), F.col("files").alias(f"n{x}"))
    pairs, (often_a, often_b) = cut_hot(pairs, [["ha", "ra"], ["hb", "rb"]])
    sized = cut(skew_join(skew_join(pairs, size("a"), ["ha", "ra"], hot=often_a), size("b"), ["hb", "rb"], hot=often_b))
    small = F.col("na") * F.col("nb") <= CELL
    few = sized.filter(small).drop("na", "nb").join(side("a"), ["ha", "ra"]).join(side("b"), ["hb", "rb"])
    # of larger products each pair of blocks is a key of its own, which both sides are sent to
    k = lambda x: F.ceil(F.col(f"n{x}") / salt_rows).cast("int")
    grid = sized.filter(~small).withColumns({"ka": k("a"), "kb": k("b")})
    grid = grid.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ka") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("kb") - 1))).drop("ka", "kb", "na", "nb")

    def sent(x: str, block: str) -> DataFrame:
        there = side(x).join(sized.filter(~small).select(f"h{x}", f"r{x}").distinct(), [f"h{x}", f"r{x}"], "left_semi")
        placed = skew_join(there, size(x), [f"h{x}", f"r{x}"]).withColumn(block, F.pmod(F.xxhash64(f"f{x}", F.lit(5)), k(x)).cast("int")).drop(f"n{x}")
        return grid.join(placed, [f"h{x}", f"r{x}", block])

    met = few
    if not sized.filter(~small).isEmpty():
        met = few.unionByName(sent("a", "i").join(sent("b", "j"), ["ha", "ra", "hb", "rb", "i", "j"]).drop("i", "j"))
    told = met.filter("fa <> fb").select(F.least("fa", "fb").alias("file_id_a"), F.greatest("fa", "fb").alias("file_id_b"), "sa", "sb", (F.col("ha") == F.col("hb")).alias("e"), (F.col("ra") == F.col("rb")).alias("q"), F.col("fa").alias("first"))
    # within one class a pair comes out in both directions: one of them counts
    told = cut(told.filter("not (e and q) or first = file_id_a").select("file_id_a", "file_id_b", (F.col("sa") | F.col("sb")).alias("twice")))
    return told.filter("not twice").drop("twice").unionByName(told.filter("twice").drop("twice").distinct())


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_pictures(table(spark, sf_dir, "media_metadata"))


def _named(x: str) -> list[Column]:
    """A class's hash and shape as texts and whole numbers: 16 hex digits, and millionths."""
    return [F.lpad(F.lower(F.hex(f"h{x}")), 16, "0").alias(f"phash{x and '_' + x}"), F.floor(F.col(f"r{x}") * 1_000_000).alias(f"shape{x and '_' + x}")]


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file and class of exact copies: file_id, phash, shape, the class's files, and links, the number of
    other classes that it is close to. No pair of files is written, however many files a class has."""
    rows = picture_rows(table(spark, sf_dir, "media_metadata"))
    classes = picture_classes(rows)
    pairs = cut(class_pairs(classes))
    ends = pairs.select(F.col("ha").alias("h"), F.col("ra").alias("r")).unionByName(pairs.select(F.col("hb").alias("h"), F.col("rb").alias("r")))
    told = cut(classes.join(ends.groupBy("h", "r").agg(F.count(F.lit(1)).alias("links")), ["h", "r"], "left").fillna(0, ["links"]))
    return skew_join(rows, told, ["h", "r"]).select("file_id", *_named(""), "files", "links")


def p1_class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of close classes, the smaller (shape, hash) first; with p1_classes they stand for all pairs of files."""
    pairs = class_pairs(picture_classes(picture_rows(table(spark, sf_dir, "media_metadata"))))
    told = pairs.select(F.struct(*_named("a")).alias("x"), F.struct(*_named("b")).alias("y"))
    one = lambda s, x: F.struct(s[f"shape_{x}"].alias("shape"), s[f"phash_{x}"].alias("phash"))
    told = told.select(one(F.col("x"), "a").alias("x"), one(F.col("y"), "b").alias("y"))
    low, high = F.least("x", "y"), F.greatest("x", "y")
    return told.select(low["phash"].alias("phash_a"), low["shape"].alias("shape_a"), high["phash"].alias("phash_b"), high["shape"].alias("shape_b"))


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p1_class_pairs": p1_class_pairs}

_CLASSES = r"""
WITH c AS (SELECT file_id, regexp_replace(lower(regexp_replace(phash, '^\s+|\s+$', '', 'g')), '^0x', '') AS p,
                  greatest(width, height)::DOUBLE / least(width, height) AS r
           FROM media_metadata WHERE width > 0 AND height > 0 AND file_id IS NOT NULL),
h AS (SELECT DISTINCT file_id, r, p, ('0x' || p)::UBIGINT AS v FROM c WHERE regexp_full_match(p, '[0-9a-f]{16}') AND p <> repeat(p[1], 16)),
k AS (SELECT p, v, r, count(*) AS files FROM h GROUP BY p, v, r),
x AS (SELECT a.p AS pa, a.r AS ra, b.p AS pb, b.r AS rb FROM k a JOIN k b ON (a.r, a.p) < (b.r, b.p) AND bit_count(xor(a.v, b.v)) <= 5 AND greatest(a.r, b.r) / least(a.r, b.r) <= 1.02)
"""
SQL = {
    "p1_found": r"""
WITH c AS (SELECT file_id, regexp_replace(lower(regexp_replace(phash, '^\s+|\s+$', '', 'g')), '^0x', '') AS p,
                  greatest(width, height)::DOUBLE / least(width, height) AS r
           FROM media_metadata WHERE width > 0 AND height > 0),
h AS (SELECT DISTINCT file_id, r, ('0x' || p)::UBIGINT AS v FROM c
      WHERE regexp_full_match(p, '[0-9a-f]{16}') AND p <> repeat(p[1], 16))
SELECT DISTINCT x.file_id AS file_id_a, y.file_id AS file_id_b
FROM h x JOIN h y ON x.file_id < y.file_id AND bit_count(xor(x.v, y.v)) <= 5 AND greatest(x.r, y.r) / least(x.r, y.r) <= 1.02""",
    "p1_classes": _CLASSES
    + """, n AS (SELECT p, r, count(*) AS links FROM (SELECT pa AS p, ra AS r FROM x UNION ALL SELECT pb, rb FROM x) GROUP BY p, r)
SELECT file_id, h.p AS phash, floor(h.r * 1000000)::BIGINT AS shape, files, coalesce(links, 0) AS links FROM h JOIN k USING (p, r) LEFT JOIN n USING (p, r)""",
    "p1_class_pairs": _CLASSES
    + """, y AS (SELECT pa, pb, floor(ra * 1000000)::BIGINT AS sa, floor(rb * 1000000)::BIGINT AS sb FROM x)
SELECT CASE WHEN (sa, pa) <= (sb, pb) THEN pa ELSE pb END AS phash_a, least(sa, sb) AS shape_a, CASE WHEN (sa, pa) <= (sb, pb) THEN pb ELSE pa END AS phash_b, greatest(sa, sb) AS shape_b FROM y""",
}
