"""Problem 3: capture times of mixed formats and zones as one UTC instant each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalumen.runtime import blank, bounded_broadcast, cut, small_methods, table

#: 1990-01-01T00:00:00Z.
EARLIEST = 631_152_000

_ZONE = r"(Z|UTC|GMT|[+-]\d{2}(?::?\d{2})?|[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)"
_TIME = r"(\d{1,2}):([0-5]\d)(?::([0-5]\d)(?:[.,]\d+)?)?(?: ?([AaPp])[Mm](?![A-Za-z]))?(?: ?" + _ZONE + ")?"
_OFFSET = r"^[+-]\d{2}(:?\d{2})?$"
_UTC = ("Z", "UTC", "GMT")
#: Syntactic family, pattern, and the groups that hold year, month, day, hour, minute, second, half day, zone, leading zone.
FAMILIES = [
    ("dash", r"^(UTC )?(\d{4})-(\d{2})-(\d{2})[T ]" + _TIME + "$", "$2|$3|$4|$5|$6|$7|$8|$9|$1"),
    ("colon", r"^(UTC )?(\d{4}):(\d{2}):(\d{2})[T ]" + _TIME + "$", "$2|$3|$4|$5|$6|$7|$8|$9|$1"),
    ("compact", r"^(UTC )?(\d{4})(\d{2})(\d{2})[T_ ]?(\d{2})([0-5]\d)([0-5]\d)?(?:[.,]\d+)?(?: ?" + _ZONE + ")?$", "$2|$3|$4|$5|$6|$7||$8|$1"),
    ("dot", r"^(UTC )?(\d{1,2})\.(\d{1,2})\.(\d{4})[T, ]+" + _TIME + "$", "$4|$3|$2|$5|$6|$7|$8|$9|$1"),
    ("slash", r"^(UTC )?(\d{1,2})/(\d{1,2})/(\d{4})[T, ]+" + _TIME + "$", "$4|$2|$3|$5|$6|$7|$8|$9|$1"),
    ("mail", r"^(?:[A-Z][a-z]{2}, )?(\d{1,2}) ([A-Z][a-z]{2}) (\d{4}) " + _TIME + "$", "$3|$2|$1|$4|$5|$6|$7|$8|"),
]
#: Reading formats: those of a family as declared, and the other order of day and month where both are in use.
FORMATS = ["dash", "colon", "compact", "dot", "slash", "mail", "epoch_s", "epoch_ms", "dot_month_first", "slash_day_first"]
#: Weight of a format before anything of a source is known; the declared orders outweigh their opposites.
PRIOR = [1.0] * 8 + [0.05, 0.05]
#: Formats that the project's declared reading allows: dots are day first, slashes month first.
DECLARED = FORMATS[:8]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def zone_ids(spark: SparkSession) -> list[str]:
    return sorted(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())


def utc_text(seconds: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SSZ of epoch seconds, whatever the session's zone."""
    day, rest = F.floor(seconds / 86400), F.pmod(seconds, F.lit(86400))
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60), F.lit("Z"))


def with_root(df: DataFrame, path: str, roots: DataFrame) -> DataFrame:
    """Adds root_id and root_zone of the longest root that contains the path by whole components, null without one.

    One join per depth at which roots exist, deepest first; roots that differ in a trailing slash only count as one,
    of the smallest root_id. A blank path or root matches nothing.
    """
    clean = F.regexp_replace("root_path", "/+$", "")
    known = (
        roots.filter(~blank("root_path"))
        .select(clean.alias("_root"), F.size(F.split(clean, "/")).alias("_depth"), F.struct("root_id", F.col("time_zone").alias("root_zone")).alias("_r"))
        .groupBy("_root", "_depth")
        .agg(F.min("_r").alias("_r"))
    )
    depths = sorted((r[0] for r in known.select("_depth").distinct().collect()), reverse=True)  # no more than components of a path
    out = df.withColumn("_parts", F.split(F.when(~blank(path), F.col(path)), "/"))
    for d in depths:
        at = known.filter(F.col("_depth") == d).select(F.col("_root").alias(f"_a{d}"), F.col("_r").alias(f"_r{d}"))
        whole = F.size("_parts") >= d
        out = out.withColumn(f"_a{d}", F.when(whole, F.array_join(F.slice("_parts", 1, d), "/"))).join(bounded_broadcast(at), f"_a{d}", "left").drop(f"_a{d}")
    best = F.coalesce(*(F.col(f"_r{d}") for d in depths)) if depths else F.lit(None).cast("struct<root_id:int,root_zone:string>")
    return out.withColumn("_best", best).drop("_parts", *(f"_r{d}" for d in depths)).select("*", "_best.root_id", "_best.root_zone").drop("_best")


def _utc_seconds(local: Column, zone: Column) -> Column:
    """Epoch seconds of local seconds in a region or offset zone: an hour that occurs twice means the earlier
    instant, a skipped one moves forward by the gap, as the JVM's zone rules resolve them."""
    digits = F.rpad(F.regexp_replace(zone, ":", ""), 5, "0")
    minutes = F.substring(digits, 2, 2).try_cast("int") * 60 + F.substring(digits, 4, 2).try_cast("int")
    shift = F.when(digits.startswith("-"), -minutes).otherwise(minutes) * 60
    region = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), zone))
    return F.when(zone.rlike(_OFFSET), local - shift).when(zone.isin(*_UTC), local).when(zone.isNotNull(), region)


def candidates(df: DataFrame, text: str, zones: list[str]) -> DataFrame:
    """Adds readings: for each of FORMATS the epoch seconds that it gives for the text, null where it gives none.

    A zone in the text holds; else root_zone (a column of df) does. Zones that the JVM doesn't know count as none.
    """
    t = F.regexp_replace(F.col(text), r"(?U)^\s+|\s+$", "")
    parts = F.when(t.rlike(r"^\d{10}\z"), F.split(F.concat(F.lit("epoch_s|"), t), r"\|")).when(t.rlike(r"^\d{13}\z"), F.split(F.concat(F.lit("epoch_ms|"), t), r"\|"))
    for name, pattern, order in FAMILIES:
        parts = parts.when(t.rlike(pattern), F.split(F.regexp_replace(t, pattern, f"{name}|{order}"), r"\|"))
    out = df.withColumn("_p", parts)
    p = lambda i: F.get("_p", i)
    number = lambda i: F.nullif(p(i), F.lit("")).try_cast("int")
    named = F.array_position(F.array(*map(F.lit, MONTHS)), p(2)).cast("int")
    hour, half = number(4), F.lower(p(7))
    hour24 = F.when(half == "", F.when(hour <= 23, hour)).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    told = F.coalesce(F.nullif(p(8), F.lit("")), F.nullif(F.trim(p(9)), F.lit("")))
    zone = F.coalesce(told, F.col("root_zone"))
    known = zone.isin(*_UTC) | zone.rlike(_OFFSET) | zone.isin(*zones)
    out = out.withColumns({"_family": p(0), "_y": number(1), "_m": F.when(p(0) == "mail", named).otherwise(number(2)), "_d": number(3), "_t": hour24 * 3600 + number(5) * 60 + F.coalesce(number(6), F.lit(0)), "_zone": F.when(known, zone)})

    def seconds(month: str, day: str) -> Column:
        date = F.concat_ws("-", F.lpad(F.col("_y").cast("string"), 4, "0"), F.lpad(F.col(month).cast("string"), 2, "0"), F.lpad(F.col(day).cast("string"), 2, "0")).try_cast("date")
        usable = F.col(month).isNotNull() & F.col(day).isNotNull() & F.col("_y").isNotNull()
        return F.when(usable, F.unix_date(date).cast("long") * 86400 + F.col("_t"))

    out = out.withColumns({"_l": seconds("_m", "_d"), "_x": F.when(F.col("_family").isin("dot", "slash"), seconds("_d", "_m"))})
    epoch = p(1).try_cast("long")
    out = out.withColumns({"_s": _utc_seconds(F.col("_l"), F.col("_zone")), "_w": _utc_seconds(F.col("_x"), F.col("_zone"))})
    late = lambda c: F.when(c >= EARLIEST, c)
    family = F.col("_family")
    each = [late(F.when(family == f, F.col("_s"))) for f in FORMATS[:6]]
    each += [late(F.when(family == "epoch_s", epoch)), late(F.when(family == "epoch_ms", F.floor(epoch / 1000)))]
    each += [late(F.when(family == "dot", F.col("_w"))), late(F.when(family == "slash", F.col("_w")))]
    return out.withColumns({"readings": F.array(*each), "zone_from": F.when(family.startswith("epoch"), "epoch").when(told.isNotNull(), "text").when(F.col("root_zone").isNotNull(), "root")}).drop(*(f"_{c}" for c in ("p", "family", "y", "m", "d", "t", "zone", "l", "x", "s", "w")))


def fit_mixtures(counts: DataFrame, prior: list[float] = PRIOR, rounds: int = 100) -> DataFrame:
    """(source, mask, weights): posterior of each format for a value of that source that the formats in mask can read.

    counts: source, mask (bit k: format k reads it), n. Expectation-maximisation over the source's mixture of formats:
    each value has likelihood under every valid parse, with the prior as pseudo-count. A source's rows are as many
    as its distinct masks, 2 ** len(FORMATS) at most, however many values it has.
    """
    weights = np.asarray(prior)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        n = group["n"].to_numpy(float)
        valid = (group["mask"].to_numpy()[:, None] >> np.arange(len(weights))) & 1
        share = weights / weights.sum()
        for _ in range(rounds):
            odds = valid * share
            post = odds / np.maximum(odds.sum(1, keepdims=True), 1e-300)
            new = (n @ post) + weights
            new /= new.sum()
            if np.abs(new - share).max() < 1e-9:
                break
            share = new
        odds = valid * share
        post = odds / np.maximum(odds.sum(1, keepdims=True), 1e-300)
        return pd.DataFrame({"source": group["source"], "mask": group["mask"], "posterior": list(post)})

    return counts.groupBy("source").applyInPandas(fit, "source long, mask int, posterior array<double>")


def normalise(media: DataFrame, files: DataFrame, roots: DataFrame, text: str = "capture_datetime", keep: tuple[str, ...] = (), formats: list[str] = DECLARED, sure: float = 0.99, prior: list[float] = PRIOR) -> DataFrame:
    """Distinct (file_id, text, keep...) with orig_path, format, posterior, ambiguous, zone_from and seconds.

    A source is a scan root. Of the formats that may be used (`formats`: the declared orders of day and month), the one
    with the highest posterior reads the text. `ambiguous` marks texts that some other format reads as another
    instant with a posterior above 1 - sure: such texts stay open, whatever was chosen.

    Null, blank and unreadable texts, and those without a zone whose file, path or root or the root's zone is missing,
    have null seconds. Repeated rows come out once; empty tables give no rows; other columns are ignored.
    """
    spark = media.sparkSession
    texts = media.select("file_id", F.col(text).alias("text"), *keep).distinct()
    paths = files.select(F.col("id").alias("file_id"), "orig_path")
    rows = with_root(texts.join(paths, "file_id", "left"), "orig_path", roots)
    rows = candidates(rows, "text", zone_ids(spark)).withColumn("source", F.coalesce(F.col("root_id").cast("long"), F.lit(-1)))
    mask = sum((F.get("readings", k).isNotNull().cast("int") * (1 << k) for k in range(len(FORMATS))), F.lit(0))
    with small_methods(spark):
        rows = cut(rows.withColumn("mask", mask.cast("int")).drop("root_id", "root_zone"))
    fitted = fit_mixtures(rows.filter("mask > 0").groupBy("source", "mask").agg(F.count(F.lit(1)).alias("n")), prior)
    # at most (roots + 1) * 2 ** len(FORMATS) rows: broadcast where the roots are few enough for that to be small
    allowed = F.array(*(F.lit(1.0 if f in formats else 0.0) for f in FORMATS))
    usable = F.zip_with("posterior", allowed, lambda x, y: x * y)
    best = F.array_max(usable)
    fitted = cut(fitted.select("source", "mask", "posterior", F.when(best > 0, F.array_position(usable, best)).cast("int").alias("pick")))
    out = rows.join(bounded_broadcast(fitted), ["source", "mask"], "left")
    chosen = F.get("readings", F.col("pick") - 1)
    rival = F.exists(F.arrays_zip("readings", "posterior"), lambda x: (x["posterior"] > 1 - sure) & (x["readings"] != F.get(F.col("readings"), F.col("pick") - 1)))
    return out.select(
        "file_id", "text", *keep, "orig_path",
        F.get(F.array(*map(F.lit, FORMATS)), F.col("pick") - 1).alias("format"),
        F.get("posterior", F.col("pick") - 1).alias("posterior"),
        F.coalesce(rival, F.lit(False)).alias("ambiguous"), "zone_from", chosen.alias("seconds"),
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = normalise(table(spark, sf_dir, "media_metadata"), table(spark, sf_dir, "files"), table(spark, sf_dir, "scan_roots"))
    return read.filter("seconds is not null").select("file_id", utc_text(F.col("seconds")).alias("captured_utc")).distinct()


def swap_orders(media: DataFrame, files: DataFrame, roots: DataFrame, text: str = "capture_datetime") -> DataFrame:
    """media with day and month swapped in all dotted and slashed dates of every second scan root (odd root_id).

    Makes sources of either order whose true instants are known: those of the texts before. Other texts, and those of
    files without a root, stay as they are.
    """
    paths = files.select(F.col("id").alias("file_id"), "orig_path")
    rows = with_root(media.join(paths, "file_id", "left"), "orig_path", roots)
    turned = F.regexp_replace(F.col(text), r"^(\s*(?:UTC )?)(\d{1,2})([./])(\d{1,2})\3(\d{4})", "$1$4$3$2$3$5")
    return rows.withColumn(text, F.when(F.col("root_id") % 2 == 1, turned).otherwise(F.col(text))).select(*media.columns)


def p3_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of p3_found, read from tables in which every second scan root writes its dates in the other order.

    No order is declared here: posteriors alone choose between day first and month first, per source, so that the
    rows are right only where expectation-maximisation found each source's order. Texts of sources whose other texts
    don't tell are read by the first format in order of FORMATS among equals. Nulls and empty tables as in p3_found.
    """
    media, files, roots = (table(spark, sf_dir, t) for t in ("media_metadata", "files", "scan_roots"))
    read = normalise(swap_orders(media, files, roots), files, roots, formats=FORMATS, prior=[1.0] * len(FORMATS))
    return read.filter("seconds is not null").select("file_id", utc_text(F.col("seconds")).alias("captured_utc")).distinct()


def p3_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct text of a file with its reading, the reading's posterior and whether it stays ambiguous."""
    read = normalise(table(spark, sf_dir, "media_metadata"), table(spark, sf_dir, "files"), table(spark, sf_dir, "scan_roots"))
    return read.select("file_id", "text", "format", F.round("posterior", 6).alias("posterior"), "ambiguous", "zone_from", utc_text(F.col("seconds")).alias("captured_utc"))


QUERIES: dict[str, Callable] = {"p3_found": p3_found, "p3_orders": p3_orders, "p3_readings": p3_readings}

READ_SQL = r"""
root_of AS (SELECT f.id, arg_max(coalesce(r.time_zone, ''), length(rtrim(r.root_path, '/'))) AS root_zone
  FROM files f JOIN scan_roots r ON regexp_matches(f.orig_path, '\S') AND regexp_matches(r.root_path, '\S')
    AND (f.orig_path = rtrim(r.root_path, '/') OR starts_with(f.orig_path, rtrim(r.root_path, '/') || '/')) GROUP BY f.id),
texts AS (SELECT m.*, regexp_replace(m.capture_datetime, '^\s+|\s+$', '', 'g') AS t, nullif(r.root_zone, '') AS root_zone
  FROM media_metadata m LEFT JOIN root_of r ON r.id = m.file_id),
told AS (SELECT *, CASE WHEN starts_with(t, 'UTC ') THEN 'UTC' ELSE nullif(regexp_extract(t, '(Z|UTC|GMT|[+-]\d{2}:?\d{2}|[A-Z][A-Za-z]+(?:/[A-Za-z_]+)+)$', 1), '') END AS text_zone,
    regexp_replace(trim(regexp_replace(regexp_replace(t, '^UTC ', ''), ' ?(Z|UTC|GMT|[+-]\d{2}:?\d{2}|[A-Z][A-Za-z]+(?:/[A-Za-z_]+)+)$', '')), '[.,]\d+$', '') AS body FROM texts),
parsed AS (SELECT *, coalesce(text_zone, root_zone) AS zone, try_strptime(body, ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y:%m:%d %H:%M:%S',
    '%Y%m%d_%H%M%S', '%Y%m%dT%H%M%S', '%d.%m.%Y %H:%M:%S', '%m/%d/%Y %I:%M:%S %p', '%a, %d %b %Y %H:%M:%S']) AS tm FROM told),
zoned AS (SELECT *, CASE WHEN regexp_full_match(t, '\d{10}') THEN t::BIGINT WHEN regexp_full_match(t, '\d{13}') THEN t::BIGINT // 1000
    WHEN zone IN ('Z', 'UTC', 'GMT') THEN epoch(tm)::BIGINT
    WHEN regexp_matches(zone, '^[+-]') THEN epoch(tm)::BIGINT - (zone[1] || '1')::INT * (zone[2:3]::INT * 3600 + right(zone, 2)::INT * 60)
    ELSE epoch(timezone(zone, tm))::BIGINT END AS at_,
    tm IS NOT NULL AND zone NOT IN ('Z', 'UTC', 'GMT') AND NOT regexp_matches(zone, '^[+-]') AS by_region FROM parsed),
read AS (SELECT * EXCLUDE (at_), CASE WHEN s >= 631152000 THEN s END AS seconds FROM (SELECT *,
    CASE WHEN by_region AND timezone(zone, make_timestamptz((at_ - 3600) * 1000000)) = tm THEN at_ - 3600 ELSE at_ END AS s FROM zoned))"""
#: ICU reads an hour that occurs twice as the later instant: the earlier one is taken where it shows the same time.
SQL: dict[str, str] = {
    "p3_found": f"WITH {READ_SQL} SELECT DISTINCT file_id, strftime(make_timestamp(seconds * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_utc FROM read WHERE seconds IS NOT NULL",
    # the same instants: the order of each source is recovered
    "p3_orders": f"WITH {READ_SQL} SELECT DISTINCT file_id, strftime(make_timestamp(seconds * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_utc FROM read WHERE seconds IS NOT NULL",
}
