"""Issues that organizer logs tell of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalumen.functions.constants import LOG_ISSUES
from catalumen.functions.paths import clean_path


def classify(line: Column, issues: dict[str, str] = LOG_ISSUES, path_group: int = 1) -> Column:
    """struct<issue, path> of a log line: the first pattern that it matches, in order; null without one.

    As given, lines about videos match the image pattern first and keep the word video in their path, and a path ends at
    its first colon where the pattern ends in one.
    """
    out = F.when(F.lit(False), F.struct(F.lit("").alias("issue"), F.lit("").alias("path")))
    for issue, pattern in issues.items():
        out = out.when(line.rlike(pattern), F.struct(F.lit(issue).alias("issue"), F.regexp_extract(line, pattern, path_group).alias("path")))
    return out


def issues_by_path(lines: DataFrame, line: str = "value", issues: dict[str, str] = LOG_ISSUES) -> DataFrame:
    """(path, issues): the distinct issues of each path, sorted, joined by semicolons. At most one of each kind is kept
    per path and task before the shuffle."""
    found = lines.select(classify(F.col(line), issues).alias("i")).filter("i is not null").select(clean_path(F.col("i.path")).alias("path"), "i.issue")
    return found.groupBy("path").agg(F.array_join(F.sort_array(F.collect_set("issue")), ";").alias("issues"))


def issue_summary(lines: DataFrame, unknown: DataFrame, line: str = "value", issues: dict[str, str] = LOG_ISSUES) -> DataFrame:
    """(path, in_unknown_files, issues). unknown: path."""
    known = unknown.select(clean_path(F.col("path")).alias("path")).distinct().withColumn("u", F.lit(1))
    return issues_by_path(lines, line, issues).join(known, "path", "left").select("path", F.coalesce("u", F.lit(0)).alias("in_unknown_files"), "issues")
