"""Reading of content fingerprints that machines spell differently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spaces, tabs and line ends.
OUTER = " \t\r\n"


def _clean(column: Column) -> Column:
    return F.lower(F.btrim(column, F.lit(OUTER)))


def full_hash(column: Column) -> Column:
    """The lower-case full hash: 64 hex digits; null for anything else."""
    c = _clean(column)
    return F.when(c.rlike(r"^[0-9a-f]{64}\z"), c)


def sparse_hash(column: Column) -> Column:
    """The lower-case sparse hash: s- and 64 hex digits; null for anything else."""
    c = _clean(column)
    return F.when(c.rlike(r"^s-[0-9a-f]{64}\z"), c)


def counts(size_bytes: Column) -> Column:
    """Empty files (size 0) don't take part in comparisons of content; files of unknown size do."""
    return F.coalesce(size_bytes != 0, F.lit(True))
