"""Fingerprints of content that is a binary column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalumen.functions.constants import SPARSE_BLOCK


def full_fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def sparse_fingerprint(content: Column, block: int = SPARSE_BLOCK) -> Column:
    """s- and the SHA-256 of the size in ASCII, the first block, for more than three blocks the one from the middle on,
    and for more than two blocks the last one."""
    size = F.octet_length(content)
    none = F.lit(b"")
    middle = F.when(size > 3 * block, F.substring(content, F.floor(size / 2).cast("int") + 1, F.lit(block))).otherwise(none)
    last = F.when(size > 2 * block, F.substring(content, F.lit(-block), F.lit(block))).otherwise(none)
    return F.concat(F.lit("s-"), F.sha2(F.concat(size.cast("string").cast("binary"), F.substring(content, F.lit(1), F.lit(block)), middle, last), 256))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit values."""
    return F.bit_count(a.bitwiseXOR(b))


def picture_value(text: Column) -> Column:
    """The 64-bit value of a picture hash of 16 hex digits, whatever its outer blanks, case and leading 0x; else null."""
    c = F.regexp_replace(F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")), "^0x", "")
    return F.when(c.rlike(r"^[0-9a-f]{16}\z"), F.conv(c, 16, -10).cast("long"))
