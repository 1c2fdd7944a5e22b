"""Date and duration expressions over the texts that tags, logs and paths hold. Unreadable texts give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ntz(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def exif_time(text: Column) -> Column:
    """YYYY:MM:DD HH:MM:SS as a local time."""
    strict = text.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}\z")
    return F.when(strict, _ntz(F.regexp_replace(text, r"^(\d{4}):(\d{2}):", "$1-$2-")))


def flexible_time(text: Column) -> Column:
    """An ISO or colon date with or without UTC, fraction and offset, as a local time: offsets are dropped, as capture
    times are kept without zone."""
    t = F.trim(F.regexp_replace(text, "UTC", ""))
    tail = r"(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\z"
    iso = r"^(\d{4})[-:](\d{2})[-:](\d{2})[T ](\d{2}:\d{2}:\d{2})" + tail
    compact = r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})" + tail
    same = t.rlike(r"^\d{4}-\d{2}-\d{2}|^\d{4}:\d{2}:\d{2}")
    return F.coalesce(
        F.when(t.rlike(iso) & same, _ntz(F.regexp_replace(t, iso, "$1-$2-$3 $4"))),
        F.when(t.rlike(compact), _ntz(F.regexp_replace(t, compact, "$1-$2-$3 $4:$5:$6"))),
    )


def media_time(text: Column, zone: str, local: bool = False) -> Column:
    """A container's date: UTC unless `local`, as local time of the given zone."""
    t = flexible_time(text)
    return t if local else F.convert_timezone(F.lit("UTC"), F.lit(zone), t)


def local_seconds(t: Column) -> Column:
    """Seconds of a local time since 1970 on its own clock."""
    day = F.unix_date(t.cast("date")).cast("long")
    return day * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def date_from_path(path: Column) -> Column:
    """The date that a directory tree tells: a full date, a compact one, a year with a month beside it, a year.

    Components are taken in order in each of the four passes; impossible dates are passed over. 1900 to 2099.
    """
    parts = F.split(path, "/")
    # the shapes of dates in paths, here and below: fixed values
    year, month = r"^(19|20)\d{2}\z", r"^(0[1-9]|1[0-2])\z"

    def first(dates: Column) -> Column:
        return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))

    def date(y: Column, m: Column, d: Column) -> Column:
        return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")

    full, compact = r"^((?:19|20)\d{2})[-_](\d{1,2})[-_](\d{1,2})\z", r"^((?:19|20)\d{2})(\d{2})(\d{2})\z"
    def told(pattern: str) -> Column:
        g = lambda p, i: F.regexp_extract(p, pattern, i)
        return first(F.transform(parts, lambda p: F.when(p.rlike(pattern), date(g(p, 1), g(p, 2), g(p, 3)))))

    passes = [told(full), told(compact)]

    def beside(p: Column, i: Column) -> Column:
        after, before = F.get(parts, i + 1), F.get(parts, i - 1)
        one = F.lit("01")
        return F.when(p.rlike(year), F.when(after.rlike(month), date(p, after, one)).when(before.rlike(month), date(p, before, one)))

    passes.append(first(F.transform(parts, beside)))
    passes.append(first(F.transform(parts, lambda p: F.when(p.rlike(year), date(p, F.lit("01"), F.lit("01"))))))
    return F.coalesce(*passes)


def clock_seconds(text: Column) -> Column:
    """Seconds of H:MM:SS, with or without a fraction, or of a plain number."""
    clock = text.rlike(r"^\d+:\d{1,2}:\d{1,2}(\.\d+)?\z")
    p = F.split(text, ":")
    return F.when(clock, F.get(p, F.lit(0)).try_cast("double") * 3600 + F.get(p, F.lit(1)).try_cast("double") * 60 + F.get(p, F.lit(2)).try_cast("double")).otherwise(text.try_cast("double"))


def stamp(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd_HH-mm-ss")


def iso(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
