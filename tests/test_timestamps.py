import datetime as dt
import zoneinfo

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalumen.operators import timestamps as ts

UTC = dt.UTC
MEDIA, FILES, ROOTS = "file_id long, capture_datetime string", "id long, orig_path string", "root_id int, root_path string, time_zone string"


def read(spark, texts, zone="Europe/Berlin", **more):
    media = spark.createDataFrame(list(enumerate(texts)), MEDIA)
    files = spark.createDataFrame([(i, "/r/x.jpg") for i in range(len(texts))], FILES)
    roots = spark.createDataFrame([(1, "/r/", zone)], ROOTS)
    return {r.file_id: r for r in ts.normalise(media, files, roots, **more).withColumn("utc", ts.utc_text(F.col("seconds"))).collect()}


CASES = {
    "2020-06-01T12:00:00": "2020-06-01T10:00:00Z",
    " 2020:06:01 12:00:00.75\n": "2020-06-01T10:00:00Z",
    "20200601_120000": "2020-06-01T10:00:00Z",
    "20200601T120000Z": "2020-06-01T12:00:00Z",
    "2020-06-01 12:00": "2020-06-01T10:00:00Z",
    "01.06.2020 12:00:00": "2020-06-01T10:00:00Z",
    "06/01/2020 1:00:00 PM": "2020-06-01T11:00:00Z",
    "06/01/2020 12:00:00 AM": "2020-05-31T22:00:00Z",
    "Mon, 01 Jun 2020 12:00:00 -0330": "2020-06-01T15:30:00Z",
    "2020-06-01T12:00:00.5+09:00": "2020-06-01T03:00:00Z",
    "UTC 2020-06-01 12:00:00": "2020-06-01T12:00:00Z",
    "2020-06-01 12:00:00 America/New_York": "2020-06-01T16:00:00Z",
    "1591012800": "2020-06-01T12:00:00Z",
    "1591012800999": "2020-06-01T12:00:00Z",
    "2019-10-27 02:30:00": "2019-10-27T00:30:00Z",  # occurs twice: the earlier
    "2020-03-29 02:30:00": "2020-03-29T01:30:00Z",  # skipped: forward by the gap
    "2020-02-30 12:00:00": None,
    "13/06/2020 1:00:00 PM": None,
    "2020-06-01": None,
    "1989-12-31T23:59:59Z": None,
    "2020-06-01 24:00:00": None,
    "2020-06-01 12:00:00 Nowhere/Land": None,
    "unknown": None,
    "": None,
    None: None,
    "x" * 100_000: None,
}


def test_formats(spark):
    got = read(spark, list(CASES))
    assert {t: got[i].utc for i, t in enumerate(CASES)} == CASES


def test_roots(spark):
    files = spark.createDataFrame([(1, "/a/b/c.jpg"), (2, "/a/bc/d.jpg"), (3, "/a"), (4, " "), (5, None), (6, "/z/q.jpg"), (7, "/a/n/x.jpg")], FILES)
    roots = spark.createDataFrame([(1, "/a", "Asia/Tokyo"), (2, "/a/b/", "UTC"), (3, "/a/n", None), (4, None, "UTC"), (5, " ", "UTC")], ROOTS)
    got = {r.id: (r.root_id, r.root_zone) for r in ts.with_root(files, "orig_path", roots).collect()}
    assert got == {1: (2, "UTC"), 2: (1, "Asia/Tokyo"), 3: (1, "Asia/Tokyo"), 4: (None, None), 5: (None, None), 6: (None, None), 7: (3, None)}


def test_ambiguity_follows_the_source(spark):
    clear = [f"{d}.03.2020 10:00:00" for d in range(13, 29)]
    got = read(spark, [*clear, "05.03.2020 10:00:00", "05.05.2020 10:00:00"])
    assert not got[16].ambiguous and got[16].utc == "2020-03-05T09:00:00Z"  # the source is day first
    lone = read(spark, ["05.03.2020 10:00:00", "05.05.2020 10:00:00"])
    assert lone[0].ambiguous and not lone[1].ambiguous
    other = [f"03.{d}.2020 10:00:00" for d in range(13, 29)]
    told = read(spark, [*other, "05.03.2020 10:00:00"], formats=ts.FORMATS)
    assert told[16].format == "dot_month_first" and told[16].utc == "2020-05-03T08:00:00Z"


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.datetimes(dt.datetime(1995, 1, 1), dt.datetime(2035, 1, 1)), st.sampled_from(["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "Pacific/Auckland"])), min_size=1, max_size=60))
def test_zones_as_zoneinfo(spark, values):
    texts = [f"{t:%Y-%m-%d %H:%M:%S} {z}" for t, z in values]
    got = read(spark, texts)
    for i, (t, z) in enumerate(values):
        assert got[i].seconds == int(t.replace(microsecond=0, tzinfo=zoneinfo.ZoneInfo(z)).astimezone(UTC).timestamp())


def test_empty_tables_and_extra_columns(spark):
    media = spark.createDataFrame([(1, "2020-06-01 12:00:00Z", "x", 1)], MEDIA + ", seconds string, mask int")
    empty = spark.createDataFrame([], FILES)
    roots = spark.createDataFrame([], ROOTS)
    assert ts.normalise(media, empty, roots).head().seconds == 1591012800
    assert ts.normalise(media.limit(0), empty, roots).count() == 0
