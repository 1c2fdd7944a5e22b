import datetime
import hashlib
import re
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from catalumen.functions import content, paths, tags, times

EDGES = ["/a/b.jpg", "/a/.hidden", "/a/foo.", "/a/x.tar.gz", "/a/._IMG.jpg", "/a/..a.b", "/a b/IMG (1).JPG", "c.txt", "/a/é_ü.CR2", "/a/no_ext"]


def one(spark, expr, value=None):
    return spark.createDataFrame([(value,)], "v string").select(expr).head()[0]


def test_parts_as_pathlib(spark):
    n = paths.file_name(F.col("p"))
    rows = spark.createDataFrame([(p,) for p in EDGES], "p string").select("p", n, paths.stem(n), paths.suffix(n), paths.parent(F.col("p"))).collect()
    for p, name, stem, suffix, parent in rows:
        q = PurePosixPath(p)
        if p == "/a/foo.":  # newer versions of the library tell another suffix
            assert (name, stem, suffix) == ("foo.", "foo.", "")
        else:
            assert (name, stem, suffix) == (q.name, q.stem, q.suffix)
        assert parent == ("" if "/" not in p else str(q.parent))


@pytest.mark.parametrize(("name", "kind", "report"), [("a.cr2", "raw", "raw"), ("a.JPG", "jpeg", "jpeg"), ("a.mp4", "video", "video"), ("a.xyz", "other", "other"), ("._a.jpg", "other", "jpeg"), (None, None, None)])
def test_types(spark, name, kind, report):
    assert one(spark, paths.file_type(F.col("v")), name) == kind
    assert one(spark, paths.file_type(F.col("v"), False), name) == report


@pytest.mark.parametrize(("stem", "v2", "v1"), [("IMG_1234", -4, -4), ("img_copy", 1 - 4 + 2, 3), ("beach at noon", 4, 5), ("a copy", 2 - 4 + 2, 0)])
def test_scores(spark, stem, v2, v1):
    assert one(spark, paths.name_score(F.col("v")), stem) == v2
    assert one(spark, paths.name_score(F.col("v"), "v1"), stem) == v1


@pytest.mark.parametrize(("stem", "v2", "v1"), [("IMG_1 (2)", "img_1", "img_1"), ("a_copy", "a", "a"), ("a_edit", "a_edit", "a"), ("b(copy)", "b", "b"), ("__x-- ", "x", "x")])
def test_stems(spark, stem, v2, v1):
    assert one(spark, paths.normal_stem(F.col("v")), stem) == v2
    assert one(spark, paths.normal_stem(F.col("v"), "v1"), stem) == v1


def test_psd_stems(spark):
    assert one(spark, paths.psd_stem(F.col("v")), "pic_v12") == "pic"
    assert one(spark, paths.psd_stem(F.col("v")), "pic-working") == "pic-working"
    assert one(spark, paths.psd_stem(F.col("v"), "v1"), "pic-working") == "pic"


def test_within_and_clean(spark):
    assert one(spark, paths.within(F.col("v"), F.lit("/a/b/")), "/a/b/c") is True
    assert one(spark, paths.within(F.col("v"), F.lit("/a/b")), "/a/bc") is False
    for dirty, clean in [(' "/a//b/./c/" ', "/a/b/c"), ("", "."), ("/", "/"), ("./a", "a")]:
        assert one(spark, paths.clean_path(F.col("v")), dirty) == clean


def test_outside(spark):
    rows = spark.createDataFrame([("/s/a",), ("/s",), ("/sx/a",), (None,)], "path string")
    skips = spark.createDataFrame([("/s/",), (None,), ("",)], "skip_dir string")
    assert {r[0] for r in paths.outside(rows, skips).collect()} == {"/sx/a", None}


@pytest.mark.parametrize(
    ("path", "day"),
    [("/p/2010-04-20/x", "2010-04-20"), ("/p/2010-02-30/20110102/x", "2011-01-02"), ("/2009/10/x", "2009-10-01"), ("/10/2009/x", "2009-10-01"), ("/2009/13/x", "2009-01-01"), ("/1899/x", None), (None, None)],
)
def test_date_from_path(spark, path, day):
    assert one(spark, times.date_from_path(F.col("v")).cast("string"), path) == day


def test_dates(spark):
    t = datetime.datetime(2020, 1, 2, 3, 4, 5)
    assert one(spark, times.exif_time(F.col("v")), "2020:01:02 03:04:05") == t
    assert one(spark, times.exif_time(F.col("v")), "2020:13:02 03:04:05") is None
    for text in ("2020-01-02T03:04:05", "UTC 2020-01-02 03:04:05", "2020:01:02 03:04:05.99", "20200102T030405Z", "2020-01-02T03:04:05+02:00"):
        assert one(spark, times.flexible_time(F.col("v")), text) == t
    assert one(spark, times.media_time(F.col("v"), "Asia/Tokyo"), "2020-01-01 18:04:05 UTC") == t
    assert one(spark, times.clock_seconds(F.col("v")), "01:02:03.5") == 3723.5
    assert one(spark, times.clock_seconds(F.col("v")), "x") is None


@pytest.mark.parametrize("n", [0, 10, 200, 4096, 8193, 20000])
def test_sparse_fingerprint(spark, n):
    data = bytes(range(256)) * (n // 256) + bytes(n % 256)
    h = hashlib.sha256(str(n).encode() + data[:4096] + (data[n // 2 : n // 2 + 4096] if n > 12288 else b"") + (data[-4096:] if n > 8192 else b""))
    df = spark.createDataFrame([(bytearray(data),)], "b binary")
    assert df.select(content.sparse_fingerprint(F.col("b")), content.full_fingerprint(F.col("b"))).head()[:] == ("s-" + h.hexdigest(), hashlib.sha256(data).hexdigest())


def test_general_track_and_fallback(spark):
    tags_ = {"duration": "5000", "recorded_date": "2020-01-02 03:04:05", "device_model": "TestCam"}
    df = spark.createDataFrame([(tags_, '[{"Duration": 7, "Make": "M", "CreateDate": "2021:01:01 00:00:00"}]'), ({}, '[{"Duration": 7, "Make": "M", "CreateDate": "2021:01:01 00:00:00"}]'), (None, None)], "g map<string,string>, t string")
    got = [r[0] for r in df.select(tags.video_metadata(F.col("g"), tags.tool_tags(F.col("t")))).collect()]
    assert tuple(got[0]) == (datetime.datetime(2020, 1, 2, 3, 4, 5), 5.0, "TestCam")
    assert tuple(got[1]) == (datetime.datetime(2021, 1, 1), 7.0, "M")
    assert tuple(got[2]) == (None, None, None)


def test_diagnose(spark):
    probe = '{"format":{"duration":"3.5"},"streams":[{"codec_type":"audio","tags":{"date":"x"}},{"codec_type":"video","width":640,"height":480,"codec_name":"h264"}]}'
    df = spark.createDataFrame([({"duration": "3500", "performer": "P"}, {"width": "640"}, probe, '[{"Duration":"0:00:04","ImageWidth":1,"ImageHeight":2,"Model":"M"}]')], "g map<string,string>, v map<string,string>, p string, t string")
    rows = df.select(F.inline(tags.diagnose(*map(F.col, "gvpt")))).collect()
    assert [r.tool for r in rows] == ["mediainfo", "ffprobe", "exiftool"]
    assert rows[0][1:] == (None, "3.5", "640", None, None, "P", "")
    assert rows[1][1:] == ("x", "3.5", "640", "480", "h264", None, "")
    assert rows[2][1:] == (None, "4.0", "1", "2", None, "M", "")
    assert one(spark, tags.about_camera(F.col("v")), "Device_Model_X") is True
    assert one(spark, paths.shorten(F.col("v")), "x" * 61) == "x" * 57 + "..."


def test_log_lines(spark):
    from catalumen.operators import logs

    lines = ["EXIF read failed for /images/a.dng: error", "No EXIF tags found for /images/z.jpg", "pHash computation failed for /images/z.jpg: bad", "Using filesystem mtime as capture_datetime for video /v.mp4", "noise", None]
    unknown = spark.createDataFrame([("/images/a.dng",)], "path string")
    got = {tuple(r) for r in logs.issue_summary(spark.createDataFrame([(x,) for x in lines], "value string"), unknown).collect()}
    assert got == {("/images/a.dng", 1, "exif_read_failed"), ("/images/z.jpg", 0, "no_exif_tags;phash_failed"), ("video /v.mp4", 0, "using_filesystem_time_image")}
    assert all(re.compile(p) for p in logs.LOG_ISSUES.values())
