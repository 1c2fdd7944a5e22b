import datetime

import pytest
from pyspark.sql import functions as F

from catalumen.operators import catalog, links
from catalumen.operators.components import connected_components
from catalumen.plans import destinations
from catalumen.runtime import skew_join

H, K = "a" * 64, "b" * 64
S = "s-" + "c" * 64
RECORD = "record_id long, hash string, sparse_hash string, type string, ext string, orig_name string, orig_path string, size_bytes long, is_seed boolean, name_score int, scanned_at timestamp, capture_datetime string, camera_model string, lens_model string, width int, height int, duration_sec double, phash string"


def record(i, h=None, s=None, score=None, seed=False, kind="jpeg", name=None, camera=None, size=10):
    return (i, h, s, kind, ".jpg", name or f"p{i}.jpg", f"/src/{name or f'p{i}.jpg'}", size, seed, score, datetime.datetime(2020, 1, i), None, camera, None, None, None, None, None)


def test_better_name_wins(spark):
    got = catalog.canonical(spark.createDataFrame([record(1, H, score=5, size=1), record(2, H.upper() + " ", score=10, size=2), record(3, H, score=10)], RECORD)).collect()
    assert [(r.orig_name, r.size_bytes, r.copies, r.first_seq) for r in got] == [("p2.jpg", 1, 3, 1)]


def test_full_hash_comes_later(spark):
    got = catalog.canonical(spark.createDataFrame([record(1, None, S, 1), record(2, H, S, 9), record(3, K, S, None), record(4)], RECORD)).collect()
    assert [(r.hash, r.sparse_hash, r.orig_name) for r in got] == [(H, S, "p2.jpg")]


def test_seed_beats_score_and_last_metadata_wins(spark):
    rows = spark.createDataFrame([record(1, H, score=9, camera="A"), record(2, H, score=1, seed=True, camera="B"), record(3, H, kind="other", camera="C")], RECORD)
    assert catalog.canonical(rows).head().orig_name == "p2.jpg"
    assert catalog.metadata_last(rows).head().camera_model == "B"


def test_empty_and_clashing_columns(spark):
    rows = spark.createDataFrame([], RECORD)
    assert catalog.canonical(rows).count() == 0
    more = spark.createDataFrame([record(1, H)], RECORD).withColumns({"content": F.lit("x"), "copies": F.lit(1), "first_seq": F.lit(2)})
    assert catalog.canonical(more).head().content == H


def test_hashing_plan(spark):
    rows = spark.createDataFrame([record(1, None, S), record(2, None, S), record(3, None, "s-" + "d" * 64), record(4, None, "s-" + "e" * 64)], RECORD)
    known = spark.createDataFrame([("s-" + "d" * 64,)], "sparse_hash string")
    assert {r.record_id: r.needs_full for r in catalog.hashing_plan(rows, known).collect()} == {1: False, 2: True, 3: True, 4: False}


def test_ids_follow_first_sight(spark):
    rows = spark.createDataFrame([(f"c{i}", i) for i in range(100)], "content string, first_seq long")
    have = spark.createDataFrame([("c5", 7)], "content string, id long")
    got = {r.content: r.id for r in catalog.assign_ids(rows, have).collect()}
    assert got["c5"] == 7 and [got[f"c{i}"] for i in range(100) if i != 5] == list(range(8, 107))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (100, 100)] + [(200, 200 + i) for i in range(1, 50)] + [(None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(1, 41)} == {1} and got[102] == 100 and {got[200 + i] for i in range(50)} == {200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_psd_links(spark):
    files = spark.createDataFrame([(1, "jpeg", "img.jpg"), (2, "raw", "IMG.dng"), (3, "raw", "img (1).dng"), (4, "psd", "img_v2.psd"), (5, "psd", "collage.psd"), (6, "psd", None)], "id long, type string, orig_name string")
    refs = spark.createDataFrame([(5, 0, "none.jpg"), (5, 1, "img.jpg"), (4, 0, "img.jpg")], "psd_file_id long, pos int, name string")
    assert {tuple(r) for r in links.psd_links(files, refs).collect()} == {(4, 3, 100, "stem"), (5, 3, 95, "smart_object")}
    assert {tuple(r) for r in links.psd_links(files, refs, "v1").collect()} == {(4, 1, 100, "stem"), (5, 1, 95, "smart_object")}


def test_picture_links_with_raw_hashes(spark):
    rows = spark.createDataFrame([(1, "raw", "a.dng", None, "c", None, 100), (2, "jpeg", "b.jpg", None, "c", "00000000000000ff", 130), (3, "jpeg", "c.jpg", None, "c", "ffffffffffffffff", 90), (4, "jpeg", "d.jpg", None, "c", "00000000000000fe", 131)], "id long, type string, orig_name string, capture_datetime string, camera_model string, phash string, at long")
    raw = spark.createDataFrame([(1, "00000000000000f0")], "raw_file_id long, raw_phash string")
    assert {r.output_file_id for r in links.by_picture(rows).collect()} == {2, 3}
    assert {r.output_file_id for r in links.by_picture(rows, raw).collect()} == {2}


def test_band_join_is_complete(spark):
    a = [(i * 7 % 53, i) for i in range(60)]
    b = [(i * 5 % 47, i) for i in range(60)]
    got = links.band_join(spark.createDataFrame(a, "x long, i long"), spark.createDataFrame(b, "y long, j long"), [], "x", "y", 2).count()
    assert got == sum(abs(x - y) <= 2 for x, _ in a for y, _ in b)


def number(rows, taken=()):
    """Numbering one by one."""
    used = {}
    for f, n in taken:
        used.setdefault(f, set()).add(n)
    out = {}
    for i, f, want in sorted(rows):
        names, got, n = used.setdefault(f, set()), want, 1
        head, dot, tail = want.rpartition(".")
        while got in names:
            got, n = f"{head}_{n}.{tail}", n + 1
        names.add(got)
        out[i] = (f, got)
    return out


def test_numbering_as_one_by_one(spark):
    wants = ["a.jpg", "a_1.jpg", "a_1_1.jpg", "b.jpg", "b_2.jpg", "c.jpg", "a_2.jpg", "A.jpg"]
    rows = [(i, f"/f{i % 3}", wants[(i * i + i // 7) % len(wants)]) for i in range(200)]
    taken = [("/f0", "b_1.jpg"), ("/f1", "c.jpg"), ("/f9", "x.jpg")]
    df, old = spark.createDataFrame(rows, "id long, folder string, want string"), spark.createDataFrame(taken, "folder string, name string")
    assert {r.id: (r.folder, r.name) for r in destinations.number_names(df, old).collect()} == number(rows, taken)
    assert {r.id: (r.folder, r.name) for r in destinations.number_names(df).collect()} == number(rows)


def test_main_and_resized_plan(spark):
    at = datetime.datetime(2021, 1, 1, 12)
    files = spark.createDataFrame([(1, "jpeg", "img.jpg", None), (2, "jpeg", "img (1).jpg", None), (3, "raw", "img.dng", None), (4, "psd", "img.psd", None), (5, "sidecar", "img.xmp", None)], "id long, type string, orig_name string, dest_path string").withColumn("orig_path", F.concat(F.lit("/src/"), "orig_name"))
    caps = spark.createDataFrame([(1, at, 2000, 2000), (2, at, 100, 100), (3, at, None, None), (4, at, None, None)], "id long, at timestamp_ntz, width int, height int")
    psd = links.psd_links(files)
    plan = destinations.plan_destinations(files, caps, "/out", linked_psds=psd)
    got = {r.id: r.dest_path for r in plan.collect()}
    assert got == {1: "/out/output/2021/2021-01/img_2021-01-01_12-00-00.jpg", 2: "/out/output/2021/2021-01/img (1)_resized_100x100_2021-01-01_12-00-00.jpg", 3: "/out/raw/2021/2021-01/img_2021-01-01_12-00-00.dng"}
    side = destinations.sidecar_destinations(links.sidecar_links(files), plan, files).collect()
    assert [tuple(r) for r in side] == [(5, "/out/raw/2021/2021-01/img_2021-01-01_12-00-00.xmp")]
    docs = destinations.psd_destinations(files.filter("type = 'psd'").select("id", "orig_name"), psd, plan).collect()
    assert [tuple(r) for r in docs] == [(4, "/out/output/2021/2021-01/img.psd")]
    again = destinations.plan_destinations(files.drop("dest_path").join(plan, "id", "left"), caps, "/out", linked_psds=psd)
    assert {r.id: r.dest_path for r in again.collect()} == got


def test_plans_have_no_cross_join(spark):
    rows = spark.createDataFrame([(1, "raw", "a.dng", "t", "c", None, 100)], "id long, type string, orig_name string, capture_datetime string, camera_model string, phash string, at long")
    for df in (links.by_picture(rows), links.by_time_and_camera(rows)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_skew_join_as_a_join(spark, how):
    left = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 40)], "k long, v string")
    got, want = skew_join(left, right, ["k"], how), left.join(right, ["k"], how)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert skew_join(left.limit(0), right, ["k"], how).count() == 0
