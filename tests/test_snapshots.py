"""The snapshot catalogue: writers that meet, what a write costs, and merges that lose nothing."""

import datetime

import pytest

from catalumen.operators import pipeline
from catalumen.sources.snapshots import Catalog, Conflict

H, K, S = "a" * 64, "b" * 64, "s-" + "c" * 64
AT = datetime.datetime(2020, 1, 1)
FILES = "id long, hash string, sparse_hash string, type string, ext string, orig_name string, orig_path string, dest_path string, size_bytes long, is_seed boolean, name_score int, first_seen_at timestamp, last_seen_at timestamp"
SCAN = "seq long, hash string, sparse_hash string, hash_is_sparse boolean, type string, ext string, orig_name string, orig_path string, size_bytes long, is_seed boolean, name_score int, mtime double, capture_datetime timestamp_ntz, camera_model string, lens_model string, width int, height int, duration_sec double, phash string"


def file_row(i, h=None, s=None):
    return (i, h, s, "jpeg", ".jpg", f"f{i}.jpg", f"/old/f{i}.jpg", f"/out/f{i}.jpg", 1, False, 0, AT, AT)


def scan_row(i, h=None, s=None):
    return (i, h, s, h is None, "jpeg", ".jpg", f"n{i}.jpg", f"/new/n{i}.jpg", 1, False, 0, 1.5e9, AT, f"cam {i}", None, None, None, None, None)


def test_the_second_of_two_writers_fails(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([file_row(i, f"{i:064x}") for i in ids], FILES)
    a, b = Catalog(spark, f"{tmp_path}/c"), Catalog(spark, f"{tmp_path}/c")
    assert a.write({"files": rows(1)}) == 1
    seen = b.version()
    assert a.write({"files": rows(1, 2)}, base=a.version()) == 2
    with pytest.raises(Conflict):
        b.write({"files": rows(1, 3)}, base=seen)
    assert b.version() == 2 and {r.id for r in b.table("files").collect()} == {1, 2}
    assert {r.id for r in b.table("files", 1).collect()} == {1}  # readers of the old snapshot still have it


def test_a_dead_writers_pointer_is_passed_over(spark, tmp_path):
    cat = Catalog(spark, f"{tmp_path}/c")
    cat.write({"files": spark.createDataFrame([file_row(1, H)], FILES)})
    (tmp_path / "c/pointers/00000002").touch()
    assert cat.version() == 1 and cat.table("files").count() == 1
    assert cat.write({"files": spark.createDataFrame([file_row(2, K)], FILES)}) == 3 and cat.table("files").head().id == 2


def test_unchanged_tables_are_not_copied(spark, tmp_path):
    cat = Catalog(spark, f"{tmp_path}/c")
    links = spark.createDataFrame([(1, 2)], "raw_file_id long, sidecar_file_id long")
    cat.write({"files": spark.createDataFrame([file_row(1, H)], FILES), "raw_sidecars": links})
    first = cat.manifest()
    cat.write({}, {"raw_sidecars": spark.createDataFrame([(3, 4)], links.schema)})
    assert cat.manifest()["files"] == first["files"] and cat.manifest()["raw_sidecars"][:1] == first["raw_sidecars"]
    assert {tuple(r) for r in cat.table("raw_sidecars").collect()} == {(1, 2), (3, 4)}


def test_a_merge_after_another_writer(spark, tmp_path, monkeypatch):
    cat, other = Catalog(spark, f"{tmp_path}/c"), Catalog(spark, f"{tmp_path}/c")
    pipeline.ingest(cat, spark.createDataFrame([scan_row(1, H)], SCAN))
    merge = pipeline._merge

    def between(c, base, scan, dialect):
        monkeypatch.setattr(pipeline, "_merge", merge)
        out = merge(c, base, scan, dialect)
        pipeline.ingest(other, spark.createDataFrame([scan_row(2, K)], SCAN))  # comes first
        return out

    monkeypatch.setattr(pipeline, "_merge", between)
    pipeline.ingest(cat, spark.createDataFrame([scan_row(3, "d" * 64)], SCAN))
    assert {r.hash for r in cat.table("files").collect()} == {H, K, "d" * 64} and cat.version() == 3


@pytest.mark.parametrize("dialect", ["v1", "v2"])
def test_rows_without_fingerprint_stay_and_ids_are_remapped(spark, tmp_path, dialect):
    cat = Catalog(spark, f"{tmp_path}/c")
    media = "file_id long, capture_datetime string, camera_model string, lens_model string, width int, height int, duration_sec double, phash string, aspect_ratio double"
    seen = "path string, file_id long, is_seed boolean, seen_at timestamp, mtime double, size_bytes long, hash string, hash_is_sparse boolean"
    cat.write(
        {
            # 5 and 7 are one content by their sparse hash; 9 has no readable fingerprint
            "files": spark.createDataFrame([file_row(5, None, S), file_row(7, H, S), file_row(9, "broken")], FILES),
            "media_metadata": spark.createDataFrame([(i, "t", f"cam {i}", None, None, None, None, None, None) for i in (7, 9)], media),
            "file_occurrences": spark.createDataFrame([(f"/old/f{i}.jpg", i, False, AT, 1.0, 1, "x", False) for i in (5, 7, 9)], seen),
            "raw_sidecars": spark.createDataFrame([(7, 9), (5, 9)], "raw_file_id long, sidecar_file_id long"),
            "psd_source_links": spark.createDataFrame([(9, 7, 100, "stem")], "psd_file_id long, source_file_id long, confidence int, link_method string"),
        }
    )
    pipeline.ingest(cat, spark.createDataFrame([scan_row(1, K), scan_row(2, H, S)], SCAN), dialect)
    files = {r.id: r for r in cat.table("files").collect()}
    assert set(files) == {5, 9, 10} and files[9].hash == "broken" and files[9].dest_path == "/out/f9.jpg"
    assert files[5].hash == H and files[10].hash == K
    assert {r.file_id: r.camera_model for r in cat.table("media_metadata").collect()} == {5: "cam 2", 9: "cam 9", 10: "cam 1"}
    assert {r.path: r.file_id for r in cat.table("file_occurrences").collect()} == {"/old/f5.jpg": 5, "/old/f7.jpg": 5, "/old/f9.jpg": 9, "/new/n1.jpg": 10, "/new/n2.jpg": 5}
    assert [tuple(r) for r in cat.table("raw_sidecars").collect()] == [(5, 9)] and cat.table("psd_source_links").head().source_file_id == 5
    pipeline.ingest(cat, spark.createDataFrame([scan_row(1, K)], SCAN), dialect)
    assert {r.id for r in cat.table("files").collect()} == {5, 9, 10}
    assert cat.table("file_occurrences").count() == (5 if dialect == "v2" else 6)
