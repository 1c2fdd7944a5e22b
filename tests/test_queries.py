import importlib
import os

import pytest

import __spark_entry__ as entry
from oracle import compare

FOLDER = "/root/testdata/sf0.001"
MODULES = [importlib.import_module(m) for m in entry.CORE]
NAMES = [(m, q) for m in MODULES for q in m.QUERIES]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize(("module", "name"), NAMES, ids=[q for _, q in NAMES])
def test_query(spark, module, name):
    if name in module.SQL:
        compare(spark, FOLDER, module.QUERIES[name], module.SQL[name])
    else:
        assert module.QUERIES[name](spark, FOLDER).count() >= 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def tables(spark, folder, **rows):
    """Writes tables of (schema, rows) into a folder and gives its name."""
    for name, (shape, data) in rows.items():
        spark.createDataFrame(data, shape).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("hidden", ["s-" + "b" * 64, "zz broken"])
def test_full_hash_beside_other_texts(spark, tmp_path, hidden):
    """A path's valid full hash counts, whatever other texts were recorded for the path."""
    full, path = "a" * 64, "/in/x.jpg"
    seen = "path string, file_id long, is_seed boolean, seen_at string, hash string"
    d = tables(
        spark, tmp_path,
        file_records=("orig_path string, hash string", [(path, full), (path, hidden)]),
        file_occurrences=(seen, [(path, None, False, "2020", full), (path, None, False, "2021", hidden)]),
        files=("id long, hash string, orig_path string, dest_path string", [(7, full, "/lib/x.jpg", "/out/x.jpg")]),
    )
    for name in ("source_report", "source_report_occurrences"):
        rows = entry.queries()[name](spark, d).collect()
        assert [(r.path, r.status, r.note) for r in rows] == [(path, "Duplicate", "Duplicate of ID 7 (content_hash)")]


def test_nested_roots_are_found_by_path(spark, tmp_path):
    roots = [(1, "/r", "UTC"), (2, "/r/in/", "UTC"), (3, "/s", "UTC"), (4, "/r2", "UTC"), (5, "E:/x", "UTC"), (6, "E:/x/y", "UTC"), (7, "/none", None), (9, "/s/", "UTC"), (10, None, "UTC"), (11, "", "UTC")]
    kept = ["/r/a.jpg", "/r/inner/a.jpg", "/s/a.jpg", "/r2/a.jpg", "E:/x/a.jpg", "/q/a.jpg"]
    skipped = ["/r/in/a.jpg", "/r/in", "E:/x/y/a.jpg", "/none/b/a.jpg"]
    d = tables(spark, tmp_path, scan_roots=("root_id int, root_path string, time_zone string", roots), file_occurrences=("path string, file_id long", [(p, 1) for p in kept + skipped]))
    assert sorted(r.path for r in entry.queries()["skip_subtree"](spark, d).collect()) == sorted(kept)


#: Queries over captures in which more outputs than a block has rows share one second.
HOT_BANDS = ["link_priority_merge", "phash_band_link", "phash_band_link_bits"]


@pytest.mark.parametrize("name", HOT_BANDS)
def test_links_of_a_clock_that_was_never_set(spark, tmp_path, name):
    n, at = 2100, "2000:01:01 00:00:00"
    kinds = ["raw" if i <= 3 else "jpeg" for i in range(1, n + 4)]
    files = [(i, k, f"img_{i % 50}.x") for i, k in enumerate(kinds, 1)] + [(n + 10, "tiff", "a_1.tif"), (n + 11, "jpeg", "b.jpg")]
    met = [(i, at, "Orvex Z30", None, 4, 3, f"{1 << i % 40:016x}") for i, _, _ in files[:-2]]
    met += [(n + 10, "2000:01:01 00:00:30", "Orvex Z30", None, 4, 3, "0" * 16), (n + 11, "2000:01:01 00:00:31", "Orvex Z30", None, 4, 3, "0" * 16)]
    d = tables(
        spark, tmp_path,
        files=("id long, type string, orig_name string", files),
        media_metadata=("file_id long, capture_datetime string, camera_model string, lens_model string, width int, height int, phash string", met),
        raw_outputs=("raw_file_id long, output_file_id long", [(1, 4), (1, 5), (2, n + 10)]),
    )
    compare(spark, d, entry.queries()[name], entry.oracle_sql()[name])
