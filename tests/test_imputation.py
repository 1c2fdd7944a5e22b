import random
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from catalumen.operators import imputation as imp
from catalumen.operators import lowrank
from catalumen.operators.timestamps import utc_text

MEDIA = "file_id long, capture_datetime string, camera_model string, lens_model string, width int, height int, duration_sec double, aspect_ratio double, phash string"
FILES = "id long, orig_path string"
ROOTS = "root_id int, root_path string, time_zone string"


def brute(rows, paths):
    """The rule, record by record: rows of (file_id, instant, model)."""
    folders, shots, out = defaultdict(list), {}, set()
    full = []
    for i, t, m in rows:
        p = paths.get(i)
        if not p or not p.strip():
            continue
        folder, _, name = p.rpartition("/")
        stem = name.lower().rsplit(".", 1)[0] if "." in name[1:] else name.lower()
        m = " ".join(m.lower().split()) if m and any(c.isdigit() for c in m) else None
        full.append((i, folder, stem, t, m))
        if m:
            folders[folder].append((m, t))
        if t is not None:
            shots[folder, stem] = min(t, shots.get((folder, stem), t))
    for i, folder, stem, t, m in full:
        have = folders[folder]
        if m is None and have:
            if len({x for x, _ in have}) == 1:
                out.add((i, "camera_model", have[0][0]))
            elif t is not None and (far := [(abs(y - t), x) for x, y in have if y is not None]):
                near = {x for d, x in far if d == min(far)[0]}
                if min(far)[0] <= 600 and len(near) == 1:
                    out.add((i, "camera_model", near.pop()))
        if t is None and (folder, stem) in shots:
            out.add((i, "capture_datetime", shots[folder, stem]))
    return out


def found(spark, rows, paths):
    media = [(i, None if t is None else str(t), m, None, None, None, None, None, None) for i, t, m in rows]
    files = spark.createDataFrame(list(paths.items()), FILES)
    got = imp.fill(imp.cut(imp.cells(spark.createDataFrame(media, MEDIA), files, spark.createDataFrame([], ROOTS)))).filter("choices = 1").select("file_id", "field", "filled").distinct()
    return {tuple(r) for r in got.collect()}


def test_as_record_by_record(spark):
    rng = random.Random(7)
    paths = {i: rng.choice([None, " ", f"/d{rng.randrange(4)}/S{rng.randrange(40)}.{rng.choice(['JPG', 'dng', 'a.b'])}", f"n{i}.jpg", f"/d0/.h{i}"]) for i in range(150)}
    rows = [(rng.randrange(170), rng.choice([None, 1_400_000_000 + rng.randrange(4000)]), rng.choice([None, "unknown", "Cam 1", " cam  1", "Z50", "Z50"])) for _ in range(400)]
    text = {(i, f, spark.range(1).select(utc_text(F.lit(v))).head()[0] if isinstance(v, int) else v) for i, f, v in brute(rows, paths)}
    assert found(spark, rows, paths) == text


def test_ties_must_agree(spark):
    paths = {1: "/d/a.jpg", 2: "/d/b.jpg", 3: "/d/c.jpg", 4: "/e/x.jpg"}
    rows = [(1, 1_400_000_100, "A1"), (2, 1_400_000_300, "B2"), (3, 1_400_000_200, None), (4, None, None)]
    assert found(spark, rows, paths) == set()
    assert (3, "camera_model", "a1") in found(spark, [*rows[:2], (3, 1_400_000_150, None)], paths)


def test_empty(spark):
    assert found(spark, [], {1: "/a/b.jpg"}) == set()


def test_low_rank_recovers_held_out_values(spark):
    rng = np.random.default_rng(3)
    n, kinds = 3000, 6
    kind = rng.integers(0, kinds, n)
    pdf = pd.DataFrame({"a": kind, "b": kind * 10 + rng.integers(0, 3, n), "c": (kind + 1) * 7 % 20, "x": kind * 2.0 + rng.normal(0, 0.1, n)})
    hide = rng.random(n) < 0.2
    seen = pdf.assign(a=pd.array(np.where(hide, None, pdf["a"]), dtype="Int32"), b=pdf["b"].astype("int32"), c=pdf["c"].astype("int32"))
    seen["id"] = range(n)
    df = spark.createDataFrame(seen.astype(object).where(seen.notna(), None), "a int, b int, c int, x double, id long")
    model = lowrank.LowRank(["a", "b", "c"], ["x"]).fit(df)
    options = F.array(*(F.struct(F.lit(str(k)).alias("value"), F.lit(k).alias("bucket")) for k in range(kinds)))
    got = {r.id: int(r.value) for r in model.decode(df.filter("a is null").withColumn("choices", options), "a", ["id"]).collect()}
    right = np.mean([got[i] == kind[i] for i in np.flatnonzero(hide)])
    assert len(got) == hide.sum() and right > 0.95
    back = model.predict(df.withColumn("x", F.lit(None).cast("double")), "x", ["id"]).toPandas().set_index("id")["value"].reindex(range(n))
    assert np.corrcoef(back, pdf["x"])[0, 1] > 0.9


def test_unfilled_cells_are_marked(spark):
    media = spark.createDataFrame([(1, "1400000000", "Cam 1", "50mm", 100, 50, None, None, None), (2, None, None, None, None, None, None, None, None)], MEDIA)
    files = spark.createDataFrame([(1, "/a/x.jpg"), (2, "/b/y.jpg")], FILES)
    got = imp.fill(imp.cut(imp.cells(media, files, spark.createDataFrame([], ROOTS))), whole=True).filter("file_id = 2").collect()
    assert {(r.field, r.source) for r in got} == {("camera_model", "model"), ("aspect_ratio", "model"), ("pixels", "model"), ("duration_sec", "model")}


def test_missing_lenses_are_decoded(spark, tmp_path):
    kinds = [("Cam 1", " 50MM ", 100, 50), ("Cam 2", "85mm", 300, 400)]
    media, files = [], []
    for i in range(60):
        camera, lens, width, height = kinds[i % 2]
        media.append((i, "1400000000", camera, [None, " ", lens, lens, lens][i // 2 % 5], width, height, None, None, None))
        files.append((i, f"/d{i % 2}/x{i}.jpg"))
    for name, shape, data in (("media_metadata", MEDIA, media), ("files", FILES, files), ("scan_roots", ROOTS, [])):
        spark.createDataFrame(data, shape).write.parquet(f"{tmp_path}/{name}.parquet")
    got = [r for r in imp.p6_imputed(spark, str(tmp_path)).collect() if r.field == "lens_model"]
    assert {(r.file_id, r.filled, r.source) for r in got} == {(m[0], ["50mm", "85mm"][m[0] % 2], "model") for m in media if not (m[3] or "").strip()}


def test_more_models_than_buckets_are_all_decoded(spark):
    """Planted: each of 1,500 models has a lens of its own; no model is kept from being a candidate by its bucket."""
    n = 1500
    media = [(i, "1400000000", f"cam {i}", f"{i}mm", 100, 50, None, None, None) for i in range(n)] + [(n + i, None, None, f"{i}mm", 100, 50, None, None, None) for i in range(n)]
    files = [(i, f"/d{i}/x{i}.jpg") for i in range(2 * n)]
    have = imp.cut(imp.features(imp.cells(spark.createDataFrame(media, MEDIA), spark.createDataFrame(files, FILES), spark.createDataFrame([], ROOTS))))
    values = [tuple(r) for r in have.filter("camera is not null").select("camera", "model", "model2").distinct().collect()]
    assert len(values) == n and len({v[1:] for v in values}) > n - 10 > len({v[1] for v in values})
    model = lowrank.LowRank(imp.CATEGORIES, imp.NUMBERS, rounds=1)
    # each model's cell is told apart by the sum of its two buckets: every value wins for a record with its own factors
    model.solve = lambda b: np.array([model.factors[m] + model.factors[imp.CATEGORIES.index("model2") * lowrank.BUCKETS + k] for m, k in zip(b["model"], b["model2"], strict=True)])
    model.factors = np.random.default_rng(5).normal(size=model.factors.shape)
    known = have.filter("camera is not null").select("file_id", "camera", *imp.CATEGORIES, *imp.NUMBERS)
    got = model.decode_among(known, imp.MODEL, values, ["file_id", "camera"]).collect()
    assert len({r.value for r in got}) > 1024 and np.mean([r.value == r.camera for r in got]) > 0.8
    every = imp.decode_in_use(model, have.filter("camera is not null"), have, "camera", imp.MODEL, ["file_id", "camera"]).collect()
    assert sorted((r.file_id, r.value) for r in every) == sorted((r.file_id, r.value) for r in got)


def test_blocks_of_values_as_all_at_once(spark, monkeypatch):
    media = [(i, "1400000000", f"Cam {i % 7}", f"{i % 7}mm", 100 + i % 7, 50, None, None, None) for i in range(70)] + [(100 + i, None, None, f"{i}mm", 100 + i, 50, None, None, None) for i in range(7)]
    files = [(m[0], f"/d{m[0]}/x.jpg") for m in media]
    rows = imp.cut(imp.cells(spark.createDataFrame(media, MEDIA), spark.createDataFrame(files, FILES), spark.createDataFrame([], ROOTS)))
    whole = sorted(map(tuple, imp.fill(rows, whole=True).filter("field = 'camera_model'").collect()))
    monkeypatch.setattr(imp, "VALUES", 2)
    assert sorted(map(tuple, imp.fill(rows, whole=True).filter("field = 'camera_model'").collect())) == whole and len(whole) == 7
    assert {(r[0], r[2]) for r in whole} == {(100 + i, f"cam {i}") for i in range(7)}  # planted: the lens tells the camera


def test_held_out_models_come_back(spark):
    media = [(i, None, f"Cam {i % 5}", f"{i % 5}mm", 100 * (1 + i % 5), 50, None, None, None) for i in range(400)]
    files = [(i, f"/d{i}/x.jpg") for i in range(400)]
    rows = imp.cut(imp.cells(spark.createDataFrame(media, MEDIA), spark.createDataFrame(files, FILES), spark.createDataFrame([], ROOTS)))
    got = {r.source: r for r in imp.held_out(rows).collect()}
    assert set(got) == {"model", "model alone"} and got["model"].cells > 20 and got["model"].accuracy > 0.95


def test_found_cells_come_out_of_the_model(spark, tmp_path, monkeypatch):
    """Both fields of p6_found are decoded by a model that was fitted on all records."""
    media = [(1, "1400000000", "Cam 1", "50mm", 100, 50, None, None, None), (2, None, None, "50mm", 100, 50, None, None, None), (3, None, "Cam 2", None, None, None, None, None, None)]
    for name, shape, data in (("media_metadata", MEDIA, media), ("files", FILES, [(1, "/a/x.jpg"), (2, "/a/x.dng"), (3, "/b/y.jpg")]), ("scan_roots", ROOTS, [])):
        spark.createDataFrame(data, shape).write.parquet(f"{tmp_path}/{name}.parquet")
    fitted, asked, fit, decode = [], {}, lowrank.LowRank.fit, lowrank.LowRank.decode
    monkeypatch.setattr(lowrank.LowRank, "fit", lambda self, records: fitted.append(records.count()) or fit(self, records))

    def seen(self, cells, feature, keep):
        asked[feature] = {r.file_id for r in cells.collect()}
        return decode(self, cells, feature, keep)

    monkeypatch.setattr(lowrank.LowRank, "decode", seen)
    got = {tuple(r) for r in imp.p6_found(spark, str(tmp_path)).collect()}
    assert got == {(2, "camera_model", "cam 1"), (2, "capture_datetime", "2014-05-13T16:53:20Z")}
    assert fitted == [3] and asked == {"model": {2}, "time": {2}}


def test_numbers_are_decoded_among_their_choices(spark):
    """Of six admissible numbers the model takes the one nearest to its prediction, whether it is asked for one or all."""
    rows = [(i, i % 6, (i % 6 + 1) * 7 % 20, None if i % 5 == 0 else i % 6 * 1e6) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a int, b int, x double")
    model = lowrank.LowRank(["a", "b"], ["x"], rounds=2).fit(df)
    cells = df.filter("x is null").withColumn("choices", F.array(*(F.struct(F.lit(str(k)).alias("value"), F.lit(k * 1e6).alias("number")) for k in range(6))))
    told = {r.id: r.value for r in model.predict(cells, "x", ["id"]).collect()}
    got = {r.id: (int(r.value), r.choices) for r in model.decode(cells, "x", ["id"]).collect()}
    assert got == {i: (min(range(6), key=lambda k: abs(k * 1e6 - v)), 6) for i, v in told.items()} and len(got) == 60
    assert len({v for v, _ in got.values()}) > 1


def planted(n: int) -> pd.DataFrame:
    """Records of three categories and two numbers, with unknown cells everywhere and one record that knows none."""
    rng = np.random.default_rng(11)
    df = pd.DataFrame({c: np.where(rng.random(n) < 0.2, np.nan, rng.integers(0, k, n)) for c, k in (("a", 4), ("b", 30), ("c", 9))} | {c: np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n)) for c in ("x", "y")})
    df.iloc[0] = np.nan
    return df


def test_factors_solve_each_records_normal_equations(spark):
    """As one system of all cells by record, values that aren't there included; no record's matrix is built for that."""
    df = planted(300)
    model = lowrank.LowRank(["a", "b", "c"], ["x", "y"])
    model.used[:] = np.arange(model.features) % 3 > 0
    r, size = model.rank, lowrank.BUCKETS
    for i, got in enumerate(model.solve(df)):
        left, right = np.eye(r) * lowrank.RIDGE, np.zeros(r)
        for k, c in enumerate("abc"):
            if not np.isnan(v := df[c][i]):
                x, block = model.factors[k * size + int(v)], slice(k * size, (k + 1) * size)
                rest = model.factors[block][model.used[block]]
                left += lowrank.OTHERS * rest.T @ rest + (1 - lowrank.OTHERS) * np.outer(x, x)
                right += x
        for k, c in enumerate("xy"):
            if not np.isnan(v := df[c][i]):
                y = model.factors[3 * size + k]
                left, right = left + np.outer(y, y), right + v * y
        assert np.allclose(got, np.linalg.solve(left, right), atol=1e-9)


def test_records_cost_far_less_than_a_system_of_the_rank(spark):
    """A round's time by record: less than half of solving one system of the rank for each and building its matrix."""
    import time

    df = planted(20_000)
    model = lowrank.LowRank(["a", "b", "c"], ["x", "y"])

    def least(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    def whole():
        x = model.factors[np.arange(len(df))[:, None] * 7 % 3000 + [1, 2, 3]]
        left = np.broadcast_to(np.eye(model.rank), (len(df), model.rank, model.rank)).copy()
        for k in range(3):
            left += x[:, k, :, None] * x[:, k, None, :]
        np.linalg.solve(left, x.sum(1)[:, :, None])

    assert least(lambda: model.solve(df)) < 0.5 * least(whole)


def test_a_round_is_alternating_least_squares(spark):
    """The features' factors after a round are those of the sums over all records, whatever the partitions."""
    df = planted(200)
    records = spark.createDataFrame(df.astype(object).where(df.notna(), None), "a double, b double, c double, x double, y double").selectExpr("int(a) a", "int(b) b", "int(c) c", "x", "y").repartition(5)
    model, start = lowrank.LowRank(["a", "b", "c"], ["x", "y"], rounds=1).fit(records), lowrank.LowRank(["a", "b", "c"], ["x", "y"])
    start.centre, start.scale = model.centre, model.scale
    u, r, size = start.solve(df), start.rank, lowrank.BUCKETS
    for k, c in enumerate("abc"):
        every = u[df[c].notna()]
        for v in df[c].dropna().unique():
            own = u[df[c] == v]
            left = lowrank.OTHERS * every.T @ every + (1 - lowrank.OTHERS) * own.T @ own + lowrank.RIDGE * np.eye(r)
            assert np.allclose(model.factors[k * size + int(v)], np.linalg.solve(left, own.sum(0)), atol=1e-8)
    for k, c in enumerate("xy"):
        at = df[c].notna()
        value = (df[c][at] - model.centre[k]) / model.scale[k]
        assert np.allclose(model.factors[3 * size + k], np.linalg.solve(u[at].T @ u[at] + lowrank.RIDGE * np.eye(r), value @ u[at]), atol=1e-8)
    assert model.used.sum() == df[["a", "b", "c"]].nunique().sum() + 2
