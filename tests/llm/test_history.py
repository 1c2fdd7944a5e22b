"""Batches against a stored history: near-duplicates as by brute force, and runs that go on from what is stored."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalumen.llm import history
from catalumen.llm.chunks import chunk

DOCS = "doc_id long, text string, b int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def edited(rng, text):
    w = text.split(" ")
    kind = rng.randrange(4)
    if kind == 0:
        w[rng.randrange(len(w))] = "changed"
    elif kind == 1:
        w.insert(rng.randrange(len(w)), "inserted words here")
    elif kind == 2:
        half = len(w) // 2
        w = w[half:] + w[:half]
    else:
        del w[len(w) // 3 : len(w) // 3 + 3]
    return " ".join(w)


def library(seed=1):
    """(doc_id, text, batch), and the ids of edited or repeated texts."""
    rng = random.Random(seed)
    rows, copies = [], set()
    for i in range(60):
        rows.append((i, words(rng, 80), 2000))
    for i in range(60, 160):
        if rng.random() < 0.5:
            base = rng.choice(rows[:60])[1]
            rows.append((i, rng.choice([edited(rng, base), base, f"  {base}\r\n"]), rng.choice([2001, 2002])))
            copies.add(i)
        else:
            rows.append((i, words(rng, 80), rng.choice([2001, 2002])))
    return rows, copies


def brute(rows, coverage):
    """doc_id -> whether it is covered, batch after batch, every pair compared."""
    rows = [(i, " ".join(t.split()), b) for i, t, b in rows if t and t.strip() and b is not None]
    bags = {}
    for i, t, _ in rows:
        _, n, h = chunk([t.encode()], **history.TEXT)
        bags[i] = (Counter(), len(t.encode()))
        for x, y in zip(n.tolist(), h.tolist(), strict=True):
            bags[i][0][y] += x
    out, accepted = {}, []
    for b in sorted({r[2] for r in rows}):
        now = [i for i, _, c in rows if c == b]
        for i in now:
            bag, size = bags[i]
            out[i] = any(sum(min(x, bags[j][0].get(c, 0)) for c, x in bag.items()) >= coverage * max(size, bags[j][1]) for j in accepted)
        accepted += [i for i in now if not out[i]]
    return out


def test_near_duplicates_as_by_brute_force(spark):
    rows, copies = library()
    odd = [(200, None, 2001), (201, "", 2001), (202, " \n", 2001), (203, "short", None), (204, "short", 2000), (205, "short", 2002), (206, "short", 2002), (206, "short", 2002)]
    df = spark.createDataFrame(rows + odd, DOCS).withColumns({"id": F.lit(1), "chunk": F.lit("x"), "batch": F.lit(9)})
    got = {r.doc_id: r for r in history.near_documents(df, F.col("b")).collect()}
    want = brute(rows + odd, history.COVERAGE)
    assert {i: r.known_id is not None for i, r in got.items()} == want
    assert {got[i].known_id for i in (205, 206)} == {204} and not {200, 201, 202, 203} & set(got)
    found = {i for i, r in got.items() if r.known_id is not None}
    assert len(found & copies) >= 0.9 * len(copies) and not found - copies - {205, 206}


def test_nothing_and_one_batch(spark):
    assert history.near_documents(spark.createDataFrame([], DOCS), F.col("b")).count() == 0
    one = history.near_documents(spark.createDataFrame([(1, "same text here", 1), (2, "same text here", 1)], DOCS), F.col("b")).collect()
    assert {(r.doc_id, r.known_id) for r in one} == {(1, None), (2, None)}


FILES, RECORDS = "id long, hash string, sparse_hash string, size_bytes long", "record_id long, batch_no int, hash string, sparse_hash string, size_bytes long"


def test_a_second_run_adds_nothing(spark, tmp_path):
    key = "{:064x}".format
    files = spark.createDataFrame([(i, key(i * 7919), None, 1) for i in range(300)], FILES)
    records = spark.createDataFrame([(i, 1 + i % 3, key((i % 400) * 7919), None, 1) for i in range(600)], RECORDS)
    path = f"{tmp_path}/kept"
    first = sorted(map(tuple, history.known_records(files, records, path).collect()))
    h = history.History(spark, path)
    assert h.steps() == ["step=files", "step=records"]
    rows = h.table().count()
    assert sorted(map(tuple, history.known_records(files, records, path).collect())) == first
    assert history.History(spark, path).table().count() == rows and len(first) > 400
    assert sorted(map(tuple, history.known_records(files, records).collect())) == first  # and so without a kept history


def test_a_small_batch_opens_few_parts(spark, tmp_path):
    key = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    h = history.History(spark, f"{tmp_path}/parts", parts=64)
    stored = spark.createDataFrame([(bytearray.fromhex(key(i * 104729 + 1)), 0) for i in range(3000)], "content binary, batch int")
    h.append(stored)
    batch = history.chunk_rows(stored.filter("batch = 0").limit(2).unionByName(spark.createDataFrame([(bytearray(b"unknown content!"), 1)], "content binary, batch int")), **history.FINGERPRINT)
    parts = {r[0] for r in batch.select(h.part(F.col("chunk"))).distinct().collect()}
    read = h.table(sorted(parts)).count()
    assert len(parts) < 16 and 0 < read < 0.3 * h.table().count()
    found = h.absorb(batch)
    assert found.count() == 2 and len(h.steps()) == 2 and h.table(steps=h.steps()[1:]).select("id").distinct().count() == 1
    scan, _ = h._met(batch, None)
    assert scan.select("known").distinct().count() >= 2


def test_an_incomplete_step_does_not_count(spark, tmp_path):
    h = history.History(spark, f"{tmp_path}/broken")
    df = spark.createDataFrame([(bytearray(b"0123456789abcdef" * 2), 0)], "content binary, batch int")
    h.append(df, "a")
    (tmp_path / "broken" / "step=a" / "_SUCCESS").unlink()
    assert h.steps() == [] and h.match(df).count() == 0
    h.append(df, "a")
    assert h.match(df).count() == 1
    with pytest.raises(ValueError, match="other chunk sizes"):
        history.History(spark, f"{tmp_path}/broken", least=4, bits=2, most=8)
