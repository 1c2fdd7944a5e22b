import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalumen.llm import chunks, history, pictures, seen, survivors

MEDIA = "file_id long, width int, height int, phash string"
U = np.uint64


# problem 1


def brute_pairs(rows):
    usable = {(i, int(h, 16), max(w, q) / min(w, q)) for i, w, q, p in rows if i is not None and w and q and w > 0 and q > 0 and p for h in [p.strip().lower().removeprefix("0x")] if len(h) == 16 and len(set(h)) > 1 and all(c in "0123456789abcdef" for c in h)}
    return {(a, b) for a, x, r in usable for b, y, s in usable if a < b and (x ^ y).bit_count() <= 5 and max(r, s) / min(r, s) <= 1.02}


def picture_rows(n, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(8)]
    out = []
    for i in range(n):
        h = rng.choice(base)
        for _ in range(rng.randrange(8)):
            h ^= 1 << rng.randrange(64)
        text = rng.choice(["{:016x}", " {:016X}\t", "0x{:016x}", "0X{:016X}"]).format(h)
        out.append((rng.randrange(n), rng.choice([4000, 4000, 3000, None, 0, 4040]), rng.choice([3000, 4000, 3000, -1]), rng.choice([text] * 9 + [None, "0" * 16, "zz", ""])))
    return out + out[:5] + [(None, 1, 1, "0123456789abcdef")]


@pytest.mark.parametrize("seed", [1, 2])
def test_pictures_as_brute_force(spark, seed):
    rows = picture_rows(250, seed)
    got = pictures.same_pictures(spark.createDataFrame(rows, MEDIA), salt_rows=3)
    assert {tuple(r) for r in got.collect()} == brute_pairs(rows)


def test_close_hashes_in_blocks(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(120)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "h long")
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 5}
    for rows in (7, 10_000):  # trees cut into many blocks, and whole ones
        got = pictures.close_hashes(df, tree_rows=rows).collect()
        assert len(got) == len(want) and {frozenset(r) for r in got} == want


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40), st.integers(1, 7))
def test_some_rotation_meets_the_bounds(values, bits):
    widths = [w for _, w in pictures.segments(bits)]
    assert sum(widths) == 64
    for a in values[:6]:
        for b in [v ^ a for v in values] + values:
            if (a ^ b).bit_count() <= bits:
                ok = False
                for s, (first, _) in enumerate(pictures.segments(bits)):
                    x, y = (pictures._rotate(np.array([v], dtype=U), np.array([first])) for v in (a, b))
                    ok |= bool(pictures._meets(x, y, widths[s:] + widths[:s], bits)[0])
                assert ok


def test_pictures_of_nothing(spark):
    empty = spark.createDataFrame([], MEDIA)
    assert pictures.same_pictures(empty).count() == 0
    one = spark.createDataFrame([(1, 10, 10, "0123456789abcdef"), (1, 10, 10, "0123456789abcdee")], MEDIA).withColumns({"h": F.lit(1), "r": F.lit("x"), "ha": F.lit(2)})
    assert pictures.same_pictures(one).count() == 0


# problem 2

FILES = "id long, hash string, sparse_hash string, size_bytes long, is_seed boolean, name_score int, orig_path string, orig_name string, first_seen_at timestamp"


def file_row(i, h=None, s=None, size=1, seed=None, score=None, path="/p", name="n"):
    return (i, h and h * 64, s and "s-" + s * 64, size, seed, score, path, name, None)


def test_groups_and_survivors(spark):
    rows = [
        file_row(1, "a"), file_row(2, "A", seed=True), file_row(3, "a", seed=True, score=5), file_row(4, "a", seed=True, score=9, name=" "),
        file_row(10, "b", "1"), file_row(11, None, "1"), file_row(12, "c", "1", score=1),  # joined through 11
        file_row(20, "d", "2"), file_row(21, "e", "2"),  # equal sparse hashes, but both have full ones
        file_row(30, "f", size=0), file_row(31, "f", size=None), file_row(32, "f"),
        file_row(40), file_row(41, "g"), (42, "g" * 63, None, 1, None, None, "/p", "n", None),
    ]
    got = {tuple(r) for r in survivors.survivors(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {(1, 3), (10, 12), (31, 31)}
    golden = {r.first_id: r for r in survivors.golden_records(spark.createDataFrame(rows, FILES)).collect()}
    assert golden[1].copies == 4 and golden[1].name_score == 5 and golden[10].is_seed is None


def test_long_chain_and_hot_group(spark):
    letters = "0123456789abcdef"
    key = lambda n: letters[n % 16] * 32 + f"{n:032x}"
    rows = []
    for n in range(60):  # full n, sparse n and n + 1, with rows that have a sparse hash only
        rows += [(3 * n + 1, key(n), "s-" + key(n), 1, None, None, "/p", "n", None), (3 * n + 2, key(n), "s-" + key(n + 1), 1, None, None, "/p", "n", None), (3 * n + 3, None, "s-" + key(n), 1, None, None, "/p", "n", None)]
    rows += [(1000 + i, "f" * 64, None, 1, None, i, "/p", "n", None) for i in range(500)]
    got = {tuple(r) for r in survivors.survivors(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {(1, 1), (1000, 1499)}


def test_survivors_of_nothing(spark):
    assert survivors.survivors(spark.createDataFrame([], FILES)).count() == 0


def test_group_limit_comes_before_the_shuffle(spark):
    df = spark.createDataFrame([file_row(i, "a") for i in range(9)], FILES)
    plan = survivors.survivors(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


# problem 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=120), max_size=30), st.randoms())
def test_chunks_depend_on_content_only(texts, rng):
    texts = [*texts, b"", b"a" * 300]
    order = list(range(len(texts)))
    rng.shuffle(order)

    def of(ts):
        out = [[] for _ in ts]
        for r, n, h in zip(*chunks.chunk(ts, 8, 2, 16), strict=True):
            out[r].append((int(n), int(h)))
        return out

    a, b = of(texts), of([texts[i] for i in order])
    assert [a[i] for i in order] == b
    assert all(sum(n for n, _ in c) == len(t) for c, t in zip(a, texts, strict=True))
    assert all(8 <= n < 16 + 8 for c, t in zip(a, texts, strict=True) if len(t) >= 8 for n, _ in c)


def test_an_insertion_changes_few_chunks():
    rng = np.random.default_rng(1)
    a = bytes(rng.integers(0, 256, 20_000, dtype=np.uint8))
    b = a[:7000] + b"something new" + a[7000:]
    x, y = ({(int(n), int(h)) for _, n, h in zip(*chunks.chunk([t], 64, 7, 1024), strict=True)} for t in (a, b))
    assert sum(n for n, _ in x & y) > 0.8 * len(a)


RECORDS = "record_id long, batch_no int, hash string, sparse_hash string, size_bytes long"


def record(i, batch, h=None, s=None, size=1):
    return (i, batch, h and h * 64, s and "s-" + s * 64, size)


def test_known_records(spark):
    files = spark.createDataFrame([(1, "a" * 64, "s-" + "1" * 64, 5), (2, " " + "B" * 64 + "\n", None, 0), (3, "c" * 64, None, None)], "id long, hash string, sparse_hash string, size_bytes long")
    rows = [
        record(1, 1, "a"), record(2, 1, "b"), record(3, 1, "c", size=None), record(4, 1, "d"), record(5, 1, "d"), record(6, 2, "d", "1"),
        record(7, 2, "e", "1"), record(8, 2, "a", size=0), record(9, 3, None, None), record(10, None, "a"), record(11, 2, "b"), record(12, 3, "e"),
    ]
    got = {tuple(r) for r in history.known_records(files, spark.createDataFrame(rows, RECORDS)).collect()}
    assert got == {(1, "full"), (3, "full"), (6, "full"), (7, "sparse"), (11, "full"), (12, "full")}
    assert history.known_records(files.limit(0), spark.createDataFrame([], RECORDS)).count() == 0


def test_batch_by_batch_as_in_one_go(spark):
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(0, 256, 600, dtype=np.uint8)) for _ in range(40)]
    batches = [[texts[i] for i in rng.integers(0, 40, 15)] for _ in range(3)]
    near = texts[0][:300] + b"!" + texts[0][300:]
    h = history.History(spark, coverage=0.7, least=16, bits=4, most=128)
    frame = lambda ts, b: spark.createDataFrame([(bytearray(t), b) for t in sorted(set(ts))], "content binary, batch int")
    h.append(frame(texts[:1], 0))
    found, accepted = [], {texts[0]}
    for b, batch in enumerate(batches, 1):
        new = frame([*batch, near], b)
        ids = {r.id: bytes(r.content) for r in new.select("content", history.content_id(F.col("content")).alias("id")).collect()}
        known = {ids[r.id] for r in h.match(new).collect()}
        assert known - {near} == set(batch) & accepted and near in known
        fresh = (set(batch) | {near}) - known
        if fresh:
            h.append(frame(fresh, b))
        accepted |= fresh
        found.append(known)
    assert len(found[2]) > len(found[0])


def test_a_chunk_that_all_contents_share(spark):
    head = b"the same long head of all of them " * 4
    rng = np.random.default_rng(9)
    texts = [head + bytes(rng.integers(0, 256, 60, dtype=np.uint8)) for _ in range(200)]
    h = history.History(spark, least=8, bits=2, most=16)
    df = spark.createDataFrame([(bytearray(t), 1) for t in texts], "content binary, batch int")
    h.append(df)
    assert sorted(h.match(df).select("id", "known").collect()) == sorted((r.id, r.id) for r in df.select(history.content_id(F.col("content")).alias("id")).collect())


# problem 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=200), st.lists(st.integers(0, 2**64 - 1), max_size=50), st.integers(1, 12))
def test_filter_round_trip(keys, others, q):
    a, b = np.array(keys, dtype=U), np.array(others, dtype=U)
    f = seen.QuotientFilter.build(a, q)
    mask = U((1 << (q + 32)) - 1)
    assert np.array_equal(f.keys(), np.unique(a & mask))
    g = seen.QuotientFilter.unpack(f.pack())
    assert np.array_equal(g.contains(b), np.isin(b & mask, a & mask)) and g.contains(a).all()
    m = seen.QuotientFilter.merge([f, seen.QuotientFilter.build(b, q)], q)
    assert np.array_equal(m.keys(), np.unique(np.concatenate([a, b]) & mask))


def test_small_remainders_err_as_derived():
    rng = np.random.default_rng(2)
    keys, strange = (rng.integers(0, 2**63, 60_000, dtype=np.uint64) for _ in range(2))
    f = seen.QuotientFilter.build(keys, 16, 8)
    expected = seen.Layout(0, 16, 8).wrong_rate(len(keys))
    assert f.contains(keys).all() and abs(f.contains(strange).mean() - expected) < 0.3 * expected
    assert f.size() < len(keys) * 2


@pytest.mark.parametrize("shards", [1, 8])
def test_seen_before(spark, shards):
    rng = random.Random(3)
    keys = [rng.getrandbits(63) for _ in range(40)]
    past = [keys[i] for i in range(10)] * 2
    new = [(i, rng.choice([*keys, keys[0], keys[20], keys[20]])) for i in range(300)]
    rng.shuffle(new)
    known, want = set(past), set()
    for i, k in sorted(new):
        if k in known:
            want.add(i)
        known.add(k)
    h = spark.createDataFrame([(k,) for k in past], "key long")
    r = spark.createDataFrame([(k, i) for i, k in new], "key long, id long").repartition(5)
    got = [x.record_id for x in seen.seen_before(h, r, seen.Layout.of(400, shards)).collect()]
    assert len(got) == len(want) and set(got) == want
    assert seen.seen_before(h.limit(0), r.limit(0), seen.Layout.of(0)).count() == 0


def test_pictures_of_one_hash_that_a_third_has(spark, monkeypatch):
    monkeypatch.setattr(pictures, "CELL", 50)
    hot, near = "0123456789abcdef", "0123456789abcdee"
    rng = random.Random(8)
    rows = [(i, 100, 50, hot if i % 3 == 0 else near if i % 30 == 1 else f"{rng.getrandbits(64):016x}") for i in range(300)]
    rows += [(3, 100, 50, near), (6, 200, 100, hot), (9, 51, 100, hot)]
    got = [tuple(r) for r in pictures.same_pictures(spark.createDataFrame(rows, MEDIA), salt_rows=7).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)
