"""Stored filters of seen keys, and what they weigh."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from catalumen.llm import seen

U = np.uint64


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 300), max_size=60))
def test_varints_round_trip(values):
    v = np.array(values, dtype=U)
    assert np.array_equal(seen.read_varints(np.frombuffer(seen.varints(v), np.uint8)), v)


def test_filters_weigh_in_proportion_to_their_keys():
    """Of 10^8, 10^9 and 10^10 keys: what a task sends to all shards, a key, grows by less than half from first to last."""
    rng = np.random.default_rng(1)
    weights = []
    for keys in (10**8, 10**9, 10**10):
        layout = seen.Layout.of(keys)
        # one task's LOCAL_ROWS keys are spread evenly over all shards: a few shards' parts stand for all
        each = max(1, seen.LOCAL_ROWS >> layout.shard_bits)
        sizes = [len(seen.QuotientFilter.build(rng.integers(0, 2**63, each, dtype=U) * U(2), layout.q, layout.r).pack()) for _ in range(20)]
        weights.append(sum(sizes) / 20 / each)
    assert weights[0] < 7 and weights[-1] < 1.5 * weights[0] and weights[-1] < 8


def test_batch_after_batch_as_in_one_go(spark, tmp_path):
    rng = random.Random(3)
    keys = [rng.getrandbits(63) for _ in range(500)]
    frame = lambda ks: spark.createDataFrame([(k,) for k in ks], "key long")
    store = seen.SeenKeys(spark, f"{tmp_path}/keys", 1000)
    assert store.version() == 0 and store.filters().count() == 0
    store.absorb(frame(keys[:200]))
    store.absorb(frame(keys[150:300] * 2))
    again = seen.SeenKeys(spark, f"{tmp_path}/keys")
    assert again.version() == 2 and again.layout == store.layout
    stored = [seen.QuotientFilter.unpack(bytes(r[0])) for r in again.filters().select("filter").collect()]
    assert sum(map(len, stored)) == 300
    records = spark.createDataFrame([(k, i) for i, k in enumerate([*keys[100:350], keys[400], keys[400]])], "key long, id long")
    assert {r.record_id for r in again.seen(records).collect()} == {*range(200), 251}
    # an incomplete version doesn't count
    (tmp_path / "keys" / "v00000002" / "_SUCCESS").unlink()
    assert again.version() == 1 and len(again.seen(records).collect()) == 101


def test_a_hot_key_and_empty_sides(spark, tmp_path):
    store = seen.SeenKeys(spark, f"{tmp_path}/hot", 10)
    store.absorb(spark.createDataFrame([], "key long"))
    records = spark.createDataFrame([(7 if i % 3 == 0 else i + 100, i) for i in range(3000)], "key long, id long").repartition(6)
    assert {r.record_id for r in store.seen(records).collect()} == set(range(3, 3000, 3))
    assert store.seen(records.limit(0)).count() == 0
