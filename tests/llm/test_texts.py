import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalumen.llm import abuse, mixture, tokens

TOKENIZER = os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json")
needs_files = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary files")


@pytest.fixture(scope="module")
def pair():
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(TOKENIZER)
    library.encode_special_tokens = True
    return tokens.Encoder(tokens.read_ranks()), library


def check(pair, texts):
    own, library = pair
    ids, counts = own.encode(texts)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for t, p, e in zip(texts, parts, library.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True):
        assert p.tolist() == e.ids, repr(t)
        assert own.decode(p.tolist()) == (t or "").encode()
        assert own.spans(p)[-1] == len((t or "").encode())


@needs_files
def test_odd_texts(pair):
    check(pair, ["", None, " ", "  a", "a  ", "\n\n x", "don't we'll I've x's' 's's ''s", " 's", "'S", "<|endoftext|>", "日本語 テキスト", "a b", "²³ ½", "😂😂", "\u0000", "x" * 5000, " " * 3000, "'" * 500, "ab" * 3000, "\U000105c0Ᲊ"])


@needs_files
def test_random_texts(pair, monkeypatch):
    rng = random.Random(1)
    signs = ["'", "s", "t", "re", "ve", "ll", "m", "d", "r", "v", "l", "e", " ", "  ", "\n", "\t", "a", "1", "!", "é", "日", "😂", "　", "﻿"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(3000)]
    check(pair, texts)
    monkeypatch.setattr(tokens, "CODES", 20)  # texts cut into portions
    check(pair, texts)


@needs_files
def test_all_code_points(pair):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    check(pair, ["a".join(chars[i : i + 500]) + " 1".join(chars[i : i + 500]) for i in range(0, 0x3500, 500)])
    check(pair, ["a".join(chars[i : i + 4000 : 7]) for i in range(0x3500, len(chars) - 4000, 40_000)])


@needs_files
def test_newer_code_points_need_no_library(pair, monkeypatch):
    chars = [chr(c) for runs in tokens.NEWER.values() for low, high in runs for c in {low, (low + high) // 2, high}]
    texts = [f"a{c} 1{c} {c}{c}" for c in chars]
    check(pair, texts)
    with_library = pair[0].encode(texts)[0].tolist()
    monkeypatch.setitem(__import__("sys").modules, "tokenizers", None)
    assert tokens.Encoder(tokens.read_ranks()).encode(texts)[0].tolist() == with_library
    monkeypatch.setattr(tokens, "UNICODE", ("1.0",))
    with pytest.raises(RuntimeError, match="Unicode"):
        tokens.class_table()


@needs_files
def test_scan_is_associative():
    rng = np.random.default_rng(1)
    c = rng.integers(0, 7, 5000).astype(np.uint8)
    first = rng.random(5000) < 0.01
    first[0] = True
    state, want = tokens.S_CLOSED, []
    for k, f in zip(c, first, strict=True):
        state = tokens.TRANSITIONS[k, tokens.S_CLOSED if f else state]
        want.append(state)
    for width in (2, 7, 64):
        assert tokens.scan(c, first, width).tolist() == want


@needs_files
def test_encode_frame(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (3, "", "z"), (1, "hello world", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in tokens.encode(df).collect())
    assert got == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    assert tokens.encode(df.limit(0)).count() == 0


DOCS, TARGETS = "doc_id long, source string, text string", "source string, weight double, max_repeats int"


@needs_files
def test_mixture(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["Big", " big ", "BIG"]), "word " * rng.randrange(1, 30)) for i in range(600)]
    rows += [(1000 + i, "small one", "word " * rng.randrange(1, 30)) for i in range(40)] + [(2000, None, "x"), (2001, "other", "x"), (2002, "big", None), (2003, "big", "")]
    targets = spark.createDataFrame([("big", 3.0, 1), ("small_one", 1.0, 3), ("nothing", 2.0, 1), (None, 1.0, 1)], TARGETS)
    use, report = mixture.mix(spark.createDataFrame(rows, DOCS), targets)
    shares = {r.source: r for r in report.collect()}
    used = {}
    for r in use.collect():
        used[r.source] = used.get(r.source, 0) + r.n_tokens * r.repeats
        assert r.repeats <= {"big": 1, "small_one": 3}[r.source]
    assert used == {k: shares[k].used_tokens for k in used}
    longest = 31
    for s in ("big", "small_one"):
        assert 0 <= shares[s].budget - shares[s].used_tokens <= longest
    assert abs(shares["big"].actual_share - 0.75) < 0.02 and shares["nothing"].actual_share == 0 and shares["other"].used_tokens == 0


@needs_files
def test_larger_budgets_keep_smaller_sets(spark):
    docs = spark.createDataFrame([(i, "a", "word " * (i % 9 + 1)) for i in range(300)], DOCS)
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    sets = []
    for total in (100, 500, 2500):
        use, report = mixture.mix(docs, targets, total)
        assert 0 <= total - report.head().used_tokens <= 10
        sets.append({(r.doc_id, k) for r in use.collect() for k in range(r.repeats)})
    assert sets[0] < sets[1] < sets[2]


@needs_files
def test_mixture_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    use, report = mixture.mix(spark.createDataFrame([], DOCS), targets)
    assert use.count() == 0 and report.head().used_tokens == 0
    use, report = mixture.mix(spark.createDataFrame([(1, "a", "x")], DOCS), targets.limit(0))
    assert use.count() == 0


@pytest.mark.parametrize(("token", "word"), [("fuuuuck", "fuck"), ("1d10t", "idiot"), ("fuсkіng", "fucking"), ("été", "ete"), ("a$$", "ass"), ("2024", "0"), ("сад", "сад")])
def test_disguises(token, word):
    assert abuse.plain(token)[0] == word


def test_tokens_of_disguised_words():
    r = abuse.Reader()
    assert list(r.tokens("You j_a_c_k_a_s_s! Go. c​reep")) == [["you", "jackass"], ["go"], ["creep"]]
    assert list(r.tokens("写真。x")) == [["写", "真"], ["x"]]


BAD = ["you are a worthless {}", "shut up you {}", "what a {} you are, get lost"]
FINE = ["the harbour was calm in {}", "shot with the {} at noon", "my worthless tripod broke near {}", "thanks for the {} report"]


def sample(n, seed, noise=0.04):
    rng = random.Random(seed)
    texts, labels, truth = [], [], []
    for _ in range(n):
        bad = rng.random() < 0.15
        parts = [rng.choice(FINE).format(rng.choice(["may", "june", "norway", "camera"])) for _ in range(rng.randrange(1, 5))]
        if bad:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(BAD).format(rng.choice(["idiot", "clown", "fool"])))
        texts.append(". ".join(parts) + ".")
        truth.append(int(bad))
        labels.append(int(bad) ^ (rng.random() < noise))
    return texts, np.array(labels), np.array(truth)


def test_held_out_accuracy():
    texts, labels, _ = sample(1500, 1)
    w, b = abuse.fit(texts, labels)
    texts, _, truth = sample(600, 2)
    p = abuse.score_texts(abuse.Reader(), texts, w, b) >= abuse.CUT
    assert truth[p].mean() > 0.95 and p[truth == 1].mean() > 0.95
    assert 0 < (w != 0).sum() < 20_000


def test_scores(spark):
    texts, labels, _ = sample(800, 3, 0)
    docs = spark.createDataFrame([(i, t, "S") for i, t in enumerate(texts)] + [(9000, None, None), (9001, "", "s"), (9002, "the harbour was calm. " * 2000 + "you are a worthless fool.", "s")], "doc_id long, text string, source string")
    rated = spark.createDataFrame([(i, int(v), "a") for i, v in enumerate(labels)] + [(1, None, "b"), (9000, 1, "b"), (None, 1, "b"), (2, 0, "b"), (2, 1, "c")], "doc_id long, abusive int, rater string")
    got = {r.doc_id: r.score for r in abuse.scores(docs, rated).collect()}
    assert len(got) == len(texts) + 3 and got[9000] == got[9001] == 0 and got[9002] > 0.5
    assert abuse.majority(rated).count() == 801  # 9000 is rated though it has no text
    none = abuse.scores(docs, rated.limit(0)).agg(F.max("score")).head()[0]
    assert none < 0.1 and abuse.scores(docs.limit(0), rated).count() == 0
