"""Problem 9: abusive, hateful or sexual content, by FTRL-proximal logistic regression."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalumen.llm.chunks import mix64
from catalumen.llm.mixture import source_key
from catalumen.runtime import spread, table

#: Labelled documents that the model is fitted on at most, drawn by a hash of doc_id; all documents are scored.
LABELLED = 30_000
#: Hashed features.
SPACE_BITS = 20
#: FTRL-proximal: learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.2, 0.5
#: Passes over the segments in each round, segments of one step, rounds of choosing segments, folds of each round.
PASSES, STEP, ROUNDS, FOLDS = 2, 32, 3, 3
#: A feature counts if as many labelled documents have it.
RARE = 3
#: Score by other documents from which a segment of an abusive document may be why; the one beyond which a harmless
#: label isn't believed; the weight of an abusive segment in the last fit.
SUSPECT, TRUSTED, LIFT = 0.15, 0.8, 1.0
#: Constant of a model without labelled words: everything is harmless.
NO_DATA = -5.0
#: Score from which a document is reported.
CUT = 0.25
#: Tokens of a segment; longer sentences are read in windows of that many tokens that overlap by half.
WINDOW = 12
KEPT = 200_000
#: Texts read at once.
PORTION = 2_000

#: Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOKALIKES = str.maketrans(dict(zip("асеорхуікѕјԁһвмнтοαεικνρτυ", "aceopxyiksjdhbmhtoaeikvptu", strict=True)))
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "€": "e"})
_HIDDEN = re.compile("[­​-‏ -‮⁠-⁤︀-️﻿]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ ._*\-·]){2,}[^\W\d_](?![^\W_])")
_TOKEN = re.compile(r"(?:[.!?…]+(?=\s|$)|[。！？\n\r]+)|([぀-ヿ㐀-鿿]|[^\W_]+(?:[*@$!|+€'’#]+[^\W_぀-ヿ㐀-鿿]+)*)")
_LATIN = re.compile("[a-z]")
_REPEAT = re.compile(r"(.)\1{2,}")
_DOUBLE = re.compile(r"(.)\1+")


def plain(token: str) -> tuple[str, str]:
    """(word, skeleton): a token without disguises, and its consonants after the first letter."""
    if token.isdigit():
        return "0", ""
    if _LATIN.search(token):
        token = token.translate(LOOKALIKES)
    token = "".join(c for c in unicodedata.normalize("NFKD", token) if not unicodedata.combining(c))
    token = _REPEAT.sub(r"\1", token.translate(SIGNS))
    word = re.sub(r"[*'’#]", "", token) or token
    skeleton = _DOUBLE.sub(r"\1", word[:1] + re.sub("[aeiouyäöü]", "", word[1:])) if word.isascii() else ""
    return word, skeleton


def _hash(text: str) -> int:
    x = 0xCBF29CE484222325
    for b in text.encode("utf-8", "surrogatepass"):
        x = ((x ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return x


class Codes(dict):
    """token -> its number, given at the first look; its word's and its skeleton's hashes are kept under that number.

    The empty token, an end of a sentence, is number 0."""

    def __init__(self) -> None:
        self[""] = 0
        self.words: list[int] = [0]
        self.bones: list[int] = [0]

    def __missing__(self, token: str) -> int:
        word, skeleton = plain(token)
        self.words.append(_hash("w" + word))
        self.bones.append(_hash("k" + skeleton) if len(skeleton) > 1 else 0)
        self[token] = number = len(self.words) - 1
        return number


class Reader:
    """Texts as segments of hashed word n-grams (1 to 3), skip-grams (one or two words left out) and skeletons."""

    def __init__(self, bits: int = SPACE_BITS) -> None:
        self.bits = bits
        self.kept = Codes()

    def tokens(self, text: str) -> Iterator[list[str]]:
        """The sentences of a text as lists of raw tokens."""
        run: list[str] = []
        for token in [*self.marks(text), ""]:
            if token:
                run.append(token)
            elif run:
                yield run
                run = []

    @staticmethod
    def marks(text: str) -> list[str]:
        """The raw tokens of a text, with an empty one at each end of a sentence."""
        t = _HIDDEN.sub("", unicodedata.normalize("NFKC", text)).lower()
        t = _SPACED.sub(lambda m: re.sub(r"[ ._*\-·]", "", m[0]), t)
        return _TOKEN.findall(t)

    def segments(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text of each segment, segment of each feature, feature), in order, each feature once a segment."""
        if len(self.kept) > KEPT:
            self.kept = Codes()
        number = self.kept.__getitem__
        numbers: list[int] = []
        ends: list[int] = []
        for text in texts:
            if text:
                numbers += map(number, self.marks(text))
            numbers.append(0)
            ends.append(len(numbers))
        codes = np.array(numbers, dtype=np.int64)
        # sentences: runs between zeros
        stops = np.flatnonzero(codes == 0)
        begin = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
        length = stops - begin
        begin, length = begin[length > 0], length[length > 0]
        step = WINDOW // 2
        windows = np.where(length > WINDOW, -(-(length - step) // step), 1)
        nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        start = np.repeat(begin, windows) + nth * step
        size = np.minimum(WINDOW, np.repeat(length, windows) - nth * step)
        owner = np.searchsorted(np.array(ends, dtype=np.int64), start, side="right")
        at = codes[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)]
        w, k = (np.array(x, dtype=np.uint64)[at] for x in (self.kept.words, self.kept.bones))
        seg = np.repeat(np.arange(len(size)), size)
        parts, segs = [w], [seg]
        with np.errstate(over="ignore"):
            for kind, (a, gap) in enumerate([(w, 1), (w, 2), (w, 3), (k, 1)], 1):
                if len(a) > gap:
                    same = seg[gap:] == seg[:-gap]
                    if a is k:
                        same &= (k[gap:] != 0) & (k[:-gap] != 0)
                    parts.append(mix64(a[:-gap][same] * np.uint64(31) + mix64(a[gap:][same] + np.uint64(kind)))), segs.append(seg[gap:][same])
            if len(w) > 2:
                same = seg[2:] == seg[:-2]
                parts.append(mix64(mix64(w[:-2][same] * np.uint64(31) + w[1:-1][same]) * np.uint64(31) + w[2:][same])), segs.append(seg[2:][same])
            parts.append(k[k != 0]), segs.append(seg[k != 0])
            feature = (mix64(np.concatenate(parts)) >> np.uint64(64 - self.bits)).astype(np.int64)
        pairs = np.concatenate(segs) << self.bits | feature
        pairs.sort()
        pairs = pairs[np.diff(pairs, prepend=-1) != 0]
        return owner, pairs >> self.bits, pairs & ((1 << self.bits) - 1)


class Ftrl:
    """FTRL-proximal logistic regression with per-coordinate rates; the L1 penalty keeps most weights at 0.

    The last coordinate is a constant without penalty.
    """

    def __init__(self, size: int) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def constant(self) -> float:
        return float(-self.z[-1] / ((BETA + self.n[-1] ** 0.5) / ALPHA))

    def learn(self, feature: np.ndarray, row: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        """One step on a few segments: entries (feature, row), with a target and a weight for each row."""
        p = sigmoid(np.bincount(row, weights=self.weights(feature), minlength=len(target)) + self.constant())
        slope = weight * (p - target)
        own, back = np.unique(feature, return_inverse=True)
        g, square = np.bincount(back, weights=slope[row]), np.bincount(back, weights=slope[row] ** 2)
        w, n = self.weights(own), self.n[own]
        self.z[own] += g - (np.sqrt(n + square) - np.sqrt(n)) / ALPHA * w
        self.n[own] = n + square
        g, square, n = slope.sum(), (slope**2).sum(), self.n[-1]
        self.z[-1] += g - (np.sqrt(n + square) - np.sqrt(n)) / ALPHA * self.constant()
        self.n[-1] = n + square


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Bags:
    """The segments of labelled documents as rows of feature numbers, without features of fewer than RARE documents."""

    def __init__(self, texts: list[str], bits: int) -> None:
        reader = Reader(bits)
        owners, wheres, features = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        documents, count = np.zeros(1 << bits, dtype=np.int64), 0
        for lo in range(0, len(texts), PORTION):
            owner, where, feature = reader.segments(texts[lo : lo + PORTION])
            once = np.sort(feature << 32 | owner[where])
            documents += np.bincount(once[np.diff(once, prepend=-1) != 0] >> 32, minlength=1 << bits)
            owners.append(owner + lo)
            wheres.append((where + count).astype(np.int32))
            features.append(feature.astype(np.int32))
            count += len(owner)
        self.owner, where, feature = np.concatenate(owners), np.concatenate(wheres), np.concatenate(features)
        del wheres, features
        keep = documents[feature] >= RARE
        self.names = np.flatnonzero(documents >= RARE)
        number = (np.cumsum(documents >= RARE) - 1).astype(np.int32)
        self.where, self.feature = where[keep], number[feature[keep]]
        self.begin = np.searchsorted(self.where, np.arange(count + 1))

    def train(self, rows: np.ndarray, target: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> Ftrl:
        model = Ftrl(len(self.names))
        for _ in range(PASSES):
            order = rng.permutation(rows)
            for lo in range(0, len(order), STEP):
                part = order[lo : lo + STEP]
                count = self.begin[part + 1] - self.begin[part]
                row = np.repeat(np.arange(len(part)), count)
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.begin[part], count)
                model.learn(self.feature[at], row, target[part], weight[part])
        return model

    def score(self, model: Ftrl) -> np.ndarray:
        return sigmoid(np.bincount(self.where, weights=model.weights()[self.feature], minlength=len(self.owner)) + model.constant())


def fit(texts: list[str], labels: np.ndarray, bits: int = SPACE_BITS) -> tuple[np.ndarray, float]:
    """(weights, bias) of a model of segments, from labels of whole documents that raters sometimes get wrong.

    All segments of a harmless document are harmless; of an abusive one at least one segment is abusive. The first
    round takes all its segments as such. Later rounds take those that models fitted on other documents find
    suspicious, its highest one in any case among them, and leave out the rest; harmless labels that such models
    contradict strongly are left out too. Scores from other documents keep wrong labels from confirming themselves.
    """
    weights = np.zeros(1 << bits)
    bags = Bags(texts, bits)
    if not len(bags.owner):
        return weights, NO_DATA
    rng = np.random.default_rng(42)
    positive = labels[bags.owner] == 1
    fold = rng.permutation(len(labels))[bags.owner] % FOLDS
    use, target = np.ones(len(positive), dtype=bool), positive.copy()
    for _ in range(ROUNDS):
        p = np.zeros(len(positive))
        for k in range(FOLDS):
            rows = np.flatnonzero(use & (fold != k))
            model = bags.train(rows, target.astype(float), np.ones(len(target)), rng)
            p[fold == k] = bags.score(model)[fold == k]
        top = np.zeros(len(labels))
        np.maximum.at(top, bags.owner, p)
        suspect = max(SUSPECT, 2.5 * target[use].mean())
        target = positive & (top[bags.owner] >= suspect) & (p >= np.minimum(0.5, top[bags.owner]))
        use = target | (~positive & (p < TRUSTED))
    model = bags.train(np.flatnonzero(use), target.astype(float), np.where(target, LIFT, 1.0), rng)
    weights[bags.names] = model.weights()[:-1]
    return weights, model.constant()


def majority(labels: DataFrame) -> DataFrame:
    """(doc_id, label): what most raters of a document say; without a majority no row."""
    votes = labels.filter("abusive in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.sum(F.col("abusive") * 2 - 1).alias("v"))
    return votes.filter("v <> 0").select("doc_id", (F.col("v") > 0).cast("int").alias("label"))


def train(documents: DataFrame, labels: DataFrame, most: int = LABELLED, bits: int = SPACE_BITS) -> tuple[np.ndarray, float]:
    """Fits on at most `most` labelled documents, those of the least hashes of doc_id, in one task; the driver gets the
    weights that aren't 0."""
    voted = majority(labels)
    sample = voted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # each task sends its least ones only
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").filter("text is not null")  # `most` rows at most

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        w, b = fit(group["text"].tolist(), group["label"].to_numpy(), bits)
        live = np.flatnonzero(w)
        return pd.DataFrame({"feature": np.append(live, -1), "weight": np.append(w[live], b)})

    told = rows.groupBy(F.lit(0).alias("_one")).applyInPandas(learn, "feature long, weight double").toPandas()  # 2 ** bits rows at most
    w = np.zeros(1 << bits, dtype=np.float32)
    inner = told[told["feature"] >= 0]
    w[inner["feature"].to_numpy()] = inner["weight"].to_numpy()
    bias = told.loc[told["feature"] < 0, "weight"]
    return w, float(bias.iloc[0]) if len(bias) else NO_DATA


def score_texts(reader: Reader, texts: list[str | None], w: np.ndarray, b: float) -> np.ndarray:
    """The highest probability of a text's segments; 0 for null, empty and wordless texts."""
    owner, where, feature = reader.segments(texts)
    out = np.zeros(len(texts))
    if len(owner):
        p = sigmoid(np.bincount(where, weights=w[feature], minlength=len(owner)) + b)
        np.maximum.at(out, owner, p)
    return out


def scores(documents: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep..., score of every document.

    Null and empty texts score 0; without usable labels everything scores near 0; documents labelled several times
    count once; repeated rows are each scored; long texts are read whole, by segments; other columns are ignored.
    """
    w, b = train(documents, labels)
    live = np.flatnonzero(w).astype(np.int32)
    shared = documents.sparkSession.sparkContext.broadcast((len(w), live, w[live], b))  # few weights aren't 0
    rows = spread(documents.select(*keep, "text"))
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        size, live, values, bias = shared.value
        weights = np.zeros(size, dtype=np.float32)
        weights[live] = values
        for batch in batches:
            for lo in range(0, len(batch), PORTION):
                part = batch.iloc[lo : lo + PORTION]
                yield part[list(keep)].assign(score=score_texts(reader, part["text"].tolist(), weights, bias))

    return rows.mapInPandas(run, ", ".join(f"`{c}` {fields[c]}" for c in keep) + ", score double")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))
    return told.filter(F.col("score") >= CUT).select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source (read without case and blanks): documents, those reported, and their share."""
    told = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"), ("doc_id", "source"))
    return (
        told.groupBy(source_key(F.col("source")).alias("source"))
        .agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("score") >= CUT).alias("reported"))
        .withColumn("rate", F.col("reported") / F.col("documents"))
    )


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
SQL: dict[str, str] = {}
