"""Low-rank alternating least squares over mixed cells of records and encoded features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of a categorical feature's encoded values; a bound on the model, whatever the number of values.
BUCKETS = 1024
RANK = 24
ROUNDS = 6
#: Weight of the cells of a known categorical feature's other values (0), against 1 for the value that is there.
OTHERS = 0.1
RIDGE = 0.1
#: Records of a task of a round, about.
TASK = 100_000
#: Predicted cells of one matrix product.
SCORES = 4_000_000


def bucket(column: Column, seed: int = 0) -> Column:
    """The encoded value of a category; null stays null. Another seed gives an independent encoding."""
    salted = F.xxhash64(column, F.lit(seed)) if seed else F.xxhash64(column)
    return F.when(column.isNotNull(), F.pmod(salted, F.lit(BUCKETS)).cast("int"))


class LowRank:
    """Factors of the features, fitted on all records; a record's own factors are solved from its known cells.

    Feature rows: BUCKETS for each categorical column, then one for each numeric column. Records stay distributed:
    a round is one pass that solves the records' factors against the features' and adds up each feature's normal
    equations, pre-aggregated by task. The driver holds the features' sums only, len(categories) * BUCKETS +
    len(numbers) rows.
    """

    def __init__(self, categories: list[str], numbers: list[str], rank: int = RANK, rounds: int = ROUNDS) -> None:
        self.categories, self.numbers, self.rank, self.rounds = categories, numbers, rank, rounds
        self.features = len(categories) * BUCKETS + len(numbers)
        # a fixed start by rule: cosines of the golden angle
        grid = np.arange(1, self.features * rank + 1, dtype=float).reshape(self.features, rank)
        self.factors = np.cos(grid * 2.399963229728653) / np.sqrt(rank)
        self.used = np.ones(self.features, dtype=bool)
        self.centre, self.scale = np.zeros(len(numbers)), np.ones(len(numbers))

    def _cells(self, b: pd.DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
        cats = []
        for k, c in enumerate(self.categories):
            v = b[c].to_numpy(dtype=float, na_value=np.nan)
            at = np.flatnonzero(~np.isnan(v))
            cats.append((at, v[at].astype(np.int64) + k * BUCKETS))
        nums = []
        for k, c in enumerate(self.numbers):
            v = (b[c].to_numpy(dtype=float, na_value=np.nan) - self.centre[k]) / self.scale[k]
            at = np.flatnonzero(np.isfinite(v))
            nums.append((at, v[at]))
        return cats, nums

    def solve(self, b: pd.DataFrame) -> np.ndarray:
        """Factors of records, one row each; a record without known cells has zeros.

        Records that know the same columns share a base, inverted once; a record's own categories change it by one rank
        each, so that only a system of that many unknowns is solved by record (Woodbury's identity).
        """
        cats, nums = self._cells(b)
        n, n_cats = len(b), len(cats)
        category, number = np.full((n, n_cats), -1), np.full((n, len(nums)), np.nan)
        for k, (at, f) in enumerate(cats):
            category[at, k] = f
        for k, (at, value) in enumerate(nums):
            number[at, k] = value
        values = [self.factors[k * BUCKETS : (k + 1) * BUCKETS][self.used[k * BUCKETS : (k + 1) * BUCKETS]] for k in range(n_cats)]
        alike = [v.T @ v for v in values]
        known = np.concatenate([category >= 0, ~np.isnan(number)], axis=1)
        patterns, which = np.unique(known @ (1 << np.arange(known.shape[1])), return_inverse=True)
        out = np.empty((n, self.rank))
        for p in range(len(patterns)):
            at = np.flatnonzero(which == p)
            has = np.flatnonzero(known[at[0]])
            own, y = has[has < n_cats], self.factors[n_cats * BUCKETS + has[has >= n_cats] - n_cats]
            base = np.linalg.inv(RIDGE * np.eye(self.rank) + OTHERS * sum(alike[k] for k in own) + y.T @ y)
            x = self.factors[category[at[:, None], own]]  # records, own categories, rank
            right = x.sum(1) + number[at[:, None], has[has >= n_cats] - n_cats] @ y
            met = x @ base
            small = met @ x.transpose(0, 2, 1) + np.eye(len(own)) / (1 - OTHERS)
            weight = np.linalg.solve(small, met @ right[:, :, None])
            out[at] = right @ base - (weight.transpose(0, 2, 1) @ met)[:, 0]
        return out

    def fit(self, records: DataFrame) -> LowRank:
        """records: the category columns encoded by bucket(), the numeric ones as doubles; nulls are unknown cells."""
        records = records.select(*self.categories, *(F.col(c).cast("double") for c in self.numbers))
        # infinities and NaN are unknown too
        finite = [F.when(F.abs(F.col(c)) < 1e300, F.col(c)) for c in self.numbers]
        count, *m = records.agg(F.count(F.lit(1)), *(f(x) for x in finite for f in (F.avg, F.stddev_pop))).head()
        self.centre = np.array([x or 0.0 for x in m[0::2]])
        self.scale = np.array([x or 1.0 for x in m[1::2]])
        # a task sends its sums of all features, however few its records are: less is shuffled by fewer tasks
        records = records.coalesce(-(-count // TASK) or 1)
        r, tri = self.rank, np.triu_indices(self.rank)
        n_cats, width = len(self.categories), 1 + r + len(tri[0])
        packed = "feature long, sums binary"

        def pack(feature: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"feature": feature, "sums": [row.tobytes() for row in sums]})

        def unpack(b: pd.DataFrame) -> np.ndarray:
            return np.frombuffer(b"".join(b["sums"])).reshape(-1, width)

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Of each feature: its records, the sum of their factors (weighted by a number's value) and of their squares."""
            linear, square = np.zeros((self.features, 1 + r)), np.zeros((self.features, r, r))
            for b in batches:
                u = self.solve(b)
                cats, nums = self._cells(b)
                for at, f in cats:
                    order = np.argsort(f, kind="stable")
                    own, by = f[order], u[at[order]]
                    begin = np.flatnonzero(np.diff(own, prepend=-1))
                    if len(at):
                        linear[own[begin], 0] += np.diff(begin, append=len(own))
                        linear[own[begin], 1:] += np.add.reduceat(by, begin)
                    for value, part in zip(own[begin], np.split(by, begin[1:]), strict=False):
                        square[value] += part.T @ part
                for k, (at, value) in enumerate(nums, n_cats * BUCKETS):
                    linear[k, 0] += len(at)
                    linear[k, 1:] += value @ u[at]
                    square[k] += u[at].T @ u[at]
            live = np.flatnonzero(linear[:, 0])
            yield pack(live, np.concatenate([linear[live], square[live][:, tri[0], tri[1]]], axis=1))

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((self.features, width))
            for b in batches:
                for f, row in zip(b["feature"], unpack(b), strict=True):
                    total[f] += row
            live = np.flatnonzero(total[:, 0])
            yield pack(live, total[live])

        for _ in range(self.rounds):
            told = records.mapInPandas(sums, packed).repartition("feature").mapInPandas(add, packed).toPandas()  # at most a row per feature
            feature, s = told["feature"].to_numpy(), unpack(told)
            square = np.zeros((len(s), r, r))
            square[:, tri[0], tri[1]] = s[:, 1 + r :]
            square[:, tri[1], tri[0]] = s[:, 1 + r :]
            # a category's records are those of its values
            others = [square[feature // BUCKETS == k].sum(0) for k in range(n_cats)]
            new, used = np.zeros_like(self.factors), np.zeros(self.features, dtype=bool)
            for i, f in enumerate(feature):
                k = f // BUCKETS
                left = OTHERS * others[k] + (1 - OTHERS) * square[i] if k < n_cats else square[i]
                new[f] = np.linalg.solve(left + RIDGE * np.eye(r), s[i, 1 : 1 + r])
                used[f] = True
            self.factors, self.used = new, used
        return self

    def decode(self, cells: DataFrame, feature: str, keep: list[str]) -> DataFrame:
        """keep..., value, score and choices of each cell: of its admissible values (column choices) the one with the
        highest score, the smallest value among equals.

        Choices of a category are struct<value, bucket>, and its predicted cell is the score; those of a number are
        struct<value, number>, and the score falls with the distance from the predicted number. A cell without
        admissible values gives null.
        """
        category = feature in self.categories
        k = (self.categories if category else self.numbers).index(feature)

        def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                u, n = self.solve(b), len(b)
                count = np.array([len(o) for o in b["_value"]], dtype=np.int64)
                row = np.repeat(np.arange(n), count)
                value = np.array([o for options in b["_value"] for o in options], dtype=object)
                number = np.array([o for options in b["_number"] for o in options], dtype=float)
                if category:
                    at = number.astype(np.int64)
                    score = np.einsum("ij,ij->i", u[row], self.factors[k * BUCKETS + at]) if len(row) else np.empty(0)
                else:
                    told = u @ self.factors[len(self.categories) * BUCKETS + k]
                    score = -np.abs((number - self.centre[k]) / self.scale[k] - told[row])
                _, rank = np.unique(value.astype(str), return_inverse=True)
                order = np.lexsort((rank, -score, row))
                best = order[np.searchsorted(row[order], np.flatnonzero(count))]
                values, scores = np.full(n, None, dtype=object), np.full(n, np.nan)
                values[count > 0], scores[count > 0] = value[best], score[best]
                yield b[keep].assign(value=values, score=pd.array(np.where(count > 0, scores, None), dtype="Float64"), choices=count)

        fields = {f.name: f.dataType.simpleString() for f in cells.schema}
        apart = {"_value": F.col("choices.value"), "_number": F.col("choices.bucket" if category else "choices.number")}  # structs are slow in pandas
        asked = cells.select(*dict.fromkeys([*keep, *self.categories, *self.numbers]), *(c.alias(name) for name, c in apart.items()))
        return asked.mapInPandas(pick, ", ".join(f"`{c}` {fields[c]}" for c in keep) + ", value string, score double, choices int")

    def decode_among(self, cells: DataFrame, encodings: list[str], values: list[tuple], keep: list[str]) -> DataFrame:
        """keep..., value and score of each cell: of all `values` the one with the highest predicted cell.

        encodings: categories that encode the same value independently; values: (value, bucket in each of them). A value's
        score is the sum of its cells', so that values that share a bucket in one encoding are told apart by the others;
        the smallest value wins among equals. One matrix product a batch.
        """
        values = sorted(values)
        names = np.array([v[0] for v in values], dtype=object)
        table = sum(self.factors[self.categories.index(c) * BUCKETS + np.array([v[i] for v in values])] for i, c in enumerate(encodings, 1))
        shared = cells.sparkSession.sparkContext.broadcast((names, table))

        def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, table = shared.value
            for b in batches:
                u = self.solve(b)
                best, top = np.zeros(len(b), np.int64), np.zeros(len(b))
                step = max(1, SCORES // len(names))
                for lo in range(0, len(b), step):
                    score = u[lo : lo + step] @ table.T
                    best[lo : lo + step] = at = score.argmax(1)
                    top[lo : lo + step] = score[np.arange(len(at)), at]
                yield b[keep].assign(value=names[best], score=top)

        fields = {f.name: f.dataType.simpleString() for f in cells.schema}
        return cells.mapInPandas(pick, ", ".join(f"`{c}` {fields[c]}" for c in keep) + ", value string, score double")

    def predict(self, cells: DataFrame, number: str, keep: list[str]) -> DataFrame:
        """keep..., value: the predicted value of a numeric feature for each record."""
        k = self.numbers.index(number)
        factor = self.factors[len(self.categories) * BUCKETS + k]

        def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b[keep].assign(value=self.solve(b) @ factor * self.scale[k] + self.centre[k])

        fields = {f.name: f.dataType.simpleString() for f in cells.schema}
        return cells.mapInPandas(fill, ", ".join(f"`{c}` {fields[c]}" for c in keep) + ", value double")
