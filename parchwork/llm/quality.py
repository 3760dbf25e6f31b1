"""Quality classifier: ordinal regression with cumulative links on graded documents.

One weight vector scores a text and ordered thresholds cut the score into grades:
P(grade <= k) = sigmoid(threshold[k] - score). From one score come the expected grade and the probability
of reaching any grade, which is what selection goes by. Features are hashed words, pieces of
words and runs of marks, each counted once per text, and a few shares that tell repetition,
shouting and symbols. Hash cells enter, however many they are, if they mark a lower grade beyond chance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchwork.llm import _words
from parchwork.llm._memory import tidy
from parchwork.plans.session import materialize, spread

_U = np.uint64
#: Tasks that read the sample.
TASKS = 16
#: Hash cells, labelled rows that are fitted at most (those of the least hashes of doc_id), and the chi-square that a cell
#: must reach: by chance, one of all cells does in two fits.
CELLS, SAMPLE, CHI_SQUARE = 1 << 20, 12_000, 25.0
#: Weight of the squared weights in the fit.
RIDGE = 0.5
#: Bytes in a piece of a word.
GRAM = 5
#: Of texts of MANY words at least; others take the mean.
SHARES, MANY = ("repeated neighbours", "distinct words", "most frequent word", "upper case", "marks", "letters in a word"), 8

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: All but marks separates runs of marks.
_NOT_MARK = bytes(c for c in range(256) if not _MARK[c])


def _described(texts: list[bytes], column: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index, distinct hash cells, shares) of each text. With `column`, cells of a negative column are left out."""

    def cells(hashes: np.ndarray, salt: int) -> np.ndarray:
        found = ((hashes ^ _U(salt)) & _U(CELLS - 1)).astype(np.int32)
        return found if column is None else found[column[found] >= 0]

    marks = {i: cells(h, 0x3C6EF) for i, _, h in _words.words_of(texts, _NOT_MARK)}
    grams = {i: cells(h, 0x9E6C6) for i, h in _words.grams_of(texts, _words.NON_WORD, GRAM)}
    for i, _, words in _words.words_of(texts, _words.NON_WORD):
        n = len(words)
        shares = np.full(len(SHARES), np.nan)
        found = np.unique(np.concatenate([cells(words, 0), marks[i], grams[i]]))
        if n >= MANY:
            buf = np.frombuffer(texts[i], dtype=np.uint8)
            _, counts = np.unique(words, return_counts=True)
            letters = max(1, int(np.count_nonzero(_LETTERS[buf])))
            shares[:] = (
                np.count_nonzero(words[1:] == words[:-1]) / n, len(counts) / n, counts.max() / n, np.count_nonzero(_UPPER[buf]) / letters,
                np.count_nonzero(_MARK[buf]) / len(buf), letters / n / 10,
            )
        yield i, found, shares


class Model(NamedTuple):
    """`column` gives a hash cell's place among the weights, -1 if it has none; the shares' weights come last."""

    column: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def score(self, cells: np.ndarray, shares: np.ndarray) -> float:
        at = self.column[cells]
        return float(self.weights[at[at >= 0]].sum() + np.nan_to_num((shares - self.mean) / self.scale) @ self.weights[len(self.weights) - len(SHARES) :])

    def reached(self, score: float) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 - _sigmoid(self.thresholds - score)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def count_cells(cells: list[np.ndarray], grades: np.ndarray, steps: int) -> np.ndarray:
    """How many texts of each grade hold each cell: a row for each grade."""
    return np.array([np.bincount(np.concatenate([np.empty(0, np.int32), *(c for c, g in zip(cells, grades, strict=True) if g == k)]), minlength=CELLS) for k in range(steps + 1)])


def select_cells(counts: np.ndarray, sizes: np.ndarray, least: float = CHI_SQUARE) -> np.ndarray:
    """All cells that are commoner in a grade than in the next one given beyond chance. `sizes`: texts of each grade."""
    chosen = [np.empty(0, np.int64)]
    given = np.flatnonzero(sizes)
    for k, above in zip(given[:-1], given[1:], strict=True):
        low, high, a, b = counts[k].astype(float), counts[above].astype(float), float(sizes[k]), float(sizes[above])
        n, present = a + b, low + high
        with np.errstate(divide="ignore", invalid="ignore"):
            chi = np.nan_to_num(n * (low * n - present * a) ** 2 / (present * a * (n - present) * b))
        chosen.append(np.flatnonzero((chi >= least) & (low * b > high * a) & (present >= 3)))
    return np.unique(np.concatenate(chosen))


class _Likelihood:
    """Minus the penalised log-likelihood of all grades and its gradient. A text's cells are a run in one array of
    columns, so work and memory go by the cells that texts hold. The parameters: weights of cells, weights of shares,
    the first threshold, logarithms of the steps between thresholds."""

    def __init__(self, columns: list[np.ndarray], width: int, shares: np.ndarray, grades: np.ndarray, ridge: float):
        self.sizes = np.array([len(c) for c in columns])
        self.flat = np.concatenate([np.empty(0, np.int32), *columns])
        self.some = np.flatnonzero(self.sizes)
        self.starts = (np.cumsum(self.sizes) - self.sizes)[self.some]
        self.width, self.shares, self.grades, self.ridge = width, shares, grades, ridge
        self.steps, self.rows = int(grades.max()), np.arange(len(grades))
        self.weights = width + shares.shape[1]

    def begin(self) -> np.ndarray:
        """No weights, and thresholds that give the grades their shares."""
        below = np.cumsum(np.bincount(self.grades, minlength=self.steps + 1) + 0.5)[:-1] / (len(self.grades) + 0.5 * (self.steps + 1))
        theta = np.log(below / (1 - below))
        return np.concatenate([np.zeros(self.weights), theta[:1], np.log(np.diff(theta))])

    def thresholds(self, value: np.ndarray) -> np.ndarray:
        return np.cumsum(np.append(value[self.weights], np.exp(value[self.weights + 1 :])))

    def __call__(self, value: np.ndarray) -> tuple[float, np.ndarray]:
        score = self.shares @ value[self.width : self.weights]
        if len(self.some):
            score[self.some] += np.add.reduceat(value[self.flat], self.starts)
        up = np.zeros((len(score), self.steps + 2))
        up[:, -1] = 1
        up[:, 1:-1] = _sigmoid(self.thresholds(value)[None, :] - score[:, None])
        slope, g, r = up * (1 - up), self.grades, self.rows
        p = np.maximum(up[r, g + 1] - up[r, g], 1e-12)
        by_upper, by_lower = slope[r, g + 1] / p, slope[r, g] / p
        by_score = by_upper - by_lower  # of the loss
        theta = (np.bincount(g, by_lower, self.steps + 1)[1:] - np.bincount(g, by_upper, self.steps + 1)[:-1])
        own = value[: self.weights]
        tail = np.cumsum(theta[::-1])[::-1]  # a step moves all thresholds after it
        gradient = np.concatenate([
            np.bincount(self.flat, np.repeat(by_score, self.sizes), self.width), self.shares.T @ by_score, tail[:1], tail[1:] * np.exp(value[self.weights + 1 :]),
        ])
        gradient[: self.weights] += self.ridge * own
        return float(-np.log(p).sum() + self.ridge / 2 * (own**2).sum()), gradient


def _descend(of: _Likelihood, rounds: int, memory: int = 8) -> np.ndarray:
    """The least value by L-BFGS with halved steps."""
    value = of.begin()
    loss, gradient = of(value)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        way, taken = gradient.copy(), []
        for moved, turned, scale in reversed(past):
            taken.append(scale * (moved @ way))
            way -= taken[-1] * turned
        way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(gradient).max())
        for (moved, turned, scale), t in zip(past, reversed(taken), strict=True):
            way += moved * (t - scale * (turned @ way))
        step = 1.0
        while True:
            new = value - step * way
            new_loss, new_gradient = of(new)
            if new_loss <= loss - 1e-4 * step * (gradient @ way) or step < 1e-9:
                break
            step /= 2
        if not new_loss < loss:
            break
        moved, turned = new - value, new_gradient - gradient
        if (curve := moved @ turned) > 1e-12:
            past = [*past, (moved, turned, 1 / curve)][-memory:]
        gain, value, loss, gradient = loss - new_loss, new, new_loss, new_gradient
        if gain < 1e-6 * max(1.0, loss):
            break
    return value


def fit(chosen: np.ndarray, cells: list[np.ndarray], shares: np.ndarray, grades: np.ndarray, ridge: float = RIDGE, rounds: int = 300) -> Model:
    """Maximum likelihood of the ordered grades 0, 1, 2, ... under a ridge, over the `chosen` cells and the shares."""
    column = np.full(CELLS, -1, dtype=np.int32)
    column[chosen] = np.arange(len(chosen))
    known = np.isfinite(shares)
    mean = np.where(known, shares, 0).sum(axis=0) / np.maximum(1, known.sum(axis=0))
    scale = np.sqrt(np.where(known, (shares - mean) ** 2, 0).sum(axis=0) / np.maximum(1, known.sum(axis=0))) + 1e-3
    columns = [at[at >= 0] for at in (column[c] for c in cells)]
    of = _Likelihood(columns, len(chosen), np.nan_to_num((shares - mean) / scale), grades, ridge)
    value = _descend(of, rounds)
    return Model(column, value[: of.weights], of.thresholds(value), mean, scale)


def _graded(batches: Iterator[pa.RecordBatch], column: np.ndarray | None) -> tuple[list[np.ndarray], list[np.ndarray], list[int], list[int]]:
    cells, shares, grade, ids = [], [], [], []
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        found = {i: (c, s) for i, c, s in _described(texts, column)}
        cells += [found[i][0] for i in range(len(texts))]
        shares += [found[i][1] for i in range(len(texts))]
        grade += batch.column("grade").to_pylist()
        ids += batch.column("doc_id").to_pylist()
    return cells, shares, grade, ids


def _count(steps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((steps + 1, CELLS), dtype=np.int64)
        for batch in batches:
            cells, _, grade, _ = _graded(iter([batch]), None)
            total += count_cells(cells, np.array(grade), steps)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.astype("<i4").tobytes(), 1)], pa.binary())], names=["counts"])

    return run


def _collect(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, shares, grade, ids = _graded(batches, told.value)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grade, pa.int32()), pa.array([c.tobytes() for c in cells], pa.binary()), pa.array([s.tolist() for s in shares], pa.list_(pa.float64()))], names=["doc_id", "grade", "cells", "shares"])

    return run


def train(docs: DataFrame, graded: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from `docs` (doc_id, text) and `graded` (doc_id, grade: 0, 1, ...; rows with a null are left out).

    At most `sample` graded rows are fitted, a fixed choice by hash. None if they hold fewer than two grades.
    """
    some = graded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).where("doc_id is not null and grade is not null")
    some = F.broadcast(some.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample))  # `sample` rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(some, "doc_id")
    rows = materialize(rows.repartition(TASKS), "graded")
    sizes = {r["grade"]: r["n"] for r in rows.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    steps = max(sizes)
    counts = sum(np.frombuffer(zlib.decompress(r["counts"]), dtype="<i4").reshape(steps + 1, CELLS) for r in rows.coalesce(TASKS).mapInArrow(tidy(_count(steps)), "counts binary").collect())
    chosen = select_cells(counts, np.array([sizes.get(k, 0) for k in range(steps + 1)]))
    column = np.full(CELLS, -1, dtype=np.int32)
    column[chosen] = 0
    told = docs.sparkSession.sparkContext.broadcast(column)
    found = rows.mapInArrow(tidy(_collect(told)), "doc_id long, grade int, cells binary, shares array<double>").collect()
    found.sort(key=lambda r: (r["doc_id"], r["grade"], r["cells"]))
    return fit(chosen, [np.frombuffer(r["cells"], dtype=np.int32) for r in found], np.array([r["shares"] for r in found]), np.array([r["grade"] for r in found]))


def _score(told, top: int, names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            expected, tail = np.zeros(len(texts)), np.zeros(len(texts))
            for i, cells, shares in _described(texts, model.column):
                reached = model.reached(model.score(cells, shares))
                expected[i], tail[i] = reached.sum(), reached[top - 1]
            yield batch.append_column(names[0], pa.array(np.round(expected, 6))).append_column(names[1], pa.array(np.round(tail, 6)))

    return run


def classify(df: DataFrame, model: Model | None, top: int = 2) -> DataFrame:
    """`df` with expected_grade and p_top, the probability of grade `top` or better.

    A null text counts as empty. Without a model both are null. Columns of these names in the input are replaced.
    """
    out = spread(df).drop("expected_grade", "p_top").withColumn("text", F.col("text").cast("string"))
    if model is None:
        return out.withColumns({"expected_grade": F.lit(None).cast("double"), "p_top": F.lit(None).cast("double")})
    told = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*out.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("p_top", T.DoubleType())])
    return out.mapInArrow(tidy(_score(told, min(top, len(model.thresholds)), ("expected_grade", "p_top"))), schema)


def grades(labels: DataFrame) -> DataFrame:
    """Grade 0: low quality; 1: good but toxic; 2: good. A null quality has no grade, a null toxic counts as 0."""
    grade = F.when(F.col("quality") < 1, 0).when(F.col("toxic") >= 1, 1).otherwise(2)
    return labels.where("quality is not null").select("doc_id", grade.alias("grade"))


#: A document of the best grade by this probability is kept; with few labels, toxic ones come out between 0.5 and this.
KEEP = 0.8


def kept() -> Column:
    """Without a model nothing is rejected."""
    return F.coalesce(F.col("p_top") >= KEEP, F.lit(True))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return classify(docs, model).select("doc_id", "expected_grade", "p_top", kept().alias("kept"))
