"""Language ID with error-correcting output codes.

Each learned language has a codeword; one binary classifier of hashed letter n-grams predicts each bit. A text gets the
language whose codeword loses least against all bits together, each weighted by the loss of its own margin, so a few bits that
are wrong are outvoted. Where a second codeword is nearly as near, the prediction is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchwork.llm._memory import tidy
from parchwork.llm.quality import _descend
from parchwork.plans.session import materialize, spread

UNDETERMINED = "und"
#: Documents that are fitted at most (each whole, and a piece of a few words of it), hash cells of n-grams, cells that enter the fit.
SAMPLE, CELLS, FEATURES = 4_000, 1 << 16, 4_096
#: Letters in an n-gram at most, and letters that are looked at together.
GRAM, CHUNK = 3, 1 << 20
#: Weight of the squared weights in the fit; temperatures that decoding tries; share of the sample that chooses among them.
RIDGE, TEMPERATURES, ASIDE = 1e-3, (0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), 5
#: Tasks that read the sample.
TASKS = 16
#: Ambiguous: the second language has at least this share of the first one's probability.
AMBIGUOUS = 0.25


def codewords(k: int) -> np.ndarray:
    """A row of +1 and -1 for each of `k` languages.

    Up to seven languages: every way to part them in two, so any two rows differ in 2^(k-2) bits. Beyond: rows of
    the Sylvester matrix of the next power of two, without the constant column, which differ in half of its order.
    """
    if k <= 7:
        parts = np.arange(1, 1 << max(0, k - 1))
        return np.array([np.where((parts >> (k - 1 - row)) & 1, 1, -1) for row in range(k)]).reshape(k, len(parts))
    order = 1 << (k - 1).bit_length()
    row, column = np.arange(k)[:, None], np.arange(1, order)[None, :]
    return np.where(np.bitwise_count(row & column) & 1, -1, 1)


_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def grams(text: str) -> Iterator[np.ndarray]:
    """Hash cells of all n-grams of letters in `text`, lower-cased, a stretch of anything else being one blank, as is a seam between chunks."""
    for at in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes = np.where(_is_letter()[codes], codes, 0)
        codes = np.concatenate([[0], codes, [0]]).astype(np.uint32)
        codes = codes[(codes != 0) | np.concatenate([[True], codes[:-1] != 0])]
        if len(codes) < 3:
            continue
        h, found = np.zeros(len(codes), dtype=np.uint32), []
        for n in range(1, GRAM + 1):
            h = (h[: len(codes) - n + 1] * np.uint32(0x01000193) ^ codes[n - 1 :]) * np.uint32(0x9E3779B1)
            found.append((h ^ (h >> np.uint32(15))) & np.uint32(CELLS - 1))
        yield np.concatenate(found)


def counted(text: str, column: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Counts by cell, or by place in `column` (-1: none), and the number of n-grams, 0 if there is no letter."""
    width = CELLS if column is None else int(column.max(initial=-1)) + 2
    counts, n = np.zeros(width, dtype=np.int64), 0
    for cells in grams(text):
        counts += np.bincount(cells if column is None else column[cells] + 1, minlength=width)
        n += len(cells)
    return counts if column is None else counts[1:], n


def features(text: str, column: np.ndarray) -> np.ndarray | None:
    """Counts over the root of their number: evidence grows with the root of the length. None without a letter."""
    counts, n = counted(text, column)
    return (counts / np.sqrt(n)).astype(np.float32) if n else None


def piece(text: str, h: int) -> str:
    """Some 1 to 12 words at a place that `h` names."""
    words = text.split()
    at = h % max(1, len(words))
    return " ".join(words[at : at + 1 + (h >> 20) % 12])


class Model(NamedTuple):
    languages: list[str]
    codes: np.ndarray
    column: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Probability of each language."""
        return decode(self.codes, (x @ self.weights + self.bias)[None, :], self.temperature)[0]


def decode(codes: np.ndarray, margins: np.ndarray, temperature: float) -> np.ndarray:
    """Each text's languages by the summed logistic losses of its bits' margins against the codewords."""
    loss = np.logaddexp(0, -margins[:, None, :] * codes[None, :, :]).sum(axis=2) * temperature
    near = np.exp(loss.min(axis=1, keepdims=True) - loss)
    return near / near.sum(axis=1, keepdims=True)


class _Bits:
    """Minus the penalised log-likelihood of all bits' classifiers together, and its gradient."""

    def __init__(self, x: np.ndarray, bits: np.ndarray, share: np.ndarray):
        self.x, self.bits, self.share, self.shape = x, bits, share[:, None], (x.shape[1] + 1, bits.shape[1])

    def begin(self) -> np.ndarray:
        return np.zeros(self.shape[0] * self.shape[1])

    def __call__(self, value: np.ndarray) -> tuple[float, np.ndarray]:
        w = value.reshape(self.shape)
        agree = self.bits * (self.x @ w[:-1].astype(np.float32) + w[-1])
        slope = -self.bits * self.share * 0.5 * (1 - np.tanh(0.5 * agree))
        gradient = np.vstack([self.x.T @ slope.astype(np.float32), slope.sum(axis=0)[None, :]]).astype(np.float64)
        gradient[:-1] += RIDGE * w[:-1]
        return float((self.share * np.logaddexp(0, -agree)).sum() + RIDGE / 2 * (w[:-1] ** 2).sum()), gradient.ravel()


def fit(languages: list[str], column: np.ndarray, x: np.ndarray, of: np.ndarray, rounds: int = 200) -> Model:
    """A model from rows `x` of the languages with numbers `of`. Each language weighs the same; each fifth row only sets the temperature."""
    codes = codewords(len(languages))
    aside = np.arange(len(of)) % ASIDE == ASIDE - 1

    def weights(rows: np.ndarray) -> np.ndarray:
        counts = np.bincount(of[rows], minlength=len(languages))
        return 1 / counts[of[rows]] / np.count_nonzero(counts) * 100

    used = _Bits(x[~aside], codes[of[~aside]], weights(~aside))
    value = (_descend(used, rounds) if codes.size else used.begin()).reshape(used.shape)
    temperature = 1.0
    if aside.any():
        margins, w = x[aside] @ value[:-1] + value[-1], weights(aside)
        told = [(w * np.log(np.maximum(decode(codes, margins, t)[np.arange(len(w)), of[aside]], 1e-12))).sum() for t in TEMPERATURES]
        temperature = TEMPERATURES[int(np.argmax(told))]
    return Model(languages, codes, column, value[:-1].astype(np.float32), value[-1].astype(np.float32), temperature)


def _count(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = np.zeros((len(languages), CELLS))
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts, n = counted(text)
                if n:
                    shares[languages.index(lang)] += counts / n
        yield pa.RecordBatch.from_arrays([pa.array([shares.astype("<f4").tobytes()], pa.binary())], names=["shares"])

    return run


def _describe(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, lang, text in zip(batch.column("h").to_pylist(), batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                out += [(h, lang, x.astype("<f2").tobytes()) for x in (features(t, told.value) for t in (text, piece(text, h & (1 << 62) - 1))) if x is not None]
            h, lang, x = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(lang, pa.string()), pa.array(x, pa.binary())], names=["h", "lang", "x"])

    return run


def sample_of(docs: DataFrame, sample: int) -> tuple[DataFrame, list[str]]:
    """h, lang, text of at most `sample` documents, and the languages. Each language gives as many as it has up to its even share."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("doc_id is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return rows.select(F.lit(0).cast("long").alias("h"), "lang", "text").limit(0), []
    rate = F.create_map(*(F.lit(v) for lang in languages for v in (lang, min(1.0, sample / len(languages) / sizes[lang]))))
    h = F.xxhash64("doc_id", "lang")
    few = rows.select(h.alias("h"), "doc_id", "lang").where(F.pmod("h", F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20)).distinct().orderBy("h", "doc_id", "lang").limit(sample)
    # rows of one doc_id and language count as one document; the broadcast side has `sample` rows at most
    found = rows.join(F.broadcast(few), ["doc_id", "lang"]).groupBy("h", "lang").agg(F.min("text").alias("text")).where("text is not null")
    return found, languages


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from `docs` (doc_id, lang, text; rows with a null are left out), None without languages.

    At most `sample` documents are fitted, chosen by a hash of doc_id, as many of each language as it has up to an even share. The
    features are the n-grams that make up the largest share of the n-grams of some language in the sample.
    """
    found, languages = sample_of(docs, sample)
    if not languages:
        return None
    found = materialize(found.repartition(TASKS), "languages")
    shares = sum(np.frombuffer(r["shares"], dtype="<f4").reshape(len(languages), CELLS).astype(float) for r in found.coalesce(TASKS).mapInArrow(tidy(_count(languages)), "shares binary").collect())
    chosen = np.sort(np.argsort(-(shares / np.maximum(1e-9, shares.sum(axis=1, keepdims=True))).max(axis=0), kind="stable")[:FEATURES])
    column = np.full(CELLS, -1, dtype=np.int64)
    column[chosen] = np.arange(len(chosen))
    told = docs.sparkSession.sparkContext.broadcast(column)
    rows = found.mapInArrow(tidy(_describe(told)), "h long, lang string, x binary").collect()  # two for each document of the sample
    rows.sort(key=lambda r: (r["h"], r["lang"], r["x"]))
    x = np.array([np.frombuffer(r["x"], dtype="<f2") for r in rows], dtype=np.float32).reshape(len(rows), len(chosen))
    return fit(languages, column, x, np.array([languages.index(r["lang"]) for r in rows], dtype=np.int64))


def _predict(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        for batch in batches:
            lang, score, second, ambiguous = [], [], [], []
            for text in batch.column("text"):
                x = features(text.as_py() or "", model.column)
                p = model.decode(x) if x is not None else None
                order = np.argsort(-p, kind="stable") if p is not None else []
                lang.append(model.languages[order[0]] if len(order) else UNDETERMINED)
                score.append(round(float(p[order[0]]), 6) if len(order) else 0.0)
                second.append(model.languages[order[1]] if len(order) > 1 else None)
                ambiguous.append(bool(len(order) > 1 and p[order[1]] >= AMBIGUOUS * p[order[0]]))
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(second, pa.string()), pa.array(ambiguous, pa.bool_())],
                names=[*names, "lang_pred", "score", "lang_second", "ambiguous"],
            )

    return run


_NEW = {"lang_pred": T.StringType(), "score": T.DoubleType(), "lang_second": T.StringType(), "ambiguous": T.BooleanType()}


def identify(df: DataFrame, model: Model | None) -> DataFrame:
    """`df` with lang_pred, score (0 to 1), lang_second and ambiguous in place of text, each row by its text alone.

    A text that is null or has no letter, or any text without a model, is `und` with score 0. Columns of these names in
    the input are replaced. An empty table gives no rows.
    """
    rows = spread(df).drop(*_NEW).withColumn("text", F.col("text").cast("string"))
    if model is None:
        plain = {"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0), "lang_second": F.lit(None).cast("string"), "ambiguous": F.lit(False)}
        return rows.drop("text").withColumns(plain)
    told = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"] + [T.StructField(n, t) for n, t in _NEW.items()])
    return rows.mapInArrow(tidy(_predict(told)), schema)


def held_out() -> Column:
    """A document without an id is not held out, and not learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op13_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.select("doc_id", "lang", "text").where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
