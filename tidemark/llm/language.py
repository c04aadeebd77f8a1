"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of hashed n-grams (1 to 3 characters) count over every learning document.
The model is trained with follow-the-regularised-leader under an elastic net, on a bounded sample
(about PER_LANG learning documents a language), and a temperature fitted on a part of that
sample kept aside calibrates its probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Learning documents of each language, about.
PER_LANG = 700
BITS = 14
SIZE = 1 << BITS
_SLICE = 64
_LETTER = re.compile(r"[^\W\d_]")
_CHUNK = 1 << 20
_FOLDS = 64


def _hashes(points: np.ndarray) -> Iterator[np.ndarray]:
    mix = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917)]
    shift = np.uint32(32 - BITS)
    one = points * mix[0]
    yield (one ^ (one >> np.uint32(15))) * mix[1] >> shift
    if len(points) > 1:
        two = (points[:-1] * mix[1] + points[1:]) * mix[2]
        yield (two ^ (two >> np.uint32(15))) * mix[0] >> shift
    if len(points) > 2:
        three = ((points[:-2] * mix[2] + points[1:-1]) * mix[0] + points[2:]) * mix[1]
        yield (three ^ (three >> np.uint32(15))) * mix[2] >> shift


def counts(text: str) -> np.ndarray:
    """How often each n-gram bucket occurs in the whole, lower-cased text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.zeros(SIZE, np.int64)
    for at in range(0, len(points), _CHUNK):
        part = points[max(0, at - 2) : at + _CHUNK]
        for n, h in enumerate(_hashes(part)):
            # n-grams that end before this chunk were counted with the one before
            out += np.bincount(h[max(0, 2 - n) if at else 0 :], minlength=SIZE)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))  # ² is a word character, no letter


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    w: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str) -> np.ndarray:
        return tfidf(counts(text), self.idf)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax((x @ self.w.T + self.bias) / self.temperature)


def tfidf(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(found).astype(np.float32) * idf
    norm = float(np.sqrt(x @ x))
    return x / norm if norm else x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], n_langs: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights (languages x buckets, sparse by l1) and biases."""
    z, n = np.zeros((n_langs, SIZE + 1)), np.zeros((n_langs, SIZE + 1))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(n)) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            index, value = np.r_[rows[k][0], SIZE], np.r_[rows[k][1], 1.0]
            zi, ni = z[:, index], n[:, index]
            w = weights(zi, ni)
            p = softmax(w @ value)
            p[labels[k]] -= 1
            g = p[:, None] * value
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[:, index] = zi + g - sigma * w
            n[:, index] = ni + g * g
    w = weights(z, n).astype(np.float32)
    return w[:, :SIZE], w[:, SIZE]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the smallest log loss."""
    if not len(labels):
        return 1.0
    grid = np.geomspace(0.05, 5, 60)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _learning(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()
    )


def frequencies(learning: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequency of every bucket over all rows, and their number: summed within tasks,
    then within _FOLDS tasks, whose vectors alone reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                for text in batch.slice(at, _SLICE).column(0).to_pylist():
                    df += counts(text) > 0
                    n += 1
        fold = TaskContext.get().partitionId() % _FOLDS
        yield pa.record_batch([pa.array([fold], pa.int32()), pa.array([n], pa.int64()), pa.array([df.tobytes()])], names=["fold", "n", "df"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for k in range(batch.num_rows):
                df += np.frombuffer(batch.column(2)[k].as_py(), np.int64)
                n += batch.column(1)[k].as_py()
        yield pa.record_batch([pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([df.tobytes()])], names=["fold", "n", "df"])

    schema = "fold int, n long, df binary"
    parts = learning.select("text").mapInArrow(count, schema).repartition(_FOLDS, "fold").mapInArrow(add, schema).collect()
    return sum((np.frombuffer(r["df"], np.int64) for r in parts), np.zeros(SIZE, np.int64)), sum(r["n"] for r in parts)


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """The calibrated model, or None where nothing can be learned from."""
    learning = _learning(docs)
    sizes = learning.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return None
    langs = sorted(r["lang"] for r in sizes)
    place = {x: k for k, x in enumerate(langs)}
    df, n = frequencies(learning)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    # Each language's share of rows by hash: about per_lang rows, so at most a few MB a language.
    chance = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_lang / r["n"]))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    sample = learning.where(draw < F.coalesce(F.element_at(chance, F.col("lang")), F.lit(0.0)))
    sample = sample.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(2 * per_lang * len(sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                index, value = [], []
                for text in part.column(1).to_pylist():
                    x = tfidf(counts(text), idf)
                    on = np.flatnonzero(x)
                    index.append(on.astype("<u2").tobytes())
                    value.append(x[on].astype("<f2").tobytes())
                yield pa.record_batch([part.column(0), part.column(2), pa.array(index, pa.binary()), pa.array(value, pa.binary())], names=["doc_id", "lang", "i", "v"])

    got = sorted(sample.mapInArrow(run, "doc_id long, lang string, i binary, v binary").collect())
    rows = [(np.frombuffer(r["i"], "<u2").astype(np.int64), np.frombuffer(r["v"], "<f2").astype(np.float64)) for r in got]
    labels = [place[r["lang"]] for r in got]
    aside = [k for k in range(len(rows)) if k % 5 == 4]
    w, bias = ftrl([r for k, r in enumerate(rows) if k % 5 != 4], [x for k, x in enumerate(labels) if k % 5 != 4], len(langs))
    logits = np.array([w[:, rows[k][0]] @ rows[k][1] + bias for k in aside]).reshape(len(aside), len(langs))
    return Model(langs, idf, w, bias, temperature(logits, np.array([labels[k] for k in aside], dtype=np.int64)))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) per row: `und` with score 0 for null text, text without a
    letter, or where nothing was learned."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                texts = part.column(1).to_pylist()
                said, sure = ["und"] * len(texts), np.zeros(len(texts))
                known = [k for k, t in enumerate(texts) if own is not None and has_letter(t)]
                if known:
                    p = own.probabilities(np.stack([own.vector(texts[k]) for k in known]))
                    for k, row in zip(known, p, strict=True):
                        best = int(row.argmax())
                        said[k], sure[k] = own.langs[best], float(row[best])
                yield pa.record_batch([part.column(0), pa.array(said, pa.string()), pa.array(sure)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    Null text and text without a letter, empty and blank text among them, are `und` with score 0,
    and so is every row where nothing was learned. Each row is answered by itself, repeated or
    not; a null id is not held out; of equal chances the language first in order is said; an empty
    table gives no rows. Texts are read whole, whatever their length."""
    out = predict(docs, fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
