"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

The score of features x is w0 + w.x + sum over pairs of <v_i, v_j> x_i x_j, computed in time
linear in the features as half of |sum v_i x_i|^2 - sum |v_i x_i|^2. It is trained on the driver
with Adagrad on a bounded sample of labelled rows (TRAIN_ROWS, those of the smallest hash), whose
features executors compute; every document is then scored over its whole text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that training uses at most.
TRAIN_ROWS = 6000
#: Buckets of hashed words.
WORDS = 1 << 14
#: Bins of each structure statistic.
BINS = 16
RANK = 8
_SLICE = 256
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_PUNCT = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
_WIDE = bytes(range(128, 256))
_MARKS = b"!*$#%&|<>{}[]=~^_\\"

STATS = ("chars", "words", "word_length", "upper", "digit", "punct", "marks", "distinct", "top", "repeat", "lines", "line_repeat", "line_length", "marked", "wide")


def structure(text: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Structure statistics, each on a scale of about 0 to 1."""
    n, size = max(1, len(words)), max(1, len(text))
    lines = text.split(b"\n")
    return [
        min(1.0, np.log1p(len(text)) / 14),
        min(1.0, np.log1p(len(words)) / 12),
        min(1.0, size / n / 16),
        (len(text) - len(text.translate(None, _UPPER))) / size,
        (len(text) - len(text.translate(None, _DIGIT))) / size,
        min(1.0, (len(text) - len(text.translate(None, _PUNCT))) / size * 2),
        min(1.0, (len(text) - len(text.translate(None, _MARKS))) / size * 2),
        len(counts) / n,
        (max(counts.values()) if counts else 0) / n,
        sum(map(eq, words, words[1:])) / n,
        min(1.0, np.log1p(len(lines)) / 10),
        1 - len(set(lines)) / len(lines),
        min(1.0, np.log1p(size / len(lines)) / 12),
        sum(w[-1] in _MARKS for w in words) / n,
        (len(text) - len(text.translate(None, _WIDE))) / size,
    ]


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) pairs, each index once: words summed by bucket (of unit length together),
    then one bin a statistic; so at most WORDS and a few entries, however long the text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    counts = Counter(words)
    crc = zlib.crc32
    bucket = np.fromiter((crc(w) for w in counts), np.int64, len(counts)) % WORDS
    index, place = np.unique(bucket, return_inverse=True)
    value = np.bincount(place, np.log1p(np.fromiter(counts.values(), np.float64, len(counts))), len(index)).astype(np.float32)
    norm = float(np.sqrt((value * value).sum())) or 1.0
    stats = [*structure(raw, words, counts), min(1.0, np.log1p(max(0, n_chars or 0)) / 14), float(n_chars is None)]
    bins = np.minimum((np.sqrt(np.clip(stats, 0, 1)) * BINS).astype(np.int64), BINS - 1)
    return np.r_[index, WORDS + np.arange(len(stats)) * BINS + bins], np.r_[value / norm, np.full(len(stats), 0.5)].astype(np.float32)


SIZE = WORDS + (len(STATS) + 2) * BINS


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        index, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        starts = np.cumsum([0] + [len(r[0]) for r in rows[:-1]])
        linear = np.add.reduceat(self.w[index] * value, starts)
        parts = self.v[index] * value[:, None]
        total, squares = np.add.reduceat(parts, starts, axis=0), np.add.reduceat(parts * parts, starts, axis=0)
        raw = self.bias + linear + 0.5 * (total * total - squares).sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 6, rate: float = 0.1, decay: float = 2e-4, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss; without rows, or with one class only, the prior alone scores."""
    rng = np.random.default_rng(seed)
    mean = (sum(labels) + 1) / (len(labels) + 2)
    bias, w = float(np.log(mean / (1 - mean))), np.zeros(SIZE, np.float32)
    v = rng.normal(0, 0.02, (SIZE, RANK)).astype(np.float32)
    if len(set(labels)) < 2:
        return Machine(bias, w, v * 0)
    gw, gv, gb = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, RANK), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            index, value = rows[k]
            vi = v[index]
            part = vi * value[:, None]
            total = part.sum(axis=0)
            raw = bias + float(w[index] @ value) + 0.5 * float((total * total).sum() - (part * part).sum())
            slope = 1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30))) - labels[k]
            dw = slope * value + decay * w[index]
            dv = slope * value[:, None] * (total - part) + decay * vi
            gb += slope * slope
            bias -= rate * slope / np.sqrt(gb)
            np.add.at(gw, index, dw * dw)
            np.add.at(w, index, -rate * dw / np.sqrt(gw[index]))
            np.add.at(gv, index, dv * dv)
            np.add.at(v, index, -rate * dv / np.sqrt(gv[index]))
    return Machine(float(bias), w, v)


def _texts(docs: DataFrame) -> DataFrame:
    chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), chars.alias("n_chars"))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Machine:
    """Trains on labelled rows that are not held out; a document that repeats an id counts once."""
    wanted = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id")
        .limit(train_rows)
    )
    # At most train_rows rows of 12 bytes: small at any size of the input.
    rows = _texts(docs).join(F.broadcast(wanted), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.struct("text", "n_chars")).alias("d")).select("doc_id", "quality", "d.text", "d.n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t, n) for t, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            packed = [[x[0].astype("<i4").tobytes() for x in found], [x[1].astype("<f4").tobytes() for x in found]]
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(p, pa.binary()) for p in packed)], names=["doc_id", "quality", "i", "v"])

    got = sorted(rows.mapInArrow(run, "doc_id long, quality int, i binary, v binary").collect())
    return train([(np.frombuffer(r["i"], "<i4"), np.frombuffer(r["v"], "<f4")) for r in got], [r["quality"] for r in got])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """Adds nothing to docs but returns (doc_id, score) per row, null text scored as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                found = [features(t, n) for t, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.record_batch([part.column(0), pa.array(model.scores(found).astype(np.float64))], names=["doc_id", "score"])

    return _texts(docs).mapInArrow(run, "doc_id long, score double")


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    Null and empty texts are scored as empty. Each row is answered by itself, repeated or not; a
    null id is not held out and has no label. Without labelled rows, or with one class only, the
    score is the prior; an empty table gives no rows."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score 0.5 or more, columns unchanged, in one pass without a join.

    Each row is judged by itself: null text as empty, null ids and repeated rows like any other;
    an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    has_chars = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                texts = part.column("text").to_pylist()
                chars = part.column("n_chars").to_pylist() if has_chars else [None] * len(texts)
                keep = model.scores([features(t, n) for t, n in zip(texts, chars, strict=True)]) >= 0.5
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
