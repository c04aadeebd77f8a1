"""Vector code compression: product codes from integer codebooks.

A vector's components become integers, its parts are coded by the nearest entry of their
position's codebook, and the codebooks are refined in rounds. In each round every task gets a
kd-tree a codebook (as many bytes as the entries, whatever the table holds), finds the nearest
entry of every part by branch and bound, and emits one integer sum and count for each entry and
component it met; sums of sums are the new entries. The search enters every box that is not
farther than the best so far, equal ones included, so that of entries at the same distance the
lowest index is always found. All arithmetic is on integers, so neither the order of rows nor
their partitions change a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Entries of a leaf of a tree at most.
LEAF = 2
#: Rows that a search takes at a time.
_ROWS = 8192


def width_of(dim: int, parts: int) -> int:
    """Components of a part; vectors whose length parts does not divide end in zeros."""
    return max(1, -(-dim // parts))


def limit_of(width: int) -> int:
    """Largest absolute component for which a part's squared distance fits a long."""
    return int((2**62 // width) ** 0.5) // 2


@dataclass
class _Node:
    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray
    axis: int = 0
    split: int = 0
    left: _Node | None = None
    right: _Node | None = None


def tree_of(book: np.ndarray, entries: np.ndarray | None = None) -> _Node:
    """kd-tree of a codebook's entries, each node with the box of what lies below it."""
    entries = np.arange(len(book)) if entries is None else entries
    points = book[entries]
    node = _Node(points.min(axis=0), points.max(axis=0), entries)
    if len(entries) > LEAF:
        node.axis = int(np.argmax(node.high - node.low))
        order = entries[np.argsort(points[:, node.axis], kind="stable")]
        half = len(order) // 2
        node.split = int(book[order[half], node.axis])
        node.left, node.right = tree_of(book, order[:half]), tree_of(book, order[half:])
    return node


def nearest(book: np.ndarray, root: _Node, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row of x, the lowest index of equals."""
    best = np.full(len(x), np.iinfo(np.int64).max)
    index = np.full(len(x), len(book), np.int64)

    def visit(node: _Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.left is None:
            for k in np.sort(node.entries):
                off = x[rows] - book[k]
                d = np.einsum("ij,ij->i", off, off)
                won = (d < best[rows]) | ((d == best[rows]) & (k < index[rows]))
                best[rows[won]], index[rows[won]] = d[won], k
            return
        below = x[rows, node.axis] < node.split
        for first, second, own in ((node.left, node.right, rows[below]), (node.right, node.left, rows[~below])):
            visit(first, own)
            off = np.maximum(0, np.maximum(second.low - x[own], x[own] - second.high))
            visit(second, own[np.einsum("ij,ij->i", off, off) <= best[own]])

    visit(root, np.arange(len(x)))
    return index, best


def _integers(scale: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_vector")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            there = lists.is_valid().to_numpy(zero_copy_only=False)
            keep, packed, dims = [], [], []
            for k, (start, end) in enumerate(zip(ends - sizes, ends, strict=True)):
                v = values[start:end]
                if there[k] and np.isfinite(v).all():
                    width = width_of(len(v), parts)
                    top = limit_of(width)
                    whole = np.zeros(width * parts, "<i4")
                    with np.errstate(over="ignore"):
                        whole[: len(v)] = np.clip(np.floor(scale * v), -top, top)
                    keep.append(k)
                    packed.append(whole.tobytes())
                    dims.append(len(v))
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.record_batch([kept.column("_id"), kept.column("_label"), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], names=["_id", "_label", "dim", "packed"])

    return run


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(_id, _label, dim, packed): rows whose vector is usable, its integers as bytes."""
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vec_col).alias("_vector"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(_integers(scale, parts), f"_id {kinds['_id']}, _label {kinds['_label']}, dim int, packed binary")


def _whole(packed: list[bytes], parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<i4").reshape(len(packed), parts, -1).astype(np.int64)


def _met(batches: Iterator[pa.RecordBatch], books: dict[int, np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per run of rows of one length: batch, row numbers, length, parts, indexes and distances."""
    trees = {dim: [tree_of(b) for b in book] for dim, book in books.items()}
    for batch in batches:
        dims, packed = batch.column("dim").to_numpy(), batch.column("packed")
        for dim in np.unique(dims):
            book, own = books[int(dim)], np.flatnonzero(dims == dim)
            for at in range(0, len(own), _ROWS):
                rows = own[at : at + _ROWS]
                x = _whole(packed.take(pa.array(rows)).to_pylist(), len(book))
                found = [nearest(b, t, x[:, p]) for p, (b, t) in enumerate(zip(book, trees[int(dim)], strict=True))]
                yield batch, rows, int(dim), x, np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _sums(books: dict[int, np.ndarray]):
    """A task's sums: one row for each entry and component that its rows met. Sums are kept in two
    halves, so that no number of rows a task can hold overflows them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = {dim: np.zeros(book.shape, np.int64) for dim, book in books.items()}
        high = {dim: np.zeros(book.shape, np.int64) for dim, book in books.items()}
        counts = {dim: np.zeros(book.shape[:2], np.int64) for dim, book in books.items()}
        for _, _, dim, x, index, _ in _met(batches, books):
            for p in range(x.shape[1]):
                np.add.at(low[dim][p], index[:, p], x[:, p] & 0xFFFF)
                np.add.at(high[dim][p], index[:, p], x[:, p] >> 16)
                counts[dim][p] += np.bincount(index[:, p], minlength=counts[dim].shape[1])
        for dim, n in counts.items():
            part, entry = np.nonzero(n)
            width = low[dim].shape[2]
            flat = [np.repeat(a, width) for a in (part, entry, n[part, entry])]
            columns = [np.full(len(flat[0]), dim), flat[0], flat[1], np.tile(np.arange(width), len(part)), flat[2], low[dim][part, entry].ravel(), high[dim][part, entry].ravel()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 4 + [pa.int64()] * 3, strict=True)], names=["dim", "part", "entry", "place", "n", "low", "high"])

    return run


def _codes(books: dict[int, np.ndarray], kinds: str):
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, _, _, index, distance in _met(batches, books):
            code = [bytes(r).hex() for r in index.astype(np.uint8)]
            kept = batch.take(pa.array(rows))
            yield pa.record_batch([kept.column("_id"), kept.column("_label"), kept.column("dim"), pa.array(code, pa.string()), pa.array(distance.tolist(), pa.list_(pa.int64()))], names=names)

    return run


def first_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> dict[int, np.ndarray]:
    """Codebooks (part, entry, component) by vector length, from the vectors of the smallest ids."""
    first = Window.partitionBy("dim").orderBy(F.col("_id").asc_nulls_last(), "packed")
    seeds = rows.select("_id", "dim", "packed").withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= entries).orderBy("dim", "_rank").collect()
    books: dict[int, list[bytes]] = {}
    for r in seeds:
        books.setdefault(r.dim, []).append(bytes(r.packed))
    return {dim: _whole(packed, parts).transpose(1, 0, 2).copy() for dim, packed in books.items()}


def refined(rows: DataFrame, books: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The codebooks after one round: each used entry the floor of the mean of its parts."""
    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums = rows.select("dim", "packed").mapInArrow(_sums(books), "dim int, part int, entry int, place int, n long, low long, high long")
    out = {dim: book.copy() for dim, book in books.items()}
    for r in sums.groupBy("dim", "part", "entry", "place").agg(big("n"), big("low"), big("high")).collect():
        out[r.dim][r.part, r.entry, r.place] = (int(r.low) + (int(r.high) << 16)) // int(r.n)
    return out


def book_digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


@dataclass
class Coded:
    """rows: (_id, _label, dim, code, errors by part); books: the final codebooks by length."""

    rows: DataFrame
    books: dict[int, np.ndarray]


def compressed(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Coded:
    """Codes of all usable vectors and the codebooks that give them.

    A vector that is null or holds a null or non-finite component has no row. Vectors of another
    length have codebooks of their own; a length that parts does not divide is filled with zeros,
    and an empty vector is one zero a part. Components so large that a squared distance would not
    fit a long (|x| above 160,000 at 64 components) are held at that limit. Null ids come after
    all others in the first codebooks, and rows of one id go by their components. Repeated rows
    keep a row each. With fewer rows than entries a codebook has as many entries as rows. An
    empty table gives no rows and no codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    rows = cut(integer_vectors(vectors, id_col, vec_col, label_col, parts, scale))
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books else 0):
        books = refined(rows, books)
    kinds = dict(rows.dtypes)
    schema = f"_id {kinds['_id']}, _label {kinds['_label']}, dim int, code string, errors array<bigint>"
    return Coded(rows.mapInArrow(_codes(books, schema), schema), books)


def code_report(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", **rules) -> DataFrame:
    """Per usable vector: vec_id, code, error, label_error (errors of its label's rows, null labels
    together; null where that exceeds a long), codebooks_sha256. Odd rows are as in compressed()."""
    coded = compressed(vectors, id_col, vec_col, label_col, **rules)
    wide = F.aggregate("errors", F.lit(0).cast("decimal(38,0)"), lambda a, e: (a + e).cast("decimal(38,0)"))
    rows = cut(coded.rows.select("_id", "_label", "dim", "code", wide.alias("_error")))
    totals = cut(rows.groupBy(F.col("_label").alias("_of")).agg(F.sum("_error").alias("_total")))
    digest = F.lit(None).cast("string")
    for dim, book in coded.books.items():
        digest = F.when(F.col("dim") == dim, F.lit(book_digest(book))).otherwise(digest)
    long = lambda c: F.expr(f"try_cast({c} AS bigint)")
    return rows.join(totals, F.col("_label").eqNullSafe(F.col("_of"))).select(
        F.col("_id").alias("vec_id"), "code", long("_error").alias("error"), long("_total").alias("label_error"), digest.alias("codebooks_sha256")
    )


def _rounds_sql(rounds: int) -> str:
    out = []
    for k in range(rounds + 1):
        out.append(
            f"""a{k} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, d * 16 + entry) AS entry, min(d) AS d FROM (
  SELECT p.vec_id, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x))::HUGEINT AS d FROM p JOIN b{k} b ON p.part = b.part AND p.place = b.place GROUP BY ALL) GROUP BY ALL)"""
        )
        if k < rounds:
            out.append(
                f"""m{k} AS MATERIALIZED (SELECT p.part, a.entry, p.place, sum(p.x)::HUGEINT AS s, count(*) AS c FROM p JOIN a{k} a ON p.vec_id = a.vec_id AND p.part = a.part GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.place, coalesce(((m.s - ((m.s % m.c) + m.c) % m.c) // m.c)::BIGINT, b.x) AS x FROM b{k} b LEFT JOIN m{k} m ON b.part = m.part AND b.entry = m.entry AND b.place = m.place)"""
            )
    return ",\n".join(out)


SQL = f"""
WITH e AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, (k - 1) // (n // {PARTS}) AS part, (k - 1) % (n // {PARTS}) AS place, floor({SCALE} * v[k])::BIGINT AS x
  FROM (SELECT vec_id, v, len(v) AS n, unnest(range(1, len(v) + 1)) AS k FROM e)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e QUALIFY entry < {ENTRIES}),
b0 AS MATERIALIZED (SELECT p.part, s.entry, p.place, p.x FROM p JOIN s ON p.vec_id = s.vec_id),
{_rounds_sql(ROUNDS)},
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id),
l AS (SELECT e.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY e.label)::BIGINT AS label_error FROM e JOIN c ON e.vec_id = c.vec_id)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) FROM b{ROUNDS}) AS codebooks_sha256 FROM l
"""
