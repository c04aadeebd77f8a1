"""Embedding near-dedup by int8 tile products with rigorous error bounds.

A unit vector u is stored as s * q with int8 q, and e = |u - s * q| is computed in double for
each vector. For two vectors |u.v - s t (q.r)| <= e + f + 3 e f, so only pairs whose integer
product reaches the threshold less that bound can link. Integer products of a tile pair are
exact (below 2^24 they run as a float32 matrix product).

Two rounds: the first moves only the int8 tiles and names the vectors that may link with any
other; the second does the tile products of those vectors alone, with the stored vectors beside
them, and recomputes in double precision the pairs that may reach the threshold. Equal vectors
are one row with a multiplicity before tiles are made. A tile pair emits, per vector, its number
of links and one edge to the root of its group within the pair, never its pairs.

The tiles of a dimension are laid out on a triangle: each pair of tiles is one group of at most
two rows of bounded size. The arithmetic of the first round is quadratic in the distinct vectors,
as the method is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.graph import connected_components
from tidemark.session import cut

THRESHOLD = 0.9
#: Vectors of a tile at most, and the bytes that they may have as doubles (one vector always fits).
TILE, TILE_BYTES = 8192, 32 << 20
_ROWS = 512


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, key): the vector as packed doubles; null where it can link with nothing."""
    for batch in batches:
        lists = batch.column(1)
        flat = lists.flatten()
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        sizes = np.diff(np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        ends = np.cumsum(sizes)
        out: list[bytes | None] = []
        for start, end in zip(ends - sizes, ends, strict=True):
            v = values[int(start) : int(end)]
            top = np.abs(v).max() if len(v) and np.isfinite(v).all() else 0.0
            out.append((v + 0.0).tobytes() if top > 0 else None)
        yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "key"])


def _unit(raw: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(raw), dtype=np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x, np.sqrt((x * x).sum(axis=1))


def _tile(frame: pd.DataFrame) -> pd.DataFrame:
    dim = int(frame["dim"].iloc[0])
    frame = frame.sort_values("rep")
    x, norm = _unit(list(frame["key"]), dim)
    u = x / norm[:, None]
    scale = np.abs(u).max(axis=1) / 127.0
    q = np.rint(u / scale[:, None]).astype(np.int8)
    err = np.sqrt(((u - q * scale[:, None]) ** 2).sum(axis=1)) + 1e-12
    return pd.DataFrame(
        {
            "dim": [dim],
            "tile": [int(frame["tile"].iloc[0])],
            "tiles": [int(frame["tiles"].iloc[0])],
            "rep": [frame["rep"].to_numpy(np.int64).tobytes()],
            "mult": [frame["mult"].to_numpy(np.int64).tobytes()],
            "q": [q.tobytes()],
            "scale": [scale.tobytes()],
            "err": [err.tobytes()],
            "full": [b"".join(frame["key"])],
        }
    )


def _slim(frame: pd.DataFrame) -> pd.DataFrame:
    return _tile(frame).assign(mult=b"", full=b"")


_TILE_SCHEMA = "dim int, tile int, tiles int, rep binary, mult binary, q binary, scale binary, err binary, full binary"


class _Side:
    def __init__(self, row: pd.Series, dim: int) -> None:
        self.rep, self.mult = np.frombuffer(row["rep"], np.int64), np.frombuffer(row["mult"], np.int64)
        kind = np.float32 if 127 * 127 * dim < 1 << 24 else np.float64
        self.q = np.frombuffer(row["q"], np.int8).reshape(-1, dim).astype(kind)
        self.scale, self.err = np.frombuffer(row["scale"]), np.frombuffer(row["err"])
        if row["full"]:
            self.x, self.norm = _unit([row["full"]], dim)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index linked with each of n indexes, through any links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _candidates(a: _Side, b: _Side, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that may reach the threshold, by blocks of rows; i < j within one tile."""
    slack, top = b.err.max(), b.scale.max()
    for at in range(0, len(a.rep), _ROWS):
        rows = slice(at, at + _ROWS)
        product = a.q[rows] @ b.q.T
        need = (threshold - a.err[rows] - slack - 3 * a.err[rows] * slack) / (a.scale[rows] * top) - 1e-3
        i, j = np.nonzero(product >= need[:, None])
        value = product[i, j] * (a.scale[rows][i] * b.scale[j])
        i += at
        keep = value >= threshold - a.err[i] - b.err[j] - 3 * a.err[i] * b.err[j] - 1e-12
        if same:
            keep &= i < j
        yield i[keep], j[keep]


def _pairs(a: _Side, b: _Side, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose cosine in double precision reaches the threshold."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, j in _candidates(a, b, same, threshold):
        for part in range(0, len(i), 65536):
            p, r = i[part : part + 65536], j[part : part + 65536]
            cosine = np.einsum("ij,ij->i", a.x[p], b.x[r]) / (a.norm[p] * b.norm[r])
            hit = cosine >= threshold
            left.append(p[hit])
            right.append(r[hit])
    return np.concatenate(left), np.concatenate(right)


def _sides(frame: pd.DataFrame) -> tuple[_Side, _Side, bool]:
    sides = [_Side(row, int(row["dim"])) for _, row in frame.sort_values("tile").iterrows()]
    return sides[0], sides[-1], frame["first"].iloc[0] == frame["second"].iloc[0]


def _hopeful(threshold: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        a, b, same = _sides(frame)
        marks = np.zeros(len(a.rep), bool), np.zeros(len(b.rep), bool)
        for i, j in _candidates(a, b, same, threshold):
            marks[0][i] = True
            marks[1][j] = True
        return pd.DataFrame({"rep": np.unique(np.r_[a.rep[marks[0]], b.rep[marks[1]]])})

    return run


def _product(threshold: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        a, b, same = _sides(frame)
        i, j = _pairs(a, b, same, threshold)
        rep, mult = (a.rep, a.mult) if same else (np.r_[a.rep, b.rep], np.r_[a.mult, b.mult])
        j = j if same else j + len(a.rep)
        n = np.bincount(i, mult[j], len(rep)) + np.bincount(j, mult[i], len(rep))
        linked = np.flatnonzero(n)
        least = np.full(len(rep), np.iinfo(np.int64).max)
        root = _roots(i, j, len(rep))
        np.minimum.at(least, root, rep)
        return pd.DataFrame({"rep": rep[linked], "n": n[linked].astype(np.int64), "root": least[root[linked]]})

    return run


def _met(distinct: DataFrame, tile: int, make, compare, schema: str) -> DataFrame:
    """compare() over every pair of tiles of the distinct vectors, each group one or two rows."""
    fit = F.greatest(F.lit(1), F.least(F.lit(tile), F.floor(F.lit(TILE_BYTES) / (8 * F.col("dim")))))
    sizes = distinct.groupBy("dim").agg(F.count("*").alias("n")).select("dim", F.ceil(F.col("n") / fit).cast("int").alias("tiles"))
    dealt = distinct.join(sizes, "dim").withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles").cast("long")).cast("int"))
    made = cut(dealt.groupBy("dim", "tile").applyInPandas(make, _TILE_SCHEMA))
    # A tile that hashing left empty has no row; its pairs come as one tile, which then meets nothing.
    placed = (
        made.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumn("first", F.least("tile", "other"))
        .withColumn("second", F.greatest("tile", "other"))
        .drop("other")
    )
    full = F.count("*").over(Window.partitionBy("dim", "first", "second"))
    placed = placed.withColumn("met", full).where((F.col("first") == F.col("second")) | (F.col("met") == 2)).drop("met")
    return cut(placed.groupBy("dim", "first", "second").applyInPandas(compare, schema))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    A vector that is null, empty, zero or holds a null or non-finite component links with
    nothing, nor does one of another length; a null id links with nothing. Repeated ids each get
    a row and share a component. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"))
    rows = cut(rows.mapInArrow(_keys, "vec_id long, key binary"))
    distinct = rows.where("vec_id is not null and key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"))
    distinct = cut(distinct.withColumn("dim", (F.length("key") / 8).cast("int")))
    hopeful = _met(distinct, tile, _slim, _hopeful(threshold), "rep long").distinct()
    near = cut(distinct.join(hopeful, "rep", "left_semi"))
    found = _met(near, tile, _tile, _product(threshold), "rep long, n long, root long")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    groups = connected_components(found, "rep", "root")
    facts = (
        distinct.select("key", "rep", "mult")
        .join(counts, "rep", "left")
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", "mult", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "rep").alias("component"))
    )
    facts = cut(facts)
    joined = rows.join(facts.withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce(F.col("n") + F.col("mult") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS reach FROM v UNION SELECT r.node, l.y FROM r JOIN l ON r.reach = l.x),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.node = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""
