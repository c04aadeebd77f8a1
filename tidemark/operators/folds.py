"""Ordered folds: operators whose next decision depends on the rows kept so far.

A window frame cannot see what it decided before, so a key's rows fold in order, as an array
aggregate inside the JVM where the state is small, or over one key's frame on an Arrow batch.
Rows are narrow (an id, times, a score); details join back by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut


def pieces(rows: DataFrame, key: str, t: str, apart: Callable[[Column], Column]) -> DataFrame:
    """Adds _piece: a key's rows in time order, cut where the step between neighbours satisfies
    apart. Where no decision reaches over such a step, pieces fold by themselves and a key of many
    rows spreads over tasks; only the numbering runs along a key, one row at a time."""
    along = Window.partitionBy(key).orderBy(t)
    step = F.coalesce(apart(F.col(t) - F.lag(t).over(along)), F.lit(False)).cast("int")
    return rows.withColumn("_step", step).withColumn("_piece", F.sum("_step").over(along.rangeBetween(Window.unboundedPreceding, 0))).drop("_step")


def nms(rows: DataFrame, key: str, t: str, score: str, gap: float, inclusive: bool = False) -> DataFrame:
    """(key, t, score) kept by greedy suppression: by score, then time, a row stays unless it is
    nearer than gap (or at it, if inclusive) to one that stayed. Steps that suppress nothing cut a
    key into pieces. Rows without a time or score are left out."""
    item = F.struct((-F.col(score)).alias("s"), F.col(t).alias("t"))
    near = (lambda d: d <= gap) if inclusive else (lambda d: d < gap)
    kept = F.aggregate(
        F.array_sort(F.collect_list(item)),
        F.array().cast("array<struct<s:double,t:double>>"),
        lambda acc, x: F.when(F.exists(acc, lambda k: near(F.abs(k["t"] - x["t"]))), acc).otherwise(F.concat(acc, F.array(x))),
    )
    there = rows.where(F.col(t).isNotNull() & F.col(score).isNotNull()).select(F.col(key).alias("_key"), F.col(t).cast("double").alias(t), F.col(score).cast("double").alias(score))
    out = pieces(there, "_key", t, lambda d: ~near(d)).groupBy("_key", "_piece").agg(kept.alias("_kept"))
    return out.select("_key", F.explode("_kept").alias("_k")).select(F.col("_key").alias(key), F.col("_k.t").alias(t), (-F.col("_k.s")).alias(score))


def tolerance_times(rows: DataFrame, key: str, t: str, tolerance: float) -> DataFrame:
    """Times of each key less those within tolerance of the last kept one, in time order. A step
    beyond the tolerance always keeps the later time, and cuts a key into pieces."""
    kept = F.aggregate(
        F.array_sort(F.collect_set(t)),
        F.array().cast("array<double>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x - F.element_at(acc, -1) <= tolerance), acc).otherwise(F.concat(acc, F.array(x))),
    )
    there = rows.where(F.col(t).isNotNull()).select(F.col(key).alias("_key"), F.col(t).cast("double").alias(t))
    cuts = pieces(there, "_key", t, lambda d: d > tolerance)
    return cuts.groupBy("_key", "_piece").agg(kept.alias("_kept")).select(F.col("_key").alias(key), F.explode("_kept").alias(t))


def budget_guard(rows: DataFrame, key: str, ident: str, length: str, order: list[Column], target: Column, only_above: Column, always: Column | None = None, first: bool = False) -> DataFrame:
    """(key, ident, kept) of a skip-and-fill budget per key.

    Where the total length does not exceed only_above, every row stays. Otherwise rows are
    visited in order; a row stays if always holds (it still uses budget), if it is the first and
    first is set, or if the used budget with it does not exceed target; rows left out use nothing.
    target and only_above are columns of the key's rows (the same in each).
    """
    total = F.sum(length).over(Window.partitionBy(key))
    ranked = rows.withColumn("_total", total).withColumn("_pos", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    item = F.struct(F.col("_pos").alias("p"), F.col(ident).cast("long").alias("i"), F.col(length).cast("double").alias("d"), (always if always is not None else F.lit(False)).alias("a"), target.alias("g"))

    def visit(acc: Column, x: Column) -> Column:
        fits = x["a"] | (acc["used"] + x["d"] <= x["g"])
        if first:
            fits = fits | (x["p"] == 1)
        return F.when(fits, F.struct((acc["used"] + x["d"]).alias("used"), F.concat(acc["kept"], F.array(x["i"])).alias("kept"))).otherwise(acc)

    start = F.struct(F.lit(0.0).alias("used"), F.array().cast("array<bigint>").alias("kept"))
    per = ranked.groupBy(key).agg(F.aggregate(F.array_sort(F.collect_list(item)), start, visit)["kept"].alias("_kept"), F.first(F.col("_total") > only_above).alias("_over"))
    stays = ~F.col("_over") | F.array_contains("_kept", F.col(ident).cast("long"))
    return ranked.join(per, key).select(key, ident, stays.alias("kept"))


def reverse_elimination(rows: DataFrame, key: str, ident: str, length: str, score: str, ultra: Column, target: Column, only_above: Column) -> DataFrame:
    """(key, ident, kept): where the total exceeds only_above, rows that are not ultra leave from
    the lowest score (then id) until the rest is at most target. One ordered window sum: a row
    leaves iff what remains after all that leave before it still exceeds target."""
    total = F.sum(length).over(Window.partitionBy(key))
    before = F.sum(F.when(ultra, 0.0).otherwise(F.col(length))).over(Window.partitionBy(key).orderBy(score, ident).rowsBetween(Window.unboundedPreceding, -1))
    leaves = (total > only_above) & ~ultra & (total - F.coalesce(before, F.lit(0.0)) > target)
    return rows.select(key, ident, (~leaves).alias("kept"))


def iou(a: tuple[float, float], b: tuple[float, float]) -> float:
    both = min(a[1], b[1]) - max(a[0], b[0])
    every = max(a[1], b[1]) - min(a[0], b[0])
    return both / every if both > 0 and every > 0 else 0.0


def promote(candidates: DataFrame, kept: DataFrame, key: str, most: int = 2, limit: float = 0.5) -> DataFrame:
    """(key, cand_id) of at most so many candidates of a key, by score then id, that overlap no
    kept and no promoted interval at an IoU of limit or more."""

    def run(_: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        have = list(zip(old["start"], old["end"], strict=True))
        out = []
        for row in new.sort_values(["score", "cand_id"], ascending=[False, True]).itertuples():
            if len(out) < most and all(iou((row.start, row.end), h) < limit for h in have):
                out.append(row)
                have.append((row.start, row.end))
        return pd.DataFrame({key: [getattr(r, key) for r in out], "cand_id": [r.cand_id for r in out]}).astype("int64")

    left = candidates.select(key, "cand_id", "start", "end", "score").groupBy(key)
    return left.cogroup(kept.select(key, "start", "end").groupBy(key)).applyInPandas(run, f"{key} long, cand_id long")


def bridge(intervals: DataFrame, key: str, gap: float, longest: float) -> DataFrame:
    """(key, start, end, parts): neighbours in time order merge where their gap is positive and
    at most gap and the whole at most longest; a row already merged starts no further pair."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, row = [], None
        items = list(rows.sort_values(["start", "end"])[["start", "end"]].itertuples(index=False))
        k = 0
        while k < len(items):
            row = items[k]
            if k + 1 < len(items) and 0 < items[k + 1].start - row.end <= gap and items[k + 1].end - row.start <= longest:
                out.append((row.start, items[k + 1].end, 2))
                k += 2
            else:
                out.append((row.start, row.end, 1))
                k += 1
        done = pd.DataFrame(out, columns=["start", "end", "parts"])
        done.insert(0, key, rows[key].iloc[0])
        return done

    return intervals.select(key, "start", "end").groupBy(key).applyInPandas(run, f"{key} long, start double, end double, parts int")


def greedy_pairs(pairs: DataFrame, key: str, left: str, right: str, order: list[tuple[str, bool]]) -> DataFrame:
    """One-to-one matching: a key's pairs in order (column, ascending), taken if both ends are free.

    Under a strict order that is the same as rounds of dominant pairs: one that comes first among
    all open pairs of its left end and of its right end is taken by any greedy walk, whatever
    comes before it. Each round takes these, over all keys at once, and drops the other pairs of
    their ends; no task walks a key. Pairs of the same ends count once, the first of them, and
    ties of the whole order go by the ends. An end that is null is an end like any other."""
    rank = F.struct(*[(F.col(c) if up else -F.col(c)).alias(f"o{k}") for k, (c, up) in enumerate(order)], F.col(left).alias("l"), F.col(right).alias("r"))
    names = pairs.columns
    rows = pairs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), *[F.col(c).alias(f"_{n}") for n, c in (("k", key), ("l", left), ("r", right))], rank.alias("_rank"))
    first = Window.partitionBy("_k", "_l", "_r").orderBy("_rank")
    left_open = cut(rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"))
    taken: DataFrame | None = None
    by = [Window.partitionBy("_k", end) for end in ("_l", "_r")]
    while not left_open.isEmpty():
        best = left_open.withColumn("_a", F.min("_rank").over(by[0])).withColumn("_won", (F.col("_a") == F.col("_rank")) & (F.min("_rank").over(by[1]) == F.col("_rank"))).drop("_a")
        gone = best.withColumn("_gr", F.max("_won").over(by[1])).withColumn("_gone", F.col("_gr") | F.max("_won").over(by[0])).drop("_gr")
        marked = cut(gone)
        won = marked.where("_won").select("_row.*")
        taken = won if taken is None else taken.unionByName(won)
        left_open = marked.where("not _gone").drop("_won", "_gone")
    return pairs.limit(0) if taken is None else taken


def greedy_by_left(pairs: DataFrame, key: str, left: str, right: str, left_order: str, score: str) -> DataFrame:
    """Left rows in order each take their best free right row: by score, then the smaller right.

    What a left row takes hangs on all lefts before it, so a key is walked in order; its pairs
    stream by as Spark has sorted them, and a task holds a batch and the rights that are taken.
    All pairs of a left row carry its one place in order. Missing places and scores come last; an
    end that is null is an end like any other, and so is a null key."""
    order = [F.col(key), *[F.col(c).asc_nulls_last() for c in (left_order, left)], F.col(score).desc_nulls_last(), F.col(right).asc_nulls_last()]
    at = [pairs.columns.index(c) for c in (key, left, right)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, last = (), set(), ()
        for batch in batches:
            keep = []
            for k, a, b in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                if now != (k,):
                    now, used, last = (k,), set(), ()
                keep.append((a,) != last and b not in used)
                if keep[-1]:
                    last = (a,)
                    used.add(b)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return pairs.repartition(F.col(key)).sortWithinPartitions(*order).mapInArrow(run, pairs.schema)
