"""Aggregates: exact quantiles, profiles, effects, sweeps, lifts, selections."""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import cuts_of, running_sums, with_bucket


def quantiles(rows: DataFrame, keys: list[str], x: str, linear: dict[str, float], ranked: dict[str, float] | None = None, buckets: int = 256) -> DataFrame:
    """(keys, a column a name): exact quantiles of x, linear ones between the two nearest ranks and
    ranked ones at rank ceil(q * n), by selection over buckets, so that no task holds a key's values.

    Values are counted once a key. A sketch of each key, at most `buckets` cuts, deals its distinct
    values into buckets; their totals tell which buckets hold the ranks asked for, and only those are
    ordered. Missing values are passed over; a key without any has null; null is a key like any
    other; without keys the result is one row, null over an empty table."""
    ranked = ranked or {}
    on = [f"_k{i}" for i in range(len(keys))]
    per = rows.select(*[F.col(f"`{k}`").alias(a) for k, a in zip(keys, on)], F.col(f"`{x}`").cast("double").alias("_x")).where(F.col("_x").isNotNull()).groupBy(*on, "_x").agg(F.count("*").alias("_n"))
    facts = per.groupBy(*on).agg(cuts_of("_x", buckets, 4096).alias("_cuts"), F.sum("_n").alias("_all"))  # both uses of placed read _all, so that exchanges are shared
    placed = with_bucket(_beside(per, facts, on), "_x", "_cuts")
    before = F.coalesce(F.sum("_held").over(Window.partitionBy(*on).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most `buckets` rows a key
    totals = placed.groupBy(*on, "_bucket").agg(F.sum("_n").alias("_held"), F.max("_all").alias("_all")).withColumn("_before", before)
    between = [F.lit(float(q)) * (F.col("_all") - 1) for q in linear.values()]
    places = F.array(*[f(p).cast("long") for p in between for f in (F.floor, F.ceil)], *[F.greatest(F.ceil(F.lit(float(q)) * F.col("_all")) - 1, F.lit(0)).cast("long") for q in ranked.values()])
    asked = totals.withColumn("_places", places).where(F.exists("_places", lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("_held")))).drop("_held", "_all")
    ordered = Window.partitionBy(*on, "_bucket").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    run = _beside(placed, asked, [*on, "_bucket"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(ordered))
    at = lambda i: F.max(F.when((F.col("_places")[i] < F.col("_upto")) & (F.col("_places")[i] >= F.col("_upto") - F.col("_n")), F.col("_x")))
    found = run.groupBy(*on).agg(F.max("_all").alias("_all"), *[at(i).alias(f"_v{i}") for i in range(2 * len(linear) + len(ranked))])
    out = [F.col(a).alias(k) for a, k in zip(on, keys)]
    for i, (name, place) in enumerate(zip(linear, between)):
        low, high, share = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}"), place - F.floor(place)
        out.append(F.when(low == high, low).otherwise(low * (1 - share) + high * share).alias(name))
    return found.select(*out, *[F.col(f"_v{2 * len(linear) + i}").alias(name) for i, name in enumerate(ranked)])


def _beside(rows: DataFrame, facts: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Rows with the facts of their keys, null keys included; a single row of facts without keys."""
    if not on:
        return rows.crossJoin(F.broadcast(facts))  # one row
    other = facts.select(*[F.col(f"`{k}`").alias(f"_of{i}") for i, k in enumerate(on)], *[c for c in facts.columns if c not in on])
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_of{i}")) for i, k in enumerate(on)]
    return rows.join(other, same, how).drop(*[f"_of{i}" for i in range(len(on))])


def profile(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, count, valid, missing ratio, mean, deviation (0 for one value), quartiles, IQR,
    extremes, share of non-zero values). Quartiles come by rank selection, the rest by one
    aggregate."""
    v = F.col(x)
    plain = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count(v).alias("valid"), (1.0 - F.count(v) / F.count("*")).alias("missing_ratio"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(F.when(v != 0, 1.0).when(v.isNotNull(), 0.0)).alias("nonzero_ratio"),
    )
    out = _beside(plain, quantiles(rows, keys, x, {"q25": 0.25, "median": 0.5, "q75": 0.75}), keys, "left")
    return out.select(*keys, "n", "valid", "missing_ratio", "mean", "std", "q25", "median", "q75", (F.col("q75") - F.col("q25")).alias("iqr"), "min", "max", "nonzero_ratio")


def unpivot(rows: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    return rows.unpivot(ids, features, "feature", "value")


def cohen_d(x: str, group: Column) -> Column:
    """Standardised mean difference of group against the rest; null below two rows a side or
    without spread."""
    a, b = F.when(group, F.col(x)), F.when(~group, F.col(x))
    na, nb = F.count(a), F.count(b)
    pooled = ((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b)) / (na + nb - 2)
    return F.when((na >= 2) & (nb >= 2) & (pooled > 0), (F.avg(a) - F.avg(b)) / F.sqrt(pooled))


def robust_effect(x: str, group: Column) -> Column:
    """Median difference over the mean IQR."""
    a, b = F.when(group, F.col(x)), F.when(~group, F.col(x))
    p = lambda v, q: F.percentile(v, F.lit(q))
    width = ((p(a, 0.75) - p(a, 0.25)) + (p(b, 0.75) - p(b, 0.25))) / 2.0
    return F.when(width > 0, (p(a, 0.5) - p(b, 0.5)) / width)


def confusion(truth: Column, said: Column) -> list[Column]:
    """tp, tn, fp, fn, precision, recall, f1, balanced accuracy; a ratio over nothing is null."""
    tp, tn, fp, fn = F.count_if(truth & said), F.count_if(~truth & ~said), F.count_if(~truth & said), F.count_if(truth & ~said)
    return [tp.alias("tp"), tn.alias("tn"), fp.alias("fp"), fn.alias("fn"), *rates(tp, tn, fp, fn)]


def rates(tp: Column, tn: Column, fp: Column, fn: Column) -> list[Column]:
    div = lambda a, b: F.when(b > 0, a / b)
    precision, recall, other = div(tp, tp + fp), div(tp, tp + fn), div(tn, tn + fp)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall))
    return [precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), ((recall + other) / 2.0).alias("balanced_accuracy")]


def threshold_sweep(rows: DataFrame, x: str, truth: str) -> DataFrame:
    """(threshold, direction, tp, fp, tn, fn and rates) for every distinct cut in both directions.

    Counts accumulate over the distinct values in order, by buckets, so nothing is joined with every
    cut and no task orders them all."""
    per = rows.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("threshold")).agg(F.count_if(F.col(truth)).alias("p"), F.count_if(~F.col(truth)).alias("q"))
    run = running_sums(per, "threshold", ["p", "q"])
    from_here = lambda v: F.col(f"all_{v}") - F.col(f"run_{v}") + F.col(v)
    tall = run.select("threshold", "all_p", "all_q", from_here("p").alias("ge_p"), from_here("q").alias("ge_q"), F.col("run_p").alias("le_p"), F.col("run_q").alias("le_q"))
    sides = F.explode(F.array(F.struct(F.lit("ge").alias("direction"), F.col("ge_p").alias("tp"), F.col("ge_q").alias("fp")), F.struct(F.lit("le").alias("direction"), F.col("le_p").alias("tp"), F.col("le_q").alias("fp"))))
    flat = tall.select("threshold", "all_p", "all_q", sides.alias("s")).select("threshold", "s.direction", "s.tp", "s.fp", (F.col("all_q") - F.col("s.fp")).alias("tn"), (F.col("all_p") - F.col("s.tp")).alias("fn"))
    return flat.select("*", *rates(F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn")))


def mode_value(rows: DataFrame, key: str, x: str) -> DataFrame:
    """Most frequent value of each key, the smaller of equals."""
    counts = rows.groupBy(key, x).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by(F.col(x), F.struct(-F.col("n"), F.col(x))).alias("mode"), F.max("n").alias("mode_n"))


def top_values(rows: DataFrame, key: str | list[str], x: str, most: int, by: str = ";") -> DataFrame:
    """`value:count` of the most frequent values of each key, ties by value, as one string."""
    keys = [key] if isinstance(key, str) else key
    counts = rows.groupBy(*keys, x).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), x))).where(F.col("r") <= most)
    item = F.concat_ws(":", F.col(x), F.col("n"))
    return ranked.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", item.alias("i")))), lambda s: s["i"]), by).alias("top"))


def lift(tokens: DataFrame, token: str, group: str) -> DataFrame:
    """Counts of a token inside and outside a boolean group, the lift of its rates (1e-6 added),
    and the log lift of Laplace-smoothed rates (0.5 added, vocabulary in the denominator)."""
    per = tokens.groupBy(token).agg(F.count_if(F.col(group)).alias("n_in"), F.count_if(~F.col(group)).alias("n_out"))
    total = per.agg(F.sum("n_in").alias("t_in"), F.sum("n_out").alias("t_out"), F.count("*").alias("v"))
    joined = per.crossJoin(F.broadcast(total))  # one row of totals
    plain = ((F.col("n_in") / F.col("t_in")) + 1e-6) / ((F.col("n_out") / F.col("t_out")) + 1e-6)
    smooth = F.log(((F.col("n_in") + 0.5) / (F.col("t_in") + 0.5 * F.col("v"))) / ((F.col("n_out") + 0.5) / (F.col("t_out") + 0.5 * F.col("v"))))
    return joined.select(token, "n_in", "n_out", plain.alias("lift"), smooth.alias("log_lift"))


def gap_statistics(points: DataFrame, key: str, t: str, even: float = 0.101) -> DataFrame:
    """Smallest, median and largest step of distinct times, and whether steps are even."""
    gaps = points.select(key, t).distinct().withColumn("gap", F.col(t) - F.lag(t).over(Window.partitionBy(key).orderBy(t)))
    return gaps.groupBy(key).agg(F.count("*").alias("n"), F.min("gap").alias("min_gap"), F.median("gap").alias("median_gap"), F.max("gap").alias("max_gap"), F.coalesce(F.max("gap") - F.min("gap") <= even, F.lit(False)).alias("is_even"))


def fitted_scale(rows: DataFrame, x: str, fit: Column, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Adds scaled: position between two quantiles of the fitting rows, clipped to [0, 1], and
    level: by the 40 and 70 % quantiles of the same rows."""
    only = quantiles(rows.where(fit), [], x, {"a": lo, "b": hi, "c": 0.4, "d": 0.7}).select(F.array("a", "b", "c", "d").alias("_q"))
    out = rows.crossJoin(F.broadcast(only))  # one row of quantiles
    span = F.col("_q")[1] - F.col("_q")[0]
    scaled = F.when(span > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(x) - F.col("_q")[0]) / span))).otherwise(0.0)
    level = F.when(F.col(x).isNull(), "unknown").when(F.col(x) >= F.col("_q")[3], "high").when(F.col(x) >= F.col("_q")[2], "medium").otherwise("low")
    return out.withColumn("scaled", scaled).withColumn("level", level).drop("_q")


def cdf_position(rows: DataFrame, x: str, fit: Column) -> DataFrame:
    """Adds cdf: the share of fitting rows at or below the value.

    Distinct values carry counts, counts accumulate in order by buckets, and values join back;
    rows are never paired with every fitting row. A missing value has no position."""
    per = rows.groupBy(F.col(x).alias("_x")).agg(F.count_if(fit).alias("_n"))
    placed = running_sums(per.where(F.col("_x").isNotNull()), "_x", ["_n"])
    return rows.join(placed.select("_x", (F.col("run__n") / F.col("all__n")).alias("cdf")), F.col(x) == F.col("_x"), "left").drop("_x")


def leave_one_out(rows: DataFrame, group: str, config: str, metric: str) -> DataFrame:
    """For each held-out group the configuration of the best mean over the other groups, the
    smaller configuration of equals; means come from totals less the own value."""
    w = Window.partitionBy(config)
    n = F.count(metric).over(w)
    others = (F.sum(metric).over(w) - F.col(metric)) / F.nullif(n - 1, F.lit(0))
    scored = rows.withColumn("others", F.round(others, 9))
    best = F.min_by(F.struct(F.col(config), F.col("others"), F.col(metric)), F.struct(-F.col("others"), F.col(config)))
    return scored.where(F.col("others").isNotNull()).groupBy(group).agg(best.alias("b")).select(group, f"b.{config}", F.col("b.others").alias("mean_others"), F.col(f"b.{metric}").alias("own"))


def exact_sum(x: Column, places: int) -> Column:
    """Sum of doubles taken as decimals of so many places, the same in whatever order rows and
    partial sums arrive. Whole parts and fractions are summed as integers; where a value is no such
    number (infinite, not a number, a billion and more) or they overflow, it is a plain sum."""
    whole = F.when(F.abs(x) < 1e9, F.floor(x))
    part = F.floor((x - whole) * float(10**places) + 0.5)
    parts = F.try_sum(part).cast("decimal(20,0)") * F.lit(decimal.Decimal(1).scaleb(-places))
    total = (F.try_sum(whole).cast("decimal(20,0)") + parts).cast("double")
    return F.when(F.count(whole) == F.count(x), F.coalesce(total, F.sum(x))).otherwise(F.sum(x))


def exact_mean(x: Column, places: int) -> Column:
    return exact_sum(x, places) / F.nullif(F.count(x), F.lit(0))


def _skyline(signs: list[int]):
    """Streams points and gives those that no other one dominates; only the front is held. In
    descending order a point is followed by all that it dominates, so the first that is left is
    on the front."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        front = None
        for frame in frames:
            frame = frame if front is None else pd.concat([front, frame], ignore_index=True)
            x = frame.to_numpy(np.float64) * signs
            order = np.lexsort(-x.T[::-1])
            kept = []
            while len(order):
                best, order = order[0], order[1:]
                kept.append(best)
                beaten = (x[best] >= x[order]).all(axis=1) & (x[best] > x[order]).any(axis=1)
                order = order[~beaten]
            front = frame.iloc[kept]
        if front is not None:
            yield front

    return run


def pareto(rows: DataFrame, name: str, more: list[str], less: list[str], fan: int = 16) -> DataFrame:
    """Rows that no other row matches everywhere and beats somewhere; equal rows stand together.
    A row with a missing metric (null or not a number) is not on the front and beats none.

    Each partition keeps its own front, fan tasks merge those, and one merges theirs: points are
    never paired, and no task holds more than a front and a batch. Metrics compare as doubles."""
    metrics = [*more, *less]
    front = _skyline([1] * len(more) + [-1] * len(less))
    points = rows.select(*metrics).dropna().distinct()
    for parts in (None, fan, 1):
        points = (points.repartition(parts) if parts else points).mapInPandas(front, points.schema)
    return rows.join(points, metrics, "left_semi").select(name, *metrics)


def best_per_objective(rows: DataFrame, name: str, objectives: list[str], most: int) -> DataFrame:
    """(name, rank, objective): the best row of each objective in order, no row twice, then rows
    by the first objective until there are enough."""
    parts = [rows.orderBy(F.desc(o), name).limit(1).select(name, F.lit(k).alias("p"), F.lit(o).alias("objective")) for k, o in enumerate(objectives)]
    fill = rows.orderBy(F.desc(objectives[0]), name).limit(most).select(name, (F.lit(len(objectives)) + F.row_number().over(Window.orderBy(F.desc(objectives[0]), name))).alias("p"), F.lit("fill").alias("objective"))
    every = fill
    for p in parts:
        every = every.unionByName(p)
    once = every.groupBy(name).agg(F.min_by(F.struct("p", "objective"), "p").alias("b"))
    ranked = once.select(name, F.row_number().over(Window.orderBy("b.p", name)).alias("rank"), "b.objective")
    return ranked.where(F.col("rank") <= most)
