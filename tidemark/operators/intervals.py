"""Interval algebra on (key, start, end) rows: clustering, union, joins, coverage, metrics.

Range conditions become equi joins on a grid of buckets: both sides are copied to the buckets
they touch, and a pair is emitted only in the first bucket that both touch, so no distinct is
needed. Time axes of a key are never gathered in an array here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_clusters(points: DataFrame, key: str, t: str, gap: float, name: str = "cluster_no", tie: str | None = None) -> DataFrame:
    """Numbers clusters of each key: a new one starts where the step exceeds gap; a step equal to
    gap still joins."""
    along = Window.partitionBy(key).orderBy(t, *([tie] if tie else []))
    fresh = F.when(F.col(t) - F.lag(t).over(along) > gap, 1).otherwise(0)
    return points.withColumn("_fresh", fresh).withColumn(name, F.sum("_fresh").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def cluster_intervals(points: DataFrame, key: str, t: str, gap: float, least: int = 2, score: str | None = None) -> DataFrame:
    """(key, cluster_no, start, end, n[, score]) of clusters with at least so many points."""
    facts = [F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("n")]
    if score:
        facts.append(F.max(score).alias("score"))
    return gap_clusters(points, key, t, gap).groupBy(key, "cluster_no").agg(*facts).where(F.col("n") >= least)


def union_intervals(intervals: DataFrame, key: str, start: str = "start", end: str = "end", slack: float = 0.0, facts: list[Column] | None = None) -> DataFrame:
    """Merged intervals of each key; touching ones, and those within slack, merge. facts are
    aggregates carried along (sums, maxima, joined ids)."""
    along = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(along.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col(start) <= reach + slack, 0).otherwise(1)
    marked = intervals.withColumn("_fresh", fresh).withColumn("union_no", F.sum("_fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "union_no").agg(F.min(start).alias(start), F.max(end).alias(end), *(facts or []))


def _cells(start: Column, end: Column, width: float) -> Column:
    return F.sequence(F.floor(start / width), F.floor(end / width))


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: float, how_touch: str = "open") -> DataFrame:
    """Pairs of one key with left.start < right.end and left.end > right.start (open), or with
    <= and >= (closed). Columns besides the key must differ; both sides name their ends
    l_start, l_end and r_start, r_end. width is the size of a bucket: a row is copied to every
    bucket it touches, so about the length of the longer side's rows suits."""
    a = left.withColumn("_cell", F.explode(_cells(F.col("l_start"), F.col("l_end"), width)))
    b = right.withColumn("_cell", F.explode(_cells(F.col("r_start"), F.col("r_end"), width)))
    first = F.greatest(F.floor(F.col("l_start") / width), F.floor(F.col("r_start") / width))
    meet = (F.col("l_start") < F.col("r_end")) & (F.col("l_end") > F.col("r_start")) if how_touch == "open" else (F.col("l_start") <= F.col("r_end")) & (F.col("l_end") >= F.col("r_start"))
    return a.join(b, [key, "_cell"]).where((F.col("_cell") == first) & meet).drop("_cell")


def overlap_seconds() -> Column:
    return F.least("l_end", "r_end") - F.greatest("l_start", "r_start")


def points_in_intervals(points: DataFrame, intervals: DataFrame, key: str, t: str, width: float, closed: bool = True) -> DataFrame:
    """Point rows beside each interval (r_start, r_end) that holds them; half-open unless closed."""
    a = points.withColumn("_cell", F.floor(F.col(t) / width))
    b = intervals.withColumn("_cell", F.explode(_cells(F.col("r_start"), F.col("r_end"), width)))
    upper = F.col(t) <= F.col("r_end") if closed else F.col(t) < F.col("r_end")
    return a.join(b, [key, "_cell"]).where((F.col(t) >= F.col("r_start")) & upper).drop("_cell")


def nearest_join(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, carry: list[str], tolerance: float | None = None) -> DataFrame:
    """Left rows with the nearest right row of the key on either side: carry columns and distance.

    Both sides go in two ordered passes per key, forward for the last right row before and
    backward for the first after, each a running last, so that a key's rows cost one step each.
    Of equal distances the earlier wins. Right rows of one time count by their
    smallest carried values. Without a match, or beyond tolerance, the carried columns are null.
    """
    fact = F.struct(F.col(rt).alias("t"), *[F.col(c) for c in carry])
    once = right.groupBy(key, rt).agg(F.min(fact).alias("_fact")).select(key, F.col(rt).alias("_t"), "_fact", F.lit(0).alias("_side"))
    rows = left.select(key, F.col(lt).alias("_t"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"), F.lit(1).alias("_side"))
    both = rows.unionByName(once, allowMissingColumns=True)
    along = Window.partitionBy(key).orderBy("_t", "_side")
    back = F.last("_fact", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    against = Window.partitionBy(key).orderBy(F.desc("_t"), F.desc("_side"))
    ahead = F.last("_fact", ignorenulls=True).over(against.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_back", back).withColumn("_ahead", ahead).where("_side = 1")
    db, da = F.col("_t") - F.col("_back.t"), F.col("_ahead.t") - F.col("_t")
    pick = F.when(F.col("_back").isNull(), F.col("_ahead")).when(F.col("_ahead").isNull() | (db <= da), F.col("_back")).otherwise(F.col("_ahead"))
    found = found.withColumn("_pick", pick).withColumn("distance", F.abs(F.col("_t") - F.col("_pick.t")))
    ok = F.lit(True) if tolerance is None else F.coalesce(F.col("distance") <= tolerance, F.lit(False))
    return found.select("_row.*", F.when(ok, F.col("_pick.t")).alias(rt), *[F.when(ok, F.col(f"_pick.{c}")).alias(c) for c in carry], F.when(ok, F.col("distance")).alias("distance"))


def point_distance(t: Column, start: Column, end: Column) -> Column:
    """0 inside an interval, else the distance to its nearer edge."""
    return F.greatest(F.lit(0.0), start - t, t - end)


def interval_distance(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0.0), b_start - a_end, a_start - b_end)


def clipped(intervals: DataFrame, duration: str, start: str = "start", end: str = "end") -> DataFrame:
    """Ends clipped to [0, duration], a flag for clipped rows, empty rows dropped."""
    s, e = F.greatest(F.col(start), F.lit(0.0)), F.least(F.col(end), F.col(duration))
    return intervals.withColumn("was_clipped", (F.col(start) < 0) | (F.col(end) > F.col(duration))).withColumn("_s", s).withColumn("_e", e).where("_e > _s").drop(start, end).withColumnRenamed("_s", start).withColumnRenamed("_e", end)


def coverage(spans: DataFrame, intervals: DataFrame, key: str, width: float) -> DataFrame:
    """Per span (key, span_id, l_start, l_end): covered seconds, ratio, status and the largest
    uncovered gap inside, from intervals (key, start, end)."""
    merged = union_intervals(intervals, key).select(key, F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    inside = overlap_join(spans, merged, key, width).withColumn("s", F.greatest("l_start", "r_start")).withColumn("e", F.least("l_end", "r_end"))
    along = Window.partitionBy(key, "span_id").orderBy("s")
    before = F.coalesce(F.lag("e").over(along), F.col("l_start"))
    after = F.coalesce(F.lead("s").over(along), F.col("l_end"))
    facts = (
        inside.withColumn("gap", F.greatest(F.col("s") - before, after - F.col("e")))
        .groupBy(key, "span_id")
        .agg(F.sum(F.col("e") - F.col("s")).alias("covered"), F.max("gap").alias("max_gap"))
    )
    length = F.col("l_end") - F.col("l_start")
    out = spans.join(facts, [key, "span_id"], "left").withColumn("covered", F.coalesce("covered", F.lit(0.0))).withColumn("max_gap", F.coalesce("max_gap", length))
    ratio = F.when(length > 0, F.col("covered") / length).otherwise(F.lit(0.0))
    out = out.withColumn("ratio", ratio)
    return out.withColumn("status", F.when(F.col("ratio") >= 0.95, "full").when(F.col("ratio") > 0, "partial").otherwise("none"))


def set_metrics(actual: DataFrame, predicted: DataFrame, key: str, width: float) -> DataFrame:
    """Per key with either side: union seconds, their overlap, recall, precision, missed and
    false-positive seconds."""
    a, p = union_intervals(actual, key), union_intervals(predicted, key)
    total = lambda d, n: d.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias(n))
    pairs = overlap_join(a.select(key, F.col("start").alias("l_start"), F.col("end").alias("l_end")), p.select(key, F.col("start").alias("r_start"), F.col("end").alias("r_end")), key, width)
    both = pairs.groupBy(key).agg(F.sum(overlap_seconds()).alias("overlap"))
    out = total(a, "actual").join(total(p, "predicted"), key, "full_outer").join(both, key, "left").na.fill(0.0)
    share = lambda d: F.when(F.col(d) > 0, F.col("overlap") / F.col(d)).otherwise(0.0)
    return out.select(key, "actual", "predicted", "overlap", share("actual").alias("recall"), share("predicted").alias("precision"), (F.col("actual") - F.col("overlap")).alias("missed"), (F.col("predicted") - F.col("overlap")).alias("false_positive"))
