"""Timeline queries over events: clusters, unions, joins, coverage, peaks, runs, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import intervals as iv
from tidemark.operators import stats, windows
from tidemark.plans.registry import CELL, GAP, HOUR, P, of, points, query, sql_clusters, sql_union, table


def _clusters(spark: SparkSession, d: str, kind: str, gap: float = GAP) -> DataFrame:
    return iv.cluster_intervals(points(spark, d, kind), "user_id", "t", gap, score="value")


@query(f"WITH {P}, {sql_clusters('c', 'p', 'true')} SELECT user_id, cluster_no::BIGINT AS cluster_no, start, \"end\", n, score FROM c")
def session_gap_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Gap clusters of all events of a user."""
    return iv.cluster_intervals(points(spark, d), "user_id", "t", GAP, score="value")


_BUY_VIEW = f"{P}, {sql_clusters('a', 'p', of('purchase'))}, {sql_clusters('b', 'p', of('view'))}"


@query(f'WITH {_BUY_VIEW}, s AS (SELECT * FROM a UNION ALL SELECT * FROM b), {sql_union("u", "s")} SELECT user_id, start, "end" FROM u')
def interval_union(spark: SparkSession, d: str) -> DataFrame:
    """Union of two interval sets of a user; touching intervals merge."""
    both = _clusters(spark, d, "purchase").unionByName(_clusters(spark, d, "view"))
    return iv.union_intervals(both, "user_id").select("user_id", "start", "end")


@query(
    f"""WITH {P}, {sql_clusters('c', 'p', 'true', gap=2 * HOUR, least=1)},
m_a AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {GAP} THEN 0 ELSE 1 END AS fresh FROM c),
m_b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS no FROM m_a)
SELECT user_id, min(start) AS start, max("end") AS "end", sum(n)::BIGINT AS n, max("end" - start) AS longest, string_agg(cluster_no::BIGINT::VARCHAR, ';' ORDER BY cluster_no) AS ids, arg_max(score, start) AS last_score FROM m_b GROUP BY user_id, no"""
)
def interval_merge_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Merge of intervals up to a gap, with counts, the longest part, ids and the last score."""
    parts = iv.cluster_intervals(points(spark, d), "user_id", "t", 2 * HOUR, least=1, score="value").withColumn("length", F.col("end") - F.col("start"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("cluster_no")), lambda c: c.cast("string")), ";")
    facts = [F.sum("n").alias("n"), F.max("length").alias("longest"), ids.alias("ids"), F.max_by("score", "start").alias("last_score")]
    return iv.union_intervals(parts, "user_id", slack=GAP, facts=facts).drop("union_no")


@query(
    f"""WITH {_BUY_VIEW}
SELECT a.user_id, a.cluster_no::BIGINT AS left_no, b.cluster_no::BIGINT AS right_no, least(a."end", b."end") - greatest(a.start, b.start) AS seconds
FROM a JOIN b ON a.user_id = b.user_id AND a.start < b."end" AND a."end" > b.start"""
)
def interval_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """Half-open overlap join of two interval sets."""
    a = _clusters(spark, d, "purchase").select("user_id", F.col("cluster_no").alias("left_no"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    b = _clusters(spark, d, "view").select("user_id", F.col("cluster_no").alias("right_no"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return iv.overlap_join(a, b, "user_id", CELL).select("user_id", "left_no", "right_no", iv.overlap_seconds().alias("seconds"))


@query(
    f"""WITH {_BUY_VIEW}, s AS (SELECT user_id, start, "end", row_number() OVER (PARTITION BY user_id ORDER BY start, "end") AS no FROM (SELECT user_id, start, "end" FROM a UNION ALL SELECT user_id, start, "end" FROM b))
SELECT x.user_id, x.no AS first_no, y.no AS second_no, least(x."end", y."end") - greatest(x.start, y.start) AS seconds,
       (least(x."end", y."end") - greatest(x.start, y.start)) / least(x."end" - x.start, y."end" - y.start) AS share
FROM s x JOIN s y ON x.user_id = y.user_id AND x.no < y.no AND x.start < y."end" AND x."end" > y.start"""
)
def overlap_audit(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping pairs within one interval set and their share of the shorter."""
    both = _clusters(spark, d, "purchase").unionByName(_clusters(spark, d, "view")).select("user_id", "start", "end")
    both = both.withColumn("no", windows.row_rank("user_id", "start", "end"))
    a = both.select("user_id", F.col("no").alias("first_no"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    b = both.select("user_id", F.col("no").alias("second_no"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    pairs = iv.overlap_join(a, b, "user_id", CELL).where("first_no < second_no")
    shorter = F.least(F.col("l_end") - F.col("l_start"), F.col("r_end") - F.col("r_start"))
    return pairs.select("user_id", "first_no", "second_no", iv.overlap_seconds().alias("seconds"), (iv.overlap_seconds() / shorter).alias("share"))


@query(
    f"""WITH {P}, l AS (SELECT * FROM p WHERE event_type = 'purchase'), r AS (SELECT * FROM p WHERE event_type = 'click'),
j AS (SELECT l.user_id, l.event_id, l.t, r.t AS rt, r.event_id AS right_id, abs(l.t - r.t) AS distance, row_number() OVER (PARTITION BY l.user_id, l.event_id ORDER BY abs(l.t - r.t), r.t, r.event_id) AS k FROM l JOIN r ON l.user_id = r.user_id)
SELECT l.user_id, l.event_id, j.right_id, j.distance, CASE WHEN j.distance IS NULL THEN 'missing' WHEN j.distance <= {2 * HOUR} THEN 'good' WHEN j.distance <= {5 * HOUR} THEN 'acceptable' ELSE 'missed' END AS band
FROM l LEFT JOIN j ON l.event_id = j.event_id AND j.k = 1 AND j.distance <= {12 * HOUR}"""
)
def nearest_event_join(spark: SparkSession, d: str) -> DataFrame:
    """Nearest row of another kind within a tolerance, and its distance band."""
    left = points(spark, d, "purchase").select("user_id", "event_id", "t")
    right = points(spark, d, "click").select("user_id", F.col("t").alias("rt"), F.col("event_id").alias("right_id"))
    out = iv.nearest_join(left, right, "user_id", "t", "rt", ["right_id"], 12 * HOUR)
    return out.select("user_id", "event_id", "right_id", "distance", scalar.distance_band(F.col("distance") / HOUR).alias("band"))


@query(
    f"""WITH {P}, l AS (SELECT * FROM p WHERE event_type = 'error'), r AS (SELECT * FROM p WHERE event_type = 'view'),
ex AS (SELECT l.event_id, min(r.event_id) AS right_id FROM l JOIN r ON l.user_id = r.user_id AND floor(l.t / {HOUR}) = floor(r.t / {HOUR}) GROUP BY l.event_id),
nr AS (SELECT l.event_id, r.event_id AS right_id, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.t - r.t), r.t, r.event_id) AS k FROM l JOIN r ON l.user_id = r.user_id AND abs(l.t - r.t) <= {6 * HOUR})
SELECT l.user_id, l.event_id, coalesce(ex.right_id, nr.right_id) AS right_id, CASE WHEN ex.right_id IS NOT NULL THEN 'exact' WHEN nr.right_id IS NOT NULL THEN 'nearest' ELSE 'missing' END AS method
FROM l LEFT JOIN ex USING (event_id) LEFT JOIN nr ON nr.event_id = l.event_id AND nr.k = 1"""
)
def exact_then_nearest_join(spark: SparkSession, d: str) -> DataFrame:
    """Exact key first, else nearest in time within a tolerance, with the method kept."""
    hour = F.floor(F.col("t") / HOUR)
    left = points(spark, d, "error").select("user_id", "event_id", "t").withColumn("h", hour)
    right = points(spark, d, "view")
    exact = right.groupBy("user_id", hour.alias("h")).agg(F.min("event_id").alias("exact_id"))
    near = right.select("user_id", F.col("t").alias("rt"), F.col("event_id").alias("near_id"))
    out = iv.nearest_join(left.join(exact, ["user_id", "h"], "left"), near, "user_id", "t", "rt", ["near_id"], 6 * HOUR)
    method = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("near_id").isNotNull(), "nearest").otherwise("missing")
    return out.select("user_id", "event_id", F.coalesce("exact_id", "near_id").alias("right_id"), method.alias("method"))


@query(
    f"""WITH {P}, l AS (SELECT * FROM p WHERE event_type = 'purchase'), r AS (SELECT * FROM p WHERE event_type IN ('click', 'view')),
j AS (SELECT l.user_id, l.event_id, r.event_id AS right_id, abs(l.t - r.t) AS d, abs(l.t - r.t) + CASE WHEN r.event_type = 'click' THEN 0 ELSE {1000 * HOUR} END AS cost, r.t FROM l JOIN r ON l.user_id = r.user_id AND abs(l.t - r.t) <= {5 * HOUR})
SELECT user_id, event_id, right_id, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY cost, t, right_id) AS k FROM j) WHERE k = 1"""
)
def nearest_with_priority(spark: SparkSession, d: str) -> DataFrame:
    """Nearest within a limit, where another kind costs a penalty."""
    left = points(spark, d, "purchase").select("user_id", "event_id", F.col("t").alias("l_start"), (F.col("t") + 0.0).alias("l_end"))
    right = points(spark, d, "click", "view").select("user_id", F.col("event_id").alias("right_id"), "event_type", F.col("t").alias("rt"), (F.col("t") - 5 * HOUR).alias("r_start"), (F.col("t") + 5 * HOUR).alias("r_end"))
    near = F.abs(F.col("l_start") - F.col("rt"))
    pairs = iv.overlap_join(left, right, "user_id", CELL, "closed").where(near <= 5 * HOUR).withColumn("distance", near)
    cost = F.col("distance") + F.when(F.col("event_type") == "click", 0.0).otherwise(1000 * HOUR)
    best = F.min_by(F.struct("right_id", "distance"), F.struct(cost, "rt", "right_id"))
    return pairs.groupBy("user_id", "event_id").agg(best.alias("b")).select("user_id", "event_id", "b.right_id", "b.distance")


@query(
    f"""WITH {P}, {sql_clusters('c', 'p', of('view'))}, l AS (SELECT * FROM p WHERE event_type = 'signup')
SELECT l.user_id, l.event_id, min(greatest(0, c.start - l.t, l.t - c."end")) AS distance, bool_or(l.t BETWEEN c.start AND c."end") AS inside
FROM l JOIN c ON l.user_id = c.user_id GROUP BY l.user_id, l.event_id"""
)
def point_interval_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance of points to the nearest interval of their key, 0 inside.

    The nearest disjoint interval starts first after the point or last before it, so two nearest
    joins on the merged intervals' edges give it."""
    spans = iv.union_intervals(_clusters(spark, d, "view"), "user_id")
    left = points(spark, d, "signup").select("user_id", "event_id", "t")
    starts = spans.select("user_id", F.col("start").alias("edge"), F.col("start").alias("s"), F.col("end").alias("e"))
    ends = spans.select("user_id", F.col("end").alias("edge2"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    near = iv.nearest_join(iv.nearest_join(left, starts, "user_id", "t", "edge", ["s", "e"]).drop("distance"), ends, "user_id", "t", "edge2", ["s2", "e2"]).drop("distance")
    a, b = iv.point_distance(F.col("t"), F.col("s"), F.col("e")), iv.point_distance(F.col("t"), F.col("s2"), F.col("e2"))
    out = near.where(F.col("s").isNotNull()).withColumn("distance", F.least(a, b))
    return out.select("user_id", "event_id", "distance", (F.col("distance") == 0).alias("inside"))


@query(
    f"""WITH {P}, {sql_clusters('c', 'p', of('purchase'))},
j AS (SELECT c.user_id, c.cluster_no, x.event_type, x.value FROM p x JOIN c ON x.user_id = c.user_id AND x.t BETWEEN c.start AND c."end")
SELECT CASE WHEN grouping(user_id) = 1 THEN NULL ELSE user_id END AS user_id, CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE event_type END AS event_type, count(*) AS n, max(value) AS strongest, round(avg(value), 6) AS mean
FROM j GROUP BY GROUPING SETS ((user_id, event_type), (user_id), (event_type), ())"""
)
def point_in_interval_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Points inside intervals, rolled up by kind, by key and over all."""
    spans = _clusters(spark, d, "purchase").select("user_id", "cluster_no", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    inside = iv.points_in_intervals(points(spark, d), spans, "user_id", "t", CELL)
    sets = inside.groupingSets([[F.col("user_id"), F.col("event_type")], [F.col("user_id")], [F.col("event_type")], []], F.col("user_id"), F.col("event_type"))
    out = sets.agg(F.grouping("event_type").alias("g"), F.count("*").alias("n"), F.max("value").alias("strongest"), F.round(F.avg("value"), 6).alias("mean"))
    return out.select("user_id", F.when(F.col("g") == 1, "all").otherwise(F.col("event_type")).alias("event_type"), "n", "strongest", "mean")


@query(
    f"""WITH {P}, {sql_clusters('c', 'p', of('purchase'))},
j AS (SELECT c.user_id, c.cluster_no, c.start, c."end", x.t, x.value FROM c LEFT JOIN p x ON x.user_id = c.user_id AND x.event_type = 'click' AND x.t BETWEEN c.start AND c."end")
SELECT user_id, cluster_no::BIGINT AS cluster_no, count(t) AS n, max(value) AS max_strength, round(avg(value), 6) AS mean_strength, arg_max(t, value) AS strongest_at, min(t - start) AS from_start, min("end" - t) AS to_end FROM j GROUP BY user_id, cluster_no"""
)
def segment_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Anchors inside each segment: count, strengths, the strongest, nearest to both edges."""
    spans = _clusters(spark, d, "purchase").select("user_id", "cluster_no", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    inside = iv.points_in_intervals(points(spark, d, "click"), spans, "user_id", "t", CELL)
    facts = inside.groupBy("user_id", "cluster_no").agg(
        F.count("*").alias("n"), F.max("value").alias("max_strength"), F.round(F.avg("value"), 6).alias("mean_strength"), F.max_by("t", "value").alias("strongest_at"),
        F.min(F.col("t") - F.col("r_start")).alias("from_start"), F.min(F.col("r_end") - F.col("t")).alias("to_end"),
    )
    return spans.select("user_id", "cluster_no").join(facts, ["user_id", "cluster_no"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


_T0 = 1704067200.0  # start of the month that events cover


@query(
    f"""WITH {P} SELECT user_id, floor((t - {_T0}) / {24 * HOUR})::BIGINT AS window_index, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS n_buy, round(avg(CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END), 6) AS high_ratio, max(value) AS max_value
FROM p GROUP BY 1, 2"""
)
def tumbling_window_features(spark: SparkSession, d: str) -> DataFrame:
    """Counts and shares per tumbling window."""
    rows = points(spark, d).withColumn("window_index", F.floor((F.col("t") - _T0) / (24 * HOUR)))
    return rows.groupBy("user_id", "window_index").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("n_buy"), F.round(F.avg((F.col("value") >= 50).cast("double")), 6).alias("high_ratio"), F.max("value").alias("max_value")
    )


@query(
    f"""WITH {P}, u AS (SELECT user_id, max(t) - {_T0} AS duration FROM p GROUP BY user_id),
w AS (SELECT user_id, duration, unnest(range(0, ceil(duration / {120 * HOUR})::BIGINT)) AS window_index FROM u)
SELECT user_id, window_index::INTEGER AS window_index, window_index * {120 * HOUR} AS window_start, least(window_index * {120 * HOUR} + {120 * HOUR}, duration) AS window_end, least(window_index * {120 * HOUR} + {120 * HOUR}, duration) - window_index * {120 * HOUR} < {120 * HOUR} AS is_partial FROM w"""
)
def window_grid(spark: SparkSession, d: str) -> DataFrame:
    """Fixed windows over each key's duration, the last one cut."""
    spans = points(spark, d).groupBy("user_id").agg((F.max("t") - _T0).alias("duration"))
    return windows.grid(spans, "duration", 120 * HOUR).select("user_id", "window_index", "window_start", "window_end", "is_partial")


@query(
    f"""WITH {P}, {sql_clusters('c', 'p', of('view'))},
u AS (SELECT user_id, max(t) - {_T0} AS duration FROM p GROUP BY user_id),
w AS (SELECT user_id, unnest(range(0, ceil(duration / {24 * HOUR})::BIGINT)) AS window_index, duration FROM u),
x AS (SELECT user_id, window_index, {_T0} + window_index * {24 * HOUR} AS s, {_T0} + least(window_index * {24 * HOUR} + {24 * HOUR}, duration) AS e FROM w),
o AS (SELECT x.user_id, x.window_index, sum(least(x.e, c."end") - greatest(x.s, c.start)) AS overlap_sec, any_value(x.e - x.s) AS len, count(*) AS n_intervals FROM x JOIN c ON x.user_id = c.user_id AND c.start < x.e AND c."end" > x.s GROUP BY 1, 2)
SELECT x.user_id, x.window_index::INTEGER AS window_index, coalesce(o.n_intervals, 0) AS n_intervals, round(coalesce(o.overlap_sec, 0), 6) AS overlap_sec, round(coalesce(o.overlap_sec / o.len, 0), 6) AS overlap_ratio,
       CASE WHEN coalesce(o.overlap_sec / o.len, 0) >= 0.5 THEN 'inside' WHEN coalesce(o.overlap_sec, 0) <= 0 THEN 'outside' ELSE 'mixed' END AS scope
FROM x LEFT JOIN o USING (user_id, window_index)"""
)
def window_labels(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of every grid window with labelled intervals and its scope."""
    spans = points(spark, d).groupBy("user_id").agg((F.max("t") - _T0).alias("duration"))
    grid = windows.grid(spans, "duration", 24 * HOUR).select("user_id", "window_index", (F.col("window_start") + _T0).alias("l_start"), (F.col("window_end") + _T0).alias("l_end"))
    labels = _clusters(spark, d, "view").select("user_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    per = iv.overlap_join(grid, labels, "user_id", CELL).groupBy("user_id", "window_index").agg(F.count("*").alias("n_intervals"), F.sum(iv.overlap_seconds()).alias("sec"))
    out = grid.join(per, ["user_id", "window_index"], "left").na.fill(0, ["n_intervals", "sec"])
    ratio = scalar.safe_ratio("sec", F.col("l_end") - F.col("l_start"))
    return out.select("user_id", "window_index", "n_intervals", F.round("sec", 6).alias("overlap_sec"), F.round(ratio, 6).alias("overlap_ratio"), scalar.scope_of(F.array(F.lit("inside")), F.array(ratio)).alias("scope"))


@query(
    f"""WITH {P}, c AS (SELECT user_id, event_id, t, value, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {GAP} PRECEDING AND {GAP} FOLLOWING) AS nearby FROM p),
n AS (SELECT a.event_id, median(b.value) AS m FROM p a JOIN p b ON a.user_id = b.user_id AND a.t <> b.t AND abs(a.t - b.t) <= {GAP} GROUP BY a.event_id)
SELECT c.user_id, c.event_id, c.nearby, abs(c.value - n.m) AS shift FROM c LEFT JOIN n USING (event_id)"""
)
def sliding_context_stats(spark: SparkSession, d: str) -> DataFrame:
    """Count within reach, and the shift against the median of the neighbours."""
    rows = points(spark, d)
    near = rows.withColumn("nearby", windows.nearby_count("user_id", "t", GAP, "event_type = 'purchase'"))
    return windows.context_shift(near, "user_id", "t", "value", GAP).select("user_id", "event_id", "nearby", "shift")


_SPANS = f"s AS (SELECT user_id, unnest(range(0, 6)) AS span_id, {_T0} + unnest(range(0, 6)) * {120 * HOUR} AS a, {_T0} + unnest(range(1, 7)) * {120 * HOUR} AS b FROM (SELECT DISTINCT user_id FROM p))"


@query(
    f"""WITH {P}, {_SPANS}, {sql_clusters('c', 'p', 'true')}, {sql_union('u', 'c')},
i AS (SELECT s.user_id, s.span_id, s.a, s.b, greatest(s.a, u.start) AS x, least(s.b, u."end") AS y FROM s JOIN u ON s.user_id = u.user_id AND u.start < s.b AND u."end" > s.a),
g AS (SELECT *, greatest(x - coalesce(lag(y) OVER (PARTITION BY user_id, span_id ORDER BY x), a), coalesce(lead(x) OVER (PARTITION BY user_id, span_id ORDER BY x), b) - y) AS gap FROM i),
f AS (SELECT user_id, span_id, sum(y - x) AS covered, max(gap) AS max_gap FROM g GROUP BY 1, 2)
SELECT s.user_id, s.span_id::INTEGER AS span_id, round(coalesce(covered, 0), 6) AS covered, round(coalesce(max_gap, b - a), 6) AS max_gap, round(coalesce(covered, 0) / (b - a), 9) AS ratio,
       CASE WHEN coalesce(covered, 0) / (b - a) >= 0.95 THEN 'full' WHEN coalesce(covered, 0) > 0 THEN 'partial' ELSE 'none' END AS status
FROM s LEFT JOIN f USING (user_id, span_id)"""
)
def coverage_and_max_gap(spark: SparkSession, d: str) -> DataFrame:
    """Covered share of fixed spans and the largest uncovered gap inside."""
    rows = points(spark, d)
    spans = rows.select("user_id").distinct().withColumn("span_id", F.explode(F.sequence(F.lit(0), F.lit(5))))
    spans = spans.withColumn("l_start", _T0 + F.col("span_id") * 120 * HOUR).withColumn("l_end", _T0 + (F.col("span_id") + 1) * 120 * HOUR)
    out = iv.coverage(spans, iv.cluster_intervals(rows, "user_id", "t", GAP), "user_id", CELL)
    return out.select("user_id", "span_id", F.round("covered", 6).alias("covered"), F.round("max_gap", 6).alias("max_gap"), F.round("ratio", 9).alias("ratio"), "status")


@query(
    f"""WITH {P}, g AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM (SELECT DISTINCT user_id, t FROM p WHERE event_type = 'click')),
f AS (SELECT user_id, count(*) AS n, min(gap) AS min_gap, median(gap) AS median_gap, max(gap) AS max_gap, coalesce(max(gap) - min(gap) <= 0.101, false) AS is_even FROM g GROUP BY user_id)
SELECT user_id, n, round(min_gap, 6) AS min_gap, round(median_gap, 6) AS median_gap, round(max_gap, 6) AS max_gap, is_even, CASE WHEN max_gap IS NULL THEN 'no_sample' WHEN max_gap / {24 * HOUR} <= 1 THEN 'low' WHEN max_gap / {24 * HOUR} <= 2 THEN 'medium' ELSE 'high' END AS risk FROM f"""
)
def gap_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Steps between distinct times and their risk class."""
    out = stats.gap_statistics(points(spark, d, "click"), "user_id", "t")
    risk = scalar.gap_risk(F.col("max_gap") / (24 * HOUR))
    return out.select("user_id", "n", *[F.round(c, 6).alias(c) for c in ("min_gap", "median_gap", "max_gap")], "is_even", risk.alias("risk"))


@query(
    f"""WITH {P}, f AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s, quantile_cont(value, 0.9) AS q FROM p GROUP BY user_id),
k AS (SELECT p.*, value >= max(value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS peak FROM p)
SELECT k.user_id, k.event_id, k.value, round(greatest(20, m + 1.0 * s, q), 6) AS threshold FROM k JOIN f USING (user_id) WHERE peak AND value >= greatest(20, m + 1.0 * s, q)"""
)
def local_peaks_adaptive_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Local maxima above a threshold of their key's distribution."""
    rows = points(spark, d).withColumn("peak", windows.local_peak("value", windows.along("user_id", "t")))
    out = windows.with_adaptive_threshold(rows, "user_id", "value", 20.0, 1.0, 0.9)
    return out.where("peak and value >= threshold").select("user_id", "event_id", "value", F.round("threshold", 6).alias("threshold"))


@query(
    f"""WITH {P}, r AS (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS sustained FROM p)
SELECT user_id, event_id, round(sustained, 6) AS sustained, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY t), 6) AS delta, lead(event_type) OVER (PARTITION BY user_id ORDER BY t) AS next_type FROM r"""
)
def rolling_mean_sustained(spark: SparkSession, d: str) -> DataFrame:
    """Centred rolling mean, difference to the row before, and the row after."""
    w = windows.along("user_id", "t")
    return points(spark, d).select("user_id", "event_id", F.round(windows.rolling_mean("value", w), 6).alias("sustained"), F.round(windows.step("value", w), 6).alias("delta"), F.lead("event_type").over(w).alias("next_type"))


@query(
    f"""WITH {P}, q AS (SELECT *, value >= 30 AS f, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap, lag(value >= 30) OVER (PARTITION BY user_id ORDER BY t) AS pf FROM p),
r AS (SELECT *, sum(CASE WHEN NOT f OR coalesce(NOT pf, true) OR coalesce(gap > {12 * HOUR}, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS no FROM q),
x AS (SELECT user_id, no, count(*) AS n, max(t) - min(t) AS seconds FROM r WHERE f GROUP BY 1, 2)
SELECT user_id, max(n) AS longest, round(max(seconds), 6) AS longest_seconds, count(*) AS runs FROM x GROUP BY user_id"""
)
def longest_true_run(spark: SparkSession, d: str) -> DataFrame:
    """Longest run of true flags, broken by time jumps too."""
    w = windows.along("user_id", "t")
    rows = points(spark, d).withColumn("f", F.col("value") >= 30).withColumn("jump", windows.step("t", w) > 12 * HOUR)
    runs = windows.true_runs(rows, "user_id", "t", "f", F.col("jump"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest"), F.round(F.max(F.col("end") - F.col("start")), 6).alias("longest_seconds"), F.count("*").alias("runs"))


@query(
    f"""WITH {P}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM p)
SELECT user_id, round(regr_slope(value, k), 9) AS slope, round(1 - least(1, stddev_pop(value) / nullif(abs(median(value)), 0)), 6) AS consistency, round(stddev_pop(value), 6) AS spread FROM i GROUP BY user_id"""
)
def slope_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Least-squares slope on the index and score consistency."""
    rows = points(spark, d).withColumn("k", windows.row_rank("user_id", "t"))
    return rows.groupBy("user_id").agg(F.round(windows.slope("value", "k"), 9).alias("slope"), F.round(windows.consistency("value"), 6).alias("consistency"), F.round(F.stddev_pop("value"), 6).alias("spread"))


_VENN = f"""{P}, l AS (SELECT * FROM p WHERE event_type = 'purchase'),
h AS (SELECT l.user_id, l.event_id, bool_or(r.event_type = 'click') AS a, bool_or(r.event_type = 'view') AS b, bool_or(r.event_type = 'error') AS c
      FROM l LEFT JOIN p r ON l.user_id = r.user_id AND r.event_type IN ('click', 'view', 'error') AND abs(l.t - r.t) <= {3 * HOUR} GROUP BY 1, 2)"""


@query(
    f"""WITH {_VENN} SELECT CASE WHEN coalesce(a, false) THEN 'a' ELSE '' END || CASE WHEN coalesce(b, false) THEN 'b' ELSE '' END || CASE WHEN coalesce(c, false) THEN 'c' ELSE '' END AS venn, count(*) AS n,
count(*) FILTER (NOT coalesce(a OR b, false) AND coalesce(c, false)) AS recovered FROM h GROUP BY 1"""
)
def venn_source_cases(spark: SparkSession, d: str) -> DataFrame:
    """Which of three sources hit near a boundary, and misses of two that the third recovers."""
    left = points(spark, d, "purchase").select("user_id", "event_id", (F.col("t") - 3 * HOUR).alias("l_start"), (F.col("t") + 3 * HOUR).alias("l_end"))
    right = points(spark, d, "click", "view", "error").select("user_id", "event_type", F.col("t").alias("r_start"), (F.col("t") + 0.0).alias("r_end"), F.col("t").alias("rt"))
    mid = (F.col("l_start") + F.col("l_end")) / 2
    near = iv.overlap_join(left, right, "user_id", CELL, "closed").where(F.abs(mid - F.col("rt")) <= 3 * HOUR)
    hits = near.groupBy("user_id", "event_id").agg(*[F.bool_or(F.col("event_type") == k).alias(n) for k, n in (("click", "a"), ("view", "b"), ("error", "c"))])
    all_ = left.select("user_id", "event_id").join(hits, ["user_id", "event_id"], "left").na.fill(False)
    venn = F.concat(*[F.when(F.col(n), n).otherwise("") for n in "abc"])
    return all_.groupBy(venn.alias("venn")).agg(F.count("*").alias("n"), F.count_if(~F.col("a") & ~F.col("b") & F.col("c")).alias("recovered"))


@query(
    f"""WITH {P}, l AS (SELECT * FROM p WHERE event_type = 'purchase'), f AS (SELECT unnest(['click', 'view', 'error']) AS family),
d AS (SELECT f.family, l.event_id, min(abs(l.t - r.t)) / {HOUR} AS dist FROM l CROSS JOIN f LEFT JOIN p r ON r.user_id = l.user_id AND r.event_type = f.family GROUP BY 1, 2),
c AS (SELECT event_type AS family, count(*) AS n FROM p GROUP BY 1), m AS (SELECT (max(t) - min(t)) / 60.0 / {HOUR} AS minutes FROM p)
SELECT family, tol::INTEGER AS tol, round(avg(CASE WHEN dist <= tol THEN 1.0 ELSE 0.0 END), 6) AS recall, count(*) FILTER (dist <= tol) AS hits, round(median(dist), 6) AS median_distance,
       round(any_value(c.n) / any_value(m.minutes), 6) AS per_minute, round(100.0 * count(*) FILTER (dist <= tol) / any_value(c.n), 6) AS hits_per_100
FROM d CROSS JOIN (SELECT unnest([1, 2, 5, 10]) AS tol) JOIN c USING (family) CROSS JOIN m GROUP BY family, tol"""
)
def recall_at_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """Share of boundaries with a row of a family within tolerances, distances and densities."""
    left = points(spark, d, "purchase").select("user_id", "event_id", "t")
    parts = None
    for family in ("click", "view", "error"):
        right = points(spark, d, family).select("user_id", F.col("t").alias("rt"), F.col("event_id").alias("rid"))
        part = iv.nearest_join(left, right, "user_id", "t", "rt", ["rid"]).select(F.lit(family).alias("family"), (F.col("distance") / HOUR).alias("dist"))
        parts = part if parts is None else parts.unionByName(part)
    every = points(spark, d)
    counts = every.groupBy(F.col("event_type").alias("family")).agg(F.count("*").alias("c"))
    minutes = every.agg(((F.max("t") - F.min("t")) / 60.0 / HOUR).alias("minutes"))
    tall = parts.withColumn("tol", F.explode(F.array(*[F.lit(x) for x in (1, 2, 5, 10)])))
    hit = F.coalesce(F.col("dist") <= F.col("tol"), F.lit(False))
    per = tall.groupBy("family", "tol").agg(F.round(F.avg(hit.cast("double")), 6).alias("recall"), F.count_if(hit).alias("hits"), F.round(F.median("dist"), 6).alias("median_distance"))
    out = per.join(counts, "family").crossJoin(minutes)  # one row
    return out.select("family", "tol", "recall", "hits", "median_distance", F.round(F.col("c") / F.col("minutes"), 6).alias("per_minute"), F.round(100.0 * F.col("hits") / F.col("c"), 6).alias("hits_per_100"))


_SETS = f"""{_BUY_VIEW}, {sql_union('ua', 'a')}, {sql_union('ub', 'b')},
ta AS (SELECT user_id, sum("end" - start) AS actual FROM ua GROUP BY 1), tb AS (SELECT user_id, sum("end" - start) AS predicted FROM ub GROUP BY 1),
o AS (SELECT ua.user_id, sum(least(ua."end", ub."end") - greatest(ua.start, ub.start)) AS overlap FROM ua JOIN ub ON ua.user_id = ub.user_id AND ua.start < ub."end" AND ua."end" > ub.start GROUP BY 1),
m AS (SELECT coalesce(ta.user_id, tb.user_id) AS user_id, coalesce(actual, 0) AS actual, coalesce(predicted, 0) AS predicted, coalesce(overlap, 0) AS overlap FROM ta FULL JOIN tb USING (user_id) LEFT JOIN o USING (user_id))"""
_RATIOS = "CASE WHEN actual > 0 THEN overlap / actual ELSE 0 END AS recall, CASE WHEN predicted > 0 THEN overlap / predicted ELSE 0 END AS precision"


@query(f"WITH {_SETS} SELECT user_id, round(actual, 6) AS actual, round(predicted, 6) AS predicted, round(overlap, 6) AS overlap, round(recall, 9) AS recall, round(precision, 9) AS precision, round(actual - overlap, 6) AS missed, round(predicted - overlap, 6) AS false_positive FROM (SELECT *, {_RATIOS} FROM m)")
def session_interval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of two kinds as actual and predicted intervals: overlap metrics of a key."""
    out = iv.set_metrics(_clusters(spark, d, "purchase"), _clusters(spark, d, "view"), "user_id", CELL)
    return out.select("user_id", *[F.round(c, 9 if c in ("recall", "precision") else 6).alias(c) for c in out.columns[1:]])


@query(
    f"""WITH {_SETS}, r AS (SELECT *, {_RATIOS} FROM m)
SELECT 'macro' AS kind, round(avg(recall), 9) AS recall, round(avg(precision), 9) AS precision, count(*) AS n FROM r
UNION ALL SELECT 'micro', round(sum(overlap) / sum(actual), 9), round(sum(overlap) / sum(predicted), 9), count(*) FROM r"""
)
def interval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Macro averages over keys and micro ratios of sums."""
    per = iv.set_metrics(_clusters(spark, d, "purchase"), _clusters(spark, d, "view"), "user_id", CELL)
    facts = per.agg(F.avg("recall").alias("a"), F.avg("precision").alias("b"), (F.sum("overlap") / F.sum("actual")).alias("c"), (F.sum("overlap") / F.sum("predicted")).alias("e"), F.count("*").alias("n"))
    rows = F.array(F.struct(F.lit("macro").alias("kind"), F.round("a", 9).alias("recall"), F.round("b", 9).alias("precision"), "n"), F.struct(F.lit("micro").alias("kind"), F.round("c", 9).alias("recall"), F.round("e", 9).alias("precision"), "n"))
    return facts.select(F.explode(rows).alias("r")).select("r.*")


@query(
    f"""WITH {_BUY_VIEW}, j AS (SELECT b.user_id, b.cluster_no AS p_no, b.start AS ps, b."end" AS pe, sum(least(a."end", b."end") - greatest(a.start, b.start)) AS o FROM b JOIN a ON a.user_id = b.user_id AND a.start < b."end" AND a."end" > b.start GROUP BY 1, 2, 3, 4),
k AS (SELECT a.user_id, a.cluster_no, least(a."end" - a.start, max(least(a."end", b."end") - greatest(a.start, b.start))) AS o FROM a JOIN b ON a.user_id = b.user_id AND a.start < b."end" AND a."end" > b.start GROUP BY 1, 2, a.start, a."end")
SELECT u.user_id, round(coalesce((SELECT sum(least(o, pe - ps)) FROM j WHERE j.user_id = u.user_id), 0), 6) AS capped, round(coalesce((SELECT sum(o) FROM k WHERE k.user_id = u.user_id), 0), 6) AS best FROM (SELECT DISTINCT user_id FROM a) u"""
)
def overlap_conventions(spark: SparkSession, d: str) -> DataFrame:
    """Overlap by two more conventions: per prediction, capped at its length; best single overlap
    per actual interval (A26)."""
    a = _clusters(spark, d, "purchase").select("user_id", "cluster_no", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    b = _clusters(spark, d, "view").select("user_id", F.col("cluster_no").alias("p_no"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    pairs = iv.overlap_join(a, b, "user_id", CELL).withColumn("o", iv.overlap_seconds())
    capped = pairs.groupBy("user_id", "p_no").agg(F.least(F.sum("o"), F.first(F.col("r_end") - F.col("r_start"))).alias("o")).groupBy("user_id").agg(F.sum("o").alias("capped"))
    best = pairs.groupBy("user_id", "cluster_no").agg(F.max("o").alias("o")).groupBy("user_id").agg(F.sum("o").alias("best"))
    out = a.select("user_id").distinct().join(capped, "user_id", "left").join(best, "user_id", "left").na.fill(0.0)
    return out.select("user_id", F.round("capped", 6).alias("capped"), F.round("best", 6).alias("best"))


_BEST = f"""{_BUY_VIEW}, j AS (SELECT a.user_id, a.cluster_no, a.start AS s, a."end" AS e, b.start AS ps, b."end" AS pe, row_number() OVER (PARTITION BY a.user_id, a.cluster_no ORDER BY least(a."end", b."end") - greatest(a.start, b.start) DESC, abs((a.start + a."end") / 2 - (b.start + b."end") / 2), b.start) AS k
FROM a JOIN b ON a.user_id = b.user_id AND a.start < b."end" AND a."end" > b.start)"""


@query(f"WITH {_BEST} SELECT user_id, cluster_no::BIGINT AS cluster_no, round(abs(s - ps), 6) AS start_error, round(abs(e - pe), 6) AS end_error, round(exp(-((abs(s - ps) + abs(e - pe)) / 2 / {HOUR}) / 10), 9) AS quality FROM j WHERE k = 1")
def boundary_errors_best(spark: SparkSession, d: str) -> DataFrame:
    """Boundary errors against the best overlapping interval, not exclusive."""
    a = _clusters(spark, d, "purchase").select("user_id", "cluster_no", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    b = _clusters(spark, d, "view").select("user_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    centre = F.abs((F.col("l_start") + F.col("l_end")) / 2 - (F.col("r_start") + F.col("r_end")) / 2)
    best = F.min_by(F.struct("l_start", "l_end", "r_start", "r_end"), F.struct(-iv.overlap_seconds(), centre, "r_start"))
    out = iv.overlap_join(a, b, "user_id", CELL).groupBy("user_id", "cluster_no").agg(best.alias("b")).select("user_id", "cluster_no", "b.*")
    s, e = F.abs(F.col("l_start") - F.col("r_start")), F.abs(F.col("l_end") - F.col("r_end"))
    return out.select("user_id", "cluster_no", F.round(s, 6).alias("start_error"), F.round(e, 6).alias("end_error"), F.round(F.exp(-((s + e) / 2 / HOUR) / 10), 9).alias("quality"))


@query(
    f"""WITH {P}, e AS (SELECT *, row_number() OVER (PARTITION BY user_id, round_even(t / {HOUR}, 0) ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, t, event_id) AS k FROM p)
SELECT user_id, event_id, event_type FROM e WHERE k = 1"""
)
def tolerance_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """One row a time bucket: source priority, then time."""
    prio = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    rows = points(spark, d).withColumn("bucket", F.bround(F.col("t") / HOUR, 0))
    ranked = rows.withColumn("k", windows.row_rank(["user_id", "bucket"], prio, "t", "event_id"))
    return ranked.where("k = 1").select("user_id", "event_id", "event_type")


@query(
    f"""WITH {P}, c AS (SELECT a.user_id, a.event_id, a.t, x.o, abs(b.t - (a.t + x.o)) AS dist, b.event_id AS got, row_number() OVER (PARTITION BY a.event_id, x.o ORDER BY abs(b.t - (a.t + x.o)), b.t, b.event_id) AS k
FROM (SELECT * FROM p WHERE event_type = 'signup') a CROSS JOIN (SELECT unnest([{-10 * HOUR}, 0.0, {10 * HOUR}]) AS o) x LEFT JOIN p b ON a.user_id = b.user_id AND b.event_type = 'view' AND abs(b.t - (a.t + x.o)) <= {2 * HOUR})
SELECT user_id, event_id, o AS "offset", got, round(dist, 6) AS dist FROM c WHERE k = 1"""
)
def grid_sampling_simulation(spark: SparkSession, d: str) -> DataFrame:
    """Offsets around anchors snapped to the nearest observed row within tolerance."""
    anchors = points(spark, d, "signup").select("user_id", "event_id", "t")
    grid = windows.offsets_around(anchors, "t", [-10 * HOUR, 0.0, 10 * HOUR]).select("user_id", "event_id", "offset", "sample_t")
    seen = points(spark, d, "view").select("user_id", F.col("t").alias("rt"), F.col("event_id").alias("got"))
    out = iv.nearest_join(grid, seen, "user_id", "sample_t", "rt", ["got"], 2 * HOUR)
    return out.select("user_id", "event_id", "offset", "got", F.round("distance", 6).alias("dist"))


@query(
    f"""WITH {_BUY_VIEW}, r AS (SELECT a.user_id, a.cluster_no, a.start AS s, a."end" AS e, x.t, x.event_type FROM a LEFT JOIN p x ON a.user_id = x.user_id AND x.t BETWEEN a.start - {15 * HOUR} AND a."end" + {15 * HOUR})
SELECT user_id, cluster_no::BIGINT AS cluster_no, count(*) FILTER (t >= s - {15 * HOUR} AND t < s) AS before_15, count(*) FILTER (t >= s - {5 * HOUR} AND t < s) AS before_5, count(*) FILTER (t >= s AND t <= s + {5 * HOUR}) AS intro,
count(*) FILTER (t >= s AND t <= e) AS body, count(*) FILTER (t >= e - {5 * HOUR} AND t <= e) AS tail, count(*) FILTER (t > e AND t <= e + {5 * HOUR}) AS after_5, count(*) FILTER (t > e AND t <= e + {15 * HOUR} AND event_type = 'click') AS after_15_click
FROM r GROUP BY 1, 2"""
)
def phase_features(spark: SparkSession, d: str) -> DataFrame:
    """Counts in windows around each candidate from one range join."""
    spans = _clusters(spark, d, "purchase").select("user_id", "cluster_no", F.col("start").alias("s"), F.col("end").alias("e"), (F.col("start") - 15 * HOUR).alias("r_start"), (F.col("end") + 15 * HOUR).alias("r_end"))
    near = iv.points_in_intervals(points(spark, d), spans, "user_id", "t", CELL)
    t, s, e = F.col("t"), F.col("s"), F.col("e")
    return near.groupBy("user_id", "cluster_no").agg(
        F.count_if((t >= s - 15 * HOUR) & (t < s)).alias("before_15"), F.count_if((t >= s - 5 * HOUR) & (t < s)).alias("before_5"), F.count_if((t >= s) & (t <= s + 5 * HOUR)).alias("intro"),
        F.count_if((t >= s) & (t <= e)).alias("body"), F.count_if((t >= e - 5 * HOUR) & (t <= e)).alias("tail"), F.count_if((t > e) & (t <= e + 5 * HOUR)).alias("after_5"),
        F.count_if((t > e) & (t <= e + 15 * HOUR) & (F.col("event_type") == "click")).alias("after_15_click"),
    )


@query(
    f"""WITH {P}, {sql_clusters('c', 'p', of('purchase'))}, u AS (SELECT user_id, max(t) - {_T0} - {240 * HOUR} AS duration FROM p GROUP BY user_id)
SELECT user_id, cluster_no::BIGINT AS cluster_no, greatest(start - {_T0 + 240 * HOUR}, 0) AS start, least("end" - {_T0 + 240 * HOUR}, duration) AS "end", start - {_T0 + 240 * HOUR} < 0 OR "end" - {_T0 + 240 * HOUR} > duration AS was_clipped
FROM c JOIN u USING (user_id) WHERE least("end" - {_T0 + 240 * HOUR}, duration) > greatest(start - {_T0 + 240 * HOUR}, 0)"""
)
def interval_clipping(spark: SparkSession, d: str) -> DataFrame:
    """Intervals clipped to the key's span, empty ones dropped, clips flagged."""
    spans = points(spark, d).groupBy("user_id").agg((F.max("t") - _T0 - 240 * HOUR).alias("duration"))
    rows = _clusters(spark, d, "purchase").withColumn("start", F.col("start") - (_T0 + 240 * HOUR)).withColumn("end", F.col("end") - (_T0 + 240 * HOUR)).join(spans, "user_id")
    return iv.clipped(rows, "duration").select("user_id", "cluster_no", "start", "end", "was_clipped")


@query(
    f"""WITH {P}, a AS (SELECT user_id, event_id FROM p WHERE event_type = 'click'), c AS (SELECT DISTINCT user_id FROM p WHERE event_type = 'click' AND value > 200), g AS (SELECT DISTINCT user_id FROM p WHERE event_type = 'error' AND value > 150)
SELECT 'union' AS op, count(*) AS n FROM (SELECT user_id FROM c UNION SELECT user_id FROM g) UNION ALL SELECT 'intersect', count(*) FROM (SELECT user_id FROM c INTERSECT SELECT user_id FROM g) UNION ALL SELECT 'except', count(*) FROM (SELECT user_id FROM c EXCEPT SELECT user_id FROM g)
UNION ALL SELECT 'semi', count(*) FROM a WHERE user_id IN (SELECT user_id FROM c) UNION ALL SELECT 'anti', count(*) FROM a WHERE user_id NOT IN (SELECT user_id FROM c)"""
)
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection, difference, semi and anti membership of ids."""
    a = points(spark, d, "click").select("user_id", "event_id", "value")
    c = a.where("value > 200").select("user_id").distinct()
    g = points(spark, d, "error").where("value > 150").select("user_id").distinct()
    parts = {"union": c.union(g).distinct(), "intersect": c.intersect(g), "except": c.exceptAll(g), "semi": a.join(c, "user_id", "left_semi"), "anti": a.join(c, "user_id", "left_anti")}
    out = None
    for name, frame in parts.items():
        one = frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""WITH {P}, x AS (SELECT DISTINCT user_id FROM p WHERE event_type = 'purchase' AND value > 150), a AS (SELECT user_id, count(*) AS n FROM p WHERE event_type = 'click' AND value > 120 GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM p WHERE event_type = 'view' AND value > 120 GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS old_n, coalesce(b.n, 0) AS new_n, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b USING (user_id)"""
)
def version_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Full outer comparison of two outputs by key."""
    one = lambda k, n: points(spark, d, k).where("value > 120").groupBy("user_id").agg(F.count("*").alias(n))
    out = one("click", "a").join(one("view", "b"), "user_id", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return out.select("user_id", F.coalesce("a", F.lit(0)).alias("old_n"), F.coalesce("b", F.lit(0)).alias("new_n"), change.alias("change"))


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT vec_id, e, lag(e) OVER (ORDER BY vec_id) AS b, lag(vec_id) OVER (ORDER BY vec_id) AS prev_id FROM v),
m AS (SELECT vec_id, prev_id, greatest(-1, least(1, list_dot_product(e, b) / (greatest(sqrt(list_dot_product(e, e)), 1e-12) * greatest(sqrt(list_dot_product(b, b)), 1e-12)))) AS c, list_distance(e, b) AS l2 FROM s WHERE b IS NOT NULL)
SELECT vec_id, prev_id, round(1 - c, 6) AS cosine_distance, round(l2, 6) AS l2_distance FROM m"""
)
def embedding_step_distance(spark: SparkSession, d: str) -> DataFrame:
    """Cosine and Euclidean distance of consecutive vectors."""
    rows = table(spark, d, "embeddings", "vec_id", "embedding").withColumn("e", F.col("embedding").cast("array<double>"))
    # Consecutive ids join by number within id ranges: no single task orders all vectors.
    width = 4096
    part = Window.partitionBy(F.floor(F.col("vec_id") / width)).orderBy("vec_id")
    edges = rows.groupBy(F.floor(F.col("vec_id") / width).alias("g")).agg(F.max_by(F.struct("vec_id", "e"), "vec_id").alias("x"))
    # The window without a key orders one number a range; the vectors are joined to it.
    order = edges.select("g", F.lag("g").over(Window.orderBy("g")).alias("before"))
    carried = order.join(edges.select(F.col("g").alias("before"), "x"), "before", "left").select("g", "x")
    local = rows.withColumn("g", F.floor(F.col("vec_id") / width)).withColumn("y", F.lag(F.struct("vec_id", "e")).over(part))
    pairs = local.join(carried, "g").withColumn("b", F.coalesce("y", "x")).where(F.col("b").isNotNull())
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = lambda a: F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12))
    cosine = scalar.clip(dot("e", "b.e") / (size("e") * size("b.e")), -1, 1)
    l2 = F.sqrt(F.aggregate(F.zip_with("e", "b.e", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return pairs.select("vec_id", F.col("b.vec_id").alias("prev_id"), F.round(1 - cosine, 6).alias("cosine_distance"), F.round(l2, 6).alias("l2_distance"))
