"""Statistics queries: quantiles, profiles, effects, sweeps, scaling, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import folds, scoring, stats, windows
from tidemark.plans.registry import P, points, query, table


@query(
    """WITH f AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS q2, quantile_cont(l_extendedprice, 0.75) AS q3, stddev_samp(l_extendedprice) AS sd, max(l_extendedprice) - min(l_extendedprice) AS rg FROM lineitem GROUP BY 1),
r AS (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2.0 AS rk, count(l_extendedprice) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round((l_extendedprice - q2) / coalesce(nullif(q3 - q1, 0), nullif(sd, 0), nullif(rg, 0), 1), 6) AS robust_z, round(rk / n, 9) AS pct,
CASE WHEN 100 * rk / n >= 70 THEN 'high' WHEN 100 * rk / n >= 40 THEN 'medium' ELSE 'low' END AS level FROM r JOIN f USING (l_suppkey)"""
)
def robust_z_percentile_level(spark: SparkSession, d: str) -> DataFrame:
    """Robust z, average percent rank and its level within a supplier."""
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    ranked = rows.withColumn("pct", windows.average_rank_pct("l_extendedprice", "l_suppkey"))
    out = windows.with_robust_z(ranked, "l_suppkey", "l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.round("robust_z", 6).alias("robust_z"), F.round("pct", 9).alias("pct"), scalar.percentile_bin(100 * F.col("pct")).alias("level"))


@query(
    f"""WITH {P}, m AS (SELECT user_id, median(value) AS m, quantile_cont(value, 0.95) AS q FROM p GROUP BY 1), a AS (SELECT p.user_id, median(abs(value - m)) AS mad FROM p JOIN m USING (user_id) GROUP BY 1)
SELECT p.user_id, event_id, value, round(mad, 6) AS mad, round(greatest(m + 3 * mad, q), 6) AS threshold FROM p JOIN m USING (user_id) JOIN a USING (user_id) WHERE value >= greatest(m + 3 * mad, q)"""
)
def mad_threshold_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Rows over median + 3 MAD or the 95 % quantile of their key."""
    out = windows.with_mad_threshold(points(spark, d).select("user_id", "event_id", "value"), "user_id", "value")
    return out.where("value >= threshold").select("user_id", "event_id", "value", F.round("mad", 6).alias("mad"), F.round("threshold", 6).alias("threshold"))


_PROFILE = ", ".join(
    f"round({e}, 6) AS {n}"
    for e, n in (
        ("count(*)", "n"), ("count(value)", "valid"), ("1 - count(value) / count(*)", "missing_ratio"), ("avg(value)", "mean"), ("coalesce(stddev_samp(value), 0)", "std"), ("quantile_cont(value, 0.25)", "q25"), ("quantile_cont(value, 0.5)", "median"),
        ("quantile_cont(value, 0.75)", "q75"), ("quantile_cont(value, 0.75) - quantile_cont(value, 0.25)", "iqr"), ("min(value)", "min"), ("max(value)", "max"), ("avg(CASE WHEN value <> 0 THEN 1.0 WHEN value IS NOT NULL THEN 0.0 END)", "nonzero_ratio"),
    )
).replace("round(count(*), 6)", "count(*)").replace("round(count(value), 6)", "count(value)")


@query(
    f"""WITH t AS (UNPIVOT (SELECT l_returnflag, l_quantity, l_discount, l_tax, CASE WHEN l_extendedprice > 50000 THEN l_extendedprice END AS big_price FROM lineitem) ON l_quantity, l_discount, l_tax, big_price INTO NAME feature VALUE value),
g AS (SELECT l_returnflag, feature, count(*) AS total FROM (SELECT l_returnflag, unnest(['l_quantity', 'l_discount', 'l_tax', 'big_price']) AS feature FROM lineitem) GROUP BY 1, 2),
x AS (SELECT l_returnflag, feature, value FROM t UNION ALL SELECT g.l_returnflag, g.feature, NULL FROM g JOIN (SELECT l_returnflag, feature, count(*) AS c FROM t GROUP BY 1, 2) c USING (l_returnflag, feature), range(g.total - c.c))
SELECT l_returnflag, feature, {_PROFILE} FROM x GROUP BY 1, 2"""
)
def group_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profile of several features per group, after unpivoting them."""
    rows = table(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_discount", "l_tax", "l_extendedprice").withColumn("big_price", F.when(F.col("l_extendedprice") > 50000, F.col("l_extendedprice")))
    out = stats.profile(stats.unpivot(rows.drop("l_extendedprice"), ["l_returnflag"], ["l_quantity", "l_discount", "l_tax", "big_price"]), ["l_returnflag", "feature"], "value")
    return out.select("l_returnflag", "feature", *[c if c in ("n", "valid") else F.round(c, 6).alias(c) for c in out.columns[2:]])


@query(
    """WITH x AS (SELECT n_chars::DOUBLE AS v, quality = 1 AS g FROM documents JOIN labels USING (doc_id)),
s AS (SELECT count(v) FILTER (g) AS na, count(v) FILTER (NOT g) AS nb, avg(v) FILTER (g) AS ma, avg(v) FILTER (NOT g) AS mb, var_samp(v) FILTER (g) AS va, var_samp(v) FILTER (NOT g) AS vb,
quantile_cont(v, 0.5) FILTER (g) AS qa, quantile_cont(v, 0.5) FILTER (NOT g) AS qb, quantile_cont(v, 0.75) FILTER (g) - quantile_cont(v, 0.25) FILTER (g) AS ia, quantile_cont(v, 0.75) FILTER (NOT g) - quantile_cont(v, 0.25) FILTER (NOT g) AS ib FROM x),
e AS (SELECT *, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS d FROM s)
SELECT na AS n_in, nb AS n_out, round(d, 6) AS cohen_d, round((qa - qb) / ((ia + ib) / 2), 6) AS robust_effect, CASE WHEN abs(d) >= 0.8 THEN 'large' WHEN abs(d) >= 0.5 THEN 'medium' WHEN abs(d) >= 0.2 THEN 'small' ELSE 'negligible' END AS band FROM e"""
)
def group_profile_effects(spark: SparkSession, d: str) -> DataFrame:
    """Effect sizes of length between quality classes."""
    rows = table(spark, d, "documents", "doc_id", "n_chars").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id").select(F.col("n_chars").cast("double").alias("v"), (F.col("quality") == 1).alias("g"))
    out = rows.agg(F.count_if("g").alias("n_in"), F.count_if(~F.col("g")).alias("n_out"), stats.cohen_d("v", F.col("g")).alias("e"), F.round(stats.robust_effect("v", F.col("g")), 6).alias("robust_effect"))
    return out.select("n_in", "n_out", F.round("e", 6).alias("cohen_d"), "robust_effect", scalar.effect_band("e").alias("band"))


@query(
    """WITH a AS (SELECT o_orderpriority AS grp, o_totalprice AS v FROM orders), f AS (SELECT grp, avg(v) AS mean, median(v) AS med, stddev_samp(v) AS sd, count(*) AS n FROM a GROUP BY 1)
SELECT x.grp AS left_group, y.grp AS right_group, round(x.mean - y.mean, 4) AS diff, round((x.mean - y.mean) / abs(y.mean), 9) AS relative_diff, CASE WHEN x.mean > y.mean THEN 'higher' WHEN x.mean < y.mean THEN 'lower' ELSE 'equal' END AS direction,
round((x.mean - y.mean) / sqrt(((x.n - 1) * x.sd * x.sd + (y.n - 1) * y.sd * y.sd) / (x.n + y.n - 2)), 6) AS effect, rank() OVER (ORDER BY round(abs(x.mean - y.mean), 4) DESC) AS place FROM f x JOIN f y ON x.grp < y.grp"""
)
def pairwise_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of groups: differences, direction, pooled effect, rank (A10)."""
    f = table(spark, d, "orders", "o_orderpriority", "o_totalprice").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"), F.count("*").alias("n"))
    side = lambda p: f.select(*[F.col(c).alias(p + c) for c in ("o_orderpriority", "m", "s", "n")])
    j = side("x_").join(side("y_"), F.col("x_o_orderpriority") < F.col("y_o_orderpriority"))
    diff = F.col("x_m") - F.col("y_m")
    pooled = ((F.col("x_n") - 1) * F.col("x_s") * F.col("x_s") + (F.col("y_n") - 1) * F.col("y_s") * F.col("y_s")) / (F.col("x_n") + F.col("y_n") - 2)
    direction = F.when(diff > 0, "higher").when(diff < 0, "lower").otherwise("equal")
    out = j.select(F.col("x_o_orderpriority").alias("left_group"), F.col("y_o_orderpriority").alias("right_group"), F.round(diff, 4).alias("diff"), F.round(diff / F.abs("y_m"), 9).alias("relative_diff"), direction.alias("direction"), F.round(diff / F.sqrt(pooled), 6).alias("effect"), F.round(F.abs(diff), 4).alias("a"))
    return out.withColumn("place", F.rank().over(Window.orderBy(F.desc("a")))).drop("a")


@query(
    """WITH x AS (SELECT o_orderkey, o_orderpriority, o_totalprice, sum(l_extendedprice) FILTER (l_returnflag = 'A') AS a, sum(l_extendedprice) FILTER (l_returnflag = 'N') AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3),
p AS (SELECT o_orderpriority, a - b AS delta FROM x WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT o_orderpriority, count(*) AS n, round(avg(delta), 4) AS mean_delta, round(stddev_samp(delta), 4) AS std_delta, round(avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END), 9) AS positive_ratio, round(avg(delta) / nullif(stddev_samp(delta), 0), 6) AS paired_effect FROM p GROUP BY 1"""
)
def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    """Within-order difference of two segments, then its distribution."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_extendedprice").groupBy("l_orderkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice"))).alias("a"), F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_extendedprice"))).alias("b")
    )
    p = table(spark, d, "orders", "o_orderkey", "o_orderpriority").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("delta", F.col("a") - F.col("b")).where("delta is not null")
    return p.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.round(F.avg("delta"), 4).alias("mean_delta"), F.round(F.stddev_samp("delta"), 4).alias("std_delta"), F.round(F.avg((F.col("delta") > 0).cast("double")), 9).alias("positive_ratio"),
        F.round(F.avg("delta") / F.nullif(F.stddev_samp("delta"), F.lit(0.0)), 6).alias("paired_effect"),
    )


_SWEEP = """WITH x AS (SELECT n_chars::DOUBLE AS v, quality = 1 AS g FROM documents JOIN labels USING (doc_id)), t AS (SELECT DISTINCT v AS threshold FROM x), s AS (SELECT unnest(['ge', 'le']) AS direction),
c AS (SELECT threshold, direction, count(*) FILTER (g AND h) AS tp, count(*) FILTER (NOT g AND h) AS fp, count(*) FILTER (NOT g AND NOT h) AS tn, count(*) FILTER (g AND NOT h) AS fn
FROM (SELECT threshold, direction, g, CASE direction WHEN 'ge' THEN v >= threshold ELSE v <= threshold END AS h FROM t, s, x) GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END AS spec FROM c),
k AS (SELECT threshold, direction, tp, fp, tn, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END, 9) AS f1, round((recall + spec) / 2, 9) AS balanced_accuracy FROM r)"""


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "n_chars").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id").select(F.col("n_chars").cast("double").alias("v"), (F.col("quality") == 1).alias("g"))
    out = stats.threshold_sweep(rows, "v", "g")
    return out.select("threshold", "direction", "tp", "fp", "tn", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "balanced_accuracy")])


@query(_SWEEP + " SELECT * FROM k")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of every cut in both directions."""
    return _sweep(spark, d)


@query(_SWEEP + ", m AS (SELECT median(v) AS m FROM x) SELECT threshold, direction, balanced_accuracy, f1 FROM k, m ORDER BY balanced_accuracy DESC, coalesce(f1, -1) DESC, abs(threshold - m), threshold, direction LIMIT 1")
def threshold_best(spark: SparkSession, d: str) -> DataFrame:
    """The best cut by balanced accuracy, F1, closeness to the median."""
    labelled = table(spark, d, "documents", "doc_id", "n_chars").join(table(spark, d, "labels", "doc_id"), "doc_id")
    mid = stats.quantiles(labelled, [], "n_chars", {"m": 0.5})
    rows = _sweep(spark, d).crossJoin(mid)  # one row
    return rows.orderBy(F.desc("balanced_accuracy"), F.coalesce("f1", F.lit(-1.0)).desc(), F.abs(F.col("threshold") - F.col("m")), "threshold", "direction").limit(1).select("threshold", "direction", "balanced_accuracy", "f1")


@query(
    """WITH x AS (SELECT l.quality = 1 AS t, d.n_chars >= 1000 AS p FROM labels l JOIN documents d USING (doc_id)), c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND NOT p) AS tn, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM x)
SELECT tp, tn, fp, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) AS f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced_accuracy FROM c"""
)
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Confusion counts and rates of a rule."""
    rows = table(spark, d, "labels", "doc_id", "quality").join(table(spark, d, "documents", "doc_id", "n_chars"), "doc_id")
    out = rows.agg(*stats.confusion(F.col("quality") == 1, F.col("n_chars") >= 1000))
    return out.select("tp", "tn", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "balanced_accuracy")])


@query(
    """SELECT l_shipdate_year, round(quantile_cont(l_extendedprice, 0.05), 4) AS q05, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.95), 4) AS q95, quantile_disc(l_extendedprice, 0.9) AS p90, round(stddev_samp(l_extendedprice), 4) AS sd1, round(stddev_pop(l_extendedprice), 4) AS sd0
FROM (SELECT *, year(l_shipdate) AS l_shipdate_year FROM lineitem) GROUP BY 1"""
)
def quantile_profile(spark: SparkSession, d: str) -> DataFrame:
    """Linear and nearest-rank quantiles, both deviations."""
    rows = table(spark, d, "lineitem", "l_shipdate", "l_extendedprice").withColumn("l_shipdate_year", F.year("l_shipdate"))
    key, x = "l_shipdate_year", "l_extendedprice"
    exact = stats.quantiles(rows, [key], x, {"q05": 0.05, "q50": 0.5, "q95": 0.95}, {"p90": 0.9})
    spread = rows.groupBy(key).agg(F.round(F.stddev_samp(x), 4).alias("sd1"), F.round(F.stddev_pop(x), 4).alias("sd0"))
    return spread.join(exact, key).select(key, *[F.round(q, 4).alias(q) for q in ("q05", "q50", "q95")], "p90", "sd1", "sd0")


@query(
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.05) AS a, quantile_cont(o_totalprice, 0.95) AS b, quantile_cont(o_totalprice, 0.4) AS m, quantile_cont(o_totalprice, 0.7) AS h FROM orders WHERE o_orderkey % 5 <> 0)
SELECT o_orderkey, round(least(1, greatest(0, (o_totalprice - a) / (b - a))), 9) AS scaled, CASE WHEN o_totalprice >= h THEN 'high' WHEN o_totalprice >= m THEN 'medium' ELSE 'low' END AS level FROM orders, q"""
)
def train_scaled_levels(spark: SparkSession, d: str) -> DataFrame:
    """Scaling and levels fitted on one split and applied to all."""
    out = stats.fitted_scale(table(spark, d, "orders", "o_orderkey", "o_totalprice"), "o_totalprice", F.col("o_orderkey") % 5 != 0)
    return out.select("o_orderkey", F.round("scaled", 9).alias("scaled"), "level")


@query("WITH f AS (SELECT o_totalprice AS v FROM orders WHERE o_orderkey % 5 <> 0), n AS (SELECT count(*) AS n FROM f), c AS (SELECT v, count(*) OVER (ORDER BY v) AS k FROM f) SELECT o_orderkey, round(coalesce(max(c.k), 0) / any_value(n.n), 9) AS cdf FROM orders CROSS JOIN n LEFT JOIN c ON c.v <= o_totalprice AND c.v = (SELECT max(v) FROM f WHERE v <= o_totalprice) GROUP BY o_orderkey")
def empirical_cdf(spark: SparkSession, d: str) -> DataFrame:
    """Position of every value in the distribution of one split."""
    out = stats.cdf_position(table(spark, d, "orders", "o_orderkey", "o_totalprice"), "o_totalprice", F.col("o_orderkey") % 5 != 0)
    return out.select("o_orderkey", F.round("cdf", 9).alias("cdf"))


@query(
    """SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn, rank() OVER (PARTITION BY c_mktsegment ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS LAST) AS place,
dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS dense FROM customer"""
)
def score_rank_dense(spark: SparkSession, d: str) -> DataFrame:
    """Row number with tie-break, standard rank with missing last, dense rank."""
    rows = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal").withColumn("positive", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return rows.select(
        "c_custkey", "c_nationkey", windows.row_rank("c_nationkey", F.desc("c_acctbal"), "c_custkey").alias("rn"), windows.min_rank("positive", "c_mktsegment").alias("place"),
        F.dense_rank().over(Window.partitionBy("c_mktsegment").orderBy("c_nationkey")).alias("dense"),
    )


@query(
    """SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS gid, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 9) AS discount, count(DISTINCT l_suppkey) AS suppliers
FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))"""
)
def grouping_sets_summary(spark: SparkSession, d: str) -> DataFrame:
    """Overall, by each key and by both in one pass."""
    rows = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_suppkey")
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    out = rows.groupingSets([[], [a], [b], [a, b]], a, b).agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 9).alias("discount"), F.countDistinct("l_suppkey").alias("suppliers"))
    return out.select(F.coalesce(a, F.lit("all")).alias("flag"), F.coalesce(b, F.lit("all")).alias("status"), "gid", "n", "quantity", "discount", "suppliers")


@query(
    """WITH c AS (SELECT event_type, CASE WHEN value >= 100 THEN 'very high' WHEN value >= 60 THEN 'high' WHEN value >= 20 THEN 'medium' ELSE 'low' END AS reason, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type, 2), (2)))
SELECT coalesce(event_type, 'all') AS event_type, reason, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, reason) AS place FROM c QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, reason) <= 3"""
)
def reason_summary(spark: SparkSession, d: str) -> DataFrame:
    """Top reasons per key and over all."""
    band = scalar.banded("value", ((100, "very high"), (60, "high"), (20, "medium")), "low")
    rows = table(spark, d, "events", "event_type", "value").select("event_type", band.alias("reason"))
    counts = rows.groupingSets([[F.col("event_type"), F.col("reason")], [F.col("reason")]], F.col("event_type"), F.col("reason")).agg(F.count("*").alias("n"))
    ranked = counts.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), "reason", "n").withColumn("place", windows.row_rank("event_type", F.desc("n"), "reason"))
    return ranked.where("place <= 3")


@query("SELECT CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS quality, count(*) FILTER (toxic = 0) AS clean, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (toxic IS NULL) AS missing FROM labels GROUP BY 1")
def crosstab_flags(spark: SparkSession, d: str) -> DataFrame:
    """Counts of two flags against each other, zero filled, missing apart."""
    rows = table(spark, d, "labels").select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("quality"), F.when(F.col("toxic") == 0, "clean").when(F.col("toxic") == 1, "toxic").otherwise("missing").alias("k"))
    return rows.groupBy("quality").pivot("k", ["clean", "toxic", "missing"]).count().na.fill(0)


@query(
    """WITH k AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), m AS (SELECT o_custkey, o_orderpriority AS mode, n AS mode_n FROM k QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1),
t AS (SELECT o_custkey, string_agg(o_orderpriority || ':' || n, ';' ORDER BY n DESC, o_orderpriority) AS top FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS r FROM k) WHERE r <= 3 GROUP BY 1),
d AS (SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ';' ORDER BY o_orderstatus) AS states, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY 1)
SELECT o_custkey, mode, mode_n, top, states, first_order FROM m JOIN t USING (o_custkey) JOIN d USING (o_custkey)""".replace("min_by(o_orderkey, (o_orderdate, o_orderkey))", "arg_min(o_orderkey, epoch(o_orderdate)::BIGINT * 1000000 + o_orderkey)")
)
def mode_and_top_values(spark: SparkSession, d: str) -> DataFrame:
    """Mode, top values as text, distinct states, first row of each key."""
    rows = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    extra = rows.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ";").alias("states"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))
    return stats.mode_value(rows, "o_custkey", "o_orderpriority").join(stats.top_values(rows, "o_custkey", "o_orderpriority", 3), "o_custkey").join(extra, "o_custkey")


_METRICS = """m AS (SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 9) AS discount, round(avg(l_tax), 9) AS tax FROM lineitem GROUP BY 1),
x AS (SELECT max(revenue) AS mr, max(quantity) AS mq FROM m), o AS (SELECT m.*, round(0.5 * revenue / mr + 0.3 * quantity / mq - 0.2 * discount, 9) AS balanced, round(0.8 * revenue / mr - 0.2 * tax, 9) AS income FROM m, x)"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of suppliers, rounded from exact sums: sums of doubles would round half a cent by
    the order in which partial sums arrive, which differs between two readings of one shuffle."""
    income, mean = F.col("l_extendedprice") * (1 - F.col("l_discount")), lambda c: F.round(stats.exact_mean(F.col(c), 10), 9)
    m = table(spark, d, "lineitem", "l_suppkey", "l_extendedprice", "l_discount", "l_quantity", "l_tax").groupBy("l_suppkey").agg(
        F.round(stats.exact_sum(income, 8), 2).alias("revenue"), F.round(stats.exact_mean(F.col("l_quantity"), 10), 6).alias("quantity"), mean("l_discount").alias("discount"), mean("l_tax").alias("tax")
    )
    top = m.agg(F.max("revenue").alias("mr"), F.max("quantity").alias("mq"))
    o = m.crossJoin(top)  # one row
    balanced = 0.5 * F.col("revenue") / F.col("mr") + 0.3 * F.col("quantity") / F.col("mq") - 0.2 * F.col("discount")
    return o.withColumn("balanced", F.round(balanced, 9)).withColumn("income", F.round(0.8 * F.col("revenue") / F.col("mr") - 0.2 * F.col("tax"), 9)).drop("mr", "mq")


@query(
    f"WITH {_METRICS} SELECT l_suppkey, revenue, quantity, discount, tax FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.revenue >= a.revenue AND b.quantity >= a.quantity AND b.discount <= a.discount AND b.tax <= a.tax AND (b.revenue > a.revenue OR b.quantity > a.quantity OR b.discount < a.discount OR b.tax < a.tax))"
)
def objective_pareto(spark: SparkSession, d: str) -> DataFrame:
    """Rows that none dominates over maximised and minimised metrics."""
    return stats.pareto(_metrics(spark, d), "l_suppkey", ["revenue", "quantity"], ["discount", "tax"])


@query(
    f"""WITH {_METRICS}, c AS (SELECT l_suppkey, 0 AS p, 'balanced' AS objective FROM (SELECT * FROM o ORDER BY balanced DESC, l_suppkey LIMIT 1) UNION ALL SELECT l_suppkey, 1, 'income' FROM (SELECT * FROM o ORDER BY income DESC, l_suppkey LIMIT 1)
UNION ALL SELECT l_suppkey, 2 + row_number() OVER (ORDER BY balanced DESC, l_suppkey), 'fill' FROM (SELECT * FROM o ORDER BY balanced DESC, l_suppkey LIMIT 5)),
u AS (SELECT l_suppkey, min(p) AS p, arg_min(objective, p) AS objective FROM c GROUP BY 1)
SELECT l_suppkey, row_number() OVER (ORDER BY p, l_suppkey) AS "rank", objective FROM u QUALIFY row_number() OVER (ORDER BY p, l_suppkey) <= 5"""
)
def top_configs(spark: SparkSession, d: str) -> DataFrame:
    """Best row of each objective score, none twice, filled up in order."""
    return stats.best_per_objective(_metrics(spark, d), "l_suppkey", ["balanced", "income"], 5)


@query(
    """WITH m AS (SELECT c_mktsegment AS grp, o_orderpriority AS config, avg(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), o AS (SELECT *, round((sum(v) OVER (PARTITION BY config) - v) / (count(*) OVER (PARTITION BY config) - 1), 9) AS others FROM m)
SELECT grp, config, round(others, 4) AS mean_others, round(v, 4) AS own FROM o QUALIFY row_number() OVER (PARTITION BY grp ORDER BY others DESC, config) = 1"""
)
def leave_one_out_selection(spark: SparkSession, d: str) -> DataFrame:
    """Per held-out group, the configuration of the best mean over the others."""
    m = table(spark, d, "orders", "o_custkey", "o_orderpriority", "o_totalprice").join(table(spark, d, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    m = m.groupBy(F.col("c_mktsegment").alias("grp"), F.col("o_orderpriority").alias("config")).agg(F.avg("o_totalprice").alias("v"))
    return stats.leave_one_out(m, "grp", "config", "v").select("grp", "config", F.round("mean_others", 4).alias("mean_others"), F.round("own", 4).alias("own"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((CASE WHEN l_quantity > 25 THEN 0.5 * l_quantity ELSE 0 END + 0.3 * l_tax) / (CASE WHEN l_quantity > 25 THEN 0.8 ELSE 0.3 END), 9) AS weighted,
round(1 / (1 + exp(-least(greatest(l_quantity - 25, -6), 6))), 9) AS squashed, CASE WHEN l_discount <= 0 THEN 0 ELSE l_tax / l_discount END AS ratio, CASE WHEN l_discount >= 0.065 THEN 'high' WHEN l_discount >= 0.035 THEN 'medium' ELSE 'low' END AS level,
concat_ws(';', CASE WHEN l_quantity > 40 THEN 'large' END, CASE WHEN l_discount > 0.05 THEN 'cheap' END, CASE WHEN l_tax = 0 THEN 'untaxed' END) AS reasons, l_tax > 0.02 OR l_discount > 0.02 AS any_high, lpad((round_even(l_quantity * 7.3, 0)::BIGINT // 60)::VARCHAR, 2, '0') || ':' || lpad((round_even(l_quantity * 7.3, 0)::BIGINT % 60)::VARCHAR, 2, '0') AS clock,
round((CASE WHEN l_quantity > 25 THEN l_quantity ELSE 0 END + l_tax + l_discount) / (CASE WHEN l_quantity > 25 THEN 3 ELSE 2 END), 9) AS mean FROM lineitem"""
)
def scalar_projection(spark: SparkSession, d: str) -> DataFrame:
    """Weighted means over present inputs, squashing, safe ratios, levels, reasons, clocks
    (P05-P08, P17, P19-P23)."""
    q, t, c = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    weighted = scalar.weighted_mean([(F.when(q > 25, q), 0.5), (t, 0.3)])
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(weighted, 9).alias("weighted"), F.round(scalar.sigmoid(q - 25), 9).alias("squashed"), scalar.safe_ratio(t, c).alias("ratio"),
        scalar.banded(c, ((0.065, "high"), (0.035, "medium")), "low").alias("level"),
        scalar.reasons([(q > 40, "large"), (c > 0.05, "cheap"), (t == 0, "untaxed")]).alias("reasons"), scalar.any_positive([t - 0.02, c - 0.02]).alias("any_high"), scalar.clock(q * 7.3).alias("clock"),
        F.round(scalar.row_mean([F.when(q > 25, q), t, c]), 9).alias("mean"),
    )


@query(
    """WITH s AS (SELECT o_orderkey AS id, o_orderkey % 97 AS n, CASE o_orderkey % 5 WHEN 0 THEN ' ' || (o_orderkey % 97) || '.50 ' WHEN 1 THEN 'nan' WHEN 2 THEN '' WHEN 3 THEN 'abc' ELSE (o_orderkey % 97)::VARCHAR END AS a,
CASE o_custkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'TRUE ' WHEN 2 THEN 'no' WHEN 3 THEN '1' END AS b, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 59) || ':' || (o_custkey % 60) WHEN 1 THEN (o_orderkey % 3) || ':' || (o_orderkey % 59) || ':' || (o_custkey % 60) WHEN 2 THEN (o_orderkey % 97)::VARCHAR ELSE 'x' END AS c,
CASE o_custkey % 4 WHEN 0 THEN 'o' WHEN 1 THEN '' WHEN 2 THEN 'maybe' ELSE 'N' END AS e, CASE WHEN o_custkey % 7 > 0 THEN (o_orderkey % 59)::VARCHAR END AS m, CASE WHEN o_orderkey % 6 > 0 THEN (o_custkey % 75)::VARCHAR END AS z FROM orders),
u AS (SELECT *, string_split(c, ':') AS part FROM s)
SELECT id, coalesce(CASE WHEN isfinite(try_cast(trim(a) AS DOUBLE)) THEN try_cast(trim(a) AS DOUBLE) END, 0) AS lenient, CASE WHEN isfinite(try_cast(trim(a) AS DOUBLE)) THEN try_cast(trim(a) AS DOUBLE) END AS strict, coalesce(lower(trim(b)) IN ('true', '1', 'yes', 'y'), false) AS truth,
CASE len(part) WHEN 3 THEN part[1]::DOUBLE * 3600 + part[2]::DOUBLE * 60 + part[3]::DOUBLE WHEN 2 THEN part[1]::DOUBLE * 60 + part[2]::DOUBLE ELSE try_cast(c AS DOUBLE) END AS seconds, CASE e WHEN 'o' THEN 'true' WHEN '' THEN 'missing' WHEN 'N' THEN 'false' ELSE 'uncertain' END AS tri,
CASE WHEN m IS NOT NULL AND z IS NOT NULL AND z::DOUBLE < 60 THEN m::DOUBLE * 60 + z::DOUBLE END AS at, CASE WHEN m IS NULL AND z IS NULL THEN 'both_missing' WHEN m IS NULL THEN 'minute_missing' WHEN z IS NULL THEN 'second_missing' WHEN z::DOUBLE >= 60 THEN 'second_range' ELSE 'ok' END AS issue FROM u"""
)
def lenient_casts(spark: SparkSession, d: str) -> DataFrame:
    """Text cells made of order rows as numbers, truths, times, three-valued answers, and minutes
    beside seconds (P01-P04, P18, P36)."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    text, part = lambda x: x.cast("string"), lambda x, n: (x % n).cast("string")
    rows = table(spark, d, "orders", "o_orderkey", "o_custkey").select(
        o.alias("id"),
        F.when(o % 5 == 0, F.concat(F.lit(" "), part(o, 97), F.lit(".50 "))).when(o % 5 == 1, "nan").when(o % 5 == 2, "").when(o % 5 == 3, "abc").otherwise(text(o % 97)).alias("a"),
        F.when(c % 5 == 0, "Yes").when(c % 5 == 1, "TRUE ").when(c % 5 == 2, "no").when(c % 5 == 3, "1").alias("b"),
        F.when(o % 4 == 0, F.concat_ws(":", part(o, 59), part(c, 60))).when(o % 4 == 1, F.concat_ws(":", part(o, 3), part(o, 59), part(c, 60))).when(o % 4 == 2, text(o % 97)).otherwise("x").alias("c"),
        F.when(c % 4 == 0, "o").when(c % 4 == 1, "").when(c % 4 == 2, "maybe").otherwise("N").alias("e"),
        F.when(c % 7 > 0, part(o, 59)).alias("m"),
        F.when(o % 6 > 0, part(c, 75)).alias("z"),
    )
    at, issue = scalar.minute_second("m", "z")
    return rows.select("id", scalar.lenient_number("a").alias("lenient"), scalar.strict_number("a").alias("strict"), scalar.truth("b").alias("truth"), scalar.seconds_of("c").alias("seconds"), scalar.tri_state("e").alias("tri"), at.alias("at"), issue.alias("issue"))


_METRIC_NAMES = ("recall", "precision", "boundary", "false_ratio", "over", "review", "missed_ratio", "short_recall")


@query(
    f"""WITH m AS (SELECT p_partkey, {', '.join(f"(p_partkey * {37 + 12 * k} % 101) / 100.0 AS {n}" for k, n in enumerate(_METRIC_NAMES))}, (p_size * 7 % 130) / 100.0 AS used FROM part)
SELECT p_partkey, round(0.35 * recall + 0.25 * "precision" + 0.15 * boundary - 0.15 * false_ratio - 0.05 * "over" - 0.05 * review, 6) AS balanced, round(0.42 * "precision" + 0.22 * boundary + 0.16 * recall - 0.14 * false_ratio - 0.06 * review, 6) AS precision_safe,
round(0.5 * recall + 0.18 * "precision" + 0.12 * boundary - 0.1 * missed_ratio - 0.05 * false_ratio - 0.05 * review, 6) AS recall_safe, round(0.36 * "precision" + 0.22 * boundary + 0.18 * recall + 0.14 * (1 - least(1, greatest(0, used))) - 0.1 * false_ratio, 6) AS low_overprediction,
round(0.4 * short_recall + 0.25 * recall + 0.15 * "precision" + 0.1 * boundary - 0.1 * false_ratio, 6) AS short_safe FROM m""".replace(" AS precision,", ' AS "precision",').replace(" AS over,", ' AS "over",')
)
def objective_scores(spark: SparkSession, d: str) -> DataFrame:
    """The five composite objectives over metric rows, one a part."""
    p = F.col("p_partkey")
    metrics = {n: p * (37 + 12 * k) % 101 / 100.0 for k, n in enumerate(_METRIC_NAMES)}
    scores = scoring.objectives(metrics, F.col("p_size") * 7 % 130 / 100.0)
    return table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", *[F.round(c, 6).alias(n) for n, c in scores.items()])


_ORDERS = "r AS (SELECT o_custkey, o_orderkey, o_totalprice / 1000.0 AS len, (o_orderkey * 37 % 101) / 100.0 AS score, o_orderkey % 7 = 0 AS ultra, sum(o_totalprice / 1000.0) OVER (PARTITION BY o_custkey) AS total FROM orders)"


def _budget_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 1000.0).alias("len"), (F.col("o_orderkey") * 37 % 101 / 100.0).alias("score"), (F.col("o_orderkey") % 7 == 0).alias("ultra"))


def _sql_budget(order: str, always: str, first: str, above: float) -> str:
    return f"""WITH RECURSIVE {_ORDERS}, k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {order}) AS pos FROM r),
f AS (SELECT o_custkey, o_orderkey, pos, true AS kept, len AS used FROM k WHERE pos = 1 AND ({always} OR {first} OR len <= 900)
UNION ALL SELECT o_custkey, o_orderkey, pos, false, 0.0::DOUBLE FROM k WHERE pos = 1 AND NOT ({always} OR {first} OR len <= 900)
UNION ALL SELECT k.o_custkey, k.o_orderkey, k.pos, {always} OR f.used + len <= 900, CASE WHEN {always} OR f.used + len <= 900 THEN f.used + len ELSE f.used END FROM f JOIN k ON k.o_custkey = f.o_custkey AND k.pos = f.pos + 1)
SELECT r.o_custkey, r.o_orderkey, r.total <= {above} OR f.kept AS kept FROM r JOIN f ON r.o_custkey = f.o_custkey AND r.o_orderkey = f.o_orderkey"""


@query(_sql_budget("ultra DESC, score DESC, o_orderkey", "ultra", "false", 1200.0))
def budget_guard(spark: SparkSession, d: str) -> DataFrame:
    """Skip-and-fill budget, ultra rows always kept, only above the soft limit."""
    order = [F.desc("ultra"), F.desc("score"), F.col("o_orderkey")]
    return folds.budget_guard(_budget_rows(spark, d), "o_custkey", "o_orderkey", "len", order, F.lit(900.0), F.lit(1200.0), F.col("ultra"))


@query(_sql_budget("score DESC, o_orderkey", "(ultra OR (k.o_orderkey % 4 >= 2 AND (k.o_orderkey * 53 % 101) / 100.0 >= 0.18 AND score >= 0.65))", "false", 1200.0))
def budget_guard_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The same in rank order alone, with the relaxed ultra flag."""
    relaxed = scoring.relaxed_ultra(F.col("ultra"), F.col("o_orderkey") % 4, F.col("o_orderkey") * 53 % 101 / 100.0, F.col("score"))
    return folds.budget_guard(_budget_rows(spark, d), "o_custkey", "o_orderkey", "len", [F.desc("score"), F.col("o_orderkey")], F.lit(900.0), F.lit(1200.0), relaxed)


@query(_sql_budget("score DESC, len, o_orderkey", "false", "true", 1500.0))
def budget_guard_first_kept(spark: SparkSession, d: str) -> DataFrame:
    """The same above the hard limit only, the first row always kept."""
    return folds.budget_guard(_budget_rows(spark, d), "o_custkey", "o_orderkey", "len", [F.desc("score"), F.col("len"), F.col("o_orderkey")], F.lit(900.0), F.lit(1500.0), first=True)


@query(
    f"""WITH {_ORDERS}, b AS (SELECT *, coalesce(sum(CASE WHEN ultra THEN 0 ELSE len END) OVER (PARTITION BY o_custkey ORDER BY score, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT o_custkey, o_orderkey, NOT (total > 1200 AND NOT ultra AND total - before > 900) AS kept FROM b"""
)
def budget_reverse_elimination(spark: SparkSession, d: str) -> DataFrame:
    """Lowest scores leave until the rest fits, as one window sum (W17d)."""
    return folds.reverse_elimination(_budget_rows(spark, d), "o_custkey", "o_orderkey", "len", "score", F.col("ultra"), F.lit(900.0), F.lit(1200.0))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderdate) > 1 AS is_repeated FROM orders")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose key occurs more than once."""
    return table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").select("o_orderkey", (F.count("*").over(Window.partitionBy("o_custkey", "o_orderdate")) > 1).alias("is_repeated"))


@query(
    """WITH s AS (SELECT * FROM (VALUES (0, 'train'), (1, 'validation'), (2, 'test')) v(b, split)), m AS (SELECT o_orderkey, o_totalprice, split, CASE split WHEN 'train' THEN 'development' WHEN 'validation' THEN 'development' ELSE 'held out' END AS role FROM orders JOIN s ON o_custkey % 3 = b)
SELECT coalesce(split, 'all') AS split, coalesce(role, 'all') AS role, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM m GROUP BY GROUPING SETS ((split, role), (role), ())"""
)
def split_summary(spark: SparkSession, d: str) -> DataFrame:
    """Split and role columns from a small dimension, summed by split and role."""
    dim = spark.createDataFrame([(0, "train"), (1, "validation"), (2, "test")], "b int, split string")
    rows = table(spark, d, "orders", "o_custkey", "o_totalprice").withColumn("b", (F.col("o_custkey") % 3).cast("int")).join(F.broadcast(dim), "b")
    rows = rows.withColumn("role", F.when(F.col("split") == "test", "held out").otherwise("development"))
    out = rows.groupingSets([[F.col("split"), F.col("role")], [F.col("role")], []], F.col("split"), F.col("role")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))
    return out.select(F.coalesce("split", F.lit("all")).alias("split"), F.coalesce("role", F.lit("all")).alias("role"), "n", "mean_price")


@query(
    """WITH c AS (SELECT w, h, t, 'w' || w || '_h' || h || '_t' || t AS config FROM (SELECT unnest([0.3, 0.5, 0.7]) AS w), (SELECT unnest([1, 2]) AS h), (SELECT unnest([0.35, 0.5]) AS t)),
e AS (SELECT event_type, value, (value / 100.0) AS s, CASE WHEN value >= 60 THEN 1.0 ELSE 0.0 END AS hard FROM events)
SELECT w, h::INTEGER AS h, t, event_type, count(*) FILTER (least(1, w * s + (1 - w) * hard / h) >= t) AS kept, round(avg(least(1, w * s + (1 - w) * hard / h)), 6) AS mean_score FROM c, e GROUP BY 1, 2, 3, 4"""
)
def config_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Every row scored under every configuration of a small literal grid."""
    grid = spark.createDataFrame([(w, h, t) for w in (0.3, 0.5, 0.7) for h in (1, 2) for t in (0.35, 0.5)], "w double, h int, t double")
    rows = table(spark, d, "events", "event_type", "value").withColumn("s", F.col("value") / 100.0).withColumn("hard", F.when(F.col("value") >= 60, 1.0).otherwise(0.0))
    score = F.least(F.lit(1.0), F.col("w") * F.col("s") + (1 - F.col("w")) * F.col("hard") / F.col("h"))
    tall = rows.crossJoin(F.broadcast(grid)).withColumn("score", score)  # twelve configurations
    return tall.groupBy("w", "h", "t", "event_type").agg(F.count_if(F.col("score") >= F.col("t")).alias("kept"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(
    """WITH l AS (SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || '=' || l_quantity::INTEGER, ',' ORDER BY l_linenumber, l_quantity, l_extendedprice) AS parts FROM lineitem GROUP BY 1)
SELECT o_custkey, count(*)::INTEGER AS n_orders, sum(n)::BIGINT AS n_lines, string_agg(o_orderkey || '[' || parts || ']', ';' ORDER BY o_orderdate, o_orderkey) AS outline FROM orders JOIN l ON o_orderkey = l_orderkey GROUP BY 1"""
)
def nested_manifest(spark: SparkSession, d: str) -> DataFrame:
    """One nested row a key, ordered intervals with their parts, written as JSON and outlined
    from the JSON read back (S15, S06)."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice"))).alias("lines"))
    rows = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    per = rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "lines"))).alias("orders"))
    kind = "array<struct<o_orderdate: timestamp, o_orderkey: bigint, lines: array<struct<l_linenumber: int, l_quantity: double, l_extendedprice: double>>>>"
    back = per.select("o_custkey", F.from_json(F.to_json("orders"), kind).alias("orders"))
    part = lambda x: F.concat_ws("=", x["l_linenumber"], x["l_quantity"].cast("int"))
    outline = F.transform("orders", lambda o: F.concat(o["o_orderkey"].cast("string"), F.lit("["), F.array_join(F.transform(o["lines"], part), ","), F.lit("]")))
    n_lines = F.aggregate("orders", F.lit(0).cast("long"), lambda s, o: s + F.size(o["lines"]))
    return back.select("o_custkey", F.size("orders").alias("n_orders"), n_lines.alias("n_lines"), F.array_join(outline, ";").alias("outline"))


@query("SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3")
def quota_examples(spark: SparkSession, d: str) -> DataFrame:
    """At most three examples a group, by priority."""
    rows = table(spark, d, "documents", "source", "doc_id", "n_chars").withColumn("k", windows.row_rank("source", F.desc("n_chars"), "doc_id"))
    return rows.where("k <= 3").drop("k")


@query("SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || ':20240524'), o_orderkey) AS k FROM orders QUALIFY k <= 20")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic sample of a group: the rows of the smallest seeded hashes."""
    rows = table(spark, d, "orders", "o_orderkey", "o_orderpriority").withColumn("h", F.md5(F.concat_ws(":", "o_orderkey", F.lit("20240524")).cast("binary")))
    return rows.withColumn("k", windows.row_rank("o_orderpriority", "h", "o_orderkey")).where("k <= 20").select("o_orderpriority", "o_orderkey", "k")


@query("SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL::INTEGER AS size FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL FROM supplier UNION ALL SELECT 'part', p_partkey, p_name, NULL, p_size FROM part")
def aligned_union(spark: SparkSession, d: str) -> DataFrame:
    """Tables of different columns as one, missing columns null."""
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    p = table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return c.unionByName(s).unionByName(p, allowMissingColumns=True)


@query("SELECT o_custkey, sha256(string_agg(printf('%.6f-%.6f', o_totalprice, o_totalprice + 1), '|' ORDER BY o_totalprice, o_orderkey)) AS checksum, 'C' || lpad(o_custkey::VARCHAR, 6, '0') AS stable_id FROM orders GROUP BY 1")
def interval_checksums(spark: SparkSession, d: str) -> DataFrame:
    """Checksum of the ordered intervals of a key, and a padded id."""
    item = F.format_string("%.6f-%.6f", F.col("o_totalprice"), F.col("o_totalprice") + 1)
    rows = table(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderkey").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_totalprice", "o_orderkey", item.alias("i")))).alias("x"))
    return rows.select("o_custkey", F.sha2(F.array_join(F.transform("x", lambda s: s["i"]), "|"), 256).alias("checksum"), scalar.sequence_id("C", "o_custkey", 6).alias("stable_id"))


@query(
    """WITH x AS (SELECT c_custkey, c_acctbal / 10000 AS v, CASE c_nationkey % 5 WHEN 0 THEN 'High' WHEN 1 THEN ' medium ' WHEN 2 THEN 'low_or_unknown' WHEN 3 THEN 'nan' END AS name FROM customer),
y AS (SELECT *, CASE WHEN trim(lower(coalesce(name, ''))) IN ('high', 'medium', 'low') THEN trim(lower(name)) WHEN trim(lower(coalesce(name, ''))) IN ('', 'nan', 'none') THEN 'low' ELSE 'unknown' END AS level FROM x)
SELECT c_custkey, CASE WHEN v >= 0.8 THEN 'high' WHEN v >= 0.45 THEN 'medium' ELSE 'low' END AS reliability, CASE WHEN v >= 0.70 THEN 'high' WHEN v >= 0.40 THEN 'medium' ELSE 'low' END AS relaxed, CASE WHEN v >= 0.95 THEN 'very_high' WHEN v >= 0.90 THEN 'high' WHEN v >= 0.75 THEN 'medium' ELSE 'low' END AS strength,
CASE WHEN v >= 0.70 THEN 'high' WHEN v >= 0.40 THEN 'medium' ELSE 'low' END AS percentile, level, level = 'high' AS is_high, level IN ('medium', 'high') AS is_medium_or_high, least(greatest(round_even(v * 29.97, 0)::BIGINT, 0), 19) AS frame FROM y"""
)
def level_bands(spark: SparkSession, d: str) -> DataFrame:
    """Levels by fixed cut-offs, level names and their predicates, frame numbers."""
    k = F.col("c_nationkey") % 5
    name = F.when(k == 0, "High").when(k == 1, " medium ").when(k == 2, "low_or_unknown").when(k == 3, "nan")
    rows = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal").select("c_custkey", (F.col("c_acctbal") / 10000).alias("v"), scalar.level_name(name).alias("level"))
    return rows.select(
        "c_custkey", scalar.reliability_level("v").alias("reliability"), scalar.relaxed_reliability_level("v").alias("relaxed"), scalar.strength_band("v").alias("strength"), scalar.percentile_level("v").alias("percentile"), "level",
        scalar.is_high("level").alias("is_high"), scalar.is_medium_or_high("level").alias("is_medium_or_high"), scalar.frame_index("v", F.lit(29.97), F.lit(20)).cast("long").alias("frame"),
    )
