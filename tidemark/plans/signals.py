"""Signal queries: vectors as samples, histograms and grey rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import signal
from tidemark.operators import intervals as iv
from tidemark.plans.registry import CELL, HOUR, P, points, query, table


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), f AS (SELECT vec_id, i::INTEGER AS frame, x[i * 8 + 1 : i * 8 + 16] AS y FROM v, range(0, 7) r(i)),
g AS (SELECT vec_id, frame, round(sqrt(list_sum(list_transform(y, lambda a: a * a)) / 16), 9) AS rms, round(len(list_filter(range(1, 16), lambda k: (y[k] >= 0) <> (y[k + 1] >= 0))) / 15, 9) AS zcr FROM f) SELECT * FROM g"""
)
def audio_frames(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping frames of samples with level and zero crossings (G05, time-domain part of G06)."""
    f = _vectors(spark, d).select("vec_id", F.posexplode(signal.frames("x", 16, 8)).alias("frame", "y"))
    return f.select("vec_id", "frame", F.round(signal.rms("y"), 9).alias("rms"), F.round(signal.zero_crossings("y"), 9).alias("zcr"))


@query()
def audio_features(spark: SparkSession, d: str) -> DataFrame:
    """Spectral features, cepstrum and onsets of samples."""
    made = _vectors(spark, d).select("vec_id", signal.sound_feature_columns(16000, 16, 8)("x").alias("f"))
    return made.select("vec_id", *[F.round(F.col(f"f.{n}"), 6).alias(n) for n in signal.FEATURES])


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), m AS (SELECT vec_id, x, list_aggregate(x, 'median') + list_aggregate(x, 'stddev_pop') AS lv FROM v)
SELECT vec_id, len(list_filter(range(2, len(x)), lambda i: x[i] > x[i - 1] AND x[i] >= x[i + 1] AND x[i] > lv)) AS n_peaks, round(lv, 9) AS level FROM m"""
)
def onset_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Inner maxima over median plus deviation."""
    v = _vectors(spark, d)
    sorted_ = F.array_sort("x")
    n = F.size("x")
    mid = (F.element_at(sorted_, F.ceil(n / 2).cast("int")) + F.element_at(sorted_, (F.floor(n / 2) + 1).cast("int"))) / 2
    mean = signal.total("x") / n
    sd = F.sqrt(F.aggregate("x", F.struct(F.lit(0.0).alias("s"), mean.alias("m")), lambda a, y: F.struct((a["s"] + (y - a["m"]) * (y - a["m"])).alias("s"), a["m"].alias("m")))["s"] / n)
    rows = v.withColumn("level", mid + sd)
    return rows.select("vec_id", signal.peaks("x", F.col("level")).cast("long").alias("n_peaks"), F.round("level", 9).alias("level"))


def _pixel(dr: int, dc: int) -> str:
    """SQL of the pixel beside pixel i of an 8 x 8 frame, border pixels repeated outwards."""
    return f"g[greatest(0, least(7, i // 8 + ({dr}))) * 8 + greatest(0, least(7, i % 8 + ({dc}))) + 1]"


_GRADIENT = " + ".join(
    f"abs(({_pixel(*p[0])} + 2 * {_pixel(*p[1])} + {_pixel(*p[2])}) - ({_pixel(*q[0])} + 2 * {_pixel(*q[1])} + {_pixel(*q[2])}))"
    for p, q in (([(-1, 1), (0, 1), (1, 1)], [(-1, -1), (0, -1), (1, -1)]), ([(1, -1), (1, 0), (1, 1)], [(-1, -1), (-1, 0), (-1, 1)]))
)
_FRAMES = f"""v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda a: abs(a) * 255) AS g FROM embeddings), w AS (SELECT *, list_transform(range(0, 64), lambda i: {_GRADIENT}) AS m FROM v),
h AS (SELECT vec_id, g, list_transform(range(0, 64), lambda i: (m[i + 1] >= 160 OR (m[i + 1] >= 80 AND len(list_filter(range(0, 64), lambda j: j <> i AND abs(j // 8 - i // 8) <= 1 AND abs(j % 8 - i % 8) <= 1 AND m[j + 1] >= 160)) > 0))::INTEGER) AS e FROM w),
s AS (SELECT vec_id, g, e, lag(g) OVER t AS b, lag(e) OVER t AS f FROM h WINDOW t AS (PARTITION BY vec_id // 64 ORDER BY vec_id))"""


@query(
    f"""WITH {_FRAMES}, k AS (SELECT vec_id, g, b, list_sum(g) / 64 AS ma, list_sum(b) / 64 AS mb, len(list_filter(range(1, 65), lambda i: e[i] <> f[i])) / 64 AS edge FROM s WHERE b IS NOT NULL),
m AS (SELECT *, list_dot_product(g, g) / 64 - ma * ma AS va, list_dot_product(b, b) / 64 - mb * mb AS vb, list_dot_product(g, b) / 64 - ma * mb AS cv, list_sum(list_transform(range(1, 65), lambda i: sqrt(g[i] * b[i]))) / sqrt(list_sum(g) * list_sum(b)) AS bc FROM k),
c AS (SELECT *, sqrt(greatest(0, 1 - bc)) AS hist, ((2 * ma * mb + 6.5025) * (2 * cv + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225)) AS ssim FROM m)
SELECT vec_id, round(hist, 6) AS hist, round(ssim, 6) AS ssim, round(edge, 6) AS edge, round(0.45 * hist + 0.2 * abs(ma - mb) / 255 + 0.2 * (1 - ssim) / 2 + 0.15 * edge, 6) AS score FROM c"""
)
def frame_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Change score of consecutive 8 x 8 grey frames of a clip, edges included."""
    g = _vectors(spark, d).select("vec_id", F.transform("x", lambda a: F.abs(a) * 255).alias("g"))
    shown = g.withColumn("m", signal.gradient("g", 8)).withColumn("e", signal.edges("m", 8))
    before = Window.partitionBy(F.floor(F.col("vec_id") / 64)).orderBy("vec_id")
    s = shown.select("vec_id", "g", "e", F.lag("g").over(before).alias("b"), F.lag("e").over(before).alias("f")).where("b is not null")
    made = s.select(
        "vec_id", signal.histogram_distance("g", "b").alias("hist"), signal.similarity("g", "b").alias("ssim"), (F.abs(signal.total("g") - signal.total("b")) / 64 / 255).alias("bright"), signal.edge_change("e", "f").alias("edge")
    )
    score = signal.change_score(F.col("hist"), F.col("bright"), F.col("ssim"), F.col("edge"))
    return made.select("vec_id", F.round("hist", 6).alias("hist"), F.round("ssim", 6).alias("ssim"), F.round("edge", 6).alias("edge"), F.round(score, 6).alias("score"))


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda a: abs(a) * 255) AS g FROM embeddings), l AS (SELECT vec_id, list_sum(g) / 64 AS mean, list_min(g) AS min, list_sort(g)[7] AS p10, len(list_filter(g, lambda a: a < 25)) / 64 AS dark FROM v)
SELECT vec_id, round(mean, 6) AS mean, round(min, 6) AS min, round(p10, 6) AS p10, round(dark, 9) AS dark_ratio, mean < 25 OR dark > 0.9 AS black FROM l"""
)
def luma_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Brightness of grey rows and which count as black."""
    rows = _vectors(spark, d).select("vec_id", signal.luma(F.transform("x", lambda a: F.abs(a) * 255)).alias("l"))
    return rows.select("vec_id", F.round("l.mean", 6).alias("mean"), F.round("l.min", 6).alias("min"), F.round("l.p10", 6).alias("p10"), F.round("l.dark_ratio", 9).alias("dark_ratio"), F.col("l.black").alias("black"))


#: Reach of the context and of the rows before it, step of a sample, least dark run, guard of the timeline's end.
_CONTEXT, _BEFORE, _STEP, _SUSTAINED, _GUARD = 15 * HOUR, 30 * HOUR, 5 * HOUR, 10 * HOUR, 24 * HOUR


@query(
    f"""WITH {P}, a AS (SELECT user_id, event_id, t, max(t) OVER (PARTITION BY user_id) - {_GUARD} AS guard, event_type FROM p),
j AS (SELECT a.user_id, a.event_id, a.t, a.guard, x.t AS s, x.event_id AS e, x.value, abs(x.t - a.t) <= {_CONTEXT} AS near, x.value < 10 AS dark FROM a JOIN p x ON a.user_id = x.user_id AND x.event_type = 'view' AND abs(x.t - a.t) <= {_BEFORE} WHERE a.event_type = 'purchase'),
r AS (SELECT user_id, event_id, max(n) AS longest FROM (SELECT user_id, event_id, g, count(*) FILTER (dark) AS n FROM (SELECT *, sum(CASE WHEN dark THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, event_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM j WHERE near) GROUP BY 1, 2, 3) GROUP BY 1, 2),
f AS (SELECT user_id, event_id, count(*) FILTER (near AND dark) AS n_dark, avg(value) FILTER (near AND s < t) AS pre, avg(value) FILTER (near AND s > t) AS post, greatest(max(value) FILTER (near), coalesce(median(value) FILTER (s < t), max(value) FILTER (near))) AS high, min(value) FILTER (near AND dark) AS low, min(s) FILTER (near AND dark) AS first_dark FROM j GROUP BY 1, 2),
z AS (SELECT a.user_id, a.event_id, coalesce(n_dark, 0) AS n_dark, pre, post, coalesce(longest, 0) AS longest_run, coalesce(longest, 0) * {_STEP} >= {_SUSTAINED} AS sustained, coalesce(n_dark > 0 AND high - low >= 35, false) AS fade, a.t >= a.guard OR coalesce(first_dark >= a.guard, false) AS guarded
  FROM a LEFT JOIN f ON a.user_id = f.user_id AND a.event_id = f.event_id LEFT JOIN r ON a.user_id = r.user_id AND a.event_id = r.event_id WHERE a.event_type = 'purchase')
SELECT user_id, event_id, n_dark, round(pre, 6) AS pre, round(post, 6) AS post, longest_run, guarded, (n_dark > 0 OR sustained OR fade) AND NOT guarded AS eligible, CASE WHEN sustained AND fade THEN 'strong' WHEN sustained OR fade THEN 'medium' WHEN n_dark > 0 THEN 'weak' ELSE 'none' END AS support FROM z"""
)
def dark_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Dark rows around an anchor: the longest run of them, fall of brightness, strength of
    support, and whether the timeline's end accounts for it (G10)."""
    every = points(spark, d)
    ends = every.groupBy("user_id").agg((F.max("t") - _GUARD).alias("guard"))
    anchors = every.where("event_type = 'purchase'").select("user_id", "event_id", F.col("t").alias("at"))
    reach = anchors.select("user_id", "event_id", "at", (F.col("at") - _BEFORE).alias("r_start"), (F.col("at") + _BEFORE).alias("r_end"))
    views = every.where("event_type = 'view'").select("user_id", "t", "value", F.col("event_id").alias("view_id"))
    rows = iv.points_in_intervals(views, reach, "user_id", "t", CELL).where(F.abs(F.col("t") - F.col("at")) <= _BEFORE)
    rows = rows.withColumn("near", F.abs(F.col("t") - F.col("at")) <= _CONTEXT).withColumn("dark", F.col("value") < 10)
    # A run of dark rows follows one row that is not dark; rows outside the context are in no run.
    along = Window.partitionBy("user_id", "event_id", "near").orderBy("t", "view_id").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(F.when(F.col("dark"), 0).otherwise(1)).over(along)
    rows = rows.withColumn("run", run).withColumn("in_run", F.sum(F.col("dark").cast("int")).over(Window.partitionBy("user_id", "event_id", "near", "run")))
    only = lambda c, when: F.when(when, F.col(c))
    near, seen = F.col("near"), F.col("near") & F.col("dark")
    f = rows.groupBy("user_id", "event_id").agg(
        F.count_if(seen).alias("n_dark"),
        F.avg(only("value", near & (F.col("t") < F.col("at")))).alias("pre"),
        F.avg(only("value", near & (F.col("t") > F.col("at")))).alias("post"),
        F.greatest(F.max(only("value", near)), F.median(only("value", F.col("t") < F.col("at")))).alias("high"),
        F.min(only("value", seen)).alias("low"),
        F.min(only("t", seen)).alias("first_dark"),
        F.coalesce(F.max(only("in_run", near)), F.lit(0)).alias("longest"),
    )
    out = anchors.join(f, ["user_id", "event_id"], "left").join(ends, "user_id")
    no = lambda c: F.coalesce(c, F.lit(False))
    out = out.withColumns({"n_dark": F.coalesce("n_dark", F.lit(0)), "longest_run": F.coalesce("longest", F.lit(0)).cast("long")})
    has, sustained, fade = F.col("n_dark") > 0, F.col("longest_run") * _STEP >= _SUSTAINED, no((F.col("n_dark") > 0) & (F.col("high") - F.col("low") >= 35))
    out = out.withColumn("guarded", (F.col("at") >= F.col("guard")) | no(F.col("first_dark") >= F.col("guard")))
    return out.select("user_id", "event_id", "n_dark", F.round("pre", 6).alias("pre"), F.round("post", 6).alias("post"), "longest_run", "guarded", ((has | sustained | fade) & ~F.col("guarded")).alias("eligible"), signal.dark_support(has, sustained, fade).alias("support"))


@query("WITH b AS (SELECT p_partkey, p_size::DOUBLE AS w, p_retailprice / 100 AS h FROM part) SELECT p_partkey, round(w * h / 2, 6) AS area FROM b")
def polygon_area(spark: SparkSession, d: str) -> DataFrame:
    """Area of a polygon of points: here triangles with two known sides."""
    w, h = F.col("p_size").cast("double"), F.col("p_retailprice") / 100
    zero = F.lit(0.0)
    shape = F.array(F.array(zero, zero), F.array(w, zero), F.array(w * 0.25, h))
    return table(spark, d, "part", "p_partkey", "p_size", "p_retailprice").select("p_partkey", F.round(signal.polygon_area(shape), 6).alias("area"))
