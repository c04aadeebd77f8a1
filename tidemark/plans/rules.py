"""Rule queries: cues, machines, scores, folds, matching, post-processing and diagnosis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import folds, fsm, graph, scoring, stats, windows
from tidemark.operators import intervals as iv
from tidemark.plans.registry import CELL, GAP, HOUR, P, of, points, query, sql_clusters, table
from tidemark.sources.tabular import only_splits

_T0 = 1704067200.0

_CUES = f"""{P}, q AS (SELECT *, event_type = 'purchase' AND value >= 40 AS hard, event_type = 'click' AND value >= 20 AS start_support, event_type = 'view' AS continuity, event_type = 'error' AND value >= 25 AS end_support, event_type = 'signup' AS weak,
event_type = 'purchase' AND t - {_T0} < {36 * HOUR} AND value < 80 AS opening_only, (event_type = 'click' AND value < 24) OR (event_type IN ('purchase', 'error') AND floor(value) % 5 = 0) AS audio_only, event_type IN ('purchase', 'error') AND floor(value) % 3 = 0 AS scene_only, event_type = 'view' AND value < 2 AS fuzzy_only, event_type = 'click' AND value >= 50 AS audio_start, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END + CASE WHEN event_type = 'purchase' AND value >= 70 THEN 1 ELSE 0 END AS kinds, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM p)"""


def _limits() -> fsm.Limits:
    """The default limits with an hour for a second."""
    base = fsm.Limits()
    longer = {k: getattr(base, k) * HOUR for k in ("opening_sec", "fresh_sec", "support_sec", "close_sec", "shortest", "early_sec", "long_sec", "unresolved_sec", "rejected_sec", "recent_sec", "text_sec", "bridge_sec", "bridge_both_sec")}
    return fsm.Limits(**longer)


def _cues(spark: SparkSession, d: str) -> DataFrame:
    """Event rows with boolean cues: each machine reads those it knows."""
    k, v, t = F.col("event_type"), F.col("value"), F.col("t") - _T0
    flags = {
        "hard": (k == "purchase") & (v >= 40), "start_support": (k == "click") & (v >= 20), "continuity": k == "view", "end_support": (k == "error") & (v >= 25), "weak": k == "signup",
        "opening_only": (k == "purchase") & (t < 36 * HOUR) & (v < 80), "fuzzy_only": (k == "view") & (v < 2), "audio_only": ((k == "click") & (v < 24)) | (k.isin("purchase", "error") & (F.floor(v) % 5 == 0)), "scene_only": k.isin("purchase", "error") & (F.floor(v) % 3 == 0), "audio": (k == "click") & (v >= 24), "ocr_hard": (k == "purchase") & (v >= 60),
        "recent_hard": (k == "purchase") & (v >= 50), "strong": (k == "purchase") & (v >= 30), "support": k.isin("click", "view"), "known_low": (k == "error") & (v >= 40), "conflict": (k == "error") & (v < 5), "start_high": (k == "purchase") & (v >= 60),
        "start_medium": (k == "purchase") & (v >= 20) & (v < 60), "audio_start": (k == "click") & (v >= 50), "unreliable": v < 15, "text": (k == "view") & (v >= 20), "product": (k == "signup") & (v >= 40), "rise": (k == "click") & (v >= 60), "confirm": k.isin("purchase", "view") & (v >= 15),
        "kind_product": k.isin("purchase", "signup"), "kind_call": (k == "purchase") & (v >= 70),
    }
    return points(spark, d).select("*", *[c.alias(n) for n, c in flags.items()], F.lit(30 * 24 * HOUR).alias("duration"))


def _machine(spark: SparkSession, d: str, name: str) -> DataFrame:
    return fsm.intervals(_cues(spark, d), "user_id", "t", "event_id", name, _limits(), "duration")


def sql_walk(cues: str, lim: fsm.Limits) -> str:
    """The current machine as a recursive walk: one row a step, with what it emits."""
    return f"""WITH RECURSIVE {cues},
w AS (SELECT user_id, 0::BIGINT AS i, 'outside' AS st, NULL::DOUBLE AS a, NULL::DOUBLE AS pt, NULL::BIGINT AS pi, NULL::VARCHAR AS pw, NULL::DOUBLE AS lh, NULL::DOUBLE AS sf, 0 AS sn, NULL::VARCHAR AS kind, NULL::DOUBLE AS os, NULL::DOUBLE AS oe, NULL::VARCHAR AS ow, 0 AS seq, false AS took, NULL::BIGINT AS pk FROM (SELECT DISTINCT user_id FROM q)
UNION ALL
SELECT user_id, i, nst,
  CASE WHEN nst = 'outside' THEN NULL WHEN st = 'outside' AND nst = 'inside' THEN t WHEN st = 'opening' AND nst = 'inside' THEN pt ELSE a END,
  CASE WHEN nst IN ('opening', 'closing') THEN CASE WHEN st = nst THEN pt ELSE t END END,
  CASE WHEN nst IN ('opening', 'closing') THEN CASE WHEN st = nst THEN pi ELSE i END END,
  CASE WHEN nst = 'closing' THEN CASE WHEN st = 'closing' THEN pw WHEN end_support THEN 'end support' WHEN t - coalesce(nlh, a) > {lim.fresh_sec} THEN 'freshness' ELSE 'support cap' END END,
  CASE WHEN st = 'closing' AND nst = 'outside' THEN NULL ELSE nlh END, CASE WHEN st = 'closing' AND nst = 'outside' THEN NULL ELSE nsf END, CASE WHEN st = 'closing' AND nst = 'outside' THEN 0 ELSE nsn END,
  CASE WHEN st = 'closing' AND nst = 'outside' THEN 'closed' WHEN nst = 'outside' AND (st = 'opening' OR opening_only) THEN 'review' END,
  CASE WHEN st = 'closing' THEN a WHEN st = 'opening' THEN pt ELSE t END, CASE WHEN st = 'closing' THEN pt ELSE t END,
  CASE WHEN st = 'closing' THEN pw WHEN st = 'opening' AND end_support THEN 'cancelled by end support' WHEN st = 'opening' THEN 'not confirmed in time' ELSE 'opening notice' END,
  CASE WHEN nst = 'inside' AND st IN ('outside', 'opening') THEN seq + 1 ELSE seq END, nst = 'inside' OR (st = 'inside' AND nst = 'closing'), CASE WHEN nst = 'inside' AND st = 'opening' THEN pi END
FROM (SELECT *, CASE st
    WHEN 'outside' THEN CASE WHEN opening_only THEN 'outside' WHEN hard THEN 'inside' WHEN start_support AND NOT audio_only AND NOT scene_only THEN 'opening' ELSE 'outside' END
    WHEN 'opening' THEN CASE WHEN hard THEN 'inside' WHEN end_support THEN 'outside' WHEN t - pt > {lim.opening_sec} OR i - pi + 1 > {lim.opening_rows} THEN 'outside' ELSE 'opening' END
    WHEN 'inside' THEN CASE WHEN (end_support AND NOT hard) OR t - coalesce(nlh, a) > {lim.fresh_sec} OR coalesce(t - nsf > {lim.support_sec} AND nsn > {lim.support_rows}, false) THEN 'closing' ELSE 'inside' END
    ELSE CASE WHEN hard OR (continuity AND NOT end_support) THEN 'inside' WHEN end_support OR t - pt >= {min(lim.close_sec, lim.fresh_sec)} THEN 'outside' ELSE 'closing' END END AS nst
  FROM (SELECT w.user_id, w.st, w.a, w.pt, w.pi, w.pw, w.seq, q.i, q.t, q.hard, q.start_support, q.continuity, q.end_support, q.opening_only, q.audio_only, q.scene_only,
    CASE WHEN q.hard THEN q.t ELSE w.lh END AS nlh, CASE WHEN q.hard THEN NULL WHEN q.start_support OR q.continuity THEN coalesce(w.sf, q.t) ELSE w.sf END AS nsf, CASE WHEN q.hard THEN 0 WHEN q.start_support OR q.continuity THEN w.sn + 1 ELSE w.sn END AS nsn
    FROM w JOIN q ON q.user_id = w.user_id AND q.i = w.i + 1)))"""


def sql_strict(cues: str, lim: fsm.Limits) -> str:
    """The earlier machine as a recursive walk: what waits, starts, pauses and ends at each row."""
    return f"""WITH RECURSIVE {cues},
w AS (SELECT user_id, 0::BIGINT AS i, 'outside' AS st, NULL::DOUBLE AS a, NULL::DOUBLE AS pt, NULL::BIGINT AS pi, NULL::DOUBLE AS lh, NULL::DOUBLE AS sf, 0 AS sn, NULL::VARCHAR AS kind, NULL::DOUBLE AS os, NULL::DOUBLE AS oe, NULL::VARCHAR AS ow FROM (SELECT DISTINCT user_id FROM q)
UNION ALL
SELECT user_id, i, nst, CASE WHEN nst IN ('outside', 'opening') THEN NULL WHEN st = 'outside' THEN t WHEN st = 'opening' THEN pt ELSE a END,
  CASE WHEN nst IN ('opening', 'closing') THEN CASE WHEN st = nst THEN pt ELSE t END END, CASE WHEN nst IN ('opening', 'closing') THEN CASE WHEN st = nst THEN pi ELSE i END END,
  CASE WHEN st = 'closing' AND nst = 'outside' THEN NULL ELSE nlh END, CASE WHEN st = 'closing' AND nst = 'outside' THEN NULL ELSE nsf END, CASE WHEN st = 'closing' AND nst = 'outside' THEN 0 ELSE nsn END,
  CASE WHEN nst <> 'outside' THEN NULL WHEN st = 'closing' THEN 'closed' WHEN st = 'opening' OR opening_only OR audio_start OR NOT weak THEN 'review' END,
  CASE st WHEN 'closing' THEN a WHEN 'opening' THEN pt ELSE t END, CASE WHEN st = 'closing' THEN pt ELSE t END,
  CASE WHEN st = 'closing' AND t - pt >= {lim.close_sec} THEN 'no hard evidence in time' WHEN st = 'closing' THEN 'low flow' WHEN st = 'opening' THEN 'not confirmed in time' WHEN opening_only THEN 'opening notice' ELSE 'weak, sound or scene alone' END
FROM (SELECT *, CASE st
    WHEN 'outside' THEN CASE WHEN opening_only THEN 'outside' WHEN hard THEN 'inside' WHEN support THEN 'opening' ELSE 'outside' END
    WHEN 'opening' THEN CASE WHEN hard AND t - pt <= {lim.opening_sec} AND i - pi <= {lim.opening_rows} THEN 'inside' WHEN t - pt > {lim.opening_sec} OR i - pi > {lim.opening_rows} THEN 'outside' ELSE 'opening' END
    WHEN 'inside' THEN CASE WHEN t - coalesce(nlh, a) > {lim.fresh_sec} OR (t - coalesce(nsf, t) > {lim.support_sec} AND nsn >= {lim.support_rows}) OR end_support THEN 'closing' ELSE 'inside' END
    ELSE CASE WHEN hard THEN 'inside' WHEN t - pt >= {lim.close_sec} OR end_support THEN 'outside' ELSE 'closing' END END AS nst
  FROM (SELECT w.user_id, w.st, w.a, w.pt, w.pi, q.i, q.t, q.hard, q.weak, q.end_support, q.opening_only, q.audio_start, q.start_support OR q.continuity AS support,
    CASE WHEN q.hard THEN q.t ELSE w.lh END AS nlh, CASE WHEN q.hard THEN NULL WHEN q.start_support OR q.continuity THEN coalesce(w.sf, q.t) ELSE w.sf END AS nsf, CASE WHEN q.hard THEN 0 WHEN q.start_support OR q.continuity THEN w.sn + 1 ELSE w.sn END AS nsn
    FROM w JOIN q ON q.user_id = w.user_id AND q.i = w.i + 1)))"""


_WALK = sql_walk(_CUES, _limits())
_STRICT = fsm.Limits(**{**vars(_limits()), "opening_sec": 15 * HOUR, "support_sec": 15 * HOUR, "support_rows": 3})
_EMITTED = " SELECT user_id, kind, os AS start, oe AS \"end\", ow AS end_reason FROM w WHERE kind IS NOT NULL"
_LEFT_OPEN = " UNION ALL SELECT w.user_id, 'open', w.a, q.t, 'end of rows' FROM w JOIN (SELECT user_id, max(i) AS i, max(t) AS t FROM q GROUP BY 1) q ON w.user_id = q.user_id AND w.i = q.i WHERE w.a IS NOT NULL"


@query(_WALK + _EMITTED + _LEFT_OPEN)
def fsm_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Closed, reviewed and open intervals of the current machine."""
    return _machine(spark, d, "evidence").select("user_id", "kind", "start", "end", "end_reason")


@query(_WALK + " SELECT user_id, st AS state_after, count(*) AS n, max(i)::BIGINT AS last_row FROM w WHERE i > 0 GROUP BY 1, 2")
def fsm_trace(spark: SparkSession, d: str) -> DataFrame:
    """Trace of the machine, counted by state."""
    rows = fsm.trace(_cues(spark, d), "user_id", "t", "event_id", "evidence", _limits(), "duration")
    numbered = rows.withColumn("i", windows.row_rank("user_id", "t"))
    return numbered.groupBy("user_id", "state_after").agg(F.count("*").alias("n"), F.max("i").cast("long").alias("last_row"))


_LONG_OPEN = _LEFT_OPEN.replace("'open'", "'unresolved'").replace("'end of rows'", "'long, left open'") + f" AND q.t - w.a > {_STRICT.unresolved_sec}"


@query(sql_strict(_CUES, _STRICT) + _EMITTED + _LEFT_OPEN + _LONG_OPEN)
def fsm_strict(spark: SparkSession, d: str) -> DataFrame:
    """The earlier form: starts confirmed in time or reviewed, ends resumed by hard evidence alone."""
    return fsm.intervals(_cues(spark, d), "user_id", "t", "event_id", "strict", _STRICT, "duration").select("user_id", "kind", "start", "end", "end_reason")


@query()
def fsm_support(spark: SparkSession, d: str) -> DataFrame:
    """Pattern-confirmed starts, support caps, open intervals split three ways."""
    return _machine(spark, d, "support")


@query()
def fsm_strong(spark: SparkSession, d: str) -> DataFrame:
    """Recent strong rows keep an interval, caps date its end back."""
    return _machine(spark, d, "strong")


@query()
def fsm_guarded(spark: SparkSession, d: str) -> DataFrame:
    """Sound alone must be confirmed by text."""
    return _machine(spark, d, "guarded")


@query()
def fsm_levels(spark: SparkSession, d: str) -> DataFrame:
    """The first form, with bridges over low rows."""
    return _machine(spark, d, "levels")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Closed intervals, scored and filtered; open ones are reported by fsm_intervals alone."""
    closed = _machine(spark, d, "evidence").where("kind = 'closed'")
    scored = scoring.scored(closed.withColumn("duration", F.lit(30 * 24 * HOUR)), HOUR, "duration")
    out = scoring.filtered(scored, HOUR, fsm.CUES)
    return out.withColumn("cand_id", windows.row_rank("user_id", "start", "end"))


_SCORED = f"""{_WALK},
made AS (SELECT user_id, seq, kind, os AS start, oe AS "end", ow AS why FROM w WHERE kind = 'closed'),
took AS (SELECT w.user_id, w.seq, q.* EXCLUDE (user_id) FROM w JOIN q ON q.user_id = w.user_id AND q.i = w.i WHERE w.took UNION ALL SELECT w.user_id, w.seq, q.* EXCLUDE (user_id) FROM w JOIN q ON q.user_id = w.user_id AND q.i = w.pk),
spans AS (SELECT user_id, seq, g, max(t) FILTER (weak) - min(t) FILTER (weak) AS span FROM (SELECT *, sum(CASE WHEN weak THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, seq ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM took) GROUP BY 1, 2, 3),
n AS (SELECT user_id, seq, count(*) AS n, count(*) FILTER (hard) AS hard, count(*) FILTER (start_support) AS ss, count(*) FILTER (continuity) AS ct, count(*) FILTER (event_type = 'purchase' AND value >= 60) AS oh, count(*) FILTER (event_type = 'purchase' AND value >= 50) AS rh,
count(*) FILTER (event_type = 'click' AND value >= 24) AS au, bool_or(opening_only) AS oo, bool_or(fuzzy_only) AS fo, bool_and(audio_only) AS ao, bool_and(scene_only) AS so, max(kinds) AS kinds FROM took GROUP BY 1, 2),
f AS (SELECT made.*, n.* EXCLUDE (user_id, seq), greatest(1, (made."end" - made.start) / {HOUR}) AS len, coalesce((SELECT max(span) FROM spans s WHERE s.user_id = made.user_id AND s.seq = made.seq), 0) / {HOUR} AS weak_span FROM made JOIN n ON made.user_id = n.user_id AND made.seq = n.seq),
g AS (SELECT *, hard / greatest(1, len / 60) AS hd FROM f),
b AS (SELECT *, least(1, hd / 4) AS dens, least(1, CASE WHEN hard > 0 THEN 1 ELSE 0.62 END + least(0.18, 0.04 * ss)) * 0.3 + least(1, (hard + 0.5 * ct + 0.3 * ss) / n) * 0.22 + CASE WHEN why = 'end support' THEN 0.86 WHEN why = 'freshness' THEN 0.68 WHEN why = 'support cap' THEN 0.58 ELSE 0.35 END * 0.16 + least(1, hd / 4) * 0.17 + least(1, (rh + 0.5 * oh) / n) * 0.1 + least(1, au / n) * 0.05 AS base FROM g),
c AS (SELECT *, CASE WHEN weak_span > 35 THEN 0.08 ELSE 0 END + CASE WHEN len >= 180 THEN 0.08 ELSE 0 END + CASE WHEN oo THEN 0.3 ELSE 0 END + CASE WHEN fo THEN 0.24 ELSE 0 END + CASE WHEN ao THEN 0.28 ELSE 0 END + CASE WHEN so THEN 0.32 ELSE 0 END + CASE WHEN len > 240 THEN 0.08 ELSE 0 END + CASE WHEN len >= 180 AND dens < 0.35 THEN 0.12 ELSE 0 END AS penalty FROM b),
x AS (SELECT *, greatest(0, least(1, base - penalty)) AS score FROM c), y AS (SELECT *, least(1, score / greatest(1, len / 60)) AS sd FROM x),
z AS (SELECT *, least(1, 0.65 * score + 0.35 * sd) AS rank_score, score >= 0.85 AND sd >= 0.35 AND hard >= 3 AND hd >= 1 AND oh >= 2 AND kinds >= 2 AND NOT (oo OR fo OR ao OR so) AS ultra,
concat_ws(';', CASE WHEN score < 0.45 THEN 'low score' END, CASE WHEN sd < 0.2 THEN 'low score density' END, CASE WHEN hard < 1 THEN 'too little hard evidence' END, CASE WHEN hd < 0.35 THEN 'thin hard evidence' END, CASE WHEN weak_span > 35 THEN 'weak span' END, CASE WHEN oo THEN 'opening only' END, CASE WHEN fo THEN 'fuzzy only' END, CASE WHEN ao THEN 'sound only' END, CASE WHEN so THEN 'scene only' END, CASE WHEN len >= 180 AND dens < 0.35 THEN 'long and thin' END) AS failed, row_number() OVER (PARTITION BY user_id ORDER BY start, "end") AS cand_id FROM y)"""


@query(_SCORED + ' SELECT user_id, cand_id, start, "end", round(score, 6) AS score, round(sd, 6) AS score_density, round(rank_score, 6) AS rank_score, round(hd, 6) AS hard_density, round(penalty, 6) AS penalty, ultra, failed, CASE WHEN failed = \'\' THEN \'prediction\' ELSE \'review\' END AS status FROM z')
def candidate_score_filter(spark: SparkSession, d: str) -> DataFrame:
    """Scored candidates with failed thresholds and status."""
    out = _candidates(spark, d)
    return out.select("user_id", "cand_id", "start", "end", *[F.round(c, 6).alias(c) for c in ("score", "score_density", "rank_score", "hard_density", "penalty")], "ultra", "failed", "status")


@query(
    _SCORED
    + f""", s AS (SELECT *, "end" - start AS d, sum("end" - start) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY ultra DESC, rank_score DESC, sd DESC, score DESC, cand_id) AS pos FROM z WHERE failed = ''),
v AS (SELECT user_id, 0::BIGINT AS pos, 0.0::DOUBLE AS used, NULL::BIGINT AS cand_id, false AS kept, NULL::DOUBLE AS total FROM (SELECT DISTINCT user_id FROM s) UNION ALL SELECT s.user_id, s.pos, CASE WHEN s.ultra OR used + s.d <= {0.15 * 30 * 24 * HOUR} THEN used + s.d ELSE used END, s.cand_id, s.ultra OR used + s.d <= {0.15 * 30 * 24 * HOUR}, s.total FROM v JOIN s ON s.user_id = v.user_id AND s.pos = v.pos + 1)
SELECT user_id, cand_id, total <= {0.18 * 30 * 24 * HOUR} OR kept AS kept FROM v WHERE pos > 0"""
)
def budget_after_fsm(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of the whole path from cues to budget."""
    rows = _candidates(spark, d).where("status = 'prediction'").withColumn("len", F.col("end") - F.col("start"))
    order = [F.desc("ultra"), F.desc("rank_score"), F.desc("score_density"), F.desc("score"), F.col("cand_id")]
    kept = folds.budget_guard(rows, "user_id", "cand_id", "len", order, 0.15 * F.col("duration"), 0.18 * F.col("duration"), F.col("ultra"))
    return kept


_IV = f"{P}, {sql_clusters('a', 'p', of('purchase'))}, {sql_clusters('b', 'p', of('view'))}"


def _clusters(spark: SparkSession, d: str, kind: str, gap: float = GAP) -> DataFrame:
    return iv.cluster_intervals(points(spark, d, kind), "user_id", "t", gap, score="value")


_VARIANTS = ", ".join(f"('{name}', {', '.join(str(w) for w in weights.values())})" for name, weights in scoring.PHASES.items())


@query(
    f"""{_SCORED}, e AS (SELECT z.*, count(*) FILTER (y.t >= z.start AND y.t <= z.start + {5 * HOUR} AND y.event_type = 'click' AND y.value >= 20) AS intro, count(*) FILTER (y.t >= z.start AND y.t <= z."end" AND y.event_type IN ('purchase', 'signup')) AS body,
count(*) FILTER (y.t >= z."end" - {5 * HOUR} AND y.t <= z."end") AS tail, count(*) FILTER (y.t > z."end") AS after FROM z JOIN p y ON z.user_id = y.user_id AND y.t >= z.start AND y.t <= z."end" + {15 * HOUR} WHERE z.kind = 'closed' GROUP BY ALL),
v AS (SELECT *, least(1, body / greatest(1, len / 60) / 4) AS bd, CASE WHEN tail > 0 THEN greatest(0, (tail - after) / tail) ELSE 0 END AS dr FROM e, (VALUES {_VARIANTS}) l(variant, wi, wb, wd, wr, ws)),
m AS (SELECT *, 0.3 * least(1, least(1, CASE WHEN hard > 0 THEN 1 ELSE 0.62 END + least(0.18, 0.04 * ss)) + CASE WHEN intro > 0 THEN wi ELSE 0 END) + 0.22 * least(1, least(1, (hard + 0.5 * ct + 0.3 * ss) / n) + wb * bd)
+ 0.16 * greatest(0, least(1, CASE WHEN why = 'end support' THEN 0.86 WHEN why = 'freshness' THEN 0.68 WHEN why = 'support cap' THEN 0.58 ELSE 0.35 END + wd * dr + CASE WHEN tail > 0 AND after = 0 THEN wr ELSE 0 END - CASE WHEN after > 0 THEN ws ELSE 0 END))
+ 0.17 * least(1, dens + 0.05 * bd) + 0.1 * least(1, (rh + 0.5 * oh) / n) + 0.05 * least(1, au / n) AS weighed, hard + CASE WHEN body > 0 AND bd > 0.25 THEN 1 ELSE 0 END AS hard2 FROM v),
h AS (SELECT *, greatest(0, least(1, weighed - least(0.45, penalty))) AS score2, hard2 / greatest(1, len / 60) AS hd2 FROM m), k AS (SELECT *, least(1, score2 / greatest(1, len / 60)) AS sd2 FROM h)
SELECT user_id, cand_id, variant, round(score2, 6) AS score, round(sd2, 6) AS score_density, round(least(1, 0.65 * score2 + 0.35 * sd2), 6) AS rank_score, hard2::BIGINT AS n_hard, round(score2 - score, 6) AS moved, score2 >= 0.45 AND sd2 >= 0.2 AND hard2 >= 1 AND hd2 >= 0.35 AND weak_span <= 35 AS passes FROM k"""
)
def phase_rescoring(spark: SparkSession, d: str) -> DataFrame:
    """Closed candidates rescored by their phases under three variants."""
    closed = _candidates(spark, d).where("kind = 'closed'")
    carried = F.struct("length", "penalty", "weak_span", "n_hard", F.col("score").alias("before"), *[f"{k}_strength" for k in scoring.WEIGHTS]).alias("_c")
    spans = closed.select("user_id", "cand_id", "start", "end", carried, F.col("start").alias("r_start"), (F.col("end") + 15 * HOUR).alias("r_end"))
    near = iv.points_in_intervals(points(spark, d).select("user_id", "t", "event_type", "value"), spans, "user_id", "t", CELL)
    t, s, e, kind = F.col("t"), F.col("start"), F.col("end"), F.col("event_type")
    f = near.groupBy("user_id", "cand_id").agg(
        F.any_value("_c").alias("_c"), F.count_if((t >= s) & (t <= s + 5 * HOUR) & (kind == "click") & (F.col("value") >= 20)).alias("intro"), F.count_if((t >= s) & (t <= e) & kind.isin("purchase", "signup")).alias("body"), F.count_if((t >= e - 5 * HOUR) & (t <= e)).alias("tail"), F.count_if(t > e).alias("after")
    )
    out = scoring.phase_rescored(f.select("user_id", "cand_id", "intro", "body", "tail", "after", "_c.*"), HOUR)
    return out.select("user_id", "cand_id", "variant", *[F.round(c, 6).alias(c) for c in ("score", "score_density", "rank_score")], F.col("n_hard").cast("long").alias("n_hard"), F.round(F.col("score") - F.col("before"), 6).alias("moved"), "passes")


@query(
    f"""WITH {_IV}, v AS (SELECT b.boost, b.bw, m.mode, m.mw FROM (VALUES ('none', 0.0), ('small', 0.05), ('medium', 0.1), ('large', 0.2)) b(boost, bw), (VALUES ('off', 0.0), ('support', 0.05), ('full', 0.15)) m(mode, mw)),
s AS (SELECT boost, mode, user_id, "end" - start AS len, least(1.0, score / 300 + bw * CASE WHEN n >= 3 THEN 1 ELSE 0 END + mw * CASE WHEN score >= 100 THEN 1 ELSE 0 END) AS sc, score >= 250 AS ultra, cluster_no FROM a, v),
k AS (SELECT *, sum(len) OVER (PARTITION BY boost, mode, user_id) AS total, coalesce(sum(CASE WHEN ultra THEN 0 ELSE len END) OVER (PARTITION BY boost, mode, user_id ORDER BY sc, cluster_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s WHERE sc >= 0.2)
SELECT boost, mode, count(*) AS candidates, count(*) FILTER (NOT (total > {20 * HOUR} AND NOT ultra AND total - before > {12 * HOUR})) AS kept, round(avg(sc), 6) AS mean_score FROM k GROUP BY 1, 2"""
)
def boost_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Four boosts by three modes on all candidates, each with its own budget (F11, F12, W17d)."""
    grid = spark.createDataFrame([(b, bw, m, mw) for b, bw in (("none", 0.0), ("small", 0.05), ("medium", 0.1), ("large", 0.2)) for m, mw in (("off", 0.0), ("support", 0.05), ("full", 0.15))], "boost string, bw double, mode string, mw double")
    rows = _clusters(spark, d, "purchase").crossJoin(F.broadcast(grid))  # twelve variants
    sc = F.least(F.lit(1.0), F.col("score") / 300 + F.col("bw") * (F.col("n") >= 3).cast("int") + F.col("mw") * (F.col("score") >= 100).cast("int"))
    rows = rows.withColumn("sc", sc).where("sc >= 0.2").withColumn("len", F.col("end") - F.col("start")).withColumn("key", F.concat_ws("|", "boost", "mode", "user_id"))
    kept = folds.reverse_elimination(rows, "key", "cluster_no", "len", "sc", F.col("score") >= 250, F.lit(12 * HOUR), F.lit(20 * HOUR))
    out = rows.join(kept, ["key", "cluster_no"])
    return out.groupBy("boost", "mode").agg(F.count("*").alias("candidates"), F.count_if("kept").alias("kept"), F.round(F.avg("sc"), 6).alias("mean_score"))


@query(
    f"""WITH {P}, e AS (SELECT *, CASE WHEN value >= 100 THEN 'strong' WHEN value >= 50 THEN 'plain' END AS kind FROM p WHERE event_type IN ('click', 'purchase') AND value >= 50),
{sql_clusters('c', 'e', 'true', gap=20 * HOUR, least=1)}, k AS (SELECT user_id, cluster_no, string_agg(DISTINCT kind, ';' ORDER BY kind) AS kinds FROM c_b GROUP BY 1, 2)
SELECT c.user_id, c.cluster_no::BIGINT AS cluster_no, start - {HOUR} AS start, start - {HOUR} + least({60 * HOUR}, greatest({12 * HOUR}, "end" - start)) AS "end", greatest(0.5, score / 400) AS score, kinds FROM c JOIN k USING (user_id, cluster_no)"""
)
def event_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Typed events, clustered, become proposals of bounded length."""
    rows = points(spark, d, "click", "purchase").where("value >= 50").withColumn("kind", F.when(F.col("value") >= 100, "strong").otherwise("plain"))
    c = iv.gap_clusters(rows, "user_id", "t", 20 * HOUR).groupBy("user_id", "cluster_no").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.max("value").alias("v"), F.array_join(F.array_sort(F.collect_set("kind")), ";").alias("kinds"))
    start = F.col("a") - HOUR
    length = F.least(F.lit(60 * HOUR), F.greatest(F.lit(12 * HOUR), F.col("b") - F.col("a")))
    return c.select("user_id", "cluster_no", start.alias("start"), (start + length).alias("end"), F.greatest(F.lit(0.5), F.col("v") / 400).alias("score"), "kinds")


@query(
    f"""WITH {_IV}, x AS (SELECT a.user_id, a.cluster_no, a."end", z.t, row_number() OVER (PARTITION BY a.user_id, a.cluster_no ORDER BY abs(z.t - a."end"), z.t) AS k FROM a LEFT JOIN p z ON z.user_id = a.user_id AND z.event_type = 'error' AND z.t BETWEEN a."end" - {5 * HOUR} AND a."end" + {20 * HOUR}),
y AS (SELECT a.user_id, a.cluster_no, min(z.t) AS t FROM a JOIN p z ON z.user_id = a.user_id AND z.event_type = 'error' AND z.t > a."end" AND z.t <= a."end" + {180 * HOUR} GROUP BY 1, 2)
SELECT a.user_id, a.cluster_no::BIGINT AS cluster_no, x.t AS near_black, y.t AS downstream, CASE WHEN x.t IS NOT NULL AND abs(x.t - a."end") <= {20 * HOUR} THEN x.t WHEN a.score >= 80 AND y.t - a.start <= {260 * HOUR} THEN y.t ELSE a."end" END AS refined_end,
CASE WHEN x.t IS NOT NULL THEN 'black' WHEN a.score >= 80 AND y.t - a.start <= {260 * HOUR} THEN 'downstream' ELSE 'kept' END AS how
FROM a JOIN x ON a.user_id = x.user_id AND a.cluster_no = x.cluster_no AND x.k = 1 LEFT JOIN y ON a.user_id = y.user_id AND a.cluster_no = y.cluster_no"""
)
def end_refinement(spark: SparkSession, d: str) -> DataFrame:
    """Ends move to a near dark frame, or for strong starts to the first downstream."""
    spans = _clusters(spark, d, "purchase").select("user_id", "cluster_no", "start", "end", "score", (F.col("end") - 5 * HOUR).alias("r_start"), (F.col("end") + 180 * HOUR).alias("r_end"))
    t, e = F.col("t"), F.col("end")
    black = iv.points_in_intervals(points(spark, d, "error").select("user_id", "t"), spans, "user_id", "t", CELL)
    near = F.min_by(F.when(t <= e + 20 * HOUR, t), F.when(t <= e + 20 * HOUR, F.struct(F.abs(t - e), t)))
    f = black.groupBy("user_id", "cluster_no").agg(near.alias("near_black"), F.min(F.when(t > e, t)).alias("downstream"))
    out = spans.join(f, ["user_id", "cluster_no"], "left")
    far = F.coalesce((F.col("score") >= 80) & (F.col("downstream") - F.col("start") <= 260 * HOUR), F.lit(False))
    how = F.when(F.col("near_black").isNotNull(), "black").when(far, "downstream").otherwise("kept")
    return out.withColumn("how", how).select("user_id", "cluster_no", "near_black", "downstream", F.when(F.col("how") == "black", F.col("near_black")).when(F.col("how") == "downstream", F.col("downstream")).otherwise(e).alias("refined_end"), "how")


@query(
    f"""WITH {_IV}, c AS (SELECT a.user_id, a.cluster_no, max(b."end") AS e FROM a JOIN b ON a.user_id = b.user_id AND b.start < a."end" + {GAP} AND b."end" > a.start AND b."end" > a."end" AND b."end" - a.start <= {100 * HOUR} GROUP BY 1, 2)
SELECT a.user_id, a.cluster_no::BIGINT AS cluster_no, coalesce(c.e, a."end") AS "end", c.e IS NOT NULL AS extended FROM a LEFT JOIN c USING (user_id, cluster_no)"""
)
def review_end_extension(spark: SparkSession, d: str) -> DataFrame:
    """Ends move to the largest valid end among overlapping review rows."""
    a = _clusters(spark, d, "purchase").select("user_id", "cluster_no", "start", "end", F.col("start").alias("l_start"), (F.col("end") + GAP).alias("l_end"))
    b = _clusters(spark, d, "view").select("user_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    near = iv.overlap_join(a, b, "user_id", CELL).where((F.col("r_end") > F.col("end")) & (F.col("r_end") - F.col("start") <= 100 * HOUR))
    best = near.groupBy("user_id", "cluster_no").agg(F.max("r_end").alias("e"))
    return a.join(best, ["user_id", "cluster_no"], "left").select("user_id", "cluster_no", F.coalesce("e", "end").alias("end"), F.col("e").isNotNull().alias("extended"))


@query(
    f"""WITH {_IV}, r AS (SELECT user_id, cluster_no, start, "end", n, score, concat_ws(';', CASE WHEN n >= 3 THEN 'many' END, CASE WHEN score >= 100 THEN 'strong' END, CASE WHEN "end" - start > {8 * HOUR} THEN 'long' END) AS reasons,
least(1, greatest(0, 0.3 + CASE WHEN n >= 3 THEN 0.2 ELSE 0 END + CASE WHEN score >= 100 THEN 0.3 ELSE 0 END - CASE WHEN "end" - start > {8 * HOUR} THEN 0.15 ELSE 0 END)) AS rule_score FROM a)
SELECT user_id, cluster_no::BIGINT AS cluster_no, reasons, round(rule_score, 6) AS rule_score, round(rule_score, 6) >= 0.45 AS predicted, n * 0.01 AS part_count, CASE WHEN score >= 100 THEN 0.3 ELSE 0.0 END AS part_strength FROM r"""
)
def manual_rule_scores(spark: SparkSession, d: str) -> DataFrame:
    """Boosts, penalties and their reasons, with the parts of the score."""
    many, strong, long_ = F.col("n") >= 3, F.col("score") >= 100, F.col("end") - F.col("start") > 8 * HOUR
    rule = scalar.clip(F.lit(0.3) + F.when(many, 0.2).otherwise(0.0) + F.when(strong, 0.3).otherwise(0.0) - F.when(long_, 0.15).otherwise(0.0))
    rows = _clusters(spark, d, "purchase").withColumn("s", rule)
    return rows.select("user_id", "cluster_no", scalar.reasons([(many, "many"), (strong, "strong"), (long_, "long")]).alias("reasons"), F.round("s", 6).alias("rule_score"), (F.round("s", 6) >= 0.45).alias("predicted"), (F.col("n") * 0.01).alias("part_count"), F.when(strong, 0.3).otherwise(0.0).alias("part_strength"))


@query(
    f"""WITH RECURSIVE {_IV}, s AS (SELECT user_id, start, "end", row_number() OVER (PARTITION BY user_id ORDER BY start, "end") AS i FROM a), x AS (SELECT s.*, coalesce(n.start - s."end" > 0 AND n.start - s."end" <= {60 * HOUR} AND n."end" - s.start <= {90 * HOUR}, false) AS can, n."end" AS e2 FROM s LEFT JOIN s n ON s.user_id = n.user_id AND n.i = s.i + 1),
w AS (SELECT user_id, i, start, CASE WHEN can THEN e2 ELSE "end" END AS "end", CASE WHEN can THEN 2 ELSE 1 END AS parts FROM x WHERE i = 1 UNION ALL SELECT x.user_id, x.i, x.start, CASE WHEN x.can THEN x.e2 ELSE x."end" END, CASE WHEN x.can THEN 2 ELSE 1 END FROM w JOIN x ON x.user_id = w.user_id AND x.i = w.i + w.parts)
SELECT user_id, start, "end", parts::INTEGER AS parts FROM w"""
)
def bridge_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring fragments merge in order, each used once."""
    return folds.bridge(_clusters(spark, d, "purchase"), "user_id", 60 * HOUR, 90 * HOUR)


@query(
    f"""WITH RECURSIVE {_IV}, k AS (SELECT user_id, list([start, "end"]) AS have FROM a GROUP BY 1), c AS (SELECT user_id, cluster_no, start, "end", row_number() OVER (PARTITION BY user_id ORDER BY score DESC, cluster_no) AS i FROM b),
w AS (SELECT c.user_id, 0::BIGINT AS i, coalesce(any_value(k.have), []) AS have, 0 AS n, NULL::BIGINT AS cand_id FROM c LEFT JOIN k USING (user_id) GROUP BY 1
UNION ALL SELECT user_id, i, CASE WHEN ok THEN list_append(have, [start, "end"]) ELSE have END, CASE WHEN ok THEN n + 1 ELSE n END, CASE WHEN ok THEN cluster_no END FROM (SELECT w.user_id, c.i, w.have, w.n, c.start, c."end", c.cluster_no::BIGINT AS cluster_no,
w.n < 2 AND len(list_filter(w.have, lambda h: greatest(0, least(h[2], c."end") - greatest(h[1], c.start)) / (greatest(h[2], c."end") - least(h[1], c.start)) >= 0.5)) = 0 AS ok FROM w JOIN c ON c.user_id = w.user_id AND c.i = w.i + 1))
SELECT user_id, cand_id FROM w WHERE cand_id IS NOT NULL"""
)
def promote_with_iou(spark: SparkSession, d: str) -> DataFrame:
    """At most two candidates a key that overlap nothing kept."""
    cand = _clusters(spark, d, "view").withColumnRenamed("cluster_no", "cand_id")
    return folds.promote(cand, _clusters(spark, d, "purchase"), "user_id")


@query(
    f"""WITH {P}, e AS (SELECT user_id, list([value, t] ORDER BY value DESC, t) AS xs FROM p WHERE event_type = 'click' GROUP BY 1),
k AS (SELECT user_id, list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: abs(y[2] - x[1][2]) < {24 * HOUR})) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM e)
SELECT user_id, u[2] AS t, u[1] AS value FROM (SELECT user_id, unnest(kept) AS u FROM k)"""
)
def greedy_nms(spark: SparkSession, d: str) -> DataFrame:
    """Greedy suppression by score."""
    return folds.nms(points(spark, d, "click"), "user_id", "t", "value", 24 * HOUR)


@query(
    f"""WITH {P}, e AS (SELECT user_id, list(DISTINCT t ORDER BY t) AS xs FROM p WHERE event_type = 'view' GROUP BY 1), k AS (SELECT user_id, list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[-1] <= {5 * HOUR} THEN acc ELSE list_concat(acc, x) END) AS kept FROM e)
SELECT user_id, unnest(kept) AS t FROM k"""
)
def tolerance_times(spark: SparkSession, d: str) -> DataFrame:
    """Times less those near the last kept one."""
    return folds.tolerance_times(points(spark, d, "view"), "user_id", "t", 5 * HOUR)


def _near_pairs(spark: SparkSession, d: str) -> DataFrame:
    a = points(spark, d, "purchase").select("user_id", F.col("event_id").alias("gt"), F.col("t").alias("gt_t"), F.col("t").alias("l_start"), (F.col("t") + 0.0).alias("l_end"))
    b = points(spark, d, "click").select("user_id", F.col("event_id").alias("cand"), F.col("t").alias("cand_t"), (F.col("t") - 12 * HOUR).alias("r_start"), (F.col("t") + 12 * HOUR).alias("r_end"))
    return iv.overlap_join(a, b, "user_id", CELL, "closed").select("user_id", "gt", "cand", "gt_t", "cand_t", F.abs(F.col("gt_t") - F.col("cand_t")).alias("dist")).where(F.col("dist") <= 12 * HOUR)


def _sql_match(pairs: str, order: str) -> str:
    """Pairs (user_id, x, y, v) in order, taken if both ends are free."""
    busy = "(list_contains(ux, o.x) OR list_contains(uy, o.y))"
    return f"""WITH RECURSIVE {pairs}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS i FROM j),
w AS (SELECT user_id, i, x, y, v, true AS taken, [x] AS ux, [y] AS uy FROM o WHERE i = 1
UNION ALL SELECT o.user_id, o.i, o.x, o.y, o.v, NOT {busy}, CASE WHEN {busy} THEN ux ELSE list_append(ux, o.x) END, CASE WHEN {busy} THEN uy ELSE list_append(uy, o.y) END FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)"""


_NEAR = f"{P}, j AS (SELECT l.user_id, l.event_id AS x, r.event_id AS y, abs(l.t - r.t) AS v, l.t AS xt FROM p l JOIN p r ON l.user_id = r.user_id AND l.event_type = 'purchase' AND r.event_type = 'click' AND abs(l.t - r.t) <= {12 * HOUR})"
_MEET = f"""{P}, {sql_clusters('a', 'p', of('purchase'), gap=40 * HOUR)}, {sql_clusters('b', 'p', of('view'), gap=40 * HOUR)},
j AS (SELECT a.user_id, a.cluster_no::BIGINT AS x, b.cluster_no::BIGINT AS y, least(a."end", b."end") - greatest(a.start, b.start) AS v FROM a JOIN b ON a.user_id = b.user_id AND a.start < b."end" AND a."end" > b.start)"""


@query(_sql_match(_NEAR, "v, x, y") + " SELECT user_id, x AS gt, y AS cand, round(v, 6) AS dist FROM w WHERE taken")
def greedy_one_to_one_match(spark: SparkSession, d: str) -> DataFrame:
    """Closest pairs first, each end once."""
    out = folds.greedy_pairs(_near_pairs(spark, d), "user_id", "gt", "cand", [("dist", True), ("gt", True), ("cand", True)])
    return out.select("user_id", "gt", "cand", F.round("dist", 6).alias("dist"))


@query(_sql_match(_MEET, "v DESC, x, y") + " SELECT user_id, x AS a_no, y AS b_no, v AS overlap FROM w WHERE taken")
def greedy_overlap_match(spark: SparkSession, d: str) -> DataFrame:
    """Largest overlaps first, each interval once."""
    a = _clusters(spark, d, "purchase", 40 * HOUR).select("user_id", F.col("cluster_no").alias("a_no"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    b = _clusters(spark, d, "view", 40 * HOUR).select("user_id", F.col("cluster_no").alias("b_no"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    pairs = iv.overlap_join(a, b, "user_id", CELL).select("user_id", "a_no", "b_no", iv.overlap_seconds().alias("overlap"))
    return folds.greedy_pairs(pairs, "user_id", "a_no", "b_no", [("overlap", False), ("a_no", True), ("b_no", True)])


@query(_sql_match(_NEAR, "xt, x, v, y") + " SELECT user_id, x AS gt, y AS cand, round(v, 6) AS dist FROM w WHERE taken")
def greedy_match_by_left(spark: SparkSession, d: str) -> DataFrame:
    """Left rows in time order take their best free right row."""
    pairs = _near_pairs(spark, d).withColumn("score", -F.col("dist"))
    return folds.greedy_by_left(pairs, "user_id", "gt", "cand", "gt_t", "score").select("user_id", "gt", "cand", F.round("dist", 6).alias("dist"))


_GRAPH = f"""WITH RECURSIVE {P}, n AS (SELECT * FROM p WHERE event_type IN ('click', 'view')), e AS (SELECT a.event_id AS x, b.event_id AS y FROM n a JOIN n b ON a.user_id = b.user_id AND a.event_type <> b.event_type AND abs(a.t - b.t) <= {2 * HOUR}),
r AS (SELECT event_id AS node, event_id AS reach FROM n WHERE event_id IN (SELECT x FROM e) UNION SELECT r.node, e.y FROM r JOIN e ON r.reach = e.x), g AS (SELECT node, min(reach) AS component FROM r GROUP BY 1)"""


@query(_GRAPH + " SELECT * FROM g")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """Components over edges between two sources near in time: a true graph."""
    a = points(spark, d, "click").select("user_id", F.col("event_id").alias("x"), F.col("t").alias("l_start"), (F.col("t") + 0.0).alias("l_end"))
    b = points(spark, d, "view").select("user_id", F.col("event_id").alias("y"), F.col("t").alias("rt"), (F.col("t") - 2 * HOUR).alias("r_start"), (F.col("t") + 2 * HOUR).alias("r_end"))
    edges = iv.overlap_join(a, b, "user_id", CELL, "closed").where(F.abs(F.col("l_start") - F.col("rt")) <= 2 * HOUR)
    return graph.connected_components(edges.select(F.col("x").alias("src"), F.col("y").alias("dst")))


@query(
    _GRAPH
    + """ SELECT component, coalesce(min(t) FILTER (event_type = 'click'), min(t)) AS canonical_t, count(*) AS n, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS relation, string_agg(event_type || ':' || node, ';' ORDER BY t, node) AS members FROM g JOIN n ON n.event_id = g.node GROUP BY 1"""
)
def anchor_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Components with a canonical member: the earliest of the first source, else of the second."""
    comp = connected_components(spark, d)
    rows = points(spark, d, "click", "view").withColumnRenamed("event_id", "node").join(comp, "node")
    first = F.when(F.col("event_type") == "click", 0).otherwise(1)
    members = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "node", "event_type"))), lambda m: F.concat_ws(":", m["event_type"], m["node"])), ";")
    return rows.groupBy("component").agg(F.min_by("t", F.struct(first, "t")).alias("canonical_t"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), "+").alias("relation"), members.alias("members"))


@query(
    f"""WITH {_IV}, j AS (SELECT a.user_id, a.cluster_no, max(least(a."end", b."end") - greatest(a.start, b.start)) AS o FROM a JOIN b ON a.user_id = b.user_id AND a.start < b."end" AND a."end" > b.start GROUP BY 1, 2),
r AS (SELECT a.user_id, a.cluster_no, count(*) AS n FROM a JOIN p x ON x.user_id = a.user_id AND x.event_type = 'click' AND x.t BETWEEN a.start AND a."end" GROUP BY 1, 2)
SELECT a.user_id, a.cluster_no::BIGINT AS cluster_no, CASE WHEN j.o / (a."end" - a.start) >= 0.8 THEN 'good' WHEN j.o IS NOT NULL THEN 'partial' WHEN r.n IS NOT NULL THEN 'candidate_not_selected' ELSE 'no_candidate' END AS failure,
CASE WHEN j.o / (a."end" - a.start) >= 0.8 THEN 'none' WHEN j.o IS NOT NULL THEN 'extend' WHEN r.n IS NOT NULL THEN 'promote' ELSE 'add evidence' END AS fix FROM a LEFT JOIN j USING (user_id, cluster_no) LEFT JOIN r USING (user_id, cluster_no)"""
)
def failure_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """Why an actual interval was missed and what would mend it."""
    a = _clusters(spark, d, "purchase").select("user_id", "cluster_no", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    b = _clusters(spark, d, "view").select("user_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    best = iv.overlap_join(a, b, "user_id", CELL).groupBy("user_id", "cluster_no").agg(F.max(iv.overlap_seconds()).alias("o"))
    inside = iv.points_in_intervals(points(spark, d, "click").select("user_id", "t"), a.withColumnRenamed("l_start", "r_start").withColumnRenamed("l_end", "r_end"), "user_id", "t", CELL).groupBy("user_id", "cluster_no").agg(F.count("*").alias("n"))
    out = a.join(best, ["user_id", "cluster_no"], "left").join(inside, ["user_id", "cluster_no"], "left")
    good = F.col("o") / (F.col("l_end") - F.col("l_start")) >= 0.8
    pick = lambda w, x, y, z: F.when(good, w).when(F.col("o").isNotNull(), x).when(F.col("n").isNotNull(), y).otherwise(z)
    return out.select("user_id", "cluster_no", pick("good", "partial", "candidate_not_selected", "no_candidate").alias("failure"), pick("none", "extend", "promote", "add evidence").alias("fix"))


@query(
    f"""WITH {P}, t AS (SELECT a.user_id, a.event_id, a.t, count(b.t) FILTER (b.t < a.t AND b.event_type = 'view') AS pre, count(b.t) FILTER (b.t > a.t AND b.event_type = 'view') AS post, quantile_disc(b.value, 0.9) FILTER (b.event_type = 'click') AS p90 FROM p a LEFT JOIN p b ON a.user_id = b.user_id AND abs(a.t - b.t) <= {20 * HOUR} WHERE a.event_type = 'purchase' GROUP BY 1, 2, 3)
SELECT user_id, event_id, pre, post, coalesce(p90, 0) AS sound_p90, post > pre AS rises, CASE WHEN coalesce(p90, 0) / 150 >= 0.65 THEN 'high' WHEN coalesce(p90, 0) / 150 >= 0.35 THEN 'medium' ELSE 'low' END AS sound_level, t - {_T0} <= least(45 * {HOUR}, greatest(30 * {HOUR}, 0.02 * {30 * 24 * HOUR})) AS in_opening FROM t"""
)
def anchor_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Text and sound windows around each anchor as one wide row (fusion of J05, A03, P08, P24)."""
    spans = points(spark, d, "purchase").select("user_id", "event_id", F.col("t").alias("at"), (F.col("t") - 20 * HOUR).alias("r_start"), (F.col("t") + 20 * HOUR).alias("r_end"))
    near = iv.points_in_intervals(points(spark, d).select("user_id", "t", "event_type", "value"), spans, "user_id", "t", CELL).where(F.abs(F.col("t") - F.col("at")) <= 20 * HOUR)
    view = F.col("event_type") == "view"
    f = near.groupBy("user_id", "event_id", "at").agg(F.count_if(view & (F.col("t") < F.col("at"))).alias("pre"), F.count_if(view & (F.col("t") > F.col("at"))).alias("post"), F.coalesce(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value) FILTER (WHERE event_type = 'click')"), F.lit(0.0)).alias("sound_p90"))
    window = scalar.opening_window(F.lit(30 * 24)) * HOUR
    return f.select("user_id", "event_id", "pre", "post", "sound_p90", (F.col("post") > F.col("pre")).alias("rises"), scalar.score_level(F.col("sound_p90") / 150).alias("sound_level"), (F.col("at") - _T0 <= window).alias("in_opening"))


@query(
    """WITH h AS (SELECT s_suppkey, s_nationkey % 2 = 0 AS dev, s_acctbal FROM supplier) SELECT CASE WHEN dev THEN 'development' ELSE 'held out' END AS part, count(*) AS n, count(*) FILTER (s_acctbal >= (SELECT quantile_cont(s_acctbal, 0.7) FROM h WHERE dev)) AS selected FROM h GROUP BY 1"""
)
def frozen_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """A threshold fitted on one split, frozen, and applied to the other."""
    rows = table(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").withColumn("dev", F.col("s_nationkey") % 2 == 0)
    rows = only_splits(rows.withColumn("part", F.when(F.col("dev"), "development").otherwise("held out")), "part", ["development", "held out"])
    cut = stats.quantiles(rows.where("dev"), [], "s_acctbal", {"cut": 0.7})
    return rows.crossJoin(cut).groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("s_acctbal") >= F.col("cut")).alias("selected"))  # one row


@query(_CUES.replace("p AS", "WITH p AS", 1) + " SELECT event_id, hard, start_support, continuity, end_support, weak, opening_only, audio_only, concat_ws(';', CASE WHEN hard THEN 'hard' END, CASE WHEN start_support THEN 'start' END, CASE WHEN continuity THEN 'continuity' END, CASE WHEN end_support THEN 'end' END) AS why FROM q")
def cue_flags(spark: SparkSession, d: str) -> DataFrame:
    """Evidence tiers of every row as boolean cues, with their reasons."""
    rows = _cues(spark, d)
    why = scalar.reasons([(F.col("hard"), "hard"), (F.col("start_support"), "start"), (F.col("continuity"), "continuity"), (F.col("end_support"), "end")])
    return rows.select("event_id", "hard", "start_support", "continuity", "end_support", "weak", "opening_only", "audio_only", why.alias("why"))
