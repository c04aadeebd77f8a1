"""Scores, filters and rule projections on candidate intervals; column expressions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import clip, reasons
from tidemark.sources.tabular import forbidden

# Weights, thresholds and penalties of the candidate score.
WEIGHTS = {"start": 0.30, "continuity": 0.22, "end": 0.16, "density": 0.17, "timeline": 0.10, "audio": 0.05}
PENALTIES = {"weak_span": 0.08, "overlong": 0.08, "opening_only": 0.30, "fuzzy_only": 0.24, "audio_only": 0.28, "scene_only": 0.32, "excess": 0.08, "thin": 0.12}
LEAST = {"score": 0.45, "score_density": 0.20, "hard": 1, "hard_density": 0.35}
WEAK_SPAN, LONG, THIN = 35.0, 180.0, 0.35
ULTRA = {"score": 0.85, "score_density": 0.35, "hard": 3, "hard_density": 1.0, "ocr_hard": 2, "kinds": 2}
#: The earlier, relaxed form.
RELAXED_ULTRA = {"score": 0.65, "score_density": 0.18, "hard": 2}


def scored(candidates: DataFrame, unit: float = 1.0, duration: str | None = None) -> DataFrame:
    """Adds the six strengths, the penalty, score, score_density, rank_score, hard_density, ultra.

    unit is the number of seconds that count as one second of the fixed limits."""
    length = F.greatest(F.lit(1.0), (F.col("end") - F.col("start")) / unit)
    n = F.greatest(F.lit(1), F.col("n_rows"))
    hard_density = F.col("n_hard") / F.greatest(F.lit(1.0), length / 60.0)
    why = F.col("end_reason")
    parts = {
        "start": clip(F.when(F.col("n_hard") > 0, 1.0).otherwise(0.62) + F.least(F.lit(0.18), 0.04 * F.col("n_start_support"))),
        "continuity": clip((F.col("n_hard") + 0.5 * F.col("n_continuity") + 0.3 * F.col("n_start_support")) / n),
        "end": F.when(why.contains("end support"), 0.86).when(why.contains("freshness"), 0.68).when(why.contains("support cap"), 0.58).otherwise(0.35),
        "density": clip(hard_density / 4.0),
        "timeline": clip((F.col("n_recent_hard") + 0.5 * F.col("n_ocr_hard")) / n),
        "audio": clip(F.col("n_audio") / n),
    }
    out = candidates.withColumn("length", length).withColumn("hard_density", hard_density)
    for name, part in parts.items():
        out = out.withColumn(f"{name}_strength", part)
    base = sum((F.col(f"{k}_strength") * w for k, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    span = F.lit(0.0) if duration is None else 0.18 * F.col(duration) / unit
    hits = {
        "weak_span": F.col("weak_span") / unit > WEAK_SPAN, "overlong": F.col("length") >= LONG, "opening_only": F.col("opening_only"), "fuzzy_only": F.col("fuzzy_only"), "audio_only": F.col("audio_only"),
        "scene_only": F.col("scene_only"), "excess": F.col("length") > F.greatest(F.lit(240.0), span), "thin": (F.col("length") >= LONG) & (F.col("density_strength") < THIN),
    }
    penalty = sum((F.when(h, PENALTIES[k]).otherwise(0.0) for k, h in hits.items()), F.lit(0.0))
    out = out.withColumn("penalty", penalty).withColumn("score", clip(base - F.col("penalty")))
    out = out.withColumn("score_density", clip(F.col("score") / F.greatest(F.lit(1.0), F.col("length") / 60.0)))
    out = out.withColumn("rank_score", clip(0.65 * F.col("score") + 0.35 * F.col("score_density")))
    flags = F.col("opening_only") | F.col("fuzzy_only") | F.col("audio_only") | F.col("scene_only")
    ultra = (F.col("score") >= ULTRA["score"]) & (F.col("score_density") >= ULTRA["score_density"]) & (F.col("n_hard") >= ULTRA["hard"]) & (F.col("hard_density") >= ULTRA["hard_density"]) & (F.col("n_ocr_hard") >= ULTRA["ocr_hard"]) & (F.col("kinds") >= ULTRA["kinds"]) & ~flags
    return out.withColumn("ultra", ultra)


def filtered(candidates: DataFrame, unit: float = 1.0, read: Iterable[str] = ()) -> DataFrame:
    """Adds status (prediction or review) and failed, the reasons for review, of closed candidates
    from scored(). read names the columns that the decision was made from: where one of them
    tells of labels, every candidate goes to review."""
    why = [
        (F.col("score") < LEAST["score"], "low score"),
        (F.col("score_density") < LEAST["score_density"], "low score density"),
        (F.col("n_hard") < LEAST["hard"], "too little hard evidence"),
        (F.col("hard_density") < LEAST["hard_density"], "thin hard evidence"),
        (F.col("weak_span") / unit > WEAK_SPAN, "weak span"),
        (F.lit(bool(forbidden(list(read)))), "label columns"),
        (F.col("opening_only"), "opening only"),
        (F.col("fuzzy_only"), "fuzzy only"),
        (F.col("audio_only"), "sound only"),
        (F.col("scene_only"), "scene only"),
        ((F.col("length") >= LONG) & (F.col("density_strength") < THIN), "long and thin"),
    ]
    out = candidates.withColumn("failed", reasons(why))
    return out.withColumn("status", F.when(F.col("failed") == "", "prediction").otherwise("review"))


def relaxed_ultra(ultra: Column, hard: Column, score_density: Column, score: Column) -> Column:
    """The ultra flag of the earlier budget: that of the score, or a lower set of limits."""
    return ultra | ((hard >= RELAXED_ULTRA["hard"]) & (score_density >= RELAXED_ULTRA["score_density"]) & (score >= RELAXED_ULTRA["score"]))


# Weights of the phase variants, of the body in the density, and the penalty's cap.
PHASES = {
    "light": {"intro": 0.05, "body": 0.05, "drop": 0.06, "return": 0.03, "still": 0.10},
    "balanced": {"intro": 0.08, "body": 0.08, "drop": 0.10, "return": 0.05, "still": 0.15},
    "end_strict": {"intro": 0.05, "body": 0.06, "drop": 0.15, "return": 0.07, "still": 0.22},
}
BODY_IN_DENSITY, BODY_COUNTS, MOST_PENALTY = 0.05, 0.25, 0.45


def phase_rescored(candidates: DataFrame, unit: float = 1.0) -> DataFrame:
    """Candidates of scored() under each phase variant, with new strengths, scores and passes.

    intro, tail and after are counts of cues at the start, before the end and past it, body those
    of products and calls inside. Phases move the strengths before they are weighted; penalties
    come off after, up to a cap."""
    grid = F.array(*[F.struct(F.lit(name).alias("variant"), *[F.lit(w).alias(f"w_{k}") for k, w in weights.items()]) for name, weights in PHASES.items()])
    rows = candidates.withColumn("_v", F.explode(grid)).select("*", "_v.*").drop("_v")
    minutes = F.greatest(F.lit(1.0), F.col("length") / 60.0)
    body = clip(F.col("body") / minutes / 4.0)
    drop = F.when(F.col("tail") > 0, clip((F.col("tail") - F.col("after")) / F.col("tail"))).otherwise(0.0)
    returned = ((F.col("tail") > 0) & (F.col("after") == 0)).cast("double")
    still = (F.col("after") > 0).cast("double")
    moved = {
        "start": F.col("start_strength") + F.col("w_intro") * (F.col("intro") > 0).cast("double"),
        "continuity": F.col("continuity_strength") + F.col("w_body") * body,
        "end": F.col("end_strength") + F.col("w_drop") * drop + F.col("w_return") * returned - F.col("w_still") * still,
        "density": F.col("density_strength") + BODY_IN_DENSITY * body,
        "timeline": F.col("timeline_strength"),
        "audio": F.col("audio_strength"),
    }
    base = sum((clip(moved[k]) * w for k, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    hard = F.col("n_hard") + ((F.col("body") > 0) & (body > BODY_COUNTS)).cast("long")
    out = rows.withColumn("score", clip(base - F.least(F.lit(MOST_PENALTY), F.col("penalty")))).withColumn("n_hard", hard)
    out = out.withColumn("score_density", clip(F.col("score") / minutes)).withColumn("hard_density", F.col("n_hard") / minutes)
    out = out.withColumn("rank_score", clip(0.65 * F.col("score") + 0.35 * F.col("score_density")))
    kept = (F.col("score") >= LEAST["score"]) & (F.col("score_density") >= LEAST["score_density"]) & (F.col("n_hard") >= LEAST["hard"]) & (F.col("hard_density") >= LEAST["hard_density"])
    return out.withColumn("passes", kept & (F.col("weak_span") / unit <= WEAK_SPAN))


# Weights of the composite objectives over the metrics of a configuration.
OBJECTIVES = {
    "balanced": {"recall": 0.35, "precision": 0.25, "boundary": 0.15, "false_ratio": -0.15, "over": -0.05, "review": -0.05},
    "precision_safe": {"precision": 0.42, "boundary": 0.22, "recall": 0.16, "false_ratio": -0.14, "review": -0.06},
    "recall_safe": {"recall": 0.50, "precision": 0.18, "boundary": 0.12, "missed_ratio": -0.10, "false_ratio": -0.05, "review": -0.05},
    "low_overprediction": {"precision": 0.36, "boundary": 0.22, "recall": 0.18, "unused": 0.14, "false_ratio": -0.10},
    "short_safe": {"short_recall": 0.40, "recall": 0.25, "precision": 0.15, "boundary": 0.10, "false_ratio": -0.10},
}


def objectives(metrics: dict[str, Column], predicted_ratio: Column) -> dict[str, Column]:
    """The five composite objectives; unused is what predictions leave of the whole, and a
    missing metric counts as 0."""
    known = {k: F.coalesce(c, F.lit(0.0)) for k, c in metrics.items()} | {"unused": 1 - clip(F.coalesce(predicted_ratio, F.lit(0.0)))}
    return {name: sum((known[k] * w for k, w in weights.items()), F.lit(0.0)) for name, weights in OBJECTIVES.items()}
