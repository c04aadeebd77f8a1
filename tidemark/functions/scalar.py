"""Scalar column functions: casts, clips, levels, clocks, reasons. All stay inside code generation."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strict_number(x: Column | str) -> Column:
    """Number from any text or number; unparsable and non-finite values are null."""
    v = _c(x).try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def lenient_number(x: Column | str, default: float = 0.0) -> Column:
    """As strict_number, with a default for what is missing."""
    return F.coalesce(strict_number(x), F.lit(float(default)))


def whole_number(x: Column | str) -> Column:
    """Identifier that may carry a decimal point in text."""
    return strict_number(x).cast("long")


def truth(x: Column | str) -> Column:
    """true, 1, yes, y in any case and spacing are true; all else, null too, is false."""
    return F.coalesce(F.lower(F.trim(_c(x).cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def tri_state(x: Column | str) -> Column:
    """Free text as true, false, uncertain or missing."""
    t = F.lower(F.trim(F.coalesce(_c(x).cast("string"), F.lit(""))))
    return (
        F.when(t.isin("", "nan", "none", "null", "na"), "missing")
        .when(t.isin("true", "1", "yes", "y", "o", "ok"), "true")
        .when(t.isin("false", "0", "no", "n", "x"), "false")
        .otherwise("uncertain")
    )


def clip(x: Column | str, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Null stays null, although least and greatest skip it."""
    v = _c(x)
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi))))


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """0 where the denominator is not positive or missing."""
    d = _c(den)
    return F.when(d > 0, _c(num) / d).otherwise(F.lit(0.0))


def sigmoid(x: Column | str, bound: float = 6.0) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(x, -bound, bound)))


def banded(x: Column | str, bands: Iterable[tuple[float, str]], rest: str, missing: str | None = None) -> Column:
    """First band whose lower bound the value reaches, in the order given."""
    v, out = _c(x), None
    if missing is not None:
        out = F.when(v.isNull() | F.isnan(v.cast("double")), missing)
    for bound, name in bands:
        out = (F.when if out is None else out.when)(v >= bound, name)
    return out.otherwise(rest)


# Fixed cut-offs.
def score_level(x: Column | str) -> Column:
    return banded(x, ((0.65, "high"), (0.35, "medium")), "low")


def reliability_level(x: Column | str) -> Column:
    return banded(x, ((0.8, "high"), (0.45, "medium")), "low")


def relaxed_reliability_level(x: Column | str) -> Column:
    return banded(x, ((0.70, "high"), (0.40, "medium")), "low")


def strength_band(x: Column | str) -> Column:
    return banded(x, ((0.95, "very_high"), (0.90, "high"), (0.75, "medium")), "low", "unknown")


def percentile_level(x: Column | str) -> Column:
    return banded(x, ((0.70, "high"), (0.40, "medium")), "low", "unknown")


def percentile_bin(x: Column | str) -> Column:
    """Half-open bins of a percentage."""
    return banded(x, ((70.0, "high"), (40.0, "medium")), "low", "unknown")


def effect_band(x: Column | str) -> Column:
    return banded(F.abs(_c(x)), ((0.8, "large"), (0.5, "medium"), (0.2, "small")), "negligible", "unknown")


def distance_band(x: Column | str) -> Column:
    v = _c(x)
    return F.when(v.isNull(), "missing").when(v <= 2, "good").when(v <= 5, "acceptable").otherwise("missed")


def gap_risk(x: Column | str) -> Column:
    v = _c(x)
    return F.when(v.isNull(), "no_sample").when(v <= 1, "low").when(v <= 2, "medium").otherwise("high")


def level_name(x: Column | str) -> Column:
    """Spellings of unknown collapse; missing is low."""
    t = F.lower(F.trim(F.coalesce(_c(x), F.lit(""))))
    return F.when(t.isin("high", "medium", "low"), t).when(t.isin("", "nan", "none"), "low").otherwise("unknown")


def is_high(x: Column | str) -> Column:
    return F.coalesce(_c(x) == "high", F.lit(False))


def is_medium_or_high(x: Column | str) -> Column:
    return F.coalesce(_c(x).isin("medium", "high"), F.lit(False))


def clock(x: Column | str, floor: bool = False) -> Column:
    """Seconds as mm:ss, rounding half to even unless floored."""
    s = (F.floor(_c(x)) if floor else F.bround(_c(x), 0)).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), F.pmod(s, F.lit(60)))


def seconds_of(x: Column | str) -> Column:
    """Seconds from a number, mm:ss or hh:mm:ss text; anything else is null."""
    text = F.trim(_c(x).cast("string"))
    part = F.split(text, ":")
    at = [F.get(part, k).try_cast("double") for k in range(3)]
    return F.when(F.size(part) == 1, strict_number(text)).when(F.size(part) == 2, at[0] * 60 + at[1]).when(F.size(part) == 3, at[0] * 3600 + at[1] * 60 + at[2])


def minute_second(minute: Column | str, second: Column | str) -> tuple[Column, Column]:
    """(seconds, issue) from separate cells."""
    m, s = strict_number(minute), strict_number(second)
    issue = F.when(m.isNull() & s.isNull(), "both_missing").when(m.isNull(), "minute_missing").when(s.isNull(), "second_missing").when((s < 0) | (s >= 60), "second_range").otherwise("ok")
    return F.when(issue == "ok", m * 60 + s), issue


def weighted_mean(parts: Iterable[tuple[Column | str, float]]) -> Column:
    """Weighted mean over the inputs that are present; null where none is."""
    pairs = [(_c(x), w) for x, w in parts]
    total = functools.reduce(operator.add, [F.coalesce(x, F.lit(0.0)) * w for x, w in pairs])
    weight = functools.reduce(operator.add, [F.when(x.isNotNull(), w).otherwise(0.0) for x, w in pairs])
    return F.when(weight > 0, total / weight)


def row_mean(columns: Iterable[Column | str]) -> Column:
    return weighted_mean((c, 1.0) for c in columns)


def reasons(flags: Iterable[tuple[Column, str]], by: str = ";") -> Column:
    """Names of the flags that are true, joined in the order given."""
    return F.array_join(F.array_compact(F.array(*[F.when(f, n) for f, n in flags])), by)


def any_positive(columns: Iterable[Column | str]) -> Column:
    return functools.reduce(operator.or_, [F.coalesce(_c(c) > 0, F.lit(False)) for c in columns], F.lit(False))


def opening_window(duration: Column | str) -> Column:
    return F.least(F.lit(45.0), F.greatest(F.lit(30.0), _c(duration) * 0.02))


def frame_index(sec: Column | str, fps: Column | str, frames: Column | str | None = None) -> Column:
    at = F.greatest(F.bround(_c(sec) * _c(fps), 0).cast("long"), F.lit(0))
    return at if frames is None else F.least(at, _c(frames) - 1)


def sequence_id(prefix: str, number: Column | str, width: int = 5) -> Column:
    return F.concat(F.lit(prefix), F.lpad(_c(number).cast("string"), width, "0"))


def redact(text: Column | str, limit: int | None = None) -> Column:
    """URLs, e-mail addresses and phone numbers as marks, white space squeezed, cut at limit."""
    t = F.regexp_replace(_c(text), r"https?://[^ \t\r\n]+", "[URL]")
    # A match takes its whole run of local characters, so that none starts within one: without
    # this every character of a long run would be tried as a start.
    t = F.regexp_replace(t, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    t = F.regexp_replace(t, r"\+?[0-9][0-9() -]{7,}[0-9]", "[PHONE]")
    t = F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))
    return t if limit is None else F.substring(t, 1, limit)


# Feature name to group, by fixed patterns.
GROUPS = (("mfcc", "spectral_shape"), ("spectral|centroid|rolloff|flatness|bandwidth", "spectral"), ("onset|flux", "change"), ("rms|energy|silence|loud", "level"), ("zcr|zero", "noise"))


def feature_group(name: Column | str) -> Column:
    out = None
    for pattern, group in GROUPS:
        hit = F.lower(_c(name)).rlike(pattern)
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return out.otherwise("other")


def scope_of(scopes: Column, overlaps: Column) -> Column:
    """One scope of at least half overlap names the window; none is outside, more are mixed."""
    strong = F.array_distinct(F.transform(F.filter(F.arrays_zip(scopes.alias("s"), overlaps.alias("r")), lambda p: p["r"] >= 0.5), lambda p: p["s"]))
    return F.when(F.size(strong) == 1, strong[0]).when(F.coalesce(F.array_max(overlaps), F.lit(0.0)) <= 0, "outside").otherwise("mixed")
