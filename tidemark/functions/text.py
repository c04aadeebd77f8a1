"""Text functions. Only compatibility normalisation and sequence similarity, which Spark lacks,
run in Python, on Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of the tokens that keyword matching knows.
KEEP = r"[^0-9a-z가-힣%+./:_-]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(T.StringType())
def compatibility_form(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalise(text: Column | str, compatibility: bool = True) -> Column:
    """Lower case, known characters only, single spaces; null is empty."""
    t = F.coalesce(_c(text), F.lit(""))
    if compatibility:
        t = compatibility_form(t)
    return F.trim(F.regexp_replace(F.lower(t), KEEP, " "))


def compact(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"\s+", "")


def tokens(text: Column | str, pattern: str = r"[^\s]+") -> Column:
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(pattern), F.lit(0))


def occurrences(text: Column | str, phrase: Column | str) -> Column:
    """Non-overlapping occurrences of a plain phrase."""
    t, p = F.coalesce(_c(text), F.lit("")), phrase if isinstance(phrase, Column) else F.lit(phrase)
    return F.when(F.length(p) > 0, ((F.length(t) - F.length(F.replace(t, p, F.lit("")))) / F.length(p)).cast("int")).otherwise(0)


def keyword_hits(normal: Column | str, packed: Column | str, keywords: Iterable[str]) -> Column:
    """Keywords found in the normalised or in the compact text, each once."""
    n, p = _c(normal), _c(packed)
    return F.array_compact(F.array(*[F.when(n.contains(k) | p.contains(k.replace(" ", "")), F.lit(k)) for k in keywords]))


def phrase_hits(text: Column | str, phrases: Iterable[str]) -> Column:
    return F.array_compact(F.array(*[F.when(_c(text).contains(p), F.lit(p)) for p in phrases]))


def within_reach(text: Column | str, first: str, second: str, window: int) -> Column:
    """Some starts of two stems lie at most window characters apart, in either order. Two bounded
    look-aheads at each position, so the time is linear in the text."""
    a, b = re.escape(first), re.escape(second)
    return F.coalesce(_c(text), F.lit("")).rlike(f"(?s)(?={a})(?=.{{0,{window}}}{b})|(?={b})(?=.{{0,{window}}}{a})")


def best_ratio(text: str, phrase: str, low: int = 4, high: int = 8) -> float:
    """Best similarity of a phrase with any substring of low to high characters.

    The characters that a substring shares with the phrase bound its ratio; substrings are tried
    from the largest bound down until none left can beat the best."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    shared = [(np.r_[0, np.cumsum(codes == ord(c))], phrase.count(c)) for c in set(phrase)]
    tries = []
    for size in range(low, min(high, len(codes)) + 1):
        common = sum(np.minimum(run[size:] - run[:-size], n) for run, n in shared)
        bound = 2.0 * common / (size + len(phrase))
        tries.append((bound, np.arange(len(bound)), np.full(len(bound), size)))
    if not tries:
        return 0.0
    bound, at, size = (np.concatenate(x) for x in zip(*tries, strict=True))
    best, seen, match = 0.0, set(), SequenceMatcher(autojunk=False)
    match.set_seq2(phrase)
    for k in np.argsort(-bound, kind="stable"):
        if bound[k] <= best:
            break
        part = text[at[k] : at[k] + size[k]]
        if part not in seen:
            seen.add(part)
            match.set_seq1(part)
            best = max(best, match.ratio())
    return best


def fuzzy_score(phrases: tuple[str, ...]):
    """Column function: the best similarity of any phrase with substrings of the text."""

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series) -> pd.Series:
        return text.map(lambda t: max((best_ratio(t or "", p) for p in phrases), default=0.0))

    return score


def corrected_score(disclosure: Column, sponsor: Column, product: Column, cta: Column, link: Column, price: Column, guard: Column) -> Column:
    """Weighted keyword evidence; a guard phrase voids disclosure and costs half a point."""
    raw = F.when(guard, 0.0).otherwise(2.0 * disclosure) + 1.5 * sponsor + 0.8 * product + 1.0 * cta + 1.0 * link + 0.8 * price - F.when(guard, 0.5).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw / 6.0))


def density(token_count: Column, char_count: Column, box_count: Column, area: Column) -> Column:
    """Mean of four capped ratios."""
    one = F.lit(1.0)
    return (F.least(one, token_count / 18.0) + F.least(one, char_count / 120.0) + F.least(one, box_count / 8.0) + F.least(one, area / 0.08)) / 4.0


def frame_score(keyword_score: Column, density_score: Column) -> Column:
    return 0.65 * keyword_score + 0.35 * density_score


def token_type(token: Column | str) -> Column:
    t = _c(token)
    return (
        F.when(t.rlike(r"^[0-9][0-9.,%]*$"), "numeric")
        .when(t.rlike(r"[0-9]") & t.rlike(r"[A-Za-z]"), "mixed")
        .when(t.rlike(r"^[가-힣]+$"), "hangul")
        .when(t.rlike(r"^[A-Za-z]+$"), "latin")
        .otherwise("other")
    )


def token_category(token: Column, lift: Column, groups: Column, terms: dict[str, tuple[str, ...]]) -> Column:
    """A term list names the category; otherwise lift and spread do."""
    out = None
    for name, words in terms.items():
        hit = token.isin(*words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when((lift >= 2) & (groups >= 2), "candidate").when(lift >= 2, "single_group").otherwise("common")


def emptiness(status: Column | str, text: Column | str) -> Column:
    """Failed reads and empty reads are classes of their own, never negative evidence."""
    return F.when(F.coalesce(_c(status), F.lit("failed")) != "ok", "failed").when(F.length(F.trim(F.coalesce(_c(text), F.lit("")))) == 0, "success_empty").otherwise("success_text")


def subtype(notes: Column | str) -> Column:
    """Strongest named way of a match: typo, then proximity, then fuzzy, else exact."""
    t = F.lower(F.coalesce(_c(notes), F.lit("")))
    return F.when(t.contains("typo"), "typo").when(t.contains("proximity") | t.contains("near"), "proximity").when(t.contains("fuzzy"), "fuzzy").otherwise("exact")
