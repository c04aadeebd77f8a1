"""License scans over a positional rare-token index, in DataFrame functions only.

Licence notices are kept as passages of words (tidemark.llm.notices). Document frequencies of all
their words are counted over the whole corpus, and the POSTED words of highest IDF of each passage
are posted with their positions in it. Per file, the posted words it holds are looked up; each
stands for the offset at which its passage would lie, and a passage is a candidate only at
offsets where the postings of two or more of its words agree. There the IDF share of its words
that stand in place (or within SLIP places of it, so that a word put in or left out moves no
other out of reach) must reach LEAST_SHARE, and one of its mandatory key phrases must stand in
place. The score is the best share of the file's accepted passages.

All work on a file happens within its row, so no shuffle carries texts and no word of many files
gathers anywhere; only the word counts (one row a passage word) reach the driver.
"""

from __future__ import annotations

import functools
import json
import math
import operator
import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.notices import PASSAGES, SPELLINGS

#: Posted words of a passage at most.
POSTED = 8
#: Places that a word may stand off its own.
SLIP = 2
#: Share of a passage's IDF that must stand in place.
LEAST_SHARE = 0.6

#: Base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Passages with their words in one spelling.
NOTICES = tuple((label, [SPELLINGS.get(w, w) for w in text.split()], [[SPELLINGS.get(w, w) for w in k.split()] for k in keys]) for label, text, keys in PASSAGES)
VOCABULARY = sorted({w for _, notice, _ in NOTICES for w in notice} | {w for p, _ in PHRASES for w in p.split()})


def words(text: F.Column) -> F.Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, GAP), "")


def _spelled(word: F.Column) -> F.Column:
    """A word in its one spelling."""
    return functools.reduce(lambda out, p: F.when(word == p[0], F.lit(p[1])).otherwise(out), SPELLINGS.items(), word)


def _strings(values: list[str]) -> F.Column:
    return F.array(*[F.lit(v) for v in values])


def idf(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Smoothed IDF of each passage word over all rows."""
    wanted = _strings([*VOCABULARY, *SPELLINGS])
    found = F.array_distinct(F.transform(F.array_intersect(wanted, words(F.col(text_col))), _spelled))
    seen = F.concat(found, F.array(F.lit("*")))
    counts = {r["w"]: r["n"] for r in docs.select(F.explode(seen).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    n = counts.get("*", 0)
    return {w: math.log((1 + n) / (1 + counts.get(w, 0))) + 1e-3 for w in VOCABULARY}


def posted(notice: list[str], weight: dict[str, float]) -> list[int]:
    """Positions of the passage's posted words: the first places of those of highest IDF."""
    first = [i for i, w in enumerate(notice) if notice.index(w) == i]
    return sorted(sorted(first, key=lambda i: (-weight[notice[i]], i))[:POSTED])


def place_of(notice: list[str], key: list[str]) -> int:
    return next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)


def _stands(at: F.Column, phrase: list[str]) -> F.Column:
    """The base phrase stands at word number at."""
    out = F.lit(True)
    for k, w in enumerate(phrase):
        out = out & F.coalesce(F.get("_w", at + k) == w, F.lit(False))
    return out


#: Offsets are packed below the passage number; one may be negative.
_SPAN, _ZERO = 1 << 40, 1 << 32


def _votes(weight: dict[str, float]) -> F.Column:
    """For each hit of a posted word, (passage, offset) packed, over all passages that post it."""
    postings: dict[str, list[int]] = {}
    for k, (_, notice, _) in enumerate(NOTICES):
        for i in posted(notice, weight):
            postings.setdefault(notice[i], []).append(k * _SPAN + _ZERO - i)
    table = F.from_json(F.lit(json.dumps(postings)), "map<string, array<bigint>>")
    return F.flatten(F.transform("_hits", lambda h: F.transform(F.coalesce(F.element_at(table, h["w"]), F.array().cast("array<bigint>")), lambda v: v + h["p"])))


def _passages(weight: dict[str, float]) -> F.Column:
    """The passages as one constant array: label, words with weights, and key phrases with places."""
    out = []
    for label, notice, keys in NOTICES:
        total = sum(weight[w] for w in notice)
        phrases = [{"words": k, "at": place_of(notice, k)} for k in keys]
        out.append({"label": label, "facts": [{"w": w, "x": weight[w] / total} for w in notice], "keys": phrases})
    kind = "array<struct<label: string, facts: array<struct<w: string, x: double>>, keys: array<struct<words: array<string>, at: int>>>>"
    return F.from_json(F.lit(json.dumps(out)), kind)


def _share(offset: F.Column, facts: F.Column) -> F.Column:
    """Share of the weights of the words that stand within SLIP places of offset plus their own."""

    def stands(fact: F.Column, i: F.Column) -> F.Column:
        first = F.greatest(F.lit(0), offset + i - SLIP)
        size = offset + i + SLIP + 1 - first
        near = F.when(size > 0, F.array_contains(F.slice("_v", first + 1, F.greatest(F.lit(0), size)), fact["w"])).otherwise(False)
        return F.when(near, fact["x"]).otherwise(0.0)

    return F.aggregate(F.transform(facts, stands), F.lit(0.0), lambda a, x: a + x)


def _keyed(offset: F.Column, keys: F.Column) -> F.Column:
    def stands(key: F.Column) -> F.Column:
        slips = [offset + key["at"] + d for d in range(-SLIP, SLIP + 1)]
        return functools.reduce(operator.or_, [(s >= 0) & (F.slice("_v", F.greatest(F.lit(0), s) + 1, F.size(key["words"])) == key["words"]) for s in slips])

    return F.exists(keys, stands)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null text counts as empty: no words, no labels (empty strings), null places, score 0. Each
    row is answered by itself, repeated or not, a null id too; an empty table gives no rows.
    """
    weight = idf(docs, text_col)
    rare = {notice[i] for _, notice, _ in NOTICES for i in posted(notice, weight)}
    index = sorted(rare | {p.split()[0] for p, _ in PHRASES}, key=lambda w: (-weight[w], w))

    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col).cast("string")).alias("_w"))
    others = list(SPELLINGS)
    frame = frame.withColumn("_top", F.array_intersect(_strings([*index, *others]), F.col("_w")))
    hit = F.transform("_w", lambda w, i: F.when(F.array_contains("_top", w), F.struct(_spelled(w).alias("w"), i.alias("p"))))
    frame = frame.withColumn("_hits", F.when(F.size("_top") > 0, F.filter(hit, lambda h: h.isNotNull())))
    frame = frame.withColumn("_v", F.when(F.arrays_overlap("_top", _strings(others)), F.transform("_w", _spelled)).otherwise(F.col("_w")))

    def standing(phrase: list[str]) -> F.Column:
        places = F.transform(F.filter("_hits", lambda h: h["w"] == phrase[0]), lambda h: h["p"])
        return F.when(F.array_contains("_top", phrase[0]), F.filter(places, lambda at: _stands(at, phrase)))

    # Two or more words of a passage must agree on an offset: equal neighbours of the sorted votes.
    frame = frame.withColumn("_votes", F.when(F.size("_top") > 1, F.array_sort(_votes(weight))))
    agreed = F.array_distinct(F.filter("_votes", lambda v, i: (i > 0) & (F.get("_votes", i - 1) == v)))
    some = frame.withColumn("_agreed", agreed)

    passages = _passages(weight)

    def tried(vote: F.Column) -> F.Column:
        offset = (vote % _SPAN - _ZERO).cast("int")
        passage = F.element_at(passages, (F.shiftright(vote, 40) + 1).cast("int"))
        share = F.when(_keyed(offset, passage["keys"]), _share(offset, passage["facts"])).otherwise(0.0)
        return F.struct(passage["label"].alias("label"), share.alias("share"))

    accepted = F.filter(F.transform("_agreed", tried), lambda c: c["share"] >= LEAST_SHARE)
    some = some.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        *[standing(p.split()).alias(f"_base{k}") for k, (p, _) in enumerate(PHRASES)],
        F.when(F.size("_agreed") > 0, accepted).alias("_found"),
    )
    starts = [F.coalesce(F.col(f"_base{k}"), F.array().cast("array<int>")) for k in range(len(PHRASES))]
    every = F.concat(*starts)
    base_labels = F.array_compact(F.array(*[F.when(F.size(s) > 0, label) for s, (_, label) in zip(starts, PHRASES, strict=True)]))
    more = F.coalesce(F.transform("_found", lambda c: c["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("_found", lambda c: c["share"])), F.lit(0.0))
    return some.select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, more)), ",").alias("labels"),
        F.least(F.lit(1.0), best).alias("score"),
    )
