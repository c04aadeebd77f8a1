"""Filter interaction audit: what each of five filters removes in every order they can take.

Texts are scanned in the Arrow buffer of a batch. A table of byte classes marks white space,
capitals, signs and the bytes that begin a code point; prefix sums of the marks, read at the
documents' ends, count them. Words are the runs between marks of white space; each gets a hash
from prefix sums of its bytes, and a document's hashes are sorted, so that equal words stand
together. Neighbours of one hash are compared byte by byte; where that ever fails, the document's
words are counted as they are.

A document is then five bits. Documents are summed by part, bits and labels, and every order and
step is read off those sums, at most 32 a part; no order is ever run over the documents.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

FILTERS = "ABCDE"
#: Bounds of the filters: words, percent of distinct words, percent of capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SIGNS = b"#$%&*|"
#: Bytes that are scanned at a time; one document may be longer.
BLOCK = 4 << 20
_SPACE, _CAPITAL, _SIGN, _POINT = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] |= _SPACE
_CLASS[65:91] |= _CAPITAL
_CLASS[list(SIGNS)] |= _SIGN
_CLASS[:128] |= _POINT
_CLASS[192:] |= _POINT
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes from a and from b on differ within sizes, a pair a row."""
    out = np.zeros(len(a), bool)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        if size > 1 << 12:
            out[own] = [not np.array_equal(data[i : i + size], data[j : j + size]) for i, j in zip(a[own], b[own], strict=True)]
            continue
        place, step = np.arange(size), (1 << 18) // int(size)
        for at in range(0, len(own), step):
            rows = own[at : at + step]
            out[rows] = (data[a[rows, None] + place] != data[b[rows, None] + place]).any(axis=1)
    return out


def _repeats(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray, n: int, hashes: np.ndarray) -> np.ndarray:
    """Words of each document less its distinct words."""
    order = np.lexsort((hashes, docs))
    a, b = order[:-1], order[1:]
    met = (docs[a] == docs[b]) & (hashes[a] == hashes[b])
    a, b = a[met], b[met]
    size = ends - starts
    wrong = size[a] != size[b]
    wrong[~wrong] = _differ(data, starts[a[~wrong]], starts[b[~wrong]], size[a[~wrong]])
    out = np.bincount(docs[a], minlength=n)
    for d in np.unique(docs[a[wrong]]):
        own = np.flatnonzero(docs == d)
        out[d] = len(own) - len({data[s:e].tobytes() for s, e in zip(starts[own], ends[own], strict=True)})
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, whatever its place: the sum of byte times a power of an odd
    base, from prefix sums, divided by the power of its start. Of a word above BLOCK its first
    BLOCK bytes and its length count; words of one hash are compared whole in any case."""
    out = np.empty(len(starts), np.uint64)
    until = np.minimum(ends, starts + BLOCK)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(until, starts[at] + BLOCK, side="right")))
        low, own = starts[at], slice(at, end)
        piece = data[low : until[end - 1]].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * _powers(_BASE, len(piece)), out=sums[1:])
        out[own] = (sums[until[own] - low] - sums[starts[own] - low]) * _powers(_BACK, len(piece) + 1)[starts[own] - low]
        at = end
    out += (ends - starts).astype(np.uint64)
    return out ^ (out >> np.uint64(29))


def _sums_at(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Prefix sums of marks at rising offsets, a block of marks at a time."""
    out, before = np.zeros(len(offsets), np.int64), 0
    for at in range(0, len(marks), BLOCK):
        sums = np.cumsum(marks[at : at + BLOCK], dtype=np.int64)
        own = slice(*np.searchsorted(offsets, [at, at + len(sums)], side="right"))
        out[own] = before + sums[offsets[own] - at - 1]
        before += int(sums[-1])
    return out


def scanned(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """words, distinct, capitals, signs and points of each text data[offsets[k]:offsets[k + 1]]."""
    kind = _CLASS[data]
    counted = lambda mask: np.diff(_sums_at((kind & mask) != 0, offsets))
    inside = (kind & _SPACE) == 0
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = ~inside[1:] | ~inside[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(edge[:-1] & inside)
    ends = np.flatnonzero(edge[1:] & inside) + 1
    docs = np.searchsorted(offsets, starts, side="right") - 1
    n = len(offsets) - 1
    words = np.bincount(docs, minlength=n)
    repeats = _repeats(data, starts, ends, docs, n, word_hashes(data, starts, ends))
    return {"words": words, "distinct": words - repeats, "capitals": counted(_CAPITAL), "signs": counted(_SIGN), "points": counted(_POINT)}


def failures(seen: dict[str, np.ndarray]) -> np.ndarray:
    """Bits 0 to 3 for the filters A to D that a text fails."""
    fails = (
        seen["words"] < LEAST_WORDS,
        100 * seen["distinct"] < LEAST_DISTINCT * seen["words"],
        100 * seen["capitals"] > MOST_CAPITALS * seen["points"],
        seen["signs"] > 0,
    )
    return sum(f.astype(np.int64) << k for k, f in enumerate(fails))


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        whole = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        out = np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(whole, whole[at] + BLOCK, side="right")) - 1)
            out[at:end] = failures(scanned(data[whole[at] : whole[end]], whole[at : end + 1] - whole[at]))
            at = end
        yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "part", "digest")), pa.array(out, pa.int32())], names=["doc_id", "part", "digest", "mask"])


def document_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask): bits 0 to 3 of mask are the filters A to D."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    return rows.mapInArrow(_masks, f"doc_id {dict(rows.dtypes)['doc_id']}, part string, digest binary, mask int")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters.

    Copies of a text agree in every other bit, so the bit of E is counted, not joined back: rows
    merge by digest and id, then by digest, part and labels with their smallest id and its
    number; a digest's rows beyond those of its smallest id fail. A text of a third of all rows
    spreads over its ids first and is a few rows a task after.
    """
    told = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    marks = cut(labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_of")).agg(told("quality"), told("toxic")))
    rows = cut(document_masks(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("m")))
    rows = rows.join(marks, F.col("doc_id") == F.col("_of"), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("quality", "toxic")})
    # A null id is no smaller id of another, and has none itself.
    groups = rows.groupBy("digest", "mask", "part", "quality", "toxic").agg(
        F.sum("m").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("m"))), F.lit(0)).alias("unnamed"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "m"))).alias("low"),
    )
    # A row of low holds one (digest, part, labels) and id, so equal lowest ids of other groups are theirs.
    first = F.min("low.doc_id").over(Window.partitionBy("digest"))
    kept = F.col("unnamed") + F.when(F.col("low.doc_id") == F.col("first"), F.col("low.m")).otherwise(F.lit(0))
    split = groups.withColumn("first", first).withColumn("kept", kept).select(
        "part", "quality", "toxic", F.explode(F.array(F.struct("mask", F.col("kept").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))).alias("e")
    )
    return split.groupBy("part", F.col("e.mask").alias("mask")).agg(
        F.sum("e.n").alias("n"), F.sum(F.col("e.n") * F.col("quality")).alias("good"), F.sum(F.col("e.n") * F.col("toxic")).alias("toxic")
    )


def orders() -> list[tuple[str, int, int, int, int]]:
    """(order, step, its filter's number, bits of the filters before it, of the filter), 600 rows."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        name = "".join(FILTERS[k] for k in order)
        out += [(name, i + 1, k, sum(1 << j for j in order[:i]), 1 << k) for i, k in enumerate(order)]
    return out


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step: part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null text counts as empty, null lang as the empty part; a null id has no smaller id and is
    none; repeated rows count each, and those of a text's smallest id pass E; of repeated labels
    of a document one that says 1 is enough. An empty table has no parts and gives no rows.
    """
    counts = mask_counts(docs, labels)
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sums"))  # at most 32 a part
    plan = F.from_json(F.lit(repr([list(r) for r in orders()]).replace("'", '"')), "array<array<string>>")
    rows = by_part.withColumn("s", F.explode(plan)).select(
        "part", "sums", F.col("s")[0].alias("filter_order"), *[F.col("s")[k].cast("int").alias(c) for k, c in ((1, "step"), (3, "before"), (4, "bit"))]
    )

    def total(which: str, when) -> Column:
        return F.aggregate("sums", F.lit(0).cast("long"), lambda a, e: a + F.when(when(e["mask"]), e[which]).otherwise(F.lit(0)))

    has = lambda m: m.bitwiseAND(F.col("bit")) != 0
    free = lambda m: m.bitwiseAND(F.col("before")) == 0
    size = sum(1 for _ in itertools.permutations(FILTERS))
    # In as many orders as any other of its failed filters, a filter is the first to meet a document.
    shapley = F.aggregate("sums", F.lit(0).cast("long"), lambda a, e: a + F.when(has(e["mask"]), e["n"] * (F.lit(size) / F.bit_count(e["mask"])).cast("long")).otherwise(F.lit(0)))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: free(m) & ~has(m)).alias("kept"),
        total("n", lambda m: free(m) & has(m)).alias("removed"),
        total("n", lambda m: ~free(m) & has(m)).alias("redundant"),
        total("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("good", lambda m: free(m) & has(m)).alias("good_lost"),
        total("toxic", lambda m: free(m) & has(m)).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


SQL = r"""
WITH l AS (SELECT doc_id AS id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (SELECT doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
   regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f FROM w LEFT JOIN l ON doc_id = id),
g AS MATERIALIZED (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || d.c || e.c || h.c AS filter_order FROM x a, x b, x d, x e, x h WHERE len(list_distinct([a.c, b.c, d.c, e.c, h.c])) = 5),
s AS MATERIALIZED (SELECT filter_order, step, [strpos('ABCDE', c) FOR c IN string_split(filter_order[1:step - 1], '') IF c <> ''] AS before, strpos('ABCDE', filter_order[step]) AS k
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, k, n, good, toxic, f[k] AS has, len(list_filter(before, lambda b: f[b])) = 0 AS free, len(list_filter(f, lambda v: v)) AS fails FROM g, s),
t AS (SELECT part, filter_order, step, k, sum(n) FILTER (free AND NOT has) AS kept, sum(n) FILTER (free AND has) AS removed, sum(n) FILTER (has AND NOT free) AS redundant,
  sum(n) FILTER (has AND fails = 1) AS unique_fails, sum(good) FILTER (free AND has) AS good_lost, sum(toxic) FILTER (free AND has) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM t
"""
