"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the documents are range-partitioned by
that key into buckets, token counts are summed per bucket, bucket totals are prefix-summed, and
a local running sum inside each bucket gives the document's position in its source's random
order. The source's budget then cuts that order at an exact token: documents before the cut are
taken once more than those after it, and the document on the cut gives part of its tokens.
No source, however large, is ever ordered in one task: a task orders single buckets, whose
number grows with the table (a bucket is a prefix of the key, so their number changes no result).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import row_hash
from tidemark.session import cut

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Rows of a bucket at most, were all rows of one source, and its least number of hex digits.
BUCKET_ROWS, LEAST_DIGITS = 16384, 3


def word_count(text: str | F.Column) -> F.Column:
    """Number of words in a text; null counts as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def bucket_digits(rows: int) -> int:
    """Hex digits of the key that name a bucket of a table of so many rows."""
    digits = LEAST_DIGITS
    while 16**digits * BUCKET_ROWS < rows:
        digits += 1
    return digits


def measured(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", seed: str = "mix-1", digits: int = LEAST_DIGITS) -> DataFrame:
    """Adds _size, _src (a non-null source key), _digest (of the text), _key (hash-random, from id
    and text, so that rows of one id or of none spread like others) and _bucket (a range of keys)."""
    return (
        docs.withColumn("_size", word_count(text))
        .withColumn("_src", F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("~null")))
        .withColumn("_digest", F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))
        .withColumn("_key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("_digest")).cast("binary")))
        .withColumn("_bucket", F.substring("_key", 1, digits))
    )


def budgets(per_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(_src, source_size, target) from (_src, source_size), one row a source.

    Sources in code-point order, null last, take the weights in turn and divide share times all
    tokens; no target exceeds cap times its source, and the excess goes to the others by weight.
    Resharing until nothing is above its cap equals filling to one common level: order sources by
    cap/weight, and the level is set by the first source that its own cap does not bind.
    """
    every = Window.partitionBy()
    order = Window.orderBy(F.when(F.col("_src") == "~null", 1).otherwise(0), "_src")
    rank = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    frame = (
        per_source.withColumn("_w", w)
        .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_all", F.sum("source_size").over(every) * F.lit(float(share)))
    )
    rising = Window.orderBy("_ratio", "_src")
    before = F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(rising.rowsBetween(0, Window.unboundedFollowing))
    frame = frame.withColumn("_level", (F.col("_all") - before) / rest)
    level = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(every)
    return frame.withColumn("_top", level).select(
        "_src", "source_size", F.when(F.col("_top").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_top") * F.col("_w"))).alias("target")
    )


def placed(sized: DataFrame, totals_of: DataFrame | None = None, id_col: str = "doc_id", **rules) -> DataFrame:
    """Adds source_size, target, size, taken (tokens) and copies (times the row enters the mix,
    the row on the cut included) to the rows of measured().

    Rows that repeat an id, or have none, are separate rows, ordered by their texts like others;
    rows that repeat id and text tie, by a column _tie where there is one. Rows of no words take a
    place in the order, take no tokens, and are copied as their place says; null text counts as
    empty and null sources are one source. An empty table gives no rows.
    """
    totals = (sized if totals_of is None else totals_of).groupBy("_src", "_bucket").agg(F.sum("_size").alias("_total"))
    totals = cut(totals)
    along = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = budgets(totals.groupBy("_src").agg(F.sum("_total").alias("source_size")), **rules)
    offsets = totals.select("_src", "_bucket", F.coalesce(F.sum("_total").over(along), F.lit(0)).alias("_offset")).join(plan, "_src")
    ties = ["_tie"] if "_tie" in sized.columns else []
    within = Window.partitionBy("_src", "_bucket").orderBy("_key", id_col, "_size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("_before", F.coalesce(F.sum("_size").over(within), F.lit(0))).join(offsets, ["_src", "_bucket"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    rows = (
        rows.withColumn("_epochs", epochs.cast("long"))
        .withColumn("_rest", budget - F.col("_epochs") * F.col("source_size"))
        .withColumn("_start", F.col("_offset") + F.col("_before"))
    )
    part = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - F.col("_start")))
    return (
        rows.withColumn("size", F.col("_size"))
        .withColumn("taken", (F.col("_epochs") * F.col("_size") + part).cast("long"))
        .withColumn("copies", F.col("_epochs") + F.when(F.col("_start") < F.col("_rest"), 1).otherwise(0))
    )


def mix_report(docs: DataFrame, **rules) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, copies. Nulls, ties, repeated
    rows and empty tables are as in placed(); the same rows in any layout give the same report."""
    sized = cut(measured(docs.select("doc_id", "source", "text"), digits=bucket_digits(docs.count())).drop("text"))
    return placed(sized, **rules).select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


def mix_documents(docs: DataFrame, **rules) -> DataFrame:
    """The mix itself: every row as often as the mix takes it, columns unchanged.

    A document on its source's cut is kept whole, so a source exceeds its budget by less than
    one document. A clash with the operator's own columns is avoided by nesting the row. Ties of
    rows that repeat id and text go by a hash of the row, so that any layout of the same rows
    gives the same mix; the rest is as in placed().
    """
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id"), F.col("source"), F.col("text"))
    sized = measured(rows, digits=bucket_digits(docs.count())).withColumn("_tie", row_hash(docs)).drop("text", "source")
    out = placed(sized, totals_of=sized.select("_src", "_bucket", "_size"), **rules)
    return out.where("copies > 0").withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source
), w AS (
  SELECT *, CASE r % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS wt,
         source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(wt) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w
), t AS (
  SELECT source, source_size, CASE WHEN top IS NULL THEN cap ELSE least(cap, top * wt) END AS target
  FROM (SELECT *, max(CASE WHEN lv <= cap / wt THEN lv END) OVER () AS top FROM l)
), p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - start)))::BIGINT AS taken,
       (epochs + CASE WHEN start < floor(target)::BIGINT - epochs * source_size THEN 1 ELSE 0 END)::BIGINT AS copies
FROM p
"""
