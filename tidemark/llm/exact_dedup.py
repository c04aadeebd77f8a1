"""Exact dedup by skew-safe combining.

Texts are equal when identical after lower-casing A-Z. Each stage groups by the whole
normalised text beside its digest, so unequal texts never merge: map tasks merge the copies they
hold, salted digest groups merge next (a group of a third of all rows spreads over the salts),
and the few salt winners of a digest merge last. Only the winners' digests travel back.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

SALTS = 16
#: A text of more than one part in HOT of all rows has its copies joined over the salts; there are
#: fewer than HOT such texts at any size of the table.
HOT = 4096


def normalised(text: F.Column) -> F.Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def row_hash(docs: DataFrame) -> F.Column:
    """A hash of a row kept in the struct _row; maps, which Spark does not hash, go in as text."""
    parts = []
    for f in docs.schema.fields:
        part = F.col(f"_row.`{f.name}`")
        parts.append(F.to_json(F.struct(part)) if "map<" in f.dataType.simpleString() else part)
    return F.xxhash64(*parts)


def copy_groups(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(digest, norm, keep_id, group_size), one row a distinct text, from rows (doc_id, norm, digest).
    The salt is that of the map task, which has merged its own copies before."""
    salted = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    return salted.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The largest id of equal texts stays. Null text counts as empty; a null id is smaller than
    any other, and of a group of null ids every row is kept; rows that repeat both id and text
    share one decision. Distinct texts of one digest, should they ever occur, are told apart by
    content in the last join too. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    groups = copy_groups(rows, salts).select("digest", "keep_id", "group_size")
    winners = cut(groups)
    shared = winners.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    ids = rows.select("doc_id", "digest")
    if shared.isEmpty():
        total = winners.agg(F.sum("group_size")).first()[0] or 0
        hot = winners.where(F.col("group_size") * HOT > total).select("digest", F.lit(True).alias("hot"))
        spread = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        by_salt = winners.withColumn("hot", F.col("group_size") * HOT > total).withColumn("salt", F.explode(spread)).drop("hot")
        salt = F.when(F.col("hot"), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(F.lit(0)).cast("int")
        # Fewer than HOT rows of 33 bytes: small at any size of the input.
        joined = ids.join(F.broadcast(hot), "digest", "left").withColumn("salt", salt).join(by_salt, ["digest", "salt"])
    else:
        joined = rows.join(copy_groups(rows, salts), ["digest", "norm"])
    return joined.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def without_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows that stay, columns unchanged; rows repeated with id and text stay once, the one of
    the smallest row hash. Null text counts as empty; null ids are one id, the smallest, so that
    one of a group's stays where it has no other; an empty table gives no rows.

    Ids join as text, null as a word of its own, so that the join and the choice among repeated
    rows share one exchange of the documents."""
    rows = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    name = F.coalesce(F.col("keep_id").cast("string"), F.lit("null"))
    winners = copy_groups(rows, salts).select(F.col("digest").alias("_digest"), name.alias("_id")).distinct()
    digest = F.unhex(F.sha2(normalised(F.col("text")), 256))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"), digest.alias("_digest"))
    kept = whole.join(winners, ["_digest", "_id"], "left_semi")
    once = Window.partitionBy("_digest", "_id").orderBy(row_hash(docs))
    return kept.withColumn("_n", F.row_number().over(once)).where("_n = 1").select("_row.*")


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
