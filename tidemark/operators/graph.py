"""Connected components of an edge list, as alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _nearest(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of every node; cut so that the join that follows starts from two
    exchanges, which lets adaptive execution split the rows of a hub over several tasks."""
    return cut(edges.groupBy("u").agg(F.min("v").alias("m")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest reachable node.

    Large-star links each larger neighbour of a node to the smallest node around it, small-star
    does the same for the smaller neighbours; alternating them ends in one star a component
    after a logarithmic number of rounds. Edges are kept distinct and each round is cut to the
    shared folder. Null ends and self loops count as no edge; a node without edges is absent.
    """
    hi, lo = F.greatest(src, dst), F.least(src, dst)
    current = cut(
        edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .select(hi.alias("u"), lo.alias("v"))
        .distinct()
    )
    seen = _fingerprint(current)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(
            both.join(_nearest(both), "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        small = (
            large.join(_nearest(large), "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        current = cut(small)
        now = _fingerprint(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
