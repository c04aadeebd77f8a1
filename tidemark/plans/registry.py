"""Registry of queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def points(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    """events as a timeline: user_id, t (seconds), event_id, event_type, value; only some types if named."""
    rows = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    if types:
        rows = rows.where(F.col("event_type").isin(*types))
    return rows.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_id", "event_type", "value")


# Limits in seconds: one second of the timeline that the rules were made for is an hour here.
HOUR = 3600.0
GAP = 10 * HOUR
CELL = 48 * HOUR

#: SQL of points() and of the interval sets that several queries share.
P = "p AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, event_id, event_type, value FROM events)"


def of(kind: str) -> str:
    return f"event_type = '{kind}'"


def sql_clusters(name: str, source: str, where: str, gap: float = GAP, least: int = 2) -> str:
    """Intervals (user_id, cluster_no, start, end, n, score) of gap clusters, as common tables."""
    return f"""{name}_a AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > {gap} THEN 1 ELSE 0 END AS fresh FROM {source} WHERE {where}),
{name}_b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS cluster_no FROM {name}_a),
{name} AS (SELECT user_id, cluster_no, min(t) AS start, max(t) AS "end", count(*) AS n, max(value) AS score FROM {name}_b GROUP BY user_id, cluster_no HAVING count(*) >= {least})"""


def sql_union(name: str, source: str) -> str:
    return f"""{name}_a AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {source}),
{name}_b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS union_no FROM {name}_a),
{name} AS (SELECT user_id, union_no, min(start) AS start, max("end") AS "end" FROM {name}_b GROUP BY user_id, union_no)"""
