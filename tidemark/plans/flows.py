"""Source, sink and stream queries: round trips through files of the shared folder."""

from __future__ import annotations

import io
import uuid
import wave
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import signal
from tidemark.operators import fsm
from tidemark.plans.registry import HOUR, query, sql_clusters, table
from tidemark.plans.rules import sql_walk
from tidemark.session import shared_dir
from tidemark.sources import media, tabular
from tidemark.streaming import timeline as stream


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey AS id, c_name AS name, round(c_acctbal, 2) AS balance, NULL::VARCHAR AS note FROM customer")
def text_table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A table written as text with declared columns and read back by alias."""
    path = _folder(spark, "csv")
    tabular.write_text_table(table(spark, d, "customer"), path, ["c_custkey", "c_name", "c_acctbal", "note"])
    back = tabular.renamed(tabular.read_text_table(spark, path), {"id": ["C_CUSTKEY"], "name": ["c_name"], "balance": ["c_acctbal"], "note": []})
    return back.select(F.col("id").cast("long").alias("id"), "name", F.round(F.col("balance").cast("double"), 2).alias("balance"), "note")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def resumed_append(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping runs append each row once."""
    path = _folder(spark, "append")
    rows = table(spark, d, "orders", "o_orderkey", "o_totalprice")
    tabular.append_new(rows.where("o_orderkey % 3 < 2"), path, "o_orderkey")
    return tabular.append_new(rows, path, "o_orderkey")


@query("SELECT r_regionkey, count(*) AS n, string_agg(n_name, ';' ORDER BY n_nationkey) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def manifest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Nested JSON per key, written and read back."""
    path = _folder(spark, "manifest")
    tabular.write_manifest(table(spark, d, "nation"), path, "n_regionkey", ["n_nationkey", "n_name"])
    back = spark.read.schema("n_regionkey int, parts array<struct<n_nationkey: int, n_name: string>>").json(path)
    return back.select(F.col("n_regionkey").alias("r_regionkey"), F.size("parts").cast("long").alias("n"), F.array_join(F.transform(F.array_sort("parts"), lambda p: p["n_name"]), ";").alias("names"))


@query("SELECT c_mktsegment AS item, count(*) AS n FROM (SELECT unnest(string_split(c_mktsegment || ';' || c_mktsegment, ';')) AS c_mktsegment FROM customer) GROUP BY 1")
def list_cells(spark: SparkSession, d: str) -> DataFrame:
    """Delimited cells and JSON cells as rows."""
    rows = table(spark, d, "customer", "c_mktsegment")
    plain = rows.select(F.explode(tabular.split_list(F.concat_ws(" ; ", "c_mktsegment"))).alias("item"))
    nested = rows.select(F.explode(tabular.json_list(F.to_json(F.array("c_mktsegment")))).alias("item"))
    return plain.unionByName(nested).groupBy("item").agg(F.count("*").alias("n"))


#: Tables of a decision frame, the prefix their columns get there, and the columns.
_DECISION = {"documents": ("feature", ["doc_id", "text", "lang", "source", "n_chars"]), "labels": ("label", ["doc_id", "quality", "toxic"]), "benchmark": ("gt", ["item_id", "text"])}


@query(
    "SELECT feature, valid, regexp_matches(feature, 'actual|label|truth|ground|annotation|review|(^|[^a-z0-9])gt([^a-z0-9]|$)') AS forbidden FROM ("
    + " UNION ALL ".join(f"SELECT '{prefix}_{c}' AS feature, count({c}) AS valid FROM {name}" for name, (prefix, columns) in _DECISION.items() for c in columns)
    + ")"
)
def column_guard(spark: SparkSession, d: str) -> DataFrame:
    """Columns offered to a decision, their present values, and those that tell of labels (P25)."""
    parts = []
    for name, (prefix, columns) in _DECISION.items():
        counts = table(spark, d, name, *columns).agg(*[F.count(c).alias(f"{prefix}_{c}") for c in columns])
        parts.append(counts.unpivot([], counts.columns, "feature", "valid"))
    return reduce(DataFrame.unionByName, parts).withColumn("forbidden", tabular.is_forbidden("feature"))


@query(
    """WITH n AS (SELECT n_nationkey, n_regionkey, min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
r AS (SELECT n_regionkey, min(lo) AS lo, max(hi) AS hi, sum(c) AS c FROM n GROUP BY 1),
k AS (SELECT n_nationkey, 'balance' AS section, 'highest' AS name, hi AS value, 1 AS over FROM n UNION ALL SELECT n_nationkey, 'own', 'customers', c, 1 FROM n
UNION ALL SELECT n_nationkey, 'balance', 'lowest', r.lo, 0 FROM n JOIN r USING (n_regionkey) UNION ALL SELECT n_nationkey, 'balance', 'highest', r.hi, 0 FROM n JOIN r USING (n_regionkey) UNION ALL SELECT n_nationkey, 'size', 'customers', r.c, 0 FROM n JOIN r USING (n_regionkey))
SELECT n_nationkey, section, name, arg_max(value, over)::DOUBLE AS value FROM k GROUP BY 1, 2, 3"""
)
def config_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Nested settings of a family (region) with each variant's (nation's) changes merged in."""
    nations = table(spark, d, "nation", "n_nationkey", "n_regionkey")
    rows = table(spark, d, "customer", "c_nationkey", "c_acctbal").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.count("*").cast("double").alias("c")).join(nations, "n_nationkey")
    of = lambda **parts: F.create_map(*[x for k, m in parts.items() for x in (F.lit(k), F.create_map(*[y for n, v in m.items() for y in (F.lit(n), F.col(v))]))])
    base = rows.groupBy("n_regionkey").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("c").alias("c")).select("n_regionkey", of(balance={"lowest": "lo", "highest": "hi"}, size={"customers": "c"}).alias("base"))
    variants = rows.select("n_nationkey", "n_regionkey", of(balance={"highest": "hi"}, own={"customers": "c"}).alias("changes"))
    merged = variants.join(base, "n_regionkey").select("n_nationkey", F.explode(tabular.overlaid("base", "changes")).alias("section", "settings"))
    return merged.select("n_nationkey", "section", F.explode("settings").alias("name", "value"))


def _drained(frame: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and reads its sink. Complete results overwrite the
    batch before, so a retried batch changes nothing."""
    spark = frame.sparkSession
    writer = frame.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "complete":
        done = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out")).start()
    else:
        done = writer.format("parquet").option("path", f"{folder}/out").start()
    done.awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{folder}/out")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of its files; times are taken as UTC."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


_SESSION = f"p AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, event_id, event_type, value FROM events), {sql_clusters('c', 'p', 'true', gap=10 * HOUR, least=1)}"


@query(f'WITH {_SESSION} SELECT user_id, round(start, 3) AS start, round("end", 3) AS "end", n FROM c')
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Session windows over the event stream (W06 as a stream)."""
    out = _drained(stream.sessions(_events(spark, d), "user_id", "ts", "10 hours", "1 hour"), _folder(spark, "sessions"), "complete")
    sec = lambda c: F.round(F.unix_micros(c) / 1e6, 3)
    return out.select("user_id", sec("start").alias("start"), sec("end").alias("end"), "n")


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) // 1000000 AS start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows over the event stream (W21 as a stream)."""
    out = _drained(stream.tumbling(_events(spark, d), "event_type", "ts", "1 day", "1 hour"), _folder(spark, "windows"), "complete")
    return out.select("event_type", F.unix_seconds("start").alias("start"), "n")


_STREAM = """p AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, event_id, event_type, value FROM events), q AS (SELECT *, event_type = 'purchase' AND value >= 40 AS hard, event_type = 'click' AND value >= 20 AS start_support, event_type = 'view' AS continuity, event_type = 'error' AND value >= 25 AS end_support,
false AS opening_only, false AS audio_only, false AS scene_only, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM p)"""
_HOURS = fsm.Limits(**{n: getattr(fsm.Limits(), n) * HOUR for n in ("opening_sec", "fresh_sec", "support_sec", "close_sec")})


@query(sql_walk(_STREAM, _HOURS) + ' SELECT user_id, kind, round(os, 3) AS start, round(oe, 3) AS "end", ow AS end_reason FROM w WHERE kind IS NOT NULL')
def stream_fsm(spark: SparkSession, d: str) -> DataFrame:
    """The current machine over the event stream, one state a key (F01 as a stream)."""
    return _walked(spark, d, timed=False)


def _sql_timed(cues: str, lim: fsm.Limits) -> str:
    """The machine by the clock: a row first meets the deadline that lies before it, then the state
    that is left; x_ columns hold what the deadline emits. Deadlines before the last watermark, an
    hour before the last row of all, are met without a row."""
    wait = min(lim.close_sec, lim.fresh_sec)
    until = f"CASE st WHEN 'opening' THEN pt + {lim.opening_sec} WHEN 'closing' THEN pt + {wait} END"
    return f"""WITH RECURSIVE {cues},
w AS (SELECT user_id, 0::BIGINT AS i, 'outside' AS st, NULL::DOUBLE AS a, NULL::DOUBLE AS pt, NULL::BIGINT AS pi, NULL::VARCHAR AS pw, NULL::DOUBLE AS lh, NULL::DOUBLE AS sf, 0 AS sn,
  NULL::VARCHAR AS kind, NULL::DOUBLE AS os, NULL::DOUBLE AS oe, NULL::VARCHAR AS ow, NULL::VARCHAR AS x_kind, NULL::DOUBLE AS x_os, NULL::DOUBLE AS x_oe, NULL::VARCHAR AS x_ow FROM (SELECT DISTINCT user_id FROM q)
UNION ALL
SELECT user_id, i, nst,
  CASE WHEN nst IN ('outside', 'opening') THEN NULL WHEN est = 'outside' THEN t WHEN est = 'opening' THEN pt ELSE a END,
  CASE WHEN nst IN ('opening', 'closing') THEN CASE WHEN est = nst THEN pt ELSE t END END, CASE WHEN nst IN ('opening', 'closing') THEN CASE WHEN est = nst THEN pi ELSE i END END,
  CASE WHEN nst = 'closing' THEN CASE WHEN est = 'closing' THEN pw WHEN end_support THEN 'end support' WHEN t - coalesce(nlh, a) > {lim.fresh_sec} THEN 'freshness' ELSE 'support cap' END END,
  CASE WHEN est = 'closing' AND nst = 'outside' THEN NULL ELSE nlh END, CASE WHEN est = 'closing' AND nst = 'outside' THEN NULL ELSE nsf END, CASE WHEN est = 'closing' AND nst = 'outside' THEN 0 ELSE nsn END,
  CASE WHEN nst <> 'outside' THEN NULL WHEN est = 'closing' THEN 'closed' WHEN est = 'opening' OR opening_only THEN 'review' END,
  CASE est WHEN 'closing' THEN a WHEN 'opening' THEN pt ELSE t END, CASE WHEN est = 'closing' THEN pt ELSE t END,
  CASE WHEN est = 'closing' THEN pw WHEN est = 'opening' AND end_support THEN 'cancelled by end support' WHEN est = 'opening' THEN 'not confirmed in time' ELSE 'opening notice' END,
  CASE WHEN late THEN CASE st WHEN 'closing' THEN 'closed' ELSE 'review' END END, CASE st WHEN 'closing' THEN a ELSE pt END, CASE st WHEN 'closing' THEN pt ELSE pt + {lim.opening_sec} END, CASE st WHEN 'closing' THEN pw ELSE 'not confirmed in time' END
FROM (SELECT *, CASE est
    WHEN 'outside' THEN CASE WHEN opening_only THEN 'outside' WHEN hard THEN 'inside' WHEN start_support AND NOT audio_only AND NOT scene_only THEN 'opening' ELSE 'outside' END
    WHEN 'opening' THEN CASE WHEN hard THEN 'inside' WHEN end_support THEN 'outside' WHEN i - pi + 1 > {lim.opening_rows} THEN 'outside' ELSE 'opening' END
    WHEN 'inside' THEN CASE WHEN (end_support AND NOT hard) OR t - coalesce(nlh, a) > {lim.fresh_sec} OR coalesce(t - nsf > {lim.support_sec} AND nsn > {lim.support_rows}, false) THEN 'closing' ELSE 'inside' END
    ELSE CASE WHEN hard OR (continuity AND NOT end_support) THEN 'inside' WHEN end_support OR t - pt >= {wait} THEN 'outside' ELSE 'closing' END END AS nst
  FROM (SELECT *, CASE WHEN hard THEN t ELSE elh END AS nlh, CASE WHEN hard THEN NULL WHEN start_support OR continuity THEN coalesce(esf, t) ELSE esf END AS nsf, CASE WHEN hard THEN 0 WHEN start_support OR continuity THEN esn + 1 ELSE esn END AS nsn
    FROM (SELECT *, CASE WHEN late THEN 'outside' ELSE st END AS est, CASE WHEN late AND st = 'closing' THEN NULL ELSE lh END AS elh, CASE WHEN late AND st = 'closing' THEN NULL ELSE sf END AS esf, CASE WHEN late AND st = 'closing' THEN 0 ELSE sn END AS esn
      FROM (SELECT w.user_id, w.st, w.a, w.pt, w.pi, w.pw, w.lh, w.sf, w.sn, q.i, q.t, q.hard, q.start_support, q.continuity, q.end_support, q.opening_only, q.audio_only, q.scene_only, coalesce(q.t > {until}, false) AS late FROM w JOIN q ON q.user_id = w.user_id AND q.i = w.i + 1))))),
last AS (SELECT w.* FROM w JOIN (SELECT user_id, max(i) AS i FROM q GROUP BY 1) m ON w.user_id = m.user_id AND w.i = m.i WHERE {until} < (SELECT max(t) - 3600 FROM q)),
e AS (SELECT user_id, kind, os, oe, ow FROM w WHERE kind IS NOT NULL UNION ALL SELECT user_id, x_kind, x_os, x_oe, x_ow FROM w WHERE x_kind IS NOT NULL
UNION ALL SELECT user_id, CASE st WHEN 'closing' THEN 'closed' ELSE 'review' END, CASE st WHEN 'closing' THEN a ELSE pt END, CASE st WHEN 'closing' THEN pt ELSE pt + {lim.opening_sec} END, CASE st WHEN 'closing' THEN pw ELSE 'not confirmed in time' END FROM last)"""


@query(_sql_timed(_STREAM, _HOURS) + ' SELECT user_id, kind, round(os, 3) AS start, round(oe, 3) AS "end", ow AS end_reason FROM e')
def stream_fsm_timed(spark: SparkSession, d: str) -> DataFrame:
    """The machine by the clock: event-time timers end pending starts and ends that no row ends (F01 as a stream)."""
    return _walked(spark, d, timed=True)


def _walked(spark: SparkSession, d: str, timed: bool) -> DataFrame:
    k, v = F.col("event_type"), F.col("value")
    rows = _events(spark, d).select("user_id", "ts", "event_id", ((k == "purchase") & (v >= 40)).alias("hard"), ((k == "click") & (v >= 20)).alias("start_support"), (k == "view").alias("continuity"), ((k == "error") & (v >= 25)).alias("end_support"))
    out = _drained(stream.intervals(rows, "user_id", "ts", "event_id", _HOURS, timed=timed), _folder(spark, "machine"))
    return out.where("kind <> 'open'").select("user_id", "kind", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "end_reason")


@query("SELECT 'csv' AS kind, (SELECT count(*) FROM nation)::BIGINT AS mentions")
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Files by kind, and how often a term occurs in them."""
    path = _folder(spark, "inventory")
    tabular.write_text_table(table(spark, d, "nation"), path, ["n_nationkey", "n_name"])
    kinds = tabular.inventory(spark, f"{path}/*.csv").select("kind").distinct()
    terms = tabular.term_usage(spark, f"{path}/*.csv", ["NATION_"]).agg(F.sum("NATION_").cast("long").alias("mentions"))
    return kinds.crossJoin(terms)  # one row


@query("SELECT s_suppkey, s_acctbal * 2 AS value, 2 AS run_id FROM supplier")
def versioned_output(spark: SparkSession, d: str) -> DataFrame:
    """Runs as partitions of one table, of which the last is read."""
    path = _folder(spark, "runs")
    for run in (1, 2):
        table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") * run).alias("value"), F.lit(run).alias("run_id")).write.mode("append").partitionBy("run_id").parquet(path)
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("run_id").alias("run_id"))
    return rows.join(F.broadcast(last), "run_id").select("s_suppkey", "value", "run_id")  # one row of the last run


def _recorded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors written as WAV bytes and decoded again."""
    for frame in frames:
        rows = []
        for i, x in zip(frame["vec_id"], frame["embedding"], strict=True):
            made = io.BytesIO()
            with wave.open(made, "wb") as w:
                w.setnchannels(1)
                w.setsampwidth(2)
                w.setframerate(16000)
                w.writeframes((x / max(1e-9, np.abs(x).max()) * 32000).astype("<i2").tobytes())
            rows.append({"vec_id": i} | media.wav(made.getvalue(), 0.0, 0.0))
        yield pd.DataFrame(rows, columns=["vec_id", "rate", "duration", "samples"])


@query()
def decoded_media(spark: SparkSession, d: str) -> DataFrame:
    """Samples decoded from WAV bytes, with sound features."""
    made = table(spark, d, "embeddings", "vec_id", "embedding").mapInPandas(_recorded, "vec_id long, rate int, duration double, samples array<float>")
    features = signal.sound_feature_columns(16000, 16, 8)("samples").alias("f")
    return made.select("vec_id", "rate", "duration", features).select("vec_id", "rate", "duration", F.round("f.rms", 4).alias("rms"), "f.onsets")
