"""Source queries: media containers, frames and workbooks that tasks write and read back."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import query, table
from tidemark.session import cut, qualified, shared_dir
from tidemark.sources import books, containers, store

#: Vectors of a film, its pictures' width, pictures and samples a second.
FILM, WIDE, FPS, RATE = 64, 8, 25, 8000
#: Kind of film k modulo 4: container, with sound.
KINDS = (("avi", False), ("mp4", True), ("avi", True), ("wav", True))


def _folder(spark: SparkSession, name: str) -> str:
    return qualified(spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")


def _films(spark: SparkSession, d: str) -> str:
    """Vectors as pictures of films (or sound), a file for each 64 ids, written by tasks."""
    folder = _folder(spark, "films")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        film = int(frame["film"].iloc[0])
        kind, sound = KINDS[film % 4]
        values = [np.asarray(x, dtype=np.float64) for x in frame.sort_values("vec_id")["embedding"]]
        pictures = [np.floor(np.clip((x + 1) * 127.5, 0, 255)).reshape(-1, WIDE) for x in values]
        rate = RATE if sound else 0
        if kind == "wav":
            content = containers.wav_file(np.concatenate(values) * 32000, RATE)
        elif kind == "mp4":
            content = containers.mp4_file(pictures, FPS, rate)
        else:
            content = containers.avi_file(pictures, FPS, rate, index=film % 8 != 4)
        store.put(f"{folder}/film-{film:08d}.{kind}", content)
        return pd.DataFrame({"film": [film]})

    rows = table(spark, d, "embeddings", "vec_id", "embedding").withColumn("film", F.floor(F.col("vec_id") / FILM))
    rows.groupBy("film").applyInPandas(run, "film long").write.format("noop").mode("overwrite").save()
    return folder


def _film(path: str | Column = "path") -> Column:
    return F.regexp_extract(path, r"film-(\d+)", 1).cast("long").alias("film")


_FILMS = f"g AS (SELECT vec_id // {FILM} AS film, count(*) AS n, (vec_id // {FILM}) % 4 AS kind, any_value(len(embedding)) AS dim FROM embeddings GROUP BY ALL)"


@query(
    f"""WITH {_FILMS} SELECT film, CASE kind WHEN 1 THEN 'mp4' WHEN 3 THEN 'wav' ELSE 'avi' END AS container, 'ok' AS status,
round(CASE WHEN kind = 3 THEN n * dim / {RATE}.0 ELSE n / {FPS}.0 END, 6) AS duration, CASE WHEN kind <> 3 THEN {FPS}.0::DOUBLE END AS fps, CASE WHEN kind <> 3 THEN n END AS frame_count,
CASE WHEN kind <> 3 THEN {WIDE} END::INTEGER AS width, CASE WHEN kind <> 3 THEN dim // {WIDE} END::INTEGER AS height, CASE WHEN kind <> 3 THEN 'rawvideo' END AS video_codec, kind <> 0 AS has_audio,
CASE kind WHEN 0 THEN NULL WHEN 1 THEN 'sowt' ELSE 'pcm' END AS audio_codec, CASE WHEN kind <> 0 THEN {RATE}.0::DOUBLE END AS audio_rate, CASE WHEN kind <> 0 THEN 1 END::INTEGER AS channels, true AS valid,
CASE kind WHEN 0 THEN 'audio_stream_missing' WHEN 3 THEN 'fps_zero_or_missing;frame_count_zero_or_missing' ELSE '' END AS warning FROM g"""
)
def container_probe(spark: SparkSession, d: str) -> DataFrame:
    """Headers of films and sounds made of vectors."""
    probe = containers.load(spark, containers.MediaProbe, _films(spark, d))
    return probe.select(_film(), "container", "status", F.round("duration", 6).alias("duration"), F.round("fps", 6).alias("fps"), "frame_count", "width", "height", "video_codec", "has_audio", "audio_codec", "audio_rate", "channels", "valid", "warning")


@query(
    f"""WITH p AS (SELECT vec_id // {FILM} AS film, row_number() OVER (PARTITION BY vec_id // {FILM} ORDER BY vec_id) - 1 AS frame, list_sum(list_transform(embedding::DOUBLE[], lambda x: floor(least(255, greatest(0, (x + 1) * 127.5)))))::BIGINT AS luma FROM embeddings)
SELECT film, frame, luma, luma AS by_frame, luma AS by_msec FROM p WHERE film % 4 <> 3"""
)
def frame_reads(spark: SparkSession, d: str) -> DataFrame:
    """Every picture in sequence, by its number and by its time, with the sum of its pixels each way."""
    folder = _films(spark, d)
    probe, index = containers.load(spark, containers.MediaProbe, folder), containers.load(spark, containers.FrameIndex, folder)
    light = F.expr("aggregate(sequence(1, length(pixels)), 0L, (a, k) -> a + conv(hex(substring(pixels, k, 1)), 16, 10))")
    sums = lambda f, name: f.select("path", "frame", light.alias(name))
    asked = index.select("path", "msec")
    rows = sums(containers.load(spark, containers.Frames, folder), "luma")
    rows = rows.join(sums(containers.seek_frames(index, index), "by_frame"), ["path", "frame"]).join(sums(containers.seek_msec(index, probe, asked), "by_msec"), ["path", "frame"])
    return rows.select(_film(), "frame", "luma", "by_frame", "by_msec")


#: Orders of a book.
BOOK = 5000
_START = "(o_orderkey * 37 % 7200)"
_LENGTH = "CASE WHEN o_orderkey % 13 = 0 THEN -5 WHEN o_orderkey % 23 = 0 THEN 2 WHEN o_orderkey % 29 = 0 THEN 700 ELSE 20 + o_orderkey % 50 END"


def _books(spark: SparkSession, d: str) -> str:
    """Orders as label books: minutes and seconds apart, clock text, or words, by the book's number;
    the labels stand on the second of three sheets, below two rows of other text."""
    folder = _folder(spark, "books")
    rows = table(spark, d, "orders", "o_orderkey", "o_orderpriority").withColumn("book", F.floor(F.col("o_orderkey") / BOOK))
    rows = rows.withColumn("s", F.expr(_START).cast("long")).withColumn("e", F.expr(f"s + {_LENGTH}").cast("long")).withColumn("kind", F.col("book") % 3)
    minute = lambda c: F.floor(F.col(c) / 60).cast("string")
    second = lambda c: F.pmod(F.col(c), F.lit(60)).cast("string")
    clock = lambda c: F.when(F.col("kind") == 1, F.concat(minute(c), F.lit(":"), F.lpad(second(c), 2, "0"))).otherwise(F.concat(minute(c), F.lit("분 "), second(c), F.lit(" sec")))
    blank = F.col("o_orderkey") % 19 == 0
    title = F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderpriority"))
    abrupt = F.when(F.col("o_orderkey") % 5 == 0, "yes").when(F.col("o_orderkey") % 5 == 1, "maybe").otherwise("no")
    start = lambda c: F.when(F.col("o_orderkey") % 11 != 0, c)
    # Every seventh row of the first kind tells a minute less and sixty seconds more.
    late = F.when((F.col("o_orderkey") % 7 == 0) & (F.col("s") >= 60), 1).otherwise(0)
    apart = F.array(F.col("o_orderkey").cast("string"), title, start((F.floor(F.col("s") / 60) - late).cast("string")), start((F.pmod(F.col("s"), F.lit(60)) + 60 * late).cast("string")), minute("e"), second("e"), abrupt)
    joined = F.array(F.col("o_orderkey").cast("string"), title, start(clock("s")), clock("e"), abrupt)
    cells = F.when(blank, F.array().cast("array<string>")).when(F.col("kind") == 0, apart).otherwise(joined)
    body = rows.select("book", F.lit("labels").alias("sheet"), F.lit(1).alias("sheet_no"), (F.col("o_orderkey") % BOOK + 4).cast("int").alias("row_number"), cells.alias("cells"))
    heads = {0: ["Video ID", "영상 제목", "AD start (min)", "AD start (sec)", "광고 종료 분", "광고 종료 초", "abrupt?", "AD start min sec"], 1: ["video_no", "Title", "AD start time", "AD_END", "전환형"], 2: ["영상번호", "video title", "광고 시작", "광고 종료 시간", "abrupt", "제목", "title"]}
    parts = [body]
    for kind, names in heads.items():
        own = rows.where(F.col("kind") == kind).select("book").distinct()
        # Of the third kind two more columns claim the title, which then maps to none.
        lines = [("notes", 0, 1, ["video id", "remark"]), ("notes", 0, 2, ["1", "checked"]), ("labels", 1, 1, ["Labels of the book"]), ("labels", 1, 2, ["made by hand", None, "x"]), ("labels", 1, 3, names), ("spare", 2, 1, names)]
        made = spark.createDataFrame(lines, "sheet string, sheet_no int, row_number int, cells array<string>")
        parts.append(own.crossJoin(F.broadcast(made)).select("book", "sheet", "sheet_no", "row_number", "cells"))  # six rows
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    books.write_books(whole, folder, "book")
    return folder


def _book() -> Column:
    return F.regexp_extract("path", r"/(\d+)\.xlsx$", 1).cast("long").alias("book")


@query(
    f"""WITH b AS (SELECT DISTINCT o_orderkey // {BOOK} AS book FROM orders), s AS (SELECT book, book % 3 AS kind, u.sheet_no::INTEGER AS sheet_no FROM b, (SELECT unnest([0, 1, 2]) AS sheet_no) u)
SELECT book, sheet_no, ['notes', 'labels', 'spare'][sheet_no + 1] AS sheet, (CASE sheet_no WHEN 1 THEN 3 ELSE 1 END)::INTEGER AS header_row, (CASE WHEN sheet_no = 0 THEN 3 WHEN kind = 2 THEN 10 ELSE 13 END)::INTEGER AS score,
CASE WHEN sheet_no = 0 THEN 'video_id=0' WHEN kind = 0 THEN 'ad_end_min=4,ad_end_sec_part=5,ad_start_min=2,ad_start_sec_part=3,is_abrupt_transition_ad=6,video_id=0,video_title=1'
  WHEN kind = 1 THEN 'ad_end_combined=3,ad_start_combined=2,is_abrupt_transition_ad=4,video_id=0,video_title=1' ELSE 'ad_end_combined=3,ad_start_combined=2,is_abrupt_transition_ad=4,video_id=0' END AS columns,
CASE WHEN sheet_no = 0 OR kind = 1 THEN '' WHEN kind = 0 THEN '7:AD start min sec=ad_start_min|ad_start_sec_part' ELSE 'video_title=1|5|6' END AS ambiguous, sheet_no = 1 AS main FROM s"""
)
def workbook_headers(spark: SparkSession, d: str) -> DataFrame:
    """Header, columns by meaning and unclear headers of every sheet of written books, and which sheet is the main one."""
    found = books.headers(books.read_sheets(spark, _books(spark, d), books.HEADER_ROWS))
    main = books.main_sheets(found).select("path", "sheet_no", F.lit(True).alias("main"))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("columns")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return found.join(main, ["path", "sheet_no"], "left").select(_book(), "sheet_no", "sheet", "header_row", "score", told.alias("columns"), "ambiguous", F.coalesce("main", F.lit(False)).alias("main"))


@query(
    f"""WITH o AS (SELECT o_orderkey, o_orderkey // {BOOK} AS book, (o_orderkey // {BOOK}) % 3 AS kind, o_orderpriority, {_START} AS s, {_START} + {_LENGTH} AS e FROM orders WHERE o_orderkey % 19 <> 0),
r AS (SELECT *, CASE WHEN kind <> 2 AND o_orderkey % 17 <> 0 THEN o_orderpriority ELSE '' END AS title, CASE WHEN o_orderkey % 11 <> 0 THEN s END AS b,
  CASE WHEN e >= 0 THEN e WHEN kind = 0 THEN floor(e / 60.0) * 60 + ((e % 60) + 60) % 60 WHEN kind = 2 THEN abs(floor(e / 60.0)) * 60 + ((e % 60) + 60) % 60 ELSE abs(floor(e / 60.0)) * -60 END AS f FROM o),
q AS (SELECT *, f - b AS length FROM r),
t AS (SELECT *, list_filter([CASE WHEN title = '' THEN 'missing_video_title' END, CASE WHEN b IS NULL THEN 'ad_start_sec_not_numeric' END, CASE WHEN length <= 0 THEN 'ad_end_sec_not_greater_than_ad_start_sec' END, CASE WHEN length <= 0 THEN 'ad_duration_sec_not_positive' END], lambda x: x IS NOT NULL) AS bad,
  list_filter([CASE WHEN kind > 0 AND b IS NULL THEN 'start:blank_time' END, CASE WHEN kind = 0 AND o_orderkey % 7 = 0 AND b >= 60 THEN 'start:second_part_gte_60' END, CASE WHEN length > 0 AND length < 3 THEN 'duration_very_short_lt_3_sec' END, CASE WHEN length > 600 THEN 'duration_very_long_gt_600_sec' END], lambda x: x IS NOT NULL) AS warned FROM q)
SELECT book, (o_orderkey % {BOOK} + 4)::INTEGER AS row_number, 'A' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS ad_interval_id, o_orderkey::VARCHAR AS video_id, title AS video_title, b::DOUBLE AS start_sec, f::DOUBLE AS end_sec, length::DOUBLE AS duration_sec,
CASE o_orderkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'not_reviewed' ELSE 'no' END AS is_abrupt, len(bad) = 0 AS label_valid, array_to_string(list_sort(bad), '; ') AS invalid_reason, array_to_string(list_sort(warned), '; ') AS warnings
FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY o_orderkey) AS k FROM t)"""
)
def workbook_labels(spark: SparkSession, d: str) -> DataFrame:
    """Clean interval labels of the main sheets of written books, clocks signed."""
    folder = _books(spark, d)
    main = cut(books.main_sheets(books.headers(books.read_sheets(spark, folder, books.HEADER_ROWS))))
    labels = books.clean_labels(books.mapped_rows(books.read_sheets(spark, folder), main), signed=True)
    return labels.select(_book(), "row_number", "ad_interval_id", "video_id", "video_title", "start_sec", "end_sec", "duration_sec", "is_abrupt", "label_valid", "invalid_reason", "warnings")
