"""Queries against their SQL on small tables of their own, where the given ones have no such row."""

from __future__ import annotations

import math
import random
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import duckdb
from helpers import duck_rows, rows_of
from pyspark.sql import functions as F

from tidemark.operators import stats
from tidemark.plans import all_queries, all_sql
from tidemark.sources import books


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables made of (schema, rows)."""
    con = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return rows_of(all_queries()[name](spark, str(folder))), duck_rows(con, all_sql()[name])


def test_longest_text_weighs_conversations_beyond_a_thousand_against_length(spark, tmp_path):
    rows = [(5, 0, "user", "x" * 40), (2100, 3, "user", "y" * 39), (900, 7, "user", "z" * 39), (6, 101, "system", "a"), (7, 1, "system", "b"), (3, 0, "tool", None), (4, 0, "tool", ""), (None, 0, "odd", "long"), (1, None, "odd", "longer"), (1, 0, None, "none")]
    got, want = both(spark, tmp_path, "longest_text", conversations=("conv_id long, turn long, role string, text string", rows))
    assert got == want and len(got[1]) == 5


def test_workbook_labels_read_clocks_before_zero(spark, tmp_path):
    # Book 1 writes clocks; orders by 7200 start within five seconds of zero and, by 13, end five before.
    near = [k for k in range(5000, 200_000) if k // 5000 % 3 == 1 and k % 13 == 0 and k * 37 % 7200 < 5]
    rows = [(k, "2-HIGH") for k in [*near, 5, 13, 5001, 5002, 10_003]]
    got, want = both(spark, tmp_path, "workbook_labels", orders=("o_orderkey long, o_orderpriority string", rows))
    assert got == want
    ends = got[0].index("end_sec")
    assert sum(r[ends] == "-60.0" for r in got[1]) >= 2


def test_only_signed_clocks_stand_before_zero(spark):
    cases = {"-1:59": (-60.0, None), "-2:05": (-120.0, None), "1:05": (65.0, None), "-9": (-9.0, "combined_numeric_assumed_seconds"), "-1:02:03": (-1.0, "combined_numeric_assumed_seconds"), "-1분 59 sec": (119.0, None)}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    read = lambda signed: {r.t: (r.v, r.w) for c in [books.combined_seconds(F.col("t"), signed)] for r in rows.select("t", c[0].alias("v"), c[1].alias("w")).collect()}
    assert read(True) == cases
    assert read(False) == cases | {"-1:59": (-1.0, "combined_numeric_assumed_seconds"), "-2:05": (-2.0, "combined_numeric_assumed_seconds")}


def test_front_of_suppliers_rounds_half_cents_alike_in_any_order(spark, tmp_path):
    # Two suppliers of the same lines in two orders: their exact revenue ends in half a cent, their sums of doubles differ.
    rng = random.Random(11)
    while True:
        lines = [(rng.randrange(90_000, 10_000_000) / 100, rng.randrange(11) / 100) for _ in range(600)]
        exact = sum(Decimal(str(p)) * (1 - Decimal(str(c))) for p, c in lines)
        sums = [reduce(lambda s, r: s + r[0] * (1 - r[1]), order, 0.0) for order in (lines, lines[::-1])]
        if exact * 1000 % 10 == 5 and len({Decimal(repr(s)).quantize(Decimal("0.01"), ROUND_HALF_UP) for s in sums}) == 2:
            break
    rows = [(k, p, c, 1.0, 0.0) for k, order in ((1, lines), (2, lines[::-1])) for p, c in order] + [(3, 1.0, 0.1, 1.0, 0.0)]
    schema = "l_suppkey long, l_extendedprice double, l_discount double, l_quantity double, l_tax double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_suppkey: r.revenue for r in all_queries()["objective_pareto"](spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys((1, 2), float(exact.quantize(Decimal("0.01"), ROUND_HALF_UP)))


def test_exact_sums_of_odd_values(spark):
    groups = {"order": [1e8, 0.1, 0.2, -1e8, -0.3], "null": [None, 2.5, None], "none": [None], "nan": [1.0, float("nan")], "inf": [1.0, float("inf")], "huge": [1e300, 1.0], "below": [-0.25, -1.75, -1e-9], "tenths": [0.1] * 10}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r.k: (r.s, r.m) for r in rows.repartition(5).groupBy("k").agg(stats.exact_sum(F.col("v"), 8).alias("s"), stats.exact_mean(F.col("v"), 8).alias("m")).collect()}
    assert all(math.isnan(v) for v in got.pop("nan"))
    assert got == {"order": (0.0, 0.0), "null": (2.5, 2.5), "none": (None, None), "inf": (math.inf, math.inf), "huge": (1e300, 5e299), "below": (-2.0, -2.0 / 3), "tenths": (1.0, 0.1)}
