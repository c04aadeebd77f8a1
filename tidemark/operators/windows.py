"""Window operators on keyed, ordered rows."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def row_rank(key: str | list[str], *order: Column | str) -> Column:
    """1, 2, ... in an order that names its tie-break."""
    return F.row_number().over(Window.partitionBy(key).orderBy(*order))


def average_rank_pct(value: str, key: str | list[str]) -> Column:
    """Average rank of ties over the number of present values, in (0, 1]; missing stays null."""
    ordered = Window.partitionBy(key).orderBy(F.col(value).asc_nulls_last())
    ties = Window.partitionBy(*([key] if isinstance(key, str) else key), value)
    n = F.count(value).over(Window.partitionBy(key))
    return F.when(F.col(value).isNotNull(), (F.rank().over(ordered) + (F.count("*").over(ties) - 1) / 2.0) / n)


def min_rank(value: str, key: str | list[str], ascending: bool = False) -> Column:
    """Standard rank, missing last."""
    by = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    return F.rank().over(Window.partitionBy(key).orderBy(by))


def along(key: str | list[str], *order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(*order)


def step(t: str, w: WindowSpec) -> Column:
    return F.col(t) - F.lag(t).over(w)


def rolling_mean(x: str, w: WindowSpec, radius: int = 1) -> Column:
    return F.avg(x).over(w.rowsBetween(-radius, radius))


def local_peak(x: str, w: WindowSpec, radius: int = 2) -> Column:
    return F.col(x) >= F.max(x).over(w.rowsBetween(-radius, radius))


def nearby_count(key: str, t: str, reach: float, flag: str) -> Column:
    """Rows of a key within reach of t on either side for which the SQL condition holds, the row
    itself included."""
    return F.expr(f"count_if({flag}) OVER (PARTITION BY `{key}` ORDER BY `{t}` RANGE BETWEEN {reach}D PRECEDING AND {reach}D FOLLOWING)")


def with_adaptive_threshold(rows: DataFrame, key: str, x: str, floor: float, sigmas: float = 2.5, q: float = 0.95) -> DataFrame:
    """Adds threshold: the largest of a floor, mean + sigmas * population deviation, and a quantile."""
    facts = rows.groupBy(key).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"), F.percentile(x, F.lit(q)).alias("_q"))
    return rows.join(facts, key).withColumn("threshold", F.greatest(F.lit(float(floor)), F.col("_m") + sigmas * F.col("_s"), F.col("_q"))).drop("_m", "_s", "_q")


def with_mad_threshold(rows: DataFrame, key: str, x: str, mads: float = 3.0, q: float = 0.95) -> DataFrame:
    """Adds mad and threshold: the larger of median + mads * MAD and a quantile."""
    centre = rows.groupBy(key).agg(F.median(x).alias("_m"), F.percentile(x, F.lit(q)).alias("_q"))
    near = rows.join(centre, key)
    spread = near.groupBy(key).agg(F.median(F.abs(F.col(x) - F.col("_m"))).alias("mad"))
    return near.join(spread, key).withColumn("threshold", F.greatest(F.col("_m") + mads * F.col("mad"), F.col("_q"))).drop("_m", "_q")


def with_robust_z(rows: DataFrame, key: str, x: str) -> DataFrame:
    """Adds robust_z: distance from the median by IQR, else by deviation, else by range, else by 1."""
    facts = rows.groupBy(key).agg(
        F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"), F.stddev_samp(x).alias("_sd"), (F.max(x) - F.min(x)).alias("_range")
    )
    iqr = F.nullif(F.col("_q")[2] - F.col("_q")[0], F.lit(0.0))
    scale = F.coalesce(iqr, F.nullif("_sd", F.lit(0.0)), F.nullif("_range", F.lit(0.0)), F.lit(1.0))
    return rows.join(facts, key).withColumn("robust_z", (F.col(x) - F.col("_q")[1]) / scale).drop("_q", "_sd", "_range")


class _Ordered:
    """Values in order, in blocks of at most 1,024: adding, removing and finding the k-th cost one
    block's work and a step a block. Values that are no number stand after all others."""

    def __init__(self) -> None:
        self.blocks: list[list[float]] = []
        self.tops: list[float] = []
        self.n = self.odd = 0

    def add(self, x: float) -> None:
        self.n += 1
        if x != x:
            self.odd += 1
            return
        if not self.blocks:
            self.blocks, self.tops = [[x]], [x]
            return
        i = min(bisect_left(self.tops, x), len(self.tops) - 1)
        block = self.blocks[i]
        insort(block, x)
        if len(block) > 1024:
            self.blocks.insert(i + 1, block[512:])
            self.tops.insert(i + 1, block[-1])
            del block[512:]
        self.tops[i] = block[-1]

    def remove(self, x: float) -> None:
        self.n -= 1
        if x != x:
            self.odd -= 1
            return
        i = bisect_left(self.tops, x)
        block = self.blocks[i]
        del block[bisect_left(block, x)]
        if block:
            self.tops[i] = block[-1]
        else:
            del self.blocks[i], self.tops[i]

    def at(self, k: int) -> float:
        for block in self.blocks:
            if k < len(block):
                return block[k]
            k -= len(block)
        return float("nan")

    def median(self) -> float | None:
        if not self.n:
            return None
        low, high = self.at((self.n - 1) // 2), self.at(self.n // 2)
        return low if low == high else low * 0.5 + high * 0.5


class _Centres:
    """Medians of the neighbours of each time of one cell, as rows come in order of time. Held are
    the rows within reach of the time whose neighbours are not all there yet."""

    def __init__(self, reach: float) -> None:
        self.reach, self.values = reach, _Ordered()
        self.past: deque = deque()
        self.ahead: deque = deque()
        self.made: list[tuple[float, float | None]] = []

    def feed(self, t: float, x: float | None, own: bool) -> None:
        while self.ahead and t - self.ahead[0][0] > self.reach:
            self.centre()
        self.ahead.append((t, x, own))
        if x is not None:
            self.values.add(x)

    def centre(self) -> None:
        """The earliest time of those ahead has all its neighbours."""
        t, same = self.ahead[0][0], []
        while self.ahead and self.ahead[0][0] == t:
            same.append(self.ahead.popleft())
        while self.past and t - self.past[0][0] > self.reach:
            x = self.past.popleft()[1]
            if x is not None:
                self.values.remove(x)
        if any(own for _, _, own in same):
            here = [x for _, x, _ in same if x is not None]
            for x in here:
                self.values.remove(x)
            self.made.append((t, self.values.median()))
            for x in here:
                self.values.add(x)
        self.past.extend(same)

    def end(self) -> None:
        while self.ahead:
            self.centre()


def context_shift(rows: DataFrame, key: str, t: str, x: str, reach: float, width: int = 16) -> DataFrame:
    """Adds shift: distance from the median of the key's rows of other times within reach.

    A key is cut into cells of `width` reaches; rows near a cell's border are copied to the cell
    beside it, so the cells of one key spread over tasks. A cell's rows stream by in order of time
    past an ordered set of the values within reach: a step costs no pass over the neighbours, and a
    task holds the rows of twice the reach. Missing values are passed over as neighbours; rows
    without a key, a time, a value or neighbours have no shift."""
    size, margin = float(width * reach), 1.001 * reach
    own, near = F.floor(F.col("t") / size), F.sequence(F.floor((F.col("t") - margin) / size), F.floor((F.col("t") + margin) / size))
    there = rows.select(F.col(key).alias("key"), F.col(t).cast("double").alias("t"), F.col(x).cast("double").alias("x")).where(F.col("key").isNotNull() & (F.abs("t") < float("inf")))
    ready = there.withColumn("cell", F.explode(near)).withColumn("own", F.col("cell") == own).select("key", "cell", "t", "x", "own")
    ready = ready.repartition("key", "cell").sortWithinPartitions("key", "cell", "t")
    kind = dict(ready.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, walk = None, _Centres(reach)
        for batch in batches:
            keys, times, middles = [], [], []

            def drain() -> None:
                keys.extend([cell[0]] * len(walk.made))  # noqa: B023
                times.extend(at for at, _ in walk.made)  # noqa: B023
                middles.extend(m for _, m in walk.made)  # noqa: B023
                walk.made = []  # noqa: B023

            for k, c, at, value, mine in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if cell != (k, c):
                    if cell is not None:
                        walk.end()
                        drain()
                    cell, walk = (k, c), _Centres(reach)
                walk.feed(at, value, mine)
            drain()
            types = batch.schema.field(0).type
            yield pa.record_batch([pa.array(keys, types), pa.array(times, pa.float64()), pa.array(middles, pa.float64())], names=["_key", "_t", "_m"])
        if cell is not None:
            walk.end()
            yield pa.record_batch([pa.array([cell[0]] * len(walk.made), types), pa.array([at for at, _ in walk.made], pa.float64()), pa.array([m for _, m in walk.made], pa.float64())], names=["_key", "_t", "_m"])

    centre = ready.mapInArrow(run, f"_key {kind}, _t double, _m double")
    return rows.join(centre, (F.col(key) == F.col("_key")) & (F.col(t) == F.col("_t")), "left").withColumn("shift", F.abs(F.col(x) - F.col("_m"))).drop("_key", "_t", "_m")


def true_runs(rows: DataFrame, key: str, t: str, flag: str, broken: Column | None = None) -> DataFrame:
    """(key, run_no, n, start, end) of runs of consecutive true flags; broken marks rows that
    start a new run although the row before is true."""
    w = along(key, t)
    fresh = (~F.col(flag)) | F.coalesce(~F.lag(flag).over(w), F.lit(True))
    if broken is not None:
        fresh = fresh | F.coalesce(broken, F.lit(False))
    marked = rows.withColumn("_f", F.when(fresh, 1).otherwise(0)).withColumn("run_no", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where(F.col(flag)).groupBy(key, "run_no").agg(F.count("*").alias("n"), F.min(t).alias("start"), F.max(t).alias("end"))


def slope(y: str, x: str) -> Column:
    return F.regr_slope(y, x)


def consistency(x: str) -> Column:
    """1 less the deviation by the absolute median, at least 0; null where the median is 0."""
    return 1.0 - F.least(F.lit(1.0), F.stddev_pop(x) / F.nullif(F.abs(F.median(x)), F.lit(0.0)))


def grid(spans: DataFrame, duration: str, width: float) -> DataFrame:
    """Windows of one width over [0, duration), the last one cut short."""
    n = F.ceil(F.col(duration) / width).cast("int")
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    out = spans.withColumn("window_index", at).withColumn("window_start", F.col("window_index") * width)
    out = out.withColumn("window_end", F.least(F.col("window_start") + width, F.col(duration)))
    return out.withColumn("is_partial", F.col("window_end") - F.col("window_start") < width)


def offsets_around(anchors: DataFrame, t: str, offsets: list[float]) -> DataFrame:
    """A row for each sampling offset around each anchor."""
    return anchors.withColumn("offset", F.explode(F.array(*[F.lit(float(o)) for o in offsets]))).withColumn("sample_t", F.col(t) + F.col("offset"))


def cuts_of(x: str, buckets: int, accuracy: int) -> Column:
    """Aggregate: the cuts between buckets of about equal count, and each 16th of them."""
    cuts = F.percentile_approx(x, F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), F.lit(accuracy))
    return F.struct(cuts.alias("each"), F.filter(cuts, lambda _, i: i % 16 == 15).alias("coarse"))


def with_bucket(rows: DataFrame, x: str, cuts: str) -> DataFrame:
    """Adds _bucket, the number of cuts below x, by the coarse ones and 16 of the others."""
    below = lambda of: F.size(F.filter(of, lambda c: c < F.col(x)))
    rows = rows.withColumn("_coarse", below(F.col(f"{cuts}.coarse")))
    fine = below(F.slice(F.col(f"{cuts}.each"), F.col("_coarse") * 16 + 1, F.lit(16)))
    return rows.withColumn("_bucket", F.col("_coarse") * 16 + fine).drop("_coarse", cuts)


def running_sums(rows: DataFrame, x: str, values: list[str], buckets: int = 256) -> DataFrame:
    """Adds run_<v>, the sum of v over all rows up to x (equal ones included), and all_<v>.

    Approximate quantiles, one row of numbers, cut the order into buckets; sums run inside a
    bucket, and the totals of the buckets before, at most buckets + 1 rows, are added. No task
    orders all rows, however many distinct values there are."""
    cuts = rows.agg(cuts_of(x, buckets, 10000).alias("_cuts"))
    placed = with_bucket(rows.crossJoin(F.broadcast(cuts)), x, "_cuts")  # one row
    inside = Window.partitionBy("_bucket").orderBy(x).rangeBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_bucket").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    totals = totals.select("_bucket", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in values], *[F.sum(f"_t_{v}").over(Window.partitionBy()).alias(f"all_{v}") for v in values])
    out = placed.select("*", *[F.sum(v).over(inside).alias(f"_r_{v}") for v in values]).join(totals, "_bucket")
    for v in values:
        out = out.withColumn(f"run_{v}", F.col(f"_r_{v}") + F.col(f"_b_{v}")).drop(f"_r_{v}", f"_b_{v}")
    return out.drop("_bucket")
