"""Series operators on long tables (group, time, value); every window names its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def embed(df: DataFrame, by: list[str], order: list[str], value: str, dimension: int, delay: int = 1, ahead: int = 0) -> DataFrame:
    """Delay vectors lag0..lagE-1 (present first) of rows with a whole history, and `target`, `ahead` steps on, if asked for."""
    if dimension < 1 or delay < 1:
        raise ValueError("dimension and delay start at 1")
    w = _w(by, order)
    out = df.select("*", *(F.lag(value, k * delay).over(w).alias(f"lag{k}") for k in range(1, dimension)), F.col(value).alias("lag0"), F.row_number().over(w).alias("_r"), *([F.lead(value, ahead).over(w).alias("target")] if ahead else []))
    return out.where(F.col("_r") > (dimension - 1) * delay).drop("_r")


def difference(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """`diff` to the row before; the first row of a group goes."""
    w = _w(by, order)
    return df.select("*", (F.col(value) - F.lag(value).over(w)).alias("diff"), F.row_number().over(w).alias("_r")).where("_r > 1").drop("_r")


def circular_shift(df: DataFrame, by: list[str], order: list[str], value: str, shift: int) -> DataFrame:
    """`shifted`: the value `shift` rows earlier, the series taken as a ring."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    placed = df.withColumn("_r", F.row_number().over(_w(by, order)) - 1)
    ring = placed.select(*by, F.col(value).alias("shifted"), F.pmod(F.col("_r") + shift, n).cast("int").alias("_r"))
    return placed.join(ring, [*by, "_r"]).drop("_r")


def contiguous_split(df: DataFrame, by: list[str], order: list[str], train: float, val: float, embargo: int = 0) -> DataFrame:
    """`split` in time order; the last `embargo` rows before each seam go."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    placed = df.withColumn("_p", F.row_number().over(_w(by, order)) - 1).withColumn("_n", n)
    a, b, p = F.floor(F.round(F.col("_n") * train, 6)), F.floor(F.round(F.col("_n") * (train + val), 6)), F.col("_p")
    split = F.when(p < a - embargo, "train").when((p >= a) & (p < b - embargo), "val").when(p >= b, "test")
    return placed.withColumn("split", split).drop("_p", "_n").where(F.col("split").isNotNull())


def standardise(df: DataFrame, by: list[str], value: str, train: Column) -> DataFrame:
    """`z` by the training rows' mean and population spread; a spread of 0 counts as 1."""
    w = Window.partitionBy(*by)
    own = F.when(train, F.col(value))
    spread = F.stddev_pop(own).over(w)
    return df.withColumn("z", (F.col(value) - F.avg(own).over(w)) / F.when(spread > 0, spread).otherwise(1.0))


def decimate(df: DataFrame, by: list[str], order: list[str], value: str, factor: int) -> DataFrame:
    """(by, block, mean) of runs of `factor` rows; the unfinished last run goes."""
    placed = df.withColumn("_p", F.row_number().over(_w(by, order)) - 1)
    out = placed.groupBy(*by, F.floor(F.col("_p") / factor).alias("block")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("_n"))
    return out.where(F.col("_n") == factor).drop("_n")


def interpolate(df: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """`filled`: linear between the nearest known values, those at the ends carried outward."""
    back = _w(by, [time]).rowsBetween(Window.unboundedPreceding, 0)
    on = _w(by, [time]).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(time).cast("double").alias("t"), F.col(value).alias("v")))
    out = df.withColumn("_a", F.last(known, True).over(back)).withColumn("_b", F.first(known, True).over(on))
    step = F.try_divide(F.col(time).cast("double") - F.col("_a.t"), F.col("_b.t") - F.col("_a.t"))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * F.coalesce(step, F.lit(0.0))
    return out.withColumn("filled", F.coalesce(line, F.col("_a.v"), F.col("_b.v"))).drop("_a", "_b")


def deseasonalise(df: DataFrame, by: list[str], season: Column, value: str) -> DataFrame:
    """`anomaly`: the value less its season's mean, over the group's spread of that plus 1e-6."""
    out = df.withColumn("_s", season)
    out = out.withColumn("_a", F.col(value) - F.avg(value).over(Window.partitionBy(*by, "_s")))
    return out.withColumn("anomaly", F.col("_a") / (F.stddev_pop("_a").over(Window.partitionBy(*by)) + 1e-6)).drop("_s", "_a")


def common_average(df: DataFrame, time: str, value: str) -> DataFrame:
    """`referenced`: the value less the mean over channels at its time."""
    return df.withColumn("referenced", F.col(value) - F.avg(value).over(Window.partitionBy(time)))


def bipolar(df: DataFrame, time: str, shaft: str, contact: str, value: str, step: int = 1) -> DataFrame:
    """(time, shaft, contact, difference) to the contact `step` further on the same shaft."""
    other = df.select(time, shaft, (F.col(contact) - step).alias(contact), F.col(value).alias("_v"))
    return df.join(other, [time, shaft, contact]).select(time, shaft, contact, (F.col(value) - F.col("_v")).alias("difference"))


def laplacian(df: DataFrame, time: str, shaft: str, contact: str, value: str) -> DataFrame:
    """(time, shaft, contact, difference) to the mean of both neighbours on the shaft."""
    around = [df.select(time, shaft, (F.col(contact) + k).alias(contact), F.col(value).alias(n)) for k, n in ((1, "_a"), (-1, "_b"))]
    joined = df.join(around[0], [time, shaft, contact]).join(around[1], [time, shaft, contact])
    return joined.select(time, shaft, contact, (F.col(value) - (F.col("_a") + F.col("_b")) / 2).alias("difference"))


def autocorrelation(df: DataFrame, by: list[str], order: list[str], value: str, lags: int = 5) -> DataFrame:
    """(by, mean_abs_acf) of the centred series over lags 1..lags."""
    centred = df.withColumn("_c", F.col(value) - F.avg(value).over(Window.partitionBy(*by)))
    w = _w(by, order)
    moved = centred.select(*by, "_c", *(F.lag("_c", k).over(w).alias(f"_{k}") for k in range(1, lags + 1)))
    below = F.sum(F.col("_c") * F.col("_c"))
    mean = sum((F.abs(F.try_divide(F.sum(F.col("_c") * F.col(f"_{k}")), below)) for k in range(1, lags + 1)), F.lit(0.0)) / lags
    return moved.groupBy(*by).agg(mean.alias("mean_abs_acf"))


def curve_statistics(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """(by, first, last, best, first_best, rise, monotone, plateau) of a learning curve."""
    w = _w(by, [order])
    top = F.max(value).over(Window.partitionBy(*by))
    steps = df.withColumn("_d", F.col(value) - F.lag(value).over(w)).withColumn("_top", top)
    return steps.groupBy(*by).agg(
        F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.max(value).alias("best"),
        F.min(F.when(F.col(value) == F.col("_top"), F.col(order))).alias("first_best"),
        F.sum(F.greatest("_d", F.lit(0.0))).alias("rise"), F.avg((F.col("_d") >= 0).cast("int")).alias("monotone"),
        F.avg((F.col(value) >= 0.95 * F.col("_top")).cast("int")).alias("plateau"),
    )


def sliding(df: DataFrame, by: list[str], order: list[str], value: str, length: int, horizon: int) -> DataFrame:
    """`window`, the last `length` values, and `target`, `horizon` rows on; rows without either go."""
    w = _w(by, order)
    out = df.withColumn("window", F.collect_list(value).over(w.rowsBetween(1 - length, 0))).withColumn("target", F.lead(value, horizon).over(w))
    return out.where((F.size("window") == length) & F.col("target").isNotNull())
