"""Relational operators that take and return DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranks import running_counts, with_groups
from ..functions.scalar import micros


def covered_columns(df: DataFrame, share: float) -> list[str]:
    """Columns of which at least this share of rows is not null, by one pass."""
    row = df.agg(*(F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in df.columns)).first()
    return [c for c in df.columns if row[c] is not None and row[c] >= share]


def varying_groups(df: DataFrame, by: str, value: str, least: float = 1e-12) -> DataFrame:
    """Rows of the groups whose value varies."""
    kept = df.groupBy(by).agg(F.stddev_pop(value).alias("_s")).where(F.col("_s") > least).select(by)
    return df.join(kept, by, "left_semi")


def expressed_and_variable(df: DataFrame, by: str, value: str, least_mean: float, quantile: float) -> DataFrame:
    """(by, mean, spread) of the groups with enough mean whose spread is not among the lowest of those."""
    stats = df.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread")).where(F.col("mean") >= least_mean)
    return stats.where(F.col("spread") >= stats.agg(F.percentile("spread", F.lit(quantile))).scalar())


def clear_of(df: DataFrame, others: DataFrame, time: str, seconds: int, by: list[str]) -> DataFrame:
    """Rows with no row of `others` within so many seconds in the same group.

    Both sides are dealt to cells of that length, so the range join is an equi-join on (group, cell) over three cells.
    """
    cell = F.floor(micros(time) / (seconds * 1_000_000)).cast("long")
    near = others.select(*by, micros(time).alias("_o"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    hit = [F.abs(micros(time) - F.col("_o")) <= seconds * 1_000_000]
    own = df.withColumn("_cell", cell).alias("x")
    near = near.select(*(F.col(c).alias(f"_{c}") for c in by), "_o", F.col("_cell").alias("_at"))
    condition = reduce(Column.__and__, [F.col("_cell") == F.col("_at"), *(F.col(c) == F.col(f"_{c}") for c in by), *hit])
    return own.join(near, condition, "left_anti").drop("_cell")


def within_intervals(df: DataFrame, intervals: DataFrame, time: str, start: str, end: str, by: list[str], cell_seconds: int) -> DataFrame:
    """Inner range join of points with [start, end] intervals of the same group, over the cells that an interval covers."""
    size = cell_seconds * 1_000_000
    cell = lambda c: F.floor(micros(c) / size).cast("long")
    spread = intervals.withColumn("_cell", F.explode(F.sequence(cell(start), cell(end))))
    return df.withColumn("_cell", cell(time)).join(spread, [*by, "_cell"]).where(F.col(time).between(F.col(start), F.col(end))).drop("_cell")


def common_keys(tables: list[tuple[DataFrame, str]]) -> DataFrame:
    """(key) of the keys that all tables have."""
    first, name = tables[0]
    out = first.select(F.col(name).alias("key")).distinct()
    for table, name in tables[1:]:
        out = out.join(table.select(F.col(name).alias("key")), "key", "left_semi")
    return out


def paired_delta(df: DataFrame, keys: list[str], arm: str, control: str, value: str) -> DataFrame:
    """(keys, arm, delta) of each arm's value less the control arm's at the same keys."""
    base = df.where(F.col(arm) == control).select(*keys, F.col(value).alias("_base"))
    return df.where(F.col(arm) != control).join(base, keys).withColumn("delta", F.col(value) - F.col("_base"))


def unordered_pairs(df: DataFrame, key: str, block: str) -> DataFrame:
    """(i, j), i < j, of the keys inside each block."""
    a, b = df.select(block, F.col(key).alias("i")), df.select(block, F.col(key).alias("j"))
    return a.join(b, block).where("i < j").select("i", "j")


def permuted(df: DataFrame, key: str, seed: int, by: list[str]) -> DataFrame:
    """Each row with `ghost`, another row's key of its group: the order by key against the order by a seeded hash."""
    def order(first: Column):
        return Window.partitionBy(*by).orderBy(first, key)

    natural = df.withColumn("_r", F.row_number().over(order(F.col(key))))
    hashed = df.select(*(F.col(c).alias(f"_{c}") for c in by), F.col(key).alias("ghost"), F.row_number().over(order(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")))).alias("_q"))
    same = reduce(Column.__and__, [F.col("_r") == F.col("_q"), *(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by)])
    return natural.join(hashed, same).drop("_r", "_q", *(f"_{c}" for c in by))


def remaining_grid(spark: SparkSession, axes: dict[str, list], done: DataFrame) -> DataFrame:
    """The distinct combinations of a driver-sized parameter grid that `done` lacks."""
    kinds = {c: dict(done.dtypes)[c] for c in axes}
    rows = sorted(set(product(*axes.values())))
    grid = spark.createDataFrame(rows, list(axes)).select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()))
    return grid.join(done, list(axes), "left_anti")


def pooled_ratio(df: DataFrame, by: list[str], top: Column, below: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.try_divide(F.sum(top), F.sum(below)).alias("ratio"))


def weighted_mean(df: DataFrame, by: list[str], value: Column, weight: Column) -> DataFrame:
    return pooled_ratio(df, by, value * weight, F.when(value.isNotNull(), weight))


def pool_rare(df: DataFrame, column: str, least: int, other: str = "other") -> DataFrame:
    """The column's values with fewer than `least` rows become `other`; the counts are aggregated before they are joined."""
    rare = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < least).select(F.col(column).alias("_rare"))
    joined = df.join(rare, F.col(column) == F.col("_rare"), "left")
    return joined.withColumn(column, F.when(F.col("_rare").isNotNull(), other).otherwise(F.col(column))).drop("_rare")


def confusion(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 and balanced accuracy; an undefined ratio is null."""
    counts = df.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    recall = F.try_divide(tp, tp + fn)
    return counts.select("*", F.try_divide(tp, tp + fp).alias("precision"), recall.alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), ((recall + F.try_divide(tn, tn + fp)) / 2).alias("balanced"))


def shares(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """`share` of each row in its group's total; equal shares where the total is not positive."""
    grouped = with_groups(df, by, _total=F.sum(value), _n=F.count(F.lit(1)))
    share = F.when(F.col("_total") > 0, F.col(value) / F.col("_total")).otherwise(1 / F.col("_n"))
    return grouped.withColumn("share", share).drop("_total", "_n")


def percentile_against(df: DataFrame, negatives: DataFrame, value: str, key: str) -> DataFrame:
    """(key, pct): the share of the negatives' values below each row's, by running counts over the distinct values of both."""
    both = df.select(value, F.lit(0).cast("long").alias("_n")).unionByName(negatives.select(value, F.lit(1).cast("long").alias("_n")))
    below = running_counts(both, value, {"n": F.col("_n")}).select(value, F.col("n_before"))
    total = negatives.where(F.col(value).isNotNull()).agg(F.count(F.lit(1)).alias("_t"))
    return df.join(below, value).join(F.broadcast(total)).select(key, F.try_divide("n_before", "_t").alias("pct"))


def zscore(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """`z` of each row in its group (sample spread); 0 where the group doesn't vary."""
    grouped = with_groups(df, by, _mean=F.avg(value), _spread=F.stddev_samp(value))
    z = F.try_divide(F.col(value) - F.col("_mean"), F.nullif(F.col("_spread"), F.lit(0.0)))
    return grouped.withColumn("z", F.coalesce(z, F.lit(0.0))).drop("_mean", "_spread")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their `rank`; Spark limits each partition before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def top_share(df: DataFrame, by: list[str], value: str, tie: str, k: int) -> DataFrame:
    """(by, share) of the k largest values in the group's total."""
    tops = top_per_group(df, by, [F.desc(value), F.asc(tie)], k).groupBy(*by).agg(F.sum(value).alias("_top"))
    return df.groupBy(*by).agg(F.sum(value).alias("_all")).join(tops, by, "left").select(*by, F.try_divide("_top", "_all").alias("share"))


def operating_curve(df: DataFrame, order: list[Column], positive: Column, at: list[int]) -> DataFrame:
    """(k, hits, precision, recall) at each k: only the first max(at) rows are ordered on one task."""
    total = df.agg(F.count_if(positive).alias("_total"))
    top = df.withColumn("_y", positive.cast("long")).orderBy(*order).limit(max(at))
    placed = top.withColumn("_r", F.row_number().over(Window.orderBy(*order)))
    ks = df.sparkSession.createDataFrame([(k,) for k in at], "k int")
    hits = placed.join(F.broadcast(ks), F.col("_r") <= F.col("k")).groupBy("k").agg(F.sum("_y").alias("hits"))
    return hits.join(F.broadcast(total)).select("k", "hits", (F.col("hits") / F.col("k")).alias("precision"), F.try_divide("hits", "_total").alias("recall"))


def consensus(df: DataFrame, member: str, methods: int) -> DataFrame:
    """(member, in_how_many, consensus) over the methods' sets."""
    return df.groupBy(member).agg(F.count(F.lit(1)).alias("in_how_many")).withColumn("consensus", F.col("in_how_many") == methods)


def overlap_matrix(df: DataFrame, method: str, member: str) -> DataFrame:
    """(m1, m2, shared, jaccard) of each two methods' sets."""
    sizes = df.groupBy(method).agg(F.count(F.lit(1)).alias("n"))
    pairs = df.select(F.col(method).alias("m1"), member).join(df.select(F.col(method).alias("m2"), member), member).groupBy("m1", "m2").agg(F.count(F.lit(1)).alias("shared"))
    out = pairs.join(sizes.toDF("m1", "_a"), "m1").join(sizes.toDF("m2", "_b"), "m2")
    return out.select("m1", "m2", "shared", (F.col("shared") / (F.col("_a") + F.col("_b") - F.col("shared"))).alias("jaccard"))


def flagged_jaccard(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Jaccard similarity of two flags over the rows; 1 if neither flags any."""
    return df.agg(F.coalesce(F.try_divide(F.count_if(a & b), F.count_if(a | b)), F.lit(1.0)).alias("jaccard"))


def first_of_each(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row with the smallest `order`, by a partial aggregate."""
    rest = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_m")).select(*keys, "_m.*")


def combinations(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Every choice of len(names) keys in rising order."""
    out = df.select(F.col(key).alias(names[0]))
    for before, name in zip(names, names[1:]):
        out = out.join(df.select(F.col(key).alias(name)), F.col(before) < F.col(name))
    return out


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats included: one aggregate over their union."""
    both = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0").isEmpty()


def pivot_fixed(df: DataFrame, by: list[str], column: Column, values: list[str], aggregate: Callable[[Column], Column], value: str) -> DataFrame:
    """One column for each of the given values; no pass to find them."""
    return df.groupBy(*by).agg(*(aggregate(F.when(column == v, F.col(value))).alias(v) for v in values))


def one_hot(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """0/1 columns for the known values; an unknown one is 0 in all."""
    return df.select(*(c for c in df.columns if c != column), *(F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(n) for v, n in names.items()))
