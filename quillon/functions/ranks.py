"""The five rank flavours, and distributed ranks for orders without a partition."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settled

# Tables of at most so many rows, counted when stored, are broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 1 << 20


def _window(partition: list[str], order: Column, *ties: str):
    return Window.partitionBy(*partition).orderBy(order, *ties)


def position_rank(partition: list[str], value: str, *ties: str, descending: bool = False) -> Column:
    """Ranks from 1 with ties broken by the named columns."""
    return F.row_number().over(_window(partition, F.desc(value) if descending else F.asc(value), *ties))


def min_rank(partition: list[str], value: str, descending: bool = False) -> Column:
    return F.rank().over(_window(partition, F.desc(value) if descending else F.asc(value)))


def average_rank(partition: list[str], value: str, descending: bool = False) -> Column:
    """Ranks from 1, tied values at their mean rank."""
    return min_rank(partition, value, descending) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, value)) - 1) / 2


def pct_rank(partition: list[str], value: str) -> Column:
    """Average rank over the number of rows."""
    return average_rank(partition, value) / F.count(F.lit(1)).over(Window.partitionBy(*partition))


def running_counts(df: DataFrame, value: str, sums: dict[str, Column], descending: bool = False, per_bucket: int = 1 << 16, by: tuple[str, ...] = (), following: str | None = None) -> DataFrame:
    """One row for each distinct value: sums of columns over it, and `<name>_before`, the sums over all smaller (or larger) values.
    A column `following`, if named, holds the next distinct value (null after the last).

    The order is global, or that of each group of the `by` columns (rows with a null there are left out), but no task sees all values: values
    are summed first, parted at approximate quantiles, cumulated inside a part, and shifted by the sums of earlier parts (one row each).
    """
    present = [F.col(c).isNotNull() for c in (value, *by)]
    for there in present:
        df = df.where(there)
    grouped = df.groupBy(*by, value).agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    parts = grouped.count() // per_bucket + 1
    edges = sorted(set(grouped.approxQuantile(value, [i / parts for i in range(1, parts)], 0.001))) if parts > 1 else []
    if edges:
        cuts = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="_x", outputCol="_cut", handleInvalid="keep")
        part = F.col("_cut").cast("int") * (-1 if descending else 1)
        grouped = cuts.transform(grouped.withColumn("_x", F.col(value).cast("double"))).withColumn("_part", part).drop("_x", "_cut")
    else:
        grouped = grouped.withColumn("_part", F.lit(0))
    order = F.desc(value) if descending else F.asc(value)
    inside = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # One row a part: the window over them holds 1 / per_bucket of the distinct values.
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.max(value) if descending else F.min(value)
    totals = grouped.groupBy(*by, "_part").agg(start.alias("_start"), *(F.sum(k).alias(f"_{k}") for k in sums))
    then = F.lead("_start").over(Window.partitionBy(*by).orderBy("_part"))
    shift = totals.select(*by, "_part", then.alias("_then"), *(F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in sums))
    near = F.lead(value).over(Window.partitionBy(*by, "_part").orderBy(order))
    cumulated = grouped.select("*", *([near.alias("_near")] if following else []), *(F.coalesce(F.sum(k).over(inside), F.lit(0)).alias(f"{k}_before") for k in sums))
    joined = cumulated.join(shift if by or parts > BROADCAST_ROWS else F.broadcast(shift), [*by, "_part"])
    return joined.select(*by, value, *sums, *((F.col(f"{k}_before") + F.col(f"_{k}")).alias(f"{k}_before") for k in sums), *([F.coalesce("_near", "_then").alias(following)] if following else []))


def with_groups(df: DataFrame, by: list[str], **aggregates: Column) -> DataFrame:
    """df with columns of its group's aggregates (null keys are a group). Groups are aggregated before they are joined, so no task holds a whole one."""
    keys = [f"_by{i}" for i in range(len(by))]
    groups = settled(df.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys))).agg(*(a.alias(n) for n, a in aggregates.items())))
    small = groups.count() <= BROADCAST_ROWS
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)))
    return df.join(F.broadcast(groups) if small else groups, same).drop(*keys)


def first_by_hash(df: DataFrame, by: list[str], hashed: Column, tie: str, wanted: Column, sums: dict[str, Column] | None = None, name: str = "chosen", digits: int = 4) -> DataFrame:
    """df with `name`: whether the row is among the first `wanted` of its group, by a hexadecimal hash and then `tie`.

    `wanted` is an expression of the group's `n` (rows) and of the `sums` over it; below 1 it takes none, from n on all. Rows are counted by their hash's first
    digits, and the cut lies in one of a group's 16**digits buckets: only the rows of that bucket are sorted, the others are never shuffled. A null key is a
    group; a null hash sorts first. Rows alike in hash and tie are told apart at will.
    """
    sums = {"n": F.lit(1).cast("long")} | (sums or {})
    keys = [f"_by{i}" for i in range(len(by))]
    rows = df.withColumn("_hash", hashed).withColumn("_bucket", F.coalesce(F.conv(F.substring("_hash", 1, digits), 16, 10).cast("int"), F.lit(-1)))
    counts = rows.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys)), "_bucket").agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    group = Window.partitionBy(*keys)
    upto = F.sum("n").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.select(*keys, "_bucket", F.col("n").alias("_m"), upto.alias("_upto"), *(F.sum(k).over(group).alias(k) for k in sums))
    counts = counts.withColumn("_wanted", F.coalesce(wanted.cast("long"), F.lit(0)))
    # The last bucket that ends at or before the cut, and how many rows of the next one are wanted.
    whole = F.max(F.when(F.col("_upto") <= F.col("_wanted"), F.col("_bucket")))
    taken = F.coalesce(F.max(F.when(F.col("_upto") <= F.col("_wanted"), F.col("_upto"))), F.lit(0))
    following = F.min(F.when(F.col("_upto") > F.col("_wanted"), F.col("_bucket")))
    cuts = settled(counts.groupBy(*keys).agg(F.coalesce(whole, F.lit(-2)).alias("_whole"), following.alias("_edge"), (F.first("_wanted") - taken).alias("_left")))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)), F.lit(True))
    placed = rows.join(F.broadcast(cuts) if cuts.count() <= BROADCAST_ROWS else cuts, same)
    at_edge = (F.col("_bucket") == F.col("_edge")) & (F.col("_left") > 0)
    clear = placed.where(~F.coalesce(at_edge, F.lit(False))).withColumn(name, F.col("_bucket") <= F.col("_whole"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash", tie))
    edge = placed.where(at_edge).withColumn(name, place <= F.col("_left"))
    return clear.unionByName(edge).select(*df.columns, name)
