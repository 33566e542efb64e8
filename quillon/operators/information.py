"""Mutual information by nearest neighbours, nulls drawn from pools by position, and split-half floors; no order is held by one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import BROADCAST_ROWS, running_counts
from ..storage import settled

#: Euler's constant. Fixed value.
EULER = 0.5772156649015329


def numbered(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """df with each row's place from 0 in the order of these columns: a distributed sort, places inside partitions, and the partitions' offsets."""
    rows = settled(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # a row for each partition
    start = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_start"))
    return rows.join(F.broadcast(start), part == F.col("_p")).withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_start", "_at")


def digamma(n: Column) -> Column:
    """The digamma function at whole numbers from 1: harmonic sums up to 9, beyond it the asymptotic series (error under 1e-12)."""
    n = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(-EULER), lambda s, i: s + F.when(i < n, 1.0 / i).otherwise(0.0))
    series = F.log(n) - 0.5 / n - 1 / (12 * n**2) + 1 / (120 * n**4) - 1 / (252 * n**6) + 1 / (240 * n**8)
    return F.when(n < 10, small).otherwise(series)


#: Positions of a window.
RUN = 1 << 14


def class_information(df: DataFrame, value: str, label: str, k: int = 3) -> DataFrame:
    """(information): nats between a continuous column and a class, by the distance to the k-th nearest value of the same class (Ross 2014).

    A row's radius is that distance, in a class of n rows the (n-1)-th if that is less; the rows strictly within it (where it is 0, at
    it) are counted in the whole column. Rows with a null, and classes of one row, take no part; 0 at least, null without rows.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(label).isNotNull()).select((F.col(value).cast("double") + 0.0).alias("x"), F.col(label).alias("c"))
    cells = settled(rows.groupBy("c", "x").agg(F.count("*").alias("n")))  # equal rows have one radius
    sizes = cells.groupBy("c").agg(F.sum("n").alias("size")).where("size > 1")
    placed = numbered(cells.join(F.broadcast(sizes), "c"), "c", "x")  # classes are few
    # A run of positions meets the k before and after it, so windows are of runs.
    runs = F.array_distinct(F.array(*(F.floor((F.col("position") + j) / RUN) for j in (-k, 0, k))))
    inside = placed.select("*", F.explode(runs).alias("run"))
    order = Window.partitionBy("run").orderBy("position")
    others = [F.lag(F.struct("c", "x", "n"), j).over(order) if j > 0 else F.lead(F.struct("c", "x", "n"), -j).over(order) for j in range(-k, k + 1) if j]
    used = F.least(F.lit(k), F.col("size") - 1).cast("int")
    near = inside.select("*", F.array(*others).alias("other")).where(F.floor(F.col("position") / RUN) == F.col("run"))
    far = F.transform(F.filter("other", lambda o: o["c"] == F.col("c")), lambda o: F.struct(F.abs(F.col("x") - o["x"]).alias("d"), o["n"].alias("n")))
    far = F.array_sort(F.concat(F.array(F.struct(F.lit(0.0).alias("d"), (F.col("n") - 1).alias("n"))), far))
    # The least distance within which there are as many rows as used.
    none = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("d"))
    radius = F.aggregate(far, none, lambda s, o: F.struct((s["seen"] + o["n"]).alias("seen"), F.coalesce(s["d"], F.when(s["seen"] + o["n"] >= F.col("used"), o["d"])).alias("d")))["d"]
    radii = settled(near.withColumn("used", used).select("x", "size", "n", "used", radius.alias("r")))
    radii = radii.withColumn("low", F.col("x") - F.col("r")).withColumn("high", F.col("x") + F.col("r"))
    ends = radii.select(F.col("x").alias("v"), "n").unionByName(radii.select(F.explode(F.array("low", "high")).alias("v"), F.lit(0).cast("long").alias("n")))
    counts = settled(running_counts(ends, "v", {"held": F.col("n")}))
    above = counts.select(F.col("v").alias("high"), F.col("held_before").alias("below_high"))
    below = counts.select(F.col("v").alias("low"), (F.col("held_before") + F.col("held")).alias("to_low"), F.col("held").alias("at"))
    within = F.when(F.col("r") == 0, F.col("at")).otherwise(F.col("below_high") - F.col("to_low"))
    terms = radii.join(above, "high").join(below, "low").select("n", "used", "size", within.alias("m"))
    mean = lambda c: F.try_divide(F.sum(F.col("n") * digamma(F.col(c))), F.sum("n"))
    total = terms.agg(F.sum("n").alias("n"), mean("used").alias("a"), mean("size").alias("b"), mean("m").alias("d"))
    return total.select(F.when(F.col("n") > 0, F.greatest(F.lit(0.0), digamma(F.col("n")) + F.col("a") - F.col("b") - F.col("d"))).alias("information"))


def plug_in_information(df: DataFrame, value: str, label: str) -> DataFrame:
    """(information): nats between two discrete columns by their frequencies; rows with a null take no part."""
    cells = settled(df.where(F.col(value).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(value).alias("x"), F.col(label).alias("c")).agg(F.count("*").alias("n")))
    by_x, by_c = cells.groupBy("x").agg(F.sum("n").alias("nx")), cells.groupBy("c").agg(F.sum("n").alias("nc"))
    joined = cells.join(by_x, "x").join(by_c, "c").join(F.broadcast(cells.agg(F.sum("n").alias("total"))))
    share = F.col("n") / F.col("total")
    return joined.agg(F.greatest(F.lit(0.0), F.sum(share * F.log(F.col("n") * F.col("total") / (F.col("nx") * F.col("nc"))))).alias("information"))


def typed_information(df: DataFrame, columns: list[str], label: str, k: int = 3, discrete: int = 2) -> DataFrame:
    """(column, kind, information): columns of at most `discrete` values by their frequencies, the others by nearest neighbours."""
    distinct = df.agg(*(F.count_distinct(c).alias(str(i)) for i, c in enumerate(columns))).first()
    out = None
    for i, c in enumerate(columns):
        exact = distinct[i] <= discrete
        row = (plug_in_information(df, c, label) if exact else class_information(df, c, label, k)).select(F.lit(c).alias("column"), F.lit("discrete" if exact else "continuous").alias("kind"), "information")
        out = row if out is None else out.unionByName(row)
    return out


def hashed(*parts: Column) -> Column:
    """The first 32 bits of the MD5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("long")


#: Draws of a task.
DRAWS = 1 << 18


def pool_null(rows: DataFrame, draws: int) -> DataFrame:
    """(item, delta, null_mean, p_identity) for rows (id, item, cohort, value) of cohorts 0 and 1: is an item's shift more than its cohorts' pools give?

    delta is the mean of cohort 1 less that of cohort 0. A draw takes as many values from each cohort's pool, with replacement, as the item
    has there: positions in the pool (ordered by value, then id) by MD5 of draw, item, cohort and number. One-sided towards delta's sign;
    items that lack a cohort are left out, null values too.
    """
    valid = rows.where(F.col("value").isNotNull() & F.col("item").isNotNull() & F.col("cohort").isin(0, 1))
    placed = numbered(valid.select("id", "item", "cohort", "value"), "cohort", "value", "id")
    firsts = placed.groupBy("cohort").agg(F.min("position").alias("first"), F.count("*").alias("size"))
    pool = placed.join(F.broadcast(firsts), "cohort").select("cohort", (F.col("position") - F.col("first")).alias("place"), "value")
    seen = settled(valid.groupBy("item", "cohort").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))
    both = seen.groupBy("item").agg(F.max(F.when(F.col("cohort") == 0, F.col("mean"))).alias("a"), F.max(F.when(F.col("cohort") == 1, F.col("mean"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").select("item", (F.col("b") - F.col("a")).alias("delta"))
    # Each row makes the draws of its own number among its item's and cohort's, so a large item's draws are spread over all tasks.
    own = numbered(valid.select("id", "item", "cohort"), "item", "cohort", "id")
    starts = settled(own.groupBy("item", "cohort").agg(F.min("position").alias("start"), F.count("*").alias("n")))
    tasks = (starts.agg(F.sum("n")).first()[0] or 0) * draws // DRAWS + 1  # few bytes make many draws
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts
    each = own.repartition(tasks).join(starts, ["item", "cohort"]).join(F.broadcast(firsts.select("cohort", "size")), "cohort")
    each = each.select("item", "cohort", "size", (F.col("position") - F.col("start")).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    place = F.pmod(hashed(F.col("draw"), F.col("item"), F.col("cohort"), F.col("i")), F.col("size"))
    taken = each.select("item", "cohort", "draw", place.alias("place")).join(pool, ["cohort", "place"])
    means = taken.groupBy("item", "draw").agg(F.avg(F.when(F.col("cohort") == 1, F.col("value"))).alias("b"), F.avg(F.when(F.col("cohort") == 0, F.col("value"))).alias("a"))
    beyond = F.when(F.col("delta") < 0, F.col("b") - F.col("a") <= F.col("delta")).otherwise(F.col("b") - F.col("a") >= F.col("delta"))
    return means.join(both, "item").groupBy("item", "delta").agg(F.avg(F.col("b") - F.col("a")).alias("null_mean"), F.avg(beyond.cast("int")).alias("p_identity"))


#: Units up to which all halves are formed (12,870 of 16).
MOST_UNITS = 16


def split_half_floor(rows: DataFrame) -> DataFrame:
    """(item, units, deviation, largest) for rows (item, unit, value): how far the means of two halves of an item's units lie apart.

    Over all choices of half of the units (rounded down), the population deviation and the largest absolute value of the mean of the other
    units' rows less that of the chosen ones'. Items of fewer than 4 units have neither; more than MOST_UNITS units raise.
    """
    sums = rows.where(F.col("value").isNotNull()).groupBy("item", "unit").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    packed = settled(sums.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("unit", "s", "n"))).alias("u")))
    most = packed.agg(F.max(F.size("u"))).first()[0] or 0
    if most > MOST_UNITS:
        raise ValueError(f"{most} units, halves are formed of up to {MOST_UNITS}")
    side = lambda f, bit: f"aggregate(zip_with(u, sequence(0, size(u) - 1), (x, i) -> IF(shiftright(m, i) & 1 = {bit}, x.{f}, 0)), {'0D' if f == 's' else '0L'}, (a, x) -> a + x)"
    halves = packed.withColumn("m", F.explode_outer(F.expr("IF(size(u) >= 4, filter(sequence(0, cast(shiftleft(1, size(u)) - 1 AS INT)), x -> bit_count(x) = size(u) div 2), NULL)")))
    apart = halves.select("item", F.size("u").alias("units"), F.expr(f"try_divide({side('s', 0)}, {side('n', 0)}) - try_divide({side('s', 1)}, {side('n', 1)})").alias("d"))
    return apart.groupBy("item", "units").agg(F.stddev_pop("d").alias("deviation"), F.max(F.abs("d")).alias("largest"))
