"""Queries of the series, state-space, scan, generator and streaming operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import causal, manifold, scan, series
from ..functions.scalar import micros
from ..operators import relational as R
from ..sources import generators
from ..streaming import windows
from .catalogue import Tables, query

_ORDER = "(PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"""WITH x AS (SELECT event_id, value AS lag0, lag(value, 1) OVER w AS lag1, lag(value, 2) OVER w AS lag2, lead(value, 1) OVER w AS target, row_number() OVER w AS r FROM events WINDOW w AS {_ORDER}) SELECT event_id, lag0, lag1, lag2, target FROM x WHERE r > 2""")
def ts01_delay_embedding(t: Tables) -> DataFrame:
    return series.embed(t.events, ["user_id"], ["ts", "event_id"], "value", 3, 1, 1).select("event_id", "lag0", "lag1", "lag2", "target")


@query(f"SELECT event_id, round(value - prev, 6) AS diff FROM (SELECT event_id, value, lag(value) OVER w AS prev, row_number() OVER w AS r FROM events WINDOW w AS {_ORDER}) WHERE r > 1")
def win08_difference(t: Tables) -> DataFrame:
    return series.difference(t.events, ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("diff", 6).alias("diff"))


@query(f"""WITH p AS (SELECT event_id, user_id, value, row_number() OVER {_ORDER} - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT a.event_id, b.value AS shifted FROM p a JOIN p b ON a.user_id = b.user_id AND a.r = (b.r + 7) % a.n""")
def win11_circular_shift(t: Tables) -> DataFrame:
    return series.circular_shift(t.events, ["user_id"], ["ts", "event_id"], "value", 7).select("event_id", "shifted")


@query(f"""WITH p AS (SELECT event_id, row_number() OVER {_ORDER} - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events), s AS (SELECT event_id, CASE WHEN p < floor(round(n * 0.6, 6)) - 2 THEN 'train' WHEN p >= floor(round(n * 0.6, 6)) AND p < floor(round(n * 0.8, 6)) - 2 THEN 'val' WHEN p >= floor(round(n * 0.8, 6)) THEN 'test' END AS split FROM p) SELECT * FROM s WHERE split IS NOT NULL""")
def ts18_split_with_embargo(t: Tables) -> DataFrame:
    return series.contiguous_split(t.events, ["user_id"], ["ts", "event_id"], 0.6, 0.2, 2).select("event_id", "split")


@query("SELECT event_id, round((value - avg(CASE WHEN event_id % 2 = 0 THEN value END) OVER w) / coalesce(nullif(stddev_pop(CASE WHEN event_id % 2 = 0 THEN value END) OVER w, 0), 1), 6) AS z FROM events WINDOW w AS (PARTITION BY event_type)")
def ts19_train_only_scale(t: Tables) -> DataFrame:
    return series.standardise(t.events, ["event_type"], "value", F.col("event_id") % 2 == 0).select("event_id", F.round("z", 6).alias("z"))


@query(f"""WITH p AS (SELECT user_id, value, row_number() OVER {_ORDER} - 1 AS p FROM events) SELECT user_id, floor(p / 5)::BIGINT AS block, round(avg(value), 6) AS mean FROM p GROUP BY 1, 2 HAVING count(*) = 5""")
def ts13_decimate(t: Tables) -> DataFrame:
    return series.decimate(t.events, ["user_id"], ["ts", "event_id"], "value", 5).select("user_id", "block", F.round("mean", 6).alias("mean"))


@query(f"SELECT event_id FROM (SELECT event_id, row_number() OVER {_ORDER} - 1 AS p FROM events) WHERE p % 4 = 0")
def ts14_stride(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    return t.events.withColumn("p", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).where("p % 4 = 0").select("event_id")


@query("""WITH x AS (SELECT user_id, event_id AS t, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events), y AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN t END) OVER b AS ta, min(CASE WHEN v IS NOT NULL THEN t END) OVER f AS tb FROM x WINDOW b AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT y.t AS event_id, round(coalesce(a.value + (b.value - a.value) * coalesce((y.t - ta) / nullif(tb - ta, 0), 0), a.value, b.value), 6) AS filled FROM y LEFT JOIN events a ON a.event_id = ta LEFT JOIN events b ON b.event_id = tb""")
def ts15_interpolate(t: Tables) -> DataFrame:
    holes = t.events.select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    return series.interpolate(holes, ["user_id"], "event_id", "v").select("event_id", F.round("filled", 6).alias("filled"))


@query("""WITH a AS (SELECT event_id, event_type, value - avg(value) OVER (PARTITION BY event_type, least(dayofyear(ts), 365)) AS a FROM events) SELECT event_id, round(a / (stddev_pop(a) OVER (PARTITION BY event_type) + 1e-6), 6) AS anomaly FROM a""")
def ts16_deseasonalise(t: Tables) -> DataFrame:
    from ..functions.scalar import day_of_year

    return series.deseasonalise(t.events, ["event_type"], day_of_year(F.col("ts")), "value").select("event_id", F.round("anomaly", 6).alias("anomaly"))


_GRID = "SELECT floor(epoch(ts) / 3600)::BIGINT AS t, 'S' AS shaft, user_id % 4 AS c, avg(value) AS v FROM events GROUP BY 1, 2, 3"


def _grid(t: Tables) -> DataFrame:
    hour = F.floor(micros("ts") / 3_600_000_000).cast("long")
    return t.events.groupBy(hour.alias("t"), F.lit("S").alias("shaft"), (F.col("user_id") % 4).alias("c")).agg(F.avg("value").alias("v"))


@query(f"WITH g AS ({_GRID}) SELECT t, c, round(v - avg(v) OVER (PARTITION BY t) + 1e-9, 6) AS referenced FROM g")
def ts17_common_average(t: Tables) -> DataFrame:
    return series.common_average(_grid(t), "t", "v").select("t", "c", F.round(F.col("referenced") + 1e-9, 6).alias("referenced"))


@query(f"WITH g AS ({_GRID}) SELECT a.t, a.c, round(a.v - b.v, 6) AS difference FROM g a JOIN g b ON a.t = b.t AND b.c = a.c + 1")
def ts17_bipolar(t: Tables) -> DataFrame:
    return series.bipolar(_grid(t), "t", "shaft", "c", "v").select("t", "c", F.round("difference", 6).alias("difference"))


@query("""WITH i AS (SELECT user_id, event_id AS around, ts - INTERVAL 30 MINUTE AS a, ts + INTERVAL 30 MINUTE AS b FROM events WHERE event_type = 'error') SELECT e.event_id, i.around FROM events e JOIN i ON e.user_id = i.user_id AND e.ts BETWEEN a AND b""")
def ts20_interval_windows(t: Tables) -> DataFrame:
    around = t.events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("around"), (F.col("ts") - F.expr("INTERVAL 30 MINUTE")).alias("a"), (F.col("ts") + F.expr("INTERVAL 30 MINUTE")).alias("b"))
    return R.within_intervals(t.events, around, "ts", "a", "b", ["user_id"], 1800).select("event_id", "around")


@query(f"""WITH x AS (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS win, lead(value, 2) OVER {_ORDER} AS target FROM events) SELECT event_id, round(list_sum(win), 6) AS total, target FROM x WHERE len(win) = 4 AND target IS NOT NULL""")
def win12_sliding(t: Tables) -> DataFrame:
    out = series.sliding(t.events, ["user_id"], ["ts", "event_id"], "value", 4, 2)
    return out.select("event_id", F.round(F.aggregate("window", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), "target")


@query("""WITH s AS (SELECT user_id, event_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS d, max(value) OVER (PARTITION BY user_id) AS top FROM events)
SELECT user_id, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, max(value) AS best, min(event_id) FILTER (WHERE value = top) AS first_best, round(sum(greatest(d, 0)), 4) AS rise, avg(CASE WHEN d IS NOT NULL THEN (d >= 0)::INT END) AS monotone, avg((value >= 0.95 * top)::INT) AS plateau FROM s GROUP BY 1""")
def win13_curve_statistics(t: Tables) -> DataFrame:
    return series.curve_statistics(t.events, ["user_id"], "event_id", "value").withColumn("rise", F.round("rise", 4))


@query(f"""WITH c AS (SELECT user_id, value - avg(value) OVER (PARTITION BY user_id) AS c, ts, event_id FROM events), m AS (SELECT user_id, c, lag(c, 1) OVER w AS a, lag(c, 2) OVER w AS b FROM c WINDOW w AS {_ORDER}) SELECT user_id, round((abs(sum(c * a) / sum(c * c)) + abs(sum(c * b) / sum(c * c))) / 2, 6) AS mean_abs_acf FROM m GROUP BY 1""")
def sta35_autocorrelation(t: Tables) -> DataFrame:
    return series.autocorrelation(t.events, ["user_id"], ["ts", "event_id"], "value", 2).select("user_id", F.round("mean_abs_acf", 6).alias("mean_abs_acf"))


def hourly(t: Tables) -> DataFrame:
    """(t, channel, value): the number, mean and largest value of each kind of events in each hour, 0 in hours without any."""
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    cells = t.events.where(F.col("ts").isNotNull() & F.col("event_type").isNotNull()).groupBy(hour.alias("t"), "event_type").agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"))
    span = cells.agg(F.min("t").alias("a"), F.max("t").alias("b")).select(F.explode(F.sequence("a", "b")).alias("t"))
    grid = span.join(F.broadcast(cells.select("event_type").distinct()))  # kinds of events: a few
    full = grid.join(cells, ["t", "event_type"], "left").selectExpr("t", "event_type", "stack(3, 'n', n, 'mean', mean, 'most', most) AS (measure, value)")
    return full.select("t", F.concat_ws(":", "event_type", "measure").alias("channel"), F.coalesce("value", F.lit(0.0)).alias("value"))


def paired_hours(t: Tables) -> DataFrame:
    """(system, t, x, y): for each kind of events the hourly numbers and means."""
    kind = F.split("channel", ":")
    wide = hourly(t).where(kind[1] != "most").groupBy(kind[0].alias("system"), "t")
    return wide.agg(F.max(F.when(kind[1] == "n", F.col("value"))).alias("x"), F.max(F.when(kind[1] == "mean", F.col("value"))).alias("y"))


@query()
def ts06_cross_mapping(t: Tables) -> DataFrame:
    return manifold.convergence(manifold.convergent_cross_mapping(paired_hours(t), 2, replicates=4, radius=2))


@query()
def ts08_dominant_direction(t: Tables) -> DataFrame:
    return manifold.dominant_direction(manifold.convergence(manifold.convergent_cross_mapping(paired_hours(t), 2, replicates=4, radius=2)))


@query()
def ts12_surrogate_test(t: Tables) -> DataFrame:
    return manifold.surrogate_test(paired_hours(t), draws=19, dimension=2)


#: What the scan's queries share.
HOURLY_SCAN = scan.ScanConfig(degree=2, ghosts=12, steps=20, code=4)


@query()
def drv_scan(t: Tables) -> DataFrame:
    return scan.scan(hourly(t), HOURLY_SCAN)[0]


@query()
def drv08_gates(t: Tables) -> DataFrame:
    return scan.scan(hourly(t), HOURLY_SCAN)[2]


@query()
def drv10_threshold_rules(t: Tables) -> DataFrame:
    return scan.threshold_rules(scan.scan(hourly(t), HOURLY_SCAN)[1])


@query()
def drv13_membership(t: Tables) -> DataFrame:
    return scan.membership(hourly(t), replace(HOURLY_SCAN, fill="uniform"))


@query()
def drv15_binary_scan(t: Tables) -> DataFrame:
    return scan.scan(hourly(t), replace(HOURLY_SCAN, binary=True))[0]


@query()
def cau01_anm_orientation(t: Tables) -> DataFrame:
    pairs = paired_hours(t).select(F.col("system").alias("pair"), "x", "y")
    return causal.anm_orient(pairs)


@query()
def gen01_nonlinear_roles(t: Tables) -> DataFrame:
    return generators.nonlinear_causes(t.spark, 500, 3)


@query()
def gen06_trial(t: Tables) -> DataFrame:
    return generators.trial(t.spark, 500, 3)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_ext_tumbling(t: Tables) -> DataFrame:
    return windows.tumbling(t.events, "1 hour")


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_ext_sessions(t: Tables) -> DataFrame:
    return windows.sessions(t.events, "30 minutes")
