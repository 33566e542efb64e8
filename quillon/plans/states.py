"""Queries of the pair calibration with bootstrap and of the exact neighbour join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calibration, gains, knn, scan
from .catalogue import Tables, query
from .series import HOURLY_SCAN, hourly, paired_hours

_REPLICATES = 6
_CDF = ", ".join(map(str, calibration.POISSON))
#: Pairs with their bins, and the weight of each pair in each replicate.
_JOINT = f"""WITH v AS (SELECT vec_id AS k, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings),
c AS (SELECT k, list_transform(a, lambda x: x - list_avg(a)) AS a, list_transform(b, lambda x: x - list_avg(b)) AS b FROM v),
p AS (SELECT x.k AS i, y.k AS j, round(least(pow(list_cosine_similarity(x.a, y.a), 2), 0.999999), 9) AS r2, round(list_cosine_similarity(x.b, y.b), 9) AS e FROM c x JOIN c y ON x.k < y.k),
h AS (SELECT i, j, least(greatest(ceil(round(r2 * 20, 9)) - 1, 0), 19)::INT AS r_bin, least(greatest(ceil(round((e + 1.024) / 0.032, 9)) - 1, 0), 63)::INT AS e_bin FROM p),
u AS (SELECT vec_id AS k, r AS replicate, ('0x' || left(md5(r || ':' || vec_id), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM embeddings, range({_REPLICATES + 1}) AS t(r)),
w AS (SELECT k, replicate, CASE WHEN replicate = 0 THEN 1 ELSE len(list_filter([{_CDF}]::DOUBLE[], lambda c: u > c)) END AS w FROM u),
g AS (SELECT a.replicate::INT AS replicate, r_bin, e_bin, sum(a.w * b.w)::DOUBLE AS pairs FROM h JOIN w a ON a.k = h.i JOIN w b ON b.k = h.j AND b.replicate = a.replicate GROUP BY 1, 2, 3),
q AS (SELECT * FROM g WHERE pairs > 0),
s AS (SELECT replicate, r_bin, sum(pairs) AS pairs, coalesce(sum(pairs) FILTER (WHERE -1.024 + 0.016 + e_bin * 0.032 > 0.3), 0) / sum(pairs) AS p_equiv, sum((-1.024 + 0.016 + e_bin * 0.032) * pairs) / sum(pairs) AS mean_e FROM q GROUP BY 1, 2)"""


def _halves(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))


def _joint(t: Tables) -> DataFrame:
    return calibration.joint_histogram(_halves(t), "vec_id", "a", "b", _REPLICATES)


@query(f"{_JOINT} SELECT * FROM q")
def agg20_joint_histogram(t: Tables) -> DataFrame:
    return _joint(t)


@query(f"{_JOINT} SELECT replicate, r_bin, pairs, round(p_equiv, 9) AS p_equiv, round(mean_e, 9) AS mean_e FROM s")
def agg21_calibration_curves(t: Tables) -> DataFrame:
    return calibration.curves(_joint(t), 0.3).select("replicate", "r_bin", "pairs", F.round("p_equiv", 9).alias("p_equiv"), F.round("mean_e", 9).alias("mean_e"))


@query(f"{_JOINT} SELECT r_bin, max(p_equiv) FILTER (WHERE replicate = 0) AS p_equiv, quantile_cont(p_equiv, 0.025) FILTER (WHERE replicate > 0) AS low, quantile_cont(p_equiv, 0.5) FILTER (WHERE replicate > 0) AS mid, quantile_cont(p_equiv, 0.975) FILTER (WHERE replicate > 0) AS high FROM s GROUP BY 1")
def sta10_entity_bootstrap(t: Tables) -> DataFrame:
    return calibration.intervals(calibration.curves(_joint(t), 0.3))


@query(f"""{_JOINT}, e AS (SELECT replicate, sum(pairs * p_equiv) / sum(pairs) AS base, sum(pairs * p_equiv) FILTER (WHERE r_bin BETWEEN 2 AND 4) / sum(pairs) FILTER (WHERE r_bin BETWEEN 2 AND 4) AS ceiling FROM s GROUP BY 1),
l AS (SELECT replicate, 'base' AS quantity, base AS value FROM e UNION ALL SELECT replicate, 'ceiling', ceiling FROM e UNION ALL SELECT replicate, 'lift', ceiling / base FROM e)
SELECT quantity, max(value) FILTER (WHERE replicate = 0) AS observed, quantile_cont(value, 0.025) FILTER (WHERE replicate > 0) AS low, quantile_cont(value, 0.5) FILTER (WHERE replicate > 0) AS mid, quantile_cont(value, 0.975) FILTER (WHERE replicate > 0) AS high FROM l GROUP BY 1""")
def agg06_lift_interval(t: Tables) -> DataFrame:
    return calibration.headline(calibration.curves(_joint(t), 0.3), 2, 4)


#: Hourly numbers (x) and means (y) of each kind of events, 0 in hours without any.
_HOURS = """WITH c AS (SELECT epoch_us(ts) // 3600000000 AS t, event_type AS system, count(*)::DOUBLE AS x, avg(value) AS y FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2),
g AS (SELECT t, system FROM (SELECT unnest(range(min(t), max(t) + 1)) AS t FROM c), (SELECT DISTINCT system FROM c)),
h AS (SELECT g.system, g.t, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM g LEFT JOIN c ON c.t = g.t AND c.system = g.system)"""
#: Delays of the numbers, and the four nearest of each, more than 24 hours away.
_NEAR = """d AS (SELECT system, t, [v, lag(v, 1) OVER w, lag(v, 2) OVER w] AS state, lag(v, 2) OVER w AS last FROM b WINDOW w AS (PARTITION BY system ORDER BY t)),
n AS (SELECT p.system, p.t, q.t AS neighbour, round(sqrt(pow(p.state[1] - q.state[1], 2) + pow(p.state[2] - q.state[2], 2) + pow(p.state[3] - q.state[3], 2)), 9) AS distance FROM d p JOIN d q ON p.system = q.system AND abs(p.t - q.t) > 24 WHERE p.last IS NOT NULL AND q.last IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY system, t ORDER BY distance, neighbour) AS rank FROM n QUALIFY rank <= 4)"""


@query(f"{_HOURS}, b AS (SELECT system, t, x AS v FROM h), {_NEAR} SELECT system, t, rank::INT AS rank, neighbour, distance FROM k")
def join13_neighbours(t: Tables) -> DataFrame:
    return knn.knn_join(knn.delays(paired_hours(t), 3, value="x"), 4, 24)


@query(f"""{_HOURS}, b AS (SELECT system || ':x' AS system, t, y AS v, x AS target FROM h UNION ALL SELECT system || ':y', t, x, y FROM h), {_NEAR},
m AS (SELECT *, min(distance) OVER (PARTITION BY system, t) AS d1 FROM k),
z AS (SELECT *, CASE WHEN d1 = 0 THEN CASE WHEN distance = 0 THEN 1 ELSE 1e-6 END ELSE greatest(exp(-distance / CASE WHEN d1 = 0 THEN 1 ELSE d1 END), 1e-6) END AS weight FROM m),
f AS (SELECT z.system, z.t, sum(weight * target) / sum(weight) AS predicted, count(*) AS n FROM z JOIN b ON b.system = z.system AND b.t = z.neighbour GROUP BY 1, 2)
SELECT split_part(f.system, ':', 1) AS system, split_part(f.system, ':', 2) AS cause, CASE split_part(f.system, ':', 2) WHEN 'x' THEN 'y' ELSE 'x' END AS effect, count(*) AS n, round(corr(predicted, target), 6) AS rho FROM f JOIN b ON b.system = f.system AND b.t = f.t WHERE n = 4 GROUP BY f.system""")
def ts03_cross_map_skill(t: Tables) -> DataFrame:
    return knn.cross_map_skill(paired_hours(t), 3, radius=24).withColumn("rho", F.round("rho", 6))


@query()
def ts27_gain_matrix(t: Tables) -> DataFrame:
    return gains.gain_matrix(scan.states(hourly(t), HOURLY_SCAN))
