"""Queries of predictive information, of retrieval with some of the sources visible, and of gridded arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import knn, parameters, retrieval, vinformation
from ..sources import grids
from ..storage import new_folder, settled
from .catalogue import Tables, query
from .series import hourly, paired_hours

_TOLD = ["l_linestatus", "tens", "l_discount", "l_linenumber"]
_BITS = ", ".join(f"({1 << j}, '{c}')" for j, c in enumerate(_TOLD))


@query(f"""WITH r AS (SELECT l_returnflag AS y, l_linestatus AS a, floor(l_quantity / 10)::INT AS b, l_discount AS c, l_linenumber AS d, l_orderkey % 5 = 0 AS held FROM lineitem WHERE l_returnflag IS NOT NULL AND l_orderkey IS NOT NULL),
p AS (SELECT y, (count(*) FILTER (NOT held) + 1) / (sum(count(*) FILTER (NOT held)) OVER () + count(*) OVER ()) AS prior FROM r GROUP BY 1),
g AS (SELECT mask, CASE WHEN mask & 1 > 0 THEN a END AS a, CASE WHEN mask & 2 > 0 THEN b END AS b, CASE WHEN mask & 4 > 0 THEN c END AS c, CASE WHEN mask & 8 > 0 THEN d END AS d, y, count(*) FILTER (NOT held) AS n, count(*) FILTER (held) AS m FROM r, range(16) AS k(mask) GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY mask, a, b, c, d) AS total FROM g),
v AS (SELECT mask, sum(m * ln((n + prior) / (total + 1))) / sum(m) AS value FROM t JOIN p USING (y) GROUP BY 1),
f AS (SELECT * FROM (VALUES {_BITS}) AS x(bit, feature)),
j AS (SELECT feature, o.mask, w.value - o.value AS gain, factorial(bit_count(o.mask)::INT) * factorial(3 - bit_count(o.mask)::INT) / 24 AS share, o.mask | bit AS wide FROM v o JOIN f ON o.mask & bit = 0 JOIN v w ON w.mask = o.mask | bit)
SELECT feature, round(max(gain) FILTER (WHERE mask = 0), 9) AS marginal, round(max(gain) FILTER (WHERE wide = 15), 9) AS conditional, round(sum(share * gain), 9) AS shapley FROM j GROUP BY 1""")
def red17_v_information(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("tens", F.floor(F.col("l_quantity") / 10).cast("int"))
    values = settled(vinformation.table_values(rows, "l_returnflag", _TOLD, F.col("l_orderkey") % 5 == 0))
    out = vinformation.information(values, _TOLD)
    return out.select("feature", *(F.round(c, 9).alias(c) for c in ("marginal", "conditional", "shapley")))


@query()
def red17_linear_information(t: Tables) -> DataFrame:
    columns = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]
    values = settled(vinformation.linear_values(t.lineitem, "l_extendedprice", columns, F.col("l_orderkey") % 5 == 0))
    return vinformation.information(values, columns)


_SOURCES = ["first", "second", "third"]
_SETS = retrieval.gain_sets("first", _SOURCES)
_SEEN = ", ".join(f"('{s}', {', '.join(str(c in seen).upper() for c in _SOURCES)})" for s, seen in _SETS.items())
#: The label of every fifth vector from its nearest others, by sets of its thirds.
_RETRIEVED = f"""WITH e AS (SELECT vec_id AS k, embedding[1:20]::DOUBLE[] AS a, embedding[21:40]::DOUBLE[] AS b, embedding[41:64]::DOUBLE[] AS c, label::DOUBLE AS y FROM embeddings WHERE label IS NOT NULL),
g AS (SELECT q.k, q.y AS actual, p.k AS partner, p.y, list_sum(list_transform(list_zip(q.a, p.a), lambda z: (z[1] - z[2]) ** 2)) AS a, list_sum(list_transform(list_zip(q.b, p.b), lambda z: (z[1] - z[2]) ** 2)) AS b, list_sum(list_transform(list_zip(q.c, p.c), lambda z: (z[1] - z[2]) ** 2)) AS c FROM e q JOIN e p ON q.k % 5 = 0 AND p.k % 5 <> 0),
s AS (SELECT * FROM (VALUES {_SEEN}) AS x(name, sa, sb, sc)),
d AS (SELECT k, name AS "set", actual, partner, y, round(CASE WHEN sa THEN a ELSE 0 END + CASE WHEN sb THEN b ELSE 0 END + CASE WHEN sc THEN c ELSE 0 END, 9) AS d2 FROM g, s),
n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY k, "set" ORDER BY d2, partner) <= 5),
r AS (SELECT k AS vec_id, "set", coalesce(avg(y) FILTER (WHERE d2 = 0), sum(y / sqrt(d2)) FILTER (WHERE d2 > 0) / sum(1 / sqrt(d2)) FILTER (WHERE d2 > 0)) AS predicted, max(actual) AS actual FROM n GROUP BY 1, 2)"""


def _thirds(t: Tables) -> DataFrame:
    cut = {"first": (1, 20), "second": (21, 20), "third": (41, 24)}
    rows = t.embeddings.select("vec_id", F.col("label").cast("double").alias("label"), *(F.slice("embedding", *c).alias(s) for s, c in cut.items()))
    return retrieval.conditional_retrieval(rows, "vec_id", {s: s for s in _SOURCES}, "label", F.col("vec_id") % 5 != 0, _SETS)


@query(f'{_RETRIEVED} SELECT vec_id, "set", round(predicted, 6) AS predicted, actual FROM r')
def ts25_conditional_retrieval(t: Tables) -> DataFrame:
    return _thirds(t).withColumn("predicted", F.round("predicted", 6))


@query(f"""{_RETRIEVED}, m AS (SELECT "set", avg((predicted - actual) ** 2) AS mse FROM r GROUP BY 1),
x AS (SELECT substr("set", 2) AS source, max(mse) FILTER (WHERE "set"[1] = '+') AS w, max(mse) FILTER (WHERE "set"[1] = '-') AS o FROM m WHERE "set"[1] IN ('+', '-') GROUP BY 1),
z AS (SELECT source, (SELECT mse FROM m WHERE "set" = 'own') - w AS marginal, o - (SELECT mse FROM m WHERE "set" = 'all') AS conditional FROM x)
SELECT source, round(marginal, 6) AS marginal, round(conditional, 6) AS conditional, CASE WHEN conditional > 0 THEN 'direct' WHEN marginal > 0 THEN 'indirect' ELSE 'none' END AS verdict FROM z""")
def ts26_retrieval_gains(t: Tables) -> DataFrame:
    out = retrieval.gains(retrieval.skill(_thirds(t)))
    return out.withColumns({c: F.round(c, 6) for c in ("marginal", "conditional")})


@query()
def ts24_energy_against_error(t: Tables) -> DataFrame:
    """Spearman's correlation of a query's energy, and of its distance to the nearest memory, with its error, for two kernels and three betas."""
    rows = knn.delays(paired_hours(t), 3, value="x").join(paired_hours(t).select("system", "t", "y"), ["system", "t"])
    met = retrieval.energies(rows, "t", "system", "state", "y", [0.1, 1.0, 10.0], 24)
    met = settled(met.select("kernel", "beta", *(F.round(c, 9).alias(c) for c in ("energy", "nearest", "error"))))
    each = [retrieval.rank_correlation(met, m, "error", ("kernel", "beta")).withColumn("measure", F.lit(m)) for m in ("energy", "nearest")]
    return each[0].unionByName(each[1])


@query()
def src16_chunked_grid(t: Tables) -> DataFrame:
    """The last week of all hourly channels (t, channel, value), read from chunks of an array that holds their whole history."""
    rows = settled(hourly(t))
    names = sorted(r[0] for r in rows.select("channel").distinct().collect())  # kinds of events: a few
    if not names:
        return rows.select("t", "channel", "value")
    places = t.spark.createDataFrame(list(enumerate(names)), "place long, channel string")
    first, last = rows.agg(F.min("t"), F.max("t")).first()
    path, hours = new_folder(t.spark, "grid"), last - first + 1
    cells = rows.join(F.broadcast(places), "channel").select((F.col("t") - first).alias("hour"), "place", "value")
    grids.write_zarr(cells, path, ["hour", "place"], [hours, len(names)], [168, 8])
    week = grids.read_zarr(t.spark, path).where(F.col("hour") >= hours - 168)
    return week.join(F.broadcast(places), "place").select((F.col("hour") + first).alias("t"), "channel", "value")


@query()
def drv16_parameter_grid(t: Tables) -> DataFrame:
    """How far hourly channels foretell themselves, over a grid of delays, differencing and penalties."""
    rows = settled(hourly(t))
    cells = parameters.crossed({"difference": [False, True], "dimension": [1, 3], "ridge": [1.0, 100.0]})
    return parameters.run_grid(t.spark, cells, lambda c: parameters.predictability(rows, **c), new_folder(t.spark, "grid"), 4)
