"""Queries of neighbour information and of nulls from pools and halves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import pct_rank
from ..operators import information
from .catalogue import Tables, query

_NEAR = """{n}r AS (SELECT x, c FROM (SELECT {x}::DOUBLE AS x, l_returnflag AS c FROM lineitem) WHERE x IS NOT NULL AND c IS NOT NULL),
{n}s AS (SELECT c, count(*) AS size FROM {n}r GROUP BY 1 HAVING count(*) > 1),
{n}l AS (SELECT x, size, list_sort(list_filter([abs(x - lag(x, 1) OVER w), abs(x - lag(x, 2) OVER w), abs(x - lag(x, 3) OVER w), abs(x - lead(x, 1) OVER w), abs(x - lead(x, 2) OVER w), abs(x - lead(x, 3) OVER w)], lambda d: d IS NOT NULL))[least(3, size - 1)] AS r, least(3, size - 1) AS k FROM {n}r JOIN {n}s USING (c) WINDOW w AS (PARTITION BY c ORDER BY x)),
{n}c AS (SELECT x AS v, sum(count(*)) OVER (ORDER BY x) AS upto, count(*) AS here FROM {n}l GROUP BY 1),
{n}h AS (SELECT l.x, l.r, l.k, l.size, coalesce(c.upto, 0) AS below FROM {n}l l ASOF LEFT JOIN {n}c c ON l.x + l.r > c.v),
{n}b AS (SELECT h.*, coalesce(c.upto, 0) AS low, coalesce(e.here, 0) AS here FROM {n}h h ASOF LEFT JOIN {n}c c ON h.x - h.r >= c.v LEFT JOIN {n}c e ON e.v = h.x),
{n}m AS (SELECT greatest(0, max(t.psi) + avg(p.psi) - avg(q.psi) - avg(o.psi)) AS information FROM {n}b JOIN g t ON t.n = (SELECT count(*) FROM {n}l) JOIN g p ON p.n = k JOIN g q ON q.n = size JOIN g o ON o.n = CASE WHEN r = 0 THEN here ELSE below - low END)"""
_PSI = f"g AS (SELECT 1 AS n, -{information.EULER} AS psi UNION ALL SELECT i + 1, -{information.EULER} + sum(1.0::DOUBLE / i) OVER (ORDER BY i) FROM range(1, (SELECT count(*) FROM lineitem) + 1) AS t(i))"
_PLUG = """d AS (SELECT l_linenumber <= 3 AS x, l_returnflag AS c, count(*) AS n FROM lineitem GROUP BY 1, 2),
e AS (SELECT n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY c) AS nc, sum(n) OVER () AS total FROM d)"""


@query(f"""WITH {_PSI}, {_NEAR.format(n='p', x='l_extendedprice')}, {_NEAR.format(n='q', x='l_quantity')}, {_PLUG}
SELECT 'l_extendedprice' AS "column", 'continuous' AS kind, round(information, 8) AS information FROM pm UNION ALL SELECT 'l_quantity', 'continuous', round(information, 8) FROM qm
UNION ALL SELECT 'early', 'discrete', round(greatest(0, sum(n / total * ln(n * total / (nx * nc)))), 8) FROM e""")
def sta34_typed_information(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_extendedprice", "l_quantity", (F.col("l_linenumber") <= 3).alias("early"), "l_returnflag")
    out = information.typed_information(rows, ["l_extendedprice", "l_quantity", "early"], "l_returnflag")
    return out.withColumn("information", F.round("information", 8))


#: Orders of status F (cohort 0) and O (cohort 1) with the percentile of their price within the day.
_POOL = """p AS (SELECT o_orderkey AS id, o_orderpriority AS item, o_orderstatus AS status, year(o_orderdate) AS unit, (rank() OVER (PARTITION BY o_orderdate ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderdate, o_totalprice) - 1) / 2.0) / count(*) OVER (PARTITION BY o_orderdate) AS value FROM orders),
v AS (SELECT id, item, CASE status WHEN 'F' THEN 0 ELSE 1 END AS cohort, unit, round(value, 9) AS value FROM p WHERE status IN ('F', 'O'))"""


def _percentiles(t: Tables) -> DataFrame:
    value = F.round(pct_rank(["o_orderdate"], "o_totalprice"), 9)
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("item"), "o_orderstatus", F.year("o_orderdate").alias("unit"), value.alias("value"))
    return rows.where(F.col("o_orderstatus").isin("F", "O")).withColumn("cohort", F.when(F.col("o_orderstatus") == "F", 0).otherwise(1)).drop("o_orderstatus")


@query(f"""WITH {_POOL}, o AS (SELECT cohort, value, row_number() OVER (PARTITION BY cohort ORDER BY value, id) - 1 AS place, count(*) OVER (PARTITION BY cohort) AS size FROM v),
n AS (SELECT item, cohort, count(*) AS n, avg(value) AS mean FROM v GROUP BY 1, 2), z AS (SELECT DISTINCT cohort, size FROM o),
b AS (SELECT item, max(mean) FILTER (WHERE cohort = 1) - max(mean) FILTER (WHERE cohort = 0) AS delta FROM n GROUP BY 1),
i AS (SELECT item, cohort, draw, unnest(range(n)) AS i FROM n, range(10) AS r(draw)),
d AS (SELECT item, cohort, draw, ('0x' || left(md5(draw || ':' || item || ':' || cohort || ':' || i), 8))::BIGINT % size AS place FROM i JOIN z USING (cohort)),
k AS (SELECT item, draw, avg(value) FILTER (WHERE cohort = 1) - avg(value) FILTER (WHERE cohort = 0) AS x FROM d JOIN o USING (cohort, place) GROUP BY 1, 2)
SELECT k.item, round(delta, 9) AS delta, round(avg(x), 9) AS null_mean, avg(CASE WHEN delta < 0 THEN x <= delta ELSE x >= delta END::INT) AS p_identity FROM k JOIN b ON b.item = k.item GROUP BY k.item, delta""")
def sta21_pool_null(t: Tables) -> DataFrame:
    out = information.pool_null(_percentiles(t), 10)
    return out.select("item", F.round("delta", 9).alias("delta"), F.round("null_mean", 9).alias("null_mean"), "p_identity")


@query(f"""WITH {_POOL}, s AS (SELECT item, unit, sum(value) AS s, count(*) AS n, row_number() OVER (PARTITION BY item ORDER BY unit) - 1 AS i, count(*) OVER (PARTITION BY item) AS k FROM v GROUP BY 1, 2),
m AS (SELECT item, k, unnest(range(1 << k)) AS m FROM (SELECT DISTINCT item, k FROM s) WHERE k >= 4),
d AS (SELECT m.item, m.k, m.m, sum(s.s) FILTER (WHERE (m >> i) & 1 = 0) / sum(s.n) FILTER (WHERE (m >> i) & 1 = 0) - sum(s.s) FILTER (WHERE (m >> i) & 1 = 1) / sum(s.n) FILTER (WHERE (m >> i) & 1 = 1) AS d FROM m JOIN s ON s.item = m.item WHERE bit_count(m.m) = m.k // 2 GROUP BY 1, 2, 3)
SELECT item, k::INT AS units, round(stddev_pop(d), 9) AS deviation, round(max(abs(d)), 9) AS largest FROM d GROUP BY 1, 2""")
def sta22_split_half_floor(t: Tables) -> DataFrame:
    out = information.split_half_floor(_percentiles(t).select("item", "unit", "value"))
    return out.select("item", "units", F.round("deviation", 9).alias("deviation"), F.round("largest", 9).alias("largest"))
