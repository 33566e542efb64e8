"""More queries: the remaining aggregates, scalar functions, tests, learners and probes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar, stats
from ..operators import blocks, graph, learning, manifold, redundancy, scan
from ..operators import relational as R
from ..sources import generators
from ..storage import settled
from .catalogue import Tables, query
from .series import HOURLY_SCAN, hourly, paired_hours


@query("SELECT o_orderstatus, median(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, median(o_totalprice) FILTER (WHERE o_orderpriority <> '1-URGENT') AS others FROM orders GROUP BY 1")
def agg10_masked_median(t: Tables) -> DataFrame:
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return t.orders.groupBy("o_orderstatus").agg(F.median(F.when(urgent, F.col("o_totalprice"))).alias("urgent"), F.median(F.when(~urgent, F.col("o_totalprice"))).alias("others"))


@query("WITH l AS (SELECT l_partkey, l_suppkey, l_linenumber, avg(l_discount) AS v FROM lineitem GROUP BY 1, 2, 3) SELECT l_partkey, l_suppkey, round(max(v) + 1e-9, 6) AS best FROM l GROUP BY 1, 2")
def agg27_max_over_lags(t: Tables) -> DataFrame:
    by_lag = t.lineitem.groupBy("l_partkey", "l_suppkey", "l_linenumber").agg(F.avg("l_discount").alias("v"))
    return by_lag.groupBy("l_partkey", "l_suppkey").agg(F.round(F.max("v") + 1e-9, 6).alias("best"))


@query("SELECT user_id, round(avg(value) + 1e-9, 6) AS mean, round(stddev_pop(value) + 1e-9, 6) AS spread, round(avg(value) / nullif(stddev_pop(value), 0) + 1e-9, 6) AS ratio FROM events GROUP BY 1")
def agg28_ensemble_ratio(t: Tables) -> DataFrame:
    spread = F.stddev_pop("value")
    return t.events.groupBy("user_id").agg(F.round(F.avg("value") + 1e-9, 6).alias("mean"), F.round(spread + 1e-9, 6).alias("spread"), F.round(F.try_divide(F.avg("value"), F.nullif(spread, F.lit(0.0))) + 1e-9, 6).alias("ratio"))


@query("WITH a AS (SELECT l_partkey AS k, avg(l_discount) AS v FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1), b AS (SELECT l_partkey AS k, avg(l_discount) AS v FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1) SELECT round(avg(abs(a.v - b.v)), 9) AS gap FROM a JOIN b USING (k)")
def agg33_mean_absolute_difference(t: Tables) -> DataFrame:
    side = lambda k, n: t.lineitem.where(F.col("l_linenumber") % 2 == k).groupBy("l_partkey").agg(F.avg("l_discount").alias(n))
    return side(0, "a").join(side(1, "b"), "l_partkey").agg(F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 9).alias("gap"))


@query("SELECT l_returnflag, round(sum(l_quantity * l_discount) / sum(l_quantity), 9) AS mean FROM lineitem GROUP BY 1")
def agg05_weighted_mean(t: Tables) -> DataFrame:
    return R.weighted_mean(t.lineitem, ["l_returnflag"], F.col("l_discount"), F.col("l_quantity")).select("l_returnflag", F.round("ratio", 9).alias("mean"))


@query("""WITH e AS (SELECT l_returnflag AS system, l_linestatus AS seed, l_linenumber AS source, l_linenumber % 2 AS other, l_quantity % 4 AS kind, avg(l_extendedprice) AS mse FROM lineitem GROUP BY ALL),
w AS (SELECT system, seed, source, other, max(mse) FILTER (WHERE kind = 0) AS n, max(mse) FILTER (WHERE kind = 1) AS s, max(mse) FILTER (WHERE kind = 2) AS o, max(mse) FILTER (WHERE kind = 3) AS b FROM e GROUP BY ALL)
SELECT system, seed, source, other, round(n - s, 3) AS marginal_gain, round(o - b, 3) AS conditional_gain, CASE WHEN o - b > 0 THEN 'direct' WHEN n - s > 0 THEN 'indirect' ELSE 'none' END AS verdict FROM w""")
def join08_gain_table(t: Tables) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("none", "source_only", "other_only", "both"))), (F.col("l_quantity") % 4).cast("int") + 1)
    errors = t.lineitem.groupBy(F.col("l_returnflag").alias("system"), F.col("l_linestatus").alias("seed"), F.col("l_linenumber").alias("source"), (F.col("l_linenumber") % 2).alias("other"), kinds.alias("kind")).agg(F.avg("l_extendedprice").alias("mse"))
    return learning.gain_table(errors, ["system", "seed"]).withColumns({c: F.round(c, 3) for c in ("marginal_gain", "conditional_gain")})


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set02_intersection(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").cast("long").alias("k")).intersect(t.supplier.select(F.col("s_nationkey").cast("long").alias("k")))


@query("SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1)::DOUBLE / count(*) FILTER (WHERE quality = 1 OR toxic = 1) AS jaccard FROM labels")
def set09_flag_jaccard(t: Tables) -> DataFrame:
    return R.flagged_jaccard(t.labels, F.col("quality") == 1, F.col("toxic") == 1)


@query("SELECT s_suppkey, regexp_extract(replace(s_name, '#', ''), '([A-Za-z'']+)([0-9]+)$', 1) AS shaft, regexp_extract(replace(s_name, '#', ''), '([A-Za-z'']+)([0-9]+)$', 2)::INT AS contact FROM supplier")
def scl04_contact_parts(t: Tables) -> DataFrame:
    shaft, number = scalar.contact_parts(F.replace("s_name", F.lit("#"), F.lit("")))
    return t.supplier.select("s_suppkey", shaft.alias("shaft"), number.alias("contact"))


@query("WITH x AS (SELECT l_orderkey, l_linenumber, l_discount AS a, l_tax AS b, l_quantity / 50 AS c FROM lineitem) SELECT l_orderkey, l_linenumber, round(a + b + c + a*a + a*b + a*c + b*b + b*c + c*c + a*a*a + a*a*b + a*a*c + a*b*b + a*b*c + a*c*c + b*b*b + b*b*c + b*c*c + c*c*c, 9) AS total FROM x")
def scl13_polynomial_features(t: Tables) -> DataFrame:
    lags = [F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50]
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(sum(scalar.polynomial(lags, 3)[1:], scalar.polynomial(lags, 3)[0]), 9).alias("total"))


@query("SELECT vec_id, round(ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))), 6) AS energy FROM embeddings")
def scl16_logsumexp(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(scalar.logsumexp(F.col("embedding").cast("array<double>")), 6).alias("energy"))


@query("SELECT p_partkey, CASE WHEN left(p_brand, length(p_brand) - 1) IN ('Brand#1', 'Brand#3') THEN left(p_brand, length(p_brand) - 1) ELSE 'Brand#' END AS root FROM part")
def scl09_name_root(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", scalar.name_root(F.col("p_brand"), ["Brand#", "Brand#1", "Brand#3"]).alias("root"))


@query("SELECT vec_id, a AS row_, b AS col_, round(embedding[a]::DOUBLE * embedding[3 + b]::DOUBLE + 1e-9, 6) AS product FROM embeddings, range(1, 4) x(a), range(1, 3) y(b)")
def scl14_interactions(t: Tables) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    made = t.embeddings.select("vec_id", F.posexplode(scalar.interactions(F.slice(e, 1, 3), F.slice(e, 4, 2))).alias("k", "product"))
    return made.select("vec_id", (F.floor(F.col("k") / 2) + 1).alias("row_"), (F.col("k") % 2 + 1).cast("long").alias("col_"), F.round(F.col("product") + 1e-9, 6).alias("product"))


@query("SELECT event_id, round(cos(radians(value % 90)) * cos(radians(user_id)), 9) AS x, round(cos(radians(value % 90)) * sin(radians(user_id)), 9) AS y, round(sin(radians(value % 90)), 9) AS z FROM events")
def scl17_unit_sphere(t: Tables) -> DataFrame:
    x, y, z = scalar.unit_sphere(F.col("value") % 90, F.col("user_id"))
    return t.events.select("event_id", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"), F.round(z, 9).alias("z"))


@query("""WITH x AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'Likely pathogenic' WHEN 'view' THEN 'Benign' WHEN 'error' THEN 'Conflicting: pathogenic and benign' ELSE event_type END AS s FROM events)
SELECT event_id, CASE WHEN lower(s) LIKE '%conflicting%' THEN NULL WHEN lower(s) LIKE '%pathogenic%' THEN 1 WHEN lower(s) LIKE '%benign%' THEN 0 END AS y FROM x""")
def scl23_significance(t: Tables) -> DataFrame:
    text = F.when(F.col("event_type") == "click", "Likely pathogenic").when(F.col("event_type") == "view", "Benign").when(F.col("event_type") == "error", "Conflicting: pathogenic and benign").otherwise(F.col("event_type"))
    return t.events.select("event_id", scalar.significance(text).alias("y"))


@query("SELECT user_id, arg_min(event_type, (v, event_type)) AS cheapest FROM (SELECT user_id, event_type, round(sum(value), 6) AS v FROM events GROUP BY 1, 2) GROUP BY 1")
def scl24_cheapest_key(t: Tables) -> DataFrame:
    costs = t.events.groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 6).alias("v"))
    maps = costs.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    return maps.select("user_id", F.explode("m").alias("k", "v")).groupBy("user_id").agg(F.min_by("k", F.struct("v", "k")).alias("cheapest"))


@query()
def sta13_hsic(t: Tables) -> DataFrame:
    return blocks.grouped_hsic(t.lineitem, "l_returnflag", "l_quantity", "l_extendedprice")


@query()
def sta18_wilcoxon(t: Tables) -> DataFrame:
    means = t.events.groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    deltas = R.paired_delta(means, ["user_id"], "event_type", "view", "v")
    return stats.signed_rank(deltas, "event_type", "delta").select("event_type", "p")


@query()
def sta20_cohort_permutation(t: Tables) -> DataFrame:
    """Exact label permutation over the cohort of all nations with the largest statistic over cells."""
    members = [int(r[0]) for r in t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey").orderBy("n_nationkey").collect()]
    cells = t.customer.where(F.col("c_nationkey").isin(members)).groupBy(F.col("c_nationkey").alias("m"), F.col("c_mktsegment").alias("cell")).agg(F.sum("c_acctbal").cast("double").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    names = sorted({r["cell"] for r in cells})
    sums, counts = np.zeros((len(members), len(names))), np.zeros((len(members), len(names)))
    for r in cells:
        at = members.index(r["m"]), names.index(r["cell"])
        sums[at], counts[at] = r["s"], r["n"]
    p = stats.cohort_p(t.spark, sums, counts, len(members) // 2)
    return t.spark.createDataFrame([(c, float(v)) for c, v in zip(names, p)], "cell string, p double")


@query("WITH c AS (SELECT quantile_cont(value, 0.9) AS cut FROM events WHERE event_type = 'view') SELECT round(cut, 6) AS cut, avg((value > cut)::INT) AS sensitivity FROM events, c WHERE event_type = 'error' GROUP BY cut")
def sta23_matched_specificity(t: Tables) -> DataFrame:
    cut = t.events.where("event_type = 'view'").agg(F.percentile("value", F.lit(0.9)).alias("cut"))
    bad = t.events.where("event_type = 'error'").join(F.broadcast(cut))
    return bad.groupBy("cut").agg(F.avg((F.col("value") > F.col("cut")).cast("int")).alias("sensitivity")).select(F.round("cut", 6).alias("cut"), "sensitivity")


@query()
def sta30_participation_ratio(t: Tables) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    _, _, cov = redundancy.moments(t.lineitem, columns)
    spread = np.sqrt(np.diag(cov))
    ratio, n95 = learning.participation(np.linalg.eigvalsh(cov / np.outer(spread, spread)))
    return t.spark.createDataFrame([(ratio, n95)], "participation double, n_95 int")


@query("""WITH d AS (SELECT l_returnflag AS g, l_orderkey % 5 <> 0 AS train, l_extendedprice AS a, l_discount AS b, l_extendedprice * (1 - l_discount) AS y FROM lineitem),
m AS (SELECT g, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) + 1 AS aa, var_pop(b) * count(*) + 1 AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS bz FROM d WHERE train GROUP BY g),
w AS (SELECT *, (ay * bb - bz * ab) / (aa * bb - ab * ab) AS wa, (bz * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM m)
SELECT g AS l_returnflag, round(greatest(0, 1 - avg(pow(y - my - (a - ma) * wa - (b - mb) * wb, 2)) / var_pop(y)), 6) AS r2 FROM d JOIN w USING (g) WHERE NOT train GROUP BY g""")
def reg01_grouped_ridge(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("train", F.col("l_orderkey") % 5 != 0).withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return learning.grouped_ridge(rows, "l_returnflag", ["l_extendedprice", "l_discount"], ["net"], "train", intercept=True, ddof=0).withColumn("r2", F.round("r2", 6))


@query()
def reg09_component_knee(t: Tables) -> DataFrame:
    scores = blocks.component_r2(t.embeddings, "embedding", [1, 2, 4, 8, 16, 32, 64])
    return t.spark.createDataFrame([(r, s, learning.knee(scores, 0.5)) for r, s in scores.items()], "width int, r2 double, knee int")


@query("""WITH p AS (SELECT a.vec_id, b.vec_id AS o, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d, b.label AS v FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d * d, 9), o) AS k FROM p) SELECT vec_id, round(sum(v / greatest(d, 1e-12)) / sum(1 / greatest(d, 1e-12)) + 1e-9, 6) AS predicted FROM r WHERE k <= 5 GROUP BY 1""")
def reg07_neighbour_regression(t: Tables) -> DataFrame:
    return blocks.neighbour_regression(t.embeddings, "vec_id", "embedding", "label", 5).withColumn("predicted", F.round(F.col("predicted") + 1e-9, 6))


@query()
def ts09_optimal_dimension(t: Tables) -> DataFrame:
    made = paired_hours(t)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"system": frame["system"].iloc[:1], "dimension": [manifold.optimal_dimension(frame.sort_values("t")["x"].to_numpy())]})

    return made.groupBy("system").applyInPandas(run, "system string, dimension int")


@query("""WITH x AS (SELECT user_id, event_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y FROM events), s AS (SELECT *, lag(value) OVER w AS pv, lag(y) OVER w AS py, lead(value) OVER w AS nv, lead(y) OVER w AS ny FROM x WHERE y IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id))
SELECT event_id, CASE WHEN nv IS NULL OR value - pv <= nv - value THEN py ELSE ny END AS predicted FROM s WHERE pv IS NOT NULL OR nv IS NOT NULL""")
def win16_analogue(t: Tables) -> DataFrame:
    x = t.events.withColumn("y", F.lead("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("y IS NOT NULL")
    w = Window.partitionBy("user_id").orderBy("value", "event_id")
    s = x.select("event_id", "value", *(f("value").over(w).alias(f"{n}v") for n, f in (("p", F.lag), ("n", F.lead))), *(f("y").over(w).alias(f"{n}y") for n, f in (("p", F.lag), ("n", F.lead))))
    near = F.when(F.col("nv").isNull() | (F.col("value") - F.col("pv") <= F.col("nv") - F.col("value")), F.col("py")).otherwise(F.col("ny"))
    return s.where("pv IS NOT NULL OR nv IS NOT NULL").select("event_id", near.alias("predicted"))


@query("""WITH f AS (SELECT max(value) AS floor FROM events WHERE event_type = 'error') SELECT e.event_type, count(*) AS n, count(*) FILTER (WHERE value > greatest(400, floor * 0.9)) AS clears FROM events e, f GROUP BY 1""")
def drv11_artifact_floor(t: Tables) -> DataFrame:
    floor = t.events.where("event_type = 'error'").agg(F.max("value").alias("floor"))
    clears = F.col("value") > F.greatest(F.lit(400.0), F.col("floor") * 0.9)
    return t.events.join(F.broadcast(floor)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(clears).alias("clears"))


@query()
def drv14_readout_decomposition(t: Tables) -> DataFrame:
    rows = settled(scan.states(hourly(t), HOURLY_SCAN))
    return scan.readouts(rows, settled(scan.codes(rows, HOURLY_SCAN)), HOURLY_SCAN)


@query()
def red14_baseline_shares(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_quantity", "l_discount", "l_tax", ((F.col("l_quantity") > 30) & (F.col("l_discount") > 0.03)).cast("int").alias("y"))
    return learning.importance_shares(learning.baseline_importances(rows, ["l_quantity", "l_discount", "l_tax"], "y", trees=10))


@query()
def red21_associative_reconstruction(t: Tables) -> DataFrame:
    return blocks.associative_r2(t.embeddings, "vec_id", "embedding", 8.0)


@query("SELECT floor(r2 / 0.05)::INT AS bin, count(*) AS n, avg((lx = ly)::INT) AS same FROM (SELECT round(pow(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2), 9) AS r2, a.label AS lx, b.label AS ly FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) GROUP BY 1")
def red19_reliability_by_bin(t: Tables) -> DataFrame:
    a = t.embeddings.select("vec_id", "embedding", "label")
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"), F.col("label").alias("l2"))
    c = scalar.cosine(F.col("embedding"), F.col("e2"))
    return a.join(b, "vec_id").withColumn("r2", F.round(c * c, 9)).groupBy(F.floor(F.round(F.col("r2") / 0.05, 9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("l2")).cast("int")).alias("same"))


@query("WITH e AS (SELECT DISTINCT o_custkey % 40 AS src, o_orderkey % 40 AS dst FROM orders WHERE o_totalprice > 400000), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT dst, count(*) AS in_weight FROM b GROUP BY 1")
def grf05_symmetric_in_weight(t: Tables) -> DataFrame:
    edges = t.orders.where("o_totalprice > 400000").selectExpr("o_custkey % 40 AS src", "o_orderkey % 40 AS dst")
    return graph.both_ways(edges).groupBy("dst").agg(F.count(F.lit(1)).alias("in_weight"))


@query("""WITH u AS (SELECT label, generate_subscripts(embedding, 1) AS c, unnest(embedding)::DOUBLE AS v FROM embeddings), k AS (SELECT label, c, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM u GROUP BY ALL), o AS (SELECT c, avg(v) AS g, count(*) AS total FROM u GROUP BY c),
x AS (SELECT sum(n * s / total) AS inside, sum(n * pow(m - g, 2) / total) AS outside FROM k JOIN o USING (c)) SELECT round(inside, 6) AS within, round(outside, 6) AS "between", round(inside / outside, 6) AS ratio FROM x""")
def nn12_neural_collapse(t: Tables) -> DataFrame:
    width = len(t.embeddings.select("embedding").first()[0])
    units = t.embeddings.select("label", *(F.col("embedding")[k].cast("double").alias(f"u{k}") for k in range(width)))
    out = learning.neural_collapse(units, "label", [f"u{k}" for k in range(width)])
    return out.select(F.round("within", 6).alias("within"), F.round("between", 6).alias("between"), F.round("ratio", 6).alias("ratio"))


@query()
def nn09_weight_statistics(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(k, float(v)) for k, v in blocks.weight_statistics(t.embeddings, "vec_id", "embedding").items()], "statistic string, value double")


@query("""WITH m AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2), d AS (SELECT a.event_type AS arm, a.v - b.v AS x FROM m a JOIN m b ON a.user_id = b.user_id AND b.event_type = 'view' AND a.event_type <> 'view'),
n AS (SELECT avg(x) AS m, stddev_samp(x) AS s FROM d WHERE arm = 'click') SELECT arm AS event_type, round((avg(x) - m) / s, 6) AS z FROM d, n WHERE arm <> 'click' GROUP BY arm, m, s""")
def nn14_null_calibrated_z(t: Tables) -> DataFrame:
    means = t.events.groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    deltas = R.paired_delta(means, ["user_id"], "event_type", "view", "v")
    return learning.paired_z(deltas, "event_type", F.col("event_type") == "click", "delta").select("event_type", F.round("z", 6).alias("z"))


@query("WITH g AS (SELECT p_brand, count(DISTINCT p_type) AS k FROM part GROUP BY 1) SELECT p_partkey, round(p_retailprice / sqrt(k), 6) AS scaled FROM part JOIN g USING (p_brand)")
def prep04_group_scale(t: Tables) -> DataFrame:
    sizes = t.part.groupBy("p_brand").agg(F.countDistinct("p_type").alias("k"))
    return t.part.join(sizes, "p_brand").select("p_partkey", F.round(F.col("p_retailprice") / F.sqrt("k"), 6).alias("scaled"))


@query("WITH s AS (SELECT lang, avg((n_chars > 3000 OR source IS NULL)::INT) AS gap FROM documents GROUP BY 1) SELECT lang, round(gap, 9) AS gap FROM s WHERE gap < 0.3")
def prep07_null_fraction(t: Tables) -> DataFrame:
    masked = t.documents.withColumn("x", F.when(~((F.col("n_chars") > 3000) | F.col("source").isNull()), F.col("n_chars")))
    return masked.groupBy("lang").agg(F.avg(F.col("x").isNull().cast("int")).alias("gap")).where("gap < 0.3").select("lang", F.round("gap", 9).alias("gap"))


@query("WITH m AS (SELECT max(value) AS m FROM events WHERE event_type = 'error') SELECT count(*) FILTER (WHERE value <= m) AS buried, count(*) AS causal FROM events, m WHERE event_type = 'click'")
def red16_causal_buried(t: Tables) -> DataFrame:
    best = t.events.where("event_type = 'error'").agg(F.max("value").alias("m"))
    return t.events.where("event_type = 'click'").join(F.broadcast(best)).agg(F.count_if(F.col("value") <= F.col("m")).alias("buried"), F.count(F.lit(1)).alias("causal"))


@query()
def drv12_outflow(t: Tables) -> DataFrame:
    rows = settled(scan.states(hourly(t), HOURLY_SCAN))
    return scan.outflows(rows, settled(scan.codes(rows, HOURLY_SCAN)), HOURLY_SCAN)


@query("""WITH p AS (SELECT c_custkey, c_acctbal, radians(c_nationkey * 6.0 - 75 + c_custkey % 5) AS lat, radians(c_custkey * 1.0) AS lon FROM customer), x AS (SELECT c_custkey, c_acctbal, cos(lat) * cos(lon) AS x, cos(lat) * sin(lon) AS y, sin(lat) AS z FROM p),
c AS (SELECT -1 AS draw, *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM x UNION ALL SELECT k AS draw, x.*, row_number() OVER (PARTITION BY k ORDER BY md5(k || ':' || c_custkey), c_custkey) AS r FROM x, range(20) d(k)), s AS (SELECT * FROM c WHERE r <= 500),
n AS (SELECT a.draw, a.c_custkey, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) AS d FROM s a JOIN s b ON a.draw = b.draw AND a.c_custkey <> b.c_custkey GROUP BY ALL) SELECT draw::INT AS draw, round(median(d), 9) AS median_distance FROM n GROUP BY draw""")
def drv17_spatial_clustering(t: Tables) -> DataFrame:
    """Median nearest distance on the sphere of the 500 best customers (draw -1) against 20 hash-drawn sets of the same size; sizes are the feature."""
    x, y, z = scalar.unit_sphere(F.col("c_nationkey") * 6.0 - 75 + F.col("c_custkey") % 5, F.col("c_custkey") * 1.0)
    places = t.customer.select("c_custkey", "c_acctbal", x.alias("x"), y.alias("y"), z.alias("z"))
    by_hash = lambda k: F.md5(F.concat(F.lit(f"{k}:"), F.col("c_custkey").cast("string")).cast("binary"))
    sets = [(-1, F.desc("c_acctbal")), *((k, by_hash(k)) for k in range(20))]
    drawn = [places.orderBy(o, "c_custkey").limit(500).withColumn("draw", F.lit(k)) for k, o in sets]
    every = reduce(DataFrame.unionByName, drawn)
    other = every.select("draw", F.col("c_custkey").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"))
    chord = F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2 + (F.col("z") - F.col("oz")) ** 2)
    near = every.join(other, "draw").where("c_custkey <> o").groupBy("draw", "c_custkey").agg(F.min(chord).alias("d"))
    return near.groupBy("draw").agg(F.round(F.median("d"), 9).alias("median_distance"))


@query()
def grf01_random_dag(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(graph.random_dag(30, 2, 7), "src long, dst long")


@query()
def red23_energy_ablation(t: Tables) -> DataFrame:
    return blocks.energy_ablation(t.embeddings, "vec_id", "embedding", 4.0)


@query()
def ts28_lagged_partial_correlation(t: Tables) -> DataFrame:
    made = hourly(t).where(F.col("channel").endswith(":n"))
    w = Window.partitionBy("channel").orderBy("t")
    both = made.select("t", "channel", "value", F.lag("value").over(w).alias("before"))
    names = sorted(r[0] for r in made.select("channel").distinct().collect())  # a channel for each kind of events
    wide = both.groupBy("t").agg(*(F.max(F.when(F.col("channel") == c, F.col(v))).alias(f"v{i}_{v}") for i, c in enumerate(names) for v in ("value", "before")))
    columns = [f"v{i}_{v}" for v in ("value", "before") for i in range(len(names))]
    _, _, cov = redundancy.moments(wide, columns)
    p = learning.partial_correlations(cov)
    return t.spark.createDataFrame([(a, b, float(abs(p[i, len(names) + j]))) for i, b in enumerate(names) for j, a in enumerate(names) if i != j], "cause string, effect string, strength double")
