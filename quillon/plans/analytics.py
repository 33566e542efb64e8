"""Queries of the statistics, pair, graph, redundancy, learning and preparation operators."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ranks, scalar, stats
from ..operators import graph, importance, learning, pairs, redundancy
from ..operators import relational as R
from ..storage import settled
from .catalogue import Tables, query

# -- statistics --------------------------------------------------------------------------------------------------------

_SCORED = "SELECT CAST(n_chars AS DOUBLE) AS s, quality = 1 AS p, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL"


def _scored(t: Tables) -> DataFrame:
    joined = t.documents.join(t.labels.where("quality IS NOT NULL"), "doc_id")
    return joined.select(F.col("n_chars").cast("double").alias("s"), (F.col("quality") == 1).alias("p"), "doc_id")


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def sta01_pearson(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(stats.correlation("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("""WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS x,
rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS y FROM part) SELECT p_brand, round(corr(x, y), 6) AS rho FROM r GROUP BY 1""")
def sta02_spearman(t: Tables) -> DataFrame:
    return stats.spearman(t.part, "p_size", "p_retailprice", "p_brand").select("p_brand", F.round("rho", 6).alias("rho"))


@query(f"""WITH x AS ({_SCORED}), r AS (SELECT p, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS k FROM x), c AS (SELECT count(*) FILTER (WHERE p) AS n1, count(*) FILTER (WHERE NOT p) AS n0, sum(k) FILTER (WHERE p) AS rs FROM r)
SELECT round((rs - n1 * (n1 + 1) / 2) / (n1 * n0), 9) AS auroc, round(greatest((rs - n1 * (n1 + 1) / 2) / (n1 * n0), 1 - (rs - n1 * (n1 + 1) / 2) / (n1 * n0)), 9) AS orientation_free FROM c""")
def sta03_auroc(t: Tables) -> DataFrame:
    out = stats.auroc(_scored(t), "s", F.col("p"))
    return out.select(F.round("auroc", 9).alias("auroc"), F.round(F.greatest(F.col("auroc"), 1 - F.col("auroc")), 9).alias("orientation_free"))


@query(f"""WITH x AS ({_SCORED}), r AS (SELECT p, row_number() OVER (ORDER BY s, doc_id) AS k FROM x), c AS (SELECT count(*) FILTER (WHERE p) AS n1, count(*) FILTER (WHERE NOT p) AS n0, sum(k) FILTER (WHERE p) AS rs FROM r)
SELECT round((rs - n1 * (n1 + 1) / 2) / (n1 * n0), 9) AS auroc FROM c""")
def sta04_auroc_ordinal(t: Tables) -> DataFrame:
    return stats.auroc_ordinal(_scored(t), "s", F.col("p"), "doc_id").select(F.round("auroc", 9).alias("auroc"))


@query(f"""WITH x AS ({_SCORED}), g AS (SELECT s, count(*) FILTER (WHERE p) AS p, count(*) AS n FROM x GROUP BY 1), c AS (SELECT p, sum(p) OVER (ORDER BY s DESC) / sum(n) OVER (ORDER BY s DESC) AS precision FROM g)
SELECT round(sum(p * precision) / sum(p), 9) AS average_precision FROM c""")
def sta06_average_precision(t: Tables) -> DataFrame:
    return stats.average_precision(_scored(t), "s", F.col("p")).select(F.round("average_precision", 9).alias("average_precision"))


@query("""WITH b AS (SELECT b, o_orderpriority, avg(o_totalprice) AS m FROM orders, range(20) AS r(b) WHERE ('0x' || left(md5(b || ':' || o_orderkey), 8))::BIGINT % 2 = 0 GROUP BY 1, 2)
SELECT o_orderpriority, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM b GROUP BY 1""")
def sta09_half_sample_interval(t: Tables) -> DataFrame:
    draws = t.spark.range(20).select(F.col("id").alias("b"))
    picked = t.orders.join(F.broadcast(draws), F.conv(F.substring(F.md5(F.concat_ws(":", "b", "o_orderkey").cast("binary")), 1, 8), 16, 10).cast("long") % 2 == 0)
    means = picked.groupBy("b", "o_orderpriority").agg(F.avg("o_totalprice").alias("m"))
    return means.groupBy("o_orderpriority").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select("o_orderpriority", F.round(F.col("q")[0], 4).alias("low"), F.round(F.col("q")[1], 4).alias("high"))


@query("""WITH m AS (SELECT o_orderpriority AS g, year(o_orderdate) * 12 + month(o_orderdate) AS k, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2),
p AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, avg(v) OVER (PARTITION BY g) AS mean FROM m WHERE g IS NOT NULL AND k IS NOT NULL AND v IS NOT NULL),
d AS (SELECT g, b, ('0x' || left(md5(b || ':' || g || ':' || i), 8))::BIGINT % n AS i FROM p, range(2000) AS r(b)),
q AS (SELECT g, n, mean, b, avg(v) AS x FROM d JOIN p USING (g, i) GROUP BY 1, 2, 3, 4)
SELECT g AS o_orderpriority, n, round(mean, 4) AS mean, round(quantile_cont(x, 0.025), 4) AS low, round(quantile_cont(x, 0.975), 4) AS high FROM q GROUP BY g, n, mean""")
def sta09_bootstrap_interval(t: Tables) -> DataFrame:
    months = t.orders.groupBy("o_orderpriority", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("k")).agg(F.avg("o_totalprice").alias("v"))
    out = stats.bootstrap_interval(months, "o_orderpriority", "v", "k")
    return out.select("o_orderpriority", "n", *(F.round(c, 4).alias(c) for c in ("mean", "low", "high")))


@query("""SELECT event_id, r FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('5:' || event_id), event_id) AS r FROM events) WHERE r <= 10""")
def sta11_sample_without_replacement(t: Tables) -> DataFrame:
    order = F.md5(F.concat(F.lit("5:"), F.col("event_id").cast("string")).cast("binary"))
    return R.top_per_group(t.events, ["user_id"], [order.asc(), F.asc("event_id")], 10).select("event_id", F.col("rank").alias("r"))


@query(f"""WITH x AS ({_SCORED}), obs AS (SELECT avg(s) FILTER (WHERE p) - avg(s) FILTER (WHERE NOT p) AS d, count(*) FILTER (WHERE p) AS k FROM x),
o AS (SELECT b, s, row_number() OVER (PARTITION BY b ORDER BY md5(b || ':' || doc_id), doc_id) AS i FROM x, range(30) AS r(b)),
n AS (SELECT b, avg(s) FILTER (WHERE i <= k) - avg(s) FILTER (WHERE i > k) AS d FROM o, obs GROUP BY 1)
SELECT (1 + count(*) FILTER (WHERE n.d >= obs.d)) / (count(*) + 1) AS p FROM n, obs""")
def sta12_permutation_p(t: Tables) -> DataFrame:
    return stats.permutation_test(settled(_scored(t)), "s", F.col("p"), "doc_id", 30)


@query(f"""WITH x AS ({_SCORED}), r AS (SELECT p, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS k FROM x), c AS (SELECT count(*) FILTER (WHERE p)::DOUBLE AS n1, count(*) FILTER (WHERE NOT p)::DOUBLE AS n0, sum(k) FILTER (WHERE p) AS rs FROM r)
SELECT rs - n1 * (n1 + 1) / 2 AS u, n1 AS n_pos, n0 AS n_neg, round(2 * (rs - n1 * (n1 + 1) / 2) / (n1 * n0) - 1, 9) AS rank_biserial FROM c""")
def sta14_mann_whitney(t: Tables) -> DataFrame:
    return stats.mann_whitney(_scored(t), "s", F.col("p")).select("u", "n_pos", "n_neg", F.round("rank_biserial", 9).alias("rank_biserial"))


@query("WITH c AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS k FROM documents GROUP BY 1) SELECT source, 3.0 / greatest(n - k, 1) AS bound FROM c")
def sta24_rule_of_three(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count_if((F.col("lang") != "en") | F.col("lang").isNull()).alias("n")).select("source", stats.rule_of_three(F.col("n")).alias("bound"))


@query("""WITH c AS (SELECT source, count(*) FILTER (WHERE toxic = 1) AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), a AS (SELECT sum(n) AS total, sum(k) AS m FROM c),
i AS (SELECT source, k, n, total, m, unnest(range(0, (n + 1)::BIGINT)) AS i FROM c, a)
SELECT source, round(coalesce(sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(total - m + 1) - lgamma(n - i + 1) - lgamma(total - m - n + i + 1) - lgamma(total + 1) + lgamma(n + 1) + lgamma(total - n + 1))) FILTER (WHERE i >= k AND i <= m AND n - i <= total - m), 0), 9) AS p_enriched,
round(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FILTER (WHERE i >= k), 9) AS p_sign FROM i GROUP BY 1""")
def sta19_exact_tails(t: Tables) -> DataFrame:
    counts = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("k"), F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("population"), F.sum("k").alias("marked"))
    joined = counts.join(F.broadcast(total))
    return joined.select("source", F.round(stats.hypergeometric_sf("k", "population", "marked", "n"), 9).alias("p_enriched"), F.round(stats.sign_test("k", "n"), 9).alias("p_sign"))


@query()
def sta16_stouffer(t: Tables) -> DataFrame:
    p = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.avg("quality").alias("p"), F.sqrt(F.count(F.lit(1))).alias("w")).dropna()
    return stats.stouffer(p, "p", "w").select("z", stats.normal_sf("z").alias("p"))


@query("""WITH x AS (SELECT d.n_chars::DOUBLE AS y, l.toxic = 1 AS w FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic IS NOT NULL),
s AS (SELECT avg(y) FILTER (WHERE w) - avg(y) FILTER (WHERE NOT w) AS effect, sqrt(var_samp(y) FILTER (WHERE w) / count(*) FILTER (WHERE w) + var_samp(y) FILTER (WHERE NOT w) / count(*) FILTER (WHERE NOT w)) AS se FROM x)
SELECT round(effect, 6) AS effect, round(effect - 1.96 * se, 6) AS low, round(effect + 1.96 * se, 6) AS high FROM s""")
def sta25_difference_in_means(t: Tables) -> DataFrame:
    x = t.documents.join(t.labels.where("toxic IS NOT NULL"), "doc_id").select(F.col("n_chars").cast("double").alias("y"), (F.col("toxic") == 1).alias("w"))
    a, b = F.when(F.col("w"), F.col("y")), F.when(~F.col("w"), F.col("y"))
    s = x.agg((F.avg(a) - F.avg(b)).alias("effect"), F.sqrt(F.var_samp(a) / F.count(a) + F.var_samp(b) / F.count(b)).alias("se"))
    return s.select(F.round("effect", 6).alias("effect"), F.round(F.col("effect") - 1.96 * F.col("se"), 6).alias("low"), F.round(F.col("effect") + 1.96 * F.col("se"), 6).alias("high"))


@query("""WITH m AS (SELECT median(n_chars) AS m FROM documents), x AS (SELECT n_chars > (SELECT m FROM m) AS up, l.quality AS y, l.toxic = 1 AS w FROM documents JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL),
e AS (SELECT up, avg(y) FILTER (WHERE w) - avg(y) FILTER (WHERE NOT w) AS d FROM x GROUP BY 1) SELECT round(max(d) FILTER (WHERE up), 6) AS upper, round(max(d) FILTER (WHERE NOT up), 6) AS lower, round(max(d) FILTER (WHERE up) - max(d) FILTER (WHERE NOT up), 6) AS gap FROM e""")
def sta26_stratified_effect(t: Tables) -> DataFrame:
    middle = t.documents.agg(F.median("n_chars").alias("m"))
    x = t.documents.join(t.labels.dropna(subset=["quality", "toxic"]), "doc_id").withColumn("up", F.col("n_chars") > middle.scalar())
    effect = lambda up: F.avg(F.when((F.col("up") == up) & (F.col("toxic") == 1), F.col("quality"))) - F.avg(F.when((F.col("up") == up) & (F.col("toxic") != 1), F.col("quality")))
    s = x.agg(effect(True).alias("a"), effect(False).alias("b"))
    return s.select(F.round("a", 6).alias("upper"), F.round("b", 6).alias("lower"), F.round(F.col("a") - F.col("b"), 6).alias("gap"))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value >= 0)
SELECT user_id, round(2 * sum(i * value) / (n * sum(value)) - (n + 1) / n, 6) AS gini FROM r GROUP BY user_id, n""")
def sta27_gini(t: Tables) -> DataFrame:
    return stats.gini(t.events.where("value >= 0"), "value", "user_id").select("user_id", F.round("gini", 6).alias("gini"))


@query("""WITH r AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS i FROM events)
SELECT user_id, round(kurtosis(v), 4) AS kurtosis, round(sum(v) FILTER (WHERE i <= 4) / sum(v), 6) AS top4_share, round(sum(v) * sum(v) / sum(v * v), 4) AS participation FROM r GROUP BY 1""")
def sta28_profile_shape(t: Tables) -> DataFrame:
    return stats.profile_shape(t.events, "value", "user_id").select("user_id", F.round("kurtosis", 4).alias("kurtosis"), F.round("top4_share", 6).alias("top4_share"), F.round("participation", 4).alias("participation"))


@query("SELECT event_id, CASE WHEN value > 0.9 * ln(2) * 500 THEN 'memorising' WHEN value > 100 THEN 'partial' ELSE 'fitting' END AS regime FROM events")
def sta29_regimes(t: Tables) -> DataFrame:
    import math

    v = F.col("value")
    return t.events.select("event_id", F.when(v > 0.9 * math.log(2) * 500, "memorising").when(v > 100, "partial").otherwise("fitting").alias("regime"))


@query("""WITH c AS (SELECT lang, source, count(*)::DOUBLE AS n FROM documents GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c), a AS (SELECT lang, sum(n) AS na FROM c GROUP BY 1), b AS (SELECT source, sum(n) AS nb FROM c GROUP BY 1)
SELECT round(sum(n / t * ln(n * t / (na * nb))), 9) AS mi FROM c JOIN a USING (lang) JOIN b USING (source), t""")
def sta33_mutual_information(t: Tables) -> DataFrame:
    return stats.binned_information(t.documents, "lang", "source").select(F.round("mi", 9).alias("mi"))


@query("""WITH g AS (SELECT event_type, count(*) FILTER (WHERE user_id % 2 = 0)::DOUBLE AS a, count(*) FILTER (WHERE user_id % 2 = 1)::DOUBLE AS b FROM events GROUP BY 1),
p AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM g) SELECT round(sum(CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END), 9) AS divergence FROM p""")
def sta31_jensen_shannon(t: Tables) -> DataFrame:
    counts = t.events.groupBy("event_type").agg(F.count_if(F.col("user_id") % 2 == 0).alias("a"), F.count_if(F.col("user_id") % 2 == 1).alias("b"))
    sides = counts.agg(F.transform(F.sort_array(F.collect_list(F.struct("event_type", "a", "b"))), lambda s: s["a"] / 1.0).alias("a"), F.transform(F.sort_array(F.collect_list(F.struct("event_type", "a", "b"))), lambda s: s["b"] / 1.0).alias("b"))
    share = lambda c: F.transform(c, lambda x: x / F.aggregate(c, F.lit(0.0), lambda s, y: s + y))
    return sides.select(F.round(stats.jensen_shannon(share(F.col("a")), share(F.col("b"))), 9).alias("divergence"))


@query("""WITH v AS (SELECT value, count(*) FILTER (WHERE event_type = 'click') AS a, count(*) FILTER (WHERE event_type = 'view') AS b FROM events WHERE event_type IN ('click', 'view') GROUP BY 1),
c AS (SELECT value, sum(a) OVER w / sum(a) OVER () AS fa, sum(b) OVER w / sum(b) OVER () AS fb, lead(value) OVER w - value AS step FROM v WINDOW w AS (ORDER BY value)) SELECT round(sum(abs(fa - fb) * step), 4) AS distance FROM c""")
def sta32_wasserstein(t: Tables) -> DataFrame:
    return stats.wasserstein(t.events.where("event_type IN ('click', 'view')"), "value", F.col("event_type") == "click").select(F.round("distance", 4).alias("distance"))


# -- pairs and graphs --------------------------------------------------------------------------------------------------

_PAIRS = "SELECT a.vec_id AS i, b.vec_id AS j, a.label AS li, b.label AS lj, round(pow(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2), 9) AS r2 FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"


@query(f"WITH p AS ({_PAIRS}), h AS (SELECT least(greatest(ceil(round(r2 * 20, 9)) - 1, 0), 19)::INT AS r_bin, li = lj AS hit FROM p) SELECT r_bin, count(*) AS pairs, avg(hit::INT) AS p_equiv FROM h GROUP BY 1")
def agg20_pair_calibration(t: Tables) -> DataFrame:
    return pairs.calibration_curve(pairs.pair_histogram(t.embeddings, "vec_id", "embedding", "label"))


@query(f"WITH p AS ({_PAIRS}), h AS (SELECT least(greatest(ceil(round(r2 * 20, 9)) - 1, 0), 19)::INT AS r_bin, li = lj AS hit FROM p) SELECT count(*) FILTER (WHERE hit AND r_bin >= 2)::DOUBLE / nullif(count(*) FILTER (WHERE hit), 0) AS reverse FROM h")
def agg22_reverse_conditional(t: Tables) -> DataFrame:
    h = pairs.pair_histogram(t.embeddings, "vec_id", "embedding", "label")
    return h.agg(F.try_divide(F.sum(F.when(F.col("r_bin") >= 2, F.col("hits")).otherwise(0)), F.sum("hits")).alias("reverse"))


@query(f"""WITH p AS ({_PAIRS}), b AS (SELECT i AS key, j AS partner, r2, li = lj AS same FROM p UNION ALL SELECT j, i, r2, li = lj FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY r2 DESC, partner) AS rank FROM b)
SELECT key, max(r2) AS best_r2, bool_or(same) AS has_equivalent FROM r WHERE rank <= 5 GROUP BY 1""")
def red18_equivalent_partner(t: Tables) -> DataFrame:
    return pairs.equivalent_partner(pairs.top_partners(t.embeddings, "vec_id", "embedding", "label", 5))


_EDGES = "SELECT DISTINCT s_suppkey % 25 AS src, l_partkey % 25 AS dst FROM supplier JOIN lineitem ON s_suppkey = l_suppkey WHERE l_quantity >= 50 AND l_discount >= 0.1 AND l_tax >= 0.08"


def _edges(t: Tables) -> DataFrame:
    lines = t.lineitem.where("l_quantity >= 50 AND l_discount >= 0.1 AND l_tax >= 0.08")
    return t.supplier.join(lines, F.col("s_suppkey") == F.col("l_suppkey")).selectExpr("s_suppkey % 25 AS src", "l_partkey % 25 AS dst").distinct()


@query(f"""WITH e AS ({_EDGES}), o AS (SELECT src AS node, count(*) AS out_degree FROM e GROUP BY 1), i AS (SELECT dst AS node, count(*) AS in_degree FROM e GROUP BY 1)
SELECT n_nationkey AS node, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, CASE WHEN in_degree > 0 THEN 'driven' WHEN out_degree > 0 THEN 'source' ELSE 'isolated' END AS role FROM nation LEFT JOIN i ON n_nationkey = i.node LEFT JOIN o ON n_nationkey = o.node""")
def grf02_degree_roles(t: Tables) -> DataFrame:
    return graph.degrees(_edges(t), t.nation.select(F.col("n_nationkey").alias("node")))


@query(f"""WITH e AS ({_EDGES}), b AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst), d AS (SELECT src AS i, dst AS j FROM b WHERE src < dst),
h AS (SELECT DISTINCT x.dst AS i, y.dst AS j FROM b x JOIN b y ON x.src = y.src WHERE x.dst < y.dst) SELECT i, j, 'edge' AS class FROM d UNION ALL SELECT i, j, 'two_hop' FROM h WHERE (i, j) NOT IN (SELECT (i, j) FROM d)""")
def grf03_pair_classes(t: Tables) -> DataFrame:
    return graph.pair_classes(_edges(t))


@query(f"""WITH RECURSIVE e AS ({_EDGES}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w(node, here) AS (SELECT DISTINCT src, src FROM b UNION SELECT w.node, b.dst FROM w JOIN b ON w.here = b.src)
SELECT node, min(here) AS component FROM w GROUP BY 1""")
def grf07_components(t: Tables) -> DataFrame:
    return graph.components(_edges(t))


# -- regression, redundancy, learning ----------------------------------------------------------------------------------


@query("SELECT event_id, round(value - avg(value) OVER (PARTITION BY event_type), 6) AS residual FROM events")
def reg04_residual_by_group(t: Tables) -> DataFrame:
    means = t.events.groupBy("event_type").agg(F.avg("value").alias("_m"))
    return t.events.join(F.broadcast(means), "event_type").select("event_id", F.round(F.col("value") - F.col("_m"), 6).alias("residual"))


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pairwise_sql(table: str, columns: dict[str, str], bins: int = 32) -> str:
    """CTEs ending in r(predictor, target, r2) over expressions of a table."""
    clean = f"c AS (SELECT {', '.join(f'({e})::DOUBLE AS {n}' for n, e in columns.items())} FROM {table})"
    ends = f"e AS (SELECT {', '.join(f'min({n}) AS lo_{n}, max({n}) AS hi_{n}' for n in columns)} FROM c)"
    cells = " UNION ALL ".join(f"SELECT '{a}' AS predictor, '{b}' AS target, least(floor(({a} - lo_{a}) / (hi_{a} - lo_{a}) * {bins}), {bins - 1}) AS bin, {b} AS v FROM c, e" for a in columns for b in columns if a != b)
    means = "m AS (SELECT predictor, target, bin, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM p GROUP BY ALL), o AS (SELECT predictor, target, sum(n * m) / sum(n) AS mean FROM m GROUP BY ALL)"
    return f"{clean}, {ends}, p AS ({cells}), {means}, r AS (SELECT predictor, target, sum(n * pow(m - mean, 2)) / (sum(n * pow(m - mean, 2)) + sum(n * s)) AS r2 FROM m JOIN o USING (predictor, target) GROUP BY ALL)"


@query(f"WITH {_pairwise_sql('lineitem', dict(zip(_MEASURES, _MEASURES)))} SELECT predictor, target, round(r2, 6) AS r2 FROM r")
def red03_pairwise_r2(t: Tables) -> DataFrame:
    return redundancy.pairwise_r2(t.lineitem, _MEASURES).withColumn("r2", F.round("r2", 6))


_COPIES = {"l_quantity": "l_quantity", "square": "l_quantity * l_quantity", "wave": "cos(l_quantity / 8)", "l_tax": "l_tax", "rate": "1 + l_tax / 2", "l_discount": "l_discount"}


@query(f"""WITH RECURSIVE {_pairwise_sql('lineitem', _COPIES)}, l AS (SELECT a.predictor AS src, a.target AS dst FROM r a JOIN r b ON a.predictor = b.target AND a.target = b.predictor WHERE a.r2 >= 0.95 AND b.r2 >= 0.95),
w AS (SELECT src AS node, src AS to_node FROM l UNION SELECT node, dst FROM w JOIN l ON to_node = src) SELECT node, min(to_node) AS component FROM w GROUP BY node""")
def red06_equivalence_classes(t: Tables) -> DataFrame:
    """Classes of columns and their transforms that predict each other; a wave is predicted by its source, but not the source by it."""
    made = t.lineitem.select(*(F.expr(e).alias(n) for n, e in _COPIES.items()))
    links = redundancy.equivalence_links(redundancy.pairwise_r2(made, list(_COPIES)).withColumnsRenamed({"predictor": "i", "target": "j", "r2": "score"}), 0.95)
    names = F.array(*map(F.lit, sorted(_COPIES)))
    code = lambda c: F.array_position(names, F.col(c)).alias(c)
    name = lambda c: F.element_at(names, F.col(c).cast("int")).alias(c)
    return graph.components(links.select(code("src"), code("dst"))).select(name("node"), name("component"))


_COLUMNS = ["l_quantity", "l_discount", "l_tax"]


def _r2_sql(target: str, others: list[str]) -> str:
    """R2 of a least-squares fit by determinants of correlation matrices, over columns r_a_b of correlations."""

    def det(rows: list[str], columns: list[str]) -> str:
        if not rows:
            return "1"
        cell = lambda b: "1" if rows[0] == b else f"r_{min(rows[0], b)}_{max(rows[0], b)}"
        return "(" + " + ".join(f"{'-' if k % 2 else ''}{cell(b)} * {det(rows[1:], columns[:k] + columns[k + 1 :])}" for k, b in enumerate(columns)) + ")"

    return f"(1 - {det([target, *others], [target, *others])} / {det(others, others)})" if others else "0"


_CORRELATIONS = "WITH c AS (SELECT " + ", ".join(f"corr({a}, {b}) AS r_{a}_{b}" for a, b in combinations(sorted(_MEASURES), 2)) + " FROM lineitem)"
_PRICE = "l_extendedprice"


def _losses_sql(name: str, left: dict[str, list[str]]) -> str:
    """Rows (name, loss) of what the price's R2 loses when only the listed columns are left."""
    return f"{_CORRELATIONS} " + " UNION ALL ".join(f"SELECT '{n}' AS {name}, round({_r2_sql(_PRICE, _COLUMNS)} - {_r2_sql(_PRICE, own)}, 9) AS loss FROM c" for n, own in left.items())


def _shapley_sql() -> str:
    def term(feature: str) -> str:
        rest = [c for c in _COLUMNS if c != feature]
        subsets = [list(s) for k in range(len(rest) + 1) for s in combinations(rest, k)]
        return " + ".join(f"({_r2_sql(_PRICE, [*s, feature])} - {_r2_sql(_PRICE, s)}) / {3 if len(s) in (0, len(rest)) else 6}" for s in subsets)

    return f"{_CORRELATIONS} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round({term(f)}, 9) AS shapley FROM c" for f in _COLUMNS)


@query(f"""{_CORRELATIONS}, s AS (SELECT 'l_extendedprice' AS feature, 1.0::DOUBLE AS r2 UNION ALL SELECT 'l_net', 1.0 FROM c UNION ALL SELECT 'l_quantity', {_r2_sql("l_quantity", ["l_extendedprice", "l_tax"])} FROM c UNION ALL SELECT 'l_tax', {_r2_sql("l_tax", ["l_extendedprice", "l_quantity"])} FROM c)
SELECT feature, round(r2 + 1e-9, 6) AS r2_from_others, r2 >= 0.95 AS redundant, CASE WHEN r2 >= 0.95 THEN 'redundant' WHEN r2 >= 0.5 THEN 'partially redundant' ELSE 'unique' END AS verdict FROM s""")
def red01_redundancy_scores(t: Tables) -> DataFrame:
    scores = redundancy.redundancy_scores(t.lineitem.withColumn("l_net", F.col("l_extendedprice") * 2 + 1), ["l_quantity", "l_extendedprice", "l_net", "l_tax"])
    return scores.withColumn("r2_from_others", F.round(F.col("r2_from_others") + 1e-9, 6))


@query()
def red01_forest_scores(t: Tables) -> DataFrame:
    """A wave of a column is a copy that only the forest sees."""
    rows = t.part.select(F.col("p_size").cast("double").alias("size"), F.cos(F.col("p_size") / 8).alias("wave"), F.col("p_retailprice").alias("price"))
    return redundancy.redundancy_scores(rows, ["size", "wave", "price"], trees=20)


@query()
def red04_minimal_removals(t: Tables) -> DataFrame:
    gone = redundancy.minimal_removals(t.lineitem, "l_extendedprice", _COLUMNS, 0.5)
    return t.spark.createDataFrame([(c,) for c in gone], "feature string")


@query(_shapley_sql())
def red07_shapley_of_columns(t: Tables) -> DataFrame:
    return redundancy.shapley(redundancy.coalition_values(t.lineitem, "l_extendedprice", _COLUMNS), _COLUMNS).withColumn("shapley", F.round("shapley", 9))


@query()
def red09_noise_floor(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(redundancy.noise_floor(t.lineitem, "l_extendedprice", _COLUMNS),)], "floor double")


@query(_losses_sql("feature", {c: [o for o in _COLUMNS if o != c] for c in _COLUMNS}))
def red10_leave_one_out(t: Tables) -> DataFrame:
    return redundancy.leave_one_out(t.lineitem, "l_extendedprice", _COLUMNS).withColumn("loss", F.round("loss", 9))


@query(_losses_sql("\"group\"", {"amount": ["l_discount", "l_tax"], "rates": ["l_quantity"]}))
def red05_group_losses(t: Tables) -> DataFrame:
    r2 = redundancy.scorer(t.lineitem, ["l_extendedprice", *_COLUMNS])
    losses = learning.group_losses(lambda own: r2("l_extendedprice", own), {"amount": ["l_quantity"], "rates": ["l_discount", "l_tax"]})
    return t.spark.createDataFrame(losses, "group string, loss double").withColumn("loss", F.round("loss", 9))


@query()
def reg05_panel_ridge(t: Tables) -> DataFrame:
    partners = pairs.top_partners(t.embeddings, "vec_id", "embedding", "label", 5)
    return learning.panel_ridge(t.embeddings, partners, "vec_id", "embedding")


@query()
def reg06_forest_r2(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("a"), (F.col("p_partkey") % 100).cast("double").alias("b"))
    return t.spark.createDataFrame([(redundancy.forest_r2(rows, "y", ["a", "b"], trees=20),)], "r2 double")


@query()
def nn08_gate_importance(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("y", (F.col("l_quantity") > 25).cast("int"))
    return importance.summarise(importance.run_gates(rows, _COLUMNS, "y", runs=4, sample_rows=2000, epochs=15))


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('1:' || event_id), event_id) * 5 <= count(*) OVER (PARTITION BY event_type) * 3 AS train FROM events")
def prep01_stratified_split(t: Tables) -> DataFrame:
    order = F.md5(F.concat(F.lit("1:"), F.col("event_id").cast("string")).cast("binary"))
    rows = t.events.select("event_id", "event_type")
    return ranks.first_by_hash(rows, ["event_type"], order, "event_id", F.floor(F.col("n") * 3 / 5), name="train").select("event_id", "train")


@query("SELECT event_id, count(*) OVER () / (5.0 * count(*) OVER (PARTITION BY event_type))::DOUBLE AS weight FROM events")
def prep05_class_weights(t: Tables) -> DataFrame:
    counts = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("c"))
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"))
    weights = counts.join(F.broadcast(sums)).select("event_type", (F.col("n") / (F.col("k") * F.col("c"))).alias("weight"))
    return t.events.join(F.broadcast(weights), "event_type").select("event_id", "weight")


@query("SELECT doc_id, round(coalesce(CASE WHEN doc_id % 3 <> 0 THEN n_chars END, avg(CASE WHEN doc_id % 3 <> 0 THEN n_chars END) OVER (PARTITION BY lang)), 6) AS filled FROM documents")
def prep06_mean_imputation(t: Tables) -> DataFrame:
    masked = t.documents.withColumn("x", F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")).cast("double"))
    means = masked.groupBy(F.col("lang").alias("_l")).agg(F.avg("x").alias("_m"))
    return masked.join(F.broadcast(means), F.col("lang").eqNullSafe(F.col("_l"))).select("doc_id", F.round(F.coalesce("x", "_m"), 6).alias("filled"))


@query("SELECT o_orderkey, ('0x' || left(md5('9:' || o_orderkey), 8))::BIGINT % 5 AS fold FROM orders")
def prep08_folds(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", (F.conv(F.substring(F.md5(F.concat(F.lit("9:"), F.col("o_orderkey").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 5).alias("fold"))


@query("SELECT vec_id, round(2 * list_dot_product(embedding::DOUBLE[], q.e) / (list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) + list_dot_product(q.e, q.e)), 6) AS proximity FROM embeddings, (SELECT embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 1) q")
def red20_named_proximity(t: Tables) -> DataFrame:
    first = t.embeddings.orderBy("vec_id").limit(1).select(F.col("embedding").cast("array<double>").alias("e"))
    return t.embeddings.join(F.broadcast(first)).select("vec_id", F.round(scalar.proximity(F.col("embedding"), F.col("e")), 6).alias("proximity"))


