"""Relational queries: projections, filters, joins, aggregates, windows, top-k, sets and reshapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks, scalar
from ..operators import relational as R
from .catalogue import Tables, query


# -- projections and filters -------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, l_tax / nullif(l_discount, 0) AS ratio FROM lineitem WHERE l_quantity >= 49")
def prj02_computed_columns(t: Tables) -> DataFrame:
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)
    return t.lineitem.where("l_quantity >= 49").select("l_orderkey", "l_linenumber", net.alias("net"), F.try_divide("l_tax", "l_discount").alias("ratio"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS role, CAST(c_acctbal > 0 AS INT) AS positive, n_name AS label, 'arm1' AS arm FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def prj04_case_lookup_constant(t: Tables) -> DataFrame:
    role = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "low").otherwise("high")
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return named.select("c_custkey", role.alias("role"), (F.col("c_acctbal") > 0).cast("int").alias("positive"), F.col("n_name").alias("label"), F.lit("arm1").alias("arm"))


@query("SELECT doc_id, lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL")
def flt01_drop_nulls(t: Tables) -> DataFrame:
    return t.documents.dropna(subset=["lang", "source", "text"]).select("doc_id", "lang", "source")


@query("SELECT count(*) AS rows_kept, 'doc_id,toxic' AS columns_kept FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL")
def flt02_column_coverage(t: Tables) -> DataFrame:
    masked = t.labels.withColumn("quality", F.when(F.col("doc_id") % 2 == 0, F.col("quality")))
    kept = R.covered_columns(masked, 0.8)
    return masked.select(*kept).dropna().agg(F.count(F.lit(1)).alias("rows_kept")).withColumn("columns_kept", F.lit(",".join(kept)))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 HAVING stddev_pop(value) > 1e-12) GROUP BY 1")
def flt03_varying_groups(t: Tables) -> DataFrame:
    return R.varying_groups(t.events, "event_type", "value").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT l_partkey, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS d FROM lineitem GROUP BY 1),
e AS (SELECT * FROM s WHERE m >= 30000) SELECT l_partkey, round(m + 1e-6, 3) AS m, round(d + 1e-6, 3) AS d FROM e WHERE d >= (SELECT quantile_cont(d, 0.2) FROM e)""")
def flt05_expressed_and_variable(t: Tables) -> DataFrame:
    kept = R.expressed_and_variable(t.lineitem, "l_partkey", "l_extendedprice", 30000, 0.2)
    return kept.select("l_partkey", F.round(F.col("mean") + 1e-6, 3).alias("m"), F.round(F.col("spread") + 1e-6, 3).alias("d"))


@query("SELECT l_partkey, count(*) FILTER (WHERE l_discount >= 0.05) AS hits FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_discount >= 0.05) >= 3")
def flt06_count_of_condition(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.count_if(F.col("l_discount") >= 0.05).alias("hits")).where("hits >= 3")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10 AND l_discount < 0.03 AND l_tax < 0.03")
def flt07_all_below(t: Tables) -> DataFrame:
    limits = {"l_quantity": 10, "l_discount": 0.03, "l_tax": 0.03}
    return t.lineitem.where(scalar.all_of([F.col(c) < x for c, x in limits.items()])).select("l_orderkey", "l_linenumber")


@query("SELECT user_id, count(*) AS n, bool_and(value <= 400) AS clean FROM events GROUP BY 1 HAVING count(*) >= 5 AND bool_and(value IS NOT NULL)")
def flt09_group_minimum(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("value") <= 400).alias("clean"), F.bool_and(F.col("value").isNotNull()).alias("full")).where("n >= 5 AND full").drop("full")


@query("""SELECT e.event_id FROM events e WHERE e.event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM events x WHERE x.event_type = 'error' AND x.user_id = e.user_id AND x.ts BETWEEN e.ts - INTERVAL 300 SECOND AND e.ts + INTERVAL 300 SECOND)""")
def flt12_interval_clearance(t: Tables) -> DataFrame:
    return R.clear_of(t.events.where("event_type <> 'error'"), t.events.where("event_type = 'error'"), "ts", 300, ["user_id"]).select("event_id")


@query("SELECT event_id, greatest(least(value, 20), -20) AS clipped, CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 0 ELSE value END AS fine FROM events")
def flt14_clip_and_finite(t: Tables) -> DataFrame:
    return t.events.select("event_id", scalar.clip(F.col("value"), -20.0, 20.0).alias("clipped"), scalar.finite_or(F.col("value"), 0.0).alias("fine"))


# -- joins -------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def join01_inner(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey IN (SELECT s_suppkey FROM supplier)")
def join02_three_way_keys(t: Tables) -> DataFrame:
    return R.common_keys([(t.customer, "c_custkey"), (t.orders, "o_custkey"), (t.supplier, "s_suppkey")]).select(F.col("key").alias("c_custkey"))


@query("SELECT d.doc_id, d.n_chars, l.quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def join04_left_with_default(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", "n_chars", "quality", F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("WITH a AS (SELECT o_custkey AS k, count(*) AS orders FROM orders GROUP BY 1), b AS (SELECT s_suppkey AS k, s_acctbal AS balance FROM supplier) SELECT k, orders, balance FROM a FULL JOIN b USING (k)")
def join05_full_outer(t: Tables) -> DataFrame:
    a = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("orders"))
    return a.join(t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance")), "k", "full")


@query("""WITH m AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2)
SELECT a.user_id, a.event_type, round(a.v - b.v, 6) AS delta FROM m a JOIN m b ON a.user_id = b.user_id AND b.event_type = 'view' AND a.event_type <> 'view'""")
def join07_paired_delta(t: Tables) -> DataFrame:
    means = t.events.groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return R.paired_delta(means, ["user_id"], "event_type", "view", "v").select("user_id", "event_type", F.round("delta", 6).alias("delta"))


@query("""WITH b AS (SELECT list_distinct(list(l_partkey)) AS parts, l_orderkey FROM lineitem GROUP BY 2)
SELECT l_orderkey, list_has_any(parts, [1, 2, 3, 5, 8, 13]) AS hit FROM b""")
def join09_any_overlap(t: Tables) -> DataFrame:
    wanted = t.spark.createDataFrame([(k,) for k in (1, 2, 3, 5, 8, 13)], "l_partkey long")
    hits = t.lineitem.join(F.broadcast(wanted), "l_partkey", "left_semi").select("l_orderkey", F.lit(True).alias("hit")).distinct()
    return t.lineitem.select("l_orderkey").distinct().join(hits, "l_orderkey", "left").select("l_orderkey", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
def join10_unordered_pairs(t: Tables) -> DataFrame:
    return R.unordered_pairs(t.nation, "n_nationkey", "n_regionkey")


@query("SELECT a.r_regionkey AS i, b.r_regionkey AS j FROM region a, region b WHERE a.r_regionkey <> b.r_regionkey")
def join11_ordered_pairs(t: Tables) -> DataFrame:
    keys = t.region.select("r_regionkey")
    return keys.withColumnRenamed("r_regionkey", "i").join(keys.withColumnRenamed("r_regionkey", "j"), F.col("i") != F.col("j"))


@query("""WITH o AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS p, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7:' || c_custkey), c_custkey) AS q FROM customer)
SELECT a.c_custkey, b.c_custkey AS ghost FROM o a JOIN o b ON a.c_mktsegment = b.c_mktsegment AND a.p = b.q""")
def join12_permuted_keys(t: Tables) -> DataFrame:
    return R.permuted(t.customer, "c_custkey", 7, ["c_mktsegment"]).select("c_custkey", "ghost")


@query("""WITH g AS (SELECT a.r_regionkey AS x, b.n_nationkey AS y FROM region a, nation b WHERE b.n_nationkey < 5) SELECT x, y FROM g WHERE (x, y) NOT IN (SELECT (n_regionkey, n_nationkey) FROM nation)""")
def join15_grid_minus_done(t: Tables) -> DataFrame:
    done = t.nation.select(F.col("n_regionkey").alias("x"), F.col("n_nationkey").alias("y"))
    return R.remaining_grid(t.spark, {"x": [0, 1, 2, 3, 4], "y": [0, 1, 2, 3, 4]}, done)


# -- aggregates --------------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS low, max(l_quantity) AS high, round(sum(l_extendedprice), 2) AS total, arg_min(l_partkey, (l_orderkey, l_linenumber)) AS first_part FROM lineitem GROUP BY 1, 2")
def agg02_named_aggregates(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.min_by("l_partkey", F.struct("l_orderkey", "l_linenumber")).alias("first_part"))


@query("SELECT event_type, median(value) FILTER (WHERE user_id % 2 = 0) AS even, median(value) FILTER (WHERE user_id % 2 = 1) AS odd FROM events GROUP BY 1")
def agg03_median_unstacked(t: Tables) -> DataFrame:
    side = F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")
    return R.pivot_fixed(t.events, ["event_type"], side, ["even", "odd"], F.median, "value")


@query("SELECT l_returnflag, round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 9) AS pooled FROM lineitem GROUP BY 1")
def agg04_pooled_ratio(t: Tables) -> DataFrame:
    return R.pooled_ratio(t.lineitem, ["l_returnflag"], F.col("l_discount") * F.col("l_extendedprice"), F.col("l_extendedprice")).select("l_returnflag", F.round("ratio", 9).alias("pooled"))


@query("SELECT o_orderpriority, quantile_cont(o_totalprice, 0.025) AS low, quantile_cont(o_totalprice, 0.5) AS mid, quantile_cont(o_totalprice, 0.975) AS high, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr FROM orders GROUP BY 1")
def agg11_percentiles(t: Tables) -> DataFrame:
    q = F.percentile("o_totalprice", F.array(*map(F.lit, (0.025, 0.25, 0.5, 0.75, 0.975))))
    return t.orders.groupBy("o_orderpriority").agg(q.alias("q")).selectExpr("o_orderpriority", "q[0] AS low", "q[2] AS mid", "q[4] AS high", "q[3] - q[1] AS iqr")


@query("WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1) SELECT CASE WHEN n < 300 THEN 'other' ELSE p_type END AS kind, sum(n)::BIGINT AS parts FROM c GROUP BY 1")
def agg07_rare_pooled(t: Tables) -> DataFrame:
    return R.pool_rare(t.part, "p_type", 300).groupBy(F.col("p_type").alias("kind")).agg(F.count(F.lit(1)).alias("parts"))


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, avg(CAST(o_totalprice > 250000 AS INT)) AS large, bool_or(o_totalprice > 450000) AS any_huge, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS top FROM orders GROUP BY 1")
def agg09_fractions_and_best(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    return t.orders.groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("customers"), F.avg((price > 250000).cast("int")).alias("large"), F.bool_or(price > 450000).alias("any_huge"), F.max_by("o_orderkey", F.struct(price, -F.col("o_orderkey"))).alias("top"))


@query("SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS samp, round(stddev_pop(l_quantity), 6) AS pop, round(avg(abs(l_discount - l_tax)), 9) AS gap FROM lineitem GROUP BY 1")
def agg13_spreads(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.stddev_samp("l_quantity"), 6).alias("samp"), F.round(F.stddev_pop("l_quantity"), 6).alias("pop"), F.round(F.avg(F.abs(F.col("l_discount") - F.col("l_tax"))), 9).alias("gap"))


@query("WITH b AS (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY 1, 2), w AS (SELECT user_id, arg_max(event_type, (round(v, 6), event_type)) AS winner FROM b GROUP BY 1) SELECT winner, count(*) AS wins FROM w GROUP BY 1")
def agg15_winners(t: Tables) -> DataFrame:
    sums = t.events.groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 6).alias("v"))
    return sums.groupBy("user_id").agg(F.max_by("event_type", F.struct("v", "event_type")).alias("winner")).groupBy("winner").agg(F.count(F.lit(1)).alias("wins"))


@query("""WITH c AS (SELECT max(value) AS m FROM events WHERE event_type = 'error') SELECT event_type, min(value) AS least, min(value) > (SELECT m FROM c) AS apart FROM events WHERE event_type <> 'error' GROUP BY 1""")
def agg16_separation(t: Tables) -> DataFrame:
    floor = t.events.where("event_type = 'error'").agg(F.max("value").alias("m"))
    return t.events.where("event_type <> 'error'").groupBy("event_type").agg(F.min("value").alias("least")).withColumn("apart", F.col("least") > floor.scalar())


@query("""WITH m AS (SELECT median(n_chars) AS m FROM documents), x AS (SELECT d.n_chars > (SELECT m FROM m) AS p, l.quality = 1 AS y FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL),
c AS (SELECT count(*) FILTER (WHERE p AND y) AS tp, count(*) FILTER (WHERE p AND NOT y) AS fp, count(*) FILTER (WHERE NOT p AND y) AS fn, count(*) FILTER (WHERE NOT p AND NOT y) AS tn FROM x)
SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced FROM c""")
def agg18_confusion(t: Tables) -> DataFrame:
    middle = t.documents.agg(F.median("n_chars").alias("m")).first()["m"]
    joined = t.documents.join(t.labels.where("quality IS NOT NULL"), "doc_id")
    return R.confusion(joined, F.col("n_chars") > middle, F.col("quality") == 1)


@query("WITH s AS (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_linestatus, q / sum(q) OVER (PARTITION BY l_returnflag) AS share FROM s")
def agg24_shares(t: Tables) -> DataFrame:
    sums = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))
    return R.shares(sums, ["l_returnflag"], "q").select("l_returnflag", "l_linestatus", "share")


@query("WITH g AS (SELECT p_brand, sum(p_retailprice) AS v FROM part WHERE p_size > 45 GROUP BY 1) SELECT b.p_brand, round(coalesce(g.v, 0), 4) AS total FROM (SELECT DISTINCT p_brand FROM part) b LEFT JOIN g USING (p_brand)")
def agg23_group_sums_with_zero(t: Tables) -> DataFrame:
    sums = t.part.where("p_size > 45").groupBy("p_brand").agg(F.sum("p_retailprice").alias("v"))
    return t.part.select("p_brand").distinct().join(sums, "p_brand", "left").select("p_brand", F.round(F.coalesce("v", F.lit(0.0)), 4).alias("total"))


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1e-9, 6) AS prefix_mean FROM events")
def agg29_prefix_mean(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("user_id", "event_id", F.round(F.avg("value").over(w) + 1e-9, 6).alias("prefix_mean"))


@query("WITH p AS (SELECT o_custkey, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS s FROM orders GROUP BY 1) SELECT count(DISTINCT s) / count(*) AS distinct_fraction FROM p")
def agg31_distinct_patterns(t: Tables) -> DataFrame:
    patterns = t.orders.groupBy("o_custkey").agg(F.concat_ws("|", F.sort_array(F.collect_set("o_orderpriority"))).alias("s"))
    return patterns.groupBy("s").agg(F.count(F.lit(1)).alias("n")).agg((F.count(F.lit(1)) / F.sum("n")).alias("distinct_fraction"))


@query("WITH m AS (SELECT avg(value) FILTER (WHERE event_type = 'click') AS a, avg(value) FILTER (WHERE event_type = 'view') AS b, avg(value) FILTER (WHERE event_type = 'error') AS c FROM events) SELECT round((a - b) / nullif(a - c, 0), 6) AS first_share, round((b - c) / nullif(a - c, 0), 6) AS second_share FROM m")
def agg32_gap_shares(t: Tables) -> DataFrame:
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    m = t.events.agg(mean("click").alias("a"), mean("view").alias("b"), mean("error").alias("c"))
    return m.select(F.round(F.try_divide(F.col("a") - F.col("b"), F.col("a") - F.col("c")), 6).alias("first_share"), F.round(F.try_divide(F.col("b") - F.col("c"), F.col("a") - F.col("c")), 6).alias("second_share"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 9) AS mean FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_ext_rollup(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 9).alias("mean"))


# -- windows, order, top-k ---------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS by_position, rank() OVER w AS by_min,
rank() OVER w + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS by_average, (rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2) / count(*) OVER (PARTITION BY p_brand) AS pct
FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size DESC)""")
def win01_rank_flavours(t: Tables) -> DataFrame:
    by = ["p_brand"]
    return t.part.select("p_partkey", ranks.position_rank(by, "p_size", "p_partkey", descending=True).alias("by_position"), ranks.min_rank(by, "p_size", True).alias("by_min"), ranks.average_rank(by, "p_size", True).alias("by_average"), ranks.pct_rank(by, "p_size").alias("pct"))


@query("WITH n AS (SELECT value FROM events WHERE event_type = 'error') SELECT event_id, (SELECT count(*) FROM n WHERE n.value < e.value) / (SELECT count(*) FROM n) AS pct FROM events e WHERE event_type = 'click'")
def win05_percentile_vs_negatives(t: Tables) -> DataFrame:
    return R.percentile_against(t.events.where("event_type = 'click'"), t.events.where("event_type = 'error'"), "value", "event_id")


@query("SELECT event_id, round(coalesce((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 0), 6) AS z FROM events WINDOW w AS (PARTITION BY user_id)")
def win06_group_zscore(t: Tables) -> DataFrame:
    return R.zscore(t.events, ["user_id"], "value").select("event_id", F.round("z", 6).alias("z"))


@query("""WITH o AS (SELECT doc_id, toxic, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS p, row_number() OVER (PARTITION BY quality ORDER BY md5('3:' || doc_id), doc_id) AS q FROM labels)
SELECT a.doc_id, b.toxic AS shuffled FROM o a JOIN o b ON a.quality IS NOT DISTINCT FROM b.quality AND a.p = b.q""")
def win07_shuffled_labels(t: Tables) -> DataFrame:
    order = R.permuted(t.labels, "doc_id", 3, ["quality"]).select("doc_id", "ghost")
    return order.join(t.labels.select(F.col("doc_id").alias("ghost"), F.col("toxic").alias("shuffled")), "ghost").select("doc_id", "shuffled")


@query("""WITH r AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1), c AS (SELECT v, sum(v) OVER (ORDER BY v DESC, o_custkey) / sum(v) OVER () AS s FROM r)
SELECT count(*) FILTER (WHERE s < 0.95) + 1 AS n_95, round(sum(v) FILTER (WHERE s <= 0.5) / sum(v), 6) AS half_share FROM c""")
def win14_cumulative_share(t: Tables) -> DataFrame:
    revenue = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    runs = ranks.running_counts(revenue, "v", {"s": F.col("v"), "n": F.lit(1).cast("long")}, descending=True)
    total = revenue.agg(F.sum("v").alias("total"))
    share = (F.col("s_before") + F.col("s")) / F.col("total")
    return runs.join(F.broadcast(total)).agg((F.sum(F.when(share < 0.95, F.col("n")).otherwise(0)) + 1).alias("n_95"), F.round(F.sum(F.when(share <= 0.5, F.col("s"))) / F.first("total"), 6).alias("half_share"))


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type) AS of_kind FROM events")
def win15_count_per_value(t: Tables) -> DataFrame:
    return t.events.join(F.broadcast(t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("of_kind"))), "event_type").select("event_id", "of_kind")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def srt03_largest(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT user_id, event_id, r FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3")
def srt05_top_per_group(t: Tables) -> DataFrame:
    return R.top_per_group(t.events, ["user_id"], [F.desc("value"), F.asc("event_id")], 3).select("user_id", "event_id", F.col("rank").alias("r"))


@query("SELECT user_id, round(sum(value) FILTER (WHERE r <= 4) / nullif(sum(value), 0), 6) AS top4 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) GROUP BY 1")
def srt06_top_share(t: Tables) -> DataFrame:
    return R.top_share(t.events, ["user_id"], "value", "event_id", 4).select("user_id", F.round("share", 6).alias("top4"))


@query("""WITH x AS (SELECT CAST(quality = 1 AS INT) AS y, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)
SELECT k, sum(y)::BIGINT AS hits, sum(y) / k AS precision, sum(y) / (SELECT sum(y) FROM x) AS recall FROM x, (VALUES (10), (20), (50), (100)) AS ks(k) WHERE r <= k GROUP BY k""")
def srt07_operating_curve(t: Tables) -> DataFrame:
    joined = t.documents.join(t.labels.where("quality IS NOT NULL"), "doc_id")
    return R.operating_curve(joined, [F.desc("n_chars"), F.asc("doc_id")], F.col("quality") == 1, [10, 20, 50, 100])


# -- sets and reshapes -------------------------------------------------------------------------------------------------


@query("SELECT 'customer' AS kind, c_nationkey AS k, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier")
def set01_union_all(t: Tables) -> DataFrame:
    a = t.customer.select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_nationkey").cast("int").alias("k"), F.col("s_acctbal").alias("balance")))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set03_difference(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).distinct().join(t.orders, F.col("k") == F.col("o_custkey"), "left_anti")


@query("""WITH m AS (SELECT 'price' AS method, p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part UNION ALL SELECT 'size', p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) FROM part UNION ALL SELECT 'key', p_partkey, row_number() OVER (ORDER BY p_partkey DESC) FROM part)
SELECT p_partkey, count(*) AS in_how_many, count(*) = 3 AS consensus FROM m WHERE r <= 100 GROUP BY 1""")
def set04_consensus(t: Tables) -> DataFrame:
    return R.consensus(_top_parts(t), "p_partkey", 3)


@query("""WITH m AS (SELECT 'price' AS method, p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part UNION ALL SELECT 'size', p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) FROM part UNION ALL SELECT 'key', p_partkey, row_number() OVER (ORDER BY p_partkey DESC) FROM part),
s AS (SELECT method, p_partkey FROM m WHERE r <= 100), n AS (SELECT method, count(*) AS n FROM s GROUP BY 1), o AS (SELECT a.method AS m1, b.method AS m2, count(*) AS shared FROM s a JOIN s b USING (p_partkey) GROUP BY 1, 2)
SELECT m1, m2, shared, shared / (x.n + y.n - shared) AS jaccard FROM o JOIN n x ON m1 = x.method JOIN n y ON m2 = y.method""")
def set05_overlap_matrix(t: Tables) -> DataFrame:
    return R.overlap_matrix(_top_parts(t), "method", "p_partkey")


def _top_parts(t: Tables) -> DataFrame:
    orders = {"price": [F.desc("p_retailprice"), F.asc("p_partkey")], "size": [F.desc("p_size"), F.asc("p_partkey")], "key": [F.desc("p_partkey")]}
    tops = [t.part.orderBy(*o).limit(100).select(F.lit(m).alias("method"), "p_partkey") for m, o in orders.items()]
    return tops[0].unionByName(tops[1]).unionByName(tops[2])


@query("SELECT min(o_orderkey) AS o_orderkey, o_custkey, o_orderstatus FROM orders GROUP BY 2, 3")
def set06_drop_duplicates(t: Tables) -> DataFrame:
    return R.first_of_each(t.orders, ["o_custkey", "o_orderstatus"], "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT a.r_regionkey AS a, b.r_regionkey AS b, c.r_regionkey AS c FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey JOIN region c ON b.r_regionkey < c.r_regionkey")
def set07_combinations(t: Tables) -> DataFrame:
    return R.combinations(t.region, "r_regionkey", ["a", "b", "c"])


@query("SELECT true AS equal_tables")
def set08_table_equality(t: Tables) -> DataFrame:
    again = t.orders.select(*t.orders.columns).repartition(3)
    return t.spark.createDataFrame([(R.same_rows(t.orders, again),)], "equal_tables boolean")


@query("SELECT event_type, round(avg(value) FILTER (WHERE hour(ts) % 4 = 0), 6) AS h0, round(avg(value) FILTER (WHERE hour(ts) % 4 = 1), 6) AS h1, round(avg(value) FILTER (WHERE hour(ts) % 4 = 2), 6) AS h2, round(avg(value) FILTER (WHERE hour(ts) % 4 = 3), 6) AS h3 FROM events GROUP BY 1")
def rsh01_pivot_mean(t: Tables) -> DataFrame:
    part = F.concat(F.lit("h"), (F.hour("ts") % 4).cast("string"))
    return R.pivot_fixed(t.events, ["event_type"], part, ["h0", "h1", "h2", "h3"], lambda c: F.round(F.avg(c), 6), "value")


@query("SELECT user_id, avg(value) FILTER (WHERE event_type = 'click') AS click, avg(value) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1 HAVING avg(value) FILTER (WHERE event_type = 'click') IS NOT NULL AND avg(value) FILTER (WHERE event_type = 'view') IS NOT NULL")
def rsh04_paired_rows(t: Tables) -> DataFrame:
    return R.pivot_fixed(t.events, ["user_id"], F.col("event_type"), ["click", "view"], F.avg, "value").dropna()


@query("SELECT vec_id, i - 1 AS place, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) AS r(i) WHERE vec_id < 100")
def rsh06_wide_to_long(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id < 100").select("vec_id", F.posexplode("embedding").alias("place", "x")).select("vec_id", F.col("place").cast("long").alias("place"), F.col("x").cast("double").alias("x"))


@query("SELECT c_custkey, CAST(c_mktsegment = 'AUTOMOBILE' AS INT) AS automobile, CAST(c_mktsegment = 'BUILDING' AS INT) AS building, CAST(c_mktsegment = 'MACHINERY' AS INT) AS machinery FROM customer")
def rsh07_one_hot(t: Tables) -> DataFrame:
    return R.one_hot(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", {"AUTOMOBILE": "automobile", "BUILDING": "building", "MACHINERY": "machinery"})


# -- scalar functions --------------------------------------------------------------------------------------------------


@query(r"""SELECT p_partkey, split_part(p_name, ' (', 1) AS before, regexp_extract(p_brand, '([A-Za-z'']+)#?([0-9]+)$', 2) AS number, regexp_matches(p_type, '^[A-E]') AS early, lower(trim(p_brand)) IN ('yes', '1') AS truth FROM part""")
def scl01_strings(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", scalar.text_before(F.col("p_name"), " (").alias("before"), F.regexp_extract("p_brand", "([A-Za-z']+)#?([0-9]+)$", 2).alias("number"), F.col("p_type").rlike("^[A-E]").alias("early"), F.lower(F.trim("p_brand")).isin("yes", "1").alias("truth"))


@query(r"""WITH b AS (SELECT p_partkey, upper(replace(p_brand, '#', '')) || 'A' || p_partkey AS s FROM part), c AS (SELECT *, regexp_replace(s, '[0-9]+$', '') AS bare FROM b),
d AS (SELECT *, CASE WHEN length(bare) > 3 AND regexp_matches(bare, '[A-Z]$') THEN left(bare, -1) ELSE bare END AS cut FROM c) SELECT p_partkey, CASE WHEN length(cut) >= 3 THEN cut ELSE s END AS root FROM d""")
def scl02_symbol_root(t: Tables) -> DataFrame:
    name = F.concat(F.upper(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("A"), F.col("p_partkey").cast("string"))
    return t.part.select("p_partkey", scalar.symbol_root(name).alias("root"))


@query("SELECT o_orderkey, least(dayofyear(o_orderdate), 365) AS day FROM orders")
def scl12_day_of_year(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", scalar.day_of_year(F.col("o_orderdate")).alias("day"))


@query("SELECT event_id, round(0.5 * (1 + tanh(0.5 * value / 100)), 9) AS s, round(greatest(value / 100, 0) + ln(1 + exp(-abs(value / 100))), 9) AS p FROM events")
def scl15_sigmoid_softplus(t: Tables) -> DataFrame:
    x = F.col("value") / 100
    return t.events.select("event_id", F.round(scalar.sigmoid(x), 9).alias("s"), F.round(scalar.softplus(x), 9).alias("p"))


@query("SELECT l_orderkey, l_linenumber, greatest(ceil(round(l_discount / 0.02, 9)) - 1, 0)::INT AS r, least(floor(round(l_discount / 0.02, 9)), 4)::INT AS l FROM lineitem")
def scl18_bins(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", scalar.right_closed_bin(F.col("l_discount"), 0.02, 5).alias("r"), scalar.left_closed_bin(F.col("l_discount"), 0.02, 5).alias("l"))


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS norm2, round(list_dot_product(embedding[2:]::DOUBLE[], embedding[2:]::DOUBLE[]), 6) AS without_first FROM embeddings")
def scl20_array_products(t: Tables) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    cut = scalar.zero_at(e, [0])
    return t.embeddings.select("vec_id", F.round(scalar.dot(e, e), 6).alias("norm2"), F.round(scalar.dot(cut, cut), 6).alias("without_first"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def scl22_json_dig(t: Tables) -> DataFrame:
    return t.events.select("event_id", scalar.dig(F.col("props"), "k").alias("k"))


@query("SELECT event_id, round(value / 0.5) * 0.5 AS snapped, round(value / 1000 * 127 + 128)::INT AS code FROM events")
def scl25_snap_and_quantise(t: Tables) -> DataFrame:
    return t.events.select("event_id", scalar.snap(F.col("value"), F.lit(1.0), 0.5).alias("snapped"), scalar.quantise(F.col("value"), F.lit(1000.0)).alias("code"))
