"""Scans, filters, joins, aggregates, selections and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaylark.operators import ordering
from quaylark.operators import relational as R
from quaylark.plans.registry import query
from quaylark.plans.tables import DAILY, NEWS, PRICES, RETURNS, cents, daily, news, prices, rounded, table

GROUPS = {"click": "market", "error": "legal", "purchase": "firm"}


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-04-01' AND l_discount BETWEEN 0.03 AND 0.05 AND l_returnflag IN ('A', 'N') AND l_quantity IS NOT NULL")
def scan_project_filter(spark, d):
    rows = table(spark, d, "lineitem")
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    return rows.where((F.col("l_shipdate") >= day("1997-01-01 00:00:00")) & (F.col("l_shipdate") < day("1997-04-01 00:00:00")) & F.col("l_discount").between(0.03, 0.05) & F.col("l_returnflag").isin("A", "N") & F.col("l_quantity").isNotNull()).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey, p_brand FROM part WHERE regexp_full_match(p_brand, 'Brand#[0-9]') AND length(p_brand) = 7")
def regex_fullmatch_filter(spark, d):
    return table(spark, d, "part").where(F.col("p_brand").rlike("^Brand#[0-9]$") & (F.length("p_brand") == 7)).select("p_partkey", "p_brand")


@query("SELECT event_id, CASE WHEN value > 200 THEN 'large' WHEN event_type = 'error' THEN 'fault' WHEN value < 5 THEN 'small' ELSE 'other' END AS kind FROM events")
def case_ordered(spark, d):
    return table(spark, d, "events").select("event_id", R.ordered_case([(F.col("value") > 200, "large"), (F.col("event_type") == "error", "fault"), (F.col("value") < 5, "small")], "other").alias("kind"))


@query("SELECT event_id, CASE WHEN value < 5 THEN 'small' WHEN event_type = 'error' THEN 'fault' WHEN value > 200 THEN 'large' ELSE 'other' END AS stage FROM events")
def case_last_match(spark, d):
    return table(spark, d, "events").select("event_id", R.last_case([(F.col("value") > 200, "large"), (F.col("event_type") == "error", "fault"), (F.col("value") < 5, "small")], "other").alias("stage"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'market' WHEN 'error' THEN 'legal' WHEN 'purchase' THEN 'firm' ELSE 'other' END AS grp FROM events")
def dim_lookup_default(spark, d):
    dim = spark.createDataFrame(list(GROUPS.items()), "event_type string, grp string")
    return R.lookup(table(spark, d, "events"), F.broadcast(dim), ["event_type"], {"grp": "other"}).select("event_id", "grp")


@query("SELECT event_id, CASE WHEN z IS NULL THEN NULL WHEN abs(z) > 0.5 THEN CAST(sign(z) AS INTEGER) ELSE 0 END AS class, CASE WHEN z IS NOT NULL THEN CASE WHEN z > 1 THEN 1e0 ELSE 0e0 END END AS big FROM (SELECT event_id, nullif(round((value - 50) / 40, 3), 0.5) AS z FROM events)")
def three_class_flags(spark, d):
    rows = table(spark, d, "events").withColumn("z", F.nullif(rounded((F.col("value") - 50) / 40, 3), F.lit(0.5)))
    return rows.select("event_id", R.three_classes(F.col("z")).alias("class"), R.flag(F.col("z") > 1, F.col("z")).alias("big"))


@query("WITH q AS (SELECT quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM events WHERE ts < TIMESTAMP '2024-01-20') SELECT event_id, round(least(greatest(value, a), b), 6) AS value FROM events, q")
def winsorize_train(spark, d):
    return R.winsorized(table(spark, d, "events"), F.col("ts") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), ["value"]).select("event_id", F.round("value", 6).alias("value"))


@query(f"WITH {RETURNS}, m AS (SELECT quantile_cont(r, 0.5) AS m FROM ret WHERE date < DATE '2000-01-01') SELECT date, ticker, round(coalesce(r, m), 6) AS r FROM ret, m")
def median_impute(spark, d):
    from quaylark.operators import series as S
    from quaylark.plans.tables import panel

    rows = panel(spark, d).withColumn("r", S.log_return())
    return R.imputed(rows, F.col("date") < F.lit("2000-01-01").cast("date"), ["r"]).select("date", "ticker", F.round("r", 6).alias("r"))


@query(f"WITH {RETURNS} SELECT count(*) AS n, count(DISTINCT ticker) AS tickers FROM ret WHERE r IS NOT NULL AND volume IS NOT NULL")
def drop_missing(spark, d):
    from quaylark.operators import series as S
    from quaylark.plans.tables import panel

    return panel(spark, d).withColumn("r", S.log_return()).na.drop(subset=["r", "volume"]).agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("tickers"))


@query("SELECT l.doc_id, l.quality FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = l.doc_id AND length(x.text) < 200)")
def short_articles_anti(spark, d):
    short = table(spark, d, "documents").where(F.length("text") < 200).select("doc_id")
    return table(spark, d, "labels").join(short, "doc_id", "left_anti").select("doc_id", "quality")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def semi_known_keys(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_company_only(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT c.c_custkey, coalesce(o.n, 0) AS n, coalesce(o.spent, 0) AS spent FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey")
def left_outer_fill(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return R.lookup(table(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], {"n": 0, "spent": 0.0})


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dimension_chain(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@query(f"WITH {PRICES} SELECT a.date, a.ticker, a.close, b.close AS close_other FROM prices a LEFT JOIN prices b ON a.date = b.date AND b.ticker = 'Brand#' || CAST(CAST(substr(a.ticker, 7) AS INTEGER) + 1 AS VARCHAR)")
def composite_lookup(spark, d):
    p = prices(spark, d)
    other = p.select("date", F.concat(F.lit("Brand#"), (F.substring("ticker", 7, 9).cast("int") - 1).cast("string")).alias("ticker"), F.col("close").alias("close_other"))
    return R.lookup(p.select("date", "ticker", "close"), other, ["date", "ticker"])


@query("WITH e AS (SELECT DISTINCT user_id AS ticker, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS t FROM events), m AS (SELECT max(t) AS m FROM e) SELECT DISTINCT ticker, t + k AS t FROM e, m, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k) WHERE t + k <= m")
def band_expand_distinct(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("ticker"), F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("t")).distinct()
    last = e.agg(F.max("t").alias("m"))
    return R.expand_band(e.join(F.broadcast(last)), "t", 5, F.col("m")).select("ticker", "t")


@query("""WITH a AS (SELECT labels.doc_id, quality AS a, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS b FROM labels JOIN documents USING (doc_id))
SELECT a, count(*) FILTER (b = 0) AS b0, count(*) FILTER (b = 1) AS b1 FROM a GROUP BY a""")
def pivot_agreement(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("a"), (F.col("n_chars") > 1000).cast("int").alias("b"))
    return rows.groupBy("a").pivot("b", [0, 1]).count().select("a", F.coalesce("0", F.lit(0)).alias("b0"), F.coalesce("1", F.lit(0)).alias("b1"))


@query("SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM documents WHERE n_chars > 500")
def common_sample(spark, d):
    docs = table(spark, d, "documents")
    return table(spark, d, "labels").where("quality = 1").select("doc_id").intersect(docs.where("lang = 'en'").select("doc_id")).intersect(docs.where("n_chars > 500").select("doc_id"))


@query(f"WITH {RETURNS}, b AS (SELECT date, avg(r) AS rb FROM ret GROUP BY date) SELECT ret.date, ticker, round(r - rb, 6) AS ar FROM ret JOIN b ON b.date = ret.date WHERE r IS NOT NULL")
def subtract_benchmark(spark, d):
    from quaylark.operators import series as S
    from quaylark.plans.tables import panel

    rows = panel(spark, d).withColumn("r", S.log_return())
    bench = rows.groupBy("date").agg(F.avg("r").alias("rb"))
    return rows.join(bench, "date").where("r IS NOT NULL").select("date", "ticker", F.round(F.col("r") - F.col("rb"), 6).alias("ar"))


@query("""WITH a AS (SELECT doc_id, CAST(quality AS VARCHAR) AS label FROM labels WHERE quality = 1), b AS (SELECT doc_id, lang AS label FROM documents WHERE n_chars < 2000)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.label, b.label) AS label FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def combine_first_full_outer(spark, d):
    a = table(spark, d, "labels").where("quality = 1").select("doc_id", F.col("quality").cast("string").alias("label"))
    return R.combine_first(a, table(spark, d, "documents").where("n_chars < 2000").select("doc_id", F.col("lang").alias("label")), ["doc_id"], ["label"])


@query("""WITH k AS (SELECT source, lang, avg(quality) AS m FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2),
f AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT source, lang, round(m, 6) AS value, 'given' AS typ FROM k UNION ALL SELECT f.source, f.lang, CAST(n AS DOUBLE), 'inferred' FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.source = f.source AND k.lang = f.lang)""")
def inferred_label_union(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    k = docs.join(labels, "doc_id").groupBy("source", "lang").agg(F.avg("quality").alias("value"))
    f = docs.groupBy("source", "lang").agg(F.count("*").cast("double").alias("value")).join(k, ["source", "lang"], "left_anti")
    return k.withColumns({"value": F.round("value", 6), "typ": F.lit("given")}).unionByName(f.withColumn("typ", F.lit("inferred")))


@query("""SELECT a.l_orderkey, a.l_linenumber, a.v AS v_a, b.v AS v_b, a.v = b.v AS agree FROM (SELECT l_orderkey, l_linenumber, l_discount > 0.05 AS v FROM lineitem) a
JOIN (SELECT l_orderkey, l_linenumber, l_tax > 0.04 AS v FROM lineitem WHERE l_returnflag = 'A') b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""")
def vote_join(spark, d):
    rows = table(spark, d, "lineitem")
    a = rows.select("l_orderkey", "l_linenumber", (F.col("l_discount") > 0.05).alias("v_a"))
    b = rows.where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", (F.col("l_tax") > 0.04).alias("v_b"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).withColumn("agree", F.col("v_a") == F.col("v_b"))


@query(f"WITH {DAILY} SELECT lead(date) OVER (ORDER BY date) AS date, level AS level_before FROM daily QUALIFY lead(date) OVER (ORDER BY date) IS NOT NULL")
def next_session_features(spark, d):
    return daily(spark, d).select(F.lead("date").over(Window.orderBy("date")).alias("date"), F.col("level").alias("level_before")).where("date IS NOT NULL")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, count(DISTINCT user_id) AS users, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS share FROM events GROUP BY event_type")
def group_measures(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count_distinct("user_id").alias("users"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("share"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1, 2) SELECT user_id, event_type AS top FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c) WHERE k = 1""")
def mode_by_key(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.mode(F.when(F.col("event_type") != "view", F.col("event_type")), True).alias("top")).where("top IS NOT NULL")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS types FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id")
def ordered_distinct_concat(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(R.distinct_text("event_type").alias("types"))


@query("""WITH f AS (SELECT user_id, CAST(floor(value / 25) AS BIGINT) AS b, min(event_id) AS e FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY e) AS n FROM f)
SELECT user_id, string_agg(CAST(b AS VARCHAR), ' | ' ORDER BY e) AS firsts FROM k WHERE n <= 8 GROUP BY user_id""")
def first_unique_concat(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.floor(F.col("value") / 25).cast("string").alias("b"))
    return rows.groupBy("user_id").agg(R.first_unique("event_id", "b", 8).alias("firsts"))


@query("SELECT event_id, (c * count(*) OVER (PARTITION BY user_id) - sum(c) OVER (PARTITION BY user_id)) / (100e0 * count(*) OVER (PARTITION BY user_id)) AS within, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events)")
def group_demean(spark, d):
    w = Window.partitionBy("user_id")
    return table(spark, d, "events").select("event_id", ((cents("value") * F.count("*").over(w) - F.sum(cents("value")).over(w)) / (100.0 * F.count("*").over(w))).alias("within"), F.count("*").over(w).alias("n"))


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 8) AS weighted FROM lineitem GROUP BY 1")
def weighted_mean(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_extendedprice"), 8).alias("weighted"))


@query("""WITH c AS (SELECT event_type, user_id % 10 AS cell, sum(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS s, count(*) AS n FROM events GROUP BY 1, 2),
p AS (SELECT event_type, sum(s) AS ps, sum(n) AS pn FROM c GROUP BY 1), b AS (SELECT sum(ps) / sum(pn) AS base FROM p),
m AS (SELECT p.event_type, (ps + 20 * base) / (pn + 20) AS pm, base FROM p, b)
SELECT c.event_type, c.cell, round((s + 20 * pm) / (n + 20), 8) AS mean, round(greatest(-1, least(1, 2 * ((s + 20 * pm) / (n + 20) - base))), 8) AS confidence FROM c JOIN m ON m.event_type = c.event_type""")
def calibration_shrink(spark, d):
    rows = table(spark, d, "events").select("event_type", (F.col("user_id") % 10).alias("cell"), (F.col("value") > 50).cast("double").alias("y"))
    return R.shrunk(rows, ["event_type", "cell"], ["event_type"], "y").select("event_type", "cell", F.round("mean", 8).alias("mean"), F.round("confidence", 8).alias("confidence"))


@query("SELECT event_type, round(count(*) * 1.0 / sum(count(*)) OVER (), 8) AS share FROM events GROUP BY event_type")
def value_shares(spark, d):
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.select("event_type", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 8).alias("share"))


@query("WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS m FROM events GROUP BY 1, 2) SELECT user_id, round(avg(m), 6) AS mean, CASE WHEN count(*) >= 5 THEN round(avg(m) / (stddev_samp(m) / sqrt(count(*))), 5) END AS t FROM s GROUP BY user_id")
def two_stage_mean_t(spark, d):
    s = table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("m"))
    t = F.try_divide(F.avg("m"), F.stddev_samp("m") / F.sqrt(F.count("*")))
    return s.groupBy("user_id").agg(F.round(F.avg("m"), 6).alias("mean"), F.when(F.count("*") >= 5, F.round(t, 5)).alias("t"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS qe, round(corr(l_quantity, l_discount), 6) AS qd, round(corr(l_extendedprice, l_discount), 6) AS ed, round(corr(l_tax, l_discount), 6) AS td FROM lineitem")
def correlation_matrix(spark, d):
    pairs = {"qe": ("l_quantity", "l_extendedprice"), "qd": ("l_quantity", "l_discount"), "ed": ("l_extendedprice", "l_discount"), "td": ("l_tax", "l_discount")}
    return table(spark, d, "lineitem").agg(*(F.round(F.corr(a, b), 6).alias(n) for n, (a, b) in pairs.items()))


@query("WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT source, n, CAST(least(n, greatest(1, round_even(100 * sqrt(n) / sum(sqrt(n)) OVER (), 0))) AS BIGINT) AS take FROM c")
def sqrt_allocation(spark, d):
    c = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    share = F.bround(100 * F.sqrt("n") / F.sum(F.sqrt("n")).over(Window.partitionBy(F.lit(0))))
    return c.select("source", "n", F.least(F.col("n"), F.greatest(F.lit(1), share.cast("long"))).alias("take"))


@query("SELECT event_type, round(quantile_cont(value, 0.3333), 6) AS low, round(quantile_cont(value, 0.5), 6) AS mid, round(quantile_cont(value, 0.6667), 6) AS high FROM events GROUP BY 1")
def group_quantiles(spark, d):
    q = ordering.quantiles(table(spark, d, "events"), "value", [0.3333, 0.5, 0.6667], ["event_type"])
    cut = lambda share: F.round(F.max(F.when(F.col("share") == share, F.col("value"))), 6)
    return q.groupBy("event_type").agg(cut(0.3333).alias("low"), cut(0.5).alias("mid"), cut(0.6667).alias("high"))


@query("""WITH e AS (SELECT event_type, CASE WHEN value > 50 THEN 'good' ELSE 'bad' END AS tone, isodow(ts) AS dow, value FROM events)
SELECT event_type, tone, CAST(dow AS INTEGER) AS dow, count(*) AS n, round(avg(value), 6) AS mean FROM e GROUP BY GROUPING SETS ((event_type), (tone), (dow), (event_type, tone), ()) HAVING count(*) >= 60""")
def grouping_sets_by_type(spark, d):
    t, tone, dow = F.col("event_type"), F.col("tone"), F.col("dow")
    rows = table(spark, d, "events").select("event_type", F.when(F.col("value") > 50, "good").otherwise("bad").alias("tone"), (F.weekday("ts") + 1).alias("dow"), "value")
    out = rows.groupingSets([[t], [tone], [dow], [t, tone], []], t, tone, dow).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return out.where("n >= 60")


@query("""WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1)
SELECT user_id, CASE greatest(click, error, purchase) WHEN click THEN 'click' WHEN error THEN 'error' ELSE 'purchase' END AS top FROM c""")
def dominant_group(spark, d):
    kinds = ["click", "error", "purchase"]
    c = table(spark, d, "events").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in kinds))
    most = F.greatest(*kinds)
    return c.select("user_id", R.ordered_case([(F.col(k) == most, k) for k in kinds]).alias("top"))


@query("SELECT doc_id, count(*) OVER (PARTITION BY md5(text)) > 1 AND text <> '' AS dup FROM documents")
def duplicate_flags(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), (F.col("text") != "").alias("full"))
    return rows.select("doc_id", ((F.count("*").over(Window.partitionBy("h")) > 1) & F.col("full")).alias("dup"))


@query("SELECT user_id, bool_or(value > 300) AS some, bool_and(value < 400) AS every FROM events GROUP BY user_id HAVING bool_or(event_type = 'signup')")
def group_bool_filter(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("value") > 300).alias("some"), F.bool_and(F.col("value") < 400).alias("every"), F.bool_or(F.col("event_type") == "signup").alias("_k")).where("_k").drop("_k")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_global(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE k <= greatest(1, round_even(0.02 * n, 0))")
def topk_share_per_group(spark, d):
    return R.top_share(table(spark, d, "events"), ["event_type"], 0.02, [F.desc("value"), F.col("event_id")]).select("event_type", "event_id", "value")


@query("SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1")
def longest_version_wins(spark, d):
    return R.best_row(table(spark, d, "documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], [F.desc("n_chars"), F.col("doc_id")])


@query("WITH m AS (SELECT l_returnflag, l_linestatus, l_linenumber, avg(l_discount) AS score FROM lineitem GROUP BY 1, 2, 3) SELECT l_returnflag, arg_max(l_linenumber, score) AS best, round(max(score), 8) AS score FROM m WHERE l_linestatus = 'F' GROUP BY 1")
def best_config(spark, d):
    m = table(spark, d, "lineitem").where("l_linestatus = 'F'").groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_discount").alias("score"))
    return m.groupBy("l_returnflag").agg(F.max_by("l_linenumber", "score").alias("best"), F.round(F.max("score"), 8).alias("score"))


_QUARTERS = "q AS (SELECT o_orderkey, year(o_orderdate) * 4 + quarter(o_orderdate) AS fold, o_totalprice / 1000 AS score FROM orders)"


def _quarters(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("long").alias("fold"), (F.col("o_totalprice") / 1000).alias("score"))


@query(f"WITH {_QUARTERS}, v AS (SELECT fold + 1 AS fold, quantile_cont(score, 0.9) AS cut FROM q GROUP BY 1) SELECT q.fold, count(*) AS n, count(*) FILTER (score >= cut) AS taken FROM q JOIN v ON v.fold = q.fold GROUP BY q.fold")
def val_threshold_topq(spark, d):
    q = _quarters(spark, d)
    v = ordering.quantiles(q, "score", [0.9], ["fold"]).select((F.col("fold") + 1).alias("fold"), F.col("value").alias("cut"))
    return q.join(F.broadcast(v), "fold").groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= F.col("cut")).alias("taken"))


@query(f"WITH {_QUARTERS}, f AS (SELECT DISTINCT fold FROM q), c AS (SELECT f.fold, quantile_cont(abs(score - 200), 0.8) AS cut FROM f JOIN q ON q.fold < f.fold GROUP BY f.fold) SELECT q.fold, round(cut, 6) AS cut, count(*) FILTER (abs(score - 200) >= cut) AS taken FROM q JOIN c ON c.fold = q.fold GROUP BY 1, 2")
def selective_threshold_prior_folds(spark, d):
    q = _quarters(spark, d).withColumn("a", F.abs(F.col("score") - 200))
    cut = ordering.earlier_quantile(q, "fold", "a", 0.8).withColumnRenamed("value", "cut")  # a row for each quarter
    return q.join(F.broadcast(cut), "fold").groupBy("fold", F.round("cut", 6).alias("cut_"), "cut").agg(F.count_if(F.col("a") >= F.col("cut")).alias("taken")).select("fold", F.col("cut_").alias("cut"), "taken")


@query(f"WITH {_QUARTERS}, v AS (SELECT fold, quantile_cont(score, 0.75) AS cut FROM q WHERE o_orderkey % 2 = 0 GROUP BY 1) SELECT q.fold, count(*) FILTER (score >= cut) AS taken, sum(CAST(round(score * 1e5) AS BIGINT)) FILTER (score >= cut) / (1e5 * count(*) FILTER (score >= cut)) AS mean FROM q JOIN v ON v.fold = q.fold WHERE o_orderkey % 2 = 1 GROUP BY 1")
def own_val_threshold(spark, d):
    q = _quarters(spark, d)
    v = ordering.quantiles(q.where("o_orderkey % 2 = 0"), "score", [0.75], ["fold"]).select("fold", F.col("value").alias("cut"))
    return q.where("o_orderkey % 2 = 1").join(F.broadcast(v), "fold").groupBy("fold").agg(F.count_if(F.col("score") >= F.col("cut")).alias("taken"), F.try_divide(F.sum(F.when(F.col("score") >= F.col("cut"), F.round(F.col("score") * 1e5).cast("long"))), 1e5 * F.count_if(F.col("score") >= F.col("cut"))).alias("mean"))


@query("SELECT source, doc_id, round(least(5, n) * 1.0 / n, 8) AS pi FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || 's1')) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE k <= 5")
def stratified_sample(spark, d):
    return R.stratified(table(spark, d, "documents"), "source", "doc_id", F.lit(5), "s1").select("source", "doc_id", F.round("pi", 8).alias("pi"))


@query("SELECT f, count(*) AS n, round(avg(value), 6) AS mean FROM events, (SELECT unnest([25, 50, 75, 100]) AS f) WHERE event_id * 37 % 100 < f GROUP BY f")
def fraction_samples(spark, d):
    shares = spark.createDataFrame([(25,), (50,), (75,), (100,)], "f int")
    return table(spark, d, "events").join(F.broadcast(shares), F.col("event_id") * 37 % 100 < F.col("f")).groupBy("f").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, unnest(['quantity', 'discount', 'tax']) AS f, unnest([l_quantity * 0.01, l_discount * -5, l_tax * 4]) AS c FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY abs(c) DESC, f) AS n FROM x)
SELECT l_orderkey, l_linenumber, string_agg(f, ', ' ORDER BY n) AS reasons FROM k WHERE n <= 2 GROUP BY 1, 2""")
def top_reasons(spark, d):
    parts = F.array(*(F.struct((-F.abs(c)).alias("size"), F.lit(n).alias("f")) for n, c in (("quantity", F.col("l_quantity") * 0.01), ("discount", F.col("l_discount") * -5), ("tax", F.col("l_tax") * 4))))
    best = F.slice(F.array_sort(parts), 1, 2)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", best.alias("b"))
    # a key can be on several rows; their reasons stand together, as those of one key
    return R.best_row(rows.withColumn("b", F.explode("b")).groupBy("l_orderkey", "l_linenumber").agg(F.array_sort(F.collect_list("b")).alias("b")).select("l_orderkey", "l_linenumber", F.array_join(F.transform(F.slice("b", 1, 2), lambda x: x["f"]), ", ").alias("reasons")), ["l_orderkey", "l_linenumber"], [F.col("reasons")])


@query("SELECT CAST(event_id AS VARCHAR) AS id, value, event_type AS kind, NULL AS price FROM events WHERE value > 300 UNION ALL SELECT 'o' || o_orderkey, NULL, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 490000")
def union_by_name(spark, d):
    a = table(spark, d, "events").where("value > 300").select(F.col("event_id").cast("string").alias("id"), "value", F.col("event_type").alias("kind"))
    b = table(spark, d, "orders").where("o_totalprice > 490000").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderstatus").alias("kind"), F.col("o_totalprice").alias("price"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_subset(spark, d):
    return table(spark, d, "events").select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def except_unknown(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_totalprice > 100000").select("o_custkey"))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier")
def intersect_groups(spark, d):
    return table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("""WITH a AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'view')
SELECT NOT EXISTS (SELECT k FROM a EXCEPT SELECT k FROM b) AND NOT EXISTS (SELECT k FROM b EXCEPT SELECT k FROM a) AS same""")
def set_equality(spark, d):
    e = table(spark, d, "events")
    both = e.where("event_type IN ('click', 'view')").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "click").alias("a"), F.bool_or(F.col("event_type") == "view").alias("b"))
    return both.agg(F.coalesce(F.bool_and(F.col("a") & F.col("b")), F.lit(True)).alias("same"))


@query(f"WITH {NEWS} SELECT ticker, event_type, count(*) AS n FROM news GROUP BY ALL HAVING count(*) >= 20")
def counts_by_two(spark, d):
    return news(spark, d).groupBy("ticker", "event_type").agg(F.count("*").alias("n")).where("n >= 20")


@query("SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n, round(count(*) FILTER (value > 50) * 1.0 / count(*), 6) AS good FROM events GROUP BY 1, 2")
def monthly_counts(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("good"))


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(*) - count(DISTINCT md5(text)) AS repeats, count(*) FILTER (length(text) < 200) AS short, min(n_chars) AS low, max(n_chars) AS high FROM documents")
def contract_report(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), (F.count("*") - F.count_distinct(F.md5(F.col("text").cast("binary")))).alias("repeats"), F.count_if(F.length("text") < 200).alias("short"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))
