"""Evaluation queries: folds, losses, agreement, tests, intervals, ensembles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaylark.operators import series as S
from quaylark.operators import stats as T
from quaylark.plans.registry import query
from quaylark.plans.series import _returns
from quaylark.plans.tables import DAILY, PRICES, RETURNS, daily, prices, table


@query(f"""WITH {DAILY}, f AS (SELECT k + 1 AS fold, CAST(DATE '1998-01-01' + to_months(CAST(3 * k AS INTEGER)) AS DATE) AS q0, CAST(DATE '1998-01-01' + to_months(CAST(3 * k - 3 AS INTEGER)) AS DATE) AS v0, CAST(DATE '1998-01-01' + to_months(CAST(3 * k + 3 AS INTEGER)) AS DATE) AS q1 FROM (SELECT unnest(range(0, 6)) AS k)),
x AS (SELECT fold, date, trading_index + 10 AS gap, q0, v0, q1, (SELECT min(trading_index) FROM daily e WHERE e.date >= f.v0) AS vi, (SELECT min(trading_index) FROM daily e WHERE e.date >= f.q0) AS qi FROM daily CROSS JOIN f)
SELECT fold, 'train' AS part, date FROM x WHERE gap < vi UNION ALL SELECT fold, 'val', date FROM x WHERE date >= v0 AND date < q0 AND gap < qi UNION ALL SELECT fold, 'fit', date FROM x WHERE date < q0 AND gap < qi UNION ALL SELECT fold, 'test', date FROM x WHERE date >= q0 AND date < q1""")
def folds_walk_forward(spark, d):
    return T.walk_forward_folds(daily(spark, d), "1998-01-01", 6, 5)


@query(f"WITH {DAILY}, n AS (SELECT count(*) AS n FROM daily) SELECT date, CASE WHEN trading_index < floor(0.7 * n) THEN 'train' WHEN trading_index < floor(0.8 * n) THEN 'val' ELSE 'test' END AS part FROM daily, n")
def split_70_10_20(spark, d):
    rows = daily(spark, d)
    n = F.col("n")
    return rows.join(F.broadcast(rows.agg(F.count("*").alias("n")))).select("date", F.when(F.col("trading_index") < F.floor(0.7 * n), "train").when(F.col("trading_index") < F.floor(0.8 * n), "val").otherwise("test").alias("part"))


def scored(spark, d):
    """doc_id, y, n_chars, p: a crude chance from the length."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", F.col("quality").alias("y"), "toxic", "n_chars", F.round(1 / (1 + F.exp(-(F.ln("n_chars") - 6))), 8).alias("p"))


_SCORED = "sc AS (SELECT labels.doc_id, quality AS y, toxic, n_chars, round(1 / (1 + exp(-(ln(n_chars) - 6))), 8) AS p FROM labels JOIN documents ON documents.doc_id = labels.doc_id)"


@query(f"WITH {_SCORED} SELECT round((sum(CASE WHEN a.n_chars > b.n_chars THEN 1.0 WHEN a.n_chars = b.n_chars THEN 0.5 ELSE 0.0 END)) / count(*), 8) AS auc FROM sc a JOIN sc b ON a.y = 1 AND b.y = 0")
def auc_rank(spark, d):
    return T.auc(scored(spark, d), "y", "n_chars").select(F.round("auc", 8).alias("auc"))


@query(f"WITH {_SCORED} SELECT toxic, round(avg(CASE WHEN y = 1 THEN -ln(least(greatest(p, 1e-6), 1 - 1e-6)) ELSE -ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)) END), 7) AS log_loss, round(avg((p - y) * (p - y)), 7) AS brier FROM sc GROUP BY toxic")
def logloss_brier(spark, d):
    loss, brier = T.probability_losses("y", "p")
    return scored(spark, d).groupBy("toxic").agg(F.round(F.avg(loss), 7).alias("log_loss"), F.round(F.avg(brier), 7).alias("brier"))


@query(f"""WITH {_SCORED}, c AS (SELECT CAST(count(*) FILTER (y = 1 AND p > 0.5) AS DOUBLE) AS tp, CAST(count(*) FILTER (y <> 1 AND p > 0.5) AS DOUBLE) AS fp, CAST(count(*) FILTER (y = 1 AND p <= 0.5) AS DOUBLE) AS fn, CAST(count(*) FILTER (y <> 1 AND p <= 0.5) AS DOUBLE) AS tn FROM sc)
SELECT tp, fp, fn, tn, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 8) AS bal_acc, round((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 8) AS mcc,
  round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0)) / 2, 8) AS macro_f1 FROM c""")
def mcc_balacc_f1(spark, d):
    rows = scored(spark, d).withColumn("g", (F.col("p") > 0.5).cast("int"))
    return T.confusion(rows, "y", "g").select("tp", "fp", "fn", "tn", *(F.round(c, 8).alias(c) for c in ("bal_acc", "mcc", "macro_f1")))


@query(f"""WITH {RETURNS}, f AS (SELECT date, r, lead(r) OVER (PARTITION BY ticker ORDER BY trading_index) AS r1 FROM ret), k AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY r) + (count(*) OVER (PARTITION BY date, r) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY r1) + (count(*) OVER (PARTITION BY date, r1) - 1) / 2.0 AS b FROM f WHERE r IS NOT NULL AND r1 IS NOT NULL),
i AS (SELECT date, count(*) AS n, corr(a, b) AS ic FROM k GROUP BY date HAVING count(*) >= 5) SELECT date, n, round(ic, 6) AS ic FROM i""")
def rank_ic(spark, d):
    rows = _returns(spark, d).withColumn("r1", F.lead("r").over(S.by()))
    return T.rank_ic(rows, "date", "r", "r1").select("date", "n", F.round("ic", 6).alias("ic"))


_RATERS = "k AS (SELECT quality AS a, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS b FROM labels JOIN documents ON documents.doc_id = labels.doc_id)"


@query(f"""WITH {_RATERS}, c AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM k GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c), p AS (SELECT a, sum(n) / max(t) AS pa FROM c, t GROUP BY a), q AS (SELECT b, sum(n) / max(t) AS pb FROM c, t GROUP BY b)
SELECT (SELECT CAST(t AS BIGINT) FROM t) AS n, round((SELECT sum(CASE WHEN a = b THEN n ELSE 0 END) / sum(n) FROM c), 8) AS agreement, round(1 - (SELECT sum(CASE WHEN a <> b THEN n ELSE 0 END) / sum(n) FROM c) / (SELECT sum(CASE WHEN a <> b THEN pa * pb ELSE 0 END) FROM p, q), 8) AS kappa""")
def kappa(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("a"), (F.col("n_chars") > 1000).cast("int").alias("b"))
    return T.kappa(rows, "a", "b").select("n", F.round("agreement", 8).alias("agreement"), F.round("kappa", 8).alias("kappa"))


_T = "t AS (SELECT user_id, round(exp(-abs(avg(value) - 50) / 20), 9) AS p FROM events GROUP BY 1)"


@query(f"WITH {_T}, r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, user_id) AS k FROM t) SELECT user_id, round(least(1.0, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 7) AS q FROM r")
def bh_fdr(spark, d):
    t = table(spark, d, "events").groupBy("user_id").agg(F.round(F.exp(-F.abs(F.avg("value") - 50) / 20), 9).alias("p"))
    return T.bh(t, "p").select("user_id", F.round("q", 7).alias("q"))


@query(f"""WITH {DAILY}, z AS (SELECT trading_index, abs(level - 180000) / 1e5 - abs(level - lag(level) OVER (ORDER BY trading_index)) / 1e5 AS x FROM daily), y AS (SELECT * FROM z WHERE x IS NOT NULL), m AS (SELECT avg(x) AS m, count(*) AS n FROM y),
c AS (SELECT trading_index, x - m AS c FROM y, m), l AS (SELECT c, lag(c, 1) OVER (ORDER BY trading_index) AS c1, lag(c, 2) OVER (ORDER BY trading_index) AS c2 FROM c), g AS (SELECT sum(c * c) + 2 * (2.0 / 3) * sum(c * c1) + 2 * (1.0 / 3) * sum(c * c2) AS v FROM l)
SELECT n, round(m, 6) AS mean, round(m / sqrt(v / n / n), 4) AS dm, round(m / sqrt(v / n / n) * sqrt((n + 1 - 6 + 6.0 / n) / n), 4) AS hln FROM m, g""")
def dm_test(spark, d):
    rows = daily(spark, d)
    x = F.abs(F.col("level") - 180000) / 1e5 - F.abs(F.col("level") - F.lag("level").over(S.by(None))) / 1e5
    rows = rows.select("trading_index", x.alias("x")).where("x IS NOT NULL")
    return T.dm_statistic(rows, "trading_index", "x", 3).select("n", F.round("mean", 6).alias("mean"), F.round("dm", 4).alias("dm"), F.round("hln", 4).alias("hln"))


@query("""WITH p AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS t FROM p),
d AS (SELECT rep, i.pos, i.s, i.n FROM (SELECT unnest(range(0, 50)) AS rep) CROSS JOIN (SELECT unnest(range(0, 400)) AS b) JOIN i ON i.pos // 10 = (rep * 7919 + b * 104729) % (i.t // 10)),
m AS (SELECT rep, sum(s) / sum(n) AS m FROM d GROUP BY rep) SELECT count(*) AS reps, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM m""")
def block_bootstrap(spark, d):
    """Blocks of 10 sessions drawn by a rule that SQL can repeat; T.block_draws draws them at random."""
    rows = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    partials = rows.join(F.broadcast(S.calendar(rows)), "date").select(F.col("trading_index").alias("pos"), "s", "n")
    blocks = partials.agg(F.floor(F.count("*") / 10).alias("blocks"))
    drawn = spark.range(50).select(F.col("id").alias("rep")).join(F.broadcast(spark.range(400).select(F.col("id").alias("b")))).join(F.broadcast(blocks))
    times = drawn.groupBy("rep", ((F.col("rep") * 7919 + F.col("b") * 104729) % F.col("blocks")).alias("block")).agg(F.count("*").alias("times"))
    draws = times.select("rep", F.explode(F.sequence(F.col("block") * 10, F.col("block") * 10 + 9)).alias("pos"), "times")
    return T.bootstrap_mean(partials, draws).select("reps", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query()
def bootstrap_random(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    partials = rows.join(F.broadcast(S.calendar(rows)), "date").select(F.col("trading_index").alias("pos"), "s", "n")
    return T.bootstrap_mean(partials, T.block_draws(spark, partials.count(), 10, 500, 42))


@query("""WITH f AS (SELECT l_suppkey AS g, l_returnflag AS e, l_extendedprice / 1000 AS y, l_quantity AS a, l_discount * 100 AS b FROM lineitem), w AS (SELECT g, y - avg(y) OVER (PARTITION BY e) AS y, a - avg(a) OVER (PARTITION BY e) AS a, b - avg(b) OVER (PARTITION BY e) AS b FROM f),
s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS byy FROM w), k AS (SELECT (bb * ay - ab * byy) / (aa * bb - ab * ab) AS ka, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS kb, aa, ab, bb, aa * bb - ab * ab AS det FROM s),
c AS (SELECT g, sum(a * (y - ka * a - kb * b)) AS sa, sum(b * (y - ka * a - kb * b)) AS sb FROM w, k GROUP BY g), m AS (SELECT sum(sa * sa) AS maa, sum(sa * sb) AS mab, sum(sb * sb) AS mbb, count(*) AS n FROM c)
SELECT 'quantity' AS name, round(ka, 6) AS coefficient, round(sqrt((bb * bb * maa - 2 * bb * ab * mab + ab * ab * mbb) / (det * det) * n / (n - 1)), 6) AS error FROM k, m
UNION ALL SELECT 'discount', round(kb, 6), round(sqrt((ab * ab * maa - 2 * ab * aa * mab + aa * aa * mbb) / (det * det) * n / (n - 1)), 6) FROM k, m""")
def ols_fixed_effects(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_returnflag").alias("e"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("quantity"), (F.col("l_discount") * 100).alias("discount"))
    found = T.fixed_effects_ols(rows, "y", ["quantity", "discount"], "e", "g")
    return spark.createDataFrame([(n, round(b, 6), round(s, 6)) for n, b, s in found], "name string, coefficient double, error double")


@query("""WITH p AS (SELECT p_partkey, p_type, p_retailprice AS s1, p_size AS s2, p_partkey % 3 = 0 AS ref FROM part),
e AS (SELECT p_partkey, p_type, (SELECT count(*) FROM p q WHERE q.ref AND q.p_type = p.p_type AND q.s1 <= p.s1) * 1.0 / (SELECT count(*) FROM p q WHERE q.ref AND q.p_type = p.p_type) AS e1, (SELECT count(*) FROM p q WHERE q.ref AND q.p_type = p.p_type AND q.s2 <= p.s2) * 1.0 / (SELECT count(*) FROM p q WHERE q.ref AND q.p_type = p.p_type) AS e2 FROM p)
SELECT p_partkey, round((e1 + e2) / 2, 7) AS score, CAST(CAST(e1 > 0.5 AS INTEGER) + CAST(e2 > 0.5 AS INTEGER) AS INTEGER) AS votes FROM e""")
def ecdf_rank_ensemble(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_type", F.col("p_retailprice").alias("s1"), F.col("p_size").alias("s2"))
    ref = F.col("p_partkey") % 3 == 0
    rows = S.ecdf(S.ecdf(rows, "s1", ref, ["p_type"], "e1"), "s2", ref, ["p_type"], "e2")
    return rows.select("p_partkey", F.round((F.col("e1") + F.col("e2")) / 2, 7).alias("score"), ((F.col("e1") > 0.5).cast("int") + (F.col("e2") > 0.5).cast("int")).alias("votes"))


@query(f"WITH {PRICES}, f AS (SELECT ticker, date, close > 1500 AS up FROM prices), p AS (SELECT ticker, avg(CAST(up AS INTEGER)) AS prior FROM f WHERE date < DATE '1999-01-01' GROUP BY 1) SELECT f.ticker, count(*) AS n, round(avg(CASE WHEN (prior > 0.5) = up THEN 1.0 ELSE 0.0 END), 6) AS hit, round(greatest(avg(CAST(up AS INTEGER)), 1 - avg(CAST(up AS INTEGER))), 6) AS base FROM f JOIN p ON p.ticker = f.ticker WHERE date >= DATE '1999-01-01' GROUP BY 1")
def majority_baseline(spark, d):
    f = prices(spark, d).select("ticker", "date", (F.col("close") > 1500).alias("up"))
    cut = F.lit("1999-01-01").cast("date")
    p = f.where(F.col("date") < cut).groupBy("ticker").agg(F.avg(F.col("up").cast("double")).alias("prior"))
    rate = F.avg(F.col("up").cast("double"))
    return f.where(F.col("date") >= cut).join(p, "ticker").groupBy("ticker").agg(F.count("*").alias("n"), F.round(F.avg(((F.col("prior") > 0.5) == F.col("up")).cast("double")), 6).alias("hit"), F.round(F.greatest(rate, 1 - rate), 6).alias("base"))


@query(f"WITH {RETURNS}, m AS (SELECT sign(r) AS s, CAST(lead(r) OVER (PARTITION BY ticker ORDER BY trading_index) > 0 AS INTEGER) AS up FROM ret), f AS (SELECT * FROM m WHERE s IS NOT NULL AND up IS NOT NULL) SELECT CAST(s AS INTEGER) AS s, count(*) AS n, round((sum(up) + 1.0) / (count(*) + 2), 8) AS p_up FROM f GROUP BY s")
def momentum_laplace(spark, d):
    rows = _returns(spark, d).withColumn("up", (F.lead("r").over(S.by()) > 0).cast("int")).where("r IS NOT NULL AND up IS NOT NULL")
    return rows.groupBy(F.signum("r").cast("int").alias("s")).agg(F.count("*").alias("n"), F.round((F.sum("up") + 1) / (F.count("*") + 2), 8).alias("p_up"))


@query("""WITH q AS (SELECT year(o_orderdate) * 4 + quarter(o_orderdate) AS fold, CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0.0 END AS hit FROM orders), f AS (SELECT fold, count(*) AS n, avg(hit) AS m FROM q GROUP BY 1)
SELECT count(*) AS folds, round(min(m), 7) AS worst, round(max(m), 7) AS best, round(sum(n * m) / sum(n), 7) AS overall FROM f""")
def by_quarter_min_max(spark, d):
    q = table(spark, d, "orders").groupBy((F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).alias("fold")).agg(F.count("*").alias("n"), F.avg((F.col("o_totalprice") > 250000).cast("double")).alias("m"))
    return q.agg(F.count("*").alias("folds"), F.round(F.min("m"), 7).alias("worst"), F.round(F.max("m"), 7).alias("best"), F.round(F.sum(F.col("n") * F.col("m")) / F.sum("n"), 7).alias("overall"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, sum(l_discount) AS a, sum(l_tax) AS b FROM lineitem GROUP BY 1, 2) SELECT CASE WHEN a > 0.05 AND b > 0.04 THEN 'agree-up' WHEN a <= 0.05 AND b <= 0.04 THEN 'agree-not' ELSE 'conflict' END AS state, count(*) AS n FROM s GROUP BY 1""")
def agreement_state(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_discount").alias("a"), F.sum("l_tax").alias("b"))
    a, b = F.col("a") > 0.05, F.col("b") > 0.04
    return s.groupBy(F.when(a & b, "agree-up").when(~a & ~b, "agree-not").otherwise("conflict").alias("state")).agg(F.count("*").alias("n"))


@query(f"WITH {DAILY}, t AS (SELECT date, ntile(5) OVER (ORDER BY date) AS block, volume FROM daily) SELECT CAST(block AS INTEGER) AS block, count(*) AS n, min(date) AS first, round(avg(volume), 6) AS mean FROM t GROUP BY 1")
def time_blocks(spark, d):
    rows = daily(spark, d).withColumn("block", F.ntile(5).over(Window.orderBy("date")))
    return rows.groupBy("block").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.round(F.avg("volume"), 6).alias("mean"))
