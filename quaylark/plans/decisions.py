"""Decision rules, thresholds, selections and their evaluation by fold."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaylark.operators import decisions as D
from quaylark.operators import ordering
from quaylark.operators import series as S
from quaylark.plans.registry import query
from quaylark.plans.series import _returns
from quaylark.plans.tables import DAILY, PANEL, RETURNS, cents, daily, panel, table

# Scored orders: a fold is a quarter, p a score from 0 to 1 in hundredths, y whether the order is large
_SCORED = """q AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, year(o_orderdate) * 4 + quarter(o_orderdate) AS fold, (o_custkey % 100) / 100e0 AS p, (o_orderkey * 7 % 100) / 100e0 AS p2,
  CAST(round(o_totalprice * 100) AS BIGINT) % 10000 / 10000e0 - 0.5 AS r, CASE WHEN o_totalprice > 180000 THEN 1 ELSE 0 END AS y FROM orders)"""


def scored(spark, d):
    o = table(spark, d, "orders")
    fold = (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("long")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("date"), fold.alias("fold"), ((F.col("o_custkey") % 100) / 100.0).alias("p"), ((F.col("o_orderkey") * 7 % 100) / 100.0).alias("p2"),
        ((cents("o_totalprice") % 10000) / 10000.0 - 0.5).alias("r"), (F.col("o_totalprice") > 180000).cast("int").alias("y"))


@query("SELECT o_orderkey AS id, round(ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))), 8) AS logit FROM (SELECT o_orderkey, (o_custkey % 101) / 100e0 AS p FROM orders)")
def logit_clipped(spark, d):
    p = (F.col("o_custkey") % 101) / 100.0
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(D.logit(p), 8).alias("logit"))


_THREE = """t AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity / 50e0 AS a, l_discount * 10 AS b, l_tax * 5 AS c FROM lineitem),
n AS (SELECT *, greatest(a, 1e-6) AS x, greatest(b, 1e-6) AS y, greatest(c, 1e-6) AS z FROM t)"""


def three(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.array(F.col("l_quantity") / 50.0, F.col("l_discount") * 10, F.col("l_tax") * 5).alias("p"))
    return rows.withColumn("p", D.normalised("p"))


@query(f"WITH {_THREE} SELECT l_orderkey, l_linenumber, round(x / (x + y + z), 8) AS p0, round(y / (x + y + z), 8) AS p1, round(z / (x + y + z), 8) AS p2 FROM n")
def probability_rows(spark, d):
    return three(spark, d).select("l_orderkey", "l_linenumber", *(F.round(F.col("p")[k], 8).alias(f"p{k}") for k in range(3)))


@query(f"""WITH {_THREE}, pr AS (SELECT count(*) FILTER (l_returnflag = 'A') * 1e0 / count(*) AS pa, count(*) FILTER (l_returnflag = 'N') * 1e0 / count(*) AS pn, count(*) FILTER (l_returnflag = 'R') * 1e0 / count(*) AS prr FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'),
s AS (SELECT l_orderkey, l_linenumber, round(x / (x + y + z) / pa, 9) AS a, round(y / (x + y + z) / pn, 9) AS b, round(z / (x + y + z) / prr, 9) AS c FROM n, pr)
SELECT CASE WHEN a >= b AND a >= c THEN 'A' WHEN b >= c THEN 'N' ELSE 'R' END AS guess, count(*) AS n FROM s GROUP BY 1""")
def prior_argmax(spark, d):
    """The class whose chance exceeds its share of the training rows by most."""
    train = table(spark, d, "lineitem").where(F.col("l_shipdate") < F.lit("1999-01-01 00:00:00").cast("timestamp_ntz"))
    priors = train.agg(F.array(*(F.count_if(F.col("l_returnflag") == c) / F.count("*") for c in "ANR")).alias("prior"))
    return three(spark, d).join(F.broadcast(priors)).select(D.argmax_over_prior("p", "prior", ["A", "N", "R"]).alias("guess")).groupBy("guess").agg(F.count("*").alias("n"))


@query(f"""WITH {_SCORED}, pr AS (SELECT a.fold, avg(CAST(b.y AS DOUBLE)) AS prior FROM (SELECT DISTINCT fold FROM q) a JOIN q b ON b.fold < a.fold GROUP BY 1)
SELECT q.fold, round(max(prior), 8) AS prior, count(*) AS n, count(*) FILTER (p > prior) AS up, count(*) FILTER (p > prior AND y = 1) AS hits FROM q JOIN pr ON pr.fold = q.fold GROUP BY 1""")
def prior_threshold(spark, d):
    """Up where the chance exceeds the share of the folds before."""
    q = scored(spark, d)
    priors = D.share_before(q, "fold", "y")
    return q.join(F.broadcast(priors), "fold").groupBy("fold").agg(F.round(F.max("prior"), 8).alias("prior"), F.count("*").alias("n"), F.count_if(F.col("p") > F.col("prior")).alias("up"), F.count_if((F.col("p") > F.col("prior")) & (F.col("y") == 1)).alias("hits"))


@query(f"""WITH {_SCORED}, s AS (SELECT fold, p - (1 - p2) AS score, CASE WHEN r > 0 THEN 1 ELSE 0 END AS up FROM q WHERE round(r, 4) <> 0)
SELECT a.fold, count(DISTINCT a.score) AS scores, max(n) AS n, max(ups) AS ups FROM s a JOIN (SELECT fold, count(*) AS n, CAST(sum(up) AS BIGINT) AS ups FROM s GROUP BY 1) c ON c.fold = a.fold GROUP BY 1""")
def continuous_score(spark, d):
    """p_up - p_down against the realised sign; rows without a move are out."""
    s = scored(spark, d).where(F.round("r", 4) != 0).select("fold", (F.col("p") - (1 - F.col("p2"))).alias("score"), D.direction("r").alias("up"))
    return s.groupBy("fold").agg(F.count_distinct("score").alias("scores"), F.count("*").alias("n"), F.sum("up").cast("long").alias("ups"))


@query(f"WITH {RETURNS} SELECT date, ticker, CASE WHEN r > 0 THEN 1 WHEN r < 0 THEN 0 END AS up, round(abs(r), 6) AS size FROM ret WHERE r IS NOT NULL")
def direction_target(spark, d):
    """1 up, 0 down, null where nothing moved."""
    return _returns(spark, d).where("r IS NOT NULL").select("date", "ticker", D.direction("r").alias("up"), F.round(F.abs("r"), 6).alias("size"))


@query(f"""WITH {_SCORED}, c AS (SELECT unnest(['V1', 'L2', 'D2']) AS candidate)
SELECT candidate, fold, count(*) FILTER (candidate <> 'D2' OR abs(r) >= 0.01) AS train, round(sum(CASE WHEN candidate = 'L2' THEN pow(0.5, (DATE '2002-01-01' - date) / 250e0) ELSE 1 END) FILTER (candidate <> 'D2' OR abs(r) >= 0.01), 6) AS weight, count(*) AS test FROM q, c GROUP BY 1, 2""")
def candidate_fits(spark, d):
    """Training rows and weights of each candidate: D2 drops small moves from training only, L2 weighs by age."""
    q = scored(spark, d).withColumn("candidate", F.explode(F.array(*map(F.lit, ("V1", "L2", "D2")))))
    kept = (F.col("candidate") != "D2") | (F.abs("r") >= 0.01)
    weight = F.when(F.col("candidate") == "L2", F.pow(F.lit(0.5), F.datediff(F.lit("2002-01-01").cast("date"), "date") / 250.0)).otherwise(1.0)
    return q.groupBy("candidate", "fold").agg(F.count_if(kept).alias("train"), F.round(F.sum(F.when(kept, weight)), 6).alias("weight"), F.count("*").alias("test"))


@query(f"""WITH {_SCORED}, c AS (SELECT fold, unnest([0.3, 0.5, 0.7]) AS cut, p, y FROM q), s AS (SELECT fold, cut, CAST(count(*) FILTER ((p > cut) = (y = 1)) AS BIGINT) AS good, count(*) AS n FROM c GROUP BY 1, 2),
r AS (SELECT fold, cut, sum(good) OVER w AS g, sum(n) OVER w AS n FROM s WINDOW w AS (PARTITION BY cut ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT fold, CAST(cut AS DOUBLE) AS cut, round(g / n, 8) AS so_far FROM r WHERE n IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(g / n, 12) DESC, cut) = 1""")
def cumulative_selection(spark, d):
    """For each fold the rule that did best on all folds before it."""
    c = scored(spark, d).withColumn("cut", F.explode(F.array(*map(F.lit, (0.3, 0.5, 0.7)))))
    s = c.groupBy("fold", "cut").agg(F.count_if((F.col("p") > F.col("cut")) == (F.col("y") == 1)).alias("good"), F.count("*").alias("n"))
    return D.best_so_far(s, "fold", "cut", "good", "n").select("fold", "cut", F.round("so_far", 8).alias("so_far"))


@query(f"""WITH {_SCORED}, b AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY date, id) - 1) * 5 / count(*) OVER ()) AS BIGINT) AS block, id % 7 AS k FROM q),
g AS (SELECT block, k, sum(y) AS s, count(*) AS n FROM b GROUP BY 1, 2), t AS (SELECT k, sum(s) AS s, sum(n) AS n FROM g GROUP BY 1)
SELECT g.block, g.k, round((t.s - g.s + 1) / (t.n - g.n + 2e0), 8) AS p FROM g JOIN t ON t.k = g.k""")
def out_of_fold_chances(spark, d):
    """Five blocks in time; a block's chances by group come from the other four."""
    q = scored(spark, d).withColumn("k", F.col("id") % 7)
    total = q.agg(F.count("*").alias("_all"))  # one row
    ranked = ordering.running(q.withColumn("one", F.lit(1)), ["date", "id"], "one", "before").join(F.broadcast(total))
    g = ranked.withColumn("block", F.floor(F.col("before") * 5 / F.col("_all")).cast("long")).groupBy("block", "k").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    t = g.groupBy("k").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return g.join(t, "k").select("block", "k", F.round((F.col("ts") - F.col("s") + 1) / (F.col("tn") - F.col("n") + 2.0), 8).alias("p"))


@query(f"WITH {_SCORED}, v AS (SELECT fold, CAST(p > 0.5 AS INTEGER) AS a, CAST(p2 > 0.5 AS INTEGER) AS b, CAST(p + p2 > 1 AS INTEGER) AS c, CAST(p > 0.3 AS INTEGER) AS d, CAST(p2 > 0.3 AS INTEGER) AS e, y FROM q) SELECT fold, count(*) FILTER (a + b + c = 3) AS all3, count(*) FILTER (a + b + c + d + e >= 4) AS four_of_five, count(*) FILTER (a + b = 2) AS both, count(*) FILTER (a + b + c = 3 AND y = 1) AS all3_hits FROM v GROUP BY 1")
def consensus_rules(spark, d):
    q = scored(spark, d)
    votes = [(F.col("p") > 0.5), (F.col("p2") > 0.5), (F.col("p") + F.col("p2") > 1), (F.col("p") > 0.3), (F.col("p2") > 0.3)]
    return q.groupBy("fold").agg(F.count_if(D.agree(votes[:3], 3)).alias("all3"), F.count_if(D.agree(votes, 4)).alias("four_of_five"), F.count_if(D.agree(votes[:2], 2)).alias("both"), F.count_if(D.agree(votes[:3], 3) & (F.col("y") == 1)).alias("all3_hits"))


@query(f"""WITH {_SCORED}, a AS (SELECT fold, count(*) FILTER (p > 0.6) AS n, count(*) FILTER (p > 0.6 AND y = 1) AS k, avg(CAST(y AS DOUBLE)) AS base FROM q GROUP BY 1)
SELECT fold, n, k, round(k * 1e0 / n, 8) AS hit, round(base, 8) AS base, round(k * 1e0 / n - base, 8) AS lift, round(k * 1e0 / n - 1.96 * sqrt(k * 1e0 / n * (1 - k * 1e0 / n) / n), 7) AS low, round(k * 1e0 / n + 1.96 * sqrt(k * 1e0 / n * (1 - k * 1e0 / n) / n), 7) AS high FROM a WHERE n > 0""")
def hit_vs_base(spark, d):
    """Hits of the chosen rows against the share of all, with a normal interval."""
    a = scored(spark, d).groupBy("fold").agg(F.count_if(F.col("p") > 0.6).alias("n"), F.count_if((F.col("p") > 0.6) & (F.col("y") == 1)).alias("k"), F.avg(F.col("y").cast("double")).alias("base")).where("n > 0")
    hit, low, high = D.share_interval(F.col("k"), F.col("n"))
    return a.select("fold", "n", "k", F.round(hit, 8).alias("hit"), F.round("base", 8).alias("base"), F.round(hit - F.col("base"), 8).alias("lift"), F.round(low, 7).alias("low"), F.round(high, 7).alias("high"))


@query(f"""WITH {_SCORED}, c AS (SELECT fold, 10 AS pct, quantile_cont(p, 0.9) AS hi, quantile_cont(p, 0.1) AS lo FROM q GROUP BY 1 UNION ALL SELECT fold, 15, quantile_cont(p, 0.85), quantile_cont(p, 0.15) FROM q GROUP BY 1),
t AS (SELECT q.fold, pct, count(*) AS n, count(*) FILTER (p >= hi) + count(*) FILTER (p <= lo) AS taken, count(*) FILTER (p >= hi AND y = 1) + count(*) FILTER (p <= lo AND y = 0) AS good FROM q JOIN c ON c.fold = q.fold GROUP BY 1, 2),
s AS (SELECT pct, round(sum(good) * 1e0 / sum(taken), 8) AS accuracy, round(sum(taken) * 1e0 / sum(n), 8) AS coverage, round(min(good * 1e0 / taken), 8) AS worst, round(max(good * 1e0 / taken), 8) AS best FROM t GROUP BY 1) SELECT CAST(pct AS INTEGER) AS pct, accuracy, coverage, worst, best FROM s""")
def two_sided_confidence(spark, d):
    """The surest rows on either side of each fold: accuracy, coverage, and the worst and best fold."""
    q = scored(spark, d)
    cuts = ordering.quantiles(q, "p", [0.1, 0.15, 0.85, 0.9], ["fold"])
    at = lambda s: F.max(F.when(F.col("share") == s, F.col("value")))
    cuts = cuts.groupBy("fold").agg(*(F.struct(F.lit(k).alias("pct"), at(1 - k / 100).alias("hi"), at(k / 100).alias("lo")).alias(f"c{k}") for k in (10, 15)))
    cuts = cuts.select("fold", F.explode(F.array("c10", "c15")).alias("c")).select("fold", "c.*")
    rows = q.join(F.broadcast(cuts), "fold")  # two rows a fold
    above, below = F.col("p") >= F.col("hi"), F.col("p") <= F.col("lo")
    t = rows.groupBy("fold", "pct").agg(F.count("*").alias("n"), (F.count_if(above) + F.count_if(below)).alias("taken"), (F.count_if(above & (F.col("y") == 1)) + F.count_if(below & (F.col("y") == 0))).alias("good"))
    rate = F.col("good") / F.col("taken")
    return t.groupBy("pct").agg(F.round(F.sum("good") / F.sum("taken"), 8).alias("accuracy"), F.round(F.sum("taken") / F.sum("n"), 8).alias("coverage"), F.round(F.min(rate), 8).alias("worst"), F.round(F.max(rate), 8).alias("best"))


@query(f"""WITH {_SCORED}, g AS (SELECT fold, avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1e0 ELSE 0e0 END) AS model, avg(CASE WHEN y = 1 THEN 1e0 ELSE 0e0 END) AS follow, avg(CASE WHEN p > 0.5 THEN r ELSE 0 END) AS gain, avg(r) AS gain_all FROM q GROUP BY 1)
SELECT fold, round(model, 8) AS model, round(follow, 8) AS follow, round(model - follow, 8) AS edge, round(gain, 7) AS gain, round(gain_all, 7) AS gain_all, model > follow AS better FROM g""")
def model_vs_investor(spark, d):
    """By quarter: the model against an investor who follows every signal."""
    g = scored(spark, d).groupBy("fold").agg(F.avg(F.when((F.col("p") > 0.5) == (F.col("y") == 1), 1.0).otherwise(0.0)).alias("model"), F.avg(F.col("y").cast("double")).alias("follow"), F.avg(F.when(F.col("p") > 0.5, F.col("r")).otherwise(0.0)).alias("gain"), F.avg("r").alias("gain_all"))
    return g.select("fold", F.round("model", 8).alias("model"), F.round("follow", 8).alias("follow"), F.round(F.col("model") - F.col("follow"), 8).alias("edge"), F.round("gain", 7).alias("gain"), F.round("gain_all", 7).alias("gain_all"), (F.col("model") > F.col("follow")).alias("better"))


@query(f"""WITH {_SCORED}, a AS (SELECT id, p, y FROM q WHERE id % 3 <> 0), b AS (SELECT id, p2 FROM q WHERE id % 5 <> 0), j AS (SELECT a.id, y, least(greatest(p, 1e-6), 1 - 1e-6) AS p, least(greatest(p2, 1e-6), 1 - 1e-6) AS p2 FROM a JOIN b ON b.id = a.id),
l AS (SELECT -CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END AS la, -CASE WHEN y = 1 THEN ln(p2) ELSE ln(1 - p2) END AS lb FROM j)
SELECT count(*) AS n, round(avg(la), 7) AS loss_a, round(avg(lb), 7) AS loss_b, round(avg(la - lb), 7) AS difference, round(avg(la - lb) / (stddev_samp(la - lb) / sqrt(count(*))), 6) AS t FROM l""")
def ablation_common_sample(spark, d):
    """Two specifications on the rows that both score."""
    from quaylark.operators.stats import probability_losses

    q = scored(spark, d)
    j = q.where("id % 3 <> 0").select("id", "p", "y").join(q.where("id % 5 <> 0").select("id", "p2"), "id")
    l = j.select(probability_losses("y", "p")[0].alias("la"), probability_losses("y", "p2")[0].alias("lb")).withColumn("x", F.col("la") - F.col("lb"))
    return l.agg(F.count("*").alias("n"), F.round(F.avg("la"), 7).alias("loss_a"), F.round(F.avg("lb"), 7).alias("loss_b"), F.round(F.avg("x"), 7).alias("difference"), F.round(F.avg("x") / (F.stddev_samp("x") / F.sqrt(F.count("*"))), 6).alias("t"))


_IC = f"""{PANEL}, ret AS (SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY ticker ORDER BY trading_index) AS r FROM panel), f AS (SELECT date, ticker, r AS a, lead(r) OVER (PARTITION BY ticker ORDER BY trading_index) AS b FROM ret),
k AS (SELECT * FROM f WHERE a IS NOT NULL AND b IS NOT NULL)"""


@query(f"""WITH {_IC}, m AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY a) + (count(*) OVER (PARTITION BY date, a) - 1) / 2e0 AS ra, rank() OVER (PARTITION BY date ORDER BY b) + (count(*) OVER (PARTITION BY date, b) - 1) / 2e0 AS rb FROM k),
i AS (SELECT date, corr(ra, rb) AS ic FROM m GROUP BY 1 HAVING count(*) >= 5) SELECT count(ic) AS sessions, round(avg(ic), 6) AS mean, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) / sqrt(5), 5) AS t FROM i WHERE ic IS NOT NULL AND NOT isnan(ic)""")
def rank_ic_t(spark, d):
    """Mean of the sessions' rank correlations, its t-statistic taken down for overlapping horizons of five."""
    from quaylark.operators.stats import rank_ic

    rows = _returns(spark, d).withColumn("b", F.lead("r").over(S.by())).select("date", F.col("r").alias("a"), "b")
    i = rank_ic(rows, "date", "a", "b").where("ic IS NOT NULL AND NOT isnan(ic)")
    return i.agg(F.count("ic").alias("sessions"), F.round(F.avg("ic"), 6).alias("mean"), F.round(F.avg("ic") / (F.stddev_samp("ic") / F.sqrt(F.count("ic"))) / F.sqrt(F.lit(5.0)), 5).alias("t"))


@query(f"""WITH {_IC}, m AS (SELECT ticker, rank() OVER (PARTITION BY ticker ORDER BY a) + (count(*) OVER (PARTITION BY ticker, a) - 1) / 2e0 AS ra, rank() OVER (PARTITION BY ticker ORDER BY b) + (count(*) OVER (PARTITION BY ticker, b) - 1) / 2e0 AS rb FROM k)
SELECT ticker, count(*) AS n, round(corr(ra, rb), 6) AS ic FROM m GROUP BY 1 HAVING count(*) >= 5""")
def rank_ic_series(spark, d):
    """The same over time, by ticker."""
    from quaylark.operators.stats import rank_ic

    rows = _returns(spark, d).withColumn("b", F.lead("r").over(S.by())).select("ticker", F.col("r").alias("a"), "b")
    return rank_ic(rows, "ticker", "a", "b").select("ticker", "n", F.round("ic", 6).alias("ic"))


@query("""WITH k AS (SELECT quality + toxic AS a, CASE WHEN n_chars > 2000 THEN 2 WHEN n_chars > 800 THEN 1 ELSE 0 END AS b FROM labels JOIN documents ON documents.doc_id = labels.doc_id), c AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM k GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c),
p AS (SELECT a, sum(n) / max(t) AS pa FROM c, t GROUP BY 1), w AS (SELECT b, sum(n) / max(t) AS pb FROM c, t GROUP BY 1)
SELECT (SELECT CAST(t AS BIGINT) FROM t) AS n, round((SELECT sum(CASE WHEN a = b THEN n ELSE 0 END) / sum(n) FROM c), 8) AS agreement, round(1 - (SELECT sum((a - b) * (a - b) * n) / sum(n) FROM c) / (SELECT sum((a - b) * (a - b) * pa * pb) FROM p, w), 8) AS kappa""")
def kappa_quadratic(spark, d):
    from quaylark.operators.stats import kappa

    b = F.when(F.col("n_chars") > 2000, 2).when(F.col("n_chars") > 800, 1).otherwise(0)
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("quality") + F.col("toxic")).alias("a"), b.alias("b"))
    return kappa(rows, "a", "b", "quadratic").select("n", F.round("agreement", 8).alias("agreement"), F.round("kappa", 8).alias("kappa"))


@query("SELECT event_type, count(*) AS n, round(avg(CASE WHEN (CAST(json_extract(props, '$.k') AS INTEGER) > 50) = (value > 50) THEN 1e0 ELSE 0e0 END), 8) AS consistent FROM events WHERE round(value, 2) <> 50 GROUP BY 1")
def sign_consistency(spark, d):
    """How often a label's sign is that of the score."""
    k = F.get_json_object("props", "$.k").cast("int") > 50
    rows = table(spark, d, "events").where(F.round("value", 2) != 50)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg((k == (F.col("value") > 50)).cast("double")), 8).alias("consistent"))


_ROLES = ["train", "val", "fit", "test"]


@query(f"""WITH {DAILY}, f AS (SELECT k AS fold, CAST(DATE '1998-01-01' + to_months(CAST(3 * (k - 1) AS INTEGER)) AS DATE) AS q0 FROM (SELECT unnest(range(1, 7)) AS k)), x AS (SELECT fold, q0, CAST(q0 - to_months(3) AS DATE) AS v0, CAST(q0 + to_months(3) AS DATE) AS q1 FROM f),
s AS (SELECT fold, v0, q0, q1, (SELECT min(trading_index) FROM daily WHERE date >= v0) AS v, (SELECT min(trading_index) FROM daily WHERE date >= q0) AS q FROM x),
p AS (SELECT fold, 'train' AS part, date FROM daily, s WHERE trading_index + 10 < v UNION ALL SELECT fold, 'val', date FROM daily, s WHERE date >= v0 AND date < q0 AND trading_index + 10 < q
UNION ALL SELECT fold, 'fit', date FROM daily, s WHERE date < q0 AND trading_index + 10 < q UNION ALL SELECT fold, 'test', date FROM daily, s WHERE date >= q0 AND date < q1)
SELECT fold, part, count(*) AS sessions, min(date) AS first_, max(date) AS last_ FROM p GROUP BY 1, 2""")
def fold_description(spark, d):
    from quaylark.operators.stats import walk_forward_folds

    parts = walk_forward_folds(daily(spark, d), "1998-01-01", 6, 5, 5)
    return parts.groupBy("fold", "part").agg(F.count("*").alias("sessions"), F.min("date").alias("first_"), F.max("date").alias("last_"))


@query("""WITH m AS (SELECT max(CAST(o_orderdate AS DATE)) AS last FROM orders), s AS (SELECT last, CAST(date_trunc('quarter', last) AS DATE) AS q FROM m), v AS (SELECT last, q, CASE WHEN last - q > 45 THEN q ELSE CAST(q - to_months(3) AS DATE) END AS val, last - 5 AS fresh FROM s)
SELECT CASE WHEN CAST(o_orderdate AS DATE) >= fresh THEN 'latest' WHEN CAST(o_orderdate AS DATE) >= val THEN 'val' ELSE 'train' END AS part, count(*) AS n, round(avg(CASE WHEN o_totalprice > 180000 THEN 1e0 ELSE 0e0 END), 8) AS rate FROM orders, v GROUP BY 1""")
def latest_split(spark, d):
    """The split for scoring the latest news: the last quarter validates if it is more than 45 days old, else the one before."""
    o = table(spark, d, "orders").withColumn("date", F.col("o_orderdate").cast("date"))
    last = o.agg(F.max("date").alias("last"))  # one row
    part = D.latest_part("date", "last", 45, 5)
    return o.join(F.broadcast(last)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("o_totalprice") > 180000).cast("double")), 8).alias("rate"))


@query("""WITH m AS (SELECT max(CAST(o_orderdate AS DATE)) AS last FROM orders), g AS (SELECT o_orderpriority, sum(CASE WHEN o_totalprice > 180000 THEN 1 ELSE 0 END) AS s, count(*) AS n FROM orders, m WHERE CAST(o_orderdate AS DATE) < last - 5 GROUP BY 1)
SELECT o_orderkey, round((s + 1) / (n + 2e0), 8) AS p, CASE WHEN (s + 1) / (n + 2e0) > 0.4 THEN 'follow' ELSE 'wait' END AS advice FROM orders JOIN g ON g.o_orderpriority = orders.o_orderpriority, m WHERE CAST(o_orderdate AS DATE) >= last - 5""")
def latest_scores(spark, d):
    """Chances of the newest rows by their group's share before them."""
    o = table(spark, d, "orders").withColumn("date", F.col("o_orderdate").cast("date"))
    o = o.join(F.broadcast(o.agg(F.max("date").alias("last"))))
    old = F.col("date") < F.date_sub("last", 5)
    g = o.where(old).groupBy("o_orderpriority").agg(((F.sum((F.col("o_totalprice") > 180000).cast("int")) + 1) / (F.count("*") + 2.0)).alias("p"))
    return o.where(~old).join(F.broadcast(g), "o_orderpriority").select("o_orderkey", F.round("p", 8).alias("p"), F.when(F.col("p") > 0.4, "follow").otherwise("wait").alias("advice"))


@query(f"""WITH {DAILY}, x AS (SELECT *, ln(level) - lag(ln(level), 5) OVER (ORDER BY trading_index) AS mom, avg(level) OVER (ORDER BY trading_index ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS base, lead(level, 5) OVER (ORDER BY trading_index) AS later FROM daily)
SELECT CASE WHEN mom > 0 THEN 1 ELSE 0 END AS momentum, CASE WHEN level > base THEN 1 ELSE 0 END AS tone, count(*) AS n, count(*) FILTER (later > level) AS up, round(avg(CASE WHEN later > level THEN 1e0 ELSE 0e0 END), 8) AS rate FROM x WHERE mom IS NOT NULL AND later IS NOT NULL GROUP BY 1, 2""")
def sector_rules(spark, d):
    """Tone and momentum rules of the sector against its next five sessions."""
    w = S.by(None)
    x = daily(spark, d).withColumns({"mom": F.ln("level") - F.lag(F.ln("level"), 5).over(w), "base": F.avg("level").over(S.frame(20, member=None)), "later": F.lead("level", 5).over(w)}).where("mom IS NOT NULL AND later IS NOT NULL")
    return x.groupBy((F.col("mom") > 0).cast("int").alias("momentum"), (F.col("level") > F.col("base")).cast("int").alias("tone")).agg(F.count("*").alias("n"), F.count_if(F.col("later") > F.col("level")).alias("up"), F.round(F.avg((F.col("later") > F.col("level")).cast("double")), 8).alias("rate"))
