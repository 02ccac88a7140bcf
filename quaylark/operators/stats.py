"""Evaluation: folds, ranks, losses, agreement, tests, intervals and regressions, on sums that Spark aggregates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylark.operators import ordering
from quaylark.operators.series import mean_rank


def walk_forward_folds(cal: DataFrame, first: str, quarters: int, horizon: int, embargo: int = 5) -> DataFrame:
    """fold, part, date: test quarters in a row, the quarter before each for validation, all before that for training (and
    training and validation for the last fit), with horizon + embargo sessions left out before what follows.

    The calendar has a row a session and the folds are few; they meet by a broadcast."""
    spark = cal.sparkSession
    folds = spark.range(quarters).select((F.col("id") + 1).alias("fold"), F.add_months(F.lit(first).cast("date"), (3 * F.col("id")).cast("int")).alias("q0"))
    folds = folds.withColumns({"v0": F.add_months("q0", -3), "q1": F.add_months("q0", 3)})
    days = cal.select("date", "trading_index").join(F.broadcast(folds))
    w = Window.partitionBy("fold")
    days = days.withColumns({"_v": F.min(F.when(F.col("date") >= F.col("v0"), F.col("trading_index"))).over(w), "_q": F.min(F.when(F.col("date") >= F.col("q0"), F.col("trading_index"))).over(w)})
    gap = F.col("trading_index") + horizon + embargo
    parts = F.array_compact(F.array(
        F.when(gap < F.col("_v"), "train"),
        F.when((F.col("date") >= F.col("v0")) & (F.col("date") < F.col("q0")) & (gap < F.col("_q")), "val"),
        F.when((F.col("date") < F.col("q0")) & (gap < F.col("_q")), "fit"),
        F.when((F.col("date") >= F.col("q0")) & (F.col("date") < F.col("q1")), "test"),
    ))
    return days.select("fold", F.explode(parts).alias("part"), "date")


def auc(rows: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by mean ranks: scores are counted first, so ranks run over distinct scores."""
    by = by or []
    counts = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("_s")).agg(F.sum(F.col(label).cast("double")).alias("p"), F.count("*").cast("double").alias("n"))
    counts = counts.withColumn("_neg", F.col("n") - F.col("p"))
    if by:
        w = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_below", F.coalesce(F.sum("_neg").over(w), F.lit(0.0)))
    else:
        counts = ordering.running(counts, ["_s"], "_neg", "_below")
    pairs = counts.withColumn("u", F.col("p") * (F.col("_below") + (F.col("n") - F.col("p")) / 2))
    return pairs.groupBy(*by).agg(F.try_divide(F.sum("u"), F.sum("p") * F.sum(F.col("n") - F.col("p"))).alias("auc"))


def probability_losses(label: str, p: str, eps: float = 1e-6) -> tuple[Column, Column]:
    """Log loss and Brier score of a row."""
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    return -F.when(F.col(label) == 1, F.ln(q)).otherwise(F.ln(1 - q)), F.pow(F.col(p) - F.col(label), 2)


def confusion(rows: DataFrame, label: str, guess: str, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn and balanced accuracy, MCC and macro F1."""
    y, g = F.col(label) == 1, F.col(guess) == 1
    c = rows.groupBy(*(by or [])).agg(*(F.count_if(x).cast("double").alias(n) for n, x in (("tp", y & g), ("fp", ~y & g), ("fn", y & ~g), ("tn", ~y & ~g))))
    t = {n: F.col(n) for n in ("tp", "fp", "fn", "tn")}
    tp, fp, fn, tn = t["tp"], t["fp"], t["fn"], t["tn"]
    f1 = lambda a, b, c: F.coalesce(F.try_divide(2 * a, 2 * a + b + c), F.lit(0.0))
    return c.withColumns({
        "bal_acc": (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2,
        "mcc": F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "macro_f1": (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2,
    })


def kappa(rows: DataFrame, a: str, b: str, weights: str = "plain") -> DataFrame:
    """Cohen's kappa of two raters' integer classes; weights: plain or quadratic. n, agreement, kappa."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    one = Window.partitionBy(F.lit(0))  # a row for each pair of classes
    cells = cells.withColumn("all", F.sum("n").over(one))
    rowsum, colsum = cells.groupBy("a").agg((F.sum("n") / F.first("all")).alias("pa")), cells.groupBy("b").agg((F.sum("n") / F.first("all")).alias("pb"))
    lost = lambda: F.pow(F.col("a") - F.col("b"), 2) if weights == "quadratic" else (F.col("a") != F.col("b")).cast("double")
    seen = cells.agg((F.sum(lost() * F.col("n")) / F.sum("n")).alias("seen"), F.sum("n").cast("long").alias("n"), (F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0.0)) / F.sum("n")).alias("agreement"))
    chance = F.broadcast(rowsum).join(F.broadcast(colsum)).agg(F.sum(lost() * F.col("pa") * F.col("pb")).alias("chance"))
    return seen.join(F.broadcast(chance)).select("n", "agreement", (1 - F.try_divide("seen", "chance")).alias("kappa"))


def bh(rows: DataFrame, p: str, by: list[str] | None = None) -> DataFrame:
    """rows with q: Benjamini and Hochberg's values, a reverse running minimum of p m / rank."""
    if by:
        w = Window.partitionBy(*by)
        ranked = rows.withColumns({"_m": F.count(p).over(w), "_r": F.row_number().over(w.orderBy(p))})
        least = F.min(F.col(p) * F.col("_m") / F.col("_r")).over(w.orderBy("_r").rowsBetween(0, Window.unboundedFollowing))
        return ranked.withColumn("q", F.least(F.lit(1.0), least)).drop("_m", "_r")
    # of equal p the last rank has the least value
    counts = ordering.running(rows.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("_n")), [p], "_n", "_b")
    total = counts.agg(F.sum("_n").alias("_m"))  # one row
    valued = counts.join(F.broadcast(total)).withColumn("_x", F.col(p) * F.col("_m") / (F.col("_b") + F.col("_n")))
    found = ordering.least_from(valued, [p], "_x", "q").select(p, F.least(F.lit(1.0), "q").alias("q"))
    return rows.join(found, p, "left").select(*rows.columns, "q")


def rank_ic(rows: DataFrame, date: str, score: str, outcome: str, least: int = 5) -> DataFrame:
    """Spearman's correlation of score and outcome in each session with at least `least` rows."""
    known = rows.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    ranked = known.select(date, mean_rank(score, [date]).alias("a"), mean_rank(outcome, [date]).alias("b"))
    return ranked.groupBy(date).agg(F.count("*").alias("n"), F.corr("a", "b").alias("ic")).where(F.col("n") >= least)


def dm_statistic(rows: DataFrame, order: str, diff: str, horizon: int) -> DataFrame:
    """Diebold and Mariano's statistic of a series of loss differences with a Bartlett long-run variance, and Harvey,
    Leybourne and Newbold's small-sample factor. A row a session: lags are taken over one ordered series."""
    w = Window.orderBy(order)
    base = rows.select(order, F.col(diff).alias("d")).join(F.broadcast(rows.agg(F.avg(diff).alias("m"))))
    base = base.withColumn("c", F.col("d") - F.col("m"))
    lags = [F.lag("c", k).over(w).alias(f"c{k}") for k in range(1, horizon)]
    sums = base.select("c", "m", *lags).agg(F.first("m").alias("m"), F.count("*").alias("n"), F.sum(F.col("c") * F.col("c")).alias("g0"), *(F.sum(F.col("c") * F.col(f"c{k}")).alias(f"g{k}") for k in range(1, horizon)))
    var = F.col("g0") + sum((2 * (1 - k / horizon) * F.col(f"g{k}") for k in range(1, horizon)), F.lit(0.0))
    dm = F.try_divide("m", F.sqrt(F.try_divide(var, F.col("n") * F.col("n"))))
    n = F.col("n")
    factor = F.sqrt((n + 1 - 2 * horizon + F.lit(horizon * (horizon - 1)) / n) / n)
    return sums.select("n", F.col("m").alias("mean"), dm.alias("dm"), (dm * factor).alias("hln"))


def t_p_value(t: float, df: float) -> float:
    """Two-sided p-value of Student's t by the incomplete beta function's continued fraction."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x in (0.0, 1.0):
        return float(x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-30)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or 1e-30)
                c = (1 + num / c) or 1e-30
                h *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return h

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def block_draws(spark: SparkSession, sessions: int, block: int, reps: int, seed: int) -> DataFrame:
    """rep, pos, times: how often each session is drawn when blocks of sessions are drawn with replacement. Made by rep on
    the executors, each from its own seed."""
    n_blocks = -(-sessions // block)

    def run(batches):
        for pdf in batches:
            for rep in pdf.id:
                starts = np.random.default_rng([seed, int(rep)]).integers(0, max(1, sessions - block + 1), n_blocks)
                pos = (starts[:, None] + np.arange(block)).reshape(-1)[:sessions]
                found, times = np.unique(pos[pos < sessions], return_counts=True)
                yield pdf.iloc[:0].assign() if not len(found) else type(pdf)({"rep": int(rep), "pos": found, "times": times})

    return spark.range(reps).mapInPandas(run, "rep long, pos long, times long")


def bootstrap_mean(partials: DataFrame, draws: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Interval of a mean from each session's partial sums (pos, s, n): draws meet partials, not rows."""
    reps = draws.join(F.broadcast(partials), "pos").groupBy("rep").agg(F.try_divide(F.sum(F.col("s") * F.col("times")), F.sum(F.col("n") * F.col("times"))).alias("m"))
    return reps.agg(F.count("m").alias("reps"), F.percentile("m", F.lit(low)).alias("low"), F.percentile("m", F.lit(high)).alias("high"))


def fixed_effects_ols(rows: DataFrame, y: str, xs: list[str], effect: str, cluster: str) -> list[tuple[str, float, float]]:
    """(name, coefficient, standard error): regression with the effect's means taken out and errors clustered. Spark sums the
    normal equations and each cluster's score products; only matrices of the regressors' size come to the driver."""
    w = Window.partitionBy(effect)
    flat = rows.na.drop(subset=[y, *xs]).select(F.col(cluster).alias("_g"), *((F.col(c) - F.avg(c).over(w)).alias(c) for c in [y, *xs]))
    pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:]]
    sums = flat.agg(F.count("*").alias("n"), *(F.sum(F.col(a) * F.col(b)).alias(f"xx{i}") for i, (a, b) in enumerate(pairs)), *(F.sum(F.col(a) * F.col(y)).alias(f"xy{i}") for i, a in enumerate(xs))).first()
    xx = np.zeros((len(xs), len(xs)))
    for i, (a, b) in enumerate(pairs):
        xx[xs.index(a), xs.index(b)] = xx[xs.index(b), xs.index(a)] = sums[f"xx{i}"]
    if np.linalg.matrix_rank(xx) < len(xs):
        raise ValueError("the regressors are collinear")
    beta = np.linalg.solve(xx, [sums[f"xy{i}"] for i in range(len(xs))])
    error = F.col(y) - sum((float(b) * F.col(x) for b, x in zip(beta, xs)), F.lit(0.0))
    scores = flat.groupBy("_g").agg(*(F.sum(F.col(x) * error).alias(x) for x in xs))
    meat_row = scores.agg(F.count("*").alias("g"), *(F.sum(F.col(a) * F.col(b)).alias(f"m{i}") for i, (a, b) in enumerate(pairs))).first()
    meat = np.zeros_like(xx)
    for i, (a, b) in enumerate(pairs):
        meat[xs.index(a), xs.index(b)] = meat[xs.index(b), xs.index(a)] = meat_row[f"m{i}"]
    g = meat_row["g"]
    bread = np.linalg.inv(xx)
    cov = bread @ meat @ bread * (g / max(1, g - 1))
    return [(x, float(b), float(s)) for x, b, s in zip(xs, beta, np.sqrt(np.diag(cov)))]
