"""Decisions from scores: clipped logits, normalised chances, priors, consensus, selection so far, splits for the latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clipped(p: Column, eps: float = 1e-6) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clipped(p, eps)
    return F.ln(q / (1 - q))


def normalised(p: str, eps: float = 1e-6) -> Column:
    """An array of chances, none below eps, with the sum 1."""
    lifted = F.transform(p, lambda x: F.greatest(x, F.lit(eps)))
    total = F.aggregate(lifted, F.lit(0.0), lambda s, x: s + x)
    return F.transform(lifted, lambda x: x / total)


def argmax_over_prior(p: str, prior: str, classes: list[str]) -> Column:
    """The class with the greatest chance in proportion to its prior, the first of equal ones."""
    lift = F.transform(F.arrays_zip(F.col(p).alias("p"), F.col(prior).alias("q")), lambda x: F.round(x["p"] / x["q"], 9))
    return F.element_at(F.array(*map(F.lit, classes)), F.array_position(lift, F.array_max(lift)).cast("int"))


def direction(r: str) -> Column:
    """1 for a rise, 0 for a fall, null where nothing moved or nothing is known."""
    return F.when(F.col(r) > 0, 1).when(F.col(r) < 0, 0)


def share_before(rows: DataFrame, fold: str, y: str) -> DataFrame:
    """fold, prior: the share of y over all folds before. A row a fold."""
    sums = rows.groupBy(fold).agg(F.sum(F.col(y).cast("double")).alias("_s"), F.count(y).alias("_n"))
    w = Window.orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(fold, F.try_divide(F.sum("_s").over(w), F.sum("_n").over(w)).alias("prior")).where("prior IS NOT NULL")


def best_so_far(cells: DataFrame, fold: str, rule: str, good: str, n: str) -> DataFrame:
    """fold, rule, so_far: for each fold the rule with the best share over the folds before, the least of equal ones. cells: a row
    for each fold and rule."""
    w = Window.partitionBy(rule).orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)
    seen = cells.select(fold, rule, F.try_divide(F.sum(good).over(w), F.sum(n).over(w)).alias("so_far")).where("so_far IS NOT NULL")
    first = Window.partitionBy(fold).orderBy(F.desc(F.round("so_far", 12)), rule)
    return seen.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def agree(votes: list[Column], least: int) -> Column:
    """At least `least` of the votes are cast."""
    return sum((v.cast("int") for v in votes), F.lit(0)) >= least


def share_interval(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """A share and its normal interval."""
    p = k / n
    half = z * F.sqrt(p * (1 - p) / n)
    return p, p - half, p + half


def latest_part(date: str, last: str, old_days: int, fresh_days: int) -> Column:
    """latest (the last fresh_days), val (the last quarter, or the one before where that is at most old_days old) or train."""
    quarter = F.date_trunc("quarter", F.col(last)).cast("date")
    begin = F.when(F.datediff(last, quarter) > old_days, quarter).otherwise(F.add_months(quarter, -3))
    return F.when(F.col(date) >= F.date_sub(last, fresh_days), "latest").when(F.col(date) >= begin, "val").otherwise("train")
