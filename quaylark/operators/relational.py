"""Joins, aggregates and selections with the engine's null and tie rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylark.operators import ordering


def ordered_case(cases: list[tuple[Column, object]], other: object = None) -> Column:
    """The value of the first case that holds."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(other)


def last_case(cases: list[tuple[Column, object]], other: object = None) -> Column:
    """The value of the last case that holds: later rules overwrite earlier ones."""
    return ordered_case(cases[::-1], other)


def lookup(rows: DataFrame, dim: DataFrame, keys: list[str], default: dict | None = None) -> DataFrame:
    """Left join with a dimension; defaults where it has no row. Catalyst broadcasts a small dimension."""
    out = rows.join(dim, keys, "left")
    return out.fillna(default) if default else out


def three_classes(z: Column, threshold: float = 0.5) -> Column:
    """Sign of z beyond the threshold, else 0; null stays null."""
    return F.when(z.isNull(), None).when(F.abs(z) > threshold, F.signum(z).cast("int")).otherwise(0)


def flag(condition: Column, known: Column) -> Column:
    """1.0 or 0.0 where `known` isn't null, else null."""
    return F.when(known.isNotNull(), condition.cast("double"))


def combine_first(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """All keys of either; a's values, b's where a has none."""
    left, right = a.alias("a"), b.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    return left.join(right, on, "full").select(*(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in [*keys, *columns]))


def expand_band(rows: DataFrame, at: str, width: int, last: Column) -> DataFrame:
    """Each row at its position and the `width` after it, up to `last`, without repeats."""
    return rows.withColumn(at, F.explode(F.sequence(F.col(at), F.least(F.col(at) + width, last)))).distinct()


def distinct_text(col: str, sep: str = ",") -> Column:
    """Sorted distinct values, joined."""
    return F.array_join(F.array_sort(F.collect_set(col)), sep)


def first_unique(order: str, col: str, n: int, sep: str = " | ") -> Column:
    """The first n distinct values in order, joined."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(order, col))), lambda x: x[col])
    return F.array_join(F.slice(F.array_distinct(rows), 1, n), sep)


def best_row(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_share(rows: DataFrame, keys: list[str], share: float, order: list[Column]) -> DataFrame:
    """The best round(share x size) rows of each key, at least one."""
    w = Window.partitionBy(*keys)
    n = F.greatest(F.lit(1), F.bround(F.lit(share) * F.count("*").over(w)).cast("int"))
    return rows.withColumns({"_n": F.row_number().over(w.orderBy(*order)), "_most": n}).where("_n <= _most").drop("_n", "_most")


def shrunk(rows: DataFrame, cell: list[str], parent: list[str], outcome: str, m: float = 20.0) -> DataFrame:
    """Cell means drawn to their parent's, and parents' to the overall mean, with the weight of m rows."""
    cells = rows.groupBy(*cell).agg(F.sum(outcome).alias("s"), F.count(outcome).alias("n"))
    above = cells.groupBy(*parent).agg(F.sum("s").alias("ps"), F.sum("n").alias("pn"))
    base = above.agg((F.sum("ps") / F.sum("pn")).alias("base"))
    above = above.join(F.broadcast(base)).withColumn("parent_mean", (F.col("ps") + m * F.col("base")) / (F.col("pn") + m))
    out = cells.join(above.select(*parent, "parent_mean", "base"), parent)
    out = out.withColumn("mean", (F.col("s") + m * F.col("parent_mean")) / (F.col("n") + m))
    return out.withColumn("confidence", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (F.col("mean") - F.col("base")))))


def winsorized(rows: DataFrame, train: Column, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Columns cut at quantiles of the training rows."""
    edges = ordering.quantile_row(rows.where(train), columns, [low, high])
    return rows.withColumns({c: F.least(F.greatest(F.col(c), F.lit(edges[c][0])), F.lit(edges[c][1])) for c in columns if edges[c][0] is not None})


def imputed(rows: DataFrame, train: Column, columns: list[str]) -> DataFrame:
    """Infinite values are unknown; unknown values become the training rows' median."""
    finite = rows.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in columns})
    mids = ordering.quantile_row(finite.where(train), columns, [0.5])
    return finite.withColumns({c: F.coalesce(c, F.lit(mids[c][0])) for c in columns})


def stratified(rows: DataFrame, stratum: str, key: str, sizes: Column, seed: str) -> DataFrame:
    """sizes rows of each stratum, drawn by a hash of key and seed, with their inclusion probability pi."""
    w = Window.partitionBy(stratum)
    order = w.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary")))
    out = rows.withColumns({"_n": F.row_number().over(order), "_all": F.count("*").over(w)}).withColumn("_take", F.least(sizes, F.col("_all")))
    return out.where("_n <= _take").withColumn("pi", F.col("_take") / F.col("_all")).drop("_n", "_all", "_take")
