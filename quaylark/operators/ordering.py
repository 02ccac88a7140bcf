"""Ranks, running sums and quantiles over the whole of a table, without one task that sees every row.

Rows are dealt by ranges of their order; each range is summed up by itself, the few sums are added up, and each range goes on
from what the ranges before it hold."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaylark.session import stored


def ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with _p, the number of their range; equal rows are in one range. Stored, so the numbers stay."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), "ranges")


def running(rows: DataFrame, order: list[str], value: str, out: str = "before") -> DataFrame:
    """rows (distinct in `order`) with out: the sum of value over all rows that come before."""
    dealt = ranged(rows, order)
    sums = dealt.groupBy("_p").agg(F.sum(value).alias("_s"))
    # a row for each range
    offsets = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn(out, own).join(F.broadcast(offsets), "_p").withColumn(out, F.col(out) + F.col("_o")).drop("_p", "_o")


def ordered_sums(rows: DataFrame, key: str, order: str, value: str, out: str = "added") -> DataFrame:
    """key, out: the known values of each key added one by one in order, so the sum of doubles is the same wherever the rows lie. Rows
    are sorted and stream by; none are held."""

    def fold(batches):
        at, total = None, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = []
            for k, v in zip(keys, values):
                if k != at:
                    if at is not None:
                        found.append((at, total))
                    at, total = k, 0.0
                total += v
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], batch.schema.field(0).type), pa.array([t for _, t in found], pa.float64())], [key, out])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], batch.schema.field(0).type), pa.array([total], pa.float64())], [key, out])

    dealt = rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, order, value).select(key, value)
    return dealt.mapInArrow(fold, f"{key} {dict(rows.dtypes)[key]}, {out} double")


def least_from(rows: DataFrame, order: list[str], value: str, out: str = "least") -> DataFrame:
    """rows (distinct in `order`) with out: the least value of the row and all after it."""
    dealt = ranged(rows, order)
    sums = dealt.groupBy("_p").agg(F.min(value).alias("_s"))
    after = sums.select("_p", F.min("_s").over(Window.orderBy("_p").rowsBetween(1, Window.unboundedFollowing)).alias("_o"))
    own = F.min(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(0, Window.unboundedFollowing))
    return dealt.withColumn(out, own).join(F.broadcast(after), "_p").withColumn(out, F.least(out, "_o")).drop("_p", "_o")


def quantiles(rows: DataFrame, column: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """by, share, value: exact quantiles, interpolated, of the known values of a column in each group.

    Values are counted, the counts run over the global order, and only the two rows about each quantile go on."""
    by = by or []
    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    counts = running(counts, [*by, "_v"], "_n", "_b")
    groups = counts.groupBy(*by).agg(F.min("_b").alias("_first"), F.sum("_n").alias("_all"))
    placed = (counts.join(groups, by) if by else counts.join(F.broadcast(groups))).withColumn("_b", F.col("_b") - F.col("_first"))
    placed = placed.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("_h", F.col("share") * (F.col("_all") - 1))
    at = F.floor("_h")
    low, high = (F.col("_b") <= at) & (at < F.col("_b") + F.col("_n")), (F.col("_b") <= at + 1) & (at + 1 < F.col("_b") + F.col("_n"))
    near = placed.where(low | high).groupBy(*by, "share", "_h").agg(F.max(F.when(low, F.col("_v"))).alias("_low"), F.max(F.when(high, F.col("_v"))).alias("_high"))
    return near.select(*by, "share", (F.col("_low") + (F.coalesce("_high", "_low") - F.col("_low")) * (F.col("_h") - F.floor("_h"))).alias("value"))


def earlier_quantile(rows: DataFrame, group: str, column: str, share: float) -> DataFrame:
    """group, value: for each group but the first, the exact quantile, interpolated, of the known values of all groups before it.

    Values are counted by group and dealt by ranges. The counts of each range and group tell in which ranges a group's quantile
    lies; only the values of these are looked at for it."""
    counts = ranged(rows.where(F.col(column).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(column).alias("_v")).agg(F.count("*").alias("_n")), ["_v"])
    sums = counts.groupBy("_p", "_g").agg(F.sum("_n").alias("_s"))  # a row for each range and group
    later = F.broadcast(rows.select(F.col(group).alias("_l")).distinct())
    ends = sums.join(later, F.col("_g") < F.col("_l")).groupBy("_l", "_p").agg(F.sum("_s").alias("_s"))
    of = Window.partitionBy("_l")
    ends = ends.withColumns({"_b": F.sum("_s").over(of.orderBy("_p")) - F.col("_s"), "_h": F.lit(share) * (F.sum("_s").over(of) - 1)})
    near = ends.where((F.col("_b") <= F.floor("_h") + 1) & (F.floor("_h") < F.col("_b") + F.col("_s"))).select("_l", "_p", "_b", "_h")
    values = counts.join(F.broadcast(near), "_p").where(F.col("_g") < F.col("_l")).groupBy("_l", "_p", "_b", "_h", "_v").agg(F.sum("_n").alias("_n"))
    values = values.withColumn("_b", F.col("_b") + F.sum("_n").over(Window.partitionBy("_l", "_p").orderBy("_v")) - F.col("_n"))
    at = F.floor("_h")
    holds = lambda k: (F.col("_b") <= k) & (k < F.col("_b") + F.col("_n"))
    found = values.groupBy(F.col("_l").alias(group), "_h").agg(F.max(F.when(holds(at), F.col("_v"))).alias("_low"), F.max(F.when(holds(at + 1), F.col("_v"))).alias("_high"))
    return found.select(group, (F.col("_low") + (F.coalesce("_high", "_low") - F.col("_low")) * (F.col("_h") - F.floor("_h"))).alias("value"))


def quantile_row(rows: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """The quantiles of some columns, as numbers: a row for each column and share."""
    out = {}
    for c in columns:
        found = {r["share"]: r["value"] for r in quantiles(rows, c, shares).collect()}
        out[c] = [found.get(s) for s in shares]
    return out


def rank_share(rows: DataFrame, column: str, out: str) -> DataFrame:
    """rows with out: the mean rank of a value among all known ones, as a share; null for null."""
    counts = running(rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n")), [column], "_n", "_b")
    total = counts.agg(F.sum("_n").alias("_all"))  # one row
    ranks = counts.join(F.broadcast(total)).select(column, ((F.col("_b") + (F.col("_n") + 1) / 2) / F.col("_all")).alias(out))
    return rows.join(ranks, column, "left")
