"""Sessions and time series: calendars, dense panels, frames with a least count, decay, ranks, islands, as-of joins.

All windows are partitioned by ticker or by date. The only unpartitioned ones run over calendars, one row a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calendar(days: DataFrame) -> DataFrame:
    """date, trading_index from 0: the ordered session axis."""
    return days.select("date").where(F.col("date").isNotNull()).distinct().withColumn("trading_index", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))


def densify(facts: DataFrame, cal: DataFrame, members: DataFrame, member: str, fill: dict | None = None) -> DataFrame:
    """A row for every session and member, facts where there are any. The grid is calendar x members, both dimensions;
    the calendar's rows are broadcast."""
    grid = members.select(member).join(F.broadcast(cal.select("date", "trading_index")))
    out = grid.join(facts, ["date", member], "left")
    return out.fillna(fill) if fill else out


def by(member: str | None = "ticker", order: str = "trading_index"):
    return Window.partitionBy(member).orderBy(order) if member else Window.orderBy(order)


def frame(width: int, skip: int = 0, member: str | None = "ticker", order: str = "trading_index"):
    """The last `width` rows, ending `skip` rows before this one."""
    return by(member, order).rowsBetween(-(width - 1) - skip, -skip)


def rolled(agg, col: str | Column, width: int, least: int | None = None, skip: int = 0, member: str | None = "ticker", order: str = "trading_index") -> Column:
    """agg over the frame; null with fewer than `least` values (all of them if not given)."""
    col = F.col(col) if isinstance(col, str) else col
    w = frame(width, skip, member, order)
    return F.when(F.count(col).over(w) >= (width if least is None else least), agg(col).over(w))


def median(col: Column) -> Column:
    return F.percentile(col, F.lit(0.5))


def z_score(col: str, width: int, least: int | None = None, skip: int = 0, member: str | None = "ticker") -> Column:
    """Distance from the trailing mean in trailing standard deviations; null where that is 0."""
    mean, sd = (rolled(a, col, width, least, skip, member) for a in (F.avg, F.stddev_samp))
    return F.try_divide(F.col(col) - mean, F.nullif(sd, F.lit(0.0)))


def log_return(close: str = "close", member: str = "ticker") -> Column:
    """Difference of logs to the session before; null if either is missing."""
    return F.ln(close) - F.lag(F.ln(close)).over(by(member))


def decayed(col: str, half_life: int, member: str | None = "ticker", order: str = "trading_index") -> Column:
    """Sum of 2^(-age / half_life) times past values up to an age of three half-lives, on dense rows."""
    w = by(member, order)
    total = F.coalesce(F.col(col), F.lit(0.0))
    for age in range(1, 3 * half_life + 1):
        total = total + F.lit(2.0 ** (-age / half_life)) * F.coalesce(F.lag(col, age).over(w), F.lit(0.0))
    return total


def ahead(col: str, start: int, end: int, member: str | None = "ticker") -> Column:
    """Sum over the rows from `start` to `end` after this one; null if one is missing."""
    w = by(member).rowsBetween(start, end)
    return F.when(F.count(col).over(w) == end - start + 1, F.sum(col).over(w))


def rank_share(col: str, partition: list[str]) -> Column:
    """Rank of a value among the known ones of its partition, ties averaged, as a share; null for null."""
    w = Window.partitionBy(*partition).orderBy(F.col(col).asc_nulls_last())
    ties = F.count(col).over(Window.partitionBy(*partition, col))
    return F.when(F.col(col).isNotNull(), (F.rank().over(w) + (ties - 1) / 2) / F.count(col).over(Window.partitionBy(*partition)))


def mean_rank(col: str, partition: list[str]) -> Column:
    """Rank with ties averaged."""
    w, ties = Window.partitionBy(*partition).orderBy(col), Window.partitionBy(*partition, col)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2


def islands(rows: DataFrame, at: str, gap: int, out: str = "island", member: str | None = None) -> DataFrame:
    """Number the runs of rows whose distance to the row before is at most `gap` (days for dates, else units)."""
    w = Window.partitionBy(*([member] if member else [])).orderBy(at)
    distance = F.datediff(at, F.lag(at).over(w)) if dict(rows.dtypes)[at] == "date" else F.col(at) - F.lag(at).over(w)
    starts = rows.withColumn("_new", F.when(distance.isNull() | (distance > gap), 1).otherwise(0))
    return starts.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def since_last(flag: str, member: str | None = "ticker") -> Column:
    """Sessions since the flag was last set before this one."""
    w = by(member).rowsBetween(Window.unboundedPreceding, -1)
    return F.col("trading_index") - F.last(F.when(F.col(flag), F.col("trading_index")), ignorenulls=True).over(w)


def next_session_map(cal: DataFrame, first, last) -> DataFrame:
    """day, session for each day from first to last: the first session on or after the day."""
    days = cal.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    w = Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    return days.join(F.broadcast(cal.select(F.col("date").alias("day"), F.col("date").alias("_s"))), "day", "left").select("day", F.first("_s", ignorenulls=True).over(w).alias("session"))


def to_session(rows: DataFrame, ts: str, cal: DataFrame, cutoff: str = "14:45") -> DataFrame:
    """rows with session: the first session on or after the item's day, the next day from the cutoff on; null past the last."""
    hour, minute = (int(x) for x in cutoff.split(":"))
    late = F.hour(ts) * 60 + F.minute(ts) >= hour * 60 + minute
    keyed = rows.withColumn("_day", F.date_add(F.col(ts).cast("date"), F.when(late, 1).otherwise(0)))
    ends = cal.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    if ends["a"] is None:
        return keyed.withColumn("session", F.lit(None).cast("date")).drop("_day")
    mapped = next_session_map(cal, F.lit(ends["a"]), F.lit(ends["b"]))
    # one row a calendar day
    joined = keyed.withColumn("_day", F.greatest("_day", F.lit(ends["a"]))).join(F.broadcast(mapped.withColumnRenamed("day", "_day")), "_day", "left")
    return joined.drop("_day")


def as_of(probes: DataFrame, facts: DataFrame, key: str, at: str, values: dict[str, Column]) -> DataFrame:
    """probes with values, each an aggregate of the facts of their key known at or before them.

    Facts and probes are laid on one axis, so one shuffle by key does it. values: name to the aggregate's argument and
    function, as a callable from a window to a column."""
    names = [c for c in facts.columns if c not in (key, at)]
    probe = probes.select(key, at, *[c for c in probes.columns if c not in (key, at)], F.lit(True).alias("_probe"))
    both = probe.unionByName(facts.select(key, at, *(F.col(c).alias(f"_f_{c}") for c in names), F.lit(False).alias("_probe")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.select("*", *(f(w).alias(n) for n, f in values.items())).where("_probe").drop("_probe", *(f"_f_{c}" for c in names))


def ecdf(rows: DataFrame, score: str, is_ref: Column, partition: list[str], out: str) -> DataFrame:
    """rows with out: the share of reference scores of the partition that are at most this one."""
    w = Window.partitionBy(*partition).orderBy(score).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ref = F.when(is_ref, 1).otherwise(0)
    return rows.withColumn(out, F.try_divide(F.sum(ref).over(w), F.sum(ref).over(Window.partitionBy(*partition))))
