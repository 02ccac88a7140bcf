"""Event facts of a ticker and session, their outcomes, credibility, paths, stories and portfolios."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylark.operators import series as S
from quaylark.session import ship, stored


def event_table(items: DataFrame) -> DataFrame:
    """One row for each ticker and session of items (ticker, session, event_type, score, ts)."""
    strongest = F.struct(F.abs("score").alias("a"), (-F.col("event_id")).alias("e"))
    return items.where("session IS NOT NULL").groupBy("ticker", "session").agg(
        F.count("*").alias("n"),
        F.round(F.sum("score"), 4).alias("score"),
        F.signum(F.bround(F.sum("score"), 6)).cast("int").alias("direction"),
        F.max_by("event_type", strongest).alias("event_type"),
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"),
        F.round(F.avg((F.col("score") < 0).cast("double")), 6).alias("bad_share"),
    )


def outcomes(events: DataFrame, prices: DataFrame, horizon: int, shift: Column) -> DataFrame:
    """Events with the return from `shift` sessions after them over `horizon` sessions: an equi-join on shifted positions."""
    p = prices.select("ticker", F.col("trading_index").alias("_i"), F.col("close").alias("_c"))
    entry = p.select("ticker", F.col("_i").alias("_a"), F.col("_c").alias("entry"))
    leave = p.select("ticker", F.col("_i").alias("_b"), F.col("_c").alias("leave"))
    out = events.withColumn("_a", F.col("trading_index") + shift).withColumn("_b", F.col("_a") + horizon)
    out = out.join(entry, ["ticker", "_a"], "left").join(leave, ["ticker", "_b"], "left")
    return out.withColumn("ret", F.try_divide("leave", "entry") - 1).drop("_a", "_b", "entry", "leave")


def credibility(probes: DataFrame, known: DataFrame, key: str, at: str, k: float = 10.0) -> DataFrame:
    """probes with the share of right outcomes of their key known at or before them, drawn to a half by k, less a half."""
    got = S.as_of(probes, known, key, at, {"_s": lambda w: F.sum("_f_y").over(w), "_n": lambda w: F.count("_f_y").over(w)})
    return got.withColumn("credibility", (F.coalesce("_s", F.lit(0.0)) + 0.5 * k) / (F.col("_n") + k) - 0.5).drop("_s", "_n")


def paths(events: DataFrame, ar: DataFrame, before: int, after: int) -> DataFrame:
    """events x offsets k with the abnormal return there and its running sum from the first offset."""
    spread = events.withColumn("k", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("_at", F.col("trading_index") + F.col("k"))
    met = spread.join(ar.select("ticker", F.col("trading_index").alias("_at"), "ar"), ["ticker", "_at"], "left").drop("_at")
    w = Window.partitionBy("ticker", "trading_index").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumn("car", F.sum("ar").over(w))


def stories(items: DataFrame, look_back: int, threshold: float) -> DataFrame:
    """items (id, key, at, vec) with root and rank: each joins its most alike predecessor of the key within look_back, if
    alike enough (cosine of unit vectors), else begins a story. The choice of predecessor needs no state, so it is a band
    join; roots are found by pointer doubling, in as many rounds as the logarithm of the longest chain.

    The band is met by buckets of look_back: an item of bucket b has its predecessors in b and b - 1."""
    a = items.select("key", "id", "at", "vec", F.floor(F.col("at") / look_back).alias("b"))
    past = a.select("key", F.col("id").alias("id2"), F.col("at").alias("at2"), F.col("vec").alias("vec2"), F.explode(F.array("b", F.col("b") + 1)).alias("b"))
    dot = F.aggregate(F.zip_with("vec", "vec2", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    near = a.join(past, ["key", "b"]).where((F.col("at2") >= F.col("at") - look_back) & ((F.col("at2") < F.col("at")) | ((F.col("at2") == F.col("at")) & (F.col("id2") < F.col("id")))))
    best = near.withColumn("sim", F.round(dot, 9)).where(F.col("sim") >= threshold).groupBy("id").agg(F.max_by("id2", F.struct("sim", (-F.col("at2")).alias("t"), (-F.col("id2")).alias("i"))).alias("parent"))
    now = stored(items.select("id").join(best, "id", "left").select("id", F.coalesce("parent", "id").alias("parent"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("rank")), "forest")
    for _ in range(64):
        up = now.select(F.col("id").alias("parent"), F.col("parent").alias("top"), F.col("rank").alias("more"))
        after = stored(now.join(up, "parent").select("id", F.col("top").alias("parent"), (F.col("rank") + F.col("more")).alias("rank"), (F.col("top") != F.col("parent")).alias("moved")), "forest")
        moved = after.where("moved").limit(1).count()
        now = after.drop("moved")
        if not moved:
            break
    return now.select("id", F.col("parent").alias("root"), (F.col("rank") + 1).alias("rank"))


def simulate(signals: DataFrame, keys: list[str], slots: int, hold: int, cost: float, capital: float = 100.0) -> DataFrame:
    """simulate_runs with the same slots, holding time and cost for all runs."""
    return simulate_runs(signals.withColumns({"slots": F.lit(slots), "hold": F.lit(hold), "cost": F.lit(float(cost))}), keys, capital)


def simulate_runs(signals: DataFrame, keys: list[str], capital: float = 100.0) -> DataFrame:
    """Equity of portfolios of equal slots: signals (t, priority, ret) enter in order of priority where a slot is free, hold for
    `hold` sessions and compound. Slots are state from one session to the next, so each run (keys, with slots, hold and cost) is
    one group; runs are dealt out in parallel. No more than `slots` signals of a session can enter, so the rest is cut
    before: a group has slots * sessions rows at most. Returns keys, trades, value."""
    ship(signals.sparkSession)
    order = Window.partitionBy(*keys, "t").orderBy(F.desc("priority"), F.desc("ret"))
    best = signals.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= F.col("slots"))

    def run(pdf):
        slots, hold, cost = int(pdf.slots.iloc[0]), int(pdf.hold.iloc[0]), float(pdf.cost.iloc[0])
        free = [(-1, k, capital / slots) for k in range(slots)]  # busy until, slot, value
        trades = 0
        for t, r in pdf.sort_values(["t", "_k"])[["t", "ret"]].itertuples(index=False):
            if free[0][0] < t:
                until, k, value = heapq.heappop(free)
                heapq.heappush(free, (t + hold, k, value * (1 + r - cost)))
                trades += 1
        return pdf.iloc[:1][keys].assign(trades=trades, value=sum(v for *_, v in sorted(free, key=lambda x: x[1])))

    kinds = {f.name: f.dataType.simpleString() for f in signals.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "trades long, value double"])
    return best.select(*keys, "t", "ret", "_k", "slots", "hold", "cost").groupBy(*keys).applyInPandas(run, schema)
