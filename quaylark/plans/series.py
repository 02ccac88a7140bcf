"""Time-series queries on the price panel, the daily series and the news counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaylark.operators import series as S
from quaylark.plans.registry import query
from quaylark.plans.tables import DAILY, NEWS, NEWS_CAL, PANEL, PRICES, RETURNS, daily, news, news_calendar, panel, prices

W = "PARTITION BY ticker ORDER BY trading_index"


def _returns(spark, d):
    return panel(spark, d).withColumn("r", S.log_return())


def _r(*names, n=6):
    return [F.round(c, n).alias(c) for c in names]


@query(f"WITH {PANEL} SELECT date, trading_index, ticker, close, volume FROM panel")
def densify_calendar(spark, d):
    return panel(spark, d).select("date", "trading_index", "ticker", "close", "volume")


@query("WITH c AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) SELECT date, row_number() OVER (ORDER BY date) - 1 AS trading_index FROM c")
def trading_calendar(spark, d):
    return daily(spark, d).select("date", "trading_index")


@query(f"WITH {RETURNS} SELECT date, ticker, round(r, 6) AS r FROM ret WHERE r IS NOT NULL")
def log_return_no_ffill(spark, d):
    return _returns(spark, d).where("r IS NOT NULL").select("date", "ticker", *_r("r"))


@query(f"WITH {PANEL} SELECT date, ticker, round(close / lag(close) OVER ({W}) - 1, 6) AS simple FROM panel")
def simple_return(spark, d):
    return panel(spark, d).select("date", "ticker", F.round(F.try_divide("close", F.lag("close").over(S.by())) - 1, 6).alias("simple"))


@query(f"""WITH {RETURNS} SELECT date, ticker,
  round(CASE WHEN count(r) OVER w20 >= 5 THEN avg(r) OVER w20 END, 6) AS mean20, round(CASE WHEN count(r) OVER w20 >= 5 THEN stddev_samp(r) OVER w20 END, 6) AS sd20,
  round(CASE WHEN count(close) OVER w5 >= 5 THEN max(close) OVER w5 END, 6) AS max5, round(CASE WHEN count(volume) OVER w5 >= 1 THEN sum(volume) OVER w5 END, 4) AS vol5
FROM ret WINDOW w20 AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w5 AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def rolling_min_periods(spark, d):
    rows = _returns(spark, d)
    return rows.select("date", "ticker", F.round(S.rolled(F.avg, "r", 20, 5), 6).alias("mean20"), F.round(S.rolled(F.stddev_samp, "r", 20, 5), 6).alias("sd20"), F.round(S.rolled(F.max, "close", 5), 6).alias("max5"), F.round(S.rolled(F.sum, "volume", 5, 1), 4).alias("vol5"))


@query(f"""WITH {PANEL} SELECT date, ticker, round((volume - CASE WHEN count(volume) OVER w >= 10 THEN avg(volume) OVER w END)
  / nullif(CASE WHEN count(volume) OVER w >= 10 THEN stddev_samp(volume) OVER w END, 0), 5) AS z FROM panel WINDOW w AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def rolling_prev_window_z(spark, d):
    return panel(spark, d).select("date", "ticker", F.round(S.z_score("volume", 20, 10, 1), 5).alias("z"))


@query(f"""WITH {RETURNS}, m AS (SELECT *, close * volume / 1e6 AS value, CASE WHEN r = 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END AS still FROM ret),
  q AS (SELECT date, ticker, CASE WHEN count(still) OVER a >= 20 THEN avg(still) OVER a END AS share, CASE WHEN count(value) OVER a >= 20 THEN quantile_cont(value, 0.5) OVER a END AS mid
  FROM m WINDOW a AS ({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT date, ticker, round(mid, 10) AS mid, CASE WHEN share IS NULL AND mid IS NULL THEN NULL ELSE coalesce(share > 0.3, false) OR coalesce(mid < 0.05, false) END AS illiquid FROM q""")
def rolling_median_liquidity(spark, d):
    rows = _returns(spark, d).withColumns({"value": F.col("close") * F.col("volume") / 1e6, "still": F.when(F.col("r") == 0, 1.0).when(F.col("r").isNotNull(), 0.0)})
    rows = rows.withColumns({"share": S.rolled(F.avg, "still", 60, 20, 1), "mid": S.rolled(S.median, "value", 60, 20, 1)})
    flag = F.coalesce(F.col("share") > 0.3, F.lit(False)) | F.coalesce(F.col("mid") < 0.05, F.lit(False))
    return rows.select("date", "ticker", F.round("mid", 10).alias("mid"), F.when(F.col("share").isNotNull() | F.col("mid").isNotNull(), flag).alias("illiquid"))


@query(f"""WITH {RETURNS}, a AS (SELECT *, abs(r) / nullif(close * volume / 1e6, 0) AS x FROM ret)
SELECT date, ticker, round(CASE WHEN count(x) OVER w >= 10 THEN avg(x) OVER w END, 6) AS amihud FROM a WINDOW w AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def amihud(spark, d):
    rows = _returns(spark, d).withColumn("x", F.try_divide(F.abs("r"), F.nullif(F.col("close") * F.col("volume") / 1e6, F.lit(0.0))))
    return rows.select("date", "ticker", F.round(S.rolled(F.avg, "x", 20, 10), 6).alias("amihud"))


@query(f"""WITH {PANEL}, l AS (SELECT ticker, min(trading_index) FILTER (close IS NOT NULL) AS a, max(trading_index) FILTER (close IS NOT NULL) AS b FROM panel GROUP BY ticker)
SELECT date, panel.ticker, close IS NULL AND trading_index BETWEEN a AND b AS suspended FROM panel JOIN l ON l.ticker = panel.ticker""")
def suspended_flag(spark, d):
    rows, known = panel(spark, d), F.when(F.col("close").isNotNull(), F.col("trading_index"))
    every = Window.partitionBy("ticker")
    return rows.select("date", "ticker", (F.col("close").isNull() & F.col("trading_index").between(F.min(known).over(every), F.max(known).over(every))).alias("suspended"))


@query(f"""WITH {RETURNS}, b AS (SELECT date, trading_index, CASE WHEN count(r) >= 10 THEN avg(r) END AS r FROM ret GROUP BY 1, 2)
SELECT date, round(r, 6) AS r, round(sum(coalesce(r, 0)) OVER (ORDER BY trading_index), 6) AS log_level FROM b""")
def benchmark_equal_weight(spark, d):
    index = _returns(spark, d).groupBy("date", "trading_index").agg(F.when(F.count("r") >= 10, F.avg("r")).alias("r"))
    return index.select("date", F.round("r", 6).alias("r"), F.round(F.sum(F.coalesce("r", F.lit(0.0))).over(Window.orderBy("trading_index")), 6).alias("log_level"))


@query(f"""WITH {RETURNS} SELECT date, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) FILTER (r IS NOT NULL) AS breadth, CAST(count(*) FILTER (r > 0.069) AS DOUBLE) / count(*) AS ceiling_share
FROM ret GROUP BY date HAVING count(r) > 0""")
def breadth(spark, d):
    rows = _returns(spark, d).groupBy("date").agg(F.avg(F.when(F.col("r").isNotNull(), F.when(F.col("r") > 0, 1.0).otherwise(0.0))).alias("breadth"), (F.count_if(F.col("r") > 0.069) / F.count("*")).alias("ceiling_share"), F.count("r").alias("n"))
    return rows.where("n > 0").drop("n")


@query(f"""WITH {DAILY}, r AS (SELECT *, ln(level) - lag(ln(level)) OVER (ORDER BY trading_index) AS r FROM daily),
f AS (SELECT date, trading_index, CASE WHEN count(r) OVER f5 = 5 THEN sum(r) OVER f5 END AS r5, CASE WHEN count(r) OVER f1 = 1 THEN sum(r) OVER f1 END AS r1,
  CASE WHEN count(r) OVER b60 >= 40 THEN stddev_samp(r) OVER b60 END AS sd FROM r
  WINDOW f5 AS (ORDER BY trading_index ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), f1 AS (ORDER BY trading_index ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING), b60 AS (ORDER BY trading_index ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, r5 / (sd * sqrt(5)) AS z5 FROM f)
SELECT date, round(r1, 6) AS r1, round(r5, 6) AS r5, round(z5, 5) AS z5, CASE WHEN z5 IS NULL THEN NULL WHEN abs(z5) > 0.5 THEN CAST(sign(z5) AS INTEGER) ELSE 0 END AS y5,
  CASE WHEN z5 IS NOT NULL THEN CASE WHEN abs(z5) > 1.5 THEN 1e0 ELSE 0e0 END END AS big FROM z""")
def forward_targets(spark, d):
    rows = daily(spark, d).withColumn("r", F.ln("level") - F.lag(F.ln("level")).over(S.by(None)))
    rows = rows.withColumns({"r1": S.ahead("r", 1, 1, None), "r5": S.ahead("r", 1, 5, None), "sd": S.rolled(F.stddev_samp, "r", 60, 40, member=None)})
    rows = rows.withColumn("z5", F.try_divide("r5", F.col("sd") * F.sqrt(F.lit(5))))
    y = F.when(F.col("z5").isNull(), None).when(F.abs("z5") > 0.5, F.signum("z5").cast("int")).otherwise(0)
    big = F.when(F.col("z5").isNotNull(), (F.abs("z5") > 1.5).cast("double"))
    return rows.select("date", *_r("r1", "r5"), F.round("z5", 5).alias("z5"), y.alias("y5"), big.alias("big"))


@query(f"""WITH {DAILY} SELECT date, round(avg(volume) OVER (ORDER BY trading_index ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) - avg(volume) OVER (ORDER BY trading_index ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS attention
FROM daily QUALIFY count(*) OVER (ORDER BY trading_index ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) = 5 AND count(*) OVER (ORDER BY trading_index ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20""")
def attention_target(spark, d):
    rows = daily(spark, d).withColumns({"later": S.ahead("volume", 1, 5, None) / 5, "before": S.rolled(F.avg, "volume", 20, member=None)})
    return rows.where("later IS NOT NULL AND before IS NOT NULL").select("date", F.round(F.col("later") - F.col("before"), 6).alias("attention"))


_SESSIONS = f"""{NEWS}, {NEWS_CAL}, k AS (SELECT *, CAST(ts AS DATE) + CASE WHEN hour(ts) * 60 + minute(ts) >= 885 THEN 1 ELSE 0 END AS day FROM news),
s AS (SELECT k.*, (SELECT min(date) FROM ncal WHERE date >= k.day) AS session FROM k)"""
_DENSE = _SESSIONS + """, f AS (SELECT ticker, session AS date, count(*) AS n, sum(score) AS tone FROM s WHERE session IS NOT NULL GROUP BY 1, 2),
dense AS (SELECT c.date, c.trading_index, t.ticker, coalesce(f.n, 0) AS n, coalesce(f.tone, 0) AS tone FROM ncal c CROSS JOIN (SELECT DISTINCT ticker FROM f) t LEFT JOIN f ON f.date = c.date AND f.ticker = t.ticker)"""


def sessions(spark, d):
    """News with their session."""
    return S.to_session(news(spark, d), "ts", news_calendar(spark, d))


def dense_news(spark, d):
    """date, trading_index, ticker, n, tone: sums of each session, 0 without news."""
    facts = sessions(spark, d).where("session IS NOT NULL").groupBy("ticker", F.col("session").alias("date")).agg(F.count("*").alias("n"), F.sum("score").alias("tone"))
    return S.densify(facts, news_calendar(spark, d), facts.select("ticker").distinct(), "ticker", {"n": 0, "tone": 0.0})


@query(f"WITH {_SESSIONS} SELECT session, count(*) AS n, round(sum(score), 4) AS score FROM s GROUP BY session")
def session_map_cutoff(spark, d):
    return sessions(spark, d).groupBy("session").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"))


@query(f"""WITH {_DENSE}, x AS (SELECT a.date, a.ticker, sum(pow(2, -(a.trading_index - b.trading_index) / 3.0) * b.n) AS intensity, sum(pow(2, -(a.trading_index - b.trading_index) / 3.0) * b.tone) AS tone
  FROM dense a JOIN dense b ON a.ticker = b.ticker AND b.trading_index BETWEEN a.trading_index - 9 AND a.trading_index GROUP BY 1, 2)
SELECT date, ticker, round(intensity, 5) AS intensity, round(tone, 4) AS tone_sum, round(CASE WHEN intensity > 0 THEN tone / intensity END, 4) AS tone FROM x""")
def decay_tone(spark, d):
    rows = dense_news(spark, d).withColumns({"i": S.decayed("n", 3), "t": S.decayed("tone", 3)})
    return rows.select("date", "ticker", F.round("i", 5).alias("intensity"), F.round("t", 4).alias("tone_sum"), F.round(F.when(F.col("i") > 0, F.col("t") / F.col("i")), 4).alias("tone"))


@query(f"""WITH {_SESSIONS}, f AS (SELECT session AS date, count(*) FILTER (event_type = 'error') AS legal, count(*) AS n FROM s GROUP BY 1),
g AS (SELECT c.date, c.trading_index, coalesce(f.legal, 0) AS legal, coalesce(f.n, 0) AS n FROM ncal c LEFT JOIN f ON f.date = c.date),
x AS (SELECT a.date, sum(pow(2, -(a.trading_index - b.trading_index) / 3.0) * b.legal) FILTER (a.trading_index - b.trading_index <= 9) / sum(pow(2, -(a.trading_index - b.trading_index) / 3.0) * b.n) FILTER (a.trading_index - b.trading_index <= 9) AS s3,
  sum(pow(2, -(a.trading_index - b.trading_index) / 10.0) * b.legal) / sum(pow(2, -(a.trading_index - b.trading_index) / 10.0) * b.n) AS s10 FROM g a JOIN g b ON b.trading_index BETWEEN a.trading_index - 30 AND a.trading_index GROUP BY 1)
SELECT date, round(s3, 6) AS share3, round(s10, 6) AS share10 FROM x""")
def legal_share_two_lambda(spark, d):
    f = sessions(spark, d).groupBy(F.col("session").alias("date")).agg(F.count_if(F.col("event_type") == "error").alias("legal"), F.count("*").alias("n"))
    g = news_calendar(spark, d).join(f, "date", "left").fillna(0, ["legal", "n"])
    cut = {f"{c}{h}": S.decayed(c, h, None) for c in ("legal", "n") for h in (3, 10)}
    return g.withColumns(cut).select("date", *(F.round(F.try_divide(f"legal{h}", f"n{h}"), 6).alias(f"share{h}") for h in (3, 10)))


@query(f"""WITH {PRICES} SELECT date, ticker, round((rank() OVER (PARTITION BY date ORDER BY close) + (count(*) OVER (PARTITION BY date, close) - 1) / 2.0) / count(close) OVER (PARTITION BY date), 6) AS share FROM prices WHERE close IS NOT NULL""")
def cs_rank_pct(spark, d):
    return prices(spark, d).select("date", "ticker", F.round(S.rank_share("close", ["date"]), 6).alias("share"))


@query(f"WITH {DAILY} SELECT date, round(CASE WHEN count(level) OVER w >= 40 THEN avg(level) OVER w END, 4) AS mean FROM daily WINDOW w AS (ORDER BY trading_index ROWS UNBOUNDED PRECEDING)")
def expanding_mean(spark, d):
    w = S.by(None).rowsBetween(Window.unboundedPreceding, 0)
    return daily(spark, d).select("date", F.round(F.when(F.count("level").over(w) >= 40, F.avg("level").over(w)), 4).alias("mean"))


@query("""WITH u AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1 HAVING count(*) >= 2),
g AS (SELECT *, CASE WHEN date - lag(date) OVER (ORDER BY date) <= 2 THEN 0 ELSE 1 END AS new FROM u)
SELECT date, n, CAST(sum(new) OVER (ORDER BY date) AS BIGINT) AS burst FROM g""")
def gap_island_bursts(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count("*").alias("n")).where("n >= 2")
    return S.islands(rows, "date", 2, "burst").select("date", "n", "burst")


@query(f"""WITH {DAILY}, z AS (SELECT *, abs(ln(level) - lag(ln(level)) OVER (ORDER BY trading_index)) AS a FROM daily), m AS (SELECT date, trading_index FROM z WHERE a > 0.25),
k AS (SELECT *, trading_index - lag(trading_index) OVER (ORDER BY trading_index) AS gap FROM m) SELECT date, trading_index FROM k WHERE gap IS NULL OR gap > 10""")
def cluster_collapse(spark, d):
    rows = daily(spark, d).withColumn("a", F.abs(F.ln("level") - F.lag(F.ln("level")).over(S.by(None)))).where("a > 0.25")
    gap = F.col("trading_index") - F.lag("trading_index").over(S.by(None))
    return rows.withColumn("gap", gap).where("gap IS NULL OR gap > 10").select("date", "trading_index")


@query(f"WITH {_DENSE} SELECT date, ticker, trading_index - max(CASE WHEN n > 0 THEN trading_index END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM dense")
def since_last_news(spark, d):
    return dense_news(spark, d).withColumn("has", F.col("n") > 0).select("date", "ticker", S.since_last("has").alias("since"))


@query(f"""WITH {PANEL}, f AS (SELECT *, max(close) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS high, min(close) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS low FROM panel)
SELECT date, ticker, round(ln(close) - ln(high), 6) AS from_high, round(ln(close) - ln(low), 6) AS from_low FROM f""")
def distance_from_extremes(spark, d):
    w = S.frame(20)
    return panel(spark, d).select("date", "ticker", F.round(F.ln("close") - F.ln(F.max("close").over(w)), 6).alias("from_high"), F.round(F.ln("close") - F.ln(F.min("close").over(w)), 6).alias("from_low"))


@query(f"WITH {DAILY} SELECT round(min(level / top - 1), 6) AS drawdown FROM (SELECT level, max(level) OVER (ORDER BY trading_index) AS top FROM daily)")
def max_drawdown(spark, d):
    w = S.by(None).rowsBetween(Window.unboundedPreceding, 0)
    return daily(spark, d).select((F.col("level") / F.max("level").over(w) - 1).alias("x")).agg(F.round(F.min("x"), 6).alias("drawdown"))


@query(f"WITH {DAILY}, o AS (SELECT unnest([0, 1, 2, 3, 4]) AS off) SELECT CAST(off AS BIGINT) AS off, date, level FROM daily, o WHERE (trading_index - off) % 5 = 0 AND trading_index >= off")
def stride_sample(spark, d):
    offs = spark.range(5).select(F.col("id").alias("off"))
    rows = daily(spark, d).join(F.broadcast(offs), (F.col("trading_index") >= F.col("off")) & (F.pmod(F.col("trading_index") - F.col("off"), F.lit(5)) == 0))
    return rows.select("off", "date", "level")


@query(f"WITH {DAILY}, m AS (SELECT max(trading_index) AS last FROM daily) SELECT date, round(pow(0.5, (last - trading_index) / 250.0), 8) AS weight, round(pow(0.5, (DATE '2002-01-01' - date) / 365.0), 8) AS day_weight FROM daily, m")
def time_weights(spark, d):
    rows = daily(spark, d)
    last = rows.agg(F.max("trading_index").alias("last"))
    return rows.join(F.broadcast(last)).select("date", F.round(F.pow(F.lit(0.5), (F.col("last") - F.col("trading_index")) / 250), 8).alias("weight"), F.round(F.pow(F.lit(0.5), F.datediff(F.lit("2002-01-01").cast("date"), "date") / 365), 8).alias("day_weight"))


@query(f"""WITH {RETURNS}, b AS (SELECT date, CASE WHEN count(r) >= 10 THEN avg(r) END AS rb FROM ret GROUP BY date), a AS (SELECT ret.date, trading_index, ticker, r - rb AS ar FROM ret JOIN b ON b.date = ret.date)
SELECT date, ticker, round(ar - CASE WHEN count(ar) OVER w >= 60 THEN avg(ar) OVER w END, 6) AS ar_own FROM a WINDOW w AS ({W} ROWS BETWEEN 130 PRECEDING AND 11 PRECEDING)""")
def own_trend_ar(spark, d):
    rows = abnormal(spark, d)
    return rows.select("date", "ticker", F.round(F.col("ar") - S.rolled(F.avg, "ar", 120, 60, 11), 6).alias("ar_own"))


def abnormal(spark, d):
    """Returns less the equal-weight benchmark of their session (one row a session, broadcast)."""
    rows = _returns(spark, d)
    bench = rows.groupBy("date").agg(F.when(F.count("r") >= 10, F.avg("r")).alias("rb"))
    return rows.join(F.broadcast(bench), "date").withColumn("ar", F.col("r") - F.col("rb"))


@query(f"""WITH {DAILY} SELECT date, round(CASE WHEN count(volume) OVER a > 0 THEN avg(volume) OVER a END, 6) AS base_near, round(CASE WHEN count(volume) OVER b >= 30 THEN avg(volume) OVER b END, 6) AS base_far
FROM daily WINDOW a AS (ORDER BY trading_index ROWS BETWEEN 25 PRECEDING AND 6 PRECEDING), b AS (ORDER BY trading_index ROWS BETWEEN 60 PRECEDING AND 11 PRECEDING)""")
def pre_event_baseline(spark, d):
    rows = daily(spark, d)
    return rows.select("date", F.round(S.rolled(F.avg, "volume", 20, 1, 6, None), 6).alias("base_near"), F.round(S.rolled(F.avg, "volume", 50, 30, 11, None), 6).alias("base_far"))


@query(f"""WITH {DAILY}, h AS (SELECT *, level > 180000 AS hold FROM daily) SELECT date, hold, hold AND NOT coalesce(lag(hold) OVER (ORDER BY trading_index), false) AS entry FROM h""")
def position_changes(spark, d):
    rows = daily(spark, d).withColumn("hold", F.col("level") > 180000)
    return rows.select("date", "hold", (F.col("hold") & ~F.lag("hold", 1, False).over(S.by(None))).alias("entry"))


@query(f"""WITH {PANEL}, h AS (SELECT date, ticker, close / lag(close) OVER ({W}) - 1 AS m, CASE ticker WHEN 'Brand#1' THEN 0.07 WHEN 'Brand#2' THEN 0.10 ELSE 0.15 END AS lim FROM panel)
SELECT date, ticker, m >= lim - 0.003 AS ceiling, m <= -lim + 0.003 AS floor, round(m / lim, 5) AS used FROM h""")
def price_limits(spark, d):
    rows = panel(spark, d).withColumns({"m": F.try_divide("close", F.lag("close").over(S.by())) - 1, "lim": F.when(F.col("ticker") == "Brand#1", 0.07).when(F.col("ticker") == "Brand#2", 0.10).otherwise(0.15)})
    return rows.select("date", "ticker", (F.col("m") >= F.col("lim") - 0.003).alias("ceiling"), (F.col("m") <= -F.col("lim") + 0.003).alias("floor"), F.round(F.col("m") / F.col("lim"), 5).alias("used"))
