"""The driver's tables in the roles of the engine: news items, prices, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylark.operators import series

#: Centre of events.value, so that the rest is a signed score.
CENTRE = 50


def cents(column: str) -> Column:
    """An amount in whole hundredths, so that sums don't depend on their order."""
    return F.round(F.col(column) * 100).cast("long")


def rounded(value: Column, places: int) -> Column:
    """A double rounded as the SQL does it: value * 10^places to a whole number, halves away from zero, over 10^places. Spark's
    own round looks at the shortest decimal form, so it takes 0.5005 (which times 1000 is below 500.5) for a half."""
    scale = F.lit(10.0**places)
    x = F.abs(value) * scale
    near = (F.floor(x) + (x - F.floor(x) >= 0.5).cast("int")) / scale
    return F.when(x < float(1 << 52), F.signum(value) * near + F.lit(0.0)).otherwise(value)


def ratio(above: Column, below: Column, places: int) -> Column:
    """above / below (whole numbers, below > 0) rounded to places, exact halves away from zero."""
    scaled = F.abs(above).cast("decimal(38,0)") * F.lit(2 * 10**places).cast("decimal(19,0)")
    n = below.cast("decimal(19,0)")
    units = F.call_function("div", scaled + n, 2 * n).cast("double")
    return F.signum(above.cast("double")) * units / F.lit(10.0**places) + F.lit(0.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, ticker, event_type, score."""
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("ticker"), "event_type", F.round(F.col("value") - CENTRE, 2).alias("score"))


def news_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions: week days of the news, but for its last day, whose late news has no session yet."""
    days = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("date")).distinct()
    last = days.agg(F.max("date").alias("last"))  # one row
    return series.calendar(days.join(F.broadcast(last), F.col("date") < F.col("last")).where(F.weekday("date") < 5).select("date"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, ticker, close, volume from line items by brand."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker")), "l_partkey")
    rows = rows.groupBy(F.col("l_shipdate").cast("date").alias("date"), "ticker").agg((F.sum(cents("l_extendedprice")) / (100.0 * F.sum("l_quantity"))).alias("close"), F.sum("l_quantity").alias("volume"))
    return rows


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, trading_index, ticker, close, volume for every session and ticker; no price: null."""
    found = prices(spark, sf_dir)
    return series.densify(found, series.calendar(found.select("date")), found.select("ticker").distinct(), "ticker")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, trading_index, level (mean order price), volume (orders) for each order date."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg((F.sum(cents("o_totalprice")) / (100.0 * F.count("*"))).alias("level"), F.count("*").alias("volume"))
    return rows.join(F.broadcast(series.calendar(rows.select("date"))), "date")


NEWS = "news AS (SELECT event_id, ts, user_id AS ticker, event_type, round(value - 50, 2) AS score FROM events)"
NEWS_CAL = "ncal AS (SELECT d AS date, row_number() OVER (ORDER BY d) - 1 AS trading_index FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) WHERE isodow(d) < 6 AND d < (SELECT max(CAST(ts AS DATE)) FROM events))"
PRICES = "prices AS (SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS ticker, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / (100e0 * sum(l_quantity)) AS close, sum(l_quantity) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
PANEL = (
    PRICES
    + ", cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS trading_index FROM (SELECT DISTINCT date FROM prices))"
    + ", panel AS (SELECT cal.date, cal.trading_index, t.ticker, p.close, p.volume FROM cal CROSS JOIN (SELECT DISTINCT ticker FROM prices) t LEFT JOIN prices p ON p.date = cal.date AND p.ticker = t.ticker)"
)
RETURNS = PANEL + ", ret AS (SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY ticker ORDER BY trading_index) AS r FROM panel)"
DAILY = "days AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / (100e0 * count(*)) AS level, count(*) AS volume FROM orders GROUP BY 1), daily AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS trading_index FROM days)"
