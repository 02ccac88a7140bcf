"""Sinks and sources as queries: each writes a table into the shared folder, reads it back and gives its rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quaylark.plans.registry import query
from quaylark.plans.tables import table
from quaylark.session import shared_dir
from quaylark.sources import readers as I
from quaylark.sources import writers as O


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/out-{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, replace(c_name, '#', '\"#,' || chr(10)) AS c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(NULL AS VARCHAR) AS missing, 'one' AS tag FROM customer")
def csv_round_trip(spark, d):
    """Quotes, commas and line breaks through a CSV; strings only, columns by name, a tag for the file."""
    path = _place(spark, "csv")
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), F.replace("c_name", F.lit("#"), F.lit('"#,\n')).alias("c_name"), F.col("c_nationkey").cast("string").alias("c_nationkey"))
    O.write_csv(rows, path)
    return I.read_csv(spark, path, ["c_custkey", "c_name", "c_nationkey", "missing"], tag="one")


@query("SELECT event_id, CASE WHEN value > 60 THEN 'related' WHEN value > 10 THEN 'irrelevant' ELSE 'failed' END AS route FROM events")
def routed_round_trip(spark, d):
    path = _place(spark, "routed")
    v = F.col("value")
    O.write_routed(table(spark, d, "events").select("event_id", "value"), F.when(v > 60, "related").when(v > 10, "irrelevant").otherwise("failed"), path)
    return spark.read.parquet(path).select("event_id", "route")


@query("SELECT user_id, count(*) AS n, max(event_id) AS last_ FROM events GROUP BY 1")
def append_round_trip(spark, d):
    """The same batch twice, then one that overlaps: each key stays once."""
    path = _place(spark, "append")
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_"))
    first = rows.where("user_id % 2 = 0")
    O.append_new(first, path, ["user_id"])
    O.append_new(first, path, ["user_id"])
    O.append_new(rows, path, ["user_id"])
    return O.read_keyed(spark, path)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS state FROM orders")
def upsert_round_trip(spark, d):
    """A table, then a batch that replaces the rows whose keys it has."""
    path = _place(spark, "upsert")
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"))
    O.upsert(rows.where("o_orderkey % 7 <> 0"), path, ["o_orderkey"])
    O.upsert(rows.where("o_orderkey % 3 = 0 OR o_orderkey % 7 = 0").withColumn("state", F.when(F.col("o_orderkey") % 3 == 0, "new").otherwise(F.col("state"))), path, ["o_orderkey"])
    return O.read_keyed(spark, path)


@query("SELECT year(o_orderdate) AS year, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def partitioned_round_trip(spark, d):
    """A table in folders by year, written twice."""
    path = _place(spark, "parquet")
    rows = table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year"), "o_orderstatus").agg(F.count("*").alias("n"))
    for _ in range(2):
        O.write_parquet(rows, path, ["year"])
    return spark.read.parquet(path).select(F.col("year").cast("long").alias("year"), "o_orderstatus", "n")


@query("SELECT vec_id, true AS near FROM embeddings")
def half_round_trip(spark, d):
    """Vectors at half precision are within a thousandth of what they were."""
    path = _place(spark, "half")
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    O.write_half(rows, "embedding", path)
    back = O.read_half(spark, path, "embedding").select("vec_id", F.col("embedding").alias("half"))
    far = F.exists(F.zip_with("embedding", "half", lambda a, b: F.abs(a - b) > 0.001), lambda x: x)
    return rows.join(back, "vec_id").select("vec_id", (~far).alias("near"))


@query("SELECT o_orderpriority AS name, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) * 1000 // count(*) AS permille FROM orders GROUP BY 1")
def report_driver(spark, d):
    """A result written as CSV and Parquet and shown as Markdown; what is read back is what was found."""
    path = _place(spark, "report")
    found = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n"), F.expr("sum(case when o_orderstatus = 'F' then 1 else 0 end) * 1000 div count(*)").alias("permille"))
    O.write_parquet(found, f"{path}/parquet")
    back = spark.read.parquet(f"{path}/parquet")
    O.write_csv(back, f"{path}/csv")
    shown = O.markdown(back.orderBy("name")).count("\n") - 1
    again = I.read_csv(spark, f"{path}/csv", ["name", "n", "permille"])
    return again.where(F.lit(shown) == F.lit(back.count())).select("name", F.col("n").cast("long").alias("n"), F.col("permille").cast("long").alias("permille"))
