"""What the query modules share: the registry, and views of the tables as series and as candidates with boxes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesforge.session import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str = ""):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with pos, the place in the user's series."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value").withColumn("pos", F.row_number().over(w))


E = "e AS (SELECT event_id, user_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem rows as candidates of their order, with a box from quantity, discount and tax."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.row_number().over(order).alias("candidate"), F.col("l_extendedprice").alias("confidence"), "l_returnflag",
        F.col("l_quantity").alias("x1"), (F.col("l_discount") * 100).alias("y1"), (F.col("l_quantity") + 20).alias("x2"), (F.col("l_discount") * 100 + 10).alias("y2"),
    )


B = """b AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS candidate,
  l_returnflag, l_extendedprice AS confidence, l_quantity AS x1, l_discount * 100 AS y1, l_quantity + 20 AS x2, l_discount * 100 + 10 AS y2 FROM lineitem)"""
