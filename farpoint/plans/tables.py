"""Views of the test tables as points, vectors and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farpoint.functions.timeparts import timestamp_parts
from farpoint.operators.numbering import number_rows
from farpoint.specs import Attr, OutlierParams, WindowSpec

EVENT_ORDER = ["ts", "event_id"]
EVENT_ATTRS = [Attr("value"), Attr("event_type", "nominal", "String")]
EVENT_SPEC, EVENT_PARAMS = WindowSpec(200, 50), OutlierParams(2.005, 5)
# Per user: short windows, as there are few events each.
USER_SPEC, USER_PARAMS = WindowSpec(12, 3), OutlierParams(20.005, 3)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")


def numbered_events(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Events in order of time, with only the columns asked for."""
    kept = list(dict.fromkeys([*EVENT_ORDER, *columns, "value", "event_type"]))
    return number_rows(events(spark, folder).select(*kept), EVENT_ORDER).drop("ts")


def user_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events numbered per user."""
    return number_rows(events(spark, folder), EVENT_ORDER, ["user_id"]).drop("ts")


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Events in the layout of a sensor table: time parts and one reading."""
    return events(spark, folder).select("user_id", *timestamp_parts("ts"), "value")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


def label_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """One anchor per label: its first vector."""
    first = F.min(F.struct("vec_id", "embedding")).alias("v")
    return vectors(spark, folder).groupBy("label").agg(first).select("label", "v.vec_id", "v.embedding")


def order_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """One box per order, in (day, price / 100)."""
    day = F.unix_date(F.to_date("o_orderdate")).cast("bigint")
    price = F.floor(F.col("o_totalprice") / 100).cast("bigint")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), day.alias("xMin"), price.alias("yMin"), "o_custkey")
    return orders.select(
        "id",
        "xMin",
        "yMin",
        (F.col("xMin") + 1 + F.col("id") % 7).alias("xMax"),
        (F.col("yMin") + 1 + F.col("o_custkey") % 11).alias("yMax"),
    )


def order_points(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as points: day and price numeric, status nominal."""
    day = F.unix_date(F.to_date("o_orderdate")).cast("double")
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice", day.alias("o_day"), "o_orderstatus")


ORDER_ATTRS = [Attr("o_totalprice"), Attr("o_day"), Attr("o_orderstatus", "nominal", "String")]
LINE_ATTRS = [Attr("l_quantity"), Attr("l_discount"), Attr("l_tax"), Attr("l_returnflag", "nominal", "String")]
