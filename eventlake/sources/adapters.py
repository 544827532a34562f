"""Event logs and registries from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.criteria import tag_column
from .shared import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


def _event(df: DataFrame, context: str, identifier, name, timestamp, payload, tags) -> DataFrame:
    return df.select("position", identifier.alias("identifier"), name.alias("name"), F.lit("1.0").alias("version"), timestamp.alias("timestamp"), F.encode(payload, "UTF-8").alias("payload"), F.create_map().cast("map<string,string>").alias("metadata"), tags.alias("tags"), F.lit(context).alias("context"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: position event_id + 1, tags userId and k."""
    e = table(spark, sf_dir, "events").withColumn("position", F.col("event_id") + 1)
    return _event(e, "activity", F.concat(F.lit("evt-"), "event_id"), F.col("event_type"), millis("ts"), F.col("props"), tag_column(userId=F.col("user_id"), k=F.get_json_object("props", "$.k")))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a log in order of key, in which timestamps go back and forth."""
    o = table(spark, sf_dir, "orders").withColumn("position", F.col("o_orderkey") + 1)
    return _event(o, "placed", F.concat(F.lit("ord-"), "o_orderkey"), F.lit("OrderPlaced"), millis("o_orderdate"), F.col("o_orderpriority"), tag_column(orderId=F.col("o_orderkey"), customerId=F.col("o_custkey")))


#: What orders the events of the orders log, besides what they are.
ORDER = ["timestamp", "name", "order_id", "line", "part", "supplier", "customer", "amount", "quantity", "discount", "tax", "flags"]


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero, none = F.lit(-1).cast("long"), F.lit(-1.0)
    o = table(spark, sf_dir, "orders").select(millis("o_orderdate").alias("timestamp"), F.lit("OrderPlaced").alias("name"), F.col("o_orderkey").alias("order_id"), zero.alias("line"), zero.alias("part"), zero.alias("supplier"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("amount"), none.alias("quantity"), none.alias("discount"), none.alias("tax"), F.concat("o_orderstatus", "o_orderpriority").alias("flags"))
    li = table(spark, sf_dir, "lineitem").select(millis("l_shipdate"), F.lit("LineShipped"), "l_orderkey", F.col("l_linenumber").cast("long"), "l_partkey", "l_suppkey", zero, "l_extendedprice", "l_quantity", "l_discount", "l_tax", F.concat("l_returnflag", "l_linestatus"))
    return o.union(li)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders and lineitem as one log by time."""
    e = numbered(order_events(spark, sf_dir), ORDER)
    own = tag_column(orderId=F.col("order_id"))
    tags = F.when(F.col("name") == "OrderPlaced", F.concat(own, tag_column(customerId=F.col("customer")))).otherwise(F.concat(own, tag_column(partId=F.col("part"), supplierId=F.col("supplier"))))
    return _event(e, "orders", F.concat("name", F.lit("-"), "position"), F.col("name"), F.col("timestamp"), F.to_json(F.struct("amount", "quantity")), tags)


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = numbered(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])
    return _event(c, "chat", F.concat_ws("-", "conv_id", "turn"), F.col("role"), F.lit(1712345678000) + F.col("position"), F.col("text"), tag_column(convId=F.col("conv_id")))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(spark, sf_dir).union(placed(spark, sf_dir)).union(chat(spark, sf_dir))


def handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as handlers: message_type, client_id, component_name, load_factor, reg_seq."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.concat(F.lit("Command"), F.col("s_suppkey") % 5).alias("message_type"), F.col("s_name").alias("client_id"), F.col("n_name").alias("component_name"), (F.col("s_suppkey") % 4).alias("load_factor"), F.col("s_suppkey").alias("reg_seq"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as commands; odd keys have no routing key, and names with no handler occur."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("arrival"), F.concat(F.lit("Command"), F.col("o_orderkey") % 6).alias("name"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).alias("routing_key"), F.col("o_totalprice").cast("long").alias("duration_us"), F.when(F.col("o_orderstatus") == "F", "HANDLER_ERROR").otherwise("").alias("error_code"))


def subscription_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("sub-"), "user_id").alias("subscription_id"), F.when(F.col("event_type").isin("signup", "view"), "open").when(F.col("event_type") == "error", "cancel").when(F.col("event_type") == "purchase", "complete").otherwise("update").alias("op"), F.col("event_id").alias("seq"), millis("ts").alias("at"))


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("client-"), "user_id").alias("client_id"), F.concat(F.lit("component-"), F.col("user_id") % 3).alias("component_name"), F.col("event_type").alias("op"), F.col("event_id").alias("seq"), millis("ts").alias("at"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier, nation and region as reports of processors' segments."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.select(F.col("r_name").alias("processor_name"), F.col("n_name").alias("client_id"), (F.col("n_nationkey") % 7 != 0).alias("running"), F.col("s_suppkey").alias("segment_id"), F.expr("shiftleft(1L, cast(s_suppkey % 4 as int))").alias("one_part_of"), (F.col("s_suppkey") * 3).alias("token_position"), (F.col("s_acctbal") > 0).alias("caught_up"), (F.col("s_acctbal") < -900).alias("replaying"), F.when(F.col("s_acctbal") > 9800, "failed").otherwise("").alias("error_state"))
