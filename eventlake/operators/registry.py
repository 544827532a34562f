"""Registries from their logs: clients, subscriptions, event processors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .reads import latest


def handlers(ops: DataFrame) -> DataFrame:
    """Live handlers from a log (op register|unregister|remove_client, message_type, client_id, component_name, load_factor,
    seq): each registration counts, also a second one of a client, until the client takes the type back or is removed."""
    back = ops.where("op = 'unregister'").groupBy("message_type", "client_id").agg(F.max("seq").alias("back"))
    gone = ops.where("op = 'remove_client'").groupBy("client_id").agg(F.max("seq").alias("gone"))
    live = ops.where("op = 'register'").join(back, ["message_type", "client_id"], "left").join(gone, "client_id", "left")
    live = live.where((F.col("seq") > F.coalesce("back", F.lit(-1))) & (F.col("seq") > F.coalesce("gone", F.lit(-1))))
    return live.select("message_type", "client_id", "component_name", "load_factor", F.col("seq").alias("reg_seq"))


def connected(ops: DataFrame) -> DataFrame:
    """Clients whose last register or unregister is a register: client_id, component_name, connected_at."""
    return latest(ops.where(F.col("op").isin("register", "unregister")), ["client_id"], "seq").where("op = 'register'").select("client_id", "component_name", F.col("at").alias("connected_at"))


def subscriptions(ops: DataFrame) -> DataFrame:
    """Active subscriptions from a log (op open|complete|cancel|remove_client, subscription_id, client_id, handler_client_id, at,
    seq): the last open of an id, unless its id was ended later or its subscriber or handler removed later."""
    last = latest(ops.where(F.col("op").isin("open", "cancel", "complete")), ["subscription_id"], "seq").where("op = 'open'")
    gone = ops.where("op = 'remove_client'").groupBy(F.col("client_id").alias("who")).agg(F.max("seq").alias("gone"))
    for side in ("client_id", "handler_client_id"):
        last = last.join(gone, F.col(side) == F.col("who"), "left").where("gone is null or gone < seq").drop("who", "gone")
    return last.select("subscription_id", "client_id", "handler_client_id", F.col("at").alias("opened_at"), "seq")


def subscription_stats(active: DataFrame, now) -> DataFrame:
    """How many are active, and the greatest age in whole seconds (0 where there is none)."""
    return active.agg(F.count("*").alias("active"), F.coalesce(F.max(F.floor((now - F.col("opened_at")) / 1000)), F.lit(0)).cast("long").alias("oldest_s"))


def with_initial(answers: DataFrame, updates: DataFrame, active: DataFrame) -> DataFrame:
    """What a subscriber gets: the initial result as the first update, then the updates since it was opened, numbered."""
    first = answers.join(active.select("subscription_id"), "subscription_id").select("subscription_id", "payload", F.lit(-1).cast("long").alias("seq"))
    then = delivered(updates, active.select("subscription_id", "seq")).select("subscription_id", "payload", F.col("seq").cast("long").alias("seq"))
    nth = F.row_number().over(W.partitionBy("subscription_id").orderBy("seq")).cast("long")
    return first.union(then).select("subscription_id", nth.alias("nth"), (F.col("seq") < 0).alias("initial"), "payload")


def permits(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Each acquire of a log (keys, op grant|acquire, permits, seq) with whether it got a permit and how many were left after
    it. Permits are granted and used one by one in order and never fall under 0, so what is left is the running sum less its
    least value below 0: two running values of a sorted group."""
    by = W.partitionBy(*keys).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    moved = ops.withColumn("sum", F.sum(F.when(F.col("op") == "grant", F.col("permits")).otherwise(-1)).over(by))
    left = moved.withColumn("left", (F.col("sum") - F.least(F.lit(0), F.min("sum").over(by))).cast("long"))
    before = F.coalesce(F.lag("left").over(W.partitionBy(*keys).orderBy("seq")), F.lit(0))
    return left.withColumn("acquired", before > 0).where("op = 'acquire'").drop("sum", "op", "permits")


def reports(log: DataFrame, removed: DataFrame) -> DataFrame:
    """The last report of each processor and client since the client was last removed (client_id, seq)."""
    gone = removed.groupBy("client_id").agg(F.max("seq").alias("gone"))
    last = latest(log, ["processor_name", "client_id"], "seq").join(gone, "client_id", "left")
    return last.where("gone is null or gone < seq").drop("gone")


def aggregated(found: DataFrame) -> DataFrame:
    """By processor and token store: the mode of the first report, how many instances and their clients, by name."""
    by = found.groupBy("processor_name", "token_store_identifier")
    return by.agg(F.min_by("mode", "seq").alias("mode"), F.count("*").alias("instances"), F.sort_array(F.collect_list("client_id")).alias("clients"), F.sum("active_threads").cast("long").alias("active_threads")).orderBy("processor_name", "token_store_identifier")


def active_subscriptions(ops: DataFrame) -> DataFrame:
    """Subscriptions whose last open, cancel or complete is an open: subscription_id, opened at, seq."""
    return latest(ops.where(F.col("op").isin("open", "cancel", "complete")), ["subscription_id"], "seq").where("op = 'open'").select("subscription_id", F.col("at").alias("opened_at"), "seq")


def delivered(updates: DataFrame, active: DataFrame) -> DataFrame:
    """Updates of active subscriptions since they were opened."""
    return updates.join(active.withColumnRenamed("seq", "opened"), "subscription_id").where(F.col("seq") > F.col("opened"))


def clients(beats: DataFrame) -> DataFrame:
    """client_id, component_name, last_heartbeat; the last report of a client holds."""
    return latest(beats, ["client_id"], "seq").select("client_id", "component_name", F.col("at").alias("last_heartbeat"))


def health(known: DataFrame, now) -> DataFrame:
    """Whole seconds since the last heartbeat: over 15 is stale, over 5 slow. The overview calls over 15 slow, else ok."""
    age = F.floor((now - F.col("last_heartbeat")) / 1000).cast("long")
    return known.withColumn("age_s", age).withColumn("health", F.when(age > 15, "stale").when(age > 5, "slow").otherwise("healthy")).withColumn("overview", F.when(age > 15, "slow").otherwise("ok"))


def dead(known: DataFrame, now, timeout_ms: int = 15_000) -> DataFrame:
    return known.where(now - F.col("last_heartbeat") > timeout_ms)


def processors(segments: DataFrame) -> DataFrame:
    """By processor: instances, segments, status and range of token positions (-1 where it has none)."""
    failed = F.bool_or(F.coalesce(F.col("error_state"), F.lit("")) != "")
    status = F.when(~F.bool_or("running"), "stopped").when(failed, "error").when(F.bool_or(F.coalesce("replaying", F.lit(False))), "replaying").when(F.bool_and(F.coalesce("caught_up", F.lit(True))), "caught up").otherwise("behind")
    return segments.groupBy("processor_name").agg(F.count_distinct("client_id").alias("instances"), F.count("segment_id").alias("segments"), status.alias("status"), F.coalesce(F.min("token_position"), F.lit(-1)).alias("low"), F.coalesce(F.max("token_position"), F.lit(-1)).alias("high"))


def split_candidate(segments: DataFrame) -> DataFrame:
    """The segment with the least one_part_of, the first on ties; 0 where there is none."""
    return segments.groupBy("processor_name").agg(F.coalesce(F.min_by("segment_id", F.when(F.col("segment_id").isNotNull(), F.struct("one_part_of", "segment_id"))), F.lit(0)).alias("segment_id"))


def merge_candidate(segments: DataFrame) -> DataFrame:
    """The segment with the greatest one_part_of, the last on ties; 0 where there is none."""
    return segments.groupBy("processor_name").agg(F.coalesce(F.max_by("segment_id", F.when(F.col("segment_id").isNotNull(), F.struct("one_part_of", "segment_id"))), F.lit(0)).alias("segment_id"))
