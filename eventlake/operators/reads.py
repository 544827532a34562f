"""Reads of a log: sourcing, single events, positions, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.criteria import Condition


def source(log: DataFrame, condition: Condition, start: int = 1, committed: int | None = None) -> DataFrame:
    """Matching events from `start` up to `committed`, without tags, by position. A negative start reads nothing."""
    rows = log.where(F.col("position") >= start) if start >= 0 else log.where(F.lit(False))
    if committed is not None:
        rows = rows.where(F.col("position") <= committed)
    return rows.where(condition.column()).drop("tags").orderBy("position")


def with_offsets(spark, path: str) -> DataFrame:
    """The events of stored files with where they stand: file and row_index in it."""
    return spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))


def source_since(log: DataFrame, condition: Condition, timestamp: int) -> DataFrame:
    """Matching events from the first position, by position, of an event at or after the time; none if there is none."""
    start = sequence_at(log, timestamp).select(F.col("position").alias("from_here"))
    return log.join(F.broadcast(start)).where((F.col("from_here") >= 0) & (F.col("position") >= F.col("from_here"))).where(condition.column()).drop("tags", "from_here").orderBy("position")


def source_stored(log: DataFrame, condition: Condition, start: int = 1, limit: int | None = None) -> DataFrame:
    """With tags, and at most `limit` events; a limit under 1 still yields one."""
    rows = log.where((F.col("position") >= start) & condition.column()).orderBy("position")
    return rows if limit is None else rows.limit(max(1, limit))


def source_many(log: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Events of many entities in one job: keys has a column `value` of tag values; one row for each pair."""
    exploded = log.withColumn("tag", F.explode(F.array_distinct("tags"))).where(F.col("tag.key") == F.lit(bytearray(key.encode()))).withColumn("value", F.decode("tag.value", "UTF-8"))
    return exploded.join(keys.select("value").distinct(), "value").drop("tag", "tags")


def ends(log: DataFrame) -> DataFrame:
    """head: the next position; tail: the first, or head if there is none; events: how many."""
    head = F.coalesce(F.max("position"), F.lit(0)) + 1
    return log.agg(head.alias("head"), F.coalesce(F.min("position"), head).alias("tail"), F.count("*").alias("events"))


def get_tags(log: DataFrame, position: int) -> DataFrame:
    """Tags of one event, as text; raises KeyError where there is no such event."""
    row = log.where(F.col("position") == position).select(F.explode_outer("tags").alias("t"))
    if position < 1 or not row.limit(1).count():
        raise KeyError(position)
    return row.where("t is not null").select(F.decode("t.key", "UTF-8").alias("key"), F.decode("t.value", "UTF-8").alias("value"))


def sequence_at(log: DataFrame, timestamp: int) -> DataFrame:
    """First position, by position, of an event at or after the time; -1 if there is none."""
    return log.where(F.col("timestamp") >= timestamp).agg(F.coalesce(F.min("position"), F.lit(-1)).alias("position"))


def first_after(log: DataFrame, condition: Condition, marker: int) -> DataFrame:
    return log.where((F.col("position") > marker) & condition.column()).agg(F.min("position").alias("position"))


def page_bounds(limit: int = 50, page: int = 1) -> tuple[int, int]:
    if limit < 1:
        raise ValueError("a page has at least one event")
    return min(limit, 200), max(1, page)


def page_newest(log: DataFrame, condition: Condition | None, limit: int = 50, page: int = 1) -> DataFrame:
    """A page of matching events, newest first."""
    limit, page = page_bounds(limit, page)
    rows = log if condition is None else log.where(condition.column())
    return rows.orderBy(F.desc("position")).offset(limit * (page - 1)).limit(limit)


def page_as_served(log: DataFrame, condition: Condition | None, limit: int = 50, page: int = 1) -> DataFrame:
    """A page as the console serves it. Filtered: the oldest limit * page matches, reversed, of which the page is cut.
    Unfiltered: a window from the end, whose last page starts at the tail again and overlaps the one before."""
    limit, page = page_bounds(limit, page)
    if condition is None:
        last = log.agg(F.coalesce(F.max("position"), F.lit(0))).first()[0]
        start = max(1, last - limit * page + 1)
        return log.where((F.col("position") >= start) & (F.col("position") < start + limit)).orderBy(F.desc("position"))
    oldest = log.where(condition.column()).orderBy("position").limit(limit * page)
    return oldest.orderBy(F.desc("position")).offset(limit * (page - 1)).limit(limit)


def pages(log: DataFrame, limit: int = 50) -> DataFrame:
    limit, _ = page_bounds(limit)
    return log.agg(F.count("*").alias("events"), F.ceil(F.count("*") / limit).cast("long").alias("pages"))


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, by one aggregation with partial results on the map side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row")).select(*keys, "__row.*")


def running(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
