"""Counters and overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def context_stats(logs: DataFrame) -> DataFrame:
    return logs.groupBy("context").agg((F.max("position") + 1).alias("head"), F.min("position").alias("tail"), F.count("*").alias("events"))


def chart(stats: DataFrame) -> DataFrame:
    """Bars in percent of the largest context, whole, at least 2."""
    top = F.greatest(F.max("events").over(W.partitionBy()), F.lit(1))  # one row for each context
    return stats.select("context", "events", F.greatest(F.lit(2), F.floor(F.col("events") * 100 / top)).cast("long").alias("pct"))


def counters(ops: DataFrame) -> DataFrame:
    """Totals, whole averages and rates of an operation log (op, events, duration_us, hit, rejected)."""
    n = lambda c: F.count(F.when(c, 1))
    append, read = F.col("op") == "append", F.col("op") == "source"
    total = lambda c, v: F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0))
    agg = ops.agg(n(append).alias("appends"), total(append, "events").alias("events_appended"), n(append & F.col("rejected")).alias("dcb_violations"), n(read).alias("source_queries"), total(append, "duration_us").alias("append_us"), total(read, "duration_us").alias("source_us"), n(read & F.col("hit")).alias("cache_hits"))
    whole = lambda a, b: F.coalesce(F.expr(f"case when {b} > 0 then {a} div {b} end"), F.lit(0))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a) * 100.0, F.col(b)), F.lit(0.0))
    return agg.select("*", whole("append_us", "appends").alias("avg_append_us"), whole("source_us", "source_queries").alias("avg_source_us"), rate("cache_hits", "source_queries").alias("hit_rate"), rate("dcb_violations", "appends").alias("violation_rate"))


def store_counters(ops: DataFrame) -> DataFrame:
    """All counters of a store from its operation log (op append|source|index_read|bloom_check|map_read|rotation, events,
    duration_us, hit, rejected, seek): hit is a cache's, rejected is a condition's or a bloom filter's, seek says that a source
    went to offsets. Rates in percent, 0 where there is nothing."""
    n = lambda op, c=True: F.count(F.when((F.col("op") == op) & c, 1))
    total = lambda op, v, c=True: F.coalesce(F.sum(F.when((F.col("op") == op) & c, F.col(v))), F.lit(0)).cast("long")
    hit, rejected, seek = F.col("hit"), F.col("rejected"), F.col("seek")
    out = ops.agg(
        n("append", ~rejected).alias("appends"), total("append", "events", ~rejected).alias("events_appended"), n("append", rejected).alias("dcb_violations"), total("append", "duration_us", ~rejected).alias("append_duration_us"),
        n("source").alias("source_queries"), total("source", "events").alias("events_sourced"), total("source", "duration_us").alias("source_duration_us"),
        n("index_read", hit).alias("index_cache_hits"), n("index_read", ~hit).alias("index_cache_misses"), n("bloom_check").alias("bloom_checks"), n("bloom_check", rejected).alias("bloom_rejections"),
        n("map_read", hit).alias("mmap_cache_hits"), n("map_read", ~hit).alias("mmap_cache_misses"), n("rotation").alias("segment_rotations"), n("source", seek).alias("direct_seek_reads"), n("source", ~seek).alias("sequential_scan_reads"),
    )
    rate = lambda a, *every: F.coalesce(F.try_divide(F.col(a) * 100.0, sum(F.col(e) for e in every)), F.lit(0.0))
    return out.select("*", rate("index_cache_hits", "index_cache_hits", "index_cache_misses").alias("index_cache_hit_rate"), rate("bloom_rejections", "bloom_checks").alias("bloom_rejection_rate"), rate("mmap_cache_hits", "mmap_cache_hits", "mmap_cache_misses").alias("mmap_cache_hit_rate"), rate("direct_seek_reads", "direct_seek_reads", "sequential_scan_reads").alias("direct_seek_rate"))


def throughput(log: DataFrame) -> DataFrame:
    """Events for each second between the first and the last."""
    return log.agg(F.count("*").alias("events"), F.try_divide(F.count("*") * 1000.0, F.max("timestamp") - F.min("timestamp")).alias("per_second"))
