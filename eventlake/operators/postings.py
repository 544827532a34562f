"""The inverted index: postings of names and tags by segment, its use for reads, pruning, bitmaps and tag edits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.criteria import Condition, Criterion, name_key
from ..schema import SEGMENT


def fkey(key: Column, value: Column) -> Column:
    """Unambiguous text of a tag."""
    return F.concat(F.hex(key), F.lit("="), F.hex(value))


def segment_of(position: Column, size: int = SEGMENT) -> Column:
    return F.floor((position - 1) / size).cast("long")


def build(log: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(segment, fkey, position, name): one row for each distinct tag of an event and one for its name, with its name."""
    keys = F.concat(F.array(F.concat(F.lit("name:"), "name")), F.transform(F.array_distinct("tags"), lambda t: fkey(t["key"], t["value"])))
    return log.select(segment_of(F.col("position"), size).alias("segment"), F.explode(keys).alias("fkey"), "position", "name")


def write(postings: DataFrame, path: str, distinct: int = 1 << 20, mode: str = "errorifexists") -> None:
    """Sorted by key, with a bloom filter on it, so that a read of one key skips the other row groups."""
    w = postings.repartitionByRange("segment", "fkey").sortWithinPartitions("segment", "fkey", "position").write
    w.option("parquet.bloom.filter.enabled#fkey", "true").option("parquet.enable.dictionary#fkey", "false").option("parquet.bloom.filter.expected.ndv#fkey", str(distinct)).partitionBy("segment").mode(mode).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("segment").cast("long").alias("segment"), "fkey", "position", "name")


def positions(postings: DataFrame, condition: Condition) -> DataFrame | None:
    """Matching positions by relational division on the postings; None where a criterion matches everything."""
    found = []
    for c in condition.criteria:
        if not c.names and not c.tags:
            return None
        found.append(_criterion(postings, c))
    return reduce(DataFrame.union, found).distinct() if found else postings.select("position").where(F.lit(False))


def _criterion(postings: DataFrame, c: Criterion) -> DataFrame:
    tags = sorted({t.fkey for t in c.tags})
    names = [name_key(n) for n in c.names]
    rows = postings.where(F.col("fkey").isin(tags + names)).groupBy("position")
    want = F.count(F.when(F.col("fkey").isin(tags), 1)) == len(tags) if tags else F.lit(True)
    named = F.count(F.when(F.col("fkey").isin(names), 1)) > 0 if names else F.lit(True)
    return rows.agg(want.alias("t"), named.alias("n")).where("t and n").select("position")


def source(log: DataFrame, postings: DataFrame, condition: Condition) -> DataFrame:
    """The same rows as reads.source, by a semi-join with the index's positions."""
    found = positions(postings, condition)
    return (log if found is None else log.join(found, "position", "left_semi")).drop("tags")


def segments_that_may_match(postings: DataFrame, condition: Condition) -> DataFrame:
    """Segments that have, for some criterion, every tag and one of the names; the others need not be read."""
    keys = postings.select("segment", "fkey").distinct()
    found = []
    for c in condition.criteria:
        tags, names = sorted({t.fkey for t in c.tags}), [name_key(n) for n in c.names]
        agg = keys.groupBy("segment").agg(F.count(F.when(F.col("fkey").isin(tags), 1)).alias("t"), F.count(F.when(F.col("fkey").isin(names), 1)).alias("n")) if tags or names else keys.groupBy("segment").agg(F.lit(0).alias("t"), F.lit(0).alias("n"))
        found.append(agg.where((F.col("t") == len(tags)) & (F.col("n") > 0 if names else F.lit(True))).select("segment"))
    return reduce(DataFrame.union, found).distinct() if found else keys.select("segment").where(F.lit(False))


def bitmaps(log: DataFrame, condition: Condition) -> DataFrame:
    """Matching positions as one bitmap for each bucket, with their number."""
    p = F.col("position")
    return log.where(condition.column()).groupBy(F.bitmap_bucket_number(p).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("bitmap")).withColumn("positions", F.bitmap_count("bitmap"))


def edited(log: DataFrame, edits: DataFrame) -> DataFrame:
    """log with tag edits (position, seq, op add|remove, tag) applied; of several edits of a tag the last holds."""
    last = edits.groupBy("position", "tag").agg(F.max_by("op", "seq").alias("op"))
    by = last.groupBy("position").agg(F.collect_set(F.when(F.col("op") == "add", F.col("tag"))).alias("more"), F.collect_set(F.when(F.col("op") == "remove", F.col("tag"))).alias("less"))
    none = F.array().cast("array<struct<key:binary,value:binary>>")
    return log.join(by, "position", "left").withColumn("tags", F.array_except(F.array_union("tags", F.coalesce("more", none)), F.coalesce("less", none))).drop("more", "less")


def unindexed(log: DataFrame, postings: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Events of segments that have no postings yet."""
    return log.withColumn("segment", segment_of(F.col("position"), size)).join(postings.select("segment").distinct(), "segment", "left_anti").drop("segment")
