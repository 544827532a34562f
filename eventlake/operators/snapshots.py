"""Keyed snapshots as a table (key, sequence, ...): upsert, prune, delete, list, last, and replay from the last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add(store: DataFrame, new: DataFrame, prune: bool = False) -> DataFrame:
    """new over store: of one key and sequence the new one; with prune, the keys' sequences from 0 up to it go."""
    kept = store.join(new.select("key", "sequence"), ["key", "sequence"], "left_anti")
    if prune:
        top = new.groupBy("key").agg(F.max("sequence").alias("__top"))
        kept = kept.join(top, "key", "left").where("__top is null or sequence < 0 or sequence >= __top").drop("__top")
    return kept.unionByName(new.select(*kept.columns))


def delete(store: DataFrame, key, to) -> DataFrame:
    """Without the key's sequences from 0 up to `to`; negative ones stay."""
    return store.where(~((F.col("key") == key) & (F.col("sequence") >= 0) & (F.col("sequence") < to)))


def listed(store: DataFrame, key, start: int, to: int) -> DataFrame:
    return store.where((F.col("key") == key) & (F.col("sequence") >= start) & (F.col("sequence") < to)).orderBy("sequence")


def last(store: DataFrame) -> DataFrame:
    rest = [c for c in store.columns if c != "key"]
    return store.groupBy("key").agg(F.max_by(F.struct(*rest), "sequence").alias("s")).select("key", "s.*")


def rehydrated(store: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Events (with column `key`) after their key's last snapshot, all where it has none."""
    tops = store.groupBy("key").agg(F.max("sequence").alias("snapshot"))
    return log.join(tops.withColumnRenamed("key", key), key, "left").where(F.col("snapshot").isNull() | (F.col("position") > F.col("snapshot")))


def get_last(store: DataFrame, key) -> DataFrame:
    """One row: the key's last snapshot; where it has none, the key with sequence 0 and empty fields."""
    rest = [f for f in store.schema.fields if f.name not in ("key", "sequence")]
    found = store.where(F.col("key") == key).agg(F.max(F.col("sequence")).alias("sequence"), *[F.max_by(f.name, "sequence").alias(f.name) for f in rest])
    empty = lambda f: F.coalesce(F.col(f.name), F.lit("").cast(f.dataType)) if f.dataType.typeName() in ("string", "binary") else F.col(f.name)
    return found.select(F.lit(key).alias("key"), F.coalesce("sequence", F.lit(0)).alias("sequence"), *[empty(f).alias(f.name) for f in rest])


def write(store: DataFrame, path: str, buckets: int = 64) -> None:
    """The table of snapshots as Parquet, by bucket of the key and sorted, so that a key's read opens one bucket."""
    keyed = store.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    keyed.repartition("bucket").sortWithinPartitions("key", "sequence").write.partitionBy("bucket").mode("overwrite").parquet(path)


def read(spark, path: str, key=None, buckets: int = 64) -> DataFrame:
    """All snapshots, or those of one key from its bucket alone."""
    found = spark.read.parquet(path)
    if key is not None:
        found = found.where((F.col("bucket") == F.pmod(F.xxhash64(F.lit(key)), F.lit(buckets)).cast("int")) & (F.col("key") == key))
    return found.drop("bucket")
