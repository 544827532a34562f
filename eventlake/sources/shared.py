"""Tables in the folder that driver and executors share, and gapless numbering over partitions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in spark.checkpoint.dir (a folder of our own where that is unset): cuts lineage durably."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if sc.master.partition("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir is not set: driver and executors share no folder")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="eventlake-"))
        folder = sc._jsc.sc().getCheckpointDir().get()
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: list, column: str = "position", start: int = 1, partitions: int | None = None) -> DataFrame:
    """df with a gapless number in order of `by`: range partitions, sorted, each with the rows before it added. No task
    sees more than its partition. `by` must order all rows that differ."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    rows = written(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    base, starts = start, []
    for part, size in sorted((r["__part"], r["n"]) for r in rows.groupBy("__part").agg(F.count("*").alias("n")).collect()):  # a row for each partition
        starts.append((part, base))
        base += size
    starts = df.sparkSession.createDataFrame(starts or [(0, start)], "__of int, __base long")
    return rows.join(F.broadcast(starts), F.col("__part") == F.col("__of")).withColumn(column, F.col("__base") + F.col("__row")).drop("__part", "__row", "__of", "__base")


def counted(df: DataFrame, by: list, what: Column, column: str) -> DataFrame:
    """df with how many rows that are `what` come before each in order of `by`, in parts as in numbered."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    rows = written(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), "counted")
    base, starts = 0, []
    for part, size in sorted((r["__part"], r["n"]) for r in rows.groupBy("__part").agg(F.count_if(what).alias("n")).collect()):  # a row for each partition
        starts.append((part, base))
        base += size
    starts = df.sparkSession.createDataFrame(starts, "__of int, __base long")
    before = F.count_if(what).over(W.partitionBy("__part").orderBy("__row").rowsBetween(W.unboundedPreceding, -1))
    own = rows.withColumn(column, before)
    return own.join(F.broadcast(starts), F.col("__part") == F.col("__of")).withColumn(column, F.col(column) + F.col("__base")).drop("__part", "__row", "__of", "__base")
