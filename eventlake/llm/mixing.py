"""Mixing sources to target weights by weighted fair queueing.

Each document of a source gets a virtual finish time: the words of its source up to and with it, in shuffled order,
divided by the source's target. A source whose target exceeds its size is gone through again. In order of that time all
sources reach their targets together; the mix is the entries in this order up to the total budget, where the entry that
crosses it stays if half of it fits.

All steps are DataFrame operations. Running sums go by buckets, of the shuffle key and then of the time, so neither a hot
source nor the whole queue is ever one task; of the queue only the bucket in which the budget ends is summed row by row.

Defined results: null or empty texts have size 0 and are taken 0 times in words, and once as rows; a null source is a source
of its own, last in order; null doc_ids are documents like others; rows alike in all columns are separate documents; an
empty table gives no rows; other columns of the input are ignored by `weigh` and kept by `mix`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discarded, parts, table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Of (source, source_size): each source's target. Sources by code point, null last, weigh `weights` in turn and
    divide share * all sizes, none above epochs * its size. Where the sources with the smallest cap per weight are capped,
    the rest divide what is left by weight; the first source whose cap is above its part ends the capping."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    capped = ranked.withColumn("cap", F.lit(float(epochs)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    by = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, every = by.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    left = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    level = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(every)
    found = capped.withColumn("level", left).withColumn("final", level)
    # past the first source that stays under its cap the levels only fall, so the highest of theirs is the level of all of them
    return found.select("source", "source_size", F.when(F.col("final").isNull() | (F.col("ratio") <= F.col("final")), F.col("cap")).otherwise(F.col("final") * F.col("w")).alias("target"))


def weigh(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, before (its source's words earlier in shuffled order), taken."""
    queue = written(queued(sized(docs).drop("text"), parts(docs), weights, share, epochs), "queue")
    end = budget_end(queue, 4 * parts(docs), share, epochs)
    taken = sum(F.when((F.col("size") > 0) & within(e, end), F.col("size")).otherwise(F.lit(0)) for e in range(epochs))
    return queue.withColumn("taken", taken.cast("long")).drop("shuffled", "bucket")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and text with the size in words and the shuffle key."""
    return docs.select("doc_id", "source", "text", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("shuffled"))


def queued(rows: DataFrame, n: int, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """rows with their place in the queue. The running sum of a source is that of its earlier buckets and that in its bucket."""
    buckets = 1 << max(4, (n * 4).bit_length())
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("shuffled", 1, 6), 16, 10).cast("long") * buckets / (1 << 24)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    running = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("in_bucket").over(running), F.lit(0))).drop("in_bucket")
    goals = targets(sums.groupBy("source").agg(F.sum("in_bucket").alias("source_size")), weights, share, epochs).withColumnRenamed("source", "of")
    starts = starts.join(goals, starts["source"].eqNullSafe(goals["of"])).select("of", F.col("bucket").alias("nth"), "start", "source_size", "target")
    local = W.partitionBy("source", "bucket").orderBy("shuffled", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("here", F.coalesce(F.sum("size").over(local), F.lit(0)))
    rows = rows.join(starts, rows["source"].eqNullSafe(starts["of"]) & (rows["bucket"] == starts["nth"])).withColumn("before", F.col("start") + F.col("here"))
    return rows.drop("of", "nth", "start", "here")


def finish(epoch: int):
    """Virtual finish time in this pass. Documents without words are out at once in the first and never in another."""
    time = F.try_divide((epoch * F.col("source_size") + F.col("before") + F.col("size")).cast("double"), F.col("target"))
    return F.when(F.col("size") > 0, time).otherwise(F.lit(0.0 if epoch == 0 else None).cast("double"))


def turn(epoch: int):
    """What comes first of equal times."""
    return F.concat("shuffled", F.lit(f":{epoch}:"), F.col("size").cast("string"), F.lit(":"), F.coalesce("source", F.lit("")))


def within(epoch: int, end: tuple[float, str] | None):
    """Whether the entry of this pass comes before the end of the budget."""
    time = finish(epoch)
    if end is None:
        return F.coalesce(time.isNotNull(), F.lit(False))
    return F.coalesce((time < end[0]) | (time == end[0]) & (turn(epoch) <= end[1]), F.lit(False))


def budget_end(queue: DataFrame, buckets: int, share: float, epochs: int) -> tuple[float, str] | None:
    """(time, turn) of the last entry that the budget has room for; None if it has for all."""
    entries = queue.where("size > 0 and target > 0").select("size", F.explode(F.array(*[F.struct(finish(e).alias("time"), turn(e).alias("turn")) for e in range(epochs)])).alias("e")).select("size", "e.*")
    entries = entries.withColumn("part", F.floor(F.least("time", F.lit(2.0)) * buckets))
    budget = min(share, float(epochs)) * (queue.agg(F.sum("size")).first()[0] or 0)
    ends = entries.groupBy("part").agg(F.sum("size").alias("words")).withColumn("start", F.sum("words").over(W.orderBy("part")) - F.col("words"))  # a row for each of 2 * buckets + 1 at most
    last = ends.where(F.col("start") + F.col("words") > budget).orderBy("part").first()
    if last is None:
        return None
    inside = entries.where(F.col("part") == last["part"]).withColumn("until", F.sum("size").over(W.orderBy("time", "turn")) + last["start"])  # one part of many
    kept = inside.where(F.col("until") - F.col("size") / 2.0 <= budget).agg(F.max(F.struct("time", "turn")).alias("end")).first()["end"]
    return (kept["time"], kept["turn"]) if kept else _before(entries, last["part"])


def _before(entries: DataFrame, part: int) -> tuple[float, str]:
    """The last entry of the parts before this one."""
    found = entries.where(F.col("part") < part).agg(F.max(F.struct("time", "turn")).alias("end")).first()["end"]
    return (found["time"], found["turn"]) if found else (0.0, "")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, range-sorted by virtual finish time up to where the
    budget is spent."""
    whole = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = whole.select(F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("shuffled"), "doc_id", "source", "row")
    narrow = written(queued(sized(docs).drop("text"), parts(docs), weights, share, epochs), "queue")
    end = budget_end(narrow, 4 * parts(docs), share, epochs)
    discarded(narrow)
    queue = queued(rows, parts(docs), weights, share, epochs)
    entries = queue.select("row", F.explode(F.filter(F.array(*[F.when(within(e, end), finish(e)) for e in range(epochs)]), lambda t: t.isNotNull())).alias("time"))
    return entries.repartitionByRange(parts(docs), "time").sortWithinPartitions("time").select("row.*")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return weigh(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The same by SQL; words are counted after white space is one character.
ORACLE = r"""
with d as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as shuffled,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, 2.0 * source_size as cap, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3.0 when 1 then 1.0 else 2.0 end as w from s),
l as (select *, cap / w as ratio, (1.5 * sum(source_size) over () - coalesce(sum(cap) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) as level
      from r window b as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
f as (select *, max(case when ratio > level then level end) over () as final from l),
t as (select source, source_size, (case when final is null or ratio <= final then cap else final * w end)::double as target from f),
q as (select d.*, t.source_size, t.target,
        coalesce(sum(d.size) over (partition by d.source order by shuffled, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as before,
        row_number() over () as entry
      from d join t on d.source is not distinct from t.source),
e as (select entry, size, (epoch * source_size + before + size)::double / target as time, shuffled || ':' || epoch || ':' || size || ':' || coalesce(source, '') as turn
      from q, (values (0), (1)) as epochs(epoch) where size > 0 and target > 0),
m as (select entry, size from (select *, sum(size) over (order by time, turn) as until from e) where until - size / 2.0 <= 1.5 * (select sum(size) from d))
select doc_id, q.size, source_size, target, coalesce(n, 0)::bigint as taken
from q left join (select entry, sum(size) as n from m group by entry) k on q.entry = k.entry
"""
