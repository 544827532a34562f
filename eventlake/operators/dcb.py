"""Conditional appends: conflict checks of one or many conditions, request folding, and replay of a request log."""

from __future__ import annotations

import bisect
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.criteria import Condition
from ..schema import SEGMENT
from . import reads
from .postings import segment_of


def conflict(log: DataFrame, condition: Condition, marker: int) -> int | None:
    """The first matching position after the marker."""
    return reads.first_after(log, condition, marker).first()["position"]


def first_past(asked: DataFrame, postings: DataFrame, keys: list[str], size: int) -> DataFrame:
    """For each of asked (keys, marker): the first position past the marker in the postings of that key (found, or null). A
    marker meets the postings of its own segment only; beyond it the next segment that has the key is looked up among the
    first positions of segments, so a key costs a row for each segment however many events or questions it has."""
    held = postings.join(asked.select(*keys).distinct(), keys, "left_semi").select("segment", "position", *keys)
    asked = asked.select(*keys, "marker").distinct().withColumn("segment", segment_of(F.greatest(F.col("marker"), F.lit(0)) + 1, size))
    inside = asked.join(held, [*keys, "segment"]).where("position > marker").groupBy(*keys, "marker").agg(F.min("position").alias("inside"))
    firsts = held.groupBy(*keys, "segment").agg(F.min("position").alias("first"))
    spots = asked.select(*keys, "segment", F.lit(None).cast("long").alias("first"), F.lit(0).alias("given")).distinct().union(firsts.withColumn("given", F.lit(1)))
    from_last = W.partitionBy(*keys).orderBy(F.desc("segment"), "given").rowsBetween(W.unboundedPreceding, 0)
    later = spots.withColumn("later", F.last("first", True).over(from_last)).where("given = 0").select(*keys, "segment", "later")
    return asked.join(inside, [*keys, "marker"], "left").join(later, [*keys, "segment"], "left").select(*keys, "marker", F.coalesce("inside", "later").alias("found"))


def conflicts(conditions: DataFrame, postings: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Of many conditions (cond_id, marker, crit_id, fkeys, names) against one log: cond_id and the first conflicting
    position, null where none conflicts. Criteria of one tag, or of names only, ask for the first position past the marker;
    of several tags the rarest gives the candidates, which must have the others too."""
    want = conditions.select("cond_id", "crit_id", "marker", F.array_distinct("fkeys").alias("fkeys"), F.array_distinct("names").alias("names"))
    named = F.explode(F.when(F.size("names") > 0, F.col("names")).otherwise(F.array(F.lit(None).cast("string"))))
    single = want.where(F.size("fkeys") == 1).select("cond_id", "marker", F.col("fkeys")[0].alias("fkey"), named.alias("name"))
    single = single.union(want.where((F.size("fkeys") == 0) & (F.size("names") > 0)).select("cond_id", "marker", F.explode("names").alias("name")).select("cond_id", "marker", F.concat(F.lit("name:"), "name"), F.lit(None).cast("string")))
    any_name = single.where("name is null").drop("name")
    by_name = single.where("name is not null")
    found = [
        any_name.join(first_past(any_name, postings, ["fkey"], size), ["fkey", "marker"]).select("cond_id", "found"),
        by_name.join(first_past(by_name, postings, ["fkey", "name"], size), ["fkey", "name", "marker"]).select("cond_id", "found"),
    ]
    several = want.where(F.size("fkeys") > 1)
    tags = several.select("cond_id", "crit_id", F.explode("fkeys").alias("fkey"))
    often = postings.join(tags.select("fkey").distinct(), "fkey", "left_semi").groupBy("fkey").agg(F.count("*").alias("events"))
    rarest = tags.join(often, "fkey", "left").groupBy("cond_id", "crit_id").agg(F.min_by("fkey", F.struct(F.coalesce("events", F.lit(0)), "fkey")).alias("fkey"))
    met = several.join(rarest, ["cond_id", "crit_id"]).join(postings.select("fkey", "position", "name"), "fkey").where((F.col("position") > F.col("marker")) & ((F.size("names") == 0) | F.array_contains("names", F.col("name"))))
    others = met.select("cond_id", "crit_id", "position", F.size("fkeys").alias("n"), F.explode(F.array_remove("fkeys", F.col("fkey"))).alias("fkey"))
    full = others.join(postings.select("fkey", "position"), ["fkey", "position"]).groupBy("cond_id", "crit_id", "position", "n").agg(F.count("*").alias("has"))
    found.append(full.where("has = n - 1").select("cond_id", F.col("position").alias("found")))
    everything = want.where((F.size("fkeys") == 0) & (F.size("names") == 0)).select("cond_id", F.greatest(F.col("marker"), F.lit(0)).alias("marker"))
    last = postings.agg(F.coalesce(F.max("position"), F.lit(0)).alias("last"))
    found.append(everything.join(F.broadcast(last)).where("marker < last").select("cond_id", (F.col("marker") + 1).alias("found")))  # one row; positions have no gaps
    least = reduce(DataFrame.union, found).groupBy("cond_id").agg(F.min("found").alias("conflict"))
    return conditions.select("cond_id").distinct().join(least, "cond_id", "left")


def folded(parts: DataFrame) -> DataFrame:
    """Requests from their streamed parts (request_id, part_no, condition, events): events in order, the first condition."""
    ordered = F.sort_array(F.collect_list(F.struct("part_no", "events")))
    return parts.groupBy("request_id").agg(F.min_by("condition", F.when(F.col("condition").isNotNull(), F.col("part_no"))).alias("condition"), F.flatten(F.transform(ordered, lambda p: p["events"])).alias("events"))


def replay(requests: DataFrame) -> DataFrame:
    """Each context's requests (context, arrival, key, marker) in order of arrival: a request appends one event of `key`
    unless an accepted one of that key lies past its marker. Accepted appends change what later ones meet, so a context is
    one task; contexts are independent. Returns context, arrival, accepted, position, conflict (0 where there is none)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        last, seen, out = 0, {}, []
        for arrival, key, marker in rows.sort_values("arrival")[["arrival", "key", "marker"]].itertuples(index=False):
            own = seen.setdefault(key, [])
            at = bisect.bisect_right(own, marker)
            if marker >= 0 and at < len(own):
                out.append((arrival, False, 0, own[at]))
            else:
                last += 1
                own.append(last)
                out.append((arrival, True, last, 0))
        made = pd.DataFrame(out, columns=["arrival", "accepted", "position", "conflict"])
        made.insert(0, "context", rows["context"].iloc[0])
        return made

    return requests.groupBy("context").applyInPandas(run, "context string, arrival long, accepted boolean, position long, conflict long")
