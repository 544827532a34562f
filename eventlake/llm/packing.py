"""Best-fit packing of documents into sequences of fixed length after Martello-Toth dominance reduction.

Only the number of pieces of each length matters, so the instance is a table of at most `capacity` counts, whatever the
corpus. The reduction fixes sets of pieces that dominate every other feasible set of their largest piece: pieces that
fill a sequence exactly in pairs, pieces that nothing fits beside, and pairs where the partner is at least as long as any
set that could stand in its place. It goes through all lengths, longest first, and repeats until nothing can be fixed;
sets of three are not looked at. Best fit by falling length packs the rest.
Both work on runs of equal pieces, so the plan has a few thousand runs at most. Pieces find their place by length and rank.

Defined results: a null or empty text is the end id alone; null doc_ids and repeated rows are packed like others; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import sliced, table, texts_of, trim, written
from .encoding import encoder, with_end

CAPACITY = 2048
VOCABULARY, END = "byte_bpe_50k.json", 0


def reduced(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Takes the dominating sets out of counts (by length); (how many, [(length, times)]) of each."""
    fixed = []

    def fix(n: int, *lengths: int) -> None:
        fixed.append((n, [(x, lengths.count(x)) for x in sorted(set(lengths), reverse=True)]))
        for x in lengths:
            counts[x] -= n

    if counts[capacity]:
        fix(int(counts[capacity]), capacity)
    for a in range(capacity - 1, (capacity - 1) // 2, -1):  # a full pair dominates all sets of its longer piece
        b = capacity - a
        n = int(counts[a] // 2 if a == b else min(counts[a], counts[b])) if a >= b else 0
        if n:
            fix(n, a, b)
    before = -1
    while len(fixed) > before:
        before = len(fixed)
        for a in np.flatnonzero(counts)[::-1].tolist():
            while counts[a] and (found := _dominating(counts, a, capacity - a)):
                n, b = found
                fix(n, *((a, b) if b else (a,)))
    return fixed


def _dominating(counts: np.ndarray, a: int, room: int) -> tuple[int, int] | None:
    """How often, and the partner of a (0: none) in a set that dominates all sets with a; None where there is no such pair."""
    counts[a] -= 1
    fits = np.flatnonzero(counts[: room + 1])
    has = counts[fits]
    twice = fits[has > 1]
    counts[a] += 1
    if not len(fits):
        return int(counts[a]), 0
    b = int(fits[-1])
    if b < room:
        beside = np.searchsorted(fits, np.minimum(room - fits, fits - 1), side="right") - 1
        two = (fits + fits[beside])[beside >= 0]  # of two lengths
        if (two > b).any() or ((2 * twice > b) & (2 * twice <= room)).any():
            return None
        one, more, all_ = 0, 0, (1 << room + 1) - 1  # sums up to room of one piece, and of several
        for x, n in zip(fits.tolist(), has.tolist(), strict=True):
            n, times = min(n, room // x), 1
            while n:
                times = min(times, n)
                more |= (one | more | (times > 1)) << x * times & all_
                one |= 1 << x if times == 1 else 0
                n -= times
                times *= 2
        if more.bit_length() - 1 > b:
            return None
    return int(counts[a] // 2 if a == b else min(counts[a], counts[b])) or 1, b


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit by falling length: each piece goes to the fullest sequence that has room, by runs of equal sequences."""
    open_: dict[int, list] = defaultdict(list)
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        for room in [r for r in sorted(open_) if r >= length] if left else []:
            runs, each = open_.pop(room), room // length
            while runs and left:
                n, content = runs.pop()
                full = min(n, left // each)
                if full:
                    open_[room - each * length].append((full, [*content, (length, each)]))
                    left -= full * each
                if n > full and left and left < each:
                    open_[room - left * length].append((1, [*content, (length, left)]))
                    left, full = 0, full + 1
                if n > full:
                    runs.append((n - full, content))
                    if left >= each:
                        continue
            if runs:
                open_[room].extend(runs)
            if not left:
                break
        each = capacity // length
        if left >= each:
            open_[capacity - each * length].append((left // each, [(length, each)]))
            left %= each
        if left:
            open_[capacity - left * length].append((1, [(length, left)]))
    return [run for runs in open_.values() for run in runs]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where the pieces of each length and rank go: runs (length, first rank) with the first sequence, the pieces of a
    sequence and the first offset."""
    counts = counts.astype(np.int64).copy()
    runs, rank, sequence = [], defaultdict(int), 0
    for n, content in reduced(counts, capacity) + best_fit(counts, capacity):
        offset = 0
        for length, each in content:
            runs.append((length, rank[length], sequence, each, offset))
            rank[length] += n * each
            offset += length * each
        sequence += n
    runs = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return {"key": runs[:, 0] << 44 | runs[:, 1], "rank": runs[:, 1], "sequence": runs[:, 2], "each": runs[:, 3], "offset": runs[:, 4]}


def cut(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents, without a place: with the task that made each and its rank there among its length."""

    def run(batches):
        from pyspark import TaskContext

        encode, seen, part = encoder(vocabulary, "<u4", False), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in (piece for b in batches for piece in sliced(b, "text", 4 << 20)):
            rows, piece, start, length, sums = [], [], [], [], []
            ids, off = with_end(*encode.ids(batch["text"]), end)
            for k, (first, total) in enumerate(zip(off.tolist(), np.diff(off).tolist(), strict=False)):
                edges = [0, *range(total % capacity or capacity, total + 1, capacity)]
                for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append(k)
                    piece.append(i)
                    start.append(a)
                    length.append(b - a)
                    sums.append(zlib.crc32(ids[first + a : first + b]))
            lengths = np.array(length, np.int64)
            order = np.argsort(lengths, kind="stable")
            ordered = lengths[order]
            rank = np.empty(len(lengths), np.int64)
            rank[order] = seen[ordered] + np.arange(len(ordered)) - np.searchsorted(ordered, ordered)
            seen += np.bincount(lengths, minlength=capacity + 1)
            yield pa.record_batch([batch["doc_id"].take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64()), pa.array(np.full(len(rows), part, np.int64)), pa.array(rank)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])
        trim()

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long")


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """Per piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(cut(docs, vocabulary, end, capacity), "pieces")  # encoded once
    by = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    base = written(by.withColumn("base", F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")), "ranks")
    counts = np.zeros(capacity + 1, np.int64)
    for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    shared = docs.sparkSession.sparkContext.broadcast(plan(counts, capacity))  # a few runs for each length

    def place(batches):
        p = shared.value
        for b in batches:
            length, rank = np.asarray(b["length"]), np.asarray(b["rank"])
            run = np.searchsorted(p["key"], length << 44 | rank, side="right") - 1
            nth = rank - p["rank"][run]
            yield pa.record_batch([*(b[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(p["sequence"][run] + nth // p["each"][run]), pa.array(p["offset"][run] + nth % p["each"][run] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(base.drop("n"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(texts_of(table(spark, sf_dir, "documents")))
