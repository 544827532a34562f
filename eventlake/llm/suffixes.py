"""Removal of long repeated byte strings by a sparse suffix array.

Every string of LENGTH bytes holds an anchor: the place of the least hash of GRAM bytes in it. Equal strings have their
anchors at equal places, so it is enough to sort the suffixes that begin at anchors. Each record has the leading bytes of
its suffix with a hash of its first GRAM bytes (the group), a hash of all bytes that a string with this anchor can reach
(the class), document and place. Splitters sampled from the documents range-partition the records by leading bytes;
splitters go down to document and place, so that one string which a third of the documents share is spread over buckets.
Each bucket sorts its records by multikey quicksort, key by key where the keys before are equal, and compares neighbours;
what spans a boundary is settled by the buckets' first and last keys.

A record whose class occurs earlier stands for strings that all occur earlier. Of a class only the first record is left to
judge, and only where its group has other classes too: its strings go through a second round of the same sort, one record
for each string. All strings are judged on the input.

Defined results: a null or empty text has nothing to remove; null doc_ids come before all others; rows that share doc_id
and text are one document, and rows that share only doc_id are ordered by a digest of the text; an empty table gives no
rows; other columns are ignored. Texts are cut by bytes and may end inside a character, so only a digest is returned by
`digests`; `removed_runs` gives the runs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Hashes, chained, flat, ids_unique, input_bytes, map_texts, mixed, parts, released, signed, table, texts_of, unique_ids, written

LENGTH, GRAM = 100, 64
#: Text bytes worked on at once; a record for each of some 20 bytes.
STEP = 1 << 20
#: Documents whose records are the sample for the splitters, about.
SAMPLED = 1500
#: Records of a bucket, about.
BUCKET = 400_000
#: Bits of the table of records to judge that is broadcast; with more records than a 16th of it they are joined instead.
TABLE_BITS = 27
RECORD = "bucket int, g long, c long, uid long, pos long"


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of each window of `width`, by running extremes in blocks from both sides."""
    run, fill = (np.minimum, np.uint64((1 << 64) - 1)) if least else (np.maximum, np.uint64(0))
    n = len(x)
    padded = np.full(-(-n // width) * width, fill)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = run.accumulate(blocks, axis=1).ravel()
    back = run.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return run(back[: n - width + 1], ahead[width - 1 : n])


def anchors(buf: np.ndarray, off: np.ndarray, hashes: Hashes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in buf, document, hash of the gram there) of the anchors of all strings of `length` that lie in a document."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    if len(buf) < length:
        return none
    at = np.arange(len(buf) - gram + 1)
    h = hashes.of(at, at + gram) | np.uint64(1)
    width = length - gram + 1
    least = _sliding(h, width, True)
    ends = np.repeat(off[1:], np.diff(off))  # of each byte: its document's end
    least[np.arange(len(least)) + length > ends[: len(least)]] = 0
    padded = np.zeros(len(h) + width - 1, np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    chosen = np.flatnonzero(_sliding(padded, width, False) == h)
    return chosen, np.searchsorted(off, chosen, side="right") - 1, h[chosen]


def _lead(buf: np.ndarray, at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Two leading bytes, then 48 bits of hash."""
    return buf[at].astype(np.uint64) << np.uint64(56) | buf[at + 1].astype(np.uint64) << np.uint64(48) | h >> np.uint64(16)


def anchor_records(buf: np.ndarray, off: np.ndarray, uid: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(g, c, uid, pos) of every anchor."""
    hashes = Hashes(buf)
    at, row, h = anchors(buf, off, hashes, length, gram)
    left, right = np.minimum(at - off[row], length - gram), np.minimum(off[row + 1] - at, length)
    return _lead(buf, at, h), chained([hashes.of(at - left, at + right), left.astype(np.uint64)]), uid[row], at - off[row]


def string_records(buf: np.ndarray, off: np.ndarray, uid: np.ndarray, judged: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(g, c, uid, pos) of every string whose anchor is marked in `judged`, the table of hashed (uid, pos)."""
    hashes = Hashes(buf)
    at, row, _ = anchors(buf, off, hashes, length, gram)
    hit = in_table(judged, uid[row], at - off[row])
    at, row = at[hit], row[hit]
    first, last = np.maximum(at - (length - gram), off[row]), np.minimum(at, off[row + 1] - length)
    edge = np.zeros(len(buf) + 1, np.int64)
    keep = first <= last
    np.add.at(edge, first[keep], 1)
    np.add.at(edge, last[keep] + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    of = np.searchsorted(off, starts, side="right") - 1
    h = hashes.of(starts, starts + length)
    return _lead(buf, starts, mixed(h, 3)), h, uid[of], starts - off[of]


def _place(uid: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return (mixed(mixed(uid.astype(np.int64).view(np.uint64)) + pos.astype(np.uint64), 5) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def in_table(table_: np.ndarray, uid: np.ndarray, pos: np.ndarray) -> np.ndarray:
    p = _place(uid, pos)
    return table_[p >> 3] >> (p & 7).astype(np.uint8) & 1 > 0


def _packed(g, c, uid, pos) -> np.ndarray:
    """Records as byte strings in their order."""
    out = np.zeros(len(g), np.dtype([("g", ">u8"), ("c", ">u8"), ("u", ">u8"), ("p", ">u4")]))
    out["g"], out["c"], out["u"], out["p"] = g, c, uid.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63), pos
    return out.view("S28").ravel()


def multikey_order(*keys: np.ndarray) -> np.ndarray:
    """Order by the first key; then only where keys are equal so far, by the next."""
    order = np.argsort(keys[0], kind="quicksort")
    run = np.cumsum(np.concatenate([[0], keys[0][order][1:] != keys[0][order][:-1]])) if len(order) else order
    for key in keys[1:]:
        size = np.bincount(run)
        tied = np.flatnonzero(size[run] > 1)
        if not len(tied):
            break
        own = order[tied]
        order[tied] = own[np.lexsort((key[own], run[tied]))]
        sorted_ = key[order]
        run = np.cumsum(np.concatenate([[0], (run[1:] != run[:-1]) | (sorted_[1:] != sorted_[:-1])]))
    return order


def records_of(docs: DataFrame, make, splitters: np.ndarray | None, limit: int = STEP) -> DataFrame:
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        g, c, uid, pos = make(*flat(batch["text"]), np.asarray(batch["uid"]))
        bucket = np.searchsorted(splitters, _packed(g, c, uid, pos), side="right") if splitters is not None else np.zeros(len(g))
        return pa.record_batch([pa.array(bucket.astype(np.int32)), pa.array(signed(g)), pa.array(signed(c)), pa.array(uid), pa.array(pos)], ["bucket", "g", "c", "uid", "pos"])

    return map_texts(docs.select("uid", "text"), one, RECORD, limit=limit)


def splitters_of(docs: DataFrame, make, buckets: int, rows: int) -> np.ndarray:
    """Keys that divide the sampled documents' records evenly."""
    every = max(1, rows // SAMPLED)
    found = records_of(docs.where(F.pmod(F.xxhash64("uid"), F.lit(every)) == 0), make, None).select("g", "c", "uid", "pos")
    found = found.where(F.pmod(F.xxhash64("uid", "pos"), F.lit(4)) == 0).toArrow()
    cols = [found[k].to_numpy() for k in ("g", "c", "uid", "pos")]
    keys = np.sort(_packed(cols[0].view(np.uint64), cols[1].view(np.uint64), cols[2], cols[3]))
    even = [(k << 64) // buckets for k in range(1, buckets)]
    if len(keys) < 4 * buckets:  # too few to tell: even parts of the keys' range
        zero = np.zeros(len(even), np.int64)
        return _packed(np.array(even, np.uint64), zero, zero, zero)
    return keys[(np.arange(1, buckets) * len(keys)) // buckets]


def _compared(batches):
    """Sorts a bucket and compares neighbours. Rows: a record whose group has others, or may have in the next buckets;
    kind 1: its class has an earlier record here. At last the bucket's own row (kind -1) with its first and last keys."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    bucket = got[0]["bucket"][0].as_py()
    g, c, uid, pos = (np.concatenate([np.asarray(b[k]) for b in got]) for k in ("g", "c", "uid", "pos"))
    order = multikey_order(g.view(np.uint64), c.view(np.uint64), uid, pos)
    g, c, uid, pos = g[order], c[order], uid[order], pos[order]
    n = len(g)
    new_g = np.concatenate([[True], g[1:] != g[:-1]])
    new_c = new_g | np.concatenate([[True], c[1:] != c[:-1]])
    group, cls = np.cumsum(new_g) - 1, np.cumsum(new_c) - 1
    in_group = np.bincount(group)[group]
    classes = np.bincount(group[new_c])[group]
    keep = (in_group > 1) | (group == 0) | (group == group[-1])
    cols = {"bucket": np.full(n, bucket, np.int32), "g": g, "c": c, "uid": uid, "pos": pos, "kind": (~new_c).astype(np.int32), "many": classes > 1, "head_class": cls == 0, "head": group == 0, "tail": group == group[-1]}
    for a in range(0, n, 200_000):
        part = np.flatnonzero(keep[a : a + 200_000]) + a
        if len(part):
            yield pa.RecordBatch.from_pydict({k: pa.array(v[part]) for k, v in cols.items()} | {"last_g": pa.nulls(len(part), pa.int64()), "last_c": pa.nulls(len(part), pa.int64())})
    yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "g": g[:1], "c": c[:1], "uid": uid[:1], "pos": pos[:1], "kind": pa.array([-1], pa.int32()), "many": [False], "head_class": [False], "head": [False], "tail": [False], "last_g": g[-1:], "last_c": c[-1:]})


def later(records: DataFrame, buckets: int, name: str) -> DataFrame:
    """Of records: g, c, uid, pos, later (an equal (g, c) comes before) and many (g has other c), for all where either holds."""
    schema = "bucket int, g long, c long, uid long, pos long, kind int, many boolean, head_class boolean, head boolean, tail boolean, last_g long, last_c long"
    rows = written(records.repartitionById(buckets, F.col("bucket")).mapInArrow(_compared, schema), name)
    edges = sorted((r["bucket"], r["g"], r["c"], r["last_g"], r["last_c"]) for r in rows.where("kind = -1").collect())  # a row for each bucket
    known = [(b, i > 0 and edges[i - 1][3] == g, i > 0 and edges[i - 1][3:] == (g, c), i + 1 < len(edges) and edges[i + 1][1] == lg) for i, (b, g, c, lg, _) in enumerate(edges)]
    edge = records.sparkSession.createDataFrame(known or [(-1, False, False, False)], "of int, group_before boolean, class_before boolean, group_after boolean")
    met = rows.where("kind >= 0").join(F.broadcast(edge), F.col("bucket") == F.col("of"))
    met = met.select("g", "c", "uid", "pos", ((F.col("kind") == 1) | F.col("head_class") & F.col("class_before")).alias("later"), (F.col("many") | F.col("head") & F.col("group_before") | F.col("tail") & F.col("group_after")).alias("many"))
    out = met.where("later or many")
    out._path = rows._path
    return out


def removed_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs (doc_id, text) with uid and marks: places whose reach is removed (2 * pos for an anchor, 2 * pos + 1 for a string)."""
    unique = ids_unique(docs)
    keyed = unique_ids(docs)
    single = keyed if unique else keyed.dropDuplicates(["uid"])
    rows, size = single.count(), input_bytes(docs) * 2
    buckets = max(parts(docs), size // (length - gram + 1) * 2 // BUCKET)
    make = lambda buf, off, uid: anchor_records(buf, off, uid, length, gram)
    first = later(records_of(single, make, splitters_of(single, make, buckets, rows)), buckets, "anchors")
    released(docs.sparkSession)
    judge = first.where("many and not later").select("uid", "pos")
    strings = later(_judged(single, judge, buckets, rows, length, gram), buckets, "strings").where("later")
    released(docs.sparkSession)
    marks = first.where("later").select("uid", (F.col("pos") * 2).alias("mark")).union(strings.select("uid", (F.col("pos") * 2 + 1).alias("mark")))
    marks = marks.groupBy("uid").agg(F.collect_list("mark").alias("marks"))
    return keyed.join(marks, "uid", "left")


def bit_table(keys: DataFrame) -> np.ndarray | None:
    """A bit table of fixed size with a bit for each hashed (uid, pos); None if they are too many for it."""
    if keys.count() > 1 << TABLE_BITS - 4:
        return None

    def hashed(batches):
        for b in batches:
            p = _place(np.asarray(b["uid"]), np.asarray(b["pos"]))
            yield pa.record_batch([pa.array((p >> 6).astype(np.int32)), pa.array(signed(np.uint64(1) << (p & 63).astype(np.uint64)))], ["word", "bits"])

    words = keys.select("uid", "pos").mapInArrow(hashed, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2 ** (TABLE_BITS - 6)
    table_ = np.zeros(1 << TABLE_BITS - 6, np.int64)
    table_[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table_.view(np.uint8)


def _judged(docs: DataFrame, judge: DataFrame, buckets: int, rows: int, length: int, gram: int) -> DataFrame:
    """Records of the strings of the anchors to judge. The anchors come as a bit table of fixed size, in which a wrong hit
    only adds strings, or joined to their documents where they are too many for it."""
    spark = docs.sparkSession

    if (table_ := bit_table(judge)) is not None:
        shared = spark.sparkContext.broadcast(table_)
        make = lambda buf, off, uid: string_records(buf, off, uid, shared.value, length, gram)
        return records_of(docs, make, splitters_of(docs, make, buckets, rows))
    lists = judge.groupBy("uid").agg(F.collect_list("pos").alias("at"))
    met = docs.join(lists, "uid")
    everything = np.full(1 << TABLE_BITS - 3, 255, np.uint8)
    make = lambda buf, off, uid: string_records(buf, off, uid, everything, length, gram)
    splitters = splitters_of(docs, make, buckets, rows)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        uid, lists_ = np.asarray(batch["uid"]), batch["at"]
        own = np.zeros(1 << TABLE_BITS - 3, np.uint8)
        p = _place(np.repeat(uid, np.diff(np.asarray(lists_.offsets))), np.asarray(lists_.flatten()))
        np.bitwise_or.at(own, p >> 3, (1 << (p & 7)).astype(np.uint8))
        g, c, u, pos = string_records(*flat(batch["text"]), uid, own, length, gram)
        return pa.record_batch([pa.array(np.searchsorted(splitters, _packed(g, c, u, pos), side="right").astype(np.int32)), pa.array(signed(g)), pa.array(signed(c)), pa.array(u), pa.array(pos)], ["bucket", "g", "c", "uid", "pos"])

    return map_texts(met, one, RECORD, limit=STEP)


def covered(size: int, marks: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Which bytes of a document the marks remove."""
    pos, whole = marks >> 1, marks & 1 == 1
    start = np.where(whole, pos, np.maximum(pos - (length - gram), 0))
    end = np.minimum(pos + length, size)
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, marks in zip(batch["text"].to_pylist(), batch["marks"], strict=True):
            raw = text.encode()
            if not marks.is_valid:
                out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                continue
            gone = covered(len(raw), marks.values.to_numpy(), length, gram)
            runs = int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1).sum())
            out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
        cols = list(zip(*out, strict=True))
        return pa.record_batch([batch["doc_id"], *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_texts(removed_runs(docs, length, gram).select("doc_id", "text", "marks"), one, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(texts_of(table(spark, sf_dir, "documents")))
