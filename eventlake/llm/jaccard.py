"""Exact Jaccard join of word n-gram sets by partition of the universe.

Hashing deals the n-grams of a set to the segments of its size band. Two sets that link differ in few n-grams, so where a
band has more segments than that, they agree on a whole segment: sets that share a segment are candidates. A set probes
only as many of its segments as differences are possible, the fullest, whose candidates cost least. Where too many of its
segments are empty it also probes the one-deletion neighbourhood of segment 0, which counts for two, and after that empty
segments.

Sets that share a segment form a bucket; buckets of the same sets are one. Rows of a bucket carry a sketch of their set: the
parity of the n-grams in each of a number of slots that grows with the set. Where two sketches differ in more slots than
linked sets can differ in n-grams, the sets do not link, so the candidates of a bucket are compared by sketches, in blocks
that are bounded, and nearly all end there without becoming rows. Of those that pass only a spanning forest by least
difference is verified, on the n-grams themselves, byte for byte. Where one of its links fails, all that pass in that bucket
across components are verified. Buckets of more than BLOCK sets are dealt to blocks: first each within itself, then, if the
bucket still has several components, each two blocks of it. No link between different sets is lost. Equal sets are one node
from the start; they are known by two 64-bit hashes.

Words are [^\\x20\\x09-\\x0D]+ after A-Z are lower-cased.

Defined results: a null or empty text, or one without words, is an empty set, linked with nothing; null doc_ids are
documents like others, and a component's id is the smallest that is not null; repeated rows are linked; an empty table
gives no rows; other columns are ignored by `components` and kept by `representatives`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chained, discarded, flat, hashed, input_bytes, lower, map_texts, mixed, parts, table, texts_of, unique_ids, words, written
from .suffixes import BUCKET, bit_table, in_table, later, records_of, splitters_of

SHINGLE, PERCENT = 4, 85
#: Sets of a bucket that are compared at once, about; more are dealt to blocks.
BLOCK = 2048
STEP = 1 << 19
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(buf: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-grams of each row, in order of row; of fewer than k words, all in one."""
    buf = lower(buf)
    start, end, row = words(buf, off)
    word = hashed(buf, start, end)
    n = np.bincount(row, minlength=len(off) - 1)
    first = np.cumsum(n) - n
    rows, made = [], []
    if len(row) >= k:
        at = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :])
        rows.append(row[at])
        made.append(chained([word[at + i] for i in range(k)]))
    for m in range(1, k):
        short = np.flatnonzero(n == m)
        rows.append(short)
        made.append(mixed(chained([word[first[short] + i] for i in range(m)]), m))
    row, h = np.concatenate(rows), np.concatenate(made)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def nodes(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two 64-bit hashes of each row's set."""
    size = np.bincount(row, minlength=n)
    full, out = np.flatnonzero(size), []
    for salt in (11, 12):
        total = np.zeros(n, np.uint64)
        if len(row):
            total[full] = np.add.reduceat(mixed(h, salt), (np.cumsum(size) - size)[full])
        out.append(mixed(total + size.astype(np.uint64), salt + 2).view(np.int64))
    return size, *out


def sketches(row: np.ndarray, h: np.ndarray, size: np.ndarray) -> pa.Array:
    """Of each set the parities of its n-grams in slots, whose number is a power of two, 256 and three for each n-gram at least.
    The first half xor the second is the sketch of half the slots."""
    slots = np.maximum(256, 1 << np.ceil(np.log2(np.maximum(3 * size, 1))).astype(np.int64))
    end = np.cumsum(slots)
    at = (end - slots)[row] + (mixed(h, 41) & (slots[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(end[-1]) if len(end) else 0) & 1).astype(np.uint8)
    offsets = np.concatenate([[0], end // 8]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.packbits(odd, bitorder="little"))])


class Bands:
    """Sizes from edges[i] up to edges[i + 1] are band i, of segments[i] segments."""

    def __init__(self, percent: int, largest: int):
        self.percent = percent
        edges = [1]
        while edges[-1] <= largest:
            edges.append(edges[-1] * 100 // percent + 1)
        self.edges = np.array(edges)
        top = self.edges[1:] - 1
        self.most = self.differences(top, top * 100 // percent)
        self.segments = self.most + 2 + self.most // 32  # some more than can differ, for those that are empty

    def differences(self, a, b):
        """Most n-grams in which sets of sizes a and b can differ and link."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def of(self, size):
        return np.searchsorted(self.edges, size, side="right") - 1


def signatures(row: np.ndarray, h: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature, role) of the segments under which each set is found and looks for others. Roles: 0, 1 for an empty
    segment that only is found, 2 for an empty one that looks. Any two meet but two of role 1."""
    size = np.bincount(row, minlength=n)
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if not len(row):
        return none
    bands = Bands(percent, int(size.max()))
    least = -(-size * percent // 100)
    own, low = bands.of(np.maximum(size, 1)), bands.of(np.maximum(least, 1))
    jobs = []
    for back in range(int((own - low).max()) + 1):
        docs = np.flatnonzero((size > 0) & (own - back >= low))
        band = own[docs] - back
        need = bands.differences(np.minimum(size[docs], bands.edges[band + 1] - 1), size[docs]) + 1
        jobs.append(np.stack([docs, band, need, np.full(len(docs), back == 0)]))
    doc, band, need, home = np.concatenate(jobs, axis=1)
    some = (need > 1) | (home == 1) & (bands.most[band] > 0)  # else only equal sets link
    doc, band, need, home = doc[some], band[some], need[some], home[some].astype(bool)
    if not len(doc):
        return none
    m = bands.segments[band]
    base = np.cumsum(m) - m
    begin = (np.cumsum(size) - size)[doc]
    count = size[doc]
    job = np.repeat(np.arange(len(doc)), count)
    at = np.arange(len(job)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
    token = h[at]
    segment = base[job] + (mixed(token, 17) % m[job].astype(np.uint64)).astype(np.int64)
    value = mixed(token, 19)
    order = np.argsort(segment, kind="stable")
    ordered, value = segment[order], value[order]
    cut = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    total, held = int(m.sum()), np.zeros(int(m.sum()), np.int64)
    sums = np.zeros(total, np.uint64)
    sums[ordered[cut]] = np.add.reduceat(value, cut)
    held += np.bincount(segment, minlength=total)
    seg_job = np.repeat(np.arange(len(doc)), m)
    name = mixed((np.repeat(band, m) * 1_000_003 + np.arange(total) - base[seg_job]).astype(np.uint64), 23)
    # a set is found under all its full segments in its own band; elsewhere it probes the fullest that it needs
    rank = np.empty(total, np.int64)
    by = np.lexsort((-held, seg_job))
    rank[by] = np.arange(total) - base[seg_job[by]]
    full = held > 0
    chosen = full & (home[seg_job] | (rank < need[seg_job]))
    filled = np.bincount(seg_job, full, minlength=len(doc)).astype(np.int64)
    zero = np.zeros(total, bool)
    zero[base] = True
    short = need - filled
    # one-deletion neighbourhoods of segment 0: of every set at home, and of those that probe with too few full segments
    wide = zero[ordered] & (home | (short > 0))[seg_job[ordered]]
    gone = mixed((sums[ordered[wide]] - value[wide]) ^ name[ordered[wide]], 29)
    short = short - (held[base] > 0)
    nth = np.cumsum(~full) - 1
    nth = nth - np.concatenate([[0], np.cumsum(np.bincount(seg_job, ~full, minlength=len(doc)).astype(np.int64))[:-1]])[seg_job]
    looks = ~full & (nth < short[seg_job])
    found = ~full & home[seg_job] & ~looks
    pick = chosen | looks | found
    role = np.where(looks, 2, np.where(found, 1, 0))[pick]
    rows = np.concatenate([doc[seg_job[pick]], doc[seg_job[ordered[wide]]]])
    return rows, np.concatenate([mixed(sums[pick] ^ name[pick], 29), gone]), np.concatenate([role, np.zeros(len(gone), np.int64)])


def _postings(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(sig, uid, role) for the signatures of several sets; of documents with equal sets one is listed."""

    def make(buf, off, uid):
        row, h = shingles(buf, off, k)
        n = len(off) - 1
        size, node, _ = nodes(row, h, n)
        order = np.lexsort((uid, node))
        first = np.zeros(n, bool)
        first[order] = np.concatenate([[True], node[order][1:] != node[order][:-1]]) if n else False
        keep = first[row]
        r, sig, role = signatures(row[keep], h[keep], n, percent)
        return sig, node.view(np.uint64)[r], uid[r], role

    rows = docs.count()
    buckets = max(parts(docs), input_bytes(docs) * 2 // 12 // BUCKET)
    found = later(records_of(docs, make, splitters_of(docs, make, buckets, rows), limit=STEP), buckets, "segments")
    out = found.where("many and not later").select(F.col("g").alias("sig"), "uid", F.col("pos").cast("int").alias("role"))
    out._path = found._path
    return out


def sets_of(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, uid, n, sketch and node, the least uid of an equal set, of docs (doc_id, text, uid). A table."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, h = shingles(*flat(batch["text"]), k)
        size, one_, two = nodes(row, h, batch.num_rows)
        return pa.record_batch([batch["doc_id"], batch["uid"], pa.array(size), pa.array(one_), pa.array(two), sketches(row, h, size)], ["doc_id", "uid", "n", "one", "two", "sketch"])

    found = written(map_texts(docs, one, "doc_id long, uid long, n long, one long, two long, sketch binary", limit=STEP), "hashed")
    least = found.groupBy("one", "two").agg(F.min("uid").alias("node")).toDF("a", "b", "node")
    made = written(found.join(least, (F.col("one") == F.col("a")) & (F.col("two") == F.col("b"))).drop("one", "two", "a", "b"), "known")
    discarded(found)
    return made


def buckets_of(postings: DataFrame, known: DataFrame, block: int) -> DataFrame:
    """The rows of buckets: bucket, of (blocks of the bucket), block, node, n, sketch, found (only: role 1). Signatures of the
    same sets are one bucket."""
    content = postings.groupBy("sig").agg(F.bit_xor(F.xxhash64("uid", "role")).alias("of_all"), F.count("*").alias("size"), F.min("role").alias("low"), F.max("role").alias("high"))
    content = content.where("low = 0 or high = 2").select(F.col("sig").alias("s"), F.xxhash64("of_all", "size").alias("bucket"), F.ceil(F.col("size") / block).alias("of"))
    rows = postings.join(content, F.col("sig") == F.col("s")).groupBy("bucket", "uid").agg(F.max("of").alias("of"), F.min(F.col("role") == 1).alias("found"))
    sets = known.where("uid = node").select("node", "n", "sketch").dropDuplicates(["node"])
    return rows.join(sets, F.col("uid") == F.col("node")).select("bucket", "of", F.pmod(F.xxhash64("node", "bucket"), F.col("of")).alias("block"), "node", "n", "sketch", "found")


class _Group:
    """Sets with sketches, grouped, in order of group: which pairs of a group may link."""

    def __init__(self, batch: pa.Table, percent: int):
        self.percent = percent
        self.group, self.node, self.n, self.label, self.side, self.found = (batch[c].to_numpy() for c in ("group", "node", "n", "label", "side", "found"))
        data, off = flat(batch["sketch"].combine_chunks())
        width = np.diff(off)
        self.width, self.place, self.words = width, np.zeros(len(width), np.int64), {}
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            self.place[rows] = np.arange(len(rows))
            self.words[w] = data[(off[rows][:, None] + np.arange(w)).ravel()].view("<u8").reshape(len(rows), w // 8)

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many slots the sketches of rows a and b differ, in slots of the coarser one."""
        out = np.zeros(len(a), np.int64)
        small, big = np.where(self.width[a] <= self.width[b], a, b), np.where(self.width[a] <= self.width[b], b, a)
        kinds = self.width[small] << 32 | self.width[big]
        for kind in np.unique(kinds).tolist():
            at = np.flatnonzero(kinds == kind)
            low, high = kind >> 32, kind & (1 << 32) - 1
            x, y = self.words[low], self.words[high]
            while y.shape[1] * 8 > low:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            step = max(1, (1 << 22) // x.shape[1])
            for i in range(0, len(at), step):
                some = at[i : i + step]
                out[some] = np.bitwise_count(x[self.place[small[some]]] ^ y[self.place[big[some]]]).sum(axis=1, dtype=np.int64)
        return out

    def passing(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, difference) of the pairs of rows of one group that may link."""
        size = len(self.group)
        ends = np.searchsorted(self.group, self.group, side="right")
        after = ends - np.arange(size) - 1
        total, got, at = np.cumsum(after), [], 0
        while at < size:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 20), side="right")))
            some = np.arange(at, to)
            a = np.repeat(some, after[some])
            b = np.arange(len(a)) - np.repeat(np.cumsum(after[some]) - after[some], after[some]) + a + 1
            low, high = np.minimum(self.n[a], self.n[b]), np.maximum(self.n[a], self.n[b])
            may = (100 * low >= self.percent * high) & (self.label[a] != self.label[b]) & ((self.side[a] != self.side[b]) | (self.side[a] < 0)) & ~(self.found[a] & self.found[b])
            a, b = a[may], b[may]
            most = (100 - self.percent) * (self.n[a] + self.n[b]) // (100 + self.percent)
            differ = self.differ(a, b)
            near = differ <= most
            got.append((a[near], b[near], differ[near]))
            at = to
        return tuple(map(np.concatenate, zip(*got, strict=True)))

    def forest(self, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Which pairs make a spanning forest of least weight, over what the labels connect already."""
        _, comp = np.unique(np.stack([self.group, self.label]), axis=1, return_inverse=True)
        comp = comp.ravel().astype(np.int64)
        x, y = np.minimum(self.node[a], self.node[b]), np.maximum(self.node[a], self.node[b])
        rank = np.empty(len(a), np.int64)
        rank[np.lexsort((y, x, weight))] = np.arange(len(a))
        by_rank = np.argsort(rank)
        chosen, left = np.zeros(len(a), bool), np.arange(len(a))
        while len(left := left[comp[a[left]] != comp[b[left]]]):
            best = np.full(int(comp.max()) + 1, len(a), np.int64)
            np.minimum.at(best, comp[a[left]], rank[left])
            np.minimum.at(best, comp[b[left]], rank[left])
            edge = by_rank[np.unique(best[best < len(a)])]
            chosen[edge] = True
            name = np.arange(len(best))
            while True:  # the least name over the new edges, then over names
                p, q = name[comp[a[edge]]], name[comp[b[edge]]]
                if (p == q).all():
                    break
                np.minimum.at(name, np.maximum(p, q), np.minimum(p, q))
                while (name[name] != name).any():
                    name = name[name]
            comp = name[comp]
        return chosen


def candidates(rows: DataFrame, percent: int, forest: bool, partitions: int) -> DataFrame:
    """(unit, a, b, more) of the pairs that may link and have different labels, of rows (unit, side, node, n, label, sketch,
    found): all, or a spanning forest in each unit; more: the unit has others. Sides below 0 meet themselves."""

    def work(got: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(got)
        unit = np.asarray(whole["unit"].combine_chunks())
        group = np.cumsum(np.concatenate([[0], unit[1:] != unit[:-1]]))
        g = _Group(whole.append_column("group", pa.array(group)), percent)
        a, b, differ = g.passing()
        pick = np.arange(len(a))
        if forest:
            pick = np.flatnonzero(g.forest(a, b, differ))
        more = np.bincount(group[a], minlength=group[-1] + 1) > np.bincount(group[a[pick]], minlength=group[-1] + 1)
        x, y = g.node[a[pick]], g.node[b[pick]]
        if len(pick):
            yield pa.record_batch([pa.array(unit[a[pick]]), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(more[group[a[pick]]])], ["unit", "a", "b", "more"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = np.asarray(batch["unit"])
            last = int(np.searchsorted(-(unit != unit[-1]).astype(np.int8), 0))  # where the last unit begins
            if held and unit[0] != held[-1]["unit"][-1].as_py() and size > 4 * BLOCK:
                yield from work(held)
                held, size = [], 0
            held.append(batch.slice(0, last))
            size += last
            if last and size > 4 * BLOCK:
                yield from work([h for h in held if h.num_rows])
                held, size = [], 0
            held = [h for h in held if h.num_rows]
            held.append(batch.slice(last))
            size += batch.num_rows - last
        if held:
            yield from work(held)

    dealt = rows.repartition(partitions, "unit").sortWithinPartitions("unit").select("unit", "side", "node", "n", "label", "sketch", "found")
    return dealt.mapInArrow(run, "unit long, a long, b long, more boolean")


def ngrams(text: bytes, k: int) -> set[bytes]:
    """The n-grams themselves, words joined by a space; of fewer than k words, all in one."""
    found = _WORD.findall(text.lower())
    if len(found) <= k:
        return {b" ".join(found)} if found else set()
    joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found])
    return {joined[a:b] for a, b in zip([0, *ends[:-k].tolist()], (ends[k - 1 :] - 1).tolist(), strict=True)}


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) of uids of docs that link, as a table."""
    ends = written(pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct().withColumn("pos", F.lit(0).cast("long")), "ends")
    texts = docs.select("uid", "text")
    if (bits := bit_table(ends)) is not None:
        shared, schema = docs.sparkSession.sparkContext.broadcast(bits), texts.schema

        def maybe(batch: pa.RecordBatch) -> pa.RecordBatch:
            uid = np.asarray(batch["uid"])
            return batch.filter(pa.array(in_table(shared.value, uid, np.zeros(len(uid), np.int64))))

        texts = map_texts(texts, maybe, schema)
    texts = written(texts.join(ends.select("uid"), "uid", "left_semi").dropDuplicates(["uid"]), "texts")
    met = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        links, known = [], {}
        for a, b, *both in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), *(batch[c].cast(pa.binary()).to_pylist() for c in ("text_a", "text_b")), strict=True):
            x, y = (known[i] if i in known else known.setdefault(i, ngrams(t, k)) for i, t in zip((a, b), both, strict=True))
            common = len(x & y)
            links.append(100 * common >= percent * (len(x) + len(y) - common))
        return batch.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    out = written(map_texts(met, one, "a long, b long", "text_a", STEP // 2), "verified")
    discarded(ends, texts)
    return out


def connected(links: DataFrame) -> DataFrame:
    """node and label (the least node of its component) of the nodes of links (a, b), as a table: least labels over links,
    then over labels, until nothing changes."""
    both = written(links.union(links.select("b", "a")).distinct().toDF("a", "b"), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = hooked.select(F.col("node").alias("at"), F.col("label").alias("far"))
        moved = written(hooked.join(jump, hooked["label"] == jump["at"]).select("node", "old", F.least("label", "far").alias("label")), "labels")
        discarded(labels)
        labels = moved
        if not moved.where("old <> label").limit(1).count():
            discarded(both)
            return labels


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    names = labels.select(F.col("node").alias("of_node"), F.col("label").alias("known_label"))
    return rows.join(names, F.col("node") == F.col("of_node"), "left").withColumn("label", F.coalesce("known_label", "node")).drop("of_node", "known_label")


class Links:
    """The links found so far and the components that they make."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.docs, self.k, self.percent, self.links, self.labels = docs, k, percent, [], None

    def search(self, units: DataFrame) -> None:
        """Looks for links in units (unit, side, node, n, sketch, found) until all candidates across components are settled."""
        partitions = parts(units, 8 << 20)
        first = written(candidates(labelled(units, self.labels), self.percent, True, partitions), "forest")
        good = self._verify(first)
        failed = first.where("more").join(good.toDF("x", "y"), (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti").select(F.col("unit").alias("again")).distinct()
        failed = written(failed, "failed")
        if failed.limit(1).count():
            open_ = units.join(failed, F.col("unit") == F.col("again"), "left_semi")
            second = written(candidates(labelled(open_, self.labels), self.percent, False, partitions).join(first.select("a", "b"), ["a", "b"], "left_anti"), "candidates")
            self._verify(second)
            discarded(second)
        discarded(first, failed)

    def _verify(self, found: DataFrame) -> DataFrame:
        good = verified(found.select("a", "b").distinct(), self.docs, self.k, self.percent)
        if good.limit(1).count():
            self.links.append(good)
            every = self.links[0]
            for more in self.links[1:]:
                every = every.union(more)
            discarded(self.labels)
            self.labels = connected(every)
        return good


def join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> tuple[DataFrame, DataFrame | None]:
    """Of docs (doc_id, text, uid): sets_of(docs), and the labels of nodes that are linked (None: none are)."""
    known = sets_of(docs, k)
    postings = _postings(docs, k, percent)
    rows = written(buckets_of(postings, known, block), "buckets")
    discarded(postings)
    found = Links(docs, k, percent)
    found.search(rows.select(F.xxhash64("bucket", "block").alias("unit"), F.lit(-1).alias("side"), "node", "n", "sketch", "found"))
    large = labelled(rows.where("of > 1"), found.labels)
    mixed_ = large.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select(F.col("bucket").alias("open"))
    if mixed_.limit(1).count():
        pairs = large.join(mixed_, F.col("bucket") == F.col("open"), "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1))).where("other <> block")
        found.search(written(pairs.select(F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), F.col("block").cast("int").alias("side"), "node", "n", "sketch", "found"), "blocks"))
    discarded(rows, *found.links)
    return known, found.labels


def components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Per document of docs (doc_id, text): doc_id, n_shingles, component_id, and uid and first (its component's least uid)."""
    keyed = unique_ids(docs)
    known, labels = join(keyed, k, percent, block)
    rows = labelled(known.drop("sketch"), labels)
    least = rows.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"), F.min("uid").alias("first")).withColumnRenamed("label", "of")
    met = rows.join(least, (F.col("label") == F.col("of")) & (F.col("n") > 0), "left")
    return met.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), "uid", F.coalesce("first", "uid").alias("first"))


def representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs of which each is the first of its component, with all columns."""
    found = components(texts_of(docs), k, percent).where("n_shingles > 0")
    if not found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count():
        return docs.join(written(found.where("uid <> first").select(F.col("doc_id").alias("__gone")), "gone"), F.col("doc_id") == F.col("__gone"), "left_anti")
    # doc_ids are not unique: a row is known by its text too
    rows = docs.withColumn("__text", F.coalesce(F.col("text"), F.lit("")))
    keyed = unique_ids(texts_of(docs)).dropDuplicates(["uid"]).join(written(found.select("uid", "first").distinct(), "firsts").withColumnRenamed("uid", "__uid"), F.col("uid") == F.col("__uid"), "left")
    keyed = keyed.select(F.col("doc_id").alias("__id"), F.col("text").alias("__own"), F.coalesce(F.col("uid") == F.col("first"), F.lit(True)).alias("__first"), F.col("first").isNotNull().alias("__words"))
    met = rows.join(keyed, rows["doc_id"].eqNullSafe(keyed["__id"]) & (rows["__text"] == keyed["__own"])).where("__first")
    return met.where("__words").dropDuplicates(["__id", "__own"]).union(met.where("not __words")).select(*docs.columns)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(texts_of(table(spark, sf_dir, "documents"))).select("doc_id", "n_shingles", "component_id")


#: The same by SQL, from all pairs of documents that share an n-gram: for small tables.
ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
r as (select doc_id as d, doc_id as other from n
      union select r.d, case when l.a = r.other then l.b else l.a end from r join l on l.a = r.other or l.b = r.other),
m as (select d, min(other) as least from r group by 1)
select w.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(least, w.doc_id) as component_id
from w left join n on n.doc_id = w.doc_id left join m on m.d = w.doc_id
"""
