"""Toxicity by a factorization machine over hashed terms.

A term is a word or the first four to six bytes of one, hashed to one of 2^18 slots. Every slot that occurs in a bounded
labelled sample gets a weight and a vector; a document's margin is the bias, the weights of its distinct slots and, over
its size, the inner products of their vectors in pairs, so that an insult beside a group's name can weigh more than both
alone. What tells nothing is held down by regularisation and not left out: both are scaled down for slots of few rows or
of nearly all, and weights also by how little the slot tells alone (chi-squared); vectors are not, so pairs that tell only
together are learned. Margins become probabilities by a sigmoid fitted on rows kept out of the fit.

Defined results: a null or empty text scores as one without terms; null doc_ids are not held out and never learned
from; repeated rows are scored like others; without labels of both kinds all scores are 0; an empty table gives no rows;
other columns are ignored by `score` and kept by `without_toxic`. Of several labels of a doc_id the highest counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Hashes, flat, lower, map_texts, spans, table, texts_of, written
from .quality import calibrate

#: Labelled rows the machine is fitted on, at most (the bound of the sample).
FIT_ROWS = 20_000
SLOT_BITS, FACTORS = 18, 8
#: Rows and chi-squared of a slot at which its scale is half.
HALF_ROWS, HALF_CHI = 10.0, 26.0
BATCH = 256
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
_PART = np.ones(256, bool)  # white space and ASCII punctuation end a term
_PART[:48] = _PART[58:65] = _PART[91:97] = _PART[123:128] = False
_PART[ord("'")] = True


def terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word and of its prefixes."""
    buf = lower(buf)
    start, end, row = spans(_PART[buf], off)
    hashes, rows, out = Hashes(buf), [row], []
    out.append(hashes.of(start, end))
    for k in PREFIXES:
        long = end - start > k
        out.append(hashes.of(start[long], start[long] + k))
        rows.append(row[long])
    return np.concatenate(rows), np.concatenate(out)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Texts and labels of at most `rows` documents that are not held out, those of the smallest hashes; their ids are broadcast."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("key"), F.col("toxic").cast("int").alias("toxic")).dropna()
    chosen = chosen.groupBy("key").agg(F.max("toxic").alias("y")).where(~held_out("key")).orderBy(F.xxhash64("key"), "key").limit(rows)
    return docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["key"]).select("doc_id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict:
    rows_in = written(sample(docs, labels, rows), "labelled")  # one pass over the documents, two over the sample
    if rows_in.select("y").distinct().count() < 2:
        return {"terms": np.zeros(0, np.int64)}

    def active(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, at = slots(*flat(batch["text"]))
        cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
        return pa.record_batch([batch["doc_id"], batch["y"], pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(at, pa.int32()))], ["doc_id", "y", "at"])

    found = map_texts(rows_in, active, "doc_id long, y int, at array<int>").toArrow()  # at most `rows` rows
    y, order = (found["y"].to_numpy() > 0).astype(np.float64), np.argsort(found["doc_id"].to_numpy(), kind="stable")
    chunks = found["at"].chunks
    cut = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(np.asarray(c.offsets)) for c in chunks]))])
    at = np.concatenate([np.asarray(c.flatten()) for c in chunks])
    del found, chunks
    return machine(cut, at, y, order)


def slots(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the distinct slots of each row, in order of row."""
    row, h = terms(buf, off)
    key = np.unique(row << SLOT_BITS | (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
    return key >> SLOT_BITS, key & (1 << SLOT_BITS) - 1


def summed(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums of the rows of x between cuts."""
    out, some = np.zeros((len(cut) - 1, x.shape[1]), np.float32), cut[1:] > cut[:-1]
    if some.any():
        out[some] = np.add.reduceat(x, cut[:-1][some], axis=0)
    return out


def margins(row: np.ndarray, at: np.ndarray, n: int, model: dict) -> np.ndarray:
    """Margins of n rows; (row, at) in order of row."""
    every = np.concatenate([model["w"][:, None], model["v"], model["size"][:, None]], 1)
    z, cut = np.zeros(n), np.searchsorted(row, np.arange(n + 1))
    for a in range(0, n, BATCH):
        b = min(n, a + BATCH)
        x, own = every[at[cut[a] : cut[b]]], cut[a : b + 1] - cut[a]
        sums = summed(x, own)
        squares = summed((x[:, 1:-1] ** 2).sum(1, keepdims=True), own)[:, 0]
        z[a:b] = model["b"] + sums[:, 0] + 0.5 * ((sums[:, 1:-1] ** 2).sum(1) - squares) / np.maximum(sums[:, -1], 1e-3)
    return z


def machine(cut: np.ndarray, at: np.ndarray, y: np.ndarray, order: np.ndarray, factors: int = FACTORS, steps: int = 300, passes: int = 8, seed: int = 5) -> dict:
    """Weights and vectors by AdaGrad on the logistic loss, kinds balanced, in batches; weights shrink by L1, vectors by L2.
    Row i has the slots at[cut[i] : cut[i + 1]]. Every fifth row in `order` calibrates and isn't fitted. No array but `at` and
    what the batches need of it is as long as the sample."""
    n, size, random = len(y), 1 << SLOT_BITS, np.random.default_rng(seed)
    test = np.arange(n) % 5 == 4 if n >= 50 else np.zeros(n, bool)
    of, toxic = np.zeros(size), np.zeros(size)
    for a in range(0, n, 8 * BATCH):
        part = at[cut[a] : cut[min(n, a + 8 * BATCH)]]
        of += np.bincount(part, minlength=size)
        toxic += np.bincount(part, np.repeat(y[a : a + 8 * BATCH], np.diff(cut[a : a + 8 * BATCH + 1])), minlength=size)
    chi = n * (toxic * n - of * y.sum()) ** 2 / np.maximum(of * y.sum() * (n - y.sum()), 1e-9) / (n - of + 1.0)
    common = of / (of + HALF_ROWS) * np.sqrt(1 - of / n)
    scale = np.column_stack([common * (chi + 2) / (chi + HALF_CHI), *[common] * factors]).astype(np.float32)
    whole = np.concatenate([np.bincount(np.repeat(np.arange(len(own) - 1), np.diff(own)), common[at[own[0] : own[-1]]] ** 2, minlength=len(own) - 1) for own in (cut[a : a + BATCH + 1] for a in range(0, n, BATCH))])
    whole = np.maximum(whole, 1e-3).astype(np.float32)
    own = np.column_stack([np.zeros(size), random.normal(0, 0.01, (size, factors))]).astype(np.float32)  # weight, vector
    rate = np.array([0.2] + [0.1] * factors, np.float32)
    shrink, least = np.array([0.0] + [1e-3] * factors, np.float32), 3e-4
    square, b, b_square = np.full_like(own, 1e-8), 0.0, 1e-8
    learned = order[random.permutation(np.flatnonzero(~test))]
    balance = np.where(y > 0, 0.5 / max(y[learned].mean(), 1e-9), 0.5 / max(1 - y[learned].mean(), 1e-9))
    batches = []
    for a in range(0, len(learned), BATCH):
        rows = learned[a : a + BATCH]
        many = cut[rows + 1] - cut[rows]
        starts = np.concatenate([[0], np.cumsum(many)])
        used, which = np.unique(at[np.repeat(cut[rows] - starts[:-1], many) + np.arange(starts[-1])], return_inverse=True)
        by_slot = np.repeat(np.arange(len(rows), dtype=np.uint8), many)[np.argsort(which, kind="stable")]
        batches.append((rows, starts, used, which.astype(np.int32), by_slot, np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(used)))])))
    for step in range(max(steps, passes * len(batches))):
        rows, starts, used, which, by_slot, ends = batches[step % len(batches)]
        x, q, part = own[used] * scale[used], own[used], 1 / whole[rows]
        sums = summed(x[which], starts)
        squares = summed((x[:, 1:] ** 2).sum(1)[which][:, None], starts)[:, 0]
        z = b + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares) * part
        e = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[rows]) * balance[rows] / len(rows)).astype(np.float32)
        each = np.column_stack([e, sums[:, 1:] * (e * part)[:, None], e * part])
        g = summed(each[by_slot], ends)
        g[:, 1:-1] -= x[:, 1:] * g[:, -1:]
        g = g[:, :-1] * scale[used] + shrink * q
        square[used] += g * g
        pace = rate / np.sqrt(square[used])
        q -= pace * g
        q[:, 0] = np.sign(q[:, 0]) * np.maximum(np.abs(q[:, 0]) - pace[:, 0] * least, 0)
        own[used] = q
        b_square += float(e.sum()) ** 2
        b -= rate[0] * float(e.sum()) / b_square**0.5
    fitted = own * scale
    model = {"terms": np.flatnonzero(of), "w": fitted[:, 0], "v": fitted[:, 1:], "size": (common**2).astype(np.float32), "b": b}
    kept = order[test]
    if not len(kept) or y[kept].min() == y[kept].max():
        kept = order
    many = np.diff(cut)[kept]
    z = margins(np.repeat(np.arange(len(kept)), many), at[np.repeat(cut[kept] - (np.cumsum(many) - many), many) + np.arange(many.sum())], len(kept), model)
    return model | calibrate(z, y[kept], z, y[kept])


def probability(buf: np.ndarray, off: np.ndarray, model: dict) -> np.ndarray:
    n = len(off) - 1
    if not len(model["terms"]):
        return np.zeros(n)
    z = margins(*slots(buf, off), n, model)
    return 1 / (1 + np.exp(-np.clip(model["scale"] * z + model["shift"], -40, 40)))


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^18 weights and vectors

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = probability(*flat(batch["text"]), shared.value)
        return pa.record_batch([batch["doc_id"], batch["held_out"], pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_texts(docs.withColumn("held_out", held_out()), one, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: dict, threshold: float = THRESHOLD, column: str = "text") -> DataFrame:
    """The rows of docs whose score is under the threshold, with all columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(column)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(probability(*flat(batch.column(at)), shared.value) < threshold))

    return map_texts(docs, one, docs.schema, column)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts_of(table(spark, sf_dir, "documents"))
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
