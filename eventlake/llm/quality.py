"""Quality rules: exact repetition and length rules, then a hashed word and character n-gram logistic regression.

The regression is trained on labelled quality rows, its probability calibrated on rows kept out of the fit, and scored in
Arrow batches against a fixed threshold.

Defined results: a null or empty text has no words and fails the rules; null doc_ids and repeated rows are scored like
others; an empty table gives no rows; other columns are ignored; labels that are null are not learned from; without
labels of both kinds the regression keeps everything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Hashes, chained, flat, map_texts, mixed, table, texts_of, white, words

DIMENSIONS = 1 << 15
#: Labelled rows the regression is fitted on, at most (the bound of the sample).
FIT_ROWS = 8_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Documents with a lower calibrated probability of good quality go.
THRESHOLD = 0.5
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def coded(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each byte range; equal bytes and only they have equal numbers."""
    size = ends - starts
    off = np.concatenate([[0], np.cumsum(size)])
    data = buf[np.repeat(starts - off[:-1], size) + np.arange(off[-1])]
    held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(data)])
    return np.asarray(held.dictionary_encode().indices).astype(np.int64)


def repeated(*keys: np.ndarray) -> np.ndarray:
    """Which places have keys that occur at several places. Groups are made by hashes and then compared."""
    if not len(keys[0]):
        return np.zeros(0, bool)
    _, first, where, n = np.unique(chained([k.astype(np.uint64) for k in keys]), return_index=True, return_inverse=True, return_counts=True)
    if not all((k == k[first[where]]).all() for k in keys):  # two share a hash
        _, where, n = np.unique(np.stack(keys), axis=1, return_inverse=True, return_counts=True)
    return n[where.ravel()] > 1


def counts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of every text of a batch."""
    n = len(off) - 1
    per = lambda rows, w=None: np.bincount(rows, w, minlength=n).astype(np.int64)
    start, end, row = words(buf, off)
    letters = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    out = {"n_words": per(row), "word_chars": per(row, letters[end] - letters[start])}
    marks = np.concatenate([[0], np.cumsum(_SYMBOLS[buf])])
    out["n_symbols"] = marks[off[1:]] - marks[off[:-1]]
    lines = np.sort(np.concatenate([off[:-1], np.flatnonzero(buf == 10) + 1]))  # of each line: its start; a break at a text's end starts an empty one
    line_row = np.searchsorted(off, lines, side="right") - 1
    stop = np.minimum(np.append(lines[1:], len(buf)), off[np.minimum(line_row + 1, n)])
    stop = np.where((stop > lines) & (buf[np.maximum(stop - 1, 0)] == 10), stop - 1, stop) if len(buf) else stop
    inside = np.concatenate([[0], np.cumsum(~white(buf))])
    full = (inside[stop] > inside[lines]) & (line_row < n)
    lines, stop, line_row = lines[full], stop[full], line_row[full]
    first = np.zeros(len(lines), bool)
    first[np.unique(coded(buf, lines, stop) * n + line_row, return_index=True)[1]] = True
    out["n_dup_lines"] = per(line_row[~first])
    twice = np.zeros(len(row), bool)
    if len(row) > 2:
        word = coded(buf, start, end)
        at = np.flatnonzero(row[:-2] == row[2:])
        again = at[repeated(row[at], word[at], word[at + 1], word[at + 2])]
        for k in range(3):
            twice[again + k] = True
    out["n_repeat_words"] = per(row[twice])
    return out


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed feature) of every word, word pair and run of three characters' bytes."""
    hashes, mask = Hashes(buf), np.uint64(DIMENSIONS - 1)
    start, end, row = words(buf, off)
    word = hashes.of(start, end)
    pair = np.flatnonzero(row[:-1] == row[1:])
    chars = np.zeros(0, np.uint64)
    char_row = np.zeros(0, np.int64)
    if len(buf) > 2:
        wide = buf.astype(np.uint32)
        gram = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
        gram = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - (DIMENSIONS // 2).bit_length() + 1)
        char_row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:-2]
        inner = np.ones(len(gram), bool)
        cut = off[1:-1]
        for k in (1, 2):
            inner[(cut - k)[(cut >= k) & (cut - k < len(gram))]] = False
        chars, char_row = gram[inner], char_row[inner]
    half = np.uint64(DIMENSIONS // 2 - 1)
    ids = np.concatenate([(word & half) + np.uint64(DIMENSIONS // 2), (chained([word[pair], word[pair + 1]]) & half) + np.uint64(DIMENSIONS // 2), chars.astype(np.uint64)]) & mask
    return np.concatenate([row, row[pair], char_row]), ids.astype(np.int64)


def averaged(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, value, minlength=n) / np.maximum(np.bincount(row, minlength=n), 1)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict:
    """Weights, bias and calibration from at most `rows` labelled documents, those of the smallest hashes. The rows of the
    sample are broadcast; a fifth of them, by hash, is kept out of the fit and calibrates it."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("key"), F.col("quality").cast("int").alias("y")).dropna().dropDuplicates(["key"]).orderBy(F.xxhash64("key"), "key").limit(rows)
    joined = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["key"]).select("doc_id", "text", "y")

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, ids = features(*flat(batch["text"]))
        key, n = np.unique(row * DIMENSIONS + ids, return_counts=True)
        of = key // DIMENSIONS
        share = np.sqrt(n / np.bincount(of, n, minlength=batch.num_rows)[of])  # square roots of shares: unit vectors
        cut = np.searchsorted(of, np.arange(batch.num_rows + 1))
        lists = lambda v, t: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v, t))
        return pa.record_batch([batch["doc_id"], batch["y"], lists((key % DIMENSIONS).astype(np.int16), pa.int16()), lists(share.astype(np.float32), pa.float32())], ["doc_id", "y", "ids", "share"])

    found = map_texts(joined, vectors, "doc_id long, y int, ids array<short>, share array<float>").toArrow()  # at most `rows` rows
    model = {"w": np.zeros(DIMENSIONS), "b": 0.0, "scale": 0.0, "shift": 10.0}
    y, doc_id = found["y"].to_numpy().astype(np.float64), found["doc_id"].to_numpy()
    if not len(y) or y.min() == y.max():
        return model
    blocks, before = [], 0  # (first row, rows, row of each value, feature, value), so that no array is as long as the sample
    for ids, share in zip(found["ids"].chunks, found["share"].chunks, strict=True):
        blocks.append((before, len(ids), np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(np.asarray(ids.offsets))), np.asarray(ids.flatten()), np.asarray(share.flatten())))
        before += len(ids)

    def margins(w, b):
        return np.concatenate([np.bincount(row, x * w[ids], minlength=n) for _, n, row, ids, x in blocks]) + b

    test = mixed(doc_id.view(np.uint64), 31) % np.uint64(5) == 4
    test = np.zeros(len(y), bool) if len(y) < 50 else test
    w, b, grad2 = np.zeros(DIMENSIONS), 0.0, np.full(DIMENSIONS, 1e-4)
    b2, balance = 1e-4, np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) * ~test / max(1, (~test).sum())
    for _ in range(80):
        e = (1 / (1 + np.exp(-np.clip(margins(w, b), -40, 40))) - y) * balance
        g = 1e-6 * w
        for at, n, row, ids, x in blocks:
            g += np.bincount(ids, e[at : at + n][row] * x, minlength=DIMENSIONS)
        grad2 += g * g
        b2 += e.sum() ** 2
        w -= 1.0 * g / np.sqrt(grad2)
        b -= 0.5 * e.sum() / np.sqrt(b2)
    z = margins(w, b)
    return {"w": w, "b": b} | calibrate(z[test], y[test], z, y)


def calibrate(z, y, every_z, every_y) -> dict:
    """Platt's sigmoid over held-out margins, by Newton steps; over all rows where the held-out ones are of one kind."""
    if not len(y) or y.min() == y.max():
        z, y = every_z, every_y
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    m, s = z.mean(), z.std() or 1.0
    u, theta = (z - m) / s, np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(theta[0] * u + theta[1], -40, 40)))
        g = np.array([((p - target) * u).sum(), (p - target).sum()]) + 1e-3 * theta
        v = p * (1 - p)
        h = np.array([[(v * u * u).sum(), (v * u).sum()], [(v * u).sum(), v.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        theta = theta - np.clip(step, -2, 2)
    return {"scale": theta[0] / s, "shift": theta[1] - theta[0] * m / s}


def probability(buf: np.ndarray, off: np.ndarray, model: dict) -> np.ndarray:
    row, ids = features(buf, off)
    n = len(off) - 1
    key, times = np.unique(row * DIMENSIONS + ids, return_counts=True)
    of = key // DIMENSIONS
    share = np.sqrt(times / np.maximum(np.bincount(of, times, minlength=n), 1)[of])
    z = np.bincount(of, share * model["w"][key % DIMENSIONS], minlength=n) + model["b"]
    return 1 / (1 + np.exp(-np.clip(model["scale"] * z + model["shift"], -40, 40)))


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """Per document the base counts, base_failed, kept and the probability of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS numbers

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, off = flat(batch["text"])
        c = counts(buf, off)
        failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
        p = probability(buf, off, shared.value)
        return pa.record_batch([batch["doc_id"], *(pa.array(v, pa.int64()) for v in c.values()), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)], ["doc_id", *c, "base_failed", "kept", "probability"])

    return map_texts(docs, one, f"{COUNTS}, base_failed boolean, kept boolean, probability double")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts_of(table(spark, sf_dir, "documents"))
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
