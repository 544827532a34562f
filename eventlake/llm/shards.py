"""Shards of token ids with a minimal perfect hash index.

A shard is two files: `<name>.ids`, the raw little-endian ids of its documents end to end in ascending key order, and
`<name>.mph`, which maps each document key to its slot. A slot holds a fingerprint of the key, the offset and the length,
so that one key costs a hash for each level passed and one read, and a key that is not in the shard is refused but for
one in 2**32. The index also lists the keys, in order.

The hash is built in levels: a key whose place in a level's bit array no other key shares is settled there, the others go
to the next level; a key's slot is the rank of its bit.

Defined results: a null or empty text is the end id alone; a null doc_id is a key of its own, before all others; rows that
share a doc_id are told apart by their order of text; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, parts, shared_path, sliced, table, texts_of, trim
from .encoding import encoder, with_end

MAGIC = b"IDSH0001"
VOCABULARY, END = "word_bpe_49k.json", 2
#: Bytes of ids in a shard, about.
SHARD_BYTES = 64 << 20
GAMMA = 2.0


def opened(path: str, mode: str):
    """A file of the shared folder, by the local mount where it is one and else by Arrow's file systems."""
    if path.startswith("file:") or "://" not in path:
        return open("/" + path.removeprefix("file:").lstrip("/"), mode)
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_output_stream(inner) if "w" in mode else system.open_input_file(inner)


def made_folder(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)


class PerfectHash:
    """levels: the bit arrays; slots: rank over all of them."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ranks, base = [], 0
        for bits in levels:
            ranks.append(base + np.cumsum(bits, dtype=np.int64) - bits)
            base += int(bits.sum())
        self.ranks = ranks

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct 64-bit hashes."""
        levels = []
        while len(keys):
            size = max(1, int(len(keys) * GAMMA))
            place = (mixed(keys, len(levels) + 1) % np.uint64(size)).astype(np.int64)
            single = np.bincount(place, minlength=size) == 1
            levels.append(single)
            keys = keys[~single[place]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 for keys that no level settles."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            place = (mixed(keys[left], k + 1) % np.uint64(len(bits))).astype(np.int64)
            here = bits[place]
            out[left[here]] = self.ranks[k][place[here]]
            left = left[~here]
            if not len(left):
                break
        return out


def key_hash(ids: np.ndarray, null: np.ndarray, nth: np.ndarray) -> np.ndarray:
    return mixed(mixed(ids.astype(np.int64).view(np.uint64)) ^ (nth.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64)), 7)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 99) >> np.uint64(32)).astype(np.uint32)


def nth_of(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """The place of each among its equal neighbours."""
    at = np.arange(len(ids))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    return at - np.maximum.accumulate(np.where(new, at, 0))


class Shard:
    """Reads a shard. get(ids): offsets and lengths; payload(offset, length): the ids."""

    def __init__(self, path: str):
        with opened(path + ".mph", "rb") as f:
            raw = f.read()
        if raw[:8] != MAGIC:
            raise ValueError(f"{path} is not a shard")
        size = int.from_bytes(raw[8:12], "little")
        self.head = json.loads(raw[12 : 12 + size])
        with np.load(io.BytesIO(raw[12 + size :])) as a:
            self.keys, self.null, self._prints, self._starts, self._lengths = (a[k] for k in ("keys", "null", "prints", "starts", "lengths"))
            self._hash = PerfectHash([np.unpackbits(a[f"level{k}"], count=n).astype(bool) for k, n in enumerate(self.head["levels"])])
        self._file = opened(path + ".ids", "rb")

    def get(self, ids: np.ndarray, null: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths are -1 for keys that aren't there."""
        keys = key_hash(ids, null, nth)
        slot = self._hash.slots(keys)
        found = (slot >= 0) & (self._prints[slot] == fingerprint(keys))
        return np.where(found, self._starts[slot], 0), np.where(found, self._lengths[slot], -1)

    def payload(self, start: int, length: int) -> np.ndarray:
        width = np.dtype(self.head["dtype"]).itemsize
        self._file.seek(start * width)
        return np.frombuffer(self._file.read(length * width), self.head["dtype"])


def index_bytes(keys: np.ndarray, null: np.ndarray, lengths: np.ndarray, dtype: str) -> bytes:
    starts = np.cumsum(lengths) - lengths
    hashes = key_hash(keys, null, nth_of(keys, null))
    hashed = PerfectHash.build(hashes)
    slot = hashed.slots(hashes)
    put = lambda v, t: (o := np.zeros(len(keys), t), o.__setitem__(slot, v))[0]
    arrays = {"keys": keys, "null": null, "prints": put(fingerprint(hashes), np.uint32), "starts": put(starts, np.int64), "lengths": put(lengths, np.int64)}
    out = io.BytesIO()
    np.savez(out, **arrays, **{f"level{k}": np.packbits(b) for k, b in enumerate(hashed.levels)})
    head = json.dumps({"dtype": dtype, "documents": len(keys), "levels": [len(b) for b in hashed.levels]}).encode()
    return MAGIC + len(head).to_bytes(4, "little") + head + out.getvalue()


def write_shards(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, dtype: str = "<u2", word_level: bool = True, shard_bytes: int = SHARD_BYTES) -> list[tuple]:
    """Writes the ids of docs (doc_id, text) in ascending doc_id order. Returns for each shard, in order: path, documents,
    ids, and the ids of all shards before it. A task that is tried again writes files of other names; only the names that
    tasks returned are used."""
    spark = docs.sparkSession
    folder = shared_path(spark, "shards")
    made_folder(spark, folder)
    ordered = docs.repartitionByRange(parts(docs), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        from pyspark import TaskContext

        encode, shard, number = encoder(vocabulary, dtype, word_level), None, 0
        width = np.dtype(dtype).itemsize
        for batch in (piece for b in batches for piece in sliced(b, "text", 4 << 20)):
            if shard is None:
                name = f"{folder}/{TaskContext.get().partitionId():06d}-{number:04d}-{uuid.uuid4().hex}"
                shard, ids, null, lengths = opened(name + ".ids", "wb"), [], [], []
            made, off = with_end(*encode.ids(batch["text"]), end)
            shard.write(made.tobytes())
            lengths.append(np.diff(off))
            ids.append(np.asarray(batch["doc_id"].fill_null(0)))
            null.append(np.asarray(batch["doc_id"].is_null()))
            if sum(int(n.sum()) for n in lengths) * width >= shard_bytes:
                yield finished(name, shard, ids, null, lengths, number)
                shard, number = None, number + 1
        if shard is not None:
            yield finished(name, shard, ids, null, lengths, number)
        trim()

    def finished(name, shard, ids, null, lengths, number):
        from pyspark import TaskContext

        shard.close()
        ids, null, lengths = map(np.concatenate, (ids, null, lengths))
        with opened(name + ".mph", "wb") as f:
            f.write(index_bytes(ids, null, lengths, dtype))
        return pa.record_batch([[name], [TaskContext.get().partitionId()], [number], [len(ids)], [int(lengths.sum())]], ["path", "part", "number", "documents", "ids"])

    rows = sorted(ordered.mapInArrow(run, "path string, part long, number long, documents long, ids long").collect(), key=lambda r: (r["part"], r["number"]))  # a row for each shard
    out, before = [], 0
    for r in rows:
        out.append((r["path"], r["documents"], r["ids"], before))
        before += r["ids"]
    return out


def read_shards(spark: SparkSession, shards: list[tuple]) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers)."""
    listed = spark.createDataFrame(shards, "path string, documents long, ids long, before long").repartition(max(1, len(shards)))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                shard = Shard(r["path"])
                nth = nth_of(shard.keys, shard.null)
                for at in range(0, len(shard.keys), 20_000):
                    ids, null = shard.keys[at : at + 20_000], shard.null[at : at + 20_000]
                    start, length = shard.get(ids, null, nth[at : at + 20_000])
                    if (length < 0).any():
                        raise ValueError(f"{r['path']} misses keys of its own")
                    sums = [zlib.crc32(shard.payload(s, n).astype("<u4").tobytes()) for s, n in zip(start.tolist(), length.tolist(), strict=True)]
                    yield pa.record_batch([pa.array(ids, mask=null), pa.array(start + r["before"]), pa.array(length), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(spark, write_shards(texts_of(table(spark, sf_dir, "documents"))))
