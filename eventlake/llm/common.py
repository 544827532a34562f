"""Shared pieces of the text operators: the shared folder, Arrow batches of bounded size, and vectorised
word and hash arithmetic over UTF-8 buffers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one call of a batch function gets at most, unless a single text is longer.
BATCH_BYTES = 1 << 19

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []
_LIBC = ctypes.CDLL(None)
#: What empties the tables that an operator keeps in a worker, for the next operator to call.
caches: list[Callable] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not jdir.isDefined():
            if spark.sparkContext.master.partition("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir is not set: driver and executors share no folder")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="eventlake-"))
            jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get()
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def discarded(*frames: DataFrame | None) -> None:
    """Deletes tables that `written` made, when nothing reads them any more."""
    for df in frames:
        if df is not None:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner take the shuffle files of frames that nothing refers to any more, which it learns of from the
    collectors of Python and the JVM alone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def input_bytes(df: DataFrame) -> int:
    """What df reads by Catalyst's estimates: file sizes for scans. Where it has none, 16 MB for each partition."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    size = min(int(plan.stats().sizeInBytes()), sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())))
    return size if size < 1 << 58 else df.rdd.getNumPartitions() << 24


def parts(df: DataFrame, each: int = 32 << 20) -> int:
    """Partitions for a shuffle of what df reads, of about `each` bytes; never below the session's own number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(200_000, -(-input_bytes(df) // each)))


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so that other columns can't clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forget() -> None:
    """Empties what other operators keep in this worker."""
    for clear in caches:
        clear()
    trim()


def steady() -> None:
    """From now on glibc gives arrays of a megabyte back when they are freed, which costs page faults."""
    if hasattr(_LIBC, "mallopt"):
        _LIBC.mallopt(-3, 1 << 20)


def trim() -> None:
    """Gives what is free back to the system: workers stay after a task, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def map_texts(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator], schema: str, column: str = "text", limit: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow in slices whose `column` holds at most `limit` bytes, so memory does not follow the session's batch size."""

    def run(batches):
        forget()
        for batch in batches:
            for piece in sliced(batch, column, limit):
                made = work(piece)
                if isinstance(made, pa.RecordBatch):
                    yield made
                else:
                    yield from made
        trim()

    return df.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column end to end, and the offsets of its rows (nulls are empty)."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    off = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if ends else np.zeros(len(column) + 1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z."""
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def white(buf: np.ndarray) -> np.ndarray:
    return _WHITE[buf]


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of `inside` that do not cross rows: starts, ends, rows."""
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes outside [\\x20\\x09-\\x0D]: starts, ends, rows."""
    return spans(~_WHITE[buf], off)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 19), x, np.uint64)])) for x in (_ODD, _ODD_INVERSE)]
    return _powers[0], _powers[1]


class Hashes:
    """64-bit polynomial hashes of any byte ranges of a buffer, from one prefix sum. Ranges can be made that share one: these
    are for features and for choosing places, `hashed` is for telling what is equal."""

    def __init__(self, buf: np.ndarray):
        up, self._down = _power(len(buf) + 1)
        self._sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))


_BELOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the low n bytes


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of buf on, as one little-endian number; zeros follow the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def hashed(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges, each as the sum of its blocks of eight bytes, mixed with their number."""
    words_, size = eights(buf), ends - starts
    out = mixed(words_[starts] & _BELOW[np.minimum(size, 8)], 2 * salt + 1)
    long_ = np.flatnonzero(size > 8)
    if len(long_):
        blocks = (size[long_] - 1) // 8
        first = np.cumsum(blocks) - blocks
        nth = np.arange(int(blocks.sum())) - np.repeat(first, blocks) + 1
        at = np.repeat(starts[long_], blocks) + 8 * nth
        value = words_[at] & _BELOW[np.minimum(np.repeat(ends[long_], blocks) - at, 8)]
        out[long_] += np.add.reduceat(mixed(value ^ mixed(nth.astype(np.uint64), 5), 2 * salt + 1), first)
    return mixed(out + size.astype(np.uint64), 2 * salt + 2)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x.astype(np.uint64) + np.uint64((salt * 2 + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chained(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of several in order."""
    out = mixed(hashes[0])
    for h in hashes[1:]:
        out = mixed(out * np.uint64(0xFF51AFD7ED558CCD) + h)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ids_unique(df: DataFrame) -> bool:
    return not df.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()


def unique_ids(df: DataFrame) -> DataFrame:
    """df (doc_id, text) with a long `uid` that is unique and ascends with doc_id. Where doc_ids are unique, uid is doc_id.
    Otherwise rows are ranked by doc_id (null first), then text; rows alike in both share one uid."""
    if ids_unique(df):
        return df.withColumn("uid", F.col("doc_id"))
    keys = df.select("doc_id", F.sha2("text", 256).alias("mark")).distinct()
    keys = written(keys.repartitionByRange(parts(df), F.col("doc_id").asc_nulls_first(), "mark").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "mark").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "uids")
    sizes = sorted((r["part"], r["n"]) for r in keys.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each partition
    base, starts = 0, []
    for part, n in sizes:
        starts.append((part, base))
        base += n
    starts = df.sparkSession.createDataFrame(starts or [(0, 0)], "part int, base long")
    keys = keys.join(F.broadcast(starts), "part").select(F.col("doc_id").alias("key"), "mark", (F.col("base") + F.col("row")).alias("uid"))
    marked = df.withColumn("mark", F.sha2("text", 256))
    return marked.join(keys, marked["doc_id"].eqNullSafe(keys["key"]) & (marked["mark"] == keys["mark"])).select(marked["doc_id"], "text", "uid")
