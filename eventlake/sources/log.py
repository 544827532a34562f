"""A durable event log on any Hadoop file system.

Data files are written first; then a manifest with the batch's files, positions and number is created under a name that
must not exist. Readers list manifests, so a batch is there whole or not at all, and the last manifest's position is what
is committed. An append that loses the race for a number checks its condition again and retries; if the winner died before
its manifest was in place, the loser puts it there. Every CHECKPOINT manifests one file lists all so far.
"""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dcb, postings, reads
from ..plans.criteria import Condition
from ..schema import EVENT, SEGMENT
from .shared import numbered

#: Manifests from one list of them to the next, and seconds after which a lock that names nothing is given up.
CHECKPOINT, GRACE = 100, 60
CONTEXT = re.compile(r"[A-Za-z0-9_-]{1,128}")


class ContextError(ValueError):
    """A context that is unknown, taken, or badly named."""


class ContextNotFound(ContextError):
    pass


class ContextExists(ContextError):
    pass


class InvalidContextName(ContextError):
    pass


class ConsistencyConditionViolated(Exception):
    def __init__(self, position: int):
        super().__init__(f"an event at position {position} conflicts with the append")
        self.conflicting_position = position


@dataclass(frozen=True)
class Appended:
    first_position: int
    count: int
    consistency_marker: int


def valid_context(name: str) -> bool:
    return CONTEXT.fullmatch(name) is not None


class Store:
    """Contexts under a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def create(self, name: str = "default") -> EventLog:
        if not valid_context(name):
            raise InvalidContextName(f"not a context name: {name!r}")
        if self.exists(name):
            raise ContextExists(f"{name} exists")
        self._fs.mkdirs(self._path(f"{self.root}/{name}/manifests"))
        return self.open(name)

    def exists(self, name: str) -> bool:
        return valid_context(name) and self._fs.exists(self._path(f"{self.root}/{name}/manifests"))

    def open(self, name: str = "default") -> EventLog:
        if not self.exists(name):
            raise ContextNotFound(f"no context {name}")
        return EventLog(self.spark, f"{self.root}/{name}", name)

    def names(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root)) if f.isDirectory()]
        return sorted(n for n in found if self.exists(n))


class EventLog:
    def __init__(self, spark: SparkSession, path: str, context: str):
        self.spark, self.path, self.context = spark, path, context
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._jpath(f"{self.path}/manifests")))

    def manifests(self) -> list[dict]:
        """All in order, from the last list of them and those since."""
        names = self._names()
        lists = [n for n in names if n.endswith(".list")]
        found = json.loads(self._read(f"{self.path}/manifests/{lists[-1]}")) if lists else []
        return found + [json.loads(self._read(f"{self.path}/manifests/{n}")) for n in names if n.endswith(".json") and (not lists or n[:20] > lists[-1][:20])]

    def last(self) -> tuple[int, int]:
        """Number and position of the last manifest; reads that one alone."""
        names = [n for n in self._names() if n.endswith(".json")]
        return (int(names[-1][:20]), json.loads(self._read(f"{self.path}/manifests/{names[-1]}"))["last"]) if names else (0, 0)

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._jpath(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def committed(self) -> int:
        return self.last()[1]

    def read(self, committed: int | None = None) -> DataFrame:
        """All committed events, or those up to a position that was committed."""
        found = [m for m in self.manifests() if m["data"] and (committed is None or m["first"] <= committed)]
        rows = self.spark.read.schema(EVENT).parquet(*[m["data"] for m in found]) if found else self.spark.createDataFrame([], EVENT)
        return rows if committed is None else rows.where(F.col("position") <= committed)

    def source(self, condition: Condition, start: int = 1) -> tuple[DataFrame, int]:
        """Matching events and the marker: the position that was committed when the read began."""
        marker = self.committed()
        return reads.source(self.read(marker), condition, start, marker), marker

    def seal(self, size: int = SEGMENT) -> int:
        """Writes the postings of full segments that have none yet; returns how many segments there were. Run by one job at a
        time, as a compaction."""
        full, log = self.committed() // size, self.read()
        have = self._sealed()
        new = postings.build(log.where(F.col("position") <= full * size) if have is None else postings.unindexed(log.where(F.col("position") <= full * size), have, size), size)
        sealed = new.select("segment").distinct().count()
        if sealed:
            postings.write(new, f"{self.path}/postings", mode="append")
        return sealed

    def _sealed(self) -> DataFrame | None:
        return postings.read(self.spark, f"{self.path}/postings") if self._fs.exists(self._jpath(f"{self.path}/postings")) else None

    def postings(self, size: int = SEGMENT) -> DataFrame:
        """The stored postings, and those of segments that aren't sealed, from the events."""
        have, log = self._sealed(), self.read()
        return postings.build(log, size) if have is None else have.unionByName(postings.build(postings.unindexed(log, have, size), size))

    def head(self) -> int:
        return self.committed() + 1

    def tail(self) -> int:
        return 1 if self.committed() else self.head()

    def append(self, events: DataFrame, condition: Condition | None = None, marker: int = 0, order: list[str] | None = None, retries: int = 20, batch: str | None = None) -> Appended:
        """Appends events (identifier, name, version, timestamp, payload, metadata, tags) in `order`, default: a column
        `seq`. With a condition, only if no event past the marker matches it; a negative marker never conflicts. A batch
        name that was appended before is not appended again."""
        columns = [c.split(" ")[0] for c in EVENT.split(", ")]
        for _ in range(retries):
            if batch is not None and (old := next((m for m in self.manifests() if m.get("batch") == batch), None)):
                return Appended(old["first"], old["last"] - old["first"] + 1, old["last"])
            number, committed = self.last()
            if condition is not None and marker >= 0 and (at := dcb.conflict(self.read(committed), condition, marker)) is not None:
                raise ConsistencyConditionViolated(at)
            number += 1
            data = f"{self.path}/data/{number:020d}-{self.spark._jvm.java.util.UUID.randomUUID().toString()}"
            rows = numbered(events, order or ["seq"], start=committed + 1).withColumn("context", F.lit(self.context))
            rows.select(*columns).write.parquet(data)
            n = self.spark.read.parquet(data).count()  # what is written, not what the events would be if evaluated again
            if not n:
                self._fs.delete(self._jpath(data), True)
                return Appended(committed + 1, 0, committed)
            if self._publish(number, {"first": committed + 1, "last": committed + n, "data": data} | ({"batch": batch} if batch else {})):
                return Appended(committed + 1, n, committed + n)
        raise RuntimeError("too many appends at once")

    def _write(self, name: str, text: str) -> bool:
        """False if there is a file of that name."""
        try:
            out = self._fs.create(self._jpath(name), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception) or self._fs.exists(self._jpath(name)):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _publish(self, number: int, manifest: dict) -> bool:
        """Creates the manifest; False if another has its number. It is written under a name of its own first; who creates
        the lock, which says where it is, owns the number, and whoever finds a lock without a manifest renames it there."""
        own = f"{self.path}/pending/{number:020d}-{self.spark._jvm.java.util.UUID.randomUUID().toString()}"
        self._write(own, json.dumps(manifest))
        if not self._write(f"{self.path}/locks/{number:020d}", own):
            self._fs.delete(self._jpath(own), False)
            self._settle(number)
            return False
        self._settle(number)
        return True

    def _settle(self, number: int) -> None:
        """Puts the manifest in place that the number's lock names. A lock that names none was left by a writer that died in
        the act; after GRACE seconds an empty manifest takes its number."""
        at, lock = f"{self.path}/manifests/{number:020d}.json", f"{self.path}/locks/{number:020d}"
        for _ in range(GRACE * 2):
            if self._fs.exists(self._jpath(at)):
                break
            pending = self._read(lock)
            if pending:
                if self._fs.exists(self._jpath(pending)):
                    self._fs.rename(self._jpath(pending), self._jpath(at))
                continue
            if time.time() - self._fs.getFileStatus(self._jpath(lock)).getModificationTime() / 1000 > GRACE:
                committed = self.last()[1]
                self._write(at, json.dumps({"first": committed + 1, "last": committed, "data": None}))
                break
            time.sleep(0.5)
        if number % CHECKPOINT == 0:
            listed, own = f"{self.path}/manifests/{number:020d}.list", f"{self.path}/pending/{self.spark._jvm.java.util.UUID.randomUUID().toString()}"
            if not self._fs.exists(self._jpath(listed)):
                self._write(own, json.dumps(self.manifests()[:number]))
                self._fs.rename(self._jpath(own), self._jpath(listed))

    def orphans(self) -> list[str]:
        """Data of appends that were never published."""
        base = self._jpath(f"{self.path}/data")
        known = {m["data"].rsplit("/", 1)[-1] for m in self.manifests() if m["data"]}
        return sorted(f.getPath().toString() for f in self._fs.listStatus(base) if f.getPath().getName() not in known) if self._fs.exists(base) else []
