"""Live subscriptions: a streaming source whose offset is the committed position, and filters over it."""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..plans.criteria import Condition
from ..schema import EVENT

#: EVENT in Arrow's terms.
_ARROW = pa.schema([("position", pa.int64()), ("identifier", pa.string()), ("name", pa.string()), ("version", pa.string()), ("timestamp", pa.int64()), ("payload", pa.binary()), ("metadata", pa.map_(pa.string(), pa.string())), ("tags", pa.list_(pa.struct([("key", pa.binary()), ("value", pa.binary())]))), ("context", pa.string())])


class _Range(InputPartition):
    def __init__(self, path: str, after: int, to: int):
        self.path, self.after, self.to = path, after, to


def _system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"))


class PositionReader(DataSourceStreamReader):
    """Offsets are positions: a batch is what manifests after one and up to another hold, a partition for each data file."""

    def __init__(self, options):
        self.path, self.start = options["path"].rstrip("/"), int(options.get("start", 1))

    def _manifests(self) -> list[dict]:
        """All in order, from the last list of them and those since."""
        system, folder = _system(f"{self.path}/manifests")
        names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(folder)))
        lists = [n for n in names if n.endswith(".list")]

        def read(name: str):
            with system.open_input_file(f"{folder}/{name}") as f:
                return json.loads(f.read())

        return (read(lists[-1]) if lists else []) + [read(n) for n in names if n.endswith(".json") and (not lists or n[:20] > lists[-1][:20])]

    def initialOffset(self) -> dict:
        return {"position": self.start - 1}

    def latestOffset(self) -> dict:
        found = self._manifests()
        return {"position": max(self.start - 1, found[-1]["last"] if found else 0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = start["position"], end["position"]
        out = []
        for m in self._manifests():
            if m["data"] and m["last"] > a and m["first"] <= b:
                system, folder = _system(m["data"])
                out += [_Range(f"{m['data']}/{f.base_name}", a, b) for f in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda f: f.base_name) if f.base_name.endswith(".parquet")]
        return out

    def read(self, part: _Range):
        system, path = _system(part.path)
        found = pq.read_table(path, filesystem=system, partitioning=None, filters=[("position", ">", part.after), ("position", "<=", part.to)])
        yield from found.sort_by("position").cast(_ARROW).to_batches(max_chunksize=4096)

    def commit(self, end: dict) -> None:
        pass


class PositionSource(DataSource):
    """format("eventlake"), option path: a context's folder, option start: the first position (1)."""

    @classmethod
    def name(cls) -> str:
        return "eventlake"

    def schema(self) -> str:
        return EVENT

    def streamReader(self, schema) -> PositionReader:
        return PositionReader(self.options)


def subscribe(spark: SparkSession, path: str, condition: Condition, start: int = 1) -> DataFrame:
    """History from `start`, then what is appended: the query's checkpoint is the cursor."""
    spark.dataSource.register(PositionSource)
    return spark.readStream.format("eventlake").option("path", path).option("start", str(start)).load().where(condition.column())


def follow_files(spark: SparkSession, path: str, schema, condition: Condition | None = None) -> DataFrame:
    """A stream over Parquet files of a log as they come."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows if condition is None else rows.where(condition.column())
