"""A Spark data source of framed messages: ``spark.read.format("ledger_frames")`` and ``readStream``.

Files of a folder hold frames as peers send them: magic, a 12-byte command, the
payload's length and checksum, the payload. Rows are (file, position, command,
payload). A batch read has a partition for each file, as a mark within a payload
is only told by what stands before it; of a file no more is held than one
message and what is read at a time. A stream's offset is the
last file name of the sorted listing, so files are to be added in that order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .wire import frames_in

SCHEMA = "file string, position int, command string, payload binary"
#: The main network's mark (a fixed value).
MAGIC = "f9beb4d9"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _listed(uri: str) -> list[str]:
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    return sorted(x.path for x in fs.get_file_info(pafs.FileSelector(path)) if x.is_file and not x.base_name.startswith((".", "_")))


class _Reader:
    def __init__(self, options: dict):
        self.uri, self.magic = options["path"], bytes.fromhex(options.get("magic", MAGIC))

    def rows(self, path: str) -> Iterator[tuple]:
        fs, _ = pafs.FileSystem.from_uri(self.uri if "://" in self.uri else f"file://{self.uri}")
        with fs.open_input_file(path) as f:
            for i, (command, payload) in enumerate(frames_in(f.read, self.magic)):
                yield path.rsplit("/", 1)[-1], i, command, payload


class _BatchReader(_Reader, DataSourceReader):
    def partitions(self):
        return [_File(p) for p in _listed(self.uri)]

    def read(self, partition):
        return self.rows(partition.path)


class _StreamReader(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        found = _listed(self.uri)
        return {"after": found[-1] if found else ""}

    def partitions(self, start: dict, end: dict):
        return [_File(p) for p in _listed(self.uri) if start["after"] < p <= end["after"]]

    def read(self, partition):
        return self.rows(partition.path)


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledger_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _BatchReader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)
