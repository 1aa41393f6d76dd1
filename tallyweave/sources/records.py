"""A Spark data source of files of records of one size: ``spark.read.format("ledger_records")``.

Such files are appended to, a record at a time, and a crash may leave part of a
record at the end; that tail is no record. Rows are (file, position, record). A
partition reads a range of whole records, so a large file is many partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a record (a hash) and of what a partition reads, about.
SIZE, RANGE_BYTES = 32, 64 << 20


class _Range(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        uri = options["path"]
        self.uri, self.size = uri if "://" in uri else f"file://{uri}", int(options.get("size", SIZE))
        self.records = max(1, int(options.get("rangeBytes", RANGE_BYTES)) // self.size)

    def partitions(self):
        fs, path = pafs.FileSystem.from_uri(self.uri)
        info = fs.get_file_info(path)
        files = [info] if info.is_file else [x for x in fs.get_file_info(pafs.FileSelector(path)) if x.is_file and not x.base_name.startswith((".", "_"))]
        ranges = [(f.path, at, min(f.size // self.size, at + self.records)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size // self.size, self.records)]
        return [_Range(*r) for r in ranges] or [_Range("", 0, 0)]

    def read(self, partition) -> Iterator[tuple]:
        if partition.first == partition.end:
            return
        fs, _ = pafs.FileSystem.from_uri(self.uri)
        name, at = partition.path.rsplit("/", 1)[-1], partition.first
        with fs.open_input_file(partition.path) as f:
            f.seek(at * self.size)
            while at < partition.end:
                data = f.read(min(4096, partition.end - at) * self.size)
                for i in range(0, len(data), self.size):
                    yield name, at, data[i : i + self.size]
                    at += 1


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledger_records"

    def schema(self) -> str:
        return "file string, position long, record binary"

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSource)
