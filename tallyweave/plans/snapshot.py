"""Consistent snapshots of several tables, published by manifests.

A commit writes its data in new folders and then a manifest, whole or not at
all, that names every table's folders; readers take the newest manifest and so
never see half a commit. What a crash leaves has no manifest and is ignored.
Going back publishes a manifest with a bound on the height; data is removed
only by ``vacuum``, and ``compact`` writes a table's many parts as one.

A version is published by one writer: its manifest is created only if there is
none. Who comes second puts its rows on top of what was published meanwhile, or
fails with ``Conflict`` if it was to be on top of a certain version.
"""

from __future__ import annotations

import json
import os
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer published the version first."""


class Snapshots:
    """Tables under a folder that driver and executors share (a path or URI)."""

    def __init__(self, spark: SparkSession, root: str, height: str = "height"):
        self.spark, self.height = spark, height
        self.root = root if "://" in root else f"file://{os.path.abspath(root)}"
        self.fs, self.path = pafs.FileSystem.from_uri(self.root)
        self.fs.create_dir(f"{self.path}/manifests", recursive=True)

    def versions(self) -> list[int]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.path}/manifests"))
        return sorted(int(x.base_name[:-5]) for x in found if x.base_name.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the newest by default; an empty one before the first commit."""
        found = self.versions()
        if not found and version is None:
            return {"version": 0, "tables": {}, "batches": [], "streams": {}, "facts": {}}
        with self.fs.open_input_file(f"{self.path}/manifests/{version or found[-1]:010d}.json") as f:
            return json.loads(f.read())

    def _publish(self, manifest: dict) -> bool:
        """Publish a manifest as its version; False if that is there already."""
        own, to = f"{self.path}/manifests/.{uuid.uuid4().hex}", f"{self.path}/manifests/{manifest['version']:010d}.json"
        with self.fs.open_output_stream(own) as f:
            f.write(json.dumps(manifest).encode())
        if isinstance(self.fs, pafs.LocalFileSystem):
            try:
                os.link(own, to)  # fails where the name is taken
            except FileExistsError:
                return False
            finally:
                os.unlink(own)
            return True
        jvm = self.spark._jvm
        path = lambda x: jvm.org.apache.hadoop.fs.Path(self.root[: -len(self.path)] + x)
        hadoop = path(own).getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = not hadoop.exists(path(to)) and hadoop.rename(path(own), path(to))  # HDFS renames to a new name only
        if not done:
            self.fs.delete_file(own)
        return done

    def _seen(self, manifest: dict, batch: str | tuple[str, int] | None) -> bool:
        if isinstance(batch, tuple):
            return batch[1] <= manifest["streams"].get(batch[0], -1)
        return batch is not None and batch in manifest["batches"]

    def commit(self, tables: dict[str, DataFrame], batch: str | tuple[str, int] | None = None, facts: dict | None = None, replace_above: int | None = None, overwrite: tuple[str, ...] = (), expect: int | None = None) -> int:
        """Append rows to tables and publish all together; return the version.

        batch: what is committed once, and a second time does nothing: a name, or
        (stream, number) with numbers that ascend, of which only the last is kept.
        facts: values to keep beside the tables. replace_above: rows already
        there above this height are out (a reorganisation). overwrite: tables whose
        earlier rows are out. expect: the version that this is to follow.
        """
        now = self.manifest()
        if self._seen(now, batch):
            return now["version"]
        written = {}
        for name, rows in tables.items():
            written[name] = f"data/{name}/{uuid.uuid4().hex}"
            rows.write.option("compression", "zstd").parquet(f"{self.root}/{written[name]}")
        schemas = {name: rows.schema.jsonValue() for name, rows in tables.items()}
        while True:
            now = self.manifest()
            if self._seen(now, batch):  # by another writer, while this one wrote
                return now["version"]
            if expect is not None and now["version"] != expect:
                raise Conflict(f"version {expect} was to be followed, but there is version {now['version']}")
            if replace_above is not None:
                for entry in now["tables"].values():
                    entry["parts"] = [p | {"most": replace_above if p["most"] is None else min(p["most"], replace_above)} for p in entry["parts"]]
            for name, folder in written.items():
                entry = now["tables"].setdefault(name, {"schema": schemas[name], "parts": []})
                if name in overwrite:
                    entry["parts"] = []
                entry["parts"].append({"folder": folder, "most": None})
            if isinstance(batch, tuple):
                now["streams"][batch[0]] = batch[1]
            elif batch is not None:
                now["batches"].append(batch)
            now["facts"] |= facts or {}
            now["version"] += 1
            if self._publish(now):
                return now["version"]

    def compact(self, table: str, most_parts: int = 1) -> int:
        """Write a table's parts as one if there are more than so many; return the version. Conflict if another writer was faster."""
        now = self.manifest()
        entry = now["tables"].get(table)
        if entry is None or len(entry["parts"]) <= most_parts:
            return now["version"]
        return self.commit({table: self.read(table, now["version"])}, overwrite=(table,), expect=now["version"])

    def truncate(self, height: int, facts: dict | None = None) -> int:
        """Publish a version without rows above height."""
        return self.commit({}, replace_above=height, facts=facts)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        entry = self.manifest(version)["tables"].get(table)
        if entry is None:
            raise KeyError(f"no table {table}")
        schema = StructType.fromJson(entry["schema"])
        by_bound: dict[int | None, list[str]] = {}
        for p in entry["parts"]:
            by_bound.setdefault(p["most"], []).append(f"{self.root}/{p['folder']}")
        out = self.spark.createDataFrame([], schema)
        for most, folders in by_bound.items():
            rows = self.spark.read.schema(schema).parquet(*folders)
            out = out.unionByName(rows if most is None else rows.where(F.col(self.height) <= most))
        return out

    def vacuum(self, keep: int = 1) -> int:
        """Remove manifests but the newest ones, and data that none of those names; return how many folders went."""
        old = self.versions()[:-keep]
        for v in old:
            self.fs.delete_file(f"{self.path}/manifests/{v:010d}.json")
        named = {p["folder"] for v in self.versions() for t in self.manifest(v)["tables"].values() for p in t["parts"]}
        gone = 0
        tables = self.fs.get_file_info(pafs.FileSelector(f"{self.path}/data", allow_not_found=True))
        for table in tables:
            for part in self.fs.get_file_info(pafs.FileSelector(table.path)):
                if f"data/{table.base_name}/{part.base_name}" not in named:
                    self.fs.delete_dir(part.path)
                    gone += 1
        return gone
