"""A folder's changes as a stream: a source whose offsets are versions of a stored listing.

Each look at the folder that finds it changed stores a listing (path, size, time) under a new version, dealt to shards by
path; the events of a batch are the differences of two stored listings.  A restart goes on from the version in the
checkpoint: nothing is lost or told twice, whatever happened meanwhile.  A path that is renamed is deleted and created.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from mnemoweave.sources.tree import opened

FORMAT = "folder_changes"
EVENTS = "path string, event string, at timestamp"
SHARDS = 8
_NONE = -1  # the version of a folder that was never looked at


class Listings:
    """Stored listings of a folder, by version."""

    def __init__(self, root: str, state: str, extensions: tuple[str, ...] = (), ignored_dirs: tuple[str, ...] = ()):
        self.system, self.top = opened(root)
        self.store, self.state = opened(state)
        self.extensions, self.ignored = extensions, {".git", *ignored_dirs}

    def now(self) -> dict[str, tuple[int, int]]:
        """{path: (size, time in ns)} of the watched files; links to folders are not followed."""
        found, todo = {}, [self.top]
        while todo:
            for info in self.system.get_file_info(pafs.FileSelector(todo.pop(), allow_not_found=True)):
                if info.type == pafs.FileType.Directory:
                    if info.base_name not in self.ignored:
                        todo.append(info.path)
                elif not self.extensions or info.extension in self.extensions:
                    found[info.path.removeprefix(self.top).lstrip("/")] = (info.size or 0, info.mtime_ns or 0)
        return found

    def versions(self) -> list[int]:
        infos = self.store.get_file_info(pafs.FileSelector(self.state, allow_not_found=True))
        return sorted(int(i.base_name) for i in infos if i.base_name.isdigit())

    def shard(self, version: int, k: int) -> dict[str, tuple[int, int]]:
        if version == _NONE:
            return {}
        rows = pq.read_table(f"{self.state}/{version}/{k}.parquet", filesystem=self.store).to_pydict()
        return dict(zip(rows["path"], zip(rows["size"], rows["time"])))

    def whole(self, version: int) -> dict[str, tuple[int, int]]:
        return {p: x for k in range(SHARDS) for p, x in self.shard(version, k).items()}

    def seen_at(self, version: int) -> datetime:
        with self.store.open_input_stream(f"{self.state}/{version}/at.json") as stream:
            return datetime.fromtimestamp(json.loads(stream.read())["at"], UTC)

    def write(self, version: int, listing: dict[str, tuple[int, int]]) -> None:
        """Written aside and then moved, so that a version is there whole or not at all."""
        aside = f"{self.state}/.{version}"
        self.store.create_dir(aside, recursive=True)
        for k in range(SHARDS):
            mine = sorted(p for p in listing if zlib.crc32(p.encode()) % SHARDS == k)
            rows = {"path": pa.array(mine, pa.string()), "size": pa.array([listing[p][0] for p in mine], pa.int64()), "time": pa.array([listing[p][1] for p in mine], pa.int64())}
            pq.write_table(pa.table(rows), f"{aside}/{k}.parquet", filesystem=self.store)
        with self.store.open_output_stream(f"{aside}/at.json") as stream:
            stream.write(json.dumps({"at": datetime.now(UTC).timestamp()}).encode())
        self.store.move(aside, f"{self.state}/{version}")

    def look(self) -> int:
        """The version of the folder as it is now; a new one if it has changed."""
        listing, last = self.now(), max(self.versions(), default=_NONE)
        if last != _NONE and self.whole(last) == listing:
            return last
        self.write(last + 1, listing)
        return last + 1

    def drop_before(self, version: int) -> None:
        for old in self.versions():
            if old < version:
                self.store.delete_dir(f"{self.state}/{old}")


class _Span(InputPartition):
    def __init__(self, start: int, end: int, shard: int):
        self.start, self.end, self.shard = start, end, shard


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        split = lambda k: tuple(x for x in options.get(k, "").split(",") if x)
        self.args = (options["path"], options["state"], split("extensions"), split("ignored_dirs"))
        self.known = options.get("existing", "known") == "known"

    def initialOffset(self) -> dict:
        """Files that are there at the first start are known already, or told as created with ``existing`` = ``created``."""
        return {"version": Listings(*self.args).look() if self.known else _NONE}

    def latestOffset(self) -> dict:
        return {"version": Listings(*self.args).look()}

    def partitions(self, start: dict, end: dict) -> list[_Span]:
        return [_Span(start["version"], end["version"], k) for k in range(SHARDS)] if start != end else []

    def read(self, partition: _Span) -> Iterator[tuple]:
        held = Listings(*self.args)
        before, after = held.shard(partition.start, partition.shard), held.shard(partition.end, partition.shard)
        at = held.seen_at(partition.end)
        for path in sorted(before.keys() | after.keys()):
            if before.get(path) != after.get(path):
                yield path, "Created" if path not in before else "Deleted" if path not in after else "Modified", at

    def commit(self, end: dict) -> None:
        Listings(*self.args).drop_before(end["version"])


class FolderChanges(DataSource):
    """Options: ``path``, ``state`` (a folder for listings, shared by driver and executors), ``extensions`` and
    ``ignored_dirs`` (comma-separated), ``existing`` (``known`` or ``created``)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderChanges)
