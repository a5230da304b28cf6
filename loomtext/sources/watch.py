"""A folder of notes as a data source: its files as a batch, and what became of them since the last look as a stream.

    watch.scan(spark, root)                  # file_path, text, file_size, modified_ns
    watch.watched(spark, root, snapshots)    # events, as coalesce_events() and IndexSync take them

A task lists one folder of the given depth (and all below it); the driver only sees the names of those folders. An offset is a time. The listing of each folder at that time is written
to the snapshots' folder, once, by the task that made it, so a batch that is replayed after a failure compares the same two listings and gives the same events.
"""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from loomtext.config import Config
from loomtext.functions.scope import in_scope

FILES = "file_path string, text string, file_size long, modified_ns long"
EVENTS = "event_id long, ts timestamp, file_path string, old_path string, op string"
SHARDS = "_folders"


def write_notes(notes: DataFrame, root: str) -> None:
    """file_path, text, modified_ns as files below a folder that all machines share, each task its own; times are set in a local file system. What is there is overwritten."""

    def write(rows: Iterator[Row]) -> None:
        tree = Tree(root)
        for r in rows:
            path = f"{tree.root}/{r['file_path']}"
            tree.fs.create_dir(path.rpartition("/")[0], recursive=True)
            with tree.fs.open_output_stream(path) as f:
                f.write((r["text"] or "").encode())
            if isinstance(tree.fs, pf.LocalFileSystem):
                os.utime(path, ns=(r["modified_ns"], r["modified_ns"]))

    notes.select("file_path", "text", "modified_ns").foreachPartition(write)


def delete_notes(notes: DataFrame, root: str) -> None:
    """Takes the files of file_path away; one that is not there is none to take."""

    def delete(rows: Iterator[Row]) -> None:
        tree = Tree(root)
        for r in rows:
            path = f"{tree.root}/{r['file_path']}"
            if tree.fs.get_file_info(path).type == pf.FileType.File:
                tree.fs.delete_file(path)

    notes.select("file_path").foreachPartition(delete)


@dataclass
class Folder(InputPartition):
    """path below the root ("" for the root), and whether folders below it belong to it; two times in a stream."""

    path: str
    deep: bool
    start: int = 0
    end: int = 0


class Tree:
    """A root in any file system that pyarrow knows."""

    def __init__(self, root: str):
        self.fs, self.root = pf.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pf.LocalFileSystem(), root)
        self.root = self.root.rstrip("/")

    def there(self) -> None:
        if self.fs.get_file_info(self.root).type != pf.FileType.Directory:
            raise FileNotFoundError(f"no folder {self.root}")  # not the same as a folder whose notes are all gone

    def list(self, path: str, deep: bool) -> list[pf.FileInfo]:
        return self.fs.get_file_info(pf.FileSelector(f"{self.root}/{path}".rstrip("/"), recursive=deep, allow_not_found=True))

    def relative(self, info: pf.FileInfo) -> str:
        return info.path.removeprefix(self.root).lstrip("/")

    def folders(self, depth: int) -> list[tuple[str, bool]]:
        """Folders above a depth by themselves, and those at it with all that is below."""
        self.there()
        level, out = [""], []
        for _ in range(depth):
            out += [(p, False) for p in level]
            level = [self.relative(x) for p in level for x in self.list(p, False) if x.type == pf.FileType.Directory]
        return out + [(p, True) for p in level]

    def notes(self, path: str, deep: bool) -> list[tuple[str, int, int]]:
        """file_path, file_size, modified_ns, in order."""
        files = (x for x in self.list(path, deep) if x.type == pf.FileType.File and x.extension.lower() == "md")
        return sorted((self.relative(x), x.size, x.mtime_ns) for x in files)


class Notes(DataSource):
    """Options: depth (1) of the folders that are listed by a task each; snapshots, needed for a stream, a folder that all machines share."""

    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return EVENTS if "snapshots" in self.options else FILES

    def reader(self, schema) -> DataSourceReader:
        return NoteReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        if "snapshots" not in self.options:
            raise ValueError("a stream of notes needs the option snapshots: a folder that all machines share")
        return NoteStream(self.options)


def scan(spark: SparkSession, root: str, config: Config = Config(), depth: int = 1) -> DataFrame:
    """The notes below a folder that are in scope, empty ones included (which Spark's own file readers, and so scan_notes(), leave out)."""
    spark.dataSource.register(Notes)
    return spark.read.format("notes").option("depth", depth).load(root).where(in_scope(F.col("file_path"), config.include, config.exclude))


def watched(spark: SparkSession, root: str, snapshots: str, depth: int = 1) -> DataFrame:
    """The stream of what becomes of them."""
    spark.dataSource.register(Notes)
    return spark.readStream.format("notes").option("depth", depth).option("snapshots", snapshots).load(root)


class NoteReader(DataSourceReader):
    """Bad bytes of a text are replaced; a note that goes away between listing and reading is left out."""

    def __init__(self, options: dict[str, str]):
        self.root, self.depth = options["path"], int(options.get("depth", 1))

    def partitions(self) -> list[Folder]:
        return [Folder(*f) for f in Tree(self.root).folders(self.depth)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        tree = Tree(self.root)
        for path, size, ns in tree.notes(partition.path, partition.deep):
            try:
                with tree.fs.open_input_stream(f"{tree.root}/{path}") as f:
                    yield path, f.read().decode("utf-8", "replace"), size, ns
            except FileNotFoundError:
                continue


class NoteStream(DataSourceStreamReader):
    """create, modify (another size or time) and delete of every note, one event a path and batch; the first batch has all notes. A rename is a delete and a create."""

    def __init__(self, options: dict[str, str]):
        self.root, self.depth = options["path"], int(options.get("depth", 1))
        self.snapshots = options["snapshots"]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """Now in milliseconds, and later than any snapshot there is, should the clock have gone back."""
        return {"at": max([int(time.time() * 1000), *(t + 1 for t in self._times())])}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        """The folders there are, and those of the last look; the list is kept, too, for replays."""
        kept = self._load(end["at"], SHARDS)
        if kept is None:
            old = self._load(start["at"], SHARDS) or []
            kept = sorted({*Tree(self.root).folders(self.depth), *((p, bool(deep)) for p, deep, _ in old)})
            kept = self._save(end["at"], SHARDS, [(p, int(deep), 0) for p, deep in kept])
        return [Folder(p, bool(deep), start["at"], end["at"]) for p, deep, _ in kept]

    def read(self, partition: Folder) -> Iterator[tuple]:
        name = hashlib.sha256(f"{partition.path}\n{partition.deep}".encode()).hexdigest()
        new = self._load(partition.end, name)
        if new is None:
            new = self._save(partition.end, name, Tree(self.root).notes(partition.path, partition.deep))
        was = {path: stat for path, *stat in self._load(partition.start, name) or []}
        at = datetime.fromtimestamp(partition.end / 1000, timezone.utc)
        for path, *stat in new:
            before = was.pop(path, None)
            if before != stat:
                yield partition.end, at, path, None, "create" if before is None else "modify"
        for path in was:
            yield partition.end, at, path, None, "delete"

    def commit(self, end: dict) -> None:
        """Listings older than the last batch's are not needed any more."""
        tree = Tree(self.snapshots)
        for t in self._times():
            if t < end["at"]:
                tree.fs.delete_dir(f"{tree.root}/at={t}")

    def _times(self) -> list[int]:
        tree = Tree(self.snapshots)
        return [int(x.base_name.removeprefix("at=")) for x in tree.list("", False) if x.base_name.startswith("at=")]

    def _load(self, at: int, name: str) -> list[tuple[str, int, int]] | None:
        tree = Tree(self.snapshots)
        file = f"{tree.root}/at={at}/{name}"
        if tree.fs.get_file_info(file).type != pf.FileType.File:
            return None
        rows = pq.read_table(file, filesystem=tree.fs, partitioning=None).to_pydict()
        return list(zip(rows["path"], rows["size"], rows["ns"], strict=True))

    def _save(self, at: int, name: str, rows: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Written beside its place and then moved there, so it is never read half; a task that runs twice takes the listing that stands."""
        tree = Tree(self.snapshots)
        folder = f"{tree.root}/at={at}"
        tree.fs.create_dir(folder, recursive=True)
        columns = {"path": pa.array([r[0] for r in rows], pa.string()), "size": pa.array([r[1] for r in rows], pa.int64()), "ns": pa.array([r[2] for r in rows], pa.int64())}
        own = f"{folder}/.{name}-{time.time_ns()}"
        pq.write_table(pa.table(columns), own, filesystem=tree.fs)
        standing = self._load(at, name)
        if standing is not None:
            tree.fs.delete_file(own)
            return standing
        tree.fs.move(own, f"{folder}/{name}")
        return rows
