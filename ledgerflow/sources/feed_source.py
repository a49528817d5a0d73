"""Feeds as a data source: spark.read.format("feed") and spark.readStream.format("feed").

    spark.dataSource.register(FeedSource)
    spark.read.format("feed").option("live", "true").option("limit", "10").load("s3://bucket/landing")

One row for each item, or for a rejected document's first error, as feeds.parsed() gives them. The driver lists the folder
only; a partition is one file, or a few small ones, which its task reads through pyarrow's file systems (local, S3, GCS,
HDFS). With a limit the items behind it are not looked at. With the option pushdown, which needs the session's
spark.sql.python.filterPushdown.enabled, a filter on `path` picks files before any is read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from ledgerflow.sources import feeds

SCHEMA = f"path string, {feeds.RAW}"
#: Files are put together up to so many bytes, so that many small ones do not make a task each.
PARTITION_BYTES = 4 * 1024 * 1024
_KINDS = [pa.string(), pa.int32(), *[pa.string()] * 5]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass(frozen=True)
class File:
    path: str
    size: int
    modified: int


@dataclass
class Files(InputPartition):
    files: tuple[File, ...]

    def __init__(self, files: tuple[File, ...]) -> None:
        super().__init__(files)
        self.files = files


def opened(path: str) -> tuple[arrow_fs.FileSystem, str, str]:
    """The file system of a path or address, the path there, and what stands before it in an address."""
    if path.startswith("file:") or "://" not in path:
        inner = path.removeprefix("file:")
        return arrow_fs.LocalFileSystem(), f"/{inner.lstrip('/')}" if inner.startswith("//") else inner, "file:"
    found, inner = arrow_fs.FileSystem.from_uri(path)
    return found, inner, path[: len(path) - len(inner)]


def listed(path: str) -> list[File]:
    """The files of a folder, or the one file, by path; hidden ones, and those that a writer has not finished, are left out."""
    found, inner, before = opened(path)
    one = found.get_file_info(inner)
    infos = [one] if one.type == arrow_fs.FileType.File else found.get_file_info(arrow_fs.FileSelector(inner, recursive=True))
    shown = [i for i in infos if i.type == arrow_fs.FileType.File and not any(p[:1] in "._" for p in i.path[len(inner) :].strip("/").split("/") if p)]
    return sorted((File(before + i.path, i.size, i.mtime_ns or 0) for i in shown), key=lambda f: f.path)


def grouped(files: list[File], most: int) -> list[Files]:
    out: list[Files] = []
    held: list[File] = []
    for f in files:
        if held and sum(x.size for x in held) + f.size > most:
            out.append(Files(tuple(held)))
            held = []
        held.append(f)
    return [*out, Files(tuple(held))] if held else out


class Settings:
    """The options of a feed source, checked when the query is made."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options.get("path", "")
        self.live = options.get("live", "false").lower() == "true"
        self.limit = int(options["limit"]) if "limit" in options else None
        self.bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        if not self.path:
            raise ValueError("the feed source needs a path")
        if self.live and not (self.limit and 1 <= self.limit <= feeds.MOST_LIVE):
            raise ValueError(f"a live feed needs a limit from 1 to {feeds.MOST_LIVE}")

    def rows(self, files: Iterable[File]) -> Iterator[pa.RecordBatch]:
        for f in files:
            if f.size > feeds.MAX_BYTES:
                found = [(0, None, None, None, None, "size")]
            else:
                store, inner, _ = opened(f.path)
                with store.open_input_stream(inner) as stream:
                    found = feeds.items(stream.read(), self.live, self.limit)
            rows = [(f.path, *r) for r in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


class FeedReader(DataSourceReader):
    def __init__(self, settings: Settings) -> None:
        self.settings, self.paths = settings, None

    def partitions(self) -> list[Files]:
        files = listed(self.settings.path)
        return grouped([f for f in files if self.paths is None or f.path in self.paths], self.settings.bytes) or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.settings.rows(partition.files)


class FilteredFeedReader(FeedReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality on path picks files; Spark applies all other filters."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.paths = {f.value} if self.paths is None else self.paths & {f.value}
            elif isinstance(f, In) and f.attribute == ("path",):
                self.paths = set(f.value) if self.paths is None else self.paths & set(f.value)
            else:
                yield f


class FeedStreamReader(DataSourceStreamReader):
    """New files in the order of their times and paths; an offset is the last file taken. A file must appear whole, by a rename,
    and not with a time before files that were taken already."""

    def __init__(self, settings: Settings) -> None:
        self.settings = settings

    def _new(self, start: dict, end: dict | None = None) -> list[File]:
        key = lambda f: (f.modified, f.path)
        last = (start["modified"], start["path"])
        files = sorted((f for f in listed(self.settings.path) if key(f) > last), key=key)
        return files if end is None else [f for f in files if key(f) <= (end["modified"], end["path"])]

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self._new(self.initialOffset())
        return {"modified": files[-1].modified, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return grouped(self._new(start, end), self.settings.bytes)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.settings.rows(partition.files)


class FeedSource(DataSource):
    """Format "feed". Options: path, live (RSS or Atom, decoded HTML later; false: strict RSS), limit (items of a live document),
    partitionBytes, pushdown."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> FeedReader:
        kind = FilteredFeedReader if self.options.get("pushdown", "false").lower() == "true" else FeedReader
        return kind(Settings(dict(self.options)))

    def streamReader(self, schema: object) -> FeedStreamReader:
        return FeedStreamReader(Settings(dict(self.options)))
