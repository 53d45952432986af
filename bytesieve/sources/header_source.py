"""Spark data source ``file_headers``: (path, file_size, header) of the files below a folder, nothing read but prefixes.

    spark.dataSource.register(HeaderSource)
    spark.read.format("file_headers").option("glob", "*.bin").load("/data/incoming")

Planning walks folders until they are enough for the tasks asked for and only counts files, one at a time; what it keeps is
a bounded list of folders. A folder with more files than a task should read is dealt to several by the hash of the name,
each of which pages through the listing and keeps its own share; folders that planning did not reach are walked by tasks.
Filters on path and size (and the ``glob`` option) are met while listing, so files they leave out are never opened.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from itertools import islice

import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from bytesieve import rules

SCHEMA = "path string, file_size long, header binary"
PAGE = 1000
_TESTS = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
    StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: lambda a, b: b in a,
}


@dataclass
class Entry:
    path: str
    size: int | None  # None: a folder


class Store:
    """Files of one root: on this machine through the paged folder iterator, elsewhere through pyarrow, which returns a
    folder's names at once. Links to folders are not followed, so no walk runs in a circle."""

    def __init__(self, path: str):
        self.local = path.startswith("file:") or "://" not in path
        if self.local:
            self.root, self.scheme = re.sub("^file:/+", "/", path), "file:"
        else:
            from pyarrow import fs
            self.where, self.root = fs.FileSystem.from_uri(path)
            self.scheme = path[: path.index(self.root)] if self.root in path else ""

    def entries(self, folder: str) -> Iterator[Entry]:
        if self.local:
            with os.scandir(folder) as found:
                for e in found:
                    if e.is_dir(follow_symlinks=False):
                        yield Entry(e.path, None)
                    elif e.is_file():
                        yield Entry(e.path, e.stat().st_size)
        else:
            from pyarrow import fs
            for i in self.where.get_file_info(fs.FileSelector(folder)):
                if i.type == fs.FileType.Directory:
                    yield Entry(i.path, None)
                elif i.type == fs.FileType.File:
                    yield Entry(i.path, i.size)

    def prefix(self, path: str, size: int) -> bytes | None:
        """None if the file has gone since it was listed; other errors fail the task, which is then tried again."""
        try:
            if self.local:
                with open(path, "rb") as f:
                    return f.read(size)
            with self.where.open_input_stream(path) as f:
                return f.read(size)
        except FileNotFoundError:
            return None


class Part(InputPartition):
    """Folders to list, the share (of `shares`) of their names to keep, and whether to go down into sub-folders."""

    def __init__(self, folders: list[str], share: int = 0, shares: int = 1, deep: bool = False):
        super().__init__((folders, share, shares, deep))
        self.folders, self.share, self.shares, self.deep = folders, share, shares, deep


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.size = int(options.get("size", rules.HEADER_SIZE))
        self.glob = options.get("glob")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.per_task = int(options.get("filesPerTask", 20_000))
        self.most_folders = int(options.get("plannedFolders", 10_000))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", None)
            if type(f) in _TESTS and column in (("path",), ("file_size",)) and f.value is not None:
                self.tests.append((column[0], type(f), f.value))
            else:
                yield f

    def wanted(self, store: Store, e: Entry) -> bool:
        if self.glob is not None and not fnmatch(os.path.basename(e.path), self.glob):
            return False
        values = {"path": store.scheme + e.path, "file_size": e.size}
        return all(_TESTS[kind](values[column], value) for column, kind, value in self.tests)

    def partitions(self) -> list[Part]:
        store, parts, small, held = Store(self.path), [], [], 0
        todo, seen = deque([store.root]), 0
        while todo and seen < self.most_folders:
            folder, files = todo.popleft(), 0
            seen += 1
            for e in store.entries(folder):
                if e.size is not None:
                    files += 1
                elif self.recursive:
                    todo.append(e.path)
            shares = -(-files // self.per_task)
            if shares > 1:
                parts += [Part([folder], i, shares) for i in range(shares)]
            elif files:
                if held + files > self.per_task:
                    parts.append(Part(small))
                    small, held = [], 0
                small, held = [*small, folder], held + files
        if small:
            parts.append(Part(small))
        return [*parts, *(Part([folder], deep=True) for folder in todo)] or [Part([])]

    def _files(self, store: Store, part: Part) -> Iterator[Entry]:
        todo = list(part.folders)
        while todo:
            for e in store.entries(todo.pop()):
                if e.size is None:
                    if part.deep:
                        todo.append(e.path)
                elif part.shares == 1 or zlib.crc32(os.path.basename(e.path).encode("utf-8", "surrogateescape")) % part.shares == part.share:
                    if self.wanted(store, e):
                        yield e

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        store = Store(self.path)
        found = self._files(store, part)
        while page := list(islice(found, PAGE)):
            heads = [store.prefix(e.path, self.size) if self.size else None for e in page]
            yield pa.RecordBatch.from_arrays(
                [pa.array([store.scheme + e.path for e in page], pa.string()), pa.array([e.size for e in page], pa.int64()),
                 pa.array(heads, pa.binary())], names=["path", "file_size", "header"])


class HeaderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options)
