"""A data source of files' facts that survives files it cannot read.

Partitions are folders: the driver lists only the first levels of a tree, until there
are folders enough; tasks walk the rest. Each file gives one row: what could be read,
or the kind of the error that stopped it. Files are read in pieces; without content
hashes, only their first bytes and what their headers point to.
"""

from __future__ import annotations

import datetime
import errno
import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from prismlake.functions.imaging import dimensions_of, exif_of

#: Bytes that a header hash covers.
HEADER = 4096
#: Bytes at a file's beginning in which sizes and tags are looked for when its content is not read.
HEAD = 1 << 18
#: Bytes that are read at a time.
PIECE = 1 << 20
#: Rows of a batch.
BATCH = 512
#: Kinds of errors by the system's number; all others are IO_ERROR.
KINDS = {errno.EACCES: "PERMISSION_DENIED", errno.EPERM: "PERMISSION_DENIED", errno.ENOENT: "NOT_FOUND"}

SCHEMA = "path string, size_bytes long, mtime string, content_hash string, header_hash string, width int, height int, date_taken string, orientation int, thumbnail binary, kind string, error string"
TYPES = [pa.string(), pa.int64(), *[pa.string()] * 3, pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.string()]
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


@dataclass
class Walk(InputPartition):
    """All files below a folder."""

    folder: str


@dataclass
class Own(InputPartition):
    """The files of a folder itself, those whose names have this checksum modulo parts."""

    folder: str
    part: int
    parts: int


@dataclass
class Chosen(InputPartition):
    """Files by name."""

    paths: tuple[str, ...]


def kind_of(error: OSError) -> str:
    return KINDS.get(error.errno, "IO_ERROR")


def _failed(path: str, error: OSError) -> dict:
    return {"path": path, "kind": kind_of(error), "error": str(error)}


def facts_of(path: str, hashed: bool, facts: bool = True) -> dict:
    """The row of one file; hashed: with a hash of its content, for which it is read whole, piece by piece."""
    try:
        stat = os.stat(path)
        with open(path, "rb") as file:
            head = file.read(HEAD if facts or hashed else HEADER)
            digest = hashlib.sha256(head) if hashed else None
            while hashed and (piece := file.read(PIECE)):
                digest.update(piece)
    except OSError as error:
        return _failed(path, error)
    at = datetime.datetime.fromtimestamp(int(stat.st_mtime), datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S+00:00")
    row = {"path": path, "size_bytes": stat.st_size, "mtime": at, "content_hash": digest and digest.hexdigest(), "header_hash": hashlib.sha256(head[:HEADER]).hexdigest()}
    if facts:
        row["width"], row["height"] = dimensions_of(head)
        row |= exif_of(head)
    return row


class HeadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folders = json.loads(options.get("folders", "[]"))
        self.paths = json.loads(options.get("paths", "[]"))
        self.endings = tuple(json.loads(options.get("extensions", "[]")))
        self.hashed = options.get("hashed", "false") == "true"
        self.facts = options.get("facts", "true") == "true"
        self.slices = int(options.get("slices", "64"))

    def partitions(self) -> list[InputPartition]:
        """Folders enough for all slices; those that had to be opened for it give their own files."""
        todo, opened = list(dict.fromkeys(os.path.abspath(f) for f in self.folders)), []
        while todo and len(todo) < self.slices:
            below = []
            for folder in todo:
                opened.append(folder)
                try:
                    with os.scandir(folder) as entries:
                        below += sorted(e.path for e in entries if e.is_dir(follow_symlinks=False))
                except OSError:
                    pass  # its own files' partition says so
            todo = below
        parts = max(1, self.slices // max(1, len(opened) + len(todo)))
        found: list[InputPartition] = [Walk(f) for f in todo] + [Own(f, i, parts) for f in opened for i in range(parts)]
        size = max(1, -(-len(self.paths) // self.slices))
        return found + [Chosen(tuple(self.paths[i : i + size])) for i in range(0, len(self.paths), size)]

    def _names(self, partition: InputPartition) -> Iterator[tuple[str, OSError | None]]:
        """(path, None) of files, (folder, error) of folders that cannot be listed; links are passed by."""
        if isinstance(partition, Chosen):
            yield from ((p, None) for p in partition.paths)
            return
        todo = [partition.folder]
        while todo:
            folder = todo.pop()
            try:
                with os.scandir(folder) as entries:
                    for e in entries:
                        if e.is_dir(follow_symlinks=False):
                            if isinstance(partition, Walk):
                                todo.append(e.path)
                        elif e.is_file(follow_symlinks=False) and (isinstance(partition, Walk) or zlib.crc32(os.fsencode(e.name)) % partition.parts == partition.part):
                            yield e.path, None
            except OSError as error:
                if isinstance(partition, Walk) or partition.part == 0:
                    yield folder, error

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for path, error in self._names(partition):
            if error is None and self.endings and not path.lower().endswith(self.endings):
                continue
            rows.append(_failed(path, error) if error is not None else facts_of(path, self.hashed, self.facts))
            if len(rows) >= BATCH:
                yield self._batch(rows)
                rows = []
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(NAMES, TYPES, strict=True)], names=NAMES)


class FileHeads(DataSource):
    """Facts of files on a file system that all executors see, by folders or by names."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return HeadReader(self.options)


def file_heads(spark: SparkSession, folders: list[str] | None = None, paths: list[str] | None = None, extensions: list[str] | None = None, hashed: bool = False, facts: bool = True, slices: int = 64) -> DataFrame:
    """One row for each file below folders, and for each of paths: path, size_bytes, mtime, content_hash (with hashed), header_hash, and with facts width, height, date_taken, orientation and thumbnail.

    What cannot be read has its path, the kind of the error (a name of views.FAILURES)
    and its text, folders that cannot be listed too; nothing fails the job. Empty files
    are files. Roots that overlap give a file once for each. Without hashed, a file's
    first bytes alone are read.
    """
    spark.dataSource.register(FileHeads)
    plain = [f.removeprefix("file:") for f in folders or []]
    options = {"folders": json.dumps(plain), "paths": json.dumps(paths or []), "extensions": json.dumps(extensions or []), "hashed": str(hashed).lower(), "facts": str(facts).lower(), "slices": str(slices)}
    return spark.read.format("file_heads").options(**options).load()
