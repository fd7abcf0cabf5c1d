"""Rows of names and bytes as files: a sink that publishes all files of a write or none of them.

``df.write.format("glyphlake_files").mode("append").save(folder)`` after ``register(spark)``, for rows
(name string, content binary). A task writes into a staging folder of its own attempt, so attempts
that run twice or die midway leave nothing among the published files; the driver moves the folders
of the attempts that count when all tasks are done, and removes the staging area when one fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from posixpath import dirname, normpath

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

STAGING = "_staging"
#: Moves under way at once when a write is published.
MOVES = 16


@dataclass
class Attempt(WriterCommitMessage):
    """What a finished task tells the driver: its folder and how many files are in it."""

    folder: str
    files: int


def _plain(name: str | None) -> str:
    """The name if it stays inside the folder, and is read again by Spark; an error otherwise."""
    if not name or name.startswith("/") or normpath(name) != name or any(p[0] in "._" for p in name.split("/")):
        raise ValueError(f"not a name of a file inside the folder: {name!r}")
    return name


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _area(self) -> tuple[pafs.FileSystem, str, str]:
        store, root = pafs.FileSystem.from_uri(self.path)
        return store, root, f"{root}/{STAGING}/{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        store, _, area = self._area()
        folder, names = f"{area}/{uuid.uuid4().hex}", set()
        store.create_dir(folder)
        for batch in iterator:
            for name, content in zip(batch.column("name"), batch.column("content"), strict=True):
                name = _plain(name.as_py())
                if name in names:
                    raise ValueError(f"two rows have one name: {name}")
                names.add(name)
                if "/" in name:
                    store.create_dir(f"{folder}/{dirname(name)}")
                with store.open_output_stream(f"{folder}/{name}") as out:
                    if content.is_valid:
                        out.write(content.as_buffer())
        return Attempt(folder, len(names))

    def commit(self, messages: list[Attempt | None]) -> None:
        store, root, area = self._area()
        staged = []
        for m in messages:
            if m is not None and m.files:
                found = store.get_file_info(pafs.FileSelector(m.folder, recursive=True))
                staged += [(f.path, f.path[len(m.folder) + 1 :]) for f in found if f.type == pafs.FileType.File]
        names = [name for _, name in staged]
        taken = set() if self.overwrite else {f.path for f in store.get_file_info([f"{root}/{n}" for n in names]) if f.type != pafs.FileType.NotFound}
        if len(set(names)) < len(names) or taken:
            self.abort(messages)
            raise ValueError(f"a name is there twice: {min(taken, default=None) or min(n for n in names if names.count(n) > 1)}")
        if self.overwrite:
            for f in store.get_file_info(pafs.FileSelector(root)):
                if f.base_name != STAGING:
                    store.delete_dir(f.path) if f.type == pafs.FileType.Directory else store.delete_file(f.path)
        for folder in sorted({dirname(n) for n in names} - {""}):
            store.create_dir(f"{root}/{folder}")
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda s: store.move(s[0], f"{root}/{s[1]}"), staged))
        store.delete_dir(area)

    def abort(self, messages: list[Attempt | None]) -> None:
        store, _, area = self._area()
        if store.get_file_info(area).type == pafs.FileType.Directory:
            store.delete_dir(area)


class Files(DataSource):
    """The data source ``glyphlake_files``; its option path is a folder on any file system that Arrow opens."""

    @classmethod
    def name(cls) -> str:
        return "glyphlake_files"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        if kinds.get("name") != "string" or kinds.get("content") != "binary":
            raise ValueError("rows of (name string, content binary) are needed")
        return FilesWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, folder: str, mode: str = "append") -> None:
    """Write rows (name, content) as files under the folder, all of them or none.

    Names are paths relative to the folder, must differ from each other and, unless ``mode`` is
    overwrite, from the files that are there; a null content is an empty file. Overwriting removes
    what was in the folder. No rows publish nothing. Other columns are ignored.
    """
    rows.sparkSession.dataSource.register(Files)
    rows.select("name", "content").write.format(Files.name()).mode(mode).save(folder)


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(name, content) of the files under a folder whose names fit the pattern, each whole; Spark passes empty files over."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return read.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
