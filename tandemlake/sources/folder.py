"""Folders of named files, written by tasks and committed as a whole.

A data source whose rows are (name, content): rows of one name stand together, in order, in one task, which streams them
into a file. Files are written in a folder of the run beside where they belong; when all tasks have succeeded they are
moved into place and, where an ending is given, files of an earlier run with that ending go. A run that fails leaves
what was there before.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .scratch import opened

FORMAT, TYPE = "named_files", "name string, content binary"


def uri(path: str) -> str:
    return path if "://" in path else os.path.abspath(path)


def safe(name: str | None) -> str:
    """A name as a file's: what it can't hold is percent-encoded, so no two names share a file. None is none of them."""
    return "%" if name is None else quote(name, safe=":-._") or "%00"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, ending: str):
        self.path, self.ending, self.run = path, ending, f".run-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        mine = f"{self.run}/{TaskContext.get().taskAttemptId()}"
        now, out, names = None, None, []
        try:
            for b in iterator:
                for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if name != now:
                        if out is not None:
                            out.close()
                        if not names:
                            fs.create_dir(f"{root}/{mine}", recursive=True)
                        now, out = name, fs.open_output_stream(f"{root}/{mine}/{name}")
                        names.append(name)
                    out.write(content)
        finally:
            if out is not None:
                out.close()
        return Written(mine, names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        new = [(m.folder, n) for m in messages if m is not None for n in m.names]
        if len({n for _, n in new}) < len(new):
            self.abort(messages)
            raise ValueError("rows of one file were in several tasks, or not together")
        for folder, name in new:
            if fs.get_file_info(f"{root}/{name}").type == pfs.FileType.File:
                fs.delete_file(f"{root}/{name}")
            fs.move(f"{root}/{folder}/{name}", f"{root}/{name}")
        kept = {n for _, n in new}
        for f in fs.get_file_info(pfs.FileSelector(root)) if self.ending else ():
            if f.type == pfs.FileType.File and f.base_name.endswith(self.ending) and f.base_name not in kept:
                fs.delete_file(f.path)
        self._clear(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        self._clear(fs, root)

    def _clear(self, fs: pfs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/{self.run}").type == pfs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.run}")


class Files(DataSource):
    """spark.dataSource.register(Files); df.write.format("named_files").option("ending", ".bed").mode("overwrite").save(path)"""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return TYPE

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(uri(self.options["path"]), self.options.get("ending", ""))


def write_files(rows: DataFrame, keys: list[str], order: list[str], contents: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[str, bytes]]], path: str, ending: str = "") -> None:
    """Deals rows out by `keys`, orders them in each task, and writes the (name, bytes) that contents() makes of them as the folder's files."""

    def run(batches):
        held, size = [], 0
        for item in contents(batches):
            held.append(item)
            size += len(item[1])
            if size >= 1 << 22 or len(held) >= 4096:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in held], pa.string()), pa.array([c for _, c in held], pa.binary())], ["name", "content"])

    tick = [f"`{c}`" for c in keys]
    ready = rows.repartition(*tick).sortWithinPartitions(*tick, *(f"`{c}`" for c in order)).mapInArrow(run, TYPE)
    rows.sparkSession.dataSource.register(Files)
    ready.write.format(FORMAT).option("ending", ending).mode("overwrite").save(uri(path))
