"""k-mer class databases: gzip files of little-endian sets, and class maps.

Layout before compression: u8 k, u16 sets, and for each set u16 name length, name, u32 count, count x i32.

Databases written here have each set in a gzip member of its own, and beside {class}.db a file {class}.db.sets that says where
the members begin. By it sets are dealt out to tasks; a database without one, or with one of other bytes, is a task's.
"""

from __future__ import annotations

import gzip
import json
import os
import struct
import sys
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folder import safe, write_files
from .scratch import cut, opened, scratch

#: k-mers that a database's reader holds at a time.
PART = 1 << 18


def encode(k: int, sets: dict[str, np.ndarray]) -> bytes:
    """k-mers in order, and no time stamp, so that equal sets give equal bytes."""
    if not 0 < k < 256 or len(sets) > 65535:
        raise ValueError("k or the number of sets doesn't fit")
    out = [struct.pack("<BH", k, len(sets))]
    for name, values in sets.items():
        raw, values = name.encode(), np.sort(np.asarray(values, "<i4"))
        out += [struct.pack("<H", len(raw)), raw, struct.pack("<I", len(values)), values.tobytes()]
    return gzip.compress(b"".join(out), mtime=0)


class _Bytes:
    """What a gzip stream of one or more members holds, some bytes at a time."""

    def __init__(self, f):
        self.f, self.z, self.held = f, zlib.decompressobj(31), bytearray()

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            raw = self.z.unconsumed_tail or (self.z.unused_data if self.z.eof else b"") or self.f.read(1 << 16)
            if not raw:
                raise ValueError("a k-mer database ends early")
            if self.z.eof:  # another member
                self.z = zlib.decompressobj(31)
            self.held.extend(self.z.decompress(raw, 1 << 20))
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def set(self) -> Iterator[tuple[str, np.ndarray]]:
        """A set's name and some of its k-mers, PART at most at a time; an empty one comes once."""
        name = self.take(struct.unpack("<H", self.take(2))[0]).decode()
        (count,) = struct.unpack("<I", self.take(4))
        for done in range(0, max(count, 1), PART):
            yield name, np.frombuffer(self.take(4 * min(PART, count - done)), "<i4")


def streamed(f) -> Iterator[tuple[int, str, np.ndarray]]:
    """(k, name, some of its k-mers) of a database as a gzip stream, PART k-mers at most at a time; an empty set comes once. Raises if it ends early."""
    data = _Bytes(f)
    k, n = struct.unpack("<BH", data.take(3))
    for _ in range(n):
        for name, values in data.set():
            yield k, name, values


def _places(fs: pfs.FileSystem, name: str) -> list[int]:
    """Where a database's header and sets begin, and its end, by the file beside it; none if there is no such file or it is of another database."""
    beside = f"{name}.sets"
    if fs.get_file_info(beside).type != pfs.FileType.File:
        return []
    with fs.open_input_stream(beside, compression=None) as f:
        places = np.frombuffer(f.read(), "<i8").tolist()
    return places if places and places[-1] == fs.get_file_info(name).size else []


def read_dbs(spark: SparkSession, path: str, permissive: bool = False) -> DataFrame:
    """class (the file's stem), subtype, k, kmer of a folder's *.db files.

    A folder that isn't there, or is none, or has no such file, raises. permissive leaves out files that can't be
    decoded, with a warning in the worker's log; otherwise they raise.
    """
    fs, folder = opened(path if "://" in path else os.path.abspath(path))
    kind = fs.get_file_info(folder).type
    if kind == pfs.FileType.NotFound:
        raise FileNotFoundError(f"no folder {path}")
    if kind != pfs.FileType.Directory:
        raise ValueError(f"{path} is no folder")
    if not any(f.base_name.endswith(".db") for f in fs.get_file_info(pfs.FileSelector(folder))):
        raise ValueError(f"no .db files in {path}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.db").load(path).select("path")  # contents stream
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(batches):
        """A row for each set, or for a whole database whose sets' places aren't known (from -1)."""
        for b in batches:
            path, k, start = [], [], []
            for p in b.column("path").to_pylist():
                there, name = opened(p)
                sets = []
                try:
                    places = _places(there, name)
                    if places:
                        with there.open_input_stream(name, compression=None) as f:
                            size, count = struct.unpack("<BH", _Bytes(f).take(3))
                        sets = places[1:-1] if count == len(places) - 2 else []
                except (ValueError, OSError, zlib.error):
                    pass  # read whole, and reported there
                path += [p] * max(1, len(sets))
                k += [size if sets else 0] * max(1, len(sets))
                start += sets or [-1]
            yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(k, pa.int64()), pa.array(start, pa.int64())], ["path", "k", "start"])

    def parts(there: pfs.FileSystem, name: str, k: int, start: int) -> Iterator[tuple[int, str, np.ndarray]]:
        if start < 0:
            with there.open_input_stream(name, compression=None) as f:
                yield from streamed(f)
            return
        with there.open_input_file(name) as f:
            f.seek(start)
            for subtype, values in _Bytes(f).set():
                yield k, subtype, values

    def run(batches):
        for b in batches:
            for p, k, start in zip(*(b.column(c).to_pylist() for c in ("path", "k", "start")), strict=True):
                stem = unquote(p.rsplit("/", 1)[-1].removesuffix(".db"))
                there, name = opened(p)
                try:
                    if permissive and start < 0:  # whole or not at all: gone through once before
                        for _ in parts(there, name, k, start):
                            pass
                    for size, subtype, values in parts(there, name, k, start):
                        n = len(values)
                        yield pa.RecordBatch.from_arrays([pa.array([stem] * n, pa.string()), pa.array([subtype] * n, pa.string()), pa.array(np.full(n, size, np.int32)), pa.array(values)], ["class", "subtype", "k", "kmer"])
                except (ValueError, OSError, zlib.error, struct.error) as e:
                    if not permissive:
                        raise
                    print(f"left out {p}: {e}", file=sys.stderr)

    each = files.repartition(n).mapInArrow(dealt, "path string, k bigint, start bigint").repartition(n)
    return each.mapInArrow(run, "class string, subtype string, k int, kmer int")


def write_dbs(db: DataFrame, k: int, folder: str) -> DataFrame:
    """Returns class, subtype, n: the sizes of what it writes. One {class}.db a class in a folder that driver and executors share; databases of other classes there stay.

    The format names a set's size before its k-mers, so sizes are counted first; then each class streams, in order,
    through the task that writes its file, whatever its size. Nothing passes the driver, and a run that fails changes nothing.
    """
    if not 0 < k < 256:
        raise ValueError("k doesn't fit")
    one = cut(db.select("class", "subtype", "kmer").distinct())
    sizes = cut(one.groupBy("class", "subtype").agg(F.count("*").alias("n")))
    sets = sizes.groupBy("class").agg(F.count("*").alias("sets"))
    rows = one.join(sizes.join(sets, "class"), ["class", "subtype"])

    def contents(batches):
        now, subtype, z, at, places = None, None, None, 0, []

        def packed(raw: bytes, end: bool = False) -> tuple[str, bytes]:
            nonlocal at
            out = z.compress(raw) + (z.flush() if end else b"")
            at += len(out)
            return file_name(now), out

        def beside() -> tuple[str, bytes]:
            return f"{file_name(now)}.sets", np.array([*places, at], "<i8").tobytes()

        for b in batches:
            c, s, kmer = b.column("class").to_pylist(), b.column("subtype").to_pylist(), np.asarray(b.column("kmer")).astype("<i4")
            cuts = [0, *(i for i in range(1, len(c)) if (c[i], s[i]) != (c[i - 1], s[i - 1])), len(c)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if z is None or c[x] != now:
                    if z is not None:
                        yield packed(b"", True)
                        yield beside()
                    now, subtype, count, z, at, places = c[x], None, b.column("sets")[x].as_py(), zlib.compressobj(9, zlib.DEFLATED, 31), 0, [0]
                    if count > 65535:
                        raise ValueError("the number of sets doesn't fit")
                    yield packed(struct.pack("<BH", k, count))
                if s[x] != subtype:
                    yield packed(b"", True)  # a set is a member of its own
                    places.append(at)
                    subtype, raw, z = s[x], s[x].encode(), zlib.compressobj(9, zlib.DEFLATED, 31)
                    yield packed(struct.pack("<H", len(raw)) + raw + struct.pack("<I", b.column("n")[x].as_py()))
                yield packed(kmer[x:y].tobytes())
        if z is not None:
            yield packed(b"", True)
            yield beside()

    write_files(rows, ["class"], ["subtype", "kmer"], contents, folder)
    return sizes


def bucketed(db: DataFrame, buckets: int | None = None) -> DataFrame:
    """db's class, kmer (and k) as a table of its own, dealt out and sorted by k-mer once: joins by k-mer read it as it lies and shuffle queries alone.

    Repeated rows are left out. The table is the session's; its files are in the shared folder.
    """
    spark = db.sparkSession
    columns = ["class", "kmer", *(c for c in ("k",) if c in db.columns)]
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "kmers")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    rows = db.select(*columns).distinct().repartition(n, "kmer")
    rows.write.format("parquet").bucketBy(n, "kmer").sortBy("kmer").option("path", path).saveAsTable(name)
    return spark.table(name)


def file_name(name: str) -> str:
    """A class's file; characters that a file's name can't have are percent-encoded, so no two classes share one."""
    return safe(name) + ".db"


def class_map(spark: SparkSession, classes: dict[str, list[str]]) -> DataFrame:
    """class, subtype (lower case)."""
    return spark.createDataFrame([(c, s.lower()) for c, subtypes in classes.items() for s in subtypes], "class string, subtype string")


def read_class_map(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one configuration file
    classes = json.loads(text)
    if missing := set(required) - set(classes):
        raise ValueError(f"the class map lacks {sorted(missing)}")
    return class_map(spark, classes)
