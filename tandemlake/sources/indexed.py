"""Sequences read by index: which bytes of which file hold which bases.

An index has a row for each piece of a record, SEGMENT bytes of a file at most. Spark builds it: byte ranges of the files
are dealt out, each is scanned for line starts, and what lies across a border (a header begun before it, a line that goes
on) is settled from a row a segment by window functions. Plain FASTA of any line widths, block-gzipped FASTA (whose blocks
are found from any byte on), and sequences of a table, which tasks write as bare bases, are indexed alike. Plain gzip
can't be entered in the middle: a task unpacks such a file first, in a stream.

What is read later are pieces, by their bytes: a record of any length is many tasks' work, and a region costs the
segments that it lies in. Only index rows are joined and shuffled.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import cut, opened, scratch

#: Bytes that a row of the index names at most, bytes that a task scans, and bytes that a task reads where all are read.
SEGMENT, RANGE, SHARE = 1 << 18, 1 << 26, 1 << 25
#: Bases a bin has in which regions meet pieces.
BIN = 1 << 18
BARE, TEXT, BLOCKS, GZIP = range(4)
MAGIC = b"\x1f\x8b"
#: What ends a block-gzipped file: an empty block.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True


def block_size(head: bytes) -> int | None:
    """A block's bytes from its first 18 or more; None if these begin no block."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= min(end, len(head)):
        n = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and n == 2 and at + 6 <= len(head):
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + n
    return None


def unpacked(block: bytes) -> bytes:
    """A block's contents, with its check sum and size tested; raises what zlib raises."""
    z = zlib.decompressobj(31)
    out = z.decompress(block)
    if not z.eof or z.unused_data:
        raise zlib.error("a block doesn't end where it says")
    return out


def blocks(f, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, contents) of the blocks from `start` on, which is one's offset."""
    while start < size:
        f.seek(start)
        raw = f.read(1 << 16)
        n = block_size(raw)
        if n is None or len(raw) < n:
            raise ValueError(f"a block-gzipped file breaks off at byte {start}")
        yield start, unpacked(raw[:n])
        start += n


def first_block(f, start: int, size: int) -> int:
    """Where the first block at or after `start` begins, or the file's size."""
    while start < size:
        f.seek(start)
        raw = f.read(1 << 18)
        at = raw.find(b"\x1f\x8b\x08\x04")
        while at >= 0:
            n = block_size(raw[at : at + 256])
            if n is not None and start + at + n <= size:
                f.seek(start + at)
                try:
                    unpacked(f.read(n))
                    return start + at
                except zlib.error:
                    pass
            at = raw.find(b"\x1f\x8b\x08\x04", at + 1)
        start += max(1, len(raw) - 3)
    return size


# --- building --------------------------------------------------------------------------------------------------


def _kinds(batches):
    """Each file's kind from its first bytes. One that can't be opened is left out, with a warning."""
    for b in batches:
        kept, kinds = [], []
        for i, path in enumerate(b.column("path").to_pylist()):
            try:
                fs, name = opened(path)
                with fs.open_input_file(name) as f:
                    head = f.read(256)
                    if block_size(head) is not None:
                        f.seek(max(0, b.column("length")[i].as_py() - len(END)))
                        if f.read(len(END)) != END:
                            raise ValueError(f"{path} breaks off: its last block is missing")
            except OSError as e:
                print(f"left out {path}: {e}", file=sys.stderr)
                continue
            kept.append(i)
            kinds.append(BLOCKS if block_size(head) is not None else GZIP if head[:2] == MAGIC else TEXT)
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(kept, pa.int64())) for c in b.columns), pa.array(kinds, pa.int64())], [*b.schema.names, "kind"])


def _unzipped(folder: str):
    """Unpacks plain gzip files in a stream; a file that breaks off raises."""

    def run(batches):
        for b in batches:
            paths, sizes = [], []
            for i, path in enumerate(b.column("path").to_pylist()):
                fs, name = opened(path)
                there, root = opened(folder)
                there.create_dir(root, recursive=True)
                task = TaskContext.get()
                out, z, size = f"unpacked-{task.partitionId():06d}-{i:04d}-{task.taskAttemptId()}", zlib.decompressobj(31), 0
                with fs.open_input_stream(name, compression=None) as f, there.open_output_stream(f"{root}/{out}") as g:
                    while raw := f.read(1 << 20):
                        while raw:
                            if z.eof:  # another member
                                z = zlib.decompressobj(31)
                            size += g.write(z.decompress(raw, 1 << 24))
                            raw = z.unused_data if z.eof else z.unconsumed_tail
                    size += g.write(z.flush())
                if not z.eof:
                    raise ValueError(f"{path} breaks off")
                paths.append(f"{folder}/{out}")
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([b.column("file"), pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array([TEXT] * b.num_rows, pa.int64())], ["file", "path", "length", "kind"])

    return run


def _token(after: bytes, more) -> str:
    """A header's text up to its first blank; more() gives what follows the bytes at hand."""
    i = 0
    while True:
        while i < len(after) and not _blank[after[i]]:
            i += 1
        if i < len(after) or not (new := more(len(after))):
            return after[:i].decode("utf-8", "replace")
        after += new


def _segment(buf: bytes, more) -> dict:
    """What a segment holds: its first line by itself, which may go on from before, then the stretches of its records."""
    data = np.frombuffer(buf, np.uint8)
    bases = np.concatenate([[0], np.cumsum(~_blank[data])])
    ends = np.nonzero(data == 10)[0]
    first = int(ends[0]) + 1 if len(ends) else len(data)
    starts = ends + 1
    heads = starts[:-1][data[starts[:-1]] == 62] if len(starts) and starts[-1] == len(data) else starts[data[starts] == 62] if len(starts) else starts
    bound = [*heads.tolist(), len(data)]
    pieces = [{"seq_id": None, "skip": first, "size": bound[0] - first, "bases": int(bases[bound[0]] - bases[first])}] if bound[0] > first else []
    tail = None
    if len(ends):
        last = int(starts[-1])
        tail = 0 if last == len(data) else 2 if data[last] == 62 else 1
    for head, end in zip(bound, bound[1:], strict=False):
        i = int(np.searchsorted(ends, head))
        line = int(ends[i]) + 1 if i < len(ends) else len(data)
        pieces.append({"seq_id": _token(buf[head + 1 : head + 4096], lambda n, h=head: buf[h + 1 + n : h + 1 + n + 4096] or more(h + 1 + n - len(buf))), "skip": line, "size": end - line, "bases": int(bases[end] - bases[line])})
    gt = bool(len(data)) and data[0] == 62
    return {"gt": gt, "token": _token(buf[1:4096], lambda n: buf[1 + n : 1 + n + 4096] or more(1 + n - len(buf))) if gt else None, "tail": tail, "first": first, "bases": int(bases[first]), "pieces": pieces}


_PIECES = pa.list_(pa.struct([("seq_id", pa.string()), ("skip", pa.int64()), ("size", pa.int64()), ("bases", pa.int64())]))
_SEGMENT = pa.schema([("file", pa.string()), ("path", pa.string()), ("kind", pa.int64()), ("at", pa.int64()), ("gt", pa.bool_()), ("token", pa.string()), ("tail", pa.int64()), ("first", pa.int64()), ("bases", pa.int64()), ("pieces", _PIECES)])
_SEGMENT_TYPE = "file string, path string, kind bigint, at bigint, gt boolean, token string, tail bigint, first bigint, bases bigint, pieces array<struct<seq_id:string,skip:bigint,size:bigint,bases:bigint>>"


def _scanned(size: int, share: int):
    """A row for each segment of the byte ranges (file, path, length, kind, x) of `share` bytes."""

    def segments(f, kind: int, length: int, x: int) -> Iterator[tuple[int, bytes, object]]:
        end = min(length, x + share)
        if kind == TEXT:
            for at in range(x, end, size):
                f.seek(at)
                buf = f.read(min(size, end - at))
                if len(buf) < min(size, end - at):
                    raise ValueError("a file is shorter than it was listed")

                def more(n, begin=at + len(buf)):
                    f.seek(begin + n)
                    return f.read(4096)

                yield at, buf, more
            return
        held, at = [], None
        for start, raw in blocks(f, first_block(f, x, length) if x else 0, length):
            if start >= end:
                break
            if raw:
                held.append(raw)
                at = start if at is None else at
            if sum(map(len, held)) >= size:
                yield at, b"".join(held), _after(f, at, length, b"".join(held))
                held, at = [], None
        if held:
            yield at, b"".join(held), _after(f, at, length, b"".join(held))

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                fs, name = opened(row["path"])
                rows = []
                with fs.open_input_file(name) as f:
                    for at, buf, more in segments(f, row["kind"], row["length"], row["x"]):
                        rows.append({"file": row["file"], "path": row["path"], "kind": row["kind"], "at": at, **_segment(buf, more)})
                        if len(rows) == 16:
                            yield from pa.Table.from_pylist(rows, _SEGMENT).to_batches()
                            rows = []
                yield from pa.Table.from_pylist(rows, _SEGMENT).to_batches()

    return run


def _after(f, at: int, length: int, buf: bytes):
    """What follows a segment of blocks."""

    def more(n):
        out = b"".join(raw for _, raw in _take(blocks(f, at, length), len(buf) + n + 4096))
        return out[len(buf) + n : len(buf) + n + 4096]

    return more


def _take(found, n: int):
    for at, raw in found:
        yield at, raw
        n -= len(raw)
        if n <= 0:
            return


def index_of(spark: SparkSession, paths: str | list[str], size: int = SEGMENT, share: int = RANGE) -> DataFrame:
    """The index of FASTA files: file, seq_id, path, kind, at, skip, size, base0, bases, seq_len, rec, a row for each piece of a record.

    Bases base0 and on are in the `size` bytes after `skip` of those that begin at byte `at` (of a block, its contents).
    Text before a file's first header is left out. A record without bases has one row. A file that can't be opened is
    left out with a warning; one that breaks off raises.
    """
    listed = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), "path", "length").where("length > 0")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = listed.repartition(n).mapInArrow(_kinds, "file string, path string, length bigint, kind bigint")
    packed = known.where(F.col("kind") == GZIP)
    unzipped = packed.repartition(n).mapInArrow(_unzipped(scratch(spark, "unpacked")), "file string, path string, length bigint, kind bigint")
    files = known.where(F.col("kind") != GZIP).unionByName(unzipped)
    ranges = files.select("file", "path", "length", "kind", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(share).cast("bigint"))).alias("x"))
    segments = cut(ranges.repartition(n).mapInArrow(_scanned(size, share), _SEGMENT_TYPE))

    by = Window.partitionBy("file").orderBy("at")  # a row for a segment
    first = F.row_number().over(by) == 1
    own = F.when(F.col("gt"), 2).otherwise(1)
    lined = segments.withColumns({"after": F.when(F.col("tail") == 0, F.when(F.lead("gt").over(by), 2).otherwise(1)).when(F.col("tail").isNull() & first, own).otherwise(F.col("tail")), "starts": F.col("gt") & (first | (F.lag("tail").over(by) == 0))})
    kind = F.coalesce(F.last("after", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)), own)
    zero = F.lit(0).cast("bigint")
    piece = lambda i, s, z, b: F.struct(i.alias("seq_id"), s.alias("skip"), z.alias("size"), b.alias("bases"))
    head = F.when(F.coalesce("starts", F.lit(False)), F.array(piece(F.col("token"), F.col("first"), zero, zero)))
    line = F.when(kind == 1, F.array(piece(F.lit(None).cast("string"), zero, F.col("first"), F.col("bases"))))
    whole = lined.withColumn("all", F.concat(F.coalesce(head, line, F.array().cast("array<struct<seq_id:string,skip:bigint,size:bigint,bases:bigint>>")), "pieces"))
    each = whole.select("file", "path", "kind", "at", F.posexplode("all").alias("n", "p")).select("file", "path", "kind", "at", "n", "p.*")
    numbered = each.withColumn("rec", F.sum(F.col("seq_id").isNotNull().cast("bigint")).over(Window.partitionBy("file").orderBy("at", "n"))).where("rec > 0")
    of = Window.partitionBy("file", "rec")
    told = numbered.withColumns({"seq_id": F.max("seq_id").over(of), "seq_len": F.sum("bases").over(of), "base0": F.coalesce(F.sum("bases").over(of.orderBy("at", "n").rowsBetween(Window.unboundedPreceding, -1)), zero), "last": F.row_number().over(of.orderBy("at", "n"))})
    used = told.where((F.col("bases") > 0) | ((F.col("seq_len") == 0) & (F.col("last") == 1)))
    return cut(used.select("file", "seq_id", "path", "kind", "at", "skip", "size", "base0", "bases", "seq_len", "rec"))


def read_index(spark: SparkSession, paths: str | list[str], size: int = SEGMENT, share: int = RANGE) -> Indexed:
    """FASTA files by index."""
    return Indexed(index_of(spark, paths, size, share))


def stored(seqs: DataFrame, size: int = SEGMENT) -> Indexed:
    """Sequences of a table (seq_id, seq and perhaps file), written once as bare bases by the tasks that have them, and indexed.

    Null sequences are left out. Bases count as they stand, whatever they are; repeated rows are records of their own.
    """
    kind = seqs.schema["seq_id"].dataType.simpleString()
    file = F.col("file") if "file" in seqs.columns else F.lit(None)
    rows = seqs.select(file.cast("string").alias("file"), "seq_id", F.col("seq").cast("binary").alias("seq")).where("seq is not null")
    folder = scratch(seqs.sparkSession, "bases")

    def run(batches):
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        path, at, rec = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}", 0, task.partitionId() << 40
        with fs.open_output_stream(path.replace(folder, root, 1)) as out:
            for b in batches:
                seq = b.column("seq").to_pylist()
                sizes = [len(x) for x in seq]
                row, skip = [], []
                for i, n in enumerate(sizes):
                    starts = range(0, max(n, 1), size)
                    row += [i] * len(starts)
                    skip += starts
                row, skip, n = np.array(row, np.int64), np.array(skip, np.int64), np.array(sizes, np.int64)
                begin = at + np.concatenate([[0], np.cumsum(n)])[:-1] if len(n) else n
                for x in seq:
                    out.write(x)
                at += int(n.sum())
                long, bases = n[row], np.minimum(size, n[row] - skip)
                columns = [begin[row] + skip, np.zeros(len(row), np.int64), bases, skip, bases, long, rec + row]
                rec += len(n)
                yield pa.RecordBatch.from_arrays([b.column("file").take(pa.array(row)), b.column("seq_id").take(pa.array(row)), pa.array([path] * len(row), pa.string()), pa.array(np.full(len(row), BARE, np.int64)), *map(pa.array, columns)], ["file", "seq_id", "path", "kind", "at", "skip", "size", "base0", "bases", "seq_len", "rec"])

    return Indexed(cut(rows.mapInArrow(run, f"file string, seq_id {kind}, path string, kind bigint, at bigint, skip bigint, size bigint, base0 bigint, bases bigint, seq_len bigint, rec bigint")))


# --- reading ---------------------------------------------------------------------------------------------------


class Reader:
    """Reads bases of pieces; keeps the last file open and the last piece at hand."""

    def __init__(self):
        self.path, self.f, self.size, self.key, self.known, self.read = None, None, 0, None, b"", 0

    def close(self) -> None:
        if self.f is not None:
            self.f.close()
        self.path = self.f = None

    def _open(self, path: str) -> None:
        if path != self.path:
            self.close()
            fs, name = opened(path)
            self.path, self.f, self.size, self.key = path, fs.open_input_file(name), fs.get_file_info(name).size, None

    def bases(self, path: str, kind: int, at: int, skip: int, size: int, bases: int, low: int, high: int) -> bytes:
        """Bases low to high (counted from the piece's first) of a piece that `bases` are in; those beyond are read on."""
        self._open(path)
        if kind == BARE or kind == TEXT and size == bases and high <= bases:  # no line ends
            self.f.seek(at + skip + low)
            self.read += high - low
            return self.f.read(high - low)
        if (at, skip, size) != self.key:
            self.key, self.known = (at, skip, size), b"".join(self._lines(kind, at, skip, size))
        found = self.known
        if high > len(found):
            more, need = [], high - len(found)
            for new in self._lines(kind, at, skip + size, None):
                more.append(new)
                need -= len(new)
                if need <= 0:
                    break
            found += b"".join(more)
        return found[low:high]

    def _lines(self, kind: int, at: int, skip: int, size: int | None) -> Iterator[bytes]:
        """Bases of `size` bytes after `skip`, or of all that follow."""
        for raw in self._raw(kind, at, skip, size):
            data = np.frombuffer(raw, np.uint8)
            yield data[~_blank[data]].tobytes()

    def _raw(self, kind: int, at: int, skip: int, size: int | None) -> Iterator[bytes]:
        if kind == BLOCKS:
            for _, raw in blocks(self.f, at, self.size):
                self.read += len(raw)
                raw, skip = raw[skip:], max(0, skip - len(raw))
                if raw:
                    yield raw if size is None else raw[:size]
                    if size is not None and (size := size - len(raw)) <= 0:
                        return
            return
        self.f.seek(at + skip)
        while size is None or size > 0:
            raw = self.f.read(1 << 16 if size is None else size)
            if not raw:
                return
            self.read += len(raw)
            yield raw
            size = None if size is None else size - len(raw)


def _fetched(columns: list[str], kept: int):
    """Adds seq to rows whose columns past the kept ones say what to read."""

    def run(batches):
        reader = Reader()
        for b in batches:
            names = [c for c in columns[:kept]]
            places = list(zip(*(b.column(c).to_pylist() for c in columns[kept:]), strict=True))
            x = 0
            while x < len(places):  # at most some megabytes a batch
                out, total = [], 0
                while x + len(out) < len(places) and total < 4 << 20:
                    out.append(reader.bases(*places[x + len(out)]))
                    total += len(out[-1])
                part = b.slice(x, len(out))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(out, pa.binary())], [*names, "seq"])
                x += len(out)
        reader.close()

    return run


@dataclass(frozen=True)
class Indexed:
    """Sequences by their index. Where functions take a table of sequences, they take this as well."""

    index: DataFrame

    def records(self) -> DataFrame:
        """file, seq_id, seq_len, path, rec of each record; path and rec tell records apart."""
        return self.index.groupBy("path", "rec", "seq_id").agg(F.first("file").alias("file"), F.max("seq_len").alias("seq_len")).select("file", "seq_id", "seq_len", "path", "rec")

    def save(self, path: str, rows_a_file: int = 1 << 14) -> None:
        """The index as Parquet, by seq_id and place, for later sessions and for sources/pieces.py. Names become strings."""
        rows = self.index.withColumn("seq_id", F.col("seq_id").cast("string"))
        rows.repartitionByRange("seq_id", "rec", "base0").sortWithinPartitions("seq_id", "rec", "base0").write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Indexed:
        return Indexed(spark.read.parquet(path))

    def keyed(self, seq_id: Column) -> Indexed:
        """With another seq_id, made of file and seq_id."""
        return Indexed(self.index.withColumn("seq_id", seq_id))

    def where(self, condition) -> Indexed:
        """Records that hold a condition on file, seq_id and seq_len; it goes down to the scan of the index."""
        return Indexed(self.index.where(condition))

    def read(self, rows: DataFrame, kept: list[str]) -> DataFrame:
        """rows (kept columns, index columns, low, high in the record's bases) with the bases as seq, a row each."""
        columns = [*kept, "path", "kind", "at", "skip", "size", "bases", "_low", "_high"]
        placed = rows.select(*kept, *columns[len(kept) : -2], (F.col("low") - F.col("base0")).alias("_low"), (F.col("high") - F.col("base0")).alias("_high"))
        kinds = ", ".join(f"`{c}` {placed.schema[c].dataType.simpleString()}" for c in kept)
        return placed.mapInArrow(_fetched(columns, len(kept)), f"{kinds}, seq binary")

    def pieces(self, overlap: int = 0) -> DataFrame:
        """seq_id, pos0, seq: every base, in pieces that `overlap` bases of what follows are added to. Records without bases have none."""
        spark = self.index.sparkSession
        total = self.index.agg(F.sum("size")).first()[0] or 0
        tasks = max(spark.sparkContext.defaultParallelism, -(-total // SHARE))
        low = F.greatest("base0", F.lit(0))
        rows = self.index.withColumns({"low": low, "high": F.least(F.col("base0") + F.col("bases") + overlap, "seq_len")}).where("low < least(base0 + bases, seq_len)")
        return self.read(rows.withColumn("pos0", F.col("low")).repartition(tasks).sortWithinPartitions("path", "at", "skip"), ["seq_id", "pos0"])

    def stretches(self, size: int, more: int, share: int = SHARE) -> DataFrame:
        """seq_id, n, and what a Reader needs (path, kind, at, skip, size, bases, low, high) for bases n x size to (n + 1) x size + more of each record.

        A row is made from the piece that its first base is in, from which a Reader reads on; nothing is joined.
        """
        spark = self.index.sparkSession
        total = self.index.agg(F.sum("bases")).first()[0] or 0
        tasks = max(2 * spark.sparkContext.defaultParallelism, -(-total // share))
        first, last = F.expr(f"(greatest(base0, 0) + {size - 1}L) div {size}L"), F.expr(f"(least(base0 + bases, seq_len) - 1) div {size}L")
        rows = self.index.where("bases > 0 and base0 < seq_len").withColumns({"_a": first, "_z": last}).where("_a <= _z").withColumn("n", F.explode(F.sequence("_a", "_z")))
        low, high = F.col("n") * size, F.least((F.col("n") + 1) * size + more, "seq_len")
        return rows.select("seq_id", "n", "path", "kind", "at", "skip", "size", "bases", (low - F.col("base0")).alias("low"), (high - F.col("base0")).alias("high")).repartition(tasks).sortWithinPartitions("path", "at", "skip")

    def slices(self, regions: DataFrame, k: int, keys: list[str], bin_: int = BIN) -> DataFrame:
        """seq_id (a struct of the keys), pos0, seq: the regions (keys, seq_id, start, end) cut from their pieces.

        A region's k-mers, those that lie in it whole, are in its slices once each, at their places in the sequence. Rows of
        the index meet regions by bins of bases; only the bytes of pieces that a region touches are read.
        """
        clear = regions.select(F.struct(*keys).alias("_key"), F.col("seq_id").alias("_of"), F.greatest("start", F.lit(0)).cast("bigint").alias("_a"), F.col("end").cast("bigint").alias("_z")).where(F.col("_z") - F.col("_a") >= k)
        wanted = clear.withColumn("_bin", F.explode(F.sequence(F.expr(f"_a div {bin_}L"), F.expr(f"(_z - {k}) div {bin_}L"))))
        here = self.index.where("bases > 0").withColumns({"_x": F.greatest("base0", F.lit(0)), "_y": F.least(F.col("base0") + F.col("bases"), "seq_len")}).where("_x < _y").withColumnRenamed("seq_id", "_of")
        here = here.withColumn("_bin", F.explode(F.sequence(F.expr(f"_x div {bin_}L"), F.expr(f"(_y - 1) div {bin_}L"))))
        both = here.join(wanted, ["_of", "_bin"]).where(F.expr(f"_a < _y and _z - {k} >= _x and _bin = greatest(_a, _x) div {bin_}L"))
        rows = both.select(F.col("_key").alias("seq_id"), "path", "kind", "at", "skip", "size", "bases", "base0", F.greatest("_a", "_x").alias("low"), F.least(F.col("_z"), F.col("_y") + (k - 1), "seq_len").alias("high")).where(F.col("high") - F.col("low") >= k)
        tasks = int(self.index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        near = rows.withColumn("pos0", F.col("low")).repartition(tasks, "path", "at").sortWithinPartitions("path", "at", "skip", "low")
        return self.read(near, ["seq_id", "pos0"])

    def selected(self, ids: list[str]) -> Indexed:
        """The records asked for by name or by chrom:lo-hi, in which case that part; the first file that has one gives it, and of it the first record.

        The list, a caller's, is joined to the index alone.
        """
        spark = self.index.sparkSession
        asked = spark.createDataFrame([(s,) for s in dict.fromkeys(ids)], "asked string")
        group = lambda i: F.regexp_extract("asked", r"^(.*):(\d+)-(\d+)$", i)
        whole = asked.select("asked", F.col("asked").alias("seq_id"), F.lit(0).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi"), F.lit(0).alias("part"))
        part = asked.where(group(1) != "").select("asked", group(1).alias("seq_id"), group(2).cast("bigint").alias("lo"), group(3).cast("bigint").alias("hi"), F.lit(1).alias("part"))
        names = sorted({*ids, *(s.rpartition(":")[0] for s in ids)})
        mine = self.index.where(F.col("seq_id").isin(names)) if len(names) <= 1000 else self.index  # goes down to the scan
        found = Indexed(mine).records().join(F.broadcast(whole.unionByName(part)), "seq_id")
        first = found.withColumn("_r", F.row_number().over(Window.partitionBy("asked").orderBy("part", "file", "rec"))).where("_r = 1")
        best = mine.join(F.broadcast(first.select("path", "seq_id", "rec", "asked", "lo", "hi")), ["path", "seq_id", "rec"])  # a row an asked id
        end = F.greatest(F.lit(0), F.least(F.coalesce("hi", "seq_len"), "seq_len") - F.col("lo"))
        cut = best.withColumns({"base0": F.col("base0") - F.col("lo"), "seq_len": end, "seq_id": F.col("asked")})
        return Indexed(cut.where("base0 < seq_len and base0 + bases > 0 or seq_len = 0").select(self.index.columns))
