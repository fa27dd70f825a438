"""Token ids in files, each id in the fewest bits that the vocabulary needs.

A file holds blocks of BLOCK ids; a block is lanes of 64 ids packed into `bits` 64-bit little-endian words, so that
numpy packs and unpacks all lanes of a block with 64 shifts. After the blocks come the documents' ids and first
tokens and each block's byte offset, then a fixed-size trailer; any document is read from its own blocks alone.

    blocks | int64 doc_ids | uint8 doc_id nulls | uint64 starts (documents + 1) | uint64 block offsets (blocks + 1) |
    trailer: uint32 bits, uint32 block, uint64 documents, uint64 ids, 8 bytes "TOKBITS1"
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ids_and_text, map_batches, scratch, settle, utf8
from .tokens import encoder

BLOCK, LANE, MAGIC = 1 << 16, 64, b"TOKBITS1"
TRAILER = struct.Struct("<IIQQ8s")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids, padded with zeros to whole lanes, in `bits` words a lane."""
    lanes = np.zeros(-(-len(ids) // LANE) * LANE, np.uint64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(-1, LANE)
    out = np.zeros((len(lanes), bits), "<u8")
    for j in range(LANE):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= lanes[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return out.tobytes()


def unpack_bits(raw: bytes, bits: int, n: int) -> np.ndarray:
    words = np.frombuffer(raw, "<u8").reshape(-1, bits)
    out, mask = np.empty((len(words), LANE), np.uint32), np.uint64((1 << bits) - 1)
    for j in range(LANE):
        word, shift = divmod(j * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | words[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = x & mask
    return out.reshape(-1)[:n]


class Writer:
    """Writes one file; holds a block of ids and, for each document, its id and first token."""

    def __init__(self, out, bits: int):
        self.out, self.bits, self.rest, self.size = out, bits, np.zeros(0, np.uint32), 0
        self.docs, self.nulls, self.starts, self.blocks = [], [], [np.zeros(1, np.int64)], [0]

    def add(self, doc_ids: pa.Array, ids: np.ndarray, limits: np.ndarray) -> None:
        self.docs.append(np.asarray(doc_ids.fill_null(0)).astype("<i8"))
        self.nulls.append(np.asarray(doc_ids.is_null()).astype(np.uint8))
        self.starts.append(self.size + limits[1:])
        self.size += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            self._block(ids[i : i + BLOCK])
        self.rest = ids[whole:].astype(np.uint32)

    def _block(self, ids: np.ndarray) -> None:
        raw = pack_bits(ids, self.bits)
        self.out.write(raw)
        self.blocks.append(self.blocks[-1] + len(raw))

    def close(self) -> tuple[int, int]:
        if len(self.rest):
            self._block(self.rest)
        docs = np.concatenate([np.zeros(0, "<i8"), *self.docs])
        for part in (docs, np.concatenate([np.zeros(0, np.uint8), *self.nulls]), np.concatenate(self.starts).astype("<u8"), np.array(self.blocks, "<u8")):
            self.out.write(part.tobytes())
        self.out.write(TRAILER.pack(self.bits, BLOCK, len(docs), self.size, MAGIC))
        return len(docs), self.size


class Reader:
    """Random access to a file of Writer's."""

    def __init__(self, f, size: int):
        self.f = f
        f.seek(size - TRAILER.size)
        self.bits, self.block, self.n, self.size, magic = TRAILER.unpack(f.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        blocks = -(-self.size // self.block)
        index = 8 * self.n + self.n + 8 * (self.n + 1) + 8 * (blocks + 1)
        f.seek(size - TRAILER.size - index)
        raw = f.read(index)
        self.doc_ids = np.frombuffer(raw, "<i8", self.n)
        self.nulls = np.frombuffer(raw, np.uint8, self.n, 8 * self.n).astype(bool)
        self.starts = np.frombuffer(raw, "<u8", self.n + 1, 9 * self.n).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1, 17 * self.n + 8).astype(np.int64)

    def ids(self, a: int, z: int) -> np.ndarray:
        """Ids a to z of the file, from the blocks that hold them."""
        if a >= z:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, (z - 1) // self.block
        self.f.seek(int(self.offsets[first]))
        raw = self.f.read(int(self.offsets[last + 1] - self.offsets[first]))
        lane = 8 * self.bits
        skip = (a - first * self.block) // LANE
        upto = -(-(z - first * self.block) // LANE)
        return unpack_bits(raw[skip * lane : upto * lane], self.bits, z - first * self.block - skip * LANE)[a - first * self.block - skip * LANE :]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


KEY = "struct<known:boolean,id:bigint,tie:bigint,u:bigint>"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and key, by which rows are in the files' order: null ids first, equal ids by a hash of the text, and equal rows at random."""
    rows = ids_and_text(docs)
    return rows.withColumn("key", F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("id"), F.xxhash64("text").alias("tie"), F.xxhash64(F.monotonically_increasing_id()).alias("u")))


def bounds(docs: DataFrame) -> list[tuple[bool, int, int, int]]:
    """Where each file but the first begins: a key for each shuffle partition, from the keys alone."""
    narrow = keyed(docs).select("key").repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    least = narrow.select("key", F.spark_partition_id().alias("p")).groupBy("p").agg(F.min("key").alias("key")).collect()  # a row a partition
    return sorted(tuple(r.key) for r in least)[1:]


def write_tokens(docs: DataFrame, tokenizer: str, end: int, where: str | None = None) -> DataFrame:
    """Writes the ids of all documents, each ended by `end`, in ascending doc_id order (null first; equal ids by a hash
    of the text). Returns the files in order: shard, path, n_docs, n_tokens, base (ids in the files before).

    Texts are encoded where they are read; what is shuffled are their ids, 2 or 4 bytes each, to the file that holds
    their place in the order. Rows that are equal in id and text may be dealt to several files in a row.

    Null and empty texts are `end` alone; other columns are ignored; no rows give no files. Each task writes under a
    name of its own and moves the file into place once it is whole, so a task that runs again does no harm.
    """
    spark = docs.sparkSession
    where = where or scratch(spark, "tokens")
    limits = bounds(docs)

    def encoded(batches):
        enc = encoder(tokenizer)
        for b in batches:
            ids, at = enc.encode(b.column("text"), end=end)
            raw = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(at * ids.itemsize), pa.py_buffer(ids)])
            part = [bisect_right(limits, (k["known"], k["id"], k["tie"], k["u"])) for k in b.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(part, pa.int32()), pa.array(np.full(b.num_rows, ids.itemsize, np.int32)), raw.cast(pa.binary())], ["doc_id", "key", "part", "width", "ids"])

    rows = map_batches(keyed(docs), encoded, f"doc_id bigint, key {KEY}, part int, width int, ids binary")
    ordered = rows.repartitionById(len(limits) + 1, "part").sortWithinPartitions("key").select("doc_id", "width", "ids")
    vocabulary = max(encoder(tokenizer).vocab, end + 1)

    def shards(batches):
        task, writer = TaskContext.get(), None
        fs, folder = pfs.FileSystem.from_uri(where)
        name = f"{folder}/shard-{task.partitionId():06d}.tok"
        mine = f"{name}.attempt-{task.taskAttemptId()}"
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                fs.create_dir(folder, recursive=True)
                stream = fs.open_output_stream(mine)
                writer = Writer(stream, bits_for(vocabulary))
            raw, at = utf8(b.column("ids"))
            width = b.column("width")[0].as_py()
            writer.add(b.column("doc_id"), np.frombuffer(raw.tobytes(), f"<u{width}"), at // width)
        if writer is not None:
            n, size = writer.close()
            stream.close()
            settle(fs, mine, name)
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([f"{where}/shard-{task.partitionId():06d}.tok"]), pa.array([n]), pa.array([size])], ["shard", "path", "n_docs", "n_tokens"])

    files = sorted(cut(map_batches(ordered, shards, "shard int, path string, n_docs bigint, n_tokens bigint")).collect())  # one row a file
    bases = np.concatenate([[0], np.cumsum([f.n_tokens for f in files], dtype=np.int64)]).tolist()
    return spark.createDataFrame([(*f, b) for f, b in zip(files, bases, strict=False)], "shard int, path string, n_docs bigint, n_tokens bigint, base bigint")


def read_tokens(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """The documents of files that write_tokens returned: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    n = max(1, files.count())

    def documents(batches):
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                fs, name = pfs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as f:
                    r = Reader(f, fs.get_file_info(name).size)
                    i = 0
                    while i < r.n:
                        j = max(i + 1, min(i + 5000, int(np.searchsorted(r.starts, r.starts[i] + (4 << 20), "right")) - 1))
                        at = r.starts[i : j + 1]
                        ids = r.ids(int(at[0]), int(at[-1])).astype("<u4")
                        raw = memoryview(ids).cast("B")
                        lim = ((at - at[0]) * 4).tolist()
                        crc = [zlib.crc32(raw[x:y]) for x, y in zip(lim, lim[1:], strict=False)]
                        cols = [pa.array(r.doc_ids[i:j], pa.int64(), mask=r.nulls[i:j]), pa.array(base + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            cols.append(pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(cols, names)
                        i = j

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return map_batches(files.select("path", "base").repartition(n), documents, schema)
