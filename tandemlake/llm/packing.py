"""Packing by concatenate and cut.

All documents' ids, each ended by a separator, are one long stream; it is cut every `length` ids. Pass one encodes
each partition once, writes the ids with their offsets inside the partition, and sums the partitions' totals; prefix
sums of those totals (one number a partition) make the offsets global. Pass two cuts each document at the window
limits and leaves a boundary record for each piece. Only the stream's last window is short.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_text, map_batches, written
from .tokens import encoder

LENGTH, SEPARATOR = 1024, 0


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = SEPARATOR, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids
    (little-endian unsigned, 2 or 4 bytes an id).

    docs: doc_id and text; other columns are ignored. Null and empty texts are the separator alone. Rows with a
    null or repeated doc_id are documents of their own. Equal texts are packed again. No rows give no rows. The
    order of documents in the stream is that of the partitions read; it is fixed by the first pass's written rows.
    """

    def encoded(batches):
        part, at = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer)
        for b in batches:
            ids, limits = enc.encode(b.column("text"), end=end)
            raw = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(limits * ids.itemsize), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(at + limits[:-1]), pa.array(np.full(b.num_rows, ids.itemsize, np.int32)), raw.cast(pa.binary())], ["doc_id", "part", "at", "width", "ids"])
            at += int(limits[-1])

    rows = written(map_batches(ids_and_text(docs), encoded, "doc_id bigint, part int, at bigint, width int, ids binary"), "packed")
    totals = rows.groupBy("part").agg(F.max(F.col("at") + F.expr("octet_length(ids) div width")).alias("n")).orderBy("part").collect()  # one row a partition
    bases = dict(zip((r.part for r in totals), np.concatenate([[0], np.cumsum([r.n for r in totals], dtype=np.int64)]).tolist(), strict=False))

    def pieces(batches):
        for b in batches:
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            for doc, part, at, width, raw in zip(*(b.column(k).to_pylist() for k in ("doc_id", "part", "at", "width", "ids")), strict=True):
                ids, base = np.frombuffer(raw, f"<u{width}"), bases[part] + at
                wide = memoryview(ids.astype("<u4")).cast("B")
                cuts = [0, *range(length - base % length, len(ids), length), len(ids)]
                for a, z in zip(cuts, cuts[1:], strict=False):
                    out["start"].append(a)
                    out["length"].append(z - a)
                    out["ids_crc32"].append(zlib.crc32(wide[4 * a : 4 * z]))
                    out["sequence_id"].append((base + a) // length)
                    out["offset"].append((base + a) % length)
                    out["ids"].append(raw[width * a : width * z] if with_ids else b"")
                out["doc_id"] += [doc] * (len(cuts) - 1)
                out["doc_tokens"] += [len(ids)] * (len(cuts) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()], list(out))

    got = map_batches(rows, pieces, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
    return got if with_ids else got.drop("ids")


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """The sequences themselves: sequence_id, n_ids, ids (array<int>), and boundaries (doc_id, start, offset, length).

    pieces: pack's rows with their ids, whose width (2 or 4 bytes) a piece's length tells. At most `length` ids meet in a
    group. A short sequence is padded to `length` unless its size is a power of two. No pieces give no sequences.
    """
    laid = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids"))).alias("p"))

    def joined(batches):
        for b in batches:
            n, ids = [], []
            for p in b.column("p").to_pylist():
                x = np.concatenate([np.frombuffer(q["ids"], f"<u{len(q['ids']) // q['length']}") for q in p]).astype(np.int32)
                n.append(len(x))
                ids.append(x if len(x) & (len(x) - 1) == 0 else np.pad(x, (0, length - len(x)), constant_values=pad))
            yield pa.RecordBatch.from_arrays([b.column("sequence_id"), pa.array(n, pa.int32()), pa.array(ids, pa.list_(pa.int32())), b.column("boundaries")], ["sequence_id", "n_ids", "ids", "boundaries"])

    cols = laid.select("sequence_id", "p", F.expr("transform(p, x -> struct(x.doc_id, x.start, x.offset, x.length))").alias("boundaries"))
    return map_batches(cols, joined, "sequence_id bigint, n_ids int, ids array<int>, boundaries array<struct<doc_id:bigint,start:bigint,offset:bigint,length:bigint>>")
