"""WARC files, and a Merkle audit of their replicas.

Pages are written as gzip WARC files, a member a record, with an index of records and their byte ranges. A leaf of a
file's tree hashes a record's place and stored bytes; FAN nodes in order have a parent, up to the file's root, and
files' roots go on in the same way up to one root for the replica. A replica's nodes are written by level; the lowest
levels are hashed in the pass that reads the bytes. Two replicas are compared from the root down: equal roots end it,
and else only the children of nodes that differ are read and compared, level by level. What differs at the bottom are
the damaged records. Ranges come from the index, so no damage can mislead a parser.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, empty_if_null, map_batches, scratch, settle

FAN, RUN = 16, 2  # children a node; levels above the leaves that are hashed where the bytes are read
FEW = 1 << 17  # nodes that are broadcast
INDEX = "shard bigint, seq bigint, page_id bigint, offset bigint, length bigint, n_bytes bigint, record_sha256 binary"


def record(page_id: int | None, url: str, html: bytes) -> bytes:
    """A page's record. A url's line ends are removed, so that it can't add headers."""
    url = url.replace("\r", "").replace("\n", "")
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html\r\nContent-Length: {len(html)}\r\n\r\n"
    return head.encode() + html + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member, the same bytes for the same record."""
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def name_of(shard: int) -> str:
    return f"shard-{shard:09d}.warc.gz"


def write_warc(pages: DataFrame, where: str) -> DataFrame:
    """Writes all pages and returns the index, a row for each record, by shard and seq.

    Null urls and html are empty. Repeated and null page_ids have records each. A partition of pages becomes a file, its
    records in the order read, so nothing is shuffled and no key can crowd a file. Other columns are ignored; no rows
    give no files. A task writes a file under a name of its own and then moves it into place, so one that runs again
    does no harm.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), empty_if_null("url"), empty_if_null("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pfs.FileSystem.from_uri(where)
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        mine, out, seq, at = f"{folder}/{name_of(shard)}.attempt-{attempt}", None, 0, 0
        for b in batches:
            if out is None and b.num_rows:
                fs.create_dir(folder, recursive=True)
                out = fs.open_output_stream(mine)
            found = []
            for page, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                raw = record(page, url, html.encode())
                stored = member(raw)
                out.write(stored)
                found.append((shard, seq, page, at, len(stored), len(raw), hashlib.sha256(raw).digest()))
                seq, at = seq + 1, at + len(stored)
            cols = list(zip(*found, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 6 else pa.int64()) for i, c in enumerate(cols)], [c.split()[0] for c in INDEX.split(", ")])
        if out is not None:
            out.close()
            settle(fs, mine, f"{folder}/{name_of(shard)}")

    return cut(map_batches(rows, run, INDEX))


def read_warc(index: DataFrame, where: str) -> DataFrame:
    """shard, seq, page_id, url, html of the records that are whole; one that can't be read has null url and html. An empty index gives no rows."""

    def run(batches):
        for b in batches:
            url, html = [], []
            for stored in ranges(b, where):
                try:
                    head, _, rest = zlib.decompress(stored, 31).partition(b"\r\n\r\n")
                    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                    body = rest[: int(fields["Content-Length"])].decode()
                    url.append(fields["WARC-Target-URI"])
                    html.append(body)
                except (zlib.error, KeyError, ValueError):
                    url.append(None)
                    html.append(None)
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("seq"), b.column("page_id"), pa.array(url, pa.string()), pa.array(html, pa.string())], ["shard", "seq", "page_id", "url", "html"])

    return map_batches(in_order(index), run, "shard bigint, seq bigint, page_id bigint, url string, html string")


def in_order(index: DataFrame) -> DataFrame:
    """The index dealt out by runs of FAN^RUN records, so that a file of any size is read by many tasks."""
    return index.repartition("shard", F.expr(f"seq div {FAN**RUN}")).sortWithinPartitions("shard", "seq")


def ranges(b: pa.RecordBatch, where: str) -> Iterator[bytes]:
    """The stored bytes of an index batch's records; empty where a file or range is missing."""
    fs, folder = pfs.FileSystem.from_uri(where)
    f, now = None, None
    for shard, offset, length in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
        if shard != now:
            if f is not None:
                f.close()
            try:
                f = fs.open_input_file(f"{folder}/{name_of(shard)}")
            except FileNotFoundError:
                f = None
            now = shard
        yield b"" if f is None or offset >= f.size() else f.read_at(length, offset)
    if f is not None:
        f.close()


def tails(index: DataFrame) -> DataFrame:
    """A range for what a file has beyond its last record: nothing, if it is whole."""
    return index.groupBy("shard").agg((F.max("seq") + 1).alias("seq"), F.max(F.col("offset") + F.col("length")).alias("offset")).select("shard", "seq", "offset", F.lit(1).cast("bigint").alias("length"))


def leaves(index: DataFrame, where: str) -> DataFrame:
    """level, shard, idx, hash of each record's place and stored bytes and of each file's first byte beyond its records (level 0), and of the nodes above, up to level RUN."""
    every = index.select("shard", "seq", "offset", "length").unionByName(tails(index))

    def nodes(shard: int, kids: list[tuple[int, bytes]]) -> list[tuple[int, int, int, bytes]]:
        out = []
        for level in range(RUN + 1):
            out += [(level, shard, *kid) for kid in kids]
            kids = [(idx, parent(list(group))) for idx, group in groupby(kids, lambda kid: kid[0] // FAN)]
        return out

    def batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["level", "shard", "idx", "hash"])

    def run(batches):
        at, found = None, []
        for b in batches:
            places, done = np.stack([np.asarray(b.column(c)).astype("<i8") for c in ("offset", "length")], axis=1), []
            for shard, seq, place, stored in zip(b.column("shard").to_pylist(), b.column("seq").to_pylist(), places, ranges(b, where), strict=True):
                if at != (shard, seq // FAN**RUN):
                    done += nodes(at[0], found) if at else []
                    at, found = (shard, seq // FAN**RUN), []
                found.append((seq, hashlib.sha256(b"\0" + place.tobytes() + stored).digest()))
            if done:
                yield batch(done)
        if at:
            yield batch(nodes(at[0], found))

    return map_batches(in_order(every), run, NODES)


NODES = "level int, shard bigint, idx bigint, hash binary"


def parent(kids: list[tuple[int, bytes]]) -> bytes:
    """The hash of a node over its children's numbers and hashes."""
    return hashlib.sha256(b"\1" + ",".join(f"{idx}:{h.hex().upper()}" for idx, h in kids).encode()).digest()


def parents(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The nodes above, hashed as parent() does: each over its children, FAN at most, in order and with their numbers."""
    child = F.struct("idx", "hash")
    kids = nodes.groupBy(*keys, F.floor(F.col("idx") / FAN).alias("idx")).agg(F.array_sort(F.collect_list(child)).alias("kids"))
    text = F.array_join(F.transform("kids", lambda c: F.concat_ws(":", c["idx"].cast("string"), F.hex(c["hash"]))), ",")
    return kids.select(*keys, "idx", F.unhex(F.sha2(F.concat(F.lit("\1"), text).cast("binary"), 256)).alias("hash"))


def levels_for(n: int) -> int:
    """Steps of FAN from n nodes to one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def tree(index: DataFrame, where: str) -> tuple[list[DataFrame], int]:
    """A replica's nodes (shard, idx, hash) by level, and the level of files' roots.

    Up to that level idx is within the shard; above it shard is 0 and idx a shard number less the smallest, divided by
    FAN at each step. The last level is the replica's root. An empty index has no nodes.
    """
    spark, path = index.sparkSession, scratch(index.sparkSession, "tree")
    sizes = index.agg((F.max("seq") + 2).alias("n"), F.min("shard").alias("low"), F.max("shard").alias("high")).first()
    inner = max(RUN, levels_for(sizes.n or 1))
    top = inner + 1 + levels_for((sizes.high - sizes.low + 1) if sizes.n else 1)
    leaves(index, where).write.partitionBy("level").parquet(path)
    at = lambda level: spark.read.schema(NODES).parquet(path).where(F.col("level") == level).select("shard", "idx", "hash")
    levels = [at(level) for level in range(RUN + 1)] if sizes.n else [spark.createDataFrame([], NODES).drop("level")] * (RUN + 1)
    for level in range(RUN + 1, top + 1):
        below = levels[-1]
        if level == inner + 1:
            levels.append(below.select(F.lit(0).cast("bigint").alias("shard"), (F.col("shard") - F.lit(sizes.low or 0)).alias("idx"), "hash"))
        else:
            levels.append(cut(parents(below, ["shard"])))
    return levels, inner


def descend(a: list[DataFrame], b: list[DataFrame], inner: int, low: int) -> tuple[DataFrame, list[int]]:
    """shard, idx of the leaves that differ between two trees, and how many nodes were compared at each level, from the root down."""
    differing, seen = None, []
    for level in range(len(a) - 1, -1, -1):
        kids = [a[level], b[level]]
        if differing is not None and level == inner:  # from places in the tree of files to the files themselves
            differing = differing.select((F.col("idx") + low).alias("shard"), F.lit(0).cast("bigint").alias("idx"))
            kids = [k.join(F.broadcast(differing) if few else differing, ["shard", "idx"], "left_semi") for k in kids]
        elif differing is not None:
            up = differing.select("shard", F.col("idx").alias("_up"))
            kids = [k.withColumn("_up", F.floor(F.col("idx") / FAN)).join(F.broadcast(up) if few else up, ["shard", "_up"], "left_semi").drop("_up") for k in kids]
        both = cut(kids[0].join(kids[1].withColumnRenamed("hash", "other"), ["shard", "idx"], "full"))
        differing = both.where("not hash <=> other").select("shard", "idx")
        seen.append(both.count())
        found = differing.count()
        few = found <= FEW
        if not found:
            break
    return differing, seen


def files(spark: SparkSession, where: str) -> DataFrame:
    """file: names in a replica's folder, those of attempts apart. A folder that isn't there has none."""
    fs, folder = pfs.FileSystem.from_uri(where)
    found = fs.get_file_info(pfs.FileSelector(folder, allow_not_found=True))  # a name a file, as any reader lists them
    return spark.createDataFrame([(f.base_name,) for f in found if f.type == pfs.FileType.File and ".attempt-" not in f.base_name], "file string")


def extra_files(index: DataFrame, one: str, other: str) -> DataFrame:
    """file, replica ("one" or "other"): files that the index doesn't know and only one replica has."""
    spark = index.sparkSession
    known = index.select(F.format_string("shard-%09d.warc.gz", "shard").alias("file")).distinct()
    a, b = (files(spark, w).join(known, "file", "left_anti") for w in (one, other))
    return a.join(b, "file", "left_anti").withColumn("replica", F.lit("one")).unionByName(b.join(a, "file", "left_anti").withColumn("replica", F.lit("other")))


def audit(index: DataFrame, one: str, other: str) -> DataFrame:
    """shard, seq of the records whose stored bytes differ between two replicas (seq one beyond the last: more bytes follow).

    A record that only one of them has differs. Files that the index doesn't know are extra_files' matter. No rows if the
    roots are equal. An empty index gives no rows.
    """
    a, inner = tree(index, one)
    b, _ = tree(index, other)
    low = index.agg(F.min("shard").alias("low")).first().low or 0
    bad, seen = descend(a, b, inner, low)
    return bad.select("shard", F.col("idx").alias("seq")) if len(seen) == len(a) else bad.limit(0).select("shard", F.col("idx").alias("seq"))


def copied(index: DataFrame, one: str, other: str, damaged: Column) -> None:
    """Makes a replica, a shard a task. Records for which `damaged` holds get one bit flipped in their middle: a case to audit."""
    marks = index.select("shard", "seq", F.when(damaged, F.col("offset") + F.expr("length div 2")).otherwise(-1).alias("at"), "offset", "length").repartition("shard").sortWithinPartitions("shard", "seq")

    def run(batches):
        fs, to = pfs.FileSystem.from_uri(other)
        attempt = TaskContext.get().taskAttemptId()
        fs.create_dir(to, recursive=True)
        out, now = None, None

        def close():
            if out is not None:
                out.close()
                settle(fs, f"{to}/{name_of(now)}.attempt-{attempt}", f"{to}/{name_of(now)}")

        for b in batches:
            for shard, at, offset, stored in zip(b.column("shard").to_pylist(), b.column("at").to_pylist(), b.column("offset").to_pylist(), ranges(b, one), strict=True):
                if shard != now:
                    close()
                    now, out = shard, fs.open_output_stream(f"{to}/{name_of(shard)}.attempt-{attempt}")
                if at >= 0:
                    stored = bytearray(stored)
                    stored[at - offset] ^= 1
                out.write(bytes(stored))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])
        close()

    cut(map_batches(marks, run, "n bigint"))
