"""Masking of annotated intervals in sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.fasta import LINE
from ..sources.folder import safe, write_files
from ..sources.indexed import BIN, Indexed, Reader


def masked(seqs: DataFrame, intervals: DataFrame, soft: bool = False) -> DataFrame:
    """seqs with the bases of intervals(seq_id, start, end) as N, or in lower case. Intervals may overlap and reach beyond the sequence."""
    each = intervals.groupBy("seq_id").agg(F.collect_list("start").alias("_a"), F.collect_list("end").alias("_z"))
    rows = seqs.join(each, "seq_id", "left")

    def run(batches):
        for b in batches:
            out = []
            for seq, a, z in zip(b.column("seq").to_pylist(), b.column("_a").to_pylist(), b.column("_z").to_pylist(), strict=True):
                if seq is not None and a:
                    s = np.frombuffer(seq.encode(), np.uint8).copy()
                    for x, y in zip(a, z, strict=True):
                        x, y = max(0, x), max(0, y)
                        s[x:y] = np.frombuffer(s[x:y].tobytes().lower(), np.uint8) if soft else ord("N")
                    seq = s.tobytes().decode()
                out.append(seq)
            keep = [n for n in b.schema.names if n not in ("_a", "_z")]
            yield pa.RecordBatch.from_arrays([pa.array(out, b.schema.field("seq").type) if n == "seq" else b.column(n) for n in keep], keep)

    return rows.select(*seqs.columns, "_a", "_z").mapInArrow(run, seqs.schema)


def _masked(bases: bytes, marks: list[dict], soft: bool) -> bytes:
    s = np.frombuffer(bases, np.uint8).copy()
    for m in marks:
        s[m["a"] : m["z"]] = np.frombuffer(s[m["a"] : m["z"]].tobytes().lower(), np.uint8) if soft else ord("N")
    return s.tobytes()


def _marked(seqs: Indexed, intervals: DataFrame) -> DataFrame:
    """The index's pieces with what to read of each (low, high) and the stretches of it to mask, counted from there (_marks)."""
    low, high = F.greatest("base0", F.lit(0)), F.least(F.col("base0") + F.col("bases"), "seq_len")
    pieces = seqs.index.withColumns({"low": low, "high": F.greatest(low, high)})
    bins = lambda a, z: F.explode(F.sequence(F.expr(f"{a} div {BIN}L"), F.expr(f"({z} - 1) div {BIN}L")))
    wanted = intervals.select("seq_id", F.greatest("start", F.lit(0)).cast("bigint").alias("_a"), F.col("end").cast("bigint").alias("_z")).where("_a < _z").distinct().withColumn("_bin", bins("_a", "_z"))
    met = pieces.where("low < high").withColumn("_bin", bins("low", "high")).join(wanted, ["seq_id", "_bin"]).where("_a < high and _z > low")
    key = ["path", "at", "skip", "seq_id", "base0"]
    part = F.struct((F.greatest("_a", "low") - F.col("low")).alias("a"), (F.least("_z", "high") - F.col("low")).alias("z"))
    marks = met.groupBy(*key).agg(F.collect_set(part).alias("_marks"))  # by their ends within a piece
    return pieces.join(marks, key, "left")


def masked_pieces(seqs: Indexed, intervals: DataFrame, soft: bool = False) -> DataFrame:
    """seq_id, pos0, seq: the pieces of indexed sequences with the bases of intervals(seq_id, start, end) as N, or in lower case.

    Intervals are joined to index rows; no sequence is. They may overlap, repeat and reach beyond the sequence.
    """
    rows = _marked(seqs, intervals).where("low < high").withColumn("pos0", F.col("low"))
    kind = rows.schema["seq_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            seq = [_masked(s, m, soft) if m else s for s, m in zip(b.column("seq").to_pylist(), b.column("_marks").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("seq_id"), b.column("pos0"), pa.array(seq, pa.binary())], ["seq_id", "pos0", "seq"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return seqs.read(rows.repartition(tasks, "path", "at"), ["seq_id", "pos0", "_marks"]).mapInArrow(run, f"seq_id {kind}, pos0 bigint, seq binary")


def write_masked(seqs: Indexed, intervals: DataFrame, path: str, soft: bool = False) -> None:
    """A FASTA file for each seq_id, {seq_id}.fa, of its records with intervals masked.

    Index rows are dealt out by seq_id; a task reads, masks and writes a record piece by piece, so its length doesn't
    matter. Files of an earlier run go; a run that fails changes nothing. A record without bases is its header alone.
    """
    rows = _marked(seqs, intervals).select(F.coalesce(F.col("seq_id").cast("string"), F.lit("")).alias("name"), "file", "path", "kind", "at", "skip", "size", "bases", "base0", "low", "high", "rec", "_marks")

    def contents(batches):
        reader, now, line = Reader(), None, 0
        for b in batches:
            for r in b.to_pylist():
                file = safe(r["name"]).replace(":", "%3A") + ".fa"  # Hadoop's file names have no colons
                head = b""
                if (r["name"], r["path"], r["rec"]) != now:
                    head = (b"\n" if now and now[0] == r["name"] and line else b"") + f">{r['name']}\n".encode()
                    now, line = (r["name"], r["path"], r["rec"]), 0
                seq = reader.bases(r["path"], r["kind"], r["at"], r["skip"], r["size"], r["bases"], r["low"] - r["base0"], r["high"] - r["base0"]) if r["low"] < r["high"] else b""
                seq = _masked(seq, r["_marks"], soft) if r["_marks"] else seq
                cuts = [0, *range(LINE - line, len(seq), LINE), len(seq)]
                out = b"\n".join(seq[x:y] for x, y in zip(cuts, cuts[1:], strict=False)) if seq else b""
                line = (line + len(seq)) % LINE if seq else line
                if seq and line == 0:
                    out += b"\n"
                yield file, head + out
        reader.close()

    write_files(rows, ["name"], ["file", "path", "rec", "low"], contents, path, ".fa")


def chosen(named: DataFrame, what: tuple[str | int, ...] = (), periods: DataFrame | None = None) -> DataFrame:
    """The intervals to mask: all, also if ALL is asked for; those of given names, whatever their case; or those whose commonest distance is a given number.

    periods: seq_id, start, end, period.
    """
    if not what or "ALL" in what:
        return named
    names = [w.lower() for w in what if isinstance(w, str)]
    lengths = [w for w in what if isinstance(w, int)]
    got = named.where(F.lower("name").isin(names) if names else F.lit(False))
    if lengths and periods is not None:
        got = got.unionByName(named.join(periods.where(F.col("period").isin(lengths)).select("seq_id", "start", "end"), ["seq_id", "start", "end"], "left_semi")).distinct()
    return got


def as_length(value: str) -> str | int:
    """An option's value: a number if it is one."""
    return int(value) if value.lstrip("-").isdigit() else value


def asked(option: Column) -> Column:
    """The same of a column: struct(length, name), one of which is null."""
    number = option.rlike("^-*[0-9]+$")
    return F.struct(F.when(number, option.cast("bigint")).alias("length"), F.when(~number, option).alias("name"))
