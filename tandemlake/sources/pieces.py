"""spark.read.format("fasta_pieces"): pieces of indexed sequences as a table.

    Indexed(...).save("index")
    read_pieces(spark, "index").where("seq_id = 'chr1' and pos0 < 1000000")

Partitions are runs of index rows, each of which names a byte range of a file. What a query asks of seq_id and pos0 is
pushed down: index files whose statistics rule it out make no partition, and of the others only bytes of rows that hold it
are read. Spark wants spark.sql.python.filterPushdown.enabled for that, which read_pieces sets for the session.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .indexed import Reader
from .scratch import opened

#: Rows of an index that make a partition: at 256 KB each, 16 MB.
ROWS = 64
SCHEMA = "file string, seq_id string, seq_len bigint, pos0 bigint, seq binary"
_column = {"seq_id": "seq_id", "pos0": "base0", "file": "file", "seq_len": "seq_len"}
_test = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def _expression(f: Filter) -> pc.Expression | None:
    """A filter as one on the index; None for one that stays with Spark."""
    if type(f) not in (*_test, In) or len(f.attribute) != 1 or f.attribute[0] not in _column or getattr(f, "value", 0) is None:
        return None
    field = pc.field(_column[f.attribute[0]])
    return field.isin([v for v in f.value if v is not None]) if isinstance(f, In) else _test[type(f)](field, f.value)


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    end: int


class PiecesReader(DataSourceReader):
    def __init__(self, index: str):
        self.index, self.tests = index, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if _expression(f) is None:
                yield f
            else:
                self.tests.append(f)

    def _where(self) -> pc.Expression:
        return reduce(operator.and_, map(_expression, self.tests), pc.field("bases") > 0)

    def partitions(self) -> list[Rows]:
        fs, root = opened(self.index)
        out = []
        for part in pads.dataset(root, filesystem=fs, format="parquet").get_fragments():
            part.ensure_complete_metadata()
            for group in part.subset(self._where()).row_groups if part.row_groups else []:
                start = sum(g.num_rows for g in part.row_groups if g.id < group.id)
                out += [Rows(part.path, x, min(x + ROWS, start + group.num_rows)) for x in range(start, start + group.num_rows, ROWS)]
        return out or [Rows("", 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = opened(self.index)
        rows = pads.dataset(partition.path, filesystem=fs, format="parquet").to_table().slice(partition.first, partition.end - partition.first).filter(self._where())
        reader = Reader()
        for r in rows.to_pylist():
            seq = reader.bases(r["path"], r["kind"], r["at"], r["skip"], r["size"], r["bases"], 0, r["bases"])
            yield pa.RecordBatch.from_arrays([pa.array([r["file"]], pa.string()), pa.array([r["seq_id"]], pa.string()), pa.array([r["seq_len"]]), pa.array([r["base0"]]), pa.array([seq], pa.binary())], ["file", "seq_id", "seq_len", "pos0", "seq"])
        reader.close()


class Pieces(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_pieces"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PiecesReader:
        return PiecesReader(self.options["index"])


def read_pieces(spark: SparkSession, index: str) -> DataFrame:
    """file, seq_id, seq_len, pos0, seq: the pieces of a saved index's sequences."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Pieces)
    return spark.read.format("fasta_pieces").option("index", index).load()
