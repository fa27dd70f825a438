"""Sorted tables of numbers that tasks look up by key range, a bounded number of pages at a time.

Rows are dealt out by ranges of the key and written in pages of PAGE rows by the tasks that have them. What the driver
keeps is each page's first key and path: an entry for PAGE rows.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import cut, map_batches, scratch, settle

#: Rows of a page, and the pages that a worker holds.
PAGE, PAGES = 1 << 16, 64


def write_pages(rows: DataFrame, columns: list[str], order: list[str]) -> list[tuple[int, str]]:
    """Writes bigint columns, ordered by `order`, the first of which is columns[0], the key; (first key, path) of each page."""
    spark = rows.sparkSession
    where = scratch(spark, "pages")

    def put(batches):
        fs, folder = pfs.FileSystem.from_uri(where)
        fs.create_dir(folder, recursive=True)
        task, held, size, n = TaskContext.get(), [], 0, 0

        def close():
            page = np.concatenate(held, axis=1)
            name = f"page-{task.partitionId():06d}-{n:06d}"
            mine = f"{folder}/{name}.attempt-{task.taskAttemptId()}"
            with fs.open_output_stream(mine) as f:
                f.write(page.tobytes())
            settle(fs, mine, f"{folder}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([int(page[0, 0])]), pa.array([f"{where}/{name}"])], ["first", "path"])

        for b in batches:
            if b.num_rows:
                held.append(np.stack([np.asarray(b.column(c)).astype("<i8") for c in columns]))
                size += b.num_rows
            if size >= PAGE:
                yield close()
                held, size, n = [], 0, n + 1
        if held:
            yield close()

    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    return sorted(tuple(r) for r in cut(map_batches(ordered.select(*columns), put, "first bigint, path string")).collect())


class Pages:
    """Reads what write_pages wrote."""

    def __init__(self, pages: list[tuple[int, str]], columns: int, most: int | None = None):
        self.first, self.paths, self.columns = np.array([p[0] for p in pages], np.int64), [p[1] for p in pages], columns
        self.held, self.most = OrderedDict(), most or PAGES

    def page(self, i: int) -> np.ndarray:
        if i not in self.held:
            fs, name = pfs.FileSystem.from_uri(self.paths[i])
            with fs.open_input_stream(name) as f:
                self.held[i] = np.frombuffer(f.read(), "<i8").reshape(self.columns, -1)
            if len(self.held) > self.most:
                self.held.popitem(last=False)
        self.held.move_to_end(i)
        return self.held[i]

    def between(self, low: int, high: int) -> np.ndarray:
        """All rows whose key is from low to high, in order, as an array of columns."""
        found = [np.zeros((self.columns, 0), np.int64)]
        for i in range(max(0, int(np.searchsorted(self.first, low, "left")) - 1), int(np.searchsorted(self.first, high, "right"))):
            page = self.page(i)
            x, y = np.searchsorted(page[0], low, "left"), np.searchsorted(page[0], high, "right")
            found.append(page[:, x:y])
        return np.concatenate(found, axis=1)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The rows of ascending keys, each of which has one."""
        out = np.zeros((self.columns, len(keys)), np.int64)
        place = np.searchsorted(self.first, keys, "right") - 1
        cuts = [0, *(np.nonzero(np.diff(place))[0] + 1).tolist(), len(keys)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if x < y:
                page = self.page(int(place[x]))
                out[:, x:y] = page[:, np.searchsorted(page[0], keys[x:y])]
        return out
