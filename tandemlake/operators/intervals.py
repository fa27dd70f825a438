"""Interval rules of a sequence's spans: one pass over each sorted list of intervals that can meet.

Whether an interval stays depends on those kept before it, so they are gone through in order. But no rule reaches over a
gap: where an interval begins further than the rule's reach beyond everything before it, a new list begins. Gaps are
looked for between bins of a sequence, from a row a bin; what lies between two gaps is a group, and groups, not sequences,
are dealt out to tasks. Rows stream through.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut


class Conflicts:
    """The intervals kept so far, by ascending start: what is near or inside one of them goes."""

    def __init__(self, tolerance: int):
        self.tolerance, self.last, self.widest, self.ends = tolerance, None, None, []

    def keeps(self, start: int, end: int) -> bool:
        if self.last is not None:
            at = bisect_left(self.ends, end - self.tolerance)
            if start - self.last <= self.tolerance or end < self.widest or at < len(self.ends) and self.ends[at] <= end + self.tolerance:
                return False
        self.last, self.widest = start, end if self.widest is None else max(end, self.widest)
        insort(self.ends, end)
        return True


class Repeats:
    """The starts and ends kept so far."""

    def __init__(self):
        self.starts, self.ends = set(), set()

    def keeps(self, start: int, end: int) -> bool:
        if start in self.starts or end in self.ends:
            return False
        self.starts.add(start)
        self.ends.add(end)
        return True


#: Bases of a bin, between which gaps are looked for.
BIN, GROUP = 1 << 22, "_group"


def grouped(rows: DataFrame, keys: list[str], reach: int, bin_: int = BIN) -> DataFrame:
    """rows with a number _group: intervals of one key and different groups are more than `reach` apart.

    rows are read twice. Null keys are a key; an interval's ends may stand in either order.
    """
    low, high, at = F.least("start", "end"), F.greatest("start", "end"), F.expr(f"floor(least(start, end) / {bin_})")
    names = [f"_k{i}" for i in range(len(keys))]
    bins = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], at.alias("_at")).agg(F.min(low).alias("_low"), F.max(high).alias("_high"))
    by = Window.partitionBy(*names).orderBy("_at")
    before = F.max("_high").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = (before.isNull() | (F.col("_low") > before + reach)).cast("bigint")
    numbered = bins.withColumn("_opens", opens).select(*names, F.col("_at").alias("_bin_at"), F.sum("_opens").over(by).alias(GROUP))
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)] + [at == F.col("_bin_at")]
    same = on[0]
    for c in on[1:]:
        same &= c
    return rows.join(numbered, same).drop(*names, "_bin_at")


def _dealt(rows: DataFrame, keys: list[str], reach: int) -> tuple[DataFrame, list[str]]:
    """rows by keys and group; rows that have groups already keep them."""
    return (rows if GROUP in rows.columns else grouped(cut(rows), keys, reach)), [*(k for k in keys if k != GROUP), GROUP]


def _in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    cols = [c for c in dict.fromkeys([*order, "start", "end"]) if c not in keys]
    return rows.select(*keys, *cols).repartition(*keys).sortWithinPartitions(*keys, *order)


def _schema(rows: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*keys, "start", "end"])


def _kept(rows: DataFrame, keys: list[str], order: list[str], new: Callable[[], Conflicts | Repeats], reach: int) -> DataFrame:
    """keys, start, end of the intervals that new()'s rule keeps, each group's in order; _group too where rows have it."""
    out = [*keys, "start", "end", *[GROUP] * (GROUP in rows.columns)]
    rows, keys = _dealt(rows, keys, reach)
    columns = [*keys, "start", "end"]

    def run(batches):
        now, rule = None, None
        for b in batches:
            mask = np.zeros(b.num_rows, bool)
            for i, (start, end, *group) in enumerate(zip(*(b.column(c).to_pylist() for c in ("start", "end", *keys)), strict=True)):
                if rule is None or group != now:
                    now, rule = group, new()
                mask[i] = rule.keeps(start, end)
            yield b.select(columns).filter(pa.array(mask))

    return _in_order(rows, keys, order).mapInArrow(run, _schema(rows, keys)).select(*out)


def without_conflicts(rows: DataFrame, keys: list[str], tolerance: int, order: tuple[str, ...] = ()) -> DataFrame:
    """Drops an interval whose start or end is within `tolerance` of that of one kept, or that one kept strictly contains."""
    return _kept(rows, keys, ["start", *order, "end"], lambda: Conflicts(tolerance), tolerance)


def without_repeats(rows: DataFrame, keys: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """Drops an interval whose start or end is that of one kept."""
    return _kept(rows, keys, [*order, "start", "end"], Repeats, 0)


def border_flags(rows: DataFrame, keys: list[str], band: int, window: int) -> DataFrame:
    """Each interval with what follows it: at_border (its end is within 3 windows of a band's edge), adjacent (the next begins within 4 windows)."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    phase = F.col("end") % F.lit(band)
    out = rows.withColumn("next_start", F.lead("start").over(w)).withColumn("next_end", F.lead("end").over(w))
    return out.withColumn("at_border", (phase <= 3 * window) | (phase >= band - 3 * window)).withColumn("adjacent", F.coalesce(F.abs(F.col("end") - F.col("next_start")) <= 4 * window, F.lit(False)))


def stitched(rows: DataFrame, keys: list[str], band: int, window: int) -> DataFrame:
    """Joins an interval that ends at a band's edge with the next, if that begins within 4 windows; a joined one isn't tried again."""
    out = [*keys, "start", "end"]
    rows, keys = _dealt(rows, keys, 4 * window)
    columns = [*keys, "start", "end"]
    types = [rows.schema[c].dataType.simpleString() for c in columns]

    def run(batches):
        held = None  # list, start, end, whether joined
        for b in batches:
            done = []
            for start, end, *group in zip(*(b.column(c).to_pylist() for c in ("start", "end", *keys)), strict=True):
                if held is not None and held[0] == group:
                    _, a, z, joined = held
                    edge = min(z % band, band - z % band) <= 3 * window
                    if edge and not joined and abs(z - start) <= 4 * window:
                        held = group, a, max(z, end), True
                        continue
                if held is not None:
                    done.append((*held[0], held[1], held[2]))
                held = group, start, end, False
            if done:
                yield batch(done)
        if held is not None:
            yield batch([(*held[0], held[1], held[2])])

    def batch(found):
        arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(c, arrow[t]) for c, t in zip(zip(*found, strict=True), types, strict=True)], columns)

    return _in_order(rows, keys, ["start", "end"]).mapInArrow(run, _schema(rows, keys)).select(*out)
