"""Top-n and period means of many columns in one pass: a mergeable state per group.

A task reads its rows once and keeps, for every group it meets, the n largest
values of each column and the sum and count of each month.  The state is bounded
by the number of groups and months, whatever the number of rows; a task that
meets too many groups passes its states on early.  One exchange brings the states
of a group together, where they are merged: the largest of the largest, the sums
of the sums.  Every period is built from the months of the merged state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.functions.calendar import period_labels

#: Rows that a task reduces at once, and month entries it holds before it passes them on.
ROWS, ENTRIES = 1 << 17, 1 << 19
#: Month number of a row without a date: in no period, but among the largest.
UNDATED = -1


def _codes(frame: pd.DataFrame) -> np.ndarray:
    """Number of each row's group, in order of first appearance."""
    if not frame.shape[1]:
        return np.zeros(len(frame), np.int64)
    return frame.groupby(list(frame.columns), dropna=False, sort=False).ngroup().to_numpy(np.int64)


def _starts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)


class PartialState:
    """What a task has seen: its groups, the months of each, and the n largest values of each column of each."""

    def __init__(self, keys: list[str], width: int, n: int):
        self.keys, self.width, self.n = keys, width, n
        self.clear()

    def clear(self) -> None:
        self.groups: pd.DataFrame | None = None
        none = np.zeros(0, np.int64)
        self.of, self.ym = none, none  # group and month of each entry
        self.sums, self.counts = np.zeros((0, self.width)), np.zeros((0, self.width), np.int64)
        self.tops = [(none, np.zeros(0)) for _ in range(self.width)]

    def _numbers(self, frame: pd.DataFrame) -> np.ndarray:
        """Group numbers of the rows of ``frame``; new groups are added."""
        local = _codes(frame)
        first = np.unique(local, return_index=True)[1]
        fresh = frame.iloc[first]
        known = 0 if self.groups is None else len(self.groups)
        both = fresh if self.groups is None else pd.concat([self.groups, fresh], ignore_index=True)
        number = _codes(both)
        self.groups = both.iloc[np.unique(number, return_index=True)[1]].reset_index(drop=True)
        return number[known:][local]

    def add(self, rows: pd.DataFrame) -> None:
        """``rows`` has the keys, ``ym`` and the values ``c0, c1 ...``."""
        number = self._numbers(rows[self.keys])
        values = np.stack([rows[f"c{i}"].to_numpy(np.float64, na_value=np.nan) for i in range(self.width)], axis=1)
        here = ~np.isnan(values)
        of, ym = np.r_[self.of, number], np.r_[self.ym, rows["ym"].to_numpy(np.int64)]
        order = np.lexsort((ym, of))
        of, ym = of[order], ym[order]
        starts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (ym[1:] != ym[:-1])])
        self.sums = np.add.reduceat(np.concatenate([self.sums, np.where(here, values, 0.0)])[order], starts, axis=0)
        self.counts = np.add.reduceat(np.concatenate([self.counts, here.astype(np.int64)])[order], starts, axis=0)
        self.of, self.ym = of[starts], ym[starts]
        for i, (group, v) in enumerate(self.tops):
            group, v = np.r_[group, number[here[:, i]]], np.r_[v, values[here[:, i], i]]
            order = np.lexsort((-v, group))
            group, v = group[order], v[order]
            starts = _starts(group)
            rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
            self.tops[i] = group[rank < self.n], v[rank < self.n]

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """One row per key: its months and its largest values, as lists."""
        if self.groups is None:
            return
        ends = lambda of: pa.array(np.searchsorted(of, np.arange(len(self.groups) + 1)).astype(np.int32))
        steps = pa.array(np.arange(0, self.sums.size + 1, self.width, dtype=np.int32))
        inner = [pa.ListArray.from_arrays(steps, pa.array(x.ravel())) for x in (self.sums, self.counts)]
        entries = pa.StructArray.from_arrays([pa.array(self.ym.astype(np.int32)), *inner], ["ym", "s", "n"])
        columns = [pa.Array.from_pandas(self.groups[k], type=schema.field(k).type) for k in self.keys]
        columns.append(pa.ListArray.from_arrays(ends(self.of), entries))
        columns += [pa.ListArray.from_arrays(ends(group), pa.array(v)) for group, v in self.tops]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def period_states(df: DataFrame, keys: list[str], date: str, columns: list[str], n: int = 10) -> DataFrame:
    """``keys, months, t0, t1 ...``: the merged state of each group; NULL and NaN are no values."""
    by = [f"k{i}" for i in range(len(keys))]
    ym = F.coalesce((F.year(date) * 12 + F.month(date) - 1).cast("int"), F.lit(UNDATED))
    values = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]
    rows = df.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], ym.alias("ym"), *values)
    kinds = dict(rows.dtypes)
    tops = [f"t{i}" for i in range(len(columns))]
    text = [f"{b} {kinds[b]}" for b in by] + ["months array<struct<ym: int, s: array<double>, n: array<bigint>>>"]
    text += [f"{t} array<double>" for t in tops]
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held, size, schema = PartialState(by, width, n), [], 0, None

        def reduced() -> None:
            nonlocal held, size
            if size:
                # Nullable types keep whole-number keys whole where some are NULL.
                state.add(pa.Table.from_batches(held).to_pandas(types_mapper=_NULLABLE.get))
            held, size = [], 0

        for batch in batches:
            if schema is None:
                schema = _schema(batch.schema, by, tops)
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS:
                reduced()
                if len(state.of) > ENTRIES:
                    yield from state.rows(schema)
                    state.clear()
        reduced()
        if schema is not None:
            yield from state.rows(schema)

    partial = rows.mapInArrow(run, ", ".join(text))
    together = [F.flatten(F.collect_list("months")).alias("months")]
    together += [F.slice(F.sort_array(F.flatten(F.collect_list(t)), asc=False), 1, n).alias(t) for t in tops]
    merged = partial.groupBy(*by).agg(*together)
    return merged.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], "months", *tops)


_NULLABLE = {
    pa.int8(): pd.Int8Dtype(),
    pa.int16(): pd.Int16Dtype(),
    pa.int32(): pd.Int32Dtype(),
    pa.int64(): pd.Int64Dtype(),
    pa.bool_(): pd.BooleanDtype(),
    pa.string(): pd.StringDtype("pyarrow"),
}


def _schema(given: pa.Schema, by: list[str], tops: list[str]) -> pa.Schema:
    entry = pa.struct([("ym", pa.int32()), ("s", pa.list_(pa.float64())), ("n", pa.list_(pa.int64()))])
    fields = [given.field(b) for b in by] + [pa.field("months", pa.list_(entry))]
    return pa.schema(fields + [pa.field(t, pa.list_(pa.float64())) for t in tops])


def _entries(columns: list[str], by_year: bool) -> Column:
    """(Period, Year, sums, counts) of every month and period, and of the largest values."""
    kind = "struct<Period: string, Year: int, s: array<double>, n: array<bigint>>"

    def of_month(m: Column) -> Column:
        labels = F.when(m["ym"] == UNDATED, F.array().cast("array<string>")).otherwise(period_labels(m["ym"] % 12 + 1))

        def entry(label: Column) -> Column:
            year = F.when((label == "Annual") & F.lit(by_year), F.floor(m["ym"] / 12).cast("int"))
            return F.struct(label.alias("Period"), year.alias("Year"), m["s"].alias("s"), m["n"].alias("n")).cast(kind)

        return F.transform(labels, entry)

    tops = [F.col(f"t{i}") for i in range(len(columns))]
    sums = F.array(*[F.aggregate(t, F.lit(0.0), lambda a, v: a + v) for t in tops])
    largest = F.struct(
        F.lit("top-10").alias("Period"), F.lit(None).cast("int").alias("Year"), sums.alias("s"),
        F.array(*[F.size(t).cast("bigint") for t in tops]).alias("n"),
    ).cast(kind)
    return F.concat(F.flatten(F.transform("months", of_month)), F.array(largest))


def top_and_period_means(df: DataFrame, keys: list[str], date: str, columns: list[str], by_year: bool = True) -> DataFrame:
    """Top-10 mean of each column on its own and all period means, per group.

    One scan and one exchange.  Only the Annual rows carry their ``Year``.  A group
    without any value of a column keeps its rows, with NULL there.
    """
    state = period_states(df, keys, date, columns)
    named = state.withColumnsRenamed({k: f"k{i}" for i, k in enumerate(keys)})
    by = [f"k{i}" for i in range(len(keys))]
    rows = named.select(*by, F.inline(_entries(columns, by_year)))
    total = lambda x, i: F.sum(F.get(x, F.lit(i)))
    means = [
        (total("s", i) / F.when(total("n", i) > 0, total("n", i))).alias(c) for i, c in enumerate(columns)
    ]
    out = rows.groupBy(*by, "Period", "Year").agg(*means)
    return out.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], "Period", "Year", *columns)
