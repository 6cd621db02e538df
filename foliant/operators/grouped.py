"""Arrow steps over many groups at a time: Spark deals and sorts the rows, a task takes whole groups out of its batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame


def dealt(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """``rows`` by ``keys`` over as many tasks as shuffles have, however few bytes they are: for steps with much work a byte, which a file's splits and row groups would leave to a few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def group_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group of sorted rows begins; null is a key like others."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in keys:
        column = rows[c]
        if not pa.types.is_integer(column.type):  # texts and others by number
            column = column.combine_chunks().dictionary_encode()
            column = column.indices if isinstance(column, pa.DictionaryArray) else pa.chunked_array([c.indices for c in column.chunks], pa.int32())
        blank = column.is_null().to_numpy(zero_copy_only=False)
        value = column.fill_null(0).to_numpy()
        new[1:] |= (value[1:] != value[:-1]) | (blank[1:] != blank[:-1])
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, starts) of groups that are complete; the last group of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        starts = group_starts(pa.Table.from_batches([b]), keys)
        if held:
            last = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), b.slice(0, 1)])
            goes_on = len(group_starts(last, keys)) == 1
            if goes_on and len(starts) == 1:
                held.append(b)
                continue
            cut = int(starts[1]) if goes_on and len(starts) > 1 else 0
            if cut:
                held.append(b.slice(0, cut))
            rows = pa.Table.from_batches(held).combine_chunks()
            yield rows, group_starts(rows, keys)
            b, starts, held = b.slice(cut), starts[1:] - cut if cut else starts, []
        if len(starts) > 1:
            rows = pa.Table.from_batches([b.slice(0, int(starts[-1]))])
            yield rows, starts[:-1]
        held = [b.slice(int(starts[-1]))]
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, group_starts(rows, keys)


def map_groups(rows: DataFrame, keys: list[str], order: list[str | Column], run: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``run`` of (rows, starts): whole groups of the ``keys`` in a row, each one's rows in their order and beginning at starts[k]. A group lies in one task, as with applyInArrow, but small ones share a call."""

    def step(batches):
        for held, starts in whole_groups(batches, keys):
            yield from run(held, starts).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(step, schema)
