"""Sums over all rows of NumPy partials, reduced on the cluster in two levels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame


DIRECT_TASKS = 64  # up to this many partial vectors go straight to the driver


def batch_matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A list<double> column of equal lengths as a matrix, without per-row Python objects."""
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64, copy=False).reshape(batch.num_rows, -1)


def sum_partials(df: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray],
                 size: int) -> np.ndarray:
    """Sum of ``partial(batch)`` (a vector of ``size``) over all batches of ``df``.

    Each task adds up its own batches; about sqrt(tasks) groups add up tasks; the driver adds up the
    groups. No row leaves its task.
    """
    tasks = df.rdd.getNumPartitions()
    fan = int(np.sqrt(tasks)) if tasks > DIRECT_TASKS else 1

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(size)
        for b in batches:
            if b.num_rows:
                acc += partial(b)
        slot = TaskContext.get().partitionId() % fan
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), _row(acc)], ["slot", "acc"])

    def per_slot(table: pa.Table) -> pa.Table:
        return pa.table([_row(_total(table, size))], ["acc"])

    partials = df.mapInArrow(per_task, "slot int, acc array<double>")
    if fan > 1:
        partials = partials.groupBy("slot").applyInArrow(per_slot, "acc array<double>")
    return _total(partials.select("acc").toArrow(), size)


def _row(values: np.ndarray) -> pa.Array:
    """One list<double> value, without Python objects per number."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


def _total(table: pa.Table, size: int) -> np.ndarray:
    return sum((chunk.flatten().to_numpy().reshape(-1, size).sum(axis=0) for chunk in table.column("acc").chunks), np.zeros(size))
