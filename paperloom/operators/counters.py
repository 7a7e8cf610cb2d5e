"""Sums of arrays that tasks count in numpy: in a tree, so no task sees an array of every other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Arrays that meet in one group at most, and rows of an array's slice.
FAN_IN = 16
SCHEMA = "part int, task long, blob binary"


def packed(total: np.ndarray, slices: int = 1, dtype: str = "i8") -> pa.RecordBatch:
    """The calling task's array, as dtype, in rows (part, task, blob), a part a slice, empty
    ones left out; compressed, since most counters of a large table are zero or small."""
    task = TaskContext.get()
    pieces = [(i, p) for i, p in enumerate(np.array_split(total.reshape(-1), slices)) if p.any()]
    blobs = [pa.compress(p.astype(dtype).tobytes(), "zstd", asbytes=True) for _, p in pieces]
    number = pa.array([task.partitionId() if task else 0] * len(pieces), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in pieces], pa.int32()), number, pa.array(blobs, pa.binary())], ["part", "task", "blob"])


def tree_sum(parts: DataFrame, tasks: int, size: int, slices: int = 1, dtype: str = "i8", fan_in: int = FAN_IN) -> np.ndarray:
    """The sum of the tasks' arrays (packed, of ``size`` values of dtype).

    Each round adds the arrays of at most fan_in neighbouring tasks, slice by slice on the
    executors; there are log(tasks) rounds, and the driver gets one array. A task that
    was repeated or never had a row changes nothing."""
    lengths = [len(p) for p in np.array_split(np.empty(size, np.int8), slices)]

    def add(table: pa.Table) -> pa.Table:
        if len(table) > fan_in:
            raise ValueError(f"{len(table)} arrays in one group")
        part = table.column("part")[0].as_py()
        total = np.zeros(lengths[part], dtype)
        for blob in table.column("blob"):
            total += unpacked(blob.as_py(), lengths[part], dtype)
        blobs = [pa.compress(total.tobytes(), "zstd", asbytes=True)]
        return pa.table({"part": pa.array([part], pa.int32()), "task": pa.array([table.column("task")[0].as_py() // fan_in], pa.int64()), "blob": pa.array(blobs, pa.binary())})

    rows = parts.select("part", "task", "blob")
    while tasks > 1:
        rows = rows.groupBy("part", F.floor(F.col("task") / fan_in).alias("_group")).applyInArrow(add, SCHEMA)
        tasks = -(-tasks // fan_in)
    out = np.zeros(size, dtype)
    views = np.array_split(out, slices)
    for r in rows.toLocalIterator():  # one row a slice
        views[r["part"]] += unpacked(r["blob"], lengths[r["part"]], dtype)
    return out


def unpacked(blob: bytes, length: int, dtype: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, length * np.dtype(dtype).itemsize, "zstd", asbytes=True), dtype)
