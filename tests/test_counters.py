"""Sums of task arrays in a tree."""

import numpy as np
import pyarrow as pa
import pytest

from paperloom.operators import counters as C


def made(spark, partitions, size, slices):
    def run(batches):
        total = np.zeros(size, np.int32)
        for b in batches:
            np.add.at(total, b.column(0).to_numpy() % size, 1)
        yield C.packed(total, slices)

    return spark.range(0, 10_000, 1, partitions).mapInArrow(run, C.SCHEMA)


@pytest.mark.parametrize("partitions,slices", [(1, 1), (7, 3), (200, 4)])
def test_sum_of_many_tasks(spark, partitions, slices):
    got = C.tree_sum(made(spark, partitions, 1_000, slices), partitions, 1_000, slices)
    assert (got == 10).all() and len(got) == 1_000


def test_no_group_has_an_array_of_every_task(spark):
    # a group beyond the fan-in raises, so 200 tasks pass only through rounds
    with pytest.raises(Exception, match="arrays in one group"):
        one = made(spark, 200, 50, 1).withColumn("task", C.F.lit(0).cast("long"))
        C.tree_sum(one, 200, 50, 1)


def test_empty_and_silent_tasks(spark):
    assert not C.tree_sum(spark.createDataFrame([], C.SCHEMA), 5, 10).any()
    assert C.packed(np.zeros(4)).num_rows == 0
    few = made(spark, 3, 10, 2).where("task = 1")
    assert C.tree_sum(few, 3, 10, 2).sum() > 0


def test_round_trip():
    x = np.arange(10)
    rows = C.packed(x, 1)
    assert (C.unpacked(rows.column(2)[0].as_py(), 10, "i8") == x).all() and isinstance(rows, pa.RecordBatch)
