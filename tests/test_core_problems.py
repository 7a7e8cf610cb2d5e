"""Orphan references and skewed keys on small tables with every awkward case."""

from collections import defaultdict
from datetime import datetime

from paperloom.functions.columns import consistent_entities
from paperloom.operators import orphans, skew
from tests.conftest import rows

T1, T2, T3 = datetime(2024, 1, 10), datetime(2024, 2, 10), datetime(2024, 3, 10)
REFS = "src_table string, src_key long, ref_id string, at timestamp_ntz"
PARENTS = "id string, arrived_at timestamp_ntz"
DELETIONS = "id string, deleted_at timestamp_ntz"


def found(spark, refs, parents, deletions):
    return rows(orphans.orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), spark.createDataFrame(deletions, DELETIONS)))


def test_kinds(spark):
    parents = [("a_1_p1", T1), ("a_1_p1", T3), ("b_2_p1", T3), ("odd", T1), (None, T1)]
    deletions = [("a_1_p1", T2), ("a_1_p1", T3), ("never_9_p9", T1), (None, T1)]
    refs = [
        ("q", 1, "a_1_p1", T1),  # there, not yet deleted
        ("q", 2, " a_1_p1 ", T2),  # deleted at that moment
        ("q", 3, "b_2_p1", T1),  # late
        ("q", 4, "b_3_p1", T1),  # beyond the run
        ("q", 5, "x_1_p1", T1),  # inside a run, another id
        ("q", 6, "never_9_p9", T2),  # deleted but never delivered
        ("q", 7, None, T1), ("q", 8, "  ", T1),
        ("q", 9, "odd", T2), ("q", 10, "odder", None),
        ("q", 4, "b_3_p1", T1),  # repeated
    ]
    assert found(spark, refs, parents, deletions) == sorted(
        [("q", 2, "a_1_p1", "deleted", "2024-02"), ("q", 3, "b_2_p1", "late", "2024-01"), ("q", 4, "b_3_p1", "missing", "2024-01"), ("q", 5, "x_1_p1", "missing", "2024-01"), ("q", 6, "never_9_p9", "missing", "2024-02"), ("q", 10, "odder", "missing", None)],
        key=repr,
    )


def test_empty_tables(spark):
    assert found(spark, [], [], []) == []
    assert found(spark, [("q", 1, "a_1_p1", T1)], [], []) == [("q", 1, "a_1_p1", "missing", "2024-01")]


def test_one_id_holds_most_references(spark):
    refs = [("q", i, "hot_1_p1", T1) for i in range(3000)] + [("q", 9000 + i, f"c_{i}_p7", T1) for i in range(50)]
    got = found(spark, refs, [("hot_1_p1", T3)] + [(f"c_{i}_p7", T1) for i in range(49)], [])
    assert len(got) == 3001 and sum(r[3] == "late" for r in got) == 3000 and ("q", 9049, "c_49_p7", "missing", "2024-01") in got


def test_runs_are_contiguous_and_cut_at_blocks(spark):
    keys = [1, 2, 3, 7, 8, (1 << orphans.BLOCK_BITS) - 1, 1 << orphans.BLOCK_BITS, None, 2]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    assert sorted((r[1], r[2]) for r in rows(orphans.contiguous_runs(df, "k"))) == [(1, 3), (7, 8), (4095, 4095), (4096, 4096)]
    refs = spark.createDataFrame([(k,) for k in (0, 2, 4, 6, 8, 9, 4096, 4097, None)], "k long")
    assert sorted(r[0] for r in orphans.beyond_runs(refs, "k", orphans.contiguous_runs(df, "k")).collect()) == [0, 4, 6, 9, 4097]


CHUNKS = "chunk_key long, theme string, entities array<string>, confidence double, key_value string, field string, n int"


def test_key_statistics(spark):
    data = [
        (1, " Cells ", ["TP53", "tp53 ", "ＴＰ５３", None, " "], 0.5, "x", "y", 1),
        (1, " Cells ", ["TP53", "tp53 ", "ＴＰ５３", None, " "], 0.5, "x", "y", 1),  # delivered twice
        (2, "cells", None, None, None, None, None),
        (3, None, ["ТР53"], 0.7, None, None, None),  # Cyrillic letters
        (4, " ", [], 0.9, None, None, None),
        (None, "cells", ["TP53"], 0.1, None, None, None),
    ]
    got = rows(skew.key_statistics(spark.createDataFrame(data, CHUNKS)))
    assert [(f, k, n, round(m, 9)) for f, k, n, m in got] == [("entity", "tp53", 2, 0.6), ("theme", "cells", 2, 0.5)]
    assert rows(skew.key_statistics(spark.createDataFrame([], CHUNKS))) == []
    assert rows(skew.frequent_keys(spark.createDataFrame(data, CHUNKS), 0.5)) == [("entity", "tp53"), ("theme", "cells")]


def test_eager_aggregation_equals_the_plain_join(spark):
    tags = [(i % 7, "k" + str(i % 3)) for i in range(60)] + [(None, "k0")]
    measures = [(i % 5, float(i) if i % 4 else None) for i in range(23)] + [(None, 1.0)]
    a, b = spark.createDataFrame(tags, "id long, k string"), spark.createDataFrame(measures, "id long, v double")
    want = defaultdict(lambda: [0, 0, 0.0])
    for i, k in tags:
        for j, v in measures:
            if i is not None and i == j:
                want[k][0] += 1
                want[k][1] += v is not None
                want[k][2] += v or 0.0
    got = {r["k"]: [r["n"], r["n_values"], r["total"]] for r in skew.eager_join_aggregate(a, b, "id", ["k"], "v", distinct_tags=False).collect()}
    assert got == want


def test_skew_safe_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(500)] + [(999, None)], "i long, k string")
    right = spark.createDataFrame([("hot", 1), ("k2", 2)], "k string, v int")
    assert rows(skew.skew_safe_left_join(left, right, "k").select("i", "k", "v")) == rows(left.join(right, "k", "left").select("i", "k", "v"))


def test_consistent_entities(spark):
    df = spark.createDataFrame([(1, ["Xüfafin", "Xüfafin", "РＬ８４", "PL​84"]), (2, None), (3, ["plain", None])], "k long, entities array<string>")
    assert rows(consistent_entities(df)) == [(1, ["Xüfafin", "Xüfafin", "PL84", "PL84"]), (2, None), (3, ["plain", None])]
