import numpy as np
import pytest

from gavilla.operators.scans import scan


def plain(rows, one_run):
    out, seen = [], {}
    for run, i, x, mark in rows:
        total, last, high = seen.get(0 if one_run else run, (0, None, None))
        out.append((run, i, total + x, mark if mark is not None else last, high))
        high = mark if high is None else high if mark is None else max(high, mark)
        seen[0 if one_run else run] = (total + x, mark if mark is not None else last, high)
    return out


@pytest.mark.parametrize("one_run", [True, False])
@pytest.mark.parametrize("batch", ["10000", "7"])
def test_scan_over_hot_and_small_runs(spark, one_run, batch):
    """One run holds most rows and lies over several partitions."""
    r = np.random.RandomState(4)
    runs = sorted([5] * 200 + [7] * 3 + [9] * 40 + list(range(20, 60)))
    rows = [(run, i, int(r.randint(-5, 50)), int(r.randint(1000)) if r.rand() < 0.2 else None) for i, run in enumerate(runs)]
    df = spark.createDataFrame(rows, "run bigint, i bigint, x bigint, mark bigint").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = scan(df, ["run", "i"], None if one_run else "run", ("x",), ("mark",), ("mark",))
        assert sorted(found.select("run", "i", "sum_x", "last_mark", "high_mark").collect()) == plain(rows, one_run)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scan_of_nothing_and_of_texts(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, 0.25), (3, "b", 1.0), (4, None, 2.0)], "i bigint, t string, x double")
    assert scan(df.limit(0), ["i"], None, ("x",), ("t",)).count() == 0
    found = scan(df, ["i"], None, ("x",), ("t",)).orderBy("i").collect()
    assert [(r.sum_x, r.last_t) for r in found] == [(0.5, "a"), (0.75, "a"), (1.75, "b"), (3.75, "b")]
