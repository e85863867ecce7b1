"""Counters that keep no state: many micro-batches, folds, replays, late events."""

import os

import pytest
from pyspark.sql import functions as F

from prism.streaming import counters as ST


def write_events(spark, folder, rows):
    spark.createDataFrame(rows, "item string, `kind.of` string").coalesce(1).write.mode("append").parquet(folder)


def run(spark, src, base, fold_every):
    stream = ST.parquet_stream(spark, src, max_files_per_trigger=1)
    q = ST.start_counters(stream, "item", "kind.of", f"{base}/table", f"{base}/checkpoint", fold_every)
    q.awaitTermination()
    assert q.exception() is None
    return {(r["item"], r["type"]): r["count"] for r in ST.read_counters(spark, f"{base}/table").collect()}


def names(base, kind):
    return sorted(int(f.split("=")[1]) for f in os.listdir(f"{base}/table") if f.startswith(f"{kind}="))


def test_counters_over_folds_and_restarts(spark, tmp_dir):
    src, base, expected = f"{tmp_dir}/src", f"{tmp_dir}/out", {}

    def send(*rows):
        write_events(spark, src, rows)
        for r in rows:
            expected[r] = expected.get(r, 0) + 1

    send(("old", "view"), ("a", "view"), (None, None))
    assert run(spark, src, base, 3) == expected and names(base, "fold") == []
    for i in range(7):
        send(("a", "view"), (f"b{i}", "click"))
    assert run(spark, src, base, 3) == expected  # batches 1-7: folds behind 2 and 5
    assert names(base, "fold") == [2, 5] and names(base, "batch") == [3, 4, 5, 6, 7]
    send(("old", "view"))  # idle since batch 0, long folded
    send(("a", "view"))
    assert run(spark, src, base, 3) == expected and expected["old", "view"] == 2
    assert names(base, "fold") == [5, 8]
    # a replayed batch overwrites its own counts; half a fold is not read
    os.makedirs(f"{base}/table/fold=9")
    spark.read.parquet(f"{base}/table/batch=9").write.mode("overwrite").parquet(f"{tmp_dir}/copy")
    spark.read.parquet(f"{tmp_dir}/copy").write.mode("overwrite").parquet(f"{base}/table/batch=9")
    assert {(r["item"], r["type"]): r["count"] for r in ST.read_counters(spark, f"{base}/table").collect()} == expected


def test_counters_without_events(spark, tmp_dir):
    assert ST.read_counters(spark, f"{tmp_dir}/none").count() == 0


def test_counters_keep_no_state(spark, tmp_dir):
    write_events(spark, f"{tmp_dir}/src", [("a", "view")])
    run(spark, f"{tmp_dir}/src", f"{tmp_dir}/out", 3)
    assert not os.path.exists(f"{tmp_dir}/out/checkpoint/state")
