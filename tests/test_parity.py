"""Odd names, dialects and layouts that a user meets: column names with dots and quotes, CSV quoting,
workbooks and JSON files of one folder that differ, sessions outside UTC."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prism.operators import correlate as C
from prism.operators import describe as D
from prism.operators import model as M
from prism.operators import quality as Q
from prism.operators import roles as RL
from prism.sources import readers as RD
from prism.streaming import counters as ST

NAMES = ["chiffre d'affaires", "a.b", "Prix HT"]


@pytest.fixture()
def odd(spark):
    rows = [(float(i), float(i * i % 7), None if i % 4 == 0 else 3.0 * i, f"t{i % 3}") for i in range(40)]
    return spark.createDataFrame(rows, "x double, y double, z double, t string").toDF(*NAMES, "te`xt's")


def test_odd_names_through_every_analysis(odd):
    assert {r.column_name: r["count"] for r in D.describe_numeric(odd).collect()} == {NAMES[0]: 40, NAMES[1]: 40, NAMES[2]: 30}
    assert D.describe_numeric_approx(odd).count() == 3
    assert {r.column_name: r.distinct for r in RL.column_profile(odd).collect()} == {NAMES[0]: 40, NAMES[1]: 4, NAMES[2]: 30, "te`xt's": 3}
    assert {(r.var1, r.var2): r.r for r in C.correlation_matrix(odd).collect()}[NAMES[0], NAMES[2]] == pytest.approx(1)
    assert C.correlation_analysis(odd).summary.first()["variables_analyzed"] == 3
    assert D.categorical_top10(odd).count() == 3 and D.categorical_nunique(odd).first()["unique_values"] == 3
    assert Q.validate(odd, "correlation").first()["is_valid"]
    assert RL.date_candidates(odd).first()["is_date"] is False


def test_frames_without_text_or_numbers(spark):
    numbers = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert D.categorical_nunique(numbers).count() == 0 and D.categorical_top10(numbers).count() == 0
    texts = spark.createDataFrame([("x",)], "a string")
    assert D.describe_numeric(texts).count() == 0 and D.describe_numeric_approx(texts).count() == 0


def test_correlation_of_an_overlap_far_from_the_mean(spark):
    rows = [(0.0, None)] * 1000 + [(1e7 + i, float(i)) for i in range(5)]
    r = {(x.var1, x.var2): x.r for x in C.correlation_matrix(spark.createDataFrame(rows, "a double, b double")).collect()}
    assert r["a", "b"] == pytest.approx(1, abs=1e-9) and r["b", "a"] == r["a", "b"]


def test_correlation_over_partitions_equals_pandas(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12)) + 1e5
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3], x[:, 4] = 7.0, np.nan
    frame = pd.DataFrame(x, columns=[f"c{i}" for i in range(12)])
    ours = {(r.pos1 - 1, r.pos2 - 1): r.r for r in C.correlation_matrix(spark.createDataFrame(frame).repartition(5)).collect()}
    theirs = frame.corr().fillna(0).to_numpy()
    assert all(ours[i, j] == pytest.approx(theirs[i, j], abs=1e-9) for i in range(12) for j in range(12))


def test_empty_correlation(spark):
    assert [r.r for r in C.correlation_matrix(spark.createDataFrame([], "a double, b double")).collect()] == [0.0] * 4


def test_csv_dialect(spark, tmp_dir):
    with open(f"{tmp_dir}/a.csv", "w", encoding="utf-8") as f:
        f.write('id,a.b,code,n\n1,"He said ""hi"", then left",10D,1.5\n2,"two\nlines",20F,-2e3\n3,NA,30D,\n')
    got = RD.scan_csv(spark, tmp_dir).orderBy("id")
    assert [tuple(r) for r in got.collect()] == [(1, 'He said "hi", then left', "10D", 1.5), (2, "two\nlines", "20F", -2000.0), (3, None, "30D", None)]


def test_json_files_of_both_layouts_in_one_folder(spark, tmp_dir):
    for name, text in (("a.json", '\n [{"x": 1, "y": "u"}, {"x": 2, "y": "v"}]'), ("b.json", '{"x": {"0": 3}, "z": {"0": "w"}}')):
        with open(f"{tmp_dir}/{name}", "w") as f:
            f.write(text)
    got = RD.scan_json(spark, tmp_dir)
    assert sorted((r.x, r.y, r.z) for r in got.collect()) == [(1, "u", None), (2, "v", None), (3, None, "w")]


def test_dates_are_judged_by_every_row(spark):
    rows = [("2024-01-01", "02/01/2024")] * 300 + [("never", "31/12/2023")]
    got = {r.column_name: r.is_date for r in RL.date_candidates(spark.createDataFrame(rows, "a string, b string")).collect()}
    assert got == {"a": False, "b": True}


def test_kmeans_keeps_the_rows_identity(spark):
    df = spark.createDataFrame([(i, f"n{i}", float(i % 3 * 10 + i % 2), float(i % 3)) for i in range(30)], "id long, name string, x double, y double")
    res = M.kmeans(df, ["x", "y"], k=3)
    assert {"id", "name", "cluster"} <= set(res.assigned.columns)
    assert {r["id"] for r in res.assigned.collect()} == set(range(30))
    assert res.profile.agg(F.sum("size")).first()[0] == 30 and res.inertia >= 0


def test_stream_days_outside_utc_and_compaction(spark, tmp_dir):
    src = os.path.join(tmp_dir, "events")
    zone = spark.conf.get("spark.sql.session.timeZone")
    for day in (1, 2):
        at = dt.datetime(2024, 1, day, 0, 30)
        spark.createDataFrame([(at,), (at,)], "ts timestamp_ntz").write.mode("append").parquet(src)
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
        stream = ST.parquet_stream(spark, src, max_files_per_trigger=1)
        query = ST.start_upsert(ST.stream_daily_counts(stream, "ts"), f"{tmp_dir}/table", f"{tmp_dir}/checkpoint")
        query.awaitTermination()
        for table in (ST.read_upserts(spark, f"{tmp_dir}/table", ["window"]), ST.compact(spark, f"{tmp_dir}/table", ["window"], f"{tmp_dir}/small")):
            got = table.select(ST.utc_day(F.col("window.start")).alias("day"), "count").collect()
            assert sorted((r.day, r["count"]) for r in got) == [(dt.datetime(2024, 1, d), 2) for d in (1, 2)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_metadata_counts_the_bytes_of_header_only_files(spark, tmp_dir):
    with open(f"{tmp_dir}/a.csv", "w") as f:
        f.write("a,b\n")
    assert tuple(RD.ingest_metadata(spark, tmp_dir, "csv").first()) == (0, 2, 4)


def test_correlation_tiles_and_tree(spark, monkeypatch):
    """Small tiles and a small fan-in: the pairs and tasks are merged over several rows and both steps."""
    monkeypatch.setattr(C, "TILE", 4)
    monkeypatch.setattr(C, "FAN", 2)
    rng = np.random.default_rng(6)
    frame = pd.DataFrame(rng.normal(1e6, 1, (300, 7)), columns=list("abcdefg")).mask(rng.random((300, 7)) < 0.2)
    frame["g"] = 5.0
    got = {(r.var1, r.var2): r.r for r in C.correlation_matrix(spark.createDataFrame(frame).repartition(9)).collect()}
    expected = frame.corr().fillna(0)
    assert len(got) == 49
    for (a, b), r in got.items():
        assert r == pytest.approx(expected.loc[a, b], abs=1e-9), (a, b)
