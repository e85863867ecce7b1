"""Edge cases taken from the behaviours of the reference (FIXTURES.md, table C)."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from prism.functions import scalar as X
from prism.functions.text import classify_message, classify_message_degraded
from prism.operators import charts as CH
from prism.operators import correlate as C
from prism.operators import describe as D
from prism.operators import model as M
from prism.operators import quality as Q
from prism.operators import roles as RL
from prism.operators import timeseries as TS
from prism.plans.analysis import run_analysis
from prism.sources.sinks import results_json


def test_c1_empty_dataset(spark):
    df = spark.createDataFrame([], "a int, b string")
    v = Q.validate(df, "descriptive").first()
    assert not v["is_valid"] and v["errors"] == ["empty_dataset"]
    assert Q.check_not_empty(df).first()["code"] == "empty_dataset"
    res = run_analysis(df, "descriptive")
    assert res.status == "failed" and "empty_dataset" in res.error


def test_c2_too_few_numeric(spark):
    df = spark.createDataFrame([(float(i), str(i)) for i in range(5)], "a double, b string")
    v = Q.validate(df, "correlation").first()
    assert not v["is_valid"]
    assert v["errors"] == ["too_few_numeric:1"]
    assert v["recommendations"] == ["numeric_columns:a"]
    with pytest.raises(ValueError, match="too_few_numeric"):
        C.correlation_analysis(df)


def test_c3_pairwise_deletion_constant_and_nan(spark):
    nan = float("nan")
    rows = [(1.0, 2.0, 5.0, None), (2.0, None, 5.0, None), (3.0, 7.0, 5.0, None),
            (None, 1.0, 5.0, None), (5.0, 4.0, 5.0, None), (nan, 9.0, 5.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, const double, allnull double")
    facts = {r["column_name"]: r["is_constant"] for r in C.constant_columns(df).collect()}
    assert facts == {"a": False, "b": False, "const": True, "allnull": False}
    _, removed, kept = C.drop_constant_columns(df)
    assert removed == 1 and kept == ["a", "b", "allnull"]
    got = {(r["var1"], r["var2"]): r["r"] for r in C.correlation_matrix(df, kept).collect()}
    pdf = pd.DataFrame(rows, columns=["a", "b", "const", "allnull"])[kept].astype(float)
    expect = pdf.corr().fillna(0)
    for a in kept:
        for b in kept:
            assert got[(a, b)] == pytest.approx(expect.loc[a, b], abs=1e-12), (a, b)


def test_c4_regression_row_minimum(spark):
    four = spark.createDataFrame([(float(i), float(i), float(i * i)) for i in range(4)], "y double, x1 double, x2 double")
    with pytest.raises(ValueError, match="too_few_rows:4"):
        M.regression_prep(four, "y", ["x1", "x2"])
    five = spark.createDataFrame([(float(i), float(i), float(i * i)) for i in range(5)], "y double, x1 double, x2 double")
    assert M.regression_prep(five, "y", ["x1", "x2"]).count() == 5
    with pytest.raises(ValueError, match="target_in_features"):
        M.regression_prep(five, "y", ["y"])
    with pytest.raises(ValueError, match="missing_target_or_features"):
        M.regression_prep(five, "y", [])


def test_c5_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    with pytest.raises(ValueError, match="too_few_rows_for_k:2"):
        M.kmeans(df, k=3)
    with pytest.raises(ValueError, match="k_out_of_range"):
        M.kmeans(df, k=21)


def test_c6_dates_detection_and_parse_failure(spark):
    rows = [("2024-01-01", 1.0), ("2024-01-02 10:00:00", 2.0), ("2024-02-01T08:30:00", 3.0),
            ("not a date", 4.0), (None, 5.0), ("2024-03-01", None)]
    df = spark.createDataFrame(rows, "d string, v double")
    cand = {r["column_name"]: r["is_date"] for r in RL.date_candidates(df).collect()}
    assert cand == {"d": False}
    good = df.where(F.col("d") != "not a date")
    assert {r["column_name"]: r["is_date"] for r in RL.date_candidates(good).collect()} == {"d": True}
    bad = TS.timeseries_summary(df, "d", "v").first()
    assert bad["message"] == "date_parse_error:1" and bad["mean"] is None
    ok = TS.timeseries_summary(good, "d", "v").first()
    assert ok["message"] is None and ok["n_observations"] == 3
    assert ok["start"] == "2024-01-01T00:00:00" and ok["end"] == "2024-02-01T08:30:00"
    assert ok["mean"] == pytest.approx(2.0)
    missing = TS.timeseries_summary(good, None, "v").first()
    assert missing["message"] == "missing_parameters"


def test_c7_classifier_rule_order(spark):
    texts = ["Montre-moi un graphique", "Fais un PLOT des ventes", "visualise ça", "un chart svp",
             "Un résumé rapide", "aperçu des données", "explore ce fichier", "quelle structure ?",
             "corrélation entre a et b", "une analyse complète", "test statistique", "régression linéaire",
             "bonjour", "résumé et analyse", "chart et corrélation"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r["t"] for r in df.select(classify_message(F.col("text"))["type"].alias("t")).collect()]
    assert got == ["visualization", "visualization", "visualization", "visualization",
                   "data_exploration", "data_exploration", "data_exploration", "data_exploration",
                   "data_analysis", "data_analysis", "data_analysis", "data_analysis",
                   "general_question", "data_exploration", "visualization"]
    deg = [r["t"] for r in df.select(classify_message_degraded(F.col("text")).alias("t")).collect()]
    assert deg[0] == "data_exploration"          # "montre" wins before "graphique" in degraded order
    assert deg[1] == "visualization" and deg[12] == "help" and deg[8] == "help"


def test_c8_top10_ties_and_other(spark):
    vals = ["a"] * 5 + ["b"] * 5 + ["c"] * 4 + ["d"] * 3 + ["e"] * 3 + ["f", "g", "h", "i", "j", "k", "l"] + [None]
    df = spark.createDataFrame([(v,) for v in vals], "cat string")
    top = D.categorical_top10(df).orderBy("rank").collect()
    assert [r["value"] for r in top] == ["a", "b", "c", "d", "e", "f", "g", "h", "i", "j"]
    assert [r["count"] for r in top][:5] == [5, 5, 4, 3, 3]
    assert D.categorical_nunique(df).first()["unique_values"] == 12
    chart = {r["label"]: r["value"] for r in CH.chart_category_topk_other(D.categorical_top10(df), ["cat"]).collect()}
    assert chart["Autres"] == 2.0 and len(chart) == 9
    assert sum(r["count"] for r in top) <= len(vals)


def test_c9_tags_split(spark):
    df = spark.createDataFrame([("a, b",), ("a,,b ",), ("",), (None,)], "tags string")
    got = [r["t"] for r in df.select(X.tags_split("tags").alias("t")).collect()]
    assert got[0] == ["a", "b"] and got[1] == ["a", "b"] and got[2] == [] and got[3] is None
    assert df.select(X.tags_join(X.tags_split("tags")).alias("j")).first()["j"] == "a, b"


def test_c10_chart_validation(spark):
    docs = [
        json.dumps({"labels": ["x"], "datasets": [{"label": "s", "data": [1]}]}),
        json.dumps({"datasets": [{"data": [1]}]}),
        json.dumps({"labels": [], "datasets": []}),
        json.dumps({"labels": ["x"], "datasets": [{"data": 3}]}),
        "not json",
        json.dumps([1, 2]),
    ]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, doc string")
    got = [r["ok"] for r in df.select(CH.chart_validate(df, "doc").alias("ok")).orderBy("id").collect()]
    assert got == [True, False, False, False, False, False]


def test_c11_missing_threshold_is_strict(spark):
    cols = [f"c{i}" for i in range(10)]
    # 10 rows x 10 columns: exactly 30 missing cells, then 31
    exact = [tuple(None if (r * 10 + c) < 30 else 1.0 for c in range(10)) for r in range(10)]
    over = [tuple(None if (r * 10 + c) < 31 else 1.0 for c in range(10)) for r in range(10)]
    schema = ", ".join(f"{c} double" for c in cols)
    assert Q.check_missing_ratio(spark.createDataFrame(exact, schema)).first()["warn"] is False
    assert Q.check_missing_ratio(spark.createDataFrame(over, schema)).first()["warn"] is True
    w = Q.validate(spark.createDataFrame(over, schema), "descriptive").first()["warnings"]
    assert "many_missing_values:31" in w


def test_c14_one_row_std_is_null(spark):
    df = spark.createDataFrame([(3.5,)], "x double")
    row = D.describe_numeric(df).first()
    assert row["std"] is None and row["q25"] == 3.5 and row["median"] == 3.5
    doc = json.loads(results_json(D.describe_numeric(df), "column_name").first()["document"])
    assert doc["std"] is None and doc["count"] == 1


def test_nan_is_missing_everywhere(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (3.0, "c")], "x double, s string")
    assert {r["column_name"]: r["missing"] for r in Q.null_counts(df).collect()} == {"x": 1, "s": 1}
    d = D.describe_numeric(df).first()
    assert d["count"] == 2 and d["mean"] == 2.0
    assert Q.complete_rows(df).first()["n"] == 2


def test_unknown_analysis_type_keeps_the_error(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    res = run_analysis(df, "custom")
    assert res.status == "failed" and res.error == "unsupported_analysis_type:custom"


def test_scalar_functions(spark):
    df = spark.createDataFrame([(1, 0), (1, 8), (3, 4)], "p int, t int")
    got = [r["v"] for r in df.select(X.fn_percentage("p", "t").alias("v")).collect()]
    assert got == [0.0, 12.5, 75.0]
    sizes = spark.createDataFrame([(1,), (10,), (1536,), (3 * 1024 ** 3,)], "n bigint")
    txt = [r["s"] for r in sizes.select(X.fn_human_bytes("n").alias("s")).collect()]
    assert txt == ["1 byte", "10 bytes", "1.5 KB", "3.0 GB"]
    t = spark.createDataFrame([("x" * 60,), ("short",)], "m string")
    titles = [r["t"] for r in t.select(X.title_from_message(F.lit("Nouvelle conversation"), F.col("m")).alias("t")).collect()]
    assert titles == ["x" * 50 + "...", "short"]
    trunc = [r["t"] for r in t.select(X.fn_truncate("m", 10).alias("t")).collect()]
    assert trunc == ["x" * 9 + "…", "short"]
