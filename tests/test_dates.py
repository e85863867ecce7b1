"""Text dates: one form a column, elected over all its values; equal to pandas where pandas reads a column by one form."""

import warnings

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from prism.functions.dates import DATE_FORMS
from prism.operators import roles as RL
from prism.operators import timeseries as TS

#: form -> values of a column
COLUMNS = {
    "M/d/yyyy": ["01/02/2024", "03/04/2024"],
    "M/d/yyyy ": ["02/13/2024", "01/02/2024"],
    "M/d/yyyy  ": ["1/2/2024 1:05 PM", "12/31/2023 12:00 am"],
    "d/M/yyyy": ["13/02/2024", "01/02/2024"],
    "d/M/yyyy ": ["13/02/2024 10:11:12.5", "01/02/2024 01:02:03.25"],
    "M-d-yyyy": ["01-02-2024", "3-4-2024"],
    "d-M-yyyy": ["13-02-2024", "03-04-2024"],
    "M.d.yyyy": ["01.02.2024"],
    "d.M.yyyy": ["31.12.2023", "01.02.2024"],
    "M/d/yy": ["1/2/24", "12/31/99"],
    "yyyy/M/d": ["2024/01/02", "2024/1/3"],
    "yyyyMMdd": ["20240102", "20231231"],
    "MMM d, yyyy": ["Jan 5, 2024", "dec 16, 2023"],
    "MMMM d, yyyy": ["May 5, 2024", "June 5, 2024"],
    "d MMM yyyy": ["5 Jan 2024", "16 Feb 2024"],
    "d-MMM-yy": ["5-Jan-24", "06-Feb-23"],
    "iso": ["2024-01-02T10:11:12", "2023-12-31T00:00:00"],
    "iso ": ["", "2024-01-02", "NaT", None, "2023-01-02"],
}


def frame(spark, columns):
    rows = max(len(v) for v in columns.values())
    cells = [[*v, *[None] * (rows - len(v))] for v in columns.values()]
    schema = ", ".join(f"c{i} string" for i in range(len(columns))) + ", v double"
    return spark.createDataFrame([(*r, 1.0) for r in zip(*cells)], schema)


def pandas_range(values):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        parsed = pd.to_datetime(pd.Series(values, dtype=object))
    return parsed.min().isoformat(), parsed.max().isoformat()


def test_elected_forms_and_pandas(spark):
    df = frame(spark, COLUMNS)
    got = {r.column_name: r.form for r in RL.date_candidates(df).collect()}
    assert got == {f"c{i}": form.strip() for i, form in enumerate(COLUMNS)}
    for i, values in enumerate(COLUMNS.values()):
        one = TS.timeseries_summary(df, f"c{i}", "v").first()
        assert (one["start"], one["end"]) == pandas_range(values), values
        assert one["n_observations"] == sum(v not in (None, "", "NaT") for v in values) and one["message"] is None


@pytest.mark.parametrize("values, bad", [
    (["13/02/2024", "02/13/2024", "01/02/2024"], 1),
    (["2024-02-30", "2024-02-28"], 1), (["02/30/2024"], 1), (["garbage", "None", " "], 3), (["12345"], 1),
    (["2024-01-02", "01/02/2024", "2024-01-03"], 1), (["1/2/2024 13:05 PM"], 1), (["01/02/2024x"], 1),
])
def test_columns_without_a_form(spark, values, bad):
    df = frame(spark, {"c": values})
    assert RL.date_candidates(df).first()["form"] is None
    one = TS.timeseries_summary(df, "c0", "v").first()
    assert one["message"] == f"date_parse_error:{bad}" and one["start"] is None and one["mean"] is None


def test_own_formats_and_no_values(spark):
    df = frame(spark, {"a": ["2024|31|12"], "b": [None]})
    got = {r.column_name: (r.is_date, r.form) for r in RL.date_candidates(df, ["yyyy|dd|MM"]).collect()}
    assert got == {"c0": (True, "yyyy|dd|MM"), "c1": (False, None)}
    assert TS.timeseries_summary(df, "c0", "v", ["yyyy|dd|MM"]).first()["start"] == "2024-12-31T00:00:00"
    assert RL.date_candidates(df.select("v")).count() == 0


def test_one_scan(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("date_format(o_orderdate, 'MM/dd/yyyy') AS `a.b`", "o_totalprice AS `v.w`")
    for df in (RL.date_candidates(o), TS.timeseries_summary(o, "a.b", "v.w")):
        assert df._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
        assert df.count() == 1


PATTERNS = {"M/d/yyyy": "%m/%d/%Y", "d/M/yyyy": "%d/%m/%Y", "M-d-yyyy": "%m-%d-%Y", "d.M.yyyy": "%d.%m.%Y", "yyyy/M/d": "%Y/%m/%d"}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(days=st.lists(st.dates(min_value=pd.Timestamp("1950-01-01").date(), max_value=pd.Timestamp("2049-12-31").date()), min_size=1, max_size=8),
       form=st.sampled_from(sorted(PATTERNS)))
def test_property_first_form_that_fits_all(spark, days, form):
    values = [d.strftime(PATTERNS[form]) for d in days]

    def fits(pattern):
        try:
            return [pd.Timestamp(pd.to_datetime(v, format=pattern)) for v in values]
        except ValueError:
            return None

    order = ["%Y/%m/%d", "%m/%d/%Y", "%m-%d-%Y", "%m.%d.%Y", "%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y"]
    expected = next(p for p in map(fits, order) if p is not None)
    one = TS.timeseries_summary(frame(spark, {"c": values}), "c0", "v").first()
    assert (one["start"], one["end"]) == (min(expected).isoformat(), max(expected).isoformat())


def test_month_first_comes_before_day_first():
    order = DATE_FORMS
    for sep in "/-.":
        for year in ("yyyy", "yy"):
            assert order.index(f"M{sep}d{sep}{year}") < order.index(f"d{sep}M{sep}{year}")
