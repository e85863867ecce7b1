"""run_analysis: validate, run one analysis type, shape its charts.

Returns an ``AnalysisResult`` with a status instead of mutating a database row.
Result tables are lazy DataFrames over the caller's input, which is neither cached
nor uncached here: a caller that wants it kept between the passes persists it itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prism.operators import charts as CH
from prism.operators import correlate as C
from prism.operators import describe as D
from prism.operators import model as M
from prism.operators import quality as Q
from prism.operators import timeseries as TS
from prism.operators.roles import roles
from prism.session import cut_lineage

ANALYSIS_TYPES = ["descriptive", "correlation", "regression", "clustering", "timeseries"]


@dataclass
class AnalysisResult:
    status: str                      # completed | failed
    error: str | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    charts: DataFrame | None = None
    validation: dict | None = None


def run_analysis(df: DataFrame, analysis_type: str, params: dict | None = None) -> AnalysisResult:
    params = params or {}
    if analysis_type not in ANALYSIS_TYPES:
        return AnalysisResult("failed", f"unsupported_analysis_type:{analysis_type}")
    src = df
    try:
        v = Q.validate(src, analysis_type).first().asDict()
        if not v["is_valid"]:
            return AnalysisResult("failed", "validation_failed:" + "; ".join(v["errors"]), validation=v)
        r = roles(src)
        tables: dict[str, DataFrame] = {}
        charts = None
        if analysis_type == "descriptive":
            tables["summary"] = D.dataset_summary(src)
            if r.numeric:
                tables["numeric_stats"] = cut_lineage(D.describe_numeric(src))
            if r.categorical:
                tables["categorical_unique"] = D.categorical_nunique(src)
                tables["categorical_top10"] = cut_lineage(D.categorical_top10(src))
            charts = CH.auto_charts("descriptive", df=src, describe=tables.get("numeric_stats"),
                                    top10=tables.get("categorical_top10"), numeric_cols=r.numeric,
                                    categorical_cols=r.categorical, materialize=False)
        elif analysis_type == "correlation":
            res = C.correlation_analysis(src)
            matrix = cut_lineage(res.matrix)
            top = cut_lineage(C.top_correlations(matrix))
            tables.update(matrix=matrix, strong_correlations=top,
                          summary=C.correlation_summary_from(top, len(res.kept), len(r.numeric), res.kept))
            charts = CH.auto_charts("correlation", top=top, matrix=matrix, variables=res.kept, materialize=False)
        elif analysis_type == "regression":
            res = M.regression_analysis(src, params.get("target_column"), params.get("feature_columns"),
                                        params.get("split_key"))
            tables.update(coefficients=res.coefficients, metrics=res.metrics.withColumn(
                "n_samples", F.lit(res.n_samples).cast("bigint")))
        elif analysis_type == "clustering":
            res = M.kmeans(src, params.get("columns"), params.get("n_clusters"))
            tables.update(clusters=res.profile.withColumn("inertia", F.lit(res.inertia)), assigned=res.assigned)
        elif analysis_type == "timeseries":
            tables["summary"] = TS.timeseries_summary(src, params.get("date_column"), params.get("value_column"))
        return AnalysisResult("completed", tables=tables, charts=charts, validation=v)
    except (ValueError, PySparkException) as e:  # a bad parameter, such as a column that is not there
        return AnalysisResult("failed", str(e))
