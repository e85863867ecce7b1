"""prism: Spark-native tabular analytics (profiling, quality checks, statistics,
modelling, chart data and workspace queries) on the DataFrame API.

Typical use::

    from prism import load, column_profile, validate, run_analysis
    df = load(spark, "s3://bucket/sales.csv")
    column_profile(df).show()
    res = run_analysis(df, "descriptive")
    res.tables["numeric_stats"].show()
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# functions that run in Python workers travel with their task: executors need not have this package
register_pickle_by_value(sys.modules[__name__])


from prism.operators.correlate import correlation_analysis, correlation_matrix
from prism.operators.describe import categorical_top10, dataset_summary, describe_numeric, describe_numeric_approx
from prism.operators.model import kmeans, regression_analysis
from prism.operators.quality import compatibility_matrix, validate
from prism.operators.roles import column_profile, roles
from prism.operators.timeseries import timeseries_summary
from prism.plans.analysis import AnalysisResult, run_analysis
from prism.sources.readers import load

__version__ = "0.1.0"

__all__ = [
    "AnalysisResult", "categorical_top10", "column_profile", "compatibility_matrix", "correlation_analysis",
    "correlation_matrix", "dataset_summary", "describe_numeric", "describe_numeric_approx", "kmeans", "load",
    "regression_analysis", "roles", "run_analysis", "timeseries_summary", "validate",
]
