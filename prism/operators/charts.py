"""Chart-data shaping (C1-C10): numbers and labels of the charts, as long rows

    (chart, chart_type, series_pos, series, label_pos, label, value, color)

built from the small analysis result tables; ``chart_document`` folds them into
``{labels: [...], datasets: [{label, data: [...]}]}``. Every input here is an
analysis result whose size is bounded by the schema (columns, pairs, top-k),
never by the data rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prism.functions.sqltext import column
from prism.operators.correlate import top_correlations
from prism.operators.describe import dataset_summary, missing_by_dataset
from prism.session import cut_lineage

# Chart labels and series names of the reference (French presentation defaults).
COMPOSITION_LABELS = ["Colonnes Numériques", "Colonnes Catégorielles", "Valeurs Manquantes"]
COMPOSITION_SERIES = "Nombre"
FIVE_NUMBER_LABELS = ["Minimum", "Q1 (25%)", "Médiane", "Q3 (75%)", "Maximum"]
MEDIAN_SERIES, MEAN_SERIES = "Médiane", "Moyenne"
OTHER_LABEL = "Autres"
CATEGORY_CHART_TYPES = ["pie", "doughnut", "polarArea", "bar"]
COMPLETENESS_LABELS = ["Complètes", "Avec valeurs manquantes"]
CORRELATION_SERIES = "Force de corrélation"
CORRELATION_PROFILE_SERIES = "Corrélation moyenne"
POSITIVE_COLOR, NEGATIVE_COLOR = "#2ECC71", "#E74C3C"

ROW_COLS = ["chart", "chart_type", "series_pos", "series", "label_pos", "label", "value", "color"]


def _row(chart, chart_type, series_pos, series, label_pos, label, value, color=None) -> Column:
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        lit(chart).cast("string").alias("chart"), lit(chart_type).cast("string").alias("chart_type"),
        lit(series_pos).cast("int").alias("series_pos"), lit(series).cast("string").alias("series"),
        lit(label_pos).cast("int").alias("label_pos"), lit(label).cast("string").alias("label"),
        lit(value).cast("double").alias("value"), lit(color).cast("string").alias("color"))


def _explode(df: DataFrame, rows: list[Column]) -> DataFrame:
    return df.select(F.inline(F.array(*rows)))


def _position(col: str, names: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col(col)).cast("int")


def chart_composition(df: DataFrame) -> DataFrame:
    """[#numeric, #categorical, missing cells] (doughnut)."""
    s = dataset_summary(df)
    vals = ["numeric_columns", "categorical_columns", "missing_values"]
    return _explode(s, [_row("composition", "doughnut", 1, COMPOSITION_SERIES, i + 1, lab, F.col(v))
                        for i, (lab, v) in enumerate(zip(COMPOSITION_LABELS, vals))])


def chart_five_number(describe: DataFrame, numeric_cols: list[str], n: int | None = None) -> DataFrame:
    """Min, q25, median, q75, max of the numeric columns (radar); ``n`` shows the first n only."""
    first = numeric_cols[:n]
    d = describe.where(F.col("column_name").isin(first)).withColumn("sp", _position("column_name", first))
    stats = ["min", "q25", "median", "q75", "max"]
    return _explode(d, [_row("five_number", "radar", F.col("sp"), F.col("column_name"), i + 1, lab,
                             F.coalesce(F.col(s), F.lit(0.0)))
                        for i, (lab, s) in enumerate(zip(FIVE_NUMBER_LABELS, stats))])


def chart_median_vs_mean(describe: DataFrame, numeric_cols: list[str], n: int | None = None) -> DataFrame:
    """Median and mean series over the numeric columns (bar); ``n`` shows the first n only."""
    first = numeric_cols[:n]
    d = describe.where(F.col("column_name").isin(first)).withColumn("lp", _position("column_name", first))
    return _explode(d, [
        _row("median_vs_mean", "bar", 1, MEDIAN_SERIES, F.col("lp"), F.col("column_name"), F.coalesce(F.col("median"), F.lit(0.0))),
        _row("median_vs_mean", "bar", 2, MEAN_SERIES, F.col("lp"), F.col("column_name"), F.coalesce(F.col("mean"), F.lit(0.0))),
    ])


def chart_category_topk_other(top: DataFrame, categorical_cols: list[str], k: int = 8, n: int | None = None,
                              totals: DataFrame | None = None) -> DataFrame:
    """C4: per categorical column its ``k`` most frequent values plus ``Autres``; the chart
    type rotates pie, doughnut, polarArea, bar; ``n`` shows the first n columns only.

    ``totals`` (column_name, n) makes ``Autres`` all other values of the column; without it
    it is the rest of the ``top`` list only, as on the reference's screen."""
    first = categorical_cols[:n]
    t = top.where(F.col("column_name").isin(first))
    shown = t.where(F.col("rank") <= k).select("column_name", F.col("rank").alias("lp"), F.col("value").alias("label"),
                                               F.col("count").alias("value"))
    if totals is None:
        other = t.where(F.col("rank") > k).groupBy("column_name").agg(F.sum("count").alias("value"))
    else:
        other = (totals.where(F.col("column_name").isin(first))
                 .join(shown.groupBy("column_name").agg(F.sum("value").alias("s")), "column_name", "left")
                 .select("column_name", (F.col("n") - F.coalesce("s", F.lit(0))).alias("value")))
    folded = shown.unionByName(other.select("column_name", F.lit(k + 1).alias("lp"), F.lit(OTHER_LABEL).alias("label"), "value"))
    types = F.array(*[F.lit(x) for x in CATEGORY_CHART_TYPES])
    return folded.withColumn("cp", _position("column_name", first)).where(F.col("value") > 0).select(
        F.concat(F.lit("category:"), F.col("column_name")).alias("chart"),
        F.element_at(types, ((F.col("cp") - 1) % len(CATEGORY_CHART_TYPES) + 1).cast("int")).alias("chart_type"),
        F.lit(1).alias("series_pos"), F.col("column_name").alias("series"),
        F.col("lp").cast("int").alias("label_pos"), F.col("label"),
        F.col("value").cast("double").alias("value"), F.lit(None).cast("string").alias("color"))


def category_totals(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, n): non-null cells of each column, one aggregate."""
    one = df.agg(*[F.count(column(c)).alias(f"n{i}") for i, c in enumerate(cols)])
    return _explode(one, [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n")) for i, c in enumerate(cols)])


def chart_completeness(df: DataFrame, only_if_missing: bool = False) -> DataFrame:
    """Complete cells vs missing cells (pie); optionally only when cells are missing."""
    m = missing_by_dataset(df)
    if only_if_missing:
        m = m.where(F.col("missing") > 0)
    return _explode(m, [_row("completeness", "pie", 1, "Valeurs", 1, COMPLETENESS_LABELS[0], F.col("complete")),
                        _row("completeness", "pie", 1, "Valeurs", 2, COMPLETENESS_LABELS[1], F.col("missing"))])


def chart_top_correlations(top: DataFrame) -> DataFrame:
    """``a ↔ b`` labels, |r| values, colour by sign (bar)."""
    return top.select(
        F.lit("top_correlations").alias("chart"), F.lit("bar").alias("chart_type"), F.lit(1).alias("series_pos"),
        F.lit(CORRELATION_SERIES).alias("series"), F.col("rank").cast("int").alias("label_pos"),
        F.concat(F.col("var1"), F.lit(" ↔ "), F.col("var2")).alias("label"),
        F.abs(F.col("r")).alias("value"),
        F.when(F.col("r") > 0, F.lit(POSITIVE_COLOR)).otherwise(F.lit(NEGATIVE_COLOR)).alias("color"))


def chart_correlation_profile(matrix: DataFrame, variables: list[str], n: int | None = None) -> DataFrame:
    """Mean |r| of each variable with the others (radar; ``n``: among the first n only);
    empty with fewer than two variables."""
    first = variables[:n]
    if len(first) < 2:
        return matrix.sparkSession.createDataFrame([], ", ".join(
            f"{c} {t}" for c, t in zip(ROW_COLS, ["string", "string", "int", "string", "int", "string", "double", "string"])))
    m = matrix.where(F.col("var1").isin(first) & F.col("var2").isin(first) & (F.col("var1") != F.col("var2")))
    return (m.groupBy("var1").agg(F.avg(F.abs("r")).alias("value"))
            .select(F.lit("correlation_profile").alias("chart"), F.lit("radar").alias("chart_type"),
                    F.lit(1).alias("series_pos"), F.lit(CORRELATION_PROFILE_SERIES).alias("series"),
                    _position("var1", first).alias("label_pos"), F.col("var1").alias("label"), "value",
                    F.lit(None).cast("string").alias("color")))


def chart_validate(docs: DataFrame, doc: str = "doc") -> Column:
    """True when the JSON document has a list ``labels``, a non-empty list
    ``datasets`` and every dataset has a list ``data``."""
    d = F.col(doc)
    parsed = F.from_json(d, "struct<labels: string, datasets: array<string>>")
    labels_ok = F.json_array_length(F.get_json_object(d, "$.labels")).isNotNull()
    ds = parsed["datasets"]
    ds_ok = F.coalesce(F.json_array_length(F.get_json_object(d, "$.datasets")), F.lit(0)) > 0
    each = F.forall(ds, lambda x: F.json_array_length(F.get_json_object(x, "$.data")).isNotNull())
    return F.coalesce(labels_ok & ds_ok & each, F.lit(False))


def chart_document(rows: DataFrame) -> DataFrame:
    """Fold chart rows into (chart, chart_type, document) with the nested chart struct."""
    per_series = rows.groupBy("chart", "chart_type", "series_pos", "series").agg(
        F.array_sort(F.collect_list(F.struct("label_pos", "label", "value", "color"))).alias("pts"))
    per_series = per_series.select(
        "chart", "chart_type", "series_pos",
        F.transform("pts", lambda p: p["label"]).alias("labels"),
        F.struct(F.col("series").alias("label"), F.transform("pts", lambda p: p["value"]).alias("data"),
                 F.filter(F.transform("pts", lambda p: p["color"]), lambda c: c.isNotNull()).alias("backgroundColor")).alias("ds"))
    return per_series.groupBy("chart", "chart_type").agg(
        F.min_by("labels", "series_pos").alias("labels"),
        F.transform(F.array_sort(F.collect_list(F.struct("series_pos", "ds"))), lambda x: x["ds"]).alias("datasets"),
    ).select("chart", "chart_type", F.struct("labels", "datasets").alias("document"))


def chart_custom(rows: DataFrame, title: str, chart_type: str) -> DataFrame:
    """A chart document from any (series, label_pos, label, value) table, with its C8 verdict."""
    full = rows.select(F.lit(title).alias("chart"), F.lit(chart_type).alias("chart_type"),
                       F.coalesce(F.col("series_pos"), F.lit(1)).cast("int").alias("series_pos") if "series_pos" in rows.columns
                       else F.lit(1).alias("series_pos"),
                       "series", F.col("label_pos").cast("int").alias("label_pos"), F.col("label").cast("string").alias("label"),
                       F.col("value").cast("double").alias("value"), F.lit(None).cast("string").alias("color"))
    docs = chart_document(full).withColumn("doc", F.to_json("document"))
    return docs.select("chart", "chart_type", "doc", chart_validate(docs, "doc").alias("is_valid"))


def auto_charts(analysis_type: str, *, df: DataFrame | None = None, describe: DataFrame | None = None,
                top10: DataFrame | None = None, numeric_cols: list[str] | None = None,
                categorical_cols: list[str] | None = None, top: DataFrame | None = None,
                matrix: DataFrame | None = None, variables: list[str] | None = None,
                materialize: bool = True) -> DataFrame | None:
    """Every chart of an analysis type. descriptive: C1, C2, C3, C4 and C5
    (only when cells are missing); correlation: C6, C7; regression/clustering: none.

    Result tables feeding several charts are small (bounded by the schema); with
    ``materialize`` they are checkpointed once into the shared folder so each
    chart reads them instead of recomputing their passes."""
    if materialize:
        descriptive = analysis_type == "descriptive"
        describe, top10 = [cut_lineage(t) if t is not None and descriptive else t for t in (describe, top10)]
        if matrix is not None and analysis_type == "correlation":
            matrix = cut_lineage(matrix)
            top = top_correlations(matrix)  # from the written matrix: it is aggregated once
    parts: list[DataFrame] = []
    if analysis_type == "descriptive":
        parts.append(chart_composition(df))
        if numeric_cols:
            parts += [chart_five_number(describe, numeric_cols), chart_median_vs_mean(describe, numeric_cols)]
        if categorical_cols:
            parts.append(chart_category_topk_other(top10, categorical_cols, totals=category_totals(df, categorical_cols)))
        parts.append(chart_completeness(df, only_if_missing=True))
    elif analysis_type == "correlation":
        parts += [chart_top_correlations(top), chart_correlation_profile(matrix, variables)]
    if not parts:
        return None
    out = parts[0].select(*ROW_COLS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*ROW_COLS))
    return out


# ------------------------------------------------------------------ charts named by the reference
# without a computation behind them (histogram, outlier fences, scatter sample, heatmap, box, line).
def chart_histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram of ``col`` over [min, max]: (bucket, lower, upper, count) as
    chart rows. The range is one aggregate row; buckets are a grouped count."""
    from prism.functions.missing import clean_numeric
    v = clean_numeric(col)
    mn, mx = df.agg(F.min(v), F.max(v)).first()
    if mn is None:
        return df.sparkSession.createDataFrame([], ", ".join(
            f"{c} {t}" for c, t in zip(ROW_COLS, ["string", "string", "int", "string", "int", "string", "double", "string"])))
    width = (mx - mn) if mx > mn else 1.0
    bucket = F.least(F.floor((v - F.lit(mn)) * F.lit(float(bins)) / F.lit(float(width))) + 1, F.lit(bins)).cast("int")
    counts = df.where(v.isNotNull()).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    lo = F.lit(float(mn)) + (F.col("b") - 1) * F.lit(float(width) / bins)
    return counts.select(
        F.lit(f"histogram:{col}").alias("chart"), F.lit("bar").alias("chart_type"), F.lit(1).alias("series_pos"),
        F.lit(col).alias("series"), F.col("b").alias("label_pos"),
        F.format_string("%.2f", lo).alias("label"), F.col("n").cast("double").alias("value"),
        F.lit(None).cast("string").alias("color"))


def outlier_fences(df: DataFrame, describe: DataFrame, k: float = 1.5) -> DataFrame:
    """(column_name, lower, upper, n_outliers): Tukey fences q25 - k*IQR, q75 + k*IQR
    from the describe rows, outliers counted in one aggregate over ``df``."""
    from prism.functions.missing import clean_numeric
    fences = {r["column_name"]: (r["q25"], r["q75"]) for r in describe.select("column_name", "q25", "q75").collect()
              if r["q25"] is not None}
    cols = list(fences)
    aggs = []
    for i, c in enumerate(cols):
        q1, q3 = fences[c]
        lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
        v = clean_numeric(c)
        aggs.append(F.count_if((v < F.lit(lo)) | (v > F.lit(hi))).alias(f"o{i}"))
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"),
                 F.lit(fences[c][0] - k * (fences[c][1] - fences[c][0])).alias("lower"),
                 F.lit(fences[c][1] + k * (fences[c][1] - fences[c][0])).alias("upper"),
                 F.col(f"o{i}").alias("n_outliers")) for i, c in enumerate(cols)])))


def chart_scatter_sample(df: DataFrame, x: str, y: str, order: Column, n: int = 500) -> DataFrame:
    """Scatter points: a deterministic sample of ``n`` (x, y) pairs, the rows with the
    smallest ``order`` (e.g. a hash of the row key). The limit is the sampling feature."""
    pts = (df.where(column(x).isNotNull() & column(y).isNotNull())
           .select(order.alias("_o"), column(x).cast("string").alias("label"), column(y).cast("double").alias("value")).orderBy("_o").limit(n))
    return pts.select(
        F.lit(f"scatter:{x}:{y}").alias("chart"), F.lit("scatter").alias("chart_type"), F.lit(1).alias("series_pos"),
        F.lit(f"{x} vs {y}").alias("series"), F.lit(None).cast("int").alias("label_pos"),
        "label", "value", F.lit(None).cast("string").alias("color"))


def chart_heatmap(matrix: DataFrame) -> DataFrame:
    """Correlation heatmap: one series per variable, one point per other variable."""
    return matrix.select(
        F.lit("heatmap").alias("chart"), F.lit("heatmap").alias("chart_type"), F.col("pos1").cast("int").alias("series_pos"),
        F.col("var1").alias("series"), F.col("pos2").cast("int").alias("label_pos"), F.col("var2").alias("label"),
        F.col("r").alias("value"), F.lit(None).cast("string").alias("color"))


def chart_box(describe: DataFrame, numeric_cols: list[str], n: int | None = None) -> DataFrame:
    """Box plot data: five-number summary of the numeric columns."""
    rows = chart_five_number(describe, numeric_cols, n)
    return rows.withColumn("chart", F.lit("box")).withColumn("chart_type", F.lit("boxplot"))


def chart_line(counts: DataFrame, x: str, y: str = "count", name: str = "line") -> DataFrame:
    """Line chart of an ordered series (e.g. daily or monthly counts)."""
    return counts.select(
        F.lit(name).alias("chart"), F.lit("line").alias("chart_type"), F.lit(1).alias("series_pos"),
        F.lit(y).alias("series"), F.dense_rank().over(Window.orderBy(x)).alias("label_pos"),
        F.col(x).cast("string").alias("label"), F.col(y).cast("double").alias("value"),
        F.lit(None).cast("string").alias("color"))
