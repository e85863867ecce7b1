"""Readers (S1, S3-S7): files to DataFrames with pandas-compatible load semantics.

Type inference runs as one distributed aggregate (does every non-missing value
of a text column cast to bigint / double / boolean?) instead of sampling on the
driver; the verdicts (one row, one flag per column and type) drive the casts.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from prism.functions.sqltext import column
from prism.session import cut_lineage

# The default missing-value tokens of pandas ``read_csv``.
DEFAULT_NA = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
              "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Text accepted as booleans by pandas inference.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]

# What reads as a number (a cast alone would also take suffixes, as in ``10D``).
INTEGER = r"^[+-]?\d+$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?([iI]nf(inity)?|INF(INITY)?)$"

FORMATS = {".csv": "csv", ".xlsx": "excel", ".json": "json", ".parquet": "parquet"}


def _na_to_null(c: Column, na_values: list[str]) -> Column:
    return F.when(~c.isin(*na_values) & c.isNotNull(), c)


def infer_types(df: DataFrame, cols: list[str] | None = None, rows: Observation | None = None) -> DataFrame:
    """Cast text columns whose non-missing values all parse: integer -> bigint,
    number -> double, True/False -> boolean; others stay text. One aggregate; ``rows`` observes the number of
    rows (metric ``rows``) that it has passed."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and (cols is None or f.name in cols)]
    if not cols:
        return df
    bools = TRUE_TOKENS + FALSE_TOKENS
    checks = []
    for i, c in enumerate(cols):
        v = column(c)
        present = v.isNotNull()
        checks += [
            F.count_if(present).alias(f"n{i}"),
            F.count_if(present & F.trim(v).rlike(INTEGER) & v.try_cast("bigint").isNotNull()).alias(f"i{i}"),
            F.count_if(present & F.trim(v).rlike(NUMBER) & v.try_cast("double").isNotNull()).alias(f"d{i}"),
            F.count_if(present & v.isin(*bools)).alias(f"b{i}"),
        ]
    r = (df if rows is None else df.observe(rows, F.count(F.lit(1)).alias("rows"))).agg(*checks).first()
    out = []
    for i, c in enumerate(cols):
        n = r[f"n{i}"]
        v = column(c)
        if n and r[f"i{i}"] == n:
            out.append(v.try_cast("bigint").alias(c))
        elif n and r[f"d{i}"] == n:
            out.append(v.try_cast("double").alias(c))
        elif n and r[f"b{i}"] == n:
            out.append(F.when(v.isin(*TRUE_TOKENS), F.lit(True)).when(v.isin(*FALSE_TOKENS), F.lit(False)).alias(c))
        elif n == 0:
            out.append(v.cast("double").alias(c))  # all missing: pandas gives a float column of NaN
        else:
            out.append(v)
    cast = {c: e for c, e in zip(cols, out)}
    return df.select(*[cast.get(c, column(c)) for c in df.columns])


def files_with_broken_lines(spark: SparkSession, path: str) -> dict[str, bool]:
    """File -> whether a line end may lie inside quotes, for the CSV files under ``path``, by one split scan.

    A record that goes on behind a line end leaves a quote open there, so that line has an odd number of
    quotes; in a file of whole records every line has an even number. (A single quote inside an unquoted field
    is odd too: such a file is read whole without need, but rightly.)"""
    value = F.col("value")
    odd = F.length(F.regexp_replace(value, '[^"]+', "")) % 2 == 1
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.when(value.contains('"'), odd).otherwise(False).alias("odd"))
    return {r["file"]: r["broken"] for r in lines.groupBy("file").agg(F.bool_or("odd").alias("broken")).collect()}


def scan_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, na_values: list[str] | None = None,
             infer: bool = True, multi_line: bool | None = None, rows: Observation | None = None) -> DataFrame:
    """CSV with a header row; NA tokens become NULL; types inferred as pandas
    does (dates stay text). With ``schema`` the given types are used.

    The dialect is pandas': a quote inside quotes is doubled, and quoted fields may hold line
    ends. A file with such fields is read by one task, all others are split; which files have
    them is found by one split scan, see :func:`files_with_broken_lines` (``multi_line`` takes it as known).
    ``rows`` observes the row count of the inference pass."""
    na = DEFAULT_NA if na_values is None else na_values
    reader = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").option("escape", '"')
    if multi_line is None:
        broken = files_with_broken_lines(spark, path)
        multi_line = any(broken.values())
        whole = sorted(f for f, b in broken.items() if b)
        split = sorted(f for f, b in broken.items() if not b)
    else:
        whole = split = []
    raw = reader.option("multiLine", multi_line).csv(path)
    if whole and split:  # file by file; the header line may be broken, so its columns are those of the reader above
        shaped = reader.schema(raw.schema)
        raw = shaped.option("multiLine", True).csv(whole).union(shaped.option("multiLine", False).csv(split))
    clean = raw.select(*[_na_to_null(column(c), na).alias(c) for c in raw.columns])
    if schema is not None:
        st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        return clean.select(*[column(f.name).try_cast(f.dataType).alias(f.name) for f in st.fields])
    return infer_types(clean, rows=rows) if infer else clean


def scan_json_records(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None) -> DataFrame:
    """S3: files holding a JSON array of records (one document per file)."""
    r = spark.read.option("multiLine", True)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def scan_json_columns(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None) -> DataFrame:
    """pandas' default column-oriented JSON ``{column: {row_label: value}}``.

    Each file is parsed as one document; cells are exploded to
    (file, column, row, value) and pivoted back per row. The pivot column list
    is the set of column names (bounded by the schema).
    """
    docs = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("_file"),
        F.from_json("value", "map<string, map<string, string>>").alias("doc"))
    cells = (docs.select("_file", F.explode("doc").alias("column_name", "cells"))
             .select("_file", "column_name", F.explode("cells").alias("row_label", "value")))
    if schema is not None:
        st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        names = [f.name for f in st.fields]
    else:
        cells = cut_lineage(cells, "json-cells")  # names, inference and result read the cells, not the documents
        names = [r["column_name"] for r in cells.select("column_name").distinct().orderBy("column_name").collect()]
    wide = cells.groupBy("_file", "row_label").pivot("column_name", names).agg(F.first("value")).drop("_file", "row_label")
    if schema is not None:
        return wide.select(*[column(f.name).try_cast(f.dataType).alias(f.name) for f in st.fields])
    return infer_types(wide)


def scan_json(spark: SparkSession, path: str, schema=None, layout: str | None = None) -> DataFrame:
    """JSON as pandas ``read_json``: a top-level array is records, an object is columns. Every
    file is read by its own layout (``layout`` "records" or "columns" takes it as known);
    a column that one layout's files lack is NULL in their rows."""
    if layout is None:
        # the first line of a file that is not blank: least block, then least position in the block's task
        lines = (spark.read.text(path).where(F.col("value").rlike(r"\S"))
                 .select(F.col("_metadata.file_path").alias("file"), F.ltrim("value").startswith("[").alias("records"),
                         F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place")))
        files = lines.groupBy("file").agg(F.min_by("records", "place").alias("records")).collect()
        by = {kind: sorted(r["file"] for r in files if r["records"] == kind) for kind in (True, False)}
    else:
        by = {layout == "records": [path]}
    parts = [reader(spark, by[kind], schema) for kind, reader in ((True, scan_json_records), (False, scan_json_columns)) if by.get(kind)]
    if len(parts) == 2 and schema is None:
        shared = set(parts[0].columns) & set(parts[1].columns)
        differ = {c for c in shared if parts[0].schema[c].dataType != parts[1].schema[c].dataType}
        parts = [infer_types(p.select(*[column(c).cast("string").alias(c) if c in differ else column(c) for c in p.columns]), list(differ))
                 if differ else p for p in parts]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan (filters and projections reach the scan)."""
    return spark.read.parquet(path)


def detect_format(path: str, fmt: str | None = None) -> str:
    if fmt:
        return fmt
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in FORMATS:
        raise ValueError(f"unsupported_format:{ext or path}")
    return FORMATS[ext]


def load(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Reader chosen by declared type or file extension; unknown types
    (including the declared-only ``api``) raise ``unsupported_format``."""
    kind = detect_format(path, fmt)
    if kind == "csv":
        return scan_csv(spark, path, **options)
    if kind == "excel":
        from prism.sources.xlsx import scan_xlsx
        return scan_xlsx(spark, path, **options)
    if kind == "json":
        return scan_json(spark, path, **options)
    if kind == "parquet":
        return scan_parquet(spark, path)
    raise ValueError(f"unsupported_format:{kind}")


def ingest_metadata(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """(rows, columns, bytes) of a loaded file set; bytes are the files' lengths, which the
    ``binaryFile`` source lists without reading a file. The rows of CSV files are counted by the inference pass."""
    kind, seen = detect_format(path, fmt), Observation()
    df = load(spark, path, kind, **({"rows": seen} if kind == "csv" else {}))
    length = F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("bytes")
    nbytes = spark.read.format("binaryFile").load(path).select("length").agg(length).first()["bytes"]
    columns = [F.lit(len(df.columns)).cast("bigint").alias("columns"), F.lit(nbytes).cast("bigint").alias("bytes")]
    if kind == "csv" and df.columns:  # all columns were text, so the inference pass has counted the rows
        return spark.range(1).select(F.lit(seen.get["rows"]).cast("bigint").alias("rows"), *columns)
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", *columns)


#: Rows of one JSON document that the writers make.
DOCUMENT_ROWS = 10_000


def write_json_records(df: DataFrame, path: str, rows: int = DOCUMENT_ROWS) -> None:
    """Write files of JSON arrays of at most ``rows`` records each (the layout S3 reads)."""
    def arrays(batches):
        import pandas as pd
        held: list[str] = []
        for batch in batches:
            for record in batch["j"]:
                held.append(record)
                if len(held) == rows:
                    yield pd.DataFrame({"value": ["[" + ",".join(held) + "]"]})
                    held = []
        if held:
            yield pd.DataFrame({"value": ["[" + ",".join(held) + "]"]})

    (df.select(F.to_json(F.struct(*[column(c) for c in df.columns])).alias("j"))
     .mapInPandas(arrays, "value string").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path))


def write_json_columns(df: DataFrame, path: str, rows: int = DOCUMENT_ROWS) -> None:
    """Write column-oriented documents ``{column: {row: value}}`` of at most ``rows`` rows each
    (the layout S4 reads; rows are labelled by their position in the document)."""
    cols = df.columns

    def documents(batches):
        import json as _json

        import pandas as pd
        for batch in batches:
            for start in range(0, len(batch), rows):
                part = batch.iloc[start:start + rows]
                doc = {c: {str(i): (None if pd.isna(v) else v) for i, v in enumerate(part[c].tolist())} for c in cols}
                yield pd.DataFrame({"value": [_json.dumps(doc, default=str)]})

    df.mapInPandas(documents, "value string").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
