"""Readers and writers: pandas load parity (C12, C13), the workbook folder source
(S2), format dispatch (S5), file metadata (S6), sinks (S8-S11), stream = batch."""

import io
import json
import os
import zipfile

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prism.sources import readers as RD
from prism.sources import sinks as S
from prism.sources import xlsx
from prism.sources.xlsx import EPOCH, _as_date, _shows_date, scan_xlsx, workbook_cells, write_xlsx
from prism.streaming import counters as ST


def test_c12_csv_matches_pandas(spark, tmp_dir):
    text = "id,score,flag,day,label\n1,NA,True,2024-01-01,x\n2,NaN,False,2024-01-02,\n3,2.5,True,2024-01-03,NULL\n"
    path = os.path.join(tmp_dir, "c12.csv")
    with open(path, "w") as f:
        f.write(text)
    df = RD.scan_csv(spark, path)
    pdf = pd.read_csv(io.StringIO(text))
    assert dict(df.dtypes) == {"id": "bigint", "score": "double", "flag": "boolean", "day": "string", "label": "string"}
    rows = df.orderBy("id").collect()
    for r, (_, p) in zip(rows, pdf.iterrows()):
        assert r["id"] == p["id"] and r["flag"] == p["flag"] and r["day"] == p["day"]
        assert (r["score"] is None) == pd.isna(p["score"])
        assert (r["label"] is None) == pd.isna(p["label"])


def test_c13_json_records_and_columns(spark, tmp_dir):
    pdf = pd.DataFrame({"a": [1, 2, 3], "b": ["x", "y", None], "c": [0.5, 1.5, 2.5]})
    rec = os.path.join(tmp_dir, "rec.json")
    col = os.path.join(tmp_dir, "col.json")
    pdf.to_json(rec, orient="records")
    pdf.to_json(col)  # pandas default: column-oriented
    for path in (rec, col):
        got = RD.scan_json(spark, path)
        back = pd.read_json(path)
        g = got.select("a", "b", "c").orderBy("a").toPandas()
        assert list(g["a"]) == list(back["a"])
        assert list(g["c"]) == list(back["c"])
        assert [None if pd.isna(v) else v for v in g["b"]] == [None if pd.isna(v) else v for v in back["b"]]


def _workbook(rows):
    """A minimal .xlsx: shared strings for text, numbers inline, one sheet."""
    strings, cells_xml = [], []
    for r, row in enumerate(rows, start=1):
        cs = []
        for c, v in enumerate(row):
            ref = f"{chr(65 + c)}{r}"
            if isinstance(v, bool):
                cs.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, (int, float)):
                cs.append(f'<c r="{ref}"><v>{v}</v></c>')
            elif v is None:
                continue
            else:
                strings.append(v)
                cs.append(f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>')
        cells_xml.append(f'<row r="{r}">{"".join(cs)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rns}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Type="worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}>' + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{"".join(cells_xml)}</sheetData></worksheet>')
    return buf.getvalue()


def test_s2_workbook_folder(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "books")
    os.makedirs(folder)
    with open(os.path.join(folder, "a.xlsx"), "wb") as f:
        f.write(_workbook([["name", "qty", "ok"], ["pen", 3, True], ["ink", 1.5, False]]))
    with open(os.path.join(folder, "b.xlsx"), "wb") as f:
        f.write(_workbook([["name", "qty", "ok"], ["cap", 7, True], ["NA", None, False]]))
    cells = list(workbook_cells(open(os.path.join(folder, "a.xlsx"), "rb").read()))
    assert (1, 1, "name", False) in cells and (2, 2, "3", False) in cells
    df = scan_xlsx(spark, folder)
    assert dict(df.dtypes) == {"name": "string", "qty": "double", "ok": "boolean"}
    rows = [tuple(r) for r in df.collect()]
    assert rows == [("pen", 3.0, True), ("ink", 1.5, False), ("cap", 7.0, True), (None, None, False)]
    assert RD.load(spark, os.path.join(folder, "a.xlsx")).count() == 2


def test_s2_workbooks_with_other_columns_and_orders(spark, tmp_dir):
    for name, rows in (("a", [["name", "qty"], ["pen", 3]]), ("b", [["qty", "name", "price"], [7, "cap", 2.5], [8, "hat", None]])):
        with open(os.path.join(tmp_dir, f"{name}.xlsx"), "wb") as f:
            f.write(_workbook(rows))
    got = scan_xlsx(spark, tmp_dir)
    assert sorted((r["name"], r["qty"], r["price"]) for r in got.collect()) == [("cap", 7, 2.5), ("hat", 8, None), ("pen", 3, None)]


def test_s5_dispatch_errors(spark, tmp_dir):
    with pytest.raises(ValueError, match="unsupported_format"):
        RD.load(spark, os.path.join(tmp_dir, "x.txt"))
    with pytest.raises(ValueError, match="unsupported_format:api"):
        RD.load(spark, os.path.join(tmp_dir, "x.csv"), "api")


def test_s6_metadata_bytes(spark, tmp_dir, sf_dir):
    path = f"{sf_dir}/nation.parquet"
    m = RD.ingest_metadata(spark, path).first()
    assert m["rows"] == 25 and m["columns"] == 3 and m["bytes"] == os.path.getsize(path)


def test_s8_to_s11_writers(spark, tmp_dir, sf_dir):
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    lines = S.transcript_txt(conv, "conv_id", "turn", "role", "text")
    out = os.path.join(tmp_dir, "txt")
    S.write_lines(lines, out)
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.startswith("part-"))
    assert text.startswith("Conversation: Conversation ")
    js = S.transcript_json(conv, "conv_id", "turn", "role", "text")
    heads = js.where(F.col("line_no") == -1).collect()
    assert sum(json.loads(h["line"])["n_messages"] for h in heads) == conv.count()
    df = spark.createDataFrame([("a", float("nan"), None)], "k string, x double, y string")
    doc = json.loads(S.results_json(df, "k").first()["document"])
    assert doc == {"k": "a", "x": None, "y": None}


def test_stream_equals_batch_with_several_micro_batches(spark, sf_dir):
    s = ST.parquet_stream(spark, sf_dir, "orders.parquet", max_files_per_trigger=1)
    got = {r["status"]: r["count"] for r in ST.run_to_table(spark, ST.stream_status_counts(s, "o_orderstatus"), ["status"], "t").collect()}
    batch = {r["o_orderstatus"]: r["count"] for r in spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()}
    assert got == batch


def test_s1_large_files_are_split_unless_lines_break(spark, tmp_dir):
    """Files without line ends in quotes are read by many tasks, those with them whole, also in one folder."""
    plain, mixed = f"{tmp_dir}/plain", f"{tmp_dir}/mixed"
    os.makedirs(plain), os.makedirs(mixed)
    rows = [f'{i},"say ""{i}"" now",x{i}' for i in range(60_000)]
    for folder in (plain, mixed):
        with open(f"{folder}/a.csv", "w") as f:
            f.write("n,t,u\n" + "\n".join(rows) + "\n")
    with open(f"{mixed}/b.csv", "w") as f:
        f.write('n,t,u\n-1,"two\nlines, ""quoted""",y\n-2,plain,z\n')
    broken = {os.path.basename(k): v for k, v in RD.files_with_broken_lines(spark, mixed).items()}
    assert broken == {"a.csv": False, "b.csv": True}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        df = RD.scan_csv(spark, plain)
        assert df.rdd.getNumPartitions() > 4 and df.count() == 60_000
        assert df.where("n = 17").first()["t"] == 'say "17" now'
        both = RD.scan_csv(spark, mixed)
        assert both.rdd.getNumPartitions() > 4 and both.count() == 60_002 and both.schema["n"].dataType.simpleString() == "bigint"
        assert both.where("n = -1").first()["t"] == 'two\nlines, "quoted"'
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_s1_a_stray_quote_reads_as_before(spark, tmp_dir):
    with open(f"{tmp_dir}/s.csv", "w") as f:
        f.write('a,b\n1,5" pipe\n2,six\n')
    assert [tuple(r) for r in RD.scan_csv(spark, f"{tmp_dir}/s.csv").orderBy("a").collect()] == [(1, '5" pipe'), (2, "six")]


def test_s5_layout_is_told_by_the_first_line(spark, tmp_dir):
    with open(f"{tmp_dir}/a.json", "w") as f:
        f.write("\n \n  [\n" + ",\n".join('{"x": %d}' % i for i in range(5)) + "]")
    with open(f"{tmp_dir}/b.json", "w") as f:
        f.write('\n{"x":\n {"0": 7}}')
    assert sorted(r["x"] for r in RD.scan_json(spark, tmp_dir).collect()) == [0, 1, 2, 3, 4, 7]


def test_s6_rows_are_counted_by_the_inference_pass(spark, tmp_dir):
    with open(f"{tmp_dir}/c.csv", "w") as f:
        f.write('n,t\n' + "".join(f'{i},"a\nb"\n' for i in range(100)))
    df = RD.ingest_metadata(spark, f"{tmp_dir}/c.csv")
    assert "Scan csv" not in df._jdf.queryExecution().executedPlan().toString()
    assert (df.first()["rows"], df.first()["columns"]) == (100, 2)
    with open(f"{tmp_dir}/e.csv", "w") as f:
        f.write("n,t\n")
    assert RD.ingest_metadata(spark, f"{tmp_dir}/e.csv").first()["rows"] == 0


def test_s2_written_workbooks_read_back(spark, tmp_dir):
    """Types, dates, blank rows, odd text and many workbooks, against the rows themselves and a pandas-like reading."""
    import datetime as dt

    rows = [(i, i / 3, i % 2 == 0, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i, milliseconds=i), dt.date(1999, 12, 31) + dt.timedelta(i),
             f"<t&{i}> _x0041_ \x01 é\n", None if i % 4 else 7) for i in range(50)]
    rows[10] = (None,) * 7
    df = spark.createDataFrame(rows, "`a.b` long, f double, ok boolean, at timestamp_ntz, day date, t string, n int").coalesce(1)
    write_xlsx(df, f"{tmp_dir}/books", rows=20)
    files = os.listdir(f"{tmp_dir}/books")
    assert len([f for f in files if f.endswith(".xlsx")]) == 3 and not any(f.startswith("_writing") for f in files)
    back = scan_xlsx(spark, f"{tmp_dir}/books")
    assert [t for _, t in back.dtypes] == ["bigint", "double", "boolean", "timestamp_ntz", "timestamp_ntz", "string", "bigint"]
    got = sorted((tuple(r) for r in back.collect()), key=lambda r: (r[0] is not None, r[0]) if r[0] is not None else (False, 0))
    want = [(None,) * 7] + [(a, f, ok, at, dt.datetime(d.year, d.month, d.day), t, n) for a, f, ok, at, d, t, n in rows if a is not None]
    assert got == want
    write_xlsx(df.limit(0), f"{tmp_dir}/none")
    assert scan_xlsx(spark, f"{tmp_dir}/none").count() == 0


def test_s2_date_formats():
    assert all(map(_shows_date, ["yyyy-mm-dd", "d/m", "[$-40C]d mmm yyyy;@", "DD.MM.YY"]))
    assert not any(map(_shows_date, ["0.00", '0" days"', "[h]:mm:ss", "hh:mm", "#,##0_d", "[Red]0"]))
    assert _as_date("45292.5", EPOCH) == "2024-01-01T12:00:00" and _as_date("1e300", EPOCH) is None


def test_workbooks_are_read_and_written_in_pieces(tmp_path):
    """A task holds some cells of a workbook, whatever its rows."""
    n = 20_000
    writer = xlsx.WorkbookWriter(str(tmp_path), ["a", "b"], 15_000)
    files = writer.write((i, f"t{i}") if i % 7 else (None, None) for i in range(n)).files
    assert len(files) == 2
    for name, first, rows in zip(files, (0, 15_000), (15_000, 5_000)):
        batch = pa.RecordBatch.from_pydict({"path": [name], "content": pa.array([open(name, "rb").read()], pa.binary())})
        pieces = list(xlsx._cells_of(iter([batch]), 0))
        assert len(pieces) == -(-sum(p.num_rows for p in pieces) // xlsx.CELLS_AT_ONCE) and max(p.num_rows for p in pieces) <= xlsx.CELLS_AT_ONCE
        got = [(x["r"], x["c"], x["v"]) for p in pieces for x in p.to_pylist() if x["c"]]
        assert got == [(1, 1, "a"), (1, 2, "b")] + [(i - first + 2, c, v) for i in range(first, first + rows) if i % 7
                                                    for c, v in ((1, str(i)), (2, f"t{i}"))]
