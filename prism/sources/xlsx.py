"""A folder of Excel workbooks (.xlsx) -> one table (first sheet, first row is
the header).

Spark has no built-in Excel source. Workbooks are read with the ``binaryFile``
source (any Hadoop file system, one row per file), each is unzipped and its
first sheet turned into long cells (file, row, column, text) by a
``mapInArrow`` task, some thousands of cells at once, and rows are pivoted back by the *names* in each workbook's own
header: columns may stand in any order, and one that a workbook lacks is NULL in its
rows. Only the stdlib ``zipfile``/``xml`` parsers run in the task.
A cell whose number format shows a day or a year is a date; a column of dates alone becomes a
timestamp, as in pandas (times of day and durations stay numbers). Blank rows between others are rows of NULLs.

Workbooks are written by a Python data source: a task writes its rows as workbooks under temporary names, and the
commit of all tasks gives them their final ones. The path may have any scheme that ``pyarrow.fs`` opens; reading goes
through Spark's own file sources.
"""

from __future__ import annotations

import datetime as dt
import io
import math
import re
import shutil
import tempfile
import uuid
import zipfile
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from prism.functions.sqltext import column
from prism.session import cut_lineage
from prism.sources.readers import DEFAULT_NA, infer_types

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
      "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
      "p": "http://schemas.openxmlformats.org/package/2006/relationships"}
CELLS_SCHEMA = "path string, r int, c int, v string, d boolean"
#: The built-in number formats that show a date.
DATE_FORMATS = {14, 15, 16, 17, 22, *range(27, 32), 36, 50, 51, 52, 53, 54, 57, 58}
EPOCH, EPOCH_1904 = dt.datetime(1899, 12, 30), dt.datetime(1904, 1, 1)


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n


def _text(node) -> str:
    """The node's text; characters that XML cannot hold are written as _xHHHH_."""
    text = "".join(t.text or "" for t in node.iter(f"{{{NS['m']}}}t"))
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _shows_date(code: str) -> bool:
    """Whether a number format's code shows a day or a year (quoted text, escapes and brackets aside)."""
    return bool(re.search("[dyDY]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.', "", code)))


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """The cell styles whose number format is a date."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.findall("m:numFmts/m:numFmt", NS)}
    formats = [int(x.get("numFmtId", 0)) for x in root.findall("m:cellXfs/m:xf", NS)]
    return {i for i, f in enumerate(formats) if (_shows_date(own[f]) if f in own else f in DATE_FORMATS)}


def _as_date(serial: str, epoch: dt.datetime) -> str | None:
    """ISO text of a serial day number, to the millisecond; None where there is no such date."""
    try:
        return (epoch + dt.timedelta(milliseconds=round(float(serial) * 86_400_000))).isoformat()
    except (OverflowError, ValueError):
        return None


def workbook_cells(data: bytes | pa.Buffer, sheet: int = 0) -> Iterator[tuple[int, int, str | None, bool]]:
    """Yield (row, column, text, is a date) of one sheet of an .xlsx workbook (1-based); a blank row
    between others yields (row, 0, None, False)."""
    with zipfile.ZipFile(pa.BufferReader(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ET.fromstring(z.read("xl/sharedStrings.xml"))
            shared = [_text(si) for si in root.findall("m:si", NS)]
        dates = _date_styles(z)
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        about = wb.find("m:workbookPr", NS)
        epoch = EPOCH_1904 if about is not None and about.get("date1904") in ("1", "true") else EPOCH
        sheets = wb.findall("m:sheets/m:sheet", NS)
        rid = sheets[sheet].get(f"{{{NS['r']}}}id")
        rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels.findall("p:Relationship", NS) if r.get("Id") == rid)
        target = target.lstrip("/")
        path = target if target.startswith("xl/") else f"xl/{target}"
        last = None
        with z.open(path) as xml:
            for row in _rows(xml):
                r = int(row.get("r"))
                cells = [x for x in (_cell(c, shared, dates, epoch) for c in row.findall("m:c", NS)) if x[1] is not None]
                if not cells:
                    continue
                for blank in range(last + 1, r) if last is not None else ():
                    yield blank, 0, None, False
                last = r
                for c, text, is_date in cells:
                    yield r, c, text, is_date


def _rows(xml) -> Iterator[ET.Element]:
    """The rows of a sheet one by one; what has been read is let go, from the elements around it too."""
    around = []
    for event, element in ET.iterparse(xml, ("start", "end")):
        if event == "start":
            around.append(element)
            continue
        around.pop()
        if element.tag == f"{{{NS['m']}}}row":
            yield element
            around[-1].remove(element)


def _cell(c, shared: list[str], dates: set[int], epoch: dt.datetime) -> tuple[int, str | None, bool]:
    kind, v, place = c.get("t", "n"), c.find("m:v", NS), _col_index(c.get("r"))
    if kind == "inlineStr":
        return place, _text(c), False
    if v is None or v.text is None:
        return place, None, False
    if kind == "s":
        return place, shared[int(v.text)], False
    if kind == "b":
        return place, "True" if v.text == "1" else "False", False
    if kind == "d" or kind == "n" and int(c.get("s", 0)) in dates:
        date = v.text if kind == "d" else _as_date(v.text, epoch)
        return place, date if date is not None else v.text, date is not None
    return place, v.text, False


#: Cells that a task holds at once.
CELLS_AT_ONCE = 20_000


def _cells_of(batches: Iterator[pa.RecordBatch], sheet: int) -> Iterator[pa.RecordBatch]:
    kinds = {"r": pa.int32(), "c": pa.int32(), "v": pa.string(), "d": pa.bool_()}
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            cells = workbook_cells(content.as_buffer(), sheet)
            while some := list(islice(cells, CELLS_AT_ONCE)):
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(some), pa.string()),
                                                  **{n: pa.array([x[i] for x in some], t) for i, (n, t) in enumerate(kinds.items())}})


def scan_xlsx(spark: SparkSession, folder: str, sheet: int = 0, na_values: list[str] | None = None,
              infer: bool = True) -> DataFrame:
    """Every ``*.xlsx`` under ``folder`` (or one file), concatenated."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(folder).select("path", "content")
    # each workbook is unzipped once; header, types and rows read the cells
    cells = cut_lineage(files.mapInArrow(lambda it: _cells_of(it, sheet), CELLS_SCHEMA), "xlsx-cells")
    first_row = cells.groupBy("path").agg(F.min("r").alias("hr"))
    tagged = cells.join(first_row, "path")
    header = tagged.where((F.col("r") == F.col("hr")) & F.col("v").isNotNull()).select("path", "c", F.col("v").alias("name"))
    # a name that a workbook has twice keeps its first column; columns stand in the order of their first place
    header = header.groupBy("path", "name").agg(F.min("c").alias("c"))
    body = tagged.where(F.col("r") > F.col("hr")).select("path", "r", "c", "v", "d")
    na = DEFAULT_NA if na_values is None else na_values
    named = body.join(header, ["path", "c"], "left").withColumn("v", F.when(~F.col("v").isin(*na), F.col("v")))
    facts = (header.select("name", "c", F.lit(None).cast("boolean").alias("d"))
             .unionByName(named.where("v IS NOT NULL AND name IS NOT NULL").select("name", F.lit(None).cast("int").alias("c"), "d"))
             .groupBy("name").agg(F.min("c").alias("c"), F.bool_and("d").alias("dates")).orderBy("c", "name").collect())
    if not facts:
        return spark.createDataFrame([], "value string")
    out = named.groupBy("path", "r").pivot("name", [f["name"] for f in facts]).agg(F.first("v"))
    dates = {f["name"] for f in facts if f["dates"]} if infer else set()
    out = out.select(*[column(f["name"]).cast("timestamp_ntz").alias(f["name"]) if f["name"] in dates else column(f["name"]) for f in facts])
    return infer_types(out) if infer else out


# --- writing -------------------------------------------------------------------------

#: Rows of a workbook (a sheet holds 1,048,576 with its header).
WORKBOOK_ROWS = 100_000
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPES = "http://schemas.openxmlformats.org/package/2006"
# The parts of a workbook with one sheet and the styles 0 (general) and 1 (date and time).
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_TYPES}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.'
                           'relationships+xml"/>' + "".join(
                               f'<Override PartName="/xl/{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{t}+xml"/>'
                               for n, t in (("workbook", "sheet.main"), ("worksheets/sheet1", "worksheet"), ("styles", "styles"))) + "</Types>",
    "_rels/.rels": f'<Relationships xmlns="{_TYPES}/relationships"><Relationship Id="rId1" Type="{_RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook {_MAIN} xmlns:r="{_RELS}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_TYPES}/relationships"><Relationship Id="rId1" Type="{_RELS}/worksheet" Target="worksheets/'
                                  f'sheet1.xml"/><Relationship Id="rId2" Type="{_RELS}/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet {_MAIN}><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
                     '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
}


def _column_name(i: int) -> str:
    out, i = "", i + 1
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell_xml(ref: str, v) -> str:
    if v is None or isinstance(v, float) and not math.isfinite(v):
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, dt.date):
        at = v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
        return f'<c r="{ref}" s="1"><v>{(at.replace(tzinfo=None) - EPOCH) / dt.timedelta(days=1)!r}</v></c>'
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f'<c r="{ref}"><v>{v!r}</v></c>' if isinstance(v, (int, float)) else f'<c r="{ref}"><v>{v}</v></c>'
    text = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)|[\x00-\x08\x0b\x0c\r\x0e-\x1f\ufffe\uffff]", lambda m: f"_x{ord(m[0]):04X}_", str(v))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def workbook(header: list[str], rows: Iterable[tuple]) -> bytes:
    """A workbook with one sheet."""
    out = io.BytesIO()
    write_workbook(out, header, rows)
    return out.getvalue()


def write_workbook(out, header: list[str], rows: Iterable[tuple]) -> None:
    """A workbook with one sheet, written into a binary file row by row."""
    names = [_column_name(i) for i in range(len(header))]
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for part, xml in _PARTS.items():
            z.writestr(part, xml)
        with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f"<worksheet {_MAIN}><sheetData>".encode())
            for r, row in enumerate(chain([tuple(header)], rows), 1):
                sheet.write(f'<row r="{r}">{"".join(_cell_xml(f"{n}{r}", v) for n, v in zip(names, row))}</row>'.encode("utf-8", "replace"))
            sheet.write(b"</sheetData></worksheet>")


@dataclass
class _Written(WriterCommitMessage):
    files: list


def _open_folder(path: str):
    """The file system of a path and the path on it."""
    from pyarrow import fs
    if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", path):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace(":", "://", 1))
    return fs.LocalFileSystem(), path


class WorkbookWriter(DataSourceWriter):
    def __init__(self, path: str, header: list[str], rows: int):
        self.path, self.header, self.rows = path, header, rows

    def write(self, iterator):
        fs, folder = _open_folder(self.path)
        fs.create_dir(folder, recursive=True)
        files, rows = [], iter(iterator)
        for first in rows:
            name = f"{folder}/_writing-{uuid.uuid4().hex}"
            # zip goes back to a part's head: a local file first
            with tempfile.TemporaryFile() as made:
                write_workbook(made, self.header, map(tuple, chain([first], islice(rows, self.rows - 1))))
                made.seek(0)
                with fs.open_output_stream(name) as f:
                    shutil.copyfileobj(made, f)
            files.append(name)
        return _Written(files)

    def commit(self, messages):
        fs, folder = _open_folder(self.path)
        for name in (f for m in messages if m is not None for f in m.files):
            fs.move(name, f"{folder}/part-{name.rsplit('-', 1)[1]}.xlsx")

    def abort(self, messages):
        fs, _ = _open_folder(self.path)
        for name in (f for m in messages if m is not None for f in m.files):
            fs.delete_file(name)


class WorkbookSource(DataSource):
    """``df.write.format("prism_xlsx")``: a folder of workbooks."""

    @classmethod
    def name(cls):
        return "prism_xlsx"

    def writer(self, schema, overwrite):
        return WorkbookWriter(self.options["path"], schema.names, int(self.options.get("rows", WORKBOOK_ROWS)))


def write_xlsx(df: DataFrame, path: str, rows: int = WORKBOOK_ROWS) -> None:
    """Write a folder of workbooks of at most ``rows`` rows each, from every task its own. Dates and timestamps become date
    cells (to the millisecond); nulls, NaN and infinities are blank."""
    df.sparkSession.dataSource.register(WorkbookSource)
    df.write.format("prism_xlsx").mode("append").option("rows", rows).save(path)
