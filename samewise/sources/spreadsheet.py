"""Workbooks without a library: a Spark data source that reads .xlsx, and a writer.

A workbook is one zip of XML and can't be split, so a sheet is one task that
streams its rows; only the table of shared strings is held, which the format
bounds to one sheet file's size.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheets(path: str) -> dict[str, str]:
    """Sheet name to its file inside the workbook, in order."""
    with zipfile.ZipFile(path) as z:
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        found = {s.get("name"): rels[s.get(REL)] for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")}
    return {n: t.lstrip("/") if t.startswith("/") else f"xl/{t}" for n, t in found.items()}


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def rows(path: str, sheet: str) -> Iterator[list[str | None]]:
    """The rows of a sheet as text, one at a time; empty cells are null."""
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for _, e in ET.iterparse(f):
                    if e.tag == f"{MAIN}si":
                        shared.append("".join(t.text or "" for t in e.iter(f"{MAIN}t")))
                        e.clear()
        with z.open(sheets(path)[sheet]) as f:
            for _, e in ET.iterparse(f):
                if e.tag != f"{MAIN}row":
                    continue
                out: list[str | None] = []
                for i, c in enumerate(e.iter(f"{MAIN}c")):
                    at = _column(c.get("r")) if c.get("r") else i
                    v, kind = c.find(f"{MAIN}v"), c.get("t")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                    elif v is None or v.text is None:
                        text = None
                    elif kind == "s":
                        text = shared[int(v.text)]
                    elif kind == "b":
                        text = "TRUE" if v.text == "1" else "FALSE"
                    else:
                        text = v.text
                    out += [None] * (at + 1 - len(out))
                    out[at] = text
                yield out
                e.clear()


def pick_sheet(path: str, preferred: str, required: Sequence[str]) -> str:
    """The preferred sheet, else the first whose header has all required columns; else an error that names the sheets."""
    names = sheets(path)
    if preferred in names:
        return preferred
    for name in names:
        header = next(rows(path, name), [])
        if all(c in header for c in required):
            return name
    raise ValueError(f"no sheet with {', '.join(required)} among: {', '.join(names)}")


class WorkbookSource(DataSource):
    """format("workbook"): options path, sheet; all columns text."""

    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        header = next(rows(self.options["path"], self.options["sheet"]), [])
        return ", ".join(f"`{h}` string" for h in header if h)

    def reader(self, schema):
        return WorkbookReader(self.options["path"], self.options["sheet"])


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, sheet: str):
        self.path, self.sheet = path, sheet

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        every = rows(self.path, self.sheet)
        kept = [i for i, h in enumerate(next(every, [])) if h]
        for r in every:
            values = tuple(r[i] if i < len(r) else None for i in kept)
            if any(v is not None for v in values):
                yield values


def read_workbook(spark: SparkSession, path: str, preferred: str = "", required: Sequence[str] = ()) -> DataFrame:
    """A sheet of an .xlsx or .xlsm file in a mounted folder, all columns text."""
    if not path.lower().endswith((".xlsx", ".xlsm")):
        raise ValueError(f"not a workbook: {path}")
    sheet = pick_sheet(path, preferred, required)
    spark.dataSource.register(WorkbookSource)
    df = spark.read.format("workbook").option("sheet", sheet).load(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def _name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def write_workbook(path: str, content: dict[str, tuple[Sequence[str], Iterable[Sequence]]]) -> None:
    """{sheet: (columns, rows)} as .xlsx; rows are streamed, so DataFrame.toLocalIterator() may feed them."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, office = MAIN.strip("{}"), REL[1:].split("}")[0]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(content) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(content, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(content) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, (columns, body) in enumerate(content.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
                f.write(_row(1, columns))
                for n, r in enumerate(body, 2):
                    f.write(_row(n, r))
                f.write(b"</sheetData></worksheet>")


def _row(n: int, values: Sequence) -> bytes:
    cells = []
    for i, v in enumerate(values):
        if v is None:
            continue
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            cells.append(f'<c r="{_name(i)}{n}"><v>{v}</v></c>')
        else:
            cells.append(f'<c r="{_name(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
    return f'<row r="{n}">{"".join(cells)}</row>'.encode()
