"""Tables as grids of cells: file, sheet, row, col (from 1), vtype, value."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

GRID = "file string, sheet string, row int, col int, vtype string, value string, formula string, style string, format string"
STRUCTURE = (
    "file string, sheet string, rows int, cols int, merges array<string>, header_merges int, formulas int, filter_ref string, tables array<string>, hidden_rows array<int>, hidden_cols array<string>, "
    "header_styles array<string>, sheet_state string, error string, position int, scanned boolean"
)
BROKEN = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, NotImplementedError)
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def from_table(df: DataFrame, name: str, keys: list[str], sheet: str = "") -> DataFrame:
    """A grid with the column names in row 1 and the rows, in the order of their keys, from row 2 on.

    Rows are numbered by range partitions and counts of the earlier ones, never in a single task.
    """
    numbered = number_rows(df, keys)
    cells = F.posexplode(F.array(*[F.struct(F.lit(t).alias("vtype"), F.col(c).cast("string").alias("value")) for c, t in df.dtypes]))
    body = numbered.select((F.col("row_no") + 1).cast("int").alias("row"), cells.alias("col", "cell")).select("row", (F.col("col") + 1).alias("col"), "cell.vtype", "cell.value")
    head = df.sparkSession.createDataFrame([(1, i + 1, "string", c) for i, c in enumerate(df.columns)], "row int, col int, vtype string, value string")
    return head.unionByName(body).select(F.lit(name).alias("file"), F.lit(sheet).alias("sheet"), "row", "col", "vtype", "value")


def number_rows(df: DataFrame, keys: list[str], name: str = "row_no") -> DataFrame:
    """df with a row number from 1 in the order of keys: range partitions, counts of the partitions before, place inside.

    The partitioned rows are written to the shared folder, as ranges come from a sample and have to be the same for counts and places.
    """
    parts = written(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return parts.withColumn("_place", inside).join(F.broadcast(bases), "_part").withColumn(name, (F.col("_base") + F.col("_place")).cast("long")).drop("_part", "_base", "_place")


def to_table(grid: DataFrame, columns: list[str]) -> DataFrame:
    """Rows below the header as columns of text, with their row number."""
    cells = grid.filter("row > 1").groupBy("row")
    return cells.agg(*[F.max(F.when(F.col("col") == i + 1, F.col("value"))).alias(c) for i, c in enumerate(columns)])


#: Rows, columns and sheets that a preview shows, and characters from which a delimiter is guessed.
PREVIEW_ROWS, PREVIEW_COLS, PREVIEW_SHEETS = 13, 200, 20
#: Fixed value: bytes of a sheet's XML up to which a profile scans its structure.
SCANNED_BYTES = 4 << 20
SNIFFED, DELIMITERS = 8192, ",;\t|"


def _sniffed(text: str) -> str:
    """The delimiter that the first characters suggest, else a comma."""
    import csv

    try:
        return csv.Sniffer().sniff(text[:SNIFFED], DELIMITERS).delimiter
    except csv.Error:
        return ","


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = ",") -> DataFrame:
    """A grid of texts: ragged rows and empty cells kept, no types guessed, a byte-order mark left out. Without a delimiter each file's own is guessed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        for f in frames:
            for name, content in zip(f["file"], f["content"]):
                text = _decoded(content)
                rows = csv.reader(io.StringIO(text), delimiter=delimiter or _sniffed(text))
                out = [(name, "", r, c, "string", v, None, None, None) for r, cells in enumerate(rows, 1) for c, v in enumerate(cells, 1)]
                yield pd.DataFrame(out, columns=[x.split()[0] for x in GRID.split(", ")])

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")
    return files.mapInPandas(run, GRID)


def _decoded(content: bytes) -> str:
    for name in ("utf-8-sig", "gb18030", "big5"):
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


def _column(ref: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(letter) - 64
    return n


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    return [(s.get("name"), "xl/" + rels[s.get(rel)].lstrip("/").removeprefix("xl/")) for s in found]


#: Number formats that a workbook need not write down, by their number.
FORMATS = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0_);(#,##0)", 38: "#,##0_);[Red](#,##0)", 39: "#,##0.00_);(#,##0.00)", 40: "#,##0.00_);[Red](#,##0.00)",
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
_NO_FIELD = re.compile(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]|General|E[+-]', re.IGNORECASE)
CHUNK = 10_000  # cells that are held at once


@dataclass
class _Styles:
    """Number formats by cell style, and the day that serial number 0 is."""

    formats: list[str]
    first_day: datetime

    @classmethod
    def of(cls, book: zipfile.ZipFile) -> _Styles:
        formats: list[str] = []
        if "xl/styles.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iter(f"{_MAIN}numFmt")}
            styles = root.find(f"{_MAIN}cellXfs")
            formats = [own.get(n, FORMATS.get(n, "General")) for n in (int(x.get("numFmtId") or 0) for x in (styles if styles is not None else ()))]
        old = any(x.get("date1904") in ("1", "true") for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}workbookPr"))
        return cls(formats, datetime(1904, 1, 1) if old else datetime(1899, 12, 30))

    def format(self, style: str | None) -> str | None:
        return self.formats[int(style or 0)] if self.formats and int(style or 0) < len(self.formats) else None

    def date(self, text: str | None, code: str | None) -> str | None:
        """A serial number in a format of dates or times as text: a date, a date with its time, or a time alone."""
        if text is None or not code or not re.search("[dmyhs]", _NO_FIELD.sub("", code.split(";")[0]), re.IGNORECASE):
            return None
        try:
            n = float(text)
            days = n + 1 if self.first_day.year == 1899 and 1 <= n < 60 else n  # day 60 of 1900 is none
            at = self.first_day + timedelta(milliseconds=round(days * 86_400_000))
        except (ValueError, OverflowError):
            return None
        at = at.replace(microsecond=0) if at.microsecond < 500_000 else at.replace(microsecond=0) + timedelta(seconds=1)
        return at.strftime("%H:%M:%S") if 0 <= n < 1 else at.strftime("%Y-%m-%d" if at.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")


def _events(book: zipfile.ZipFile, member: str, shared: list[str], styles: _Styles, rows: int | None = None) -> Iterator[tuple]:
    """One pass over a sheet: ("cell", row, col, vtype, value, formula, style, format), ("merge", ref), ("filter", ref), ("hidden_row", number), ("hidden_col", letters).

    What was read is let go after each row, so a sheet of any length needs little memory. With `rows` it ends after so many rows.
    """
    kinds = {"s": "string", "str": "string", "inlineStr": "string", "b": "boolean", "e": "error", "d": "date"}
    path: list[ElementTree.Element] = []
    for event, x in ElementTree.iterparse(book.open(member), ("start", "end")):
        if event == "start":
            path.append(x)
            if x.tag == f"{_MAIN}row":
                if rows is not None and int(x.get("r") or 0) > rows:
                    return
                if x.get("hidden") in ("1", "true"):
                    yield "hidden_row", int(x.get("r"))
            continue
        path.pop()
        name = x.tag.removeprefix(_MAIN)
        if name == "c":
            ref, kind = x.get("r", "A1"), x.get("t", "n")
            value, formula = x.find(f"{_MAIN}v"), x.find(f"{_MAIN}f")
            text = value.text if value is not None else "".join(t.text or "" for t in x.iter(f"{_MAIN}t")) if kind == "inlineStr" else None
            vtype, code = kinds.get(kind, "number"), styles.format(x.get("s"))
            if kind == "s" and text is not None:
                text = shared[int(text)]
            elif vtype == "number" and (day := styles.date(text, code)) is not None:
                vtype, text = "date", day
            yield "cell", int(re.search(r"\d+", ref)[0]), _column(ref), vtype, text, None if formula is None else "=" + (formula.text or ""), x.get("s"), code
        elif name == "mergeCell":
            yield "merge", x.get("ref")
        elif name == "autoFilter" and path[-1].tag == f"{_MAIN}worksheet":
            yield "filter", x.get("ref")
        elif name == "col" and x.get("hidden") in ("1", "true"):
            for i in range(int(x.get("min")), int(x.get("max")) + 1):
                yield "hidden_col", _letters(i)
        if name in ("row", "mergeCell", "col"):
            path[-1].remove(x)


def _cells(book: zipfile.ZipFile, member: str, shared: list[str], styles: _Styles, rows: int | None = None) -> Iterator[tuple]:
    return (e[1:] for e in _events(book, member, shared, styles, rows) if e[0] == "cell")


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]


def _tables(book: zipfile.ZipFile, member: str) -> list[str]:
    """name=range of the tables of a sheet, in the order of their names."""
    folder, _, name = member.rpartition("/")
    if f"{folder}/_rels/{name}.rels" not in book.namelist():
        return []
    out = []
    for r in ElementTree.fromstring(book.read(f"{folder}/_rels/{name}.rels")):
        if (r.get("Type") or "").endswith("/table"):
            table = ElementTree.fromstring(book.read("xl/" + r.get("Target").replace("../", "").lstrip("/").removeprefix("xl/")))
            out.append(f"{table.get('displayName') or table.get('name')}={table.get('ref')}")
    return sorted(out)


def _declared_size(book: zipfile.ZipFile, member: str) -> list[int]:
    """Rows and columns that a sheet's head declares, without reading its cells."""
    with book.open(member) as f:
        last = re.search(rb'<dimension[^>]*ref="(?:[A-Z]+\d+:)?([A-Z]+)(\d+)"', f.read(4096))
    return [int(last[2]), _column(last[1].decode())] if last else [0, 0]


def _letters(n: int) -> str:
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def read_workbooks(spark: SparkSession, path: str, preview: bool = False) -> DataFrame:
    """Cells of all sheets of .xlsx files, one task a file: value, formula, style and number format of each; numbers in a format of dates come as dates. Cells are passed on as they are read. A preview reads the first PREVIEW_ROWS rows, PREVIEW_COLS columns and PREVIEW_SHEETS sheets only.

    A file that can't be read gives one row of type unreadable, with the reason as its value, after the sheets that could.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["file"], f["content"]):
                columns = [x.split()[0] for x in GRID.split(", ")]
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as book:
                        shared, styles = _shared(book), _Styles.of(book)
                        for sheet, member in _sheets(book)[: PREVIEW_SHEETS if preview else None]:
                            found = _cells(book, member, shared, styles, PREVIEW_ROWS if preview else None)
                            cells = ((name, sheet, *c) for c in found if not preview or c[1] <= PREVIEW_COLS)
                            while part := list(islice(cells, CHUNK)):
                                yield pd.DataFrame(part, columns=columns)
                except BROKEN as e:
                    yield pd.DataFrame([(name, None, 0, 0, "unreadable", f"{type(e).__name__}: {e}", None, None, None)], columns=columns)

    return _workbooks(spark, path).mapInPandas(run, GRID)


def workbook_structure(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """Size, merged ranges (those of the first five rows counted as header merges), formulas, filter range, tables, hidden rows and columns, styles of the first row, state and position of each sheet, in one pass.

    Sheets whose XML is over most_bytes (profiles take SCANNED_BYTES) are not scanned: they have their declared size and tables only. A file that can't be read gives one row with the reason in error.
    """
    columns = [x.split()[0] for x in STRUCTURE.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["file"], f["content"]):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as book:
                        states = {s.get("name"): s.get("state") or "visible" for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")}
                        shared, formats = _shared(book), _Styles.of(book)
                        for position, (sheet, member) in enumerate(_sheets(book), 1):
                            found: dict[str, list] = {k: [] for k in ("merge", "filter", "hidden_row", "hidden_col")}
                            size, top, formulas = [0, 0], {}, 0
                            scanned = most_bytes is None or book.getinfo(member).file_size <= most_bytes
                            for kind, *e in _events(book, member, shared, formats) if scanned else ():
                                if kind != "cell":
                                    found[kind].append(e[0])
                                    continue
                                size = [max(size[0], e[0]), max(size[1], e[1])]
                                formulas += e[4] is not None
                                if e[0] == 1:
                                    top[e[1]] = e[5] or ""
                            if not scanned:
                                size = _declared_size(book, member)
                            heads = sum(int(re.search(r"\d+", m)[0]) <= 5 for m in found["merge"])
                            styles = [top.get(i, "") for i in range(1, size[1] + 1)] if scanned else []
                            filters = found["filter"][0] if found["filter"] else None
                            rows.append((name, sheet, *size, found["merge"], heads, formulas, filters, _tables(book, member), found["hidden_row"], found["hidden_col"], styles, states[sheet], None, position, scanned))
                except BROKEN as e:
                    rows.append((name, *[None] * (len(columns) - 4), f"{type(e).__name__}: {e}", None, None))
                frame = pd.DataFrame(rows, columns=columns)
                yield frame.astype({c: "Int64" for c in ("rows", "cols", "header_merges", "formulas", "position")} | {"scanned": "boolean"})

    return _workbooks(spark, path).mapInPandas(run, STRUCTURE)


def _workbooks(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").option("recursiveFileLookup", "true").load(path)
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")
