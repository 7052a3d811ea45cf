"""Readers over several splits of one file: line numbers, quoted line ends, key order."""

import csv
import io
import json
import random
import tracemalloc
import zipfile

import pytest

from gridproof.sources import grid, jsonl, splits


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cell(rng):
    kind = rng.randrange(9)
    return ["plain", "", "a,b", 'say "x"', "line\nbreak", "é ü", 'in"side', "\n\n", " spaced "][kind] + str(rng.randrange(99)) * (kind not in (1, 7))


def written_rows(seed, n=400):
    rng, out = random.Random(seed), io.StringIO(newline="")
    for i in range(n):
        row = [cell(rng) for _ in range(rng.randrange(1, 6))]
        if i % 50 == 7:
            row.append("long, \"quoted\"\n" * 150)  # over several splits
        csv.writer(out, lineterminator="\r\n" if seed % 2 else "\n").writerow(row)
        if i % 40 == 3:
            out.write('x,in"side,"closed"after,\n\n')
    return out.getvalue()


def test_quoted_line_ends_over_splits(spark, tmp_path, small_splits):
    texts = {f"t{seed}.csv": written_rows(seed) for seed in range(4)} | {"bom.csv": "﻿a,b\n1,\"x\ny\"", "open.csv": 'a,b\n1,"never closed\nto the end', "one.csv": "a", "empty.csv": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    lines = splits.split_lines(spark, str(tmp_path), line_end="\n")
    assert lines.select("file", "block").distinct().count() > 40
    got = {}
    for r in splits.read_delimited_splits(spark, str(tmp_path)).collect():
        got.setdefault(r.file.rpartition("/")[2], {})[r.row, r.col] = r.value
    for name, text in texts.items():
        want = {(r, c): v for r, record in enumerate(csv.reader(io.StringIO(text.lstrip("﻿"), newline="\n")), 1) for c, v in enumerate(record, 1)}
        assert got.get(name, {}) == want, name


@pytest.mark.parametrize("line", ['a,b', '"a,b', '"a"', '"a""b",c', '"a"b"c', 'x"y,"z', '""', '"""', '""""', 'a,""', 'a,"', '"x"y,"z', "", ',,"'])
@pytest.mark.parametrize("inside", [False, True])
def test_ends_of_records_are_those_of_the_csv_module(line, inside):
    marked = csv.reader(io.StringIO(('"' if inside else "") + line + "\nMARK\n", newline="\n"))
    assert splits._Ends(",")(line, inside) == (["MARK"] not in list(marked))


def test_line_numbers_over_splits(spark, tmp_path, small_splits):
    for name, bad in (("a.jsonl", 173), ("b.jsonl", None)):
        out = [json.dumps({"id": i, "x": "y" * (i % 60)}) for i in range(1, 301)]
        for i in (5, 60, 61, 200):
            out[i] = ""
        if bad:
            out[bad - 1] = "{bad"
        (tmp_path / name).write_text("\n".join(out) + "\n")
    lines = jsonl.read_lines(spark, str(tmp_path), numbered=True).collect()
    want = [(n, i, x) for n in ("a.jsonl", "b.jsonl") for i, x in enumerate((tmp_path / n).read_text().split("\n"), 1) if x.strip()]
    assert sorted((r.file.rpartition("/")[2], r.line, r.value) for r in lines) == want and len({(r.file, r.block) for r in lines}) > 10
    with pytest.raises(Exception, match=r"a\.jsonl:173: \{bad"):
        jsonl.read_jsonl(spark, str(tmp_path)).select(jsonl.field("id")).collect()


def test_key_order_of_previews(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"z": 1, "a": {"k": 2, "b": 3}, "m": "\\"x\\": 1"}\n\n\n{"a": 1, "b\\"q": 2, "z": 3, "z": 4}\n[1]\n' + '{"later": 1}\n' * 9, encoding="utf-8")
    (tmp_path / "b.jsonl").write_text('"text"\n')
    got = {r.file.rpartition("/")[2]: (r.rows, r.columns, len(r.sample)) for r in jsonl.preview_jsonl(spark, str(tmp_path), 4).collect()}
    assert got == {"a.jsonl": (12, ["z", "a", "m", 'b"q', "later"], 4), "b.jsonl": (1, [], 1)}


def workbook(path, sheets, styles="", strings=(), old=False):
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><workbookPr date1904="{int(old)}"/><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/s{i}.xml"/>' for i, _ in enumerate(sheets, 1)) + "</Relationships>")
        book.writestr("xl/styles.xml", f"<styleSheet {main}>{styles}</styleSheet>")
        book.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{x}</t></si>" for x in strings) + "</sst>")
        for i, body in enumerate(sheets.values(), 1):
            book.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}>{body}</worksheet>")


STYLES = '<numFmts count="2"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd;@"/><numFmt numFmtId="165" formatCode="&quot;days&quot; 0.0_);[Red]\\d0"/></numFmts><cellXfs count="6">' + "".join(f'<xf numFmtId="{n}"/>' for n in (0, 14, 164, 22, 165, 20)) + "</cellXfs>"


def test_number_formats_and_dates(spark, tmp_path):
    cells = [("A", 1, 45292), ("B", 2, 45292.5), ("C", 3, 45292.75), ("D", 4, 45292), ("E", 0, 45292), ("F", 5, 0.25), ("G", 1, 59), ("H", 1, 61), ("I", 10**6, 3)]
    row = '<row r="1">' + "".join(f'<c r="{c}1" s="{s}"><v>{v}</v></c>' for c, s, v in cells if s < 9) + '<c r="I1" t="s" s="1"><v>0</v></c><c r="J1" s="1"><f>NOW()</f></c></row>'
    for name, old in (("new.xlsx", False), ("old.xlsx", True)):
        workbook(tmp_path / name, {"s": f"<sheetData>{row}</sheetData>"}, STYLES, ["text"], old)
    got = {(r.file, r.col): (r.vtype, r.value, r.format) for r in grid.read_workbooks(spark, str(tmp_path)).collect()}
    assert [got["new.xlsx", i] for i in range(1, 11)] == [
        ("date", "2024-01-01", "mm-dd-yy"), ("date", "2024-01-01 12:00:00", "yyyy\\-mm\\-dd;@"), ("date", "2024-01-01 18:00:00", "m/d/yy h:mm"), ("number", "45292", '"days" 0.0_);[Red]\\d0'), ("number", "45292", "General"),
        ("date", "06:00:00", "h:mm"), ("date", "1900-02-28", "mm-dd-yy"), ("date", "1900-03-01", "mm-dd-yy"), ("string", "text", "mm-dd-yy"), ("number", None, "mm-dd-yy"),
    ]
    assert got["old.xlsx", 1][1] == "2028-01-02"


def test_structure_in_one_pass_with_a_limit(spark, tmp_path):
    body = '<dimension ref="A1:C900"/><cols><col min="2" max="3" hidden="1"/></cols><sheetData>' + "".join(f'<row r="{i}"{" hidden=%s1%s" % (chr(34), chr(34)) if i == 5 else ""}><c r="A{i}" s="1"><v>{i}</v></c><c r="C{i}"><f>A{i}</f><v>1</v></c></row>' for i in range(1, 901)) + '</sheetData><autoFilter ref="A1:C9"/><mergeCells><mergeCell ref="A1:B2"/><mergeCell ref="A9:B9"/></mergeCells>'
    workbook(tmp_path / "w.xlsx", {"first": body, "second": "<sheetData/>"}, STYLES)
    a, b = sorted(grid.workbook_structure(spark, str(tmp_path)).collect(), key=lambda r: r.position)
    assert (a.rows, a.cols, a.merges, a.header_merges, a.formulas, a.filter_ref, a.hidden_rows, a.hidden_cols, a.header_styles, a.position, a.scanned) == (900, 3, ["A1:B2", "A9:B9"], 1, 900, "A1:C9", [5], ["B", "C"], ["1", "", ""], 1, True)
    assert (b.sheet, b.rows, b.cols, b.position) == ("second", 0, 0, 2)
    c, d = sorted(grid.workbook_structure(spark, str(tmp_path), 10_000).collect(), key=lambda r: r.position)
    assert (c.rows, c.cols, c.merges, c.scanned) == (900, 3, [], False) and d.scanned


def test_a_long_sheet_takes_little_memory(tmp_path):
    def body(n):
        return "<sheetData>" + "".join(f'<row r="{i}">' + "".join(f'<c r="{c}{i}" t="s"><v>{i % 3}</v></c>' for c in "ABCDEFGH") + "</row>" for i in range(1, n + 1)) + "</sheetData>"

    peaks = []
    for n in (2_000, 40_000):
        workbook(tmp_path / f"{n}.xlsx", {"s": body(n)}, STYLES, "abc")
        with zipfile.ZipFile(tmp_path / f"{n}.xlsx") as book:
            styles = grid._Styles.of(book)
            tracemalloc.start()
            assert sum(1 for _ in grid._cells(book, "xl/worksheets/s1.xml", ["a", "b", "c"], styles)) == 8 * n
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
    assert peaks[1] < 4e6 and peaks[1] < 2 * peaks[0]
