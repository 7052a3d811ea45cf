"""Readers, writers and the stream over files made here."""

import zipfile

import pytest

from gridproof.sources import grid, jsonl

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def test_jsonl_modes(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"id": "x", "n": 1}\n\n{"id": "y"}\n[1]\n{bad\n', encoding="utf-8")
    path = str(tmp_path / "a.jsonl")
    rows = jsonl.read_jsonl(spark, path, "skip")
    assert [r[0] for r in rows.select(jsonl.field("id")).collect()] == ["x", "y", None]
    with pytest.raises(Exception, match="bad JSON line"):
        jsonl.read_jsonl(spark, path, "strict").select(jsonl.field("id")).collect()


def test_round_trip_and_inventory(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "é")], "a long, b string")
    jsonl.append_jsonl(df, str(tmp_path / "log"))
    jsonl.append_jsonl(df, str(tmp_path / "log"))
    back = jsonl.read_jsonl(spark, str(tmp_path / "log"))
    assert sorted(r[0] for r in back.select(jsonl.field("a", "long")).collect()) == [1, 1, 2, 2]
    assert jsonl.inventory(spark, str(tmp_path / "log")).filter("size > 0").count() >= 2
    for folder in ("x", "y"):
        (tmp_path / "tree" / folder).mkdir(parents=True)
        (tmp_path / "tree" / folder / "same.csv").write_text(folder)
    for path in (str(tmp_path / "tree"), f"file://{tmp_path}/tree/"):
        assert sorted(r.file for r in jsonl.inventory(spark, path).collect()) == ["x/same.csv", "y/same.csv"]


def test_json_documents(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "o.json").write_text('{"a": 3}')
    rows = jsonl.read_json_documents(spark, str(tmp_path))
    assert sorted(r[0] for r in rows.select(jsonl.field("a", "int")).collect()) == [1, 2, 3]


def test_csv_is_lexical(spark, tmp_path):
    (tmp_path / "t.csv").write_text('﻿id,category\n1,01\n2,"",x\n', encoding="utf-8")
    cells = {(r.row, r.col): r.value for r in grid.read_delimited(spark, str(tmp_path / "t.csv")).collect()}
    assert cells == {(1, 1): "id", (1, 2): "category", (2, 1): "1", (2, 2): "01", (3, 1): "2", (3, 2): "", (3, 3): "x"}


def test_delimiters_are_guessed(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;v\n1;2,5\n2;3,5\n")
    (tmp_path / "b.tsv").write_text("id\tv\n1\tx\n")
    cells = grid.read_delimited(spark, str(tmp_path), None)
    assert {r.file: r.value for r in cells.filter("row = 2 AND col = 2").collect()} == {"a.csv": "2,5", "b.tsv": "x"}


def test_judgment_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    for name in ("a_judgments.jsonl", "m/b_judgments.jsonl", "m/c_tabular_judgments.jsonl", "m/d.jsonl"):
        (tmp_path / name).write_text("{}\n")
    got = jsonl.judgment_files(spark, [str(tmp_path), str(tmp_path / "m")])
    assert sorted(r.file.rpartition("/")[2] for r in got.collect()) == ["a_judgments.jsonl", "b_judgments.jsonl"]
    with pytest.raises(ValueError, match="no x_"):
        jsonl.judgment_files(spark, [str(tmp_path)], "x_*.jsonl")


def test_a_preview_is_bounded(spark, tmp_path):
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "many.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="s{i}" r:id="r{i}"/>' for i in range(25)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(25)) + "</Relationships>")
        for i in range(25):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>' + "".join(f'<row r="{r}"><c r="A{r}"><v>1</v></c><c r="GT{r}"><v>2</v></c></row>' for r in range(1, 40)) + "</sheetData></worksheet>")
    cells = grid.read_workbooks(spark, str(tmp_path), preview=True)
    assert cells.count() == 20 * 13 and cells.selectExpr("max(row)", "max(col)", "count(DISTINCT sheet)").first() == (13, 1, 20)
    assert grid.read_workbooks(spark, str(tmp_path)).count() == 25 * 39 * 2


def test_workbook(spark, tmp_path):
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{rel}"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>id</t></si><si><r><t>01</t></r></si></sst>')
        cells = '<row r="1"><c r="A1" t="s" s="2"><v>0</v></c><c r="AB1" t="inlineStr"><is><t>x</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><f>A2*2</f><v>2</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><cols><col min="2" max="3" hidden="1"/></cols><sheetData>{cells}<row r="5" hidden="1"/></sheetData><autoFilter ref="A1:B2"/><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>')
    (tmp_path / "broken.xlsx").write_bytes(b"no workbook")
    cells = grid.read_workbooks(spark, str(tmp_path))
    assert [(r.file, r.sheet) for r in cells.filter("vtype = 'unreadable'").collect()] == [("broken.xlsx", None)]
    sheets = grid.workbook_structure(spark, str(tmp_path))
    assert sheets.filter("error IS NOT NULL").count() == 1
    r = sheets.filter("error IS NULL").first()
    assert (r.filter_ref, r.tables, r.hidden_rows, r.hidden_cols, r.header_styles[0], r.sheet_state) == ("A1:B2", [], [5], ["B", "C"], "2", "visible")
    from gridproof.operators.structure import sheet_issues

    assert sheet_issues(sheets, sheets.withColumn("filter_ref", sheets.sheet), "unit_scale_conversion").first()["code"] == "filter_changed"
    (tmp_path / "broken.xlsx").unlink()
    from gridproof.operators.profile import workbook_profile

    preview = {(r.row, r.col) for r in grid.read_workbooks(spark, str(tmp_path), preview=True).collect()}
    assert preview == {(1, 1), (1, 28), (2, 1), (2, 2)}
    p = workbook_profile(grid.workbook_structure(spark, str(tmp_path)), grid.read_workbooks(spark, str(tmp_path))).first()
    assert (p.file, p.sheets, p.merges, p.ranges, p.header_merges, p.formulas, p.complex_structure_candidate) == ("b.xlsx", 1, 1, ["A1:B1"], 1, 1, True)
    got = {(r.row, r.col): (r.vtype, r.value, r.formula, r.style) for r in grid.read_workbooks(spark, str(tmp_path)).collect()}
    assert got == {(1, 1): ("string", "id", None, "2"), (1, 28): ("string", "x", None, None), (2, 1): ("string", "01", None, None), (2, 2): ("number", "2", "=A2*2", None)}
    r = grid.workbook_structure(spark, str(tmp_path)).first()
    assert (r.sheet, r.rows, r.cols, r.merges, r.header_merges, r.formulas) == ("Data", 2, 28, ["A1:B1"], 1, 1)


def test_stream_keeps_last_valid(spark, tmp_path):
    from gridproof.streaming.canonical import canonical_stream

    rows = [("a", 1, "success", "x"), ("a", 2, "run_failed", ""), ("b", 3, "run_failed", "")]
    spark.createDataFrame(rows, "id string, line long, status string, answer string").write.parquet(str(tmp_path / "in"))
    log = spark.readStream.schema("id string, line long, status string, answer string").parquet(str(tmp_path / "in"))
    got = {}

    def keep(df, _):
        got.update({r.id: (r.line, r.attempts) for r in df.collect()})

    run = canonical_stream(log).writeStream.outputMode("update").foreachBatch(keep).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    run.awaitTermination(120)
    assert got == {"a": (1, 2), "b": (3, 1)}


def test_manifest(spark, tmp_path):
    from gridproof.sources import reports

    (tmp_path / "m.csv").write_text("dataset,model,clean\na,m,x\na,m,y\n")
    assert reports.read_manifest(spark, str(tmp_path / "m.csv"), ["dataset", "clean"]).count() == 2
    with pytest.raises(ValueError, match="repeats"):
        reports.read_manifest(spark, str(tmp_path / "m.csv"), ["dataset"], ["dataset", "model"])
    with pytest.raises(ValueError, match="no column attacked"):
        reports.read_manifest(spark, str(tmp_path / "m.csv"), ["attacked"])


def test_text_reports(spark):
    from gridproof.sources import reports

    df = spark.createDataFrame([("a_1", "m", "25.00% (n=8)"), ("b", "m", None), ("a_1", "n", "--")], "dataset string, model string, cell string")
    assert reports.markdown(df, "dataset", ["model"]).splitlines()[:5] == ["## a_1", "", "| model | cell |", "| --- | --- |", "| m | 25.00% (n=8) |"]
    body = reports.latex(df, "dataset", ["model"]).splitlines()
    assert body[4] == r"a\_1 & m & 25.00\% (n=8) \\" and body[5] == r" & n & -- \\" and body[6] == r"\midrule"
    assert '"rows":3' in reports.json_report(df, ["dataset", "model"]).first()[0]


def test_required_fields(spark, tmp_path):
    from gridproof.operators.files import require_fields

    (tmp_path / "a.jsonl").write_text('{"id": 1, "question": "x"}\n')
    rows = jsonl.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    assert require_fields(rows, ["id", "question"]).count() == 1
    with pytest.raises(Exception, match="missing fields: answer"):
        require_fields(rows, ["id", "answer"]).select(jsonl.field("id")).collect()


def test_code_imports(spark):
    from gridproof.functions.code import banned_import

    df = spark.createDataFrame([("import urllib.request as u",), ("from httpx import get",), ("x = 'socket'",), ("def",), (None,)], "c string")
    assert [r[0] for r in df.select(banned_import("c")).collect()] == ["urllib.request", "httpx", None, "syntax error", None]


def test_previews(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"a": 1}, {"b": 2, "a": 3}]')
    got = {r.key: (r.first_row, r.rows) for r in jsonl.preview_keys(jsonl.read_json_documents(spark, str(tmp_path))).collect()}
    assert got == {"a": (0, 2), "b": (1, 1)}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.csv").write_text("h\n1\n2\n")
    assert [tuple(r) for r in jsonl.row_counts(spark, str(tmp_path / "t")).collect()] == [("x.csv", 2)]
