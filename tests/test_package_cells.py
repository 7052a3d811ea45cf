"""Cells are matched by place only where a check reads them so, and no two cells have one token."""

from gridproof.operators import packages as pk


def test_places_that_no_check_reads_are_not_matched(spark):
    cells = [(p, side, "t.csv", "", row, 1, "string", f"{row}", None, None) for p in ("rows", "columns", "sheets", "recoded", "own") for side in ("before", "after") for row in (1, 2)]
    packages = spark.createDataFrame([("rows", pk.ROW_SHUFFLE), ("columns", pk.COLUMN_SHUFFLE), ("sheets", pk.CROSS_SHEET), ("recoded", pk.REENCODING), ("own", "another")], "package string, operator string")
    placed = pk._Grids(spark.createDataFrame(cells, pk.CELLS), packages).placed
    assert {(r["package"], r["row"]) for r in placed.collect()} == {("rows", 1), ("recoded", 1), ("recoded", 2), ("own", 1), ("own", 2)}


def test_cells_with_other_fields_have_other_tokens(spark):
    fields = [(None, "a", None, None), (None, None, "a", None), ("1:a", "b", None, None), ("1", "a1:b", None, None), ("", "a", None, None), ("-", None, None, None), (None, "-", None, None)]
    assert spark.createDataFrame(fields, "vtype string, value string, formula string, style string").select(pk._token().alias("t")).distinct().count() == len(fields)
