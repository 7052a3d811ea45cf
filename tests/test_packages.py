"""Validators of packages: small packages by hand, and intervals against brute force."""

import random

from gridproof.operators import intervals
from gridproof.operators import packages as pk


def grid(package, side, rows, file="t.csv", sheet="", vtype="string", first_style=None):
    return [(package, side, file, sheet, r, c, vtype, v, None, first_style if r == 1 else None) for r, row in enumerate(rows, 1) for c, v in enumerate(row, 1)]


def issues(spark, cells, operators, **contracts):
    tables = {name: spark.createDataFrame(rows, pk.Contracts().schemas[name]) for name, rows in contracts.items()}
    packages = spark.createDataFrame(list(operators.items()), "package string, operator string")
    found = pk.package_issues(spark.createDataFrame(cells, pk.CELLS), packages, pk.Contracts(**tables)).collect()
    return {(r.package, r.file, r.sheet, r.code, r.value) for r in found}


BASE = [["id", "price", "unit"], ["1", "10", "kg"], ["2", "20", "kg"], ["3", "30", "kg"], ["4", "40", "kg"]]


def test_lost_rows_and_damage_beside_the_change_are_found(spark):
    dates = [["id", "day", "name"], *[[str(i), f"2024-01-0{i}", f"n{i}"] for i in range(1, 6)]]
    recoded = [dates[0], *[[a, b.replace("-", "/"), c] for a, b, c in dates[1:]]]
    damaged = [r if i != 2 else [r[0], r[1], "damaged"] for i, r in enumerate(recoded)]
    scaled = [["id", "price (g)", "unit"], *[[a, b + "000", c] for a, b, c in BASE[1:]]]
    cells = []
    for name, before, after in (("ok", dates, recoded), ("lost", dates, recoded[:3]), ("beside", dates, damaged), ("gone", dates, [*recoded[:2], ["2", "", "n2"], *recoded[3:]]), ("unit", BASE, scaled), ("unit lost", BASE, scaled[:2]), ("unit beside", BASE, [scaled[0], *[[a, b, "lb" if a == "4" else c] for a, b, c in scaled[1:]]])):
        cells += grid(name, "before", before) + grid(name, "after", after)
    got = issues(spark, cells, {n: pk.UNIT if n.startswith("unit") else pk.REENCODING for n in ("ok", "lost", "beside", "gone", "unit", "unit lost", "unit beside")})
    place = ("t.csv", "")
    assert got == {
        ("lost", *place, "sheet_shape_changed", 1.0), ("lost", None, None, "attack_not_changed", 0.0), ("beside", *place, "reencoding_not_equivalent", 1.0), ("gone", *place, "missingness_changed", 1.0),
        ("unit lost", *place, "sheet_shape_changed", 1.0), ("unit lost", None, None, "attack_not_changed", 0.0),
    }


def test_a_text_beside_numbers_is_no_distractor(spark):
    text = ["price", "price", "quoted", "why", "how"]
    declared = [(n, "price", "gross", text) for n in ("near", "text", "away", "copy", "moved")]
    add = lambda at, values, rows=BASE: [r[:at] + [v] + r[at:] for r, v in zip(rows, ["gross", *values])]
    good = ["11", "22", "33", "44"]
    cells = []
    turned = [[c, a, b] for a, b, c in BASE]
    for name, after in (("near", add(2, good)), ("text", add(2, ["no number"] * 4)), ("away", add(3, good)), ("copy", add(2, ["10", "20", "30", "41"])), ("moved", add(3, good, turned))):
        cells += grid(name, "before", BASE) + grid(name, "after", after)
    got = {(p, code) for p, _, _, code, _ in issues(spark, cells, {n: pk.DISTRACTOR for n, *_ in declared}, distractors=declared)}
    assert got == {("text", "distractor_type_incompatible"), ("away", "distractor_not_adjacent"), ("copy", "distractor_difference_too_low"), ("moved", "original_columns_reordered")}
    bare = issues(spark, grid("b", "before", BASE) + grid("b", "after", add(2, good)), {"b": pk.DISTRACTOR}, distractors=[("b", "price", "gross", ["price", " "])])
    assert bare == {("b", None, None, "distractor_contract_incomplete", 1.0)}


def test_records_over_sheets_are_one_multiset(spark):
    head, rows = ["id", "kind", "n"], [[str(i), "ab"[i % 2], str(i * i)] for i in range(8)]
    before = grid("", "before", [head, *rows], "w.xlsx", "all")
    turned = lambda rows: [[r[2], r[0], r[1]] for r in rows]
    split = lambda rows: {"A": [["n", "id", "kind"], *turned([r for r in rows if r[1] == "a"])], "B": [head, *[r for r in rows if r[1] == "b"]]}
    cases = {"good": split(rows), "lost": split(rows[:-1]), "twice": split([*rows, rows[0]]), "altered": split([*rows[:-1], ["7", "b", "x"]]), "kept": {"A": [head, *rows]}, "names": {**split(rows), "C": [["n", "n", "id"], ["1", "2", "3"]]}, "empty": {**split(rows), "C": [head]}}
    cells = []
    for name, sheets in cases.items():
        cells += [(name, *c[1:]) for c in before]
        for sheet, table in sheets.items():
            cells += grid(name, "after", table, "w.xlsx", sheet)
    cells += [("formula", *c[1:]) for c in before] + [("formula", "after", f, s, r, c, t, v, "=A1" if r == 2 and c == 1 else None, None) for sheet, table in split(rows).items() for _, _, f, s, r, c, t, v, _, _ in grid("", "after", table, "w.xlsx", sheet)]
    got = issues(spark, cells, {n: pk.CROSS_SHEET for n in [*cases, "formula"]})
    assert {(p, code, n) for p, _, _, code, n in got} == {
        ("lost", "cross_sheet_records_changed", 1), ("twice", "cross_sheet_records_changed", 1), ("altered", "cross_sheet_records_changed", 2), ("kept", "sheet_count_not_changed", 1),
        ("names", "invalid_relayout_sheet", 1), ("empty", "invalid_relayout_sheet", 1), ("formula", "cross_sheet_records_changed", 4), ("formula", "formula_set_changed", 2),
    }


def test_appended_rows_are_declared_once_each(spark):
    after = [[*r, "m" if i else "mark"] for i, r in enumerate(BASE)] + [["9", "90", "kg", "sum"], ["10", "91", "kg", "check"]]
    row = lambda n, a, b, value="sum", kind="summary_row": (n, "t.csv", "", a, b, "mark", value, kind, "no fact", "7")
    rows = [row("good", 6, 6), row("good", 7, 7, "check"), row("gap", 6, 6), row("twice", 6, 7), row("twice", 7, 7, "check"), row("out", 5, 6), row("out", 7, 7, "check"), row("kind", 6, 6, kind="other"), row("kind", 7, 7, "check")]
    names = ("good", "gap", "twice", "out", "kind", "none", "head")
    cells = [c for n in names for c in grid(n, "before", BASE) + grid(n, "after", after)]
    rows += [row("head", 6, 6), row("head", 7, 7, "check")]
    got = issues(spark, cells, {n: pk.NON_OBSERVATION for n in names}, rows=rows, markers=[(n, "label" if n == "head" else "mark", "m") for n in names])
    assert {(p, code, n) for p, _, _, code, n in got} == {
        ("gap", "non_observation_row_declaration_mismatch", 1), ("twice", "non_observation_row_declaration_mismatch", 1), ("out", "non_observation_row_declaration_mismatch", 1), ("kind", "non_observation_declaration_incomplete", 1),
        ("none", "non_observation_rows_missing", 1), ("none", "undeclared_sheet_changed", 13), ("none", "attack_not_changed", 0), ("head", "marker_column_header_invalid", 1),
    }


def test_files_and_sheets_that_one_side_lacks(spark):
    cells = grid("file", "before", BASE) + grid("file", "after", BASE, "u.csv") + grid("sheet", "before", BASE, "w.xlsx", "a") + grid("sheet", "after", BASE[::-1], "w.xlsx", "a") + grid("sheet", "after", BASE, "w.xlsx", "b") + grid("same", "before", BASE) + grid("same", "after", BASE)
    got = issues(spark, cells, {"file": pk.ROW_SHUFFLE, "sheet": "another", "same": "another"})
    assert got == {("file", None, None, "file_package_changed", 2.0), ("sheet", "w.xlsx", None, "sheet_names_changed", 1.0), ("same", None, None, "attack_not_changed", 0.0)}


def test_cover_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    for block in (1 << 20, 7):
        monkeypatch.setattr(intervals, "BLOCK", block)
        declared = [(k, a, a + rng.randrange(-2, 12)) for k in range(5) for a in (rng.randrange(-5, 60) for _ in range(rng.randrange(12)))]
        wanted = [(k, 1, rng.randrange(1, 60)) for k in range(7)]
        got = intervals.cover(spark.createDataFrame(declared or [(0, 1, 0)], "k long, start long, end long"), spark.createDataFrame(wanted, "k long, start long, end long"), ["k"]).collect()
        for k, lo, hi in wanted:
            n = {}
            for key, a, b in declared:
                for x in range(a, b + 1) if key == k else ():
                    n[x] = n.get(x, 0) + 1
            want = (sum(x not in n for x in range(lo, hi + 1)), sum(v - 1 for x, v in n.items() if lo <= x <= hi), sum(v for x, v in n.items() if not lo <= x <= hi))
            assert [(r.never, r.again, r.outside) for r in got if r.k == k] == [want]
