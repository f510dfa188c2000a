"""Workbooks and formulas at scale: one pass over files, work done once for equal pieces, the same results by either way."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from quirelake.operators import formulas
from quirelake.plans import catalogue
from quirelake.sources import workbook
from tests.test_office import MOVES
from tests.test_sources import made_workbook


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_workbooks_are_written_and_read_once(spark, small):
    assert _plan(catalogue.QUERIES["workbook_formula_lines"](spark, small)).count("MapInArrow run(") == 2


def test_cells_pass_one_window_down_and_one_along(spark):
    cells = spark.createDataFrame([("s", 1, 1, "=A2")], "sheet string, row int, col int, formula string")
    plan = formulas.compress(cells)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("hashpartitioning") == 2 and "Union" not in plan


def test_forms_are_worked_out_once_for_each_batch():
    import pyarrow as pa

    calls = []
    work = lambda *args: (calls.append(args), formulas.form_of(*args))[1]
    made = formulas._each_once(work, pa.string(), pa.array(["=A1", "=A1", None, "=A1", "=\x01"]), pa.array([2, 2, 2, 3, 1]), pa.array([1, 1, 1, 1, 1]))
    assert made.to_pylist() == ["=\x01c:0,r:-1\x01"] * 2 + [None, "=\x01c:0,r:-2\x01", "=\x01"] and len(calls) == 3


def test_plain_texts_move_as_columns_do(spark):
    texts = [(f, r, c) for f, _ in MOVES if f for r, c in ((4, 4), (1, 1), (1_048_576, 16_384))]
    rows = spark.createDataFrame([(f, r, c, i) for i, (f, r, c) in enumerate(texts)], "f string, r int, c int, i int")
    two = F.lit(2)
    found = rows.select("i", formulas.moved(F.col("f"), two, two, F.col("r"), F.col("c")).alias("m")).orderBy("i").collect()
    assert [x.m for x in found] == [formulas.moved_text(f, 2, 2, r, c) for f, r, c in texts]


def _random_cells(rng):
    out = []
    for r in range(1, 40):
        row = []
        for c in "ABCDEAB":
            name = c if len(row) < 5 else f"A{c}"
            row.append(rng.choice([f'<c r="{name}{r}"><v>{rng.random()}</v></c>', f'<c r="{name}{r}" t="s"><v>{rng.randrange(2)}</v></c>', f'<c r="{name}{r}" t="str"><f>{name}{r + 1}&amp;"&lt;"</f><v>x</v></c>', f'<c r="{name}{r}" s="1"/>', f'<c r="{name}{r}" s="1"><v>{r}</v></c>',
                f'<c r="{name}{r}" t="inlineStr"><is><t xml:space="preserve"> a&#13;\n</t></is></c>', f'<c r="{name}{r}"><f t="shared" si="{rng.randrange(3)}"/></c>', f'<c r="{name}{r}"><f t="shared" si="{rng.randrange(3)}">{name}{r + 1}</f></c>', ""]))
        out.append(f'<row r="{r}">{"".join(row)}</row>')
    rng.shuffle(out)
    return "".join(out)


def test_parts_at_once_and_as_streams_are_equal(monkeypatch):
    rng = random.Random(5)
    for _ in range(20):
        book = made_workbook([("a", "visible", _random_cells(rng)), ("b", "hidden", "<row/>"), ("c", "visible", _random_cells(rng))])
        monkeypatch.setattr(workbook, "WHOLE_PART", 10**6)
        found = list(workbook.cells_of(book))
        monkeypatch.setattr(workbook, "WHOLE_PART", 0)
        assert found == list(workbook.cells_of(book)) and len(found) > 200


def test_the_first_shared_text_by_rows_counts():
    rows = '<row r="3"><c r="A3"><f t="shared" si="0"/></c><c r="B3"><f t="shared" si="0">B9</f></c></row><row r="1"><c r="A1"><f t="shared" si="0">A2*$C$1</f></c></row><row r="4"><c r="A4"><f t="shared" si="7"/></c></row>'
    found = list(workbook.cells_of(made_workbook([("a", "visible", rows)])))
    assert [(*c[2:4], c[6]) for c in found] == [(2, 0, "=A4*$C$1"), (2, 1, "=B9"), (0, 0, "=A2*$C$1"), (3, 0, None)]


def test_broken_parts_give_the_cells_before_and_an_error(spark):
    book = io.BytesIO(made_workbook([("a", "visible", '<row r="1"><c r="A1"><v>1</v></c></row>')]))
    out = io.BytesIO()
    with zipfile.ZipFile(book) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            new.writestr(name, old.read(name).decode().replace("</sheetData>", ""))
    files = spark.createDataFrame([("p", bytearray(out.getvalue())), ("q", None)], "path string, content binary")
    assert sorted((r.path, r.raw or "", (r.error or "")[:11]) for r in workbook.workbook_cells(files).collect()) == [("p", "", "no workbook"), ("p", "1", ""), ("q", "", "no workbook")]


def test_many_workbooks_of_many_batches(spark):
    """More workbooks than a batch holds, and one of more cells than that: no cell goes astray."""
    table = spark.range(2_500).selectExpr("cast(id as string) as path", "cast(id % 2 as int) as sheet_no", "concat('s', id % 3) as sheet", "explode(sequence(0, if(id = 7, 30000, 2))) as row")
    cells = table.selectExpr("path", "sheet_no", "sheet", "row", "row % 3 as col", "'number' as kind", "cast(row as string) as raw", "cast(null as string) as formula").coalesce(1)
    found = workbook.workbook_cells(workbook.workbook_files(cells))
    expected = cells.selectExpr("path", "0 as sheet_no", "sheet", "row", "col", "kind", "raw", "formula")
    assert found.drop("error").exceptAll(expected).count() == 0 and found.count() == 2_499 * 3 + 30_001


def _written(lines):
    import pyarrow as pa

    given = pa.record_batch({"_id": ["s"] * len(lines), "_at": list(range(len(lines))), "line": pa.array(lines, pa.string())})
    made = list(formulas._written_out(iter([given])))
    return made, sorted((at, c["row"], c["col"], c["formula"]) for b in made for at, held in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) for c in held)


def test_lines_are_written_out_some_cells_at_a_time(monkeypatch):
    lines = ["A1:A3 = B1", None, "C1:D70 = $A1+C2", "no line", "A1:A3 = B1", "B2 = 7", "A3:A1 = 2", " a1 = b1 "]
    expected = [(at, r, 1, f"=B{r}") for at in (0, 4) for r in (1, 2, 3)] + [(2, r, c, f"=$A{r}+{'?ABCD'[c]}{r + 1}") for r in range(1, 71) for c in (3, 4)] + [(5, 2, 2, "=7"), (7, 1, 1, "=B1")]
    for most in (1, 2, 3, 7, 50, 10_000):
        monkeypatch.setattr(formulas, "CELLS_AT_ONCE", most)
        made, found = _written(lines)
        assert found == sorted(expected)
        assert max(sum(map(len, b.column(2).to_pylist())) for b in made) <= max(most, 3)


def test_cells_of_small_sheets_need_no_exchange(spark, small):
    """Lines go to sheets dealt like the cells: the tables are dealt once more for rows, once for sheets, and put together where they are."""
    plan = catalogue.QUERIES["workbook_formula_cells"](spark, small)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(dealt) == 4 and "Join" not in plan and sum("REPARTITION_BY_NUM" in line for line in dealt) == 3


def test_together_and_apart_are_equal(spark):
    lines = [("s", 0, "A1:B3 = C1"), ("s", 1, "B2:B5 = 7"), ("t", 0, "A1 = $B$1"), (None, 2, "A1 = 1"), ("s", 2, None), ("t", 3, "x")]
    table = spark.createDataFrame(lines, "sheet string, at int, line string")
    found = [sorted(map(repr, formulas.expand(table, together=n).collect())) for n in (None, 3)]
    assert found[0] == found[1] and len(found[0]) == 10 and "Row(sheet='s', row=2, col=2, formula='=7')" in found[0]
    cells = spark.createDataFrame([("s", 1, 1, "x"), ("s", 9, 9, "y"), (None, 1, 1, "z")], "sheet string, row int, col int, text string")
    met = {(r.sheet, r.row, r.col): (r.text, r.formula) for r in formulas.with_formulas(cells, formulas.expand(table)).collect()}
    assert len(met) == 11 and met["s", 1, 1] == ("x", "=C1") and met["s", 9, 9] == ("y", None) and met[None, 1, 1] == ("z", "=1") and met["s", 3, 2] == ("", "=7")
    for n in (None, 3):
        assert {(r.sheet, r.row, r.col): (r.text, r.formula) for r in formulas.with_lines(cells, table, together=n).collect()} == met


def test_runs_go_on_from_batch_to_batch():
    import pyarrow as pa

    rng = random.Random(3)
    cells, expected = [], []
    for col in range(1, 60):
        row, n = rng.randrange(1, 5), 0
        for _ in range(rng.randrange(1, 9)):
            high, fixed = rng.randrange(1, 6), rng.randrange(3)
            if cells and n and rng.random() < 0.5:
                row += 1 + rng.randrange(3)
            same = n and cells[-1][1] == row - 1 and expected[-1][4] == fixed
            if same:
                expected[-1] = (*expected[-1][:3], row + high - 1, fixed)
            else:
                expected.append((f"=$A${fixed + 1}", row, col, row + high - 1, fixed))
            for r in range(row, row + high):
                n += 1
                cells.append(("s", r, col, f"=$A${fixed + 1}", n))
            row += high
    columns = list(zip(*cells, strict=True))
    table = pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32()), strict=True)], names=["_id", "row", "col", "formula", "_n"])
    for most in (1, 2, 3, 10, 10_000):
        found = [r for b in formulas._runs_of(iter(table.to_batches(most)), "row", "_row1") for r in b.to_pylist()]
        assert [(r["formula"], r["row"], r["col"], r["_row1"]) for r in found] == [e[:4] for e in expected]


def test_most_cells_show_what_they_are_without_the_code_of_dates(spark):
    """Dates stand in a lambda: as plain code they make a stage larger than what the JVM compiles."""
    cells = spark.createDataFrame([("date", "45000.5")], "kind string, raw string").select(workbook.shown().alias("text"))
    assert cells.first().text == "2023-03-15 12:00:00"
    assert _plan(cells).count("date_format") == 3 and "lambda" in _plan(cells)


def _plain_sheet(rows, head='<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<worksheet xmlns="m"><dimension ref="A1"/>', tail="<mergeCells><mergeCell ref='A1:B2'/></mergeCells></worksheet>"):
    return f"{head}<sheetData>{rows}</sheetData>{tail}"


def test_plain_sheets_read_as_by_the_whole_parser(monkeypatch):
    rng = random.Random(11)
    text = lambda least=0: "".join(rng.choice(["a", " ", "\n", "\t", "é", "😀", "&amp;", "&lt;", "&gt;", "&quot;", "&apos;", "&amp;lt;", '"', "'", "]]", ";"]) for _ in range(rng.randrange(least, 6)))
    plain = workbook._plain_cells
    monkeypatch.setattr(workbook, "_date_styles", lambda archive: {3})

    def book(sheet):
        made = made_workbook([("a", "visible", "")])
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(made)) as old, zipfile.ZipFile(out, "w") as new:
            for name in old.namelist():
                new.writestr(name, sheet if name.endswith("s1.xml") else old.read(name))
        return out.getvalue()

    def both(sheet):
        found = []
        for way in (plain, lambda data: None):
            monkeypatch.setattr(workbook, "_plain_cells", way)
            found.append(list(workbook.cells_of(book(sheet))))
        assert found[0] == found[1]
        return found[0]

    for _ in range(60):
        rows = []
        for r in range(rng.randrange(8)):
            cells = []
            for c in range(rng.randrange(6)):
                kind = rng.choice(["", ' t="n"', ' s="3"', ' s="2" t="str"', ' t="b"', ' t="e"', ' t="odd"', ' s="3" t="d"'])
                formula = f"<f>{text()}</f>" if rng.random() < 0.5 else ""
                value = rng.choice(["", "<v></v>", f"<v>{text()}</v>", f"<is><t>{text(1)}</t></is>", f'<is><t xml:space="preserve">{text(1)}</t></is>'])
                cells.append(f'<c r="{"ABCXYZ"[c]}{rng.randrange(1, 99)}"{kind}>{formula}{value}</c>')
            rows.append(f'<row r="{r + 1}">{"".join(cells)}</row>')
        sheet = _plain_sheet("".join(rows))
        assert plain(sheet.encode()) is not None
        both(sheet)
    assert len(both(_plain_sheet('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" s="3"><v>1</v></c></row>'))) == 2
    cell = '<c r="A1"><v>1</v></c>'
    row = f'<row r="1">{cell}</row>'
    others = [
        _plain_sheet(f"<!--{cell}-->{row}"), _plain_sheet(row, tail=f"<x>{cell}</x></worksheet>"), _plain_sheet(row, tail=f"<!-- </sheetData> --></worksheet>"), _plain_sheet('<row r="1"><c r="A1"><v><![CDATA[<v>2</v>]]></v></c></row>'),
        _plain_sheet('<row r="1"><c r="A1"><v>a&#13;b</v></c></row>'), _plain_sheet('<row r="1"><c r="A1"><v>a\r\nb</v></c></row>'), _plain_sheet('<row r="1"><c r="A1" t="inlineStr"><is><t></t></is></c></row>'), _plain_sheet('<row r="1"><c t="b" r="A1"><v>1</v></c></row>'),
        _plain_sheet('<row r="1"><c r="A1"/><c r="B1"><f t="shared" si="0">A1</f></c><c r="B2"><f t="shared" si="0"/></c></row>'), _plain_sheet("<row/>" + row), _plain_sheet(row, head='<worksheet xmlns="m">'), _plain_sheet(row + "</sheetData><sheetData>" + row),
    ]
    for sheet in others:
        assert plain(sheet.encode()) is None
        both(sheet)
    assert plain(_plain_sheet(row, tail="").encode()) is None and plain(b"\xff" + row.encode()) is None and plain(row.encode("utf-16")) is None
    written = workbook._archive([("s", row)])
    assert plain(zipfile.ZipFile(io.BytesIO(written)).read("xl/worksheets/sheet1.xml")) == [("A1", "", "", "", "1", "")]
