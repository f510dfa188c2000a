"""What keeps queries in proportion to their tables: work dealt over all cores, tables as folders, references as HTML has them."""

import pytest

from quirelake.plans import catalogue, templates

ONE_FILE = [c[0] for c in templates.CONVERSIONS] + ["heading_summaries", "code_fenced", "emphasis_of_parts"]


@pytest.mark.parametrize("name", ONE_FILE)
def test_documents_of_one_file_are_dealt_over_all_cores(spark, small, name):
    plan = catalogue.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_conversion_has_tasks_for_all_cores(spark, small):
    assert catalogue.QUERIES["csv_parts_as_csv"](spark, small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_stream_of_a_table_that_is_a_folder(spark, small, tmp_path):
    spark.read.parquet(f"{small}/pages.parquet").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    found = catalogue.QUERIES["stream_equals_batch"](spark, str(tmp_path))
    assert found.where("same").count() == spark.read.parquet(f"{small}/pages.parquet").count()


@pytest.mark.parametrize("name", ["page_titles", "page_article_stats"])
def test_references_without_a_semicolon(spark, tmp_path, same_as_duckdb, name):
    title = "a&quot;b&amp;&amp &copy c&middot;d &amp;lt; &gt;&lt e&amp"
    html = f"<html><head><title>{title}</title></head><body><article><h1>{title}</h1><p>Some words of a text that is long enough.</p></article></body></html>"
    rows = spark.createDataFrame([(1, "http://a.org/x", html)], "page_id long, url string, html string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/all")
    next((tmp_path / "all").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    same_as_duckdb(catalogue.QUERIES[name](spark, str(tmp_path)), catalogue.ORACLES[name], str(tmp_path))


def test_components_of_runs_by_brute_force():
    import random

    from quirelake.operators.pictures import components

    pick = random.Random(7)
    for dilation in (1, 3, 5):
        for _ in range(40):
            runs = []
            for y in range(pick.randrange(1, 14)):
                at = pick.randrange(6)
                while pick.random() < 0.7:
                    end = at + pick.randrange(1, 9)
                    runs.append((y, at, end))
                    at = end + dilation + pick.randrange(0, 8)
            label = list(range(len(runs)))
            for _ in runs:
                for i, (y, a, b) in enumerate(runs):
                    for j, (z, c, d) in enumerate(runs):
                        apart = max(c - b + 1, a - d + 1, 0)
                        if 1 <= z - y <= dilation and apart <= (dilation - 1 if z - y == dilation else dilation):
                            label[i] = label[j] = min(label[i], label[j])
            boxes = [(min(runs[i][1] for i in k), min(runs[i][0] for i in k), max(runs[i][2] for i in k), max(runs[i][0] for i in k) + 1) for k in ([i for i, x in enumerate(label) if x == w] for w in set(label))]
            assert sorted(components(runs, dilation)) == sorted(boxes)


def test_formulas_are_worked_out_once_for_each_cell(spark):
    from pyspark.sql import functions as F

    from quirelake.operators import formulas

    cells = spark.createDataFrame([("=A1+$B$2&SUM(A:C)&AB3", 5, 3)], "formula string, row int, col int")
    form = formulas.relative(F.col("formula"), F.col("row"), F.col("col"))
    placed = formulas.absolute(F.col("form"), F.col("row") + 1, F.col("col") + 1).alias("next")
    made = cells.select(form.alias("form"), "row", "col").select("form", placed)
    assert [tuple(r) for r in made.collect()] == [("=\x01c:-2,r:-4\x01+\x01C:2,R:2\x01&SUM(\x01c:-2,c:0\x01)&\x01c:25,r:-2\x01", "=B2+$B$2&SUM(B:D)&AC4")]
    given = cells.select(F.col("formula").alias("form"), "row", "col").select(placed)
    assert given._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2  # forms, and the coordinates of one


def test_texts_come_in_small_parts():
    import pyarrow as pa

    from quirelake.sources.reader import TEXTS_AT_ONCE, in_parts

    batch = pa.record_batch({"x": list(range(1000))})
    parts = list(in_parts(iter([batch])))
    assert max(p.num_rows for p in parts) <= TEXTS_AT_ONCE and [x for p in parts for x in p.column(0).to_pylist()] == list(range(1000))


def _composed(template, key):
    values = {"name": "blue anvil", "brand": "Brand#1", "type": "SMALL", "key": str(key), "size": "7", "brand_latex": "Brand", "rule": "=" * 10, "cr": "\r"}
    return templates._PLACE.sub(lambda m: values.get(m[1], m[0]), template)


@pytest.mark.parametrize("fmt, template", [("markdown", templates.BODY), ("latex", templates.LATEX)])
def test_pieces_that_repeat_are_read_once(monkeypatch, fmt, template):
    from quirelake.plans.convert import convert_text
    from quirelake.sources import inline, latex, markdown

    for remembered in (inline._remembered, markdown._remembered, latex._remembered, latex._remembered_blocks):
        remembered.cache_clear()
    calls = []
    holder, name = (inline._TOKEN, "search") if fmt == "markdown" else (latex._PLAIN, "match")
    counting = type("Counting", (), {name: lambda self, *args: (calls.append(args), getattr(holder, name)(*args))[1]})()
    monkeypatch.setattr(inline if fmt == "markdown" else latex, "_TOKEN" if fmt == "markdown" else "_PLAIN", counting)
    convert_text(_composed(template, 1), fmt, "html")
    first = len(calls)
    convert_text(_composed(template, 2), fmt, "html")
    assert len(calls) - first < first  # what has the key alone is read again


@pytest.mark.parametrize("fmt, source", [("markdown", "- a *b* <javascript:x>\n\n> q ~~s~~"), ("latex", "\\begin{quote}a \\emph{b} \\href{javascript:x}{c}\\end{quote}"), ("latex", "\\begin{itemize}\\item a \\href{javascript:x}{c}\\end{itemize}")])
def test_a_change_of_a_tree_leaves_others_alone(fmt, source):
    from quirelake.plans.render import neutralize_links, render_json
    from quirelake.schema import walk
    from quirelake.sources.reader import parse

    before = parse(fmt, source)
    changed = parse(fmt, source)
    assert neutralize_links(changed) == 1
    for n in walk(changed):
        if n["type"] == "Text":
            n["bold"] = True
        n.get("children", []).append({"type": "HorizontalRule"})
    assert render_json(parse(fmt, source)) == render_json(before) and render_json(before) != render_json(changed)


def test_csv_reads_lines_by_the_delimiters_that_it_has(monkeypatch):
    import csv
    from types import SimpleNamespace

    from quirelake.sources import plain

    used = []
    monkeypatch.setattr(plain, "csv", SimpleNamespace(reader=lambda lines, delimiter: (used.append(delimiter), csv.reader(lines, delimiter=delimiter))[1]))
    assert [plain.sniff(s) for s in ("a,b\n1,2\n", "a;b\n1;2,5\n3;4\n", "a\tb\n1\t2\n", "word\n", "a|b|c\n1|2,x|3\n")] == [",", ";", "\t", ",", "|"]
    assert len(used) == 2 + 6 + 2 + 0 + 4  # 4 delimiters for each of 12 lines before
    tree = plain.parse_csv('k,"a\r\nb",\n1,,"x\n"\n')
    assert [[c["type"] for c in x["children"]] for x in tree["children"][0]["headers"]] == [["Text"], ["Text", "LineBreak", "Text"], []]
