"""Passes over the node table against the same passes over trees, and the smaller operators."""

import pytest
from pyspark.sql import functions as F

from quirelake.functions import formats, text
from quirelake.operators import blocks, tree
from quirelake.plans.convert import convert_df, render_df
from quirelake.plans.render import discard_links, neutralize_links, remove_images
from quirelake.schema import NODE_COLUMNS, assemble, flatten, plain_text
from quirelake.sources.markdown import parse_markdown
from quirelake.sources.reader import parse_df

SOURCES = [
    "[a ![i](s) **b**](u) c [![j](s)](v)\n\n# [h](javascript:x)\n",
    "plain\n\n- [x](y) z\n- w\n",
    "",
    None,
    "| [a](b) | ![c](d) |\n| --- | --- |\n| 1 | [2](DATA:x) |\n",
]


@pytest.fixture(scope="module")
def nodes(spark):
    df = spark.createDataFrame([(i, s, "clash") for i, s in enumerate(SOURCES)], "doc_id long, text string, type string")
    return parse_df(df, "markdown").cache()


def trees(df):
    by_id = {}
    for r in df.collect():
        by_id.setdefault(r["doc_id"], []).append(r.asDict())
    return {i: assemble(rows) for i, rows in by_id.items()}


def test_parse_df(nodes):
    assert trees(nodes) == {i: parse_markdown(s or "") for i, s in enumerate(SOURCES)}


@pytest.mark.parametrize(("on_nodes", "on_tree"), [(tree.discard_links, discard_links), (tree.neutralize_links, neutralize_links), (tree.remove_images, remove_images)])
def test_passes(nodes, on_nodes, on_tree):
    got = tree.renumbered(on_nodes(nodes))
    for i, made in trees(got).items():
        want = parse_markdown(SOURCES[i] or "")
        on_tree(want)
        assert made == want
        rows = sorted((tuple(r[c] for c in NODE_COLUMNS) for r in got.where(F.col("doc_id") == i).collect()), key=lambda r: r[0])
        assert rows == flatten(want)


def test_plain_text(nodes):
    got = {(r["doc_id"], r["node_id"]): r["text"] for r in tree.plain_text(nodes, ("Paragraph", "Heading")).collect()}
    made = trees(nodes)
    for i, t in made.items():
        want = [plain_text([n]) for n in t["children"] if n["type"] in ("Paragraph", "Heading")]
        assert [v for k, v in sorted(got.items()) if k[0] == i][: len(want)] == want or i == 1


def test_render_and_convert_agree(spark, nodes):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SOURCES)], "doc_id long, text string")
    whole = {r["doc_id"]: r["converted"] for r in convert_df(df, "markdown", "html").collect()}
    by_nodes = {r["doc_id"]: r["rendered"] for r in render_df(tree.neutralize_links(nodes), "html").collect()}
    assert whole == by_nodes
    errors = {r["doc_id"]: r["error"] for r in convert_df(df, "markdown", "csv").collect()}
    assert errors[1] and errors[4] is None


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    made = [parse_df(df, "html"), convert_df(df, "text", "html"), blocks.blocks_of(df), blocks.wrap_statistics(df), blocks.content_dedup(df), blocks.contexts(df, "x")]
    assert [m.count() for m in made] == [0] * 6
    assert tree.renumbered(tree.discard_links(made[0])).count() == 0


def test_section_numbers(spark):
    levels = [1, 2, 2, 3, 1, 3, 2]
    df = spark.createDataFrame([(1, i, k, i != 2) for i, k in enumerate(levels)], "doc_id long, node_id int, level int, numbered boolean")
    got = {r["node_id"]: r["number"] for r in tree.section_numbers(df).collect()}
    assert got == {0: "1", 1: "1.1", 3: "1.1.1", 4: "2", 5: "2.0.1", 6: "2.1"}


def test_formulas_go_round(spark):
    ranges = spark.createDataFrame([("s", "D", 2, 5, "=B{r}+$A$1"), ("s", "D", 8, 8, "=B{r}"), ("s", "E", 1, 3, "=SUM(A1:C1)")], "sheet string, col string, first int, last int, formula string")
    cells = blocks.expand_formulas(ranges.where("formula not like '%SUM%'"))
    assert cells.count() == 5
    assert {tuple(r) for r in blocks.compress_formulas(cells).select("col", "first", "last", "formula").collect()} == {("D", 2, 5, "=B{r}+$A$1"), ("D", 8, 8, "=B{r}")}


def test_decoding(spark):
    s = "né €"
    files = [s.encode(), b"\xef\xbb\xbf" + s.encode(), s.encode("utf-16"), "né".encode("cp1252")]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(files)], "i int, data binary")
    got = [r[0] for r in df.orderBy("i").select(formats.decoded_file(F.col("data"))).collect()]
    assert got == [s, s, s, "né"]
    pages = [("x\xe9".encode("latin-1"), "ISO-8859-1"), (b'<meta charset="windows-1252">\x80', None), (b"a\xff", "nonsense")]
    df = spark.createDataFrame(pages, "data binary, charset string")
    got = [r[0] for r in df.select(formats.decoded_page(F.col("data"), F.col("charset"))).collect()]
    assert got[0] == "xé" and got[1].endswith("€") and got[2] == "a�"
    magic = spark.createDataFrame([(b"x%PDF-1.7", "pdf"), (b"nope", "pdf"), (b"PK\x03\x04", "docx"), (b"", "xlsx")], "d binary, f string")
    assert [r[0] for r in magic.select(formats.magic_ok(F.col("d"), F.col("f"))).collect()] == [True, False, True, False]


def test_numbers_and_choices(spark):
    df = spark.createDataFrame([(3.0,), (2.25,), (None,), (-7.0,)], "v double")
    assert [r[0] for r in df.select(text.format_number(F.col("v"))).collect()] == ["3", "2.25", "", "-7"]
    with pytest.raises(ValueError, match="markdown"):
        formats.check_choice("format", "x", ("markdown", "html"))


def test_media(spark):
    from quirelake.functions import media

    df = spark.createDataFrame([("HTTPS://a.b/c%20d.png?x=1", "image/svg+xml; q=1"), ("//h/x", "image/jpeg"), ("C:/a b.png", "text/html"), ("rel/p.gif", None)], "u string, t string")
    u = F.col("u")
    got = df.select(
        media.is_remote(u), media.has_scheme(u), media.resolve_local(u, F.lit("/base/")), media.sanitized_filename(media.image_filename(u)), media.extension_of_type(F.col("t"))
    ).collect()
    assert [tuple(r)[:3] for r in got] == [(True, True, "HTTPS://a.b/c%20d.png?x=1"), (True, False, "//h/x"), (False, False, "C:/a b.png"), (False, False, "/base/rel/p.gif")]
    assert got[0][3] == "c_d.png" and got[1][3].startswith("image_") and [r[4] for r in got] == [".svg", ".jpg", None, None]
    data = spark.createDataFrame([("data:text/plain;base64,aGk=",), ("data:,a%20b",), ("http://x",)], "u string")
    assert [r[0] and bytes(r[0]) for r in data.select(media.data_url_bytes(u)).collect()] == [b"hi", b"a b", None]
    box = spark.range(1).select(media.box_text(F.lit(10), F.lit(50), F.lit(30), F.lit(20), F.lit(18)).alias("b")).withColumn("p", media.box_of_text(F.col("b"))).first()
    assert box["b"] == "Text box (x 10%, y 50%, w 30%, h 20%, font 18pt)" and (box["p"]["x"], box["p"]["font"]) == (10, 18.0)
    other = spark.range(1).select(
        media.sheet_serial(F.lit("1900-01-01 12:00:00").cast("timestamp")), media.property_text(F.lit("a  b\n" + "word " * 80)), media.frame_percent(F.lit(1), F.lit(3))
    ).first()
    assert other[0] == 2.5 and len(other[1]) <= 255 and other[1].endswith("word") and other[2] == 33


def test_unique_names_are_unique(spark):
    names = ["x", "X", "x (2)", None, "x", "y" * 31, "y" * 31]
    df = spark.createDataFrame([(1, i, n, "clash") for i, n in enumerate(names)] + [(2, 0, "x", "clash")], "doc_id long, node_id long, name string, at string")
    got = {(r["doc_id"], r["node_id"]): r["unique_name"] for r in tree.unique_names(df, "name").collect()}
    assert [got[1, i] for i in range(7)] == ["x", "X (2)", "x (2) (2)", None, "x (3)", "y" * 31, "y" * 27 + " (2)"] and got[2, 0] == "x"
    assert tree.unique_names(df.limit(0), "name").count() == 0


def test_depth_below_nested_links(spark):
    from quirelake.schema import node, paragraph
    from quirelake.schema import text as words

    inner = node("Link", url="v", content=[words("b")])
    document = node("Document", children=[paragraph(node("Link", url="u", content=[words("a"), inner]), words("c"))])
    from quirelake.schema import node_schema

    df = spark.createDataFrame([(1, *r) for r in flatten(document)], node_schema())
    assert [(r["text"], r["depth"]) for r in tree.discard_links(df).orderBy("node_id").collect()] == [(None, 0), (None, 1), ("a", 2), ("b", 2), ("c", 2)]


def test_references_of_odd_documents(spark):
    from quirelake.operators import references

    tex = ["", None, r"\ref{a}\label{a}", "\\section{S}\\label{a}\n\n\\ref{a}\n\n\\section{T}\n\n\\label{a}x"]
    df = parse_df(spark.createDataFrame([(i, s, "clash") for i, s in enumerate(tex)], "doc_id long, text string, label string"), "latex")
    assert sorted((r["doc_id"], r["shown"]) for r in references.printed_references(df).collect()) == [(2, "[a]"), (3, "2")]


def test_layout_of_empty_tables(spark):
    from quirelake.operators import layout, references

    empty = spark.createDataFrame([], "doc_id long, at long, kind string, level int, text string, feature string, list long, start int, ok boolean, code string, language string, note string")
    made = [layout.slide_plans(empty), layout.list_numbers(empty), layout.run_until_failures(empty, phase="doc_id"), layout.dropped_census(empty), layout.code_runs(empty)]
    assert not sum(df.count() for df in [*made, references.paired_notes(empty, empty), references.attached_captions(empty)])
