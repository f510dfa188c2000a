"""Sources and renderers on small cases of our own."""

import pytest

from quirelake.plans.convert import Options, convert_text
from quirelake.plans.render import RENDERERS, Html, Markdown, discard_links, remove_images
from quirelake.schema import NODE_COLUMNS, assemble, flatten, node, paragraph, plain_text, text, walk
from quirelake.sources.html import parse_html
from quirelake.sources.inline import Inline, trim_bare_url
from quirelake.sources.latex import parse_latex
from quirelake.sources.markdown import parse_markdown
from quirelake.sources.plain import display_width, parse_csv, parse_json, parse_text, sniff
from quirelake.sources.reader import parse_transcription


def kinds(tree):
    return [n["type"] for n in tree["children"]]


def md(source, **options):
    return convert_text(source, "html", "markdown", Options(**options))


def test_walk_order_puts_metadata_last():
    tree = node("Document", children=[node("Table", headers=[node("TableCell", children=[text("h")])], caption=[text("c")])], title=[text("t")])
    assert [n["content"] for n in walk(tree) if n["type"] == "Text"] == ["h", "c", "t"]
    rows = flatten(tree)
    assert assemble([dict(zip(NODE_COLUMNS, r, strict=True)) for r in rows]) == tree
    assert rows[0][4] == len(rows) - 1


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<nav><ul><li>menu</ul></nav><p>kept", "kept\n"),
        ("<main><p>in</span></p></main><p>out", "in\n"),
        ("<main>a</main><p>x</p><article>b</article>", "a\n\nb\n"),
        ("<script>var a='</p>';</script><p>&lt;p&gt;", "\\<p\\>\n"),
        ("<head><title>T</title></head><p>x", "x\n"),
    ],
)
def test_extraction(source, want):
    assert md(source, extract_html=True) == want


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<b>a<br>b</b> c", "**a**  \n**b** c\n"),
        ("<b>a</b>\n  <i>b</i>", "**a** _b_\n"),
        ("<title>T</title><p>x", "# T\n\nx\n"),
        ("<title>T</title><h1>H</h1><p>x", "# H\n\nx\n"),
        ("<img src='data:x' data-src=real.png alt=a>", "![a](real.png)\n"),
        ("<img srcset='one.png 1x, two.png 2x'>", "![](one.png)\n"),
        ("<blockquote>Abstract: x</blockquote>", "> [!IMPORTANT]\n> **Abstract**  \n> x\n"),
        ("<blockquote>Abstraction x</blockquote>", "> Abstraction x\n"),
        ("<a href=' JavaScript:x'>y</a>", "[y](#)\n"),
        ("<ul><li><input type=checkbox checked>a<li>b<ul><li>c</ul></ul>", "- [x] a\n- b\n    - c\n"),
        ("<pre><code class=language-py>a\n b</code></pre>", "```py\na\n b\n```\n"),
    ],
)
def test_html(source, want):
    assert md(source) == want


def test_html_tables():
    t = parse_html("<table><tr><th>a<th>b<tr><td>1<td>2</table>")["children"][0]
    assert len(t["headers"]) == 2 and len(t["rows"]) == 1
    t = parse_html("<table><tr><td rowspan=2 colspan=2>x<td>1<td>2<tr><td><p>3</p><p>4</p><td>5</table>")["children"][0]
    assert [len(r["cells"]) for r in t["rows"]] == [4, 4] and plain_text(t["rows"][1]["cells"]) == "3 45"


def test_wiki_pages():
    page = '<div class="mediawiki"></div><h2>A<span class="mw-editsection">edit</span></h2><p>x<sup class="reference">[1]</sup></p><h2>See also</h2><p>y</p><h3>z</h3><h2>B</h2><p>w</p>'
    assert md(page, extract_html=True) == "## A\n\nx\n\n## B\n\nw\n"
    assert "edit" in md(page)


CASES = [
    "# H *i* **b** ~~s~~\n\ntext `a``b` $x$ [l](<u v> \"t\")\n",
    "a * b _c_d_ 1\\. x\n\n1\\. not a list\n\n\\# no heading\n",
    "- a\n- b\n\n1. x\n2. y\n",
    "> [!TIP]\n> hint\n\n> quote\n",
    "| a | b |\n| --- | --- |\n| `x\\|y` | 2 |\n",
    "![alt](a.png)\n\nFigure: cap\n",
    "note[^1] and[^2]\n\n[^1]: one\n\n[^2]: two\n",
]


@pytest.mark.parametrize("source", CASES)
def test_markdown_is_stable(source):
    once = Markdown().document(parse_markdown(source))
    assert parse_markdown(once) == parse_markdown(source)
    assert Markdown().document(parse_markdown(once)) == once


PROBES = [  # what was lost, left alive or slow once
    ("latex", r"a \iffalse x \iftrue y \fi z \else shown \fi keep", "a shown keep\n"),
    ("latex", r"a \iffalse never \iftrue closed \fi", "a\n"),
    ("markdown", "a\ue000b \\* **bo\\*ld** `a\\*b` [li\\]nk](http://a.b/\\(c\\))", "a\ue000b \\* **bo\\*ld** `a\\*b` [li\\]nk](http://a.b/(c))\n"),
    ("markdown", "see http://a.b/c(d). and http://x.y/z)).", "see <http://a.b/c(d)>. and <http://x.y/z>)).\n"),
    ("text", "===\nOn it\n===\nAuthor: A\n  and B\n\nx", '---\ntitle: "On it"\nauthor: "A and B"\n---\n\nx\n'),
]


@pytest.mark.parametrize(("fmt", "source", "want"), PROBES)
def test_probes(fmt, source, want):
    assert convert_text(source, fmt, "markdown") == want


def test_unsafe_links():
    made = convert_text('<a href="java\tscript:x">a</a> <a href="\x01 data:x">b</a> <a href="http://a.b">c</a>', "html", "html")
    assert made.count('href="#"') == 2 and 'href="http://a.b"' in made


def test_deep_and_long():
    """Nesting of thousands of levels, and many runs of backticks, within seconds."""
    import time

    begin = time.perf_counter()
    for fmt, source in (("html", "<div>" * 3000 + "x"), ("html", "<ul><li>" * 600 + "x"), ("markdown", "> " * 2000 + "x"), ("latex", "{" * 3000 + "x"), ("markdown", " ".join("`" * i + "x" for i in range(1, 401)))):
        convert_text(source, fmt, "markdown")
    assert time.perf_counter() - begin < 10


def test_models_are_not_passed_over():
    with pytest.raises(ValueError, match="model"):
        Options(image_handling="describe")


@pytest.mark.parametrize("literal", ["a*b*c", "_x_", "[a](b)", "`x`", "<b>", "1. x", "# x", "- x", "~~x~~", "$a$", "a_b_c", "&amp;", "![a](b)", "\\*"])
def test_literals_survive_markdown(literal):
    tree = node("Document", children=[paragraph(text(literal))])
    assert parse_markdown(Markdown().document(tree)) == tree


def test_markdown_references():
    got = parse_markdown("[a][X] [b] [c][none]\n\n[x]: http://x\n[b]: http://b 'T'\n")["children"][0]["children"]
    assert [n["url"] for n in got if n["type"] == "Link"] == ["http://x", "http://b"] and "[c][none]" in plain_text(got)
    assert plain_text(Inline({}, {"a": "see [^a]"}).parse("[^a]")[0]["content"]) == "see [^a]"


def test_trim_bare_url():
    assert [trim_bare_url(u) for u in ("http://a.b/c).", "http://a/(b)", "http://a?!")] == ["http://a.b/c", "http://a/(b)", "http://a"]


def test_text_lists_notes_and_wrapping():
    assert kinds(parse_text("1. a\n2. b\n\n1. c\n")) == ["ListBlock", "ListBlock"]
    tree = parse_text("One[1] two[2].\n\n[1] First.\n\n[2] Second.\n")
    assert sum(n["type"] == "Footnote" for n in walk(tree)) == 2
    assert plain_text(parse_text("One[1] two[2].\n")["children"]) == "One[1] two[2]."
    wrapped = "\n".join(["word " * 11 + "longer"] * 5)
    assert not any(n["type"] == "LineBreak" for n in walk(parse_text(wrapped)))
    assert any(n["type"] == "LineBreak" for n in walk(parse_text("roses are red\nviolets are blue\n")))
    assert display_width("a漢é") == 4


def test_text_round_trip():
    source = "Title\n=====\n\nSome text.\n\n- a\n- b\n\n+---+---+\n| a | b |\n+===+===+\n| 1 | 2 |\n+---+---+\n\n    code\n      more\n"
    assert convert_text(source, "text", "text") == source


@pytest.mark.parametrize(("sample", "want"), [("a;b;c\n1;2;3", ";"), ("a\tb\n1\t2", "\t"), ("a|b\n1|2", "|"), ("a,b\n1,2", ","), ("plain", ",")])
def test_sniff(sample, want):
    assert sniff(sample) == want


def test_csv():
    assert convert_text("﻿a;b\n1\n\n;\n", "csv", "csv") == "a,b\r\n1,\r\n"
    assert convert_text("", "csv", "markdown") == "" and parse_csv("")["children"] == []
    assert convert_text('a,b\n"x\ny","q""z"\n', "csv", "csv") == 'a,b\r\n"x\ny","q""z"\r\n'
    with pytest.raises(ValueError, match="no table"):
        convert_text("x", "text", "csv")


def test_json_errors():
    tree = parse_markdown(CASES[0])
    assert parse_json(RENDERERS["json"](tree)) == tree
    for bad in ('{"type": "Nope"}', '{"type": "Text"}', '{"type": "Paragraph", "children": 1}', "[]", '{"type": "Paragraph"}'):
        with pytest.raises(ValueError):
            parse_json(bad)
    assert parse_json('{"type": "Document", "more": 1}') == node("Document")


def test_latex():
    tree = parse_latex(r"\newcommand{\w}[1]{\emph{#1}}\section{A}\w{x} ``q'' caf\'e --- \verb|a_b| 5\% % gone" "\n\n" r"\begin{enumerate}\item a\item b\end{enumerate}\begin{tabular}{ll}\hline h & i\\\hline 1 & 2\\\end{tabular}")
    assert kinds(tree) == ["Heading", "Paragraph", "ListBlock", "Table"]
    assert Markdown().document(tree).startswith("# A\n\n_x_ “q” café — `a_b` 5%\n")
    assert len(tree["children"][3]["headers"]) == 2
    bomb = r"\newcommand{\a}{\b\b\b\b\b\b\b\b\b\b}\newcommand{\b}{\c\c\c\c\c\c\c\c\c\c}\newcommand{\c}{\a\a\a\a\a\a\a\a\a\a}\a"
    parse_latex(bomb)


def test_passes():
    tree = parse_markdown("[a ![i](s) b](u) [![j](s)](v)")
    remove_images(tree)
    assert [n["url"] for n in walk(tree) if n["type"] == "Link"] == ["u"]
    discard_links(tree)
    assert not any(n["type"] == "Link" for n in walk(tree)) and plain_text([tree]) == "a  b "


def test_transcription_and_errors():
    tree = parse_transcription("```html\n<table><tr><td>a</td></tr><tr><td>b</td></tr></table>\n```")
    assert len(tree["children"][0]["headers"]) == 1
    with pytest.raises(ValueError, match="markdown"):
        convert_text("x", "nope", "html")
    assert "alert-tip" in Html().document(parse_markdown(CASES[3]))


def test_code_parsing():
    source = "Some words of prose that go on.\n\ndef f(a_b):\n\nx = 1\n\nreturn a_b + x\n\nSee [the docs](http://x) and mail a@b.c for more, as in [1].\n"
    got = convert_text(source, "markdown", "markdown", Options(code_parsing=True))
    assert "```\ndef f(a_b):\nx = 1\nreturn a_b + x\n```" in got and got.startswith("Some words of prose") and got.rstrip().endswith("as in [1].") is False or "[the docs]" in got


def made_workbook(sheets):
    """A workbook with the sheets given: name, state and the XML of its rows."""
    import io
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" state="{s}" r:id="rId{i}"/>' for i, (n, s, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {main}><sheets>{names}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst {main}><si><t>plain</t></si><si><r><t>two</t></r><r><t> runs, "q"</t></r><rPh sb="0" eb="1"><t>no</t></rPh></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="&quot;d&quot;0.0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        for i, (_, _, rows) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark):
    from quirelake.sources.workbook import csv_files, workbook_cells

    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3" s="1"><v>45000</v></c><c r="B3" s="1"><v>45000.5</v></c><c r="C3" s="1"><v>0.25</v></c>'
        '<c r="D3" s="2"><v>2.50</v></c><c r="E3" t="b"><v>1</v></c><c r="F3" t="inlineStr"><is><t>in</t></is></c><c r="G3"><f>A3+1</f><v>45001</v></c><c r="H3" t="e"><v>#N/A</v></c></row>'
    )
    one, two = made_workbook([("Data", "visible", rows), ("Secret", "hidden", rows)]), made_workbook([("a/b", "visible", '<row><c r="B1"><v>1</v></c></row>'), ("c", "visible", '<row><c r="A1"><v>2</v></c></row>'), ("none", "visible", "")])
    df = spark.createDataFrame([("one", one, "clash"), ("two", two, ""), ("bad", b"zip", ""), ("null", None, "")], "path string, content binary, sheet string")
    cells = workbook_cells(df)
    got = {(r["path"], r["suffix"]): r["csv"] for r in csv_files(cells).collect()}
    line = "2023-03-15,2023-03-15 12:00:00,06:00:00,2.5,TRUE,in,45001,#N/A"
    assert got == {("one", ""): f'﻿plain,,"two runs, ""q""",,,,,\r\n,,,,,,,\r\n{line}\r\n', ("two", "_a_b"): "﻿,1\r\n", ("two", "_c"): "﻿2\r\n"}
    assert [(r["row"], r["col"]) for r in cells.where("formula = '=A3+1'").collect()] == [(2, 6)]
    assert {r["path"] for r in cells.where("error is not null").collect()} == {"bad", "null"}
    assert workbook_cells(df.limit(0)).count() == 0
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert csv_files(cells.where("path = 'one'")).head()["csv"] == got["one", ""]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_save_by_extension(spark, tmp_path):
    from quirelake.plans.convert import save

    df = spark.createDataFrame([(1, "a,b")], "doc_id long, text string")
    save(df, f"{tmp_path}/out.csv")
    save(df, f"{tmp_path}/plain")
    back = spark.read.option("header", True).csv(f"{tmp_path}/out.csv")
    assert [tuple(r) for r in back.collect()] == [("1", "a,b")] and spark.read.parquet(f"{tmp_path}/plain").count() == 1
    with pytest.raises(ValueError, match="no writer"):
        save(df, f"{tmp_path}/out.docx")
    with pytest.raises(ValueError, match="is read by"):
        save(back, f"{tmp_path}/out.csv", mode="overwrite")


def test_warnings_come_from_the_same_pass(spark):
    from quirelake.sources.reader import parse_and_warn

    good = '{"type": "Document", "children": []}'
    rows = [(1, good), (2, "{"), (3, None), (4, "[1]"), (5, '{"type": "Nope"}')]
    nodes, warnings = parse_and_warn(spark.createDataFrame(rows, "doc_id long, text string"), "json")
    assert [tuple(r)[:2] for r in nodes.collect()] == [(1, 0)]
    assert sorted((r.doc_id, r.code) for r in warnings.collect()) == [(i, "failed") for i in (2, 3, 4, 5)]
    nodes, warnings = parse_and_warn(spark.createDataFrame([(1, "a\x01b\ufffd"), (2, "plain")], "doc_id long, text string"), "text")
    assert sorted((r.doc_id, r.code) for r in warnings.collect()) == [(1, "control_characters"), (1, "replaced_characters")]
    assert nodes.select("doc_id").distinct().count() == 2
