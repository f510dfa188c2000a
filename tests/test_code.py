"""Code in sources: the rules for one text, and the same over tables."""

import random

from quirelake.operators import code as tables
from quirelake.plans.convert import Options, convert_text
from quirelake.sources import code

PROSE = [
    "List:", "Reference in `requirements.txt`:", "> - [![T](Foto.jpg)](https://e.org/a_b) and a [hobbit-hole][1].\n\n[1]: https://x.org", "Formatting **bold** *italic **both*** ~~struck~~, [link](https://www.google.it/?&hl=it)",
    "[4] E. Author, “Ai-based detection,” _Computational_ _Economics_, vol. 59, pp. 987–1005.", "Keith T. Smith, [1] _[★]_ A. N. Other, [2] Third Author [2] _[,]_ [3]", "_★_ E-mail: publications@ras.ac.uk (KTS)",
    "van Dijk T., 1902, QJRAS, 2, 202\nFournier P., 1901, ApJ, 1, 101", "A **000**, 1–2 (2026)", "``Use `code` in your Markdown file.``", "# Heading = (x)", "- item = (x);", "| a | b |\n|---|---|\n| 1 | 2 |",
]
CODE = [
    ("def f(x):\n    return x_y * 2", "python"), ("public class A {\n  int x = 1;\n  System.out.println(x);\n}", "java"), ("SELECT a_b, c_d FROM t WHERE (x = 1);", "sql"), ('{"a": [1, 2], "b": {"c": true}}', "json"), ("x_y = f(a, b[0]);", None), ("const a = () => { return b; };", "javascript"),
]


def test_prose_is_left_alone():
    for text in PROSE:
        assert code.fenced(f"Intro text.\n\n{text}") == f"Intro text.\n\n{text}"


def test_code_keeps_its_lines_and_has_a_language():
    for source, language in CODE:
        assert code.fenced(f"Some words.\n\n{source}\n\nMore words of prose.") == f"Some words.\n\n```{language or ''}\n{source}\n```\n\nMore words of prose."
    got = convert_text("Intro.\n\ndef __init__(self, my_var):\n    self.my_var = a * b * c\n    return self.my_var\n", "markdown", "markdown", Options(code_parsing=True))
    assert "```python\ndef __init__(self, my_var):\n    self.my_var = a * b * c\n    return self.my_var\n```" in got


def test_neighbours_join_and_fences_stay():
    text = "def f(a_b):\n    pass\n\n\nreturn a_b + self.x;\n\n```\nx = 1;\n\ny = f(2);\n```\nText after."
    assert code.fenced(text) == "```python\ndef f(a_b):\n    pass\n\nreturn a_b + self.x;\n```\n\n```\nx = 1;\n\ny = f(2);\n```\n\nText after."


def _documents():
    rng = random.Random(3)
    pieces = [*PROSE, *(s for s, _ in CODE), "Some words of prose that go on.", "~~~\na = 1;\n\nb\n~~~", "``` js\nx();", "    indented = code(1)\n    more()", "\tx", " ", "```", "a\r\nb"]
    return [(i, rng.choice(["\n\n", "\n\n\n", "\n \n"]).join(rng.choice(pieces) for _ in range(rng.randrange(0, 9)))) for i in range(120)] + [(120, None), (121, ""), (122, "\n\n")]


def test_tables_equal_single_texts(spark):
    docs = _documents()
    df = spark.createDataFrame([(t, i, 1) for i, t in docs], "text string, doc_id long, block int")
    blocks = {}
    for r in sorted(tables.source_blocks(df).collect(), key=lambda r: r.block):
        blocks.setdefault(r.doc_id, []).append((r.source, r.fenced))
    assert blocks == {i: b for i, t in docs if (b := code.blocks_of(t or ""))}
    assert {r.doc_id: r.text for r in tables.fenced_sources(df).collect()} == {i: code.fenced(t or "") for i, t in docs}
    assert tables.fenced_sources(df.limit(0)).count() == 0


def _walked(rows):
    """Short lines by walking away from code in both directions."""
    joins = [c for _, c in rows]
    short = [not c and 0 < len((t or "").split()) <= tables.SHORT_WORDS for t, c in rows]
    for step in (1, -1):
        for start, (_, is_code) in enumerate(rows):
            i, seen = start + step, []
            while is_code and 0 <= i < len(rows) and short[i]:
                seen.append(i)
                i += step
            signs = [k for k, j in enumerate(seen) if any(x in rows[j][0] for x in code.INDICATORS)]
            whole = 0 <= i < len(rows) and rows[i][1]
            for j in seen if whole else seen[: signs[-1] + 1] if signs and is_code else []:
                joins[j] = joins[j] or is_code
    return joins


def test_short_lines_beside_code(spark):
    rng = random.Random(9)
    docs = [[(t, t == "code") for t in (rng.choice(["code", "x = 1", "else", "a long line of words that is prose by itself", None, "short one", "}"]) for _ in range(rng.randrange(1, 14)))] for _ in range(80)]
    df = spark.createDataFrame([(d, k, t, c) for d, rows in enumerate(docs) for k, (t, c) in enumerate(rows)], "doc_id int, at int, text string, is_code boolean")
    got = {(r.doc_id, r.at): r.joins for r in tables.absorbed_lines(df).collect()}
    assert got == {(d, k): j for d, rows in enumerate(docs) for k, j in enumerate(_walked(rows))}
