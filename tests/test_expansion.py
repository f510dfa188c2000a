"""Pictures replaced by blocks in the node table, against the same on trees."""

import random

from pyspark.sql import functions as F
from quirelake.operators import expansion, tree
from quirelake.schema import assemble, child_slots, flatten, node, plain_text, text
from quirelake.sources.reader import parse_df
from quirelake.storage import stored

PIECES = ["word one ", "![a](a.png)", "**bold** ", "![b](b.png)", "[in ![c](c.png) link](u) ", "more", "  ", "`code`"]
BLOCKS = ["# T ![h](h.png) x", "> quote {0}\n>\n> - item {1}\n> - ![q](q.png)", "| a | ![t](t.png) |\n|---|---|\n| {0} | 2 |", "{0}{1}{2}", "{0}![z](z.png){1}"]


def _sources():
    rng = random.Random(2)
    return [(i, "\n\n".join(rng.choice(BLOCKS).format(*(rng.choice(PIECES) for _ in range(3))) for _ in range(rng.randrange(1, 5)))) for i in range(60)]


def _made(kind, level, words):
    inner = [text(words)] if words else []
    if kind in ("Paragraph", "Heading"):
        return node(kind, children=inner, **({"level": level or 1} if kind == "Heading" else {}))
    return node(kind, code=words)


def _expanded(n, blocks):
    """A node's child lists with the pictures of ``blocks`` (by identity) replaced."""
    for slot, children in child_slots(n):
        out = []
        for c in children:
            if id(c) in blocks and n["type"] != "Paragraph":
                words = " ".join(b[2].strip() for b in blocks[id(c)])
                out += [text(words)] if words else []
                continue
            _expanded(c, blocks)
            if c["type"] != "Paragraph" or not any(id(x) in blocks for x in c["children"]):
                out.append(c)
                continue
            part = []
            for x in [*c["children"], None]:
                if x is not None and id(x) not in blocks:
                    part.append(x)
                    continue
                if any(p["type"] != "LineBreak" and (p["type"] != "Text" or p["content"].strip()) for p in part):
                    out.append(node("Paragraph", children=part))
                part = []
                out += [_made(*b) for b in blocks[id(x)]] if x is not None else []
        n[slot] = out


def test_expansion_equals_trees(spark):
    docs = spark.createDataFrame(_sources(), "doc_id long, text string")
    nodes = parse_df(docs, "markdown").cache()
    rng = random.Random(7)
    rows, expected = [], {}
    by = {}
    for r in nodes.collect():
        by.setdefault(r.doc_id, []).append(r.asDict())
    for i, found in by.items():
        root = assemble(found)
        order = [root]
        todo = [root]
        order = []
        while todo:  # nodes in the order of their numbers
            n = todo.pop()
            order.append(n)
            todo.extend(reversed([c for _, children in child_slots(n) for c in children]))
        blocks = {}
        for number, n in enumerate(order):
            if n["type"] == "Image" and rng.random() < 0.7:
                mine = [(rng.choice(["Paragraph", "Heading", "CodeBlock", "Equation"]), 2, rng.choice(["made words", "x = 1", ""])) for _ in range(rng.randrange(1, 4))]
                blocks[id(n)] = mine
                rows += [(i, number, k, *b) for k, b in enumerate(mine)]
                if n["caption"]:
                    mine.append(("Paragraph", None, "Figure: " + plain_text(n["caption"])))
        _expanded(root, blocks)
        expected[i] = flatten(root)
    assert len(rows) > 60
    given = spark.createDataFrame([*rows, (0, 0, 0, "Paragraph", 1, "no picture"), (9999, 1, 0, "Paragraph", 1, "no document")], "doc_id long, node_id int, at int, type string, level int, text string")
    made = stored(expansion.expand_images(nodes, given))
    got = {}
    for r in made.collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    for i in expected:
        assert sorted(got[i]) == expected[i], i
    rows_of = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows_of(tree.renumbered(made)) == rows_of(made)
    assert rows_of(expansion.expand_images(nodes, given.limit(0))) == rows_of(nodes)
    assert expansion.expand_images(nodes.limit(0), given).count() == 0
    nodes.unpersist()


def test_captions_follow(spark):
    docs = spark.createDataFrame([(1, r"\begin{figure}\includegraphics{a.png}\caption{A \emph{fine} one}\end{figure}")], "doc_id long, text string")
    nodes = parse_df(docs, "latex")
    image = nodes.where("type = 'Image'").select("doc_id", "node_id", F.lit(0).alias("at"), F.lit("Paragraph").alias("type"), F.lit(1).alias("level"), F.lit("Seen.").alias("text"))
    found = expansion.expand_images(nodes, image).where("type = 'Text'").orderBy("node_id").collect()
    assert [r.text for r in found] == ["Seen.", "Figure: A fine one"]
