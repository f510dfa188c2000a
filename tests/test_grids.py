"""Spans against a plain walk."""

import random

from quirelake.operators import grids


def _walk(rows):
    """Cells of each row by walking columns with what is carried."""
    carry, out = [], []
    for cells in rows:
        cells, row = list(cells), []
        while len(row) < 4096:
            found = next((c for c in carry if c[0] == len(row) and c[1] > 0), None)
            if found:
                row.append("")
                found[1] -= 1
            elif cells:
                text, across, down = cells.pop(0)
                for k in range(across):
                    if down > 1:
                        carry.append([len(row), down - 1])
                    row.append(text if k == 0 else "")
            elif any(c[1] > 0 and c[0] > len(row) for c in carry):
                row.append("")
            else:
                break
        carry = [c for c in carry if c[1] > 0]
        out.append(row)
    return out


def test_spans_equal_a_walk(spark):
    rng = random.Random(12)
    tables = {t: [[(f"{t}.{r}.{c}", rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3, 5])) for c in range(rng.randrange(1, 6))] for r in range(rng.randrange(1, 8))] for t in range(150)}
    tables[1000] = [[("wide", 5000, 2), ("gone", 1, 1)], [("next", 1, 1)]]
    tables[1001] = [[("a", 4000, 1), ("b", 96, 2), ("gone", 1, 1)], [("c", 1, 1)]]
    cells = [(t, r, c, *cell) for t, rows in tables.items() for r, row in enumerate(rows) for c, cell in enumerate(row)]
    df = spark.createDataFrame(cells, "doc_id int, row int, at int, text string, colspan int, rowspan int")
    got = {}
    for x in sorted(grids.without_spans(df).collect(), key=lambda x: (x.doc_id, x.row, x.col)):
        got.setdefault(x.doc_id, {}).setdefault(x.row, []).append(x.text)
    for t, rows in tables.items():
        if t < 1000:
            assert [got[t].get(r, []) for r in range(len(rows))] == _walk(rows), t
    assert [len(got[1000][r]) for r in (0, 1)] == [4096, 4096] and got[1001][1][0] == "c" and len(got[1001][0]) == 4096
    odd = spark.createDataFrame([(1, 0, 0, None, 0, None), (1, 0, 1, "b", -2, 1)], "doc_id int, row int, at int, text string, colspan int, rowspan int")
    assert sorted((x.col, x.text) for x in grids.without_spans(odd).collect()) == [(0, ""), (1, "b")]
    assert grids.without_spans(df.limit(0)).count() == 0
