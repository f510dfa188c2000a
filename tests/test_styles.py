"""Styled runs against a plain writer with a stack."""

import random
import unicodedata

from quirelake.operators import styles

NAMES = ("bold", "italic", "strikethrough")


def _plain(runs):
    merged = []
    for text, *flags, other in runs:
        if merged and merged[-1][1:] == [tuple(flags), False] and not other:
            merged[-1][0] += text or ""
        else:
            merged.append([text or "", tuple(flags), bool(other)])
    pieces, stack, spaces = [], [], ""

    def close(keep):
        nonlocal spaces
        while len(stack) > keep:
            pieces.append((2, stack.pop()))
        pieces.append((0, spaces))
        spaces = ""

    def extent(k, s):
        n = 0
        for text, flags, other in merged[k:]:
            if other or text.strip() and not flags[s]:
                break
            n += bool(text.strip())
        return n

    for k, (text, flags, other) in enumerate(merged):
        if other:
            close(0)
            pieces.append((0, text))
            continue
        core = text.strip()
        if not core:
            spaces += text
            continue
        keep = 0
        while keep < len(stack) and flags[stack[keep]]:
            keep += 1
        close(keep)
        at = text.index(core)
        pieces.append((0, text[:at]))
        for s in sorted((s for s in range(3) if flags[s] and s not in stack), key=lambda s: -extent(k, s)):
            stack.append(s)
            pieces.append((1, s))
        pieces.append((0, core))
        spaces = text[at + len(core) :]
    close(0)
    pieces = [p for p in pieces if p[0] or p[1]]

    def beside(i, step):
        if not 0 <= i + step < len(pieces):
            return " ", False
        kind, value = pieces[i + step]
        return ("*", True) if kind else (value[-1] if step < 0 else value[0], False)

    sign = lambda c: unicodedata.category(c)[0] in "PS"

    def fits(form, i, opens):
        (b, mb), (a, ma) = beside(i, -1), beside(i, 1)
        if form[0] == "<":
            return True
        if form == "*" and (mb or ma):
            return False
        left = not a.isspace() and (not sign(a) or b.isspace() or sign(b))
        right = not b.isspace() and (not sign(b) or a.isspace() or sign(a))
        if form[0] == "_":
            return left and (not right or sign(b)) if opens else right and (not left or sign(a))
        return left if opens else right

    out = [v if k == 0 else None for k, v in pieces]
    for i, (kind, s) in enumerate(pieces):
        if kind == 1:
            j = pieces.index((2, s), i)
            out[i], out[j] = next(f for f in styles.FORMS[NAMES[s]] if fits(f[0], i, True) and fits(f[1], j, False))
    return "".join(out)


def test_markers_equal_a_stack(spark):
    rng = random.Random(6)
    docs = []
    for _ in range(400):
        docs.append([(rng.choice(["a", "word ", " x", "  ", "é.", "(q)", "", None, "b c", "*"]), *(rng.random() < 0.45 for _ in range(3)), rng.random() < 0.08) for _ in range(rng.randrange(1, 8))])
    rows = [(d, k, t, b, i, s, o) for d, runs in enumerate(docs) for k, (t, b, i, s, o) in enumerate(runs)]
    df = spark.createDataFrame(rows, "doc_id int, at int, text string, bold boolean, italic boolean, strikethrough boolean, other boolean")
    got = {r.doc_id: r.markdown for r in styles.emphasised(df).collect()}
    assert got == {d: _plain(runs) for d, runs in enumerate(docs)}
    assert styles.emphasised(df.limit(0)).count() == 0


def test_shared_markers(spark):
    rows = [(0, 0, "a ", False, True, None, None), (0, 1, "b", True, True, None, None), (0, 2, " c", False, True, None, None), (1, 0, "in", False, True, False, False), (1, 1, "side", False, False, False, False)]
    df = spark.createDataFrame(rows, "doc_id int, at int, text string, bold boolean, italic boolean, strikethrough boolean, other boolean")
    assert {r.doc_id: r.markdown for r in styles.emphasised(df).collect()} == {0: "_a **b** c_", 1: "*in*side"}
