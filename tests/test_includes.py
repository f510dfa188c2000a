"""Sources put together, against a plain recursion."""

import posixpath
import random
import re

from quirelake.operators import includes


def _plain(files, main):
    """Text and missing names by recursion."""
    missing = []
    root = posixpath.dirname(main)

    def read(path, stack):
        def one(m):
            if m["skip"] is not None:
                return m["skip"]
            if m["comment"] is not None:
                return ""
            name = (m["braced"] if m["braced"] is not None else m["bare"]).strip()
            full = name if "." in name.rpartition("/")[2] else name + ".tex"
            target = posixpath.normpath(posixpath.join(root, full)) if not name.startswith("/") else None
            if target not in files or not target.endswith(".tex") or root and not target.startswith(root + "/") or target in stack or len(stack) >= 16:
                if name not in missing:
                    missing.append(name)
                return ""
            return read(target, [*stack, target])

        form = r"(?s)(?P<skip>\\begin\{verbatim\}.*?\\end\{verbatim\}|\\verb\|[^|\n]*\|)|\\(?:input|include)(?:\s*\{(?P<braced>[^}]*)\}|\s+(?P<bare>[^\s\\{}%]+))|(?P<comment>(?<!\\)%[^\n]*)"
        return re.sub(form, one, files[path] or "")

    return read(main, [main]), missing


def test_sources_equal_recursion(spark):
    rng = random.Random(4)
    names = [f"d/f{k}.tex" for k in range(14)] + ["d/sub/g.tex", "d/sub/h.tex", "e/out.tex", "d/style.sty", "top.tex"]
    files = {}
    for n in names:
        parts = []
        for _ in range(rng.randrange(0, 6)):
            other = rng.choice(["f1", "f2.tex", "./f3", "sub/g", "sub/../f4", "f5", "nothing", "../e/out", "style.sty", "f6 ", "/d/f7", "sub/h", "f8", "f9", "d/f10", "e/out"])
            parts.append(rng.choice([f"\\input{{{other}}}", f"\\include {{{other}}}", f"\\input {other.strip()} ", f"% \\input{{{other}}}\n  ", f"\\begin{{verbatim}}\\input{{{other}}}\\end{{verbatim}}", f"\\verb|\\input{{{other}}}|", "text \\% more\\\\ ", "é\n"]))
        files[n] = "".join(parts)
    files["d/f0.tex"] = None
    chain = {f"c/x{k}.tex": f"{k} \\input{{x{k + 1}}}" for k in range(20)}
    files |= chain
    table = spark.createDataFrame([(t, p, 1) for p, t in files.items()], "text string, path string, main int")
    mains = spark.createDataFrame([(p,) for p in files] + [("nowhere.tex",), (None,)], "path string")
    got = {r.path: (r.text, r.missing) for r in includes.whole_sources(table, mains).collect()}
    for p in files:
        assert got[p] == _plain(files, p), p
    assert set(got) == set(files) and got["c/x0.tex"][1] == ["x16"]
    assert includes.whole_sources(table.limit(0), mains).count() == 0


def test_rows_moved_grow_with_files_and_not_with_the_files_below_them(spark, monkeypatch):
    from quirelake.storage import stored

    moved = []

    def counted(df):
        out = stored(df)
        moved.append(out.count())
        return out

    monkeypatch.setattr(includes, "stored", counted)
    files = {f"d/p{k}.tex": f"[{k}]\\input{{p{2 * k + 1}}}\\input{{p{2 * k + 2}}}" for k in range(127)} | {"d/p70.tex": "", "d/p71.tex": "a\\input{p8}b", "d/p9.tex": "\\input{p70}\\input{p70}\\input{none}"}
    table = spark.createDataFrame(list(files.items()), "path string, text string")
    got = {r.path: (r.text, r.missing) for r in includes.whole_sources(table, table).collect()}
    assert all(got[p] == _plain(files, p) for p in files)
    assert sum(moved) < 30 * len(files)
