"""Node trees to Markdown, HTML, LaTeX, plain text, CSV and JSON."""

from __future__ import annotations

import csv
import html as _html
import io
import json
import re
from urllib.parse import urlparse

from ..schema import NODE_FIELDS, Node, child_slots, node, walk
from ..sources.plain import UNDERLINES, display_width

Nodes = list[Node]


#: The name of the method for each node type.
_METHOD = {kind: kind.lower() for kind in NODE_FIELDS}


def _runs(nodes: Nodes) -> Nodes:
    """Neighbouring texts of one style joined."""
    if len(nodes) < 2:
        return nodes
    out: Nodes = []
    for n in nodes:
        if n["type"] == "Text" and out and out[-1]["type"] == "Text" and {k: v for k, v in n.items() if k != "content"} == {k: v for k, v in out[-1].items() if k != "content"}:
            out[-1] = out[-1] | {"content": out[-1]["content"] + n["content"]}
        else:
            out.append(n)
    return out


def spaces_apart(s: str) -> tuple[str, str, str]:
    """Leading white space, core, trailing white space."""
    core = s.strip()
    at = s.find(core) if core else len(s)
    return s[:at], core, s[at + len(core) :]


def table_grid(table: Node) -> tuple[Nodes, list[Nodes]]:
    """Header and rows, padded to the widest."""
    rows = [r["cells"] for r in table["rows"]]
    width = max([len(table["headers"]), *map(len, rows)], default=0)
    pad = lambda cells: [*cells, *(node("TableCell") for _ in range(width - len(cells)))]
    return pad(table["headers"]) if table["headers"] else [], [pad(r) for r in rows]


def macro(n: Node) -> str:
    """A reference macro as it is written in LaTeX."""
    if n["type"] == "Label":
        return f"\\label{{{n['name']}}}"
    options = "".join(f"[{o}]" for o in n["options"])
    return f"\\{n['style']}{options}{{{','.join(n['keys']) if n['type'] == 'Citation' else n['label']}}}"


class Renderer:
    """Blocks and inline nodes as strings; subclasses have one method for each node type.

    A type without a method renders as nothing.  Footnotes are numbered in the
    order in which they are met, nested ones after all outer ones.
    """

    def __init__(self):
        self.notes: list[Nodes] = []

    def inline(self, nodes: Nodes) -> str:
        return "".join(self._one(n) for n in _runs(nodes))

    def _one(self, n: Node) -> str:
        method = getattr(self, _METHOD[n["type"]], None)
        return method(n) if method else ""

    def blocks(self, nodes: Nodes, between: str = "\n\n") -> str:
        return between.join(s for n in nodes if (s := self._one(n)) != "")

    def footnote(self, n: Node) -> str:
        self.notes.append(n["content"])
        return self.mark(len(self.notes))

    def mark(self, number: int) -> str:
        return f"[{number}]"

    def note_texts(self) -> list[str]:
        """The notes so far; notes inside them follow."""
        out: list[str] = []
        while len(out) < len(self.notes):
            out.append(self.inline(self.notes[len(out)]))
        return out

    def citation(self, n: Node) -> str:
        return macro(n)

    reference = label = citation

    def bibliography(self, n: Node) -> str:
        return "\n\n".join([*n["commands"], *(f"\\bibitem{f'[{e["label"]}]' if e['label'] else ''}{{{e['key']}}} {self.inline(e['children'])}" for e in n["entries"])])


_MAY_ESCAPE = re.compile(r"[\\`*\[\]<>~$_!&]")
_LINE_MARK = re.compile(r"^(#{1,6}(?=\s)|[-+](?=\s)|>|=+\s*$|-{2,}\s*$|\|)")
_LINE_NUMBER = re.compile(r"^(\d{1,9})([.)])(?=\s)")
_CELL_SPACES = re.compile(r"[ \t]+")
_ESCAPED = re.compile(r"([\\`*\[\]<>~$]|(?<![^\W_])_|_(?![^\W_])|!(?=\[)|&(?=#|[A-Za-z]))")


class Markdown(Renderer):
    """GitHub-flavoured Markdown."""

    def mark(self, number: int) -> str:
        return f"[^{number}]"

    def document(self, n: Node) -> str:
        meta = [f'{k}: "{self.inline(n[k]).replace(chr(92), chr(92) * 2).replace(chr(34), chr(92) + chr(34))}"' for k in ("title", "author", "date") if n[k]]
        parts = [*(["---\n" + "\n".join(meta) + "\n---"] if meta else []), self.blocks(n["children"])]
        parts += [f"[^{i}]: {t}" for i, t in enumerate(self.note_texts(), 1)]
        body = "\n\n".join(p for p in parts if p)
        return f"{body}\n" if body else ""

    def text(self, n: Node) -> str:
        before, core, after = spaces_apart(n["content"].replace("\n", " "))
        if not core:
            return n["content"]
        if _MAY_ESCAPE.search(core):
            core = _ESCAPED.sub(r"\\\1", core)
        if n["script"]:
            core = f"<{n['script']}>{core}</{n['script']}>"
        if n["italic"]:
            core = f"_{core}_"
        if n["bold"]:
            core = f"**{core}**"
        if n["strikethrough"]:
            core = f"~~{core}~~"
        return before + core + after

    def inline(self, nodes: Nodes) -> str:
        if len(nodes) == 1 and nodes[0]["type"] == "Text" and not nodes[0]["bold"] and not nodes[0]["italic"]:
            return self.text(nodes[0])
        out = ""
        nodes = _runs(nodes)
        for k, n in enumerate(nodes):
            s = self._one(n)
            if n["type"] == "Text" and (n["bold"] or n["italic"]) and (core := spaces_apart(n["content"])[1]):
                following = nodes[k + 1]["content"][:1] if k + 1 < len(nodes) and nodes[k + 1]["type"] == "Text" else ""
                letters = out[-1:].isalnum() and s[:1] in "_*~" or following.isalnum() and s[-1:] in "_*~"
                plain = core[0].isalnum() and core[-1].isalnum() and out[-1:] != "*" and following != "*"
                if letters and plain and n["italic"] and not n["bold"] and not n["strikethrough"]:
                    s = s.replace(f"_{core}_", f"*{core}*")  # an underscore beside a letter is no marker
                elif letters and not (plain and not n["italic"]) or out[-1:] == "*" and s[:1] == "*":
                    before, core, after = spaces_apart(n["content"])
                    core = _ESCAPED.sub(r"\\\1", core)
                    for flag, tag in (("italic", "em"), ("bold", "strong"), ("strikethrough", "del")):
                        core = f"<{tag}>{core}</{tag}>" if n[flag] else core
                    s = before + core + after
            out += s
        return out

    def link(self, n: Node) -> str:
        inner = self.inline(n["content"])
        if not n["title"] and len(n["content"]) == 1 and n["content"][0]["type"] == "Text" and n["content"][0]["content"] == n["url"] and re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]+:[^\s<>]*", n["url"]):
            return f"<{n['url']}>"
        title = f' "{n["title"].replace(chr(34), chr(92) + chr(34))}"' if n["title"] else ""
        return f"[{inner}]({self._target(n['url'])}{title})"

    def _target(self, url: str) -> str:
        return f"<{url}>" if re.search(r"\s", url) or url.count("(") != url.count(")") else url

    def image(self, n: Node) -> str:
        title = f' "{n["title"]}"' if n["title"] else ""
        return f"![{n['alt']}]({self._target(n['src'])}{title})"

    def codeinline(self, n: Node) -> str:
        ticks = "`" * (max([0, *map(len, re.findall("`+", n["code"]))]) + 1)
        pad = " " if n["code"].startswith("`") or n["code"].endswith("`") else ""
        return f"{ticks}{pad}{n['code']}{pad}{ticks}"

    def linebreak(self, n: Node) -> str:
        return "  \n"

    def equation(self, n: Node) -> str:
        if n["inline"]:
            return f"${n['code']}$"
        code = f"\\begin{{{n['env']}}}\n{n['code']}\n\\end{{{n['env']}}}" if n["env"] else n["code"]
        return f"$$\n{code}\n$$"

    def paragraph(self, n: Node) -> str:
        lines = self.inline(n["children"]).split("\n")
        lines = [x if x[:1].isalpha() else _LINE_MARK.sub(r"\\\1", _LINE_NUMBER.sub(r"\1\\\2", x)) for x in lines]
        tail = [f"Figure: {self.inline(i['caption'])}{_label(i)}" for i in n["children"] if i["type"] == "Image" and i["caption"]]
        return "\n\n".join(["\n".join(lines), *tail])

    def heading(self, n: Node) -> str:
        return f"{'#' * n['level']} {self.inline(n['children'])}".rstrip()

    def codeblock(self, n: Node) -> str:
        fence = "`" * max(3, max([0, *map(len, re.findall("`+", n["code"]))]) + 1)
        return f"{fence}{n['language'] or ''}\n{n['code']}\n{fence}"

    def blockquote(self, n: Node) -> str:
        inner = self.blocks(n["children"])
        head = f"[!{n['alert_type'].upper()}]\n" if n.get("alert_type") else ""
        return "\n".join(f"> {x}".rstrip() for x in (head + inner).split("\n"))

    def abstract(self, n: Node) -> str:
        lines = ["[!IMPORTANT]", "**Abstract**  ", *self.blocks(n["children"]).split("\n")]
        return "\n".join(f"> {x}" if x.strip() else ">" for x in lines)

    def horizontalrule(self, n: Node) -> str:
        return "---"

    def listblock(self, n: Node) -> str:
        """Blocks after an item's first line are indented by four; paragraphs among them set the items apart."""
        out = []
        loose = any(b["type"] == "Paragraph" for i in n["items"] for b in i["children"][1:])
        for k, item in enumerate(n["items"]):
            mark = f"{n['start'] + k}." if n["ordered"] else "-"
            mark += "" if item["checked"] is None else f" [{'x' if item['checked'] else ' '}]"
            parts = []
            for j, b in enumerate(item["children"]):
                if (made := self.blocks([b])).strip():
                    first = j == 0 and b["type"] == "Paragraph"
                    body = made if first else "\n".join(f"    {x}" if x.strip() else "" for x in made.split("\n"))
                    parts.append("\n" * (j > 0 and b["type"] == "Paragraph") + body)
            out.append(f"{mark} {'\n'.join(parts).strip()}")
        return ("\n\n" if loose else "\n").join(out)

    def table(self, n: Node) -> str:
        head, rows = table_grid(n)
        width = len(head or (rows[0] if rows else []))
        if not width:
            return ""

        def cell(c: Node) -> str:
            s = self.inline(c["children"])
            if "\n" in s:
                s = s.replace("  \n", "<br>").replace("\n", "<br>")
            if "  " in s or "\t" in s:
                s = _CELL_SPACES.sub(" ", s)
            return s.replace("|", "\\|").strip()

        line = lambda cells: "| " + " | ".join(cells) + " |"
        lines = [line([cell(c) for c in head] or [""] * width), "|" + "|".join(["---"] * width) + "|", *(line([cell(c) for c in r]) for r in rows)]
        caption = [f"Table: {self.inline(n['caption'])}{_label(n)}"] if n["caption"] or n["label"] else []
        return "\n\n".join([*caption, "\n".join(lines)])


def _label(n: Node) -> str:
    return f" \\label{{{n['label']}}}" if n.get("label") else ""


_HTML_MARKS = re.compile("[&<>\"']")


def _escape_html(s: str, quote: bool = True) -> str:
    return _html.escape(s, quote) if _HTML_MARKS.search(s) else s


class Html(Renderer):
    """A page, or a part of one."""

    def mark(self, number: int) -> str:
        return f'<sup class="footnote-ref">[{number}]</sup>'

    def document(self, n: Node) -> str:
        title = self.inline(n["title"]) or next((self.inline(h["children"]) for h in n["children"] if h["type"] == "Heading"), "Document")
        plain = re.sub(r"<[^>]*>", "", title)
        head = "".join(f'<{t} class="{c}">{self.inline(n[k])}</{t}>\n' for k, t, c in (("title", "h1", "title"), ("author", "p", "author"), ("date", "p", "date")) if n[k])
        body = self.blocks(n["children"], "\n")
        notes = "".join(f"<li>{t}</li>\n" for t in self.note_texts())
        notes = f'\n<ol class="footnotes">\n{notes}</ol>' if notes else ""
        return f'<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8">\n<title>{plain}</title>\n</head>\n<body>\n{head}{body}{notes}\n</body>\n</html>\n'

    def text(self, n: Node) -> str:
        out = _escape_html(n["content"]).replace("\n", "<br />\n")
        if n["italic"]:
            out = f"<i>{out}</i>"
        if n["bold"]:
            out = f"<b>{out}</b>"
        if n["strikethrough"]:
            out = f"<s>{out}</s>"
        return f"<{n['script']}>{out}</{n['script']}>" if n["script"] else out

    def link(self, n: Node) -> str:
        title = f' title="{_escape_html(n["title"])}"' if n["title"] else ""
        return f'<a href="{_escape_html(n["url"])}"{title}>{self.inline(n["content"])}</a>'

    def image(self, n: Node) -> str:
        title = f' title="{_escape_html(n["title"])}"' if n["title"] else ""
        label = f' data-label="{_escape_html(n["label"])}"' if n["label"] else ""
        made = f'<img src="{_escape_html(n["src"])}" alt="{_escape_html(n["alt"])}"{title} />'
        caption = f"<figcaption>{self.inline(n['caption'])}</figcaption>\n" if n["caption"] else ""
        return f"<figure{label}>\n{made}\n{caption}</figure>" if caption or label else made

    def codeinline(self, n: Node) -> str:
        return f"<code>{_escape_html(n['code'])}</code>"

    def linebreak(self, n: Node) -> str:
        return "<br />\n"

    def equation(self, n: Node) -> str:
        code = _escape_html(n["code"])
        if n["inline"]:
            return f'<span class="math inline">\\({code}\\)</span>'
        begin, end = (f"\\begin{{{n['env']}}}", f"\\end{{{n['env']}}}") if n["env"] else ("$$", "$$")
        return f'<div class="math block">{begin}\n{code}\n{end}</div>'

    def citation(self, n: Node) -> str:
        return _escape_html(macro(n), quote=False)

    reference = label = citation

    def paragraph(self, n: Node) -> str:
        """Display formulas and figures, which ``<p>`` cannot hold, stand between its parts."""
        out: list[str] = []
        run: list[Node] = []
        apart = lambda c: c["type"] == "Equation" and not c["inline"] or c["type"] == "Image" and (c["caption"] or c["label"])
        for c in [*n["children"], None]:
            if c is not None and not apart(c):
                run.append(c)
                continue
            if (made := self.inline(run)).strip():
                out.append(f"<p>{made}</p>")
            run = []
            out += [self.inline([c])] if c is not None else []
        return "\n".join(out)

    def heading(self, n: Node) -> str:
        return f"<h{n['level']}>{self.inline(n['children'])}</h{n['level']}>"

    def codeblock(self, n: Node) -> str:
        cls = f' class="language-{_escape_html(n["language"])}"' if n["language"] else ""
        return f"<pre><code{cls}>{_escape_html(n['code'])}</code></pre>"

    def blockquote(self, n: Node) -> str:
        cls = f' class="alert alert-{n["alert_type"].lower()}"' if n["alert_type"] else ""
        title = f'<div class="alert-title">{n["alert_type"].upper()}</div>\n' if n["alert_type"] else ""
        return f"<blockquote{cls}>\n{title}{self.blocks(n['children'], chr(10))}\n</blockquote>"

    def abstract(self, n: Node) -> str:
        return f'<blockquote class="alert-important">\n<div class="alert-title">Abstract</div>\n{self.blocks(n["children"], chr(10))}\n</blockquote>'

    def horizontalrule(self, n: Node) -> str:
        return "<hr />"

    def listblock(self, n: Node) -> str:
        tag = "ol" if n["ordered"] else "ul"
        start = f' start="{n["start"]}"' if n["ordered"] and n["start"] != 1 else ""
        items = []
        for i in n["items"]:
            box = "" if i["checked"] is None else f'<input type="checkbox" disabled{" checked" if i["checked"] else ""} /> '
            inner = self.inline(i["children"][0]["children"]) if len(i["children"]) == 1 and i["children"][0]["type"] == "Paragraph" else self.blocks(i["children"], "")
            items.append(f"<li>{box}{inner}</li>")
        return f"<{tag}{start}>\n" + "\n".join(items) + f"\n</{tag}>"

    def table(self, n: Node) -> str:
        head, rows = table_grid(n)
        line = lambda cells, t: "<tr>\n" + "\n".join(f"<{t}>{self.inline(c['children'])}</{t}>" for c in cells) + "\n</tr>"
        parts = [f"<caption>{self.inline(n['caption'])}</caption>"] if n["caption"] else []
        parts += [f"<thead>{line(head, 'th')}</thead>"] if head else []
        parts += ["<tbody>\n" + "\n".join(line(r, "td") for r in rows) + "\n</tbody>"] if rows else []
        label = f' data-label="{_escape_html(n["label"])}"' if n["label"] else ""
        return f"<table{label}>\n" + "\n".join(parts) + "\n</table>"


# Characters that LaTeX reads as commands, and how they are written.
LATEX_ESCAPES = {
    "\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "$": r"\$", "&": r"\&", "#": r"\#", "%": r"\%", "_": r"\_", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}",
    "“": "``", "”": "''", "\u00a0": "~",
}
_SECTIONS = ("chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph")


def escape_latex(s: str) -> str:
    """Text as LaTeX reads it back."""
    return "".join(LATEX_ESCAPES.get(c, c) for c in s)


class Latex(Renderer):
    """An article, or a report if the document's root is a chapter."""

    def document(self, n: Node) -> str:
        self.root = 0 if n["section_root"] else 1
        body = self.blocks(n["children"])
        kinds = {d["type"] for d in walk(n)}
        packages = [p for p, k in (("amsmath", "Equation"), ("graphicx", "Image"), ("hyperref", "Link")) if k in kinds]
        if any(d["type"] == "Text" and d["strikethrough"] for d in walk(n)):
            packages.append("ulem")
        if any(d["type"] == "ListItem" and d["checked"] is not None for d in walk(n)):
            packages.append("amssymb")
        head = [f"\\documentclass{{{'report' if n['section_root'] else 'article'}}}", "\\usepackage[utf8]{inputenc}", *(f"\\usepackage{{{p}}}" for p in packages)]
        head += [f"\\{k}{{{self.inline(n[k])}}}" for k in ("title", "author", "date") if n[k]]
        start = ["\\maketitle"] if n["title"] else []
        return "\n".join([*head, "", "\\begin{document}", *start, "", body, "", "\\end{document}", ""])

    def text(self, n: Node) -> str:
        before, core, after = spaces_apart(n["content"])
        out = escape_latex(core)
        for flag, name in ((n["script"] == "sup", "textsuperscript"), (n["script"] == "sub", "textsubscript"), (n["italic"], "textit"), (n["bold"], "textbf"), (n["strikethrough"], "sout")):
            out = f"\\{name}{{{out}}}" if flag and core else out
        return before + out + after

    def link(self, n: Node) -> str:
        url = re.sub(r"[\\{}^]", lambda m: f"%{ord(m[0]):02X}", n["url"]).replace("%", r"\%").replace("#", r"\#")
        inner = self.inline(n["content"])
        return f"\\url{{{url}}}" if n["content"] and n["content"][0].get("content") == n["url"] else f"\\href{{{url}}}{{{inner}}}"

    def image(self, n: Node) -> str:
        made = f"\\includegraphics[width=\\linewidth]{{{n['src']}}}"
        label = f"\\label{{{n['label']}}}" if n["label"] else ""
        return f"\\begin{{figure}}\n\\centering\n{made}\n\\caption{{{self.inline(n['caption'])}}}{label}\n\\end{{figure}}" if n["caption"] or label else made

    def codeinline(self, n: Node) -> str:
        return f"\\texttt{{{escape_latex(n['code'])}}}"

    def linebreak(self, n: Node) -> str:
        return " \\and " if n["author_separator"] else "\\\\\n"

    def footnote(self, n: Node) -> str:
        return f"\\footnote{{{self.inline(n['content'])}}}"

    def equation(self, n: Node) -> str:
        if n["inline"]:
            return f"${n['code']}$"
        env = n["env"] or ("align*" if re.search(r"(?<!\\)&|\\\\", re.sub(r"\\begin\{(\w+\*?)\}.*?\\end\{\1\}", "", n["code"], flags=re.S)) else "equation*")
        return f"\\begin{{{env}}}\n{n['code']}\n\\end{{{env}}}"

    def paragraph(self, n: Node) -> str:
        return self.inline(n["children"])

    def heading(self, n: Node) -> str:
        name = _SECTIONS[min(n["level"] - 1 + self.root, 5)]
        return f"\\{name}{'' if n['numbered'] else '*'}{{{self.inline(n['children'])}}}"

    def codeblock(self, n: Node) -> str:
        note = f"% language: {n['language']}\n" if n["language"] else ""
        return f"{note}\\begin{{verbatim}}\n{n['code']}\n\\end{{verbatim}}"

    def blockquote(self, n: Node) -> str:
        return f"\\begin{{quote}}\n{self.blocks(n['children'])}\n\\end{{quote}}"

    def abstract(self, n: Node) -> str:
        return f"\\begin{{abstract}}\n{self.blocks(n['children'])}\n\\end{{abstract}}"

    def horizontalrule(self, n: Node) -> str:
        return "\\noindent\\rule{\\linewidth}{0.4pt}"

    def appendix(self, n: Node) -> str:
        return "\\appendix"

    def listblock(self, n: Node) -> str:
        env = "enumerate" if n["ordered"] else "itemize"
        counter = f"\n\\setcounter{{enumi}}{{{n['start'] - 1}}}" if n["ordered"] and n["start"] != 1 else ""
        items = [f"\\item{'' if i['checked'] is None else '[$' + ('\\boxtimes' if i['checked'] else '\\square') + '$]'} {self.blocks(i['children'])}" for i in n["items"]]
        return f"\\begin{{{env}}}{counter}\n" + "\n".join(items) + f"\n\\end{{{env}}}"

    def table(self, n: Node) -> str:
        head, rows = table_grid(n)
        width = len(head or (rows[0] if rows else []))
        if not width:
            return ""
        line = lambda cells: " & ".join(self.inline(c["children"]).replace("\\\\\n", " ") for c in cells) + " \\\\"
        lines = ["\\hline", *([line(head), "\\hline"] if head else []), *map(line, rows), "\\hline"]
        made = f"\\begin{{tabular}}{{{'l' * width}}}\n" + "\n".join(lines) + "\n\\end{tabular}"
        if not (n["caption"] or n["label"]):
            return made
        label = f"\\label{{{n['label']}}}" if n["label"] else ""
        return f"\\begin{{table}}\n\\centering\n\\caption{{{self.inline(n['caption'])}}}{label}\n{made}\n\\end{{table}}"

    def bibliography(self, n: Node) -> str:
        entries = [f"\\bibitem{f'[{e["label"]}]' if e['label'] else ''}{{{e['key']}}} {self.inline(e['children'])}" for e in n["entries"]]
        return "\n".join([*n["commands"], *([f"\\begin{{thebibliography}}{{{n['widest']}}}", *entries, "\\end{thebibliography}"] if entries else [])])


class Plain(Renderer):
    """Plain text with underlined headings and grid tables."""

    def document(self, n: Node) -> str:
        title = self.inline(n["title"])
        rule = "=" * max(3, display_width(title))
        parts = ["\n".join([*([rule, title, rule] if title else []), *(f"{k.title()}: {self.inline(n[k])}" for k in ("author", "date") if n[k])])]
        parts.append(self.blocks(n["children"]))
        parts += [f"[{i}] {t}" for i, t in enumerate(self.note_texts(), 1)]
        body = "\n\n".join(p for p in parts if p)
        return f"{body}\n" if body else ""

    def text(self, n: Node) -> str:
        return n["content"]

    def link(self, n: Node) -> str:
        inner = self.inline(n["content"])
        if not inner.strip() or inner == n["url"]:
            return n["url"]
        return inner if not n["url"] or n["url"] in (f"mailto:{inner}", f"http://{inner}", f"https://{inner}") else f"{inner} ({n['url']})"

    def image(self, n: Node) -> str:
        return n["description"] or n["extracted_text"] or ""

    def codeinline(self, n: Node) -> str:
        return n["code"]

    def linebreak(self, n: Node) -> str:
        return "\n"

    def equation(self, n: Node) -> str:
        if n["inline"]:
            return f"${n['code']}$"
        code = f"\\begin{{{n['env']}}}\n{n['code']}\n\\end{{{n['env']}}}" if n["env"] else n["code"]
        return f"$$\n{code}\n$$"

    def paragraph(self, n: Node) -> str:
        tail = [f"Figure: {self.inline(i['caption'])}" for i in n["children"] if i["type"] == "Image" and i["caption"]]
        return "\n\n".join(p for p in [self.inline(n["children"]), *tail] if p)

    def heading(self, n: Node) -> str:
        title = self.inline(n["children"]).replace("\n", " ")
        return f"{title}\n{UNDERLINES[n['level'] - 1] * max(3, display_width(title))}"

    def codeblock(self, n: Node) -> str:
        return "\n".join(f"    {x}".rstrip() for x in n["code"].split("\n"))

    def blockquote(self, n: Node) -> str:
        head = f"[!{n['alert_type'].upper()}]\n" if n.get("alert_type") else ""
        return "\n".join(f"> {x}".rstrip() for x in (head + self.blocks(n["children"])).split("\n"))

    def abstract(self, n: Node) -> str:
        gap = "\n" if n["children"] and n["children"][0]["type"] == "Paragraph" else "\n\n"
        return "\n".join(f"> {x}".rstrip() for x in f"Abstract:{gap}{self.blocks(n['children'])}".split("\n"))

    def horizontalrule(self, n: Node) -> str:
        return "---"

    def listblock(self, n: Node) -> str:
        out = []
        for k, item in enumerate(n["items"]):
            mark = f"{n['start'] + k}. " if n["ordered"] else "- "
            task = "" if item["checked"] is None else f"[{'x' if item['checked'] else ' '}] "
            body = task + self.blocks(item["children"], "\n")
            out.append(mark + "\n".join(x if i == 0 or not x else " " * len(mark) + x for i, x in enumerate(body.split("\n"))))
        return "\n".join(out)

    def table(self, n: Node) -> str:
        head, rows = table_grid(n)
        grid = [[self.inline(c["children"]).split("\n") for c in r] for r in ([head] if head else []) + rows]
        if not grid:
            return ""
        widths = [max(1, *(display_width(x) for r in grid for x in r[k])) for k in range(len(grid[0]))]
        border = lambda c: "+" + "+".join(c * (w + 2) for w in widths) + "+"
        lines = [border("-")]
        for k, r in enumerate(grid):
            for at in range(max(map(len, r))):
                cells = [c[at] if at < len(c) else "" for c in r]
                lines.append("|" + "|".join(f" {x}{' ' * (w - display_width(x))} " for x, w in zip(cells, widths, strict=True)) + "|")
            lines.append(border("=" if head and k == 0 else "-"))
        caption = [f"Table: {self.inline(n['caption'])}"] if n["caption"] else []
        return "\n\n".join([*caption, "\n".join(lines)])


class _Cell(Plain):
    """The text of a spreadsheet cell: notes are left out."""

    def footnote(self, n: Node) -> str:
        return ""

    def link(self, n: Node) -> str:
        return self.inline(n["content"])


def render_csv(tree: Node) -> str:
    """The first table, CRLF, quoted where needed; an error without one."""
    tables = [n for n in walk(tree) if n["type"] == "Table"]
    if not tables:
        raise ValueError("the document has no table to write as CSV")
    return csv_of(tables[0])


def csv_of(table: Node) -> str:
    """One table as CSV."""
    head, rows = table_grid(table)
    out = io.StringIO(newline="")
    cells = _Cell()
    csv.writer(out, lineterminator="\r\n").writerows([[cells.inline(c["children"]) for c in r] for r in ([head] if head else []) + rows])
    return out.getvalue()


def render_json(tree: Node) -> str:
    """Every field with its type first."""
    return json.dumps(tree, ensure_ascii=False, indent=2)


# Schemes that a rendered link must not have.
UNSAFE_SCHEMES = ("javascript", "vbscript", "data")


def is_unsafe(url: str) -> bool:
    """Whether a browser, which drops tabs, line ends and leading control characters, reads an unsafe scheme."""
    scheme, colon, _ = re.sub(r"[\t\n\r]", "", url).lstrip("".join(map(chr, range(33)))).partition(":")
    return bool(colon) and scheme.lower() in UNSAFE_SCHEMES


def neutralize_links(tree: Node) -> int:
    """Links of unsafe schemes point nowhere; returns how many."""
    unsafe = [n for n in walk(tree) if n["type"] == "Link" and is_unsafe(n["url"])]
    for n in unsafe:
        n["url"] = "#"
    return len(unsafe)


def discard_links(tree: Node) -> None:
    """Links become their content."""
    for n in list(walk(tree)):
        for _, children in child_slots(n):
            while any(c["type"] == "Link" for c in children):
                children[:] = [x for c in children for x in (c["content"] if c["type"] == "Link" else [c])]


def remove_images(tree: Node) -> None:
    """Images go, then links left empty."""
    for n in list(walk(tree)):
        for _, children in child_slots(n):
            children[:] = [c for c in children if c["type"] != "Image"]
    for n in list(walk(tree)):
        for _, children in child_slots(n):
            children[:] = [c for c in children if c["type"] != "Link" or c["content"]]


def is_remote(src: str) -> bool:
    """Whether an address is on the web."""
    return src.startswith("//") or urlparse(src).scheme in ("http", "https")


RENDERERS = {
    "markdown": lambda t: Markdown().document(t),
    "html": lambda t: Html().document(t),
    "latex": lambda t: Latex().document(t),
    "text": lambda t: Plain().document(t),
    "csv": render_csv,
    "json": render_json,
}
