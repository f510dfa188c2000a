"""A subset of LaTeX, read and not typeset, to a node tree."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from ..schema import Node, copied, node, paragraph, text
from .inline import CITATIONS, REFERENCES, REMEMBERED, SHORT

# Limits of macro expansion, display environments, symbols, accents, sectioning commands.
DEEPEST, GROWTH, SLACK = 16, 100, 1_000_000
MATH = frozenset("equation equation* align align* gather gather* multline multline* eqnarray eqnarray* displaymath math alignat alignat* flalign flalign*".split())
VERBATIM = ("verbatim", "lstlisting", "minted", "Verbatim", "verbatim*")
LEVELS = ("part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph")
SYMBOLS = {
    "ldots": "…", "dots": "…", "textellipsis": "…", "textbackslash": "\\", "textasciitilde": "~", "textasciicircum": "^", "textbar": "|", "textless": "<", "textgreater": ">",
    "textendash": "–", "textemdash": "—", "textquoteright": "’", "textquoteleft": "‘", "textquotedblleft": "“", "textquotedblright": "”", "S": "§", "P": "¶", "copyright": "©",
    "textregistered": "®", "texttrademark": "™", "pounds": "£", "euro": "€", "textdegree": "°", "dag": "†", "ddag": "‡", "ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ",
    "o": "ø", "O": "Ø", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł", "i": "ı", "LaTeX": "LaTeX", "TeX": "TeX", "quad": " ", "qquad": " ", "today": "",
}
ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "k": "\u0328", "r": "\u030a"}
_STYLE = {"textbf": {"bold": True}, "textit": {"italic": True}, "emph": {"italic": True}, "textsl": {"italic": True}, "sout": {"strikethrough": True}, "st": {"strikethrough": True}, "textsuperscript": {"script": "sup"}, "textsubscript": {"script": "sub"}}
_DECLARED = {"bfseries": {"bold": True}, "bf": {"bold": True}, "itshape": {"italic": True}, "it": {"italic": True}, "em": {"italic": True}}
_PASS = frozenset("textrm textsf textsc underline mbox text textnormal uppercase footnotesize small".split())
_IGNORED_ONE = frozenset("vspace hspace vspace* hspace* pagestyle thispagestyle bibliographystyle usepackage documentclass input include setlength addtolength setcounter linespread graphicspath".split())

_BRACKETS = {"{": re.compile(r"\\.|[{}]", re.S), "[": re.compile(r"\\.|[\[\]]", re.S)}
_SPACE = re.compile(r"\s*")
_CONTROL = re.compile(r"\\([A-Za-z]+|.)", re.S)
_COMMAND = re.compile(r"\\([A-Za-z]+\*?|.|$)", re.S)
_AFTER_BREAK = re.compile(r"\*?(\s*\[[^\]]*\])?")
_AFTER_SYMBOL = re.compile(r"\{\}|[ \t]*(?=\S)?")
_BLANKS = re.compile(r"[ \t]*")
_MARK = re.compile(r"\x02(\d+)\x03")
_PLAIN = re.compile(r"[^\\{}$\x02]+")
_PARAGRAPH_END = re.compile(r"\n[ \t]*\n\s*|\\par(?![A-Za-z])")
_BLOCK = re.compile(
    r"\\begin\{([A-Za-z]+\*?)\}|\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph)(\*?)(?=\s*[\[{])|\\\[|\$\$|\x02(\d+)\x03|\\(appendix|maketitle|tableofcontents|hrule|newpage|clearpage|noindent|centering|bigskip|medskip|smallskip)(?![A-Za-z])|\\bibitem"
)
_LIST_PIECE = re.compile(r"(\\begin\{[^{}]*\}|\\end\{[^{}]*\}|\\item(?![A-Za-z]))")
_COUNTER = re.compile(r"\\setcounter\{enumi+\}\{(\d+)\}")
_LABEL = re.compile(r"\\label\{([^{}]*)\}")
_RULES = re.compile(r"\\(?:toprule|midrule|bottomrule|endfirsthead|endfoot|endlastfoot|centering)(?![A-Za-z])|\\(?:cline|cmidrule)(?:\([^)]*\))?\{[^{}]*\}")
_END_HEAD = re.compile(r"\\endhead(?![A-Za-z])")
_HLINE = re.compile(r"\\hline(?![A-Za-z])")
_ROW_SPACE = re.compile(r"^\s*\[[^\]]*\]")
_MULTICOLUMN = re.compile(r"\s*\\multicolumn\{(\d{1,3})\}")
_MULTIROW = re.compile(r"\s*\\multirow")
_SPLIT = re.compile(r"\\begin\{|\\end\{|\\.|[{}&]", re.S)
_ODD_SPACE = re.compile(r"[^\S \u00a0]|\s\s")
_SPACES = re.compile(r"\s+")
_AFTER_PERCENT = re.compile(r"[^\n]*(\n[ \t]*)?")
_META = {name: re.compile(rf"\\{name}\s*\{{") for name in ("title", "author", "date")}
_LEVEL = re.compile(rf"\\({'|'.join(LEVELS)})\*?\s*[\[{{]")
_DEFINITION = re.compile(r"\\(?:(?:re|provide)?newcommand|providecommand|DeclareMathOperator|def)\*?\s*(?:\{\s*\\([A-Za-z]+)\s*\}|\\([A-Za-z]+))")
_DEF_PARAMETERS, _PARAMETERS = re.compile(r"(?:#\d)*"), re.compile(r"\s*\[(\d)\]")
_CODE = re.compile(
    rf"\\begin\{{(?P<env>{'|'.join(map(re.escape, VERBATIM))})\}}(?P<opts>\[[^\]]*\])?(?:(?<=minted\}})\{{(?P<arg>[^{{}}]*)\}}|(?<=\])\{{(?P<arg2>[^{{}}]*)\}})?(?P<body>.*?)\\end\{{(?P=env)\}}", re.S
)
_SHORT_CODE = re.compile(r"\\(?:verb\*?|lstinline(?:\[[^\]]*\])?)([^A-Za-z\s*{\[])(.*?)\1")


def group(source: str, at: int, opening: str = "{", closing: str = "}") -> int:
    """The place after the group that opens at ``at``; the end of the source if it is open."""
    depth = 0
    for m in _BRACKETS[opening].finditer(source, at):
        c = m[0]
        if c == opening:
            depth += 1
        elif c == closing:
            depth -= 1
            if not depth:
                return m.end()
    return len(source)


def arguments(source: str, at: int, count: int, optional: int = 1) -> tuple[list[str], list[str], int]:
    """Optional and required arguments from ``at`` on."""
    options: list[str] = []
    required: list[str] = []
    while len(required) < count or optional and len(options) < optional and not required:
        i = _SPACE.match(source, at).end()
        if i < len(source) and source[i] == "[" and len(options) < optional and not required:
            end = group(source, i, "[", "]")
            options.append(source[i + 1 : end - 1])
        elif len(required) < count and i < len(source) and source[i] == "{":
            end = group(source, i)
            required.append(source[i + 1 : end - 1])
        elif len(required) < count and i < len(source) and not source[i].isspace() and source[i] not in "[]":
            end = i + 1 if source[i] != "\\" else _CONTROL.match(source, i).end()
            required.append(source[i:end])
        else:
            break
        at = end
    return options, required + [""] * (count - len(required)), at


def _hide_code(source: str, hidden: list[Node]) -> str:
    """Code becomes marks, so that nothing in it is read."""

    def block(m: re.Match) -> str:
        options = m["opts"] or ""
        language = (re.search(r"language=(?:\{)?(\w+)", options) or [None, None])[1]
        if m["env"] == "minted":
            language = m["arg"] or language
        hidden.append(node("CodeBlock", code=m["body"].strip("\n"), language=language))
        return f"\x02{len(hidden) - 1}\x03"

    source = _CODE.sub(block, source)

    def short(m: re.Match) -> str:
        hidden.append(node("CodeInline", code=m[2]))
        return f"\x02{len(hidden) - 1}\x03"

    return _SHORT_CODE.sub(short, source)


_CONDITIONAL = re.compile(r"\\(?:(?P<begin>if(?!thenelse|def)[A-Za-z@]*)|(?P<other>else)|(?P<end>fi))(?![A-Za-z@])")


def _without_false(source: str) -> str:
    """A text without what ``\\iffalse`` hides, up to its own ``\\else`` or ``\\fi``; conditionals inside count.

    One that is never closed hides all up to the end of the document.
    """
    if "\\iffalse" not in source:
        return source
    out, at = [], 0
    open_ifs: list[str] = []  # plain, hidden (an \\iffalse), inner (inside a hidden one), shown (the \\else of a hidden one)
    for m in _CONDITIONAL.finditer(source):
        if m["begin"] and "hidden" in open_ifs:
            open_ifs.append("inner")
        elif m["begin"] == "iffalse":
            out.append(source[at : m.start()])
            open_ifs.append("hidden")
        elif m["begin"]:
            open_ifs.append("plain")
        elif open_ifs and m["other"] and open_ifs[-1] == "hidden":
            open_ifs[-1], at = "shown", m.end()
        elif open_ifs and m["end"]:
            last = open_ifs.pop()
            if last == "shown":
                out.append(source[at : m.start()])
            if last in ("shown", "hidden"):
                at = m.end()
    if "hidden" in open_ifs:
        end = source.find("\\end{document}", at)
        return "".join(out) + (source[end:] if end >= 0 else "")
    return "".join([*out, source[at:]])


def _without_comments(source: str) -> str:
    source = re.sub(r"\\begin\{comment\}.*?\\end\{comment\}", "", source, flags=re.S)
    source = _without_false(source)
    out, at, i = [], 0, source.find("%")
    while i >= 0:
        before = i
        while before and source[before - 1] == "\\":
            before -= 1
        if (i - before) % 2:  # an escaped one
            i = source.find("%", i + 1)
            continue
        out.append(source[at:i])
        at = _AFTER_PERCENT.match(source, i).end()
        i = source.find("%", at)
    return "".join([*out, source[at:]])


def _expanded(source: str) -> str:
    """User macros applied, to a bounded depth and size."""
    macros: dict[str, tuple[int, str | None, str]] = {}
    out, at = [], 0
    while m := _DEFINITION.search(source, at):
        out.append(source[at : m.start()])
        name, i = m[1] or m[2], m.end()
        count, default = 0, None
        if "\\def" in m[0]:
            params = _DEF_PARAMETERS.match(source, i)
            count, i = params[0].count("#"), params.end()
        elif n := _PARAMETERS.match(source, i):
            count, i = int(n[1]), n.end()
            if i < len(source) and source[i] == "[":
                end = group(source, i, "[", "]")
                default, i = source[i + 1 : end - 1], end
        _, body, i = arguments(source, i, 1, 0)
        macros[name] = (count, default, f"\\operatorname{{{body[0]}}}" if "Operator" in m[0] else body[0])
        at = i
    source = "".join([*out, source[at:]])
    if not macros:
        return source
    use = re.compile(r"\\(" + "|".join(sorted(map(re.escape, macros), key=len, reverse=True)) + r")(?![A-Za-z])")
    limit = GROWTH * len(source) + SLACK
    for _ in range(DEEPEST):
        out, at, changed = [], 0, False
        while m := use.search(source, at):
            count, default, body = macros[m[1]]
            options, required, end = arguments(source, m.end(), count - (default is not None), int(default is not None)) if count else ([], [], m.end())
            values = ([options[0] if options else default] if default is not None else []) + required
            out += [source[at : m.start()], re.sub(r"#(\d)", lambda k: values[int(k[1]) - 1] if int(k[1]) <= len(values) else "", body)]  # noqa: B023
            at, changed = end, True
        source = "".join([*out, source[at:]])
        if not changed or len(source) > limit:
            break
    return source


class _Latex:
    def __init__(self, hidden: list[Node]):
        self.hidden, self.top = hidden, 0

    def blocks(self, source: str) -> list[Node]:
        """Blocks of a stretch of LaTeX."""
        out: list[Node] = []
        buffer = ""

        def flush() -> None:
            nonlocal buffer
            for part in _PARAGRAPH_END.split(buffer):
                children = _tidy(self.inline(part.strip()))
                if children:
                    out.append(paragraph(*children))
            buffer = ""

        at = 0
        while m := _BLOCK.search(source, at):
            buffer += source[at : m.start()]
            at = m.end()
            if m[0] == "\\[" or m[0] == "$$":
                end = source.find("\\]" if m[0] == "\\[" else "$$", at)
                end = len(source) if end < 0 else end
                flush()
                out.append(node("Equation", code=source[at:end].strip()))
                at = end + 2
            elif m[2]:
                options, required, at = arguments(source, at, 1)
                flush()
                level = LEVELS.index(m[2]) - self.top + 1
                out.append(node("Heading", level=max(1, min(6, level)), children=_tidy(self.inline(required[0])), numbered=not m[3]))
            elif m[4]:
                code = self.hidden[int(m[4])]
                if code["type"] == "CodeInline":
                    buffer += m[0]
                else:
                    flush()
                    out.append(code)
            elif m[5]:
                flush()
                out += [node("Appendix")] if m[5] == "appendix" else [node("HorizontalRule")] if m[5] == "hrule" else []
            elif m[0] == "\\bibitem":
                at = len(source)
            else:
                name = m[1]
                end = self.end_of(source, at, name)
                body = source[at:end]
                at = min(len(source), end + len(f"\\end{{{name}}}"))
                if name in ("math",):
                    buffer += f"${body.strip()}$"
                    continue
                flush()
                out += self.environment(name, body)
        buffer += source[at:]
        flush()
        return out

    def inside(self, source: str) -> list[Node]:
        """Blocks inside an item, a quote or an abstract."""
        if len(source) <= SHORT and "\x02" not in source:  # no code, so the same in any document of these sections
            return copied(_remembered_blocks(source, self.top))
        return self.blocks(source)

    def end_of(self, source: str, at: int, name: str) -> int:
        depth = 1
        for m in re.compile(rf"\\(begin|end)\{{{re.escape(name)}\}}").finditer(source, at):
            depth += 1 if m[1] == "begin" else -1
            if not depth:
                return m.start()
        return len(source)

    def environment(self, name: str, body: str) -> list[Node]:
        if name in MATH:
            label = _LABEL.search(body)
            env = None if name in ("displaymath", "equation", "equation*") else name
            made = node("Equation", code=_LABEL.sub("", body).strip(), env=env)
            return [made, *([paragraph(node("Label", name=label[1]))] if label else [])]
        if name in ("itemize", "enumerate", "description"):
            return self.list(name, body)
        if name in ("tabular", "tabular*", "tabularx", "longtable", "array"):
            return [self.table(name, body)]
        if name in ("figure", "figure*", "table", "table*", "wrapfigure", "SCfigure", "subfigure"):
            return self.floating(body)
        if name == "abstract":
            return [node("Abstract", children=self.inside(body))]
        if name in ("quote", "quotation", "verse"):
            return [node("BlockQuote", children=self.inside(body))]
        if name == "thebibliography":
            _, (widest,), at = arguments(body, 0, 1, 0)
            entries = []
            for part in re.split(r"\\bibitem(?![A-Za-z])", body[at:])[1:]:
                options, (key,), end = arguments(part, 0, 1)
                entries.append(node("BibEntry", key=key, children=_tidy(self.inline(part[end:].strip())), label=options[0] if options else None))
            return [node("Bibliography", entries=entries, widest=widest or "9")]
        if name == "keywords":
            return [paragraph(text("Keywords: ", bold=True), *_tidy(self.inline(body.strip())))]
        if name in ("theorem", "lemma", "proposition", "corollary", "definition", "proof", "remark", "example"):
            options, _, at = arguments(body, 0, 0)
            title = name.capitalize() + (f" ({options[0]})" if options else "") + "."
            inner = self.blocks(body[at:])
            if inner and inner[0]["type"] == "Paragraph":
                inner[0]["children"] = [text(f"{title} ", bold=True), *inner[0]["children"]]
                return inner
            return [paragraph(text(title, bold=True)), *inner]
        return self.blocks(re.sub(r"^\s*(\[[^\]]*\]|\{[^{}]*\})+", "", body) if name in ("minipage", "multicols", "columns", "column") else body)

    def list(self, name: str, body: str) -> list[Node]:
        parts: list[str] = []
        depth = 0
        for piece in _LIST_PIECE.split(body):
            depth += piece.startswith("\\begin") - piece.startswith("\\end")
            if piece == "\\item" and not depth:
                parts.append("")
            elif parts:
                parts[-1] += piece
        items = []
        start = _COUNTER.search(body)
        for p in parts:
            options, _, at = arguments(p, 0, 0)
            checked = {"$\\square$": False, "$\\boxtimes$": True}.get(options[0].strip()) if options else None
            inner = self.inside(p[at:])
            if options and checked is None:
                head = _tidy(self.inline(options[0]))
                for h in head:
                    h["bold"] = True if h["type"] == "Text" else h.get("bold")
                if inner and inner[0]["type"] == "Paragraph":
                    inner[0]["children"] = [*head, text(" "), *inner[0]["children"]]
                else:
                    inner = [paragraph(*head), *inner]
            items.append(node("ListItem", children=inner, checked=checked))
        return [node("ListBlock", ordered=name == "enumerate", items=items, start=int(start[1]) + 1 if start else 1)] if items else []

    def table(self, name: str, body: str) -> Node:
        _, _, at = arguments(body, 0, 2 if name in ("tabular*", "tabularx") else 1)
        body = _RULES.sub("", body[at:])
        head_end = _END_HEAD.search(body)
        caption = re.search(r"\\caption\{", body)
        made_caption: list[Node] = []
        if caption:
            end = group(body, caption.end() - 1)
            made_caption = _tidy(self.inline(body[caption.end() : end - 1]))
            body = body[: caption.start()] + body[end:]
        rows: list[tuple[list[Node], int]] = []
        rules = 0
        first_rule = None
        for k, line in enumerate(_split(_END_HEAD.sub("", body), "\\\\")):
            rules = len(_HLINE.findall(line))
            line = _HLINE.sub("", _ROW_SPACE.sub("", line))
            if rules and rows and first_rule is None:
                first_rule = len(rows)
            if not line.strip() or line.strip().startswith("\\label"):
                continue
            cells: list[Node] = []
            for cell in _split(line, "&"):
                wide = 1
                if m := _MULTICOLUMN.match(cell):
                    _, required, _ = arguments(cell, m.end(), 2, 0)
                    wide, cell = int(m[1]), required[1]
                if m := _MULTIROW.match(cell):
                    _, required, _ = arguments(cell, m.end(), 3, 1)
                    cell = required[2]
                cells.append(node("TableCell", children=_tidy(self.inline(cell.strip()))))
                cells += [node("TableCell") for _ in range(wide - 1)]
            rows.append((cells, k))
        has_head = bool(rows) and (first_rule == 1 or head_end is not None)
        label = _LABEL.search(body)
        return node("Table", headers=rows[0][0] if has_head else [], rows=[node("TableRow", cells=c) for c, _ in rows[has_head:]], caption=made_caption, label=label[1] if label else None)

    def floating(self, body: str) -> list[Node]:
        options, _, at = arguments(body, 0, 0)
        body = body[at:]
        captions: list[list[Node]] = []
        while m := re.search(r"\\caption\*?(\[[^\]]*\])?\{", body):
            end = group(body, m.end() - 1)
            captions.append(_tidy(self.inline(body[m.end() : end - 1])))
            body = body[: m.start()] + body[end:]
        label = re.search(r"\\label\{([^{}]*)\}", body)
        body = re.sub(r"\\label\{[^{}]*\}|\\centering(?![A-Za-z])", "", body)
        inner = self.blocks(body)
        from ..schema import walk

        holders = [d for n in inner for d in walk(n) if d["type"] in ("Image", "Table")]
        if holders:
            holders[-1]["caption"] = captions[-1] if captions else holders[-1]["caption"]
            holders[-1]["label"] = label[1] if label else holders[-1]["label"]
        elif captions:
            inner.append(paragraph(*captions[-1]))
        return inner

    def inline(self, source: str, style: dict | None = None) -> list[Node]:
        """Inline nodes of a stretch without blocks."""
        if not style and len(source) <= SHORT and "\x02" not in source:  # no code, so the same in any document
            return copied(_remembered(source))
        return self._inline(source, style)

    def _inline(self, source: str, style: dict | None = None) -> list[Node]:
        style = dict(style or {})
        out: list[Node] = []

        def say(s: str) -> None:
            if s:
                out.append(text(s, **style))

        i = 0
        while i < len(source):
            c = source[i]
            if c == "\x02":
                m = _MARK.match(source, i)
                out.append(self.hidden[int(m[1])])
                i = m.end()
            elif c == "{":
                end = group(source, i)
                out += self.inline(source[i + 1 : end - 1], style)
                i = end
            elif c == "}":
                i += 1
            elif c == "$":
                end = source.find("$", i + 1)
                if end < 0:
                    say("$")
                    i += 1
                else:
                    out.append(node("Equation", code=source[i + 1 : end].strip(), inline=True))
                    i = end + 1
            elif c == "\\":
                i = self.command(source, i, style, out, say)
            else:
                m = _PLAIN.match(source, i)
                say(typographic(m[0]))
                i = m.end()
        return out

    def command(self, source: str, i: int, style: dict, out: list[Node], say) -> int:
        m = _COMMAND.match(source, i)
        name, i = m[1], m.end()
        bare = name.rstrip("*")
        if name == "\\":
            out.append(node("LineBreak"))
            return _AFTER_BREAK.match(source, i).end()
        if name == "(":
            end = source.find("\\)", i)
            end = len(source) if end < 0 else end
            out.append(node("Equation", code=source[i:end].strip(), inline=True))
            return end + 2
        if name in ACCENTS and not (name.isalpha() and i < len(source) and source[i].isalpha()):
            _, (letter,), end = arguments(source, i, 1, 0)
            letter = {"\\i": "i", "\\j": "j"}.get(letter, letter)
            say(unicodedata.normalize("NFC", letter[:1] + ACCENTS[name] + letter[1:]) if letter else "")
            return end
        if not name[:1].isalpha():
            say({",": " ", ";": " ", ":": " ", " ": " ", "\n": " ", "-": "", "/": "", "!": "", "@": ""}.get(name, name))
            return i
        if bare in SYMBOLS:
            say(SYMBOLS[bare])
            return _AFTER_SYMBOL.match(source, i).end() if source[i : i + 2] != "{}" else i + 2
        if bare in CITATIONS:
            options, (keys,), end = arguments(source, i, 1, 2)
            out.append(node("Citation", keys=[k.strip() for k in keys.split(",")], style=name, options=options))
            return end
        if bare in REFERENCES:
            options, (label,), end = arguments(source, i, 1, 1)
            out.append(node("Reference", label=label, style=name, options=options))
            return end
        _, required, end = arguments(source, i, 1)
        if bare == "label":
            out.append(node("Label", name=required[0]))
        elif bare == "footnote":
            out.append(node("Footnote", content=_tidy(self.inline(required[0]))))
        elif bare in ("href", "url"):
            _, required, end = arguments(source, i, 2 if bare == "href" else 1, 0)
            url = required[0].replace("\\%", "%").replace("\\#", "#").replace("\\_", "_").replace("\\&", "&")
            out.append(node("Link", url=url, content=self.inline(required[1], style) if bare == "href" else [text(url, **style)]))
        elif bare == "includegraphics":
            out.append(node("Image", src=required[0].strip()))
        elif bare in ("texttt", "code"):
            out.append(node("CodeInline", code="".join(n.get("content", n.get("code", "")) for n in self.inline(required[0]))))
        elif bare in _STYLE:
            out += self.inline(required[0], style | _STYLE[bare])
        elif bare in _DECLARED:
            style.update(_DECLARED[bare])
            return re.compile(r"\s*").match(source, i).end()
        elif bare in ("newline", "linebreak"):
            out.append(node("LineBreak"))
            return i
        elif bare == "and":
            out.append(node("LineBreak", author_separator=True))
            return re.compile(r"\s*").match(source, i).end()
        elif name in _IGNORED_ONE:
            pass
        elif bare in _PASS or i < len(source) and source[i : i + 1] in "{[":
            while i < len(source) and source[i] in "{[":  # an unknown command keeps what it holds
                end = group(source, i, source[i], "}" if source[i] == "{" else "]")
                if source[i] == "{":
                    out += self.inline(source[i + 1 : end - 1], style)
                i = end
            return i
        else:
            return _BLANKS.match(source, i).end()
        return end


def typographic(s: str) -> str:
    """Quotes, dashes and ties of LaTeX as characters."""
    s = s.replace("---", "—").replace("--", "–").replace("``", "“").replace("''", "”").replace("~", "\u00a0")
    return _SPACES.sub(lambda m: "\u00a0" if m[0] == "\u00a0" else " ", s) if _ODD_SPACE.search(s) else s


@lru_cache(REMEMBERED)
def _remembered(source: str) -> list[Node]:
    """The nodes of a stretch without code; cells, items and headings are often the same in many documents."""
    return _Latex([])._inline(source)


@lru_cache(REMEMBERED)
def _remembered_blocks(source: str, top: int) -> list[Node]:
    reader = _Latex([])
    reader.top = top
    return reader.blocks(source)


def _split(source: str, mark: str) -> list[str]:
    """Parts between marks outside groups and environments."""
    out, depth, i, begin = [], 0, 0, 0
    while m := _SPLIT.search(source, i):
        s, i = m[0], m.end()
        if not depth and s == mark:
            out.append(source[begin : m.start()])
            begin = i
        elif len(s) > 2:  # an environment begins or ends
            depth += 1 if s == "\\begin{" else -1
            i = group(source, i - 1)
        else:
            depth += (s == "{") - (s == "}")
    return [*out, source[begin:]]


def _tidy(nodes: list[Node]) -> list[Node]:
    """Spaces collapsed across texts, breaks and spaces at the ends gone."""
    out: list[Node] = []
    for n in nodes:
        if n["type"] == "Text":
            content = n["content"]
            if content.startswith(" ") and (not out or out[-1]["type"] == "LineBreak" or out[-1]["type"] == "Text" and out[-1]["content"].endswith(" ")):
                content = content[1:]
            if not content:
                continue
            if out and out[-1]["type"] == "Text" and out[-1] == n | {"content": out[-1]["content"]}:
                out[-1] = out[-1] | {"content": out[-1]["content"] + content}
                continue
            n = n | {"content": content}
        elif n["type"] == "LineBreak":
            if not out or out[-1]["type"] == "LineBreak":
                continue
            if out[-1]["type"] == "Text":
                out[-1] = out[-1] | {"content": out[-1]["content"].rstrip(" ")}
        out.append(n)
    while out and (out[-1]["type"] == "LineBreak" or out[-1]["type"] == "Text" and not out[-1]["content"].strip(" ")):
        out.pop()
    if out and out[-1]["type"] == "Text":
        out[-1] = out[-1] | {"content": out[-1]["content"].rstrip(" ")}
    return out


def parse_latex(source: str) -> Node:
    """The tree of a LaTeX source."""
    hidden: list[Node] = []
    source = source.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n").replace("\x02", "").replace("\x03", "")
    source = _expanded(_without_comments(_hide_code(source, hidden)))
    meta = {}
    for name in ("title", "author", "date"):
        if m := _META[name].search(source):
            end = group(source, m.end() - 1)
            meta[name] = source[m.end() : end - 1]
            source = source[: m.start()] + source[end:]
    body_source = source.partition("\\begin{document}")[2].partition("\\end{document}")[0] if "\\begin{document}" in source else source
    reader = _Latex(hidden)
    used = {LEVELS.index(name) for name in _LEVEL.findall(body_source)}
    reader.top = min(used, default=0)
    tree = node("Document", children=reader.blocks(body_source))
    tree["section_root"] = "chapter" if used and LEVELS[min(used)] in ("part", "chapter") else None
    for name, value in meta.items():
        tree[name] = _tidy(reader.inline(value.strip()))
    return tree
