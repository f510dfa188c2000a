"""HTML to a node tree: a tolerant element tree first, then content extraction, then nodes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urlparse

from ..schema import Node, node, paragraph, plain_text, text

# What content extraction drops, and the attributes that it keeps.
NOISE = frozenset("script style nav footer header aside noscript iframe form head".split())
KEPT_ATTRIBUTES = frozenset(
    "href src alt title class id role encoding display colspan rowspan data-src data-lazy-src srcset data-srcset data-label start type checked".split()
)
_CELLS, _GROUPS = frozenset({"td", "th"}), frozenset({"thead", "tbody", "tfoot"})
# For an opening tag, the open elements that it ends and those that stop the search.
IMPLIED_END = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (_CELLS | {"tr"}, _GROUPS | {"table"}),
    "td": (_CELLS, frozenset({"tr", "table"})),
    "th": (_CELLS, frozenset({"tr", "table"})),
    "thead": (_GROUPS | _CELLS | {"tr"}, frozenset({"table"})),
    "tbody": (_GROUPS | _CELLS | {"tr"}, frozenset({"table"})),
    "tfoot": (_GROUPS | _CELLS | {"tr"}, frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
}
# Elements without content, elements that are blocks, spaces of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main "
    "nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_SPACE = " \t\n\r\f"
# Classes and ids that wiki software puts on everything but the article.
WIKI_CLASSES = frozenset(
    "mw-editsection mw-editsection-bracket navbox navbox-inner navbox-styles vertical-navbox navbar ambox ombox mbox-small hatnote dablink rellink noprint "
    "printfooter catlinks mw-jump-link toc toccolours shortdescription mw-empty-elt sistersitebox side-box navigation-not-searchable portal".split()
)
WIKI_IDS = frozenset("toc catlinks mw-navigation mw-panel siteSub contentSub jump-to-nav p-lang".split())
WIKI_REFERENCES = frozenset("reflist references refbegin mw-references-wrap".split())
WIKI_SECTIONS = frozenset({"see also", "external links", "further reading", "siehe auch", "weblinks", "voir aussi", "liens externes", "véase también", "enlaces externos"})
WIKI_MARKS = ('class="mediawiki', 'id="mw-content-text"')
MOST_CELLS = 4096


@dataclass
class Element:
    """An element; children are elements and strings."""

    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)

    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def below(self, *tags: str):
        """Descendants with one of the tags, in order."""
        todo = list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, Element):
                if c.tag in tags:
                    yield c
                todo.extend(reversed(c.children))

    def text(self) -> str:
        """All strings below."""
        out, todo = [], list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                todo.extend(reversed(c.children))
        return "".join(out)


class _Builder(HTMLParser):
    """Elements with implied ends; stray end tags close nothing."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in IMPLIED_END:
            ends, stops = IMPLIED_END[tag]
            last = None
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in stops:
                    break
                if self.open[i].tag in ends:
                    last = i
            if last is not None:
                del self.open[last:]
        elif tag in BLOCKS:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == "p":
                    del self.open[i:]
                    break
                if self.open[i].tag in BLOCKS:
                    break
        made = Element(tag, {k: v if v is not None else "" for k, v in attrs})
        self.open[-1].children.append(made)
        if tag not in VOID:
            self.open.append(made)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            # A formatting end tag does not reach out of its cell or item.
            if tag not in BLOCKS and self.open[i].tag in ("td", "th", "li", "table"):
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def elements(source: str) -> Element:
    """The element tree of a page."""
    builder = _Builder()
    builder.feed(source)
    builder.close()
    return builder.root


class SiteProfile:
    """A kind of site: how to know it, and what of its pages is not content."""

    def matches(self, url: str | None, source: str) -> bool:
        raise NotImplementedError

    def skip(self, element: Element) -> bool:
        """Whether an element goes with all below it."""
        return False

    def clean(self, tree: Node) -> None:
        """Changes the finished tree."""


class WikiProfile(SiteProfile):
    """Encyclopedia pages of wiki software, in any language."""

    def __init__(self, *, keep_references: bool = True, keep_citations: bool = False, drop_sections: frozenset[str] = WIKI_SECTIONS):
        self.keep_references, self.keep_citations, self.drop_sections = keep_references, keep_citations, drop_sections

    def matches(self, url: str | None, source: str) -> bool:
        if url and (urlparse(url).hostname or "").lower().split(".")[-2:] == ["wikipedia", "org"]:
            return True
        return any(0 <= source.find(mark) < 50_000 - len(mark) + 1 for mark in WIKI_MARKS)

    def skip(self, element: Element) -> bool:
        classes = element.classes()
        if classes & WIKI_CLASSES or element.attrs.get("id") in WIKI_IDS or element.attrs.get("role") == "navigation":
            return True
        if not self.keep_citations and element.tag == "sup" and "reference" in classes:
            return True
        return not self.keep_references and bool(classes & WIKI_REFERENCES)

    def clean(self, tree: Node) -> None:
        """Sections are intervals of blocks, up to the next heading of the same or a smaller level."""
        blocks = tree["children"]
        end = [len(blocks)] * 7  # by level, where a section that lies open would end; read from the last block on
        outside = [True] * len(blocks)
        for i in range(len(blocks) - 1, -1, -1):
            if blocks[i]["type"] == "Heading":
                level = blocks[i]["level"]
                if " ".join(plain_text([blocks[i]]).split()).lower() in self.drop_sections:
                    outside[i : end[level]] = [False] * (end[level] - i)
                end[level:] = [i] * (7 - level)
        tree["children"] = [b for b, stays in zip(blocks, outside, strict=True) if stays]


PROFILES: tuple[SiteProfile, ...] = (WikiProfile(),)


def content(root: Element, profiles: tuple[SiteProfile, ...] = ()) -> Element:
    """Extraction: noise and site chrome go, safe attributes stay, main blocks stand alone if there are any."""

    def clean(e: Element) -> Element:
        out = Element(e.tag, {k: v for k, v in e.attrs.items() if k in KEPT_ATTRIBUTES and v})
        for c in e.children:
            if isinstance(c, str):
                out.children.append(c)
            elif c.tag not in NOISE and not any(p.skip(c) for p in profiles):
                out.children.append(clean(c))
        return out

    def mains(e: Element) -> list[Element]:
        found = []
        for c in e.children:
            if isinstance(c, Element):
                if c.tag in ("main", "article") or c.attrs.get("role") == "main":
                    found.append(c)
                else:
                    found += mains(c)
        return found

    whole = clean(root)
    return Element("#root", {}, mains(whole)) if mains(whole) else whole


_STYLES = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "s": "strikethrough", "del": "strikethrough", "strike": "strikethrough"}
_LANGUAGE = re.compile(r"(?:language|lang)-([\w+#-]+)")


class _Nodes:
    """Nodes of an element tree."""

    def __init__(self, root: Element):
        self.bold, self.italic = set(), set()
        for style in root.below("style"):
            for names, body in re.findall(r"([^{}]+)\{([^{}]*)\}", style.text()):
                for cls in re.findall(r"\.([\w-]+)", names):
                    if re.search(r"font-weight:\s*(bold|[6-9]00)", body):
                        self.bold.add(cls)
                    if re.search(r"font-style:\s*italic", body):
                        self.italic.add(cls)

    def styled(self, e: Element, style: dict) -> dict:
        classes = e.classes()
        if name := _STYLES.get(e.tag):
            style = style | {name: True}
        if e.tag in ("sup", "sub"):
            style = style | {"script": e.tag}
        if classes & self.bold:
            style = style | {"bold": True}
        if classes & self.italic:
            style = style | {"italic": True}
        return style

    def blocks(self, e: Element, style: dict) -> list[Node]:
        """The blocks below an element; inline content between them becomes paragraphs."""
        out: list[Node] = []
        inline: list[Node] = []

        def flush() -> None:
            done = _trimmed(inline)
            inline.clear()
            if done:
                out.append(paragraph(*done))

        def visit(children: list, style: dict) -> None:
            for c in children:
                if isinstance(c, str):
                    inline.append(text(c, **style))
                elif c.tag in BLOCKS or c.tag in ("math", "script") and (c.attrs.get("display") == "block"):
                    flush()
                    out.extend(self.block(c, style))
                elif c.tag in ("script", "style", "head", "title", "template"):
                    if c.tag == "script" and c.attrs.get("type", "").startswith("math/tex"):
                        inline.append(node("Equation", code=c.text().strip(), inline=True))
                elif any(True for _ in c.below(*BLOCKS)) and c.tag != "a":
                    visit(c.children, self.styled(c, style))  # formatting around blocks
                else:
                    inline.extend(self.inline(c, style))

        visit(e.children, style)
        flush()
        return out

    def block(self, e: Element, style: dict) -> list[Node]:
        style = self.styled(e, style)
        tag = e.tag
        if re.fullmatch("h[1-6]", tag):
            children = _trimmed(self.inlines(e, style))
            return [node("Heading", level=int(tag[1]), children=children)] if children else []
        if tag == "p":
            children = _trimmed(self.inlines(e, style))
            if not children:
                return []
            return [node("Heading", level=1, children=children) if "title" in e.classes() else paragraph(*children)]
        if tag == "hr":
            return [node("HorizontalRule")]
        if tag == "pre":
            code = next(e.below("code"), None)
            found = _LANGUAGE.search(f"{e.attrs.get('class', '')} {code.attrs.get('class', '') if code else ''}")
            body = e.text()
            return [node("CodeBlock", code=body.removeprefix("\n").rstrip("\n"), language=found[1] if found else None)]
        if tag in ("ul", "ol"):
            items = [self.item(c, style) for c in e.children if isinstance(c, Element) and c.tag == "li"]
            for c in e.children:  # lists directly inside lists belong to the item before
                if isinstance(c, Element) and c.tag in ("ul", "ol"):
                    (items[-1]["children"] if items else items.append(node("ListItem")) or items[-1]["children"]).extend(self.block(c, style))
            start = e.attrs.get("start", "")
            return [node("ListBlock", ordered=tag == "ol", items=items, start=int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1)] if items else []
        if tag == "dl":
            out = []
            for c in e.children:
                if isinstance(c, Element) and c.tag in ("dt", "dd"):
                    out += self.blocks(c, style | ({"bold": True} if c.tag == "dt" else {}))
            return out
        if tag == "blockquote":
            # Our own pages show what kind of quote it is.
            mark = next((c for c in e.children if isinstance(c, Element) and "alert-title" in c.classes()), None)
            rest = Element(e.tag, e.attrs, [c for c in e.children if c is not mark])
            children = self.blocks(rest, style)
            if mark is not None and mark.text().strip() == "Abstract":
                return [node("Abstract", children=children)]
            alert = next((c.removeprefix("alert-") for c in sorted(e.classes()) if c.startswith("alert-")), None)
            return [abstract_of(children, alert) or node("BlockQuote", children=children, alert_type=alert)] if children else []
        if tag == "table":
            return self.table(e, style)
        if tag == "figure":
            out = []
            caption: list[Node] = []
            for c in e.children:
                if isinstance(c, Element) and c.tag == "figcaption":
                    caption = _trimmed(self.inlines(c, style))
                else:
                    out += self.blocks(Element("div", {}, [c]), style)
            holders = [d for n in out for d in _walk(n) if d["type"] in ("Image", "Table")]
            if caption and holders:
                holders[-1]["caption"] = caption
            elif caption:
                out.append(paragraph(*caption))
            return out
        return self.blocks(e, style)

    def item(self, e: Element, style: dict) -> Node:
        checked = None
        children = e.children
        flat = [c for c in children if not (isinstance(c, str) and not c.strip(_SPACE))]
        if flat and isinstance(flat[0], Element) and flat[0].tag == "input" and flat[0].attrs.get("type") == "checkbox":
            checked = "checked" in flat[0].attrs
            children = [c for c in children if c is not flat[0]]
        return node("ListItem", children=self.blocks(Element("li", {}, children), self.styled(e, style)), checked=checked)

    def cell(self, e: Element, style: dict) -> Node:
        """Inline content of a cell; blocks in it are set apart by a space."""
        parts: list[Node] = []
        for b in self.blocks(e, self.styled(e, style)):
            if parts:
                parts.append(text(" "))
            parts += _inline_of(b)
        return node("TableCell", children=_trimmed(parts))

    def table(self, e: Element, style: dict) -> list[Node]:
        rows: list[tuple[Element, bool]] = []
        before: list[Node] = []
        caption: list[Node] = []

        def visit(parent: Element, head: bool) -> None:
            for c in parent.children:
                if isinstance(c, Element):
                    if c.tag == "tr":
                        rows.append((c, head))
                    elif c.tag in _GROUPS:
                        visit(c, head or c.tag == "thead")
                    elif c.tag == "caption":
                        caption.extend(_trimmed(self.inlines(c, style)))
                    elif c.tag not in ("col", "colgroup"):
                        before.extend(self.blocks(Element("div", {}, [c]), style))
                elif c.strip(_SPACE):
                    before.append(paragraph(text(" ".join(c.split()), **style)))

        visit(e, False)
        grid: list[list[Node]] = []
        carried: dict[int, int] = {}
        headers: list[Node] = []
        for at, (row, head) in enumerate(rows):
            cells = [c for c in row.children if isinstance(c, Element) and c.tag in ("td", "th")]
            is_header = head or at == 0 and bool(cells) and all(c.tag == "th" for c in cells)
            line: list[Node] = []

            def carry(line: list[Node]) -> None:
                while carried.get(len(line), 0) > 0 and len(line) < MOST_CELLS:
                    carried[len(line)] -= 1
                    line.append(node("TableCell"))

            for c in cells:
                carry(line)
                wide, high = (int(v) if (v := c.attrs.get(k, "")).isdigit() and len(v) < 6 else 1 for k in ("colspan", "rowspan"))
                for k in range(max(1, min(wide, MOST_CELLS - len(line)))):
                    if high > 1:
                        carried[len(line)] = high - 1
                    line.append(self.cell(c, style) if k == 0 else node("TableCell"))
            carry(line)
            if is_header and not headers:
                headers = line
            elif line:
                grid.append(line)
        if not headers and not grid:
            return before
        made = node("Table", headers=headers, rows=[node("TableRow", cells=r) for r in grid], caption=caption, label=e.attrs.get("data-label") or None)
        return [*before, made]

    def inlines(self, e: Element, style: dict) -> list[Node]:
        out: list[Node] = []
        for c in e.children:
            if isinstance(c, str):
                out.append(text(c, **style))
            elif c.tag in BLOCKS:
                for b in self.block(c, style):
                    out += [*([text(" ")] if out else []), *_inline_of(b)]
            else:
                out += self.inline(c, style)
        return out

    def inline(self, e: Element, style: dict) -> list[Node]:
        style = self.styled(e, style)
        tag = e.tag
        if tag == "br":
            return [node("LineBreak")]
        if tag == "img":
            return self.image(e)
        if tag == "a" and e.attrs.get("href"):
            inner = _merged(self.inlines(e, style))
            return [node("Link", url=e.attrs["href"], title=e.attrs.get("title") or None, content=inner)] if inner else []
        if tag in ("code", "kbd", "samp", "tt"):
            return [node("CodeInline", code=e.text())] if e.text() else []
        if tag == "math" or "math" in e.classes() and tag == "span":
            found = next((a for a in e.below("annotation") if "tex" in a.attrs.get("encoding", "")), None)
            code = (found.text() if found else e.text()).strip()
            code = re.sub(r"^\{\\displaystyle\s*(.*)\}$", r"\1", code, flags=re.S).strip().removeprefix("\\(").removesuffix("\\)").strip()
            return [node("Equation", code=code, inline=e.attrs.get("display") != "block")] if code else []
        if tag == "script":
            return [node("Equation", code=e.text().strip(), inline=True)] if e.attrs.get("type", "").startswith("math/tex") else []
        if tag in ("style", "head", "title", "template", "input"):
            return []
        return self.inlines(e, style)

    def image(self, e: Element) -> list[Node]:
        src = e.attrs.get("src", "").strip()
        if not src or src.startswith("data:"):
            first = next((v.split(",")[0].split()[0] for k in ("srcset", "data-srcset") if (v := e.attrs.get(k, "").strip())), "")
            src = e.attrs.get("data-src") or e.attrs.get("data-lazy-src") or first or src
        return [node("Image", src=src, alt=e.attrs.get("alt", ""), title=e.attrs.get("title") or None, label=e.attrs.get("data-label") or None)] if src else []


def _walk(n: Node):
    from ..schema import walk

    return walk(n)


def _inline_of(block: Node) -> list[Node]:
    """The inline content of a block, for places that hold no blocks."""
    kind = block["type"]
    if kind in ("Paragraph", "Heading"):
        return block["children"]
    if kind == "CodeBlock":
        return [node("CodeInline", code=block["code"])]
    if kind == "ListBlock":
        return _spaced([_spaced([_inline_of(b) for b in i["children"]]) for i in block["items"]])
    if kind == "Table":
        lines = [block["headers"], *(r["cells"] for r in block["rows"])]
        return _spaced([_spaced([c["children"] for c in line]) for line in lines if line])
    if "children" in block:
        return _spaced([_inline_of(b) for b in block["children"]])
    return [block] if kind == "Equation" else []


def _spaced(parts: list[list[Node]]) -> list[Node]:
    out: list[Node] = []
    for p in parts:
        if p:
            out += [*([text(" ")] if out else []), *p]
    return out


def _merged(nodes: list[Node]) -> list[Node]:
    """Spaces collapsed across runs, equal neighbours joined."""
    out: list[Node] = []
    space = False
    for n in nodes:
        if n["type"] == "Text":
            content = re.sub(f"[{_SPACE}]+", " ", n["content"])
            if space and content.startswith(" "):
                content = content[1:]
            if not content:
                continue
            space = content.endswith(" ")
            style = {k: n[k] for k in ("bold", "italic", "strikethrough", "script")}
            if out and out[-1]["type"] == "Text" and all(out[-1][k] == v for k, v in style.items()):
                out[-1]["content"] += content
            else:
                out.append(text(content, **style))
        else:
            if n["type"] == "LineBreak" and out and out[-1]["type"] == "Text":
                out[-1]["content"] = out[-1]["content"].rstrip(" ")
                if not out[-1]["content"]:
                    out.pop()
            space = n["type"] == "LineBreak"
            out.append(n)
    return out


def _trimmed(nodes: list[Node]) -> list[Node]:
    """Merged, without breaks and spaces at either end."""
    out = _merged(nodes)
    while out and (out[0]["type"] == "LineBreak" or out[0]["type"] == "Text" and not out[0]["content"].lstrip(_SPACE)):
        out.pop(0)
    while out and (out[-1]["type"] == "LineBreak" or out[-1]["type"] == "Text" and not out[-1]["content"].rstrip(_SPACE)):
        out.pop()
    if out and out[0]["type"] == "Text":
        out[0]["content"] = out[0]["content"].lstrip(_SPACE)
    if out and out[-1]["type"] == "Text":
        out[-1]["content"] = out[-1]["content"].rstrip(_SPACE)
    return out


def abstract_of(children: list[Node], alert: str | None = None) -> Node | None:
    """An Abstract, if the first text says so as a whole word; in an alert, only in an important one and in bold."""
    first = children[0] if children else None
    if alert and (alert.lower() != "important" or not first or not first.get("children") or not first["children"][0].get("bold")):
        return None
    if not first or first["type"] != "Paragraph" or not first["children"] or first["children"][0]["type"] != "Text":
        return None
    head = first["children"][0]
    m = re.match(r"\s*abstract\b[:.\s]*", head["content"], re.I)
    if not m:
        return None
    rest = head["content"][m.end() :]
    inner = [head | {"content": rest}, *first["children"][1:]] if rest else first["children"][1:]
    while inner and (inner[0]["type"] == "LineBreak" or inner[0]["type"] == "Text" and not inner[0]["content"].strip()):
        inner = inner[1:]
    return node("Abstract", children=[*([paragraph(*inner)] if inner else []), *children[1:]])


def parse_html(source: str, *, extract: bool = False, url: str | None = None, profiles: tuple[SiteProfile, ...] = PROFILES) -> Node:
    """The tree of a page; ``extract`` keeps its main content only."""
    root = elements(source)
    chosen = tuple(p for p in profiles if p.matches(url, source)) if extract else ()
    if extract:
        root = content(root, chosen)
    tree = node("Document", children=_Nodes(root).blocks(root, {}))
    title = next(root.below("title"), None)
    if title is not None and (words := title.text().split()) and not any(n["type"] == "Heading" and n["level"] == 1 for n in tree["children"]):
        tree["children"].insert(0, node("Heading", level=1, children=[text(" ".join(words))]))
    for p in chosen:
        p.clean(tree)
    return tree
