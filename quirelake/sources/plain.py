"""Plain text, delimited text and tree JSON to node trees."""

from __future__ import annotations

import csv
import io
import json
import re
import unicodedata
from typing import Any

from ..schema import _REQUIRED, NODE_FIELDS, Node, is_slot, node, paragraph, text
from .html import abstract_of
from .inline import MACRO, macro_node, trim_bare_url

# Underlines of headings, levels 1 to 6.
UNDERLINES = "=-~^\"'"
_ITEM = re.compile(r"^(\s*)(?:([-*+•])|(\d{1,9})[.)])\s+(.*)$")
_URL_OR_MACRO = re.compile(rf"(?P<url>(?<![\w/])https?://[^\s<>]+)|{MACRO.pattern}")


def display_width(s: str) -> int:
    """Columns of a string: wide characters take two, combining ones none."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def literal(source: str) -> list[Node]:
    """Text with bare URLs and reference macros as nodes."""
    out: list[Node] = []
    at = 0
    for m in _URL_OR_MACRO.finditer(source):
        if m["url"]:
            url = trim_bare_url(m["url"])
            made, end = node("Link", url=url, content=[text(url)]), m.start() + len(url)
        else:
            made, end = macro_node(m[0]), m.end()
        if m.start() > at:
            out.append(text(source[at : m.start()]))
        out.append(made)
        at = end
    return [*out, text(source[at:])] if at < len(source) else out


def is_wrapped(paragraphs: list[list[str]]) -> bool:
    """Whether lines are cut at a width: most could not have held the next word."""
    pairs = [(a, b) for p in paragraphs for a, b in zip(p, p[1:], strict=False)]
    widths = [w for a, _ in pairs if (w := display_width(a.rstrip())) <= 100]
    if not widths or max(widths) < 50:
        return False
    full = sum(display_width(a.rstrip()) + 1 + display_width(b.split()[0]) > max(widths) for a, b in pairs if b.split())
    return full >= 3 and 2 * full >= len(pairs)


class _Text:
    def __init__(self, wrapped: bool):
        self.wrapped = wrapped

    def parse(self, lines: list[str]) -> list[Node]:
        out: list[Node] = []
        i = 0
        while i < len(lines):
            line = lines[i]
            bare = line.strip()
            nxt = lines[i + 1].strip() if i + 1 < len(lines) else ""
            if not bare:
                i += 1
            elif line.expandtabs(4).startswith("    "):
                j = i
                while j < len(lines) and (not lines[j].strip() or lines[j].expandtabs(4).startswith("    ")):
                    j += 1
                out.append(node("CodeBlock", code="\n".join(x.expandtabs(4)[4:] for x in lines[i:j]).rstrip()))
                i = j
            elif len(nxt) >= 3 and nxt[0] in UNDERLINES and len(set(nxt)) == 1 and not re.match(r"^[-=*_ ]+$", bare):
                out.append(node("Heading", level=UNDERLINES.index(nxt[0]) + 1, children=literal(bare)))
                i += 2
            elif re.fullmatch(r"[-*_=]{3,}", bare) and len(set(bare)) == 1:
                out.append(node("HorizontalRule"))
                i += 1
            elif re.match(r"^\+[-=+]+\+$", bare):
                i = self.grid(lines, i, out)
            elif bare.startswith(">"):
                j = i
                while j < len(lines) and lines[j].strip().startswith(">"):
                    j += 1
                children = self.parse([re.sub(r"^\s*>\s?", "", x) for x in lines[i:j]])
                out.append(abstract_of(children) or node("BlockQuote", children=children))
                i = j
            elif bare.startswith("$$"):
                j = i
                while j < len(lines) and not (lines[j].strip().endswith("$$") and (j > i or len(bare) > 3)):
                    j += 1
                out.append(node("Equation", code="\n".join(x.strip() for x in lines[i : j + 1]).strip("$").strip()))
                i = j + 1
            elif _ITEM.match(line):
                i = self.list(lines, i, out)
            else:
                j = i
                while j < len(lines) and lines[j].strip() and (j == i or not _ITEM.match(lines[j])):
                    if j > i and j + 1 < len(lines) and len(n := lines[j + 1].strip()) >= 3 and n[0] in UNDERLINES and len(set(n)) == 1:
                        break
                    j += 1
                out.append(self.paragraph([x.strip() for x in lines[i:j]]))
                i = j
        return out

    def paragraph(self, lines: list[str]) -> Node:
        if self.wrapped:
            return paragraph(*literal(" ".join(lines)))
        children: list[Node] = []
        for k, line in enumerate(lines):
            children += [*([node("LineBreak")] if k else []), *literal(line)]
        return paragraph(*children)

    def list(self, lines: list[str], i: int, out: list[Node]) -> int:
        first = _ITEM.match(lines[i])
        base, ordered = len(first[1]), first[2] is None
        items: list[list[str]] = []
        number = 0
        while i < len(lines):
            line = lines[i]
            m = _ITEM.match(line)
            if m and len(m[1]) <= base + 1:
                if (m[2] is None) != ordered or len(m[1]) < base or ordered and items and int(m[3]) != number + 1:
                    break
                number = int(m[3]) if ordered else 0
                items.append([m[4]])
            elif not line.strip():
                nxt = next((x for x in lines[i + 1 :] if x.strip()), "")
                if not (len(nxt) - len(nxt.lstrip()) >= base + 2 or (n := _ITEM.match(nxt)) and len(n[1]) == base and (n[2] is None) == ordered and (not ordered or int(n[3]) == number + 1)):
                    break
                items[-1].append("")
            elif len(line) - len(line.lstrip()) >= base + 2:
                items[-1].append(line[min(base + 2, len(line) - len(line.lstrip())) :])
            else:
                break
            i += 1
        made = []
        for body in items:
            checked = None
            if m := re.match(r"^\[([ xX])\]\s+(.*)$", body[0]):
                checked, body = m[1] != " ", [m[2], *body[1:]]
            made.append(node("ListItem", children=self.parse(body), checked=checked))
        out.append(node("ListBlock", ordered=ordered, items=made, start=int(first[3]) if ordered else 1))
        return i

    def grid(self, lines: list[str], i: int, out: list[Node]) -> int:
        cuts = [k for k, c in enumerate(lines[i].strip()) if c == "+"]
        groups: list[tuple[list[str], str]] = []
        body: list[list[str]] = []
        i += 1
        while i < len(lines) and lines[i].strip()[:1] in ("|", "+") and lines[i].strip():
            bare = lines[i].strip()
            if bare.startswith("+"):
                groups.append(([" ".join(c for c in col if c) for col in zip(*body, strict=False)], bare))
                body = []
            else:
                body.append([bare[a + 1 : b].strip() for a, b in zip(cuts, cuts[1:], strict=False)])
            i += 1
        cells = lambda g: [node("TableCell", children=literal(c) if c else []) for c in g]
        head = next((k for k, (_, border) in enumerate(groups) if "=" in border), -1)
        out.append(node("Table", headers=cells(groups[head][0]) if head >= 0 else [], rows=[node("TableRow", cells=cells(g)) for g, _ in groups[head + 1 :]]))
        return i


def _title_block(lines: list[str]) -> tuple[dict[str, str], list[str]]:
    """A title between rules of equals signs at the start, and author and date after it; indented lines go on."""
    head = 0
    while head < len(lines) and not lines[head].strip():
        head += 1
    rules = [k < len(lines) and re.fullmatch("={3,}", lines[k].strip()) for k in (head, head + 2)]
    if not all(rules) or not lines[head + 1].strip():
        return {}, lines
    found, at, last = {"title": lines[head + 1].strip()}, head + 3, None
    while at < len(lines) and (line := lines[at]).strip():
        name, colon, value = line.partition(":")
        if colon and name in ("Author", "Date") and name.lower() not in found:
            last = name.lower()
            found[last] = value.strip()
        elif last and line[0] in " \t":
            found[last] += f" {line.strip()}"
        else:
            break
        at += 1
    return {k: v for k, v in found.items() if v}, lines[at:]


def parse_text(source: str) -> Node:
    """The tree of a plain text."""
    lines = source.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    metadata, lines = _title_block(lines)
    paragraphs = [[x for x in p.split("\n")] for p in re.split(r"\n\s*\n", "\n".join(lines)) if p.strip() and not p.startswith("    ")]
    tree = node("Document", children=_Text(is_wrapped(paragraphs)).parse(lines), **{k: [text(v)] for k, v in metadata.items()})
    _place_notes(tree)
    return tree


def _place_notes(tree: Node) -> None:
    """Trailing paragraphs ``[1] …`` … ``[N] …`` become footnotes at their first marks, if every one has a mark."""
    blocks = tree["children"]
    first = len(blocks)
    while first and (n := blocks[first - 1])["type"] == "Paragraph" and n["children"] and n["children"][0]["type"] == "Text" and re.match(r"\[\d+\]\s", n["children"][0]["content"]):
        first -= 1
    notes: dict[int, list[Node]] = {}
    for n in blocks[first:]:
        head = n["children"][0]
        m = re.match(r"\[(\d+)\]\s+", head["content"])
        notes[int(m[1])] = [head | {"content": head["content"][m.end() :]}, *n["children"][1:]]
    if not notes or sorted(notes) != list(range(1, len(blocks) - first + 1)):
        return
    from ..schema import child_slots, walk

    body = blocks[:first]
    marked = {int(x) for b in body for d in walk(b) if d["type"] == "Text" for x in re.findall(r"\[(\d+)\]", d["content"])}
    if not set(notes) <= marked:
        return
    used: set[int] = set()

    def place(n: Node) -> None:
        for _, children in child_slots(n):
            new: list[Node] = []
            for c in children:
                if c["type"] != "Text":
                    place(c)
                    new.append(c)
                    continue
                at = 0
                for m in re.finditer(r"\[(\d+)\]", c["content"]):
                    k = int(m[1])
                    if k in notes and k not in used:
                        used.add(k)
                        new += [c | {"content": c["content"][at : m.start()]}, node("Footnote", content=notes[k])]
                        at = m.end()
                new.append(c | {"content": c["content"][at:]})
            children[:] = [c for c in new if c["type"] != "Text" or c["content"]]

    tree["children"] = body
    place(tree)


def sniff(sample: str) -> str:
    """The delimiter among comma, semicolon, tab and bar that cuts most lines alike."""
    lines = [x for x in sample.splitlines() if x.strip()][:50]
    best, score = ",", 0.0
    for d in ",;\t|":
        if d not in sample:
            continue
        counts = [len(next(csv.reader([x], delimiter=d))) - 1 for x in lines]
        if counts and min(counts) > 0 or counts and sum(c == counts[0] for c in counts) * 2 > len(counts) and counts[0]:
            alike = sum(c == counts[0] for c in counts) / len(counts)
            if alike * min(counts[0], 20) > score:
                best, score = d, alike * min(counts[0], 20)
    return best


def parse_csv(source: str) -> Node:
    """A document with one table; the first row is the header."""
    source = source.removeprefix("\ufeff")
    rows = list(csv.reader(io.StringIO(source, newline=""), delimiter=sniff(source[:8192])))
    while rows and not any(c.strip() for c in rows[-1]):
        rows.pop()
    if not rows:
        return node("Document")
    width = max(map(len, rows))

    def cells(row: list[str]) -> list[Node]:
        made = []
        for value in [*row, *[""] * (width - len(row))]:
            if "\n" not in value:
                children = [text(value)] if value else []
            else:
                children = []
                for k, part in enumerate(value.replace("\r\n", "\n").split("\n")):
                    children += [*([node("LineBreak")] if k else []), *([text(part)] if part else [])]
            made.append(node("TableCell", children=children))
        return made

    return node("Document", children=[node("Table", headers=cells(rows[0]), rows=[node("TableRow", cells=cells(r)) for r in rows[1:]])])


def decoded(value: Any) -> Node:
    """A node from JSON; unknown types, missing fields and wrong lists are errors, unknown keys are ignored."""
    if not isinstance(value, dict) or value.get("type") not in NODE_FIELDS:
        raise ValueError(f"unknown node type: {value.get('type') if isinstance(value, dict) else value!r}")
    kind = value["type"]
    fields = {}
    for name, default in NODE_FIELDS[kind].items():
        if name not in value:
            if default is _REQUIRED:
                raise ValueError(f"{kind} needs {name}")
            continue
        v = value[name]
        if isinstance(default, list) and not isinstance(v, list):
            raise ValueError(f"{kind}.{name} is no list")
        fields[name] = [decoded(c) for c in v] if is_slot(kind, name) else v
    return node(kind, **fields)


def parse_json(source: str) -> Node:
    """The tree of tree JSON; its root is a Document."""
    tree = decoded(json.loads(source))
    if tree["type"] != "Document":
        raise ValueError("the root is no Document")
    return tree
