"""The node table: one row for each node of each document, in pre-order.

``(node_id, subtree_end)`` is a nested-set interval, so descendants are a
range, the text of a node is an ordered aggregation over that range, and
removing a subtree is an anti join.  Parsers build plain dictionaries
(``node``); ``flatten`` and ``assemble`` go between them and rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import types as T

Node = dict[str, Any]

# The order in which child lists are visited.
SLOTS = ("children", "content", "items", "headers", "rows", "cells", "entries", "caption", "title", "author", "date")

# Node types, with their required fields and the defaults of the others.
_REQUIRED = object()
NODE_FIELDS: dict[str, dict[str, Any]] = {
    "Text": {"content": _REQUIRED, "bold": False, "italic": False, "strikethrough": False, "script": None},
    "Link": {"url": _REQUIRED, "title": None, "content": []},
    "Image": {"src": _REQUIRED, "alt": "", "title": None, "description": None, "category": None, "extracted_text": None, "caption": [], "label": None},
    "CodeInline": {"code": _REQUIRED},
    "LineBreak": {"author_separator": False},
    "Footnote": {"content": []},
    "Citation": {"keys": _REQUIRED, "style": "cite", "options": []},
    "Reference": {"label": _REQUIRED, "style": "ref", "options": []},
    "Label": {"name": _REQUIRED},
    "Paragraph": {"children": []},
    "Heading": {"level": _REQUIRED, "children": [], "numbered": True},
    "CodeBlock": {"code": _REQUIRED, "language": None},
    "BlockQuote": {"children": [], "alert_type": None},
    "Abstract": {"children": []},
    "HorizontalRule": {},
    "Appendix": {},
    "BibEntry": {"key": _REQUIRED, "children": [], "label": None},
    "Bibliography": {"commands": [], "entries": [], "widest": "9"},
    "ListItem": {"children": [], "checked": None},
    "ListBlock": {"ordered": _REQUIRED, "items": [], "start": 1},
    "TableCell": {"children": []},
    "TableRow": {"cells": []},
    "Table": {"headers": [], "rows": [], "caption": [], "label": None},
    "Equation": {"code": _REQUIRED, "inline": False, "env": None},
    "Document": {"children": [], "title": [], "author": [], "date": [], "section_root": None},
}

#: The fields of each type that hold child nodes, in their fixed order; its required fields; and a node of it with every default.
SLOTS_OF = {kind: tuple(name for name in SLOTS if isinstance(fields.get(name), list)) for kind, fields in NODE_FIELDS.items()}
_SLOTS_BACK = {kind: names[::-1] for kind, names in SLOTS_OF.items()}
_REQUIRED_OF = {kind: tuple(name for name, default in fields.items() if default is _REQUIRED) for kind, fields in NODE_FIELDS.items()}
_LISTS_OF = {kind: tuple(name for name, default in fields.items() if isinstance(default, list) or name == "keys") for kind, fields in NODE_FIELDS.items()}
_BLANK = {kind: {"type": kind, **fields} for kind, fields in NODE_FIELDS.items()}

#: Attribute columns of the node table and their types; ``text`` holds Text.content.
ATTRIBUTES: dict[str, str] = {
    "text": "string", "bold": "boolean", "italic": "boolean", "strikethrough": "boolean", "script": "string", "url": "string", "title": "string",
    "src": "string", "alt": "string", "description": "string", "category": "string", "extracted_text": "string", "code": "string", "language": "string",
    "level": "int", "numbered": "boolean", "ordered": "boolean", "start": "int", "checked": "boolean", "alert_type": "string", "inline": "boolean",
    "env": "string", "keys": "array<string>", "style": "string", "options": "array<string>", "label": "string", "name": "string", "key": "string",
    "commands": "array<string>", "widest": "string", "author_separator": "boolean", "section_root": "string",
}
STRUCTURE = {"node_id": "int", "parent_id": "int", "slot": "string", "ord": "int", "subtree_end": "int", "depth": "int", "type": "string"}
NODE_COLUMNS = [*STRUCTURE, *ATTRIBUTES]


def node_schema(id_name: str = "doc_id", id_type: str = "long") -> T.StructType:
    """The schema of the node table."""
    columns = {id_name: id_type, **STRUCTURE, **ATTRIBUTES}
    return T._parse_datatype_string(", ".join(f"`{k}` {v}" for k, v in columns.items()))


def node(kind: str, **fields: Any) -> Node:
    """A node with the defaults of its type; unknown types and fields are errors."""
    out: Node = _BLANK[kind].copy()
    out.update(fields)
    if len(out) > len(_BLANK[kind]) or "type" in fields:
        raise ValueError(f"{kind} has no {', '.join(sorted(fields.keys() - NODE_FIELDS[kind].keys()))}")
    for name in _REQUIRED_OF[kind]:
        if name not in fields:
            raise ValueError(f"{kind} needs {name}")
    for name in _LISTS_OF[kind]:
        if isinstance(value := out[name], list):
            out[name] = value[:]
    return out


def is_slot(kind: str, name: str) -> bool:
    """Whether a field holds child nodes."""
    return name in SLOTS_OF[kind]


def child_slots(n: Node) -> Iterator[tuple[str, list[Node]]]:
    """The child lists of a node in their fixed order."""
    for name in SLOTS_OF[n["type"]]:
        yield name, n[name]


def walk(n: Node) -> Iterator[Node]:
    """A node and its descendants, depth first."""
    todo = [n]
    while todo:
        n = todo.pop()
        yield n
        for name in _SLOTS_BACK[n["type"]]:
            if below := n[name]:
                todo.extend(below[::-1])


def plain_text(nodes: list[Node]) -> str:
    """The text of nodes, descendants included."""
    return "".join(d["content"] for n in nodes for d in walk(n) if d["type"] == "Text")


def flatten(tree: Node) -> list[tuple]:
    """Rows in the order of NODE_COLUMNS."""
    rows: list[list] = []
    todo: list[tuple[Node | None, int, str | None, int, int]] = [(tree, -1, None, 0, 0)]
    while todo:
        n, parent, slot, at, depth = todo.pop()
        if n is None:  # the end of a subtree
            rows[parent][4] = len(rows) - 1
            continue
        number = len(rows)
        fields = {k: v for k, v in n.items() if k != "type" and not is_slot(n["type"], k)}
        if n["type"] == "Text":
            fields["text"] = fields.pop("content")
        rows.append([number, parent if parent >= 0 else None, slot, at, number, depth, n["type"], *(fields.get(a) for a in ATTRIBUTES)])
        todo.append((None, number, None, 0, 0))
        below = [(c, number, name, i, depth + 1) for name, children in child_slots(n) for i, c in enumerate(children)]
        todo.extend(reversed(below))
    return [tuple(r) for r in rows]


def assemble(rows: list[dict[str, Any]]) -> Node:
    """The tree of one document's rows; a document without rows is empty."""
    made: dict[int, Node] = {}
    root = node("Document")
    for r in sorted(rows, key=lambda r: r["node_id"]):
        kind = r["type"]
        fields: dict[str, Any] = {}
        for name, default in NODE_FIELDS[kind].items():
            if is_slot(kind, name):
                continue
            value = r.get("text" if (kind, name) == ("Text", "content") else name)
            if value is None and default is not _REQUIRED:
                value = default
            fields[name] = list(value) if isinstance(default, list) or name == "keys" else value
        n = made[r["node_id"]] = node(kind, **fields)
        parent = made.get(r["parent_id"]) if r["parent_id"] is not None else None
        if parent is None:
            root = n if kind == "Document" else root
        else:
            parent[r["slot"]].append(n)
    return root


def text(content: str, **style: Any) -> Node:
    """A Text node."""
    if style:
        return node("Text", content=content, **style)
    return {"type": "Text", "content": content, "bold": False, "italic": False, "strikethrough": False, "script": None}


def copied(nodes: list[Node]) -> list[Node]:
    """Nodes and their descendants again, so that a change of them leaves these as they are."""
    out = []
    for n in nodes:
        made = n.copy()
        for name in SLOTS_OF[n["type"]]:
            made[name] = copied(n[name])
        out.append(made)
    return out


def paragraph(*children: Node) -> Node:
    """A Paragraph node."""
    return node("Paragraph", children=list(children))
