"""Conversions of one document for each part: its source, and the outcome that is expected.

Sources and outcomes are templates over the columns of ``part``, so that SQL
makes the expected text without a parser or renderer.  The outcomes state the
formats that the writers have to follow; they are fixed values, not records of
what the writers print.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import spread
from .convert import convert_df

_PLACE = re.compile(r"\{([a-z_]+)(?::(\d+))?\}")
#: What a place of a template holds, in SQL that Spark and DuckDB both know.
PLACES = {
    "name": "p_name", "brand": "p_brand", "type": "p_type", "key": "cast(p_partkey AS varchar(20))", "size": "cast(p_size AS varchar(20))",
    "brand_latex": "replace(p_brand, '#', '\\#')", "rule": "repeat('=', cast(greatest(3, length(p_name)) AS int))", "cr": "chr(13)",
}


def composed(template: str) -> list[tuple[bool, str]]:
    """The pieces of a template: (whether it is SQL, text)."""
    out, at = [], 0
    for m in _PLACE.finditer(template):
        if m[1] in PLACES:
            value = PLACES[m[1]] if not m[2] else f"rpad({PLACES[m[1]]}, {m[2]}, ' ')"
            out += [(False, template[at : m.start()]), (True, value)]
            at = m.end()
    return [*out, (False, template[at:])]


def source(template: str) -> Column:
    """A source as a column over ``part``."""
    return F.concat(*[F.expr(x) if is_sql else F.lit(x) for is_sql, x in composed(template)])


def oracle(template: str) -> str:
    """The SQL of an expected outcome."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    value = " || ".join(x if is_sql else quoted(x) for is_sql, x in composed(template))
    return f"SELECT p_partkey, {value} AS converted, NULL::VARCHAR AS error FROM part"


def converted(parts: DataFrame, template: str, from_format: str, to_format: str) -> DataFrame:
    """p_partkey, converted and error of the documents composed by a template."""
    docs = spread(parts, "p_partkey").select("p_partkey", source(template).alias("source"))
    return convert_df(docs, from_format, to_format, id_col="p_partkey", text_col="source")


MARKDOWN = r'''---
title: {name}
author: {brand}
---

# {name}

Intro of **{name}** with *{type}*, ~~old~~ and `code {name}`[^1]. See [{brand}](http://x.org/{key} "{type}") or <http://y.org/{key}>.

Ref [link {brand}][r], \*escaped\* {type}, &copy; and a<br>b, [{key}].

[r]: http://r.org/{key} "Of {size}"

## Sizes

- first {name}
- second
  - inner {size}
- [x] done
- [ ] open

3. three
4. four

| Key | Size |
|-----|------|
| alpha | **beta** |
| a\|b | gamma |

> quoted {name}

> [!NOTE]
> note {brand}

```python
x = {size}
```

$$
a^{size}
$$

Inline $b_{size}$ math, H~2~O.

![alt {name}](img/{key}.png "{type}")

---

[^1]: Footnote {name}.
'''

BODY = r'''# {name}

Intro of **{name}** with *{type}*, ~~old~~ and `code {name}`. See [{brand}](http://x.org/{key} "{type}") or <http://y.org/{key}>.

Ref [link {brand}][r], \*escaped\* {type}, &copy; and a<br>b, [{key}].

[r]: http://r.org/{key} "Of {size}"

## Sizes

- first {name}
- second
  - inner {size}
- [x] done
- [ ] open

3. three
4. four

| Key | Size |
|-----|------|
| alpha | **beta** |
| a\|b | gamma |

> quoted {name}

> [!NOTE]
> note {brand}

```python
x = {size}
```

$$
a^{size}
$$

Inline $b_{size}$ math, H~2~O.

![alt {name}](img/{key}.png "{type}")

---
'''

BODY_AS_HTML = r'''<!DOCTYPE html>
<html>
<head>
<meta charset="utf-8">
<title>{name}</title>
</head>
<body>
<h1>{name}</h1>
<p>Intro of <b>{name}</b> with <i>{type}</i>, <s>old</s> and <code>code {name}</code>. See <a href="http://x.org/{key}" title="{type}">{brand}</a> or <a href="http://y.org/{key}">http://y.org/{key}</a>.</p>
<p>Ref <a href="http://r.org/{key}" title="Of {size}">link {brand}</a>, *escaped* {type}, © and a<br />
b, [{key}].</p>
<h2>Sizes</h2>
<ul>
<li>first {name}</li>
<li><p>second</p><ul>
<li>inner {size}</li>
</ul></li>
<li><input type="checkbox" disabled checked /> done</li>
<li><input type="checkbox" disabled /> open</li>
</ul>
<ol start="3">
<li>three</li>
<li>four</li>
</ol>
<table>
<thead><tr>
<th>Key</th>
<th>Size</th>
</tr></thead>
<tbody>
<tr>
<td>alpha</td>
<td><b>beta</b></td>
</tr>
<tr>
<td>a|b</td>
<td>gamma</td>
</tr>
</tbody>
</table>
<blockquote>
<p>quoted {name}</p>
</blockquote>
<blockquote class="alert alert-note">
<div class="alert-title">NOTE</div>
<p>note {brand}</p>
</blockquote>
<pre><code class="language-python">x = {size}</code></pre>
<div class="math block">$$
a^{size}
$$</div>
<p>Inline <span class="math inline">\(b_{size}\)</span> math, H~2~O.</p>
<p><img src="img/{key}.png" alt="alt {name}" title="{type}" /></p>
<hr />
</body>
</html>
'''

MARKDOWN_AS_TEXT = r'''{rule}
{name}
{rule}
Author: {brand}

{name}
{rule}

Intro of {name} with {type}, old and code {name}[1]. See {brand} (http://x.org/{key}) or http://y.org/{key}.

Ref link {brand} (http://r.org/{key}), *escaped* {type}, © and a
b, [{key}].

Sizes
-----

- first {name}
- second
  - inner {size}
- [x] done
- [ ] open

3. three
4. four

+-------+-------+
| Key   | Size  |
+=======+=======+
| alpha | beta  |
+-------+-------+
| a|b   | gamma |
+-------+-------+

> quoted {name}

> [!NOTE]
> note {brand}

    x = {size}

$$
a^{size}
$$

Inline $b_{size}$ math, H~2~O.

---

[1] Footnote {name}.
'''

MARKDOWN_AS_MARKDOWN = r'''---
title: "{name}"
author: "{brand}"
---

# {name}

Intro of **{name}** with _{type}_, ~~old~~ and `code {name}`[^1]. See [{brand}](http://x.org/{key} "{type}") or <http://y.org/{key}>.

Ref [link {brand}](http://r.org/{key} "Of {size}"), \*escaped\* {type}, © and a  
b, \[{key}\].

## Sizes

- first {name}
- second
    - inner {size}
- [x] done
- [ ] open

3. three
4. four

| Key | Size |
|---|---|
| alpha | **beta** |
| a\|b | gamma |

> quoted {name}

> [!NOTE]
> note {brand}

```python
x = {size}
```

$$
a^{size}
$$

Inline $b_{size}$ math, H\~2\~O.

![alt {name}](img/{key}.png "{type}")

---

[^1]: Footnote {name}.
'''

HTML = r'''<html><head><title>T {name}</title><style>p{x}</style></head><body>
<h1>About <em>{name}</em></h1>
<p>One <b>bold {name}</b> and <i>slanted</i><br>next line <a href="http://x.org/{key}" title="{type}">link {brand}</a>, <code>x = {size}</code>, <del>old</del>, H<sub>2</sub>O.
<p>Unclosed paragraph &amp; entity &eacute;</b>
<ul><li>first<li>second<ul><li>inner {size}</ul></ul>
<ol start=3><li>three</li><li>four</li></ol>
<ul><li><input type="checkbox" checked> done</li><li><input type="checkbox"> open</li></ul>
<table><caption>Sizes of {name}</caption><tr><th>Key<th>Size</tr><tr><td rowspan=2>{key}<td>{size}</tr><tr><td>{brand}</tr><tr><td colspan=2>{type}</td></tr></table>
<blockquote><p>quoted {name}</p></blockquote>
<pre><code class="language-python">x = {size}
y = 2</code></pre>
<figure><img src="img/{key}.png" alt="alt {name}"><figcaption>Figure of {brand}</figcaption></figure>
<hr>
loose text {key}
<script>no()</script></body></html>'''

HTML_AS_MARKDOWN = r'''# About _{name}_

One **bold {name}** and _slanted_  
next line [link {brand}](http://x.org/{key} "{type}"), `x = {size}`, ~~old~~, H<sub>2</sub>O.

Unclosed paragraph & entity é

- first
- second
    - inner {size}

3. three
4. four

- [x] done
- [ ] open

Table: Sizes of {name}

| Key | Size |
|---|---|
| {key} | {size} |
|  | {brand} |
| {type} |  |

> quoted {name}

```python
x = {size}
y = 2
```

![alt {name}](img/{key}.png)

Figure: Figure of {brand}

---

loose text {key}
'''

LATEX = r'''\documentclass{article}
\newcommand{\thing}[1]{\textbf{#1}}
\title{On {name}}
\author{A. Writer}
\begin{document}
\maketitle
\begin{abstract}
Short summary of {name}.
\end{abstract}
\section{First}\label{sec:{key}} % a comment
See \thing{{name}} and \emph{slanted} with ``quotes'' --- dash, caf\'e, 5\%.\footnote{Note {key}.}
\iffalse hidden \iftrue twice \fi never \fi
\subsection*{Parts}
\begin{itemize}
\item first {size}
\item second
\end{itemize}
\begin{enumerate}
\item one
\item two
\end{enumerate}
\begin{tabular}{ll}
\hline
Key & Size \\
\hline
{key} & {size} \\
\hline
\end{tabular}
\begin{equation}
a^{{size}} = b
\end{equation}
Inline $x_{{key}}$ and \verb|raw {name}| and \href{http://x.org/{key}}{link}.
\begin{verbatim}
x = {size}
\end{verbatim}
Cited \cite{{key}-a,b} and \ref{sec:{key}}.

\begin{quote}
quoted {name}
\end{quote}
\end{document}
'''

LATEX_AS_MARKDOWN = r'''---
title: "On {name}"
author: "A. Writer"
---

> [!IMPORTANT]
> **Abstract**  
> Short summary of {name}.

# First

\label{sec:{key}} See **{name}** and _slanted_ with “quotes” — dash, café, 5%.[^1]

## Parts

- first {size}
- second

1. one
2. two

| Key | Size |
|---|---|
| {key} | {size} |

$$
a^{{size}} = b
$$

Inline $x_{{key}}$ and `raw {name}` and [link](http://x.org/{key}).

```
x = {size}
```

Cited \cite{{key}-a,b} and \ref{sec:{key}}.

> quoted {name}

[^1]: Note {key}.
'''

TEXT = r'''===
On {name}
===
Author: A. Writer
Date: 2020-01-{key}

First
=====

Intro of {name}[1] and more.

Parts
-----

- first {size}
- second
  - inner

3. three
4. four

+----------+----------+
| Key      | Size     |
+==========+==========+
| {key:8} | {size:8} |
+----------+----------+

> quoted {name}

    x = {size}
    y = 2

$$
a^{size}
$$

---

[1] Note {key}.
'''

TEXT_AS_MARKDOWN = r'''---
title: "On {name}"
author: "A. Writer"
date: "2020-01-{key}"
---

# First

Intro of {name}[^1] and more.

## Parts

- first {size}
- second
    - inner

3. three
4. four

| Key | Size |
|---|---|
| {key} | {size} |

> quoted {name}

```
x = {size}
y = 2
```

$$
a^{size}
$$

---

[^1]: Note {key}.
'''

CSV = r'''Key,Name,Note
{key},{name},"a, ""b"" | c"
,{brand},
'''

CSV_AS_MARKDOWN = r'''| Key | Name | Note |
|---|---|---|
| {key} | {name} | a, "b" \| c |
|  | {brand} |  |
'''

CSV_AS_HTML = r'''<!DOCTYPE html>
<html>
<head>
<meta charset="utf-8">
<title>Document</title>
</head>
<body>
<table>
<thead><tr>
<th>Key</th>
<th>Name</th>
<th>Note</th>
</tr></thead>
<tbody>
<tr>
<td>{key}</td>
<td>{name}</td>
<td>a, &quot;b&quot; | c</td>
</tr>
<tr>
<td></td>
<td>{brand}</td>
<td></td>
</tr>
</tbody>
</table>
</body>
</html>
'''

CSV_AS_CSV = r'''Key,Name,Note{cr}
{key},{name},"a, ""b"" | c"{cr}
,{brand},{cr}
'''

#: Query, format and template of the source, format and template of the outcome.
CONVERSIONS = [
    ("markdown_parts_as_html", "markdown", BODY, "html", BODY_AS_HTML),
    ("markdown_parts_as_text", "markdown", MARKDOWN, "text", MARKDOWN_AS_TEXT),
    ("markdown_parts_as_markdown", "markdown", MARKDOWN, "markdown", MARKDOWN_AS_MARKDOWN),
    ("html_parts_as_markdown", "html", HTML, "markdown", HTML_AS_MARKDOWN),
    ("latex_parts_as_markdown", "latex", LATEX, "markdown", LATEX_AS_MARKDOWN),
    ("text_parts_as_markdown", "text", TEXT, "markdown", TEXT_AS_MARKDOWN),
    ("csv_parts_as_markdown", "csv", CSV, "markdown", CSV_AS_MARKDOWN),
    ("csv_parts_as_html", "csv", CSV, "html", CSV_AS_HTML),
    ("csv_parts_as_csv", "csv", CSV, "csv", CSV_AS_CSV),
]
