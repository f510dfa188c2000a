"""Scalar functions over text columns, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that code is full of.
KEYWORDS = (
    "if else for while return class function def import from include new null true false int str bool void float string var let const self this public "
    "private static extends implements try catch throw switch case break continue async await type interface enum struct div span href src id style echo "
    "print printf select where"
).split()
# Weights of the four signs of code, the threshold, punctuation that prose uses as much.
WEIGHTS = (0.35, 0.25, 0.20, 0.20)
THRESHOLD = 0.25
PROSE_PUNCTUATION = ".,?!-_*\"':"
ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"
CODE_PUNCTUATION = r"[#$%&()+/;<=>@\[\\\]^`{|}~]"

# In order, the languages of code and what its lower-cased text holds: of each group one string at least.
# ^ before a string: the text begins with it; $: it ends with it; !: it does not hold it.
LANGUAGES: list[tuple[str, tuple[tuple[str, ...], ...]]] = [
    ("latex", (("\\begin{", "\\documentclass", "\\usepackage"),)),
    ("html", (("<html>", "</div>", "<!doctype", "xmlns="),)),
    ("sql", (("select ",), ("from ",))),
    ("json", (("^{",), ("$}",), (":",))),
    ("php", (("<?php", "$this->"),)),
    ("python", (("def ", "import ", "print(", "elif "),)),
    ("rust", (("fn ", "let mut ", "impl "),)),
    ("go", (("package main", "func "),)),
    ("cpp", (("#include <", "std::", "cout << "),)),
    ("java", (("public class ", "using system;", "namespace ", "system.out.print", "console.write"), ("system.out.print", "public static void main"))),
    ("csharp", (("public class ", "using system;", "namespace ", "system.out.print", "console.write"),)),
    ("typescript", (("interface ",), (": string", ": number", "readonly "))),
    ("javascript", (("document.get", "const ", "let ", "function ", "console.log"),)),
    ("css", (("margin:",), ("padding:",), ("display:", "color:"))),
    ("yaml", (("^---",),)),
    ("yaml", (("\n  ",), (":",), ("!{",), ("![",))),
    ("powershell", (("get-", "write-host", "write-output", "write-error"),)),
    ("bash", (("pip install", "npm install", "git clone", "docker run", "cargo build", "echo ", "ls -l", "sudo ", "chmod ", "mkdir "),)),
]
#: Strings that begin with a sign of the table above and are meant as they are.
_PLAIN = ("$this->",)


def _rule(part: str) -> tuple[str, str]:
    """The sign of a string and what is looked for."""
    return ("", part) if part in _PLAIN or part[0] not in "^$!" else (part[0], part[1:])


def language_case(backslashes: int = 2) -> str:
    """The language guess as a SQL CASE over ``t``; DuckDB wants one backslash where Spark wants two."""

    def condition(part: str) -> str:
        sign, what = _rule(part)
        quoted = "'" + what.replace("\\", "\\" * backslashes) + "'"
        if "\n" in what:
            quoted = "(" + quoted.replace("\n", "' || chr(10) || '") + ")"
        return {"^": f"startswith(t, {quoted})", "$": f"endswith(t, {quoted})", "!": f"not contains(t, {quoted})"}.get(sign, f"contains(t, {quoted})")

    group = lambda g: "(" + " or ".join(map(condition, g)) + ")"
    body = " ".join(f"when {' and '.join(map(group, groups))} then '{name}'" for name, groups in LANGUAGES)
    return f"case {body} end"


def language_of(code: str) -> str | None:
    """The language guess of one text."""
    t = code.lower()

    def holds(part: str) -> bool:
        sign, what = _rule(part)
        return t.startswith(what) if sign == "^" else t.endswith(what) if sign == "$" else (what in t) != (sign == "!")

    return next((name for name, groups in LANGUAGES if all(any(map(holds, g)) for g in groups)), None)


def words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def code_measures(text: Column) -> dict[str, Column]:
    """Counts behind the four signs of code."""
    w = words(text)
    lines = F.filter(F.split(F.regexp_replace(text, r"\n$", ""), "\n"), lambda x: F.lit(True))
    bare = F.transform(w, lambda x: F.regexp_replace(F.lower(x), r"^[(){};:,.\"']+|[(){};:,.\"']+$", ""))
    camel = lambda x: x.rlike("[a-z][A-Z]") & (F.length(F.regexp_replace(x, f"^{ASCII_PUNCTUATION}+|{ASCII_PUNCTUATION}+$", "")) >= 4)
    odd = lambda x: camel(x) | (x.contains("_") & x.rlike("[a-z]")) | x.rlike("[a-z]-[a-z]")
    return {
        "n_words": F.size(w).cast("long"),
        "n_lines": F.when(text == "", 0).otherwise(F.size(lines)).cast("long"),
        "n_punctuation": F.regexp_count(text, F.lit(ASCII_PUNCTUATION)).cast("long"),
        "n_code_punctuation": F.regexp_count(text, F.lit(CODE_PUNCTUATION)).cast("long"),
        "n_keywords": F.size(F.filter(bare, lambda x: x.isin(*KEYWORDS))).cast("long"),
        "n_odd_case": F.size(F.filter(w, odd)).cast("long"),
        "n_indented": F.size(F.filter(lines, lambda x: x.rlike(r"^(\t+| {2,})") & (F.trim(x, F.lit(" \t\r\x0b\x0c")) != ""))).cast("long"),
    }


def code_score(threshold: float = THRESHOLD) -> dict[str, Column]:
    """score and is_code from the columns of ``code_measures``."""
    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    s1, s2 = F.least(F.col("n_punctuation") / n, F.lit(1.0)), F.col("n_keywords") / n
    s3, s4 = F.col("n_odd_case") / n, F.col("n_indented") / lines
    total = s1 * WEIGHTS[0] + s2 * WEIGHTS[1] + s3 * WEIGHTS[2] + s4 * WEIGHTS[3]
    strong = F.when((F.least(F.col("n_code_punctuation") / n, F.lit(1.0)) > 0.7) | (s4 > 0.8), F.greatest(total, F.lit(0.6))).otherwise(total)
    score = F.when((F.col("n_keywords") == 0) & (F.col("n_odd_case") == 0), F.greatest(F.lit(0.0), strong - 0.15)).otherwise(strong)
    return {"score": score, "is_code": score > threshold}


def escape_html(text: Column) -> Column:
    """Text in HTML."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_latex(text: Column) -> Column:
    """Text in LaTeX.

    What stands between backslashes is escaped by itself, braces first, so
    that no replacement is escaped again.
    """
    from ..plans.render import LATEX_ESCAPES

    def piece(part: Column) -> Column:
        for c in sorted(LATEX_ESCAPES, key=lambda c: c not in "{}"):
            if c != "\\":
                part = F.replace(part, F.lit(c), F.lit(LATEX_ESCAPES[c]))
        return part

    return F.array_join(F.transform(F.split(text, r"\\", -1), piece), LATEX_ESCAPES["\\"])


def safe_href(url: Column) -> Column:
    """``#`` for a URL whose scheme runs code or holds data, as a browser reads it.

    Browsers drop tabs and line ends anywhere, and control characters and spaces before a URL.
    """
    from ..plans.render import UNSAFE_SCHEMES

    read = F.regexp_replace(F.regexp_replace(url, r"[\t\n\r]", ""), r"^[\x00-\x20]+", "")
    return F.when(F.lower(F.regexp_extract(read, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin(*UNSAFE_SCHEMES), F.lit("#")).otherwise(url)


def sheet_name(text: Column) -> Column:
    """A spreadsheet's sheet name from a heading: invalid characters become spaces, 31 characters at most."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\[\]:*?/\\]", " "), r"\s+", " "))
    return F.when(clean == "", F.lit("Sheet")).otherwise(F.substring(clean, 1, 31))


def markdown_cell(text: Column) -> Column:
    """Text in a Markdown table cell."""
    return F.trim(F.replace(F.regexp_replace(F.replace(text, F.lit("\n"), F.lit("<br>")), "[ \t]+", " "), F.lit("|"), F.lit("\\|")))


def csv_cell(text: Column) -> Column:
    """A value of a CSV row, quoted where needed."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike("[\",\r\n]"), quoted).otherwise(text)


def format_number(value: Column) -> Column:
    """A number as a cell shows it: whole ones without a fraction."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(value.isNull(), "").when(whole, value.cast("decimal(20,0)").cast("string")).otherwise(value.cast("string"))


def typed_cell(text: Column) -> Column:
    """The kind of a cell's text: only what formats back to the same text is more than text."""
    decimal = text.rlike(r"^-?(0|[1-9]\d{0,14})\.\d*[1-9]$")
    date = text.rlike(r"^\d{4}-\d\d-\d\d$") & text.try_cast("date").isNotNull()
    stamp = text.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$") & text.try_cast("timestamp").isNotNull()
    time = text.rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d$")
    return (
        F.when(text == "", "empty").when(text.isin("TRUE", "FALSE"), "boolean").when(text.rlike(r"^-?(0|[1-9]\d{0,14})$"), "number").when(decimal, "number")
        .when(date, "date").when(stamp, "datetime").when(time, "time").otherwise("text")
    )
