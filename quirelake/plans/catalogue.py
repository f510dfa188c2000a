"""The registered queries of the document engine, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, text
from ..operators import blocks, tree
from ..schema import node_schema
from ..sources.reader import parse_df
from ..storage import shared_folder
from . import office, relations, templates
from .convert import Options, convert_df, render_df
from .render import LATEX_ESCAPES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _page_nodes(spark: SparkSession, sf_dir: str, *, extract: bool) -> DataFrame:
    return parse_df(_table(spark, sf_dir, "pages"), "html", id_col="page_id", text_col="html", url_col="url", extract=extract)


#: Character references of the pages as HTML reads them in text: the semicolon may be missing.
_DECODED = "{0}"
for _name, _char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("gt", ">"), ("lt", "<"), ("amp", "&")):
    _DECODED = f"regexp_replace({_DECODED}, '&{_name};?', '{_char}', 'g')"


@query(
    f"""
WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS body FROM pages)
SELECT page_id, {_DECODED.format("trim(regexp_extract(body, '<h1>(.*?)</h1>', 1))")} AS title,
  len(regexp_extract_all(body, '<p>'))::BIGINT AS n_paragraphs, len(regexp_extract_all(body, '<h[1-6]>'))::BIGINT AS n_headings,
  len(regexp_extract_all(body, '<a '))::BIGINT AS n_links FROM a"""
)
def page_article_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and counts of the main content of every page."""
    nodes = _page_nodes(spark, sf_dir, extract=True)
    counts = tree.node_counts(nodes, id_col="page_id")
    titles = tree.plain_text(nodes, ("Heading",), id_col="page_id").groupBy("page_id").agg(F.min_by("text", "node_id").alias("title"))
    return counts.join(titles, "page_id").select("page_id", "title", "n_paragraphs", "n_headings", "n_links")


@query("SELECT page_id, len(regexp_extract_all(html, '<a href='))::BIGINT AS n_links, 0::BIGINT AS n_after FROM pages")
def links_discarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of whole pages, before and after they are replaced by their content."""
    nodes = _page_nodes(spark, sf_dir, extract=False)
    after = tree.discard_links(nodes, id_col="page_id")
    count = lambda df, name: df.groupBy("page_id").agg(F.count(F.when(F.col("type") == "Link", 1)).alias(name))
    return count(nodes, "n_links").join(count(after, "n_after"), "page_id")


@query(
    r"""
SELECT page_id, "at", CASE WHEN lower(regexp_extract(regexp_replace(translate(url, chr(9) || chr(10) || chr(13), ''), '^[\x00-\x20]+', ''), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('javascript', 'vbscript', 'data') THEN '#' ELSE url END AS url
FROM (SELECT page_id, generate_subscripts(urls, 1) - 1 AS "at", unnest(urls) AS url
  FROM (SELECT page_id, list_concat([url, ' JavaScript:x', 'data:text/html,x', 'mailto:a@b', 'java' || chr(9) || 'script:x', chr(1) || 'vb' || chr(10) || 'script:x'], regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS urls FROM pages))"""
)
def safe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages and some unsafe ones, neutralized."""
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    urls = F.concat(F.array("url", F.lit(" JavaScript:x"), F.lit("data:text/html,x"), F.lit("mailto:a@b"), F.lit("java\tscript:x"), F.lit("\x01vb\nscript:x")), found)
    exploded = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(urls).alias("at", "url"))
    return exploded.select("page_id", F.col("at").cast("long").alias("at"), text.safe_href(F.col("url")).alias("url"))


def _code_measures_sql() -> str:
    keywords = ", ".join(f"'{k}'" for k in text.KEYWORDS)
    return rf"""
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, CASE WHEN text = '' THEN 0 ELSE len(l) END::BIGINT AS n_lines,
  len(regexp_extract_all(text, '[!-/:-@\[-`{{-~]'))::BIGINT AS n_punctuation,
  len(regexp_extract_all(text, '[#$%&()+/;<=>@\[\\\]^`{{|}}~]'))::BIGINT AS n_code_punctuation,
  len(list_filter(w, lambda x: regexp_replace(regexp_replace(lower(x), '^[(){{}};:,."'']+', ''), '[(){{}};:,."'']+$', '') IN ({keywords})))::BIGINT AS n_keywords,
  len(list_filter(w, lambda x: (regexp_matches(x, '[a-z][A-Z]') AND length(regexp_replace(regexp_replace(x, '^[!-/:-@\[-`{{-~]+', ''), '[!-/:-@\[-`{{-~]+$', '')) >= 4)
    OR (contains(x, '_') AND regexp_matches(x, '[a-z]')) OR regexp_matches(x, '[a-z]-[a-z]')))::BIGINT AS n_odd_case,
  len(list_filter(l, lambda x: regexp_matches(x, '^(\t+| {{2,}})') AND trim(x, chr(9) || ' ' || chr(13) || chr(11) || chr(12)) <> ''))::BIGINT AS n_indented FROM w)"""


@query(f"WITH {_code_measures_sql()} SELECT * FROM m")
def code_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts behind the code score of every document."""
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", *[c.alias(k) for k, c in text.code_measures(F.col("text")).items()])


_SCORE_SQL = """
s AS (SELECT *, greatest(n_words, 1) AS nw, greatest(n_lines, 1) AS nl FROM m),
t AS (SELECT *, least(n_punctuation / nw, 1.0::DOUBLE) * 0.35::DOUBLE + n_keywords / nw * 0.25::DOUBLE + n_odd_case / nw * 0.20::DOUBLE + n_indented / nl * 0.20::DOUBLE AS total FROM s),
u AS (SELECT *, CASE WHEN least(n_code_punctuation / nw, 1.0::DOUBLE) > 0.7::DOUBLE OR n_indented / nl > 0.8::DOUBLE THEN greatest(total, 0.6::DOUBLE) ELSE total END AS strong FROM t),
v AS (SELECT *, CASE WHEN n_keywords = 0 AND n_odd_case = 0 THEN greatest(0.0::DOUBLE, strong - 0.15::DOUBLE) ELSE strong END AS score FROM u)"""


@query(f"WITH {_code_measures_sql()}, {_SCORE_SQL} SELECT doc_id, round(score, 9) AS score, score > 0.25::DOUBLE AS is_code FROM v")
def code_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code score and verdict of every document."""
    flagged = code_metrics(spark, sf_dir).withColumns(text.code_score())
    return flagged.select("doc_id", F.round("score", 9).alias("score"), "is_code")


@query(
    f"""WITH {_code_measures_sql()}, {_SCORE_SQL}
SELECT quality, count(*)::BIGINT AS n, count(*) FILTER (WHERE score > 0.25::DOUBLE)::BIGINT AS n_code FROM v JOIN labels USING (doc_id) GROUP BY quality"""
)
def quality_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that look like code, by their quality label."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    return code_flags(spark, sf_dir).join(labels, "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_code"), 1)).alias("n_code"))


@query(
    f"""SELECT kind, id, {text.language_case(1).replace("startswith(", "starts_with(").replace("endswith(", "ends_with(")} AS language FROM (
SELECT 'document' AS kind, doc_id AS id, lower(text) AS t FROM documents
UNION ALL SELECT 'turn', conv_id * 1000 + turn, lower(text) FROM conversations
UNION ALL SELECT 'example', * FROM (VALUES (1, 'def f(): pass'), (2, '#include <x>'), (3, '{{"a": 1}}'), (4, 'select a from b'), (5, 'sudo ls'), (6, 'let x = 1;'), (7, '\\begin{{x}}')))"""
)
def guess_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The programming language that a text would be in."""
    docs = _table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    turns = _table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    samples = ["def f(): pass", "#include <x>", '{"a": 1}', "select a from b", "sudo ls", "let x = 1;", "\\begin{x}"]
    examples = spark.createDataFrame([("example", i, s) for i, s in enumerate(samples, 1)], "kind string, id long, text string")
    every = docs.unionByName(turns).unionByName(examples).withColumn("t", F.lower("text"))
    return every.select("kind", "id", F.expr(text.language_case(2)).alias("language"))


_LINES = "lines AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS \"at\", unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))"


@query(
    rf"""WITH {_LINES},
k AS (SELECT *, CASE WHEN trim(line, ' ') = '' THEN 'blank' WHEN regexp_matches(line, '^(    | {{0,3}}\t)') THEN 'code'
  WHEN regexp_matches(trim(line, ' '), '^(-{{3,}}|\*{{3,}}|_{{3,}}|={{3,}})$') THEN 'rule' WHEN starts_with(trim(line, ' '), '>') THEN 'quote'
  WHEN regexp_matches(trim(line, ' '), '^([-*+•]|[0-9]{{1,9}}[.)])\s') THEN 'list' WHEN contains(line, '|') THEN 'table' ELSE 'paragraph' END AS kind FROM lines),
s AS (SELECT *, CASE WHEN lag(kind) OVER w IS NOT DISTINCT FROM kind THEN 0 ELSE 1 END AS starts FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY "at")),
r AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY "at") AS block FROM s)
SELECT doc_id, block::BIGINT AS block, kind, min("at")::BIGINT AS first_line, count(*)::BIGINT AS n_lines, sum(length(line))::BIGINT AS n_chars
FROM r WHERE kind <> 'blank' GROUP BY doc_id, block, kind"""
)
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines of one kind in every document."""
    return blocks.blocks_of(_table(spark, sf_dir, "documents"))


@query(
    rf"""WITH {_LINES},
p AS (SELECT doc_id, length(rtrim(line, ' ')) AS wide, line, lead(line) OVER (PARTITION BY doc_id ORDER BY "at") AS next FROM lines),
q AS (SELECT doc_id, wide, length(regexp_extract(rtrim(next, ' '), '^\s*(\S+)', 1)) AS word FROM p WHERE trim(line, ' ') <> '' AND trim(next, ' ') <> ''),
x AS (SELECT doc_id, max(wide) FILTER (WHERE wide <= 100) AS width FROM q GROUP BY doc_id),
y AS (SELECT doc_id, width::BIGINT AS width, count(*)::BIGINT AS n_pairs, count(*) FILTER (WHERE wide + 1 + word > width)::BIGINT AS n_full FROM q JOIN x USING (doc_id) GROUP BY ALL)
SELECT *, coalesce(width >= 50 AND n_full >= 3 AND 2 * n_full >= n_pairs, false) AS wrapped FROM y"""
)
def wrapped_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the lines of every document are cut at a width."""
    return blocks.wrap_statistics(_table(spark, sf_dir, "documents"))


@query("SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM documents")
def escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as HTML text."""
    return _table(spark, sf_dir, "documents").select("doc_id", text.escape_html(F.col("text")).alias("html"))


def _latex_sql() -> str:
    """Character by character, unlike the columns' way."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"WHEN {quoted(c)} THEN {quoted(r)}" for c, r in LATEX_ESCAPES.items())
    return f"array_to_string(list_transform(string_split(text, ''), lambda c: CASE c {cases} ELSE c END), '')"


@query(f"SELECT doc_id, {_latex_sql()} AS latex FROM documents")
def escape_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as LaTeX text."""
    return _table(spark, sf_dir, "documents").select("doc_id", text.escape_latex(F.col("text")).alias("latex"))


@query("SELECT doc_id, sha1(coalesce(text, '')) AS digest, min(doc_id) OVER (PARTITION BY sha1(coalesce(text, ''))) AS first_id FROM documents")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document with each content."""
    return blocks.content_dedup(_table(spark, sf_dir, "documents"))


@query(
    rf"""WITH {_LINES},
p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_at FROM lines)
SELECT p.doc_id, "at"::BIGINT AS "at", substring(text, greatest(0, begin_at - 500) + 1, begin_at - greatest(0, begin_at - 500)) AS before, substring(text, begin_at + length(line) + 1, 500) AS after
FROM p JOIN documents d ON p.doc_id = d.doc_id WHERE regexp_matches(line, '[Ll]icen[sc]e')"""
)
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 characters on either side of every line about licenses."""
    return blocks.contexts(_table(spark, sf_dir, "documents"), "[Ll]icen[sc]e")


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as headings of documents: a brand is a document, a size gives the level."""
    return _table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("node_id"), (F.col("p_size") % 4 + 1).cast("int").alias("level"),
        (F.col("p_partkey") % 7 != 0).alias("numbered"), F.col("p_name").alias("heading"), F.col("p_type").alias("kind"),
    )


_HEADINGS = "h AS (SELECT p_brand AS doc_id, p_partkey AS node_id, (p_size % 4 + 1)::INT AS level, p_partkey % 7 <> 0 AS numbered, p_name AS heading, p_type AS kind FROM part)"


@query(
    f"""WITH {_HEADINGS}, n AS (SELECT * FROM h WHERE numbered),
s AS (SELECT *, {", ".join(f"coalesce(max(CASE WHEN level < {k} THEN node_id END) OVER (PARTITION BY doc_id ORDER BY node_id), -1) AS s{k}" for k in (2, 3, 4))} FROM n),
c AS (SELECT *, count(*) FILTER (WHERE level = 1) OVER (PARTITION BY doc_id ORDER BY node_id) AS n1,
  {", ".join(f"count(*) FILTER (WHERE level = {k}) OVER (PARTITION BY doc_id, s{k} ORDER BY node_id) AS n{k}" for k in (2, 3, 4))} FROM s)
SELECT doc_id, node_id, level, CASE level WHEN 1 THEN n1::VARCHAR WHEN 2 THEN n1 || '.' || n2 WHEN 3 THEN n1 || '.' || n2 || '.' || n3 ELSE n1 || '.' || n2 || '.' || n3 || '.' || n4 END AS number FROM c"""
)
def section_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of sections."""
    return tree.section_numbers(_headings(spark, sf_dir)).select("doc_id", "node_id", "level", "number")


@query(
    f"""WITH {_HEADINGS}, r AS (SELECT doc_id, node_id, CASE WHEN level = 1 THEN heading END AS heading FROM h)
SELECT doc_id, node_id, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM r"""
)
def nearest_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last top heading above every row."""
    rows = _headings(spark, sf_dir).withColumn("heading", F.when(F.col("level") == 1, F.col("heading")))
    return tree.nearest_above(rows).select("doc_id", "node_id", "above")


@query(
    f"""WITH {_HEADINGS}, b AS (SELECT doc_id, node_id, level, kind FROM h),
d AS (SELECT * FROM b WHERE lower(trim(kind)) IN (SELECT min(lower(p_type)) FROM part UNION ALL SELECT max(lower(p_type)) FROM part))
SELECT doc_id, node_id FROM b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = b.doc_id AND d.node_id <= b.node_id
  AND NOT EXISTS (SELECT 1 FROM b c WHERE c.doc_id = b.doc_id AND c.node_id > d.node_id AND c.node_id <= b.node_id AND c.level <= d.level))"""
)
def section_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks outside the sections with two titles."""
    rows = _headings(spark, sf_dir).withColumn("heading", F.col("kind"))
    low, high = _table(spark, sf_dir, "part").agg(F.min(F.lower("p_type")), F.max(F.lower("p_type"))).first()
    return tree.prune_sections(rows, (low, high)).select("doc_id", "node_id")


@query(
    """WITH n AS (SELECT n_regionkey AS doc_id, n_nationkey::BIGINT AS node_id, 'A/B ' || substr(n_name, 1, 1) AS heading FROM nation),
c AS (SELECT *, trim(regexp_replace(regexp_replace(heading, '[\\[\\]:*?/\\\\]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY node_id) AS k FROM c)
SELECT doc_id, node_id, CASE WHEN k = 1 THEN name ELSE substr(name, 1, 31 - length(' (' || k || ')')) || ' (' || k || ')' END AS sheet FROM k"""
)
def sheet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique sheet names from headings."""
    rows = _table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").cast("long").alias("node_id"), F.concat(F.lit("A/B "), F.substring("n_name", 1, 1)).alias("heading")
    )
    named = rows.withColumn("name", text.sheet_name(F.col("heading")))
    return tree.unique_names(named, "name").select("doc_id", "node_id", F.col("unique_name").alias("sheet"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as ragged tables, one for each region: a header, then name and key, the name alone for odd keys."""
    nation = _table(spark, sf_dir, "nation")
    values = F.when(F.col("n_nationkey") % 2 == 1, F.array("n_name")).otherwise(F.array("n_name", F.concat(F.lit('a "b", |'), F.col("n_nationkey").cast("string"))))
    body = nation.select(F.col("n_regionkey").alias("doc_id"), (F.col("n_nationkey") + 1).alias("row"), F.posexplode(values).alias("col", "text"))
    head = _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc_id"), F.lit(0).alias("row"), F.posexplode(F.array(F.lit("Nation"), F.lit("Key"), F.col("r_name"))).alias("col", "text"))
    return body.unionByName(head)


_ROWS = """r AS (SELECT r_regionkey AS doc_id, 0 AS row, ['Nation', 'Key', r_name] AS cells FROM region UNION ALL
SELECT n_regionkey, n_nationkey + 1, CASE WHEN n_nationkey % 2 = 1 THEN [n_name, '', ''] ELSE [n_name, 'a "b", |' || n_nationkey, ''] END FROM nation)"""


@query(f"WITH {_ROWS} SELECT doc_id, row, array_to_string(cells, chr(9)) AS cells FROM r")
def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged tables padded to their widest row."""
    return blocks.padded_tables(_cells(spark, sf_dir)).select("doc_id", "row", F.array_join("cells", "\t").alias("cells"))


@query(
    f"""WITH {_ROWS}, l AS (SELECT doc_id, row, array_to_string(list_transform(cells, lambda c: CASE WHEN regexp_matches(c, '[",]') THEN '"' || replace(c, '"', '""') || '"' ELSE c END), ',') AS line FROM r)
SELECT doc_id, string_agg(line, chr(13) || chr(10) ORDER BY row) || chr(13) || chr(10) AS csv FROM l GROUP BY doc_id"""
)
def table_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as CSV."""
    return blocks.csv_of_tables(blocks.padded_tables(_cells(spark, sf_dir)))


@query(
    f"""WITH {_ROWS}, l AS (SELECT doc_id, row, '| ' || array_to_string(list_transform(cells, lambda c: trim(replace(c, '|', '\\|'))), ' | ') || ' |' || CASE WHEN row = 0 THEN chr(10) || '| --- | --- | --- |' ELSE '' END AS line FROM r)
SELECT doc_id, string_agg(line, chr(10) ORDER BY row) AS markdown FROM l GROUP BY doc_id"""
)
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as Markdown."""
    return blocks.markdown_of_tables(blocks.padded_tables(_cells(spark, sf_dir)))


_SAMPLES = ["", "TRUE", "true", "7", "007", "-3", "1,5", "1.50", "1.5", "0.25", "2024-02-29", "2023-02-29", "2024-01-01 10:20:30", "23:59:59", "25:00:00", "x", "1e5", "-0"]


@query(
    rf"""WITH c AS (SELECT 'sample' AS kind, v.id::BIGINT AS id, v.text FROM (VALUES {", ".join(f"({i}, '{s}')" for i, s in enumerate(_SAMPLES))}) AS v(id, text)
UNION ALL SELECT 'supplier', s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey::VARCHAR WHEN 1 THEN s_name ELSE '0' || s_suppkey END FROM supplier)
SELECT *, CASE WHEN text = '' THEN 'empty' WHEN text IN ('TRUE', 'FALSE') THEN 'boolean' WHEN regexp_matches(text, '^-?(0|[1-9]\d{{0,14}})(\.\d*[1-9])?$') THEN 'number'
  WHEN regexp_matches(text, '^\d{{4}}-\d\d-\d\d$') AND try_cast(text AS DATE) IS NOT NULL THEN 'date'
  WHEN regexp_matches(text, '^\d{{4}}-\d\d-\d\d \d\d:\d\d:\d\d$') AND try_cast(text AS TIMESTAMP) IS NOT NULL THEN 'datetime'
  WHEN regexp_matches(text, '^([01]\d|2[0-3]):[0-5]\d:[0-5]\d$') THEN 'time' ELSE 'text' END AS cell_type FROM c"""
)
def typed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of cell texts."""
    samples = spark.createDataFrame([("sample", i, s) for i, s in enumerate(_SAMPLES)], "kind string, id long, text string")
    key = F.col("s_suppkey")
    shown = F.when(key % 3 == 0, key.cast("string")).when(key % 3 == 1, F.col("s_name")).otherwise(F.concat(F.lit("0"), key.cast("string")))
    suppliers = _table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), key.alias("id"), shown.alias("text"))
    return samples.unionByName(suppliers).withColumn("cell_type", text.typed_cell(F.col("text")))


@query(
    """SELECT s_nationkey AS sheet, 'D' AS col, row::BIGINT AS row, replace('=B{r}*$A$1', '{r}', row::VARCHAR) AS formula
FROM (SELECT s_nationkey, unnest(range(min(s_suppkey), max(s_suppkey) + 1)) AS row FROM supplier GROUP BY s_nationkey)"""
)
def formula_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula for every cell of a range."""
    ranges = _table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("sheet")).agg(F.min("s_suppkey").alias("first"), F.max("s_suppkey").alias("last"))
    return blocks.expand_formulas(ranges.select("sheet", F.lit("D").alias("col"), "first", "last", F.lit("=B{r}*$A$1").alias("formula")))


@query(
    """WITH c AS (SELECT s_nationkey % 5 AS sheet, s_suppkey AS row FROM supplier), r AS (SELECT *, row - row_number() OVER (PARTITION BY sheet ORDER BY row) AS run FROM c)
SELECT sheet, 'C' AS col, min(row)::BIGINT AS "first", max(row)::BIGINT AS "last", '=A{r}+B$2' AS formula FROM r GROUP BY sheet, run"""
)
def formula_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one formula as ranges."""
    cells = _table(spark, sf_dir, "supplier").select(
        (F.col("s_nationkey") % 5).alias("sheet"), F.lit("C").alias("col"), F.col("s_suppkey").alias("row"), F.concat(F.lit("=A"), F.col("s_suppkey").cast("string"), F.lit("+B$2")).alias("formula")
    )
    return blocks.compress_formulas(cells).select("sheet", "col", "first", "last", "formula")


@query(
    """WITH s AS (SELECT p_brand AS brand, p_size AS size, sum(length(p_name)) AS w, min(p_partkey) AS "at" FROM part GROUP BY ALL)
SELECT brand, arg_max(size, w * 1000000000 - "at") AS dominant FROM s GROUP BY brand"""
)
def dominant_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of most characters, as a dominant font is found."""
    rows = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.length("p_name").alias("w"), F.col("p_partkey").alias("at"))
    return blocks.dominant(rows, "brand", "size", "w", "at")


@query(
    """WITH n AS (SELECT n_regionkey AS doc_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS number, n_name AS note FROM nation),
m AS (SELECT doc_id, number, unnest([number * 10, number * 10 + 5]) AS "at" FROM n WHERE NOT (doc_id = 2 AND number = 1))
SELECT n.doc_id, min("at")::BIGINT AS "at", n.number::BIGINT AS number, note FROM n JOIN m ON n.doc_id = m.doc_id AND n.number = m.number WHERE n.doc_id <> 2 GROUP BY ALL"""
)
def notes_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes at their first marks; one document lacks a mark and keeps its text."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).cast("long")
    notes = _table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc_id"), number.alias("number"), F.col("n_name").alias("note"))
    marks = notes.where("not (doc_id = 2 and number = 1)").select("doc_id", "number", F.explode(F.array(F.col("number") * 10, F.col("number") * 10 + 5)).alias("at"))
    return tree.place_notes(marks, notes)


_PATHS = ["a/b.MD", "x.tar.html", "y", "z.tex", "w.xlsx", "dir.txt/none", "p.jpeg"]
_TYPES = ["text/html; charset=utf-8", "image/png", "application/pdf", "text/plain", "TEXT/CSV", "application/xhtml+xml", "image"]


def _format_case(kind: str) -> str:
    whens = []
    for name, extensions, _, _, types in formats.INPUTS:
        if kind == "path":
            whens.append(f"WHEN lower(regexp_extract(x, '(\\.[^./\\\\]+)$', 1)) IN ({', '.join(map(repr, extensions))}) THEN '{name}'")
        whens += [f"WHEN {f'starts_with(b, {t!r})' if t.endswith('/') else f'b = {t!r}'} THEN '{name}'" for t in types if kind != "path"]
    return f"CASE {' '.join(whens)} END"


@query(
    f"""SELECT 'path' AS kind, x AS value, {_format_case("path")} AS format FROM (SELECT unnest({_PATHS}) AS x)
UNION ALL SELECT 'media type', x, {_format_case("type")} FROM (SELECT x, lower(trim(string_split(x, ';')[1])) AS b FROM (SELECT unnest({_TYPES}) AS x))
UNION ALL SELECT 'path', url, {_format_case("path").replace("(x,", "(url,")} FROM pages"""
)
def format_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of paths and media types."""
    urls = _table(spark, sf_dir, "pages").select(F.col("url").alias("value"))
    paths = spark.createDataFrame([(p,) for p in _PATHS], "value string").unionByName(urls)
    types = spark.createDataFrame([(t,) for t in _TYPES], "value string")
    by_path = paths.select(F.lit("path").alias("kind"), "value", formats.format_of_path(F.col("value")).alias("format"))
    return by_path.unionByName(types.select(F.lit("media type").alias("kind"), "value", formats.format_of_media_type(F.col("value")).alias("format")))


@query(
    f"""SELECT asked, source, target, CASE WHEN asked <> 'auto' THEN asked WHEN source IN ('image', 'latex') THEN 'transcribe' WHEN target IN ('csv', 'text') THEN 'discard' ELSE 'keep' END AS handling,
  output, asked <> 'auto' AS required
FROM (SELECT unnest({list(formats.HANDLINGS)}) AS asked), (SELECT unnest({[f[0] for f in formats.INPUTS]}) AS source),
  (VALUES {", ".join(f"('{f[0]}', {repr(f[3][0]) if f[3] else 'NULL'})" for f in formats.OUTPUTS)}) AS o(target, output)"""
)
def image_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How images are handled for every source and target."""
    return formats.image_plan(spark)


@query(
    """WITH b AS (SELECT n_regionkey AS page_id, n_nationkey AS block_id, (n_nationkey % 3)::DOUBLE AS x0, (n_nationkey % 2)::DOUBLE AS y0, (n_nationkey % 3 + 1 + n_nationkey % 5)::DOUBLE AS x1, (n_nationkey % 2 + 2)::DOUBLE AS y1 FROM nation),
p AS (SELECT a.page_id, a.block_id AS "inner", c.block_id AS "outer", (a.x1 - a.x0) * (a.y1 - a.y0) AS s, (c.x1 - c.x0) * (c.y1 - c.y0) AS t,
  greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS o FROM b a JOIN b c ON a.page_id = c.page_id AND a.block_id <> c.block_id)
SELECT page_id, "inner", "outer" FROM p WHERE o / s >= 0.8::DOUBLE AND (t > s OR t = s AND "outer" < "inner")"""
)
def block_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks inside other blocks of a page."""
    k = F.col("n_nationkey")
    d = lambda c: c.cast("double")
    box = F.struct(d(k % 3).alias("x0"), d(k % 2).alias("y0"), d(k % 3 + 1 + k % 5).alias("x1"), d(k % 2 + 2).alias("y1"))
    rows = _table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("page_id"), k.alias("block_id"), box.alias("box"))
    return blocks.containment(rows)


@query(
    f"""SELECT page_id, {_DECODED.format("trim(regexp_extract(html, '<title>(.*?)</title>', 1))")} AS title FROM pages"""
)
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first heading of whole pages without their own: the page title takes its place."""
    pages = _table(spark, sf_dir, "pages").withColumn("html", F.regexp_replace("html", "(?s)<h1>.*?</h1>", ""))
    nodes = parse_df(pages, "html", id_col="page_id", text_col="html")
    return tree.plain_text(nodes, ("Heading",), id_col="page_id").groupBy("page_id").agg(F.min_by("text", "node_id").alias("title"))


@query(
    r"""SELECT page_id, host = 'wikipedia.org' OR ends_with(host, '.wikipedia.org') OR contains(left(html, 50000), 'class="mediawiki') OR contains(left(html, 50000), 'id="mw-content-text"') AS wiki
FROM (SELECT page_id, html, lower(regexp_extract(CASE WHEN page_id % 5 = 0 THEN 'https://de.wikipedia.org/wiki/X' ELSE url END, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages)"""
)
def site_profile_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of encyclopedias, by host or fingerprint; every fifth page gets such an address."""
    url = F.when(F.col("page_id") % 5 == 0, "https://de.wikipedia.org/wiki/X").otherwise(F.col("url"))
    host = F.lower(F.regexp_extract(url, "^[a-z]+://([^/:?#]+)", 1))
    head = F.substring("html", 1, 50000)
    wiki = (host == "wikipedia.org") | host.endswith(".wikipedia.org") | head.contains('class="mediawiki') | head.contains('id="mw-content-text"')
    return _table(spark, sf_dir, "pages").select("page_id", wiki.alias("wiki"))


def _converted(to: str, extract: bool = True) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return convert_df(_table(spark, sf_dir, "pages"), "html", to, Options(extract_html=extract), id_col="page_id", text_col="html", url_col="url")

    run.__name__, run.__doc__ = f"{to}_of_pages", f"The main content of every page as {to}."
    return query()(run)


for _to in ("markdown", "html", "text", "latex", "json"):
    _converted(_to)


@query()
def documents_as_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, read as plain text, as Markdown."""
    return convert_df(_table(spark, sf_dir, "documents"), "text", "markdown")


@query()
def conversations_as_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn, read as Markdown, as HTML."""
    turns = _table(spark, sf_dir, "conversations").withColumn("turn_id", F.col("conv_id") * 1000 + F.col("turn"))
    return convert_df(turns, "markdown", "html", id_col="turn_id")


@query("SELECT page_id, true AS same FROM pages")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of pages through JSON and back, compared as node tables."""
    nodes = _page_nodes(spark, sf_dir, extract=True)
    again = parse_df(json_of_nodes(nodes), "json", id_col="page_id", text_col="rendered")
    key = lambda df: df.groupBy("page_id").agg(F.sum(F.xxhash64(*[f.name for f in node_schema("page_id").fields]).cast("decimal(38,0)")).alias("h"), F.count("*").alias("n"))
    a, b = key(nodes), key(again).withColumnsRenamed({"h": "h2", "n": "n2"})
    return a.join(b, "page_id").select("page_id", ((F.col("h") == F.col("h2")) & (F.col("n") == F.col("n2"))).alias("same"))


def json_of_nodes(nodes: DataFrame) -> DataFrame:
    """page_id and rendered JSON of a node table of pages."""
    return render_df(nodes, "json", id_col="page_id")


@query("SELECT page_id, true AS same FROM pages")
def markdown_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown, read and written again: nothing changes."""
    once = markdown_of_pages(spark, sf_dir)
    twice = convert_df(once, "markdown", "markdown", id_col="page_id", text_col="converted").withColumnRenamed("converted", "again")
    return once.join(twice.select("page_id", "again"), "page_id").select("page_id", (F.col("converted") == F.col("again")).alias("same"))


markdown_of_pages = QUERIES["markdown_of_pages"]


@query("SELECT page_id, true AS same FROM pages")
def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages converted by a stream and by a batch, compared."""
    import uuid

    from ..streaming.convert import run_available

    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    columns = {"id_col": "page_id", "text_col": "html", "url_col": "url"}
    run_available(spark, sf_dir, "pages.parque[t]", f"{out}/data", f"{out}/state", "html", "markdown", Options(extract_html=True), **columns).awaitTermination()
    streamed = spark.read.parquet(f"{out}/data").select("page_id", F.col("converted").alias("streamed"))
    return markdown_of_pages(spark, sf_dir).join(streamed, "page_id").select("page_id", (F.col("converted") == F.col("streamed")).alias("same"))


def _template_query(name: str, from_format: str, source: str, to_format: str, expected: str) -> None:
    """Registers a conversion of composed documents."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return templates.converted(_table(spark, sf_dir, "part"), source, from_format, to_format)

    run.__name__, run.__doc__ = name, f"A {from_format} document for each part, as {to_format}."
    query(templates.oracle(expected))(run)


for _conversion in templates.CONVERSIONS:
    _template_query(*_conversion)

for _run, _sql in [*relations.REGISTERED, *office.REGISTERED]:
    query(_sql)(_run)
