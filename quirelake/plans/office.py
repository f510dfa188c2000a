"""Queries of the operators on sheets and pages, with their DuckDB SQL; the catalogue registers them.

Workbooks hold the order lines of the given tables: texts, numbers and formulas, one workbook for each order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fitting
from ..operators import blocks, code, formulas, grids, includes, pages, pictures, styles
from ..sources.reader import parse_and_warn
from ..sources.workbook import shown, workbook_cells, workbook_files
from ..storage import spread, tasks_for

REGISTERED: list[tuple[Callable[[SparkSession, str], DataFrame], str | None]] = []


def _with(oracle: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        REGISTERED.append((f, oracle))
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Order lines of a task: their cells, some ten a line, are sorted there.
LINES_A_TASK = 1_000_000


def _order_cells(spark: SparkSession, sf_dir: str, tasks: int) -> DataFrame:
    """The cell table of a workbook for each order: its lines, amounts, running totals and a row of sums.

    Lines are dealt by path, so that no later step by path needs another exchange; cells are made of
    one row of a sheet at a time.
    """
    dealt = spread(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"), "path", tasks=tasks)
    lines = dealt.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))).alias("l"))
    cell = "named_struct('row', i, 'col', {}, 'kind', '{}', 'raw', {}, 'formula', {})".format
    empty = "cast(null as string)"
    heads = ", ".join(cell(c, "text", f"'{t}'", empty) for c, t in enumerate(("part & no.", "quantity", "price", "amount", "total", "<sum>")))
    each = ", ".join(
        [
            cell(0, "number", "cast(x.l_partkey as string)", empty), cell(1, "number", "cast(x.l_quantity as string)", empty), cell(2, "number", "cast(x.l_extendedprice as string)", empty),
            cell(3, "number", empty, "concat('=B', i + 1, '*C', i + 1, '*(1-$H$1)')"),
            cell(4, "number", empty, "if(i = 1, '=D2', concat('=E', i, '+D', i + 1))"),
            cell(5, "text", "'D1'", "concat('=SUM(D$2:D', i + 1, ')&\"D1\"')"),
        ]
    )
    sums = ", ".join(cell(c, "number", empty, f"concat('=SUM({letter}2:{letter}', i, ')')") for c, letter in ((1, "B"), (2, "C"), (3, "D")))
    rate = cell(7, "number", "'0.05'", empty)
    rows = lines.select("path", F.size("l").alias("n"), "l", F.explode(F.sequence(F.lit(0), F.size("l") + 1)).alias("i")).select("path", "n", "i", F.get("l", F.col("i") - 1).alias("x"))
    cells = F.expr(f"case when i = 0 then array({heads}, {rate}) when i <= n then array({each}) else array({sums}) end")
    return rows.select("path", F.lit(0).alias("sheet_no"), F.lit("Lines & sums").alias("sheet"), F.inline(cells))


_LINES = """
n AS (SELECT l_orderkey::VARCHAR AS path, count(*)::BIGINT AS n FROM lineitem GROUP BY l_orderkey)"""


@_with(
    f"""
WITH {_LINES},
r AS (
  SELECT path, 2 AS "row", 4 AS col, CASE WHEN n = 1 THEN 'D2' ELSE 'D2:D' || (n + 1) END || ' = B2*C2*(1-$H$1)' AS line FROM n
  UNION ALL SELECT path, 2, 5, 'E2 = D2' FROM n
  UNION ALL SELECT path, 3, 5, CASE WHEN n = 2 THEN 'E3' ELSE 'E3:E' || (n + 1) END || ' = E2+D3' FROM n WHERE n > 1
  UNION ALL SELECT path, 2, 6, CASE WHEN n = 1 THEN 'F2' ELSE 'F2:F' || (n + 1) END || ' = SUM(D$2:D2)&"D1"' FROM n
  UNION ALL SELECT path, n + 2, 2, 'B' || (n + 2) || ':D' || (n + 2) || ' = SUM(B2:B' || (n + 1) || ')' FROM n)
SELECT path, "row"::BIGINT AS "row", col::BIGINT AS col, line FROM r"""
)
def workbook_formula_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks of orders, written as files and read back: their formulas as lines over ranges."""
    tasks = tasks_for(_table(spark, sf_dir, "lineitem"), LINES_A_TASK)
    cells = workbook_cells(workbook_files(_order_cells(spark, sf_dir, tasks)))
    placed = cells.select("path", (F.col("row") + 1).alias("row"), (F.col("col") + 1).alias("col"), "formula")
    return formulas.compress(placed, id_col="path").select("path", F.col("row").cast("long"), F.col("col").cast("long"), "line")


@_with(
    f"""
WITH {_LINES}, i AS (SELECT path, n, unnest(range(2, n + 2)) AS i FROM n)
SELECT path, i AS "row", 4::BIGINT AS col, '' AS text, '=B' || i || '*C' || i || '*(1-$H$1)' AS formula FROM i
UNION ALL SELECT path, i, 5, '', CASE WHEN i = 2 THEN '=D2' ELSE '=E' || (i - 1) || '+D' || i END FROM i
UNION ALL SELECT path, i, 6, 'D1', '=SUM(D$2:D' || i || ')&"D1"' FROM i
UNION ALL SELECT path, n + 2, 2, '', '=SUM(B2:B' || (n + 1) || ')' FROM n UNION ALL SELECT path, n + 2, 3, '', '=SUM(C2:C' || (n + 1) || ')' FROM n UNION ALL SELECT path, n + 2, 4, '', '=SUM(D2:D' || (n + 1) || ')' FROM n
UNION ALL SELECT path, 1, k, t, NULL FROM n, (SELECT unnest([1, 2, 3, 4, 5, 6, 8]) AS k, unnest(['part & no.', 'quantity', 'price', 'amount', 'total', '<sum>', '0.05']) AS t)"""
)
def workbook_formula_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines over ranges written out again, beside what the cells show; number cells of order lines are left out."""
    tasks = tasks_for(_table(spark, sf_dir, "lineitem"), LINES_A_TASK)
    cells = _order_cells(spark, sf_dir, tasks)
    placed = cells.select("path", (F.col("row") + 1).alias("row"), (F.col("col") + 1).alias("col"), shown().alias("text"), "formula")
    lines = formulas.compress(placed, id_col="path").withColumn("at", F.monotonically_increasing_id())
    met = formulas.with_lines(placed.where("row = 1 or (col > 3 and text <> '')"), lines, id_col="path", together=tasks)
    return met.select("path", F.col("row").cast("long"), F.col("col").cast("long"), "text", "formula")


@_with(
    """
SELECT p_partkey AS doc_id, p_name || ' is what this part is called.' || chr(10) || chr(10) || '```' || CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'sql' ELSE '' END || chr(10)
  || CASE p_partkey % 3 WHEN 0 THEN 'def f_' || p_partkey || '(x):' || chr(10) || '    return x_y * ' || p_size WHEN 1 THEN 'select p_size from part where p_partkey = ' || p_partkey || ';' ELSE 'a_b[' || p_size || '] = {' || p_partkey || '};' END
  || chr(10) || chr(10) || 'x_y = f(a, b[' || p_size || ']);' || chr(10) || '```' || chr(10) || chr(10) || '~~~' || chr(10) || 'y = (1);' || chr(10) || chr(10) || 'z' || chr(10) || '~~~' || chr(10) || chr(10) || 'More words: see [1] or ' || p_brand || ' (size ' || p_size || ').' AS text FROM part"""
)
def code_fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown sources of parts, with unfenced code between prose and fences: code comes out fenced, with its language."""
    form = (
        r"concat(p_name, ' is what this part is called.\n\n', case p_partkey % 3 when 0 then concat('def f_', p_partkey, '(x):\n    return x_y * ', p_size) when 1 then concat('select p_size from part where p_partkey = ', p_partkey, ';')"
        r" else concat('a_b[', p_size, '] = {', p_partkey, '};') end, '\n\n\nx_y = f(a, b[', p_size, ']);\n\n~~~\ny = (1);\n\nz\n~~~\nMore words: see [1] or ', p_brand, ' (size ', p_size, ').')"
    )
    parts = spread(_table(spark, sf_dir, "part"), "p_partkey")
    return code.fenced_sources(parts.select(F.col("p_partkey").alias("doc_id"), F.expr(form).alias("text")))


def _laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the documents' lines, laid out on a page: every fifth across it, the others in two columns of two.

    A block is as high as it has lines of forty characters; sections lie below one another.
    """
    from pyspark.sql import Window

    found = blocks.blocks_of(_table(spark, sf_dir, "documents"))
    order = Window.partitionBy("doc_id").orderBy("block")
    placed = found.select("doc_id", (F.row_number().over(order) - 1).alias("n"), (F.col("n_lines") + F.floor(F.col("n_chars") / 40)).cast("double").alias("high"))
    placed = placed.withColumns({"section": F.floor(F.col("n") / 5).cast("int"), "part": F.col("n") % 5})
    inside = Window.partitionBy("doc_id", "section")
    total = lambda *parts: F.coalesce(F.sum(F.when(F.col("part").isin(*parts), F.col("high") * 20 + 10)).over(inside), F.lit(0.0))
    placed = placed.withColumns({"tall": total(0) + F.greatest(total(1, 2), total(3, 4)), "head": total(0), "one": total(1), "three": total(3)})
    heights = placed.groupBy("doc_id", "section").agg(F.first("tall").alias("_tall"))
    top = F.coalesce(F.sum("_tall").over(Window.partitionBy("doc_id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    tops = heights.withColumn("_top", top).drop("_tall")
    y0 = F.col("_top") + F.when(F.col("part") == 0, 0.0).otherwise(F.col("head")) + F.when(F.col("part") == 2, F.col("one")).when(F.col("part") == 4, F.col("three")).otherwise(0.0)
    right = F.col("part") >= 3
    x0, x1 = F.when(right, 520.0).otherwise(0.0), F.when((F.col("part") == 0) | right, 1000.0).otherwise(480.0)
    # Numbers that say nothing about the order.
    block = F.pmod(F.col("n") * 7919 + F.col("doc_id") % 97, F.lit(1_000_003)).cast("int")
    return placed.join(tops, ["doc_id", "section"]).select("doc_id", block.alias("block"), "n", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + F.col("high") * 20).alias("y1"))


@_with(
    r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT *, CASE WHEN trim(line, ' ') = '' THEN 'blank' WHEN regexp_matches(line, '^(    | {0,3}\t)') THEN 'code' WHEN regexp_matches(trim(line, ' '), '^(-{3,}|\*{3,}|_{3,}|={3,})$') THEN 'rule' WHEN starts_with(trim(line, ' '), '>') THEN 'quote'
  WHEN regexp_matches(trim(line, ' '), '^([-*+•]|[0-9]{1,9}[.)])[ \t\n\x0B\f\r]') THEN 'list' WHEN contains(trim(line, ' '), '|') THEN 'table' ELSE 'paragraph' END AS kind FROM l),
s AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY doc_id ORDER BY i) IS NOT DISTINCT FROM kind THEN 0 ELSE 1 END AS s FROM k),
r AS (SELECT doc_id, kind, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
d AS (SELECT DISTINCT doc_id, kind, run FROM r WHERE kind <> 'blank'),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS n FROM d)
SELECT doc_id, ((n * 7919 + doc_id % 97) % 1000003)::BIGINT AS block, n::BIGINT AS place FROM n"""
)
def block_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading order of laid out documents; it must be the order of their blocks in the text."""
    found = pages.reading_order(_laid_out(spark, sf_dir).drop("n"), page="doc_id")
    return found.select("doc_id", F.col("block").cast("long").alias("block"), F.col("place").cast("long").alias("place"))


@_with(None)
def blocks_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of laid out documents, in parts of their page, merged to a limit."""
    from pyspark.sql import Window

    laid = _laid_out(spark, sf_dir)
    tall = F.max("y1").over(Window.partitionBy("doc_id"))
    shares = laid.withColumn("_tall", tall).select("doc_id", "block", (F.col("x0") / 1000).alias("x0"), (F.col("y0") / F.col("_tall")).alias("y0"), (F.col("x1") / 1000).alias("x1"), (F.col("y1") / F.col("_tall")).alias("y1"), (F.col("n") % 11 == 10).alias("dense"))
    return pages.merged_to_limit(shares, page="doc_id")


@_with(None)
def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents drawn as pictures, one pixel a character."""
    drawn = pictures.lines_as_picture(spread(_table(spark, sf_dir, "documents"), "doc_id"))
    return pictures.segments(drawn, page="doc_id", dilation=5, side=1)


@_with(
    """
WITH RECURSIVE t(main, node, place) AS (SELECT p_partkey, p_partkey, '' FROM part
  UNION ALL SELECT t.main, p.p_partkey, t.place || s.s FROM t, (SELECT unnest(['1', '2']) AS s) s JOIN part p ON true WHERE p.p_partkey = 2 * t.node + s.s::BIGINT AND length(t.place) < 15),
pre AS (SELECT t.main, string_agg('[' || p_name || ']', '' ORDER BY place) AS text FROM t JOIN part p ON p.p_partkey = t.node GROUP BY t.main),
lost AS (SELECT main, list(name ORDER BY place, name) AS missing FROM (
  SELECT main, 'p' || (2 * node + s.s::BIGINT) AS name, min(place || s.s) AS place FROM t, (SELECT unnest(['1', '2']) AS s) s WHERE 2 * node + s.s::BIGINT > (SELECT max(p_partkey) FROM part) OR length(place) >= 15 GROUP BY ALL) GROUP BY main)
SELECT 'd/p' || main || '.tex' AS path, text, len(missing)::BIGINT AS n_missing, list_aggregate(missing, 'string_agg', ',') AS missing FROM pre LEFT JOIN lost USING (main)"""
)
def included_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of parts, each with two more that it includes, put together from every part as the main file."""
    part = _table(spark, sf_dir, "part")
    path = F.concat(F.lit("d/p"), F.col("p_partkey").cast("string"), F.lit(".tex"))
    name = lambda k: F.concat(F.lit("p"), (F.col("p_partkey") * 2 + k).cast("string"))
    text = F.concat(F.lit("["), "p_name", F.lit("]\\input{"), name(1), F.lit("}% \\input{none}\\include{no}"), F.lit("\n"), F.lit("\\input "), name(2))
    files = part.select(path.alias("path"), F.regexp_replace(text, "\n", " \n").alias("text"))
    found = includes.whole_sources(files, files)
    bare = F.regexp_replace("text", r"\s*\n", "")
    return found.select("path", bare.alias("text"), F.size("missing").cast("long").alias("n_missing"), F.array_join("missing", ",").alias("missing"))


@_with(
    """
WITH RECURSIVE d AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: length(x)) AS l FROM documents),
s(doc_id, l, k, scale) AS (SELECT doc_id, l, 0, 1.0::DOUBLE FROM d UNION ALL
  SELECT doc_id, l, k + 1, CASE WHEN h <= 360 OR scale <= 0.5 THEN scale ELSE greatest(0.5::DOUBLE, scale * 360 / h) END FROM (
    SELECT *, list_sum(list_transform(l, lambda c: greatest(1.0::DOUBLE, ceil(c / greatest(1.0::DOUBLE, 600 / (20 * scale * 0.5::DOUBLE)))) * (20 * scale) * 1.2::DOUBLE + 6 * scale)) AS h FROM s) WHERE k < 5)
SELECT doc_id, round(scale, 6) AS scale, greatest(18.0::DOUBLE, 32 - 2 * greatest(0, ceil((32 - 2 * (600 / 0.55::DOUBLE) / greatest(l[1], 1)) / 2)))::DOUBLE AS title FROM s WHERE k = 5"""
)
def documents_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document on one slide: the scale at which its lines fit, and the size of its first line as the title."""
    length = F.length(F.col("text"))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.struct(F.length(x).alias("chars"), F.lit(0).alias("level"), F.lit("text").alias("kind")))
    boxes = _table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"), length.alias("_n"))
    scale = fitting.fitted_scale(F.col("lines"), F.lit(600.0), F.lit(360.0))
    title = fitting.title_size(F.col("lines")[0]["chars"], F.lit(600.0), 32.0)
    return boxes.select("doc_id", F.round(scale, 6).alias("scale"), title.alias("title"))


@_with(
    """
WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS "row", l_quantity, l_extendedprice FROM lineitem),
c AS (SELECT doc_id, "row", unnest([0, 1, 2, 3]) AS col, unnest([CASE WHEN "row" = 1 THEN doc_id::VARCHAR ELSE '' END, l_quantity::BIGINT::VARCHAR, '', floor(l_extendedprice)::BIGINT::VARCHAR]) AS text FROM l
  UNION ALL SELECT DISTINCT doc_id, 0, unnest([0, 1, 2, 3]), unnest(['order', 'amounts', '', '']) FROM l)
SELECT doc_id, "row"::BIGINT AS "row", col::BIGINT AS col, text FROM c"""
)
def spans_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of orders: the key spans all lines, the head and the quantity span columns; as plain grids."""
    from pyspark.sql import Window

    lines = _table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    row, n = F.row_number().over(order), F.count("*").over(Window.partitionBy("l_orderkey"))
    placed = lines.select(F.col("l_orderkey").alias("doc_id"), row.cast("long").alias("row"), n.cast("int").alias("_n"), "l_quantity", "l_extendedprice")
    cell = lambda at, text, across, down: F.struct(F.lit(at).alias("at"), text.cast("string").alias("text"), F.lit(across).alias("colspan"), down.cast("int").alias("rowspan"))
    key = F.filter(F.array(F.when(F.col("row") == 1, cell(0, F.col("doc_id"), 1, F.col("_n")))), lambda c: c.isNotNull())
    rest = F.array(cell(1, F.col("l_quantity").cast("long"), 2, F.lit(1)), cell(2, F.floor("l_extendedprice"), 1, F.lit(1)))
    body = placed.select("doc_id", "row", F.inline(F.concat(key, rest)))
    head = placed.select("doc_id", F.lit(0).cast("long").alias("row")).distinct().select("doc_id", "row", F.inline(F.array(cell(0, F.lit("order"), 1, F.lit(1)), cell(1, F.lit("amounts"), 3, F.lit(1)))))
    found = grids.without_spans(head.unionByName(body))
    return found.select("doc_id", "row", F.col("col").cast("long").alias("col"), "text")


@_with("SELECT p_partkey AS doc_id, '_see **' || p_brand || '** and_  ~~' || p_size || '~~ end' || '*in*side `' || p_name || '`' AS markdown FROM part")
def emphasis_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styled runs about every part as Markdown, markers shared and nested."""
    run = lambda text, bold=False, italic=False, struck=False, other=False: F.struct(text.cast("string").alias("text"), *(F.lit(v).alias(k) for k, v in (("bold", bold), ("italic", italic), ("strikethrough", struck), ("other", other))))
    word = F.lit
    runs = F.array(
        run(word("see "), italic=True), run(F.col("p_brand"), bold=True, italic=True), run(word(" and "), italic=True), run(word(" ")), run(F.col("p_size"), struck=True), run(word(" en")), run(word("d")),
        run(word("in"), italic=True), run(word("side ")), run(F.concat(F.lit("`"), "p_name", F.lit("`")), other=True),
    )
    rows = spread(_table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("doc_id"), F.posexplode(runs).alias("at", "r")).select("doc_id", "at", "r.*")
    return styles.emphasised(rows)


@_with(
    """
SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 3 = 1 THEN 0 ELSE 3 END::BIGINT AS n_nodes,
  CASE p_partkey % 3 WHEN 1 THEN 'failed' WHEN 2 THEN 'replaced_characters' ELSE '' END AS codes FROM part"""
)
def parse_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of parts as JSON, one in three broken off and one in three with odd characters: their nodes and what the reader says, from one pass."""
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 2, F.lit("\ufffd")).otherwise(""))
    tree = F.concat(F.lit('{"type": "Document", "children": [{"type": "Paragraph", "children": [{"type": "Text", "content": "'), name, F.when(F.col("p_partkey") % 3 == 1, "").otherwise('"}]}]}'))
    parts = spread(_table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("doc_id"), tree.alias("text"))
    nodes, warnings = parse_and_warn(parts, "json")
    counts = nodes.groupBy("doc_id").agg(F.count("*").alias("n_nodes"))
    codes = warnings.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))
    joined = parts.select("doc_id").join(counts, "doc_id", "left").join(codes, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("n_nodes", F.lit(0)).cast("long").alias("n_nodes"), F.coalesce("codes", F.lit("")).alias("codes"))
