"""Lines, blocks, tables, formulas, images and geometry as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, at, line: every line of every text, in the JVM."""
    return docs.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("at", "line"))


def line_kind(line: Column) -> Column:
    """The kind of block that a line of plain text belongs to."""
    bare = F.trim(line)
    return (
        F.when(bare == "", "blank")
        .when(line.rlike(r"^(    | {0,3}\t)"), "code")
        .when(bare.rlike(r"^(-{3,}|\*{3,}|_{3,}|={3,})$"), "rule")
        .when(bare.startswith(">"), "quote")
        .when(bare.rlike(r"^([-*+•]|[0-9]{1,9}[.)])\s"), "list")
        .when(bare.contains("|"), "table")
        .otherwise("paragraph")
    )


def blocks_of(docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id, block, kind, first_line, n_lines, n_chars: runs of lines of one kind (gaps and islands)."""
    kinds = lines_of(docs, id_col=id_col).withColumn("kind", line_kind(F.col("line")))
    w = Window.partitionBy(id_col).orderBy("at")
    starts = kinds.withColumn("starts", F.when(F.lag("kind").over(w).eqNullSafe(F.col("kind")), 0).otherwise(1))
    runs = starts.withColumn("block", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = runs.groupBy(id_col, "block", "kind").agg(F.min("at").cast("long").alias("first_line"), F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))
    return out.where("kind <> 'blank'")


def wrap_statistics(docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id, width, n_pairs, n_full, wrapped: whether the lines of a text are cut at a width."""
    lines = lines_of(docs, id_col=id_col).withColumn("line", F.rtrim("line"))
    w = Window.partitionBy(id_col).orderBy("at")
    pairs = lines.withColumn("next", F.lead("line").over(w)).where("trim(line) <> '' and trim(next) <> ''")
    pairs = pairs.withColumn("wide", F.length("line")).withColumn("word", F.length(F.regexp_extract(F.col("next"), r"^\s*(\S+)", 1)))
    widths = pairs.groupBy(id_col).agg(F.max(F.when(F.col("wide") <= 100, F.col("wide"))).alias("width"))
    joined = pairs.join(widths, id_col)
    full = F.count(F.when(F.col("wide") + 1 + F.col("word") > F.col("width"), 1))
    out = joined.groupBy(id_col).agg(F.first("width").cast("long").alias("width"), F.count("*").alias("n_pairs"), full.alias("n_full"))
    wrapped = F.coalesce((F.col("width") >= 50) & (F.col("n_full") >= 3) & (2 * F.col("n_full") >= F.col("n_pairs")), F.lit(False))
    return out.withColumn("wrapped", wrapped)


def contexts(docs: DataFrame, pattern: str, *, id_col: str = "doc_id", size: int = 500) -> DataFrame:
    """id, at, before, after: ``size`` characters on either side of each line that matches, from prefix sums."""
    lines = lines_of(docs, id_col=id_col)
    w = Window.partitionBy(id_col).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("begin", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)))
    hits = placed.where(F.col("line").rlike(pattern)).select(F.col(id_col).alias("_id"), "at", "begin", F.length("line").alias("wide"))
    joined = hits.join(docs.select(id_col, "text"), F.col("_id") == F.col(id_col))
    low = F.greatest(F.lit(0), F.col("begin") - size)
    return joined.select(
        id_col, F.col("at").cast("long").alias("at"), F.substr("text", low + 1, F.col("begin") - low).alias("before"),
        F.substr("text", F.col("begin") + F.col("wide") + 1, F.lit(size)).alias("after"),
    )


def content_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest, first_id: equal contents are named by the smallest id.

    The smallest ids are found by a partial aggregation; a digest that many
    rows share meets its one row in a join that adaptive execution may split.
    """
    digests = docs.select(id_col, F.sha1(F.coalesce(text_col, F.lit(""))).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min(id_col).alias("first_id"))
    return digests.join(firsts, "digest").select(id_col, "digest", "first_id")


def padded_tables(cells: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id, row, cells: every row of a table padded to its widest; nothing is cut.

    ``cells`` has id, row, col, text.
    """
    width = cells.groupBy(id_col).agg(F.max("col").alias("last"))
    rows = cells.groupBy(id_col, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("by_col"))
    return rows.join(width, id_col).select(
        id_col, "row", F.transform(F.sequence(F.lit(0), F.col("last").cast("int")), lambda c: F.coalesce(F.col("by_col")[c], F.lit(""))).alias("cells")
    )


def csv_of_tables(tables: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id and csv of padded tables: CRLF, quoted where needed."""
    from ..functions.text import csv_cell

    line = F.array_join(F.transform("cells", csv_cell), ",")
    ordered = F.array_sort(F.collect_list(F.struct("row", line.alias("line"))))
    return tables.groupBy(id_col).agg(F.concat(F.array_join(ordered["line"], "\r\n"), F.lit("\r\n")).alias("csv"))


def markdown_of_tables(tables: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id and markdown of padded tables whose row 0 is the header."""
    from ..functions.text import markdown_cell

    line = F.concat(F.lit("| "), F.array_join(F.transform("cells", markdown_cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.size("cells")), " | "), F.lit(" |"))
    shown = F.when(F.col("row") == 0, F.concat(line, F.lit("\n"), rule)).otherwise(line)
    ordered = F.array_sort(F.collect_list(F.struct("row", shown.alias("line"))))
    return tables.groupBy(id_col).agg(F.array_join(ordered["line"], "\n").alias("markdown"))


def dominant(rows: DataFrame, key: str, value: str, weight: str, at: str) -> DataFrame:
    """key and the value with the largest weight; the first seen wins a tie."""
    sums = rows.groupBy(key, value).agg(F.sum(weight).alias("_w"), F.min(at).alias("_at"))
    return sums.groupBy(key).agg(F.max_by(value, F.struct("_w", -F.col("_at"))).alias("dominant"))


def expand_formulas(ranges: DataFrame) -> DataFrame:
    """sheet, col, row, formula for every cell of ``(sheet, col, first, last, formula)``.

    ``{r}`` in a formula is the row relative to the first one, as references
    shift along a column; absolute references hold no mark.
    """
    cells = ranges.select("sheet", "col", "formula", F.explode(F.sequence("first", "last")).alias("row"))
    return cells.select("sheet", "col", "row", F.replace("formula", F.lit("{r}"), F.col("row").cast("string")).alias("formula"))


def compress_formulas(cells: DataFrame) -> DataFrame:
    """sheet, col, first, last, formula: maximal vertical runs that repeat one formula, shifted.

    A formula is compared with its own row number marked, so equal marks in
    successive rows are one run (gaps and islands).
    """
    marked = cells.withColumn("formula", F.regexp_replace("formula", F.concat(F.lit(r"(?<=[A-Z])"), F.col("row").cast("string"), F.lit(r"(?!\d)")), F.lit("{r}")))
    w = Window.partitionBy("sheet", "col", "formula").orderBy("row")
    runs = marked.withColumn("run", F.col("row") - F.row_number().over(w))
    return runs.groupBy("sheet", "col", "formula", "run").agg(F.min("row").alias("first"), F.max("row").alias("last")).drop("run")


def overlap_share(a: str, b: str) -> Column:
    """The part of rectangle ``a`` (struct x0, y0, x1, y1) that lies inside ``b``."""
    wide = F.greatest(F.lit(0.0), F.least(f"{a}.x1", f"{b}.x1") - F.greatest(f"{a}.x0", f"{b}.x0"))
    high = F.greatest(F.lit(0.0), F.least(f"{a}.y1", f"{b}.y1") - F.greatest(f"{a}.y0", f"{b}.y0"))
    area = (F.col(f"{a}.x1") - F.col(f"{a}.x0")) * (F.col(f"{a}.y1") - F.col(f"{a}.y0"))
    return F.when(area > 0, wide * high / area).otherwise(0.0)


def containment(blocks: DataFrame, *, page: str = "page_id", least: float = 0.8) -> DataFrame:
    """page, inner, outer: blocks of a page that lie inside a larger one; a range join within pages."""
    a, b = (blocks.select(F.col(page).alias(f"{s}_page"), F.col("block_id").alias(f"{s}_id"), F.col("box").alias(s)) for s in "ab")
    area = lambda s: (F.col(f"{s}.x1") - F.col(f"{s}.x0")) * (F.col(f"{s}.y1") - F.col(f"{s}.y0"))
    larger = (area("b") > area("a")) | (area("b") == area("a")) & (F.col("b_id") < F.col("a_id"))
    joined = a.join(b, (F.col("a_page") == F.col("b_page")) & (F.col("a_id") != F.col("b_id")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.x0") < F.col("b.x1")))
    return joined.where(larger & (overlap_share("a", "b") >= least)).select(F.col("a_page").alias(page), F.col("a_id").alias("inner"), F.col("b_id").alias("outer"))
