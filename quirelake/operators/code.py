"""Code in Markdown sources and among paragraphs, for all documents at once.

``fenced_sources`` cuts sources into blocks, scores them in the JVM, and looks
again at the few that score as code as their reader sees them, which takes the
inline reader (an Arrow map over those blocks alone).  Runs of code are islands.

Defined results: null and empty texts stay empty; blocks inside fences are left as they are; repeated ids are one
document only if their texts are one row, so ids must be unique; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.code import BARE_WORDS, FENCE, INDICATORS, LINK, OTHER_START, TABLE_RULE

#: Words of a line that is short beside code.
SHORT_WORDS = 6


def source_blocks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, block (from 0, with gaps), source, fenced: the blocks of every source.

    A line that opens a fence flips the state of those behind it, and one that can close the open fence flips it back;
    which fence is open is a fold over the lines that look like fences, in each document.
    """
    lines = docs.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("at", "line"))
    sign = F.regexp_extract("line", r"^ {0,3}(`{3,}|~{3,})", 1)
    marks = lines.withColumn("_sign", sign).where(F.col("_sign") != "")
    bare = F.regexp_replace(F.trim("line"), r"^(?:`+|~+)$", "") == ""
    ordered = F.array_sort(F.collect_list(F.struct("at", F.col("_sign").alias("sign"), bare.alias("bare"))))
    start = F.struct(F.lit("").alias("open"), F.lit(-1).alias("from"), F.expr("cast(array() as array<struct<first: int, last: int>>)").alias("done"))

    def step(s: Column, m: Column) -> Column:
        closes = (s["open"] != "") & m["bare"] & F.startswith(m["sign"], s["open"])
        opened = F.struct(m["sign"].alias("open"), m["at"].alias("from"), s["done"].alias("done"))
        closed = F.struct(F.lit("").alias("open"), F.lit(-1).alias("from"), F.array_append(s["done"], F.struct(s["from"].alias("first"), m["at"].alias("last"))).alias("done"))
        return F.when(s["open"] == "", opened).when(closes, closed).otherwise(s)

    finish = lambda s: F.when(s["open"] != "", F.array_append(s["done"], F.struct(s["from"].alias("first"), F.lit(2**31 - 1).alias("last")))).otherwise(s["done"])
    fences = marks.groupBy(id_col).agg(F.aggregate(ordered, start, step, finish).alias("_f")).select(F.col(id_col).alias("_id"), F.inline("_f"))
    inside = lines.join(fences, (F.col(id_col) == F.col("_id")) & F.col("at").between(F.col("first"), F.col("last")), "left")
    # A block ends at a blank line, where a fence begins and behind its end.
    w = Window.partitionBy(id_col).orderBy("at")
    fence = F.col("first")
    blank = fence.isNull() & (F.trim(F.translate("line", "\t\r\x0b\x0c", "    ")) == "")
    cut = F.when(blank | ~F.lag("first").over(w).eqNullSafe(fence), 1).otherwise(0)
    placed = inside.withColumns({"block": F.sum(cut).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_blank": blank, "fenced": fence.isNotNull()})
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("at", "line")))["line"], "\n")
    return placed.where("not _blank").groupBy(id_col, "block", "fenced").agg(joined.alias("source")).select(id_col, "block", "source", "fenced")


def may_be_code(source: Column) -> Column:
    """Whether a block is neither another structure nor too short to tell."""
    bare = F.regexp_replace(source, r"^\s+|\s+$", "")
    lines = F.split(bare, "\n")
    several = F.size(lines) > 1
    quote = F.forall(lines, lambda x: F.ltrim(x).startswith(">"))
    table = F.forall(lines, lambda x: F.trim(x).startswith("|") & F.trim(x).endswith("|")) | lines[0].contains("|") & F.coalesce(F.get(lines, F.lit(1)).rlike(TABLE_RULE), F.lit(False))
    few = (F.size(T.words(bare)) < BARE_WORDS) | ~several & bare.endswith(":")
    outside = F.regexp_replace(bare, "`+[^`]*`+", "")
    sign = F.lit(False)
    for i in INDICATORS:
        sign |= outside.contains(i)
    return (bare != "") & ~bare.rlike(OTHER_START) & ~bare.rlike(LINK) & ~quote & ~(several & table) & (~few | sign)


def _scored(blocks: DataFrame, column: str) -> DataFrame:
    """``_code``: whether a column's text scores as code."""
    measures = T.code_measures(F.col(column))
    measured = blocks.withColumns(measures)
    return measured.withColumn("_code", T.code_score()["is_code"]).drop(*measures)


def code_blocks(blocks: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """``blocks`` with is_code and language: code by score, also as its reader sees it."""
    first = _scored(blocks.withColumn("_may", ~F.col("fenced") & may_be_code(F.col("source"))), "source").withColumn("_code", F.col("_code") & F.col("_may")).drop("_may")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quirelake.sources.code import shown

        for batch in batches:
            yield batch.append_column("_shown", pa.array([shown(s) for s in batch.column("source").to_pylist()], pa.string()))

    found = first.where("_code").drop("_code")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    second = _scored(found.mapInArrow(look, f"{kinds}, _shown string"), "_shown")
    guess = lambda c: F.expr(f"({T.language_case().replace('(t,', f'(lower({c}),')})")
    told = second.select(*blocks.columns, F.col("_code").alias("is_code"), F.when(F.col("_code"), F.coalesce(guess("_shown"), guess("source"))).alias("language"))
    rest = first.where("not _code").select(*blocks.columns, F.lit(False).alias("is_code"), F.lit(None).cast("string").alias("language"))
    return told.unionByName(rest)


def fenced_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the source with every run of code blocks in one fence, in the first language found."""
    told = code_blocks(source_blocks(docs, id_col=id_col, text_col=text_col), id_col=id_col)
    w = Window.partitionBy(id_col).orderBy("block")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = F.when(F.col("is_code") & F.coalesce(F.lag("is_code").over(w), F.lit(False)), 0).otherwise(1)
    runs = told.withColumn("_starts", starts).withColumn("_run", F.sum("_starts").over(upto))
    sources = F.array_join(F.array_sort(F.collect_list(F.struct("block", "source")))["source"], "\n\n")
    language = F.coalesce(F.min_by("language", F.when(F.col("language").isNotNull(), F.col("block"))), F.lit(""))
    joined = runs.groupBy(id_col, "_run", "is_code").agg(sources.alias("_s"), language.alias("_l"))
    shown = F.when(F.col("is_code"), F.concat(F.lit("```"), "_l", F.lit("\n"), "_s", F.lit("\n```"))).otherwise(F.col("_s"))
    whole = joined.groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_list(F.struct("_run", shown.alias("s"))))["s"], "\n\n").alias("_text"))
    out = docs.select(F.col(id_col).alias("_id")).join(whole, F.col("_id") == F.col(id_col), "left")
    return out.select(F.col("_id").alias(id_col), F.coalesce("_text", F.lit("")).alias(text_col))


def absorbed_lines(paragraphs: DataFrame, *, id_col: str = "doc_id", at: str = "at") -> DataFrame:
    """``joins``: whether a paragraph is code, or a short line that belongs to the code beside it.

    ``paragraphs`` has id, an order, text and is_code.  Short lines between code all belong to it; those with code on one side only
    belong up to the furthest that has a sign of code.  Runs of short lines are islands.
    """
    w = Window.partitionBy(id_col).orderBy(at)
    words = F.size(T.words(F.coalesce("text", F.lit(""))))
    sign = F.lit(False)
    for i in INDICATORS:
        sign |= F.coalesce(F.col("text").contains(i), F.lit(False))
    short = ~F.col("is_code") & (words > 0) & (words <= SHORT_WORDS)
    n = F.row_number().over(w)
    rows = paragraphs.withColumns({"_short": short, "_sign": sign, "_n": n})
    rows = rows.withColumn("_starts", F.when(F.lag("_short").over(w).eqNullSafe(F.col("_short")), 0).otherwise(1))
    rows = rows.withColumns({"_run": F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_before": F.coalesce(F.lag("is_code").over(w), F.lit(False)), "_after": F.coalesce(F.lead("is_code").over(w), F.lit(False))})
    run = Window.partitionBy(id_col, "_run").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"_left": F.first("_before").over(run), "_right": F.last("_after").over(run), "_first": F.min(F.when(F.col("_sign"), F.col("_n"))).over(run), "_last": F.max(F.when(F.col("_sign"), F.col("_n"))).over(run)})
    beside = F.expr("(_left and _right) or (_left and _n <= coalesce(_last, -1)) or (_right and _n >= coalesce(_first, 2147483647))")
    return rows.withColumn("joins", F.col("is_code") | F.col("_short") & beside).select(*paragraphs.columns, "joins")
