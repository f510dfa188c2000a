"""What labels, notes, captions and includes of documents refer to, over tables of all documents at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .tree import section_numbers, without_subtrees

#: Includes in includes at most.
DEPTH = 16


def label_numbers(nodes: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id, label, number: tables and figures by their own count, other labels by the section they stand in.

    Only tables and figures with a caption or label count.  The last node of a
    label decides; a label before the first numbered section has no number.
    Reads ``nodes`` several times: store what comes from a parser first.
    """
    captioned = nodes.where("slot = 'caption'").select(F.col(id_col).alias("_id"), F.col("parent_id").alias("_parent")).distinct()
    counted = nodes.where(F.col("type").isin("Table", "Image")).join(captioned, (F.col(id_col) == F.col("_id")) & (F.col("node_id") == F.col("_parent")), "left")
    counted = counted.where(F.col("_parent").isNotNull() | (F.col("label") != ""))
    objects = counted.select(id_col, "node_id", "label", F.row_number().over(Window.partitionBy(id_col, "type").orderBy("node_id")).cast("string").alias("number"))
    headings = section_numbers(nodes.where("type = 'Heading'"), id_col=id_col).select(id_col, "node_id", F.lit(None).cast("string").alias("label"), F.col("number").alias("section"))
    labels = nodes.where("type = 'Label'").select(id_col, "node_id", F.col("name").alias("label"), F.lit(None).cast("string").alias("section"))
    before = Window.partitionBy(id_col).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = headings.unionByName(labels).withColumn("number", F.coalesce(F.last("section", ignorenulls=True).over(before), F.lit("")))
    every = objects.unionByName(placed.drop("section")).where("label is not null and label <> ''")
    return every.groupBy(id_col, "label").agg(F.max_by("number", "node_id").alias("number")).where("number <> ''")


def printed_references(nodes: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id, node_id, label, shown: each reference as its number, or ``[label]`` where nothing has that label."""
    numbers = label_numbers(nodes, id_col=id_col).withColumnsRenamed({id_col: "_id", "label": "_label"})
    refs = nodes.where("type = 'Reference'").select(id_col, "node_id", "label")
    joined = refs.join(numbers, (F.col(id_col) == F.col("_id")) & (F.col("label") == F.col("_label")), "left")
    return joined.select(id_col, "node_id", "label", F.coalesce("number", F.concat(F.lit("["), "label", F.lit("]"))).alias("shown"))


def summary_text(nodes: DataFrame, kind: str, *, id_col: str = "doc_id", line_break: str = "; ") -> DataFrame:
    """id, node_id, summary: nodes of a kind that does not nest, as one line each.

    Notes and pictures stay out, breaks become ``line_break``, code and ``$math$``
    stay, links show their content.  One window, one aggregation, one exchange.
    """
    seen = without_subtrees(nodes, F.col("type").isin("Footnote", "Image"), id_col=id_col)
    w = Window.partitionBy(id_col).orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.last(F.when(F.col("type") == kind, F.struct(F.col("node_id").alias("at"), F.col("subtree_end").alias("end"))), ignorenulls=True).over(w)
    shown = (
        F.when(F.col("type") == "Text", F.replace("text", F.lit("\n"), F.lit(line_break))).when(F.col("type") == "LineBreak", F.lit(line_break))
        .when(F.col("type") == "CodeInline", F.col("code")).when(F.col("type") == "Equation", F.concat(F.lit("$"), "code", F.lit("$")))
    )
    inside = seen.withColumn("_top", top).withColumn("_shown", shown).where(F.col("node_id") <= F.col("_top.end"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("_shown").isNotNull(), F.struct("node_id", "_shown"))))
    text = F.trim(F.regexp_replace(F.array_join(ordered["_shown"], ""), " {2,}", " "))
    return inside.groupBy(id_col, F.col("_top.at").alias("node_id")).agg(text.alias("summary"))


def paired_notes(marks: DataFrame, texts: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id, mark, note: the k-th text of a document goes to its k-th mark.

    ``marks`` has id and at, ``texts`` id, at and note.  Spare marks of a document with texts
    get empty notes; without texts its marks stay marks (null); spare texts have a null mark.
    """
    w = Window.partitionBy(id_col).orderBy("at")
    a = marks.select(id_col, F.col("at").alias("mark"), F.row_number().over(w).alias("k"))
    b = texts.select(id_col, "note", F.row_number().over(w).alias("k"))
    some = texts.select(id_col, F.lit(True).alias("some")).distinct()
    note = F.when(F.col("some") & F.col("mark").isNotNull(), F.coalesce("note", F.lit(""))).otherwise(F.col("note"))
    return a.join(b, [id_col, "k"], "full").join(some, id_col, "left").select(id_col, "mark", note.alias("note"))


def attached_captions(blocks: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id, at, target: the block that a caption belongs to, or null for one that stays a paragraph.

    ``blocks`` has id, at and kind.  A caption belongs to the table right after it, else to the table or lone
    image right before it, unless that table already has the caption before it.
    """
    w = Window.partitionBy(id_col).orderBy("at")
    near = blocks.withColumns(
        {
            "_next": F.lead(F.struct("kind", "at")).over(w),
            "_last": F.lag(F.struct("kind", "at")).over(w),
            "_taken": (F.lag("kind").over(w) == "table") & F.coalesce(F.lag("kind", 2).over(w) == "caption", F.lit(False)),
        }
    )
    before = F.col("_last.kind").isin("table", "image") & ~F.col("_taken")
    target = F.when(F.col("_next.kind") == "table", F.col("_next.at")).when(before, F.col("_last.at"))
    return near.where("kind = 'caption'").select(id_col, "at", target.alias("target"))


def included_files(edges: DataFrame, *, depth: int = DEPTH) -> DataFrame:
    """main, path, depth: what each file pulls in, itself at depth 0.

    ``edges`` has path and target, both resolved and inside the folder of the
    main file.  A file that is being read already is left out, as is what lies
    deeper than ``depth`` files.  One join by file a level, over written tables.
    """
    edges = stored(edges.select("path", "target"))
    found = stored(edges.select(F.col("path").alias("main"), "path", F.array("path").alias("stack"), F.lit(0).alias("depth")).distinct())
    levels = [found]
    for level in range(1, depth):
        further = found.join(edges, "path").where(~F.array_contains("stack", F.col("target")))
        found = stored(further.select("main", F.col("target").alias("path"), F.array_append("stack", F.col("target")).alias("stack"), F.lit(level).alias("depth")))
        if found.isEmpty():
            break
        levels.append(found)
    return reduce(DataFrame.unionByName, levels).select("main", "path", "depth")
