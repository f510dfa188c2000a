"""Tree passes over the node table of all documents at once.

Everything is partitioned by the document, so a chain of passes needs one
exchange on its id.  Removing nodes leaves gaps in ``node_id``; order and
intervals stay valid, and ``renumbered`` closes the gaps where needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import safe_href


def plain_text(nodes: DataFrame, kinds: tuple[str, ...], *, id_col: str = "doc_id") -> DataFrame:
    """id, node_id, type and text of every node of the kinds given: the texts of its subtree in order."""
    tops = nodes.where(F.col("type").isin(*kinds)).select(id_col, F.col("node_id").alias("top"), F.col("subtree_end").alias("end"), F.col("type").alias("kind"))
    texts = nodes.where("type = 'Text'").select(F.col(id_col).alias("_id"), "node_id", "text")
    inside = (F.col(id_col) == F.col("_id")) & (F.col("node_id") > F.col("top")) & (F.col("node_id") <= F.col("end"))
    joined = tops.join(texts, inside, "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("node_id").isNotNull(), F.struct("node_id", "text"))))
    return joined.groupBy(id_col, F.col("top").alias("node_id"), F.col("kind").alias("type")).agg(F.array_join(ordered["text"], "").alias("text"))


def node_counts(nodes: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Nodes of each document by kind, as one row with a column for each kind asked for often."""
    count = lambda kind: F.count(F.when(F.col("type") == kind, 1)).alias(f"n_{kind.lower()}s")
    return nodes.groupBy(id_col).agg(*map(count, ("Paragraph", "Heading", "Link", "Image", "Table", "CodeBlock", "Footnote")), F.max("depth").alias("depth"))


def _without_parents(nodes: DataFrame, kind: str, id_col: str) -> DataFrame:
    """Rows of a kind taken out, their children handed to the nearest ancestor that stays."""
    gone = nodes.where(F.col("type") == kind)
    # The outermost link around a node: the first interval, in order, that still holds it.
    w = Window.partitionBy(id_col).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.when(F.col("type") == kind, F.struct(F.col("subtree_end").alias("end"), F.col("parent_id").alias("parent"), F.col("slot").alias("slot"), F.col("ord").alias("ord")))
    # How many of them are open: begun before the node less those that ended before it.
    begun = nodes.select("*", F.when(F.col("type") == kind, 1).otherwise(0).alias("_delta"), F.lit(1).alias("_is_node"))
    ended = gone.select(id_col, (F.col("subtree_end") + 1).alias("node_id"), F.lit(-1).alias("_delta"), F.lit(0).alias("_is_node"))
    events = Window.partitionBy(id_col).orderBy("node_id", "_is_node").rowsBetween(Window.unboundedPreceding, -1)
    counted = begun.unionByName(ended, allowMissingColumns=True).withColumn("_open", F.coalesce(F.sum("_delta").over(events), F.lit(0)).cast("int"))
    marked = counted.where("_is_node = 1").withColumn("_over", F.max(opened).over(w))
    inside = F.col("_over").isNotNull() & (F.col("node_id") <= F.col("_over.end"))
    parents = gone.select(F.col(id_col).alias("_id"), F.col("node_id").alias("_gone"))
    child = marked.join(parents, (F.col(id_col) == F.col("_id")) & (F.col("parent_id") == F.col("_gone")), "left")
    lifted = inside & F.col("_gone").isNotNull()
    out = child.where(F.col("type") != kind).withColumns(
        {
            "parent_id": F.when(lifted, F.col("_over.parent")).otherwise(F.col("parent_id")),
            "slot": F.when(lifted, F.col("_over.slot")).otherwise(F.col("slot")),
            "depth": F.col("depth") - F.col("_open"),
        }
    )
    return out.select(nodes.columns)


def discard_links(nodes: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Links replaced by their content; ``renumbered`` gives children their places."""
    return _without_parents(nodes, "Link", id_col)


def neutralize_links(nodes: DataFrame) -> DataFrame:
    """Links of unsafe schemes point nowhere."""
    return nodes.withColumn("url", F.when(F.col("type") == "Link", safe_href(F.col("url"))).otherwise(F.col("url")))


def without_subtrees(nodes: DataFrame, roots: Column, *, id_col: str = "doc_id") -> DataFrame:
    """Rows outside the subtrees whose root satisfies a condition, by one running maximum."""
    w = Window.partitionBy(id_col).orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.max(F.when(roots, F.col("subtree_end"))).over(w)
    return nodes.withColumn("_end", end).where(F.col("_end").isNull() | (F.col("node_id") > F.col("_end"))).drop("_end")


def remove_images(nodes: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Images go with their captions, then links left empty."""
    left = without_subtrees(nodes, F.col("type") == "Image", id_col=id_col)
    children = left.where("parent_id is not null").select(F.col(id_col).alias("_id"), F.col("parent_id").alias("_parent")).distinct()
    holds = (F.col(id_col) == F.col("_id")) & (F.col("node_id") == F.col("_parent"))
    return left.join(children, holds, "left").where((F.col("type") != "Link") | F.col("_parent").isNotNull()).select(nodes.columns)


def renumbered(nodes: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """node_id, parent_id, subtree_end and ord without gaps."""
    w = Window.partitionBy(id_col).orderBy("node_id")
    numbered = nodes.withColumn("_new", F.row_number().over(w) - 1)
    ids = numbered.select(F.col(id_col).alias("_id"), F.col("node_id").alias("_old"), F.col("_new").alias("_parent_new"))
    ends = numbered.withColumn("_last", F.max("_new").over(Window.partitionBy(id_col).orderBy("node_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    last = ends.select(F.col(id_col).alias("_id2"), F.col("node_id").alias("_at"), "_last")
    # The end of a subtree is the last node that stays at or before the old end.
    joined = numbered.join(ids, (F.col(id_col) == F.col("_id")) & (F.col("parent_id") == F.col("_old")), "left")
    inside = joined.join(last, (F.col(id_col) == F.col("_id2")) & (F.col("_at") >= F.col("node_id")) & (F.col("_at") <= F.col("subtree_end")))
    keep = [c for c in nodes.columns if c not in ("node_id", "parent_id", "subtree_end", "ord")]
    out = inside.groupBy(*keep, "_new", "_parent_new").agg(F.max("_last").alias("subtree_end"))
    siblings = Window.partitionBy(id_col, "_parent_new", "slot").orderBy("_new")
    out = out.withColumn("ord", F.row_number().over(siblings) - 1)
    return out.withColumnsRenamed({"_new": "node_id", "_parent_new": "parent_id"}).select(nodes.columns)


def section_numbers(headings: DataFrame, *, id_col: str = "doc_id", at: str = "node_id", levels: int = 6) -> DataFrame:
    """``number`` of every numbered heading: its counters joined by dots.

    A numbered heading raises its level's counter and zeroes deeper ones.
    The counter of a level counts headings of that level since the last one
    of a smaller level, which two window passes express.
    """
    numbered = headings.where("numbered")
    w = Window.partitionBy(id_col).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = numbered
    for k in range(2, levels + 1):  # the last heading above each level
        starts = starts.withColumn(f"_s{k}", F.coalesce(F.max(F.when(F.col("level") < k, F.col(at))).over(w), F.lit(-1)))
    starts = starts.withColumn("_s1", F.lit(-1))
    for k in range(1, levels + 1):
        since = Window.partitionBy(id_col, f"_s{k}").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        starts = starts.withColumn(f"_n{k}", F.count(F.when(F.col("level") == k, 1)).over(since))
    counters = F.slice(F.array(*[F.col(f"_n{k}").cast("string") for k in range(1, levels + 1)]), 1, F.col("level"))
    return starts.withColumn("number", F.array_join(counters, ".")).drop(*[f"_{c}{k}" for c in "sn" for k in range(1, levels + 1)])


def nearest_above(rows: DataFrame, *, id_col: str = "doc_id", at: str = "node_id", heading: str = "heading") -> DataFrame:
    """``above``: the last heading text before each row, or null."""
    w = Window.partitionBy(id_col).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("above", F.last(heading, ignorenulls=True).over(w))


def prune_sections(blocks: DataFrame, titles: tuple[str, ...], *, id_col: str = "doc_id", at: str = "node_id") -> DataFrame:
    """Top-level blocks outside the sections with one of the titles.

    A section lasts until a heading of its level or a smaller one.  For each
    block, the last heading of each level decides: a dropped heading of level
    k still holds if no heading of a level up to k came after it.
    """
    title = F.lower(F.trim(F.regexp_replace("heading", r"\s+", " ")))
    w = Window.partitionBy(id_col).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = blocks
    dropped = F.lit(False)
    for k in range(1, 7):
        last = F.last(F.when(F.col("level") <= k, F.struct((title.isin(*titles) & (F.col("level") == k)).alias("d"))), ignorenulls=True).over(w)
        out = out.withColumn(f"_d{k}", F.coalesce(last["d"], F.lit(False)))
        dropped |= F.col(f"_d{k}")
    return out.where(~dropped).drop(*[f"_d{k}" for k in range(1, 7)])


def unique_names(rows: DataFrame, name: str, *, id_col: str = "doc_id", at: str = "node_id", most: int = 31) -> DataFrame:
    """``unique_name``: a name already given, whatever its case, gets the first free of `` (2)``, `` (3)`` within the length allowed.

    Names made this way count as given, so a later name that equals one is
    numbered too.  The names of one document are folded in the JVM, by their
    order; those of a document are as few as its tables.
    """

    def candidate(bare: Column, n: Column) -> Column:
        suffix = F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))
        return F.when(n == 1, bare).otherwise(F.concat(F.substr(bare, F.lit(1), most - F.length(suffix)), suffix))

    def given(taken: Column, row: Column) -> Column:
        free = F.filter(F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda n: candidate(row["name"], n)), lambda c: ~F.exists(taken, lambda t: F.lower(t["name"]) == F.lower(c)))
        return F.array_append(taken, F.struct(row["at"].alias("at"), F.element_at(free, 1).alias("name")))

    kind = dict(rows.dtypes)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(name).alias("name"))))
    folded = F.aggregate(ordered, F.expr(f"cast(array() as array<struct<at:{kind[at]},name:string>>)"), given)
    named = rows.where(F.col(name).isNotNull()).groupBy(id_col).agg(folded.alias("_named")).select(F.col(id_col).alias("_id"), F.inline("_named").alias("_at", "unique_name"))
    return rows.join(named, (F.col(id_col) == F.col("_id")) & (F.col(at) == F.col("_at")), "left").drop("_id", "_at")


def place_notes(marks: DataFrame, notes: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Each note at its first mark: id, mark position, number, note.

    Notes of a document count only if they are numbered 1 to N and every one
    has a mark; otherwise all marks stay text.
    """
    numbers = notes.groupBy(id_col).agg(F.count("*").alias("n"), F.countDistinct("number").alias("d"), F.min("number").alias("low"), F.max("number").alias("high"))
    good = numbers.where("n = d and low = 1 and high = n").select(F.col(id_col).alias("_g"), "n")
    first = marks.groupBy(id_col, "number").agg(F.min("at").alias("at"))
    joined = notes.join(good, F.col(id_col) == F.col("_g")).join(first.withColumnsRenamed({id_col: "_m", "number": "_number"}), (F.col(id_col) == F.col("_m")) & (F.col("number") == F.col("_number")), "left")
    complete = joined.groupBy(id_col).agg(F.count("at").alias("found"), F.max("n").alias("all")).where("found = all").select(F.col(id_col).alias("_c"))
    return joined.join(complete, F.col(id_col) == F.col("_c")).select(id_col, "at", "number", "note")
