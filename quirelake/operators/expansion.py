"""Rows put into the node table: pictures replaced by blocks, paragraphs split around them.

A node is an opening and a closing event of its document.  Events have keys that
leave room between any two: (number of the node at that place, phase, rank), so new
nodes, and the parts of a paragraph that is cut, get events between those of other
nodes.  One window over the events in their order then numbers everything anew:
openings so far are node numbers and interval ends, openings less closings the depth.

Defined results: expansions of nodes that are no pictures, or do not exist, are passed over; a part of a paragraph without
anything but white space and breaks goes; pictures that are not right inside a paragraph become one text; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ATTRIBUTES
from ..storage import stored

_OPEN, _CLOSE = 0, 1


def _key(place: Column, phase: Column | int, rank: Column | int, turn: Column | int = 0) -> Column:
    as_long = lambda c: (F.lit(c) if isinstance(c, int) else c).cast("long")
    return F.array(as_long(place), as_long(phase), as_long(rank), as_long(turn))


def numbered(rows: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The node table from rows with ``uid``, ``parent_uid`` and the keys ``opens`` and ``closes`` (arrays of longs), by one window.

    Slot and attributes stay; node_id, parent_id, ord, subtree_end and depth are made anew.
    """
    event = lambda kind, key: F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key"))
    events = rows.select(id_col, "uid", F.explode(F.array(event(_OPEN, "opens"), event(_CLOSE, "closes"))).alias("_e"))
    w = Window.partitionBy(id_col).orderBy("_e.key", "_e.kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.sum(F.when(F.col("_e.kind") == _OPEN, 1).otherwise(0)).over(w)
    closed = F.sum(F.when(F.col("_e.kind") == _CLOSE, 1).otherwise(0)).over(w)
    counted = events.withColumns({"_opened": opened, "_depth": opened - closed})
    at = lambda kind, c: F.max(F.when(F.col("_e.kind") == kind, F.col(c)))
    places = counted.groupBy(id_col, "uid").agg((at(_OPEN, "_opened") - 1).cast("int").alias("node_id"), (at(_CLOSE, "_opened") - 1).cast("int").alias("subtree_end"), (at(_OPEN, "_depth") - 1).cast("int").alias("depth"))
    parents = places.select(id_col, F.col("uid").alias("parent_uid"), F.col("node_id").alias("parent_id"))
    made = rows.drop("node_id", "subtree_end", "depth", "parent_id", "ord").join(places, [id_col, "uid"]).join(parents, [id_col, "parent_uid"], "left")
    siblings = Window.partitionBy(id_col, "parent_id", "slot").orderBy("node_id")
    return made.withColumn("ord", (F.row_number().over(siblings) - 1).cast("int"))


def _uid(node: Column, part: Column | int = 0) -> Column:
    return F.concat_ws(":", node.cast("string"), (F.lit(part) if isinstance(part, int) else part).cast("string"))


def expand_images(nodes: DataFrame, blocks: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The node table with pictures replaced by the blocks given for them.

    ``blocks`` has id, node_id (of the picture), at, type (Paragraph, Heading, CodeBlock or Equation), level and text.
    A picture in a paragraph splits it; its caption follows the blocks as a paragraph ``Figure: ...``.
    """
    columns, nodes = nodes.columns, stored(nodes)  # read several times
    images = nodes.where("type = 'Image'").select(id_col, "node_id", F.col("parent_id").alias("_p"), F.col("subtree_end").alias("_end"), F.col("depth").alias("_d"))
    used = blocks.select(id_col, "node_id", "at", F.col("type").alias("kind"), F.col("level").cast("int").alias("level"), F.coalesce("text", F.lit("")).alias("words")).where("kind in ('Paragraph', 'Heading', 'CodeBlock', 'Equation')")
    chosen = images.join(used.select(id_col, "node_id").distinct(), [id_col, "node_id"])
    kinds = nodes.select(id_col, F.col("node_id").alias("_p"), F.col("type").alias("_parent_type"), F.col("slot").alias("_parent_slot"), F.col("parent_id").alias("_grand"))
    chosen = chosen.join(kinds, [id_col, "_p"], "left")
    split = F.col("_parent_type") == "Paragraph"
    # Captions: the texts below a picture.
    below = nodes.where("type = 'Text'").select(id_col, F.col("node_id").alias("_t"), F.col("text").alias("_text"))
    inside = chosen.select(id_col, "node_id", "_end").where("_end > node_id").join(below, id_col).where("_t > node_id and _t <= _end")
    captions = inside.groupBy(id_col, "node_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("_t", "_text")))["_text"], "").alias("words"))
    captions = captions.select(id_col, "node_id", F.lit(2**31 - 1).alias("at"), F.lit("Paragraph").alias("kind"), F.lit(None).cast("int").alias("level"), F.concat(F.lit("Figure: "), "words").alias("words"))
    used = used.join(chosen.select(id_col, "node_id"), [id_col, "node_id"], "left_semi").unionByName(captions)
    # Rows that stay: not below a picture that goes.
    spans = chosen.select(id_col, F.col("node_id").alias("_img"), "_end")
    w = Window.partitionBy(id_col).orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = nodes.join(spans.withColumnRenamed("_img", "node_id"), [id_col, "node_id"], "left").withColumn("_gone", F.coalesce(F.max("_end").over(w) >= F.col("node_id"), F.lit(False)))
    # The part of its paragraph that each child is in: how many split points come before it.
    points = chosen.where(split).select(id_col, "node_id", F.lit(1).alias("_point"))
    siblings = Window.partitionBy(id_col, "parent_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parted = marked.join(points, [id_col, "node_id"], "left").withColumn("_part", F.coalesce(F.sum("_point").over(siblings), F.lit(0)))
    cut = parted.where("_point = 1").select(id_col, F.col("parent_id").alias("_cut")).distinct()
    of_cut = cut.select(id_col, F.col("_cut").alias("parent_id"), F.lit(True).alias("_in_cut"))
    rows = parted.where("not _gone").drop("_end", "_point", "_gone").join(of_cut, [id_col, "parent_id"], "left")
    rows = rows.withColumn("_part", F.when(F.col("_in_cut"), F.col("_part")).otherwise(0))
    has_content = F.max(~((F.col("type") == "LineBreak") | (F.col("type") == "Text") & (F.trim(F.translate("text", "\t\n\r", "   ")) == ""))).alias("_full")
    parts = rows.where("_in_cut").groupBy(id_col, F.col("parent_id").alias("_whole"), "_part").agg(has_content, F.min("node_id").alias("_first"), F.max("subtree_end").alias("_last"))
    parts = parts.where("_full").drop("_full")
    wholes = rows.join(cut.select(id_col, F.col("_cut").alias("node_id")), [id_col, "node_id"], "left_semi").drop("_part")
    closes = _key(F.col("subtree_end"), 1, -F.col("depth"))
    plain = rows.join(cut.select(id_col, F.col("_cut").alias("node_id")), [id_col, "node_id"], "left_anti")
    # A child in a part that goes, goes too: it is white space.
    kept = parts.select(id_col, F.col("_whole").alias("parent_id"), "_part", F.lit(True).alias("_kept"))
    inner = plain.join(kept, [id_col, "parent_id", "_part"], "left").where("_in_cut is null or _kept")
    inner = inner.withColumns({"uid": _uid(F.col("node_id")), "parent_uid": F.when(F.col("parent_id").isNotNull(), _uid(F.col("parent_id"), F.col("_part"))), "opens": _key(F.col("node_id"), 0, 0), "closes": closes})
    pieces = wholes.join(parts.withColumnRenamed("_whole", "node_id"), [id_col, "node_id"])
    pieces = pieces.withColumns({"uid": _uid(F.col("node_id"), F.col("_part")), "parent_uid": _uid(F.col("parent_id")), "opens": _key(F.col("_first"), -1, 0), "closes": _key(F.col("_last"), 1, -F.col("depth"))})
    new = _new_rows(used, chosen.withColumn("_split", F.coalesce(split, F.lit(False))), nodes, id_col)
    table = inner.select(*columns, "uid", "parent_uid", "opens", "closes").unionByName(pieces.select(*columns, "uid", "parent_uid", "opens", "closes")).unionByName(new)
    return numbered(stored(table), id_col=id_col).select(columns)


def _new_rows(used: DataFrame, chosen: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """Rows of the blocks of each picture, with their texts; of pictures that split nothing, one text."""
    types = {f.name: f.dataType for f in nodes.schema}
    order = Window.partitionBy(id_col, "node_id").orderBy("at")
    placed = used.join(chosen, [id_col, "node_id"]).withColumn("_k", F.row_number().over(order))
    holder = F.col("kind").isin("Paragraph", "Heading")

    def row(**fields: Column) -> Column:
        base = {"node_id": F.col("node_id"), "parent_id": F.col("_p"), "slot": F.lit("children"), "ord": F.lit(0), "subtree_end": F.col("node_id"), "depth": F.lit(0), "type": F.lit(None)}
        base |= {a: F.lit(None) for a in ATTRIBUTES} | fields
        extra = {"uid", "parent_uid", "opens", "closes"}
        return F.struct(*[(v.cast(types[k]) if k not in extra else v).alias(k) for k, v in base.items() if k in extra or k in types])

    uid = F.concat(_uid(F.col("node_id")), F.lit("+"), F.col("_k").cast("string"))
    place = lambda turn: _key(F.col("node_id"), 0, F.col("_k"), turn)
    block = row(
        type=F.col("kind"), slot=F.coalesce("_parent_slot", F.lit("children")), level=F.when(F.col("kind") == "Heading", F.coalesce("level", F.lit(1))), numbered=F.when(F.col("kind") == "Heading", F.lit(True)),
        code=F.when(~holder, F.col("words")), inline=F.when(F.col("kind") == "Equation", F.lit(False)), uid=uid, parent_uid=_uid(F.col("_grand")), opens=place(0), closes=place(3),
    )
    style = {k: F.lit(False) for k in ("bold", "italic", "strikethrough")}
    text = row(type=F.lit("Text"), text=F.col("words"), uid=F.concat(uid, F.lit("t")), parent_uid=uid, opens=place(1), closes=place(2), **style)
    made = F.when(holder & (F.col("words") != ""), F.array(block, text)).otherwise(F.array(block))
    blocks = placed.where("_split").select(id_col, F.inline(made))
    joined = placed.where("not _split").groupBy(id_col, "node_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("_k", F.trim("words").alias("w"))))["w"], " ").alias("words"), F.first("_p").alias("_p"))
    joined = joined.where("words <> ''").join(nodes.select(id_col, "node_id", F.col("slot").alias("_slot")), [id_col, "node_id"])
    at = lambda turn: _key(F.col("node_id"), 0, 0, turn)
    stand_in = joined.select(id_col, F.inline(F.array(row(type=F.lit("Text"), slot=F.col("_slot"), text=F.col("words"), uid=_uid(F.col("node_id")), parent_uid=_uid(F.col("_p")), opens=at(0), closes=at(1), **style))))
    names = [*nodes.columns, "uid", "parent_uid", "opens", "closes"]
    return blocks.select(names).unionByName(stand_in.select(names))
