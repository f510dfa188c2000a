"""Blocks of pages: their reading order, and merging to a limit, for all pages at once.

A page's blocks are rows of (page, block, x0, y0, x1, y1, ...).  Each step works on the
blocks of all pages together, by windows partitioned by page, so one exchange carries a
whole round; rounds end when no page has anything left to do.

Reading order is a recursive XY-cut.  A table holds the blocks of open regions.
In each round a region is cut at its vertical gaps; one without any at its
horizontal gaps, where the longest stretch of rows that a vertical gap divides
stays together and is cut next.  A gap lies where a block starts after the
running maximum of the ends before it.  A region that nothing cuts is done.

Merging joins pairs of blocks round by round, in each page the best pair by
one minimum.  Candidates of a block are its neighbours in an order along one axis,
found by windows, never all pairs of a page.

Defined results: ties go by the block's number, blocks of repeated rows count
one by one if their numbers differ; blocks without a place (a null edge) are left out of the order; an empty table gives
an empty result; other columns pass through reading order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

# How far two blocks may overlap and still be apart, in pixels; the share of a block that lies in its host.
TOLERANCE = 2.0
CONTAINED = 0.8
# Fixed values, in parts of a page: a thin line, the gap in shares of two lines of a title, the alignment and the gap of paragraphs of
# a column; the number of blocks at which columns stop joining, and the most that a page keeps.
THIN_LINE, LINE_GAP = 0.06, 0.8
COLUMN_LEFT, COLUMN_RIGHT, COLUMN_GAP = 0.03, 0.05, 0.05
FEW_BLOCKS, MOST_BLOCKS = 16, 24
SWALLOWED = 0.9

_EDGES = ("x0", "y0", "x1", "y1")
_STEP = "%06d."


def _area(s: str = "") -> Column:
    c = lambda e: F.col(f"{s}{e}")
    return (c("x1") - c("x0")) * (c("y1") - c("y0"))


def _runs(rows: DataFrame, key: list[str], low: str, high: str, name: str) -> DataFrame:
    """``name``: the run of each block along an axis, from 0; a new one begins where no earlier block reaches."""
    order = Window.partitionBy(*key).orderBy(low, "block")
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col(low) >= reach - TOLERANCE), 1).otherwise(0)
    cut = rows.withColumn("_begins", begins)
    return cut.withColumn(name, F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1).drop("_begins")


def _stretches(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, _i, _j: of each region, the longest stretch of at least two of its rows that a vertical gap divides.

    A gap at the left edge of a block holds in every row where no block that starts
    further left crosses that edge; the stretch is what lies between the nearest rows above and below that break it,
    if it also holds a block that starts further left.  Ties go to the upper one.
    """
    side = lambda s: [F.col(c).alias(f"{s}{c}") for c in ("x0", "x1", "block", "_row")]
    a = rows.select(*key, "_rows", *side("a"))
    b = rows.select(*key, *side("b"))
    earlier = (F.col("bx0") < F.col("ax0")) | (F.col("bx0") == F.col("ax0")) & (F.col("bblock") < F.col("ablock"))
    crosses = F.col("bx1") - TOLERANCE > F.col("ax0")
    # Of the rows of blocks that start further left: the nearest that break the gap, and the nearest that do not.
    met = a.join(b, key).where(earlier)
    at, row = F.col("_arow"), F.col("b_row")
    met = met.withColumnRenamed("a_row", "_arow")
    per = met.groupBy(*key, "_rows", "ablock", "_arow").agg(
        F.max(F.when(crosses & (row <= at), row)).alias("above"), F.min(F.when(crosses & (row >= at), row)).alias("below"),
        F.max(F.when(~crosses & (row <= at), row)).alias("left_above"), F.min(F.when(~crosses & (row >= at), row)).alias("left_below"),
    )
    i, j = F.coalesce(F.col("above") + 1, F.lit(0)), F.coalesce(F.col("below"), F.col("_rows"))
    found = per.withColumns({"_i": i, "_j": j}).where("(_arow >= _i and _arow < _j) and _j - _i >= 2 and _j - _i < _rows")
    inside = F.coalesce(F.col("left_above") >= F.col("_i"), F.lit(False)) | F.coalesce(F.col("left_below") < F.col("_j"), F.lit(False))
    best = found.where(inside).groupBy(*key).agg(F.max(F.struct((F.col("_j") - F.col("_i")).alias("n"), (-F.col("_i")).alias("i"))).alias("_best"))
    return best.select(*key, (-F.col("_best.i")).alias("_i"), (F.col("_best.n") - F.col("_best.i")).alias("_j"))


def cut_order(blocks: DataFrame, *, page: str = "page_id") -> DataFrame:
    """page, block and ``path``: sorted by path, the blocks of a page are in the order of the recursive XY-cut."""
    edges = [F.col(e).cast("double").alias(e) for e in _EDGES]
    usable = reduce(lambda a, b: a & b, [F.col(e).isNotNull() for e in _EDGES])
    open_rows = stored(blocks.where(usable).select(page, "block", *edges, F.lit("").alias("path")))
    done: list[DataFrame] = []
    key = [page, "path"]
    while True:
        columns = _runs(open_rows, key, "x0", "x1", "_column").withColumn("_columns", F.max("_column").over(Window.partitionBy(*key)) + 1)
        split = columns.where("_columns > 1").select(page, "block", *_EDGES, F.concat("path", F.format_string(_STEP, "_column")).alias("path"))
        rows = _runs(columns.where("_columns = 1"), key, "y0", "y1", "_row").withColumn("_rows", F.max("_row").over(Window.partitionBy(*key)) + 1)
        rows = stored(rows.drop("_column", "_columns"))
        # One row and one column: nothing cuts it, and its blocks go by their upper left corner.
        last = F.row_number().over(Window.partitionBy(*key).orderBy("y0", "x0", "block"))
        done.append(stored(rows.where("_rows = 1").select(page, "block", F.concat("path", F.format_string(_STEP, last)).alias("path"))))
        several = rows.where("_rows > 1")
        placed = several.join(_stretches(several, key), key, "left")
        part = F.when(F.col("_i").isNull(), F.col("_row")).when(F.col("_row") < F.col("_i"), 0).when(F.col("_row") < F.col("_j"), 1).otherwise(2)
        below = placed.select(page, "block", *_EDGES, F.concat("path", F.format_string(_STEP, part.cast("long"))).alias("path"))
        open_rows = stored(split.unionByName(below))
        if open_rows.isEmpty():
            return reduce(DataFrame.unionByName, done)


def _hosts(blocks: DataFrame, page: str) -> DataFrame:
    """page, block, host: the largest block of the page that covers most of a smaller one; ties go to the smaller number."""
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("block", *_EDGES)]
    met = blocks.select(page, *side("a")).join(blocks.select(page, *side("b")), page)
    met = met.where("b_x0 < a_x1 and a_x0 < b_x1 and b_y0 < a_y1 and a_y0 < b_y1").where(_area("b_") > _area("a_"))
    covered = (F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")) * (F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0"))
    return met.where(covered > CONTAINED * _area("a_")).groupBy(page, F.col("a_block").alias("block")).agg(F.max_by("b_block", F.struct(_area("b_"), -F.col("b_block"))).alias("host"))


def reading_order(blocks: DataFrame, *, page: str = "page_id") -> DataFrame:
    """The columns of ``blocks`` and ``place`` (from 0): top to bottom, columns first, nested blocks after their host.

    What lies in a block that itself lies in another comes last.  ``block`` numbers the blocks of a page.
    """
    edges = [F.col(e).cast("double").alias(e) for e in _EDGES]
    usable = reduce(lambda a, b: a & b, [F.col(e).isNotNull() for e in _EDGES])
    plain = stored(blocks.where(usable).select(page, "block", *edges))
    hosts = stored(_hosts(plain, page))
    tops = plain.join(hosts, [page, "block"], "left_anti")
    order = cut_order(tops, page=page)
    nested = hosts.join(order.select(page, F.col("block").alias("host"), "path"), [page, "host"], "left")
    everything = order.select(page, "block", "path", F.lit(0).alias("_inner")).unionByName(nested.select(page, "block", F.coalesce("path", F.lit("~")).alias("path"), F.lit(1).alias("_inner")))
    place = F.row_number().over(Window.partitionBy(page).orderBy("path", "_inner", "block")) - 1
    return blocks.join(everything.select(page, "block", place.alias("place")), [page, "block"])


def _merged(blocks: DataFrame, pairs: DataFrame, page: str) -> DataFrame:
    """Blocks with each pair (page, a, b) as one: the rectangle around both, under the smaller number, dense if both are."""
    into = pairs.select(page, F.greatest("a", "b").alias("block"), F.least("a", "b").alias("_into"))
    moved = blocks.join(into, [page, "block"], "left").withColumn("block", F.coalesce("_into", "block"))
    return moved.groupBy(page, "block").agg(*(F.min(e).alias(e) for e in ("x0", "y0")), *(F.max(e).alias(e) for e in ("x1", "y1")), F.min("dense").alias("dense"))


def _chosen(pairs: DataFrame, page: str, excess: DataFrame | None = None) -> DataFrame:
    """Of (page, a, b, cost): the pairs that are the best for both of their blocks, at most as many as a page has too many."""
    rank = F.struct("cost", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    ends = pairs.distinct().select(page, "a", "b", rank.alias("_rank"), F.explode(F.array("a", "b")).alias("_end"))
    best = ends.withColumn("_best", F.min("_rank").over(Window.partitionBy(page, "_end")))
    mutual = best.where("_rank = _best").groupBy(page, "a", "b", "_rank").count().where("count = 2")
    if excess is not None:
        n = F.row_number().over(Window.partitionBy(page).orderBy("_rank"))
        mutual = mutual.withColumn("_n", n).join(excess, page).where("_n <= excess")
    return stored(mutual.select(page, "a", "b"))


def _near(blocks: DataFrame, page: str, left: list[Column], right: list[Column]) -> DataFrame:
    """Pairs a, b of a page that share a cell of a grid: ``left`` places a, ``right`` b and all cells around."""
    side = lambda s: [F.col(c).alias(f"{s}{c}") for c in ("block", *_EDGES)]
    text = blocks.where("not dense")
    names = [f"_g{k}" for k in range(len(left))]
    a = text.select(page, *side("a"), *(F.floor(g).alias(n) for g, n in zip(left, names, strict=True)))
    b = text.select(page, *side("b"), *(F.floor(g).alias(n) for g, n in zip(right, names, strict=True)))
    for n in names:
        b = b.withColumn(n, F.explode(F.array(F.col(n) - 1, F.col(n), F.col(n) + 1)))
    return a.join(b, [page, *names]).where("ablock <> bblock")


def _title_pairs(blocks: DataFrame, page: str) -> DataFrame:
    """Thin lines closely below one another that overlap in width by half; the closest first."""
    thin = blocks.where(F.col("y1") - F.col("y0") < THIN_LINE)
    met = _near(thin, page, [F.col("y1") / THIN_LINE], [F.col("y0") / THIN_LINE])
    gap = F.col("by0") - F.col("ay1")
    overlap = F.least("ax1", "bx1") - F.greatest("ax0", "bx0")
    low = F.least(F.col("ay1") - F.col("ay0"), F.col("by1") - F.col("by0"))
    narrow = F.least(F.col("ax1") - F.col("ax0"), F.col("bx1") - F.col("bx0"))
    return met.where((gap >= 0) & (gap < LINE_GAP * low) & (overlap > 0.5 * narrow)).select(page, F.col("ablock").alias("a"), F.col("bblock").alias("b"), gap.alias("cost"))


def _column_pairs(blocks: DataFrame, page: str) -> DataFrame:
    """Aligned paragraphs, one closely below or over the other; the smallest first."""
    met = _near(blocks, page, [F.col("x0") / COLUMN_LEFT, F.col("y1") / COLUMN_GAP], [F.col("x0") / COLUMN_LEFT, F.col("y0") / COLUMN_GAP])
    aligned = (F.abs(F.col("ax0") - F.col("bx0")) < COLUMN_LEFT) & (F.abs(F.col("ax1") - F.col("bx1")) < COLUMN_RIGHT)
    near = F.abs(F.col("by0") - F.col("ay1")) < COLUMN_GAP
    both = met.where(aligned & near)
    return both.select(page, F.least("ablock", "bblock").alias("a"), F.greatest("ablock", "bblock").alias("b"), (_area("a") + _area("b")).alias("cost"))


#: Neighbours on either side, by upper and by left edge, among which a block's nearest one is sought.
NEIGHBOURS = 4


def _nearest_pairs(blocks: DataFrame, page: str) -> DataFrame:
    """Each text block with the nearest of its neighbours; the smallest block first."""
    me = F.struct("block", *_EDGES)
    found = blocks.where("not dense")
    around = []
    for edge, other in (("y0", "x0"), ("x0", "y0")):
        w = Window.partitionBy(page).orderBy(edge, other, "block")
        around += [f(me, k).over(w) for k in range(1, NEIGHBOURS + 1) for f in (F.lag, F.lead)]
    found = found.withColumn("_around", F.array(*around))
    gap = lambda n: F.greatest(F.col("x0") - n["x1"], n["x0"] - F.col("x1"), F.lit(0.0)) + F.greatest(F.col("y0") - n["y1"], n["y0"] - F.col("y1"), F.lit(0.0))
    nearest = F.array_min(F.transform(F.filter("_around", lambda n: n.isNotNull()), lambda n: F.struct(gap(n).alias("gap"), n["block"].alias("block"))))
    return found.select(page, F.col("block").alias("a"), nearest["block"].alias("b"), _area().alias("cost")).where("b is not null")


def _excess(blocks: DataFrame, page: str, limit: int) -> DataFrame:
    return blocks.groupBy(page).agg((F.count("*") - limit).cast("int").alias("excess")).where("excess > 0")


def merged_to_limit(blocks: DataFrame, *, page: str = "page_id", few: int = FEW_BLOCKS, most: int = MOST_BLOCKS) -> DataFrame:
    """page, block, x0, y0, x1, y1, dense: lines of a title joined, then columns down to ``few`` blocks, then neighbours down to ``most``.

    Edges are parts of the page.  Only text (not dense) joins, so a page of more than ``most`` dense blocks keeps them.  In each
    round the pairs join that are the best of both their blocks, by cost, then number; the best pair of a page always is one.
    """
    columns = [page, "block", *(F.col(e).cast("double").alias(e) for e in _EDGES), F.coalesce("dense", F.lit(False)).alias("dense")]
    usable = reduce(lambda a, b: a & b, [F.col(e).isNotNull() for e in _EDGES])
    left = stored(blocks.where(usable).select(*columns))
    for pairs_of, limit in ((_title_pairs, None), (_column_pairs, few), (_nearest_pairs, most)):
        while True:
            excess = None if limit is None else _excess(left, page, limit)
            busy = left if excess is None else left.join(excess, page, "left_semi")
            pairs = _chosen(pairs_of(busy, page), page, excess)
            if pairs.isEmpty():
                break
            joined = _merged(left, pairs, page)
            if pairs_of is _nearest_pairs:
                joined = _unswallowed(joined, pairs, page)
            left = stored(joined)
    return left


def _unswallowed(blocks: DataFrame, pairs: DataFrame, page: str) -> DataFrame:
    """Blocks without text that a pair just joined covers nearly whole."""
    made = blocks.join(pairs.select(page, F.least("a", "b").alias("block")), [page, "block"], "left_semi")
    joined = made.select(page, *(F.col(c).alias(f"b{c}") for c in ("block", *_EDGES)))
    met = blocks.where("not dense").join(joined, page).where("block <> bblock and x0 < bx1 and bx0 < x1 and y0 < by1 and by0 < y1")
    covered = (F.least("x1", "bx1") - F.greatest("x0", "bx0")) * (F.least("y1", "by1") - F.greatest("y0", "by0"))
    smaller = (_area() < _area("b")) | (_area() == _area("b")) & (F.col("block") > F.col("bblock"))
    gone = met.where((covered >= SWALLOWED * _area()) & smaller).select(page, "block").distinct()
    return blocks.join(gone, [page, "block"], "left_anti")
