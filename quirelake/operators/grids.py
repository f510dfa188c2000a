"""Tables whose cells span columns and rows, as plain grids.

A table is a fold over its rows, in the JVM.  What a row hands on is, for each column, how many further
rows are taken by cells above.  Within a row each cell goes to the first free column; what lies between is taken from
above and blank.  A span lies over taken columns without using them up, so those are taken in the next row.

Defined results: spans below one are one; blanks are empty texts; a row ends at its last cell or the last column taken from above; a
cell that would start at or behind ``MOST_COLUMNS`` goes; rows come in the order of their numbers, cells in the order of theirs; an empty table
gives an empty result.  The cells of one table are one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import let

# Fixed value: columns of a row, beyond which no cell begins.
MOST_COLUMNS = 4096


def _placed(cells: Column, taken: Column) -> Column:
    """Cells with the column each starts at: an array of (start, end, down, text)."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int, down: int, text: string>>)").alias("done"))

    def step(s: Column, c: Column) -> Column:
        # The first column from here on that is not taken; the one behind the last always is free.
        free = F.filter(F.sequence(s["at"], F.greatest(s["at"], F.size(taken))), lambda j: F.coalesce(F.get(taken, j), F.lit(0)) == 0)

        def put(first: Column) -> Column:
            one = F.struct(first.alias("start"), (first + c["across"]).alias("end"), c["down"].alias("down"), c["text"].alias("text"))
            return F.when(first < MOST_COLUMNS, F.struct((first + c["across"]).alias("at"), F.array_append(s["done"], one).alias("done"))).otherwise(F.struct(F.lit(MOST_COLUMNS).alias("at"), s["done"].alias("done")))

        return let(F.get(free, F.lit(0)), put)

    return F.aggregate(cells, start, step, lambda s: s["done"])


def _left(placed: Column, taken: Column) -> Column:
    """What the next row finds taken, by column."""
    width = F.greatest(F.size(taken), F.coalesce(F.array_max(F.transform(placed, lambda p: p["end"])), F.lit(0)))
    covers = lambda p, j: (p["start"] <= j) & (j < p["end"])

    def column(j: Column) -> Column:
        old = F.coalesce(F.get(taken, j), F.lit(0))
        over = F.exists(placed, lambda p: covers(p, j))
        new = F.aggregate(F.filter(placed, lambda p: covers(p, j)), F.lit(0), lambda n, p: n + p["down"] - 1)
        return F.when((old > 0) & ~over, old - 1).otherwise(old) + new

    return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), column)).otherwise(F.array().cast("array<int>"))


def _row(placed: Column, taken: Column) -> Column:
    """The texts of a row by column, blanks where nothing starts."""
    last_taken = F.coalesce(F.array_max(F.filter(F.transform(taken, lambda n, j: F.when(n > 0, j + 1)), lambda j: j.isNotNull())), F.lit(0))
    width = F.greatest(F.least(last_taken, F.lit(MOST_COLUMNS)), F.coalesce(F.array_max(F.transform(placed, lambda p: p["end"])), F.lit(0)))
    starts = F.map_from_entries(F.transform(placed, lambda p: F.struct(p["start"].alias("k"), p["text"].alias("v"))))
    texts = let(starts, lambda m: F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.coalesce(F.try_element_at(m, j), F.lit(""))))
    return F.when(width > 0, texts).otherwise(F.array().cast("array<string>"))


def without_spans(cells: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id, row, col, text of every cell of the grids.

    ``cells`` has id, row, at (the order in its row), text, colspan and rowspan.  A row without cells has none of its own.
    """
    whole = lambda c: F.greatest(F.coalesce(F.col(c).cast("int"), F.lit(1)), F.lit(1))
    # No cell reaches further than it needs to: columns behind the last one begin nothing.
    one = F.struct("at", F.least(whole("colspan"), F.lit(MOST_COLUMNS)).alias("across"), whole("rowspan").alias("down"), F.coalesce("text", F.lit("")).alias("text"))
    rows = cells.groupBy(id_col, "row").agg(F.array_sort(F.collect_list(one)).alias("cells"))
    tables = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("rows"))
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.expr(f"cast(array() as array<struct<row: {dict(cells.dtypes)['row']}, texts: array<string>>>)").alias("done"))

    def step(s: Column, r: Column) -> Column:
        made = lambda p: F.struct(r["row"].alias("row"), _row(p, s["taken"]).alias("texts"))
        return let(_placed(r["cells"], s["taken"]), lambda p: F.struct(_left(p, s["taken"]).alias("taken"), F.array_append(s["done"], made(p)).alias("done")))

    grids = tables.select(id_col, F.inline(F.aggregate("rows", start, step, lambda s: s["done"])))
    return grids.select(id_col, "row", F.posexplode("texts").alias("col", "text"))
