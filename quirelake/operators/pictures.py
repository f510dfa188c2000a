"""Blocks of page pictures: runs of ink, connected over rows, as rectangles.

A picture is a table of scan lines (page, y, gray values from left to right).
The background of a region is the fullest bin of its gray values; pixels far from it are ink.
Ink of a line becomes runs inside the JVM, without a row for each pixel.  The runs of one
region are one group, in which those of lines that lie close are swept side by side and
joined.  A component that is large, but smaller than its region, is a region of the next round, with a background of its own.

Two pixels belong together if the squares of ``DILATION`` pixels around them touch.  That is what dilating
the picture and flood filling would find, without either.

Defined results: lines without pixels are empty; a picture without ink has no block; a region whose background is no
more than ``LEAST_BACKGROUND`` of it is one dense block; a missing line is a line without ink; an empty table gives an
empty result; other columns are not read.  The runs of one picture are one group.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import spread, stored
from .layout import GRAY_BIN

# How far ink is from the background; the side of the square around a pixel; how deep panels are looked into, how large a
# panel is in parts of the page and of its region; the least area in parts of the page and the least side in pixels of a block; the share
# of a region that its background has at least.
INK_DIFFERENCE = 28
DILATION = 9
MOST_DEPTH = 3
PANEL_AREA, PANEL_OF_REGION = 0.08, 0.95
LEAST_AREA, LEAST_SIDE = 0.0004, 4
LEAST_BACKGROUND = 0.35


def _background(lines: DataFrame) -> DataFrame:
    """page, region, level, share: the middle of the fullest bin of gray values, the darkest in a tie."""
    bins = lines.select("page", "region", F.explode("gray").alias("g")).groupBy("page", "region", F.floor(F.col("g") / GRAY_BIN).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    best = bins.groupBy("page", "region").agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"), F.max("n").alias("n"), F.sum("n").alias("all"))
    return best.select("page", "region", (F.col("bin") * GRAY_BIN + GRAY_BIN // 2).alias("level"), (F.col("n") / F.col("all")).alias("share"))


def _runs(lines: DataFrame, dilation: int) -> DataFrame:
    """page, region, y, a, b: stretches of ink of a line, those that lie close as one."""
    ink = lambda i: F.abs(F.get("gray", i) - F.col("level")) > INK_DIFFERENCE
    places = F.filter(F.sequence(F.lit(0), F.size("gray") - 1), ink)
    marked = lines.where(F.size("gray") > 0).withColumn("_p", places).where(F.size("_p") > 0)
    far = dilation  # the greatest distance at which pixels of one line belong together
    first = F.filter("_p", lambda x, i: (i == 0) | (x - F.get("_p", i - 1) > far))
    last = F.filter("_p", lambda x, i: (i == F.size("_p") - 1) | (F.get("_p", i + 1) - x > far))
    pairs = marked.select("page", "region", "y", "_left", F.explode(F.arrays_zip(first.alias("a"), last.alias("b"))).alias("_r"))
    return pairs.select("page", "region", "y", (F.col("_r.a") + F.col("_left")).alias("a"), (F.col("_r.b") + F.col("_left") + 1).alias("b"))


def components(runs: list[tuple[int, int, int]], dilation: int) -> list[tuple[int, int, int, int]]:
    """x0, y0, x1, y1 of each component of runs (y, a, b), which within a line lie further apart than ``dilation``."""
    runs = sorted(runs)
    root = list(range(len(runs)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    lines = {y: [i for i, _ in each] for y, each in groupby(enumerate(runs), key=lambda r: r[1][0])}
    for y, lower in lines.items():
        for down in range(1, dilation + 1):
            upper = lines.get(y - down, ())
            near = dilation - 1 if down == dilation else dilation
            i = j = 0
            while i < len(upper) and j < len(lower):
                (_, a, b), (_, c, d) = runs[upper[i]], runs[lower[j]]
                if max(c - b, a - d) + 1 <= near:
                    one, two = top(upper[i]), top(lower[j])
                    root[max(one, two)] = min(one, two)
                # What ends first touches nothing further: the next run of the other line is too far away.
                if b < d:
                    i += 1
                else:
                    j += 1
    boxes: dict[int, list[int]] = {}
    for i, (y, a, b) in enumerate(runs):
        box = boxes.setdefault(top(i), [a, y, b, y + 1])
        box[0], box[2], box[3] = min(box[0], a), max(box[2], b), y + 1
    return [tuple(box) for box in boxes.values()]


def _bounds(runs: DataFrame, dilation: int) -> DataFrame:
    """page, region, x0, y0, x1, y1 of each component of runs."""

    def boxes(table: pa.Table) -> pa.Table:
        found = components(list(zip(*(table.column(c).to_pylist() for c in ("y", "a", "b")), strict=True)), dilation)
        key = [pa.array([table.column(k)[0].as_py()] * len(found), table.schema.field(k).type) for k in ("page", "region")]
        return pa.table([*key, *(pa.array(c, pa.int32()) for c in zip(*found, strict=True))], names=["page", "region", "x0", "y0", "x1", "y1"])

    return runs.groupBy("page", "region").applyInArrow(boxes, f"page {dict(runs.dtypes)['page']}, region string, x0 int, y0 int, x1 int, y1 int")


def segments(lines: DataFrame, *, page: str = "page_id", dilation: int = DILATION, depth: int = MOST_DEPTH, area: float = LEAST_AREA, side: int = LEAST_SIDE) -> DataFrame:
    """page, x0, y0, x1, y1 (ends exclusive) and dense: the blocks of every picture.

    ``lines`` has the page, y (from 0) and gray, an array of values from 0 to 255.
    """
    pixels = stored(lines.select(F.col(page).alias("page"), F.col("y").cast("int").alias("y"), F.coalesce(F.col("gray").cast("array<int>"), F.array().cast("array<int>")).alias("gray")))
    sizes = pixels.groupBy("page").agg(F.max(F.size("gray")).alias("_w"), (F.max("y") + 1).alias("_h"))
    regions = sizes.select("page", F.lit("").alias("region"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("_w").alias("x1"), F.col("_h").alias("y1"), (F.col("_w").cast("long") * F.col("_h")).alias("_page_area")).where("x1 > 0")
    regions, found = stored(regions), []
    for level in range(depth + 1):
        place = pixels.join(regions, "page").where("y >= y0 and y < y1")
        cropped = place.select("page", "region", "y", F.col("x0").alias("_left"), F.slice("gray", F.col("x0") + 1, F.col("x1") - F.col("x0")).alias("gray"))
        cropped = stored(spread(cropped, "page", "region"))
        told = stored(regions.join(_background(cropped), ["page", "region"]))
        found.append(told.where(F.col("share") < LEAST_BACKGROUND).select("page", "x0", "y0", "x1", "y1", F.lit(True).alias("dense")))
        plain = told.where(F.col("share") >= LEAST_BACKGROUND)
        runs = _runs(cropped.join(plain.select("page", "region", "level"), ["page", "region"]), dilation)
        whole = plain.select("page", "region", "_page_area", ((F.col("x1") - F.col("x0")).cast("long") * (F.col("y1") - F.col("y0"))).alias("_area"))
        boxes = stored(_bounds(runs, dilation).join(whole, ["page", "region"]))
        own = (F.col("x1") - F.col("x0")).cast("long") * (F.col("y1") - F.col("y0"))
        panel = (own > PANEL_AREA * F.col("_page_area")) & (own < PANEL_OF_REGION * F.col("_area")) & F.lit(level < depth)
        kept = (own >= area * F.col("_page_area")) & (F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) >= side)
        found.append(boxes.where(~panel & kept).select("page", "x0", "y0", "x1", "y1", F.lit(False).alias("dense")))
        name = F.concat_ws(" ", F.col("region"), *(F.col(c).cast("string") for c in ("x0", "y0")))
        regions = stored(boxes.where(panel).select("page", name.alias("region"), "x0", "y0", "x1", "y1", "_page_area"))
        if regions.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).withColumnRenamed("page", page)


def lines_as_picture(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 80) -> DataFrame:
    """id, y, gray: texts drawn one pixel a character, dark on white, lines broken at a width."""
    lines = F.split(F.coalesce(text_col, F.lit("")), "\n", -1)
    cut = lambda x: F.when(x == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(x, F.lit(f"(?s).{{1,{width}}}"), F.lit(0)))
    rows = docs.select(id_col, F.posexplode(F.flatten(F.transform(lines, cut))).alias("y", "line"))
    dark: Column = F.transform(F.split(F.rpad("line", width, " "), ""), lambda c: F.when(F.trim(F.translate(c, "\t\r", "  ")) == "", 255).otherwise(0))
    return rows.select(id_col, "y", F.slice(dark, 1, width).alias("gray"))
