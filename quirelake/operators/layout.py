"""Slides, lists, phases and page pictures as windows and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The widest and highest column of a table in parts of a page, the width of a gray bin, the fewest pixels
# of a picture worth reading, the forms of pictures that no model reads, the failures in a row that end a phase.
COLUMN_WIDTH = 0.35
COLUMN_HEIGHT = 0.2
GRAY_BIN = 8
LEAST_PIXELS = 1024
VECTOR_FORMATS = ("EMF", "WMF")
FAILURES = 3


def slide_plans(blocks: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id, slide, section, level, title, n_blocks: how blocks fall into slides.

    ``blocks`` has id, at, kind, level and text.  A heading starts a slide; one
    of level 1 also starts a section and has a slide only where blocks follow
    it.  A document of such headings alone has a slide for each.
    """
    w = Window.partitionBy(id_col).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.col("kind") == "heading"
    top = heading & (F.col("level") == 1)
    placed = blocks.withColumns({"_plan": F.count(F.when(heading, 1)).over(w), "_section": F.count(F.when(top, 1)).over(w)})
    plans = placed.groupBy(id_col, "_plan").agg(
        F.max("_section").alias("_section"), F.max(F.when(heading, F.col("level"))).alias("_level"), F.max(F.when(heading, F.col("text"))).alias("title"),
        F.count(F.when(~heading, 1)).alias("n_blocks"),
    )
    kept = F.coalesce(F.col("_level") > 1, F.lit(False)) | (F.col("n_blocks") > 0)
    plans = plans.withColumn("_kept", kept).withColumn("_any", F.max("_kept").over(Window.partitionBy(id_col))).where("_kept or not _any")
    slide = F.row_number().over(Window.partitionBy(id_col).orderBy("_plan"))
    section = F.when(F.col("_section") > 0, F.col("_section") - 1)
    return plans.select(id_col, slide.alias("slide"), section.alias("section"), F.greatest(F.coalesce("_level", F.lit(2)), F.lit(2)).alias("level"), "title", "n_blocks")


def list_numbers(items: DataFrame, *, id_col: str = "doc_id", levels: int = 9) -> DataFrame:
    """``number`` of every list item, counting on after interruptions.

    ``items`` has id, at, list, level (0 is outermost) and start.  An item counts the
    items of its list and level since the last item of that list on an outer level.
    """
    w = Window.partitionBy(id_col, "list").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outer = F.lit(None).cast("long")
    for k in range(levels):
        last = F.max(F.when(F.col("level") < k, F.col("at").cast("long"))).over(w) if k else F.lit(None).cast("long")
        outer = F.when(F.col("level") == k, last).otherwise(outer)
    since = Window.partitionBy(id_col, "list", "level", "_outer").orderBy("at")
    return items.withColumn("_outer", outer).withColumn("number", F.col("start") + F.row_number().over(since) - 1).drop("_outer")


def run_until_failures(jobs: DataFrame, *, phase: str = "phase", at: str = "at", most: int = FAILURES) -> DataFrame:
    """Jobs of each phase up to the failure that is the last of ``most`` in a row.

    ``jobs`` has the phase, an order and ok; the streak of a job is its distance from the last success.
    """
    w = Window.partitionBy(phase).orderBy(at)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = jobs.withColumn("_n", F.row_number().over(w))
    streak = numbered.withColumn("_streak", F.col("_n") - F.coalesce(F.max(F.when(F.col("ok"), F.col("_n"))).over(upto), F.lit(0)))
    ended = F.min(F.when(F.col("_streak") >= most, F.col("_n"))).over(Window.partitionBy(phase))
    return streak.withColumn("_end", ended).where("_end is null or _n <= _end").drop("_n", "_streak", "_end")


def dropped_census(features: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id, dropped: what a document lost, as ``x (n), y`` in the order of first appearance.

    ``features`` has id, at and feature, one row for each loss; counts are partial before the exchange.
    """
    counts = features.groupBy(id_col, "feature").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    shown = F.when(F.col("n") > 1, F.concat("feature", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("feature"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "feature", shown.alias("shown"))))
    return counts.groupBy(id_col).agg(F.array_join(ordered["shown"], ", ").alias("dropped"))


def background_level(pixels: DataFrame, *, id_col: str = "page_id") -> DataFrame:
    """id, level, share: the middle of the fullest bin of gray values, the darkest in a tie, and its share.

    ``pixels`` has id, gray (0 to 255) and n, how many pixels have it.
    """
    bins = pixels.groupBy(id_col, F.floor(F.col("gray") / GRAY_BIN).cast("int").alias("bin")).agg(F.sum("n").alias("n"))
    best = bins.groupBy(id_col).agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"), F.max("n").alias("n"), F.sum("n").alias("all"))
    return best.select(id_col, (F.col("bin") * GRAY_BIN + GRAY_BIN // 2).alias("level"), (F.col("n") / F.col("all")).alias("share"))


def worth_reading(form: Column, width: Column, height: Column, least: int = LEAST_PIXELS) -> Column:
    """Whether a picture is readable (its size known), no vector form and large enough."""
    return F.coalesce(~form.isin(*VECTOR_FORMATS) & (width.cast("long") * height >= least), F.lit(False))


def needs_labels(blocks: DataFrame, *, page: str = "page_id") -> DataFrame:
    """page, needed: false where all blocks are plain text and no two short narrow ones stand side by side.

    ``blocks`` has the page, box (x0, y0, x1, y1, in parts of the page) and plain.  Two blocks overlap
    in height iff one starts before the furthest end of those that start above it: no self-join.
    """
    small = (F.col("box.x1") - F.col("box.x0") < COLUMN_WIDTH) & (F.col("box.y1") - F.col("box.y0") < COLUMN_HEIGHT)
    w = Window.partitionBy(page, "_small").orderBy("box.y0", "box.y1", "box.x0").rowsBetween(Window.unboundedPreceding, -1)
    marked = blocks.withColumn("_small", F.coalesce(small, F.lit(False)))
    beside = F.col("_small") & (F.col("box.y1") > F.col("box.y0")) & (F.col("box.y0") < F.max("box.y1").over(w))
    return marked.withColumn("_beside", F.coalesce(beside, F.lit(False))).groupBy(page).agg((F.max("_beside") | ~F.min("plain")).alias("needed"))


def code_runs(blocks: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id, first, last, code, language: neighbouring code blocks as one, in the first language that any of them has.

    ``blocks`` has id, at (without gaps), kind, code and language.
    """
    w = Window.partitionBy(id_col).orderBy("at")
    code = blocks.where("kind = 'code'").withColumn("_run", F.col("at") - F.row_number().over(w))
    ordered = F.array_sort(F.collect_list(F.struct("at", "code")))
    return code.groupBy(id_col, "_run").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.array_join(ordered["code"], "\n").alias("code"),
        F.min_by("language", F.when(F.col("language").isNotNull(), F.col("at"))).alias("language"),
    ).drop("_run")
