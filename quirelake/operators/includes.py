"""Sources put together from the files that they include, for all main files at once.

A file is cut into its texts and its includes by column functions; verbatim text
and comments do not include anything, and comments go.  Names resolve from the folder of the main file, so what a file
becomes depends on that folder and the file alone: the pieces are laid out once for each folder of main files and file in it.

Files whose includes end within ``DEPTH`` files are put together *from below*: a round for each height, in which files take the
finished texts of what they include.  So a text is moved once for each file that includes it, and all rounds together move a
few times the result.  Files that are deeper, or that come back to a file that is being read, are read *from above*: a
table holds the includes that are still open, each with its path of positions, the places from the main file down at which it
stands, and sorting by it puts the texts in order.

Defined results: names resolve from the main file's folder and need no extension; what lies outside that folder, is no ``.tex`` file, does
not exist, is being read already or lies deeper than ``DEPTH`` files is missing; null texts are empty; of several rows of one path the
smallest text counts; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

# How deep files may include files; the environments whose text stands as it is.
DEPTH = 16
VERBATIM = ("verbatim", "lstlisting", "minted", "Verbatim", "comment")

_MARK = "\x01"
_INCLUDE = r"\\(?:input|include)(?:\s*\{[^}]*\}|\s+[^\s\\{}%]+)"
_TOKEN = (
    r"(?s)\\begin\{(?:" + "|".join(VERBATIM) + r")\*?\}.*?\\end\{(?:" + "|".join(VERBATIM) + r")\*?\}"
    rf"|\\verb\*?(?![a-zA-Z])([^\n])(?:(?!\1)[^\n])*\1|{_INCLUDE}|%[^\n]*+|\\[\s\S]|[^\\%]++|[\s\S]"
)


def normal_path(path: Column) -> Column:
    """A path without empty and ``.`` parts, ``..`` taken back; null above the top."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("good"))

    def step(s: Column, p: Column) -> Column:
        up = F.struct(F.slice(s["kept"], 1, F.greatest(F.size(s["kept"]) - 1, F.lit(0))).alias("kept"), (s["good"] & (F.size(s["kept"]) > 0)).alias("good"))
        return F.when(p == "..", up).otherwise(F.struct(F.array_append(s["kept"], p).alias("kept"), s["good"].alias("good")))

    lead = F.when(path.startswith("/"), "/").otherwise("")
    return F.aggregate(parts, start, step, lambda s: F.when(s["good"], F.concat(lead, F.array_join(s["kept"], "/"))))


def _pieces(files: DataFrame) -> DataFrame:
    """path, at, text, name: the texts of each file and the names between them (one of both is null)."""
    token = lambda t: F.when(t.rlike(f"^{_INCLUDE}$"), F.concat(F.lit(_MARK), F.trim(F.regexp_replace(t, r"^\\(?:input|include)\s*\{?|\}$", "")), F.lit(_MARK))).when(t.startswith("%"), "").otherwise(t)
    text = F.translate("text", _MARK, "")
    joined = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), token), "")
    cut = files.select("path", F.posexplode(F.split(joined, _MARK, -1)).alias("at", "piece"))
    return cut.select("path", "at", F.when(F.col("at") % 2 == 0, F.col("piece")).alias("text"), F.when(F.col("at") % 2 == 1, F.col("piece")).alias("name"))


def whole_sources(files: DataFrame, mains: DataFrame, *, path: str = "path", text: str = "text") -> DataFrame:
    """path, text and missing (names in order, each once) of every main file, with all that it includes in place.

    ``files`` has path and text, ``mains`` path.
    """
    unique = stored(files.where(F.col(path).isNotNull()).groupBy(F.col(path).alias("path")).agg(F.coalesce(F.min(text), F.lit("")).alias("text")))
    folder = normal_root(F.regexp_extract("path", r"^(.*/)?[^/]*$", 1))
    # A folder above the top holds nothing; it has the mark, as no path begins with.
    starts = stored(unique.join(mains.select(F.col(path).alias("path")).distinct(), "path", "left_semi").select(F.coalesce(folder, F.lit(_MARK)).alias("folder"), "path"))
    laid = stored(_laid(unique, starts))
    heights, deep = _heights(laid, starts)
    found = reduce(DataFrame.unionByName, _from_below(laid, heights))
    if not deep.isEmpty():
        found = found.unionByName(_from_above(laid, deep))
    return found.select(F.col("path").alias(path), F.coalesce("text", F.lit("")).alias(text), F.coalesce("missing", _no_names()).alias("missing"))


#: What a source depends on: the folder of the main file, and the file.
KEY = ["folder", "path"]


def _no_names() -> Column:
    return F.array().cast("array<string>")


def _laid(unique: DataFrame, starts: DataFrame) -> DataFrame:
    """folder, path, at, text, name, target: the pieces of every file in every folder of main files; target is the file that a name includes, if any."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    inside = unique.where(F.lower("path").endswith(".tex")).select(F.explode(above).alias("folder"), "path").join(starts.select("folder").distinct(), "folder", "left_semi")
    placed = stored(inside.unionByName(starts).distinct().join(_pieces(unique), "path"))
    named = F.concat("folder", "name", F.when(F.regexp_extract("name", r"[^/]*$", 0).contains("."), "").otherwise(".tex"))
    wanted = placed.where("name is not null").select(*KEY, "at", "name", F.when(~F.col("name").startswith("/"), normal_path(named)).alias("target"))
    there = inside.select("folder", F.col("path").alias("target"), F.lit(True).alias("_there"))
    met = wanted.join(there, ["folder", "target"], "left").select(*KEY, "at", F.lit(None).cast("string").alias("text"), "name", F.when(F.col("_there"), F.col("target")).alias("target"))
    return placed.where("text <> ''").select(*KEY, "at", "text", "name", F.lit(None).cast("string").alias("target")).unionByName(met)


def _heights(laid: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with the number of includes on the longest way down, if that is below ``DEPTH``, and whether they are main files; and the other main files.

    A round keeps the includes of files that still go on, so it handles fewer than the one before.
    """
    still = laid.where("target is not null").select(*KEY, "target")
    no = F.lit(False).alias("main")
    reached = [laid.select(*KEY, F.lit(0).alias("height"), no).distinct(), starts.select(*KEY, F.lit(0).alias("height"), F.lit(True).alias("main"))]
    for height in range(1, DEPTH + 1):
        reached.append(still.select(*KEY, F.lit(height).alias("height"), no).distinct())
        if height < DEPTH:
            going = still.select("folder", F.col("path").alias("target")).distinct()
            still = stored(still.join(going, ["folder", "target"], "left_semi"))
            if still.isEmpty():
                break
    found = stored(reduce(DataFrame.unionByName, reached).groupBy(*KEY).agg(F.max("height").alias("height"), F.max("main").alias("main")))
    return found.where(F.col("height") < DEPTH), found.where((F.col("height") == DEPTH) & F.col("main")).select(*KEY)


def _from_below(laid: DataFrame, heights: DataFrame) -> list[DataFrame]:
    """folder, path, text, missing of the main files with a height, in a table for each height."""
    kept = [*KEY, "height", "main"]
    own = laid.where("target is null").join(heights, KEY).select(*kept, "at", F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("name").isNull(), _no_names()).otherwise(F.array("name")).alias("missing"))
    own = stored(own.unionByName(heights.where("main").select(*kept, F.lit(-1).alias("at"), F.lit("").alias("text"), _no_names().alias("missing"))))
    below = heights.select("folder", F.col("path").alias("target"), F.col("height").alias("below"))
    links = stored(laid.where("target is not null").select(*KEY, "at", "target").join(heights, KEY).join(below, ["folder", "target"]))
    parts, done = [own], []
    most = heights.agg(F.max("height")).first()[0]
    for height in range((most if most is not None else -1) + 1):
        here = [p.where(F.col("height") == height) for p in parts]
        ordered = F.array_sort(F.collect_list(F.struct("at", "text", "missing")))
        rows = reduce(DataFrame.unionByName, here).groupBy(*KEY, "main").agg(ordered.alias("p"))
        done.append(stored(rows.select(*KEY, "main", F.array_join("p.text", "").alias("text"), F.array_distinct(F.flatten("p.missing")).alias("missing"))))
        if height < most:
            taken = done[-1].select("folder", F.col("path").alias("target"), "text", "missing")
            parts.append(stored(links.where(F.col("below") == height).join(taken, ["folder", "target"]).select(*kept, "at", "text", "missing")))
    return [d.where("main").select(*KEY, "text", "missing") for d in done or [own]]


def _from_above(laid: DataFrame, starts: DataFrame) -> DataFrame:
    """folder, path, text, missing of files that are read by following their includes, ``DEPTH`` files deep."""
    open_rows = starts.select("folder", F.col("path").alias("main"), F.array("path").alias("stack"), F.col("path").alias("here"), F.array().cast("array<int>").alias("place"))
    texts, missing = [], []
    for depth in range(1, DEPTH + 1):
        met = open_rows.join(laid.withColumnRenamed("path", "here"), ["folder", "here"])
        good = F.coalesce(F.col("target").isNotNull() & ~F.array_contains("stack", F.col("target")), F.lit(False)) & F.lit(depth < DEPTH)
        met = stored(met.select("folder", "main", "stack", F.array_append("place", F.col("at")).alias("place"), "text", "name", F.when(good, F.col("target")).alias("here")))
        texts.append(met.where("name is null").select("folder", "main", "place", "text"))
        missing.append(met.where("name is not null and here is null").select("folder", "main", "place", "name"))
        open_rows = met.where("here is not null").select("folder", "main", F.array_append("stack", F.col("here")).alias("stack"), "here", "place")
        if open_rows.isEmpty():
            break
    main = ["folder", "main"]
    ordered = lambda c: F.array_sort(F.collect_list(F.struct("place", c)))[c]
    whole = reduce(DataFrame.unionByName, texts).groupBy(*main).agg(F.array_join(ordered("text"), "").alias("text"))
    lost = reduce(DataFrame.unionByName, missing).groupBy(*main, "name").agg(F.min("place").alias("place")).groupBy(*main).agg(ordered("name").alias("missing"))
    return whole.join(lost, main, "full").select("folder", F.col("main").alias("path"), "text", "missing")


def normal_root(root: Column) -> Column:
    """The folder of a main file as its normal path begins."""
    return F.when(normal_path(root).isin("", "/"), F.coalesce(normal_path(root), F.lit(""))).otherwise(F.concat(normal_path(root), F.lit("/")))
