"""Styled runs of text as Markdown, for the runs of all paragraphs at once.

Neighbouring runs of one style are one (islands).  How far a style lasts from a run on is the
distance to the next run without it, a running minimum from behind; white space alone does
not end it.  A fold over the runs of a paragraph then opens what lasts longest first, so that markers nest,
and closes what ends; spaces stay outside.  At last each pair of markers takes the first of its forms that opens and closes
where it stands.

Defined results: null texts are empty and null styles are none; rows that are no text (``other``) come as they are and end all styles;
an empty table gives an empty result.  The runs of one paragraph are one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import let

# The styles and the forms of their markers, the preferred one first.
FORMS = {
    "bold": (("**", "**"), ("<strong>", "</strong>")),
    "italic": (("_", "_"), ("*", "*"), ("<em>", "</em>")),
    "strikethrough": (("~~", "~~"), ("<del>", "</del>")),
}
STYLES = tuple(FORMS)
_TEXT, _OPEN, _CLOSE = 0, 1, 2
_PIECE = "struct<mark: int, style: string, value: string>"


def merged_runs(runs: DataFrame, *, id_col: str = "doc_id", at: str = "at") -> DataFrame:
    """Runs with neighbours of one style joined; their place is that of the first."""
    w = Window.partitionBy(id_col).orderBy(at)
    plain = runs.select(id_col, at, F.coalesce("text", F.lit("")).alias("text"), *(F.coalesce(F.col(s), F.lit(False)).alias(s) for s in STYLES), F.coalesce("other", F.lit(False)).alias("other"))
    style = F.struct(*STYLES, "other")
    starts = F.when(F.lag(style).over(w).eqNullSafe(style) & ~F.col("other"), 0).otherwise(1)
    placed = plain.withColumn("_starts", starts).withColumn("_run", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    text = F.array_join(F.array_sort(F.collect_list(F.struct(at, "text")))["text"], "")
    return placed.groupBy(id_col, "_run", *STYLES, "other").agg(F.min(at).alias(at), text.alias("text")).drop("_run")


def _with_extents(runs: DataFrame, id_col: str, at: str) -> DataFrame:
    """``_e_`` and the style: how many runs that are not blank keep a style from each run on."""
    w = Window.partitionBy(id_col).orderBy(at)
    full = F.col("other") | (F.trim(F.translate("text", "\t\n\r", "   ")) != "")
    n = F.sum(F.when(full, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = runs.withColumns({"_full": full, "_n": n})
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ends = {f"_end_{s}": F.coalesce(F.min(F.when(F.col("_full") & (F.col("other") | ~F.col(s)), F.col("_n"))).over(ahead), F.max("_n").over(ahead) + 1) for s in STYLES}
    return rows.withColumns(ends).withColumns({f"_e_{s}": F.col(f"_end_{s}") - F.col("_n") for s in STYLES})


def _pieces(runs: Column) -> Column:
    """Texts and markers of a paragraph in order."""
    piece = lambda mark, style, value: F.struct(F.lit(mark).alias("mark"), style.alias("style"), value.alias("value"))
    text = lambda value: F.array(piece(_TEXT, F.lit(""), value))
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast(f"array<{_PIECE}>").alias("out"), F.lit("").alias("spaces"))

    def closed(s: Column, keep: Column) -> Column:
        """The pieces with the markers from ``keep`` on closed, innermost first, and the spaces behind them."""
        gone = F.reverse(F.slice(s["stack"], keep + 1, F.greatest(F.size(s["stack"]) - keep, F.lit(0))))
        return F.concat(s["out"], F.transform(gone, lambda x: piece(_CLOSE, x, F.lit(""))), text(s["spaces"]))

    def step(s: Column, r: Column) -> Column:
        lead, trail = F.regexp_extract(r["text"], r"^(\s*)", 1), F.regexp_extract(r["text"], r"(\s*)$", 1)
        core = F.regexp_replace(r["text"], r"^\s+|\s+$", "")
        wanted = F.filter(F.array(*(F.when(r[x], F.lit(x)) for x in STYLES)), lambda x: x.isNotNull())
        # What stays open: the outer markers up to the first that the run does not have.
        first_gone = F.array_min(F.filter(F.transform(s["stack"], lambda x, i: F.when(~F.array_contains(wanted, x), i)), lambda i: i.isNotNull()))

        def opened(keep: Column) -> Column:
            kept = F.slice(s["stack"], 1, keep)
            lasting = [F.when(r[x] & ~F.array_contains(kept, x), F.struct((-r[f"_e_{x}"]).alias("e"), F.lit(k).alias("k"), F.lit(x).alias("x"))) for k, x in enumerate(STYLES)]
            new = F.transform(F.array_sort(F.filter(F.array(*lasting), lambda x: x.isNotNull())), lambda t: t["x"])
            pieces = lambda n: F.concat(closed(s, keep), text(lead), F.transform(n, lambda x: piece(_OPEN, x, F.lit(""))), text(core))
            return let(new, lambda n: F.struct(F.concat(kept, n).alias("stack"), pieces(n).alias("out"), trail.alias("spaces")))

        styled = let(F.coalesce(first_gone, F.size(s["stack"])), opened)
        blank = F.struct(s["stack"].alias("stack"), s["out"].alias("out"), F.concat(s["spaces"], r["text"]).alias("spaces"))
        other = F.struct(F.array().cast("array<string>").alias("stack"), F.concat(closed(s, F.lit(0)), text(r["text"])).alias("out"), F.lit("").alias("spaces"))
        return F.when(r["other"], other).when(core == "", blank).otherwise(styled)

    return F.aggregate(runs, start, step, lambda s: F.filter(closed(s, F.lit(0)), lambda p: (p["mark"] > 0) | (p["value"] != "")))


def _forms(pieces: Column) -> Column:
    """The text of every marker by its place: the first form that fits at both ends."""
    at = lambda i: F.get(pieces, i)
    marked = lambda i: F.coalesce(at(i)["mark"] > 0, F.lit(False))
    before = lambda i: F.when(i == 0, " ").when(marked(i - 1), "*").otherwise(F.right(at(i - 1)["value"], F.lit(1)))
    after = lambda i: F.when(i == F.size(pieces) - 1, " ").when(marked(i + 1), "*").otherwise(F.left(at(i + 1)["value"], F.lit(1)))

    def fits(form: str, i: Column, opens: bool) -> Column:
        if form.startswith("<"):
            return F.lit(True)
        b, a = before(i), after(i)
        space, sign = lambda c: c.rlike(r"^\s$"), lambda c: c.rlike(r"^[\p{P}\p{S}]$")
        left = ~space(a) & (~sign(a) | space(b) | sign(b))
        right = ~space(b) & (~sign(b) | space(a) | sign(a))
        if form[0] == "_":
            return left & (~right | sign(b)) if opens else right & (~left | sign(a))
        good = left if opens else right
        return good & ~marked(i - 1) & ~marked(i + 1) if form == "*" else good

    places = F.when(F.size(pieces) > 0, F.sequence(F.lit(0), F.size(pieces) - 1)).otherwise(F.array().cast("array<int>"))
    partner = lambda i: F.array_min(F.filter(places, lambda j: (j > i) & (at(j)["mark"] == _CLOSE) & (at(j)["style"] == at(i)["style"])))

    def ends(i: Column, j: Column) -> Column:
        chosen = F.lit(None).cast("struct<a: string, b: string>")
        for style, forms in FORMS.items():
            shown = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in forms]
            best = shown[-1]
            for k in range(len(forms) - 2, -1, -1):
                best = F.when(fits(forms[k][0], i, True) & fits(forms[k][1], j, False), shown[k]).otherwise(best)
            chosen = F.when(at(i)["style"] == style, best).otherwise(chosen)
        return let(chosen, lambda c: F.array(F.struct(i.alias("at"), c["a"].alias("sign")), F.struct(j.alias("at"), c["b"].alias("sign"))))

    pairs = F.transform(F.filter(places, lambda i: at(i)["mark"] == _OPEN), lambda i: F.struct(i.alias("i"), partner(i).alias("j")))
    return F.map_from_entries(F.flatten(F.transform(pairs, lambda p: ends(p["i"], p["j"]))))


def emphasised(runs: DataFrame, *, id_col: str = "doc_id", at: str = "at") -> DataFrame:
    """id and markdown of every paragraph.

    ``runs`` has id, an order, text (escaped already), bold, italic, strikethrough and other.
    """
    told = _with_extents(merged_runs(runs, id_col=id_col, at=at), id_col, at)
    each = F.struct(F.col(at).alias("_at"), "text", *STYLES, "other", *(f"_e_{s}" for s in STYLES))
    paragraphs = told.groupBy(id_col).agg(F.array_sort(F.collect_list(each)).alias("_runs"))
    made = paragraphs.select(id_col, _pieces(F.col("_runs")).alias("_p")).select(id_col, "_p", _forms(F.col("_p")).alias("_signs"))
    return made.select(id_col, F.array_join(F.transform("_p", lambda p, i: F.coalesce(F.try_element_at("_signs", i), p["value"])), "").alias("markdown"))
