"""Queries of the operators on references and layout, with their DuckDB SQL; the catalogue registers them.

Their inputs are made from the given tables: documents from parts, blocks, items and jobs from events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, references
from ..sources.reader import parse_df
from ..storage import spread, stored

REGISTERED: list[tuple[Callable[[SparkSession, str], DataFrame], str]] = []


def _with(oracle: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        REGISTERED.append((f, oracle))
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, dealt over all cores: each becomes a document."""
    return spread(_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey")


def _events(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    """doc_id and at of every event, with columns of SQL that DuckDB reads alike."""
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("at"), *[F.expr(c).alias(k) for k, c in columns.items()])


def _events_sql(**columns: str) -> str:
    return f"SELECT user_id AS doc_id, event_id AS \"at\", {', '.join(f'{c} AS {k}' for k, c in columns.items())} FROM events"


@_with(
    """
SELECT p_partkey AS doc_id, label, shown, count(*)::BIGINT AS n FROM (
  SELECT p_partkey, unnest(['s-' || i, 'f-' || i, 'none', 'early']) AS label, unnest([i::VARCHAR, i::VARCHAR, '[none]', '[early]']) AS shown
  FROM (SELECT p_partkey, unnest(range(1, p_partkey % 4 + 2)) AS i FROM part)) GROUP BY ALL"""
)
def reference_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed references of LaTeX documents: sections, figures, labels that no number stands for."""
    section = (
        r"format_string('\\section{S}\\label{s-%d}\n\nSee \\ref{s-%d}, \\ref{f-%d}, \\ref{none} and \\ref{early}.\n\n"
        r"\\begin{figure}\\includegraphics{a.png}\\caption{C}\\label{f-%d}\\end{figure}\n\n', i, i, i, i)"
    )
    source = F.expr(rf"concat('\\label{{early}}Start.\n\n', array_join(transform(sequence(1, cast(p_partkey % 4 as int) + 1), i -> {section}), ''))")
    nodes = stored(parse_df(_parts(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), source.alias("text")), "latex"))
    return references.printed_references(nodes).groupBy("doc_id", "label", "shown").agg(F.count("*").alias("n"))


@_with("SELECT p_partkey AS doc_id, p_brand || ' c l $x$ no. ' || p_size AS summary FROM part")
def heading_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with code, links, math, pictures and notes, as one line."""
    source = F.concat(F.lit("# "), "p_brand", F.lit(" `c` [l](u) $x$[^1] ![i](s) no. "), F.col("p_size").cast("string"), F.lit("\n\nText.\n\n[^1]: note\n"))
    nodes = parse_df(_parts(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), source.alias("text")), "markdown")
    return references.summary_text(nodes, "Heading").select("doc_id", "summary")


@_with(
    """
WITH m AS (SELECT user_id AS doc_id, list(event_id ORDER BY event_id) FILTER (event_type = 'view') AS marks,
  list('note ' || event_id ORDER BY event_id) FILTER (event_type IN ('click', 'error') AND event_id % 3 <> 0) AS notes FROM events GROUP BY user_id),
k AS (SELECT *, unnest(range(1, greatest(coalesce(len(marks), 0), coalesce(len(notes), 0)) + 1)) AS k FROM m)
SELECT doc_id, marks[k] AS mark, CASE WHEN len(notes) >= 1 AND marks[k] IS NOT NULL THEN coalesce(notes[k], '') ELSE notes[k] END AS note FROM k"""
)
def footnote_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks and texts of notes, paired by position."""
    events = _events(spark, sf_dir, kind="event_type", note="concat('note ', event_id)")
    return references.paired_notes(events.where("kind = 'view'"), events.where("kind in ('click', 'error') and at % 3 <> 0"))


_CAPTIONED = "CASE (event_id * event_id + event_id) % 7 WHEN 0 THEN 'caption' WHEN 2 THEN 'table' WHEN 6 THEN 'caption' WHEN 5 THEN 'image' ELSE CASE event_type WHEN 'view' THEN 'table' WHEN 'error' THEN 'caption' ELSE 'image' END END"


@_with(
    f"""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "at") AS r FROM ({_events_sql(kind=_CAPTIONED)}))
SELECT c.doc_id, c."at", CASE WHEN n.kind = 'table' THEN n."at" WHEN p.kind = 'image' THEN p."at" WHEN p.kind = 'table' AND coalesce(q.kind, '') <> 'caption' THEN p."at" END AS target
FROM b c LEFT JOIN b n ON n.doc_id = c.doc_id AND n.r = c.r + 1 LEFT JOIN b p ON p.doc_id = c.doc_id AND p.r = c.r - 1 LEFT JOIN b q ON q.doc_id = c.doc_id AND q.r = c.r - 2
WHERE c.kind = 'caption'"""
)
def caption_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table or picture that each caption belongs to."""
    return references.attached_captions(_events(spark, sf_dir, kind=_CAPTIONED))


@_with(
    """
WITH RECURSIVE e AS (SELECT p_partkey AS path, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS target FROM part WHERE p_partkey % 5 <> 4),
t(main, path, stack, depth) AS (SELECT path, path, [path], 0 FROM e
UNION ALL SELECT t.main, e.target, list_append(t.stack, e.target), t.depth + 1 FROM t JOIN e USING (path) WHERE NOT list_contains(t.stack, e.target) AND t.depth < 15)
SELECT main, count(*)::BIGINT AS n_files, max(depth)::BIGINT AS depth FROM t GROUP BY main"""
)
def included_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files each file pulls in, itself counted, and how deep, where includes run in circles."""
    part = _table(spark, sf_dir, "part")
    edges = part.crossJoin(F.broadcast(part.agg(F.count("*").alias("n")))).where("p_partkey % 5 <> 4").select(F.col("p_partkey").alias("path"), F.expr("(p_partkey * 7 + 3) % n").alias("target"))
    return references.included_files(edges).groupBy("main").agg(F.count("*").alias("n_files"), F.max("depth").cast("long").alias("depth"))


_BLOCKS = {"kind": "CASE WHEN event_type IN ('view', 'error') THEN 'heading' ELSE 'block' END", "level": "event_id % 3 + 1", "text": "event_type"}


@_with(
    f"""
WITH b AS (SELECT *, sum((kind = 'heading')::INT) OVER w AS plan, sum((kind = 'heading' AND level = 1)::INT) OVER w AS section FROM ({_events_sql(**_BLOCKS)}) WINDOW w AS (PARTITION BY doc_id ORDER BY "at")),
h AS (SELECT doc_id, plan, max(section) AS section, max(level) FILTER (kind = 'heading') AS level, max(text) FILTER (kind = 'heading') AS title, count(*) FILTER (kind <> 'heading') AS n_blocks FROM b GROUP BY ALL),
k AS (SELECT *, coalesce(level, 1) > 1 OR n_blocks > 0 AS kept FROM h)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY plan)::BIGINT AS slide, (CASE WHEN section > 0 THEN section - 1 END)::BIGINT AS section,
  greatest(coalesce(level, 2), 2)::BIGINT AS level, title, n_blocks::BIGINT AS n_blocks FROM k
WHERE kept OR doc_id NOT IN (SELECT doc_id FROM k WHERE kept)"""
)
def slide_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides and sections of documents by their headings."""
    plans = layout.slide_plans(_events(spark, sf_dir, **_BLOCKS))
    return plans.select("doc_id", F.col("slide").cast("long"), F.col("section").cast("long"), F.col("level").cast("long"), "title", "n_blocks")


_ITEMS = {"list": "event_id % 2", "level": "(event_id * event_id + event_id) % 3", "start": "event_id % 2 * 4 + 1"}


@_with(
    f"""
WITH i AS ({_events_sql(**_ITEMS)})
SELECT a.doc_id, a."at", (a.start + (SELECT count(*) FROM i b WHERE b.doc_id = a.doc_id AND b.list = a.list AND b.level = a.level AND b."at" < a."at"
  AND b."at" > coalesce((SELECT max(c."at") FROM i c WHERE c.doc_id = a.doc_id AND c.list = a.list AND c.level < a.level AND c."at" < a."at"), -1)))::BIGINT AS number FROM i a"""
)
def list_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of list items whose lists are interrupted by one another."""
    return layout.list_numbers(_events(spark, sf_dir, **_ITEMS)).select("doc_id", "at", F.col("number").cast("long"))


_JOBS = {"ok": "event_type NOT IN ('view', 'error') OR event_id % 4 = 0"}


@_with(
    f"""
WITH j AS (SELECT *, lag(ok) OVER w AS p, lag(ok, 2) OVER w AS q FROM ({_events_sql(**_JOBS)}) WINDOW w AS (PARTITION BY doc_id ORDER BY "at")),
e AS (SELECT doc_id, min("at") AS last FROM j WHERE NOT ok AND NOT p AND NOT q GROUP BY doc_id)
SELECT j.doc_id, count(*)::BIGINT AS n_run, count(*) FILTER (ok)::BIGINT AS n_ok FROM j LEFT JOIN e USING (doc_id) WHERE last IS NULL OR "at" <= last GROUP BY j.doc_id"""
)
def phase_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that run before three failures in a row end their phase."""
    run = layout.run_until_failures(_events(spark, sf_dir, **_JOBS), phase="doc_id")
    return run.groupBy("doc_id").agg(F.count("*").alias("n_run"), F.count(F.when(F.col("ok"), 1)).alias("n_ok"))


@_with(
    """
SELECT doc_id, string_agg(CASE WHEN n > 1 THEN feature || ' (' || n || ')' ELSE feature END, ', ' ORDER BY first) AS dropped
FROM (SELECT user_id AS doc_id, event_type AS feature, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY doc_id"""
)
def dropped_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents lost, counted."""
    return layout.dropped_census(_events(spark, sf_dir, feature="event_type"))


@_with(
    """
WITH b AS (SELECT user_id AS page_id, event_id * 37 % 256 // 8 AS bin, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, bin) AS r, sum(n) OVER (PARTITION BY page_id) AS every FROM b)
SELECT page_id, (bin * 8 + 4)::BIGINT AS level, round(n::DOUBLE / every::DOUBLE, 9) AS share FROM r WHERE r = 1"""
)
def background_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The background of pictures by their gray values."""
    pixels = _events(spark, sf_dir, gray="event_id * 37 % 256", n="1").withColumnRenamed("doc_id", "page_id")
    return layout.background_level(pixels).select("page_id", F.col("level").cast("long"), F.round("share", 9).alias("share"))


@_with("SELECT p_partkey, coalesce(p_partkey % 5 NOT IN (1, 2) AND p_partkey % 5 <> 4 AND p_size * (p_partkey % 97) >= 1024, false) AS worth FROM part")
def images_worth_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures that a model should see; one in five has no known form."""
    form = F.expr("element_at(array('PNG', 'EMF', 'WMF', 'JPEG', null), cast(p_partkey % 5 as int) + 1)")
    return _table(spark, sf_dir, "part").select("p_partkey", layout.worth_reading(form, F.col("p_size"), F.col("p_partkey") % 97).alias("worth"))


_BOX = {"x0": "event_id % 3 * 0.3D", "x1": "event_id % 3 * 0.3D + 0.1D + event_id % 5 * 0.1D", "y0": "event_id * 7 % 40 * 0.025D", "y1": "event_id * 7 % 40 * 0.025D + event_id % 4 * 0.08D"}
_BOX_SQL = {k: v.replace("0.3D", "0.3::DOUBLE").replace("0.1D", "0.1::DOUBLE").replace("0.025D", "0.025::DOUBLE").replace("0.08D", "0.08::DOUBLE") for k, v in _BOX.items()}


@_with(
    f"""
WITH b AS (SELECT *, "at" // 8 AS page_id, "at" % 31 <> 0 AS plain FROM ({_events_sql(**_BOX_SQL)})),
s AS (SELECT * FROM b WHERE x1 - x0 < 0.35::DOUBLE AND y1 - y0 < 0.2::DOUBLE)
SELECT page_id, bool_or(NOT plain) OR page_id IN (SELECT a.page_id FROM s a JOIN s c ON a.page_id = c.page_id AND a."at" < c."at" AND least(a.y1, c.y1) > greatest(a.y0, c.y0)) AS needed
FROM b GROUP BY page_id"""
)
def pages_needing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose blocks need labels, eight blocks on each."""
    blocks = _events(spark, sf_dir, **_BOX).selectExpr("at div 8 as page_id", "struct(x0, y0, x1, y1) as box", "at % 31 <> 0 as plain")
    return layout.needs_labels(blocks)


_CODE = {"kind": "CASE WHEN event_type IN ('view', 'error', 'click') THEN 'code' ELSE 'text' END", "language": "CASE WHEN event_id % 3 = 0 THEN event_type END"}


@_with(
    f"""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "at") AS r FROM ({_events_sql(**_CODE)})),
c AS (SELECT *, sum((kind <> 'code')::INT) OVER (PARTITION BY doc_id ORDER BY r) AS run FROM b)
SELECT doc_id, min(r)::BIGINT AS first, max(r)::BIGINT AS last, string_agg('x' || "at", chr(10) ORDER BY r) AS code, first(language ORDER BY r) FILTER (language IS NOT NULL) AS language
FROM c WHERE kind = 'code' GROUP BY doc_id, run"""
)
def merged_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of code blocks as one, in the first language found."""
    from pyspark.sql import Window

    events = _events(spark, sf_dir, **_CODE, code="concat('x', event_id)")
    numbered = events.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")).cast("long"))
    return layout.code_runs(numbered)
