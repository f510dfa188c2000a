"""License scans by an exact set-similarity join, in DataFrame functions only.

Texts are read as overlapping blocks of words, templates as sets of words.  A
block matches a template when it holds at least ``THRESHOLD`` of its distinct
words (containment).  The join is exact and never compares a block with a
template it cannot match:

* template words are ordered by their document frequency over the whole table;
* prefix filter: a match must contain one of the ``t - o + 1`` rarest words of
  a template of ``t`` words of which ``o`` must be found, so only blocks around
  such words are formed at all;
* length filter: a block with fewer than ``o`` distinct words cannot match;
* positional filter: the block must hold ``o`` template words from the place
  of the shared word in the global order on.

What is left is verified in full.  Blocks are ``2 m`` words long and begin at
every ``m``-th word, ``m`` the longest template, so that every stretch of
``m`` words lies inside one.  Only the hits, a few rows per licensed document,
are shuffled.

Defined results: null and empty texts have no words and no labels, score 0;
repeated rows give repeated results; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_WORD, lower_sql

#: Phrases whose places always count, with their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices as they stand in files, lower-cased.
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ],
    "apache-2": ["licensed under the apache license version 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "gpl-3": ["licensed under the gnu general public license version 3"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "public-domain": ["this is free and unencumbered software released into the public domain"],
}
#: Part of a template's distinct words that a block must hold.
THRESHOLD = 0.9


def template_sets() -> list[tuple[str, list[str]]]:
    """(label, distinct words) of every template."""
    return [(label, list(dict.fromkeys(t.split()))) for label, texts in TEMPLATES.items() for t in texts]


def block_step() -> int:
    """Words of the longest template."""
    return max(len(t.split()) for texts in TEMPLATES.values() for t in texts)


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    return F.array_remove(F.split(lower_sql(F.coalesce(text, F.lit(""))), NON_WORD), "")


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def frequencies(worded: DataFrame) -> dict[str, int]:
    """Documents that hold each template word: at most one row per word of the template vocabulary."""
    vocabulary = sorted({w for _, ws in template_sets() for w in ws})
    rows = worded.select(F.explode(F.array_intersect("words", _strings(vocabulary))).alias("w")).groupBy("w").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r["w"]: r["count"] for r in rows}


def matches(worded: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, key, label, containment of every block that meets a template's threshold."""
    found = frequencies(worded)
    order = sorted(found, key=lambda w: (found[w], w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for label, words in template_sets():
        ordered = sorted(words, key=rank.__getitem__)
        needed = math.ceil(threshold * len(ordered) - 1e-9)
        index += [(w, label, ordered, needed, rank[w]) for w in ordered[: len(ordered) - needed + 1]]
    spark = worded.sparkSession
    entries = F.broadcast(spark.createDataFrame(index, "token string, label string, template array<string>, needed int, place int"))
    rare = _strings(sorted({i[0] for i in index}))
    step = block_step()
    ranks = F.create_map(*[F.lit(x) for w, i in rank.items() for x in (w, i)])
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(rare, F.get("words", i)))
    at = worded.where(F.arrays_overlap("words", rare)).select("doc_id", "key", "words", F.explode(places).alias("at"))
    nth = F.floor(F.col("at") / step).cast("int")
    blocks = at.select(
        "doc_id", "key", "words", F.get("words", F.col("at")).alias("token"),
        F.explode(F.when(nth > 0, F.array(nth - 1, nth)).otherwise(F.array(nth))).alias("block"),
    ).select(
        "doc_id", "key", "token", F.array_distinct(F.slice("words", F.col("block") * step + 1, 2 * step)).alias("held")
    )
    later = F.size(F.filter("held", lambda w: F.coalesce(ranks[w], F.lit(-1)) >= F.col("place")))
    common = F.size(F.array_intersect("held", "template"))
    return (
        blocks.join(entries, "token")
        .where(F.size("held") >= F.col("needed"))
        .where(later >= F.col("needed"))
        .where(common >= F.col("needed"))
        .select("doc_id", "key", "label", (common / F.size("template")).alias("containment"))
    )


def phrase_places(phrase: str) -> Column:
    """Starts of a phrase in ``words``, from 0."""
    parts = phrase.split()
    here = lambda i: F.forall(F.array(*[F.get("words", i + k) == p for k, p in enumerate(parts)]), lambda x: x)
    present = F.lit(True)
    for p in sorted(parts, key=len, reverse=True)[:2]:
        present &= F.array_contains("words", p)
    return F.when(
        present & (F.size("words") >= len(parts)), F.filter(F.sequence(F.lit(0), F.size("words") - len(parts)), here)
    ).otherwise(F.array().cast("array<int>"))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    worded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("key"), words_of(text).alias("words"))
    hits = (
        matches(worded)
        .groupBy("doc_id", "key")
        .agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
        .withColumnsRenamed({"doc_id": "_doc", "key": "_key"})
    )
    placed = worded.select(
        "doc_id", "key", F.size("words").cast("long").alias("n_words"),
        *[phrase_places(p).alias(f"_{i}") for i, p in enumerate(BASE_PHRASES)],
    )
    lists = [f"_{i}" for i in range(len(BASE_PHRASES))]
    every = F.concat(*lists)
    base = F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for c, label in zip(lists, BASE_PHRASES.values(), strict=True)]))
    placed = placed.select(
        "doc_id", "key", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"), F.sort_array(F.array_distinct(base)).alias("base"),
    )
    both = placed.join(hits, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """The same in DuckDB: every block against every template, without filters."""
    from .common import LOWER, UPPER

    step = block_step()
    values = ", ".join(f"('{label}', [{', '.join(repr(w) for w in ws)}])" for label, ws in template_sets())
    starts = []
    for phrase, label in BASE_PHRASES.items():
        parts = phrase.split()
        test = " AND ".join(f"words[i + {k + 1}] = '{p}'" for k, p in enumerate(parts))
        starts.append(f"SELECT doc_id, i AS place, '{label}' AS label FROM (SELECT doc_id, words, unnest(range(0, len(words) - {len(parts) - 1})) AS i FROM w) WHERE {test}")
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
base AS ({" UNION ALL ".join(starts)}),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM base GROUP BY doc_id),
blocks AS (SELECT doc_id, list_distinct(words[i + 1 : i + {2 * step}]) AS held FROM (SELECT doc_id, words, unnest(range(0, len(words), {step})) AS i FROM w)),
templates(label, template) AS (VALUES {values}),
hits AS (SELECT doc_id, label, len(list_intersect(held, template))::DOUBLE / len(template) AS containment FROM blocks, templates
         WHERE len(list_intersect(held, template)) >= ceil({THRESHOLD} * len(template) - 1e-9)),
h AS (SELECT doc_id, list(DISTINCT label) AS labels, max(containment) AS containment FROM hits GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
  coalesce(array_to_string(b.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []::VARCHAR[]), coalesce(h.labels, []::VARCHAR[])))), ',') AS labels,
  CASE WHEN b.n_base > 0 THEN 1.0 ELSE coalesce(h.containment, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN h USING (doc_id)
"""
