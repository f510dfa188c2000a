"""Preference formatting of chat turns, in DataFrame functions only.

A pair is a chosen and a rejected conversation.  Their longest common turn
prefix is rendered once, as the prompt; after it the completions stand side by
side, turn by turn, each with the mask of what is learned: the answers of the
assistant with their end mark, but not the header before them.

The prefix is found by digests: the rows of a turn are counted by digest on
either side, and the first turn with unequal counts ends the prefix.  Texts
meet the end of their pair's prefix after that, and only the rows of one turn
are put together, so no conversation is gathered into one row or task, however
long it is.

Defined results: a null text renders as an empty turn, a null role as
``unknown``, both equal to themselves; rows with a null pair or turn are left
out; several rows of one turn are equal if their counts are, and are rendered
in the order (role, text), each as often as it stands there; identical
conversations are all prompt; a conversation missing on one side leaves the
other as a completion beside an empty text; rows of another side than chosen or
rejected are left out; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
SIDES = ("chosen", "rejected")


def _rendered(rows: Column) -> Column:
    """Text and mask (begin:end in code points, comma-joined) of the sorted rows of a turn."""

    def more(done: Column, row: Column) -> Column:
        head = F.concat(F.lit(START), row["role"], F.lit("\n"))
        text = F.concat(done["text"], head, row["text"], F.lit(END), F.lit("\n"))
        begin = F.char_length(done["text"]) + F.char_length(head)
        span = F.concat_ws(":", begin, F.char_length(text) - 1)
        comma = F.when(done["mask"] == "", "").otherwise(",")
        return F.struct(text.alias("text"), F.when(row["role"] == "assistant", F.concat(done["mask"], comma, span)).otherwise(done["mask"]).alias("mask"))

    return F.aggregate(rows, F.struct(F.lit("").alias("text"), F.lit("").alias("mask")), more)


def preference_pairs(turns: DataFrame) -> DataFrame:
    """pair_id, turn, part (prompt, completion), prompt, chosen, rejected, chosen_mask, rejected_mask.

    ``turns`` has pair_id, side (chosen or rejected), turn, role, text.  Rows
    of the prompt have its text, rows of a completion both sides' texts and
    masks; the rest is null.
    """
    rows = turns.where("pair_id is not null and turn is not null").where(F.col("side").isin(*SIDES)).select(
        "pair_id", "side", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    balance = F.sum(F.when(F.col("side") == SIDES[0], 1).otherwise(-1))
    marks = rows.select("pair_id", "turn", "side", F.sha2(F.concat_ws("\n", F.sha2("role", 256), "text"), 256).alias("mark"))
    unequal = marks.groupBy("pair_id", "turn", "mark").agg(balance.alias("balance")).where("balance <> 0")
    ends = unequal.groupBy(F.col("pair_id").alias("_pair")).agg(F.min("turn").alias("end"))
    met = rows.join(ends, F.col("pair_id") == F.col("_pair"), "left").select("pair_id", "turn", "side", "role", "text", (F.col("end").isNull() | (F.col("turn") < F.col("end"))).alias("in_prompt"))
    of = lambda name: _rendered(F.sort_array(F.collect_list(F.when(F.col("side") == name, F.struct("role", "text"))))).alias(name)
    paired = met.repartition("pair_id", "turn").groupBy("pair_id", "turn", "in_prompt").agg(*map(of, SIDES))
    after = lambda c: F.when(~F.col("in_prompt"), F.col(c))
    return paired.select(
        "pair_id", "turn", F.when(F.col("in_prompt"), "prompt").otherwise("completion").alias("part"), F.when(F.col("in_prompt"), F.col("chosen.text")).alias("prompt"),
        *[after(f"{s}.text").alias(s) for s in SIDES], *[after(f"{s}.mask").alias(f"{s}_mask") for s in SIDES],
    )


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """Pairs made of single conversations: the rejected side ends with a stranger's answer.

    Conversation ``c`` is chosen as it is; its rejected twin has the last
    assistant turn of conversation ``c xor 1`` in place of its own.  Without
    such a partner, or without an assistant turn, both sides are equal.
    """
    rows = conversations.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    last = (
        rows.where("role = 'assistant'").groupBy("pair_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    )
    own = last.select(F.col("pair_id").alias("_own"), F.col("last.turn").alias("_turn"))
    partner = last.select(F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("_partner"), F.col("last.text").alias("_text"))
    swap = own.join(partner, F.col("_own") == F.col("_partner")).select("_own", "_turn", "_text")
    stranger = (F.col("turn") == F.col("_turn")) & (F.col("role") == "assistant")
    rejected = rows.join(swap, F.col("pair_id") == F.col("_own"), "left").select(
        "pair_id", F.lit("rejected").alias("side"), "turn", "role", F.when(stranger, F.col("_text")).otherwise(F.col("text")).alias("text")
    )
    return rows.select("pair_id", F.lit("chosen").alias("side"), "turn", "role", "text").unionByName(rejected)


ORACLE = f"""
WITH t AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
last AS (SELECT pair_id, max({{'turn': turn, 'text': coalesce(text, '')}}) AS last FROM t WHERE role = 'assistant' GROUP BY pair_id),
swap AS (SELECT a.pair_id, a.last.turn AS at, b.last.text AS text FROM last a JOIN last b ON b.pair_id = xor(a.pair_id, 1)),
both_sides AS (
  SELECT pair_id, 'chosen' AS side, turn, role, text FROM t
  UNION ALL
  SELECT t.pair_id, 'rejected', t.turn, t.role, CASE WHEN t.turn = swap.at AND t.role = 'assistant' THEN swap.text ELSE t.text END
  FROM t LEFT JOIN swap ON t.pair_id = swap.pair_id),
sided AS (SELECT pair_id, side, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM both_sides),
counted AS (
  SELECT pair_id, turn, role, text, count(*) FILTER (WHERE side = 'chosen') AS chosen, count(*) FILTER (WHERE side = 'rejected') AS rejected FROM sided GROUP BY ALL),
ends AS (SELECT pair_id, min(turn) AS "end" FROM counted WHERE chosen <> rejected GROUP BY pair_id),
parted AS (SELECT sided.*, "end" IS NULL OR turn < "end" AS in_prompt, '{START}' || role || chr(10) AS head FROM sided LEFT JOIN ends USING (pair_id)),
pieces AS (SELECT *, head || text || '{END}' || chr(10) AS piece, row_number() OVER (PARTITION BY pair_id, turn, side ORDER BY role, text) AS nth FROM parted),
placed AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY pair_id, turn, side ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pieces),
sides AS (
  SELECT pair_id, turn, in_prompt, side, string_agg(piece, '' ORDER BY nth) AS text,
    coalesce(string_agg((before + length(head))::BIGINT || ':' || (before + length(piece) - 1)::BIGINT, ',' ORDER BY nth) FILTER (WHERE role = 'assistant'), '') AS mask
  FROM placed GROUP BY ALL)
SELECT pair_id, turn, CASE WHEN in_prompt THEN 'prompt' ELSE 'completion' END AS part,
  max(text) FILTER (WHERE side = 'chosen' AND in_prompt) AS prompt,
  CASE WHEN NOT in_prompt THEN coalesce(max(text) FILTER (WHERE side = 'chosen'), '') END AS chosen,
  CASE WHEN NOT in_prompt THEN coalesce(max(text) FILTER (WHERE side = 'rejected'), '') END AS rejected,
  CASE WHEN NOT in_prompt THEN coalesce(max(mask) FILTER (WHERE side = 'chosen'), '') END AS chosen_mask,
  CASE WHEN NOT in_prompt THEN coalesce(max(mask) FILTER (WHERE side = 'rejected'), '') END AS rejected_mask
FROM sides GROUP BY pair_id, turn, in_prompt
"""
