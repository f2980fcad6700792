"""Preference formatting: a shared prompt and two masked completions, with DataFrame functions only.

The longest common turn prefix of the chosen and the rejected conversation is rendered once as the prompt. What follows
in either is a completion; its mask lists, as start:end in code points, the parts to be learned: the texts of assistant
turns with their end marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The marks of a widely used chat template.
START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns: one row a conversation, its turns (role, text) in order of turn, then role and text.

    Null roles and texts become empty strings; rows with a null conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    ordered = F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text"))))
    return (
        turns.filter("conv_id is not null")
        .groupBy("conv_id")
        .agg(ordered.alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))
    )


def common_turns(a: Column, b: Column) -> Column:
    """The number of turns at the start that agree in role and text."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x.role == y.role) & (x.text == y.text), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def render(turns: Column) -> Column:
    parts = F.transform(turns, lambda t: F.concat(F.lit(START), t.role, F.lit("\n"), t.text, F.lit(END + "\n")))
    return F.array_join(parts, "")


def mask(turns: Column) -> Column:
    """start:end of each part to be learned, comma-joined, within the rendered turns."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc.at + F.lit(len(START) + 1) + F.char_length(t.role)
        end = begin + F.char_length(t.text) + F.lit(len(END))
        span = F.concat_ws(":", begin.cast("string"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(t.role == LEARNED, F.concat(acc.spans, F.array(span))).otherwise(acc.spans).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: F.array_join(acc.spans, ","))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pair_id, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask for every row of pairs.

    pairs: pair_id and the arrays of turns chosen and rejected. Where one is null there is nothing to compare: the
    prompt is empty, the other is a whole completion, and the missing one's columns are null. Where one conversation
    begins the other, its completion is empty; equal conversations are all prompt. Very long turns are rendered whole;
    repeated rows agree; other columns are ignored, whatever their names; no rows give none.
    """
    both = F.col("chosen").isNotNull() & F.col("rejected").isNotNull()
    n = F.when(both, common_turns(F.col("chosen"), F.col("rejected"))).otherwise(0)
    whole = F.coalesce("chosen", "rejected")
    cut = pairs.withColumn("prompt_turns", n).withColumn("prompt", F.when(F.col("prompt_turns") > 0, render(F.slice(whole, F.lit(1), F.col("prompt_turns")))).otherwise(""))
    after = {c: F.slice(F.col(c), F.col("prompt_turns") + 1, F.greatest(F.size(c), F.lit(0))) for c in ("chosen", "rejected")}
    return cut.select(
        "pair_id",
        F.col("prompt_turns").cast("long").alias("prompt_turns"),
        "prompt",
        *[x for c in after for x in (render(after[c]).alias(c), mask(after[c]).alias(f"{c}_mask"))],
    )


def swapped_replies(turns: DataFrame) -> DataFrame:
    """Preference pairs out of plain conversations: each is chosen over itself with a foreign final reply.

    Conversations 2k and 2k + 1 are partners. The rejected side is the conversation up to its last assistant turn, with
    the partner's last assistant text there. A conversation without an assistant turn, or whose partner is missing or
    has none, has a null rejected side. Very long texts stay whole; repeated turns stand beside each other; other columns
    are ignored, whatever their names; no turns give no pairs.
    """
    own = conversations(turns).withColumn("last", F.array_max(F.transform("turns", lambda t, i: F.when(t.role == LEARNED, i))))
    partner = F.col("conv_id") + 1 - 2 * F.pmod("conv_id", F.lit(2))
    replies = own.filter("last is not null").select(partner.alias("conv_id"), F.element_at(F.col("turns"), F.col("last") + 1).getField("text").alias("reply"))
    swapped = F.concat(F.slice("turns", F.lit(1), F.col("last")), F.array(F.struct(F.lit(LEARNED).alias("role"), F.col("reply").alias("text"))))
    return own.join(replies, "conv_id", "left").select(
        F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.when(F.col("last").isNotNull() & F.col("reply").isNotNull(), swapped).alias("rejected")
    )


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_preferences(swapped_replies(table(spark, sf_dir, "conversations")))


OP8_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), last AS (
  SELECT conv_id, max(k) FILTER (WHERE role = 'assistant') AS k FROM t GROUP BY conv_id
), reply AS (
  SELECT t.conv_id + 1 - 2 * (t.conv_id % 2) AS conv_id, t.text FROM t JOIN last USING (conv_id, k)
), side AS (
  SELECT conv_id, 'chosen' AS side, k, role, text FROM t
  UNION ALL
  SELECT t.conv_id, 'rejected', t.k, t.role, t.text FROM t JOIN last USING (conv_id) JOIN reply USING (conv_id) WHERE t.k < last.k
  UNION ALL
  SELECT conv_id, 'rejected', last.k, 'assistant', reply.text FROM last JOIN reply USING (conv_id) WHERE last.k IS NOT NULL
), ids AS (
  SELECT conv_id, max(CASE WHEN side = 'rejected' THEN 1 ELSE 0 END) AS paired FROM side GROUP BY conv_id
), differ AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id,
         min(CASE WHEN c.role = r.role AND c.text = r.text THEN NULL ELSE coalesce(c.k, r.k) END) AS first,
         max(coalesce(c.k, r.k)) AS longest
  FROM (SELECT * FROM side WHERE side = 'chosen') c
  FULL JOIN (SELECT * FROM side WHERE side = 'rejected') r ON c.conv_id = r.conv_id AND c.k = r.k
  GROUP BY 1
), cut AS (
  SELECT conv_id, paired, CASE WHEN paired = 1 THEN coalesce(first - 1, longest) ELSE 0 END AS n
  FROM ids JOIN differ USING (conv_id)
), sized AS (
  SELECT s.*, n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS part FROM side s JOIN cut USING (conv_id)
), placed AS (
  SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY conv_id, side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 13 + length(role) AS start
  FROM sized WHERE k > n
), made AS (
  SELECT conv_id, side, string_agg(part, '' ORDER BY k) AS text,
         string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(sized_text) AS BIGINT), ',' ORDER BY k) FILTER (WHERE role = 'assistant') AS mask
  FROM (SELECT *, text || '<|im_end|>' AS sized_text FROM placed) GROUP BY conv_id, side
), prompts AS (
  SELECT conv_id, string_agg(part, '' ORDER BY k) AS prompt FROM sized WHERE side = 'chosen' AND k <= n GROUP BY conv_id
)
SELECT cut.conv_id AS pair_id, CAST(n AS BIGINT) AS prompt_turns, coalesce(prompt, '') AS prompt,
       coalesce(c.text, '') AS chosen, coalesce(c.mask, '') AS chosen_mask,
       CASE WHEN paired = 1 THEN coalesce(r.text, '') END AS rejected, CASE WHEN paired = 1 THEN coalesce(r.mask, '') END AS rejected_mask
FROM cut
LEFT JOIN prompts USING (conv_id)
LEFT JOIN made c ON c.conv_id = cut.conv_id AND c.side = 'chosen'
LEFT JOIN made r ON r.conv_id = cut.conv_id AND r.side = 'rejected'
"""
