"""Preference formatting of chosen and rejected conversations.

DataFrame functions only. Turns of a pair are matched by turn number; the longest common prefix
ends before the first turn number that only one side has or where role or text differ. The
prefix is rendered once as the prompt, what is left of each side as its completion, with the
character spans that a loss may be taken over: the texts and end marks of assistant turns.

Turns are dealt once by pair, texts included; what follows (one row per turn, the two sides of a
turn beside each other, the pair) is sorted and grouped where it lies. No pairs of conversations
but those asked for are made. The table of the query holds no preferences; its pairs are the
conversations 2k and 2k + 1, and most of them differ from the first turn.

A null text is empty, a null role ``unknown``. Rows without a conversation id or turn number are
left out. Of several rows for one turn the least (role, text) counts. A conversation without a
partner is chosen, and its other side is null and renders as empty; so does one without turns.
Identical conversations have two empty completions. A rendered conversation, of any length, must
fit a row. An empty table gives an empty table. Extra input columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import table

END = "<|end|>\n"


def head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def rendered(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda t: F.concat(head(t["role"]), t["text"], F.lit(END))), "")


def loss_spans(parts: Column) -> Column:
    """``start-end`` of each trained span of the rendered parts, joined by commas."""
    size = lambda t: F.length(head(t["role"])) + F.length(t["text"]) + len(END)
    walk = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + size(t)).alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(s["spans"], F.array(F.concat_ws("-", (s["at"] + F.length(head(t["role"]))).cast("string"), (s["at"] + size(t)).cast("string")))),
            ).otherwise(s["spans"]).alias("spans"),
        ),
    )
    return F.array_join(walk["spans"], ",")


def paired(turns: DataFrame, by_length: bool) -> DataFrame:
    """A row per pair from rows (pair_id, side 0 or 1, conv_id, turn, role, text).

    Side 0 is chosen, or ``by_length`` the one with more characters of assistant text, of equal
    ones side 0.
    """
    said = F.struct(F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = turns.select("pair_id", "side", "conv_id", "turn", said.alias("said")).repartition("pair_id")
    # grouped by ever fewer of the columns that the rows are sorted by: no further exchange
    one = dealt.groupBy("pair_id", "turn", "side").agg(F.min("said").alias("said"), F.max("conv_id").alias("conv_id"))
    of = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    both = one.groupBy("pair_id", "turn").agg(of(0, "said").alias("a"), of(1, "said").alias("b"), of(0, "conv_id").alias("a_id"), of(1, "conv_id").alias("b_id"))
    size = lambda c: F.sum(F.when(F.col(f"{c}.role") == "assistant", F.length(f"{c}.text")).otherwise(0))
    rows = both.groupBy("pair_id").agg(
        F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("turn"))).alias("first"), F.array_sort(F.collect_list(F.struct("turn", "a", "b"))).alias("parts"),
        F.max("a_id").alias("a_id"), F.max("b_id").alias("b_id"), size("a").alias("a_size"), size("b").alias("b_size"),
    )
    return rows.withColumn("swap", F.col("a_id").isNull() | (F.col("b_id").isNotNull() & (F.col("b_size") > F.col("a_size"))) if by_length else F.lit(False))


def rendered_pairs(rows: DataFrame) -> DataFrame:
    """pair_id, ids, prompt_turns, prompt, and text and loss spans of both completions, from rows of ``paired``."""
    before = lambda t: F.col("first").isNull() | (t["turn"] < F.col("first"))
    prompt = F.transform(F.filter("parts", before), lambda t: F.coalesce(t["a"], t["b"]))
    rest = F.filter("parts", lambda t: ~before(t))
    side = lambda first: F.filter(F.transform(rest, lambda t: F.when(F.col("swap") == F.lit(first), t["b"]).otherwise(t["a"])), lambda t: t.isNotNull())
    chosen, rejected = side(True), side(False)
    swapped = lambda x, y: F.when(F.col("swap"), F.col(y)).otherwise(F.col(x))
    return rows.select(
        "pair_id", swapped("a_id", "b_id").alias("chosen_id"), swapped("b_id", "a_id").alias("rejected_id"), F.size(prompt).alias("prompt_turns"), rendered(prompt).alias("prompt"),
        rendered(chosen).alias("chosen"), loss_spans(chosen).alias("chosen_loss"),
        rendered(rejected).alias("rejected"), loss_spans(rejected).alias("rejected_loss"),
    )


def turns_of(conversations: DataFrame) -> DataFrame:
    rows = conversations.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    return rows.select("conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string"))


def format_preferences(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row per pair of ``pairs`` (pair_id, chosen_id, rejected_id); a conversation may be in several."""
    side = lambda k, c: F.struct(F.lit(k).alias("side"), F.col(c).alias("conv_id"))
    sides = pairs.select("pair_id", F.explode(F.array(side(0, "chosen_id"), side(1, "rejected_id"))).alias("s")).select("pair_id", "s.*")
    out = rendered_pairs(paired(sides.join(turns_of(conversations), "conv_id"), False)).drop("chosen_id", "rejected_id")
    texts = ["prompt", "chosen", "chosen_loss", "rejected", "rejected_loss"]
    return pairs.select("pair_id", "chosen_id", "rejected_id").join(out, "pair_id", "left").select(
        "pair_id", "chosen_id", "rejected_id", F.coalesce("prompt_turns", F.lit(0)).alias("prompt_turns"), *(F.coalesce(c, F.lit("")).alias(c) for c in texts)
    )


def neighbour_preferences(conversations: DataFrame) -> DataFrame:
    """Conversations 2k and 2k + 1 as pair k, for integer ids of any size and sign; the one with more assistant text is chosen."""
    c = turns_of(conversations)
    return rendered_pairs(paired(c.select(F.shiftright("conv_id", 1).alias("pair_id"), F.col("conv_id").bitwiseAND(F.lit(1)).alias("side"), "*"), True))


def op9_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_preferences(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, t.role AS role, t.text AS text FROM (
    SELECT conv_id, turn, min(struct_pack(role := coalesce(role, 'unknown'), text := coalesce(text, ''))) AS t
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL)),
sizes AS (SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS size FROM turns GROUP BY conv_id),
pairs AS (
  SELECT (conv_id - (conv_id & 1)) // 2 AS pair_id, first(conv_id ORDER BY size DESC, conv_id) AS chosen_id,
         CASE WHEN count(*) = 2 THEN last(conv_id ORDER BY size DESC, conv_id) END AS rejected_id
  FROM sizes GROUP BY 1),
cut AS (
  SELECT p.pair_id, min(coalesce(c.turn, r.turn)) AS first
  FROM (SELECT pair_id, t.* FROM pairs JOIN turns t ON t.conv_id = chosen_id) c
  FULL JOIN (SELECT pair_id, t.* FROM pairs JOIN turns t ON t.conv_id = rejected_id) r
    ON c.pair_id = r.pair_id AND c.turn = r.turn
  JOIN pairs p ON p.pair_id = coalesce(c.pair_id, r.pair_id)
  WHERE c.turn IS NULL OR r.turn IS NULL OR c.role <> r.role OR c.text <> r.text
  GROUP BY 1),
parts AS (
  SELECT p.pair_id, s.side, t.turn, t.role, cut.first IS NULL OR t.turn < cut.first AS common,
         '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) AS out, length(t.role) + 5 AS skip
  FROM pairs p LEFT JOIN cut USING (pair_id) CROSS JOIN (VALUES (1), (2)) s(side)
  JOIN turns t ON t.conv_id = CASE side WHEN 1 THEN chosen_id ELSE rejected_id END),
placed AS (
  SELECT *, coalesce(sum(length(out)) OVER (PARTITION BY pair_id, side, common ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM parts),
text AS (
  SELECT pair_id,
    count(*) FILTER (side = 1 AND common) AS prompt_turns,
    coalesce(string_agg(out, '' ORDER BY turn) FILTER (side = 1 AND common), '') AS prompt,
    coalesce(string_agg(out, '' ORDER BY turn) FILTER (side = 1 AND NOT common), '') AS chosen,
    coalesce(string_agg(CAST(off + skip AS BIGINT) || '-' || CAST(off + length(out) AS BIGINT), ',' ORDER BY turn) FILTER (side = 1 AND NOT common AND role = 'assistant'), '') AS chosen_loss,
    coalesce(string_agg(out, '' ORDER BY turn) FILTER (side = 2 AND NOT common), '') AS rejected,
    coalesce(string_agg(CAST(off + skip AS BIGINT) || '-' || CAST(off + length(out) AS BIGINT), ',' ORDER BY turn) FILTER (side = 2 AND NOT common AND role = 'assistant'), '') AS rejected_loss
  FROM placed GROUP BY pair_id)
SELECT pair_id, chosen_id, rejected_id, CAST(prompt_turns AS INTEGER) AS prompt_turns, prompt, chosen, chosen_loss, rejected, rejected_loss
FROM pairs JOIN text USING (pair_id)
"""
