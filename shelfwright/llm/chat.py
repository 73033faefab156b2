"""Prefix-target expansion of conversations; native DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.llm.shared import table

#: Control strings of the template. Each starts with ``<|``, which never occurs inside an escaped text.
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Places where a control string of this or another chat template begins.
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    r"""Double each backslash, then put one behind the first character of every control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?s)(.)", "$1")


def expand(turns: DataFrame) -> DataFrame:
    """One example per assistant turn (conv_id, turn_no, n_turns, text, loss_start, loss_length).

    ``text`` is the template of all turns up to and with that reply; only the ``loss_length`` code points from
    ``loss_start`` on (the escaped reply) are trainable. Turns after the last reply are kept by one example with loss_length 0,
    so every turn of every conversation is in the output. A conversation is formatted once; examples are prefixes.

    Rows are ordered by turn (null first), ties by role, then text; repeated rows are turns of their own. Null roles and texts are
    empty; a null conv_id is one conversation. Extra columns are ignored. No rows give no examples. The text of one conversation
    is together in one row, as its examples are.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("body"))
    t = t.withColumn("head", F.concat(F.lit(START), escape(F.col("role")), F.lit(MIDDLE))).withColumn("body", escape(F.col("body")))
    t = t.withColumn("seg", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.select("conv_id", "seg", F.row_number().over(order).alias("turn_no"), F.sum(F.length("seg")).over(upto).cast("long").alias("stop"),
                 F.length("body").cast("long").alias("len"), (F.col("role") == "assistant").alias("reply"))
    # All marks but the reply's own text are outside of the loss.
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn_no", "seg"))).alias("segs"),
                                 F.collect_list(F.struct("turn_no", "stop", "len", "reply")).alias("marks"), F.max("turn_no").alias("last"))
    g = g.select("conv_id", F.array_join(F.transform("segs", lambda s: s["seg"]), "").alias("whole"),
                 F.explode(F.filter("marks", lambda m: m["reply"] | (m["turn_no"] == F.col("last")))).alias("m"))
    length = F.when(F.col("m.reply"), F.col("m.len")).otherwise(F.lit(0).cast("long"))
    return g.select("conv_id", F.col("m.turn_no").cast("long").alias("turn_no"), F.col("m.turn_no").cast("long").alias("n_turns"),
                    F.expr("substring(whole, 1, int(m.stop))").alias("text"),
                    (F.col("m.stop") - len(END) - F.col("m.len")).alias("loss_start"), length.alias("loss_length"))


def turns_of(text: Column) -> Column:
    """The turns of a formatted text, unescaped: array of (role, text)."""
    parts = F.filter(F.split(text, r"<\|im_end\|>", -1), lambda p: p != "")
    bare = F.transform(parts, lambda p: F.split(F.substring(p, len(START) + 1, 2 ** 31 - 1), r"<\|im_sep\|>", -1))
    return F.transform(bare, lambda b: F.struct(unescape(b[0]).alias("role"), unescape(b[1]).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """Digest columns of each conversation, from its formatted examples alone."""
    e = examples.withColumn("loss", unescape(F.expr("substring(text, int(loss_start) + 1, int(loss_length))")))
    e = e.select("conv_id", "turn_no", "loss", F.length("text").cast("long").alias("chars"), "text",
                 F.max("turn_no").over(Window.partitionBy("conv_id")).alias("top"))
    e = e.withColumn("turns", F.when(F.col("turn_no") == F.col("top"), turns_of(F.col("text"))))
    g = e.groupBy("conv_id").agg(F.first("turns", ignorenulls=True).alias("turns"), F.sum("chars").alias("formatted_chars"),
                                 F.array_sort(F.collect_list(F.struct("turn_no", "loss"))).alias("losses"))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return g.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"),
                    F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op1(spark, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7 whose texts hold control strings."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(expand(c.unionByName(extra)))


OP1_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, {len(START) + len(MIDDLE) + len(END)} + length(role) + length(text) + length(text) - length(replace(text, '\', ''))
             + length(role) - length(replace(role, '\', ''))
             + len(regexp_extract_all(text, '<\||</?s>|<</?SYS>>|\[/?INST\]')) + len(regexp_extract_all(role, '<\||</?s>|<</?SYS>>|\[/?INST\]')) AS n FROM t),
p AS (SELECT *, row_number() OVER o AS k, count(*) OVER (PARTITION BY conv_id) AS m, sum(n) OVER (o ROWS UNBOUNDED PRECEDING) AS upto
      FROM e WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (role = 'assistant' OR k = m))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
