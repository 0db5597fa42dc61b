"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its
context, and only that reply is trainable. Turns that follow the last assistant
turn (or all, where there is none) end in one example without a target, so that
the examples of a conversation hold it whole.

The template marks turns as ``<|role|>text</s>``. Inside texts and roles
every control string is broken by a backslash after its first character, and
backslashes are doubled; ``unescape`` takes that back exactly.

DataFrame functions only. Turns are gathered per conversation (one digest or
one transcript needs them in one row); contexts are prefixes of one array of
formatted turns. Null text or role: empty. Turns are ordered by turn (nulls
first), then role, then text; repeated rows are turns of their own. A null
conversation id is a conversation. An empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import read

#: Strings that steer models or mark turns; none is left whole inside a text.
CONTROL = (r"</?s>", r"\[/?INST\]", r"<</?SYS>>", r"<\|[^|<>]*\|>")
OPEN, CLOSE, END = "<|", "|>", "</s>"
#: A turn in formatted text: its mark, and the text before the end mark.
TURN = r"(?s)<\|(.*?)\|>(.*?)</s>"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    inside = "|".join(x[1:] if x[0] != "\\" else x[2:] for x in CONTROL)
    return F.regexp_replace(doubled, rf"([<\[])(?=(?:{inside}|\|))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv_id and its formatted turns in order: ``role``, ``mark`` and ``body``."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    formatted = F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"),
        F.concat(F.lit(OPEN), role_escape(t["role"]), F.lit(CLOSE)).alias("mark"),
        F.concat(escape(t["text"]), F.lit(END)).alias("body"),
    ))
    return gathered.select("conv_id", formatted.alias("turns"))


def role_escape(role: Column) -> Column:
    """As texts, and ``|>`` is broken too: a role ends at the first one."""
    return F.replace(escape(role), F.lit(CLOSE), F.lit("|\\>"))


def prefix_targets(turns: DataFrame, trainable: str = "assistant") -> DataFrame:
    """One row for each example: conv_id, example (from 0), context, target, and
    the span of ``text = context + target`` that is trained on (code points,
    end exclusive; the end mark belongs to the target)."""
    c = conversations_of(turns)
    spots = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == trainable, i + 1)), lambda i: i.isNotNull())
    c = c.withColumn("spots", spots)
    c = c.withColumn("spots", F.when(F.array_contains("spots", F.size("turns")), F.col("spots")).otherwise(F.concat("spots", F.array(F.size("turns") + F.lit(1)))))
    e = c.select("conv_id", "turns", F.posexplode("spots").alias("example", "spot"))
    before = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("spot") - 1), lambda t: F.concat(t["mark"], t["body"])), "")
    own = F.get("turns", F.col("spot") - 1)
    e = e.select(
        "conv_id", "example",
        F.concat(before, F.coalesce(own["mark"], F.lit(""))).alias("context"),
        F.coalesce(own["body"], F.lit("")).alias("target"),
    )
    return e.select("*", F.concat("context", "target").alias("text"), F.char_length("context").alias("loss_start"), (F.char_length("context") + F.char_length("target")).alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples say, taken from their text and mask alone: per
    conversation its turns (role, text) in order and the trained texts."""
    last = F.max_by("text", "example").alias("whole")
    trained = F.expr("substring(text, loss_start + 1, loss_end - loss_start)")
    said = F.when(F.col("loss_end") > F.col("loss_start"), unescape(F.left(trained, F.char_length(trained) - len(END))))
    per = examples.select("conv_id", "example", "text", said.alias("said")).groupBy("conv_id").agg(
        last,
        F.transform(F.sort_array(F.collect_list(F.struct("example", "said"))), lambda x: x["said"]).alias("said"),
        F.sum(F.char_length("text")).alias("formatted_chars"),
    )
    roles, texts = F.regexp_extract_all("whole", F.lit(TURN), F.lit(1)), F.regexp_extract_all("whole", F.lit(TURN), F.lit(2))
    back = F.transform(F.arrays_zip(roles.alias("role"), texts.alias("text")), lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))
    return per.select("conv_id", back.alias("turns"), F.filter("said", lambda s: s.isNotNull()).alias("trained"), "formatted_chars")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(
        "SELECT -7L AS conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    back = read_back(prefix_targets(both.unionByName(extra)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("trained", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
-- a backslash more for every backslash and every control string; of roles for |> as well
size AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         8 + length(role) + length(text) + length(role || text) - length(replace(role || text, '\', ''))
         + len(regexp_extract_all(text, '[<\[](/?s>|/?INST\]|</?SYS>>|\|)')) + len(regexp_extract_all(role, '[<\[](/?s>|/?INST\]|</?SYS>>|\|)'))
         + (length(role) - length(replace(role, '|>', ''))) // 2 AS n
  FROM rows),
so_far AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i) AS upto, count(*) OVER (PARTITION BY conv_id) AS turns FROM size),
per AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS said,
         coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(upto) FILTER (WHERE role = 'assistant' OR i = turns) AS formatted
  FROM so_far GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted::BIGINT AS formatted_chars
FROM per
"""
