"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable. The text
of an example is a prefix of the conversation's text, so a conversation is rendered once and its examples are cut from it
while rows are made; no row holds more than one example. A conversation that doesn't end with an assistant turn gets one more
example, with nothing trainable, so that the output has every turn.

A turn is ``<s>role\\ntext</s>``. Inside roles and texts ``&`` is written ``&amp;``, the control strings ``<s>`` and ``</s>``
begin with ``&lt;``, and a line end in a role is ``&nl;``; ``unescape`` restores them.

Where turns end in the conversation's text is a running sum over its turns, which Spark sorts and spills. One row then holds a
conversation's text, as the largest of its examples does by definition.

Defined results: a null text or role is empty; turns are ordered by number, then role, then text, nulls first; repeated turns
count each; texts of any length are kept whole; a row with a null conversation id belongs to no other row, so it is a
conversation of its own; an empty table gives no examples; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit(OPEN), F.lit("&lt;s>")), F.lit(CLOSE), F.lit("&lt;/s>"))
    return F.replace(out, F.lit("\n"), F.lit("&nl;")) if role else out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&nl;"), F.lit("\n")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trainable: str = "assistant") -> DataFrame:
    """One row per example: conv_id, example (from 0), n_turns, formatted, loss_start, loss_end (characters; the mask is 1 between them) and complete (it has all turns)."""
    role, text = F.coalesce(F.col(f"`{role_col}`"), F.lit("")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    given = df.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text"))
    part = F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit("\n"), escape(F.col("text")), F.lit(CLOSE))
    upto = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    # An end grows with every turn, so it gives the order.
    turn = lambda stop: F.struct(stop.cast("int").alias("stop"), part.alias("part"), F.char_length(escape(F.col("text"))).alias("size"), (F.col("role") == trainable).alias("loss"))
    ended = given.filter(F.col("conv_id").isNotNull()).withColumn("stop", F.sum(F.char_length(part)).over(upto))
    listed = ended.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn(F.col("stop")))).alias("turns"))
    # As a literal, the missing id lets the optimizer drop this side where only ids are asked for.
    none = F.lit(None).cast(given.schema["conv_id"].dataType).alias("conv_id")
    whole = listed.unionByName(given.filter(F.col("conv_id").isNull()).select(none, F.array(turn(F.char_length(part))).alias("turns")))
    texts = whole.select("conv_id", F.array_join(F.transform("turns", lambda t: t["part"]), "").alias("full"), F.transform("turns", lambda t: t.dropFields("part")).alias("turns"))
    n = F.size("turns")
    marked = F.transform("turns", lambda t, i: F.struct((i + 1).alias("n_turns"), t["stop"].alias("stop"), t["size"].alias("size"), t["loss"].alias("loss"), (i + 1 == n).alias("complete")))
    rows = texts.select("conv_id", "full", F.posexplode(F.filter(marked, lambda x: x["loss"] | x["complete"])).alias("example", "x"))
    stop = F.col("x.stop") - len(CLOSE)
    return rows.select(
        "conv_id", "example", F.col("x.n_turns").alias("n_turns"), F.col("full").substr(F.lit(1), F.col("x.stop")).alias("formatted"),
        F.when(F.col("x.loss"), stop - F.col("x.size")).otherwise(stop).alias("loss_start"), stop.alias("loss_end"), F.col("x.complete").alias("complete"),
    )


def targets(examples: DataFrame) -> DataFrame:
    """``examples`` with ``target``: the text under the loss mask, read from the formatted text and unescaped."""
    return examples.withColumn("target", unescape(F.col("formatted").substr(F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: an array of ``role\\ntext``, unescaped."""
    parts = F.split(formatted, CLOSE, -1)
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: unescape(F.substring(p, len(OPEN) + 1, 2_147_483_647)))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: turns and their SHA-256, characters and SHA-256 of all text under the mask, formatted characters."""
    turns = read_turns(F.col("formatted"))
    read = targets(examples).select(
        "conv_id", "example", "target", F.char_length("formatted").alias("size"),
        F.when(F.col("complete"), F.size(turns)).alias("n"),
        F.when(F.col("complete"), F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t, F.lit("\n"))), ""), 256)).alias("sha"),
    )
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "target"))), lambda x: x["target"]), "")
    found = read.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.max("n").cast("long").alias("n_turns"), F.max("sha").alias("turns_sha256"), ordered.alias("loss"), F.sum(F.col("size").cast("long")).alias("formatted_chars"))
    # without an id: one turn, one example
    alone = read.filter(F.col("conv_id").isNull()).select("conv_id", F.col("n").cast("long").alias("n_turns"), F.col("sha").alias("turns_sha256"), F.col("target").alias("loss"), F.col("size").cast("long").alias("formatted_chars"))
    return found.unionByName(alone).select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


#: DuckDB SQL for ``digests(format_conversations(...))`` over all conversations and one of control strings.
ORACLE_SQL = """
WITH given AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, NULL, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, coalesce(role, ''), text) AS rn,
         count(*) OVER (PARTITION BY conv_id, alone) AS n,
         8 + length(replace(replace(replace(replace(coalesce(role, ''), '&', '&amp;'), '<s>', '&lt;s>'), '</s>', '&lt;/s>'), chr(10), '&nl;'))
           + length(replace(replace(replace(text, '&', '&amp;'), '<s>', '&lt;s>'), '</s>', '&lt;/s>')) AS chars
  FROM given
), added AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id, alone ORDER BY rn ROWS UNBOUNDED PRECEDING) AS upto FROM sized
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (WHERE role = 'assistant' OR rn = n) AS BIGINT) AS formatted_chars
FROM added GROUP BY conv_id, alone
"""
