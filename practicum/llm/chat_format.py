"""Chat formatting by prefix-target expansion (DataFrame functions only).

Every assistant turn becomes an example of its own: all preceding turns as context, only that
reply trainable. What follows the last assistant turn (or a conversation without any) becomes one
more example with an empty target, so no turn is lost. A turn is written
``<s>role[INST]text[/INST]``, an example ends with ``</s>``; backslashes in texts are doubled and a
control string gets a backslash after its first character, which ``unescape`` takes back exactly.

An example is held as (context turns, target turn): its text is built from slices of the turn
array, whose size is one conversation. Conversations are sequences by nature, so one conversation
is the largest unit that a task holds; many rows of one conversation meet only there.

Defined results: null or empty role and text count as empty; a null turn sorts first, equal turns by role
and text; rows repeated are turns repeated; every row without conv_id is a conversation by itself (equal ones
are one of repeated turns), so they never gather in one task; a text of any length is written whole; an empty table
gives no examples; columns other than the four are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The control strings of the template.
TURN, TEXT, TEXT_END, EXAMPLE_END = "<s>", "[INST]", "[/INST]", "</s>"
PROBE = "</s>[INST] ok [/INST]"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), r"([<\[])(/?(?:s>|INST\]))", r"$1\\$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"([<\[])\\(/?(?:s>|INST\]))", r"$1$2"), r"\\\\", r"\\")


def format_conversations(rows: DataFrame, *, target_role: str = "assistant") -> DataFrame:
    """Examples: conv_id, alone (tells rows without conv_id apart), example (0, 1, ...), trainable, context, target, n_context.

    ``context || target || '</s>'`` is the formatted example; the loss mask covers the text of the
    target turn alone, ``loss_start`` and ``loss_end`` in code points of the formatted example.
    """
    blank = F.lit("")
    turns = rows.select(
        "conv_id", F.col("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
        F.when(F.col("conv_id").isNull(), F.sha2(F.concat_ws("\n", F.col("turn").cast("string"), "role", "text"), 256)).alias("alone"),
    )
    convs = turns.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    written = F.transform("t", lambda x: F.concat(F.lit(TURN), escape(x["role"]), F.lit(TEXT), escape(x["text"]), F.lit(TEXT_END)))
    at = F.filter(F.transform("t", lambda x, i: F.when(x["role"] == target_role, i)), lambda i: i.isNotNull())
    packed = convs.select("conv_id", "alone", F.inline_outer(F.array(F.struct(written.alias("w"), at.alias("at"), F.size("t").alias("n")))))
    last = F.coalesce(F.get("at", F.size("at") - 1), F.lit(-1))
    ends = F.when(last < F.col("n") - 1, F.concat("at", F.array(F.col("n")))).otherwise(F.col("at"))
    each = packed.select("conv_id", "alone", "w", "n", F.posexplode(ends).alias("example", "end"))
    context = F.array_join(F.slice("w", 1, F.col("end")), "")
    target = F.coalesce(F.get("w", F.col("end")), blank)
    made = each.select("conv_id", "alone", "example", (F.col("end") < F.col("n")).alias("trainable"), context.alias("context"), target.alias("target"), F.least("end", "n").alias("n_context"))
    mark = F.instr("target", TEXT) + len(TEXT) - 1
    start = F.char_length("context") + mark
    return made.withColumns({
        "loss_start": F.when(F.col("trainable"), start).otherwise(0),
        "loss_end": F.when(F.col("trainable"), F.char_length("context") + F.char_length("target") - len(TEXT_END)).otherwise(0),
        "formatted": F.concat("context", "target", F.lit(EXAMPLE_END)),
    })


def read_back(examples: DataFrame) -> DataFrame:
    """The digest of each conversation, from formatted texts and loss spans alone."""
    masked = F.when(F.col("trainable"), unescape(F.expr("substring(formatted, loss_start + 1, loss_end - loss_start)"))).otherwise("")
    pieces = F.filter(F.split(F.regexp_replace("formatted", r"</s>\z", ""), F.lit(r"<s>")), lambda p: p != "")
    parsed = F.transform(
        pieces,
        lambda p: F.concat(unescape(F.substring_index(p, TEXT, 1)), F.lit("\n"), unescape(F.regexp_extract(p, r"(?s)\[INST\](.*)\[/INST\]\z", 1)), F.lit("\n")),
    )
    each = examples.select("conv_id", "alone", "example", masked.alias("m"), "formatted", F.char_length("formatted").alias("chars"))
    whole = each.groupBy("conv_id", "alone").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "m"))), lambda x: x["m"]), "").alias("loss"),
        F.max_by("formatted", "example").alias("formatted"),
        F.sum("chars").alias("formatted_chars"),
    )
    digest = whole.select("conv_id", "loss", "formatted_chars", F.inline(F.array(F.struct(parsed.alias("p")))))
    return digest.select(
        "conv_id",
        F.size("p").cast("long").alias("n_turns"),
        F.sha2(F.array_join("p", ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(rows.unionByName(probe)))


ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), n AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    length(replace(role, '\', '\\')) + length(replace(text, '\', '\\'))
    + len(regexp_extract_all(role, '[<\[]/?(?:s>|INST\])')) + len(regexp_extract_all(text, '[<\[]/?(?:s>|INST\])')) + 16 AS chars
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), s AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto,
    max(CASE WHEN role = 'assistant' THEN k ELSE 0 END) OVER (PARTITION BY conv_id) AS last_reply FROM n
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR (k = n AND last_reply < n) THEN upto + 4 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
