"""Chat formatting with typed content parts; DataFrame functions only.

A visitor over each turn's parts (text, image, audio, document) flattens them into one text: text is escaped, any other
part leaves an ordered placeholder, its reference and its expanded token count in the list of attachments.

A turn is `<|turn|>role<|says|>text<|end|>`. Inside roles and texts each backslash is doubled and every control string is
broken by a backslash after its first character, so no control string of the template or of the listed other ones can
come from a text. A backslash that stands alone was put in; taking it out restores the text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.common import table

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: What follows < or [ in a control string.
CONTROL = r"([<\[])(\||/?s>|/?INST\]|</?SYS>)"
#: Tokens that a part stands for: pixels a side of an image patch, audio frames a second, tokens a page.
PATCH, FRAMES, PAGE = 28, 25, 1024

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, "$1\\\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def text_part(text: Column) -> Column:
    """One text part of a plain text column."""
    empty = {c: F.lit(None) for c in ("ref", "width", "height", "seconds", "pages")}
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[v.alias(k) for k, v in empty.items()])).cast(PARTS)


def _tokens(part: Column) -> Column:
    side = lambda c: F.ceil(F.greatest(F.coalesce(part[c], F.lit(PATCH)), F.lit(1)) / PATCH)
    return (
        F.when(part["type"] == "image", side("width") * side("height"))
        .when(part["type"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * FRAMES))
        .when(part["type"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * PAGE)
        .otherwise(F.lit(0))
        .cast("long")
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start and length in code points), attachments, n_turns.

    turns: conv_id, turn, role, parts (PARTS). Null roles, parts and texts are empty; parts of unknown type are taken as
    text. Rows go by turn (nulls first), then role and text; repeated rows are turns of their own. A null conv_id is a
    conversation. Loss covers the text of each assistant turn, without the markers. Other columns are left out.

    Each conversation becomes one row, as its text is one string; places of spans come from one window sum over the
    same partitioning, so there is one shuffle.
    """
    kinds = ("image", "audio", "document")
    parts = F.coalesce(F.filter("parts", lambda p: p.isNotNull()), F.array().cast(PARTS))
    visit = F.transform(parts, lambda p, i: F.struct(i.alias("part"), F.coalesce(F.when(p["type"].isin(*kinds), p["type"]), F.lit("text")).alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens"), escape(F.coalesce(p["text"], F.lit(""))).alias("text")))
    said = F.array_join(F.transform("visited", lambda p: F.when(p["type"] == "text", p["text"]).otherwise(F.concat(F.lit("<|"), p["type"], F.lit(":"), p["part"], F.lit("|>")))), "")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), visit.alias("visited"))
    rows = rows.withColumn("said", said).withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "said")
    rows = rows.withColumn("at", F.row_number().over(order))
    rows = rows.withColumn("until", F.sum(F.length("head") + F.length("said") + len(END)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct(F.col("at"), (F.col("until") - len(END) - F.length("said")).cast("long").alias("start"), F.length("said").cast("long").alias("length"))
    held = F.transform(F.filter("visited", lambda p: p["type"] != "text"), lambda p: F.struct(F.col("at").alias("turn"), p["part"].alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
    chats = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("at", F.concat("head", "said", F.lit(END)).alias("text")))).alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("spans"),
        F.flatten(F.array_sort(F.collect_list(held))).alias("attachments"),
        F.count("*").alias("n_turns"),
    )
    return chats.select("conv_id", F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"), F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"), "attachments", "n_turns")


def read_back(chats: DataFrame) -> DataFrame:
    """Adds turns (role and text as they were, placeholders left in) and loss_text, both read from `formatted` alone."""
    pieces = F.split(F.col("formatted"), r"<\|end\|>")
    turns = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda t: F.split(F.substring(t, len(TURN) + 1, 1 << 30), r"<\|says\|>"))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.withColumn("turns", F.transform(turns, lambda t: F.struct(unescape(t[0]).alias("role"), unescape(t[1]).alias("text")))).withColumn("loss_text", F.array_join(loss, ""))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    chats = read_back(format_chats(turns.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|</?SYS>)', '\1\\\2', 'g') AS t,
    regexp_replace(replace(role, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|</?SYS>)', '\1\\\2', 'g') AS r FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(r) + length(t) + 23)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
