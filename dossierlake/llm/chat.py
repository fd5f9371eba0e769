"""Chat formatting by a grammar round trip, in DataFrame functions alone.

A conversation is written as a chain of turns::

    user        [INST]body[/INST]
    assistant   <s>body</s>
    any other   [ROLE]body of the role[TEXT]body[/ROLE]

A body is the text itself, or a backslash followed by the escaped text. Every turn is first written with its
plain text, read back by the parser and compared with its source. Where that differs, the conflicting turn is
written again at the next level of escaping: control strings only, then every character that could begin one.
A control string inside a body is a conflict too, as the grammar has none there.
A turn that its parser reads back whole begins with its opening mark and ends at the first closing mark, so a
chain of such turns is read back turn by turn; ``format_conversations`` still reads every whole conversation
back and fails if a turn differs.

Escapes are ``\\0`` for a backslash, ``\\1`` for ``[`` and ``\\2`` for ``<``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The first character of each control string, with what must follow.
SQUARE, ANGLE = r"\[(?=(?:/?INST|/?ROLE|TEXT)\])", r"<(?=/?s>)"
TURN = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>|\[ROLE\].*?\[TEXT\].*?\[/ROLE\]"
CONTROL = r"\[(?:/?INST|/?ROLE|TEXT)\]|</?s>"
ROLE_END, TEXT_END = "[TEXT]", "[/ROLE]"
ESCAPE = "\\"


def _escape(text: Column, level: int) -> Column:
    if level == 0:
        return text
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    if level == 1:
        out = F.regexp_replace(F.regexp_replace(out, SQUARE, r"\\1"), ANGLE, r"\\2")
    else:
        out = F.replace(F.replace(out, F.lit("["), F.lit(ESCAPE + "1")), F.lit("<"), F.lit(ESCAPE + "2"))
    return F.concat(F.lit(ESCAPE), out)


def unescape(body: Column) -> Column:
    """The text that a body stands for."""
    out = F.substring(body, 2, 2147483647)
    for code, plain in (("1", "["), ("2", "<"), ("0", ESCAPE)):
        out = F.replace(out, F.lit(ESCAPE + code), F.lit(plain))
    return F.when(body.startswith(ESCAPE), out).otherwise(body)


def _segments(role: Column, text: Column, level: int) -> tuple[Column, Column, Column]:
    """Opening mark, body and closing mark of a turn."""
    user, assistant = role == "user", role == "assistant"
    opening = F.when(user, "[INST]").when(assistant, "<s>").otherwise(F.concat(F.lit("[ROLE]"), _escape(role, level), F.lit(ROLE_END)))
    return opening, _escape(text, level), F.when(user, "[/INST]").when(assistant, "</s>").otherwise(TEXT_END)


def _read_turn(turn: Column) -> Column:
    """Role and text of one turn, as the grammar has it."""

    def body(opening: int, closing: int) -> Column:
        return unescape(F.substring(turn, F.lit(opening + 1), F.char_length(turn) - (opening + closing)))

    inner = F.substring(turn, F.lit(7), F.char_length(turn) - 13)
    at = F.locate(ROLE_END, inner)
    named = F.struct(unescape(F.substring(inner, F.lit(1), at - 1)).alias("role"), unescape(F.substring(inner, at + len(ROLE_END), F.lit(2147483647))).alias("text"))
    return (
        F.when(turn.startswith("[INST]"), F.struct(F.lit("user").alias("role"), body(6, 7).alias("text")))
        .when(turn.startswith("<s>"), F.struct(F.lit("assistant").alias("role"), body(3, 4).alias("text")))
        .otherwise(named)
    )


def parse_conversation(formatted: Column) -> Column:
    """The turns, an array of (role, text), of a formatted conversation; null where it isn't one.

    The grammar has no control string inside a body, and nothing between turns.
    """
    turns = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))
    length = F.aggregate(turns, F.lit(0), lambda n, x: n + F.char_length(x))
    marks = F.aggregate(turns, F.lit(0), lambda n, x: n + F.when(x.startswith("[ROLE]"), 3).otherwise(2))
    whole = (length == F.char_length(formatted)) & (marks == F.regexp_count(formatted, F.lit(CONTROL)))
    return F.when(whole, F.transform(turns, _read_turn))


def format_conversations(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv``, n_turns, formatted, segments, turns, n_escaped.

    ``segments`` is an array of (text, loss) whose texts joined are ``formatted``; loss marks the bodies of
    assistant turns. ``turns`` is what the parser reads back from ``formatted``.

    Nulls: a null text or role counts as empty, a null turn number comes first, rows without a conversation
    id make up one conversation whose id is null. Ties on the turn number go by role and then text, in binary
    order; repeated rows are turns of their own. An empty table gives an empty table. Columns besides the four
    are ignored, whatever their names. A conversation is one value and so lies in one task, however long.
    """
    said = turns.select(F.col(conv).alias("conv"), F.col(order).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    written = None
    levels = []
    for level in (0, 1, 2):
        opening, body, closing = _segments(F.col("role"), F.col("text"), level)
        levels.append(F.struct(opening.alias("opening"), body.alias("body"), closing.alias("closing"), F.lit(level).alias("level")))
    for level, one in reversed(list(enumerate(levels))):
        whole = F.concat(one["opening"], one["body"], one["closing"])
        back = parse_conversation(whole)
        same = (F.size(back) == 1) & (back[0]["role"] == F.col("role")) & (back[0]["text"] == F.col("text"))
        written = one if written is None else F.when(F.coalesce(same, F.lit(False)), one).otherwise(written)
    said = said.withColumn("w", written)
    grouped = said.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "w"))).alias("t"))
    segments = F.flatten(F.transform("t", lambda x: F.array(
        F.struct(x["w"]["opening"].alias("text"), F.lit(False).alias("loss")),
        F.struct(x["w"]["body"].alias("text"), (x["role"] == "assistant").alias("loss")),
        F.struct(x["w"]["closing"].alias("text"), F.lit(False).alias("loss")),
    )))
    out = grouped.select("conv", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"), F.size(F.filter("t", lambda x: x["w"]["level"] > 0)).cast("long").alias("n_escaped"), segments.alias("segments"))
    out = out.withColumn("formatted", F.array_join(F.transform("segments", lambda x: x["text"]), ""))
    out = out.withColumn("turns", parse_conversation(F.col("formatted")))
    checked = F.when(F.coalesce(F.col("turns") == F.col("source"), F.lit(False)), F.col("turns")).otherwise(F.raise_error(F.lit("a formatted conversation isn't read back as it was")).cast(out.schema["turns"].dataType))
    return out.select(F.col("conv").alias(conv), F.size("source").cast("long").alias("n_turns"), "formatted", "segments", checked.alias("turns"), "n_escaped")


def digest(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Figures read back from the formatted text and its loss mask."""
    said = F.concat(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""))
    loss = F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: unescape(x["text"])), "")
    return formatted.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op1_chat(spark, sf_dir: str) -> DataFrame:
    """All of ``conversations`` and conversation -7, which says control strings."""
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    strange = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{strange}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return digest(format_conversations(told.unionByName(more)))


_OWN = "'</s>[INST] ok [/INST]'"
OP1_SQL = f"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_OWN} UNION ALL SELECT -7, 1, 'assistant', {_OWN}),
marked AS (
  SELECT *, regexp_matches(text, '\\[(/?INST|/?ROLE|TEXT)\\]|</?s>') OR text[1] = '\\' AS strange FROM told),
lengths AS (
  SELECT *, length(text) + CASE WHEN strange THEN 1 + length(text) - length(replace(text, '\\', ''))
      + len(regexp_extract_all(text, '\\[(/?INST|/?ROLE|TEXT)\\]|</?s>')) ELSE 0 END AS body,
    CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length(role) END AS marks FROM marked)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(body + marks)::BIGINT AS formatted_chars
FROM lengths GROUP BY conv_id"""
