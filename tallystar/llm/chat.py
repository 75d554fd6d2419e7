"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is under the loss.
A conversation that does not end with an assistant turn gives one more example that holds it whole, with an empty
loss span, so no turn is missing from the output.

The template writes a turn as ``<turn:ROLE>TEXT</turn>`` and a line feed. Inside roles and texts a backslash becomes ``\\e``,
``<`` becomes ``\\l`` and ``>`` becomes ``\\g``, so no text can hold a mark of the template, and ``plain`` gives the text
back. An example carries its whole context, so a conversation of n turns costs the order of n² characters.

Defined cases: turns are ordered by number, then role, then text, nulls first, so ties and repeated rows keep a fixed
place and all of them stay; a null text is empty; a null role is written ``\\n`` and is no assistant; rows with a null
conversation id form one conversation. An empty table gives no example. Further columns are not part of the result.
A conversation is one row of the work, as each of its examples is; conversations are spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystar.llm.shared import positional

END = "</turn>\n"
_ESCAPES = (("\\", "\\e"), ("<", "\\l"), (">", "\\g"))


def escaped(text: Column) -> Column:
    for mark, code in _ESCAPES:
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def plain(text: Column) -> Column:
    for mark, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(mark))
    return text


def _opening(role: Column) -> Column:
    return F.concat(F.lit("<turn:"), F.coalesce(escaped(role), F.lit("\\n")), F.lit(">"))


def format_examples(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text", target: str = "assistant") -> DataFrame:
    """Rows (conv_id, turns, formatted, loss_start, loss_end, whole); the span counts code points from 0.

    ``turns`` is the number of turns in the example; ``whole`` marks the example that holds all turns.
    """
    frame, names = positional(conversations, conv_id, turn, role, text)
    said = frame.groupBy(F.col(names[conv_id]).alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct(
        F.col(names[turn]).alias("turn"), F.col(names[role]).alias("role"),
        F.coalesce(names[text], F.lit("")).alias("text")))).alias("said"))
    count = F.size("said")
    replies = F.filter(F.sequence(F.lit(1), count), lambda at: F.coalesce(
        F.element_at("said", at)["role"] == target, F.lit(False)) | (at == count))
    written = said.select("conv_id", count.alias("count"), F.transform("said", lambda t: F.struct(
        F.concat(_opening(t["role"]), escaped(t["text"]), F.lit(END)).alias("whole"),
        F.length(_opening(t["role"])).alias("opening"),
        F.coalesce(t["role"] == target, F.lit(False)).alias("is_target"))).alias("marked"), replies.alias("replies"))
    spread = written.select("conv_id", "count", "marked", F.explode("replies").alias("turns"))
    last = F.element_at("marked", F.col("turns"))
    built = spread.select(
        "conv_id", F.col("turns").cast("long").alias("turns"), (F.col("turns") == F.col("count")).alias("whole"),
        last["opening"].alias("opening"), F.length(last["whole"]).alias("length"), last["is_target"].alias("is_target"),
        F.array_join(F.transform(F.slice("marked", 1, F.col("turns")), lambda m: m["whole"]), "").alias("formatted"))
    start = F.length("formatted") - F.col("length") + F.col("opening")
    end = F.length("formatted") - F.lit(len(END))
    return built.select("conv_id", "turns", "formatted",
                        F.when(F.col("is_target"), start).otherwise(end).cast("long").alias("loss_start"),
                        end.cast("long").alias("loss_end"), "whole")


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss, unescaped."""
    return plain(F.substring(formatted, (start + 1).cast("int"), (end - start).cast("int")))


def read_turns(formatted: Column) -> Column:
    """The turns of an example as an array of (role, text), read back from its text."""
    parts = F.split(formatted, "</turn>\n")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        code = F.substring_index(F.substring(part, 7, 1 << 30), ">", 1)
        role = F.when(code != "\\n", plain(code))
        return F.struct(role.alias("role"), plain(F.substring(part, F.length(code) + 8, F.lit(1 << 30))).alias("text"))
    return F.transform(parts, turn)
