"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, and only that reply is trainable. A conversation of n turns therefore
gives text in proportion to n squared, which is what the method asks for; an
example is written at a time, never all of a conversation's at once.

The template is, per turn, `<|im_start|>ROLE\\nTEXT<|im_end|>\\n`. Inside roles
and texts a backslash is put behind the `<` of anything that looks like a control
string (`<`, any backslashes, `|`), which `unescaped` takes out again, so only
the template itself can open or close a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escaped_role(role: Column) -> Column:
    """A role on one line, so that the first line break of a turn ends it."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescaped_role(role: Column) -> Column:
    halves = F.split(unescaped(role), r"\\\\")
    breaks = F.transform(halves, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(breaks, "\\")


def chat_examples(turns: DataFrame) -> DataFrame:
    """Format (conv_id, turn, role, text) rows as training examples.

    One row per assistant turn: conv_id, example (from 1, in the order of the
    turns), n_turns in it, text, loss_start and loss_chars (the trainable code
    points of text, counted from 0; the reply alone, without its end mark).
    Turns behind the last assistant turn, or all turns where there is none, make
    one more example without trainable text, so that no turn is lost.

    Nulls: a null text or role is empty, a null conv_id is a conversation of its
    own, a null turn comes first. Turns that tie are ordered by role, then text,
    and repeated rows stay. An empty table gives no examples. Further columns
    are not looked at. A conversation's own turns meet in one row, as each of its
    examples must hold them.
    """
    row = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    talks = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    parts = F.transform(
        "turns",
        lambda t: F.concat(F.lit(START), _escaped_role(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(END + "\n")),
    )
    replies = F.filter(
        F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == "assistant"
    )
    last = F.coalesce(F.get("replies", F.size("replies") - 1), F.lit(0))
    ends = F.when(last < F.size("parts"), F.concat("replies", F.array(F.size("parts")))).otherwise(F.col("replies"))
    each = talks.select(
        "conv_id", parts.alias("parts"), replies.alias("replies"),
        F.transform("turns", lambda t: F.length(escaped(t["text"]))).alias("lengths"),
    ).select("conv_id", "parts", "lengths", "replies", F.posexplode(ends).alias("at", "upto"))
    trains = F.col("at") < F.size("replies")
    text = F.array_join(F.slice("parts", F.lit(1), F.col("upto")), "")
    length = F.element_at("lengths", F.col("upto"))
    return each.select(
        "conv_id", (F.col("at") + 1).cast("long").alias("example"), F.col("upto").cast("long").alias("n_turns"),
        text.alias("text"), trains.alias("trains"), length.alias("length"),
    ).select(
        "conv_id", "example", "n_turns", "text",
        F.when(F.col("trains"), F.length("text") - F.lit(len(END) + 1) - F.col("length")).cast("long").alias("loss_start"),
        F.when(F.col("trains"), F.col("length")).otherwise(0).cast("long").alias("loss_chars"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: turns and trainable text.

    Columns conv_id, turns (array of role, text), loss_text (all trainable text,
    in order, nothing between) and formatted_chars. The turns are parsed out of
    the longest example, the last one.
    """
    loss = unescaped(
        F.when(F.col("loss_chars") > 0, F.substring("text", F.col("loss_start") + 1, F.col("loss_chars"))).otherwise("")
    )
    found = examples.select("conv_id", "example", "text", loss.alias("loss")).groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    pieces = F.slice(F.split("whole", r"<\|im_start\|>"), 2, F.size(F.split("whole", r"<\|im_start\|>")))

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(1), F.length(piece) - F.lit(len(END) + 1))
        cut = F.locate("\n", body)
        return F.struct(
            _unescaped_role(F.substring(body, F.lit(1), cut - 1)).alias("role"),
            unescaped(F.substring(body, cut + 1, F.length(body))).alias("text"),
        )

    return found.select(
        "conv_id", F.transform(pieces, turn).alias("turns"),
        F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss_text"), "formatted_chars",
    )
