"""Chat formatting with Spark expressions only, and reading the format back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulefold.llm.frames import col


@dataclass(frozen=True)
class Template:
    """Markers of a conversation. `escape` is put before each control string inside a text, and before itself.

    A block is `open` + role + `head` + texts of adjacent turns of that role joined by `between` + `close`. All markers
    start with `lead`, so doubling marks for `lead` alone would do for them; `foreign` lists control strings of other
    formats, which are broken up likewise by an escape behind their first character.
    """

    open: str = "<|turn|>"
    head: str = "<|text|>"
    between: str = "<|next|>"
    close: str = "<|end|>"
    lead: str = "<|"
    escape: str = "\\"
    foreign: tuple[str, ...] = ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


DEFAULT = Template()


def escaped(text: Column, t: Template = DEFAULT) -> Column:
    """The text with `escape` doubled, then an escape after the first character of every control string."""
    out = F.replace(text, F.lit(t.escape), F.lit(t.escape * 2))
    for control in (t.lead, *t.foreign):
        out = F.replace(out, F.lit(control), F.lit(control[0] + t.escape + control[1:]))
    return out


def unescaped(text: Column, t: Template = DEFAULT) -> Column:
    """The inverse of `escaped`: single escapes go, doubled ones become one."""
    e = "\\Q" + t.escape + "\\E"
    return F.regexp_replace(text, F.lit(f"{e}({e}?)"), F.lit("$1"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 template: Template = DEFAULT) -> DataFrame:
    """One row per conversation: the conversation's id and `formatted`, its turns in order as one string.

    The turn structs of a conversation are collected, sorted by turn, role and text, merged into a block where neighbours
    have one role, and concatenated; the work is linear in the turns, as a fold over an array would not be. Null texts are empty, a null role is the role "", a null turn comes first, rows with a null
    id are one conversation. Equal rows stay as turns of their own. An empty table gives no rows; other columns are ignored.

    A conversation is one value, so its turns meet in one row; rows are dealt by conversation alone, one shuffle.
    """
    t = template
    turn = F.struct(
        col(turn_col).alias("turn"), F.coalesce(col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    conv_col_ = col(conv_col)
    chats = turns.groupBy(col(conv_col).alias(conv_col)).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    # a block starts where the role differs from the one before; its turns are the slice up to the next start
    role = lambda i: F.get("turns", i - 1)["role"]
    starts = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (role(i) != role(i - 1)))

    def merged(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("turns") + 1)
        texts = F.transform(F.slice("turns", start, end - start), lambda x: escaped(x["text"], t))
        return F.struct(escaped(role(start), t).alias("role"), F.array_join(texts, t.between).alias("texts"))

    blocks = chats.select(conv_col_, "turns", starts.alias("starts")).select(conv_col_, F.transform("starts", merged).alias("blocks"))
    parts = F.transform("blocks", lambda b: F.concat(F.lit(t.open), b["role"], F.lit(t.head), b["texts"], F.lit(t.close)))
    return blocks.select(conv_col_, F.array_join(parts, "").alias("formatted"))


def read_chats(formatted: DataFrame, conv_col: str = "conv_id", formatted_col: str = "formatted", loss_role: str = "assistant",
               template: Template = DEFAULT) -> DataFrame:
    """Read back: conv id, turns (array of role, text) and loss_text, the unescaped text of all turns of `loss_role`.

    Markers cannot occur inside escaped texts, so splitting at them is exact. The loss mask covers the texts of
    `loss_role` and no marker.
    """
    t = template
    blocks = F.filter(F.split(col(formatted_col), F.lit("\\Q" + t.open + "\\E"), -1), lambda _, i: i > 0)

    def turns_of(block: Column) -> Column:
        head = F.substring_index(block, t.head, 1)
        body = F.substring(block, F.length(head) + F.lit(len(t.head) + 1), F.length(block) - F.length(head) - F.lit(len(t.head) + len(t.close)))
        texts = F.split(body, F.lit("\\Q" + t.between + "\\E"), -1)
        return F.transform(texts, lambda x: F.struct(unescaped(head, t).alias("role"), unescaped(x, t).alias("text")))

    turns = F.flatten(F.transform(blocks, turns_of))
    out = formatted.select(col(conv_col), col(formatted_col).alias("formatted"), turns.alias("turns"))
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["role"] == loss_role), lambda x: x["text"]), "")
    return out.select(col(conv_col), "formatted", "turns", loss.alias("loss_text"))
