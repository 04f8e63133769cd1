"""Chat formatting of conversations whose turns consist of typed parts.

A turn is a list of parts: text, image, audio or document. A visitor goes over the parts in order;
text is escaped, and every other part leaves a placeholder in the text and a row in the list of attachments
with its reference and the number of tokens that the placeholder stands for.

A formatted turn is ``<|im_start|>role`` newline ``body<|im_end|>`` newline. In roles and texts a
backslash is doubled and a backslash is put inside everything that could be read as a control string, so
formatted text holds control strings only where the template put them. Reading a backslash and the
character behind it as that character gives the text back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "<|im_start|>"
END = "<|im_end|>"
SPOKEN = "assistant"

PART = "struct<kind:string,text:string,ref:string,units:bigint>"

#: Tokens for a unit of an attachment: an image's tile, a second of audio, a document's page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}

#: Control strings of common templates, and what stands for them inside texts.
CONTROL = {
    "\\": "\\\\",
    "<|": "<\\|",
    "<s>": "<\\s>",
    "</s>": "<\\/s>",
    "<<SYS>>": "<\\<SYS>>",
    "<</SYS>>": "<\\</SYS>>",
    "[INST]": "[\\INST]",
    "[/INST]": "[\\/INST]",
}


def escape(text: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), CONTROL.items(), text)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _visit(part: Column) -> Column:
    kind = part["kind"]
    placeholder = F.concat(F.lit("<|"), F.when(kind.isin(*TOKENS_PER_UNIT), kind).otherwise("other"), F.lit("|>"))
    return F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(placeholder)


def _attachment(part: Column) -> Column:
    per_unit = reduce(lambda c, p: c.when(part["kind"] == p[0], p[1]), TOKENS_PER_UNIT.items(), F).otherwise(0)
    tokens = (F.coalesce(part["units"], F.lit(0)) * per_unit).cast("long")
    return F.struct(part["kind"].alias("kind"), part["ref"].alias("ref"), tokens.alias("tokens"))


def text_parts(text: Column) -> Column:
    """A turn that consists of one text (null: empty)."""
    part = F.struct(
        F.lit("text").alias("kind"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"),
        F.lit(0).cast("long").alias("units"),
    )
    return F.array(part)


def format_chats(turns: DataFrame) -> DataFrame:
    """One row for each conversation of ``turns`` (conv_id, turn, role, parts; others are ignored):

    ``conv_id``, ``n_turns``, ``pieces`` (array of text and loss: the formatted conversation in pieces, where
    loss marks what the assistant says), ``attachments`` (kind, ref, tokens in order) and ``expanded_tokens``.

    Turns stand in order of turn (null first), equal ones in order of role and body. A null role is empty,
    null parts are left out, a part of unknown kind is an attachment of no tokens, and a null kind is one
    too. Rows with a null conv_id form one conversation. A conversation is one row, so it must fit into one.
    An empty table gives no rows.
    """
    parts = F.coalesce(F.filter("parts", lambda p: p.isNotNull()), F.array().cast(f"array<{PART}>"))
    seen = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform(parts, _visit), "").alias("body"),
        F.transform(F.filter(parts, lambda p: ~F.coalesce(p["kind"] == "text", F.lit(False))), _attachment).alias("attached"),
    )
    listed = seen.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "body", "attached"))).alias("turns")
    )

    def pieces(turn: Column) -> Column:
        head = F.concat(F.lit(START), F.replace(escape(turn["role"]), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
        said = [(head, F.lit(False)), (turn["body"], turn["role"] == SPOKEN), (F.lit(f"{END}\n"), F.lit(False))]
        return F.array(*(F.struct(text.alias("text"), loss.alias("loss")) for text, loss in said))

    attachments = F.flatten(F.transform("turns", lambda t: t["attached"]))
    return listed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("turns", pieces)).alias("pieces"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda total, a: total + a["tokens"]).alias("expanded_tokens"),
    )


def formatted(pieces: str = "pieces") -> Column:
    """The formatted conversation as one text."""
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "")


def read_turns(text: Column) -> Column:
    """Turns (role, text) of a formatted conversation; placeholders stay in the text."""

    def turn(block: Column) -> Column:
        role = F.regexp_extract(block, r"^([^\\\n]*+(?:\\[\s\S][^\\\n]*+)*+)\n", 1)
        body = F.substring(block, F.length(role) + 2, F.length(block) - F.length(role) - 2 - len(END))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    blocks = F.split(text, START.replace("|", r"\|"))
    return F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), turn)


def read_loss(pieces: str = "pieces") -> Column:
    """All text under the loss mask, without escapes."""
    said = F.filter(pieces, lambda p: p["loss"])
    return F.array_join(F.transform(said, lambda p: unescape(p["text"])), "")
