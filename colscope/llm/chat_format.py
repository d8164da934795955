"""Chat formatting with typed content parts.

A message is a list of parts (text, image, audio, document). A visitor written as one SQL expression turns the
parts into text with ordered placeholders, records what is attached, and counts the tokens that a model expands
each placeholder to. Turns are then marked by control strings; the same strings inside texts are escaped so that
the reading side gets every text back unchanged.

The control sigil is ``<|``. Inside texts and roles every ``<|`` becomes ``<||``; as control strings never have
``|`` there, no text can form one, and replacing ``<||`` by ``<|`` undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import number, numbered

START, END = "<|start|>", "<|end|>\n"
PART_SCHEMA = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"

#: Tokens of a placeholder: image patches of 14 x 14 pixels, audio frames a second, tokens a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 256


def escape(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def escape_role(role: Column) -> Column:
    """As texts, and line feeds too, since one ends the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n|>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|n|>"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """A plain text as a list of one part."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            text.alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("width"),
            F.lit(None).cast("int").alias("height"),
            F.lit(None).cast("double").alias("seconds"),
            F.lit(None).cast("int").alias("pages"),
        )
    )


def _attached(part: Column) -> Column:
    return part["kind"].isin("image", "audio", "document")


def visit_parts(parts: Column) -> dict[str, Column]:
    """``body``, ``attachments`` (kind, ref, tokens in order) and ``media_tokens`` of a list of parts.

    Parts of an unknown or null kind count as text; null lists and null texts are empty.
    """
    parts = F.coalesce(parts, F.array().cast(PART_SCHEMA))

    def tokens(part: Column) -> Column:
        patches = F.ceil(F.coalesce(part["width"], F.lit(0)) / F.lit(PATCH)) * F.ceil(
            F.coalesce(part["height"], F.lit(0)) / F.lit(PATCH)
        )
        return F.when(part["kind"] == "image", patches).when(
            part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * F.lit(AUDIO_RATE))
        ).when(
            part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)).cast("long") * F.lit(PAGE_TOKENS)
        ).otherwise(F.lit(0)).cast("long")

    def body(sofar: Column, part: Column) -> Column:
        """Texts that follow one another are escaped as one, so no control string can be put together out of two, and a
        ``<`` in front of a placeholder stands apart from it."""
        mark = F.concat(F.lit("<|"), part["kind"], F.lit("|>"))
        return F.when(
            _attached(part),
            F.struct(F.concat(sofar["done"], escape(sofar["open"]), mark).alias("done"), F.lit("").alias("open")),
        ).otherwise(
            F.struct(
                sofar["done"].alias("done"), F.concat(sofar["open"], F.coalesce(part["text"], F.lit(""))).alias("open")
            )
        )

    attached = F.filter(parts, _attached)
    return {
        "body": F.aggregate(
            parts,
            F.struct(F.lit("").alias("done"), F.lit("").alias("open")),
            body,
            lambda s: F.concat(s["done"], escape(s["open"])),
        ),
        "attachments": F.transform(attached, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), tokens(p).alias("tokens"))),
        "media_tokens": F.aggregate(attached, F.lit(0).cast("long"), lambda a, p: a + tokens(p)),
    }


def format_turns(df: DataFrame, role: str = "role", text: str | None = "text", parts: str | None = None) -> DataFrame:
    """Every row's turn: all columns, then ``turn_text``, ``loss_from`` and ``loss_len`` (code points within it),
    ``attachments``, ``media_tokens``, which replace columns of these names. Nothing is shuffled. Only the body of an
    assistant's turn bears loss. Null roles, texts and lists of parts are empty; texts may be of any length; repeated
    rows are formatted each for itself; an empty table gives no rows."""
    inner, role = numbered(df), F.col(number(df, role))
    seen = visit_parts(F.col(number(df, parts)) if parts else text_part(F.col(number(df, text))))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    learned = F.coalesce(role == "assistant", F.lit(False))
    made = {
        "turn_text": F.concat("head", "body", F.lit(END)),
        "loss_from": F.char_length("head"),
        "loss_len": F.when(learned, F.char_length("body")).otherwise(F.lit(0)),
        "attachments": F.col("attachments"),
        "media_tokens": F.col("media_tokens"),
    }
    kept = [F.col(number(df, c)).alias(c) for c in df.columns if c not in made]
    return inner.withColumns({**seen, "head": head}).select(*kept, *[c.alias(name) for name, c in made.items()])


def format_conversations(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str | None = "text",
    parts: str | None = None,
) -> DataFrame:
    """One row a conversation: ``conv, formatted, loss_mask, attachments, media_tokens``.

    ``loss_mask`` has, for each turn, the code points ``from`` the turn's start on and the ``len`` of them that
    bear loss. Turns are in order of ``turn`` (nulls first), ties by the formatted turn; repeated rows are turns
    like any other, rows with a null conversation form one. Null roles and texts are empty, an empty table gives no rows,
    extra columns are ignored. A conversation's output is one value, so its rows meet in one place; use ``format_turns``
    where only single turns are needed.
    """
    piece = F.struct(F.col(turn).alias("turn"), "turn_text", "loss_from", "loss_len", "attachments", "media_tokens")
    grouped = format_turns(df, role, text, parts).groupBy(F.col(conv).alias(conv)).agg(
        F.sort_array(F.collect_list(piece)).alias("t")
    )
    return grouped.select(
        conv,
        F.array_join(F.transform("t", lambda t: t["turn_text"]), "").alias("formatted"),
        F.transform("t", lambda t: F.struct(t["loss_from"].alias("from"), t["loss_len"].alias("len"))).alias("loss_mask"),
        F.flatten(F.transform("t", lambda t: t["attachments"])).alias("attachments"),
        F.aggregate("t", F.lit(0).cast("long"), lambda a, t: a + t["media_tokens"]).alias("media_tokens"),
    )


def read_back(df: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What formatted conversations say: ``conv, formatted, turns`` (role, text), ``loss_text``. Placeholders stay. What
    was null is empty, repeated rows are read each for itself, and an empty table gives no rows."""
    pieces = F.slice(F.split("formatted", r"<\|start\|>"), 2, F.lit(2**31 - 1))

    def turn(piece: Column) -> Column:
        end = F.instr(piece, "\n")
        body = F.substring(piece, end + 1, F.char_length(piece) - end - len(END))
        return F.struct(
            unescape_role(F.substring(piece, F.lit(1), end - 1)).alias("role"), unescape(body).alias("text")
        )

    masked = F.zip_with(
        "pieces", "loss_mask", lambda p, m: unescape(F.substring(p, m["from"] - len(START) + 1, m["len"]))
    )
    return df.withColumn("pieces", pieces).select(
        conv, "formatted", F.transform("pieces", turn).alias("turns"), F.array_join(masked, "").alias("loss_text")
    )
