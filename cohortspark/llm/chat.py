"""Chat formatting: a visitor over typed content parts, a reversible template, loss spans and the way back.

A message is (conversation, turn, role, parts); a part is a struct ``kind, text, ref, units`` with kind ``text``,
``image``, ``audio`` or ``document``. The visitor turns each part into a piece of the formatted text: a text part gives
its escaped text, any other kind gives a placeholder ``<kind:message.part>`` that names its place in the conversation.
Placeholders are the only unescaped ``<`` inside a message, so no text can imitate one. Attachments are listed in order
with their reference and the number of tokens they expand to.

The template of a message is ``### role: content</turn>`` and a line feed. Escaping replaces every ``\\``, ``<`` and ``#``
of a text by a backslash and a letter, so control strings cannot occur in a text and every text can be read back.

Everything is a built-in expression over one array per conversation; a conversation is the unit of the result and is
held by one task. Defined results: null texts and roles are empty; parts without a kind are text; a null list of parts
is an empty message; rows of one turn are ordered by role, then by their parts; a null conversation id is one
conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed values of the template. The backslash is escaped first and restored last.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = ((":", "\\c"), ("\n", "\\n"))
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
ATTACHED = ("image", "audio", "document")

#: Tokens that one unit of an attachment expands to: an image tile, a second of audio, a page of a document.
UNIT_TOKENS = {"image": 256.0, "audio": 25.0, "document": 700.0}

PART = "struct<kind:string,text:string,ref:string,units:double>"


def escape(text: Column, extra: tuple = ()) -> Column:
    for raw, safe in ESCAPES + extra:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column, extra: tuple = ()) -> Column:
    for raw, safe in reversed(ESCAPES[1:] + extra):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return F.replace(text, F.lit(ESCAPES[0][1]), F.lit(ESCAPES[0][0]))


def text_part(text: Column) -> Column:
    """A message of a single text part."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            text.alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("double").alias("units"),
        )
    )


def _kind(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text"))


def _is_attached(part: Column) -> Column:
    return _kind(part).isin(*ATTACHED)


def _visit(part: Column, message: Column, place: Column) -> Column:
    """The formatted piece of one part."""
    holder = F.concat(F.lit("<"), _kind(part), F.lit(":"), (message + 1).cast("string"), F.lit("."),
                      (place + 1).cast("string"), F.lit(">"))
    return F.when(_is_attached(part), holder).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def _tokens(part: Column) -> Column:
    """Tokens that a part expands to: words for text, units times the rate for attachments."""
    rate = F.lit(0.0)
    for kind, tokens in UNIT_TOKENS.items():
        rate = F.when(part["kind"] == kind, F.lit(tokens)).otherwise(rate)
    words = F.size(F.filter(F.split(F.coalesce(part["text"], F.lit("")), r"\s+"), lambda word: word != ""))
    return F.when(_is_attached(part), F.ceil(F.coalesce(part["units"], F.lit(1.0)) * rate)).otherwise(words).cast("long")


def format_chat(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                parts: str = "parts", learn_from: str = "assistant") -> DataFrame:
    """One row per conversation: ``formatted`` text, ``loss_spans`` (start and length in code points of the content
    of every ``learn_from`` message), ``attachments`` (kind, ref, tokens, message, part) and ``expanded_tokens``.
    """
    message = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(parts).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    grouped = messages.groupBy(F.col(conversation)).agg(F.sort_array(F.collect_list(message)).alias("_messages"))

    def content(m: Column, i: Column) -> Column:
        return F.array_join(F.transform(m["parts"], lambda p, j: _visit(p, i, j)), "")

    rows = grouped.select(
        F.col(conversation),
        F.transform("_messages", lambda m, i: F.struct(
            F.concat(F.lit(OPEN), escape(m["role"], ROLE_ESCAPES), F.lit(MIDDLE)).alias("head"),
            content(m, i).alias("body"),
            (m["role"] == learn_from).alias("learn"),
        )).alias("_pieces"),
        F.flatten(F.transform("_messages", lambda m, i: F.filter(
            F.transform(m["parts"], lambda p, j: F.struct(
                _kind(p).alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"),
                (i + 1).alias("message"), (j + 1).alias("part"))),
            lambda a: a["kind"].isin(*ATTACHED)))).alias("attachments"),
        F.aggregate(F.flatten(F.transform("_messages", lambda m: F.transform(m["parts"], _tokens))),
                    F.lit(0).cast("long"), lambda total, n: total + n).alias("expanded_tokens"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>")
                     .alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        head, body = F.length(piece["head"]).cast("long"), F.length(piece["body"]).cast("long")
        span = F.array(F.struct((state["at"] + head).alias("start"), body.alias("length")))
        return F.struct(
            (state["at"] + head + body + len(CLOSE)).alias("at"),
            F.when(piece["learn"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return rows.select(
        F.col(conversation),
        F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("_pieces", start, step, lambda state: state["spans"]).alias("loss_spans"),
        "attachments",
        "expanded_tokens",
    )


def read_turns(formatted: Column) -> Column:
    """(role, text) of every turn of a formatted text, unescaped; placeholders stay in the text as they are."""
    pieces = F.filter(F.split(formatted, r"\Q" + CLOSE + r"\E"), lambda piece: piece != "")
    middle = r"\Q" + MIDDLE + r"\E"

    def turn(piece: Column) -> Column:
        halves = F.split(F.substr(piece, F.lit(len(OPEN) + 1)), middle, 2)
        return F.struct(unescape(halves[0], ROLE_ESCAPES).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"])))
