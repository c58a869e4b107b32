"""Chat formatting from typed content parts, in DataFrame functions only.

A message's content is an array of typed parts (`PART`). The visitor walks them in order: text parts
are escaped, image, audio and document parts become placeholders, and each attachment is recorded
with its reference, its position and the tokens it expands to. Turns are then marked as

    <|im_start|>role\\n content <|im_end|>\\n

In contents a backslash is doubled and `<|` is written `<\\|`, also where its two signs come from two
text parts; so no text can open or close a turn, and all are read back exactly. In roles `%`, line
feeds and `<|` are percent-encoded. The loss mask is a list of (start, length) code-point spans of the
formatted string: assistant contents.

Edge cases. Null text: empty; null content: no parts. Null role: empty. Null conversation id: one
conversation of its own. Rows with equal turn: ordered by role, then content; repeated rows all stay.
An unknown part type raises. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: units: pixels wide and high for images, seconds for audio, pages for documents.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
START, END = "<|im_start|>", "<|im_end|>"
#: Tokens that attachments expand to: a patch of an image, a second of audio, a page of a document.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 512


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    for a, b in (("%", "%25"), ("\n", "%0A"), ("<|", "<%7C")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescape_role(role: Column) -> Column:
    for a, b in (("<%7C", "<|"), ("%0A", "\n"), ("%25", "%")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def text_parts(text: Column) -> Column:
    """One text part: the content of a plain message."""
    none = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), *none))


def _tokens(p: Column) -> Column:
    up = lambda x, unit: F.ceil(F.coalesce(x, F.lit(0)) / unit)
    return (
        F.when(p["type"] == "image", up(p["width"], PATCH) * up(p["height"], PATCH))
        .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(0)) * PAGE_TOKENS)
        .otherwise(0)
        .cast("long")
    )


def _said(p: Column) -> Column:
    return F.coalesce(p["text"], F.lit(""))


def _visit(p: Column, before: Column) -> Column:
    """A part as it is written; `before` is the part before it, null for the first."""
    media = p["type"].isin("image", "audio", "document")
    split = F.coalesce((before["type"] == "text") & _said(before).endswith("<") & _said(p).startswith("|"), F.lit(False))
    text = F.concat(F.when(split, F.lit("\\")).otherwise(""), escape(_said(p)))
    return F.when(p["type"] == "text", text).when(media, F.concat(F.lit("<|"), p["type"], F.lit("|>"))).otherwise(F.raise_error(F.concat(F.lit("unknown part type: "), F.coalesce(p["type"], F.lit("null")))))


def flatten(messages: DataFrame, content: str = "content") -> DataFrame:
    """Adds `flat` (text with placeholders), `attachments` (in order) and `expanded_tokens`."""
    parts = F.coalesce(F.col(content), F.array().cast(f"array<{PART}>"))
    media = F.filter(parts, lambda p: p["type"] != "text")
    # without empty texts, so that what stands before a text is the part before it
    full = F.filter(parts, lambda p: ~F.coalesce((p["type"] == "text") & (_said(p) == ""), F.lit(False)))
    return messages.withColumns(
        {
            "flat": F.array_join(F.transform(full, lambda p, i: _visit(p, F.get(full, i - 1))), ""),
            "attachments": F.transform(media, lambda p, i: F.struct(i.cast("int").alias("ordinal"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))),
            "expanded_tokens": F.aggregate(media, F.lit(0).cast("long"), lambda s, p: s + _tokens(p)),
        }
    )


def format_chat(messages: DataFrame, content: str = "content") -> DataFrame:
    """conv_id, formatted, loss_spans, attachments, expanded_tokens from (conv_id, turn, role, content).

    A conversation is one output row, so its turns meet in one row; nothing larger is gathered.
    """
    flat = flatten(messages, content)
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    turn = F.struct("turn", role.alias("role"), F.col("flat").alias("flat"), "attachments", "expanded_tokens")
    turns = flat.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    head = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    pieces = F.transform("t", lambda t: F.struct(F.length(head(t)).alias("before"), F.length(t["flat"]).alias("n"), (t["role"] == "assistant").alias("loss"), F.concat(head(t), t["flat"], F.lit(f"{END}\n")).alias("s")))
    rows = turns.select("conv_id", "t", pieces.alias("p"))
    span = "struct<start:int,length:int>"
    seen = F.aggregate(
        "p",
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["s"])).alias("at"),
            F.when(p["loss"], F.concat(s["spans"], F.array(F.struct((s["at"] + p["before"]).alias("start"), p["n"].alias("length")).cast(span)))).otherwise(s["spans"]).alias("spans"),
        ),
    )
    return rows.select(
        "conv_id",
        F.array_join(F.transform("p", lambda p: p["s"]), "").alias("formatted"),
        seen["spans"].alias("loss_spans"),
        F.flatten(F.transform("t", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(i.cast("int").alias("turn_ordinal"), a["ordinal"].alias("ordinal"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
        F.aggregate("t", F.lit(0).cast("long"), lambda s, t: s + t["expanded_tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted string; placeholders stay in the text."""
    segments = F.array_remove(F.split(formatted, "<\\|im_end\\|>\n"), "")
    body = lambda s: F.substr(s, F.lit(len(START) + 1))
    return F.transform(
        segments,
        lambda s: F.struct(
            unescape_role(F.substring_index(body(s), "\n", 1)).alias("role"),
            unescape(F.substr(body(s), F.locate("\n", body(s)) + 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda p: unescape(F.substr(formatted, p["start"] + 1, p["length"]))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations."""
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    rows = formatted.withColumns({"_turns": read_turns(F.col("formatted")), "_loss": loss_text(F.col("formatted"), F.col("loss_spans"))})
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("_turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"), sha(F.col("_loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
