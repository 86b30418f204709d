"""Chat formatting with typed content parts, in DataFrame expressions only.

A message is an ordered list of parts: text, image, audio or document. A visitor (one branch of a column ladder for each
kind) flattens the parts of a message into one string with a placeholder for every part that isn't text, records which
attachment each placeholder refers to, and counts the tokens to which it expands. The template then marks turns:

    <|im_start|>ROLE newline TEXT<|im_end|> newline

Inside roles and texts a backslash is doubled and "<|" becomes "<", backslash, "|", so that no control string can arise from
content, and both steps can be undone; a newline in a role becomes backslash, "n". The loss mask is a list of code-point
ranges of the formatted string: the content of each assistant turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

#: How many tokens a part other than text expands to: image: one for each PATCH x PATCH patch; audio: per second; document: per page.
PATCH, AUDIO_TOKENS_PER_S, DOCUMENT_TOKENS_PER_PAGE = 14, 25, 512

PART = "struct<kind:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    """Undoes escape_role(): halves of doubled backslashes are told from "\\n" by splitting at the doubled ones first."""
    parts = F.split(F.replace(c, F.lit("<\\|"), F.lit("<|")), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def visit(part: Column) -> Column:
    """One part: its string in the message, the attachment it refers to (null: none) and its tokens beyond the text."""
    kind = F.coalesce(part["kind"], F.lit("text"))
    patches = F.ceil(F.coalesce(part["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(0)) / PATCH)
    tokens = (
        F.when(kind == "image", patches)
        .when(kind == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS_PER_S))
        .when(kind == "document", F.coalesce(part["pages"], F.lit(0)) * DOCUMENT_TOKENS_PER_PAGE)
        .otherwise(F.lit(0))
        .cast("long")
    )
    attached = kind.isin("image", "audio", "document")
    return F.struct(
        F.when(attached, F.concat(F.lit("<|"), kind, F.lit("|>"))).otherwise(escape(part["text"])).alias("piece"),
        F.when(attached, F.struct(kind.alias("kind"), part["ref"].alias("ref"), tokens.alias("tokens"))).alias("attachment"),
        tokens.alias("tokens"),
    )


def text_parts(text: Column) -> Column:
    """A message of one text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *(null.cast(t).alias(n) for n, t in (("ref", "string"), ("width", "long"), ("height", "long"), ("seconds", "double"), ("pages", "long")))))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Formats conversations: conv, n_turns, formatted, loss_spans array<struct<start,length>> (code points), attachments array<struct<turn,kind,ref,tokens>> in order, expanded_tokens.

    df has a row for each turn; parts is array<PART>. Turns are in order of the turn number (nulls first), ties by role, then
    by content, so that repeated rows stay repeated in a defined order. A null role, text or list of parts is empty; an
    unknown kind is text; rows with a null conversation form one conversation of their own. Other columns are not read. A
    conversation is one output row, so its turns meet in one task; its size is that of one row.
    """
    seen = F.transform(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), visit)
    turns = (
        df.select(F.col(conv), F.col(turn).cast("long").alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("_role"), seen.alias("_seen"))
        .withColumn("_body", F.array_join(F.transform("_seen", lambda x: x["piece"]), ""))
        .withColumn("_att", F.array_compact(F.transform("_seen", lambda x: x["attachment"])))
        .withColumn("_tokens", F.aggregate("_seen", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))
    )
    one = F.struct("_turn", "_role", "_body", "_att", "_tokens")
    head = lambda t: F.concat(F.lit(OPEN), escape_role(t["_role"]), F.lit("\n"))
    whole = lambda t: F.concat(head(t), t["_body"], F.lit(CLOSE))
    grouped = turns.groupBy(conv).agg(F.array_sort(F.collect_list(one)).alias("_turns"))
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(head(t))
        span = F.array(F.struct(start.cast("long").alias("start"), F.length(t["_body"]).cast("long").alias("length")))
        return F.struct((acc["at"] + F.length(whole(t))).cast("long").alias("at"), F.when(t["_role"].isin(*trained), F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return grouped.select(
        conv,
        F.size("_turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("_turns", whole), "").alias("formatted"),
        F.aggregate("_turns", nothing, step)["spans"].alias("loss_spans"),
        F.flatten(F.transform("_turns", lambda t: F.transform(t["_att"], lambda a: F.struct(t["_turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
        F.aggregate("_turns", F.lit(0).cast("long"), lambda a, t: a + t["_tokens"]).alias("expanded_tokens"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role,text>>, escapes undone; placeholders stay as they are."""
    # no control string can stand inside a turn, so the closing mark ends one; the last piece is what follows the last mark
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    bodies = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.substr(p, F.lit(len(OPEN) + 1)))
    at = lambda p: F.locate("\n", p) if isinstance(p, str) else F.instr(p, "\n")
    return F.transform(bodies, lambda p: F.struct(unescape_role(F.substr(p, F.lit(1), at(p) - 1)).alias("role"), unescape(F.substr(p, at(p) + 1)).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, escapes undone, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digests(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of formatted conversations, read back from the formatted string: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    read = chats.select(conv, "formatted", parse_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "attachments", "expanded_tokens")
    return read.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
