r"""Chat formatting of messages with typed content parts, in DataFrame operations only.

A message has a role and a list of parts. Each part is visited by its type: text is escaped, an image, audio or document becomes a
placeholder in its place and an attachment with its reference, its offset and the number of tokens that the placeholder stands
for. A conversation is one text of turns and one list of turns, which says of each how long it is, which part of it counts for
the loss, and its attachments.

    <|begin|> then for each message in order: \n<|turn|>ROLE\n<|text|>CONTENT\n<|end|>

Escaping is reversible: a control string inside a role or text gets one backslash more than stands before it, so a control
string without a backslash before it is the template's. `turns` reads a formatted text back with the template alone.

A message is formatted where it is read. One shuffle brings the messages of a conversation into one row, which is the
operator's unit of output; as any string, a conversation must stay below 2 GB.

Cases. Null role or text: empty. Null or empty list of parts: empty content. Part of another type: its text, as text. Part with
a null reference or measure: attachment with a null reference, or of one token. Equal order values: by formatted message. Null
order value: first. Null conversation id: a conversation of its own. Repeated rows: each a message. Empty table: empty result.
Long texts: whole. Only the columns named by the caller are read.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEGIN, TURN, TEXT, END = "<|begin|>", "<|turn|>", "<|text|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Never left bare inside a text: those of this template and those that models commonly reserve.
CONTROL = (BEGIN, TURN, TEXT, END, *PLACEHOLDERS.values(), "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

#: One content part; measures that a type does not have are null.
PART = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("ref", T.StringType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("seconds", T.DoubleType()),
    T.StructField("pages", T.IntegerType()),
])
#: Pixels a side of an image patch, tokens of a patch, of a second of audio, of a document page.
PATCH, PER_PATCH, PER_SECOND, PER_PAGE = 28, 1, 25, 256

_CONTROL = "(?:" + "|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))) + ")"
_BARE, _ESCAPED = rf"(?<!\\)(\\*+)(?={_CONTROL})", rf"(?<!\\)\\(\\*+)(?={_CONTROL})"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _BARE, r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def text_part(text: Column) -> Column:
    """A list of one text part."""
    fields = [F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields[2:]]
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *fields))


def _tokens(part: Column) -> Column:
    patches = F.ceil(part["width"] / F.lit(PATCH)) * F.ceil(part["height"] / F.lit(PATCH)) * F.lit(PER_PATCH)
    measured = (
        F.when(part["type"] == "image", patches)
        .when(part["type"] == "audio", F.ceil(part["seconds"] * F.lit(PER_SECOND)))
        .when(part["type"] == "document", part["pages"] * F.lit(PER_PAGE))
    )
    return F.greatest(F.coalesce(measured, F.lit(1)).cast("long"), F.lit(1).cast("long"))


def _visit(part: Column) -> Column:
    """What a part leaves in the text, and the attachment it makes, if any."""
    attached = part["type"].isin(list(PLACEHOLDERS))
    shown = F.lit(None).cast("string")
    for kind, placeholder in PLACEHOLDERS.items():
        shown = F.coalesce(shown, F.when(part["type"] == kind, F.lit(placeholder)))
    return F.struct(
        F.coalesce(shown, escaped(F.coalesce(part["text"], F.lit("")))).alias("shown"),
        F.when(attached, part["type"]).alias("type"),
        part["ref"].alias("ref"),
        _tokens(part).alias("tokens"),
    )


def _flattened(parts: Column, before: Column) -> Column:
    """Content of a message and its attachments with their offsets in the turn; `before`: code points that precede the content."""
    no_attachment = F.array().cast("array<struct<type:string,ref:string,at:bigint,tokens:bigint>>")
    start = F.struct(F.array().cast("array<string>").alias("shown"), before.cast("long").alias("at"), no_attachment.alias("attachments"))

    def step(held: Column, part: Column) -> Column:
        own = F.struct(part["type"].alias("type"), part["ref"].alias("ref"), held["at"].alias("at"), part["tokens"].alias("tokens"))
        return F.struct(
            F.array_append(held["shown"], part["shown"]).alias("shown"),
            (held["at"] + F.length(part["shown"])).alias("at"),
            F.when(part["type"].isNotNull(), F.array_append(held["attachments"], own)).otherwise(held["attachments"]).alias("attachments"),
        )

    return F.aggregate(F.transform(F.coalesce(parts, F.array().cast(T.ArrayType(PART))), _visit), start, step)


def formatted(df: DataFrame, id: str, order: str, role: str, parts: Column, learned: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row a conversation: its id, `formatted`, and `turns`, an array with a struct for each message in order.

    Of a turn: `chars`, its length in the text; `loss_at` and `loss_chars`, the span in it that counts for the loss (code points,
    none for roles not in `learned`); `attachments`, each with type, ref, offset in the turn and tokens; `attached_tokens`.
    """
    name = F.coalesce(F.col(role), F.lit(""))
    opening = F.concat(F.lit("\n" + TURN), escaped(name), F.lit("\n" + TEXT))
    read = df.select(F.col(id).alias("__id"), F.col(order).alias("__order"), opening.alias("__opening"), name.isin(list(learned)).alias("__learned"), parts.alias("__parts"))
    flat = read.select("__id", "__order", "__opening", "__learned", _flattened(F.col("__parts"), F.length("__opening")).alias("__flat"))
    length = F.col("__flat")["at"] - F.length("__opening")
    turn = flat.select(
        F.col("__id").alias(id),
        F.struct(
            F.col("__order").alias("__order"),
            F.concat(F.col("__opening"), F.array_join(F.col("__flat")["shown"], ""), F.lit("\n" + END)).alias("__turn"),
            F.length("__opening").cast("long").alias("loss_at"),
            F.when(F.col("__learned"), length).otherwise(0).cast("long").alias("loss_chars"),
            F.col("__flat")["attachments"].alias("attachments"),
        ).alias("__message"),
    )
    ordered = turn.groupBy(id).agg(F.array_sort(F.collect_list("__message")).alias("__messages"))

    def described(message: Column) -> Column:
        total = F.aggregate(message["attachments"], F.lit(0).cast("long"), lambda held, a: held + a["tokens"])
        return F.struct(
            F.length(message["__turn"]).cast("long").alias("chars"), message["loss_at"], message["loss_chars"], message["attachments"], total.alias("attached_tokens")
        )

    return ordered.select(
        id,
        F.concat(F.lit(BEGIN), F.array_join(F.transform("__messages", lambda m: m["__turn"]), "")).alias("formatted"),
        F.transform("__messages", described).alias("turns"),
    )


def turns(text: Column) -> Column:
    """Roles and contents that a formatted text holds, unescaped, in order; placeholders stay in contents as they are."""
    whole = F.filter(F.split(text, re.escape("\n" + TURN)), lambda turn, at: at > 0)

    def read(turn: Column) -> Column:
        role = F.substring_index(turn, "\n" + TEXT, 1)
        content = F.substr(turn, F.length(role) + F.lit(len("\n" + TEXT) + 1), F.length(turn) - F.length(role) - F.lit(len("\n" + TEXT) + len("\n" + END)))
        return F.struct(unescaped(role).alias("role"), unescaped(content).alias("content"))

    return F.transform(whole, read)


def learned_texts(text: Column, described: Column) -> Column:
    """The unescaped texts under the loss mask, in order. Turns are cut by the template, each span inside its turn."""
    marker = "\n" + TURN
    whole = F.filter(F.split(text, re.escape(marker)), lambda turn, at: at > 0)
    spans = F.transform(F.arrays_zip(whole.alias("turn"), described.alias("mask")), lambda z: F.struct(z["turn"].alias("turn"), z["mask"].alias("mask")))
    counted = F.filter(spans, lambda z: z["mask"]["loss_chars"] > 0)
    return F.transform(
        counted,
        lambda z: unescaped(F.substr(z["turn"], (z["mask"]["loss_at"] - F.lit(len(marker) - 1)).cast("int"), z["mask"]["loss_chars"].cast("int"))),
    )


def statement(added: Mapping[str, Sequence[tuple[str, str]]]) -> str:
    """Figures of all conversations of a table `conversations` and of `added` ones (id to roles and texts) in SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    control = quoted("|".join(map(re.escape, CONTROL)))
    own = "".join(f" UNION ALL SELECT {i}, {k}, {quoted(r)}, {quoted(t)}" for i, rows in added.items() for k, (r, t) in enumerate(rows))
    size = lambda c: f"length({c}) + len(regexp_extract_all({c}, {control}))"
    around = len("\n" + TURN + "\n" + TEXT + "\n" + END)
    return f"""WITH messages AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations{own})
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
            sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
            (sum({size("role")} + {size("text")} + {around}) + {len(BEGIN)})::BIGINT AS formatted_chars,
            0::BIGINT AS attached_tokens
        FROM messages GROUP BY conv_id"""
