"""Chat formatting by event-sourced reconstruction; DataFrame functions only.

A conversation is a log of events, each with a sequence number and the message
it concerns. Folding a message: its last ``edit`` or ``regenerate`` replaces
what came before (an edit with its text, a regeneration with nothing), later
``delta`` events append their texts in order; a ``delete`` as last such event
removes it. Its role is the last one its events name. Messages stand in the
order of their first events.

Rendering, one turn after another:

    system     <s>[SYS]text[/SYS]</s>
    user       <s>[INST]text[/INST]</s>
    assistant  <s>text</s>
    any other  <s>[ROLE]role[/ROLE]text</s>

A control string inside a text or a role gets a backslash after its first
character, one more if it has some already (``</s>`` becomes ``<\\/s>``), so an
escaped text holds none of them and taking one backslash away restores it.
Texts of the assistant are under the loss mask.

Events are folded by message first (map-side combining of large partial
states is not needed then), so only whole messages meet per conversation,
whose row holds all of its text by definition.

Defined cases: null texts count as empty, a null role as an empty one; ties of
sequence numbers go by kind, then text, so repeated rows of a log are applied
each; rows with a null conversation form one conversation of their own; an
empty log gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
CONTROL = "<s>, </s>, [INST], [/INST], [SYS], [/SYS], [ROLE], [/ROLE]"
_ESCAPE = r"([<\[])(\\*/?(?:s>|(?:INST|SYS|ROLE)\]))"
_UNESCAPE = r"([<\[])\\(\\*/?(?:s>|(?:INST|SYS|ROLE)\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


def fold_messages(events: DataFrame) -> DataFrame:
    """Final messages of a log (conv_id, seq, message, kind, role, text):
    ``conv_id, first_seq, message, role, text``, deleted messages left out."""
    kind = F.coalesce("kind", F.lit("delta"))
    # Resets rank before deltas of the same sequence number.
    step = F.struct(F.col("seq"), F.when(kind == "delta", 1).otherwise(0).alias("rank"),
                    kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    folded = (events.groupBy("conv_id", "message")
              .agg(F.min("seq").alias("first_seq"),
                   F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("_role"),
                   F.max(F.when(kind != "delta", step)).alias("_reset"),
                   F.array_sort(F.collect_list(F.when(kind == "delta", step))).alias("_deltas")))
    after = F.when(F.col("_reset").isNull(), F.col("_deltas")).otherwise(
        F.filter("_deltas", lambda d: d > F.col("_reset")))
    head = F.when(F.col("_reset.kind") == "edit", F.col("_reset.text")).otherwise(F.lit(""))
    return (folded.where(~F.coalesce(F.col("_reset.kind") == "delete", F.lit(False)))
            .select("conv_id", "first_seq", "message",
                    F.coalesce("_role.role", F.lit("")).alias("role"),
                    F.concat(head, F.array_join(F.transform(after, lambda d: d["text"]), ""))
                    .alias("text")))


def segments(role: Column, text: Column) -> Column:
    """A turn as ``array<struct<text, loss>>`` of formatted pieces."""
    piece = lambda t, loss: F.struct(t.alias("text"), F.lit(loss).alias("loss"))
    body = escape(text)

    def framed(before: str, after: str):
        return F.array(piece(F.lit("<s>" + before), False), piece(body, False),
                       piece(F.lit(after + "</s>"), False))

    named = F.array(piece(F.concat(F.lit("<s>[ROLE]"), escape(role), F.lit("[/ROLE]")), False),
                    piece(body, False), piece(F.lit("</s>"), False))
    return (F.when(role == "system", framed("[SYS]", "[/SYS]"))
            .when(role == "user", framed("[INST]", "[/INST]"))
            .when(role == "assistant", F.array(piece(F.lit("<s>"), False), piece(body, True),
                                               piece(F.lit("</s>"), False)))
            .otherwise(named))


def format_conversations(messages: DataFrame) -> DataFrame:
    """``conv_id, segments, formatted`` of final messages (conv_id, first_seq, message, role, text).

    ``formatted`` joins the texts of ``segments``, whose ``loss`` flags are the mask.
    """
    turns = messages.select("conv_id", F.struct("first_seq", "message", "role", "text").alias("_turn"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    parts = F.flatten(F.transform("_turns", lambda t: segments(t["role"], t["text"])))
    return (whole.select("conv_id", parts.alias("segments"))
            .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")))


def parse_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>`` read back from a formatted conversation."""
    # Every turn ends with </s>, which no escaped text holds; the piece after the last is empty.
    pieces = F.split(formatted, "</s>")
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def one(t: Column) -> Column:
        body = F.substr(t, F.lit(4))                      # after <s>
        def between(before: int, after: int) -> Column:
            return F.substr(body, F.lit(before + 1), F.length(body) - F.lit(before + after))
        name_end = F.locate("[/ROLE]", body)
        role = (F.when(body.startswith("[SYS]"), F.lit("system"))
                .when(body.startswith("[INST]"), F.lit("user"))
                .when(body.startswith("[ROLE]"),
                      unescape(F.substr(body, F.lit(7), name_end - F.lit(7))))
                .otherwise(F.lit("assistant")))
        text = (F.when(body.startswith("[SYS]"), between(5, 6))
                .when(body.startswith("[INST]"), between(6, 7))
                .when(body.startswith("[ROLE]"), F.substr(body, name_end + F.lit(7)))
                .otherwise(body))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(turns, one)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]),
                                    lambda s: unescape(s["text"])), "")


def rows_as_events(rows: DataFrame) -> DataFrame:
    """The log of a table of turns (conv_id, turn, role, text): each row a message
    of one event; rows of one turn stand in the order of role and text, repeated
    rows side by side.

    The rows are dealt by conversation, which becomes one row in the end; the
    groupings after that are finer or as fine and need no other exchange."""
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id")
    same = plain.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("_n"))
    each = same.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return each.select("conv_id", F.col("turn").alias("seq"),
                       F.struct("turn", "role", "text", "_copy").alias("message"),
                       F.lit("delta").alias("kind"), "role", "text")


def digest(formatted: DataFrame) -> DataFrame:
    """Figures of each formatted conversation, read back from it."""
    turns = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (formatted.withColumns({"_turns": parse_turns(F.col("formatted")),
                                   "_loss": loss_text(F.col("segments"))})
            .select("conv_id", F.size("_turns").cast("long").alias("n_turns"),
                    F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"),
                    F.length("_loss").cast("long").alias("loss_chars"),
                    F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars")))
