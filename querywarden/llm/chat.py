"""Chat formatting with Spark expressions only.

Turns of one conversation are collected as structs, sorted by (turn, role, text), adjacent turns of one
role are merged into one block by an array aggregation, and the blocks are joined to one string:

    ### assistant:\\n<text><more/><text of the next turn of that role></turn>\\n

Every text is escaped so that it holds no control string of the template; the escape can be undone, so
the turns can be read back from the output. The loss mask is a list of (start, length) spans of the
output in code points: one for the text of each assistant turn, without markers.

A null text counts as empty, a null role as the empty role. Rows whose conversation id is null form one
conversation. Repeated rows are turns of their own. An empty table gives no row. Other columns are ignored.
A conversation is one output row, so a single conversation must fit in a task; conversations of any number
are spread by their id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from querywarden.functions.staging import pinned
from querywarden.llm.base import fresh

HEAD, BODY, END, MORE = "### ", ":\n", "</turn>\n", "<more/>"
#: Code of each control string in an escaped text. The back-slash comes first when escaping and last when
#: undoing it; every back-slash of an escaped text then begins one of these codes.
CODES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"), ("<more/>", "\\m"))


def escape(text: Column) -> Column:
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def escape_role(role: Column) -> Column:
    """A role ends at the first line break of its block, so it must have none of its own."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def unescape(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def merged_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: (conv_id, blocks), a block being (role, texts) with the escaped texts of
    adjacent turns of one role."""
    texts = F.coalesce(F.col(text), F.lit(""))
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), texts.alias("text")).alias("t"),
    )
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # Block borders are the turns whose role differs from the turn before; each block is a slice. One linear
    # pass finds them; growing an array of blocks turn by turn would copy it each time.
    borders = F.expr("filter(sequence(1, size(turns)), i -> i = 1 OR turns[i - 1].role <> turns[i - 2].role)")
    blocks = F.expr(
        "transform(borders, (b, k) -> struct(turns[b - 1].role AS role, "
        "transform(slice(turns, b, coalesce(get(borders, k + 1), size(turns) + 1) - b), t -> t.text) AS texts))"
    )
    return listed.withColumn("borders", borders).select("conv_id", blocks.alias("blocks"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of start and length, from 0)."""
    merged = merged_turns(turns, conv, turn, role, text)
    # Pieces in output order; lengths of all pieces before give the spans.
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.array(F.struct(F.concat(F.lit(HEAD), escape_role(b["role"]), F.lit(BODY)).alias("s"), F.lit(False).alias("loss"))),
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda x, i: F.array(
                            F.struct(F.when(i > 0, F.lit(MORE)).otherwise(F.lit("")).alias("s"), F.lit(False).alias("loss")),
                            F.struct(escape(x).alias("s"), (b["role"] == "assistant").alias("loss")),
                        ),
                    )
                ),
                F.array(F.struct(F.lit(END).alias("s"), F.lit(False).alias("loss"))),
            ),
        )
    )
    # The offset of a piece is the sum of the lengths before it. A window over the pieces of a conversation adds
    # them up once; an array that grows turn by turn would be copied each time.
    listed = merged.select("conv_id", F.posexplode(pieces).alias("place", "piece")).select("conv_id", "place", "piece", F.char_length("piece.s").cast("long").alias("length"))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    listed = listed.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)))
    whole = listed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "piece", "start", "length"))).alias("pieces"))
    loss = F.filter("pieces", lambda p: p["piece"]["loss"])
    return whole.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["piece"]["s"]), "").alias("formatted"),
        F.transform(loss, lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"))).alias("loss_spans"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """The turns and the text under the loss mask, from the output of `format_chats` alone: adds turns
    (array of role and text) and loss_texts (array)."""
    # All but the last piece of the split end with the end marker; the last is empty.
    blocks = F.filter(F.split("formatted", END), lambda b: b != "")
    head, body = len(HEAD), len(BODY)

    def turns_of(block: Column) -> Column:
        at = F.locate(BODY, block)
        role = unescape_role(F.substring(block, F.lit(head + 1), at - F.lit(head + 1)))
        texts = F.split(F.substring(block, at + F.lit(body), F.char_length(block)), MORE)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    # Four bytes for each code point, so a span is cut out at its place without counting from the start. The
    # encoded text is pinned: it is made once for a conversation, not once for a span.
    wide = fresh(chats, "wide")
    chats = pinned(chats, wide, "encode(formatted, 'UTF-32')")

    def under(span: Column) -> Column:
        return unescape(F.decode(F.substring(F.col(wide), (4 * span["start"] + 1).cast("int"), (4 * span["length"]).cast("int")), "UTF-32"))

    back = chats.withColumn("turns", F.flatten(F.transform(blocks, turns_of)))
    return back.withColumn("loss_texts", F.transform("loss_spans", under)).drop(wide)
