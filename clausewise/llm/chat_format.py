"""Chat formatting by a grammar round trip, in DataFrame functions only.

A turn is rendered plainly, read again by a deterministic parser and compared with its source;
a turn that does not come back identical is rendered once more with one more level of escaping.
One level always suffices: an escaped text holds no ``<|``, so it can neither end its own turn
nor begin another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.llm.common import once

START, END = "<|im_start|>", "<|im_end|>"
# "<", any number of "~", perhaps "n", then "|": the only strings that escaping touches
_PLAIN, _ESCAPED = r"<(~*)(n?)\|", r"<~(~*)(n?)\|"
_NEWLINE = "<n|"


def escape(text: Column) -> Column:
    """Put one ``~`` more behind the ``<`` of every ``<|``, ``<n|``, ``<~|`` and so on."""
    return F.regexp_replace(text, _PLAIN, r"<~$1$2|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"<$1$2|")


def escape_role(role: Column) -> Column:
    """As ``escape``; a line feed, which would end the header, is written ``<n|``."""
    return F.replace(escape(role), F.lit("\n"), F.lit(_NEWLINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(_NEWLINE), F.lit("\n")))


def parse(formatted: Column) -> Column:
    """Turns of a formatted text: array of (role, text), escapes undone.

    A turn is START role \\n text END \\n. What breaks that grammar gives a turn with a null text.
    """

    def turn(piece: Column) -> Column:
        header = F.substring_index(piece, "\n", 1)
        rest = piece.substr(F.char_length(header) + 2, F.char_length(piece))
        body = F.substring_index(rest, END, 1)
        whole = F.concat(header, F.lit("\n"), body, F.lit(END + "\n")) == piece
        return F.struct(unescape_role(header).alias("role"), F.when(whole, unescape(body)).alias("text"))

    pieces = F.split(formatted, r"<\|im_start\|>")
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def format_conversations(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_role: str = "assistant",
    levels: int = 1,
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``loss_spans`` (start, length in UTF-8 bytes).

    Turns are ordered by turn, then role and text (ties); a null turn comes first, a null role or
    text counts as empty, rows with a null conversation id make one conversation, repeated rows
    are repeated turns. Other columns are ignored. No rows give no conversations. The spans
    cover the escaped text of every turn of ``loss_role``, without its header and END.
    A conversation is one text, so its turns meet in one task: that is the size of one output row.
    """
    source = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )

    def render(r: Column, t: Column) -> Column:
        return F.concat(F.lit(START), r, F.lit("\n"), t, F.lit(END + "\n"))

    wanted = F.array(F.struct("role", "text"))
    tries = [(F.col("role"), F.col("text"))]
    for _ in range(levels):
        tries.append((escape_role(tries[-1][0]), escape(tries[-1][1])))
    chosen = reduce(
        lambda later, now: F.when(parse(render(*now)) == wanted, F.struct(now[0].alias("r"), now[1].alias("t"))).otherwise(
            later
        ),
        reversed(tries[:-1]),
        F.struct(tries[-1][0].alias("r"), tries[-1][1].alias("t")),
    )
    coded = source.select("conv_id", "turn", "role", "text", once(coded=chosen)).select(
        "conv_id",
        "turn",
        "role",
        "text",
        render(F.col("coded.r"), F.col("coded.t")).alias("segment"),
        F.octet_length(F.concat(F.lit(START), F.col("coded.r"), F.lit("\n"))).cast("long").alias("head"),
        F.octet_length("coded.t").cast("long").alias("body"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = coded.select(
        "conv_id",
        F.row_number().over(order).alias("pos"),
        "segment",
        F.when(
            F.col("role") == loss_role,
            F.struct(
                (F.coalesce(F.sum(F.octet_length("segment")).over(before), F.lit(0)) + F.col("head")).alias("start"),
                F.col("body").alias("length"),
            ),
        ).alias("span"),
    )
    rows = F.array_sort(F.collect_list(F.struct("pos", "segment", "span")))
    return placed.groupBy("conv_id").agg(rows.alias("rows")).select(
        "conv_id",
        F.array_join(F.transform("rows", lambda x: x["segment"]), "").alias("formatted"),
        F.filter(F.transform("rows", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from ``formatted`` and ``loss_spans`` alone: counts and digests."""

    def in_loss(span: Column) -> Column:
        piece = F.substring(F.col("raw"), (span["start"] + 1).cast("int"), span["length"].cast("int"))
        return unescape(piece.cast("string"))

    read = formatted.select(
        "conv_id", "formatted", "loss_spans", once(raw=F.col("formatted").cast("binary"), turns=parse(F.col("formatted")))
    ).select("conv_id", "formatted", "turns", once(loss=F.array_join(F.transform("loss_spans", in_loss), "")))
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
