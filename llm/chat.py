r"""Chat formatting with Spark expressions only.

Template of a conversation, blocks one after the other::

    <turn:ROLE>TEXT<next>TEXT</turn>\n

Adjacent turns of one role are merged into one block; ``<next>`` stands between
their texts, so the turns can be read back.  Control strings begin with ``<``;
inside texts and roles ``\`` is written ``\b``, ``<`` is ``\l`` and (roles)
``>`` is ``\g``, which is reversible: every backslash of the output is followed
by one of these letters, and no ``<`` of a text is left.

The loss mask is a list of [start, end) code-point spans of the formatted text,
one for each assistant text; markers are outside of it.

The turn structs of a conversation are collected and sorted.  Runs of one role
are merged by array functions: the places where the role changes are filtered
out of the array of places, and each run is the slice between two of them, joined
as one block.  Offsets are running sums of piece lengths, folded by array
aggregation in chunks of ``CHUNK`` pieces, as a fold copies the array it grows.

Defined results: null text or role is empty; turns sort by turn (null first),
role and text, so ties and repeated rows have one order; a null conv_id is a
conversation of its own; an empty table gives no rows; long texts are moved as
they are; other columns, whatever their names, are left out.  A conversation is
one output row and so one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"
#: Pieces of a conversation whose offsets are summed in one fold.
CHUNK = 256
_OPEN, _NEXT, _CLOSE = "<turn:", "<next>", "</turn>\n"


def _escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def _unescape(x: Column) -> Column:
    plain = F.replace(F.replace(x, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.replace(plain, F.lit("\\b"), F.lit("\\"))


def _before(values: Column, first: Column) -> Column:
    """first plus the sum of the values before each place."""
    step = lambda a, x: F.struct((a.total + x).alias("total"), F.concat(a.out, F.array(a.total)).alias("out"))
    return F.aggregate(values, F.struct(first.cast("long").alias("total"), F.array().cast("array<long>").alias("out")), step, lambda a: a.out)


def format_chats(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = LOSS_ROLE
) -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start long, end long>> for each conversation."""
    turn = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")
    )
    whole = rows.select(F.col(conv_col).alias("conv_id"), turn.alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("t"))
    # each array is a column that several expressions name, so that it is built once
    n = F.size("t")
    changes = lambda i: (i == 0) | (F.get("t", i).role != F.get("t", i - 1).role)
    runs = whole.select("conv_id", "t", F.filter(F.sequence(F.lit(0), n - 1), changes).alias("starts"))
    block = lambda s, k: F.struct(
        F.get("t", s).role.alias("role"),
        F.transform(F.slice("t", s + 1, F.coalesce(F.get("starts", k + 1), n) - s), lambda x: _escape(x.text)).alias("texts"),
    )
    blocks = runs.select("conv_id", F.transform("starts", block).alias("blocks"))
    opened = lambda b: F.concat(F.lit(_OPEN), F.replace(_escape(b.role), F.lit(">"), F.lit("\\g")), F.lit(">"))
    piece = lambda b, x, k: F.struct(
        F.when(k == 0, opened(b)).otherwise(_NEXT).alias("head"),
        x.alias("body"),
        F.when(k == F.size(b.texts) - 1, _CLOSE).otherwise("").alias("tail"),
        (b.role == loss_role).alias("loss"),
    )
    pieces = blocks.select("conv_id", F.flatten(F.transform("blocks", lambda b: F.transform(b.texts, lambda x, k: piece(b, x, k)))).alias("pieces"))
    sized = pieces.select(
        "conv_id",
        "pieces",
        F.array_join(F.transform("pieces", lambda p: F.concat(p.head, p.body, p.tail)), "").alias("formatted"),
        F.transform("pieces", lambda p: (F.length(p.head) + F.length(p.body) + F.length(p.tail)).cast("long")).alias("sizes"),
    )
    parts = sized.select(
        "conv_id", "pieces", "formatted", F.transform(F.sequence(F.lit(0), F.size("sizes") - 1, F.lit(CHUNK)), lambda i: F.slice("sizes", i + 1, F.lit(CHUNK))).alias("parts")
    )
    totals = F.transform("parts", lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))
    offsets = F.flatten(F.zip_with("parts", _before(totals, F.lit(0)), _before))
    span = lambda p, at: F.struct(
        (at + F.length(p.head)).alias("start"), (at + F.length(p.head) + F.length(p.body)).alias("end"), p.loss.alias("loss")
    )
    spans = parts.select("conv_id", "formatted", F.zip_with("pieces", offsets, span).alias("spans"))
    return spans.select(
        "conv_id",
        "formatted",
        F.transform(F.filter("spans", lambda s: s.loss), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))).alias("loss_spans"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>>, loss_text (unescaped) from formatted and loss_spans alone."""
    blocks = F.split("formatted", r"</turn>\n")
    role = lambda b: _unescape(F.substring_index(F.substring(b, len(_OPEN) + 1, 2**31 - 1), ">", 1))
    body = lambda b: F.substr(b, F.instr(b, F.lit(">")) + 1)
    turns = F.flatten(
        F.transform(
            F.slice(blocks, 1, F.size(blocks) - 1),
            lambda b: F.transform(F.split(body(b), _NEXT), lambda x: F.struct(role(b).alias("role"), _unescape(x).alias("text"))),
        )
    )
    loss = F.array_join(
        F.transform("loss_spans", lambda s: _unescape(F.substr("formatted", (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), ""
    )
    return chats.select("*", turns.alias("turns"), loss.alias("loss_text"))


def digests(chats: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests of what read_back gives."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read_back(chats).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
