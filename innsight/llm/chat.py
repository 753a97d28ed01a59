"""Chat formatting: a template over turns, a state machine over roles, and a loss mask.

All of it is column expressions. A turn becomes three segments: the header of its role, its
escaped text, and the end mark. A segment carries its loss flag; the formatted conversation is
the segments put together.

Escaping: a backslash doubles, ``###`` is broken up by a backslash after every second ``#``, and
``</turn>`` becomes ``<\\/turn>``. No control string is left in an escaped text, and taking the
backslash off ``\\\\``, ``\\#`` and ``\\/`` gives the text back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"


@dataclass(frozen=True)
class Template:
    """What a role's turn looks like, which roles bear loss, and which role may follow which."""

    headers: dict[str, str] = field(
        default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
    )
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> roles that may come next; a role is the state it leads to.
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
        }
    )
    final: tuple[str, ...] = ("assistant",)


def escaped(text: Column) -> Column:
    text = F.regexp_replace(text, r"\\", r"\\\\")
    text = F.regexp_replace(text, "##(?=#)", r"##\\")
    return F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#/:])", "$1")


def _header(role: Column, template: Template) -> Column:
    """The header of a role; a role the template does not know is written out, escaped."""
    other = F.concat(F.lit("### ="), F.replace(escaped(role), F.lit(":"), F.lit("\\:")), F.lit(": "))
    out = None
    for name, header in template.headers.items():
        out = (F if out is None else out).when(role == name, F.lit(header))
    return out.otherwise(other)


def _next_state(state: Column, role: Column, template: Template) -> Column:
    out = None
    for known, roles in template.follows.items():
        out = (F if out is None else out).when((state == known) & role.isin(*roles), role)
    return out.otherwise(F.lit("invalid"))


def format_conversations(
    turns: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per conversation: ``segments`` (text, loss), ``formatted``, ``n_turns``, ``valid``.

    Turns are ordered by (turn, role, text), nulls first, so ties and repeated rows have one
    order; every row is a turn. Null texts and roles count as empty. ``valid`` says whether the
    roles run through the template's state machine to a final state; invalid conversations are
    formatted all the same, for the caller to keep or drop. Rows with a null conversation id
    form one conversation. An empty table gives an empty result. Only the four named columns
    are read.

    A conversation is one output row, so its turns meet in one row; that is as long as the
    conversation itself.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(_header(t.role, template).alias("text"), F.lit(False).alias("loss")),
                F.struct(escaped(t.text).alias("text"), t.role.isin(*template.loss_roles).alias("loss")),
                F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    state = F.aggregate("turns", F.lit("start"), lambda s, t: _next_state(s, t.role, template))
    rows = rows.withColumn("segments", segments).withColumn("state", state)
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.col("state").isin(*template.final).alias("valid"),
        "segments",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    pieces = F.split(formatted, END)
    whole = F.slice(pieces, 1, F.size(pieces) - 1)

    def parsed(piece: Column) -> Column:
        role, text = None, None
        for name, header in template.headers.items():
            same = piece.startswith(F.lit(header))
            role = (F if role is None else role).when(same, F.lit(name))
            text = (F if text is None else text).when(same, F.substr(piece, F.lit(len(header) + 1)))
        other = "(?s)^### =((?:[^:\\\\]|\\\\.)*): (.*)$"
        return F.struct(
            unescaped(role.otherwise(F.regexp_extract(piece, other, 1))).alias("role"),
            unescaped(text.otherwise(F.regexp_extract(piece, other, 2))).alias("text"),
        )

    return F.transform(whole, parsed)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped segment by segment."""
    kept = F.filter(segments, lambda s: s.loss)
    return F.array_join(F.transform(kept, lambda s: unescaped(s.text)), "")
