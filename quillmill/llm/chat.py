"""Chat formatting: a finite-state machine over roles, a declarative template, loss flags.

Everything here is built from DataFrame expressions, so no row leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """What a formatted conversation looks like and which turn orders are allowed.

    A turn is written ``open role between text close``.  ``foreign`` lists control strings
    of other templates that must not appear in a text either.  Every control string is at
    least two characters long, and none begins with a character that another one ends with.
    """

    begin: str = "<s>"
    open: str = "<|turn|>"
    between: str = "<|text|>"
    close: str = "<|end|>\n"
    foreign: tuple[str, ...] = ("</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: state -> {role: next state}
    turns: dict = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accepting: tuple[str, ...] = ("answered",)

    def controls(self) -> list[str]:
        own = [self.begin, self.open, self.between, self.close.rstrip("\n")]
        return list(dict.fromkeys(c for c in (*own, *self.foreign) if c))


def escape(text: Column, template: ChatTemplate) -> Column:
    """Break every control string by a backslash after its first character; double backslashes."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in template.controls():
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`: a doubled backslash is one, a single one is dropped."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_conversations(
    turns: DataFrame, template: ChatTemplate = ChatTemplate(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, valid, state, formatted, segments``.

    ``segments`` is ``array<struct<text, loss>>`` and its texts joined give ``formatted``.
    ``valid`` is true if the state machine accepts the roles in turn order; ``state`` is
    where it ended (``reject`` after a role that the state does not allow).  Invalid
    conversations are formatted all the same, so nothing is lost; filter on ``valid``.

    Null text or role is empty text or role.  Rows with a null turn come first.  Equal
    turn numbers are ordered by role, then text; repeated rows stay.  A null ``conv_id``
    is a conversation of its own.  An empty table gives no rows; other columns are ignored.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
        ).alias("_t"),
    )
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("_t")).alias("_talk"))
    # array_sort puts null turns into the struct order natively: nulls come first.
    step = F.create_map(*(F.lit(x) for s, to in template.turns.items() for r, n in to.items() for x in (f"{s}\n{r}", n)))
    state = F.aggregate(
        "_talk", F.lit(template.start), lambda s, t: F.coalesce(F.element_at(step, F.concat(s, F.lit("\n"), t["role"])), F.lit("reject"))
    )
    plain, trained = F.lit(False), lambda t: t["role"].isin(*template.loss_roles)
    piece = lambda value, loss: F.struct(value.alias("text"), loss.alias("loss"))
    segments = F.concat(
        F.array(piece(F.lit(template.begin), plain)),
        F.flatten(
            F.transform(
                "_talk",
                lambda t: F.array(
                    piece(F.concat(F.lit(template.open), escape(t["role"], template), F.lit(template.between)), plain),
                    piece(escape(t["text"], template), trained(t)),
                    piece(F.lit(template.close), plain),
                ),
            )
        ),
    )
    out = talks.select("conv_id", F.size("_talk").cast("long").alias("n_turns"), state.alias("state"), segments.alias("segments"))
    return out.select(
        "conv_id",
        "n_turns",
        F.col("state").isin(*template.accepting).alias("valid"),
        "state",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
    )


def parse_formatted(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """Read a formatted conversation back: ``array<struct<role, text>>``, unescaped."""
    body = F.substr(formatted, F.lit(len(template.begin) + 1))
    quoted = lambda s: "\\Q" + s + "\\E"
    parts = F.split(body, quoted(template.close), -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    cut = F.transform(parts, lambda p: F.split(F.substr(p, F.lit(len(template.open) + 1)), quoted(template.between), 2))
    return F.transform(cut, lambda c: F.struct(unescape(c[0]).alias("role"), unescape(c[1]).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescape(s["text"])), "")
