"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

A conversation's rows are ordered by turn (ties by role, then text; a null turn first). The machine checks the
order of roles and names the first turn that breaks it. Each turn becomes three segments: its opening, its
text with control strings escaped, its closing; a segment carries a loss flag taken from the template. The
conversation is one value of the output, so its rows meet in one row, as the output itself requires.

Defined results: a null text or role is empty; an unknown role is kept, opens with its escaped name and breaks
the order; repeated rows are turns of their own; a null conv_id is one conversation; an empty table returns
no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Names of roles in the output, the roles that bear loss, and the transitions of the machine."""

    names: dict[str, str] = field(
        default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
    )
    loss: tuple[str, ...] = ("assistant",)
    opening: str = "### {}: "
    closing: str = " </turn>\n"
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant", "tool"),
        }
    )


#: Control strings and the escapes that stand for them inside a text; a backslash itself is doubled.
ESCAPES = {"###": "\\h", "</turn>": "\\t", ": ": "\\c"}
#: An unknown role opens with this mark and its escaped name.
OTHER = "="


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, safe in ESCAPES.items():
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def unescape(text: Column) -> Column:
    """Doubled backslashes are split off from the left, so what follows a single one is always an escape."""

    def piece(x: Column) -> Column:
        for plain, safe in ESCAPES.items():
            x = F.replace(x, F.lit(safe), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), piece), "\\")


def _opening(role: Column, t: Template) -> Column:
    before, after = t.opening.split("{}")
    names = F.create_map(*[F.lit(x) for kv in t.names.items() for x in kv])
    name = F.coalesce(F.try_element_at(names, role), F.concat(F.lit(OTHER), escape(role)))
    return F.concat(F.lit(before), name, F.lit(after))


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as structs of role and text."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.array_sort(F.collect_list(turn)).alias("turns")
    )


def validate(turns: Column, t: Template) -> Column:
    """Index of the first turn out of order, the number of turns if the end is not one that is accepted, or null."""
    moves = F.create_map(*[F.lit(x) for a, to in t.moves.items() for b in to for x in (f"{a}>{b}", b)])
    state = F.struct(F.lit(t.start).alias("at"), F.lit(0).alias("i"), F.lit(-1).alias("bad"))

    def step(s: Column, turn: Column) -> Column:
        to = F.try_element_at(moves, F.concat(s["at"], F.lit(">"), turn["role"]))
        return F.struct(
            F.coalesce(to, F.lit("error")).alias("at"),
            (s["i"] + 1).alias("i"),
            F.when((s["bad"] < 0) & to.isNull(), s["i"]).otherwise(s["bad"]).alias("bad"),
        )

    def done(s: Column) -> Column:
        return F.when(s["bad"] >= 0, s["bad"]).when(~s["at"].isin(*t.accept), s["i"])

    return F.aggregate(turns, state, step, done)


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, segments, formatted, broken_at): segments are structs (text, loss) whose texts make up formatted."""
    t = template or Template()

    def of_turn(x: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(_opening(x["role"], t), F.lit(False)),
            part(escape(x["text"]), x["role"].isin(*t.loss)),
            part(F.lit(t.closing), F.lit(False)),
        )

    return (
        conversations(rows)
        .select("conv_id", F.flatten(F.transform("turns", of_turn)).alias("segments"), validate(F.col("turns"), t).alias("broken_at"))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns that a formatted conversation holds, as structs of role and text."""
    t = template or Template()
    before, after = t.opening.split("{}")
    roles = F.create_map(*[F.lit(x) for role, name in t.names.items() for x in (name, role)])

    def turn(x: Column) -> Column:
        name = F.substring_index(F.substr(x, F.lit(len(before) + 1)), after, 1)
        role = F.coalesce(F.try_element_at(roles, name), unescape(F.substr(name, F.lit(len(OTHER) + 1))))
        text = unescape(F.substr(x, F.length(name) + len(before) + len(after) + 1))
        return F.struct(role.alias("role"), text.alias("text"))

    pieces = F.split(formatted, r"\Q" + t.closing + r"\E", -1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """What the output says when it is read back: turns, and the text under the loss mask."""
    turns = read_back(F.col("formatted"), template)
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return formatted.select(
        "conv_id", "formatted", "broken_at", turns.alias("turns"), loss.alias("loss")
    ).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("broken_at").isNull().alias("valid_order"),
    )
