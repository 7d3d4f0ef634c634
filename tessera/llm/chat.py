"""Chat formatting: a finite-state machine over roles and a declarative template.

A template names the marks around a turn, the roles whose text bears loss, and the transitions
between roles.  A conversation becomes segments (text, loss) in turn order and their concatenation.
Control strings inside texts and roles are escaped reversibly: the escape character doubles, and each
control string gets an escape of two characters, so a mark never occurs inside a text.

Null text and null role read as empty; turns are ordered by (turn, role, text), null turns first; rows
that repeat are turns each; a null id is a conversation of its own; a turn order that the machine
doesn't accept is formatted all the same and flagged (``valid`` false, ``bad_turn`` the first turn
that doesn't fit); an empty table gives no rows.  A conversation's text is one string and so one task's
work: the digests asked of it are sequential.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks, escapes, loss roles and the transitions (state, role) -> state."""

    open: str = "### "
    middle: str = ": "
    close: str = "</turn>\n"
    escape: str = "\\"
    controls: tuple[tuple[str, str], ...] = (("###", "\\h"), ("</turn>", "\\e"), (": ", "\\c"))
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    accepting: tuple[str, ...] = ("assistant",)


PLAIN = Template()


def escaped(text: Column, t: Template = PLAIN) -> Column:
    out = F.replace(text, F.lit(t.escape), F.lit(t.escape * 2))
    for control, code in t.controls:
        out = F.replace(out, F.lit(control), F.lit(code))
    return out


def unescaped(text: Column, t: Template = PLAIN) -> Column:
    """The inverse: what stands between doubled escapes has only codes, which are replaced."""

    def part(x: Column) -> Column:
        for control, code in t.controls:
            x = F.replace(x, F.lit(code), F.lit(control))
        return x

    return F.array_join(F.transform(F.split(text, r"\Q" + t.escape * 2 + r"\E", -1), part), t.escape)


def machine(roles: Column, t: Template = PLAIN) -> Column:
    """struct(state, bad): the state after all roles, and the place of the first that doesn't fit (else -1)."""
    table = F.create_map(*[F.lit(x) for (state, role), to in t.transitions.items() for x in (f"{state}\n{role}", to)])

    def step(a: Column, x: Column) -> Column:
        to = F.try_element_at(table, F.concat(a["state"], F.lit("\n"), x))
        return F.struct(
            F.coalesce(to, F.lit("dead")).alias("state"),
            (a["at"] + 1).alias("at"),
            F.when((a["bad"] < 0) & to.isNull(), a["at"]).otherwise(a["bad"]).alias("bad"),
        )

    return F.aggregate(roles, F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad")), step)


def format_conversations(rows: DataFrame, t: Template = PLAIN) -> DataFrame:
    """conv_id, n_turns, segments array<struct<text, loss>>, formatted, valid, bad_turn."""
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                F.struct(F.concat(F.lit(t.open), escaped(x["role"], t), F.lit(t.middle)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escaped(x["text"], t).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
                F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    out = turns.withColumn("segments", segments).withColumn("end", machine(F.transform("turns", lambda x: x["role"]), t))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        "segments",
        F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"),
        ((F.col("end.bad") < 0) & F.col("end.state").isin(*t.accepting)).alias("valid"),
        F.col("end.bad").alias("bad_turn"),
    )


def read_back(formatted: Column, t: Template = PLAIN) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.split(formatted, r"\Q" + t.close + r"\E", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(x: Column) -> Column:
        body = F.substring(x, F.lit(len(t.open) + 1), F.length(x))
        cut = F.instr(body, t.middle)
        return F.struct(
            unescaped(F.substring(body, F.lit(1), cut - 1), t).alias("role"),
            unescaped(F.substring(body, cut + len(t.middle), F.length(body)), t).alias("text"),
        )

    return F.transform(parts, turn)


def loss_text(segments: Column, t: Template = PLAIN) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda x: x["loss"]), lambda x: unescaped(x["text"], t)), "")
