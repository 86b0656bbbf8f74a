"""Chat formatting: a finite-state machine over roles, and a declarative template that emits text segments with loss flags.

The template is data: what stands before, between and after the role and the
text of a turn, and which roles are trained on. Control strings inside a role
or a text are broken by the escape character, so that the control strings of a
formatted conversation are exactly those of its template; ``unescape`` undoes
that. The machine is data too: a start state, its transitions by (state, role)
and the accepting states; its run over a conversation tells whether the turn
order is valid and, if not, at which turn it broke. Invalid conversations are
formatted all the same and flagged.

All steps are DataFrame functions. A conversation is one row of the result, so
its turns meet in one task; nothing larger does.

Defined cases: null text counts as empty, null role as the empty role (no
transition: invalid); turns are ordered by turn (nulls first), then role, then
text, so ties and repeated rows have one order and each is formatted; a null
conversation id is a conversation of its own; an empty table gives an empty
result; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    start: str = "<|start|>"
    message: str = "<|message|>"
    end: str = "<|end|>"
    #: Roles whose text is trained on.
    loss_roles: tuple[str, ...] = ("assistant",)
    #: Control strings of other formats that texts must not smuggle in either.
    foreign: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.start, self.message, self.end, *self.foreign)


@dataclass(frozen=True)
class Machine:
    start: str = "begin"
    transitions: tuple[tuple[str, str, str], ...] = (
        ("begin", "system", "system"),
        ("begin", "user", "user"),
        ("system", "user", "user"),
        ("user", "assistant", "assistant"),
        ("assistant", "user", "user"),
    )
    accepting: tuple[str, ...] = ("assistant",)


ESCAPE = "\\"
TEMPLATE, MACHINE = Template(), Machine()


def _quoted(s: str) -> str:
    return "".join(c if c.isalnum() or c in "_ </>" else "\\" + c for c in s)


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    """``text`` with escape characters doubled and one put after the first character of each control string."""
    firsts = sorted({c[0] for c in template.controls})
    patterns = [f"{_quoted(first)}(?={'|'.join(_quoted(c[1:]) for c in template.controls if c[0] == first)})" for first in firsts]
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), "(" + "|".join(patterns) + ")", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def format_chats(turns: DataFrame, template: Template = TEMPLATE, machine: Machine = MACHINE) -> DataFrame:
    """One row for each conversation: conv_id, segments (array of struct text, loss), formatted, state, valid, broken_at.

    ``formatted`` is the segments' text in order. ``broken_at`` is the place
    (from 0) of the first turn without a transition, or null; ``valid`` needs
    none of those and an accepting state at the end.
    """
    rows = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    df = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    table = F.create_map(*(F.lit(x) for a, role, b in machine.transitions for x in (f"{a}\n{role}", b)))
    zero = F.struct(F.lit(machine.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("broken"))

    def step(s, t):
        to = F.element_at(table, F.concat(s["state"], F.lit("\n"), t["role"]))
        # A break is kept; the machine goes on from the start, as far as it can.
        return F.struct(F.coalesce(to, F.lit(machine.start)).alias("state"), (s["at"] + 1).alias("at"), F.coalesce(s["broken"], F.when(to.isNull(), s["at"])).alias("broken"))

    df = df.withColumn("run", F.aggregate("turns", zero, step))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                part(F.concat(F.lit(template.start), escape(t["role"], template), F.lit(template.message)), F.lit(False)),
                part(escape(t["text"], template), t["role"].isin(*template.loss_roles)),
                part(F.lit(template.end), F.lit(False)),
            ),
        )
    )
    df = df.withColumn("segments", segments)
    return df.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.col("run.state").alias("state"),
        (F.col("run.broken").isNull() & F.col("run.state").isin(*machine.accepting)).alias("valid"),
        F.col("run.broken").alias("broken_at"),
    )


def read_back(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns of a formatted conversation, as array of struct (role, text), unescaped."""
    parts = F.split(formatted, _quoted(template.start), -1)  # nothing stands before the first turn
    bodies = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(body):
        halves = F.split(body, _quoted(template.message), 2)
        text = F.get(halves, 1)
        return F.struct(unescape(F.get(halves, 0)).alias("role"), unescape(F.substring(text, F.lit(1), F.length(text) - len(template.end))).alias("text"))

    return F.transform(bodies, turn)
