"""Chat formatting: a finite-state machine over roles and a declarative template.

The template gives, for each role, the strings that open and close its turns
and whether its text counts for the loss; the machine's transitions say which
role may follow which.  A conversation's turns become segments (text, loss);
marks never count for the loss.  Control strings inside a text are escaped by
a backslash after their first character (one more where backslashes already
stand there), which :func:`read_back` undoes, so formatted text can be cut
into turns again without doubt.

All of it is DataFrame functions on one row per conversation; the rows of a
conversation meet in one aggregate because its formatted text is one string.

Defined results: turns are ordered by turn number (null first), ties by role
and text, repeated rows are turns of their own; a null text is empty; a role
that the template lacks (null is the empty role) is formatted with its name
by ``other`` and is invalid for the machine; conversations with a null id are
one conversation; an empty table has no conversations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, and the machine: transitions[state][role] = next state."""
    roles: dict = field(default_factory=lambda: {
        "system": Turn("[SYS]", "[/SYS]"),
        "user": Turn("[INST]", "[/INST]"),
        "assistant": Turn("<s>", "</s>", loss=True),
    })
    other: Turn = Turn("[ROLE]", "[/TEXT]")
    name_close: str = "[/ROLE][TEXT]"
    start: str = "start"
    transitions: dict = field(default_factory=lambda: {
        "start": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    final: tuple = ("answered",)

    def controls(self) -> list[str]:
        marks = [m for t in (*self.roles.values(), self.other) for m in (t.open, t.close)]
        marks += re.findall(r"\[[^\]]*\]", self.name_close)
        return sorted(set(marks), key=lambda m: (-len(m), m))

    def pattern(self, backslashes: str) -> str:
        """Control strings with ``backslashes`` after their first character."""
        return "|".join(f"{re.escape(m[0])}{backslashes}{re.escape(m[1:])}" for m in self.controls())


def escape(text: Column, t: Template) -> Column:
    heads = "|".join(sorted({re.escape(m[0]) for m in t.controls()}))
    tails = "|".join(re.escape(m[1:]) for m in t.controls())
    return F.regexp_replace(text, f"({heads})(?=\\\\*(?:{tails}))", r"$1\\")


def unescape(text: Column, t: Template) -> Column:
    heads = "|".join(sorted({re.escape(m[0]) for m in t.controls()}))
    tails = "|".join(re.escape(m[1:]) for m in t.controls())
    return F.regexp_replace(text, f"({heads})\\\\(?=\\\\*(?:{tails}))", "$1")


def conversations(rows: DataFrame) -> DataFrame:
    """One row per conv_id: ``turns``, ordered array of (role, text)."""
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
                   F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t")).select(
        "conv_id", F.transform("t", lambda x: F.struct(x["role"], x["text"])).alias("turns"))


def _by_role(role: Column, t: Template, pick, other) -> Column:
    out = None
    for name, turn in t.roles.items():
        out = F.when(role == name, pick(turn)) if out is None else out.when(role == name, pick(turn))
    return out.otherwise(other)


def formatted(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, turns, ``segments`` (text, loss),
    ``formatted`` (the segments' texts in a row), ``state`` and ``valid``."""
    t = template

    def segments(x):
        role, text = x["role"], escape(x["text"], t)
        head = _by_role(role, t, lambda r: F.lit(r.open),
                        F.concat(F.lit(t.other.open), escape(role, t), F.lit(t.name_close)))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(text.alias("text"),
                     _by_role(role, t, lambda r: F.lit(r.loss), F.lit(t.other.loss)).alias("loss")),
            F.struct(_by_role(role, t, lambda r: F.lit(r.close), F.lit(t.other.close)).alias("text"),
                     F.lit(False).alias("loss")))

    def move(state, x):
        out = F.lit("invalid")
        for at, row in t.transitions.items():
            for role, to in row.items():
                out = F.when((state == at) & (x["role"] == role), F.lit(to)).otherwise(out)
        return out

    d = conversations(rows).withColumn("segments", F.flatten(F.transform("turns", segments)))
    return d.withColumns({
        "formatted": F.array_join(F.transform("segments", lambda s: s["text"]), ""),
        "state": F.aggregate("turns", F.lit(t.start), move),
    }).withColumn("valid", F.col("state").isin(*t.final))


def read_back(d: DataFrame, template: Template = Template()) -> DataFrame:
    """``d`` with ``back``: (role, text, loss) of each turn, read from
    ``formatted`` alone."""
    t = template
    whole = F.regexp_extract_all(
        F.col("formatted"),
        F.lit("(?s)(" + "|".join(
            f"{re.escape(x.open)}.*?{re.escape(x.close)}"
            for x in (*t.roles.values(), t.other)) + ")"), F.lit(1))

    def one(piece):
        body = lambda x: F.substring(
            piece, F.lit(len(x.open) + 1), F.length(piece) - len(x.open) - len(x.close))
        cut = F.instr(body(t.other), t.name_close)
        name = F.substring(body(t.other), F.lit(1), cut - 1)
        rest = F.substring(body(t.other), cut + len(t.name_close), F.length(piece))
        out = F.struct(unescape(name, t).alias("role"), unescape(rest, t).alias("text"),
                       F.lit(t.other.loss).alias("loss"))
        for role, x in t.roles.items():
            out = F.when(F.startswith(piece, F.lit(x.open)), F.struct(
                F.lit(role).alias("role"), unescape(body(x), t).alias("text"),
                F.lit(x.loss).alias("loss"))).otherwise(out)
        return out

    return d.withColumn("back", F.transform(whole, one))


#: a conversation whose texts are made of control strings
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def with_probe(spark: SparkSession, rows: DataFrame) -> DataFrame:
    cols = rows.select("conv_id", "turn", "role", "text")
    return cols.unionByName(spark.createDataFrame(
        PROBE, "conv_id long, turn long, role string, text string"))


def report(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of the formatted conversations, read back from the output."""
    d = read_back(formatted(rows, template).select("conv_id", "formatted", "valid"), template)
    turns = F.array_join(F.transform("back", lambda x: F.concat(
        x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("back", lambda x: x["loss"]), lambda x: x["text"]), "")
    return d.withColumn("loss_", loss).select(
        "conv_id", F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.encode(turns, "utf-8"), 256).alias("turns_sha256"),
        F.length("loss_").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_", "utf-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")
