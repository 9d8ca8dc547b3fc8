"""Chat formatting from a declarative template, in DataFrame expressions only.

A finite-state machine runs over the roles of a conversation and tells whether every turn may follow the one before.
Every turn gives three segments (head, text, close), each with a loss flag; the formatted text is their concatenation and the
mask lists length and flag per segment. Inside texts a backslash is doubled and control strings are broken by
a backslash, so the close mark never occurs in a text and formatting is reversible (``read_back``).

Defined results: null text is empty text, null role is the empty role; turns with equal numbers are ordered by role,
then text, nulls first; repeated rows are turns of their own; rows without conv_id form one conversation; roles unknown to the
template are written as hex and make the conversation invalid; invalid conversations are formatted all the same. An
empty table gives an empty table. A conversation is one value, so its rows meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks, labels by role, roles under the loss, and the roles that may follow each state ('' is the start)."""

    open: str = "### "
    label_end: str = ": "
    close: str = "</turn>"
    between: str = "\n"
    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"})
    loss: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)}
    )

    def __post_init__(self) -> None:
        if self.close[0] in self.close[1:] or "\\" in self.open + self.close or any(self.label_end in x or x[:1] == "=" for x in self.labels.values()):
            raise ValueError("marks must not overlap themselves, hold a backslash, or occur in labels")


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def escape(text: Column, t: Template) -> Column:
    """Double backslashes, then break control strings behind (close) or before (open) their first character."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit(t.close), F.lit(f"{t.close[0]}\\{t.close[1:]}"))
    return F.replace(out, F.lit(t.open), F.lit(f"\\{t.open}"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(rows: DataFrame, t: Template = Template()) -> DataFrame:
    """One row per conversation: formatted text, mask (length and loss of every segment) and validity of the turn order."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("turns"))
    labels = literal_map(t.labels)
    step = literal_map({f"{state}>{r}": r for state, roles in t.follows.items() for r in roles})

    def segments(x: Column) -> Column:
        label = F.coalesce(F.try_element_at(labels, x["role"]), F.concat(F.lit("="), F.hex(x["role"].cast("binary"))))
        parts = ((F.concat(F.lit(t.open), label, F.lit(t.label_end)), F.lit(False)), (escape(x["text"], t), x["role"].isin(*t.loss)), (F.lit(t.close + t.between), F.lit(False)))
        return F.array(*[F.struct(s.alias("text"), flag.alias("loss")) for s, flag in parts])

    def follow(state: Column, x: Column) -> Column:
        return F.coalesce(F.try_element_at(step, F.concat(state, F.lit(">"), x["role"])), F.lit("!"))

    cut = turns.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), (F.aggregate("turns", F.lit(""), follow) != "!").alias("valid"))
    return cut.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.transform("segments", lambda s: F.struct(F.length(s["text"]).alias("length"), s["loss"].alias("loss"))).alias("mask"),
        "valid",
    )


def read_back(formatted: DataFrame, t: Template = Template()) -> DataFrame:
    """Add ``turns`` (role and text of each) and ``learned`` (texts under the mask), both taken from the formatted text."""
    roles = literal_map({v: k for k, v in t.labels.items()})
    parts = F.split(F.col("formatted"), "\\Q" + t.close + t.between + "\\E", -1)
    kept = formatted.withColumn("parts", F.slice(parts, 1, F.size(parts) - 1))

    def turn(p: Column) -> Column:
        label = F.substring_index(F.substring(p, len(t.open) + 1, 1 << 30), t.label_end, 1)
        role = F.coalesce(F.try_element_at(roles, label), F.decode(F.unhex(F.substring(label, 2, 1 << 30)), "utf-8"))
        body = F.substr(p, F.length(label) + len(t.open) + len(t.label_end) + 1)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    def under_mask(p: Column, i: Column) -> Column:
        head, body = F.get("mask", 3 * i), F.get("mask", 3 * i + 1)
        return F.when(body["loss"], F.substr(p, head["length"] + 1, body["length"]))

    learned = F.transform(F.filter(F.transform("parts", under_mask), lambda x: x.isNotNull()), unescape)
    return kept.select("conv_id", "formatted", "mask", "valid", F.transform("parts", turn).alias("turns"), learned.alias("learned"))


def digests(rows: DataFrame, t: Template = Template()) -> DataFrame:
    """Per conversation, read back from its formatted text."""
    back = read_back(format_chats(rows, t), t)
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
