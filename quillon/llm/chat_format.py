"""Chat formatting of records in many layouts.

A record's layout is known by its schema fingerprint: the XXH64 of its sorted
nested field paths, those that the record fills.  The fingerprint picks a
declarative mapping, which says where the turns are: a list of messages with a
field for the role and one for the text, or single fields that are turns of a
fixed role (prompt and completion, instruction with input and output).  Mapped
records become canonical turns; a template writes those as one text together with
a loss mask, runs of characters to be learned; :func:`read_back` undoes it.

Escaping.  Markers are ``<|im_start|>`` and ``<|im_end|>``.  Inside a text any
``<``, backslashes, ``|`` gets one backslash more, so ``<|`` occurs in the output
only where the template wrote it; reading removes one again.  In a role ``%``,
``<`` and line ends are percent-encoded.

Scale.  All is a projection over records: no shuffle beyond the grouping that
makes records of rows, whose key is the conversation.  A conversation is one
value and has to fit in memory, as its digest runs over all of it.  Positions are
running sums by doubling steps, and reading cuts the text once at its end marks, so work
grows with a conversation's turns times their logarithm.

Cases.  A null text or role is empty.  Rows of a conversation are ordered by turn
(null first), then role and text; repeated rows are repeated turns.  A null
conversation id is a conversation of its own.  A record without turns formats to
an empty text; a layout without a mapping is an error that names its paths, never
a dropped record.  An empty table gives an empty result.  Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.similarity import let

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}


@dataclass(frozen=True)
class Messages:
    """Turns in the array at ``path``, whose elements have ``role`` and ``text`` fields."""

    path: str
    role: str = "role"
    text: str = "content"
    rename: Mapping[str, str] = field(default_factory=dict)

    def paths(self) -> list[str]:
        return [f"{self.path}[].{self.role}", f"{self.path}[].{self.text}"]

    def turns(self) -> Column:
        def role(r: Column) -> Column:
            out = F.coalesce(r, F.lit(""))
            for old, new in self.rename.items():
                out = F.when(r == old, new).otherwise(out)
            return out

        return F.transform(
            F.col(self.path), lambda m: F.struct(role(m[self.role]).alias("role"), F.coalesce(m[self.text], F.lit("")).alias("text"))
        )


@dataclass(frozen=True)
class Fields:
    """Turns in single fields: pairs of a role and the fields that make up its text, joined by a blank line."""

    parts: tuple[tuple[str, tuple[str, ...]], ...]

    def paths(self) -> list[str]:
        return [f for _, fields in self.parts for f in fields]

    def turns(self) -> Column:
        text = lambda fields: F.concat_ws("\n\n", *[F.col(f) for f in fields])
        return F.array(*[F.struct(F.lit(role).alias("role"), text(fields).alias("text")) for role, fields in self.parts])


#: The layouts known without further ado.
MAPPINGS: tuple[Messages | Fields, ...] = (
    Messages("messages"),
    Messages("conversations", "from", "value", ROLES),
    Fields((("user", ("prompt",)), ("assistant", ("completion",)))),
    Fields((("user", ("prompt",)), ("assistant", ("response",)))),
    Fields((("user", ("instruction",)), ("assistant", ("output",)))),
    Fields((("user", ("instruction", "input")), ("assistant", ("output",)))),
    Fields((("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
)


def _paths(kind: T.DataType, name: str, at: Column) -> list[tuple[str, Column]]:
    """Leaf paths below a column, each with the condition that a record fills it."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in _paths(f.dataType, f"{name}.{f.name}", at[f.name])]
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return [(p, at.isNotNull()) for f in kind.elementType for p, _ in _paths(f.dataType, f"{name}[].{f.name}", F.lit(None))]
    return [(f"{name}[]" if isinstance(kind, T.ArrayType) else name, at.isNotNull())]


def _hash(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(paths), "\n"))


def fingerprint(records: DataFrame, fields: Sequence[str]) -> Column:
    """Hash of the nested field paths that a record fills, among the columns ``fields``."""
    found = [p for f in records.schema if f.name in fields for p in _paths(f.dataType, f.name, F.col(f.name))]
    return _hash(F.array_compact(F.array(*[F.when(there, F.lit(path)) for path, there in found])))


def canonical_turns(records: DataFrame, fields: Sequence[str], mappings: Sequence[Messages | Fields] = MAPPINGS) -> DataFrame:
    """Add ``layout`` (the fingerprint) and ``turns``; the mapping is chosen by the fingerprint."""
    usable = [m for m in mappings if {p.split("[")[0].split(".")[0] for p in m.paths()} <= set(fields)]
    layout = F.col("layout")
    turns = F.when(layout == _hash(F.array().cast("array<string>")), F.array().cast(TURNS))
    for m in usable:
        turns = turns.when(layout == _hash(F.array(*[F.lit(p) for p in m.paths()])), m.turns().cast(TURNS))
    unknown = F.raise_error(F.concat(F.lit("no mapping for the layout with fingerprint "), layout.cast("string"))).cast(TURNS)
    return records.withColumn("layout", fingerprint(records, fields)).withColumn("turns", turns.otherwise(unknown))


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    for raw, code in (("%", "%25"), ("<", "%3C"), ("\n", "%0A")):
        role = F.replace(role, F.lit(raw), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for raw, code in (("\n", "%0A"), ("<", "%3C"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(raw))
    return role


def running_sums(sizes: Column) -> Column:
    """For each entry of an array of longs, the sum of the entries before it."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(sizes), F.lit(2)))).cast("int"))

    def double(sums: Column, step: Column) -> Column:
        far = F.pow(F.lit(2), step).cast("int")
        return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - far), F.lit(0).cast("long")))

    shifted = lambda xs: F.transform(xs, lambda x, i: F.coalesce(F.get(xs, i - 1), F.lit(0).cast("long")))
    return F.aggregate(rounds, let(sizes, shifted), double)


def write_template(records: DataFrame, learn: str = "assistant") -> DataFrame:
    """Add ``formatted`` and ``loss_mask``: spans (turn, start, length) of the texts of role ``learn``.

    ``start`` and ``length`` are characters of ``formatted``; ``turn`` is the place of the turn.
    """
    head = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    pieces = F.transform(
        F.col("turns"), lambda t: F.struct(head(t).alias("head"), escape_text(t["text"]).alias("body"), (t["role"] == learn).alias("learn"))
    )
    whole = lambda ps: F.array_join(F.transform(ps, lambda p: F.concat(p["head"], p["body"], F.lit(f"{END}\n"))), "")
    sizes = lambda ps: F.transform(ps, lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(END) + 1).cast("long"))

    def span(p: Column, i: Column, starts: Column) -> Column:
        start = F.get(starts, i) + F.length(p["head"])
        return F.when(p["learn"], F.struct(i.alias("turn"), start.alias("start"), F.length(p["body"]).cast("long").alias("length")))

    # positions are bound once: as a column of its own the optimizer would work them out again for every turn
    mask = lambda ps: let(running_sums(sizes(ps)), lambda starts: F.array_compact(F.transform(ps, lambda p, i: span(p, i, starts))))
    return records.withColumns({"formatted": whole(pieces), "loss_mask": let(pieces, mask)})


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``read_turns`` and ``read_loss`` (the learned texts), from ``formatted`` and ``loss_mask`` alone."""
    cut = F.filter(F.split(F.col("formatted"), r"<\|im_end\|>\n"), lambda x: x != "")
    body = lambda x: F.substring(x, len(START) + 1, 2147483647)
    role = lambda x: F.substring_index(body(x), "\n", 1)
    turns = F.transform(
        cut,
        lambda x: F.struct(
            unescape_role(role(x)).alias("role"),
            unescape_text(F.substr(x, F.length(role(x)) + len(START) + 2)).alias("text"),
        ),
    )
    sizes = lambda cs: F.transform(cs, lambda x: (F.length(x) + len(END) + 1).cast("long"))

    def learned(s: Column, cs: Column, begins: Column) -> Column:
        at = (s["start"] - F.get(begins, s["turn"]) + 1).cast("int")
        return unescape_text(F.substr(F.get(cs, s["turn"]), at, s["length"].cast("int")))

    spans = lambda mask, cs: let(running_sums(sizes(cs)), lambda begins: F.transform(mask, lambda s: learned(s, cs, begins)))
    loss = let(F.struct(cut.alias("cut"), F.col("loss_mask").alias("mask")), lambda x: F.array_join(spans(x["mask"], x["cut"]), ""))
    return formatted.withColumns({"read_turns": turns, "read_loss": loss})


def conversations_as_records(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of turns as records of the layout ``messages``."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("content"))
    grouped = rows.groupBy(id).agg(F.array_sort(F.collect_list(one)).alias("__m"))
    return grouped.select(id, F.transform("__m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def digest(rows: DataFrame, id: str = "conv_id") -> DataFrame:
    """Format conversations and return what reading them back finds."""
    records = canonical_turns(conversations_as_records(rows, id), ["messages"])
    back = read_back(write_template(records))
    said = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        id,
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("read_loss").cast("long").alias("loss_chars"),
        F.sha2("read_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
