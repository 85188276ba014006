"""Conversations in reply order, from quotations, with DataFrame functions only.

A line's quote level is the number of ``>`` marks it starts with (blanks between them
are ignored). A run of lines of one level of 1 or more is a quoted passage. Passages, and each
of their lines, are normalised (lower case, runs of white space as one blank, trimmed)
and hashed, as are a passage's sentences; so are the lines, the sentences, the paragraphs and
the whole of every message's own text (its lines of level 0). A sentence ends at an end mark
before white space or at a blank line, and may run over line breaks. A hash belongs to the
first turn of its conversation that has it as own text. The hashes join quoted passages to the original messages before
them: a message replies to the original of its passage of least level, whole passages
before single lines, lines before sentences, later turns first. Without a match it replies to none.

Reply order sorts a conversation by ``reply_path``: the turns from the first message of
the thread down to the message, each as 10 digits. A longer turn is ``a`` and 19 digits, a
negative one ``-`` and 19 digits of its distance from the least long, so that text order is the
order of turns, negative ones first. Turns are whole numbers. Paths double their length in each
round, so threads of depth d take log2(d) rounds.

Only conversations with a quotation take part in the joins. Own texts are combined
to one row per conversation and hash before the join, so frequent lines and long
conversations make no pairs; no conversation is gathered in one place.

Null texts are empty. Messages with a null conversation or turn reply to none. Rows with
the same conversation and turn are one message for linking (any of them may match), and
all are kept. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.staging import sized, staged

#: Digits of a turn in ``reply_path``; negative and longer ones have a mark and the digits of a long.
TURN_DIGITS, LONG_DIGITS = 10, 19

_MARKS = r"^\s*>(\s*>)*"

#: Between sentences: a blank line, or white space after an end mark and what closes behind it.
_BREAKS = r"\n\s*\n|(?<=[.!?…][\"'’”)\]»]{0,3})\s+|(?<=[。！？])"


def _normal(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, _MARKS, 0)
    return F.char_length(marks) - F.char_length(F.replace(marks, F.lit(">"), F.lit("")))


def _lines(text: Column) -> Column:
    """Array of (level, content) of a text's lines."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    return F.transform(lines, lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, _MARKS + r"\s?", "").alias("content")))


def _passages(lines: Column) -> Column:
    """Runs of lines of one level, as (level, contents); ``lines`` must be a stored column."""
    start = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))
    ends = F.concat(F.slice(start, 2, F.size(start)), F.array(F.size(lines)))
    return F.transform(
        F.arrays_zip(start.alias("a"), ends.alias("z")),
        lambda r: F.struct(F.get(lines, r["a"])["level"].alias("level"), F.transform(F.slice(lines, r["a"] + 1, r["z"] - r["a"]), lambda x: x["content"]).alias("contents")),
    )


def own_text(text: Column) -> Column:
    """A text without its quoted lines, trimmed."""
    kept = F.filter(_lines(text), lambda x: x["level"] == 0)
    return F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["content"]), "\n"), r"^\s+|\s+$", "")


def _keys(pieces: Column) -> Column:
    """Hashes of the normalised pieces that have any letter or digit."""
    return F.transform(F.filter(F.transform(pieces, _normal), lambda x: x.rlike(r"[\p{L}\p{N}]")), lambda x: F.xxhash64(x))


def links(messages: DataFrame) -> DataFrame:
    """(conv, turn, parent): the turn that each quoting message replies to; input (conv, turn, text)."""
    quoting = messages.filter(F.col("text").rlike("(?m)" + _MARKS) & F.col("conv").isNotNull() & F.col("turn").isNotNull())
    quoting = staged(quoting.select("conv", "turn", _lines(F.col("text")).alias("lines")), "quoting-lines")
    runs = quoting.select("conv", "turn", F.explode(_passages(F.col("lines"))).alias("run")).filter("run.level > 0")
    contents = F.col("run.contents")
    wanted = F.concat(
        F.transform(_keys(F.array(F.array_join(contents, " "))), lambda k: F.struct(F.lit(0).alias("rank"), k.alias("key"))),
        F.transform(_keys(contents), lambda k: F.struct(F.lit(1).alias("rank"), k.alias("key"))),
        F.transform(_keys(F.split(F.array_join(contents, "\n"), _BREAKS)), lambda k: F.struct(F.lit(2).alias("rank"), k.alias("key"))),
    )
    quoted = runs.select("conv", "turn", F.col("run.level").alias("level"), F.explode(wanted).alias("w"))
    quoted = staged(quoted.select("conv", "turn", "level", "w.rank", "w.key").distinct(), "quoted")
    convs = sized(staged(quoted.select("conv").distinct(), "quoting"))
    text = own_text(F.col("text"))
    pieces = F.concat(F.array(text), F.split(text, r"\n\s*\n"), F.split(text, r"\n"), F.split(text, _BREAKS))
    own = messages.filter("turn is not null").join(convs, "conv", "left_semi").select("conv", "turn", F.explode(F.array_distinct(_keys(pieces))).alias("key"))
    first = own.groupBy("conv", "key").agg(F.min("turn").alias("origin"))
    met = quoted.join(first, ["conv", "key"]).filter("origin < turn")
    best = F.min_by("origin", F.struct("level", "rank", -F.col("origin")))
    return met.groupBy("conv", "turn").agg(best.alias("parent"))


def _pad(turn: Column) -> Column:
    turn = turn.cast("bigint")
    digits = lambda c, n: F.lpad(c.cast("string"), n, "0")
    below = F.concat(F.lit("-"), digits(turn.bitwiseAND(F.lit(2**63 - 1)), LONG_DIGITS))
    above = F.concat(F.lit("a"), digits(turn, LONG_DIGITS))
    return F.when(turn < 0, below).when(turn >= 10**TURN_DIGITS, above).otherwise(digits(turn, TURN_DIGITS))


def paths(parents: DataFrame) -> DataFrame:
    """(conv, turn, root, depth, path) for linked messages, by doubling."""
    now = staged(parents.select("conv", "turn", F.col("parent").alias("up"), F.lit(1).alias("depth"), _pad(F.col("turn")).alias("path")), "paths")
    while True:
        above = now.select("conv", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("path").alias("head"))
        joined = now.join(above, ["conv", "up"], "left")
        new = joined.select(
            "conv",
            "turn",
            F.coalesce("next", "up").alias("up"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.concat_ws(".", "head", "path").alias("path"),
            F.col("next").isNotNull().alias("moved"),
        )
        new = staged(new, "paths")
        if new.filter("moved").isEmpty():
            return new.select("conv", "turn", F.col("up").alias("root"), "depth", F.concat_ws(".", _pad(F.col("up")), "path").alias("path"))
        now = new.drop("moved")


def reply_order(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: its columns, ``reply_to``, ``depth``, ``reply_path``, ``own_text`` and ``formatted``.

    ``formatted`` is the message without quotations as a chat line: role mark, newline, text.
    """
    base = messages.select(messages[conv_col].alias("conv"), messages[turn_col].alias("turn"), messages[role_col].alias("role"), messages[text_col].alias("text"))
    parents = staged(links(base), "parents")
    placed = paths(parents).join(parents, ["conv", "turn"]).select(F.col("conv").alias("c"), F.col("turn").alias("t"), "parent", "depth", "path")
    placed = staged(placed, "placed")
    out = base.join(placed, (F.col("conv") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    text = own_text(F.col("text"))
    return out.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        F.col("role").alias(role_col),
        F.col("parent").alias("reply_to"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("path", _pad(F.col("turn"))).alias("reply_path"),
        text.alias("own_text"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), text).alias("formatted"),
    )
