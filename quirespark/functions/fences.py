"""Code fences as columns: which stretches of lines are fenced, by a fold over the lines that begin or end one.

A line is a step between three states: outside, in a fence of backticks, in one of tildes. Lines without a mark leave every
state as it is, so only marks are folded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirespark.functions.text import let, ltrim

#: The marks that open and close a fence.
MARKS = ("```", "~~~")


def fence_kind(line: Column) -> Column:
    """The mark that a line begins with, else an empty string."""
    body = ltrim(line)
    return F.when(body.startswith(MARKS[0]), MARKS[0]).when(body.startswith(MARKS[1]), MARKS[1]).otherwise("")


def fenced(lines: Column, replaces: bool = False) -> Column:
    """The stretches (start, stop) of an array of lines that are in a fence, from the line that opens it to before the one
    that closes it. A fence is closed by its own kind; the other kind inside it is text, or, with ``replaces``, takes its place."""
    marks = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), fence_kind(x).alias("kind"))), lambda m: m["kind"] != "")
    none = F.array().cast("array<struct<start:int,stop:int>>")
    start = F.struct(F.lit("").alias("kind"), F.lit(-1).alias("at"), none.alias("out"))

    def step(s: Column, m: Column) -> Column:
        closes = s["kind"] == m["kind"]
        opens = ~closes & ((s["kind"] == "") | F.lit(replaces))
        kind = F.when(closes, F.lit("")).when(opens, m["kind"]).otherwise(s["kind"])
        ended = F.when(closes, F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), m["i"].alias("stop"))))).otherwise(s["out"])
        return F.struct(kind.alias("kind"), F.when(opens & (s["kind"] == ""), m["i"]).otherwise(s["at"]).alias("at"), ended.alias("out"))

    last = lambda s: F.when(s["kind"] != "", F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), F.size(lines).alias("stop"))))).otherwise(s["out"])
    return F.aggregate(marks, start, step, last)


def heading_level(line: Column) -> Column:
    """The level of a heading of marks, which at most three spaces indent and white space follows; 0 for other lines."""
    body = ltrim(line)

    def level(rest: Column) -> Column:
        n = F.length(body) - F.length(rest)
        return F.when((F.length(line) - F.length(body) <= 3) & n.between(1, 6) & (ltrim(rest) != rest), n).otherwise(F.lit(0))

    return let(ltrim(body, "#"), level)


def marked_headings(lines: Column) -> Column:
    """(line_index, level) of the headings of marks outside fences."""

    def outside(stretches: Column) -> Column:
        every = F.transform(lines, lambda x, i: F.struct(i.alias("line_index"), heading_level(x).alias("level")))
        return F.filter(F.filter(every, lambda h: h["level"] > 0), lambda h: ~F.exists(stretches, lambda s: (s["start"] <= h["line_index"]) & (h["line_index"] < s["stop"])))

    return let(fenced(lines), outside)
