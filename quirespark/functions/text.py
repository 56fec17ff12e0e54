"""Column forms of the string operations that Markdown work needs, with Unicode white space.

Java's ``\\s`` and ``\\d`` are ASCII and its ``.`` stops at more than \\n, so patterns here start with ``(?U)`` or
``(?d)`` where that matters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends, as text files have them: \r\n is one.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


#: What counts as white space, for functions that trim sets of characters.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def ltrim(c: Column, chars: str = WHITE) -> Column:
    return F.ltrim(c, F.lit(chars))


def rtrim(c: Column, chars: str = WHITE) -> Column:
    return F.rtrim(c, F.lit(chars))


def after(c: Column, n: Column | int) -> Column:
    """``c`` without its first ``n`` characters."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.substring(c, n + 1, F.length(c))


def led(c: Column, rest: Column) -> Column:
    """What ``c`` has before ``rest``, which it ends with."""
    return F.substring(c, F.lit(1), F.length(c) - F.length(rest))


def less(c: Column, char: str, most: int) -> Column:
    """``c`` without up to ``most`` of a character at its start."""
    return F.regexp_replace(c, f"^[{char}]{{1,{most}}}", "")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once even where ``body`` is a lambda over an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(c: Column) -> Column:
    """The lines of a text; an end of line at the end begins no further line, and an empty text has none."""
    parts = F.split(F.coalesce(c, F.lit("")), LINE_END)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def unlines(c: Column) -> Column:
    return F.array_join(c, "\n")


def each_line(c: Column, body: Callable[[Column], Column], keep_end: bool = False) -> Column:
    """``body`` of every line, joined by \\n; the last line's end is kept if asked for."""
    out = unlines(F.transform(lines(c), body))
    return F.concat(out, F.when(c.endswith("\n"), F.lit("\n")).otherwise(F.lit(""))) if keep_end else out


def tokens(c: Column) -> Column:
    """Lower-cased runs between white space, punctuation kept."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+"), lambda t: t != "")


def count(c: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


def occurrences(c: Column, part: str) -> Column:
    """How often ``part`` stands in ``c``, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def chunk_id(source: Column, text: Column) -> Column:
    """``chunk_`` and twelve hex digits of the digest of the source and the first 120 characters."""
    return F.concat(F.lit("chunk_"), F.substring(F.md5(F.concat(source, F.lit("::"), F.substring(text, 1, 120))), 1, 12))


def indexed_id(source: Column, index: Column) -> Column:
    """``c``, four hex digits of the source's digest and the index in base 36. Short: never a key by itself."""
    return F.concat(F.lit("c"), F.substring(F.md5(source), 1, 4), F.lower(F.conv(index, 10, 36)))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def first_words(c: Column, most: int) -> Column:
    """(text, count, truncated): at most ``most`` words; a text within the limit stays as it is."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda t: t != "")
    return let(
        words,
        lambda w: F.struct(
            F.when(F.size(w) > most, F.array_join(F.slice(w, 1, most), " ")).otherwise(F.coalesce(c, F.lit(""))).alias("text"),
            F.least(F.size(w), F.lit(most)).alias("count"),
            (F.size(w) > most).alias("truncated"),
        ),
    )


def without_controls(c: Column) -> Column:
    """What a spreadsheet cell may hold."""
    return F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")


def path_part(c: Column, most: int = 160) -> Column:
    """A safe file name: runs of characters other than letters, digits and ``._()- +`` become ``_``."""
    clean = strip(F.regexp_replace(F.regexp_replace(strip(c), r"[^A-Za-z0-9._()\- +]+", "_"), r"\s+", " "))
    short = F.regexp_replace(F.substring(clean, 1, most), r"\s+$", "")
    return F.when(short == "", F.lit("untitled")).otherwise(short)
