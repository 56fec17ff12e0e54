"""Sequential scans over Markdown, one document at a time, as Arrow-batched UDFs.

Only what needs state from line to line is here: fences, equations, tables, splitting. The pure functions are
what tests call; each ``*_udf`` wraps one of them.
"""

from __future__ import annotations

import re
from collections import deque
from functools import cache
from itertools import chain, groupby, repeat, zip_longest

import pandas as pd
from pyspark.sql import functions as F


def fence_kind(line: str) -> str:
    """The character of a code fence that the line begins with, else an empty string."""
    mark = line.lstrip()[:3]
    return mark[0] if mark in ("```", "~~~") else ""


class Fence:
    """Whether a line is inside a code fence. A fence is closed by its own kind; the other kind inside it is text,
    or, with ``replaces``, takes its place."""

    def __init__(self, replaces: bool = False):
        self.kind, self.replaces = "", replaces

    def inside(self, line: str) -> bool:
        kind = fence_kind(line)
        if kind and kind == self.kind:
            self.kind = ""
        elif kind and (self.replaces or not self.kind):
            self.kind = kind
        return bool(self.kind)


# Headings ------------------------------------------------------------------------------------------------------------

#: Marks that may follow the number of a heading; the first two also make list items.
LISTING, MARKS = ".)", ".):-"


def _hashed(line: str) -> tuple[int, str] | None:
    """Level and title of a line marked by #."""
    body = line.lstrip()
    title = body.lstrip("#")
    level = len(body) - len(title)
    if len(line) - len(body) <= 3 and 1 <= level <= 6 and title[:1].isspace():
        return level, title.strip().rstrip("#").strip()
    return None


def _underline(line: str) -> int:
    """The level that a line gives to the one above it, if it is all = or all -; else 0."""
    kinds = set(line.strip())
    return {"=": 1, "-": 2}[kinds.pop()] if kinds in ({"="}, {"-"}) else 0


def _numbered(line: str) -> tuple[int, bool] | None:
    """Depth of the number that a line begins with, and whether it could be a list item."""
    body = line.lstrip()
    number, *title = body.split(None, 1)[:2] if body else ("",)
    if len(line) - len(body) > 3 or not title:
        return None
    mark = number[-1] if number[-1] in MARKS else ""
    parts = number[: len(number) - len(mark)].split(".")
    if not all(x.isdecimal() for x in parts):
        return None
    return len(parts), len(parts) == 1 and mark != "" and mark in LISTING


def headings(text: str | None, levels: bool = True) -> list[dict]:
    """ATX, setext and numbered headings outside fences, as (line_index, level, text).

    A line that begins with a bare number and a dot or bracket is a list item unless blank lines surround it;
    without ``levels`` that is not looked at.
    """
    rows = (text or "").splitlines()
    blank = [*(not x.strip() for x in rows), True]  # also for what is above the first line
    out, fence, used = [], Fence(), -1
    for i, line in enumerate(rows):
        if fence.inside(line) or i == used:
            continue
        if found := _hashed(line):
            level, title = found
        elif not blank[i] and i + 1 < len(rows) and (level := _underline(rows[i + 1])):
            title, used = line.strip(), i + 1
        elif found := _numbered(line):
            if levels and found[1] and not (blank[i - 1] and blank[i + 1]):
                continue
            level, title = min(6, found[0]), line.strip()
        else:
            continue
        out.append({"line_index": i, "level": level, "text": title})
    return out


@cache
def headings_udf(levels: bool = True):
    return _column(lambda t: headings(t, levels), "array<struct<line_index:int,level:int,text:string>>")


def _column(kernel, kind: str):
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(kernel)

    return run


def stretches(text: str | None) -> list[dict]:
    """(heading, level, text) of what stands before the first heading, if anything, and of each section."""
    rows = (text or "").splitlines(keepends=True)
    found = headings(text)
    cuts = [h["line_index"] for h in found]
    heads = [None] * (not cuts or cuts[0] > 0) + found
    edges = [0] * (not cuts or cuts[0] > 0) + cuts + [len(rows)]
    parts = zip(heads, edges, edges[1:], strict=False)
    return [{"heading": h and h["text"], "level": h and h["level"], "text": "".join(rows[a:z])} for h, a, z in parts if z > a]


@cache
def stretches_udf():
    return _column(stretches, "array<struct<heading:string,level:int,text:string>>")


def levelled(text: str, level: int | None) -> str:
    """``text`` with its marked headings moved so that the first is of ``level``."""
    fence, shift, out = Fence(), None, []
    for line in text.splitlines(keepends=True):
        found = None if fence.inside(line) else _hashed(line.rstrip("\r\n"))
        if found and level is not None:
            shift = level - found[0] if shift is None else shift
            body = line.lstrip()
            line = line[: len(line) - len(body)] + "#" * max(1, min(6, found[0] + shift)) + body.lstrip("#")
        out.append(line)
    return "".join(out)


# Tables ------------------------------------------------------------------------------------------------------------


def is_piped(line: str) -> bool:
    return line.lstrip().startswith("|")


def cells(row: str) -> list[str]:
    """The cells between the outer pipes of a row; a row that is open on a side may begin or end with several."""
    parts = row.strip().split("|")
    if len(parts) > 2 and parts[0] == parts[-1] == "":
        parts = parts[1:-1]
    else:
        ends = [k for k, x in enumerate(parts) if x] or [0]
        parts = parts[ends[0] : ends[-1] + 1]
    return [x.strip() for x in parts]


def is_rule(row: list[str]) -> bool:
    """Whether the row only separates. A row of empty cells counts as that."""
    return not (row and row[0][:1].isalnum()) and not "".join(row).replace("-", "").replace(":", "").strip()


def table_grid(text: str | None) -> tuple[list[str], list[list[str]]]:
    """The header of a pipe table and its rows, cut or filled to the header; a later column of a name wins."""
    grid = []
    for line in (text or "").splitlines():
        if "|" in line and (line := line.strip())[0] == "|":
            row = [x.strip() for x in line[1:-1].split("|")] if len(line) > 1 and line[-1] == "|" else cells(line)
            if not is_rule(row):
                grid.append(row)
    head, *body = grid or [[]]
    n, names = len(head), {h: k for k, h in enumerate(head)}
    body = [r if len(r) == n else r[:n] + [""] * (n - len(r)) for r in body]
    return [*names], body if len(names) == n else [[r[k] for k in names.values()] for r in body]


def table_rows(text: str | None) -> list[dict[str, str]]:
    """A pipe table as one map a row."""
    head, body = table_grid(text)
    return [dict(zip(head, r, strict=True)) for r in body]


@cache
def table_rows_udf():
    return _column(table_rows, "array<map<string,string>>")


def _aligned(run: list[str]) -> list[str]:
    grid = [cells(x) for x in run]
    data = [r for r in grid if not is_rule(r)]
    if not data:
        return run
    columns = [*zip_longest(*data, fillvalue="")]
    columns += [("",) * len(data)] * (max(map(len, grid)) - len(columns))
    wide = [[c.ljust(max(3, *map(len, column))) for c in column] for column in columns]
    head, *body = (f"| {' | '.join(r)} |" for r in zip(*wide, strict=True))
    return [head, f"|{'|'.join('-' * (len(c[0]) + 2) for c in wide)}|", *body]


def with_table_widths(text: str | None) -> str:
    """Every pipe table again with columns as wide as their widest cell; the whole text stripped."""
    runs = groupby((text or "").splitlines(), is_piped)
    return "\n".join(chain.from_iterable(_aligned([*run]) if piped else run for piped, run in runs)).strip()


@cache
def table_widths_udf():
    return _column(with_table_widths, "string")


def table_blocks(text: str | None) -> list[dict]:
    """(start, end, text) of each stretch of table rows, blank lines between them left out; ``end`` is the line after it
    and the blank lines that follow it."""
    out, rows, i = [], (text or "").split("\n"), 0
    while i < len(rows):
        start = i
        while i < len(rows) and (is_piped(rows[i]) or (i > start and not rows[i].strip())):
            i += 1
        if i > start:
            out.append({"start": start, "end": i, "text": "\n".join(x for x in rows[start:i] if x.strip())})
        i = max(i, start + 1)
    return out


@cache
def table_blocks_udf():
    return _column(table_blocks, "array<struct<start:int,end:int,text:string>>")


def list_blocks(text: str | None) -> list[str]:
    """Stretches of list items with the indented lines that go on after them."""
    out, held = [], []
    item = lambda x: x.lstrip()[:1] in tuple("-*+") and x.lstrip()[1:2].isspace()
    for line in [*(text or "").split("\n"), ""]:
        if item(line) or held and line.startswith(" "):
            held.append(line)
        elif held:
            out.append("\n".join(held))
            held = []
    return out


@cache
def list_blocks_udf():
    return _column(list_blocks, "array<string>")


# Echoes of model prompts -------------------------------------------------------------------------------------------

#: Titles of prompt steps, and labels that are no headings.
STEP_TITLES = (
    "rewrite the header row",
    "keep the data rows exactly as-is",
    "keep the data rows exactly as is",
    "fix the latex",
    "corrected latex",
    "equation verbalization",
    "verbalization of formula",
    "verbalization of the formula",
    "rag enrichment block",
    "fix the table formatting",
    "corrected latex formula",
)
LABELS = (
    "corrected latex formula",
    "corrected latex",
    "rag enrichment block",
    "formula name",
    "also known as",
    "use case",
    "domain keywords",
    "table subject",
    "property type",
    "columns and units",
)
#: Labels of the lines that describe a table.
TABLE_LABELS = ("table subject", "property type", "columns and units", "domain keywords")


def _plain(x: str) -> str:
    return " ".join(x.lower().split())


def is_step_echo(line: str) -> bool:
    """Whether a line is ``step``, a number, a separator and one of the known titles, under any marks."""
    said = _plain(line).lstrip("-*+#_ ")
    numbered = said.removeprefix("step").lstrip()
    title = numbered.lstrip("0123456789.").lstrip()
    number = numbered[: len(numbered) - len(title)].rstrip()
    if said == numbered or not number[:1].isdigit() or not (number.endswith(".") or title[:1] in tuple(":-–—")):
        return False
    title = title.replace("–", "-").replace("—", "-")
    return any(known in title for known in STEP_TITLES)


def label_of(line: str, labels: tuple[str, ...]) -> str | None:
    """The one of ``labels`` that a line begins with, in any case and spacing, maybe emphasised."""
    said = _plain(line.strip().removeprefix("**").removeprefix("__"))
    return next((x for x in labels if said.startswith(x) and not (said[len(x) :][:1].isalnum() or said[len(x) :][:1] == "_")), None)


def _unmarked(line: str) -> str | None:
    """A label that is marked as a heading, without the marks; None for any other line."""
    body = line.lstrip()
    rest = body.lstrip("#")
    marked = 1 <= len(body) - len(rest) <= 6 and label_of(rest, LABELS)
    return line[: len(line) - len(body)] + rest.lstrip() if marked else None


def without_echoes(text: str | None) -> dict:
    """(text, steps, labels, sups): echoed step titles dropped, label headings made plain outside fences, and
    stray superscript tags taken out. The end of the last line is kept."""
    text, fence = text or "", Fence()
    rows = [(line, fence.inside(line)) for line in text.splitlines()]
    kept = [(line, None if fenced else _unmarked(line)) for line, fenced in rows if not is_step_echo(line)]
    joined = "\n".join(line if plain is None else plain for line, plain in kept) + "\n" * text.endswith("\n")
    joined, sups = _without_sups(joined)
    return {"text": joined, "steps": len(rows) - len(kept), "labels": sum(plain is not None for _, plain in kept), "sups": sups}


def _without_sups(text: str) -> tuple[str, int]:
    """``text`` without registered-mark superscripts, and with a space for each superscript tag that stands alone between
    white space; and how many of either there were."""
    parts = re.split(r"(</?sup>)", text, flags=re.I)  # text, tag, text, tag, ...
    kept, n, i = [parts[0]], 0, 1
    while i < len(parts):
        if parts[i].lower() == "<sup>" and parts[i + 1].strip().lower() == "r" and "".join(parts[i + 2 : i + 3]).lower() == "</sup>":
            kept[-1] += parts[i + 3]
            n, i = n + 1, i + 4
        else:
            kept += parts[i : i + 2]
            i += 2
    # ``free`` is what no tag has used yet; the white space around one that goes, goes with it.
    done, free, used = "", kept[0], ""
    for k, (tag, rest) in enumerate(zip(kept[1::2], kept[2::2], strict=True)):
        begins = free[-1].isspace() if free else used in ("", "\n")
        ends = rest[0].isspace() if rest else 2 * k + 3 == len(kept)
        if begins and ends:
            done, free, used, n = f"{done}{free[:-1]} ", rest[1:], rest[:1], n + 1
        else:
            free += tag + rest
    return done + free, n


@cache
def without_echoes_udf():
    @F.pandas_udf("struct<text:string,steps:int,labels:int,sups:int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([without_echoes(t) for t in texts], columns=["text", "steps", "labels", "sups"])

    return run


def replayed(text: str | None, pairs: list | None) -> str:
    """``text`` with each pair's input replaced by its output, the next occurrence after the last one put in, or
    else the first; pairs that are not found or have no output change nothing."""
    text, at = text or "", 0
    for p in [] if pairs is None else pairs:
        old, new = p["input"], p["output"]
        if not old or new is None:
            continue
        found = text.find(old, at)
        if found < 0:
            found = text.find(old)
        if found >= 0:
            text, at = text[:found] + new + text[found + len(old) :], found + len(new)
    return text


@cache
def replayed_udf():
    @F.pandas_udf("string")
    def run(texts: pd.Series, pairs: pd.Series) -> pd.Series:
        return pd.Series([replayed(t, p) for t, p in zip(texts, pairs, strict=True)])

    return run


# Equations and tables with what belongs to them ---------------------------------------------------------------------

META = re.compile(r"<!--\s*RAG-META.*?-->", re.S)


def _is_where(line: str, lists: bool = False) -> bool:
    word = line.strip().lstrip("-* ")[:6].lower()
    return word[:5] == "where" and not (word[5:].isalnum() or word[5:] == "_") or lists and line.lstrip()[:1] in ("-", "*")


#: What the lines begin with that begin a block or a fence.
_BEGINS = tuple("<$|`~")


def blocks(text: str | None, fenced: bool = True, lists: bool = False, rows: list[str] | None = None) -> list[tuple[str, int, int]]:
    """(kind, first line, line after the last) of the blocks that must stay whole: equation, table and meta, and of
    the prose between them.

    A display equation takes the paragraph that begins with ``where``, or with ``lists`` a list, along, also after one
    blank line. A table takes the rows after single or more blank lines; a title is left to the caller. Without
    ``fenced``, code fences are text like any other. ``rows`` are the text's lines, if they are known.
    """
    rows = (text or "").split("\n") if rows is None else rows
    closes = [k for k, x in enumerate(rows) if "-->" in x] if "-->" in (text or "") else []
    out, fence, end, start, c = [], Fence(replaces=True), 0, 0, 0

    def add(kind: str, a: int, z: int) -> None:
        nonlocal start
        if a > start:
            out.append(("text", start, a))
        out.append((kind, a, z))
        start = z

    # Whether in a fence or not, no other line begins or ends anything.
    for i in [k for k, x in enumerate(rows) if x.lstrip()[:1] in _BEGINS]:
        line = rows[i]
        if i < end or fenced and (fence.inside(line) or fence_kind(line)):
            continue
        while c < len(closes) and closes[c] < i:
            c += 1
        end = i + 1
        if c < len(closes) and line.lstrip().startswith("<!--") and META.match("\n".join(rows[i : closes[c] + 1]).lstrip()):
            end = closes[c] + 1
            add("meta", i, end)
        elif line.strip().startswith("$$"):
            one = line.strip()
            if not (len(one) > 4 and one.endswith("$$")):
                while end < len(rows) and "$$" not in rows[end]:
                    end += 1
                end = min(end + 1, len(rows))
            after = end + (end < len(rows) and not rows[end].strip())
            if after < len(rows) and _is_where(rows[after], lists):
                while after < len(rows) and rows[after].strip():
                    after += 1
                end = after
            add("equation", i, end)
        elif is_piped(line):
            last = i
            while end < len(rows) and (rows[end].lstrip()[:1] or "|") == "|":
                if rows[end][:1] == "|" or rows[end].strip():
                    last = end
                end += 1
            end = last + 1
            add("table", i, end)
    if start < len(rows):
        out.append(("text", start, len(rows)))
    return out


def equations(text: str | None, found: list[tuple[str, int, int]] | None = None, rows: list[str] | None = None) -> list[str]:
    """Display equations with their variables and the first enrichment comment in the lines above or below them;
    ``found`` are the text's ``blocks`` and ``rows`` its lines, if they are known."""
    rows = (text or "").split("\n") if rows is None else rows
    out, noted = [], "RAG-META" in (text or "")
    for kind, a, z in blocks(text) if found is None else found:
        if kind == "equation":
            body = "\n".join(rows[a:z]).strip()
            near = noted and (META.search("\n".join(rows[max(0, a - 15) : a])) or META.search("\n".join(rows[z : z + 15])))
            out.append(f"{body}\n{near[0]}" if near else body)
    return out


@cache
def equations_udf():
    return _column(equations, "array<string>")


def is_heading(line: str) -> bool:
    marks = len(line) - len(line.lstrip("#"))
    return 1 <= marks <= 6 and line[marks : marks + 1].isspace()


def headings_above(rows: list[str]) -> list[str]:
    """For each line, and for the end, the last heading above it, else an empty string."""
    out, last = [""], ""
    for line in rows:
        if line[:1] == "#" and is_heading(line):
            last = line.lstrip("#").strip()
        out.append(last)
    return out


def paragraph_after(rows: list[str], at: int) -> tuple[int, int]:
    """First line and line after the last of the paragraph that follows line ``at`` - 1, blank lines aside; empty if what
    follows is a heading, a table, a formula or a comment."""
    while at < len(rows) and not rows[at].strip():
        at += 1
    end = at
    while end < len(rows) and (body := rows[end].strip()) and not (is_heading(body) or body.startswith(("|", "$$", "<!--"))):
        end += 1
    return at, end


def label_lines_above(rows: list[str], at: int) -> list[str]:
    """The lines right above line ``at``, blank ones aside, from the first that is a table's label on."""
    end = at
    while end and not rows[end - 1].strip():
        end -= 1
    top = end
    while top and rows[top - 1].strip() and not (is_heading(rows[top - 1].strip()) or is_piped(rows[top - 1])):
        top -= 1
    while top < end and not is_label_line(rows[top]):
        top += 1
    return rows[top:end]


def is_label_line(line: str) -> bool:
    if ":**" not in line or not line.lstrip().startswith("**"):
        return False
    name, mark, _ = line.strip().removeprefix("**").partition(":**")
    return bool(mark) and _plain(name) in TABLE_LABELS


def tables(text: str | None, notes: bool = True, found: list[tuple[str, int, int]] | None = None, cells: bool = True, above: list[str] | None = None, rows: list[str] | None = None) -> list[dict]:
    """(heading, text, rows) of each table, with the last enrichment comment in the ten lines above it, the label lines
    above it and, as notes, the paragraph below it; ``found`` are the text's ``blocks``, ``above`` its ``headings_above``
    and ``rows`` its lines, if they are known, and without ``cells`` there are no rows."""
    rows = (text or "").split("\n") if rows is None else rows
    above, out, noted = headings_above(rows) if above is None else above, [], "RAG-META" in (text or "")
    labelled = ":**" in (text or "")
    for kind, a, z in blocks(text) if found is None else found:
        if kind != "table":
            continue
        meta = META.findall("\n".join(rows[max(0, a - 10) : a]))[-1:] if noted else []
        below, end = paragraph_after(rows, z) if notes else (z, z)
        body = "\n".join(x for x in rows[a:z] if x.strip())
        labels = [x for x in label_lines_above(rows, a) if "-->" not in x] if labelled else []
        parts = [*meta, above[a], "\n".join(labels), body, "\n".join(rows[below:end])]
        out.append({"heading": above[a], "text": "\n".join(x for x in parts if x)} | ({"rows": table_rows(body)} if cells else {}))
    return out


@cache
def tables_udf():
    return _column(tables, "array<struct<heading:string,text:string,rows:array<map<string,string>>>>")


# Splitting ---------------------------------------------------------------------------------------------------------

PROSE_SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", " ", "")
PLAIN_SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split(text: str, size: int, overlap: int, separators: tuple[str, ...] = PROSE_SEPARATORS, whole: frozenset[str] = frozenset()) -> list[str]:
    """Stretches of at most ``size`` characters, cut at the first separator that the text has, which stays with what
    follows it; neighbours share up to ``overlap``. Longer pieces are cut at the next separators. Pieces in
    ``whole`` are never cut."""
    if len(text) < size:
        return [text.strip()] if text.strip() else []
    for chosen, mark in enumerate(separators):  # noqa: B007
        if not mark or mark in text:
            break
    rest = separators[chosen + 1 :]
    if mark:
        first, *parts = text.split(mark)
        parts = [*([first] if first else []), *[mark + p for p in parts]]
    else:
        parts = list(text)
    out: list[str] = []
    held: deque[str] = deque()
    n = 0
    for part in parts:
        long = len(part)
        if long >= size and rest and part.strip() not in whole:
            if held and (joined := "".join(held).strip()):
                out.append(joined)
            held.clear()
            n = 0
            out += split(part, size, overlap, rest, whole)
            continue
        if held and n + long > size:
            if joined := "".join(held).strip():
                out.append(joined)
            while held and (n > overlap or n + long > size):
                n -= len(held.popleft())
        held.append(part)
        n += long
    if held and (joined := "".join(held).strip()):
        out.append(joined)
    return out


@cache
def split_udf(size: int, overlap: int, separators: tuple[str, ...] = PROSE_SEPARATORS):
    return _column(lambda t: split(t or "", size, overlap, separators), "array<string>")
