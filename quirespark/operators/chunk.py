"""Four chunking strategies: documents to chunk rows. Blocks that must stay whole never get cut.

Scanning and splitting is per document, an Arrow batch of documents at a time; classes and duplicates are columns
over the result. Documents: (source_file, text).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions import kernels
from quirespark.functions.kernels import PLAIN_SEPARATORS, PROSE_SEPARATORS
from quirespark.functions.text import chunk_id, indexed_id, token_estimate
from quirespark.sources import store

ATOMIC = (2048, 400)
PROSE = (2048, 300)
CHILD = (800, 100)
MAX_TOKENS, OVERLAP_TOKENS = 512, 80


def content_type(c: Column, inline: str = r"\$[^$\n]+\$") -> Column:
    math, table = c.contains("$") & (c.contains("$$") | c.rlike(inline)), c.contains("|") & c.rlike(r"(?m)^\|")
    return F.when(math & table, "mixed").when(math, "equation").when(table, "table").otherwise("text")


#: A line that says what a symbol is: ``where ...``, or a name before an equals sign or colon.
_DEFINES = r"(?im)^[ \t]*(?:where\b|(?:[-*][ \t]*)?[a-z]\w*[ \t]*[:=][ \t]*[^\s])"


def has_variables(c: Column, inline: str = r"\$[^$\n]+\$") -> Column:
    """Whether a text has math and a line that defines a symbol."""
    return c.contains("$") & (c.contains("$$") | c.rlike(inline)) & c.rlike(_DEFINES)


#: What marks a table as the schema of another.
SCHEMA_MARKERS = ("column header", "unit", "category/prerequisite/credit", "description", "path/subcategory", "page numbers")


def is_schema_table(table: Column) -> Column:
    """Whether a pipe table of ten rows at most has two of the markers."""
    found = sum((F.lower(table).contains(m).cast("int") for m in SCHEMA_MARKERS), F.lit(0))
    rows = F.filter(F.split(table, "\n"), lambda x: x.rlike(r"^\s*\|") & ~x.rlike(r"^[\s|:\-]*$"))
    return (found >= 2) & (F.size(rows) <= 10)


def section_number(heading: Column) -> Column:
    """``6.2.1`` of ``6.2.1 Title``, emphasis aside; null without a number."""
    n = F.regexp_extract(F.regexp_replace(heading, r"(?U)^[\s*]+", ""), r"^(\d+(?:\.\d+)*)", 1)
    return F.when(n != "", n)


def parent_section(section: Column) -> Column:
    return F.when(section.contains("."), F.regexp_replace(section, r"\.[^.]*$", ""))


def equation_ids(c: Column) -> Column:
    both = F.regexp_extract_all(c, F.lit(r"\\tag\{[^}]+\}|\(\d+[\-.]\d+\)"), F.lit(0))
    return F.array_distinct(F.transform(both, lambda x: F.regexp_replace(x, r"^\\tag\{|^\(|[})]$", "")))


def table_ids(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?iU)Table\s+([\w\-]+)"), F.lit(1)))


#: Chunks of so many characters leave a task's Python together.
HELD_CHARS = 4 << 20


def _frames(batches: Iterator[pd.DataFrame], kernel: Callable[[str, str], list[dict]], names: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of every document, as frames of ``HELD_CHARS`` characters of text and those of one document more."""
    for batch in batches:
        found, held = [], 0
        for source, text in zip(batch["source_file"], batch["text"], strict=True):
            rows = kernel(source, text or "")
            found += rows
            held += sum(len(r["text"]) for r in rows)
            if held > HELD_CHARS:
                yield pd.DataFrame(found, columns=names)
                found, held = [], 0
        yield pd.DataFrame(found, columns=names)


def _rows(docs: DataFrame, kernel: Callable[[str, str], list[dict]], schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    return docs.select("source_file", "text").mapInPandas(lambda batches: _frames(batches, kernel, names), schema)


def _sections(text: str) -> list[tuple[dict[str, str], list[str]]]:
    """Stretches between headings of levels 1 to 4 outside fences, each with the headings it stands under."""
    heads: dict[int, str] = {}
    out: list[tuple[dict[str, str], list[str]]] = []
    fence, now = kernels.Fence(), []
    for line in text.split("\n"):
        m = None if fence.inside(line) else re.match(r"^(#{1,4})\s+(.*?)\s*#*\s*$", line)
        if m:
            out.append(({f"h{k}": v for k, v in sorted(heads.items())}, now))
            heads = {k: v for k, v in heads.items() if k < len(m[1])} | {len(m[1]): m[2]}
            now = []
        now.append(line)
    out.append(({f"h{k}": v for k, v in sorted(heads.items())}, now))
    return [(h, x) for h, x in out if "\n".join(x).strip()]


#: A line that may be the title of the table below it: any text, or what the hierarchical strategy takes.
def any_title(line: str) -> bool:
    return not line.startswith("#")


def table_title(line: str) -> bool:
    return "Table" in line or line.strip().startswith(("**", "_"))


def _absent(text: str) -> list[str]:
    """Two characters for private use that ``text`` lacks."""
    return list(islice((c for c in map(chr, chain(range(0xE000, 0xF900), range(0xF0000, 0x10FFFE))) if c not in text), 2))


def _whole_or_split(text: str, size: int, overlap: int, separators, title=any_title, notes: bool = False, **scan) -> list[tuple[str, int]]:
    """``text`` in pieces of ``size``, with its equations, tables and comments whole, and the line each piece begins in.

    Blocks are masked by marks of two characters that the text lacks, text is cut, and marks are replaced by their blocks again. A
    ``title`` right above a table is in its block, and with ``notes`` the paragraph below it, too.
    """
    rows, masked, held, at = text.split("\n"), [], {}, []
    left, right = _absent(text)
    done = 0
    for kind, a, z in kernels.blocks(text, **scan):
        a = max(a, done)
        if kind == "text":
            masked += rows[a:z]
            at += range(a, z)
            continue
        first, body = a, rows[a:z]
        if kind == "table" and masked and masked[-1].strip() and masked[-1] not in held and title(masked[-1]):
            body = [masked.pop(), *body]
            first = at.pop()
        if kind == "table" and notes:
            below, end = kernels.paragraph_after(rows, z)
            if below < end:
                body, done = [*body, *rows[z:end]], end
        mark = f"{left}{len(held):06d}{right}"
        held[mark] = "\n".join(body)
        masked.append(mark)
        at.append(first)
    joined, out, here, line = "\n".join(masked), [], 0, 0
    for piece in kernels.split(joined, size, overlap, separators, frozenset(held)):
        # Pieces come in order and overlap, so the next begins after the start of the one before.
        found = _found(joined, piece, here)
        if found >= 0:
            line += joined.count("\n", here, found)
            here = found
        out.append((re.sub(f"{left}[0-9]+{right}", lambda m: held.get(m[0], m[0]), piece), at[line] if at else 0))
        here, line = (here + 1, line + joined.startswith("\n", here)) if found >= 0 else (here, line)
    return out


def recursive_chunks(docs: DataFrame, size: int = PROSE[0], overlap: int = PROSE[1]) -> DataFrame:
    """Pieces of ``size`` characters, blocks cut like all else: source_file, ordinal, text."""

    def kernel(source: str, text: str) -> list[dict]:
        return [{"source_file": source, "ordinal": i, "text": piece} for i, piece in enumerate(kernels.split(text, size, overlap))]

    return _rows(docs, kernel, "source_file string, ordinal int, text string")


def atomic_chunks(docs: DataFrame, size: int = ATOMIC[0], overlap: int = ATOMIC[1]) -> DataFrame:
    """Strategy 1: text of ``size`` characters, blocks whole, a table with the paragraph below it: text, source,
    section_heading, content_type, has_variables, token_estimate, in order ``ordinal``."""

    def kernel(source: str, text: str) -> list[dict]:
        above = kernels.headings_above(text.split("\n"))
        pieces = _whole_or_split(text, size, overlap, PROSE_SEPARATORS, notes=True)
        return [{"source_file": source, "ordinal": i, "text": piece, "section_heading": above[line + 1]} for i, (piece, line) in enumerate(pieces)]

    out = _rows(docs, kernel, "source_file string, ordinal int, text string, section_heading string")
    inline = r"\$[^$\n]{2,200}\$"
    return out.withColumns({"content_type": content_type(F.col("text"), inline), "has_variables": has_variables(F.col("text"), inline), "token_estimate": token_estimate(F.col("text"))})


def hierarchical_chunks(docs: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS, compat: bool = False) -> DataFrame:
    """Strategy 4: sections under their headings, cut where they exceed ``max_tokens`` (four characters each).

    With ``compat``, only sections above four times that are cut.
    """
    size = max_tokens * 4 * (4 if compat else 1)

    def kernel(source: str, text: str) -> list[dict]:
        out = []
        for heads, rows in _sections(text):
            body = "\n".join(rows).strip()
            cut = _whole_or_split(body, size, overlap * 4, PLAIN_SEPARATORS, table_title, fenced=False, lists=True) if len(body) // 4 > max_tokens else [(body, 0)]
            pieces = [p for p, _ in cut]
            out += [{"source_file": source, "ordinal": 0, "text": p, "headings": heads, "heading_path": " > ".join(heads.values())} for p in pieces if p.strip()]
        return [r | {"ordinal": i} for i, r in enumerate(out)]

    out = _rows(docs, kernel, "source_file string, ordinal int, text string, headings map<string,string>, heading_path string")
    deepest = F.element_at(F.filter(F.transform(F.reverse(F.sort_array(F.map_keys("headings"))), lambda k: section_number(F.col("headings")[k])), lambda n: n.isNotNull()), 1)
    found = F.when(F.exists(F.map_values("headings"), lambda h: section_number(h).isNotNull()), deepest)
    out = out.withColumn("section", found)
    return out.withColumns({"chunk_id": indexed_id(F.col("source_file"), F.col("ordinal")), "parent_section": parent_section(F.col("section")), "has_variables": has_variables(F.col("text"))})


def _without_label_runs(rows: list[str], lines: list[int]) -> tuple[list[str], list[int]]:
    """Prose without stretches of two or more label lines, which belong to a table."""
    is_label = [kernels.is_label_line(x) for x in rows]
    if not any(is_label):
        return rows, lines
    alone = [k for k, x in enumerate(is_label) if not x or not (is_label[k - 1 : k] == [True] or is_label[k + 1 : k + 2] == [True])]
    return [rows[k] for k in alone], [lines[k] for k in alone]


def _found(text: str, piece: str, at: int) -> int:
    """``text.find(piece, at)``, for which a long piece is prepared for longer than the first place of its start is looked for."""
    start = text.find(piece[:64], at)
    return start if start < 0 or text.startswith(piece, start) else text.find(piece, start)


def _typed(text: str, size: int, overlap: int) -> list[dict]:
    """(content_type, text, section_heading) of a document: equations, tables, then the prose without them."""
    rows, prose, lines, out = text.split("\n"), [], [], []
    above = kernels.headings_above(rows)
    found = kernels.blocks(text, rows=rows)
    for kind, a, z in found:
        if kind == "text":
            prose += rows[a:z]
            lines += range(a, z)
        elif kind == "equation":
            out.append({"content_type": "equation", "section_heading": above[a]})
    for r, body in zip(out, kernels.equations(text, found, rows) if out else (), strict=True):
        r["text"] = body
    out += [{"content_type": "table", "section_heading": t["heading"], "text": t["text"]} for t in kernels.tables(text, found=found, cells=False, above=above, rows=rows)]
    if ":**" in text:
        prose, lines = _without_label_runs(prose, lines)
    # Runs of blank lines shrink to one, so that lines keep their numbers.
    kept = [k for k in range(len(prose)) if prose[k] or k == 0 or prose[k - 1]]
    joined, lines = "\n".join(prose[k] for k in kept), [lines[k] for k in kept]
    here, line = 0, 0
    for piece in kernels.split(joined, size, overlap, PROSE_SEPARATORS):
        at = _found(joined, piece, here)
        if at >= 0:
            line += joined.count("\n", here, at)
            here = at
        out.append({"content_type": "text", "section_heading": above[lines[line] + 1] if lines else "", "text": piece})
    return out


def _first_of(chunks: DataFrame, *order: str) -> DataFrame:
    """The first chunk of each id: ids come from a digest of the first 120 characters, so others may share one."""
    return chunks.withColumn("_n", F.row_number().over(Window.partitionBy("chunk_id").orderBy(*order))).filter("_n = 1").drop("_n")


def typed_chunks(docs: DataFrame, size: int = PROSE[0], overlap: int = PROSE[1], distinct: bool = True) -> DataFrame:
    """Strategy 2: chunks by type; ``distinct`` keeps the first of each id, text before equations before tables."""

    def kernel(source: str, text: str) -> list[dict]:
        return [r | {"source_file": source, "ordinal": i} for i, r in enumerate(_typed(text, size, overlap))]

    out = _rows(docs, kernel, "source_file string, ordinal int, content_type string, text string, section_heading string")
    out = out.withColumns({"chunk_id": chunk_id(F.col("source_file"), F.col("text")), "has_variables": has_variables(F.col("text"), r"\$[^$\n]{2,200}\$")})
    return first_typed(out) if distinct else out


def first_typed(chunks: DataFrame) -> DataFrame:
    """The first of each id of ``typed_chunks`` made with ``distinct=False``; columns that were dropped are not shuffled."""
    kinds = F.array(*map(F.lit, ("text", "equation", "table")))
    return _first_of(chunks.withColumn("_t", F.array_position(kinds, F.col("content_type"))), "_t", "source_file", "ordinal").drop("_t")


def table_children(head: list[str], rows: list[list[str]], heading: str) -> list[tuple[int, str]]:
    """(first row, text) of the children of a table: a row each, or three if there are more than ten."""
    step, shown = 3 if len(rows) > 10 else 1, lambda cells: "| " + " | ".join(cells) + " |"
    above = (f"From table: {heading}\n" if heading else "") + shown(head) + "\n" + shown(["---"] * len(head))
    return [(a, "\n".join([above, *map(shown, rows[a : a + step])])) for a in range(0, len(rows), step)]


def _children(parent: dict, size: int, overlap: int) -> list[tuple[str, str]]:
    """(suffix of the source in the id, text) of the children of a parent."""
    text, kind = parent["text"], parent["content_type"]
    if kind == "text":
        return [("_child", p) for p in kernels.split(text, size, overlap, PLAIN_SEPARATORS)]
    if kind == "equation":
        said = [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith(("$$", "<!--"))][:3]
        return [("_eq_child", " ".join(said) or text[:120])]
    head, rows = kernels.table_grid(text)
    if not rows:
        return [("_tbl_child", parent["section_heading"] or text[:200])]
    return [(f"_tbl_child_{a}", t) for a, t in table_children(head, rows, parent["section_heading"])]


#: A parent with its children, whose ids are the numbers that they spell. Headings and texts are left out where nothing asks for them.
_FAMILY = pa.schema([("source_file", pa.string()), ("parent", pa.int32()), ("content_type", pa.string()), ("key", pa.int64()), ("child_keys", pa.list_(pa.int64())), ("section_heading", pa.string()), ("text", pa.string()), ("child_texts", pa.list_(pa.string()))])
_FAMILY_SQL = "source_file string, parent int, content_type string, key long, child_keys array<long>, section_heading string, text string, child_texts array<string>"
_BARE = 5


def _family_batch(rows: list[tuple], digests: list[bytes], texts: bool) -> pa.RecordBatch:
    """Of ``rows`` (source_file, parent, content_type, number of children, section_heading, text, child_texts) and the digests of each parent
    and its children, of which ``functions.text.chunk_id`` spells the first six bytes."""
    sources, numbers, kinds, many, headings, own, children = zip(*rows, strict=True) if rows else [()] * 7
    n = np.array(many, np.int64)
    keys, first = (np.frombuffer(b"".join(digests), ">u8")[::2] >> np.uint64(16)).astype(np.int64), np.cumsum(n + 1) - n - 1
    child = np.ones(len(keys), bool)
    child[first] = False
    listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(keys[child]))
    columns = [sources, numbers, kinds, keys[first], listed, headings, own, children][: len(_FAMILY) if texts else _BARE]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _FAMILY, strict=False)], names=_FAMILY.names[: len(columns)])


#: Texts of so many documents are taken out of an Arrow batch at a time.
SOME_DOCS = 64


def _families(docs: DataFrame, size: int, overlap: int, child: tuple[int, int], compat: bool, texts: bool) -> DataFrame:
    """``_FAMILY`` of documents, or what of it is not text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, digests, held, md5 = [], [], 0, hashlib.md5
        for batch in batches:
            for at in range(0, batch.num_rows, SOME_DOCS):
                for source, text in zip(*(c.slice(at, SOME_DOCS).to_pylist() for c in batch.columns), strict=True):
                    for i, p in enumerate(_typed(text or "", size, overlap)):
                        kind, own = p["content_type"], p["text"]
                        if compat and kind == "text":
                            continue
                        found = _children(p, *child)
                        digests.append(md5(f"{source}::{own[:120]}".encode()).digest())
                        digests += [md5(f"{source}{s}::{t[:120]}".encode()).digest() for s, t in found]
                        rows.append((source, i, kind, len(found), *((p["section_heading"], own, [t for _, t in found]) if texts else (None, None, None))))
                    held += 3 * len(text or "")  # about what its parents and children have
                    if held > HELD_CHARS:
                        yield _family_batch(rows, digests, texts)
                        rows, digests, held = [], [], 0
        yield _family_batch(rows, digests, texts)

    return docs.select("source_file", "text").mapInArrow(run, ", ".join(_FAMILY_SQL.split(", ")[: None if texts else _BARE]))


def _members(families: DataFrame) -> DataFrame:
    """A row for each parent and child: also child (-1 for a parent), key, parent_key and n_children."""
    texts = "text" in families.columns
    none = F.array().cast("array<long>")
    own = F.struct(F.lit(-1).alias("child"), "key", F.lit(None).cast("long").alias("parent_key"), F.size("child_keys").alias("n_children"), *((F.col("text"), F.col("child_keys")) if texts else ()))
    each = lambda k, i: F.struct(i.alias("child"), k.alias("key"), F.col("key").alias("parent_key"), F.lit(0).alias("n_children"), *((F.get("child_texts", i).alias("text"), none.alias("child_keys")) if texts else ()))
    kept = [c for c in ("source_file", "parent", "content_type", "section_heading", "own_id") if c in families.columns]
    return families.select(*kept, F.inline(F.concat(F.array(own), F.transform("child_keys", each))))


def _role_key(key: Column, child: Column) -> Column:
    """A parent's key or a child's as one number."""
    return F.shiftleft(key, 1).bitwiseOR(child.cast("long"))


def _first_members(members: DataFrame) -> DataFrame:
    """The first chunk of each id among parents and among children. A row number would have all rows sorted before they are
    shuffled, too, for the first of each to be kept."""
    own = Window.partitionBy(_role_key(F.col("key"), F.col("child") >= 0)).orderBy("source_file", "parent", "child")
    return members.withColumn("_first", F.lag(F.lit(True)).over(own).isNull()).filter("_first").drop("_first")


def _spelled(key: Column) -> Column:
    return F.concat(F.lit("chunk_"), F.lower(F.lpad(F.hex(key), 12, "0")))


def _role() -> Column:
    return F.when(F.col("child") < 0, "parent").otherwise("child")


def parent_child_chunks(docs: DataFrame, size: int = PROSE[0], overlap: int = PROSE[1], child: tuple[int, int] = CHILD, compat: bool = False) -> DataFrame:
    """Strategy 3: parents and children in one table, ``chunk_role`` telling which.

    ``child_ids`` names all children, also those that a later duplicate loses. With ``compat`` there is no prose.
    """
    rows = _first_members(_members(_families(docs, size, overlap, child, compat, True)))
    ids = (_spelled(F.col("key")).alias("chunk_id"), _spelled(F.col("parent_key")).alias("parent_id"), _role().alias("chunk_role"), F.transform("child_keys", _spelled).alias("child_ids"))
    return rows.select("source_file", "parent", "child", "content_type", "section_heading", "text", *ids, has_variables(F.col("text"), r"\$[^$\n]{2,200}\$").alias("has_variables"))


def parent_child_ids(docs: DataFrame, size: int = PROSE[0], overlap: int = PROSE[1], child: tuple[int, int] = CHILD, compat: bool = False) -> DataFrame:
    """(chunk_id, parent_id, chunk_role, content_type, source_file, n_children) of ``parent_child_chunks``, from a table of
    families without texts that is written first. Only its keys are shuffled, and the rows of those that several share."""
    families = store.written(_families(docs, size, overlap, child, compat, False).withColumn("number", F.monotonically_increasing_id()))
    every = F.concat(F.array(_role_key(F.col("key"), F.lit(0))), F.transform("child_keys", lambda k: _role_key(k, F.lit(1))))
    keys = families.select("number", F.explode(every).alias("_key"))
    shared = store.written(keys.groupBy("_key").agg(F.count("*").alias("n")).filter("n > 1").select("_key"))
    spelled = lambda some: _members(some.withColumn("own_id", _spelled(F.col("key")))).withColumn("_key", _role_key(F.col("key"), F.col("child") >= 0))
    rows = spelled(families)
    if not shared.isEmpty():
        holders = store.written(keys.join(shared, "_key", "left_semi").select("number").distinct())
        several = spelled(families.join(holders, "number", "left_semi")).join(shared, "_key", "left_semi")
        rows = rows.join(shared, "_key", "left_anti").unionByName(_first_members(several))
    ids = (F.when(F.col("child") < 0, F.col("own_id")).otherwise(_spelled(F.col("key"))).alias("chunk_id"), F.when(F.col("child") >= 0, F.col("own_id")).alias("parent_id"))
    return rows.select(*ids, _role().alias("chunk_role"), "content_type", "source_file", "n_children")


def drops(chunks: DataFrame) -> DataFrame:
    """(chunk_id, dropped): how many chunks, made with ``distinct=False``, each id that several share would lose."""
    return chunks.groupBy("chunk_id").agg((F.count("*") - 1).alias("dropped")).filter("dropped > 0")


def summary(chunks: DataFrame) -> DataFrame:
    """One row: total, files, by_type (content type to count), tokens and mean_tokens to one digit."""
    typed = chunks.withColumns({"_t": content_type(F.col("text")), "_n": token_estimate(F.col("text"))})
    by_type = typed.groupBy("_t").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_t", "n")))).alias("by_type"))
    totals = typed.agg(F.count("*").alias("total"), F.countDistinct("source_file").alias("files"), F.sum("_n").alias("tokens"), F.bround(F.avg("_n"), 1).alias("mean_tokens"))
    return totals.crossJoin(by_type)


def nearest_headings(rows: DataFrame, key: str, *order: str, text: str = "text", into: str = "heading") -> DataFrame:
    """Lines of documents (key, order, text) with the title of the last heading above each, null where there is none."""
    title = F.when(F.col(text).rlike(r"^#{1,6}\s"), F.trim(F.regexp_replace(text, "^#+", "")))
    above = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(into, F.last(title, ignorenulls=True).over(above))
