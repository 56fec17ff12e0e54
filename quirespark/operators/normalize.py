"""Structural normalisation of Markdown: page marks, headings and their levels. All columns, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions import kernels
from quirespark.functions.fences import marked_headings
from quirespark.functions.text import WHITE, after, each_line, led, less, let, lines, ltrim, occurrences, rtrim, strip, unlines

NUMBERED, OTHER = "numbered", "non-numbered"

_BLANK = r"(?:&nbsp;|[\s ​])*"
_ID = r"(?:\"{0}\"|'{0}'|{0})"
_LABEL = rf"{_BLANK}(?:(?:page{_BLANK})?\d{{1,6}}|page{_BLANK}\d{{1,6}}{_BLANK}[-–]{_BLANK}\d{{1,6}}){_BLANK}"
#: A span with an id that is blank inside, or whose id names a page and which holds a page label.
PAGE_SPAN = (
    r"(?isU)<span\b[^>]*\bid\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^>\s]+)[^>]*>" + _BLANK + r"</span>"
    r"|<span\b[^>]*\bid\s*=\s*" + _ID.format(r"\s*page[\\\-\d_]*\s*") + r"(?=[\s>])[^>]*>" + _LABEL + r"</span>"
)
#: A link whose target is a page, named by up to three numbers.
PAGE_LINK = r"(?iU)\[\s*([^\]]*?)\s*\]\(\s*#page[-_]?\d+(?:[-_]\d+){0,2}\s*\)"


def without_page_spans(c: Column) -> Column:
    """(text, removed): page marks taken out; a span with other content stays."""
    return F.struct(F.regexp_replace(c, PAGE_SPAN, "").alias("text"), F.size(F.regexp_extract_all(c, F.lit(PAGE_SPAN), F.lit(0))).alias("removed"))


def _is_page_number(word: Column) -> Column:
    """Up to four digits, or up to twelve letters that Roman numerals have."""
    roman = (F.translate(F.lower(word), "ivxlcdm", "") == "") & F.length(word).between(1, 12)
    return roman | word.rlike(r"(?U)^\d{1,4}$")


def _ends(line: Column) -> Column:
    """(before, word, marks): the last word of a line, without the asterisks after it, and what stands before."""
    whole = rtrim(line)
    plain = rtrim(whole, "*")
    word = F.element_at(F.split(plain, r"(?U)\s"), -1)
    return F.struct(F.substring(plain, F.lit(1), F.length(plain) - F.length(word)).alias("before"), word.alias("word"), after(whole, F.length(plain)).alias("marks"))


def without_page_links(c: Column) -> Column:
    """(text, unwrapped): links to pages become their labels; a line of contents, in which a page number follows the last
    link, loses that number too, but not the asterisks that close it."""

    def unwrapped(line: Column) -> Column:
        # The label is stripped as it is put in: spaces at its ends go with the brackets.
        plain = F.regexp_replace(line, PAGE_LINK, "$1")
        tail = F.substring_index(line, ")", -1)  # what follows the last bracket: marks, the number, marks
        number = F.btrim(tail, F.lit(WHITE + "*"))
        lead = led(tail, ltrim(tail, WHITE + "*"))
        few = lambda x: F.length(x) - F.length(F.replace(x, F.lit("*"), F.lit(""))) <= 3
        listed = line.rlike(PAGE_LINK) & _is_page_number(number) & (lead != rtrim(lead)) & few(lead) & few(after(tail, F.length(lead) + F.length(number)))
        short = let(_ends(plain), lambda e: F.when(_is_page_number(e["word"]) & (e["before"] != rtrim(e["before"])), F.concat(rtrim(e["before"]), e["marks"])).otherwise(rtrim(plain)))
        return F.when(listed, short).otherwise(plain)

    return F.struct(each_line(c, unwrapped, keep_end=True).alias("text"), F.size(F.regexp_extract_all(c, F.lit(PAGE_LINK), F.lit(0))).alias("unwrapped"))


#: Tags of emphasis.
EMPHASIS = ("strong", "b", "em", "i")


def _without_tags(c: Column) -> Column:
    """``c`` without one tag of emphasis at either end."""

    def opened(x: Column) -> Column:
        out = x
        for tag in EMPHASIS:
            out = F.when(F.lower(F.substring(x, 1, len(tag) + 2)) == f"<{tag}>", ltrim(after(x, len(tag) + 2))).otherwise(out)
        return out

    def closed(x: Column) -> Column:
        out = x
        for tag in EMPHASIS:
            out = F.when(F.lower(F.substring(x, -len(tag) - 3, len(tag) + 3)) == f"</{tag}>", rtrim(F.substring(x, F.lit(1), F.length(x) - len(tag) - 3))).otherwise(out)
        return out

    # only what begins or ends like a tag is looked at closer
    start = let(ltrim(c), lambda x: F.when(x.startswith("<"), opened(x)).otherwise(x))
    return let(start, lambda x: F.when(rtrim(x).endswith(">"), let(rtrim(x), closed)).otherwise(x))


def heading_category(c: Column) -> Column:
    """``numbered`` if the heading, without emphasis, quotes and markers, begins with a section number."""
    bare = ltrim(F.btrim(_without_tags(strip(c)), F.lit("*_`\"'")), WHITE + ">-*")
    return F.when(bare.rlike(r"(?U)^\d++(?!\w)"), F.lit(NUMBERED)).otherwise(F.lit(OTHER))


def document_format(headings: Column) -> Column:
    """(format, numbered, total) by majority, a tie is numbered; without headings it is non-numbered."""
    return let(
        F.transform(headings, heading_category),
        lambda k: let(
            F.size(F.filter(k, lambda x: x == NUMBERED)),
            lambda n: F.struct(
                F.when((F.size(k) > 0) & (n >= F.size(k) - n), F.lit(NUMBERED)).otherwise(F.lit(OTHER)).alias("format"), n.alias("numbered"), F.size(k).alias("total")
            ),
        ),
    )


def strict_format(headings: Column) -> Column:
    """The detector's rule: enough numbered headings of which some are nested, or else a majority of at least one."""
    kinds = F.size(F.filter(headings, lambda h: heading_category(h) == NUMBERED))
    nested = F.exists(headings, lambda h: strip(h).rlike(r"^\d+\.\d+"))
    return let(
        kinds,
        lambda n: F.when(((n >= 3) & (nested | (n >= 5))) | (n >= F.greatest(F.lit(1), F.size(headings) - n)), F.lit(NUMBERED)).otherwise(F.lit(OTHER)),
    )


def agreement(a: Column, b: Column) -> Column:
    """The share of equal labels; null if the lists differ in length or are empty."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), same / F.size(a))


def reconciled(heuristic: Column, model: Column, second: Column, double_check: float = 0.85, accept: float = 0.65) -> Column:
    """The labels to go by: the model's if it, or its second answer where the first agrees too little, agrees enough."""
    answer = F.when(F.coalesce(agreement(heuristic, model), F.lit(0.0)) >= double_check, model).otherwise(F.coalesce(second, model))
    return F.when(F.coalesce(agreement(heuristic, answer), F.lit(0.0)) >= accept, answer).otherwise(heuristic)


#: Labels that a model may give: its first answer and, more leniently, its second.
VOCABULARY = {NUMBERED: NUMBERED, OTHER: OTHER}
LENIENT = VOCABULARY | {"non numbered": OTHER, "nonnumeric": OTHER, "non-numeric": OTHER}


def format_prompt(headings: Column, examples: int = 6) -> Column:
    """What a model is asked about a whole document, with its first numbered headings."""
    numbered = F.slice(F.filter(headings, lambda h: heading_category(h) == NUMBERED), 1, examples)
    shown = F.array_join(F.transform(numbered, lambda h: F.concat(F.lit("- "), h)), "\n")
    return F.concat(F.lit(f'Is the body of this document structured by numbered headings? Say "{NUMBERED}" or "{OTHER}" and nothing else.\n\n'), shown)


def labels_prompt(headings: Column) -> Column:
    """What a model is asked for a label for each heading."""
    shown = F.array_join(F.transform(headings, lambda h, i: F.concat((i + 1).cast("string"), F.lit(". "), h)), "\n")
    return F.concat(F.lit(f'Label each heading "{NUMBERED}" or "{OTHER}". Answer with a JSON array of as many strings.\n\n'), shown)


def format_said(answer: Column) -> Column:
    """The format that a model's answer names first; null if it names none."""
    found = F.regexp_extract(F.lower(answer), r"\b(non[- ]numbered|numbered)\b", 1)
    return F.when(found == NUMBERED, F.lit(NUMBERED)).when(found != "", F.lit(OTHER))


def classified(headings: Column, answer: Column, second: Column | None = None) -> Column:
    """A document's format: the model's, else the detector's rule; with a ``second`` answer, the model's or ``unknown``."""
    if second is None:
        return F.coalesce(format_said(answer), strict_format(headings))
    return F.coalesce(format_said(answer), format_said(second), F.lit("unknown"))


def labels_said(answer: Column, n: Column, vocabulary: dict[str, str] = VOCABULARY) -> Column:
    """The labels in a model's answer: a JSON array of ``n`` words of the vocabulary; else null."""
    inner = F.regexp_extract(answer, r"(?s)(\[.*\])", 1)
    typed = F.schema_of_variant(F.try_parse_json(inner)) == "ARRAY<STRING>"
    words = F.transform(F.from_json(inner, "array<string>"), lambda w: F.lower(strip(w)))
    known = F.create_map(*(F.lit(x) for pair in vocabulary.items() for x in pair))
    found = F.transform(words, lambda w: F.try_element_at(known, w))
    return F.when(typed & (F.size(found) == n) & F.forall(found, lambda x: x.isNotNull()), found)


def report(headings: Column, model: Column, second: Column, double_check: float = 0.85, accept: float = 0.65) -> Column:
    """What the detection of a document's format rests on; ``model`` and ``second`` are ``labels_said`` or null."""
    share = lambda k: F.aggregate(k, F.lit(0.0), lambda a, x: a + (x == NUMBERED).cast("double")) / F.greatest(F.size(k), F.lit(1))
    count = lambda k, v: F.size(F.filter(k, lambda x: x == v))

    def checked(s: Column) -> Column:
        """The labels, and whether the first answer agrees so little that the second counts."""
        again = (F.coalesce(agreement(s["own"], s["model"]), F.lit(1.0)) < double_check) & s["second"].isNotNull()
        return let(again, lambda x: F.struct(s["own"].alias("own"), x.alias("checked"), F.when(x, s["second"]).otherwise(s["model"]).alias("answer"), s["model"].isNotNull().alias("asked")))

    def compared(s: Column) -> Column:
        return let(agreement(s["own"], s["answer"]), lambda a: taken(s, a, F.coalesce(a, F.lit(0.0)) >= accept))

    def taken(s: Column, agreed: Column, fits: Column) -> Column:
        kinds = F.when(fits, s["answer"]).otherwise(s["own"])
        numbered = lambda k: F.struct(count(k, NUMBERED).alias("n"), count(k, OTHER).alias("o"), F.size(k).alias("t"))
        return let(let(kinds, numbered), lambda k: told(s, agreed, fits, k))

    def told(s: Column, agreed: Column, fits: Column, k: Column) -> Column:
        some = F.size(s["own"]) > 0
        return F.struct(
            F.when(some & (2 * k["n"] >= k["t"]), F.lit(NUMBERED)).otherwise(F.lit(OTHER)).alias("document_format"),
            F.when(~some, F.lit("none")).when(fits, F.lit("model")).otherwise(F.lit("heuristic")).alias("detector"),
            F.size(s["own"]).alias("heading_count"),
            k["n"].alias("numbered_count"),
            k["o"].alias("non_numbered_count"),
            (some & s["asked"]).alias("llm_used"),
            (some & s["checked"]).alias("llm_double_checked"),
            share(s["own"]).alias("heuristic_numbered_ratio"),
            F.when(some & s["answer"].isNotNull(), share(s["answer"])).alias("llm_numbered_ratio"),
            F.when(some, agreed).alias("agreement_ratio"),
        )

    labels = F.struct(F.transform(headings, heading_category).alias("own"), model.alias("model"), second.alias("second"))
    return let(let(labels, checked), compared)


def _level(line: Column) -> Column:
    return F.when(line.startswith("#"), F.length(F.regexp_extract(line, "^(#{1,6}) ", 1))).otherwise(F.lit(0))


def with_hierarchy(c: Column) -> Column:
    """If there are level 1 and deeper headings but no level 2, all deeper ones move up so that 2 is used."""

    def moved(text: Column, ls: Column, levels: Column) -> Column:
        gap = F.array_min(F.filter(levels, lambda n: n > 1)) - 2
        wrong = F.array_contains(levels, 1) & ~F.array_contains(levels, 2) & (gap > 0)

        def shift(g: Column) -> Column:
            up = lambda x, n: F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(2), n - g)), F.regexp_replace(x, "^#+", ""))
            return unlines(F.zip_with(ls, levels, lambda x, n: F.when(n > 1, up(x, n)).otherwise(x)))

        return F.when(wrong, let(gap, shift)).otherwise(text)

    return let(c, lambda t: let(lines(t), lambda ls: let(F.transform(ls, _level), lambda n: moved(t, ls, n))))


def _without_lead(c: Column, quotes: bool = True) -> Column:
    """``c`` without what may stand before the number of a section: heading marks, a bullet, a quote, emphasis, in this order."""
    quote = r"(?:>\s++)?+" if quotes else ""
    return F.regexp_replace(c, rf"(?U)^\s*+#{{0,6}}+\s*+(?:[-*+]\s++)?+{quote}\*{{0,2}}+", "")


def _number(c: Column) -> Column:
    """The section number that ``c`` begins with, else '': parts of digits with single dots between."""
    return F.regexp_extract(c, r"(?U)^\d+(?:\.\d+)*", 0)


#: What a line has that begins with a number, as only this may stand before one.
_MAY_NUMBER = r"(?U)^[\s#*+>-]*\d"


def promoted(c: Column) -> Column:
    """Every line that begins with a number, marked or not, becomes a heading of the number's depth; not one whose
    number ends in a bracket."""

    def up(x: Column) -> Column:
        found = let(_without_lead(x), lambda bare: let(F.struct(bare.alias("bare"), _number(bare).alias("number")), lambda b: raised(x, b["bare"], b["number"])))
        return F.when(x.rlike(_MAY_NUMBER), found).otherwise(x)

    def raised(x: Column, bare: Column, number: Column) -> Column:
        rest = after(bare, F.length(number))
        title = rtrim(F.regexp_replace(rest, r"(?U)^[\s.:-]*+\*{0,2}+", ""))
        title = strip(F.regexp_replace(title, r"\*{1,2}$", ""))
        marks = F.repeat(F.lit("#"), F.least(F.lit(6), occurrences(number, ".") + 1))
        heading = let(title, lambda t: F.concat_ws(" ", marks, number, F.when(t != "", t)))
        return F.when((number != "") & ~rest.rlike(r"(?U)^[\s.:-]*+\)"), heading).otherwise(x)

    return each_line(c, up)


_PLAIN_HEADING = r"(?U)^\s*#{1,6}\s+(.*)$"


def _bare(x: Column) -> Column:
    return strip(F.btrim(strip(F.regexp_extract(x, _PLAIN_HEADING, 1)), F.lit("*")))


def demoted_front_matter(c: Column) -> Column:
    """Headings before the first numbered line become plain lines."""

    def over(ls: Column) -> Column:
        numbered = F.transform(ls, lambda x, i: F.when(x.rlike(_MAY_NUMBER) & (_number(_without_lead(x, quotes=False)) != ""), i))
        return let(
            F.coalesce(F.array_min(numbered), F.size(ls)),
            lambda first: unlines(F.transform(ls, lambda x, i: F.when((i < first) & x.contains("#") & x.rlike(r"(?U)^\s*#{1,6}\s+"), _bare(x)).otherwise(x))),
        )

    return let(lines(c), over)


def stripped_headings(c: Column) -> Column:
    """Headings whose title is not numbered become plain lines."""
    titled = lambda x: strip(F.regexp_extract(x, _PLAIN_HEADING, 1))
    return each_line(c, lambda x: F.when(x.contains("#") & x.rlike(_PLAIN_HEADING) & ~titled(x).rlike(r"(?U)^\d+(?:\.\d+)*\s"), _bare(x)).otherwise(x))


#: Lines that only name what a model has added.
CONTEXT_LABELS = ("Formula context for RAG", "RAG enrichment block")


def _is_label(line: Column) -> Column:
    """Whether a line is one of the labels, with any spacing and case, and maybe a colon."""
    said = F.lower(F.translate(line, WHITE, ""))
    return F.regexp_replace(said, ":$", "").isin(*(x.replace(" ", "").lower() for x in CONTEXT_LABELS))


def without_context_labels(c: Column) -> Column:
    """``c`` without the lines that are labels and the blank lines next to them."""
    kind = lambda x: F.when(_is_label(x), F.lit(2)).when(strip(x) == "", F.lit(0)).otherwise(F.lit(1))

    def kept(ls: Column) -> Column:
        return let(F.transform(ls, kind), lambda kinds: let(F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: F.get(kinds, i) > 0), lambda full: joined(ls, kinds, full)))

    def joined(ls: Column, kinds: Column, full: Column) -> Column:
        """The lines at the places ``full``, which are not blank, with the blank ones before them."""
        label = lambda k: F.get(kinds, F.get(full, k)) == 2

        def piece(i: Column, k: Column) -> Column:
            first = F.when(k == 0, F.lit(0)).when(label(k - 1), i).otherwise(F.get(full, k - 1) + 1)
            return F.when(label(k), F.array().cast("array<string>")).otherwise(F.slice(ls, first + 1, i - first + 1))

        last = F.element_at(full, -1)
        end = F.when(F.get(kinds, last) == 2, F.array(F.lit(""))).otherwise(F.slice(ls, last + 2, F.size(ls)))
        return F.array_join(F.concat(F.flatten(F.transform(full, piece)), end), "\n")

    def looked_at(text: Column) -> Column:
        """Lines are looked at where the text has the letters of a label; white space may part them."""
        said = F.lower(F.translate(text, WHITE, ""))
        some = [F.contains(said, F.lit(x.replace(" ", "").lower())) for x in CONTEXT_LABELS]
        out = let(F.split(text, "\n"), lambda ls: F.when(F.exists(ls, _is_label), kept(ls)).otherwise(text))
        return F.when(reduce(or_, some), out).otherwise(text)

    return let(c, looked_at)


def locally_normalized(c: Column, labels: bool = False) -> Column:
    """The rule-based normaliser for documents of numbered headings, with or without the removal of labels."""
    out = stripped_headings(promoted(with_hierarchy(demoted_front_matter(c))))
    return without_context_labels(out) if labels else out


def headings(c: Column, levels: bool = True) -> Column:
    """The headings outside fences: array of (line_index, level, text); without ``levels``, list items count, too."""
    return kernels.headings_udf(levels)(c)


def with_tree(c: Column) -> Column:
    """``c`` with its headings outside fences as one tree: the first is the only one of level 1, and none is more than a level
    below the one it belongs to, which is the last one above it of a lesser level, or else the first. Level 6 is the
    deepest. Only headings of marks change; their titles and all other lines stay.

    Headings are read off a stack of the levels on the way to the root, which grow from bottom to top.
    """

    def deeper(state: Column, level: Column) -> Column:
        kept = F.filter(state["stack"], lambda x: x < level)  # the rest belongs to headings that end here
        depth = F.when(state["n"] == 0, F.lit(1)).otherwise(F.least(F.lit(6), F.size(kept) + 2))
        stack = F.when(state["n"] == 0, state["stack"]).otherwise(F.concat(kept, F.array(level)))  # the first is below them all
        return F.struct((state["n"] + 1).alias("n"), stack.alias("stack"), F.concat(state["out"], F.array(depth)).alias("out"))

    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("n"), none.alias("stack"), none.alias("out"))

    def rebuilt(ls: Column, found: Column) -> Column:
        """The lines, with those of ``found`` (line_index, level) at their new levels."""
        levels = F.aggregate(F.transform(found, lambda h: h["level"]), start, deeper, lambda s: s["out"])

        def parts(new: Column) -> Column:
            at = lambda k: F.get(found, k)["line_index"]
            end = lambda k: F.coalesce(at(k + 1), F.size(ls))
            titled = lambda k, n: F.concat(F.repeat(F.lit("#"), n), ltrim(ltrim(F.get(ls, at(k))), "#"))
            piece = lambda n, k: F.concat(F.array(titled(k, n)), F.slice(ls, at(k) + 2, end(k) - at(k) - 1))
            return F.concat(F.slice(ls, F.lit(1), at(F.lit(0))), F.flatten(F.transform(new, piece)))

        return let(levels, lambda new: unlines(parts(new)))

    def over(ls: Column) -> Column:
        return let(marked_headings(ls), lambda found: F.when(F.size(found) > 0, F.concat(rebuilt(ls, found), F.when(c.endswith("\n"), F.lit("\n")).otherwise(F.lit("")))).otherwise(c))

    return let(lines(c), over)


def layered(docs: DataFrame, key: str = "source_file", text: str = "text", numbered=None, other=None) -> DataFrame:
    """``docs`` with ``text`` normalised stretch by stretch: sections whose headings are of one category are taken
    together, repaired by the normaliser of that category, and brought back to the level their first heading had."""
    plain = lambda c: without_context_labels(with_hierarchy(c))
    parts = docs.select(F.col(key).alias("_k"), F.posexplode(kernels.stretches_udf()(F.col(text))).alias("_n", "_s"))
    kind = heading_category(F.col("_s.heading"))
    kind = F.when(F.col("_s.heading").isNull(), F.lit(OTHER)).otherwise(kind)
    own = Window.partitionBy("_k").orderBy("_n")
    marked = parts.withColumn("_c", kind).withColumn("_new", (F.lag("_c").over(own) != F.col("_c")).cast("int"))
    runs = marked.withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(own)).groupBy("_k", "_run", "_c").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_s.text"))), lambda x: x["text"]), "").alias("_t"),
        F.min_by("_s.level", F.when(F.col("_s.level").isNotNull(), F.col("_n"))).alias("_level"),
    )
    done = F.when(F.col("_c") == NUMBERED, (numbered or (lambda c: plain(promoted(c))))(F.col("_t"))).otherwise((other or plain)(F.col("_t")))
    done = let(done, lambda t: F.when(F.col("_t").endswith("\n") & ~t.endswith("\n"), F.concat(t, F.lit("\n"))).otherwise(t))  # some drop the last end of line
    repaired = runs.select("_k", "_run", done.alias("_t"), "_level")

    def levelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["_t"] = [kernels.levelled(t or "", None if n is None or n != n else int(n)) for t, n in zip(b["_t"], b["_level"], strict=True)]
            yield b[["_k", "_run", "_t"]]

    levelled = repaired.mapInPandas(levelled, repaired.select("_k", "_run", "_t").schema)
    whole = levelled.groupBy("_k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_run", "_t"))), lambda x: x["_t"]), "").alias("_t"))
    joined = docs.join(whole, F.col(key) == F.col("_k"), "left")
    return joined.select(*(F.coalesce("_t", F.lit("")).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns))


def section_runs(docs: DataFrame, title: str, runs: dict, key: str = "source_file", text: str = "text") -> DataFrame:
    """(key, run, text): the sections whose heading is ``title``, as each of ``runs`` (name to Column function) leaves
    them; for looking at one section."""
    found = docs.select(key, F.explode(kernels.stretches_udf()(F.col(text))).alias("_s")).filter(F.col("_s.heading") == title)
    return found.select(key, F.explode(F.create_map(*(x for n, f in runs.items() for x in (F.lit(n), f(F.col("_s.text")))))).alias("run", "text"))


def external(call):
    """A normaliser made of ``call(text)``: a Column function whose result is null where the call raises."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else call(text)
        except Exception:
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype=object)

    return run


def refined(docs: DataFrame, text: str = "text", numbered=None, other=None) -> DataFrame:
    """Detect, route, repair: ``docs`` with ``text`` normalised, ``heading_format`` and ``backend``.

    ``numbered`` and ``other`` stand for external normalisers (Column to Column, see ``external``); where there is none
    or its result is null, the local repair of the hierarchy is all that is done, and the backend is ``fallback``.
    """
    found = docs.withColumn("_headings", headings(F.col(text)))
    found = found.withColumn("heading_format", document_format(F.transform("_headings", lambda h: h["text"]))["format"])
    of = lambda hook: hook(F.col(text)) if hook else F.lit(None).cast("string")
    made = found.withColumns({"_numbered": of(numbered), "_other": of(other)})
    made = made.withColumn("_made", F.when(F.col("heading_format") == NUMBERED, F.col("_numbered")).otherwise(F.col("_other")))
    backend = F.when(F.col("_made").isNull(), F.lit("fallback")).otherwise(F.lit("external"))
    repaired = without_context_labels(with_hierarchy(F.coalesce("_made", with_hierarchy(F.col(text)))))
    return made.withColumns({"backend": backend, text: repaired}).drop("_headings", "_numbered", "_other", "_made")
