"""Golden values and properties of the operators, in plain Python where a kernel is plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirespark.functions import fences, kernels
from quirespark.functions import text as T
from quirespark.operators import chunk, enrich, figures, models, normalize, retrieve


@pytest.fixture(scope="module")
def value(spark):
    def of(column, text=None):
        return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first().v

    return of


@pytest.fixture(scope="module", autouse=True)
def column(spark):
    """Columns need a session, so the one that tests use is made with it."""
    global t
    t = F.col("t")


@pytest.mark.parametrize(
    ("text", "want", "links"),
    [
        ("## **[Foreword](#page-6-0)**", "## **Foreword**", 1),
        ("hazard[,1](#page-68-0)", "hazard,1", 1),
        ("[2 Loads](#page-9-1) **17**", "2 Loads **17**", 1),
        ("[2 Loads](#page-9-1) 17**\n", "2 Loads**\n", 1),
        ("[2 Loads](#page-9-1) applies in 1999", "2 Loads applies in 1999", 1),
        ("[x](http://a) [y](#fig-1)", "[x](http://a) [y](#fig-1)", 0),
        ("[a]( #Page3 ) and [b](#page_3-1_2)", "a and b", 2),
        ("[ii Preface ](#page-3) xii", "ii Preface", 1),
        ("[x](#page-1-2-3-4)", "[x](#page-1-2-3-4)", 0),
        ("", "", 0),
    ],
)
def test_page_links(value, text, want, links):
    assert tuple(value(normalize.without_page_links(t), text)) == (want, links)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('a<span id="page-31-0">Page 31</span>b', "ab"),
        ('a<span id="section-1"></span>b', "ab"),
        ('<span id="n">keep</span>', '<span id="n">keep</span>'),
        ('<SPAN class="c" id=page-2> &nbsp;</SPAN>x', "x"),
        ("<span id='page-3'>pages 3</span>", "<span id='page-3'>pages 3</span>"),
    ],
)
def test_page_spans(value, text, want):
    assert value(normalize.without_page_spans(t)["text"], text) == want


def test_hierarchy(value):
    assert value(normalize.with_hierarchy(t), "# a\n### b\n#### c") == "# a\n## b\n### c"
    assert value(normalize.with_hierarchy(t), "# a\n## b\n#### c") == "# a\n## b\n#### c"
    once = value(normalize.with_hierarchy(t), "# a\n##### b")
    assert value(normalize.with_hierarchy(t), once) == once


@pytest.mark.parametrize(("text", "want"), [("- 3 apples", "# 3 apples"), ("## **2.1 Scope**", "## 2.1 Scope"), ("1) item", "1) item"), ("3D printing", "# 3 D printing"), ("plain", "plain")])
def test_promoted(value, text, want):
    assert value(normalize.promoted(t), text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a\n\nFormula context for RAG:\n\nb\n", "a\nb\n"),
        ("rag  enrichment BLOCK\nRAG enrichment block:\n  b", "  b"),
        ("a\n RAG enrichment block", "a\n"),
        ("RAG enrichment blocks\n\nx", "RAG enrichment blocks\n\nx"),
        ("Formula context for RAG", ""),
        (None, None),
    ],
)
def test_context_labels(value, text, want):
    assert value(normalize.without_context_labels(t), text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("Figure 3: short\nFig. 2.1 – A pump", "short"), ("figures 3\nCaption\n  on the next line\n", "on the next line"), ("fig 4 abc", ""), (" FIG.7-1: a long caption", "a long caption")],
)
def test_captions(value, text, want):
    assert value(figures.context(t, F.lit(0), F.lit(""))["caption"], text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("**1. INTRODUCTION**", "numbered"), ("<b>3.2</b> Scope", "numbered"), ("> 4 Loads", "numbered"), ("Foreword", "non-numbered"), ("2nd edition", "non-numbered")],
)
def test_heading_category(value, text, want):
    assert value(normalize.heading_category(t), text) == want


def test_headings_and_fences():
    text = "# A #\n```\n# no\n~~~\n# no\n```\nTitle\n===\n\n1. item\n2. item\n\n3. alone\n\n2.1 Scope\n\n"
    assert [(h["level"], h["text"]) for h in kernels.headings(text)] == [(1, "A"), (1, "Title"), (1, "3. alone"), (2, "2.1 Scope")]
    assert kernels.headings(None) == [] and kernels.headings("") == []


def test_strict_format(value):
    assert value(normalize.strict_format(F.array(F.lit("1 a"), F.lit("2 b"), F.lit("2.1 c")))) == "numbered"
    assert value(normalize.strict_format(F.array(F.lit("Foreword"), F.lit("Index")))) == "non-numbered"


def test_lines(value):
    for text in ("", "a", "a\n", "a\r\nb\x0bc", "\n\n", "x y\x85z"):
        assert value(T.lines(t), text) == text.splitlines()


def test_math_scan(value):
    assert value(enrich.formulas(t), "a $x$ b $$y$$ c $z") == ["$x$", "$$y$$"]
    assert value(enrich.formulas(t), "foo$$$ bar$$$ x") == ["$$ bar$$"] or value(enrich.formulas(t), "foo$$$ bar$$$ x") == ["$$$ bar$$"]


def test_echoes():
    text = "### STEP 2 — Add RAG enrichment block\nSTEP 1 — Fix the LaTeX (if needed):\nStep 3: Open the valve\n#### **Domain keywords:** foo\nx<sup>r</sup> <sup> y\n"
    assert kernels.without_echoes(text) == {"text": "Step 3: Open the valve\n**Domain keywords:** foo\nx y\n", "steps": 2, "labels": 1, "sups": 2}


def test_table_widths():
    assert kernels.with_table_widths("|a|bb|\n|-|-|\n|long cell|\n||\nend\n") == "| a         | bb  |\n|-----------|-----|\n| long cell |     |\nend"


def test_table_rows():
    assert kernels.table_rows("| a | b | a |\n|---|---|---|\n| 1 | 2 | 3 |\n| 4 |\n") == [{"a": "3", "b": "2"}, {"a": "", "b": ""}]


def test_ids(value):
    assert value(T.chunk_id(F.lit("a.md"), F.lit("hello"))) == "chunk_27f314a2ee36"
    assert value(T.chunk_id(F.lit("a.md_child"), F.lit("hello"))) == "chunk_35d6a79c8b2e"
    assert value(T.indexed_id(F.lit("a.md"), F.lit(1295))) == "cb00azz"


def test_equations_stay_apart():
    text = "$$a$$\nprose\n\n$$\nb\n$$\n\nwhere b = 1\n- c = 2\n\nmore"
    assert kernels.equations(text) == ["$$a$$", "$$\nb\n$$\n\nwhere b = 1\n- c = 2"]


def test_tables_with_what_belongs_to_them():
    text = "# Head\n\n**Table subject:** loads\n|a|b|\n|-|-|\n|1|2|\n\n|3|4|\n\nnote\n\nelse"
    (found,) = kernels.tables(text)
    assert found["heading"] == "Head" and found["text"] == "Head\n**Table subject:** loads\n|a|b|\n|-|-|\n|1|2|\n|3|4|\nnote"
    assert found["rows"] == [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}]


def test_split_covers_the_text():
    rng = random.Random(0)
    for _ in range(50):
        text = "".join(rng.choice(["word ", "x" * 30, "\n", "\n\n", ". ", "Ü"]) for _ in range(rng.randrange(200)))
        assert all(len(p) <= 120 for p in kernels.split(text, 120, 30))
        assert "".join("".join(kernels.split(text, 120, 0)).split()) == "".join(text.split())


def test_blocks_are_never_cut():
    table = "\n".join(["| key | value |", "|---|---|", *(f"| {i} | {'v' * 40} |" for i in range(40))])
    formula = "$$\n" + "\n".join(f"x_{i} = y" for i in range(60)) + "\n$$"
    text = "# A\n\n" + "words and words. " * 60 + f"\n\nTable 1\n{table}\n\n" + "more words. " * 80 + f"\n\n{formula}\nwhere x = y\n"
    pieces = chunk._whole_or_split(text, 500, 50, kernels.PROSE_SEPARATORS)
    pieces = [p for p, _ in pieces]
    assert sum(table in p for p in pieces) == 1 and sum(formula in p for p in pieces) == 1
    assert not any("" in p for p in pieces) and len(pieces) > 4


def test_chunk_tables(spark):
    rows = "\n".join(f"| {i} | r{i} |" for i in range(11))
    text = "# 6.2.1 Loads\n\n" + "Some prose here. " * 200 + f"\n\n$$a$$\nwhere a = 1\n\n| k | v |\n|---|---|\n{rows}\n"
    docs = spark.createDataFrame([("a.md", text), ("b.md", "only prose"), ("c.md", ""), ("d.md", None)], "source_file string, text string")
    out = chunk.parent_child_chunks(docs).collect()
    parents = {r.chunk_id: r for r in out if r.chunk_role == "parent"}
    children = [r for r in out if r.chunk_role == "child"]
    assert all(r.parent_id in parents and r.chunk_id in parents[r.parent_id].child_ids for r in children)
    assert sum(r.content_type == "table" for r in children) == 4
    assert {r.content_type for r in chunk.parent_child_chunks(docs, compat=True).collect()} == {"equation", "table"}
    (head,) = {(r.heading_path, r.section, r.parent_section) for r in chunk.hierarchical_chunks(docs).filter("source_file = 'a.md'").collect()}
    assert head == ("6.2.1 Loads", "6.2.1", "6.2")
    assert {r.content_type for r in chunk.typed_chunks(docs).filter("source_file = 'a.md'").collect()} == {"text", "equation", "table"}
    assert chunk.atomic_chunks(docs).filter("source_file = 'b.md'").count() == 1


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, "a c c"), (2, "d")], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "c"), (1, "A"), (2, "c c"), (3, "zzz")], "query_id long, text string")
    got = {(r.query_id, r.doc_id): r.bm25 for r in retrieve.bm25(docs, asked).collect()}
    want = {(0, 1): 0.628708, (1, 0): 0.063853, (1, 1): 0.052125, (2, 1): 1.257417}
    assert got == pytest.approx(want, abs=2e-6)


def test_min_max(spark):
    rows = spark.createDataFrame([(0, 1, 2.0), (0, 2, 4.0), (1, 1, 3.0), (1, 2, 3.0)], "query_id long, doc_id long, s double")
    got = {(r.query_id, r.doc_id): r.s_norm for r in retrieve.min_max(rows, "s").collect()}
    assert got == {(0, 1): 0.0, (0, 2): 1.0, (1, 1): 1.0, (1, 2): 1.0}
    sparse = {(r.query_id, r.doc_id): r.s_norm for r in retrieve.min_max(rows, "s", F.lit(3)).collect()}
    assert sparse == {(0, 1): 0.5, (0, 2): 1.0, (1, 1): 1.0, (1, 2): 1.0}


def test_mmr():
    assert retrieve.mmr_order([0.9, 0.85, 0.6], np.array([[1, 0], [1, 0], [0, 1]]), 3, 0.7) == [0, 2, 1]
    assert retrieve.mmr_order([0.5, 0.5], np.array([[0, 0], [1, 1]]), 5) == [0, 1]


def test_dense_by_one_matrix_and_by_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(60, [0.0] * 8)]
    corpus = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    asked = corpus.filter("doc_id < 5").withColumnRenamed("doc_id", "query_id")
    one = {tuple(r) for r in retrieve.dense(corpus, asked, 7).collect()}
    monkeypatch.setattr(retrieve, "MATRIX_QUERIES", 2)
    monkeypatch.setattr(retrieve, "MATRIX_DOCS", 20)
    assert len(one) == 35 and one == {(r.query_id, r.doc_id, r.dense, r["rank"]) for r in retrieve.dense(corpus, asked, 7).collect()}


def test_dense_takes_odd_vectors_for_zero(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [1.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [2.0, 0.0]), (6, [])]
    corpus = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    asked = corpus.filter("doc_id IN (0, 1, 5)").withColumnRenamed("doc_id", "query_id")
    got = {(r.query_id, r.doc_id): r.dense for r in retrieve.dense(corpus, asked, 9).collect()}
    assert got == {(q, d): float(q in (0, 5) and d in (0, 5)) for q in (0, 1, 5) for d in range(7)}
    assert {r.dense for r in retrieve.dense(corpus, asked.filter("query_id = 1"), 9).collect()} == {0.0}
    assert retrieve.dense(corpus, asked.limit(0), 9).collect() == [] == retrieve.dense(corpus.limit(0), asked, 9).collect()


@pytest.mark.parametrize("setting", [("BROADCAST_TERMS", 3), ("MATRIX_CELLS", 8)])
def test_bm25_by_other_plans(spark, monkeypatch, setting):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(rng.randrange(9)))) for i in range(80)] + [(90, None)], "doc_id long, text string")
    asked = spark.createDataFrame([("p", "a b b"), ("q", "c zz"), ("r", "dd e f a"), ("s", "none"), ("t", None)], "query_id string, text string")
    want = sorted(map(tuple, retrieve.bm25(docs, asked).collect()))
    best = {(r.query_id, r.doc_id) for r in retrieve.ranked(retrieve.bm25(docs, asked, top=5), "bm25", 5).collect()}
    assert best == {(r.query_id, r.doc_id) for r in retrieve.ranked(retrieve.bm25(docs, asked), "bm25", 5).collect()} and len(want) > 50
    monkeypatch.setattr(retrieve, *setting)
    got = sorted(map(tuple, retrieve.bm25(docs, asked).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-6)
    assert retrieve.bm25(docs, asked.limit(0)).collect() == []
    stats = retrieve.corpus_stats(docs).first()
    assert stats.n_docs == 81 and retrieve.corpus_stats(docs.limit(0)).first().n_docs == 0


def test_confidence(value):
    full = '{"figure_id": "f", "figure_type": "t", "caption_summary": "c", "confidence": 0.9, "extracted_text": "0123456789"}'
    ok = lambda raw: value(figures.confidence(F.col("t"), F.lit(True)), raw)
    assert ok(full) == pytest.approx(0.9)
    assert ok("{}") == 0.0 or ok("{}") == pytest.approx(0.0, abs=1e-9)
    assert value(figures.confidence(F.col("t"), F.lit(False)), full) == 0.0


def test_parsed_answers(value):
    assert value(figures.parsed(t)["valid"], '```json\n{"a": 1}\n```') and value(figures.parsed(t)["valid"], 'Sure {"a": 1} ok')
    assert not value(figures.parsed(t)["valid"], "nothing") and not value(figures.parsed(t)["valid"], "[1]")


def test_judged(value):
    assert value(models.judged(t), "**Result Accuracy**: Yes, same value") == "Yes"
    assert value(models.judged(t), "no verdict") == ""


def test_adapter_retries(spark):
    asked = spark.createDataFrame([("good",), ("bad",)], "prompt string")

    def client(text):
        if text == "bad":
            raise ValueError
        return text.upper()

    out = {r.prompt: r.output for r in models.called(client, tries=2, wait=lambda n, error: 0)(asked).collect()}
    assert out == {"good": "GOOD", "bad": None}


def test_aliases(spark):
    assert models.resolved(spark.createDataFrame([("a", "b")], "`Gold Answer` string, `QUERY` string"), "answer") == "Gold Answer"
    with pytest.raises(ValueError):
        models.resolved(spark.range(1), "question")


def test_contexts(spark):
    rows = [(0, 1, "a" * 400), (1, 1, "x" * 100), (1, 2, "y" * 100), (1, 3, "z" * 300)]
    out = {r.query_id: (len(r.context), r.used) for r in retrieve.contexts(spark.createDataFrame(rows, "query_id long, rank int, segment string"), 1).collect()}
    assert out == {0: (320, 1), 1: (201, 2)}


def test_setext_underlines_at_any_indent():
    text = "Title\n        ===\n\nOther\n\t---\ntext\n\n    ---\n"
    assert [(h["line_index"], h["level"], h["text"]) for h in kernels.headings(text)] == [(0, 1, "Title"), (3, 2, "Other")]


@pytest.mark.parametrize(
    ("line", "want"),
    [("1 Scope", (1, "1 Scope")), ("1. Scope", None), ("1: Scope", (1, "1: Scope")), ("2.3) Scope", (2, "2.3) Scope")), ("    1 code", None), ("1.)", None), ("1.", None), ("1..2 x", None), ("##### x ##", (5, "x")), ("####### x", None), ("#x", None), ("٣ Arabic", (1, "٣ Arabic"))],
)
def test_heading_lines(line, want):
    found = [(h["level"], h["text"]) for h in kernels.headings(f"a\n{line}\nb")]
    assert found == ([want] if want else [])


def test_list_items_count_without_levels():
    assert [h["text"] for h in kernels.headings("a\n1. b\n2) c", levels=False)] == ["1. b", "2) c"]


def test_cells():
    assert kernels.cells("| a | b |") == ["a", "b"] and kernels.cells("||a||") == ["", "a", ""] and kernels.cells("a|b||") == ["a", "b"]
    assert kernels.cells("||") == [""] and kernels.cells("|") == [""] and kernels.cells("|  | a") == ["", "a"]
    assert kernels.with_table_widths("|-|-|\n|:-|\n") == "|-|-|\n|:-|" and kernels.table_rows("|-|") == []
    assert kernels.with_table_widths("|a|\n|-|-|-|") == "| a   |     |     |\n|-----|-----|-----|"


def test_long_comments_stay_whole():
    comment = "<!-- RAG-META\n" + "\n".join(f"key {i}" for i in range(400)) + "\n-->"
    assert kernels.blocks(f"a\n{comment}\nb") == [("text", 0, 1), ("meta", 1, 403), ("text", 403, 404)]
    assert kernels.blocks("<!-- RAG-META open\nb") == [("text", 0, 2)] and kernels.blocks("<!-- other -->") == [("text", 0, 1)]
    (found,) = kernels.tables("# H\n<!-- RAG-META x -->\n\n|a|\n|-|\n|1|\n")
    assert found["text"] == "<!-- RAG-META x -->\nH\n|a|\n|-|\n|1|"


def test_blocks_of_the_hierarchical_strategy():
    text = "```\n|a|\n```\n$$x$$\n- x = 1\n\nend"
    assert [k for k, _, _ in kernels.blocks(text)] == ["text", "equation", "text"]
    assert kernels.blocks(text, fenced=False, lists=True) == [("text", 0, 1), ("table", 1, 2), ("text", 2, 3), ("equation", 3, 5), ("text", 5, 7)]


def test_titles_and_notes_of_tables():
    text = "Some words\n|a|\n|-|\n\nnote on it\n\nelse"
    (whole,) = [p for p, _ in chunk._whole_or_split(text, 5, 0, kernels.PROSE_SEPARATORS, notes=True) if "|a|" in p]
    assert whole == "Some words\n|a|\n|-|\n\nnote on it"
    cut = [p for p, _ in chunk._whole_or_split(text, 5, 0, kernels.PROSE_SEPARATORS, chunk.table_title)]
    assert "|a|\n|-|" in cut


def test_section_headings_follow_blocks():
    body = "\n".join(f"|{i}|" for i in range(50))
    text = f"# One\n\n|k|\n|-|\n{body}\n\n# Two\n\n" + "words here. " * 40
    pieces = chunk._whole_or_split(text, 200, 20, kernels.PROSE_SEPARATORS)
    above = kernels.headings_above(text.split("\n"))
    assert [above[line + 1] for _, line in pieces][-1] == "Two" and above[pieces[0][1] + 1] == "One"


def test_label_runs_leave_the_prose():
    found = chunk._typed("Words.\n\n**Table subject:** loads\n**Property type:** x\n|a|\n|-|\n|1|\n\nMore.\n\n**Table subject:** alone\n", 500, 0)
    assert [r["text"] for r in found if r["content_type"] == "text"] == ["Words.\n\nMore.\n\n**Table subject:** alone"]


def test_schema_tables(value):
    assert value(chunk.is_schema_table(t), "| Column header | Unit |\n|---|---|\n| a | b |") is True
    assert value(chunk.is_schema_table(t), "| Unit |\n|---|\n| b |") is False
    assert value(chunk.is_schema_table(t), "| Column header | Unit |\n" + "| a | b |\n" * 10) is False


def test_dropped_chunks(spark):
    docs = spark.createDataFrame([("a.md", "x" * 130 + " one"), ("a.md", "x" * 130 + " two")], "source_file string, text string")
    assert [r.dropped for r in chunk.drops(chunk.typed_chunks(docs, distinct=False)).collect()] == [1]


def test_warnings(value):
    found = lambda x: value(figures.conversion_warnings(t), x)
    assert found("| a | \n|b") == [figures.BROKEN_ROW + "2"] and found("x ≤ y") == [figures.NO_TABLES, figures.NO_MATH]
    assert found("| a = b |") == [figures.NO_MATH] and found("| a = b | $x$ |") == []


def test_resolved_images(spark):
    refs = spark.createDataFrame([("b", "img/A.png"), ("b", "img/A.png"), ("b", "x/none.png"), ("b", "C.jpeg")], "key string, rel_path string")
    files = spark.createDataFrame([("b", "/1/img/A.png", "img/A.png"), ("b", "/1/a.PNG", "a.PNG"), ("b", "/1/c.png", "c.png"), ("z", "/2/C.jpeg", "C.jpeg")], "key string, path string, rel_path string")
    assert sorted((r.rel_path, r.path) for r in figures.resolved(refs, files).collect()) == [("C.jpeg", "/1/c.png"), ("img/A.png", "/1/img/A.png"), ("img/A.png", "/1/img/A.png"), ("x/none.png", None)]


def test_external_normalisers_fall_back(spark):
    def call(text):
        if "bad" in text:
            raise ValueError
        return text.upper()

    docs = spark.createDataFrame([("# 1 good",), ("# 1 bad\n### x",), ("# Annex",)], "text string")
    out = {(r.backend, r.heading_format, r.text) for r in normalize.refined(docs, numbered=normalize.external(call)).collect()}
    assert out == {("external", "numbered", "# 1 GOOD"), ("fallback", "numbered", "# 1 bad\n## x"), ("fallback", "non-numbered", "# Annex")}


def test_batch_adapters(spark):
    rows = spark.createDataFrame([("q", "aa"), ("q", None)], "question string, text string")
    out = {r.text: r for r in models.scores(lambda p: [float(len(t)) for _, t in p])(models.vectors(lambda ts: [[3.0 * len(t), 0.0] for t in ts])(rows)).collect()}
    assert out["aa"].embedding == [1.0, 0.0] and out["aa"].rerank == 2.0 and out[None].embedding is None and out[None].rerank == 0.0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("### a\n# b\n##### c\n### d\n# e\n", "# a\n## b\n### c\n### d\n## e\n"),
        ("intro\n## a ##\n```\n# no\n```\n#### b", "intro\n# a ##\n```\n# no\n```\n## b"),
        ("# a\n## b\n### c\n#### d\n##### e\n###### f\n###### g", "# a\n## b\n### c\n#### d\n##### e\n###### f\n###### g"),
        ("no heading\n", "no heading\n"),
        ("", ""),
        ("  ### a\n1.2 number\n## b", "# a\n1.2 number\n## b"),
    ],
)
def test_heading_tree(value, text, want):
    assert value(normalize.with_tree(t), text) == want
    assert value(normalize.with_tree(t), want) == want


def test_marks_of_blocks_stand_in_no_text(spark):
    formula = "$$\nE = mc^2\n$$"
    text = f"\ue000000000\ue001 is text\n\n{formula}\n\nmore \ue000000000\ue001 {chr(0xE002)}"
    pieces = [p for p, _ in chunk._whole_or_split(text, 4000, 0, chunk.PROSE_SEPARATORS)]
    assert "\n".join(pieces).count("E = mc^2") == 1 and "\n".join(pieces).count("\ue000000000\ue001") == 2


@pytest.mark.parametrize("replaces", [False, True])
def test_fenced_stretches_equal_a_scan(spark, replaces):
    rng = random.Random(8)
    texts = [[rng.choice(["```", "~~~", " ```py", "text", "# h", "   ## x", "    # deep", "#no", "#", "####### seven", "\t~~~"]) for _ in range(rng.randint(0, 14))] for _ in range(400)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, ls array<string>")
    for r in rows.select("ls", fences.fenced(F.col("ls"), replaces).alias("f"), fences.marked_headings(F.col("ls")).alias("h")).collect():
        fence = kernels.Fence(replaces)
        inside = [fence.inside(x) for x in r.ls]
        assert [any(s.start <= i < s.stop for s in r.f) for i in range(len(r.ls))] == inside
        if not replaces:
            assert [(h.line_index, h.level) for h in r.h] == [(i, kernels._hashed(x)[0]) for i, x in enumerate(r.ls) if not inside[i] and kernels._hashed(x)]
