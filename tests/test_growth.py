"""Work that a row takes: expressions that once grew with the number of their uses."""

import hashlib
import random

from pyspark.sql import functions as F

from quirespark.functions import kernels
from quirespark.operators import chunk, figures, models, normalize
from quirespark.plans import stages


def size(spark, *columns):
    """How much a plan with these columns says, a measure of what each row evaluates."""
    return len(spark.range(1).selectExpr("cast(id AS string) AS c", "array('a') AS a").select(*columns)._jdf.queryExecution().analyzed().toString())


def test_reports_label_the_headings_once(spark):
    found = normalize.report(F.col("a"), F.col("a"), F.col("a"))
    own = size(spark, F.transform("a", normalize.heading_category))
    assert size(spark, found) < 3 * own + 6000


def test_normalisers_repeat_no_step(spark):
    assert size(spark, normalize.locally_normalized(F.col("c"), labels=True)) < 30_000


def test_short_forms_equal_the_rules(spark):
    """Numbers, what leads them, and tags, against plain Python."""
    rng = random.Random(3)
    rows = ["".join(rng.choice(["#", " ", "-", "*", ">", "1", "2", ".", ")", "a", "\t", " ", ":"]) for _ in range(rng.randint(0, 9))) for _ in range(3000)]

    def number(x):
        lead = 0
        while lead < len(x) and (x[lead].isdecimal() or x[lead] == "."):
            lead += 1
        parts = x[:lead].split(".")
        return ".".join(parts[: parts.index("")] if "" in parts else parts)

    def less(x, mark, most):
        return x[min(most, len(x) - len(x.lstrip(mark))) :]

    def marked(x, marks):
        return x[1:].lstrip() if x[:1] and x[:1] in marks and x[1:].lstrip() != x[1:] else x

    def bare(x):
        return less(marked(marked(less(x.lstrip(), "#", 6).lstrip(), "-*+"), ">"), "*", 2)

    def raised(x):
        n = number(bare(x))
        rest = bare(x)[len(n) :]
        title = less(rest.lstrip(" \t .:-"), "*", 2).rstrip()
        title = less(title[::-1], "*", 2)[::-1].strip()
        listed = ")" in rest[: len(rest) - len(rest.lstrip(" \t .:-)"))]
        return x if not n or listed else " ".join(["#" * min(6, n.count(".") + 1), n, *([title] if title else [])])

    got = spark.createDataFrame([(x,) for x in rows], "x string").select("x", normalize.promoted(F.col("x")).alias("y")).collect()
    assert [(r.x, r.y) for r in got if r.y != raised(r.x)] == []


def test_blocks_are_found_once_a_document(monkeypatch):
    text = "# A\n\nx\n\n$$a$$\nwhere a = 1\n\n| p |\n|---|\n| 1 |\n\nnote"
    want, calls, blocks = chunk._typed(text, 2048, 300), [], kernels.blocks
    monkeypatch.setattr(kernels, "blocks", lambda *a, **k: calls.append(a) or blocks(*a, **k))
    assert chunk._typed(text, 2048, 300) == want and len(calls) == 1
    assert [r["content_type"] for r in want] == ["equation", "table", "text"]


def test_typed_chunks_are_compared_without_their_texts(spark):
    plan = stages.chunk_typed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    window = next(x for x in plan.splitlines() if "Window [row_number" in x and "chunk_id" in x)
    below = plan.split(window)[1].split("MapInPandas")[0]
    assert " AS text_md5" in below


def test_recursive_chunks_leave_a_task_in_bounded_frames(spark):
    plan = stages.chunk_recursive(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "ArrowEvalPython" not in plan


def test_words_go_to_an_embedder_as_one_string(spark):
    texts = spark.createDataFrame([("a b A",), ("",), (None,), ("x\u2003y",)], "t string")
    made = texts.select("t", models.hashed_embedding(F.col("t"), 4).alias("v"))
    assert "array_join" in made._jdf.queryExecution().optimizedPlan().toString()
    rows = [r.v for r in made.collect()]
    assert rows[1] == rows[2] == [0.0] * 4 and abs(sum(x * x for x in rows[0]) - 1) < 1e-9


def test_figures_are_found_once_and_asked_about_in_one_row(spark):
    """References are taken out of a text once, and an image goes to Python once, however many models see it."""
    for made in (stages.figure_models, stages.figure_model_totals):
        plan = made(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate inline") == 1 and "explode" not in plan and "collect_list" not in plan


def test_answers_are_looked_into_once(spark):
    uses = lambda c, what: spark.range(1).selectExpr("cast(id AS string) AS c").select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count(what)
    assert uses(figures.confidence(F.col("c"), F.lit(True)), "get_json_object") == 2 + len(figures.REQUIRED)
    assert uses(figures.parsed(F.col("c")), "regexp_replace") == 2


def test_every_kind_of_match_takes_the_least_path(spark):
    """Images of a document in any order: the same path, else the same name, else the same stem, against plain Python."""
    rng = random.Random(5)
    some = lambda: rng.choice(["", "a/", "b/", "A/"]) + rng.choice(["x", "X", "y"]) + rng.choice([".png", ".PNG", ".jpg"])
    refs = [(rng.choice(["k", "l", None]), i, some()) for i in range(120)] + [("k", 998, None), ("m", 999, "x.png")]
    files = [(rng.choice(["k", "l", None]), f"/{rng.randint(0, 9)}/{i}", some()) for i in range(14)] + [("k", "/0", None), ("m", None, "x.png")]
    name = lambda x: x.rsplit("/", 1)[-1].lower()
    stem = lambda x: name(x).rsplit(".", 1)[0]

    def best(key, rel):
        own = [(0 if r == rel else 1 if name(r) == name(rel) else 2, p) for k, p, r in files if rel and r and p and k is not None and k == key and stem(r) == stem(rel)]
        return min(own)[1] if own else None

    got = figures.resolved(spark.createDataFrame(refs, "key string, ordinal int, rel_path string"), spark.createDataFrame(files, "key string, path string, rel_path string"))
    assert got.columns == ["key", "ordinal", "rel_path", "path"]
    assert {r.ordinal: r.path for r in got.collect()} == {i: best(k, x) for k, i, x in refs}


def test_an_image_listed_twice_is_asked_about_once(spark):
    docs = spark.createDataFrame([("b", "![a](a.png)\n![n](n.png)\n![m](m.png)")], "source_file string, text string")
    images = spark.createDataFrame([("b", "/a.png", "a.png", b"x"), ("b", "/a.png", "a.png", b"x"), ("b", "/n.png", "n.png", None)], "key string, path string, rel_path string, content binary")
    said = {"one": lambda p, u: '{"figure_id": "' + u[-4:] + '"}', "two": lambda p, u: "no"}
    rows = {r.rel_path: r for r in figures.extracted(docs, images, said, delay=0.0, tries=1, workers=3).collect()}
    assert [(r.model, r.output) for r in rows["a.png"].results] == [("one", '{"figure_id": "eA=="}'), ("two", "no")] and len(rows) == 3
    assert [r.output for r in rows["n.png"].results] == [None, None] and rows["n.png"].status == "error"
    assert rows["m.png"].results is None and rows["m.png"].status == "missing"


def test_texts_and_images_stay_off_the_driver_and_paths_are_read_once(spark):
    plan = stages.figure_model_totals(spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert "Broadcast" not in plan.sparkPlan().toString()
    assert "regexp_extract(original_ref" not in plan.optimizedPlan().toString()


def test_ids_of_parents_and_children_take_no_texts_along(spark):
    """Texts stay in the task that makes them, no row is sorted but those whose id others have, and what is said of a chunk is what
    the whole chunks say."""
    plan = stages.chunk_parent_child(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "MapIn" not in plan and "text" not in plan
    assert "Window" not in stages.order_docs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    text = "# A\n\nx\n\n$$a$$\nwhere a = 1\n\n| p | q | p |\n|---|---|---|\n| 1 | 2 | 3 |\n| 4 |\n\n| only |\n\nx\n\nx" + "\n\nword " * 400
    docs = spark.createDataFrame([("a", text), ("b", "$$a$$\n\n$$a$$"), ("b", "$$a$$"), (None, "x"), ("c", None), ("d", "| a |")], "source_file string, text string")
    whole = chunk.parent_child_chunks(docs).selectExpr("chunk_id", "parent_id", "chunk_role", "content_type", "source_file", "size(child_ids) AS n_children", "text", "child_ids", "child").collect()
    assert sorted(map(str, (r[:6] for r in whole))) == sorted(str(tuple(r)) for r in chunk.parent_child_ids(docs).collect())
    children = {r.chunk_id for r in whole if r.chunk_role == "child"}
    assert all(set(r.child_ids) <= children and bool(r.child_ids) == (r.child < 0 and r.n_children > 0) for r in whole)
    assert [(r.parent_id, r.n_children) for r in whole if r.source_file == "b" and r.chunk_role == "parent"] == [(None, 1)]
    suffix = {"text": "_child", "equation": "_eq_child", "table": "_tbl_child_"}
    spelled = {chunk_of(r.source_file, suffix[r.content_type] + str(r.child) * (r.content_type == "table"), r.text) for r in whole if r.chunk_role == "child" and r.source_file == "a"}
    assert spelled == {r.chunk_id for r in whole if r.chunk_role == "child" and r.source_file == "a"}
    rows = [r.text.split("\n", 3)[3] for r in whole if r.source_file == "a" and r.content_type == "table" and r.child >= 0]
    assert sorted(rows) == ["|  |  |", "|  |  |", "| 3 | 2 |"]


def chunk_of(source, suffix, text):
    return "chunk_" + hashlib.md5(f"{source}{suffix}::{text[:120]}".encode()).hexdigest()[:12]
