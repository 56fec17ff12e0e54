"""Sources and sinks on small trees, and that the library stands without the training-data operators."""

import json
import time
from collections import Counter
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quirespark.functions import registry
from quirespark.operators import calls, enrich, figures, models
from quirespark.sources import readers, sinks, tree
from quirespark.streaming import incremental


def test_markdown_tree(spark, tmp_path):
    for name, data in (("a.md", b"# A\n"), ("sub/b.MD", b"bad \xff byte"), ("out/c.md", b"no"), ("d.txt", b"no")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r.rel_path: r.text for r in readers.markdown(spark, str(tmp_path), exclude="out").collect()}
    assert rows == {"a.md": "# A\n", "sub/b.MD": "bad � byte"}
    assert {r.book for r in readers.books(readers.markdown(spark, str(tmp_path))).collect()} == {"", "sub", "out"}


def test_chunks(spark, tmp_path):
    lines = ['{"text": "one"}', "", "no json", '{"text": null}', "[1]", '{"text": " "}', '{"text": "two"}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    rows = [(r.source, r.line, r.chunk_index, r.text) for r in readers.chunks(spark, str(tmp_path)).orderBy("line").collect()]
    assert rows == [("x.jsonl", 1, 0, "one"), ("x.jsonl", 7, 1, "two")]
    assert len(readers.signature(spark, str(tmp_path)).first().signature) == 64


def test_records(spark, tmp_path):
    for name, obj in (("a", [1, {"x": 2}]), ("b", {"items": [{"y": 1}]}), ("c", {"z": 3}), ("d", 5)):
        (tmp_path / f"{name}.json").write_text(json.dumps(obj))
    (tmp_path / "bad.json").write_text("{")
    rows = {(r.source, r.ordinal): json.loads(r.record) for r in readers.records(spark, str(tmp_path)).collect()}
    assert rows == {("a.json", 0): 1, ("a.json", 1): {"x": 2}, ("b.json", 0): {"y": 1}, ("c.json", 0): {"z": 3}, ("d.json", 0): {"value": 5}}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("math", "a", None), ("table", "b", "c\x01")], "task string, input string, output string")
    sinks.pair_logs(rows, f"{tmp_path}/logs")
    assert {p.name for p in Path(tmp_path, "logs").iterdir() if p.is_dir()} == {"kind=Formulas", "kind=Tables"}
    sheet = sinks.result_sheet(rows, F.col("task"), F.col("input"), F.lit(""), F.col("output")).collect()
    assert sheet[1].Result == "c"


def test_stream_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: incremental.run_once(incremental.markdown_stream(spark, f"{tmp_path}/in"), lambda d: d, f"{tmp_path}/out", f"{tmp_path}/cp")
    (tmp_path / "in/a.md").write_text("a")
    run()
    (tmp_path / "in/b.md").write_text("b")
    run()
    run()
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]


def test_stands_without_training_data_operators(tmp_path):
    root = Path(__file__).parent.parent
    code = f"import sys; sys.modules['quirespark.llm'] = None; sys.path.insert(0, {str(root)!r}); import __spark_entry__ as e; assert 'bm25_topk' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_chunks_over_splits(spark, tmp_path):
    """Numbers of lines go on over the splits of a file, and start again in the next."""
    for name, n in (("a.jsonl", 400), ("b.jsonl", 30)):
        (tmp_path / name).write_text("".join("\n" if i % 7 == 0 else json.dumps({"text": f"{name} {i} " + "x" * (i % 50)}) + "\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = readers.chunks(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, n in (("a.jsonl", 400), ("b.jsonl", 30)):
        want = [(i + 1, k) for k, i in enumerate(i for i in range(n) if i % 7)]
        assert sorted((r.line, r.chunk_index) for r in rows if r.source == name) == want
        assert all(r.text.startswith(f"{name} {r.line - 1} ") for r in rows if r.source == name)


def test_corpus_prefers_chunks(spark, tmp_path):
    (tmp_path / "a.mD").write_text("# A")
    assert [tuple(r) for r in readers.corpus(spark, str(tmp_path)).collect()] == [("a.mD", 0, "# A")]
    (tmp_path / "x.jsonl").write_text('{"text": "one"}\n')
    assert [tuple(r) for r in readers.corpus(spark, str(tmp_path)).collect()] == [("x.jsonl", 0, "one")]
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        readers.corpus(spark, f"{tmp_path}/empty")


def test_parents_and_children(spark, tmp_path):
    for name, rows in (("p", [{"chunk_id": "a", "text": "old"}, {"chunk_id": "a", "text": "new"}]), ("c", [{"chunk_id": "b", "text": "t", "parent_id": "a"}, {"chunk_id": "d", "text": "t"}])):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    parents, children = readers.parent_child(spark, f"{tmp_path}/p.jsonl", f"{tmp_path}/c.jsonl")
    assert [r.text for r in parents.collect()] == ["new"] and [(r.chunk_id, r.source_file) for r in children.collect()] == [("b", "c.jsonl")]
    with pytest.raises(ValueError):
        readers.parent_child(spark, f"{tmp_path}/p.jsonl", f"{tmp_path}/p.jsonl")


def test_matching_falls_back_to_all_markdown(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.md", "a.md", "sub/c.MD"):
        (tmp_path / name).write_text(name)
    names = lambda *a: [r.rel_path for r in readers.matching(spark, str(tmp_path), *a).orderBy("rel_path").collect()]
    assert names("a*.md") == ["a.md"] and names("z*.md") == ["a.md", "b.md", "sub/c.MD"] and names("z*.md", 2) == ["a.md", "b.md"]


def test_pdfs_and_images(spark, tmp_path):
    (tmp_path / "book").mkdir()
    for name in ("a.pdf", "b.PDF", "bad.pdf", "slow.pdf", "c.txt", "book/x.PNG", "book/y.jpeg", "book/z.md"):
        (tmp_path / name).write_bytes(name.encode())

    def convert(content, timeout):
        if content == b"bad.pdf":
            raise ValueError("no pdf")
        if content == b"slow.pdf":
            raise TimeoutError
        return content.decode().upper()

    pdfs = readers.files(spark, str(tmp_path), readers.PDF, content=True)
    assert [r.rel_path for r in readers.files(spark, str(tmp_path), readers.PDF, first=2).collect()] == ["a.pdf", "b.PDF"]
    runs = readers.converted(pdfs, convert)
    assert sorted((r.status, r.text, r.detail) for r in runs.collect() if r.status != "timeout") == [("error", None, "no pdf"), ("success", "A.PDF", None), ("success", "B.PDF", None)]
    one = readers.conversion_statistics(runs).first()
    assert (one.files, one.succeeded, one.timed_out, one.failed) == (4, 2, 1, 1)
    assert sorted((r.key, r.rel_path) for r in readers.images(spark, str(tmp_path)).collect()) == [("book", "book/x.PNG"), ("book", "book/y.jpeg")]


def test_sheets(spark, tmp_path):
    (tmp_path / "q.csv").write_text('No,QUESTION ,Gold Answer\n1,"What, ""now""?",this\n2,And?,\n')
    assert [tuple(r) for r in readers.sheet(spark, f"{tmp_path}/q.csv").collect()] == [(0, 'What, "now"?', "this"), (1, "And?", None)]
    (tmp_path / "q.json").write_text('{"prompt": "p"}\n')
    assert [tuple(r) for r in readers.sheet(spark, f"{tmp_path}/q.json").collect()] == [(0, "p", None)]
    assert sinks.workbook_path("a") == "a.xlsx" and sinks.workbook_path("b.XLSX") == "b.XLSX"


def test_tree_of_files(spark, tmp_path):
    docs = spark.createDataFrame([("a.md", "# A\n"), ("sub/b c.md", "é"), ("../up.md", None)], "rel_path string, text string")
    assert sinks.tree(docs, f"{tmp_path}/out") == 3 and sinks.tree(docs.limit(0), f"{tmp_path}/out") == 0
    assert sinks.tree(docs, f"file://{tmp_path}/out") == 3
    found = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {"a.md": "# A\n", "sub/b c.md": "é", "up.md": ""}


def test_summaries(spark, tmp_path):
    chunks = spark.createDataFrame([("a.md", "x" * 40), ("b.md", "| t |")], "source_file string, text string")
    sinks.with_summary(chunks, f"{tmp_path}/c")
    (one,) = spark.read.json(f"{tmp_path}/c/summary").collect()
    assert (one.total, one.files, one.tokens) == (2, 2, 11) and spark.read.json(f"{tmp_path}/c/chunks").count() == 2
    sinks.run_summary(spark.createDataFrame([(2,)], "figures_found long"), f"{tmp_path}/s", {"workers": 4})
    assert json.loads("".join(x.read_text() for x in Path(tmp_path, "s").glob("part*"))) == {"figures_found": 2, "config": {"workers": "4"}}
    rows = spark.createDataFrame([(2, "q", "a", "r\x01", "Yes"), (1, None, "a", "r", "")], "row_index int, question string, Answer string, Result string, `Result Accuracy` string")
    assert [tuple(r) for r in sinks.judged_sheet(rows).collect()] == [(None, "a", "r", ""), ("q", "a", "r", "Yes")]


def test_registered_functions(spark):
    assert "quire_headings" in registry.register(spark)
    assert spark.sql("SELECT quire_headings('# A')[0].text AS h, quire_table_blocks('|a|')[0].end AS e").first() == ("A", 1)
    told = []
    rows, tell = registry.observed(spark.range(5), told.append, top=F.max("id"))
    rows.collect()
    tell()
    assert told == [{"rows": 5, "top": 4}]


def test_embedding_cache(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    embed = lambda d: d.withColumn("embedding", models.hashed_embedding(F.col("text"), 8))
    made, there = models.cached_embeddings(docs, embed, f"{tmp_path}/v", "m", "s")
    again, now = models.cached_embeddings(docs, embed, f"{tmp_path}/v", "m", "s")
    assert (there, now) == (False, True) and sorted(made.collect()) == sorted(again.collect())
    assert not models.cached_embeddings(docs, embed, f"{tmp_path}/v", "m", "other")[1]
    assert not models.cached_embeddings(docs.limit(1), embed, f"{tmp_path}/v", "m", "s")[1]


def test_enrichment_passes(spark, tmp_path):
    """Each pass sees what the one before has left, and a second run asks no model."""
    head = "| " + "h" * 40 + " | " + "k" * 40 + " |"
    docs = spark.createDataFrame([("a.md", f"$x$\n{head}\n|---|---|\n| $y$ | 2 |\n")], "source_file string, text string")
    asked = spark.sparkContext.accumulator(0)

    def model(rows):
        def say(batches):
            for b in batches:
                asked.add(len(b))
                b["output"] = [i.replace("$x$", "$X$").replace("$y$", "$Z$" if t == "math" else "$y$").replace("hhh", "HHH").replace("| 2 |", "| 3 |" if t == "table" else "| 2 |") for t, i in zip(b["task"], b["input"], strict=True)]
                yield b

        return rows.mapInPandas(say, rows.select("*", F.lit("").alias("output")).schema)

    for _ in range(2):
        out, log = enrich.enriched(docs, model, f"{tmp_path}/log")
        (row,) = out.collect()
        assert row.text == f"$X$\n{head.replace('hhh', 'HHH')}\n|---|---|\n| $Z$ | 3 |\n"
        assert asked.value == 4 and log.count() == 4


def test_figures_with_a_model(spark):
    docs = spark.createDataFrame([("b", "# H\n![a](a.png)\n![c](c.png)"), ("done", "![a](a.png)")], "source_file string, text string")
    images = spark.createDataFrame([("b", "/b/a.png", "a.png", b"\x00\x01")], "key string, path string, rel_path string, content binary")

    def client(prompt, url):
        return json.dumps({"figure_id": "f", "figure_type": url[:22], "caption_summary": "Section heading: # H" in prompt and "yes", "confidence": 0.9, "extracted_text": "0123456789"})

    out = figures.extracted(docs, images, client, done=spark.createDataFrame([("done",)], "source_file string"), delay=0.0, workers=1)
    rows = {r.rel_path: r for r in out.collect()}
    assert (rows["a.png"].status, rows["a.png"].confidence, rows["c.png"].status) == ("ok", 0.9, "missing")
    assert json.loads(rows["a.png"].fields)["figure_type"] == "data:image/png;base64," and "Image not found" in rows["c.png"].block
    text = figures.reinserted(docs, out).filter("source_file = 'b'").first().text
    assert text.count("FIGURE_START") == 2 and "![c](c.png)" in text and "![a](a.png)" not in text


def test_a_killed_run_repeats_no_committed_call(spark, tmp_path):
    """Each call leaves a line in a file; one of a task of its own ends the first run, after others have committed."""
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(20)] + [(3, "p3")], "id int, prompt string")

    def client(fatal):
        def ask(text):
            if fatal and text == "p13":
                while len(list(Path(tmp_path, "log").glob("*/part-*"))) < 10:
                    time.sleep(0.05)
                raise ValueError("stop")
            with open(tmp_path / "calls", "a") as f:
                f.write(text + "\n")
            return None if text == "p5" else text.upper()

        return models.called(ask, tries=1, wait=lambda n, error: None)

    run = lambda fatal: calls.logged(rows, client(fatal), f"{tmp_path}/log", ["id"], per_task=1)
    with pytest.raises(Exception, match="stop"):
        run(True)
    committed = {r.id for r in calls.answers(spark, f"{tmp_path}/log", "id int, output string").filter("output IS NOT NULL").collect()}
    before = Counter(Path(tmp_path, "calls").read_text().split())
    assert len(committed) >= 5 and 13 not in committed
    out = {(r.id, r.output) for r in run(False).collect()}
    assert out == {(i, None if i == 5 else f"P{i}") for i in range(20)}
    after = Counter(Path(tmp_path, "calls").read_text().split()) - before
    assert not {f"p{i}" for i in committed} & set(after) and after["p5"] == 2 and set(after) >= {f"p{i}" for i in range(20) if i not in committed}
    assert run(False).count() == 21 and Counter(Path(tmp_path, "calls").read_text().split()) - before - after == Counter({"p5": 2})


def test_calls_go_in_waves(spark, tmp_path):
    rows = spark.range(30).withColumn("prompt", F.col("id").cast("string"))
    out = calls.logged(rows, lambda d: d.withColumn("output", F.col("prompt")), str(tmp_path), ["id"], workers=2, per_task=4)
    assert out.filter("output = id").count() == 30 and len(list(tmp_path.glob("*-*"))) == 4
    assert calls.logged(rows.limit(0), lambda d: 1 / 0, str(tmp_path), ["id"]).collect() == []


def test_several_models_by_log(spark, tmp_path):
    docs = spark.createDataFrame([("b", "# H\n![a](a.png)\n![c](c.png)\n![d](d.png)")], "source_file string, text string")
    images = spark.createDataFrame([("b", "/b/a.png", "a.png", b"a"), ("b", "/b/d.png", "d.png", b"d")], "key string, path string, rel_path string, content binary")

    def client(sure):
        def ask(prompt, url):
            with open(tmp_path / "calls", "a") as f:
                f.write("x\n")
            if url.endswith("ZA=="):  # of the second image
                raise OSError("down")
            return json.dumps({"figure_id": "f", "figure_type": "t", "caption_summary": "c", "confidence": sure, "extracted_text": "0123456789"})

        return ask

    clients = {"m1": client(0.6), "m2": client(0.8), "m3": client(0.8)}
    for run in range(2):
        out = figures.extracted(docs, images, clients, log=f"{tmp_path}/log", delay=0.0, tries=1)
        rows = {r.rel_path: r for r in out.collect()}
        assert (rows["a.png"].model, rows["a.png"].confidence, rows["a.png"].status) == ("m2", 0.8, "ok")
        assert "| m2 | 0.80 ← SELECTED |\n| m3 | 0.80 |\n| m1 | 0.60 |" in rows["a.png"].block
        assert rows["c.png"].status == "missing" and rows["d.png"].status == "error" and "![d](d.png)" in rows["d.png"].block
        assert {(r.model, r.output is None) for r in figures.by_model(out).filter("ordinal = 2").collect()} == {("m1", True), ("m2", True), ("m3", True)}
        assert figures.totals(out).filter("source_file IS NULL").first()[1:] == (3, 1, 0, 1)
        assert len(Path(tmp_path, "calls").read_text().split()) == 3 + (run + 1) * 2 * 3  # what failed is asked again, twice a run


def test_retries_by_error():
    class RateLimitError(Exception):
        pass

    class BadRequestError(Exception):
        pass

    class Status(Exception):
        code, retry_after = 429, 40

    assert models.by_error_class(1, ValueError()) == 4 and models.by_error_class(0, RateLimitError("please wait 30 seconds")) == 30
    assert models.by_error_class(0, BadRequestError()) is None and models.by_error_class(0, ValueError("wait 30 seconds")) == 2
    assert 40 <= models.by_status(0, Status()) < 41 and 60 <= models.by_status(2, Status()) < 61 and 1 <= models.by_status(0, ValueError()) < 2
    assert models.usable_models(("a", "b"), ["b", "c"]) == ("b",)
    with pytest.raises(ValueError):
        models.usable_models(("a",), ["b"])
    assert models.either(lambda x: 1 / 0, str.upper)("a") == "A"


def test_hopeless_calls_fail_the_run(spark):
    class AuthenticationError(Exception):
        pass

    def client(text):
        raise AuthenticationError("no key")

    rows = spark.createDataFrame([("x",)], "prompt string")
    with pytest.raises(Exception, match="no key"):
        models.called(client, wait=models.by_error_class)(rows).collect()


def test_images_in_any_case(spark, tmp_path):
    for name in ("a.png", "b.PNG", "c.Jpg", "d.txt", "e.tIfF"):
        (tmp_path / "k").mkdir(exist_ok=True)
        (tmp_path / "k" / name).write_bytes(b"x")
    assert {r.rel_path for r in readers.images(spark, str(tmp_path)).collect()} == {"k/a.png", "k/b.PNG", "k/c.Jpg", "k/e.tIfF"}


def test_conversion_is_stopped_in_time(spark):
    def convert(content, timeout):
        if content == b"slow":
            time.sleep(20)
        return content.decode()

    files = spark.createDataFrame([("a", b"slow"), ("b", b"fast")], "path string, content binary").coalesce(1)
    rows = {r.path: r for r in readers.converted(files, convert, timeout=1.0).collect()}
    assert (rows["a"].status, rows["b"].status, rows["b"].text) == ("timeout", "success", "fast") and rows["a"].seconds < 10


def test_tree_source_and_sink(spark, tmp_path):
    form, out = tree.register(spark), f"{tmp_path}/out"
    rows = [("a.md", "A"), ("x/b.MD", "é\n"), ("x/y/c.markdown", None), ("../d.md", "inside"), ("e.txt", "other")]
    docs = spark.createDataFrame(rows, "rel_path string, text string").repartition(3)
    docs.write.format(form).mode("append").save(out)
    back = spark.read.format(form).load(out)
    assert {tuple(r) for r in back.collect()} == {("a.md", "A"), ("x/b.MD", "é\n"), ("x/y/c.markdown", ""), ("d.md", "inside")}
    assert spark.read.format(form).option("suffixes", "txt").load(out).collect() == [("e.txt", "other")]
    assert spark.read.format(form).option("partitionbytes", "1").load(out).rdd.getNumPartitions() > 1
    docs.filter("rel_path = 'a.md'").withColumn("text", F.lit("new")).write.format(form).mode("append").save(f"file://{out}")
    assert back.filter("rel_path = 'a.md'").first().text == "new" and back.count() == 4
    assert not [p for p in Path(out).rglob("*") if tree.STAGING in p.name or p.name == "manifest"]
    assert spark.read.format(form).load(str(tmp_path / "out" / "x" / "y")).count() == 1


def test_tree_sink_leaves_nothing_of_a_failed_job(spark, tmp_path):
    form, out = tree.register(spark), f"{tmp_path}/out"
    docs = spark.createDataFrame([(f"{i}.md", "x") for i in range(40)], "rel_path string, text string").repartition(4)
    docs.write.format(form).mode("append").save(out)
    bad = docs.withColumn("text", F.lit("y")).unionByName(spark.createDataFrame([(None, "no path")], "rel_path string, text string"))
    with pytest.raises(Exception, match="without a path"):
        bad.write.format(form).mode("append").save(out)
    assert {r.text for r in spark.read.format(form).load(out).collect()} == {"x"}
    assert sorted(p.name for p in Path(out).iterdir()) == sorted(f"{i}.md" for i in range(40))
