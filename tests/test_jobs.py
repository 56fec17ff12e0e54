"""Every stage as a job, from a tree of files to a tree or tables."""

import json
from pathlib import Path

import pytest

from quirespark import jobs

BOOK = """# 1 Pumps

<span id="page-1-0"></span>See [Loads](#page-3) and text.

![a](a.png)
Figure 1: A pump of the first kind

$$
E = mc^2
$$
where E = energy

| part | mass |
|---|---|
| rod | 2 |

### 1.1.1 Scope

Last words.
"""


def shout(prompt: str) -> str:
    return prompt.split("\n\n", 1)[1].replace("E = mc^2", "E = m c^2")


def see(prompt: str, url: str) -> str:
    return json.dumps({"figure_id": "f", "figure_type": "photo", "caption_summary": "a pump", "confidence": 0.9, "extracted_text": "more than ten"})


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    out = tmp_path_factory.mktemp("jobs")
    (out / "in" / "book").mkdir(parents=True)
    (out / "in" / "book" / "one.md").write_text(BOOK)
    (out / "in" / "book" / "a.png").write_bytes(b"x")
    return out


def text(folder: Path) -> str:
    return (folder / "book" / "one.md").read_text()


def test_stages_one_after_another(spark, root):
    run = lambda stage, source, target, *more: jobs.main([stage, "--input", str(root / source), "--output", str(root / target), *more], spark)
    run("clean", "in", "clean")
    assert "See Loads and text." in text(root / "clean") and "<span" not in text(root / "clean")
    (row,) = jobs.main(["detect", "--input", str(root / "clean")], spark).collect()
    assert (row.rel_path, row.format) == ("book/one.md", "numbered")
    run("normalize", "clean", "norm", "--tree")
    assert "## 1.1.1 Scope" in text(root / "norm").splitlines() and "# 1 Pumps" in text(root / "norm").splitlines()
    assert {(r.task, r["count"]) for r in run("enrich", "norm", "none").collect()} == {("math", 1), ("table", 1)}
    done = {r.task: (r.asked, r.enhanced) for r in run("enrich", "norm", "rich", "--client", "tests.test_jobs:shout").collect()}
    assert done[None] == (2, 2) and "E = m c^2" in text(root / "rich")
    run("clean-enrichment", "rich", "rich2")
    run("widths", "rich2", "wide")
    assert "| part | mass |\n|------|------|" in text(root / "wide")
    (root / "wide" / "book" / "a.png").write_bytes(b"x")
    report = {r.source_file: r for r in run("figures", "wide", "seen", "--client", "tests.test_jobs:see", "--delay", "0").collect()}
    assert (report[None].figures_found, report[None].missing_images, report[None].errors) == (1, 0, 0)
    assert "- **Figure type**: photo" in text(root / "seen") and "![a](a.png)" not in text(root / "seen")
    assert "dry_run" not in text(root / "seen")
    for strategy in jobs.CHUNKERS:
        (row,) = run("chunk", "seen", f"chunks-{strategy}", "--strategy", strategy).collect()
        assert row.total > 0 and row.files == 1
    assert run("index", "chunks-parent-child", "index").first()[:2] == (spark.read.json(str(root / "chunks-parent-child")).count(), 0)
    (root / "q.json").write_text('{"query_id": 1, "text": "energy rod"}\n')
    run("search", "index", "found", "--questions", str(root / "q.json"), "--k", "3")
    found = spark.read.json(str(root / "found"))
    assert found.count() >= 1 and found.filter("rank = 1").first().bm25 >= 0


def test_defaults():
    a = jobs.parser().parse_args(["chunk", "--input", "i", "--output", "o"])
    assert (a.strategy, a.size, a.overlap) == ("parent-child", None, None)
    with pytest.raises(SystemExit):
        jobs.parser().parse_args(["clean", "--input", "i"])
