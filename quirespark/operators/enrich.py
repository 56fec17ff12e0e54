"""Formula and table enrichment: what to ask a model for, whether to take its answer, and clean-up after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.functions import kernels
from quirespark.functions.text import each_line, let, lines, occurrences, strip
from quirespark.operators import calls
from quirespark.sources import store

MATH = r"\$\$[^$]*\$\$|\$[^$\n]+\$"
TASKS = ("table_header", "math", "table")

PROMPTS = {
    "table_header": "Rewrite the header row of this Markdown table so that each column has one clear label. Keep every data row as it is.\n\n%s",
    "math": "Correct the LaTeX of this formula, name it and say in words what it states. Keep the formula.\n\n%s",
    "table": "Format this Markdown table and describe its subject, properties, columns and units. Keep every value.\n\n%s",
    "code": "Format this code block and say what it does. Keep every statement.\n\n%s",
    "list": "Format this Markdown list. Keep every item.\n\n%s",
}
#: For any other task.
PROMPT = "Improve the Markdown of this passage. Keep what it says.\n\n%s"


def preprocessed(c: Column) -> Column:
    """Line-break tags become spaces, empty page anchors go, and cells of piped lines lose double spaces."""
    plain = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", " "), r'(?U)<span\s+id="page-[\d-]+"[^>]*>\s*</span>', "")
    return each_line(plain, lambda x: F.when(x.contains("|"), F.regexp_replace(x, "  +", " ")).otherwise(x))


def formulas(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(MATH), F.lit(0))


def table_lines(c: Column) -> Column:
    return F.filter(lines(c), lambda x: strip(x).startswith("|"))


def has_collapsed_headers(table: Column) -> Column:
    """Two header cells of more than 35 characters, or two with neighbouring words in capitals."""
    header = F.filter(F.transform(F.split(F.get(table_lines(table), 0), r"\|"), strip), lambda x: x != "")
    return F.coalesce(
        let(
            header,
            lambda h: (F.size(F.filter(h, lambda x: F.length(x) > 35)) >= 2) | (F.size(F.filter(h, lambda x: x.rlike(r"\b[A-Z]{2,}\b \b[A-Z]{2,}\b"))) >= 2),
        ),
        F.lit(False),
    )


def issues(c: Column) -> Column:
    """(line_index, kind) of lines with inline math, a display delimiter, or a table row."""
    kinds = lambda x, i: F.filter(
        F.array(
            F.when(x.rlike(r"\$[^$]{5,200}\$"), F.struct(i.alias("line_index"), F.lit("inline_math").alias("kind"))),
            F.when(x.contains("$$"), F.struct(i.alias("line_index"), F.lit("block_math").alias("kind"))),
            F.when(strip(x).startswith("|"), F.struct(i.alias("line_index"), F.lit("table").alias("kind"))),
        ),
        lambda k: k.isNotNull(),
    )
    return F.flatten(F.transform(lines(c), kinds))


def is_safe(original: Column, enhanced: Column) -> Column:
    """Whether an answer keeps what it was made from: its length, its display formulas and its table cells."""
    long_enough = F.length(enhanced) >= F.length(original) * F.lit(0.70)
    math = (occurrences(original, "$$") == 0) | (occurrences(enhanced, "$$") >= occurrences(original, "$$"))
    pipes = (occurrences(original, "|") <= 10) | (occurrences(enhanced, "|") >= occurrences(original, "|") * F.lit(0.80))
    return F.coalesce(long_enough & math & pipes, F.lit(False))


def prompt(task: str, content: Column) -> Column:
    return F.format_string(PROMPTS.get(task, PROMPT), content)


def tables_widened(c: Column) -> Column:
    return kernels.table_widths_udf()(c)


def without_echoes(c: Column) -> Column:
    """(text, steps, labels, sups)."""
    return kernels.without_echoes_udf()(c)


def table_blocks(c: Column) -> Column:
    """array of (start, end, text): stretches of table rows; tables that only blank lines part are one."""
    return kernels.table_blocks_udf()(c)


def code_blocks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?s)```[\w-]*\n.*?\n```"), F.lit(0))


def list_blocks(c: Column) -> Column:
    return kernels.list_blocks_udf()(c)


def elements(docs: DataFrame, key: str = "source_file", text: str = "text", tasks: tuple[str, ...] = TASKS) -> DataFrame:
    """What there is to ask about: (key, task, ordinal, input), a row per table with a collapsed header, per formula and
    per table, and, if ``tasks`` asks for them, per code block and per list."""
    with_tables = docs.withColumn("_tables", F.transform(table_blocks(F.col(text)), lambda t: t["text"]))
    found = {
        "table_header": F.filter("_tables", has_collapsed_headers),
        "math": formulas(F.col(text)),
        "table": F.col("_tables"),
        "code": code_blocks(F.col(text)),
        "list": list_blocks(F.col(text)),
    }
    named = lambda task: F.transform(found[task], lambda x, i: F.struct(F.lit(task).alias("task"), i.alias("ordinal"), x.alias("input")))
    return with_tables.select(key, F.inline(F.concat(*(named(t) for t in tasks))))


def answered(asked: DataFrame, model, done: DataFrame | None = None, workers: int | None = None) -> DataFrame:
    """A log row per element: the model's answer if it is safe, else null. Elements in ``done`` are not asked again;
    (key, task, ordinal) tells them apart, so a retried task writes the same rows. At most ``workers`` tasks ask at a
    time."""
    keys = [c for c in asked.columns if c != "input"]
    todo = asked.join(done, keys, "left_anti") if done is not None else asked
    todo = todo.repartition(workers) if workers else todo
    asked_for = F.coalesce(*(F.when(F.col("task") == t, prompt(t, F.col("input"))) for t in PROMPTS), F.format_string(PROMPT, F.col("input")))
    out = model(todo.withColumn("prompt", asked_for))
    log = out.withColumn("output", F.when(is_safe(F.col("input"), F.col("output")), F.col("output"))).select(*asked.columns, "output")
    return log.unionByName(done) if done is not None else log


def enriched(docs: DataFrame, model, path: str, key: str = "source_file", text: str = "text", tasks: tuple[str, ...] = TASKS, workers: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``docs`` after a pass for each task, each over the text that the one before has left, and the log of all.

    Each pass keeps a log below ``path``, in which answers are committed task by task, so that no model is asked twice;
    a log that is there is taken up again, for the elements that are still the same. An answer that is not safe is kept but
    not put in; an element without any answer is asked again by the next run.
    """
    out = None
    for n, task in enumerate(tasks):
        asked = elements(docs, key, text, (task,)).withColumn("digest", F.sha2("input", 256))
        asked_for = F.coalesce(*(F.when(F.col("task") == t, prompt(t, F.col("input"))) for t in PROMPTS), F.format_string(PROMPT, F.col("input")))
        said = calls.logged(asked.withColumn("prompt", asked_for), model, f"{path.rstrip('/')}/{n}-{task}", [key, "task", "ordinal", "digest"], rounds=1, workers=workers)
        log = said.select(key, "task", "ordinal", "input", F.when(is_safe(F.col("input"), F.col("output")), F.col("output")).alias("output"))
        log = store.written(log)
        docs = replayed(docs, log, key, text)
        out = log if out is None else out.unionByName(log)
    return docs, out


def statistics(log: DataFrame) -> DataFrame:
    """(task, asked, enhanced, failed) of a log, and a row for all tasks, whose task is null."""
    done = F.count("output")
    return log.rollup("task").agg(F.count("*").alias("asked"), done.alias("enhanced"), (F.count("*") - done).alias("failed"))


def cleanup_totals(docs: DataFrame, key: str = "source_file", text: str = "text") -> DataFrame:
    """One row: how many documents there are and change, and how many steps, labels and superscripts were taken out."""
    cleaned = docs.select(text, without_echoes(F.col(text)).alias("o"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c.split(".")[-1])
    changed = F.count_if(F.col("o.steps") + F.col("o.labels") + F.col("o.sups") > 0)
    return cleaned.agg(F.count("*").alias("documents"), changed.alias("changed"), total("o.steps"), total("o.labels"), total("o.sups"))


def replayed(docs: DataFrame, log: DataFrame, key: str = "source_file", text: str = "text") -> DataFrame:
    """``docs`` with every answered element put in its place, headers before formulas before tables."""
    order = F.array_position(F.array(*map(F.lit, TASKS)), F.col("task"))
    pairs = log.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "ordinal", "input", "output"))).alias("_pairs"))
    both = docs.join(pairs, key, "left")
    inputs = F.transform("_pairs", lambda p: F.struct(p["input"].alias("input"), p["output"].alias("output")))
    return both.withColumn(text, kernels.replayed_udf()(F.col(text), inputs)).drop("_pairs")
