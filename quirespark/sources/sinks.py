"""Sinks: Markdown trees, JSON lines, logs and result sheets, written by Spark's writers or, for files by name, by tasks
through Arrow's file systems."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.functions.text import without_controls
from quirespark.operators import chunk


def jsonl(rows: DataFrame, path: str, by: str | None = None, mode: str = "errorifexists") -> None:
    """One JSON object a line, nulls kept; a folder for each value of ``by``."""
    out = rows.write.mode(mode).option("ignoreNullFields", "false")
    (out.partitionBy(by) if by else out).json(path)


def tree(docs: DataFrame, path: str, rel_path: str = "rel_path", text: str = "text") -> int:
    """Each document as the file ``rel_path`` below ``path``; how many there were.

    Tasks write their own documents, each under a temporary name first, so a task that runs again leaves the same
    files. ``path`` is a folder that all executors share, or the address of a store that Arrow knows.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        for batch in batches:
            for name, body in zip(batch["rel_path"], batch["text"], strict=True):
                parts = [x for x in str(name).split("/") if x not in ("", ".", "..")]
                target = "/".join([root.rstrip("/"), *parts])
                store.create_dir(target.rpartition("/")[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write((body or "").encode())
                store.move(part, target)
            yield pd.DataFrame({"n": [len(batch)]})

    rows = docs.select(F.col(rel_path).alias("rel_path"), F.col(text).alias("text"))
    return rows.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def pair_files(log: DataFrame, docs: DataFrame, key: str = "source_file") -> DataFrame:
    """(rel_path, text) of two JSON files a document, its formulas and its tables, also where it has none; for ``tree``."""
    stem = F.regexp_replace(F.col(key), r"\.[^./]*$", "")
    pair = F.struct("task", "ordinal", "input", "output")
    lists = log.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(F.col("task") == "math", pair))).alias("Formulas"), F.sort_array(F.collect_list(F.when(F.col("task") != "math", pair))).alias("Tables")
    )
    rows = docs.select(key).distinct().join(lists, key, "left")
    said = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<task:string,ordinal:int,input:string,output:string>>")), lambda p: F.struct(p["task"].alias("task"), p["input"].alias("input"), p["output"].alias("output")))
    named = lambda c: F.struct(F.concat(F.regexp_replace(stem, "[^/]+$", ""), F.lit(f"{c}_"), F.regexp_extract(stem, "[^/]+$", 0), F.lit(".json")).alias("rel_path"), F.to_json(said(c), {"ignoreNullFields": "false"}).alias("text"))
    return rows.select(F.inline(F.array(named("Formulas"), named("Tables"))))


def pair_logs(log: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The log of enrichment pairs, formulas apart from tables."""
    kind = F.when(F.col("task") == "math", "Formulas").otherwise("Tables")
    jsonl(log.withColumn("kind", kind), path, "kind", mode)


def registry_files(figures: DataFrame, key: str = "source_file") -> DataFrame:
    """(rel_path, text) of a JSON file a document: its figures (``registry_id`` and further columns) by id; for ``tree``."""
    own = [c for c in figures.columns if c not in (key, "registry_id")]
    entry = F.struct(F.col("registry_id").alias("k"), F.struct(F.col("registry_id").alias("figure_id"), *(c for c in own if c != "figure_id")).alias("v"))
    rows = figures.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("m"))
    name = F.concat(F.regexp_replace(F.col(key), r"\.[^./]*$", ""), F.lit("_figures.json"))
    return rows.select(name.alias("rel_path"), F.to_json("m", {"ignoreNullFields": "false"}).alias("text"))


def run_summary(results: DataFrame, path: str, config: dict, mode: str = "errorifexists") -> None:
    """The totals of a run, with the settings it ran under, as JSON lines."""
    settings = F.create_map(*(F.lit(str(x)) for pair in config.items() for x in pair)) if config else F.create_map().cast("map<string,string>")
    jsonl(results.withColumn("config", settings), path, mode=mode)


def outcomes(docs: DataFrame, errors: DataFrame | None = None, key: str = "source_file") -> DataFrame:
    """What normalising came to: (backend, status, documents, sources) of ``refined`` documents and of those in
    ``errors`` (key, detail); for ``jsonl``."""
    rows = docs.select(F.col(key).alias("source"), "backend", F.lit("ok").alias("status"))
    if errors is not None:
        rows = rows.unionByName(errors.select(F.col(key).alias("source"), F.lit("none").alias("backend"), F.lit("error").alias("status")))
    return rows.groupBy("backend", "status").agg(F.count("*").alias("documents"), F.sort_array(F.collect_list("source")).alias("sources"))


def workbook_path(path: str) -> str:
    """``path`` with the suffix of a workbook."""
    return path if path.lower().endswith((".xlsx", ".xls")) else f"{path}.xlsx"


def judged_sheet(rows: DataFrame) -> DataFrame:
    """The four columns of a judged workbook, fit for cells, in order of their index."""
    names = ("question", "Answer", "Result", "Result Accuracy")
    return rows.orderBy("row_index").select(*(without_controls(F.col(f"`{n}`").cast("string")).alias(n) for n in names))


def result_sheet(rows: DataFrame, question: Column, answer: Column, context: Column, result: Column) -> DataFrame:
    """The four columns of a result workbook, fit for cells."""
    named = {"question": question, "Answer": answer, "RAG_Context": context, "Result": result}
    return rows.select(*(without_controls(c.cast("string")).alias(n) for n, c in named.items()))


def with_summary(chunks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Chunks and their summary, each as JSON lines below ``path``."""
    jsonl(chunks, f"{path}/chunks", mode=mode)
    jsonl(chunk.summary(chunks), f"{path}/summary", mode=mode)
