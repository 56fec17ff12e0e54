"""The stages as jobs: ``spark-submit quirespark/jobs.py STAGE ...`` or ``python -m quirespark.jobs STAGE ...``.

Each reads a tree of Markdown and writes one with the same paths, or tables. Models are functions of the caller's, named as
``module:function``; without one, enrichment and figures are dry runs. Options have the defaults of the operators.
"""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.operators import chunk, enrich, figures, index, models, normalize
from quirespark.sources import readers, sinks, store, tree


def _named(name: str | None):
    """What ``module:function`` names."""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _texts(change: Callable[[Column], Column]):
    """A job that maps every document's text."""

    def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
        docs = readers.markdown(spark, a.input)
        docs.select("rel_path", change(F.col("text")).alias("text")).write.format(tree.register(spark)).mode("append").save(a.output)

    return run


def _cleaned(c: Column) -> Column:
    return normalize.without_page_links(normalize.without_page_spans(c)["text"])["text"]


def _detected(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    docs = readers.markdown(spark, a.input).select("rel_path", normalize.headings(F.col("text")).alias("h"))
    return docs.select("rel_path", normalize.document_format(F.transform("h", lambda x: x["text"])).alias("f")).select("rel_path", "f.*").orderBy("rel_path")


def _normalized(spark: SparkSession, a: argparse.Namespace) -> None:
    """Each document by the rules for its kind of headings; ``--tree`` puts its headings into one tree after that."""
    docs = readers.markdown(spark, a.input).select("rel_path", "text")
    out = normalize.refined(docs, numbered=lambda c: normalize.locally_normalized(c, a.labels))
    text = normalize.with_tree(F.col("text")) if a.tree else F.col("text")
    out.select("rel_path", text.alias("text")).write.format(tree.register(spark)).mode("append").save(a.output)


def _enriched(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    docs = readers.markdown(spark, a.input).select(F.col("rel_path").alias("source_file"), enrich.preprocessed(F.col("text")).alias("text"))
    client = _named(a.client)
    if client is None:
        return enrich.elements(docs).groupBy("source_file", "task").count().orderBy("source_file", "task")
    out, log = enrich.enriched(docs, models.called(client), f"{a.output.rstrip('/')}-log", workers=a.workers)
    out.withColumnRenamed("source_file", "rel_path").write.format(tree.register(spark)).mode("append").save(a.output)
    return enrich.statistics(log)


def _figures(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Documents are read by folder, the images of a folder are those below it."""
    root = a.input.rstrip("/")
    docs = readers.books(readers.markdown(spark, root)).select(F.regexp_extract("rel_path", r"^([^/]+)/", 1).alias("source_file"), "rel_path", "text")
    client = {n.partition(":")[2]: _named(n) for n in a.client.split(",")} if a.client else None
    images = readers.images(spark, root).withColumn("rel_path", F.regexp_replace("rel_path", "^[^/]+/", ""))
    rows = store.written(figures.extracted(docs.select("source_file", "text"), images, client, log=f"{a.output.rstrip('/')}-log" if client else None, workers=a.workers, delay=a.delay))
    out = figures.reinserted(docs, rows)
    out.select("rel_path", "text").write.format(tree.register(spark)).mode("append").save(a.output)
    return figures.totals(rows)


CHUNKERS = {"atomic": chunk.atomic_chunks, "typed": chunk.typed_chunks, "parent-child": chunk.parent_child_chunks, "hierarchical": chunk.hierarchical_chunks}


def _chunked(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    docs = readers.markdown(spark, a.input).select(F.col("rel_path").alias("source_file"), "text")
    sizes = {"max_tokens": a.size, "overlap": a.overlap} if a.strategy == "hierarchical" else {"size": a.size, "overlap": a.overlap}
    chunks = store.written(CHUNKERS[a.strategy](docs, **{k: v for k, v in sizes.items() if v is not None}))
    sinks.jsonl(chunks, a.output, mode="overwrite")
    return chunk.summary(chunks)


def _indexed(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Brings an index of chunks (JSON lines with chunk_id and text) up to date."""
    done = index.update(spark.read.json(a.input).select("chunk_id", "text"), a.output, doc_id="chunk_id")
    return spark.createDataFrame([(done["added"], done["dead"], index.stats(spark, a.output).n_docs)], "added long, dead long, n_docs long")


def _searched(spark: SparkSession, a: argparse.Namespace) -> None:
    """The best chunks for each question of a JSON lines file (query_id, text)."""
    found = index.search(a.input, spark.read.json(a.questions), a.k)
    sinks.jsonl(found.rows, a.output, mode="overwrite")


STAGES: dict[str, tuple[Callable, dict]] = {
    "clean": (_texts(_cleaned), {}),
    "detect": (_detected, {}),
    "normalize": (_normalized, {"--labels": {"action": "store_true"}, "--tree": {"action": "store_true"}}),
    "enrich": (_enriched, {"--client": {}, "--workers": {"type": int, "default": 1}}),
    "clean-enrichment": (_texts(lambda c: enrich.without_echoes(c)["text"]), {}),
    "widths": (_texts(enrich.tables_widened), {}),
    "figures": (_figures, {"--client": {"help": "module:function, several by commas"}, "--workers": {"type": int, "default": 20}, "--delay": {"type": float, "default": 1.0}}),
    "chunk": (_chunked, {"--strategy": {"choices": sorted(CHUNKERS), "default": "parent-child"}, "--size": {"type": int}, "--overlap": {"type": int}}),
    "index": (_indexed, {}),
    "search": (_searched, {"--questions": {"required": True}, "--k": {"type": int, "default": 100}}),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quirespark.jobs", description=__doc__)
    stages = out.add_subparsers(dest="stage", required=True)
    for name, (run, options) in STAGES.items():
        one = stages.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        one.add_argument("--input", required=True)
        one.add_argument("--output", required=name != "detect")
        for flag, settings in options.items():
            one.add_argument(flag, **settings)
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame | None:
    """Runs a stage; what it reports is shown, one row a line."""
    a = parser().parse_args(arguments)
    report = STAGES[a.stage][0](spark or SparkSession.builder.getOrCreate(), a)
    if report is not None:
        report.show(1000, truncate=False)
    return report


if __name__ == "__main__":
    main(sys.argv[1:])
