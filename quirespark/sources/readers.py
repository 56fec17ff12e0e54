"""Sources: trees of Markdown, chunk corpora, multimodal JSON, images. All by Spark's readers, so any store works."""

from __future__ import annotations

import signal
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirespark.operators import models
from quirespark.operators.figures import IMAGES

MARKDOWN = "*.{[mM][dD],[mM][aA][rR][kK][dD][oO][wW][nN]}"
PDF = "*.[pP][dD][fF]"


def _files(spark: SparkSession, root: str, kind: str, glob: str, recursive: bool):
    return spark.read.format(kind).option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())


def relative(path: Column, root: str) -> Column:
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), rf"^(?:[a-z0-9]+:/*)?/?\Q{root.strip('/')}\E/", "")


def markdown(spark: SparkSession, root: str, recursive: bool = True, exclude: str | None = None) -> DataFrame:
    """(source_file, rel_path, text) of the Markdown files under ``root``; bytes that are no UTF-8 are replaced.

    ``exclude`` is a subtree, such as an output folder inside the input.
    """
    files = _files(spark, root, "binaryFile", MARKDOWN, recursive).load(root)
    rows = files.select(relative(F.col("path"), root).alias("rel_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    if exclude:
        rows = rows.filter(~F.col("rel_path").startswith(exclude.strip("/") + "/"))
    return rows.select(F.regexp_extract("rel_path", r"([^/]+)$", 1).alias("source_file"), "rel_path", "text")


def books(docs: DataFrame) -> DataFrame:
    """One document per folder, the first by path."""
    folder = F.regexp_replace("rel_path", r"/?[^/]*$", "")
    return docs.groupBy(folder.alias("book")).agg(F.min_by(F.struct("source_file", "rel_path", "text"), "rel_path").alias("d")).select("book", "d.*")


def files(spark: SparkSession, root: str, glob: str, first: int | None = None, content: bool = False) -> DataFrame:
    """(path, rel_path, length[, content]) of the files under ``root``, sorted; ``first`` of them if given."""
    rows = _files(spark, root, "binaryFile", glob, True).load(root)
    rows = rows.select("path", relative(F.col("path"), root).alias("rel_path"), "length", *(["content"] if content else []))
    return rows.orderBy("path").limit(first) if first else rows.orderBy("path")


def matching(spark: SparkSession, root: str, pattern: str, most: int | None = None) -> DataFrame:
    """The Markdown files that ``pattern`` finds right below ``root``, or if it finds none, all below it; the first
    ``most`` by path."""
    def load(glob: str, recursive: bool) -> DataFrame:
        found = _files(spark, root, "binaryFile", glob, recursive).load(root)
        return found.select(relative(F.col("path"), root).alias("rel_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))

    rows = load(pattern, False)
    rows = load(MARKDOWN, True) if rows.isEmpty() else rows
    rows = rows.select(F.regexp_extract("rel_path", r"([^/]+)$", 1).alias("source_file"), "rel_path", "text")
    return rows.orderBy("rel_path").limit(most) if most else rows


def images(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """(key, path, rel_path[, content]) of the images below ``root``; the key is the folder right below it."""
    rows = files(spark, root, "*.{" + ",".join("".join(f"[{x}{x.upper()}]" for x in e) for e in IMAGES) + "}", content=content)
    return rows.select(F.regexp_extract("rel_path", r"^([^/]+)/", 1).alias("key"), "path", "rel_path", *(["content"] if content else []))


@contextmanager
def _deadline(seconds: float) -> Iterator[None]:
    """Raises TimeoutError in what runs longer, as soon as it is in Python code."""

    def stop(*_) -> None:
        raise TimeoutError(f"more than {seconds} seconds")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def converted(pdfs: DataFrame, convert: Callable[[bytes, float], str], timeout: float = 10_800) -> DataFrame:
    """(path, status, seconds, text, detail) of what ``convert(content, timeout)`` makes of files (path, content); status
    is success, timeout (it raised TimeoutError, or was interrupted when its time was over) or error (it raised anything
    else), and the detail is the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                start, text, detail, status = time.monotonic(), None, None, "success"
                try:
                    with _deadline(timeout):
                        text = convert(content, timeout)
                except Exception as error:
                    status, detail = "timeout" if isinstance(error, TimeoutError) else "error", str(error)
                yield pd.DataFrame([(path, status, time.monotonic() - start, text, detail)], columns=["path", "status", "seconds", "text", "detail"])

    return pdfs.select("path", "content").mapInPandas(run, "path string, status string, seconds double, text string, detail string")


def conversion_statistics(runs: DataFrame) -> DataFrame:
    """One row: files, succeeded, timed_out, failed, total and mean seconds, and files an hour."""
    of = lambda s: F.count_if(F.col("status") == s)
    total = F.coalesce(F.sum("seconds"), F.lit(0.0))
    return runs.agg(
        F.count("*").alias("files"), of("success").alias("succeeded"), of("timeout").alias("timed_out"), of("error").alias("failed"),
        total.alias("seconds"), F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("mean_seconds"), F.when(total > 0, F.count("*") * 3600 / total).alias("files_per_hour"),
    )


def chunks(spark: SparkSession, root: str, schema: str = "text string") -> DataFrame:
    """JSONL chunks under ``root``: (source, line, chunk_index, the fields of ``schema``).

    Lines that are blank, no JSON object or without text are dropped by themselves. ``line`` counts all lines of the
    file from 1, ``chunk_index`` the kept ones from 0. Files are read by line and in splits: lines are numbered within
    their split first, and the splits of a file then add up.
    """
    read = _files(spark, root, "text", "*.jsonl", True).load(root)
    rows = read.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_name").alias("source"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), F.from_json("value", schema).alias("r"),
    ).withColumn("_kept", (F.regexp_replace(F.coalesce("r.text", F.lit("")), r"(?U)\s+", "") != "").cast("int"))
    own = Window.partitionBy("_file", "_block").orderBy("_at")
    local = rows.withColumns({"_line": F.row_number().over(own), "_index": F.sum("_kept").over(own)}).filter("_kept = 1")
    sizes = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.sum("_kept").alias("_m"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_lines"), F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_chunks"))
    return local.join(offsets, ["_file", "_block"]).select(
        "source", (F.col("_lines") + F.col("_line")).cast("int").alias("line"), (F.col("_chunks") + F.col("_index") - 1).cast("int").alias("chunk_index"), "r.*"
    )


def parent_child(spark: SparkSession, parents_path: str, children_path: str) -> tuple[DataFrame, DataFrame]:
    """Parents by id, the last of each, and the children that have a text and a parent's id."""
    fields = "chunk_id string, text string, source_file string, section_heading string, parent_id string, chunk_role string"
    own = chunks(spark, parents_path, fields).withColumn("source_file", F.coalesce("source_file", "source"))
    last = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.col("source").desc(), F.col("line").desc()))
    parents = own.filter("chunk_id IS NOT NULL").withColumn("_n", last).filter("_n = 1").drop("_n")
    children = chunks(spark, children_path, fields).filter("parent_id IS NOT NULL").withColumn("source_file", F.coalesce("source_file", "source"))
    for name, rows in (("parents", parents), ("children", children)):
        if rows.isEmpty():
            raise ValueError(f"no {name} under {parents_path if name == 'parents' else children_path}")
    return parents, children


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """Chunks if there are any files of them, else whole Markdown files as chunks: (source, chunk_index, text). Only the
    listing decides; an error while reading is an error."""
    listed = lambda glob: not _files(spark, root, "binaryFile", glob, True).load(root).select("path").isEmpty()
    if listed("*.jsonl"):
        return chunks(spark, root).select("source", "chunk_index", "text")
    if not listed(MARKDOWN):
        raise ValueError(f"no chunks and no Markdown under {root}")
    return markdown(spark, root).select(F.col("rel_path").alias("source"), F.lit(0).alias("chunk_index"), "text")


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """A table of questions: (row_index, question, answer) of a CSV, JSON lines or Parquet file, or, where the machine can
    read them, a workbook; the columns are found by their names, and there may be no answers."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("xlsx", "xls"):
        rows = spark.createDataFrame(pd.read_excel(path, dtype=str).astype(object).where(lambda d: d.notna(), None))
    elif kind == "csv":
        rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    else:
        rows = spark.read.json(path) if kind in ("json", "jsonl") else spark.read.parquet(path)
    question = models.resolved(rows, "question")
    try:
        answer = F.col(f"`{models.resolved(rows, 'answer')}`")
    except ValueError:
        answer = F.lit(None).cast("string")
    numbered = rows.withColumn("_at", F.monotonically_increasing_id())  # a sheet is small
    index = F.row_number().over(Window.orderBy("_at")) - 1
    return numbered.select(index.alias("row_index"), F.col(f"`{question}`").alias("question"), answer.alias("answer"))


#: Keys that may hold the list of records.
LISTS = ("chunks", "items", "documents", "data", "records")


def records(spark: SparkSession, root: str) -> DataFrame:
    """(source, ordinal, record) of JSON files: the items of a list, or of the first list under a known key, else the
    whole object; other values as {"value": ...}. Files that are no JSON are dropped."""
    whole = _files(spark, root, "text", "*.json", True).option("wholetext", "true").load(root)
    rows = whole.select(F.col("_metadata.file_name").alias("source"), "value", F.schema_of_variant(F.try_parse_json("value")).alias("kind")).filter("kind IS NOT NULL")
    items = lambda c: F.from_json(c, "array<string>")
    listed = F.coalesce(*(F.when(F.get_json_object("value", f"$.{k}").startswith("["), items(F.get_json_object("value", f"$.{k}"))) for k in LISTS))
    found = (
        F.when(F.col("kind").startswith("ARRAY"), items(F.col("value")))
        .when(F.col("kind").startswith("OBJECT"), F.coalesce(listed, F.array("value")))
        .otherwise(F.array(F.concat(F.lit('{"value":'), F.trim("value"), F.lit("}"))))
    )
    return rows.select("source", F.posexplode(found).alias("ordinal", "record"))


def signature(spark: SparkSession, root: str, glob: str = "*.jsonl") -> DataFrame:
    """One row: a digest of names, sizes and times of the files of a corpus."""
    f = _files(spark, root, "binaryFile", glob, True).load(root)
    part = F.concat_ws("|", F.regexp_extract("path", r"([^/]+)$", 1), "length", F.floor(F.unix_millis("modificationTime") / 1000))
    return f.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(part)), ""), 256).alias("signature"))
