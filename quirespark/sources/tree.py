"""A tree of text files as a data source: ``format("quire_tree")`` after ``register(spark)``.

Reading plans partitions of files by their bytes. Writing (rel_path, text) stages each task's files below the target and puts
them in their places when the job commits, from a manifest for each task; if it fails, what was staged is deleted, so that
readers see all of a run's files or none of them new. The path is a folder that driver and executors share, or the address
of a store that Arrow knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SUFFIXES = ("md", "markdown")
STAGING = ".quire-staging-"
#: Bytes of files in a partition, and of texts in a batch; a larger file is alone.
PARTITION_BYTES = 32 << 20


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path.rstrip("/"))


def _parts(name: str) -> str:
    """``name`` without what would lead out of the tree."""
    return "/".join(x for x in name.split("/") if x not in ("", ".", ".."))


@dataclass
class Files(InputPartition):
    names: list[str]


class TreeReader(DataSourceReader):
    def __init__(self, path: str, suffixes: tuple[str, ...], size: int):
        self.path, self.suffixes, self.size = path, suffixes, size

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, root = _store(self.path)
        found = sorted((f.path, f.size or 0) for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File)
        out, held = [], 0
        for name, size in found:
            inner = name[len(root) :].lstrip("/")
            if STAGING in inner or not inner.lower().endswith(tuple(f".{s}" for s in self.suffixes)):
                continue
            if not out or held + size > self.size:
                out, held = [*out, Files([])], 0
            out[-1].names.append(inner)
            held += size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, root = _store(self.path)
        names, texts, held = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["rel_path", "text"])

        for name in partition.names:
            with store.open_input_stream(f"{root}/{name}") as file:
                text = file.read().decode("utf-8", "replace")
            names.append(name)
            texts.append(text)
            held += len(text)
            if held >= self.size:
                yield batch()
                names, texts, held = [], [], 0
        if names:
            yield batch()


@dataclass
class Staged(WriterCommitMessage):
    manifest: str
    files: int


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.stage = path, f"{STAGING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, root = _store(self.path)
        own = f"{root}/{self.stage}/{uuid.uuid4().hex}"  # an attempt's, so that a task can run twice at a time
        store.create_dir(own, recursive=True)
        n = 0
        with store.open_output_stream(f"{own}/manifest") as manifest:
            for b in iterator:
                for name, text in zip(b.column("rel_path").to_pylist(), b.column("text").to_pylist(), strict=True):
                    target = _parts(name or "")
                    if not target:
                        raise ValueError("a document without a path cannot be written")
                    with store.open_output_stream(f"{own}/{n}") as out:
                        out.write((text or "").encode())
                    manifest.write((json.dumps([f"{own}/{n}", target]) + "\n").encode())
                    n += 1
        return Staged(f"{own}/manifest", n)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = _store(self.path)
        folders: set[str] = set()
        for message in filter(None, messages):
            with store.open_input_stream(message.manifest) as lines:
                for line in lines.read().splitlines():
                    staged, target = json.loads(line)
                    folder = f"{root}/{target}".rpartition("/")[0]
                    if folder not in folders:
                        store.create_dir(folder, recursive=True)
                        folders.add(folder)
                    store.move(staged, f"{root}/{target}")
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        if store.get_file_info(f"{root}/{self.stage}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.stage}")


class Tree(DataSource):
    """Options: ``path``; ``suffixes``, by commas, of the files to read; ``partitionbytes``. Writing appends, and replaces files of
    the same name; of documents that share a path one stays."""

    @classmethod
    def name(cls) -> str:
        return "quire_tree"

    def schema(self) -> str:
        return "rel_path string, text string"

    def reader(self, schema: StructType) -> TreeReader:
        suffixes = tuple(x.strip().lower() for x in self.options.get("suffixes", ",".join(SUFFIXES)).split(","))
        return TreeReader(self.options["path"], suffixes, int(self.options.get("partitionbytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"])


def register(spark: SparkSession) -> str:
    spark.dataSource.register(Tree)
    return Tree.name()
