"""Book containers as a Python data source: ``spark.read.format("books")``.

A container is a zip file with a directory at its end, so a part of it can be read without the rest.  Containers of up to
``span`` bytes are dealt over partitions whole, several to one; a larger one is cut into spans of its bytes, and
each task reads the directory, the package file and those parts that begin in its span.  Nothing holds a whole
container, neither a row nor a batch.  Many spans are dealt over a number of tasks that follows the cores.
"""

from __future__ import annotations

import fnmatch
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.functions.text import basename, slug
from quillspark.sources.epub import Package, decode, read_package

SPAN = 32 * 1024 * 1024
BATCH_BYTES = 8 * 1024 * 1024
TASKS = 10_000  # most partitions, where the caller names no number
TASKS_PER_CORE = 8
ROWS = {
    "documents": "book_id string, pos int, item_id string, name string, html string",
    "packages": "book_id string, title string, author string",
}


@dataclass
class Span(InputPartition):
    """Files of a partition; of each the span to read and the number of spans."""

    files: list[tuple[str, int, int]]


def plan_spans(sizes: list[tuple[str, int]], span: int) -> list[Span]:
    """Small files together up to ``span`` bytes, large ones in pieces of about that size."""
    out, group, total = [], [], 0
    for path, size in sizes:
        pieces = -(-size // span) or 1
        if pieces > 1:
            out += [Span([(path, k, pieces)]) for k in range(pieces)]
            continue
        if group and total + size > span:
            out.append(Span(group))
            group, total = [], 0
        group.append((path, 0, 1))
        total += size
    return [*out, Span(group)] if group else out


def dealt(spans: list[Span], tasks: int) -> list[Span]:
    """The spans over at most ``tasks`` partitions, in turn, so that spans of one container meet different tasks."""
    return [Span([f for s in spans[k::tasks] for f in s.files]) for k in range(min(tasks, len(spans)))]


class BookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.glob = options["path"], options.get("glob", "*.epub")
        self.span, self.rows = int(options.get("span", SPAN)), options.get("rows", "documents")
        self.tasks = int(options.get("tasks", TASKS))

    def partitions(self) -> list[Span]:
        system, path = fs.FileSystem.from_uri(self.root)
        found = system.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        listed = [found] if found.is_file else system.get_file_info(fs.FileSelector(path))
        sizes = [(f.path, f.size) for f in listed if f.is_file and (found.is_file or fnmatch.fnmatch(f.base_name, self.glob))]
        if self.rows == "packages":  # each container once
            return dealt(plan_spans([(p, min(s, self.span // 64)) for p, s in sorted(sizes)], self.span), self.tasks)
        return dealt(plan_spans(sorted(sizes), self.span), self.tasks)

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.root)
        rows, held = [], 0
        for path, k, pieces in partition.files if partition else []:  # a plan without files has one empty partition
            with system.open_input_file(path) as file, zipfile.ZipFile(file) as box:
                name = f"file:{path}" if isinstance(system, fs.LocalFileSystem) else path
                package = read_package(box)
                if self.rows == "packages":
                    rows.append((name, package.title, package.author))
                    continue
                for pos, item_id, part in _within(box, package, file.size(), k, pieces):
                    html = decode(box.read(part))
                    rows.append((name, pos, item_id, package.names[item_id] or item_id, html))
                    held += len(html)
                    if held > BATCH_BYTES:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        names = [field.split()[0] for field in ROWS[self.rows].split(", ")]
        types = [pa.int32() if n == "pos" else pa.string() for n in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _within(box: zipfile.ZipFile, package: Package, size: int, k: int, pieces: int) -> Iterator[tuple[int, str, zipfile.ZipInfo]]:
    """Place, id and zip entry of the documents in reading order whose entry begins in span ``k``."""
    for pos, item_id in enumerate(package.spine):
        if item_id in package.parts:
            part = box.getinfo(package.parts[item_id])
            if part.header_offset * pieces // max(size, 1) == k:
                yield pos, item_id, part


class BookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "books"

    def schema(self) -> str:
        return ROWS[self.options.get("rows", "documents")]

    def reader(self, schema) -> BookReader:
        return BookReader(dict(self.options))


def _read(spark: SparkSession, path: str, rows: str, **options: str) -> DataFrame:
    spark.dataSource.register(BookSource)
    tasks = str(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return spark.read.format("books").options(path=path, rows=rows, **{"tasks": tasks, **options}).load()


def read_documents(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Documents of the containers in a folder, or of one, in reading order; references without a document are dropped."""
    return _read(spark, path, "documents", **options)


def read_books(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """One row per container: identity and metadata."""
    found = _read(spark, path, "packages", **options)
    title = F.coalesce(F.nullif("title", F.lit("")), basename("book_id"))
    return found.select(
        "book_id", title.alias("title"), F.coalesce(F.nullif("author", F.lit("")), F.lit("Unknown")).alias("author"),
        slug(title).alias("slug"), basename("book_id").alias("source"),
    )
