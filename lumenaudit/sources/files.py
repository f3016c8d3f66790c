"""Files and folders as tables, and files parsed once into element tables."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from .. import lineage
from ..functions import scalar as S
from ..schema import ELEMENTS, PARSED, PDF, SLIDES, WORD, empty
from . import ooxml, pdf

SUFFIX = {WORD: "docx", PDF: "pdf", SLIDES: "pptx"}
#: Parsed files that are passed on together: about so many bytes of elements, or so many files. The size
#: of packed content would not do: a few MB unfold to many times that.
GROUP_BYTES, GROUP_FILES = 4 << 20, 256
#: Of an element beside its texts, as a Python object; tables whose elements have texts.
ELEMENT_BYTES, WITH_TEXT = 200, ("paragraphs", "runs", "comments", "word_links", "text_items")
#: A parsed row without elements; its lists are shared and never changed.
NOTHING: dict = {name: [] for name in ELEMENTS} | {"error": None, "extract_error": None}
FILE_COLUMNS = ("path", "name", "dir", "ext", "kind", "size", "mtime")


def described(binary: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """Columns of ``files`` from Spark's binary files; content is read only if it is selected later."""
    path = F.col("path")
    rows = binary.select(path, S.base_name(path).alias("name"), S.folder_of(path).alias("dir"), S.extension(path).alias("ext"), S.kind_of(path, case_sensitive).alias("kind"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    return rows


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files directly in a folder."""
    return described(spark.read.format("binaryFile").load(folder)).select(*FILE_COLUMNS)


def walk_files(spark: SparkSession, folder: str, kind: str | None = None, case_sensitive: bool = True) -> DataFrame:
    """All files below a folder, with content. kind: of one kind alone; its extension counts in lower
    case only, unless ``case_sensitive`` is false."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if kind and case_sensitive:
        read = read.option("pathGlobFilter", f"*.{SUFFIX[kind]}")
    rows = described(read.load(folder))
    return rows.where(F.col("kind") == kind) if kind and not case_sensitive else rows


class FolderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(self.path)]

    def read(self, partition) -> Iterator[tuple]:
        try:
            with os.scandir(partition.value) as found:
                entries = sorted(found, key=lambda e: e.name)
        except (FileNotFoundError, PermissionError, NotADirectoryError) as e:
            reason = {FileNotFoundError: "does not exist", PermissionError: "may not be read"}.get(type(e), "is no folder")
            yield None, partition.value, None, None, f"{partition.value} {reason}"
            return
        for e in entries:
            kind = "folder" if e.is_dir() else "file"
            yield e.name, e.path, kind, None if kind == "folder" else e.stat().st_size, None


class FolderSource(DataSource):
    """``spark.read.format("folder").load(path)``: entries of one local folder, folders included."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return "name string, path string, entry_type string, size long, warning string"

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options["path"])


def list_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Files and folders in a local folder. One that cannot be read gives one row with a warning."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder").load(folder.removeprefix("file://"))



def held_bytes(row: dict) -> int:
    """What a parsed file takes, about."""
    size = 0
    for name in ELEMENTS:
        if elements := row[name]:
            size += ELEMENT_BYTES * len(elements)
            if name in WITH_TEXT:
                for e in elements:
                    size += len(e["text"] or "")
    return size


def parse_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Files (path, kind, content) as parsed rows."""
    held, size = [], 0
    for batch in batches:
        contents = batch.column(2)
        for i, (path, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            data = contents[i].as_py()  # one content at a time: they may be large
            row: dict = NOTHING | {"path": path, "kind": kind}
            try:
                if kind == PDF:
                    elements, row["extract_error"] = pdf.parse(data or b"")
                    row |= elements
                elif kind in (WORD, SLIDES):
                    row |= ooxml.parse(kind, data or b"")
            except Exception as e:  # whatever a damaged file makes a parser raise belongs to that file
                row = NOTHING | {"path": path, "kind": kind, "error": f"{type(e).__name__}: {e}"[:500]}
            held.append(row)
            size += held_bytes(row)
            if size >= GROUP_BYTES or len(held) >= GROUP_FILES:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def parsed_schema() -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(PARSED))


def parse_files(files: DataFrame) -> DataFrame:
    """One row for each file with its elements as arrays; ``files`` has path, kind and content.

    A file is opened once. One that cannot be read has an ``error`` and no elements and never fails
    the job; what a reader could not extract is in ``extract_error``.
    """
    schema = parsed_schema()
    lineage.bound_batches(files.sparkSession)
    return files.select("path", "kind", "content").mapInArrow(lambda batches: parse_batches(batches, schema), PARSED)


def element_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """Each element table as rows; they share the parsed rows, which the caller keeps or writes."""
    return {name: parsed.select("path", F.explode(name).alias("e")).select("path", "e.*") for name in ELEMENTS}


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: empty(spark, f"path string, {ddl}") for name, ddl in ELEMENTS.items()}
