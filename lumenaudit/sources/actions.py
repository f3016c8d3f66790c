"""Actions on tables of files: statuses, comments and reports written to new files.

Each takes a DataFrame, works one file at a time where its content is, writes a new file below a
folder that all executors reach, and returns a saved table of what was written, so that nothing is
written twice by reading it again. A file goes to a temporary name first; a task that is run again
leaves one whole file. One that cannot be changed has an ``error`` and fails nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lineage
from ..functions import scalar as S
from ..schema import ACCESSIBLE, PDF, SLIDES, WORD
from . import writers
from .pdf import Document, decoded
from .pdf_update import with_keywords

WRITTEN = "path string, written string, error string"


def put(uri: str, data: bytes) -> None:
    """uri: a local path, or one with a scheme that pyarrow knows."""
    system, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(part := f"{path}.{uuid.uuid4().hex}.part") as f:
        f.write(data)
    system.move(part, path)


def rewritten(rows: DataFrame, change: Callable[..., bytes]) -> DataFrame:
    """``rows`` has path, written (where to), content and what else ``change`` takes after these."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str | None, str | None]] = []
            for i in range(batch.num_rows):  # one content at a time: they may be large
                path, target, *values = (column[i].as_py() for column in batch.columns)
                try:
                    put(target, change(*values))
                    out.append((path, target, None))
                except Exception as e:  # whatever a damaged file makes a writer raise belongs to that file
                    out.append((path, None, f"{type(e).__name__}: {e}"[:500]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)] if out else [pa.array([], pa.string())] * 3, ["path", "written", "error"])

    return lineage.save(rows.mapInArrow(work, WRITTEN), f"{lineage.work_dir(rows.sparkSession, 'written')}/files")


def own_place(folder: str, path: Column) -> Column:
    """Below ``folder``, one place for each path: a folder named by the path's hash keeps equal names apart."""
    return F.concat_ws("/", F.lit(folder.rstrip("/")), F.substring(F.sha2(path, 256), 1, 16), S.base_name(path))


def with_status(content: bytes | None, kind: str, status: str, user: str) -> bytes:
    data = content or b""
    if kind in (WORD, SLIDES):
        return writers.set_property(data, status == ACCESSIBLE)
    if kind != PDF:
        raise ValueError(f"no status in files of kind {kind}")
    doc = Document(data)
    old = None if doc.encrypted else decoded(doc.get(doc.dict(doc.trailer.get("Info")).get("Keywords")))
    return with_keywords(data, writers.merged_keywords(old, status, user))


def write_statuses(files: DataFrame, statuses: DataFrame, folder: str, user: str) -> DataFrame:
    """path, written, error: files (path, kind, content) whose path is in ``statuses`` (path, status;
    of repeated paths the greatest status) with the status inside: a property of office files, the
    keywords of PDFs. Encrypted PDFs have an error; theirs is kept in the store alone."""
    told = statuses.where("path is not null").groupBy("path").agg(F.max("status").alias("status"))
    rows = files.join(told, "path").select("path", own_place(folder, F.col("path")).alias("written"), "content", "kind", "status", F.lit(user).alias("user"))
    return rewritten(rows, with_status)


def with_comments(content: bytes | None, notes: list[dict]) -> bytes:
    data = content or b""
    for note in notes:
        data = writers.add_comment(data, note["target"] or "", note["comment"] or "")
    return data


def write_comments(files: DataFrame, notes: DataFrame, folder: str) -> DataFrame:
    """path, written, error: Word files (path, content) with comments from ``notes`` (path, target,
    comment), in the order of target and comment. A file with a target it does not hold has an error."""
    told = notes.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("target", "comment"))).alias("notes"))
    rows = files.join(told, "path").select("path", own_place(folder, F.col("path")).alias("written"), "content", "notes")
    return rewritten(rows, with_comments)


def write_report_files(reports: DataFrame) -> DataFrame:
    """path, written, error: each report (path, report_path, html) as an HTML file at its place."""
    return rewritten(reports.select("path", "report_path", "html"), lambda html: (html or "").encode())
