"""A remote document store: nodes listed over HTTP, or from a JSON snapshot; contents read and
uploaded where tasks run.

Options: ``url`` (of the store) and ``ticket`` or ``user`` and ``password``; or ``snapshot``, a JSON
file with one node per line, for listings. Certificates are always verified.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import lineage
from ..functions import scalar as S
from . import trees

# The store's public interface.
TICKET_HEADER = "OTCSTicket"
AUTH, CHILDREN, CONTENT, VERSIONS = "/api/v1/auth", "/api/v1/nodes/{}/nodes", "/api/v1/nodes/{}/content", "/api/v1/nodes/{}/versions"

NODE = "id long, parent_id long, type int, name string, mime_type string, size long"


def answer(request: urllib.request.Request | str, data: bytes | None = None, tries: int = 3, timeout: int = 120) -> tuple[bytes, dict[str, str]]:
    """Body and headers; asked again where the server fails or does not answer, raises OSError in the end."""
    for left in range(tries - 1, -1, -1):
        try:
            with urllib.request.urlopen(request, data, timeout) as got:
                return got.read(), {k.lower(): v for k, v in got.headers.items()}
        except OSError as e:
            if not left or (isinstance(e, urllib.error.HTTPError) and e.code < 500):
                raise
            time.sleep(1)
    raise AssertionError


def ticket_of(options: dict) -> str:
    if "ticket" in options:
        return options["ticket"]
    body = urllib.parse.urlencode({"username": options["user"], "password": options["password"]}).encode()
    return json.loads(answer(options["url"] + AUTH, body)[0])["ticket"]


def listed(url: str, ticket: str, parent: int) -> Iterator[dict]:
    """Children of a node, page by page where the store deals them so."""
    page, pages = 1, 1
    while page <= pages:
        ask = urllib.request.Request(url + CHILDREN.format(parent) + ("" if page == 1 else f"?page={page}"), headers={TICKET_HEADER: ticket})
        got = json.loads(answer(ask)[0])
        yield from ({**n, "parent_id": parent} for n in got["data"])
        page, pages = page + 1, int(got.get("page_total") or 1)


class NodeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [InputPartition(int(i)) for i in self.options.get("nodes", "0").split(",")]

    def rows(self, parent: int) -> Iterator[dict]:
        if "snapshot" in self.options:
            with open(self.options["snapshot"], encoding="utf-8") as f:
                yield from map(json.loads, filter(str.strip, f))
            return
        yield from listed(self.options["url"], ticket_of(self.options), parent)

    def read(self, partition) -> Iterator[tuple]:
        for n in self.rows(partition.value):
            yield tuple(n.get(k) for k in ("id", "parent_id", "type", "name", "mime_type", "size"))


class NodeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documentstore"

    def schema(self) -> str:
        return NODE

    def reader(self, schema) -> DataSourceReader:
        return NodeReader(dict(self.options))


def nodes(spark: SparkSession, **options: str) -> DataFrame:
    spark.dataSource.register(NodeSource)
    return spark.read.format("documentstore").options(**options).load()


def files_of(nodes: DataFrame, folder: int | None = None) -> DataFrame:
    """Documents, in one folder or anywhere; a path is the id and the name."""
    rows = nodes.where(F.col("type") == trees.DOCUMENT)
    rows = rows if folder is None else rows.where(F.col("parent_id") == folder)
    path = F.concat_ws("/", F.col("id").cast("string"), "name")
    return rows.select("id", path.alias("path"), "name", S.kind_of(F.col("name")).alias("kind"), "size", "mime_type")


def folders_of(nodes: DataFrame, folder: int) -> DataFrame:
    return nodes.where((F.col("type") == trees.FOLDER) & (F.col("parent_id") == folder)).select("id", F.col("id").cast("string").alias("path"), "name")


def walk_remote(nodes: DataFrame, folder: int, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Documents below a folder at any depth, of the given kinds (extensions in either case)."""
    rows = files_of(trees.walk(nodes, folder))
    return rows.where(F.col("kind").isin(*kinds)) if kinds else rows


def descend(spark: SparkSession, folder: int, **options: str) -> DataFrame:
    """All nodes below a folder, each level listed by tasks; a folder is listed once, whatever names it."""
    url, ticket, place = options["url"], ticket_of(options), lineage.work_dir(spark, "nodes")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parent in batch.column(0).to_pylist():
                rows = [{k: n.get(k) for k in kinds.names} for n in listed(url, ticket, parent)]
                yield pa.RecordBatch.from_pylist(rows, kinds)

    kinds = pa.schema([("id", pa.int64()), ("parent_id", pa.int64()), ("type", pa.int32()), ("name", pa.string()), ("mime_type", pa.string()), ("size", pa.int64())])
    level, levels, asked = spark.createDataFrame([(folder,)], "id long"), [], []
    while not level.isEmpty():
        asked.append(level)
        levels.append(lineage.save(level.repartition("id").mapInArrow(work, NODE), f"{place}/{len(levels)}"))
        level = levels[-1].where(F.col("type") == trees.FOLDER).select("id").distinct()
        for known in asked:
            level = level.join(known, "id", "left_anti")
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def fetch(files: DataFrame, **options: str) -> DataFrame:
    """path, name, kind, size, content, error of documents (id, path, name, size): read from the store
    one at a time. The name is that of the answer, if it has one. One that cannot be read has an error
    and no content. Reading the result again asks the store again; ``api.audit`` reads it once."""
    url, ticket = options["url"], ticket_of(options)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "name", "size", "header", "content", "error"]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        for batch in batches:
            for node, path, name, size in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    ask = urllib.request.Request(url + CONTENT.format(node), headers={TICKET_HEADER: ticket})
                    content, headers = answer(ask)
                    row = path, name, len(content), headers.get("content-disposition"), content, None
                except OSError as e:
                    row = path, name, size, None, None, f"{type(e).__name__}: {e}"[:500]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    rows = files.select("id", "path", "name", "size").mapInArrow(work, "path string, name string, size long, header string, content binary, error string")
    name = F.coalesce(F.nullif(S.attachment_name(F.col("header")), F.lit("")), F.col("name"))
    return rows.withColumn("name", name).select("path", "name", S.kind_of(F.col("name")).alias("kind"), "size", "content", "error")


def upload(files: DataFrame, description: str = "accessibility tested", **options: str) -> DataFrame:
    """id, uploaded, error: each file (id, name, content) becomes a new version of its node. The result
    is saved, so files are sent once; a task that Spark repeats may add a version twice."""
    url, ticket = options["url"], ticket_of(options)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, name, content in zip(*(c.to_pylist() for c in batch.columns)):
                error = None
                try:
                    mark = uuid.uuid4().hex
                    quoted = (name or "").replace("\\", "\\\\").replace('"', '\\"').replace("\r", "").replace("\n", "")
                    parts = [f'--{mark}\r\nContent-Disposition: form-data; name="description"\r\n\r\n{description}\r\n', f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="{quoted}"\r\nContent-Type: application/octet-stream\r\n\r\n']
                    body = "".join(parts).encode() + (content or b"") + f"\r\n--{mark}--\r\n".encode()
                    ask = urllib.request.Request(url + VERSIONS.format(node), body, {TICKET_HEADER: ticket, "Content-Type": f"multipart/form-data; boundary={mark}"})
                    answer(ask, tries=1)
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"[:500]
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([error is None]), pa.array([error], pa.string())], ["id", "uploaded", "error"])

    rows = files.select("id", "name", "content").mapInArrow(work, "id long, uploaded boolean, error string")
    return lineage.save(rows, f"{lineage.work_dir(files.sparkSession, 'uploaded')}/nodes")
