"""Explicit writes: HTML reports, status tables, office properties, comments in Word files.

Queries never write. What changes files works on bytes here; ``actions`` does so for tables of files.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from datetime import datetime, timezone
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.issues import repairs
from .ooxml import COMMENTS, CUSTOM, DOCUMENT, VT, W, members

# Names that the office formats prescribe.
FMTID = "{D5CDD505-2E9C-101B-9397-08002B2CF9AE}"
CUSTOM_NS = "http://schemas.openxmlformats.org/officeDocument/2006/custom-properties"
CONTENT_NS = "http://schemas.openxmlformats.org/package/2006/content-types"
RELS_NS = "http://schemas.openxmlformats.org/package/2006/relationships"
OFFICE_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
CUSTOM_TYPE = "application/vnd.openxmlformats-officedocument.custom-properties+xml"
COMMENTS_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.comments+xml"
PROPERTY = "isAccessible"


def report_path(folder: str, kind, name):
    """Where the report of a file goes: a folder for each kind."""
    return F.concat_ws("/", F.lit(folder.rstrip("/")), kind, F.concat(name, F.lit(".html")))


def escaped(column):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        column = F.replace(column, F.lit(a), F.lit(b))
    return column


def html_reports(results: DataFrame, issues: DataFrame, folder: str) -> DataFrame:
    """path, report_path, html: one report for each row of ``results`` (path, kind, status,
    report_passed), its issues as a table in a fixed order, each with the steps that repair it. Files
    of one kind and name have a hash of their path in the report's name. Built without Python."""
    cell = lambda c: F.concat(F.lit("<td>"), escaped(F.coalesce(c, F.lit(""))), F.lit("</td>"))
    detail = F.array_join(F.array_sort(F.transform(F.map_entries("detail"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), ", ")
    line = F.concat(F.lit("<tr>"), *[cell(F.col(c)) for c in ("criterion", "impact", "rule_id", "location")], cell(detail), cell(F.array_join("steps", " ")), F.lit("</tr>"))
    lines = repairs(issues).select("path", line.alias("line")).groupBy("path").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("lines"))
    rows = results.select("path", "kind", "status", "report_passed").join(lines, "path", "left")
    name = S.base_name(F.col("path"))
    named = rows.withColumn("name", name)
    repeated = named.groupBy("kind", "name").agg(F.count("*").alias("n")).where("n > 1").select("kind", "name", F.lit(True).alias("repeated"))
    rows = named.join(repeated, ["kind", "name"], "left")
    place = F.when(F.col("repeated"), F.concat(name, F.lit("-"), F.substring(F.sha2("path", 256), 1, 16))).otherwise(name)
    head = F.concat(F.lit("<!doctype html><html lang=\"en\"><head><meta charset=\"utf-8\"><title>"), escaped(name), F.lit("</title></head><body><h1>"), escaped(name), F.lit("</h1><p>"), F.when(F.col("report_passed"), "Passed").otherwise("Failed"), F.lit(": "), F.col("status"), F.lit("</p>"))
    table = F.when(F.col("lines").isNull(), "<p>No issues.</p>").otherwise(F.concat(F.lit("<table><tr><th>Criterion</th><th>Impact</th><th>Rule</th><th>Place</th><th>Detail</th><th>Repair</th></tr>\n"), F.col("lines"), F.lit("\n</table>")))
    return rows.select("path", report_path(folder, F.col("kind"), place).alias("report_path"), F.concat(head, table, F.lit("</body></html>")).alias("html"))


def write_reports(reports: DataFrame, folder: str) -> None:
    """As a table of HTML texts, partitioned by the folder of each kind."""
    kind = S.base_name(S.folder_of(F.col("report_path")))
    reports.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").parquet(folder)


def write_status(spark: SparkSession, updates: DataFrame, store: str) -> DataFrame:
    """Upserts (path, status, updated_by, updated_at) into a store: versions beside each other, the
    newest pointing at whole data, so a reader never meets a half-written store."""
    from ..operators.status import upsert

    old = read_status(spark, store)
    version = f"{store.rstrip('/')}/{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}"
    upsert(old, updates.select(*old.columns)).write.parquet(version)
    return read_status(spark, store)


def read_status(spark: SparkSession, store: str) -> DataFrame:
    """The newest whole version of a store, empty where there is none."""
    schema = "path string, status string, updated_by string, updated_at timestamp"
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    whole = sorted(str(p) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
    return spark.read.schema(schema).parquet(whole[-1]) if whole else spark.createDataFrame([], schema)


def rezipped(data: bytes, changed: dict[str, bytes]) -> bytes:
    """A copy of a zip with some members changed or added, the others in their order."""
    out, left = io.BytesIO(), dict(changed)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members(data):
            z.writestr(name, left.pop(name, content))
        for name, content in left.items():
            z.writestr(name, content)
    return out.getvalue()


def xml_bytes(root: ET.Element) -> bytes:
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)


def with_property(xml: bytes | None, value: str) -> bytes:
    """Custom properties with the accessibility property set: changed, added or made anew."""
    ET.register_namespace("", CUSTOM_NS)
    ET.register_namespace("vt", VT[1:-1])
    root = ET.fromstring(xml) if xml else ET.Element(f"{{{CUSTOM_NS}}}Properties")
    found = next((p for p in root if p.get("name") == PROPERTY), None)
    if found is None:
        pid = max([1, *(int(p.get("pid") or 1) for p in root)]) + 1
        found = ET.SubElement(root, f"{{{CUSTOM_NS}}}property", {"fmtid": FMTID, "pid": str(pid), "name": PROPERTY})
    for old in list(found):
        found.remove(old)
    ET.SubElement(found, f"{VT}bool").text = value
    return xml_bytes(root)


def with_type(xml: bytes, part: str, kind: str) -> bytes:
    ET.register_namespace("", CONTENT_NS)
    root = ET.fromstring(xml)
    if not any(e.get("PartName") == part for e in root):
        ET.SubElement(root, f"{{{CONTENT_NS}}}Override", {"PartName": part, "ContentType": kind})
    return xml_bytes(root)


def with_relationship(xml: bytes | None, kind: str, target: str) -> bytes:
    """One relationship of the kind; a new id is above all others."""
    ET.register_namespace("", RELS_NS)
    root = ET.fromstring(xml) if xml else ET.Element(f"{{{RELS_NS}}}Relationships")
    if not any(e.get("Type") == f"{OFFICE_REL}/{kind}" for e in root):
        taken = [int(m[1]) for e in root if (m := re.fullmatch(r"rId(\d+)", e.get("Id") or ""))]
        ET.SubElement(root, f"{{{RELS_NS}}}Relationship", {"Id": f"rId{max([0, *taken]) + 1}", "Type": f"{OFFICE_REL}/{kind}", "Target": target})
    return xml_bytes(root)


def set_property(data: bytes, accessible: bool) -> bytes:
    """An office file with its accessibility property set to 1 or 0."""
    parts = dict(members(data))
    changed = {CUSTOM: with_property(parts.get(CUSTOM), "1" if accessible else "0")}
    if "[Content_Types].xml" in parts:
        changed["[Content_Types].xml"] = with_type(parts["[Content_Types].xml"], f"/{CUSTOM}", CUSTOM_TYPE)
    changed["_rels/.rels"] = with_relationship(parts.get("_rels/.rels"), "custom-properties", CUSTOM)
    return rezipped(data, changed)


def merged_keywords(keywords: str | None, status: str, user: str) -> str:
    """PDF keywords as JSON with the status set; keywords that are no JSON are kept under their own key."""
    try:
        found = json.loads(keywords) if keywords else {}
        found = found if isinstance(found, dict) else {"keywords": found}
    except ValueError:
        found = {"keywords": keywords}
    return json.dumps(found | {"isAccessible": status, "accessibilityStatusUpdatedBy": user})


def anchored(paras: list[ET.Element], target: str) -> ET.Element | None:
    """The text element that a comment is for: equal, containing, or completing the target."""
    texts = [(p, t) for p in paras for t in p.iter(f"{W}t")]
    for fits in (lambda s: s == target, lambda s: target in s):
        for _, t in texts:
            if fits(t.text or ""):
                return t
    for p in paras:
        running = ""
        for t in p.iter(f"{W}t"):
            running += t.text or ""
            if target in running:
                return t
    return None


def add_comment(data: bytes, target: str, comment: str, author: str = "Accessibility audit", when: str | None = None) -> bytes:
    """A Word file with a comment on the run that holds ``target``; raises LookupError if none does."""
    ET.register_namespace("w", W[1:-1])
    parts = dict(members(data))
    root = ET.fromstring(parts[DOCUMENT])
    above = {child: parent for parent in root.iter() for child in parent}
    text = anchored(list(root.iter(f"{W}p")), target)
    if text is None:
        raise LookupError(f"no text for {target!r}")
    comments = ET.fromstring(parts[COMMENTS]) if COMMENTS in parts else ET.Element(f"{W}comments")
    number = str(max([0, *(int(c.get(f"{W}id") or 0) for c in comments)]) + 1)
    run = above[text]
    holder = above[run]
    at = list(holder).index(run)
    mark = ET.Element(f"{W}r")
    ET.SubElement(mark, f"{W}commentReference", {f"{W}id": number})
    holder.insert(at, ET.Element(f"{W}commentRangeStart", {f"{W}id": number}))
    holder.insert(at + 2, ET.Element(f"{W}commentRangeEnd", {f"{W}id": number}))
    holder.insert(at + 3, mark)
    when = when or f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ}"
    note = ET.SubElement(comments, f"{W}comment", {f"{W}id": number, f"{W}author": author, f"{W}date": when})
    ET.SubElement(ET.SubElement(ET.SubElement(note, f"{W}p"), f"{W}r"), f"{W}t").text = comment
    rels = posixpath.join("word/_rels", "document.xml.rels")
    changed = {DOCUMENT: xml_bytes(root), COMMENTS: xml_bytes(comments), rels: with_relationship(parts.get(rels), "comments", "comments.xml")}
    if "[Content_Types].xml" in parts:
        changed["[Content_Types].xml"] = with_type(parts["[Content_Types].xml"], f"/{COMMENTS}", COMMENTS_TYPE)
    return rezipped(data, changed)

