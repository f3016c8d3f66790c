"""Statuses: decoded from files, reduced from issues, kept in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..schema import ACCESSIBLE, NOT_APPLICABLE, OTHER, PDF, UNTESTED, WORD


def office_status(custom_props: DataFrame) -> DataFrame:
    """path, value: of the property ``isAccessible``; of repeated ones the last counts."""
    return custom_props.where("name = 'isAccessible'").groupBy("path").agg(F.max_by("value", "ord").alias("value"))


def decode(files: DataFrame, custom_props: DataFrame, pdf_meta: DataFrame, store: DataFrame) -> DataFrame:
    """path, status of every file. files: path, kind. store: path, status of PDFs that cannot be
    opened. A status is only read here, never written."""
    office = office_status(custom_props)
    meta = pdf_meta.select("path", "keywords", "encrypted")
    known = store.select("path", F.col("status").alias("stored"))
    rows = files.join(office, "path", "left").join(meta, "path", "left").join(known, "path", "left")
    pdf = F.when(F.coalesce("encrypted", F.lit(False)), F.coalesce("stored", F.lit(UNTESTED))).otherwise(S.keyword_status(F.col("keywords")))
    status = F.when(F.col("kind") == OTHER, NOT_APPLICABLE).when(F.col("kind") == PDF, pdf).otherwise(S.property_status(F.col("value")))
    return rows.select(*files.columns, status.alias("status"))


def reduce_issues(files: DataFrame, issues: DataFrame) -> DataFrame:
    """path, kind, success, status, report_passed, n_issues, error.

    files: path, kind, error, n_heading_errors. Heading errors fail the report of a Word file but do
    not change its status. A file that could not be read has no success and stays Untested.
    """
    rows = files.join(issues.groupBy("path").agg(F.count("*").alias("n")), "path", "left")
    n, bad = F.coalesce("n", F.lit(0)), F.col("error").isNotNull()
    status = F.when(bad, UNTESTED).otherwise(S.tested_status(F.col("kind"), n))
    passed = ~bad & (n == 0) & (~(F.col("kind") == WORD) | (F.col("n_heading_errors") == 0))
    return rows.select("path", "kind", (~bad).alias("success"), status.alias("status"), passed.alias("report_passed"), n.cast("long").alias("n_issues"), "error")


def upsert(store: DataFrame, updates: DataFrame, key: str = "path", order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """The latest row of each key; of equal ones, the update."""
    both = store.withColumn("newer", F.lit(0)).unionByName(updates.withColumn("newer", F.lit(1)))
    names = [c for c in store.columns if c != key]
    last = both.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order, "newer")).alias("last"))
    return last.select(key, "last.*").select(*store.columns)


def lookup(paths: DataFrame, store: DataFrame) -> DataFrame:
    """path, status: stored, else Untested."""
    return paths.join(store.select("path", "status"), "path", "left").withColumn("status", F.coalesce("status", F.lit(UNTESTED)))


def set_accessible(files: DataFrame, accessible: bool = True) -> DataFrame:
    return files.withColumn("status", F.lit(ACCESSIBLE if accessible else "Not Accessible"))
