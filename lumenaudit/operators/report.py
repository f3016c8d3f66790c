"""Folder reports, listings and batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..schema import ACCESSIBLE, KINDS, MANUAL, UNTESTED


def folder_report(files: DataFrame, *by: str) -> DataFrame:
    """Counts of files by status and the accessible percentage. files: status, and the columns ``by``."""

    def n(status: str):
        return F.count_if(F.col("status") == status)

    counts = files.groupBy(*by).agg(F.count("*").alias("num_files"), n(ACCESSIBLE).alias("num_accessible"), n(UNTESTED).alias("num_untested"), n(MANUAL).alias("num_manual"))
    rest = F.col("num_files") - F.col("num_accessible") - F.col("num_untested") - F.col("num_manual")
    return counts.withColumn("num_inaccessible", rest).withColumn("rate", S.percentage(F.col("num_accessible"), F.col("num_files")))


def pie(report: DataFrame, *by: str) -> DataFrame:
    """The four slices of a report, one row each."""
    slices = "stack(4, 'Accessible', num_accessible, 'Not Accessible', num_inaccessible, 'Untested', num_untested, 'Manual', num_manual) as (slice, n)"
    return report.selectExpr(*by, slices)


def ancestors(files: DataFrame, path: str = "path") -> DataFrame:
    """Each file once for every folder above it: adds ``folder``."""
    parts = F.split(S.folder_of(F.col(path)), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.withColumn("folder", F.explode(above))


def tree_report(files: DataFrame) -> DataFrame:
    """A folder report for every folder, files in its subfolders included."""
    return folder_report(ancestors(files), "folder")


def with_icons(files: DataFrame) -> DataFrame:
    return files.withColumn("icon", S.icon(F.col("status"))).withColumn("icon_text", S.icon_text(F.col("icon")))


def in_batch_order(files: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Files of the selected kinds with the rank in which a batch takes them."""
    if not kinds:
        raise ValueError("select at least one kind of file")
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    return files.where(F.col("kind").isin(*kinds)).withColumn("kind_rank", rank.cast("int"))
