"""Entry points: list a folder, audit files, report on a folder, set a status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lineage
from ..functions import scalar as S
from ..operators import issues as I
from ..operators import pdf_rules, report, slide_rules, status, word_rules
from ..schema import ACCESSIBLE, ISSUE, KINDS, MANUAL, NOT_ACCESSIBLE, OTHER, PDF, SLIDES, UNTESTED, WORD, empty
from ..sources import files as sources
from ..sources import remote


@dataclass
class Audit:
    """results: path, kind, success, status, report_passed, n_issues, error; issues: all found, heading
    errors and unreadable files included; tables: the element tables. All are read from the parsed
    rows in ``folder``, which ``free`` removes, or the end of the driver."""

    results: DataFrame
    issues: DataFrame
    tables: dict[str, DataFrame]
    folder: str | None = None

    def free(self) -> None:
        if self.folder:
            lineage.drop(self.results.sparkSession, self.folder)


def audit(files: DataFrame, kinds: tuple[str, ...] = KINDS, keep=None) -> Audit:
    """Tests files (path, kind, content) of the selected kinds.

    Each file is opened once: the parsed rows are written to a table in the shared folder, from which
    every element table reads its own column. keep: what else to do with them.
    """
    return audit_parsed(sources.parse_files(report.in_batch_order(files, kinds)), kinds, keep)


def audit_parsed(parsed: DataFrame, kinds: tuple[str, ...] = KINDS, keep=None) -> Audit:
    """The same of files that are parsed where they come from (rows as of ``parse_files``)."""
    spark = parsed.sparkSession
    folder = None if keep else lineage.work_dir(spark, "audit")
    parsed = (keep or (lambda df: lineage.save(df, f"{folder}/parsed")))(parsed)
    tables = sources.element_tables(parsed)
    by_kind = {PDF: pdf_rules.audit, SLIDES: slide_rules.audit, WORD: word_rules.audit}
    # rules of one kind pass over the files of the others: whole row groups by their statistics
    of_kind = {k: parsed.where(F.col("kind") == k) for k in kinds}
    found = I.union_issues([empty(spark, ISSUE), *[x for k in kinds for x in by_kind[k](sources.element_tables(of_kind[k]))]])
    headings = word_rules.heading_issues(of_kind[WORD]) if WORD in kinds else empty(spark, ISSUE)
    encrypted = F.expr("exists(pdf_meta, m -> m.encrypted)")
    if PDF in kinds:
        found = found.join(of_kind[PDF].where(encrypted).select("path"), "path", "left_anti")
    told = parsed.withColumn("error", F.coalesce("error", F.when(encrypted, "encrypted")))
    n_errors = F.when(F.col("kind") == WORD, word_rules.count_errors(word_rules.headings_of(F.col("paragraphs")))).otherwise(0)
    results = status.reduce_issues(told.select("path", "kind", "error", n_errors.alias("n_heading_errors")), found)
    errors = told.where("error is not null").select("path", "error")
    unread = I.issue(errors, "parse-error", F.lit("file"), error=F.col("error"))
    return Audit(results, I.union_issues([found, headings, unread]), tables, folder)


def audit_folder(spark: SparkSession, folder: str, kinds: tuple[str, ...] = KINDS, case_sensitive: bool = True) -> Audit:
    """All files below a folder; ValueError where no kind is selected or nothing is found."""
    if not kinds:
        raise ValueError("select at least one kind of file")
    files = sources.walk_files(spark, folder)
    files = files.where(S.kind_of(F.col("path"), case_sensitive).isin(*kinds))
    if files.select("path").isEmpty():
        raise ValueError("no documents")
    return audit(files, kinds)


def audit_remote(spark: SparkSession, folder: int, kinds: tuple[str, ...] = KINDS, deep: bool = True, **options: str) -> Audit:
    """Documents of a folder of the remote store, below it at any depth if ``deep``; see ``remote``."""
    nodes = remote.descend(spark, folder, **options) if deep else remote.nodes(spark, nodes=str(folder), **options)
    files = remote.files_of(nodes)
    return audit(remote.fetch(files.where(F.col("kind").isin(*kinds)), **options), kinds)


def record(found: Audit, store: str, user: str | None = None) -> DataFrame:
    """Puts the statuses of files that could be tested into the status store; the others keep theirs."""
    from ..sources.writers import write_status

    who = F.lit(user).cast("string") if user else F.current_user()
    rows = found.results.where("success").select("path", "status", who.alias("updated_by"), F.current_timestamp().alias("updated_at"))
    return write_status(found.results.sparkSession, rows, store)


def audit_file(spark: SparkSession, path: str) -> Audit:
    return audit(sources.described(spark.read.format("binaryFile").load(path)))


def stored_status(files: DataFrame, store: DataFrame | None = None, sniff: bool = False) -> DataFrame:
    """path, name, kind, size, status as the files themselves or the store tell it. sniff: a file
    named like a Word document that holds none is of another kind, without a status."""
    read = sources.parse_files(files).select("path", "kind", "error", "custom_props", "pdf_meta")
    parsed = lineage.save(read, f"{lineage.work_dir(files.sparkSession, 'statuses')}/parsed")  # read more than once
    tables = {name: parsed.select("path", F.explode(name).alias("e")).select("path", "e.*") for name in ("custom_props", "pdf_meta")}
    known = store if store is not None else empty(files.sparkSession, "path string, status string")
    rows = files.select("path", "name", "kind", "size")
    if sniff:
        fake = parsed.where((F.col("kind") == WORD) & F.col("error").isNotNull()).select("path", F.lit(True).alias("fake"))
        rows = rows.join(fake, "path", "left").withColumn("kind", F.when(F.col("fake"), OTHER).otherwise(F.col("kind"))).drop("fake")
    return status.decode(rows, tables["custom_props"], tables["pdf_meta"], known)


def list_folder(spark: SparkSession, folder: str, store: DataFrame | None = None) -> DataFrame:
    """Files of one folder with their statuses and icons, and its sub-folders."""
    inside = sources.described(spark.read.format("binaryFile").load(folder))
    files = report.with_icons(stored_status(inside, store, sniff=True)).withColumn("entry_type", F.lit("file"))
    folders = sources.list_entries(spark, folder).where("entry_type = 'folder' or warning is not null")
    return files.unionByName(folders.select("path", "name", "entry_type", "warning"), allowMissingColumns=True)


def folder_report(spark: SparkSession, folder: str, store: DataFrame | None = None, include_slides: bool = False) -> DataFrame:
    """One row of counts over Word and PDF files below a folder, presentations too if asked."""
    kinds = (WORD, PDF, SLIDES) if include_slides else (WORD, PDF)
    files = sources.walk_files(spark, folder)
    files = files.where(S.kind_of(F.col("path"), case_sensitive=True).isin(*kinds))
    return report.folder_report(stored_status(files, store))


def set_status(spark: SparkSession, store: str, path: str, value: str, user: str | None = None) -> DataFrame:
    """A manual change, of any kind of file, in the status store; by the session's user if none is given."""
    from ..sources.writers import write_status

    if value not in (ACCESSIBLE, NOT_ACCESSIBLE, MANUAL, UNTESTED):
        raise ValueError(f"no status: {value}")
    row = spark.createDataFrame([(path, value, user)], "path string, status string, updated_by string")
    row = row.withColumns({"updated_by": F.coalesce("updated_by", F.current_user()), "updated_at": F.current_timestamp()})
    return write_status(spark, row, store)
