"""Rules on the element tables of Word documents.

A published subset of WCAG techniques that can be decided from the document alone: picture
descriptions, link texts, table headers, heading order. It is not a full WCAG 2 AAA test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .headings import count_errors, heading_issues, headings_of
from .issues import issue, without_ignored

# Codes of the language technique that never count.
IGNORED = (
    "WCAG2AAA.Principle3.Guideline3_1.3_1_1.H57.3.Lang",
    "WCAG2AAA.Principle3.Guideline3_1.3_1_1.H57.3.XmlLang",
)


def picture_alt(word_images: DataFrame) -> DataFrame:
    return issue(word_images.where(X.is_blank(F.col("descr"))), "word-image-alt", F.concat(F.lit("picture "), F.col("img_ord").cast("string")))


def link_text(word_links: DataFrame) -> DataFrame:
    bad = X.is_blank(F.col("text")) | X.raw_url_link(F.col("text"), F.col("target"))
    return issue(word_links.where(bad), "word-link-text", F.concat(F.lit("link "), F.col("link_ord").cast("string")), text=F.col("text"))


def table_header(word_tables: DataFrame) -> DataFrame:
    return issue(word_tables.where("not header"), "word-table-header", F.concat(F.lit("table "), F.col("table_ord").cast("string")))


def audit(t: dict[str, DataFrame], ignored: tuple[str, ...] = IGNORED) -> list[DataFrame]:
    """Issues that decide the status; heading errors come apart, see ``heading_issues``."""
    return [without_ignored(x, ignored) for x in (picture_alt(t["word_images"]), link_text(t["word_links"]), table_header(t["word_tables"]))]


__all__ = ["IGNORED", "audit", "count_errors", "heading_issues", "headings_of", "link_text", "picture_alt", "table_header"]
