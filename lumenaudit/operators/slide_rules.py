"""Rules on the element tables of presentations. Each takes tables and returns issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import text as X
from .issues import issue

LEAST_CONTRAST = 4.5


def place(*columns: str):
    return F.concat_ws(" ", *[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])


def picture_alt(shapes: DataFrame) -> DataFrame:
    """Pictures at the top level of a slide with a blank description."""
    return issue(shapes.where((F.col("kind") == "pic") & X.is_blank(F.col("descr"))), "pptx-image-alt", place("slide", "ord"))


def slides_without_title(slides: DataFrame, shapes: DataFrame) -> DataFrame:
    """Slides without a placeholder of exactly the type ``title``."""
    titles = shapes.where("kind = 'sp' and ph_type = 'title'").groupBy("path", "slide").agg(F.count("*").alias("n_titles"))
    return slides.select("path", "slide").join(titles, ["path", "slide"], "left_anti")


def slide_title(slides: DataFrame, shapes: DataFrame) -> DataFrame:
    return issue(slides_without_title(slides, shapes), "pptx-slide-title", place("slide"))


def low_contrast(runs: DataFrame, least: float = LEAST_CONTRAST) -> DataFrame:
    """The first run of the first paragraph of each shape, against a white ground."""
    first = runs.where("para_ord = 1 and run_ord = 1").withColumn("ratio", S.contrast(F.col("color")))
    return first.where(F.col("ratio") < least)


def text_contrast(runs: DataFrame, least: float = LEAST_CONTRAST) -> DataFrame:
    return issue(low_contrast(runs, least), "pptx-contrast", place("slide", "shape_ord"), ratio=F.format_string("%.2f", F.col("ratio")))


def table_header(shapes: DataFrame) -> DataFrame:
    return issue(shapes.where(F.col("is_table") & (F.coalesce("first_row", F.lit("")) != "1")), "pptx-table-header", place("slide", "ord"))


def link_targets(runs: DataFrame, rels: DataFrame) -> DataFrame:
    """runs with ``target``: the hyperlink of its slide with the run's id; of equal ids the last counts."""
    links = rels.where(F.col("rel_type").contains("hyperlink")).groupBy("path", "slide", F.col("rel_id").alias("link_id")).agg(F.max_by("target", "rel_ord").alias("target"))
    return runs.join(links, ["path", "slide", "link_id"], "left")


def raw_links(runs: DataFrame, rels: DataFrame) -> DataFrame:
    found = link_targets(runs.where(F.col("link_id").isNotNull()), rels)
    return issue(found.where(X.raw_url_link(F.col("text"), F.col("target"))), "pptx-raw-link", place("slide", "shape_ord", "para_ord", "run_ord"), text=X.trimmed(F.col("text")))


def slides_without_content(slides: DataFrame, shapes: DataFrame) -> DataFrame:
    """Neither shape nor picture; a slide with a table alone counts as empty."""
    return slides.select("path", "slide").join(shapes.where("kind in ('sp', 'pic')"), ["path", "slide"], "left_anti")


def empty_slides(slides: DataFrame, shapes: DataFrame) -> DataFrame:
    return issue(slides_without_content(slides, shapes), "pptx-empty-slide", place("slide"))


def audit(t: dict[str, DataFrame]) -> list[DataFrame]:
    return [
        picture_alt(t["shapes"]),
        slide_title(t["slides"], t["shapes"]),
        text_contrast(t["runs"].where("slide > 0")),
        table_header(t["shapes"]),
        raw_links(t["runs"].where("slide > 0"), t["rels"]),
        empty_slides(t["slides"], t["shapes"]),
    ]
