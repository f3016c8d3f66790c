"""Rules on the element tables of PDFs. Each takes tables and returns issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .issues import issue

MARGIN, EXAMPLES = 5.0, 3


def title_missing(pdf_meta: DataFrame) -> DataFrame:
    """An empty title counts as missing."""
    return issue(pdf_meta.where(F.coalesce("title", F.lit("")) == ""), "pdf-title", F.lit("document"))


def language_missing(pdf_meta: DataFrame) -> DataFrame:
    """An empty language counts as present."""
    return issue(pdf_meta.where(F.col("language").isNull()), "pdf-language", F.lit("document"))


def language_of_parts(text_items: DataFrame, length: int = 10) -> DataFrame:
    """Long text items without a language tag; there are no tags on items, so each counts."""
    n = text_items.where(X.is_long_enough(F.col("text"), length)).groupBy("path").agg(F.count("*").alias("n"))
    return issue(n, "pdf-language-of-parts", F.lit("text"), n=F.col("n"))


def near_rect(x: Column, y: Column, rect: Column, margin: float = MARGIN) -> Column:
    return x.between(rect[0] - margin, rect[2] + margin) & y.between(rect[1] - margin, rect[3] + margin)


def link_texts(annotations: DataFrame, text_items: DataFrame, margin: float = MARGIN) -> DataFrame:
    """path, page, ann_ord, url, link_text: text items in or near each link's box, in order.

    A join on path and page with the box as a condition; a link without text shows its address.
    """
    links = annotations.where((F.col("subtype") == "Link") & (F.coalesce("url", F.lit("")) != "")).select("path", "page", "ann_ord", "url", "rect")
    items = text_items.where(~X.is_blank(F.col("text"))).select(F.col("path").alias("p"), F.col("page").alias("g"), "item_ord", "text", "x", "y")
    near = (F.col("path") == F.col("p")) & (F.col("page") == F.col("g")) & near_rect(F.col("x"), F.col("y"), F.col("rect"), margin)
    joined = links.join(items, near, "left").groupBy("path", "page", "ann_ord", "url").agg(X.ordered_join(["item_ord"], "text", " ").alias("found"))
    return joined.select("path", "page", "ann_ord", "url", F.coalesce(F.nullif(X.trimmed(F.col("found")), F.lit("")), F.col("url")).alias("link_text"))


def unclear_links(links: DataFrame) -> DataFrame:
    """path, n, examples (the first three texts). links: path, page, ann_ord, link_text."""
    bad = links.where(X.unclear_link(F.col("link_text")))
    rows = F.sort_array(F.collect_list(F.struct("page", "ann_ord", "link_text")))
    first = F.transform(F.slice(rows, 1, EXAMPLES), lambda r: r["link_text"])
    return bad.groupBy("path").agg(F.count("*").alias("n"), F.array_join(first, "; ").alias("examples"))


def link_purpose(annotations: DataFrame, text_items: DataFrame) -> DataFrame:
    return issue(unclear_links(link_texts(annotations, text_items)), "pdf-link-purpose", F.lit("links"), n=F.col("n"), examples=F.col("examples"))


def figure_pages(struct_nodes: DataFrame) -> DataFrame:
    """Pages whose structure tree has a figure with an alternative, and the first one in pre-order."""
    figures = struct_nodes.where((F.col("role") == "Figure") & (F.coalesce("alt", F.lit("")) != ""))
    return figures.groupBy("path", "page").agg(F.min_by("alt", "preorder").alias("first_alt"))


def images_with_alt(images: DataFrame, struct_nodes: DataFrame) -> DataFrame:
    """images with has_alt, alt and matched_by: any described figure on the page counts for all its images."""
    pages = figure_pages(struct_nodes)
    return images.join(pages, ["path", "page"], "left").select(*images.columns, F.col("first_alt").isNotNull().alias("has_alt"), F.col("first_alt").alias("alt"), F.lit("page").alias("matched_by"))


def image_alt(images: DataFrame, struct_nodes: DataFrame) -> DataFrame:
    bad = images_with_alt(images, struct_nodes).where(~F.col("has_alt"))
    pages = F.transform(F.sort_array(F.collect_list(F.struct("page", "img_ord"))), lambda r: r["page"])
    n = bad.groupBy("path").agg(F.count("*").alias("n"), pages.alias("pages"))
    return issue(n, "pdf-image-alt", F.lit("images"), n=F.col("n"), pages=F.array_join(F.col("pages").cast("array<string>"), ", "))


def form_fields(annotations: DataFrame) -> DataFrame:
    return annotations.where((F.col("subtype") == "Widget") & (F.coalesce("field_type", F.lit("")) != ""))


def has_label() -> Column:
    return (F.coalesce("alt_text", F.lit("")) != "") | (F.coalesce("field_label", F.lit("")) != "")


def has_focus_style() -> Column:
    """A box and the lowest flag bit (read as invisible) not set."""
    return F.col("rect").isNotNull() & (F.coalesce("field_flags", F.lit(0)).bitwiseAND(F.lit(1)) == 0)


def count_fields(annotations: DataFrame, good: Column) -> DataFrame:
    """path, n_bad, n_total of form fields."""
    return form_fields(annotations).groupBy("path").agg(F.count_if(~good).alias("n_bad"), F.count("*").alias("n_total"))


def field_labels(annotations: DataFrame) -> DataFrame:
    n = count_fields(annotations, has_label()).where("n_bad > 0")
    return issue(n, "pdf-field-label", F.lit("form fields"), n=F.col("n_bad"), of=F.col("n_total"))


def focus_visible(annotations: DataFrame) -> DataFrame:
    n = count_fields(annotations, has_focus_style()).where("n_bad > 0")
    return issue(n, "pdf-focus-visible", F.lit("form fields"), n=F.col("n_bad"), of=F.col("n_total"))


def document_type(paths: DataFrame, annotations: DataFrame) -> DataFrame:
    """path, is_form, first_page (the first with fields) and n_fields on it, confidence."""
    per_page = form_fields(annotations).groupBy("path", "page").agg(F.count("*").alias("n"))
    first = per_page.groupBy("path").agg(F.min("page").alias("first_page"), F.min_by("n", "page").alias("n_fields"))
    return paths.select("path").join(first, "path", "left").select("path", F.col("first_page").isNotNull().alias("is_form"), "first_page", "n_fields", F.lit(100).alias("confidence"))


def tab_order(annotations: DataFrame) -> DataFrame:
    """Form fields with their place in the tab order: by index, missing ones last, else as they stand."""
    place = F.expr("row_number() over (partition by path order by tab_index asc nulls last, page, ann_ord)")
    return form_fields(annotations).withColumn("tab_place", place)


def audit(t: dict[str, DataFrame]) -> list[DataFrame]:
    """Rules of an automated test. Those on form fields find nothing in a file without fields."""
    return [
        title_missing(t["pdf_meta"]),
        language_missing(t["pdf_meta"]),
        link_purpose(t["annotations"], t["text_items"]),
        image_alt(t["images"], t["struct_nodes"]),
        field_labels(t["annotations"]),
        focus_visible(t["annotations"]),
    ]
