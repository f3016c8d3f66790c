"""Status values, element tables and the rule dimension."""

from __future__ import annotations

from pyspark.sql import types as T

# The five statuses and the kinds of files that have them.
ACCESSIBLE = "Accessible"
NOT_ACCESSIBLE = "Not Accessible"
UNTESTED = "Untested"
NOT_APPLICABLE = "Not Applicable"
MANUAL = "Manual Testing Required"
STATUSES = (ACCESSIBLE, NOT_ACCESSIBLE, UNTESTED, NOT_APPLICABLE, MANUAL)
WORD, PDF, SLIDES, OTHER = "word", "pdf", "powerpoint", "other"
KINDS = (WORD, PDF, SLIDES)  # also the order in which a batch takes them

#: Element tables; each also has ``path`` first.
ELEMENTS = {
    "parts": "part_ord int, part_name string",
    "paragraphs": "para_ord int, style_id string, text string",
    "runs": "slide int, shape_ord int, para_ord int, run_ord int, text string, link_id string, color string",
    "rels": "slide int, rel_ord int, rel_id string, rel_type string, target string",
    "slides": "slide int, file_number int, part_name string",
    "shapes": "slide int, kind string, ord int, ph_type string, descr string, is_table boolean, first_row string",
    "comments": "id int, author string, text string",
    "custom_props": "ord int, name string, value string",
    "word_links": "link_ord int, text string, target string",
    "word_images": "img_ord int, descr string",
    "word_tables": "table_ord int, header boolean",
    "pdf_meta": "title string, language string, keywords string, author string, encrypted boolean, n_pages int, xmp string",
    "text_items": "page int, item_ord int, text string, x double, y double",
    "annotations": "page int, ann_ord int, subtype string, url string, field_type string, field_name string, alt_text string, field_label string, field_flags int, tab_index int, rect array<double>",
    "images": "page int, img_ord int, image_id string",
    "struct_nodes": "page int, node_id int, parent_id int, preorder int, role string, alt string",
}
PARSED = "path string, kind string, error string, extract_error string, " + ", ".join(f"{name} array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in ddl.split(', '))}>>" for name, ddl in ELEMENTS.items())
ISSUE = "path string, rule_id string, criterion string, impact string, location string, detail map<string,string>"


def empty(spark, ddl: str):
    return spark.createDataFrame([], T._parse_datatype_string(ddl))


#: rule, criterion, kind, impact, what it is about, priority of repair (null where none is advised).
RULES = [
    ("pdf-title", "2.4.2", PDF, "Serious", "document title", "High"),
    ("pdf-language", "3.1.1", PDF, "Serious", "document language", "High"),
    ("pdf-language-of-parts", "3.1.2", PDF, "Moderate", "text without a language", "Low"),
    ("pdf-link-purpose", "2.4.4", PDF, "Serious", "link text", "High"),
    ("pdf-image-alt", "1.1.1", PDF, "Critical", "image alternative", "High"),
    ("pdf-field-label", "3.3.2", PDF, "Critical", "form field label", "Critical"),
    ("pdf-focus-visible", "2.4.7", PDF, "Serious", "form field focus", "High"),
    ("pptx-image-alt", "1.1.1", SLIDES, "Critical", "picture description", None),
    ("pptx-slide-title", "2.4.2", SLIDES, "Serious", "slide title", None),
    ("pptx-contrast", "1.4.3", SLIDES, "Serious", "text contrast", None),
    ("pptx-table-header", "1.3.1", SLIDES, "Serious", "table header row", None),
    ("pptx-raw-link", "2.4.4", SLIDES, "Moderate", "link text", None),
    ("pptx-empty-slide", "1.3.1", SLIDES, "Minor", "empty slide", None),
    ("word-image-alt", "1.1.1", WORD, "Critical", "picture description", None),
    ("word-link-text", "2.4.4", WORD, "Serious", "link text", None),
    ("word-table-header", "1.3.1", WORD, "Serious", "table header row", None),
    ("word-heading", "1.3.1", WORD, "Moderate", "heading hierarchy", None),
    ("parse-error", "n/a", OTHER, "Critical", "file could not be read", None),
]
#: Criteria in the order in which a repair is looked up, with its priority and place.
REPAIRS = [
    ("3.3.2", "Critical", "form fields", ("Name every field in its tooltip.", "Tie visible captions to fields.")),
    ("2.4.7", "High", "form fields", ("Give fields a visible border.", "Clear the hidden flag.")),
    ("1.1.1", "High", "images", ("Tag images as figures.", "Describe each figure, or mark it as decoration.")),
    ("2.4.2", "High", "document properties", ("Set a title in the document properties.",)),
    ("2.4.4", "High", "links", ("Replace bare addresses by a text that tells where the link leads.",)),
    ("3.1.1", "High", "document properties", ("Set the document's language.",)),
    ("3.1.2", "Low", "paragraphs", ("Mark passages in another language.",)),
]
