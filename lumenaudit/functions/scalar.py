"""Paths, sizes, colours and statuses as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ACCESSIBLE, MANUAL, NOT_ACCESSIBLE, OTHER, PDF, SLIDES, UNTESTED, WORD

EXTENSIONS = ((".docx", WORD), (".pdf", PDF), (".pptx", SLIDES))


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def join_path(folder: Column, name: Column) -> Column:
    """``./`` and an empty folder leave the name alone."""
    return F.when(folder.isin("", "./", "."), name).otherwise(F.concat_ws("/", F.regexp_replace(folder, "/+$", ""), name))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def base_name_any(path: Column) -> Column:
    """After the last slash of either kind."""
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1)


def kind_of(path: Column, case_sensitive: bool = False) -> Column:
    ext = extension(path) if case_sensitive else F.lower(extension(path))
    out = F.lit(OTHER)
    for suffix, kind in EXTENSIONS:
        out = F.when(ext == suffix, kind).otherwise(out)
    return out


def node_id(url: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(url, r"objId=(\d+)", 1), F.lit("")), F.lit("9" * 18)).cast("long")


def attachment_name(header: Column) -> Column:
    """The file name in a content-disposition header."""
    return F.nullif(F.regexp_extract(header, r'filename="?([^";]+)"?', 1), F.lit(""))


def format_size(size: Column) -> Column:
    return F.when(size >= 1 << 20, F.format_string("%.2f MB", size / F.lit(float(1 << 20)))).otherwise(F.format_string("%d bytes", size.cast("long")))


def percentage(part: Column, whole: Column) -> Column:
    """One decimal, halves up; 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.floor(F.lit(1000.0) * part / whole + 0.5) / 10)


def icon(status: Column) -> Column:
    known = {ACCESSIBLE: "pass", NOT_ACCESSIBLE: "fail", UNTESTED: "untested", MANUAL: "manual"}
    out = F.lit("none")
    for value, name in known.items():
        out = F.when(status == value, name).otherwise(out)
    return out


def icon_text(name: Column) -> Column:
    return F.when(name == "pass", "Accessible").when(name == "fail", "Not accessible").otherwise("Not Tested")


def updated_icon(status: Column) -> Column:
    """After a status was changed: whatever is neither Accessible nor for manual testing has failed."""
    return F.when(status == ACCESSIBLE, "pass").when(status == MANUAL, "manual").otherwise("fail")


def has_metadata(*values: Column) -> Column:
    """Whether any of a document's properties is there and not empty."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values]).isNotNull()


def toggled(status: Column) -> Column:
    """What a manual change makes of a status: only Accessible goes down."""
    return F.when(status == ACCESSIBLE, NOT_ACCESSIBLE).otherwise(ACCESSIBLE)


def keyword_status(keywords: Column) -> Column:
    """Status in the JSON that a PDF's keywords hold; anything else is Untested."""
    told = F.get_json_object(keywords, "$.isAccessible")
    return F.when(told.isin(ACCESSIBLE, NOT_ACCESSIBLE, MANUAL), told).otherwise(UNTESTED)


def property_status(value: Column) -> Column:
    """Status of an office file from its property: only ``1`` means Accessible; null is Untested."""
    return F.when(value.isNull(), UNTESTED).when(value == "1", ACCESSIBLE).otherwise(NOT_ACCESSIBLE)


def tested_status(kind: Column, n_issues: Column) -> Column:
    """After automated tests: a PDF without issues still needs a manual test."""
    clean = F.when(kind == PDF, MANUAL).otherwise(ACCESSIBLE)
    return F.when(n_issues == 0, clean).otherwise(NOT_ACCESSIBLE)


def channel(colour: Column, at: int) -> Column:
    value = F.conv(F.substring(colour, at, 2), 16, 10).cast("double") / 255
    return F.when(value <= 0.03928, value / 12.92).otherwise(F.pow((value + 0.055) / 1.055, F.lit(2.4)))


def luminance(colour: Column) -> Column:
    return 0.2126 * channel(colour, 1) + 0.7152 * channel(colour, 3) + 0.0722 * channel(colour, 5)


def contrast(colour: Column, ground: str = "FFFFFF") -> Column:
    """WCAG contrast ratio of two RRGGBB colours; a missing colour is black."""
    a, b = luminance(F.coalesce(colour, F.lit("000000"))), luminance(F.lit(ground))
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def default_language(xmp: Column, language: Column) -> Column:
    """dc:language of the XMP, else the document's language, in lower case, else ``en``."""
    told = F.regexp_extract(F.coalesce(xmp, F.lit("")), r"dc:language>([^<]+)<", 1)
    return F.coalesce(F.nullif(F.lower(told), F.lit("")), F.nullif(F.lower(language), F.lit("")), F.lit("en"))


def rect_box(rect: Column) -> Column:
    """x, y, width and height of [x1, y1, x2, y2]; zeros where it is missing."""
    side = lambda i: F.coalesce(F.get(rect, F.lit(i)), F.lit(0.0))
    return F.struct(side(0).alias("x"), side(1).alias("y"), (side(2) - side(0)).alias("width"), (side(3) - side(1)).alias("height"))
