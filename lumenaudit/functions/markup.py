"""Elements of HTML texts by patterns: links, titles, languages, headings, images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINK = r"""(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>"""
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
LANG = r"""(?is)<html[^>]*?\slang="([^"]*)\""""
HEADING = r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"
TAG = r"(?s)<[^>]*>"


def links(html: Column) -> Column:
    """array<struct(url, text)> in order; the text is without tags."""
    pattern = F.lit(LINK)
    urls, texts = F.regexp_extract_all(html, pattern, F.lit(1)), F.regexp_extract_all(html, pattern, F.lit(2))
    return F.transform(F.arrays_zip(urls.alias("u"), texts.alias("t")), lambda x: F.struct(x["u"].alias("url"), F.regexp_replace(x["t"], TAG, "").alias("text")))


def title(html: Column) -> Column:
    """Null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(html, TITLE, 1), F.lit(""))


def language(html: Column) -> Column:
    return F.when(html.rlike(LANG), F.regexp_extract(html, LANG, 1))


def headings(html: Column) -> Column:
    pattern = F.lit(HEADING)
    levels, texts = F.regexp_extract_all(html, pattern, F.lit(1)), F.regexp_extract_all(html, pattern, F.lit(2))
    return F.transform(F.arrays_zip(levels.alias("l"), texts.alias("t")), lambda x: F.struct(x["l"].cast("int").alias("level"), F.regexp_replace(x["t"], TAG, "").alias("text")))
