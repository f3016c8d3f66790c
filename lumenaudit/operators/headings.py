"""Heading hierarchy as a fold over the headings of a document.

An accepted heading is always one level below its parent, so the path to the active heading has
levels 1, 2, .., k and the state is k alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .issues import issue

# Error codes of headings.
INVALID_LEVEL, FIRST_NOT_ONE, SECOND_ONE, NO_PLACE = 1001, 1002, 1003, 1004
BEFORE, ROOTLESS = -1, 0


def verdict(at: Column, level: Column) -> tuple[Column, Column]:
    """Error code of a heading (0 is none) and the state after it."""
    one = level.eqNullSafe(F.lit(1))
    code = (
        F.when(level < 1, INVALID_LEVEL)
        .when(at == BEFORE, 0)
        .when(at == ROOTLESS, F.when(one, 0).otherwise(FIRST_NOT_ONE))
        .when(one, SECOND_ONE)
        .when(level <= at + 1, 0)
        .otherwise(NO_PLACE)
    )
    return code, F.when(code != 0, at).when((at == BEFORE) & ~one, ROOTLESS).otherwise(level)


def heading_errors(headings: Column) -> Column:
    """array<struct(pos, level, code)> of array<struct(pos, level)> in document order.

    A null level is a style without a number. Rules: a level below 1 never fits; the first heading
    is taken whatever its level, but one above 1 leaves the tree without a root until a level 1
    comes; a second level 1 is an error; any other level may go up or one step down.
    """

    def step(state: Column, h: Column) -> Column:
        code, after = verdict(state["at"], h["level"])
        entry = F.struct(h["pos"].alias("pos"), h["level"].alias("level"), code.alias("code"))
        return F.struct(after.alias("at"), F.when(code != 0, F.concat(state["found"], F.array(entry))).otherwise(state["found"]).alias("found"))

    start = F.struct(F.lit(BEFORE).alias("at"), F.array().cast("array<struct<pos:int,level:int,code:int>>").alias("found"))
    return F.aggregate(headings, start, step, lambda s: s["found"])


def count_errors(headings: Column) -> Column:
    """How many ``heading_errors`` there are."""

    def step(state: Column, h: Column) -> Column:
        code, after = verdict(state["at"], h["level"])
        return F.struct(after.alias("at"), (state["n"] + F.when(code != 0, 1).otherwise(0)).alias("n"))

    return F.aggregate(headings, F.struct(F.lit(BEFORE).alias("at"), F.lit(0).alias("n")), step, lambda s: s["n"])


def check_headings(headings: DataFrame) -> DataFrame:
    """path, pos, level, code for each error. headings: path, pos, level (whole numbers)."""
    of = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.struct("level").alias("h")))), lambda x: F.struct(x["pos"].cast("int").alias("pos"), x["h"]["level"].cast("int").alias("level")))
    folded = headings.groupBy("path").agg(of.alias("headings"))
    return folded.select("path", F.explode(heading_errors(F.col("headings"))).alias("e")).select("path", "e.*")


def level_of(style: Column) -> Column:
    """All digits of a style id as a number; null where there is none."""
    return F.regexp_replace(style, r"\D", "").try_cast("int")


def docx_headings(paragraphs: DataFrame) -> DataFrame:
    """path, pos, level, text: paragraphs whose style starts with ``heading`` and whose text is not blank."""
    from ..functions.text import trimmed

    text = trimmed(F.col("text"))
    kept = paragraphs.where(F.lower("style_id").startswith("heading") & (F.coalesce(text, F.lit("")) != ""))
    pos = F.expr("row_number() over (partition by path order by para_ord)")
    return kept.select("path", pos.alias("pos"), level_of(F.col("style_id")).alias("level"), text.alias("text"))


def outline(headings: DataFrame) -> DataFrame:
    """path, outline: the headings as indented lines."""
    line = F.concat(F.repeat(F.lit("  "), F.coalesce("level", F.lit(1)) - 1), F.col("text"))
    rows = headings.withColumn("line", line).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    return rows.select("path", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("outline"))


def headings_of(paragraphs: Column) -> Column:
    """array<struct(pos, level)> of a file's paragraphs: those of ``docx_headings``, without dealing rows by file again."""
    kept = F.filter(paragraphs, lambda p: F.lower(p["style_id"]).startswith("heading") & p["text"].rlike(r"(?U)\S"))
    return F.transform(kept, lambda p, i: F.struct((i + 1).alias("pos"), level_of(p["style_id"]).alias("level")))


def heading_issues(files: DataFrame) -> DataFrame:
    """files: path, paragraphs (an array in document order)."""
    found = files.select("path", F.explode(heading_errors(headings_of(F.col("paragraphs")))).alias("e")).select("path", "e.*")
    return issue(found, "word-heading", F.concat(F.lit("heading "), F.col("pos").cast("string")), code=F.col("code"), level=F.col("level"))
