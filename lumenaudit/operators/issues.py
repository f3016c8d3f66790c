"""Issue rows and what is made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import REPAIRS, RULES

IMPACT = {r[0]: (r[1], r[3]) for r in RULES}


def issue(rows: DataFrame, rule_id: str, location: Column, **detail: Column) -> DataFrame:
    """Rows of ``rows`` (which has ``path``) as issues of one rule."""
    criterion, impact = IMPACT[rule_id]
    pairs = [x for k, v in detail.items() for x in (F.lit(k), v.cast("string"))]
    details = F.create_map(*pairs) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return rows.select("path", F.lit(rule_id).alias("rule_id"), F.lit(criterion).alias("criterion"), F.lit(impact).alias("impact"), location.cast("string").alias("location"), details.alias("detail"))


def union_issues(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def without_ignored(issues: DataFrame, codes: tuple[str, ...], column: str = "rule_id") -> DataFrame:
    """Drops issues with an ignored code; rows without a code stay."""
    return issues.where(~F.coalesce(F.col(column).isin(*codes), F.lit(False)))


def counts_by_path(paths: DataFrame, issues: DataFrame) -> DataFrame:
    """path, n_issues, passed for every path, those without issues too."""
    n = issues.groupBy("path").agg(F.count("*").alias("n"))
    return paths.select("path").join(n, "path", "left").select("path", F.coalesce("n", F.lit(0)).cast("long").alias("n_issues"), F.col("n").isNull().alias("passed"))


def repairs(issues: DataFrame, criterion: str = "criterion") -> DataFrame:
    """Adds ``priority``, ``place`` and ``steps`` of the first repair whose criterion occurs in the text."""
    found = F.lit(None).cast("struct<priority:string,place:string,steps:array<string>>")
    for number, priority, place, steps in reversed(REPAIRS):
        entry = F.struct(F.lit(priority).alias("priority"), F.lit(place).alias("place"), F.array(*map(F.lit, steps)).alias("steps"))
        found = F.when(F.col(criterion).contains(number), entry).otherwise(found)
    return issues.withColumn("repair", found).select(*issues.columns, "repair.priority", "repair.place", "repair.steps")


def issue_message(n: Column, noun: str, pages: Column) -> Column:
    """``2 images on pages 1, 3``: the count, the noun with its plural, the page list."""
    many = F.when(n == 1, noun).otherwise(noun + "s")
    return F.concat_ws(" ", n.cast("string"), many, F.lit("on pages"), F.array_join(pages.cast("array<string>"), ", "))
