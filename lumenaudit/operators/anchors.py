"""Where in a document an issue's text is: the anchor of a comment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def find_anchors(targets: DataFrame, runs: DataFrame) -> DataFrame:
    """For each target the first run of the best tier: 1 the run's text is equal, 2 contains it, 3 the
    running text of its paragraph contains it from this run on. Null tier: not found.

    targets: path, target_id, target. runs: path, para_ord, run_ord, text. The join is on path, so
    only runs of the same document meet. An empty target anchors to the first run.
    """
    text = F.coalesce("text", F.lit(""))
    pieces = F.expr("collect_list(coalesce(text, '')) over (partition by path, para_ord order by run_ord rows between unbounded preceding and current row)")
    running = runs.select("path", "para_ord", "run_ord", text.alias("text"), F.array_join(pieces, "").alias("running"))
    tier = F.when(F.col("text") == F.col("target"), 1).when(F.col("text").contains(F.col("target")), 2).when(F.col("running").contains(F.col("target")), 3)
    found = targets.join(running, "path").withColumn("tier", tier).where("tier is not null")
    best = found.groupBy("path", "target_id").agg(F.min(F.struct("tier", "para_ord", "run_ord")).alias("a"))
    return targets.join(best, ["path", "target_id"], "left").select("path", "target_id", "target", "a.tier", "a.para_ord", "a.run_ord")


def next_comment_ids(paths: DataFrame, comments: DataFrame, id_col: str = "id") -> DataFrame:
    """path, next_id: one more than the largest id, 1 where there is none."""
    largest = comments.groupBy("path").agg(F.max(id_col).alias("largest"))
    return paths.select("path").join(largest, "path", "left").select("path", (F.coalesce("largest", F.lit(0)) + 1).cast("long").alias("next_id"))
