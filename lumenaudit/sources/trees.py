"""Trees of folders held as rows: walks from the roots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import save, work_dir

# Node types of the remote store.
FOLDER, DOCUMENT = 0, 144


def walk(nodes: DataFrame, root: int | None = None, most: int = 200) -> DataFrame:
    """All columns of ``nodes`` and ``depth``, for nodes below ``root`` (or below rows without a parent).

    Level by level: each level is one join of the nodes with the level above, until a level is
    empty. A level is written and read back, so that none is computed again. Every node has one
    parent, so a level has no node twice; ``most`` guards against cycles.
    """
    folder = work_dir(nodes.sparkSession, "walk")

    top = nodes.where(F.col("parent_id").isNull() if root is None else F.col("parent_id") == root)
    levels, depth = [save(top.withColumn("depth", F.lit(1)), f"{folder}/1")], 1
    while not levels[-1].isEmpty():
        if depth == most:
            raise ValueError(f"a tree deeper than {most} levels, or a cycle")
        above = levels[-1].select(F.col("id").alias("parent_id"))
        depth += 1
        below = nodes.join(above, "parent_id").select(*nodes.columns)
        levels.append(save(below.withColumn("depth", F.lit(depth)), f"{folder}/{depth}"))
    return reduce(DataFrame.unionByName, levels)
