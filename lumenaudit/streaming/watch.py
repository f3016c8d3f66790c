"""An extension: audits files as they arrive, with the batch rules on each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.api import audit
from ..sources.files import described

BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, glob: str = "*", trigger: dict | None = None) -> StreamingQuery:
    """Appends results and issues of new files below ``out``; a batch that runs again replaces its own."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)

    def test(batch: DataFrame, number: int) -> None:
        found = audit(described(batch))
        found.results.write.mode("overwrite").parquet(f"{out}/results/batch={number}")
        found.issues.write.mode("overwrite").parquet(f"{out}/issues/batch={number}")
        found.free()

    return files.writeStream.foreachBatch(test).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
