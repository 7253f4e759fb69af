"""Patches as they arrive: an extension. A patch comes whole and stands alone, so no state or watermark is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import detectors
from ..plans.held import held_within
from ..plans.review import Review, review, static_findings


def patch_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Each new file of a folder is a patch: patch_id (a hash of its path), diff."""
    return spark.readStream.format("text").option("wholetext", "true").load(folder).select(F.xxhash64(F.col("_metadata.file_path")).alias("patch_id"), F.col("value").alias("diff"))


def watch_reviews(patches: DataFrame, checkpoint: str, on_review: Callable[[Review, int], None], trigger: dict | None = None, **options) -> StreamingQuery:
    """Reviews every batch of patches and calls on_review with it and its number as soon as it is done, so findings and
    progress are seen while others are still to come. options: those of review(). A batch may be given again after a
    failure, with the same number. What a batch holds is deleted when on_review returns, so it must not keep tables."""

    def called(batch: DataFrame, n: int) -> None:
        with held_within():
            on_review(review(batch, **options), n)

    return patches.writeStream.foreachBatch(called).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def watch(patches: DataFrame, sink: str, checkpoint: str, rules: list[detectors.Rule] | None = None, **trigger) -> StreamingQuery:
    """Writes every batch's findings under sink, a folder for each batch, so a repeated batch replaces itself.

    Patches above the size guard are left out."""

    def write(batch: DataFrame, n: int) -> None:
        with held_within():
            static_findings(batch, rules).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={n}")

    return patches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
