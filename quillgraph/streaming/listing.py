"""A folder as a stream of file events, deletions included.

Each poll lists the folder, stores the listing as a version, and gives the difference to the version before: ``add``, ``change``
and ``unlink``. Listings are tables, so folders of any size are compared by one join; a version is committed by its manifest,
and a poll that is repeated after a failure reads the listing it had already stored and gives the same events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.markdown import ignored
from ..tables import commit, manifest, versions

LISTING = "path string, ms long, size long"


def listing(spark: SparkSession, root: str, exclude: list[str] = ()) -> DataFrame:
    """``path, ms, size`` of the markdown files below ``root``; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.element_at(F.split("path", F.lit("\\Q" + base + "/\\E"), 2), 2)
    rows = files.select(path.alias("path"), F.unix_millis("modificationTime").alias("ms"), F.col("length").alias("size"))
    return rows.filter(~ignored(F.col("path"), exclude))


def difference(before: DataFrame, after: DataFrame, now_ms: int) -> DataFrame:
    """``path, event, ms`` between two listings; a deletion happened at ``now_ms`` at the latest."""
    old = before.select("path", F.col("ms").alias("_ms"), F.col("size").alias("_size"))
    rows = after.select("path", "ms", "size").join(old, "path", "full")
    event = F.when(F.col("_ms").isNull(), "add").when(F.col("ms").isNull(), "unlink").when((F.col("ms") != F.col("_ms")) | (F.col("size") != F.col("_size")), "change")
    return rows.select("path", event.alias("event"), F.coalesce("ms", F.lit(now_ms)).cast("long").alias("ms")).filter("event is not null")


def poll(spark: SparkSession, root: str, state: str, version: int, now_ms: int, exclude: list[str] = ()) -> DataFrame:
    """The events of one version. The first time it lists the folder; later it reads what it stored."""

    def stored(v: int) -> DataFrame:
        known = [x for x in versions(spark, state) if x <= v]
        return spark.read.schema(LISTING).parquet(f"{state}/{manifest(spark, state, known[-1])['folder']}") if known else spark.createDataFrame([], LISTING)

    if version not in versions(spark, state):
        listing(spark, root, exclude).write.mode("overwrite").parquet(f"{state}/listing-{version}")
        commit(spark, state, version, {"folder": f"listing-{version}", "ms": now_ms})
    return difference(stored(version - 1), stored(version), manifest(spark, state, version)["ms"])


def watch(spark: SparkSession, root: str, state: str, handle: Callable[[DataFrame, int], None], every: str = "2 seconds", exclude: list[str] = ()):
    """A streaming query that polls at each trigger and passes the events and the batch's number to ``handle``.

    The query's checkpoint lies in ``state``: after a restart it goes on with the next number, or repeats the last one with the
    same events; ``handle`` should write by that number.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def one(batch: DataFrame, number: int) -> None:
        now = spark.range(1).select(F.unix_millis(F.current_timestamp()).alias("ms")).first().ms
        handle(poll(spark, root, state, number, now, exclude), number)

    return ticks.writeStream.foreachBatch(one).option("checkpointLocation", f"{state}/checkpoint").trigger(processingTime=every).start()
