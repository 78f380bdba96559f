"""The versioned feed seen as a log: what was applied, what came late, and recomputation of what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.paths import plain_path
from factloom.operators.feed import decisive_changes


def with_highest_before(feed: DataFrame, slice_size: int = 100_000) -> DataFrame:
    """The feed's usable rows, each with the highest version of its file among earlier change_ids.

    A running maximum in two steps: inside slices of change_id, and over the slices' maxima. So one
    file's rows need not meet in one task. A null project_id is a project of its own; rows without version,
    path or change_id are not in the log.
    """
    keys = ["project_id", "path"]
    rows = (
        feed.select("change_id", "project_id", plain_path(F.col("path")).alias("path"), "version", "deleted", "batch")
        .where("version is not null and path is not null and change_id is not null")
        .dropDuplicates(["change_id"])
        .withColumn("slice", F.floor(F.col("change_id") / slice_size))
    )
    inside = Window.partitionBy(*keys, "slice").orderBy("change_id").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*keys, "slice").agg(F.max("version").alias("top"))
    over = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    earlier = tops.select(*keys, "slice", F.max("top").over(over).alias("top_before"))
    earlier = earlier.select(F.col("project_id").alias("e_project"), F.col("path").alias("e_path"), F.col("slice").alias("e_slice"), "top_before")
    same = F.col("project_id").eqNullSafe(F.col("e_project")) & (F.col("path") == F.col("e_path")) & (F.col("slice") == F.col("e_slice"))
    return rows.withColumn("in_slice", F.max("version").over(inside)).join(earlier, same).drop("e_project", "e_path", "e_slice").withColumn("highest_before", F.greatest("in_slice", "top_before")).drop("in_slice", "top_before", "slice")


def generation_log(feed: DataFrame) -> DataFrame:
    """Per project and batch: changes, those applied, and the generation after it (batches with an applied change count)."""
    seen = with_highest_before(feed)
    applied = F.coalesce(F.col("version") > F.col("highest_before"), F.lit(True))
    log = seen.groupBy("project_id", "batch").agg(F.count(F.lit(1)).alias("n_changes"), F.count_if(applied).alias("n_applied"))
    order = Window.partitionBy("project_id").orderBy(F.col("batch").asc_nulls_first())
    return log.withColumn("generation", F.sum(F.when(F.col("n_applied") > 0, 1).otherwise(0)).over(order))


def stale_changes(feed: DataFrame) -> DataFrame:
    """Changes that were not applied since their version had been reached before."""
    return with_highest_before(feed).where("version <= highest_before").select("change_id", "project_id", "path", "version", "highest_before")


def recompute_changed(feed: DataFrame, since: int) -> DataFrame:
    """Current versions after the whole feed, computing anew only the files with a change after ``since``.

    The result equals a full computation. Changes without a change_id arrive last, so they are after ``since``; a
    null project_id is a project of its own.
    """
    arrived = F.coalesce(F.col("change_id") <= since, F.lit(False))
    old = decisive_changes(feed.where(arrived))
    touched = feed.where(~arrived).select(F.col("project_id").alias("t_project"), plain_path(F.col("path")).alias("t_path")).where("t_path is not null").distinct()
    same = F.col("project_id").eqNullSafe(F.col("t_project")) & (F.col("path") == F.col("t_path"))
    again = decisive_changes(feed.withColumn("path", plain_path(F.col("path"))).join(touched, same, "left_semi"))
    return old.join(touched, same, "left_anti").unionByName(again)
