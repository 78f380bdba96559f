"""What changed between full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.paths import plain_path
from factloom.session import materialize, scratch_path


#: Stands for a null project_id inside the joins, so that they are plain equalities on one partitioning.
NO_PROJECT = "\x00"


def plain_digest(digest: Column) -> Column:
    """The digest's bytes, whatever its letter case and prefix; text that is not hex stays as its bytes."""
    bare = F.regexp_replace(F.lower(F.trim(digest)), "^sha256:", "")
    return F.coalesce(F.when(F.length(bare) == 64, F.unhex(bare)), F.encode(bare, "UTF-8"))


def snapshot_rows(deliveries: DataFrame) -> DataFrame:
    """One row per project_id, generation and plain path: the one delivered last.

    Rows with a generation that is null or below 1, or without a path, belong to no snapshot. A
    null delivered_at is the earliest; among rows delivered at once the greatest digest counts.
    """
    return (
        deliveries.select("project_id", "generation", plain_path(F.col("path")).alias("path"), plain_digest(F.col("sha256")).alias("digest"), "delivered_at")
        .where("generation >= 1 and path is not null")
        .groupBy("project_id", "generation", "path")
        .agg(F.max(F.struct("delivered_at", "digest")).alias("last"))
        .select("project_id", "generation", "path", F.col("last.digest").alias("digest"))
    )


def snapshot_changes(deliveries: DataFrame) -> DataFrame:
    """Paths added, removed and changed from each delivered generation of a project to the next.

    Each snapshot meets its predecessor, moved onto its generation, in one aggregation with
    signed multiplicities: identical rows cancel out, which is EXCEPT ALL both ways in one pass. What
    is left on either side is full-joined by key. All three steps use one partitioning.
    A null digest is present but never part of a change. The first snapshot has no changes; a null
    project_id is a project of its own. Empty input gives no rows.
    """
    deliveries = deliveries.withColumn("project_id", F.coalesce("project_id", F.lit(NO_PROJECT)))
    rows = snapshot_rows(deliveries)
    keys = ["project_id", "generation", "path"]
    delivered = deliveries.where((F.col("generation") >= 1) & plain_path(F.col("path")).isNotNull()).select("project_id", "generation").distinct()
    order = Window.partitionBy("project_id").orderBy("generation")
    steps = delivered.withColumn("next_generation", F.lead("generation").over(order)).withColumn("is_first", F.lag("generation").over(order).isNull())
    steps = steps.select(F.col("project_id").alias("s_project"), F.col("generation").alias("s_generation"), "next_generation", "is_first")
    steps = materialize(steps, scratch_path(deliveries.sparkSession, "steps"))
    placed = rows.join(steps, (F.col("project_id") == F.col("s_project")) & (F.col("generation") == F.col("s_generation")))
    sides = placed.select(
        "project_id",
        "path",
        "digest",
        F.explode(
            F.array(
                F.struct(F.when(~F.col("is_first"), F.col("generation")).alias("generation"), F.lit(1).alias("sign")),
                F.struct(F.col("next_generation").alias("generation"), F.lit(-1).alias("sign")),
            )
        ).alias("at"),
    ).select("project_id", "at.generation", "path", "digest", "at.sign")
    residue = (
        sides.where("generation is not null")
        .repartition(*keys)
        .groupBy(*keys, "digest")
        .agg(F.sum("sign").alias("net"))
        .where("net <> 0")
    )
    new = residue.where("net > 0").select(*keys, F.col("digest").alias("new_digest"), F.lit(True).alias("is_new"))
    old = residue.where("net < 0").select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col("digest").alias("old_digest"), F.lit(True).alias("is_old"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"o_{k}"))
    kind = (
        F.when(F.col("is_old").isNull(), "added")
        .when(F.col("is_new").isNull(), "removed")
        .when(F.col("new_digest").isNotNull() & F.col("old_digest").isNotNull(), "changed")
    )
    return (
        new.join(old, same, "full_outer")
        .select(*[F.when(F.col("is_new"), F.col(k)).otherwise(F.col(f"o_{k}")).alias(k) for k in keys], kind.alias("change_kind"))
        .where("change_kind is not null")
        .withColumn("project_id", F.nullif("project_id", F.lit(NO_PROJECT)))
    )


def change_counts(changes: DataFrame) -> DataFrame:
    """Added, removed and changed paths per project and generation."""
    return changes.groupBy("project_id", "generation").agg(
        *[F.count_if(F.col("change_kind") == k).alias(f"n_{k}") for k in ("added", "removed", "changed")]
    )
