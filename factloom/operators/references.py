"""References to records that do not exist at the moment of reference.

Method: the distinct non-null foreign keys, each with the first and last moment of
use, are left-anti-joined with the parent keys that were alive over that whole
stretch. What is left is a small set of suspect keys, kept as a table; it is joined back to its rows,
and each of these meets the latest recording before it in one merged ordering by time.

A null project_id is a project of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import materialize, scratch_path

FAR_FUTURE = "9999-12-31 00:00:00"

#: Stands for a null project_id inside the joins, so that they are plain equalities on one partitioning.
NO_PROJECT = "\x00"

#: Days of one slice of the merged ordering: an id used or recorded very often is split by time.
SLICE_DAYS = 1


def latest_recording(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """``rows`` (project_id, ref, recorded_at and more) with __found_at and __gone_at of the recording of their id that holds then.

    ``parents`` has project_id, id, row_id, recorded_at, deleted_at. Among the recordings not after the row the latest counts, of
    several at once the one with the greatest row_id; nulls if there is none. Rows and recordings of an id are ordered together
    inside time slices, and each slice gets the last recording of those before it, so the work is linear and
    no task holds all rows of one id.
    """
    slice_ = F.expr(f"timestampdiff(DAY, timestamp_ntz'1970-01-01', recorded_at) div {SLICE_DAYS}")
    made = F.struct(F.col("recorded_at").alias("at"), F.col("__deleted").alias("gone"))
    recordings = (
        parents.where("recorded_at is not null")
        .groupBy("project_id", F.col("id").alias("ref"), "recorded_at")
        .agg(F.max_by("deleted_at", "row_id").alias("__deleted"))
        .select("project_id", "ref", "recorded_at", made.alias("__made"), F.lit(None).alias("__row"))
    )
    asked = rows.select("project_id", "ref", "recorded_at", F.lit(None).alias("__made"), F.struct(*[F.col(c) for c in rows.columns]).alias("__row"))
    both = recordings.unionByName(asked).withColumn("__slice", slice_)
    keys = ["project_id", "ref"]
    inside = Window.partitionBy(*keys, "__slice").orderBy("recorded_at", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lasts = both.groupBy(*keys, "__slice").agg(F.max("__made").alias("__last"))
    over = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    before = lasts.select(F.col("project_id").alias("__b_project"), F.col("ref").alias("__b_ref"), F.col("__slice").alias("__b_slice"), F.last("__last", ignorenulls=True).over(over).alias("__before"))
    met = both.withColumn("__met", F.last("__made", ignorenulls=True).over(inside)).where("__row is not null")
    same = (F.col("project_id") == F.col("__b_project")) & (F.col("ref") == F.col("__b_ref")) & F.col("__slice").eqNullSafe(F.col("__b_slice"))
    found = met.join(before, same, "left").withColumn("__found", F.coalesce("__met", "__before"))
    return found.select("__row.*", F.col("__found.at").alias("__found_at"), F.col("__found.gone").alias("__gone_at"))


def orphan_rows(references: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows of ``references`` without a live target at their own recorded_at.

    ``references`` has project_id, ref, recorded_at and any other columns; rows whose ref
    is null or empty are no references. A row with null recorded_at has no target.
    ``parents`` as in :func:`latest_recording`. Empty tables give no orphans, or
    all references. Repeated rows come out as often as they came in.
    """
    whole = F.coalesce("project_id", F.lit(NO_PROJECT))
    refs = references.where("ref is not null and ref <> ''").withColumn("project_id", whole)
    parents = parents.where("id is not null").select(whole.alias("project_id"), "id", "row_id", "recorded_at", "deleted_at")
    uses = refs.groupBy("project_id", "ref").agg(
        F.min("recorded_at").alias("__first_use"), F.max("recorded_at").alias("__last_use"), F.max(F.col("recorded_at").isNull()).alias("__timeless")
    )
    born = parents.groupBy(F.col("project_id").alias("__p_project"), F.col("id").alias("__p_id")).agg(
        F.min("recorded_at").alias("__first_at"), F.max("recorded_at").alias("__last_at"), F.min("deleted_at").alias("__gone_at")
    )
    alive_throughout = (
        (F.col("project_id") == F.col("__p_project"))
        & (F.col("ref") == F.col("__p_id"))
        & (F.col("__first_at") == F.col("__last_at"))
        & (F.col("__first_at") <= F.col("__first_use"))
        & (F.coalesce("__gone_at", F.lit(FAR_FUTURE).cast("timestamp_ntz")) > F.col("__last_use"))
        & ~F.col("__timeless")
    )
    suspects = uses.join(born, alive_throughout, "left_anti").select(F.col("project_id").alias("__s_project"), F.col("ref").alias("__s_ref"))
    suspects = materialize(suspects, scratch_path(references.sparkSession, "suspects"))
    rows = refs.join(suspects, (F.col("project_id") == F.col("__s_project")) & (F.col("ref") == F.col("__s_ref")), "left_semi")
    of_suspects = parents.join(suspects, (F.col("project_id") == F.col("__s_project")) & (F.col("id") == F.col("__s_ref")), "left_semi")
    dead = F.col("__found_at").isNull() | F.coalesce(F.col("__gone_at") <= F.col("recorded_at"), F.lit(False))
    lost = latest_recording(rows, of_suspects).where(dead).drop("__found_at", "__gone_at")
    return lost.withColumn("project_id", F.nullif("project_id", F.lit(NO_PROJECT)))


def orphan_counts(orphans: DataFrame, references: DataFrame) -> DataFrame:
    """Per ref_table and period (generation): references, orphans and their rate; a row_id counts once."""
    per = lambda df, name: df.groupBy("ref_table", "generation", "row_id").agg(F.lit(1).alias("one")).groupBy("ref_table", "generation").agg(F.count("one").alias(name))
    total = per(references.where("ref is not null and ref <> ''"), "n_references")
    lost = per(orphans, "n_orphans").select(F.col("ref_table").alias("o_table"), F.col("generation").alias("o_generation"), "n_orphans")
    return total.join(lost, (F.col("ref_table") == F.col("o_table")) & F.col("generation").eqNullSafe(F.col("o_generation")), "left").select(
        "ref_table",
        "generation",
        "n_references",
        F.coalesce("n_orphans", F.lit(0)).cast("bigint").alias("n_orphans"),
        F.round(F.coalesce("n_orphans", F.lit(0)) / F.col("n_references"), 6).alias("orphan_rate"),
    )
