"""Joining independent fact domains under a check of hash and generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_domains(files: DataFrame, domains: dict[str, DataFrame], strict: bool = True) -> DataFrame:
    """``files`` (project_id, path, sha256, generation) with each domain's ``facts`` column, named by the domain.

    A domain has project_id, path, sha256, generation and facts. A missing partner, another hash or another
    generation is an error when strict; else the row stays with the reason in ``problem``. Domains with
    several rows for a file are incoherent too.
    """
    out, problems = files, []
    for name, df in domains.items():
        d = df.groupBy("project_id", "path").agg(
            F.count(F.lit(1)).alias(f"_{name}_n"), F.min("sha256").alias(f"_{name}_h"), F.min("generation").alias(f"_{name}_g"), F.min_by("facts", "sha256").alias(name)
        )
        out = out.join(d, ["project_id", "path"], "left")
        problems.append(
            F.when(F.col(f"_{name}_n").isNull(), f"{name} missing")
            .when(F.col(f"_{name}_n") > 1, f"{name} repeated")
            .when(~F.col(f"_{name}_h").eqNullSafe(F.col("sha256")), f"{name} hash")
            .when(~F.col(f"_{name}_g").eqNullSafe(F.col("generation")), f"{name} generation")
        )
    out = out.withColumn("problem", F.coalesce(*problems, F.lit(None).cast("string"))).select(*files.columns, *domains, "problem")
    if strict:
        fails = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(" ", F.lit("incoherent facts:"), "path", "problem")).cast("boolean")).otherwise(True)
        return out.where(fails).drop("problem")
    return out


def agree(domains: list[DataFrame], column: str) -> bool:
    """Whether all domains carry one and the same value, as of a project or a generation."""
    values = reduce(DataFrame.union, [d.select(column) for d in domains]).distinct().limit(2).count()
    return values <= 1
