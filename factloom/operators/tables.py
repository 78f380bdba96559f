"""Keyed differences between tables, their application, and set operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(keys: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, op and the new values: ``changed`` for added and differing rows, ``removed`` for missing ones (values null)."""
    rest = [c for c in new.columns if c not in keys]
    o = old.select(*keys, F.struct(*rest).alias("v"), F.lit(True).alias("there")).alias("o")
    n = new.select(*keys, F.struct(*rest).alias("v"), F.lit(True).alias("there")).alias("n")
    both = o.join(n, _same(keys, "o", "n"), "full_outer")
    op = F.when(F.col("n.there").isNull(), "removed").when(F.col("o.there").isNull() | ~F.col("o.v").eqNullSafe(F.col("n.v")), "changed")
    return both.select(*[F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys], op.alias("op"), "n.v").where("op is not null").select(*keys, "op", "v.*")


def keyed_apply(old: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of a :func:`keyed_diff` removed and its changed ones put in."""
    kept = old.alias("o").join(delta.select(*keys).alias("d"), _same(keys, "o", "d"), "left_anti")
    return kept.unionByName(delta.where("op = 'changed'").select(*old.columns))


def replace_groups(old: DataFrame, new: DataFrame, group: list[str], groups: DataFrame) -> DataFrame:
    """All rows of the named groups give way to those of ``new`` (a group may become empty)."""
    kept = old.alias("o").join(groups.select(*group).distinct().alias("g"), _same(group, "o", "g"), "left_anti")
    return kept.unionByName(new.alias("n").join(groups.select(*group).distinct().alias("g"), _same(group, "n", "g"), "left_semi").select(*old.columns))


def overlay(base: DataFrame, over: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` seen through ``over`` (same columns and deleted): its rows hide base rows, deleted ones without a substitute."""
    kept = base.alias("b").join(over.select(*keys).alias("x"), _same(keys, "b", "x"), "left_anti")
    return kept.unionByName(over.where("not coalesce(deleted, false)").select(*base.columns))


def is_empty(delta: DataFrame) -> bool:
    """Whether a delta says nothing, so that retained results can be used again."""
    return delta.isEmpty()


def set_equal(a: DataFrame, b: DataFrame) -> bool:
    return a.select(*b.columns).exceptAll(b).isEmpty() and b.exceptAll(a.select(*b.columns)).isEmpty()


def disjoint(a: DataFrame, b: DataFrame) -> bool:
    return a.intersect(b).isEmpty()


def grow(known: DataFrame, more: DataFrame) -> tuple[DataFrame, bool]:
    """Set union, and whether it brought anything new."""
    new = more.select(*known.columns).distinct().exceptAll(known.distinct().intersect(more.select(*known.columns).distinct()))
    return known.distinct().unionByName(new), not new.isEmpty()


def group_hash(df: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """One hash per group that ignores the order of rows: sums of row hashes, combined before the shuffle."""
    row = F.xxhash64(*values)
    return df.groupBy(*group).agg(F.bit_xor(row).alias("hash_xor"), F.sum(F.pmod(row, F.lit(2**31))).alias("hash_sum"), F.count(F.lit(1)).alias("n_rows"))


def changed_groups(old: DataFrame, new: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """Groups whose rows differ between two tables, compared by their hashes."""
    o, n = group_hash(old, group, values).alias("o"), group_hash(new, group, values).alias("n")
    same = (F.col("o.hash_xor") == F.col("n.hash_xor")) & (F.col("o.hash_sum") == F.col("n.hash_sum")) & (F.col("o.n_rows") == F.col("n.n_rows"))
    return o.join(n, _same(group, "o", "n"), "full_outer").where(~F.coalesce(same, F.lit(False))).select(*[F.coalesce(F.col(f"n.{g}"), F.col(f"o.{g}")).alias(g) for g in group])


def first_seen(df: DataFrame, keys: list[str], ord_: str) -> DataFrame:
    """The first row of each key by ``ord_``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(ord_)).alias("_row")).select(*keys, "_row.*")
