"""Joins by containment of spans.

A span is (keys, start, end), inclusive on both ends. Catalyst plans a containment join
as an equality on the keys with a residual; where one key holds very many spans that is
quadratic. So intervals are laid over slots of a width that suits their length: an interval gets a row
per slot it touches, a point only the slot of its start, and the slot joins the keys. A point
meets an interval at most once, and a hot key is spread over its slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: An interval over more slots than this goes to slots that are so many times wider.
MOST_SLOTS = 64


def _levels(intervals: DataFrame, slot: int) -> list[int]:
    """The widths of slots that the intervals need: one job that gives at most a dozen numbers, mostly one."""
    level = F.greatest(F.lit(0), F.ceil(F.log(float(MOST_SLOTS), (F.col("i_end").cast("double") - F.col("i_start") + 1) / slot)) - 1)
    found = intervals.where("i_start <= i_end").agg(F.collect_set(level.cast("int"))).first()[0]
    return sorted(found or [0])


def containing(points: DataFrame, intervals: DataFrame, keys: list[str], slot: int, how: str = "inner") -> DataFrame:
    """Every interval that contains a point, in one row each (or semi / anti rows of the points).

    ``points`` has the keys, p_start and p_end; ``intervals`` has the keys, i_start and i_end; other
    columns must not clash. slot: width in the unit of the spans, about the usual length of an interval.
    Intervals much longer than a slot are laid over wider slots, 64 times wider for each level, so an interval of any length has a
    bounded number of rows; a point has a row per level in use, and all levels meet in one join, so the plan does not grow with them.
    Spans with a null end, or reversed ones, contain nothing and lie in nothing.
    """
    levels = _levels(intervals, slot)
    if len(levels) == 1:
        return _meet(points.withColumn("_level", F.lit(levels[0])), intervals.withColumn("_level", F.lit(levels[0])), keys, slot, how)
    length = F.col("i_end").cast("double") - F.col("i_start") + 1
    own = F.lit(levels[-1])
    for level in reversed(levels[:-1]):
        own = F.when(length <= slot * MOST_SLOTS ** (level + 1), level).otherwise(own)
    laid, looked = intervals.withColumn("_level", own), F.explode(F.array(*[F.lit(level) for level in levels]))
    if how == "inner":
        return _meet(points.withColumn("_level", looked), laid, keys, slot, how)
    places = [*keys, "p_start", "p_end"]
    hit = _meet(points.select(*places).distinct().withColumn("_level", looked), laid, keys, slot, "left_semi").distinct()
    return points.join(hit, places, how).select(*points.columns)


def _meet(points: DataFrame, intervals: DataFrame, keys: list[str], slot: int, how: str) -> DataFrame:
    """One join of points and intervals on the keys and the slots of their levels; the slots of a level are MOST_SLOTS times wider than those below."""
    width = F.lit(slot) * F.pow(F.lit(float(MOST_SLOTS)), F.col("_level")).cast("bigint")
    slots = F.explode(F.sequence(F.floor(F.col("i_start") / width), F.floor(F.col("i_end") / width)))
    spread = intervals.where("i_start <= i_end").withColumn("_slot", slots).withColumnRenamed("_level", "_i_level")
    for k in keys:
        spread = spread.withColumnRenamed(k, f"_i_{k}")
    on = (F.col("_level") == F.col("_i_level")) & (F.col("_at") == F.col("_slot")) & (F.col("i_start") <= F.col("p_start")) & (F.col("i_end") >= F.col("p_end")) & (F.col("p_start") <= F.col("p_end"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_i_{k}"))
    return points.withColumn("_at", F.floor(F.col("p_start") / width)).join(spread, on, how).drop("_slot", "_at", "_level", "_i_level", *[f"_i_{k}" for k in keys])


def _pick(pairs: DataFrame, point_id: list[str], value: Column, order: Column, last: bool) -> DataFrame:
    best = (F.max_by if last else F.min_by)(value, order)
    return pairs.groupBy(*point_id).agg(best.alias("picked"))


def innermost(pairs: DataFrame, point_id: list[str], value: Column, ord_: Column) -> DataFrame:
    """The shortest containing interval; of equal ones the first by ``ord_``."""
    return _pick(pairs, point_id, value, F.struct(F.col("i_end") - F.col("i_start"), ord_), False)


def outermost(pairs: DataFrame, point_id: list[str], value: Column, ord_: Column) -> DataFrame:
    """The longest containing interval; of equal ones the last by ``ord_``."""
    return _pick(pairs, point_id, value, F.struct(F.col("i_end") - F.col("i_start"), ord_), True)


def first_containing(pairs: DataFrame, point_id: list[str], value: Column, ord_: Column) -> DataFrame:
    """The containing interval that comes first, whatever its length."""
    return _pick(pairs, point_id, value, ord_, False)


def one_per_location(facts: DataFrame, location: list[str], ord_: str, last: bool) -> DataFrame:
    """One fact per exact location: the first or the last by ``ord_``."""
    rest = [c for c in facts.columns if c not in location]
    best = (F.max_by if last else F.min_by)(F.struct(*rest), F.col(ord_))
    return facts.groupBy(*location).agg(best.alias("_row")).select(*location, "_row.*")


def near_in_time(rows: DataFrame, key: str, at: str, ident: str, seconds: int) -> DataFrame:
    """(src, dst) for rows of one key where dst follows src by at most ``seconds``; a slot of that width joins the key."""
    unix = F.unix_micros(F.col(at).cast("timestamp"))
    width = seconds * 1_000_000
    left = rows.select(F.col(key).alias("k"), F.col(ident).alias("src"), unix.alias("t"), F.explode(F.array(F.floor(unix / width), F.floor(unix / width) + 1)).alias("slot"))
    right = rows.select(F.col(key).alias("k2"), F.col(ident).alias("dst"), unix.alias("t2"), F.floor(unix / width).alias("slot2"))
    near = (F.col("k") == F.col("k2")) & (F.col("slot") == F.col("slot2")) & (F.col("t2") > F.col("t")) & (F.col("t2") - F.col("t") <= width)
    return left.join(right, near).select("src", "dst")


def smallest_contained(boxes: DataFrame, facts: DataFrame, keys: list[str], slot: int, value: str, ord_: str) -> DataFrame:
    """Per box (keys, i_start, i_end and more) the value of the fact at exactly its span, else of the smallest fact inside it.

    ``facts`` has the keys, p_start, p_end, the value and an order; of equal lengths the first counts. Null
    where there is none.
    """
    pairs = containing(facts, boxes.select(*keys, "i_start", "i_end").distinct(), keys, slot)
    exact = (F.col("p_start") == F.col("i_start")) & (F.col("p_end") == F.col("i_end"))
    best = F.min_by(F.struct(F.col(value)), F.struct(F.when(exact, 0).otherwise(1), F.col("p_end") - F.col("p_start"), F.col(ord_)))
    found = pairs.groupBy(*keys, "i_start", "i_end").agg(best.alias("_v")).select(*keys, "i_start", "i_end", F.col(f"_v.{value}").alias("found"))
    return boxes.join(found, [*keys, "i_start", "i_end"], "left")
