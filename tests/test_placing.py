"""Containment joins and call placement stay one join each: the driver plans every job, so its memory follows the size of plans."""

import random

import pytest

from factloom.operators import spans
from factloom.plans import program


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_intervals_of_all_lengths_meet_in_one_join(spark, how):
    r = random.Random(7)
    boxes = [(r.choice("ab"), s := r.randrange(3_000_000), s + r.choice([-1, 0, 3, 70, 5_000, 400_000])) for _ in range(150)]
    points = [(r.choice("abc"), s := r.randrange(3_000_000), s + r.choice([0, 2, 9])) for _ in range(300)] + [("a", s, e) for k, s, e in boxes[:60] if k == "a"] * 2
    got = spans.containing(spark.createDataFrame(points, "k string, p_start bigint, p_end bigint"), spark.createDataFrame(boxes, "k string, i_start bigint, i_end bigint"), ["k"], 4, how)
    around = [(p, [b for b in boxes if b[0] == p[0] and b[1] <= p[1] <= p[2] <= b[2]]) for p in points]
    want = {"inner": [(*p, *b[1:]) for p, found in around for b in found], "left_semi": [p for p, found in around if found], "left_anti": [p for p, found in around if not found]}[how]
    assert rows(got) == sorted(want)
    assert joins(got) == (1 if how == "inner" else 2)


def test_calls_are_placed_in_one_containment_join(spark, sf_dir):
    a = program.analysis(spark, sf_dir)
    placed = a.placed(a.calls, "start", "end", ["start", "end"])
    assert joins(placed) <= 2
    assert placed.count() == a.calls.select("project_id", "path", "start", "end").distinct().count()
