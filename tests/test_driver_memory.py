"""The driver's memory: it is tidied while tables are written, and holds no more than it needs."""

import sys

import pytest
from pyspark.sql import DataFrameWriter

import __spark_entry__
from factloom import session
from factloom.operators import fixpoint
from factloom.plans import program


@pytest.fixture
def tidied(monkeypatch):
    calls = []
    monkeypatch.setattr(session, "tidy", calls.append)
    return calls


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="the native heap is trimmed with glibc")
def test_native_heap_is_trimmed(spark):
    assert session.trim(spark).startswith("Trim native heap")


def test_without_trimming_nothing_fails(spark, monkeypatch):
    monkeypatch.setattr(session, "TRIM", "noSuchCommand")
    assert session.trim(spark) is None


def test_heap_keeps_little_free_memory(spark, monkeypatch):
    ask, given = session._ask, []
    setting = lambda: ask(spark, "HotSpotDiagnostic", "getVMOption", "MaxHeapFreeRatio").get("value")
    usual = setting()
    monkeypatch.setattr(session, "_ask", lambda s, bean, operation, *texts: (given.append(texts[1]) if operation == "setVMOption" else None, ask(s, bean, operation, *texts))[1])
    session.tidy(spark)
    assert given == [str(session.MOST_FREE), usual] and setting() == usual


def test_without_the_setting_garbage_is_collected_all_the_same(spark, monkeypatch):
    monkeypatch.setattr(session, "_ask", lambda *a: None)
    session.tidy(spark)


def test_rounds_of_closures_are_tidied(spark, tidied):
    edges = spark.createDataFrame([(k, k + 1) for k in range(8)], "src int, dst int")
    assert fixpoint.spread(spark.createDataFrame([(0, "x")], "node int, tag string"), edges).count() == 9
    assert len(tidied) >= 4
    del tidied[:]
    context = fixpoint.lattice(spark.createDataFrame([(0, 1)], "node int, context int"), edges.selectExpr("src", "dst", "cast(null as int) sets"))
    assert context.count() == 9 and len(tidied) >= 4


def test_facts_are_tidied(spark, sf_dir, tidied):
    program.facts(spark, sf_dir)
    assert len(tidied) >= 6


def test_functions_by_root_are_made_once(spark, sf_dir, tmp_path, tidied, monkeypatch):
    """Counted while they are written, not in a job of their own."""
    (tmp_path / "own").symlink_to(sf_dir)
    a = program.analysis(spark, str(tmp_path / "own"))
    assert a.placed_calls and a.named_nodes and a.returned_nodes
    counted, count = [], type(a.calls).count
    monkeypatch.setattr(type(a.calls), "count", lambda df: counted.append(df) or count(df))
    before = len(tidied)
    assert a.by_root.columns == ["fn_root", "target"] and not counted
    assert len(tidied) - before >= 2


def test_one_analysis_is_held(spark, sf_dir, tmp_path):
    (tmp_path / "again").symlink_to(sf_dir)
    first = program.analysis(spark, sf_dir)
    assert program.analysis(spark, sf_dir) is first
    program.analysis(spark, str(tmp_path / "again"))
    assert len(program._made) == 1 and not program._found


def test_metrics_read_findings_from_a_table(spark, sf_dir, monkeypatch):
    given = []
    monkeypatch.setattr(program, "metrics", lambda a, found: given.append(found) or found)
    program.analysis_metrics(spark, sf_dir)
    plan = given[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan


@pytest.fixture(scope="module")
def own_dir(sf_dir, tmp_path_factory):
    """A folder that nothing was asked of yet."""
    path = tmp_path_factory.mktemp("own") / "tables"
    path.symlink_to(sf_dir)
    return str(path)


#: In this order each makes only the relations that those before it did not need.
NAMES = [
    "analysis_findings",
    "analysis_directive_creations",
    "analysis_metrics",
    "analysis_owner_contexts",
    "analysis_reachable",
    "analysis_status",
    "exit_rule",
    "findings_order",
    "analysis_callbacks",
    "analysis_roles",
    "analysis_summaries",
    "finding_metrics",
    "text_report",
    "analysis_missing_owners",
    "context_labels",
    "execution_names",
    "analysis_accesses",
]


@pytest.fixture(scope="module")
def counts():
    return {"written": 0, "tidied": 0}


@pytest.mark.parametrize("name", NAMES)
def test_query_is_tidied_while_it_writes(spark, own_dir, counts, tidied, monkeypatch, name):
    parquet = DataFrameWriter.parquet

    def write(*a, **k):
        counts["written"] += 1
        return parquet(*a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    __spark_entry__.queries()[name](spark, own_dir)
    counts["tidied"] += len(tidied)
    assert counts["written"] > 30 and counts["tidied"] >= counts["written"] // 3
