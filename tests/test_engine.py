"""Operators that the queries do not reach: strict modes, sessions, streams, fixes, sources."""

import pytest
from pyspark.errors import PySparkException

from factloom.functions import text
from factloom.operators import analysis, coherence, contracts, fixpoint, retained, rules, spans, tables
from factloom.operators.feed import BucketedTable
from factloom.session import scratch_path
from factloom.sources import folder, readers, sinks
from factloom.streaming import feed as stream


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first().x


def test_byte_functions(spark):
    from pyspark.sql import functions as F

    t = "aé日😀\nz"
    assert one(spark, t, text.byte_slice(F.col("t"), F.lit(1), F.lit(3))) == "é"
    assert one(spark, t, text.byte_slice(F.col("t"), F.lit(1), F.lit(2))) is None
    assert one(spark, t, text.byte_slice(F.col("t"), F.lit(0), F.lit(99))) is None
    raw = t.encode()
    for offset in range(len(raw) + 3):
        at = min(offset, len(raw))
        while at and at < len(raw) and raw[at] & 0xC0 == 0x80:
            at -= 1
        before = raw[:at].decode()
        want = before.count("\n") + 1, len(before.rsplit("\n", 1)[-1].encode("utf-16-le")) // 2 + 1
        assert (one(spark, t, text.line_number(F.col("t"), F.lit(offset))), one(spark, t, text.utf16_column(F.col("t"), F.lit(offset)))) == want
    assert one(spark, None, text.byte_slice(F.col("t"), F.lit(0), F.lit(1))) is None
    assert one(spark, "f(( a ))", text.parentheses_around(F.col("t"), F.lit(4), F.lit(5))) == 2
    assert one(spark, "file:///a%20b", text.uri_path(F.col("t"))) == "/a b"


def test_coherence(spark):
    files = spark.createDataFrame([("p", "a", "h", 1), ("p", "b", "h", 1), ("p", "c", "h", 2), ("p", "d", "h", 1)], "project_id string, path string, sha256 string, generation int")
    d = spark.createDataFrame([("p", "a", "h", 1, "x"), ("p", "b", "g", 1, "y"), ("p", "c", "h", 1, "z")], "project_id string, path string, sha256 string, generation int, facts string")
    got = {r.path: (r.types, r.problem) for r in coherence.join_domains(files, {"types": d}, strict=False).collect()}
    assert got == {"a": ("x", None), "b": ("y", "types hash"), "c": ("z", "types generation"), "d": (None, "types missing")}
    with pytest.raises(PySparkException):
        coherence.join_domains(files, {"types": d}).collect()
    assert coherence.join_domains(files.where("path = 'a'"), {"types": d}).count() == 1
    assert coherence.agree([files, d], "project_id") and not coherence.agree([files], "generation")


def test_smallest_contained(spark):
    boxes = spark.createDataFrame([("k", 0, 10), ("k", 3, 4), ("k", 50, 60)], "k string, i_start bigint, i_end bigint")
    facts = spark.createDataFrame([("k", 3, 4, "in", 2), ("k", 0, 10, "exact", 9), ("k", 1, 2, "first", 1)], "k string, p_start bigint, p_end bigint, v string, o int")
    assert rows(spans.smallest_contained(boxes, facts, ["k"], 8, "v", "o")) == [("k", 0, 10, "exact"), ("k", 3, 4, "in"), ("k", 50, 60, None)]


def test_intervals_of_any_length(spark):
    sizes = [0, 3, 511, 40_000, 10**7, 2**45, 2**62]
    boxes = [("k", a, a + n, k) for k, (a, n) in enumerate((a, n) for n in sizes for a in (0, 700, 10**9))] + [("k", 9, 3, 90), ("k", None, 3, 91), ("k", 1, None, 92)]
    dots = [("k", p, p + w, k) for k, (p, w) in enumerate((p, w) for p in (0, 5, 699, 701, 30_000, 10**9 + 2, 2**44) for w in (0, 2, 10**6))] + [("k", 5, 4, 80), (None, 1, 1, 81), ("k", None, 1, 82), ("j", 1, 1, 83)]
    i = spark.createDataFrame(boxes, "k string, i_start bigint, i_end bigint, i bigint")
    p = spark.createDataFrame(dots, "k string, p_start bigint, p_end bigint, p bigint")
    want = sorted(((x[3], y[3]) for x in dots for y in boxes if None not in x and None not in y and x[0] == y[0] and x[1] <= x[2] and y[1] <= x[1] and y[2] >= x[2]), key=repr)
    assert rows(spans.containing(p, i, ["k"], 512).select("p", "i")) == want
    hit = {x for x, _ in want}
    assert [r.p for r in spans.containing(p, i, ["k"], 512, "left_semi").orderBy("p").collect()] == sorted(hit)
    assert {r.p for r in spans.containing(p, i, ["k"], 512, "left_anti").collect()} == {x[3] for x in dots} - hit
    assert spans.containing(p, i.limit(0), ["k"], 512).count() == 0 and spans.containing(p, i.limit(0), ["k"], 512, "left_anti").count() == len(dots)


def test_unknown_rules_and_uncertain_findings(spark):
    bad = spark.createDataFrame([("p", "a", 1, 2, "SC7003", "no-such-rule", "s")], "project_id string, path string, start_byte bigint, end_byte bigint, code string, rule string, subject string")
    with pytest.raises(PySparkException):
        rules.findings(spark, {"static_violations": bad}).collect()
    assert rules.status(rules.findings(spark, {"static_violations": bad.limit(0)})).first().status == "certified"


def test_retained_sessions(spark):
    schema = "k int, v string"
    states = [[(1, "a"), (2, "b")], [(1, "a"), (2, "B"), (3, None)], [(3, None)], [(3, None)]]
    table = retained.RetainedTable(scratch_path(spark, "test"), ["k"])
    held, token = None, None
    for g, state in enumerate(states, 1):
        table.update(g, spark.createDataFrame(state, schema))
        said = table.exchange(token)
        assert said.mode == ["full", "delta", "delta", "reuse"][g - 1]
        held, token = table.receive(held, said), said.token
        assert rows(held) == sorted(state, key=repr)
    with pytest.raises(retained.StaleGeneration):
        table.update(9, held)
    with pytest.raises(retained.StaleGeneration):
        table.current(1)


def test_affected_files_and_cutoff(spark):
    imports = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "x")], "path string, target string")
    changed = spark.createDataFrame([("a",)], "path string")
    assert {r.path for r in retained.affected_files(changed, imports, imports.limit(0)).collect()} == {"a", "b", "c"}
    old = spark.createDataFrame([("a", "f", "function"), ("q", "g", "value")], "path string, name string, kind string")
    assert retained.reshaped(old, old, changed).count() == 0
    assert retained.reshaped(old, old.where("path <> 'a'"), changed).count() == 1
    contributions = spark.createDataFrame([("a", 2), ("b", 2)], "path string, n int")
    stale = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int")
    assert rows(retained.patch(stale, contributions, changed)) == rows(contributions)
    many = spark.range(200).selectExpr("concat('f', id) as path", "1 as n")
    for n in (10, 70, 200):  # any number of affected files: the others keep what they gave
        again = many.limit(n).selectExpr("path", "2 as n")
        got = retained.patch(many, again, again)
        assert got.count() == 200 and got.where("n = 2").count() == n
    edges = spark.createDataFrame([(1, 2), (1, 9)], "src int, dst int")
    assert retained.same_topology(edges, edges.limit(1), spark.createDataFrame([(2,)], "node int"))
    cache = retained.AnswerCache(scratch_path(spark, "test"))
    assert [cache.answer([changed], lambda d: d)[1] for _ in range(2)] == [False, True]


def test_incremental_equals_full(spark):
    old = spark.createDataFrame([(k, k % 3, "x") for k in range(50)], "k int, g int, v string")
    new = spark.createDataFrame([(k, k % 3, "x" if k % 5 else None) for k in range(10, 60)], "k int, g int, v string")
    assert rows(tables.keyed_apply(old, tables.keyed_diff(old, new, ["k"]), ["k"])) == rows(new)
    assert tables.is_empty(tables.keyed_diff(new, new, ["k"])) and tables.set_equal(new, new) and not tables.disjoint(old, old)
    assert tables.grow(old, new)[1] and not tables.grow(old, old.limit(3))[1]
    assert {r.g for r in tables.changed_groups(old, new, ["g"], ["k", "v"]).collect()} == {0, 1, 2}


def test_fixpoints_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4), (6, 4), (7, 7)], "child bigint, parent bigint")
    assert rows(fixpoint.roots_by_doubling(edges)) == [(1, 3, 2), (2, 3, 1), (4, None, None), (5, None, None), (6, None, None), (7, None, None)]
    assert fixpoint.roots_by_doubling(edges.limit(0)).count() == 0
    chain = spark.range(100).selectExpr("id as child", "id + 1 as parent").union(edges.selectExpr("child + 1000", "parent + 1000"))
    deep = fixpoint.roots_by_doubling(chain)
    assert rows(deep.where("node < 100")) == [(k, 100, 100 - k) for k in range(100)] or deep.where("node < 100 and (root <> 100 or hops <> 100 - node)").count() == 0
    assert deep.where("root is null").count() == 4
    steps = edges.selectExpr("child as src", "parent as dst")
    assert {r.node for r in fixpoint.spread(spark.createDataFrame([(4, 0)], "node bigint, tag int"), steps).collect()} == {4, 5}
    labelled = spark.createDataFrame([(1, 2, None), (2, 3, 4), (3, 1, None), (9, 1, 2)], "src bigint, dst bigint, sets int")
    assert rows(fixpoint.lattice(spark.createDataFrame([(1, 1)], "node bigint, context int"), labelled)) == [(1, 5), (2, 5), (3, 4)]


def test_first_wins_and_path_counts(spark):
    edges = spark.createDataFrame([("a", "c", 2), ("b", "c", 1), ("c", "d", 1), ("d", "a", 1), ("a", "d", 5), ("x", "y", 1)], "src string, dst string, ord int")
    seeds = spark.createDataFrame([("a", "A"), ("b", "B"), ("b", "Z")], "node string, tag string")
    assert rows(fixpoint.first_wins(seeds, edges)) == [("a", "A"), ("b", "B"), ("c", "B"), ("d", "A")]
    assert fixpoint.first_wins(seeds.limit(0), edges).count() == 0
    dag = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)], "src int, dst int")
    one = spark.createDataFrame([(1,)], "node int")
    assert rows(fixpoint.path_counts(one, dag)) == [(1, 1, 1), (1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 5, 2)]
    with pytest.raises(RuntimeError):
        fixpoint.path_counts(one, dag.union(spark.createDataFrame([(5, 1)], "src int, dst int")))


def test_positions(spark):
    from factloom.operators import ordering

    data = [("p", n, k) for k, n in enumerate([5, 5, 2000, None, 7, -3, 10**12])] + [(None, 1, 90), ("q", 3, 91)]
    got = {r.k: r.position for r in ordering.positions(spark.createDataFrame(data, "f string, n bigint, k int"), ["f"], ["n", "k"], 16).collect()}
    assert got == {3: 0, 5: 1, 0: 2, 1: 3, 4: 4, 2: 5, 6: 6, 90: 0, 91: 0}
    assert ordering.demands(spark.createDataFrame(data + data, "f string, n bigint, k int"), ["f"], ["n"], 16).count() == 8


def test_type_and_pattern_texts(spark):
    from pyspark.sql import functions as F

    ask = lambda f, texts: [one(spark, t, f(F.col("t"))) for t in texts]
    assert ask(text.cleanup_type, ["void", " undefined ", "() => void", "() => Promise<void>", "string", "(a: {}) => void", None]) == [True, True, True, False, False, False, None]
    assert ask(text.returned_arrow, ["(a, b) => 1", "async x=>x", " $a => {}", "(a): T => z", "f(x)", "=> x", ""]) == [True, True, True, False, False, False, False]
    assert one(spark, "é.b.cd(", text.property_start(F.col("t"), F.lit(0), F.lit(7))) == 5 and one(spark, "ab", text.property_start(F.col("t"), F.lit(1), F.lit(9))) == 1
    assert one(spark, "/a b/é", text.path_uri(F.col("t"))) == "file:///a%20b/%C3%A9" and one(spark, "/a b/é", text.uri_path(text.path_uri(F.col("t")))) == "/a b/é"
    assert one(spark, "", text.constant_array_binding(F.lit("const [ "), F.lit(", b] = "), F.lit("<T>(1)")))
    assert not one(spark, "", text.constant_array_binding(F.lit("let ["), F.lit("] = "), F.lit("(1)")))


def test_contracts(spark):
    texts = spark.createDataFrame([('{"schemaVersion": 1, "package": {"name": "a"}, "exports": {"x": {"kind": "function", "callbacks": [{"argument": 0, "execution": "later"}]}}, "evidence": {"kind": "trusted"}}',), ("{",), ('{"schemaVersion": 2}',), (None,),
        ('{"schemaVersion": 1, "package": {"name": "a", "author": 1}, "exports": {}, "evidence": {"kind": "trusted"}}',), ('{"schemaVersion": 1, "package": {"name": "a"}, "exports": {"x": {"kind": "value", "callbacks": [{"at": 1}]}}, "evidence": {"kind": "trusted"}}',)], "text string")
    assert sorted(r.problem for r in contracts.decode(texts).collect()) == ["not a contract", "not a contract", "unknown callback", "unknown field", "unknown field", "unknown version"]
    s = spark.createDataFrame([("a", "1", "x", "value", False), ("b", "1", "y", "value", True)], "package string, version string, export string, kind string, unresolved boolean")
    made = {r.package: r.text for r in contracts.emit(s).collect()}
    assert made["b"] is None and contracts.decode(spark.createDataFrame([(made["a"],)], "text string")).first().problem is None


def test_execution_maps(spark):
    maps = spark.createDataFrame([("ab", '{"compilerFactsProtocol": 1, "sourceHash": "sha256:fb8e20fc2e4c3f248c60c39bd652f3c1347298bb977b8b4d5903b85055620603", "jsxOperations": [{"start": 0, "end": 2, "kind": " "}]}'), ("ab", "x")], "source string, map_json string")
    assert [r.problem for r in readers.execution_maps(maps).collect()] == ["jsxOperations without kind", "not a map"]
    with pytest.raises(PySparkException):
        readers.execution_maps(maps, strict=True).collect()


def test_sources_from_folders(spark, tmp_path):
    for name, body in {"a.ts": b"let a", "b.py": b"x\xff", "sub/c.ts": "é".encode()}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    folder.register(spark)
    got = spark.read.format("sourcefolder").option("path", str(tmp_path)).option("suffixes", ".ts").load()
    assert sorted(r.source for r in got.collect()) == ["let a", "é"]
    listed = readers.read_sources(spark, str(tmp_path), "*.ts")
    assert listed.count() == 2
    known = spark.createDataFrame(listed.collect(), listed.schema)
    look = lambda k: readers.changed_files(k, spark, str(tmp_path), "*.ts")
    assert look(known).count() == 0 and look(known.limit(0)).count() == 2
    moved = known.selectExpr("path", "source", "stamp - interval 1 hour as stamp", "actual")
    assert look(moved).count() == 0  # stamps moved, contents did not
    assert look(moved.selectExpr("path", "source", "stamp", "'sha256:0' as actual")).count() == 2
    assert readers.demanded(listed, listed.limit(1), ["path"]).count() == 1


def test_stream_applied_twice_is_one_batch(spark, tmp_path):
    schema = "change_id bigint, project_id string, batch bigint, path string, version bigint, deleted boolean, source string"
    data = [(k, "p", k // 5, f"/f{k % 7}", k % 11, k % 6 == 0, f"s{k}") for k in range(60)]
    for part in range(3):
        spark.createDataFrame(data[part * 20 : part * 20 + 20], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "updates.parquet"), mode="append")
    once = BucketedTable(spark, str(tmp_path / "once"), 4)
    once.apply(spark.createDataFrame(data, schema))
    streamed = BucketedTable(spark, str(tmp_path / "stream"), 4)
    for checkpoint in ("one", "two"):  # the second run delivers everything again
        stream.apply_stream(stream.read_changes(spark, str(tmp_path / "in"), "updates.parquet", 1), streamed, str(tmp_path / checkpoint), once=True).awaitTermination()
    # files arrive in any order, so only the highest versions must agree
    assert [(r[1], r[2]) for r in rows(streamed.rows())] == [(r[1], r[2]) for r in rows(once.rows())]


def test_fixes_and_flow(spark):
    params = spark.createDataFrame([("p", "a", "f", 11, 16, ["props", "x"]), ("p", "a", "g", 30, 35, [])], "project_id string, path string, fn string, start int, end int, names_in_scope array<string>")
    refs = spark.createDataFrame([("f", 20, 21, "a", True), ("g", 40, 41, "b", False)], "fn string, start int, end int, property string, safe boolean")
    fixes = analysis.destructured_fixes(params, refs).collect()
    assert [(r.fn, [tuple(e) for e in r.edits]) for r in fixes] == [("f", [(11, 16, "props2"), (20, 21, "props2.a")])]
    e = lambda s: [(k if not k.isdigit() else "call", int(k) if k.isdigit() else None) for k in s.split()]
    flow = {"a": "1 await 2", "b": "if await 1 end 2", "c": "if await else await end 3", "d": "if return end await 4", "e": "loop await 5 end 6", "f": "if await else return end 7", "g": ""}
    df = spark.createDataFrame([(k, e(v)) for k, v in flow.items()] + [("n", None)], "fn string, events array<struct<kind string, call bigint>>")
    assert rows(analysis.calls_after_await(df)) == [("a", 2), ("b", 1), ("c", 3), ("d", 4), ("e", 5), ("f", 7)]
    ent = spark.createDataFrame([("solid-js", None), (None, [("x", "k", ("/W/Node_Modules/solid-js/a", 1, 2))]), ("other", []), (None, None)], "origin_module string, alias_declarations array<struct<name string, kind string, location struct<path string, start_byte bigint, end_byte bigint>>>")
    from pyspark.sql import functions as F

    assert [r.x for r in ent.select(analysis.typed_accessor(F.col("origin_module"), F.col("alias_declarations")).alias("x")).collect()] == [True, True, False, False]
    src = "f(() => { a(); onCleanup(g); });"
    call = spark.createDataFrame([("p", "a", src, 15, 27, 25, 26, 29), ("p", "a", src, 10, 13, 12, 12, 29)], "project_id string, path string, source string, start int, end int, arg_start int, arg_end int, body_end int")
    fixed = analysis.terminal_cleanup_fixes(call).withColumn("source", F.lit(src)).select(text.apply_edits(F.col("source"), F.col("edits")).alias("x")).collect()
    assert [r.x for r in fixed] == ["f(() => { a(); return g; });"]
    assert spark.range(1).select(analysis.context_label(F.lit("event"), F.lit(None)).alias("x")).first().x == "event in module"
    assert analysis.namespace_members(spark.createDataFrame([("p", "s")], "project_id string, symbol string"), ["a", "b"]).count() == 2


def test_reports(spark):
    f = spark.createDataFrame([("p", "a", 4, 5, "SC1001", "r", "violation", "error")], "project_id string, path string, start_byte bigint, end_byte bigint, code string, rule string, kind string, severity string")
    s = spark.createDataFrame([("p", "a", "ab\ncd\n")], "project_id string, path string, source string")
    assert tuple(sinks.located(f, s).first())[-2:] == (2, 2)
    assert sinks.excerpts(f, s).first().excerpt == "cd"
    assert sinks.text_report(f).first().line == "a:4: error SC1001 r"
    assert sinks.failing_exit(rules.status(f), True).first().fails and not sinks.failing_exit(rules.status(f), False).first().fails
