"""Findings of small programs."""

import mini
import pytest

from factloom.operators.analysis import Analysis, forwarded, metrics, reads_after_await, under_boundary

STATE = 'import { createSignal } from "solid-js";\nexport const [count, setCount] = createSignal(0);\nexport function helper(n) { return n ? other(n) : count(); }\nexport function other(n) { return n ? helper(n) : 0; }\nfunction lonely() { return 1; }\n'
APP = """import { createEffect, createMemo, createSignal, onCleanup, onSettled, flush } from "solid-js";
import { count } from "./state";
import { thing } from "@x/y/z";
import { gone } from "@k/l";
export function Good() { return view({ a: count() }); }
export function Bad() { const x = count(); return x; }
export function Through() { const y = other(3); return y; }
export function Press() { return button(() => setCount(count() + 1)); }
export function Write() { setCount(2); createMemo(() => setCount(3)); return 1; }
export function Owned() { createEffect(() => count(), () => { log(1); }); onCleanup(() => { log(2); }); return 1; }
export function maybe() { onCleanup(() => { log(3); }); }
createEffect(() => 4);
onSettled(() => { createMemo(() => 5); flush(); return 6; });
export function Test() { if (count()) return 7; return 8; }
export function make() { return () => count(); }
const get = make();
export function Kept() { const z = get(); return z; }
export function Dir() { createMemo(async () => 9, { sync: true }); return bind(() => { createSignal(10); }); }
"""


@pytest.fixture(scope="module")
def analysis(spark):
    return Analysis(
        mini.facts(
            spark,
            {"/src/state.ts": STATE, "/src/App.tsx": APP},
            tracked=["{ a: count() }", "count() + 0"],
            events=["() => setCount(count() + 1)"],
            directives=["() => { createSignal(10); }"],
            markup=["{ a: count() }", "log(2)"],
        )
    )


def text_at(r):
    return (STATE if r.path == "/src/state.ts" else APP)[r.start_byte : r.end_byte]


def test_findings(spark, analysis):
    exports = spark.createDataFrame([("@k/l", "here"), ("solid-js", "createEffect"), ("@x/y", "thing")], "name string, export string")
    got = {(r.rule, text_at(r) if r.start_byte != r.end_byte else r.subject) for r in analysis.findings(exports).collect()}
    assert ("strict-read-untracked", "count()") in got
    assert ("strict-read-untracked", "other(3)") in got  # through a recursive helper
    reads = [r for r in analysis.findings().collect() if r.rule == "strict-read-untracked"]
    lines = sorted(APP[: r.start_byte].count("\n") for r in reads)
    assert lines == [5, 6, 13, 16]  # Bad, Through, Test, Kept (through a returned closure); Good is tracked, Press an event, effects track, helpers count at calls
    assert {t for r, t in got if r == "reactive-write-in-owned-scope"} == {"setCount(2)", "setCount(3)"}
    assert {t for r, t in got if r == "no-owner-effect"} == {"createEffect(() => 4)"}
    assert {t for r, t in got if r == "no-owner-cleanup"} == {"onCleanup(() => { log(3); })"}
    kinds = {r.rule: (r.kind, r.severity) for r in analysis.findings().collect()}
    assert kinds["no-owner-cleanup"] == ("uncertifiable", "error")  # exported: its callers may own it
    assert kinds["no-owner-effect"] == ("violation", "warning")
    assert ("primitive-in-leaf-owner", "createMemo(() => 5)") in got and ("flush-in-forbidden-scope", "flush()") in got
    assert ("invalid-cleanup-return", "6") in got
    assert ("component-returns-conditionally", "7") in got and ("component-returns-conditionally", "8") not in got
    assert ("primitive-in-directive-application", "createSignal(10)") in got
    assert ("missing-effect-function", "createEffect(() => 4)") in got
    assert ("sync-node-received-async", "createMemo(async () => 9, { sync: true })") in got
    assert ("execution-map-incomplete", "log(2)") in got and ("execution-map-incomplete", "{ a: count() }") not in got
    assert ("package-contract-export-missing", "gone") in got and not any(t == "@x/y/z" for _, t in got)


def test_missing_contract(spark, analysis):
    exports = spark.createDataFrame([("solid-js", "createEffect")], "name string, export string")
    lost = {r.subject for r in analysis.contract_violations(exports).where("code = 'SC9005'").collect()}
    assert lost == {"@x/y/z", "@k/l"}


def test_reachability_and_summaries(analysis):
    names = {r.node: r.name for r in analysis.nodes.where("name is not null").collect()}
    reached = {names.get(r.node) for r in analysis.reachable.collect()}
    assert {"Good", "Through", "helper", "other"} <= reached and "lonely" not in reached
    assert {names.get(r.node) for r in analysis.summaries.collect()} >= {"helper", "other", "Through", "Bad"}
    m = metrics(analysis, analysis.findings()).first()
    assert m.files == 2 and m.open >= 1 and m.functions > 15 and m.obligations > 10 and m.missing_owners > 0


MORE = """import { action, affects, createMemo, createStore, createSignal, refresh, onSettled, Loading, Loading as Wait } from "solid-js";
const late = createMemo(async () => 1);
const [one, setOne] = createSignal(1);
const [all, setAll] = createStore({ a: 1 });
const plain = 3;
const save = action(() => 2);
export function Async() { late(); return 1; }
export function Shown() { return <Loading>{late()}</Loading>; }
export function Bare() { return { x: late() }; }
export function Call() { save(); return 1; }
export function Press() { return on(() => save()); }
export function Props({ a, b }) { return a; }
export function Wait2() { const f = async () => { await one(); one(); }; return 1; }
refresh(one); refresh(plain); refresh(other.x); affects(one, "k"); affects(all, "k");
onSettled(() => () => 5);
const orphan = <Loading>x</Loading>;
"""


def test_async_actions_targets_and_boundaries(spark):
    a = Analysis(mini.facts(spark, {"/m.tsx": MORE}, tracked=["{late()}", "{ x: late() }"], events=["() => save()"]))
    got = {(r.rule, MORE[r.start_byte : r.end_byte], MORE[: r.start_byte].count("\n")) for r in a.findings().collect()}
    assert {(r, n) for r, t, n in got if t == "late()"} >= {("pending-async-untracked-read", 6), ("async-outside-loading-boundary", 8)}
    assert not any(n == 7 and r.startswith(("pending", "async")) for r, _, n in got)
    assert {(t, n) for r, t, n in got if r == "action-called-in-owned-scope"} == {("save()", 9)}
    assert ("component-props-destructure", "{ a, b }", 11) in got
    assert ("reactive-read-after-await", "one()", 12) in got
    assert {t for r, t, _ in got if r == "invalid-refresh-target"} == {"refresh(plain)"}
    assert {t for r, t, _ in got if r == "refresh-target-unresolved"} == {"refresh(other.x)"}
    assert {t for r, t, _ in got if r == "affects-keys-on-accessor"} == {'affects(one, "k")'}
    assert {t for r, t, _ in got if r == "settled-cleanup-unowned"} == {"onSettled(() => () => 5)"}
    assert {n for r, _, n in got if r == "no-owner-boundary"} == {15}


def test_props_roots(spark):
    program = """import { merge } from "solid-js";
export function One(props) { const p = props; const q = p; const all = merge(other, q); return 1; }
export function lower(props2) { const r = props2; return r; }
"""
    f = mini.facts(spark, {"/p.tsx": program})
    at = [(program.index("(props)") + 1, "One"), (program.index("(props2)") + 1, "lower")]
    spans_ = {r.name: (r.start, r.end) for r in f.functions.collect()}
    f.params = spark.createDataFrame([("p", "/p.tsx", *spans_[n], 0, "name", a, program.index(")", a)) for a, n in at], mini.SCHEMAS["params"])
    got = {(r.root.split("\x00")[-1], r.component) for r in Analysis(f).props_roots.collect()}
    assert got == {("props", "One"), ("p", "One"), ("q", "One"), ("all", "One")}


def test_factories_to_a_fixpoint(spark):
    program = """import { createSignal } from "solid-js";
const [count, setCount] = createSignal(0);
function make() { return () => count(); }
function wrap() { return make(); }
function twice() { return wrap(); }
function outer() { return () => make(); }
const a = twice();
const b = outer();
const c = b();
export function One() { const x = a(); return x; }
export function Two() { const y = c(); return y; }
export function Three() { const z = b(); return z; }
"""
    found = Analysis(mini.facts(spark, {"/f.tsx": program})).findings().where("rule = 'strict-read-untracked'").collect()
    assert sorted(program[: r.start_byte].count("\n") for r in found) == [9, 10]  # through returned calls, and through a closure's result


def test_small_joins(spark, analysis):
    args = spark.createDataFrame([("r", 0, 1), ("r", 1, 2), ("q", 0, 3)], "callee_root string, pos int, call int")
    s = spark.createDataFrame([("r", 1, "tracked")], "root string, parameter int, execution string")
    assert [(r.call, r.execution) for r in forwarded(args, s).collect()] == [(2, "tracked")]
    r = spark.createDataFrame([("p", "f", 5, 6), ("p", "f", 50, 60)], "project_id string, path string, start bigint, `end` bigint")
    b = spark.createDataFrame([("p", "f", 0, 10)], "project_id string, path string, start bigint, `end` bigint")
    assert {(x.start, x.under_loading) for x in under_boundary(r, b).collect()} == {(5, True), (50, False)}
    assert reads_after_await(r, r.limit(1)).count() == 1


def test_empty_facts(spark):
    none = Analysis(mini.facts(spark, {"/a.ts": "\n"}))
    assert none.findings().count() == 0
