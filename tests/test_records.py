"""p2 to p6 against brute force on small tables with nulls, ties, repeats, hot keys and clashing columns."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import feed, hierarchy, nested, references, snapshots
from factloom.session import scratch_path

T0 = dt.datetime(2025, 1, 1)
SYMBOLS = "row_id bigint, project_id string, id string, alias_target string, recorded_at timestamp_ntz, deleted_at timestamp_ntz"


def at(n):
    return None if n is None else T0 + dt.timedelta(days=n)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# orphan references


def random_symbols(rng, n):
    out = []
    for k in range(n):
        hot = rng.random() < 0.4
        i = "hot" if hot else f"s{rng.randrange(12)}"
        out.append((k, rng.choice(["p", "q", None]) if rng.random() < 0.1 else "p", i, rng.choice([None, "", "hot", f"s{rng.randrange(15)}"]), at(rng.choice([None, *range(90)]) if rng.random() < 0.05 else k), at(k + rng.randrange(40)) if rng.random() < 0.3 else None))
    return out + out[: n // 4]


def orphans_by_hand(refs, symbols):
    bad = set()
    for row_id, project, ref, t in refs:
        if not ref:
            continue
        same = [s for s in symbols if s[1] == project and s[2] == ref and s[4] is not None and t is not None and s[4] <= t]
        last = max(same, key=lambda s: (s[4], s[0]), default=None)
        if last is None or (last[5] is not None and last[5] <= t):
            bad.add(row_id)
    return bad


@pytest.mark.parametrize("seed", range(3))
def test_orphans(spark, seed):
    rng = random.Random(seed)
    symbols = random_symbols(rng, 60)
    refs = [(k, rng.choice(["p", "p", "p", "q", None]), rng.choice(["hot", "hot", "s1", "s2", "s99", "", None, f"s{rng.randrange(14)}"]), at(rng.choice([*range(70), None]))) for k in range(150)]
    r = spark.createDataFrame([(*x, "x", 1) for x in refs + refs[:20]], "row_id bigint, project_id string, ref string, recorded_at timestamp_ntz, s_project string, alive_from int")
    s = spark.createDataFrame(symbols, SYMBOLS).selectExpr("*", "1 as slice", "2 as first_at")
    got = {x.row_id for x in references.orphan_rows(r, s).select("row_id").collect()}
    assert got == orphans_by_hand(refs, symbols)


def test_orphans_of_empty_tables(spark):
    refs = spark.createDataFrame([(1, "p", "a", at(1))], "row_id bigint, project_id string, ref string, recorded_at timestamp_ntz")
    none = spark.createDataFrame([], SYMBOLS)
    assert references.orphan_rows(refs, none).count() == 1
    assert references.orphan_rows(refs.limit(0), none).count() == 0


# change feed

FEED = "change_id bigint, project_id string, batch bigint, path string, version bigint, deleted boolean, source string"


def files_by_hand(changes):
    state, seen = {}, set()
    for c in sorted(changes, key=lambda c: c[0]):
        if c[0] in seen or c[3] is None or c[4] is None:
            continue
        seen.add(c[0])
        path = c[3].replace("\\", "/")
        path = ("/" if path.startswith("/") else "") + "/".join(x for x in path.split("/") if x not in ("", "."))
        old = state.get((c[1], path))
        if old is None or c[4] > old[0]:
            state[c[1], path] = (c[4], bool(c[5]), c[6] or "")
    return sorted(((p, f, v, s) for (p, f), (v, gone, s) in state.items() if not gone), key=repr)


def random_feed(rng, n):
    out = []
    for k in range(n):
        path = rng.choice(["/a/hot.ts", "/a/hot.ts", "/a//hot.ts", "\\a\\hot.ts", "/a/./b.ts", "/a/../c.ts", "d.ts/", None, f"/x/{rng.randrange(9)}"])
        out.append((k, rng.choice(["p", "q", None, ""]), k // 10, path, rng.choice([None, *range(12)]), rng.choice([True, False, False, None]), rng.choice([None, "", f"s{k}", "é" * 5000])))
    out += out[: n // 5]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_feed_in_slices_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    changes = random_feed(rng, 120)
    df = spark.createDataFrame([(*c, 1, "x") for c in changes], FEED + ", bucket int, c string")
    store = feed.BucketedTable(spark, scratch_path(spark, "test"), buckets=4)
    for low in (0, 40, 80):
        store.apply(df.where(f"change_id >= {low} and change_id < {low + 40}"))
    assert rows(store.current()) == files_by_hand(changes)
    touched = store.apply(df.where("change_id < 20"))  # delivered again: nothing changes
    assert rows(store.current()) == files_by_hand(changes) and touched
    assert store.apply(df.limit(0)) == []
    assert rows(store.current()) == files_by_hand(changes)


def test_only_touched_buckets_are_rewritten(spark):
    store = feed.BucketedTable(spark, scratch_path(spark, "test"), buckets=16)
    store.apply(spark.createDataFrame([(k, "p", 0, f"/f{k}", 1, False, "s") for k in range(200)], FEED))
    before = store.manifest()[1]
    touched = store.apply(spark.createDataFrame([(900, "p", 0, "/f7", 2, True, None)], FEED))
    after = store.manifest()[1]
    assert len(touched) == 1 and {b for b in after if after[b] != before[b]} == set(touched)
    assert store.current().count() == 199


def test_bucket_count_is_kept(spark):
    path = scratch_path(spark, "test")
    changes = spark.createDataFrame([(k, None if k % 2 else "", 0, f"/f{k // 2}", 1, False, "s") for k in range(40)], FEED)
    feed.BucketedTable(spark, path, buckets=8).apply(changes)
    again = feed.BucketedTable(spark, path)
    assert again.buckets == 8
    again.apply(changes.withColumn("version", F.lit(2).cast("bigint")))
    assert again.current().where("version = 2").count() == 40 == again.current().count()
    with pytest.raises(ValueError):
        feed.BucketedTable(spark, path, buckets=12)
    stale = feed.BucketedTable(spark, path)
    again.resize(16)
    assert feed.BucketedTable(spark, path).buckets == 16 and rows(again.current()) == rows(feed.BucketedTable(spark, path).current())
    with pytest.raises(RuntimeError):
        stale.apply(changes)
    again.apply(changes.withColumn("version", F.lit(3).cast("bigint")).where("change_id < 4"))
    assert again.current().count() == 40 and again.vacuum()
    assert rows(again.current().groupBy("version").count()) == [(2, 36), (3, 4)]


def test_commit_is_refused_to_the_second_writer(spark):
    path = scratch_path(spark, "test")
    a, b = feed.BucketedTable(spark, path, 4), feed.BucketedTable(spark, path, 4)
    a._commit(1, {})
    with pytest.raises(RuntimeError):
        b._commit(1, {})


def test_log_with_null_projects(spark):
    from factloom.operators import versions

    data = [(1, None, 1, "/a", 1, False, "x"), (2, "", 1, "/a", 1, False, "y"), (3, None, 2, "/a", 2, False, "z"), (4, None, 3, "/a", 1, False, "w")]
    df = spark.createDataFrame(data, FEED)
    assert rows(versions.recompute_changed(df, 2).select("project_id", "version")) == rows(feed.decisive_changes(df).select("project_id", "version")) == [("", 1), (None, 2)]
    assert rows(versions.stale_changes(df)) == [(4, None, "/a", 1, 2)]


# snapshots

SOURCES = "project_id string, generation bigint, path string, sha256 string, delivered_at timestamp_ntz"
H = {c: c * 64 for c in "abc"}


def changes_by_hand(deliveries):
    snaps = {}
    for p, g, path, h, t in deliveries:
        if g is None or g < 1 or path is None:
            continue
        path = path.replace("//", "/").replace("/./", "/").replace("\\", "/")
        h = None if h is None else h.lower().removeprefix("sha256:")
        key, new = (p, g, path), (t or dt.datetime.min, h or "")
        if key not in snaps or new > snaps[key]:
            snaps[key] = new
    out = []
    for p in {k[0] for k in snaps}:
        gens = sorted({k[1] for k in snaps if k[0] == p})
        for a, b in zip(gens, gens[1:]):
            old = {k[2]: v[1] for k, v in snaps.items() if k[:2] == (p, a)}
            new = {k[2]: v[1] for k, v in snaps.items() if k[:2] == (p, b)}
            out += [(p, b, x, "added") for x in new.keys() - old.keys()] + [(p, b, x, "removed") for x in old.keys() - new.keys()]
            out += [(p, b, x, "changed") for x in new.keys() & old.keys() if new[x] and old[x] and new[x] != old[x]]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_snapshots(spark, seed):
    rng = random.Random(seed)
    data = []
    for _ in range(300):
        h = rng.choice([None, H["a"], H["b"], "sha256:" + H["a"], "SHA256:" + H["A".lower()].upper(), H["c"]])
        path = rng.choice(["/a/hot", "/a/hot", "/a//hot", "/a/./b", "/c", "\\c", None, f"/f{rng.randrange(6)}"])
        data.append((rng.choice(["p", "p", "q", None]), rng.choice([None, 0, 1, 3, 4, 9]), path, h, at(rng.choice([None, *range(900)]))))
    data += data[:60]
    df = spark.createDataFrame([(*x, "x", 1) for x in data], SOURCES + ", digest string, sign int")
    assert rows(snapshots.snapshot_changes(df)) == changes_by_hand(data)
    assert snapshots.snapshot_changes(df.limit(0)).count() == 0


# nested records


def test_payloads(spark):
    texts = {
        1: '{"calls": [{"target": "a", "arguments": [{"x": 1}, null, {"x": 2}]}, null, {"arguments": {"x": 1}}]}',
        2: '{"calls": {"target": "lone"}, "asyncFunctions": [{"callsAfterAwait": [{"y": 1}]}]}',
        3: '{"calls": null}', 4: "null", 5: "[]", 6: "", 7: '{"calls": [{}', 8: '{"calls": []} x', 9: None, 10: '{"calls": [1, "s", [], {"k": 1}]}',
        11: '{"calls": [{"a": 1}]}]', 12: '{"calls": [{"b": 2}], "calls": [{"a": 1}, {"a": 2}]}',
    }
    df = spark.createDataFrame([(k, t, "x") for k, t in [*texts.items(), (1, texts[1])]], "record_id bigint, payload string, id string")
    got = rows(nested.bridges(nested.file_fact_occurrences(df)).select("child", "record_id", "pos_1", "pos_2"))
    assert got == sorted(
        [
            ("call", 1, 0, -1), ("call", 1, 2, -1), ("call_argument", 1, 0, 0), ("call_argument", 1, 0, 2), ("call_argument", 1, 2, 0),
            ("call", 2, 0, -1), ("async_function", 2, 0, -1), ("call_after_await", 2, 0, 0), ("call", 10, 3, -1), ("call", 12, 0, -1), ("call", 12, 1, -1),
        ], key=repr,
    )


def test_equal_objects_have_one_identity(spark):
    a = '{"calls": [{"target": "t", "arguments": [{"b": 1, "a": {"d": 1, "c": 2}}]}]}'
    b = '{"calls": [{"arguments":[{"a":{"c":2,"d":1},"b":1}],"target":"t"}, {"target": "t", "arguments": [{"b": 2}]}]}'
    seen = nested.file_fact_occurrences(spark.createDataFrame([(1, a), (2, b)], "record_id bigint, payload string"))
    by = {(r.child, r.record_id, r.pos_1): r.id for r in seen.collect()}
    assert by["call", 1, 0] == by["call", 2, 0] != by["call", 2, 1]
    assert by["call_argument", 1, 0] == by["call_argument", 2, 0] != by["call_argument", 2, 1]
    counts = {(r.child, r.n_occurrences) for r in nested.objects(seen).collect()}
    assert ("call", 2) in counts and ("call_argument", 2) in counts


def test_identities_by_hand(spark):
    import hashlib
    import json

    def identity(kind, body, children=None):
        parts = [kind, body] + ([] if children is None else [",".join(children)])
        return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()

    canonical = lambda o: json.dumps(o, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    payload = {"calls": [{"target": "t", "arguments": [{"b": 1, "a": {"d": "é", "c": None}}, None, {"x": []}]}, {"target": "u"}], "asyncFunctions": {"symbol": "s", "callsAfterAwait": {"z": 1.5}}}
    seen = nested.file_fact_occurrences(spark.createDataFrame([(1, json.dumps(payload))], "record_id bigint, payload string"))
    got = {(r.child, r.pos_1, r.pos_2): (r.id, r.parent_id) for r in seen.collect()}
    args = [identity("call_argument", canonical(a)) if a else "null" for a in payload["calls"][0]["arguments"]]
    call, plain = identity("call", canonical({"target": "t"}), args), identity("call", canonical({"target": "u"}), [])
    late = identity("call_after_await", canonical({"z": 1.5}))
    fn = identity("async_function", canonical({"symbol": "s"}), [late])
    assert got == {("call", 0, -1): (call, None), ("call_argument", 0, 0): (args[0], call), ("call_argument", 0, 2): (args[2], call), ("call", 1, -1): (plain, None), ("async_function", 0, -1): (fn, None), ("call_after_await", 0, 0): (late, fn)}


def test_findings_arrays(spark):
    loc = "struct<path string, start_byte bigint>"
    schema = f"record_id bigint, evidence array<struct<message string, location {loc}>>, fixes array<struct<message string, applicability string, edits array<struct<location {loc}, new_text string>>>>"
    data = [(1, [("m", ("p", 1)), None, ("n", None)], [("f", None, [None, (("p", 2), "x")]), None, (None, None, None)]), (2, [], None), (3, None, [("g", "safe", [])])]
    df = spark.createDataFrame(data + data[:1], schema)
    got = rows(nested.finding_occurrences(df).select("child", "record_id", "pos_1", "pos_2"))
    assert got == sorted([("evidence", 1, 0, -1), ("evidence", 1, 2, -1), ("fix", 1, 0, -1), ("edit", 1, 0, 1), ("fix", 1, 2, -1), ("fix", 3, 0, -1)], key=repr)


# hierarchies


def tree_by_hand(nodes, parent):
    out = {}
    for n in nodes:
        path, seen = [n], {n}
        while path[-1] in parent and parent[path[-1]] not in seen:
            path.append(parent[path[-1]])
            seen.add(path[-1])
        endless = path[-1] in parent
        out[n] = (None, None, True) if endless else (path[-1], len(path) - 1, False, path)
    return out


@pytest.mark.parametrize("seed", range(1))
def test_hierarchy(spark, seed):
    rng = random.Random(seed)
    n = 150
    parent = {k: k + 1 for k in range(60) if k != 59}  # a long chain
    parent |= {k: rng.randrange(n) for k in range(60, n) if rng.random() < 0.8}
    parent |= {70: 71, 71: 72, 72: 70, 80: 80, 90: 91, 91: 90}
    parent |= {k: 5 for k in range(100, 130)}  # a hot parent
    nodes = spark.range(n).selectExpr("id as node")
    edges = spark.createDataFrame(list(parent.items()), "child bigint, parent bigint")
    tree = hierarchy.hierarchy(nodes, edges)
    got = {r.node: (r.root, r.depth, r.endless, *([] if r.endless else [r.path])) for r in tree.collect()}
    want = tree_by_hand(range(n), parent)
    assert got == want
    assert {r.node for r in hierarchy.endless_nodes(edges).collect()} == {k for k, v in want.items() if v[2]}
    pairs = {(r.ancestor, r.descendant, r.distance) for r in hierarchy.descendants(tree).collect()}
    assert pairs == {(v[3][i], k, i) for k, v in want.items() if not v[2] for i in range(1, len(v[3]))}


def test_hierarchy_without_edges(spark):
    nodes = spark.range(3).selectExpr("id as node")
    none = spark.createDataFrame([], "child bigint, parent bigint")
    assert hierarchy.hierarchy(nodes, none).where("depth = 0 and not endless and root = node").count() == 3
    assert hierarchy.endless_nodes(none).count() == 0
    assert hierarchy.hierarchy(nodes.limit(0), none).count() == 0


def test_current_symbols(spark):
    data = [
        (1, "p", "a", "b", at(1), None), (2, "p", "a", None, at(2), None), (2, "p", "a", None, at(2), None), (3, "p", "b", "b", at(1), None), (4, "q", "b", "a", at(1), None),
        (5, "p", "c", "b", at(1), at(9)), (6, "p", "d", "c", at(3), None), (7, "p", "e", "", at(3), None), (8, None, "n", "n", at(1), None), (9, "p", None, "b", at(1), None), (10, "p", "f", "b", None, None),
    ]
    current = hierarchy.current_symbols(spark.createDataFrame([(*x, 0) for x in data], SYMBOLS + ", gone int"))
    assert {r.node for r in current.collect()} == {2, 3, 4, 6, 7, 8, 10}
    assert rows(hierarchy.alias_edges(current)) == [(10, 3), (3, 3), (8, 8)]
