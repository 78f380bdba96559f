"""Queries over whole tables and texts, against brute force."""

import datetime
import hashlib
import inspect

import pytest
from compare import differences

from factloom.operators import feed, fixpoint
from factloom.plans import engine, records


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_multiplicity_has_no_bound(spark, tmp_path):
    lines = [(1, 1, 50.0), (1, 2, 7.0), (2, 1, 1.0), (3, 1, 0.0), (4, 1, None)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = sorted([(o, n, c) for o, n, q in lines for c in range(1, int(q or 0) + 1)], key=repr)
    assert rows(engine.QUERIES["multiplicity_expand"](spark, str(tmp_path))) == want


def test_domain_join_sees_every_generation(spark, tmp_path):
    h = lambda s: "sha256:" + hashlib.sha256(s.encode()).hexdigest()
    files = [(1, "p", "/a", "a", 2), (2, "p", "/b", "b", 3), (3, "p", "/c", "c", 5), (4, "p", "/d", "d", 2), (5, "p", "/e", "e", 2), (6, "p", "/f", "f", None), (7, "p", "/g", "g", 4), (8, "p", "/h", "h", 2)]
    spark.createDataFrame(files, "file_id bigint, project_id string, path string, source string, generation bigint").write.parquet(str(tmp_path / "source_files.parquet"))
    early, late = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2)
    sources = [
        ("p", 2, "/a", h("a").upper(), early), ("p", 5, "/a", h("x"), late), ("p", 3, "//b", h("old"), early), ("p", 3, "/b", h("b"), late), ("p", 4, "/c", h("c"), early), ("p", 1, "/c", h("x"), late),
        ("p", 2, "/d", h("x"), late), ("p", 2, "/d", h("d"), None), ("p", 2, "/e", h("e"), early), ("p", 2, "/e", h("x"), early), ("p", 6, "/f", h("f"), early), ("p", None, "/g", h("g"), early),
    ]
    spark.createDataFrame(sources, "project_id string, generation bigint, path string, sha256 string, delivered_at timestamp_ntz").write.parquet(str(tmp_path / "sources.parquet"))
    got = {r.path: r.problem for r in engine.QUERIES["domain_join"](spark, str(tmp_path)).collect()}
    assert got == {"/a": None, "/b": None, "/c": "digests generation", "/d": "digests hash", "/e": "digests repeated", "/f": "digests generation", "/g": "digests generation", "/h": "digests missing"}
    assert differences(spark, str(tmp_path), "domain_join", engine.QUERIES["domain_join"], engine.SQL["domain_join"]) == ""


def place(t, offset):
    """Line and UTF-16 column by brute force."""
    raw = t.encode()
    at = max(0, min(offset, len(raw)))
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    before = raw[:at].decode()
    return before.count("\n") + 1, len(before.rsplit("\n", 1)[-1].encode("utf-16-le")) // 2 + 1


TEXTS = ["aé日😀\nz\n\nÄ😀b\r\nlast", "plain\nlines\n", "日本\n" * 40 + "😀", "", "\n"]


def test_findings_are_located_in_all_files(spark, tmp_path):
    files = [(k, "p", f"/d//f{k}", t) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(files, "file_id bigint, project_id string, path string, source string").write.parquet(str(tmp_path / "source_files.parquet"))
    at = [(f"/d/f{k}", b) for k, t in enumerate(TEXTS) for b in range(len(t.encode()) + 3)]
    found = [("p", (path, b)) for path, b in [*at, *at[:5], ("/none", 3)]] + [("p", None)]
    spark.createDataFrame(found, "project_id string, primary_location struct<path string, start_byte bigint>").write.parquet(str(tmp_path / "findings.parquet"))
    want = [("p", path, b, *place(TEXTS[int(path[-1])], b)) for path, b in at] + [("p", "/none", 3, None, None)]
    assert rows(engine.QUERIES["finding_lines"](spark, str(tmp_path))) == sorted(want, key=repr)
    assert differences(spark, str(tmp_path), "finding_lines", engine.QUERIES["finding_lines"], engine.SQL["finding_lines"]) == ""


def test_byte_functions_over_whole_texts(spark, tmp_path):
    docs = list(enumerate([*TEXTS, None]))
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    places, slices, edited = set(), set(), []
    for k, t in docs:
        if t is None:
            edited.append((k, None))
            continue
        raw, starts = t.encode(), [0]
        for line in t.split("\n")[:-1]:
            starts.append(starts[-1] + len(line.encode()) + 1)
        n = len(raw)
        places |= {(k, b, *place(t, b)) for b in [*starts, n // 2, n, n + 1]}
        for a, b in [*((s, s + len(x.encode())) for s, x in zip(starts, t.split("\n"))), (n // 2, n // 2 + 9), (0, n), (n, n + 1)]:
            cut = b > n or any(i < n and raw[i] & 0xC0 == 0x80 for i in (a, b))
            slices.add((k, a, b, None if cut else raw[a:b].decode()))
        edited.append((k, "\n".join(f"<{i}>{x[len(x) // 2 :]}" for i, x in enumerate(t.split("\n")))))
    for name, want in {"line_col": places, "byte_slice": slices, "apply_edits": edited}.items():
        assert rows(engine.QUERIES[name](spark, str(tmp_path))) == sorted(want, key=repr), name
        assert differences(spark, str(tmp_path), name, engine.QUERIES[name], engine.SQL[name]) == "", name


def test_closures_end_or_fail(spark):
    chain = spark.createDataFrame([(k, k + 1, None) for k in range(6)], "src bigint, dst bigint, sets int")
    start = spark.createDataFrame([(0, 1)], "node bigint, tag int")
    lattice = lambda n: fixpoint.lattice(start.withColumnRenamed("tag", "context"), chain, **n)
    for closure in (lambda n: fixpoint.spread(start, chain, **n), lattice):
        assert rows(closure({})) == rows(closure({"most_rounds": 7})) == [(k, 1) for k in range(7)]
        with pytest.raises(RuntimeError):
            closure({"most_rounds": 5})
    for f in (fixpoint.spread, fixpoint.lattice):
        assert inspect.signature(f).parameters["most_rounds"].default is None


def test_changes_without_change_id_are_applied(spark, tmp_path):
    schema = "change_id bigint, project_id string, path string, version bigint, deleted boolean, source string"
    data = [(1, "p", "/a", 1, False, "a1"), (9, "p", "/b", 3, False, "b3"), (2, "p", "/c", 5, False, "c5"), (None, "p", "/a", 2, False, "a2"), (None, "p", "/b", 3, False, "late"), (None, "p", "/c", 6, True, None), (None, "p", "/d", 1, False, "d1")]
    data += [(None, "p", "/e", 1, False, x) for x in "xyz"]
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "updates.parquet"))
    got = rows(records.QUERIES["p3_files"](spark, str(tmp_path)))
    assert got[:3] == [("p", "/a", 2, "a2"), ("p", "/b", 3, "b3"), ("p", "/d", 1, "d1")] and [r[:3] for r in got[3:]] == [("p", "/e", 1)]
    assert differences(spark, str(tmp_path), "p3_found", records.QUERIES["p3_found"], records.SQL["p3_found"]) == ""
    turned = feed.decisive_changes(spark.createDataFrame(data[::-1], schema).coalesce(1)).where("path = '/e'").first()
    assert turned.source == got[3][3]
