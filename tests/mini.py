"""A tiny scanner that makes fact tables from small programs, for tests of the analysis only."""

from __future__ import annotations

import re

from factloom.operators.analysis import Facts

AT = "project_id string, path string"
SCHEMAS = {
    "calls": f"{AT}, start bigint, `end` bigint, callee_start bigint, callee_end bigint, callee_text string",
    "call_args": f"{AT}, call_start bigint, call_end bigint, pos int, start bigint, `end` bigint, value string",
    "functions": f"{AT}, start bigint, `end` bigint, body_start bigint, body_end bigint, name string, name_start bigint, name_end bigint, exported boolean, is_async boolean, ord bigint",
    "binding_names": f"{AT}, init_start bigint, init_end bigint, name string, start bigint, `end` bigint, array_slot int",
    "entities": f"{AT}, start_byte bigint, end_byte bigint, symbol string, type_text string",
    "symbols": "project_id string, id string, alias_target string, name string, decl_path string",
    "regions": f"{AT}, group string, start bigint, `end` bigint, label string",
    "returns": f"{AT}, start bigint, `end` bigint, value string, type_text string, control_tests array<struct<start bigint, `end` bigint>>",
    "imports": f"{AT}, module string, imported string, start bigint",
    "elements": f"{AT}, start bigint, `end` bigint, name_start bigint, name_end bigint",
    "after_await": f"{AT}, start bigint, `end` bigint",
    "params": f"{AT}, fn_start bigint, fn_end bigint, pos int, shape string, start bigint, `end` bigint",
}
OPEN, CLOSE = "([{", ")]}"


def close_of(text, at):
    """Index after the bracket that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] in OPEN) - (text[i] in CLOSE)
        if depth == 0:
            return i + 1
    raise ValueError("unbalanced")


def end_of_expression(text, at):
    i = at
    while i < len(text) and text[i] not in ",;)]}\n":
        i = close_of(text, i) if text[i] in OPEN else i + 1
    return i


def value_of(text):
    t = text.strip()
    if re.match(r"async\b.*=>", t, re.S):
        return "async-function"
    if re.match(r"(\([^)]*\)|\w+)\s*=>|function\b", t):
        return "function"
    if t == "undefined":
        return "undefined"
    if "sync: true" in t:
        return "sync-options"
    return "identifier" if re.fullmatch(r"[A-Za-z_$]\w*", t) else "other"


def facts(spark, files, tracked=(), events=(), directives=(), markup=()):
    """files: path to text. The others list texts whose every occurrence is a region of that kind."""
    rows = {k: [] for k in SCHEMAS}
    p = "p"
    for path, text in files.items():
        imported = set()
        for m in re.finditer(r"import \{([^}]*)\} from \"([^\"]+)\"", text):
            for name in m[1].split(","):
                rows["imports"].append((p, path, m[2], name.strip(), m.start()))
                if m[2] == "solid-js":
                    imported.add(name.strip())
        for name in imported:
            rows["symbols"] += [(p, f"{path}:{name}", f"lib:{name}", name, path), (p, f"lib:{name}", None, name, "/w/node_modules/solid-js/types.d.ts")]
        sym = lambda name: f"{path}:{name}" if name in imported else name  # noqa: E731, B023
        for m in re.finditer(r"[A-Za-z_$]\w*", text):
            rows["entities"].append((p, path, m.start(), m.end(), sym(m[0]), None))
        for m in re.finditer(r"(?<![\w.])([a-zA-Z_]\w*)(?=\()", text):
            if m[1] in ("function", "if", "return") or re.search(r"function\s+$", text[: m.start()]):
                continue
            end = close_of(text, m.end())
            rows["calls"].append((p, path, m.start(), end, m.start(), m.end(), m[1]))
            at, pos = m.end() + 1, 0
            while at < end - 1:
                stop = end_of_expression(text, at)
                part = text[at:stop]
                if part.strip():
                    lead = len(part) - len(part.lstrip())
                    rows["call_args"].append((p, path, m.start(), end, pos, at + lead, at + len(part.rstrip()), value_of(part)))
                    pos += 1
                at = stop + 1
        order = 0
        for m in re.finditer(r"(export )?function (\w+)\(", text):
            body = text.index("{", close_of(text, m.end() - 1))
            order += 1
            start = m.start() + len(m[1] or "")
            rows["functions"].append((p, path, start, close_of(text, body), body, close_of(text, body), m[2], m.start(2), m.end(2), bool(m[1]), False, order))
        for m in re.finditer(r"(async )?\([^()]*\)\s*=>\s*", text):
            end = close_of(text, m.end()) if text[m.end()] == "{" else end_of_expression(text, m.end())
            order += 1
            rows["functions"].append((p, path, m.start(), end, m.end(), end, None, None, None, False, bool(m[1]), 1000 + order))
            if text[m.end()] != "{":
                rows["returns"].append((p, path, m.end(), end, value_of(text[m.end() : end]), None, []))
        for m in re.finditer(r"return ([^;]+);", text):
            guard = re.search(r"if \(([^{}]*)\)\s*$", text[: m.start()])
            tests = [(guard.start(1), guard.end(1))] if guard else []
            rows["returns"].append((p, path, m.start(1), m.end(1), value_of(m[1]), None, tests))
        for m in re.finditer(r"const (\[([^\]]*)\]|(\w+)) = ", text):
            end = end_of_expression(text, m.end())
            if m[3]:
                rows["binding_names"].append((p, path, m.end(), end, m[3], m.start(3), m.end(3), None))
            else:
                for slot, n in enumerate(re.finditer(r"\w+", m[2])):
                    rows["binding_names"].append((p, path, m.end(), end, n[0], m.start(2) + n.start(), m.start(2) + n.end(), slot))
        for m in re.finditer(r"<(\w+)[^>]*>[^<]*</\1>", text):
            rows["elements"].append((p, path, m.start(), m.end(), m.start(1), m.end(1)))
        for m in re.finditer(r"await (\w+\(\)); (\w+\(\))", text):
            rows["after_await"].append((p, path, m.start(2), m.end(2)))
        for f in [r for r in rows["functions"] if r[1] == path]:
            if m := re.compile(r"[^(]*\((\{[^}]*\})").match(text, f[2], f[4]):
                rows["params"].append((p, path, f[2], f[3], 0, "object", m.start(1), m.end(1)))
        for group, label, listed in (("trackedRegions", "jsx", tracked), ("callbackRoles", "event-handler", events), ("callbackRoles", "directive-apply", directives), ("jsxOperations", "jsx-expression", markup)):
            for piece in listed:
                for m in re.finditer(re.escape(piece), text):
                    rows["regions"].append((p, path, group, m.start(), m.end(), label))
    names = {r[4] for r in rows["entities"]} - {r[1] for r in rows["symbols"]}
    rows["symbols"] += [(p, n, None, n, "/src") for n in sorted(names)]
    return Facts(spark, **{k: spark.createDataFrame(rows[k], s) for k, s in SCHEMAS.items()})
