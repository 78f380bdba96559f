"""Parsing by derivatives: programs in and out of each language, failing tokens, truncation."""

import ast
import json
import random

import pytest

pytest.importorskip("factloom.llm")
from factloom.llm.derivatives import Grammar
from factloom.llm.parsing import regex_is_sound, verdict

VALID = {
    "typescript": [
        "", "#!/usr/bin/env node\nlet a = 1", "﻿import a from 'b'", "import type { A, type B as C } from './x'; import D, * as E from \"y\"; import 'z'",
        "export * from 'a'; export * as b from 'b'; export { c as default, type d }; export default class {}", "export default async function () {}\nexport default interface A {}",
        "const f = <T,>(x: T): T => x; const g = async <T extends object = {}>(x: T) => { await x }", "let x = <any>y; let z = y as unknown as string[]; let w = y!.a!.b![0] satisfies number",
        "a < b > (c); f<number>(1); new Map<string, Array<number>>(); x = a < b && c > d; y = a >> b >>> c; z >>= 2; q >= r",
        "function f(this: Window, a?: number, ...rest: string[]): asserts a is number { return }", "function over(a: string): void\nfunction over(a: number): void\nfunction over(a: any) {}",
        "abstract class A<T> extends B<T> implements C, D { private readonly x: number = 1; static #y?: string; declare z; constructor(public a: number, protected b?) { super() } get p() { return 1 } set p(v) {} abstract m(): void; [k: string]: any; async *gen() {} static { this.#y = '' } 'quoted'() {} [Symbol.iterator]() {} }",
        "@dec() export class A { @input() name!: string; @out m(@param x) {} }", "enum E { A, B = 1 << 2, 'c' = `x` } declare const enum F { A }",
        "type A<T> = T extends (infer U)[] ? U : never; type M = { readonly [K in keyof T as `x${K}`]?: T[K] }; type N = { -readonly [K in T]-?: T[K] }",
        "type F = (a: number, b?: string) => void; type G = new (...a: any[]) => object; type H = abstract new () => void; type U = | 'a' | 'b' | -1; type T = [a: number, b?: string, ...c: boolean[]]",
        "type P = typeof import('x'); type I = import('y').Z<number>; type K = keyof typeof obj; type Idx = A['b'][number]; let u: unique symbol",
        "interface A extends B, C<D> { (x: number): string; new (x): A; readonly a: string; b?(): void, c: number\n d: any; get e(): number; [k: string]: unknown }",
        "declare module 'x' { export const a: number; export function f(): void; export default a }\ndeclare global { interface Window { a: 1 } var b: any }\nnamespace A.B { export const c = 1 }",
        "for (const a of b) ; for (let i = 0, n = 1; i < n; i++) {} for (;;) break; for (x in y) z; for await (const q of r) {} while (1) do x(); while (y)\nlabel: for (;;) continue label",
        "switch (a) { case 1: case 2: { break } default: x }", "try { a } catch { b } finally { c }", "if (a) b; else if (c) d; else { e }", "a = b ? (c) : d => e; f = a ? (b, c) : (d)",
        "x\n++y\nvar z = a\n(b)\nlet t = `a${b ? `c${d}` : {e: 1}.e}f`", "a = /[/\\]]+/g.test(b) / 2 / c; if (a) /re/.exec(b); ({}) / 1; x = {} / 1; [] / 1", "a?.b?.[c]?.(d) ?? e; x = y ? .5 : 1; a ||= b; a **= 2; c = 1_000n + 0xFFn + .5e-3",
        "({ a, b: c, [d]: e, get f() { return 1 }, set f(v) {}, async *g() {}, async h() {}, ...i, 'j': 1, 2: 3, if: 4, async: 1, get: 2 })", "let { a, b: { c = 1 }, ...d } = e, [f, , g = 2, ...h] = i; ({ a = 1 } = b); [x, y] = [y, x]",
        "async () => { for await (const x of y) await z }; async x => x; (async function* () { yield* a; yield })()", "let type = 1, of = 2, async = 3, from = 4, as = 5; type = of; async(of); get = set", "import a = require('b'); export = a; export as namespace Z; import x = A.B.C",
        "// }\n/* ` ( */ const s = '\\'}' + \"\\\"{\" ", "const a = 'x'\u2028const b = 1", "let v = <const>['a']; let o = { m<T>(x: T) { return x } }", "label: { break label }", "const \\u0061b = 1; let größe = $_", "export type { A } from './a'; export declare const b: number; export abstract class C {}",
        "function f<const T, in out U>(x: T) {}", "let a = b as const, c = d as any as E<F>", "if (a < b) { c > (d) }", "const x = y < z ? 1 : 2", "var f = function g(): number { return 1 }", "let fn: (a: number) => (b: string) => void = null!", "class A { x = 1\n y = 2\n static async = 3; get; set; static }", "import x from './d.json' with { type: 'json' }", "do x++; while (x < 5) y()",
    ],
    "tsx": [
        "const a = <div class=\"x\" {...p} on:click={f} data-x='y' b>text's &amp; {/* c */} {x} <b/> <></></div>;", "const f = <T,>(x: T) => <A<T> x={x} />; const g = <T extends B>(x: T) => x", "x = a < b; y = <A.B.C/>; z = cond ? <p>no; semicolons = \"here\"</p> : null",
        "function C() { return (<Show when={a() > 1} fallback={<span>closed</span>}>{(r) => <li>{r}</li>}</Show>) }", "let t = <p>\n  // not a comment `\n</p>", "<style>{`a { b: c }`}</style>; let v = x as any", "const e = <input type=\"text\" value={a()} disabled />",
    ],
    "javascript": ["const a = 1; export { a }", "class A { #x = 1; static y = 2; m() { return #x in this } }", "let a = b < c > (d)", "export default () => {}", "var x = a ? b : c, type = 2; interface_ = 1", "import('x').then(({ default: d }) => d)", "x = y\n/re/g.z"],
    "jsx": ["export const A = (p) => <ul {...p}>{p.rows.map((r) => <li key={r}>{r}</li>)}</ul>;"],
    "json": ['{"a": [1, -2.5e+3, true, null, "\\u00e9\\n"], "b": {}}', " 1 ", '"x"', "[]"],
    "python": [
        "", "x = 1\n", "def f(a, /, b: int = 2, *args, c, **kw) -> int:\n    return a if b else -c\n", "class A(B, metaclass=M):\n    x: int = 1\n\n    @property\n    def y(self): return self.x\n", "f'{x!r:>{w}} {y=} {{}}' \"a\" 'b'\n", "with open(a) as f, b: pass\nwith (a as b, c as d,):\n    pass\n",
        "match x:\n    case {'a': [1, *rest], **kw} if y: pass\n    case A.B | C(d=1, e=_) as f:\n        pass\n    case _: pass\n", "try:\n    a\nexcept* (B, C) as e:\n    raise D from e\nelse:\n    b\nfinally:\n    c\n", "async def f():\n    async with a as b: await c\n    return [x async for x in y if x]\n",
        "x = {**a, 'b': 1, **c}; y = {1, *z}; w = [i for j in k for i in j if i if j]\n", "a, *b = c = d; a += 1; del a, b[0]; x[1:2, ..., ::3] = lambda x, *y, z=1: x\n", "if (n := len(a)) > 10: print(n)\nelif not a in b and c is not d: pass\n", "type X[T: int, *U] = list[T]\ndef f[T](x: T): ...\n", "from . import a\nfrom ..b.c import (d as e, f,)\nimport g.h as i, j\n", "print(*a, sep='', **k)\nx = a @ b // c ** -d\n", "global_ = 1\nmatch = 2\nmatch.x(case)\n", "while 1:\n\tif x:\n\t\tbreak\n\telse:\n\t\tcontinue\n", "x = '''\n<<<<<<< ours\n'''\n",
    ],
}

INVALID = {
    "typescript": ["const", "const a", "const a: number", "let {a}", "{\"name\": \"x\"}", "return <div></div>", "def f(x):\n    return x", "<<<<<<< HEAD\nlet a = 1\n=======\n>>>>>>> b", "function f() {", "a b", "let a = ;", "if (a", "'abc", "`abc ${d", "/* open", "class { }", "import { a from 'b'", ".a { b: c }", "name: x y", "# notes", "x = {a: 1", "}", "for (const a of) {}", "<!DOCTYPE html>", "let a = 1 2", "let 1a = 2"],
    "tsx": ["<a>", "<a></b", "const x = <any>y;", "<p>}</p>", "<p a=>x</p>", "return (<div>{x}</div>", "<a b={}/>"],
    "javascript": ["let a: number = 1", "interface A {}", "type A = string", "function f(a: number) {}", "enum A { B }", "a as b", "const x = <div/>", "class A { private x = 1 }", "export const f = (a: any[] = []) => a", "import type { A } from 'b'"],
    "jsx": ["const a: number = <p/>", "<p>"],
    "json": ["", "{'a': 1}", "[1,]", "{\"a\": 1,}", "NaN", "01", "// c\n{}", "{\"a\": \"\n\"}", "[1", "\ufeff{}", "{\"a\" 1}", "[1] x", "{a: 1}", "\"\\x\""],
    "python": ["def f(:\n    pass\n", "x = (1,\n", "if x:\n", "  x = 1\n", "print 'a'\n", "<<<<<<< HEAD\n", "const a = 1;\n", "class A { }\n", "x = '''abc", "for x y:\n    pass\n", "def f():\nreturn 1\n", "import { a } from 'b'\n", "a = b c\n"],
}


@pytest.mark.parametrize("language", sorted(VALID))
def test_valid(language):
    wrong = [(t, verdict(t, language)) for t in VALID[language] if not verdict(t, language).valid]
    assert not wrong


@pytest.mark.parametrize("language", sorted(INVALID))
def test_invalid(language):
    assert [t for t in INVALID[language] if verdict(t, language).valid] == []


#: What a grammar without places, precedence or targets would let pass, and what comes close to it.
NOT_THERE = {
    "javascript": [
        'a ?? b || c', '-1 ** 2', 'return 1', 'function f() { await x }', '1 = 2', '/(/', '({a = 1})', 'f() = 1', 'a + b = c', 'await x ** 2', 'x = /a/gg', '/*/x', '(() => { await f() })',
        '1++', 'for (f() of x) {}',
    ],
    'jsx': [
        'x = <a></b>', 'x = <a><b></a></b>', 'x = <></a>',
    ],
    'tsx': [
        'x = <a.b></a.c>', 'const y = <T extends>(a: T) => a', 'return 3', 'function g(): void { await 3 }',
    ],
    'typescript': [
        'a && b ?? c', 'let x: number = return 1',
    ],
    'python': [
        'f() = 1', 'f() += 1', 'for f() in x: pass', 'del f()', '(a + b) = 3', 'x = (1 := 2)', '1 = x', 'a + 1 = 2',
    ],
}
THERE = {
    "javascript": [
        '(a ?? b) || c', 'a ?? b ?? c', '(-1) ** 2', '2 ** -1', '2 ** 3 ** 2', 'async function f() { await x; return 1 }', 'await x',
        'function f() { return async () => { await 1; return 2 } }', '[a, b] = [b, a]', '({a = 1} = x)', '({a, b: c.d, ...e} = x)', 'using r = f()', 'await using x = y', 'x = a\n/b/g',
        'for (const x of /a(b|c)+?/g.exec(s)) {}', '/[(]/', '/\\(/.test(x)', '/(?<n>a)\\k<n>/u', 'a.b[c].d = 1', 'x++', '++a.b', 'for (x.y of z) {}', 'for ([a,b] of z) {}',
        'for ({a = 1} of z) ;', 'class A { static { this.x = 1 } x = () => { return 3 }; async m() { for await (const a of b) {} } }', 'a ||= b', 'a ??= b && c', 'new X().y = 2', '(a) = 1',
        'export default async () => { await 1 }', 'x = async x => await x', 'x = async (a, b = 2) => await x', 'if (a) b; else c', 'async () => {}', 'using = 3', 'let async; async = 3',
        'x = { async a() { await 1 }, *g() { yield 1 }, get b() { return 1 } }', 'import x, { y as z } from "a"', '`a${b}c${`d`}`', 'a = b ? c : d ? e : f',
        'label: for (;;) { continue label }', 'x = a < b', 'x = a > b && c',
    ],
    'jsx': [
        'x = <a></a>', 'x = <a.b c={<d/>} {...e}>t {f(<g></g>)} <h /></a.b>', 'x = <></>', 'x = <a b={x < y}>{z > 1 ? <i>1</i> : null}</a>', 'x = <a>{`x${<b></b>}`}</a>',
        'x = cond && <div><A/><B></B></div>', 'x = <a-b:c></a-b:c>', 'x = <a onClick={() => { if (a < b) { return <i/> } }}></a>', 'x = <a>{/* c */}</a>',
    ],
    'tsx': [
        'const f = <T,>(a: T) => a', 'const g = <T extends U>(a: T): Array<Map<K, V>> => <Foo<Bar<X>> a="1">t</Foo>', 'x = <a></a>', 'const y = (a as B).c = 3', 'x! += 2',
        'let z = a < b && c > d', 'const h = async <T,>(a: T): Promise<void> => { await a; return }', 'foo<A>(b)', 'x = <For each={xs()}>{(i) => <li>{i < 3}</li>}</For>',
    ],
    'typescript': [
        'type A<T> = T extends (infer U extends string)[] ? U : never', 'type B<T> = T extends infer U ? U : 1', 'using r = f()', 'await using x = y',
        'abstract class A { abstract m(): void; private async *g(): AsyncGenerator<number> { yield 1; await 2 } constructor(private x = 1) { super() } }', 'const x = <number>y',
        '(<any>x).y = 1', '(x as any) = 1', 'let v = a as B ?? c', 'declare function f(a: number): void', 'enum E { A = 1 << 2, B }', 'function f(this: X, a?: number): asserts a is 3 {}',
        'namespace N { export const a = 1 }',
    ],
    'python': [
        'a, *b = c', '(a, b) = [c, d] = e', 'x: int = 3', 'a.b[c] += 1', 'for a, (b, c) in d: pass', 'with a as (b, c), d as e.f: pass', 'del a[0], b.c', 'if (n := f()) > 3: pass',
        '[x for x, y in z if (k := x)]', 'x = y = yield', 'def f(): \n  a = yield b\n  return a', 'print(*a, **b)', '(a).b = 1', 'f(x)[0] = 2', 'f(x).y = 2', 'lambda: (yield)',
        'async def f():\n  async for x in y: await x', 'match a:\n  case [1, *b]: pass', 'x = *a, b', 'for x in *a, b: pass',
    ],
}


def test_places_precedence_and_targets():
    assert [(k, t) for k, texts in NOT_THERE.items() for t in texts if verdict(t, k).valid] == []
    assert [(k, t) for k, texts in THERE.items() for t in texts if not verdict(t + "\n", k).valid] == []


def test_regular_expressions():
    sound = ["/a(b|c)+?d{2,}?/gi", "/[(]/", r"/\(/", "/(?<n>a)(?:b)(?=c)(?!d)(?<=e)(?<!f)/u", "/a{,3}/", "/(?i:a)/"]
    assert [t for t in sound if not regex_is_sound(t)] == []
    assert [t for t in ["/(/", "/)/", "/a/gg", "/*a/", "/a/q", "/(?a)/", "/a|*/"] if regex_is_sound(t)] == []


def test_failing_token_and_truncation():
    v = verdict("let a = 1;\nlet b = ) ;", "typescript")
    assert (v.failure, v.offset, v.token) == ("token", 19, ")")
    v = verdict("function f() {\n  g(1, ", "javascript")
    assert v.failure == "truncated" and v.offset == 22
    assert verdict("[1, 2", "json").failure == "truncated"
    assert verdict("def f(a,\n", "python").failure == "truncated"
    assert verdict("x = `a ${b", "typescript").failure == "truncated"


def test_long_and_deep_texts():
    assert verdict("let a = 1;\n" * 20_000, "typescript").valid
    assert verdict("[" * 400 + "]" * 400, "json").valid
    assert verdict("f(" * 300 + ")" * 300, "typescript").valid
    assert not verdict("f(" * 300 + ")" * 299, "typescript").valid


def test_any_depth_and_a_table_that_starts_anew(monkeypatch):
    for text, language in (("[" * 30_000 + "]" * 30_000, "json"), ("x = " + "(" * 2_000 + "1" + ")" * 2_000, "typescript"), ("let a = " + "[" * 900 + "{b: " * 600 + "1" + "}" * 600 + "]" * 900, "javascript")):
        assert verdict(text, language).valid and not verdict(text[:-1], language).valid
    from factloom.llm import derivatives, parsing

    monkeypatch.setattr(derivatives, "MOST_LANGUAGES", 300)
    parsing.grammar("typescript").reset()
    text = "\n".join(f"export const f{k} = async <T,>(a: T[] = [], {{ b, c: [d] }}: any) => {{ if (a < b && c > d) {{ for (const x of y) await z`q${{x ?? 1}}` }} return a?.b! }}" for k in range(300))
    assert verdict(text, "typescript").valid and not verdict(text + " )", "typescript").valid
    assert len(parsing.grammar("typescript")._languages) < 3000
    parsing.grammar("typescript").reset()


def test_json_against_the_standard_library():
    rng = random.Random(3)
    alphabet = ["{", "}", "[", "]", ",", ":", '"a"', "1", "-0.5", "true", "null", " "]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9)))
        try:
            json.loads(text)
            ok = True
        except ValueError:
            ok = False
        assert verdict(text, "json").valid == ok, text


def test_python_against_the_standard_library():
    rng = random.Random(4)
    alphabet = ["x", "1", "(", ")", "[", "]", "=", "+", " if ", " else ", "lambda:", ",", ":", "not ", "*", "for x in y", ".", "'s'", "\n"]
    from factloom.llm.parsing import _python

    refused = 0
    for _ in range(6000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 8))) + "\n"
        try:
            ast.parse(text)
        except (SyntaxError, ValueError):
            continue
        refused += not _python(text).valid
    assert refused == 0


def test_ambiguous_grammar_stays_small():
    g = Grammar("s = 'a' | s2\ns2 = 'a' s | 'a' s s", "s")
    lang = g.start
    for _ in range(60):
        lang = g.derive(lang, "a")
    assert g.nullable(lang) and len(g._languages) < 2000
    assert g.derive(lang, "b") is g.empty


def test_verdicts_of_odd_rows(spark):
    from factloom.llm import sources

    data = [(1, "p", "/a.ts", "let a"), (1, "p", "/a.ts", "let a"), (2, "p", "/b.TS", "let ("), (3, None, None, "x"), (4, "p", "/c.py", None), (5, "p", "/d", "x"), (6, "p", "/e.json", ""), (7, None, "\\f.jSx", "<a/>"), (None, "p", "/g.css", "a {}"), (8, "p", "/x.d.ts", "declare const a: number")]
    df = spark.createDataFrame([(*x, "v", 1) for x in data], "file_id bigint, project_id string, path string, source string, language string, valid int")
    got = sorted((r.file_id, r.valid) for r in sources.verdicts(df).distinct().collect())
    assert got == [(1, True), (2, False), (6, False), (7, True), (8, True)]
    rates = {(r.project_id, r.language): (r.n_files, r.n_invalid) for r in sources.invalid_rates(sources.verdicts(df)).collect()}
    assert rates == {("p", "typescript"): (3, 1), ("p", "json"): (1, 1), (None, "jsx"): (1, 0)}
    assert sources.verdicts(df.limit(0)).count() == 0
