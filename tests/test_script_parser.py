import pytest

from tallgrass.functions.script_parser import error_of, parse, partial

VALID_JS = [
    "",
    "#!/usr/bin/env node\n'use strict';",
    "import a, { b as c, default as d } from './x.js';\nimport * as e from 'y';\nexport { a as default, c };\nexport * as q from 'z';",
    "const { a, b: [c, ...d], ...e } = f, g = 1;\nlet h\nvar i = 2\n",
    "for (const [k, v] of Object.entries(x)) if (k in y) continue; else break;\nfor (let i = 0, n = 3; i < n; i++) {}\nfor (;;) break",
    "a: for (const x in y) { for (;;) { continue a } }",
    "const r = /[/\\]]+/g.test(x) / 2 / 3; const s = x ? /a/ : b / c;",
    "const t = `a${b + `c${d}`}e`; tag`x${1}`;",
    "class A extends (B, C) { static #x = 1; get y() { return this.#x } set y(v) {} async *z() { yield* q(); await w } static { init() } [k + 1]() {} 'q'() {} 5() {} constructor() { super() } has(o) { return #x in o } }",
    "async function f() { for await (const x of y) await x; return await z }",
    "const f = async (a, { b = 1 } = {}, ...c) => ({ a, b, ...c }), g = x => y => x + y, h = async x => await x;",
    "x ??= y?.[0]?.(1)?.z; a ||= b; c **= d ** -e; delete x.y, void 0; typeof z === 'q';",
    "if (a) b\nelse if (c) d()\nelse { e }\ndo x(); while (y)\nswitch (z) { case 1: case 2: q(); break; default: w() }",
    "try { a() } catch { b() } finally { c() }\nthrow new Error(`x`)",
    "export default function () {}\n",
    "export default class { x = 1 }",
    "const el = <A.B x='1' {...p} y={z}>text {a.map(i => <li key={i}>{i}</li>)} <></> </A.B>;",
    "({ a, b } = c); [a, b] = [b, a]; new Foo; new a.b.C(1).d();",
    "const o = { get: 1, set: 2, async: 3, get x() { return 1 }, async *[y]() {}, 'a-b': 1, 2: 3, if: 4, f() {}, ...r };",
    "label: { break label }\nlet async; async = 1; const of = 2, get = 3; yield_ = of;",
    "x = a\n++b\nvar y = function* () { const z = yield; yield z }",
    "const big = 1_000n + 0xFFn + 0b11 + 0o7 + .5e-3 + 5.;",
]
INVALID_JS = [
    "const x", "const = 1", "let a b", "f(", "{", "}", "class { }", "return 1", "if (a", "`${a`", "'abc\n'", "/abc", "a => { ", "x = = 1", "1 = 2", "f() = 1", "import a from b", "export a", "break",
    "<<<<<<< HEAD\nx", "const a: number = 1", "interface A {}", "<a><b></a>", "<a>}</a>", "for (let i = 0; i < 1; i++", "new", "a ?? b || c", "-1 ** 2", "await_ x", "class A { constructor() {} constructor() {} }",
    "async function f() { await }", "{ import x from 'y' }", "var if = 1", "3in x; 3a", "const t = “x”", "x�y", "throw\n1", "try {}", "switch (a) { default: default: }", "foo(a b)",
]
VALID_TS = [
    "const a: string | undefined = x as any as Foo<Bar<Baz>>; let b!: number;",
    "interface A<T extends object = {}> extends B, C<T> { readonly [k: string]: T; a?(x: number): void; new (x: string): A; (y: T): y is T; get z(): number }",
    "type M<T> = { readonly [K in keyof T as `x${K & string}`]?: T[K] extends infer U extends string ? U[] : never }; type F = new (...a: any[]) => void;",
    "type G = (a: string, b?: number) => asserts a is string; type H = [a: string, b?: number, ...c: boolean[]]; type I = typeof import('x'); type J = -1 | 'a' | `b`;",
    "export abstract class A<T> extends B<T> implements C, D { private readonly x: number = 1; constructor(private y: string, readonly z?: T) { super() } abstract f(): void; declare w: string; static override g<U>(this: A<U>, u: U): u is U { return true } }",
    "enum A { B = 1, C = 'x', D }\nconst enum E { F }\ndeclare module 'x' { export const y: number }\ndeclare global { interface Window { a: 1 } }\nnamespace N.M { export type T = 1 }",
    "function f(a: string): string;\nfunction f(a: any): any { return a }\nfunction g<T,>(this: Window, x: T): asserts x is NonNullable<T> {}",
    "const f = <T,>(x: T): x is T => true, g = async <T>(x: T): Promise<T> => x;\nconst m = new Map<string, Array<number>>(); f<string>(x); a < b > c;",
    "import type { A } from 'a'; import { type B, C } from 'b'; export type { D }; import e = require('e'); export = f;",
    "let x = y!; let z = y!.a![0]; let w = <any>q; const v = a satisfies B; for (const k of m.keys()!) {}",
    "const r = a ? (b) : c => d; const s = a ? (b, c) : d; const t = (a ? b : c) as D;",
    "@Dec() export class A { @Input() x: string; @Out f(@Inject(T) t: T) {} }",
    "abstract class A { abstract x: number; protected abstract get y(): string }\nlet u: unique symbol; let k: keyof typeof x; let c: A.B<C>['d'][];",
    "function isX(v: unknown): v is { a: string } { return typeof v === 'object' && v !== null }",
    "const x = { async f<T>(a: T): Promise<void> {}, get y(): number { return 1 } };",
    "type A = B extends (infer U)[] ? U : B extends (...args: any) => infer R ? R : never;",
]


@pytest.mark.parametrize("text", VALID_JS)
def test_valid_scripts(text):
    assert error_of(text, False, True) is None
    if "<" not in text or "=>" not in text:
        assert error_of(text, True, True) is None


@pytest.mark.parametrize("text", INVALID_JS)
def test_invalid_scripts(text):
    assert error_of(text, False, True) is not None


@pytest.mark.parametrize("text", VALID_TS)
def test_valid_typescript(text):
    assert error_of(text, True, False) is None


@pytest.mark.parametrize("text", ["const a = <p className='x'>y</p>;", "let x: ;", "type A = ", "interface { }", "enum A { b c }", "function f(a: string { }", "class A { x: }"])
def test_invalid_typescript(text):
    assert error_of(text, True, False) is not None


def test_declarations():
    source = "export const A = () => 1;\nconst b = {\n  f() { function g() {} }\n};\nexport class C { m() {} }\ninterface D {}\ntype E = 1;\nfunction* h() {}\n"
    got = [(d.kind, d.name, d.nested, d.arrow) for d in parse(source, True, False)]
    assert got == [
        ("export_statement", None, False, False),
        ("lexical_declaration", "A", False, True),
        ("lexical_declaration", "b", False, False),
        ("method_definition", "f", True, False),
        ("function_declaration", "g", True, False),
        ("export_statement", None, False, False),
        ("class_declaration", "C", False, False),
        ("method_definition", "m", True, False),
        ("interface_declaration", "D", False, False),
        ("type_alias_declaration", "E", False, False),
    ]


def test_broken_text_keeps_what_was_complete():
    assert [d.name for d in partial("function a() {}\nfunction b() {", False)] == ["a"]


def test_deep_nesting_is_reported():
    assert error_of("(" * 50000, False, True) is not None
    assert error_of("x" * 1_000_000, False, True) is None
