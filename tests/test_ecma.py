import pytest

from codeloom.functions.ecma import EcmaError, parse

GOOD_JS = [
    "", "// only\n", "#!/usr/bin/env node\nx()", "let a = 1, {b, c: [d = 2]} = f;", "a = b\n++c", "if (a) b; else if (c) {} else d()", "for (const [k, v] of m) { continue }", "for (let i = 0, n = 3; i < n; i++);",
    "for (x in y) ;", "for await (const x of y) {}", "async () => { await x; for await (const q of z) {} }", "const f = async x => await x", "const g = (a, {b}, ...c) => ({a})", "x = a ? (b) : c => d", "label: for (;;) { break label }",
    "class A extends B { #p = 1; static s; static { this.q = 2 } get x() { return this.#p } set x(v) {} async *gen() { yield* a } [k]() {} 'str'() {} constructor() { super() } }",
    "const t = `a${b + `c${d}`}e`; tag`x\\u`", "r = /[/\\]]+/gi.test(s) / 2", "a = b / c / d", "x = a ?? b; y = a?.b?.[c]?.(d)", "new Foo; new Foo.Bar(1)(2)", "import a, {b as c} from 'm'; import * as n from 'n'; import 'side'; export * from 'x'; export {a as default}; export default class {}",
    "export const z = 1", "import('x').then(y)", "import.meta.url", "({a, b, c() {}, get d() { return 1 }, async e() {}, *f() {}, [g]: 1, 'h': 2, ...i})", "({a = 1} = {})", "[a, b] = [b, a]", "switch (a) { case 1: case 2: b; break; default: c }",
    "try { a } catch { b } finally { c }", "do x++; while (x < 5) y()", "var yield_ = 1; let async = 2; async = 3; let of = 1; get = set", "0b11 + 0o7 + 0xf + 1_000n + .5e-3", "a\n/b/g", "x = function* () { const y = yield; }", "if (a) function f() {}", "(function () {})()", "!function(){}()", "x => { return }",
    "while (1) { if (a) break; }", "throw new Error(`x ${y}`)", "void 0, typeof a, delete a.b", "a **= b ** c", "a ||= b; c &&= d; e ??= f", "let [x,,y] = z", "({ async: 1, get: 2, set: 3, static: 4 })", "#!x\n", "const { a: { b }, ...rest } = c",
]
BAD_JS = [
    "const = 4;", "function (", "f(a;", "let a = ;", "}", "{", "'open", "x = “a”", "if (a {", "<<<<<<< ours\na", "class { }", "return 1", "const a;", "a b", "import {a from 'x'", "for (;;", "`open ${a", "/* open", "a => {} => b", "1 = 2", "({a = 1})", "await = x y", "function f() { await x }",
    "let x: number = 1", "interface A {}", "<div/>", "enum A {}", "a ?? b || c", "export default", "def f():\n  pass", "{% if x %}", "new", "case 1:", "try {}", "x = {a b}", "/re/gg", "3in []", "break", "-a ** 2", "async () => { for (x of y }",
]
GOOD_TS = [
    "let x: number = 1 as const as any", "interface A<T = {}> extends B<T>, C { a?: string; readonly [k: string]: number; m<U>(x: U): void; new (x): A; (y): string; get z(): 1 }", "type F<T> = T extends (infer U)[] ? U : never; type M = { readonly [K in keyof T]?: T[K] }",
    "type L = `a${string}b` | 'x' | -1 | [a: string, b?: number, ...rest: T[]] | unique symbol | typeof x.y | import('m').T<string>", "abstract class A<T> extends B<T> implements C, D { private readonly x: number = 1; constructor(public a: string, protected b?: number) { super() } abstract m(): void; declare y: string; static z?: T; m2(this: A): asserts this is B; get g(): number { return 1 } override o() {} [k: string]: any }",
    "function f<T extends object>(this: Window, a: T, b?: number, ...c: string[]): a is string; function f(a) { return a! }", "const g = <T,>(x: T): T => x; const h = async <T>(x: T) => x", "enum E { A = 1, B = 'x'.length } const enum F { C } declare enum G { D }", "namespace N.M { export const a = 1 } declare module 'm' { export default x; } declare global { interface W {} }",
    "import type { A } from 'a'; import { type B, C } from 'b'; export type { D } from 'd'; export type E2 = 1; import fs = require('fs'); export = fs; export as namespace Q", "let y = <any>x; let z = f<string>(x)<number>; a < b; c > d; new Map<string, number[]>()", "@Dec() class K { @Input() a: string; @Out b = 1; m(@P() x) {} }", "declare const x: number, y: string; declare function q(): void",
    "const v = x satisfies Y; for (const a of b as C[]) {}", "let u: A | undefined; let o = a ? (b): c => d : e", "let k: (new () => A) | ((x: string) => void)[]; type G2 = A<B<C<D>>>", "type R = asserts; let type = 1; type = 2; declare; namespace; abstract", "function over(a: string): void\nfunction over(a: number): void\nfunction over(a: any) {}",
    "export default interface Foo {}", "export abstract class X {}", "let f2 = function <T>(x: T) {}", "class Q { m?(): void; p!: string }", "type Fn = (...args: any[]) => asserts x is string", "let a1 = b < c && d > e", "x = y as any as Z<string>[]", "type C2 = A extends B ? C extends D ? 1 : 2 : 3", "let fn: typeof import('x')", "if (a < b) { c }", "type T3 = { a: 1, b: 2 }['a']", "export const enum Z { A }",
]
BAD_TS = ["let x: = 1", "interface { }", "type = ;", "function f(a: ): void {}", "class A { x: }", "let x: string number", "enum { A }", "type A = {", "f(a: string)"]
GOOD_JSX = ["x = <a b='c' d={e} {...f}>text {g} <h.i/> <></> {/* c */}</a>", "const A = () => (<div>\n a &amp; b's\n</div>);", "<A render={() => <b/>} x-y:z=\"q\"/>", "a < b; c = d ? <e/> : null", "f(<a>{x && <b/>}{...y}</a>)"]
BAD_JSX = ["<a>", "<a></b>", "<a b=c/>", "<a>{</a>", "<a>}</a>", "x = <a/><b/>", "<div>a > b</div>"]


@pytest.mark.parametrize("text", GOOD_JS)
def test_good_js(text):
    parse(text)


@pytest.mark.parametrize("text", BAD_JS)
def test_bad_js(text):
    with pytest.raises(EcmaError):
        parse(text)


@pytest.mark.parametrize("text", GOOD_TS)
def test_good_ts(text):
    parse(text, ts=True)


@pytest.mark.parametrize("text", BAD_TS)
def test_bad_ts(text):
    with pytest.raises(EcmaError):
        parse(text, ts=True)


@pytest.mark.parametrize("text", GOOD_JSX)
def test_good_jsx(text):
    parse(text, jsx=True)
    parse(text, jsx=True, ts=True)


@pytest.mark.parametrize("text", BAD_JSX)
def test_bad_jsx(text):
    with pytest.raises(EcmaError):
        parse(text, jsx=True)


def test_tsx_generic_arrow():
    parse("const f = <T,>(x: T) => <div>{x}</div>; const g = <T extends object>(y: T) => y; const h = <A<string> b={1}/>", ts=True, jsx=True)


def test_declarations():
    text = "export function a() {}\nconst b = (x) => { function c() {} };\nclass D { m() {} static async n() {} }\n"
    found = [(d.kind, d.name, d.owner) for d in parse(text)]
    assert ("function", "a", "") in found and ("function", "b", "") in found and ("class", "D", "") in found
    assert ("method", "m", "D") in found and ("method", "n", "D") in found


def test_deep_nesting_ends():
    parse("x = " + "[" * 3000 + "]" * 3000)
    parse("x = " + "(" * 300 + "a" + ")" * 300)
    with pytest.raises(EcmaError):
        parse("x = " + "[" * 3000)
