"""The recognisers on programs and damaged programs of each language."""

import pytest

from oresieve.llm.grammar.java import parse_java
from oresieve.llm.grammar.scan import Bad
from oresieve.llm.grammar.script import parse_script
from oresieve.llm.unparsable import verdict

JS_GOOD = [
    "", "#!/usr/bin/env node\nlet a = 1", "a\n++b", "for (const [k, v] of m) continue", "for await (const x of y()) {}", "for (let i = 0, n = 2; i < n; i++);", "for (x in o) ;", "x = a ? (b) : c => d", "async (x) => { await x }",
    "`a ${b + `c ${d}`} e`", "a = b / c / d; e = /[/\\]]+/g.test(f)", "if (x) /re/.exec(y)", "class A extends B { static #p = 1; static { this.q = 2 } get [k]() { return 1 } async *gen() { yield* x } 'lit'() {} }",
    "({ a, b: 1, ...c, get d() { return 1 }, async e() {}, [f]: 2, *g() {} })", "var { a = 1, b: { c }, ...rest } = o", "[a, b] = [b, a]", "a ??= b?.c?.[0]?.(1)", "label: for (;;) break label", "export default class {}", "export * as ns from 'x'",
    "import d, { a as b } from 'y'; import * as z from 'z'; import 'q'", "new.target; new Foo; new (foo())(1)", "switch (a) { case 1: break; default: }", "try {} catch {} finally {}", "do x++; while (x < 5) y", "a = function* () { yield 1 }", "0x1F + 0b11 + 1_000n + .5e3", "return_ = 1; let of = 2; async = 3",
    "import('x').then(f)", "x = y => ({})", "if (a) b; else c", "a = b\n(c)", "var yield_ = 1; `\\u{1F600}`",
]
JS_BAD = ["let = ;", "a +", "if (x", "function (a) {}", "return 1", "const x", "a b", "({ a: 1 b: 2 })", "'open", "1 = 2", "class A { foo }; class { }", "let x: number = 1", "<<<<<<< HEAD\na\n=======", "x => { return", "`a ${b", "404: Not Found", "{\"a\": 1}", "await x y", "for (;;", "import { a } 'x'", "a?.b = 1", "<div>a</div>", "3a"]
TS_GOOD = [
    "let x: Array<Map<string, number>> = []", "interface A<T extends B = C> extends D, E<T> { readonly a?: string; [k: string]: any; (x: number): void; new (y): A; m<U>(u: U): u is string }", "type F = (a: number, ...b: string[]) => void | never", "type M = { readonly [K in keyof T]?: T[K] extends infer U ? U : never }",
    "enum E { A = 1, B = 'x' } const enum G { Z }", "abstract class A<T> implements I, J { private constructor(private readonly x: number, public y?: string) { super() } abstract f(): void; declare z: number; w!: string; static async g<T>(this: A, v: T): Promise<T> { return v as any } }",
    "function f(x: string): string; function f(x: any) { return x! }", "const a = <T,>(x: T): T => x; const b = x as unknown as string; const c = y satisfies Z", "namespace N.M { export const a = 1 } declare module 'm' { function g(): void } declare const q: number", "import type { A } from 'a'; import { type B } from 'b'; export type { C } from 'c'; import r = require('r')",
    "@Dec() class A { @Input() x: string; constructor(@Inject(T) private t: T) {} }", "let t: [a: string, b?: number, ...c: boolean[]]; let u: `a${string}`; let v: typeof import('x'); let w: unique symbol", "f<string>(x); new Map<string, number>(); a < b; c > d", "function isS(x: any): x is string { return true } function as(x): asserts x is A {}",
    "x = a ? (b) : c; y = a ? (b): number => 1 : 2", "const g = async <T>(x: T) => x", "let o = { m<T>(x: T): void {} }", "export default interface A {}", "export = x", "for (const k of Object.keys(o as object)) {}", "a >>= 1; b >>> 2",
]
JAVA_GOOD = [
    "package a.b; import java.util.*; import static x.Y.z; public class A { }", "class A<T extends B & C> extends D<T> implements E, F { int[] a = {1, 2,}, b[]; static { x(); } { y(); } A() { this(1); } <U> A(U u) throws E { super(); } }",
    "interface I { int x = 1; default void f() { } static <T> T g(T t) { return t; } void h() throws E; }", "enum E implements I { A(1) { void f() {} }, B; E(int... x) {} }", "record R<T>(int a, @N String... b) implements I { R { if (a < 0) throw new E(); } }", "@interface N { int value() default 1; String[] n() default {}; }",
    "sealed interface S permits A, B {} non-sealed class A implements S {} final class B implements S {}", "class A { void f() { for (int i = 0, n = 1; i < n; i++) {} for (var x : xs) continue; do { } while (a); l: while (true) break l; synchronized (this) { } assert a : b; } }",
    "class A { int f(Object o) { return switch (o.k()) { case 1, 2 -> 3; case 4 -> { yield 5; } default -> throw new E(); }; } }", "class A { void f() { try (var r = g(); s) { } catch (E | F e) { } finally { } if (o instanceof String s && s.length() > 1) { } } }",
    "class A { Object f() { Function<A, B> g = A::<C>h; Supplier<int[]> s = () -> new int[] {1}; return (a, b) -> a + b; } }", "class A { String t = \"\"\"\n  x \"y\" z\n  \"\"\"; char c = '\\u0041'; long l = 0xFFL; double d = 1e-3; int i = 1_000; }",
    "class A { void f() { List<Map<String, List<Integer>>> x = new ArrayList<>(); int y = (int) z + (A) w; Object o = (Runnable & S) () -> {}; x.<A>m().n[1]++; int[][] q = new int[3][]; } }", "class A { void f() { switch (m) { case 1: x(); break; default: y(); } final int z; class L {} record P(int a) {} } }", "class A { void f() { a >>>= 2; b = c >> 1; String[]::new; } }".replace("String[]::new;", "g(String[]::new);"),
]
JAVA_BAD = ["class A { void f() { return } }", "void f() {}", "class A { int x }", "class { }", "class A { void f() { 1 + 2; } }", "class A { void f( { } }", "class A { String s = \"a; }", "package a", "class A { void f() { if x { } } }", "public class A {\n=======\n}", "class A { void f() { a.b = ; } }", "class A { void f() { x y z; } }", "class A { foo(1); }"]


@pytest.mark.parametrize("text", JS_GOOD)
def test_script_accepts(text):
    parse_script(text)
    parse_script(text, ts=True)


@pytest.mark.parametrize("text", JS_BAD)
def test_script_refuses(text):
    with pytest.raises(Bad):
        parse_script(text)


@pytest.mark.parametrize("text", TS_GOOD)
def test_typescript_accepts(text):
    parse_script(text, ts=True)


@pytest.mark.parametrize("text", ["let x: = 1", "interface A { a: }", "enum { A }", "function f(x: string { }", "type = 1 2", "class A { x: number y }", "let a: Array<string = []"])
def test_typescript_refuses(text):
    with pytest.raises(Bad):
        parse_script(text, ts=True)


def test_jsx():
    good = "const a = <A b='c' d={e} {...f}>text {g} <H/> <></> {/* no */}</A>; const h = <I.J>{k.map(l => <M key={l}/>)}</I.J>;"
    parse_script(good, jsx=True)
    parse_script("const f = <T,>(x: T) => <div>{x}</div>", ts=True, jsx=True)
    for text in (good, "a = <b>c</b>"):
        with pytest.raises(Bad):
            parse_script(text)
    with pytest.raises(Bad):
        parse_script("const a = <A></B>", jsx=True)


@pytest.mark.parametrize("text", JAVA_GOOD)
def test_java_accepts(text):
    parse_java(text)


@pytest.mark.parametrize("text", JAVA_BAD)
def test_java_refuses(text):
    with pytest.raises(Bad):
        parse_java(text)


@pytest.mark.parametrize("end", ["// the end. DO NOT EDIT.\n", "// a b c d", "/* ( [ { */", "/** x. */\n", "// it's"])
def test_comments_at_the_end_hold_no_tokens(end):
    parse_script("let a = 1;\n" + end)
    parse_script("let a: number = 1;\n" + end, ts=True)
    parse_java("class A { }\n" + end)
    for text in ("let a = ;" + end, "let a = 1; /* open"):
        with pytest.raises(Bad):
            parse_script(text)
    with pytest.raises(Bad):
        parse_java("class A { /* open }")


def test_deep_nesting_ends():
    for text in ("(" * 5000 + ")" * 5000, "{" * 3000 + "}" * 3000, "[" * 900):
        try:
            parse_script(text)
        except (Bad, RecursionError):
            pass


N = 10_000
DEEP = {
    "a.js": ["x = " + "[" * N + "]" * N, "f(" * N + "1" + ")" * N, "x = " + "a ? 1 : " * N + "2", "if (a) b(); else " * N + "c()", "{" * N + "}" * N, "x = `" + "${`" * 200 + "`}" * 200 + "`"],
    "a.ts": ["x = " + "(" * N + "1" + ")" * N, "let x: " + "A<" * N + "B" + ">" * N],
    "a.jsx": ["x = " + "<a>" * N + "</a>" * N],
    "A.java": ["class A { void f() { %s } }" % body for body in ("x = " + "(" * N + "1" + ")" * N + ";", "if (a) b(); else " * N + "c();", "x = " + "a ? 1 : " * N + "2;", "{" * N + "}" * N)],
    "a.py": ["if a: b\n" + "elif a: b\n" * 5000],
}


@pytest.mark.parametrize("path,text", [(p, t) for p, texts in DEEP.items() for t in texts], ids=lambda x: x if len(x) < 8 else "text")
def test_nesting_is_no_fault(path, text):
    assert verdict(path, text)[1] == "valid"
    assert verdict(path, text + ")]}")[1] == "corrupt"


def test_depth_beyond_a_parser_is_undecided():
    assert verdict("a.py", "x = " + "(" * 250 + "1" + ")" * 250)[1] == "undecided"
    assert verdict("a.py", "x = " + "-" * 100_000 + "1")[1] == "undecided"
    assert verdict("a.py", "x = " + "(" * 250 + "1")[1] == "corrupt"
