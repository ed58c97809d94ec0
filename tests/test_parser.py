import random

import pytest

from tessera.functions.rust_lexer import tokenize
from tessera.functions.rust_parser import parse


def nodes(src):
    return [(i.removeprefix("@"), t, p) for i, t, p in parse("@", src).nodes if t != "file"]


def edges(src, kind):
    return {(a.removeprefix("@"), b.removeprefix("@::").removeprefix("@")) for a, b, k in parse("@", src).edges if k == kind}


def names(src, kind):
    return {b for _, b in edges(src, kind)}


def test_lexer():
    src = "a /* x /* y */ z */ 'a 'b' b'c' \"s\\\"\" r#\"q\"z\"# 1.5e3 1..2 0xFFu8 r#fn // end\nx"
    assert [t.text for t in tokenize(src)] == ["a", "'a", "'b'", "b'c'", '"s\\""', 'r#"q"z"#', "1.5e3", "1", ".", ".", "2", "0xFFu8", "r#fn", "x"]
    assert [t.text for t in tokenize("#!/bin/x\nfn")] == ["fn"]
    assert [t.text for t in tokenize("#![a]")][:2] == ["#", "!"]


@pytest.mark.parametrize(
    ("src", "want"),
    [
        ("fn foo() {}", [("#1:1", "function", "foo")]),
        ("pub(crate) fn foo() {}", [("#1:1", "function", "pub::foo")]),
        ("#[bench] fn b(_: &mut Bencher) {}", [("#1:10", "function", "bench::b")]),
        ("#[allow(dead_code)]\n#[bench]\nfn b() {}", [("#3:1", "function", "bench::b")]),
        ("#[cfg(bench)]\nfn b() {}", [("#2:1", "function", "b")]),
        ("#[cfg(not(test))] fn t() {}", [("#1:19", "function", "test::t")]),
        ("#[tokio::test] async fn t() {}", [("#1:16", "function", "test::t")]),
        ("#[test]\n#[bench]\npub fn t() {}", [("#3:1", "function", "pub::test::t")]),
        ("#[test]\n// note\nfn t() {}", [("#3:1", "function", "t")]),
        ("fn t() { #[cfg(test)] let x = 1; }", [("#1:1", "function", "test::t")]),
        ("fn a() {}\n#[test] fn b() {}\nfn c() {}", [("#1:1", "function", "a"), ("#2:9", "function", "test::b"), ("#3:1", "function", "c")]),
        ("é!(); fn a() {}", [("#1:8", "function", "a")]),
        ("trait Draw { fn draw(&self); fn d() {} type T; const N: u8; }", [("#1:1", "trait", "Draw"), ("#1:30", "function", "d"), ("#1:48", "const", "N")]),
        ("impl Draw for Point {}", [("#1:1", "impl", "Draw")]),
        ("impl<T> Foo<T> {}", [("#1:1", "impl", None)]),
        ("impl From<X> for Y { type O = u8; }", [("#1:1", "impl", "Y"), ("#1:22", "type_alias", "O")]),
        ("impl fmt::Display for P {}", [("#1:1", "impl", "P")]),
        ("union U { a: u8 }\nmacro_rules! m { () => { fn no() {} } }", [("#2:1", "macro", "m")]),
        ("mod a; mod b { static mut S: u8 = 1; enum E { A } }", [("#1:1", "module", "a"), ("#1:8", "module", "b"), ("#1:16", "static", "S"), ("#1:38", "enum", "E")]),
        ('extern "C" { fn c(x: u8); }\nextern crate z;\npub extern "C" fn d() {}', [("#3:1", "function", "pub::d")]),
        ("fn outer() { fn inner() {} struct S; }", [("#1:1", "function", "outer"), ("#1:14", "function", "inner"), ("#1:28", "struct", "S")]),
    ],
)
def test_items(src, want):
    assert nodes(src) == want


def test_containment():
    assert edges("mod m { fn f() { fn g() {} } }", "contains") == {("", "#1:1"), ("#1:1", "#1:9"), ("#1:9", "#1:18")}


def test_calls():
    src = "fn f() { a(); b::c(1); x.d(); e::<T>(); G::<T>::new(); (h)(); i!(j(k())); l![m()]; vec!{n()} self.o.p(); Q { r: s() }; if t() {} match u() { v(w) if y() => z(), _ => {} } }"
    assert names(src, "calls") == {"a", "b::c", "G::<T>::new", "j", "k", "s", "t", "u", "y", "z"}
    assert names("fn f() { m!(x.a(), B::c(), if (d) {}, e!(f()), $g(1)); }", "calls") == {"c", "f"}
    assert names("fn f() { let g = |a: T| -> U { h(a) }; for i in 0..n() { w(i) } return r(loop { break q() }); }", "calls") == {"h", "n", "w", "r", "q"}


def test_references():
    src = "fn f(a: &mut Aa, b: [Bb; 3]) -> Result<Cc, d::Dd> where T: Ee + 'static { let x: Box<dyn Fn(Ff) -> Gg> = h as Hh; Ii { j: 1 }; k::Kk { .. } = y; Ll::Mm; <Nn as Oo>::p(); }"
    assert names(src, "references") >= {"Aa", "Bb", "Result", "Cc", "Dd", "Ee", "Box", "Fn", "Ff", "Gg", "Hh", "Ii", "Kk", "Nn", "Oo"}
    assert not names(src, "references") & {"Ll", "Mm", "d", "k", "u8"}
    assert names("struct P { x: i32 } type Q = P;", "references") == {"P", "Q"}
    assert names("fn f() { match s { Shape::Sq { side } => side, Tuple(x) => x } }", "references") == {"Sq"}


def test_traits_macros_unsafe():
    assert names("impl Draw for P {}", "implements_trait") == {"Draw"}
    assert names("impl fmt::Display for P {}", "implements_trait") == {"Display"}
    assert names("impl<T> !Send for P<T> {}", "implements_trait") == {"Send"}
    assert not names("impl From<X> for Y {}", "implements_trait") and not names("impl Y {}", "implements_trait")
    assert names("fn f() { a::b!(); c![1] }", "expands_to") == {"b", "c"}
    assert edges("unsafe fn a() {}\nfn b() { unsafe { c() } }\nunsafe impl S for T {}", "uses_unsafe") == {("#1:1", "#1:1"), ("#2:1", "#2:1"), ("#3:1", "#3:1")}


def test_use_paths():
    src = "use a::b;\nuse crate::c::{D, e};\npub use super::f;\nmod m { use self::g as h; }\nfn x() { use std::mem; }"
    assert parse("@", src).use_paths == ["a::b", "crate::c::{D, e}", "pub use super::f", "self::g as h", "std::mem"]


def test_never_fails():
    rng = random.Random(1)
    bits = ["fn", "f", "(", ")", "{", "}", "<", ">", "::", "#[test]", "impl", "struct", "|", "=>", "match", "!", ";", "'a", '"', "->", "let", "=", "if", "x", "[", "]", "pub", "use", "where", ":", ",", "&", "*", "for", "unsafe", "type", "..", "/*"]
    for _ in range(600):
        facts = parse("f", " ".join(rng.choice(bits) for _ in range(rng.randint(0, 60))))
        assert facts.nodes[0] == ("f", "file", None)
    assert parse("f", "fn a() {" + "(" * 30_000).nodes[0][1] == "file"
    assert [n[1] for n in parse("f", "not valid rust {{{").nodes] == ["file"]
