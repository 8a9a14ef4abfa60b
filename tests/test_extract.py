"""What each extractor finds in small texts."""

from __future__ import annotations

import sys

import pytest

from symloom.extract import lexer, registry
from symloom.extract.langs import python
from symloom.extract.pipeline import extract, extract_text, records, records_of
from symloom.sources.registry import supported_languages


def found(text: str, language: str, path: str):
    return extract_text(text.encode(), language, path)


def symbols(f) -> dict[str, str]:
    return {s["qualified_name"]: s["kind"] for s in f.symbols}


def one(f, name: str) -> dict:
    return next(s for s in f.symbols if s["name"] == name)


def calls(f) -> set:
    return {(c["caller_qualified_name"], c["callee_raw_name"]) for c in f.calls}


def relations(f) -> set:
    return {(t["owner_qualified_name"], t["relation"], t["target_raw_name"]) for t in f.types}


def imports(f) -> list:
    return [(i["raw_path"], i["alias"]) for i in f.imports]


RUST = """//! module text
use std::collections::{HashMap, hash_map::Entry as E};
use util::helper;
use a::b::*;

/// A point.
/// Of two.
#[derive(Debug)]
pub struct Point<T> { pub x: T, y: Vec<Point<T>> }
struct Pair(u32, pub Inner);
struct Unit;
pub(crate) enum Kind { A, B(u8) }
pub trait Shape { type Out; fn area(&self) -> f64; fn twice(&self) -> f64 { self.area() } }
impl<T> Point<T> {
    pub fn new(x: T) -> Self { helper(x); Self::make() }
}
impl Shape for Unit { fn area(&self) -> f64 { 1.0 } }
impl Shape for Foreign { fn area(&self) -> f64 { 1.0 } }
impl fmt::Display for Unit { fn area(&self) {} }
macro_rules! m { () => { fn hidden() {} } }
mod inner { pub const LIMIT: usize = 3; pub static mut S: u8 = 1; type Alias = Point<u8>; fn deep() { fn never() {} let c = '}'; deep2("{"); a.b(1).c::<u8>(2); } }
fn add(x: u32, y: Other) -> u32 { x }
"""


def test_rust():
    f = found(RUST, "rust", "src/geo.rs")
    s = symbols(f)
    assert s["src::geo::Point"] == "struct" and s["src::geo::Unit"] == "struct" and s["src::geo::Kind"] == "enum"
    assert s["src::geo::Shape"] == "trait" and s["src::geo::Shape::area"] == "trait_method" and s["src::geo::Shape::Out"] == "associated_type"
    assert s["src::geo::Shape::twice"] == "function"
    assert s["src::geo::Point::new"] == "method" and s["src::geo::Unit::Shape::area"] == "method" and s["src::geo::Unit::Display::area"] == "method"
    assert s["src::geo::inner"] == "module" and s["src::geo::inner::LIMIT"] == "const" and s["src::geo::inner::S"] == "static" and s["src::geo::inner::Alias"] == "type"
    assert "hidden" not in str(s) and "never" not in str(s)
    assert ("src::geo::Point", "field_type", "Vec<Point<T>>") in relations(f) and ("src::geo::Pair", "field_type", "Inner") in relations(f)
    assert ("src::geo::Unit", "implements", "Shape") in relations(f) and not any(o.endswith("Foreign") for o, _, _ in relations(f))
    assert {("src::geo::Point::new", "helper"), ("src::geo::Point::new", "Self::make"), ("src::geo::Shape::twice", "self.area"), ("src::geo::inner::deep", "deep2")} <= calls(f)
    assert ("src::geo::inner::deep", "a.b") in calls(f) and ("src::geo::inner::deep", "a.b(1).c::<u8>") in calls(f)
    assert imports(f) == [("std::collections::HashMap", None), ("std::collections::hash_map::Entry", "E"), ("util::helper", None), ("a::b::*", None)]
    p = one(f, "Point")
    assert p["visibility"] == "pub" and p["signature"] == "pub struct Point<T>" and p["start_line"] == 9 and p["doc_comment"] is None
    assert one(f, "Kind")["visibility"] == "pub(crate)"
    assert {r["raw_name"] for r in f.refs} >= {"Other"} and "u32" not in {r["raw_name"] for r in f.refs}
    assert RUST.encode()[p["body_start_byte"] : p["body_end_byte"]].startswith(b"pub struct Point")
    assert one(f, "new")["parent_qualified_name"] == "src::geo::Point"


def test_rust_docs_and_modules():
    f = found("/// One.\n/// Two.\npub fn a() -> u32 { 0 }\n// plain\nfn b() {}\n/** Block. */\nfn c();", "rust", "src/lib.rs")
    assert symbols(f) == {"src::a": "function", "src::b": "function", "src::c": "function"}
    assert one(f, "a")["doc_comment"] == "One.\nTwo." and one(f, "b")["doc_comment"] is None and one(f, "c")["doc_comment"] == "Block."
    assert one(f, "a")["signature"] == "pub fn a() -> u32"
    assert symbols(found("fn m() {}", "rust", "src/main.rs")) == {"src::m": "function"}
    assert symbols(found("fn m() {}", "rust", "src/foo/mod.rs")) == {"src::foo::m": "function"}
    assert symbols(found("#[derive(Debug)]\nstruct X;", "rust", "x.rs")) and one(found("#[derive(Debug)]\nstruct X;", "rust", "x.rs"), "X")["start_line"] == 2


def test_rust_macros_chains_and_small_types():
    f = found("""fn f(a: my_type, b: &mut other<inner>) -> res_t {
    println!("{}", hidden(Gone)); vec![lost(1)];
    let v: small = x.y()?.z(1)?.w();
    let s = Point { field: value };
    let n = q as size_t;
    let m: Vec<tiny> = g::<Big>(a)?.b()??.c();
}
""", "rust", "src/m.rs")
    assert calls(f) == {("src::m::f", x) for x in ("x.y", "x.y()?.z", "x.y()?.z(1)?.w", "g::<Big>", "g::<Big>(a)?.b", "g::<Big>(a)?.b()??.c")}
    assert {r["raw_name"] for r in f.refs} == {"my_type", "other", "inner", "res_t", "small", "Point", "size_t", "Vec", "tiny", "Big"}


PYTHON = '''import os, sys as system
from . import near
from ..pkg.mod import name as other, more
from far import *


@deco(1)
class Base(Root, pkg.Mixin[int], metaclass=Meta):
    """Says
    what."""

    size: int = 1

    async def run(self, x: "int", y: Item = make()) -> Result:
        def inner():
            return helper(x)

        return self.go(x)[0].stop()


def top(a, *b):
    """One."""
    print(a)
'''


def test_python():
    f = found(PYTHON, "python", "pkg/__init__.py")
    assert symbols(f) == {"pkg.Base": "class", "pkg.Base.run": "method", "pkg.top": "function"}
    assert relations(f) == {("pkg.Base", "extends", "Root"), ("pkg.Base", "extends", "pkg.Mixin[int]")}
    assert calls(f) == {("pkg.Base.run", "make"), ("pkg.Base.run", "helper"), ("pkg.Base.run", "self.go"), ("pkg.Base.run", "self.go(x)[0].stop"), ("pkg.top", "print")}
    assert imports(f) == [("os", None), ("sys", "system"), (".near", None), ("..pkg.mod.name", "other"), ("..pkg.mod.more", None), ("far.*", None)]
    assert one(f, "Base")["doc_comment"] == "Says\nwhat." and one(f, "Base")["start_line"] == 8 and one(f, "Base")["visibility"] is None
    assert one(f, "run")["signature"].startswith("async def run(self") and one(f, "run")["signature"].endswith("-> Result")
    assert {r["raw_name"] for r in f.refs} == {"int", "Item", "Result"} - {"int"} or {r["raw_name"] for r in f.refs} == {"Item", "Result"}
    assert one(f, "top")["doc_comment"] == "One."


def test_python_with_errors():
    f = found("class A:\n    def m(self):\n        return (\n\ndef ok(x):\n    pass\n", "python", "a.py")
    assert symbols(f) == {"a.A": "class", "a.A.m": "method", "a.ok": "function"}


def test_python_of_another_version():
    text = """import os, sys
from . import near


class Old(Base, object):
    def run(self, x):
        print "running", x
        try:
            return self.go(x)
        except IOError, e:
            exec "code"
            log(e)

    def other(self):
        return `x` + compute()


def fine(a: Item):
    return helper(a)


def broken(:
    call_in_broken()
print "end"
"""
    f = found(text, "python", "p/m.py")
    assert symbols(f) == {"p.m.Old": "class", "p.m.Old.run": "method", "p.m.Old.other": "method", "p.m.fine": "function", "p.m.broken": "function"}
    assert imports(f) == [("os", None), ("sys", None), (".near", None)] and relations(f) == {("p.m.Old", "extends", "Base"), ("p.m.Old", "extends", "object")}
    assert calls(f) == {("p.m.Old.run", "self.go"), ("p.m.Old.run", "log"), ("p.m.fine", "helper")} and [r["raw_name"] for r in f.refs] == ["Item"]
    assert one(f, "fine")["start_line"] == 18 and text.encode()[one(f, "run")["body_start_byte"] : one(f, "run")["body_end_byte"]].startswith(b"def run(self, x):")


TS = """import def, { a, b as c } from "./mod";
import * as ns from 'lib';
import "./side.css";
/** Says hi. */
function hi(u: User, n: number = 1): Promise<Reply> { const x: Local = ns.call(u); return new Thing(x).go(); }
export class Dog<T> extends Animal<T> implements Pet, pkg.Named {
  private name: string = "x";
  constructor(n: string) { super(n); this.bark(); }
  get size(): number { return 1 }
  static make = (x: T) => build(x);
  bark(): void { if (a) { log(`w ${wrap(a)}`); } }
}
export interface Shape extends Base { area(): number; name: string }
type Id = string | number;
enum Color { Red, Green }
export const go = async (x: number) => { run(x) }
const plain = 3, f2 = function () { return 1 };
function over(a: string): void;
"""


def test_typescript():
    f = found(TS, "typescript", "src/app/index.ts")
    s = symbols(f)
    base = "src::app::"
    assert s[base + "hi"] == "function" and s[base + "Dog"] == "class" and s[base + "Shape"] == "interface" and s[base + "Id"] == "type" and s[base + "Color"] == "enum"
    assert s[base + "Dog::bark"] == "method" and s[base + "Dog::constructor"] == "method" and s[base + "Dog::make"] == "method" and s[base + "Shape::area"] == "method" and s[base + "Dog::size"] == "method"
    assert s[base + "go"] == "function" and s[base + "f2"] == "function" and base + "plain" not in s and base + "over" not in s and base + "Dog::name" not in s
    assert relations(f) == {(base + "Dog", "extends", "Animal"), (base + "Dog", "implements", "Pet"), (base + "Dog", "implements", "pkg.Named"), (base + "Shape", "extends", "Base")}
    assert imports(f) == [("./mod", "def"), ("./mod", "a"), ("./mod", "c"), ("lib", "ns"), ("./side.css", None)]
    assert {(base + "hi", "call"), (base + "hi", "go"), (base + "Dog::bark", "log"), (base + "Dog::bark", "wrap"), (base + "Dog::make", "build"), (base + "go", "run"), (base + "Dog::constructor", "bark")} <= calls(f)
    types = {r["raw_name"] for r in f.refs if r["kind"] == "type"}
    assert {"User", "number", "Promise", "Reply", "Local"} <= types
    assert "call" in {r["raw_name"] for r in f.refs if r["kind"] == "call"}
    assert one(f, "Dog")["visibility"] == "export" and one(f, "hi")["visibility"] is None and one(f, "hi")["doc_comment"] == "Says hi."
    assert one(f, "go")["signature"] == "go = async (x: number) =>" and one(f, "hi")["signature"] == "function hi(u: User, n: number = 1): Promise<Reply>"


def test_javascript():
    f = found("class A extends B { m() { return /[{]/.test(x) } f = () => { y() } }\nfunction g() { h() }\nconst k = (a) => a.z();", "javascript", "lib/x.mjs")
    assert symbols(f) == {"lib::x::A": "class", "lib::x::A::m": "method", "lib::x::A::f": "method", "lib::x::g": "function", "lib::x::k": "function"}
    assert relations(f) == {("lib::x::A", "extends", "B")}
    assert {("lib::x::A::m", "test"), ("lib::x::A::f", "y"), ("lib::x::g", "h"), ("lib::x::k", "z")} == calls(f)


GO = """// Package p.
package shapes

import (
	"fmt"
	str "strings"
	_ "embed"
	. "math"
)
import "os"

// Point is.
type Point struct {
	X, Y int
	Base
	*Other
	next *Point `json:"n"`
}

type (
	Shape interface {
		Area() float64
		fmt.Stringer
	}
	Alias = Point
	Celsius float64
)

// New makes.
func New(x int, s Shape) (*Point, error) {
	fmt.Println(x)
	return helper(x).make(), nil
}

func (p *Point) move(d Delta) { p.x.run(d) }
func (s Set[T]) Len() int { return 0 }
"""


def test_go():
    f = found(GO, "go", "pkg/shapes/point.go")
    assert symbols(f) == {"shapes::Point": "struct", "shapes::Shape": "interface", "shapes::Shape::Area": "method", "shapes::Alias": "type_alias", "shapes::Celsius": "type", "shapes::New": "function", "shapes::Point::move": "method", "shapes::Set::Len": "method"}
    assert relations(f) == {("shapes::Point", "embeds", "Base"), ("shapes::Point", "embeds", "Other"), ("shapes::Shape", "extends", "fmt.Stringer"), ("shapes::Alias", "alias_of", "Point")}
    assert imports(f) == [("fmt", None), ("strings", "str"), ("embed", "_"), ("math", "."), ("os", None)]
    assert {("shapes::New", "Println"), ("shapes::New", "helper"), ("shapes::New", "make"), ("shapes::Point::move", "run")} == calls(f)
    assert one(f, "New")["visibility"] == "exported" and one(f, "move")["visibility"] == "package-private" and one(f, "New")["doc_comment"] == "New makes."
    assert one(f, "New")["signature"] == "func New(x int, s Shape) (*Point, error)"
    types = {r["raw_name"] for r in f.refs if r["kind"] == "type"}
    assert {"Shape", "Point", "Delta", "error"} <= types and "x" not in types


def test_go_types_in_bodies():
    f = found("""package p
func N(a Foo) *Bar {
	c := make(chan Msg, 3)
	d := new(Thing)
	e := x.(Asserted)
	g := func(q Arg, r ...Rest) Res { return inner(q) }
	h := []Elem{}
	m := map[Key]pkg.Val{}
	switch y := x.(type) {
	case One, *Two:
		use(y)
	}
	var z Zed = Gen[Item](a)
	for i := range xs { fs[i](a) }
	return nil
}
func (s *S) M(a Foo) {}
func G[T Num](t T) T { return t }
""", "go", "p/n.go")
    types = [r["raw_name"] for r in f.refs if r["kind"] == "type"]
    assert "N" not in types and "M" not in types and "G" not in types
    assert {"Foo", "Bar", "Msg", "Thing", "Asserted", "Arg", "Rest", "Res", "Elem", "Key", "Val", "One", "Two", "Zed", "Item", "S", "Num", "T"} <= set(types)
    assert not {"x", "y", "a", "q", "r", "c", "xs", "i", "t", "s", "pkg"} & set(types)
    assert {("p::N", "inner"), ("p::N", "use"), ("p::N", "Gen"), ("p::N", "make"), ("p::N", "new")} <= calls(f)


JAVA = """package com.example.app;
import java.util.List;
import static java.lang.Math.*;
/** Top doc. */
@Entity(name = "x")
public class Foo<T> extends Base<Item> implements Runnable, Comparable<Foo> {
    private final int a = 1, b;
    protected List<String> names = new ArrayList<>();
    /** lost */
    public Foo(int x) { super(x); init(); }
    @Override public Result run(Arg arg) throws Bad { helper.go(arg); return new Thing(arg); }
    abstract void none();
    enum Color implements Named { /** red */ RED(1) { void paint() { p(); } }, GREEN; int v() { return 1; } }
    static class Inner { }
}
interface Shape extends Base { double area(); }
@interface Mark { String value(); }
"""


def test_java():
    f = found(JAVA, "java", "src/Foo.java")
    s, b = symbols(f), "com.example.app::"
    assert s[b + "Foo"] == "class" and s[b + "Foo::a"] == "field" and s[b + "Foo::b"] == "field" and s[b + "Foo::names"] == "field" and s[b + "Foo::Foo"] == "constructor"
    assert s[b + "Foo::run"] == "method" and s[b + "Foo::none"] == "method" and s[b + "Foo::Color"] == "enum" and s[b + "Foo::Color::RED"] == "enum_constant" and s[b + "Foo::Color::RED::paint"] == "method" and s[b + "Foo::Color::v"] == "method"
    assert s[b + "Shape"] == "interface" and s[b + "Shape::area"] == "method" and s[b + "Mark"] == "annotation" and s[b + "Foo::Inner"] == "class"
    assert imports(f) == [("java.util.List", None), ("static java.lang.Math.*", None)]
    targets = {t for o, _, t in relations(f) if o == b + "Foo"}
    assert targets == {"Base<Item>", "Base", "Item", "Runnable", "Comparable<Foo>", "Comparable", "Foo", "List"}  # of a plain type nothing, of generic ones all
    assert not any(o == b + "Foo::Color" and t == "Named" for o, _, t in relations(f))
    assert {(b + "Foo::run", "go"), (b + "Foo::run", "new Thing"), (b + "Foo::Foo", "init"), (b + "Foo::Color::RED::paint", "p")} == calls(f)
    assert one(f, "Foo")["doc_comment"] == "Top doc." and one(f, "run")["doc_comment"] is None and one(f, "RED")["doc_comment"] == "red"
    assert one(f, "names")["visibility"] == "protected" and one(f, "none")["visibility"] is None
    assert f.refs == []


def test_java_generics():
    f = found("""package p;
class A<K extends Comparable<K>> {
    private Map<String, Integer> counts = new HashMap<String, Integer>(), more = of(1, 2), last;
    Map<String, List<Foo>> get() { return go(); }
    public static <T, U> Map.Entry<T, U[]> pair(Map<T, U> a, int b) { return make(a); }
    record Rec(int a, List<B> b) { int twice() { return a; } }
    int[] sizes = {1, 2}, rest[];
    @Nullable Foo plain; boolean less = a < b;
    A(List<K> all) { super(all); }
    void end() { done(); }
}
record Top(int x) {}
class Last {}
""", "java", "A.java")
    assert symbols(f) == {"p::A": "class", "p::A::counts": "field", "p::A::more": "field", "p::A::last": "field", "p::A::get": "method", "p::A::pair": "method", "p::A::sizes": "field", "p::A::rest": "field", "p::A::plain": "field", "p::A::less": "field", "p::A::A": "constructor", "p::A::end": "method", "p::Last": "class"}
    assert [t["target_raw_name"] for t in f.types] == ["Map", "Integer", "Map", "List<Foo>", "List", "Foo", "Map.Entry", "Map", "Entry", "T", "U"]
    assert calls(f) == {("p::A::get", "go"), ("p::A::pair", "make"), ("p::A::end", "done")}


CSHARP = """using System;
using static System.Math;
using Alias = System.Text.StringBuilder;
namespace My.App {
    /// <summary>Hi</summary>
    [Serializable]
    public sealed class Foo<T> : Base<T>, IThing where T : new() {
        private readonly int count = 1;
        public event EventHandler Changed;
        public string Name { get; set; } = "x";
        public int Twice => count * 2;
        public Foo(Item item) : base(item) { Init(); }
        public User GetUser(int id) { return repo.Find<User>(id); }
        static void Arrow(Dep d) => d.Run(new Thing());
        enum Color { Red, Green = 2 }
    }
    public delegate void Handler(object s, Args e);
    interface IThing { void Do(); }
    struct P { }
}
"""


def test_csharp():
    f = found(CSHARP, "csharp", "a/Foo.cs")
    s, b = symbols(f), "My::App::"
    want = {"Foo": "class", "Foo::count": "field", "Foo::Changed": "event", "Foo::Name": "property", "Foo::Twice": "property", "Foo::Foo": "constructor", "Foo::GetUser": "method", "Foo::Arrow": "method", "Foo::Color": "enum", "Foo::Color::Red": "enum_member", "Foo::Color::Green": "enum_member", "Handler": "delegate", "IThing": "interface", "IThing::Do": "method", "P": "struct"}
    assert s == {b + k: v for k, v in want.items()}
    assert relations(f) == {(b + "Foo", "extends", "Base"), (b + "Foo", "extends", "IThing")}
    assert imports(f) == [("System", None), ("System.Math", None), ("System.Text.StringBuilder", "Alias")]
    assert {(b + "Foo::Foo", "Init"), (b + "Foo::GetUser", "Find"), (b + "Foo::Arrow", "Run"), (b + "Foo::Arrow", "Thing")} == calls(f)
    assert one(f, "Name")["visibility"] == "public" and one(f, "P")["visibility"] == "default" and one(f, "count")["visibility"] == "private readonly" and one(f, "Red")["visibility"] is None
    assert one(f, "Foo")["doc_comment"] == "<summary>Hi</summary>"


def test_csharp_generics():
    f = found("""namespace N;
class A {
    private Dictionary<string, int> counts = new Dictionary<string, int>(), more;
    public readonly Dictionary<string, List<Foo>> map;
    int a = 1, b = Make(2, 3);
    Foo?[] items;
    (int x, Bar y) pair;
    public Dictionary<string, List<Foo>> Get(IList<Bar> all, System.Text.Encoding e) => Go();
    public event Action<int, string> Changed;
    public List<Foo> All { get; set; } = new();
    T Map<T>(Func<T, Foo> f) where T : class { return f.Run<T>(1); }
    void IThing.Do() { Done(); }
    void End() { }
}
""", "csharp", "A.cs")
    b = "N::A"
    assert symbols(f) == {b: "class", **{f"{b}::{x}": "field" for x in ("counts", "more", "map", "a", "b", "items", "pair")}, f"{b}::Get": "method", f"{b}::Changed": "event", f"{b}::All": "property", f"{b}::Map": "method", f"{b}::Do": "method", f"{b}::End": "method"}
    types = [r["raw_name"] for r in f.refs if r["kind"] == "type"]
    assert {"Dictionary<string, int>", "Dictionary<string, List<Foo>>", "IList<Bar>", "System.Text.Encoding", "Action<int, string>", "List<Foo>", "Foo", "Bar", "int", "Func<T, Foo>"} <= set(types) and "Make" not in types
    assert {(f"{b}::Get", "Go"), (f"{b}::Map", "Run"), (f"{b}::Do", "Done")} == calls(f)


DART = """library my.lib;
import 'dart:io' as io;
export 'src/a.dart';
/// A dog.
class Dog extends Animal with Loud, Fast implements Pet {
  final String name;
  Dog(this.name, Item i) : super(i) { init(); }
  Dog.named(this.name);
  factory Dog.of(String s) => Dog(s);
  const Dog.fixed() : name = 'x';
  /// Barks.
  void bark(int n) { io.stdout.write(n); list..add(1)..sort(); }
  int get size => compute();
  set size(int v) { store(v); }
  bool operator ==(Object o) => same(o);
  static Future<Result> load() async { return new Loader().go(); }
}
mixin Loud on Animal { }
enum Color { red, green }
extension Ext on String { int twice() => length * 2; }
extension on int { void z() {} }
typedef Cb = void Function(Arg a);
var top = 1;
Result run(Config c) { return help(c); }
"""


def test_dart():
    f = found(DART, "dart", "lib/dog.dart")
    s, b = symbols(f), "my.lib::"
    want = {"Dog": "class", "Dog::name": "field", "Dog::bark": "method", "Dog::size": "setter", "Dog::==": "operator", "Dog::load": "method", "Loud": "mixin", "Color": "enum", "Color::red": "enum_constant", "Color::green": "enum_constant", "Ext": "extension", "Ext::twice": "method", "extension_on_int": "extension", "extension_on_int::z": "method", "Cb": "type_alias", "top": "variable", "run": "function", "Dog::Dog": "constructor", "Dog::named": "constructor", "Dog::of": "factory_constructor", "Dog::fixed": "const_constructor"}
    assert s == {b + k: v for k, v in want.items()}
    assert [x["kind"] for x in f.symbols if x["name"] == "size"] == ["getter", "setter"]
    assert relations(f) == {(b + "Dog", "extends", "Animal"), (b + "Dog", "implements", "Loud"), (b + "Dog", "implements", "Fast"), (b + "Dog", "implements", "Pet")}
    assert imports(f) == [("import:dart:io", "io"), ("export:src/a.dart", None)]
    assert {(b + "Dog::bark", "write"), (b + "Dog::bark", "add"), (b + "Dog::bark", "sort"), (b + "Dog::size", "compute"), (b + "Dog::size", "store"), (b + "Dog::==", "same"), (b + "Dog::load", "go"), (b + "run", "help"), (b + "Dog::Dog", "init")} <= calls(f)
    bark = one(f, "bark")
    assert bark["doc_comment"] == "Barks." and DART[bark["body_start_byte"] : bark["body_end_byte"]] == "void bark(int n)" and bark["visibility"] is None


@pytest.mark.parametrize("language", sorted(supported_languages()))
def test_anything_can_be_read(language):
    """Broken, empty and odd texts give what they can and never raise."""
    texts = {"rust": RUST, "python": PYTHON, "typescript": TS, "javascript": TS, "go": GO, "java": JAVA, "csharp": CSHARP, "dart": DART}
    whole = texts[language]
    for n in range(0, len(whole), 7):
        found(whole[:n], language, "x/y.z")
        found(whole[n:], language, "x/y.z")
    for odd in ["", "}}}}", "((((", "\x00\xff", "é" * 10, "'", '"', "/*", "`${", "class", "fn", "func (", "type", "import", "use a::{", "@", "#", "enum {"]:
        found(odd, language, "x.y")
    assert extract_text(b"\xff\xfe class A", language, "a.b") is not None


def test_python_work_grows_with_the_file():
    """Functions of Python called while a file is read: of twice the file about twice as many, though each of its functions has calls to be put in order."""

    def work(n):
        text, seen = b"".join(b"def f_%d(a: A) -> B:\n    return g(a).h()\n" % i for i in range(n)), 0

        def count(frame, event, arg):
            nonlocal seen
            seen += event == "call"

        sys.setprofile(count)
        try:
            found = extract_text(text, "python", "m.py")
        finally:
            sys.setprofile(None)
        assert len(found.calls) == 2 * n and found.calls == sorted(found.calls, key=lambda r: (r["line"], r["col"]))
        return seen

    assert work(400) < 2.5 * work(200)


#: For each language a file's extension, lines before the first item, and items of which some look across others.
ITEMS = [
    ("rust", "rs", "", "impl T_9 {\n    fn f(&self) { self.g(); }\n}\nuse a::b_#;\npub struct T_# {\n    x: A_#,\n}\nimpl S for T_# {\n    pub fn run(&self) -> B_# { go(1) }\n}\n"),
    ("python", "py", "", '@d\nclass T_#(B):\n    """x\nclass Y:\n"""\n    def run(self, a: A_#) -> B:\n        return self.go(a)\nimport m_#\n'),
    ("typescript", "ts", "", 'import { A } from "m_#";\nexport class T_# extends B {\n  run(a: A_#): B { return go(a); }\n}\nfunction f_#(a: A) { return `${g(a)}`; }\n'),
    ("javascript", "js", "", "class T_# extends B {\n  run(a) { return this.go(a); }\n}\nimport 'm_#'\n"),
    ("go", "go", "package p\n", 'import "m_#"\ntype T_# struct {\n\tB_#\n}\nfunc (t *T_#) Run(a A) error {\n\treturn t.go(a)\n}\n'),
    ("java", "java", "package p.q;\n", "import m.N_#;\nclass T_# extends B<A_#> {\n    A run(int a) { return go(a); }\n}\n"),
    ("csharp", "cs", "namespace N;\n", "using M_#;\nclass T_# : B {\n    public A_# Run(B b) { return Go(b); }\n}\n"),
    ("dart", "dart", "library l;\n", "import 'm_#.dart';\nclass T_# extends B {\n  A_# run(B b) { return go(b); }\n}\n"),
]


@pytest.mark.parametrize("language, ext, head, item", ITEMS)
def test_pieces_are_the_whole(monkeypatch, language, ext, head, item):
    text, at = head + "".join(item.replace("#", str(i)) for i in range(12)), f"a/b.{ext}"
    # what is open at the end, or named by what stands at the end, is found as in a file that is read as one
    texts = [text, text.replace("}", "", 1), text + "}\n" + text, text + "\nclass Z {", text.removeprefix(head) + head, text.replace("(", "", 1)]
    whole = [vars(extract_text(t.encode(), language, at)) for t in texts]
    monkeypatch.setattr(lexer, "PIECE", 20)
    monkeypatch.setattr(python, "PIECE", 100)
    module = registry.module_path(at, language)
    assert len(list(registry.pieces(language, text, module))) > 3
    assert [vars(extract_text(t.encode(), language, at)) for t in texts] == whole
    for kind in ("symbols", "refs", "calls", "imports", "types"):
        for t, w in zip(texts, whole):
            rows = [r for piece in records_of(t.encode(), language, at, kind) for r in piece]
            assert sorted(map(str, rows)) == sorted(map(str, w[kind]))


def test_records_of_a_kind(spark):
    files = spark.createDataFrame([(f"a/b.{ext}", language, bytearray((head + item).replace("#", "1").encode())) for language, ext, head, item in ITEMS] + [("c.txt", "text", bytearray(b"x"))], "path string, language string, content binary")
    every = extract(files.selectExpr("*", "content AS content_hash", "0 AS size_bytes", "0 AS modified_at"))
    for kind in ("symbols", "refs", "calls", "imports", "types"):
        got, wanted = records(files, kind), every.selectExpr("path", f"inline({kind})")
        assert got.columns == wanted.columns and got.count() == wanted.count() > 0
        assert got.exceptAll(wanted).isEmpty()
