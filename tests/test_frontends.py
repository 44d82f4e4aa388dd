"""The front-ends on a small file of each language: symbols, calls and imports, and the time that long files take."""

import time

import pytest

from codeloom.sources.frontends import extract_one


def outline(language, source):
    found = extract_one("f", language, source)
    symbols = {s["qualified_name"].removeprefix("f."): s for s in found["symbols"]}
    calls = {(c["callee"], (c["caller_qualified"] or "f.").removeprefix("f.")) for c in found["calls"]}
    imports = [(i["local_name"], i["module_path"]) for i in found["imports"]]
    return symbols, calls, imports


def kinds(symbols):
    return {name: s["kind"] for name, s in symbols.items()}


TYPESCRIPT = """import base, { tax as rate, round } from './money';
import * as log from "./log";
import './setup';
// function ghost() {}
@Service({ scope: 'x' })
export class Cart<T> extends Base<T> {
  private lines: Map<string, number> = new Map();
  constructor(private owner: string) { super(owner); this.reset(); }
  @Trace() async total(id: string): Promise<{ sum: number }> { return log.write(id)?.sum() ?? rate(`t ${round(1)} }`); }
  abstract later(): void;
  handler = () => { hidden(); }
  set value(v) { if (v && this.open || v > 2) { this.x = v ? 1 : 2 } }
}
export default async function main<T>(cart: T, make = build()): Promise<void> {
  const inner = async (y?: number) => { step(y); };
  const odd = /[/"']{/.test("a"), m = function () { deep(); };
  function nested() { for (const q of list()) { do { spin(); } while (more()); } }
  switch (cart) { case 1: new Cart(arg()); break; default: new Cart().go(); }
  const obj = { method(a) { inside(); }, f: pick<number>(3) };
}
interface Shape { area(): number }
export enum Color { Red = 1 }
export type Alias<T> = { a: T }
  | null;
export const one = (a) => a + two(a), three = 3;
"""


def test_typescript():
    symbols, calls, imports = outline("typescript", TYPESCRIPT)
    assert kinds(symbols) == {
        "Cart": "class", "Cart.constructor": "method", "Cart.total": "method", "Cart.value": "method", "main": "function", "main.inner": "variable", "main.m": "variable",
        "main.nested": "function", "Shape": "interface", "Color": "enum", "Alias": "type", "one": "variable",
    }
    assert {n for n, s in symbols.items() if s["is_exported"]} == {"Cart", "main", "Color", "Alias", "one"}
    total = symbols["Cart.total"]
    assert (total["signature"], total["return_type"], total["receiver_type"], total["decorators"]) == ("(id: string)", "Promise<{ sum: number }>", "f.Cart", ["@Trace()"])
    assert symbols["Cart"]["decorators"] == ["@Service({ scope: 'x' })"] and symbols["main"]["return_type"] == "Promise<void>"
    assert symbols["Cart.value"]["complexity"] == 5 and symbols["main.nested"]["complexity"] == 3 and symbols["Cart"]["complexity"] == 0
    assert (symbols["Cart"]["line_start"], symbols["Cart"]["line_end"], symbols["Alias"]["line_end"]) == (6, 13, 24)
    assert {("this.reset", "Cart.constructor"), ("log.write", "Cart.total"), ("log.write(id)?.sum", "Cart.total"), ("rate", "Cart.total"), ("round", "Cart.total"), ("build", "main"), ("step", "main.inner"),
            ("deep", "main.m"), ("list", "main.nested"), ("more", "main.nested"), ("arg", "main"), ("new Cart().go", "main"), ("inside", "main"), ("pick", "main"), ("two", "one")} <= calls
    assert not {c for c, _ in calls} & {"hidden", "ghost", "Cart", "super", "later", "method", "Trace"}
    assert imports == [("rate", "./money"), ("round", "./money"), ("base", "./money"), ("log", "./log"), (None, "./setup")]


def test_commonjs():
    symbols, calls, imports = outline("javascript", "const { a, b: c } = require('./m');\nconst d = require(\"./n\");\nrequire('./bare');\nfunction f() { const g = require('lazy'); return g.run(a); }\n")
    assert imports == [("a", "./m"), ("c", "./m"), ("d", "./n"), ("g", "lazy"), (None, "./bare")]
    assert ("g.run", "f") in calls and kinds(symbols) == {"f": "function"}
    assert outline("typescript", "const a = require('./m');\n")[2] == []


RUST = """use std::collections::{HashMap, hash_map::{Entry, self}};
use crate::shop::price as cost;
use tools::*;
pub struct Cart<'a> { owner: &'a str }
#[derive(Debug)]
pub(crate) enum Kind { A, B(i32) }
impl<'a> Cart<'a> {
    pub fn new() -> Self { let c = '{'; Cart { owner: trim("}") } }
    #[tool(name = "x")]
    fn run(&self, n: i32) -> Result<(), Kind> where Self: Sized {
        match n { 0 => math::add(1, 2), n if n > 1 && self.ok() => self.go(|x| x.f()), Some(x) => {}, _ => println!("{}", hidden(b)) }
        if let Some(y) = find(n) { while y || last() { } }
        let v = it.iter().map(|| quiet()).collect::<Vec<_>>();
    }
}
impl Cart<'_> for Shape { fn area(&self) -> f64 { 1.0 } }
trait Shape { fn area(&self) -> f64; fn name(&self) -> String { label() } }
mod tests {
  #[test]
  fn works() { Cart::new(); }
}
fn main() { let c = Cart::new(); c.run(1); }
"""


def test_rust():
    symbols, calls, imports = outline("rust", RUST.replace("impl Cart<'_> for Shape", "impl Drawn for Cart"))
    assert kinds(symbols) == {
        "Cart": "class", "Kind": "enum", "Cart<'a>.new": "method", "Cart<'a>.run": "method", "Cart.area": "method", "Shape": "class", "Shape.area": "method", "Shape.name": "method",
        "works": "function", "main": "function",
    }
    assert {n for n, s in symbols.items() if s["is_exported"]} == {"Cart", "Cart<'a>.new", "Cart<'a>.run", "works"}
    run = symbols["Cart<'a>.run"]
    assert (run["signature"], run["return_type"], run["complexity"]) == ("(&self, n: i32)", "Result<(), Kind>", 9)
    assert {("trim", "Cart<'a>.new"), ("math::add", "Cart<'a>.run"), ("self.ok", "Cart<'a>.run"), ("self.go", "Cart<'a>.run"), ("x.f", "Cart<'a>.run"), ("find", "Cart<'a>.run"), ("last", "Cart<'a>.run"),
            ("it.iter().map", "Cart<'a>.run"), ("quiet", "Cart<'a>.run"), ("label", "Shape.name"), ("Cart::new", "works"), ("Cart::new", "main"), ("c.run", "main")} <= calls
    assert not {c for c, _ in calls} & {"hidden", "println", "Some"}
    assert imports == [("HashMap", "std::collections::HashMap"), ("Entry", "std::collections::hash_map::Entry"), ("hash_map", "std::collections::hash_map"), ("cost", "crate::shop::price"), (None, "tools::*")]


def test_go():
    source = 'package shop\nimport (\n  "fmt"\n  m "example.com/x/money"\n)\nimport "os"\ntype Cart struct { x int }\ntype ( Op interface { Do(a int) int }\n  Num int )\ntype A = B\nfunc (c *Cart) Add(a, b int) (int, error) { return a + b, fmt.Errorf("x") }\nfunc (Cart) sub() int { return 1 }\nfunc Max[T any](a T) map[string]interface{} { if a > 1 && b { for i := 0; i < 3; i++ { go c.Add(1, 2) } } ; x := []byte(s); f := func(a int) error { return deep() }; return nil }\nfunc main() { defer done(c); m.Do(int(3)) }\n'
    symbols, calls, imports = outline("go", source)
    assert kinds(symbols) == {"Cart": "class", "Op": "interface", "Num": "type", "Cart.Add": "method", "Cart.sub": "method", "Max": "function", "main": "function"}
    assert {n for n, s in symbols.items() if s["is_exported"]} == {"Cart", "Op", "Num", "Cart.Add", "Max"}
    assert (symbols["Cart.Add"]["signature"], symbols["Cart.Add"]["return_type"], symbols["Cart.Add"]["receiver_type"]) == ("(a, b int)", "(int, error)", "Cart")
    assert symbols["Max"]["return_type"] == "map[string]interface{}" and symbols["Max"]["complexity"] == 4 and symbols["Cart"]["complexity"] == 1
    assert calls == {("fmt.Errorf", "Cart.Add"), ("c.Add", "Max"), ("deep", "Max"), ("done", "main"), ("m.Do", "main"), ("int", "main")}
    assert imports == [("fmt", "fmt"), ("m", "example.com/x/money"), ("os", "os")]


def test_java():
    source = """package shop;
import java.util.List;
import java.util.*;
import static money.Rates.VAT;
@Deprecated
public class Cart extends Base implements Comparable<Cart> {
  private final List<String> names = make();
  static { init(); }
  public Cart(int x) { super(x); this.x = check(x); }
  @Override public <T> Map<String, List<T>> get(T a, int[] b) throws IOException { for (String s : names) { use(s); } for (int i = 0; i < 3 && ok(); i++) {} return new Cart(arg()).then().map(a -> go(a)); }
  abstract int area();
  class Inner { void nope() { hidden(); } }
  int[] all() { Cart f = new Cart() { int m() { return anon(); } }; return x ? a.b.c() : null; }
}
interface Shape { double area(); default int two() { return one(); } }
enum Color { RED, GREEN; int f() { return 1; } }
"""
    symbols, calls, imports = outline("java", source)
    assert kinds(symbols) == {"Cart": "class", "Cart.Cart": "method", "Cart.get": "method", "Cart.area": "method", "Cart.all": "method", "Shape": "interface", "Shape.area": "method", "Shape.two": "method", "Color": "enum"}
    assert symbols["Cart.get"]["complexity"] == 3 and symbols["Cart.all"]["complexity"] == 2 and symbols["Cart.get"]["signature"] == "(T a, int[] b)" and not any(s["is_exported"] for s in symbols.values())
    assert calls == {("check", "Cart.Cart"), ("use", "Cart.get"), ("ok", "Cart.get"), ("arg", "Cart.get"), ("new Cart(arg()).then", "Cart.get"), ("new Cart(arg()).then().map", "Cart.get"), ("go", "Cart.get"), ("anon", "Cart.all"), ("a.b.c", "Cart.all"), ("one", "Shape.two")}
    assert imports == [("List", "java.util.List"), ("java.util", "java.util"), ("VAT", "money.Rates.VAT")]


def test_csharp():
    source = """using System;
using Rates = Money.Rates;
namespace Shop.Core {
  [Serializable]
  public class Cart : Base, IShape {
    public int Total { get; set; } = Start();
    public Cart(int x) : base(x) { Check(x); }
    public int Add(int a, int b) => a + Sum(a, b);
    public async Task<List<int>> Run<T>(T x) where T : class { if (a && b) await Log.Write(x); foreach (var q in Items()) { } int Local(int z) { return z; } return obj?.Gen<int>(1) ?? x.Y(2); }
    public static Cart operator +(Cart a, Cart b) { return Plus(a, b); }
    public delegate void Changed(int x);
  }
  interface IShape { int Area(int x); }
  enum Color { Red, Green }
}
"""
    symbols, calls, imports = outline("csharp", source)
    assert kinds(symbols) == {"Cart": "class", "Cart.Cart": "method", "Cart.Add": "method", "Cart.Run": "method", "IShape": "interface", "IShape.Area": "method", "Color": "enum"}
    assert calls == {("Check", "Cart.Cart"), ("Log.Write", "Cart.Run"), ("Items", "Cart.Run"), ("x.Y", "Cart.Run")} and symbols["Cart.Run"]["complexity"] == 3
    assert imports == [("System", "System"), ("Rates", "Money.Rates")]


def test_ruby():
    source = """require 'json'
require_relative "money/rate"
class Cart < Base
  attr_reader :x
  def initialize(x, y = 2)
    puts "a #{helper(x)} b" if x
    super(x)
  end
  def self.make(a)
    hidden(a)
  end
  def add(a) = a + 1
  def run!
    items.each do |i|
      next unless i.ok?
      while i do go(i) end
    end
    case x
    when 1 then one 2
    end
    <<~EOS
      def fake; end
    EOS
  end
end
module Math
  def area; compute(1); end
end
def free_function(a)
  raise ArgumentError, "x" unless a
  Cart.new(a).run!
  b = a / 3 / 4
end
free_function 3
"""
    symbols, calls, imports = outline("ruby", source)
    assert kinds(symbols) == {"Cart": "class", "Cart.initialize": "method", "Cart.add": "method", "Cart.run!": "method", "Math": "class", "Math.area": "method", "free_function": "function"}
    assert (symbols["Cart"]["line_start"], symbols["Cart"]["line_end"], symbols["Cart.run!"]["line_end"]) == (3, 25, 24)
    assert {("puts", "Cart.initialize"), ("helper", "Cart.initialize"), ("each", "Cart.run!"), ("ok?", "Cart.run!"), ("go", "Cart.run!"), ("one", "Cart.run!"), ("compute", "Math.area"), ("raise", "free_function"), ("new", "free_function"), ("run!", "free_function"), ("free_function", "")} <= calls
    assert not {c for c, _ in calls} & {"hidden", "fake", "attr_reader", "self"}
    assert imports == [("json", "json"), ("rate", "money/rate")]


def test_php():
    source = """<html> outside(); <?php
namespace Shop;
use Money\\Rate;
use Money\\{Util, Other as O};
use function Money\\round_up;
#[Attr(1)]
final class Cart extends Base implements Shape {
  use Logs;
  public function __construct(private int $a) { $this->init(strlen("x")); parent::boot(); }
  abstract protected function area(): float;
  public static function make(): self { return new self(helper()); }
}
interface Shape { public function area(); }
function &free(int $a, $b = null): ?string { if ($a && isset($b)) { return \\Money\\run($a)->then(fn($x) => go($x))->done(); } elseif ($b) {} return <<<EOT
 text { fake() }
 EOT; }
?> between() <?php after(); $f(); Cart::make(); $o?->nul();
"""
    symbols, calls, imports = outline("php", source)
    assert kinds(symbols) == {"Cart": "class", "Cart.__construct": "method", "Cart.area": "method", "Cart.make": "method", "Shape": "interface", "Shape.area": "method", "free": "function"}
    assert (symbols["free"]["return_type"], symbols["free"]["signature"], symbols["free"]["complexity"], symbols["free"]["line_end"]) == ("?string", "(int $a, $b = null)", 4, 16)
    assert calls == {("init", "Cart.__construct"), ("strlen", "Cart.__construct"), ("helper", "Cart.make"), ("isset", "free"), ("\\Money\\run", "free"), ("then", "free"), ("go", "free"), ("done", "free"), ("after", "")}
    assert imports == [("Rate", "Money\\Rate"), ("Util", "Money\\Util"), ("O", "Money\\Other"), ("round_up", "Money\\round_up")]


def test_c():
    source = '#include <stdio.h>\n#include "shape/point.h"\n#define WRAP(x) bar(x)\ntypedef struct Point { int x; } Point;\nstruct Node;\nenum Color { RED, GREEN };\nunion Value { int i; };\nstatic int add(int a, int b);\nint *find(struct Node *n, char c) { if (c == \'{\' && n) { return look(n, sizeof(int)); } for (;;) { } return 0; }\nint main(void) { struct Point p = {1}; int y = add(1, 2); p.f(3); q->g(4); return add(y, 3) ? 1 : 0; }\n'
    symbols, calls, imports = outline("c", source)
    assert kinds(symbols) == {"Point": "class", "Color": "enum", "Value": "class", "find": "function", "main": "function"} and symbols["find"]["complexity"] == 4
    assert calls == {("look", "find"), ("add", "main"), ("p.f", "main"), ("q->g", "main")}
    assert imports == [("stdio", "stdio.h"), ("point", "shape/point.h")]


def test_cpp():
    source = """#include <vector>
namespace n { int compute(int x) { return std::max(x, 1); } }
namespace a::b {
template <typename T>
class Cart : public Base<T> {
 public:
  Cart(int x) : x_(x), y_{2} { init(x); }
  ~Cart() {}
  int add(int a) const noexcept { return helper(a) + this->go(); }
  virtual void draw() = 0;
  bool operator==(const Cart& o) const { return eq(o); }
  int later(int z);
};
}
int Cart::sub(int a) { std::vector<int> v(10); Foo bar(1); auto l = [&](int q) { return lam(q); }; return obj.m(a); }
struct P { int x; int len() { return 1; } };
enum class Color : int { Red };
auto tail(int x) -> int { return pick<int>(x); }
"""
    symbols, calls, _ = outline("cpp", source)
    assert kinds(symbols) == {
        "compute": "function", "Cart": "class", "Cart.Cart": "method", "Cart.~Cart": "method", "Cart.add": "method", "Cart.operator==": "method", "sub": "function", "P": "class",
        "P.len": "method", "Color": "enum", "tail": "function",
    }
    assert symbols["sub"]["receiver_type"] == "f.Cart" and ("lam", "sub") in calls and ("obj.m", "sub") in calls
    assert {("std::max", "compute"), ("init", "Cart.Cart"), ("helper", "Cart.add"), ("this->go", "Cart.add"), ("eq", "Cart.operator==")} <= calls and not {c for c, _ in calls} & {"v", "bar", "later", "draw"}


def test_python():
    source = "import a.b\nimport a.c as d\nfrom .tool import run as r, other\nfrom ..up.there import x\n\n@dec(1)\nclass Cart(Base):\n    items = build()\n    @property\n    async def total(self, a=1) -> int:\n        return r(a) if a and self.x or [y for y in z] else d.e.f(2)\n\ndef outer():\n    def inner():\n        try:\n            go()\n        except E:\n            pass\n    return (lambda: inner)()()\n"
    symbols, calls, imports = outline("python", source)
    assert kinds(symbols) == {"Cart": "class", "Cart.total": "method", "outer": "function", "outer.inner": "function"}
    total = symbols["Cart.total"]
    assert (total["signature"], total["return_type"], total["decorators"], total["complexity"]) == ("(self, a=1)", "int", ["property"], 4) and symbols["outer.inner"]["complexity"] == 1
    assert {("r", "Cart.total"), ("d.e.f", "Cart.total"), ("go", "outer.inner")} <= calls and "build" not in {c for c, _ in calls}
    assert imports == [("a", "a"), ("d", "a/c"), ("r", "./tool"), ("other", "./tool"), ("x", "../up/there")]
    symbols, calls, imports = outline("python", "from .m import go\nclass A:\n    def f(self):\n        go(1)\ndef broken(:\n")
    assert {"A": "class", "A.f": "method"}.items() <= kinds(symbols).items() and ("go", "A.f") in calls and imports == [("go", "./m")]


UNITS = {
    "typescript": "export function f%d(a: number) {\n  if (a && b%d(a)) { return g(a); }\n  return [1].map((x) => x + h(x));\n}\n", "rust": "pub fn f%d(a: i32) -> i32 {\n  match a { 0 => g(a), _ => h%d(a) }\n}\n\n",
    "java": "class C%d {\n  int f(int a) {\n    return g%d(a);\n  }}\n", "ruby": "def f%d(a)\n  g(a) if h%d(a)\n  x.each do |y| y.z end\nend\n", "cpp": "int f%d(int a) {\n  if (a) { return g%d(a); }\n  return h(a);\n}\n",
    "go": "func f%d(a int) int {\n  if a > 1 { return g%d(a) }\n  return 1\n}\n", "python": "def f%d(a):\n    if a:\n        return g%d(a)\n\n",
}


@pytest.mark.parametrize("language", UNITS)
def test_long_files(language):
    source = "".join(UNITS[language] % (i, i) for i in range(2500))
    began = time.process_time()
    found = extract_one("f", language, source)
    assert time.process_time() - began < 4 and len(found["symbols"]) >= 2500 and len(found["calls"]) >= 2500


@pytest.mark.parametrize("language", ["typescript", "javascript", "rust", "go", "java", "csharp", "ruby", "php", "c", "cpp", "python"])
def test_broken_and_empty_files(language):
    for source in ("", "}", "{{{", "(((", "class", "function (", "'", "\"", "`${", "/*", "<", "def\nend end", "\u00e9\u4e2d{\u2028", "fn f(", "func (", "impl", "#include", "<?php function", "@", "x" * 10000, "(" * 3000, "{" * 3000):
        extract_one("f", language, source)


def test_unicode_names():
    symbols, calls, _ = outline("typescript", "export function grüße(名: string) { return zähle(名); }\n")
    assert kinds(symbols) == {"grüße": "function"} and calls == {("zähle", "grüße")}
