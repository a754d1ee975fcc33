"""Declarations of Go and TypeScript, and what the index makes of them."""

import json

import pytest

from loomgraph.operators import merge
from loomgraph.plans import index
from loomgraph.sources import extract
from loomgraph.sources.braces import Source, template_end
from loomgraph.sources.declare import declarations

GO = """// package not
package shop

import (
	"fmt"
	alias "net/http"
)
import _ "embed"

type (
	Cart struct {
		Items map[string]struct{ N int }
	}
	ID = string
	Pair[K comparable, V any] struct{ k K; v V }
	Arr [3]int
	Loader interface {
		Load(id string) error
	}
)
type Handler func(w http.ResponseWriter)
type Set[T any] map[T]struct{}

func (c *Cart) Load(
	id string,
) (err error) {
	type inner struct{}
	func() { fmt.Println("func x() {") }()
	return nil
}
func (p Pair[K, V]) Key() K { return p.k }
func (Cart) Static() {}
func G[T any](x T) T {
	return x
}
func external(x int) int
var f = func() {}
"""
SCRIPT = """import { a, b as c } from "./x"
import "side"
import type D from '../d'
const re = /[{"'`]/g, t = `a ${b ? `}{` : "}"} {`
const half = (a) / 2 / b
@Injectable({ x: 1 })
export abstract class Store<T extends { id: string }, U = {}> extends Base<T> implements I<{ a: 1 }> {
  private items: Map<string, { n: number }> = new Map()
  handler = () => { this.x() }
  constructor(private readonly a: string) { super() }
  get size(): number { return 1 }
  get() { return 1 }
  async *walk<K = string>(x: K): AsyncGenerator<{ a: K }> {
    yield x
  }
  @Log() private static async helper(): Promise<{ a: string } | null> { return null }
  abstract nope(): void
  overload(a: string): { b: number }
  overload(a: any): { b: number } { return a }
  #secret() {}
  [Symbol.iterator]() { return 1 }
}
export interface Props { a: string }
export type Fn = (x: number) =>
  string
export const enum Color { Red, Green }
enum E { A = 1 }
export default async function main(): Promise<void> {
  function inner() {}
  class Hidden { m() {} }
}
export function* gen() {}
function sig(a: string): void
function sig(a: any): void {}
export const arrow = async <T,>(x: T): Promise<T> => x, plain = 3, other = function () { return 1 }
const typed: (x: number) => string = (x) => String(x)
const notfn = (a + b) * 2
const pick = cond ? (a) => a : null
if (x) { function cond() {} }
export default class extends Foo { a() {} }
class Base { m() { return `${this.x}` } }
"""


def test_go_scopes():
    found = [(r["kind"], r["receiver"], r["label"], r["exported"], r["line_start"], r["line_end"]) for r in declarations("a.go", GO, "go")]
    assert found == [
        ("package", "", "shop", False, 2, 2), ("import", "", "fmt", False, 5, 5), ("import", "", "net/http", False, 6, 6), ("import", "", "embed", False, 8, 8),
        ("struct", "", "Cart", True, 11, 13), ("alias", "", "ID", True, 14, 14), ("struct", "", "Pair", True, 15, 15), ("alias", "", "Arr", True, 16, 16), ("interface", "", "Loader", True, 17, 19),
        ("alias", "", "Handler", True, 21, 21), ("alias", "", "Set", True, 22, 22), ("method", "Cart", "Load", True, 24, 30), ("method", "Pair", "Key", True, 31, 31), ("method", "Cart", "Static", True, 32, 32),
        ("function", "", "G", True, 33, 35), ("function", "", "external", False, 36, 36),
    ]


def test_script_scopes():
    rows = declarations("a.ts", SCRIPT, "typescript")
    assert [(r["kind"], r["label"], r["exported"]) for r in rows if r["kind"] not in ("import", "method")] == [
        ("class", "Store", True), ("interface", "Props", True), ("type", "Fn", True), ("enum", "Color", True), ("enum", "E", False), ("function", "main", True),
        ("function", "gen", True), ("function", "sig", False), ("function", "arrow", True), ("function", "other", True), ("function", "typed", False), ("class", "Base", False),
    ]
    assert [r["label"] for r in rows if r["kind"] == "import"] == ["./x", "side", "../d"]
    assert [(r["receiver"], r["label"], r["exported"]) for r in rows if r["kind"] == "method"] == [
        *(("Store", n, e) for n, e in (("constructor", True), ("size", True), ("get", True), ("walk", True), ("helper", False), ("overload", True), ("#secret", False), ("[Symbol.iterator]", True))), ("Base", "m", False),
    ]
    store = next(r for r in rows if r["label"] == "Store")
    assert (store["base"], store["line_start"], store["line_end"]) == ("Base", 6, 22)
    assert next((r["line_start"], r["line_end"]) for r in rows if r["label"] == "Fn") == (24, 25)


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_line_ends_change_nothing(ending):
    for text, language in ((GO, "go"), (SCRIPT, "typescript")):
        assert declarations("x", text.replace("\n", ending), language) == declarations("x", text, language)


def test_awkward_files():
    assert declarations("x", "", "go") == [] and declarations("x", "", "typescript") == []
    for text in ("type T struct {\n", "func (", "func f(\n}", "type (\n", "import (", "package", "type"):
        declarations("x", text, "go")
    for text in ("class A {\n m() {", "export", "class", "const a = ", "@", "export class {", "enum", "function", "class A { [", "a = `${`", "x = /[/", "const {a, b} = (c"):
        declarations("x", text, "typescript")
    assert [r["label"] for r in declarations("x", "class A { m() {} }\nclass B {\n m() {", "typescript")] == ["A", "m"]
    text = "a `x ${`y ${'`'} `} z` b"
    assert text[template_end(text, 2) :] == " b"
    assert [t.text for t in Source("a = /'/ ; b", "typescript").t] == ["a", "=", "/'/", ";", "b"]


def test_every_intent_has_its_symbol(spark):
    files = spark.createDataFrame([("d/a.go", "go", GO), ("d/a.ts", "typescript", SCRIPT)], "rel_path string, language string, content string")
    label = lambda owner, name: f"{owner}.{name}" if owner else name
    declared = {(r.rel_path, label(r.receiver, r.label)) for r in extract.declarations(files).collect()}
    intents = {(r.rel_path, label(r.owner, r.name)) for r in extract.function_intents(files).collect()}
    assert intents <= declared and ("d/a.go", "G") in intents and ("d/a.ts", "main") in intents


def test_index_joins_intents_and_bases(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.go").write_text(GO)
    (root / "a.ts").write_text(SCRIPT)
    (root / "m.py").write_text("class A:\n    pass\n\n\nclass B(A, dict):\n    pass\n")
    store = merge.Versions(spark, str(tmp_path / "store"))
    index.index(spark, str(root), store, "p", "r1")
    nodes = {r.id: r.canonical_id for r in store.read("nodes").collect()}
    names = {(nodes[r.node_id], json.loads(r.payload)["name"]) for r in store.read("iir").collect()}
    assert not [x for x in names if x[0].split(":")[1].split(".")[-1] != x[1]] and {("a.go:G", "G"), ("a.go:Cart.Load", "Load"), ("a.ts:arrow", "arrow")} <= names
    extends = {(nodes[r.source_id], nodes[r.target_id], r.source_class) for r in store.read("edges").where("type = 'extends'").collect()}
    assert extends == {("a.ts:Store", "a.ts:Base", "speculative"), ("m:B", "m:A", "speculative")}
    assert index.dangling(store).count() == 0


def test_another_version_of_an_extractor_reads_files_again(spark, tmp_path, monkeypatch):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.go").write_text("package a\n\nfunc F() {}\n")
    store = merge.Versions(spark, str(tmp_path / "store"))
    assert index.index(spark, str(root), store, "p", "r1")["processed"] == 1
    assert index.index(spark, str(root), store, "p", "r2")["processed"] == 0
    old = index.fingerprint()
    monkeypatch.setitem(index.EXTRACTORS, "go", index.version_of(extract))
    now = index.fingerprint(index.EXTRACTORS)
    monkeypatch.setattr(index, "fingerprint", lambda: now)
    assert old != now and index.index(spark, str(root), store, "p", "r3")["processed"] == 1
