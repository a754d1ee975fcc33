"""Requests, records, plans and streams beside the registered queries."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import compile, intents, ir, merge, records
from loomgraph.operators.merge import Versions
from loomgraph.plans import index as plan
from loomgraph.plans import order
from loomgraph.sources import extract, syntax
from loomgraph.streaming import watch

P = order.Plugin


def test_plugins_in_order():
    names = lambda ps: [p.id for p in ps]
    plain = [P("b"), P("a")]
    assert names(order.in_order(plain)) == ["b", "a"]
    some = [P("z", requires=("x",)), P("m", enriches=("go",)), P("b", provides=("x", "language:go")), P("a")]
    assert names(order.in_order(some)) == ["a", "b", "m", "z"]
    assert [names(x) for x in order.layers([some[2], some[0], some[1]])] == [["b"], ["z", "m"]]
    assert [names(x) for x in order.layers([P("p", provides=("x",)), P("old"), P("q", provides=("y",)), P("r", requires=("y",))])] == [["p"], ["old"], ["q"], ["r"]]
    for bad, why in (([P("a", requires=("x",))], "no plug-in provides"), ([P("a", requires=("x",)), P("b", provides=("x",)), P("c", provides=("x",))], "several"), ([P("a", provides=("x",), requires=("x",))], "of itself"), ([P("a", provides=("x",), requires=("y",)), P("b", provides=("y",), requires=("x",))], "each other")):
        with pytest.raises(order.PlanError, match=why):
            order.in_order(bad)
    assert names(order.matching([P("e", (".PY",)), P("g", match=order.glob_match("api/*"))], "api/x.py")) == ["e", "g"]


def test_decisions():
    order.check_decisions({"a": ["b"], "b": []})
    with pytest.raises(order.PlanError, match="unknown"):
        order.check_decisions({"a": ["b"]})
    with pytest.raises(order.PlanError, match="themselves"):
        order.check_decisions({"a": ["b"], "b": ["a"]})


RULES = """rules:
- id: no-null
  target: FunctionIntent
  severity: error
  require: {forbidConditionShape: {ops: ["=="], operandLiteral: "null"}}
- id: declare-side-effects
  target: FunctionIntent
  severity: info
  require: {sideEffectsDeclared: false}
"""


def test_rule_packs(spark, tmp_path):
    pytest.importorskip("yaml")
    inner = tmp_path / "a" / "b"
    inner.mkdir(parents=True)
    assert intents.discover_rules(str(inner)) is None
    (tmp_path / "iir.rules.yml").write_text(RULES)
    path, found = intents.discover_rules(str(inner))
    assert path.endswith("iir.rules.yml") and [r["id"] for r in found] == ["no-null", "declare-side-effects"]
    rules, errors = intents.effective_rules([RULES, "rules: []", "{"])
    assert [r["id"] for r in rules] == ["function-explicit-return-type", "declare-side-effects", "expected-failures-use-result", "no-null"] and len(errors) == 2
    for bad in ("rules: [{id: a, target: X, severity: error}]", "rules: [{id: a, target: FunctionIntent, severity: bad}]", "rules: [{id: a, target: FunctionIntent, severity: info, extra: 1}]", "rules: [{id: a, target: FunctionIntent, severity: info, require: {forbidConditionShape: {}}}]", "rules: [{id: a, target: FunctionIntent, severity: info}, {id: a, target: FunctionIntent, severity: info}]"):
        with pytest.raises(intents.BadPack):
            intents.load_rules(bad)
    node = "array<array<struct<id:int,parent:int,op:string,text:string>>>"
    rows = [(1, "public", [], ("int", True), None, [[(0, -1, "==", ""), (1, 0, "lit", "null")]]), (2, "private", ["E"], ("int", False), [], [[(0, -1, "==", ""), (1, 0, "lit", "1")]])]
    df = spark.createDataFrame(rows, f"node_id int, visibility string, failures array<string>, returns struct<type:string,explicit:boolean>, effects array<string>, shapes {node}")
    got = {(r.node_id, r.rule): r.status for r in intents.evaluate_rules(df, rules).collect()}
    assert [got[1, r["id"]] for r in rules] == ["passed", "passed", "skipped", "failed"] and [got[2, r["id"]] for r in rules] == ["skipped", "warned", "warned", "passed"]


def test_declared_intents():
    pytest.importorskip("yaml")
    made = intents.load_intent("kind: FunctionIntent\nname: f\nlanguage: go\ninputs: [{name: a}]\nreturns: {type: int}\n")
    assert made["visibility"] == "public" and made["origin"] == "declared" and made["inputs"] == [{"name": "a", "type": "unknown"}] and made["returns"] == {"type": "int", "explicit": True}
    for bad in ("kind: Other\nname: f\nlanguage: go", "kind: FunctionIntent\nlanguage: go", "kind: FunctionIntent\nname: f\nlanguage: go\ntypo: 1", "kind: FunctionIntent\nname: f\nlanguage: go\nbehavior: [{when: a}]"):
        with pytest.raises(intents.BadPack):
            intents.load_intent(bad)


def test_requests_at_the_edge(spark):
    rows = [(1, None), (2, ""), (3, '<anchor type="symbol" id=""/><anchor type="file" id="f" ><predicate name="callgraph" value="no"/><predicate name="callgraph" value="true"/><k_limit>x</k_limit><max_loops>-4</max_loops><model_tier> fast </model_tier>')]
    got = {r.id: r for r in ir.tools(ir.validate(ir.extract(spark.createDataFrame(rows, "id int, text string")))).collect()}
    assert got[1].mode == got[2].mode == "thinking" and got[2].error == "no anchors"
    assert [tuple(a) for a in got[3].anchors] == [("file", "f", "medium")] and got[3].predicates == {"callgraph": "true"} and got[3].error == "no open queries"
    assert got[3].tools == ["callgraph", "filecontext"] and (got[3].max_loops, got[3].k_limit, got[3].model_tier) == (1, 0, "fast")
    assert [ir.clamp("search", n) for n in (None, 0, 7, 99)] == [10, 10, 7, 50]
    cut = spark.createDataFrame([("é" * 1500,), ("short",)], "t string").select(ir.truncated(F.col("t")).alias("t")).collect()
    assert cut[0].t == "é" * 1000 + "\n_(content truncated at 2000 chars)_" and cut[1].t == "short"


def test_policies():
    a = {"id": "a", "version": "v1", "phase": "enrich", "severity": "info"}
    assert [p["id"] for p in compile.merge_policies([a], [a | {"id": "b", "supersedes": ["a"], "override_rationale": "why"}])] == ["b"]
    for bad in ([[a], [a]], [[a | {"id": "b", "supersedes": ["a"]}]], [[a | {"supersedes": ["gone"], "override_rationale": "x"}]], [[a | {"phase": "odd"}]], [[a | {"version": " "}]], [[a | {"add": ("k", " ", True)}]]):
        with pytest.raises(order.PlanError):
            compile.merge_policies(*bad)


def test_runs_that_fail_and_runs_over_some_paths(spark, tmp_path, monkeypatch):
    src, store = tmp_path / "src", Versions(spark, f"file://{tmp_path}/store")
    src.mkdir()
    (src / "a.py").write_text("def one():\n    pass\n")
    (src / "b.py").write_text("def two():\n    pass\n")
    run = lambda name, **how: plan.index(spark, f"file://{src}", store, "p", name, **how)
    labels = lambda: {r.label for r in store.read("nodes").where("type = 'symbol'").collect()}
    monkeypatch.setattr(plan, "symbols", lambda files: files.select(F.raise_error(F.lit("broken")).cast("string").alias("rel_path")))
    with pytest.raises(plan.FailedRun):
        run("r0")
    assert not plan.ready(store) and [(r.run, r.status) for r in store.read("runs").collect()] == [("r0", "failed")]
    monkeypatch.undo()
    run("r1")
    assert plan.ready(store) and labels() == {"one", "two"}
    (src / "a.py").write_text("def three():\n    pass\n")
    (src / "b.py").unlink()
    (src / "c.py").write_text("def four():\n    pass\n")
    run("r2", only=["a.py", "../x"])
    assert labels() == {"three", "two"}
    run("r3", only=["b.py"])
    assert labels() == {"three"}
    monkeypatch.setattr(plan, "symbols", lambda files: files.select(F.raise_error(F.lit("broken")).cast("string").alias("rel_path")))
    with pytest.raises(plan.FailedRun):
        run("r4")
    assert plan.ready(store) and labels() == {"three"}
    monkeypatch.undo()
    run("r5")
    assert labels() == {"three", "four"} and store.read("runs").count() == 6


def test_admission(spark):
    rows = spark.createDataFrame([(f"f{k}", 64 * 1024) for k in range(200)] + [("big", 1 << 30)], "rel_path string, length long")
    got = plan.admitted(rows, 1, most=1 << 24, buckets=1).groupBy("part").agg(F.sum("units").alias("u"), F.max("units").alias("m")).collect()
    assert sum(r.u for r in got) == 200 * 32 + 256 and all(r.u <= 2 * 256 for r in got)


def test_streams_of_writes_and_state(spark, tmp_path):
    rows = [("activation", "p", f"n{k % 3}", str(k), k, 0) for k in range(30)] + [("weight", "p", "w", "x", 100 + k, 2) for k in range(5)]
    writes = spark.createDataFrame(rows, "op string, project_id string, entity string, payload string, seq long, delta long")
    writes.repartition(4).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(writes.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []
    watch.pending_batches(read(), lambda df, k: seen.append([tuple(r) for r in df.collect()]), f"{tmp_path}/c1").awaitTermination()
    assert len(seen) == 4 and all(len({(r[0], r[2]) for r in b}) == len(b) for b in seen) and sum(r[5] for b in seen for r in b) == 10
    store = Versions(spark, f"file://{tmp_path}/store")
    updates = read().where("op = 'activation'").select(F.col("entity").alias("node_id"), (F.lit(30.0) - F.col("seq")).alias("activation"), "seq")
    watch.keep_state(watch.running_activation(updates), store, "activation", ["node_id"], f"{tmp_path}/c2").awaitTermination()
    assert {(r.node_id, r.activation, r.peak) for r in store.read("activation").collect()} == {("n0", 3.0, 30.0), ("n1", 2.0, 29.0), ("n2", 1.0, 28.0)}
    weights = read().where("op = 'weight'").select(F.col("entity").alias("edge_id"), F.col("seq").cast("double").alias("weight"), F.col("delta").alias("co_activations"), "seq")
    watch.keep_state(watch.running_weights(weights), store, "weights", ["edge_id"], f"{tmp_path}/c3").awaitTermination()
    assert [tuple(r) for r in store.read("weights").collect()] == [("w", 104.0, 10)] and store.read("activation").count() == 3


def test_watched_folder(spark, tmp_path):
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "a.py").write_text("x")
    got = []
    go = lambda: watch.in_batches(watch.once_each(watch.file_changes(spark, f"file://{folder}", "p"), ["event_id"], "1 hour"), lambda df, _: got.extend(r.path.rpartition("/")[2] for r in df.collect()), f"{tmp_path}/c").awaitTermination()
    go()
    (folder / "b.py").write_text("y")
    go()
    assert sorted(got) == ["a.py", "b.py"]


def test_syntax_rows(spark):
    files = spark.createDataFrame([("a.py", "python", "def f(x):\n    return g(x)\n"), ("bad.py", "python", "def ("), ("c.go", "go", "x")], "rel_path string, language string, content string")
    nodes = merge.settle(syntax.syntax(files), "t")
    assert {r.rel_path for r in nodes.select("rel_path").distinct().collect()} == {"a.py"}
    f = nodes.where("type = 'FunctionDef'")
    assert [(r.field, r.name, r.line, r.end_line) for r in f.collect()] == [("body", "f", 1, 2)]
    assert [r.type for r in syntax.children(nodes, f, "body").collect()] == ["Return"] and syntax.first_below(nodes, f, "Call").count() == 1
    assert records.token_hash("t") == "e3b98a4da31a127d4bde6e43033f66ba274cab0eb7eb1c70ec41402bf6273dd8"


GO = """package shop
import (
	"errors"
	"net/http"
	yaml "gopkg.in/yaml.v2"
	"github.com/x/bar/v2"
)
var ErrGone = errors.New("gone")
func (c *Cart) Load(ctx context.Context, id, name string, opts ...Option) (*Item, error) {
	// if comment { }
	if id == "" {
		return nil, errors.New("empty_id")
	}
	if v, ok := c.m[id]; !ok && v.Count >= -1 {
		log.Println("x")
		return nil, ErrGone
	} else if name != "b" || c.closed == true {
		c.store.Save(id)
	} else {
		panic("bad state")
	}
	resp, err := http.Get("u" + id)
	if err != nil { return nil, err }
	switch name {
	case "a", "b":
		return one(), nil
	default:
		bar.Do(resp)
	}
	switch x := v.(type) {
	case int:
		return nil, fmt.Errorf("int %d", x)
	}
	go func() {
		if inner { tracker.Emit(1) }
	}()
	return &Item{ID: id}, nil
}
func helper[T any](xs []T, f func(T) bool) map[string]interface{} {
	for _, x := range xs {
		if f(x) {
			yaml.Marshal(x)
		}
	}
	return nil
}
func plain(int, string) error { return errors.New("p") }
"""

TS = """import axios, { get as fetchIt, type T } from "axios"
import * as fs from 'fs'
export async function load(id: string, n?: number, ...rest: string[]): Promise<{a: number}> {
  if (!id) throw new Error("empty id");
  if (n === undefined || n < -3) {
    return axios.get(id)
  } else {
    console.log("no")
  }
  switch (id) {
    case "x":
      fs.writeFileSync(id, "y");
      break;
    default:
      throw new NotFound()
  }
  const cb = (z) => { if (z) { return 1 } }
  items.forEach(function (q) { if (q) save(q) })
  try { await fetchIt() } catch (e) { throw e }
  return { a: n }
}
const add = (a: number, b = 2): number => a + b
export const each = async (xs) => {
  if (xs.length > 0 && xs.ok)
    return JSON.parse(xs)
  other.update(xs)
}
class K { m() { if (a) { return 1 } } }
function two({ a, b }: Props, cb: (x: number) => void): void {
  if (a) { cb(1) } else if (b) { throw "late" }
}
"""


def test_go_and_typescript_intents(spark):
    files = spark.createDataFrame([("a.go", "go", GO), ("a.ts", "typescript", TS), ("bad.go", "go", "func f( {"), ("bad.ts", "typescript", "function ( { ] if"), ("none.ts", "typescript", None)], "rel_path string, language string, content string")
    got = {r.name: r for r in extract.function_intents(files).collect()}
    assert set(got) == {"Load", "helper", "plain", "load", "add", "each", "two"}
    load = got["Load"]
    assert (load.visibility, load.returns.type, [(i["name"], i["type"]) for i in load.inputs]) == ("public", "(*Item, error)", [("ctx", "context.Context"), ("id", "string"), ("name", "string"), ("opts", "...Option")])
    assert [(b["when"], b["then_op"], b["then_value"]) for b in load.behavior] == [
        ('id == ""', "return", 'nil, errors.New("empty_id")'), ("!ok && v.Count >= -1", "return", "nil, ErrGone"), ('name != "b" || c.closed == true', "invoke", "c.store.Save"), ("else", "throw", "bad state"),
        ("err != nil", "return", "nil, err"), ('name == "a" || name == "b"', "return", "one(), nil"), ("else", "invoke", "bar.Do"), ("v is int", "return", 'nil, fmt.Errorf("int %d", x)'),
    ]
    assert load.behavior[0]["when_expr"] == '{"op":"==","args":[{"op":"path","text":"id"},{"op":"lit","text":"\\"\\""}]}'
    assert [(e["name"], e["kind"], e["basis"]) for e in load.effects] == [("bar.Do", "unclassified", "heuristic"), ("c.store.Save", "mutation", "heuristic"), ("http.Get", "network", "resolved"), ("tracker.Emit", "mutation", "heuristic")]
    assert [(f.code, f.kind) for f in load.failures] == [("ErrGone", "sentinel"), ("bad state", "constructed"), ("empty_id", "constructed"), ("err", "propagated"), ("int %d", "constructed")]
    assert got["helper"].returns.type == "map[string]interface{}" and got["helper"].visibility == "private" and [(f.code, f.kind) for f in got["plain"].failures] == [("p", "constructed")]
    ts = got["load"]
    assert (ts.visibility, ts.returns.type, [(i["name"], i["type"]) for i in ts.inputs]) == ("public", "Promise<{a: number}>", [("id", "string"), ("n", "number"), ("rest", "string[]")])
    assert [(b["when"], b["then_op"], b["then_value"]) for b in ts.behavior] == [("!id", "throw", "empty id"), ("n === undefined || n < -3", "return", "axios.get(id)"), ("else", "invoke", "console.log"), ('id === "x"', "invoke", "fs.writeFileSync"), ("else", "throw", "NotFound")]
    assert [(e["name"], e["kind"]) for e in ts.effects] == [("axios.get", "network"), ("fs.writeFileSync", "io"), ("save", "mutation")]
    assert [(f.code, f.kind) for f in ts.failures] == [("NotFound", "sentinel"), ("e", "propagated"), ("empty id", "constructed")]
    assert got["add"].returns.type == "number" and got["each"].visibility == "public" and [b["when"] for b in got["each"].behavior] == ["xs.length > 0 && xs.ok"]
    assert [(b["when"], b["then_value"]) for b in got["two"].behavior] == [("a", "cb"), ("b", "late")] and [i["name"] for i in got["two"].inputs] == ["{ a, b }", "cb"]
