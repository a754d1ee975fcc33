"""Expected values of the model on small graphs, and properties that hold on any."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.catalog import changes
from loomgraph.functions import ids
from loomgraph.operators import activation, intents, merge, reads, search, traverse
from loomgraph.sources import extract, tables, walk
from loomgraph.streaming import watch

NODES = "id string, project_id string, type string, label string, canonical_id string, source_class string, source_file string, kind string, exported boolean, line_start long, line_end long"


def small(spark, edges, activations=(), labels=None):
    """A graph of edges (source, target, weight or None) of type calls in project p."""
    names = sorted({x for s, t, _ in edges for x in (s, t)})
    nodes = spark.createDataFrame([(n, "p", "symbol", (labels or {}).get(n, n), (labels or {}).get(n, n), "structural", None, None, None, None, None) for n in names], NODES)
    e = spark.createDataFrame([(f"{s}-{t}", "p", s, t, "calls", "structural") for s, t, _ in edges], "id string, project_id string, source_id string, target_id string, type string, source_class string")
    w = spark.createDataFrame([(f"{s}-{t}", float(x), "structural") for s, t, x in edges if x is not None], "edge_id string, weight double, source_class string")
    a = spark.createDataFrame(list(activations), "node_id string, activation double")
    return tables.Graph(nodes, e, w, a)


def seeds(spark, rows):
    return spark.createDataFrame([("s", n, float(a)) for n, a in rows], "set string, id string, activation double")


def spread(spark, g, rows):
    return {r.id: round(r.activation, 6) for r in activation.spread(g, seeds(spark, rows)).collect()}


def test_identities(spark):
    row = spark.range(1).select(ids.node_id(F.lit("a"), F.lit("symbol"), F.lit("x.Y")).alias("n"), ids.edge_id(F.lit("s"), F.lit("calls"), F.lit(None)).alias("e")).first()
    assert row.n == hashlib.sha256(b"a:symbol:x.Y").hexdigest()[:32] and row.e == hashlib.sha256(b"s:calls:").hexdigest()[:32]


def test_chain_and_two_paths(spark):
    chain = small(spark, [("A", "B", 0.5), ("B", "C", 0.5), ("C", "D", 0.5), ("D", "E", 0.5)])
    assert spread(spark, chain, [("A", 1.0)]) == {"A": 1.0, "B": 0.3}
    two = small(spark, [("A", "B", 0.9), ("B", "C", 0.9), ("A", "D", 0.2), ("D", "E", 0.2)])
    found = spread(spark, two, [("A", 1.0)])
    assert found["C"] == 0.2916 and found["D"] == 0.12 and "E" not in found
    assert spread(spark, small(spark, [("A", "B", 0.8)]), [("A", 1.0)]) == {"A": 1.0, "B": 0.48}
    assert spread(spark, small(spark, [("A", "B", None), ("A", "C", 0.0)]), [("A", 0.5), ("A", 1.0)]) == {"A": 1.0, "B": 0.6, "C": 0.3}


def test_spreading_equals_best_path(spark):
    rng = random.Random(8)
    edges = {(rng.randrange(12), rng.randrange(12)): rng.choice([None, 0.0, 0.3, 0.7, 1.0]) for _ in range(40)}
    best = {0: 1.0, 1: 0.6}
    for _ in range(6):
        for (s, t), w in edges.items():
            x = best.get(s, 0) * 0.6 * (1.0 if w is None else 0.5 if w <= 0 else w)
            if x >= 0.1 and x > best.get(t, 0):
                best[t] = x
    g = small(spark, [(str(s), str(t), w) for (s, t), w in edges.items()])
    assert spread(spark, g, [("0", 1.0), ("1", 0.6)]) == {str(k): round(v, 6) for k, v in best.items()}


def test_hebbian_and_decay(spark):
    g = small(spark, [("A", "B", 0.5), ("B", "C", 0.5)])
    new = {r.edge_id: r for r in activation.hebbian(g, spark.createDataFrame([("A", 0.8), ("B", 0.6)], "id string, activation double")).collect()}
    assert round(new["A-B"].weight, 6) == 0.548 and new["A-B"].co_activations == 1
    assert round(new["B-C"].weight, 6) == 0.495 and new["B-C"].co_activations == 0


def test_reach_keeps_cycles_and_fewest_hops(spark):
    g = small(spark, [("A", "B", 1), ("B", "A", 1), ("B", "C", 1), ("C", "D", 1), ("D", "E", 1), ("A", "X", 0.05)])
    found = {r.id: r.hops for r in traverse.reach(traverse.calls(g), spark.createDataFrame([("A",)], "id string"), 3).collect()}
    assert found == {"B": 1, "A": 2, "C": 2, "D": 3}
    got = traverse.proposed_calls(g, spark.createDataFrame([("A",)], "id string")).collect()
    assert {r.target_id for r in got} == {"A", "C", "D"}


def test_search_ranks_exact_labels_first(spark):
    labels = {"1": "CartController.load_cart", "2": "Store.api_cart_token", "3": "Other.cart"}
    g = small(spark, [("1", "2", 1), ("2", "3", 1)], labels=labels)
    found = search.search(g, spark.createDataFrame([("CartController load_cart",), ("?",)], "query string")).orderBy("rank").collect()
    assert found[0].id == "1" and {r.id for r in found} == {"1"}


def test_many_queries_find_what_few_do(spark):
    rng = random.Random(5)
    names = ["".join(rng.choices("abcé_/", k=rng.randint(1, 9))) for _ in range(120)]
    g = small(spark, [(str(k), str(k + 1), 1) for k in range(119)], labels={str(k): n for k, n in enumerate(names)})
    asked = ["".join(rng.choices("abcé_ ", k=rng.randint(1, 7))) for _ in range(60)] + ["ab", "é"]
    queries = spark.createDataFrame([(q,) for q in sorted(set(asked))], "query string")
    shown = lambda few: sorted((r.query, r.id, r.score, r.rank) for r in search.search(g, queries, few=few).collect())
    assert shown(1000) == shown(0) and len(shown(0)) > 50


def test_related_ranks_all_that_is_found(spark):
    plain = [f"word{k:02}" for k in range(15)]
    names = [f"route{k:03}" for k in range(130)] + ["a/much/longer/id/than/the/others:route", *plain, "at/a/route/some/word/beside"]
    rows = [(n, "p", "file", n.split(":")[-1], n, "structural", None, None, None, None, None) for n in names]
    g = tables.Graph(spark.createDataFrame(rows, NODES), None, None, None)
    # an exact label comes first, however many shorter ids there are
    assert [r.id for r in search.related(g, ["route"], limit=2).orderBy("rank").collect()] == [names[130], "route000"]
    # what a word of the query finds comes before the patterns, however many others without a pattern it finds
    assert [r.id for r in search.related(g, ["route"], "word", limit=2).orderBy("rank").collect()] == [names[-1], names[130]]


def test_cycle_settles(spark):
    g = small(spark, [("A", "B", 0.9), ("B", "C", 0.9)])
    anchors = spark.createDataFrame([("p", "symbol", "A", "high")], "project_id string, kind string, ref string, confidence string")
    assert {r.id for r in activation.cycle(g, anchors, k=5, loops=4).collect()} == {"A", "B", "C"}


def state(spark, nodes, edges, owners, hashes):
    return merge.State(
        spark.createDataFrame(nodes, "id string, label string"), spark.createDataFrame(edges, "id string, source_id string, target_id string"),
        spark.createDataFrame(owners, "rel_path string, id string, run string"), spark.createDataFrame(hashes, "rel_path string, hash string"),
    )


@pytest.mark.parametrize(("scope", "left"), [("full", {"a"}), ("incremental", {"a", "c"}), ("paths", {"a", "c", "d"})])
def test_reconcile_scopes(spark, scope, left):
    live = state(spark, [("a", "A"), ("b", "B"), ("c", "C"), ("d", "D")], [("ab", "a", "b"), ("ac", "a", "c")], [("f1", "a", "r0"), ("f1", "b", "r0"), ("f2", "c", "r0"), ("f3", "d", "r0")], [("f1", "h"), ("f2", "h"), ("f3", "h")])
    staged = state(spark, [("a", "A2")], [], [("f1", "a", "r1")], [("f1", "h1")])
    files = spark.createDataFrame([("f1", "indexed"), ("f2", "walked")], "rel_path string, status string")
    out = merge.reconcile(live, staged, files, "r1", scope)
    nodes = {r.id: r.label for r in out.nodes.collect()}
    assert set(nodes) == left and nodes["a"] == "A2"
    assert {r.id for r in out.edges.collect()} == ({"ac"} if "c" in left else set())
    again = merge.reconcile(out, staged, files, "r1", scope)
    assert {r.id for r in again.nodes.collect()} == left
    broken = state(spark, [("a", "A2")], [("az", "a", "zz")], [("f1", "a", "r1")], [("f1", "h1")])
    with pytest.raises(merge.BrokenEdges):
        merge.reconcile(live, broken, files, "r1", scope)


def test_derived_edges_are_sought_only_for_what_is_dead_and_no_node(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "a")], "source_id string, target_id string").withColumn("type", F.lit("calls"))
    edges = e.select(ids.edge_id(F.col("source_id"), F.col("type"), F.col("target_id")).alias("id"), "*")
    name = {(r.source_id, r.target_id): r.id for r in edges.collect()}
    files = spark.createDataFrame([("f1", "indexed")], "rel_path string, status string")

    def left(owned):
        live = state(spark, [("a", "A"), ("b", "B"), ("c", "C")], [("x", "a", "b")], [("f1", "a", "r0"), ("f1", "b", "r0"), ("f1", "c", "r0"), *owned], [("f1", "h")])
        live.edges = edges
        staged = state(spark, [("a", "A"), ("c", "C")], [("x", "a", "b")], [("f1", "a", "r1"), ("f1", "c", "r1")], [("f1", "h")])
        staged.edges = edges.limit(0)
        before = len(tables._WRITTEN)
        out = merge.reconcile(live, staged, files, "r1", "full", check=False, derived=True)
        return {r.id for r in out.edges.collect()}, [x for x in tables._WRITTEN[before:] if "/owned-edges" in x]

    assert left([]) == ({name["a", "c"], name["c", "a"]}, [])
    found, sought = left([("f1", name["a", "c"], "r0")])
    assert found == {name["c", "a"]} and len(sought) == 1



def test_versions_show_whole_publications(spark, tmp_path):
    v = merge.Versions(spark, f"file://{tmp_path}/v")
    assert v.current() == 0
    v.publish({"a": spark.range(3), "b": spark.range(5)})
    v.publish({"a": spark.range(7)})
    assert (v.current(), v.read("a").count(), v.read("b").count(), v.read("a", 1).count()) == (2, 7, 5, 3)


def test_behaviour_rules_and_shapes(spark):
    branch = "array<struct<when_expr:string,then_op:string,then_value:string>>"
    rows = [([("x", "return", "1")], [("x", "return", "1")]), ([("x", "return", "1")], [("y", "return", "1")]), ([(None, "return", "1")], [("y", "return", "1")]), ([("x", "return", "1")], []), ([], [("x", "return", "1")])]
    got = spark.createDataFrame(rows, f"a {branch}, b {branch}").select(intents.compare_behaviour(F.col("a"), F.col("b")).alias("f")).collect()
    assert [[(x.kind, x.severity) for x in r.f] for r in got] == [[], [("behavior", "warning")], [("unsupported_comparison", "info")], [("unsupported_comparison", "info")], []]
    assert [r["id"] for r in intents.merge_rules(intents.RULES, [{"id": "declare-side-effects"}, {"id": "new"}])] == ["function-explicit-return-type", "declare-side-effects", "expected-failures-use-result", "new"]


NESTED = """
import math, requests
from net import http as web
from sqlalchemy import db

def nested(a: int, b, *c, d=1, **e):
    for x in c:
        if a > 1:
            b.save(x)
    math.sqrt(a)
    requests.get(web.x())
    db.run()
    def inner():
        if d:
            raise ValueError("no")
    if not b:
        return
    else:
        raise err
"""


def test_python_extraction(spark):
    text = 'class Missing(Exception):\n    pass\n\n\ndef load(user_id):\n    if user_id == "":\n        raise ValueError("empty_id")\n    if user_id == "gone":\n        raise Missing\n    return user_id\n\n\ndef again(fn):\n    try:\n        fn()\n    except Exception:\n        raise\n\n\ndef grade(score):\n    match score:\n        case 100:\n            return "perfect"\n        case _:\n            return "other"\n' + NESTED
    files = spark.createDataFrame([("m/a.py", "python", text), ("bad.py", "python", "def ("), ("x.go", "go", 'package shop\n\nimport "fmt"\n\nfunc (c *Cart) Load(id string) error {\nfunc helper() {\ntype Store interface {\n')], "rel_path string, language string, content string")
    found = {r.name: r for r in extract.python_intents(files).collect()}
    load = found["load"]
    assert [(b["when"], b["then"], b["then_op"], b["then_value"]) for b in load.behavior] == [('user_id == ""', 'raise ValueError("empty_id")', "throw", "empty_id"), ('user_id == "gone"', "raise Missing", "throw", "Missing")]
    assert load.behavior[0]["when_expr"] == '{"op":"==","args":[{"op":"path","text":"user_id"},{"op":"lit","text":"\\"\\""}]}'
    assert [(f.code, f.kind) for f in load.failures] == [("Missing", "sentinel"), ("empty_id", "constructed")]
    assert [(f.code, f.kind) for f in found["again"].failures] == [("propagated", "propagated")]
    assert [(b["when"], b["then_value"]) for b in found["grade"].behavior] == [("score == 100", '"perfect"'), ("else", '"other"')]
    nested = found["nested"]
    assert [(b["when"], b["then_op"], b["then_value"]) for b in nested.behavior] == [("a > 1", "invoke", "b.save"), ("not b", "return", None), ("else", "throw", "err")]
    assert [(i["name"], i["type"]) for i in nested.inputs] == [("a", "int"), ("b", "unknown"), ("*c", "unknown"), ("d", "unknown"), ("**e", "unknown")]
    assert [(e["name"], e["kind"], e["basis"]) for e in nested.effects] == [("b.save", "mutation", "heuristic"), ("db.run", "db", "resolved"), ("requests.get", "network", "resolved"), ("web.x", "network", "resolved")]
    assert [(f.code, f.kind) for f in nested.failures] == [("err", "propagated"), ("no", "constructed")]
    assert [r.type for r in extract.python_symbols(files).where("rel_path = 'bad.py'").collect()] == ["file"]


def test_walk(spark, tmp_path):
    for name in ("a/b.py", "a/c.ts", "node_modules/x.js", "gen/d.py", "e.txt", "a/__init__.py", "a/_util.py", "a/.hidden.py", "a/x.log", "out/y.py", "a/out/z.py", "__pycache__/b.py", "a/.cache/q.py", "dist/k.py", "src/made/m.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    (tmp_path / "big.py").write_text("y" * 2000)
    (tmp_path / ".gitignore").write_text("# made\n*.log\n!a/x.log\nout/\n/src/made\n")
    found = walk.files(spark, f"file://{tmp_path}", ["gen"], most_bytes=1000)
    # a pattern without a slash asks for a folder before it, so out/ of the root stays and a/out goes
    kept = {"a/b.py", "a/__init__.py", "a/_util.py", "a/.hidden.py", "out/y.py", "dist/k.py"}
    assert {(r.rel_path, r.language) for r in found.collect()} == {(k, "python") for k in kept} | {("a/c.ts", "typescript"), ("e.txt", None), (".gitignore", None)}
    as_column = found.withColumn("skip", walk.ignored(F.col("rel_path"), ["a/*.ts", "dist"]))
    assert {r.rel_path for r in as_column.where("skip").collect()} == {"a/c.ts", "dist/k.py"}
    globs = {"a/**": ["a/b/c"], "a/*": ["a/b"], "[!x]?.{py,go}": ["ab.py", "ab.go"]}
    assert all(walk.is_ignored(p, [g]) for g, ps in globs.items() for p in ps)
    assert not any(walk.is_ignored(p, [g]) for g, p in {"a/*": "a/b/c", "[!x]?.{py,go}": "xb.py", "*.py": "a.ts"}.items())
    asked = walk.paths(found, spark.createDataFrame([("a/b.py",), ("gone.py",), ("../x",)], "rel_path string"))
    assert {(r.rel_path, r.deleted) for r in asked.collect()} == {("a/b.py", False), ("gone.py", True)}


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    last = events.agg(F.max("ts")).first()[0]
    sentinel = events.limit(1).withColumn("ts", F.lit(last).cast("timestamp_ntz") + F.expr("INTERVAL 30 DAY"))
    events.unionByName(sentinel).repartition(3).write.parquet(f"{tmp_path}/in")
    got = []
    stream = changes(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in"))
    watch.stream(stream, lambda df, _: got.extend(map(tuple, df.collect())), f"{tmp_path}/c", "10 minutes").awaitTermination()
    want = sorted(map(tuple, watch.debounce(changes(events), "10 minutes").collect()))
    assert sorted(got) == want


def test_prefix_and_contains_ignore_case(spark):
    g = small(spark, [("A", "B", 1)], labels={"A": "Pkg/One", "B": "pkg_two%"})
    assert [r.id for r in reads.prefixed(g, "p", "pkg/").collect()] == ["A"] and [r.id for r in reads.containing(g, "p", "_TWO%").collect()] == ["B"]
    assert reads.escape_like("a_b%\\") == "a\\_b\\%\\\\"


def test_steps_lie_where_they_are_joined(spark, sf):
    g = tables.graph(spark, sf)
    for reverse in (False, True):
        steps = traverse.calls(g, reverse)
        frontier = g.nodes.where("type = 'symbol'").select(F.col("id").alias("seed"), F.col("id").alias("node"))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = steps.from_(frontier)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_hubs_are_dealt_to_parts(spark, tmp_path):
    rng = random.Random(3)
    edges = [("hub", f"n{k}", 1.0) for k in range(300)] + [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}", 1.0) for _ in range(200)] + [("s", "hub", 1.0)]
    g = small(spark, sorted(set(edges)))
    g.home = str(tmp_path)
    plain = tables.Graph(g.nodes, g.edges, g.weights, g.activation)
    rows = traverse.calls(plain).rows
    steps = traverse.laid_out(g, "steps", rows, hub=40)
    assert steps.on == ["node", "part"] and [tuple(r) for r in steps.hubs.collect()] == [("hub", 8)]
    assert steps.rows.where("node = 'hub'").select("part").distinct().count() == 8
    seeds_ = spark.createDataFrame([("s",), ("hub",), ("n1",)], "id string")
    shown = lambda st: sorted(map(tuple, traverse.reach(st, seeds_, 3).collect()))
    assert shown(steps) == shown(traverse.Steps(rows, ["node"])) and len(shown(steps)) > 600
    assert traverse.laid_out(g, "steps", rows, hub=40) is steps
