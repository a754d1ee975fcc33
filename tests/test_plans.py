"""Indexing a tree end to end, and the façade over it."""

from loomgraph.operators.merge import Versions
from loomgraph.plans import index as plan
from loomgraph.plans.knowledge import KnowledgeGraph


def test_index_follows_the_tree(spark, tmp_path):
    src, store = tmp_path / "src", Versions(spark, f"file://{tmp_path}/store")
    src.mkdir()
    (src / "a.py").write_text("import os\n\ndef one():\n    pass\n\ndef two():\n    pass\n")
    (src / "b.py").write_text("import os\n\ndef three():\n    pass\n")
    (src / "c.go").write_text('package shop\n\nimport "fmt"\n\nfunc (c *Cart) Load() {\n}\n')
    counted = ("version", "processed", "skipped", "deleted")
    run = lambda name: {k: v for k, v in plan.index(spark, f"file://{src}", store, "p", name).items() if k in counted}
    assert not plan.ready(store)
    assert run("r1") == {"version": 1, "processed": 3, "skipped": 0, "deleted": 0}
    labels = lambda: {r.label for r in store.read("nodes").where("type = 'symbol'").collect()}
    assert plan.ready(store) and labels() == {"one", "two", "three", "Cart.Load"}
    lifted = lambda: {(r.rel_path, r.label) for r in store.read("iir").join(store.read("nodes").withColumnRenamed("id", "node_id"), "node_id").collect()}
    assert lifted() == {("a.py", "one"), ("a.py", "two"), ("b.py", "three"), ("c.go", "Cart.Load")}
    (src / "a.py").write_text("import os\n\ndef one():\n    return 1\n")
    (src / "b.py").unlink()
    assert run("r2") == {"version": 2, "processed": 1, "skipped": 1, "deleted": 1}
    assert labels() == {"one", "Cart.Load"} and plan.dangling(store).count() == 0 and lifted() == {("a.py", "one"), ("c.go", "Cart.Load")}
    assert {r.canonical_id for r in store.read("nodes").where("kind = 'import'").collect()} == {"os", "fmt"}
    assert run("r3") == {"version": 3, "processed": 0, "skipped": 2, "deleted": 0} and labels() == {"one", "Cart.Load"}
    kg = KnowledgeGraph.of_store(spark, store)
    assert [r.label for r in kg.search("cart load").collect()] == ["Cart.Load"]
    assert kg.nodes_for_source_file("a.py").count() == 1 and kg.file_node("p", "c.go").count() == 1


def test_facade_over_tables(spark, sf):
    kg = KnowledgeGraph.of_tables(spark, sf)
    seed = kg.g.nodes.where("canonical_id = 'suppliers:Supplier1'").orderBy("id").first().id
    assert kg.callers(seed).count() > 0 and kg.callees([seed]).count() > 0
    assert {r.section for r in kg.investigate("Supplier1").collect()} >= {"search", "callers", "callees", "references"}
    assert kg.activation_of("nothing").first().activation == 0.0
    brand = kg.nodes_prefix("p1", "parts/", 1).first().canonical_id
    assert kg.org_find_similar(brand).first().similarity == 1.0


def test_ledger_counts_what_was_written(spark, tmp_path):
    src, store = tmp_path / "src", Versions(spark, f"file://{tmp_path}/store")
    src.mkdir()
    (src / "a.py").write_text("def one():\n    pass\n")
    (src / "b.go").write_text("package b\n\nfunc F() {}\n")
    found = plan.index(spark, f"file://{src}", store, "p", "r1")
    (src / "b.go").unlink()
    later = plan.index(spark, f"file://{src}", store, "p", "r2")
    assert found["files"] == 2 and found["bytes"] == 20 + 23 and found["nodes"] > later["nodes"] == store.read("nodes").count() and later["edges"] == store.read("edges").count()
    rows = {r.run: (r.files, r.bytes, r.nodes, r.edges) for r in store.read("runs").collect()}
    assert rows == {"r1": tuple(found[c] for c in ("files", "bytes", "nodes", "edges")), "r2": tuple(later[c] for c in ("files", "bytes", "nodes", "edges"))}
    assert [r.source_id for r in KnowledgeGraph.of_store(spark, store).edge_by_id([store.read("edges").first().id]).collect()] == [store.read("edges").first().source_id]
