"""What graphs and traversals leave on disk."""

import os

from pyspark.sql import functions as F

from loomgraph import catalog
from loomgraph.functions import ids
from loomgraph.operators import activation, compile, reads, traverse
from loomgraph.sources import syntax, tables


def test_ids_are_packed_and_unpacked(spark):
    texts = ["0" * 32, "0123456789abcdef" * 2, "0123456789ABCDEF" * 2, "", "é:x", "x" * 16, "g" * 32, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ids.packed(F.col("t")).alias("b"))
    back = rows.select("t", "b", ids.unpacked(F.col("b")).alias("u")).collect()
    assert [r.u for r in back] == texts
    assert [len(r.b) for r in back[:2]] == [16, 16] and all(len(r.b) >= 17 for r in back[2:7])


def test_a_graph_keeps_neither_lines_nor_edge_ids(spark, sf):
    tables.clean(spark)
    g = tables.graph(spark, sf)
    home = g.home.removeprefix("file:").replace("///", "/")
    assert not any("/lines-" in path for path in tables._WRITTEN) and not os.path.exists(f"{home}/lines")
    assert set(spark.read.parquet(f"{g.home}/edges").columns) == {"project_id", "source_id", "target_id", "type", "weight"}
    made = g.edges.where(F.col("id") != ids.edge_id(F.col("source_id"), F.col("type"), F.col("target_id")))
    assert made.isEmpty() and g.edges.count() == g.edges.select("id").distinct().count() > 0


def test_lines_move_once_and_what_graphs_are_made_of_goes(spark, sf, monkeypatch):
    _, o = tables.orders(spark, sf)
    o = tables.bucketed(o, ["o_orderkey"], "orders", order=["o_orderkey"])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(map(repr, df.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        once = tables.lines(spark, sf, o)
        assert plan(once).count("Exchange hashpartitioning") == 1 and "path" not in once.columns
        monkeypatch.setattr(tables, "PARTS", 10)
        many = tables.lines(spark, sf, o)
        assert "Broadcast" not in plan(many) and rows(once) == rows(many)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tables.clean(spark)
    g = tables.graph(spark, sf)
    assert tables._WRITTEN == [g.home] and not tables._NAMED


def test_spreading_leaves_one_table_and_no_shuffle_files(spark, sf):
    tables.clean(spark)
    g = tables.graph(spark, sf)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    seeds = g.activation.limit(50).select(F.col("node_id").alias("set"), F.col("node_id").alias("id"), "activation")
    assert activation.spread(g, seeds).count() > 50
    assert sum("/best-" in path for path in tables._WRITTEN) == 1 and spark.conf.get(key) == before
    context = spark.sparkContext._jsc.sc()
    local = [x.toString() for x in context.env().blockManager().diskBlockManager().localDirs()]
    for df in (g.edges.groupBy("target_id").count(), g.edges.groupBy("source_id").count()):
        held = lambda: sum(len(fs) for d in local for _, _, fs in os.walk(d) if fs)
        n = held()
        traverse.settle(df, "counts")
        assert held() <= n


def test_edges_move_without_their_ids(spark, sf):
    g = tables.graph(spark, sf)
    pairs = g.edges.where("type = 'calls'").select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))
    found = reads.edges_between(g, pairs)
    assert "lo" not in found.columns and sorted(found.columns) == sorted(reads.weighted(g).columns)
    assert found.exceptAll(g.edges.withColumn("weight", F.coalesce("weight", F.lit(1.0))).where("type = 'calls'").select(*found.columns)).isEmpty()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.index("sha2") < plan.index("SortMergeJoin")  # the root of a plan comes first


def test_repairs_pass_no_units_through_the_driver(spark):
    units = spark.range(1000).selectExpr("id as unit", "repeat('x', cast(id % 5 as int)) as source")
    verify = lambda df: df.selectExpr("unit", "if(source = '', 'passed', 'failed') as status")
    propose = lambda df: df.selectExpr("unit", "substring(source, 2) as proposed")
    done = compile.repair_loop(units, verify, propose, lambda df: df.where("unit % 7 > 0"))
    assert "Broadcast" not in done._jdf.queryExecution().executedPlan().toString()
    want = {k: ("passed" if k % 5 == 0 or k % 7 and k % 5 <= 3 else "failed") for k in range(1000)}
    assert {r.unit: r.status for r in done.collect()} == want


def test_files_are_handed_on_together():
    files = syntax.pd.DataFrame({"rel_path": [f"{k}.py" for k in range(50)], "content": ["f()\n"] * 49 + ["("]})
    got = list(syntax.frames(iter([files])))
    assert len(got) == 1 and got[0]["rel_path"].nunique() == 49


def test_walks_pass_nothing_through_the_driver_and_move_no_nodes(spark, sf):
    walks = catalog.QUERIES["syntax_walks"](spark, sf)
    plan = walks._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Exchange" not in plan


def test_inner_scopes_are_hidden_from_each_root(spark):
    text = "def f():\n    a()\n    def g():\n        b()\n        def h():\n            c()\n    d()\n"
    nodes = syntax.syntax(spark.createDataFrame([("m.py", "python", text), ("n.py", "python", "x()\n")], "rel_path string, language string, content string")).cache()
    called = lambda df: {(r.root, r.name) for r in df.where("type = 'Name'").collect()}
    roots = nodes.where("type in ('FunctionDef', 'Module')")
    name = {r.id: r.name or r.rel_path for r in roots.collect()}
    found = {(name[k] if k else "module", v) for k, v in called(syntax.below(nodes, roots, True))}
    assert found == {("f", "a"), ("f", "d"), ("g", "b"), ("h", "c"), ("module", "x")}


def test_edges_of_other_types_are_not_moved(spark, sf):
    g = tables.graph(spark, sf)
    wanted = g.edges.where("type = 'annotates'").select("id").limit(20)
    found, every = reads.edges_by_id(g, wanted, "annotates"), reads.edges_by_id(g, wanted)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, every.collect())) and found.count() == 20
    plan = catalog.QUERIES["edge_by_id"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(type,annotates)" in plan and "HashAggregate" not in plan
