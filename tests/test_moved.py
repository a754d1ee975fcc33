"""What graph queries move, and that the keys which rows are made of give the ids of the graph."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from loomgraph import catalog
from loomgraph.functions import ids
from loomgraph.operators import activation, merge, org, reads, semantic, traverse
from loomgraph.sources import tables
from loomgraph.sources.tables import Graph


@contextmanager
def unbroadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def untyped(g):
    return Graph(g.nodes, g.edges.select("*"), g.weights, g.activation)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_orders_have_the_ids_of_their_symbols(spark, sf):
    _, o = tables.orders(spark, sf)
    made = o.select(ids.node_id(F.col("p"), F.lit("symbol"), tables.sym()).alias("id"))
    assert made.join(tables.graph(spark, sf).nodes, "id", "left_anti").isEmpty() and not made.isEmpty()
    for name in ("edge_by_id", "enrich_claims"):  # named a column that orders no longer have
        assert catalog.QUERIES[name](spark, sf).columns


def test_graphs_are_written_by_keys(spark, sf):
    g = tables.graph(spark, sf)
    for name, end in (("edges", "source_id"), ("edges", "target_id"), ("activation", "node_id")):
        assert spark.read.parquet(f"{g.home}/{name}").schema[end].dataType.fieldNames() == ["type", "head", "number"]
    assert "id" not in spark.read.parquet(f"{g.home}/nodes").columns
    ends = g.typed.select(F.col("source_id").alias("id"), F.col("source_type").alias("type")).union(g.typed.select("target_id", "target_type")).distinct()
    assert ends.join(g.nodes, ["id", "type"], "left_anti").isEmpty()


def test_typed_and_other_graphs_have_the_same_neighbours(spark, sf):
    g = tables.graph(spark, sf)
    with unbroadcast(spark):
        assert "SortMergeJoin" not in plan(reads.imports(g)) and "SortMergeJoin" not in plan(reads.neighbours(g, None, source_type="namespace", node_type=["namespace"]))
    for found in (reads.references, reads.implementors, reads.imports, lambda x: reads.dependencies(x, True)):
        assert rows(found(g).select("anchor", "id", "rank")) == rows(found(untyped(g)).select("anchor", "id", "rank"))


def test_a_few_missing_ends_leave_edges_where_they_are(spark, sf):
    g = tables.graph(spark, sf)
    with unbroadcast(spark):
        assert "SortMergeJoin" not in plan(reads.unresolved_nodes(g.edges, g.nodes.where("type <> 'concept'")))


def test_edges_are_told_without_their_ids(spark, sf):
    g = tables.graph(spark, sf)
    dead = g.nodes.where("kind = 'interface' or type = 'concept'").select("id")
    with unbroadcast(spark):
        left = merge.cascade(g.edges, dead, True)
        shown = plan(left)
    assert shown.index("sha2") < shown.index("SortMergeJoin")  # the root of a plan comes first
    assert rows(left.select("id")) == rows(merge.cascade(g.edges, dead).select("id"))


def test_weights_and_ends_meet_edges_once(spark, sf):
    g = tables.graph(spark, sf)
    anchors = g.activation.withColumnRenamed("node_id", "id").unionByName(g.nodes.where("type = 'file'").select("id", F.lit(0.7).alias("activation")))
    plain = Graph(g.nodes, g.edges.drop("weight"), g.weights, g.activation)
    with unbroadcast(spark):
        assert plan(activation.hebbian(g, anchors)).count("SortMergeJoin") == 2
        assert plan(activation.enriched(g, anchors)).count("SortMergeJoin") == 3
    assert rows(activation.hebbian(g, anchors).select("edge_id", "weight", "source_class", "co_activations")) == rows(activation.hebbian(plain, anchors).select("edge_id", "weight", "source_class", "co_activations"))


def test_some_needles_are_found_without_lists(spark, sf):
    tables.clean(spark)
    g = tables.graph(spark, sf)
    wanted = g.nodes.where("type = 'namespace'").select(F.col("canonical_id").alias("query"), "project_id")
    few, many = (semantic.resolution_candidates(g, wanted, few=few) for few in (0, 10_000))
    assert rows(few) == rows(many) and not any(name.startswith("canonical") for _, name in tables.KEPT)


def test_proposed_calls_look_up_weak_calls_only(spark):
    edges = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 0.01), ("b", "d", 1.0), ("a", "e", None), ("d", "e", 1.0), ("d", "a", 1.0)]
    e = spark.createDataFrame([(s + t, s, t, "calls", w) for s, t, w in edges], "id string, source_id string, target_id string, type string, weight double")
    nodes, weights = spark.createDataFrame([(x,) for x in "abcde"], "id string"), e.where("weight is not null").select(F.col("id").alias("edge_id"), "weight")
    seeds = nodes.where("id = 'a'")
    for g in (Graph(nodes, e, weights, None), Graph(nodes, e.drop("weight"), weights, None)):
        found = traverse.proposed_calls(g, seeds)
        assert {r.target_id for r in found.collect()} == {"d", "a"}
    assert "hops" in plan(traverse.proposed_calls(Graph(nodes, e, weights, None), seeds))


def test_namespaces_are_read_without_nodes(spark, sf):
    g = tables.graph(spark, sf)
    whole = g.nodes.select("id", "type", "canonical_id", "label")
    ends = g.typed.select(F.explode(F.array(*[F.struct(F.col(f"{e}_id").alias("id"), *[F.col(f"{e}_{c}").alias(c) for c in ("type", "canonical_id", "label")]) for e in ("source", "target")])).alias("e")).select("e.*")
    assert ends.exceptAll(ends.join(whole, whole.columns, "left_semi")).isEmpty() and ends.join(whole, whole.columns, "left_anti").isEmpty()
    with unbroadcast(spark):
        for name in ("references_grouped", "namespace_dependents", "namespace_dependencies", "namespace_members", "namespace_summary"):
            shown = plan(catalog.QUERIES[name](spark, sf))
            assert "/nodes" not in shown, name
        assert "/nodes" not in plan(org.shared_dependencies(g))
        assert "SortMergeJoin" not in plan(reads.top_activated(g, 3))


def test_members_and_dependencies_of_other_graphs_are_the_same(spark, sf):
    g = tables.graph(spark, sf)
    for found in (lambda x: reads.members(x, "namespace"), lambda x: reads.dependencies(x, True), reads.dependencies):
        assert sorted(found(g).columns) == sorted(found(untyped(g)).columns)
        assert rows(found(g).select("anchor", "id", "type", "label", "canonical_id", "source_file", "rank")) == rows(found(untyped(g)).select("anchor", "id", "type", "label", "canonical_id", "source_file", "rank"))
    for found in (lambda x: reads.members(x, "namespace", ["type", "label"]), lambda x: reads.dependencies(x, True, shown=["canonical_id"]), lambda x: reads.neighbours(x, None, True, source_type="namespace", shown=["canonical_id"])):
        assert rows(found(g)) == rows(found(untyped(g)))
    assert rows(org.shared_dependencies(g)) == rows(org.shared_dependencies(untyped(g)))
    assert rows(reads.top_activated(g, 5)) == rows(reads.top_activated(untyped(g), 5))


def test_copies_of_a_node_are_listed_once(spark):
    found = spark.createDataFrame([("a", c, f"n{k}", k) for k in range(40) for c in ("x", "y", "z")], "anchor string, edge_type string, id string, k int")
    got = reads.listed(found, 7, [F.asc("k"), F.asc("id")]).collect()
    assert sorted((r["rank"], r.k) for r in got) == [(k + 1, k) for k in range(7)]
