"""One object over a project graph: each method is a typed query that returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activation, ir, merge, org, reads, search, traverse
from ..sources import tables
from ..sources.tables import Graph


class KnowledgeGraph:
    """Queries over nodes, edges, weights and activation; anchors are given as ids or as DataFrames of ids."""

    def __init__(self, spark: SparkSession, graph: Graph):
        self.spark, self.g = spark, graph

    @classmethod
    def of_tables(cls, spark: SparkSession, folder: str) -> KnowledgeGraph:
        return cls(spark, tables.graph(spark, folder))

    @classmethod
    def of_store(cls, spark: SparkSession, store: merge.Versions) -> KnowledgeGraph:
        """The current version of an indexed tree; weights and activation start empty."""
        none = lambda s: spark.createDataFrame([], s)
        return cls(spark, Graph(store.read("nodes"), store.read("edges"), none("edge_id string, weight double, source_class string"), none("node_id string, activation double")))

    def substrate(self, project: str, canonical: str | None = None, types: tuple[str, ...] = (), limit: int = 20) -> DataFrame:
        """What a plug-in may ask for: a node by canonical id, else concepts, else namespaces, else what is most active."""
        if canonical is not None:
            return reads.by_id(self.g, self.node_by_canonical(project, canonical))
        for kind in types:
            if kind == "concept":
                return reads.concepts(self.g, project, "")
            if kind == "namespace":
                return self.g.nodes.where((F.col("project_id") == project) & (F.col("type") == "namespace")).orderBy("canonical_id", "id").limit(limit)
        return reads.top_activated(self.g, limit).where(F.col("project_id") == project)

    def _ids(self, anchors: DataFrame | str | list[str]) -> DataFrame:
        if isinstance(anchors, DataFrame):
            return anchors
        return self.spark.createDataFrame([(a,) for a in ([anchors] if isinstance(anchors, str) else anchors)], "id string")

    def node_by_id(self, ids) -> DataFrame:
        return reads.by_id(self.g, self._ids(ids))

    def edge_by_id(self, ids) -> DataFrame:
        return reads.edges_by_id(self.g, self._ids(ids))

    def node_by_canonical(self, project: str, canonical: str) -> DataFrame:
        return reads.by_canonical(self.g, self.spark.createDataFrame([(project, canonical)], "project_id string, canonical_id string"))

    def nodes(self, project: str, kind: str | None = None) -> DataFrame:
        return reads.nodes_of(self.g, project, kind)

    def nodes_prefix(self, project: str, prefix: str, limit: int | None = None) -> DataFrame:
        return reads.prefixed(self.g, project, prefix, limit)

    def nodes_contains(self, project: str, part: str, limit: int | None = None) -> DataFrame:
        return reads.containing(self.g, project, part, limit)

    def nodes_for_source_file(self, path: str) -> DataFrame:
        return reads.of_source_file(self.g).where(F.col("source_file") == path)

    def file_node(self, project: str, path: str) -> DataFrame:
        return self.g.nodes.where((F.col("project_id") == project) & (F.col("type") == "file") & (F.col("canonical_id") == path))

    def concepts(self, project: str, term: str = "") -> DataFrame:
        return reads.concepts(self.g, project, term)

    def topk_activated(self, k: int = activation.TOP) -> DataFrame:
        return reads.top_activated(self.g, k)

    def activation_of(self, ids) -> DataFrame:
        """id and activation, 0 where there is none."""
        a = self.g.activation.withColumnRenamed("node_id", "id")
        return self._ids(ids).join(a, "id", "left").select("id", F.coalesce("activation", F.lit(0.0)).alias("activation"))

    def edges_from(self, ids) -> DataFrame:
        return reads.edges_from(self.g, self._ids(ids))

    def edges_to(self, ids) -> DataFrame:
        return reads.edges_to(self.g, self._ids(ids))

    def edges_between(self, a: str, b: str) -> DataFrame:
        return reads.edges_between(self.g, self.spark.createDataFrame([(a, b)], "a string, b string"))

    def callees(self, ids, depth: int = 3) -> DataFrame:
        return traverse.reached_nodes(self.g, self._ids(ids), depth)

    def callers(self, ids, depth: int = 3) -> DataFrame:
        return traverse.reached_nodes(self.g, self._ids(ids), depth, reverse=True)

    def propose_calls(self, ids, depth: int = 3) -> DataFrame:
        return traverse.proposed_calls(self.g, self._ids(ids), depth)

    def _near(self, ids, types, **how) -> DataFrame:
        return reads.neighbours(self.g, types, **how).join(self._ids(ids).select(F.col("id").alias("anchor")), "anchor", "left_semi")

    def references(self, ids) -> DataFrame:
        return reads.grouped_references(self._near(ids, None, reverse=True))

    def _of(self, ids, found: DataFrame) -> DataFrame:
        return found.join(self._ids(ids).select(F.col("id").alias("anchor")).distinct(), "anchor", "left_semi")

    def concept_implementors(self, ids) -> DataFrame:
        return self._of(ids, reads.implementors(self.g, None))

    def file_imports(self, ids) -> DataFrame:
        return self._of(ids, reads.imports(self.g, None))

    def namespace_members(self, ids) -> DataFrame:
        return self._near(ids, ["contains", "defines"], least=None)

    def namespace_summary(self, ids) -> DataFrame:
        return reads.namespace_summary(self.namespace_members(ids))

    def namespace_dependencies(self, ids) -> DataFrame:
        return self._of(ids, reads.dependencies(self.g, anchor_type=None))

    def namespace_dependents(self, ids) -> DataFrame:
        return self._of(ids, reads.dependencies(self.g, True, None))

    def search(self, text: str, limit: int = 10) -> DataFrame:
        return search.search(self.g, self.spark.createDataFrame([(text,)], "query string"), ir.clamp("search", limit))

    def related(self, kind: str, limit: int = 10, query: str = "", ids=None) -> DataFrame:
        """Tests, entrypoints or lifecycle nodes, those of a query or of some nodes first."""
        return search.related(self.g, search.PATTERNS[kind], query, None if ids is None else self._ids(ids), ir.clamp("related", limit))

    def spread(self, seeds: DataFrame) -> DataFrame:
        return activation.spread(self.g, seeds)

    def cycle(self, anchors: DataFrame, k: int = activation.TOP, loops: int = activation.LOOPS) -> DataFrame:
        return activation.cycle(self.g, anchors, k, loops)

    def investigate(self, text: str, limit: int = 5) -> DataFrame:
        """section, anchor and id: what search finds, with callers, callees, references and related nodes around it."""
        found = traverse.settle(self.search(text, ir.clamp("investigate", limit)).select("id"), "found")
        part = lambda name, df, a: df.select(F.lit(name).alias("section"), F.col(a).alias("anchor"), "id")
        out = part("search", found.withColumn("anchor", F.col("id")), "anchor")
        out = out.unionByName(part("callers", self.callers(found), "seed")).unionByName(part("callees", self.callees(found), "seed"))
        out = out.unionByName(part("references", self._near(found, None, reverse=True), "anchor"))
        for kind in ("tests", "entrypoints"):
            out = out.unionByName(part(kind, self.related(kind, query=text).withColumn("anchor", F.col("pattern")), "anchor"))
        return out

    def org_find_similar(self, ref: str) -> DataFrame:
        return org.similar(org.lifted_nodes(self.g), self.spark.createDataFrame([(ref,)], "ref string"))

    def cross_project_edges(self) -> DataFrame:
        shared = org.shared_dependencies(self.g).select("source_node", "target_node", F.lit("shares_dependency").alias("type"), "weight")
        return shared.unionByName(org.mirrors(self.g).select("source_node", "target_node", F.lit("mirrors").alias("type"), "weight"))
