"""Keyed merges, pending writes, versioned publication and incremental reconciliation."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import edge_id, node_id
from ..sources.tables import settle
from .reads import grown, missing_endpoints, shrunk


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """new's rows over old's of the same key; the columns in keep stay as they were. new has one row per key."""
    kept = [c for c in keep if c in old.columns]
    fresh = new.select(*[F.col(c).alias(f"_n_{c}") for c in old.columns], F.lit(True).alias("_hit"))
    cond = [F.col(k).eqNullSafe(F.col(f"_n_{k}")) for k in key]
    joined = old.withColumn("_had", F.lit(True)).join(fresh, cond, "full")
    pick = lambda c: F.when(F.col("_had") & F.lit(c in kept), F.col(c)).when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*map(pick, old.columns))


def insert_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def accumulate_weights(old: DataFrame, updates: DataFrame) -> DataFrame:
    """Weight and class of the last update (by seq), counts summed: (edge_id, weight, source_class, co_activations[, seq])."""
    last = updates.groupBy("edge_id").agg(F.max_by(F.struct("weight", "source_class"), "seq").alias("n"), F.sum("co_activations").alias("more"))
    both = old.join(last, "edge_id", "full")
    return both.select("edge_id", F.coalesce("n.weight", "weight").alias("weight"), F.coalesce("n.source_class", "source_class").alias("source_class"), (F.coalesce("co_activations", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("co_activations"))


#: The order in which kinds of pending writes are flushed.
FLUSH = ["node", "edge", "iir", "activation", "weight", "concept", "plan", "enrichment"]


def pending(writes: DataFrame) -> DataFrame:
    """Last write per (op, project, entity), weight deltas summed, enrichments all kept; with their place in the flush."""
    place = F.array_position(F.lit(FLUSH), F.col("op"))
    key = ["op", "project_id", "entity"]
    last = writes.where("op <> 'enrichment'").groupBy(*key).agg(F.max_by("payload", "seq").alias("payload"), F.max("seq").alias("seq"), F.sum(F.when(F.col("op") == "weight", F.col("delta")).otherwise(0)).alias("delta"))
    every = last.unionByName(writes.where("op = 'enrichment'").select(*key, "payload", "seq", F.lit(0).cast("long").alias("delta")))
    return every.withColumn("place", place)


def file_diff(listing: DataFrame, hashes: DataFrame) -> DataFrame:
    """rel_path and what to do: skip, process or delete; listing and hashes (rel_path, hash)."""
    a, b = listing.select("rel_path", F.col("hash").alias("_new")), hashes.select("rel_path", F.col("hash").alias("_old"))
    action = F.when(F.col("_new").isNull(), "delete").when(F.col("_new").eqNullSafe(F.col("_old")), "skip").otherwise("process")
    return a.join(b, "rel_path", "full").select("rel_path", action.alias("action"))


def conflicts(contributions: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose contributions disagree, with the columns that do."""
    counts = [F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns]
    found = contributions.groupBy(key).agg(*counts)
    names = F.array_compact(F.array(*[F.when(F.col(c) > 1, F.lit(c)) for c in columns]))
    return found.select(key, F.array_join(names, ",").alias("columns")).where("columns <> ''")


def merged_contributions(rows: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """One row per key of rows(key, identity columns, properties map<string,string>): properties of all contributions together, and
    conflicts, the identity columns and properties that they disagree on (a row with conflicts is not to be written)."""
    clash = conflicts(rows, key, identity).select(key, F.split("columns", ",").alias("_columns"))
    first = rows.groupBy(key).agg(*[F.min(c).alias(c) for c in identity])
    parts = rows.select(key, F.explode("properties").alias("k", "v")).groupBy(key, "k").agg(F.min("v").alias("v"), F.count_distinct("v").alias("n"))
    maps = parts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"), F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("k")))).alias("_keys"))
    none = F.array().cast("array<string>")
    joined = first.join(maps, key, "left").join(clash, key, "left")
    return joined.select(key, *identity, F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"), F.concat(F.coalesce("_columns", none), F.coalesce("_keys", none)).alias("conflicts"))


def cascade_records(dead: DataFrame, weights: DataFrame, edges: DataFrame, activation: DataFrame, iir: DataFrame, artifacts: DataFrame, now: int) -> dict[str, DataFrame]:
    """What the records are once the nodes of dead(id) are gone: weights of edges that are left (edges after cascade()), activation and
    extracted intents of nodes that are left; artifacts of theirs stay, without a node and stale from now on."""
    gone = dead.select(F.col("id").alias("node_id")).distinct()
    hit = gone.select(F.col("node_id").alias("unit_node_id"), F.lit(True).alias("_hit"))
    marked = artifacts.join(hit, "unit_node_id", "left").withColumns({"stale_at": F.when(F.col("_hit") & F.col("stale_at").isNull(), F.lit(now)).otherwise(F.col("stale_at")), "unit_node_id": F.when(F.col("_hit").isNull(), F.col("unit_node_id"))})
    return {
        "weights": weights.join(edges.select(F.col("id").alias("edge_id")), "edge_id", "left_semi"),
        "activation": activation.join(gone, "node_id", "left_anti"),
        "iir": iir.join(gone.withColumn("kind", F.lit("extracted")), ["node_id", "kind"], "left_anti").select(*iir.columns),
        "artifacts": marked.select(*artifacts.columns),
    }


def prune_file(nodes: DataFrame, edges: DataFrame, kept: DataFrame, files: DataFrame, derived: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes of files(source_file) that are not in kept(id); namespaces and concepts stay. For derived see cascade."""
    local = nodes.join(files.select("source_file").distinct(), "source_file", "left_semi").where("type not in ('namespace', 'concept')")
    dead = settle(without(local.select("id"), kept.select("id"), "id"), "dead")
    return without(nodes, dead, "id"), cascade(edges, dead, derived)


def without(rows: DataFrame, gone: DataFrame, *on: str) -> DataFrame:
    """rows whose ids are not in gone; ids are moved packed."""
    return grown(shrunk(rows, *on).join(shrunk(gone.select(*on), *on), list(on), "left_anti"), *on).select(*rows.columns)


def cascade(edges: DataFrame, dead: DataFrame, derived: bool = False) -> DataFrame:
    """Edges neither end of which is in dead(id). derived: their ids follow from source, type and target, and are made again."""
    source, target = (dead.select(F.col("id").alias(end)) for end in ("source_id", "target_id"))
    moved = ["source_id", "target_id"] if derived else ["id", "source_id", "target_id"]
    left = shrunk(edges.drop("id") if derived else edges, *moved).join(shrunk(source, "source_id"), "source_id", "left_anti").join(shrunk(target, "target_id"), "target_id", "left_anti")
    left = grown(left, *moved)
    return (left.withColumn("id", edge_id(F.col("source_id"), F.col("type"), F.col("target_id"))) if derived else left).select(*edges.columns)


def remapped(nodes: DataFrame, edges: DataFrame, project: str, siblings: DataFrame | None = None, anchors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and edges that extractors named by ids of their own, under the project's ids.

    nodes(rel_path, local_id, type, canonical_id, ...) get id; edges(rel_path, source_id, target_id, type, ...) are looked up among the
    file's nodes, then among those of siblings(rel_path, local_id, id), else keep what they have. With anchors(rel_path, id) a file
    node is not a node of its own but stands for its file's anchor.
    """
    made = nodes.withColumn("id", node_id(F.lit(project), F.col("type"), F.col("canonical_id")))
    if anchors is not None:
        own = anchors.select("rel_path", F.col("id").alias("_anchor"))
        made = made.join(own, "rel_path", "left").withColumn("id", F.when(F.col("type") == "file", F.coalesce("_anchor", "id")).otherwise(F.col("id")))
        kept = made.where("type <> 'file' or _anchor is null").drop("_anchor")
    else:
        kept = made
    ids = made.groupBy("rel_path", "local_id").agg(F.max("id").alias("_own"))
    other = siblings.groupBy("rel_path", "local_id").agg(F.max("id").alias("_other")) if siblings is not None else None
    for end in ("source_id", "target_id"):
        edges = edges.join(ids.withColumnRenamed("local_id", end), ["rel_path", end], "left")
        if other is not None:
            edges = edges.join(other.withColumnRenamed("local_id", end), ["rel_path", end], "left").withColumn("_own", F.coalesce("_own", "_other")).drop("_other")
        edges = edges.withColumn(end, F.coalesce("_own", end)).drop("_own")
    return kept, edges.withColumn("id", edge_id(F.col("source_id"), F.col("type"), F.col("target_id")))


def swept(nodes: DataFrame, edges: DataFrame, iir: DataFrame, run: str, derived: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left after a full run: rows that indexing manages (index_managed) and this run has not written are gone.

    A node takes its edges and extracted intents with it; rows that indexing does not manage stay. For derived see cascade.
    """
    stale = F.coalesce("index_managed", F.lit(False)) & ~F.col("last_index_run_id").eqNullSafe(F.lit(run))
    dead = settle(nodes.where(stale).select("id"), "swept")
    gone = dead.select(F.col("id").alias("node_id"))
    extracted = F.col("kind") == "extracted"
    intents = without(iir.where(extracted), gone, "node_id").unionByName(iir.where(~F.coalesce(extracted, F.lit(False))))
    return nodes.where(~stale), cascade(edges.where(~stale), dead, derived), intents.select(*iir.columns)


@dataclass
class State:
    """hashes(rel_path, hash), owners(rel_path, id, run), nodes(id, ...), edges(id, source_id, target_id, ...)."""

    nodes: DataFrame
    edges: DataFrame
    owners: DataFrame
    hashes: DataFrame


class BrokenEdges(ValueError):
    """A staged edge has an end that is neither live nor staged."""


def reconcile(live: State, staged: State, files: DataFrame, run: str, scope: str, check: bool = True, derived: bool = False) -> State:
    """The state after publishing a run; files(rel_path, status: walked, indexed or deleted).

    full: whatever this run has not seen loses its owner. incremental: indexed files and files that are gone are in scope.
    paths: indexed and deleted files are. An entity whose last owner goes, goes with its edges. For derived see cascade.
    """
    nodes = upsert(live.nodes, staged.nodes, ["id"])
    # without staged edges there is nothing to put over the live ones
    edges = live.edges if staged.edges.isEmpty() else upsert(live.edges, staged.edges, ["id"])
    if check and not missing_endpoints(staged.edges, live.nodes, staged.nodes).isEmpty():
        raise BrokenEdges(run)
    indexed = files.where("status = 'indexed'").select("rel_path")
    seen = staged.owners.select("rel_path", "id").join(indexed, "rel_path", "left_semi").distinct().withColumn("run", F.lit(run))
    # each of the tables returned is computed from these, so they are computed once
    owners = settle(insert_new(seen, live.owners.select("rel_path", "id", "run"), ["rel_path", "id"]), "owners")
    gone = live.hashes.select("rel_path").join(files.select("rel_path"), "rel_path", "left_anti")
    touched = {"full": None, "incremental": indexed.unionByName(gone), "paths": files.where("status in ('indexed', 'deleted')").select("rel_path")}[scope]
    stale = owners.where(F.col("run") != run)
    if touched is not None:
        stale = stale.join(touched.distinct(), "rel_path", "left_semi")
    left = settle(owners.join(stale.select("rel_path", "id"), ["rel_path", "id"], "left_anti"), "left")
    dead = settle(stale.select("id").distinct().join(left.select("id"), "id", "left_anti"), "dead")
    known = live.nodes.select("id").unionByName(staged.nodes.select("id"))
    nodes = without(nodes, dead, "id")
    # no derived id of an edge is a node's, so where all that is dead are nodes no edge is owned itself and none is made or moved to tell
    sought = settle(without(dead, known, "id"), "sought") if derived else dead
    if not sought.isEmpty() and not settle(shrunk(edges.select("id"), "id").join(shrunk(sought, "id"), "id", "left_semi"), "owned-edges").isEmpty():
        edges = without(edges, sought, "id")
    edges = cascade(edges, dead, derived)
    kept = {"full": None, "incremental": live.hashes.join(gone, "rel_path", "left_anti"), "paths": live.hashes.join(files.where("status = 'deleted'"), "rel_path", "left_anti")}[scope]
    hashes = staged.hashes if kept is None else upsert(kept, staged.hashes, ["rel_path"])
    return State(nodes, edges, left, hashes)


class Versions:
    """Tables published together: each version is a folder, and a small pointer table names the current one.

    The pointer is a Parquet table with one row per publication; readers take the highest number whose folder was completed
    before it was written, so a failed publication is never seen. One writer at a time is assumed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> int:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_pointer")
        if not path.getFileSystem(conf).exists(path):
            return 0
        return self.spark.read.schema("version long, tables string").parquet(f"{self.root}/_pointer").agg(F.max("version")).first()[0] or 0

    def publish(self, tables: dict[str, DataFrame | Callable[[], DataFrame]]) -> int:
        """Write all tables in order, then the pointer; tables not given are carried over from the version before.

        A table may be given as a function, which is called when those before it are written (and what they observe is known).
        """
        last = self.current()
        at = dict(self._places(last)) if last else {}
        for name, df in tables.items():
            path = f"{self.root}/v{last + 1}/{name}"
            (df() if callable(df) else df).write.mode("overwrite").parquet(path)
            at[name] = path
        self.spark.createDataFrame([(last + 1, json.dumps(at))], "version long, tables string").coalesce(1).write.mode("append").parquet(f"{self.root}/_pointer")
        return last + 1

    def _places(self, version: int) -> dict[str, str]:
        row = self.spark.read.schema("version long, tables string").parquet(f"{self.root}/_pointer").where(F.col("version") == version).first()
        return json.loads(row.tables)

    def has(self, name: str) -> bool:
        return name in self._places(self.current())

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self._places(version or self.current())[name])


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
