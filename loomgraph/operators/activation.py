"""Spreading activation, Hebbian strengthening and decay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import activation_confidence, confidence_activation, edge_id, packed, unpacked
from ..sources.tables import Graph, bucketed, forget, short
from .grams import FEW, holding
from .reads import grown, ranked, shrunk, weighted
from .traverse import laid_out, settle

#: Fixed values of the model.
DECAY, THRESHOLD, DEPTH = 0.6, 0.1, 6
RATE, FLOOR, CEILING, PROMOTE, FADE = 0.1, 0.01, 1.0, 0.4, 0.99
TOP, LOOPS, CONTEXT = 30, 8, 0.85


def resolve_anchors(g: Graph, anchors: DataFrame, few: int = FEW) -> DataFrame:
    """anchor, id, activation for anchors(project_id, kind, ref, confidence).

    Symbols match exactly, else the five shortest that contain the reference; namespaces by prefix (20); concepts by contents;
    files by prefix.
    """
    a = anchors.withColumn("anchor", F.concat_ws(":", "kind", "ref"))
    seen = ("type", "canonical_id", "label")
    # the exact branch is an equi-join; only what it leaves goes through the others, project by project
    symbols = g.nodes.where("type = 'symbol'").select("id", "project_id", F.col("canonical_id").alias("ref"))
    exact = symbols.join(short(a.where("kind = 'symbol'")), ["project_id", "ref"])
    left = a.where("kind = 'symbol'").join(exact.select("anchor", "project_id").distinct(), ["anchor", "project_id"], "left_anti")
    names, both = F.lower("canonical_id"), F.lower(F.concat_ws("\n", "canonical_id", "label"))

    def meets(rows: DataFrame, name: str, hay: Column, condition: Column) -> DataFrame:
        """rows of anchors with the nodes of their project that hold the reference and meet the condition."""
        asked = rows.withColumn("needle", F.lower("ref"))
        return holding(g, asked, name, hay, few, shown=seen).join(short(asked), ["project_id", "needle"]).where(condition)

    def cut(df: DataFrame, order: list, k: int) -> DataFrame:
        return ranked(df, ["project_id", "anchor"], order, k).drop("rank")

    starts = F.startswith(names, F.lower("ref"))
    within = F.contains(names, F.lower("ref")) | F.contains(F.lower("label"), F.lower("ref"))
    fuzzy = cut(meets(left, "canonical", names, F.col("type") == "symbol"), [F.length("canonical_id"), F.col("id")], 5)
    spaces = cut(meets(a.where("kind = 'namespace'"), "canonical", names, (F.col("type") == "namespace") & starts), [F.col("canonical_id"), F.col("id")], 20)
    ideas = meets(a.where("kind = 'concept'"), "labels", both, (F.col("type") == "concept") & within)
    files = meets(a.where("kind = 'file'"), "canonical", names, starts)
    found = exact.select("project_id", "anchor", "id", "confidence")
    for part in (fuzzy, spaces, ideas, files):
        found = found.unionByName(part.select("project_id", "anchor", "id", "confidence"))
    return found.select("project_id", "anchor", "id", confidence_activation(F.col("confidence")).alias("activation"))


def spread(g: Graph, seeds: DataFrame) -> DataFrame:
    """set, id, activation: the best product over paths from seeds(set, id, activation), kept from the threshold on.

    An edge passes on activation x 0.6 x weight (0.5 where that is not positive, 1 without a weight row). With weights and seeds of
    at most 1, 0.6^5 < 0.1, so the frontier dies within the depth.
    """
    w = F.when(F.col("weight") <= 0, 0.5).otherwise(F.col("weight"))
    steps = laid_out(g, "weighted", weighted(g).select(F.col("source_id").alias("node"), F.col("target_id").alias("next"), w.alias("w")))
    # what is known stays in buckets of set and id, both packed; a round moves only what it passes on
    start = seeds.groupBy(packed(F.col("set")).alias("set"), packed(F.col("id")).alias("id")).agg(F.max("activation").alias("activation"))
    best = bucketed(start.withColumn("round", F.lit(0)), ["set", "id"], "best", dealt=True)
    for k in range(DEPTH):
        frontier = best.where(F.col("round") == k).select("set", unpacked(F.col("id")).alias("node"), "activation")
        if frontier.isEmpty():
            break
        passed = steps.from_(frontier).select("set", packed(F.col("next")).alias("id"), (F.col("activation") * DECAY * F.col("w")).alias("passed")).where(F.col("passed") >= THRESHOLD)
        passed = passed.groupBy("set", "id").agg(F.max("passed").alias("passed"))
        # a path back may be no better than what is there
        better = F.col("passed").isNotNull() & (F.col("activation").isNull() | (F.col("passed") > F.col("activation")))
        before, best = best, bucketed(best.join(passed, ["set", "id"], "full").select("set", "id", F.greatest("activation", "passed").alias("activation"), F.when(better, k + 1).otherwise(F.col("round")).alias("round")), ["set", "id"], "best", dealt=True)
        forget(before)
    return best.select(unpacked(F.col("set")).alias("set"), unpacked(F.col("id")).alias("id"), "activation")


def top(found: DataFrame, k: int = TOP) -> DataFrame:
    return ranked(found, ["set"], [F.desc("activation"), F.asc("id")], k).withColumn("confidence", activation_confidence(F.col("activation")))


def _raised(weight: Column) -> Column:
    return F.greatest(F.lit(FLOOR), F.least(F.lit(CEILING), weight + RATE * F.col("_s") * F.col("_t")))


def _strengthened(g: Graph, a: DataFrame) -> DataFrame:
    """hebbian() of a graph with weights on its edges: each edge meets what its ends have, once, and its id is made afterwards."""
    s, t = (a.select(F.col("id").alias(end), F.col("activation").alias(name)) for end, name in (("source_id", "_s"), ("target_id", "_t")))
    e = shrunk(g.edges.select("source_id", "target_id", "type", "source_class", "weight"), "source_id", "target_id")
    hit = F.col("_s").isNotNull() & F.col("_t").isNotNull()
    e = e.join(s, "source_id", "left").join(t, "target_id", "left").where(hit | F.col("weight").isNotNull())
    new = F.when(hit, _raised(F.coalesce("weight", F.lit(1.0)))).otherwise(F.greatest(F.lit(FLOOR), F.col("weight") * FADE))
    kind = F.when(hit & (F.col("source_class") == "speculative") & (new >= PROMOTE), "associative").otherwise(F.col("source_class"))
    e = grown(e, "source_id", "target_id")
    return e.select(edge_id(F.col("source_id"), F.col("type"), F.col("target_id")).alias("edge_id"), new.alias("weight"), kind.alias("source_class"), F.when(hit, 1).otherwise(0).alias("co_activations"))


def hebbian(g: Graph, anchors: DataFrame) -> DataFrame:
    """The new weight table: edges with both ends among anchors(id, activation) are strengthened, other rows fade."""
    a = anchors.groupBy("id").agg(F.max("activation").alias("activation"))
    if g.derived and "weight" in g.edges.columns:
        return _strengthened(g, shrunk(a, "id"))
    s, t = a.select(F.col("id").alias("source_id"), F.col("activation").alias("_s")), a.select(F.col("id").alias("target_id"), F.col("activation").alias("_t"))
    old = g.weights.select(F.col("edge_id").alias("id"), "weight", F.col("source_class").alias("class"))
    hit = g.edges.drop("weight").join(s, "source_id").join(t, "target_id").join(old, "id", "left")
    new = _raised(F.coalesce("weight", F.lit(1.0)))
    kind = F.coalesce("class", "source_class")
    hit = hit.select(F.col("id").alias("edge_id"), new.alias("weight"), F.when((kind == "speculative") & (new >= PROMOTE), "associative").otherwise(kind).alias("source_class"), F.lit(1).alias("co_activations")).dropDuplicates(["edge_id"])
    rest = g.weights.join(hit.select("edge_id"), "edge_id", "left_anti").select("edge_id", F.greatest(F.lit(FLOOR), F.col("weight") * FADE).alias("weight"), "source_class", F.lit(0).alias("co_activations"))
    return hit.unionByName(rest)


def fade(weights: DataFrame, rate: float = FADE) -> DataFrame:
    return weights.withColumn("weight", F.greatest(F.lit(FLOOR), F.col("weight") * rate))


def merge_activation(old: DataFrame, new: DataFrame) -> DataFrame:
    """Activation replaced, peak kept: old and new (node_id, activation[, peak])."""
    a = old.select("node_id", F.col("activation").alias("_old"), (F.col("peak") if "peak" in old.columns else F.col("activation")).alias("_peak"))
    joined = a.join(new.select("node_id", F.col("activation").alias("_new")), "node_id", "full")
    return joined.select("node_id", F.coalesce("_new", "_old").alias("activation"), F.greatest("_peak", "_new").alias("peak"))


def reset(activation: DataFrame) -> DataFrame:
    """Activation 0 where it was above, peaks kept."""
    return activation.select("node_id", F.when(F.col("activation") > 0, 0.0).otherwise(F.col("activation")).alias("activation"), (F.col("peak") if "peak" in activation.columns else F.col("activation")).alias("peak"))


def activate(g: Graph, anchors: DataFrame, k: int = TOP) -> tuple[DataFrame, DataFrame]:
    """The activation table after one pass over anchors, and the enriched top k: without anchors that exist, what is most active now."""
    found = spread(g, _seeds(g, anchors, k))
    table = merge_activation(g.activation, found.select(F.col("id").alias("node_id"), "activation"))
    return table, enriched(g, top(found, k).select("id", "activation"))


def _seeds(g: Graph, anchors: DataFrame, k: int) -> DataFrame:
    seeds = resolve_anchors(g, anchors).select(F.lit("all").alias("set"), "id", "activation")
    if seeds.isEmpty():
        seeds = g.activation.orderBy(F.desc("activation"), "node_id").limit(k).select(F.lit("all").alias("set"), F.col("node_id").alias("id"), "activation")
    return seeds


def cycle(g: Graph, anchors: DataFrame, k: int = TOP, loops: int = LOOPS, used: Callable[[DataFrame], float] | None = None) -> DataFrame:
    """Resolve, spread, strengthen, until the top k no longer change, the loops are used up, or what is found takes 0.85 of the context.

    used tells what share of the context the nodes of a round take. rounds and converged (the top k settled) are columns of the
    result. The driver sees k ids a round.
    """
    seeds = _seeds(g, anchors, k)
    seen: set | None = None
    best, rounds, converged = None, 0, False
    for rounds in range(1, loops + 1):
        best = settle(top(spread(g, seeds), k), "top")
        now = {r.id for r in best.select("id").collect()}
        converged = now == seen
        if converged or used is not None and used(best) >= CONTEXT:
            break
        seen = now
        g = with_weights(g, settle(hebbian(g, best), "weights").drop("co_activations"))
    return best.withColumns({"rounds": F.lit(rounds), "converged": F.lit(converged)})


def with_weights(g: Graph, weights: DataFrame) -> Graph:
    """g with another weight table, written on its edges too."""
    edges = g.edges.drop("weight").join(weights.select(F.col("edge_id").alias("id"), "weight"), "id", "left")
    return Graph(g.nodes, settle(edges, "edges"), weights, g.activation)


def enriched(g: Graph, found: DataFrame) -> DataFrame:
    """The nodes of found(id, activation) with their confidence and their edges of both directions; nodes that are gone are left out."""
    # an edge moves once for each end, with packed ids; what it is shown as is made after it has been gathered
    e = weighted(g).select("type", "weight", packed(F.col("source_id")).alias("source_id"), packed(F.col("target_id")).alias("target_id"), *([] if g.derived else ["id"]))
    parts = [c for c in e.columns if c not in ("source_id", "target_id")]
    other = lambda near, far, out: F.struct(F.col(near).alias("node"), F.col(far).alias("other"), F.lit(out).alias("out"))
    ends = F.when(F.col("source_id") == F.col("target_id"), F.array(other("source_id", "target_id", True))).otherwise(F.array(other("source_id", "target_id", True), other("target_id", "source_id", False)))
    both = e.select(*parts, F.explode(ends).alias("e")).select("e.*", *parts)
    wanted = shrunk(found.select(F.col("id").alias("node"), "activation"), "node")
    near = both.join(wanted.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.collect_set(F.struct("other", "out", *parts)).alias("edges"))

    def shown(x: Column) -> Column:
        me, far = unpacked(F.col("node")), unpacked(x["other"])
        source, target = F.when(x["out"], me).otherwise(far), F.when(x["out"], far).otherwise(me)
        made = edge_id(source, x["type"], target) if g.derived else x["id"]
        return F.struct(made.alias("id"), source.alias("source_id"), target.alias("target_id"), x["type"].alias("type"), x["weight"].alias("weight"))

    n = g.nodes.select(packed(F.col("id")).alias("node"), "type", "canonical_id")
    all_of = n.join(wanted, "node").join(near, "node", "left").withColumn("edges", F.array_sort(F.transform(F.coalesce("edges", F.array().cast(near.schema["edges"].dataType)), shown)))
    return all_of.select(unpacked(F.col("node")).alias("id"), "type", "canonical_id", "activation", activation_confidence(F.col("activation")).alias("confidence"), "edges")
