"""Ranked search over nodes, related nodes by pattern, source ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import search_tokens
from ..sources.tables import Graph, short
from .grams import FEW, holding
from .reads import ranked

#: Patterns of related nodes, in the order in which they are tried.
PATTERNS = {
    "tests": ["test", "tests", "spec", "fixture", "fixtures", "phpunit", "__tests__"],
    "entrypoints": ["route", "routes", "endpoint", "controller", "add_action", "add_filter", "do_action", "apply_filters", "register", "bootstrap", "init", "handler"],
    "lifecycle": ["init", "load", "session", "auth", "authenticate", "validate", "persist", "save", "merge", "handle", "callback"],
}


def score(tokens: Column, label: Column, canonical: Column, file: Column, kind: Column, line: Column) -> Column:
    """Ladders for label and canonical id, a bonus for the file, per token; then one bonus each for symbol, file and line."""
    label, canonical, file = F.lower(label), F.lower(canonical), F.lower(F.coalesce(file, F.lit("")))

    def one(t: Column) -> Column:
        a = F.when(label == t, 90).when(label.contains(t), 45).otherwise(0)
        b = F.when(canonical == t, 80).when(F.endswith(canonical, t), 55).when(canonical.contains(t), 35).otherwise(0)
        return a + b + F.when(file.contains(t), 20).otherwise(0)

    total = F.aggregate(tokens, F.lit(0), lambda s, t: s + one(t))
    return total + F.when(kind == "symbol", 8).otherwise(0) + F.when(file != "", 5).otherwise(0) + F.when(line > 0, 3).otherwise(0)


def reasons(tokens: Column, label: Column, canonical: Column, file: Column) -> Column:
    """What of a node each token stands in, in the order of the ladders."""
    label, canonical, file = F.lower(label), F.lower(canonical), F.lower(F.coalesce(file, F.lit("")))

    def said(t: Column) -> Column:
        a = F.when(label == t, F.concat(F.lit("label exact:"), t)).when(label.contains(t), F.concat(F.lit("label:"), t))
        b = F.when(canonical == t, F.concat(F.lit("canonical exact:"), t)).when(F.endswith(canonical, t), F.concat(F.lit("canonical suffix:"), t)).when(canonical.contains(t), F.concat(F.lit("canonical:"), t))
        return F.array(a, b, F.when(file.contains(t), F.concat(F.lit("file:"), t)))

    found = F.array_compact(F.flatten(F.transform(tokens, said)))
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise("matched query")


def _hits(g: Graph, q: DataFrame, few: int) -> DataFrame:
    """nodes with each query(query, tokens) a token of which stands in their ids, labels or files.

    A few queries are met by one scan; many look their tokens up in posting lists of the projects.
    """
    hit = lambda c: F.exists("tokens", lambda t: F.contains(F.lower(c), t))
    found = hit(F.col("canonical_id")) | hit(F.col("label")) | hit(F.coalesce("source_file", F.lit("")))
    if q.limit(few + 1).count() <= few:
        return g.nodes.join(F.broadcast(q), found)
    hay = F.lower(F.concat_ws("\n", "canonical_id", "label", F.coalesce("source_file", F.lit(""))))
    token = q.select("query", F.explode("tokens").alias("needle"))
    asked = token.select(F.lit("").alias("project_id"), "needle")
    pairs = holding(g, asked, "names", hay, 0, everywhere=True).join(token, "needle").select("id", "query").distinct()
    return g.nodes.join(pairs, "id").join(q, "query")


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query", search_tokens(F.col("query")).alias("tokens")).where(F.size("tokens") > 0)


def _scored(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", score(F.col("tokens"), F.col("label"), F.col("canonical_id"), F.col("source_file"), F.col("type"), F.col("line_start")))


def search(g: Graph, queries: DataFrame, limit: int = 10, few: int = FEW) -> DataFrame:
    """Per row of queries(query) and project: the best nodes. A first cut keeps the max(100, 12 limit) shortest canonical ids."""
    first = ranked(_hits(g, _asked(queries), few), ["query", "project_id"], [F.length("canonical_id"), F.col("id")], max(100, 12 * limit)).drop("rank")
    return ranked(_scored(first), ["query", "project_id"], [F.desc("score"), F.octet_length("canonical_id"), F.length("canonical_id"), F.col("id")], limit).withColumn("reason", reasons(F.col("tokens"), F.col("label"), F.col("canonical_id"), F.col("source_file"))).drop("tokens")


def related(g: Graph, patterns: list[str], query: str = "", anchors: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """Per project the nodes that one of the patterns occurs in, with the first such pattern.

    Candidates are, in this order, all that the query finds, the anchors(id), and all that each word of the query and each pattern finds
    when searched for, each in the order of search(); a node counts where it comes first. Only the answer is cut, to `limit` nodes.
    """
    spark = g.nodes.sparkSession
    words = [r[0] for r in spark.range(1).select(F.explode(search_tokens(F.lit(query)))).collect()]
    terms = ([(0, query)] if query else []) + [(k + 2, t) for k, t in enumerate([*words, *patterns])]
    asked = spark.createDataFrame(terms, "place int, query string")
    first = asked.groupBy("query").agg(F.min("place").alias("place"))
    hay = F.lower(F.concat_ws(" ", "canonical_id", "label", F.coalesce("source_file", F.lit(""))))
    pattern = F.get(F.filter(F.lit(patterns), lambda p: hay.contains(p)), F.lit(0))
    # what no pattern occurs in goes first, so that nothing need be ranked but what is left
    marked = Graph(g.nodes.withColumn("pattern", pattern).where("pattern is not null"), g.edges, g.weights, g.activation)
    best = F.struct((-F.col("score")).alias("score"), F.octet_length("canonical_id").alias("bytes"), F.length("canonical_id").alias("length"))
    found = _scored(_hits(marked, _asked(first.select("query")), FEW).join(short(first), "query")).select("id", "project_id", "pattern", "place", best.alias("best"))
    if anchors is not None:
        held = marked.nodes.join(anchors.select("id").distinct(), "id", "left_semi")
        even = F.struct(F.lit(0).alias("score"), F.lit(0).alias("bytes"), F.lit(0).alias("length"))
        found = found.unionByName(held.select("id", "project_id", "pattern", F.lit(1).alias("place"), even.alias("best")))
    once = found.groupBy("project_id", "id", "pattern").agg(F.min(F.struct("place", "best")).alias("first"))
    return ranked(once, ["project_id"], [F.col("first.place"), F.col("first.best"), F.col("id")], limit).drop("first")


def source_ranges(texts: DataFrame, start: Column, end: Column, context: int = 2, most: int = 81) -> DataFrame:
    """id, line, text: lines start - context to end + context of texts(id, text), within the text and at most `most` of them."""
    rows = texts.select("id", F.split("text", "\n").alias("lines"), start.alias("s"), end.alias("e"))
    first = F.greatest(F.col("s") - context, F.lit(1))
    last = F.least(F.col("e") + context, F.size("lines"), first + most - 1)
    cut = rows.withColumn("first", first).where(first <= last).select("id", "first", F.posexplode(F.slice("lines", first, last - first + 1)).alias("k", "text"))
    return cut.select("id", (F.col("first") + F.col("k")).alias("line"), "text")
