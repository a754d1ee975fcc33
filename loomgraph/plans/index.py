"""Indexing a source tree: list, compare hashes, extract what changed, reconcile, publish all tables as one version."""

from __future__ import annotations

import hashlib
import inspect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import edge_id, node_id
from ..operators import merge, reads
from ..operators.traverse import settle
from ..sources import braces, declare, effects, extract, walk


def version_of(*modules) -> str:
    """A version that changes with the text of the modules."""
    return hashlib.sha256("".join(map(inspect.getsource, modules)).encode()).hexdigest()[:16]


#: What extractors depend on; another value makes every file count as changed.
EXTRACTORS = {"python": version_of(extract, effects), **dict.fromkeys(("go", "typescript"), version_of(extract, effects, braces, declare))}
NODES = "id string, project_id string, type string, label string, canonical_id string, source_class string, source_file string, kind string, exported boolean, line_start long, line_end long"
EDGES = "id string, project_id string, source_id string, target_id string, type string, source_class string"
OWNERS, HASHES = "rel_path string, id string, run string", "rel_path string, hash string"


def fingerprint(extractors: dict[str, str] = EXTRACTORS) -> str:
    return hashlib.sha256("|".join(f"{k}@{v}" for k, v in sorted(extractors.items())).encode()).hexdigest()


@dataclass
class Extraction:
    nodes: DataFrame
    edges: DataFrame
    owners: DataFrame


def symbols(files: DataFrame) -> DataFrame:
    """rel_path, type, canonical_id, label, kind, exported, line_start, line_end, bases over all languages; bases: canonical ids that the classes which one extends have in its file."""
    py = extract.python_symbols(files)
    named = F.filter(F.from_json(F.get_json_object("detail", "$.bases"), "array<string>"), lambda b: b.rlike(r"^\w+$"))
    py = py.withColumn("bases", F.transform(named, lambda b: F.concat_ws(":", F.substring_index("canonical_id", ":", 1), b))).drop("detail")
    d = extract.declarations(files)
    name = F.when(F.col("receiver") != "", F.concat_ws(".", "receiver", "label")).otherwise(F.col("label"))
    space = F.col("kind").isin("import", "package")
    base = F.when(F.col("base") != "", F.array(F.concat_ws(":", "rel_path", "base")))
    other = d.select("rel_path", F.when(space, "namespace").otherwise("symbol").alias("type"), F.when(space, F.col("label")).otherwise(F.concat_ws(":", "rel_path", name)).alias("canonical_id"), name.alias("label"), "kind", F.when(~space, F.col("exported")).alias("exported"), "line_start", "line_end", base.alias("bases"))
    plain = files.where(F.coalesce("language", F.lit("")) != "python").select("rel_path", F.lit("file").alias("type"), F.col("rel_path").alias("canonical_id"), F.element_at(F.split("rel_path", "/"), -1).alias("label"), *[F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("exported", "boolean"), ("line_start", "int"), ("line_end", "int"), ("bases", "array<string>"))])
    return py.unionByName(other).unionByName(plain)


def graph_of(found: DataFrame, project: str, run: str) -> Extraction:
    """Nodes, edges (file defines symbol, contains its module, imports a namespace; class extends class) and who owns them; found is symbols()."""
    p = F.lit(project)
    rows = found.withColumns({"id": node_id(p, F.col("type"), F.col("canonical_id")), "file_id": node_id(p, F.lit("file"), F.col("rel_path"))})
    # several files may name one namespace: the first by path describes it
    first = rows.groupBy("id").agg(F.min(F.struct("rel_path", "line_start", "type", "label", "canonical_id", "kind", "exported", "line_end")).alias("r"))
    shared = F.col("r.type") == "namespace"
    nodes = first.select("id", p.alias("project_id"), "r.type", "r.label", "r.canonical_id", F.lit("structural").alias("source_class"), F.when(~shared, F.col("r.rel_path")).alias("source_file"), "r.kind", "r.exported", F.col("r.line_start").cast("long").alias("line_start"), F.col("r.line_end").cast("long").alias("line_end"))
    kind = F.when(F.col("type") == "symbol", "defines").when(F.col("kind").isin("import", "relative"), "imports").otherwise("contains")
    links = rows.where("type <> 'file'").select(F.col("file_id").alias("source_id"), F.col("id").alias("target_id"), kind.alias("type"), "rel_path").distinct()
    # a class of the same file is what a base names; others are not guessed at
    bases = rows.select("id", "rel_path", F.explode("bases").alias("base")).select(F.col("id").alias("source_id"), node_id(p, F.lit("symbol"), F.col("base")).alias("target_id"), F.lit("extends").alias("type"), "rel_path").distinct()
    links = links.unionByName(bases.join(rows.where("kind = 'class'").select(F.col("id").alias("target_id"), "rel_path").distinct(), ["target_id", "rel_path"], "left_semi").select(*links.columns))
    links = links.withColumn("id", edge_id(F.col("source_id"), F.col("type"), F.col("target_id")))
    source = F.when(F.col("type") == "extends", "speculative").otherwise("structural").alias("source_class")
    edges = links.select("id", p.alias("project_id"), "source_id", "target_id", "type", source).dropDuplicates(["id"])
    owners = rows.select("rel_path", "id").unionByName(links.select("rel_path", "id")).distinct().withColumn("run", F.lit(run))
    return Extraction(nodes, edges, owners)


IIR = "rel_path string, project_id string, node_id string, kind string, language string, payload string, source_hash string, run string"


def observed(files: DataFrame, project: str, run: str) -> DataFrame:
    """The intents of the functions of files(rel_path, language, hash, content) as records on their symbols; one that is not whole ends the run."""
    found = extract.function_intents(files)
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace("rel_path", r"\.pyi?$", ""), "/", "."), r"\.__init__$", "")
    label = F.concat_ws(".", "owner", "name")
    whole = (F.trim("name") != "") & ~F.exists("inputs", lambda x: F.trim(x["name"]) == "") & ~F.exists("behavior", lambda b: (F.trim(b["when"]) == "") | (F.trim(b["then"]) == ""))
    name = F.when(F.coalesce(whole, F.lit(False)), F.concat_ws(":", F.when(F.col("language") == "python", stem).otherwise(F.col("rel_path")), label)).otherwise(F.raise_error(F.concat(F.lit("an intent that is not whole in "), "rel_path")).cast("string"))
    body = F.to_json(F.struct(F.lit("FunctionIntent").alias("kind"), "name", "language", F.lit("observed").alias("origin"), "visibility", "inputs", "returns", "behavior", F.col("effects").alias("sideEffects"), F.col("failures").alias("failureModes")))
    rows = found.select("rel_path", F.lit(project).alias("project_id"), node_id(F.lit(project), F.lit("symbol"), name).alias("node_id"), F.lit("extracted").alias("kind"), "language", body.alias("payload"))
    # a name that a file defines twice is one symbol; of its intents the first in text order of the payload is kept
    first = rows.groupBy("rel_path", "project_id", "node_id", "kind", "language").agg(F.min("payload").alias("payload"))
    return first.join(files.select("rel_path", F.col("hash").alias("source_hash")), "rel_path").withColumn("run", F.lit(run))


class FailedRun(RuntimeError):
    """A run that was given up; the store has it in its ledger, and the graph of the run before it."""


RUNS = "ord long, run string, project_id string, fingerprint string, status string, error string, files long, bytes long, nodes long, edges long"


def _ledger(spark: SparkSession, store: merge.Versions, project: str, run: str, status: str, error: str | None = None, stats: dict[str, int] | None = None) -> DataFrame:
    """The runs so far and this one; files and bytes are what was listed, nodes and edges what the version holds."""
    told = [(stats or {}).get(c) for c in ("files", "bytes", "nodes", "edges")]
    row = spark.createDataFrame([(store.current() + 1, run, project, fingerprint(), status, error, *told)], RUNS)
    return row.unionByName(store.read("runs"), allowMissingColumns=True) if store.current() else row


def index(spark: SparkSession, root: str, store: merge.Versions, project: str, run: str, full: bool = False, globs: list[str] | None = None, only: list[str] | None = None) -> dict[str, int]:
    """Bring the store up to date with the tree and return counts. Only files whose hash changed are opened again.

    With `only` nothing but those relative paths is looked at: changed ones are indexed again, those that are gone are deleted.
    Everything is checked before the version's pointer is written; a run that fails in any file leaves the graph of the version
    before it in place, and an entry in the ledger.
    """
    try:
        return _index(spark, root, store, project, run, full, globs, only)
    except Exception as e:
        failed = {"runs": _ledger(spark, store, project, run, "failed", f"{type(e).__name__}: {e}"[:2000])}
        if not store.current():
            failed |= {n: spark.createDataFrame([], s) for n, s in (("nodes", NODES), ("edges", EDGES), ("owners", OWNERS), ("hashes", HASHES), ("iir", IIR))}
        store.publish(failed)
        raise FailedRun(f"run {run} was given up") from e


def _completed(store: merge.Versions) -> DataFrame:
    return store.read("runs").where("status = 'completed'")


def _index(spark: SparkSession, root: str, store: merge.Versions, project: str, run: str, full: bool, globs: list[str] | None, only: list[str] | None) -> dict[str, int]:
    empty = lambda schema: spark.createDataFrame([], schema)
    known = store.current() > 0
    last = _completed(store).orderBy(F.desc("ord")).first() if known else None
    if known and (last is None or last.fingerprint != fingerprint()):
        full, only = True, None
    live = merge.State(*(store.read(t) for t in ("nodes", "edges", "owners", "hashes"))) if known else merge.State(empty(NODES), empty(EDGES), empty(OWNERS), empty(HASHES))
    listing = walk.files(spark, root, globs)
    hashes = empty(HASHES) if full else live.hashes
    if only is not None:
        asked = walk.paths(listing, spark.createDataFrame([(p,) for p in only], "rel_path string"))
        listing = asked.where(~F.col("deleted")).select("rel_path", "language", "hash", "content")
        hashes = hashes.join(asked.select("rel_path"), "rel_path", "left_semi")
    # what is written is counted as it is written
    read, nodes, edges = Observation("listing"), Observation("nodes"), Observation("edges")
    listing = settle(listing.observe(read, F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes")), "listing")
    seen = listing.select("rel_path", "hash")
    diff = settle(merge.file_diff(seen, hashes), "diff")
    todo = listing.join(diff.where("action = 'process'"), "rel_path", "left_semi")
    found = graph_of(settle(symbols(todo), "symbols"), project, run)
    gone = F.when(F.col("action") == "delete", "deleted")
    files = (diff if only is not None else diff.where("action <> 'delete'")).select("rel_path", gone.when(F.col("action") == "process", "indexed").otherwise("walked").alias("status"))
    staged = merge.State(found.nodes, found.edges, found.owners, seen.join(todo.select("rel_path"), "rel_path", "left_semi"))
    # an intent is of a symbol that the run has found
    lifted = settle(observed(todo, project, run).join(found.nodes.where("type = 'symbol'").select(F.col("id").alias("node_id")), "node_id", "left_semi").select(*[c.split(" ")[0] for c in IIR.split(", ")]), "intents")
    kept = store.read("iir").join(diff.where("action <> 'skip'").select("rel_path"), "rel_path", "left_anti") if known and store.has("iir") else empty(IIR)
    if known and store.has("iir") and full and only is None:
        kept = kept.join(listing.select("rel_path"), "rel_path", "left_semi")
    out = merge.reconcile(live, staged, files, run, "paths" if only is not None else "full" if full or last is None else "incremental")
    counts = {r.action: r["count"] for r in diff.groupBy("action").count().collect()}
    ord_ = store.current() + 1
    stats: dict[str, int] = {}

    def completed() -> DataFrame:
        stats.update(read.get | nodes.get | edges.get)
        return _ledger(spark, store, project, run, "completed", stats=stats)

    store.publish({
        "nodes": out.nodes.observe(nodes, F.count(F.lit(1)).alias("nodes")), "edges": out.edges.observe(edges, F.count(F.lit(1)).alias("edges")), "owners": out.owners, "hashes": out.hashes,
        "iir": kept.select(*lifted.columns).unionByName(lifted), "manifest": files.withColumn("run", F.lit(run)), "runs": completed,
    })
    return stats | {"version": ord_, "processed": counts.get("process", 0), "skipped": counts.get("skip", 0), "deleted": counts.get("delete", 0)}


#: Units and bounds of the bytes that are worked on at once, and how often what a file becomes is held.
UNIT, IN_FLIGHT, EXPANSION = 64 * 1024, 64 << 20, 16


def in_flight_bytes(size: Column, plugins: int) -> Column:
    """What a file of so many bytes is reckoned to take while it is worked on."""
    return F.greatest(size, F.lit(1)) * EXPANSION * max(2, plugins + 1)


def admitted(listing: DataFrame, plugins: int, most: int = IN_FLIGHT, buckets: int = 64) -> DataFrame:
    """listing(rel_path, length) with units, bucket and part: the files of a bucket in order, cut into parts of about `most` bytes in flight.

    A part is what one task works on; a file counts at most as much as a whole part. Buckets keep the running sum from one task.
    """
    units = F.least(F.greatest(F.ceil(in_flight_bytes(F.col("length"), plugins) / UNIT), F.lit(1)), F.lit(max(1, most // UNIT))).cast("long")
    before = Window.partitionBy("bucket").orderBy("rel_path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return listing.withColumns({"units": units, "bucket": F.pmod(F.xxhash64("rel_path"), F.lit(buckets)).cast("int")}).withColumn("part", F.floor((F.sum("units").over(before) - 1) / max(1, most // UNIT)).cast("long"))


def ready(store: merge.Versions) -> bool:
    """Whether a completed version may be queried."""
    return store.current() > 0 and not _completed(store).isEmpty()


def dangling(store: merge.Versions) -> DataFrame:
    """Edges of the current version without one of their ends; none is expected."""
    nodes = store.read("nodes")
    return reads.missing_endpoints(store.read("edges"), nodes, nodes)
