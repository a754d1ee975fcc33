"""Record tables beside the graph: scans by their keys, append-only and in-place writes, tokens and their expiry.

Every scan takes a table and the keys wanted as DataFrames, and gives rows a place in the order of their key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .merge import upsert


def scan(rows: DataFrame, wanted: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The rows of the wanted keys with their place, by key and order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.join(wanted.select(*keys).distinct(), keys, "left_semi").withColumn("place", F.row_number().over(w))


def intent_row(iir: DataFrame, wanted: DataFrame) -> DataFrame:
    """The intents of wanted(project_id, node_id, kind)."""
    return iir.join(wanted.select("project_id", "node_id", "kind").distinct(), ["project_id", "node_id", "kind"], "left_semi")


def intents_of_nodes(iir: DataFrame, wanted: DataFrame) -> DataFrame:
    return scan(iir, wanted, ["project_id", "node_id"], ["kind"])


def intents_of_projects(iir: DataFrame, wanted: DataFrame) -> DataFrame:
    """Intents of wanted(project_id, kind) by node."""
    return scan(iir, wanted, ["project_id", "kind"], ["node_id"])


def log_of_runs(log: DataFrame, wanted: DataFrame) -> DataFrame:
    return scan(log, wanted, ["run_id"], ["loop_index", "ts", "id"])


def log_of_sessions(log: DataFrame, wanted: DataFrame) -> DataFrame:
    return scan(log, wanted, ["session_id"], ["ts", "id"])


def enrichments_of_runs(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    return scan(rows, wanted, ["run_id"], ["loop_index", "created_at", "id"])


def enrichments_of_entities(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    return scan(rows, wanted, ["entity_id"], ["created_at", "id"])


def plans_by_id(plans: DataFrame, wanted: DataFrame) -> DataFrame:
    return plans.join(wanted.select("id").distinct(), "id", "left_semi")


def plan_history(plans: DataFrame, wanted: DataFrame) -> DataFrame:
    """All revisions of the plans of wanted(project_id, unit_id), first ones first."""
    return scan(plans, wanted, ["project_id", "unit_id"], ["revision", "created_at"])


def latest_plans(plans: DataFrame, wanted: DataFrame) -> DataFrame:
    last = scan(plans, wanted, ["project_id", "unit_id"], [F.desc("revision"), F.desc("created_at")])
    return last.where("place = 1").drop("place")


def records_of_plans(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Recipes, artifacts, verifications, approvals, test plans or repairs of wanted(plan_revision_id), by time and id."""
    return scan(rows, wanted, ["plan_revision_id"], ["created_at", "id"])


def projects_by(projects: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Projects by id or git_url, or by a path of paths(project_id, path) if wanted has that joined on."""
    return projects.join(wanted.select(column).distinct(), column, "left_semi")


def projects_by_path(projects: DataFrame, paths: DataFrame, wanted: DataFrame) -> DataFrame:
    at = paths.join(wanted.select("path").distinct(), "path", "left_semi").select(F.col("project_id").alias("id"), "path")
    return projects.join(at, "id")


def project_list(projects: DataFrame) -> DataFrame:
    return projects.orderBy(F.desc("last_seen_at"), "id")


def project_paths(paths: DataFrame, wanted: DataFrame) -> DataFrame:
    return scan(paths, wanted, ["project_id"], [F.desc("last_seen"), "path"])


def vocabulary(seeds: DataFrame, project: str | None = None) -> DataFrame:
    """Seeds of a project (its own and those that all projects share), or of the organisation, by term."""
    if project is None:
        return seeds.where("scope = 'org'").orderBy("term")
    return seeds.where((F.col("scope") == "project") | F.col("project_id").eqNullSafe(F.lit(project))).orderBy("term")


def seed_by_term(seeds: DataFrame, wanted: DataFrame) -> DataFrame:
    """For wanted(project_id, term) one seed: the project's own before those shared by projects, and these before the organisation's."""
    s = seeds.select("term", F.col("project_id").alias("owner"), "scope", "definition")
    hit = wanted.select("project_id", "term").distinct().join(s, "term").where((F.col("owner") == F.col("project_id")) | F.col("scope").isin("project", "org"))
    place = F.when(F.col("owner") == F.col("project_id"), 0).when(F.col("scope") == "project", 1).otherwise(2)
    w = Window.partitionBy("project_id", "term").orderBy(place, "owner", "definition")
    return hit.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place", "owner")


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append-only tables keep every row: enrichments, audit entries, the execution log, turns."""
    return old.unionByName(new.select(*old.columns))


def update(old: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """old with the columns that changes has set anew for its keys (a null leaves what was there); other rows and new keys don't count.

    So sessions are touched and ended, turns completed, projects and tokens marked.
    """
    fields = [c for c in changes.columns if c not in key]
    new = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in fields]).withColumn("_hit", F.lit(True))
    joined = old.join(new, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in old.columns])


def register(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new put in or refreshed; created_at stays."""
    return upsert(old, new, key)


def verdicts(rows: DataFrame) -> DataFrame:
    """artifact_id, verdict of verifications(artifact_id, verdict, created_at, id): the last one counts."""
    return rows.groupBy("artifact_id").agg(F.max_by("verdict", F.struct("created_at", "id")).alias("verdict"))


def verdict_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """artifact_id, before, after where the verdicts differ; one that is missing counts as empty."""
    a, b = verdicts(before).withColumnRenamed("verdict", "before"), verdicts(after).withColumnRenamed("verdict", "after")
    both = a.join(b, "artifact_id", "full").select("artifact_id", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))
    return both.where("before <> after")


def owner_counts(owners: DataFrame) -> DataFrame:
    """id, n: in how many files an entity is."""
    return owners.groupBy("id").agg(F.count("*").alias("n"))


def token_hash(token: str) -> str:
    """What is stored of a token."""
    return hashlib.sha256(token.encode()).hexdigest()


def live_tokens(tokens: DataFrame, hashes: DataFrame, now: int) -> DataFrame:
    """The tokens of hashes(token_hash) that are neither revoked nor expired at the time now (milliseconds; no expiry: null)."""
    fine = tokens.where(F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    return fine.join(hashes.select("token_hash").distinct(), "token_hash", "left_semi")


def fresh(rows: DataFrame, column: str, now: int, days: int = 30) -> DataFrame:
    """Rows whose time (milliseconds) is at most so many days before now, as for caches."""
    return rows.where(F.lit(now) - F.col(column) <= days * 86_400_000)


def now_millis() -> Column:
    """The clock of records, in whole seconds; tests hand in times of their own."""
    return F.unix_timestamp(F.current_timestamp()) * 1000


def line_range(properties: Column) -> Column:
    """line_start, line_end from JSON properties under either spelling, as numbers or text; 0 and 0 without a start above 0."""

    def whole(*names: str) -> Column:
        found = [F.get_json_object(properties, f"$.{n}") for n in names]
        # fractions are cut off, as numbers of JSON are; text must be a whole number
        return F.coalesce(*[F.coalesce(x.try_cast("int"), F.when(x.rlike(r"^-?[0-9]+\.[0-9]+([eE][+-]?[0-9]+)?$"), x.try_cast("double").cast("int"))) for x in found])

    start, end = whole("line_start", "start_line"), whole("line_end", "end_line")
    none = start.isNull() | (start <= 0)
    return F.struct(F.when(none, 0).otherwise(start).alias("line_start"), F.when(none, 0).when(end.isNull() | (end < start), start).otherwise(end).alias("line_end"))
