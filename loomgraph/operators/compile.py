"""From declared or lifted intents to implementation records, many plans at once: one row per plan, expressions over its arrays.

A plan has plan_id, language, lifecycle, unit struct<id, node_id, canonical_id>, intent (INTENT), bindings, claims, obligations and
questions (the array types below). Steps that a language model or a person takes are callables handed in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import effect_kind, record_id
from ..plans.order import PlanError

INTENT = "struct<name:string,visibility:string,inputs:array<struct<name:string,type:string>>,returns:struct<type:string>,behavior:array<struct<when:string,then:string,then_op:string>>,side_effects:array<struct<name:string,kind:string>>,failure_modes:array<struct<code:string,kind:string,source:string>>,constraints:array<string>>"
BINDINGS = "array<struct<id:string,canonical_id:string,state:string>>"
CLAIMS = "array<struct<id:string,kind:string,statement:string,state:string>>"
OBLIGATIONS = "array<struct<id:string,kind:string,requirement:string,state:string,producer:string>>"
QUESTIONS = "array<struct<id:string,prompt:string,blocking:boolean>>"
CHANGES = "array<struct<place:int,kind:string,operation:string,target:string,requirement:string>>"
PLAN = f"plan_id string, language string, lifecycle string, unit struct<id:string,node_id:string,canonical_id:string>, intent {INTENT}, bindings {BINDINGS}, claims {CLAIMS}, obligations {OBLIGATIONS}, questions {QUESTIONS}"

#: Phases in order, severities, coverages and the version of lifts and packs.
PHASES = ["resolve", "enrich", "constrain", "preGenerate", "verify", "repair"]
SEVERITIES = ["info", "warning", "error"]
COVERAGES = ["modeled", "partial", "unsupported"]
LIFT_VERSION = PACK_VERSION = "v1"
#: What questions, claims and findings say; {} is what they are about.
PROMPTS = {
    "coverage": "Plugin lift coverage is {}.",
    "target": "Which existing symbol should this change target, or should it create a new symbol?",
    "binding": "Which symbol satisfies the required {} role?",
    "failure strategy": "How should provider or domain failures be represented and propagated?",
    "approval": "Approve policy {} before generation.",
    "policy conflict": "mandatory policy conflict for {}",
    "resolve conflict": "Resolve the blocked policy or resolution conflict before rendering.",
}
#: The policies that every change of state is held to.
MUTATION_POLICIES = [
    {"id": "semantic.mutation.audit", "version": "v1", "phase": "constrain", "priority": 10, "severity": "error", "claim_kinds": ["effect.mutation"], "add": ("audit", "audit.publish", True)},
    {"id": "semantic.mutation.provider-failure", "version": "v1", "phase": "constrain", "priority": 20, "severity": "error", "claim_kinds": ["failure.propagated"], "add": ("failure.wrap", "wrap provider error", True)},
]


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _said(name: str, about: Column | str) -> Column:
    """A prompt about something."""
    before, after = PROMPTS[name].split("{}")
    return F.concat(F.lit(before), F.lit(about) if isinstance(about, str) else about, F.lit(after))


def _struct(**fields: Column | str) -> Column:
    return F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()])


def merge_evidence(parent: Column, more: Column) -> Column:
    """parent's items, then those of more whose id is new, each id once."""
    seen = F.transform(parent, lambda e: e["id"])
    first = F.filter(more, lambda e, k: ~F.exists(F.slice(more, F.lit(1), k), lambda x: x["id"] == e["id"]))
    return F.concat(parent, F.filter(first, lambda e: ~F.array_contains(seen, e["id"])))


# -- lifts ------------------------------------------------------------------------------------------------------------------


def normal_lift(lifted: DataFrame) -> DataFrame:
    """Lifts as they are stored: error (null if sound), coverage, claims and evidence in order.

    lifted(node_id, version, coverage, origin, name, language, claims array<id, kind, statement>, evidence array<path, start, end,
    basis>). One without version, coverage, claims and evidence is of old and counts as partial; a coverage that is not whole is
    itself a claim; a whole one needs evidence or claims.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    given = F.coalesce("claims", F.array().cast("array<struct<id:string,kind:string,statement:string>>"))
    whole = F.filter(given, lambda c: (text(c["id"]) != "") & (text(c["kind"]) != "") & (text(c["statement"]) != ""))
    once = F.filter(whole, lambda c, k: ~F.exists(F.slice(whole, F.lit(1), k), lambda x: x["id"] == c["id"]))
    spans = F.filter(F.coalesce("evidence", F.array().cast("array<struct<path:string,start:int,end:int,basis:string>>")), lambda e: (e["start"] >= 0) & (e["end"] >= e["start"]))
    old = blank("version") & blank("coverage") & (F.size(given) == 0) & (F.size(F.coalesce("evidence", F.array().cast("array<struct<path:string,start:int,end:int,basis:string>>"))) == 0)
    rows = lifted.withColumns({"version": F.when(old, LIFT_VERSION).otherwise(F.col("version")), "coverage": F.when(old, "partial").otherwise(F.col("coverage")), "claims": once, "evidence": F.array_sort(spans)})
    told = F.exists("claims", lambda c: c["kind"].isin("unknown", "unsupported"))
    own = _struct(id="lift-coverage", kind=F.when(F.col("coverage") == "unsupported", "unsupported").otherwise("unknown"), statement=_said("coverage", F.col("coverage")))
    partly = F.col("coverage").isin("partial", "unsupported") & ~told
    rows = rows.withColumn("claims", F.array_sort(F.when(partly, F.concat("claims", F.array(own))).otherwise(F.col("claims"))))
    error = (
        F.when(blank("node_id"), "no node").when(text(F.col("name")) == "", "no name").when(text(F.col("language")) == "", "no language")
        .when(~F.col("origin").eqNullSafe(F.lit("observed")), "not observed").when(~F.col("version").eqNullSafe(F.lit(LIFT_VERSION)), "unsupported version")
        .when(~F.coalesce(F.col("coverage").isin(COVERAGES), F.lit(False)), "invalid coverage").when((F.col("coverage") == "modeled") & (F.size("claims") == 0) & (F.size("evidence") == 0), "no evidence")
    )
    return rows.withColumn("error", error)


def can_satisfy(coverage: Column) -> Column:
    """Only a whole observation proves that something mandatory is met."""
    return coverage.eqNullSafe(F.lit("modeled"))


# -- plans ------------------------------------------------------------------------------------------------------------------


def shaped(requests: DataFrame) -> DataFrame:
    """requests with the questions that their plans start with, and unresolved as lifecycle where there is a blocking one.

    requests(plan_id, unit, intent, needed array<id, prompt, blocking>, needs_strategy boolean): a unit without a node asks for its
    target, each needed binding is asked for, and a failure strategy where one is required and no failure is declared.
    """
    target = F.when(F.coalesce(F.col("unit.node_id"), F.lit("")) == "", _struct(id="target-symbol", prompt=PROMPTS["target"], blocking=F.lit(True)))

    def binding(n: Column) -> Column:
        key = F.when(F.coalesce(n["id"], F.lit("")) == "", record_id("binding", n["prompt"])).otherwise(n["id"])
        return _struct(id=F.concat(F.lit("binding-"), key), prompt=F.when(F.coalesce(n["prompt"], F.lit("")) == "", _said("binding", key)).otherwise(n["prompt"]), blocking=n["blocking"])

    strategy = F.when(F.coalesce("needs_strategy", F.lit(False)) & (F.coalesce(F.size("intent.failure_modes"), F.lit(0)) <= 0), _struct(id="failure-strategy", prompt=PROMPTS["failure strategy"], blocking=F.lit(True)))
    asked = F.concat(F.array_compact(F.array(target)), F.transform(F.coalesce("needed", F.array().cast(QUESTIONS)), binding), F.array_compact(F.array(strategy))).cast(QUESTIONS)
    return requests.withColumn("questions", asked).withColumn("lifecycle", F.when(blocked(F.col("questions")), "resolving").otherwise("resolved"))


def blocked(questions: Column) -> Column:
    return F.exists(questions, lambda q: F.coalesce(q["blocking"], F.lit(False)))


def checked_policies(policies: list[dict]) -> list[dict]:
    """policies as given; refused if one is not whole."""
    for p in policies:
        if not str(p.get("id", "")).strip() or not str(p.get("version", "")).strip():
            raise PlanError("a policy needs id and version")
        if p.get("phase") not in PHASES or p.get("severity") not in SEVERITIES:
            raise PlanError(f"policy {p['id']!r} has an unknown phase or severity")
        if p.get("add") and not all(str(x).strip() for x in p["add"][:2]):
            raise PlanError(f"policy {p['id']!r} adds an obligation without kind or requirement")
    return policies


def merge_policies(*layers: list[dict]) -> list[dict]:
    """Layers of policies one after the other; a later one takes an earlier one away only by name and with a rationale."""
    merged: dict[str, dict] = {}
    for p in (p for layer in layers for p in checked_policies(layer)):
        if p["id"] in merged:
            raise PlanError(f"policy {p['id']!r} is defined more than once")
        if p.get("supersedes") and not str(p.get("override_rationale", "")).strip():
            raise PlanError(f"policy {p['id']!r} supersedes another without rationale")
        for x in p.get("supersedes", []):
            if x not in merged:
                raise PlanError(f"policy {p['id']!r} supersedes unknown policy {x!r}")
            del merged[x]
        merged[p["id"]] = p
    return list(merged.values())


def apply_policies(plans: DataFrame, policies: list[dict]) -> DataFrame:
    """plans with the obligations and questions that policies add, passes (policy, outcome) and findings, phase by phase.

    A policy selects plans by language, any of claim_kinds and all of all_claim_kinds. A mandatory obligation of a kind that is
    already there with another requirement is a conflict: the plan is blocked and asked about it.
    """
    ids = [p["id"] for p in checked_policies(policies)]
    if len(set(ids)) < len(ids):
        raise PlanError("a policy is defined more than once")
    kinds = F.transform("claims", lambda c: c["kind"])
    df = plans.withColumns({"passes": _none("array<struct<policy:string,outcome:string>>"), "findings": _none("array<struct<policy:string,severity:string,message:string>>")})
    for p in sorted(policies, key=lambda p: (PHASES.index(p["phase"]), p.get("priority", 0), p["id"])):
        fits = F.lit(True)
        if p.get("languages"):
            fits = fits & F.col("language").isin(p["languages"])
        if p.get("claim_kinds"):
            fits = fits & F.arrays_overlap(kinds, F.lit(p["claim_kinds"]))
        if p.get("all_claim_kinds"):
            fits = fits & (F.size(F.array_except(F.lit(p["all_claim_kinds"]), kinds)) == 0)
        fits = F.coalesce(fits, F.lit(False))
        clash, obligations, questions = F.lit(False), _none(OBLIGATIONS), _none(QUESTIONS)
        if p.get("add"):
            kind, requirement, mandatory = (*p["add"], True)[:3]
            if mandatory:
                clash = F.exists("obligations", lambda o: (o["kind"] == kind) & (o["requirement"] != requirement))
            made = _struct(id=record_id("obligation", F.col("plan_id"), F.lit(p["id"]), F.lit(kind)), kind=kind, requirement=requirement, state="declared", producer=p.get("producer") or p["id"])
            obligations = F.when(~clash, F.array(made)).otherwise(_none(OBLIGATIONS)).cast(OBLIGATIONS)
            message = PROMPTS["policy conflict"].format(kind)
            questions = F.when(clash, F.array(_struct(id=record_id("question", F.col("plan_id"), F.lit("conflict"), F.lit(p["id"])), prompt=message, blocking=F.lit(True)))).otherwise(_none(QUESTIONS))
        if p.get("require_approval"):
            asked = F.array(_struct(id=record_id("question", F.col("plan_id"), F.lit("approval"), F.lit(p["id"])), prompt=_said("approval", p["id"]), blocking=F.lit(True)))
            questions = F.when(clash, questions).otherwise(asked)
        said = F.when(clash, F.array(_struct(policy=p["id"], severity="error", message=PROMPTS["policy conflict"].format(p["add"][0] if p.get("add") else ""))))
        if p.get("supersedes"):
            said = said.otherwise(F.array(_struct(policy=p["id"], severity="info", message=f"Policy explicitly supersedes {', '.join(p['supersedes'])}.")))
        outcome = F.when(~fits, "skipped").when(clash, "conflict").otherwise("applied")
        df = df.withColumns({
            "obligations": F.when(fits, F.concat("obligations", obligations)).otherwise(F.col("obligations")),
            "questions": F.when(fits, F.concat("questions", questions)).otherwise(F.col("questions")),
            "findings": F.when(fits, F.concat("findings", F.coalesce(said, _none("array<struct<policy:string,severity:string,message:string>>")))).otherwise(F.col("findings")),
            "passes": F.concat("passes", F.array(_struct(policy=p["id"], outcome=outcome))),
        })
    stuck = F.exists("passes", lambda x: x["outcome"] == "conflict")
    return df.withColumn("lifecycle", F.when(stuck, "blocked").when((F.size("questions") > 0) & (F.col("lifecycle") == "resolved"), "resolving").otherwise(F.col("lifecycle")))


@dataclass
class Pack:
    """Policies that a plug-in contributes for some languages (none: for all)."""

    plugin: str
    version: str
    policies: list[dict]
    languages: list[str] = field(default_factory=list)
    schema_version: str = PACK_VERSION


def decorated(plans: DataFrame, packs: list[Pack], builtin: list[dict] | None = None, project: list[dict] | None = None) -> DataFrame:
    """plans after the built-in policies, those of the packs for their language, and the project's; with applied, skipped plug-ins.

    Packs go in the order of their plug-ins' ids and are named as producers of what they add.
    """
    for pack in packs:
        if not pack.plugin or pack.schema_version != PACK_VERSION or not pack.policies:
            raise PlanError(f"pack of {pack.plugin!r}: it needs a plug-in, version {PACK_VERSION} and policies")
    ordered = sorted(packs, key=lambda p: p.plugin)
    stamped = [[x | {"producer": f"plugin:{p.plugin}@{p.version}"} | ({"languages": p.languages} if p.languages and not x.get("languages") else {}) for x in p.policies] for p in ordered]
    fits = [F.lit(True) if not p.languages else F.coalesce(F.col("language").isin(p.languages), F.lit(False)) for p in ordered]
    names = lambda wanted: F.array_compact(F.array(*[F.when(f == wanted, F.lit(p.plugin)) for f, p in zip(fits, ordered, strict=True)])) if ordered else F.array().cast("array<string>")
    return apply_policies(plans, merge_policies(builtin or [], *stamped, project or [])).withColumns({"applied": names(True), "skipped": names(False)})


# -- recipes, tests, packets, repairs ---------------------------------------------------------------------------------------


def lowered(plans: DataFrame) -> DataFrame:
    """A recipe per plan: error (null if it can be lowered), recipe_id, imports, steps, effects, failures and constraints.

    Only resolved plans without blocking questions are lowered, and only for TypeScript, the language with a profile.
    """
    plan = F.col
    error = F.when(plan("lifecycle") != "resolved", "plan must be resolved").when(blocked(plan("questions")), "blocking questions").when(plan("language") != "typescript", "unsupported target language")
    bound = F.filter("bindings", lambda b: (b["state"] == "resolved") & (F.coalesce(b["canonical_id"], F.lit("")) != ""))
    imports = F.transform(bound, lambda b: _struct(symbol=b["canonical_id"], form="named", record=b["id"]))
    operation = lambda c: F.coalesce(F.nullif(F.trim(c["then"]), F.lit("")), F.nullif(c["then_op"], F.lit("")))
    did = F.transform(F.filter("intent.behavior", lambda c: operation(c).isNotNull()), lambda c: _struct(operation=operation(c), call=F.lit(None).cast("string"), record="intent"))
    calls = F.transform(bound, lambda b: _struct(operation="boundary call", call=b["canonical_id"], record=b["id"]))
    steps = F.transform(F.concat(did, calls), lambda s, k: F.struct((k + 1).alias("place"), s["operation"].alias("operation"), s["call"].alias("call"), s["record"].alias("record")))

    def claim(kind: Column, statement: Column) -> Column:
        return F.coalesce(F.try_element_at(F.filter("claims", lambda c: (c["kind"] == kind) & (c["statement"] == statement)), F.lit(1))["id"], F.lit("intent"))

    def effect(e: Column) -> Column:
        kind = F.coalesce(F.nullif(e["kind"], F.lit("")), effect_kind(e["name"]))
        return _struct(name=e["name"], kind=kind, record=claim(F.concat(F.lit("effect."), kind), e["name"]))

    effects = F.transform(F.coalesce("intent.side_effects", F.array().cast("array<struct<name:string,kind:string>>")), effect)
    audits = F.transform(F.filter("obligations", lambda o: o["kind"] == "audit"), lambda o: _struct(name=o["requirement"], kind="audit", record=o["id"]))
    failures = F.transform(F.coalesce("intent.failure_modes", F.array().cast("array<struct<code:string,kind:string,source:string>>")), lambda f: _struct(code=f["code"], strategy=f["kind"], record=claim(F.concat(F.lit("failure."), f["kind"]), f["code"])))
    wraps = F.filter("obligations", lambda o: F.lower(o["kind"]).contains("failure") | F.lower(o["requirement"]).contains("wrap"))
    wraps = F.transform(wraps, lambda o: _struct(code=o["requirement"], strategy="policy", record=o["id"]))
    forbids = lambda o: F.startswith(F.lower(o["kind"]), F.lit("forbid")) | F.startswith(F.lower(o["requirement"]), F.lit("forbid "))
    constraints = F.transform("obligations", lambda o: _struct(kind=o["kind"], requirement=o["requirement"], polarity=F.when(forbids(o), "forbidden").otherwise("required"), record=o["id"]))
    constraints = F.concat(constraints, F.transform(F.coalesce("intent.constraints", F.array().cast("array<string>")), lambda c: _struct(kind="intent", requirement=c, polarity="required", record="intent")))
    body = {"imports": F.array_sort(imports), "steps": steps, "effects": F.array_sort(F.concat(effects, audits)), "failures": F.array_sort(F.concat(failures, wraps)), "constraints": F.array_sort(constraints)}
    made = plans.withColumns({"error": error} | body)
    return made.withColumn("recipe_id", F.when(F.col("error").isNull(), record_id("recipe", F.col("plan_id"), F.to_json(F.struct(*body)))))


def test_cases(recipes: DataFrame, repairs: DataFrame | None = None) -> DataFrame:
    """plan_id, case_id, category, expected, record: what to test of each recipe that could be lowered.

    The intent itself, every effect, every failure that no policy handles, and what repairs(plan_id, repair_id, kind, target,
    requirement) have patched.
    """
    fine = recipes.where("error is null")
    case = lambda i, category, expected, record: F.struct(i.alias("case_id"), F.lit(category).alias("category"), expected.alias("expected"), record.alias("record"))
    test = lambda r: F.concat(F.lit("test-"), r)
    nominal = F.array(case(F.lit("test-intent"), "nominal behavior", F.concat(F.lit("returns "), F.coalesce("intent.returns.type", F.lit(""))), F.lit("intent")))
    effects = F.transform("effects", lambda e: case(test(e["record"]), "effect/audit behavior", F.concat(F.lit("observes "), e["name"]), e["record"]))
    failures = F.transform(F.filter("failures", lambda f: f["strategy"] != "policy"), lambda f: case(test(f["record"]), "failure propagation", F.concat(F.lit("reports "), f["code"]), f["record"]))
    rows = fine.select("plan_id", F.posexplode(F.concat(nominal, effects, failures)).alias("place", "c")).select("plan_id", "place", "c.*")
    if repairs is not None:
        patched = repairs.where("kind = 'recipe_patch'").join(fine.select("plan_id"), "plan_id", "left_semi")
        rows = rows.unionByName(patched.select("plan_id", F.lit(1 << 20).alias("place"), F.concat_ws("-", F.lit("test-regression"), "repair_id", "target").alias("case_id"), F.lit("regression").alias("category"), F.concat(F.lit("prevents recurrence of "), "requirement").alias("expected"), F.col("target").alias("record")))
    # of equal ids the first counts
    return rows.groupBy("plan_id", "case_id").agg(F.min_by(F.struct("category", "expected", "record"), F.struct("place", "expected")).alias("c")).select("plan_id", "case_id", "c.*")


def test_coverage(recipes: DataFrame, cases: DataFrame) -> DataFrame:
    """plan_id, record, status (covered, not_generatable or unknown), cases of the intent, claims and obligations of each recipe.

    What is not covered by a case can't be tested from outside if it is an obligation, and is unknown if it is a claim.
    """
    fine = recipes.where("error is null")
    records = F.concat(F.array(_struct(record="intent", status="unknown")), F.transform("claims", lambda c: _struct(record=c["id"], status="unknown")), F.transform("obligations", lambda o: _struct(record=o["id"], status=F.when(o["kind"].isin("audit", "failure.wrap"), "unknown").otherwise("not_generatable"))))
    asked = fine.select("plan_id", F.inline(records))
    met = cases.groupBy("plan_id", "record").agg(F.array_sort(F.collect_set("case_id")).alias("cases"))
    both = asked.groupBy("plan_id", "record").agg(F.max("status").alias("status")).join(met, ["plan_id", "record"], "full")
    return both.select("plan_id", "record", F.when(F.col("cases").isNotNull(), "covered").otherwise(F.col("status")).alias("status"), F.coalesce("cases", F.array().cast("array<string>")).alias("cases"))


def packets(plans: DataFrame) -> DataFrame:
    """plan_id, status (ready or blocked) and requirements in order: what an implementer is handed."""
    status = F.when((F.col("lifecycle") == "blocked") | blocked(F.col("questions")), "blocked").otherwise("ready")
    return plans.select("plan_id", status.alias("status"), F.array_sort("obligations").alias("requirements"), "questions")


def repair_plans(plans: DataFrame, findings: DataFrame, reports: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """repair_id, plan_id, class, status, changes for the verified plans of reports(plan_id, verification_id, status).

    findings(plan_id, place, result, record, expected): a violated fact patches the recipe, one that can't be told becomes a
    question. A blocked plan waits for its user, an inconclusive report for evidence; a repair among earlier(repair_id) is exhausted.
    """
    expected = F.coalesce("expected", F.lit(""))
    operation = F.when(F.col("result") != "violated", "supply_evidence").when(expected.contains("effect "), "ensure_effect").when(expected.contains("failure "), "ensure_failure").otherwise("satisfy_requirement")
    change = F.struct("place", F.when(F.col("result") == "violated", "recipe_patch").otherwise("plan_question").alias("kind"), operation.alias("operation"), F.col("record").alias("target"), expected.alias("requirement"))
    open_ = findings.where("result in ('violated', 'unsupported', 'unknown', 'conditional')")
    found = open_.groupBy("plan_id").agg(F.array_sort(F.collect_list(change)).alias("changes"), F.bool_or(F.col("result") == "violated").alias("bad"))
    rows = reports.join(plans.select("plan_id", "lifecycle"), "plan_id").join(found, "plan_id", "left")
    none = F.array().cast(CHANGES)
    conflict = F.array(_struct(place=F.lit(-1), kind="plan_question", operation="resolve_conflict", target=F.col("plan_id"), requirement=PROMPTS["resolve conflict"]))
    kind = F.when(F.col("lifecycle") == "blocked", "user_decision_required").when(F.col("status") == "inconclusive", "insufficient_evidence").when(F.coalesce("bad", F.lit(False)), "implementation_divergence").otherwise("insufficient_evidence")
    changes = F.when(F.col("lifecycle") == "blocked", conflict.cast(CHANGES)).when(F.col("status") == "inconclusive", none).otherwise(F.coalesce(F.col("changes").cast(CHANGES), none))
    made = rows.select("plan_id", kind.alias("class"), changes.alias("changes"), "verification_id")
    made = made.withColumn("repair_id", record_id("repair", F.col("plan_id"), F.col("class"), F.to_json("changes")))
    if earlier is None:
        return made.withColumn("status", F.lit("proposed"))
    tried = earlier.select("repair_id").distinct().withColumn("_tried", F.lit(True))
    return made.join(tried, "repair_id", "left").withColumn("status", F.when(F.col("_tried"), "exhausted").otherwise("proposed")).drop("_tried")


def mutation_status(recipes: DataFrame, observed: DataFrame) -> DataFrame:
    """plan_id, status, missing: accepted, rejected or conditional, for observed(plan_id, coverage, verdict, effects, failures).

    A plan that could not be lowered, or an observation that is not whole, leaves it conditional. findings of an error, effects and
    failures that the recipe asks for and nobody saw, or a failed verification reject it.
    """
    want = lambda c, n: F.transform(c, lambda x: x[n])
    rows = recipes.join(observed, "plan_id", "left")
    empty = F.array().cast("array<string>")
    asked = F.filter("failures_wanted", lambda f: f["strategy"] != "policy")
    missing = F.concat(F.array_except(want(F.col("effects_wanted"), "name"), F.coalesce("effects", empty)), F.array_except(want(asked, "code"), F.coalesce("failures", empty)))
    rows = rows.select("plan_id", "error", recipes["effects"].alias("effects_wanted"), recipes["failures"].alias("failures_wanted"), recipes["findings"] if "findings" in recipes.columns else F.array().cast("array<struct<severity:string>>").alias("findings"), "coverage", "verdict", observed["effects"].alias("effects"), observed["failures"].alias("failures"))
    wrong = F.exists("findings", lambda f: f["severity"] == "error") | (F.size(missing) > 0) | ~F.col("verdict").eqNullSafe(F.lit("passed"))
    status = F.when(F.col("error").isNotNull() | ~can_satisfy(F.col("coverage")), "conditional").when(wrong, "rejected").otherwise("accepted")
    return rows.select("plan_id", status.alias("status"), F.when(F.col("error").isNull() & can_satisfy(F.col("coverage")), missing).otherwise(empty).alias("missing"))


def repair_loop(sources: DataFrame, verify: Callable[[DataFrame], DataFrame], propose: Callable[[DataFrame], DataFrame], approve: Callable[[DataFrame], DataFrame] | None = None, most: int = 3) -> DataFrame:
    """unit, source, status, attempts, converged after at most `most` repairs of sources(unit, source).

    verify gives unit, status; propose gives unit, proposed for those that failed; approve gives the units that may be changed (all
    without it). What passed, can't be told or was not approved is left as it is; rounds go over all units at once. Units are joined
    by sorting: tables of a few columns take little room as files, by which Spark would have them pass through the driver.
    """
    from .traverse import settle

    left = settle(sources.select("unit", "source").withColumn("attempts", F.lit(0)), "repair")
    done = None
    for attempt in range(most + 1):
        judged = settle(left.join(verify(left.select("unit", "source")).select("unit", "status").hint("merge"), "unit"), "judged")
        failed = judged.where("status = 'failed'")
        ended = judged.where("status <> 'failed'") if attempt < most else judged
        done = ended if done is None else done.unionByName(ended)
        if attempt == most or failed.isEmpty():
            break
        proposed = settle(failed.join(propose(failed.select("unit", "source")).select("unit", "proposed").hint("merge"), "unit"), "proposed")
        fine = proposed if approve is None else proposed.join(approve(proposed).select("unit").distinct().hint("merge"), "unit", "left_semi")
        done = done.unionByName(failed.join(fine.select("unit").hint("merge"), "unit", "left_anti"))
        left = settle(fine.select("unit", F.col("proposed").alias("source"), (F.col("attempts") + 1).alias("attempts")), "repair")
    return done.withColumn("converged", F.col("status") == "passed")
