"""Declared against observed intents: comparison, rules and verdicts, as columns over one row per function."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import canonical_type

FINDING = "struct<kind:string,severity:string,path:string,expected:string,actual:string>"
#: Severities from harmless to grave.
SEVERITY = ["info", "warning", "error"]


def finding(kind: str, severity: str | Column, path: Column | str, expected: Column | None = None, actual: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    s = F.lit(severity) if isinstance(severity, str) else severity
    p = F.lit(path) if isinstance(path, str) else path
    return F.struct(F.lit(kind).alias("kind"), s.alias("severity"), p.alias("path"), (none if expected is None else expected.cast("string")).alias("expected"), (none if actual is None else actual.cast("string")).alias("actual"))


def _some(condition: Column, value: Column) -> Column:
    return F.when(condition, F.array(value)).otherwise(F.array().cast(f"array<{FINDING}>"))


def paired(intents: DataFrame) -> DataFrame:
    """One row per (project_id, node_id) with the structs `intended` and `observed` of the kinds intended and extracted."""
    body = F.struct(*[c for c in intents.columns if c not in {"project_id", "node_id", "kind"}])
    side = lambda kind, name: intents.where(F.col("kind") == kind).select("project_id", "node_id", body.alias(name))
    return side("intended", "intended").join(side("extracted", "observed"), ["project_id", "node_id"])


def compare_names(a: Column, b: Column) -> Column:
    name = _some(~a["name"].eqNullSafe(b["name"]), finding("name", "error", "name", a["name"], b["name"]))
    seen = _some(~a["visibility"].eqNullSafe(b["visibility"]), finding("visibility", "error", "visibility", a["visibility"], b["visibility"]))
    return F.concat(name, seen)


def compare_inputs(a: Column, b: Column, language: Column) -> Column:
    """Inputs by name: missing, extra, other type (unknown types are left out)."""
    names = lambda s: F.transform(s["inputs"], lambda x: x["name"])
    missing = F.transform(F.array_except(names(a), names(b)), lambda n: finding("missing_input", "error", n, n))
    extra = F.transform(F.array_except(names(b), names(a)), lambda n: finding("extra_input", "error", n, None, n))

    def differs(x: Column) -> Column:
        other = F.get(F.filter(b["inputs"], lambda y: y["name"] == x["name"]), F.lit(0))
        known = (x["type"] != "unknown") & (other["type"] != "unknown")
        bad = other.isNotNull() & known & (canonical_type(language, x["type"]) != canonical_type(language, other["type"]))
        return F.when(bad, finding("input_type", "error", x["name"], x["type"], other["type"]))

    return F.concat(missing, extra, F.array_compact(F.transform(a["inputs"], differs)))


def compare_return(a: Column, b: Column, language: Column) -> Column:
    bad = ~canonical_type(language, a["type"]).eqNullSafe(canonical_type(language, b["type"]))
    return _some(F.coalesce(a["explicit"], F.lit(False)) & bad, finding("return", "error", "returns", a["type"], b["type"]))


def compare_effects(a: Column, b: Column) -> Column:
    """Effects that only one side has; null on the declaring side declares none, so what is observed is undeclared."""
    none = F.array().cast("array<struct<name:string,basis:string>>")
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    declared = F.transform(a, lambda e: e["name"])
    undeclared = F.transform(F.filter(b, lambda e: ~F.array_contains(declared, e["name"])), lambda e: finding("undeclared_effect", F.when(e["basis"] == "resolved", "error").otherwise("warning"), e["name"], None, e["name"]))
    undetected = F.transform(F.array_except(declared, F.transform(b, lambda e: e["name"])), lambda n: finding("undetected_effect", "error", n, n))
    return F.concat(undeclared, undetected)


def compare_failures(a: Column, b: Column) -> Column:
    """Failure codes; nothing declared is not compared, and only undetected ones can't be told."""
    undetected, undeclared = F.array_except(a, b), F.array_except(b, a)
    bad = F.transform(undeclared, lambda n: finding("undeclared_failure", "error", n, None, n))
    missing = F.transform(undetected, lambda n: finding("undetected_failure", "error", n, n))
    unsure = F.transform(undetected, lambda n: finding("unsupported_comparison", "info", n, n))
    return F.when(F.size(a) == 0, F.array().cast(f"array<{FINDING}>")).when(F.size(undeclared) > 0, F.concat(bad, missing)).otherwise(unsure)


def compare_behaviour(a: Column, b: Column) -> Column:
    """Branches. None declared claims nothing, none seen can't be compared; fewer seen is a warning, more an info. As many are
    compared in order: a condition or a consequence that differs is a warning, a condition that has no expression can't be compared."""

    def differs(i: Column, o: Column, at: Column) -> Column:
        path = F.concat(F.lit("behavior/"), at.cast("string"))
        unsure = i["when_expr"].isNull() | o["when_expr"].isNull()
        told = i["then_op"].isNotNull() & o["then_op"].isNotNull()
        other = ~i["then_op"].eqNullSafe(o["then_op"]) | ~i["then_value"].eqNullSafe(o["then_value"])
        when = F.when(unsure, finding("unsupported_comparison", "info", path)).when(i["when_expr"] != o["when_expr"], finding("behavior", "warning", path, i["when_expr"], o["when_expr"]))
        shown = lambda x: F.concat_ws(" ", x["then_op"], x["then_value"])
        return F.array_compact(F.array(when, F.when(~unsure & told & other, finding("behavior_then", "warning", path, shown(i), shown(o)))))

    n, m = F.size(a), F.size(b)
    pairs = F.flatten(F.transform(F.arrays_zip(a.alias("i"), b.alias("o")), lambda p, k: differs(p["i"], p["o"], k)))
    counts = lambda severity: F.array(finding("behavior_count", severity, "behavior", n, m))
    return F.when(n == 0, F.array().cast(f"array<{FINDING}>")).when(m == 0, F.array(finding("unsupported_comparison", "info", "behavior", n, m))).when(m < n, counts("warning")).when(m > n, counts("info")).otherwise(pairs)


MATCH = "struct<kind:string,path:string>"


def _agrees(condition: Column, path: Column | str, exact: Column | None = None) -> Column:
    kind = F.lit("exact_match") if exact is None else F.when(exact, "exact_match").otherwise("acceptable_equivalent")
    made = F.struct(kind.alias("kind"), (F.lit(path) if isinstance(path, str) else path).alias("path"))
    return F.when(condition, F.array(made)).otherwise(F.array().cast(f"array<{MATCH}>"))


def matched_names(a: Column, b: Column) -> Column:
    return F.concat(_agrees(a["name"].eqNullSafe(b["name"]), "name"), _agrees(a["visibility"].eqNullSafe(b["visibility"]), "visibility"))


def matched_inputs(a: Column, b: Column, language: Column) -> Column:
    """Inputs that agree: exactly, or by types that are written otherwise; where a type is unknown the name alone agrees."""

    def one(x: Column) -> Column:
        other = F.get(F.filter(b["inputs"], lambda y: y["name"] == x["name"]), F.lit(0))
        unknown = (x["type"] == "unknown") | (other["type"] == "unknown")
        same = unknown | (canonical_type(language, x["type"]) == canonical_type(language, other["type"]))
        return _agrees(other.isNotNull() & same, x["name"], unknown | (x["type"] == other["type"]))

    return F.flatten(F.transform(a["inputs"], one))


def matched_return(a: Column, b: Column, language: Column) -> Column:
    both = F.coalesce(a["explicit"], F.lit(False)) & F.coalesce(b["explicit"], F.lit(True))
    return _agrees(both & (canonical_type(language, a["type"]) == canonical_type(language, b["type"])), "returns", a["type"] == b["type"])


def matched_effects(a: Column, b: Column) -> Column:
    return _agrees(F.size(compare_effects(a, b)) == 0, "effects")


def matched_failures(a: Column, b: Column) -> Column:
    return _agrees((F.size(a) > 0) & (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0), "failures")


def matched_behaviour(a: Column, b: Column) -> Column:
    return _agrees((F.size(a) > 0) & (F.size(compare_behaviour(a, b)) == 0), "behavior")


def report(matches: list[Column], findings: list[Column]) -> Column:
    """What agrees, what does not, and the verdict: a passing report says what it rests on."""
    found = F.concat(*findings)
    return F.struct(F.concat(*matches).alias("matches"), found.alias("findings"), verdict(found).alias("verdict"))


def verdict(findings: Column) -> Column:
    """failed on an error, inconclusive where something can't be compared, else passed."""
    return F.when(F.exists(findings, lambda f: f["severity"] == "error"), "failed").when(F.exists(findings, lambda f: f["kind"] == "unsupported_comparison"), "inconclusive").otherwise("passed")


def repair_targets(findings: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(findings, lambda f: f["severity"] != "info"), lambda f: F.concat_ws(":", f["kind"], f["path"])))


def has_shape(nodes: Column, ops: list[str], literal: str | None = None) -> Column:
    """Whether a flattened expression has a node of one of ops, with that literal among its operands if one is given."""

    def fits(n: Column) -> Column:
        right = n["op"].isin(ops) if ops else F.lit(True)
        if literal is None:
            return right
        return right & F.exists(nodes, lambda m: (m["parent"] == n["id"]) & m["op"].isin("lit", "literal") & (m["text"] == literal))

    return F.exists(nodes, fits)


#: The rules that always hold, below those of a project.
RULES = [
    {"id": "function-explicit-return-type", "target": "FunctionIntent", "severity": "error", "when": {"visibility": "public"}, "require": {"explicitReturnType": True}},
    {"id": "declare-side-effects", "target": "FunctionIntent", "severity": "error", "when": {}, "require": {"sideEffectsDeclared": True}},
    {"id": "expected-failures-use-result", "target": "FunctionIntent", "severity": "warning", "when": {"hasFailureModes": True}, "require": {"failureStrategy": "ResultType"}},
]
#: Files that hold a project's rules, the first found counts; fields of rules; marks of result types.
PACK_NAMES = ["iir.rules.yaml", "iir.rules.yml", "iir.rules.json"]
RULE_FIELDS = {"": ["id", "target", "severity", "when", "require"], "when": ["visibility", "hasFailureModes"], "require": ["explicitReturnType", "sideEffectsDeclared", "failureStrategy", "forbidConditionShape"], "shape": ["ops", "operandLiteral"]}
RESULTS = "result|either|option"


class BadPack(ValueError):
    """A rule pack or an intent that cannot be used."""


def _read(text: str) -> Any:
    """YAML, of which JSON is a part; JSON alone where there is no YAML reader."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise BadPack(f"not readable: {e}") from e


def _only(given: dict, allowed: list[str], where: str) -> dict:
    more = sorted(set(given) - set(allowed))
    if more:
        raise BadPack(f"{where}: unknown field {more[0]!r}")
    return given


def load_rules(text: str) -> list[dict]:
    """The rules of a pack; refused if a field is unknown, missing or out of range, or an id comes twice."""
    data = _read(text)
    rules = _only(data if isinstance(data, dict) else {}, ["rules"], "pack").get("rules") or []
    if not rules:
        raise BadPack("rule pack has no rules")
    seen = set()
    for k, r in enumerate(rules):
        _only(r, RULE_FIELDS[""], f"rules[{k}]")
        i = str(r.get("id") or "").strip()
        when, require = _only(r.get("when") or {}, RULE_FIELDS["when"], i), _only(r.get("require") or {}, RULE_FIELDS["require"], i)
        shape = require.get("forbidConditionShape")
        problem = (
            f"rules[{k}]: missing id" if not i else f"duplicate id {i!r}" if i in seen else f"{i}: unsupported target" if r.get("target") != "FunctionIntent"
            else f"{i}: unknown severity" if r.get("severity") not in SEVERITY else f"{i}: unsupported failureStrategy" if require.get("failureStrategy", "ResultType") != "ResultType"
            else f"{i}: a shape needs ops or operandLiteral" if shape is not None and not (_only(shape, RULE_FIELDS["shape"], i).get("ops") or shape.get("operandLiteral") is not None) else None
        )
        if problem:
            raise BadPack(problem)
        seen.add(i)
        r["when"], r["require"] = when, require
    return rules


def discover_rules(start: str) -> tuple[str, list[dict]] | None:
    """Path and rules of the nearest pack in a folder or one above it; None without one. A broken pack is an error."""
    folder = Path(start).resolve()
    for at in (folder, *folder.parents):
        for name in PACK_NAMES:
            if (at / name).is_file():
                return str(at / name), load_rules((at / name).read_text(encoding="utf-8"))
    return None


def effective_rules(packs: list[str], base: list[dict] | None = None) -> tuple[list[dict], list[str]]:
    """base (the rules that always hold) under packs, one after the other; a pack that can't be read is left out and told."""
    rules, errors = list(base or RULES), []
    for text in packs:
        try:
            rules = merge_rules(rules, load_rules(text))
        except (BadPack, ValueError) as e:
            errors.append(str(e))
    return rules, errors


#: Fields of a function's intent, and what normal() makes of them.
SOURCE_INTENT = "kind string, name string, language string, origin string, visibility string, inputs array<struct<name:string,type:string>>, returns struct<type:string>, behavior array<struct<when:string,then:string>>, sideEffects array<string>, failureModes array<string>, constraints array<string>"


def load_intent(text: str) -> dict:
    """One declared intent with its defaults; refused if a field is unknown or it is not whole."""
    names = [x.split(" ")[0] for x in SOURCE_INTENT.split(", ")]
    given = _only(_read(text) or {}, names, "intent")
    made = {n: given.get(n) for n in names}
    made |= {"visibility": made["visibility"] or "public", "origin": made["origin"] or "declared", "inputs": [{"name": x.get("name"), "type": x.get("type") or "unknown"} for x in made["inputs"] or []], "behavior": made["behavior"] or []}
    kind = (made["returns"] or {}).get("type") or ""
    made["returns"] = {"type": kind, "explicit": kind != ""}
    blank = lambda v: not str(v or "").strip()
    problem = (
        "unsupported kind" if made["kind"] != "FunctionIntent" else "missing name" if blank(made["name"]) else "missing language" if blank(made["language"])
        else "unknown visibility" if made["visibility"] not in ("public", "private") else "unknown origin" if made["origin"] not in ("observed", "declared", "inferred")
        else "an input without name" if any(blank(x["name"]) for x in made["inputs"]) else "behavior needs when and then" if any(blank(b.get("when")) or blank(b.get("then")) for b in made["behavior"]) else None
    )
    if problem:
        raise BadPack(problem)
    return made


def normal_intents(df: DataFrame, column: str = "json") -> DataFrame:
    """df with intent, the JSON column read with its defaults, and error (null if it is whole); fields that are not known don't count."""
    text = lambda c: F.coalesce(c, F.lit(""))
    i = df.withColumn("intent", F.from_json(column, SOURCE_INTENT))
    kind = text(F.col("intent.returns.type"))
    inputs = F.transform(F.coalesce("intent.inputs", F.array().cast("array<struct<name:string,type:string>>")), lambda x: F.struct(x["name"].alias("name"), F.coalesce(F.nullif(x["type"], F.lit("")), F.lit("unknown")).alias("type")))
    behavior = F.coalesce("intent.behavior", F.array().cast("array<struct<when:string,then:string>>"))
    made = F.struct(
        F.col("intent.kind").alias("kind"), F.col("intent.name").alias("name"), F.col("intent.language").alias("language"),
        F.coalesce(F.nullif("intent.origin", F.lit("")), F.lit("declared")).alias("origin"), F.coalesce(F.nullif("intent.visibility", F.lit("")), F.lit("public")).alias("visibility"),
        inputs.alias("inputs"), F.struct(kind.alias("type"), (kind != "").alias("explicit")).alias("returns"), behavior.alias("behavior"), F.col("intent.sideEffects").alias("sideEffects"), F.col("intent.failureModes").alias("failureModes"),
    )
    i = i.withColumn("intent", F.when(F.col("intent").isNotNull(), made))
    blank = lambda c: F.trim(text(c)) == ""
    error = (
        F.when(F.col("intent").isNull(), "not readable").when(~F.col("intent.kind").eqNullSafe(F.lit("FunctionIntent")), "unsupported kind").when(blank(F.col("intent.name")), "missing name").when(blank(F.col("intent.language")), "missing language")
        .when(~F.col("intent.visibility").isin("public", "private"), "unknown visibility").when(~F.col("intent.origin").isin("observed", "declared", "inferred"), "unknown origin")
        .when(F.exists("intent.inputs", lambda x: blank(x["name"])), "an input without name").when(F.exists("intent.behavior", lambda b: blank(b["when"]) | blank(b["then"])), "behavior needs when and then")
    )
    return i.withColumn("error", error)


def evaluate_rules(rows: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """node_id, rule, status (skipped, passed, warned or failed) for rows(node_id, visibility, failures, returns, effects[, shapes]).

    shapes are the flattened conditions of a function (nodes of has_shape), wanted by rules that forbid some. What a rule requires
    holds in both directions: true asks for a property, false for its absence. The rules are unrolled into the plan, so rows are
    read once.
    """

    def status(r: dict) -> Column:
        when, require = r.get("when") or {}, r.get("require") or {}
        fails = F.coalesce(F.size("failures") > 0, F.lit(False))
        applies, kept = F.lit(True), F.lit(True)
        if when.get("visibility"):
            applies = applies & F.col("visibility").eqNullSafe(F.lit(when["visibility"]))
        if when.get("hasFailureModes") is not None:
            applies = applies & (fails == when["hasFailureModes"])
        if require.get("explicitReturnType") is not None:
            kept = kept & (F.coalesce("returns.explicit", F.lit(False)) == require["explicitReturnType"])
        if require.get("sideEffectsDeclared") is not None:
            kept = kept & (F.col("effects").isNotNull() == require["sideEffectsDeclared"])
        if require.get("failureStrategy"):
            kept = kept & (~fails | F.coalesce(F.lower("returns.type").rlike(RESULTS), F.lit(False)))
        shape = require.get("forbidConditionShape")
        if shape and (shape.get("ops") or shape.get("operandLiteral") is not None):
            kept = kept & ~F.exists("shapes", lambda nodes: F.coalesce(has_shape(nodes, shape.get("ops") or [], shape.get("operandLiteral")), F.lit(False)))
        outcome = F.when(~applies, "skipped").when(kept, "passed").when(F.lit(r["severity"] == "error"), "failed").otherwise("warned")
        return F.struct(F.lit(r["id"]).alias("rule"), outcome.alias("status"))

    return rows.select("node_id", F.inline(F.array(*map(status, RULES if rules is None else rules))))


def merge_rules(base: list[dict], pack: list[dict]) -> list[dict]:
    """pack's rules over base's of the same id, in base's order, new ones last."""
    over = {r["id"]: r for r in pack}
    return [over.pop(r["id"], r) for r in base] + list(over.values())
