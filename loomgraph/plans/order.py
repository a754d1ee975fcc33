"""Orders of few items on the driver: plug-ins by what they provide and need, layers of them, decisions without cycles, providers."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from fnmatch import fnmatch
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class PlanError(ValueError):
    """A plan that cannot be put in order."""


@dataclass(frozen=True)
class Plugin:
    """What a plug-in handles, provides, requires and enriches, and the functions that it contributes.

    extract takes files(rel_path, language, content) and returns rows; analyzers take and return DataFrames; tools are queries
    by name. A plug-in that declares nothing runs in the order of registration.
    """

    id: str
    extensions: tuple[str, ...] = ()
    match: Callable[[str], bool] | None = None
    provides: tuple[str, ...] = ()
    requires: tuple[str, ...] = ()
    enriches: tuple[str, ...] = ()
    version: str = ""
    extract: Callable[[DataFrame], DataFrame] | None = None
    concepts: tuple[dict, ...] = ()
    analyzers: dict[str, Callable[..., DataFrame]] = field(default_factory=dict, hash=False)
    tools: dict[str, Callable[..., DataFrame]] = field(default_factory=dict, hash=False)

    @property
    def declared(self) -> bool:
        return bool(self.provides or self.requires or self.enriches)

    @property
    def needs(self) -> tuple[str, ...]:
        return (*self.requires, *(f"language:{x}" for x in self.enriches))


def matching(plugins: Iterable[Plugin], path: str) -> list[Plugin]:
    """The plug-ins that handle a file: by extension, else by a match of their own."""
    name = path.rpartition("/")[2].lower()
    ext = name[name.rindex(".") :] if "." in name else ""
    return [p for p in plugins if ext in [e.lower() for e in p.extensions] or (p.match is not None and p.match(path))]


def matched_files(files: DataFrame, plugins: Iterable[Plugin]) -> DataFrame:
    """rel_path, plugin for each plug-in that handles a file by its extension; a match of its own is asked where no extension fits."""
    given = list(plugins)
    ext = F.lower(F.regexp_extract("rel_path", r"(\.[^./]*)$", 1))
    named = [F.when(ext.isin([e.lower() for e in p.extensions]), F.lit(p.id)) for p in given if p.extensions]
    by_ext = files.select("rel_path", F.explode(F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")).alias("plugin"))
    own = [p for p in given if p.match is not None]
    if not own:
        return by_ext

    def asked(batches):
        for pdf in batches:
            rows = [(path, p.id) for path in pdf["rel_path"] for p in own if p.match(path)]
            yield type(pdf)(rows, columns=["rel_path", "plugin"])

    return by_ext.unionByName(files.select("rel_path").mapInPandas(asked, "rel_path string, plugin string")).distinct()


def _providers(plugins: list[Plugin]) -> dict[str, list[Plugin]]:
    found: dict[str, list[Plugin]] = {}
    for p in plugins:
        for c in p.provides:
            found.setdefault(c, []).append(p)
    return found


def in_order(plugins: Iterable[Plugin]) -> list[Plugin]:
    """Plug-ins after what they need, by id where that leaves a choice; as registered if none declares anything."""
    given = list(plugins)
    if not any(p.declared for p in given):
        return given
    providers, needs = _providers(given), {p.id: set() for p in given}
    for p in given:
        for c in p.needs:
            found = providers.get(c, [])
            if len(found) != 1:
                raise PlanError(f"{p.id} needs {c!r}, which {'no plug-in provides' if not found else 'several plug-ins provide: ' + ', '.join(x.id for x in found)}")
            if found[0] is p and c in p.requires:
                raise PlanError(f"{p.id} requires {c!r} of itself")
            needs[p.id].add(found[0].id)
    by_id, sorter, out, ready = {p.id: p for p in given}, TopologicalSorter(needs), [], []
    try:
        sorter.prepare()
    except CycleError as e:
        raise PlanError(f"plug-ins need each other: {e.args[1]}") from e
    while sorter.is_active():
        ready = sorted([*ready, *sorter.get_ready()])
        out.append(by_id[ready[0]])
        sorter.done(ready.pop(0))
    return out


def layers(plugins: Iterable[Plugin]) -> list[list[Plugin]]:
    """Plug-ins that may run side by side, layer by layer; one that declares nothing runs alone, between its neighbours."""
    given = list(plugins)
    last = {c: p for p in given for c in p.provides}
    needs = {p.id: {last[c].id for c in p.needs if c in last and last[c] is not p} if p.declared else set() for p in given}
    for before, p in zip(given, given[1:], strict=False):
        if not (before.declared and p.declared):
            needs[p.id].add(before.id)
    sorter = TopologicalSorter(needs)
    try:
        sorter.prepare()
    except CycleError as e:
        raise PlanError(f"plug-ins need each other: {e.args[1]}") from e
    out = []
    while sorter.is_active():
        ready = set(sorter.get_ready())
        out.append([p for p in given if p.id in ready])
        sorter.done(*ready)
    return out


def check_decisions(needs: dict[str, Iterable[str]]) -> None:
    """Refuse decisions that depend on unknown ones or, in the end, on themselves."""
    for d, wanted in needs.items():
        for x in wanted:
            if x not in needs:
                raise PlanError(f"decision {d!r} depends on unknown decision {x!r}")
    try:
        TopologicalSorter(needs).prepare()
    except CycleError as e:
        raise PlanError(f"decisions depend on themselves: {e.args[1]}") from e


def decision_problems(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """unit, id, problem for many plans at once: unknown dependencies, and decisions that no order can reach.

    edges(unit, id, needs), decisions(unit, id). Decisions whose needs are all met are taken away until nothing changes.
    """
    from ..operators.traverse import settle

    known = decisions.select("unit", "id").distinct()
    unknown = edges.join(known.select("unit", F.col("id").alias("needs")), ["unit", "needs"], "left_anti").select("unit", "id", F.lit("unknown dependency").alias("problem")).distinct()
    left, n = settle(edges.select("unit", "id", "needs").distinct(), "decisions"), -1
    while (now := left.count()) not in (0, n):
        n = now
        waiting = left.select("unit", F.col("id").alias("needs")).distinct()
        left = settle(left.join(waiting, ["unit", "needs"], "left_semi"), "decisions")
    # what is left waits on a cycle; those on it are waited for as well
    n = -1
    while (now := left.count()) not in (0, n):
        n = now
        wanted = left.select("unit", F.col("needs").alias("id")).distinct()
        left = settle(left.join(wanted, ["unit", "id"], "left_semi"), "decisions")
    return unknown.unionByName(left.select("unit", "id", F.lit("cycle").alias("problem")).distinct())


def provider_for(providers: DataFrame, wanted: DataFrame) -> DataFrame:
    """language, kind, provider: the one registered last of those that support it; providers(provider, ord, kind, languages)."""
    fits = wanted.join(providers, "kind").where((F.size("languages") == 0) | F.array_contains("languages", F.col("language")))
    return fits.groupBy("language", "kind").agg(F.max_by("provider", "ord").alias("provider"))


def glob_match(*patterns: str) -> Callable[[str], bool]:
    """A match for plug-ins by shell patterns over the whole path."""
    return lambda path: any(fnmatch(path, p) for p in patterns)
