"""Effects of single calls, for extractors; the same tables as the column functions."""

from __future__ import annotations

from ..functions.ids import EFFECT_PATHS, EFFECT_ROOTS, VERBS

#: Modules and functions of Python whose calls have no effect.
PURE_PACKAGES = ["math", "re", "itertools", "functools", "operator", "collections"]
PURE_CALLS = ["json.dumps", "json.loads"]


def is_verb(method: str) -> bool:
    return any(v in method.lower() for v in VERBS)


def call_effect(method: str, root: str, path: str | None) -> tuple[str, str]:
    """Kind and basis of a call."""
    path, root = (path or "").lower(), root.lower()
    for kind, prefixes in EFFECT_PATHS.items():
        if any(path == p or path.startswith(p + "/") for p in prefixes):
            return kind, "resolved"
    for kind, roots in EFFECT_ROOTS.items():
        if root in roots:
            return kind, "resolved"
    return ("mutation" if is_verb(method) else "unclassified"), "heuristic"
