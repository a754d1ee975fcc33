"""Symbols and intents from source text.

Python is parsed with the standard library's ast, in Arrow batches, one file at a time; a file that does not parse gives its
file node only. Go and TypeScript are read by their tokens: declarations scope by scope (declare), intents by brackets (braces).
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import braces, declare

SYMBOL = "rel_path string, type string, canonical_id string, label string, kind string, exported boolean, line_start int, line_end int, detail string"
CONDITION = "when string, then string, when_expr string, then_op string, then_value string"
INTENT = f"rel_path string, name string, owner string, language string, visibility string, inputs array<struct<name:string,type:string>>, returns struct<type:string,explicit:boolean>, behavior array<struct<{CONDITION.replace(' string', ':string')}>>, effects array<struct<name:string,kind:string,basis:string>>, failures array<struct<code:string,kind:string>>"

#: Comparison operators as the model writes them.
COMPARE = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Is: "==", ast.IsNot: "!="}


def module_of(path: str) -> str:
    name = path.removesuffix(".pyi").removesuffix(".py").replace("/", ".")
    return name.removesuffix(".__init__")


def exported(name: str) -> bool:
    return not name.startswith("_") or name.startswith("__") and name.endswith("__")


def _functions(tree: ast.Module) -> Iterator[tuple[ast.AST, str | None]]:
    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            yield node, None
        elif isinstance(node, ast.ClassDef):
            for inner in node.body:
                if isinstance(inner, ast.FunctionDef | ast.AsyncFunctionDef):
                    yield inner, node.name


def symbols(path: str, text: str) -> list[dict]:
    """File, module, imports, classes, functions and methods, upper-case constants."""
    module = module_of(path)
    rows: list[dict] = []

    def add(kind: str, canonical: str, label: str, what: str | None, node: ast.AST | None = None, detail: str | None = None) -> None:
        rows.append({"rel_path": path, "type": kind, "canonical_id": canonical, "label": label, "kind": what, "exported": exported(label.rsplit(".", 1)[-1]) if kind == "symbol" else None, "line_start": getattr(node, "lineno", None), "line_end": getattr(node, "end_lineno", None), "detail": detail})

    add("file", path, path.rsplit("/", 1)[-1], None)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return rows
    add("namespace", module, module, "module")
    package = module if path.endswith("__init__.py") else module.rpartition(".")[0]
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                add("namespace", a.name, a.name, "import", node)
        elif isinstance(node, ast.ImportFrom):
            base = package.split(".") if package else []
            up = base[: len(base) - node.level + 1] if node.level else []
            # one that climbs beyond the top keeps its own text, within its module
            name = ".".join([*up, node.module] if node.module else up) or f"{module}:{'.' * node.level}"
            add("namespace", name, name, "relative" if node.level else "import", node, "." * node.level + (node.module or ""))
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            bases = [ast.unparse(b) for b in node.bases]
            add("symbol", f"{module}:{node.name}", node.name, "class", node, json.dumps({"bases": bases, "decorators": [ast.unparse(d) for d in node.decorator_list]}))
        elif isinstance(node, ast.Assign):
            for t in node.targets:
                if isinstance(t, ast.Name) and t.id.isupper():
                    add("symbol", f"{module}:{t.id}", t.id, "constant", node)
    for f, owner in _functions(tree):
        label = f"{owner}.{f.name}" if owner else f.name
        add("symbol", f"{module}:{label}", label, "method" if owner else "function", f)
    return rows


def expression(node: ast.AST) -> dict | None:
    """A condition as a tree of operators, member paths and literals; None if it has anything else."""
    if isinstance(node, ast.BoolOp):
        op, args = "&&" if isinstance(node.op, ast.And) else "||", [expression(v) for v in node.values]
    elif isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        op, args = "!", [expression(node.operand)]
    elif isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in COMPARE:
        op, args = COMPARE[type(node.ops[0])], [expression(node.left), expression(node.comparators[0])]
    elif isinstance(node, ast.Name | ast.Attribute):
        text = ast.unparse(node)
        return {"op": "path", "text": text} if text.replace(".", "").replace("_", "").isalnum() else None
    elif isinstance(node, ast.Constant) or isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant):
        value = ast.literal_eval(node)
        return {"op": "lit", "text": {True: "true", False: "false", None: "none"}.get(value, json.dumps(value)) if value is None or isinstance(value, bool) else json.dumps(value) if isinstance(value, str) else repr(value)}
    else:
        return None
    return None if None in args else {"op": op, "args": args}


def _failure(node: ast.Raise) -> tuple[str, str] | None:
    """Code and kind: a message makes it constructed, a class a sentinel, a bare raise or a bound name propagates."""
    e = node.exc
    for part in ast.walk(node):
        if isinstance(part, ast.Constant) and isinstance(part.value, str) and part.value:
            return part.value, "constructed"
    if e is None:
        return "propagated", "propagated"
    if isinstance(e, ast.Call):
        return ast.unparse(e.func), "sentinel"
    if isinstance(e, ast.Name | ast.Attribute):
        name = ast.unparse(e)
        return name, "sentinel" if name.rpartition(".")[2][:1].isupper() else "propagated"
    return None


def _text(node: ast.AST, source: str) -> str:
    return " ".join((ast.get_source_segment(source, node) or ast.unparse(node)).split())


def _consequence(body: list[ast.stmt], source: str) -> tuple[str, str | None, str | None]:
    """Text, operation and value of the statement that tells most: the first return or raise, else the first."""
    node = next((s for s in body if isinstance(s, ast.Return | ast.Raise)), body[0])
    if isinstance(node, ast.Raise):
        return _text(node, source), "throw", (_failure(node) or (None,))[0]
    if isinstance(node, ast.Return):
        return _text(node, source), "return", _text(node.value, source) if node.value else None
    if isinstance(node, ast.Expr) and isinstance(node.value, ast.Call):
        return _text(node, source), "invoke", _text(node.value.func, source)
    return _text(node, source), None, None


def _within(node: ast.AST, kinds: tuple) -> Iterator[ast.AST]:
    """Nodes of those kinds below node in the order of the text, not those of functions inside it."""
    for child in ast.iter_child_nodes(node):
        if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda):
            continue
        if isinstance(child, kinds):
            yield child
        yield from _within(child, kinds)


def _clauses(f: ast.AST, source: str) -> Iterator[dict]:
    """A clause for each branch of each if and match of a function, nested ones too."""

    def clause(when: str, expr: dict | None, then: list[ast.stmt]) -> dict:
        text, op, value = _consequence(then, source)
        return {"when": when, "then": text, "when_expr": json.dumps(expr, separators=(",", ":")) if expr else None, "then_op": op, "then_value": value}

    chained: set[int] = set()  # an elif belongs to the if before it
    for s in _within(f, (ast.If, ast.Match)):
        if isinstance(s, ast.If) and id(s) not in chained:
            while True:
                yield clause(_text(s.test, source), expression(s.test), s.body)
                if len(s.orelse) == 1 and isinstance(s.orelse[0], ast.If) and source.splitlines()[s.orelse[0].lineno - 1].lstrip().startswith("elif"):
                    s = s.orelse[0]
                    chained.add(id(s))
                    continue
                if s.orelse:
                    yield clause("else", None, s.orelse)
                break
        elif isinstance(s, ast.Match):
            subject = _text(s.subject, source)
            for c in s.cases:
                if isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None and c.pattern.name is None:
                    yield clause("else", None, c.body)
                else:
                    value = c.pattern.value if isinstance(c.pattern, ast.MatchValue) else None
                    sides = [expression(s.subject), expression(value) if value else None]
                    yield clause(f"{subject} == {_text(c.pattern, source)}", None if None in sides else {"op": "==", "args": sides}, c.body)


def imported(tree: ast.Module) -> dict[str, str]:
    """The module that each imported name comes from."""
    found = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found |= {a.asname or a.name.split(".")[0]: a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            found |= {a.asname or a.name: "." * node.level + (node.module or "") for a in node.names}
    return found


def _effects(f: ast.AST, imports: dict[str, str]) -> list[dict]:
    """Calls on imported modules and calls named by a verb of change, with kind and basis."""
    from .effects import PURE_CALLS, PURE_PACKAGES, call_effect, is_verb

    found = {}
    for n in ast.walk(f):
        if not isinstance(n, ast.Call):
            continue
        full, root, method = ast.unparse(n.func), "", ""
        if isinstance(n.func, ast.Name):
            method = n.func.id
        elif isinstance(n.func, ast.Attribute):
            method, at = n.func.attr, n.func.value
            while isinstance(at, ast.Attribute):
                at = at.value
            root = at.id if isinstance(at, ast.Name) else ""
        if root in PURE_PACKAGES or full in PURE_CALLS or full in found or not (root in imports or is_verb(method)):
            continue
        kind, basis = call_effect(method, root, imports.get(root))
        found[full] = {"name": full, "kind": kind, "basis": basis}
    return [found[k] for k in sorted(found)]


def intents(path: str, text: str) -> list[dict]:
    """What each function takes, returns, decides, raises and calls for its effect."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    rows, imports = [], imported(tree)
    for f, owner in _functions(tree):
        a = f.args
        args = [(x.arg, x.annotation) for x in [*a.posonlyargs, *a.args]] + ([("*" + a.vararg.arg, a.vararg.annotation)] if a.vararg else [])
        args += [(x.arg, x.annotation) for x in a.kwonlyargs] + ([("**" + a.kwarg.arg, a.kwarg.annotation)] if a.kwarg else [])
        if owner and args and args[0][0] in {"self", "cls"}:
            args = args[1:]
        failures = dict(x for n in ast.walk(f) if isinstance(n, ast.Raise) and (x := _failure(n)))
        rows.append({"rel_path": path, "name": f.name, "owner": owner, "language": "python", "visibility": "public" if exported(f.name) else "private", "inputs": [{"name": n, "type": ast.unparse(t) if t else "unknown"} for n, t in args], "returns": {"type": ast.unparse(f.returns) if f.returns else "", "explicit": f.returns is not None}, "behavior": list(_clauses(f, text)), "effects": _effects(f, imports), "failures": [{"code": c, "kind": failures[c]} for c in sorted(failures)]})
    return rows


def _each(files: DataFrame, parse, schema: str, languages: tuple[str, ...] = ("python",)) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.strip().split(" ")[0] for c in _top_level(schema)]
        for pdf in batches:
            rows = [r for p, t, x in zip(pdf["rel_path"], pdf["content"], pdf["language"], strict=True) for r in parse(p, t or "", x)]
            yield pd.DataFrame(rows, columns=columns)

    return files.where(F.col("language").isin(*languages)).select("rel_path", "content", "language").mapInPandas(work, schema)


def _top_level(schema: str) -> list[str]:
    """The fields of a schema text, not split inside brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[last:i])
            last = i + 1
    return [*out, schema[last:]]


def python_symbols(files: DataFrame) -> DataFrame:
    return _each(files, lambda path, text, _: symbols(path, text), SYMBOL)


def function_intents(files: DataFrame, languages: tuple[str, ...] = ("python", "go", "typescript")) -> DataFrame:
    """The intents of all functions of files(rel_path, language, content) in these languages."""
    return _each(files, lambda path, text, language: intents(path, text) if language == "python" else braces.intents(path, text, language), INTENT, languages)


def python_intents(files: DataFrame) -> DataFrame:
    return function_intents(files, ("python",))


DECLARED = "rel_path string, kind string, receiver string, label string, exported boolean, base string, line_start int, line_end int"


def declarations(files: DataFrame) -> DataFrame:
    """What files(rel_path, language, content) in Go and TypeScript declare; base is the class that one extends, if it is named."""
    return _each(files, declare.declarations, DECLARED, ("go", "typescript"))
