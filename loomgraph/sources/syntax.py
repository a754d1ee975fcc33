"""Syntax trees of Python files as rows, and walks over them as filters.

Nodes are numbered in the order of the text, and a node knows the last number below it, so a subtree is a range of numbers. A node
has its type, the field of its parent that it fills, its place among the parent's nodes, and its lines and columns.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import bucketed

NODE = "rel_path string, id int, parent int, last int, place int, field string, type string, name string, line int, col int, end_line int, end_col int"
#: Rows, of whole files, that are handed on together, or a few more.
AT_ONCE = 20_000
#: Nodes that begin a scope of their own.
SCOPES = ["FunctionDef", "AsyncFunctionDef", "Lambda"]


def _rows(path: str, text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    rows: list[list] = []
    waiting = [(tree, -1, 0, "")]
    while waiting:
        node, parent, place, field = waiting.pop()
        k = len(rows)
        name = next((str(v) for f in ("name", "id", "attr", "arg") if isinstance(v := getattr(node, f, None), str)), None)
        rows.append([path, k, parent, k, place, field, type(node).__name__, name, *(getattr(node, a, None) for a in ("lineno", "col_offset", "end_lineno", "end_col_offset"))])
        below = []
        for f, value in ast.iter_fields(node):
            below += [(x, f) for x in (value if isinstance(value, list) else [value]) if isinstance(x, ast.AST)]
        waiting += [(x, k, i, f) for i, (x, f) in reversed(list(enumerate(below)))]
    for row in reversed(rows[1:]):
        rows[row[2]][3] = max(rows[row[2]][3], row[3])
    return rows


def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of many files at once: a frame for each would take longer than its parsing."""
    names = [x.split(" ")[0] for x in NODE.split(", ")]

    def made(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("line", "col", "end_line", "end_col")})

    rows: list[tuple] = []
    for pdf in batches:
        for p, t in zip(pdf["rel_path"], pdf["content"], strict=True):
            rows += _rows(p, t or "")
            if len(rows) >= AT_ONCE:
                yield made(rows)
                rows = []
    if rows:
        yield made(rows)


def syntax(files: DataFrame) -> DataFrame:
    """A row per node of the Python files of files(rel_path, language, content); none for a file that does not parse."""
    return files.where("language = 'python'").select("rel_path", "content").mapInPandas(frames, NODE)


def laid_out(files: DataFrame) -> DataFrame:
    """The nodes of files as syntax() gives them, written in buckets of rel_path: files are dealt before they are parsed, so walks move nothing."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(syntax(files.repartition(n, "rel_path")), ["rel_path"], "syntax", dealt=True)


def below(nodes: DataFrame, roots: DataFrame, own_scope: bool = False) -> DataFrame:
    """root, and each node of the subtrees of roots(rel_path, id, last), itself included, in order; with own_scope none inside inner scopes.

    A node that begins an inner scope is still there itself. Roots and scopes are as many as files, so they are joined by sorting, not
    broadcast, however small they look where they are written.
    """
    r = roots.select("rel_path", F.col("id").alias("root"), F.col("last").alias("_end"))
    found = nodes.join(r.hint("merge"), "rel_path").where(F.col("id").between(F.col("root"), F.col("_end"))).drop("_end")
    if own_scope:
        scope = F.struct(F.col("id").alias("first"), F.col("last").alias("last"))
        inner = nodes.where(F.col("type").isin(SCOPES)).groupBy("rel_path").agg(F.collect_list(scope).alias("_inner"))
        hidden = F.exists("_inner", lambda s: (s["first"] > F.col("root")) & (F.col("id") > s["first"]) & (F.col("id") <= s["last"]))
        found = found.join(inner.hint("merge"), "rel_path", "left").where(~F.coalesce(hidden, F.lit(False))).drop("_inner")
    return found


def children(nodes: DataFrame, parents: DataFrame, field: str | None = None, kind: str | None = None) -> DataFrame:
    """The nodes right below parents(rel_path, id), of a field or of a type if one is given."""
    p = parents.select("rel_path", F.col("id").alias("parent"))
    found = nodes.join(p, ["rel_path", "parent"], "left_semi")
    found = found.where(F.col("field") == field) if field else found
    return found.where(F.col("type") == kind) if kind else found


def first_below(nodes: DataFrame, roots: DataFrame, kind: str) -> DataFrame:
    """rel_path, root, id of the first node of a type in each subtree."""
    return below(nodes, roots).where(F.col("type") == kind).groupBy("rel_path", "root").agg(F.min("id").alias("id"))
