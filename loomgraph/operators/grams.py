"""Nodes whose names hold a part, through posting lists of character grams that a written graph keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import KEPT, Graph, settle, short
from .traverse import Steps, laid_out

#: Characters of a gram; needles with fewer are grams themselves. Needles up to which one scan of the nodes is made instead.
SIZE, FEW = 3, 64
#: Needles up to which lists are not written for them: a scan of the nodes' grams finds those that are asked.
SOME = 2000


def grams(text: Column, size: int) -> Column:
    """The different runs of so many characters; a shorter text is one."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(size))))


def _key(gram: Column) -> Column:
    return F.concat_ws("\n", "project_id", gram)


def postings(g: Graph, name: str, hay: Column, size: int, project: Column) -> tuple[Steps, DataFrame]:
    """Steps from project and gram to the ids of nodes, and counts(node, n) of them. Lists carry ids, no texts."""
    rows = g.nodes.select("id", project.alias("project_id"), F.explode(grams(hay, size)).alias("gram")).select(_key(F.col("gram")).alias("node"), F.col("id").alias("next"))
    steps, key = laid_out(g, f"{name}{size}", rows), (g.home, f"{name}{size}-counts")
    if key in KEPT:
        return steps, KEPT[key]
    counts = settle(rows.groupBy("node").agg(F.count("*").alias("n")), "counts")
    if g.home:
        KEPT[key] = counts
    return steps, counts


def _rarest(each: DataFrame, counts: DataFrame) -> DataFrame:
    found = each.join(counts, "node", "left").groupBy("project_id", "needle").agg(F.count_if(F.col("n").isNull()).alias("none"), F.min_by("node", F.struct("n", "node")).alias("node"))
    return found.where("none = 0").select("node", "project_id", "needle")


def holding(g: Graph, asked: DataFrame, name: str, hay: Column, few: int = FEW, everywhere: bool = False, shown: tuple[str, ...] = ()) -> DataFrame:
    """project_id, needle, id, each once, and the columns shown: nodes of the project whose hay holds the needle; asked(project_id, needle).

    A needle is looked up by its rarest gram in its project, and what that finds is checked; one with a gram that the project does not
    have finds nothing. Lists of grams are written for many needles and used wherever they are there; for some, the grams asked are
    sought in the nodes, which moves nothing. name tells layouts of different hays of a graph apart. The empty needle is in every node.
    everywhere: needles, of the project named "", are sought in all projects.
    """
    project = F.lit("") if everywhere else F.col("project_id")
    columns = ["project_id", "needle", "id", *shown]
    q = asked.select("project_id", "needle").distinct()
    nodes = g.nodes.select("id", project.alias("project_id"), hay.alias("hay"), *shown)
    if q.limit(few + 1).count() <= few:
        return nodes.join(F.broadcast(q), "project_id").where(F.contains("hay", F.col("needle"))).select(*columns)
    q = settle(q, "needles")
    found = q.where("needle = ''").join(nodes, "project_id").select(*columns)
    for size in range(1, SIZE + 1):
        mine = q.where((F.length("needle") == size) if size < SIZE else (F.length("needle") >= size))
        if mine.isEmpty():
            continue
        each = mine.select("project_id", "needle", F.explode(grams(F.col("needle"), size)).alias("gram")).withColumn("node", _key(F.col("gram")))
        if (g.home, f"{name}{size}") not in KEPT and mine.limit(SOME + 1).count() <= SOME:
            held = nodes.select("*", F.explode(grams(F.col("hay"), size)).alias("gram")).withColumn("node", _key(F.col("gram"))).drop("gram", "project_id")
            counts = held.join(short(settle(each.select("node").distinct(), "grams")), "node", "left_semi").groupBy("node").agg(F.count("*").alias("n"))
            near = held.join(short(settle(_rarest(each, counts), "rarest")), "node").where(F.contains("hay", F.col("needle"))).select(*columns)
        else:
            steps, counts = postings(g, name, hay, size, project)
            near = steps.from_(_rarest(each, counts)).select("project_id", "needle", F.col("next").alias("id")).distinct()
            if size == SIZE or shown:
                near = near.join(nodes.drop("project_id"), "id").where(F.contains("hay", F.col("needle"))).select(*columns)
        found = found.unionByName(near)
    return found
