"""Posting lists against scans."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import activation, grams, semantic
from loomgraph.sources import tables
from loomgraph.sources.tables import Graph


def made(spark, seed, home=""):
    rng = random.Random(seed)
    name = lambda n: "".join(rng.choices("abcABÉé/.:", k=rng.randint(0, n)))
    rows = [(str(k), rng.choice(["p", "q"]), rng.choice(["symbol", "namespace", "concept", "file"]), name(12), name(6)) for k in range(250)]
    nodes = spark.createDataFrame(rows, "id string, project_id string, type string, canonical_id string, label string")
    edges = spark.createDataFrame([(str(k), str(rng.randrange(250)), str(rng.randrange(250))) for k in range(50)], "id string, source_id string, target_id string")
    needles = [(rng.choice(["p", "q", "none"]), name(rng.choice([1, 2, 3, 5]))) for _ in range(200)]
    return Graph(nodes, edges, None, None, home), rows, needles


@pytest.mark.parametrize("everywhere", [False, True])
def test_holding_equals_a_scan(spark, tmp_path, everywhere):
    g, rows, needles = made(spark, 4, str(tmp_path))
    asked = spark.createDataFrame([("" if everywhere else p, n.lower()) for p, n in needles], "project_id string, needle string")
    want = sorted({(p, n, i) for p, n in asked.collect() for i, q, _, c, _ in rows if n in c.lower() and (everywhere or p == q)})
    for few in (0, 10_000):
        got = grams.holding(g, asked, f"names{everywhere}", F.lower("canonical_id"), few, everywhere)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 500


def test_lists_carry_ids_and_lie_where_they_are_joined(spark, sf):
    g = tables.graph(spark, sf)
    steps, counts = grams.postings(g, "canonical", F.lower("canonical_id"), 3, F.col("project_id"))
    assert set(steps.rows.columns) <= {"node", "next", "part"} and counts.columns == ["node", "n"]
    asked = g.nodes.where("type = 'symbol'").select("project_id", F.lower("label").alias("needle")).limit(300)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = grams.holding(g, asked, "canonical", F.lower("canonical_id"), 0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_anchors_and_candidates_by_lists_and_by_scans(spark):
    g, rows, needles = made(spark, 6)
    kinds = ["symbol", "namespace", "concept", "file"]
    anchors = spark.createDataFrame([(p, kinds[k % 4], n, "high") for k, (p, n) in enumerate(needles) if n], "project_id string, kind string, ref string, confidence string")
    shown = lambda few: sorted(map(tuple, activation.resolve_anchors(g, anchors, few).collect()))
    assert shown(0) == shown(10_000) and len(shown(0)) > 200
    wanted = spark.createDataFrame([(n, p, str(k)) for k, (p, n) in enumerate(needles)], "query string, project_id string, unit string")
    found = lambda few: sorted(map(tuple, semantic.resolution_candidates(g, wanted, few=few).collect()))
    assert found(0) == found(10_000) and len(found(0)) > 200
