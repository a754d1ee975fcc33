"""Pending writes as state: flushes by number and by time."""

import random
import time
from collections import defaultdict

import pytest

from loomgraph.operators.merge import FLUSH, pending
from loomgraph.streaming import pending as state

SCHEMA = "project_id string, op string, entity string, payload string, seq long, delta long"


@pytest.fixture
def rocks(spark):
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    yield spark
    spark.conf.set(setting, before)


def test_flushes_by_number_and_time(rocks, tmp_path):
    spark, rng = rocks, random.Random(2)
    rows = [("p", rng.choice(FLUSH), f"e{rng.randrange(90)}", f"v{k}", k, rng.randrange(5)) for k in range(400)] + [("q", "node", "x", f"v{k}", k, 0) for k in range(30)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/in")
    got = []
    found = state.flushes(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in"), most=100, wait=50)
    start = lambda: found.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="100 milliseconds").foreachBatch(lambda df, _: got.extend(df.collect())).start()
    query = start()
    try:
        end = time.time() + 60
        while time.time() < end and not (any(r.project_id == "q" and r.payload == "v29" for r in got) and any(r.project_id == "p" and r.seq == 399 for r in got)):
            time.sleep(0.2)
        time.sleep(1)
    finally:
        query.stop()
    by = defaultdict(list)
    for r in got:
        by[r.project_id, r.flush].append(r)
    assert [k for k in sorted(by) if k[0] == "q"] and all(len(v) <= 100 for v in by.values())
    assert all(len(v) == 100 for v in by.values() if v[0].reason == "full") and {v[0].reason for v in by.values()} == {"full", "time"}
    for v in by.values():
        assert [(r.place, r.seq) for r in v] == sorted((r.place, r.seq) for r in v) and len({(r.op, r.entity, r.seq if r.op == "enrichment" else 0) for r in v}) == len(v)
    # all flushes together are what the writes are worth
    want = {(r.project_id, r.op, r.entity, r.seq if r.op == "enrichment" else 0): (r.payload, r.delta) for r in pending(spark.createDataFrame(rows, SCHEMA)).collect()}
    last, deltas = {}, defaultdict(int)
    for r in sorted(got, key=lambda r: r.seq):
        key = (r.project_id, r.op, r.entity, r.seq if r.op == "enrichment" else 0)
        last[key] = r.payload
        deltas[key] += r.delta
    assert {k: (last[k], deltas[k]) for k in last} == want
