import random

import pyarrow as pa
import pytest

from sigspark.llm import components as linked


@pytest.fixture
def many_partitions(spark):
    """As in a session whose partitions are many for the links at hand."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def least(links):
    root = {x: x for link in links for x in link if link[0] != link[1]}
    changed = True
    while changed:
        changed = False
        for u, v in links:
            low = min(root.get(u, u), root.get(v, v))
            for x in (u, v):
                if root.get(x, low) != low:
                    root[x], changed = low, True
    return root


def test_few_links_make_few_partitions_and_stages(spark, many_partitions):
    """A chain of 300 once took nine rounds of stages of as many tasks as the session has partitions."""
    links = [(k, k + 1) for k in range(300)]
    spark.sparkContext.setJobGroup("components", "components")
    found = linked.components(spark.createDataFrame(links, "u long, v long"))
    assert {(r.node, r.root) for r in found.collect()} == {(k, 0) for k in range(301)}
    assert found.rdd.getNumPartitions() <= 2
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
    ran = [i for i in map(tracker.getStageInfo, stages) if i is not None]
    spark.sparkContext._jsc.clearJobGroup()
    assert sum(i.numCompletedTasks for i in ran) < 300


@pytest.mark.parametrize("rows", [7, 1000])
def test_links_in_several_partitions(spark, many_partitions, monkeypatch, rows):
    """Also where partitions hold few links each, so that components cross them."""
    from sigspark.llm import common

    monkeypatch.setattr(common, "GATHERED", rows)
    rng = random.Random(3)
    links = [(rng.randrange(-40, 200), rng.randrange(-40, 200)) for _ in range(120)] + [(1000 + k, 1001 + k) for k in range(60)]
    found = linked.components(spark.createDataFrame(links, "u long, v long").repartition(9)).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.root for r in found} == least(links)


def test_contraction_keeps_components_across_batches(monkeypatch):
    rng = random.Random(5)
    links = [(rng.randrange(100), rng.randrange(100)) for _ in range(90)]
    links = [x for x in links if x[0] != x[1]]
    for held in (1, 16, 1000):
        monkeypatch.setattr(linked, "_HELD", held)
        batches = [pa.RecordBatch.from_arrays([pa.array([u for u, _ in part]), pa.array([v for _, v in part])], ["u", "v"]) for part in (links[k : k + 10] for k in range(0, len(links), 10))]
        got = [(r["u"], r["v"]) for b in linked._contracted(iter(batches)) for r in b.to_pylist()]
        assert least(got) == least(links) and all(v < u for u, v in got)
