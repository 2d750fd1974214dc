"""Small tables take few tasks, and so few files, however many partitions shuffles have."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from test_near_duplicates import found, joined, made, similar_pairs

from recscope.llm import simhash_ball
from recscope.scratch import own_dir

PARTITIONS = 50


def tasks_of(spark, name: str, work):
    """What ``work`` returns, and how many tasks it took with ``PARTITIONS`` that are not joined."""
    held = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup(name, name)
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(name) if (info := tracker.getJobInfo(job)) for s in info.stageIds}
    return out, sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))


def test_stars_of_few_links(spark):
    links = [(k, k + 1) for k in range(0, 30)] + [(100, 200), (300, 200), (5, 5)]
    edges = spark.createDataFrame(links, "a long, b long").coalesce(1)
    roots, tasks = tasks_of(spark, "stars", lambda: dict(map(tuple, simhash_ball.stars(edges).collect())))
    assert roots == {k: 0 for k in range(1, 31)} | {200: 100, 300: 100}
    assert 0 < tasks < 25 * PARTITIONS


def test_near_duplicates_of_few_texts(spark):
    texts = made(1, 60)
    got, tasks = tasks_of(spark, "near_duplicates", lambda: found(spark, texts))
    assert got == joined(texts, similar_pairs(texts, 5))
    assert 0 < tasks < 80 * PARTITIONS


def written(spark, name: str) -> int:
    """How many scratch tables of a name there are."""
    return len(list(Path(own_dir(spark).removeprefix("file://")).glob(f"{name}-*")))


def test_stars_run_no_round_that_changes_nothing(spark):
    before = written(spark, "stars")
    edges = spark.createDataFrame([(2, 1), (1, 3), (9, 8)], "a long, b long")
    assert sorted(map(tuple, simhash_ball.stars(edges).collect())) == [(2, 1), (3, 1), (9, 8)]
    assert simhash_ball.stars(edges.where("a > 9")).count() == 0
    assert written(spark, "stars") == before
    edges = spark.createDataFrame([(1, 3), (2, 3)], "a long, b long")
    assert sorted(map(tuple, simhash_ball.stars(edges).collect())) == [(2, 1), (3, 1)]
    assert written(spark, "stars") == before + 1


def test_verification_has_no_udf_below_joined_partitions(spark):
    sets = {k: np.arange(100 * (k > 5), 100 * (k > 5) + 20 + k % 2, dtype=np.uint64).tobytes() for k in range(10)}
    members = spark.createDataFrame([(k, bytearray(v)) for k, v in sets.items()], "set long, members binary")
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "a long, b long")
    got = simhash_ball._verified(pairs, members)
    assert sorted(map(tuple, got.collect())) == [(a, b) for a in sets for b in sets if a < b and (a > 5) == (b > 5)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan and "EvalPython" not in plan
