import random

import pytest
from pyspark.sql import functions as F

from textloom.llm import components, related_splits


def union(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        up[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("seed", [1, 2])
def test_hash_to_min(spark, seed):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(60):02}", f"n{r.randrange(60):02}") for _ in range(45)] + [("chain0", "chain1")] + [(f"chain{i}", f"chain{i + 1}") for i in range(1, 9)]
    got = components.hash_to_min(spark.createDataFrame([*edges, ("x", None), edges[0]], "a string, b string"))
    assert {x["node"]: x["component"] for x in got.collect()} == union(edges)
    assert components.hash_to_min(spark.createDataFrame([], "a string, b string")).count() == 0


RUNS = "run_id string, contributor string, extra int"
RECORDS = "record_id bigint, cohort_id string, run_id string, prompt_id string, component string, node string"
MANIFEST = "cohort_id string, group_unit string, train_share double, development_share double, calibration_share double, test_share double"


def tables(spark):
    records = [
        (1, "a", " Run-1 ", None, "x", "x"), (2, "a", "run-1", "p", None, None), (3, "a", None, "p", None, None), (4, "a", "", "p", None, None), (1, "a", " Run-1 ", None, "x", "x"),
        (10, "b", "r1", "p1", None, None), (11, "b", "r2", "P1", None, None), (12, "b", "r2", None, None, None), (13, "b", None, None, None, None), (14, "b", "r9", "p9", None, None),
        (20, "c", "r1", None, None, None), (21, "c", "r2", None, None, None), (22, "c", "r3", None, None, None), (23, "c", "r4", None, None, None), (24, "c", "r5", None, None, None),
        (30, "d", "r1", "p1", None, None), (31, "d", "r1", "p1", None, None), (40, "nowhere", "r1", None, None, None), (None, "a", "run-1", None, None, None),
    ]
    runs = [("r1", "@Ann", 1), ("R1", " ann", 2), ("r2", None, 1), ("r2", "ANN ", 1), ("r3", None, 1), ("r4", "bob", 1), ("r4", "carl", 1), ("r5", "Carl", 1)]
    manifest = [("a", "run_id", 0.7, 0.1, 0.05, 0.15), ("b", "prompt_id or run_id, carried on", 0.7, 0.1, 0.1, 0.1), ("c", "contributor of the run (author)", 0.6, 0.1, 0.1, 0.2), ("d", "record_id", 0.5, 0.1, 0.1, 0.3)]
    return spark.createDataFrame(records, RECORDS), spark.createDataFrame(runs, RUNS), spark.createDataFrame(manifest, MANIFEST)


def test_related_pairs(spark):
    got = sorted(tuple(r) for r in related_splits.related_pairs(*tables(spark)).collect())
    assert got == [(1, 2), (10, 11), (10, 12), (20, 21), (23, 24)]


def test_splits_keep_sets_together_and_meet_shares(spark):
    records, runs, manifest = tables(spark)
    s = related_splits.assign_splits(records, runs, manifest)
    assert s.groupBy("component").agg(F.countDistinct("split").alias("k")).where("k > 1").count() == 0
    assert [r["split"] for r in s.where("cohort_id = 'nowhere'").collect()] == [None]
    many = spark.range(0, 4000).select(F.col("id").alias("record_id"), F.lit("d").alias("cohort_id"), F.lit("r").alias("run_id"), F.lit("p").alias("prompt_id"))
    shares = {r["split"]: r["reached_share"] for r in related_splits.split_shares(related_splits.assign_splits(many, runs, manifest), manifest).where("cohort_id = 'd'").collect()}
    assert abs(shares["train"] - 0.5) < 0.03 and abs(shares["test"] - 0.3) < 0.03
    assert related_splits.related_pairs(records.limit(0), runs.limit(0), manifest.limit(0)).count() == 0
