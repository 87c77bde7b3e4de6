"""Problem 1: splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import key
from textloom.llm.components import hash_to_min

SPLITS = ("train", "development", "calibration", "test")


def _units(unit: Column) -> list[tuple[str, Column]]:
    """Which keys a group_unit text names."""
    low = F.lower(unit)
    return [("run", low.rlike(r"\brun_id\b")), ("prompt", low.rlike(r"\bprompt_id\b")), ("contributor", low.rlike(r"\b(contributor|author)\b"))]


def contributors_of_runs(runs: DataFrame) -> DataFrame:
    """``(run, contributor)``, distinct: a run may be submitted several times and each row may spell
    or lack the contributor."""
    c = key(F.regexp_replace(key("contributor"), r"^@+", ""))
    return runs.select(key("run_id").alias("run"), c.alias("contributor")).where("run is not null and contributor is not null").distinct()


def record_nodes(records: DataFrame, runs: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with the key nodes they hang on, and the edges between key nodes.

    Nodes are strings ``cohort|kind|key``. A record is no node: it stands at its first key, and a
    record with several keys ties those keys together. So the graph has as many nodes as there are
    distinct keys, however many records a key has.
    """
    unit = F.coalesce(F.col("group_unit"), F.lit(""))
    m = manifest.select("cohort_id", *(c.alias(f"by_{n}") for n, c in _units(unit))).groupBy("cohort_id").agg(*(F.bool_or(f"by_{n}").alias(f"by_{n}") for n in ("run", "prompt", "contributor")))
    r = records.select("record_id", "cohort_id", key("run_id").alias("run"), key("prompt_id").alias("prompt")).where("record_id is not null").distinct().join(m, "cohort_id", "left")
    who = contributors_of_runs(runs)
    first = who.groupBy("run").agg(F.min("contributor").alias("contributor"))
    r = r.join(first, "run", "left")
    node = lambda kind, c: F.when(F.col(f"by_{kind}") & c.isNotNull(), F.concat_ws("|", "cohort_id", F.lit(kind), c))
    r = r.select("record_id", "cohort_id", F.col("run"), F.col("by_contributor"), *(node(k, F.col(k)).alias(f"n_{k}") for k in ("run", "prompt", "contributor")))
    r = r.withColumn("node", F.coalesce("n_run", "n_prompt", "n_contributor"))
    pairs = [("n_run", "n_prompt"), ("n_run", "n_contributor"), ("n_prompt", "n_contributor")]
    tied = r.select(F.explode(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs))).alias("e")).select("e.*").where("a is not null and b is not null").distinct()
    # A run that goes under several names ties these names together where a record of it is in the cohort.
    several = who.join(first.withColumnRenamed("contributor", "low"), "run").where("contributor <> low")
    named = r.where("by_contributor and run is not null").select("cohort_id", "run").distinct().join(several, "run")
    tag = lambda c: F.concat_ws("|", "cohort_id", F.lit("contributor"), c)
    return r.select("record_id", "cohort_id", "node"), tied.union(named.select(tag("low"), tag("contributor")).distinct())


def related_components(records: DataFrame, runs: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(record_id, cohort_id, component, first_record_id)`` for each record.

    Records of a cohort belong together if they share a key of the cohort's group_unit (run_id,
    prompt_id, the run's contributor, or any of several), carried on from record to record. Keys
    are compared without surrounding blanks, letter case and a leading ``@``; null and blank keys
    equal nothing, so a record without keys, of an unknown cohort or with unit ``record_id`` is a
    set of its own. Repeated record rows count once; empty tables give an empty result.
    """
    r, edges = record_nodes(records, runs, manifest)
    comp = hash_to_min(edges).withColumnRenamed("component", "root")
    by_node = r.where("node is not null").groupBy("cohort_id", "node").agg(F.min("record_id").alias("low")).join(comp, "node", "left").withColumn("component", F.coalesce("root", "node"))
    by_root = by_node.groupBy("cohort_id", "component").agg(F.min("low").alias("first_record_id"))
    at = by_node.join(by_root, ["cohort_id", "component"]).select("cohort_id", "node", "component", "first_record_id")
    out = r.join(at, ["cohort_id", "node"], "left")
    return out.select("record_id", "cohort_id", F.coalesce("component", F.concat_ws("|", "cohort_id", F.lit("record"), "record_id")).alias("component"), F.coalesce("first_record_id", "record_id").alias("first_record_id"))


def related_pairs(records: DataFrame, runs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each record of a set but the smallest, with the smallest."""
    return related_components(records, runs, manifest).where("record_id <> first_record_id").select("first_record_id", "record_id")


def rendezvous(node: Column, weights: dict[str, Column], seed: int) -> Column:
    """The name of the split with the highest score -w / ln(u), u drawn by hash from node and name.

    Each split wins with a chance in proportion to its weight, and a change of one weight moves
    only records to or from that split. Null, zero and negative weights never win; without any
    positive weight the result is null.
    """
    def score(name: str, w: Column) -> Column:
        u = (F.xxhash64(F.lit(seed), node, F.lit(name)).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.when(w > 0, F.struct((-w / F.log(u)).alias("score"), F.lit(name).alias("name")))

    return F.greatest(*(score(n, w) for n, w in weights.items())).getField("name")


def assign_splits(records: DataFrame, runs: DataFrame, manifest: DataFrame, seed: int = 20260819) -> DataFrame:
    """``(record_id, cohort_id, component, split)``: whole components go to a split of their cohort's
    shares by weighted rendezvous hashing. Records of a cohort without shares get a null split."""
    shares = manifest.groupBy("cohort_id").agg(*(F.max(f"{s}_share").alias(f"{s}_share") for s in SPLITS))
    r = related_components(records, runs, manifest).join(shares, "cohort_id", "left")
    return r.select("record_id", "cohort_id", "component", rendezvous(F.col("component"), {s: F.col(f"{s}_share") for s in SPLITS}, seed).alias("split"))


def split_shares(assigned: DataFrame, manifest: DataFrame) -> DataFrame:
    """Wanted and reached share of each split, by cohort."""
    n = assigned.where("split is not null").groupBy("cohort_id", "split").agg(F.count("*").alias("records"), F.countDistinct("component").alias("components"))
    total = n.groupBy("cohort_id").agg(F.sum("records").alias("all"))
    wanted = manifest.select("cohort_id", F.expr("stack(4, " + ", ".join(f"'{s}', {s}_share" for s in SPLITS) + ") as (split, target_share)"))
    return wanted.join(total, "cohort_id", "left").join(n, ["cohort_id", "split"], "left").select("cohort_id", "split", "target_share", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("components", F.lit(0)).alias("components"), (F.coalesce("records", F.lit(0)) / F.col("all")).alias("reached_share"))


