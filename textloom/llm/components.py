"""Connected components by hash-to-min exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import join_rows
from textloom.session import cut_lineage


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each node of ``edges``; the component is its smallest node.

    Every node v holds a cluster C(v), at first itself and its neighbours, kept as rows (v, u)
    rather than as a list, so that a component of any size spreads over tasks. In each round v
    sends C(v) to m = min C(v), and m to every member of C(v); it ends when no cluster changes,
    after about log(n) rounds. The minimum is aggregated before the shuffle; the join that brings
    it back has one row per node on its other side, so adaptive skew joins can split a hot node.
    Each round is cut off by a checkpoint. Rows with a null end are ignored; repeated edges and
    self loops change nothing; no edges give an empty result.
    """
    e = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v is not null and u is not null")
    state = e.union(e.selectExpr("u", "v")).union(e.selectExpr("v", "v")).union(e.selectExpr("u", "u")).distinct()
    state = cut_lineage(state)
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
    last = print_of(state)
    for _ in range(max_rounds):
        if not last[0]:
            break
        low = state.groupBy("v").agg(F.min("u").alias("m"))
        sent = join_rows(state, low, "v")
        state = cut_lineage(sent.selectExpr("m as v", "u").union(sent.selectExpr("u as v", "m as u")).distinct())
        now = print_of(state)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    return state.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
