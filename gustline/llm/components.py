"""Connected components as DataFrame operations: alternating large-star and small-star steps.

Each step is one aggregation with partial sums and one equi-join, so a hub that holds a third of all edges is
split by the adaptive skew join and never meets in one task as a group. Every step is written to the shared
folder, and the loop ends when a step changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.llm.shared import stash, unstash


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: columns a, b of any one ordered type. Returns node, component (its smallest node) for every
    node of an edge between two different nodes; no edges give an empty result. Nulls are dropped."""
    e = edges.filter("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stash(e)
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lows, "u").filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stash(small.unionByName(lows.select("u", F.col("m").alias("v"))).distinct())
        unstash(e)
        e, before = new, state
        state = _state(e)
        if state == before:
            break
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(e: DataFrame) -> tuple:
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
