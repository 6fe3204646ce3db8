"""Connected components of an edge list, by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.  Each round
is written to the shared scratch folder, so lineage stays short and a lost
executor costs no earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefield.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge list of longs; component is the smallest node reachable."""
    scratch = scratch or Scratch(edges.sparkSession, "components")
    now = scratch.save(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges"
    )
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # repeats stay until the end of the round: neither step makes more rows than it reads
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_min, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        then = scratch.save(small, "edges")
        r = then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = then
        if (r[0], r[1]) == mark:
            break
        mark = (r[0], r[1])
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def extend_components(comps: DataFrame, edges: DataFrame, scratch: Scratch | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) after ``edges`` join nodes of ``comps``, or nodes it doesn't hold.

    Only the edges between different components are solved, each end replaced by its
    component, so the rounds run over a graph as large as what is new.  A component's
    name is its smallest node, and so is that of the joined ones.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    of_a = comps.select(F.col("node").alias(a), F.col("component").alias("_ca"))
    of_b = comps.select(F.col("node").alias(b), F.col("component").alias("_cb"))
    named = edges.select(a, b).join(of_a, a, "left").join(of_b, b, "left").select(F.coalesce("_ca", a).alias("a"), F.coalesce("_cb", b).alias("b"))
    between = scratch.save(named.where("a != b").distinct(), "between")
    if between.isEmpty():
        return comps
    merged = connected_components(between, scratch).select(F.col("node").alias("component"), F.col("component").alias("_to"))
    moved = comps.join(merged, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    new = merged.select(F.col("component").alias("node"), F.col("_to").alias("component")).join(comps, "node", "left_anti")
    return scratch.save(moved.union(new), "components")


def label_nodes(nodes: DataFrame, edges: DataFrame, scratch: Scratch | None = None, id_col: str = "node") -> DataFrame:
    """(node, component) of all nodes; those without an edge are their own component."""
    found = connected_components(edges, scratch)
    own = nodes.select(F.col(id_col).alias("node")).distinct()
    return own.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
