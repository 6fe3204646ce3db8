"""Links and groups from candidate buckets, without forming all pairs of a bucket.

``link_buckets`` finds the components of the link graph that a verifier decides.
A bucket of members needs no more than a spanning set of verified links, so it
tries stars first: every member against the most central member of its bucket.
Only members that remain in different components are compared with each other,
all that an exact index leaves possible, so no link between different texts is
lost whatever a bucket's size.

All joins are plain equi-joins on their own exchange, so adaptive execution can
split a hot bucket, and every aggregation combines before it shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarefield.operators.components import connected_components, extend_components
from rarefield.scratch import Scratch

Verify = Callable[[DataFrame], DataFrame]


def link_buckets(buckets: DataFrame, prepare: Callable[[DataFrame], Verify], scratch: Scratch, near: Callable[[Column, Column], Column] | None = None, index: Callable[[DataFrame], DataFrame] | None = None, possible: Column | None = None) -> DataFrame:
    """(node, component) of the members that a verified link joins to another.

    ``buckets`` has the long columns ``key`` and ``id``.  ``prepare`` gets the
    distinct ``id`` of all members that share a bucket, once, and returns the
    verifier, which takes distinct pairs (a, b) with a < b and returns the links.
    With ``near``, ``buckets`` also has a ``sketch``, the same in all rows of
    an id; only pairs whose sketches pass ``near``, in either order, are verified.
    With ``index``, members still apart after the stars are not compared by their
    buckets.  It gets the pairs (hub, id) of a bucket's hub and member, and returns
    sharper rows (key, id, sketch, more columns c): two members that were compared
    with one hub, and could be linked, share a key of it at which ``possible``, a
    condition over sketch, c of the one and hs, h_c of the other, holds.
    """
    if near is None:
        near, buckets = (lambda one, other: F.lit(True)), buckets.withColumn("sketch", F.lit(0).cast("long"))
    rows = buckets.select("key", "id", "sketch")
    sized = rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"), F.min("sketch").alias("x"), F.max("sketch").alias("y"))
    sized = scratch.save(sized.where("lo < hi"), "sized")
    two = sized.where("n = 2").where(near(F.col("x"), F.col("y"))).select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    crowded = scratch.save(sized.where("n > 2").select("key", "n"), "crowded")
    big = scratch.save(rows.join(crowded, "key").select("key", "id", "sketch", "n"), "members")
    central = big.groupBy("id").agg(F.sum("n").alias("c"))
    rank = F.struct(F.col("c"), (-F.col("id")).alias("m"), F.col("sketch").alias("s"))
    ranked = scratch.save(big.join(central, "id").select("key", "id", "sketch", rank.alias("rank")), "ranked")
    ordered = [F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")]
    near_hub = near(F.col("sketch"), F.col("hs"))

    hub = ranked.groupBy("key").agg(F.max("rank").alias("h")).select("key", (-F.col("h.m")).alias("hub"), F.col("h.s").alias("hs"))
    hub = scratch.save(hub, "hubs")
    star = ranked.join(hub, "key").where("id != hub").where(near_hub).select(*ordered)
    tried = scratch.save(two.union(star).distinct(), "pairs")
    scratch.drop(sized, crowded)
    shared = tried.select(F.col("a").alias("id")).union(tried.select("b")).union(big.select("id")).distinct()
    verify = prepare(scratch.save(shared, "shared"))
    scratch.drop(big)
    links = scratch.save(verify(tried), "links")
    comps = connected_components(links, scratch)

    def open_members() -> DataFrame:
        """Members of buckets that still hold several components, with their component."""
        own = comps.select(F.col("node").alias("id"), "component")
        known = ranked.join(own, "id", "left").select("key", "id", "sketch", "rank", F.coalesce("component", "id").alias("comp"))
        many = known.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
        return scratch.save(known.join(many, "key", "left_semi"), "open")

    # a second star, from the most central member outside the first hub's component
    members = open_members()
    if members.isEmpty():
        return comps
    top = F.max(F.struct("rank", "comp")).alias("h")
    first = members.groupBy("key").agg(top).select("key", F.col("h.comp").alias("hc"))
    outside = members.join(first, "key").where("comp != hc")
    second = outside.groupBy("key").agg(top).select("key", (-F.col("h.rank.m")).alias("hub"), F.col("h.rank.s").alias("hs"), F.col("h.comp").alias("hc"))
    star = members.join(second, "key").where("comp != hc").where(near_hub).select(*ordered)
    fresh = scratch.save(star.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    comps = extend_components(comps, scratch.save(verify(fresh), "links"), scratch)
    tried = tried.union(fresh)
    # the rest: pairs of different components that share a key
    members = open_members()
    if members.isEmpty():
        return comps
    fits = near_hub
    if index is not None:
        compared = members.join(hub, "key").where("id != hub").select("hub", "id").distinct()
        own = members.select("id", "comp").distinct()
        members = scratch.save(index(scratch.save(compared, "compared")).join(own, "id"), "indexed")
        held = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
        per_key = held.groupBy("key").agg(F.max(F.struct("n", "comp"))["comp"].alias("most"), F.count("*").alias("comps")).where("comps > 1")
        fits = possible
    else:
        held = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
        per_key = held.groupBy("key").agg(F.max(F.struct("n", "comp"))["comp"].alias("most"))
    # members outside a key's largest component meet all others of the key; the largest component never meets itself
    lone = members.join(per_key.select("key", "most"), "key").where("comp != most")
    told = [c for c in members.columns if c not in ("key", "id", "comp", "sketch", "rank")]
    other = members.select("key", F.col("id").alias("hub"), F.col("sketch").alias("hs"), F.col("comp").alias("hc"), *[F.col(c).alias(f"h_{c}") for c in told])
    once = (F.col("comp") < F.col("hc")) | ((F.col("hc") == F.col("most")) & (F.col("comp") != F.col("hc")))
    cross = lone.join(other, (lone["key"] == other["key"]) & once & fits).select(*ordered)
    fresh = scratch.save(cross.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    return extend_components(comps, scratch.save(verify(fresh), "links"), scratch)
