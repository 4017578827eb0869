"""Links inside buckets and the groups they connect, as DataFrame operations.

A bucket never becomes all pairs of its members.  First every member is compared
with the bucket's best-known member, the one that shares most bucket places with
others: the original of a group of edited copies, say.  Members that the verified links already
connect need no more comparison.  Then, twice, a drawn member is compared with those of other groups.  Members of buckets that still hold more than one group
are compared across the groups: all of them, if the bucket has at most ``narrow``
members, else the pairs that ``within`` can't rule out by an exact condition.  So
two members meet if they share a key, however many hold it.
A caller that knows a sharper condition than shared buckets gives ``across``; one
that can tell from a few numbers of two members that they are no link gives them
(``signs``) and the condition (``fits``), which the joins that make pairs apply,
so pairs that can't be links are never written.

Defined results: members without a link, and an empty table, give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize, new_path

#: Rounds after which groups are good enough to leave comparisons out.
_ROUNDS = 2
#: How often drawn members are compared with those of other groups, which joins most groups before all their pairs are made.
_TURNS = 2


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, comp (the least node it is connected with) for every node of ``edges`` (a, b).

    After so many ``rounds``, if given, nodes of one comp are connected, but not all that are connected have one comp.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, "edges")
    path = new_path(spark, "labels")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("comp"), F.lit(True).alias("moved")), "labels", path=path)
    done = 0
    while done != rounds and labels.where("moved").limit(1).count():
        done += 1
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.select("node", "comp").join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        jumped = step.join(up, "comp", "left").select("node", F.coalesce(F.least("comp", "up"), "comp").alias("comp"), "old")
        before, path = path, new_path(spark, "labels")
        labels = materialize(jumped.select("node", "comp", (F.col("comp") != F.col("old")).alias("moved")), "labels", path=path)
        discard(spark, before)
    return labels.select("node", "comp")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """The rows (key, node) of buckets with more than one row; nodes are distinct within a bucket."""
    keys = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return materialize(rows.join(materialize(keys, "shared-keys"), "key"), "members")


def beside(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``rows`` (node, ...) of both members, their names followed by a and b."""
    for side in "ab":
        pairs = pairs.join(rows.withColumnsRenamed({c: side if c == "node" else c + side for c in rows.columns}), side)
    return pairs


def _if_given(fits: Column | None) -> Column:
    return F.lit(True) if fits is None else fits


def _stars(members: DataFrame, signs: DataFrame | None, fits: Column | None) -> DataFrame:
    """Pairs (a < b) of each bucket's best-known member with the others, as far as they fit."""
    sizes = materialize(members.groupBy("key").agg(F.count("*").alias("size")), "sizes")
    known = materialize(members.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("known")), "known")
    best = members.join(known, "node").groupBy("key").agg(F.max(F.struct("known", "node")).alias("best"))
    centers = materialize(best.select("key", F.col("best.node").alias("center")), "centers")
    stars = members.join(centers, "key").where("center <> node").select(F.least("center", "node").alias("a"), F.greatest("center", "node").alias("b")).distinct()
    return materialize((beside(stars, signs) if signs else stars).where(_if_given(fits)).select("a", "b"), "stars")


def _unlinked(members: DataFrame, groups: DataFrame) -> DataFrame:
    """key, node, comp, size of the members of buckets with more than one group."""
    placed = materialize(members.join(groups, "node", "left").select(*members.columns, F.coalesce("comp", "node").alias("comp")), "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size")).where("x <> y").select("key", "size")
    return materialize(placed.join(materialize(mixed, "mixed"), "key"), "unlinked")


def _spokes(rest: DataFrame, tried: DataFrame, turn: int, signs: DataFrame | None, fits: Column | None) -> DataFrame:
    """Pairs (a < b), not ``tried`` yet, of a member of each bucket, drawn anew each ``turn``, with those of other groups, as far as they fit."""
    drawn = rest.groupBy("key").agg(F.max(F.struct(F.xxhash64("node", F.lit(turn)), "node", "comp")).alias("x")).select("key", F.col("x.node").alias("hub"), F.col("x.comp").alias("own"))
    spokes = rest.join(drawn, "key").where("comp <> own").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    spokes = spokes.join(tried, ["a", "b"], "left_anti")
    return materialize((beside(spokes, signs) if signs else spokes).where(_if_given(fits)).select("a", "b"), "spokes")


def _across(rest: DataFrame, signs: DataFrame | None = None, fits: Column | None = None) -> DataFrame:
    """Pairs (a < b) of each bucket's members of different groups, as far as they fit."""
    rest = rest.select("key", "node", "comp")
    rest = materialize(rest.join(signs, "node"), "signed") if signs else rest
    left, right = (rest.withColumnsRenamed({c: side if c == "node" else c + side for c in rest.columns if c != "key"}) for side in "ab")
    return left.join(right, "key").where((F.col("compa") != F.col("compb")) & (F.col("a") < F.col("b")) & _if_given(fits)).select("a", "b").distinct()


def link(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    across: Callable[[DataFrame], DataFrame] | None = None,
    within: Callable[[DataFrame], DataFrame] = _across,
    *,
    signs: DataFrame | None = None,
    fits: Column | None = None,
    narrow: int = 256,
) -> DataFrame:
    """node, comp of all members that a chain of verified pairs joins to others.

    ``members`` (key, node) is a written table; ``verify`` gets distinct pairs
    (a < b) and returns those that are similar enough.  ``across`` gets the
    members (node, comp) of buckets that hold more than one group and returns
    distinct pairs (a < b) of different groups with every similar pair among them.
    ``within`` gets the members (key, node, comp) of the wide ones of these
    buckets and returns distinct pairs with every similar pair of different
    groups that shares a bucket.  ``fits`` holds for all similar pairs; it sees
    the columns of ``signs`` (node, ...) as those of ``beside``.
    """
    stars = _stars(members, signs, fits)
    links = materialize(verify(stars).select("a", "b"), "links")
    groups = components(links, _ROUNDS)
    rest = _unlinked(members, groups)
    if across:
        pairs = across(materialize(rest.select("node", "comp").distinct(), "across"))
    else:
        for turn in range(_TURNS):
            spokes = _spokes(rest, stars, turn, signs, fits)
            stars, links = stars.unionByName(spokes), links.unionByName(materialize(verify(spokes).select("a", "b"), "links"))
            rest = _unlinked(members, components(links, _ROUNDS))
        wide = materialize(rest.where(F.col("size") > narrow).select("key", "node", "comp"), "wide")
        pairs = _across(rest.where(F.col("size") <= narrow), signs, fits).unionByName(within(wide)).distinct()
    pairs = materialize(pairs.join(stars, ["a", "b"], "left_anti"), "pairs")
    return components(links.unionByName(materialize(verify(pairs).select("a", "b"), "links")))
