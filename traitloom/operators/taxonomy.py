"""Trees of traits: closure, roll-ups and pruning. ``tree`` has (id, name, parent_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.operators.bitsets import distinct_counts, member_blocks
from traitloom.sources.scratch import materialise


def closure(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance), every node with itself too.

    One join doubles the reach, so a tree of depth d takes about log2(d) of them; the first
    that adds no pair is the last. Nodes under a missing parent keep what lies below them.
    Nodes in a circle reach each other at the least distance.
    """
    nodes = tree.select(F.col("id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(0).alias("distance"))
    steps = tree.where("parent_id is not null").select(F.col("parent_id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(1).alias("distance"))
    shortest = lambda pairs: materialise(pairs.groupBy("ancestor", "descendant").agg(F.min("distance").alias("distance")), "closure")
    known, before = shortest(nodes.unionByName(steps)), -1
    while (size := known.count()) != before:
        before = size
        a, b = known.alias("a"), known.alias("b")
        known = shortest(a.join(b, F.col("a.descendant") == F.col("b.ancestor")).select("a.ancestor", "b.descendant", (F.col("a.distance") + F.col("b.distance")).alias("distance")))
    return known


def rooted(tree: DataFrame) -> DataFrame:
    """Nodes whose parents are all known, up to a root; others vanish from the tree."""
    roots = tree.where("parent_id is null").select(F.col("id").alias("root"))
    reached = closure(tree).join(roots, F.col("ancestor") == F.col("root"), "left_semi")
    return reached.select(F.col("descendant").alias("id")).distinct()


def roll_up(tree: DataFrame, leaf_counts: DataFrame) -> DataFrame:
    """The sum of leaf counts (id, n) under each node."""
    return closure(tree).join(leaf_counts, F.col("descendant") == F.col("id")).groupBy(F.col("ancestor").alias("id")).agg(F.sum("n").alias("sum_count"))


def distinct_up(tree: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct members (id, member) under each node.

    Members become blocks of bits at their own nodes, and only blocks go up to the ancestors,
    where they are merged: a node and block is one row, however many members stand below.
    """
    own = member_blocks(members, ["id"], "member")
    above = closure(tree).join(own, F.col("descendant") == F.col("id")).select(F.col("ancestor").alias("id"), "block", "bits")
    return distinct_counts(above, ["id"]).select("id", F.col("n").alias("distinct_count"))


def pruned(tree: DataFrame, leaf_counts: DataFrame, least: int) -> DataFrame:
    """Roll-up of the leaves with at least so many."""
    return roll_up(tree, leaf_counts.where(F.col("n") >= least))


def uncategorized(values: DataFrame, tree: DataFrame) -> DataFrame:
    return values.join(tree.select(F.lower("name").alias("value")), "value", "left_anti")


def cross_cut(groups: DataFrame, tree: DataFrame, holders: DataFrame) -> DataFrame:
    """Per cross-cutting group the distinct figures that hold one of its traits.

    ``groups`` has (group, trait_id, standalone), ``holders`` (figure_id, token).
    """
    named = groups.join(tree.select(F.col("id").alias("trait_id"), "name"), "trait_id", "left").select("group", F.lower(F.coalesce("standalone", "name")).alias("token"))
    wanted = named.distinct()
    figures = member_blocks(holders.join(wanted.select("token").distinct(), "token", "left_semi"), ["token"], "figure_id").join(wanted, "token")
    traits = figures.groupBy("group").agg(F.count_distinct("token").alias("n_traits"))
    return distinct_counts(figures, ["group"]).withColumnRenamed("n", "n_figures").join(traits, "group")
