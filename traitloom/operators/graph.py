"""Edges between figures: names, pairs, merges, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitloom.functions.names import bare_letters, name_variants
from traitloom.sources.scratch import materialise


def both_ways(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    return edges.select(F.col(a).alias("a"), F.col(b).alias("b")).union(edges.select(F.col(b).alias("a"), F.col(a).alias("b")))


def unordered(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """The edges with their ends in order, so that a pair is an equality key."""
    low, high = F.least(a, b), F.greatest(a, b)
    return edges.withColumns({a: low, b: high})


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One edge for each unordered pair and relation."""
    return unordered(edges).select("src", "dst", "relation").distinct()


def new_edges(proposed: DataFrame, existing: DataFrame) -> DataFrame:
    """Proposed pairs that exist in neither direction."""
    return unordered(proposed).join(unordered(existing).select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))


def related(edges: DataFrame, focal: int) -> DataFrame:
    """Nodes with an edge to or from one of them."""
    return both_ways(edges).where(F.col("a") == focal).select(F.col("b").alias("node")).distinct()


def with_names(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with the names of their ends; an unknown end has a null name."""
    s, d = names.select(F.col("id").alias("src"), F.col("name").alias("src_name")), names.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"))
    return edges.join(s, "src", "left").join(d, "dst", "left")


def search_edges(named: DataFrame, query: str) -> DataFrame:
    q = F.lit(query.lower())
    has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), q)
    return named.where(has("src_name") | has("dst_name") | has("relation"))


def visible_edges(edges: DataFrame, nodes: DataFrame, relations: list[str]) -> DataFrame:
    ids = nodes.select("id")
    return edges.where(F.col("relation").isin(*relations)).join(ids, edges.src == ids.id, "left_semi").join(ids, edges.dst == ids.id, "left_semi")


def group_pairs(members: DataFrame) -> DataFrame:
    """All pairs within each named group of (group, pos, id); groups are short written lists.

    This is for curated groups; a group of a corpus would square.
    """
    a, b = members.alias("a"), members.alias("b")
    return a.join(b, (F.col("a.group") == F.col("b.group")) & (F.col("a.pos") < F.col("b.pos"))).select(
        F.col("a.group").alias("group"), F.col("a.id").alias("src"), F.col("b.id").alias("dst"))


def merge_nodes(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges with merged ends (old, new) redirected; loops go and repeats become one."""
    s, d = merged.select(F.col("old").alias("src"), F.col("new").alias("src_new")), merged.select(F.col("old").alias("dst"), F.col("new").alias("dst_new"))
    moved = edges.join(s, "src", "left").join(d, "dst", "left").select(F.coalesce("src_new", "src").alias("src"), F.coalesce("dst_new", "dst").alias("dst"), "relation")
    return moved.where("src <> dst").distinct()


def remap_ids(edges: DataFrame, old_names: DataFrame, new_names: DataFrame) -> DataFrame:
    """Edges over old ids as edges over new ids, through the names; ends without a match go."""
    ids = old_names.select(F.col("id").alias("old"), "name").join(new_names.select(F.col("id").alias("new"), "name"), "name").select("old", "new")
    s, d = ids.select(F.col("old").alias("src"), F.col("new").alias("new_src")), ids.select(F.col("old").alias("dst"), F.col("new").alias("new_dst"))
    return edges.join(s, "src").join(d, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "relation")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached.

    Labels start at the node itself; each round takes the least label of the neighbours and
    then the label of that label, which halves distances. A count of changes ends it.
    """
    links = materialise(both_ways(edges).where("a is not null and b is not null").distinct(), "component-links")
    labels = materialise(links.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("label")), "component-labels")
    while True:
        near = links.join(labels, links.b == labels.node).groupBy("a").agg(F.min("label").alias("least"))
        lower = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "least").alias("next"))
        hop = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        moved = materialise(lower.join(hop, "next").select("node", F.col("label").alias("before"), F.least("next", "jump").alias("label")), "component-labels")
        changed = moved.where("label <> before").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("component").agg(F.count("*").alias("n_nodes"))


def name_cascade(probes: DataFrame, names: DataFrame) -> DataFrame:
    """Each probe (probe, name, tradition) resolved to a figure (id, name, tradition).

    Levels in order: the same name and tradition, the same name anywhere, a variant of the
    spelling, a name that begins with a variant and goes on with a blank, a bracket or a
    hyphen. The first level with matches decides: by its only match, else by the smallest of
    those of the probe's tradition; else it is ambiguous. (A name that several figures of one
    tradition share is decided at the first level only if it is the only one.)
    """
    # Figures of the same names and traditions match alike, and so do probes: each kind is matched once.
    forms = lambda df, key: df.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("name", "tradition"))).alias("forms"))
    kinds = forms(names, "id").groupBy("forms").agg(F.min("id").alias("first"), F.count("*").alias("held")).select("first", "held", F.inline("forms"))
    asked = forms(probes, "probe")
    askers = asked.groupBy("forms").agg(F.min("probe").alias("asker"))
    wanting = askers.select("asker", F.inline("forms"))
    own = lambda df, level, key: df.select("first", "held", F.col("tradition").alias("own_tradition"), F.lit(level).alias("level"), key.alias("key"))
    starts = F.transform(F.filter(F.sequence(F.lit(1), F.length("plain")), lambda i: F.substr("plain", i, F.lit(1)).isin(" ", "(", "-")), lambda i: F.substr("plain", F.lit(1), i - 1))
    heads = kinds.withColumn("plain", bare_letters(F.col("name")))
    keys = own(kinds, 2, F.col("name")).union(own(kinds, 3, F.explode(name_variants(F.col("name"))))).union(own(heads, 4, F.explode(F.array_distinct(F.concat(starts, F.array("plain"))))))
    wanted = wanting.select("asker", "tradition", F.lit(2).alias("level"), F.col("name").alias("key"))
    for level in (3, 4):
        wanted = wanted.union(wanting.select("asker", "tradition", F.lit(level).alias("level"), F.explode(name_variants(F.col("name"))).alias("key")))
    hits = wanted.join(keys, ["level", "key"]).select("asker", "level", "first", "held", (F.col("tradition") == F.col("own_tradition")).alias("same")).distinct()
    counted = hits.groupBy("asker", "level").agg(F.sum("held").alias("n"), F.min("first").alias("only"), F.sum(F.when(F.col("same"), F.col("held")).otherwise(0)).alias("n_same"), F.min(F.when(F.col("same"), F.col("first"))).alias("first_same"))
    best = counted.groupBy("asker").agg(F.min_by(F.struct("n", "only", "n_same", "first_same", "level"), "level").alias("b")).select("asker", "b.*")
    best = asked.join(askers.join(best, "asker"), "forms").drop("forms", "asker")
    found = F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("first_same"))
    level = F.when((F.col("level") == 2) & (F.col("n_same") > 0), 1).otherwise(F.col("level"))
    return probes.select("probe").join(best, "probe", "left").select("probe", found.alias("id"), level.alias("level"), (F.coalesce("n", F.lit(0)) > 1).__and__(F.col("first_same").isNull()).alias("ambiguous"))


def identification(targets: DataFrame, names: DataFrame) -> DataFrame:
    """For each (id, tradition, target name) the figure meant: another tradition first, then the smallest id."""
    known = names.select(F.col("id").alias("found"), F.lower("name").alias("key"), F.col("tradition").alias("found_tradition"))
    # Two of each name and tradition are enough, since only the figure itself is left out, and of each name three traditions and the figures without one.
    two = known.withColumn("rn", F.row_number().over(Window.partitionBy("key", "found_tradition").orderBy("found"))).where("rn <= 2")
    own = two.groupBy("key", "found_tradition").agg(F.array_sort(F.collect_list(F.struct("found", "found_tradition"))).alias("own"))
    nearest = Window.partitionBy("key", F.col("found_tradition").isNull()).orderBy(F.col("own")[0]["found"])
    others = own.withColumn("rn", F.row_number().over(nearest)).where("rn <= 3").groupBy("key").agg(F.flatten(F.collect_list("own")).alias("others"))
    met = targets.withColumn("key", F.lower("target")).join(others, "key").join(own.withColumnRenamed("found_tradition", "tradition"), ["key", "tradition"], "left")
    usable = F.filter(F.concat("others", F.coalesce("own", F.array().cast(own.schema["own"].dataType))), lambda x: x["found"] != F.col("id"))
    # A comparison with no tradition comes first, as null does in an order.
    best = F.array_min(F.transform(usable, lambda x: F.struct((x["found_tradition"] == F.col("tradition")).alias("same"), x["found"].alias("found"))))
    return met.withColumn("best", best).where("best IS NOT NULL").groupBy("id", "target").agg(F.min("best")["found"].alias("found"))
