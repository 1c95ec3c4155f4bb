"""Figures and their traits: the long trait relation and the queries that read it.

``figure_traits`` is the hub: one row per (figure, category, token). Pairs of figures come
from an equality join on the trait, never from all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitloom.functions import tokens as tk
from traitloom.sources.scratch import materialise

TRAIT = ["category", "token"]


def figure_traits(figures: DataFrame, id_col: str, text_fields: dict[str, str], array_fields: dict[str, str] | None = None,
                  vocabulary: tk.Vocabulary = tk.Vocabulary(), categories: set[str] | None = None, supersets: dict[str, str] | None = None) -> DataFrame:
    """(figure_id, category, token), distinct: tokens of the text fields and labels of the arrays.

    ``text_fields`` and ``array_fields`` map a column to its category. ``supersets`` maps a
    category to the name under which its super-categories replace its tokens.
    """
    parts: list[Column] = []
    for column, category in text_fields.items():
        if categories is None or category in categories:
            name, found = category, tk.tokenize(F.col(column), vocabulary)
            if supersets and category in supersets:
                name = supersets[category]
                found = _supersets(found, name, vocabulary)
            parts.append(_labelled(found, name))
    for column, category in (array_fields or {}).items():
        if categories is None or category in categories:
            parts.append(_labelled(F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), tk.type_label), category))
    exploded = figures.select(F.col(id_col).alias("figure_id"), F.explode(F.array_distinct(F.concat(*parts))).alias("t"))
    return exploded.select("figure_id", "t.category", "t.token").distinct()


def _labelled(values: Column, category: str) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(category).alias("category"), x.alias("token")))


def _supersets(values: Column, name: str, vocabulary: tk.Vocabulary) -> Column:
    return F.transform(values, lambda x: tk.superset_of(name, x, vocabulary, f"Other {name}"))


def trait_counts(traits: DataFrame) -> DataFrame:
    return traits.groupBy(*TRAIT).agg(F.count("*").alias("n_figures"))


def figure_counts(traits: DataFrame) -> DataFrame:
    return traits.groupBy("figure_id").agg(F.count("*").alias("n_traits"))


def qualified(traits: DataFrame, least: int) -> DataFrame:
    """Figures with at least ``least`` traits."""
    return figure_counts(traits).where(F.col("n_traits") >= least)


def shared_traits(traits: DataFrame, least: int) -> DataFrame:
    return trait_counts(traits).where(F.col("n_figures") >= max(2, least))


def bipartite(traits: DataFrame, least_traits: int, least_figures: int) -> tuple[DataFrame, DataFrame]:
    """Trait nodes with their degree among qualified figures, and (figure, trait) links."""
    chosen = qualified(traits, least_traits).select("figure_id")
    links = traits.join(chosen, "figure_id", "left_semi").join(shared_traits(traits, least_figures).select(*TRAIT), TRAIT, "left_semi")
    degree = links.groupBy(*TRAIT).agg(F.count("*").alias("degree")).where("degree >= 2")
    return degree, links.join(degree.select(*TRAIT), TRAIT, "left_semi")


def cooccurrence(traits: DataFrame, threshold: int) -> DataFrame:
    """(src, dst, weight), src < dst: pairs of figures with at least ``threshold`` common traits.

    Prefix filtering, which is exact: with each figure's traits ranked rarest first, a pair
    sharing t traits shares two of them (one if t is 1) among the first size - t + 2 of both.
    Candidates come from an equality join on such couples; the whole sets then verify them.
    Traits are numbered rarest first, so that rows hold numbers only.
    """
    width = min(2, threshold)
    numbered = materialise(trait_counts(traits).where("n_figures > 1").orderBy("n_figures", *TRAIT).select(*TRAIT, F.monotonically_increasing_id().alias("t")), "trait-numbers")
    ranked = traits.join(numbered, TRAIT).select("figure_id", "t")
    sets = ranked.groupBy("figure_id").agg(F.array_sort(F.collect_list("t")).alias("own")).where(F.size("own") >= threshold)
    sets = sets.withColumn("head", F.slice("own", F.lit(1), F.size("own") - threshold + width))
    if width == 1:
        keys = F.transform("head", lambda x: F.struct(x.alias("x"), x.alias("y")))
    else:
        keys = F.flatten(F.transform("head", lambda x, i: F.transform(F.slice("head", i + 2, F.size("head")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    keyed = sets.select("figure_id", "own", F.explode(keys).alias("key")).select("figure_id", "own", "key.x", "key.y")
    a, b = keyed.alias("a"), keyed.alias("b")
    pairs = a.join(b, (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.figure_id") < F.col("b.figure_id")))
    # A pair is made by each couple that it shares: only that of its rarest common traits counts.
    shared = F.array_intersect("a.own", "b.own")
    common = F.size(shared)
    return pairs.where((common >= threshold) & (F.get(shared, F.lit(0)) == F.col("a.x")) & (F.get(shared, F.lit(width - 1)) == F.col("a.y"))).select(
        F.col("a.figure_id").alias("src"), F.col("b.figure_id").alias("dst"), common.cast("long").alias("weight"))


def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal sets (id, t) as one: classes (id, t), named by their least id, and membership (id, rep).
    """
    members = sets.select("id", F.array_sort("t").alias("t"))
    found = materialise(members.groupBy("t").agg(F.min("id").alias("rep")), "classes")
    return found.select(F.col("rep").alias("id"), "t"), members.join(found, "t").select("id", "rep")


def trait_classes(traits: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Classes of figures with the same traits, at least ``threshold``, and membership."""
    return classes(traits.groupBy(F.col("figure_id").alias("id")).agg(F.collect_list(F.struct(*TRAIT)).alias("t")).where(F.size("t") >= threshold))


def class_cooccurrence(found: DataFrame, threshold: int) -> DataFrame:
    """``cooccurrence`` between the representatives of classes; members of one class share all of their traits."""
    return cooccurrence(found.select(F.col("id").alias("figure_id"), F.inline("t")), threshold)


def cooccurrence_top(traits: DataFrame, threshold: int, most: int) -> DataFrame:
    """The first ``most`` pairs of ``cooccurrence`` by weight, src and dst, without making all of them.

    Pairs of classes are ranked by the first pair of figures of each. Only the first ``most`` of
    them can hold one of the pairs wanted, and of a class only its first ``most`` + 1 figures.
    """
    found, members = trait_classes(traits, threshold)
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    first = materialise(members.withColumn("rn", rank).where(F.col("rn") <= most + 1).drop("rn"), "class-members")
    own = first.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    within = own.where(F.size("ids") > 1).join(found, F.col("rep") == F.col("id")).select("rep", F.col("rep").alias("other"), F.size("t").cast("long").alias("weight"), F.col("ids")[1].alias("next"))
    between = class_cooccurrence(found, threshold).select(F.col("src").alias("rep"), F.col("dst").alias("other"), "weight", F.col("dst").alias("next"))
    best = within.union(between).orderBy(F.col("weight").desc(), "rep", "next").limit(most)
    met = best.join(first.withColumnRenamed("id", "a"), "rep").join(first.select(F.col("rep").alias("other"), F.col("id").alias("b")), "other").where((F.col("rep") != F.col("other")) | (F.col("a") < F.col("b")))
    pairs = met.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "weight")
    return pairs.orderBy(F.col("weight").desc(), "src", "dst").limit(most)


def distances(sets: DataFrame, queries: DataFrame) -> DataFrame:
    """(a, b, distance): the Jaccard distance of each query's set (id, t) to all that share an element with it; all others are at 1."""
    sized = lambda df, name: df.select(F.col("id").alias(name), F.size("t").alias(f"n_{name}"), F.explode("t").alias("x"))
    met = sized(queries, "a").join(sized(sets, "b"), "x").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("k"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    return met.select("a", "b", F.round(1 - F.col("k") / (F.col("n_a") + F.col("n_b") - F.col("k")), 6).alias("distance"))


def ego(traits: DataFrame, focal: int, least: int = 1) -> DataFrame:
    """(figure_id, weight, common) of the figures that share traits with one of them."""
    own = traits.where(F.col("figure_id") == focal).select(*TRAIT)
    shared = traits.where(F.col("figure_id") != focal).join(own, TRAIT, "left_semi")
    return shared.groupBy("figure_id").agg(F.count("*").alias("weight"), F.array_sort(F.collect_list(F.concat_ws("::", *TRAIT))).alias("common")).where(F.col("weight") >= least)


def co_traits(traits: DataFrame, category: str, token: str, least: int = 2) -> DataFrame:
    """Labels that stand with a trait in at least ``least`` figures; a label's first category is kept."""
    holders = traits.where((F.col("category") == category) & (F.col("token") == token)).select("figure_id")
    others = traits.join(holders, "figure_id", "left_semi").where(F.col("token") != token)
    return others.groupBy("token").agg(F.min("category").alias("category"), F.count_distinct("figure_id").alias("n")).where(F.col("n") >= least)


def shared_strength(traits: DataFrame) -> DataFrame:
    """Per figure the sum of (degree - 1) over its traits, also as a share of the greatest."""
    degree = trait_counts(traits)
    summed = traits.join(degree, TRAIT).groupBy("figure_id").agg(F.sum(F.col("n_figures") - 1).alias("shared"))
    top = max(1, summed.agg(F.max("shared")).first()[0] or 0)
    return summed.select("figure_id", "shared", (F.col("shared") / F.lit(top)).alias("strength"))


def facet_filter(traits: DataFrame, facets: dict[str, list[str]]) -> DataFrame:
    """Figures that hold one of the tokens of every category named."""
    wanted = F.lit(False)
    for category, values in facets.items():
        wanted = wanted | ((F.col("category") == category) & F.col("token").isin(*values))
    hit = traits.where(wanted).groupBy("figure_id").agg(F.count_distinct("category").alias("n"))
    return hit.where(F.col("n") == len(facets)).select("figure_id")


def value_pivot(figures: DataFrame, id_col: str, field: str) -> DataFrame:
    """Each value of a delimited field with its occurrences and sorted figure ids."""
    parts = figures.select(F.col(id_col).alias("id"), F.explode(tk.raw_tokens(F.col(field))).alias("value"))
    return parts.groupBy("value").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("id")).alias("ids"))


def singletons(figures: DataFrame, id_col: str, field: str) -> DataFrame:
    """Values that exactly one figure holds."""
    parts = figures.select(F.col(id_col).alias("id"), F.explode(tk.raw_tokens(F.col(field))).alias("value")).distinct()
    return parts.groupBy("value").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")


def two_hops(links: DataFrame, labels: DataFrame, query: str) -> DataFrame:
    """Nodes whose label contains the query, with their neighbours and those neighbours' neighbours.

    ``links`` has (a, b), ``labels`` (node, label).
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = labels.where(F.contains(F.lower("label"), F.lit(query.lower()))).select("node")
    for _ in range(2):
        nearby = both.join(found, both.a == found.node, "left_semi").select(F.col("b").alias("node"))
        found = found.union(nearby).distinct()
    return found


def radial_places(figures: DataFrame, weight: str, ring: str) -> DataFrame:
    """Angle, radius and place of each figure by ring and weight; a drawing surface's worth of rows.

    The ordinal over all rows is summed from counts by ring, so no single task sorts everything.
    """
    sizes = figures.groupBy(ring).agg(F.count("*").alias("ring_n"))
    before = sizes.alias("x").join(sizes.alias("y"), F.col(f"y.{ring}") < F.col(f"x.{ring}"), "left").groupBy(F.col(f"x.{ring}").alias("ring_key")).agg(F.coalesce(F.sum("y.ring_n"), F.lit(0)).alias("before"))
    n, low, high = figures.agg(F.count("*"), F.min(weight), F.max(weight)).first()
    own = F.row_number().over(Window.partitionBy(ring).orderBy(F.col(weight).desc(), "figure_id"))
    placed = figures.withColumn("own", own).join(before, F.col(ring) == F.col("ring_key"))
    angle = 2 * F.pi() * (F.col("before") + F.col("own") - 1) / F.lit(max(1, n))
    share = (F.col(weight) - F.lit(low)) / F.lit(high - low) if n and high > low else F.lit(0.5)
    radius = F.pow(1 - share, 0.85)
    return placed.select("figure_id", angle.alias("angle"), radius.alias("radius"), (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))
