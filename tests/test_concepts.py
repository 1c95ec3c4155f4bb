"""Formal concepts over blocks of bits against sets in plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from traitloom.operators import concepts, taxonomy

ROWS = "figure_id {}, category string, token string"


def brute(traits, least):
    """Extents with their intents: all figures, single traits, and pairwise intersections."""
    figures = frozenset(f for f, own in traits.items() if own)
    extent = defaultdict(set)
    for f, own in traits.items():
        for t in own:
            extent[t].add(f)
    single = {frozenset(e) for e in extent.values() if least <= len(e) < len(figures)}
    every = single | {a & b for a in single for b in single if len(a & b) >= least} | {figures}
    return {e: {f"c::{t}" for t in extent if len(extent[t]) < len(figures) and e <= extent[t]} for e in every}


def read(lattice, names=None):
    members = defaultdict(set)
    for r in lattice.members().collect():
        members[r["concept"]].add(r["at"] if names is None else names[r["at"]])
    return {r["concept"]: frozenset(members[r["concept"]]) for r in lattice.found.collect()}


@pytest.mark.parametrize("spread", [1, 37, -1000])
def test_concepts_covers_and_layers(spark, spread):
    """Ids close together, far apart over many blocks, and below zero; one trait that all have."""
    r = random.Random(5)
    traits = {f * spread: {f"t{k}" for k in range(9) if r.random() < 0.45} | {"all"} for f in range(40)}
    frame = spark.createDataFrame([(f, "c", t) for f, own in traits.items() for t in own], ROWS.format("long"))
    lattice, want = concepts.concepts(frame, 2, 1000), brute(traits, 2)
    name = read(lattice)
    assert {name[x["concept"]]: set(x["intent"]) for x in lattice.found.collect()} == want
    assert all(x["n_extent"] == len(name[x["concept"]]) and x["n_intent"] == len(x["intent"]) for x in lattice.found.collect())
    edges = {(u, v) for u in name for v in name if name[v] < name[u] and not any(name[v] < name[w] < name[u] for w in name)}
    assert {(x["upper"], x["lower"]) for x in concepts.covers(lattice).collect()} == edges
    sizes = sorted({len(i) for i in want.values()})
    by_layer, intents = defaultdict(list), {x["concept"]: x["intent"] for x in lattice.found.collect()}
    for x in concepts.layers(lattice).collect():
        assert x["layer"] == sizes.index(x["n_intent"]) + 1 and x["y"] == pytest.approx((x["layer"] - 1) / max(1, len(sizes) - 1))
        by_layer[x["layer"]].append(x)
    for own in by_layer.values():
        own.sort(key=lambda x: x["place"])
        assert [x["place"] for x in own] == list(range(1, len(own) + 1)) and own == sorted(own, key=lambda x: (-x["n_extent"], intents[x["concept"]]))
        assert [x["x"] for x in own] == pytest.approx([(k + 1) / (len(own) + 1) for k in range(len(own))])


def test_only_the_largest_are_given(spark):
    r = random.Random(6)
    traits = {f: {f"t{k}" for k in range(12) if r.random() < 0.5} for f in range(200)}
    frame = spark.createDataFrame([(f, "c", t) for f, own in traits.items() for t in own], ROWS.format("int"))
    want = sorted(((len(e), len(i)) for e, i in brute(traits, 3).items()), reverse=True)
    for most in (0, 1, 7, 25):
        assert [(x["n_extent"], x["n_intent"]) for x in concepts.concepts(frame, 3, most).found.orderBy(F.desc("n_extent"), F.desc("n_intent")).collect()] == want[:most]


def test_text_ids_and_few_figures(spark):
    frame = spark.createDataFrame([(f"f{i}", "c", t) for i in range(6) for t in ("x", "y") if (t == "x") == (i < 4) or i == 1], ROWS.format("string"))
    found = concepts.concepts(frame, 1, 10)
    assert sorted((x["n_extent"], tuple(x["intent"])) for x in found.found.collect()) == [(1, ("c::x", "c::y")), (3, ("c::y",)), (4, ("c::x",)), (6, ())]
    few = concepts.concepts(frame.where("figure_id < 'f3'"), 1, 10)
    assert few.found.count() == 0 and few.blocks.count() == 0 and concepts.covers(few).count() == 0 and concepts.layers(few).count() == 0


def test_no_row_grows_with_an_extent(spark):
    """A trait of 10^5 figures is some 1600 rows of one long each."""
    frame = spark.range(100_000).select(F.col("id").alias("figure_id"), F.lit("c").alias("category"), F.explode(F.array(F.lit("all"), F.concat(F.lit("m"), F.col("id") % 2), F.concat(F.lit("n"), F.col("id") % 3))).alias("token"))
    blocks = concepts.trait_blocks(frame)
    assert blocks.where("trait = 'c::all'").count() == 1563 and [t for _, t in blocks.dtypes] == ["string", "bigint", "bigint"]
    found = concepts.concepts(frame, 10, 20)
    assert sorted(x["n_extent"] for x in found.found.collect()) == sorted([100_000, 50_000, 50_000, 33_334, 33_333, 33_333, 16_667, 16_667, 16_667, 16_667, 16_666, 16_666])


def test_distinct_members_up_a_deep_tree(spark):
    """Members shared between branches count once above them; text members are numbered, null ones left out."""
    r = random.Random(8)
    parent = {0: None} | {i: r.randrange(max(0, i - 3), i) for i in range(1, 40)}
    for member, kind in ((lambda k: k * 7 - 900, "long"), (lambda k: f"m{k}", "string")):
        own = [(r.randrange(40), member(r.randrange(300))) for _ in range(900)] + [(3, None)]
        tree = spark.createDataFrame([(i, f"n{i}", p) for i, p in parent.items()], "id int, name string, parent_id int")
        got = {x["id"]: x["distinct_count"] for x in taxonomy.distinct_up(tree, spark.createDataFrame(own, f"id int, member {kind}")).collect()}
        below = defaultdict(set)
        for i, m in own:
            while i is not None and m is not None:
                below[i].add(m)
                i = parent[i]
        assert got == {i: len(m) for i, m in below.items()}
