"""Dealing out by ranges against the rule taken one member after another."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from traitloom.operators import dealing, lattice


def follow(kinds, d):
    for k in kinds:
        d += 1 if k > 0 or (k == 0 and d <= 0) else -1
    return d


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([1, 0, 0, -1]), max_size=40), st.integers(-12, 12), st.integers(0, 12))
def test_the_function_of_a_range(kinds, low, width):
    """Every start's end is what the entries say."""
    starts = dealing.Starts(low, low + 2 * width)
    for k in kinds:
        starts.step(k)
    entries = starts.entries()
    for d in range(low, low + 2 * width + 1, 2):
        start, end, flat = [e for e in entries if e[0] <= d][-1]
        assert (end if flat else end + d - start) == follow(kinds, d)
    assert len(entries) <= 2 * sum(k == 0 for k in kinds) + 2


@pytest.fixture
def apart(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("weights", [(1, 1, 1), (6, 3, 1), (1, 2, 8), (9, 1, 0), (0, 1, 0), "waves"])
def test_many_members_in_many_ranges(spark, apart, weights):
    """Balanced, lopsided and drifting orders of 10^5 members: sides as by the sequential rule."""
    r = random.Random(str(weights))
    if weights == "waves":
        kinds = [r.choices([1, 0, -1], [8, 1, 2] if i // 9000 % 2 else [2, 1, 8])[0] for i in range(100_000)]
    else:
        kinds = r.choices([1, 0, -1], weights, k=100_000)
    frame = spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "id long, k int").repartition(5)
    got = {x["id"]: x["side"] for x in dealing.dealt(frame, "id", F.col("k") >= 0, F.col("k") <= 0).collect()}
    d, want = 0, {}
    for i, k in enumerate(kinds):
        left = k > 0 or (k == 0 and d <= 0)
        d += 1 if left else -1
        want[i] = "L" if left else "R"
    assert got == want


def test_no_members_and_text_keys(spark):
    rows = spark.createDataFrame([("a", True, True), ("b", True, True), ("c", False, True)], "name string, l boolean, r boolean")
    assert {x["name"]: x["side"] for x in dealing.dealt(rows, "name", F.col("l"), F.col("r")).collect()} == {"a": "L", "b": "R", "c": "R"}
    assert dealing.dealt(rows.limit(0), "name", F.col("l"), F.col("r")).collect() == []


def _times_made(spark, work):
    """How often a relation of traits is worked out while ``work`` uses it."""
    seen = spark.sparkContext.accumulator(0)
    rows = [(i, "k", f"t{j}") for i in range(40) for j in range(6) if (i * (j + 3)) % 7 < 3]

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    work(spark.createDataFrame(rows, "figure_id long, category string, token string").mapInArrow(counted, "figure_id long, category string, token string"))
    return seen.value / len(rows)


def test_traits_are_made_once_for_a_dichotomy(spark):
    assert _times_made(spark, lambda t: lattice.dichotomy(t, depth=2)) == 1


def test_traits_are_made_once_for_leaves(spark):
    assert _times_made(spark, lambda t: lattice.leaves(t, depth=2).count()) == 1


def test_traits_are_made_once_for_correspondence(spark):
    assert _times_made(spark, lambda t: lattice.correspondence(t)[0].count()) == 1
