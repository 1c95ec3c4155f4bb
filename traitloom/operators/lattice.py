"""Dichotomies, nearest vectors and correspondence analysis of traits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitloom.operators import traits as tr
from traitloom.operators.dealing import dealt
from traitloom.sources.scratch import materialise


def best_split(traits: DataFrame, exclusion: float = 0.8, coverage: float = 0.1, least_figures: int = 3, top: int = 40):
    """The pair of traits that best divides the figures, as a Row (left, right, score), or None.

    Of the ``top`` traits by count, pairs rarely held together are scored by coverage and
    balance; the earlier pair wins a tie.
    """
    n = traits.select("figure_id").distinct().count()
    named = traits.where("token IS NOT NULL").withColumn("trait", F.concat_ws("::", "category", "token"))
    if not n:
        return None
    order = Window.orderBy(F.col("k").desc(), "trait")
    counted = named.groupBy("trait").agg(F.count("*").alias("k")).where(F.col("k") >= least_figures).orderBy(F.col("k").desc(), "trait").limit(top).withColumn("rank", F.row_number().over(order))
    # Figures that hold the same of these traits count together, so pairs are made of few rows.
    held = named.join(F.broadcast(counted), "trait").groupBy("figure_id").agg(F.sort_array(F.collect_list("rank")).alias("ranks")).groupBy("ranks").agg(F.count("*").alias("n"))
    each = held.select("ranks", "n", F.explode("ranks").alias("ra"))
    both = each.select("n", "ra", F.explode("ranks").alias("rb")).where("ra < rb").groupBy("ra", "rb").agg(F.sum("n").alias("both"))
    x, y = counted.alias("x"), counted.alias("y")
    pairs = x.join(y, F.col("x.rank") < F.col("y.rank")).select(F.col("x.trait").alias("left"), F.col("y.trait").alias("right"), F.col("x.k").alias("ka"), F.col("y.k").alias("kb"), F.col("x.rank").alias("ra"), F.col("y.rank").alias("rb"))
    stats = pairs.join(both, ["ra", "rb"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    union = F.col("ka") + F.col("kb") - F.col("both")
    scored = stats.select("left", "right", "ra", "rb", (1 - F.col("both") / F.least("ka", "kb")).alias("exclusive"), (union / F.lit(n)).alias("covered"), (F.least("ka", "kb") / F.greatest("ka", "kb")).alias("balance"))
    good = scored.where((F.col("exclusive") >= exclusion) & (F.col("covered") >= coverage)).withColumn("score", F.pow("covered", 2) * 10 + F.col("balance") * 0.2)
    return good.orderBy(F.col("score").desc(), "ra", "rb").select("left", "right", "score").first()


def divided(own: DataFrame, left: str, right: str) -> DataFrame:
    """(figure_id, side) of the figures that hold one of two traits; those with both go, in the order of their ids, to the side that is smaller so far, left if equal.

    No task sees all figures: ranges of ids are summarised by what they do to the difference of the sides.
    """
    label = F.concat_ws("::", "category", "token")
    held = own.where(label.isin(left, right)).groupBy("figure_id").agg(F.bool_or(label == left).alias("l"), F.bool_or(label == right).alias("r"))
    return dealt(held, "figure_id", F.col("l"), F.col("r"))


def dichotomy(traits: DataFrame, depth: int = 3, least_group: int = 4) -> list[dict]:
    """A tree of splits as rows (path, left, right, score); figures with neither trait are dropped, used traits are not used again below.

    The tree is small: depth bounds the number of splits, and each is a few aggregations.
    """
    return [{k: v for k, v in r.items() if k != "sides"} for r in _grown(traits, depth, least_group)]


def _grown(traits: DataFrame, depth: int, least_group: int) -> list[dict]:
    out: list[dict] = []

    def grow(own: DataFrame, path: str, level: int) -> None:
        if level >= depth or own.select("figure_id").distinct().limit(least_group).count() < least_group:
            return
        split = best_split(own)
        if split is None:
            return
        sides = materialise(divided(own, split["left"], split["right"]), "sides")
        out.append({"path": path or "root", "left": split["left"], "right": split["right"], "score": split["score"], "sides": sides})
        rest = own.where(~F.concat_ws("::", "category", "token").isin(split["left"], split["right"]))
        for side in "LR":
            # A figure that has no other trait counts for the size of its group, though no trait of it can split the group.
            members = sides.where(F.col("side") == side).select("figure_id")
            bare = members.join(rest.select("figure_id").distinct(), "figure_id", "left_anti").select("figure_id", F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("token"))
            grow(materialise(rest.join(members, "figure_id", "left_semi").select("figure_id", *tr.TRAIT).union(bare), "group"), path + side, level + 1)

    grow(materialise(traits.select("figure_id", *tr.TRAIT), "traits"), "", 0)
    return out


def leaves(traits: DataFrame, depth: int = 3, least_group: int = 4) -> DataFrame:
    """(path, trait, figure_id): the groups of a dichotomy that are not split further, with the trait that names each."""
    rows = _grown(traits, depth, least_group)
    inner = {r["path"] for r in rows}
    parts = [r["sides"].where(F.col("side") == side).select(F.lit(path).alias("path"), F.lit(r[name]).alias("trait"), "figure_id")
             for r in rows for side, name in (("L", "left"), ("R", "right")) if (path := ("" if r["path"] == "root" else r["path"]) + side) not in inner]
    return reduce(DataFrame.union, parts) if parts else traits.select(F.lit("").alias("path"), F.lit("").alias("trait"), "figure_id").limit(0)


#: The relative change of the axes' inertia in a step below which they have settled.
SETTLED = 1e-7


def _principal(gram: DataFrame, masses: DataFrame, axes: int, rounds: int = 200):
    """The leading eigenvalues and eigenvectors, by trait number ``j``, of the standardised table's products.

    ``gram`` has (i, j, v), ``masses`` (j, c). Orthogonal iteration: a step is a join with the
    table of products and a sum; only products of the axes themselves reach the driver. A few
    more axes than asked for are carried along, which makes the others settle sooner. Axes that
    have not settled after ``rounds`` steps are an error, never a result.
    """
    root = masses.select("j", F.sqrt("c").alias("s"))
    names = [f"v{k}" for k in range(axes + 5)]
    rows = materialise(root.select("j", "s", *[(F.rand(k) - 0.5).alias(n) for k, n in enumerate(names)]), "axes")
    cells = materialise(gram.join(root.select(F.col("j").alias("i"), F.col("s").alias("si")), "i").join(root, "j").select("i", "j", (F.col("v") / (F.col("si") * F.col("s"))).alias("v")), "products")
    values = None
    for _ in range(rounds):
        sums = rows.agg(*[F.sum(F.col("s") * F.col(n)).alias(n) for n in names]).first()
        made = cells.join(rows, "j").groupBy("i").agg(*[F.sum(F.col("v") * F.col(n)).alias(n) for n in names])
        moved = materialise(root.join(made, F.col("j") == F.col("i"), "left").select("j", "s", *[(F.coalesce(n, F.lit(0.0)) - F.col("s") * F.lit(float(sums[n] or 0.0))).alias(n) for n in names]), "axes")
        inner = moved.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in names for b in names]).first()
        cross = np.array([[inner[f"{a}_{b}"] or 0.0 for b in names] for a in names])
        found, turn = np.linalg.eigh(cross)
        order = np.argsort(-found)
        found, turn = np.sqrt(np.maximum(found[order], 0)), turn[:, order]
        scale = turn / np.where(found > 1e-15, found, 1.0)
        rows = moved.select("j", "s", *[sum((F.col(a) * F.lit(float(scale[i, k])) for i, a in enumerate(names)), F.lit(0.0)).alias(n) for k, n in enumerate(names)])
        settled = values is not None and np.allclose(values[:axes], found[:axes], rtol=SETTLED, atol=1e-14)
        values = found
        if settled:
            return values[:axes], rows.select("j", "s", *names[:axes])
    raise RuntimeError(f"the axes have not settled after {rounds} rounds")


def correspondence(traits: DataFrame, axes: int = 5, least_figures: int = 1, driver_traits: int = 1000):
    """Correspondence analysis of the indicator table: (figure coordinates, axes' inertia).

    Traits of fewer than ``least_figures`` figures are left out; a figure that holds no other
    has null coordinates. The trait-by-trait products are a table. That of at most
    ``driver_traits`` traits is decomposed on the driver, a larger one by iteration over the
    table: the same axes, up to convergence. Signs are settled by the entry of largest size.
    """
    # Written once: counts, cells and figures all read it.
    traits = materialise(traits, "ca-traits-of-figures")
    counted = tr.trait_counts(traits).where(F.col("n_figures") >= least_figures)
    index = materialise(counted.orderBy(F.col("n_figures").desc(), *tr.TRAIT).select(*tr.TRAIT, "n_figures", F.monotonically_increasing_id().alias("j")), "ca-traits")
    m, total = index.agg(F.count("*"), F.sum("n_figures")).first()
    if not m:
        return None, []
    cell = materialise(traits.join(index, tr.TRAIT).select("figure_id", "j", F.count("*").over(Window.partitionBy("figure_id")).alias("mass")), "ca-cells")
    gram = materialise(cell.alias("a").join(cell.alias("b"), "figure_id").groupBy(F.col("a.j").alias("i"), F.col("b.j").alias("j")).agg((F.sum(1 / F.col("a.mass")) / F.lit(total)).alias("v")), "ca-products")
    masses = index.select("j", (F.col("n_figures") / F.lit(total)).alias("c"))
    names = [f"v{k}" for k in range(axes)]
    if m <= driver_traits:
        own = masses.orderBy("j").collect()
        at, c = {r["j"]: k for k, r in enumerate(own)}, np.array([r["c"] for r in own])
        products = np.zeros((m, m))
        for r in gram.collect():
            products[at[r["i"]], at[r["j"]]] = r["v"]
        found, vectors = np.linalg.eigh(products / np.sqrt(np.outer(c, c)) - np.sqrt(np.outer(c, c)))
        order = np.argsort(-found)[:axes]
        values = np.maximum(found[order], 0)
        rows = traits.sparkSession.createDataFrame([(r["j"], float(np.sqrt(r["c"])), *map(float, vectors[k, order])) for k, r in enumerate(own)], "j long, s double" + "".join(f", {n} double" for n in names[: len(order)]))
        names = names[: len(order)]
    else:
        values, rows = _principal(gram, masses, axes)
    largest = rows.agg(*[F.max_by(n, F.struct(F.round(F.abs(n), 9), -F.col("j"))).alias(n) for n in names]).first()
    weights = rows.select("j", *[(F.col(n) * F.lit(-1.0 if (largest[n] or 0) < 0 else 1.0) / F.col("s")).alias(n) for n in names])
    placed = cell.join(weights, "j").groupBy("figure_id").agg(*[(F.sum(n) / F.max("mass")).alias(f"axis_{k + 1}") for k, n in enumerate(names)])
    return traits.select("figure_id").distinct().join(placed, "figure_id", "left"), [float(v) for v in values]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """The k nearest vectors (vec_id, embedding) of each query by cosine distance, itself left out.

    Queries are searched in blocks of bounded size, each by a pass over the vectors that
    multiplies batches with the block. A task gives out only what is as near as the k best it
    has seen for a query; the best of all tasks are ranked. Vectors without length are left out.
    """
    spark = vectors.sparkSession
    usable = lambda df: df.where(F.exists("embedding", lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = materialise(usable(queries).withColumn("block", F.floor((F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")) - 1) / F.lit(max(1, block // 64)))), "queries")
    found = []
    for r in asked.select("block").distinct().orderBy("block").collect():
        own = asked.where(F.col("block") == r["block"]).select("vec_id", "embedding").toPandas()
        ids, q = own["vec_id"].to_numpy(np.int64), np.stack(own["embedding"].to_numpy())
        shared = spark.sparkContext.broadcast((ids, q, np.sqrt((q * q).sum(axis=1))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, q_norm = shared.value
            bound = np.full(len(ids), np.inf)
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    own, v = part.column(0).to_numpy(), np.stack(part.column(1).to_numpy(zero_copy_only=False))
                    distance = np.round(1 - v @ q.T / (np.sqrt((v * v).sum(axis=1))[:, None] * q_norm), 9)
                    distance[own[:, None] == ids] = np.inf
                    if len(own) > k:
                        bound = np.minimum(bound, np.partition(distance, k - 1, axis=0)[k - 1])
                    i, j = np.nonzero((distance <= bound) & np.isfinite(distance))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(own[i]), pa.array(distance[i, j])], names=["query_id", "vec_id", "distance"])

        found.append(usable(vectors).mapInArrow(run, "query_id long, vec_id long, distance double"))
    if not found:
        return spark.createDataFrame([], "query_id long, vec_id long, distance double, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return reduce(DataFrame.union, found).withColumn("rank", rank).where(F.col("rank") <= k)
