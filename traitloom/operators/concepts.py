"""Formal concepts of figures and traits, their cover edges and layers, over blocks of bits.

An extent, the figures that hold a trait, is never one value: it is rows of 64 figures each
(a block's number and a long with a bit for each figure), so what a row holds is bounded
however many figures a trait has. Extents meet, are contained in each other and are counted
block by block; equal extents have equal fingerprints, the xor of two hashes of each block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitloom.operators.bitsets import member_blocks
from traitloom.sources.scratch import materialise

#: Fewer figures have no concepts worth a picture.
LEAST_FIGURES = 4


@dataclass
class Lattice:
    """``found``: (concept, n_extent, n_intent, intent), a picture's number of rows; ``blocks``: (concept, block, bits), their extents."""

    found: DataFrame
    blocks: DataFrame

    def members(self) -> DataFrame:
        """(concept, at): the numbers of the figures of each concept, a row for each."""
        bit = F.explode(F.sequence(F.lit(0), F.lit(63)))
        return self.blocks.select("concept", "block", "bits", bit.alias("bit")).where("getbit(bits, bit) = 1").select("concept", (F.col("block") * 64 + F.col("bit")).alias("at"))


def _print() -> list[Column]:
    """Size, number of blocks and fingerprint of the extent whose rows (block, bits) are grouped."""
    xor = [F.bit_xor(h) for h in (F.xxhash64("block", "bits"), F.xxhash64(F.lit("second"), "block", "bits"))]
    return [F.sum(F.bit_count("bits")).alias("n"), F.count("*").alias("n_blocks"), F.concat(*[F.lpad(F.hex(x), 16, "0") for x in xor]).alias("print")]


def trait_blocks(traits: DataFrame) -> DataFrame:
    """(trait, block, bits) of traits (figure_id, category, token); figures whose ids are no whole numbers are numbered."""
    named = traits.where("token IS NOT NULL").select("figure_id", F.concat_ws("::", "category", "token").alias("trait"))
    return member_blocks(named, ["trait"], "figure_id")


def concepts(traits: DataFrame, least_support: int, most: int) -> Lattice:
    """The ``most`` largest concepts by extent, then size of intent, then intent, which is unlike for each.

    Extents are that of all figures, those of traits that ``least_support`` figures hold but not
    all, and one round of pairwise intersections of these. An intent has all traits that
    its whole extent holds, but for those that every figure has. Seeds are cut by size to six for each
    concept asked for, and at least 400, as this is a picture of bounded size.
    """
    blocks = materialise(trait_blocks(traits), "trait-blocks")
    everyone = blocks.groupBy("block").agg(F.bit_or("bits").alias("bits"))
    whole = everyone.agg(*_print()).first()
    total = whole["n"] or 0
    sizes = blocks.groupBy("trait").agg(*_print())
    usable = sizes.where(F.col("n").between(least_support, total - 1) & F.lit(total >= LEAST_FIGURES))
    seeds = usable.groupBy("print").agg(F.min("trait").alias("trait"), F.first("n").alias("n"), F.first("n_blocks").alias("n_blocks")).orderBy(F.col("n").desc(), "print").limit(max(6 * most, 400))
    # The seeds are at most a few for each concept asked for, so their names may go to all tasks.
    placed = materialise(blocks.join(F.broadcast(seeds.select("trait", F.col("print").alias("seed"))), "trait").select("seed", "block", "bits"), "seed-blocks")

    def met(pairs: DataFrame | None = None) -> DataFrame:
        """(s, t, block, bits): what two seeds have in common, of all pairs or of those given."""
        a, b = placed.select(F.col("seed").alias("s"), "block", F.col("bits").alias("own")), placed.select(F.col("seed").alias("t"), F.col("block").alias("at"), F.col("bits").alias("other"))
        if pairs is not None:
            a = a.join(F.broadcast(pairs), "s").select("s", F.col("t").alias("wanted"), "block", "own", "print")
        on = (F.col("block") == F.col("at")) & (F.col("own").bitwiseAND(F.col("other")) != 0)
        both = a.join(b, on & ((F.col("s") < F.col("t")) if pairs is None else F.col("wanted") == F.col("t")))
        return both.select(*(["print"] if pairs is not None else ["s", "t"]), "block", F.col("own").bitwiseAND(F.col("other")).alias("bits"))

    crossed = met().groupBy("s", "t").agg(*_print()).where(F.col("n") >= least_support)
    fresh = crossed.groupBy("print").agg(F.min(F.struct("s", "t")).alias("of"), F.first("n").alias("n"), F.first("n_blocks").alias("n_blocks")).join(seeds.select("print"), "print", "left_anti")
    every = materialise(seeds.select("print", "n", "n_blocks", F.lit(None).cast("string").alias("s"), F.lit(None).cast("string").alias("t")).union(fresh.select("print", "n", "n_blocks", "of.s", "of.t")), "extents")
    # Concepts go by size of extent first, so smaller ones than the last asked for need no intent.
    least = every.orderBy(F.col("n").desc()).limit(max(0, most - 1)).agg(F.min("n")).first()[0] if most > 1 else None
    wanted = every.where(F.col("n") >= F.lit(least)) if least is not None else every.limit(0)
    own = placed.join(F.broadcast(wanted.where("s IS NULL").select(F.col("print").alias("seed"))), "seed").select(F.col("seed").alias("print"), "block", "bits")
    extents = materialise(own.union(met(wanted.where("s IS NOT NULL").select("s", "t", "print"))), "extent-blocks")
    open_traits = blocks.join(F.broadcast(sizes.where(F.col("n") < total).select("trait")), "trait").select("trait", F.col("block").alias("at"), F.col("bits").alias("held"))
    inside = extents.join(open_traits, (F.col("block") == F.col("at")) & (F.col("bits").bitwiseAND(F.bitwise_not("held")) == 0)).groupBy("print", "trait").agg(F.count("*").alias("k"))
    intents = inside.join(F.broadcast(wanted.select("print", "n", "n_blocks")), "print").where("k = n_blocks").groupBy("print").agg(F.max("n").alias("n_extent"), F.array_sort(F.collect_list("trait")).alias("intent"))
    spark = traits.sparkSession
    top = spark.createDataFrame([(whole["print"], total, [])] if total >= LEAST_FIGURES and most else [], "print string, n_extent long, intent array<string>")
    ranked = top.union(intents.select("print", "n_extent", "intent")).withColumn("n_intent", F.size("intent")).orderBy(F.col("n_extent").desc(), F.col("n_intent").desc(), "intent").limit(most)
    found = materialise(ranked.select(F.substring("print", 1, 12).alias("concept"), "print", "n_extent", "n_intent", "intent"), "concepts")
    chosen = F.broadcast(found.select("concept", "print"))
    everyone = everyone.select(F.lit(whole["print"]).alias("print"), "block", "bits")
    return Lattice(found.drop("print"), extents.union(everyone).join(chosen, "print").select("concept", "block", "bits"))


def covers(lattice: Lattice) -> DataFrame:
    """(upper, lower): strict containment of extents with nothing between."""
    sized = lattice.blocks.join(F.broadcast(lattice.found.select("concept", "n_extent")), "concept")
    a = sized.select(F.col("concept").alias("upper"), F.col("block").alias("at"), F.col("bits").alias("held"), F.col("n_extent").alias("n_upper"))
    b = sized.select(F.col("concept").alias("lower"), "block", "bits", F.col("n_extent").alias("n_lower"))
    counts = lattice.blocks.groupBy(F.col("concept").alias("lower")).agg(F.count("*").alias("n_blocks"))
    inside = b.join(a, (F.col("block") == F.col("at")) & (F.col("n_upper") > F.col("n_lower")) & (F.col("bits").bitwiseAND(F.bitwise_not("held")) == 0)).groupBy("upper", "lower").agg(F.count("*").alias("k"))
    below = materialise(inside.join(counts, "lower").where("k = n_blocks").select("upper", "lower"), "below")
    between = below.alias("x").join(below.alias("y"), F.col("x.lower") == F.col("y.upper")).select(F.col("x.upper").alias("upper"), F.col("y.lower").alias("lower")).distinct()
    return below.join(between, ["upper", "lower"], "left_anti")


def layers(lattice: Lattice) -> DataFrame:
    """Each concept's place (x, y) from 0 to 1: layers by size of intent, and in a layer the largest extent first.

    The concepts are as many as a picture shows, so one task may order them.
    """
    layer = F.dense_rank().over(Window.orderBy("n_intent"))
    place = Window.partitionBy("layer").orderBy(F.col("n_extent").desc(), "intent")
    placed = lattice.found.select("concept", "intent", "n_extent", "n_intent", layer.alias("layer")).withColumn("place", F.row_number().over(place))
    width, last = F.count("*").over(Window.partitionBy("layer")), F.max("layer").over(Window.partitionBy())
    return placed.select("concept", "intent", "n_extent", "n_intent", "layer", "place", (F.col("place") / (width + 1)).alias("x"), ((F.col("layer") - 1) / F.greatest(F.lit(1), last - 1)).alias("y"))
