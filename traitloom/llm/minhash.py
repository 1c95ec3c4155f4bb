"""Near-duplicate documents by the Jaccard similarity of their word shingles, and by SimHash.

Texts with equal sets of shingles and equal fingerprints are one class. Each class has BANDS values, each a hash of
ROWS minima of the set under different permutations; classes that agree in a value are
compared: first all of them with the smallest and the greatest of their group, which joins
most of a crowded group, then those that its largest component still lacks with the rest of
the group. So only pairs within one component go uncompared, which can't join more.
A pair of similarity s agrees in a value with probability s^ROWS, so a pair at 0.8
is passed over with probability (1 - 0.8^5)^40 = 1.3e-7, more similar ones with less. The
similarity of the candidates is then counted from their whole sets, and only pairs at or
above the threshold are linked. Fingerprints at most ``max_distance`` bits apart are linked
too, whatever the similarity of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitloom.llm.shared import materialise, row_hash, slices
from traitloom.llm.simhash import SEED, component_roots, first_by_links, hamming_links, majority, shingle_hashes

BANDS, ROWS = 40, 5
#: Shingles permuted at a time, so that the products stay in a core's cache.
PERMUTED_AT_ONCE = 256
_RANDOM = np.random.default_rng(SEED)
FLIP = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
FACTOR = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def distinct_hashes(parts: list[np.ndarray]) -> np.ndarray:
    """The distinct ones of a text's hashes, ascending; no words give none."""
    return np.unique(np.concatenate(parts).astype(np.uint64)) if parts else np.zeros(0, np.uint64)


def shingle_set(text: str | None, shingle_words: int) -> np.ndarray:
    return distinct_hashes(list(shingle_hashes(text, shingle_words)))


def band_values(shingles: np.ndarray) -> list[int]:
    """BANDS signed 64-bit numbers; an empty set has none."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), PERMUTED_AT_ONCE):
        mixed = shingles[None, at : at + PERMUTED_AT_ONCE] ^ FLIP
        mixed *= FACTOR
        np.minimum(least, mixed.min(axis=1), out=least)
    return [xxhash.xxh3_64_intdigest(row.tobytes(), seed=i) - (1 << 63) for i, row in enumerate(least.reshape(BANDS, ROWS))]


def _with_bands(whole: DataFrame, shingle_words: int) -> DataFrame:
    """``doc`` with ``print`` (its fingerprint), ``fp`` (its class), ``n`` (the size of its set) and ``bands``."""
    schema = T.StructType([whole.schema["doc"], *[T.StructField(c, T.LongType()) for c in ("print", "fp", "n")], T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                parts = list(shingle_hashes(text, shingle_words))
                own, fingerprint = distinct_hashes(parts), majority(parts)
                out.append((fingerprint, xxhash.xxh3_64_intdigest(own.tobytes(), seed=fingerprint % (1 << 64)) - (1 << 63), len(own), band_values(own)))
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc", "print", "fp", "n", "bands"])

    return whole.mapInArrow(run, schema)


def _sets(texts: DataFrame, shingle_words: int) -> DataFrame:
    """(fp, shingles) of ``texts`` (fp, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [shingle_set(t, shingle_words).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], names=["fp", "shingles"])

    return texts.mapInArrow(run, T.StructType([T.StructField("fp", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))]))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    left, right = (sets.select(F.col("fp").alias(c), F.col("shingles").alias(f"{c}_set")) for c in ("a", "b"))
    common = F.size(F.array_intersect("a_set", "b_set"))
    similar = (100 + percent) * common >= percent * (F.size("a_set") + F.size("b_set"))
    return pairs.join(left, "a").join(right, "b").where(similar).select("a", "b")


def jaccard_links(classes: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of ``classes`` (fp, n, bands) whose sets are at least ``percent`` similar.

    They join the same classes, directly or through others, as all such pairs would.
    ``texts`` (fp, text) has one text of each class.
    """
    entries = classes.select("fp", "n", F.explode("bands").alias("value"))
    groups = entries.groupBy("value").agg(F.count("*").alias("k"), *[f(F.struct("fp", "n")).alias(c) for f, c in ((F.min, "least"), (F.max, "most"))]).where("k > 1")
    met = materialise(entries.join(groups.drop("k"), "value"), "met")
    wanted = met.select("fp").distinct()
    sets = materialise(_sets(texts.join(wanted, "fp", "left_semi"), shingle_words), "sets")

    def pairs(found: DataFrame, a: str, b: str) -> DataFrame:
        """Distinct pairs of unlike ones; sets so similar cannot differ more in size."""
        sized = 100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n")
        return found.where((F.col(f"{a}.fp") != F.col(f"{b}.fp")) & sized).select(F.least(f"{a}.fp", f"{b}.fp").alias("a"), F.greatest(f"{a}.fp", f"{b}.fp").alias("b"))

    own = met.select(F.struct("fp", "n").alias("own"), "least", "most")
    ends = materialise(_verified(pairs(own, "own", "least").union(pairs(own, "own", "most")).distinct(), sets, percent), "ends")
    roots = component_roots(ends)
    rooted = materialise(met.join(roots, met.fp == roots.node, "left").select("value", "fp", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    counted = rooted.groupBy("value", "root").agg(F.count("*").alias("k"))
    largest = counted.groupBy("value").agg(F.max_by("root", F.struct("k", "root")).alias("largest"), F.count("*").alias("roots")).where("roots > 1")
    split = rooted.join(largest, "value")
    apart = split.where("root <> largest").select("value", "root", F.struct("fp", "n").alias("own"))
    others = split.select(F.col("value").alias("v"), F.col("root").alias("r"), F.struct("fp", "n").alias("other"))
    rest = pairs(apart.join(others, (F.col("value") == F.col("v")) & (F.col("root") != F.col("r"))), "own", "other").distinct()
    return ends.union(_verified(rest, sets, percent))


def fingerprint_links(classes: DataFrame, max_distance: int, segments: int | None = None) -> DataFrame:
    """Pairs (a, b) that join ``classes`` (fp, print) whose fingerprints are equal or close.

    Of the classes with equal fingerprints the smallest stands for all.
    """
    chosen = materialise(classes.groupBy("print").agg(F.min("fp").alias("chosen")), "prints")
    equal = classes.join(chosen, "print").where("fp <> chosen").select(F.col("chosen").alias("a"), F.col("fp").alias("b"))
    left, right = (chosen.select(F.col("print").alias(c), F.col("chosen").alias(f"{c}_class")) for c in ("a", "b"))
    close = hamming_links(chosen.select(F.col("print").alias("fp")), max_distance, segments).join(left, "a").join(right, "b")
    return equal.union(close.select(F.least("a_class", "b_class"), F.greatest("a_class", "b_class")))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80,
                 max_distance: int = 5, segments: int | None = None) -> DataFrame:
    """``docs`` with one row of each component of linked texts: that with the smallest id.

    Rows whose id is null come after all others; of rows with equal ids that whose columns
    have the smallest hash stays. Documents without words, null ones too, are equal, so one of
    them stays. A very long text is one row's work and its shingles' hashes are held at once.
    Columns of ``docs`` may bear any name. No rows give no rows.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    prints = materialise(_with_bands(whole, shingle_words).withColumn("row_id", F.monotonically_increasing_id()).withColumn("row_hash", row_hash("doc", docs.schema)), "banded")
    key = F.struct(F.col(f"doc.`{id_col}`").isNull().alias("no_id"), F.col(f"doc.`{id_col}`").alias("id"), "row_hash", "row_id")
    classes = materialise(prints.groupBy("fp").agg(F.min(key).alias("own"), *[F.first(c).alias(c) for c in ("print", "n", "bands")]), "classes")
    first_rows = classes.select(F.col("own.row_id").alias("row_id"))
    texts = prints.select("row_id", "fp", F.col(f"doc.`{text_col}`").alias("text")).join(first_rows, "row_id", "left_semi").select("fp", "text")
    links = jaccard_links(classes, texts, shingle_words, percent).union(fingerprint_links(classes, max_distance, segments)).distinct()
    first = first_by_links(classes.select("fp", "own"), links)
    stay = first.select(F.col("first.row_id").alias("row_id")).distinct()
    return prints.join(stay, "row_id", "left_semi").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
