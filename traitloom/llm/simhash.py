"""Near-duplicate documents by SimHash and multi-index hashing.

A fingerprint has 64 bits: bit i is set if it is set in more than half of the hashes of a
text's word shingles. Fingerprints at most ``max_distance`` bits apart are linked.

Search: the 64 bits are cut into ``segments``. Two fingerprints that differ in at most
r = m*a + b bits (b < m) agree up to a bits in one of the first b + 1 segments, or up to
a - 1 bits in one of the others. So the values in a small Hamming ball around each segment
are looked up in a table of (segment, value), and the whole distance is verified inside the
join. Only one direction of each pair is enumerated: a probe that flips bits must have a
zero at its lowest flipped bit, where its partner has a one.

How many segments there are follows from the number of fingerprints: few, wide ones make
many probes, many narrow ones many candidates for each.

Equal fingerprints are one class, so copies never make pairs; the search runs over distinct
fingerprints and the shuffle join splits crowded segment values (AQE skew join).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitloom.llm.shared import materialise, row_hash

BITS = 64
SEED = 42
#: Shingles hashed at a time, so that a very long text needs little memory.
HASHES_AT_ONCE = 1 << 15


def shingle_spans(text: str | None, shingle_words: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text joined by spaces, and where in it each shingle starts and ends.

    A text of fewer words is one shingle; no words give none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) >= shingle_words:
        starts, ends = starts[: len(words) - shingle_words + 1], ends[shingle_words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return line, starts, ends


def shingle_hashes(text: str | None, shingle_words: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, in parts."""
    line, starts, ends = shingle_spans(text, shingle_words)
    for at in range(0, len(starts), HASHES_AT_ONCE):
        spans = map(slice, starts[at : at + HASHES_AT_ONCE].tolist(), ends[at : at + HASHES_AT_ONCE].tolist())
        yield np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, spans), repeat(SEED)), ">u8")


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits set in more than half of all hashes, as a signed number; no hashes give zero."""
    counts, total = np.zeros(BITS, np.int64), 0
    for hashes in parts:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(hashes)
    bits = np.packbits((2 * counts > total).astype(np.uint8))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprint(text: str | None, shingle_words: int) -> int:
    """The fingerprint of one text as a signed 64-bit number; no words give zero."""
    return majority(shingle_hashes(text, shingle_words))


def with_fingerprints(docs: DataFrame, text_col: str, shingle_words: int, keep: dict[str, Column]) -> DataFrame:
    """The columns ``keep`` and ``fp``, a 64-bit fingerprint as a long."""
    picked = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(f"`{text_col}`").alias("__text"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField("fp", T.LongType())])
    names = [*keep, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t, shingle_words) for t in batch.column(len(names) - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fps], names=names)

    return picked.mapInArrow(run, schema)


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment, widest first."""
    widths = [BITS // segments + (i < BITS % segments) for i in range(segments)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def segment_radii(max_distance: int, segments: int) -> list[int]:
    """The radius to search in each segment; -1 where none is needed."""
    a, b = divmod(max_distance, segments)
    return [a if i <= b else a - 1 for i in range(segments)]


def segments_for(count: int, max_distance: int) -> int:
    """The number of segments, two or more, with the least probes and candidates for each of ``count`` fingerprints."""
    def work(segments: int) -> float:
        return sum(sum(comb(width, k) for k in range(radius + 1)) * (1 + count / 2**width)
                   for (_, width), radius in zip(segment_bounds(segments), segment_radii(max_distance, segments), strict=True))

    return min(range(2, max(2, max_distance + 1) + 1), key=work)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _flips(shift: int, width: int, radius: int) -> Column:
    """An array of the bit masks of a segment's Hamming ball, with their lowest bits."""
    masks = chain.from_iterable(combinations(range(shift, shift + width), k) for k in range(radius + 1))
    rows = [(_signed(sum(1 << i for i in m)), _signed(1 << min(m)) if m else 0) for m in masks]
    literal = lambda x: f"{x}L" if x != -(1 << 63) else "(-9223372036854775807L - 1L)"
    return F.expr("array(" + ", ".join(f"named_struct('mask', {literal(m)}, 'low', {literal(b)})" for m, b in rows) + ")")


def _entry(segment: int, shift: int, width: int, fp: Column) -> Column:
    value = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    return F.struct(F.lit(segment).alias("segment"), value.alias("value"))


def _probes(segment: int, shift: int, width: int, radius: int) -> Column:
    """The segment's values to look up for ``fp``: its own and those in the ball around it."""
    fp = F.col("fp")
    flips = F.filter(_flips(shift, width, radius), lambda f: (f["mask"] == 0) | (fp.bitwiseAND(f["low"]) == 0))
    return F.transform(flips, lambda f: F.struct(
        _entry(segment, shift, width, fp.bitwiseXOR(f["mask"])).alias("at"), (f["mask"] != 0).alias("flipped")))


def hamming_links(fps: DataFrame, max_distance: int, segments: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct values of ``fps.fp`` at most ``max_distance`` bits apart."""
    segments = segments or segments_for(fps.count(), max_distance)
    probes, entries = [], []
    for i, ((shift, width), radius) in enumerate(zip(segment_bounds(segments), segment_radii(max_distance, segments), strict=True)):
        if radius >= 0:
            probes.append(_probes(i, shift, width, radius))
            entries.append(_entry(i, shift, width, F.col("fp")))
    probe = fps.select("fp", F.explode(F.concat(*probes)).alias("p")).select(F.col("fp").alias("a"), "p.at.segment", "p.at.value", "p.flipped")
    entry = fps.select("fp", F.explode(F.array(*entries)).alias("e")).select(F.col("fp").alias("b"), "e.segment", "e.value")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    hits = probe.join(entry, (probe.segment == entry.segment) & (probe.value == entry.value) & near & (F.col("flipped") | (F.col("a") < F.col("b"))))
    return hits.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def component_roots(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node but the roots; a root is its component's smallest node.

    Alternates large-star and small-star steps, each a minimum by node and a join, so no
    node's neighbours are ever gathered. Only a count and a checksum reach the driver.
    """
    def neighbours(edges: DataFrame) -> DataFrame:
        return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(edges: DataFrame, large: bool) -> DataFrame:
        """To the smallest of a node's neighbours: its larger neighbours, or itself and its smaller ones."""
        sides = neighbours(edges)
        if not large:
            sides = sides.where("b < a")
        least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        if large:
            moved = sides.where("b > a").join(least, "a").select(F.col("b").alias("x"), "m")
        else:
            moved = sides.join(least, "a").select(F.col("b").alias("x"), "m").union(least.select("a", "m"))
        return moved.where("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = materialise(links.select("a", "b"), "links")
    seen = state(edges)
    while seen[0]:
        edges = materialise(star(star(edges, True), False), "stars")
        seen, before = state(edges), seen
        if seen == before:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def first_by_links(classes: DataFrame, links: DataFrame) -> DataFrame:
    """For each ``fp`` of ``classes`` (fp, own) the smallest ``own`` in its whole component, as ``first``."""
    roots = component_roots(links)
    members = materialise(roots.union(roots.select("root", "root").distinct()), "members")
    linked = classes.join(members, classes.fp == members.node).select("fp", "root", "own")
    firsts = linked.groupBy("root").agg(F.min("own").alias("linked_first"))
    merged = linked.join(firsts, "root").select(F.col("fp").alias("linked_fp"), "linked_first", F.lit(True).alias("is_linked"))
    return classes.join(merged, classes.fp == merged.linked_fp, "left").select(
        "fp", F.when(F.col("is_linked"), F.col("linked_first")).otherwise(F.col("own")).alias("first"))


def first_by_fingerprint(keyed: DataFrame, max_distance: int, segments: int | None = None) -> DataFrame:
    """For each distinct ``fp`` the smallest ``key`` in its whole component, as ``first``."""
    classes = materialise(keyed.groupBy("fp").agg(F.min("key").alias("own")), "classes")
    return first_by_links(classes, hamming_links(classes.select("fp"), max_distance, segments))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                    max_distance: int = 4, segments: int | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id that can be reached over links, the row's own included.
    A null or wordless text has the fingerprint zero and is linked like any other. A null id
    stays null and never is a component's id, unless all ids of a component are null.
    Repeated rows are returned as often as they occur. No rows give no rows. Columns other
    than the id and the text are not read. A very long text is hashed whole, in parts.
    """
    prints = materialise(with_fingerprints(docs, text_col, shingle_words, {"key": F.col(f"`{id_col}`")}), "fingerprints")
    first = first_by_fingerprint(prints, max_distance, segments)
    return prints.join(first, "fp").select(
        F.col("key").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                         max_distance: int = 4, segments: int | None = None) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id.

    Rows whose id is null come after all others; of rows with equal ids that whose columns
    have the smallest hash stays. Documents without words have equal fingerprints, so one of
    them stays. Columns of ``docs`` may bear any name. No rows give no rows.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    prints = materialise(with_fingerprints(whole, "text", shingle_words, {"doc": F.col("doc")}).withColumn("row_id", F.monotonically_increasing_id()).withColumn("row_hash", row_hash("doc", docs.schema)), "printed")
    key = F.struct(F.col(f"doc.`{id_col}`").isNull().alias("no_id"), F.col(f"doc.`{id_col}`").alias("id"), "row_hash", "row_id")
    first = first_by_fingerprint(prints.select("fp", key.alias("key")), max_distance, segments)
    stay = first.select(F.col("first.row_id").alias("row_id")).distinct()
    return prints.join(stay, "row_id", "left_semi").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
