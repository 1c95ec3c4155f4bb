"""Benchmark items found in training passages: a BM25 index searched with block-max WAND.

The benchmark's items are the indexed side; its terms are pairs of neighbouring words, which
keeps ordinary prose from matching. An item's score for a passage is the share of the item's
own BM25 weight that the passage's terms cover, so one threshold serves items of any length.
Every passage of every document (overlapping windows, each item fits into one) is a query.
Items are grouped by the power of two that their words fit into, and each group has passages
of its own width and an index of its own, so a long item changes nothing for short ones.
A passage whose terms' greatest weights can't reach the threshold is passed over at once;
the others are searched, all items over the threshold are fetched, and an item counts if
five-word shingles of its question and of its answer are found in the passage.

Document frequencies are counted over all items. The index is cut into blocks of bounded
bytes. Each block is searched by a pass of its own over the documents, so a block is all
that the driver builds and a task holds at once; there is one pass unless the benchmark is
larger than a block.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from traitloom.llm.shared import materialise

K1, B = 1.2, 0.75
THRESHOLD = 0.5
SHINGLE_WORDS, LEAST_OVERLAP = 5, 0.8
BLOCK_POSTINGS = 64
#: Bytes of item text of an index block, and the least words of half a passage.
INDEX_BYTES = 8 << 20
HALF_PASSAGE = 64
#: ASCII characters that are no letter or digit become spaces; capital letters become small.
PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def hit_type(item_id: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("item_id", item_id), T.StructField("start", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("score", "question_overlap", "answer_overlap")]])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().translate(PLAIN).split()


def pairs_of(words: list[bytes]) -> list[bytes]:
    """The terms of a text: its pairs of neighbouring words, or its only word."""
    return list(map(b" ".join, zip(words, words[1:], strict=False))) if len(words) != 1 else words


def split_item(text: Column) -> tuple[Column, Column]:
    """Question and answer of an item given as one text: its last line or sentence is the answer."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    trimmed = F.regexp_replace(whole, r"(?U)^\s+|\s+$", "")
    parts = F.filter(F.split(trimmed, r"(?U)\n+|(?<=[.?!])\s+"), lambda x: x.rlike(r"(?U)\S"))
    several = F.size(parts) > 1
    question = F.when(several, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), " ")).otherwise(whole)
    return question, F.when(several, F.try_element_at(parts, F.lit(-1))).otherwise(F.lit(""))


def overlap(part: list[bytes], passage: set[bytes], line: bytes) -> float:
    """The share of a part's shingles that a passage has; a part of fewer words must stand in it whole; an empty one asks for nothing."""
    if not part:
        return 1.0
    if len(part) < SHINGLE_WORDS:
        return float(b" " + b" ".join(part) + b" " in line)
    own = {b" ".join(part[i : i + SHINGLE_WORDS]) for i in range(len(part) - SHINGLE_WORDS + 1)}
    return len(own & passage) / len(own)


@dataclass
class Postings:
    """A term's items in order with their weights, and the greatest weight of each block."""

    items: list[int]
    weights: list[float]
    top: float = 0.0
    block_last: list[int] = field(default_factory=list)
    block_top: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.top = max(self.weights)
        for i in range(0, len(self.items), BLOCK_POSTINGS):
            self.block_last.append(self.items[min(i + BLOCK_POSTINGS, len(self.items)) - 1])
            self.block_top.append(max(self.weights[i : i + BLOCK_POSTINGS]))


@dataclass
class Index:
    terms: dict[bytes, int]
    lists: list[Postings]
    items: list[tuple[object, list[bytes], list[bytes]]]
    half: int

    def tops(self) -> np.ndarray:
        return np.array([p.top for p in self.lists], np.float64)

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score for these terms reaches the threshold, by block-max WAND."""
        found, goal = [], threshold - 1e-9
        cursors = [[p.items[0], 0, p] for p in map(self.lists.__getitem__, terms)]

        def advance(cursor: list, item: int) -> None:
            postings = cursor[2]
            cursor[1] = bisect_left(postings.items, item, cursor[1])
            cursor[0] = postings.items[cursor[1]] if cursor[1] < len(postings.items) else None

        while True:
            cursors = sorted((c for c in cursors if c[0] is not None), key=lambda c: c[0])
            bound, pivot = 0.0, None
            for k, c in enumerate(cursors):
                bound += c[2].top
                if bound >= goal:
                    pivot = k
                    break
            if pivot is None:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            ahead, bound, reach = cursors[: pivot + 1], 0.0, None
            for c in ahead:
                k = bisect_left(c[2].block_last, item)
                if k < len(c[2].block_last):
                    bound += c[2].block_top[k]
                    reach = c[2].block_last[k] if reach is None else min(reach, c[2].block_last[k])
            if bound < goal:
                after = reach + 1
                if pivot + 1 < len(cursors):
                    after = min(after, cursors[pivot + 1][0])
                for c in ahead:
                    advance(c, max(after, item + 1))
            elif cursors[0][0] == item:
                score = sum(c[2].weights[c[1]] for c in ahead)
                if score >= goal:
                    found.append((item, score))
                for c in ahead:
                    advance(c, item + 1)
            else:
                for c in ahead:
                    if c[0] < item:
                        advance(c, item)

    def hits(self, words: list[bytes], pairs: list[bytes], tops: np.ndarray, threshold: float) -> list[dict]:
        """The verified items of a text, given as its words and their pairs, each with its best passage."""
        known = list(map(self.terms.get, pairs))
        at = [i for i, t in enumerate(known) if t is not None]
        if not at:
            return []
        term = np.array([known[i] for i in at], np.int64)
        place, weight = np.array(at, np.int64), tops[term]
        if weight.sum() < threshold - 1e-9:
            return []
        before = np.concatenate([[0.0], np.cumsum(weight)])
        starts = np.arange(0, max(1, len(words) - self.half), self.half)
        first, last = np.searchsorted(place, starts), np.searchsorted(place, starts + 2 * self.half - 1)
        best: dict[int, dict] = {}
        for k in np.flatnonzero(before[last] - before[first] >= threshold - 1e-6).tolist():
            passage = words[starts[k] : starts[k] + 2 * self.half]
            got = self.search(sorted(set(term[first[k] : last[k]].tolist())), threshold)
            if not got:
                continue
            shingles = {b" ".join(passage[i : i + SHINGLE_WORDS]) for i in range(len(passage) - SHINGLE_WORDS + 1)}
            line = b" " + b" ".join(passage) + b" "
            for item, score in got:
                item_id, question, answer = self.items[item]
                q, a = overlap(question, shingles, line), overlap(answer, shingles, line)
                if q >= LEAST_OVERLAP and a >= LEAST_OVERLAP and (item not in best or score > best[item]["score"]):
                    best[item] = {"item_id": item_id, "start": int(starts[k]), "score": min(1.0, score), "question_overlap": q, "answer_overlap": a}
        return [best[i] for i in sorted(best)]


def build_index(items: list[tuple[object, str, str]], frequency: dict[bytes, int], n_items: int, mean_terms: float, half: int) -> Index:
    """The index of a block of items (id, question, answer); ``frequency`` counts terms over all items."""
    terms: dict[bytes, int] = {}
    found: list[tuple[list[int], list[float]]] = []
    kept = []
    for item_id, question, answer in items:
        q, a = words_of(question), words_of(answer)
        own = Counter(pairs_of(q + a))
        length = sum(own.values())
        weight = {}
        for t, tf in own.items():
            idf = math.log(1 + (n_items - frequency[t] + 0.5) / (frequency[t] + 0.5))
            weight[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_terms))
        total = sum(weight.values())
        for t, w in weight.items():
            if t not in terms:
                terms[t] = len(found)
                found.append(([], []))
            found[terms[t]][0].append(len(kept))
            found[terms[t]][1].append(w / total)
        kept.append((item_id, q, a))
    return Index(terms, [Postings(*x) for x in found], kept, half)


def half_passage(words: int) -> int:
    """Half of the width of the passages in which an item of so many words is looked for."""
    return max(HALF_PASSAGE, 1 << (words - 1).bit_length())


def indexes(benchmark: DataFrame, id_col: str, question: Column, answer: Column, index_bytes: int) -> Iterator[list[Index]]:
    """The blocks of the index, one at a time, each by width of passages; only one block's items come to the driver at once."""
    items = benchmark.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(question, F.lit("")).alias("q"), F.coalesce(answer, F.lit("")).alias("a"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(b, t) for b, q, a in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                    for t in set(pairs_of(words_of(q) + words_of(a))) or [b""]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "term"])

    size = items.agg(F.sum(F.octet_length("q") + F.octet_length("a")).alias("bytes"), F.count("*").alias("n")).first()
    blocks = max(1, -(-(size["bytes"] or 0) // index_bytes))
    dealt = materialise(items.withColumn("block", F.pmod(F.xxhash64("id", "q", "a"), F.lit(blocks))), "items")
    found = materialise(dealt.select("block", "q", "a").mapInArrow(terms, "block long, term binary"), "terms")
    frequency = found.groupBy("term").agg(F.count("*").alias("n"))
    total = (size["n"] or 1), max(1.0, found.count() / max(1, size["n"] or 1))
    for block in range(blocks):
        counts = found.where(F.col("block") == block).select("term").distinct().join(frequency, "term")
        rows = [(r["id"], r["q"], r["a"]) for r in dealt.where(F.col("block") == block).orderBy("id").collect()]
        grouped: dict[int, list[tuple]] = {}
        for r in rows:
            if n := len(words_of(r[1])) + len(words_of(r[2])):
                grouped.setdefault(half_passage(n), []).append(r)
        if grouped:
            frequencies = {bytes(r["term"]): r["n"] for r in counts.collect()}
            yield [build_index(own, frequencies, *total, half) for half, own in sorted(grouped.items())]


def _searched(texts: DataFrame, index: list[Index], threshold: float, hits: T.ArrayType) -> DataFrame:
    """``texts`` (any column, text) as that column and ``hits``, what a block of the index finds."""
    shared = texts.sparkSession.sparkContext.broadcast(index)
    name = texts.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, kind = [(own, own.tops()) for own in shared.value], to_arrow_type(hits)

        def found_in(text: str | None) -> list[dict]:
            words = words_of(text)
            pairs = pairs_of(words)
            return [hit for own, tops in groups for hit in own.hits(words, pairs, tops, threshold)]

        for batch in batches:
            found = [found_in(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[name, "hits"])

    return texts.mapInArrow(run, T.StructType([texts.schema[0], T.StructField("hits", hits)]))


def _blocks(benchmark: DataFrame, item_id_col: str, question: Column | None, answer: Column | None, index_bytes: int) -> tuple[Iterator[list[Index]], T.ArrayType]:
    if question is None:
        question, answer = split_item(F.col("text"))
    return indexes(benchmark, item_id_col, question, answer, index_bytes), T.ArrayType(hit_type(benchmark.select(F.col(f"`{item_id_col}`")).schema[0].dataType))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", question: Column | None = None,
                 answer: Column | None = None, threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """A row per document and benchmark item found in it: the id and the fields of the hit.

    Without ``question`` and ``answer`` the benchmark's ``text`` is split, its last line or
    sentence being the answer. A null or empty text and a null, empty or wordless item match
    nothing; an empty answer asks for nothing. Repeated rows and items match each for itself,
    and of passages with equal scores the earliest is given. A very long text is searched
    passage by passage in one task. Ids may be of any type, and columns of ``docs`` of any
    name; those but the id and the text are not read. No documents or no items give no rows.
    """
    blocks, hits = _blocks(benchmark, item_id_col, question, answer, index_bytes)
    texts = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = [_searched(texts, index, threshold, hits) for index in blocks]
    whole = reduce(DataFrame.union, found) if found else texts.select("key", F.lit(None).cast(hits).alias("hits"))
    return whole.select(F.col("key"), F.explode("hits").alias("hit")).select(F.col("key").alias(id_col), "hit.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", question: Column | None = None,
                  answer: Column | None = None, threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, by the rules of :func:`contaminated`.

    Rows are kept or dropped each for itself, those with null ids and equal rows too. Each
    block of the index but the last writes the rows that it leaves.
    """
    blocks, hits = _blocks(benchmark, item_id_col, question, answer, index_bytes)
    left, pending = docs, None
    for index in blocks:
        left = left if pending is None else materialise(pending, "unleaked")
        whole = left.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
        clean = _searched(whole, index, threshold, hits).where(F.size("hits") == 0)
        pending = clean.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return docs if pending is None else pending
