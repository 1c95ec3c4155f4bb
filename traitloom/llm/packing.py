"""Packing of tokenised documents into sequences of bounded length.

Documents are tokenised where they lie; longer ones are cut into pieces of full length.
Pieces are dealt evenly into shards of bounded size by their row number, so no key can
crowd one. Within a shard a best-fit start is followed by a local search between underfull
bins: moves, one-for-one and two-for-one exchanges, each of which raises the sum of squared
fills, until bins empty. The pieces of bins that stay underfull meet those of other shards
in a second round.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitloom.llm.shared import materialise

SEQUENCE_TOKENS = 4096
END_ID = 1
#: Pieces of a shard, and the fill from which a bin is left alone after the first round.
SHARD_PIECES = 8192
FULL_ENOUGH = 0.995
#: Tasks of a round of packing at most.
MOST_TASKS = 1 << 16
#: Words kept with their ids in each of a worker's two generations, and the longest kept.
CACHE_WORDS, CACHE_BYTES = 400_000, 64


class WordIds:
    """Token ids of a text, word by word, as little-endian 32-bit numbers.

    The tokenizer's patterns never reach over ASCII white space, so the ids of a text are
    those of its words in order. Words are looked up; an unknown word of Latin characters is
    cut as the tokenizer's own pattern cuts it and its parts are looked up in turn, so that
    capitals and stops do not hide a known part. All other words go through the tokenizer.
    """

    LATIN = re.compile("[!-~\u00a1-\u024f]+")
    #: The word pattern of the tokenizer file.
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        spare = iter(range(256, 512))
        self.byte_chars = {b: b if b in printable else next(spare) for b in range(256)}
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        tokens = self.model.tokenize(part.encode("utf-8").decode("latin-1").translate(self.byte_chars))
        ids = self.parts[part] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return ids

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        if len(word) > CACHE_BYTES or not self.LATIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known = self.parts
        return b"".join([known.get(p) or self._part(p) for p in self.PARTS.findall(text.lower())])

    def ids(self, text: str) -> bytes:
        words = text.encode("utf-8").split()
        long = {}
        for word in set(words).difference(self.new):
            if len(word) > CACHE_BYTES:
                long[word] = self._word(word)
            else:
                self.new[word] = self.old.get(word) or self._word(word)
        if long:
            out = b"".join(long[w] if w in long else self.new[w] for w in words)
        else:
            out = b"".join(map(self.new.__getitem__, words))
        if len(self.new) > CACHE_WORDS:
            self.old, self.new = self.new, {}
        if len(self.parts) > CACHE_WORDS:
            self.parts = {}
        return out


def token_pieces(docs: DataFrame, tokenizer: str, keep: dict[str, Column], text: Column,
                 sequence_tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The columns ``keep``, then ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``."""
    picked = docs.select(*[c.alias(n) for n, c in keep.items()], F.coalesce(text, F.lit("")).alias("__text"))
    made = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    if with_ids:
        made.append(("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType([*picked.schema.fields[:-1], *[T.StructField(n, t) for n, t in made]])
    names = [*keep]
    step, end = 4 * sequence_tokens, int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(tokenizer)
        for batch in batches:
            rows, cut, of = [], [], []
            for at, text in enumerate(batch.column(len(names)).to_pylist()):
                whole = encoder.ids(text) + end
                for piece, start in enumerate(range(0, len(whole), step)):
                    own = whole[start : start + step]
                    of.append(at)
                    rows.append((piece, start // 4, len(own) // 4, zlib.crc32(own)))
                    if with_ids:
                        cut.append(np.frombuffer(own, "<u4").astype(np.int32))
            taken = pa.array(of, pa.int64())
            columns = [c.take(taken) for c in batch.columns[:-1]]
            columns += [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            if with_ids:
                columns.append(pa.array(cut, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *[n for n, _ in made]])

    return picked.mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_bits = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        fitting = open_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            at = by_free[free].pop()
            if not by_free[free]:
                open_bits ^= 1 << free
            bins[at].append(item)
        else:
            at, free = len(bins), capacity
            bins.append([item])
        left = free - length
        by_free[left].append(at)
        open_bits |= 1 << left
    return bins


def offers(lengths: np.ndarray, own: list[int]) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """The sizes of all single items and pairs of a bin, ascending, each with one such unit, a single item if there is one."""
    held: dict[int, list[int]] = {}
    for i in own:
        held.setdefault(int(lengths[i]), []).append(i)
    units = {s: (items[0],) for s, items in held.items()}
    kinds = sorted(held)
    for n, a in enumerate(kinds):
        for b in kinds[n:]:
            if a < b or len(held[a]) > 1:
                units.setdefault(a + b, (held[a][0], held[b][0 if a < b else 1]))
    sizes = sorted(units)
    return np.array(sizes, np.int64), [units[s] for s in sizes]


def exchange(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empty underfull bins, least filled first, into fuller ones; stops at the least possible count.

    A step moves an item, or exchanges one or two items of the bin for a smaller one of a
    fuller bin that has room for the difference; the step that fills most is taken. Each
    raises the sum of squared fills, so the search ends.
    """
    least = -(-int(lengths.sum()) // capacity)
    fill = np.array([lengths[b].sum() for b in bins], np.int64)
    alive, stuck = len(bins), set()
    where = np.empty(len(lengths), np.int64)
    for b, items in enumerate(bins):
        where[items] = b
    while alive > least:
        rest = [b for b in np.flatnonzero((fill > 0) & (fill < capacity)).tolist() if b not in stuck]
        if len(rest) < 2:
            break
        source = min(rest, key=lambda b: (fill[b], b))
        while fill[source] > 0:
            free = capacity - fill
            others = (fill >= fill[source]) & (fill < capacity)
            others[source] = False
            best = None
            own = bins[source]
            sizes, units = offers(lengths, own)
            room, targets = free * others, np.flatnonzero(others)
            candidates = np.flatnonzero(others[where])
            if len(targets):
                single = max((s for s, u in zip(sizes.tolist(), units, strict=True) if len(u) == 1 and s <= room[targets].max()), default=0)
                if single:
                    fits = targets[room[targets] >= single]
                    best = (single, units[int(np.searchsorted(sizes, single))], int(fits[np.argmin(room[fits])]), -1)
            if len(candidates):
                # The largest offer for which the bin of each candidate has room once the candidate has left it.
                largest = np.searchsorted(sizes, lengths[candidates] + room[where[candidates]], "right") - 1
                gain = np.where(largest >= 0, sizes[largest] - lengths[candidates], 0)
                k = int(np.argmax(gain))
                if gain[k] > 0 and (best is None or gain[k] > best[0]):
                    best = (int(gain[k]), units[int(largest[k])], int(where[candidates[k]]), int(candidates[k]))
            if best is None:
                stuck.add(source)
                break
            gain, unit, target, back = best
            for i in unit:
                own.remove(i)
                bins[target].append(i)
                where[i] = target
            if back >= 0:
                bins[target].remove(back)
                own.append(back)
                where[back] = source
            fill[target] += gain
            fill[source] -= gain
        alive = int((fill > 0).sum())
    return [b for b in bins if b]


def pack_shard(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    return exchange(lengths, best_fit(lengths, capacity), capacity)


def _packed(numbered: DataFrame, pieces: int, capacity: int, shard_pieces: int, round_no: int) -> DataFrame:
    """``row_id``, ``length``, ``sequence_id``, ``offset`` and ``fill`` of rows (row_id, length)."""
    shards = max(1, -(-pieces // shard_pieces))
    first = round_no << 62

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_id").reset_index(drop=True)
        lengths = rows["length"].to_numpy(np.int64)
        bins = pack_shard(lengths, capacity)
        order = np.concatenate([np.array(b, np.int64) for b in bins])
        sizes = [len(b) for b in bins]
        ends = np.concatenate([np.cumsum(lengths[b]) for b in bins])
        out = rows.iloc[order].reset_index(drop=True)
        return pd.DataFrame({"row_id": out["row_id"], "length": out["length"], "sequence_id": first + (int(key[0]) << 32) + np.repeat(np.arange(len(bins)), sizes),
                             "offset": ends - lengths[order], "fill": np.repeat([int(lengths[b].sum()) for b in bins], sizes)})

    dealt = numbered.withColumn("shard", F.pmod(F.xxhash64("row_id"), F.lit(shards)).cast("long"))
    # The number of tasks is given, since a shard's few bytes hide its work.
    return dealt.repartition(min(shards, MOST_TASKS), "shard").groupBy("shard").applyInPandas(run, "row_id long, length long, sequence_id long, offset long, fill long")


def pack(pieces: DataFrame, sequence_tokens: int = SEQUENCE_TOKENS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` (with a long ``length`` of 1 to ``sequence_tokens``), each with ``sequence_id`` and ``offset``.

    The pieces of a sequence lie side by side from offset 0. No rows give no rows.
    """
    numbered = materialise(pieces.withColumn("__row_id", F.monotonically_increasing_id()), "pieces")
    rows = numbered.select(F.col("__row_id").alias("row_id"), "length")
    placed = materialise(_packed(rows, rows.count(), sequence_tokens, shard_pieces, 0), "packed")
    loose = placed.where(F.col("fill") < FULL_ENOUGH * sequence_tokens)
    again = _packed(loose.select("row_id", "length"), loose.count(), sequence_tokens, shard_pieces, 1)
    final = placed.where(F.col("fill") >= FULL_ENOUGH * sequence_tokens).unionByName(again)
    return numbered.join(final.select(F.col("row_id").alias("__row_id"), "sequence_id", "offset"), "__row_id").drop("__row_id")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   sequence_tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise and pack documents; a row per piece: the id, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id``, ``offset`` and, ``with_ids``, the token ``ids`` themselves.

    A null or empty text is its end token alone. Repeated rows and null ids are packed like
    any other row. No rows give no rows. Columns other than the id and the text are not read,
    whatever their names. A very long text is tokenised by one task and cut into pieces. Which
    of equally long pieces goes where is settled by their places in the table of pieces.
    """
    pieces = token_pieces(docs, tokenizer, {"key": F.col(f"`{id_col}`")}, F.col(f"`{text_col}`"), sequence_tokens, end_id, with_ids)
    return pack(pieces, sequence_tokens).withColumnRenamed("key", id_col)
