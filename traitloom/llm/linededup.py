"""Removal of passages that repeat across a corpus, by content-defined chunks of lines.

A text is cut into units: its lines, and within a line its sentences, so that a passage is
found wherever in a line it begins. A rolling hash over the hashes of neighbouring units
chooses chunk boundaries; these depend on the units near them alone, so an insertion earlier
in a text shifts no later boundary. A chunk found twice or more in the corpus stays at its
first occurrence (smallest document, then earliest place) and goes elsewhere, if its bytes
equal those of the first and if it stands in a run of such chunks of more than one unit and
at least ``min_words`` words: a common line alone stays. A run reaches on into the chunks
beside it as far as the XXH3 hashes of their units' bytes equal those beside the first
occurrence, so a passage goes whole although its ends share chunks with other text.

Beside the chunks, each window of WINDOW words that stands earlier in the corpus goes, however
lines and sentences cut it: by itself, since it is a passage, not a common line. A window is
named by the least hash among the runs of ANCHOR words in it; equal windows have equal names,
and few words of a text give many windows one name, so only windows whose name stands at two
or more places are compared, by name and by a hash of all their words' bytes. Names and chunk
hashes are sums, which are quick but can be made equal for different texts; so nothing goes by
them alone. Of equal windows of one text that overlap, the first counts.

The work goes in four readings of the texts, and only hashes are grouped over all of them:

1. Every text gives the hashes of its chunks and the names of its windows. Those of one
   text that stand in another, or twice in their own, are repeated.
2. Texts that hold a repeated hash, one row of equal texts, give their repeated chunks and
   windows, which are compared.
3. Texts with an equal text before them are compared with it byte by byte.
4. Only texts with something to cut meet their lists, and are cut.

Between readings a sieve (a Bloom filter of bounded size) picks rows; it saves shuffling and
decides nothing, for exact joins follow. When it is full, more is shuffled, and the result
is the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitloom.llm.shared import materialise, slices

#: A boundary falls after a unit where the rolling hash over two units is divisible by this.
#: A chunk closes with this many words at the least and this many units at the most.
DIVISOR = 2
LEAST_WORDS, MAX_UNITS = 8, 16
MIN_WORDS = 20
#: Words of a window, and of the runs in it that are hashed to name it.
WINDOW, ANCHOR = 50, 25
MULTIPLIER = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
#: Bits of a sieve for each hash, how many of them a hash sets, and bits at most and at least in all.
SIEVE_SHARE, SIEVE_PROBES, SIEVE_MOST, SIEVE_LEAST = 32, 6, 1 << 28, 1 << 16
#: Hashes that are brought together at a time, in how many parts at least and at most; a power of two.
PART, LEAST_PARTS, MOST_PARTS = 1 << 18, 64, 1 << 16
#: Bytes of texts whose words are hashed at a time, so that the numbers stay in a core's cache.
GROUP_BYTES = 1 << 17
#: A name held by more texts than this, and than this part of all, is crowded; so there are few of them.
CROWD, CROWD_SHARE = 2000, 1000
#: Keys that are broadcast at most.
MOST_KEYS = 1 << 20
#: Windows of crowded names that a task remembers.
REMEMBERED = 200_000
BREAK = re.compile(rb"[.!?][ \t]+|\n")
IS_SPACE, IS_STOP, IS_BLANK = (np.isin(np.arange(256), list(x)) for x in (b" \t\n\r\x0b\x0c", b".!?", b" \t"))
POWER_TURN = GROUP_BYTES
POWERS, INVERSE = (np.multiply.accumulate(np.array([1] + [x] * (2 * GROUP_BYTES), np.uint64)) for x in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)))
#: Bytes of a word that are hashed with those of all others at once.
LONG_WORD = 64
CHUNK, OPEN, LATER = 0, 1, 2


def distinct_windows(names: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """The windows (place, name) that overlap no equal one before."""
    out, last = [], {}
    for at, name in names:
        if at - last.get(name, -WINDOW) >= WINDOW:
            last[name] = at
            out.append((at, name))
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of some bytes: where they start and end, and their hashes.

    The hash of a stretch of bytes is a difference of sums of bytes times powers, taken back
    to the first power, so that of any stretch costs the same. Bytes are taken in pieces of
    about GROUP_BYTES that end between units; a longer unit is hashed by itself.
    """

    def __init__(self, data: bytes):
        parts, at = [], 0
        while at < len(data):
            cut = BREAK.search(data, at + GROUP_BYTES) if at + GROUP_BYTES < len(data) else None
            end = cut.end() if cut else len(data)
            parts.append(self._piece(data, at, end))
            at = end
        join = lambda k, t: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t)
        self.starts, self.ends, self.hashes = join(0, np.int64), join(1, np.int64), join(2, np.uint64)
        #: The units, each up to the next: where they start, their first words and the hashes of their contents.
        self.unit_starts, self.unit_hashes = join(3, np.int64), join(4, np.uint64)
        self.unit_words = np.searchsorted(self.starts, np.append(self.unit_starts, len(data)))

    @staticmethod
    def _piece(data: bytes, at: int, end: int) -> tuple[np.ndarray, ...]:
        own = np.frombuffer(data, np.uint8, end - at, at)
        gap = np.ones(end - at + 2, bool)
        np.take(IS_SPACE, own, out=gap[1:-1])
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edges[::2], edges[1::2]
        # Blanks after a stop begin where a word ends, and most are one.
        stops = ends[IS_STOP[own[ends - 1]]]
        stops = stops[IS_BLANK[own[np.minimum(stops, end - at - 1)]] & (stops < end - at)] + 1
        longer = np.flatnonzero(IS_BLANK[own[np.minimum(stops, end - at - 1)]] & (stops < end - at))
        if len(longer):
            others = np.append(np.flatnonzero(~IS_BLANK[own]), end - at)
            stops[longer] = others[np.searchsorted(others, stops[longer])]
        breaks = np.sort(np.concatenate([stops, np.flatnonzero(own == 10) + 1]))
        units = np.append(0, breaks[breaks < len(own)])
        word = np.searchsorted(starts, np.append(units, len(own)))
        filled = word[1:] > word[:-1]
        contents = np.zeros(len(units), np.uint64)
        if len(own) <= 2 * GROUP_BYTES:
            sums = np.zeros(len(own) + 1, np.uint64)
            np.multiply(own, POWERS[: len(own)], out=sums[1:], casting="unsafe")
            np.cumsum(sums, out=sums)
            stretch = lambda a, b: mixed((sums[b] - sums[a]) * INVERSE[a] + (b - a).astype(np.uint64))
        else:
            stretch = lambda a, b: np.array([Words._long(data[at + x : at + y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.uint64)
        contents[filled] = stretch(starts[word[:-1][filled]], ends[word[1:][filled] - 1])
        return starts + at, ends + at, stretch(starts, ends), units + at, contents

    @staticmethod
    def _long(stretch: bytes) -> int:
        """The hash of a stretch within a long piece; of one that short pieces can hold, the same as there."""
        if len(stretch) > 2 * GROUP_BYTES:
            return xxhash.xxh64_intdigest(stretch)
        own = np.frombuffer(stretch, np.uint8).astype(np.uint64)
        return int(mixed(np.array([(own * POWERS[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64))[0])


class Texts:
    """Several texts at once: the units, chunks and words of each."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.data = texts, b"\n".join(texts)
        self._held: dict[int, list[bytes]] = {}
        self._unit_hashes: dict[int, list[int]] = {}
        sizes = np.array([len(t) for t in texts], np.int64)
        #: Where each text ends in the joined bytes; a line break follows.
        self.ends = np.cumsum(sizes + 1) - 1
        self.begins = self.ends - sizes
        self.words = Words(self.data)
        starts = self.words.unit_starts
        of = np.searchsorted(self.ends, starts, "right")
        inside = (of < len(texts)) & (starts < self.ends[np.minimum(of, len(texts) - 1)]) if texts else np.zeros(0, bool)
        self.unit_of, self.unit_start = of[inside], starts[inside]
        self.unit_first, self.unit_last = self.words.unit_words[:-1][inside], self.words.unit_words[1:][inside]
        self.unit_hash = self.words.unit_hashes[inside]
        self._chunk()

    def _chunk(self) -> None:
        filled = np.flatnonzero(self.unit_last > self.unit_first)
        of, own = self.unit_of[filled], self.unit_hash[filled]
        fresh = np.append(True, of[1:] != of[:-1]) if len(of) else np.zeros(0, bool)
        before = np.where(fresh, np.uint64(0), np.append(np.uint64(0), own[:-1])) if len(of) else own
        closes = ((before * np.uint64(MULTIPLIER) + own) >> np.uint64(32)) % np.uint64(DIVISOR) == 0
        counts = (self.unit_last - self.unit_first)[filled]
        heads, words, n, done = [], 0, 0, True
        for k, (new, close, count) in enumerate(zip(fresh.tolist(), closes.tolist(), counts.tolist(), strict=True)):
            if done or new:
                heads.append(k)
                words = n = 0
            words += count
            n += 1
            done = (close and words >= LEAST_WORDS) or n >= MAX_UNITS
        heads = np.array(heads, np.int64)
        tails = np.append(heads[1:], len(filled)) if len(heads) else heads
        sums = np.append(np.uint64(0), np.cumsum(own * POWERS[np.arange(len(own)) % POWER_TURN]))
        hashes = mixed((sums[tails] - sums[heads]) * INVERSE[heads % POWER_TURN] + (tails - heads).astype(np.uint64)) if len(heads) else np.zeros(0, np.uint64)
        for j in np.flatnonzero(heads // POWER_TURN != (tails - 1) // POWER_TURN).tolist():
            part = own[heads[j] : tails[j]]
            hashes[j] = mixed((part * POWERS[: len(part)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(part)))[0]
        #: The units that are not blank, and of a chunk the first of them and the one after its last.
        self.filled, self.heads, self.tails = filled, heads, tails
        #: The text of a chunk, its number in the text, its hash, and its first unit; the blank ones before a text's first chunk are its.
        self.chunk_of = of[heads] if len(heads) else np.zeros(0, np.int64)
        first = np.searchsorted(self.chunk_of, np.arange(len(self.texts)))
        self.chunk_at = np.arange(len(heads)) - first[self.chunk_of] if len(heads) else heads
        self.chunk_hash = hashes.view(np.int64)
        self.chunk_bounds = np.searchsorted(self.chunk_of, np.arange(len(self.texts) + 1))
        self.unit_bounds = np.searchsorted(self.unit_of, np.arange(len(self.texts) + 1))
        self.word_bounds = np.searchsorted(self.words.starts, np.append(self.begins, len(self.data)))

    def take(self, chunks: np.ndarray) -> None:
        """Read the units of chunks and of their neighbours, and hash them, together."""
        wanted = np.zeros(len(self.heads) + 2, bool)
        for k in range(3):
            wanted[chunks + k] = True
        own = np.flatnonzero(wanted[1:-1])
        sizes = self.tails[own] - self.heads[own]
        ends = np.cumsum(sizes)
        at = self.filled[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.heads[own] - (ends - sizes), sizes)]
        starts, stops = self.words.starts[self.unit_first[at]].tolist(), self.words.ends[self.unit_last[at] - 1].tolist()
        units = list(map(self.data.__getitem__, map(slice, starts, stops)))
        hashes = [h - (1 << 63) for h in map(xxhash.xxh3_64_intdigest, units)]
        for chunk, a, b in zip(own.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
            self._held[chunk], self._unit_hashes[chunk] = units[a:b], hashes[a:b]

    def held(self, chunk: int) -> list[bytes]:
        """The stripped units of a chunk that are not blank; a chunk is asked for by its neighbours too, so they are kept."""
        if chunk not in self._held:
            own = self.filled[self.heads[chunk] : self.tails[chunk]]
            starts, ends = self.words.starts[self.unit_first[own]], self.words.ends[self.unit_last[own] - 1]
            self._held[chunk] = [self.data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return self._held[chunk]

    def unit_hashes(self, chunk: int) -> list[int]:
        """XXH3 of the bytes of each unit of a chunk."""
        if chunk not in self._unit_hashes:
            self._unit_hashes[chunk] = [xxhash.xxh3_64_intdigest(unit) - (1 << 63) for unit in self.held(chunk)]
        return self._unit_hashes[chunk]


def line_chunks(text: bytes) -> list[tuple[list[bytes], list[bytes]]]:
    """The chunks of a text: their units, and the stripped units that are not blank.

    A blank unit goes with the chunk before it.
    """
    cut = Texts([text])
    ends = np.r_[cut.unit_start[1:], len(text)] if len(cut.unit_start) else cut.unit_start
    units = [text[a:b] for a, b in zip(cut.unit_start.tolist(), ends.tolist(), strict=True)]
    if not len(cut.heads):
        return [(units, [])] if units else []
    firsts = [0, *cut.filled[cut.heads[1:]].tolist(), len(units)]
    return [(units[firsts[k] : firsts[k + 1]], cut.held(k)) for k in range(len(cut.heads))]


def chunks(text: bytes) -> list[tuple[list[bytes], list[bytes]]]:
    """All that is compared: the chunks of lines, then for each word the window that begins with it.

    A window has no units of its own, and its content begins with a line break, as no chunk's does.
    """
    words = text.split()
    windows = [(i, b" ".join(words[i : i + WINDOW])) for i in range(len(words) - WINDOW + 1)]
    listed = dict(distinct_windows(windows))
    return line_chunks(text) + [([], [b"", w] if i in listed else []) for i, w in windows]


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` words, by doubling."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    runs, size = words, 1
    for bit in f"{n:b}"[1:]:
        runs = runs[: len(words) - 2 * size + 1] * np.uint64(pow(MULTIPLIER, size, 1 << 64)) + runs[size:]
        size *= 2
        if bit == "1":
            runs = runs[: len(words) - size] * np.uint64(MULTIPLIER) + words[size:]
            size += 1
    return mixed(runs)


def word_prints(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word: eight at a time, mixed after each; of words beyond LONG_WORD bytes, XXH3."""
    sizes = ends - starts
    lanes = np.ndarray((len(data),), "<u8", data + bytes(8), strides=(1,))
    out = sizes.astype(np.uint64) * np.uint64(MULTIPLIER)
    short = np.flatnonzero(sizes <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        short = short[sizes[short] > at]
        if not len(short):
            break
        left = np.minimum(sizes[short] - at, 8)
        bits = lanes[starts[short] + at] & (np.uint64(MASK) >> (64 - 8 * left).astype(np.uint64))
        out[short] = mixed((out[short] ^ bits) * np.uint64(MULTIPLIER))
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return out


def mixed_runs(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words, by doubling, mixed at each step."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    runs, size = words, 1
    for bit in f"{n:b}"[1:]:
        runs = mixed(runs[: len(words) - 2 * size + 1] * np.uint64(MULTIPLIER) + runs[size:])
        size *= 2
        if bit == "1":
            runs = mixed(runs[: len(words) - size] * np.uint64(MULTIPLIER) + words[size:])
            size += 1
    return runs


def least_of(runs: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` consecutive elements."""
    width, reach = 1, runs
    while 2 * width <= n:
        reach = np.minimum(reach[: len(reach) - width], reach[width:])
        width *= 2
    return np.minimum(reach[: len(runs) - n + 1], reach[n - width : len(runs) - width + 1])


class Stretches:
    """Of several texts, the stretches of neighbouring windows that share a name."""

    def __init__(self, cut: Texts):
        texts, self.words, self.cut = cut.texts, cut.words.hashes, cut
        last = np.searchsorted(cut.words.starts, cut.ends)
        first = np.r_[0, last[:-1]]
        if len(self.words) < WINDOW:
            self.of, self.at, self.start, self.length, self.names = (np.zeros(0, np.int64) for _ in range(5))
            return
        names = least_of(run_hashes(self.words, ANCHOR), WINDOW - ANCHOR + 1)
        of = np.repeat(np.arange(len(texts)), last - first)[: len(names)]
        inside = np.arange(len(names)) + WINDOW <= last[of]
        new = np.r_[True, (names[1:] != names[:-1]) | (of[1:] != of[:-1]) | (inside[1:] != inside[:-1])]
        start = np.flatnonzero(new)
        length, kept = np.diff(np.r_[start, len(names)]), inside[start]
        #: The text of a stretch, its first window in the text and among all words, its windows and their name.
        self.start, self.length, self.of = start[kept], length[kept], of[start[kept]]
        self.at, self.names = self.start - first[self.of], names[self.start].view(np.int64)

    def _digests(self, index: np.ndarray) -> np.ndarray:
        """Hashes of the words of windows, from the bytes of each word; mixed at each step, so that no sum can be made equal."""
        words, held = self.cut.words, np.zeros(len(self.words) + 1, np.int64)
        np.add.at(held, index, 1)
        np.subtract.at(held, index + WINDOW, 1)
        covered = np.cumsum(held[:-1]) > 0
        place = np.cumsum(covered) - 1
        prints = word_prints(self.cut.data, words.starts[covered], words.ends[covered])
        return mixed_runs(prints, WINDOW)[place[index]]

    def windows(self, held: np.ndarray, exact: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the windows of the stretches ``held``, end to end, and where each stretch's begin; 0 for those not listed.

        ``exact`` hashes are mixed from the words' bytes; others, of sums, are equal where those are
        and cost less, but do not tell all different windows apart.
        """
        length = self.length[held]
        ends = np.cumsum(length)
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[held] - (ends - length), length)
        hashes = np.zeros(0, np.uint64) if not len(index) else self._digests(index) if exact else run_hashes(self.words, WINDOW)[index]
        hashes = np.maximum(hashes, np.uint64(1)).view(np.int64)
        of, at = np.repeat(self.of[held], length), np.arange(len(index)) + np.repeat(self.at[held] - (ends - length), length)
        # Windows of one text that are equal have one key; others seldom do, and the texts of all such are looked at.
        keys = hashes ^ of * np.uint64(MULTIPLIER).view(np.int64)
        ordered = np.sort(keys)
        again = np.isin(keys, ordered[1:][ordered[1:] == ordered[:-1]])
        for text in np.unique(of[again]).tolist():
            own = np.flatnonzero(of == text)
            listed = {i for i, _ in distinct_windows(list(zip(at[own].tolist(), hashes[own].tolist(), strict=True)))}
            hashes[own[[i not in listed for i in at[own].tolist()]]] = 0
        return hashes, ends - length


def grouped(texts: list[bytes]) -> Iterator[range]:
    """Ranges of texts of together about GROUP_BYTES."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= GROUP_BYTES:
            yield range(first, i + 1)
            first, size = i + 1, 0
    if first < len(texts):
        yield range(first, len(texts))


def listed_windows(cut: Texts, which: list[int]) -> list[np.ndarray]:
    """Of several texts, the windows of ``which`` but those that overlap an equal one before."""
    found = Stretches(cut)
    held = np.flatnonzero(np.isin(found.of, which))
    hashes, begins = found.windows(held, exact=False)
    at = (np.arange(len(hashes)) + np.repeat(found.at[held] - begins, found.length[held]))[hashes != 0]
    of = np.repeat(found.of[held], found.length[held])[hashes != 0]
    bounds = np.searchsorted(of, np.append(which, len(cut.texts)))
    return [at[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row's id, text, the hash of its text and one of both; rows equal in id and text are one document."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return own.withColumn("text_hash", F.xxhash64("text")).withColumn("key", F.xxhash64("id", "text_hash"))


def _long_lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """``values`` in lists of so many, each as the bytes of its longs, which pass between tasks as they are."""
    offsets = np.append(0, np.cumsum(counts * 8)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values, np.int64))])


def _longs(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The longs of all lists, end to end, and how many each has."""
    offsets, data = lists.buffers()[1:] if len(lists) else (None, None)
    if offsets is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.frombuffer(offsets, np.int32, len(lists) + 1, 4 * lists.offset).astype(np.int64)
    n = int(ends[-1] - ends[0]) // 8
    return np.frombuffer(data, np.int64, n, int(ends[0])) if n else np.zeros(0, np.int64), np.diff(ends) // 8


def _utf8(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.binary()).to_pylist()


def _distinct(of: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By text and hash, the places of the first of equal ones, and of the second."""
    order = np.lexsort((hashes, of))
    new = np.ones(len(order) + 1, bool)
    new[1:-1] = (hashes[order[1:]] != hashes[order[:-1]]) | (of[order[1:]] != of[order[:-1]])
    return order[new[:-1]], order[1:][~new[1:-1] & new[:-2]]


def _hashes(rows: DataFrame) -> DataFrame:
    """(id, text_hash, key, size, hashes, names, twice): a text's chunk hashes and window names, each once, those of both that it has twice, and how many these are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = _utf8(batch.column(3))
            values, counts = ([], [], []), ([], [], [])
            for group in grouped(texts):
                cut = Texts([texts[i] for i in group])
                found = Stretches(cut)
                # The run of words that names so long a stretch stands at two places.
                long = np.flatnonzero(found.length > WINDOW - ANCHOR + 1)
                of, named = np.concatenate([found.of, found.of[long]]), np.concatenate([found.names, found.names[long]])
                own, again = _distinct(cut.chunk_of, cut.chunk_hash)
                name, twice = _distinct(of, named)
                both = np.concatenate([cut.chunk_of[again], of[twice]])
                order = np.argsort(both, kind="stable")
                lists = (cut.chunk_of[own], cut.chunk_hash[own]), (of[name], named[name]), (both[order], np.concatenate([cut.chunk_hash[again], named[twice]])[order])
                for k, (place, hashes) in enumerate(lists):
                    values[k].append(hashes)
                    counts[k].append(np.bincount(place, minlength=len(group)))
            join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
            sizes = [join(n) for n in counts]
            lists = [_long_lists(join(v), n) for v, n in zip(values, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sum(sizes).astype(np.int64)), *lists], names=["id", "text_hash", "key", "size", "hashes", "names", "twice"])

    lists = [T.StructField(n, T.BinaryType()) for n in ("hashes", "names", "twice")]
    picked = rows.select("id", "text_hash", "key", "text")
    return picked.mapInArrow(run, T.StructType([*picked.schema.fields[:3], T.StructField("size", T.LongType()), *lists]))


def _parts(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash: the leading bits of a product, since names, as least hashes, begin with few bits."""
    return (_spread(hashes) >> np.uint64(65 - parts.bit_length())).astype(np.int64) if parts > 1 else np.zeros(len(hashes), np.int64)


def _spread(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.uint64) * np.uint64(MULTIPLIER)


def _merged(hashes: np.ndarray, n: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
    """One of equal hashes, by the order of parts: how many there are in all, their least and their greatest text."""
    order = np.argsort(_spread(hashes))
    hashes = hashes[order]
    firsts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    return hashes[firsts], np.add.reduceat(n[order], firsts), np.minimum.reduceat(least[order], firsts), np.maximum.reduceat(most[order], firsts)


def _repeated(hashed: DataFrame) -> tuple[DataFrame, int]:
    """(part, hashes, counts, size, total): by parts, the hashes that stand in two texts or twice in one, and in how many; and the number of parts.

    Each batch gives one entry of a hash for each part's row, so a common hash crowds no part.
    """
    total, parts = hashed.agg(F.sum("size")).first()[0] or 0, LEAST_PARTS
    while parts < MOST_PARTS and parts * PART < total:
        parts *= 2
    names = ["hashes", "counts", "least", "most"]
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_numpy(zero_copy_only=False)
            lists = [_longs(c) for c in batch.columns[1:]]
            of = np.concatenate([np.repeat(texts, n) for _, n in lists])
            twice = np.arange(len(of)) >= len(of) - len(lists[-1][0])
            if len(of):
                told = _merged(np.concatenate([v for v, _ in lists]), np.ones(len(of), np.int64), np.where(twice, low, of), np.where(twice, high, of))
                part, counts = np.unique(_parts(told[0], parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(part), *[_long_lists(v, counts) for v in told]], names=["part", *names])

    def merge(group: pa.Table) -> pa.Table:
        told = _merged(*[np.concatenate([_longs(c)[0] for c in group.column(k).chunks]) for k in names])
        own = told[2] != told[3]
        hashes, counts = told[0][own], told[1][own]
        lists = [_long_lists(v, np.array([len(hashes)])) for v in (hashes, counts)]
        return pa.table([group.column("part").slice(0, 1), *lists, pa.array([len(hashes)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], names=["part", *names[:2], "size", "total"])

    spread = hashed.select("text_hash", "hashes", "names", "twice").mapInArrow(run, "part long, " + ", ".join(f"{n} binary" for n in names))
    return materialise(spread.groupBy("part").applyInArrow(merge, "part long, hashes binary, counts binary, size long, total long"), "repeated"), parts


def _part_sieve(repeated: DataFrame, parts: int, n: int) -> Sieve:
    """The sieve of the hashes of :func:`_repeated`, made by parts; at most SIEVE_MOST bits reach the driver."""
    bits = SIEVE_LEAST * parts // LEAST_PARTS
    while bits < min(SIEVE_MOST, SIEVE_SHARE * n):
        bits *= 2
    own = bits // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, hashes in zip(batch.column(0).to_pylist(), (_longs(batch.column(1).slice(k, 1))[0] for k in range(batch.num_rows)), strict=True):
                held = np.zeros(own, np.uint8)
                for bit in Sieve.bits(hashes, own):
                    held[bit] = 1
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([np.packbits(held, bitorder="little").tobytes()])], names=["part", "words"])

    words = np.zeros(bits // 64, np.int64)
    for row in repeated.select("part", "hashes").mapInArrow(run, "part long, words binary").collect():
        words[row["part"] * own // 64 : (row["part"] + 1) * own // 64] = np.frombuffer(row["words"], np.int64)
    return Sieve(words, parts)


def _crowded(repeated: DataFrame, least: int) -> set[int]:
    """The hashes that more than ``least`` texts hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (hashes, _), (counts, _) = _longs(batch.column(0)), _longs(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[counts > least])], names=["hash"])

    return {r["hash"] for r in repeated.select("hashes", "counts").mapInArrow(run, "hash long").collect()}


class Sieve:
    """A Bloom filter: words of 64 bits, of which each part of the hashes has an equal share."""

    def __init__(self, words: np.ndarray, parts: int = 1):
        self.words, self.parts = words, parts

    @staticmethod
    def bits(hashes: np.ndarray, own: int) -> Iterator[np.ndarray]:
        """The bits that hashes set among the ``own`` ones of their part."""
        at, step = hashes & (own - 1), (hashes >> 32) & (own - 1) | 1
        for i in range(SIEVE_PROBES):
            yield (at + i * step) & (own - 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        own = len(self.words) * 64 // self.parts
        first = _parts(hashes, self.parts) * own
        held = np.ones(len(hashes), bool)
        for bit in self.bits(hashes, own):
            bit += first
            held &= (self.words[bit >> 6] >> (bit & 63) & 1).astype(bool)
        return held


def _sieve(hashes: DataFrame, column: str = "hash") -> Sieve:
    """The sieve of a column of longs; at most SIEVE_MOST bits reach the driver."""
    bits, n = SIEVE_LEAST, hashes.count()
    while bits < min(SIEVE_MOST, SIEVE_SHARE * n):
        bits *= 2
    last = bits - 1
    step = F.shiftright(column, 32).bitwiseAND(F.lit(last)).bitwiseOR(F.lit(1))
    bit = hashes.select(F.explode(F.array(*[(F.col(column).bitwiseAND(F.lit(last)) + i * step).bitwiseAND(F.lit(last)) for i in range(SIEVE_PROBES)])).alias("bit"))
    held = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits")).toPandas()
    words = np.zeros(bits // 64, np.int64)
    words[held["word"].to_numpy(np.int64)] = held["bits"].to_numpy(np.int64)
    return Sieve(words)


def _sifted(sieve: Sieve, column: str, df: DataFrame) -> Column:
    """Whether a sieve may hold a column of longs; the other columns stay in the JVM."""
    shared = df.sparkSession.sparkContext.broadcast(sieve)

    @F.arrow_udf("boolean")
    def holds(values: pa.Array) -> pa.Array:
        return pa.array(shared.value.holds(values.to_numpy(zero_copy_only=False)))

    return holds(F.col(column))


def _flagged(rows: DataFrame, keys: DataFrame, column: str, flags: list[str]) -> DataFrame:
    """``rows`` with boolean columns: whether ``keys`` may hold the row's key under a flag.

    Up to MOST_KEYS keys are counted and broadcast, and the flags are exact; more become sieves.
    Exact joins follow, so the result is the same either way.
    """
    told = keys.groupBy(column).agg(*[F.bool_or(f).alias(f"is_{f}") for f in flags])
    if told.count() <= MOST_KEYS:
        joined = rows.join(F.broadcast(told), column, "left")
        return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.coalesce(f"is_{f}", F.lit(False)).alias(f) for f in flags])
    for f in flags:
        rows = rows.withColumn(f, _sifted(_sieve(keys.where(f), column), column, rows))
    return rows


def _holders(hashed: DataFrame, sieve: Sieve) -> DataFrame:
    """(id, text_hash, chunked, named) of the texts of which the sieve holds a chunk's hash or a window's name."""
    shared = hashed.sparkSession.sparkContext.broadcast(sieve)

    def any_held(lists: pa.Array) -> np.ndarray:
        hashes, counts = _longs(lists)
        counted, ends = np.append(0, np.cumsum(shared.value.holds(hashes))), np.append(0, np.cumsum(counts))
        return counted[ends[1:]] > counted[ends[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunked, named = any_held(batch.column(2)), any_held(batch.column(3))
            told = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(chunked), pa.array(named)], names=["id", "text_hash", "chunked", "named"])
            yield told.filter(pa.array(chunked | named))

    picked = hashed.select("id", "text_hash", "hashes", "names")
    return picked.mapInArrow(run, T.StructType([*picked.schema.fields[:2], T.StructField("chunked", T.BooleanType()), T.StructField("named", T.BooleanType())]))


class Earliest:
    """Of equal windows of crowded names, those that a task knows to stand later than another."""

    def __init__(self):
        self.first: dict[tuple[int, int], tuple] = {}

    def later(self, window: tuple[int, int], place: tuple) -> tuple[int, tuple] | None:
        """The place to give out now, and how; None if the place is kept as the first so far."""
        known = self.first.get(window)
        if known is None and len(self.first) >= REMEMBERED:
            return OPEN, place
        if known is None or place < known:
            self.first[window] = place
        return known and (LATER, max(known, place))


FOUND = [("kind", T.IntegerType()), ("at", T.IntegerType()), ("hash", T.LongType()), ("content", T.BinaryType()),
         ("before", T.ArrayType(T.LongType())), ("after", T.ArrayType(T.LongType())), ("windows", T.ArrayType(T.LongType()))]


def _found(rows: DataFrame, sieve: Sieve, crowded: set[int]) -> DataFrame:
    """Of the rows that are ``chunked`` the chunks (kind, at, hash, content, hashes of the units before and after), of those that are ``named`` the stretches of windows
    (kind, at, name, hashes of the windows) that the sieve holds.

    Windows of crowded names come one by one under a hash of their own, and a task gives out
    as LATER those that stand after another it has seen; so few rows of one hash are shuffled.
    """
    shared = rows.sparkSession.sparkContext.broadcast((sieve, np.array(sorted(crowded), np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, crowded = shared.value
        earliest = Earliest()
        arrow = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3]
        names = ["id", "text_hash", *[n for n, _ in FOUND]]

        def packed(keys: list[pa.Array], out: list[tuple], types: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*keys, *[pa.array([r[k] for r in out], t) for k, t in enumerate(types)]], names=names)

        id_type = None
        for batch in slices(batches):
            id_type = batch.column(0).type
            has_chunks, has_names = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            ids, text_hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = _utf8(batch.column(2))
            for group in grouped(texts):
                of, out = [], []
                cut = Texts([texts[i] for i in group])
                held = sieve.holds(cut.chunk_hash) & has_chunks[group.start : group.stop][cut.chunk_of]
                held = np.flatnonzero(held)
                cut.take(held)
                last = (cut.chunk_bounds[cut.chunk_of[held] + 1] - 1).tolist()
                for k, i, at, end, h in zip(held.tolist(), cut.chunk_of[held].tolist(), cut.chunk_at[held].tolist(), last, cut.chunk_hash[held].tolist(), strict=True):
                    of.append(group[i])
                    out.append((CHUNK, at, h, b"\n".join(cut.held(k)), cut.unit_hashes(k - 1)[::-1] if at else [], cut.unit_hashes(k + 1) if k < end else [], None))
                found = Stretches(cut)
                held = np.flatnonzero(sieve.holds(found.names) & has_names[group.start : group.stop][found.of])
                windows, begins = found.windows(held)
                one_by_one = np.isin(found.names[held], crowded)
                whole, length = held[~one_by_one], found.length[held]
                if len(whole):
                    keys = [batch.column(c).take(pa.array(found.of[whole] + group.start)) for c in (0, 1)]
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(found.length[whole])].astype(np.int32)), pa.array(windows[np.repeat(~one_by_one, length)]))
                    stretches = [pa.array(np.full(len(whole), OPEN, np.int32)), pa.array(found.at[whole].astype(np.int32)), pa.array(found.names[whole]), *[pa.nulls(len(whole), t) for t in arrow[3:6]], lists]
                    yield pa.RecordBatch.from_arrays([*keys, *stretches], names=names)
                for s, begin in zip(held[one_by_one].tolist(), begins[one_by_one].tolist(), strict=True):
                    i, at, name = group[int(found.of[s])], int(found.at[s]), int(found.names[s])
                    for k, h in enumerate(windows[begin : begin + int(found.length[s])].tolist()):
                        if h and (given := earliest.later((name, h), (ids[i] is None, ids[i], text_hashes[i], at + k))):
                            of.append(None if given[1][1:] != (ids[i], text_hashes[i], at + k) else i)
                            out.append((given[0], given[1][3], _mixed_pair(name, h), None, None, None, [h], given[1][1:3]))
                if out:
                    keys = [pa.array([(ids[i], text_hashes[i])[c] if i is not None else row[7][c] for i, row in zip(of, out, strict=True)], t) for c, t in enumerate((id_type, pa.int64()))]
                    yield packed(keys, out, arrow)
        left = [(OPEN, place[3], _mixed_pair(*window), None, None, None, [window[1]], place[1:3]) for window, place in earliest.first.items()]
        for at in range(0, len(left), 10_000):
            part = left[at : at + 10_000]
            yield packed([pa.array([r[7][c] for r in part], t) for c, t in enumerate((id_type, pa.int64()))], part, arrow)

    picked = rows.where("chunked OR named").select("id", "text_hash", "text", "chunked", "named")
    return picked.mapInArrow(run, T.StructType([*picked.schema.fields[:2], *[T.StructField(n, t) for n, t in FOUND]]))


def _mixed_pair(name: int, h: int) -> int:
    return xxhash.xxh3_64_intdigest(name.to_bytes(8, "little", signed=True) + h.to_bytes(8, "little", signed=True)) - (1 << 63)


def _common(a: str, b: str) -> Column:
    """How many leading elements of two arrays are equal."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    return F.when(differs > 0, differs - 1).otherwise(F.size(a))


def cut_runs(text: str, repeated: dict[int, tuple[int, int]], min_words: int, windows: Iterable[int] = ()) -> tuple[str, int, int]:
    """The text without its runs of repeated chunks and its repeated windows, and the units and words removed.

    ``repeated`` gives for the number of a chunk of lines how many units of its neighbours
    belong to it. Numbers beyond those, and ``windows`` from 0, are of windows. A unit of
    which words stay is not counted as removed.
    """
    cut = Texts([text.encode("utf-8", "surrogatepass")])
    n = max(1, len(cut.heads))
    listed = sorted({*windows, *(k - n for k in repeated if k >= n)})
    return _cut(cut, 0, {k: v for k, v in repeated.items() if k < n}, min_words, np.array(listed, np.int64))


def _gone(cut: Texts, text: int, repeated: dict[int, tuple[int, int]], min_words: int) -> list[int]:
    """The units of a text's runs of repeated chunks."""
    c0, c1 = cut.chunk_bounds[text : text + 2].tolist()
    u0, u1 = cut.unit_bounds[text : text + 2].tolist()
    counts = (cut.unit_last[u0:u1] - cut.unit_first[u0:u1]).tolist()
    firsts = [0, *(cut.filled[cut.heads[c0 + 1 : c1]] - u0).tolist(), u1 - u0]
    gone, run = [], []

    def end_run() -> None:
        contents = [counts[u] for u in run if counts[u]]
        if len(contents) > 1 and sum(contents) >= min_words:
            gone.extend(run)
        run.clear()

    for k in range(c1 - c0):
        if k in repeated:
            run.extend(range(firsts[k], firsts[k + 1]))
            continue
        lead, tail = repeated.get(k - 1, (0, 0))[1], repeated.get(k + 1, (0, 0))[0]
        if not lead and not tail:
            if run:
                end_run()
            continue
        own = range(firsts[k], firsts[k + 1])
        places = [u for u in own if counts[u]]
        lead = min(lead, len(places))
        tail = min(tail, len(places) - lead)
        a = places[lead - 1] + 1 if lead else own.start
        b = places[len(places) - tail] if tail else own.stop
        run.extend(range(own.start, a))
        if b > a:
            end_run()
        run.extend(range(b, own.stop))
    end_run()
    return [u0 + u for u in gone]


def _cut(cut: Texts, text: int, repeated: dict[int, tuple[int, int]], min_words: int, windows: np.ndarray) -> tuple[str, int, int]:
    """:func:`cut_runs` for one of several texts."""
    begin, end = int(cut.begins[text]), int(cut.ends[text])
    w0, w1 = cut.word_bounds[text : text + 2].tolist()
    gone = _gone(cut, text, repeated, min_words) if repeated else []
    spans = []
    if gone:
        after = np.minimum(np.append(cut.unit_start, end)[np.array(gone) + 1], end)
        spans += zip(cut.unit_start[gone].tolist(), after.tolist(), strict=True)
    if len(windows):
        starts = np.append(cut.words.starts[w0:w1], end)
        spans += zip(starts[windows].tolist(), starts[windows + WINDOW].tolist(), strict=True)
    if not spans:
        return cut.texts[text].decode("utf-8", "surrogatepass"), 0, 0
    spans.sort()
    left, froms, tos, at = [], [], [], begin
    for a, b in spans:
        if b <= at and froms:
            continue
        if a > at or not froms:
            left.append(cut.data[at:a])
            froms.append(a)
            tos.append(b)
        else:
            tos[-1] = b
        at = b
    left.append(cut.data[at:end])
    own = cut.words.starts[w0:w1]
    # Whether each word lies in one of the spans: the last span that begins at or before it has not ended.
    last = np.searchsorted(froms, own, "right") - 1
    lost = np.append(0, np.cumsum((last >= 0) & (own < np.array(tos)[last])))
    u0, u1 = cut.unit_bounds[text : text + 2].tolist()
    first, after = cut.unit_first[u0:u1] - w0, cut.unit_last[u0:u1] - w0
    gone_units = int(((lost[after] - lost[first] == after - first) & (after > first)).sum())
    return b"".join(left).decode("utf-8", "surrogatepass"), gone_units, int(lost[-1])


def _same_place(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash")) & (F.col(f"{a}.at") == F.col(f"{b}.at"))


def _later_chunks(found: DataFrame) -> DataFrame:
    """(id, text_hash, at, n_before, n_after) of each chunk whose bytes equal those of an earlier occurrence elsewhere."""
    contents = found.where(F.col("kind") == CHUNK).select("hash", "id", "text_hash", "at", "content", "before", "after")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "at")
    first = contents.groupBy("hash").agg(F.min_by(F.struct("id", "text_hash", "at", "content", "before", "after"), place).alias("first")).select("hash", "first.*")
    c, f = contents.alias("c"), first.alias("f")
    later = c.join(f, (F.col("c.hash") == F.col("f.hash")) & (F.col("c.content") == F.col("f.content")) & ~_same_place("c", "f"))
    return later.select("c.id", "c.text_hash", "c.at", F.col("c.content").contains(F.lit("\n").cast("binary")).alias("several"), _common("c.before", "f.before").alias("n_before"), _common("c.after", "f.after").alias("n_after"))


def _later_windows(found: DataFrame) -> DataFrame:
    """(id, text_hash, block, mask): bit i of the mask is set if window 32 * block + i stands at an earlier place."""
    # Windows spread over the partitions by name, after which each name's windows are told apart.
    spread = found.where(F.col("kind") == OPEN).select("hash", "id", "text_hash", "at", "windows").repartition("hash")
    windows = spread.select("hash", "id", "text_hash", "at", F.posexplode("windows").alias("k", "window")).where("window <> 0")
    own = Window.partitionBy("hash", "window").orderBy(F.col("id").isNull(), "id", "text_hash", F.col("at") + F.col("k"))
    # Rows of one place, from repeated rows, have one rank. The sort spills, so a crowded window needs no memory.
    later = windows.withColumn("rank", F.rank().over(own)).where("rank > 1").select("id", "text_hash", (F.col("at") + F.col("k")).alias("at"))
    told = found.where(F.col("kind") == LATER).select("id", "text_hash", "at")
    bits = [F.shiftright("at", 5).alias("block"), F.bit_or(F.expr("shiftleft(1L, at & 31)")).alias("mask")]
    return later.groupBy("id", "text_hash", bits[0]).agg(bits[1]).union(told.groupBy("id", "text_hash", bits[0]).agg(bits[1]))


def _rewritten(marked: DataFrame, text_at: int, min_words: int) -> DataFrame:
    """``marked`` (row, key_id, rep_id, rep_text, entries) as (row, clean, removed_units, removed_words)."""
    schema = T.StructType([marked.schema["row"], T.StructField("clean", T.StringType()), T.StructField("removed_units", T.LongType()), T.StructField("removed_words", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            plain = ["" if t is None else t for t in batch.column(0).field(text_at).to_pylist()]
            keys, reps, rep_texts = (batch.column(k).to_pylist() for k in (1, 2, 3))
            lists = batch.column(4)
            ends = np.append(0, np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)))
            entries = lists.flatten()
            chunk, at, x, y = (entries.field(c).to_numpy(zero_copy_only=False) for c in ("chunk", "at", "x", "y"))
            copies = [r is not None and k != f for k, f, r in zip(keys, reps, rep_texts, strict=True)]
            # A copy is cut if its bytes are those of the first; others if their lists hold something.
            touched = [i for i, t in enumerate(plain) if (t == rep_texts[i] if copies[i] else ends[i + 1] > ends[i])]
            out = [(t, 0, 0) for t in plain]
            texts = [plain[i].encode("utf-8", "surrogatepass") for i in touched]
            for group in grouped(texts):
                cut = Texts([texts[j] for j in group])
                whole = [text for text, j in enumerate(group) if copies[touched[j]]]
                for text, listed in zip(whole, listed_windows(cut, whole) if whole else [], strict=True):
                    n = int(cut.chunk_bounds[text + 1] - cut.chunk_bounds[text])
                    out[touched[group[text]]] = _cut(cut, text, dict.fromkeys(range(n), (0, 0)), min_words, listed)
                for text, j in enumerate(group):
                    i = touched[j]
                    if copies[i]:
                        continue
                    own = slice(ends[i], ends[i + 1])
                    of_chunks = chunk[own].astype(bool)
                    repeated = dict(zip(at[own][of_chunks].tolist(), zip(x[own][of_chunks].tolist(), y[own][of_chunks].tolist(), strict=True), strict=True))
                    blocks, masks = at[own][~of_chunks].astype(np.int64), x[own][~of_chunks]
                    bits = (masks[:, None] >> np.arange(32) & 1).astype(bool)
                    out[i] = _cut(cut, text, repeated, min_words, (32 * blocks[:, None] + np.arange(32))[bits])
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", "clean", "removed_units", "removed_words"])

    return marked.mapInArrow(run, schema)


def _entries(rows: DataFrame, hashed: DataFrame) -> DataFrame:
    """(text_hash, id, entry) for what goes from the first of equal texts: its chunks and its blocks of windows."""
    repeated, parts = _repeated(hashed)
    n, total = (x or 0 for x in repeated.agg(F.sum("size"), F.sum("total")).first())
    sieve, crowded = _part_sieve(repeated, parts, n), _crowded(repeated, max(CROWD, total // CROWD_SHARE))
    holders = materialise(_holders(hashed, sieve).groupBy("text_hash").agg(F.min("id").alias("id"), F.bool_or("chunked").alias("chunked"), F.bool_or("named").alias("named"))
                          .withColumn("key", F.xxhash64("id", "text_hash")), "holders")
    found = materialise(_found(_flagged(rows, holders, "key", ["chunked", "named"]), sieve, crowded), "found")
    entry = lambda chunk, at, x, y, several: F.struct(F.lit(chunk).alias("chunk"), F.col(at).alias("at"), x.cast("long").alias("x"), y.cast("long").alias("y"), several.alias("several")).alias("entry")
    chunks_gone = _later_chunks(found).select("id", "text_hash", entry(True, "at", F.col("n_before"), F.col("n_after"), F.col("several")))
    windows_gone = _later_windows(found).select("id", "text_hash", entry(False, "block", F.col("mask"), F.lit(0), F.lit(True)))
    gone, own = chunks_gone.union(windows_gone).alias("g"), holders.alias("h")
    return gone.join(own, (F.col("g.text_hash") == F.col("h.text_hash")) & F.col("g.id").eqNullSafe(F.col("h.id")), "left_semi")


def _first_texts(rows: DataFrame, hashed: DataFrame) -> DataFrame:
    """(text_hash, rep_id, rep_text) of each text that stands under several ids: the smallest id, or null if all are."""
    counted = hashed.groupBy("text_hash").agg(F.min("id").alias("rep_id"), F.max("id").alias("last_id"), F.count_if(F.col("id").isNull()).alias("nulls"))
    copied = materialise(counted.where("rep_id <> last_id OR (rep_id IS NOT NULL AND nulls > 0)").select("text_hash", "rep_id", F.xxhash64("rep_id", "text_hash").alias("key")), "copied")
    picked = _flagged(rows, copied.select("key", F.lit(True).alias("first")), "key", ["first"]).where("first")
    c, r = copied.alias("c"), picked.select("id", "text_hash", "text").alias("r")
    whole = r.join(c, (F.col("r.text_hash") == F.col("c.text_hash")) & (F.col("r.id") == F.col("c.rep_id")))
    return whole.groupBy("c.text_hash", "c.rep_id").agg(F.min("r.text").alias("rep_text"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``row`` (all columns of ``docs``), ``clean`` text, ``removed_units`` and ``removed_words``.

    A null text counts as empty and comes back empty. Rows equal in id and text are one
    document, so such repeated rows all keep or lose the same chunks. Rows with a null id
    come after all others as first occurrences, and among them those of equal texts are one
    document. Ids may be of any type that Spark can sort. A very long text is handled by one
    task, in pieces of bounded size where its words are hashed. Columns of ``docs`` may
    bear any name. No rows give no rows.
    """
    rows = _rows(docs, id_col, text_col)
    hashed = materialise(_hashes(rows), "hashes")
    lists = _entries(rows, hashed).groupBy("text_hash").agg(F.collect_set("entry").alias("entries"))
    # A text in which all that repeats is single units apart from each other loses nothing.
    chunked = F.transform(F.filter("entries", lambda e: e["chunk"]), lambda e: e["at"])
    lists = lists.where(F.exists("entries", lambda e: e["several"] | (e["x"] + e["y"] > 0) | F.array_contains(chunked, e["at"] + 1)))
    info = materialise(lists.join(_first_texts(rows, hashed), "text_hash", "full"), "info")
    told = _flagged(rows, info.select("text_hash", F.lit(True).alias("touched")), "text_hash", ["touched"])
    own, known = told.where("touched").select("row", "id", "text_hash").alias("o"), info.alias("i")
    first = F.coalesce(F.col("i.rep_id"), F.col("o.id"))
    marked = own.join(known, F.col("o.text_hash") == F.col("i.text_hash"), "left").select("o.row", F.col("o.id").alias("key_id"), first.alias("rep_id"), "i.rep_text", "i.entries")
    same = told.where("NOT touched").select("row", F.col("text").alias("clean"), F.lit(0).cast("long").alias("removed_units"), F.lit(0).cast("long").alias("removed_words"))
    return same.union(_rewritten(marked, docs.columns.index(text_col), min_words))


def with_clean_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the cleaned texts in place of its own; texts that lost nothing are unchanged, nulls included."""
    def column(name: str) -> Column:
        own = F.col(f"row.`{name}`")
        return (F.when(F.col("removed_words") > 0, F.col("clean")).otherwise(own) if name == text_col else own).alias(name)

    return dedup_lines(docs, id_col, text_col, min_words).select(*[column(c) for c in docs.columns])
