"""Looking for the entries of a dictionary table in texts.

The distinct entries become Aho-Corasick automata, each of a bounded number of bytes: as many
blocks as the dictionary's measured size calls for, each sent to all tasks by itself. An
automaton passes over a text once, however many entries it has. With one block the matches
of a text are settled where the text is; with more, entries that stand as words are joined
with the texts' runs of words, and only places are brought together. Parts of words are
looked for by passing over the texts once for each block.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitloom.sources.scratch import materialise

#: Shapes of entries that are looked up by a join; what has others goes through automata.
MOST_SHAPES = 32
SHAPE = ("words", "lead", "tail")
WORD = re.compile("[A-Za-z0-9]+")
#: Bytes of the entries of one automaton, which are sent to all tasks; the automaton takes about thirty times as much.
BLOCK_BYTES = 8 << 20
#: Rows whose texts are Python objects at a time.
ROWS = 256
PLACE = T.StructType([T.StructField("loose", T.BooleanType()), T.StructField("entry", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("found", T.StringType())])
ARROW_PLACE = pa.list_(pa.struct([("loose", pa.bool_()), ("entry", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("found", pa.string())]))

_built: dict[str, dict[bool, ahocorasick.Automaton]] = {}


def folded(text: str) -> str:
    """Small letters, place by place: a letter whose small form is longer stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _automata(name: str, entries: list[tuple[bool, str]]) -> dict[bool, ahocorasick.Automaton]:
    """The automata of a block, kept for the next task of this worker."""
    if name not in _built:
        _built.clear()
        made: dict[bool, ahocorasick.Automaton] = {}
        for loose, entry in entries:
            made.setdefault(loose, ahocorasick.Automaton()).add_word(entry, entry)
        for automaton in made.values():
            automaton.make_automaton()
        _built[name] = made
    return _built[name]


def _bounded(text: str, start: int, end: int) -> bool:
    """No letter or digit stands before the place or after it."""
    return not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())


def settled(places: list[tuple]) -> list[tuple]:
    """From left to right the longest of the places (loose, entry, start, end, ...) that begin first, none over another of its kind."""
    out, last = [], {}
    for place in sorted(places, key=lambda p: (not p[0], p[2], -p[3])):
        if place[2] >= last.get(place[0], 0):
            out.append(place)
            last[place[0]] = place[3]
    return out


def blocks_of(entries: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The distinct entries (loose, entry) dealt by hash into blocks of about so many bytes."""
    distinct = entries.where("entry <> ''").select(F.coalesce("loose", F.lit(False)).alias("loose"), "entry").distinct()
    total = distinct.agg(F.coalesce(F.sum(F.octet_length("entry") + 8), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    return [distinct.where(F.pmod(F.xxhash64("loose", "entry"), F.lit(n)) == k) for k in range(n)] if n > 1 else [distinct]


def _places(texts: DataFrame, block: DataFrame, bounded: bool, settle: bool) -> DataFrame:
    """Texts (id, text) and the places of a block's entries: all bounded ones, or of each entry the first, by itself."""
    name = uuid.uuid4().hex
    held = texts.sparkSession.sparkContext.broadcast([(r["loose"], r["entry"]) for r in block.collect()])

    def of(text: str | None, automata: dict[bool, ahocorasick.Automaton]) -> list[dict]:
        found: list[tuple] = []
        for loose, automaton in automata.items():
            hay = folded(text or "") if loose else text or ""
            if bounded:
                found += [(loose, entry, start, last + 1) for last, entry in automaton.iter(hay) if _bounded(hay, start := last + 1 - len(entry), last + 1)]
            else:
                first: dict[str, int] = {}
                for last, entry in automaton.iter(hay):
                    first.setdefault(entry, last)
                found += [(loose, entry, last + 1 - len(entry), last + 1) for entry, last in first.items()]
        if settle:
            seen: dict[tuple, tuple] = {}
            for p in settled(found):
                seen.setdefault(p[:2], p)
            found = list(seen.values())
        return [{"loose": p[0], "entry": p[1], "start": p[2], "end": p[3], "found": text[p[2] : p[3]]} for p in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(name, held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([of(t.as_py(), automata) for t in part.column(1)], ARROW_PLACE), part.column(2)], names=["id", "places", "own"])

    own = F.xxhash64("text") if not settle and bounded else F.lit(0).cast("long")
    picked = texts.select("id", "text", own.alias("own"))
    return picked.mapInArrow(run, T.StructType([picked.schema["id"], T.StructField("places", T.ArrayType(PLACE)), T.StructField("own", T.LongType())]))


def find_entries(texts: DataFrame, entries: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, loose, entry, start, end, found): the entries that stand in texts (id, text) as words, each at its first place.

    ``entries`` has (loose, entry); loose ones are in small letters and match in any case.
    From left to right the longest entry that begins first is taken, loose and exact ones
    apart. A null text holds nothing, an empty entry is found nowhere.
    """
    blocks = blocks_of(entries, block_bytes)
    if len(blocks) == 1:
        found = _places(texts, blocks[0], bounded=True, settle=True)
        return found.select("id", F.inline("places"))
    every = _looked_up(texts, entries, block_bytes)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, out = batch.slice(at, ROWS), []
                for places in part.column(1).to_pylist():
                    seen: dict[tuple, dict] = {}
                    for p in settled([(r["loose"], r["entry"], r["start"], r["end"], r["found"]) for r in places]):
                        seen.setdefault(p[:2], dict(zip(("loose", "entry", "start", "end", "found"), p, strict=True)))
                    out.append(list(seen.values()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, ARROW_PLACE)], names=["id", "places"])

    placed = every.groupBy("id", "own").agg(F.collect_set(F.struct("loose", "entry", "start", "end", "found")).alias("places")).select("id", "places")
    return placed.mapInArrow(settle, T.StructType([texts.schema["id"], T.StructField("places", T.ArrayType(PLACE))])).select("id", F.inline("places"))


def _shaped(entries: DataFrame) -> DataFrame:
    """The entries with their shape: how many words they have, and how many characters before the first and after the last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = []
            for entry in batch.column(1).to_pylist():
                starts, ends = _word_bounds(entry)
                shapes.append((len(starts), starts[0], len(entry) - ends[-1]) if starts else (0, 0, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([x[i] for x in shapes], pa.int32()) for i in range(3)]], names=["loose", "entry", *SHAPE])

    return entries.select("loose", "entry").mapInArrow(run, "loose boolean, entry string, words int, lead int, tail int")


def _word_bounds(text: str) -> tuple[list[int], list[int]]:
    """Where the runs of letters and digits of a text begin and end."""
    runs = [m.span() for m in WORD.finditer(text)] if text.isascii() else [(g[0], g[-1] + 1) for alnum, own in groupby(range(len(text)), lambda i: text[i].isalnum()) if alnum for g in [list(own)]]
    return [x[0] for x in runs], [x[1] for x in runs]


def _sieve(entries: DataFrame) -> bytes:
    """A bit for each entry's hash; beyond 2^28 bits it lets more through, and what it lets through is joined in any case."""
    bits = min(28, max(13, (16 * entries.count()).bit_length()))
    h = F.crc32(F.concat(F.when(F.col("loose"), "~").otherwise(""), F.col("entry")).cast("binary")).bitwiseAND(F.lit((1 << bits) - 1))
    cells = entries.select(h.alias("h")).groupBy(F.shiftright("h", 5).cast("int").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h & 31 AS INT))")).alias("set")).toArrow()
    held = np.zeros(1 << (bits - 5), np.uint32)
    held[cells["cell"].to_numpy()] = cells["set"].to_numpy().astype(np.uint32)
    return held.tobytes()


def _looked_up(texts: DataFrame, entries: DataFrame, block_bytes: int) -> DataFrame:
    """(id, own, loose, entry, start, end, found): all bounded places, by an equality join of the texts' runs of words with the entries.

    A bounded place begins and ends with whole words but for an entry's outer marks, so each
    run of words of a shape that entries have is a candidate; a sieve keeps most others from
    the join. Each text is passed over once, however many entries there are. Entries without
    a word or of a rare shape, beyond the commonest ones, go through automata.
    """
    shaped = materialise(_shaped(blocks_of(entries, 1 << 62)[0]), "entries")
    common = shaped.where("words > 0").groupBy("loose", *SHAPE).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "loose", *SHAPE).limit(MOST_SHAPES).drop("n").collect()
    shapes = {flag: [(r["words"], r["lead"], r["tail"]) for r in common if r["loose"] == flag] for flag in (True, False)}
    known = texts.sparkSession.createDataFrame(common, "loose boolean, words int, lead int, tail int") if common else shaped.select("loose", *SHAPE).limit(0)
    chosen, rest = (shaped.join(F.broadcast(known), ["loose", *SHAPE], how).select("loose", "entry") for how in ("left_semi", "left_anti"))
    held = texts.sparkSession.sparkContext.broadcast(_sieve(chosen))
    mark = zlib.crc32(b"~")

    def of(text: str | None, bits: np.ndarray, mask: int) -> list[dict]:
        found = []
        for loose, own in shapes.items():
            if not own or not text:
                continue
            hay = folded(text) if loose else text
            starts, ends = _word_bounds(hay)
            for words, lead, tail in own:
                for i in range(len(starts) - words + 1):
                    start, end = starts[i] - lead, ends[i + words - 1] + tail
                    if start < 0 or end > len(hay):
                        continue
                    entry = hay[start:end]
                    h = zlib.crc32(entry.encode("utf-8", "surrogatepass"), mark if loose else 0) & mask
                    if bits[h >> 5] >> (h & 31) & 1 and _bounded(hay, start, end):
                        found.append({"loose": loose, "entry": entry, "start": start, "end": end, "found": text[start:end]})
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = memoryview(held.value).cast("I")
        mask = len(bits) * 32 - 1
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([of(t.as_py(), bits, mask) for t in part.column(1)], ARROW_PLACE), part.column(2)], names=["id", "places", "own"])

    picked = texts.select("id", "text", F.xxhash64("text").alias("own"))
    fields = T.StructType([picked.schema["id"], T.StructField("places", T.ArrayType(PLACE)), T.StructField("own", T.LongType())])
    met = picked.mapInArrow(run, fields).select("id", "own", F.inline("places")).join(chosen, ["loose", "entry"], "left_semi")
    columns = ["id", "own", "loose", "entry", "start", "end", "found"]
    if rest.isEmpty():
        return met.select(*columns)
    return reduce(DataFrame.unionByName, [met.select(*columns), *[_places(texts, b, bounded=True, settle=False).select("id", "own", F.inline("places")) for b in blocks_of(rest, block_bytes)]])


def held_parts(texts: DataFrame, entries: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, entry): the entries that texts (id, text) hold anywhere, as parts of words too, each once for each row."""
    exact = entries.select(F.lit(False).alias("loose"), "entry")
    found = [_places(texts, b, bounded=False, settle=False) for b in blocks_of(exact, block_bytes)]
    return reduce(DataFrame.unionByName, found).select("id", F.inline("places")).select("id", "entry")


def match_catalog(texts: DataFrame, catalog: DataFrame, least_long: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, name, tradition, alias): entities of a catalogue named in texts (id, text), each once by its first surface.

    ``catalog`` has (name, tradition, aliases). Names of ``least_long`` letters or more match in
    any case, shorter ones and aliases exactly; names in any case count as earlier. A null
    or empty name or alias is no surface. Several entities may share one.
    """
    loose = F.length("name") >= least_long
    surfaces = catalog.select("name", "tradition", F.coalesce(loose, F.lit(False)).alias("loose"), F.when(loose, F.lower("name")).otherwise(F.col("name")).alias("entry")).union(
        catalog.select("name", "tradition", F.lit(False).alias("loose"), F.explode("aliases").alias("entry"))).where("entry <> ''").distinct()
    found = find_entries(texts, surfaces.select("loose", "entry"), block_bytes)
    named = found.join(surfaces, ["loose", "entry"])
    return named.groupBy("id", "name", "tradition").agg(F.min(F.struct((~F.col("loose")).alias("exact"), "start", "found"))["found"].alias("alias"))
