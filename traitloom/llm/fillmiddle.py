"""Fill-in-the-middle: a text is cut at two unit boundaries and its middle goes to the end.

A unit is a match of a pattern, a line unless said otherwise. A text is passed over twice
with a lazy matcher: the first pass counts the units, the second advances to both ranks and
stops; no list of units is ever made, so beside the text and its output memory is constant.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitloom.llm.shared import slices

#: A line with its end, or what follows the last one.
LINES = r"[^\n]*\n|[^\n]+"
#: The marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred texts, how many are cut, and of a hundred cut ones, how many begin with the suffix.
RATE, SUFFIX_FIRST, SEED = 100, 50, 7
ROWS = 64


def draws(seed: int, key: str) -> list[int]:
    """Four unsigned 32-bit numbers that depend on the seed and the key alone."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def places(unit: re.Pattern[str], text: str, low: int, high: int) -> tuple[int, int]:
    """Where the first ``low`` and the first ``high`` units end."""
    ends, matches, rank = [0, 0], unit.finditer(text), 0
    for k, wanted in enumerate((low, high)):
        ends[k] = ends[0]
        while rank < wanted:
            ends[k] = next(matches).end()
            rank += 1
    return ends[0], ends[1]


def rearranged(text: str, key: str, unit: re.Pattern[str], marks: tuple[str, str, str], rate: int, suffix_first: int, seed: int) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, characters of the prefix and of the middle, and the output."""
    first, second, whether, order = draws(seed, key)
    n = sum(1 for _ in unit.finditer(text))
    if not text or whether % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    start, end = places(unit, text, low, high)
    prefix, middle, suffix = marks[0] + text[:start], marks[2] + text[start:end], marks[1] + text[end:]
    spm = order % 100 < suffix_first
    return n, "spm" if spm else "psm", start, end - start, "".join((suffix, prefix, middle) if spm else (prefix, suffix, middle))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINES, marks: tuple[str, str, str] = MARKS,
                   rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """Per row: the id, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    The cuts and the form follow from the seed and the id, so repeated rows give equal
    outputs and a task that runs again gives what it gave before; a null id counts as an
    empty one. Null texts are empty; empty texts, and those that hold a mark, stay plain, and
    plain ones have no cuts (null). Both cuts may fall on one place, and then the middle is
    empty. The pattern must cover the text without gaps, as lines do. A very long text is one
    row like any other. Other columns are not read, whatever their names. No rows give no rows.
    """
    compiled = re.compile(unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            keys, texts = batch.column(1).to_pylist(), batch.column(2)
            made = [rearranged(texts[k].as_py() or "", key or "", compiled, marks, rate, suffix_first, seed) for k, key in enumerate(keys)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]], names=schema.names)

    own = F.col(f"`{id_col}`")
    picked = docs.select(own, own.cast("string").alias("fim_key"), F.col(f"`{text_col}`").alias("fim_text"))
    made = (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType()))
    schema = T.StructType([T.StructField(id_col, picked.schema[0].dataType), *[T.StructField(n, t) for n, t in made]])
    return picked.mapInArrow(run, schema)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text of an output and its form alone: the parts between the marks, in the order of the text.

    No text that was cut holds a mark, so each mark stands once.
    """
    def between(first: str, last: str | None) -> Column:
        after = F.substring_index(output, first, -1)
        return F.substring_index(after, last, 1) if last else after

    p, s, m = marks
    return (F.when(form == "psm", F.concat(between(p, s), between(m, None), between(s, m)))
            .when(form == "spm", F.concat(between(p, m), between(m, None), between(s, p))).otherwise(output))
