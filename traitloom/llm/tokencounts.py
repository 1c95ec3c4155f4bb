"""Token counts that follow edits.

A document's pre-tokens are grouped into leaves of a few hundred characters, and a binary
tree over the leaves holds sums of characters and tokens. An edit descends by characters to
the leaves it touches, takes in a neighbouring leaf where the boundary would no longer be a
safe one, encodes that region again and updates the sums on the way up; all other leaves
keep their counts. The leaves' lengths and counts are kept in a table beside the texts, so
the next batch of edits encodes no more than what it touches. A boundary is safe where a run of white space begins: no pre-token of the
pattern crosses such a place, whatever stands further off.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: The least characters of a new leaf, and how many such an edited one may hold before the tree is built anew.
LEAF_CHARS, MOST_SHARED = 512, 4
CUT = re.compile(r"(?<=\S)[ \n]")
#: Personal data that the query masks, and what replaces it.
MASKS = ((re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.]*\d)"), "[IP]"), (re.compile(r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}"), "[PHONE]"),
         (re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), "[MAIL]"))
Edit = tuple[int, int, str]


def encoder(ranks_path: str, pattern: str) -> Callable[[str], int]:
    """The number of tokens of a text under a byte-level BPE vocabulary given as ranks."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text))


def leaf_texts(text: str) -> list[str]:
    """The text cut at the first safe boundary after every few hundred characters."""
    out, start = [], 0
    while start < len(text):
        found = CUT.search(text, start + LEAF_CHARS) if start + LEAF_CHARS < len(text) else None
        end = found.start() if found else len(text)
        out.append(text[start:end])
        start = end
    return out


def safe(left: str, right: str) -> bool:
    return not left[-1:].isspace() and right[:1] in (" ", "\n", "\t", "\r")


class TokenTree:
    """Sums over the leaves of one document; node 1 is the root, leaf i is node ``size + i``."""

    def __init__(self, leaves: list[str], tokens: list[int], count: Callable[[str], int]):
        self.count, self.leaves, self.encoded_chars = count, leaves, 0
        self._build(tokens)

    @classmethod
    def of(cls, text: str, count: Callable[[str], int]) -> TokenTree:
        leaves = leaf_texts(text)
        return cls(leaves, [count(x) for x in leaves], count)

    def _build(self, tokens: list[int]) -> None:
        self.size = 1
        while self.size < max(1, len(tokens)):
            self.size *= 2
        pad = [0] * (self.size - len(tokens))
        self.tokens = [0] * self.size + tokens + pad
        self.chars = [0] * self.size + [len(x) for x in self.leaves] + pad
        for node in range(self.size - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf starts; the last one beyond the end."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace the characters from ``start`` to ``end`` (exclusive), as far as they exist."""
        end = max(start, min(end, self.chars[1]))
        start = min(start, end)
        if not self.leaves:
            self.leaves = leaf_texts(replacement)
            self.encoded_chars += len(replacement)
            return self._build([self.count(x) for x in self.leaves])
        first, at = self.leaf_at(start)
        last = self.leaf_at(max(start, end - 1))[0]
        old = "".join(self.leaves[first : last + 1])
        region = old[: start - at] + replacement + old[end - at :]
        while first > 0 and (not self.leaves[first - 1] or not safe(self.leaves[first - 1], region)):
            first -= 1
            region = self.leaves[first] + region
        while last + 1 < len(self.leaves) and (not self.leaves[last + 1] or not safe(region or " ", self.leaves[last + 1])):
            last += 1
            region += self.leaves[last]
        self.encoded_chars += len(region)
        fresh, slots = leaf_texts(region), last + 1 - first
        # Neighbouring leaves may share a slot; slots that are left over stay empty.
        share = -(-len(fresh) // slots)
        if share <= MOST_SHARED:
            fresh = ["".join(fresh[i * share : (i + 1) * share]) for i in range(slots)]
            for leaf, text in enumerate(fresh, first):
                self.leaves[leaf] = text
                self.tokens[self.size + leaf], self.chars[self.size + leaf] = self.count(text), len(text)
            low, high = (self.size + first) // 2, (self.size + last) // 2
            while low:
                for node in range(low, high + 1):
                    self._sum(node)
                low, high = low // 2, high // 2
            return None
        kept = self.tokens[self.size : self.size + len(self.leaves)]
        self.leaves[first : last + 1] = fresh
        return self._build(kept[:first] + [self.count(x) for x in fresh] + kept[last + 1 :])


def masking_edits(text: str) -> list[Edit]:
    """Edits, last first, that replace network addresses, telephone numbers and mail addresses."""
    taken: list[Edit] = []
    for pattern, mask in MASKS:
        for m in pattern.finditer(text):
            if all(m.end() <= s or m.start() >= e for s, e, _ in taken):
                taken.append((m.start(), m.end(), mask))
    return sorted(taken, reverse=True)


def gather_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", edits_col: str = "edits") -> DataFrame:
    """``docs`` with ``edits_col`` (array of start, end, replacement) from a table with a ``seq`` column.

    The edits of one document depend on each other, so one task applies them in ``seq`` order.
    Those of a null id go to the rows of a null id. A column of ``docs`` by that name gives way.
    """
    listed = edits.groupBy(F.col(f"`{id_col}`").alias("__id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "replacement"))), lambda e: e.dropFields("seq")).alias("__edits"))
    kept = docs.drop(edits_col)
    return kept.join(listed, kept[f"`{id_col}`"].eqNullSafe(F.col("__id")), "left").drop("__id").withColumnRenamed("__edits", edits_col)


LEAVES = T.ArrayType(T.StructType([T.StructField("chars", T.IntegerType()), T.StructField("tokens", T.IntegerType())]))


def _each(picked: DataFrame, made: list[tuple[str, T.DataType]], ranks_path: str, pattern: str, row) -> DataFrame:
    """``picked`` (key, text, more) as key, then the columns that ``row(count, text, more)`` makes."""
    schema = T.StructType([picked.schema[0], *[T.StructField(n, t) for n, t in made]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, kinds = encoder(ranks_path, pattern), [to_arrow_type(t) for _, t in made]
        for batch in batches:
            out = [row(count, text or "", more) for text, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist() if batch.num_columns > 2 else repeat(None, batch.num_rows), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]], names=schema.names)

    return picked.mapInArrow(run, schema)


def _picked(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"), *more)


def _kept_leaves(tree: TokenTree) -> list[dict]:
    return [{"chars": len(x), "tokens": n} for x, n in zip(tree.leaves, tree.tokens[tree.size :], strict=False) if x]


def count_leaves(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table that edits work on: the id, ``text``, ``leaves`` (array of chars, tokens) and ``n_tokens``.

    A null or empty text has no leaves and no tokens. Repeated rows and null ids are rows like
    others. No rows give no rows.
    """
    def row(count, text: str, _) -> tuple:
        tree = TokenTree.of(text, count)
        return text, _kept_leaves(tree), tree.total

    made = [("text", T.StringType()), ("leaves", LEAVES), ("n_tokens", T.LongType())]
    return _each(_picked(docs, id_col, text_col), made, ranks_path, pattern, row).withColumnRenamed("key", id_col)


def apply_edits(counted: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", edits_col: str = "edits", changed_only: bool = False) -> DataFrame:
    """A table of :func:`count_leaves` after the edits of ``edits_col``, with ``encoded_chars``, what they had encoded again.

    Rows without edits are taken over as they are and never leave the JVM; of the others the
    leaves that no edit touches keep their counts. ``changed_only`` gives the rows with edits
    alone, so that a versioned table need only write these.
    """
    def row(count, text: str, more: dict) -> tuple:
        leaves, at, tokens = [], 0, []
        for leaf in more["leaves"] or []:
            leaves.append(text[at : at + leaf["chars"]])
            tokens.append(leaf["tokens"])
            at += leaf["chars"]
        tree = TokenTree(leaves, tokens, count)
        for e in more["edits"] or []:
            tree.edit(e["start"], e["end"], e["replacement"] or "")
        return tree.text(), _kept_leaves(tree), tree.total, tree.encoded_chars

    made = [("text", T.StringType()), ("leaves", LEAVES), ("n_tokens", T.LongType()), ("encoded_chars", T.LongType())]
    more = F.struct(F.col("leaves"), F.col(f"`{edits_col}`").alias("edits")).alias("more")
    edited = F.coalesce(F.size(f"`{edits_col}`") > 0, F.lit(False))
    changed = _each(_picked(counted.where(edited), id_col, "text", more), made, ranks_path, pattern, row).withColumnRenamed("key", id_col)
    if changed_only:
        return changed
    same = counted.where(~edited).select(F.col(f"`{id_col}`"), F.coalesce("text", F.lit("")).alias("text"), "leaves", "n_tokens", F.lit(0).cast("long").alias("encoded_chars"))
    return changed.union(same)


def recount(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """Per row: the id, ``n_tokens``, ``n_edits``, ``n_tokens_after`` and ``encoded_chars`` (by the edits alone).

    Edits come from ``edits_col`` (places count code points of the text as the edits before
    left it), else they mask personal data. A null or empty text has no tokens; a null list
    no edits; places beyond the end mean the end. Repeated rows and null ids are rows like
    others; columns other than those named are not read, whatever their names. A very long
    text is one row's work. No rows give no rows.
    """
    def row(count, text: str, given: list | None) -> tuple:
        tree = TokenTree.of(text, count)
        before = tree.total
        edits = [(e["start"], e["end"], e["replacement"] or "") for e in given or []] if edits_col else masking_edits(text)
        for e in edits:
            tree.edit(*e)
        return before, len(edits), tree.total, tree.encoded_chars

    made = [(n, T.LongType()) for n in ("n_tokens", "n_edits", "n_tokens_after", "encoded_chars")]
    more = [F.col(f"`{edits_col}`").alias("edits")] if edits_col else []
    return _each(_picked(docs, id_col, text_col, *more), made, ranks_path, pattern, row).withColumnRenamed("key", id_col)
