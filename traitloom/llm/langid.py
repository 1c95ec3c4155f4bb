"""Language identification by compression.

Each language has a raw-content zstandard dictionary made from a bounded sample of its
texts. A text is compressed with each dictionary, in blocks small enough that the dictionary
stays in reach and in small letters; the language with the smallest total wins, and a narrow margin is a rejection.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of the training sample: documents of a language, characters of a document (from
#: its middle), and bytes of a dictionary, of which each sample has an equal share.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 256, 96 << 10
BLOCK_BYTES, LEVEL = 4096, 6
#: A language is rejected if the next best is less than this share larger.
NARROW = 0.01
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def held_out(id_col: str) -> Column:
    """Rows kept from training: CRC-32 of the id as text is 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Dictionary content by language, from the ``sample_docs`` documents of smallest id hash."""
    own, lang, text = F.col(f"`{id_col}`"), F.col(f"`{lang_col}`"), F.col(f"`{text_col}`")
    usable = docs.where(lang.isNotNull() & text.isNotNull() & ~held_out(id_col))
    order = F.xxhash64(own.cast("string"))
    keyed = usable.select(lang.alias("lang"), order.alias("order"))
    counts = {r["lang"]: r["n"] for r in keyed.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    # Hashes spread evenly, so those below a bound by a language's count hold the smallest ones;
    # if repeated rows leave too few, the bound is moved.
    share = 8 * sample_docs
    while True:
        bound, whole = F.lit(None).cast("long"), all(share >= n for n in counts.values())
        for name, n in counts.items():
            bound = F.when(F.col("lang") == name, F.lit(min(2**63 - 1, -(2**63) + 2**64 * share // n))).otherwise(bound)
        ranked = keyed.where(F.col("order") <= bound).distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).where(F.col("rank") <= sample_docs)
        last = {r["lang"]: (r["last"], r["n"]) for r in ranked.groupBy("lang").agg(F.max("order").alias("last"), F.count("*").alias("n")).collect()}
        if whole or all(last.get(name, (0, 0))[1] == sample_docs or share >= n for name, n in counts.items()):
            break
        share *= 8
    bound = F.lit(None).cast("long")
    for name, (most, _) in last.items():
        bound = F.when(lang == name, F.lit(most)).otherwise(bound)
    middle = F.greatest(F.lit(1), (F.length(text) - SAMPLE_CHARS) / 2 + 1).cast("int")
    picked = usable.where(order <= bound).select(lang.alias("lang"), order.alias("order"), F.substr(text, middle, F.lit(SAMPLE_CHARS)).alias("sample"))
    samples: dict[str, list[bytes]] = {}
    for row in picked.groupBy("lang", "order").agg(F.min("sample").alias("sample")).orderBy("lang", "order").collect():
        samples.setdefault(row["lang"], []).append(row["sample"].lower().encode("utf-8"))
    return {k: b"\n".join(x[: max(1, DICTIONARY_BYTES // len(v) - 1)] for x in v) + b"\n" for k, v in sorted(samples.items())}


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        self.compress = {}
        for lang, data in content.items():
            dictionary = zstandard.ZstdCompressionDict(data.ljust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            self.compress[lang] = zstandard.ZstdCompressor(dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False).compress

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, margin (0 to 1) and whether the margin is too narrow to trust."""
        if not self.compress or not text or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        data = text.lower().encode("utf-8")
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        sizes = sorted((sum(map(len, map(compress, blocks))), lang) for lang, compress in self.compress.items())
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return sizes[0][1], margin, margin < NARROW


def identify(docs: DataFrame, content: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``lang_pred``, ``score`` (margin, 0 to 1) and ``rejected``.

    Null texts and texts without a letter are ``und``; so is everything if nothing was
    learned. Equal sizes are settled by the language's name. Repeated rows and null ids are
    rows like others; columns other than the id and the text are not read, whatever their
    names. A very long text is compressed block by block. No rows give no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(content)
        for batch in batches:
            out = [classify(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "lang_pred", "score", "rejected"])

    picked = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    made = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())]
    return picked.mapInArrow(run, T.StructType([picked.schema[0], *[T.StructField(n, t) for n, t in made]]))
