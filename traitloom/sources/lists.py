"""Lists of wanted works as CSV, JSON or text, whole files as rows (path, content), and their items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.functions.text import let
from traitloom.sources.records import list_rows

#: Column headings by what they mean, and the most items of a list.
HEADINGS = {"title": ("title", "name", "work", "source", "text"), "author": ("author", "writer", "attributed to"), "language": ("language", "lang"), "url": ("url", "link", "text_url")}
MOST_ITEMS = 200
ITEMS = "array<struct<title:string,author:string,language:string,url:string>>"


def csv_cells(line: Column) -> Column:
    """The trimmed cells of a line; quotes hold commas, doubled quotes stand for one."""
    cells = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(r'((?:[^,"]++|"(?:[^"]++|"")*+"?)*+),'), F.lit(1))
    bare = lambda c: F.replace(F.replace(F.replace(c, F.lit('""'), F.lit("\0")), F.lit('"'), F.lit("")), F.lit("\0"), F.lit('"'))
    return F.transform(cells, lambda c: F.trim(F.when(c == '""', F.lit("")).otherwise(bare(c))))


def _clean(title: Column, author: Column, language: Column, url: Column) -> Column:
    """An item with its blanks tidied; empty fields are null."""
    tidy = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    return F.struct(tidy(title).alias("title"), tidy(author).alias("author"), F.nullif(F.lower(F.trim(language)), F.lit("")).alias("language"), F.nullif(F.trim(url), F.lit("")).alias("url"))


def csv_items(content: Column) -> Column:
    """Items by the columns that a heading names, in any order; without headings the first two are title and author."""
    lines = F.filter(F.split(content, "\r?\n"), lambda x: F.trim(x) != "")

    def read(rows: Column) -> Column:
        heads = F.transform(F.get(rows, F.lit(0)), lambda c: F.lower(c))
        place = lambda names: F.array_position(F.transform(heads, lambda c: c.isin(*names)), F.lit(True)).cast("int") - 1

        def items(at: Column) -> Column:
            headed = at["title"] >= 0
            cell = lambda row, name, otherwise: F.when(headed, F.when(at[name] >= 0, F.get(row, at[name]))).otherwise(F.get(row, F.lit(otherwise)) if otherwise is not None else F.lit(None).cast("string"))
            data = F.when(headed, F.slice(rows, F.lit(2), F.greatest(F.lit(0), F.size(rows) - 1))).otherwise(rows)
            return F.transform(data, lambda r: _clean(cell(r, "title", 0), cell(r, "author", 1), cell(r, "language", None), cell(r, "url", None)))

        return let(F.struct(*[place(names).alias(n) for n, names in HEADINGS.items()]), items)

    return F.when(F.size(lines) > 0, let(F.transform(lines, csv_cells), read)).otherwise(F.array().cast(ITEMS))


def txt_items(content: Column) -> Column:
    null = F.lit(None).cast("string")
    return F.transform(list_rows(content), lambda x: _clean(x["title"], x["author"], null, null))


def json_entries(content: Column) -> Column:
    """The entries of an array, or of an object's ``items`` or ``sources``; null for anything else."""
    whole = F.try_parse_json(content)
    return F.coalesce(*[F.try_variant_get(whole, p, "array<variant>") for p in ("$", "$.items", "$.sources")])


def _string(entry: Column, path: str) -> Column:
    value = F.try_variant_get(entry, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(entry, path, "string"))


def json_items(content: Column) -> Column:
    """Items of strings, which are titles, or of objects with a title under one of its names."""
    def item(e: Column) -> Column:
        title = F.coalesce(_string(e, "$"), *[_string(e, f"$.{n}") for n in ("title", "name", "work", "source")])
        return _clean(title, *[_string(e, f"$.{n}") for n in ("author", "language", "url")])

    return F.coalesce(F.transform(json_entries(content), item), F.array().cast(ITEMS))


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows (path, content); a list is short, so a file is a row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def parse_lists(files: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """(path, name, items, error) of lists (path, content): each title and author once, in order.

    ``error`` says why a list is refused, and its items are none: an unknown kind of file, no
    name, broken JSON, an entry without a title, an address that is not https, no items, or
    more than ``most``.
    """
    base = F.element_at(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), -1)
    kind = F.lower(F.regexp_extract(base, r"\.([A-Za-z0-9]+)$", 1))
    content = F.coalesce("content", F.lit(""))
    raw = files.select("path", F.trim(F.regexp_replace(base, r"(?i)\.(csv|json|txt|text)$", "")).alias("name"), kind.alias("kind"),
                       F.when(kind == "csv", csv_items(content)).when(kind == "json", json_items(content)).otherwise(txt_items(content)).alias("items"),
                       F.when(kind == "json", json_entries(content).isNull()).otherwise(F.lit(False)).alias("broken"))
    key = lambda x: F.concat(F.lower(x["title"]), F.lit("|"), F.lower(F.coalesce(x["author"], F.lit(""))))
    titled = F.filter("items", lambda x: x["title"].isNotNull())
    new = lambda at: F.filter(at, lambda x, i: F.coalesce(F.get(at, i - 1)["key"] != x["key"], F.lit(True)))
    # Equal keys stand side by side once sorted, so that a long list takes no comparison of all with all.
    unique = let(titled, lambda own: let(F.array_sort(F.transform(own, lambda x, i: F.struct(key(x).alias("key"), i.alias("i")))), lambda at: F.transform(F.array_sort(F.transform(new(at), lambda x: x["i"])), lambda i: F.get(own, i))))
    named = raw.withColumn("unique", unique)
    bad_url = F.exists("items", lambda x: x["url"].isNotNull() & ~x["url"].rlike("(?i)^https://"))
    error = (F.when(F.col("name") == "", "no name").when(~F.col("kind").isin("csv", "json", "txt", "text", ""), F.concat(F.lit("unsupported file type ."), "kind")).when(F.col("broken"), "broken JSON")
             .when((F.col("kind") == "json") & F.exists("items", lambda x: x["title"].isNull()), "an entry without a title").when(bad_url, "an address that is not https")
             .when(F.size("unique") == 0, "no items").when(F.size("unique") > most, F.concat_ws(" ", F.size("unique"), F.lit("items, at most"), F.lit(most))))
    return named.select("path", "name", F.when(error.isNull(), F.col("unique")).otherwise(F.array().cast(ITEMS)).alias("items"), error.alias("error"))
