"""Recipes that turn downloaded files into Markdown, how well each suits a file, and the choice between them.

PDF, scanned pages and Word documents are read elsewhere: their recipes are suggested here,
and what they hold is brought in as text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.functions.text import cleanup_transcription, looks_wrapped
from traitloom.functions.web import html_title, is_index_page
from traitloom.functions.wiki import html_to_markdown, wikitext_to_markdown

#: Fixed value: a text of fewer characters is none.
LEAST_CHARS = 400
WORD_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def _is(path: Column, kind: Column, extension: str, name: str) -> Column:
    return path.rlike(rf"(?i)\.{extension}$") | F.coalesce(kind == name, F.lit(False))


def _html(path: Column, kind: Column) -> Column:
    return _is(path, kind, "html?", "text/html")


def revision_text(payload: Column) -> Column:
    """The wiki text of the first page's first revision in a query's result; null if there is none."""
    pages = F.get_json_object(payload, "$.query.pages")
    slots = "revisions array<struct<content:string,`*`:string,slots:struct<main:struct<content:string,`*`:string>>>>"
    listed = F.coalesce(F.from_json(pages, f"array<struct<{slots.replace(' ', ':', 1)}>>"), F.map_values(F.from_json(pages, f"map<string,struct<{slots.replace(' ', ':', 1)}>>")))
    first = F.get(F.get(listed, F.lit(0))["revisions"], F.lit(0))
    return F.coalesce(first["slots"]["main"]["content"], first["slots"]["main"]["*"], first["content"], first["*"])


@dataclass(frozen=True)
class Recipe:
    """``suits`` scores a file (path, content type, payload) from 0 to 100; ``run`` gives its Markdown, or None if it is read elsewhere."""

    name: str
    suits: Callable[[Column, Column, Column], Column]
    run: Callable[[Column], Column] | None


#: In order of preference where scores are equal.
RECIPES = (
    Recipe("mediawiki-revision-json", lambda p, k, t: F.when(_is(p, k, "json", "application/json") & revision_text(t).isNotNull(), 95).otherwise(0), lambda t: wikitext_to_markdown(revision_text(t))),
    Recipe("html-index-crawl", lambda p, k, t: F.when(_html(p, k), F.when(is_index_page(t), 90).otherwise(20)).otherwise(0), None),
    Recipe("html-single-page", lambda p, k, t: F.when(_html(p, k), F.when(is_index_page(t), 30).otherwise(80)).otherwise(0), html_to_markdown),
    Recipe("pdf-text", lambda p, k, t: F.when(_is(p, k, "pdf", "application/pdf"), 90).when(F.startswith(t, F.lit("%PDF-")), 80).otherwise(0), None),
    Recipe("pdf-ocr", lambda p, k, t: F.when(_is(p, k, "pdf", "application/pdf"), 10).otherwise(0), None),
    Recipe("docx", lambda p, k, t: F.when(_is(p, k, "docx", WORD_TYPE), 95).otherwise(0), None),
    Recipe("ocr-cleanup", lambda p, k, t: F.when(_html(p, k) | p.rlike(r"(?i)\.(pdf|docx)$"), 0).when(looks_wrapped(t), 85).otherwise(25), cleanup_transcription),
)


def suggested(path: Column, kind: Column, payload: Column, recipes: tuple[Recipe, ...] = RECIPES) -> Column:
    """The name of the recipe that suits a file best, the first of equals; null if none does."""
    scores = F.array(*[F.struct(F.coalesce(r.suits(path, kind, F.coalesce(payload, F.lit(""))), F.lit(0)).alias("score"), F.lit(-i).alias("order"), F.lit(r.name).alias("name")) for i, r in enumerate(recipes)])
    best = F.array_max(scores)
    return F.when(best["score"] > 0, best["name"])


def extract(files: DataFrame, recipes: tuple[Recipe, ...] = RECIPES) -> DataFrame:
    """Files (path, content_type, payload) with ``recipe``, ``markdown`` and ``error``; the title heads a page without a heading."""
    told = files.withColumn("recipe", suggested(F.col("path"), F.col("content_type"), F.col("payload"), recipes))
    made = F.lit(None).cast("string")
    for r in recipes:
        if r.run is not None:
            made = F.when(F.col("recipe") == r.name, r.run(F.col("payload"))).otherwise(made)
    told = told.withColumn("__made", made)
    title = F.when(F.col("recipe") == "html-single-page", html_title(F.col("payload")))
    error = F.when(F.col("recipe").isNull(), "no recipe").when(F.col("__made").isNull(), "read elsewhere").when(F.length(F.regexp_replace("__made", r"\s+", " ")) < LEAST_CHARS, "almost no text")
    headed = F.when(title.isNotNull() & ~F.startswith("__made", F.lit("#")), F.concat(F.lit("# "), title, F.lit("\n\n"), "__made")).otherwise(F.col("__made"))
    return told.select(*files.columns, "recipe", F.when(error.isNull(), headed).alias("markdown"), error.alias("error"))
