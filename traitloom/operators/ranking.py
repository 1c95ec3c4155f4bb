"""First rows by key, best matches and the choice between candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitloom.operators.dictionary import held_parts


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. The rank filter is pushed below the shuffle, so a crowded key costs little."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def top_k(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first ``k`` rows; the order must end in a key, so that ties are settled."""
    return df.orderBy(*order).limit(clamped(k, 0, 1 << 30))


def clamped(n: int | None, least: int, most: int, default: int | None = None) -> int:
    """A number of rows asked for, within bounds; the default where none is given."""
    return max(least, min(n if n is not None else default if default is not None else most, most))


def sorted_by(df: DataFrame, column: str, descending: bool, allowed: tuple[str, ...], key: str = "id") -> DataFrame:
    """Rows by a column chosen at run time, whatever its case and accents' order in Unicode; nulls as empty texts, ties by key."""
    if column not in allowed:
        raise ValueError(f"no column to sort by: {column!r}")
    value = F.collate(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")), "UNICODE")
    return df.orderBy(value.desc() if descending else value.asc(), F.col(key))


def first_seen(rows: DataFrame, url: str, query: str, place: str) -> DataFrame:
    """Results of several queries with each address once, as the first query found it first."""
    known = rows.where(F.coalesce(F.col(url), F.lit("")) != "")
    return first_by(known, [url], [F.col(query), F.col(place)])


def fallback_editions(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (work_id, edition_id) to try next: editions not attempted yet of works that were tried and have no file.

    ``records`` has (work_id, edition_id, download_status, file). Each call is one pass; the
    caller stops after a few or when nothing is left.
    """
    fetched = records.where(F.col("download_status").isin("downloaded", "already_present") & F.col("file").isNotNull()).select("work_id").distinct()
    attempted = records.where("download_status <> 'not_selected'")
    blocked = attempted.select("work_id").distinct().join(fetched, "work_id", "left_anti")
    return candidates.join(blocked, "work_id", "left_semi").join(attempted.select("edition_id").distinct(), "edition_id", "left_anti")


def after_pass(records: DataFrame, fresh: DataFrame) -> DataFrame:
    """Records with those of the same edition in a later pass in their place."""
    return records.join(fresh.select("edition_id").distinct(), "edition_id", "left_anti").unionByName(fresh.select(*records.columns))


def token_overlap(catalogue: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """Per query (query, tokens) the entries (id, title, author) that hold most of its tokens, as parts of words too.

    The distinct tokens, as many as there are, become automata that pass over the distinct
    texts of the entries. Entries of one text score alike, and so do queries of the same
    tokens: each kind is scored once, and only the first ``most`` entries of a text can be
    among the best. Ids are keys of both tables; an empty token is not looked for.
    """
    hay = F.lower(F.concat_ws(" ", "title", "author"))
    first = catalogue.select("id", hay.alias("text")).withColumn("rn", F.row_number().over(Window.partitionBy("text").orderBy("id"))).where(F.col("rn") <= most).drop("rn")
    wanted = queries.select("query", F.array_sort(F.array_distinct("tokens")).alias("tokens"))
    asked = wanted.select("tokens").distinct()
    spread = asked.select("tokens", F.explode("tokens").alias("entry"))
    texts = catalogue.select(hay.alias("text")).distinct()
    found = held_parts(texts.select(F.col("text").alias("id"), "text"), spread.select("entry").distinct()).withColumnRenamed("id", "text")
    scored = found.join(spread, "entry").groupBy("tokens", "text").agg(F.count("*").alias("score")).join(first, "text")
    rank = F.row_number().over(Window.partitionBy("tokens").orderBy(F.col("score").desc(), "id"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= most)
    return wanted.join(best, "tokens").select("query", "id", "score", "rank")


def best_file(files: DataFrame, formats: list[str]) -> DataFrame:
    """Per item the open file of the best format, then the largest; and whether all were restricted."""
    rank = F.array_position(F.array(*map(F.lit, formats)), F.col("format"))
    usable = (rank > 0) & ~F.col("restricted")
    key = F.when(usable, F.struct(rank.alias("rank"), (-F.col("size")).alias("less"), F.col("name").alias("name")))
    return files.groupBy("item").agg(F.min(key).alias("best"), F.bool_and("restricted").alias("restricted_only")).select("item", F.col("best.name").alias("name"), "restricted_only")


def dice(a: Column, b: Column) -> Column:
    """Dice's coefficient of the distinct words of two texts; 0 if both have none."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))
    wa, wb = words(a), words(b)
    total = F.size(wa) + F.size(wb)
    return F.when(total == 0, 0.0).otherwise(2 * F.size(F.array_intersect(wa, wb)) / total)


def accepted_matches(scored: DataFrame, least: float = 0.62, margin: float = 0.05, same_work=None) -> DataFrame:
    """Per probe the best match, if it is good enough and no other work comes close.

    ``scored`` has (probe, id, work, score). ``same_work`` tells from two works whether they
    are one; without it they are if they are equal.
    """
    order = Window.partitionBy("probe").orderBy(F.col("score").desc(), "id")
    two = scored.withColumn("rn", F.row_number().over(order)).where("rn <= 2")
    pair = two.groupBy("probe").agg(*[F.max(F.when(F.col("rn") == r, F.struct("id", "work", "score"))).alias(n) for r, n in ((1, "best"), (2, "rival"))])
    close = F.coalesce((F.col("best.score") - F.col("rival.score") < margin) & ~(same_work or (lambda a, b: a == b))(F.col("best.work"), F.col("rival.work")), F.lit(False))
    return pair.where((F.col("best.score") >= least) & ~close).select("probe", F.col("best.id").alias("id"), F.col("best.score").alias("score"))


def robots_decisions(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Whether each (host, path) may be fetched: the longest matching rule decides, allow wins a tie."""
    hit = paths.join(rules, "host", "left").where(F.col("rule").isNull() | F.startswith("path", "rule"))
    decided = hit.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.col("allow").alias("allow"))).alias("m"))
    return paths.join(decided, ["host", "path"], "left").select("host", "path", F.coalesce("m.allow", F.lit(True)).alias("allowed"))


def region_of(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """Per text the region with most distinct keywords in it; null without any and on a tie.

    ``texts`` has (id, text), ``keywords`` (region, keyword) of single words.
    """
    words = texts.select("id", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"))).alias("keyword"))
    hits = words.join(keywords.distinct(), "keyword").groupBy("id", "region").agg(F.count("*").alias("n"))
    best = hits.groupBy("id").agg(F.max("n").alias("top"))
    leading = hits.join(best, "id").where("n = top").groupBy("id").agg(F.count("*").alias("ties"), F.min("region").alias("region"))
    return texts.select("id").join(leading, "id", "left").select("id", F.when(F.col("ties") == 1, F.col("region")).alias("region"))
