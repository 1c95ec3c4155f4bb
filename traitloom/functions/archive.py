"""Addresses, item metadata and the likeness of titles, for matching works with catalogue items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traitloom.functions.text import let, unicode_form

#: Words of a title that do not tell works apart.
STOP_WORDS = ("the", "a", "an", "of", "and", "or", "on", "in", "to", "with", "from", "for", "by", "its", "his", "her", "their", "de", "la", "le", "el", "vol", "edition", "trans", "translated", "translation")
#: Roman numerals of volumes.
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
#: First parts of an item's address that the identifier follows.
ITEM_PATHS = ("details", "download", "stream", "read", "embed", "metadata", "compress", "serve", "fullscreen")
#: Languages by name and their codes.
LANGUAGE_CODES = {"english": "eng", "german": "deu", "french": "fra", "spanish": "spa", "italian": "ita", "latin": "lat", "greek": "grc", "hebrew": "heb", "arabic": "ara", "japanese": "jpn",
                  "chinese": "zho", "sanskrit": "san", "russian": "rus"}
#: Languages with a wiki of their own, and codes that another wiki hosts.
WIKI_LANGUAGES = ("ar", "bn", "cs", "cy", "da", "de", "el", "en", "es", "fa", "fi", "fr", "ga", "he", "hi", "hu", "hy", "id", "is", "it", "ja", "ko", "la", "nl", "no", "pl", "pt", "ro", "ru", "sa", "sv",
                  "ta", "th", "tr", "uk", "vi", "zh")
WIKI_ALIASES = {"grc": "el", "non": "is", "nb": "no", "nn": "no", "pt-br": "pt", "zh-hans": "zh", "zh-hant": "zh"}
#: The failures of a download that a corrected address may mend.
REPAIRABLE = r"(?i)target path is not allowed|not a trusted redirect|download failed \(404\)"
#: IPv4 networks that are not for public use, as first octets and ranges of the next ones.
SPECIAL_IPV4 = ((0, 0, None), (10, 10, None), (127, 127, None), (240, 255, None), (100, 100, (64, 127)), (169, 169, (254, 254)), (172, 172, (16, 31)), (192, 192, (168, 168)), (198, 198, (18, 19)))
SPECIAL_24 = ((192, 0, 0), (192, 0, 2), (198, 51, 100), (203, 0, 113))


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def title_tokens(text: Column) -> Column:
    """The words of a title in order, without marks, capitals and stop words."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(unicode_form(F.coalesce(text, F.lit("")), "NFKD"), r"[\x{0300}-\x{036f}]", "")), "[^a-z0-9]+", " ")
    return F.filter(F.split(F.trim(plain), " "), lambda t: (t != "") & ~t.isin(*STOP_WORDS))


def token_similarity(a: Column, b: Column) -> Column:
    """Dice's coefficient of two arrays of tokens as sets; 0 if either has none."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def longest_run(a: Column, b: Column) -> Column:
    """The longest run of tokens that two arrays share, and how many of them have five letters or more; the first of equals."""
    def run(i: Column, j: Column) -> Column:
        equal = F.zip_with(F.slice(a, i + 1, F.size(a)), F.slice(b, j + 1, F.size(b)), lambda x, y: F.coalesce(x == y, F.lit(False)))
        ends = F.array_position(equal, F.lit(False)).cast("int")
        length = F.when(ends > 0, ends - 1).otherwise(F.size(equal))
        return let(length, lambda n: F.struct(n.alias("length"), (-(i * 10_000 + j)).alias("order"), F.size(F.filter(F.slice(a, i + 1, n), lambda t: F.length(t) >= 5)).alias("distinctive")))

    all_runs = F.flatten(F.transform(a, lambda _, i: F.transform(b, lambda _, j: run(i, j))))
    best = F.array_max(all_runs)
    return F.struct(F.coalesce(best["length"], F.lit(0)).alias("length"), F.coalesce(F.when(best["length"] > 0, best["distinctive"]), F.lit(0)).alias("distinctive"))


def volume_number(title: Column) -> Column:
    """The number of a volume, part or book that a title states, in digits or Roman numerals."""
    raw = F.lower(F.regexp_extract(F.coalesce(title, F.lit("")), r"(?i)\b(?:vol|volume|v|pt|part|bk|book)\.?\s*([0-9]{1,2}|[ivx]{1,4})\b", 1))
    return F.when(raw.rlike("^[0-9]+$"), raw.try_cast("int")).otherwise(_lookup(ROMAN, raw))


def item_volume(volume: Column, title: Column, identifier: Column) -> Column:
    """An item's volume: its own field, else its title's, else four digits within the identifier, if 1 to 20."""
    digits = F.regexp_extract(F.coalesce(identifier, F.lit("")), r"[a-z](\d{4})[a-z_]", 1).try_cast("int")
    return F.coalesce(F.when(volume > 0, volume), volume_number(title), F.when(digits.between(1, 20), digits))


def candidate_score(title: Column, author: Column, year: Column, item: dict[str, Column]) -> Column:
    """How well a catalogue item (title, creator, year, volume, identifier) fits a wanted work, within 0 and 1.

    The titles count for 0.85 and the authors for 0.15, or half that by the title where one
    has none; a shared run of four words, two of them long, stands for a title's likeness of
    0.8. The same year adds 0.1 and one more than five years off takes it; a wanted volume
    adds 0.1, takes 0.05 if the item states none and 0.35 if another.
    """
    return let(candidate_likeness(title, author, item), lambda k: candidate_total(k, year, item["year"]))


def candidate_likeness(title: Column, author: Column, item: dict[str, Column]) -> Column:
    """The parts of ``candidate_score`` that do not depend on years: a struct of likeness and volume."""
    def scored(k: Column) -> Column:
        by_run = let(longest_run(k["w"], k["t"]), lambda r: F.when((r["length"] >= 4) & (r["distinctive"] >= 2), 0.8).otherwise(0.0))
        by_author = F.when(named, 0.15 * token_similarity(k["a"], k["c"]))
        return let(F.greatest(token_similarity(k["w"], k["t"]), by_run), lambda x: F.struct((0.85 * x + F.coalesce(by_author, 0.075 * x)).alias("likeness"), by_volume.alias("volume")))

    named = (F.coalesce(author, F.lit("")) != "") & (F.coalesce(item["creator"], F.lit("")) != "")
    wanted, own = volume_number(title), item_volume(item["volume"], item["title"], item["identifier"])
    by_volume = F.when(wanted.isNull(), 0.0).when(own.isNull(), -0.05).when(own == wanted, 0.1).otherwise(-0.35)
    return let(F.struct(*[title_tokens(c).alias(n) for n, c in zip("wtac", (title, item["title"], author, item["creator"]), strict=True)]), scored)


def candidate_total(parts: Column, year: Column, item_year: Column) -> Column:
    """The score from the struct of ``candidate_likeness`` and both years."""
    apart = F.abs(year - item_year)
    by_year = F.when(year.isNull() | item_year.isNull() | (year == 0) | (item_year == 0), 0.0).when(apart == 0, 0.1).when(apart > 5, -0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), parts["likeness"] + by_year + parts["volume"]))


def same_work(a: Column, b: Column) -> Column:
    """Whether two titles name one work: like enough, or with a long run in common."""
    def alike(k: Column) -> Column:
        return (token_similarity(k["a"], k["b"]) >= 0.7) | let(longest_run(k["a"], k["b"]), lambda r: (r["length"] >= 4) & (r["distinctive"] >= 2))

    return let(F.struct(title_tokens(a).alias("a"), title_tokens(b).alias("b")), alike)


def _path_parts(url: Column) -> Column:
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda x: x != "")


def decoded(part: Column) -> Column:
    """A part of an address with its escapes read; as it is if they are broken. A plus stays a plus."""
    return F.coalesce(F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))), part)


def item_identifier(url: Column) -> Column:
    """The item that an address names: what follows ``items``, else what follows a known first part; null for others."""
    def named(p: Column) -> Column:
        after = F.array_position(p, "items").cast("int")
        return F.coalesce(F.when(after > 0, F.get(p, after)), F.when(F.get(p, F.lit(0)).isin(*ITEM_PATHS), F.get(p, F.lit(1))))

    return let(F.transform(_path_parts(url), decoded), named)


def encoded(part: Column) -> Column:
    """A part of an address, escaped; blanks as ``%20``."""
    out = F.replace(F.url_encode(part), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def wikisource_page(url: Column) -> Column:
    """(language, title) of a language wiki's page, else null."""
    host, path = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    language = F.regexp_extract(F.coalesce(host, F.lit("")), r"^([a-z][a-z0-9-]*)\.wikisource\.org$", 1)
    title = F.trim(F.replace(F.try_url_decode(F.replace(F.regexp_extract(path, "^/wiki/(.*)$", 1), F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" ")))
    good = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & ~language.isin("", "mul", "www") & (title != "")
    return F.when(good, F.struct(language.alias("language"), title.alias("title")))


def wiki_language(code: Column) -> Column:
    """The wiki that holds a language's texts; null if there is none."""
    own = F.lower(F.trim(code))
    resolved = F.coalesce(_lookup(WIKI_ALIASES, own), F.get(F.split(own, "[-_]"), F.lit(0)))
    return F.when(resolved.isin(*WIKI_LANGUAGES), resolved)


def wiki_languages(language: Column, script: Column, region: Column, default: str = "en") -> Column:
    """The wikis to search: the original's, by its code, script or region, then the default one.

    Han characters alone do not tell Chinese from Japanese or Korean; the region does.
    """
    told = F.when((script == "zh") & region.isin("ja", "ko"), region).otherwise(script)
    original = F.coalesce(wiki_language(language), wiki_language(told), wiki_language(region))
    return F.when(original.isNull() | (original == default), F.array(F.lit(default))).otherwise(F.array(original, F.lit(default)))


def item_metadata(document: Column) -> dict[str, Column]:
    """Fields of an item's metadata given as JSON: the first of a list or the value; empty means missing."""
    v = F.try_parse_json(F.get_json_object(document, "$.metadata"))

    def first(name: str) -> Column:
        value = F.coalesce(F.try_variant_get(v, f"$['{name}'][0]", "string"), F.when(F.schema_of_variant(F.try_variant_get(v, f"$['{name}']", "variant")).startswith("ARRAY"), F.lit(None).cast("string"))
                           .otherwise(F.try_variant_get(v, f"$['{name}']", "string")))
        return F.nullif(value, F.lit(""))

    date = F.coalesce(first("date"), first("year"))
    return {"identifier": first("identifier"), "title": first("title"), "creator": first("creator"), "date": date,
            "year": F.nullif(F.regexp_extract(date, r"(\d{4})", 1), F.lit("")).try_cast("int"), "language": language_code(first("language")), "license_url": first("licenseurl")}


def language_code(name: Column) -> Column:
    raw = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.coalesce(_lookup(LANGUAGE_CODES, raw), F.when(raw.rlike("^[a-z]{2,3}$"), raw), F.lit("und"))


def private_address(address: Column) -> Column:
    """Whether an IPv4 or IPv6 address is none of the public ones; what is no address counts as private."""
    bare = F.regexp_replace(address, r"^\[|\]$", "")
    dotted = F.regexp_replace(bare, r"(?i)^::(?:ffff:)?(\d{1,3}(?:\.\d{1,3}){3})$", "$1")
    high, low = (F.conv(F.regexp_extract(dotted, r"(?i)^::(?:ffff:)?([0-9a-f]{1,4}):([0-9a-f]{1,4})$", g), 16, 10).cast("int") for g in (1, 2))
    byte = lambda x, shift: F.shiftright(x, shift).bitwiseAND(F.lit(255)).cast("string")
    ip = F.when(dotted.rlike("(?i)^::(?:ffff:)?[0-9a-f]{1,4}:[0-9a-f]{1,4}$"), F.concat_ws(".", byte(high, 8), byte(high, 0), byte(low, 8), byte(low, 0))).otherwise(dotted)
    lower = F.lower(ip)
    group = F.conv(F.regexp_extract(lower, "^([0-9a-f]{1,4}):", 1), 16, 10).try_cast("int")
    six = lower.isin("::1", "::") | lower.rlike("^(?:fc|fd|ff|100:)") | F.coalesce(group.between(0xFE80, 0xFEFF), F.lit(False))

    def four(p: Column) -> Column:
        a, b, c = (F.get(p, F.lit(i)) for i in range(3))
        out = F.lit(False)
        for low_a, high_a, then in SPECIAL_IPV4:
            out = out | (a.between(low_a, high_a) & (b.between(*then) if then else F.lit(True)))
        for x, y, z in SPECIAL_24:
            out = out | ((a == x) & (b == y) & (c == z))
        return out | (F.size(p) != 4) | F.exists(p, lambda x: x.isNull() | ~x.between(0, 255))

    octets = F.transform(F.split(ip, r"\."), lambda x: F.when(x == "", 0).otherwise(x.try_cast("int")))
    return F.when(F.contains(ip, F.lit(":")), six).otherwise(F.coalesce(let(octets, four), F.lit(True)))


def repairable(status: Column, is_archive: Column, error: Column) -> Column:
    """Whether a failed download of an archive item is worth another address."""
    return status.isin("metadata_only", "failed") & is_archive & F.coalesce(error, F.lit("")).rlike(REPAIRABLE)


def resolved_candidate(candidate: dict[str, Column], item: dict[str, Column], source_id: str) -> Column:
    """A candidate with an item's corrected address and rights.

    What the item states replaces the rights evidence; unverified claims stay in fields of
    their own. Title, author and language are the item's only where the candidate has none.
    """
    given = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    statement = F.when(item["license_url"].isNotNull(), F.concat(F.lit("Item licence: "), item["license_url"])).otherwise("No licence statement in the item's metadata.")
    rights = F.struct(F.lit("unknown").alias("status_claim"), F.lit("source_metadata").alias("basis"), statement.alias("statement"), item["license_url"].alias("license_url"),
                      candidate["claimed_statement"].alias("claimed_statement"), candidate["text_url"].alias("previous_url"))
    return F.struct(F.coalesce(given(candidate["title"]), item["title"], item["identifier"]).alias("title"), F.coalesce(candidate["author"], item["creator"]).alias("author"),
                    F.coalesce(given(candidate["language"]), item["language"]).alias("language"), F.lit(source_id).alias("source_id"), item["download_url"].alias("text_url"), rights.alias("rights"))
