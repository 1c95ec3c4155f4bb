"""Web pages and wiki text: plain text, titles, links, and what kind of page it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traitloom.functions.markup import texts_of
from traitloom.functions.text import collapse_space, settled

#: The named entities that are read.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}
BOILERPLATE = r"(?is)<(script|style|noscript|nav|header|footer|aside|form)\b[^>]*>.*?</\1\s*>"
COMMENT = r"(?s)<!--.*?-->"
#: Extensions, their content types and formats.
EXTENSIONS = {"txt": "text/plain", "xml": "application/xml", "html": "text/html", "htm": "text/html", "json": "application/json", "pdf": "application/pdf", "csv": "text/csv"}


def unescape_html(text: Column) -> Column:
    """Each entity that is a number or one of the named ones read once; others stay."""
    pattern = r"&(#[xX]?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"
    names = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])

    def read(entity: Column) -> Column:
        body = F.substring(entity, 2, F.length(entity) - 2)
        code = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 9), 16, 10).try_cast("long")).otherwise(F.regexp_extract(body, "^#([0-9]+)", 1).try_cast("long"))
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.coalesce(F.when(body.startswith("#"), F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), char)).otherwise(F.try_element_at(names, F.lower(body))), entity)

    def joined(t: Column) -> Column:
        parts, found = F.split(t, pattern, -1), F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), read)
        return F.array_join(F.zip_with(parts, found, lambda p, e: F.concat(F.coalesce(p, F.lit("")), F.coalesce(e, F.lit("")))), "")

    return F.when(text.rlike(pattern), joined(text)).otherwise(text)


def strip_boilerplate(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), COMMENT, " "), BOILERPLATE, " ")


def strip_html(html: Column) -> Column:
    """Entities are read before tags go, so escaped tags go too."""
    return collapse_space(F.regexp_replace(unescape_html(F.coalesce(html, F.lit(""))), "<[^>]*>", " "))


def prose_length(html: Column) -> Column:
    return F.length(collapse_space(F.regexp_replace(strip_boilerplate(html), "<[^>]*>", " ")))


def html_title(html: Column) -> Column:
    found = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(F.trim(found) != "", strip_html(found))


def hrefs(html: Column) -> Column:
    """The targets of a page's links outside its boilerplate, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(strip_boilerplate(html), F.lit(r"""(?i)<a\s[^>]*?href=["']([^"'#]+)["']"""), F.lit(1)))


def content_links(html: Column, url: Column) -> Column:
    """Absolute addresses on the page's own host, in order, each once."""
    host, scheme = F.try_parse_url(url, F.lit("HOST")), F.try_parse_url(url, F.lit("PROTOCOL"))
    root = F.concat(scheme, F.lit("://"), host)
    absolute = F.transform(hrefs(html), lambda x: F.when(x.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), x).when(x.startswith("//"), F.concat(scheme, F.lit(":"), x))
                           .when(x.startswith("/"), F.concat(root, x)).otherwise(F.concat(root, F.lit("/"), x)))
    return F.array_distinct(F.filter(absolute, lambda x: F.try_parse_url(x, F.lit("HOST")) == host))


def link_count(html: Column) -> Column:
    return F.size(hrefs(html))


def is_index_page(html: Column, least_links: int = 8, most_prose: int = 220) -> Column:
    """Eight links or more with little prose for each."""
    links = link_count(html)
    return (links >= least_links) & (prose_length(html) < most_prose * links)


def is_interstitial(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).rlike(r"(?i)(captcha|are you (?:a )?human|checking your browser|enable javascript)")


def looks_like_markup(text: Column) -> Column:
    """Markup by its first 2000 characters: a declaration, ten tags or more, or JSON."""
    head = F.trim(F.substring(F.coalesce(text, F.lit("")), 1, 2000))
    return head.rlike(r"(?i)^<(?:!doctype|\?xml|html)") | (F.regexp_count(head, F.lit("</?[a-zA-Z][^>]*>")) >= 10) | (head.rlike(r"^[\[{]") & F.try_parse_json(text).isNotNull())


def url_allowed(url: Column, hosts: list[str], prefixes: list[str]) -> Column:
    """https, a listed host or one below it, and a listed start of the path."""
    host, path = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    named = F.lit(False)
    for h in hosts:
        named = named | (host == h) | host.endswith("." + h)
    below = F.lit(False)
    for p in prefixes:
        below = below | path.startswith(p)
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & named & below, F.lit(False))


def content_type(name: Column) -> Column:
    extension = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), extension), F.lit("application/octet-stream"))


def clean_wikitext(text: Column) -> Column:
    """Plain text of wiki text without comments, references, templates however deep, link marks and quotes."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), COMMENT, ""), r"(?is)<ref[^>]*/>|<ref[^>]*>.*?</ref>", "")
    text = settled(text, r"\{\{[^{}]*\}\}", r"\{\{")
    text = F.regexp_replace(text, r"(?i)\[\[(?:file|image|category):[^\[\]]*\]\]", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1"), r"\[\[([^\[\]]*)\]\]", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(text, "'{2,}", ""), "<[^>]*>", ""))


def xml_texts(xml: Column, name: str) -> Column:
    """The texts of a document's elements of a local name, in order, whatever their prefix and however they nest; inner tags go."""
    return texts_of(xml, name)
