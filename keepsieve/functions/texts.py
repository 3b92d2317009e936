"""Text, date, number and name functions as built-in column expressions; null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Endings taken for a domain; two-letter ones need a third label.
TLDS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "io", "dev", "app", "ai", "me", "tv", "sh", "fm", "ly", "is", "it", "at", "so", "to", "cc", "gg",
    "st", "im", "one", "blog", "wiki", "news", "info", "biz", "cloud", "tech", "xyz", "online", "site", "page", "link", "click", "rss", "moe", "best",
    "pro", "eu", "us", "uk", "de", "fr", "jp", "ru", "br", "in", "cn", "au", "ca", "nl", "se", "no", "fi", "dk", "es", "pl", "ch", "be", "cz", "gr",
    "hu", "ie", "nz", "pt", "ro", "sg", "tr", "ua", "za", "kr", "co",
)
# Entities resolved in page text; the ampersand comes first.
PAGE_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"))
# Names accepted for a source medium, beside its own.
MEDIUM_ALIASES = {
    "twitter": "x", "bird": "x-bird", "hn": "hackernews", "hacker-news": "hackernews", "you-tube": "youtube", "yt": "youtube", "feed": "rss", "atom": "rss",
    "bookmarks": "browser-bookmarks", "browser": "browser-bookmarks", "file": "local-file", "files": "local-file", "local": "local-file", "markdown": "markdown-file", "md": "markdown-file",
}
MEDIA = ("x", "x-bird", "json", "reddit", "hackernews", "github", "youtube", "rss", "browser-bookmarks", "local-file", "manual", "markdown-file")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UP, _LOW)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def mentions(text: Column) -> Column:
    """Distinct lower-cased handles after an @ that doesn't stand inside a word."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![A-Za-z0-9])@([A-Za-z][A-Za-z0-9_]*)"), 1), ascii_lower))


def _marked(text: Column, mark: str, strict: bool) -> Column:
    before = r"(?<![A-Za-z0-9])" if strict else ""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(before + mark + r"([A-Za-z0-9_]*[A-Za-z][A-Za-z0-9_]*(?:;|(?![A-Za-z0-9_;])))"), 1)
    real = F.filter(found, lambda t: ~t.rlike(r"^(?:[xX][0-9A-Fa-f]+|[0-9]+);$"))
    return F.array_distinct(F.transform(real, lambda t: ascii_lower(F.regexp_replace(t, ";$", ""))))


def hashtags(text: Column, strict: bool = False) -> Column:
    """Distinct lower-cased tags after a # with at least one letter, without numeric entities.

    By default a # inside a word counts too; ``strict`` leaves those out.
    """
    return _marked(text, "#", strict)


def cashtags(text: Column, strict: bool = False) -> Column:
    return _marked(text, r"\$", strict)


def masked_links(text: Column, links: Column) -> Column:
    """The text with every given link overwritten by blanks of the same length."""
    return F.aggregate(links, text, lambda t, x: F.replace(t, x, F.repeat(F.lit(" "), F.length(x))))


def bare_domains(text: Column) -> Column:
    """Distinct lower-cased domains written without scheme."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z0-9.-]+\.[A-Za-z0-9._-]*)"), 1)
    known = F.filter(runs, lambda c: F.element_at(F.split(c, r"\."), -1).isin(*TLDS))
    labels = lambda c: F.size(F.filter(F.split(c, r"\."), lambda x: x != ""))
    fits = F.filter(known, lambda c: (labels(c) >= 2) & ((F.length(F.element_at(F.split(c, r"\."), -1)) != 2) | (labels(c) >= 3)))
    return F.array_distinct(F.transform(fits, lambda c: ascii_lower(F.regexp_replace(c, r"^\.+|\.+$", ""))))


def fingerprint_tokens(title: Column, body: Column) -> Column:
    """Words a fingerprint is taken over: plain words of title and body longer than two bytes, no addresses."""
    words = F.split(F.concat(F.coalesce(F.concat(title, F.lit(" ")), F.lit("")), F.coalesce(body, F.lit(""))), r"\s+")
    plain = F.filter(words, lambda w: w.rlike(r"^[\p{L}\p{N}'-]+$") & ~ascii_lower(w).startswith("http"))
    trimmed = F.transform(plain, lambda w: ascii_lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    return F.filter(trimmed, lambda w: F.octet_length(w) > 2)


def unescape(text: Column, entities=PAGE_ENTITIES) -> Column:
    for a, b in entities:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def squash(text: Column) -> Column:
    """White space runs, no-break blanks included, collapsed to one blank; trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def clean(text: Column) -> Column:
    return squash(unescape(text))


def strip_html(text: Column) -> Column:
    """Tags to blanks, entities resolved, blanks collapsed."""
    return squash(unescape(F.regexp_replace(text, r"<[^>]*>", " ")))


def truncated(text: Column, most: int, keep: int | None = None, mark: str = "…") -> Column:
    """Texts over ``most`` characters cut to ``keep`` (most - 1 by default) and marked."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, keep or most - 1), F.lit(mark))).otherwise(text)


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_csv(text: Column) -> Column:
    """Quoted only where a comma, quote or line end asks for it."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike(r'[",\r\n]'), quoted).otherwise(F.coalesce(text, F.lit("")))


def escape_yaml(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.regexp_replace(text, r"[\r\n]+", " "), F.lit("'"), F.lit("''")), F.lit("'"))


def safe_filename(text: Column, fallback: Column) -> Column:
    """Forbidden characters to hyphens, controls to blanks, at most 120 characters; the fallback where no letter or digit is left."""
    out = F.regexp_replace(F.translate(text, '/\\:*?"<>|', "-" * 9), r"\p{Cc}", " ")
    out = F.substring(F.regexp_replace(squash(out), r"^\.+|[. ]+$", ""), 1, 120)
    return F.when(F.coalesce(out.rlike(r"[\p{L}\p{N}]"), F.lit(False)), out).otherwise(fallback)


def handle(text: Column) -> Column:
    """Trimmed and ASCII-lower-cased; a leading @ stays."""
    return ascii_lower(F.trim(text))


def is_address(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit(False))


def author_display(handle: Column, name: Column) -> Column:
    return F.when(blank_to_null(name).isNull() | (name == handle), handle).when(handle.isNull(), name).otherwise(F.concat(handle, F.lit(" ("), name, F.lit(")")))


def feed_author(text: Column) -> Column:
    """struct(address, name) of ``address (Name)`` or ``Name (address)``."""
    outer, inner = F.trim(F.regexp_extract(text, r"^([^(]*)", 1)), F.trim(F.regexp_extract(text, r"\(([^)]*)\)", 1))
    swap = is_address(inner)
    return F.struct(F.when(swap, inner).otherwise(outer).alias("address"), F.nullif(F.when(swap, outer).otherwise(inner), F.lit("")).alias("name"))


def medium(text: Column) -> Column:
    """Name of a source medium from any accepted spelling; null for an unknown one."""
    name = F.regexp_replace(F.lower(F.trim(text)), r"[_ ]", "-")
    out = F.when(name.isin(*MEDIA), name)
    for alias, target in MEDIUM_ALIASES.items():
        out = out.when(name == alias, F.lit(target))
    return out


def unfenced(text: Column) -> Column:
    """Content of a text wrapped in a Markdown code fence, with or without a language tag."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def color(text: Column) -> Column:
    """#rrggbb from #rgb or #rrggbb, a neutral grey from anything else."""
    low = F.lower(F.trim(text))
    short = F.regexp_replace(low, r"^#([0-9a-f])([0-9a-f])([0-9a-f])$", "#$1$1$2$2$3$3")
    return F.when(low.rlike(r"^#([0-9a-f]{3}|[0-9a-f]{6})$"), short).otherwise("#64748b")


def query_terms(text: str) -> list[str]:
    """Words of a query of two characters or more, lower-cased."""
    import re

    return [t for t in re.split(r"[^\w']+|_", text.lower()) if len(t) >= 2]


#: First ms of 2020, from which ids count.
EPOCH = 1577836800000


def id_to_millis(id: Column) -> Column:
    return F.shiftright(id, 16) + F.lit(EPOCH)


def millis_to_id(ms: Column, low: Column) -> Column:
    return F.shiftleft(ms - F.lit(EPOCH), 16) + low


def epoch_ms(value: Column) -> Column:
    """Seconds, milliseconds, micro- or nanoseconds since 1970 as milliseconds, by size."""
    size, whole = F.abs(value), value.cast("decimal(20,0)")  # a double doesn't hold nanoseconds
    return F.when(size >= 10**17, F.floor(whole / F.lit(10**6).cast("decimal(10,0)"))).when(size >= 10**14, F.floor(whole / F.lit(1000).cast("decimal(10,0)"))).when(size >= 10**11, value).otherwise(value * 1000).cast("bigint")


def iso8601(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def date_only(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def date_time(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm")


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring printable ASCII characters, lower-cased."""
    low = ascii_lower(F.coalesce(text, F.lit("")))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - 1)), lambda i: F.substr(low, i, F.lit(2)))
    return F.array_distinct(F.filter(pairs, lambda p: p.rlike(r"^[ -~]{2}$")))
