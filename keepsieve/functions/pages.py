"""Readable text of HTML pages: metadata by patterns, the body by scored blocks in one vectorised pass."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsieve.functions.texts import PAGE_ENTITIES, clean

# Elements without article text, block elements, and phrases of page chrome and of walls.
JUNK = ("script", "style", "nav", "header", "footer", "aside", "form", "noscript", "iframe", "svg", "button", "select", "template")
BLOCKS = ("p", "li", "blockquote", "h1", "h2", "h3", "h4", "pre", "td")
CHROME = ("cookie", "accept all", "sign in", "log in", "subscribe", "newsletter", "share this", "read more", "related posts", "follow us", "advertisement", "privacy policy", "terms of service", "all rights reserved", "skip to content")
WALLS = ("subscribe to continue", "this article is for subscribers", "subscribers only", "create an account to read", "sign in to continue reading", "enable javascript to continue", "accept cookies to continue")
#: A body of at most so many characters is no article.
LEAST_BODY = 280
_JUNK = re.compile(rf"<({'|'.join(JUNK)})\b[^>]*>.*?(?=</\1|\Z)", re.I | re.S)
_BLOCK = re.compile(rf"<({'|'.join(BLOCKS)})(?![a-z0-9])[^>]*>(.*?)</\1>", re.I | re.S)
_ANCHOR = re.compile(r"<a\b[^>]*>(.*?)</a>", re.I | re.S)
_MARKERS = re.compile(r'id="(?:root|app|__next|__nuxt)"|ng-app|data-reactroot', re.I)


def _tidy(text: str) -> str:
    for a, b in PAGE_ENTITIES:
        text = text.replace(a, b)
    return " ".join(text.replace("\xa0", " ").split())


def block_score(text: str) -> float:
    """Worth of a block: length and punctuation against links; 0 for short, link-heavy or chrome blocks."""
    n = len(text)
    if n < 40:
        return 0.0
    anchors = _ANCHOR.findall(text)
    density = sum(len(a.encode()) for a in anchors) / n
    low = text.lower()
    if density > 0.5 or sum(c in low for c in CHROME) >= 2:
        return 0.0
    points = sum(text.count(c) for c in ".,;:!?")
    return (n + 12.0 * points) / (1.0 + low.count("<a") + 8.0 * density)


def read_body(page: str) -> str:
    """Blocks of the upper three quarters by worth, in order, without direct repeats."""
    scored = [(t, s) for m in _BLOCK.finditer(_JUNK.sub("", page)) if (s := block_score(t := _tidy(m[2]))) > 0]
    if not scored:
        return ""
    ranked = sorted((s for _, s in scored), reverse=True)
    cutoff = max(1.0, ranked[min(len(ranked) * 3 // 4, len(ranked) - 1)])
    kept: list[str] = []
    for t, s in scored:
        if s >= cutoff and (not kept or kept[-1] != t):
            kept.append(t)
    return "\n\n".join(kept)


def article_body(page: Column) -> Column:
    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([None if p is None else read_body(p) for p in pages], dtype=object)

    return of(page)


def meta(page: Column, names: tuple[str, ...]) -> Column:
    """Content of the first of these meta names or properties that is there."""
    found = []
    for n in names:
        quoted = re.escape(n)
        for pattern in (rf'(?is)<meta[^>]*(?:name|property)="{quoted}"[^>]*content="([^"]*)"', rf'(?is)<meta[^>]*content="([^"]*)"[^>]*(?:name|property)="{quoted}"'):
            found.append(F.nullif(F.regexp_extract(page, pattern, 1), F.lit("")))
    return F.coalesce(*found)


def article(page: Column, base: Column) -> Column:
    """struct(title, summary, author, site, canonical, body, blocked) of a page; body and blocked as the body allows."""
    wall = F.lit(False)
    for w in WALLS:
        wall = wall | F.contains(F.lower(page), F.lit(w))
    body = F.when(wall, F.lit("")).otherwise(article_body(page))
    title = F.coalesce(meta(page, ("og:title", "twitter:title")), F.nullif(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit("")))
    link = F.coalesce(F.nullif(F.regexp_extract(page, r'(?is)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1), F.lit("")), meta(page, ("og:url",)), base)
    return F.struct(
        clean(title).alias("title"), clean(meta(page, ("description", "og:description", "twitter:description"))).alias("summary"), clean(meta(page, ("author", "article:author", "og:article:author"))).alias("author"),
        clean(meta(page, ("og:site_name", "application-name"))).alias("site"), link.alias("canonical"), body.alias("body"), F.when(wall, "paywall").when(F.length(body) <= LEAST_BODY, "empty").alias("blocked"),
    )


def without_junk(page: Column) -> Column:
    return F.regexp_replace(page, rf"(?is)<({'|'.join(JUNK)})\b[^>]*>.*?(?=</\1|\z)", "")


def visible_chars(page: Column) -> Column:
    """Characters outside tags, scripts and other elements without text."""
    return F.length(F.regexp_replace(without_junk(page), r"<[^>]*>", ""))


def needs_rendering(page: Column) -> Column:
    return page.rlike(_MARKERS.pattern) & (visible_chars(page) < 200)
