"""First-match routing of addresses to categories."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsieve.functions.urls import routing_text


@dataclass
class Rule:
    slug: str
    any: list[str] = field(default_factory=list)
    all: list[str] = field(default_factory=list)
    action: str | None = None


# The default categories (slug, name, colour, description) and rules.
CATEGORIES = (
    ("engineering", "Engineering", "#4f46e5", "code, tools, and systems"),
    ("reading", "Reading", "#0891b2", "things to read later"),
    ("writing", "Writing", "#7c3aed", "things being written"),
    ("design", "Design", "#db2777", "interfaces, type, and craft"),
    ("business", "Business", "#ca8a04", "markets, companies, and money"),
    ("science", "Science", "#16a34a", "research and findings"),
    ("news", "News", "#dc2626", "what happened"),
    ("media", "Media", "#ea580c", "video, audio, and pictures"),
    ("general", "General", "#6b7280", "everything else"),
)
DEFAULT_RULES = (
    Rule("engineering", ["github.com", "gitlab.com", "arxiv.org", "docs.rs", "crates.io", "developer.mozilla.org", "stackoverflow.com"]),
    Rule("design", ["figma.com", "dribbble.com", "awwwards.com", "fonts.google.com", "typewolf.com"]),
    Rule("business", ["substack.com", "stripe.com", "a16z.com", "bloomberg.com"]),
    Rule("science", ["nature.com", "science.org", "arxiv.org", "quantamagazine.org", "nasa.gov"]),
    Rule("news", ["reuters.com", "apnews.com", "bbc.com", "theverge.com", "arstechnica.com"]),
    Rule("media", ["youtube.com", "youtu.be", "vimeo.com", "spotify.com", "twitch.tv"]),
    Rule("reading", ["readwise.io", "pocket.com", "instapaper.com"]),
)
#: Characters by which needles of a rule table meet addresses.
GRAM = 3


def _matches(text: Column, rule: Rule) -> Column:
    hit = F.lit(False)
    for needle in rule.any:
        hit = hit | F.contains(text, F.lit(needle.lower()))
    for needle in rule.all:
        hit = hit & F.contains(text, F.lit(needle.lower()))
    return hit if rule.any else F.lit(False)


def route(url: Column, rules=DEFAULT_RULES, fallback: str = "general", known: set[str] | None = None) -> Column:
    """Category of an address: the first rule one of whose ``any`` and all of whose ``all`` needles occur in host and path.

    A rule naming an unknown category gives the fallback; null addresses too.
    One CASE in rule order, so it stays in generated code.
    """
    text = routing_text(url)
    out = None
    for r in rules:
        slug = r.slug if known is None or r.slug in known else fallback
        out = F.when(_matches(text, r), slug) if out is None else out.when(_matches(text, r), slug)
    return F.coalesce(out, F.lit(fallback)) if out is not None else F.lit(fallback)


def all_matches(url: Column, rules=DEFAULT_RULES) -> Column:
    """Categories of all matching rules in rule order."""
    text = routing_text(url)
    return F.filter(F.array(*[F.when(_matches(text, r), r.slug) for r in rules]), lambda x: x.isNotNull())


def _grams(text: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n))))


def route_by_table(items: DataFrame, url: str, rules: DataFrame, fallback: str = "general", out: str = "slug") -> DataFrame:
    """The same for many rules given as a table (order, slug, needle), one row per ``any`` needle.

    A needle may stand anywhere in host and path. It meets addresses by the one
    of its three-character pieces that fewest needles share (a shorter needle
    whole), an equi join, so no rule is tried on every address. Blank needles
    match nothing. Equal addresses are looked up once.
    """
    given = rules.select("order", F.col("slug").alias("__slug"), F.lower("needle").alias("__needle")).where("__needle <> ''").withColumn("__n", F.least(F.lit(GRAM), F.length("__needle")))
    pieces = given.select("__needle", "__n").distinct()
    each = None
    for n in range(1, GRAM + 1):
        one = pieces.where(F.col("__n") == n).select("__needle", F.explode(_grams(F.col("__needle"), n)).alias("__part"))
        each = one if each is None else each.union(one)
    shared = each.join(each.groupBy("__part").agg(F.count("*").alias("__k")), "__part")
    keyed = given.join(shared.groupBy("__needle").agg(F.min_by("__part", F.struct("__k", "__part")).alias("__part")), "__needle")
    text = items.withColumn("__text", routing_text(F.col(url)))
    distinct = text.select("__text").distinct()
    lengths = [r[0] for r in pieces.select("__n").distinct().collect()]  # three at most
    parts = None
    for n in lengths:
        one = distinct.where(F.length("__text") >= n).select("__text", F.explode(_grams(F.col("__text"), n)).alias("__part"))
        parts = one if parts is None else parts.union(one)
    if parts is None:
        return text.withColumn(out, F.lit(fallback)).drop("__text")
    hit = parts.join(keyed, "__part").where(F.contains("__text", F.col("__needle")))
    first = hit.groupBy("__text").agg(F.min_by("__slug", F.struct("order", "__slug")).alias("__slug"))
    return text.join(first, "__text", "left").withColumn(out, F.coalesce("__slug", F.lit(fallback))).drop("__text", "__slug")


def default_categories(spark: SparkSession) -> DataFrame:
    """(id, slug, name, color, description) of the categories a new archive begins with."""
    return spark.createDataFrame([(i, *c) for i, c in enumerate(CATEGORIES, 1)], "id bigint, slug string, name string, color string, description string")


def rubric(categories: DataFrame) -> DataFrame:
    """One text row: ``- slug: description`` lines in slug order."""
    return categories.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "slug", F.lit(": "), "description"))), "\n").alias("rubric"))
