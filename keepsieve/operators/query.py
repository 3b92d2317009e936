"""Filters, pages, facets, counts and satellite hydration of the archive."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = ("entities", "vision", "tagged", "categorized", "described")


@dataclass
class Filter:
    """Conditions on items, all of which hold; unset ones don't count.

    ``tags`` and ``categories`` become semi joins, the rest one predicate that
    reaches the scan.
    """

    text: str | None = None
    tags: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    medium: str | None = None
    since: int | None = None
    until: int | None = None
    described: bool | None = None

    def predicate(self, created: str = "created_ms") -> Column:
        parts: list[Column] = []
        if self.text:
            term = self.text.replace("%", " ").replace("_", " ")
            parts.append(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False)) for c in ("body", "title", "summary", "extra")]))
        if self.medium:
            parts.append(F.col("medium") == self.medium)
        if self.since is not None:
            parts.append(F.col(created) >= self.since)
        if self.until is not None:
            parts.append(F.col(created) <= self.until)
        if self.described is not None:
            parts.append(F.col("described_at").isNotNull() if self.described else F.col("described_at").isNull())
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def apply(self, items: DataFrame, tag: DataFrame | None = None, assigned: DataFrame | None = None, category: DataFrame | None = None, created: str = "created_ms") -> DataFrame:
        out = items.where(self.predicate(created))
        for t in self.tags:
            out = out.join(tag.where(F.col("tag") == t).select(F.col("bookmark").alias("id")), "id", "left_semi")
        if self.categories:
            wanted = category.where(F.col("slug").isin(self.categories)).select(F.col("id").alias("category"))
            out = out.join(assigned.join(wanted, "category", "left_semi").select(F.col("bookmark").alias("id")), "id", "left_semi")
        return out


def page(items: DataFrame, order: str, n: int, offset: int = 0, id: str = "id") -> DataFrame:
    """One page, newest first, ties by id; nulls last."""
    return items.orderBy(F.col(order).desc_nulls_last(), F.col(id).desc()).offset(offset).limit(n)


def keyset_page(items: DataFrame, pending: Column, after: int, n: int, id: str = "id") -> DataFrame:
    """The next ``n`` pending items after an id, in id order."""
    return items.where(pending & (F.col(id) > after)).orderBy(id).limit(n)


def counts(df: DataFrame, by: str, out: str = "n", top: int | None = None) -> DataFrame:
    """Rows per value, most frequent first, ties by value."""
    got = df.groupBy(by).agg(F.count("*").alias(out))
    return got.orderBy(F.col(out).desc(), by).limit(top) if top else got


def backlog(items: DataFrame) -> DataFrame:
    """(stage, pending): items without each stage's stamp, in one pass."""
    one = items.agg(*[F.count_if(F.col(f"{s}_at").isNull()).alias(s) for s in STAGES])
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("pending")) for s in STAGES])).alias("x")).select("x.*")


def archive_stamp(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("items"), F.coalesce(F.max("ingested_at"), F.lit(0)).alias("newest"))


def complete(items: DataFrame) -> DataFrame:
    return items.where(reduce(lambda a, b: a & b, [F.col(f"{s}_at").isNotNull() for s in STAGES]))


def hydrate(items: DataFrame, link: DataFrame, media: DataFrame, tag: DataFrame, assigned: DataFrame, category: DataFrame) -> DataFrame:
    """Items with arrays links, media, tags and categories; each satellite is aggregated before it is joined.

    Repeated satellite rows count once; an item without any gets empty arrays.
    """
    links = link.distinct().groupBy("bookmark").agg(F.array_sort(F.collect_list(F.struct("ordinal", "original", "resolved", "kind", "title", "body", "summary", "blocked"))).alias("links"))
    medias = media.distinct().groupBy("bookmark").agg(F.array_sort(F.collect_list(F.struct("ordinal", "kind", "url", "preview_url", "width", "height", "duration_ms", "alt_text"))).alias("media"))
    tags = tag.groupBy("bookmark").agg(F.array_sort(F.collect_set(F.lower(F.trim("tag")))).alias("tags"))
    named = assigned.join(category.select(F.col("id").alias("category"), "slug"), "category")
    best = named.groupBy("bookmark", "slug").agg(F.max(F.struct("confidence", "assigned_by")).alias("x"))
    cats = best.groupBy("bookmark").agg(F.array_sort(F.collect_list(F.struct((-F.col("x.confidence")).alias("order"), "slug", F.col("x.confidence").alias("confidence"), F.col("x.assigned_by").alias("assigned_by")))).alias("categories"))
    out = items
    for df in (links, medias, tags, cats):
        out = out.join(df.withColumnRenamed("bookmark", "id"), "id", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.array().cast(dict(out.dtypes)[c])) for c in ("links", "media", "tags", "categories")})


def display_title(title: Column, links: Column, body: Column, url: Column, medium: Column, external_id: Column) -> Column:
    """Title, else a link's title, else the first line that is no address, else host and last part of the address; at most 120 characters."""
    from keepsieve.functions import texts, urls

    lines = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("http"))
    link = F.get(F.filter(F.transform(links, lambda x: texts.blank_to_null(x["title"])), lambda x: x.isNotNull()), 0)
    last = F.get(F.filter(F.reverse(F.split(urls.path(url), "/")), lambda p: p != ""), 0)
    place = F.when(last.isNull(), urls.host(url)).otherwise(F.concat(urls.host(url), F.lit(" · "), last))
    got = F.coalesce(texts.blank_to_null(title), link, F.get(lines, 0), F.nullif(place, F.lit("")), F.concat(medium, F.lit(" "), external_id))
    return texts.truncated(texts.squash(got), 120, 117)


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def primary_link(links: Column) -> Column:
    """The link an item is about: of links of known kind or with a body the last best by body, title and prose; else the first."""
    usable = F.filter(links, lambda x: (x["kind"] != "unknown") | (F.coalesce(F.trim(x["body"]), F.lit("")) != ""))
    rated = F.transform(
        usable,
        lambda x, i: F.struct(
            (F.coalesce(F.trim(x["body"]), F.lit("")) != "").alias("body"), (F.coalesce(F.trim(x["title"]), F.lit("")) != "").alias("title"), x["kind"].isin("article", "long-form", "paper", "release").alias("prose"), i.alias("at"), x.alias("link")
        ),
    )
    return F.coalesce(F.array_max(F.transform(rated, lambda r: F.struct(r["body"], r["title"], r["prose"], r["at"], r["link"]["resolved"].alias("resolved"))))["resolved"], F.get(links, 0)["resolved"])


def core_title(title: Column, links: Column, body: Column) -> Column:
    """Title, else a link's title, else the first line cut to 90 characters, else ``Untitled``."""
    from keepsieve.functions import texts

    link = F.get(F.filter(F.transform(links, lambda x: texts.blank_to_null(x["title"])), lambda x: x.isNotNull()), 0)
    line = F.get(F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), 0)
    return F.coalesce(texts.blank_to_null(title), link, texts.truncated(line, 90), F.lit("Untitled"))


def date_range(items: DataFrame, ms: str = "created_ms") -> DataFrame:
    """(first_day, last_day) of the items; null without any."""
    from keepsieve.functions import texts

    return items.agg(F.min(ms).alias("a"), F.max(ms).alias("b")).select(texts.date_only(F.col("a")).alias("first_day"), texts.date_only(F.col("b")).alias("last_day"))


def carry_forward(items: DataFrame, *, by: str, value: str, at: str, id: str = "id", span: int = 30 * 86_400_000, out: str = "carried") -> DataFrame:
    """Adds the last ``value`` that isn't null up to each row of its group, in order of ``at`` and ``id``.

    A group is cut into spans of time, so a hot one is no single task's: within
    a span a window runs, and what earlier spans end with comes from one row a
    span. Rows without ``at`` come first.
    """
    cut = items.withColumn("__span", F.coalesce(F.floor(F.col(at) / span), F.lit(-(1 << 62))))
    w = Window.partitionBy(by, "__span").orderBy(at, id).rowsBetween(Window.unboundedPreceding, 0)
    within = cut.withColumn("__own", F.last(value, True).over(w))
    ends = cut.groupBy(by, "__span").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(F.coalesce(at, F.lit(-(1 << 62))).alias("at"), id))).alias("__end"))
    before = Window.partitionBy(by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ends.select(by, "__span", F.last("__end", True).over(before).alias("__before"))
    return within.join(earlier, [by, "__span"]).withColumn(out, F.coalesce("__own", "__before")).drop("__span", "__own", "__before")
