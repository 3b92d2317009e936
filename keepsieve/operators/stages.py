"""Enrichment stages as set-based transforms, and the runner over pending items.

Model and agent calls are injected callables from a frame to a frame; without
one a stage does what it can alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsieve.functions import texts, urls
from keepsieve.operators.fingerprints import simhash64
from keepsieve.operators.query import hydrate
from keepsieve.operators.rules import DEFAULT_RULES, route
from keepsieve.operators.store import Store, replace_rows, stamp
from keepsieve.plans.runtime import spread

ORDER = ("entities", "vision", "tagged", "categorized", "described")
MOST_LINKS, MOST_TAGS, MOST_MEDIA = 24, 24, 4
#: Price of one typed question of the model gateway, in dollars.
QUESTION = 0.0000065


def entities(items: DataFrame) -> DataFrame:
    """(id, links, tags, fingerprint): links and domains of each text, entity tags, and the fingerprint."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), "body")
    base = items.withColumn("__links", urls.links_in(F.col("body"))).withColumn("__masked", texts.masked_links(F.coalesce(F.col("body"), F.lit("")), F.col("__links")))
    base = base.withColumn("__domains", F.transform(texts.bare_domains(F.col("__masked")), lambda d: F.concat(F.lit("https://"), d)))
    found = F.slice(F.array_distinct(F.concat("__links", "__domains")), 1, MOST_LINKS)
    hosts = F.transform(found, lambda u: urls.host(u))
    tags = F.concat(hosts, F.array(urls.host(F.col("url"))), F.transform(texts.mentions(text), lambda m: F.concat(F.lit("@"), m)), texts.hashtags(text), texts.cashtags(text))
    out = spread(base).select("id", found.alias("links"), F.array_sort(F.filter(F.array_distinct(tags), lambda t: t.isNotNull() & (t != ""))).alias("tags"), texts.fingerprint_tokens(F.col("title"), F.col("body")).alias("__tokens"))
    return out.withColumn("fingerprint", simhash64(F.col("__tokens"))).drop("__tokens")


def vision(media: DataFrame) -> DataFrame:
    """(bookmark, tag): needs-description where one of the first four media lacks a telling alt text."""
    first = media.distinct().where(F.col("ordinal") < MOST_MEDIA)
    lacking = first.groupBy("bookmark").agg(F.max((F.octet_length(F.coalesce("alt_text", F.lit(""))) <= 24).cast("int")).alias("x"))
    return lacking.where("x = 1").select("bookmark", F.lit("needs-description").alias("tag"))


def tagging(items: DataFrame, link: DataFrame, tag: DataFrame, most: int | None = MOST_TAGS) -> DataFrame:
    """(bookmark, tag): author, hosts and present tags of each item, the first ``most`` by alphabet; all of them if None."""
    author = items.where(F.col("author_handle").isNotNull() & ~texts.is_address(F.col("author_handle"))).select(F.col("id").alias("bookmark"), F.col("author_handle").alias("tag"))
    own = items.select(F.col("id").alias("bookmark"), urls.host(F.col("url")).alias("tag"))
    hosts = link.select("bookmark", urls.host(F.col("resolved")).alias("tag"))
    every = author.union(own).union(hosts).union(tag.select("bookmark", F.lower(F.trim("tag")).alias("tag"))).where("tag <> ''")
    per = every.groupBy("bookmark").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    if most is not None:
        per = per.withColumn("tags", F.slice("tags", 1, most))
    return per.select("bookmark", F.explode("tags").alias("tag"))


def categorize(items: DataFrame, link: DataFrame, rules=DEFAULT_RULES, fallback: str = "general") -> DataFrame:
    """(bookmark, slug, confidence, assigned_by): rules over all links, or the fallback at one half."""
    routed = link.select("bookmark", route(F.col("resolved"), rules, fallback).alias("slug")).where(F.col("slug") != fallback).distinct()
    none = items.select(F.col("id").alias("bookmark")).join(routed, "bookmark", "left_anti")
    sure = routed.select("bookmark", "slug", F.lit(1.0).cast("float").alias("confidence"), F.lit("rule").alias("assigned_by"))
    return sure.union(none.select("bookmark", F.lit(fallback), F.lit(0.5).cast("float"), F.lit("rule")))


def describe(items: DataFrame, link: DataFrame, agent: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, title, summary): the agent's for untitled texts of up to 2000 characters, else what the item holds.

    ``agent`` maps (id, body) to (id, title, summary). The summary falls back to
    a link's, then to the first line of the text.
    """
    linked = link.where(F.trim("summary") != "").groupBy("bookmark").agg(F.min_by("summary", "ordinal").alias("__linked"))
    line = F.get(F.filter(F.transform(F.split(F.coalesce("body", F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), 0)
    base = items.join(linked.withColumnRenamed("bookmark", "id"), "id", "left")
    if agent is not None:
        todo = items.where((F.coalesce(F.trim("title"), F.lit("")) == "") & (F.trim("body") != "") & (F.length("body") <= 2000)).select("id", "body")
        base = base.join(agent(todo).select("id", texts.truncated(F.col("title"), 120).alias("__title"), texts.truncated(F.col("summary"), 400).alias("__summary")), "id", "left")
    else:
        base = base.withColumn("__title", F.lit(None).cast("string")).withColumn("__summary", F.lit(None).cast("string"))
    return base.select("id", F.coalesce("title", "__title").alias("title"), F.coalesce("__summary", "summary", "__linked", texts.truncated(line, 280, 277, "...")).alias("summary"))


def run_stage(store: Store, stage: str, now: int, agent=None, limit: int | None = None, most_tags: int | None = MOST_TAGS) -> int:
    """Runs one stage over its pending items and commits the result with their stamps as one version; returns their number."""
    t = store.tables()
    items = t["bookmark"]
    pending = items.where(F.col(f"{stage}_at").isNull())
    if limit:
        pending = pending.orderBy("id").limit(limit)
    n = pending.count()
    if n == 0:
        return 0
    ids = pending.select("id")
    inside = lambda df: df.join(ids.withColumnRenamed("id", "bookmark"), "bookmark", "left_semi")
    changed: dict[str, DataFrame] = {}
    added: dict[str, DataFrame] = {}
    more_tags = lambda df: df.distinct().join(inside(t["tag"]), ["bookmark", "tag"], "left_anti")
    if stage == "entities":
        found = entities(pending)
        old = inside(t["link"])
        fresh = found.select(F.col("id").alias("bookmark"), F.posexplode("links").alias("at", "original")).join(old.select("bookmark", F.col("resolved").alias("original")), ["bookmark", "original"], "left_anti")
        fresh = urls.with_kind(fresh, "original", "kind").select("bookmark", (F.col("at") + 10_000).alias("ordinal"), "original", F.col("original").alias("resolved"), "kind", *[F.lit(None).cast("string").alias(c) for c in ("title", "body", "summary")], F.when(urls.is_paywalled(F.col("original")), "paywall").alias("blocked"))
        added["link"] = fresh
        added["tag"] = more_tags(found.select(F.col("id").alias("bookmark"), F.explode("tags").alias("tag")))
        items = items.join(found.select("id", F.col("fingerprint").alias("__fp")), "id", "left").withColumn("fingerprint", F.coalesce("__fp", "fingerprint")).drop("__fp")
    elif stage == "vision":
        added["tag"] = more_tags(vision(inside(t["media"])))
    elif stage == "tagged":
        changed["tag"] = replace_rows(t["tag"], tagging(pending, inside(t["link"]), inside(t["tag"]), most_tags))
    elif stage == "categorized":
        assigned = categorize(pending, inside(t["link"]))
        changed["item_category"] = replace_rows(t["item_category"], assigned) if "item_category" in t else assigned
    elif stage == "described":
        told = describe(pending, inside(t["link"]), agent)
        items = items.join(told.select("id", F.col("title").alias("__t"), F.col("summary").alias("__s")), "id", "left").withColumns({"title": F.coalesce("__t", "title"), "summary": F.coalesce("__s", "summary")}).drop("__t", "__s")
    changed["bookmark"] = stamp(items, ids, stage, now)
    store.commit(changed, added)
    return n


def next_batch(store: Store, stage: str, n: int) -> DataFrame:
    """The next ``n`` pending items of a stage by id, with their links, media, tags and categories."""
    t = store.tables()
    ids = t["bookmark"].where(F.col(f"{stage}_at").isNull()).orderBy("id").limit(n)
    empty = lambda schema: store.spark.createDataFrame([], schema)
    assigned = t.get("bookmark_category", empty("bookmark bigint, category bigint, confidence float, assigned_by string"))
    return hydrate(ids, t["link"], t["media"], t["tag"], assigned, t.get("category", empty("id bigint, slug string"))).orderBy("id")


def run_all(store: Store, now: int, only=None, without=(), agent=None) -> DataFrame:
    """Runs the stages in their order; (stage, done) of each."""
    done = [(s, run_stage(store, s, now, agent)) for s in ORDER if (only is None or s in only) and s not in without]
    return store.spark.createDataFrame(done, "stage string, done bigint")


def cost(done: DataFrame) -> DataFrame:
    """Estimated dollars: two questions for each item tagged or categorized."""
    return done.agg(F.round(F.sum(F.when(F.col("stage").isin("tagged", "categorized"), F.col("done")).otherwise(0)) * QUESTION * 2, 6).alias("dollars"))
