"""Queries over the archive tables for the operators of the core, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsieve.functions import texts, urls
from keepsieve.operators import fingerprints, index, query, rules, search, stages
from keepsieve.operators.catalog import query as register
from keepsieve.operators.store import edit_tags, latest_wins, new_items, replace_rows, stamp
from keepsieve.plans.runtime import read_table, spread
from keepsieve.sinks import render

HOST = f"regexp_replace(lower(regexp_extract({{u}}, '{urls.HOST_PATTERN}', 1)), '^(www\\.)+', '')"
PATH = f"regexp_extract({{u}}, '{urls.PATH_PATTERN}', 1)"
QUERY = f"regexp_extract({{u}}, '{urls.QUERY_PATTERN}', 1)"
TRACKED = "(lower(k) IN (" + urls.quoted(urls.TRACKING) + ") OR " + " OR ".join(f"starts_with(lower(k), '{p}')" for p in urls.TRACKING_PREFIXES) + ")"


def host_sql(u: str) -> str:
    return HOST.format(u=u)


def ascii_lower_sql(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


# ---- lists, filters, counts


@register("SELECT id, medium, title, ingested_at FROM bookmark ORDER BY ingested_at DESC, id DESC LIMIT 50 OFFSET 100")
def list_page(spark: SparkSession, d: str) -> DataFrame:
    return query.page(read_table(spark, d, "bookmark").select("id", "medium", "title", "ingested_at"), "ingested_at", 50, 100)


@register("SELECT id, medium, external_id FROM bookmark WHERE entities_at IS NULL AND id > 6000000000000000 ORDER BY id LIMIT 256")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    items = read_table(spark, d, "bookmark")
    return query.keyset_page(items, F.col("entities_at").isNull(), 6_000_000_000_000_000, 256).select("id", "medium", "external_id")


@register(
    """SELECT id, medium FROM bookmark WHERE (coalesce(body ILIKE '%magnetic field%', false) OR coalesce(title ILIKE '%magnetic field%', false)
 OR coalesce(summary ILIKE '%magnetic field%', false) OR coalesce(extra ILIKE '%magnetic field%', false)) AND medium = 'rss'
 AND (id >> 16) + 1577836800000 BETWEEN 1590000000000 AND 1740000000000 AND described_at IS NOT NULL"""
)
def filter_items(spark: SparkSession, d: str) -> DataFrame:
    items = read_table(spark, d, "bookmark").withColumn("created_ms", texts.id_to_millis(F.col("id")))
    return query.Filter(text="magnetic_field", medium="rss", since=1_590_000_000_000, until=1_740_000_000_000, described=True).apply(items).select("id", "medium")


@register(
    """SELECT id, title FROM bookmark b WHERE EXISTS (SELECT 1 FROM tag t WHERE t.bookmark = b.id AND t.tag = 'later')
 AND EXISTS (SELECT 1 FROM bookmark_category x JOIN category c ON c.id = x.category WHERE x.bookmark = b.id AND c.slug IN ('tools', 'papers'))"""
)
def filter_tag_category(spark: SparkSession, d: str) -> DataFrame:
    t = {n: read_table(spark, d, n) for n in ("bookmark", "tag", "bookmark_category", "category")}
    return query.Filter(tags=["later"], categories=["tools", "papers"]).apply(t["bookmark"], t["tag"], t["bookmark_category"], t["category"]).select("id", "title")


@register("SELECT id, medium FROM bookmark WHERE id IN (SELECT bookmark FROM tag WHERE tag = 'later') AND id NOT IN (SELECT bookmark FROM bookmark_category)")
def tagged_without_category(spark: SparkSession, d: str) -> DataFrame:
    items = query.Filter(tags=["later"]).apply(read_table(spark, d, "bookmark"), read_table(spark, d, "tag"))
    assigned = read_table(spark, d, "bookmark_category").select(F.col("bookmark").alias("id"))
    return items.join(assigned, "id", "left_anti").select("id", "medium")


@register("SELECT medium, count(*) AS n FROM bookmark GROUP BY medium")
def medium_counts(spark: SparkSession, d: str) -> DataFrame:
    return query.counts(read_table(spark, d, "bookmark"), "medium")


@register("SELECT tag, count(*) AS n FROM (SELECT DISTINCT bookmark, lower(trim(tag)) AS tag FROM tag) WHERE tag <> '' GROUP BY tag ORDER BY n DESC, tag LIMIT 100")
def top_tags(spark: SparkSession, d: str) -> DataFrame:
    clean = read_table(spark, d, "tag").select("bookmark", F.lower(F.trim("tag")).alias("tag")).where("tag <> ''").distinct()
    return query.counts(clean, "tag", top=100)


@register(" UNION ALL ".join(f"SELECT '{s}' AS stage, count(*) AS pending FROM bookmark WHERE {s}_at IS NULL" for s in query.STAGES))
def stage_backlog(spark: SparkSession, d: str) -> DataFrame:
    return query.backlog(read_table(spark, d, "bookmark"))


@register("SELECT count(*) AS items, coalesce(max(ingested_at), 0) AS newest FROM bookmark")
def archive_stamp(spark: SparkSession, d: str) -> DataFrame:
    return query.archive_stamp(read_table(spark, d, "bookmark"))


@register("SELECT id FROM bookmark WHERE entities_at IS NOT NULL AND vision_at IS NOT NULL AND tagged_at IS NOT NULL AND categorized_at IS NOT NULL AND described_at IS NOT NULL")
def complete_items(spark: SparkSession, d: str) -> DataFrame:
    return query.complete(read_table(spark, d, "bookmark")).select("id")


@register(
    """SELECT b.id, count(DISTINCT x.slug) AS n_categories, string_agg(DISTINCT x.slug, '|' ORDER BY x.slug) AS slugs, min(x.confidence) AS least
 FROM bookmark b JOIN (SELECT a.bookmark, c.slug, round(a.confidence::DOUBLE, 4) AS confidence FROM bookmark_category a JOIN category c ON c.id = a.category) x ON x.bookmark = b.id GROUP BY b.id"""
)
def item_categories(spark: SparkSession, d: str) -> DataFrame:
    named = read_table(spark, d, "bookmark_category").join(read_table(spark, d, "category").select(F.col("id").alias("category"), "slug"), "category")
    per = named.groupBy(F.col("bookmark").alias("id")).agg(F.array_sort(F.collect_set("slug")).alias("s"), F.min(F.round(F.col("confidence").cast("double"), 4)).alias("least"))
    ids = read_table(spark, d, "bookmark").select("id").distinct()
    return per.join(ids, "id", "left_semi").select("id", F.size("s").cast("bigint").alias("n_categories"), F.array_join("s", "|").alias("slugs"), "least")


def _hydrated(spark: SparkSession, d: str) -> DataFrame:
    t = {n: read_table(spark, d, n) for n in ("bookmark", "link", "media", "tag", "bookmark_category", "category")}
    return query.hydrate(t["bookmark"].withColumn("created_ms", texts.id_to_millis(F.col("id"))), t["link"], t["media"], t["tag"], t["bookmark_category"], t["category"])


PREPARED = rf"""WITH l AS (SELECT DISTINCT bookmark, ordinal, original, resolved, kind, title, body, summary, blocked FROM link),
la AS (SELECT bookmark, string_agg(resolved, ' ' ORDER BY ordinal, original, resolved) AS links, count(*) AS n_links,
 first(nullif(trim(title), '') ORDER BY ordinal, original, resolved, kind, title) FILTER (WHERE nullif(trim(title), '') IS NOT NULL) AS ltitle,
 first(nullif(trim(summary), '') ORDER BY ordinal, original, resolved, kind, title) FILTER (WHERE nullif(trim(summary), '') IS NOT NULL) AS lsummary FROM l GROUP BY bookmark),
ta AS (SELECT bookmark, string_agg(DISTINCT lower(trim(tag)), ' ' ORDER BY lower(trim(tag))) AS tags FROM tag GROUP BY bookmark),
ma AS (SELECT bookmark, count(*) AS n_media FROM (SELECT DISTINCT * FROM media) GROUP BY bookmark),
cb AS (SELECT a.bookmark, c.slug, max(a.confidence) AS confidence FROM bookmark_category a JOIN category c ON c.id = a.category GROUP BY ALL),
ca AS (SELECT bookmark, string_agg(slug, ' ' ORDER BY confidence DESC, slug) AS cats, first(slug ORDER BY confidence DESC, slug) AS cat1 FROM cb GROUP BY bookmark),
b0 AS (SELECT *, list_filter(list_transform(string_split_regex(coalesce(body, ''), '\r?\n'), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, 'http'))[1] AS line1,
 {host_sql('url')} AS uhost, list_filter(list_reverse(string_split({PATH.format(u='url')}, '/')), lambda x: x <> '')[1] AS ulast FROM bookmark),
b1 AS (SELECT b0.*, la.links, la.n_links, ta.tags, ma.n_media, ca.cats, ca.cat1, la.lsummary,
 trim(regexp_replace(coalesce(nullif(trim(title), ''), ltitle, line1, nullif(CASE WHEN ulast IS NULL THEN uhost ELSE uhost || ' · ' || ulast END, ''), medium || ' ' || external_id), '[\s ]+', ' ', 'g')) AS t0
 FROM b0 LEFT JOIN la ON la.bookmark = b0.id LEFT JOIN ta ON ta.bookmark = b0.id LEFT JOIN ma ON ma.bookmark = b0.id LEFT JOIN ca ON ca.bookmark = b0.id),
p AS (SELECT *, CASE WHEN length(t0) > 120 THEN substr(t0, 1, 117) || '…' ELSE t0 END AS dtitle, coalesce(nullif(trim(summary), ''), lsummary) AS dsummary,
 CASE WHEN nullif(trim(author_name), '') IS NULL OR author_name = author_handle THEN author_handle WHEN author_handle IS NULL THEN author_name ELSE author_handle || ' (' || author_name || ')' END AS author,
 (id >> 16) + 1577836800000 AS created, coalesce(cat1, collection, medium) AS folder FROM b1)
"""


@register(PREPARED + "SELECT id, coalesce(n_links, 0) AS n_links, coalesce(n_media, 0) AS n_media, coalesce(tags, '') AS tags, coalesce(cats, '') AS categories, coalesce(links, '') AS links FROM p")
def hydrate_satellites(spark: SparkSession, d: str) -> DataFrame:
    full = _hydrated(spark, d)
    return full.select("id", F.size("links").cast("bigint").alias("n_links"), F.size("media").cast("bigint").alias("n_media"), F.array_join("tags", " ").alias("tags"), F.array_join(F.transform("categories", lambda c: c["slug"]), " ").alias("categories"), F.array_join(F.transform("links", lambda x: x["resolved"]), " ").alias("links"))


@register(PREPARED + "SELECT id, dtitle AS title, dsummary AS summary, author, folder, strftime(make_timestamp(created * 1000), '%Y-%m-%d') AS day FROM p")
def display_fields(spark: SparkSession, d: str) -> DataFrame:
    return render.prepared(_hydrated(spark, d)).select("id", "title", "summary", "author", "folder", "day")


# ---- identity, upserts, stamps


@register("SELECT id, medium, external_id FROM (SELECT *, row_number() OVER (PARTITION BY medium, external_id ORDER BY ingested_at, id) AS r FROM bookmark) WHERE r = 1")
def first_capture(spark: SparkSession, d: str) -> DataFrame:
    return query.first_wins(read_table(spark, d, "bookmark"), ["medium", "external_id"], [F.col("ingested_at"), F.col("id")]).select("id", "medium", "external_id")


@register(
    """WITH old AS (SELECT DISTINCT medium, external_id FROM bookmark WHERE ingested_at < 1680000000000), new AS (SELECT *, row_number() OVER (PARTITION BY medium, external_id ORDER BY ingested_at, id) AS r FROM bookmark WHERE ingested_at >= 1680000000000)
SELECT id, medium, external_id FROM new n WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM old o WHERE o.medium = n.medium AND o.external_id = n.external_id)"""
)
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    items = read_table(spark, d, "bookmark")
    stored, incoming = items.where("ingested_at < 1680000000000"), items.where("ingested_at >= 1680000000000")
    return new_items(stored, incoming, F.struct("ingested_at", "id")).select("id", "medium", "external_id")


@register("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    half = F.col("event_type").isin("click", "view")
    return latest_wins(e.where(half), e.where(~half), ["user_id", "event_type"], "event_id")


@register("SELECT id, CASE WHEN tagged_at IS NULL AND medium = 'rss' THEN 1800000000000 ELSE tagged_at END AS tagged_at FROM bookmark")
def stage_stamp(spark: SparkSession, d: str) -> DataFrame:
    items = read_table(spark, d, "bookmark").select("id", "medium", "tagged_at")
    done = items.where("tagged_at is null and medium = 'rss'").select("id")
    return stamp(items, done, "tagged", 1_800_000_000_000).select("id", "tagged_at")


@register(
    """SELECT bookmark, tag FROM tag t WHERE NOT (lower(trim(tag)) = 'github' AND EXISTS (SELECT 1 FROM bookmark b WHERE b.id = t.bookmark AND b.medium = 'github'))
UNION ALL SELECT id, 'starred' FROM bookmark b WHERE medium = 'github' AND NOT EXISTS (SELECT 1 FROM tag t WHERE t.bookmark = b.id AND t.tag = 'starred')"""
)
def tag_edit(spark: SparkSession, d: str) -> DataFrame:
    ids = read_table(spark, d, "bookmark").where("medium = 'github'").select("id")
    return edit_tags(read_table(spark, d, "tag"), ids, add=["starred"], remove=["github"])


@register(
    """SELECT bookmark, tag FROM tag WHERE bookmark NOT IN (SELECT id FROM bookmark WHERE medium = 'manual')
UNION ALL SELECT id, 'manual' FROM bookmark WHERE medium = 'manual'"""
)
def tag_replace(spark: SparkSession, d: str) -> DataFrame:
    fresh = read_table(spark, d, "bookmark").where("medium = 'manual'").select(F.col("id").alias("bookmark"), F.lit("manual").alias("tag"))
    return replace_rows(read_table(spark, d, "tag"), fresh)


@register(
    """SELECT id, author_handle, last_value(collection IGNORE NULLS) OVER (PARTITION BY author_handle ORDER BY ingested_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried
FROM bookmark WHERE author_handle IS NOT NULL"""
)
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    items = read_table(spark, d, "bookmark").where("author_handle is not null").select("id", "author_handle", "collection", "ingested_at")
    return query.carry_forward(items, by="author_handle", value="collection", at="ingested_at").select("id", "author_handle", "carried")


# ---- URLs


@register(f"SELECT DISTINCT bookmark, ordinal, h AS host, {urls.kind_sql('h', 'p')} AS url_kind FROM (SELECT bookmark, ordinal, {host_sql('resolved')} AS h, lower({PATH.format(u='resolved')}) AS p FROM link)")
def link_kinds(spark: SparkSession, d: str) -> DataFrame:
    got = urls.with_kind(read_table(spark, d, "link"), "resolved")
    return got.select("bookmark", "ordinal", urls.host(F.col("resolved")).alias("host"), "url_kind").distinct()


CANONICAL = (
    "(CASE WHEN scheme = 'http' THEN 'https' ELSE scheme END || '://' || h || CASE WHEN pa IN ('', '/') AND q = '' THEN '' WHEN pa = '' THEN '/' ELSE pa END || CASE WHEN q = '' THEN '' ELSE '?' || q END)"
)
URL_PARTS = f"""SELECT id, url, ingested_at, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, {host_sql('url')} AS h, {PATH.format(u='url')} AS pa,
 array_to_string(list_sort(list_filter(string_split({QUERY.format(u='url')}, '&'), lambda p: p <> '' AND NOT list_any_value([{TRACKED.replace('k)', "string_split(p, '=')[1])")}]))), '&') AS q FROM bookmark WHERE url IS NOT NULL"""


@register(f"SELECT id, {CANONICAL} AS canonical, substr(sha256({CANONICAL}), 1, 16) AS key FROM ({URL_PARTS})")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "bookmark").where("url is not null").select("id", urls.canonical(F.col("url")).alias("canonical"), urls.stable_key(F.col("url")).alias("key"))


@register(f"SELECT id, c AS canonical, n FROM (SELECT id, c, count(*) OVER (PARTITION BY c) AS n, row_number() OVER (PARTITION BY c ORDER BY ingested_at, id) AS r FROM (SELECT id, ingested_at, {CANONICAL} AS c FROM ({URL_PARTS}))) WHERE r = 1 AND n > 1")
def url_duplicates(spark: SparkSession, d: str) -> DataFrame:
    items = read_table(spark, d, "bookmark").where("url is not null").select("id", "ingested_at", urls.canonical(F.col("url")).alias("canonical"))
    got = items.groupBy("canonical").agg(F.min_by("id", F.struct("ingested_at", "id")).alias("id"), F.count("*").alias("n"))
    return got.where("n > 1").select("id", "canonical", "n")


@register(
    f"SELECT id, array_to_string(list_filter(list_transform(string_split({QUERY.format(u='url')}, '&'), lambda p: string_split(p, '=')[1]), lambda k: {TRACKED}), ',') AS tracking, "
    + f"regexp_matches('.' || {host_sql('url')}, '\\.("
    + "|".join(x.replace(".", "\\.") for x in urls.PAYWALLED)
    + ")$') AS paywalled FROM bookmark WHERE url IS NOT NULL"
)
def url_flags(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return read_table(spark, d, "bookmark").where("url is not null").select("id", F.array_join(urls.tracking_parameters(u), ",").alias("tracking"), urls.is_paywalled(u).alias("paywalled"))


@register("SELECT url, CASE WHEN regexp_matches(p, '\\.(mp4|webm|mov|m3u8|mkv|m4v)$') THEN 'video' WHEN p LIKE '%.gif' THEN 'gif' WHEN regexp_matches(p, '\\.(mp3|m4a|ogg|wav|flac|aac)$') THEN 'audio' ELSE 'photo' END AS by_name, octet_length(coalesce(alt_text, '')::BLOB) > 24 AS told FROM (SELECT DISTINCT *, lower(" + PATH.format(u="url") + ") AS p FROM media)")
def media_kinds(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "media").distinct()
    return m.select("url", urls.media_kind(F.col("url")).alias("by_name"), (F.octet_length(F.coalesce("alt_text", F.lit(""))) > 24).alias("told"))


# ---- text


def _texts(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("origin"), F.col("text").alias("body"))
    return docs.unionByName(read_table(spark, d, "bookmark").select("id", F.lit("bookmark").alias("origin"), "body"))


TEXTS = "(SELECT doc_id AS id, 'documents' AS origin, text AS body FROM documents UNION ALL SELECT id, 'bookmark', body FROM bookmark)"


def _entity_sql(pattern: str, group: int, clean: str = "x") -> str:
    low = ascii_lower_sql("x")
    return f"SELECT origin, id, x AS entity FROM (SELECT DISTINCT origin, id, {low} AS x FROM (SELECT origin, id, {clean} AS x FROM (SELECT origin, id, unnest(regexp_extract_all(coalesce(body, ''), '{pattern}', {group})) AS x FROM {TEXTS}))) WHERE x <> ''"


@register(_entity_sql("(?:^|[^A-Za-z0-9])@([A-Za-z][A-Za-z0-9_]*)", 1))
def mentions(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("origin", "id", F.explode(texts.mentions(F.col("body"))).alias("entity"))


@register(_entity_sql("#([A-Za-z0-9_]*[A-Za-z][A-Za-z0-9_]*;?)", 1, "CASE WHEN regexp_matches(x, '^([xX][0-9A-Fa-f]+|[0-9]+);$') THEN '' ELSE regexp_replace(x, ';$', '') END"))
def hashtags(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("origin", "id", F.explode(texts.hashtags(F.col("body"))).alias("entity"))


@register(_entity_sql("\\$([A-Za-z0-9_]*[A-Za-z][A-Za-z0-9_]*;?)", 1, "CASE WHEN regexp_matches(x, '^([xX][0-9A-Fa-f]+|[0-9]+);$') THEN '' ELSE regexp_replace(x, ';$', '') END"))
def cashtags(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("origin", "id", F.explode(texts.cashtags(F.col("body"))).alias("entity"))


_LABELS = "length(list_filter(string_split(x, '.'), lambda y: y <> ''))"
_LAST = "string_split(x, '.')[-1]"


@register(
    f"SELECT DISTINCT origin, id, {ascii_lower_sql(chr(39).join(['regexp_replace(x, ', '^[.]+|[.]+$', ', ', '', ', ', 'g', ')']))} AS entity FROM (SELECT origin, id, unnest(regexp_extract_all(coalesce(body, ''), '([A-Za-z0-9.-]+\\.[A-Za-z0-9._-]*)', 1)) AS x FROM {TEXTS}) "
    + f"WHERE {_LAST} IN ({urls.quoted(texts.TLDS)}) AND {_LABELS} >= 2 AND (length({_LAST}) <> 2 OR {_LABELS} >= 3)"
)
def bare_domains(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("origin", "id", F.explode(texts.bare_domains(F.col("body"))).alias("entity"))


@register(
    f"""SELECT DISTINCT origin, id, x AS entity FROM (SELECT origin, id, regexp_replace(regexp_extract(t, 'h.*'), '[.,;:!?''")\\]}}>]+$', '') AS x FROM
 (SELECT origin, id, unnest(string_split_regex(coalesce(body, ''), '\\s+')) AS t FROM {TEXTS})) WHERE regexp_matches(x, '^https?://[^/?#\\s]+')"""
)
def links_in_text(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("origin", "id", F.explode(urls.links_in(F.col("body"))).alias("entity"))


TOKEN_SQL = f"""list_filter(list_transform(list_filter(string_split_regex(coalesce(title || ' ', '') || coalesce(body, ''), '\\s+'), lambda w: regexp_matches(w, '^[\\p{{L}}\\p{{N}}''-]+$') AND NOT starts_with({ascii_lower_sql('w')}, 'http')),
 lambda w: {ascii_lower_sql("regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')")}), lambda w: strlen(w) > 2)"""


@register(f"SELECT id, array_to_string({TOKEN_SQL}, ' ') AS tokens FROM bookmark")
def tokens_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "bookmark").select("id", F.array_join(texts.fingerprint_tokens(F.col("title"), F.col("body")), " ").alias("tokens"))


@register(
    f"""WITH t AS (SELECT id, unnest({TOKEN_SQL}) AS w FROM bookmark), u AS (SELECT w, md5(w) AS m FROM (SELECT DISTINCT w FROM t)),
h AS (SELECT w, unnest(range(16)) AS k, m FROM u), n AS (SELECT w, k, instr('0123456789abcdef', substr(m, k + 1, 1)) - 1 AS v FROM h),
bits AS (SELECT w, 4 * k + j AS pos, (v >> (3 - j)) & 1 AS b FROM n, (SELECT unnest(range(4)) AS j)),
s AS (SELECT t.id, pos, sum(2 * b - 1) AS c FROM t JOIN bits USING (w) GROUP BY t.id, pos)
SELECT id, sum(CASE WHEN c > 0 THEN 1 ELSE 0 END)::BIGINT AS ones, sum(CASE WHEN c > 0 AND pos >= 32 THEN (1::BIGINT << (63 - pos)) ELSE 0 END)::BIGINT AS low FROM s GROUP BY id"""
)
def simhash(spark: SparkSession, d: str) -> DataFrame:
    """Set bits and lower half of each bookmark's SimHash."""
    tokens = texts.fingerprint_tokens(F.col("title"), F.col("body"))
    got = spread(read_table(spark, d, "bookmark").select("id", "title", "body")).select("id", tokens.alias("t")).where(F.size("t") > 0).select("id", fingerprints.simhash64(F.col("t")).alias("f"))
    return got.select("id", F.bit_count("f").cast("bigint").alias("ones"), F.col("f").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"))


@register("SELECT id, band, (fingerprint >> (16 * band)) & 65535 AS key FROM bookmark, (SELECT unnest(range(4)) AS band) WHERE fingerprint IS NOT NULL")
def fingerprint_bands(spark: SparkSession, d: str) -> DataFrame:
    items = read_table(spark, d, "bookmark").where("fingerprint is not null").select("id", F.explode(fingerprints.bands(F.col("fingerprint").cast("bigint"))).alias("x"))
    return items.select("id", F.col("x.band").cast("bigint").alias("band"), F.col("x.key").alias("key"))


@register(
    """WITH f AS (SELECT DISTINCT fingerprint::BIGINT AS fp FROM bookmark WHERE fingerprint IS NOT NULL AND fingerprint <> 0), k AS (SELECT fp, band, (fp >> (16 * band)) & 65535 AS key FROM f, (SELECT unnest(range(4)) AS band))
SELECT DISTINCT a.fp AS fp_a, b.fp AS fp_b, bit_count(xor(a.fp, b.fp)) AS distance FROM k a JOIN k b ON a.band = b.band AND a.key = b.key AND a.fp < b.fp WHERE bit_count(xor(a.fp, b.fp)) <= 3"""
)
def near_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Links between different fingerprints at most three bits apart."""
    return fingerprints.near_fingerprints(read_table(spark, d, "bookmark"), id="id", fingerprint="fingerprint")[1]


@register("SELECT id, fingerprint::BIGINT AS fingerprint, min(id) OVER (PARTITION BY fingerprint) AS representative FROM bookmark WHERE fingerprint IS NOT NULL AND fingerprint <> 0")
def fingerprint_members(spark: SparkSession, d: str) -> DataFrame:
    """Every fingerprinted bookmark with the first one of its fingerprint."""
    items = read_table(spark, d, "bookmark").where("fingerprint is not null and fingerprint <> 0").select("id", F.col("fingerprint").cast("bigint").alias("fingerprint"))
    return items.join(items.groupBy("fingerprint").agg(F.min("id").alias("representative")), "fingerprint").select("id", "fingerprint", "representative")


@register(
    r"""SELECT id, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M') AS minute, ms
FROM (SELECT id, (id >> 16) + 1577836800000 AS ms FROM bookmark)"""
)
def id_times(spark: SparkSession, d: str) -> DataFrame:
    items = read_table(spark, d, "bookmark").select("id", texts.id_to_millis(F.col("id")).alias("ms"))
    return items.select("id", texts.iso8601(F.col("ms")).alias("iso"), texts.date_time(F.col("ms")).alias("minute"), "ms")


@register("SELECT strftime(make_timestamp(ingested_at * 1000), '%Y-%m-%d') AS day, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM bookmark GROUP BY 1")
def day_sections(spark: SparkSession, d: str) -> DataFrame:
    items = read_table(spark, d, "bookmark").select("id", texts.date_only(F.col("ingested_at")).alias("day"))
    return items.groupBy("day").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@register("SELECT id, coalesce(nullif(trim(json_extract_string(raw, '$.id')), ''), nullif(trim(json_extract_string(raw, '$.tweetId')), '')) AS raw_id, try_cast(json_extract_string(raw, '$.points') AS BIGINT) AS points FROM bookmark WHERE raw IS NOT NULL")
def raw_fields(spark: SparkSession, d: str) -> DataFrame:
    first = lambda *keys: F.coalesce(*[texts.blank_to_null(F.get_json_object("raw", f"$.{k}")) for k in keys])
    return read_table(spark, d, "bookmark").where("raw is not null").select("id", first("id", "tweetId").alias("raw_id"), F.expr("try_cast(get_json_object(raw, '$.points') as bigint)").alias("points"))


@register("SELECT id, CASE WHEN NOT coalesce(regexp_matches(c, '^#([0-9a-f]{3}|[0-9a-f]{6})$'), false) THEN '#64748b' WHEN length(c) = 4 THEN '#' || c[2] || c[2] || c[3] || c[3] || c[4] || c[4] ELSE c END AS color FROM (SELECT id, lower(trim(color)) AS c FROM category)")
def category_colors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "category").select("id", texts.color(F.col("color")).alias("color"))


# ---- search

_WORDS = r"list_filter(string_split_regex(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def bm25_sql(source: str, id: str, fields: dict[str, float], terms: list[str], depth: int = 500) -> str:
    ws = {f"f{i}": (c, w) for i, (c, w) in enumerate(fields.items())}
    lists = ", ".join(f"{_WORDS.format(c=c)} AS {k}" for k, (c, _) in ws.items())
    dl = " + ".join(f"len({k})" for k in ws)
    tf = ", ".join("(" + " + ".join(f"{w} * len(list_filter({k}, lambda x: x = '{t}'))" for k, (_, w) in ws.items()) + f")::DOUBLE AS w{i}" for i, t in enumerate(terms))
    idf = lambda i: f"greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6)"
    part = " + ".join(f"{idf(i)} * (w{i} * 2.2) / (w{i} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    matched = " + ".join(f"(w{i} > 0)::INT" for i in range(len(terms)))
    return f"""WITH a AS (SELECT {id} AS id, {lists} FROM {source}), s AS (SELECT id, {dl} AS dl, {tf} FROM a),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (WHERE w{i} > 0) AS n{i}' for i in range(len(terms)))} FROM s),
r AS (SELECT id, -({part}) AS score, {matched} AS matched FROM s, st WHERE {' OR '.join(f'w{i} > 0' for i in range(len(terms)))}),
bm AS (SELECT id, score, matched FROM r WHERE matched = {len(terms)} OR (SELECT max(matched) FROM r) < {len(terms)} ORDER BY score, id LIMIT {depth})
"""


_FIELDS = {"title": 3.0, "body": 1.0, "extra": 1.5}


def _bookmark_index(spark: SparkSession, d: str) -> index.SearchIndex:
    return index.open_index(read_table(spark, d, "bookmark"), f"{d}/bookmark")


def _document_index(spark: SparkSession, d: str) -> index.SearchIndex:
    return index.open_index(read_table(spark, d, "documents"), f"{d}/documents", id="doc_id", fields={"body": "text"}, changed="saved_at")


@register(bm25_sql("bookmark", "id", _FIELDS, ["coral", "reef"]) + "SELECT id, round(score, 6) AS bm25, matched FROM bm")
def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    got = _bookmark_index(spark, d).bm25("coral reef")
    return got.select("id", F.round("bm25", 6).alias("bm25"), "matched")


@register(bm25_sql("documents", "doc_id", {"text": 1.0}, ["dumpling", "zzzunseen"]) + "SELECT id, round(score, 6) AS bm25, matched FROM bm")
def search_and_then_or(spark: SparkSession, d: str) -> DataFrame:
    got = _document_index(spark, d).bm25("dumpling zzzunseen")
    return got.select("id", F.round("bm25", 6).alias("bm25"), "matched")


@register("SELECT doc_id AS id FROM documents WHERE " + " OR ".join(f"contains({ascii_lower_sql('text')}, '{g}')" for g in ("ja", "az", "zz")))
def bigram_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _document_index(spark, d).candidates("jazz")


@register("SELECT doc_id AS id FROM documents WHERE " + " AND ".join(f"contains({ascii_lower_sql('text')}, '{g}')" for g in ("wa", "av", "ve", "fu", "un", "nc")))
def bigram_candidates_all(spark: SparkSession, d: str) -> DataFrame:
    return _document_index(spark, d).candidates("wave" + "\n" + "func", every=True)


_NEAR = f"""nw AS (SELECT DISTINCT id, w FROM (SELECT doc_id AS id, unnest({_WORDS.format(c='text')}) AS w FROM documents)),
nd AS (SELECT id, min(levenshtein(w, 'dumplnig')) AS distance FROM nw WHERE abs(length(w) - 8) <= 2 AND levenshtein(w, 'dumplnig') <= 2 GROUP BY id ORDER BY 2, 1 LIMIT 500)
"""


@register("WITH " + _NEAR + "SELECT id, distance FROM nd")
def search_word_distance(spark: SparkSession, d: str) -> DataFrame:
    return search.word_distance(read_table(spark, d, "documents"), "dumplnig", id="doc_id", content="text")


@register(
    bm25_sql("documents", "doc_id", {"text": 1.0}, ["dumpling"])
    + ", "
    + _NEAR
    + """, x AS (SELECT id, row_number() OVER (ORDER BY score, id) AS exact FROM bm), y AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS typo FROM nd),
j AS (SELECT coalesce(x.id, y.id) AS id, exact, typo, coalesce(1.0 / (60 + exact), 0) + coalesce(1.0 / (60 + typo), 0) AS fused FROM x FULL JOIN y ON x.id = y.id)
SELECT id, exact, typo, round(fused, 6) AS fused FROM j ORDER BY j.fused DESC, id LIMIT 50"""
)
def search_fused(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    exact = search.ranked(_document_index(spark, d).bm25("dumpling"), "bm25", "id")
    typo = search.ranked(search.word_distance(docs, "dumplnig", id="doc_id", content="text"), "distance", "id")
    got = search.fuse({"exact": exact, "typo": typo})
    return got.select("id", F.col("exact").cast("bigint").alias("exact"), F.col("typo").cast("bigint").alias("typo"), F.round("fused", 6).alias("fused"))


@register()
def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and typo-tolerant ranking of all bookmarks, fused."""
    return _bookmark_index(spark, d).search("magntic field")


_SCAN = bm25_sql("bookmark", "id", _FIELDS, ["dumpling"]) + ", h AS (SELECT id, score, row_number() OVER (ORDER BY score, id) AS rank FROM bm ORDER BY rank LIMIT 20 OFFSET 10)"


@register(_SCAN + " SELECT b.id, b.title, b.medium, h.rank - 10 AS rank FROM h JOIN bookmark b ON b.id = h.id")
def search_page(spark: SparkSession, d: str) -> DataFrame:
    """Second page of exact hits with their items, in order of rank."""
    hits = _bookmark_index(spark, d).search("dumpling", mode="exact", offset=10, limit=20)
    items = read_table(spark, d, "bookmark").select("id", "title", "medium")
    return index.with_ranks(items, hits, F.col("fused").desc(), F.col("id")).select("id", "title", "medium", F.col("rank").cast("bigint").alias("rank"))


@register(
    """WITH t AS (SELECT id, lower(concat_ws(' ', coalesce(title, ''), coalesce(body, ''), coalesce(extra, ''))) AS x FROM bookmark), c AS (SELECT x[i:i + 1] AS pair, id FROM t, unnest(range(1, len(x))) AS r(i))
SELECT pair, count(DISTINCT id) AS items FROM c WHERE regexp_matches(pair, '^[ -~]{2}$') GROUP BY pair""".replace("lower(", "translate(").replace("'')))", "'')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
)
def index_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Character pairs of the prefilter with the number of items that hold them."""
    rows = _bookmark_index(spark, d)._table("pairs").groupBy("pair").agg(F.count("*").alias("items"))
    return rows.select(F.concat(F.chr(F.floor(F.col("pair") / 256)), F.chr(F.col("pair") % 256)).alias("pair"), "items")


@register(
    f"""WITH w AS (SELECT id, unnest({_WORDS.format(c='title')}) AS term, 3.0 AS w FROM bookmark UNION ALL SELECT id, unnest({_WORDS.format(c='body')}), 1.0 FROM bookmark UNION ALL SELECT id, unnest({_WORDS.format(c='extra')}), 1.5 FROM bookmark)
SELECT term, count(DISTINCT id) AS df, count(*) AS cf, sum(w)::DOUBLE AS weighted FROM w GROUP BY term"""
)
def index_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the index with their frequencies."""
    rows = _bookmark_index(spark, d)._table("terms")
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.sum("weighted").alias("weighted"))


@register()
def stemmed_postings(spark: SparkSession, d: str) -> DataFrame:
    """Postings of stemmed words without accents, with document frequencies."""
    posts = search.postings(read_table(spark, d, "documents"), id="doc_id", fields={"body": "text"}, analyzer=search.porter_tokens)
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@register(
    f"""WITH w AS (SELECT doc_id AS id, {_WORDS.format(c='text')} AS ws FROM documents), p AS (SELECT id, unnest(list_filter(range(1, len(ws) + 1), lambda i: ws[i] IN ('magnetic', 'field'))) AS i FROM w),
g AS (SELECT id, i, i - row_number() OVER (PARTITION BY id ORDER BY i) AS island FROM p)
SELECT id, min(i)::INT AS first, max(i)::INT AS last FROM g GROUP BY id, island"""
)
def highlight_ranges(spark: SparkSession, d: str) -> DataFrame:
    words = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), search.tokens(F.col("text")).alias("ws"))
    at = F.filter(F.transform("ws", lambda w, i: F.when(w.isin("magnetic", "field"), i + 1)), lambda i: i.isNotNull())
    return words.select("id", F.explode(search.highlight_ranges(at)).alias("x")).select("id", "x.first", "x.last")


@register(f"SELECT tag, round(jaro_winkler_similarity(tag, 'compilr'), 6) AS score FROM (SELECT DISTINCT lower(trim(tag)) AS tag FROM tag) WHERE tag <> '' AND jaro_winkler_similarity(tag, 'compilr') >= 0.7 ORDER BY jaro_winkler_similarity(tag, 'compilr') DESC, tag LIMIT 3")
def suggest_names(spark: SparkSession, d: str) -> DataFrame:
    from keepsieve.functions.similarity import jaro_winkler

    tags = read_table(spark, d, "tag").select(F.lower(F.trim("tag")).alias("tag")).where("tag <> ''").distinct()
    scored = tags.withColumn("score", jaro_winkler(F.col("tag"), "compilr")).where("score >= 0.7").orderBy(F.col("score").desc(), "tag").limit(3)
    return scored.select("tag", F.round("score", 6).alias("score"))


# ---- rules and stages

_ROUTE_TEXT = "lower(trim(regexp_replace(regexp_replace({u}, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')))"
_TEST_RULES = (rules.Rule("tools", ["/software", "lab."]), rules.Rule("papers", ["/science"], ["notes"]), rules.Rule("recipes", ["/food"]), rules.Rule("reading-list", ["/arts", "/law"]), *rules.DEFAULT_RULES)


def _route_sql(u: str) -> str:
    t = _ROUTE_TEXT.format(u=u)
    arms = " ".join("WHEN (" + " OR ".join(f"contains({t}, '{n}')" for n in r.any) + ")" + "".join(f" AND contains({t}, '{n}')" for n in r.all) + f" THEN '{r.slug}'" for r in _TEST_RULES)
    return f"CASE {arms} ELSE 'general' END"


@register(f"SELECT DISTINCT bookmark, ordinal, {_route_sql('resolved')} AS slug FROM link")
def category_rules(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "link").select("bookmark", "ordinal", rules.route(F.col("resolved"), _TEST_RULES).alias("slug")).distinct()


@register(
    f"""WITH r AS (SELECT DISTINCT bookmark, {_route_sql('resolved')} AS slug FROM link), h AS (SELECT * FROM r WHERE slug <> 'general')
SELECT bookmark, slug, 1.0::DOUBLE AS confidence FROM h UNION ALL SELECT id, 'general', 0.5 FROM bookmark WHERE id NOT IN (SELECT bookmark FROM h)"""
)
def stage_categorize(spark: SparkSession, d: str) -> DataFrame:
    got = stages.categorize(read_table(spark, d, "bookmark"), read_table(spark, d, "link"), _TEST_RULES)
    return got.select("bookmark", "slug", F.col("confidence").cast("double").alias("confidence"))


@register("SELECT DISTINCT bookmark, 'needs-description' AS tag FROM (SELECT bookmark, ordinal, octet_length(coalesce(alt_text, '')::BLOB) AS n FROM media WHERE ordinal < 4) WHERE n <= 24")
def stage_vision(spark: SparkSession, d: str) -> DataFrame:
    return stages.vision(read_table(spark, d, "media"))


@register(
    f"""WITH e AS (SELECT id AS bookmark, author_handle AS tag FROM bookmark WHERE author_handle IS NOT NULL AND NOT regexp_matches(author_handle, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')
 UNION SELECT id, {host_sql('url')} FROM bookmark WHERE url IS NOT NULL UNION SELECT bookmark, {host_sql('resolved')} FROM link UNION SELECT bookmark, lower(trim(tag)) FROM tag)
SELECT bookmark, tag FROM (SELECT *, row_number() OVER (PARTITION BY bookmark ORDER BY tag) AS r FROM e WHERE tag <> '') WHERE r <= 24"""
)
def stage_tags(spark: SparkSession, d: str) -> DataFrame:
    return stages.tagging(read_table(spark, d, "bookmark"), read_table(spark, d, "link"), read_table(spark, d, "tag"))


@register(
    r"""WITH l AS (SELECT bookmark, first(summary ORDER BY ordinal) AS s FROM (SELECT DISTINCT bookmark, ordinal, summary FROM link) WHERE trim(summary) <> '' GROUP BY bookmark),
b AS (SELECT *, list_filter(list_transform(string_split_regex(coalesce(body, ''), '\r?\n'), lambda x: trim(x)), lambda x: x <> '')[1] AS line FROM bookmark)
SELECT b.id, b.title, coalesce(b.summary, l.s, CASE WHEN length(line) > 280 THEN substr(line, 1, 277) || '...' ELSE line END) AS summary FROM b LEFT JOIN l ON l.bookmark = b.id"""
)
def stage_describe(spark: SparkSession, d: str) -> DataFrame:
    return stages.describe(read_table(spark, d, "bookmark"), read_table(spark, d, "link"))


@register()
def stage_entities(spark: SparkSession, d: str) -> DataFrame:
    """Links, tags and fingerprint of every bookmark."""
    got = stages.entities(read_table(spark, d, "bookmark"))
    return got.select("id", F.array_join("links", " ").alias("links"), F.array_join("tags", " ").alias("tags"), "fingerprint")


@register("SELECT round((SELECT count(*) FROM bookmark WHERE tagged_at IS NOT NULL) * 0.000013 + (SELECT count(*) FROM bookmark WHERE categorized_at IS NOT NULL) * 0.000013, 6) AS dollars")
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    one = read_table(spark, d, "bookmark").agg(*[F.count(f"{s}_at").alias(s) for s in query.STAGES])
    done = one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("done")) for s in query.STAGES])).alias("x")).select("x.*")
    return stages.cost(done)


# ---- renderers


_CSV = lambda x: f"""CASE WHEN regexp_matches({x}, '[",\r\n]') THEN '"' || replace({x}, '"', '""') || '"' ELSE {x} END"""
_XML = lambda x: f"""replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')"""
_CELLS = ["id::VARCHAR", "strftime(make_timestamp(created * 1000), '%Y-%m-%dT%H:%M:%SZ')", "coalesce(medium, '')", "coalesce(author, '')", "coalesce(dtitle, '')", "coalesce(url, '')", "coalesce(tags, '')", "coalesce(cats, '')", "coalesce(body, '')", "coalesce(dsummary, '')", "coalesce(links, '')"]


@register(PREPARED + "SELECT id, md5(" + " || ',' || ".join(_CSV(c) for c in _CELLS) + ") AS row_md5 FROM p")
def render_csv(spark: SparkSession, d: str) -> DataFrame:
    return render.csv_rows(render.prepared(_hydrated(spark, d))).select("id", F.md5("line").alias("row_md5"))


_NOTE = "(coalesce(dsummary, '') || coalesce(' — @' || regexp_replace(author_handle, '^@', ''), ''))"


@register(
    PREPARED
    + f"""SELECT folder, id, md5('<outline type="rss" text="' || {_XML('dtitle')} || '" title="' || {_XML('dtitle')} || '"' || coalesce(' url="' || {_XML('url')} || '"', '') || ' addDate="' || (created // 1000)::VARCHAR || '"'
 || coalesce(' tags="' || {_XML("array_to_string(string_split(tags, ' '), ',')")} || '"', '') || '>' || CASE WHEN {_NOTE} = '' THEN '' ELSE '<description>' || {_XML(_NOTE)} || '</description>' END || '</outline>') AS row_md5
FROM (SELECT * REPLACE ((SELECT string_agg(DISTINCT lower(trim(t.tag)), ',' ORDER BY lower(trim(t.tag))) FROM tag t WHERE t.bookmark = p.id) AS tags) FROM p)""".replace("array_to_string(string_split(tags, ' '), ',')", "tags")
)
def render_opml(spark: SparkSession, d: str) -> DataFrame:
    return render.opml_outlines(render.prepared(_hydrated(spark, d))).select("folder", "id", F.md5("line").alias("row_md5"))


@register()
def render_json(spark: SparkSession, d: str) -> DataFrame:
    return render.json_lines(render.prepared(_hydrated(spark, d)))


_TAG_LIST = "coalesce((SELECT list_sort(list(DISTINCT lower(trim(t.tag)))) FROM tag t WHERE t.bookmark = p.id), [])"
_DAY = "strftime(make_timestamp(created * 1000), '%Y-%m-%d')"
_EXCERPT = r"trim(regexp_replace(coalesce(dsummary, body, ''), '[\s \x0B]+', ' ', 'g'))"


@register(
    PREPARED
    + f"""SELECT {_DAY} AS section, id AS at, md5('<article><h3>' || CASE WHEN url IS NULL THEN {_XML('dtitle')} ELSE '<a href="' || {_XML('url')} || '">' || {_XML('dtitle')} || '</a>' END || '</h3><p>'
 || {_XML(f"CASE WHEN length({_EXCERPT}) > 240 THEN substr({_EXCERPT}, 1, 237) || '…' ELSE {_EXCERPT} END")} || '</p><ul>' || array_to_string(list_transform({_TAG_LIST}[1:12], lambda v: '<li>' || {_XML('v')} || '</li>'), '') || '</ul></article>') AS line_md5 FROM p
UNION ALL SELECT DISTINCT {_DAY}, 0, md5('<section><h2>' || {_DAY} || '</h2>') FROM p UNION ALL SELECT DISTINCT {_DAY}, 1, md5('</section>') FROM p"""
)
def render_html(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the HTML document: opening (at 0) and closing (at 1) of each day, and an article for each item."""
    lines = render.html_document(render.prepared(_hydrated(spark, d)))
    return lines.select("section", F.when(F.col("part") == 1, -F.col("at")).when(F.col("part") == 2, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("at"), F.md5("line").alias("line_md5"))


@register(
    PREPARED
    + f"""SELECT id, {_DAY} AS day, md5(concat_ws(chr(10) || chr(10), '# ' || dtitle, author, url, nullif(trim(body), ''), nullif(array_to_string(list_transform({_TAG_LIST}, lambda v: '#' || v), ' '), '')) || chr(10)) AS note_md5 FROM p"""
)
def render_markdown(spark: SparkSession, d: str) -> DataFrame:
    return render.markdown_notes(render.prepared(_hydrated(spark, d))).select("id", "day", F.md5("note").alias("note_md5"))


_YAML = lambda x: f"(chr(39) || replace(regexp_replace({x}, '[\r\n]+', ' ', 'g'), chr(39), chr(39) || chr(39)) || chr(39))"


@register(
    PREPARED
    + f"""SELECT id, md5(concat_ws(chr(10) || chr(10), concat_ws(chr(10), '---', 'title: ' || {_YAML('dtitle')}, 'date: ' || {_DAY}, 'created: ' || created::VARCHAR, 'author: ' || {_YAML('author')}, 'source: ' || medium, 'id: ' || external_id, 'url: ' || url,
 'categories: [' || replace(cats, ' ', ', ') || ']', CASE WHEN len({_TAG_LIST}) > 0 THEN 'tags: [' || array_to_string({_TAG_LIST}, ', ') || ']' END, '---'), '[[' || replace(cats, ' ', ']] [[') || ']]', author, nullif(trim(body), '')) || chr(10)) AS note_md5 FROM p"""
)
def render_obsidian(spark: SparkSession, d: str) -> DataFrame:
    return render.obsidian_notes(render.prepared(_hydrated(spark, d))).select("id", F.md5("note").alias("note_md5"))


@register(
    PREPARED
    + "SELECT id, substr(regexp_replace(external_id, '[^A-Za-z0-9_-]', '', 'g'), 1, 40) || '-' || substr(sha256(external_id), 1, 16) || '.json' AS file, md5(raw) AS payload_md5 FROM p WHERE raw IS NOT NULL"
)
def render_archive(spark: SparkSession, d: str) -> DataFrame:
    items = render.prepared(_hydrated(spark, d)).where("raw is not null")
    return items.select("id", render.payload_name().alias("file"), F.md5("raw").alias("payload_md5"))


# ---- streams


@register("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    from keepsieve.streaming.ingest import windowed_counts

    got = windowed_counts(read_table(spark, d, "events"))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register(
    """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    from keepsieve.streaming.ingest import sessions

    return sessions(read_table(spark, d, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
