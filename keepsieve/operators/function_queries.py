"""Queries that run the column functions over whole tables, each beside the same thing said in SQL.

Where the tables hold no input of the needed form, it is put together from their columns, in both alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsieve.functions import pages, replies, texts, urls
from keepsieve.operators import query, rules
from keepsieve.operators.catalog import query as register
from keepsieve.operators.queries import PREPARED, _hydrated, ascii_lower_sql, host_sql
from keepsieve.operators.store import assign_categories, delete, enriched_extra, index_extra, latest_wins
from keepsieve.plans.runtime import read_table

#: The inputs, as text that both dialects read.
REPOSITORY = "concat('https://github.com/', coalesce(author_handle, 'x'), '/', medium, CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN '.git' WHEN 2 THEN '/' WHEN 3 THEN '/issues' ELSE '?tab=1' END)"
VIDEO = "concat(CASE id % 5 WHEN 0 THEN 'https://youtu.be/' WHEN 1 THEN 'https://www.youtube.com/watch?x=1&v=' WHEN 2 THEN 'https://youtube.com/embed/' WHEN 3 THEN 'https://m.youtube.com/shorts/' ELSE 'https://vimeo.com/' END, substr(md5(external_id), 1, 11), CASE WHEN id % 2 = 0 THEN '?t=3' ELSE '' END)"
STATUS = "(200 + id % 350)"
FILED = "CASE id % 3 WHEN 0 THEN concat('[note](', external_id, '.md)') WHEN 1 THEN concat('/abs/', external_id) ELSE concat(' ', external_id, ' ') END"
EPOCH = "CASE id % 4 WHEN 0 THEN CAST(floor(ingested_at / 1000) AS BIGINT) WHEN 1 THEN ingested_at WHEN 2 THEN ingested_at * 1000 ELSE ingested_at * 1000000 END"
AUTHOR = "CASE id % 3 WHEN 0 THEN concat(medium, '@mail.example (', coalesce(author_name, ''), ')') WHEN 1 THEN concat(coalesce(author_name, 'N'), ' (', medium, '@mail.example)') ELSE coalesce(author_name, '') END"
SPELLED = "concat(' ', upper(replace(medium, '-', CASE WHEN id % 2 = 0 THEN '_' ELSE ' ' END)))"
FENCED = "concat(CASE id % 3 WHEN 0 THEN concat('```json', chr(10)) WHEN 1 THEN concat('```', chr(10)) ELSE '' END, '{\"title\":\"', medium, '\"}', CASE WHEN id % 3 < 2 THEN concat(chr(10), '```') ELSE '' END)"
MARKED = "concat('pay $', replace(medium, '-', '_'), '; or $100 at ', coalesce(author_handle, 'one'), '.co.uk, see https://in.link.dev/x and ', replace(medium, '-', ''), '.dev or main.rs')"
PAGE = "concat('<html><head><title> T ', medium, ' </title><meta property=\"og:description\" content=\"S &amp; ', external_id, '\"><meta content=\"', coalesce(author_handle, 'nobody'), '\" name=\"author\"><link rel=\"canonical\" href=\"https://c.example/', external_id, '\"></head><body><p>', CASE WHEN id % 4 = 0 THEN 'Subscribe to continue' ELSE 'short' END, '</p></body></html>')"
REPLY = "concat('{\"answers\":{\"kind\":{\"type\":\"choice\",\"choice\":\"', assigned_by, '\",\"probabilities\":{\"a\":0.25}},\"ok\":{\"type\":\"boolean\",\"probability\":0.75},\"rank\":{\"type\":\"score\",\"score\":', CAST(category AS STRING), '}}}')"
EVENT = "concat(CASE event_type WHEN 'click' THEN '{\"part\":{\"text\":\"' WHEN 'view' THEN '{\"result\":\"' ELSE '{\"other\":\"' END, CAST(event_id AS STRING), CASE WHEN event_type = 'click' THEN '\"}}' ELSE '\"}' END)"


def _bookmarks(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "bookmark")


@register(f"SELECT id, CASE WHEN regexp_matches(u, '^https://github.com/[^/?#]+/[^/?#]+/?([?#].*)?$') THEN regexp_replace(regexp_extract(u, '^https://github.com/([^/?#]+/[^/?#]+)', 1), '\\.git$', '') END AS repository FROM (SELECT id, {REPOSITORY} AS u FROM bookmark)")
def repositories(spark: SparkSession, d: str) -> DataFrame:
    return _bookmarks(spark, d).select("id", urls.repository(F.expr(REPOSITORY)).alias("repository"))


@register("SELECT id, CASE WHEN id % 5 < 4 THEN substr(md5(external_id), 1, 11) END AS video FROM bookmark")
def video_ids(spark: SparkSession, d: str) -> DataFrame:
    return _bookmarks(spark, d).select("id", urls.video_id(F.expr(VIDEO)).alias("video"))


_HOSTS = ["a.example", *urls.EMBED_ENDPOINTS]
_HOST = "CASE id % {n} {arms} END".format(n=len(_HOSTS), arms=" ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HOSTS)))


@register("SELECT id, CASE id % {n} {arms} END AS endpoint FROM bookmark".format(n=len(_HOSTS), arms=" ".join(f"WHEN {i} THEN '{urls.EMBED_ENDPOINTS[h]}'" for i, h in enumerate(_HOSTS) if h in urls.EMBED_ENDPOINTS)))
def embed_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return _bookmarks(spark, d).select("id", urls.embed_endpoint(F.expr(f"concat('https://www.', {_HOST}, '/x')")).alias("endpoint"))


@register("SELECT id, replace(replace(replace(replace(url_encode(title), '-', '%2D'), '.', '%2E'), '_', '%5F'), '~', '%7E') AS encoded FROM bookmark WHERE title IS NOT NULL")
def percent_encoded(spark: SparkSession, d: str) -> DataFrame:
    return _bookmarks(spark, d).where("title is not null").select("id", urls.percent_encode(F.col("title")).alias("encoded"))


@register(f"SELECT id, CASE WHEN s IN (401, 402, 403) THEN 'paywall' WHEN s = 404 OR s = 410 THEN 'gone' ELSE 'refused' END AS reason FROM (SELECT id, {STATUS} AS s FROM bookmark)")
def status_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _bookmarks(spark, d).select("id", urls.blocked_from_status(F.expr(STATUS)).alias("reason"))


@register("SELECT DISTINCT bookmark, ordinal, string_split(string_split(resolved, '//')[2], '/')[1] AS host FROM link")
def feed_hosts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "link").select("bookmark", "ordinal", urls.feed_host(F.col("resolved")).alias("host")).distinct()


@register("SELECT id, 'file://' || CASE id % 3 WHEN 0 THEN '/home/me/' || external_id || '.md' WHEN 1 THEN '/abs/' || external_id ELSE '/home/me/' || trim(external_id) END AS target FROM bookmark")
def filed_targets(spark: SparkSession, d: str) -> DataFrame:
    return _bookmarks(spark, d).select("id", urls.filed_target(F.expr(FILED), "/home/me/").alias("target"))


@register("SELECT id, CASE WHEN id % 4 = 0 THEN ingested_at // 1000 * 1000 ELSE ingested_at END AS ms FROM bookmark")
def epoch_values(spark: SparkSession, d: str) -> DataFrame:
    return _bookmarks(spark, d).select("id", texts.epoch_ms(F.expr(EPOCH)).alias("ms"))


def _unescape_sql(x: str) -> str:
    for a, b in texts.PAGE_ENTITIES:
        quoted = lambda v: "'" + v.replace("'", "''") + "'"
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    return x


_SQUASH = lambda x: f"trim(regexp_replace({x}, '[\\s \\x0B]+', ' ', 'g'))"


_UNTAGGED = "regexp_replace(text, '<[^>]*>', ' ', 'g')"


@register(f"SELECT doc_id, md5({_SQUASH(_unescape_sql('text'))}) AS cleaned, md5({_SQUASH(_unescape_sql(_UNTAGGED))}) AS stripped FROM documents")
def cleaned_texts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", F.md5(texts.clean(F.col("text"))).alias("cleaned"), F.md5(texts.strip_html(F.col("text"))).alias("stripped"))


_BARE = "regexp_replace(regexp_replace(regexp_replace('<nav>menu</nav><script>x()</script>' || body, '<nav>menu', ''), '<script>x\\(\\)', ''), '<[^>]*>', '', 'g')"


@register(f"SELECT DISTINCT bookmark, ordinal, length({_BARE}) AS shown, length(body) > 280 AS usable FROM link WHERE body IS NOT NULL")
def visible_characters(spark: SparkSession, d: str) -> DataFrame:
    body = read_table(spark, d, "link").where("body is not null")
    return body.select("bookmark", "ordinal", pages.visible_chars(F.concat(F.lit("<nav>menu</nav><script>x()</script>"), "body")).alias("shown"), (F.length("body") > pages.LEAST_BODY).alias("usable")).distinct()


@register("SELECT id, CASE WHEN id % 3 = 2 THEN trim(string_split(coalesce(author_name, ''), '(')[1]) ELSE medium || '@mail.example' END AS address, CASE id % 3 WHEN 0 THEN nullif(trim(coalesce(author_name, '')), '') WHEN 1 THEN trim(coalesce(author_name, 'N')) END AS name FROM bookmark WHERE coalesce(author_name, '') NOT LIKE '%(%' AND coalesce(author_name, '') NOT LIKE '%)%'")
def feed_authors(spark: SparkSession, d: str) -> DataFrame:
    named = _bookmarks(spark, d).where(~F.coalesce("author_name", F.lit("")).rlike(r"[()]"))
    return named.select("id", texts.feed_author(F.expr(AUTHOR)).alias("a")).select("id", "a.address", "a.name")


@register("SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(range(1, length(t)), lambda i: substr(t, i, 2)), lambda p: regexp_matches(p, '^[ -~]{2}$')))), '') AS pairs FROM (SELECT id, " + ascii_lower_sql("title") + " AS t FROM bookmark WHERE title IS NOT NULL)")
def title_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _bookmarks(spark, d).where("title is not null").select("id", F.array_join(F.array_sort(texts.bigrams(F.col("title"))), "").alias("pairs"))


@register("SELECT id, medium FROM bookmark")
def medium_names(spark: SparkSession, d: str) -> DataFrame:
    return _bookmarks(spark, d).select("id", texts.medium(F.expr(SPELLED)).alias("medium"))


@register("SELECT id, '{\"title\":\"' || medium || '\"}' AS reply, medium AS title FROM bookmark")
def unfenced_replies(spark: SparkSession, d: str) -> DataFrame:
    return _bookmarks(spark, d).select("id", texts.unfenced(F.expr(FENCED)).alias("reply"), replies.title_and_summary(F.expr(FENCED))["title"].alias("title"))


@register("SELECT DISTINCT bookmark, assigned_by AS choice, 0.25::DOUBLE AS p_a, 0.75::DOUBLE AS p_true, 0.25::DOUBLE AS p_false, category::DOUBLE AS score FROM bookmark_category")
def answer_values(spark: SparkSession, d: str) -> DataFrame:
    got = read_table(spark, d, "bookmark_category").select("bookmark", replies.answers(F.expr(REPLY)).alias("a"))
    return got.select("bookmark", F.col("a")["kind"]["choice"].alias("choice"), replies.probability_of(F.col("a")["kind"], "a").alias("p_a"), replies.probability_of(F.col("a")["ok"], "true").alias("p_true"), replies.probability_of(F.col("a")["ok"], "false").alias("p_false"), F.col("a")["rank"]["score"].alias("score")).distinct()


@register("SELECT user_id AS reply, arg_max(event_id, event_id)::VARCHAR AS text FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id")
def last_texts(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "events").select(F.col("user_id").alias("reply"), F.col("event_id").alias("line_no"), F.expr(EVENT).alias("line"))
    return replies.last_text(lines)


@register("SELECT id, try_cast(CASE WHEN id % 3 = 0 THEN external_id ELSE '0.0' || (id % 97) END AS DOUBLE) AS dollars FROM bookmark WHERE id % 3 > 0 OR regexp_matches(external_id, '^[0-9]+$')")
def dollar_amounts(spark: SparkSession, d: str) -> DataFrame:
    some = _bookmarks(spark, d).where("id % 3 > 0 or external_id rlike '^[0-9]+$'")
    return some.select("id", replies.dollars(F.expr("CASE WHEN id % 3 = 0 THEN external_id ELSE concat('0.0', id % 97) END")).alias("dollars"))


@register("SELECT strftime(make_timestamp(min((id >> 16) + 1577836800000) * 1000), '%Y-%m-%d') AS first_day, strftime(make_timestamp(max((id >> 16) + 1577836800000) * 1000), '%Y-%m-%d') AS last_day FROM bookmark")
def date_range(spark: SparkSession, d: str) -> DataFrame:
    return query.date_range(_bookmarks(spark, d).withColumn("created_ms", texts.id_to_millis(F.col("id"))))


_LINE = "list_filter(list_transform(string_split_regex(coalesce(body, ''), '\\r?\\n'), lambda x: trim(x)), lambda x: x <> '')[1]"
_LINKS = """l AS (SELECT bookmark, first(nullif(trim(title), '') ORDER BY ordinal, original, resolved, kind, title) FILTER (WHERE nullif(trim(title), '') IS NOT NULL) AS ltitle FROM (SELECT DISTINCT bookmark, ordinal, original, resolved, kind, title FROM link) GROUP BY bookmark)"""


@register(f"WITH {_LINKS}, b AS (SELECT *, {_LINE} AS line FROM bookmark) SELECT b.id, coalesce(nullif(trim(title), ''), ltitle, CASE WHEN length(line) > 90 THEN substr(line, 1, 89) || '…' ELSE line END, 'Untitled') AS title FROM b LEFT JOIN l ON l.bookmark = b.id")
def core_titles(spark: SparkSession, d: str) -> DataFrame:
    full = _hydrated(spark, d)
    return full.select("id", query.core_title(F.col("title"), F.col("links"), F.col("body")).alias("title"))


_SEEN_LINKS = "x AS (SELECT DISTINCT bookmark, ordinal, original, resolved, kind, title, body, summary, blocked FROM link)"
_TAGGED = "t AS (SELECT bookmark, string_agg(DISTINCT lower(trim(tag)), ' ' ORDER BY lower(trim(tag))) FILTER (WHERE trim(tag) <> '') AS tags FROM tag GROUP BY bookmark)"


def _words_sql(*parts: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(parts) + "], lambda v: v IS NOT NULL AND v <> ''), ' ')"


@register(
    f"""WITH {_SEEN_LINKS}, {_TAGGED}, y AS (SELECT bookmark, string_agg({_words_sql(host_sql('resolved'), "nullif(trim(title), '')", "replace(kind, '-', ' ')")}, ' ' ORDER BY ordinal, original, resolved, kind, title) AS long,
 string_agg(nullif({_words_sql(host_sql('resolved'), "nullif(trim(title), '')")}, ''), ' ' ORDER BY ordinal, original, resolved, kind, title) AS short FROM x GROUP BY bookmark)
SELECT id, {_words_sql('author_handle', 'tags', 'long')} AS at_insert, {_words_sql("'@' || author_handle", "nullif(trim(author_name), '')", 'short', 'tags')} AS enriched FROM bookmark b LEFT JOIN t ON t.bookmark = b.id LEFT JOIN y ON y.bookmark = b.id"""
)
def indexed_texts(spark: SparkSession, d: str) -> DataFrame:
    full = _hydrated(spark, d)
    handle, tags, links = F.col("author_handle"), F.col("tags"), F.col("links")
    return full.select("id", index_extra(handle, tags, links).alias("at_insert"), enriched_extra(handle, F.col("author_name"), links, tags).alias("enriched"))


@register("SELECT id, replace(medium, '-', '_') AS cash, CASE WHEN regexp_matches(coalesce(author_handle, 'one'), '^[A-Za-z0-9.-]+$') THEN lower(coalesce(author_handle, 'one')) || '.co.uk' ELSE '?' END AS first_domain, replace(medium, '-', '') || '.dev' AS second_domain FROM bookmark WHERE regexp_matches(coalesce(author_handle, 'one'), '^[A-Za-z0-9]+$')")
def marked_names(spark: SparkSession, d: str) -> DataFrame:
    """Cashtags and bare domains of a sentence put together from each bookmark; the linked domain is masked."""
    plain = _bookmarks(spark, d).where(F.coalesce("author_handle", F.lit("one")).rlike("^[A-Za-z0-9]+$")).select("id", F.expr(MARKED).alias("t"))
    found = plain.select("id", texts.cashtags(F.col("t")).alias("c"), texts.bare_domains(texts.masked_links(F.col("t"), urls.links_in(F.col("t")))).alias("n"))
    return found.where((F.size("c") == 1) & (F.size("n") == 2)).select("id", F.get("c", 0).alias("cash"), F.get("n", 0).alias("first_domain"), F.get("n", 1).alias("second_domain"))


@register("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id >= 400 DESC, event_id) AS r FROM (SELECT * FROM events WHERE value IS NOT NULL)) WHERE r = 1")
def upsert_by_value(spark: SparkSession, d: str) -> DataFrame:
    """Upsert whose keys stand on both sides: the row of highest value, a later event winning a tie."""
    e = read_table(spark, d, "events").select("user_id", "event_type", "event_id", "value").where("value is not null")
    best = lambda df: df.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("value", -F.col("event_id"))).alias("x")).select("user_id", "event_type", "x.*")
    return latest_wins(best(e.where("event_id < 400")), best(e.where("event_id >= 400")), ["user_id", "event_type"], "value")


@register("SELECT count(*) AS n FROM bookmark WHERE medium = 'rss' AND id IN (SELECT bookmark FROM tag WHERE tag = 'later') AND described_at IS NULL")
def filtered_count(spark: SparkSession, d: str) -> DataFrame:
    return query.Filter(tags=["later"], medium="rss", described=False).apply(_bookmarks(spark, d), read_table(spark, d, "tag")).agg(F.count("*").alias("n"))


@register("WITH top AS (SELECT tag FROM tag GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 2) SELECT id FROM bookmark WHERE (SELECT count(DISTINCT t.tag) FROM tag t WHERE t.bookmark = id AND t.tag IN (SELECT tag FROM top)) = 2")
def filter_two_tags(spark: SparkSession, d: str) -> DataFrame:
    tag = read_table(spark, d, "tag")
    top = [r["tag"] for r in query.counts(tag, "tag", top=2).collect()]
    return query.Filter(tags=top).apply(_bookmarks(spark, d), tag).select("id")


@register("SELECT id, 'T ' || medium AS title, 'S & ' || external_id AS summary, coalesce(author_handle, 'nobody') AS author, 'https://c.example/' || external_id AS canonical, '' AS body, CASE WHEN id % 4 = 0 THEN 'paywall' ELSE 'empty' END AS blocked FROM bookmark WHERE NOT regexp_matches(external_id || coalesce(author_handle, ''), '[<>\"&]')")
def page_articles(spark: SparkSession, d: str) -> DataFrame:
    some = _bookmarks(spark, d).where(~F.concat("external_id", F.coalesce("author_handle", F.lit(""))).rlike('[<>"&]'))
    return some.select("id", pages.article(F.expr(PAGE), F.lit(None)).alias("a")).select("id", "a.title", "a.summary", "a.author", "a.canonical", "a.body", "a.blocked")


@register(PREPARED + "SELECT id, coalesce(n_links, 0) AS n_links, coalesce(tags, '') AS tags FROM p WHERE tagged_at IS NULL ORDER BY id LIMIT 100")
def next_batch(spark: SparkSession, d: str) -> DataFrame:
    full = query.keyset_page(_hydrated(spark, d), F.col("tagged_at").isNull(), 0, 100)
    return full.select("id", F.size("links").cast("bigint").alias("n_links"), F.array_join("tags", " ").alias("tags"))


@register(
    """WITH ch AS (SELECT id AS bookmark, CASE WHEN id % 2 = 0 THEN 'tools' ELSE 'no-such' END AS slug FROM bookmark WHERE medium = 'rss')
SELECT bookmark, category, confidence::DOUBLE AS confidence FROM bookmark_category WHERE bookmark NOT IN (SELECT bookmark FROM ch) UNION ALL SELECT DISTINCT ch.bookmark, c.id, 1.0 FROM ch JOIN category c ON c.slug = ch.slug"""
)
def replaced_categories(spark: SparkSession, d: str) -> DataFrame:
    changes = _bookmarks(spark, d).where("medium = 'rss'").select(F.col("id").alias("bookmark"), F.when(F.col("id") % 2 == 0, "tools").otherwise("no-such").alias("slug"), F.lit(1.0).cast("float").alias("confidence"), F.lit("model").alias("assigned_by"))
    return assign_categories(read_table(spark, d, "bookmark_category"), changes, read_table(spark, d, "category")).select("bookmark", "category", F.col("confidence").cast("double").alias("confidence"))


@register(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t} WHERE {c} NOT IN (SELECT id FROM bookmark WHERE medium = 'rss')" for t, c in (("bookmark", "id"), ("link", "bookmark"), ("media", "bookmark"), ("tag", "bookmark"), ("bookmark_category", "bookmark"))))
def deleted_items(spark: SparkSession, d: str) -> DataFrame:
    """Rows left in each table after the items of one medium are deleted."""
    tables = {t: read_table(spark, d, t) for t in ("bookmark", "link", "media", "tag", "bookmark_category")}
    left = delete(tables, tables["bookmark"].where("medium = 'rss'").select("id"))
    out = None
    for name, df in left.items():
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("n")).select("name", "n")
        out = one if out is None else out.union(one)
    return out


_RULES = (rules.Rule("a", ["/science", "lab."]), rules.Rule("b", ["/food", "blog"]), rules.Rule("c", ["e"]))
_TEXT = "lower(trim(regexp_replace(regexp_replace(resolved, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')))"
_HIT = lambda r: "(" + " OR ".join(f"contains(x, '{n}')" for n in r.any) + ")"


@register("SELECT DISTINCT bookmark, ordinal, CASE " + " ".join(f"WHEN {_HIT(r)} THEN '{r.slug}'" for r in _RULES) + " ELSE 'general' END AS first, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_HIT(r)} THEN '{r.slug}' END" for r in _RULES) + f"], lambda v: v IS NOT NULL), ',') AS every FROM (SELECT *, {_TEXT} AS x FROM link)")
def rule_tables(spark: SparkSession, d: str) -> DataFrame:
    """The first matching rule by the table form, and all matching ones."""
    table = spark.createDataFrame([(i, r.slug, n) for i, r in enumerate(_RULES) for n in r.any], "order int, slug string, needle string")
    routed = rules.route_by_table(read_table(spark, d, "link").select("bookmark", "ordinal", "resolved"), "resolved", table, out="first")
    return routed.select("bookmark", "ordinal", "first", F.array_join(rules.all_matches(F.col("resolved"), _RULES), ",").alias("every")).distinct()


@register("SELECT string_agg('- ' || slug || ': ' || description, chr(10) ORDER BY '- ' || slug || ': ' || description) AS rubric FROM category")
def category_rubric(spark: SparkSession, d: str) -> DataFrame:
    return rules.rubric(read_table(spark, d, "category"))
