"""Queries that put every bookmark into the form of a source and read it back, beside the same items said in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsieve.operators.catalog import query as register
from keepsieve.plans.runtime import read_table
from keepsieve.sources.readers import of_medium, parse_texts

_KEY = "md5(external_id)"
_MS = "((id >> 16) + 1577836800000)"
_BODY = "concat('x', coalesce(body, ''), 'x')"
_ISO = "date_format(timestamp_millis(shiftright(id, 16) + 1577836800000), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
_SECONDS = "cast((shiftright(id, 16) + 1577836800000) div 1000 as string)"
_HANDLE = "concat('H', substr(md5(external_id), 1, 6))"


def _payloads(spark: SparkSession, d: str, text: str) -> DataFrame:
    return read_table(spark, d, "bookmark").select(F.col("id").cast("string").alias("path"), F.expr(text).alias("text"))


def _read(spark: SparkSession, d: str, kind: str, text: str, *columns: str, medium: str | None = None) -> DataFrame:
    items = parse_texts(_payloads(spark, d, text), kind, medium)[0]
    return items.select(F.col("path").cast("bigint").alias("id"), *[F.array_join("tags", ",").alias("tags") if c == "tags" else F.col(c) for c in columns])


_SHAPES = f"""concat('[', CASE id % 5
 WHEN 0 THEN to_json(named_struct('text', {_BODY}, 'timestamp', {_ISO}, 'tweetId', {_KEY}))
 WHEN 1 THEN to_json(named_struct('id_str', {_KEY}, 'full_text', {_BODY}, 'created_at', {_ISO}, 'user', named_struct('screen_name', {_HANDLE})))
 WHEN 2 THEN to_json(named_struct('tweetId', {_KEY}, 'authorHandle', {_HANDLE}, 'body', {_BODY}, 'createdAt', {_ISO}))
 WHEN 3 THEN to_json(named_struct('Tweet Id', {_KEY}, 'Full Text', {_BODY}, 'Created At', {_ISO}, 'User Screen Name', {_HANDLE}))
 ELSE to_json(named_struct('id', {_KEY}, 'text', {_BODY}, 'author', named_struct('username', {_HANDLE}), 'created_at', {_ISO})) END, ',{{"no":"id"}}]')"""


@register(f"SELECT id, {_KEY} AS external_id, {_BODY} AS body, CASE WHEN id % 5 > 0 THEN lower({_HANDLE}) END AS author_handle, {_MS} // 1000 * 1000 AS created_ms FROM bookmark")
def read_json_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Every bookmark as a JSON record of one of five shapes."""
    return _read(spark, d, "json", _SHAPES, "external_id", "body", "author_handle", "created_ms")


@register("SELECT id, 'record has no id' AS reason FROM bookmark")
def read_json_rejects(spark: SparkSession, d: str) -> DataFrame:
    return parse_texts(_payloads(spark, d, _SHAPES), "json")[1].select(F.col("path").cast("bigint").alias("id"), "reason")


@register(f"SELECT id, {_KEY} AS external_id, {_BODY} AS body FROM bookmark UNION ALL SELECT id, 'second', 'line' FROM bookmark")
def read_json_lines(spark: SparkSession, d: str) -> DataFrame:
    text = f"concat(to_json(named_struct('id', {_KEY}, 'text', {_BODY})), chr(10), chr(10), '{{\"id\":\"second\",\"text\":\"line\"}}')"
    return of_medium(_read(spark, d, "json", text, "external_id", "body", "medium", medium="json"), "json").drop("medium")


@register(f"SELECT id, 'https://' || {_KEY} || '.example/a?b=1&c=2' AS url, 'T & ' || {_KEY} AS title, {_MS} // 1000 * 1000 AS created_ms, medium AS tags, substr(sha256('https://' || {_KEY} || '.example/a?b=1&c=2'), 1, 16) AS external_id FROM bookmark")
def read_bookmark_file(spark: SparkSession, d: str) -> DataFrame:
    text = f"concat('<DL><DT><H3>', medium, '</H3><DL><DT><A HREF=\"https://', {_KEY}, '.example/a?b=1&amp;c=2\" ADD_DATE=\"', {_SECONDS}, '\">T &amp; ', {_KEY}, '</A></DL></DL>')"
    return _read(spark, d, "bookmark-file", text, "url", "title", "created_ms", "tags", "external_id")


@register(
    f"""SELECT id, CASE WHEN id % 2 = 0 THEN 'browser-bookmarks' ELSE 'rss' END AS medium, 'https://' || {_KEY} || '.example/x' AS url, 'N ' || {_KEY} AS title, CASE WHEN id % 2 = 0 THEN {_MS} // 1000 * 1000 END AS created_ms,
 CASE WHEN id % 2 = 0 THEN medium WHEN medium < 'feed' THEN medium || ',feed' ELSE 'feed,' || medium END AS tags FROM bookmark"""
)
def read_opml(spark: SparkSession, d: str) -> DataFrame:
    inner = f"CASE WHEN id % 2 = 0 THEN concat('url=\"https://', {_KEY}, '.example/x\" addDate=\"', {_SECONDS}, '\"') ELSE concat('xmlUrl=\"https://', {_KEY}, '.example/x\"') END"
    text = f"concat('<opml><body><outline text=\"', medium, '\"><outline text=\"N ', {_KEY}, '\" ', {inner}, '/></outline></body></opml>')"
    return _read(spark, d, "opml", text, "medium", "url", "title", "created_ms", "tags")


_LINES = f"concat('# c', chr(10), chr(10), 'https://', {_KEY}, '.example', chr(10), '[T](https://b.example/', {_KEY}, ')', chr(10), {_KEY}, '.example/y', chr(10), 'https://', {_KEY}, '.example', chr(10), 'not one')"


@register(f"SELECT id, 'https://' || {_KEY} || '.example' AS url, NULL::VARCHAR AS title FROM bookmark UNION ALL SELECT id, 'https://b.example/' || {_KEY}, 'T' FROM bookmark UNION ALL SELECT id, 'https://' || {_KEY} || '.example/y', NULL FROM bookmark")
def read_url_list(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "urls", _LINES, "url", "title")


@register("SELECT id, 'no address: not one' AS reason FROM bookmark")
def read_url_rejects(spark: SparkSession, d: str) -> DataFrame:
    return parse_texts(_payloads(spark, d, _LINES), "urls")[1].select(F.col("path").cast("bigint").alias("id"), "reason")


_RFC = "date_format(timestamp_millis(shiftright(id, 16) + 1577836800000), \"EEE, dd MMM yyyy HH:mm:ss 'GMT'\")"
_FEEDS = f"""CASE WHEN id % 2 = 0 THEN concat('<rss><channel><item><title>T ', {_KEY}, '</title><link>https://a.example/', {_KEY}, '</link><pubDate>', {_RFC}, '</pubDate><author>w@x.example (A W)</author><description>&lt;b&gt;D&lt;/b&gt; ', medium, '</description></item></channel></rss>')
 ELSE concat('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T ', {_KEY}, '</title><link href="https://a.example/', {_KEY}, '"/><id>', {_KEY}, '</id><updated>', {_ISO}, '</updated><summary>D ', medium, '</summary><author><name>Ann</name></author></entry></feed>') END"""


@register(
    f"""SELECT id, CASE WHEN id % 2 = 0 THEN 'https://a.example/' ELSE '' END || {_KEY} AS external_id, 'https://a.example/' || {_KEY} AS url, 'T ' || {_KEY} AS title, 'T ' || {_KEY} || chr(10) || chr(10) || 'D ' || medium AS body,
 CASE WHEN id % 2 = 0 THEN 'w@x.example' ELSE 'ann' END AS author_handle, CASE WHEN id % 2 = 0 THEN 'A W' END AS author_name, {_MS} // 1000 * 1000 AS created_ms FROM bookmark"""
)
def read_feed(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "feed", _FEEDS, "external_id", "url", "title", "body", "author_handle", "author_name", "created_ms")


@register(f"SELECT id, {_KEY} AS external_id, 'https://news.ycombinator.com/item?id=' || {_KEY} AS url, 'T' || chr(10) || chr(10) || medium AS body, CASE WHEN id % 2 = 0 THEN 'reply' END AS role, {_MS} // 1000 * 1000 AS created_ms FROM bookmark")
def read_hackernews(spark: SparkSession, d: str) -> DataFrame:
    text = f"concat('{{\"hits\":[{{\"objectID\":\"', {_KEY}, '\",\"title\":\"T\",\"comment_text\":\"<p>', medium, '</p>\",', CASE WHEN id % 2 = 0 THEN '\"parent_id\":3,' ELSE '' END, '\"created_at\":\"', {_ISO}, '\"}},{{\"objectID\":\"2\"}}]}}')"
    return _read(spark, d, "hackernews", text, "external_id", "url", "body", "role", "created_ms")


@register(f"SELECT id, {_KEY} AS external_id, CASE WHEN id % 2 = 0 THEN 'https://www.reddit.com/r/' || medium ELSE 'https://o.example/' || {_KEY} END AS url, 'T' || chr(10) || chr(10) || {_BODY} AS body, {_MS} // 1000 * 1000 AS created_ms FROM bookmark")
def read_reddit(spark: SparkSession, d: str) -> DataFrame:
    child = f"to_json(named_struct('id', {_KEY}, 'title', 'T', 'selftext', {_BODY}, 'permalink', concat('/r/', medium), 'url', concat(CASE WHEN id % 2 = 0 THEN 'https://www.reddit.com/' ELSE 'https://o.example/' END, {_KEY}), 'created_utc', (shiftright(id, 16) + 1577836800000) div 1000))"
    text = f"concat('{{\"data\":{{\"children\":[{{\"data\":', {child}, '}},{{\"data\":{{\"id\":\"b\",\"title\":\"S\",\"stickied\":true}}}}]}}}}')"
    return _read(spark, d, "reddit", text, "external_id", "url", "body", "created_ms")


@register(f"SELECT id, id::VARCHAR AS external_id, 'a/' || {_KEY} AS title, 'a/' || {_KEY} || chr(10) || chr(10) || {_BODY} || chr(10) || chr(10) || 'Language: Go' AS body, 'a' AS author_handle, array_to_string(list_sort(list_distinct([medium, 'github', 'starred'])), ',') AS tags FROM bookmark")
def read_github_stars(spark: SparkSession, d: str) -> DataFrame:
    text = f"concat('[', to_json(named_struct('id', id, 'full_name', concat('a/', {_KEY}), 'html_url', concat('https://github.com/a/', {_KEY}), 'description', {_BODY}, 'language', 'Go', 'topics', array(medium), 'owner', named_struct('login', 'a'))), ']')"
    return _read(spark, d, "github", text, "external_id", "title", "body", "author_handle", "tags")


@register(f"SELECT id, {_KEY} AS external_id, 'https://www.youtube.com/watch?v=' || {_KEY} AS url, 'One ' || medium AS title, 'chan' AS author_handle FROM bookmark")
def read_youtube(spark: SparkSession, d: str) -> DataFrame:
    video = f"concat('{{\"playlistVideoRenderer\":{{\"videoId\":\"', {_KEY}, '\",\"title\":{{\"runs\":[{{\"text\":\"One \"}},{{\"text\":\"', medium, '\"}}]}},\"shortBylineText\":{{\"runs\":[{{\"text\":\"Chan\"}}]}}}}}}')"
    text = f"concat('<script>var ytInitialData = {{\"a\":[', {video}, ',', {video}, ']}};</script>')"
    return _read(spark, d, "youtube", text, "external_id", "url", "title", "author_handle")


@register(f"SELECT id, {_KEY} AS external_id, 'https://x.com/Ann/status/' || {_KEY} AS url, {_BODY} AS body, '@ann' AS author_handle, {_MS} // 1000 * 1000 AS created_ms FROM bookmark")
def read_x_timeline(spark: SparkSession, d: str) -> DataFrame:
    when = "date_format(timestamp_millis(shiftright(id, 16) + 1577836800000), 'EEE MMM dd HH:mm:ss +0000 yyyy')"
    legacy = f"to_json(named_struct('rest_id', {_KEY}, 'full_text', {_BODY}, 'created_at', {when}))"
    entry = f"concat('{{\"content\":{{\"itemContent\":{{\"tweet_results\":{{\"result\":{{\"core\":{{\"user_results\":{{\"result\":{{\"screen_name\":\"Ann\",\"name\":\"A\"}}}}}},\"legacy\":', {legacy}, '}}}}}}}}}}')"
    text = f"concat('{{\"data\":{{\"bookmark_timeline_v2\":{{\"timeline\":{{\"instructions\":[{{\"entries\":[', {entry}, ']}}]}}}}}}}}')"
    return _read(spark, d, "x", text, "external_id", "url", "body", "author_handle", "created_ms")


@register(f"SELECT id, 'note ' || {_KEY} || chr(10) || chr(10) || 'quoted ' || medium AS body, '@ann' AS author_handle, epoch_ms(date_trunc('day', make_timestamp({_MS} * 1000))) AS created_ms FROM bookmark")
def read_journal(spark: SparkSession, d: str) -> DataFrame:
    day = "date_format(timestamp_millis(shiftright(id, 16) + 1577836800000), 'EEEE, MMMM d, yyyy')"
    text = f"concat('# ', {day}, chr(10), '## @Ann - First', chr(10), '> quoted ', medium, chr(10), '- **What:** note ', {_KEY}, chr(10), '- **Tweet:** https://x.com/ann/status/', id, chr(10), '---', chr(10))"
    return _read(spark, d, "archive", text, "body", "author_handle", "created_ms")


@register("SELECT doc_id AS id, 'notes/' || doc_id || '.md' AS external_id, doc_id::VARCHAR AS title, md5(text) AS body_md5, 'local,md,notes' AS tags FROM documents WHERE text IS NOT NULL")
def read_documents(spark: SparkSession, d: str) -> DataFrame:
    given = read_table(spark, d, "documents").select(F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    items = parse_texts(given, "document")[0]
    return items.select(F.col("title").cast("bigint").alias("id"), "external_id", "title", F.md5("body").alias("body_md5"), F.array_join("tags", ",").alias("tags"))
