"""URL functions as built-in column expressions.

Null in, null out everywhere; a text that isn't an absolute URL has an empty
host and path. Expressions that both SQL dialects read the same are kept as
text, so the oracle states them once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts and extensions by kind of page.
PAPER_HOSTS = ("arxiv.org", "export.arxiv.org", "biorxiv.org", "openreview.net")
REPOSITORY_HOSTS = ("github.com", "gitlab.com", "codeberg.org", "bitbucket.org", "gitea.com", "sr.ht", "sourcehut.org")
VIDEO_HOSTS = ("youtube.com", "youtu.be", "vimeo.com", "dailymotion.com", "twitch.tv", "odysee.com", "rumble.com")
PODCAST_HOSTS = ("spotify.com", "overcast.fm", "castro.fm", "podcastaddict.com", "player.fm", "snipd.fm")
DOCS_HOSTS = ("docs.rs", "doc.rust-lang.org", "docs.python.org", "developer.mozilla.org", "readthedocs.io", "kubernetes.io", "man7.org", "sqlite.org", "postgresql.org")
THREAD_HOSTS = ("news.ycombinator.com", "lobste.rs", "reddit.com", "old.reddit.com", "tildes.net")
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".avif", ".svg", ".bmp")
# Query parameters that only attribute a visit, and their prefixes.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "utm_reader", "utm_brand", "utm_social",
    "utm_social-type", "gclid", "dclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "igshid", "ref_src", "ref_url", "ref", "referrer", "referer",
    "source", "spm", "yclid", "_ga", "_gl",
)
TRACKING_PREFIXES = ("utm_", "pk_", "piwik_", "mtm_", "_hs")
# Domains behind a subscription.
PAYWALLED = (
    "nytimes.com", "wsj.com", "washingtonpost.com", "theatlantic.com", "newyorker.com", "bloomberg.com", "ft.com", "economist.com", "bostonglobe.com",
    "latimes.com", "wired.com", "lemonde.fr", "zeit.de", "faz.net", "handelsblatt.com", "businessinsider.com", "techcrunch.com", "medium.com",
    "substack.com", "patreon.com", "tribune.com", "semafor.com", "axios.com", "cnn.com", "bbc.com", "guardian.com",
)
# Embedding endpoints by host.
EMBED_ENDPOINTS = {
    "youtube.com": "https://www.youtube.com/oembed", "youtu.be": "https://www.youtube.com/oembed", "vimeo.com": "https://vimeo.com/api/oembed.json",
    "twitter.com": "https://publish.twitter.com/oembed", "x.com": "https://publish.twitter.com/oembed", "soundcloud.com": "https://soundcloud.com/oembed",
    "spotify.com": "https://open.spotify.com/oembed", "flickr.com": "https://www.flickr.com/services/oembed/", "tiktok.com": "https://www.tiktok.com/oembed",
    "reddit.com": "https://www.reddit.com/oembed",
}

HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
QUERY_PATTERN = r"^[^?#]*\?([^#]*)"


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def host(url: Column) -> Column:
    """Lower-cased host without leading ``www.`` labels."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST_PATTERN, 1)), r"^(www\.)+", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH_PATTERN, 1)


def query_part(url: Column) -> Column:
    return F.regexp_extract(url, QUERY_PATTERN, 1)


def kind_sql(host: str, path: str) -> str:
    """CASE text giving the kind of a page from its host and lower-cased path; first match wins."""
    ends = " OR ".join(f"{path} LIKE '%{e}'" for e in IMAGE_ENDINGS)
    return f"""CASE
 WHEN {host} IN ('x.com', 'twitter.com') AND contains({path}, '/i/article/') THEN 'long-form'
 WHEN {host} IN ('x.com', 'twitter.com') AND contains({path}, '/status/') THEN 'post'
 WHEN {host} IN ({quoted(PAPER_HOSTS)}) THEN 'paper'
 WHEN {host} IN ({quoted(REPOSITORY_HOSTS)}) THEN 'repository'
 WHEN {host} IN ({quoted(VIDEO_HOSTS)}) THEN 'video'
 WHEN {host} IN ({quoted(PODCAST_HOSTS)}) OR contains({host}, 'podcast') THEN 'podcast'
 WHEN {ends} THEN 'image'
 WHEN contains({path}, '/releases') OR contains({path}, '/changelog') OR contains({path}, '/tag/') THEN 'release'
 WHEN {path} LIKE '/docs%' OR contains({path}, '/documentation') OR contains({path}, '/reference') OR {host} IN ({quoted(DOCS_HOSTS)}) THEN 'release'
 WHEN {host} IN ({quoted(THREAD_HOSTS)}) THEN 'thread'
 ELSE 'article' END"""


def with_kind(df, url: str, out: str = "url_kind"):
    """Adds the kind of each page; null for a null URL."""
    prepared = df.withColumn("__h", host(F.col(url))).withColumn("__p", F.lower(path(F.col(url))))
    return prepared.withColumn(out, F.when(F.col(url).isNotNull(), F.expr(kind_sql("__h", "__p")))).drop("__h", "__p")


def is_tracking(key: Column) -> Column:
    low = F.lower(key)
    test = low.isin(*TRACKING)
    for p in TRACKING_PREFIXES:
        test = test | low.startswith(p)
    return test


def tracking_parameters(url: Column) -> Column:
    """Names of the attributing parameters of a URL, in order."""
    return F.filter(F.transform(F.split(query_part(url), "&"), lambda p: F.split(p, "=")[0]), lambda k: is_tracking(k))


def canonical(url: Column) -> Column:
    """One spelling per page: https, host without www, no fragment, own parameters sorted, no slash on a bare host."""
    kept = F.array_join(F.array_sort(F.filter(F.split(query_part(url), "&"), lambda p: (p != "") & ~is_tracking(F.split(p, "=")[0]))), "&")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    scheme = F.when(scheme == "http", "https").otherwise(scheme)
    place = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]*(:\d+)?", 1)
    where = path(url)
    bare = F.when(where.isin("", "/") & (kept == ""), F.lit("")).when(where == "", F.lit("/")).otherwise(where)
    return F.concat(scheme, F.lit("://"), host(url), place, bare, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def is_paywalled(url: Column) -> Column:
    """Whether the host is one of the subscription domains or below one."""
    return F.concat(F.lit("."), host(url)).rlike(r"\.(" + "|".join(d.replace(".", r"\.") for d in PAYWALLED) + r")$")


def stable_key(url: Column) -> Column:
    """First 16 hex digits of a digest of the canonical form."""
    return F.substring(F.sha2(canonical(url), 256), 1, 16)


def repository(url: Column) -> Column:
    """owner/name where the path has exactly these two parts."""
    got = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+/([^/?#]+/[^/?#]+?)(?:\.git)?/?(?:[?#].*)?$", 1)
    return F.when(got != "", got)


def video_id(url: Column) -> Column:
    """Identifier of a video of the usual watch, short, embed and shorts addresses."""
    got = F.coalesce(
        *[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in (r"youtu\.be/([\w-]+)", r"[?&]v=([\w-]+)", r"/(?:embed|shorts)/([\w-]+)")]
    )
    return F.when(host(url).isin("youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be"), got)


def embed_endpoint(url: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, endpoint in EMBED_ENDPOINTS.items():
        out = F.when(host(url) == name, F.lit(endpoint)).otherwise(out)
    return out


def percent_encode(text: Column) -> Column:
    """Everything but ASCII letters and digits percent-encoded."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for c, code in (("-", "%2D"), (".", "%2E"), ("_", "%5F"), ("*", "%2A")):
        out = F.replace(out, F.lit(c), F.lit(code))
    return out


def routing_text(url: Column) -> Column:
    """Host and path as rules see them: lower-cased, no scheme, query, fragment or outer blanks."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")))


def blocked_from_status(status: Column) -> Column:
    return F.when(status.between(401, 403), "paywall").when(status.isin(404, 410), "gone").otherwise("refused")


def media_kind(url: Column) -> Column:
    """Kind of a media file by its extension; photo where it says nothing."""
    low = F.lower(path(url))
    return F.when(low.rlike(r"\.(mp4|webm|mov|m3u8|mkv|m4v)$"), "video").when(low.endswith(".gif"), "gif").when(low.rlike(r"\.(mp3|m4a|ogg|wav|flac|aac)$"), "audio").otherwise("photo")


def links_in(text: Column) -> Column:
    """Distinct http(s) URLs of a text in order, trailing punctuation removed.

    The first ``h`` of a token begins the candidate, so a URL glued to text with an earlier h is not seen.
    """
    tokens = F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: F.regexp_replace(F.regexp_extract(t, r"h.*", 0), r"""[.,;:!?'")\]}>]+$""", ""))
    return F.array_distinct(F.filter(tokens, lambda t: t.rlike(r"^https?://[^/?#\s]+")))


def feed_host(url: Column) -> Column:
    got = F.regexp_extract(url, r"//([^/]*)", 1)
    return F.when(F.coalesce(got, F.lit("")) == "", "feed").otherwise(got)


def filed_target(value: Column, directory: str) -> Column:
    """file: address of the target of a markdown link or a plain path, below ``directory``."""
    target = F.coalesce(F.nullif(F.regexp_extract(value, r"\[[^\]]*\]\(([^)]+)\)", 1), F.lit("")), F.trim(value))
    absolute = F.when(target.startswith("/"), target).otherwise(F.concat(F.lit(directory.rstrip("/") + "/"), target))
    return F.when(F.coalesce(target, F.lit("")) != "", F.concat(F.lit("file://"), absolute))
