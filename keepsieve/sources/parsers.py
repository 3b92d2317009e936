"""Pure parsers: the content of one file to item records (dicts); a record that can't be read becomes a reject.

Every parser returns (items, rejects) and never raises for bad content.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import xml.etree.ElementTree as ET
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd

from keepsieve.functions.timestamps import MONTH_OF, instants
from keepsieve.functions.urls import HOST_PATTERN, PATH_PATTERN, QUERY_PATTERN, TRACKING, TRACKING_PREFIXES

Record = dict
FIELDS = ("medium", "external_id", "collection", "url", "author_handle", "author_name", "title", "summary", "body", "role", "created_ms", "tags", "links", "media", "raw")
# Keys tried in order for each field, by shape of a JSON record.
ROOT_KEYS = ("bookmarks", "items", "data", "results", "tweets", "entries")
ID_KEYS = {"flat": ("Tweet Id", "Tweet ID", "tweet_id"), "api": ("id_str", "id"), "roundtrip": ("tweetId", "id"), "console": ("id", "tweetId"), "post": ("id", "id_str", "tweetId", "externalId")}
TEXT_KEYS = {"flat": ("Full Text", "full_text"), "roundtrip": ("text", "body"), "": ("full_text", "text", "Full Text")}
DATE_KEYS = {"flat": ("Created At", "created_at"), "roundtrip": ("tweetCreatedAt", "createdAt", "created_at"), "api": ("created_at",), "console": ("timestamp", "createdAt"), "post": ("created_at", "createdAt", "timestamp", "date")}
TAG_KEYS = ("tags", "hashtags", "labels", "categories")
COLLECTION_KEYS = ("collection", "folder", "list", "feed")


def record(**known) -> Record:
    out = dict.fromkeys(FIELDS)
    out |= {"body": "", "tags": [], "links": [], "media": []} | known
    out["tags"] = sorted({t.strip().lower() for t in out["tags"] if t and t.strip()})
    return out


def when_ms(value) -> int | None:
    """A date in any spelling as unix ms; clock times without zone are UTC here, numbers go by size."""
    if value is None or isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        size = abs(value)
        return int(value // 10**6 if size >= 10**17 else value // 1000 if size >= 10**14 else value if size >= 10**11 else value * 1000)
    text = str(value).strip()
    if m := re.fullmatch(r"\d{4}-\d\d-\d\d", text):
        text += " 00:00"
    got = instants(pd.Series([text], dtype=object), pd.Series(["UTC"], dtype=object), pd.Series(["ymd"], dtype=object))[0]
    return None if pd.isna(got) else int(got)


def clean_html(text: str | None) -> str:
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", text or "")).split())


def canonical(url: str) -> str:
    """The spelling that ``urls.canonical`` gives as a column, from the same patterns."""
    part = lambda pattern, n=1: (m[n] or "") if (m := re.search(pattern, url, re.S)) else ""
    attributes = lambda p: (k := p.split("=")[0].lower()) in TRACKING or k.startswith(TRACKING_PREFIXES)
    query = "&".join(sorted(p for p in part(QUERY_PATTERN).split("&") if p and not attributes(p)))
    scheme = part(r"^([A-Za-z][A-Za-z0-9+.-]*):").lower()
    host = re.sub(r"^(www\.)+", "", part(HOST_PATTERN).lower()) + part(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]*(:\d+)?")
    path = part(PATH_PATTERN)
    path = "" if path in ("", "/") and not query else path or "/"
    return f"{'https' if scheme == 'http' else scheme}://{host}{path}" + (f"?{query}" if query else "")


def key_of(url: str) -> str:
    return hashlib.sha256(canonical(url).encode()).hexdigest()[:16]


def valid_url(url) -> bool:
    try:
        p = urlsplit(url)
    except (ValueError, TypeError, AttributeError):
        return False
    return p.scheme in ("http", "https") and bool(p.hostname)


def link_of(url: str, kind: str | None = None, title: str | None = None) -> dict:
    return {"original": url, "resolved": url, "kind": kind or "article", "title": title}


def _first(obj: dict, keys) -> str | None:
    for k in keys:
        v = obj.get(k)
        if isinstance(v, str) and v.strip():
            return v
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return str(v)
    return None


def shape_of(obj: dict) -> str:
    """Shape of an exported record by the keys it has."""
    if "text" in obj and "id" not in obj and "id_str" not in obj:
        return "console"
    if "id_str" in obj or "full_text" in obj:
        return "api"
    if "tweetId" in obj and "authorHandle" in obj:
        return "roundtrip"
    if "author" not in obj and ("Tweet Id" in obj or "Full Text" in obj):
        return "flat"
    return "post"


def _people(obj: dict, shape: str) -> tuple[str | None, str | None]:
    inner = next((obj[k] for k in (("user",) if shape == "api" else ("author", "user")) if isinstance(obj.get(k), dict)), {})
    if shape == "flat":
        return _first(obj, ("User Screen Name", "user_screen_name")), _first(obj, ("User Name", "user_name"))
    if shape == "roundtrip":
        return _first(obj, ("authorHandle", "author")), _first(obj, ("authorName",))
    if shape == "api":
        return _first(inner, ("screen_name", "username")), _first(inner, ("name",))
    name = _first(inner, ("name", "displayName")) or _first(obj, ("authorName", "name", "User Name"))
    if isinstance(obj.get("author"), str):
        return obj["author"], name
    return _first(inner, ("username", "handle", "screen_name")) or _first(obj, ("handle", "screen_name", "username", "authorHandle")), name


def _media(obj: dict) -> list[dict]:
    out: dict[str, dict] = {}

    def add(url, kind, preview=None):
        if valid_url(url) and url not in out:
            out[url] = {"kind": kind or _media_kind(url), "url": url, "preview_url": preview}

    for m in obj.get("media") if isinstance(obj.get("media"), list) else ():
        if isinstance(m, str):
            add(m, None)
        elif isinstance(m, dict) and (url := _first(m, ("url", "media_url_https", "src", "mediaUrl", "media_url", "previewUrl"))):
            add(url, _spelled_kind(m.get("type")), _first(m, ("previewUrl",)))
    if out:
        return list(out.values())
    held = next((obj[k] for k in ("extended_entities", "entities") if isinstance(obj.get(k), dict)), {})
    for m in held.get("media") or ():
        if isinstance(m, dict):
            films = [v for v in (m.get("video_info") or {}).get("variants") or () if isinstance(v, dict) and v.get("content_type") == "video/mp4" and _first(v, ("url",))]
            best = max(films, key=lambda v: v.get("bitrate") or 0, default=None)  # max keeps the first of equals
            add(best["url"] if best else _first(m, ("media_url_https", "url")), _spelled_kind(m.get("type")) or "photo", _first(m, ("preview_url",)))
    return list(out.values())


def _spelled_kind(text) -> str | None:
    return {"photo": "photo", "image": "photo", "picture": "photo", "video": "video", "animated_gif": "gif", "gif": "gif", "audio": "audio"}.get(str(text or "").lower())


def _media_kind(url: str) -> str:
    path = urlsplit(url).path.lower()
    return "video" if re.search(r"\.(mp4|webm|mov|m3u8|mkv|m4v)$", path) else "gif" if path.endswith(".gif") else "audio" if re.search(r"\.(mp3|m4a|ogg|wav|flac|aac)$", path) else "photo"


def parse_json(text: str, medium: str = "json") -> tuple[list[Record], list[str]]:
    """Records of an exporter's JSON: a root array, a known key's array, or the first array there is; JSON Lines too."""
    try:
        root = json.loads(text)
    except ValueError:
        root = []
        for line in text.splitlines():
            if line.strip():
                try:
                    root.append(json.loads(line))
                except ValueError:
                    return [], ["not JSON"]
    if isinstance(root, dict):
        root = next((root[k] for k in ROOT_KEYS if isinstance(root.get(k), list)), next((v for v in root.values() if isinstance(v, list)), [root]))
    items, rejects = [], []
    for obj in root:
        if not isinstance(obj, dict):
            rejects.append("no object")
            continue
        shape = shape_of(obj)
        id = _first(obj, ID_KEYS[shape])
        if id is None:
            rejects.append("record has no id")
            continue
        handle, name = _people(obj, shape)
        url = _first(obj, ("url", "permalink", "tweetUrl", "link", "Tweet URL"))
        if url is None and medium in ("x", "x-bird"):
            url = f"https://x.com/{(handle or 'i').lstrip('@')}/status/{id}"
        role = "reply" if {"in_reply_to_status_id_str", "inReplyTo"} & obj.keys() else "quote" if {"quoted_status_id_str", "quotedTweet"} & obj.keys() else "thread" if {"self_thread", "thread_id"} & obj.keys() else None
        tags = []
        for k in TAG_KEYS:
            v = obj.get(k)
            tags += [str(t).strip().lstrip("#") for t in v if isinstance(t, str)] if isinstance(v, list) else v.split(",") if isinstance(v, str) else []
        created = next((ms for k in DATE_KEYS[shape] if (ms := when_ms(obj.get(k))) is not None), None)
        items.append(
            record(
                medium=medium, external_id=id, collection=_first(obj, COLLECTION_KEYS), url=url if valid_url(url) else None, author_handle=handle.strip().lower() if handle else None, author_name=name,
                title=_first(obj, ("title",)), summary=_first(obj, ("summary",)), body=_first(obj, TEXT_KEYS.get(shape, TEXT_KEYS[""])) or "", role=role, created_ms=created,
                tags=[*tags, *([handle.strip().lower()] if handle else [])], media=_media(obj), raw=json.dumps(obj, ensure_ascii=False),
            )
        )
    return items, rejects


class _BookmarkFile(HTMLParser):
    """Event-driven reading of a browser's bookmark file: a stack of folders, an entry per anchor."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.folders, self.pending, self.text, self.anchor, self.items = [], "", None, None, []

    def handle_starttag(self, tag, attrs):
        if tag == "dl":
            self.folders.append(self.pending)
            self.pending = ""
        elif tag == "h3":
            self.text = ""
        elif tag == "a":
            self.anchor, self.text = dict(attrs), ""

    def handle_data(self, data):
        if self.text is not None:
            self.text += data

    def handle_endtag(self, tag):
        if tag == "dl" and self.folders:
            self.folders.pop()
        elif tag == "h3":
            self.pending, self.text = " ".join((self.text or "").split()), None
        elif tag == "a" and self.anchor is not None:
            url = self.anchor.get("href") or ""
            if valid_url(url):
                date = self.anchor.get("add_date") or ""
                seconds = int(date) if date.isdigit() else None
                ms = None if seconds is None else seconds // 10**6 if seconds > 10**12 else seconds * 1000
                name = " ".join((self.text or "").split()) or url
                self.items.append(record(medium="browser-bookmarks", external_id=key_of(url), url=url, title=name, body=name, created_ms=ms, tags=[f for f in self.folders if f], links=[link_of(url)]))
            self.anchor, self.text = None, None


def parse_bookmark_file(text: str) -> tuple[list[Record], list[str]]:
    p = _BookmarkFile()
    p.feed(text)
    p.close()
    return p.items, []


def parse_opml(text: str) -> tuple[list[Record], list[str]]:
    """Every outline with a url or feed address; the enclosing outlines without one are its tags."""
    try:
        root = ET.fromstring(text.encode())
    except ET.ParseError as e:
        return [], [f"not OPML: {e}"]
    items = []

    def walk(node, folders):
        for o in node:
            if o.tag.lower().rpartition("}")[2] != "outline":
                walk(o, folders)
                continue
            low = {k.lower(): v for k, v in o.attrib.items()}
            url, feed = low.get("url"), low.get("xmlurl")
            name = low.get("title") or low.get("text") or ""
            target = url or feed
            if target and valid_url(target):
                date = low.get("adddate", "")
                ms = int(date) * 1000 if date.isdigit() else None
                items.append(record(medium="rss" if feed and not url else "browser-bookmarks", external_id=key_of(target), url=target, title=name or target, body=name or target, created_ms=ms, tags=[*folders[-1:], *(["feed"] if feed else [])], links=[link_of(target)]))
                walk(o, folders)
            else:
                walk(o, [*folders, name])

    walk(root, [])
    return items, []


def parse_url_list(text: str) -> tuple[list[Record], list[str]]:
    """One address or markdown link a line; comments and blanks are skipped, a bare host gets https."""
    seen, items, rejects = set(), [], []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        m = re.fullmatch(r"[-*]?\s*\[([^\]]*)\]\(([^)\s]+)\)", line)
        title, url = (m[1], m[2]) if m else (None, line.split()[0])
        if "://" not in url and re.match(r"^[\w-]+(\.[\w-]+)+(/|$)", url):
            url = "https://" + url
        if not valid_url(url):
            rejects.append(f"no address: {line[:80]}")
        elif url not in seen:
            seen.add(url)
            items.append(record(medium="manual", external_id=key_of(url), url=url, title=title, body=title or url, links=[link_of(url)]))
    return items, rejects


def parse_document(text: str, path: str, modified_ms: int | None) -> tuple[list[Record], list[str]]:
    parts = path.rstrip("/").split("/")
    stem, _, ending = parts[-1].rpartition(".")
    return [record(medium="local-file", external_id=path, title=stem or parts[-1], body=text, created_ms=modified_ms, tags=["local", parts[-2] if len(parts) > 1 else "", ending])], []


_DAY = re.compile(r"\d+")


def day_ms(heading: str) -> int | None:
    """Midnight UTC of a heading that holds a month's name, a day and a year."""
    month = next((MONTH_OF[w] for w in re.findall(r"[^\W\d_]+", heading.lower()) if w in MONTH_OF and len(w) > 2), None)
    numbers = [int(n) for n in _DAY.findall(heading)]
    return when_ms(f"{numbers[1]:04d}-{month:02d}-{numbers[0]:02d}") if month and len(numbers) >= 2 and numbers[0] <= 31 else None


def parse_markdown_archive(text: str, directory: str = "") -> tuple[list[Record], list[str]]:
    """A journal of days (``#``), entries (``## @handle - title``), labelled lines and quoted text; first wins by post or author and title."""
    items, seen = [], set()
    day, entry = None, None

    def close():
        if entry is None:
            return
        labels = entry["labels"]
        post = labels.get("tweet") or labels.get("post") or labels.get("quoted")
        identity = post or f"{entry['author'] or 'entry'}:{entry['title']}"
        if identity in seen:
            return
        seen.add(identity)
        quoted = "\n".join(entry["text"]).strip()
        body = "\n\n".join(x for x in (labels.get("what"), quoted) if x) or entry["title"]
        tags, links = [], {}

        def push(url, kind, title=None):
            if url and (valid_url(url) or url.startswith("file://")) and url not in links:
                links[url] = link_of(url, kind, title)
                tags.append(urlsplit(url).hostname or "")

        if entry["author"]:
            tags.append("@" + entry["author"])
        if labels.get("parent"):
            tags.append("reply")
            push(labels["parent"], "post")
        if labels.get("quoted"):
            tags.append("quote")
            push(labels["quoted"], "thread")
        for url, name in entry["links"]:
            push(url, "article", name)
        if filed := labels.get("filed"):
            m = re.search(r"\[[^\]]*\]\(([^)]+)\)", filed)
            target = m[1] if m else filed
            push(f"file://{target if target.startswith('/') else directory.rstrip('/') + '/' + target}", "article", filed)
            tags.append("filed")
        if labels.get("media"):
            tags += ["has-media", *(w.lower() for w in labels["media"].split() if len(w.encode()) > 3)]
        items.append(
            record(medium="markdown-file", external_id=identity, url=post if valid_url(post) else None, author_handle="@" + entry["author"].lower() if entry["author"] else None, title=entry["title"], body=body, role="reply" if labels.get("parent") else None, created_ms=entry["day"], tags=tags, links=list(links.values()))
        )

    for line in text.splitlines():
        bare = line.strip()
        if line.startswith("# "):
            close()
            day, entry = day_ms(line[2:]), None
        elif line.startswith("## "):
            close()
            m = re.match(r"@(\w+)\s*[-–—:]?\s*(.*)", line[3:].strip())
            entry = {"author": m[1] if m else None, "title": (m[2] if m else line[3:]).strip() or line[3:].strip(), "labels": {}, "links": [], "text": [], "day": day}
        elif entry is None or bare == "---":
            continue
        elif m := re.match(r"- \*\*([^*:]+):\*\*\s*(.*)", bare):
            label, value = m[1].strip().lower(), m[2].strip()
            if label in ("what", "tweet", "post", "parent", "quoted", "filed", "media"):
                entry["labels"][label] = value
            else:
                found = re.findall(r"\[([^\]]*)\]\(([^)\s]+)\)", value)
                entry["links"] += [(u, n) for n, u in found] or [(value, m[1].strip())]
        elif bare.startswith(">"):
            entry["text"].append(bare[1:].strip())
        elif bare and entry["text"]:
            entry["text"].append(bare)
    close()
    return items, (["content, but no entry"] if not items and text.strip() else [])


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def parse_feed(text: str, feed_url: str = "", medium: str = "rss") -> tuple[list[Record], list[str]]:
    """Entries of RSS 2.0, RDF or Atom."""
    try:
        root = ET.fromstring(text.encode())
    except ET.ParseError as e:
        return [], [f"not a feed: {e}"]
    if _local(root.tag) not in ("rss", "feed", "rdf"):
        return [], ["not a feed"]
    host = urlsplit(feed_url).netloc or "feed"
    items = []
    for node in root.iter():
        if _local(node.tag) not in ("item", "entry"):
            continue
        parts: dict[str, str] = {}
        for x in node.iter():
            if (t := "".join(x.itertext()).strip()) and _local(x.tag) not in parts:
                parts[_local(x.tag)] = t
        hrefs = [x.attrib["href"] for x in node if _local(x.tag) == "link" and x.attrib.get("href") and x.attrib.get("rel", "alternate") != "self"]
        url = hrefs[0] if hrefs else parts.get("link")
        title = clean_html(parts.get("title"))
        id = parts.get("guid") or (parts.get("id") if _local(node.tag) == "entry" else None) or url or title
        if not id or not title:
            continue
        body = clean_html(parts.get("content") or parts.get("description") or parts.get("encoded") or parts.get("summary"))
        raw = parts.get("creator") or parts.get("name") or parts.get("author") or ""
        handle, name = raw or None, None
        if m := re.fullmatch(r"(.*?)\(([^)]+)\)(.*)", raw):
            outer, inner = (m[1] + m[3]).strip(), m[2].strip()
            handle = next((p for p in (outer, inner) if "@" in p), None)
            name = next((p for p in (inner, outer) if p and "@" not in p), None)
        target = url if valid_url(url) else feed_url or None
        created = next((ms for k in ("pubdate", "updated", "published", "date") if (ms := when_ms(parts.get(k))) is not None), None)
        items.append(record(medium=medium, external_id=id.strip(), url=target, author_handle=handle.lower() if handle else None, author_name=name, title=title, body="\n\n".join(x for x in (title, body) if x), created_ms=created, tags=[host], links=[link_of(target)] if target else []))
    return items, []


def parse_hackernews(text: str, collection: str | None = None) -> tuple[list[Record], list[str]]:
    items, rejects = [], []
    for hit in json.loads(text).get("hits") or ():
        id = hit.get("objectID") or hit.get("objectId") or hit.get("id")
        body = "\n\n".join(x for x in (hit.get("title"), clean_html(hit.get("story_text")), clean_html(hit.get("comment_text"))) if x)
        if not id or not body.strip():
            rejects.append("hit without id or text")
            continue
        url = hit.get("url") or f"https://news.ycombinator.com/item?id={id}"
        items.append(record(medium="hackernews", external_id=str(id), collection=collection, url=url, author_handle=hit.get("author"), title=hit.get("title"), body=body, role="reply" if hit.get("parent_id") is not None else None, created_ms=when_ms(hit.get("created_at")), links=[link_of(url)], raw=json.dumps(hit, ensure_ascii=False)))
    return items, rejects


def parse_reddit(text: str, collection: str | None = None) -> tuple[list[Record], list[str]]:
    items, rejects = [], []
    for child in (json.loads(text).get("data") or {}).get("children") or ():
        d = child.get("data") or {}
        body = "\n\n".join(x for x in (d.get("title"), d.get("selftext")) if x)
        if d.get("stickied") or not body.strip() or not d.get("id"):
            rejects.append("stickied or empty")
            continue
        own = f"https://www.reddit.com{d.get('permalink', '')}"
        url = d["url"] if valid_url(d.get("url")) and "reddit.com" not in d["url"] else own
        items.append(record(medium="reddit", external_id=str(d["id"]), collection=collection, url=url, author_handle=d.get("author"), title=d.get("title"), body=body, created_ms=when_ms(d.get("created_utc")), links=[link_of(url)], raw=json.dumps(d, ensure_ascii=False)))
    return items, rejects


def parse_github_stars(text: str) -> tuple[list[Record], list[str]]:
    items = []
    for d in json.loads(text):
        body = "\n\n".join(x for x in (d.get("full_name"), d.get("description"), f"Language: {d['language']}" if d.get("language") else None) if x)
        items.append(record(medium="github", external_id=str(d.get("id")), url=d.get("html_url"), author_handle=(d.get("owner") or {}).get("login"), title=d.get("full_name"), body=body, tags=["github", "starred", *(d.get("topics") or ())], links=[link_of(d["html_url"], "repository")] if d.get("html_url") else [], raw=json.dumps(d, ensure_ascii=False)))
    return items, []


def parse_youtube(text: str) -> tuple[list[Record], list[str]]:
    """Videos of a playlist page: both entry shapes found anywhere in its initial data, first wins."""
    at = text.find("ytInitialData")
    brace = text.find("{", at)
    if at < 0 or brace < 0:
        return [], ["no initial data"]
    try:
        root, _ = json.JSONDecoder().raw_decode(text[brace:])
    except ValueError:
        return [], ["broken initial data"]
    items, seen, todo = [], set(), [root]

    def add(id, title, channel):
        if id and id not in seen:
            seen.add(id)
            url = f"https://www.youtube.com/watch?v={id}"
            items.append(record(medium="youtube", external_id=id, url=url, author_handle=channel.lower() if channel else None, title=title, body=title or id, tags=["needs-transcript"], links=[link_of(url, "video")]))

    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            if isinstance(v := node.get("playlistVideoRenderer"), dict):
                add(v.get("videoId"), "".join(r.get("text", "") for r in (v.get("title") or {}).get("runs") or ()), next((r.get("text") for r in (v.get("shortBylineText") or {}).get("runs") or ()), None))
            if isinstance(v := node.get("lockupViewModel"), dict):
                meta = ((v.get("metadata") or {}).get("lockupMetadataViewModel")) or {}
                found = re.search(r'"metadataParts":\s*\[\s*\{\s*"text":\s*\{\s*"content":\s*"([^"]*)"', json.dumps(meta))
                add(v.get("contentId"), (meta.get("title") or {}).get("content"), found[1] if found else None)
            todo.extend(reversed(list(node.values())))
        elif isinstance(node, list):
            todo.extend(reversed(node))
    return items, []


def parse_x_timeline(text: str) -> tuple[list[Record], list[str]]:
    """Posts of a bookmark timeline page; tombstones (no content) are rejects, a wrong envelope is one too."""
    root = json.loads(text)
    line = ((root.get("data") or root).get("bookmark_timeline_v2")) if isinstance(root, dict) else None
    if not isinstance(line, dict):
        return [], ["no timeline"]
    items, rejects = [], []
    for instruction in (line.get("timeline") or line).get("instructions") or ():
        for e in instruction.get("entries") or ():
            result = (((e.get("content") or {}).get("itemContent") or {}).get("tweet_results") or {}).get("result")
            if result is None:
                continue
            result = result.get("tweet") or result
            legacy = (result.get("legacy") or {}).get("full_tweet") or result.get("legacy")
            if not legacy:
                rejects.append("tombstone")
                continue
            user = (((result.get("core") or {}).get("user_results") or {}).get("result")) or {}
            user = user.get("legacy") or user.get("core") or user
            id = legacy.get("rest_id") or result.get("rest_id") or legacy.get("id_str")
            handle = user.get("screen_name")
            items.append(record(medium="x", external_id=str(id), url=f"https://x.com/{handle or 'i'}/status/{id}", author_handle=f"@{handle.lower()}" if handle else None, author_name=user.get("name"), body=legacy.get("full_text") or legacy.get("text") or "", created_ms=when_ms(legacy.get("created_at")), media=_media(legacy), tags=[f"@{handle}"] if handle else [], raw=json.dumps(result, ensure_ascii=False)))
    return items, rejects


def sniff(path: str, text: str) -> str:
    """Format of a file by its name and, where that says too little, its content."""
    ending = path.rpartition(".")[2].lower()
    head = text.lstrip()[:2000]
    if ending in ("html", "htm"):
        return "bookmark-file" if re.search(r"<dl|netscape-bookmark", head, re.I) else "document"
    if ending == "opml" or "<opml" in head[:300]:
        return "opml"
    if ending in ("rss", "atom", "xml") and re.search(r"<(rss|feed|rdf)", head, re.I):
        return "feed"
    if ending in ("json", "jsonl", "ndjson"):
        return "json"
    if ending in ("md", "markdown"):
        return "archive" if re.search(r"^# .*\d", text, re.M) and re.search(r"^## ", text, re.M) else "document"
    if ending == "txt":
        lines = [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
        return "urls" if lines and all(re.match(r"(https?://|\[|[\w-]+\.[\w.-]+(/|$))", x.strip()) for x in lines) else "document"
    return "json" if head[:1] in "[{" and head else "document"


def parse_any(path: str, text: str, modified_ms: int | None = None, kind: str | None = None, medium: str | None = None) -> tuple[list[Record], list[str]]:
    kind = kind or sniff(path, text)
    try:
        match kind:
            case "json":
                return parse_json(text, medium or "json")
            case "bookmark-file":
                return parse_bookmark_file(text)
            case "opml":
                return parse_opml(text)
            case "feed":
                return parse_feed(text, medium=medium or "rss")
            case "urls":
                return parse_url_list(text)
            case "archive":
                return parse_markdown_archive(text, path.rpartition("/")[0])
            case "hackernews":
                return parse_hackernews(text)
            case "reddit":
                return parse_reddit(text)
            case "github":
                return parse_github_stars(text)
            case "youtube":
                return parse_youtube(text)
            case "x":
                return parse_x_timeline(text)
            case _:
                return parse_document(text, path, modified_ms)
    except (ValueError, TypeError, AttributeError, KeyError) as e:
        return [], [f"{type(e).__name__}: {e}"[:200]]
