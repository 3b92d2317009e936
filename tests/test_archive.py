"""Readers, store, stages, renderers and streams on small invented inputs."""

import json

import pytest
from pyspark.sql import functions as F

from keepsieve.functions import pages, texts, urls
from keepsieve.operators import query, rules, search, stages
from keepsieve.operators.components import components
from keepsieve.operators.store import Store, assign_categories, delete, latest_wins
from keepsieve.sinks import render
from keepsieve.sources import parsers
from keepsieve.sources.readers import ITEM, manual_items, paged_items, read_files
from keepsieve.streaming.ingest import ingest_available, item_stream

NOW = 1_800_000_000_000


def col(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


@pytest.mark.parametrize(
    "url,want",
    [
        ("http://WWW.Example.com/a?utm_source=x&b=2&a=1#top", "https://example.com/a?a=1&b=2"),
        ("https://example.com/", "https://example.com"),
        ("https://example.com:8080/x?ref=1", "https://example.com:8080/x"),
        ("https://example.com/?q=1", "https://example.com/?q=1"),
        ("https://example.com?q=a%20b&a=", "https://example.com/?a=&q=a%20b"),
        ("https://u@example.com:80", "https://example.com:80"),
        (None, None),
    ],
)
def test_canonical(spark, url, want):
    assert col(spark, [url]).select(urls.canonical(F.col("x"))).first()[0] == want
    if url:
        assert parsers.canonical(url) == want


def test_url_functions(spark):
    cases = {
        "https://x.com/i/article/1": "long-form", "https://x.com/a/status/1": "post", "https://arxiv.org/abs/1": "paper", "https://github.com/a/b": "repository", "https://youtu.be/x": "video",
        "https://mypodcast.net/1": "podcast", "https://a.example/x.PNG": "image", "https://a.example/releases/1": "release", "https://docs.rs/x": "release", "https://lobste.rs/s/1": "thread", "https://a.example/": "article",
    }
    got = {r["x"]: r["url_kind"] for r in urls.with_kind(col(spark, list(cases)), "x").collect()}
    assert got == cases
    one = col(spark, ["https://www.youtube.com/watch?v=abc-1&t=3"]).select(urls.video_id(F.col("x")), urls.host(F.col("x")), urls.embed_endpoint(F.col("x"))).first()
    assert one[0] == "abc-1" and one[1] == "youtube.com" and one[2].startswith("https://www.youtube.com/")
    assert col(spark, ["https://github.com/a/b.git"]).select(urls.repository(F.col("x"))).first()[0] == "a/b"
    assert col(spark, ["a b-c/é"]).select(urls.percent_encode(F.col("x"))).first()[0] == "a%20b%2Dc%2F%C3%A9"
    assert col(spark, ["https://blog.medium.com/x", "https://notmedium.com"]).select(urls.is_paywalled(F.col("x")).alias("p")).collect() == [(True,), (False,)]


def test_entities(spark):
    text = "ask @harbour_1, me@mail.example about #Boats &#x27; #1999 b#flat $TIN $250 at https://pier.example/9). and tide.co.uk or keel.rs, mast.blog too."
    r = col(spark, [text]).select(*[f(F.col("x")).alias(n) for n, f in (("m", texts.mentions), ("h", texts.hashtags), ("c", texts.cashtags), ("d", texts.bare_domains), ("l", urls.links_in))]).first()
    assert r["m"] == ["harbour_1"] and r["h"] == ["boats", "flat"] and r["c"] == ["tin"] and r["d"] == ["tide.co.uk", "mast.blog"] and r["l"] == ["https://pier.example/9"]
    assert col(spark, [None]).select(texts.mentions(F.col("x"))).first()[0] == []


def test_text_helpers(spark):
    r = col(spark, ["a,b\"c"]).select(texts.escape_csv(F.col("x")), texts.escape_xml(F.col("x"))).first()
    assert r[0] == '"a,b""c"' and r[1] == "a,b&quot;c"
    assert [x[0] for x in col(spark, ["#abc", "#ABCDEF", "tomato", None]).select(texts.color(F.col("x"))).collect()] == ["#aabbcc", "#abcdef", "#64748b", "#64748b"]
    assert [x[0] for x in col(spark, [1578220625, 1578220625123, 1578220625123000], "bigint").select(texts.epoch_ms(F.col("x"))).collect()] == [1578220625000, 1578220625123, 1578220625123]
    assert [x[0] for x in col(spark, ["hacker_news", " YT ", "x", "nope"]).select(texts.medium(F.col("x"))).collect()] == ["hackernews", "youtube", "x", None]
    assert col(spark, ["```json\n{\"a\":1}\n```"]).select(texts.unfenced(F.col("x"))).first()[0] == '{"a":1}'
    a = col(spark, ["w@example (A Writer)", "A Writer (w@example.org)"]).select(texts.feed_author(F.col("x")).alias("a")).select("a.*").collect()
    assert a[1]["address"] == "w@example.org" and a[0]["name"] == "A Writer"


def test_article(spark):
    prose = "This is a long sentence about harbours, boats and the people who keep them; it goes on. " * 5
    page = f'<html><head><meta property="og:title" content="Ha &amp; B"><meta name="author" content="Ann"></head><body><nav><p>{prose}</p></nav><p>{prose}</p><p>short</p><p><a href="x">{prose}</a></p></body></html>'
    r = col(spark, [page, "<p>Subscribe to continue</p>", None]).select(pages.article(F.col("x"), F.lit("https://b")).alias("a")).select("a.*").collect()
    assert r[0]["title"] == "Ha & B" and r[0]["author"] == "Ann" and r[0]["body"] == prose.strip() and r[0]["blocked"] is None and r[0]["canonical"] == "https://b"
    assert r[1]["body"] == "" and r[1]["blocked"] == "paywall" and r[2]["body"] is None
    assert col(spark, ['<div id="root"></div><script>x</script>']).select(pages.needs_rendering(F.col("x"))).first()[0]


def test_parsers():
    items, rejects = parsers.parse_json(json.dumps({"items": [{"id": 5, "text": "hi", "author": {"username": "Bo", "name": "Bo B"}, "tags": ["#A", "b"], "created_at": 1578220625123}, {"x": 1}, 3]}))
    assert len(items) == 1 and len(rejects) == 2 and items[0]["author_handle"] == "bo" and items[0]["tags"] == ["a", "b", "bo"] and items[0]["created_ms"] == 1578220625123
    assert [parsers.shape_of(o) for o in ({"text": 1}, {"id_str": 1}, {"tweetId": 1, "authorHandle": 1}, {"Tweet Id": 1}, {"id": 1})] == ["console", "api", "roundtrip", "flat", "post"]
    marks = "<DL><DT><H3>Code</H3><DL><DT><A HREF=\"https://a.example/x\" ADD_DATE=\"1578220625\">A &amp; B</A></DL><DT><A href='https://b.example'>B</A></DL>"
    items, _ = parsers.parse_bookmark_file(marks)
    assert [(i["title"], i["tags"], i["created_ms"]) for i in items] == [("A & B", ["code"], 1578220625000), ("B", [], None)]
    items, _ = parsers.parse_opml('<opml><body><outline text="F"><outline text="t" xmlUrl="https://f.example/rss"/></outline><outline text="p" url="https://p.example" addDate="5"/></body></opml>')
    assert [(i["medium"], i["tags"]) for i in items] == [("rss", ["f", "feed"]), ("browser-bookmarks", [])]
    items, rejects = parsers.parse_url_list("# c\n\nhttps://a.example\n[T](https://b.example/x)\nc.example/y\nhttps://a.example\nnot one")
    assert [i["url"] for i in items] == ["https://a.example", "https://b.example/x", "https://c.example/y"] and len(rejects) == 1
    rss = "<rss><channel><item><title>T</title><link>https://a.example/1</link><pubDate>Fri, 02 Jan 2026 10:00:00 GMT</pubDate><author>w@x.example (A W)</author><description>&lt;b&gt;D&lt;/b&gt;</description></item></channel></rss>"
    items, _ = parsers.parse_feed(rss, "https://f.example/rss")
    assert items[0]["author_name"] == "A W" and items[0]["body"] == "T\n\nD" and items[0]["created_ms"] == parsers.when_ms("2026-01-02T10:00:00Z")
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="https://a.example/e"/><id>i</id><updated>2026-01-02T10:00:00Z</updated></entry></feed>'
    assert parsers.parse_feed(atom)[0][0]["url"] == "https://a.example/e"
    assert parsers.parse_feed("<html/>")[1] and parsers.parse_feed("nope")[1]


def test_journal():
    text = "# Friday, January 2, 2026\n## @Ann - First\n> quoted\n- **What:** note\n- **Tweet:** https://x.com/ann/status/1\n- **Links:** [a](https://a.example), [b](https://b.example)\n- **Filed:** [f](knowledge/f.md)\n- **Media:** two videos\n---\n## @ann - First\n- **Tweet:** https://x.com/ann/status/1\n"
    items, rejects = parsers.parse_markdown_archive(text, "/home/me")
    assert len(items) == 1 and not rejects
    i = items[0]
    assert i["body"] == "note\n\nquoted" and i["author_handle"] == "@ann" and i["created_ms"] == parsers.when_ms("2026-01-02T00:00:00Z")
    assert {"filed", "has-media", "videos", "@ann"} <= set(i["tags"]) and i["links"][-1]["resolved"] == "file:///home/me/knowledge/f.md"
    assert parsers.parse_markdown_archive("just text")[1]


def test_api_pages():
    hn, _ = parsers.parse_hackernews(json.dumps({"hits": [{"objectID": "1", "title": "T", "comment_text": "<p>hi</p>", "parent_id": 3, "created_at": "2026-01-02T10:00:00.000Z"}, {"objectID": "2"}]}))
    assert len(hn) == 1 and hn[0]["role"] == "reply" and hn[0]["url"].endswith("item?id=1") and hn[0]["body"] == "T\n\nhi"
    rd, rej = parsers.parse_reddit(json.dumps({"data": {"children": [{"data": {"id": "a", "title": "T", "permalink": "/r/x/a", "url": "https://www.reddit.com/r/x/a", "created_utc": 1578220625.0}}, {"data": {"id": "b", "title": "S", "stickied": True}}]}}))
    assert rd[0]["url"] == "https://www.reddit.com/r/x/a" and len(rej) == 1 and rd[0]["created_ms"] == 1578220625000
    gh, _ = parsers.parse_github_stars(json.dumps([{"id": 1, "full_name": "a/b", "html_url": "https://github.com/a/b", "description": "d", "language": "Go", "topics": ["cli"], "owner": {"login": "a"}}]))
    assert gh[0]["tags"] == ["cli", "github", "starred"] and "Language: Go" in gh[0]["body"]
    yt, _ = parsers.parse_youtube('var ytInitialData = {"a":[{"playlistVideoRenderer":{"videoId":"v1","title":{"runs":[{"text":"One"}]},"shortBylineText":{"runs":[{"text":"Chan"}]}}},{"playlistVideoRenderer":{"videoId":"v1"}}]};')
    assert [i["external_id"] for i in yt] == ["v1"] and yt[0]["author_handle"] == "chan"
    tl = {"bookmark_timeline_v2": {"instructions": [{"entries": [{"content": {"itemContent": {"tweet_results": {"result": {"core": {"user_results": {"result": {"screen_name": "Ann", "name": "A"}}}, "legacy": {"rest_id": "7", "full_text": "hey", "created_at": "Fri Jan 02 10:00:00 +0000 2026"}}}}}}, {"content": {"itemContent": {"tweet_results": {"result": {"__typename": "Gone"}}}}}]}]}}
    x, rej = parsers.parse_x_timeline(json.dumps({"data": tl}))
    assert x[0]["author_handle"] == "@ann" and len(rej) == 1 and x[0]["created_ms"]
    assert parsers.parse_x_timeline("{}")[1] == ["no timeline"]


def test_read_files_and_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("https://a.example\nhttps://b.example\n")
    (tmp_path / "n.md").write_text("just a note")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "x.md").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.json").write_text('[{"id":1,"text":"t"},{"x":2}]')
    (tmp_path / "bad.bin").write_bytes(b"\x00\xff\x00")
    items, rejects = read_files(spark, str(tmp_path))
    assert sorted(r["medium"] for r in items.collect()) == ["json", "local-file", "manual", "manual"]
    assert rejects.count() == 2
    payloads = iter([('{"hits":[{"objectID":"1","title":"a"}]}', "2"), ('{"hits":[{"objectID":"2","title":"b"}]}', "2")])
    got, _ = paged_items(spark, lambda c: next(payloads), "hackernews")
    assert got.count() == 2
    assert manual_items(spark, ["https://a.example", "ftp://no"])[0].count() == 1


def test_store_and_stages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps([{"id": 1, "text": "see https://github.com/a/b and #rust", "author": {"username": "bo"}}, {"id": 1, "text": "again"}, {"id": 2, "text": "plain words here", "media": ["https://m.example/a.jpg"]}]))
    store = Store(spark, str(tmp_path / "store"))
    items, _ = read_files(spark, str(tmp_path / "in"))
    assert store.insert(items, NOW) == {"inserted": 2, "seen": 3, "duplicates": 1}
    assert store.insert(items, NOW + 1)["inserted"] == 0
    done = {r["stage"]: r["done"] for r in stages.run_all(store, NOW).collect()}
    assert done == dict.fromkeys(stages.ORDER, 2)
    assert {r["done"] for r in stages.run_all(store, NOW + 5).collect()} == {0}
    t = Store(spark, str(tmp_path / "store")).tables()
    tags = {r["tag"] for r in t["tag"].collect()}
    assert {"rust", "github.com", "bo", "needs-description"} <= tags
    assert "engineering" in {r["slug"] for r in t["item_category"].collect()}
    assert t["bookmark"].where("fingerprint is null or described_at is null").count() == 0
    one = t["bookmark"].limit(1).select("id")
    left = delete(t, one)
    assert left["bookmark"].count() == 1 and left["tag"].join(one.withColumnRenamed("id", "bookmark"), "bookmark").count() == 0


def records(spark, n, start=0, ms="null"):
    given = spark.range(start, start + n).select(F.lit("manual").alias("medium"), F.col("id").cast("string").alias("external_id"), F.expr(f"cast({ms} as bigint)").alias("created_ms"))
    empty = spark.createDataFrame([], ITEM)
    return empty.unionByName(given, allowMissingColumns=True).withColumns({c: F.coalesce(c, F.array().cast(dict(empty.dtypes)[c])) for c in ("tags", "links", "media")})


def test_ids_are_unique_and_follow_time(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.insert(records(spark, 100_000), NOW)["inserted"] == 100_000
    # the undated run on into the next ms, where dated ones come to stand
    assert store.insert(records(spark, 300, 200_000, f"{NOW} + id % 3"), NOW)["inserted"] == 300
    assert store.insert(records(spark, 70_000, 300_000), NOW + 1)["inserted"] == 70_000
    items = store.table("bookmark")
    assert items.select("id").distinct().count() == items.count() == 170_300
    assert store.insert(records(spark, 10), NOW + 2)["inserted"] == 0
    one = records(spark, 3, 900_000, "1700000000000 + 5 * id")
    store.insert(one, NOW)
    got = store.table("bookmark").join(one.select("external_id", F.col("created_ms").alias("ms")), "external_id").select(texts.id_to_millis(F.col("id")).alias("x"), "ms").collect()
    assert len(got) == 3 and all(r["x"] == r["ms"] for r in got)


def test_a_change_that_fails_leaves_the_last_one(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store = Store(spark, path)
    store.insert(records(spark, 50), NOW)
    written = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            store.insert(records(spark, 5, 100), NOW)
    again = Store(spark, path)
    assert again.table("bookmark").count() == 50 and again.manifest["version"] == 1
    (tmp_path / "store" / "_manifest-9-x").write_text("half")
    before = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    again.insert(records(spark, 5, 100), NOW)
    # an insert writes its batch, not the archive
    assert Store(spark, path).table("bookmark").count() == 55 and sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) - before < written
    assert len(again.manifest["tables"]["bookmark"]) == 2
    again.compact()
    assert len(again.manifest["tables"]["bookmark"]) == 1 and again.table("bookmark").count() == 55 and again.size() > 0
    again.reset()
    assert Store(spark, path).tables() == {}
    again.undo()
    assert Store(spark, path).table("bookmark").count() == 55


def test_assign_categories(spark):
    category = spark.createDataFrame([(1, "a"), (2, "b")], "id long, slug string")
    assigned = spark.createDataFrame([(10, 1, 0.5, "rule"), (11, 2, 0.5, "rule"), (12, 2, 0.5, "rule")], "bookmark long, category long, confidence float, assigned_by string")
    changes = spark.createDataFrame([(10, "b", 1.0, "model"), (10, "b", 0.5, "model"), (10, "zzz", 1.0, "model"), (12, "zzz", 1.0, "model")], "bookmark long, slug string, confidence float, assigned_by string")
    got = {(r["bookmark"], r["category"], r["confidence"]) for r in assign_categories(assigned, changes, category).collect()}
    assert got == {(10, 2, 1.0), (11, 2, 0.5)}


def test_store_refuses_another_schema(spark, tmp_path):
    (tmp_path / "manifest-1.json").write_text('{"schema": 99, "version": 1, "tables": {}}')
    with pytest.raises(ValueError, match="schema"):
        Store(spark, str(tmp_path))


def test_stream_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rec = {"medium": "json", "external_id": "1", "body": "b", "created_ms": 1578220625123, "tags": ["a"], "links": [], "media": []}
    (tmp_path / "in" / "1.json").write_text(json.dumps(rec) + "\n" + json.dumps(rec | {"external_id": "2"}))
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        ingest_available(item_stream(spark, str(tmp_path / "in"), ITEM), store, str(tmp_path / "cp"), NOW)
    (tmp_path / "in" / "2.json").write_text(json.dumps(rec))
    ingest_available(item_stream(spark, str(tmp_path / "in"), ITEM), store, str(tmp_path / "cp"), NOW)
    assert store.table("bookmark").count() == 2


def test_search(spark):
    docs = spark.createDataFrame([(1, "sqlite internals", "the b-tree layout of sqlite", ""), (2, None, "about trees", "x"), (3, "", None, None), (4, "Running", "", "")], "id int, title string, body string, extra string")
    assert [r["id"] for r in search.bm25(docs, "sqlite tree").collect()] == [1]
    assert sorted(r["id"] for r in search.bm25(docs, "sqlite trees").collect()) == [1, 2]
    assert search.bm25(docs, "").count() == 0 and search.bm25(docs.limit(0), "x yy").count() == 0
    assert search.hybrid(docs, "sqllite").first()["id"] == 1 and search.hybrid(docs, " ").count() == 0
    hit = search.fuzzy(docs.withColumn("text", F.col("body")), "b-tre").first()
    assert (hit["id"], hit["first"], hit["last"]) == (1, 4, 8)
    assert search.bigram_candidates(docs.withColumn("text", F.col("body")), "tree", every=True).count() == 2
    assert docs.select(search.porter_tokens(F.col("title"))).collect()[3][0] == ["run"]
    got = spark.range(1).select(search.highlight_ranges(F.array(*map(F.lit, [1, 2, 3, 7, 9, 10])))).first()[0]
    assert [tuple(r) for r in got] == [(1, 3), (7, 7), (9, 10)]


def test_index(spark):
    from keepsieve.operators.index import open_index, with_ranks

    docs = spark.createDataFrame([(1, "sqlite internals", "the b-tree layout of sqlite", "", 5), (2, None, "about trees", "x", 6), (3, "", None, None, 7), (4, "Running", "z", "", 8)], "id int, title string, body string, extra string, ingested_at long")
    made = open_index(docs, "test-index")
    for q in ("sqlite tree", "sqlite trees", "x", "", "running"):
        want = {r["id"]: round(r["bm25"], 9) for r in search.bm25(docs, q, terms=[q] if len(q) == 1 else None).collect()}
        assert {r["id"]: round(r["bm25"], 9) for r in made.bm25(q).collect()} == want
    assert open_index(docs, "test-index").path == made.path and open_index(docs.where("id < 4"), "test-index").path != made.path
    assert made.search("sqllite").first()["id"] == 1 and made.search(" ").count() == 0 and made.search("sqlite", offset=1).count() == 0
    assert sorted(r["id"] for r in made.candidates("tree", every=True).collect()) == [1, 2] and made.candidates("").count() == 0
    hits = made.search("sqlite", mode="exact").unionByName(spark.createDataFrame([(99, 0.0, 1)], "id bigint, fused double, exact int"))
    assert [(r["id"], r["rank"]) for r in with_ranks(docs, hits, F.col("fused").desc()).collect()] == [(1, 1)]
    assert open_index(docs.limit(0), "empty").bm25("sqlite").count() == 0


def test_carry_forward(spark):
    rows = [(i, "ab"[i % 2], None if i % 5 else f"v{i}", None if i == 3 else 10_000_000_000 * i) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, g string, v string, t long")
    want, last = {}, {}
    for i, g, v, _ in sorted(rows, key=lambda r: (r[3] if r[3] is not None else -1, r[0])):
        last[g] = v or last.get(g)
        want[i] = last[g]
    assert {r["id"]: r["carried"] for r in query.carry_forward(df, by="g", value="v", at="t").collect()} == want


def test_typo_search_of_long_queries(spark):
    import random

    import numpy as np

    def fewest(text, needle):
        row, best = list(range(len(needle) + 1)), (len(needle) + 1, -1)
        for j, c in enumerate(text):
            nxt = [0]
            for i, d in enumerate(needle, 1):
                nxt.append(min(row[i - 1] + (c != d), row[i] + 1, nxt[i - 1] + 1))
            row, best = nxt, min(best, (nxt[-1], j))
        return best

    rng = random.Random(4)
    for m in (3, 63, 64, 65, 128, 150):
        needle = "".join(rng.choices("abc", k=m))
        near = "".join(c for c in needle if rng.random() > 0.05)
        texts = [x.ljust(220, "z") for x in ("".join(rng.choices("abc", k=200)), "c" + needle, near, near[:70])]
        codes = np.array(texts, dtype="U220").view(np.uint32).reshape(4, 220)
        edits, end = search._distances(codes, np.array([ord(c) for c in needle], np.uint32))
        assert list(zip(edits.tolist(), end.tolist())) == [fewest(t, needle) for t in texts]
    long = "the quick brown fox jumps over the lazy dog while nobody in the whole wide valley looks up from work"
    docs = spark.createDataFrame([(1, long[:64] + " and all else differs from here"), (2, "so " + long)], "id long, text string")
    scores = {r["id"]: r["x"] for r in docs.select("id", search.typo_scores(F.col("text"), long).alias("x")).collect()}
    assert scores[2]["score"] == 1 and (scores[2]["first"], scores[2]["last"]) == (3, 2 + len(long)) and not scores[1]["score"] == 1


def test_rules(spark):
    urls_ = ["https://github.com/a", "https://arxiv.org/1", "https://x.example", None]
    got = [r[0] for r in col(spark, urls_).select(rules.route(F.col("x"))).collect()]
    assert got == ["engineering", "engineering", "general", "general"]
    table = spark.createDataFrame([(i, r.slug, n) for i, r in enumerate(rules.DEFAULT_RULES) for n in r.any], "order int, slug string, needle string")
    assert [r["slug"] for r in rules.route_by_table(col(spark, urls_), "x", table).orderBy(F.col("x").asc_nulls_last()).collect()] == ["engineering", "engineering", "general", "general"]
    import random

    rng = random.Random(3)
    word = lambda a, b: "".join(rng.choices("ab./", k=rng.randrange(a, b)))
    made = [rules.Rule(f"s{i}", [word(1, 6), word(1, 6)]) for i in range(12)] + [rules.Rule("tools", ["/software"]), rules.Rule("eng", ["hub.com"])]
    table = spark.createDataFrame([(i, r.slug, n) for i, r in enumerate(made) for n in r.any], "order int, slug string, needle string")
    df = col(spark, [f"https://{word(4, 14)}" for _ in range(150)] + ["https://x.example/software", "https://github.com/a", "", None, None])
    same = rules.route_by_table(df, "x", table).select("slug", rules.route(F.col("x"), made).alias("want"))
    assert same.count() == 155 and same.where("slug <> want").count() == 0
    assert rules.rubric(rules.default_categories(spark)).first()["rubric"].startswith("- business: markets")
    assert col(spark, ["https://arxiv.org/1"]).select(rules.all_matches(F.col("x"))).first()[0] == ["engineering", "science"]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, k) for k in range(201, 260)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert set(got.values()) == {1, 100, 200} and len(got) == 40 + 2 + 60
    assert components(edges.limit(0)).count() == 0


def test_renderers(spark):
    items = spark.createDataFrame([(5, "rss", "e,1", None, "https://a.example/x/y/", "@bo", "Bo", None, None, "first line\nmore", "", None, 1578220625000, NOW, '{"a":1}')], "id long, medium string, external_id string, collection string, url string, author_handle string, author_name string, title string, summary string, body string, extra string, role string, created_ms long, ingested_at long, raw string")
    empty = {"link": "bookmark long, ordinal int, original string, resolved string, kind string, title string, body string, summary string, blocked string", "media": "bookmark long, ordinal int, kind string, url string, preview_url string, width int, height int, duration_ms long, alt_text string", "tag": "bookmark long, tag string", "assigned": "bookmark long, category long, confidence float, assigned_by string", "category": "id long, slug string"}
    sat = [spark.createDataFrame([(5, " B "), (5, "a")] if n == "tag" else [], s) for n, s in empty.items()]
    p = render.prepared(query.hydrate(items, *sat)).cache()
    row = render.csv_rows(p).first()["line"]
    assert row.startswith('5,2020-01-05T10:37:05Z,rss,@bo (Bo),first line,https://a.example/x/y/,a b,,"first line')
    doc = "".join(r["line"] for r in render.json_document(p).orderBy("part", "at").collect())
    assert json.loads(doc)["bookmarks"][0]["tags"] == ["a", "b"] and json.loads(doc)["count"] == 1
    assert "<outline" in render.opml_document(p).collect()[1]["line"] and "— @bo" in render.opml_document(p).collect()[1]["line"]
    assert len(render.html_document(p).collect()) == 3 and render.obsidian_notes(p).first()["note"].startswith("---\ntitle: 'first line'")
    assert render.raw_archive(p).first()["file"].startswith("e1-") and render.markdown_index(p).count() == 3
    assert render.report(3, failed=1) == "3 written, 1 failed"


def test_latest_wins(spark):
    a = spark.createDataFrame([(1, 5, "old"), (2, 1, "x")], "k int, o int, v string")
    b = spark.createDataFrame([(1, 5, "new"), (3, 1, "y")], "k int, o int, v string")
    assert {r["k"]: r["v"] for r in latest_wins(a, b, ["k"], "o").collect()} == {1: "new", 2: "x", 3: "y"}
