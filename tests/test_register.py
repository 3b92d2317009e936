from keepsieve.functions.register import register


def test_sql_functions(spark, tmp_path):
    register(spark)
    r = spark.sql("SELECT url_host('https://www.GitHub.com/a') h, url_kind('https://github.com/a/b') k, stem('relational') s, jaro_winkler('martha', 'marhta') j, block_score('short') b, url_kind(NULL) n").first()
    assert (r["h"], r["k"], r["s"], round(r["j"], 4), r["b"]) == ("github.com", "repository", "relat", 0.9611, 0.0)
    r = spark.sql("SELECT url_canonical('http://www.A.example/?b=1&a=') c, fuzzy_score('magnetic fields', 'magntic') f, fuzzy_score('none', 'magntic') n, fuzzy_score(NULL, 'x') z, bigrams('Ab a') b, simhash64(array('a')) s, url_key(NULL) k").first()
    assert r["c"] == "https://a.example/?a=&b=1" and r["f"] == 1 - 1 / 8 and r["n"] is None and r["z"] is None and sorted(r["b"]) == [" a", "ab", "b "] and r["s"] != 0 and r["k"] is None
    rows = spark.sql("SELECT t.* FROM VALUES ('a.txt', 'https://a.example') AS f(p, x), LATERAL parse_file(p, x) t").collect()
    assert rows[0]["medium"] == "manual"
    (tmp_path / "1.json").write_text('{"hits":[{"objectID":"1","title":"a"}]}')
    assert spark.read.format("archived_pages").option("kind", "hackernews").load(str(tmp_path)).count() == 1
