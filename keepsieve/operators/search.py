"""Search: postings, weighted BM25, bigram candidates, typo-tolerant matching, and rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsieve.functions.texts import ascii_lower, bigrams, query_terms
from keepsieve.plans.runtime import spread

#: Weights of title, body and extra, and the constants of the ranking.
WEIGHTS, K1, B, IDF_FLOOR = {"title": 3.0, "body": 1.0, "extra": 1.5}, 1.2, 0.75, 1e-6
#: Hits of a ranker that take part in the fusion, and its constant.
DEPTH, FUSE = 500, 60


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def porter(word: str) -> str:
    """Porter's stemming algorithm (published 1980)."""
    import re

    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    cons = r"(?:[^aeiouy]|(?<![^aeiou])y|^y)"
    shape = lambda s: re.sub(r"c+", "c", re.sub(r"v+", "v", "".join("v" if c in "aeiou" or (c == "y" and i and s[i - 1] not in "aeiou") else "c" for i, c in enumerate(s))))
    m = lambda s: shape(s).count("vc")
    vowel = lambda s: "v" in shape(s)
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and shape(s[-1]) == "c" and s[-1] not in "aeiou"
    cvc = lambda s: len(s) > 2 and re.fullmatch(r"cvc", "".join("v" if c in "aeiou" or (c == "y" and i and s[i - 1] not in "aeiou") else "c" for i, c in enumerate(s))[-3:]) is not None and s[-1] not in "wxy"
    del cons
    w = word
    for a, b in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(a):
            w = w[: len(w) - len(a)] + b
            break
    again = False
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    elif w.endswith("ed") and vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif m(w) == 1 and cvc(w):
            w += "e"
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (
        # Suffixes of steps 2 and 3.
        (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")),
        (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")),
    ):
        for a, b in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(a):
                w = w[: len(w) - len(a)] + b if m(w[: len(w) - len(a)]) > 0 else w
                break
    # Suffixes of step 4.
    for a in sorted(("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"), key=len, reverse=True):
        if w.endswith(a):
            stem = w[: len(w) - len(a)]
            if m(stem) > 1 and (a != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    if m(w) > 1 and double(w) and w.endswith("l"):
        w = w[:-1]
    return w


def porter_tokens(text: Column) -> Column:
    """Stemmed tokens without accents."""

    @F.pandas_udf("array<string>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re
        import unicodedata

        known: dict[str, str] = {}
        for texts in batches:
            out = []
            for t in texts:
                plain = "".join(c for c in unicodedata.normalize("NFD", (t or "").lower()) if not unicodedata.combining(c))
                words = re.findall(r"[^\W_]+", plain)
                for w in words:
                    if w not in known:
                        if len(known) > 500_000:
                            known.clear()
                        known[w] = porter(w)
                out.append([known[w] for w in words])
            yield pd.Series(out)

    return of(text)


def _weighted(terms: Column, weight: float) -> Column:
    return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w")))


def _times(terms: str, term: str) -> Column:
    return F.size(F.filter(terms, lambda x: x == term))


def postings(items: DataFrame, *, id: str = "id", fields: dict[str, str] | None = None, analyzer=tokens) -> DataFrame:
    """(term, id, weighted, tf): occurrences of each term in each item, weighted by field."""
    fields = fields or {k: k for k in WEIGHTS}
    parts = F.concat(*[_weighted(analyzer(F.col(c)), WEIGHTS[k]) for k, c in fields.items()])
    flat = items.select(F.col(id).alias("id"), F.explode(parts).alias("x"))
    return flat.groupBy(F.col("x.term").alias("term"), "id").agg(F.sum("x.w").alias("weighted"), F.count("*").alias("tf"))


def bm25(items: DataFrame, text: str, *, id: str = "id", fields: dict[str, str] | None = None, depth: int = DEPTH, analyzer=tokens, terms: list[str] | None = None) -> DataFrame:
    """(id, bm25, matched) of the best ``depth`` items; lower is better, ties by id.

    An item must hold all terms of the query; if none does, any term will do.
    Only occurrences of query terms leave the scan: lengths and counts are one
    partial aggregate, so the plan shuffles a row per matching item and term.
    """
    fields = fields or {k: k for k in WEIGHTS}
    terms = terms if terms is not None else list(dict.fromkeys(query_terms(text)))
    if not terms:
        return items.select(F.col(id).alias("id"), F.lit(0.0).alias("bm25"), F.lit(0).alias("matched")).limit(0)
    lists = {k: analyzer(F.col(c)) for k, c in fields.items()}
    base = items.select(F.col(id).alias("id"), *[v.alias(k) for k, v in lists.items()])
    length = sum((F.size(k) for k in fields), F.lit(0))
    scored = base.select(
        "id", length.alias("dl"), *[sum((F.lit(WEIGHTS[k]) * _times(k, t) for k in fields), F.lit(0.0)).alias(f"w{i}") for i, t in enumerate(terms)]
    )
    stats = scored.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"w{i}") > 0).alias(f"n{i}") for i in range(len(terms))])
    any_term = " OR ".join(f"w{i} > 0" for i in range(len(terms)))
    joined = scored.where(any_term).crossJoin(F.broadcast(stats))  # stats is one row
    parts = []
    for i in range(len(terms)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(IDF_FLOOR))
        w = F.col(f"w{i}")
        parts.append(idf * (w * (K1 + 1)) / (w + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    matched = sum(((F.col(f"w{i}") > 0).cast("int") for i in range(len(terms))), F.lit(0))
    out = joined.select("id", (-sum(parts, F.lit(0.0))).alias("bm25"), matched.alias("matched"))
    full = out.agg(F.max("matched").alias("__most"))
    want = out.crossJoin(F.broadcast(full)).where((F.col("matched") == len(terms)) | (F.col("__most") < len(terms)))
    return want.select("id", "bm25", "matched").orderBy("bm25", "id").limit(depth)


def bigram_candidates(items: DataFrame, text: str, *, id: str = "id", content: str = "text", every: bool = False, edits: int | None = None) -> DataFrame:
    """(id): items that share a pair of characters with the query, or every pair that occurs at all.

    With ``edits``, items that can hold the query up to so many edits: an edit
    spoils two pairs at most, so fewer missing ones are certain to be too many.
    """
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    wanted = sorted({low[i : i + 2] for i in range(len(low) - 1) if all(" " <= c <= "~" for c in low[i : i + 2])})
    if not wanted:
        return items.select(F.col(id).alias("id")).limit(0)
    lowered = items.select(F.col(id).alias("id"), ascii_lower(F.coalesce(F.col(content), F.lit(""))).alias("t"))
    flags = [F.contains("t", F.lit(w)) for w in wanted]
    if not every:
        least = 1 if edits is None else max(1, len(wanted) - 2 * edits)
        return lowered.where(sum((f.cast("int") for f in flags), F.lit(0)) >= least).select("id")
    known = lowered.agg(*[F.max(f).alias(f"k{i}") for i, f in enumerate(flags)])
    test = [(~F.col(f"k{i}")) | f for i, f in enumerate(flags)]
    some = sum((F.col(f"k{i}").cast("int") for i in range(len(wanted))), F.lit(0)) > 0
    both = lowered.crossJoin(F.broadcast(known)).where(some)  # known is one row
    for t in test:
        both = both.where(t)
    return both.select("id")


def _distances(codes: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fewest edits, first column where a match of so few ends) of a pattern in each row.

    Myers' bit-parallel scan (1999) in blocks of 64 characters, one column of
    all rows at a time; 0 pads a row.
    """
    m, one, none = len(target), np.uint64(1), np.uint64(0)
    blocks = []
    for lo in range(0, m, 64):
        part = target[lo : lo + 64]
        masks = np.zeros(codes.shape, np.uint64)
        for c in np.unique(part):
            masks[codes == c] = np.uint64(sum(1 << int(i) for i in np.flatnonzero(part == c)))
        blocks.append([masks, np.uint64(len(part) - 1), np.full(len(codes), ~none), np.zeros(len(codes), np.uint64)])
    score, best, at = np.full(len(codes), m), np.full(len(codes), m + 1), np.full(len(codes), -1)
    inside = codes > 0
    for j in range(codes.shape[1]):
        # steps up and down at the last row of a block go into the next one
        ph_in, mh_in = none, none
        for block in blocks:
            masks, top, up, down = block
            eq = masks[:, j]
            xv = eq | down
            eq = eq | mh_in
            xh = (((eq & up) + up) ^ up) | eq
            ph, mh = down | ~(xh | up), up & xh
            ph_out, mh_out = (ph >> top) & one, (mh >> top) & one
            ph, mh = (ph << one) | ph_in, (mh << one) | mh_in
            block[2], block[3] = mh | ~(xv | ph), ph & xv
            ph_in, mh_in = ph_out, mh_out
        score = score + ph_in.astype(np.int64) - mh_in.astype(np.int64)
        better = (score < best) & inside[:, j]
        best, at = np.where(better, score, best), np.where(better, j, at)
    return best, at


def _begin(text: str, needle: str, end: int, edits: int) -> int:
    """Latest start of a match of ``needle`` with ``edits`` edits that ends at ``end``."""
    lo = max(0, end + 1 - len(needle) - edits)
    part, back = text[lo : end + 1][::-1], needle[::-1]
    row = list(range(len(back) + 1))
    for j, c in enumerate(part, 1):
        nxt = [j]
        for i, d in enumerate(back, 1):
            nxt.append(min(row[i - 1] + (c != d), row[i] + 1, nxt[i - 1] + 1))
        row = nxt
        if row[-1] <= edits:
            return end + 1 - j
    return lo


def best_matches(texts: pd.Series, query: str) -> pd.DataFrame:
    """(score, first, last) of the best occurrence of a query in each text; see :func:`typo_scores`."""
    needle = query.lower()
    budget, target = max(1, len(needle) // 4), np.array([ord(c) for c in needle], np.uint32)
    n = len(texts)
    score, first, last = np.full(n, np.nan), np.full(n, -1), np.full(n, -1)
    lowered = [(t or "").lower() for t in texts]
    order = np.argsort([len(t) for t in lowered], kind="stable")
    for lo in range(0, n, 512):
        rows = order[lo : lo + 512]
        width = max((len(lowered[r]) for r in rows), default=0)
        if width == 0 or len(target) == 0:
            continue
        codes = np.array([lowered[r] for r in rows], dtype=f"U{width}").view(np.uint32).reshape(len(rows), width)
        edits, end = _distances(codes, target)
        for i in np.flatnonzero(edits <= budget):
            r = rows[i]
            score[r] = 1 - edits[i] / (len(target) + 1)
            first[r], last[r] = _begin(lowered[r], needle, int(end[i]), int(edits[i])), end[i]
    return pd.DataFrame({"score": score, "first": pd.array(first, dtype="Int32"), "last": pd.array(last, dtype="Int32")})


def typo_scores(texts: Column, query: str) -> Column:
    """struct(score, first, last): best occurrence of the query in each text, null above its budget of edits.

    The budget is a quarter of the query's length, one at least. The score is 1
    for an exact occurrence and falls with each edit; first and last are the
    inclusive character positions matched.
    """

    @F.pandas_udf("score double, first int, last int")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield best_matches(batch, query)

    return of(texts)


def fuzzy(items: DataFrame, text: str, *, id: str = "id", content: str = "text", depth: int = DEPTH) -> DataFrame:
    """(id, score, first, last) of candidate items that hold the query up to its budget of typos, best first."""
    near = bigram_candidates(items.select(id, content), text, id=id, content=content, edits=max(1, len(text) // 4))
    pool = spread(items.select(id, content)).join(near.withColumnRenamed("id", id), id, "left_semi")
    hit = pool.select(F.col(id).alias("id"), typo_scores(F.col(content), text).alias("x")).where("x.score is not null and not isnan(x.score)")
    return hit.select("id", "x.score", "x.first", "x.last").orderBy(F.col("score").desc(), "id").limit(depth)


def word_distance(items: DataFrame, text: str, *, id: str = "id", content: str = "text", depth: int = DEPTH) -> DataFrame:
    """(id, distance): smallest edit distance between the query and any word of an item, within the budget; built-ins only."""
    budget = max(1, len(text) // 4)
    words = items.select(F.col(id).alias("id"), F.explode(F.array_distinct(tokens(F.col(content)))).alias("w"))
    near = words.where(F.abs(F.length("w") - len(text)) <= budget).select("id", F.levenshtein("w", F.lit(text.lower())).alias("d")).where(F.col("d") <= budget)
    return near.groupBy("id").agg(F.min("d").alias("distance")).orderBy("distance", "id").limit(depth)


def fuse(rankings: dict[str, DataFrame], k: int = FUSE, limit: int = 50) -> DataFrame:
    """(id, fused, rank of each ranking): sum of 1 / (k + rank) over rankings (id, rank) that returned the item."""
    out = None
    for name, df in rankings.items():
        r = df.select("id", F.col("rank").alias(name))
        out = r if out is None else out.join(r, "id", "full_outer")
    score = sum((F.coalesce(1.0 / (F.lit(k) + F.col(n)), F.lit(0.0)) for n in rankings), F.lit(0.0))
    return out.withColumn("fused", score).orderBy(F.col("fused").desc(), "id").limit(limit)


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds rank from 1; ``df`` is a ranker's bounded list."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hybrid(items: DataFrame, text: str, *, id: str = "id", mode: str = "hybrid", limit: int = 50) -> DataFrame:
    """Hits (id, fused, exact, typo) by mode ``hybrid``, ``exact`` or ``fuzzy``; a blank query has none."""
    if not text.strip():
        return items.select(F.col(id).alias("id"), F.lit(0.0).alias("fused")).limit(0)
    found = {}
    if mode != "fuzzy":
        found["exact"] = ranked(bm25(items, text, id=id), "bm25", "id")
    if mode != "exact":
        whole = items.withColumn("__text", F.concat_ws(" ", F.coalesce("title", F.lit("")), "body", "extra"))
        found["typo"] = ranked(fuzzy(whole, text, id=id, content="__text"), F.col("score").desc(), F.col("id"))
    return fuse(found, limit=limit)


def highlight_ranges(positions: Column) -> Column:
    """Consecutive positions folded to inclusive (first, last) ranges; ``positions`` ascending."""
    empty = F.array().cast("array<struct<first:int,last:int>>")
    return F.aggregate(
        positions,
        empty,
        lambda acc, p: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["last"] == p - 1), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), p.cast("int").alias("last"))))).otherwise(F.concat(acc, F.array(F.struct(p.cast("int").alias("first"), p.cast("int").alias("last"))))),
    )


__all__ = ["bigram_candidates", "bigrams", "bm25", "fuse", "fuzzy", "highlight_ranges", "hybrid", "porter", "porter_tokens", "postings", "ranked", "tokens", "typo_scores", "word_distance"]
