"""Near-duplicate texts by DartMinHash signatures and banded joining.

Darts are thrown into the plane (weight, rank) of every element by a hash: one
Poisson process per element and weight layer. A document takes the darts that
fall below its element's weight, and keeps for each of K coordinates the dart
of lowest rank. Two documents agree in a coordinate with probability equal to
their weighted Jaccard similarity. A document throws about K (ln K + 3) darts,
however many elements it has.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsieve.operators.components import components
from keepsieve.plans.runtime import keep_table

#: Coordinates in a band, and bands: pairs of similarity 0.5 meet with 0.955, of 0.55 with 0.99, of 0.6 with 0.998, of 0.1 with 0.005.
ROWS, BANDS = 4, 48
#: Documents whose darts are thrown at once.
CHUNK = 1024
_WORD = re.compile(r"[^\W_]+")
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public-domain constants of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def dart_signatures(elements: np.ndarray, weights: np.ndarray, docs: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """[n_docs, k] signature of weighted sets given as (element hash, weight, document) triples; no triple twice.

    Documents without elements get a row of zeros. The value of a coordinate is
    the lowest rank rounded to 32 bits, so a last-bit difference of ``log``
    between machines doesn't show.
    """
    out = np.zeros((n_docs, k), np.uint32)
    if len(elements) == 0:
        return out
    # weight layers [0,1) [1,2) [2,4) …: a region is (element, layer), its darts are kept below the weight
    region, width, below, owner, base = [], [], [], [], []
    layer, lo, hi = 0, 0.0, 1.0
    todo = np.arange(len(elements))
    while len(todo):
        region.append(_mix(elements[todo].astype(_U) + np.array([layer], _U) * _U(0x9E3779B97F4A7C15)))
        width.append(np.full(len(todo), hi - lo))
        below.append(np.minimum(weights[todo], hi))
        owner.append(docs[todo])
        base.append(np.full(len(todo), lo))
        todo = todo[weights[todo] > hi]
        layer, lo, hi = layer + 1, hi, hi * 2
    region, width, below, owner, base = (np.concatenate(x) for x in (region, width, below, owner, base))
    total = np.bincount(docs, weights=weights, minlength=n_docs)
    limit = np.zeros(n_docs)
    np.divide(np.log(k) + 3.0, total, out=limit, where=total > 0)
    best = np.full(n_docs * k, np.inf)
    rank = np.zeros(len(region))
    throw = np.zeros(len(region), np.int64)

    def throw_on(alive: np.ndarray, fresh: bool) -> np.ndarray:
        """Darts of these regions up to the limits; returns the regions, each with its next dart beyond the limit."""
        beyond = []
        while len(alive):
            h = _mix(region[alive] + (2 * throw[alive] + 1).astype(_U) * _U(0xD1B54A32D192ED03))
            if fresh:
                rank[alive] += -np.log(((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (k * width[alive])
            fresh = True
            fits = rank[alive] < limit[owner[alive]]
            beyond.append(alive[~fits])
            alive, h = alive[fits], h[fits]
            place = _mix(h ^ _U(0xA0761D6478BD642F))
            coord = (place & _U(0xFFFFFFFF)) * _U(k) >> _U(32)
            where = base[alive] + (place >> _U(32)).astype(np.float64) * 2.0**-32 * width[alive]
            inside = where < below[alive]
            hit = alive[inside]
            np.minimum.at(best, owner[hit] * k + coord[inside].astype(np.int64), rank[hit])
            throw[alive] += 1
        return np.concatenate(beyond) if beyond else alive

    waiting = throw_on(np.arange(len(region)), True)
    while (empty := np.isinf(best).reshape(n_docs, k).any(axis=1) & (total > 0)).any():
        # a few documents have a coordinate without dart: their limit doubles and their regions go on,
        # from the dart that is already ranked but lay beyond the old limit
        limit[empty] *= 2
        again = empty[owner[waiting]]
        waiting = np.concatenate((waiting[~again], throw_on(waiting[again], False)))
    sig = best.reshape(n_docs, k).astype(np.float32).view(np.uint32)
    return np.where(total[:, None] > 0, sig, out)


def shingle_sets(texts: list[str | None], words: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count) of each distinct word sequence, sorted by both; texts under ``least`` words have none."""
    docs, flat, sizes = [], [], []
    for i, text in enumerate(texts):
        found = _WORD.findall(text.lower()) if text else ()
        if len(found) >= max(least, words):
            docs.append(i)
            sizes.append(len(found))
            flat.extend(found)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    codes, names = pd.factorize(np.array(flat, dtype=object))
    word = pd.util.hash_array(np.asarray(names, dtype=object), categorize=False)[codes]
    owner = np.repeat(np.array(docs), sizes)
    h = np.zeros(len(word) - words + 1, _U)
    for j in range(words):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + word[j : len(word) - words + 1 + j])
    whole = owner[: len(h)] == owner[words - 1 :]
    own, h = owner[: len(h)][whole], h[whole]
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1])
    return own[new], h[new], np.diff(np.append(np.flatnonzero(new), len(h)))


def sketches(texts: DataFrame, *, words: int, least: int, rows: int = ROWS, bands: int = BANDS, counted: bool = False) -> DataFrame:
    """(id, text, bits, bands) of each of ``texts`` (id, text) with at least ``least`` words.

    bits holds one bit per coordinate of the signature, bands one 32-bit hash
    per band: chance meetings of such hashes are rarer than those of unlike texts.
    """
    k = rows * bands
    schema = "id bigint, text string, bits array<bigint>, bands array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                own, h, times = shingle_sets(part.column(1).to_pylist(), words, least)
                kept, dense = np.unique(own, return_inverse=True)
                if len(kept) == 0:
                    continue
                sig = dart_signatures(h, times.astype(float) if counted else np.ones(len(h)), dense, len(kept), k)
                joined = np.zeros((len(kept), bands), _U)
                for r in range(rows):
                    joined = _mix(joined * _U(0x9E3779B97F4A7C15) + sig[:, r::rows].astype(_U) + _U(1))
                joined = _mix(joined + np.arange(bands, dtype=_U)[None, :] * _U(0xD1B54A32D192ED03))
                flags = np.zeros((len(kept), -(-k // 64) * 64), np.uint8)
                flags[:, :k] = _mix(sig.astype(_U)) & _U(1)
                bits = np.packbits(flags, axis=1).view(np.int64)
                taken = pa.array(kept)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(taken),
                        part.column(1).take(taken),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, bits.size + 1, bits.shape[1], dtype=np.int32)), pa.array(bits.ravel())),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(kept) * bands + 1, bands, dtype=np.int32)), pa.array((joined >> _U(32)).astype(np.uint32).view(np.int32).ravel())),
                    ],
                    names=["id", "text", "bits", "bands"],
                )

    return texts.mapInArrow(run, schema)


def _similarity(words: int, counted: bool):
    """Exact Jaccard similarity of the sets of word sequences of two texts, or of their counts."""

    @F.pandas_udf("double")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            sets: dict[str, set | Counter] = {}
            for text in {*left, *right}:
                w = _WORD.findall(text.lower())
                sets[text] = (Counter if counted else set)(zip(*(w[j:] for j in range(words)), strict=False))
            size = (lambda s: s.total()) if counted else len
            yield pd.Series([size(sets[x] & sets[y]) / max(1, size(sets[x] | sets[y])) for x, y in zip(left, right, strict=True)], dtype="float64")

    return of


def near_copies(texts: DataFrame, *, id: str, text: str, words: int = 5, least: int = 0, threshold: float = 0.8, rows: int = ROWS, bands: int = BANDS, counted: bool = False, sketch: bool = True) -> tuple[DataFrame, DataFrame]:
    """(members, links): every compared text with its class of equal texts, and links between classes.

    members (id, rep): rep is the smallest id with the same text. links (a, b,
    similarity), a < b: class representatives whose sets of distinct word
    sequences have a Jaccard similarity of at least ``threshold``, checked
    exactly on the texts. Texts with fewer than ``least`` words (or than
    ``words``) take no part; null ids or texts neither. An id that comes with
    several texts is a member of several classes. Empty tables give empty
    results; other columns are ignored. With ``counted`` a word sequence weighs
    as often as it occurs: the similarity is the sum of the smaller counts over
    that of the larger ones.

    Only pairs that meet in a band are compared: with the default bands one of
    similarity 0.5 is missed with 0.045, of 0.55 with 0.01, of 0.8 with less
    than a billionth. ``sketch`` drops pairs whose one-bit sketches differ too
    much before any text is moved, and with them less than one in a thousand of
    the pairs at the threshold; without it every pair that meets is checked.
    """
    given = texts.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    given = given.select("id", "text", F.xxhash64("text").alias("key1"), F.hash("text").alias("key2"))
    # copies meet before anything is computed on them; partial aggregation leaves one per task
    classes = given.groupBy("key1", "key2").agg(F.min_by("text", "id").alias("text"), F.min("id").alias("rep"))
    reps = keep_table(sketches(classes.select("rep", "text"), words=words, least=least, rows=rows, bands=bands, counted=counted))
    owners = given.groupBy("key1", "key2").agg(F.min("id").alias("rep"))
    members = given.select("id", "key1", "key2").join(owners, ["key1", "key2"]).select("id", "rep").distinct()
    members = members.join(reps.select(F.col("id").alias("rep")), "rep", "left_semi").select("id", "rep")
    keyed = reps.select("id", F.explode("bands").alias("band"))
    shared = keyed.alias("x").join(keyed.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.id") < F.col("y.id")))
    pairs = shared.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    # one bit per coordinate tells chance meetings from copies before any text is moved;
    # a pair at the threshold falls below the mark with less than one in a thousand
    k = rows * bands
    agree = (1 + threshold) / 2
    mark = k * agree - 3.3 * (k * agree * (1 - agree)) ** 0.5
    bits = reps.select("id", "bits")
    differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    met = pairs.join(bits.select(F.col("id").alias("a"), F.col("bits").alias("bits_a")), "a").join(bits.select(F.col("id").alias("b"), F.col("bits").alias("bits_b")), "b")
    likely = met.where(F.lit(k) - differ >= mark).select("a", "b") if sketch else pairs
    bodies = reps.select("id", "text")
    both = likely.join(bodies.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(bodies.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    links = both.select("a", "b", _similarity(words, counted)("text_a", "text_b").alias("similarity")).where(F.col("similarity") >= threshold)
    return members, keep_table(links)


def copy_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs (a < b) of ids that a link or a shared class joins."""
    m = members.alias("m")
    within = m.join(members.alias("o"), (F.col("m.rep") == F.col("o.rep")) & (F.col("m.id") < F.col("o.id"))).select(F.col("m.id").alias("a"), F.col("o.id").alias("b"))
    first = links.select("a", "b").join(members.select(F.col("rep").alias("a"), F.col("id").alias("ia")), "a")
    across = first.join(members.select(F.col("rep").alias("b"), F.col("id").alias("ib")), "b").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
    return within.union(across).where("a < b").distinct()


def copy_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, group, links): every compared text with the smallest id of its group and its class's number of links."""
    joined = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    grouped = members.join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left").join(degree, "rep", "left")
    return grouped.groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("group"), F.sum(F.coalesce("links", F.lit(0))).alias("links"))
