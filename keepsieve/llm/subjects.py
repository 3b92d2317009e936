"""Subjects of documents by mined class-association rules.

The sentences of a bounded sample of labelled documents become transactions of
words and a class item; parallel FP-growth finds the frequent sets, a set with
its class counts is a rule with one confidence per subject. Rules that say no
more than a part of them are pruned, which keeps a phrase apart from a word in
it ("pitch of the piano" from "pitch"). Held-out labelled documents calibrate
the evidence. Every document is then scored sentence by sentence, and gets the
subjects of at least a quarter of its sentences.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsieve.plans.runtime import keep_table, spread

#: Labelled documents used at most to fit the rules, chosen by the hash of their id.
SAMPLE_DOCS = 20_000
#: Sentences of one labelled document that take part in mining at most, so a long transcript isn't a class of its own.
SAMPLE_SENTENCES = 12
#: Held-out sentences that calibrate the evidence at most.
HELD_SENTENCES = 50_000
#: A set counts as frequent in this share of the sample's sentences, and in so many at least.
LEAST_SHARE, LEAST_COUNT = 0.0004, 4
#: Words in a rule at most; words in more than this share of sentences are left out.
LONGEST, COMMON = 3, 0.12
#: A longer rule stays if a confidence differs by this much from every rule it contains.
GAIN = 0.2
#: Share of a document's sentences that makes a subject its own.
SHARE = 0.25
_WORD = re.compile(r"[^\W\d_]{2,}")
_NOISE = re.compile(r"https?://\S+|www\.\S+|<[^<>]{1,200}>|\[\d+:\d+(?::\d+)?\]|[#@]\w+|^\s*\*\*\w+:\*\*|`{1,3}")
_STOP = re.compile(r"(?<=[.!?…。])[\"'”»)\]]*\s+|\n+|\s+[–—]\s+")
#: A piece without any stop is cut into windows of so many words.
LONG, WINDOW = 36, 14


def sentences(text: str | None) -> list[list[str]]:
    """Distinct lower-cased words of each sentence; sentences under four words don't count, unless there is no other."""
    if not text:
        return []
    plain = html.unescape(text).replace("\r", "\n") if "&" in text or "\r" in text else text
    out, short = [], []
    for piece in _STOP.split(_NOISE.sub(" ", plain)):
        words = _WORD.findall(piece.casefold())
        if len(words) > LONG:
            parts = max(2, round(len(words) / WINDOW))
            cuts = np.linspace(0, len(words), parts + 1).astype(int)
            out.extend(list(dict.fromkeys(words[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        elif len(words) >= 4:
            out.append(list(dict.fromkeys(words)))
        elif words:
            short.append(list(dict.fromkeys(words)))
    return out or short


def sentence_table(docs: DataFrame, id: str, text: str, extra: list[str] | None = None) -> DataFrame:
    """(id, extra…, items): one row per sentence."""
    extra = extra or []
    given = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"), *extra)
    types = dict(given.dtypes)
    schema = ", ".join(["id bigint", *(f"`{c}` {types[c]}" for c in extra), "items array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sentences(t) for t in batch.column(1).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(got)), [len(g) for g in got]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), *(c.take(rows) for c in batch.columns[2:]), pa.array([s for g in got for s in g], pa.list_(pa.string()))], names=["id", *extra, "items"])

    return spread(given).mapInArrow(run, schema)


def _member(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each key its place in the sorted array ``known``, or -1."""
    if len(known) == 0:
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)


def _later(owner: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry of ``owner``, place) for every place from ``first`` up to but not ``last`` of each entry."""
    counts = np.maximum(last - first, 0)
    which = np.repeat(owner, counts)
    ends = np.cumsum(counts)
    return which, np.arange(len(which)) - np.repeat(ends - counts, counts) + np.repeat(first, counts)


class Rules:
    """Mined rules: a word set to one confidence per subject; sent to the workers, bounded by the sample's size.

    Words are coded by rank; rules of two and three words are sorted arrays of
    combined codes, so a batch of sentences is matched by binary search.
    """

    def __init__(self, subjects: list[str], table: dict[frozenset, np.ndarray], prior: np.ndarray):
        self.subjects, self.table, self.prior = subjects, table, prior
        self.code = {w: i for i, w in enumerate(sorted({w for k in table for w in k}))}
        self.size = max(1, len(self.code))
        coded = {n: sorted((tuple(sorted(self.code[w] for w in k)), k) for k in table if len(k) == n) for n in (1, 2, 3)}
        self.values = {n: np.array([table[k] for _, k in coded[n]]).reshape(-1, len(subjects)) for n in coded}
        self.ones = np.array([c[0] for c, _ in coded[1]], np.int64)
        self.twos = np.array([a * self.size + b for (a, b), _ in coded[2]], np.int64)
        heads = np.array([a * self.size + b for (a, b, _), _ in coded[3]], np.int64)
        self.heads = np.unique(heads)
        self.threes = np.searchsorted(self.heads, heads) * self.size + np.array([c[2] for c, _ in coded[3]], np.int64)
        self.steps = (np.array([0.0]), np.array([0.0]))

    def evidence(self, found: list[list[str]]) -> np.ndarray:
        """[sentence, subject]: the highest confidence of the matching rules that no longer matching rule contains."""
        out = np.zeros((len(found), len(self.subjects)))
        code = self.code
        known = [[c for w in words if (c := code.get(w)) is not None] for words in found]
        counts = [len(k) for k in known]
        if not sum(counts):
            return out
        n = self.size
        # distinct words of each sentence, in the order of their codes
        both = np.unique(np.repeat(np.arange(len(found)), counts) * n + np.array([c for k in known for c in k], np.int64))
        sent, word = np.divmod(both, n)
        last = np.searchsorted(sent, sent, side="right")
        i, j = _later(np.arange(len(both)), np.arange(len(both)) + 1, last)
        pair = word[i] * n + word[j]
        head = _member(pair, self.heads)
        at = np.flatnonzero(head >= 0)
        p, k = _later(at, j[at] + 1, last[j[at]])
        three = _member(head[p] * n + word[k], self.threes)
        p, k, three = p[three >= 0], k[three >= 0], three[three >= 0]
        # places of words and pairs inside a longer rule that matches
        inside = np.zeros(len(both), bool)
        places = len(both)
        covered = np.unique(np.concatenate([i[p] * places + j[p], i[p] * places + k, j[p] * places + k]))
        inside[np.concatenate([i[p], j[p], k])] = True
        two = _member(pair, self.twos)
        hit = np.flatnonzero(two >= 0)
        hit = hit[_member(i[hit] * places + j[hit], covered) < 0]
        inside[i[hit]] = inside[j[hit]] = True
        one = _member(word, self.ones)
        single = np.flatnonzero((one >= 0) & ~inside)
        owner = np.concatenate([sent[i[p]], sent[i[hit]], sent[single]])
        if len(owner) == 0:
            return out
        value = np.concatenate([self.values[3][three], self.values[2][two[hit]], self.values[1][one[single]]])
        order = np.argsort(owner, kind="stable")
        owner = owner[order]
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        out[owner[starts]] = np.maximum.reduceat(value[order], starts)
        return out

    def calibrated(self, top: np.ndarray) -> np.ndarray:
        """Observed share of right sentences at evidence ``top``."""
        at = np.searchsorted(self.steps[0], top, side="right") - 1
        return np.where(at < 0, 0.0, self.steps[1][np.maximum(at, 0)])


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the best non-decreasing fit (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            start, mean, n = blocks.pop()
            low, prev, m = blocks.pop()
            blocks.append([low, (prev * m + mean * n) / (m + n), m + n])
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def mine_rules(docs: DataFrame, labels: DataFrame, subjects: list[str], *, id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_sentences: int = SAMPLE_SENTENCES, held_sentences: int = HELD_SENTENCES) -> Rules:
    """Fits rules on at most ``sample_docs`` labelled documents, ``sample_sentences`` of each; at most ``held_sentences`` calibrate them.

    Labels are matched to subjects without regard to case and outer blanks,
    unknown ones are ignored. A tenth of the sample calibrates the evidence.
    """
    clean = labels.select(F.col(id).cast("bigint").alias("id"), F.lower(F.trim("subject")).alias("subject")).where(F.col("subject").isin([s.lower() for s in subjects])).distinct()
    named = clean.groupBy("id").agg(F.sort_array(F.collect_set("subject")).alias("classes")).orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    sample = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).where("text is not null").join(named, "id")
    table = keep_table(sentence_table(sample, "id", "text", ["classes"]).withColumn("held", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(10)) == 0))
    order = Window.partitionBy("id").orderBy(F.xxhash64("items"))
    fit = table.where((F.size("classes") == 1) & ~F.col("held")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample_sentences)
    fit = fit.select("id", F.col("classes")[0].alias("c"), "items")
    n = fit.count()
    low = [s.lower() for s in subjects]
    if n == 0:
        return Rules(subjects, {}, np.full(len(subjects), 1 / max(1, len(subjects))))
    counts = fit.groupBy("c").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d")).toPandas().set_index("c")
    prior = np.array([counts["n"].get(s, 0) for s in low], float)
    words = fit.select("id", F.explode("items").alias("w")).groupBy("w").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"))
    least = max(LEAST_COUNT, int(LEAST_SHARE * n))
    # a word of one document alone (an invented name) is no evidence
    usable = words.where((F.col("n") >= least) & (F.col("n") <= max(least, COMMON * n)) & (F.col("d") >= 3)).select("w")
    numbered = fit.withColumn("row", F.monotonically_increasing_id())
    kept = keep_table(numbered.select("row", "c", F.explode("items").alias("w")).join(usable, "w").groupBy("row", "c").agg(F.collect_set("w").alias("ws")))
    baskets = kept.select(F.array_append("ws", F.concat(F.lit("class="), "c")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least / max(1, n), minConfidence=0.9, numPartitions=max(4, docs.sparkSession.sparkContext.defaultParallelism)).fit(baskets)
    frequent = model.freqItemsets.where(F.size("items") <= LONGEST + 1)
    split = frequent.select(
        F.filter("items", lambda x: x.startswith("class=")).alias("cs"), F.sort_array(F.filter("items", lambda x: ~x.startswith("class="))).alias("ws"), F.col("freq").cast("double").alias("freq")
    ).where((F.size("ws") > 0) & (F.size("ws") <= LONGEST) & (F.size("cs") <= 1))
    mined = split.groupBy("ws").agg(F.max(F.when(F.size("cs") == 0, F.col("freq"))).alias("n"), F.map_from_entries(F.collect_list(F.when(F.size("cs") == 1, F.struct(F.substring(F.col("cs")[0], 7, 100), "freq")))).alias("by")).where("n is not null").toPandas()
    share = (prior + 1) / (prior.sum() + len(prior))
    place = {s: i for i, s in enumerate(low)}
    everything: dict[frozenset, np.ndarray] = {}
    for ws, total, by in zip(mined["ws"], mined["n"], mined["by"], strict=True):
        v = np.zeros(len(low))
        for c, k in (by or {}).items():
            v[place[c]] = k
        everything[frozenset(ws)] = (v + 2 * share) / (total + 2)
    rules: dict[frozenset, np.ndarray] = {}
    for s in sorted(everything, key=len):
        parts = [rules[p] for size in range(1, len(s)) for c in combinations(s, size) if (p := frozenset(c)) in rules]
        v = everything[s]
        if not parts or min(np.abs(v - p).max() for p in parts) >= GAIN and v.max() >= max(p.max() for p in parts) + GAIN or (parts and v.max() <= max(p.max() for p in parts) - GAIN):
            rules[s] = v
    out = Rules(subjects, rules, share)
    held = table.where("held").select("classes", "items").orderBy(F.xxhash64("items"), "items").limit(held_sentences).toPandas()
    shown = out.evidence([list(x) for x in held["items"]])
    some = np.flatnonzero(shown.max(axis=1, initial=0) > 0)
    tops = shown[some].max(axis=1, initial=0)
    right = [low[k] in held["classes"].iloc[i] for i, k in zip(some, shown[some].argmax(axis=1), strict=True)] if len(some) else []
    if len(tops) >= 50:
        out.steps = _isotonic(tops, np.array(right, float))
    else:
        out.steps = np.array([0.0, 0.3, 0.5]), np.array([0.1, 0.4, 0.8])
    return out


#: A sentence counts for its best subject from this confidence on, before and after calibration.
SURE = 0.5


def subject_shares(docs: DataFrame, rules: Rules, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, subject, share, n_sentences): share of each document's sentences about each subject.

    Every document gets a row: one whose sentences name no subject gets the one
    with the most evidence, or the most frequent subject where there is none
    (null and empty texts). Repeated ids are scored row by row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(rules)  # bounded by the sample, not by the corpus

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = sent.value
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                found = [sentences(body) for body in part["text"]]
                counts = np.array([len(f) for f in found], np.int64)
                e = r.evidence([words for f in found for words in f])
                owner = np.repeat(np.arange(len(part)), counts)
                best, top = e.argmax(axis=1) if len(e) else np.zeros(0, int), e.max(axis=1, initial=0)
                sure = (r.calibrated(top) >= SURE) & (top >= SURE)
                share = np.zeros((len(part), len(r.subjects)))
                np.add.at(share, (owner[sure], best[sure]), 1)
                share /= np.maximum(counts, 1)[:, None]
                none = np.flatnonzero(~share.any(axis=1))
                total = np.zeros_like(share)
                np.add.at(total, owner, e)
                share[none, np.where(total[none].any(axis=1), total[none].argmax(axis=1), int(r.prior.argmax()))] = 1e-9
                doc, subject = np.nonzero(share)
                yield pd.DataFrame({"id": part["id"].to_numpy()[doc], "subject": np.array(r.subjects, dtype=object)[subject], "share": share[doc, subject], "n_sentences": counts[doc].astype(np.int32)})

    given = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return spread(given).mapInPandas(run, "id bigint, subject string, share double, n_sentences int")


#: Subjects at most: each rule holds a confidence for every one.
MOST_SUBJECTS = 1000


def document_subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame, *, id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_sentences: int = SAMPLE_SENTENCES, held_sentences: int = HELD_SENTENCES) -> DataFrame:
    """(id, subject): the subjects of at least a quarter of a document's sentences, or else its strongest one.

    The bounds of the labelled sample are those of ``mine_rules``. More than
    MOST_SUBJECTS subjects are an error; without any there is no row.
    """
    names = sorted(r["subject"] for r in areas.select("subject").where("subject is not null").distinct().limit(MOST_SUBJECTS + 1).collect())
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    if not names:
        return docs.select(F.col(id).cast("bigint").alias("id"), F.lit("").alias("subject")).limit(0)
    rules = mine_rules(docs, labels, names, id=id, text=text, sample_docs=sample_docs, sample_sentences=sample_sentences, held_sentences=held_sentences)
    shares = keep_table(subject_shares(docs, rules, id=id, text=text))
    best = shares.groupBy("id").agg(F.max_by("subject", F.struct("share", "subject")).alias("subject"))
    return shares.where(F.col("share") >= SHARE).select("id", "subject").union(best.select("id", "subject")).distinct()
