"""A search index kept in the shared folder: postings of terms and of character pairs, keyed by the archive's stamp.

Postings hold what a score needs (weighted count and length of the item), so a
query reads the rows of its own terms only: they are dealt to buckets by a
digest of the term, which prunes folders, and sorted within, which prunes row
groups. A bucket is dealt to several files by item, so a term of a third of all
items is no single task's. An index is built once for a stamp (number of items
and newest change) and reused until the stamp changes.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsieve.functions.texts import query_terms
from keepsieve.operators.search import DEPTH, FUSE, IDF_FLOOR, K1, WEIGHTS, B, fuse, postings, ranked, tokens, typo_scores
from keepsieve.plans.runtime import parts_of, shared_dir, spread

#: Bytes of the items' files for a bucket of postings, about, and files of a bucket.
BUCKET_BYTES, FILES = 4 << 20, 4


_SCHEMAS = {"terms": "term string, id bigint, dl int, weighted double, tf bigint, bucket int", "pairs": "id bigint, pair int, bucket int", "texts": "id bigint, text string"}


def _term_bucket(term: str, n: int) -> int:
    return int(hashlib.md5(term.encode()).hexdigest()[:6], 16) % n


def pair_codes(text: str) -> list[int]:
    """Codes of the distinct pairs of neighbouring printable ASCII characters of a text, lower-cased."""
    raw = np.frombuffer(text.encode(errors="replace"), np.uint8).astype(np.int32)
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    good = (raw >= 32) & (raw <= 126)
    return np.unique((raw[:-1] * 256 + raw[1:])[good[:-1] & good[1:]]).tolist() if len(raw) > 1 else []


class SearchIndex:
    """Postings of one table of items; see :func:`open_index`."""

    def __init__(self, spark: SparkSession, path: str, facts: dict):
        self.spark, self.path, self.facts = spark, path, facts

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def _postings(self, terms: list[str]) -> DataFrame:
        buckets = sorted({_term_bucket(t, self.facts["buckets"]) for t in terms})
        return self._table("terms").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def bm25(self, text: str, *, depth: int = DEPTH, terms: list[str] | None = None) -> DataFrame:
        """(id, bm25, matched) of the best ``depth`` items; lower is better, ties by id.

        An item must hold all terms of the query; if none does, any term will do.
        A query without a term of two characters is looked up whole.
        """
        terms = terms if terms is not None else list(dict.fromkeys(query_terms(text))) or [t for t in [text.strip().lower()] if t]
        if not terms:
            return self.spark.createDataFrame([], "id bigint, bm25 double, matched int")
        rows = self._postings(terms)
        n, mean = self.facts["items"], self.facts["mean"]
        known = rows.groupBy("term").agg(F.count("*").alias("df"))  # a row a term of the query
        idf = F.greatest(F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
        w = F.col("weighted")
        part = idf * (w * (K1 + 1)) / (w + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
        out = rows.join(F.broadcast(known), "term").select("id", part.alias("s")).groupBy("id").agg((-F.sum("s")).alias("bm25"), F.count("*").cast("int").alias("matched"))
        if len(terms) > 1:
            most = out.agg(F.max("matched").alias("__most"))
            out = out.crossJoin(F.broadcast(most)).where((F.col("matched") == len(terms)) | (F.col("__most") < len(terms)))  # most is one row
        return out.select("id", "bm25", "matched").orderBy("bm25", "id").limit(depth)

    def candidates(self, text: str, *, every: bool = False, edits: int | None = None) -> DataFrame:
        """(id) of items that share a pair of characters with the query, every pair that occurs at all, or enough for ``edits``."""
        wanted = pair_codes(text)
        if not wanted:
            return self.spark.createDataFrame([], "id bigint")
        rows = self._table("pairs").where(F.col("bucket").isin(sorted({c % self.facts["buckets"] for c in wanted})) & F.col("pair").isin(wanted))
        held = rows.groupBy("id").agg(F.count("*").alias("k"))
        if every:
            known = rows.agg(F.count_distinct("pair").alias("most"))  # one row
            return held.join(F.broadcast(known)).where("k = most").select("id")
        # an edit spoils two pairs at most
        return held.where(F.col("k") >= (1 if edits is None else max(1, len(wanted) - 2 * edits))).select("id")

    def fuzzy(self, text: str, *, depth: int = DEPTH) -> DataFrame:
        """(id, score, first, last) of items that hold the query up to its budget of typos, best first."""
        pool = self._table("texts").join(self.candidates(text, edits=max(1, len(text) // 4)), "id", "left_semi")
        hit = spread(pool).select("id", typo_scores(F.col("text"), text).alias("x")).where("x.score is not null and not isnan(x.score)")
        return hit.select("id", "x.score", "x.first", "x.last").orderBy(F.col("score").desc(), "id").limit(depth)

    def search(self, text: str, *, mode: str = "hybrid", offset: int = 0, limit: int = 50) -> DataFrame:
        """(id, rank of each ranker, fused): one page of hits by mode ``hybrid``, ``exact`` or ``fuzzy``; the offset counts fused hits."""
        if not text.strip():
            return self.spark.createDataFrame([], "id bigint, fused double")
        found: dict[str, DataFrame] = {}
        if mode != "fuzzy":
            found["exact"] = ranked(self.bm25(text), "bm25", "id")
        if mode != "exact":
            found["typo"] = ranked(self.fuzzy(text), F.col("score").desc(), F.col("id"))
        return fuse(found, k=FUSE, limit=offset + limit).offset(offset).limit(limit)


def with_ranks(items: DataFrame, hits: DataFrame, *order: Column | str) -> DataFrame:
    """Items of the hits (id, scores) with rank and scores, in order of rank; ids that no item has are dropped. ``hits`` is one page."""
    return items.join(ranked(hits, *order), "id").orderBy("rank")


def open_index(items: DataFrame, name: str, *, id: str = "id", fields: dict[str, str] | None = None, changed: str | None = "ingested_at", analyzer=tokens) -> SearchIndex:
    """The index of ``items`` under a name; built if there is none for their stamp (number, newest ``changed``)."""
    spark = items.sparkSession
    fields = fields or {k: k for k in WEIGHTS}
    newest = F.max(changed).cast("string") if changed else F.lit("")
    stamp = items.agg(F.count("*").alias("n"), newest.alias("newest")).first()
    key = hashlib.sha256(json.dumps([name, id, fields, stamp["n"], stamp["newest"], analyzer.__name__]).encode()).hexdigest()[:24]
    path = f"{shared_dir(spark).rstrip('/')}/search-{key}"
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at(f"{path}/facts")):
        return SearchIndex(spark, path, json.loads(spark.read.text(f"{path}/facts").first()["value"]))
    made = f"{path}-{uuid.uuid4().hex}"
    given = items.select(F.col(id).cast("bigint").alias("id"), *[F.col(c).alias(c) for c in dict.fromkeys(fields.values())])
    buckets = parts_of(given, BUCKET_BYTES)
    write = lambda df, table, by, order: df.repartition(buckets * FILES if buckets > 8 else buckets, by, F.pmod(F.hash("id"), F.lit(FILES if buckets > 8 else 1))).sortWithinPartitions(by, order).write.partitionBy(by).option("compression", "zstd").parquet(f"{made}/{table}")
    # the length goes with every posting, so no other table is read to score it
    length = sum((F.size(analyzer(F.col(c))) for c in fields.values()), F.lit(0))
    rows = postings(given.withColumn("id", F.struct("id", length.alias("dl"))), id="id", fields=fields, analyzer=analyzer)
    flat = rows.select("term", F.col("id.id").alias("id"), F.col("id.dl").alias("dl"), "weighted", "tf", F.pmod(F.conv(F.substring(F.md5("term"), 1, 6), 16, 10).cast("int"), F.lit(buckets)).alias("bucket"))
    write(flat, "terms", "bucket", "term")
    whole = spread(given.select("id", F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields.values()]).alias("text")))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                found = [pair_codes(t or "") for t in part.column(1).to_pylist()]
                owner = np.repeat(np.arange(part.num_rows), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array([c for f in found for c in f], pa.int32())], names=["id", "pair"])

    write(whole.mapInArrow(pairs, "id bigint, pair int").withColumn("bucket", F.pmod("pair", F.lit(buckets))), "pairs", "bucket", "pair")
    whole.write.option("compression", "zstd").parquet(f"{made}/texts")
    mean = given.agg(F.avg(length).alias("m")).first()["m"]
    facts = {"items": stamp["n"], "mean": mean or 1.0, "buckets": buckets}
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.text(f"{made}/facts")
    if not fs.rename(at(made), at(path)) and not fs.exists(at(f"{path}/facts")):
        raise OSError("the index could not be put in place")
    return SearchIndex(spark, path, facts)
