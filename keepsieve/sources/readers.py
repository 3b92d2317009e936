"""Readers: files and folders to the one item table, with rejects beside it.

Files are the unit of work: Spark lists and splits them over the cluster, a
parser reads each whole. ``paged_items`` follows a remote source's pages, whose
fetch is an injected callable.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsieve.plans.runtime import keep_table
from keepsieve.sources.parsers import FIELDS, parse_any

#: Pages of a remote source that the driver holds at once.
CHUNK = 200
LINK = "struct<original:string,resolved:string,kind:string,title:string>"
MEDIA = "struct<kind:string,url:string,preview_url:string>"
ITEM = f"medium string, external_id string, collection string, url string, author_handle string, author_name string, title string, summary string, body string, role string, created_ms bigint, tags array<string>, links array<{LINK}>, media array<{MEDIA}>, raw string"
#: Folders and files that a walk passes over.
SKIPPED = r"(^|/)(\.[^/]+|node_modules|target)(/|$)"


def read_files(spark: SparkSession, path: str, *, kind: str | None = None, medium: str | None = None, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of a file or folder.

    kind names the format, else each file is sniffed. items has the item
    columns and path; rejects (path, reason) has a row per record or file that
    couldn't be read. Dot files, node_modules and target are passed over; bytes
    that are no text are a reject.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    files = files.withColumn("plain", F.regexp_replace("path", r"^[a-z]+:/*", "/"))
    base = re.sub(r"^[a-z]+:/*", "/", path).rstrip("/")
    inside = F.when(F.col("plain").startswith(base), F.substring("plain", len(base) + 1, 10_000)).otherwise(F.col("plain"))
    files = files.where(~inside.rlike(SKIPPED)).select("plain", (F.unix_micros("modificationTime") / 1000).cast("bigint").alias("modified"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, modified, content in zip(pdf["plain"], pdf["modified"], pdf["content"], strict=True):
                try:
                    text = bytes(content).decode("utf-8-sig")
                    if "\x00" in text:
                        raise UnicodeError("holds NUL bytes")
                except UnicodeError as e:
                    rows.append({"path": p, "reason": f"not text: {e}"[:200]})
                    continue
                items, rejects = parse_any(p, text, int(modified), kind, medium)
                rows += [{"path": p} | i for i in items] + [{"path": p, "reason": r} for r in rejects]
            out = pd.DataFrame(rows, columns=["path", "reason", *FIELDS])
            out["created_ms"] = out["created_ms"].astype("Int64")
            yield out.astype(object).where(out.notna(), None).assign(created_ms=out["created_ms"])

    read = files.mapInPandas(run, f"path string, reason string, {ITEM}")
    return read.where("reason is null").drop("reason"), read.where("reason is not null").select("path", "reason")


def paged_items(spark: SparkSession, fetch: Callable[[str | None], tuple[str, str | None]], kind: str, max_pages: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of a source that hands out pages: fetch(cursor) gives (payload, next cursor).

    Stops at the end, or where a cursor comes again; more than ``max_pages``
    pages are an error. Payloads pass through the driver, which holds CHUNK of
    them at most: each chunk is written into the shared folder. Parsing is
    distributed.
    """
    pages, parts, cursor, known, n = [], [], None, {None}, 0
    schema = "path string, text string"
    while True:
        payload, following = fetch(cursor)
        pages.append((f"page-{n}", payload))
        n += 1
        if len(pages) == CHUNK:
            parts.append(keep_table(spark.createDataFrame(pages, schema)))
            pages = []
        if following in known:
            break
        if n == max_pages:
            raise ValueError(f"the source has more than {max_pages} pages")
        known.add(following)
        cursor = following
    frame = reduce(DataFrame.unionByName, [*parts, spark.createDataFrame(pages, schema)])
    return parse_texts(frame.repartition(max(1, min(n, spark.sparkContext.defaultParallelism))), kind)


def parse_texts(texts: DataFrame, kind: str, medium: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of payloads (path, text) of one format; null texts give neither."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, text in zip(pdf["path"], pdf["text"], strict=True):
                items, rejects = parse_any(p, text, None, kind, medium)
                rows += [{"path": p} | i for i in items] + [{"path": p, "reason": r} for r in rejects]
            out = pd.DataFrame(rows, columns=["path", "reason", *FIELDS])
            out["created_ms"] = out["created_ms"].astype("Int64")
            yield out.astype(object).where(out.notna(), None).assign(created_ms=out["created_ms"])

    read = texts.select("path", "text").where("text is not null").mapInPandas(run, f"path string, reason string, {ITEM}")
    return read.where("reason is null").drop("reason"), read.where("reason is not null").select("path", "reason")


def manual_items(spark: SparkSession, urls: list[str]) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of addresses given by hand; only http and https ones are taken."""
    return paged_items(spark, lambda c: ("\n".join(urls), None), "urls")


def oldest_first(items: DataFrame) -> DataFrame:
    """Items in the order of a folder import: by their date, undated ones last, then by identity."""
    return items.orderBy(F.col("created_ms").asc_nulls_last(), "medium", "external_id")


def of_medium(items: DataFrame, medium: str | None) -> DataFrame:
    """Items of one source only, or all where none is named."""
    return items if medium is None else items.where(F.col("medium") == medium)
