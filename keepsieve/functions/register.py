"""The library's functions under SQL names: scalar functions, a file table function, and a paged data source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from keepsieve.functions.pages import block_score, read_body
from keepsieve.functions.similarity import jaro_winkler_of
from keepsieve.functions.urls import HOST_PATTERN, PATH_PATTERN, kind_sql
from keepsieve.operators.fingerprints import simhash_udf
from keepsieve.operators.index import pair_codes
from keepsieve.operators.search import best_matches, porter
from keepsieve.sources import parsers
from keepsieve.sources.readers import ITEM


def _per_row(kind: str, of):
    """A function of one text, called once for each distinct text of a batch."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            codes, names = pd.factorize(b, use_na_sentinel=True)
            found = pd.Series([*map(of, names), None], dtype="float64" if kind == "double" else object)
            yield found.iloc[codes].reset_index(drop=True)

    return run


def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _fuzzy(texts: pd.Series, query: pd.Series) -> pd.Series:
    """Score of the best occurrence of each query in its text; null above its budget of edits or for nulls."""
    out = pd.Series([None] * len(texts), dtype="float64")
    for needle, rows in query.groupby(query).groups.items():
        out.loc[rows] = best_matches(texts.loc[rows].reset_index(drop=True), needle)["score"].to_numpy()
    return out.where(texts.notna())


def _bigrams(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [chr(c // 256) + chr(c % 256) for c in pair_codes(t)] for t in texts], dtype=object)


class ParseFile:
    """Rows of one file's content: LATERAL parse_file(path, text)."""

    def eval(self, path: str, text: str):
        items, rejects = parsers.parse_any(path or "", text or "")
        names = parsers.FIELDS
        for i in items:
            yield (path, None, *[i[n] for n in names])
        for r in rejects:
            yield (path, r, *[None] * len(names))


def _located(path: str):
    """(file system, path in it) of an address of any file system that Arrow knows; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class _Pages(DataSourceReader):
    def __init__(self, options):
        self.folder, self.kind = options["path"], options.get("kind", "hackernews")

    def partitions(self):
        from pyarrow import fs

        source, path = _located(self.folder)
        listed = source.get_file_info(fs.FileSelector(path))
        prefix = self.folder.rstrip("/")
        return [InputPartition(f"{prefix}/{x.base_name}") for x in sorted(listed, key=lambda x: x.base_name) if x.is_file and x.base_name[:1] not in "._"]

    def read(self, partition):
        if partition is None:
            return
        source, path = _located(partition.value)
        with source.open_input_stream(path) as f:
            items, _ = parsers.parse_any(partition.value, f.read().decode("utf-8"), None, self.kind)
        for i in items:
            yield tuple([dict(x) for x in i[n]] if n in ("links", "media") else i[n] for n in parsers.FIELDS)


class ArchivedPages(DataSource):
    """Data source over a folder of archived API payloads: one partition per payload."""

    @classmethod
    def name(cls) -> str:
        return "archived_pages"

    def schema(self) -> str:
        return "medium string, external_id string, collection string, url string, author_handle string, author_name string, title string, summary string, body string, role string, created_ms bigint, tags array<string>, links array<map<string,string>>, media array<map<string,string>>, raw string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options)


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL: url_host, url_kind, url_canonical, url_key, stem, read_article, block_score,
    jaro_winkler, fuzzy_score, simhash64, bigrams, parse_file."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION url_host(u STRING) RETURNS STRING RETURN regexp_replace(lower(regexp_extract(u, r'{HOST_PATTERN}', 1)), r'^(www\\.)+', '')")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION url_path(u STRING) RETURNS STRING RETURN lower(regexp_extract(u, r'{PATH_PATTERN}', 1))")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION url_kind(u STRING) RETURNS STRING RETURN {kind_sql('url_host(u)', 'url_path(u)')}")
    spark.udf.register("url_canonical", _per_row("string", parsers.canonical))
    spark.udf.register("fuzzy_score", F.pandas_udf(_fuzzy, "double"))
    spark.udf.register("simhash64", simhash_udf())
    spark.udf.register("bigrams", F.pandas_udf(_bigrams, "array<string>"))
    spark.udf.register("stem", _per_row("string", porter))
    spark.udf.register("read_article", _per_row("string", read_body))
    spark.udf.register("block_score", _per_row("double", block_score))
    spark.udf.register("url_key", _per_row("string", parsers.key_of))
    spark.udf.register("jaro_winkler", F.pandas_udf(_jaro_winkler, "double"))
    spark.udtf.register("parse_file", udtf(ParseFile, returnType=f"path string, reason string, {ITEM}"))
    spark.dataSource.register(ArchivedPages)
