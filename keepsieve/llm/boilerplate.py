"""Main body of saved pages: host suffix arrays over page token streams.

The tokens of a page are its masked lines (site name, numbers, dates and
addresses replaced by marks), rows of labels cut into their labels, since menus
come in any order. The streams of the pages of a host, or of a pool of small
hosts, are concatenated in blocks; a suffix array with common-prefix lengths
gives the runs repeated across distinct pages. What the blocks find is added up
per host. A repeated token is furniture of its host if it stands on many
distinct pages there, of different sections where the host has them, and
rarely between lines of the article, where its headings and bylines stand; or
if what follows it is hardly ever of the page's own topic, as under a heading
over other articles. A token of many hosts is furniture on hosts of few pages
too. No list of phrases takes part. Runs that stay unique are the main body.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsieve.llm.pagelines import CODE, DOUBTFUL, ITEM, MARK_FURNITURE, MARK_HEAD, MARK_MESSAGE, OWN_TOPIC, PARAGRAPH, RESIDUE, describe_pages, judge_pages
from keepsieve.plans.runtime import keep_table, spread

#: Pages in one suffix array, and hosts below this number of pages share pools.
BLOCK_PAGES, POOL_BELOW = 4096, 16
#: A furniture line stands on at least so many pages of its host (fewer on a host of few), at most such a share of them in one section or amid text.
LEAST_PAGES, MOST_IN_SECTION, MOST_AMID = 8, 0.5, 0.4
#: Pages expected in other sections from which on their lack tells.
LEAST_EXPECTED = 2
#: A line of so many hosts is furniture on all, but on those where at least so many pages, most of them amid text, speak against it.
MANY_HOSTS, LEAST_AGAINST = 8, 3
#: Such a share of a host's pages amid text speaks against many hosts, and up to such a share its own pages stand against many hosts where a line is amid text.
AGAINST, DESPITE = 0.75, 0.1
#: A heading over other articles is followed by a single unique line on at least such a share of its pages, and by the page's own topic or a paragraph on at most such a share.
LEAST_FOLLOWED, MOST_FOLLOWED_OWN = 0.5, 0.15
#: Words of a line of the article at least, if nothing else tells it.
PROSE_WORDS = 6
#: Depth to which suffixes are ordered, in lines.
DEPTH = 16


def repeated_runs(tokens: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """For each position of concatenated streams, lines of the longest run from there that another page has too.

    Builds the suffix array by prefix doubling up to DEPTH tokens. ``tokens``
    are non-negative; a run never crosses the end of a page.
    """
    n = len(tokens)
    if n == 0:
        return np.zeros(0, np.int64)
    _, rank = np.unique(tokens, return_inverse=True)
    left = np.searchsorted(pages, pages, side="right") - np.arange(n)  # tokens up to the end of the page
    levels, span = [rank], 1
    while span < DEPTH:
        key = levels[-1].astype(np.int64) * (n + 1)
        ahead = np.arange(n) + span
        inside = left > span
        key[inside] += levels[-1][ahead[inside]] + 1
        _, nxt = np.unique(key, return_inverse=True)
        levels.append(nxt)
        span *= 2
    order = np.lexsort((pages, levels[-1]))
    a, b = order[:-1], order[1:]
    common, pos_a, pos_b, alive = np.zeros(n - 1, np.int64), a.copy(), b.copy(), np.ones(n - 1, bool)
    for i in range(len(levels) - 1, -1, -1):
        width = 1 << i
        ok = alive & (pos_a < n) & (pos_b < n)
        ok[ok] = (left[pos_a[ok]] >= width) & (left[pos_b[ok]] >= width) & (common[ok] < left[a[ok]]) & (common[ok] < left[b[ok]])
        ok[ok] = levels[i][pos_a[ok]] == levels[i][pos_b[ok]]
        common[ok] += width
        pos_a[ok] += width
        pos_b[ok] += width
    # the nearest suffix of another page in either direction decides; equal pages pass their bound on
    best = np.zeros(n, np.int64)
    other = pages[a] != pages[b]
    for direction in (1, -1):
        step = common[::direction]
        apart = other[::direction]
        # running minimum since the last neighbour of another page: earlier segments lie above by a multiple of 64
        segment = np.cumsum(apart)
        near = np.minimum.accumulate(step - segment * 64) + segment * 64
        near = np.where(segment == 0, 0, near)[::direction]
        np.maximum.at(best, b if direction == 1 else a, near)
    return best


def _copy_key(lines: np.ndarray, kinds: np.ndarray, sizes: np.ndarray) -> int:
    """Stands for the three longest lines that are the article's own by their shape or topic; for all lines where there is none."""
    own = np.flatnonzero(((kinds & OWN_TOPIC) > 0) | ((kinds & 15) == PARAGRAPH))
    if len(own) == 0:
        return hash(tuple(lines.tolist()))
    return hash(tuple(lines[own[np.lexsort((lines[own], -sizes[own].astype(int)))[:3]]].tolist()))


def page_streams(links: DataFrame, *, url: str, body: str, keys: list[str]) -> DataFrame:
    """One row per distinct page: keys, host, section, copy (stands for its longest own lines), and arrays of its tokens.

    Pages without body or with blanks only have no row; whole repeated rows give
    one. A token is a line that isn't blank, or a label of a row: lines holds
    the hashes of the masked tokens, at the numbers of their lines, kinds the
    classes and sizes the words of these lines.
    """
    names = [*keys, "host", "section", "copy", "lines", "at", "kinds", "sizes"]
    # rows with the same keys but another body are pages of their own
    given = links.select(*keys, F.col(url).alias("__url"), F.col(body).alias("__body")).where(F.col(body).isNotNull() & F.col(body).rlike(r"\S"))
    types = dict(links.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "host string, section string, copy bigint, lines array<bigint>, at array<int>, kinds array<tinyint>, sizes array<smallint>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                got = describe_pages(part.column(len(keys)).to_pylist(), part.column(len(keys) + 1).to_pylist())
                longest = [_copy_key(g[2], g[4], g[5]) for g in got]
                ends = np.concatenate(([0], np.cumsum([len(g[2]) for g in got]))).astype(np.int32)

                def ragged(column: int, got=got, ends=ends) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([g[column] for g in got])))

                arrays = [*part.columns[: len(keys)], pa.array([g[0] for g in got]), pa.array([g[1] for g in got]), pa.array(longest), ragged(2), ragged(3), ragged(4), ragged(5)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    made = spread(given).mapInArrow(run, schema)
    return keep_table(made.withColumn("__h", F.xxhash64("lines")).dropDuplicates([*keys, "__h"]).drop("__h"))


def _surroundings(codes: np.ndarray, pages: np.ndarray, at: np.ndarray, kinds: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """For each token whether its line stands between lines of the article, before a unique line, before a line surely of the article, or on a page without any such other line."""
    new = np.ones(len(codes), bool)
    new[1:] = (at[1:] != at[:-1]) | (pages[1:] != pages[:-1])
    starts = np.flatnonzero(new)
    line_of = np.cumsum(new) - 1
    seen = np.bincount(codes)[codes]
    kind, page, size = kinds[starts] & 15, pages[starts], sizes[starts]
    # a paragraph that more pages have is none of the article's
    sure = ((kinds[starts] & OWN_TOPIC) > 0) | (((kind == PARAGRAPH) | (kind == CODE)) & (np.maximum.reduceat(seen, starts) <= 2))
    unique = np.logical_and.reduceat(seen == 1, starts) & (size >= PROSE_WORDS) & (kind != RESIDUE)
    prose = sure | unique
    # the neighbour that counts is the nearest one that isn't an item of a list
    n = len(starts)
    near = np.flatnonzero(kind != ITEM)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    place = np.searchsorted(near, np.arange(n))
    ok = place > 0
    back = near[place[ok] - 1]
    before[ok] = prose[back] & (page[back] == page[ok])
    place = np.searchsorted(near, np.arange(n), side="right")
    ok = place < len(near)
    ahead = near[place[ok]]
    after[ok] = prose[ahead] & (page[ahead] == page[ok])
    follows, own = np.zeros(n, bool), np.zeros(n, bool)
    same = page[1:] == page[:-1]
    follows[:-1] = same & unique[1:] & ~sure[1:]
    own[:-1] = same & sure[1:]
    alone = (np.bincount(page, weights=sure)[page] == sure) & (kind != CODE) & ~((kinds[starts] & OWN_TOPIC) > 0)
    return {"amid": (before & after)[line_of], "follows": follows[line_of], "own": own[line_of], "alone": alone[line_of], "weak": (kind == DOUBTFUL)[line_of]}


def repeated_lines(streams: DataFrame) -> DataFrame:
    """(host, line, section, most, pages, amid, follows, own, alone, weak, longest): pages of each host with a token, exact whatever the blocks.

    Hosts and sections are hashes; section is the one with the most of these pages. amid counts those where the
    line stands between lines of the article, follows those where one unique line comes next, own those where a line
    surely of the article does, alone those without any such line elsewhere, weak those where the line holds words of
    messages. Rows without line hold the pages of each section of a host. Each host's pages are
    dealt to blocks of about BLOCK_PAGES; a small host stays whole in the pool it shares, and no block holds a hot
    host whole. Copies of one article (``copy``) count once.
    """
    # a page without address is its own host
    site = F.when(F.col("host") == "", F.col("copy")).otherwise(F.xxhash64("host"))
    arrays = ("lines", "at", "kinds", "sizes")
    given = streams.select(site.alias("host"), F.xxhash64("section").alias("section"), "copy", *arrays)
    sizes = given.groupBy("host").agg(F.count("*").alias("n"))
    pooled = sizes.select("host", F.when(F.col("n") < POOL_BELOW, 0).otherwise(F.col("host")).alias("pool"), "n")
    totals = pooled.groupBy("pool").agg(F.sum("n").alias("total"))
    one = given.groupBy("host", "copy").agg(F.min_by(F.struct("section", *arrays), F.struct(F.xxhash64("lines"), "section")).alias("x")).select("host", "copy", "x.*")
    dealt = one.join(pooled.join(totals, "pool").select("host", "pool", "total"), "host")
    dealt = dealt.withColumn("block", F.pmod(F.when(F.col("pool") == 0, F.xxhash64("host")).otherwise(F.xxhash64("copy")), F.ceil(F.col("total") / BLOCK_PAGES)))
    counts = ("amid", "follows", "own", "alone", "weak", "longest")

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, at, kinds, words = (np.concatenate(pdf[c].to_list()) for c in arrays)
        pages = np.repeat(np.arange(len(pdf)), [len(x) for x in pdf["lines"]])
        names, codes = np.unique(tokens, return_inverse=True)
        said = _surroundings(codes, pages, at, kinds, words) | {"longest": repeated_runs(codes, pages)}
        places = pdf.groupby(["host", "section"], sort=False)
        place, n_places = places.ngroup().to_numpy(), places.ngroups
        first = np.unique(place, return_index=True)[1]
        # once per token and page, then added up per token and place
        key = codes.astype(np.int64) * len(pdf) + pages
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        said = {c: (np.maximum if c == "longest" else np.logical_or).reduceat(v[order], starts) for c, v in said.items()}
        line, page = np.divmod(key[order][starts], len(pdf))
        key = line * n_places + place[page]
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        line, spot = np.divmod(key[order][starts], n_places)
        none = np.zeros(n_places, np.int64)
        columns = {
            "line": np.concatenate([names[line], none]),
            "whole": np.concatenate([np.zeros(len(line), bool), np.ones(n_places, bool)]),
            "pages": np.concatenate([np.diff(np.append(starts, len(key))), np.bincount(place, minlength=n_places)]),
            **{c: np.concatenate([(np.maximum if c == "longest" else np.add).reduceat(v[order].astype(np.int64), starts), none]) for c, v in said.items()},
        }
        spot = first[np.concatenate([spot, np.arange(n_places)])]
        return pd.DataFrame({"host": pdf["host"].to_numpy()[spot], "section": pdf["section"].to_numpy()[spot], **columns})

    found = dealt.groupBy("pool", "block").applyInPandas(find, "host bigint, section bigint, line bigint, whole boolean, pages bigint, " + ", ".join(f"{c} bigint" for c in counts))
    found = found.withColumn("line", F.when(~F.col("whole"), F.col("line")))
    added = [*(F.sum(c).alias(c) for c in counts[:-1]), F.max("longest").alias("longest")]
    # blocks have combined their rows, so these move once, for both groupings
    by_section = found.repartition("host", "line").groupBy("host", "line", "section").agg(F.sum("pages").alias("pages"), *added)
    # where two sections tie, neither has too many
    by_line = by_section.groupBy("host", "line", F.when(F.col("line").isNull(), F.col("section")).alias("__s"))
    return by_line.agg(F.max_by("section", "pages").alias("section"), F.max("pages").alias("most"), F.sum("pages").alias("pages"), *added).drop("__s")


def _spread_out(pages: str, most: str, share: str) -> Column:
    """Whether pages outside the section of ``most`` of them are as many as that section's ``share`` of its whole lets expect, or too few are expected to tell."""
    expected = F.col(pages) * (1 - F.col(share))
    return (expected < LEAST_EXPECTED) | (F.col(pages) - F.col(most) >= (1 - MOST_IN_SECTION) * expected)


def _kind_of_mark() -> Column:
    """What the counts of a token say: a heading over other articles, furniture, or neither (null)."""
    heads = (F.col("follows") >= LEAST_FOLLOWED * F.col("pages")) & (F.col("own") <= MOST_FOLLOWED_OWN * F.col("pages"))
    return F.when(heads, MARK_HEAD).when(F.col("amid") <= MOST_AMID * F.col("pages"), MARK_FURNITURE)


def furniture_lines(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((host, line, own), (line, mark)): what each host's own pages say of a token, and furniture of many hosts.

    ``counts`` are those of ``repeated_lines``. own is the mark for furniture of that host, -1 where its pages speak against
    what many hosts say. A host's lines count for other hosts only as one host of many.
    """
    whole = counts.where("line is null")
    hosts = whole.groupBy("host").agg(F.sum("pages").alias("n"), F.max_by("section", F.struct("pages", "section")).alias("section"))
    shares = whole.select("host", "section", F.col("pages").alias("n_section")).join(hosts.select("host", "n"), "host").select("host", "section", "n", (F.col("n_section") / F.col("n")).alias("share"))
    lines = counts.where("line is not null")
    # of few pages half are enough, for a line that is repeated alone all
    enough = F.col("pages") >= F.least(F.lit(LEAST_PAGES), F.greatest(F.lit(2), F.ceil(F.col("n") / 2)))
    together = (F.col("n") >= LEAST_PAGES) | (F.col("pages") == F.col("n")) | (F.col("longest") >= 2)
    own = lines.where("pages >= 2").withColumn("mark", _kind_of_mark()).where("mark is not null")
    own = own.join(shares, ["host", "section"]).where(enough & together & _spread_out("pages", "most", "share")).select("host", "line", "mark", "pages", "amid")
    # every host counts once, in the section where it has most of its pages
    baseline = hosts.groupBy("section").agg(F.count("*").alias("n")).join(F.broadcast(hosts.agg(F.count("*").alias("all")))).select("section", (F.col("n") / F.col("all")).alias("share"))
    ratios = [F.sum(F.col(c) / F.col("pages")).alias(c) for c in ("amid", "follows", "own")]
    by_section = lines.groupBy("line", "section").agg(F.count("*").alias("pages"), *ratios)
    by_line = by_section.groupBy("line").agg(F.sum("pages").alias("pages"), *[F.sum(c).alias(c) for c in ("amid", "follows", "own")], F.max("pages").alias("most"), F.max_by("section", "pages").alias("section"))
    common = by_line.where(F.col("pages") >= MANY_HOSTS).withColumn("mark", _kind_of_mark())
    # what is the article's on many hosts is so on one, unless that is plain there
    articles = common.where("mark is null").select("line", F.lit(True).alias("elsewhere"))
    own = own.join(articles, "line", "left").where(F.col("elsewhere").isNull() | (F.col("amid") <= DESPITE * F.col("pages"))).select("host", "line", "mark")
    many = common.where("mark is not null").join(baseline, "section", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    many = keep_table(many.where(_spread_out("pages", "most", "share")).select("line", "mark"))
    against = lines.where((F.col("pages") >= LEAST_AGAINST) & (F.col("amid") >= AGAINST * F.col("pages"))).where(_kind_of_mark().isNull()).select("host", "line").join(many, "line", "left_semi")
    own = own.join(many, ["line", "mark"], "left_anti").select("host", "line", F.col("mark").alias("own")).unionByName(against.select("host", "line", F.lit(-1).alias("own")))
    return keep_table(own), many


def marked_pages(streams: DataFrame, keys: list[str], furniture: tuple[DataFrame, DataFrame] | None, messages: DataFrame | None) -> DataFrame:
    """(keys, outside, blocked): numbers of the lines outside the main body, and whether residue replaces the content.

    The marks meet the lines in a join whose strategy follows the size of the
    mark tables: they are tables in the shared folder, so their size is known.
    """
    flat = streams.select(*keys, "host", F.xxhash64("lines").alias("__page"), F.posexplode(F.arrays_zip("lines", "at", "kinds", "sizes")).alias("pos", "x"))
    flat = flat.select(*keys, "__page", "pos", F.xxhash64("host").alias("__host"), F.col("x.lines").alias("__line"), F.col("x.at").alias("at"), F.col("x.kinds").alias("kind"), F.col("x.sizes").alias("size"))
    own, many = furniture or (None, None)
    flat = flat.join(many.select(F.col("line").alias("__line"), F.col("mark").alias("everywhere")), "__line", "left") if many is not None else flat.withColumn("everywhere", F.lit(0))
    flat = flat.join(messages.select(F.col("line").alias("__line"), F.lit(MARK_MESSAGE).alias("message")), "__line", "left") if messages is not None else flat.withColumn("message", F.lit(0))
    flat = flat.join(own.select(F.col("host").alias("__host"), F.col("line").alias("__line"), "own"), ["__host", "__line"], "left") if own is not None else flat.withColumn("own", F.lit(0))
    mark = F.greatest(F.coalesce("own", "everywhere", F.lit(0)), F.lit(0)).bitwiseOR(F.coalesce("message", F.lit(0)))
    packed = F.struct("pos", "at", "kind", "size", mark.cast("tinyint").alias("mark"))
    grouped = flat.groupBy(*keys, "__page").agg(F.sort_array(F.collect_list(packed)).alias("x"))
    columns = ("at", "kind", "size", "mark")
    plain = grouped.select(*keys, *[F.col(f"x.{c}").alias(c) for c in columns])
    types = dict(plain.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "outside array<int>, blocked boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            outside, blocked = judge_pages(lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py(), *(x.flatten().to_numpy() for x in lists))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(outside, pa.list_(pa.int32())), pa.array(blocked)], names=[*keys, "outside", "blocked"])

    return plain.mapInArrow(run, schema)


def outside_lines(links: DataFrame, *, url: str = "resolved", body: str = "body", keys: list[str] | None = None) -> DataFrame:
    """(keys, line_no): every non-blank line of a page that is not part of its main body, numbered from 1.

    ``keys`` name a page (bookmark and ordinal). Null or blank bodies give no
    rows, repeated rows count once, a page named twice with different bodies
    gives the lines of both. Null addresses make a page its own host.
    """
    from keepsieve.llm.residue import recurring_messages

    keys = keys or ["bookmark", "ordinal"]
    streams = page_streams(links, url=url, body=body, keys=keys)
    counts = keep_table(repeated_lines(streams))
    marked = marked_pages(streams, keys, furniture_lines(counts), recurring_messages(counts))
    return marked.select(*keys, F.explode("outside").alias("line_no")).distinct()


def main_bodies(links: DataFrame, *, url: str = "resolved", body: str = "body", keys: list[str] | None = None) -> DataFrame:
    """(keys, main): each page's own lines in order, joined by line feeds; empty where nothing of its own is left."""
    keys = keys or ["bookmark", "ordinal"]
    outside = outside_lines(links, url=url, body=body, keys=keys).groupBy(*keys).agg(F.collect_set("line_no").alias("gone"))
    first = Window.partitionBy(*keys).orderBy(F.length("text").desc(), F.xxhash64("text"))
    one = links.where(F.col(body).isNotNull()).select(*keys, F.col(body).alias("text")).withColumn("r", F.row_number().over(first)).where("r = 1")
    both = one.join(outside, keys, "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.coalesce(F.array_contains("gone", i + 1), F.lit(False)))
    return both.select(*keys, F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n")).alias("main"))
