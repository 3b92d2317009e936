"""Queries of the text operators, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsieve.llm.boilerplate import main_bodies, outside_lines
from keepsieve.llm.lookalike import consistent_form, look_alike_classes, look_alike_pairs
from keepsieve.llm.mixing import mix
from keepsieve.llm.nearcopies import copy_groups, copy_pairs, near_copies
from keepsieve.llm.packing import pack
from keepsieve.llm.pairs import basket_items, tag_pairs
from keepsieve.llm.residue import blocked_pages
from keepsieve.llm.subjects import document_subjects
from keepsieve.llm.tokens import token_count
from keepsieve.plans.runtime import keep_table, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function as a query under its own name, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of bookmarks whose title or body looks the same in different characters."""
    pairs = look_alike_pairs(read_table(spark, d, "bookmark"), id="id", columns=["title", "body"])
    return pairs.select(F.col("id_a").alias("bookmark_a"), F.col("id_b").alias("bookmark_b"), "field")


@query()
def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarks whose title or body looks like another's in different characters, by class."""
    return look_alike_classes(read_table(spark, d, "bookmark"), id="id", columns=["title", "body"]).withColumnRenamed("id", "bookmark")


@query()
def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """Title and body of every bookmark in the consistent form."""
    texts = read_table(spark, d, "bookmark").select("id", "title", "body")
    return consistent_form(texts, ["title", "body"]).select("id", "title_form", "body_form")


#: TESTDATA.md defines copies by three-word sequences and a similarity of one half, from 40 words on.
COPIES = {"id": "id", "text": "body", "words": 3, "least": 40, "threshold": 0.5}


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of bookmarks whose bodies share at least half of their three-word sequences."""
    members, links = near_copies(read_table(spark, d, "bookmark"), **COPIES)
    return copy_pairs(members, links).select(F.col("a").alias("bookmark_a"), F.col("b").alias("bookmark_b"))


@query()
def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every compared bookmark with the group of bookmarks that hold the same text in substance."""
    members, links = near_copies(read_table(spark, d, "bookmark"), **COPIES)
    return copy_groups(members, links).withColumnRenamed("id", "bookmark")


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of saved pages that are not part of the page's main body."""
    return outside_lines(read_table(spark, d, "link")).select("bookmark", "ordinal", F.col("line_no").cast("int").alias("line_no"))


@query()
def p1_main(spark: SparkSession, d: str) -> DataFrame:
    """The article's own lines of every saved page."""
    return main_bodies(read_table(spark, d, "link"))


@query()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Links whose body holds residue in place of a page's content."""
    return blocked_pages(read_table(spark, d, "link")).where("blocked").select("bookmark", "ordinal")


@query()
def p3_content(spark: SparkSession, d: str) -> DataFrame:
    """Links with real content."""
    return blocked_pages(read_table(spark, d, "link")).where(~F.col("blocked")).select("bookmark", "ordinal")


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return document_subjects(read_table(spark, d, "documents"), read_table(spark, d, "subject_label"), read_table(spark, d, "subject_area"))


@query()
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the subjects of at least a quarter of their sentences."""
    return _subjects(spark, d).select(F.col("id").alias("doc_id"), "subject")


@query()
def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents, and share of the corpus in code points, by subject and source; a document counts in equal parts for its subjects."""
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars")
    own = _subjects(spark, d)
    parts = own.groupBy("id").agg(F.count("*").alias("k"))
    joined = own.join(parts, "id").join(docs, "id")
    return joined.groupBy("source", "subject").agg(F.count("*").alias("documents"), F.sum(F.col("n_chars") / F.col("k")).alias("chars"))


#: Pairs in at least so many bookmarks, at least so many times as often as by chance.
PAIR_LEAST, PAIR_LIFT = 5, 8
_TAGS_SQL = r"""
WITH t AS (SELECT DISTINCT bookmark, lower(regexp_replace(tag, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS tag FROM tag WHERE bookmark IS NOT NULL),
c AS (SELECT * FROM t WHERE tag <> ''), m AS (SELECT tag, count(*) AS n FROM c GROUP BY tag), n AS (SELECT count(DISTINCT bookmark) AS n FROM c),
p AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_ab FROM c a JOIN c b ON a.bookmark = b.bookmark AND a.tag < b.tag GROUP BY 1, 2)
"""


@query(
    _TAGS_SQL
    + """SELECT p.tag_a, p.tag_b FROM p JOIN m x ON x.tag = p.tag_a JOIN m y ON y.tag = p.tag_b CROSS JOIN n
WHERE n_ab >= 5 AND n_ab * n.n >= 8 * x.n * y.n"""
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of tags that occur together often, and far more often than by chance."""
    scores = tag_pairs(read_table(spark, d, "tag")).scores(least=PAIR_LEAST)
    exact = (F.col("n_ab").cast("decimal(19,0)") * F.col("n")) >= PAIR_LIFT * F.col("n_a").cast("decimal(19,0)") * F.col("n_b")
    return scores.where(exact).select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


@query(
    _TAGS_SQL
    + """SELECT p.tag_a, p.tag_b, p.n_ab, round(p.n_ab * n.n / (x.n * y.n::DOUBLE), 6) AS ratio
FROM p JOIN m x ON x.tag = p.tag_a JOIN m y ON y.tag = p.tag_b CROSS JOIN n"""
)
def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of tags with its number of bookmarks and its ratio to the number expected by chance."""
    scores = tag_pairs(read_table(spark, d, "tag")).scores()
    return scores.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n_ab", F.round("lift", 6).alias("ratio"))


@query(
    _TAGS_SQL.replace("tag <> ''", "tag NOT IN ('', 'later')")
    + """SELECT p.tag_a, p.tag_b, p.n_ab, round(p.n_ab * n.n / (x.n * y.n::DOUBLE), 6) AS ratio
FROM p JOIN m x ON x.tag = p.tag_a JOIN m y ON y.tag = p.tag_b CROSS JOIN n"""
)
def p6_changed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs after a second batch in which every bookmark that was tagged 'later' loses that tag."""
    tags = read_table(spark, d, "tag")
    table = tag_pairs(tags)
    items = basket_items(tags, basket="bookmark", item="tag")
    hit = items.where("item = 'later'").select("basket")
    left = items.where("item <> 'later'").join(hit, "basket", "left_semi")
    table.apply(hit.join(left, "basket", "left").select("basket", "item"))
    return table.scores().select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n_ab", F.round("lift", 6).alias("ratio"))


@query()
def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or piece of one longer than the largest capacity, in its container."""
    return pack(read_table(spark, d, "documents"), read_table(spark, d, "container_size")).withColumnRenamed("id", "doc_id")


@query()
def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used of each capacity, tokens in them and share of the room used."""
    packed = pack(read_table(spark, d, "documents"), read_table(spark, d, "container_size"))
    used = packed.groupBy("container", "shard", "number").agg(F.sum("tokens").alias("tokens"))
    used = used.groupBy("container").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    sizes = read_table(spark, d, "container_size")
    return used.join(sizes, "container").select("container", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))


@query("SELECT doc_id, true AS whole, true AS fits FROM documents WHERE text <> ''")
def p7_placed(spark: SparkSession, d: str) -> DataFrame:
    """For every document whether all its tokens are placed, and whether its containers hold no more than their capacity."""
    docs, sizes = read_table(spark, d, "documents"), read_table(spark, d, "container_size")
    packed = keep_table(pack(docs, sizes))
    room = packed.groupBy("container", "shard", "number").agg(F.sum("tokens").alias("used"), F.max(F.col("position") + F.col("tokens")).alias("end"), F.count("*").alias("n"), F.countDistinct("position").alias("places"))
    room = room.join(sizes, "container").select("container", "shard", "number", ((F.col("used") <= F.col("capacity_tokens")) & (F.col("end") == F.col("used")) & (F.col("n") == F.col("places"))).alias("ok"))
    placed = packed.join(room, ["container", "shard", "number"]).groupBy("id").agg(F.sum("tokens").alias("t"), F.every("ok").alias("fits"))
    counted = docs.select(F.col("doc_id").alias("id"), token_count(F.col("text")).alias("tokens"))
    return placed.join(counted, "id").select(F.col("id").alias("doc_id"), (F.col("t") == F.col("tokens")).alias("whole"), "fits")


@query("SELECT source, true AS within_repeats, true AS near_share FROM mix_target m WHERE EXISTS (SELECT 1 FROM documents d WHERE d.source = m.source AND d.text <> '')")
def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """For every source whether no document is used too often, and whether its share is as near its target as the longest document allows."""
    targets = read_table(spark, d, "mix_target")
    chosen, shares = mix(read_table(spark, d, "documents"), targets)
    most = chosen.groupBy("source").agg(F.max("copies").alias("most"))
    whole = shares.where("tokens_there > 0").agg(F.sum("target_share").alias("whole"), F.sum("tokens_used").alias("all")).join(chosen.agg(F.max("tokens").alias("longest")))
    got = shares.where("tokens_there > 0").join(most, "source").join(F.broadcast(whole))  # one row
    return got.select("source", (F.col("most") <= F.col("max_repeats")).alias("within_repeats"), (F.abs(F.col("share") - F.col("target_share") / F.col("whole")) * F.col("all") <= F.col("longest")).alias("near_share"))


@query()
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the mix, with their repeats."""
    chosen, _ = mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_target"))
    return chosen.withColumnRenamed("id", "doc_id")


@query()
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of tokens of each source."""
    return mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_target"))[1]
