"""Template residue, filler and error pages among saved pages.

Lines are masked (unfilled fields, numbers, dates, addresses and the site's
name), and their exact hashes are grouped across sources. A line is a message if
it recurs on several sources (more of them if it holds no word of such messages)
and rarely with anything of the page's own around it; unfilled fields and filler
count by their shape. A page is blocked if such lines stand where its content
should.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsieve.plans.runtime import keep_table

#: A doubtful line is a message from so many sources on, with at most such a share of its pages holding content.
LEAST_SOURCES, MOST_WITH_CONTENT = 4, 0.3
#: A line without any word of messages is one from so many sources on.
LEAST_PLAIN = 8


def recurring_messages(counts: DataFrame) -> DataFrame:
    """(line): masked lines that recur across sources on pages without other content of their own; ``counts`` of ``repeated_lines``."""
    by_line = counts.where("line is not null").groupBy("line").agg(F.count_if(F.col("alone") > 0).alias("sources"), F.sum("pages").alias("n"), F.sum("alone").alias("alone"), F.sum("weak").alias("weak"))
    enough = F.col("sources") >= F.when(2 * F.col("weak") >= F.col("n"), LEAST_SOURCES).otherwise(LEAST_PLAIN)
    return keep_table(by_line.where(enough & (F.col("alone") >= (1 - MOST_WITH_CONTENT) * F.col("n"))).select("line"))


def blocked_pages(links: DataFrame, *, url: str = "resolved", body: str = "body", keys: list[str] | None = None) -> DataFrame:
    """(keys, blocked) of each page with a non-blank body: whether residue stands in place of its content.

    A page that only mentions or quotes a message among content of its own is
    not blocked. Null or blank bodies give no row; repeated rows give one; of a
    page named twice with different bodies one blocked body is enough.
    """
    from keepsieve.llm.boilerplate import furniture_lines, marked_pages, page_streams, repeated_lines

    keys = keys or ["bookmark", "ordinal"]
    streams = page_streams(links, url=url, body=body, keys=keys)
    counts = keep_table(repeated_lines(streams))
    marked = marked_pages(streams, keys, furniture_lines(counts), recurring_messages(counts))
    return marked.groupBy(*keys).agg(F.max("blocked").alias("blocked"))
