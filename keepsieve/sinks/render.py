"""Renderers: items to JSON, CSV, OPML, HTML, Markdown and raw archives, each line a column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsieve.functions import texts
from keepsieve.operators.query import display_title

CSV_COLUMNS = ("id", "created_at", "medium", "author", "title", "url", "tags", "categories", "text", "summary", "links")


def prepared(full: DataFrame, created: str = "created_ms") -> DataFrame:
    """Hydrated items with what the renderers share: title, author, summary, day, folder."""
    linked = F.get(F.filter(F.transform("links", lambda x: texts.blank_to_null(x["summary"])), lambda s: s.isNotNull()), 0)
    when = F.coalesce(F.col(created), F.col("ingested_at"))
    return full.select(
        "id", "medium", "external_id", F.coalesce("body", F.lit("")).alias("text"), "url", "collection", "raw", "tags", "links", "categories", F.col(created).alias("created_at"), "ingested_at",
        display_title(F.col("title"), F.col("links"), F.col("body"), F.col("url"), F.col("medium"), F.col("external_id")).alias("title"),
        F.coalesce(texts.blank_to_null(F.col("summary")), linked).alias("summary"), texts.author_display(F.col("author_handle"), F.col("author_name")).alias("author"), F.col("author_handle"), F.col("author_name"),
        texts.date_time(when).alias("when"), texts.date_only(when).alias("day"), F.coalesce(F.get("categories", 0)["slug"], F.col("collection"), F.col("medium")).alias("folder"),
    )


def record(full: bool = False) -> Column:
    """Public record of a prepared item; nulls and empty lists are left out of its JSON."""
    none = lambda c: F.when(F.size(c) > 0, F.col(c) if isinstance(c, str) else c)
    fields = [
        F.col("id").cast("string").alias("id"), "medium", "external_id", "title", "summary", "text", "url", "author", "created_at", "ingested_at", "when", none("tags").alias("tags"),
        F.when(F.size("categories") > 0, F.transform("categories", lambda c: F.struct(c["slug"].alias("slug"), c["confidence"].alias("confidence"), c["assigned_by"].alias("by")))).alias("categories"),
        F.when(F.size("links") > 0, F.transform("links", lambda x: F.struct(x["original"].alias("original"), x["resolved"].alias("resolved"), x["kind"].alias("kind"), x["blocked"].alias("blocked")))).alias("links"), "raw",
    ]
    return F.struct(*fields, *(["collection", "folder"] if full else []))


def json_lines(items: DataFrame) -> DataFrame:
    return items.select("id", F.to_json(record()).alias("line"))


def json_document(items: DataFrame, version: str = "1") -> DataFrame:
    """One document in pieces: (part, at, line) in order, so no row holds the whole archive."""
    head = items.agg(F.count("*").alias("n")).select(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("at"), F.concat(F.lit(f'{{"tool":"keepsieve","version":"{version}","count":'), F.col("n"), F.lit(',"bookmarks":[')).alias("line"))
    body = items.select(F.lit(1).alias("part"), F.col("id").alias("at"), F.to_json(record()).alias("line"))
    return head.unionByName(body).unionByName(head.select(F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("at"), F.lit("]}").alias("line")))


def csv_rows(items: DataFrame) -> DataFrame:
    cells = {
        "id": F.col("id").cast("string"), "created_at": texts.iso8601(F.col("created_at")), "medium": F.col("medium"), "author": F.col("author"), "title": F.col("title"), "url": F.col("url"), "tags": F.array_join("tags", " "),
        "categories": F.array_join(F.transform("categories", lambda c: c["slug"]), " "), "text": F.col("text"), "summary": F.col("summary"), "links": F.array_join(F.transform("links", lambda x: x["resolved"]), " "),
    }
    return items.select("id", F.concat_ws(",", *[texts.escape_csv(F.coalesce(cells[c], F.lit(""))) for c in CSV_COLUMNS]).alias("line"))


def opml_outlines(items: DataFrame) -> DataFrame:
    """(folder, id, line): one outline per item under its folder."""
    e = texts.escape_xml
    note = F.concat(F.coalesce("summary", F.lit("")), F.coalesce(F.concat(F.lit(" — @"), F.regexp_replace("author_handle", "^@", "")), F.lit("")))
    attr = lambda name, v: F.coalesce(F.concat(F.lit(f' {name}="'), v, F.lit('"')), F.lit(""))
    tags = F.when(F.size("tags") > 0, e(F.array_join("tags", ",")))
    line = F.concat(
        F.lit('<outline type="rss" text="'), e(F.col("title")), F.lit('" title="'), e(F.col("title")), F.lit('"'), attr("url", e(F.col("url"))), attr("addDate", F.floor(F.col("created_at") / 1000).cast("string")), attr("tags", tags), F.lit(">"),
        F.when(note == "", "").otherwise(F.concat(F.lit("<description>"), e(note), F.lit("</description>"))), F.lit("</outline>"),
    )
    return items.select("folder", "id", line.alias("line"))


def _grouped(lines: DataFrame, key: str, opening: Column, closing: str, descending: bool = False) -> DataFrame:
    """Lines of sections in order: (section, part, at, line), one row per line, ready for a range-sorted write."""
    groups = lines.select(key).distinct()
    head = groups.select(F.col(key).alias("section"), F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("at"), opening.alias("line"))
    foot = groups.select(F.col(key).alias("section"), F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("at"), F.lit(closing).alias("line"))
    body = lines.select(F.col(key).alias("section"), F.lit(1).alias("part"), (-F.col("id") if descending else F.col("id")).alias("at"), "line")
    return head.unionByName(body).unionByName(foot).orderBy(F.col("section").desc() if descending else F.col("section"), "part", "at")


def opml_document(items: DataFrame) -> DataFrame:
    return _grouped(opml_outlines(items), "folder", F.concat(F.lit('<outline text="'), texts.escape_xml(F.col("folder")), F.lit('">')), "</outline>")


def html_articles(items: DataFrame) -> DataFrame:
    """(day, id, line): one article element per item, twelve tags at most, an excerpt of 240 characters."""
    e = texts.escape_xml
    excerpt = texts.truncated(texts.squash(F.coalesce("summary", "text")), 240, 237)
    tags = F.array_join(F.transform(F.slice("tags", 1, 12), lambda t: F.concat(F.lit("<li>"), e(t), F.lit("</li>"))), "")
    title = F.when(F.col("url").isNull(), e(F.col("title"))).otherwise(F.concat(F.lit('<a href="'), e(F.col("url")), F.lit('">'), e(F.col("title")), F.lit("</a>")))
    line = F.concat(F.lit("<article><h3>"), title, F.lit("</h3><p>"), e(excerpt), F.lit("</p><ul>"), tags, F.lit("</ul></article>"))
    return items.select("day", "id", line.alias("line"))


def html_document(items: DataFrame) -> DataFrame:
    return _grouped(html_articles(items), "day", F.concat(F.lit("<section><h2>"), F.col("day"), F.lit("</h2>")), "</section>", True)


def note_name() -> Column:
    return F.concat(F.col("day"), F.lit(" "), texts.safe_filename(F.col("title"), F.col("external_id")))


def markdown_notes(items: DataFrame) -> DataFrame:
    tags = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("#"), t)), " ")
    text = F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("title")), F.col("author"), F.col("url"), F.nullif(F.trim("text"), F.lit("")), F.nullif(tags, F.lit("")))
    return items.select("id", "day", note_name().alias("name"), F.concat(text, F.lit("\n")).alias("note"))


def markdown_index(items: DataFrame) -> DataFrame:
    lines = items.select("day", "id", F.concat(F.lit("- [["), note_name(), F.lit("]]")).alias("line"))
    return _grouped(lines, "day", F.concat(F.lit("## "), F.col("day")), "", True)


def obsidian_notes(items: DataFrame) -> DataFrame:
    y = texts.escape_yaml
    slugs = F.transform("categories", lambda c: c["slug"])
    field = lambda name, v: F.concat(F.lit(f"{name}: "), v)
    front = F.concat_ws(
        "\n", F.lit("---"), field("title", y(F.col("title"))), field("date", F.col("day")), field("created", F.coalesce("created_at", "ingested_at").cast("string")), field("author", y(F.col("author"))), field("source", F.col("medium")), field("id", F.col("external_id")), field("url", F.col("url")),
        F.when(F.size("categories") > 0, F.concat(F.lit("categories: ["), F.array_join(slugs, ", "), F.lit("]"))), F.when(F.size("tags") > 0, F.concat(F.lit("tags: ["), F.array_join("tags", ", "), F.lit("]"))), F.lit("---"),
    )
    wiki = F.nullif(F.array_join(F.transform(slugs, lambda s: F.concat(F.lit("[["), s, F.lit("]]"))), " "), F.lit(""))
    return items.select("id", note_name().alias("name"), F.concat(F.concat_ws("\n\n", front, wiki, F.col("author"), F.nullif(F.trim("text"), F.lit(""))), F.lit("\n")).alias("note"))


def payload_name() -> Column:
    return F.concat(F.substring(F.regexp_replace("external_id", r"[^A-Za-z0-9_-]", ""), 1, 40), F.lit("-"), F.substring(F.sha2("external_id", 256), 1, 16), F.lit(".json"))


def raw_archive(items: DataFrame) -> DataFrame:
    """(file, payload, entry): one payload per item that keeps its raw record, and its index line."""
    kept = items.where("raw is not null")
    entry = F.to_json(F.struct("external_id", "medium", payload_name().alias("file"), F.col("id").cast("string").alias("id"), "title", "created_at"))
    return kept.select(payload_name().alias("file"), F.col("raw").alias("payload"), entry.alias("entry"))


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def report(written: int, skipped: int = 0, failed: int = 0) -> str:
    return ", ".join(f"{n} {what}" for n, what in ((written, "written"), (skipped, "skipped"), (failed, "failed")) if n) or "nothing to do"
