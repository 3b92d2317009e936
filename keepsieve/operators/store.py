"""The archive store: Parquet tables of parts behind numbered manifests.

A change writes new parts and then a manifest of its own number, which comes
into being whole by one rename; the newest manifest is in force. A reader never
sees half a change, a change that fails leaves the last one in force, and nothing
is overwritten while it is read. New items are appended as a part, so an insert
writes no more than its batch.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsieve.functions import texts
from keepsieve.operators.query import STAGES, first_wins
from keepsieve.plans.runtime import keep_table

SCHEMA_VERSION = 1
SATELLITES = ("link", "media", "tag", "bookmark_category", "item_category")


def new_items(stored: DataFrame, incoming: DataFrame, order: Column, keys: tuple[str, ...] = ("medium", "external_id")) -> DataFrame:
    """Incoming rows whose identity isn't stored, the first of each by ``order``. Stored rows are left alone."""
    return first_wins(incoming, list(keys), [order]).join(stored.select(*keys).distinct(), list(keys), "left_anti")


def latest_wins(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Catalogue upsert: for each key the row of highest ``order``, a change winning a tie."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    return first_wins(both, keys, [F.col(order).desc_nulls_last(), F.col("__new").desc()]).drop("__new")


def replace_rows(current: DataFrame, changes: DataFrame, key: str = "bookmark") -> DataFrame:
    """Satellite replace: all rows of the changed keys go, the given ones come."""
    return current.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def stamp(items: DataFrame, done: DataFrame, stage: str, now: int) -> DataFrame:
    """Items with ``stage`` stamped ``now`` where ``done`` (id) names them."""
    marked = items.join(done.select("id").distinct().withColumn("__done", F.lit(True)), "id", "left")
    return marked.withColumn(f"{stage}_at", F.when(F.col("__done"), F.lit(now)).otherwise(F.col(f"{stage}_at"))).drop("__done")


def requeue(items: DataFrame, stage: str) -> DataFrame:
    return items.withColumn(f"{stage}_at", F.lit(None).cast("bigint"))


def delete(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the given ids (id), satellites included."""
    out = dict(tables)
    out["bookmark"] = tables["bookmark"].join(ids.select("id"), "id", "left_anti")
    for name in SATELLITES:
        if name in tables:
            out[name] = tables[name].join(ids.select(F.col("id").alias("bookmark")), "bookmark", "left_anti")
    return out


def edit_tags(tag: DataFrame, ids: DataFrame, add: list[str] = (), remove: list[str] = ()) -> DataFrame:
    """Tag rows after adding and removing tags on the given ids; adding one that is there changes nothing."""
    gone = [t.strip().lower() for t in remove]
    kept = tag.join(ids.select(F.col("id").alias("bookmark"), F.lit(True).alias("__hit")), "bookmark", "left")
    kept = kept.where(F.col("__hit").isNull() | ~F.lower(F.trim("tag")).isin(gone or [""])).drop("__hit")
    fresh = ids.select(F.col("id").alias("bookmark"), F.explode(F.array(*[F.lit(t.strip().lower()) for t in add] or [F.lit("")])).alias("tag")).where("tag <> ''")
    return kept.unionByName(fresh.join(kept.select("bookmark", "tag"), ["bookmark", "tag"], "left_anti"))


def assign_categories(assigned: DataFrame, changes: DataFrame, category: DataFrame) -> DataFrame:
    """Assignments (bookmark, category, confidence, assigned_by) after those of the changed items are replaced.

    ``changes`` (bookmark, slug, confidence, assigned_by): a slug that the
    catalogue doesn't have is skipped, one given twice counts with its highest
    confidence; an item all of whose slugs are unknown ends without any.
    """
    known = changes.join(category.select(F.col("id").alias("category"), "slug"), "slug").groupBy("bookmark", "category").agg(F.max(F.struct("confidence", "assigned_by")).alias("x"))
    kept = assigned.join(changes.select("bookmark").distinct(), "bookmark", "left_anti")
    return kept.select("bookmark", "category", "confidence", "assigned_by").unionByName(known.select("bookmark", "category", F.col("x.confidence").alias("confidence"), F.col("x.assigned_by").alias("assigned_by")))


def number_items(fresh: DataFrame, stored: DataFrame | None, ms: str = "made") -> DataFrame:
    """``fresh`` with a unique id: its ms since 2020 in the upper bits, counted up within the ms and on into the next.

    An id is the one before it in order of time plus one, or the first of its
    ms if that is larger. The order is dealt to range partitions; only one
    number a partition passes through the driver. Rows that would meet a stored
    id are numbered after the last stored one.
    """
    place = "__place"
    rest = [c for c in fresh.columns if c != ms]
    dealt = fresh.withColumn("__h", F.xxhash64("medium", "external_id")).withColumn("__base", F.shiftleft(F.col(ms) - F.lit(texts.EPOCH), 16))
    for _ in range(8):
        ordered = dealt.repartitionByRange("__base", "__h", "external_id").sortWithinPartitions("__base", "__h", "external_id")
        numbered = keep_table(ordered.withColumn("__m", F.monotonically_increasing_id()).select("*", F.shiftright("__m", 33).alias("__p"), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)).alias(place)).drop("__m"))
        sums = sorted((r["__p"], r["n"], r["g"]) for r in numbered.groupBy("__p").agg(F.count("*").alias("n"), F.max(F.col("__base") - F.col(place)).alias("g")).collect())
        offset, high, state = 0, -(1 << 62), []
        for p, n, g in sums:
            state.append((p, offset, high))
            high, offset = max(high, g - offset), offset + n
        if not state:
            return fresh.withColumn("id", F.lit(0).cast("bigint"))
        before = fresh.sparkSession.createDataFrame(state, "__p bigint, __o bigint, __high bigint")
        w = Window.partitionBy("__p").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
        run = F.greatest(F.max(F.col("__base") - F.col(place)).over(w) - F.col("__o"), F.col("__high"))
        out = numbered.join(F.broadcast(before), "__p").withColumn("id", F.col("__o") + F.col(place) + run)  # a row a partition
        met = keep_table(out.join(stored.select("id"), "id", "left_semi").select("medium", "external_id")) if stored is not None else None
        if met is None or met.isEmpty():
            return out.select("id", ms, *rest)
        last = stored.agg(F.max("id")).first()[0]
        marked = numbered.drop("__p", place).join(met.withColumn("__met", F.lit(True)), ["medium", "external_id"], "left")
        dealt = marked.withColumn("__base", F.when(F.col("__met"), F.greatest(F.col("__base"), F.lit(last + 1))).otherwise(F.col("__base"))).drop("__met")
    raise RuntimeError("ids could not be numbered around the stored ones")


def index_extra(handle: Column, tags: Column, links: Column) -> Column:
    """Indexed text of a new item: handle and tags, then host, title and kind of each link, joined by blanks."""
    from keepsieve.functions import urls

    of_link = F.transform(links, lambda x: F.array(urls.host(x["resolved"]), texts.blank_to_null(x["title"]), F.regexp_replace(x["kind"], "-", " ")))
    words = F.concat(F.array(handle), tags, F.flatten(of_link))
    return F.array_join(F.filter(words, lambda x: x.isNotNull() & (x != "")), " ")


def enriched_extra(handle: Column, name: Column, links: Column, tags: Column) -> Column:
    """Indexed text after links and tags are known: @handle, name, hosts and titles of the links, tags last."""
    from keepsieve.functions import urls

    of_link = F.transform(links, lambda x: F.array(urls.host(x["resolved"]), texts.blank_to_null(x["title"])))
    words = F.concat(F.array(F.concat(F.lit("@"), handle), texts.blank_to_null(name)), F.flatten(of_link), tags)
    return F.array_join(F.filter(words, lambda x: x.isNotNull() & (x != "")), " ")


class Store:
    """Tables of one archive under a folder: the newest manifest names the parts of each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.manifest = self._load()
        if self.manifest["schema"] != SCHEMA_VERSION:
            raise ValueError(f"store has schema {self.manifest['schema']}, this is {SCHEMA_VERSION}: rebuild it")

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self) -> list[str]:
        return [x.getPath().getName() for x in self._fs.listStatus(self._at(""))] if self._fs.exists(self._at("")) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self._names() if n.startswith("manifest-") and n.endswith(".json"))

    def _read(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/manifest-{number}.json", wholetext=True).first()["value"])

    def _load(self) -> dict:
        numbers = self._numbers()
        return self._read(numbers[-1]) if numbers else {"schema": SCHEMA_VERSION, "version": 0, "tables": {}}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{part}" for part in self.manifest["tables"][name]])

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in self.manifest["tables"]}

    def commit(self, changed: dict[str, DataFrame], added: dict[str, DataFrame] | None = None) -> int:
        """Replaces the tables of ``changed``, appends the rows of ``added``, and puts a manifest in force; returns its number."""
        folders = [int(n[1:]) for n in self._names() if n[:1] == "v" and n[1:].isdigit()]
        version = max([self.manifest["version"], *folders, *self._numbers()]) + 1  # a change that failed may have left its number
        tables = dict(self.manifest["tables"])
        for name, df in changed.items():
            df.write.option("compression", "zstd").parquet(f"{self.path}/v{version}/{name}")
            tables[name] = [f"v{version}/{name}"]
        for name, df in (added or {}).items():
            part = f"v{version}/{name}-added"
            df.write.option("compression", "zstd").parquet(f"{self.path}/{part}")
            tables[name] = [*tables.get(name, []), part]
        return self._publish({"schema": SCHEMA_VERSION, "version": version, "tables": tables})

    def _publish(self, manifest: dict) -> int:
        fresh = self._at(f"_manifest-{manifest['version']}-{uuid.uuid4().hex}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(fresh, self._at(f"manifest-{manifest['version']}.json")):
            raise OSError("manifest could not be put in place")
        self.manifest = manifest
        return manifest["version"]

    def undo(self) -> int:
        """Puts the tables as they were before the last change in force, as a change of its own; returns its number."""
        earlier = [n for n in self._numbers() if n < self.manifest["version"]]
        tables = self._read(earlier[-1])["tables"] if earlier else {}
        return self._publish(self.manifest | {"version": self.manifest["version"] + 1, "tables": tables})

    def reset(self) -> int:
        """Puts an empty archive in force; earlier manifests stay for ``undo``."""
        return self._publish(self.manifest | {"version": self.manifest["version"] + 1, "tables": {}})

    def compact(self, names: list[str] | None = None) -> int:
        """Rewrites tables of many parts as one each."""
        many = [n for n, parts in self.manifest["tables"].items() if len(parts) > 1 and (names is None or n in names)]
        return self.commit({n: self.table(n) for n in many}) if many else self.manifest["version"]

    def size(self) -> int:
        """Bytes of the parts in force."""
        return sum(self._fs.getContentSummary(self._at(part)).getLength() for parts in self.manifest["tables"].values() for part in parts)

    def insert(self, incoming: DataFrame, now: int) -> dict[str, int]:
        """Adds items (reader columns) that aren't stored with their links, media and tags; returns counts.

        Ids are those of ``number_items``; an item without date takes ``now``.
        Only the keys of stored items are read, and only the batch is written.
        """
        stored = self.table("bookmark") if "bookmark" in self.manifest["tables"] else None
        shaped = incoming.withColumn("made", F.coalesce("created_ms", F.lit(now)))
        order = F.struct("created_ms", "external_id", "path") if "path" in incoming.columns else F.struct("created_ms", "external_id")
        fresh = new_items(stored, shaped, order) if stored is not None else first_wins(shaped, ["medium", "external_id"], [order])
        fresh = keep_table(number_items(fresh, stored))
        rows = fresh.select(
            "id", "medium", "external_id", "collection", "url", "author_handle", "author_name", "title", F.coalesce("summary", F.get_json_object("raw", "$.summary")).alias("summary"), F.coalesce("body", F.lit("")).alias("body"),
            index_extra(F.col("author_handle"), F.col("tags"), F.col("links")).alias("extra"), "role", F.col("created_ms"), F.lit(now).alias("ingested_at"), F.lit(None).cast("bigint").alias("fingerprint"), *[F.lit(None).cast("bigint").alias(f"{s}_at") for s in STAGES], "raw",
        )
        links = fresh.select(F.col("id").alias("bookmark"), F.posexplode("links").alias("ordinal", "x")).select("bookmark", "ordinal", "x.original", "x.resolved", "x.kind", "x.title", *[F.lit(None).cast("string").alias(c) for c in ("body", "summary", "blocked")])
        media = fresh.select(F.col("id").alias("bookmark"), F.posexplode("media").alias("ordinal", "x")).select("bookmark", "ordinal", "x.kind", "x.url", "x.preview_url", *[F.lit(None).cast(t).alias(c) for c, t in (("width", "int"), ("height", "int"), ("duration_ms", "bigint"), ("alt_text", "string"))])
        tags = fresh.select(F.col("id").alias("bookmark"), F.explode("tags").alias("tag")).distinct()
        counts = {"inserted": fresh.count(), "seen": incoming.count()}
        if counts["inserted"] or stored is None:
            self.commit({}, {"bookmark": rows, "link": links, "media": media, "tag": tags})
        return counts | {"duplicates": counts["seen"] - counts["inserted"]}
