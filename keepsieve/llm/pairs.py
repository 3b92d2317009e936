"""Items that appear together: an incremental pair table.

Changed baskets emit signed pair and marginal deltas (minus what they held,
plus what they hold), which are merged into counts kept in hash buckets; scores
are recomputed from the counts of affected items. Only buckets that a delta
meets are written anew, so a small batch costs little beside the table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsieve.plans.runtime import keep_table, parts_of, shared_dir

#: Items of a basket that meet in one task at most, and bytes of the first batch's files for each bucket, about.
BLOCK, BUCKET_BYTES = 256, 1 << 20
_TABLES = {"baskets": "basket bigint, item string, id bigint", "pairs": "id_a bigint, id_b bigint, n_ab bigint", "marginals": "id bigint, item string, n bigint"}
_KEYS = {"baskets": ("basket",), "pairs": ("id_a", "id_b"), "marginals": ("id",)}


def basket_items(rows: DataFrame, *, basket: str, item: str) -> DataFrame:
    """(basket, item): distinct lower-cased items without surrounding white space; blank and null ones are none."""
    clean = F.lower(F.regexp_replace(item, r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$", ""))
    return rows.select(F.col(basket).alias("basket"), clean.alias("item")).where("basket is not null and item <> ''").distinct()


def signed_pairs(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id_a, id_b, delta) from (basket, sign, id), id_a < id_b; ``sizes`` (basket, sign, n) counts the ids.

    A basket of more than BLOCK items is split in blocks whose pairs of blocks
    meet in different tasks; equal pairs are added up before the shuffle.
    """
    large = sizes.where(F.col("n") > BLOCK).select("basket", "sign", F.ceil(F.col("n") / BLOCK).cast("int").alias("g"))
    lists = items.join(large, ["basket", "sign"], "left_anti").groupBy("basket", "sign").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)
    first = lists.select("sign", "ids", F.posexplode("ids").alias("at", "id_a"))
    small = first.select("id_a", F.explode(F.slice("ids", F.col("at") + 2, F.lit(BLOCK))).alias("id_b"), "sign")
    dealt = items.join(large, ["basket", "sign"]).withColumn("k", F.pmod(F.hash("id"), F.col("g")))
    # block k takes part in the meetings (k, j) of all blocks j
    met = dealt.select("basket", "sign", "id", "k", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("j"))
    met = met.select("basket", "sign", "id", F.least("k", "j").alias("lo"), F.greatest("k", "j").alias("hi"), "k").repartition("basket", "sign", "lo", "hi")
    sides = met.groupBy("basket", "sign", "lo", "hi").agg(*[F.collect_list(F.when(F.col("k") == F.col(c), F.col("id"))).alias(c + "_ids") for c in ("lo", "hi")])
    across = sides.select("sign", "lo", "hi", "hi_ids", F.explode("lo_ids").alias("x")).select("sign", "lo", "hi", "x", F.explode("hi_ids").alias("y"))
    across = across.where("lo <> hi or x < y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "sign")
    return small.unionByName(across).groupBy("id_a", "id_b").agg(F.sum("sign").alias("delta"))


class PairTable:
    """Persistent counts of items, pairs and baskets under one folder, changed basket by basket.

    The folder holds versions of buckets and, for every batch that was finished,
    a manifest that names the version of each bucket; a batch that fails leaves
    the last one in force, and a table opened on a folder goes on from there.
    Items are counted under a 64-bit hash of theirs; two items of one hash are
    an error. Counts that fall to zero are dropped.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = (path or f"{shared_dir(spark).rstrip('/')}/pairs-{uuid.uuid4().hex}").rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at(""))] if self._fs.exists(self._at("")) else []
        whole = max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=0)
        # a version without manifest is of a batch that failed; its number isn't used again
        self.version = max([whole, *(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())])
        if whole:
            text = spark.read.text(f"{self.path}/manifest-{whole}.json", wholetext=True).first()["value"]
            self._state = json.loads(text)
        else:
            self._state = {"buckets": buckets, "n": 0, "tables": {t: {} for t in _TABLES}}

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or the part of it in ``buckets``."""
        held = self._state["tables"][table]
        paths = [f"{self.path}/v{v}/{table}/bucket={b}" for b, v in held.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(_TABLES[table]).parquet(*paths) if paths else self.spark.createDataFrame([], _TABLES[table])

    def _write(self, df: DataFrame, table: str, touched: list[int] | None) -> None:
        """Writes the rows of the touched buckets (all of them by default) as this version."""
        n, path = self._state["buckets"], f"{self.path}/v{self.version}/{table}"
        dealt = df.withColumn("bucket", F.pmod(F.hash(*_KEYS[table]), F.lit(n)))
        dealt.repartition(n if touched is None else max(1, len(touched)), "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(path)
        written = [x.getPath().getName() for x in self._fs.listStatus(self._at(f"v{self.version}/{table}"))]
        held = {b: v for b, v in self._state["tables"][table].items() if touched is not None and int(b) not in touched}
        self._state["tables"][table] = held | {w[7:]: self.version for w in written if w.startswith("bucket=")}

    def _merge(self, delta: DataFrame, table: str, count: str) -> None:
        """Adds ``delta`` to the counts of a table, bucket by bucket."""
        keys = [c for c in delta.columns if c != "delta"]
        touched = [r[0] for r in delta.select(F.pmod(F.hash(*_KEYS[table]), F.lit(self._state["buckets"]))).distinct().collect()]
        both = self._read(table, touched).unionByName(delta.withColumnRenamed("delta", count))
        self._write(both.groupBy(*keys).agg(F.sum(count).alias(count)).where(F.col(count) != 0), table, touched)

    def _finish(self) -> None:
        """Makes this version the one in force."""
        fresh = self._at(f"_manifest-{self.version}-{uuid.uuid4().hex}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(self._state).encode()))
        out.close()
        if not self._fs.rename(fresh, self._at(f"manifest-{self.version}.json")):
            raise OSError("manifest could not be put in place")

    def apply(self, changed: DataFrame) -> DataFrame:
        """Replaces the content of baskets: ``changed`` (basket, item), item null for a basket now empty.

        Returns the items affected (id, item): those of changed counts or pairs,
        or all if the number of baskets changed, which the scores of all pairs depend on.
        """
        hashed = changed.select("basket", "item", F.xxhash64("item").alias("id"))
        first, before = not self._state["tables"]["baskets"], json.dumps(self._state)
        self.version += 1
        try:
            if first:
                self._state["buckets"] = self._state["buckets"] or parts_of(changed, BUCKET_BYTES)
                self._write(hashed.where("item is not null").distinct(), "baskets", None)
                signed = self._read("baskets").withColumn("sign", F.lit(1))
            else:
                ids = keep_table(changed.select("basket").distinct().withColumn("bucket", F.pmod(F.hash("basket"), F.lit(self._state["buckets"]))))
                touched = [r[0] for r in ids.select("bucket").distinct().collect()]
                stored = self._read("baskets", touched)
                new = hashed.where("item is not null").distinct()
                signed = keep_table(stored.join(ids, "basket", "left_semi").withColumn("sign", F.lit(-1)).unionByName(new.withColumn("sign", F.lit(1))))
                held = stored.join(ids, "basket", "left_anti").unionByName(signed.where("sign = 1").drop("sign"))
                self._write(held, "baskets", touched)
            sizes = keep_table(signed.groupBy("basket", "sign").agg(F.count("*").alias("n")))
            more = sizes.agg(F.coalesce(F.sum("sign"), F.lit(0))).first()[0]
            deltas = signed_pairs(signed.select("basket", "sign", "id"), sizes).where("delta <> 0")
            single = keep_table(signed.groupBy("id", "item").agg(F.sum("sign").alias("delta")).where("delta <> 0"))
            if first:
                self._write(deltas.withColumnRenamed("delta", "n_ab"), "pairs", None)
                self._write(single.withColumnRenamed("delta", "n"), "marginals", None)
            else:
                deltas = keep_table(deltas)
                self._merge(deltas, "pairs", "n_ab")
                self._merge(single, "marginals", "n")
            marginals = self._read("marginals")
            if single.join(marginals.select("id", F.col("item").alias("other")), "id").where("item <> other").limit(1).count():
                raise ValueError("two items have the same hash")
            self._state["n"] += more
            self._finish()
        except BaseException:
            self._state = json.loads(before)
            raise
        if first or more:
            return marginals.select("id", "item").unionByName(single.select("id", "item")).distinct()
        of_pairs = deltas.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct().join(marginals, "id").select("id", "item")
        return keep_table(single.select("id", "item").unionByName(of_pairs).distinct())

    def scores(self, affected: DataFrame | None = None, least: int = 1) -> DataFrame:
        """(item_a, item_b, n_ab, n_a, n_b, n, lift) of pairs in at least ``least`` baskets, of ``affected`` items only if given.

        lift is the count over the one expected by chance, n_ab * n / (n_a * n_b).
        """
        pairs = self._read("pairs").where(F.col("n_ab") >= least)
        if affected is not None:
            a = pairs.join(affected.select(F.col("id").alias("id_a")), "id_a", "left_semi")
            pairs = a.unionByName(pairs.join(affected.select(F.col("id").alias("id_b")), "id_b", "left_semi")).distinct()
        one = self._read("marginals").where(F.col("n") >= least)
        named = pairs.join(one.select(F.col("id").alias("id_a"), F.struct("item", "n").alias("a")), "id_a").join(one.select(F.col("id").alias("id_b"), F.struct("item", "n").alias("b")), "id_b")
        lo, hi = F.least("a", "b"), F.greatest("a", "b")
        out = named.select(lo["item"].alias("item_a"), hi["item"].alias("item_b"), "n_ab", lo["n"].alias("n_a"), hi["n"].alias("n_b"), F.lit(self._state["n"]).cast("bigint").alias("n"))
        return out.withColumn("lift", F.col("n_ab") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b")))


def tag_pairs(tags: DataFrame, *, basket: str = "bookmark", item: str = "tag") -> PairTable:
    """The pair table of whole baskets, as one batch of changes to an empty one."""
    table = PairTable(tags.sparkSession)
    table.apply(basket_items(tags, basket=basket, item=item))
    return table
