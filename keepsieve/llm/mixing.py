"""Mixing sources to target shares by pivotal dependent rounding.

Each document of a source should appear f times, f = target tokens over tokens
there are. The whole part is fixed; the fractional parts are rounded in pairs:
token mass moves from one document to the other, in a random direction whose
odds keep every expectation, until one of the two is integral. The token sum of
a source thus stays what it was, up to one document; short documents of one leaf
then make up for that one, so the chance of these few to be chosen departs from
their source's rate. Leaves of bounded size are
rounded in parallel, and their one fractional document each meets the others in
the next level of a reduction tree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsieve.llm.tokens import DEFAULT, token_count
from keepsieve.plans.runtime import keep_table, spread

#: Documents in one leaf of the tree, about.
LEAF = 20_000
#: Sources with a target at most: the driver plans their rates.
MOST_SOURCES = 100_000


def _uniform(a: np.ndarray, seed: int) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array([seed], np.uint64) * np.uint64(0xD1B54A32D192ED03)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def pivotal(p: np.ndarray, weight: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Rounds fractions ``p`` to 0 or 1 keeping the sum of p * weight; at most one entry stays fractional."""
    p = p.astype(float).copy()
    tiny = 1e-9
    at = -1
    for j in range(len(p)):
        if p[j] <= tiny or p[j] >= 1 - tiny:
            p[j] = round(p[j])
            continue
        if at < 0:
            at = j
            continue
        i = at
        wi, wj = weight[i], weight[j]
        up = min((1 - p[i]) * wi, p[j] * wj)  # mass that can move from j to i
        down = min(p[i] * wi, (1 - p[j]) * wj)  # and from i to j
        move = up if u[j] * (up + down) < down else -down
        p[i] += move / wi
        p[j] -= move / wj
        i_done, j_done = (x <= tiny or x >= 1 - tiny for x in (p[i], p[j]))
        if i_done:
            p[i] = round(p[i])
        if j_done:
            p[j] = round(p[j])
        at = -1 if i_done and j_done else j if i_done else i
    return p


def mix(docs: DataFrame, targets: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = DEFAULT, seed: int = 1, leaf: int = LEAF, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares).

    chosen (id, source, tokens, copies): documents used at least once. shares
    (source, target_share, max_repeats, tokens_there, tokens_used, share, documents, copies):
    what was reached. ``budget`` is the total in tokens; by default the largest
    at which every source that has tokens can reach its share within its
    repeats; beyond that a source stays at its most and falls short. A source
    without target or without tokens gives no document; repeated ids count
    once; texts without tokens are never chosen; targets of sources that are
    missing are spread over the others in proportion. The same input and seed
    give the same choice.
    """
    spark = docs.sparkSession
    sized = spread(docs.select(id, text, source)).select(F.col(id).cast("bigint").alias("id"), F.col(source).alias("source"), token_count(F.col(text), tokenizer).alias("tokens")).where("tokens > 0 and source is not null and id is not null")
    goal = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    sized = keep_table(sized.join(goal.select("source"), "source", "left_semi").groupBy("id").agg(F.min_by("source", F.struct("tokens", "source")).alias("source"), F.min(F.struct("tokens", "source"))["tokens"].alias("tokens")))
    there = sized.groupBy("source").agg(F.sum("tokens").alias("s"), F.count("*").alias("n"))
    rows = goal.join(there, "source").limit(MOST_SOURCES + 1).collect()  # one row per source of the target table
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources have a target")
    plan = {r["source"]: r for r in rows}
    if not plan:
        return spark.createDataFrame([], "id bigint, source string, tokens bigint, copies int"), goal.select("source", "target_share", "max_repeats", F.lit(0).cast("bigint").alias("tokens_there"), F.lit(0).cast("bigint").alias("tokens_used"), F.lit(0.0).alias("share"), F.lit(0).cast("bigint").alias("documents"), F.lit(0).cast("bigint").alias("copies"))
    whole = sum(r["target_share"] for r in plan.values())
    total = budget or min(r["max_repeats"] * r["s"] * whole / r["target_share"] for r in plan.values())
    rate = {k: min(float(r["max_repeats"]), total * r["target_share"] / whole / r["s"]) for k, r in plan.items()}
    rates = spark.createDataFrame([(k, f, max(1, -(-int(plan[k]["n"]) // leaf))) for k, f in rate.items()], "source string, f double, leaves int")
    start = sized.join(rates, "source").select(
        "id", "source", "tokens", F.floor(F.col("f") + 1e-9).cast("int").alias("whole"), F.greatest(F.lit(0.0), F.col("f") - F.floor(F.col("f") + 1e-9)).alias("p"), F.pmod(F.xxhash64("id"), F.col("leaves")).alias("leaf")
    )
    schema = "id bigint, source string, tokens bigint, whole int, p double, leaf bigint"

    def round_leaf(level: int, last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            order = np.argsort(_uniform(pdf["id"].to_numpy(), seed * 1000 + level), kind="stable")
            pdf = pdf.iloc[order].reset_index(drop=True)
            u = _uniform(pdf["id"].to_numpy(), seed * 1000 + 500 + level)
            p = pivotal(pdf["p"].to_numpy(), pdf["tokens"].to_numpy(float), u)
            if last:
                p = np.where((p > 0) & (p < 1), (u < p).astype(float), p)
            return pdf.assign(p=p)[["id", "source", "tokens", "whole", "p", "leaf"]]

        return run

    most = max(-(-int(r["n"]) // leaf) for r in plan.values())
    done, level = [], 0
    current = start
    while True:
        rounded = keep_table(current.groupBy("source", "leaf").applyInPandas(round_leaf(level, most <= 1), schema))
        done.append(rounded.where((F.col("p") <= 0) | (F.col("p") >= 1)))
        if most <= 1:
            break
        # one fractional document a leaf is left; 256 leaves meet in one of the next level
        most = -(-most // 256)
        current = rounded.where((F.col("p") > 0) & (F.col("p") < 1)).withColumn("leaf", F.floor(F.col("leaf") / 256))
        level += 1
    every = done[0]
    for more in done[1:]:
        every = every.union(more)
    rounded = every.select("id", "source", "tokens", (F.col("whole") + F.round("p")).cast("int").alias("copies"))
    # the last document of a source was rounded alone: by how many tokens a source is off is one number per source
    off = {r["source"]: float(r["t"]) - rate[r["source"]] * plan[r["source"]]["s"] for r in rounded.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()}
    bound = {k: int(r["max_repeats"]) for k, r in plan.items()}

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["source"].iloc[0]
        left, flips = -off.get(name, 0.0), []
        step = 1 if left > 0 else -1
        for key, size, w, p in pdf.sort_values(["tokens", "id"], ascending=[False, True])[["id", "tokens", "whole", "p"]].itertuples(index=False):
            copies = int(w + round(p))
            if size <= abs(left) and 0 <= copies + step <= bound[name]:
                left -= step * size
                flips.append((key, step))
        return pd.DataFrame(flips, columns=["id", "flip"])

    flips = done[0].where("leaf = 0").groupBy("source").applyInPandas(settle, "id bigint, flip int")
    chosen = keep_table(rounded.join(flips, "id", "left").select("id", "source", "tokens", (F.col("copies") + F.coalesce("flip", F.lit(0))).alias("copies")).where("copies > 0"))
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.count("*").alias("documents"), F.sum("copies").alias("copies"))
    joined = goal.join(there.select("source", F.col("s").alias("tokens_there")), "source", "left").join(used, "source", "left").na.fill(0, ["tokens_there", "tokens_used", "documents", "copies"])
    sums = used.agg(F.sum("tokens_used").alias("__all"))
    shares = joined.join(F.broadcast(sums)).select("source", "target_share", "max_repeats", "tokens_there", "tokens_used", (F.col("tokens_used") / F.greatest(F.lit(1), F.col("__all"))).alias("share"), "documents", "copies")
    return chosen, shares
