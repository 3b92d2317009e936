"""Hierarchical packing of documents into containers of several fixed capacities.

A document goes to the smallest tier it fits; one longer than the largest
capacity is cut into full containers and a rest. Every tier is packed best-fit
decreasing, from the largest down, and the gaps its containers leave are filled
with whole documents of shorter tiers before those are packed themselves.
Containers of a tier are dealt to step groups of equal attention cost.

Pieces are dealt to shards by hash, and a shard is packed alone: at most a
container per shard and tier stays part empty, so the loss falls with size.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsieve.llm.tokens import DEFAULT, token_count
from keepsieve.plans.runtime import keep_table, spread

#: Pieces packed together in one task, about.
SHARD_PIECES = 20_000
#: Different capacities at most: every task holds them all.
MOST_CAPACITIES = 1000
#: Containers in a step group.
STEP = 16


class _Bins:
    """Open containers by room left; best fit is the smallest room that suffices."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room, self.rooms, self.content = capacity, {}, [], []

    def open(self) -> int:
        self.content.append([])
        self._put(len(self.content) - 1, self.capacity)
        return len(self.content) - 1

    def _put(self, at: int, room: int) -> None:
        if room > 0:
            if room not in self.by_room:
                self.by_room[room] = []
                insort(self.rooms, room)
            self.by_room[room].append(at)

    def place(self, item: int, size: int, fresh: bool) -> bool:
        i = bisect_left(self.rooms, size)
        if i == len(self.rooms):
            if not fresh or size > self.capacity:
                return False
            self.open()
            i = bisect_left(self.rooms, size)
        room = self.rooms[i]
        stack = self.by_room[room]
        at = stack.pop()
        if not stack:
            del self.by_room[room]
            self.rooms.pop(i)
        self.content[at].append((item, self.capacity - room))
        self._put(at, room - size)
        return True


def pack_shard(sizes: list[int], capacities: list[int]) -> list[tuple[int, int, int, int]]:
    """(item, tier, container, offset) for each of ``sizes``, none above the largest capacity; tiers ascending."""
    tiers: list[list[int]] = [[] for _ in capacities]
    for i, size in enumerate(sizes):
        tiers[next(t for t, c in enumerate(capacities) if size <= c)].append(i)
    for t in tiers:
        t.sort(key=lambda i: (-sizes[i], i))
    out = []
    for t in range(len(capacities) - 1, -1, -1):
        bins = _Bins(capacities[t])
        for i in tiers[t]:
            bins.place(i, sizes[i], True)
        for lower in range(t - 1, -1, -1):
            tiers[lower] = [i for i in tiers[lower] if not bins.place(i, sizes[i], False)]
        out.extend((i, t, b, at) for b, content in enumerate(bins.content) for i, at in content)
    return out


def pack(docs: DataFrame, containers: DataFrame, *, id: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT, shard_pieces: int = SHARD_PIECES, step: int = STEP) -> DataFrame:
    """One row per placed piece: (id, piece, start, tokens, container, shard, number, position, step_group).

    piece counts the parts of a document from 0, start is its first token in
    the document, container names the capacity, (shard, number) the container
    itself, position its first token in it. Only a document longer than the
    largest capacity has more than one piece. Texts without tokens (null, empty)
    take no room and have no row; repeated rows are packed once each; without
    capacities nothing can be placed and the result is empty; more than
    MOST_CAPACITIES of them are an error.
    """
    sized = spread(docs.select(id, text)).select(F.col(id).cast("bigint").alias("id"), token_count(F.col(text), tokenizer).alias("tokens"))
    sized = keep_table(sized.where("tokens > 0"))
    given = containers.where("capacity_tokens > 0").groupBy("container").agg(F.max("capacity_tokens").alias("c")).orderBy("c", "container").limit(MOST_CAPACITIES + 1).collect()
    if len(given) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    names, capacities = [r["container"] for r in given], [int(r["c"]) for r in given]
    schema = "id bigint, piece int, start bigint, tokens bigint, container string, shard bigint, number int, position int, step_group int"
    if not given:
        return docs.sparkSession.createDataFrame([], schema)
    largest = capacities[-1]
    # cutting happens before dealing, so one very long document spreads over shards
    cut = sized.select("id", "tokens", F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / largest).cast("int"))).alias("piece"), F.xxhash64("id", "tokens").alias("h"))
    cut = cut.select("id", "piece", (F.col("piece").cast("bigint") * largest).alias("start"), F.least(F.lit(largest), F.col("tokens") - F.col("piece").cast("bigint") * largest).alias("tokens"))
    pieces = sized.agg(F.sum(F.ceil(F.col("tokens") / largest))).first()[0] or 0
    shards = max(1, round(pieces / shard_pieces))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "id", "piece"], ascending=[False, True, True], ignore_index=True)
        sizes = pdf["tokens"].astype(int).tolist()
        placed = pd.DataFrame(pack_shard(sizes, capacities), columns=["i", "tier", "number", "position"])
        out = pdf.loc[placed["i"]].reset_index(drop=True)
        out["container"] = [names[t] for t in placed["tier"]]
        out["number"], out["position"], out["tier"] = placed["number"], placed["position"], placed["tier"]
        # containers by attention cost, dealt forth and back, so each group gets its share of costly ones
        out["cost"] = out["tokens"].astype(float) ** 2
        cost = out.groupby(["tier", "number"])["cost"].sum().reset_index().sort_values(["tier", "cost", "number"], ascending=[True, False, True])
        rank = cost.groupby("tier").cumcount()
        groups = cost.groupby("tier")["number"].transform("size").floordiv(step).clip(lower=1)
        lap, at = rank // groups, rank % groups
        cost["step_group"] = at.where(lap % 2 == 0, groups - 1 - at)
        out = out.merge(cost[["tier", "number", "step_group"]], on=["tier", "number"])
        return out[["id", "piece", "start", "tokens", "container", "shard", "number", "position", "step_group"]]

    return dealt.groupBy("shard").applyInPandas(run, schema)
