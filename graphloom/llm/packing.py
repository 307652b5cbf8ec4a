"""Filling fixed-capacity containers with texts.

Cost-balanced packing: a sequence costs its length plus a quadratic attention term for each of
its texts.  Texts go in descending length to the cheapest sequence that still has room.  Whole
containers are cut off texts that exceed one; nothing else is split.  The corpus is dealt into
shards of many containers by a hash, so that each task packs a bounded share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut

CAPACITY = 2048
#: Tokens that one shard holds on average.
SHARD_TOKENS = 4_000_000

_PLACED = "doc_id long, part int, start long, n_tokens long, container long, place int, position long"


def attention_cost(length: np.ndarray | int, capacity: int):
    return length + length * length / capacity


def pack_shard(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container, place) of each length; lengths come in descending order, none above the capacity.

    As many sequences are open from the start as the total needs; another opens when a text
    fits nowhere.  Ties go to the sequence opened first.
    """
    n = max(1, -(-int(lengths.sum()) // capacity))
    room, cost, filled = np.full(n, capacity, np.int64), np.zeros(n), np.zeros(n, np.int64)
    containers, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, length in enumerate(lengths):
        best = int(np.argmin(np.where(room >= length, cost, np.inf)))
        if room[best] < length:
            room, cost, filled = np.append(room, capacity), np.append(cost, 0.0), np.append(filled, 0)
            best = len(room) - 1
        containers[k], places[k] = best, filled[best]
        room[best] -= length
        filled[best] += 1
        cost[best] += attention_cost(length, capacity)
    return containers, places


def _pack(capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "part"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        containers, places = pack_shard(pdf["n_tokens"].to_numpy(np.int64), capacity)
        out = pdf[["doc_id", "part", "start", "n_tokens"]].copy()
        out["container"] = (np.int64(key[0]) << 32) + containers
        out["place"] = places.astype(np.int32)
        by = out.sort_values(["container", "place"])
        out["position"] = (by.groupby("container")["n_tokens"].cumsum() - by["n_tokens"]).astype(np.int64)
        return out

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, part, start, n_tokens, container, place, position) of each piece of each text.

    sizes: (doc_id, n_tokens).  A text above the capacity is cut into whole containers and a
    rest (part 0, 1, ..., beginning at token ``start``); position is the piece's first token in
    its container.  Texts without tokens take no room: container, place and position are null.
    Repeated doc_ids are packed once per row.
    """
    sizes = cut(sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")))
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    parts = F.expr(f"sequence(0, cast((n_tokens - 1) div {capacity} as int))")
    pieces = (
        sizes.where("n_tokens > 0")
        .select("doc_id", "n_tokens", F.explode(parts).alias("part"))
        .select("doc_id", "part", (F.col("part") * F.lit(capacity).cast("long")).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("part") * F.lit(capacity).cast("long")).alias("n_tokens"))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)))
    )
    placed = pieces.groupBy("shard").applyInPandas(_pack(capacity), _PLACED)
    empty = sizes.where("n_tokens = 0").select(
        "doc_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("start"), "n_tokens", F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("long").alias("position")
    )
    return placed.unionByName(empty)


def _filled(packed: DataFrame, capacity: int) -> DataFrame:
    """(container, tokens, pieces, cost, overlaps): what each container holds."""
    n = F.col("n_tokens")
    before = F.lag(F.col("position") + n).over(Window.partitionBy("container").orderBy("place"))
    rows = packed.where("container is not null").withColumn("overlap", F.coalesce(before, F.lit(0)) != F.col("position"))
    return rows.groupBy("container").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.sum(n + n * n / capacity).alias("cost"), F.count_if("overlap").alias("overlaps"))


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, pieces, the share of room that is used, the least fill, and how evenly the cost lies.

    cost_spread is the standard deviation of the containers' attention cost over its mean.
    """
    return _filled(packed, capacity).agg(
        F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("pieces").alias("pieces"), (F.sum("tokens") / (F.count(F.lit(1)) * capacity)).alias("used"), F.min("tokens").alias("least_tokens"),
        F.avg("cost").alias("mean_cost"), (F.stddev_pop("cost") / F.avg("cost")).alias("cost_spread"), F.max("cost").alias("most_cost"),
    )


def soundness(packed: DataFrame, sizes: DataFrame, capacity: int = CAPACITY, least_used: float = 0.98) -> DataFrame:
    """One row that tells whether a packing of the texts of ``sizes`` (doc_id, n_tokens) is what it should be.

    texts and texts without tokens; texts whose pieces are not their tokens; texts split though
    within the capacity; containers above the capacity or with gaps; whether the room is used to
    ``least_used``, a last container per shard aside.
    """
    pieces = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("pieces"), F.count_if(F.col("container").isNull()).alias("bare"))
    texts = sizes.groupBy("doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"), F.sum(F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity))).alias("due"))
    both = texts.join(pieces, "doc_id", "full_outer")
    of_texts = both.agg(
        F.sum("rows").alias("texts"), F.sum("bare").alias("empty_texts"), F.count_if(~F.col("tokens").eqNullSafe(F.col("placed"))).alias("incomplete_texts"), F.count_if(~F.col("pieces").eqNullSafe(F.col("due"))).alias("wrongly_split_texts")
    )
    filled = _filled(packed, capacity).agg(
        F.count_if((F.col("tokens") > capacity) | (F.col("overlaps") > 0)).alias("bad_containers"),
        (F.count(F.lit(1)) <= F.sum("tokens") / (capacity * least_used) + F.count_distinct(F.shiftright("container", 32))).alias("well_filled"),
    )
    return of_texts.crossJoin(filled)  # one row each
