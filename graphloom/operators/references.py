"""References to records that do not exist.

Keys are dictionary-encoded as integers, references become bitmaps per range of 32,768
keys and per week, and ``reference AND NOT parent`` leaves the bits of those
(key, week) pairs whose parent is not known to live through the week.  Only the surviving
bits are decoded and checked edge by edge against the lives of their key.  A bitmap travels as
the smallest of three containers: positions, runs of positions, or all bits.

Skew: references are reduced to distinct (graph, key, week) groups by a map-side
combine before any join, so a key that holds a third of all edges costs one row a week.  Where
edges meet the verdicts on their keys, groups of very many edges are salted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut

_SURVIVORS = "bucket long, week timestamp, bits array<int>"


def canonical(ref: Column) -> Column:
    """The form in which references and keys are compared: trimmed, lower case; blank is null."""
    stripped = F.lower(F.regexp_replace(ref, r"(?U)^\s+|\s+$", ""))
    return F.when(F.length(stripped) > 0, stripped)


def edge_references(relationships: DataFrame) -> DataFrame:
    """One row per edge and side: rel_id, side, graph, key, at, week.

    A null edge time falls into the week null; such a reference can only be sound by no life.
    """
    sides = F.explode(
        F.array(
            F.struct(F.lit("source").alias("side"), F.col("source_id").alias("ref")),
            F.struct(F.lit("target").alias("side"), F.col("target_id").alias("ref")),
        )
    )
    return (
        relationships.select("rel_id", "graph", F.col("created_at").alias("at"), sides.alias("s"))
        .select("rel_id", "s.side", "graph", canonical(F.col("s.ref")).alias("key"), "at")
        .withColumn("week", F.date_trunc("week", "at"))
    )


def key_lives(entities: DataFrame, modules: DataFrame) -> DataFrame:
    """Every life of every key: (scope, key, born, died); scope is the graph, or '' for modules."""
    inside = entities.select(
        F.col("graph").alias("scope"), canonical(F.col("id")).alias("key"), F.col("created_at").alias("born"), F.col("removed_at").alias("died")
    )
    outside = modules.select(
        F.lit("").alias("scope"), canonical(F.col("target_id")).alias("key"), F.col("added_at").alias("born"), F.col("removed_at").alias("died")
    )
    return inside.unionByName(outside).where("scope is not null and key is not null")


def dictionary(lives: DataFrame) -> DataFrame:
    """(scope, key) -> code: dense within each partition, so that 32,768 neighbours fill one bitmap.

    ``sure_from`` is the birth of the earliest life that never ended.  Codes depend on the
    partitioning, hence they are written out once.
    """
    keys = lives.groupBy("scope", "key").agg(F.min(F.when(F.col("died").isNull(), F.col("born"))).alias("sure_from"))
    return cut(keys.withColumn("code", F.monotonically_increasing_id()))


#: Bits of a bitmap.
RANGE = 32_768
#: Edges of one (graph, key, week) beyond which they are dealt to several tasks.
HOT_ROWS = 1_000_000


def container(bitmap: bytes) -> bytes:
    """The smallest form of a bitmap: a letter, then its positions, the ends of its runs, or its bits."""
    bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")
    edges = np.flatnonzero(np.diff(bits, prepend=0, append=0))
    n = int(bits.sum())
    if 2 * n <= min(2 * len(edges), len(bitmap)):
        return b"p" + np.flatnonzero(bits).astype("<u2").tobytes()
    return b"r" + edges.astype("<u2").tobytes() if 2 * len(edges) < len(bitmap) and (not len(edges) or edges[-1] < 1 << 16) else b"b" + bitmap


def bits_of(packed: bytes) -> np.ndarray:
    """The bits of a container, one byte each."""
    body = packed[1:]
    if packed[:1] == b"b":
        return np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little")
    out = np.zeros(RANGE, np.uint8)
    at = np.frombuffer(body, "<u2").astype(np.int64)
    if packed[:1] == b"p":
        out[at] = 1
    else:
        for first, last in at.reshape(-1, 2):
            out[first:last] = 1
    return out


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["bits"] = [container(b) for b in pdf["bits"]]
        yield pdf


def _survivors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by range and week, the births before the references of a week: referred AND NOT born so far."""
    bucket, known = None, None
    for pdf in batches:
        rows = []
        for b, week, is_birth, packed in zip(pdf["bucket"], pdf["week"], pdf["is_birth"], pdf["bits"]):
            if b != bucket:
                bucket, known = b, np.zeros(RANGE, np.uint8)
            bits = bits_of(packed)
            if is_birth:
                known |= bits
                continue
            left = np.flatnonzero(bits & (1 - known)).astype(np.int32)
            if len(left):
                rows.append((b, week, left))
        yield pd.DataFrame(rows, columns=["bucket", "week", "bits"])


def suspects(groups: DataFrame, codes: DataFrame) -> DataFrame:
    """(code, week) pairs whose key is not surely alive from the start of the week on.

    groups: distinct (code, week) of references.  codes: the dictionary.
    """
    bitmap = F.bitmap_construct_agg(F.bitmap_bit_position(F.col("code") + 1))
    bucket = F.bitmap_bucket_number(F.col("code") + 1).alias("bucket")
    referred = groups.where("week is not null").groupBy(bucket, "week").agg(bitmap.alias("bits")).select("bucket", "week", F.lit(False).alias("is_birth"), "bits")
    # A key is sure from the first week that begins after its birth.
    sure_week = F.when(F.date_trunc("week", "sure_from") == F.col("sure_from"), F.col("sure_from")).otherwise(
        F.date_trunc("week", F.col("sure_from") + F.expr("interval 7 days"))
    )
    born = codes.where("sure_from is not null").groupBy(bucket, sure_week.alias("week")).agg(bitmap.alias("bits")).select("bucket", "week", F.lit(True).alias("is_birth"), "bits")
    packed = referred.unionByName(born).mapInPandas(_packed, "bucket long, week timestamp, is_birth boolean, bits binary")
    left = packed.repartition("bucket").sortWithinPartitions("bucket", "week", F.desc("is_birth")).mapInPandas(_survivors, _SURVIVORS)
    # Bit p of bucket b stands for the code (b - 1) * 32768 + p.
    return left.select("bucket", "week", F.explode("bits").alias("bit")).select(((F.col("bucket") - 1) * RANGE + F.col("bit")).alias("code"), "week")


def orphan_references(relationships: DataFrame, entities: DataFrame, modules: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(rel_id, side, reason, at): references that find no entity or module alive at the edge's time.

    reason is ``missing`` (no row of the key at all; null and blank references too), ``late``
    (every row begins after the edge) or ``deleted``.  An edge without a time finds nothing
    alive: missing or deleted.  Repeated deliveries give one row; empty tables and extra
    columns are no special case; an entity without graph or id is never found.
    """
    refs = edge_references(relationships)
    lives = key_lives(entities, modules)
    codes = dictionary(lives)
    inside = codes.where("scope <> ''").select(F.col("scope").alias("graph"), "key", F.col("code").alias("in_code"))
    outside = codes.where("scope = ''").select("key", F.col("code").alias("out_code"))

    groups = refs.where("key is not null").groupBy("graph", "key", "week").agg(F.count(F.lit(1)).alias("n"))
    coded = (
        groups.join(outside, "key", "left")
        .join(inside, ["graph", "key"], "left")
        .select("graph", "key", "week", "n", F.coalesce("out_code", "in_code").alias("code"), F.col("out_code").isNotNull().alias("is_module"), F.col("in_code").isNotNull().alias("is_entity"))
    )
    coded = cut(coded)
    found = coded.where("code is not null")
    left = suspects(found.select("code", "week"), codes)
    doubtful = found.join(left, ["code", "week"], "left_semi").unionByName(found.where("week is null"))

    # The lives of doubtful keys that touch the week, as few intervals as there are.
    end = F.coalesce(F.col("week") + F.expr("interval 7 days"), F.lit("9999-01-01").cast("timestamp"))
    scopes = F.explode(F.array_compact(F.array(F.when(F.col("is_entity"), F.col("graph")), F.when(F.col("is_module"), F.lit("")))))
    touched = (
        doubtful.select("graph", "key", "week", scopes.alias("scope"))
        .join(lives, ["scope", "key"])
        .groupBy("graph", "key", "week")
        .agg(
            F.min("born").alias("first_born"),
            F.collect_set(
                F.when((F.col("born") < end) & (F.col("died").isNull() | (F.col("died") > F.col("week"))), F.struct("born", "died"))
            ).alias("lives"),
        )
    )
    verdicts = touched.unionByName(coded.where("code is null").select("graph", "key", "week"), allowMissingColumns=True)
    alive = F.exists("lives", lambda x: (x["born"] <= F.col("at")) & (x["died"].isNull() | (x["died"] > F.col("at"))))
    asking, told, on = refs.where("key is not null"), verdicts.withColumnsRenamed({"graph": "v_graph", "key": "v_key", "week": "v_week"}), same_key("graph", "key", "week")
    # Groups of very many edges: at most as many as the edges go into hot_rows, each dealt to as many tasks as that again.
    hot = coded.where(F.col("n") > hot_rows).select("graph", "key", "week", F.ceil(F.col("n") / hot_rows).cast("int").alias("salts"))
    if not hot.isEmpty():
        hot = F.broadcast(hot.withColumnsRenamed({"graph": "h_graph", "key": "h_key", "week": "h_week"}))
        meets = lambda prefix: F.col("h_graph").eqNullSafe(F.col(f"{prefix}graph")) & F.col("h_key").eqNullSafe(F.col(f"{prefix}key")) & F.col("h_week").eqNullSafe(F.col(f"{prefix}week"))
        salts = F.coalesce("salts", F.lit(1))
        asking = asking.join(hot, meets(""), "left").withColumn("salt", F.pmod(F.xxhash64("rel_id", "side"), salts).cast("int")).drop("h_graph", "h_key", "h_week", "salts")
        told = told.join(hot, meets("v_"), "left").withColumn("v_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("h_graph", "h_key", "h_week", "salts")
        on = on & (F.col("salt") == F.col("v_salt"))
    judged = (
        asking.join(told, on)
        .withColumn("reason", F.when(F.col("lives").isNull(), "missing").when(F.coalesce(alive, F.lit(False)), None).when(F.col("first_born") > F.col("at"), "late").otherwise("deleted"))
        .where("reason is not null")
        .select("rel_id", "side", "reason", "at")
    )
    blank = refs.where("key is null").select("rel_id", "side", F.lit("missing").alias("reason"), "at")
    return judged.unionByName(blank).distinct()


def same_key(*names: str) -> Column:
    """Join condition name <=> v_name; null keys meet."""
    on = F.lit(True)
    for name in names:
        on = on & F.col(name).eqNullSafe(F.col(f"v_{name}"))
    return on


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans by the table's reference column, month of the edge and reason."""
    return orphans.groupBy(F.concat(F.lit("relationships."), F.col("side"), F.lit("_id")).alias("reference"), F.date_format("at", "yyyy-MM").alias("period"), "reason").agg(
        F.count(F.lit(1)).alias("n")
    )
