"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target in words; a document's expected copies are target / words of its source.
Whole copies are taken as they are; the fractions are rounded so that a source's words are kept:
two documents with fractional copies meet, words move at random from one to the other until one is
integral, and what is left meets the next. The expectation of every document is unchanged, and the
words of a source differ from its target by less than one document. Each node also hands some of its
settled documents, of all sizes, up to the next; the root of a source's tree flips a few of those that
it holds, largest first, while that brings the words nearer to the target. So a source ends within
about its smallest documents of the target, and expectations are exact for all but one node's documents.

The pairing is a reduction tree. Leaves are buckets of about LEAF documents by a hash of the id, so
a source of any size is spread over many tasks; each leaf leaves one document at most, and those it
carries, and LEAF leaves meet in a node of the next level. The randomness is a hash of the ids that
meet, so reruns agree.

Nulls: a null source is a source of its own, after all others; a null text has no words. Documents
without words, and sources without words, take nothing. Repeated rows are separate documents; those
without an id are told apart by their place in the table. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WHITE_WORD, Scratch, table

WEIGHTS = (5, 2, 1)
CAP = 3
LEAF = 256
#: Settled documents that the nodes below one node hand up to it together, one each at least.
CARRY = 128
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, n_docs, target): water filling of all words by weight under `cap` times each source.

    With sources sorted by how early their cap binds, the level at which the rest share is a running
    sum away; no loop. One row per source passes through the single-partition windows.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    choose = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    rows = by.withColumn("weight", choose.cast("double")).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    early = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = early.rowsBetween(Window.unboundedPreceding, -1)
    after = early.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = early.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level)
    # the first source, in that order, whose cap is not below its share sets the level for all after it
    rows = rows.withColumn("level", F.first(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level")), ignorenulls=True).over(every))
    return rows.select("source", "source_size", "n_docs", F.least(
        F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(_MIX[0])
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


def pivot(p: np.ndarray, size: np.ndarray, key: np.ndarray, seed: int) -> np.ndarray:
    """Round probabilities so that sum(p * size) is kept and at most one of them stays fractional.

    All neighbours of a level meet at once; each meeting makes one of its two integral.
    """
    p = p.astype(float).copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    level = 0
    while len(left) > 1:
        paired = len(left) // 2 * 2
        i, j = left[0:paired:2], left[1:paired:2]
        room_i, room_j = (1 - p[i]) * size[i], (1 - p[j]) * size[j]
        mass_i, mass_j = p[i] * size[i], p[j] * size[j]
        up, down = np.minimum(room_i, mass_j), np.minimum(mass_i, room_j)
        salt = np.uint64((seed * 1_000_003 + level) % (1 << 63))
        draw = _mixed(_mixed(key[i] ^ salt) ^ key[j]) / 2.0**64
        rise = draw * (up + down) < down
        first_ends = np.where(rise, room_i <= mass_j, mass_i <= room_j)
        move = np.where(rise, up, -down)
        next_i, next_j = p[i] + move / size[i], p[j] - move / size[j]
        next_i = np.where(first_ends, np.where(rise, 1.0, 0.0), next_i)
        next_j = np.where(first_ends, next_j, np.where(rise, 0.0, 1.0))
        for at, new in ((i, next_i), (j, next_j)):
            p[at] = np.where(new < 1e-9, 0.0, np.where(new > 1 - 1e-9, 1.0, new))
        left = left[(p[left] > 0) & (p[left] < 1)]
        level += 1
    return p


def settle(p: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Round the last fraction of a source, then flip documents, largest first, that bring the words nearer."""
    p = p.copy()
    rest = np.flatnonzero((p > 0) & (p < 1))
    short = float((p[rest] * size[rest]).sum())
    p[rest] = _mixed(key[rest] ^ np.uint64(0xD1CE)) / 2.0**64 < p[rest]
    short -= float((p[rest] * size[rest]).sum())
    for k in np.lexsort((key, -size)):
        gain = size[k] if p[k] == 0 else -size[k]
        if abs(short - gain) < abs(short):
            p[k], short = 1 - p[k], short - gain
    return p


_NODE = "_key string, _node long, _rid long, _hash long, size long, _p double, _docs long, _up boolean"


def carried(p: np.ndarray, size: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Which rows go on to the next level: those still fractional, and n others evenly from the smallest to the largest."""
    up = (p > 0) & (p < 1)
    done = np.flatnonzero(~up)
    done = done[np.lexsort((key[done], size[done]))]
    up[done[np.linspace(0, len(done) - 1, n).astype(int)] if len(done) > n else done] = True
    return up


def _node_rounder(level: int, held: int, carry: int):
    """held: how many documents a node of the level stands for; a source of no more has its root here."""
    def round_node(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_hash", "_rid"], kind="stable", ignore_index=True)
        key, size = rows["_hash"].to_numpy(np.int64).view(np.uint64), rows["size"].to_numpy(float)
        p = pivot(rows["_p"].to_numpy(float), size, key, level)
        if rows["_docs"].iloc[0] <= held:
            return rows.assign(_p=settle(p, size, key), _up=False)
        siblings = min(LEAF, -(-int(rows["_docs"].iloc[0]) // held))
        return rows.assign(_p=p, _up=carried(p, size, key, max(1, carry // siblings)))

    return round_node


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (an int), and the columns of `keep`."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    sizes = docs.select("doc_id", "source", *keep, F.regexp_count(
        F.coalesce(F.col("text"), F.lit("")), F.lit(WHITE_WORD)).cast("long").alias("size"))
    rows = scratch.save(sizes.withColumn("_rid", F.monotonically_increasing_id()), "rows")
    targets = scratch.save(source_targets(rows, weights, cap), "targets").withColumnRenamed("source", "_source")
    few = targets.agg(F.count("*").alias("n"), F.max("n_docs").alias("docs")).first()
    rows = rows.join(F.broadcast(targets) if few.n <= 50_000 else targets, F.col("source").eqNullSafe(F.col("_source")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("_whole", F.floor(rate).cast("int")).withColumn("_p", rate - F.floor(rate))
    loose = rows.where("size > 0 and _p > 0").select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_key"),
        F.pmod(F.xxhash64(F.coalesce("doc_id", "_rid")), F.ceil(F.col("n_docs") / LEAF)).alias("_node"),
        "_rid", F.xxhash64(F.coalesce("doc_id", "_rid"), "size").alias("_hash"), "size", "_p", F.col("n_docs").alias("_docs"), F.lit(True).alias("_up"),
    )
    nodes, level, settled = max(1, -(-(few.docs or 1) // LEAF)), 0, []
    while True:
        done = nodes <= 1
        out = scratch.save(loose.groupBy("_key", "_node").applyInPandas(_node_rounder(level, LEAF ** (level + 1), CARRY), _NODE), f"level{level}")
        settled.append(out.where("not _up").select("_rid", F.col("_p").cast("int").alias("_extra")))
        if done:
            break
        loose = out.where("_up").withColumn("_node", F.expr(f"_node div {LEAF}"))
        nodes, level = -(-nodes // LEAF), level + 1
    extra = settled[0]
    for more in settled[1:]:
        extra = extra.unionAll(more)
    # decisions are as many as documents: they are the hashed side at every size, so texts are never sorted
    return rows.join(extra.hint("shuffle_hash"), "_rid", "left").select(
        "doc_id", "source", *keep, "size", "source_size", "target",
        (F.col("_whole") + F.coalesce("_extra", F.lit(0))).alias("copies"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
