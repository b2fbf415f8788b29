"""Joins that add what a log itself lacks: its transaction, its time, cached call results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainfold.sources.schemas import OK, REVERTED

MERGE_BLOCK, MERGE_TIME = 15_537_394, 1_663_224_162
SLOT, OLD_SLOT = 12, 13


def with_transactions(logs: DataFrame, txs: DataFrame) -> DataFrame:
    """logs with `tx`; a log without its transaction fails the job."""
    tx = txs.select("block_number", "tx_index", F.struct("tx_type", "from", "to", "value", "from_unrecovered").alias("tx"), F.lit(True).alias("_there"))
    joined = logs.join(tx, ["block_number", "tx_index"], "left")
    checked = F.when(F.col("_there"), F.col("tx")).otherwise(F.raise_error(F.format_string(
        "MissingTxRecord: block %d, transaction %d", F.col("block_number"), F.col("tx_index"))).cast("struct<tx_type:int,from:binary,to:binary,value:binary,from_unrecovered:boolean>"))
    return joined.withColumn("tx", checked).drop("_there")


def tx_mask(logs: DataFrame) -> DataFrame:
    """The transactions that emitted logs."""
    return logs.select("block_number", "tx_index").distinct()


def select_by_mask(txs: DataFrame, mask: DataFrame) -> DataFrame:
    """The transactions of a mask; one that is missing fails the job."""
    there = txs.withColumn("_there", F.lit(True))
    joined = mask.join(there, ["block_number", "tx_index"], "left")
    return joined.where(F.when(F.col("_there"), F.lit(True)).otherwise(F.raise_error(F.format_string(
        "MissingTxRecord: block %d, transaction %d", F.col("block_number"), F.col("tx_index"))).cast("boolean"))).drop("_there")


def creation_aware(txs: DataFrame) -> DataFrame:
    """txs read from records with `flags`: a set lowest bit means that the transaction created a contract and has no `to`."""
    return txs.withColumn("to", F.when(F.col("flags").bitwiseAND(1) == 0, F.col("to")))


def block_time(block: Column) -> Column:
    """The estimate of a block's time: 12 seconds a block from the merge on, 13 before it, 0 at least."""
    after = MERGE_TIME + (block - MERGE_BLOCK) * SLOT
    before = F.greatest(F.lit(0).cast("long"), MERGE_TIME - (MERGE_BLOCK - block) * OLD_SLOT)
    return F.when(block >= MERGE_BLOCK, after).otherwise(before).cast("long")


def with_time(logs: DataFrame, blocks: DataFrame) -> DataFrame:
    """logs with `timestamp`: the block's own, or the estimate where it is unknown (null or 0)."""
    known = blocks.select("block_number", F.nullif("ts", F.lit(0)).alias("_ts"))
    return logs.join(known, "block_number", "left").withColumn(
        "timestamp", F.coalesce("_ts", block_time(F.col("block_number")))).drop("_ts")


def current_calls(cache: DataFrame) -> DataFrame:
    """One result for each call: the last written."""
    return cache.groupBy("target", "calldata").agg(F.max_by(F.struct("status", "value"), F.col("seq")).alias("r")).select(
        "target", "calldata", "r.status", "r.value")


def with_call(rows: DataFrame, cache: DataFrame, target: Column, calldata: Column, name: str = "call") -> DataFrame:
    """rows with a struct of the call's value and its state: ok, reverted or not_prefetched."""
    results = current_calls(cache).select(F.col("target").alias("_t"), F.col("calldata").alias("_c"), F.col("status").alias("_s"), F.col("value").alias("_v"))
    joined = rows.withColumns({"_target": target, "_data": calldata}).join(
        results, (F.col("_target") == F.col("_t")) & (F.col("_data") == F.col("_c")), "left")
    state = F.when(F.col("_s").isNull(), "not_prefetched").when(F.col("_s") == REVERTED, "reverted").otherwise("ok")
    return joined.withColumn(name, F.struct(state.alias("state"), F.when(F.col("_s") == OK, F.col("_v")).alias("value"))).drop(
        "_t", "_c", "_s", "_v", "_target", "_data")


def require_call(call: Column) -> Column:
    """The value, or a failure that says why there is none."""
    return F.when(call["state"] == "ok", call["value"]).when(
        call["state"] == "reverted", F.raise_error("CallReverted").cast("binary")).otherwise(F.raise_error("NotPrefetched").cast("binary"))
