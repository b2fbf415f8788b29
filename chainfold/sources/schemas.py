"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

LOGS = T.StructType([
    T.StructField("block_number", T.LongType(), False),
    T.StructField("tx_index", T.IntegerType(), False),
    T.StructField("log_index", T.IntegerType(), False),
    T.StructField("address", T.BinaryType(), False),
    T.StructField("topics", T.ArrayType(T.BinaryType()), False),
    T.StructField("topic0", T.BinaryType(), True),
    T.StructField("data", T.BinaryType(), False),
    T.StructField("tx_hash", T.BinaryType(), True),
])
BLOCKS = T.StructType([
    T.StructField("block_number", T.LongType(), False),
    T.StructField("block_hash", T.BinaryType(), True),
    T.StructField("parent_hash", T.BinaryType(), True),
    T.StructField("ts", T.LongType(), True),
])
TXS = T.StructType([
    T.StructField("block_number", T.LongType(), False),
    T.StructField("tx_index", T.IntegerType(), False),
    T.StructField("tx_type", T.IntegerType(), True),
    T.StructField("from", T.BinaryType(), True),
    T.StructField("to", T.BinaryType(), True),
    T.StructField("value", T.BinaryType(), True),
    T.StructField("from_unrecovered", T.BooleanType(), True),
])
CALL_CACHE = T.StructType([
    T.StructField("target", T.BinaryType(), False),
    T.StructField("calldata", T.BinaryType(), False),
    T.StructField("status", T.IntegerType(), False),
    T.StructField("value", T.BinaryType(), True),
    T.StructField("seq", T.LongType(), False),
])
ORDER = ("block_number", "tx_index", "log_index")
#: Blocks below the head that may still change.
FINALITY = 64
#: Width of the folder that a block's rows are stored in.
BUCKET = 100_000
OK, REVERTED = 0, 1
