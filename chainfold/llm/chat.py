"""Chat formatting by multi-party perspective rotation.

A dialogue is rendered once for each participant: that speaker is the assistant, the others are named
users, system turns stay system turns. Masks are the code-point spans of what the assistant says, end
marks included, so that training counts those only.

A dialogue is rendered in parts of TURNS turns, so that one of any length is spread over tasks and no
row grows without bound. Every participant gets every part, with no mask where they are silent, so
the parts of a perspective, by block and sub, add up to the whole dialogue; rows are parts times
participants. Where more than CROWD messages share a part (many with the same turn numbers), the part
is cut further, in order, into pieces of CROWD // 2 messages.

Rows repeated exactly are one message. Messages of one turn are ordered by role and text. A null turn
comes before all others, a null role is the speaker `unknown`, a null text is empty, and null
conv_ids form one dialogue. A dialogue with system turns only is rendered once, with a null perspective
and no mask. `<|` inside names and texts gets a blank between its characters, so no message can forge
a mark. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

TURNS = 64
CROWD = 4096
BROADCAST_ROWS = 20_000
END = "<|end|>"


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _block() -> Column:
    return F.expr(f"coalesce(cast(floor(turn / {TURNS}) as bigint), -1)")


def _role() -> Column:
    return _plain(F.coalesce("role", F.lit("unknown")))


def _cut(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows of crowded parts with sub: pieces in order, ranked by range so that no task holds a part."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.save(rows.repartitionByRange(n, "conv_id", "block", "turn", "role", "text").withColumn("_p", F.spark_partition_id()), "placed")
    upto = Window.partitionBy("conv_id", "block").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = scratch.save(placed.groupBy("conv_id", "block", "_p").agg(F.count("*").alias("n")).select(
        F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), F.col("_p").alias("_q"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_before")), "before")
    place = F.row_number().over(Window.partitionBy("conv_id", "block", "_p").orderBy("turn", "role", "text"))
    return placed.withColumn("_place", place).join(_small(before), F.expr("conv_id <=> _conv and block = _block and _p = _q")).withColumn(
        "sub", F.expr(f"cast((_before + _place - 1) div {max(1, CROWD // 2)} as int)")).drop("_conv", "_block", "_p", "_q", "_before", "_place")


def messages(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, block, turn, role, text, sub): distinct messages and the part that each is in; and the (_conv, _block) of crowded parts."""
    rows = conversations.select("conv_id", "turn", _role().alias("role"), _plain(F.coalesce("text", F.lit(""))).alias("text")).distinct()
    rows = rows.withColumn("block", _block())
    crowds = scratch.save(rows.groupBy("conv_id", "block").agg(F.count("*").alias("n")).where(f"n > {CROWD}").select(
        F.col("conv_id").alias("_conv"), F.col("block").alias("_block")), "crowds")
    if crowds.isEmpty():
        return rows.withColumn("sub", F.lit(0)), crowds
    crowded, at = _small(crowds), F.expr("conv_id <=> _conv and block = _block")
    return rows.join(crowded, at, "left_anti").withColumn("sub", F.lit(0)).unionByName(_cut(rows.join(crowded, at, "left_semi"), scratch)), crowds


def participants(conversations: DataFrame, crowds: DataFrame, scratch: Scratch) -> DataFrame:
    """(_conv, _who) of the dialogues of more than one part; a null _who where all turns are system's."""
    blocks = conversations.groupBy("conv_id").agg(F.min(_block()).alias("low"), F.max(_block()).alias("high")).where("low < high")
    long = scratch.save(blocks.select(F.col("conv_id").alias("_conv")).unionAll(crowds.select("_conv")).distinct(), "long")
    roles = conversations.select("conv_id", _role().alias("_who")).join(_small(long), F.expr("conv_id <=> _conv"), "left_semi").where("_who <> 'system'").distinct()
    return scratch.save(long.join(roles, F.expr("conv_id <=> _conv"), "left").select("_conv", "_who"), "participants")


def rotate(conversations: DataFrame) -> DataFrame:
    """One row per dialogue, part and participant: conv_id, block, sub, perspective, n_turns, rendered and mask, an array of (s, e)."""
    scratch = Scratch(conversations.sparkSession, "chat")
    rows, crowds = messages(conversations, scratch)
    parts = rows.groupBy("conv_id", "block", "sub").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # a dialogue of one part has its participants at hand
    own = F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), lambda r: r != "system"))
    others = _small(participants(conversations, crowds, scratch).withColumn("_long", F.lit(True)))
    each = parts.join(others, F.expr("conv_id <=> _conv"), "left").select(
        "conv_id", "block", "sub", "turns", F.explode_outer(F.when(F.col("_long"), F.array("_who")).otherwise(own)).alias("perspective"))
    mine = lambda t: F.coalesce(t["role"] == F.col("perspective"), F.lit(False))
    pieces = F.transform("turns", lambda t: F.struct(
        F.when(mine(t), F.lit("<|assistant|>\n")).when(t["role"] == "system", F.lit("<|system|>\n"))
        .otherwise(F.concat(F.lit("<|user:"), t["role"], F.lit("|>\n"))).alias("head"),
        F.concat(t["text"], F.lit(END)).alias("body"), mine(t).alias("mine")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int>>)").alias("mask"))
    step = lambda a, p: F.struct(
        (a["at"] + F.char_length(p["head"]) + F.char_length(p["body"]) + 1).alias("at"),
        F.when(p["mine"], F.array_append(a["mask"], F.struct(
            (a["at"] + F.char_length(p["head"])).alias("s"), (a["at"] + F.char_length(p["head"]) + F.char_length(p["body"])).alias("e"))))
        .otherwise(a["mask"]).alias("mask"))
    return each.withColumn("pieces", pieces).select(
        "conv_id", "block", "sub", "perspective", F.size("turns").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("rendered"),
        F.aggregate("pieces", start, step, lambda a: a["mask"]).alias("mask"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations")).select(
        "conv_id", "block", "sub", "perspective", F.col("n_turns").cast("long").alias("n_turns"), "rendered",
        F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["s"].cast("string"), m["e"].cast("string"))), ",").alias("mask"))


ORACLE = f"""
WITH rows AS (SELECT DISTINCT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role,
    replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
placed AS (SELECT *, coalesce(CAST(floor(turn / {TURNS}) AS BIGINT), -1) AS block FROM rows),
cut AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY conv_id, block) > {CROWD}
    THEN CAST((row_number() OVER (PARTITION BY conv_id, block ORDER BY turn NULLS FIRST, role, text) - 1) // {CROWD // 2} AS INTEGER) ELSE 0 END AS sub FROM placed),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM placed WHERE role <> 'system'
    UNION ALL SELECT conv_id, NULL FROM placed GROUP BY conv_id HAVING bool_and(role = 'system')),
pieces AS (SELECT p.conv_id, p.block, p.sub, perspective, turn, role, text, coalesce(role = perspective, false) AS mine,
    CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user:' || role || '|>' END || chr(10) AS head,
    text || '{END}' AS body FROM cut p JOIN speakers s ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
located AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, block, sub, perspective
    ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS s FROM pieces)
SELECT conv_id, block, sub, perspective, count(*) AS n_turns,
    string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
    coalesce(string_agg(CAST(s AS VARCHAR) || '-' || CAST(s + length(body) AS VARCHAR), ',' ORDER BY s) FILTER (mine), '') AS mask
FROM located GROUP BY conv_id, block, sub, perspective"""
