"""Metadata calls: gather what the manifest declares, once each, in rounds as deep as the calls chain."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainfold.functions import abi
from chainfold.functions.keccak import selector
from chainfold.plans.manifest import Call, Manifest, Prefetch
from chainfold.sources.schemas import CALL_CACHE, OK, ORDER

from .enrich import current_calls

#: Calls in one batch of a fetcher.
BATCH = 500

#: (target, calldata) pairs to (status, value) pairs; None marks a batch that failed and is asked again later.
Fetch = Callable[[list[tuple[bytes, bytes]]], list[tuple[int, bytes]] | None]


def calldata(d: Prefetch, call: Call) -> Column:
    """The selector and the arguments' words."""
    words = [abi.param_word(d.on_event.parsed, a, F.col("topics"), F.col("data")) if isinstance(a, str) else F.lit(a) for a in call.args]
    return F.concat(F.lit(selector(call.method)), *words)


def static_calls(spark: SparkSession, m: Manifest) -> DataFrame:
    rows = [(c.address, selector(c.method)) for c in m.static_prefetch]
    return spark.createDataFrame(rows, "target binary, calldata binary")


def _targets(logs: DataFrame, cache: DataFrame, d: Prefetch, k: int) -> DataFrame:
    """The event's logs with the target of its k-th call as `_at<k>`, null where it is not known yet."""
    call, name = d.calls[k], f"_at{k}"
    if call.target.kind == "log":
        return logs.withColumn(name, F.col("address"))
    if call.target.kind == "param":
        return logs.withColumn(name, abi.param_address(d.on_event.parsed, call.target.name, F.col("topics"), F.col("data")))
    j = d.producer(k)
    rows = logs if f"_at{j}" in logs.columns else _targets(logs, cache, d, j)
    done = current_calls(cache).where(F.col("status") == OK).select(
        F.col("target").alias("_t"), F.col("calldata").alias("_c"), F.col("value").alias("_v"))
    at = 32 * call.target.index
    # the word must be there whole: a short return names no address
    address = F.when(F.octet_length("_v") >= at + 32, F.substring("_v", at + 13, 20))
    return rows.withColumn("_d", calldata(d, d.calls[j])).join(
        done, (F.col(f"_at{j}") == F.col("_t")) & (F.col("_d") == F.col("_c")), "left").withColumn(name, address).drop("_t", "_c", "_v", "_d")


def gather(logs: DataFrame, cache: DataFrame, m: Manifest) -> DataFrame:
    """(target, calldata, first): each call that can be made now once, with the place of the log that first needs it.

    Logs are matched by topic alone.
    """
    spark = logs.sparkSession
    static = static_calls(spark, m).withColumn("first", F.struct(*[F.lit(-1).cast("long").alias(c) for c in ORDER]))
    found = [static]
    for d in m.prefetch:
        rows = logs.where(F.col("topic0") == F.lit(d.on_event.topic0))
        for k, call in enumerate(d.calls):
            placed = _targets(rows, cache, d, k).where(F.col(f"_at{k}").isNotNull())
            found.append(placed.select(F.col(f"_at{k}").alias("target"), calldata(d, call).alias("calldata"),
                                       F.struct(*[F.col(c).cast("long").alias(c) for c in ORDER]).alias("first")))
    calls = reduce(DataFrame.unionByName, found)
    return calls.groupBy("target", "calldata").agg(F.min("first").alias("first"))


def missing(calls: DataFrame, cache: DataFrame) -> DataFrame:
    return calls.join(cache.select("target", "calldata"), ["target", "calldata"], "left_anti")


def fetch_all(calls: DataFrame, fetch: Fetch, seq: int) -> DataFrame:
    """Results of the calls in batches, on the executors; a failed batch is left out and the others stand."""
    def run(frames):
        import pandas as pd

        for frame in frames:
            pairs = [(bytes(t), bytes(c)) for t, c in zip(frame["target"], frame["calldata"], strict=True)]
            for k in range(0, len(pairs), BATCH):
                part = pairs[k : k + BATCH]
                results = fetch(part)
                if results is not None:
                    yield pd.DataFrame([(t, c, s, v, seq) for (t, c), (s, v) in zip(part, results, strict=True)], columns=CALL_CACHE.names)

    return calls.select("target", "calldata").mapInPandas(run, CALL_CACHE)


def run_rounds(logs: DataFrame, m: Manifest, cache: DataFrame, fetch: Fetch, write: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Gather, drop what is cached, fetch, as often as the deepest chain is long. write(results, round) keeps them and returns the whole cache.

    Calls are dealt to as many tasks as run at once: they are few bytes, and what coalesces small partitions would leave one task to fetch all.
    They are dealt by a hash of their own, since a deal by the columns of the join before is taken as done.
    """
    tasks = logs.sparkSession.sparkContext.defaultParallelism
    for k in range(m.prefetch_depth):
        asked = missing(gather(logs, cache, m), cache).repartition(tasks, F.xxhash64("target", "calldata"))
        cache = write(fetch_all(asked, fetch, k + 1), k)
    return cache
