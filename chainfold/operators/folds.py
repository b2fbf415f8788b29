"""Folds of ordered logs into keyed state and event tables.

Handlers of the algebraic kinds are declared: a fold names its key, and each column how it follows
from the logs in order. They become one aggregation for each entity, with map-side sums and maxima in
place of an ordered replay. A handler that must see prior state uses `keyed_reduce`, which runs in
order for each key, all keys apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from chainfold.functions import abi, u256
from chainfold.sources.schemas import ORDER


#: Blocks that a running state is summed over in one go.
STRETCH = 10_000


def position() -> Column:
    """A log's place in the order of all logs."""
    return F.struct(*ORDER)


def balances(legs: DataFrame, key: str = "id", value: str = "value", sign: str = "sign") -> DataFrame:
    """(key, balance): the sum of sign * value modulo 2**256. A key appears even if its sum is 0."""
    return legs.groupBy(key).agg(u256.signed_sum(F.col(value), F.col(sign)).alias("balance"))


def transfer_legs(transfers: DataFrame, source: str = "from", target: str = "to", value: str = "value") -> DataFrame:
    """Two signed rows for each transfer; the zero address is debited on a mint like any other."""
    return transfers.select(*ORDER, F.explode(F.array(
        F.struct(F.col(f"`{source}`").alias("id"), F.lit(-1).alias("sign")),
        F.struct(F.col(f"`{target}`").alias("id"), F.lit(1).alias("sign")),
    )).alias("leg"), F.col(f"`{value}`").alias("value")).select(*ORDER, "leg.id", "leg.sign", "value")


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The last row of each key in log order."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), position()).alias("_r"))
    return best.select(*keys, *[F.col("_r").getField(c).alias(c) for c in rest])


def merge_columns(branches: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """One row for each key; every column has its last non-null value over all branches, which may lack columns."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)
    return rows.groupBy(key).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), position())).alias(c) for c in columns])


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("count"))


def _sums_before(rows: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """rows with, for each value, its sum over the key's earlier rows.

    A key's history is cut at every STRETCH blocks: sums within a stretch, and over the stretches
    before, of which there is one row for each, so a key of any length is spread over many tasks.
    """
    cut = rows.withColumns({"_stretch": F.floor(F.col("block_number") / STRETCH), **{f"_v{k}": v for k, v in enumerate(values.values())}})
    order = Window.partitionBy(key, "_stretch").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = cut.groupBy(key, "_stretch").agg(*[F.sum(f"_v{k}").alias(f"_t{k}") for k in range(len(values))])
    totals = totals.select(F.col(key).alias("_key"), F.col("_stretch").alias("_s"), *[F.coalesce(F.sum(f"_t{k}").over(earlier), zero).alias(f"_b{k}") for k in range(len(values))])
    inside = cut.withColumns({name: F.coalesce(F.sum(f"_v{k}").over(order), zero) for k, name in enumerate(values)})
    joined = inside.join(totals, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_stretch") == F.col("_s")))
    return joined.withColumns({name: F.col(name) + F.col(f"_b{k}") for k, name in enumerate(values)}).drop(
        "_stretch", "_key", "_s", *[f"_{x}{k}" for k in range(len(values)) for x in "vb"])


def state_before(rows: DataFrame, key: str, value: Column, start: Column | int = 0) -> DataFrame:
    """rows with `before`: start and the sum of the key's values in logs before each, as a handler would read it."""
    return _sums_before(rows, key, {"before": value}).withColumn("before", F.col("before") + start)


def word_state_before(rows: DataFrame, key: str, word: str, sign: str) -> DataFrame:
    """As state_before, for 256-bit words."""
    parts = {f"_limb{k}": u256.limb(F.col(word), k) * F.col(sign) for k in range(u256.LIMBS)}
    return _sums_before(rows, key, parts).withColumn("before", u256.from_limbs([F.col(p) for p in parts])).drop(*parts)


def event_rows(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """An append-only table: the event id as key, and a projection."""
    return rows.select(abi.event_id(*[F.col(c) for c in ORDER]).alias("id"), *columns)


class KeyOutOfOrder(ValueError):
    """An immutable key does not increase."""


def require_increasing(existing: DataFrame | None, added: DataFrame, key: str = "id") -> None:
    """Raise unless the added keys are unique, not null, and all beyond the existing ones.

    Equal keys meet in a group-by, and only a key that is there twice or null comes out of it.
    """
    wrong = added.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).first()
    if wrong is not None:
        raise KeyOutOfOrder(f"added key {wrong[key]!r} is null" if wrong[key] is None else f"added key {wrong[key]!r} is there {wrong.n} times")
    low = added.agg(F.min(key).alias("low")).first().low
    if existing is not None and low is not None:
        high = existing.agg(F.max(key).alias("high")).first().high
        plain = lambda x: bytes(x) if isinstance(x, (bytes, bytearray)) else x
        if high is not None and plain(low) <= plain(high):
            raise KeyOutOfOrder(f"added key {low!r} is not beyond {high!r}")


def merge_state(committed: DataFrame | None, delta: DataFrame, key: str) -> DataFrame:
    """Committed rows without those that the delta replaces, and the delta."""
    if committed is None:
        return delta
    return committed.join(delta.select(key), key, "left_anti").unionByName(delta.select(committed.columns))


def changed_sums(committed: DataFrame | None, delta: DataFrame, key: str = "id", value: str = "balance") -> DataFrame:
    """The new sums modulo 2**256 of the delta's keys, and of no others."""
    if committed is None:
        return delta
    touched = committed.select(key, value).join(delta.select(key), key, "left_semi")
    return touched.unionByName(delta.select(key, value)).groupBy(key).agg(u256.signed_sum(F.col(value)).alias(value))


def add_balances(committed: DataFrame | None, delta: DataFrame, key: str = "id", value: str = "balance") -> DataFrame:
    """Committed sums plus the delta's, modulo 2**256."""
    if committed is None:
        return delta
    both = committed.select(key, value).unionByName(delta.select(key, value))
    return both.groupBy(key).agg(u256.signed_sum(F.col(value)).alias(value))


def newest(layers: list[DataFrame], key: str) -> DataFrame:
    """One row for each key: that of the last layer which has it."""
    if len(layers) == 1:
        return layers[0]
    every = reduce(DataFrame.unionByName, [rows.withColumn("_layer", F.lit(k)) for k, rows in enumerate(layers)])
    rest = [c for c in layers[0].columns if c != key]
    best = every.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col("_layer")).alias("_r"))
    return best.select(*[F.col(key) if c == key else F.col("_r").getField(c).alias(c) for c in layers[0].columns])


def keyed_reduce(rows: DataFrame, key: str, step: Callable[[dict | None, dict], dict | None], schema: str, state: DataFrame | None = None) -> DataFrame:
    """Run step(state, log) over each key's logs in order; the last state of each key is its row.

    step must be a function of its arguments alone, since a task may run again. Keys are spread over
    tasks and sorted within them, so a key of any length streams through without being gathered.
    """
    out = T.StructType.fromDDL(schema)
    names = rows.columns
    flagged = rows.select("*", F.lit(None).cast(out).alias("_state"))
    if state is not None:
        old = state.select(F.struct(*[F.col(f.name) for f in out.fields]).alias("_state"), F.col(key))
        flagged = flagged.unionByName(old, allowMissingColumns=True)
    ordered = flagged.repartition(key).sortWithinPartitions(key, F.col("_state").isNull(), *ORDER)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now, done = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row[key] != at:
                    if now is not None:
                        done.append(now)
                    at, now = row[key], None
                if row["_state"] is not None:
                    now = dict(row["_state"])
                else:
                    now = step(now, {n: row[n] for n in names})
            if done:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([now], arrow)

    return ordered.mapInArrow(run, out)


def replay(rows: DataFrame, step: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """Run a handler of many keys over all logs in order, in one task: the caller accepts that this does not scale."""
    out = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([r for row in batch.to_pylist() for r in step(row)], arrow)

    return rows.coalesce(1).sortWithinPartitions(*ORDER).mapInArrow(run, out)


def replay_stretches(rows: DataFrame, step: Callable[[DataFrame | None, DataFrame], DataFrame], keep: Callable[[DataFrame, int], DataFrame],
                     state: DataFrame | None = None, most: int = 100_000) -> DataFrame | None:
    """Fold logs in stretches of whole blocks of about `most` logs, in order: state = keep(step(state, logs), last block).

    keep writes the state and reads it back, so a run that stops goes on from the last stretch. Each
    stretch is distributed work; only the stretches follow each other.
    """
    edges = rows.groupBy("block_number").agg(F.count("*").alias("n"))
    upto = Window.orderBy("_thousand").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_thousand").orderBy("block_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = edges.withColumn("_thousand", F.floor(F.col("block_number") / 1000)).withColumn("_sum", F.sum("n").over(inside))
    # a row for each thousand blocks
    before = edges.groupBy(F.col("_thousand").alias("_t")).agg(F.sum("n").alias("n")).withColumnRenamed("_t", "_thousand").select(
        F.col("_thousand").alias("_t"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_before"))
    stretch = edges.join(before, F.col("_thousand") == F.col("_t")).groupBy(F.expr(f"(_before + _sum - 1) div {most}").alias("s")).agg(
        F.min("block_number").alias("low"), F.max("block_number").alias("high")).orderBy("s")
    for r in stretch.toLocalIterator():
        state = keep(step(state, rows.where(F.col("block_number").between(r.low, r.high))), r.high)
    return state
