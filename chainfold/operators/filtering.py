"""Which logs are kept: address and topic sets, discovered children, emitter gates, block blooms.

The keep rule is a conjunction of predicates on plain columns, so it is pushed into the scan; small
sets become IN lists, large ones a semi join. Children are found and joined in one plan.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainfold.functions import abi
from chainfold.plans.manifest import Manifest

#: Address sets up to this size are literals of the predicate.
LITERALS = 1_000
#: Tables of addresses with no more rows than this are sent to all tasks: 32 MB of keys and pointers.
BROADCAST_ROWS = 500_000


def keep(logs: DataFrame, addresses: Iterable[bytes] = (), topics: Iterable[bytes] = (), exclude: Iterable[bytes] = (),
         start: int | None = None, end: int | None = None) -> DataFrame:
    """Logs with a topic, in both sets (an empty set allows all) and not excluded, of blocks start to end inclusive."""
    spark = logs.sparkSession
    kept = logs.where(F.col("topic0").isNotNull())
    if start is not None:
        kept = kept.where(F.col("block_number") >= start)
    if end is not None:
        kept = kept.where(F.col("block_number") <= end)
    if topics := list(topics):
        kept = kept.where(F.col("topic0").isin(topics))
    for values, how in ((list(addresses), "left_semi"), (list(exclude), "left_anti")):
        if not values:
            continue
        if len(values) <= LITERALS:
            inside = F.col("address").isin(values)
            kept = kept.where(inside if how == "left_semi" else ~inside)
        else:
            table = spark.createDataFrame([(v,) for v in set(values)], "address binary")
            kept = kept.join(F.broadcast(table) if len(values) <= BROADCAST_ROWS else table, "address", how)
    return kept


def primary_logs(logs: DataFrame, m: Manifest, start: int | None = None, end: int | None = None) -> DataFrame:
    return keep(logs, m.known_addresses, m.primary_topics, start=start, end=end)


def children_of(logs: DataFrame, m: Manifest) -> DataFrame:
    """Distinct addresses that the factories' own creation logs name."""
    found = [
        logs.where((F.col("topic0") == F.lit(f.create_event.topic0)) & (F.col("address") == F.lit(f.address)))
        .select(abi.param_address(f.create_event.parsed, f.spawn_param, F.col("topics"), F.col("data")).alias("address"))
        for f in m.factories
    ]
    if not found:
        return logs.select("address").limit(0)
    return reduce(DataFrame.unionAll, found).distinct()


def child_logs(logs: DataFrame, children: DataFrame, m: Manifest, start: int | None = None, end: int | None = None) -> DataFrame:
    """Logs of children, of all history, without those of statically known addresses."""
    kept = keep(logs, (), m.child_topics, m.known_addresses, start, end)
    return kept.join(sized(children), "address", "left_semi")


def sized(addresses: DataFrame) -> DataFrame:
    """The table, sent to all tasks if a count shows that it is small enough."""
    return F.broadcast(addresses) if addresses.count() <= BROADCAST_ROWS else addresses


def filtered(logs: DataFrame, m: Manifest, start: int | None = None, end: int | None = None) -> DataFrame:
    """Primary and children logs, disjoint by construction, with the bucket that each is in."""
    start = m.start_block if start is None else start
    end = m.end_block if end is None else end
    primary = primary_logs(logs, m, start, end).withColumn("bucket", F.lit("primary"))
    if not m.factories or not m.child_topics:
        return primary
    # creations before a resumed start spawned children too
    children = children_of(primary_logs(logs, m, m.start_block, end), m)
    return primary.unionByName(child_logs(logs, children, m, start, end).withColumn("bucket", F.lit("children")))


def gate(m: Manifest, topic0: Column, address: Column) -> Column:
    """Whether the emitter may emit the log's event; false for topics that no event has."""
    rule = F.lit(False)
    for event in reversed(m.events):
        allowed = m.legitimate(event, address)
        rule = F.when(topic0 == F.lit(event.topic0), F.lit(True) if allowed is None else allowed).otherwise(rule)
    return rule


def admitted(logs: DataFrame, m: Manifest, children: DataFrame) -> DataFrame:
    """The live address gate: known addresses and children, topics unseen."""
    known = logs.where(F.col("address").isin(m.known_addresses))
    others = logs.where(~F.col("address").isin(m.known_addresses)).join(sized(children), "address", "left_semi")
    return known.unionByName(others.select(known.columns))


def dispatch(logs: DataFrame, m: Manifest) -> dict[str, DataFrame]:
    """For each event its logs that pass the gate, decoded as `params`."""
    return {e.name: event_rows(logs, m, e.topic0) for e in m.events}


def event_rows(logs: DataFrame, m: Manifest, topic0: bytes) -> DataFrame:
    event = next(e for e in m.events if e.topic0 == topic0)
    rows = logs.where(F.col("topic0") == F.lit(topic0))
    allowed = m.legitimate(event, F.col("address"))
    rows = rows if allowed is None else rows.where(allowed)
    return rows.withColumn("params", abi.decode_event(event.parsed, F.col("topics"), F.col("data")))


# block blooms

TOPIC_BITS, ADDRESS_BITS, PROBES = 2048, 8192, 7


def bloom_positions(key: bytes, bits: int) -> list[int]:
    """Seven big-endian pairs of bytes of the key, right-padded, modulo the bits."""
    padded = key.ljust(2 * PROBES, b"\0")
    return [int.from_bytes(padded[2 * k : 2 * k + 2], "big") % bits for k in range(PROBES)]


def _positions(keys: list[bytes], bits: int):
    """bloom_positions of many keys, a row for each."""
    import numpy as np

    padded = b"".join([k[: 2 * PROBES].ljust(2 * PROBES, b"\0") for k in keys])
    return np.frombuffer(padded, ">u2").astype("int64").reshape(-1, PROBES) % bits


def _block_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of each block of a partition; a block that goes on in the next batch is carried there, so a large one is few rows."""
    import numpy as np

    width, held = TOPIC_BITS + ADDRESS_BITS, None

    def made(blocks, codes) -> pa.RecordBatch:
        owner, bit = np.divmod(codes, width)
        lists = []
        for here, low in ((bit < TOPIC_BITS, 0), (bit >= TOPIC_BITS, TOPIC_BITS)):
            offsets = np.searchsorted(owner[here], np.arange(len(blocks) + 1)).astype("int32")
            lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array((bit[here] - low).astype("int32"))))
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *lists], ["block_number", "topic_bits", "address_bits"])

    for batch in batches:
        if not batch.num_rows:
            continue
        blocks, place = np.unique(batch.column(0).to_numpy(), return_inverse=True)
        found = []
        for column, bits, low in ((1, TOPIC_BITS, 0), (2, ADDRESS_BITS, TOPIC_BITS)):
            # a key's bits are looked up once, and spread over each block that has it once
            encoded = batch.column(column).dictionary_encode()
            there = encoded.is_valid().to_numpy(zero_copy_only=False)
            if not len(keys := encoded.dictionary):
                continue
            pairs = np.unique(place[there].astype("int64") * len(keys) + encoded.indices.drop_null().to_numpy())
            owner, key = np.divmod(pairs, len(keys))
            found.append((owner[:, None] * width + low + _positions(keys.to_pylist(), bits)[key]).ravel())
        if held is not None:
            k = int(np.searchsorted(blocks, held[0]))
            if k < len(blocks) and blocks[k] == held[0]:
                found.append(k * width + held[1])
            else:
                yield made(np.array([held[0]]), held[1])
        codes = np.unique(np.concatenate([np.empty(0, "int64"), *found]))
        last = len(blocks) - 1
        cut = np.searchsorted(codes, last * width)
        held = (blocks[last], codes[cut:] - last * width)
        if last:
            yield made(blocks[:last], codes[:cut])
    if held is not None:
        yield made(np.array([held[0]]), held[1])


def block_blooms(logs: DataFrame) -> DataFrame:
    """(block_number, topic_bits, address_bits): the set bits of each block's two filters.

    Each partition makes a row for its blocks, not one for each log and bit: those were fourteen times the logs.
    """
    bits = logs.select("block_number", "topic0", "address").mapInArrow(_block_bits, "block_number long, topic_bits array<int>, address_bits array<int>")
    return bits.groupBy("block_number").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("topic_bits", "address_bits")])


def candidate_blocks(blooms: DataFrame, addresses: Iterable[bytes] = (), topics: Iterable[bytes] = (), start: int | None = None, end: int | None = None) -> DataFrame:
    """Blocks that may hold a log of both sets; none that does is missing."""
    def hit(column: str, keys: list[bytes], bits: int) -> Column:
        wanted = [F.array(*map(F.lit, sorted(set(bloom_positions(k, bits))))) for k in keys]
        return reduce(Column.__or__, [F.size(F.array_except(w, F.col(column))) == 0 for w in wanted])

    found = blooms
    if start is not None:
        found = found.where(F.col("block_number") >= start)
    if end is not None:
        found = found.where(F.col("block_number") <= end)
    if keys := list(topics):
        found = found.where(hit("topic_bits", keys, TOPIC_BITS))
    if keys := list(addresses):
        found = found.where(hit("address_bits", keys, ADDRESS_BITS))
    return found.select("block_number").distinct()


def require_dense(blocks: DataFrame, start: int, end: int) -> None:
    """Raise unless every block from start to end is there once."""
    row = blocks.where(F.col("block_number").between(start, end)).agg(
        F.min("block_number").alias("low"), F.max("block_number").alias("high"), F.count("*").alias("n"), F.count_distinct("block_number").alias("d")).first()
    if (row.low, row.high, row.n, row.d) != (start, end, end - start + 1, end - start + 1):
        raise LookupError(f"blocks {start} to {end}: {row.d} of {end - start + 1} are there, {row.n - row.d} twice")


def covers(blocks: DataFrame, start: int, end: int) -> bool:
    try:
        require_dense(blocks, start, end)
    except LookupError:
        return False
    return True
