import pytest
from pyspark.sql import functions as F

from chainfold.operators import filtering
from chainfold.plans.erc20 import APPROVAL, TRANSFER
from chainfold.plans.manifest import Contract, Event, Factory, Manifest
from tests.chain import addr, approval, blocks_of, logs_of, transfer, word

A, B, C, FAC = addr(0xA), addr(0xB), addr(0xC), addr(0xFA)
CREATE = Event("Create(address child)")
SYNC = Event("Sync(uint112 a, uint112 b)")


def log(block, address, event, data=b"", log_=0, topics=()):
    return (block, 0, log_, address, [event.topic0, *topics], event.topic0, data, None)


def places(df):
    return [tuple(r) for r in df.select("block_number", "log_index").orderBy("block_number", "log_index").collect()]


def test_keep_rule(spark):
    rows = [transfer(100, A, B, 1, token=A), transfer(101, A, B, 1, token=B), approval(102, A, B, 1, token=A), (103, 0, 0, A, [], None, b"", None), transfer(104, A, B, 1, token=C)]
    logs = logs_of(spark, rows)
    at = lambda **kw: [b for b, _ in places(filtering.keep(logs, **kw))]
    assert at() == [100, 101, 102, 104]  # a log without topics never counts
    assert at(addresses=[A]) == [100, 102] and at(topics=[TRANSFER.topic0]) == [100, 101, 104]
    assert at(addresses=[A, B], topics=[TRANSFER.topic0]) == [100, 101]
    assert at(exclude=[A]) == [101, 104] and at(start=101, end=102) == [101, 102]
    many = [A, *(n.to_bytes(20, "big") for n in range(filtering.LITERALS + 5))]
    assert at(addresses=many) == [100, 102] and at(exclude=many) == [101, 104]


def test_filter_thousand_blocks(spark):
    rows = [r for n in range(100, 1100) for r in ([transfer(n, A, B, 1, token=A), approval(n, A, B, 1, token=B, log=1)] if n % 2 == 0 else [log(n, C, CREATE)])]
    m = Manifest("m", 1, 100, contracts=(Contract("a", A, (TRANSFER,)), Contract("b", B, (APPROVAL,))))
    kept = filtering.filtered(logs_of(spark, rows), m)
    row = kept.agg(F.count("*").alias("n"), F.count_distinct("block_number").alias("blocks"), F.max(F.col("block_number") % 2).alias("odd")).first()
    assert (row.n, row.blocks, row.odd) == (1000, 500, 0)
    m = Manifest("m", 1, 100, end_block=119, contracts=m.contracts)
    assert filtering.filtered(logs_of(spark, rows), m).select("block_number").distinct().count() == 10


def factory_logs():
    return [log(100, FAC, CREATE, word(addr(1)), 0), log(100, FAC, CREATE, word(addr(2)), 1), log(100, FAC, CREATE, word(addr(3)), 2),
            log(99, addr(2), SYNC), log(101, addr(1), SYNC), log(103, addr(3), SYNC), log(104, C, SYNC),
            log(105, C, CREATE, word(C)), log(106, FAC, SYNC)]


def test_factory(spark):
    m = Manifest("m", 1, 0, factories=(Factory("f", FAC, CREATE, "child", (SYNC,)),))
    logs = logs_of(spark, factory_logs())
    kept = filtering.filtered(logs, m)
    by = {b: sorted({r.block_number for r in kept.where(F.col("bucket") == b).collect()}) for b in ("primary", "children")}
    # a create log of another address discovers nothing; children count from before their creation; the factory is no child
    assert by == {"primary": [100], "children": [99, 101, 103]}
    assert {bytes(r.address) for r in filtering.children_of(logs, m).collect()} == {addr(1), addr(2), addr(3)}


def count(spark, m, rows, event):
    return filtering.event_rows(filtering.filtered(logs_of(spark, rows), m), m, event.topic0).count()


def test_gates(spark):
    two = Manifest("m", 1, 0, contracts=(Contract("a", A, (TRANSFER,)), Contract("b", B, (APPROVAL,))))
    rows = [transfer(1, A, B, 1, token=A), approval(2, A, B, 1, token=A), transfer(3, A, B, 1, token=B), approval(4, A, B, 1, token=B)]
    assert count(spark, two, rows, TRANSFER) == 1 and count(spark, two, rows, APPROVAL) == 1
    three = Manifest("m", 1, 0, contracts=(Contract("a", A, (TRANSFER,)), Contract("b", B, (TRANSFER,)), Contract("c", C, (APPROVAL,))))
    assert count(spark, three, [transfer(k, A, B, 1, token=t) for k, t in enumerate((A, B, C))], TRANSFER) == 2
    child = Manifest("m", 1, 0, contracts=(Contract("x", C, (TRANSFER,)),), factories=(Factory("f", FAC, CREATE, "child", (SYNC,)),))
    rows = [log(1, FAC, CREATE, word(addr(1))), log(2, addr(1), SYNC), log(3, C, SYNC), transfer(4, A, B, 1, token=C), transfer(5, A, B, 1, token=addr(1))]
    assert count(spark, child, rows, SYNC) == 1 and count(spark, child, rows, TRANSFER) == 1 and count(spark, child, rows, CREATE) == 1
    single = Manifest("m", 1, 0, contracts=(Contract("a", A, (TRANSFER, APPROVAL)),))
    assert single.legitimate(single.events[0], F.col("address")) is None
    gated = logs_of(spark, rows).select(filtering.gate(child, F.col("topic0"), F.col("address")).alias("g"))
    assert [r.g for r in gated.collect()] == [True, True, False, True, False]


def test_admitted(spark):
    m = Manifest("m", 1, 0, contracts=(Contract("a", A, (TRANSFER,)),))
    children = spark.createDataFrame([(B,)], "address binary")
    rows = [transfer(k, A, B, 1, token=t) for k, t in enumerate((A, B, C))]
    assert [b for b, _ in places(filtering.admitted(logs_of(spark, rows), m, children))] == [0, 1]


def test_blooms(spark):
    assert filtering.bloom_positions(TRANSFER.topic0, filtering.TOPIC_BITS) == [1522, 685, 994, 155, 450, 104, 1079]
    token = bytes.fromhex("ae78736Cd615f374D3085123A210448E74Fc6393")
    assert filtering.bloom_positions(token, filtering.ADDRESS_BITS) == [3704, 4972, 5653, 4980, 4872, 4387, 528]
    logs = logs_of(spark, [transfer(1, A, B, 1, token=token), approval(2, A, B, 1, token=token), transfer(3, A, B, 1, token=B), (4, 0, 0, C, [], None, b"", None)])
    blooms = filtering.block_blooms(logs)
    row = blooms.where("block_number = 1").first()
    assert set(row.topic_bits) == {1522, 685, 994, 155, 450, 104, 1079} and set(row.address_bits) == {3704, 4972, 5653, 4980, 4872, 4387, 528}
    found = lambda *a: sorted(r.block_number for r in filtering.candidate_blocks(blooms, *a).collect())
    assert found([token], [TRANSFER.topic0]) == [1] and found((), [TRANSFER.topic0]) == [1, 3] and found([token]) == [1, 2] and found() == [1, 2, 3, 4]


def test_density(spark):
    blocks = blocks_of(spark, [1, 2, 3, 5])
    filtering.require_dense(blocks, 1, 3)
    assert filtering.covers(blocks, 2, 3) and not filtering.covers(blocks, 1, 5) and not filtering.covers(blocks.unionAll(blocks), 1, 3)
    with pytest.raises(LookupError):
        filtering.require_dense(blocks, 3, 5)


def test_block_filters_are_made_by_partition(spark):
    """A partition gives a row for each of its blocks; those of a block that several partitions hold are put together."""
    import pyarrow as pa

    keys = [bytes([k]) * 20 for k in range(60)]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["block_number", "topic0", "address"])
    many = list(filtering._block_bits(iter([batch([(1, b"\1" * 32, k), (2, None, k)]) for k in keys[:50]] + [batch([(2, b"\2" * 32, keys[50])])])))
    assert sum(b.num_rows for b in many) < 110
    one = list(filtering._block_bits(iter([batch([(7, b"\1" * 32, k)]) for k in keys])))
    assert [b.num_rows for b in one] == [1]
    df = spark.createDataFrame([(k % 3, (bytes([k % 5]) * 32) if k % 4 else None, keys[k]) for k in range(60)] + [(9, None, b"\x01")], "block_number long, topic0 binary, address binary").repartition(4)
    got = {r.block_number: r for r in filtering.block_blooms(df).collect()}
    for n in (0, 1, 2, 9):
        mine = [r for r in df.collect() if r.block_number == n]
        assert got[n].address_bits == sorted({p for r in mine for p in filtering.bloom_positions(bytes(r.address), filtering.ADDRESS_BITS)})
        assert got[n].topic_bits == sorted({p for r in mine if r.topic0 is not None for p in filtering.bloom_positions(bytes(r.topic0), filtering.TOPIC_BITS)})


def test_a_key_of_many_logs_is_looked_up_once_a_batch(monkeypatch):
    import pyarrow as pa

    asked, real = [], filtering._positions
    monkeypatch.setattr(filtering, "_positions", lambda keys, bits: asked.append(len(keys)) or real(keys, bits))
    topics, addresses = [bytes([1]) * 32, None, bytes([2]) * 32], [addr(5), addr(6)]
    rows = [(k // 300, topics[k % 3], addresses[k % 2]) for k in range(900)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[c] for r in rows], pa.binary()) for c in (1, 2)]], ["block_number", "topic0", "address"])
    made = {r["block_number"]: r for b in filtering._block_bits(iter([batch])) for r in b.to_pylist()}
    bits = lambda keys, n: sorted({p for k in keys if k for p in filtering.bloom_positions(k, n)})
    assert asked == [2, 2] and sorted(made) == [0, 1, 2]
    for r in made.values():
        assert r["topic_bits"] == bits(topics, filtering.TOPIC_BITS) and r["address_bits"] == bits(addresses, filtering.ADDRESS_BITS)
    none = pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), pa.array([None], pa.binary()), pa.array([None], pa.binary())], ["block_number", "topic0", "address"])
    assert [r for b in filtering._block_bits(iter([none])) for r in b.to_pylist()] == [{"block_number": 7, "topic_bits": [], "address_bits": []}]
