import pytest
from pyspark.sql import functions as F

from chainfold.plans.erc20 import TRANSFER
from chainfold.plans.manifest import Contract, Event, Factory, Manifest
from chainfold.streaming import live
from tests.chain import addr, blocks_of, logs_of, transfer, word

TOKEN = addr(0xAE)
M = Manifest("m", 1, 0, contracts=(Contract("t", TOKEN, (TRANSFER,)),))


def follower(spark, seen, cursor=99, manifest=M, depth=64):
    children = spark.createDataFrame([], "address binary")
    return live.Follower(spark, manifest, children, cursor, lambda final, children, to, batch: seen.append((sorted(r.block_number for r in final.collect()), to)), depth)


def snapshot(spark, numbers, salt=b"", logs=None):
    return blocks_of(spark, numbers, salt), logs_of(spark, [transfer(n, addr(1), addr(2), 1) for n in (numbers if logs is None else logs)])


def test_finality(spark):
    assert live.can_finalize(100, 164) and not live.can_finalize(100, 163)
    final, rest = live.split_final(blocks_of(spark, range(100, 110)), 168)
    assert (final.count(), rest.count()) == (5, 5)
    live.check_gap(100, 1164)
    with pytest.raises(live.StaleBaseline):
        live.check_gap(100, 1165)


def test_snapshots(spark):
    live.require_snapshot(blocks_of(spark, range(1, 65)))
    live.require_snapshot(blocks_of(spark, []))
    for bad in ([1, 2, 4], range(1, 67)):
        with pytest.raises(LookupError):
            live.require_snapshot(blocks_of(spark, bad))
    assert live.linked(blocks_of(spark, [1, 2, 3])).count() == 0
    mixed = blocks_of(spark, [1, 2]).unionAll(blocks_of(spark, [3], b"x"))
    assert [r.block_number for r in live.linked(mixed).collect()] == [3]


def test_fork_point(spark):
    ring = blocks_of(spark, range(1, 6))
    assert live.fork_point(ring, ring) is None
    assert live.fork_point(ring, blocks_of(spark, range(1, 4)).unionAll(blocks_of(spark, range(4, 8), b"x"))) == 4
    with pytest.raises(live.ReorgExceedsFinalityDepth):
        live.fork_point(ring, blocks_of(spark, range(1, 6), b"x"))


def test_classify(spark):
    before = blocks_of(spark, range(1, 7))
    after = blocks_of(spark, [3, 4]).unionAll(blocks_of(spark, [5, 6, 7], b"x"))
    c = live.changes(before, after, 2)
    assert (c.reorg_from, c.new, c.finalized, c.reorged_out) == (5, [7], [1, 2], [])
    c = live.changes(before, blocks_of(spark, range(1, 5)), 0)
    assert (c.reorg_from, c.new, c.reorged_out) == (5, [], [5, 6])
    assert live.changes(before, before, 0) == live.Changes()


def test_promote_and_reorg(spark):
    seen = []
    f = follower(spark, seen)
    f.tick(*snapshot(spark, [100, 101, 102]), last_final=99, batch_id=0)
    assert f.tip_logs().count() == 3 and seen == []
    blocks = blocks_of(spark, [100, 101]).unionAll(blocks_of(spark, [102], b"x", parent=b""))
    changed = f.tick(blocks, snapshot(spark, [], logs=[100, 101, 102, 102])[1].dropDuplicates(["block_number"]), last_final=99, batch_id=1)
    assert changed.reorg_from == 102 and f.tip_logs().count() == 3
    later = blocks_of(spark, [101]).unionAll(blocks_of(spark, [102, 103], b"x", parent=b""))
    f.tick(later, snapshot(spark, [101, 102, 103])[1], last_final=100, batch_id=2)
    assert seen == [([100], 100)] and f.cursor == 100 and f.tip_logs().count() == 3
    # a repeated batch is ignored
    f.tick(*snapshot(spark, [102, 103]), last_final=101, batch_id=2)
    assert seen == [([100], 100)]


def test_fatal_reorganisations(spark):
    f = follower(spark, [], cursor=100)
    f.tick(*snapshot(spark, [100, 101]), last_final=100)
    with pytest.raises(live.ReorgExceedsFinalityDepth):
        f.tick(*snapshot(spark, [100, 101], b"x"), last_final=100)
    g = follower(spark, [], cursor=99)
    g.tick(*snapshot(spark, [100, 101]), last_final=99)
    with pytest.raises(live.ReorgExceedsFinalityDepth):
        g.tick(*snapshot(spark, [100, 101], b"x"), last_final=100)


def test_backlog_counts_as_new(spark):
    f = follower(spark, [], cursor=0)
    assert f.tick(*snapshot(spark, [100, 101]), last_final=99).new == [100, 101]


def test_children_of_the_same_block(spark):
    create, sync = Event("Create(address child)"), Event("Sync(uint256 n)")
    m = Manifest("m", 1, 0, factories=(Factory("f", addr(9), create, "child", (sync,)),))
    rows = [(100, 0, 0, addr(9), [create.topic0], create.topic0, word(addr(5)), None), (100, 0, 1, addr(5), [sync.topic0], sync.topic0, word(1), None),
            (100, 0, 2, addr(6), [sync.topic0], sync.topic0, word(1), None)]
    seen = []
    f = follower(spark, seen, manifest=m)
    f.tick(blocks_of(spark, [100]), logs_of(spark, rows), last_final=99)
    assert f.tip_logs().count() == 2
    f.tick(blocks_of(spark, [101]), logs_of(spark, [(101, 0, 0, addr(5), [sync.topic0], sync.topic0, word(1), None)]), last_final=100)
    assert seen == [([100, 100], 100)] and f.tip_logs().count() == 1


def test_stream(spark, tmp_path):
    heads = tmp_path / "heads"
    heads.mkdir()
    (heads / "1.json").write_text('{"head": 103}\n')
    seen = []
    f = follower(spark, seen, depth=2)

    def read(batch):
        head = batch.agg(F.max("head")).first()[0]
        final = head - 2
        return (*snapshot(spark, range(100, head + 1)), min(final, f.cursor + 1) if f.pending else f.cursor)

    source = spark.readStream.schema("head long").json(str(heads))
    query = live.follow(source, f, read, str(tmp_path / "checkpoint"), processingTime="100 milliseconds")
    try:
        query.processAllAvailable()
        assert f.cursor == 99 and f.tip_logs().count() == 4
        (heads / "2.json").write_text('{"head": 104}\n')
        query.processAllAvailable()
    finally:
        query.stop()
    assert seen == [([100], 100)] and f.cursor == 100 and f.tip_logs().count() == 4
