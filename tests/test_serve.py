import json

import pytest
from pyspark.sql import functions as F

from chainfold.functions import u256
from chainfold.plans.erc20 import TRANSFER
from chainfold.sources import rpc
from chainfold.sources.schemas import TXS
from chainfold.sources.store import PendingStore
from chainfold.streaming.live import ReorgExceedsFinalityDepth
from chainfold.streaming.serve import Subscription
from tests.chain import addr, blocks_of, logs_of, transfer, word

A, B, T = addr(1), addr(2), addr(0xAE)


def blocks_in(frame):
    return sorted(r.block_number for r in frame.logs.collect())


def test_subscription(spark):
    with pytest.raises(ValueError, match="filter"):
        Subscription()
    logs = logs_of(spark, [transfer(n, A, B, 1, token=T if n % 2 == 0 else addr(9)) for n in range(100, 110)])
    sub = Subscription([T], [TRANSFER.topic0], cursor=101)
    push, beat = sub.backfill(logs, 105)
    assert (push.kind, blocks_in(push), beat.kind, beat.block, sub.cursor) == ("push", [102, 104], "heartbeat", 105, 105)
    assert [f.kind for f in sub.backfill(logs, 105)] == ["heartbeat"]
    frames = sub.poll(blocks_of(spark, [106, 107]), logs, 105)
    assert [f.kind for f in frames] == ["push", "heartbeat"] and blocks_in(frames[0]) == [106]
    changed = blocks_of(spark, [106]).unionAll(blocks_of(spark, [107, 108], b"x"))
    frames = sub.poll(changed, logs, 105)
    assert [(f.kind, f.block) for f in frames] == [("reorg", 107), ("push", 108), ("heartbeat", 105)] and blocks_in(frames[1]) == [108]
    assert blocks_in(sub.add_address(addr(9), logs, 103)) == [103, 105, 107] and addr(9) in sub.addresses
    with pytest.raises(ReorgExceedsFinalityDepth):
        sub.poll(blocks_of(spark, [106, 107, 108], b"y"), logs, 106)


def test_subscription_with_transactions(spark):
    txs = spark.createDataFrame([(100, 0, 0, A, None, word(1), False), (100, 1, 0, B, None, word(1), False)], TXS)
    push = Subscription([T], with_txs=True).backfill(logs_of(spark, [transfer(100, A, B, 1, tx=1)]), 100, txs)[0]
    assert [bytes(r["from"]) for r in push.txs.collect()] == [B]
    more = logs_of(spark, [transfer(100, A, B, 1, tx=1), transfer(101, A, B, 1)])
    assert [tuple(r) for r in rpc.missing_txs(more, txs).collect()] == [(101, 0)]


def test_pending_store(spark, tmp_path):
    store = PendingStore(spark, f"{tmp_path}/pending")
    assert store.read()[0].count() == 0
    store.write(blocks_of(spark, [100, 101, 102]), logs_of(spark, [transfer(n, A, B, 1) for n in (100, 101, 102)]))
    numbers = lambda: sorted(r.block_number for r in store.read()[0].collect())
    store.insert(blocks_of(spark, [102, 103], b"x"), logs_of(spark, [transfer(103, A, B, 1)]))
    assert numbers() == [100, 101, 102, 103] and sorted(r.block_number for r in store.read()[1].collect()) == [100, 101, 103]
    store.truncate(103)
    store.drop_final(100)
    assert numbers() == [101, 102] and store.number() == 4 and store.read()[2] is None
    with pytest.raises(LookupError):
        store.write(blocks_of(spark, [100, 102]), logs_of(spark, []))
    store.write(blocks_of(spark, [101]), logs_of(spark, []), spark.createDataFrame([], TXS))
    assert store.read()[2].count() == 0


def test_head_stream(spark, tmp_path):
    rpc.register(spark)
    (tmp_path / "head.json").write_text(json.dumps({"head": 7}))
    heads = []
    query = (spark.readStream.format("chain_head").option("url", f"file:{tmp_path}/head.json").load().writeStream
             .foreachBatch(lambda df, _: heads.extend(r.head for r in df.collect())).option("checkpointLocation", f"{tmp_path}/c")
             .trigger(processingTime="100 milliseconds").start())
    try:
        query.processAllAvailable()
        (tmp_path / "head.json").write_text(json.dumps({"head": 9}))
        query.processAllAvailable()
    finally:
        query.stop()
    assert heads == [7, 9]


def test_little_endian(spark):
    x = 0x0102030405
    row = spark.range(1).select(u256.from_little_endian(F.lit(x.to_bytes(32, "little"))).alias("w")).first()
    assert int.from_bytes(row.w, "big") == x
