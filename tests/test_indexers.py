import json

from chainfold.functions.keccak import selector
from chainfold.plans import erc20, pairs, registry
from chainfold.plans.runner import Indexer, Reader
from chainfold.sources.store import BlockStore
from tests.chain import addr, blocks_of, logs_of, number, transfer, word

FACTORY = addr(0xFA)


def created(block, pair):
    return (block, 0, 0, FACTORY, [pairs.CREATED.topic0, word(addr(8)), word(addr(9))], pairs.CREATED.topic0, word(addr(pair)) + word(1), None)


def sync(block, pair, a, b, log=1):
    return (block, 0, log, addr(pair), [pairs.SYNC.topic0], pairs.SYNC.topic0, word(a) + word(b), None)


def swap(block, pair, log=2):
    topic = pairs.swap(False).topic0
    return (block, 0, log, addr(pair), [topic, word(addr(3)), word(addr(4))], topic, b"".join(word(n) for n in (1, 2, 3, 4)), None)


def moved(event, block, pair, a, b, log):
    return (block, 0, log, addr(pair), [event.topic0, word(addr(3)), word(addr(4))][: 3 if event is pairs.BURN else 2], event.topic0, word(a) + word(b), None)


def fetch(calls):
    out = []
    for target, data in calls:
        if data == selector("token0()"):
            out.append((0, word(addr(target[0] + 50))))
        elif data == selector("token1()"):
            out.append((1, b"") if target[0] == 2 else (0, word(addr(target[0] + 100))))
        elif data == selector("symbol()"):
            out.append((0, word(32) + word(3) + b"ABC".ljust(32, b"\0")) if target[0] == 51 else (1, b""))
        else:
            out.append((0, word(6)) if target[0] == 51 else (1, b""))
    return out


def test_pairs(spark, tmp_path):
    store = BlockStore(spark, f"{tmp_path}/store")
    store.append(logs_of(spark, [created(1, 1), sync(1, 1, 5, 6), swap(1, 1), created(2, 2), moved(pairs.MINT, 2, 2, 8, 9, 5), sync(3, 1, 7, 8), swap(3, 77), moved(pairs.BURN, 3, 1, 2, 1, 6)]), blocks_of(spark, [1, 2, 3]))
    indexer = Indexer(spark, store, f"{tmp_path}/run", pairs.manifest(FACTORY), pairs.handler, fetch)
    indexer.run()
    assert indexer.stats == {"scanned_blocks": 4, "matched_blocks": 3, "kept_logs": 7}

    def rows():
        return {r.id[0]: (r.first_token[0], r.second_token and r.second_token[0], r.first_decimals, r.second_decimals, r.first_reserve and int(r.first_reserve), r.second_reserve and int(r.second_reserve),
                          r.first_symbol and bytes(r.first_symbol)) for r in indexer.state.view().table("pools").collect()}

    assert rows() == {1: (51, 101, 6, 18, 7, 8, b"ABC"), 2: (52, None, 18, 18, None, None, None)}
    store.append(logs_of(spark, [sync(4, 2, 1, 2), swap(4, 2)]), blocks_of(spark, [4]))
    indexer.run()
    assert rows() == {1: (51, 101, 6, 18, 7, 8, b"ABC"), 2: (52, None, 18, 18, 1, 2, None)}
    trades = Reader(indexer).range("trades", 0, 10)
    assert [(t["pool"][0], t["caller"][0], t["signer"], number(t["first_in"]), number(t["second_out"])) for t in trades] == [(1, 3, None, 1, 4), (2, 3, None, 1, 4)]
    assert [(c["pool"][0], c["added"], number(c["first_amount"])) for c in Reader(indexer).range("liquidity_changes", 0, 10)] == [(2, 1, 8), (1, 0, 2)]


def test_pools_made_before_the_first_block(spark, tmp_path):
    """A pool whose creation is out of the window, but known as a child, gets its tokens when it trades; trades have their signer."""
    from chainfold.plans.manifest import Contract
    from chainfold.sources.schemas import TXS

    store = BlockStore(spark, f"{tmp_path}/store")
    m = pairs.manifest(FACTORY, start_block=1, with_signer=True)
    store.append(logs_of(spark, [created(1, 1), swap(2, 1)]), blocks_of(spark, [1, 2]), spark.createDataFrame([(1, 0, 2, addr(8), None, word(1), False), (2, 0, 2, addr(9), None, word(1), False)], TXS))
    indexer = Indexer(spark, store, f"{tmp_path}/run", m, pairs.handler, fetch)
    indexer.run()
    assert [bytes(t["signer"]) for t in Reader(indexer).range("trades", 0, 5)] == [addr(9)]
    asked = {(bytes(r.target)[0], bytes(r.calldata)) for r in indexer.cache().collect()}
    assert (1, selector("token0()")) in asked and (51, selector("symbol()")) in asked
    late = pairs.Manifest("late", 1, 2, contracts=(Contract("old", addr(1), (pairs.SYNC, pairs.swap(False), pairs.MINT, pairs.BURN, pairs.CREATED)),), prefetch=m.prefetch[1:], entities=pairs.ENTITIES)
    other = Indexer(spark, store, f"{tmp_path}/late", late, pairs.handler, fetch)
    other.run()
    assert [(r.id[0], r.first_token[0]) for r in other.state.view().table("pools").collect()] == [(1, 51)]


def registered(block, label, name, expires):
    data = word(0x60) + word(5) + word(expires) + word(len(name)) + name.ljust(-(-len(name) // 32) * 32, b"\0")
    return (block, 0, 0, addr(7), [registry.REGISTERED.topic0, bytes([label]) * 32, word(addr(label))], registry.REGISTERED.topic0, data, None)


def test_registry(spark, tmp_path):
    store = BlockStore(spark, f"{tmp_path}/store")
    store.append(logs_of(spark, [registered(1, 1, b"alice", 10), registered(2, 2, b"a name of more than thirty-two bytes", 11), registered(3, 1, b"alice", 99)]), blocks_of(spark, [1, 2, 3]))
    indexer = Indexer(spark, store, f"{tmp_path}/run", registry.manifest(addr(7)), registry.handler)
    indexer.run()
    rows = {r.label[0]: (bytes(r.text), number(r.until)) for r in indexer.state.view().table("labels").collect()}
    assert rows == {1: (b"alice", 99), 2: (b"a name of more than thirty-two bytes", 11)} and Reader(indexer).count("claims") == 3


def test_spawn(spark, tmp_path):
    store = BlockStore(spark, f"{tmp_path}/store")
    token, a, b = addr(0xAE), addr(1), addr(2)
    store.append(logs_of(spark, [transfer(100, a, b, 5)]), blocks_of(spark, [100]))
    indexer = Indexer(spark, store, f"{tmp_path}/run", erc20.manifest(token, start_block=100), erc20.handler)
    (tmp_path / "heads").mkdir()
    (tmp_path / "heads" / "1.json").write_text(json.dumps({"head": 101}))
    source = spark.readStream.schema("head long").json(f"{tmp_path}/heads")

    def read(batch):
        head = max(r.head for r in batch.collect())
        if head == 103:
            raise OSError("the node is gone")
        return blocks_of(spark, [head]), logs_of(spark, [transfer(head, a, b, 7)]), head - 1

    query = indexer.spawn(source, read, f"{tmp_path}/c", processingTime="100 milliseconds")
    reader = Reader(indexer)
    try:
        query.processAllAvailable()
        assert number(reader.read("accounts", b)["balance"]) == 12 and reader.cursor == 100
        (tmp_path / "heads" / "2.json").write_text(json.dumps({"head": 102}))
        query.processAllAvailable()
        assert number(reader.read("accounts", b)["balance"]) == 19 and reader.cursor == 101 and reader.follow_error is None
        (tmp_path / "heads" / "3.json").write_text(json.dumps({"head": 103}))
        try:
            query.processAllAvailable()
        except Exception:
            pass
        assert "the node is gone" in reader.follow_error
    finally:
        query.stop()
