"""Remote clients over a shared folder, and the commands that follow a recorded node."""

import json

import pytest
from pyspark.sql import functions as F

from chainfold import cli
from chainfold.functions.keccak import checksummed
from chainfold.plans import erc20
from chainfold.plans.manifest import Contract, Entity, Event, Factory, Manifest
from chainfold.plans.runner import Delta, Indexer, State, TxFieldsUnavailable
from chainfold.operators import folds
from chainfold.sources import receipts, rpc
from chainfold.sources.receipts import rlp_encode
from chainfold.sources.schemas import ORDER, TXS
from chainfold.sources.store import BlockStore, PendingStore
from chainfold.streaming import remote
from chainfold.streaming.live import ReorgExceedsFinalityDepth
from tests.chain import addr, blocks_of, logs_of, number, transfer, word

T, A, B = addr(0xAE), addr(1), addr(2)


@pytest.fixture
def there(spark, tmp_path):
    store, pending = BlockStore(spark, f"{tmp_path}/store"), PendingStore(spark, f"{tmp_path}/pending")
    return store, pending, remote.Server(spark, store, pending, f"{tmp_path}/shared")


def balance(indexer):
    return {bytes(r.id): number(r.balance) for r in indexer.state.view().table("accounts").collect()}


def spans(spark, numbers, salt=b"", value=1, parent=None):
    return logs_of(spark, [transfer(n, A, B, value) for n in numbers]), blocks_of(spark, numbers, salt, parent)


def test_frames():
    assert remote.decode(remote.encode({"kind": "push", "number": 3})) == {"kind": "push", "number": 3}
    for bad in ("", "[]", '{"kind": "other", "number": 1}', '{"kind": "push"}'):
        with pytest.raises(remote.FrameError):
            remote.decode(bad)


def test_push_promote_reorg_and_reconnect(spark, there, tmp_path):
    store, pending, server = there
    store.append(*spans(spark, range(100, 103)))
    pending.write(*reversed(spans(spark, range(103, 106))))
    indexer = Indexer(spark, store, f"{tmp_path}/run", erc20.manifest(T, start_block=100), erc20.handler)
    client = remote.remote_indexer(indexer, f"{tmp_path}/shared")
    assert server.poll() == 3 and client.step() == 3
    assert client.cursor == 102 and balance(indexer)[B] == 3 and client.pending().count() == 3
    # a reorganisation drops what was pushed, the new blocks come instead
    pending.truncate(104)
    logs, blocks = spans(spark, range(104, 107), b"x", 10, parent=b"")
    pending.insert(blocks, logs)
    server.poll()
    client.step()
    assert {r.block_number: number(r.data) for r in client.pending().collect()} == {103: 1, 104: 10, 105: 10, 106: 10}
    store.append(*spans(spark, [103]))
    store.append(*spans(spark, [104], b"x", 10))
    pending.drop_final(104)
    server.poll()
    client.step()
    assert client.cursor == 104 and balance(indexer)[B] == 14 and sorted(r.block_number for r in client.pending().collect()) == [105, 106]
    # a client that comes back has its cursor and gets what is pending again
    again = remote.remote_indexer(indexer, f"{tmp_path}/shared")
    remote.Server(spark, store, pending, f"{tmp_path}/shared").poll()
    again.step()
    assert again.cursor == 104 and sorted(r.block_number for r in again.pending().collect()) == [105, 106] and balance(indexer)[B] == 14
    again.requests.write({"kind": "register", "addresses": [], "topics": [], "cursor": 0, "txs": False})
    with pytest.raises(remote.Gone, match="filter"):
        fresh = remote.Server(spark, store, pending, f"{tmp_path}/shared")
        fresh.poll()
        again.frames.at = 0
        again.step()


def test_a_deep_reorganisation_is_fatal(spark, there, tmp_path):
    store, pending, server = there
    store.append(*spans(spark, range(100, 103)))
    done = []
    client = remote.Client(spark, f"{tmp_path}/shared", erc20.manifest(T), lambda *a: done.append(a), 99)
    server.poll()
    client.step()
    assert client.cursor == 102 and len(done) == 1
    remote.Channel(spark, f"{tmp_path}/shared/{client.name}/frames", remote.KINDS).write({"kind": "reorg", "block": 101})
    frames = remote.Channel(spark, f"{tmp_path}/shared/{client.name}/frames", remote.KINDS)
    frames.at = client.frames.at
    frames.write({"kind": "reorg", "block": 101})
    with pytest.raises(ReorgExceedsFinalityDepth):
        client.step()


CREATE, SYNC = Event("Create(address child)"), Event("Sync(uint256 n)")
FACTORY = Manifest("m", 1, 100, factories=(Factory("f", addr(9), CREATE, "child", (SYNC,)),), entities=(Entity("Total", "mutable", (("id", "b20"), ("n", "u256"))),))


def totals(events, context):
    rows = events["Sync"].select(*ORDER, F.col("address").alias("id"), F.col("params.n").alias("n"))
    return State(mutable={"totals": Delta(folds.latest(rows, "id").select("id", "n"), "id")})


def test_children_are_loaded_from_their_creation(spark, there, tmp_path):
    store, pending, server = there
    create = lambda n, child: (n, 0, 0, addr(9), [CREATE.topic0], CREATE.topic0, word(addr(child)), None)
    sync = lambda n, child, v: (n, 0, child, addr(child), [SYNC.topic0], SYNC.topic0, word(v), None)
    store.append(logs_of(spark, [create(100, 5), sync(100, 5, 1), sync(101, 5, 2), sync(101, 6, 3)]), blocks_of(spark, [100, 101]))
    indexer = Indexer(spark, store, f"{tmp_path}/run", FACTORY, totals)
    client = remote.remote_indexer(indexer, f"{tmp_path}/shared")
    rows = lambda: {r.id[0]: number(r.n) for r in indexer.state.view().table("totals").collect()}
    for _ in range(2):
        server.poll()
        client.step()
    assert client.cursor == 101 and rows() == {5: 2}
    store.append(logs_of(spark, [create(102, 6), sync(102, 6, 7), sync(102, 5, 8)]), blocks_of(spark, [102]))
    for _ in range(2):
        server.poll()
        client.step()
    assert client.cursor == 102 and rows() == {5: 8, 6: 7}
    again = remote.remote_indexer(indexer, f"{tmp_path}/shared")
    store.append(logs_of(spark, [sync(103, 5, 9), sync(103, 6, 10)]), blocks_of(spark, [103]))
    remote.Server(spark, store, pending, f"{tmp_path}/shared").poll()
    again.step()
    assert rows() == {5: 9, 6: 10}


def record(path, head, fork=10**9, most=7, low=0):
    """A node's recording: a transfer of 1 to B in every block, of 100 from the fork on."""
    h = lambda n: "0x" + f"{n:062x}{'ff' if n >= fork else '00'}"
    x = lambda raw: "0x" + raw.hex()
    blocks = [{"number": hex(n), "hash": h(n), "parentHash": h(n - 1), "timestamp": hex(1_700_000_000 + n), "transactions": [
        {"blockNumber": hex(n), "transactionIndex": hex(k), "type": "0x2", "from": x(A), "to": x(T), "value": hex(n)} for k in range(2)]} for n in range(low, head + 1)]
    logs = [{"blockNumber": hex(n), "transactionIndex": "0x1", "logIndex": "0x0", "address": x(T), "topics": [x(erc20.TRANSFER.topic0), x(word(A)), x(word(B))],
             "data": x(word(100 if n >= fork else 1)), "transactionHash": None} for n in range(low, head + 1)]
    path.write_text(json.dumps({"head": head, "most": most, "blocks": blocks, "logs": logs}))
    return f"file:{path}"


def test_follow_and_serve_commands(spark, tmp_path):
    url = record(tmp_path / "node.json", 100)
    store, out = f"{tmp_path}/store", f"{tmp_path}/out"
    found = json.loads(cli.main(["follow", url, store, out, checksummed(T), "--until", "100"], spark))
    assert found == {"head": 100, "cursor": 36}
    record(tmp_path / "node.json", 102, fork=90)
    assert json.loads(cli.main(["follow", url, store, out, "--module", "chainfold.plans.erc20", "--args", json.dumps({"address": checksummed(T)}), "--until", "102"], spark))["cursor"] == 38
    assert json.loads(cli.main(["ask", store, out, checksummed(T), "account", B.hex()], spark))["balance"] == "39"
    assert json.loads(cli.main(["run", store, out, "--module", "chainfold.plans.erc20", "--args", json.dumps({"address": checksummed(T)})], spark))["cursor"] == 38
    client = remote.Client(spark, f"{tmp_path}/shared", erc20.manifest(T), lambda *a: None, 30)
    assert cli.main(["serve", store, f"{out}/pending", f"{tmp_path}/shared", "--rounds", "2", "--every", "0"], spark) == "frames: 4"
    client.step()
    assert client.cursor == 38 and client.pending().count() == 64


def test_recorded_sources(spark, tmp_path):
    url = record(tmp_path / "node.json", 40)
    blocks, logs, txs = rpc.chain(spark, url, with_txs=True)(0, 30)
    assert blocks.count() == logs.count() == 31 and txs.count() == 31 and {r.tx_index for r in txs.collect()} == {1}
    with pytest.raises(Exception, match="no block 41"):
        rpc.chain(spark, url)(39, 41)[0].collect()
    store = BlockStore(spark, f"{tmp_path}/store")
    store.append(logs, blocks)
    m = Manifest("m", 1, 0, contracts=(Contract("t", T, (Event("Transfer(address indexed from, address indexed to, uint256 value)", tx_fields=True),)),))
    with pytest.raises(TxFieldsUnavailable):
        Indexer(spark, store, f"{tmp_path}/run", m, erc20.handler).build_index()
    assert rpc.import_txs(store, url, span=10) == 31 and store.txs.count() == 31 and rpc.import_txs(store, url) == 0
    assert Indexer(spark, store, f"{tmp_path}/run", m, erc20.handler).build_index() == 30


def dump_block(n, value, salt=0, tx=0, parent=bytes(32)):
    log = [T, [erc20.TRANSFER.topic0, word(A), word(B)], word(value)]
    return n, rlp_encode([[b"", b"\x01", A, []]] * tx + [[b"", b"\x01", A, [log]]]), rlp_encode([parent] * 8 + [salt] + [bytes(32)] * 2 + [1_700_000_000 + n])


DUMP = "block_number long, receipts binary, header binary"


def test_a_dump_with_reorganised_blocks(spark, tmp_path):
    rows = [dump_block(n, n) for n in range(10, 60)] + [dump_block(20, 999, salt=7, tx=1), dump_block(45, 999, salt=8)]
    spark.createDataFrame(rows, DUMP).write.parquet(f"{tmp_path}/dump")
    store = BlockStore(spark, f"{tmp_path}/store")
    with pytest.raises(LookupError, match="more than once"):
        cli.load_dump(spark, f"{tmp_path}/dump", store, span=16)
    hashes = receipts.header_blocks(spark.createDataFrame(rows[:50], DUMP)).select("block_number", "block_hash")
    # the spans before the one that failed are there, and the import goes on behind them
    done = store.meta["last_final"]
    assert cli.load_dump(spark, f"{tmp_path}/dump", store, hashes=hashes, span=16) == 59
    assert {r.block_number: number(r.data) for r in store.logs.collect()} == {n: n for n in range(10, 60)}
    assert store.blocks.join(hashes, ["block_number", "block_hash"]).count() == 50 and (done is None or done < 20) and len(store.meta["parts"]) >= 4
    # without hashes, a later pass finds the stored block's row by the shape of its logs
    dump = spark.createDataFrame([rows[10], rows[-2], rows[11]], DUMP)
    assert sorted((r.block_number, bytes(r.header)) for r in receipts.matching_rows(dump, store.logs).collect()) == [(20, rows[10][2]), (21, rows[11][2])]


def test_headers_are_resumed(spark):
    rows = [dump_block(n, n) for n in range(5)] + [dump_block(3, 1, salt=9)]
    dump = spark.createDataFrame(rows, DUMP)
    hashes = receipts.header_blocks(spark.createDataFrame(rows[:5], DUMP))
    assert receipts.header_blocks(dump, hashes).join(hashes, ["block_number", "block_hash"]).count() == 5
    assert sorted(r.block_number for r in receipts.header_blocks(dump, hashes, hashes.where("block_number < 2")).collect()) == [2, 3, 4]
