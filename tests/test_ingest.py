"""Head ingestion, gaps, replaced checkpoints, incremental indexing, layers of state."""

import os

import pytest
from pyspark.sql import functions as F

from chainfold.plans import erc20
from chainfold.plans.runner import Indexer, TxFieldsUnavailable
from chainfold.plans.manifest import Contract, Event, Manifest
from chainfold.sources import store as stores
from chainfold.sources.schemas import BUCKET, TXS
from chainfold.sources.store import BlockStore, PendingStore, StateStore
from chainfold.streaming import live
from chainfold.streaming.ingest import HeadIngest
from tests.chain import addr, blocks_of, logs_of, number, transfer, word

T, A, B = addr(0xAE), addr(1), addr(2)


class FakeChain:
    """Blocks from 0 on; from `fork` on they carry another salt."""

    def __init__(self, spark):
        self.spark, self.fork, self.salt, self.asked, self.txs = spark, 10**9, b"x", [], True

    def __call__(self, start, end):
        self.asked.append((start, end))
        old, new = range(start, min(end, self.fork - 1) + 1), range(max(start, self.fork), end + 1)
        blocks = blocks_of(self.spark, old).unionAll(blocks_of(self.spark, new, self.salt, parent=b"" if start <= self.fork else self.salt))
        logs = logs_of(self.spark, [transfer(n, A, B, 1) for n in old] + [transfer(n, A, B, 100) for n in new])
        txs = self.spark.createDataFrame([(n, 0, 2, A, B, word(1), False) for n in range(start, end + 1)], TXS) if self.txs else None
        return blocks, logs, txs


@pytest.fixture
def chain(spark, tmp_path):
    fake = FakeChain(spark)
    store, pending = BlockStore(spark, f"{tmp_path}/store"), PendingStore(spark, f"{tmp_path}/pending")
    return fake, HeadIngest(spark, store, pending, fake, depth=8, span=10)


def numbers(df):
    return sorted(r.block_number for r in df.select("block_number").collect())


def test_head_goes_through_the_ring(spark, chain):
    fake, ingest = chain
    assert ingest.advance(30, start=0) == 22
    assert numbers(ingest.store.blocks) == list(range(23)) and numbers(ingest.pending.read()[0]) == list(range(23, 31))
    assert (0, 9) in fake.asked and (20, 22) in fake.asked
    assert ingest.advance(32) == 24 and numbers(ingest.store.blocks) == list(range(25)) and numbers(ingest.store.logs) == list(range(25))
    # transactions of final blocks come with them, and say so
    assert numbers(ingest.store.txs) == list(range(25)) and numbers(ingest.store.tx_blocks) == list(range(25))
    assert ingest.advance(32) == 24 and numbers(ingest.pending.read()[0]) == list(range(25, 33))
    fake.txs = False
    assert ingest.advance(45) == 37 and 34 in numbers(ingest.store.blocks) and 34 not in numbers(ingest.store.tx_blocks)


def test_forks_are_found_by_hashes(spark, chain, caplog):
    fake, ingest = chain
    with caplog.at_level("INFO", "chainfold"):
        ingest.advance(30, start=0)
    assert caplog.messages == []  # nothing was pending that could become final
    fake.fork = 28
    assert ingest.resolve(31) == 28 and numbers(ingest.pending.read()[0]) == [23, 24, 25, 26, 27]
    assert "from 28 left the chain" in caplog.text
    ingest.advance(31)
    logs = {r.block_number: number(r.data) for r in ingest.pending.read()[1].collect()}
    assert logs == {n: 1 if n < 28 else 100 for n in range(24, 32)} and numbers(ingest.store.blocks) == list(range(24))
    fake.fork, fake.salt = 20, b"y"
    with pytest.raises(live.ReorgExceedsFinalityDepth):
        ingest.advance(33)


def test_a_head_that_falls_back(spark, chain):
    _, ingest = chain
    ingest.advance(30, start=0)
    ingest.resolve(27)
    assert numbers(ingest.pending.read()[0]) == [23, 24, 25, 26, 27]
    with pytest.raises(live.ReorgExceedsFinalityDepth):
        ingest.resolve(20)


def test_broken_chains_are_refused(spark):
    with pytest.raises(live.BrokenChain):
        live.require_chain(blocks_of(spark, [1, 3]))
    with pytest.raises(live.BrokenChain):
        live.require_chain(blocks_of(spark, [1, 2]).unionAll(blocks_of(spark, [3], b"x")))
    with pytest.raises(live.BrokenChain):
        live.require_chain(blocks_of(spark, [5, 6]), b"other")
    live.require_chain(blocks_of(spark, [5, 6]), b"h4")
    live.require_chain(blocks_of(spark, []))


def balances(indexer, name="accounts"):
    return {bytes(r.id): number(r.balance) for r in indexer.state.view().table(name).collect()}


def snapshot(spark, numbers_):
    return blocks_of(spark, numbers_), logs_of(spark, [transfer(n, A, B, 1) for n in numbers_])


def test_a_gap_of_fifty_blocks_is_filled(spark, tmp_path):
    store = BlockStore(spark, f"{tmp_path}/store")
    store.append(logs_of(spark, [transfer(n, A, B, 1) for n in range(100)]), blocks_of(spark, range(100)))
    indexer = Indexer(spark, store, f"{tmp_path}/run", erc20.manifest(T), erc20.handler)
    follower = indexer.start()
    assert follower.cursor == 99
    store.append(logs_of(spark, [transfer(n, A, B, 1) for n in range(100, 150)]), blocks_of(spark, range(100, 150)))
    follower.tick(*snapshot(spark, range(150, 155)), last_final=149)
    assert follower.cursor == 149 and balances(indexer)[B] == 150 and number(next(r.balance for r in indexer.tip("accounts").collect() if bytes(r.id) == B)) == 155
    follower.tick(*snapshot(spark, range(152, 157)), last_final=151)
    assert follower.cursor == 151 and balances(indexer)[B] == 152
    # blocks that nobody has stop the follower, they are not skipped
    with pytest.raises(live.StaleBaseline):
        follower.tick(*snapshot(spark, range(170, 175)), last_final=169)
    with pytest.raises(live.BrokenChain):
        follower.tick(*snapshot(spark, range(170, 175)), last_final=160)
    assert balances(indexer)[B] in (152, 157)


def test_a_lone_follower_loses_nothing(spark):
    seen = []
    m = Manifest("m", 1, 0, contracts=(Contract("t", T, (erc20.TRANSFER,)),))
    f = live.Follower(spark, m, spark.createDataFrame([], "address binary"), 99, lambda final, children, to, batch: seen.append(to))
    f.tick(*snapshot(spark, range(150, 153)), last_final=149)
    with pytest.raises(live.BrokenChain):
        f.tick(*snapshot(spark, range(160, 163)), last_final=159)


def test_a_replaced_checkpoint_loses_nothing(spark, tmp_path):
    store = BlockStore(spark, f"{tmp_path}/store")
    store.append(*reversed(snapshot(spark, range(100, 101))))
    indexer = Indexer(spark, store, f"{tmp_path}/run", erc20.manifest(T, start_block=100), erc20.handler)
    follower = indexer.start()
    follower.tick(*snapshot(spark, range(101, 104)), last_final=100, batch_id=40)
    follower.tick(*snapshot(spark, range(102, 105)), last_final=101, batch_id=41)
    assert indexer.state.current().batch_id == 41
    again = Indexer(spark, store, f"{tmp_path}/run", erc20.manifest(T, start_block=100), erc20.handler)
    follower = again.start()
    follower.tick(*snapshot(spark, range(102, 105)), last_final=101, batch_id=0)
    follower.tick(*snapshot(spark, range(104, 107)), last_final=103, batch_id=1)
    assert again.state.current().cursor == 103 and balances(again)[B] == 4
    # a commit that comes again after a crash changes nothing
    again.follower.commit(logs_of(spark, [transfer(103, A, B, 1)]), again.children(), 103, 2)
    assert balances(again)[B] == 4


def read_files(df):
    """The stored files that a DataFrame reads."""
    return {os.path.dirname(f).split("/logs/")[1] for f in df.inputFiles() if "/logs/" in f}


def test_a_second_run_reads_the_new_bucket(spark, tmp_path, monkeypatch):
    store = BlockStore(spark, f"{tmp_path}/store")
    far = BUCKET * 3
    store.append(logs_of(spark, [transfer(far - 2, A, B, 1), transfer(far - 1, A, B, 1, token=addr(9))]), blocks_of(spark, [far - 2, far - 1]))
    indexer = Indexer(spark, store, f"{tmp_path}/run", erc20.manifest(T, start_block=far - 2), erc20.handler)
    indexer.run()
    store.append(logs_of(spark, [transfer(far, A, B, 1), transfer(far + 1, A, B, 1, token=addr(9))]), blocks_of(spark, [far, far + 1]))
    read = []
    real = stores.BlockStore.read_matching
    monkeypatch.setattr(stores.BlockStore, "read_matching", lambda self, *a: read.append(real(self, *a)) or read[-1])
    indexer.run()
    plan = read[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and f"block_bucket#" in plan  # noqa: F541
    assert numbers(read[0]) == [far, far + 1] and indexer.state.current().cursor == far
    metrics = read[0].select(F.input_file_name().alias("f")).distinct().collect()
    assert all(f"block_bucket={far // BUCKET}" in r.f for r in metrics)
    assert store.read_matching(0, 2 * far, [addr(0x77)], []).count() == 0
    assert read_files(store.read_range(far, far, [])) == set()


def test_layers_fold_into_a_base(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "DELTAS", 2)
    monkeypatch.setattr(stores, "KEEP", 3)
    state = StateStore(spark, f"{tmp_path}/s")
    expect = {}
    for k in range(9):
        rows = {f"k{k % 4}": k, f"only{k}": k}
        expect |= rows
        state.commit({"t": (spark.createDataFrame(list(rows.items()), "id string, v int"), "id")}, {}, k, k)
        pinned = pinned if k > 6 else state.view()  # noqa: F821
        assert {r.id: r.v for r in state.view().table("t").collect()} == expect
        assert len(state.current().tables["t"]) <= 3
    assert {r.id: r.v for r in pinned.table("t").collect()} == {k: v for k, v in expect.items() if v <= 6} | {"k0": 4, "k1": 5, "k2": 6, "k3": 3}
    left = [d for d, _, files in os.walk(f"{tmp_path}/s/t") if any(f.endswith(".parquet") for f in files)]
    assert len(left) < 9


def test_transactions_have_to_cover_the_range(spark, tmp_path):
    paid = Event("Transfer(address indexed from, address indexed to, uint256 value)", tx_fields=True)
    m = Manifest("m", 1, 0, contracts=(Contract("t", T, (paid,)),), entities=())
    store = BlockStore(spark, f"{tmp_path}/store")
    store.append(logs_of(spark, [transfer(1, A, B, 1)]), blocks_of(spark, [1]))
    with pytest.raises(TxFieldsUnavailable):
        Indexer(spark, store, f"{tmp_path}/run", m, lambda events, context: None).build_index()
    other = BlockStore(spark, f"{tmp_path}/other")
    other.append(logs_of(spark, [transfer(1, A, B, 1)]), blocks_of(spark, [1]), spark.createDataFrame([(1, 0, 2, A, B, word(1), False)], TXS))
    assert Indexer(spark, other, f"{tmp_path}/run2", m, lambda events, context: None).build_index() == 1


def test_a_run_that_keeps_nothing(spark, tmp_path):
    store = BlockStore(spark, f"{tmp_path}/store")
    store.append(logs_of(spark, [transfer(1, A, B, 1, token=addr(9))]), blocks_of(spark, [1]))
    indexer = Indexer(spark, store, f"{tmp_path}/run", erc20.manifest(T, start_block=1), erc20.handler)
    assert indexer.run().scanned_to == 1 and indexer.index().count() == 0
    store.append(logs_of(spark, [transfer(2, A, B, 1)]), blocks_of(spark, [2]))
    assert indexer.run().cursor == 2 and balances(indexer)[B] == 1
