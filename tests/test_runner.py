import pytest
from pyspark.sql import functions as F

from chainfold.functions import abi
from chainfold.operators import folds
from chainfold.plans import erc20
from chainfold.plans.manifest import Call, Contract, Entity, Event, Factory, Manifest, ManifestError, Prefetch, Target
from chainfold.plans.runner import Delta, Indexer, Reader, State
from chainfold.sources.schemas import ORDER
from chainfold.sources.store import BlockStore
from tests.chain import ZERO, addr, approval, blocks_of, logs_of, number, transfer, word

TOKEN, A, B, C = addr(0xAE), addr(0xA), addr(0xB), addr(0xC)
ROWS = [transfer(100, ZERO, A, 100), transfer(101, ZERO, B, 50), transfer(102, A, C, 30), approval(102, A, B, 9, log=1), transfer(103, B, A, 20), approval(103, A, B, 4, log=1),
        transfer(103, A, B, 1, token=addr(1), log=2)]


@pytest.fixture
def setup(spark, tmp_path):
    blocks = BlockStore(spark, f"{tmp_path}/store")
    blocks.append(logs_of(spark, ROWS[:3]), blocks_of(spark, range(100, 103)))
    return blocks, Indexer(spark, blocks, f"{tmp_path}/run", erc20.manifest(TOKEN), erc20.handler)


def accounts(df):
    return {bytes(r.id): number(r.balance) for r in df.collect()}


def test_token_end_to_end(spark, setup):
    blocks, indexer = setup
    one = indexer.run()
    assert one.scanned_to == 102 and indexer.run() == one
    blocks.append(logs_of(spark, ROWS), blocks_of(spark, range(100, 104)))
    two = indexer.run()
    assert (two.number, two.cursor, two.counts) == (2, 103, {"transfers": 4, "approvals": 1})
    assert accounts(indexer.state.view().table("accounts")) == {A: 90, B: 30, C: 30, ZERO: 2**256 - 150}
    api = erc20.Api(Reader(indexer))
    assert api.health() == {"status": "ok", "cursor": 103, "transfers": 4}
    assert api.account("0x" + A.hex())["balance"] == "90" and api.account("0x" + addr(0x77).hex())["balance"] == "0"
    assert api.allowance(A.hex(), B.hex())["value"] == "4"
    assert [t["value"] for t in api.transfers(2)] == ["20", "30"] and api.transfers(5, 99) == []
    with pytest.raises(ValueError):
        api.account("0x12")
    reader = Reader(indexer)
    for call in (lambda: reader.count("accounts"), lambda: reader.range("accounts", 0, 1), lambda: reader.load("transfers", b"")):
        with pytest.raises(ManifestError):
            call()
    assert len(reader.range("transfers", 1, 2)) == 2


def test_in_one_go_or_piecemeal(spark, setup, tmp_path):
    blocks, indexer = setup
    indexer.run()
    blocks.append(logs_of(spark, ROWS), blocks_of(spark, range(100, 104)))
    indexer.run()
    whole = Indexer(spark, blocks, f"{tmp_path}/whole", erc20.manifest(TOKEN), erc20.handler)
    whole.run()
    for name in ("accounts", "allowances", "transfers", "approvals"):
        a, b = (i.state.view().table(name) for i in (indexer, whole))
        assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_another_manifest_starts_anew(spark, setup, tmp_path):
    blocks, indexer = setup
    indexer.run()
    other = Indexer(spark, blocks, f"{tmp_path}/run", erc20.manifest(TOKEN, end_block=101), erc20.handler)
    assert other.run().scanned_to == 101
    assert accounts(other.state.view().table("accounts")) == {A: 100, B: 50, ZERO: 2**256 - 150}


def test_tip_and_reorganisation(spark, setup):
    _, indexer = setup
    f = indexer.start(head=103)
    pending = lambda rows, salt=b"": (blocks_of(spark, [103], salt, parent=b""), logs_of(spark, rows))
    f.tick(*pending([ROWS[4]]), last_final=102)
    assert accounts(indexer.tip("accounts"))[A] == 90 and indexer.tip("transfers").count() == 4
    f.tick(*pending([ROWS[4], transfer(103, C, A, 5, log=5)], b"x"), last_final=102)
    assert accounts(indexer.tip("accounts"))[A] == 95 and indexer.tip("transfers").count() == 5
    assert accounts(indexer.state.view().table("accounts"))[A] == 70
    f.tick(blocks_of(spark, [104], b"x"), logs_of(spark, []), last_final=103)
    assert accounts(indexer.state.view().table("accounts"))[A] == 95 and indexer.state.current().cursor == 103
    assert Reader(indexer).cursor == 103


CREATE = Event("PairCreated(address indexed token0, address pair, uint256 n)")
SYNC = Event("Sync(uint112 reserve0, uint112 reserve1)")
FACTORY = addr(0xFA)
PAIRS = Manifest("pairs", 1, 0, factories=(Factory("f", FACTORY, CREATE, "pair", (SYNC,)),),
                 prefetch=(Prefetch(CREATE, (Call("token0()", Target("param", "pair")), Call("decimals()", Target("of", "token0()")))),),
                 entities=(Entity("Pair", "mutable", (("id", "b20"), ("token0", "b20"), ("decimals", "u8"), ("reserve0", "u112"), ("reserve1", "u112"))),))


def pairs_handler(events, context):
    created = events["PairCreated"].select(*ORDER, F.col("params.pair").alias("id"))
    created = context.call(created, F.col("id"), "token0()", ("address",), name="t")
    created = context.call(created, F.col("t.v0"), "decimals()", ("uint8",), name="d")
    named = created.select(*ORDER, "id", F.col("t.v0").alias("token0"), F.coalesce("d.v0", F.lit(18)).alias("decimals"))
    synced = events["Sync"].select(*ORDER, F.col("address").alias("id"), "params.reserve0", "params.reserve1")
    rows = folds.merge_columns([named, synced], "id", ["token0", "decimals", "reserve0", "reserve1"])
    old = context.committed.table("pairs")
    if old is not None:
        kept = old.select("id", *[F.col(c).alias(f"_{c}") for c in old.columns if c != "id"])
        rows = rows.join(kept, "id", "left").select("id", *[F.coalesce(c, f"_{c}").alias(c) for c in rows.columns if c != "id"])
    return State(mutable={"pairs": Delta(rows, "id")})


def fetch(calls):
    return [(0, word(bytes([t[0] + 50]) * 20)) if d == abi.keccak256(b"token0()")[:4] else ((1, b"") if t[0] == 52 else (0, word(6))) for t, d in calls]


def test_factory_with_prefetch(spark, tmp_path):
    made = lambda b, pair: (b, 0, 0, FACTORY, [CREATE.topic0, word(addr(9))], CREATE.topic0, word(addr(pair)) + word(1), None)
    sync = lambda b, pair, x, y: (b, 0, 1, addr(pair), [SYNC.topic0], SYNC.topic0, word(x) + word(y), None)
    blocks = BlockStore(spark, f"{tmp_path}/store")
    blocks.append(logs_of(spark, [made(1, 1), sync(2, 1, 5, 6), sync(2, 3, 8, 8)]), blocks_of(spark, [1, 2]))
    indexer = Indexer(spark, blocks, f"{tmp_path}/run", PAIRS, pairs_handler, fetch)
    indexer.run()
    rows = lambda: {r.id[0]: (r.token0[0], r.decimals, r.reserve0 and int(r.reserve0), r.reserve1 and int(r.reserve1)) for r in indexer.state.view().table("pairs").collect()}
    assert rows() == {1: (51, 6, 5, 6)}
    blocks.append(logs_of(spark, [made(3, 2), sync(4, 1, 7, 7)]), blocks_of(spark, [3, 4]))
    indexer.run()
    assert rows() == {1: (51, 6, 7, 7), 2: (52, 18, None, None)}
    # a child found late brings the logs that it had emitted before
    blocks.append(logs_of(spark, [made(5, 3)]), blocks_of(spark, [5]))
    indexer.build_index()
    assert indexer.index().where((F.col("address") == F.lit(addr(3))) & (F.col("block_number") == 2)).count() == 1


def test_events_of_one_name_are_refused(spark, setup):
    blocks, _ = setup
    m = Manifest("m", 1, 0, contracts=(Contract("c", A, (Event("X(uint256 a)", alias="Y"), Event("Y(uint256 a)"))),))
    with pytest.raises(ManifestError, match="named"):
        Indexer(spark, blocks, "/nowhere", m, erc20.handler)
