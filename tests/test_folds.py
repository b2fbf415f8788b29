import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainfold.operators import enrich, folds, prefetch
from chainfold.functions.keccak import selector
from chainfold.plans.manifest import Call, Contract, Event, Manifest, Prefetch, StaticCall, Target
from chainfold.sources.schemas import CALL_CACHE, TXS
from tests.chain import ZERO, addr, blocks_of, logs_of, number, transfer, word

MOVED = "block_number long, tx_index int, log_index int, from binary, to binary, value binary"


def balances(spark, moves):
    df = spark.createDataFrame([(k, 0, 0, f, t, word(v)) for k, (f, t, v) in enumerate(moves)], MOVED)
    return {bytes(r.id): number(r.balance) for r in folds.balances(folds.transfer_legs(df)).collect()}


def replayed(moves):
    state = {}
    for f, t, v in moves:
        state[f] = (state.get(f, 0) - v) % 2**256
        state[t] = (state.get(t, 0) + v) % 2**256
    return state


def test_balances(spark):
    a, b, c = addr(1), addr(2), addr(3)
    moves = [(ZERO, a, 100), (ZERO, b, 50), (a, c, 30), (b, a, 20)]
    assert balances(spark, moves) == {a: 90, b: 30, c: 30, ZERO: 2**256 - 150}
    assert balances(spark, [(a, a, 7), (b, c, 0)]) == {a: 0, b: 0, c: 0}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4), st.one_of(st.integers(0, 2**256 - 1), st.integers(0, 9))), min_size=1, max_size=40))
def test_balances_against_a_replay(spark, moves):
    moves = [(addr(f), addr(t), v) for f, t, v in moves]
    assert balances(spark, moves) == replayed(moves)


def test_state_before_and_incremental(spark):
    rng = random.Random(1)
    moves = [(addr(rng.randint(0, 3)), addr(rng.randint(0, 3)), rng.getrandbits(255)) for _ in range(60)]
    df = spark.createDataFrame([(k, 0, 0, f, t, word(v)) for k, (f, t, v) in enumerate(moves)], MOVED)
    legs = folds.transfer_legs(df)
    half = folds.add_balances(folds.balances(legs.where("block_number < 30")), folds.balances(legs.where("block_number >= 30")))
    assert {bytes(r.id): number(r.balance) for r in half.collect()} == replayed(moves)
    rows = folds.word_state_before(df.withColumn("sign", F.lit(1)), "to", "value", "sign").collect()
    for r in rows:
        assert number(r.before) == sum(v for k, (_, t, v) in enumerate(moves) if k < r.block_number and t == bytes(r["to"])) % 2**256


def test_latest_and_merge(spark):
    rows = spark.createDataFrame([(1, 0, 0, "k", 1, None), (1, 0, 1, "k", 2, 5), (2, 0, 0, "k", 3, None), (1, 1, 0, "l", 9, None)],
                                 "block_number long, tx_index int, log_index int, id string, a int, b int")
    assert {r.id: (r.a, r.b) for r in folds.latest(rows, "id").collect()} == {"k": (3, None), "l": (9, None)}
    merged = folds.merge_columns([rows.select("block_number", "tx_index", "log_index", "id", "a"), rows.select("block_number", "tx_index", "log_index", "id", "b")], "id", ["a", "b"])
    assert {r.id: (r.a, r.b) for r in merged.collect()} == {"k": (3, 5), "l": (9, None)}
    assert {r.id: r["count"] for r in folds.counts(rows, "id").collect()} == {"k": 3, "l": 1}


def test_immutable_keys(spark):
    rows = lambda *ks: spark.createDataFrame([(bytes([k]),) for k in ks], "id binary")
    folds.require_increasing(None, rows(3, 4))
    folds.require_increasing(rows(1, 2), rows(3, 4))
    for old, new in ((rows(3), rows(3)), (rows(5), rows(4)), (None, rows(4, 4))):
        with pytest.raises(folds.KeyOutOfOrder):
            folds.require_increasing(old, new)


def test_merge_state(spark):
    rows = lambda **kv: spark.createDataFrame(list(kv.items()), "id string, v int")
    assert {r.id: r.v for r in folds.merge_state(rows(a=1, b=2), rows(b=3, c=4), "id").collect()} == {"a": 1, "b": 3, "c": 4}


def step(state, log):
    state = state or {"id": log["id"], "top": 0, "n": 0}
    return {**state, "top": max(state["top"] - 1, log["a"]), "n": state["n"] + 1}


def test_keyed_reduce_against_a_replay(spark):
    rng = random.Random(2)
    logs = [(b, 0, 0, rng.choice("xyz"), rng.randint(0, 9)) for b in range(200)]
    schema = "block_number long, tx_index int, log_index int, id string, a int"
    expect = {}
    for row in sorted(logs):
        expect[row[3]] = step(expect.get(row[3]), {"id": row[3], "a": row[4]})
    df = spark.createDataFrame(rng.sample(logs, len(logs)), schema)
    whole = folds.keyed_reduce(df, "id", step, "id string, top int, n int")
    assert {r.id: r.asDict() for r in whole.collect()} == expect
    early = folds.keyed_reduce(df.where("block_number < 90"), "id", step, "id string, top int, n int")
    late = folds.keyed_reduce(df.where("block_number >= 90"), "id", step, "id string, top int, n int", state=early)
    assert {r.id: r.asDict() for r in late.collect()} == expect
    in_order = folds.replay(df, lambda log: [{"b": log["block_number"]}], "b long").collect()
    assert [r.b for r in in_order] == list(range(200))


def test_transactions(spark):
    txs = spark.createDataFrame([(1, 0, 2, addr(4), None, word(5), False)], TXS)
    row = enrich.with_transactions(logs_of(spark, [transfer(1, addr(1), addr(2), 3)]), txs).first()
    assert bytes(row.tx["from"]) == addr(4) and row.tx["to"] is None
    with pytest.raises(Exception, match="MissingTxRecord"):
        enrich.with_transactions(logs_of(spark, [transfer(2, addr(1), addr(2), 3)]), txs).collect()
    with pytest.raises(Exception, match="MissingTxRecord"):
        enrich.select_by_mask(txs, enrich.tx_mask(logs_of(spark, [transfer(2, addr(1), addr(2), 3)]))).collect()
    flagged = spark.createDataFrame([(addr(1), 0), (addr(2), 1)], "to binary, flags int")
    assert [r.to and bytes(r.to) for r in enrich.creation_aware(flagged).collect()] == [addr(1), None]


def test_times(spark):
    cases = {15537394: 1663224162, 15537395: 1663224174, 15538394: 1663236162, 0: 1461238040}
    got = spark.createDataFrame([(b,) for b in cases], "b long").select("b", enrich.block_time(F.col("b")).alias("t")).collect()
    assert {r.b: r.t for r in got} == cases
    blocks = blocks_of(spark, [5]).unionByName(blocks_of(spark, [6]).withColumn("ts", F.lit(0).cast("long")))
    rows = enrich.with_time(logs_of(spark, [transfer(b, addr(1), addr(2), 3) for b in (5, 6, 7)]), blocks).collect()
    assert {r.block_number: r.timestamp for r in rows} == {5: 1_700_000_060, 6: 1461238040 + 6 * 13, 7: 1461238040 + 7 * 13}


CREATED = Event("Created(address pool)")
CHAINED = Manifest("m", 1, 0, contracts=(Contract("f", addr(9), (CREATED,)),), static_prefetch=(StaticCall(addr(8), "decimals()"),), prefetch=(Prefetch(CREATED, (
    Call("token()", Target("param", "pool")), Call("decimals()", Target("of", "token()")), Call("fee(uint256)", args=(word(7),)))),))


def fetch(pairs):
    out = []
    for target, data in pairs:
        if data == selector("token()"):
            out.append((1, b"") if target == addr(3) else (0, word(bytes([target[0] + 100]) * 20)))
        else:
            out.append((0, word(18)))
    return out


def test_prefetch_rounds(spark, tmp_path):
    made = lambda b, pool: (b, 0, 0, addr(9), [CREATED.topic0], CREATED.topic0, word(addr(pool)), None)
    logs = logs_of(spark, [made(1, 1), made(2, 2), made(3, 1), made(4, 3)])
    kept = []

    def write(results, k):
        path = f"{tmp_path}/{k}"
        results.write.parquet(path)
        kept.append(path)
        return spark.read.parquet(*kept)

    cache = prefetch.run_rounds(logs, CHAINED, spark.createDataFrame([], CALL_CACHE), fetch, write)
    rows = [(bytes(r.target)[0], bytes(r.calldata), r.status, r.seq) for r in cache.collect()]
    token, decimals, fee = selector("token()"), selector("decimals()"), selector("fee(uint256)") + word(7)
    # pools once each, the static call, the emitter's call; then decimals of the tokens found, none for the reverted one
    assert sorted(rows) == sorted([(1, token, 0, 1), (2, token, 0, 1), (3, token, 1, 1), (8, decimals, 0, 1), (9, fee, 0, 1), (101, decimals, 0, 2), (102, decimals, 0, 2)])
    called = enrich.with_call(logs, cache, F.substring("data", 13, 20), F.lit(token))
    assert sorted((r.block_number, r.call.state) for r in called.collect()) == [(1, "ok"), (2, "ok"), (3, "ok"), (4, "reverted")]
    missing = enrich.with_call(logs, cache, F.col("address"), F.lit(token))
    assert {r.call.state for r in missing.collect()} == {"not_prefetched"}
    with pytest.raises(Exception, match="NotPrefetched"):
        missing.select(enrich.require_call(F.col("call"))).collect()


def test_calls_of_a_round_are_fetched_by_several_tasks(spark):
    """Small shuffle partitions are coalesced: all calls of a round came to one task."""
    n = 200
    logs = logs_of(spark, [(k, 0, 0, addr(9), [CREATED.topic0], CREATED.topic0, word(k.to_bytes(20, "big")), None) for k in range(1, n + 1)])
    m = Manifest("m", 1, 0, contracts=(Contract("f", addr(9), (CREATED,)),), prefetch=(Prefetch(CREATED, (Call("token()", Target("param", "pool")),)),))
    tasks = []

    def write(results, k):
        rows = results.groupBy(F.spark_partition_id().alias("task")).count().collect()
        tasks.extend(r["count"] for r in rows)
        return results

    prefetch.run_rounds(logs, m, spark.createDataFrame([], CALL_CACHE), fetch, write)
    assert sum(tasks) == n and len(tasks) > 1 and max(tasks) < n


def test_a_selector_is_hashed_once(monkeypatch):
    from chainfold.functions import keccak

    hashed, real = [], keccak.keccak256
    monkeypatch.setattr(keccak, "keccak256", lambda data: hashed.append(data) or real(data))
    assert {keccak.selector("asked(uint8,uint16)") for _ in range(1000)} == {real(b"asked(uint8,uint16)")[:4]} and len(hashed) == 1


def test_failed_batches_are_left_out_and_the_last_result_stands(spark):
    calls = spark.createDataFrame([(addr(1), b"x"), (addr(2), b"x")], "target binary, calldata binary").coalesce(1)
    assert prefetch.fetch_all(calls, lambda pairs: None, 1).count() == 0
    cache = spark.createDataFrame([(addr(1), b"x", 1, None, 1), (addr(1), b"x", 0, b"v", 2)], CALL_CACHE)
    assert [(r.status, bytes(r.value)) for r in enrich.current_calls(cache).collect()] == [(0, b"v")]
