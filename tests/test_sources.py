import json
import random
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from chainfold.sources import receipts as rc
from chainfold.sources import rpc, store
from chainfold.sources.schemas import LOGS
from chainfold.sources.store import BlockStore, StateStore, StoreError, newest_page, page
from tests.chain import addr, blocks_of, logs_of, transfer, word


def test_rlp_round_trip():
    rng = random.Random(4)

    def item(depth):
        if depth and rng.random() < 0.5:
            return [item(depth - 1) for _ in range(rng.randint(0, 6))]
        return rng.randbytes(rng.choice([0, 1, 5, 55, 56, 300]))

    for _ in range(60):
        x = item(3)
        assert rc.rlp_item(rc.rlp_encode(x))[0] == x
    for bad in (b"", b"\x83ab", b"\xc3\x83ab", b"\xb8"):
        with pytest.raises(rc.RlpError):
            rc.rlp_item(bad)


def test_header_time():
    header = rc.rlp_encode([bytes(32)] * 11 + [1_700_000_000])
    assert rc.header_timestamp(header) == 1_700_000_000
    with pytest.raises(rc.RlpError):
        rc.header_timestamp(rc.rlp_encode([b"x"]))


def receipts(*senders):
    logs = [[addr(7), [word(1)], b"data"], [addr(8), [], b""]]
    return rc.rlp_encode([[b"", b"\x01", s, logs if k % 2 == 0 else []] for k, s in enumerate(senders)])


def test_receipts():
    rows = rc.decode_receipts(5, receipts(addr(1), addr(2), addr(3)))
    assert [r[:4] for r in rows] == [(5, 0, 0, addr(7)), (5, 0, 1, addr(8)), (5, 2, 2, addr(7)), (5, 2, 3, addr(8))]
    assert rows[0][4:] == ([word(1)], word(1), b"data", None) and rows[1][5] is None
    assert rc.decode_senders(receipts(addr(1), addr(2))) == [(addr(1), True), (addr(2), False)]
    with pytest.raises(rc.RlpError):
        rc.decode_receipts(1, rc.rlp_encode([[b"", b"", addr(1), [[b"short", [], b""]]]]))


SECRET = 0xC0FFEE
FIELDS = {  # unsigned fields of each type, `to` and value in their places
    0: lambda to: [3, 10**9, 21000, to, 10**18, b""],
    1: lambda to: [1, 3, 10**9, 21000, to, 10**18, b"", []],
    2: lambda to: [1, 3, 1, 10**9, 21000, to, 10**18, b"", []],
    3: lambda to: [1, 3, 1, 10**9, 21000, to, 10**18, b"", [], 5, [bytes(32)]],
    4: lambda to: [1, 3, 1, 10**9, 21000, to, 10**18, b"", [], [[1, addr(1), 0, 0, 1, 1]]],
}


def signed(kind, to, protected=True):
    fields = FIELDS[kind](to)
    to_sign = [*fields, 1, b"", b""] if kind == 0 and protected else fields
    prefix = bytes([kind]) if kind else b""
    digest = rc.keccak256(prefix + rc.rlp_encode(to_sign))
    k = 12345 + kind
    x, y = rc._times(k, rc._G)
    r = x % rc._N
    s = pow(k, -1, rc._N) * (int.from_bytes(digest, "big") + r * SECRET) % rc._N
    parity = y % 2
    v = parity if kind else (37 + parity if protected else 27 + parity)
    return prefix + rc.rlp_encode([*fields, v, r, s])


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("to", [addr(9), b""])
def test_sign_and_recover(kind, to):
    tx = rc.decode_transaction(signed(kind, to))
    assert (tx["tx_type"], tx["to"], int.from_bytes(tx["value"], "big")) == (kind, to or None, 10**18)
    assert rc.recover_sender(tx["hash"], tx["parity"], tx["r"], tx["s"]) == rc.public_address(SECRET)


def test_old_and_bad_transactions():
    tx = rc.decode_transaction(signed(0, addr(9), protected=False))
    assert rc.recover_sender(tx["hash"], tx["parity"], tx["r"], tx["s"]) == rc.public_address(SECRET)
    assert rc.recover_sender(tx["hash"], tx["parity"], 0, 1) is None
    assert rc.public_address(1).hex() == "7e5f4552091a69125d5dfcb7b8c2659029395bdf"
    for bad in (b"", b"\x05\xc0", b"\x02\xc0", signed(2, addr(1)) + b"x"):
        with pytest.raises(rc.RlpError):
            rc.decode_transaction(bad)


def test_block_transactions(spark):
    raws = [signed(0, addr(9)), signed(2, b""), signed(1, addr(8))]
    body = rc.rlp_encode([[_raw(r) for r in raws], []])
    assert rc.body_transactions(body) == raws
    value = receipts(b"", b"", addr(3))
    dump = spark.createDataFrame([(5, value, body)], "block_number long, receipts binary, body binary")
    got = [(r.tx_index, r.tx_type, bytes(r["from"]), r.to and bytes(r.to), r.from_unrecovered) for r in rc.block_txs(dump).orderBy("tx_index").collect()]
    assert got == [(0, 0, rc.public_address(SECRET), addr(9), False), (2, 1, addr(3), addr(8), False)]
    assert rc.receipt_logs(dump).count() == 4
    with pytest.raises(rc.RlpError, match="receipts for"):
        rc.block_transactions(5, receipts(addr(1)), body)


def _raw(raw):
    return rc.rlp_item(raw)[0] if raw[0] >= 0xC0 else raw


def test_headers_and_canonical(spark):
    header = lambda t: rc.rlp_encode([b"\x01" * 32] + [bytes(32)] * 10 + [t])
    dump = spark.createDataFrame([(1, header(5)), (1, header(6)), (2, header(7))], "block_number long, header binary")
    rows = rc.header_blocks(dump).orderBy("block_number").collect()
    assert [r.block_number for r in rows] == [1, 2] and rows[1].ts == 7 and bytes(rows[1].parent_hash) == b"\x01" * 32
    rows = spark.createDataFrame([(1, b"a", 1), (1, b"b", 2), (2, b"c", 3)], "block_number long, block_hash binary, v int")
    hashes = spark.createDataFrame([(1, b"b"), (2, b"c")], "block_number long, block_hash binary")
    assert sorted(r.v for r in rc.canonical(rows, hashes).collect()) == [2, 3]
    with pytest.raises(LookupError, match="more than once"):
        rc.canonical(rows, None)
    with pytest.raises(LookupError, match="canonical hash"):
        rc.canonical(rows, hashes.where("block_number = 1"))
    assert rc.canonical(rows.where("block_number = 2"), None).count() == 1


def test_json_logs(spark):
    records = [{"blockNumber": "0x10", "transactionIndex": "0x2", "logIndex": "0x3", "address": "0x" + "ab" * 20, "topics": ["0x" + f"{k:064x}" for k in range(5)],
                "data": "0x", "transactionHash": "0x" + "fe" * 32}, {"blockNumber": "0x11", "address": "0x" + "cd" * 20, "topics": [], "data": "0x01ff"}]
    df = spark.createDataFrame([(json.dumps(r),) for r in records], "line string").select(F.from_json("line", rpc.LOG_JSON).alias("j")).select("j.*")
    a, b = rpc.to_logs(df).orderBy("block_number").collect()
    assert (a.block_number, a.tx_index, a.log_index, len(a.topics), bytes(a.data)) == (16, 2, 3, 4, b"") and bytes(a.tx_hash) == b"\xfe" * 32
    assert (b.tx_index, b.log_index, b.topic0, bytes(b.data), b.tx_hash) == (0, 0, None, b"\x01\xff", None)


def test_json_transactions_and_times(spark):
    df = spark.createDataFrame([("0x1", "0x0", "0x2", "0x" + "aa" * 20, None, "0x5"), ("0x1", "0x1", None, "0x" + "bb" * 20, "0x" + "cc" * 20, "0x0")], rpc.TX_JSON)
    mask = spark.createDataFrame([(1, 0)], "block_number long, tx_index int")
    row = rpc.to_txs(df, mask).first()
    assert (row.tx_type, row.to, int.from_bytes(row.value, "big")) == (2, None, 5)
    with pytest.raises(Exception, match="MissingTxRecord"):
        rpc.to_txs(df, spark.createDataFrame([(1, 7)], "block_number long, tx_index int")).collect()
    times = spark.createDataFrame([("0x1", "0x64"), ("0x2", "0x70")], "number string, timestamp string")
    assert [r.ts for r in rpc.to_timestamps(times, 1, 2).orderBy("block_number").collect()] == [100, 112]
    with pytest.raises(LookupError):
        rpc.to_timestamps(times, 1, 3)
    head = spark.createDataFrame([('{"params":{"result":{"number":"0x1b4"}}}',)], "m string").select(rpc.head_number(F.col("m")).alias("n")).first().n
    assert head == 436


def test_spans_adapt():
    asked = []

    def ask(a, b):
        asked.append((a, b))
        if b - a + 1 > 600:
            raise OSError("too many")
        return [{"blockNumber": hex(a), "logIndex": "0x1"}, {"blockNumber": hex(a), "logIndex": "0x0"}]

    rows = list(rpc.fetch_logs(ask, 0, 2999))
    good = [x for x in asked if x[1] - x[0] + 1 <= 600]
    assert good[0] == (0, 511) and good[-1][1] == 2999 and all(b[0] == a[1] + 1 for a, b in zip(good, good[1:], strict=False))
    assert [r["logIndex"] for r in rows[:2]] == ["0x0", "0x1"]

    def never(a, b):
        raise OSError("down")

    with pytest.raises(OSError):
        list(rpc.fetch_logs(never, 0, 10))


def test_rpc_source_splits_into_spans(spark):
    reader = rpc.RpcLogReader({"url": "http://nowhere", "start": "0", "end": "20000"})
    spans = reader.partitions()
    assert [(p.start, p.end) for p in spans] == [(0, 8191), (8192, 16383), (16384, 20000)]


def test_block_store(spark, tmp_path):
    bs = BlockStore(spark, f"{tmp_path}/store")
    assert bs.logs.count() == 0 and bs.meta["last_final"] is None
    assert bs.append(logs_of(spark, [transfer(100, addr(1), addr(2), 3), transfer(102, addr(1), addr(2), 3)]), blocks_of(spark, range(100, 103))) == 102
    # blocks that are there already are ignored, empty ones are kept, gaps are refused
    assert bs.append(logs_of(spark, [transfer(102, addr(1), addr(2), 3), transfer(103, addr(1), addr(2), 3)]), blocks_of(spark, [102, 103])) == 103
    assert (bs.logs.count(), bs.blocks.count()) == (3, 4)
    with pytest.raises(StoreError, match="does not follow"):
        bs.append(logs_of(spark, []), blocks_of(spark, [105]))
    with pytest.raises(StoreError):
        bs.append(logs_of(spark, []), blocks_of(spark, [104, 106]))
    assert [r.block_number for r in bs.read_range(101, 103).orderBy("block_number").collect()] == [102, 103] and bs.read_block(100).count() == 1
    assert {r.store: (r.rows, r.first, r.last, r.blocks) for r in bs.status().collect()} == {"logs": (3, 100, 103, 3), "blocks": (4, 100, 103, 4), "txs": (0, None, None, 0)}
    (tmp_path / "store" / "_meta.json").write_text("{}")
    with pytest.raises(StoreError, match="not of this store"):
        _ = bs.meta


def test_state_versions(spark, tmp_path):
    store = StateStore(spark, f"{tmp_path}/state")
    rows = lambda **kv: spark.createDataFrame(list(kv.items()), "id string, v int")
    assert store.current().number == 0 and store.view().table("x") is None
    store.commit({"x": (rows(a=1), "id")}, {"log": (rows(p=1), "id")}, 5, 6)
    pinned = store.view()
    store.commit({"x": (rows(a=2, b=3), "id")}, {"log": (rows(q=2), "id")}, 8, 9, batch_id=4)
    now = store.view()
    assert {r.id: r.v for r in now.table("x").collect()} == {"a": 2, "b": 3} and now.table("log").count() == 2
    assert {r.id: r.v for r in pinned.table("x").collect()} == {"a": 1} and pinned.table("log").count() == 1
    assert (now.version.number, now.version.cursor, now.version.counts, now.version.batch_id) == (2, 8, {"log": 2}, 4)
    # a write that was never published is not seen
    rows(z=9).write.parquet(f"{tmp_path}/state/log/v=99")
    assert store.view().table("log").count() == 2


def test_pages(spark):
    rows = spark.createDataFrame([(k,) for k in range(150)], "id long")
    assert [r.id for r in page(rows, "id", 10, 3).collect()] == [10, 11, 12]
    assert [r.id for r in newest_page(rows, "id", 3, 5).collect()] == [144, 143, 142]
    assert newest_page(rows, "id", 500).count() == 100 and newest_page(rows, "id").count() == 20 and newest_page(rows, "id", 5, 500).count() == 0


def test_decoded_rows_come_in_small_batches(spark):
    """What a worker gives at once does not grow with the logs of its blocks, nor what it gets with their bytes."""
    value = rc.rlp_encode([[b"", 1, bytes(20), [[bytes([k]) * 20, [bytes(32)], bytes(32)] for k in range(5)]]] * 1_000)
    dump = pa.RecordBatch.from_pylist([{"block_number": n, "receipts": value} for n in range(3)])
    sizes = [b.num_rows for b in rc._decoded(iter([dump]), lambda r: rc.decode_receipts(r.block_number, r.receipts), to_arrow_schema(LOGS))]
    assert sum(sizes) == 15_000 and max(sizes) <= rc.OUT_ROWS
    assert rc.receipt_logs(spark.createDataFrame([(1, value)], "block_number long, receipts binary")).count() == 5_000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= rc.BATCH_BYTES


def test_canonical_hashes_are_not_broadcast(spark):
    """They are as many as the blocks, though an estimate of what Python gives may look small."""
    dump = spark.createDataFrame([(n, bytes([n]) * 32) for n in range(4)], "block_number long, block_hash binary")
    plan = rc.canonical(dump, dump)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_batches_are_cut_without_computing_their_rows(spark, tmp_path):
    """Cuts come from block numbers: each log's columns are made once, and the order is the logs'."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def data(n):
        calls.add(1)
        return n.to_bytes(4, "big")

    low, n = 1_000, 60_000
    logs = spark.range(n).select(
        (low + F.col("id") % 3000).alias("block_number"), F.lit(0).alias("tx_index"), F.col("id").cast("int").alias("log_index"), F.lit(addr(1)).alias("address"),
        F.array(F.lit(b"t")).alias("topics"), data("id").alias("data"), F.lit(None).cast("binary").alias("tx_hash"))
    blocks = BlockStore(spark, f"{tmp_path}/s")
    assert blocks.append(logs, blocks_of(spark, range(low, low + 3000))) == low + 2999
    assert calls.value == n
    files = [[(r.block_number, r.log_index) for r in spark.read.parquet(f).collect()] for f in blocks.logs.inputFiles()]
    assert len(files) > 1 and all(f == sorted(f) for f in files) and sum(map(len, files)) == n
    ends = sorted((f[0], f[-1]) for f in files)
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_a_span_of_most_logs_is_cut_within_its_block(spark):
    logs = spark.range(70_000).select(F.when(F.col("id") < 100, F.col("id")).otherwise(50).alias("block_number"), F.lit(0).alias("tx_index"), F.col("id").cast("int").alias("log_index"), F.lit("a").alias("f"))
    parts = store.in_log_order(logs, 0, 99, "f").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 70_000
    assert "RepartitionByExpression" in store.in_log_order(logs, 0, 99, "f")._jdf.queryExecution().analyzed().toString()
    assert store.in_log_order(logs.limit(0), 0, 99, "f").count() == 0


def test_tables_of_a_commit_are_written_at_the_same_time(spark, tmp_path, monkeypatch):
    meet, real = threading.Barrier(3, timeout=20), store.StateStore._write
    monkeypatch.setattr(store.StateStore, "_write", lambda self, *a: meet.wait() and None or real(self, *a))
    state = store.StateStore(spark, f"{tmp_path}/state")
    table = lambda *ids: spark.createDataFrame([(bytes([k]), k) for k in ids], "id binary, n int")
    made = state.commit({"a": (table(1, 2), "id"), "b": (table(3), "id")}, {"c": (table(4, 5, 6), "id")}, 7, 8)
    assert made.counts == {"c": 3} and made.keys == {"a": "id", "b": "id"}
    assert [state.view().table(t).count() for t in "abc"] == [2, 1, 3]
