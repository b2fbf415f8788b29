"""Stores, indexers, following, importing and decoding over the driver's tables, with the SQL of the same rows.

Purchases stand in for a token's transfers and clicks for its approvals; the store has every block of
the events' span, in two deliveries with a run of the token's indexer after each.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainfold.functions import abi, text, u256
from chainfold.functions.keccak import address, checksummed, keccak256, selector
from chainfold.operators import enrich, filtering, folds, prefetch
from chainfold.sources import receipts, rpc, store
from chainfold.sources.schemas import LOGS, ORDER, TXS
from chainfold.sources.store import BlockStore, PendingStore
from chainfold.streaming import live, remote
from chainfold.streaming.ingest import HeadIngest

from . import erc20, pairs, registry
from .driver_queries import _E, _LEGS, EVENT, _table, addr, as_address, as_word, cents, event_logs, query
from .manifest import Call, Contract, Entity, Event, Factory, Manifest, ManifestError, Prefetch, StaticCall, Target
from .runner import Indexer, Reader
from .workspace import folder

TOKEN = b"\xae" * 20
#: The last block of the first delivery.
CUT = 142_113_600


def _hash(n: Column, salt: Column | int = 0) -> Column:
    return as_word(n * 1000 + salt)


def token_logs(spark: SparkSession, d: str) -> DataFrame:
    """Events as logs of LOGS: purchases are transfers of the token, clicks approvals, the rest other contracts' logs."""
    logs = event_logs(spark, d)
    topic = lambda n: F.concat(F.lit(bytes(12)), as_address(n))
    kind = F.when(F.col("event_type") == "purchase", F.lit(erc20.TRANSFER.topic0)).when(F.col("event_type") == "click", F.lit(erc20.APPROVAL.topic0))
    other = (F.col("user_id") * 7 + 3) % 150
    return logs.withColumn("_kind", kind).select(
        "block_number", "tx_index", "log_index", F.when(F.col("_kind").isNotNull(), F.lit(TOKEN)).otherwise(F.col("address")).alias("address"),
        F.when(F.col("_kind").isNotNull(), F.array("_kind", topic(F.col("user_id")), topic(other))).otherwise(F.col("topics")).alias("topics"),
        F.coalesce("_kind", "topic0").alias("topic0"), "data", "tx_hash")


def dense_blocks(spark: SparkSession, low: int, high: int, salt_from: int | None = None) -> DataFrame:
    """Every block of a span; from `salt_from` on they are another chain's."""
    salt = lambda n: F.when(n >= salt_from, 7).otherwise(0) if salt_from is not None else 0
    n = F.col("id")
    return spark.range(low, high + 1).select(n.alias("block_number"), _hash(n, salt(n)).alias("block_hash"), _hash(n - 1, salt(n - 1)).alias("parent_hash"), (n * 12).alias("ts"))


def span(logs: DataFrame) -> tuple[int, int]:
    return logs.agg(F.min("block_number"), F.max("block_number")).first()


def built(spark: SparkSession, d: str) -> tuple[BlockStore, Indexer, list[dict]]:
    """The store, the token's indexer after both deliveries, and the statistics of its two runs."""
    return _built(spark, spark.sparkContext.applicationId, d)


@lru_cache(maxsize=4)
def _built(spark: SparkSession, _: str, d: str) -> tuple[BlockStore, Indexer, list[dict]]:
    home, logs = folder(spark, "token"), token_logs(spark, d)
    low, high = span(logs)
    blocks = BlockStore(spark, f"{home}/store")
    indexer = Indexer(spark, blocks, f"{home}/run", erc20.manifest(TOKEN, start_block=low), erc20.handler)
    stats = []
    for end in (CUT, high):
        blocks.append(logs.where(F.col("block_number") <= end), dense_blocks(spark, low, end))
        indexer.run()
        stats.append(dict(indexer.stats))
    return blocks, indexer, stats


def number(c: str | Column) -> Column:
    """An address or word as a long."""
    return F.conv(F.hex(c), 16, 10).cast("long")


def signed(c: str) -> Column:
    return u256.narrow(F.col(c), 56, True)


def unsigned(c: str) -> Column:
    return u256.narrow(F.col(c), 56, False)


def told(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str) -> str:
    quote = lambda v: "true" if v is True else "false" if v is False else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) t({names})"


# the store

@query(f"{_E} SELECT event_id, block_number FROM e")
def store_logs(spark, d):
    """What two appends wrote; a third of blocks that are there adds nothing."""
    blocks = built(spark, d)[0]
    meta = blocks.meta
    blocks.append(token_logs(spark, d), dense_blocks(spark, meta["first"], meta["last_final"]))
    return blocks.logs.select(F.col("log_index").cast("long").alias("event_id"), "block_number")


@query(f"{_E}, s AS (SELECT min(block_number) AS a, max(block_number) AS b FROM e) SELECT 'logs' AS store, count(*) AS rows, min(block_number) AS first, max(block_number) AS last, count(DISTINCT block_number) AS blocks FROM e "
       "UNION ALL SELECT 'blocks', b - a + 1, a, b, b - a + 1 FROM s UNION ALL SELECT 'txs', 0, NULL, NULL, 0")
def store_status(spark, d):
    return built(spark, d)[0].status()


@query(f"{_E} SELECT event_id FROM e WHERE block_number = (SELECT max(block_number) FROM e)")
def store_block(spark, d):
    blocks = built(spark, d)[0]
    return blocks.read_block(blocks.meta["last_final"]).select(F.col("log_index").cast("long").alias("event_id"))


@query(f"{_E} SELECT block_number, block_number * 12 AS ts FROM e WHERE event_type = 'error' GROUP BY block_number")
def store_times(spark, d):
    logs = filtering.keep(built(spark, d)[0].logs, (), [EVENT["error"].topic0])
    return enrich.with_time(logs, built(spark, d)[0].blocks).select("block_number", F.col("timestamp").alias("ts")).distinct()


@query(f"{_E} SELECT event_id FROM e WHERE event_type = 'error' AND user_id IN (3, 4, 5)")
def bloom_superset(spark, d):
    """The folders that the blocks' filters allow, then the rule itself."""
    blocks, keys = built(spark, d)[0], ([addr(3), addr(4), addr(5)], [EVENT["error"].topic0])
    meta = blocks.meta
    return filtering.keep(blocks.read_matching(meta["first"], meta["last_final"], *keys), *keys).select(F.col("log_index").cast("long").alias("event_id"))


@query(f"{_E}, hit AS (SELECT DISTINCT block_number FROM e WHERE event_type = 'error' AND user_id IN (3, 4, 5)), s AS (SELECT min(block_number) AS a, max(block_number) AS b FROM e)"
       " SELECT (SELECT count(*) FROM hit) AS missed_none, b - a + 1 AS filters FROM s")
def bloom_blocks(spark, d):
    """No block with a match is missing among the candidates; every block has its filter."""
    blocks, keys = built(spark, d)[0], ([addr(3), addr(4), addr(5)], [EVENT["error"].topic0])
    found = filtering.candidate_blocks(blocks.blooms, *keys)
    true = filtering.keep(blocks.logs, *keys).select("block_number").distinct()
    return true.join(found, "block_number", "left_semi").agg(F.count("*").alias("missed_none")).withColumn("filters", F.lit(blocks.blooms.count()).cast("long"))


@query(values([("a gap", "StoreError"), ("below the end", "142221000 kept"), ("a foreign file", "StoreError"), ("not there", "nothing")], '"case", outcome').replace("142221000 kept", "ignored"))
def store_refusals(spark, d):
    """What a store does with blocks that do not follow, blocks it has, and a folder that is not its own."""
    home, out = folder(spark, "refusals"), []
    blocks = BlockStore(spark, f"{home}/s")
    none = spark.createDataFrame([], LOGS)
    blocks.append(none, dense_blocks(spark, 10, 20))

    def attempt(case, f):
        try:
            out.append((case, f()))
        except store.StoreError:
            out.append((case, "StoreError"))

    attempt("a gap", lambda: str(blocks.append(none, dense_blocks(spark, 22, 25))))
    attempt("below the end", lambda: "ignored" if blocks.append(none, dense_blocks(spark, 12, 18)) == 20 else "taken")
    store.publish(spark, f"{home}/t/_meta.json", "{}")
    attempt("a foreign file", lambda: str(BlockStore(spark, f"{home}/t").meta))
    attempt("not there", lambda: "nothing" if BlockStore(spark, f"{home}/u").logs.isEmpty() else "something")
    return told(spark, out, "case string, outcome string")


# runs and reads

@query(f"{_LEGS} SELECT id, CAST(sum(v) AS BIGINT) AS balance FROM legs GROUP BY id")
def indexer_accounts(spark, d):
    rows = built(spark, d)[1].state.view().table("accounts")
    return rows.select(number("id").alias("id"), signed("balance").alias("balance"))


@query(f"{_E} SELECT user_id AS owner, (user_id * 7 + 3) % 150 AS spender, arg_max(cents, event_id) AS value FROM e WHERE event_type = 'click' GROUP BY user_id")
def indexer_allowances(spark, d):
    rows = built(spark, d)[1].state.view().table("allowances")
    return rows.select(number(F.substring("id", 1, 20)).alias("owner"), number(F.substring("id", 21, 20)).alias("spender"), unsigned("value").alias("value"))


@query(f"{_E} SELECT event_id, user_id AS owner, cents AS value FROM e WHERE event_type = 'click'")
def indexer_approvals(spark, d):
    rows = built(spark, d)[1].state.view().table("approvals")
    return rows.select(abi.unpack_event_id(F.col("id"))["log_index"].alias("event_id"), number("owner").alias("owner"), unsigned("value").alias("value"))


@query(f"{_E}, s AS (SELECT min(block_number) AS a, max(block_number) AS b FROM e), k AS (SELECT * FROM e WHERE event_type IN ('purchase', 'click'))"
       f" SELECT 1 AS run, {CUT} - a + 1 AS scanned, (SELECT count(DISTINCT block_number) FROM k WHERE block_number <= {CUT}) AS matched, (SELECT count(*) FROM k WHERE block_number <= {CUT}) AS kept FROM s"
       f" UNION ALL SELECT 2, b - {CUT}, (SELECT count(DISTINCT block_number) FROM k WHERE block_number > {CUT}), (SELECT count(*) FROM k WHERE block_number > {CUT}) FROM s")
def indexer_runs(spark, d):
    """The statistics of two runs: the second scans what the first did not."""
    return told(spark, [(k + 1, s["scanned_blocks"], s["matched_blocks"], s["kept_logs"]) for k, s in enumerate(built(spark, d)[2])], "run int, scanned long, matched long, kept long")


@query(f"{_E} SELECT event_id FROM e WHERE event_type IN ('purchase', 'click') AND block_number > {CUT}")
def index_above_cursor(spark, d):
    return built(spark, d)[1].index().where(F.col("block_number") > CUT).select(F.col("log_index").cast("long").alias("event_id"))


@query(f"{_E} SELECT 'another run' AS step, false AS changed UNION ALL SELECT 'another manifest', true")
def indexer_reruns(spark, d):
    """A run with nothing new changes nothing; another manifest starts from nothing."""
    blocks, indexer, _ = built(spark, d)
    before = indexer.state.current()
    same = indexer.run() != before
    other = Indexer(spark, blocks, f"{folder(spark, 'other')}/run", erc20.manifest(TOKEN, start_block=blocks.meta["first"], end_block=CUT), erc20.handler)
    first = other.run()
    again = Indexer(spark, blocks, other.path, erc20.manifest(TOKEN, start_block=blocks.meta["first"] + 1, end_block=CUT), erc20.handler)
    return told(spark, [("another run", same), ("another manifest", again.run().fingerprint != first.fingerprint)], "step string, changed boolean")


@query(f"{_E}, t AS (SELECT * FROM e WHERE event_type = 'purchase') SELECT event_id, user_id, (user_id * 7 + 3) % 150 AS target, cents FROM t ORDER BY block_number, event_id LIMIT 50 OFFSET 100")
def reader_range(spark, d):
    return _read(spark, Reader(built(spark, d)[1]).range("transfers", 100, 50))


@query(f"{_E}, t AS (SELECT * FROM e WHERE event_type = 'purchase') SELECT event_id, user_id, (user_id * 7 + 3) % 150 AS target, cents FROM t ORDER BY block_number DESC, event_id DESC LIMIT 20 OFFSET 5")
def reader_newest(spark, d):
    return _read(spark, Reader(built(spark, d)[1]).newest("transfers", 20, 5))


def _read(spark: SparkSession, rows: list[dict]) -> DataFrame:
    n = lambda raw: int.from_bytes(raw, "big")
    return told(spark, [(n(r["id"][12:]), n(r["from"]), n(r["to"]), n(r["value"])) for r in rows], "event_id long, user_id long, target long, cents long")


@query(f"{_E}, t AS (SELECT * FROM e WHERE event_type = 'purchase') SELECT event_id, user_id, (user_id * 7 + 3) % 150 AS target, cents FROM t ORDER BY block_number, event_id LIMIT 1 OFFSET 40")
def point_read(spark, d):
    """An immutable row by its key, and one that is not there."""
    reader = Reader(built(spark, d)[1])
    key = reader.range("transfers", 40, 1)[0]["id"]
    found = [reader.read("transfers", key), reader.read("transfers", bytes(16))]
    return _read(spark, [r for r in found if r is not None])


@query(f"{_LEGS} SELECT (SELECT count(*) FROM e WHERE event_type = 'purchase') AS transfers, (SELECT count(*) FROM e WHERE event_type = 'click') AS approvals, "
       "(SELECT max(block_number) FROM e WHERE event_type IN ('purchase', 'click')) AS cursor, 3 AS refused")
def reader_counts(spark, d):
    reader, refused = Reader(built(spark, d)[1]), 0
    for call in (lambda: reader.count("accounts"), lambda: reader.range("accounts", 0, 1), lambda: reader.load("transfers", bytes(16))):
        try:
            call()
        except ManifestError:
            refused += 1
    return told(spark, [(reader.count("transfers"), reader.count("approvals"), reader.cursor, refused)], "transfers long, approvals long, cursor long, refused int")


@query(f"{_LEGS}, b AS (SELECT id, CAST(((sum(v) % 18446744073709551616) + 18446744073709551616) % 18446744073709551616 AS BIGINT) AS low FROM legs GROUP BY id),"
       " a AS (SELECT user_id, arg_max(cents, event_id) AS cents FROM e WHERE event_type = 'click' GROUP BY user_id)"
       " SELECT 'transfers' AS what, CAST((SELECT count(*) FROM e WHERE event_type = 'purchase') AS VARCHAR) AS answer UNION ALL SELECT 'nobody', '0'"
       " UNION ALL SELECT 'allowance', coalesce((SELECT CAST(cents AS VARCHAR) FROM a WHERE user_id = 3), '0')"
       " UNION ALL SELECT 'newest', (SELECT CAST(cents AS VARCHAR) FROM e WHERE event_type = 'purchase' ORDER BY block_number DESC, event_id DESC LIMIT 1)")
def api_answers(spark, d):
    api = erc20.Api(Reader(built(spark, d)[1]))
    return told(spark, [("transfers", str(api.health()["transfers"])), ("nobody", api.account("0x" + (b"\x77" * 20).hex())["balance"]),
                        ("allowance", api.allowance(addr(3).hex(), addr(24).hex())["value"]), ("newest", api.transfers(1)[0]["value"])], "what string, answer string")


@query(f"""{_LEGS}, p AS (SELECT user_id AS id, -cents AS v, block_number FROM e WHERE event_type = 'purchase' UNION ALL SELECT (user_id * 7 + 3) % 150, cents, block_number FROM e WHERE event_type = 'purchase')
    SELECT id, CAST(sum(v) AS BIGINT) AS balance FROM p WHERE block_number <= {CUT} GROUP BY id""")
def pinned_view(spark, d):
    """A version that was taken before the second delivery's commit still reads as it did."""
    indexer = built(spark, d)[1]
    now = indexer.state.current()
    old = store.Version(**(now.__dict__ | {"number": 1, "tables": {k: v[:1] for k, v in now.tables.items()}}))
    return indexer.state.view(old).table("accounts").select(number("id").alias("id"), signed("balance").alias("balance"))


@query(f"{_LEGS} SELECT id, CAST(sum(v) AS BIGINT) AS balance FROM legs GROUP BY id")
def layered_commits(spark, d):
    """Twelve commits of changed rows: layers are folded into a base on the way. The legs are decoded and dealt once, so a commit reads its own."""
    home = folder(spark, "layers")
    state = store.StateStore(spark, f"{home}/state")
    moved = folds.transfer_legs(_moved(token_logs(spark, d))).select("id", "sign", "value", (F.col("log_index") % 12).alias("k"))
    moved.write.partitionBy("k").parquet(f"{home}/legs")
    for k in range(12):
        part = folds.balances(spark.read.schema("id binary, sign int, value binary, k int").parquet(f"{home}/legs").where(F.col("k") == k))
        state.commit({"accounts": (folds.changed_sums(state.view().table("accounts"), part), "id")}, {}, k, k)
    return state.view().table("accounts").select(number("id").alias("id"), signed("balance").alias("balance"))


def _moved(logs: DataFrame) -> DataFrame:
    m = erc20.manifest(TOKEN)
    return filtering.dispatch(filtering.filtered(logs, m), m)["Transfer"].select(*ORDER, "params.from", "params.to", "params.value")


# folds with prior state

@query(f"{_E} SELECT user_id, count(*) AS n, CAST(1152921504606846977 + sum(cents) AS BIGINT) AS cents, max(event_id) AS last FROM e GROUP BY user_id")
def keyed_reduce_resumed(spark, d):
    """A reducer goes on from a state of numbers beyond 2**53, in two deliveries."""
    rows = event_logs(spark, d).select(*ORDER, "user_id", unsigned("data").alias("cents"))
    schema = "user_id long, n long, cents long, last long"

    def step(state, log):
        state = state or {"user_id": log["user_id"], "n": 0, "cents": 1152921504606846977}
        return state | {"n": state["n"] + 1, "cents": state["cents"] + log["cents"], "last": log["log_index"]}

    first = folds.keyed_reduce(rows.where(F.col("block_number") <= CUT), "user_id", step, schema)
    return folds.keyed_reduce(rows.where(F.col("block_number") > CUT), "user_id", step, schema, state=first)


@query(f"{_LEGS} SELECT id, CAST(sum(v) AS BIGINT) AS balance FROM legs GROUP BY id")
def replay_stretches(spark, d):
    """An ordered replay in stretches of whole blocks, each committed before the next."""
    state = store.StateStore(spark, folder(spark, "stretches"))
    logs = filtering.keep(token_logs(spark, d), [TOKEN], [erc20.TRANSFER.topic0])
    n = logs.count()

    def keep(made: DataFrame, last: int) -> DataFrame:
        state.commit({"accounts": (made, "id")}, {}, last, last)
        return state.view().table("accounts")

    done = folds.replay_stretches(logs, lambda now, part: folds.add_balances(now, folds.balances(folds.transfer_legs(_moved(part)))), keep, most=max(1, n // 3))
    return done.select(number("id").alias("id"), signed("balance").alias("balance"))


@query(f"{_E} SELECT event_id, CAST(coalesce(sum(cents) OVER (PARTITION BY user_id ORDER BY block_number, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 5 AS BIGINT) AS before FROM e")
def running_state(spark, d):
    rows = event_logs(spark, d).withColumn("cents", unsigned("data"))
    return folds.state_before(rows, "user_id", F.col("cents"), 5).select(F.col("log_index").cast("long").alias("event_id"), "before")


# following

_TIP = 2_000


def _chain(spark: SparkSession, d: str, fork: int | None = None):
    """The events as a chain: from the fork on, blocks have other hashes and every log comes once for the even ids only."""
    logs = token_logs(spark, d)

    def ask(start: int, end: int):
        part = logs.where(F.col("block_number").between(start, end))
        part = part if fork is None else part.where((F.col("block_number") < fork) | (F.col("log_index") % 2 == 0))
        txs = part.select("block_number", "tx_index").distinct().select("block_number", "tx_index", F.lit(2).alias("tx_type"), as_address(F.col("block_number")).alias("from"),
                                                                      F.lit(None).cast("binary").alias("to"), as_word(F.col("block_number")).alias("value"), F.lit(False).alias("from_unrecovered"))
        return dense_blocks(spark, start, end, fork), part, txs

    return ask


@query(f"""{_E}, top AS (SELECT max(block_number) AS t FROM e), k AS (SELECT event_id, CASE WHEN block_number <= t - {_TIP} THEN 'store' ELSE 'ring' END AS place FROM e, top
    WHERE block_number < t - 800 OR event_id % 2 = 0) SELECT place, count(*) AS logs, CAST(sum(event_id) AS BIGINT) AS ids FROM k GROUP BY place""")
def head_ingest(spark, d):
    """A head that advances in steps, then forks within the ring: the store has final blocks, the ring the fork's."""
    top = span(token_logs(spark, d))[1]
    low, home = top - 30_000, folder(spark, "ingest")
    old = token_logs(spark, d).where(F.col("block_number") < low)
    # events are rarer here than logs on a chain, so the ring is longer
    blocks, pending = BlockStore(spark, f"{home}/store"), PendingStore(spark, f"{home}/pending", depth=_TIP)
    first = span(token_logs(spark, d))[0]
    blocks.append(old, dense_blocks(spark, first, low - 1))
    ingest = HeadIngest(spark, blocks, pending, _chain(spark, d), depth=_TIP)
    ingest.advance(top - 1_000)
    ingest.chain = _chain(spark, d, fork=top - 800)
    ingest.advance(top)
    place = lambda df, name: df.agg(F.lit(name).alias("place"), F.count("*").alias("logs"), F.sum(F.col("log_index").cast("long")).alias("ids"))
    return place(blocks.logs, "store").unionByName(place(pending.read()[1], "ring"))


_FOLLOW = f"""{_E}, top AS (SELECT max(block_number) AS t FROM e), p AS (SELECT user_id AS id, -cents AS v, block_number, event_id FROM e WHERE event_type = 'purchase'
    UNION ALL SELECT (user_id * 7 + 3) % 150, cents, block_number, event_id FROM e WHERE event_type = 'purchase')"""


def _followed(spark: SparkSession, d: str) -> tuple[Indexer, int]:
    """A follower over three snapshots: a backlog, a reorganisation above a fork, and a promotion after a gap."""
    home, logs = folder(spark, "follow"), token_logs(spark, d)
    low, top = span(logs)
    blocks = BlockStore(spark, f"{home}/store")
    blocks.append(logs.where(F.col("block_number") <= top - 8_000), dense_blocks(spark, low, top - 8_000))
    indexer = Indexer(spark, blocks, f"{home}/run", erc20.manifest(TOKEN, start_block=low), erc20.handler)
    follower = indexer.start()
    chain, forked = _chain(spark, d), _chain(spark, d, fork=top - 3_000)
    snapshot = lambda ask, a, b: ask(a, b)[:2]
    follower.tick(*snapshot(chain, top - 7_999, top - 6_000), last_final=top - 8_000)
    # blocks that no snapshot has shown come from the store
    gap = chain(top - 7_999, top - 4_500)
    blocks.append(gap[1], gap[0])
    follower.tick(*snapshot(chain, top - 4_499, top - 2_500), last_final=top - 4_500)
    follower.tick(*snapshot(forked, top - 4_499, top), last_final=top - 4_500)
    follower.tick(*snapshot(forked, top - 3_499, top), last_final=top - 3_500)
    return indexer, top


@lru_cache(maxsize=2)
def _follow_once(spark: SparkSession, _: str, d: str) -> tuple[Indexer, int]:
    return _followed(spark, d)


def followed(spark: SparkSession, d: str) -> tuple[Indexer, int]:
    return _follow_once(spark, spark.sparkContext.applicationId, d)


@query(f"{_FOLLOW} SELECT id, CAST(sum(v) AS BIGINT) AS balance FROM p, top WHERE block_number <= t - 3500 GROUP BY id")
def gap_fill(spark, d):
    """What is committed after a gap of some thousand blocks, a reorganisation and two promotions."""
    return followed(spark, d)[0].state.view().table("accounts").select(number("id").alias("id"), signed("balance").alias("balance"))


@query(f"{_FOLLOW} SELECT id, CAST(sum(v) AS BIGINT) AS balance FROM p, top WHERE block_number < t - 3000 OR event_id % 2 = 0 GROUP BY id")
def follow_tip(spark, d):
    """The tip view: committed state with the fork's pending logs folded on top."""
    return followed(spark, d)[0].tip("accounts").select(number("id").alias("id"), signed("balance").alias("balance"))


@query(f"{_FOLLOW} SELECT t - 3500 AS cursor, (SELECT count(*) FROM e, top WHERE event_type = 'purchase' AND (block_number < t - 3000 OR event_id % 2 = 0)) AS transfers FROM top")
def follow_reader(spark, d):
    """Reads of what is being followed see the pending rows."""
    reader = Reader(followed(spark, d)[0])
    return told(spark, [(reader.cursor, reader.count("transfers"))], "cursor long, transfers long")


@query(values([("a gap that nobody fills", "BrokenChain"), ("a parent that is not the block before", "BrokenChain"), ("a change below the cursor", "ReorgExceedsFinalityDepth"),
               ("a fork below the ring", "ReorgExceedsFinalityDepth"), ("a store far behind", "StaleBaseline")], '"case", outcome'))
def follow_refusals(spark, d):
    out, none = [], spark.createDataFrame([], LOGS)
    m = erc20.manifest(TOKEN)

    def fresh():
        return live.Follower(spark, m, spark.createDataFrame([], "address binary"), 99, lambda *a: None)

    def gap():
        f = fresh()
        f.tick(dense_blocks(spark, 100, 105), none, 99)
        f.tick(dense_blocks(spark, 120, 125), none, 119)

    def below():
        f = fresh()
        f.tick(dense_blocks(spark, 100, 105), none, 99)
        f.tick(dense_blocks(spark, 100, 106), none, 102)
        f.tick(dense_blocks(spark, 101, 106, salt_from=101), none, 102)

    cases = {"a gap that nobody fills": gap, "a parent that is not the block before": lambda: live.require_chain(
        dense_blocks(spark, 1, 5).unionAll(dense_blocks(spark, 6, 8, salt_from=0))), "a change below the cursor": below,
        "a fork below the ring": lambda: live.fork_point(dense_blocks(spark, 1, 5), dense_blocks(spark, 1, 5, salt_from=0)), "a store far behind": lambda: live.check_gap(100, 1_165)}
    for case, f in cases.items():
        try:
            f()
            out.append((case, "nothing"))
        except (live.BrokenChain, live.ReorgExceedsFinalityDepth, live.StaleBaseline) as error:
            out.append((case, type(error).__name__))
    return told(spark, out, "case string, outcome string")


@query(f"{_E}, top AS (SELECT max(block_number) AS t FROM e) SELECT t - 3 + n AS block_number, n = 3 AS replaced FROM top, (SELECT unnest([0, 1, 2, 3]) AS n)")
def pending_ring(spark, d):
    """Insert, truncate, replace and drop: what the ring holds then, and its transactions."""
    top = span(token_logs(spark, d))[1]
    ring, chain = PendingStore(spark, folder(spark, "ring")), _chain(spark, d)
    ring.insert(*chain(top - 40, top - 1))
    ring.truncate(top - 10)
    ring.insert(*chain(top - 10, top - 1))
    ring.insert(*_chain(spark, d, fork=top)(top, top))
    ring.drop_final(top - 4)
    blocks, _, txs = ring.read()
    assert txs is not None
    return blocks.select("block_number", (F.col("block_hash") != _hash(F.col("block_number"))).alias("replaced"))


@query(f"{_LEGS} SELECT id, CAST(sum(v) AS BIGINT) AS balance FROM legs GROUP BY id")
def remote_follow(spark, d):
    """A client that gets the store's history and then new blocks as frames of a server, and reconnects on the way."""
    home, logs = folder(spark, "remote"), token_logs(spark, d)
    low, top = span(logs)
    blocks, pending = BlockStore(spark, f"{home}/store"), PendingStore(spark, f"{home}/pending")
    blocks.append(logs.where(F.col("block_number") <= CUT), dense_blocks(spark, low, CUT))
    server = remote.Server(spark, blocks, pending, f"{home}/shared")
    indexer = Indexer(spark, blocks, f"{home}/run", erc20.manifest(TOKEN, start_block=low), erc20.handler)
    client = remote.remote_indexer(indexer, f"{home}/shared")
    server.poll()
    client.step()
    blocks.append(logs, dense_blocks(spark, low, top))
    client = remote.remote_indexer(indexer, f"{home}/shared")
    server.poll()
    client.step()
    return indexer.state.view().table("accounts").select(number("id").alias("id"), signed("balance").alias("balance"))


@query(f"{_E} SELECT event_id FROM e WHERE event_type = 'click' AND user_id IN (1, 2) AND block_number > {CUT}")
def remote_children(spark, d):
    """Addresses that a subscription takes up later bring their logs from their creation on."""
    from chainfold.streaming.serve import Subscription

    logs = event_logs(spark, d)
    sub = Subscription([addr(7)], [EVENT["click"].topic0])
    sub.backfill(logs, span(logs)[1])
    push = sub.add_children(told(spark, [(addr(1),), (addr(2),)], "address binary"), logs, CUT + 1)
    return push.logs.select(F.col("log_index").cast("long").alias("event_id"))


@query(f"{_E}, top AS (SELECT max(block_number) AS t FROM e) SELECT t AS head, t - 64 AS final FROM top")
def spawned_follow(spark, d):
    """A stream of heads, followed until it has no more."""
    home, logs = folder(spark, "spawn"), token_logs(spark, d)
    top = span(logs)[1]
    blocks = BlockStore(spark, f"{home}/store")
    blocks.append(logs.where(F.col("block_number").between(top - 900, top - 100)), dense_blocks(spark, top - 900, top - 100))
    indexer = Indexer(spark, blocks, f"{home}/run", erc20.manifest(TOKEN, start_block=top - 900), erc20.handler)
    ingest = HeadIngest(spark, blocks, PendingStore(spark, f"{home}/pending"), _chain(spark, d))
    told(spark, [(top - 50,)], "head long").coalesce(1).write.json(f"{home}/heads/1")
    told(spark, [(top,)], "head long").coalesce(1).write.json(f"{home}/heads/2")
    source = spark.readStream.schema("head long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").json(f"{home}/heads")
    heads = []

    def read(batch: DataFrame):
        heads.append(max(r.head for r in batch.collect()))
        ingest.advance(max(heads))
        return ingest.snapshot()

    running = indexer.spawn(source, read, f"{home}/checkpoint", availableNow=True)
    running.awaitTermination()
    return told(spark, [(max(heads), indexer.follower.cursor)], "head long, final long")


# dumps

def _rlp_dump(spark: SparkSession, rows: DataFrame, by: str) -> DataFrame:
    """(block_number, receipts, body, header) of rows (block, user, cents): a receipt and a transaction for each row, after one without logs."""
    parts = rows.groupBy(F.col(by).alias("block_number")).agg(F.array_sort(F.collect_list(F.struct("place", "user_id", "cents"))).alias("rows"))

    def encode(batches):
        topic = EVENT["view"].topic0
        for batch in (whole.slice(k, 100) for whole in batches for k in range(0, whole.num_rows, 100)):
            out = []
            for block, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made, body = [[b"", 21_000, addr(0), []]], [receipts.rlp_encode([1, 1, 21_000, addr(0), 0, b"", 27, 1, 1])]
                for r in held:
                    made.append([b"", 21_000, addr(r["user_id"]), [[addr(r["user_id"]), [topic], r["cents"].to_bytes(32, "big")]]])
                    fields = [1, r["place"], 1, 2, 21_000, addr(r["user_id"] + 1), r["cents"], b"", [], 0, 1, 1]
                    body.append(b"\x02" + receipts.rlp_encode(fields))
                # typed transactions stand as byte strings, the first as a list
                inner = body[0] + b"".join(receipts.rlp_encode(b) for b in body[1:])
                raw = _listed(_listed(inner))
                header = receipts.rlp_encode([(block + 1).to_bytes(32, "big"), *[bytes(32)] * 10, block * 12])
                out.append({"block_number": block, "receipts": receipts.rlp_encode(made), "body": raw, "header": header})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("block_number", pa.int64()), ("receipts", pa.binary()), ("body", pa.binary()), ("header", pa.binary())]))

    return receipts.small_batches(parts).mapInArrow(encode, "block_number long, receipts binary, body binary, header binary")


def _listed(body: bytes) -> bytes:
    """Bytes of encoded items as a list."""
    if len(body) < 56:
        return bytes([0xC0 + len(body)]) + body
    size = len(body).to_bytes((len(body).bit_length() + 7) // 8, "big")
    return bytes([0xF7 + len(size)]) + size + body


def _event_rows(spark: SparkSession, d: str) -> DataFrame:
    return event_logs(spark, d).select("block_number", F.col("log_index").alias("place"), "user_id", unsigned("data").alias("cents"))


_PLACED = f"{_E}, p AS (SELECT block_number, row_number() OVER (PARTITION BY block_number ORDER BY event_id) AS k, user_id, cents FROM e)"


@query(f"{_PLACED} SELECT block_number, CAST(k AS INTEGER) AS tx_index, CAST(k - 1 AS INTEGER) AS log_index, user_id, cents FROM p")
def receipt_decode(spark, d):
    """Compact receipts to logs: numbers run through the block, a transaction without logs has none."""
    logs = receipts.receipt_logs(_rlp_dump(spark, _event_rows(spark, d), "block_number"))
    return logs.select("block_number", "tx_index", "log_index", number("address").alias("user_id"), unsigned("data").alias("cents"))


@query(f"{_PLACED} SELECT block_number, CAST(k AS INTEGER) AS tx_index, 2 AS tx_type, user_id AS sender, user_id + 1 AS target, cents AS value FROM p")
def receipt_txs(spark, d):
    """Bodies and receipts paired: the transactions that have logs, with the receipt's sender."""
    txs = receipts.block_txs(_rlp_dump(spark, _event_rows(spark, d), "block_number"))
    return txs.select("block_number", "tx_index", "tx_type", number("from").alias("sender"), number("to").alias("target"), unsigned("value").alias("value"))


@query("SELECT c_custkey AS block_number, c_custkey * 12 AS ts, c_custkey + 1 AS parent FROM customer")
def header_times(spark, d):
    """Headers to times and links; a block that is there twice counts once."""
    rows = _table(spark, d, "customer").select(F.col("c_custkey").alias("block_number"), F.lit(0).alias("place"), F.col("c_custkey").alias("user_id"), F.lit(1).cast("long").alias("cents"))
    dump = _rlp_dump(spark, rows, "block_number")
    blocks = receipts.header_blocks(dump.unionAll(dump))
    return blocks.select("block_number", "ts", number("parent_hash").alias("parent"))


@query("SELECT c_custkey AS block_number, c_custkey AS user_id FROM customer")
def dump_import(spark, d):
    """A dump with reorganised blocks into a store, in spans: canonical hashes choose, what is there is not taken again."""
    from chainfold.cli import load_dump

    home = folder(spark, "dump")
    rows = _table(spark, d, "customer").select(F.col("c_custkey").alias("block_number"), F.lit(0).alias("place"), F.col("c_custkey").alias("user_id"), F.lit(1).cast("long").alias("cents"))
    true = _rlp_dump(spark, rows, "block_number")
    wrong = true.where("block_number % 7 = 3").withColumn("header", F.concat(F.substring("header", 1, F.octet_length("header") - 1), F.lit(b"\x01"))).withColumn("receipts", F.lit(receipts.rlp_encode([[b"", 1, addr(1), []]] * 2)))
    wrong = wrong.join(true.where("block_number % 7 = 3").select("block_number", F.col("header").alias("_h")).hint("merge"), "block_number").where("header <> _h").drop("_h")
    true.unionByName(wrong).write.parquet(f"{home}/dump")
    hashes = receipts.header_blocks(true).select("block_number", "block_hash")
    blocks = BlockStore(spark, f"{home}/store")
    n = true.count()
    load_dump(spark, f"{home}/dump", blocks, head=n // 2 + 64, hashes=hashes, span=max(1, n // 3))
    load_dump(spark, f"{home}/dump", blocks, hashes=hashes, span=max(1, n // 3))
    return blocks.logs.select("block_number", number("address").alias("user_id"))


@query("SELECT c_custkey AS block_number, c_custkey AS user_id FROM customer WHERE c_custkey % 3 = 0")
def shape_match(spark, d):
    """Of two rows of a block the one whose logs the store has."""
    rows = _table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("block_number"), F.lit(0).alias("place"), F.col("c_custkey").alias("user_id"), F.lit(1).cast("long").alias("cents"))
    true, other = _rlp_dump(spark, rows, "block_number"), _rlp_dump(spark, rows.withColumn("user_id", F.col("user_id") + 1), "block_number")
    logs = receipts.receipt_logs(true)
    return receipts.receipt_logs(receipts.matching_rows(true.unionAll(other), logs)).select("block_number", number("address").alias("user_id"))


@query("SELECT n_nationkey, true AS recovered FROM nation")
def sender_recovery(spark, d):
    """The address of the key that signed, from hash and signature."""
    def recover(batches):
        n_, g_ = receipts._N, receipts._G
        for batch in batches:
            out = []
            for k in batch.column(0).to_pylist():
                secret, nonce = k + 1, k + 99
                digest = keccak256(str(k).encode())
                x, y = receipts._times(nonce, g_)
                r = x % n_
                s = pow(nonce, -1, n_) * (int.from_bytes(digest, "big") + r * secret) % n_
                out.append({"n_nationkey": k, "recovered": receipts.recover_sender(digest, y % 2, r, s) == receipts.public_address(secret)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("n_nationkey", pa.int32()), ("recovered", pa.bool_())]))

    return _table(spark, d, "nation").select("n_nationkey").mapInArrow(recover, "n_nationkey int, recovered boolean")


# nodes

def _recording(spark: SparkSession, d: str) -> str:
    """A node's recording with a block for each nation (25 at every scale), two transactions and a log in each."""
    rows = sorted(tuple(r) for r in _table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect())
    h = lambda n: "0x" + n.to_bytes(32, "big").hex()
    a = lambda n: "0x" + addr(n).hex()
    blocks = [{"number": hex(n), "hash": h(n + 1), "parentHash": h(n), "timestamp": hex(12 * n), "transactions": [
        {"blockNumber": hex(n), "transactionIndex": hex(k), "type": "0x2", "from": a(r + k), "to": a(n), "value": hex(r)} for k in range(2)]} for n, r in rows]
    logs = [{"blockNumber": hex(n), "transactionIndex": "0x1", "logIndex": hex(r), "address": a(r), "topics": ["0x" + EVENT["view"].topic0.hex()], "data": h(n)} for n, r in rows]
    path = f"{folder(spark, 'node')}/node.json"
    store.publish(spark, path, json.dumps({"head": rows[-1][0], "most": 7, "blocks": blocks, "logs": logs}))
    return "file:" + (store._local(path) or path)


@query("SELECT CAST(n_nationkey AS BIGINT) AS block_number, n_regionkey AS log_index, CAST(n_regionkey AS BIGINT) AS address FROM nation")
def rpc_logs(spark, d):
    """Logs of a node that refuses long spans."""
    rpc.register(spark)
    logs = spark.read.format("chain_rpc").options(url=_recording(spark, d), start="0", end="24").load()
    return logs.select("block_number", "log_index", number("address").alias("address"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS block_number, CAST(n_nationkey * 12 AS BIGINT) AS ts, CAST(n_regionkey + 1 AS BIGINT) AS sender, CAST(n_regionkey AS BIGINT) AS value FROM nation")
def rpc_chain(spark, d):
    """Blocks and the transactions that have logs, as head ingestion gets them."""
    blocks, _, txs = rpc.chain(spark, _recording(spark, d), with_txs=True)(0, 24)
    return blocks.join(txs, "block_number").select("block_number", "ts", number("from").alias("sender"), unsigned("value").alias("value"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS block_number, 1 AS tx_index, CAST(n_regionkey + 1 AS BIGINT) AS sender FROM nation")
def rpc_import_txs(spark, d):
    """Transactions of a store that has none, fetched in spans, then there for every block."""
    url, blocks = _recording(spark, d), BlockStore(spark, folder(spark, "txs"))
    found, logs, _ = rpc.chain(spark, url)(0, 24)
    blocks.append(logs, found)
    rpc.import_txs(blocks, url, span=10)
    return blocks.txs.join(blocks.tx_blocks.select("block_number"), "block_number").select("block_number", "tx_index", number("from").alias("sender"))


@query("SELECT c_custkey AS block_number, c_custkey * 12 AS ts FROM customer")
def json_timestamps(spark, d):
    hexed = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    rows = _table(spark, d, "customer").select(hexed(F.col("c_custkey")).alias("number"), hexed(F.col("c_custkey") * 12).alias("timestamp"))
    low, high = _table(spark, d, "customer").agg(F.min("c_custkey"), F.max("c_custkey")).first()
    return rpc.to_timestamps(rows, low, high)


@query("SELECT o_orderkey, o_orderkey AS head FROM orders")
def json_heads(spark, d):
    message = F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.struct(F.struct(F.concat(F.lit("0x"), F.lower(F.hex("o_orderkey"))).alias("number")).alias("result")).alias("params")))
    return _table(spark, d, "orders").select("o_orderkey", rpc.head_number(message).alias("head"))


@query(f"{_E} SELECT DISTINCT block_number, 0 AS tx_index FROM e WHERE block_number % 3 <> 0")
def missing_txs(spark, d):
    logs = event_logs(spark, d)
    have = logs.where("block_number % 3 = 0").select("block_number", "tx_index").distinct()
    return rpc.missing_txs(logs, have)


@query(f"{_E}, top AS (SELECT max(block_number) AS t FROM e) SELECT DISTINCT block_number, 0 AS tx_index, block_number AS value, block_number AS sender FROM e, top WHERE block_number BETWEEN t - 3000 AND t - 64")
def mirrored_txs(spark, d):
    """Transactions of blocks that became final came with them through the ring."""
    top, home = span(token_logs(spark, d))[1], folder(spark, "mirror")
    blocks = BlockStore(spark, f"{home}/store")
    ingest = HeadIngest(spark, blocks, PendingStore(spark, f"{home}/pending"), _chain(spark, d))
    ingest.advance(top - 30, start=top - 3_000)
    ingest.advance(top)
    covered = blocks.txs.join(blocks.tx_blocks.select("block_number"), "block_number", "left_semi")
    return covered.select("block_number", "tx_index", unsigned("value").alias("value"), number("from").alias("sender"))


# decoding

@query("SELECT o_orderkey, o_custkey AS a, [o_custkey, o_orderkey, 7] AS list, [o_orderkey, o_custkey] AS fixed, o_orderkey + 1 AS first, o_orderpriority AS note FROM orders".replace(
    "[o_custkey, o_orderkey, 7] AS list", "CAST(o_custkey AS VARCHAR) || ',' || CAST(o_orderkey AS VARCHAR) || ',7' AS list").replace(
    "[o_orderkey, o_custkey] AS fixed", "CAST(o_orderkey AS VARCHAR) || ',' || CAST(o_custkey AS VARCHAR) AS fixed"))
def abi_shapes(spark, d):
    """A dynamic array, a fixed one, a tuple and a text in one payload."""
    event = abi.parse_event("E(uint48 a, uint48[] list, uint48[2] fixed, (uint48,address) pair, string note)")
    o = _table(spark, d, "orders")
    c, k = as_word(F.col("o_custkey")), as_word(F.col("o_orderkey"))
    note = F.encode("o_orderpriority", "utf-8")
    padded = F.unhex(F.rpad(F.hex(note), 64, "0"))
    data = F.concat(c, F.lit((224).to_bytes(32, "big")), k, c, as_word(F.col("o_orderkey") + 1), c, F.lit((352).to_bytes(32, "big")),
                    F.lit((3).to_bytes(32, "big")), c, k, F.lit((7).to_bytes(32, "big")), as_word(F.octet_length(note)), padded)
    p = abi.bound(data, lambda made: abi.decode_event(event, F.array().cast("array<binary>"), made))  # the payload is made once a row
    joined = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
    return o.select("o_orderkey", p.alias("p")).select("o_orderkey", "p.a", joined("p.list").alias("list"), joined("p.fixed").alias("fixed"), F.col("p.pair._0").alias("first"), "p.note")


@query("SELECT s_suppkey, s_suppkey % 3 <> 0 AS ok, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey ELSE -1 END AS n, CASE WHEN s_suppkey % 3 <> 0 THEN s_name ELSE '' END AS name FROM supplier")
def abi_returns(spark, d):
    """Return values with a dynamic tail; cut short they are an error, not zeros."""
    s = _table(spark, d, "supplier")
    name = F.encode("s_name", "utf-8")
    whole = F.concat(as_word(F.col("s_suppkey")), F.lit((64).to_bytes(32, "big")), as_word(F.octet_length(name)), F.unhex(F.rpad(F.hex(name), 64, "0")))
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.substring(whole, 1, 90)).otherwise(whole)
    r = abi.decode_returns(raw, "uint48", "string")
    return s.select("s_suppkey", r.alias("r")).select("s_suppkey", "r.ok", F.coalesce("r.v0", F.lit(-1)).alias("n"), F.coalesce("r.v1", F.lit("")).alias("name"))


#: Signature, canonical form, topic. Fixed values of public standards.
_SIGNATURES = [
    ("Transfer(address indexed from, address indexed to, uint value)", "Transfer(address,address,uint256)", "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"),
    ("Approval(address indexed o, address indexed s, uint256 v)", "Approval(address,address,uint256)", "8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925"),
    ("Swap(address indexed a, uint b, uint c, uint d, uint e, address indexed f)", "Swap(address,uint256,uint256,uint256,uint256,address)", "d78ad95fa46c994b6551d0da85fc275fe613ce37657fb8d5e3d130840159d822"),
    ("Sync(uint112 a, uint112 b)", "Sync(uint112,uint112)", "1c411e9a96e071241c2f21f7726b17ae89e3cab4c78be50e062b03a9fffbbad1"),
    ("NameRegistered(string n, bytes32 indexed l, address indexed o, uint c, uint e)", "NameRegistered(string,bytes32,address,uint256,uint256)", "ca6abbe9d7f11422cb6ca7629fbf6fe9efb1c621f71ce8f02b9f2a230097404f"),
]


@query(values(_SIGNATURES, "signature, canonical, topic"))
def abi_signatures(spark, d):
    parsed = [(s, abi.parse_event(s)) for s, _, _ in _SIGNATURES]
    return told(spark, [(s, p.canonical, p.topic0.hex()) for s, p in parsed], "signature string, canonical string, topic string")


_LITERALS = [("0xae78736Cd615f374D3085123A210448E74Fc6393", "taken"), ("0xae78736cd615f374d3085123a210448e74fc6393", "refused"), ("0xd8dA6BF26964aF9D7eEd9e03E53415D37aA96045", "taken"), ("0x12", "refused")]


@query(values(_LITERALS, "literal, outcome"))
def address_literals(spark, d):
    out = []
    for literal, _ in _LITERALS:
        try:
            out.append((literal, "taken" if checksummed(address(literal)) == literal else "changed"))
        except ValueError:
            out.append((literal, "refused"))
    return told(spark, out, "literal string, outcome string")


@query("SELECT n_nationkey, lpad(printf('%x', n_nationkey), 64, '0') AS word, 'a9059cbb' AS method FROM nation")
def abi_calldata(spark, d):
    """A call's selector, and arguments as words."""
    word = F.concat(*[F.lit(abi.encode_arg(0)[:24]), F.unhex(F.lpad(F.hex("n_nationkey"), 16, "0"))])
    literals = {k: abi.encode_arg(k) for k in range(25)}
    same = F.element_at(F.create_map(*[x for k, v in literals.items() for x in (F.lit(k), F.lit(v))]), F.col("n_nationkey"))
    return _table(spark, d, "nation").select("n_nationkey", F.lower(F.hex(F.when(word == same, word))).alias("word"), F.lit(selector("transfer(address,uint256)").hex()).alias("method"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE o_custkey END AS target FROM orders")
def tx_creation(spark, d):
    """A transaction that created a contract has no target."""
    rows = _table(spark, d, "orders").select("o_orderkey", as_address(F.col("o_custkey")).alias("to"), F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(2).alias("flags"))
    return enrich.creation_aware(rows).select("o_orderkey", F.coalesce(number("to"), F.lit(-1)).alias("target"))


@query("SELECT o_orderkey, o_custkey AS value FROM orders")
def little_endian(spark, d):
    digits = F.lpad(F.hex("o_custkey"), 16, "0")
    turned = F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(8)])
    return _table(spark, d, "orders").select("o_orderkey", u256.narrow(u256.from_little_endian(F.unhex(F.rpad(turned, 64, "0"))), 56, False).alias("value"))


@query(f"{_E} SELECT user_id, user_id AS parsed FROM e GROUP BY user_id")
def parsed_address(spark, d):
    return event_logs(spark, d).select("user_id", number(text.parse_address(text.hex_address(F.col("address")))).alias("parsed")).distinct()


# declarations

@query(values([("purchase", True), ("click", True), ("view", True)], "event, once"))
def manifest_events(spark, d):
    """Events that several contracts declare are there once; the first declaration stands."""
    m = Manifest("m", 1, 0, contracts=(Contract("a", addr(1), (EVENT["purchase"], EVENT["click"])), Contract("b", addr(2), (Event("purchase(uint48 other)"), EVENT["view"]))))
    return told(spark, [(e.name, [x.topic0 for x in m.events].count(e.topic0) == 1 and (e.name != "purchase" or e is EVENT["purchase"])) for e in m.events], "event string, once boolean")


def _bad_manifests():
    sync, other = Event("Sync(uint112 a, uint112 b)"), Event("Other(uint256 a)")
    create = Event("Create(address child, uint256 n)")
    prefetch_on = lambda *calls: Manifest("m", 1, 0, prefetch=(Prefetch(create, calls),))
    return {
        "factories with other children": lambda: Manifest("m", 1, 0, factories=(Factory("f", addr(1), create, "child", (sync,)), Factory("g", addr(2), create, "child", (other,)))),
        "a child that is no address": lambda: Manifest("m", 1, 0, factories=(Factory("f", addr(1), create, "n", (sync,)),)),
        "an unknown parameter": lambda: Manifest("m", 1, 0, factories=(Factory("f", addr(1), create, "nobody", (sync,)),)),
        "a call of no earlier call": lambda: prefetch_on(Call("a()", Target("of", "b()"))),
        "a call without a method": lambda: prefetch_on(Call("")),
        "a literal that is no word": lambda: prefetch_on(Call("a(bytes)", args=(b"\x01",))),
        "a static call without a method": lambda: Manifest("m", 1, 0, static_prefetch=(StaticCall(addr(1), ""),)),
        "two tables of one name": lambda: Manifest("m", 1, 0, entities=(Entity("A", "mutable", (("id", "b20"),)), Entity("A", "immutable", (("id", "b16"),)))),
        "a storage that is none": lambda: Entity("A", "either", (("id", "b20"),)),
        "a key of any length": lambda: Entity("A", "mutable", (("id", "blob"),)),
        "a signature that is none": lambda: Event("no signature"),
    }


@query(values([(k, "ManifestError") for k in _bad_manifests()], '"case", outcome'))
def manifest_errors(spark, d):
    out = []
    for case, make in _bad_manifests().items():
        try:
            make()
            out.append((case, "taken"))
        except ManifestError:
            out.append((case, "ManifestError"))
    return told(spark, out, "case string, outcome string")


@query(values([("complete", "taken"), ("one missing", "LookupError"), ("one twice", "LookupError")], '"case", outcome'))
def dense_refusals(spark, d):
    whole, out = dense_blocks(spark, 100, 200), []
    for case, blocks in {"complete": whole, "one missing": whole.where("block_number <> 150"), "one twice": whole.unionAll(whole.where("block_number = 150"))}.items():
        try:
            filtering.require_dense(blocks, 100, 200)
            out.append((case, "taken"))
        except LookupError:
            out.append((case, "LookupError"))
    return told(spark, out, "case string, outcome string")


# prefetch

_ASKED = Manifest("asked", 1, 0, contracts=(Contract("any", addr(0), (EVENT["view"],)),), static_prefetch=(StaticCall(addr(1_000_000), "name()"),), prefetch=(
    Prefetch(EVENT["view"], (Call("nation()"), Call("region()", Target("of", "nation()")))),))


def _answer(calls):
    """nation() of a user is user % 25 + 100000, reverted for every eleventh; region() of n is n % 5; a batch of 500 that begins with a user below 3 fails."""
    out = []
    for target, data in calls:
        n = int.from_bytes(target, "big")
        if data == selector("nation()"):
            out.append((1, b"") if n % 11 == 0 else (0, (n % 25 + 100_000).to_bytes(32, "big")))
        else:
            out.append((0, (n % 5).to_bytes(32, "big")))
    return out


@query(f"""{_E}, u AS (SELECT DISTINCT user_id AS n FROM e WHERE event_type = 'view'), k AS (SELECT DISTINCT n % 25 + 100000 AS n FROM u WHERE n % 11 <> 0)
    SELECT n AS target, 'nation' AS method, CASE WHEN n % 11 = 0 THEN -1 ELSE n % 25 + 100000 END AS value FROM u UNION ALL SELECT n, 'region', n % 5 FROM k UNION ALL SELECT 1000000, 'name', 0""")
def prefetch_rounds(spark, d):
    """Calls in rounds as deep as they chain: what the first round answered is what the second asks."""
    home, parts = folder(spark, "calls"), []

    def write(results: DataFrame, k: int) -> DataFrame:
        results.write.parquet(f"{home}/{k}")
        parts.append(f"{home}/{k}")
        return spark.read.parquet(*parts)

    from chainfold.sources.schemas import CALL_CACHE

    cache = prefetch.run_rounds(event_logs(spark, d), _ASKED, spark.createDataFrame([], CALL_CACHE), _answer, write)
    name = F.when(F.col("calldata") == F.lit(selector("nation()")), "nation").when(F.col("calldata") == F.lit(selector("region()")), "region").otherwise("name")
    return enrich.current_calls(cache).select(number("target").alias("target"), name.alias("method"), F.coalesce(unsigned("value"), F.lit(-1)).alias("value"))


@query(f"{_E}, u AS (SELECT DISTINCT user_id AS n FROM e) SELECT count(*) AS calls, count(*) AS answered FROM u")
def prefetch_batches(spark, d):
    """A batch that fails is left out and asked for again; the others stand."""
    asked = event_logs(spark, d).select(F.col("address").alias("target"), F.lit(selector("nation()")).alias("calldata")).distinct().coalesce(1)
    broken = prefetch.fetch_all(asked, lambda calls: None if any(int.from_bytes(t, "big") == 0 for t, _ in calls) else _answer(calls), 1)
    rest = prefetch.missing(asked, broken)
    done = broken.unionAll(prefetch.fetch_all(rest, _answer, 2))
    return asked.agg(F.count("*").alias("calls")).crossJoin(F.broadcast(done.agg(F.count("*").alias("answered"))))


@query(values([("no transactions", "TxFieldsUnavailable"), ("transactions of all blocks", "taken"), ("a log without its transaction", "refused")], '"case", outcome'))
def tx_refusals(spark, d):
    """A manifest that wants transactions needs them for every block, and every log needs its own."""
    from .runner import TxFieldsUnavailable

    home, out = folder(spark, "refused"), []
    paid = Event("Transfer(address indexed from, address indexed to, uint256 value)", tx_fields=True)
    m = Manifest("paid", 1, 0, contracts=(Contract("t", TOKEN, (paid,)),))
    top = span(token_logs(spark, d))[1]
    blocks, logs, txs = _chain(spark, d)(top - 500, top)
    for case, given in {"no transactions": None, "transactions of all blocks": txs}.items():
        there = BlockStore(spark, f"{home}/{len(out)}")
        there.append(logs, blocks, given)
        try:
            Indexer(spark, there, f"{home}/run{len(out)}", m, erc20.handler).build_index()
            out.append((case, "taken"))
        except TxFieldsUnavailable:
            out.append((case, "TxFieldsUnavailable"))
    try:
        enrich.with_transactions(logs, txs.limit(0)).write.format("noop").mode("overwrite").save()
        out.append(("a log without its transaction", "taken"))
    except Exception as error:
        out.append(("a log without its transaction", "refused" if "MissingTxRecord" in str(error) else "failed"))
    return told(spark, out, "case string, outcome string")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey + 50000000 AS BIGINT) AS token, CASE WHEN n_nationkey % 2 = 0 THEN 6 ELSE 18 END AS decimals FROM nation")
def tip_prefetch(spark, d):
    """Pools of pending blocks: their tokens are asked for when the tip is read."""
    home, factory = folder(spark, "tip"), b"\xfa" * 20
    made = _table(spark, d, "nation").select(
        F.lit(11).cast("long").alias("block_number"), F.lit(0).alias("tx_index"), F.col("n_nationkey").cast("int").alias("log_index"), F.lit(factory).alias("address"),
        F.array(F.lit(pairs.CREATED.topic0), as_word(F.lit(1)), as_word(F.lit(2))).alias("topics"), F.lit(pairs.CREATED.topic0).alias("topic0"),
        F.concat(F.lit(bytes(12)), as_address(F.col("n_nationkey")), as_word(F.lit(1))).alias("data"), F.lit(None).cast("binary").alias("tx_hash"))
    blocks = BlockStore(spark, f"{home}/store")
    blocks.append(spark.createDataFrame([], LOGS), dense_blocks(spark, 1, 10))
    indexer = Indexer(spark, blocks, f"{home}/run", pairs.manifest(factory, start_block=1), pairs.handler, _pool_answer)
    indexer.start().tick(dense_blocks(spark, 11, 12), made, 10)
    return indexer.tip("pools").select(number("id").alias("id"), number("first_token").alias("token"), F.col("first_decimals").cast("int").alias("decimals"))


def _pool_answer(calls):
    """token0() of a pool is its number and fifty million; decimals() of even tokens are 6; nothing else answers."""
    out = []
    for target, data in calls:
        n = int.from_bytes(target, "big")
        if data == selector("token0()"):
            out.append((0, (n + 50_000_000).to_bytes(32, "big")))
        elif data == selector("decimals()") and n % 2 == 0:
            out.append((0, (6).to_bytes(32, "big")))
        else:
            out.append((1, b""))
    return out


# the other indexers

@query("""WITH s AS (SELECT l_orderkey AS id, arg_max(CAST(round(l_quantity * 100) AS BIGINT), k) AS reserve0 FROM (SELECT l_orderkey, l_quantity,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) AS k FROM lineitem) GROUP BY l_orderkey)
    SELECT o_orderkey AS id, o_orderkey + 50000000 AS token0, CASE WHEN o_orderkey % 2 = 0 THEN 6 ELSE 18 END AS token0_decimals, coalesce(reserve0, -1) AS reserve0
    FROM orders LEFT JOIN s ON s.id = o_orderkey WHERE o_orderstatus = 'F'""")
def pairs_state(spark, d):
    """Pairs that a factory made, with what their tokens answer and the last reserves."""
    from pyspark.sql.window import Window

    factory, home = b"\xfa" * 20, folder(spark, "pairs")
    word = lambda c: as_word(c)
    o = _table(spark, d, "orders").where("o_orderstatus = 'F'")
    made = o.select(F.col("o_orderkey").alias("n"), F.lit(1).cast("long").alias("block_number"), F.lit(0).alias("tx_index"), F.col("o_orderkey").cast("int").alias("log_index"), F.lit(factory).alias("address"),
                    F.array(F.lit(pairs.CREATED.topic0), word(F.lit(1)), word(F.lit(2))).alias("topics"), F.lit(pairs.CREATED.topic0).alias("topic0"),
                    F.concat(F.lit(bytes(12)), as_address(F.col("o_orderkey")), word(F.lit(1))).alias("data"), F.lit(None).cast("binary").alias("tx_hash")).drop("n")
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_extendedprice"))
    synced = _table(spark, d, "lineitem").withColumn("k", k).select(
        F.lit(2).cast("long").alias("block_number"), F.col("l_orderkey").cast("int").alias("tx_index"), "k", as_address(F.col("l_orderkey")).alias("address"),
        F.array(F.lit(pairs.SYNC.topic0)).alias("topics"), F.lit(pairs.SYNC.topic0).alias("topic0"), F.concat(word(cents("l_quantity")), word(F.lit(5))).alias("data"),
        F.lit(None).cast("binary").alias("tx_hash")).withColumnRenamed("k", "log_index")
    blocks = BlockStore(spark, f"{home}/store")
    blocks.append(made.unionByName(synced), dense_blocks(spark, 1, 2))

    indexer = Indexer(spark, blocks, f"{home}/run", pairs.manifest(factory), pairs.handler, _pool_answer)
    indexer.run()
    return indexer.state.view().table("pools").select(
        number("id").alias("id"), number("first_token").alias("token0"), F.col("first_decimals").cast("int").alias("token0_decimals"), F.coalesce(F.col("first_reserve").cast("long"), F.lit(-1)).alias("reserve0"))


@query("SELECT c_custkey AS label, c_name AS name, c_custkey % 7 AS owner FROM customer")
def registry_names(spark, d):
    """The latest registration of each label, with names of any length."""
    home = folder(spark, "names")
    c = _table(spark, d, "customer")
    name = F.encode("c_name", "utf-8")

    def registered(block: int, named: Column, owner: Column) -> DataFrame:
        data = F.concat(F.lit((96).to_bytes(32, "big")), as_word(F.lit(5)), as_word(F.lit(9)), as_word(F.octet_length(named)), F.unhex(F.rpad(F.hex(named), 128, "0")))
        return c.select(F.lit(block).cast("long").alias("block_number"), F.lit(0).alias("tx_index"), F.col("c_custkey").cast("int").alias("log_index"), F.lit(TOKEN).alias("address"),
                        F.array(F.lit(registry.REGISTERED.topic0), as_word(F.col("c_custkey")), F.concat(F.lit(bytes(12)), as_address(owner))).alias("topics"),
                        F.lit(registry.REGISTERED.topic0).alias("topic0"), data.alias("data"), F.lit(None).cast("binary").alias("tx_hash"))

    blocks = BlockStore(spark, f"{home}/store")
    blocks.append(registered(1, F.lit(b"an earlier name that is longer than a word of thirty-two bytes"), F.lit(3)).unionByName(registered(2, name, F.col("c_custkey") % 7)), dense_blocks(spark, 1, 2))
    indexer = Indexer(spark, blocks, f"{home}/run", registry.manifest(TOKEN), registry.handler)
    indexer.run()
    return indexer.state.view().table("labels").select(number("label").alias("label"), F.col("text").cast("string").alias("name"), number("holder").alias("owner"))


@query(f"{_LEGS} SELECT id, CAST(sum(v) AS BIGINT) AS balance FROM legs GROUP BY id")
def external_read(spark, d):
    """A state table read without the engine: its pointer names plain Parquet folders, later ones win."""
    state = built(spark, d)[1].state
    pointer = json.loads(store.read_text(spark, f"{state.path}/CURRENT.json"))
    layers = [spark.read.parquet(p).withColumn("layer", F.lit(k)) for k, p in enumerate(pointer["tables"]["accounts"])]
    rows = layers[0]
    for more in layers[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("id").agg(F.max_by("balance", "layer").alias("balance")).select(number("id").alias("id"), signed("balance").alias("balance"))


@query(f"{_E}, top AS (SELECT max(block_number) AS t FROM e WHERE event_type IN ('purchase', 'click')) SELECT t AS cursor, (SELECT count(*) FROM e WHERE event_type = 'purchase') AS transfers, 3 AS tables FROM top")
def cli_commands(spark, d):
    """The command line over the same store: run a module's manifest, and the store's status."""
    from chainfold import cli

    blocks = built(spark, d)[0]
    told_ = json.loads(cli.main(["run", blocks.path, f"{folder(spark, 'cli')}/run", "--module", "chainfold.plans.erc20",
                                 "--args", json.dumps({"address": checksummed(TOKEN), "start_block": blocks.meta["first"]})], spark))
    status = cli.main(["status", blocks.path], spark).splitlines()
    return told(spark, [(told_["cursor"], told_["counts"]["transfers"], len(status))], "cursor long, transfers long, tables int")


@query(f"{_E} SELECT event_id, block_number, user_id, cents FROM e WHERE event_type = 'purchase' AND block_number <= {CUT}")
def handler_context(spark, d):
    """What a handler has beside its events: transactions and times of the same blocks."""
    from .runner import Context

    blocks, indexer, _ = built(spark, d)
    events = filtering.dispatch(indexer.index().where(F.col("block_number") <= CUT), indexer.manifest)["Transfer"]
    txs = events.select("block_number", "tx_index").distinct().select("block_number", "tx_index", *[F.lit(None).cast(f.dataType).alias(f.name) for f in TXS.fields[2:]])
    context = Context(indexer.manifest, txs, blocks.blocks, indexer.cache(), indexer.state.view())
    rows = context.with_time(context.with_tx(events)).where("timestamp = block_number * 12")
    return rows.select(F.col("log_index").cast("long").alias("event_id"), "block_number", number("params.from").alias("user_id"), u256.narrow(F.col("params.value"), 56, False).alias("cents"))
