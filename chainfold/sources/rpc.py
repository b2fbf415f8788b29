"""JSON-RPC sources: recorded or live responses as rows, and a data source that splits a range into spans."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .schemas import LOGS, TXS

LEAST_SPAN, MOST_SPAN, TRIES = 512, 8192, 5
LOG_JSON = "blockNumber string, transactionIndex string, logIndex string, address string, topics array<string>, data string, transactionHash string"
TX_STRUCT = "blockNumber:string,transactionIndex:string,type:string,`from`:string,`to`:string,value:string"
TX_JSON = "blockNumber string, transactionIndex string, type string, `from` string, `to` string, value string"


def quantity(c: Column) -> Column:
    """`0x…` to a long."""
    return F.conv(F.substring(c, 3, 64), 16, 10).cast("long")


def word(c: Column) -> Column:
    """`0x…` of up to 64 digits to a 32-byte word."""
    return F.unhex(F.lpad(F.substring(c, 3, 64), 64, "0"))


def hex_bytes(c: Column) -> Column:
    return F.unhex(F.substring(c, 3, 1 << 30))


def to_logs(rows: DataFrame) -> DataFrame:
    """Rows of LOG_JSON to logs: four topics at most, missing numbers are 0."""
    topics = F.transform(F.slice(F.coalesce("topics", F.array().cast("array<string>")), 1, 4), hex_bytes)
    number = lambda c: F.coalesce(quantity(F.col(c)), F.lit(0))
    return rows.select(
        number("blockNumber").alias("block_number"), number("transactionIndex").cast("int").alias("tx_index"), number("logIndex").cast("int").alias("log_index"),
        hex_bytes(F.col("address")).alias("address"), topics.alias("topics"), F.get(topics, 0).alias("topic0"),
        F.coalesce(hex_bytes(F.col("data")), F.lit(b"")).alias("data"), hex_bytes(F.col("transactionHash")).alias("tx_hash"))


def to_txs(rows: DataFrame, mask: DataFrame) -> DataFrame:
    """Rows of TX_JSON to the transactions of a mask; one that is missing fails the job."""
    from chainfold.operators.enrich import select_by_mask

    parsed = rows.select(
        quantity(F.col("blockNumber")).alias("block_number"), quantity(F.col("transactionIndex")).cast("int").alias("tx_index"),
        F.coalesce(quantity(F.col("type")), F.lit(0)).cast("int").alias("tx_type"), hex_bytes(F.col("from")).alias("from"),
        hex_bytes(F.col("to")).alias("to"), word(F.col("value")).alias("value"), F.lit(False).alias("from_unrecovered"))
    return select_by_mask(parsed, mask).select(*TXS.names)


def to_timestamps(rows: DataFrame, start: int, end: int) -> DataFrame:
    """(block_number, ts) from rows of (number, timestamp); all of start to end, or it fails."""
    found = rows.select(quantity(F.col("number")).alias("block_number"), quantity(F.col("timestamp")).alias("ts"))
    n = found.where(F.col("block_number").between(start, end)).select("block_number").distinct().count()
    if n != end - start + 1:
        raise LookupError(f"{n} of {end - start + 1} timestamps from {start} to {end}")
    return found


def head_number(message: Column) -> Column:
    """The block number of a newHeads notification."""
    return quantity(F.get_json_object(message, "$.params.result.number"))


def call_node(url: str, method: str, params: list) -> object:
    """The node's answer. A `file:` url is a recording: JSON with head, blocks (with their transactions) and logs."""
    if url.startswith("file:"):
        return _recorded(url.removeprefix("file:"), method, params)
    body = json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}).encode()
    request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=60) as answer:
        found = json.load(answer)
    if "error" in found:
        raise OSError(found["error"])
    return found["result"]


def _recorded(path: str, method: str, params: list) -> object:
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    match method:
        case "eth_blockNumber":
            return hex(held["head"])
        case "eth_getBlockByNumber":
            return next((b for b in held["blocks"] if b["number"] == params[0]), None)
        case "eth_getLogs":
            low, high = (int(params[0][k], 16) for k in ("fromBlock", "toBlock"))
            if high - low >= held.get("most", MOST_SPAN):
                raise OSError("too many blocks")
            wanted = params[0].get("address")
            return [r for r in held["logs"] if low <= int(r["blockNumber"], 16) <= high and (not wanted or r["address"] in wanted)]
    raise OSError(f"{method} was not recorded")


def fetch_logs(ask: Callable[[int, int], list[dict]], start: int, end: int) -> Iterator[dict]:
    """Logs of the blocks in order. Spans double from LEAST_SPAN to MOST_SPAN and halve on errors; a block that fails TRIES times fails."""
    at, span, failed = start, LEAST_SPAN, 0
    while at <= end:
        stop = min(end, at + span - 1)
        try:
            rows = ask(at, stop)
        except OSError:
            failed += 1
            if failed >= TRIES and span == 1:
                raise
            span = max(1, span // 2)
            continue
        yield from sorted(rows, key=lambda r: (int(r["blockNumber"], 16), int(r.get("logIndex") or "0x0", 16)))
        at, span, failed = stop + 1, min(MOST_SPAN, span * 2), 0


class Span(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class RpcLogSource(DataSource):
    """spark.read.format("chain_rpc").options(url=…, start=…, end=…): logs of a node, a task for each span of blocks."""

    @classmethod
    def name(cls) -> str:
        return "chain_rpc"

    def schema(self):
        return LOGS

    def reader(self, schema) -> DataSourceReader:
        return RpcLogReader(self.options)


class RpcLogReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.start, self.end = options["url"], int(options["start"]), int(options["end"])
        self.addresses = [a for a in options.get("addresses", "").split(",") if a]

    def partitions(self):
        return [Span(a, min(self.end, a + MOST_SPAN - 1)) for a in range(self.start, self.end + 1, MOST_SPAN)]

    def read(self, partition: Span):
        def ask(a: int, b: int):
            wanted = {"fromBlock": hex(a), "toBlock": hex(b)} | ({"address": self.addresses} if self.addresses else {})
            return call_node(self.url, "eth_getLogs", [wanted])

        raw = lambda x: bytes.fromhex((x or "0x")[2:])
        for r in fetch_logs(ask, partition.start, partition.end):
            topics = [raw(t) for t in r["topics"][:4]]
            yield (int(r["blockNumber"], 16), int(r.get("transactionIndex") or "0x0", 16), int(r.get("logIndex") or "0x0", 16), raw(r["address"]),
                   topics, topics[0] if topics else None, raw(r["data"]), raw(r["transactionHash"]) if r.get("transactionHash") else None)


class HeadSource(DataSource):
    """spark.readStream.format("chain_head").option("url", …): the head's number, whenever it moves.

    The offset of the stream is the head, so a restarted query goes on where it stopped.
    """

    @classmethod
    def name(cls) -> str:
        return "chain_head"

    def schema(self) -> str:
        return "head long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return HeadReader(self.options)


class HeadReader(DataSourceStreamReader):
    def __init__(self, options):
        self.url, self.start = options["url"], int(options.get("start", "-1"))

    def head(self) -> int:
        return int(call_node(self.url, "eth_blockNumber", []), 16)

    def initialOffset(self) -> dict:
        return {"head": self.start}

    def latestOffset(self) -> dict:
        return {"head": self.head()}

    def partitions(self, start: dict, end: dict):
        return [Span(start["head"], end["head"])]

    def read(self, partition: Span):
        if partition.end > partition.start:
            yield (partition.end,)


def register(spark) -> None:
    """Make the sources known to a session."""
    for source in (RpcLogSource, HeadSource):
        spark.dataSource.register(source)


BLOCK_JSON = "number string, hash string, parentHash string, timestamp string"


def _blocks(spark, url: str, start: int, end: int, full: bool) -> DataFrame:
    """A JSON text for each block, asked for on the executors; one that the node lacks fails the job."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                found = call_node(url, "eth_getBlockByNumber", [hex(n), full])
                if found is None:
                    raise LookupError(f"the node has no block {n}")
                yield pa.RecordBatch.from_pydict({"json": [json.dumps(found)]})

    return spark.range(start, end + 1).mapInArrow(ask, "json string")


def chain(spark, url: str, with_txs: bool = False):
    """A node's chain as (blocks, logs, transactions or None) of a span, as head ingestion asks for it."""
    register(spark)

    def span(start: int, end: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        raw = _blocks(spark, url, start, end, with_txs)
        j = raw.select(F.from_json("json", BLOCK_JSON + f", transactions array<struct<{TX_STRUCT}>>" * with_txs).alias("j"))
        blocks = j.select(quantity(F.col("j.number")).alias("block_number"), hex_bytes(F.col("j.hash")).alias("block_hash"),
                          hex_bytes(F.col("j.parentHash")).alias("parent_hash"), quantity(F.col("j.timestamp")).alias("ts"))
        logs = spark.read.format("chain_rpc").options(url=url, start=str(start), end=str(end)).load()
        if not with_txs:
            return blocks, logs, None
        from chainfold.operators.enrich import tx_mask

        return blocks, logs, to_txs(j.select(F.explode("j.transactions").alias("t")).select("t.*"), tx_mask(logs))

    return span


def import_txs(store, url: str, span: int = 128) -> int:
    """Fetch the transactions of stored blocks that have none, span by span, from where an earlier run stopped. Returns how many blocks."""
    done, meta = 0, store.meta
    for part in [p for p in meta["parts"] if p not in meta["with_txs"]]:
        blocks, logs = store.part(part)
        low, high = blocks.agg(F.min("block_number"), F.max("block_number")).first()
        for start in range(low, high + 1, span):
            end = min(high, start + span - 1)
            here = F.col("block_number").between(start, end)
            found = _blocks(store.spark, url, start, end, True).select(F.from_json("json", f"transactions array<struct<{TX_STRUCT}>>").alias("j"))
            from chainfold.operators.enrich import tx_mask

            store.add_txs(part, start, to_txs(found.select(F.explode("j.transactions").alias("t")).select("t.*"), tx_mask(logs.where(here))))
            done += end - start + 1
        store.txs_done(part)
    return done


def missing_txs(logs: DataFrame, txs: DataFrame) -> DataFrame:
    """(block_number, tx_index) of transactions with logs that are not fetched yet: where an interrupted import goes on."""
    from chainfold.operators.enrich import tx_mask

    return tx_mask(logs).join(txs.select("block_number", "tx_index"), ["block_number", "tx_index"], "left_anti")
