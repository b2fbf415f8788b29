"""Binary sources: RLP, receipts, transactions, and the block they belong to.

Each decoder is a plain function of bytes; the DataFrame sources run them in Arrow batches on the
executors over a dump of (key, value) rows.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chainfold.functions.keccak import keccak256, keccak256_all

from .schemas import BLOCKS, LOGS, TXS


class RlpError(ValueError):
    """Bytes that are not the RLP that was expected."""


def rlp_item(data: bytes, at: int = 0) -> tuple[bytes | list, int]:
    """The item at a place, and the place after it."""
    kind, start, end = rlp_span(data, at)
    if kind == "bytes":
        return data[start:end], end
    items = []
    while start < end:
        item, start = rlp_item(data, start)
        items.append(item)
    if start != end:
        raise RlpError("a list's items run past its end")
    return items, end


def rlp_span(data: bytes, at: int) -> tuple[str, int, int]:
    """Kind, start and end of the payload of the item at a place."""
    if at >= len(data):
        raise RlpError("no item where one was expected")
    first = data[at]
    if first < 0x80:
        kind, start, size = "bytes", at, 1
    elif first < 0xB8:
        kind, start, size = "bytes", at + 1, first - 0x80
    elif first < 0xC0:
        n = first - 0xB7
        kind, start, size = "bytes", at + 1 + n, int.from_bytes(data[at + 1 : at + 1 + n], "big")
    elif first < 0xF8:
        kind, start, size = "list", at + 1, first - 0xC0
    else:
        n = first - 0xF7
        kind, start, size = "list", at + 1 + n, int.from_bytes(data[at + 1 : at + 1 + n], "big")
    if start + size > len(data):
        raise RlpError("an item runs past the end of its data")
    return kind, start, start + size


def rlp_encode(item: bytes | int | list) -> bytes:
    if isinstance(item, int):
        item = item.to_bytes((item.bit_length() + 7) // 8, "big")
    if isinstance(item, list):
        body, low = b"".join(map(rlp_encode, item)), 0xC0
    elif len(item) == 1 and item[0] < 0x80:
        return item
    else:
        body, low = item, 0x80
    if len(body) < 56:
        return bytes([low + len(body)]) + body
    size = len(body).to_bytes((len(body).bit_length() + 7) // 8, "big")
    return bytes([low + 55 + len(size)]) + size + body


def _uint(raw: bytes) -> int:
    return int.from_bytes(raw, "big")


def header_timestamp(header: bytes) -> int:
    """Field 11 of a block header."""
    fields, _ = rlp_item(header)
    if not isinstance(fields, list) or len(fields) < 12:
        raise RlpError("a header has at least 12 fields")
    return _uint(fields[11])


def decode_receipts(block: int, value: bytes) -> list[tuple]:
    """Compact receipts [[post, cumulative gas, sender, [log, ...]], ...] or without sender, to rows of logs.

    A log is [address, [topic, ...], data]; log numbers run through the block; hashes are unknown.
    """
    receipts, _ = rlp_item(value)
    rows, number = [], 0
    for tx, receipt in enumerate(receipts):
        for log in receipt[-1]:
            address, topics, data = log[0], log[1], log[2]
            if len(address) != 20 or len(topics) > 4 or any(len(t) != 32 for t in topics):
                raise RlpError(f"block {block}, transaction {tx}: a malformed log")
            rows.append((block, tx, number, address, topics, topics[0] if topics else None, data, None))
            number += 1
    return rows


def decode_senders(value: bytes) -> list[tuple[bytes | None, bool]]:
    """For each receipt its sender, if it has one, and whether it has logs."""
    receipts, _ = rlp_item(value)
    return [(r[2] if len(r) > 3 and len(r[2]) == 20 else None, bool(r[-1])) for r in receipts]


#: Transaction type: the places of to, value, v and of the unsigned part's length. Fixed values.
_PLACES = {0: (3, 4, 6, 6), 1: (4, 5, 8, 8), 2: (5, 6, 9, 9), 3: (5, 6, 11, 11), 4: (5, 6, 10, 10)}


def decode_transaction(raw: bytes, signed: bool = True) -> dict:
    """to (None for a creation), value, type, and if `signed` the hash that was signed with v, r and s."""
    if not raw:
        raise RlpError("an empty transaction")
    kind = 0 if raw[0] >= 0xC0 else raw[0]
    if kind not in _PLACES:
        raise RlpError(f"transaction type {kind} is not known")
    fields, end = rlp_item(raw, 0 if kind == 0 else 1)
    to, value, v, n = _PLACES[kind]
    if not isinstance(fields, list) or len(fields) < v + 3 or end != len(raw):
        raise RlpError("a transaction with too few fields")
    unsigned, parity = fields[:n], _uint(fields[v])
    if kind == 0:
        if parity >= 35:
            unsigned, parity = [*unsigned, (parity - 35) // 2, b"", b""], (parity - 35) % 2
        else:
            parity -= 27
    prefix = bytes([kind]) if kind else b""
    return {"tx_type": kind, "to": fields[to] or None, "value": _uint(fields[value]).to_bytes(32, "big"),
            "hash": keccak256(prefix + rlp_encode(unsigned)) if signed else None, "parity": parity, "r": _uint(fields[v + 1]), "s": _uint(fields[v + 2])}


# secp256k1: fixed values
_P = 2**256 - 2**32 - 977
_N = 0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFEBAAEDCE6AF48A03BBFD25E8CD0364141
_G = (0x79BE667EF9DCBBAC55A06295CE870B07029BFCDB2DCE28D959F2815B16F81798, 0x483ADA7726A3C4655DA4FBFC0E1108A8FD17B448A68554199C47D08FFB10D4B8)


def _plus(a, b):
    if a is None or b is None:
        return a or b
    if a[0] == b[0]:
        if (a[1] + b[1]) % _P == 0:
            return None
        slope = 3 * a[0] * a[0] * pow(2 * a[1], -1, _P)
    else:
        slope = (b[1] - a[1]) * pow(b[0] - a[0], -1, _P)
    x = (slope * slope - a[0] - b[0]) % _P
    return x, (slope * (a[0] - x) - a[1]) % _P


def _times(k: int, point):
    out = None
    while k:
        if k & 1:
            out = _plus(out, point)
        point, k = _plus(point, point), k >> 1
    return out


def public_address(secret: int) -> bytes:
    x, y = _times(secret, _G)
    return keccak256(x.to_bytes(32, "big") + y.to_bytes(32, "big"))[12:]


def recover_sender(digest: bytes, parity: int, r: int, s: int) -> bytes | None:
    """The address whose key signed the hash, or None for a signature that no key made."""
    if not (0 < r < _N and 0 < s < _N and parity in (0, 1)):
        return None
    square = (pow(r, 3, _P) + 7) % _P
    y = pow(square, (_P + 1) // 4, _P)
    if y * y % _P != square:
        return None
    y = y if y % 2 == parity else _P - y
    inverse = pow(r, -1, _N)
    z = int.from_bytes(digest, "big")
    q = _plus(_times(s * inverse % _N, (r, y)), _times(-z * inverse % _N, _G))
    return keccak256(q[0].to_bytes(32, "big") + q[1].to_bytes(32, "big"))[12:] if q else None


def body_transactions(body: bytes) -> list[bytes]:
    """The raw transactions of a block body [[tx, ...], ...]; typed ones stand as byte strings."""
    _, start, end = rlp_span(body, 0)
    kind, start, end = rlp_span(body, start)
    if kind != "list":
        raise RlpError("a body begins with its list of transactions")
    out = []
    while start < end:
        kind, a, b = rlp_span(body, start)
        out.append(body[start:b] if kind == "list" else body[a:b])
        start = b
    return out


def block_transactions(block: int, receipts: bytes, body: bytes) -> list[tuple]:
    """Rows of txs for the transactions with logs; receipts and body must pair up."""
    senders, raws = decode_senders(receipts), body_transactions(body)
    if len(senders) != len(raws):
        raise RlpError(f"block {block}: {len(senders)} receipts for {len(raws)} transactions")
    rows = []
    for k, ((sender, has_logs), raw) in enumerate(zip(senders, raws, strict=True)):
        if has_logs:
            tx = decode_transaction(raw, signed=sender is None)
            sender = sender or recover_sender(tx["hash"], tx["parity"], tx["r"], tx["s"])
            rows.append((block, k, tx["tx_type"], sender, tx["to"], tx["value"], sender is None))
    return rows


#: Bytes of one batch that Python gets, and rows of one that it gives: a batch is blocks, and each may be megabytes of many logs.
BATCH_BYTES, OUT_ROWS = 4 << 20, 2_000


def small_batches(df: DataFrame) -> DataFrame:
    """The session's batches for Python are cut by bytes, so that a worker's memory does not follow the size of blocks."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def _decoded(batches: Iterator[pa.RecordBatch], decode, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows that decode(record) gives; at most OUT_ROWS and those of one record are held at once."""
    made = []
    flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    for batch in batches:
        record = namedtuple("Record", batch.schema.names)
        for k in range(batch.num_rows):
            made += decode(record(*[c[k].as_py() for c in batch.columns]))
            while len(made) >= OUT_ROWS:
                yield flush(made[:OUT_ROWS])
                del made[:OUT_ROWS]
    if made:
        yield flush(made)


def _rows(df: DataFrame, decode, schema) -> DataFrame:
    arrow = to_arrow_schema(schema)
    return small_batches(df).mapInArrow(lambda batches: _decoded(batches, decode, arrow), schema)


def receipt_logs(dump: DataFrame) -> DataFrame:
    """Logs from (block_number, receipts)."""
    return _rows(dump.select("block_number", "receipts"), lambda r: decode_receipts(r.block_number, bytes(r.receipts)), LOGS)


def block_txs(dump: DataFrame) -> DataFrame:
    """Transactions with logs from (block_number, receipts, body)."""
    return _rows(dump.select("block_number", "receipts", "body"), lambda r: block_transactions(r.block_number, bytes(r.receipts), bytes(r.body)), TXS)


def header_blocks(dump: DataFrame, hashes: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(block_number, block_hash, parent_hash, ts) from (block_number, header), without blocks that are known.

    Of repeated blocks the one with the canonical hash stands, or without `hashes` the least.
    """
    schema = to_arrow_schema(BLOCKS)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            headers = batch.column("header").to_pylist()
            fields = [rlp_item(h)[0] for h in headers]
            yield pa.RecordBatch.from_arrays([batch.column("block_number"), pa.array(keccak256_all(headers), pa.binary()), pa.array([f[0] for f in fields], pa.binary()),
                                              pa.array(map(header_timestamp, headers), pa.int64())], schema=schema)

    if known is not None:
        dump = dump.join(known.select("block_number").hint("merge"), "block_number", "left_anti")
    rows = dump.select(F.col("block_number").cast("long").alias("block_number"), "header").mapInArrow(decode, BLOCKS)
    if hashes is not None:
        rows = canonical(rows, hashes)
    return rows.groupBy("block_number").agg(F.min(F.struct("block_hash", "parent_hash", "ts")).alias("b")).select("block_number", "b.*")


def with_hash(dump: DataFrame) -> DataFrame:
    """The dump's rows with block_hash, that of their header."""
    out = T.StructType([*dump.schema.fields, T.StructField("block_hash", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(keccak256_all(batch.column("header").to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "block_hash"])

    return dump.mapInArrow(run, out)


def resolved(dump: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """One row of a dump for each block: of repeated ones that of the canonical chain. Only their headers are hashed."""
    if dump.groupBy("block_number").count().where("count > 1").isEmpty():
        return dump
    if hashes is None or "header" not in dump.columns:
        return canonical(dump, None)
    many = dump.groupBy("block_number").count().where("count > 1").select("block_number").hint("merge")
    picked = canonical(with_hash(dump.join(many, "block_number", "left_semi")), hashes).drop("block_hash").dropDuplicates(["block_number"])
    return dump.join(many, "block_number", "left_anti").unionByName(picked)


def matching_rows(dump: DataFrame, logs: DataFrame) -> DataFrame:
    """The rows of a dump whose receipts have the (transaction, log, address) shape of the stored logs, one for each block.

    For passes over a dump that come after its logs, without canonical hashes: repeated blocks are told
    apart by what was stored of them.
    """
    marked = dump.withColumn("_row", F.monotonically_increasing_id())
    shape = lambda rows, *by: rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("tx_index", "log_index", "address"))).alias("_shape"))
    fields = T.StructType([T.StructField("_row", T.LongType()), *LOGS.fields])
    decoded = _rows(marked.select(F.col("_row").alias("number"), "block_number", "receipts"),
                    lambda r: ((r.number, *x) for x in decode_receipts(r.block_number, bytes(r.receipts))), fields)
    empty = F.expr("cast(array() as array<struct<tx_index:int,log_index:int,address:binary>>)")
    theirs = marked.join(shape(decoded, "_row").hint("merge"), "_row", "left").withColumn("_shape", F.coalesce("_shape", empty))
    stored = shape(logs, F.col("block_number").alias("_block")).withColumnRenamed("_shape", "_stored")
    return theirs.join(stored.hint("merge"), F.col("block_number") == F.col("_block"), "left").where(F.col("_shape") == F.coalesce("_stored", empty)).dropDuplicates(
        ["block_number"]).select(*dump.columns)


def canonical(dump: DataFrame, hashes: DataFrame | None) -> DataFrame:
    """The rows of (block_number, block_hash, ...) on the canonical chain; repeated blocks need `hashes` to choose by.

    Hashes and blocks are as many as the dump's: both sides are shuffled, whatever an estimate of rows from Python says.
    """
    if hashes is None:
        repeated = dump.groupBy("block_number").count().where("count > 1").select("block_number").first()
        if repeated is not None:
            raise LookupError(f"block {repeated.block_number} is there more than once and there are no canonical hashes")
        return dump
    keys = ["block_number", "block_hash"]
    kept = dump.join(hashes.select(*keys).hint("merge"), keys, "left_semi")
    lost = dump.select("block_number").distinct().join(kept.select("block_number").hint("merge"), "block_number", "left_anti").first()
    if lost is not None:
        raise LookupError(f"no row of block {lost.block_number} has the canonical hash")
    return kept
