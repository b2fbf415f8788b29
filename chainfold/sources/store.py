"""The store: block-ordered tables, and versions of entity tables published by one rename.

Every write makes new files; CURRENT.json names those that count. A crash before the rename leaves
files that no reader sees and the next write ignores. The pointer is replaced with os.replace on a
local path and by Hadoop's rename elsewhere, so a store needs a file system whose rename replaces
atomically (local or HDFS, not an object store).

A mutable table is a base and up to DELTAS layers of changed rows above it; the next commit folds
them into a new base. Layers of versions that are more than KEEP behind are removed.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainfold.operators import folds
from chainfold.operators.filtering import block_blooms, candidate_blocks, require_dense

from .schemas import BLOCKS, BUCKET, FINALITY, LOGS, ORDER, TXS


#: Layers of changed rows above a base, and versions that old readers may still hold.
DELTAS, KEEP = 8, 16
#: Sets of more keys than this are not tested against the blocks' filters.
TESTED = 64
#: Equal spans of blocks whose logs are counted to cut a batch into files, and the logs of one.
CELLS, FILE_LOGS = 1024, 250_000
BLOOMS = "block_number long, topic_bits array<int>, address_bits array<int>"


def together(spark: SparkSession, steps: list[Callable]) -> list:
    """The results of steps that do not need each other, run at the same time; the first one's error is raised when all have ended."""
    if len(steps) < 2:
        return [s() for s in steps]
    with ThreadPoolExecutor(len(steps)) as pool:
        return [made.result() for made in [pool.submit(inheritable_thread_target(spark)(s)) for s in steps]]


class StoreError(RuntimeError):
    """A table that is missing, foreign, or would be left with a gap."""


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return path if "://" not in path else None


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file as a whole."""
    if (local := _local(path)) is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        temporary = f"{local}.{os.getpid()}.tmp"
        with open(temporary, "w", encoding="utf-8") as file:
            file.write(text)
            file.flush()
            os.fsync(file.fileno())
        os.replace(temporary, local)
        return
    jvm = spark._jvm
    final, temporary = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration()).rename(temporary, final, options)


def read_text(spark: SparkSession, path: str) -> str | None:
    if (local := _local(path)) is not None:
        try:
            with open(local, encoding="utf-8") as file:
                return file.read()
        except FileNotFoundError:
            return None
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return "\n".join(r.value for r in spark.read.text(path).collect())


_STORED = T.StructType([*LOGS.fields, T.StructField("block_bucket", T.LongType())])


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def in_log_order(logs: DataFrame, low: int, high: int, folder: str) -> DataFrame:
    """Logs of a span of blocks by folder and in log order, cut between blocks into parts of about FILE_LOGS.

    The folder's column comes first, since a write by folders sorts again what is not sorted by it.

    repartitionByRange would compute all columns of all logs a second time to find its cuts. Here logs are counted in
    CELLS equal spans, from the block numbers alone; where some span is longer than two parts, it does.
    """
    width = max(1, -(-(high - low + 1) // CELLS))
    cell = F.least(F.greatest(F.floor((F.col("block_number") - low) / width).cast("int"), F.lit(0)), F.lit(CELLS - 1))
    found = {r.cell: r.n for r in logs.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}
    total, before, places = sum(found.values()), 0, []
    parts = max(1, -(-total // FILE_LOGS), min(logs.sparkSession.sparkContext.defaultParallelism, total * 10 // FILE_LOGS))
    if parts > 1 and max(found.values()) > 2 * total / parts:
        return logs.repartitionByRange(*ORDER).sortWithinPartitions(folder, *ORDER)
    for k in range(CELLS):
        places.append(str(before * parts // max(1, total)))
        before += found.get(k, 0)
    # folded into one literal: a look-up for each log
    place = F.get(F.split(F.lit(",".join(places)), ",").cast("array<int>"), cell)
    return logs.repartitionById(parts, F.least(place, F.lit(parts - 1))).sortWithinPartitions(folder, *ORDER)


class BlockStore:
    """logs, blocks, txs and block filters of final blocks, in folders of BUCKET blocks, sorted in log order."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def meta(self) -> dict:
        """first, last_final, parts (the batch numbers that count) and with_txs, those of them that have transactions."""
        text = read_text(self.spark, f"{self.path}/_meta.json")
        found = json.loads(text) if text else {"first": None, "last_final": None, "parts": [], "with_txs": []}
        if not {"first", "last_final", "parts", "with_txs"} <= found.keys():
            raise StoreError(f"{self.path}/_meta.json is not of this store")
        if found["parts"] and (found["first"] is None or found["last_final"] is None or found["last_final"] < found["first"]):
            raise StoreError(f"{self.path}/_meta.json names no span of blocks")
        return found

    def _read(self, name: str, schema, parts: list[int] | None = None) -> DataFrame:
        parts = [f"{self.path}/{name}/part={n}" for n in (self.meta["parts"] if parts is None else parts)]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.path}/{name}").schema(schema).parquet(*parts).select(*schema.names)

    @property
    def logs(self) -> DataFrame:
        return self._read("logs", LOGS)

    @property
    def blocks(self) -> DataFrame:
        return self._read("blocks", BLOCKS)

    @property
    def txs(self) -> DataFrame:
        return self._read("txs", TXS, self.meta["with_txs"])

    @property
    def tx_blocks(self) -> DataFrame:
        """The blocks whose transactions are there, if only to say that there are none."""
        return self._read("blocks", BLOCKS, self.meta["with_txs"])

    @property
    def blooms(self) -> DataFrame:
        """(block_number, topic_bits, address_bits) of every block, one without logs included."""
        return self._read("blooms", T.StructType.fromDDL(BLOOMS))

    def read_range(self, start: int, end: int, buckets: list[int] | None = None) -> DataFrame:
        """Logs of the blocks, both ends included; folders outside, or not among the buckets, are not read."""
        low, high = start // BUCKET, end // BUCKET
        parts = [f"{self.path}/logs/part={n}" for n in self.meta["parts"]]
        if not parts:
            return self.logs
        rows = self.spark.read.option("basePath", f"{self.path}/logs").schema(_STORED).parquet(*parts)
        if buckets is not None:
            rows = rows.where(F.col("block_bucket").isin(buckets) if buckets else F.lit(False))
        return rows.where(F.col("block_bucket").between(low, high) & F.col("block_number").between(start, end)).select(*LOGS.names)

    def read_matching(self, start: int, end: int, addresses: list[bytes], topics: list[bytes]) -> DataFrame:
        """Logs of the folders in which some block's filters allow a log of both sets."""
        few = lambda keys: keys if len(keys) <= TESTED else []
        found = candidate_blocks(self.blooms, few(addresses), few(topics), start, end)
        # a row for each folder
        buckets = [r.b for r in found.select(F.floor(F.col("block_number") / BUCKET).alias("b")).distinct().collect()]
        return self.read_range(start, end, sorted(buckets))

    def read_block(self, block: int) -> DataFrame:
        return self.read_range(block, block)

    def append(self, logs: DataFrame, blocks: DataFrame, txs: DataFrame | None = None) -> int:
        """Add final blocks. Blocks already there are ignored, a gap is refused. Returns the last final block."""
        meta = self.meta
        last = meta["last_final"]
        after = lambda df: df if last is None else df.where(F.col("block_number") > last)
        part = max(meta["parts"], default=-1) + 1
        # written once, then checked: blocks may come from a decoder, and no reader sees a part before it is published
        path = f"{self.path}/blocks/part={part}"
        after(blocks).sortWithinPartitions("block_number").write.mode("overwrite").parquet(path)
        new = self._read("blocks", BLOCKS, [part])
        span = new.agg(F.min("block_number").alias("low"), F.max("block_number").alias("high")).first()
        if span.low is None:
            return last
        if last is not None and span.low != last + 1:
            raise StoreError(f"block {span.low} does not follow {last}")
        try:
            require_dense(new, span.low, span.high)
        except LookupError as error:
            raise StoreError(str(error)) from None
        bucketed = after(logs).withColumn("topic0", F.get("topics", 0)).withColumn("block_bucket", F.floor(F.col("block_number") / BUCKET))
        (in_log_order(bucketed, span.low, span.high, "block_bucket").write.mode("overwrite").partitionBy("block_bucket")
         .option("parquet.bloom.filter.enabled#address", "true").option("parquet.bloom.filter.enabled#topic0", "true")
         .parquet(f"{self.path}/logs/part={part}"))
        every = new.select("block_number").join(block_blooms(self._part_logs(part)).hint("merge"), "block_number", "left")
        empty = F.expr("cast(array() as array<int>)")
        every.select("block_number", *[F.coalesce(c, empty).alias(c) for c in ("topic_bits", "address_bits")]).sortWithinPartitions(
            "block_number").write.mode("overwrite").parquet(f"{self.path}/blooms/part={part}")
        if txs is not None:
            after(txs).sortWithinPartitions("block_number", "tx_index").write.mode("overwrite").parquet(f"{self.path}/txs/part={part}/start={span.low}")
        first = span.low if meta["first"] is None else meta["first"]
        publish(self.spark, f"{self.path}/_meta.json", json.dumps({
            "first": first, "last_final": span.high, "parts": [*meta["parts"], part], "with_txs": [*meta["with_txs"], *([part] if txs is not None else [])]}))
        return span.high

    def _part_logs(self, part: int) -> DataFrame:
        return self.spark.read.schema(LOGS).parquet(f"{self.path}/logs/part={part}")

    def part(self, part: int) -> tuple[DataFrame, DataFrame]:
        """Blocks and logs of one batch."""
        return self._read("blocks", BLOCKS, [part]), self._read("logs", LOGS, [part])

    def add_txs(self, part: int, start: int, txs: DataFrame) -> None:
        """Transactions of a batch's blocks from one on, which count once the batch is done; asked again they replace themselves."""
        txs.sortWithinPartitions("block_number", "tx_index").write.mode("overwrite").parquet(f"{self.path}/txs/part={part}/start={start}")

    def txs_done(self, part: int) -> None:
        meta = self.meta
        publish(self.spark, f"{self.path}/_meta.json", json.dumps(meta | {"with_txs": sorted({*meta["with_txs"], part})}))

    def status(self) -> DataFrame:
        """One row for each table: rows, first and last block, distinct blocks."""
        out = None
        for name in ("logs", "blocks", "txs"):
            row = getattr(self, name).agg(F.lit(name).alias("store"), F.count("*").alias("rows"), F.min("block_number").alias("first"),
                                          F.max("block_number").alias("last"), F.count_distinct("block_number").alias("blocks"))
            out = row if out is None else out.unionByName(row)
        return out


class PendingStore:
    """The snapshot of blocks above finality, replaced as a whole: readers see one snapshot or the next."""

    def __init__(self, spark: SparkSession, path: str, depth: int = FINALITY):
        self.spark, self.path, self.depth = spark, path.rstrip("/"), depth

    def write(self, blocks: DataFrame, logs: DataFrame, txs: DataFrame | None = None) -> int:
        from chainfold.streaming.live import require_snapshot

        require_snapshot(blocks, self.depth)
        number = self.number() + 1
        folder = f"{self.path}/snapshot={number}"
        blocks.coalesce(1).write.mode("overwrite").parquet(f"{folder}/blocks")
        logs.coalesce(1).write.mode("overwrite").parquet(f"{folder}/logs")
        if txs is not None:  # without it the transactions are not built, which differs from none
            txs.coalesce(1).write.mode("overwrite").parquet(f"{folder}/txs")
        publish(self.spark, f"{self.path}/PENDING.json", json.dumps({"snapshot": number, "txs": txs is not None}))
        return number

    def _meta(self) -> dict:
        text = read_text(self.spark, f"{self.path}/PENDING.json")
        return json.loads(text) if text else {"snapshot": 0, "txs": False}

    def number(self) -> int:
        return self._meta()["snapshot"]

    def read(self) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """(blocks, logs, txs or None); nothing written yet is an empty snapshot."""
        meta = self._meta()
        if not meta["snapshot"]:
            return self.spark.createDataFrame([], BLOCKS), self.spark.createDataFrame([], LOGS), None
        folder = f"{self.path}/snapshot={meta['snapshot']}"
        txs = self.spark.read.schema(TXS).parquet(f"{folder}/txs") if meta["txs"] else None
        return self.spark.read.schema(BLOCKS).parquet(f"{folder}/blocks"), self.spark.read.schema(LOGS).parquet(f"{folder}/logs"), txs

    def insert(self, blocks: DataFrame, logs: DataFrame, txs: DataFrame | None = None) -> int:
        """Add blocks on top; those of a number that is there replace it and all above. Transactions stay only if all blocks have them."""
        old_blocks, old_logs, old_txs = self.read()
        low = blocks.agg(F.min("block_number")).first()[0]
        below = F.col("block_number") < low
        if old_txs is None and old_blocks.isEmpty():
            old_txs = self.spark.createDataFrame([], TXS)
        both = old_txs.where(below).unionByName(txs) if old_txs is not None and txs is not None else None
        return self.write(old_blocks.where(below).unionByName(blocks), old_logs.where(below).unionByName(logs), both)

    def _only(self, kept) -> int:
        blocks, logs, txs = self.read()
        return self.write(blocks.where(kept), logs.where(kept), None if txs is None else txs.where(kept))

    def truncate(self, start: int) -> int:
        """Drop blocks from a number on."""
        return self._only(F.col("block_number") < start)

    def drop_final(self, last_final: int) -> int:
        return self._only(F.col("block_number") > last_final)


@dataclass
class Version:
    number: int = 0
    cursor: int = -1
    scanned_to: int = -1
    tables: dict[str, list[str]] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    fingerprint: str = ""
    batch_id: int = -1
    #: The key of each mutable table, and folders that no later version reads, with the version that dropped them.
    keys: dict[str, str] = field(default_factory=dict)
    dropped: list[list] = field(default_factory=list)


class StateStore:
    """Entity tables. A version lists the folders of every table; readers take one version and keep it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def current(self) -> Version:
        text = read_text(self.spark, f"{self.path}/CURRENT.json")
        return Version(**json.loads(text)) if text else Version()

    def view(self, version: Version | None = None) -> "View":
        return View(self, version or self.current())

    def _write(self, df: DataFrame, name: str, number: int, key: str) -> str:
        path = f"{self.path}/{name}/v={number}"
        df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
        return path

    def commit(self, mutable: dict[str, tuple[DataFrame, str]], immutable: dict[str, tuple[DataFrame, str]], cursor: int, scanned_to: int,
               fingerprint: str = "", batch_id: int = -1) -> Version:
        """Write the changed rows of mutable tables and new rows of immutable ones, check them, then publish all at once.

        Each table comes with its key; files are sorted by it. A mutable table's rows replace those of
        the same key; an immutable table's keys must increase. counts are of immutable tables.
        """
        old = self.current()
        number = old.number + 1
        tables, counts, keys, dropped = dict(old.tables), dict(old.counts), dict(old.keys), list(old.dropped)
        before = self.view(old)

        def layer(name: str, df: DataFrame, key: str) -> tuple[list[str], list[list]]:
            layers = [*tables.get(name, []), self._write(df, name, number, key)]
            if len(layers) <= DELTAS + 1:
                return layers, []
            merged = folds.newest([self.spark.read.parquet(p) for p in layers], key)
            return [self._write(merged, f"{name}/base", number, key)], [[number, p] for p in layers]

        def rows(name: str, df: DataFrame, key: str) -> tuple[list[str], int]:
            path = self._write(df, name, number, key)
            added = self.spark.read.parquet(path)
            folds.require_increasing(before.table(name), added, key)
            return [*tables.get(name, []), path], counts.get(name, 0) + added.count()

        # one table's steps are small jobs that wait for each other, so the tables are written at the same time
        made = together(self.spark, [*[partial(layer, n, df, key) for n, (df, key) in mutable.items()], *[partial(rows, n, df, key) for n, (df, key) in immutable.items()]])
        for (name, (_, key)), (layers, gone) in zip(mutable.items(), made):
            tables[name], keys[name] = layers, key
            dropped += gone
        for name, (paths, n) in zip(immutable, made[len(mutable):]):
            tables[name], counts[name] = paths, n
        due = [p for n, p in dropped if n <= number - KEEP]
        new = Version(number, cursor, scanned_to, tables, counts, fingerprint or old.fingerprint, batch_id, keys, [x for x in dropped if x[0] > number - KEEP])
        publish(self.spark, f"{self.path}/CURRENT.json", json.dumps(new.__dict__))
        for path in due:
            remove(self.spark, path)
        return new


class View:
    """Tables of one version."""

    def __init__(self, store: StateStore, version: Version):
        self.store, self.version = store, version

    def table(self, name: str) -> DataFrame | None:
        paths = self.version.tables.get(name)
        if not paths:
            return None
        key = self.version.keys.get(name)
        if key is None:
            return self.store.spark.read.parquet(*paths)
        return folds.newest([self.store.spark.read.parquet(p) for p in paths], key)


def page(rows: DataFrame, key: str, start: int, n: int) -> DataFrame:
    """Rows start to start + n in order of key."""
    return rows.orderBy(key).offset(start).limit(n)


def newest_page(rows: DataFrame, key: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest first, at most 100 rows; past the end there are none."""
    return rows.orderBy(F.col(key).desc()).offset(offset).limit(min(limit, 100))
