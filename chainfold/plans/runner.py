"""Running a manifest: filter, discover, prefetch, fold, commit; then follow the head.

A handler is a function of the manifest's decoded events and a context; it returns the changes of its
tables. The same handler folds history, what became final since, and pending logs for the tip view,
so it must depend on its arguments alone.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainfold.functions import abi
from chainfold.functions.keccak import selector
from chainfold.operators import enrich, filtering, folds, prefetch
from chainfold.sources import store
from chainfold.sources.schemas import CALL_CACHE, LOGS, ORDER
from chainfold.streaming import live

from .manifest import Entity, Manifest, ManifestError

log = logging.getLogger("chainfold")
#: Kept logs; a part without any has no file to tell its schema.
_INDEXED = T.StructType([*LOGS.fields, T.StructField("bucket", T.StringType())])


@dataclass
class Delta:
    """Rows of a mutable table that replace those of the same key, or whose `adds` columns are added to them modulo 2**256."""

    rows: DataFrame
    key: str
    adds: str | None = None

    def changed(self, committed: DataFrame | None) -> DataFrame:
        """The new rows of the keys that the delta names, as a commit writes them."""
        if self.adds:
            return folds.changed_sums(committed, self.rows, self.key, self.adds)
        return self.rows if committed is None else self.rows.select(committed.columns)

    def onto(self, committed: DataFrame | None) -> DataFrame:
        if self.adds:
            return folds.add_balances(committed, self.rows, self.key, self.adds)
        return folds.merge_state(committed, self.rows, self.key)


@dataclass
class State:
    mutable: dict[str, Delta] = field(default_factory=dict)
    immutable: dict[str, DataFrame] = field(default_factory=dict)


class TxFieldsUnavailable(LookupError):
    """A manifest wants transactions of blocks that have none."""


@dataclass
class Context:
    """What a handler may read beside its events."""

    manifest: Manifest
    txs: DataFrame
    blocks: DataFrame
    cache: DataFrame
    committed: store.View

    def with_tx(self, rows: DataFrame) -> DataFrame:
        return enrich.with_transactions(rows, self.txs)

    def with_time(self, rows: DataFrame) -> DataFrame:
        return enrich.with_time(rows, self.blocks)

    def call(self, rows: DataFrame, target: Column, method: str, returns: tuple[str, ...], args: tuple[Column, ...] = (), name: str = "call") -> DataFrame:
        """rows with (state, ok, v0, …) of a prefetched call."""
        data = F.concat(F.lit(selector(method)), *args)
        found = enrich.with_call(rows, self.cache, target, data, "_call")
        decoded = abi.decode_returns(F.col("_call.value"), *returns)
        state = F.when((F.col("_call.state") == "ok") & ~decoded["ok"], "malformed").otherwise(F.col("_call.state"))
        values = [decoded[f"v{k}"].alias(f"v{k}") for k in range(len(returns))]
        return found.withColumn(name, F.struct(state.alias("state"), *values)).drop("_call")


Handler = Callable[[dict[str, DataFrame], Context], State]


class Indexer:
    """A manifest, its handler and its folders: `index` for kept logs, `calls` for results, `state` for entity tables."""

    def __init__(self, spark: SparkSession, blocks: store.BlockStore, path: str, manifest: Manifest, handler: Handler,
                 fetch: prefetch.Fetch | None = None):
        for event in manifest.events:
            if event.name != event.parsed.name and any(e.name == event.name and e is not event for e in manifest.events):
                raise ManifestError(f"two events are named `{event.name}`")
        self.spark, self.blocks, self.path, self.manifest, self.handler, self.fetch = spark, blocks, path.rstrip("/"), manifest, handler, fetch
        self.state = store.StateStore(spark, f"{self.path}/state")
        self.follower: live.Follower | None = None
        self.query = None
        self.stats: dict[str, int] = {}

    # kept logs

    def _index_meta(self) -> dict:
        text = store.read_text(self.spark, f"{self.path}/index.json")
        meta = json.loads(text) if text else {}
        return meta if meta.get("fingerprint") == self.manifest.fingerprint() else {"fingerprint": self.manifest.fingerprint(), "parts": [], "scanned_to": None}

    def _children(self, meta: dict) -> DataFrame:
        """The children that the parts before discovered: a table of their addresses."""
        folders = [f"{p}-children" for p in meta["parts"]]
        return self.spark.read.schema("address binary").parquet(*folders) if folders else self.spark.createDataFrame([], "address binary")

    def build_index(self) -> int | None:
        """Filter what the store has beyond the index; another manifest starts it anew. Returns the last block scanned.

        Only folders of new blocks in which some block's filters allow a match are read, and history only for
        children that are new.
        """
        meta, m = self._index_meta(), self.manifest
        stored = self.blocks.meta
        last = stored["last_final"]
        if last is None:
            return meta["scanned_to"]
        end = last if m.end_block is None else min(last, m.end_block)
        start = m.start_block if meta["scanned_to"] is None else meta["scanned_to"] + 1
        if start > end:
            return meta["scanned_to"]
        low = max(start, stored["first"])
        if m.wants_tx and low <= end and not filtering.covers(self.blocks.tx_blocks, low, end):
            raise TxFieldsUnavailable(f"transactions of blocks {low} to {end} are not all there")
        folder = f"{self.path}/index-{m.fingerprint()[:12]}/part={len(meta['parts'])}"
        kept = filtering.primary_logs(self.blocks.read_matching(start, end, m.known_addresses, m.primary_topics), m, start, end).withColumn("bucket", F.lit("primary"))
        if m.factories and m.child_topics:
            old = self._children(meta)
            found = filtering.children_of(kept.drop("bucket"), m).join(old, "address", "left_anti")
            found.write.mode("overwrite").parquet(f"{folder}-children")
            new = self.spark.read.schema("address binary").parquet(f"{folder}-children")
            known = old.unionByName(new)
            logs = self.blocks.read_matching(start, end, [], m.child_topics)
            kept = kept.unionByName(filtering.child_logs(logs, known, m, start, end).withColumn("bucket", F.lit("children")))
            if start > m.start_block and not new.isEmpty():
                # children that this range discovered may have emitted before it
                earlier = self.blocks.read_matching(m.start_block, start - 1, [], m.child_topics)
                kept = kept.unionByName(filtering.child_logs(earlier, new, m, m.start_block, start - 1).withColumn("bucket", F.lit("children")))
        else:
            # made without Python workers
            self.spark.range(0).select(F.lit(b"").alias("address")).write.mode("overwrite").parquet(f"{folder}-children")
        store.in_log_order(kept, low, end, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        written = self.spark.read.schema(_INDEXED).parquet(folder).agg(F.count("*").alias("n"), F.count_distinct("block_number").alias("b")).first()
        self.stats |= {"scanned_blocks": end - start + 1, "matched_blocks": written.b, "kept_logs": written.n}
        meta |= {"parts": [*meta["parts"], folder], "scanned_to": end}
        store.publish(self.spark, f"{self.path}/index.json", json.dumps(meta))
        log.info("blocks %d to %d: %d logs of %d blocks kept", start, end, written.n, written.b)
        return end

    def index(self) -> DataFrame:
        parts = self._index_meta()["parts"]
        frames = [self.spark.read.schema(_INDEXED).parquet(p) for p in parts]
        if not frames:
            return self.blocks.logs.withColumn("bucket", F.lit("primary")).limit(0)
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out

    def children(self) -> DataFrame:
        return self._children(self._index_meta())

    # calls

    def cache(self) -> DataFrame:
        names = json.loads(store.read_text(self.spark, f"{self.path}/calls.json") or "[]")
        return self.spark.read.schema(CALL_CACHE).parquet(*names) if names else self.spark.createDataFrame([], CALL_CACHE)

    def run_prefetch(self, logs: DataFrame) -> DataFrame:
        m = self.manifest
        if not m.prefetch and not m.static_prefetch:
            return self.cache()
        if self.fetch is None:
            return self.cache()

        def write(results: DataFrame, _: int) -> DataFrame:
            names = json.loads(store.read_text(self.spark, f"{self.path}/calls.json") or "[]")
            folder = f"{self.path}/calls/part={len(names)}"
            results.withColumn("seq", F.lit(len(names)).cast("long")).write.mode("overwrite").parquet(folder)
            store.publish(self.spark, f"{self.path}/calls.json", json.dumps([*names, folder]))
            return self.cache()

        return prefetch.run_rounds(logs, m, self.cache(), self.fetch, write)

    # folding

    def fold(self, logs: DataFrame, txs: DataFrame | None = None) -> State:
        cache = self.cache()
        context = Context(self.manifest, self.blocks.txs if txs is None else txs, self.blocks.blocks, cache, self.state.view())
        return self.handler(filtering.dispatch(logs, self.manifest), context)

    def _commit(self, state: State, cursor: int, scanned_to: int, batch_id: int = -1) -> store.Version:
        view = self.state.view()
        mutable = {name: (delta.changed(view.table(name)), delta.key) for name, delta in state.mutable.items()}
        made = self.state.commit(mutable, {n: (df, "id") for n, df in state.immutable.items()}, cursor, scanned_to, self.manifest.fingerprint(), batch_id)
        log.info("version %d: blocks to %d, rows %s", made.number, scanned_to, made.counts)
        return made

    def commit(self, state: State, cursor: int) -> store.Version:
        """Commit what a fold of logs up to a block made."""
        return self._commit(state, cursor, cursor)

    def run(self) -> store.Version:
        """Bring the state up to the store's end: a second run with nothing new changes nothing."""
        current = self.state.current()
        if current.fingerprint not in ("", self.manifest.fingerprint()):
            current = self.reset()
        scanned = self.build_index()
        if scanned is None or scanned <= current.scanned_to:
            return current
        logs = self.index().where(F.col("block_number") > current.scanned_to)
        self.run_prefetch(logs)
        last = logs.agg(F.max("block_number")).first()[0]
        log.info("folding blocks %d to %d", current.scanned_to + 1, scanned)
        return self._commit(self.fold(logs), current.cursor if last is None else last, scanned)

    def reset(self) -> store.Version:
        """Forget the state of another manifest."""
        old = self.state.current()
        empty = store.Version(number=old.number, dropped=[*old.dropped, *([old.number, p] for paths in old.tables.values() for p in paths)])
        store.publish(self.spark, f"{self.state.path}/CURRENT.json", json.dumps(empty.__dict__))
        return empty

    # following

    def start(self, head: int | None = None) -> live.Follower:
        version = self.run()
        if head is not None:
            live.check_gap(self.blocks.meta["last_final"] or 0, head)
        at = max(version.scanned_to, self.manifest.start_block - 1)

        def commit(final: DataFrame, children: DataFrame, cursor: int, batch_id: int) -> None:
            if cursor <= self.state.current().scanned_to:
                return  # a run that stopped after its commit comes back to it
            self.run_prefetch(final)
            self._commit(self.fold(final, self.pending_txs), cursor, cursor, batch_id)

        made = [0]

        def keep_children(children: DataFrame) -> DataFrame:
            made[0] += 1
            folder = f"{self.path}/children/{self.state.current().number}-{made[0]}"
            children.write.mode("overwrite").parquet(folder)
            return self.spark.read.parquet(folder)

        def fill(start: int, end: int) -> tuple[DataFrame, DataFrame]:
            blocks = self.blocks.blocks.where(F.col("block_number").between(start, end))
            if not filtering.covers(blocks, start, end):
                raise live.StaleBaseline(f"blocks {start} to {end} are neither pending nor all in the store")
            return blocks, self.blocks.read_range(start, end)

        self.pending_txs: DataFrame | None = None
        self.follower = live.Follower(self.spark, self.manifest, keep_children(self.children()), at, commit, keep_children=keep_children, fill=fill)
        return self.follower

    def spawn(self, source: DataFrame, read: Callable, checkpoint: str, head: int | None = None, **trigger):
        """Bring the state up to date, then follow in the background; returns the streaming query."""
        follower = self.start(head)
        self.query = live.follow(source, follower, read, checkpoint, **trigger)
        return self.query

    def tip(self, name: str) -> DataFrame | None:
        """A table with the pending logs folded on top of what is committed."""
        committed = self.state.view().table(name)
        logs = self.follower.tip_logs() if self.follower else None
        if logs is None:
            return committed
        if self.manifest.prefetch:
            self.run_prefetch(logs)
        state = self.fold(logs, self.pending_txs)
        if name in state.mutable:
            return state.mutable[name].onto(committed)
        if name in state.immutable:
            rows = state.immutable[name]
            return rows if committed is None else committed.unionByName(rows)
        return committed


class Reader:
    """Reads of tip-inclusive entity tables, by the storage that each entity declares."""

    def __init__(self, indexer: Indexer):
        self.indexer = indexer
        self.entities = {e.store_name: e for e in indexer.manifest.entities}

    def _rows(self, name: str) -> DataFrame:
        rows = self.indexer.tip(name)
        if rows is None:
            raise LookupError(f"no table `{name}` yet")
        return rows

    def _immutable(self, name: str, what: str) -> Entity:
        entity = self.entities[name]
        if entity.storage != "immutable":
            raise ManifestError(f"{what} is for immutable tables; `{name}` is mutable")
        return entity

    def read(self, name: str, key) -> dict | None:
        row = self._rows(name).where(F.col(self.entities[name].key) == F.lit(key)).first()
        return row.asDict() if row else None

    def load(self, name: str, key) -> dict | None:
        if self.entities[name].storage == "immutable":
            raise ManifestError(f"`{name}` is immutable: a handler cannot load from it")
        return self.read(name, key)

    def count(self, name: str) -> int:
        self._immutable(name, "count")
        return self._rows(name).count()

    def range(self, name: str, start: int, n: int) -> list[dict]:
        entity = self._immutable(name, "range")
        return [r.asDict() for r in store.page(self._rows(name), entity.key, start, n).collect()]

    def newest(self, name: str, limit: int = 20, offset: int = 0) -> list[dict]:
        entity = self._immutable(name, "newest")
        return [r.asDict() for r in store.newest_page(self._rows(name), entity.key, limit, offset).collect()]

    @property
    def follow_error(self) -> str | None:
        """Why following stopped, if it did."""
        error = self.indexer.query.exception() if self.indexer.query is not None else None
        return str(error) if error else None

    @property
    def cursor(self) -> int:
        return self.indexer.follower.cursor if self.indexer.follower else self.indexer.state.current().cursor
