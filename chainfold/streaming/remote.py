"""Remote following over a shared folder: requests one way, frames the other.

A client writes requests (register, children) and reads frames; the server reads requests and writes
frames. Both are numbered, each with a small JSON header that is published after its tables, so
either side may stop anywhere and go on: a frame without its header is not there yet, and a client that
comes back registers anew with its cursor. The client folds pushes as pending, commits the prefix that
a heartbeat declares final, and drops what a reorganisation names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainfold.operators.filtering import children_of, primary_logs
from chainfold.plans.manifest import Manifest
from chainfold.sources import store as stores
from chainfold.sources.schemas import LOGS, TXS

from .live import ReorgExceedsFinalityDepth
from .serve import Frame, Subscription

KINDS = ("push", "reorg", "heartbeat", "goaway")


class FrameError(ValueError):
    """A header that is no frame's or request's."""


def encode(header: dict) -> str:
    return json.dumps(header, sort_keys=True)


def decode(text: str, kinds: tuple[str, ...] = KINDS) -> dict:
    try:
        header = json.loads(text)
    except ValueError as error:
        raise FrameError(str(error)) from None
    if not isinstance(header, dict) or header.get("kind") not in kinds or not isinstance(header.get("number"), int):
        raise FrameError(f"{text[:80]!r} is no header")
    return header


class Channel:
    """Numbered headers with tables in a folder, written by one side and read by the other."""

    def __init__(self, spark: SparkSession, path: str, kinds: tuple[str, ...]):
        self.spark, self.path, self.kinds, self.at = spark, path.rstrip("/"), kinds, 0

    def write(self, header: dict, **tables: DataFrame) -> int:
        number = self.at
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{number}/{name}")
        stores.publish(self.spark, f"{self.path}/{number}.json", encode(header | {"number": number, "tables": sorted(tables)}))
        self.at += 1
        return number

    def read(self) -> Iterator[dict]:
        """Headers that have come since, in order."""
        while (text := stores.read_text(self.spark, f"{self.path}/{self.at}.json")) is not None:
            header = decode(text, self.kinds)
            self.at += 1
            yield header

    def table(self, header: dict, name: str, schema) -> DataFrame | None:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{header['number']}/{name}") if name in header["tables"] else None


REQUESTS = ("register", "children")


class Server:
    """Answers the clients of a folder from a store and a ring of pending blocks."""

    def __init__(self, spark: SparkSession, store: stores.BlockStore, pending: stores.PendingStore, path: str):
        self.spark, self.store, self.pending, self.path = spark, store, pending, path.rstrip("/")
        self.clients: dict[str, tuple[Channel, Channel, Subscription | None]] = {}

    def _everything(self) -> DataFrame:
        return self.store.logs.unionByName(self.pending.read()[1])

    def _requests(self, requests: Channel, subscription: Subscription | None, answers: Channel) -> Subscription | None:
        for header in requests.read():
            if header["kind"] == "register":
                try:
                    subscription = Subscription([bytes.fromhex(a) for a in header["addresses"]], [bytes.fromhex(t) for t in header["topics"]], header["cursor"], header["txs"])
                except ValueError as error:
                    answers.write({"kind": "goaway", "block": -1, "reason": str(error)})
            elif subscription is not None:
                self._send(answers, subscription.add_children(requests.table(header, "addresses", "address binary"), self._everything(), header["since"]))
        return subscription

    @staticmethod
    def _send(answers: Channel, frame: Frame) -> None:
        tables = {name: df for name, df in (("logs", frame.logs), ("txs", frame.txs)) if df is not None}
        answers.write({"kind": frame.kind, "block": frame.block}, **tables)

    def poll(self) -> int:
        """Take in requests and send every client what is new to it. Returns the number of frames sent."""
        names = json.loads(stores.read_text(self.spark, f"{self.path}/clients.json") or "[]")
        sent = 0
        for name in names:
            requests, answers, subscription = self.clients.get(name) or (
                Channel(self.spark, f"{self.path}/{name}/requests", REQUESTS), Channel(self.spark, f"{self.path}/{name}/frames", KINDS), None)
            before = answers.at
            subscription = self._requests(requests, subscription, answers)
            self.clients[name] = requests, answers, subscription
            last_final = self.store.meta["last_final"]
            if subscription is not None and last_final is not None:
                frames = subscription.backfill(self.store.logs, last_final, self.store.txs)[:-1] if subscription.cursor < last_final else []
                blocks, logs, txs = self.pending.read()
                for frame in [*frames, *subscription.poll(blocks, logs, last_final, txs)]:
                    self._send(answers, frame)
            sent += answers.at - before
        return sent


class Gone(RuntimeError):
    """The server refused the client."""


class Client:
    """Follows a manifest through a server's folder.

    commit(final_logs, cursor, txs) is called, in order, with what became final.
    """

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest, commit: Callable[[DataFrame, int, DataFrame | None], None], cursor: int,
                 children: DataFrame | None = None, found: Callable[[DataFrame], DataFrame] | None = None):
        """found writes newly discovered children where a later client gets them as `children`, and reads them back."""
        self.found = found or self._keep
        self.spark, self.path, self.manifest, self.commit, self.cursor = spark, path.rstrip("/"), manifest, commit, cursor
        self.children = children if children is not None else spark.createDataFrame([], "address binary")
        self.connect()

    def connect(self) -> None:
        """Register, anew if need be, from the cursor on; what was pending comes again."""
        self.name = uuid.uuid4().hex
        self.requests = Channel(self.spark, f"{self.path}/{self.name}/requests", REQUESTS)
        self.frames = Channel(self.spark, f"{self.path}/{self.name}/frames", KINDS)
        self.pushed: list[DataFrame] = []
        self.txs: list[DataFrame] = []
        m = self.manifest
        topics = [*m.primary_topics, *m.child_topics]
        self.requests.write({"kind": "register", "addresses": [a.hex() for a in m.known_addresses], "topics": [t.hex() for t in topics],
                             "cursor": self.cursor, "txs": m.wants_tx})
        if not self.children.isEmpty():
            self.requests.write({"kind": "children", "since": self.cursor + 1}, addresses=self.children)
        names = json.loads(stores.read_text(self.spark, f"{self.path}/clients.json") or "[]")
        stores.publish(self.spark, f"{self.path}/clients.json", json.dumps([*names, self.name]))

    def pending(self) -> DataFrame:
        """Logs that are pushed and not final; one that came twice is there once."""
        out = self.spark.createDataFrame([], LOGS)
        for logs in self.pushed:
            out = out.unionByName(logs)
        return out.dropDuplicates(["block_number", "tx_index", "log_index"])

    def _keep(self, children: DataFrame) -> DataFrame:
        folder = f"{self.path}/{self.name}/found-{self.frames.at}"
        children.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema("address binary").parquet(folder)

    def _discover(self, logs: DataFrame) -> bool:
        """Ask for the children that a push created. Returns whether there are any."""
        if not self.manifest.factories:
            return False
        created = primary_logs(logs, self.manifest)
        found = self.found(children_of(created, self.manifest).join(self.children, "address", "left_anti"))
        if found.isEmpty():
            return False
        self.children = self.children.unionByName(found)
        since = created.agg(F.min("block_number")).first()[0]
        self.requests.write({"kind": "children", "since": since}, addresses=found)
        return True

    def step(self) -> int:
        """Apply the frames that have come. Returns how many; children are asked for before a heartbeat that would pass them by."""
        done, waiting = 0, False
        for header in self.frames.read():
            done += 1
            match header["kind"]:
                case "push":
                    logs = self.frames.table(header, "logs", LOGS)
                    self.pushed.append(logs)
                    if (txs := self.frames.table(header, "txs", TXS)) is not None:
                        self.txs.append(txs)
                    waiting = self._discover(logs) or waiting
                case "reorg":
                    if header["block"] <= self.cursor:
                        raise ReorgExceedsFinalityDepth(f"block {header['block']} changed, but {self.cursor} is committed")
                    below = F.col("block_number") < header["block"]
                    self.pushed = [x.where(below) for x in self.pushed]
                    self.txs = [x.where(below) for x in self.txs]
                case "heartbeat" if header["block"] > self.cursor and not waiting:
                    self._promote(header["block"])
                case "goaway":
                    raise Gone(header["reason"])
        return done

    def _promote(self, last_final: int) -> None:
        final = F.col("block_number").between(self.cursor + 1, last_final)
        txs = self.txs[0] if self.txs else None
        for more in self.txs[1:]:
            txs = txs.unionByName(more)
        self.commit(self.pending().where(final), last_final, txs)
        self.cursor = last_final
        above = F.col("block_number") > last_final
        self.pushed, self.txs = [x.where(above) for x in self.pushed], [x.where(above) for x in self.txs]


def remote_indexer(indexer, path: str) -> Client:
    """A client that commits to an indexer's state, from its cursor on. Historical logs and the tip come the same way."""
    def commit(final: DataFrame, cursor: int, txs: DataFrame | None) -> None:
        if cursor > indexer.state.current().scanned_to:
            indexer.run_prefetch(final)
            indexer.commit(indexer.fold(final, txs), cursor)

    spark, listed = indexer.spark, f"{indexer.path}/remote-children.json"
    folders = lambda: json.loads(stores.read_text(spark, listed) or "[]")

    def found(children: DataFrame) -> DataFrame:
        folder = f"{indexer.path}/remote-children/part={len(folders())}"
        children.write.mode("overwrite").parquet(folder)
        stores.publish(spark, listed, json.dumps([*folders(), folder]))
        return spark.read.schema("address binary").parquet(folder)

    version = indexer.state.current()
    known = spark.read.schema("address binary").parquet(*folders()) if folders() else None
    return Client(spark, path, indexer.manifest, commit, max(version.scanned_to, indexer.manifest.start_block - 1), known, found)
