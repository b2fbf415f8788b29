"""Serving a filter: what a remote indexer would subscribe to, as frames over shared tables.

A subscription is a filter and a cursor. A poll answers with frames in order: a reorganisation first,
then one push of the filtered logs beyond the cursor, then a heartbeat with the last final block. A
client folds pushes as pending, promotes them on heartbeats and drops what a reorganisation names; it
can come back with its cursor at any time, since frames depend on the store and the cursor alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainfold.operators.filtering import keep, sized
from chainfold.operators.enrich import select_by_mask, tx_mask

from .live import ReorgExceedsFinalityDepth, changes


@dataclass
class Frame:
    kind: str  # push, reorg or heartbeat
    block: int
    logs: DataFrame | None = None
    txs: DataFrame | None = None


@dataclass
class Subscription:
    """addresses and topics as in the keep rule; one of them must be named."""

    addresses: list[bytes] = field(default_factory=list)
    topics: list[bytes] = field(default_factory=list)
    cursor: int = -1
    with_txs: bool = False

    def __post_init__(self):
        if not self.addresses and not self.topics:
            raise ValueError("a subscription without a filter would send everything")
        self._seen: DataFrame | None = None
        self.children: DataFrame | None = None

    def _kept(self, logs: DataFrame, start: int, end: int) -> DataFrame:
        kept = keep(logs, self.addresses, self.topics, start=start, end=end)
        if self.children is None:
            return kept
        others = keep(logs, (), self.topics, self.addresses, start, end)
        return kept.unionByName(others.join(sized(self.children), "address", "left_semi"))

    def _push(self, logs: DataFrame, txs: DataFrame | None, start: int, end: int) -> Frame:
        kept = self._kept(logs, start, end)
        return Frame("push", end, kept, select_by_mask(txs, tx_mask(kept)) if self.with_txs and txs is not None else None)

    def backfill(self, logs: DataFrame, last_final: int, txs: DataFrame | None = None) -> list[Frame]:
        """Final logs beyond the cursor."""
        frames = [self._push(logs, txs, self.cursor + 1, last_final)] if last_final > self.cursor else []
        self.cursor = max(self.cursor, last_final)
        return [*frames, Frame("heartbeat", last_final)]

    def poll(self, blocks: DataFrame, logs: DataFrame, last_final: int, txs: DataFrame | None = None) -> list[Frame]:
        """Frames for a new snapshot of the blocks above finality."""
        head = blocks.agg(F.max("block_number")).first()[0]
        frames: list[Frame] = []
        if self._seen is not None:
            found = changes(self._seen, blocks, last_final)
            if found.reorg_from is not None:
                if found.reorg_from <= last_final:
                    raise ReorgExceedsFinalityDepth(f"block {found.reorg_from} changed, but {last_final} is final")
                frames.append(Frame("reorg", found.reorg_from))
                self.cursor = min(self.cursor, found.reorg_from - 1)
        if head is not None and head > self.cursor:
            frames.append(self._push(logs, txs, self.cursor + 1, head))
            self.cursor = head
        self._seen = blocks
        return [*frames, Frame("heartbeat", last_final)]

    def add_address(self, address: bytes, logs: DataFrame, since: int) -> Frame:
        """Follow another address, with its logs from the block of its creation up to the cursor."""
        if self.addresses and address not in self.addresses:
            self.addresses.append(address)
        return Frame("push", self.cursor, keep(logs, [address], self.topics, start=since, end=self.cursor))

    def add_children(self, found: DataFrame, logs: DataFrame, since: int) -> Frame:
        """Follow a table of addresses, with their logs from the block of the first creation up to the cursor."""
        self.children = found if self.children is None else self.children.unionByName(found).distinct()
        fresh = keep(logs, (), self.topics, self.addresses, since, self.cursor)
        return Frame("push", self.cursor, fresh.join(sized(found), "address", "left_semi"))
