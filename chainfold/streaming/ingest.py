"""Taking in the head: a ring of pending blocks that follows the chain, and final blocks moved to the store.

The chain is asked for spans of blocks as it stands now. The ring is compared with it first: what is no
longer on it is dropped from the fork on, and a fork below the ring is fatal. Final blocks are appended
to the store before they leave the ring, and the store ignores what it has, so a run that stops
between the two repeats itself without harm. Blocks further behind go to the store in spans.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainfold.sources.schemas import FINALITY
from chainfold.sources.store import BlockStore, PendingStore

from .live import BrokenChain, ReorgExceedsFinalityDepth, fork_point, require_chain

log = logging.getLogger("chainfold")

#: Blocks that are appended to the store at once.
SPAN = 10_000
#: How often a span is asked for again if the chain moved meanwhile.
TRIES = 3

#: (blocks, logs, transactions or None) of a span of the chain; None means that transactions are not known.
Chain = Callable[[int, int], tuple[DataFrame, DataFrame, DataFrame | None]]


class HeadIngest:
    def __init__(self, spark: SparkSession, store: BlockStore, pending: PendingStore, chain: Chain, depth: int = FINALITY, span: int = SPAN):
        self.spark, self.store, self.pending, self.chain, self.depth, self.span = spark, store, pending, chain, depth, span

    def resolve(self, head: int) -> int | None:
        """Drop pending blocks that left the chain; returns the first of them."""
        ring = self.pending.read()[0]
        low, high = ring.agg(F.min("block_number"), F.max("block_number")).first()
        if low is None:
            return None
        if low > head:
            raise ReorgExceedsFinalityDepth(f"the head is {head}, below all pending blocks from {low}")
        fork = fork_point(ring, self.chain(low, min(high, head))[0])
        if fork is not None:
            log.warning("pending blocks from %d left the chain", fork)
            self.pending.truncate(fork)
        return fork

    def _last_hash(self) -> tuple[int | None, bytes | None]:
        """Number and hash of the highest block that is there, in the ring or else in the store."""
        for blocks in (self.pending.read()[0], self.store.blocks):
            row = blocks.agg(F.max(F.struct("block_number", "block_hash")).alias("b")).first().b
            if row is not None and row.block_number is not None:
                return row.block_number, None if row.block_hash is None else bytes(row.block_hash)
        return None, None

    def finalize(self, last_final: int) -> None:
        """Append pending blocks up to a number to the store, with their transactions where they are known, then drop them."""
        blocks, logs, txs = self.pending.read()
        upto = F.col("block_number") <= last_final
        if blocks.where(upto).isEmpty():
            return
        self.store.append(logs.where(upto), blocks.where(upto), None if txs is None else txs.where(upto))
        self.pending.drop_final(last_final)
        log.info("blocks to %d are final", last_final)

    def _take(self, start: int, end: int, to_store: bool) -> None:
        blocks, logs, txs = self.chain(start, end)
        if to_store:
            first = blocks.where(F.col("block_number") == start)
            require_chain(first, self._last_hash()[1])
            self.store.append(logs, blocks, txs)
        else:
            require_chain(blocks, self._last_hash()[1])
            self.pending.insert(blocks, logs, txs)

    def advance(self, head: int, start: int | None = None) -> int:
        """Follow the chain to a head; an empty store begins at `start`. Returns the last final block."""
        last_final = head - self.depth
        for attempt in range(TRIES):
            self.resolve(head)
            self.finalize(last_final)
            try:
                top = self._last_hash()[0]
                at = (start if start is not None else max(0, last_final)) if top is None else top + 1
                while at <= last_final:
                    end = min(last_final, at + self.span - 1)
                    self._take(at, end, to_store=True)
                    at = end + 1
                if at <= head:
                    self._take(at, head, to_store=False)
                return last_final
            except BrokenChain as error:
                if attempt + 1 == TRIES:
                    raise
                log.warning("%s; asking again", error)
        raise AssertionError("not reached")

    def snapshot(self) -> tuple[DataFrame, DataFrame, int]:
        """(blocks, logs, last final block) for a follower's tick."""
        blocks, logs, _ = self.pending.read()
        return blocks, logs, self.store.meta["last_final"]
