"""Following the head: finality by depth, reorganisations by refolding what is not final.

Blocks above finality stay raw in a pending snapshot of FINALITY blocks at most. Committed state holds
final blocks only; the tip is committed state with the pending logs folded on top. A reorganisation
replaces pending blocks, so there is nothing to undo: the next read folds what is pending then.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainfold.operators.filtering import child_logs, children_of, primary_logs
from chainfold.plans.manifest import Manifest
from chainfold.sources.schemas import FINALITY

log = logging.getLogger("chainfold")

#: A follower whose store is further behind than this is refused: import first.
GAP_LIMIT = 1_000


class ReorgExceedsFinalityDepth(RuntimeError):
    """A block that was committed as final is no longer on the chain."""


class StaleBaseline(RuntimeError):
    """The store is too far behind the head to follow it."""


class BrokenChain(RuntimeError):
    """Blocks that do not follow each other."""


def can_finalize(block: int, head: int, depth: int = FINALITY) -> bool:
    return head >= block + depth


def split_final(rows: DataFrame, head: int, depth: int = FINALITY) -> tuple[DataFrame, DataFrame]:
    """Rows of final blocks, and of those that may still change."""
    last = head - depth
    return rows.where(F.col("block_number") <= last), rows.where(F.col("block_number") > last)


def require_snapshot(blocks: DataFrame, depth: int = FINALITY) -> None:
    """Raise unless a pending snapshot is dense and short enough."""
    row = blocks.agg(F.min("block_number").alias("low"), F.max("block_number").alias("high"), F.count("*").alias("n")).first()
    if row.n and (row.high - row.low + 1 != row.n or row.n > depth):
        raise LookupError(f"pending blocks {row.low} to {row.high}: {row.n} rows, at most {depth} and no gap are allowed")


def linked(blocks: DataFrame) -> DataFrame:
    """Blocks whose parent hash is not the hash of the block before."""
    before = F.lag("block_hash").over(Window.orderBy("block_number"))  # FINALITY rows at most
    return blocks.withColumn("_before", before).where(F.col("_before").isNotNull() & ~F.col("_before").eqNullSafe(F.col("parent_hash"))).drop("_before")


def fork_point(ring: DataFrame, chain: DataFrame) -> int | None:
    """The first block of the ring that is not on the chain, by walking to the last common block."""
    both = ring.alias("r").join(chain.alias("c"), F.expr("r.block_number = c.block_number and r.block_hash = c.block_hash"))
    common = both.agg(F.max("r.block_number")).first()[0]
    low, high = ring.agg(F.min("block_number"), F.max("block_number")).first()
    if low is None or common == high:
        return None
    if common is None:
        raise ReorgExceedsFinalityDepth(f"no block from {low} to {high} is on the chain")
    return common + 1


@dataclass
class Changes:
    """What a new snapshot says of the one before."""

    reorg_from: int | None = None
    new: list[int] = field(default_factory=list)
    finalized: list[int] = field(default_factory=list)
    reorged_out: list[int] = field(default_factory=list)


def classify(previous: DataFrame, current: DataFrame, last_final: int) -> DataFrame:
    """(block_number, change) of two snapshots of (block_number, block_hash): changed, new, finalized, reorged_out or same.

    A block that went is final if it is not beyond last_final, else reorganised out.
    """
    top = previous.agg(F.coalesce(F.max("block_number"), F.lit(-1)).alias("_top"))
    p = previous.select("block_number", F.col("block_hash").alias("_p"), F.lit(True).alias("_in_p"))
    c = current.select("block_number", F.col("block_hash").alias("_c"), F.lit(True).alias("_in_c"))
    return p.join(c, "block_number", "full_outer").crossJoin(F.broadcast(top)).select("block_number", (
        F.when(F.col("_in_p") & F.col("_in_c"), F.when(F.col("_p").eqNullSafe(F.col("_c")), "same").otherwise("changed"))
        .when(F.col("_in_c"), F.when(F.col("block_number") > F.col("_top"), "new").otherwise("changed"))
        .when(F.col("block_number") <= last_final, "finalized").otherwise("reorged_out")).alias("change"))


def changes(previous: DataFrame, current: DataFrame, last_final: int) -> Changes:
    """The classification on the driver: snapshots have FINALITY rows at most."""
    out = Changes()
    for r in classify(previous, current, last_final).orderBy("block_number").collect():
        if r.change in ("changed", "reorged_out") and out.reorg_from is None:
            out.reorg_from = r.block_number
        if r.change in ("new", "finalized", "reorged_out"):
            getattr(out, r.change).append(r.block_number)
    return out


def seed(current: DataFrame, cursor: int) -> DataFrame:
    """What counts as seen when following starts: no block beyond the cursor."""
    return current.where(F.col("block_number") <= cursor)


@dataclass
class Pending:
    """An immutable snapshot of raw blocks and logs above finality."""

    blocks: DataFrame
    logs: DataFrame


#: (blocks, logs) of a span of final blocks that a follower has not seen.
Fill = Callable[[int, int], tuple[DataFrame, DataFrame]]


def require_chain(blocks: DataFrame, parent: bytes | None = None) -> None:
    """Raise unless blocks (FINALITY at most) are dense and linked, the first to `parent`; unknown hashes link to anything."""
    rows = blocks.select("block_number", "block_hash", "parent_hash").orderBy("block_number").collect()
    if rows and parent is not None and rows[0].parent_hash is not None and bytes(rows[0].parent_hash) != parent:
        raise BrokenChain(f"block {rows[0].block_number} does not follow the block before it")
    for one, other in zip(rows, rows[1:], strict=False):
        if other.block_number != one.block_number + 1:
            raise BrokenChain(f"block {other.block_number} stands after {one.block_number}")
    if (broken := linked(blocks).first()) is not None:
        raise BrokenChain(f"block {broken.block_number} does not follow the block before it")


class Follower:
    """The live loop: promote what became final, then take in new blocks or a reorganisation.

    The follower calls commit(final_logs, children, cursor, batch_id) for logs that became final, in
    order and without a gap: blocks that neither snapshot holds come from fill(start, end), which has
    final ones. Without fill, following starts at the first snapshot's first block.
    """

    def __init__(self, spark: SparkSession, manifest: Manifest, children: DataFrame, cursor: int,
                 commit: Callable[[DataFrame, DataFrame, int, int], None], depth: int = FINALITY,
                 keep_children: Callable[[DataFrame], DataFrame] | None = None, fill: Fill | None = None):
        """keep_children writes the set of children and reads it back, so that its plan does not grow with every tick."""
        self.spark, self.manifest, self.children, self.cursor = spark, manifest, children, cursor
        self.commit, self.depth, self.batch_id, self.fill = commit, depth, -1, fill
        self.keep_children = keep_children or (lambda df: df)
        self.pending: Pending | None = None
        self.final_hash: bytes | None = None

    def _promote(self, blocks: DataFrame, logs: DataFrame, upto: int, batch_id: int | None) -> None:
        """Commit the logs of final blocks from the cursor to a block."""
        window = F.col("block_number").between(self.cursor + 1, upto)
        final = self.relevant(logs.where(window))
        if self.manifest.factories:
            fresh = children_of(final, self.manifest).join(self.children, "address", "left_anti")
            if not fresh.isEmpty():
                self.children = self.keep_children(self.children.unionByName(fresh))
        self.commit(final, self.children, upto, batch_id if batch_id is not None else self.batch_id + 1)
        last = blocks.where(F.col("block_number") == upto).select("block_hash").first()
        self.cursor, self.final_hash = upto, bytes(last.block_hash) if last is not None and last.block_hash is not None else None

    def _fill(self, low: int, last_final: int, batch_id: int | None) -> None:
        """Commit what lies between the cursor and the first pending block."""
        if low - 1 > last_final:
            raise BrokenChain(f"blocks {self.cursor + 1} to {low - 1} are not pending and not final")
        if self.fill is None:
            raise BrokenChain(f"blocks {self.cursor + 1} to {low - 1} are in neither snapshot, and there is nothing to fill the gap from")
        log.info("filling blocks %d to %d", self.cursor + 1, low - 1)
        self._promote(*self.fill(self.cursor + 1, low - 1), low - 1, batch_id)

    def relevant(self, logs: DataFrame) -> DataFrame:
        """Logs of a batch that the manifest wants; creations in the batch count, so a child's first logs are caught."""
        primary = primary_logs(logs, self.manifest)
        if not self.manifest.factories:
            return primary
        known = self.children.unionByName(children_of(primary, self.manifest)).distinct()
        return primary.unionByName(child_logs(logs, known, self.manifest))

    def tick(self, blocks: DataFrame, logs: DataFrame, last_final: int, batch_id: int | None = None) -> Changes:
        """Take in a snapshot of all blocks above the store's end. A batch that comes twice is ignored."""
        if batch_id is not None and batch_id == self.batch_id:
            return Changes()
        require_chain(blocks)
        found = changes(self.pending.blocks if self.pending else seed(blocks, self.cursor), blocks, last_final)
        lost = [b for b in (found.reorg_from, *found.reorged_out) if b is not None and b <= self.cursor]
        if lost:
            raise ReorgExceedsFinalityDepth(f"block {min(lost)} changed, but blocks to {self.cursor} are committed")
        if self.pending is not None:
            old_top = self.pending.blocks.agg(F.max("block_number")).first()[0]
            upto = min(last_final, old_top if old_top is not None else -1)
            if upto > self.cursor:
                # what became final is taken from the snapshot before, unless the reorganisation reached it
                if found.reorg_from is not None and found.reorg_from <= upto:
                    raise ReorgExceedsFinalityDepth(f"block {found.reorg_from} changed while {upto} is final")
                self._promote(self.pending.blocks, self.pending.logs, upto, batch_id)
        above = blocks.where(F.col("block_number") > self.cursor)
        first = above.orderBy("block_number").select("block_number", "parent_hash").first()
        if first is not None and first.block_number > self.cursor + 1 and (self.pending is not None or self.fill is not None):
            self._fill(first.block_number, last_final, batch_id)
        if first is not None and first.block_number == self.cursor + 1 and None not in (self.final_hash, first.parent_hash) and bytes(first.parent_hash) != self.final_hash:
            raise ReorgExceedsFinalityDepth(f"block {first.block_number} does not follow block {self.cursor}, which is committed")
        if found.reorg_from is not None:
            log.warning("a reorganisation from block %d", found.reorg_from)
        keep = F.col("block_number") > self.cursor
        self.pending = Pending(blocks.where(keep), logs.where(keep))
        self.batch_id = batch_id if batch_id is not None else self.batch_id + 1
        return found

    def tip_logs(self) -> DataFrame | None:
        """Pending logs that the tip view folds over committed state."""
        return self.relevant(self.pending.logs.where(F.col("block_number") > self.cursor)) if self.pending else None


def check_gap(last_final: int, head: int, limit: int = GAP_LIMIT) -> None:
    if head - FINALITY - last_final > limit:
        raise StaleBaseline(f"the store ends at {last_final}, the head is {head}: import up to {head - FINALITY} first")


def follow(source: DataFrame, follower: Follower, read: Callable[[DataFrame], tuple[DataFrame, DataFrame, int]], checkpoint: str, **trigger):
    """Run ticks from a streaming DataFrame of head announcements. read(batch) gives (blocks, logs, last_final) of the snapshot."""
    def step(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            follower.tick(*read(batch), batch_id=batch_id)

    return (source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 second"})).start())
