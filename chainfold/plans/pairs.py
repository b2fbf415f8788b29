"""A factory's indexer: trading pools with their tokens, decimals, symbols and reserves, and tables of trades and liquidity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainfold.operators import folds
from chainfold.sources.schemas import ORDER

from .manifest import Call, Entity, Event, Factory, Manifest, Prefetch, Target
from .runner import Context, Delta, State

CREATED = Event("PairCreated(address indexed token0, address indexed token1, address pair, uint256 index)")
SYNC = Event("Sync(uint112 reserve0, uint112 reserve1)")
SWAP = "Swap(address indexed sender, uint256 amount0In, uint256 amount1In, uint256 amount0Out, uint256 amount1Out, address indexed to)"
MINT = Event("Mint(address indexed sender, uint256 amount0, uint256 amount1)")
BURN = Event("Burn(address indexed sender, uint256 amount0, uint256 amount1, address indexed to)")
DECIMALS = 18  # of a token that does not say
SIDES = (("first", "0"), ("second", "1"))
ENTITIES = (
    Entity("Pool", "mutable", (("id", "b20"), *((f"{side}_{what}", kind) for what, kind in (
        ("token", "b20"), ("decimals", "u8"), ("symbol", "blob"), ("reserve", "u112")) for side, _ in SIDES))),
    Entity("Trade", "immutable", (("id", "b16"), ("pool", "b20"), ("caller", "b20"), ("signer", "b20"), *((f"{side}_{way}", "u256") for way in ("in", "out") for side, _ in SIDES))),
    Entity("LiquidityChange", "immutable", (("id", "b16"), ("pool", "b20"), ("caller", "b20"), ("added", "u8"), *((f"{side}_amount", "u256") for side, _ in SIDES))),
)
COLUMNS = [c for c, _ in ENTITIES[0].columns[1:]]


def swap(with_signer: bool) -> Event:
    return Event(SWAP, tx_fields=with_signer)


def manifest(factory: bytes, start_block: int = 0, end_block: int | None = None, chain_id: int = 1, with_signer: bool = False) -> Manifest:
    """with_signer asks for the transactions of trades, whose senders are their signers.

    Tokens are asked for when a pool is made, and when it trades: so pools older than the first block
    have theirs too.
    """
    def calls(pool: Target) -> tuple[Call, ...]:
        tokens = tuple(Call(f"token{k}()", pool) for _, k in SIDES)
        return tokens + tuple(Call(method, Target("of", f"token{k}()")) for _, k in SIDES for method in ("decimals()", "symbol()"))

    traded = swap(with_signer)
    return Manifest("pairs", chain_id, start_block, end_block, factories=(Factory("factory", factory, CREATED, "pair", (SYNC, traded, MINT, BURN)),),
                    prefetch=(Prefetch(CREATED, calls(Target("param", "pair"))), Prefetch(traded, calls(Target("log")))), entities=ENTITIES)


def _named(seen: DataFrame, old: DataFrame | None, context: Context) -> DataFrame:
    """Tokens, decimals and symbols of pools, for every log that showed one.

    A token that cannot be asked keeps the earlier one, the last known to the pool in log order; its
    decimals fall back to DECIMALS, its symbol to none.
    """
    for side, k in SIDES:
        seen = context.call(seen, F.col("id"), f"token{k}()", ("address",), name="_asked")
        before = F.lit(None).cast("binary")
        if old is not None:
            seen = seen.join(old.select(F.col("id").alias("_id"), F.col(f"{side}_token").alias("_before")), F.col("id") == F.col("_id"), "left").drop("_id")
            before = F.col("_before")
        upto = Window.partitionBy("id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = seen.withColumn(f"{side}_token", F.coalesce(F.last(F.col("_asked.v0"), ignorenulls=True).over(upto), before)).drop("_asked", "_before")
        seen = context.call(seen, F.col(f"{side}_token"), "decimals()", ("uint8",), name="_decimals")
        seen = context.call(seen, F.col(f"{side}_token"), "symbol()", ("string",), name="_symbol")
        seen = seen.withColumns({f"{side}_decimals": F.coalesce("_decimals.v0", F.lit(DECIMALS).cast("long")),
                                 f"{side}_symbol": F.col("_symbol.v0").cast("binary")}).drop("_decimals", "_symbol")
    return seen


def handler(events: dict[str, DataFrame], context: Context) -> State:
    """Tokens come with a pool's creation or trades, reserves with every sync; a column that no event of a run set keeps its value."""
    swaps = events["Swap"]
    if context.manifest.wants_tx:
        swaps = context.with_tx(swaps)
    else:
        swaps = swaps.withColumn("tx", F.struct(F.lit(None).cast("binary").alias("from")))
    seen = events["PairCreated"].select(*ORDER, F.col("params.pair").alias("id")).unionByName(folds.latest(swaps.select(*ORDER, F.col("address").alias("id")), "id"))
    old = context.committed.table("pools")
    synced = events["Sync"].select(*ORDER, F.col("address").alias("id"), *[F.col(f"params.reserve{k}").alias(f"{side}_reserve") for side, k in SIDES])
    rows = folds.merge_columns([_named(seen, old, context), synced], "id", COLUMNS)
    if old is not None:
        kept = old.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in COLUMNS])
        rows = rows.join(kept, F.col("id") == F.col("_id"), "left").select("id", *[F.coalesce(c, f"_{c}").alias(c) for c in COLUMNS])
    trades = folds.event_rows(swaps, F.col("address").alias("pool"), F.col("params.sender").alias("caller"), F.col("tx.from").alias("signer"),
                              *[F.col(f"params.amount{k}{way.title()}").alias(f"{side}_{way}") for way in ("in", "out") for side, k in SIDES])
    moved = events["Mint"].withColumn("added", F.lit(1)).select(*ORDER, "address", "params.sender", "added", "params.amount0", "params.amount1").unionByName(
        events["Burn"].withColumn("added", F.lit(0)).select(*ORDER, "address", "params.sender", "added", "params.amount0", "params.amount1"))
    changes = folds.event_rows(moved, F.col("address").alias("pool"), F.col("sender").alias("caller"), "added", *[F.col(f"amount{k}").alias(f"{side}_amount") for side, k in SIDES])
    return State(mutable={"pools": Delta(rows, "id")}, immutable={"trades": trades, "liquidity_changes": changes})
