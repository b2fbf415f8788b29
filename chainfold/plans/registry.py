"""A name registry's indexer: the latest registration of each label with its name as bytes, and a table of all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainfold.operators import folds
from chainfold.sources.schemas import ORDER

from .manifest import Contract, Entity, Event, Manifest
from .runner import Context, Delta, State

REGISTERED = Event("NameRegistered(string name, bytes32 indexed label, address indexed owner, uint256 cost, uint256 expires)")
ENTITIES = (
    Entity("Label", "mutable", (("label", "b32"), ("holder", "b20"), ("until", "u256"), ("paid", "u256"), ("text", "blob"))),
    Entity("Claim", "immutable", (("id", "b16"), ("label", "b32"), ("holder", "b20"), ("text", "blob"))),
)


def manifest(registrar: bytes, start_block: int = 0, end_block: int | None = None, chain_id: int = 1) -> Manifest:
    return Manifest("names", chain_id, start_block, end_block, contracts=(Contract("registrar", registrar, (REGISTERED,)),), entities=ENTITIES)


def handler(events: dict[str, DataFrame], context: Context) -> State:
    claims = events["NameRegistered"].select(
        *ORDER, "params.label", F.col("params.owner").alias("holder"), F.col("params.expires").alias("until"), F.col("params.cost").alias("paid"),
        F.col("params.name").cast("binary").alias("text"))
    last = folds.latest(claims, "label").select("label", "holder", "until", "paid", "text")
    return State(mutable={"labels": Delta(last, "label")}, immutable={"claims": folds.event_rows(claims, "label", "holder", "text")})
