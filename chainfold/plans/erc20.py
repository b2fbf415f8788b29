"""A token's indexer: balances, allowances, transfers and approvals, and an API over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainfold.functions import text
from chainfold.operators import folds
from chainfold.sources.schemas import ORDER

from .manifest import Contract, Entity, Event, Manifest
from .runner import Context, Delta, Reader, State

TRANSFER = Event("Transfer(address indexed from, address indexed to, uint256 value)")
APPROVAL = Event("Approval(address indexed owner, address indexed spender, uint256 value)")
ENTITIES = (
    Entity("Account", "mutable", (("id", "b20"), ("balance", "u256"))),
    Entity("Allowance", "mutable", (("id", "b40"), ("value", "u256"))),
    Entity("Transfer", "immutable", (("id", "b16"), ("from", "b20"), ("to", "b20"), ("value", "u256"))),
    Entity("Approval", "immutable", (("id", "b16"), ("owner", "b20"), ("spender", "b20"), ("value", "u256"))),
)


def manifest(address: bytes, start_block: int = 0, end_block: int | None = None, chain_id: int = 1) -> Manifest:
    return Manifest("erc20", chain_id, start_block, end_block, contracts=(Contract("token", address, (TRANSFER, APPROVAL)),), entities=ENTITIES)


def handler(events: dict[str, DataFrame], context: Context) -> State:
    moved = events["Transfer"].select(*ORDER, "params.from", "params.to", "params.value")
    granted = events["Approval"].select(*ORDER, "params.owner", "params.spender", "params.value")
    allowances = folds.latest(granted.select(*ORDER, text.concat_key(F.col("owner"), F.col("spender")).alias("id"), "value"), "id")
    return State(
        mutable={"accounts": Delta(folds.balances(folds.transfer_legs(moved)), "id", adds="balance"),
                 "allowances": Delta(allowances.select("id", "value"), "id")},
        immutable={"transfers": folds.event_rows(moved, "from", "to", "value"), "approvals": folds.event_rows(granted, "owner", "spender", "value")},
    )


class Api:
    """What a service answers: addresses as hex, amounts as decimal digits."""

    def __init__(self, reader: Reader):
        self.reader = reader

    @staticmethod
    def _address(text_: str) -> bytes:
        raw = bytes.fromhex(text_.removeprefix("0x"))
        if len(raw) != 20:
            raise ValueError(f"{text_!r} is no address")
        return raw

    @staticmethod
    def _digits(word: bytes | None) -> str:
        return str(int.from_bytes(word or b"", "big"))

    def health(self) -> dict:
        return {"status": "ok", "cursor": self.reader.cursor, "transfers": self.reader.count("transfers")}

    def account(self, address: str) -> dict:
        row = self.reader.read("accounts", self._address(address))
        return {"address": address, "balance": self._digits(row and row["balance"])}

    def allowance(self, owner: str, spender: str) -> dict:
        row = self.reader.read("allowances", self._address(owner) + self._address(spender))
        return {"owner": owner, "spender": spender, "value": self._digits(row and row["value"])}

    def transfers(self, limit: int = 20, offset: int = 0) -> list[dict]:
        return [{"id": bytes(r["id"]).hex(), "from": "0x" + bytes(r["from"]).hex(), "to": "0x" + bytes(r["to"]).hex(), "value": self._digits(r["value"])}
                for r in self.reader.newest("transfers", limit, offset)]
