"""Declarations: what to read, checked as a whole when it is built, before any job runs."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from chainfold.functions.abi import ParsedEvent, SignatureError, parse_event

U256 = "u256"
_INTEGERS = {f"{s}{8 * n}" for s in ("u", "i") for n in range(1, 33)}


class ManifestError(ValueError):
    """A declaration that cannot be run."""


@dataclass(frozen=True)
class Event:
    """An event by signature. tx_fields asks for the owning transaction's columns."""

    signature: str
    alias: str = ""
    tx_fields: bool = False

    def __post_init__(self):
        if not self.signature:
            raise ManifestError("an event needs a signature")
        try:
            _ = self.parsed
        except SignatureError as error:
            raise ManifestError(str(error)) from None

    @cached_property
    def parsed(self) -> ParsedEvent:
        return parse_event(self.signature)

    @property
    def topic0(self) -> bytes:
        return self.parsed.topic0

    @property
    def name(self) -> str:
        return self.alias or self.parsed.name

    def address_param(self, name: str, where: str) -> None:
        try:
            p = self.parsed.param(name)
        except SignatureError as error:
            raise ManifestError(f"{where}: {error}") from None
        if p.type.text != "address":
            raise ManifestError(f"{where}: parameter `{name}` is `{p.type.text}`, expected `address`")


@dataclass(frozen=True)
class Contract:
    name: str
    address: bytes
    events: tuple[Event, ...]


@dataclass(frozen=True)
class Factory:
    name: str
    address: bytes
    create_event: Event
    spawn_param: str
    child_events: tuple[Event, ...]


@dataclass(frozen=True)
class Target:
    """Where a call goes: the log's emitter, a parameter, or an address that an earlier call returned."""

    kind: str = "log"  # log, param or of
    name: str = ""
    index: int = 0


@dataclass(frozen=True)
class Call:
    """args are parameter names, or literal 32-byte words."""

    method: str
    target: Target = Target()
    args: tuple[str | bytes, ...] = ()


@dataclass(frozen=True)
class Prefetch:
    on_event: Event
    calls: tuple[Call, ...]

    def producer(self, k: int) -> int:
        """The call whose result is the k-th call's target."""
        method = self.calls[k].target.name
        found = [j for j in range(k) if self.calls[j].method == method]
        if len(found) != 1:
            problem = "several earlier calls declare" if found else "no earlier call declares"
            raise ManifestError(f"prefetch on `{self.on_event.name}`: {problem} `{method}`")
        return found[0]

    def depth(self, k: int) -> int:
        return 1 + self.depth(self.producer(k)) if self.calls[k].target.kind == "of" else 1


@dataclass(frozen=True)
class StaticCall:
    address: bytes
    method: str


@dataclass(frozen=True)
class Entity:
    """Columns by name and type: u8 .. u256, i8 .. i256, bN (N bytes), blob or a list `[type]`; the first is the key.

    storage is `mutable` (keyed rows, the newest wins) or `immutable` (append only, keys increase).
    """

    name: str
    storage: str
    columns: tuple[tuple[str, str], ...]
    store: str = ""

    def __post_init__(self):
        if self.storage not in ("mutable", "immutable"):
            raise ManifestError(f"entity `{self.name}`: storage must be mutable or immutable, there is no default")
        if not isinstance(self.columns, tuple) or not all(isinstance(c, tuple) and len(c) == 2 for c in self.columns):
            raise ManifestError(f"entity `{self.name}`: columns must be (name, type) pairs")
        if not self.columns:
            raise ManifestError(f"entity `{self.name}` has no columns")
        for column, kind in self.columns:
            inner = kind[1:-1] if kind.startswith("[") and kind.endswith("]") else kind
            known = inner in _INTEGERS or inner == "blob" or (inner[:1] == "b" and inner[1:].isdecimal())
            if not known or (inner != kind and inner == "blob"):
                raise ManifestError(f"entity `{self.name}`: column `{column}` of type `{kind}` cannot be stored")
        if self.columns[0][1].startswith("[") or self.columns[0][1] == "blob":
            raise ManifestError(f"entity `{self.name}`: the key cannot vary in length")

    @property
    def key(self) -> str:
        return self.columns[0][0]

    @property
    def store_name(self) -> str:
        """Account becomes accounts, unless a name is given."""
        if self.store:
            return self.store
        spaced = "".join("_" + c.lower() if c.isupper() and k else c.lower() for k, c in enumerate(self.name))
        return spaced + "s"


@dataclass(frozen=True)
class Manifest:
    name: str
    chain_id: int
    start_block: int
    end_block: int | None = None  # inclusive
    contracts: tuple[Contract, ...] = ()
    factories: tuple[Factory, ...] = ()
    prefetch: tuple[Prefetch, ...] = ()
    static_prefetch: tuple[StaticCall, ...] = ()
    entities: tuple[Entity, ...] = field(default=())

    def __post_init__(self):
        for f in self.factories:
            f.create_event.address_param(f.spawn_param, f"factory `{f.name}`")
        topics = [frozenset(e.topic0 for e in f.child_events) for f in self.factories]
        if len(set(topics)) > 1:
            raise ManifestError("factories must declare the same child events; split other protocols into their own manifest")
        for d in self.prefetch:
            for k, call in enumerate(d.calls):
                where = f"prefetch on `{d.on_event.name}`"
                if not call.method:
                    raise ManifestError(f"{where}: a call has an empty method")
                if call.target.kind == "param":
                    d.on_event.address_param(call.target.name, where)
                elif call.target.kind == "of":
                    d.producer(k)
                elif call.target.kind != "log":
                    raise ManifestError(f"{where}: unknown target `{call.target.kind}`")
                for arg in call.args:
                    if isinstance(arg, str):
                        try:
                            p = d.on_event.parsed.param(arg)
                        except SignatureError as error:
                            raise ManifestError(f"{where}: {error}") from None
                        if not p.type.primitive:
                            raise ManifestError(f"{where}: argument `{arg}` of type `{p.type.text}` has no fixed size")
                    elif len(arg) != 32:
                        raise ManifestError(f"{where}: a literal argument has {len(arg)} bytes, not 32")
        if any(not c.method for c in self.static_prefetch):
            raise ManifestError("a static call has an empty method")
        names = [e.store_name for e in self.entities]
        for n in names:
            if names.count(n) > 1:
                raise ManifestError(f"two entities are stored as `{n}`; give one of them a store name")

    # sets for the filters

    @property
    def known_addresses(self) -> list[bytes]:
        return [*(c.address for c in self.contracts), *(f.address for f in self.factories)]

    @cached_property
    def events(self) -> list[Event]:
        """Every event once, by topic; the first declaration stands."""
        declared = [e for c in self.contracts for e in c.events] + [
            e for f in self.factories for e in (f.create_event, *f.child_events)]
        return list({e.topic0: e for e in reversed(declared)}[t] for t in dict.fromkeys(e.topic0 for e in declared))

    @property
    def primary_topics(self) -> list[bytes]:
        """Topics of what contracts and factories themselves emit."""
        own = [e for c in self.contracts for e in c.events] + [f.create_event for f in self.factories]
        return list(dict.fromkeys(e.topic0 for e in own))

    @property
    def child_topics(self) -> list[bytes]:
        return list(dict.fromkeys(e.topic0 for f in self.factories for e in f.child_events))

    @property
    def wants_tx(self) -> bool:
        return any(e.tx_fields for e in self.events)

    @property
    def prefetch_depth(self) -> int:
        return max([1, *(d.depth(k) for d in self.prefetch for k in range(len(d.calls)))])

    def legitimate(self, event: Event, address: Column) -> Column | None:
        """The emitter gate of an event, or None where every address that passes the filters may emit it.

        A static contract must have declared the event, a factory's creation must come from that
        factory, and a child event may come from any address that is not known statically.
        """
        t = event.topic0
        declarers = [c.address for c in self.contracts if any(e.topic0 == t for e in c.events)]
        creators = [f.address for f in self.factories if f.create_event.topic0 == t]
        from_child = t in self.child_topics
        if not from_child and set(self.known_addresses) <= {*declarers, *creators} and not self.factories:
            return None
        allowed = F.lit(False)
        if named := list(dict.fromkeys([*declarers, *creators])):
            allowed = address.isin(named)
        if from_child:
            allowed = allowed | ~address.isin(self.known_addresses)
        return allowed

    def fingerprint(self) -> str:
        """Changes with anything that changes which logs or calls are kept."""
        h = lambda b: b.hex()
        described = {
            "name": self.name, "chain": self.chain_id, "start": self.start_block, "end": self.end_block, "tx": self.wants_tx,
            "contracts": [[c.name, h(c.address), [h(e.topic0) for e in c.events]] for c in self.contracts],
            "factories": [[f.name, h(f.address), h(f.create_event.topic0), f.spawn_param, [h(e.topic0) for e in f.child_events]] for f in self.factories],
            "prefetch": [[h(d.on_event.topic0), [[c.method, c.target.kind, c.target.name, c.target.index,
                          [a if isinstance(a, str) else "0x" + h(a) for a in c.args]] for c in d.calls]] for d in self.prefetch],
            "static": [[h(s.address), s.method] for s in self.static_prefetch],
        }
        return hashlib.sha256(json.dumps(described, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
