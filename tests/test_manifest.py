import pytest

from chainfold.plans.manifest import Call, Contract, Entity, Event, Factory, Manifest, ManifestError, Prefetch, StaticCall, Target

A, B, X = b"\xaa" * 20, b"\xbb" * 20, b"\xcc" * 20
TRANSFER = Event("Transfer(address indexed from, address indexed to, uint256 value)")
APPROVAL = Event("Approval(address indexed owner, address indexed spender, uint256 value)")
CREATE = Event("Create(address child, uint256 n)")
SWAP, SYNC = Event("Swap(uint256 n)"), Event("Sync(uint112 a, uint112 b)")


def manifest(**kw):
    return Manifest("m", 1, 0, **kw)


@pytest.mark.parametrize("make, says", [
    (lambda: Event(""), "signature"),
    (lambda: Event("Bad(uint7 x)"), "unsupported"),
    (lambda: Entity("E", "", (("id", "u64"),)), "storage"),
    (lambda: Entity("E", "mutable", ()), "no columns"),
    (lambda: Entity("E", "mutable", "abc"), "pairs"),
    (lambda: Entity("E", "mutable", (("id", "bool"),)), "cannot be stored"),
    (lambda: Entity("E", "mutable", (("id", "blob"),)), "key"),
    (lambda: manifest(entities=(Entity("Account", "mutable", (("id", "u64"),)), Entity("Other", "mutable", (("id", "u64"),), "accounts"))), "stored as"),
    (lambda: manifest(factories=(Factory("f", A, CREATE, "nope", ()),)), "child, n"),
    (lambda: manifest(factories=(Factory("f", A, CREATE, "n", ()),)), "expected `address`"),
    (lambda: manifest(factories=(Factory("f", A, CREATE, "child", (SWAP,)), Factory("g", B, CREATE, "child", (SYNC,)))), "same child events"),
    (lambda: manifest(prefetch=(Prefetch(CREATE, (Call(""),)),)), "empty method"),
    (lambda: manifest(static_prefetch=(StaticCall(A, ""),)), "empty method"),
    (lambda: manifest(prefetch=(Prefetch(CREATE, (Call("x()", Target("param", "nope")),)),)), "no parameter"),
    (lambda: manifest(prefetch=(Prefetch(CREATE, (Call("x()", Target("param", "n")),)),)), "expected `address`"),
    (lambda: manifest(prefetch=(Prefetch(CREATE, (Call("x()", Target("of", "y()")),)),)), "no earlier"),
    (lambda: manifest(prefetch=(Prefetch(CREATE, (Call("y()"), Call("y()"), Call("x()", Target("of", "y()")))),)), "several"),
    (lambda: manifest(prefetch=(Prefetch(CREATE, (Call("x(uint256)", args=(b"short",)),)),)), "not 32"),
])
def test_declaration_errors(make, says):
    with pytest.raises(ManifestError, match=says):
        make()


def test_sets():
    m = manifest(contracts=(Contract("a", A, (TRANSFER, APPROVAL)), Contract("b", B, (Event("Transfer(address,address,uint256)", alias="Again"),))),
                 factories=(Factory("f", X, CREATE, "child", (SWAP,)),))
    assert m.known_addresses == [A, B, X]
    assert [e.name for e in m.events] == ["Transfer", "Approval", "Create", "Swap"]
    assert m.primary_topics == [TRANSFER.topic0, APPROVAL.topic0, CREATE.topic0] and m.child_topics == [SWAP.topic0]
    assert not m.wants_tx and manifest(contracts=(Contract("a", A, (Event(TRANSFER.signature, tx_fields=True),)),)).wants_tx
    assert Entity("SwapEvent", "immutable", (("id", "b16"),)).store_name == "swap_events"


def test_depth_and_fingerprint():
    d = Prefetch(CREATE, (Call("a()", Target("param", "child")), Call("b()", Target("of", "a()")), Call("c()", Target("of", "b()"))))
    m = manifest(prefetch=(d,))
    assert m.prefetch_depth == 3 and manifest().prefetch_depth == 1
    prints = {manifest().fingerprint(), m.fingerprint(), manifest(contracts=(Contract("a", A, (TRANSFER,)),)).fingerprint(),
              manifest(end_block=5).fingerprint(), manifest(prefetch=(Prefetch(CREATE, (Call("x(uint256)", args=(bytes(32),)),)),)).fingerprint(),
              manifest(prefetch=(Prefetch(CREATE, (Call("x(uint256)", args=(b"\1" * 32,)),)),)).fingerprint()}
    assert len(prints) == 6 and manifest().fingerprint() == manifest().fingerprint()
