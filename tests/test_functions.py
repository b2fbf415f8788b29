import random

import pytest
from pyspark.sql import functions as F

from chainfold.functions import abi, text, u256
from chainfold.functions.keccak import address, checksummed, keccak256, selector

GOLDEN = {
    "Transfer(address indexed from, address indexed to, uint value)": "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef",
    "Approval(address,address,uint256)": "8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925",
    "PairCreated(address,address,address,uint256)": "0d3648bd0f6ba80134a33ba9275ac585d9d315f0ad8355cddefde31afa28d0e9",
    "Sync(uint112,uint112)": "1c411e9a96e071241c2f21f7726b17ae89e3cab4c78be50e062b03a9fffbbad1",
    "Ping(uint256)": "48257dc961b6f792c2b78a080dacfed693b660960a702de21cee364e20270e2f",
}


def test_hashes():
    assert keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    for signature, topic in GOLDEN.items():
        assert abi.parse_event(signature).topic0.hex() == topic
    assert selector("decimals()").hex() == "313ce567" and selector("getPair(address,address)").hex() == "e6a43905"
    assert keccak256(b"x" * 500) != keccak256(b"x" * 501)


def test_checksums():
    for text_ in ("0xae78736Cd615f374D3085123A210448E74Fc6393", "0xd8dA6BF26964aF9D7eEd9e03E53415D37aA96045"):
        assert checksummed(address(text_)) == text_
        with pytest.raises(ValueError, match="checksummed"):
            address(text_.lower())
    for bad in ("0x12", "ae78736Cd615f374D3085123A210448E74Fc6393", "0x" + "g" * 40):
        with pytest.raises(ValueError):
            address(bad)


def test_canonical_forms_and_places():
    assert abi.parse_event("E(uint a, int b, byte c)").canonical == "E(uint256,int256,bytes1)"
    assert abi.parse_event("E( (address, uint) pair, (uint24,int24,address) key )").canonical == "E((address,uint256),(uint24,int24,address))"
    assert [abi.parse_event(f"E({t} a, uint b)").param("b").place for t in ("uint256[3]", "(address,uint256)", "uint256[]", "string")] == [96, 64, 32, 32]
    assert abi.parse_event("E()").params == ()


@pytest.mark.parametrize("bad, says", [
    ("", "empty"), ("E", r"missing `\("), ("E(uint256", "must end"), ("(uint256)", "name"), ("9E(uint)", "identifier"), ("E(uint a, uint a)", "duplicate"),
    ("E(uint indexed a,uint indexed b,uint indexed c,uint indexed d)", "more than 3"), ("E(uint7 a)", "unsupported"), ("E(bytes33 a)", "unsupported"),
    ("E(uint a b c)", "too many"), ("E(uint a,)", "empty param"), ("E(uint indexd a)", "indexed"), ("E(uint 9a)", "identifier"), ("E(foo)", "unsupported"),
])
def test_signature_errors(bad, says):
    with pytest.raises(abi.SignatureError, match=says):
        abi.parse_event(bad)


def test_unknown_parameter_lists_the_others():
    with pytest.raises(abi.SignatureError, match="from, to"):
        abi.parse_event("T(address from, address to)").param("nope")


def w(x) -> bytes:
    return x.to_bytes(32, "big") if isinstance(x, int) else x.rjust(32, b"\0")


def decode(spark, signature, *data, topics=()):
    event = abi.parse_event(signature)
    df = spark.createDataFrame([([event.topic0, *topics], b"".join(data))], "topics array<binary>, data binary")
    return df.select(abi.decode_event(event, F.col("topics"), F.col("data")).alias("x")).first().x


def ints(values):
    return [int.from_bytes(v, "big") for v in values]


def test_decode_vectors(spark):
    pair = decode(spark, "E((address,uint256) pair)", w(b"\xab" * 20), w(0xDEAD)).pair
    assert (bytes(pair._0), ints([pair._1])) == (b"\xab" * 20, [0xDEAD])
    assert ints(decode(spark, "E(uint256[3] arr)", w(10), w(20), w(30)).arr) == [10, 20, 30]
    assert ints(decode(spark, "E(uint256[] a)", w(32), w(3), w(100), w(200), w(300)).a) == [100, 200, 300]
    assert [bytes(v) for v in decode(spark, "E(address[] v)", w(32), w(2), w(b"\x11" * 20), w(b"\x22" * 20)).v] == [b"\x11" * 20, b"\x22" * 20]
    row = decode(spark, "E(uint256 a, uint256[] arr, uint256 b)", w(11), w(0x60), w(22), w(2), w(7), w(8))
    assert (ints([row.a, row.b]), ints(row.arr)) == ([11, 22], [7, 8])
    row = decode(spark, "NameRegistered(string name, uint256 cost)", w(0x40), w(42), w(11), b"vitalik.eth".ljust(32, b"\0"))
    assert (row.name, ints([row.cost])) == ("vitalik.eth", [42])
    assert bytes(decode(spark, "Blob(bytes p)", w(32), w(3), b"\xde\xad\xbe".ljust(32, b"\0")).p) == b"\xde\xad\xbe"
    row = decode(spark, "E(bool indexed flag, bytes4 sel, bytes32 hash)", bytes.fromhex("aabbccdd").ljust(32, b"\0"), b"\x77" * 32, topics=[w(1)])
    assert (row.flag, bytes(row.sel), bytes(row.hash)) == (True, bytes.fromhex("aabbccdd"), b"\x77" * 32)


def test_decode_of_short_and_hostile_data(spark):
    assert decode(spark, "E(uint256 a, uint24 b)", w(1)[:31]).asDict() == {"a": bytearray(32), "b": 0}
    assert bytes(decode(spark, "B(bytes p)", w(32), w(99)).p) == b"" and decode(spark, "B(string p)").p == ""
    assert decode(spark, "E(uint256[] a)", w(32), w(0)).a == [] and decode(spark, "E(uint256[] a)").a == []
    assert len(decode(spark, "E(uint256[] a)", w(32), w(2**31 - 1), w(5)).a) == 1
    assert decode(spark, "E(uint256[] a)", w(2**255), w(1)).a == []


@pytest.mark.parametrize("kind", ["(address,bytes)", "bytes[]", "string[3]"])
def test_nested_dynamic_is_refused(spark, kind):
    with pytest.raises(abi.SignatureError, match="nested dynamic"):
        decode(spark, f"E({kind} a)")


def test_indexed_hash_is_refused(spark):
    with pytest.raises(abi.SignatureError, match="hash"):
        decode(spark, "E(string indexed a)", topics=[w(1)])


def test_numbers_against_python(spark):
    rng = random.Random(3)
    xs = [0, 1, 2**256 - 1, 2**255, 2**255 - 1, *(rng.getrandbits(rng.choice([8, 60, 120, 256])) for _ in range(80))]
    rows = [(k % 3, w(x), rng.choice([1, -1])) for k, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "k int, w binary, s long")
    sums = {r.k: int.from_bytes(r.v, "big") for r in df.groupBy("k").agg(u256.signed_sum(F.col("w"), F.col("s")).alias("v")).collect()}
    assert sums == {k: sum(int.from_bytes(b, "big") * s for q, b, s in rows if q == k) % 2**256 for k in range(3)}
    kinds = [(bits, signed) for bits in (8, 24, 56, 64, 112, 120, 128, 248, 256) for signed in (False, True)]
    got = df.select("w", u256.to_text(F.col("w")).alias("t"), u256.add(F.col("w"), F.col("w")).alias("d"), u256.subtract(u256.lit(1), F.col("w")).alias("m"),
                    *[u256.narrow(F.col("w"), b, s).alias(f"{b}{s}") for b, s in kinds]).collect()
    for r in got:
        x = int.from_bytes(r.w, "big")
        assert r.t == str(x) and int.from_bytes(r.d, "big") == 2 * x % 2**256 and int.from_bytes(r.m, "big") == (1 - x) % 2**256
        for bits, signed in kinds:
            low = x % 2**bits
            low -= 2**bits if signed and low >= 2 ** (bits - 1) else 0
            v = r[f"{bits}{signed}"]
            assert (int.from_bytes(v, "big") if isinstance(v, (bytes, bytearray)) else int(v)) == (low % 2**256 if bits > 120 else low), (bits, signed, x)


def test_amounts(spark):
    cases = [(15 * 10**17, 18, "1.5"), (12345678, 6, "12.345678"), (2 * 10**18, 18, "2"), (0, 18, "0"), (1, 18, "0.000000000000000001"), (42, 0, "42"), (10**30, 18, "1000000000000")]
    df = spark.createDataFrame([(w(v), d, t) for v, d, t in cases], "w binary, d int, t string")
    assert all(r.got == r.t for r in df.select("t", text.word_amount(F.col("w"), F.col("d")).alias("got")).collect())
    got = spark.range(1).select(text.word_amount(u256.lit(123), 255).alias("x")).first().x
    assert got.startswith("0.0") and len(got) == 79


def test_ids_and_addresses(spark):
    row = spark.range(1).select(abi.event_id(F.lit(0x0102030405060708), F.lit(7), F.lit(3)).alias("k")).select("k", abi.unpack_event_id(F.col("k")).alias("u")).first()
    assert bytes(row.k).hex() == "01020304050607080000000700000003" and tuple(row.u) == (0x0102030405060708, 7, 3)
    row = spark.range(1).select(text.parse_address(F.lit("0x" + "Ab" * 20)).alias("a"), text.parse_address(F.lit("0x12")).alias("b"), text.hex_address(F.lit(b"\xab" * 20)).alias("c")).first()
    assert bytes(row.a) == b"\xab" * 20 and row.b is None and row.c == "0x" + "ab" * 20
    assert abi.encode_arg(5)[-1] == 5 and abi.encode_arg(b"\xab\xcd")[:2] == b"\xab\xcd" and abi.encode_arg(b"\x01" * 20)[12:] == b"\x01" * 20 and abi.encode_arg(True)[-1] == 1


def test_call_returns(spark):
    df = spark.createDataFrame([(1, w(b"\x0a" * 20) + w(6)), (2, w(1)[:30]), (3, None)], "k int, v binary")
    got = {r.k: r.x for r in df.select("k", abi.decode_returns(F.col("v"), "address", "uint8").alias("x")).collect()}
    assert (got[1].ok, bytes(got[1].v0), got[1].v1) == (True, b"\x0a" * 20, 6)
    assert (got[2].ok, got[2].v0) == (False, None) and got[3].ok is False
    name = spark.createDataFrame([(w(32) + w(3) + b"abc".ljust(32, b"\0"),), (w(32) + w(99),)], "v binary").select(abi.decode_returns(F.col("v"), "string").alias("x")).collect()
    assert [(r.x.ok, r.x.v0) for r in name] == [(True, "abc"), (False, None)]


def test_dynamic_values_name_their_data_once(spark):
    """An expression that repeats its places nests their copies: a list named its data some two hundred times."""
    df = spark.range(1).select(F.lit(w(64) + w(224) + w(0) + w(1)).alias("payload"))
    event = abi.parse_event("E(uint48[] list, uint48[2] fixed, string note)")
    for made, most in ((abi.decode_event(event, F.array().cast("array<binary>"), F.col("payload")), 3), (abi.decode_returns(F.col("payload"), "uint48[]", "string"), 1)):
        plan = df.select(made.alias("x"))._jdf.queryExecution().analyzed().toString().splitlines()[0]
        assert plan.count("payload#") <= most, plan.count("payload#")
    whole = w(32) + w(2) + w(5) + w(6)
    cut = spark.createDataFrame([(whole,), (whole[:96],), (w(32) + w(2**31) + w(5),), (w(2**255) + w(1),), (b"",), (None,)], "v binary").select(abi.decode_value(F.col("v"), 0, abi.parse_type("uint48[]")).alias("x"))
    assert [r.x for r in cut.collect()] == [[5, 6], [5], [5], [], [], []]


def test_many_hashes_at_once():
    from chainfold.functions.keccak import keccak256, keccak256_all

    messages = [bytes((7 * k + j) % 256 for j in range(n)) for k, n in enumerate([0, 1, 31, 135, 136, 137, 271, 272, 273, 600, 600, 5])]
    assert keccak256_all(messages) == [keccak256(m) for m in messages] and keccak256_all([]) == []
    assert keccak256_all([b""])[0].hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"


def test_event_logs_parse_no_text(spark, tmp_path):
    """A log's block is arithmetic on its time; words and addresses are padded as bytes."""
    from chainfold.plans import driver_queries as d

    spark.sql("""select event_id, 1L user_id, 'click' event_type, 1.0D value, ts from values (1L, timestamp_ntz'2024-03-10 02:30:59.9'), (2L, timestamp_ntz'1970-01-01 00:00:00'),
        (3L, timestamp_ntz'2024-12-31 23:59:59.999999') t(event_id, ts)""").write.parquet(f"{tmp_path}/events.parquet")
    logs = d.event_logs(spark, str(tmp_path))
    assert {r.log_index: r.seconds for r in logs.collect()} == {1: 1710037859, 2: 0, 3: 1735689599}
    assert "as string" not in logs._jdf.queryExecution().optimizedPlan().toString().lower() and "map(" not in logs._jdf.queryExecution().optimizedPlan().toString().lower()
    numbers = [0, 1, 15, 16, 255, 256, 2**63 - 1]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", d.as_word(F.col("n")).alias("w"), d.as_address(F.col("n")).alias("a")).collect()
    assert all((bytes(r.w), bytes(r.a)) == (r.n.to_bytes(32, "big"), r.n.to_bytes(20, "big")) for r in rows)


def test_sums_of_words_carry_without_a_fold(spark):
    """Small, large, negative and null words; limbs of zeros or ones are not converted by text."""
    draw = random.Random(5)
    words = [draw.choice([draw.getrandbits(256), draw.getrandbits(60), 2**256 - 1 - draw.getrandbits(40), 0, 2**256 - 1]) for _ in range(300)]
    rows = [(k % 7, w.to_bytes(32, "big"), draw.choice([1, -1])) for k, w in enumerate(words)] + [(9, None, 1)]
    made = spark.createDataFrame(rows, "k int, w binary, s int").groupBy("k").agg(u256.signed_sum(F.col("w"), F.col("s")).alias("total"))
    got = {r.k: r.total and int.from_bytes(r.total, "big") for r in made.collect()}
    assert got == {k: sum(int.from_bytes(w, "big") * s for q, w, s in rows if q == k) % 2**256 for k in range(7)} | {9: None}
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()
