"""Engine operators over the driver's tables, with the SQL that DuckDB runs for the same rows.

The events table stands in for a log stream: block = epoch / 12, log index = event_id, emitter =
user_id as an address, topic = the event type's signature hash, data = the value in cents as an ABI
word. Orders stand in for a factory's creations and line items for its children's logs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainfold.functions import abi, text, u256
from chainfold.functions.keccak import selector
from chainfold.operators import enrich, filtering, folds, prefetch
from chainfold.plans.manifest import Call, Contract, Event, Factory, Manifest, Prefetch, Target
from chainfold.sources import receipts, rpc, store
from chainfold.sources.schemas import ORDER
from chainfold.streaming import live
from chainfold.streaming.serve import Subscription

TYPES = ("view", "signup", "click", "error", "purchase")
EVENT = {t: Event(f"{t}(uint48 value)") for t in TYPES}
CREATE = Event("Opened(address indexed order, uint48 price)")
SHIPPED = Event("Shipped(uint48 quantity)")
FACTORY = b"\xfa" * 20


def addr(n: int) -> bytes:
    return n.to_bytes(20, "big")


def as_address(c: Column) -> Column:
    return F.lpad(F.unhex(F.hex(c.cast("long"))), 20, b"\0")


def as_word(c: Column) -> Column:
    return F.lpad(F.unhex(F.hex(c.cast("long"))), 32, b"\0")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def event_logs(spark: SparkSession, d: str) -> DataFrame:
    """Events as logs; epochs of wall-clock timestamps need no time zone, and no text: that took most of a scan."""
    topic = F.coalesce(*[F.when(F.col("event_type") == t, F.lit(EVENT[t].topic0)) for t in TYPES])
    seconds = F.expr("cast(unix_date(cast(ts as date)) as bigint) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts)")
    return _table(spark, d, "events").select(
        F.floor(seconds / 12).cast("long").alias("block_number"),
        F.lit(0).alias("tx_index"), F.col("event_id").cast("int").alias("log_index"), as_address(F.col("user_id")).alias("address"),
        F.array(topic).alias("topics"), topic.alias("topic0"), as_word(cents("value")).alias("data"), F.lit(None).cast("binary").alias("tx_hash"),
        "user_id", "event_type", seconds.alias("seconds"))


def order_logs(spark: SparkSession, d: str) -> DataFrame:
    """A creation for each order, then a log of the order's address for each line item."""
    created = _table(spark, d, "orders").select(
        F.col("o_orderkey").alias("block_number"), F.lit(0).alias("tx_index"), F.lit(0).alias("log_index"),
        F.when(F.col("o_orderstatus") == "F", F.lit(FACTORY)).otherwise(F.lit(addr(1))).alias("address"),
        F.array(F.lit(CREATE.topic0), F.concat(F.lit(bytes(12)), as_address(F.col("o_orderkey")))).alias("topics"),
        F.lit(CREATE.topic0).alias("topic0"), as_word(cents("o_totalprice")).alias("data"), F.col("o_orderkey").alias("order"))
    shipped = _table(spark, d, "lineitem").select(
        (F.col("l_orderkey") + 10_000_000).alias("block_number"), F.lit(0).alias("tx_index"), F.col("l_linenumber").alias("log_index"),
        as_address(F.col("l_orderkey")).alias("address"), F.array(F.lit(SHIPPED.topic0)).alias("topics"), F.lit(SHIPPED.topic0).alias("topic0"),
        as_word(cents("l_quantity")).alias("data"), F.col("l_orderkey").alias("order"))
    return created.unionByName(shipped)


ORDERS = Manifest("orders", 1, 0, factories=(Factory("opener", FACTORY, CREATE, "order", (SHIPPED,)),))
#: The factory, and three orders that are contracts of their own.
ORDERS_AND_STATIC = Manifest("orders and static", 1, 0, contracts=tuple(Contract(f"c{n}", addr(n), (EVENT["view"],)) for n in (2, 3, 5)),
                             factories=ORDERS.factories)
USERS = Manifest("users", 1, 0, contracts=(
    Contract("seven", addr(7), (EVENT["purchase"], EVENT["click"])), Contract("eight", addr(8), (EVENT["purchase"],)),
    Contract("nine", addr(9), (EVENT["view"],))))

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_E = """WITH e AS (SELECT *, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds,
    CAST(floor(epoch(date_trunc('second', ts)) / 12) AS BIGINT) AS block_number, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"""


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"{_E} SELECT event_id, block_number FROM e WHERE event_type IN ('purchase', 'click') AND user_id BETWEEN 5 AND 40 AND user_id NOT IN (7, 9)")
def keep_rule(spark, d):
    kept = filtering.keep(event_logs(spark, d), [addr(n) for n in range(5, 41)], [EVENT["purchase"].topic0, EVENT["click"].topic0], [addr(7), addr(9)])
    return kept.select(F.col("log_index").cast("long").alias("event_id"), "block_number")


@query(f"{_E} SELECT event_id, user_id FROM e WHERE event_type = 'signup'")
def keep_wildcard(spark, d):
    return filtering.keep(event_logs(spark, d), (), [EVENT["signup"].topic0]).select(F.col("log_index").cast("long").alias("event_id"), "user_id")


@query(f"{_E} SELECT event_id, user_id FROM e WHERE user_id % 3 = 0 AND user_id < 150")
def keep_large_set(spark, d):
    many = [addr(n) for n in range(0, 150, 3)] + [addr(10**6 + n) for n in range(2_000)]
    return filtering.keep(event_logs(spark, d), many).select(F.col("log_index").cast("long").alias("event_id"), "user_id")


@query(f"{_E} SELECT event_id, block_number FROM e WHERE block_number BETWEEN 142010000 AND 142050000")
def block_range(spark, d):
    return filtering.keep(event_logs(spark, d), start=142_010_000, end=142_050_000).select(F.col("log_index").cast("long").alias("event_id"), "block_number")


@query("""SELECT l_orderkey AS "order", count(*) AS n, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS BIGINT) AS quantity FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey""")
def factory_children(spark, d):
    logs = order_logs(spark, d)
    kept = filtering.filtered(logs, ORDERS).where("bucket = 'children'")
    return filtering.event_rows(kept, ORDERS, SHIPPED.topic0).groupBy("order").agg(F.count("*").alias("n"), F.sum("params.quantity").alias("quantity"))


@query("""SELECT l_orderkey AS "order", count(*) AS n FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_orderkey NOT IN (2, 3, 5) GROUP BY l_orderkey""")
def children_exclude(spark, d):
    kept = filtering.filtered(order_logs(spark, d), ORDERS_AND_STATIC)
    return kept.where("bucket = 'children'").groupBy("order").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS "order" FROM orders WHERE o_orderstatus = 'F'""")
def factory_discovery(spark, d):
    found = filtering.children_of(order_logs(spark, d), ORDERS)
    return found.select(F.conv(F.hex("address"), 16, 10).cast("long").alias("order"))


@query(f"""{_E} SELECT event_id, user_id, event_type FROM e WHERE (event_type = 'purchase' AND user_id IN (7, 8))
    OR (event_type = 'click' AND user_id = 7) OR (event_type = 'view' AND user_id = 9)""")
def emitter_gate(spark, d):
    kept = filtering.filtered(event_logs(spark, d), USERS)
    return kept.where(filtering.gate(USERS, F.col("topic0"), F.col("address"))).select(F.col("log_index").cast("long").alias("event_id"), "user_id", "event_type")


@query(f"{_E} SELECT event_id, event_type, cents FROM e WHERE (event_type = 'purchase' AND user_id IN (7, 8)) OR (event_type = 'click' AND user_id = 7) OR (event_type = 'view' AND user_id = 9)")
def dispatch_decode(spark, d):
    made = filtering.dispatch(filtering.filtered(event_logs(spark, d), USERS), USERS)
    rows = [df.select(F.col("log_index").cast("long").alias("event_id"), F.lit(name).alias("event_type"), F.col("params.value").alias("cents")) for name, df in made.items()]
    return reduce(DataFrame.unionByName, rows)


@query(f"""{_E} SELECT event_id, block_number, row_number() OVER (PARTITION BY block_number ORDER BY event_id) AS ordinal FROM e
    WHERE event_type IN ('view', 'click') OR (event_type = 'error' AND user_id < 20)""")
def merge_order(spark, d):
    logs = event_logs(spark, d)
    both = filtering.keep(logs, (), [EVENT["view"].topic0, EVENT["click"].topic0]).unionByName(
        filtering.keep(logs, [addr(n) for n in range(20)], [EVENT["error"].topic0]))
    in_block = Window.partitionBy("block_number").orderBy("tx_index", "log_index")
    return both.select(F.col("log_index").cast("long").alias("event_id"), "block_number", F.row_number().over(in_block).cast("long").alias("ordinal"))


_LEGS = f"""{_E}, legs AS (SELECT user_id AS id, -cents AS v FROM e WHERE event_type = 'purchase'
    UNION ALL SELECT (user_id * 7 + 3) % 150, cents FROM e WHERE event_type = 'purchase')"""


def _legs(spark, d) -> DataFrame:
    moved = filtering.keep(event_logs(spark, d), (), [EVENT["purchase"].topic0]).select(
        *ORDER, F.col("user_id").alias("from"), ((F.col("user_id") * 7 + 3) % 150).alias("to"), abi.data_word(F.col("data"), 0).alias("value"))
    return folds.transfer_legs(moved)


@query(f"{_LEGS} SELECT id, CAST(sum(v) AS BIGINT) AS balance FROM legs GROUP BY id")
def balance_fold(spark, d):
    return folds.balances(_legs(spark, d)).select("id", u256.narrow(F.col("balance"), 56, True).alias("balance"))


@query(f"{_LEGS} SELECT id, CAST(((sum(v) % 4294967296) + 4294967296) % 4294967296 AS BIGINT) AS balance FROM legs GROUP BY id")
def balance_mod(spark, d):
    return folds.balances(_legs(spark, d)).select("id", u256.narrow(F.col("balance"), 32, False).alias("balance"))


@query(f"{_LEGS} SELECT id, CAST(sum(v) AS VARCHAR) AS balance FROM legs GROUP BY id HAVING sum(v) >= 0")
def balance_text(spark, d):
    return folds.balances(_legs(spark, d)).where(F.col("balance") < F.lit(b"\x80" + bytes(31))).select("id", u256.to_text(F.col("balance")).alias("balance"))


@query(f"{_E} SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(cents, event_id) AS cents, max(event_id) AS event_id FROM e GROUP BY user_id")
def latest_state(spark, d):
    rows = event_logs(spark, d).select(*ORDER, "user_id", "event_type", u256.narrow(F.col("data"), 56, False).alias("cents"))
    return folds.latest(rows, "user_id").select("user_id", "event_type", "cents", F.col("log_index").cast("long").alias("event_id"))


@query(f"""{_E} SELECT user_id, coalesce(arg_max(cents, event_id) FILTER (event_type = 'view'), -1) AS viewed, coalesce(arg_max(cents, event_id) FILTER (event_type = 'purchase'), -1) AS bought
    FROM e WHERE event_type IN ('view', 'purchase') GROUP BY user_id""")
def merge_columns(spark, d):
    rows = event_logs(spark, d).select(*ORDER, "user_id", "topic0", u256.narrow(F.col("data"), 56, False).alias("cents"))
    branch = lambda t, c: rows.where(F.col("topic0") == F.lit(EVENT[t].topic0)).select(*ORDER, "user_id", F.col("cents").alias(c))
    return folds.merge_columns([branch("view", "viewed"), branch("purchase", "bought")], "user_id", ["viewed", "bought"]).fillna(-1)


@query(f"""{_E} SELECT event_id, CAST(coalesce(sum(cents) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
    FROM e WHERE event_type = 'purchase'""")
def state_as_of(spark, d):
    rows = filtering.keep(event_logs(spark, d), (), [EVENT["purchase"].topic0]).withColumn("sign", F.lit(1))
    return folds.word_state_before(rows, "user_id", "data", "sign").select(
        F.col("log_index").cast("long").alias("event_id"), u256.narrow(F.col("before"), 56, False).alias("before"))


@query(f"{_E} SELECT user_id, event_type, count(*) AS count FROM e GROUP BY user_id, event_type")
def counter(spark, d):
    return folds.counts(event_logs(spark, d), "user_id", "event_type")


@query(f"""{_E} SELECT user_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, max(event_id) AS last FROM e GROUP BY user_id""")
def keyed_reduce(spark, d):
    rows = event_logs(spark, d).select(*ORDER, "user_id", u256.narrow(F.col("data"), 56, False).alias("cents"))

    def step(state, log):
        state = state or {"user_id": log["user_id"], "n": 0, "cents": 0}
        return state | {"n": state["n"] + 1, "cents": state["cents"] + log["cents"], "last": log["log_index"]}

    return folds.keyed_reduce(rows, "user_id", step, "user_id long, n long, cents long, last long")


@query(f"{_E} SELECT printf('%016x%08x%08x', block_number, 0, event_id) AS id, event_id FROM e")
def event_id(spark, d):
    return event_logs(spark, d).select(F.lower(F.hex(abi.event_id(*[F.col(c) for c in ORDER]))).alias("id"), F.col("log_index").cast("long").alias("event_id"))


@query(f"{_E} SELECT event_id, block_number FROM e")
def event_id_inverse(spark, d):
    return event_logs(spark, d).select(abi.unpack_event_id(abi.event_id(*[F.col(c) for c in ORDER])).alias("k")).select(
        F.col("k.log_index").alias("event_id"), "k.block_number")


@query(f"{_E} SELECT printf('%016x%08x%08x', block_number, 0, event_id) AS id, user_id, cents FROM e WHERE event_type = 'click'")
def event_table(spark, d):
    rows = filtering.keep(event_logs(spark, d), (), [EVENT["click"].topic0])
    return folds.event_rows(rows, "user_id", u256.narrow(F.col("data"), 56, False).alias("cents")).withColumn("id", F.lower(F.hex("id")))


@query(f"{_E} SELECT event_id, user_id FROM e ORDER BY block_number, event_id LIMIT 50 OFFSET 100")
def range_page(spark, d):
    rows = folds.event_rows(event_logs(spark, d), F.col("log_index").cast("long").alias("event_id"), "user_id")
    return store.page(rows, "id", 100, 50).select("event_id", "user_id")


@query(f"{_E} SELECT event_id, user_id FROM e ORDER BY block_number DESC, event_id DESC LIMIT 20 OFFSET 5")
def newest_page(spark, d):
    rows = folds.event_rows(event_logs(spark, d), F.col("log_index").cast("long").alias("event_id"), "user_id")
    return store.newest_page(rows, "id", offset=5).select("event_id", "user_id")


@query("""SELECT l_orderkey AS block_number, o_custkey AS sender, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, o_custkey""")
def tx_enrich(spark, d):
    logs = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("block_number"), F.lit(0).alias("tx_index"))
    txs = _table(spark, d, "orders").select(
        F.col("o_orderkey").alias("block_number"), F.lit(0).alias("tx_index"), F.lit(2).alias("tx_type"), as_address(F.col("o_custkey")).alias("from"),
        F.lit(None).cast("binary").alias("to"), as_word(cents("o_totalprice")).alias("value"), F.lit(False).alias("from_unrecovered"))
    rows = enrich.with_transactions(logs, txs)
    return rows.groupBy("block_number", F.conv(F.hex("tx.from"), 16, 10).cast("long").alias("sender")).agg(
        F.count("*").alias("n"), F.sum(u256.narrow(F.col("tx.value"), 56, False)).alias("value"))


@query(f"{_E} SELECT DISTINCT block_number, CAST(user_id % 4 AS INTEGER) AS tx_index FROM e")
def tx_mask(spark, d):
    return enrich.tx_mask(event_logs(spark, d).withColumn("tx_index", (F.col("user_id") % 4).cast("int")))


@query(f"""{_E}, known AS (SELECT block_number, min(seconds) AS ts FROM e WHERE block_number % 2 = 0 GROUP BY block_number)
    SELECT event_id, coalesce(known.ts, 1663224162 + (e.block_number - 15537394) * 12) AS timestamp FROM e LEFT JOIN known ON known.block_number = e.block_number""")
def time_fallback(spark, d):
    logs = event_logs(spark, d)
    blocks = logs.groupBy("block_number").agg(F.min("seconds").alias("s")).select("block_number", F.when(F.col("block_number") % 2 == 0, F.col("s")).otherwise(0).alias("ts"))
    return enrich.with_time(logs, blocks).select(F.col("log_index").cast("long").alias("event_id"), "timestamp")


@query("SELECT o_orderkey, CASE WHEN o_orderkey * 20000 >= 15537394 THEN 1663224162 + (o_orderkey * 20000 - 15537394) * 12 ELSE greatest(0, 1663224162 - (15537394 - o_orderkey * 20000) * 13) END AS timestamp FROM orders")
def block_time(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", enrich.block_time(F.col("o_orderkey") * 20_000).alias("timestamp"))


_CALLS = Manifest("calls", 1, 0, contracts=(Contract("any", addr(0), (EVENT["view"],)),), prefetch=(
    Prefetch(EVENT["view"], (Call("nation()"), Call("region()", Target("of", "nation()")))),))


def _cache(spark, d) -> DataFrame:
    """nation() of every customer with a view, and region() of every nation, as call results. Customers 0 to 9 are not cached."""
    users = _table(spark, d, "customer").where("c_custkey >= 10").select(
        as_address(F.col("c_custkey")).alias("target"), F.lit(selector("nation()")).alias("calldata"),
        F.when(F.col("c_custkey") % 11 == 0, 1).otherwise(0).alias("status"), as_word(F.col("c_nationkey") + 1000).alias("value"), F.lit(1).cast("long").alias("seq"))
    nations = _table(spark, d, "nation").select(
        as_address(F.col("n_nationkey") + 1000).alias("target"), F.lit(selector("region()")).alias("calldata"), F.lit(0).alias("status"),
        as_word(F.col("n_regionkey")).alias("value"), F.lit(2).cast("long").alias("seq"))
    return users.unionByName(nations)


_NEEDED = f"""{_E}, direct AS (SELECT user_id AS target, 'nation' AS method, min(event_id) AS first FROM e WHERE event_type = 'view' GROUP BY user_id),
    chained AS (SELECT c_nationkey + 1000 AS target, 'region' AS method, min(event_id) AS first FROM e JOIN customer ON c_custkey = user_id
        WHERE event_type = 'view' AND c_custkey >= 10 AND c_custkey % 11 <> 0 GROUP BY c_nationkey), calls AS (SELECT * FROM direct UNION ALL SELECT * FROM chained)"""


def _named(calls: DataFrame) -> DataFrame:
    return calls.select(F.conv(F.hex("target"), 16, 10).cast("long").alias("target"),
                        F.when(F.col("calldata") == F.lit(selector("nation()")), "nation").otherwise("region").alias("method"),
                        F.col("first.log_index").alias("first"))


@query(f"{_NEEDED} SELECT * FROM calls")
def call_dedupe(spark, d):
    return _named(prefetch.gather(event_logs(spark, d), _cache(spark, d), _CALLS))


@query(f"{_NEEDED} SELECT * FROM calls WHERE method = 'nation' AND target NOT IN (SELECT c_custkey FROM customer WHERE c_custkey >= 10)")
def call_missing(spark, d):
    cache = _cache(spark, d)
    return _named(prefetch.missing(prefetch.gather(event_logs(spark, d), cache, _CALLS), cache))


@query(f"""{_E} SELECT event_id, CASE WHEN user_id < 10 OR c_custkey IS NULL THEN 'not_prefetched' WHEN user_id % 11 = 0 THEN 'reverted' ELSE 'ok' END AS state,
    coalesce(CASE WHEN user_id >= 10 AND user_id % 11 <> 0 THEN CAST(n_regionkey AS BIGINT) END, -1) AS region
    FROM e LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = c_nationkey WHERE event_type = 'view'""")
def call_chain(spark, d):
    cache = _cache(spark, d)
    views = filtering.keep(event_logs(spark, d), (), [EVENT["view"].topic0])
    one = enrich.with_call(views, cache, F.col("address"), F.lit(selector("nation()")), "nation")
    two = enrich.with_call(one, cache, F.substring("nation.value", 13, 20), F.lit(selector("region()")), "region")
    return two.select(F.col("log_index").cast("long").alias("event_id"), F.col("nation.state").alias("state"),
                      F.coalesce(u256.narrow(F.col("region.value"), 56, False), F.lit(-1)).alias("region"))


_SNAPSHOTS = f"""{_E}, top AS (SELECT max(block_number) AS t FROM e), blocks AS (SELECT block_number, min(event_id) AS h FROM e GROUP BY block_number),
    p AS (SELECT block_number, h FROM blocks, top WHERE block_number BETWEEN t - 4000 AND t - 1000),
    c AS (SELECT block_number, CASE WHEN block_number > t - 1500 THEN h + 1 ELSE h END AS h FROM blocks, top
          WHERE block_number BETWEEN t - 3000 AND t AND block_number % 97 <> 0)"""


@query(f"""{_SNAPSHOTS} SELECT coalesce(p.block_number, c.block_number) AS block_number, CASE
    WHEN p.h IS NOT NULL AND c.h IS NOT NULL THEN CASE WHEN p.h = c.h THEN 'same' ELSE 'changed' END
    WHEN c.h IS NOT NULL THEN CASE WHEN c.block_number > (SELECT max(block_number) FROM p) THEN 'new' ELSE 'changed' END
    WHEN p.block_number <= (SELECT t - 3001 FROM top) THEN 'finalized' ELSE 'reorged_out' END AS change FROM p FULL JOIN c ON c.block_number = p.block_number""")
def snapshot_diff(spark, d):
    blocks = event_logs(spark, d).groupBy("block_number").agg(F.min("log_index").alias("block_hash"))
    top = blocks.agg(F.max("block_number")).first()[0]
    n = F.col("block_number")
    previous = blocks.where(n.between(top - 4000, top - 1000))
    current = blocks.where(n.between(top - 3000, top) & (n % 97 != 0)).withColumn("block_hash", F.when(n > top - 1500, F.col("block_hash") + 1).otherwise(F.col("block_hash")))
    return live.classify(previous, current, top - 3001)


@query(f"{_E} SELECT event_id, block_number <= (SELECT max(block_number) FROM e) - 64 AS final FROM e")
def finality_split(spark, d):
    logs = event_logs(spark, d)
    final, rest = live.split_final(logs, logs.agg(F.max("block_number")).first()[0])
    return final.withColumn("final", F.lit(True)).unionByName(rest.withColumn("final", F.lit(False))).select(F.col("log_index").cast("long").alias("event_id"), "final")


@query(f"{_LEGS} SELECT id, CAST(sum(v) AS BIGINT) AS balance FROM legs GROUP BY id")
def tip_view(spark, d):
    legs = _legs(spark, d)
    head = legs.agg(F.max("block_number")).first()[0]
    final, pending = live.split_final(legs, head, 100_000)
    tip = folds.add_balances(folds.balances(final), folds.balances(pending))
    return tip.select("id", u256.narrow(F.col("balance"), 56, True).alias("balance"))


@query(f"""{_E}, x AS (SELECT event_id, cents, CAST(event_id % 5 AS INTEGER) AS places FROM e)
    SELECT event_id, CASE WHEN places = 0 THEN CAST(cents AS VARCHAR) ELSE rtrim(rtrim(
        CAST(cents // CAST(power(10, places) AS BIGINT) AS VARCHAR) || '.' || lpad(CAST(cents % CAST(power(10, places) AS BIGINT) AS VARCHAR), places, '0'), '0'), '.') END AS amount FROM x""")
def amount_text(spark, d):
    return event_logs(spark, d).select(F.col("log_index").cast("long").alias("event_id"), text.word_amount(F.col("data"), (F.col("log_index") % 5).cast("int")).alias("amount"))


@query(f"{_E} SELECT user_id, '0x' || lpad(printf('%x', user_id), 40, '0') AS address FROM e GROUP BY user_id")
def hex_address(spark, d):
    return event_logs(spark, d).select("user_id", text.hex_address(F.col("address")).alias("address")).distinct()


@query(f"{_E} SELECT event_id, user_id, cents, block_number FROM e WHERE event_type = 'error'")
def json_logs(spark, d):
    logs = filtering.keep(event_logs(spark, d), (), [EVENT["error"].topic0])
    prefixed = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    recorded = logs.select(F.to_json(F.struct(
        prefixed(F.col("block_number")).alias("blockNumber"), prefixed(F.col("log_index")).alias("logIndex"), prefixed(F.col("address")).alias("address"),
        F.transform("topics", prefixed).alias("topics"), prefixed(F.col("data")).alias("data"))).alias("line"))
    parsed = recorded.select(F.from_json("line", rpc.LOG_JSON).alias("j")).select("j.*")
    return rpc.to_logs(parsed).select(F.col("log_index").cast("long").alias("event_id"), F.conv(F.hex("address"), 16, 10).cast("long").alias("user_id"),
                                      u256.narrow(F.col("data"), 56, False).alias("cents"), "block_number")


@query(f"""{_E}, n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k, event_id FROM e)
    SELECT user_id, event_type, max(event_id) AS event_id FROM n GROUP BY user_id, event_type""")
def composite_key(spark, d):
    rows = event_logs(spark, d).withColumn("key", text.concat_key(F.col("address"), F.col("topic0")))
    last = folds.latest(rows.select(*ORDER, "key", "user_id", "event_type"), "key")
    return last.select("user_id", "event_type", F.col("log_index").cast("long").alias("event_id"))


@query(f"""{_LEGS} SELECT id, CAST(sum(v) AS BIGINT) AS balance FROM legs GROUP BY id""")
def incremental_state(spark, d):
    """Three deliveries folded one by one into the state before them."""
    legs, state = _legs(spark, d), None
    for k in range(3):
        state = folds.add_balances(state, folds.balances(legs.where(F.col("block_number") % 3 == k)))
    return state.select("id", u256.narrow(F.col("balance"), 56, True).alias("balance"))


@query(f"""{_E}, best AS (SELECT event_id // 3 AS block_number, min(user_id) AS h FROM e GROUP BY 1)
    SELECT event_id, b.block_number FROM e JOIN best b ON b.block_number = e.event_id // 3 AND b.h = e.user_id""")
def canonical_rows(spark, d):
    rows = _table(spark, d, "events").select(F.floor(F.col("event_id") / 3).alias("block_number"), as_address(F.col("user_id")).alias("block_hash"), "event_id")
    hashes = rows.groupBy("block_number").agg(F.min("block_hash").alias("block_hash"))
    return receipts.canonical(rows, hashes).select("event_id", "block_number")


@query("SELECT o_orderkey AS block_number, o_custkey AS sender FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def mask_select(spark, d):
    mask = enrich.tx_mask(_table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("block_number"), F.lit(0).alias("tx_index")))
    txs = _table(spark, d, "orders").select(F.col("o_orderkey").alias("block_number"), F.lit(0).alias("tx_index"), F.col("o_custkey").alias("sender"))
    return enrich.select_by_mask(txs, mask).select("block_number", "sender")


@query(f"{_E} SELECT event_id, user_id FROM e WHERE user_id IN (7, 8, 9) OR user_id % 50 = 1")
def live_gate(spark, d):
    logs = event_logs(spark, d)
    children = logs.where("user_id % 50 = 1").select("address").distinct()
    return filtering.admitted(logs, USERS, children).select(F.col("log_index").cast("long").alias("event_id"), "user_id")


@query(f"""{_E}, calls AS (SELECT user_id AS target, event_type AS method, event_id AS seq, event_id % 3 = 0 AS failed, cents FROM e)
    SELECT target, method, arg_max(failed, seq) AS failed, CASE WHEN NOT arg_max(failed, seq) THEN arg_max(cents, seq) ELSE -1 END AS value FROM calls GROUP BY target, method""")
def last_call(spark, d):
    cache = event_logs(spark, d).select(F.col("address").alias("target"), F.col("topic0").alias("calldata"), (F.col("log_index") % 3 == 0).cast("int").alias("status"),
                                        F.when(F.col("log_index") % 3 != 0, F.col("data")).alias("value"), F.col("log_index").cast("long").alias("seq"))
    names = F.element_at(F.create_map(*[x for t in TYPES for x in (F.lit(EVENT[t].topic0.hex()), F.lit(t))]), F.lower(F.hex("calldata")))
    return enrich.current_calls(cache).select(F.conv(F.hex("target"), 16, 10).cast("long").alias("target"), names.alias("method"),
                                              (F.col("status") == 1).alias("failed"), F.coalesce(u256.narrow(F.col("value"), 56, False), F.lit(-1)).alias("value"))


@query(f"""{_E}, top AS (SELECT max(block_number) - 50000 AS fork FROM e) SELECT user_id AS id, CAST(sum(CASE WHEN block_number > fork THEN 3 * cents ELSE cents END) AS BIGINT) AS balance
    FROM e, top WHERE event_type = 'purchase' GROUP BY user_id""")
def reorg_refold(spark, d):
    """Final blocks are folded once; the blocks above the fork come again with other values, and only those count."""
    paid = filtering.keep(event_logs(spark, d), (), [EVENT["purchase"].topic0]).select("block_number", F.col("user_id").alias("id"), F.col("data").alias("value"), F.lit(1).alias("sign"))
    fork = event_logs(spark, d).agg(F.max("block_number")).first()[0] - 50_000
    final, pending = paid.where(F.col("block_number") <= fork), paid.where(F.col("block_number") > fork)
    replaced = pending.withColumn("sign", F.lit(3))
    tip = folds.add_balances(folds.balances(final), folds.balances(replaced))
    return tip.select("id", u256.narrow(F.col("balance"), 56, True).alias("balance"))


@query(f"{_E} SELECT event_id, block_number FROM e WHERE event_type = 'view' AND user_id IN (1, 2) AND block_number > 142010000 AND block_number <= 142200000")
def subscription_push(spark, d):
    sub = Subscription([addr(1), addr(2)], [EVENT["view"].topic0], cursor=142_010_000)
    push = sub.backfill(event_logs(spark, d), 142_200_000)[0]
    return push.logs.select(F.col("log_index").cast("long").alias("event_id"), "block_number")


@query("SELECT o_orderkey AS block_number, o_custkey AS sender, CAST(round(o_totalprice * 100) AS BIGINT) AS value FROM orders WHERE o_orderstatus = 'P'")
def json_transactions(spark, d):
    prefixed = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    orders = _table(spark, d, "orders")
    recorded = orders.select(F.to_json(F.struct(
        prefixed(F.col("o_orderkey")).alias("blockNumber"), F.lit("0x0").alias("transactionIndex"), F.lit("0x2").alias("type"),
        prefixed(as_address(F.col("o_custkey"))).alias("from"), prefixed(cents("o_totalprice")).alias("value"))).alias("line"))
    mask = orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("block_number"), F.lit(0).alias("tx_index"))
    txs = rpc.to_txs(recorded.select(F.from_json("line", rpc.TX_JSON).alias("j")).select("j.*"), mask)
    return txs.select("block_number", F.conv(F.hex("from"), 16, 10).cast("long").alias("sender"), u256.narrow(F.col("value"), 56, False).alias("value"))


@query(f"""{_E}, b AS (SELECT DISTINCT block_number FROM e WHERE block_number BETWEEN 142005600 AND 142006599)
    SELECT count(*) AS present, count(*) = 1000 AS covered FROM b""")
def block_coverage(spark, d):
    blocks = event_logs(spark, d).select("block_number").distinct()
    covered = filtering.covers(blocks, 142_005_600, 142_006_599)
    return blocks.where(F.col("block_number").between(142_005_600, 142_006_599)).agg(F.count("*").alias("present")).withColumn("covered", F.lit(covered))
