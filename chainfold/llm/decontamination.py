"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test items are cut into windows of WINDOW consecutive words; items of fewer words are one window. The
searcher keeps, for windows of one length m, a shift table over hashes of blocks of two words: how far
the end of the scan may move when such a block stands there, which is m - 1 for a block that no window
has. A block that ends some window leads to the bucket of windows with that suffix hash, in order of a
hash of their first words; the words themselves are then compared.

The tables hold test items, not documents, and BLOCK_WINDOWS windows at most, whatever the number and
the length of the items: further windows are searched for in further passes over the documents. A pass
is written before the next begins, and its tables are destroyed, so neither driver nor worker ever
holds more than one block's. A pass shuffles nothing; after several, what they found is joined to
the documents by row.

A null or empty text has no words, no hits and is clean; a null or wordless item has no windows;
repeated items count once, repeated documents are judged alike; empty tables give empty or clean
results.

The query's column `contaminated` asks for windows of LEAST_ITEMS items. The pipeline's stage drops a
document with a whole window of any item; items shorter than a window are common phrases as well, and
do not condemn a document by themselves.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD_BREAK, Scratch, add_columns, ascii_lower, pack, table, unpack, word_array

WINDOW = 8
LEAST_ITEMS = 2
#: Windows of a block: its tables take some 60 bytes for each, and what its distinct words take.
BLOCK_WINDOWS = 1 << 19
SHIFT_BITS, BUCKET_BITS = 22, 18
#: Documents that several passes found are joined by shuffle beyond so many.
BROADCAST_ROWS = 20_000
#: Bytes: lower-cases A-Z, keeps digits, letters and all of a non-ASCII character, blanks the rest.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def _hash(words: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each row of word numbers."""
    h = np.zeros(words.shape[0], np.uint32)
    with np.errstate(over="ignore"):
        for k in range(words.shape[1]):
            h = (h ^ words[:, k].astype(np.uint32)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
    return h


class Searcher:
    """Wu-Manber tables for word windows of one length; symbols are numbers of words, 0 for a word of no window."""

    def __init__(self, windows: np.ndarray, owners: np.ndarray):
        """windows: (n, length) word numbers; owners: the item of each. Windows may repeat."""
        n, m = windows.shape
        self.length, self.block = m, min(2, m)
        b = self.block
        suffix = _hash(windows[:, m - b :]) >> np.uint32(32 - BUCKET_BITS)
        prefix = _hash(windows[:, :b])
        order = np.lexsort((*windows.T, prefix, suffix))
        windows, owners, suffix, prefix = windows[order], owners[order], suffix[order], prefix[order]
        fresh = np.ones(n, bool)
        fresh[1:] = (windows[1:] != windows[:-1]).any(axis=1)
        first = np.flatnonzero(fresh)
        self.words = array("i", windows[first].astype(np.int32).ravel().tobytes())
        self.prefix = array("I", prefix[first].tobytes())
        self.bucket = array("i", np.searchsorted(suffix[first], np.arange((1 << BUCKET_BITS) + 1)).astype(np.int32).tobytes())
        self.owned = array("i", np.append(first, n).astype(np.int32).tobytes())
        self.owners = array("i", owners.astype(np.int32).tobytes())
        self.shift = np.full(1 << SHIFT_BITS, m - b + 1, np.uint8)
        for end in range(b, m + 1):
            np.minimum.at(self.shift, _hash(windows[first, end - b : end]) >> np.uint32(32 - SHIFT_BITS), np.uint8(m - end))

    def occurrences(self, text: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(start, owners) of each occurrence."""
        m, b, n = self.length, self.block, len(text)
        if n < m:
            return
        ends = np.lib.stride_tricks.sliding_window_view(text, b)
        hashes = _hash(ends)
        steps = self.shift[hashes >> np.uint32(32 - SHIFT_BITS)]
        steps[text[b - 1 :] == 0] = m
        if steps[m - b :].all():
            return
        words, prefix, bucket, owned, owners = self.words, self.prefix, self.bucket, self.owned, self.owners
        steps, symbols, at = steps.tobytes(), array("i", text.astype(np.int32).tobytes()), m
        while at <= n:
            if step := steps[at - b]:
                at += step
                continue
            start, key = at - m, int(hashes[at - b]) >> (32 - BUCKET_BITS)
            low, high, wanted = bucket[key], bucket[key + 1], int(hashes[at - m])
            k = bisect_left(prefix, wanted, low, high)
            while k < high and prefix[k] == wanted:
                if words[k * m : k * m + m] == symbols[start:at]:
                    yield start, owners[owned[k] : owned[k + 1]]
                k += 1
            at += 1


class Tables:
    """The searchers for a block of windows."""

    def __init__(self, window: int = WINDOW):
        self.window, self.number, self.names, self.size = window, {}, [], 0
        self.rows: dict[int, list[tuple[np.ndarray, int]]] = {}
        self.searchers: list[Searcher] = []

    def add(self, item: str, words: list[bytes], start: int, most: int) -> int:
        """Take in an item's windows from one on, as many as there is room for below `most`; returns how many."""
        m = min(self.window, len(words))
        n = min(len(words) - m + 1 - start, most - self.size)
        ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words[start : start + n + m - 1]], np.int32)
        self.rows.setdefault(m, []).append((ids, len(self.names)))
        self.names.append(item)
        self.size += n
        return n

    def frozen(self) -> "Tables":
        for m, parts in sorted(self.rows.items()):
            windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids, m) for ids, _ in parts])
            self.searchers.append(Searcher(windows, np.concatenate([np.full(len(ids) - m + 1, owner) for ids, owner in parts])))
        self.rows = {}
        return self

    def search(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """n_words, spans of hit words, one for each occurrence, and items."""
        words = words_of(text)
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        hit: list[tuple[int, int]] = []
        found: set[str] = set()
        if ids.any():
            for searcher in self.searchers:
                for start, owners in searcher.occurrences(ids):
                    hit.append((start, start + searcher.length))
                    found.update(self.names[k] for k in owners)
        return len(words), hit, found


def joined(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Spans [s, e) in order, those that meet as one."""
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return [{"s": s, "e": e} for s, e in merged]


def blocks(items: Iterator[tuple[str, str | None]], window: int = WINDOW, most: int = BLOCK_WINDOWS) -> Iterator[Tables]:
    """Tables of at most so many windows each, one after the other; at least one."""
    tables = Tables(window)
    for item, text in items:
        words, start = words_of(text), 0
        while words and start < len(words) - min(window, len(words)) + 1:
            if tables.size >= most:
                yield tables.frozen()
                tables = Tables(window)
            start += tables.add(item, words, start, most)
    yield tables.frozen()


def _search(held):
    def make():
        search = held.value.search  # one copy of the tables for each worker

        def run(texts):
            found = [search(t) for t in texts]
            return [[x[0] for x in found], [joined(x[1]) for x in found], [sorted(x[2]) for x in found]]

        return run

    return make


def _merge():
    return lambda spans, items: [[joined([(x["s"], x["e"]) for x in s]) for s in spans], [sorted(set(i)) for i in items]]


_FOUND = "n_words long, spans array<struct<s:int,e:int>>, items array<string>"


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs packed as (text, doc_id, _row) with n_words, spans of hit words [s, e) and the item ids found."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text is not null")
    waiting = blocks(((r.item_id, r.text) for r in items.toLocalIterator()), window, block_windows)
    tables, after = next(waiting), next(waiting, None)
    rows = pack(docs, "text", "doc_id")
    broadcast = spark.sparkContext.broadcast(tables)
    if after is None:
        rows = add_columns(rows, ["text"], _search(broadcast), _FOUND)
    else:
        scratch = Scratch(spark, "benchmark")
        base = scratch.save(add_columns(rows.withColumn("_rid", F.monotonically_increasing_id()), ["text"], _search(broadcast), _FOUND), "pass0")
        hits = [base.where(F.size("items") > 0).select("_rid", "spans", "items")]
        while after is not None:
            broadcast.destroy()
            broadcast = spark.sparkContext.broadcast(after)
            found = add_columns(base.select("_rid", "text"), ["text"], _search(broadcast), _FOUND, drop=("text",)).where(F.size("items") > 0)
            hits.append(scratch.save(found.select("_rid", "spans", "items"), f"pass{len(hits)}"))
            del tables
            tables, after = after, next(waiting, None)
        broadcast.destroy()
        every = hits[0]
        for more in hits[1:]:
            every = every.unionAll(more)
        every = every.groupBy("_rid").agg(F.flatten(F.collect_list("spans")).alias("_s"), F.flatten(F.collect_list("items")).alias("_i"))
        every = scratch.save(add_columns(every, ["_s", "_i"], _merge, "spans array<struct<s:int,e:int>>, items array<string>", drop=("_s", "_i")), "hits")
        every = F.broadcast(every) if every.count() <= BROADCAST_ROWS else every.hint("shuffle_hash")
        rows = base.drop("spans", "items").join(every, "_rid", "left").select(
            "text", "doc_id", "_row", "n_words", *[F.coalesce(c, F.expr(f"cast(array() as {t})")).alias(c) for c, t in (("spans", "array<struct<s:int,e:int>>"), ("items", "array<string>"))])
    return rows.withColumn("contaminated", F.size("items") >= LEAST_ITEMS)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without WINDOW consecutive words of any item, all columns as they were."""
    long = benchmark.where(F.size(word_array(ascii_lower(F.col("text")))) >= WINDOW)
    return unpack(find_benchmark(docs, long).where(F.size("items") == 0), docs)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_benchmark(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["e"] - s["s"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


def _sql_words(text: str) -> str:
    return f"list_filter(string_split_regex(translate({text}, '{UPPER}', '{LOWER}'), '{WORD_BREAK}'), lambda x: x <> '')"


ORACLE = f"""
WITH items AS (SELECT * FROM (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_sql_words('text')} AS words FROM benchmark WHERE text IS NOT NULL)
    WHERE len(words) > 0),
placed AS (SELECT item, words, least({WINDOW}, len(words)) AS m, unnest(range(greatest(len(words) - {WINDOW - 1}, 1))) AS k FROM items),
patterns AS (SELECT DISTINCT item, m, array_to_string(words[k + 1 : k + m], ' ') AS p FROM placed),
lengths AS (SELECT DISTINCT m FROM patterns),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {_sql_words("coalesce(text, '')")} AS words FROM documents),
starts AS (SELECT rid, words, m, unnest(range(greatest(len(words) - m + 1, 0))) AS k FROM docs, lengths),
hits AS (SELECT rid, k, s.m, item FROM (SELECT rid, k, m, array_to_string(words[k + 1 : k + m], ' ') AS p FROM starts) s JOIN patterns t ON t.m = s.m AND t.p = s.p),
spots AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(k, k + m)) AS q FROM hits) GROUP BY rid),
found AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_items, 0) >= {LEAST_ITEMS} AS contaminated
FROM docs LEFT JOIN spots USING (rid) LEFT JOIN found USING (rid)"""
