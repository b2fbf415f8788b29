"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set is its distinct five-word shingles. Equal sets are one class (by a 128-bit hash), so
thousands of exact copies are one entry. A class has TREES keys: its signature, read from another
place for each tree, DEPTH_MOST values long. All keys are sorted, by range, so a tree lies in
order over many tasks and no prefix, however common, has to fit one of them. One sweep over each
sorted range takes the common prefix of every two neighbours. Entries that share DEPTH_LEAST values
are a region. Its depth adapts: a region of more than CROWD entries is followed to longer prefixes
until its parts hold no more, and within a part all are candidates of each other; besides, neighbours
in the order are always candidates, since nobody shares a longer prefix with an entry than they do.
Regions that a range ends in are swept again with what touches the same seam.

An entry of a large region may have a link that no order puts near it, as in a star of copies of one
text. So each entry of a large region is also a candidate of the region's centre, the entry with the
most company over all trees. Candidates are confirmed on the full sets. Each class's best candidate
goes first; pairs that links have joined by then need no look, the others are all confirmed. Links
give components, by contraction. Entries of large regions that are still apart from their centre's
component are the exact rest: in blocks of BLOCK_BYTES of sets they are counted against the sets of
all entries of large regions, so every link between two entries that share a region is either
confirmed or within a component. Few entries are apart unless many texts share half their shingles
and link to none; such a corpus costs a pass for each block.

Documents without words are linked with nothing; null texts have none; null ids are documents whose
component is that of their copies, and they never name one. Repeated rows share their fate. An empty
table gives an empty result. Other columns are not read. The query links at PERCENT, the pipeline's
stage at STAGE_PERCENT.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, add_columns, pack, table, unpack
from .components import components

SHINGLE = 5
PERCENT = 85
#: What the pipeline's stage links at; PERCENT is the query's.
STAGE_PERCENT = 80
TREES = 24
DEPTH_LEAST, DEPTH_MOST = 4, 16
HASHES = TREES * DEPTH_LEAST
CROWD = 8
#: Rows of a sorted range that are swept at once; a longer region is swept in pieces that overlap.
HELD_ROWS = 1 << 17
BLOCK_BYTES = 16 << 20
WORDS_HELD = 150_000
#: Involved ids are sent to all tasks up to this many, else joined by shuffle.
BROADCAST_ROWS = 20_000
_rng = np.random.default_rng(20240601)
_FACTOR = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SCALE = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_SHIFT = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, held: dict[bytes, int]) -> np.ndarray:
    """The sorted hashes of a text's shingles; of all its words together where there are fewer than five."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if len(held) > WORDS_HELD:
        held.clear()
    for w in set(words).difference(held):
        held[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(held.__getitem__, words), np.uint64, n)
    k = min(n, SHINGLE)
    with np.errstate(over="ignore"):
        total = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            total += h[i : n - k + 1 + i] * _FACTOR[i]
    return np.unique(_mixed(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(low), 512):
            values = np.multiply.outer(_SCALE, low[k : k + 512])
            values += _SHIFT[:, None]
            np.minimum(best, values.min(axis=1), out=best)
    return best


def _sign():
    held: dict[bytes, int] = {}

    def run(texts):
        n, f1, f2, sig = [], [], [], []
        for text in texts:
            s = shingle_set(text, held)
            n.append(len(s))
            if len(s):
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                f1.append((digest >> 64) - (1 << 63))
                f2.append((digest & ((1 << 64) - 1)) - (1 << 63))
                sig.append(signature(s).tobytes())
            else:
                f1.append(None), f2.append(None), sig.append(None)
        return [n, f1, f2, sig]

    return run


#: A key is the tree's number and its values, 16 bits each.
_UNITS = 1 + DEPTH_MOST
_PLACES = (np.arange(TREES)[:, None] * DEPTH_LEAST + np.arange(DEPTH_MOST)[None, :]) % HASHES
_KEYS = "key binary, cid long, n long"
_PAIR, _MEMBER, _SEAM = 0, 1, 2
_SWEPT = "kind int, a long, b long, n long, region long, key binary"


def _binary(units: np.ndarray) -> pa.Array:
    """A row of 16-bit values as a binary value each."""
    rows, width = units.shape[0], 2 * units.shape[1]
    ends = np.arange(rows + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(units).tobytes())])


def _units(keys: pa.Array) -> np.ndarray:
    width = 2 * _UNITS
    start = np.frombuffer(keys.buffers()[1], np.int32, count=keys.offset + 1)[keys.offset]
    return np.frombuffer(keys.buffers()[2], np.uint16, count=len(keys) * _UNITS, offset=int(start)).reshape(-1, _UNITS) if len(keys) else np.empty((0, _UNITS), np.uint16)


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each class, one for each tree."""
    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            some = batch.slice(k, 4096)
            low = np.frombuffer(b"".join(some.column("sig").to_pylist()), np.uint32).astype(np.uint16).reshape(-1, HASHES)
            units = np.empty((len(low), TREES, _UNITS), np.uint16)
            units[:, :, 0], units[:, :, 1:] = np.arange(TREES), low[:, _PLACES]
            yield pa.RecordBatch.from_arrays(
                [_binary(units.reshape(-1, _UNITS)), *(pa.array(np.repeat(some.column(c).to_numpy(zero_copy_only=False), TREES), pa.int64()) for c in ("cid", "n"))],
                ["key", "cid", "n"])


def _shared(units: np.ndarray) -> np.ndarray:
    """For each key how many units it shares with the one before."""
    same = units[1:] == units[:-1]
    return np.concatenate([[0], np.where(same.all(axis=1), _UNITS, same.argmin(axis=1))]) if len(units) else np.empty(0, np.int64)


def _region_of(units: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(units[: 1 + DEPTH_LEAST].tobytes()) - (1 << 63)


def _runs(shared: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of entries that share `depth` units, and the run of each entry."""
    cuts = shared < depth
    cuts[:1] = True
    starts = np.flatnonzero(cuts)
    return starts, np.diff(np.append(starts, len(shared))), np.cumsum(cuts) - 1


def near_in_order(shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of candidates in a stretch of sorted keys, from the units that neighbours share."""
    least = 1 + DEPTH_LEAST
    _, sizes, run = _runs(shared, least)
    next_to = np.flatnonzero((shared >= least) & (sizes[run] > CROWD))
    left, right = [next_to - 1], [next_to]
    at, rest = np.arange(len(shared)), shared
    for depth in range(least, _UNITS + 1):
        _, sizes, run = _runs(rest, depth)
        size = sizes[run]
        for k in range(1, CROWD):
            if k >= len(at):
                break
            both = np.flatnonzero((run[:-k] == run[k:]) & (size[:-k] <= CROWD))
            left.append(at[both])
            right.append(at[both + k])
        deeper = size > CROWD
        at, rest = at[deeper], rest[deeper]
        if not len(at):
            break
    return np.concatenate(left), np.concatenate(right)


def _sweep(percent: int, seams: bool) -> Callable:
    """Candidates, entries of large or cut regions and what touches the ends, of sorted ranges of keys."""
    least = 1 + DEPTH_LEAST
    names = _SWEPT.replace(" int", "").replace(" long", "").replace(" binary", "").split(", ")
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def made(kind: int, **columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), *(columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t)
                                                     for c, t in zip(names[1:], kinds[1:], strict=True))], names)

    def piece(units, cid, n, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        shared = _shared(units)
        i, j = near_in_order(shared)
        fit = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (cid[i] != cid[j])
        i, j = cid[i[fit]], cid[j[fit]]
        pairs = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], 1), axis=0, return_counts=True) if len(i) else None
        if pairs is not None:
            yield made(_PAIR, a=pairs[0][:, 0], b=pairs[0][:, 1], n=pairs[1])
        if not seams or not len(cid):
            return
        starts, sizes, run = _runs(shared, least)
        wanted = sizes > CROWD
        wanted[0] |= first
        wanted[-1] |= last
        region = np.zeros(len(starts), np.int64)
        for r in np.flatnonzero(wanted):
            region[r] = _region_of(units[starts[r]])
        held = np.flatnonzero(wanted[run])
        yield made(_MEMBER, a=cid[held], n=n[held], region=region[run[held]])
        ends = np.zeros(len(cid), bool)
        if first:
            ends[: min(CROWD, sizes[0])] = True
        if last:
            ends[len(cid) - min(CROWD, sizes[-1]) :] = True
        if len(ends := np.flatnonzero(ends)):
            yield made(_SEAM, a=cid[ends], n=n[ends], region=region[run[ends]], key=_binary(units[ends]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = (_units(batch.column("key")), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "n")))
            held = fresh if held is None else tuple(np.concatenate(x) for x in zip(held, fresh, strict=True))
            if len(held[1]) < HELD_ROWS // 4:
                continue
            # whole regions go; one longer than HELD_ROWS goes in pieces that share CROWD entries
            cuts = np.flatnonzero(_shared(held[0]) < least)
            done = cut = int(cuts[-1])
            if not cut and len(held[1]) >= HELD_ROWS:
                done, cut = len(held[1]), len(held[1]) - CROWD
            if cut:
                yield from piece(*(x[:done] for x in held), first, False)
                held, first = tuple(x[cut:] for x in held), False
        if held is not None:
            yield from piece(*held, first, True)

    return run


def _sets():
    held: dict[bytes, int] = {}
    return lambda texts: [[shingle_set(t, held).tobytes() for t in texts]]


def _linked(percent: int):
    def one(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
        return 100 * both >= percent * (len(x) + len(y) - both)

    return lambda: lambda a, b: [[one(*p) for p in zip(a, b, strict=True)]]


class Forest:
    """The sorted trees: pairs (a, b) that are near in some order, and the entries of large regions."""

    def __init__(self, classes: DataFrame, scratch: Scratch, percent: int):
        """classes: (cid, n, sig)."""
        self.scratch, self.percent = scratch, percent
        keys = classes.select("cid", "n", "sig").mapInArrow(_orders, _KEYS)
        swept = scratch.save(keys.repartitionByRange("key", "cid").sortWithinPartitions("key", "cid").mapInArrow(_sweep(percent, True), _SWEPT), "swept")
        # as many rows as ranges, times CROWD
        seams = swept.where(F.col("kind") == _SEAM).select("region", "key", F.col("a").alias("cid"), "n")
        seams = seams.repartition("region").sortWithinPartitions("key", "cid").select("key", "cid", "n")
        self.pairs = swept.where(F.col("kind") == _PAIR).unionAll(seams.mapInArrow(_sweep(percent, False), _SWEPT)).select("a", "b", F.col("n").alias("met"))
        members = swept.where(F.col("kind") == _MEMBER).select("region", F.col("a").alias("cid"), "n")
        sizes = scratch.save(members.groupBy("region").agg(F.count("*").alias("size")).where(f"size > {CROWD}"), "regions")
        self.large = scratch.save(members.join(sizes, "region").distinct(), "large")
        self.score = scratch.save(self.large.groupBy("cid").agg(F.sum("size").alias("score")), "score")

    def centred(self) -> DataFrame:
        """A pair of each entry of a large region with the one of best score there."""
        rows = self.large.join(self.score, "cid")
        centre = self.scratch.save(rows.groupBy("region").agg(F.max(F.struct("score", "cid", "n")).alias("c")).select(
            "region", F.col("c.cid").alias("b"), F.col("c.n").alias("nb")), "centres")
        return _sized(rows.join(centre, "region").select(F.col("cid").alias("a"), "b", F.col("n").alias("na"), "nb"), self.percent)

    def candidates(self) -> DataFrame:
        """Distinct pairs (a, b), a < b, and how often they met."""
        pairs = self.pairs.unionAll(self.centred().withColumn("met", F.lit(1).cast("long")))
        return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("met").alias("met"))

    def apart(self, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(cid, root) of all entries of large regions, and of those outside their region's best-connected entry's component."""
        rows = self.large.select("region", "cid").join(self.score, "cid").join(roots, F.col("cid") == F.col("node"), "left").select(
            "region", "cid", "score", F.coalesce("root", "cid").alias("root"))
        rows = self.scratch.save(rows, "placed")
        centre = self.scratch.save(rows.groupBy("region").agg(F.max(F.struct("score", "cid", "root")).alias("c")).select(
            "region", F.col("c.root").alias("_main")), "mains")
        every = self.scratch.save(rows.groupBy("cid").agg(F.first("root").alias("root")), "entries")
        outside = rows.join(centre, "region").where("root <> _main").groupBy("cid").agg(F.first("root").alias("root"))
        return every, self.scratch.save(outside, "apart")


def _sized(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.where(f"a <> b and 100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b")


def confirm(pairs: DataFrame, texts: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are near enough. texts: (cid, text), one per class."""
    pairs = scratch.save(pairs.select("a", "b"), "asked")
    ids = scratch.save(pairs.select(F.col("a").alias("_c")).unionAll(pairs.select("b")).distinct(), "ids")
    few = ids.count() <= BROADCAST_ROWS
    wanted = texts.join(F.broadcast(ids) if few else ids, F.col("cid") == F.col("_c"), "left_semi")
    sets = scratch.save(add_columns(wanted.select("cid", "text"), ["text"], _sets, "s binary", drop=("text",)), "sets")
    a, b = (sets.select(F.col("cid").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b")
    links = scratch.save(add_columns(both, ["sa", "sb"], _linked(percent), "linked boolean", drop=("sa", "sb")).where("linked").select("a", "b"), "links")
    scratch.drop("sets")
    return links


def _against(block, percent: int):
    """Links of a row's set with the sets of a block, one for each component that it is not in."""
    def make():
        held = block.value  # the index built from it stays with the worker
        if "values" not in held:
            raw = [np.frombuffer(x, np.uint64) for x in held.pop("sets")]
            held["sizes"] = np.array([len(x) for x in raw])
            every = np.concatenate(raw)
            order = np.argsort(every, kind="stable").astype(np.int32)
            held["values"], held["owner"] = every[order], np.repeat(np.arange(len(raw), dtype=np.int32), held["sizes"])[order]
        values, owner, sizes = held["values"], held["owner"], held["sizes"]
        cids, roots, seen = np.array(held["cids"]), np.array(held["roots"]), set()

        def run(cid, root, sets):
            out = []
            for c, r, s in zip(cid, root, sets, strict=True):
                x, links = np.frombuffer(s, np.uint64), []
                low, high = np.searchsorted(values, x), np.searchsorted(values, x, side="right")
                width = high - low
                at = np.repeat(low - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
                both = np.bincount(owner[at], minlength=len(sizes))
                for k in np.flatnonzero((100 * both >= percent * (len(x) + sizes - both)) & (roots != r)):
                    if (pair := (int(cids[k]), r)) not in seen:
                        seen.add(pair)
                        links.append(pair[0])
                out.append(links)
            return [out]

        return run

    return make


def exact_rest(entries: DataFrame, apart: DataFrame, texts: DataFrame, scratch: Scratch, percent: int) -> DataFrame | None:
    """Links (a, b) between entries that are apart and all entries, over components; None if none is apart."""
    if apart.isEmpty():
        return None
    spark = entries.sparkSession
    few = entries.count() <= BROADCAST_ROWS
    wanted = texts.join(F.broadcast(entries.withColumnRenamed("cid", "_c")) if few else entries.withColumnRenamed("cid", "_c"), F.col("cid") == F.col("_c"))
    sets = scratch.save(add_columns(wanted.select("cid", "root", "text"), ["text"], _sets, "s binary", drop=("text",)), "entry_sets")
    asked = scratch.save(sets.join(apart.select("cid"), "cid", "left_semi"), "apart_sets")
    size = asked.agg(F.sum(F.octet_length("s"))).first()[0] or 0
    blocks, links = max(1, -(-size // BLOCK_BYTES)), None
    for k in range(blocks):
        rows = list(asked.where(F.pmod(F.xxhash64("cid"), F.lit(blocks)) == k).toLocalIterator())
        if not rows:
            continue
        block = spark.sparkContext.broadcast({"cids": [r.cid for r in rows], "roots": [r.root for r in rows], "sets": [bytes(r.s) for r in rows]})
        found = add_columns(sets, ["cid", "root", "s"], _against(block, percent), "others array<long>", drop=("root", "s"))
        found = scratch.save(found.select(F.col("cid").alias("a"), F.explode("others").alias("b")), "rest")
        links = found if links is None else links.unionAll(found)
    return links


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id. Sets of a similarity of percent hundredths are linked."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    signed = scratch.save(add_columns(docs.select("doc_id", "text"), ["text"], _sign, "n long, f1 long, f2 long, sig binary", drop=("text",)), "signed")
    worded = signed.where("n > 0")
    classes = scratch.save(worded.groupBy("f1", "f2").agg(
        F.coalesce(F.min("doc_id"), F.first("f1")).alias("cid"), F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    forest = Forest(classes.select("cid", "n", "sig"), scratch, percent)
    # one text of each class: that of its smallest id
    texts = docs.select(F.col("doc_id").alias("cid"), "text").where("cid is not null")
    found = scratch.save(forest.candidates(), "candidates")
    score = forest.score
    sided = found.select(F.col("a").alias("x"), F.col("b").alias("y"), "met").unionAll(found.select("b", "a", "met"))
    best = sided.join(score, F.col("y") == F.col("cid"), "left").groupBy("x").agg(F.max(F.struct("met", "score", "y")).alias("best")).select(
        F.least("x", "best.y").alias("a"), F.greatest("x", "best.y").alias("b")).distinct()
    links = confirm(best, texts, scratch, percent)
    roots = components(links, scratch)

    def across(pairs: DataFrame) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(roots.select(F.col("node").alias(f"_{x}"), F.col("root").alias(f"r{x}")), F.col(x) == F.col(f"_{x}"), "left")
        return pairs.where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")

    rest = across(found.join(best, ["a", "b"], "left_anti"))
    links = links.unionAll(confirm(rest, texts, scratch, percent))
    roots = components(links, scratch)
    if (more := exact_rest(*forest.apart(roots), texts, scratch, percent)) is not None:
        roots = components(links.unionAll(more), scratch)
    named = scratch.save(classes.join(roots, F.col("cid") == F.col("node"), "left").select(
        F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), F.coalesce("root", "cid").alias("root"), "low"), "named")
    # a component whose smallest member has no id takes its smallest id
    return signed.join(named, F.expr("f1 = _f1 and f2 = _f2"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("low").isNotNull(), F.col("root")), "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, all columns as they were."""
    kept = near_duplicates(docs, STAGE_PERCENT).where("doc_id <=> component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return unpack(pack(docs, "text", "doc_id").join(kept.hint("shuffle_hash"), F.expr("doc_id <=> _kept"), "left_semi"), docs)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


ORACLE = rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
sets AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(greatest(len(w) - {SHINGLE - 1}, 1)),
    lambda k: array_to_string(w[k + 1 : k + {SHINGLE}], ' ')))) END AS s FROM docs),
classes AS (SELECT row_number() OVER () AS c, s, len(s) AS n, min(doc_id) AS low FROM sets WHERE len(s) > 0 GROUP BY s),
members AS (SELECT c, n, unnest(s) AS x FROM classes),
common AS (SELECT a.c AS a, b.c AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM members a JOIN members b ON a.x = b.x AND a.c < b.c
    AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * shared >= {PERCENT} * (na + nb - shared)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT r.a, e.b FROM reach r JOIN sides e ON e.a = r.b),
roots AS (SELECT reach.a AS c, min(low) AS component FROM reach JOIN classes ON classes.c = reach.b GROUP BY reach.a)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component END AS component_id,
    doc_id IS NOT DISTINCT FROM (CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component END) AS kept
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN roots ON roots.c = classes.c"""
