"""Line dedup over levelled sorted runs of line hashes.

Documents are taken in batches of descending ids. A batch is reduced to one row for each line key
that counts (hash, documents of the batch that hold it, largest of their ids), in as many buckets of
the hash as the runs have, and merge-joined with every run so far: keys that an anti-join would leave
are new, and the batch's largest document keeps the line, since later batches hold smaller ids only; of
keys already held only the count is added. The batch's rows then become a run of level 0. Whenever
FAN runs of a level have gathered they are merged into one run of the next level, so many batches
leave few runs. Runs are bucketed and sorted by hash, a file for each bucket, so joins with them and
merges of them read both sides in order, without an exchange or a sort.

A second pass takes from the merged run the keys found in LEAST_DOCUMENTS documents or more, joins
them to the documents' lines by hash, and rebuilds each text without the lines to drop. A line that a
third of all documents hold is one row a task after the map-side sum; in the join its matches are
left to the skew-join splitting of adaptive execution.

Keys are compared by two chained 64-bit hashes. A null or empty text is one empty line. A document is
an id: rows that share one count once for a key, and are judged and returned each for itself; rows
without an id count as one document before all others. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, ascii_lower, table

LEAST_POINTS = 20
LEAST_DOCUMENTS = 3
FAN = 2
#: A table is taken in so many batches, or as many more as hold this many lines each.
BATCHES = 4
BATCH_LINES = 1 << 31
#: Lists of dropped lines, and of repeated ids, beyond this many rows are joined by shuffle, not broadcast.
BROADCAST_ROWS = 20_000
#: ASCII white space.
_BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.btrim(ascii_lower(line), F.lit(_BLANKS))


def _lines(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, whole, h1, h2, at, first) for each line whose key is long enough.

    whole is a hash of the text, at the line's number from 0, first whether no line before it in the
    text has its key: a document counts once for a key.
    """
    hashed = F.transform(_lines(), lambda x, i: F.struct(i.alias("at"), line_key(x).alias("key")))
    hashed = F.transform(F.filter(hashed, lambda x: F.char_length(x["key"]) >= LEAST_POINTS), lambda x: F.struct(
        F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit("line"), x["key"]).alias("h2"), x["at"].alias("at")))
    # sorted by hash and number, equal keys are neighbours
    each = docs.select("doc_id", F.xxhash64("text").alias("whole"), F.array_sort(hashed).alias("k"))
    before = F.when(F.col("i") > 0, F.get("k", F.col("i") - 1))
    return each.select("doc_id", "whole", "k", F.posexplode("k").alias("i", "x")).select(
        "doc_id", "whole", "x.h1", "x.h2", "x.at",
        F.coalesce((before["h1"] != F.col("x.h1")) | (before["h2"] != F.col("x.h2")), F.lit(True)).alias("first"))


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Within it, a bucket of one file counts as sorted."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class LineRuns:
    """The runs: bucketed, sorted tables of (h1, h2, n, keeper) by level; keeper is null where a run only adds to the count."""

    def __init__(self, scratch: Scratch, fan: int = FAN):
        self.scratch, self.spark, self.fan = scratch, scratch.spark, fan
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def run(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def _write(self, rows: DataFrame) -> str:
        """rows lie in buckets of their hash already, by an aggregation or as runs do."""
        name = f"line_run_{uuid.uuid4().hex}"
        path = self.scratch.path(name)
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).option("compression", "zstd").saveAsTable(name)
        self.scratch.paths[name] = path
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        self.scratch.drop(name)

    def against(self, batch: DataFrame) -> DataFrame:
        """A batch's rows with no keeper where some run holds the key."""
        for name in [name for level in self.levels for name in level]:
            held = self.run(name).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).hint("merge")
            batch = batch.join(held, F.expr("h1 = _h1 and h2 = _h2"), "left").select(
                "h1", "h2", "n", F.when(F.col("_h1").isNull(), F.col("keeper")).alias("keeper"))
        return batch

    def merged(self, one: str, other: str) -> DataFrame:
        """Two runs as one, in order, bucket by bucket."""
        a, b = (self.run(name).select(*[F.col(c).alias(f"{c}_{side}") for c in ("h1", "h2", "n", "keeper")]) for name, side in ((one, "a"), (other, "b")))
        zero = F.lit(0).cast("long")
        return a.join(b.hint("merge"), F.expr("h1_a = h1_b and h2_a = h2_b"), "full").select(
            F.coalesce("h1_a", "h1_b").alias("h1"), F.coalesce("h2_a", "h2_b").alias("h2"),
            (F.coalesce("n_a", zero) + F.coalesce("n_b", zero)).alias("n"), F.greatest("keeper_a", "keeper_b").alias("keeper"))

    def add(self, lines: DataFrame) -> None:
        """Take in a batch of (h1, h2, doc_id), a row for each document that holds a key; all ids are below those of the batches before."""
        batch = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        with _sorted_scans(self.spark):
            self.levels[0].append(self._write(self.against(batch)))
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fan:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._merge(self.levels[level]))
                self.levels[level] = []

    def _merge(self, names: list[str]) -> str:
        """One run of several, two at a time."""
        def two(one: str, other: str) -> str:
            with _sorted_scans(self.spark):
                made = self._write(self.merged(one, other))
            self.drop(one)
            self.drop(other)
            return made

        return reduce(two, names)

    def all_rows(self) -> DataFrame:
        """One run of all runs, smaller levels first."""
        names = [name for level in self.levels for name in level]
        self.levels = [[] for _ in self.levels]
        self.levels[-1] = [self._merge(names)]
        return self.run(self.levels[-1][0])


def holders(lines: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(h1, h2, doc_id), a row for each document that holds a key: rows that share an id are one."""
    once = lines.where("first").select("h1", "h2", "doc_id")
    repeated = scratch.save(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id")), "repeated")
    if not (n := repeated.count()):
        return once
    repeated = F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated
    same = F.expr("doc_id <=> _id")
    return once.join(repeated, same, "left_anti").unionAll(once.join(repeated, same, "left_semi").distinct())


def dedup_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped and kept, the text of the lines that stay."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    lines = scratch.save(keyed_lines(docs), "lines")
    held = holders(lines, docs, scratch)
    batches = max(batches, -(-lines.count() // BATCH_LINES))
    cuts = lines.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)]).alias("cuts")).first().cuts or []
    runs = LineRuns(scratch)
    upto = [*sorted(set(cuts)), None]
    for k in reversed(range(len(upto))):
        part = F.lit(True) if upto[k] is None else F.col("doc_id") <= upto[k]
        part = part & (F.col("doc_id") > upto[k - 1]) if k else F.col("doc_id").isNull() | part
        runs.add(held.where(part))
    many = scratch.save(runs.all_rows().where(F.col("n") >= LEAST_DOCUMENTS).select("h1", "h2", "keeper"), "many")
    runs.drop(runs.levels[-1][0])
    drops = lines.join(many, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("doc_id", "whole").agg(
        F.collect_set("at").alias("drop"))
    drops = scratch.save(drops, "drops").withColumnsRenamed({"doc_id": "_id", "whole": "_whole"})
    drops = F.broadcast(drops) if drops.count() <= BROADCAST_ROWS else drops.hint("shuffle_hash")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("whole")).join(
        drops, F.expr("doc_id <=> _id and whole = _whole"), "left")
    split = rows.select("doc_id", _lines().alias("lines"), F.coalesce("drop", F.expr("cast(array() as array<int>)")).alias("drop"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    return split.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("drop").cast("long").alias("n_dropped"),
        F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n").alias("kept"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT rid, doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM docs),
keyed AS (SELECT *, trim(translate(line, '{UPPER}', '{LOWER}'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines),
many AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {LEAST_POINTS}
    GROUP BY key HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= {LEAST_DOCUMENTS}),
judged AS (SELECT rid, doc_id, pos, line, many.key IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS dropped FROM keyed LEFT JOIN many ON many.key = keyed.key)
SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY rid"""
