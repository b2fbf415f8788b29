"""Hilbert-curve sharding: order rows along a curve through several metadata dimensions and cut runs.

Four dimensions of four bits each (source, language, size, document id, cut where a sixteenth of the
rows has passed) give a cell of a Hilbert curve; rows are sorted by (cell, text, id) and cut into runs
whose counts differ by one at most. Neighbours on the curve are neighbours in every dimension, so each
shard spans a narrow range of all four and a reader that filters on any of them skips most files.

Equal texts are a group and share a cell, that of their smallest id, so they lie in a row. Where a cut
goes through a group that a shard can hold, the smaller part changes places with single texts of the
shard that holds the rest, or all of it with single texts of the nearest shard that has as many; counts
stay as they are. A group stays apart only if it is larger than a shard, or than what any shard has of
single texts.

Nulls are a value of their own (last for strings, 0 for numbers); a null text counts no bytes and
has checksum 0, and is equal to an empty one; repeated rows are separate rows; an empty table gives an
empty result. Columns of the input other than those named are carried only by `hilbert_shards(..., keep=...)`.
One row for each distinct source, and for each shard, passes through a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table

BITS = 4
LEVELS = 1 << BITS
#: A table of distinct values beyond this many rows is joined by shuffle, not broadcast.
BROADCAST_ROWS = 20_000


def hilbert_cell(packed: str) -> Column:
    """The place on the curve, 0 to 65535, of four coordinates packed as nibbles of an int column.

    The packed form keeps each step of the transform one small expression over a lambda variable.
    """
    steps = ",".join(f"struct({q} as q, {4 * i} as s)" for q in (8, 4, 2) for i in range(4))
    undo = f"""aggregate(array({steps}), {packed}, (h, t) -> case
        when (shiftright(h, t.s) & t.q) <> 0 then h ^ (t.q - 1)
        when t.s = 0 then h
        else h ^ ((h ^ shiftright(h, t.s)) & (t.q - 1)) ^ shiftleft((h ^ shiftright(h, t.s)) & (t.q - 1), t.s) end)"""
    gray = f"aggregate(array(4, 8, 12), {undo}, (h, s) -> h ^ shiftleft(shiftright(h, s - 4) & 15, s))"
    flips = "(if((h & 32768) <> 0, 7, 0) ^ if((h & 16384) <> 0, 3, 0) ^ if((h & 8192) <> 0, 1, 0))"
    flipped = f"aggregate(array({gray}), 0, (a, h) -> h ^ ({flips} * 4369))"
    return F.expr(f"""aggregate(sequence(0, 15), struct({flipped} as h, 0 as d),
        (a, k) -> struct(a.h as h, a.d * 2 + (shiftright(a.h, (k % 4) * 4 + 3 - cast(k div 4 as int)) & 1) as d),
        a -> a.d)""")


def _codes(rows: DataFrame, column: str, out: str) -> DataFrame:
    """A code 0 to 15 for each distinct value: values in order, cut where a sixteenth of the rows has passed."""
    counts = rows.groupBy(column).agg(F.count("*").alias("_n"))
    order = Window.orderBy(F.col(column).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.select(
        F.col(column).alias(f"_{column}"),
        F.floor((F.sum("_n").over(order) - F.col("_n")) * LEVELS / F.sum("_n").over(every)).cast("int").alias(out),
    )


def _with_code(rows: DataFrame, column: str, out: str, scratch: Scratch) -> DataFrame:
    codes = scratch.save(_codes(rows, column, out), out)
    codes = F.broadcast(codes) if codes.count() <= BROADCAST_ROWS else codes
    return rows.join(codes, F.col(column).eqNullSafe(F.col(f"_{column}")), "left").drop(f"_{column}")


_TEXT = ["text_crc32", "size", "_hash"]


def _grouped(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with `together`, how many share the text, and the cell of the smallest id among them."""
    groups = scratch.save(rows.groupBy(*_TEXT).agg(F.count("*").alias("together"), F.min(F.struct("doc_id", "cell")).alias("_first")).where("together > 1").select(
        *[F.col(c).alias(f"_{c}") for c in _TEXT], "together", F.col("_first.cell").alias("_cell")), "groups")
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    return rows.join(groups, F.expr(" and ".join(f"{c} = _{c}" for c in _TEXT)), "left").withColumns({
        "cell": F.coalesce("_cell", "cell"), "together": F.coalesce("together", F.lit(1))}).drop("_cell", *[f"_{c}" for c in _TEXT])


def _ranked(placed: DataFrame, value: Column, out: str) -> DataFrame:
    """placed with the sum of value (0 or more) over all rows before, from sums within range partitions (_run, _at) and over them."""
    inside = Window.partitionBy("_run").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition, so the broadcast is bounded by the number of partitions
    runs = placed.groupBy("_run").agg(F.sum(value).alias("_n")).select("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(runs), "_run").withColumn(
        out, F.col("_before") + F.col("_inside")).drop("_inside", "_before")


def _swaps(ranked: DataFrame, total: int, n_shards: int, scratch: Scratch) -> DataFrame | None:
    """(_old, _new) ranks of rows that change places, so that groups come together; None if no cut goes through one."""
    spark = ranked.sparkSession
    shard = lambda rank: rank * n_shards // total
    first = lambda k: -(-k * total // n_shards)
    of = F.expr(f"(_rank * {n_shards}L) div {total}L")
    cut = ranked.where("together > 1").groupBy(*_TEXT).agg(F.min("_rank").alias("low"), F.max("_rank").alias("high")).where(
        f"(low * {n_shards}L) div {total}L < (high * {n_shards}L) div {total}L and high - low < {total // n_shards}L")
    # each of these goes through a cut: no more rows than shards
    through = [(r.low, r.high) for r in cut.select("low", "high").collect() if shard(r.high) == shard(r.low) + 1]
    if not through:
        return None
    counted = scratch.save(_ranked(ranked.withColumn("_one", (F.col("together") == 1).cast("long")), F.col("_one"), "_single").where("_one = 1").select(
        "_rank", "_single", of.alias("_shard")), "singles")
    room = {r["_shard"]: [r.low, r.high] for r in counted.groupBy("_shard").agg(F.min("_single").alias("low"), F.max("_single").alias("high")).collect()}
    moves = []
    for low, high in sorted(through):
        middle = first(shard(high))
        parts = [(middle - low, low, shard(high)), (high - middle + 1, middle, shard(low))]
        for n, start, to in sorted(parts):
            free = room.get(to)
            if free is None or free[1] - free[0] + 1 < n:
                continue
            # from the shard's end at the cut
            if to == shard(high):
                moves.append((start, n, free[0]))
                free[0] += n
            else:
                moves.append((start, n, free[1] - n + 1))
                free[1] -= n
            break
        else:  # neither shard has room: the nearest that has takes all of it
            size, near = high - low + 1, shard(low)
            if (to := next((t for t in sorted(room, key=lambda t: abs(t - near)) if room[t][1] - room[t][0] + 1 >= size), None)) is not None:
                moves.append((low, size, room[to][0]))
                room[to][0] += size
    if not moves:
        return None
    table_ = F.broadcast(spark.createDataFrame(moves, "_start long, _n long, _from long"))
    theirs = counted.join(table_, F.expr("_single >= _from and _single < _from + _n")).select(F.col("_rank").alias("_old"), F.expr("_start + _single - _from").alias("_new"))
    theirs = scratch.save(theirs, "swaps")
    return theirs.unionAll(theirs.select("_new", "_old"))


def hilbert_shards(docs: DataFrame, n_shards: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, source, lang, cell, together, shard, slot and the columns of `keep`.

    Only ids, sizes and checksums are shuffled, by range; the global rank is the place within a range
    partition plus the rows of the partitions before it, so no task holds more than one range.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "hilbert")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.save(docs.select(
        "doc_id", "source", "lang", *keep,
        (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_hash"),
    ), "rows")
    cuts = rows.agg(F.percentile_approx("doc_id", [k / LEVELS for k in range(1, LEVELS)]).alias("cuts")).first().cuts or []
    passed = "+".join([f"if(doc_id > {c}L, 1, 0)" for c in cuts] or ["0"])
    coded = _with_code(_with_code(rows, "source", "a0", scratch), "lang", "a1", scratch)
    coded = coded.withColumn("_packed", (
        F.col("a0")
        + F.shiftleft("a1", 4)
        + F.shiftleft(F.least(F.lit(LEVELS - 1), F.greatest(F.lit(0), F.floor(F.log2(F.col("size"))).cast("int") - 4)), 8)
        + F.shiftleft(F.coalesce(F.expr(passed), F.lit(0)).cast("int"), 12)
    ).cast("int")).withColumn("cell", hilbert_cell("_packed")).drop("_packed", "a0", "a1")
    coded = scratch.save(coded, "coded")
    order = ["cell", *_TEXT, "doc_id"]
    placed = scratch.save(
        _grouped(coded, scratch).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        "placed",
    ).withColumn("_run", F.shiftright("_at", 33))
    scratch.drop("rows")
    scratch.drop("coded")
    runs = placed.groupBy("_run").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    total = placed.count()
    ranked = placed.join(F.broadcast(offsets), "_run").withColumn(
        "_rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_before")
    if total and (swaps := _swaps(ranked, total, n_shards, scratch)) is not None:
        swaps = F.broadcast(swaps) if swaps.count() <= BROADCAST_ROWS else swaps.hint("shuffle_hash")
        ranked = ranked.join(swaps, F.col("_rank") == F.col("_old"), "left").withColumn("_rank", F.coalesce("_new", "_rank")).drop("_old", "_new")
    shard = F.expr(f"(_rank * {n_shards}L) div {max(total, 1)}L")
    return ranked.withColumn("shard", shard.cast("int")).withColumn(
        "slot", F.expr(f"_rank - (shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    ).drop("_run", "_at", "_rank", "_hash")


def write_shards(docs: DataFrame, n_shards: int, path: str) -> None:
    """Write whole documents as one folder per shard, each sorted along the curve."""
    cut = hilbert_shards(docs.select("doc_id", "source", "lang", "text"), n_shards, keep=("text",))
    (cut.repartitionByRange(n_shards, "shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
