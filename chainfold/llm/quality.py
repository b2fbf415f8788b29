"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Four integer features of the documents that pass the base rule (in thousandths) are counted in
log-linear bins of relative width 1/64, an exact-merge quantile sketch: sketches of partitions, sources
and languages add up bin by bin in any order, so results do not depend on how tasks are scheduled. A
group of (language, source) is judged by its own quantiles, drawn towards its language's, and those
towards the corpus's, the more the smaller it is beside a usual group; the weights are ratios of
counts, so a table ten times as large of the same documents gives the same verdicts.

Thresholds are read off these quantiles. The length of words has fences round the median, FENCE times
the upper or lower quartile's distance from it. The shares of symbols, repeated words and copied
lines are small nearly everywhere, with a tail; where the tail belongs to the group, quantiles
rise by steps, and nothing is fenced off; where one step goes up JUMP times (over the feature's NOISE),
a second kind of document begins, and the fence stands in the middle of that step.

Only counts per bin are shuffled, after a map-side sum, so a source with a third of all rows costs no
task more than its few hundred bins.

A null or empty text has no words and fails the base rule; nulls of language or source form groups
of their own; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, add_columns, pack, table, unpack

LEAST_WORDS = 50
FENCE = 8
JUMP = 4
#: Shares in thousandths: what a few chance hits make. Steps of quantiles are measured above it.
NOISE = {"symbols": 50, "repeats": 100, "copies": 100}
#: Lines that the share of copied lines is measured over at least, besides the document's own.
FEW_LINES = 10
#: Quantiles of a sketch: the quarter, then the median and ever smaller upper tails.
QUANTILES = ((1, 4), *((2**k - 1, 2**k) for k in range(1, 8)))
BITS = 6
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_SYMBOLS = b"#*$%&|<>"


def text_metrics(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (with a word) of a text.

    bytes.split() splits at exactly the six ASCII white-space characters.
    """
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    n = len(words)
    blanks = len(raw) - sum(map(len, words))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    repeated = 0
    if n > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        v = len(number)
        pair = ids[:-1] * v + ids[1:]
        if v < 2_000_000:
            window = pair[:-1] * v + ids[2:]
        else:  # v ** 3 would not fit
            window = np.unique(pair, return_inverse=True)[1][:-1] * v + ids[2:]
        order = np.argsort(window, kind="stable")
        same = window[order[1:]] == window[order[:-1]]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : k + n - 2] |= twice
        repeated = int(covered.sum())
    return n, len(text) - blanks, sum(map(raw.count, (bytes([c]) for c in _SYMBOLS))), len(lines) - len(set(lines)), repeated, len(lines)


def _measure():
    return lambda texts: list(map(list, zip(*map(text_metrics, texts), strict=True))) if texts else [[]] * 6


_FEATURES = {
    "symbols": "1000 * n_symbols {div} greatest(n_words, 1)",
    "repeats": "1000 * n_repeat_words {div} greatest(n_words, 1)",
    "copies": f"1000 * n_dup_lines {{div}} (n_lines + {FEW_LINES})",
    "length": "1000 * word_chars {div} greatest(n_words, 1)",
}
_BASE_FAILED = f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words"


def _features() -> dict[str, Column]:
    return {k: F.expr(v.format(div="div")) for k, v in _FEATURES.items()}


def bin_of(x: str) -> str:
    """SQL for a log-linear bin of a number from 0: itself below 64, else 64 bins for each power of two."""
    e = f"(length(bin({x})) - 1)"
    return f"case when {x} < {1 << BITS} then cast({x} as int) else cast({e} * {1 << BITS} + shiftright({x}, {e} - {BITS}) - {BITS << BITS} as int) end"


def least_in_bin(b: str) -> str:
    return f"case when {b} < {1 << BITS} then cast({b} as bigint) else shiftleft(cast({1 << BITS} + {b} % {1 << BITS} as bigint), {b} div {1 << BITS} - 1) end"


def _weight(n: str, parts: str, whole: str) -> str:
    """SQL for the thousandths that a part of n rows has of its own, beside half a usual part's."""
    twice = f"2 * cast({n} as double) * {parts}"
    return f"cast(floor(1000 * ({twice}) / ({twice} + {whole})) as bigint)"


def _fence_sql(kind: str) -> dict[str, tuple[str, str]]:
    """SQL for the low and high fence of each feature, from quantiles q0 .. q7 of QUANTILES; null is no fence."""
    fences = {}
    for name, noise in NOISE.items():
        steps = [(f"(q{k} + {noise})", f"(q{k + 1} + {noise})") for k in range(1, len(QUANTILES) - 1)]
        cases = " ".join(f"when {above} >= {JUMP} * {below} then cast(floor(sqrt(cast({below} * {above} as double))) as {kind}) - {noise}" for below, above in steps)
        fences[name] = (f"cast(null as {kind})", f"case {cases} end")
    fences["length"] = (f"q1 - {FENCE} * (q1 - q0)", f"q1 + {FENCE} * (q2 - q1)")
    return fences


def thresholds(rows: DataFrame) -> DataFrame:
    """(lang, source, feature, low, high) for each (lang, source) of rows that have the columns of METRICS; null is no threshold."""
    made = _features()
    long = rows.where(f"not ({_BASE_FAILED})").select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(k).alias("feature"), v.cast("long").alias("x")) for k, v in made.items()])).alias("f")
    ).select("lang", "source", "f.feature", F.expr(bin_of("f.x")).alias("bin"))
    own = long.groupBy("lang", "source", "feature", "bin").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string")
    sketch = own.select(F.lit(0).alias("level"), "lang", "source", "feature", "bin", "n").unionByName(
        own.groupBy("lang", "feature", "bin").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), "lang", none.alias("source"), "feature", "bin", "n")
    ).unionByName(
        own.groupBy("feature", "bin").agg(F.sum("n").alias("n")).select(F.lit(2).alias("level"), none.alias("lang"), none.alias("source"), "feature", "bin", "n"))
    key = ["level", "lang", "source", "feature"]
    upto = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(*key)))
    at = at.withColumn("least", F.expr(least_in_bin("bin"))).withColumn("width", F.expr(least_in_bin("(bin + 1)")) - F.col("least"))
    # the value of a rank lies evenly between the bin's ends
    value = lambda a, b: F.expr(f"case when upto * {b} >= total * {a} and (upto - n) * {b} < total * {a} then least + (width * (total * {a} - (upto - n) * {b}) - 1) div (n * {b}) end")
    names = [f"q{k}" for k in range(len(QUANTILES))]
    found = at.groupBy(*key).agg(F.first("total").alias("total"), *[F.min(value(*q)).alias(k) for q, k in zip(QUANTILES, names, strict=True)])
    group = found.where("level = 0").select("lang", "source", "feature", F.col("total").alias("n"), *names)
    per_lang = group.groupBy(F.col("lang").alias("_lang"), F.col("feature").alias("_f")).agg(F.count("*").alias("groups"))
    corpus = found.where("level = 2").select(F.col("feature").alias("_c"), F.col("total").alias("all"), *[F.col(q).alias(f"c{q}") for q in names])
    langs = found.where("level = 1").groupBy("feature").agg(F.count("*").alias("langs")).withColumnRenamed("feature", "_n")
    lang = found.where("level = 1").join(per_lang, F.expr("lang <=> _lang and feature = _f")).join(corpus, F.expr("feature = _c")).join(langs, F.expr("feature = _n"))
    lang = lang.withColumn("w", F.expr(_weight("total", "langs", "all"))).select(
        "_lang", "_f", "groups", F.col("total").alias("of"), *[F.expr(f"(w * {q} + (1000 - w) * c{q}) div 1000").alias(f"l{q}") for q in names])
    drawn = group.join(lang, F.expr("lang <=> _lang and feature = _f")).withColumn("w", F.expr(_weight("n", "groups", "of"))).select(
        "lang", "source", "feature", *[F.expr(f"(w * {q} + (1000 - w) * l{q}) div 1000").alias(q) for q in names])
    fences = _fence_sql("bigint")
    side = lambda i: F.expr("case feature " + " ".join(f"when '{k}' then {v[i]}" for k, v in fences.items()) + " end")
    return drawn.select("lang", "source", "feature", side(0).alias("low"), side(1).alias("high"))


def judge(docs: DataFrame, carry_text: bool = False) -> DataFrame:
    """docs as `_row` (and text, if carried) with the metrics, base_failed, kept and `failed`, the broken features."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.save(add_columns(pack(docs, "text", "doc_id", "lang", "source"), ["text"], _measure, METRICS,
                                    drop=() if carry_text else ("text",)), "metrics")
    fences = scratch.save(
        thresholds(rows).groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct(
            "feature", F.struct("low", "high")))).alias("_fence")).withColumnsRenamed({"lang": "_lang", "source": "_source"}),
        "fences")
    fences = F.broadcast(fences) if fences.count() <= 20_000 else fences
    rows = rows.join(fences, F.expr("lang <=> _lang and source <=> _source"), "left")
    beyond = lambda k, v: F.coalesce(v > F.col("_fence")[k]["high"], F.lit(False)) | F.coalesce(v < F.col("_fence")[k]["low"], F.lit(False))
    broken = F.array_compact(F.array(*[F.when(beyond(k, v), F.lit(k)) for k, v in _features().items()]))
    rows = rows.withColumn("base_failed", F.expr(_BASE_FAILED))
    return rows.withColumn("failed", broken).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop(
        "_fence", "_lang", "_source")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, all columns as they were."""
    return unpack(judge(docs, carry_text=True).where("kept"), docs)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    word = r"[^\x20\x09-\x0D]"
    feature = {k: v.format(div="//") for k, v in _FEATURES.items()}
    long = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS feature, CAST({v} AS BIGINT) AS x FROM metrics WHERE NOT ({_BASE_FAILED})" for k, v in feature.items())
    power, side = "(length(bin(x)) - 1)", 1 << BITS
    least = lambda b: f"CASE WHEN {b} < {side} THEN {b} ELSE ({side} + {b} % {side}) << ({b} // {side} - 1) END"
    names = [f"q{k}" for k in range(len(QUANTILES))]
    quantiles = ", ".join(f"min(CASE WHEN upto * {b} >= total * {a} AND (upto - n) * {b} < total * {a} THEN least + (width * (total * {a} - (upto - n) * {b}) - 1) // (n * {b}) END) AS {q}"
                          for (a, b), q in zip(QUANTILES, names, strict=True))
    fences = _fence_sql("BIGINT")
    of = lambda i: "CASE feature " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in fences.items()) + " END"
    same = "p.lang IS NOT DISTINCT FROM m.lang AND p.source IS NOT DISTINCT FROM m.source"
    bad = " OR ".join(f"coalesce(({v}) > (SELECT high FROM pick p WHERE {same} AND feature = '{k}'), false)"
                      f" OR coalesce(({v}) < (SELECT low FROM pick p WHERE {same} AND feature = '{k}'), false)" for k, v in feature.items())
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '{word}+') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM docs),
triples AS (SELECT rid, k, array_to_string(words[k + 1 : k + 3], ' ') AS w FROM (SELECT rid, words, unnest(range(greatest(len(words) - 2, 0))) AS k FROM split)),
again AS (SELECT rid, k FROM (SELECT rid, k, count(*) OVER (PARTITION BY rid, w) AS n FROM triples) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([k, k + 1, k + 2]) AS p FROM again) GROUP BY rid),
metrics AS (SELECT split.rid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines FROM split LEFT JOIN covered USING (rid)),
long AS ({long}),
binned AS (SELECT lang, source, feature, CASE WHEN x < {side} THEN x ELSE {power} * {side} + (x >> ({power} - {BITS})) - {BITS << BITS} END AS b FROM long),
sketch AS (SELECT 0 AS level, lang, source, feature, b, count(*) AS n FROM binned GROUP BY ALL UNION ALL
    SELECT 1, lang, NULL, feature, b, count(*) FROM binned GROUP BY ALL UNION ALL SELECT 2, NULL, NULL, feature, b, count(*) FROM binned GROUP BY ALL),
ranked AS (SELECT level, lang, source, feature, n, {least('b')} AS least, ({least('(b + 1)')}) - ({least('b')}) AS width,
    sum(n) OVER (PARTITION BY level, lang, source, feature ORDER BY b) AS upto, sum(n) OVER (PARTITION BY level, lang, source, feature) AS total FROM sketch),
found AS (SELECT level, lang, source, feature, max(total) AS total, {quantiles} FROM ranked GROUP BY ALL),
counted AS (SELECT l.*, (SELECT count(*) FROM found g WHERE level = 0 AND g.lang IS NOT DISTINCT FROM l.lang AND g.feature = l.feature) AS groups,
    (SELECT count(*) FROM found g WHERE level = 1 AND g.feature = l.feature) AS langs FROM found l WHERE l.level = 1),
weighed AS (SELECT l.lang, l.feature, l.total AS whole, groups, {_weight("l.total", "langs", "c.total")} AS w,
    {", ".join(f"l.{q} AS {q}, c.{q} AS c{q}" for q in names)} FROM counted l JOIN found c ON c.level = 2 AND c.feature = l.feature),
langs AS (SELECT lang, feature, whole, groups, {", ".join(f"(w * {q} + (1000 - w) * c{q}) // 1000 AS {q}" for q in names)} FROM weighed),
own AS (SELECT *, {_weight("n", "groups", "whole")} AS w FROM (SELECT g.lang, g.source, g.feature, g.total AS n, l.whole, l.groups, {", ".join(f"g.{q} AS g{q}, l.{q} AS l{q}" for q in names)}
    FROM found g JOIN langs l ON l.lang IS NOT DISTINCT FROM g.lang AND l.feature = g.feature WHERE g.level = 0)),
drawn AS (SELECT lang, source, feature, {", ".join(f"(w * g{q} + (1000 - w) * l{q}) // 1000 AS {q}" for q in names)} FROM own),
pick AS (SELECT lang, source, feature, {of(0)} AS low, {of(1)} AS high FROM drawn),
judged AS (SELECT *, {_BASE_FAILED} AS base_failed, ({bad}) AS broken FROM metrics m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT broken AS kept FROM judged"""


ORACLE = _oracle()
