"""URL filters: path rules by host, and link-graph propagation for what no rule covers.

Two personalised PageRanks run over host edges: trust starts at hosts with explicitly allowed pages
and follows links forward; distrust starts at blocked hosts and follows links backward, to those that
link there. A host whose distrust is above its trust, and not below LEAST, is blocked for pages that
no rule covers.

Every seed host starts with up to UNIT, the share of its pages that are seeds, so a host's masses are
sums over the seeds that reach it: they and LEAST mean the same in a corpus of any size. A round moves
DAMPING hundredths of what arrived in the round before, dealt out by link weights to every edge; a
host's mass is all that arrived there, its PageRank but for a constant factor. What arrived is moved
on while it is STILL or more at a host, so the walks end by themselves: a round halves what is under
way, and no host keeps back more than a tenth of LEAST of a round's arrivals.

Edges are absolute links of the pages, counted for each pair of hosts, and the tie of a host to its
parent host (both ways, weight 1), so that the hosts of a site share what is known of it. Masses are
whole numbers, so sums do not depend on their order and reruns agree. Pages are shuffled as sums per
host and per pair of hosts; the walks move a row for each edge and kind of mass.

Null urls and urls without :// have an empty host and path, no rule and no edges, and are allowed.
A null html has no links. Repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, table

#: (action, host, path): fixed values.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: First labels of hosts known to be bad, beside those whose pages the rules block.
BLOCKED_NAMES = ("spam-farm", "casino-win", "cheap-pills")
#: The mass of a seed host; a long holds that of 9 * 10**9 hosts.
UNIT = 10**9
DAMPING = 50
#: Distrust that blocks, and mass that is moved on: hundredths and thousandths of a seed host's.
LEAST = UNIT // 100
STILL = UNIT // 1_000
#: Rounds between two written tables.
WRITE_EVERY = 4
#: A host is a distrust seed if rules block so many hundredths of its pages.
SEED_PERCENT = 90
BROADCAST_ROWS = 50_000
_LINK = r"""href\s*=\s*["']?[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#"'\s>]+)"""


def _rule_sql(host: str, path: str) -> tuple[str, str]:
    """SQL for the name of the longest rule that fits, and for its action; null where none fits."""
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(({host} = '{h}' or {host} like '%.{h}') and {path} like '{p}%')" for _, h, p in ordered]
    name = " ".join(f"when {c} then '{h}{p}'" for c, (_, h, p) in zip(fits, ordered, strict=True))
    action = " ".join(f"when {c} then '{a}'" for c, (a, _, _) in zip(fits, ordered, strict=True))
    return f"case {name} end", f"case {action} end"


def with_rules(pages: DataFrame) -> DataFrame:
    """pages with host, path, rule and action."""
    name, action = _rule_sql("host", "path")
    rest = F.expr("if(instr(url, '://') > 0, substring(url, instr(url, '://') + 3), '')")
    return (pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
            .withColumn("host", ascii_lower(F.regexp_extract("_rest", r"^[^/?#]*", 0)))
            .withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1))
            .withColumn("rule", F.expr(name)).withColumn("action", F.expr(action)).drop("_rest"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(a, b, w): host a links to host b w times; and a host and its parent, both ways."""
    linked = pages.where("host <> ''").select(
        F.col("host").alias("a"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("b"))
    links = linked.withColumn("b", ascii_lower("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("w"))
    hosts = pages.where("host <> ''").select("host").unionAll(links.select("b")).distinct()
    parents = hosts.select("host", F.expr("substring(host, instr(host, '.') + 1)").alias("up")).where(
        "instr(host, '.') > 1 and instr(up, '.') > 1")
    return (links.unionAll(parents.select("host", "up", F.lit(1).cast("long"))).unionAll(parents.select("up", "host", F.lit(1).cast("long")))
            .groupBy("a", "b").agg(F.sum("w").alias("w")))


def host_seeds(pages: DataFrame) -> DataFrame:
    """(host, kind, seed): t for trust and x for distrust; a host's seed is UNIT times the share of its pages."""
    bad = F.substring_index("host", ".", 1).isin(*BLOCKED_NAMES)
    for n in (1, 2):  # the name may stand after a www. or the like
        bad = bad | F.element_at(F.concat(F.split("host", r"\."), F.array(*[F.lit("")] * 3)), n + 1).isin(*BLOCKED_NAMES)
    per = pages.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("action") == "allow").alias("good"), F.count_if(F.col("action") == "block").alias("barred"))
    kinds = per.select("host", F.explode(F.array(
        F.struct(F.lit("t").alias("kind"), F.when(bad, 0).otherwise(F.expr(f"good * {UNIT}L div n")).alias("seed")),
        F.struct(F.lit("x").alias("kind"), F.when(bad | (F.col("barred") * 100 >= F.col("n") * SEED_PERCENT), UNIT).otherwise(0).cast("long").alias("seed")),
    )).alias("s")).select("host", "s.kind", "s.seed").where("seed > 0")
    return kinds


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, trust, distrust) for hosts with any mass."""
    both = edges.select(F.lit("t").alias("kind"), F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionAll(
        edges.select(F.lit("x").alias("kind"), F.col("b").alias("src"), F.col("a").alias("dst"), "w"))
    out = both.groupBy("kind", "src").agg(F.sum("w").alias("all"))
    both = scratch.save(both.join(out, ["kind", "src"]), "shares")
    # m is what arrived last, mass all that arrived
    state = seeds.select("kind", "host", F.col("seed").alias("m"), F.col("seed").alias("mass"))
    rounds = 0
    while True:
        # m * w may pass a long; what is dealt out does not
        dealt = both.join(state.where(F.col("m") >= STILL).select("kind", F.col("host").alias("src"), "m"), ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), F.expr("cast(m as decimal(19,0)) * cast(w as decimal(19,0)) div all").alias("m"), F.lit(0).cast("long").alias("mass"))
        state = dealt.unionAll(state.select("kind", "host", F.lit(0).cast("long"), "mass")).groupBy("kind", "host").agg(
            F.expr(f"sum(m) * {DAMPING} div 100").alias("m"), F.sum("mass").alias("mass")).withColumn("mass", F.expr("mass + m"))
        rounds += 1
        if rounds % WRITE_EVERY == 0:
            state = scratch.save(state, f"state{rounds}")
            if state.where(F.col("m") >= STILL).isEmpty():
                break
            scratch.drop(f"state{rounds - WRITE_EVERY}")
    kept = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0))
    return state.groupBy("host").agg(kept("t").alias("trust"), kept("x").alias("distrust"))


def filter_urls(pages: DataFrame) -> DataFrame:
    """pages with host, path, rule, trust, distrust and verdict."""
    scratch = Scratch(pages.sparkSession, "urls")
    read = with_rules(pages)
    seeds = scratch.save(host_seeds(read), "seeds")
    edges = scratch.save(host_edges(read), "edges")
    masses = scratch.save(propagate(edges, seeds, scratch).where(f"distrust >= {LEAST} or trust > 0").withColumnRenamed("host", "_host"), "masses")
    masses = F.broadcast(masses) if masses.count() <= BROADCAST_ROWS else masses
    return read.join(masses, F.col("host") == F.col("_host"), "left").withColumns({
        "trust": F.coalesce("trust", F.lit(0)), "distrust": F.coalesce("distrust", F.lit(0))}).withColumn(
        "verdict", F.coalesce("action", F.expr(f"if(distrust >= {LEAST} and distrust > trust, 'block', 'allow')"))).drop("action", "_host")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    name, action = _rule_sql("host", "path")
    bad = ", ".join(f"'{x}'" for x in BLOCKED_NAMES)
    parts = [f"""
rest AS (SELECT page_id, coalesce(html, '') AS html,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, html, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT *, {name} AS rule, {action} AS action FROM cut),
linked AS (SELECT host AS a, translate(unnest(regexp_extract_all(html, '{_LINK.replace("'", "''")}', 1)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS b FROM ruled WHERE host <> ''),
links AS (SELECT a, b, count(*) AS w FROM linked WHERE a <> b GROUP BY a, b),
hosts AS (SELECT host FROM ruled WHERE host <> '' UNION SELECT b FROM links),
parents AS (SELECT host, substr(host, strpos(host, '.') + 1) AS up FROM hosts
    WHERE strpos(host, '.') > 1 AND strpos(substr(host, strpos(host, '.') + 1), '.') > 1),
edges AS (SELECT a, b, sum(w) AS w FROM (SELECT * FROM links UNION ALL SELECT host, up, 1 FROM parents
    UNION ALL SELECT up, host, 1 FROM parents) GROUP BY a, b),
per AS (SELECT host, count(*) AS n, count(*) FILTER (action = 'allow') AS good, count(*) FILTER (action = 'block') AS barred,
    string_split(host, '.')[1] IN ({bad}) OR coalesce(string_split(host, '.')[2], '') IN ({bad})
    OR coalesce(string_split(host, '.')[3], '') IN ({bad}) AS bad FROM ruled WHERE host <> '' GROUP BY host),
kinds AS (SELECT host, 't' AS kind, CASE WHEN bad THEN 0 ELSE good * {UNIT} // n END AS m FROM per UNION ALL
    SELECT host, 'x', CASE WHEN bad OR barred * 100 >= n * {SEED_PERCENT} THEN {UNIT} ELSE 0 END FROM per),
both_ways AS (SELECT 't' AS kind, a AS src, b AS dst, w FROM edges UNION ALL SELECT 'x', b, a, w FROM edges),
shares AS (SELECT kind, src, dst, w, sum(w) OVER (PARTITION BY kind, src) AS whole FROM both_ways),
walk AS (SELECT kind, host, CAST(m AS HUGEINT) AS m FROM kinds WHERE m > 0
    UNION ALL SELECT s.kind, s.dst, CAST(sum(p.m * s.w // s.whole) * {DAMPING} // 100 AS HUGEINT)
    FROM walk p JOIN shares s ON s.kind = p.kind AND s.src = p.host WHERE p.m >= {STILL} GROUP BY s.kind, s.dst),
judged AS (SELECT host, sum(CASE WHEN kind = 't' THEN m ELSE 0 END) AS trust, sum(CASE WHEN kind = 'x' THEN m ELSE 0 END) AS distrust
    FROM walk GROUP BY host)"""]
    return "WITH RECURSIVE " + ",".join(parts) + f"""
SELECT page_id, ruled.host, path, rule,
    coalesce(action, CASE WHEN distrust >= {LEAST} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN judged ON judged.host = ruled.host"""


ORACLE = _oracle()
