"""The pipeline against a brute-force version of each stage: which rows go on, and what comes out at the end."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from chainfold.llm import quality
from tests.llm import tables
from tests.llm.tables import LOWER, WHITE, WORD
from tests.llm.test_operators import encoded, shingles

STAGES = dict(corpus_pipeline.STAGES)


def measures(text):
    words = WHITE.findall(text or "")
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    cover = {p for k, x in enumerate(zip(words, words[1:], words[2:], strict=False)) if seen[x] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if WHITE.search(x)]
    n = len(words)
    failed = n < 50 or 100 * len(cover) > 50 * n
    return failed, {"symbols": 1000 * sum((text or "").count(c) for c in "#*$%&|<>") // max(n, 1), "repeats": 1000 * len(cover) // max(n, 1),
                    "copies": 1000 * (len(lines) - len(set(lines))) // (len(lines) + 10), "length": 1000 * sum(map(len, words)) // max(n, 1)}


def quantiles(values):
    """Of the bins of relative width 1/64, evenly within a bin."""
    def ends(x):
        if x < 64:
            return x, x + 1
        width = 1 << (x.bit_length() - 7)
        return x // width * width, x // width * width + width

    bins, total = Counter(map(ends, values)), len(values)
    out = []
    for num, den in quality.QUANTILES:
        upto = 0
        for (low, high), n in sorted(bins.items()):
            if (upto + n) * den >= total * num:
                out.append(low + ((high - low) * (total * num - upto * den) - 1) // (n * den))
                break
            upto += n
    return out


def drawn(own, n, parts, whole, to):
    w = math.floor(1000 * (2.0 * n * parts) / (2.0 * n * parts + whole))
    return [(w * a + (1000 - w) * b) // 1000 for a, b in zip(own, to, strict=True)]


def good(rows):
    judged = [(r, *measures(r["text"])) for r in rows]
    passing = [(r["lang"], r["source"], m) for r, failed, m in judged if not failed]
    fences = {}
    for feature in ("symbols", "repeats", "copies", "length"):
        group, lang = defaultdict(list), defaultdict(list)
        for lg, s, m in passing:
            group[lg, s].append(m[feature])
            lang[lg].append(m[feature])
        corpus = quantiles([x for v in lang.values() for x in v]) if passing else []
        for (lg, s), values in group.items():
            upper = drawn(quantiles(lang[lg]), len(lang[lg]), len(lang), len(passing), corpus)
            q = drawn(quantiles(values), len(values), sum(k[0] == lg for k in group), len(lang[lg]), upper)
            low = high = None
            if feature == "length":
                low, high = q[1] - 8 * (q[1] - q[0]), q[1] + 8 * (q[2] - q[1])
            else:
                noise = quality.NOISE[feature]
                step = next(((a + noise, b + noise) for a, b in zip(q[1:], q[2:], strict=False) if b + noise >= 4 * (a + noise)), None)
                high = math.floor(math.sqrt(step[0] * step[1])) - noise if step else None
            fences[lg, s, feature] = low, high
    kept = []
    for r, failed, m in judged:
        limits = [(m[f], *fences.get((r["lang"], r["source"], f), (None, None))) for f in m]
        if not failed and all((low is None or x >= low) and (high is None or x <= high) for x, low, high in limits):
            kept.append(r)
    return kept


def one_of_each(rows):
    sets = [shingles(r["text"] or "") for r in rows]
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                group[top(i)] = top(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[top(i)].append(r["doc_id"])
    return [r for i, r in enumerate(rows) if not sets[i] or r["doc_id"] == min(least[top(i)])]


def clean(rows, items):
    windows = set()
    for text in items:
        w = WORD.findall((text or "").translate(LOWER))
        windows |= {tuple(w[k : k + 8]) for k in range(len(w) - 7)}

    def hit(text):
        w = WORD.findall((text or "").translate(LOWER))
        return any(tuple(w[k : k + 8]) in windows for k in range(len(w) - 7))

    return [r for r in rows if not hit(r["text"])]


def corpus(seed):
    """Prose of three sources, junk, copies and near copies of some, and passages of a benchmark, one item in most."""
    rng = random.Random(seed)
    words = [f"{rng.choice('bcdfgklmnprstv')}{rng.choice('aeiou')}{rng.choice(['', 'n', 'rt', 'lass'])}{k}" for k in range(3000)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    items = [prose(rng.choice([12, 20, 60])) for _ in range(15)] + [words[7], None, ""]
    texts = [prose(rng.randint(60, 200)) + "\nand a second line" * rng.choice([0, 0, 1]) for _ in range(220)]
    texts += [" ".join(w + rng.choice(["", " ### $$"]) for w in prose(80).split()) for _ in range(25)] + [prose(rng.randint(1, 49)) for _ in range(10)] + [None, "", "the same " * 60]
    for k in range(20):
        texts.append(texts[k])
        near = texts[k + 20].split(" ")
        near[len(near) // 2] = "other"
        texts.append(" ".join(near))
        texts.append(f"{prose(50)} {items[k % 15]} {prose(40)}")
    rng.shuffle(texts)
    docs = [(k, t, rng.choice(["en", "en", "de"]), rng.choice(["a", "a", "b", "c", None]), len(t or ""), 7, 7, 7, "x", 7, 7) for k, t in enumerate(texts)]
    return docs, [(k, t, 1) for k, t in enumerate(items)]


def test_stages_against_brute_force(spark, tmp_path):
    docs, items = corpus(3)
    path = tables.write(spark, tmp_path / "t", docs=docs, items=items)
    at = spark.read.parquet(f"{path}/documents.parquet")
    rows = [r.asDict() for r in at.collect()]
    counted = lambda rs: Counter(tuple(r.values()) for r in rs)
    sizes = [len(rows)]
    for name, brute in (("quality rules", good), ("near dedup", one_of_each), ("decontamination", lambda rs: clean(rs, [i[1] for i in items]))):
        STAGES[name](spark, at, path).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        rows = brute(rows)
        assert counted(r.asDict() for r in at.collect()) == counted(rows), name
        sizes.append(len(rows))
    assert sizes[0] - sizes[1] > 30 and sizes[1] - sizes[2] > 20 and sizes[2] - sizes[3] >= 15

    STAGES["mixing"](spark, at, path).write.parquet(f"{tmp_path}/mixed")
    mixed = [r.asDict() for r in spark.read.parquet(f"{tmp_path}/mixed").collect()]
    words = lambda rs: {s: sum(len(WHITE.findall(r["text"])) for r in rs if r["source"] == s) for s in ("a", "b", "c", None)}
    had, has, times = words(rows), words(mixed), counted(mixed)
    assert set(times) <= set(counted(rows)) and max(times.values()) <= 3
    target, free, left = {}, {"a": 5, "b": 2, "c": 1, None: 5}, sum(had.values())
    while over := [s for s in free if left * free[s] / sum(free.values()) > 3 * had[s]]:
        for s in over:
            target[s] = 3 * had[s]
            left -= target[s]
            del free[s]
    target |= {s: left * w / sum(free.values()) for s, w in free.items()}
    assert all(abs(has[s] - target[s]) <= 60 for s in target)

    ids = sorted(encoded([(r["doc_id"], r["text"] or "") for r in mixed]))
    starts = np.cumsum([0, *(len(x) for _, x in ids)])
    expect = Counter((d, int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, x), s in zip(ids, starts, strict=False))
    assert Counter(map(tuple, corpus_pipeline.run(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == expect
