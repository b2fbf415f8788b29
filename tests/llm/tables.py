"""Small tables with every odd case: nulls, empty and long texts, repeated rows, clashing columns, groups of copies."""

import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WHITE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size long, n_words long, _rid long, spans string, root long, copies int"
LINE = "This very line stands in many of the documents, word for word."


def prose(rng, n):
    vocabulary = ["alpha", "Beta", "gamma,", "delta.", "epsilon", "zeta", "Êta", "thêta", "iota", "kappa", "lambda", "mu", "nu", "xi", "pi"]
    return " ".join(rng.choice(vocabulary) + (str(rng.randint(0, 400)) if rng.random() < 0.6 else "") for _ in range(n))


def edited(rng, text, share):
    return " ".join(("x" + w) if rng.random() < share else w for w in text.split(" "))


def documents(seed=1, n=60):
    rng = random.Random(seed)
    base = prose(rng, 300)
    texts = [None, "", " \n\t ", "one", "two words", "\n", "a\r\nb\x0bc", "\u00a0\u2003", "NUL\x01 end", base, base, base + " tail",
             "Released under the MIT License.", "under the mit license under the mit license", "CC BY NC cc by nc", "Apache License, Version 2.0; all rights reserved",
             "Permission is hereby granted, free of charge, to any person obtaining a copy", prose(rng, 40_000), "word " * 5_000, "### $$$ %%% " * 60,
             "İstanbul K Ǆ ß ﬁ " * 20, "<|endoftext|> it's a 's <|ENDOFTEXT|>"]
    texts += [edited(rng, base, 0.004) for _ in range(12)] + [edited(rng, base, 0.05) for _ in range(4)]
    texts += [prose(rng, rng.randint(1, 260)) + ("\n" + LINE.upper() + " " if k % 3 else "") + ("\n" + LINE) * (k % 4) for k in range(n)]
    rows = []
    for k, t in enumerate(texts):
        rows.append((k * 3, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "é", None]), len(t or ""), 7, 7, 7, "x", 7, 7))
    rows += [rows[15], rows[15], (None, base, None, None, None, None, None, None, None, None, None), (None, "under the mit license", "en", "a", 1, 1, 1, 1, "", 1, 1)]
    rng.shuffle(rows)
    return rows


BENCHMARK = "item_id long, text string, n_words long"


def benchmark(docs, seed=2):
    rng = random.Random(seed)
    long = [r[1] for r in docs if r[1] and len(WORD.findall(r[1])) > 60]
    items = [(0, None, 1), (1, "", 1), (2, "one", 1), (3, "Two, WORDS", 1), (4, "... !!!", 1)]
    for k in range(12):
        words = WORD.findall(rng.choice(long).translate(LOWER))
        at = rng.randrange(len(words) - 30)
        items.append((10 + k, " ".join(words[at : at + rng.randint(3, 25)]), 1))
    return items + [items[-1], (100, " ".join(f"never{k}" for k in range(20)), 1), (None, items[-2][1], 1)]


PAGES = "page_id long, url string, html string, host string, trust long"


def pages():
    link = lambda *hs: "".join(f'<a href="http://{h}/x">x</a>' for h in hs)
    rows = [
        (1, "http://a.example.com/en/1", link("b.example.com", "B.example.com")), (2, "https://EXAMPLE.com/en/77?x=/de/", ""), (3, "http://example.net/de/8", None),
        (4, "ftp://x.example.net/de/7#f", ""), (5, "http://notexample.net/de/8", ""), (6, "http://spam-farm.example.org/en/1", link("c.org")),
        (7, "http://good.org/fr/1", link("spam-farm.example.org", "good.org")), (8, "http://www.casino-win.org", ""), (9, None, link("a.b")), (10, "no scheme", ""),
        (11, "http://", ""), (12, "http:///en/path", ""), (13, "http://com/en/", ""), (14, "http://x.com/en", ""), (15, "http://a.org/es/?q://", ""), (None, "http://a.org/es/", None),
        (16, "//x.org/es/", ""), (17, "http://q.org?u=http://x.com/en/1", ""), (18, "http://ÉX.com/en/é", ""),
    ]
    return [(*r, "h", 1) for r in rows + rows[:2]]


CONVERSATIONS = "conv_id long, turn long, role string, text string, mask string, block long"


def conversations():
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hello"), (1, 2, "bob", "hi <|end|>"), (1, 3, "ann", None), (1, 3, "bob", "same turn"), (1, 4, None, "who"),
            (2, 0, "system", "alone"), (3, None, "ann", "no turn"), (3, 5, "ann", ""), (None, 0, "bob", "no id"), (None, 1, "ann", "é" * 5_000)]
    rows += [(4, t, "ann" if t % 2 else "bob", f"turn {t}") for t in range(200)]
    rows += [(5, t, "system" if t < 70 else "ann" if t == 150 else "bob", f"turn {t}") for t in range(180)]
    rows += [(6, t // 40, ["ann", "bob", "cy"][t % 3], f"crowd {t:05}") for t in range(4_500)]
    return [(*r, "m", 1) for r in rows + rows[:3]]


def write(spark, path, docs=None, items=None):
    docs = documents() if docs is None else docs
    items = benchmark(docs) if items is None and docs else items or []
    for name, rows, schema in (("documents", docs, DOCUMENTS), ("benchmark", items, BENCHMARK), ("pages", pages() if docs else [], PAGES),
                               ("conversations", conversations() if docs else [], CONVERSATIONS)):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return str(path)
