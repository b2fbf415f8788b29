"""License scans by a positional rare-token index.

Templates are word sequences with mandatory key phrases. One pass over the texts counts, for each word
of the templates but STOP, the documents that hold it, which gives its IDF. Each template is posted
under one word alone, the one of highest IDF in its first key phrase, with its position. A file's
licence words are taken from the highest IDF on, as far as templates are posted under them: each place
of such a word and each posting give a template and where in the file it would start. Starts are then
intersected with the rest of the template's words by relative position, in the file's own word list: a
template is found there if all its key phrases stand where they must, word for word. The score is the
IDF-weighted part of a template's posted words that stand in place, the best over what was found, and 0
if nothing was.

Nothing is shuffled but the counts: a file's candidates are verified in its own row. Null texts have
no words; repeated rows are scanned each for itself; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD_BREAK, Scratch, ascii_lower, table, word_array

#: (label, template, key phrases): fixed values. A template that is its own key phrase is one of the base.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
MORE = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
            " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or"
            " sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above"
            " copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
     ("permission is hereby granted free of charge",)),
    ("mit", "spdx license identifier mit", ("spdx license identifier mit",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy"
                 " of the license at", ("licensed under the apache license version 2 0",)),
    ("apache-2", "you may not use this file except in compliance with the license", ("you may not use this file except in compliance with the license",)),
    ("apache-2", "spdx license identifier apache 2 0", ("spdx license identifier apache 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
            " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in"
            " binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other"
            " materials provided with the distribution", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above"
            " copyright notice and this permission notice appear in all copies", ("permission to use copy modify", "fee is hereby granted")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free"
            " software foundation", ("gnu general public license",)),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license", ("gnu general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can"
              " obtain one at", ("mozilla public license",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from"
             " the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and"
             " redistribute it freely", ("alter it and redistribute it freely",)),
    ("bsl-1", "boost software license version 1 0", ("boost software license version 1 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this"
                  " software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
     ("free and unencumbered software released into the public domain",)),
    ("cc0", "creative commons cc0 1 0 universal", ("cc0 1 0 universal",)),
    ("cc-by-nc", "creative commons attribution noncommercial", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "cc by sa", ("cc by sa",)),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)
STOP = frozenset("a all and any are as be by can for in into is it not of or that the this to under use with without you 0 1 2".split())
TEMPLATES = tuple((label, tuple(t.split()), (tuple(t.split()),), True) for label, t in BASE) + tuple(
    (label, tuple(t.split()), tuple(tuple(k.split()) for k in keys), False) for label, t, keys in MORE)
VOCABULARY = sorted({w for _, t, _, _ in TEMPLATES for w in t} - STOP)


def _at(words: tuple[str, ...], phrase: tuple[str, ...]) -> int:
    return next(k for k in range(len(words)) if words[k : k + len(phrase)] == phrase)


def rarest(idf: dict[str, int]) -> list[tuple[str, int]]:
    """For each template the word it is posted under and the word's place in it."""
    posted = []
    for _, words, phrases, _ in TEMPLATES:
        key = phrases[0]
        best = max((k for k, w in enumerate(key) if w not in STOP), key=lambda k: (idf[key[k]], -k))
        posted.append((key[best], _at(words, key) + best))
    return posted


def _quoted(words) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words and `found`, an array of (start, label, base, score) in order of start."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    anchors = sorted({w for _, _, phrases, _ in TEMPLATES for w in phrases[0]} - STOP)
    words = docs.select("doc_id", word_array(ascii_lower(F.coalesce("text", F.lit("")))).alias("words"))
    rows = scratch.save(words.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        # what can hold a template keeps its words, all else none
        F.when(F.arrays_overlap("words", F.array(*map(F.lit, anchors))), F.col("words")).alias("words"),
        F.array_intersect(F.array(*map(F.lit, VOCABULARY)), F.col("words")).alias("seen")), "words")
    n_docs = rows.count()
    # one row for each word of the vocabulary at most
    counts = {r.w: r.n for r in rows.select(F.explode("seen").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    idf = {w: round(1e6 * math.log((n_docs + 1) / (counts.get(w, 0) + 1))) + 1 for w in VOCABULARY}
    posted = rarest(idf)
    index: dict[str, list[str]] = {}
    for number, (word, place) in enumerate(posted):
        index.setdefault(word, []).append(f"struct({number} as template, {place} as place)")
    # rare words first, as a file's own are looked up
    rare = sorted(index, key=lambda w: (-idf[w], w))
    lookup = "map(" + ", ".join(f"'{w}', array({', '.join(index[w])})" for w in rare) + ")"
    facts = []
    for label, text, phrases, base in TEMPLATES:
        keys = ", ".join(f"struct({_at(text, p)} as at, {_quoted(p)} as words)" for p in phrases)
        scored = ", ".join(f"struct({k} as place, '{w}' as w, {idf[w]}L as idf)" for k, w in enumerate(text) if w not in STOP)
        whole = sum(idf[w] for w in text if w not in STOP)
        facts.append(f"struct('{label}' as label, {str(base).lower()} as base, array({keys}) as keys, array({scored}) as scored, {whole}L as whole)")
    places = F.expr(f"filter(transform(words, (w, i) -> struct(i as i, w as w)), x -> x.w in ({', '.join(repr(w) for w in rare)}))")
    starts = F.expr(f"""array_distinct(flatten(transform(_places, h -> transform(element_at({lookup}, h.w), p -> struct(h.i - p.place as start, p.template as template)))))""")
    held = F.expr(f"""filter(_starts, c -> forall(element_at(array({', '.join(facts)}), c.template + 1).keys,
        k -> c.start + k.at >= 0 and slice(words, greatest(c.start + k.at, 0) + 1, size(k.words)) = k.words))""")
    found = F.expr(f"""array_sort(transform(transform(_held, c -> struct(c.start as start, element_at(array({', '.join(facts)}), c.template + 1) as t)),
        x -> struct(cast(x.start as bigint) as start, x.t.label as label, x.t.base as base,
            1000000 * aggregate(x.t.scored, 0L, (a, p) -> a + if(x.start + p.place >= 0 and get(words, x.start + p.place) <=> p.w, p.idf, 0L)) div x.t.whole / 1e6d as score)))""")
    none = F.expr("cast(array() as array<struct<start:bigint,label:string,base:boolean,score:double>>)")
    looked = rows.withColumn("_places", places).withColumn("_starts", starts).withColumn("_held", held)
    return looked.select("doc_id", "n_words", F.when(F.size("_held") > 0, found).otherwise(none).alias("found"))


def _digest(found: DataFrame) -> DataFrame:
    base = F.filter("found", lambda f: f["base"])
    starts = F.transform(base, lambda f: f["start"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda f: f["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0)).alias("score"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(scan_licenses(table(spark, sf_dir, "documents")))


def _oracle() -> str:
    quote = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    posts = [(w, t, k) for t, (_, words, _, _) in enumerate(TEMPLATES) for k, w in enumerate(words) if w not in STOP]
    values = ", ".join(f"('{w}', {t}, {k})" for w, t, k in posts)
    anchors = ", ".join(f"('{w}', {t}, {k})" for t, (w, k) in enumerate(rarest(dict.fromkeys(VOCABULARY, 1))))
    facts = ", ".join(f"({k}, '{label}', {base}, [{', '.join(str(_at(words, p)) for p in keys)}], [{', '.join(map(quote, keys))}])"
                      for k, (label, words, keys, base) in enumerate(TEMPLATES))
    return f"""
WITH post(w, template, place) AS (VALUES {values}),
anchors(w, template, place) AS (VALUES {anchors}),
facts(template, label, base, spots, keys) AS (VALUES {facts}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '{WORD_BREAK}'), lambda x: x <> '') AS words FROM documents),
hits AS (SELECT * FROM (SELECT rid, unnest(range(len(words))) AS i, unnest(words) AS w FROM docs) WHERE w IN (SELECT w FROM post)),
idf AS (SELECT v.w, CAST(round(1e6 * ln((SELECT count(*) + 1 FROM docs) / (coalesce(n, 0) + 1))) AS BIGINT) + 1 AS idf
    FROM (SELECT DISTINCT w FROM post) v LEFT JOIN (SELECT w, count(DISTINCT rid) AS n FROM hits GROUP BY w) s ON s.w = v.w),
whole AS (SELECT template, sum(idf) AS whole FROM post JOIN idf USING (w) GROUP BY template),
starts AS (SELECT DISTINCT rid, template, i - place AS start FROM hits JOIN anchors USING (w)),
held AS (SELECT rid, template, start, label, base FROM starts JOIN facts USING (template) JOIN docs USING (rid)
    WHERE len(list_filter(range(len(spots)), lambda k: start + spots[k + 1] >= 0 AND words[start + spots[k + 1] + 1 : start + spots[k + 1] + len(keys[k + 1])] = keys[k + 1])) = len(spots)),
got AS (SELECT rid, template, i - place AS start, sum(idf) AS got FROM hits JOIN post USING (w) JOIN idf USING (w) GROUP BY rid, template, start),
good AS (SELECT rid, start, label, base, (1000000 * got // whole) / 1e6 AS score FROM held JOIN got USING (rid, template, start) JOIN whole USING (template)),
per AS (SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    max(score) AS score FROM good GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
    CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN per USING (rid)"""


ORACLE = _oracle()
