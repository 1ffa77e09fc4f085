"""License scans by a positional rare-token index, in DataFrame functions only.

The licence templates below are small and fixed, so their words, positions and key phrases are literals of the plan.
One pass over the corpus counts in how many documents each licence word stands. Each template's words of highest IDF
are its anchors, so many that a beginning at which none of them stands in place can't reach the score demanded. Their
places propose where a template would have to begin (place less the word's place in the template); all proposals of a
template are scored by the IDF of the template words that stand where they should, and a label needs a high score and
every mandatory key phrase. Texts without a template's phrases aren't scored for it.

Defined results: a null or empty text has no words, no places, null first_word and last_word, empty labels and score
0; very long texts are scanned whole; ties need no rule, as every place and label counts; repeated rows are scanned each
on its own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Phrases whose places are counted, and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices as they stand in public files (permission notices, file headers, titles and short references),
# and phrases without which a notice doesn't count. A label stands for any of its notices.
TEMPLATES: dict[str, tuple[tuple[str, tuple[str, ...]], ...]] = {
    "agpl-3": (
        ("licensed under the gnu affero general public license version 3", ("affero general public license",)),
        ("it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license",)),
        ("spdx license identifier agpl 3 0", ("spdx license identifier agpl 3",)),
    ),
    "apache-2": (
        ("licensed under the apache license version 2 0", ("apache license",)),
        ("you may not use this file except in compliance with the license you may obtain a copy of the license at", ("this file except in compliance with the license",)),
        ("under the apache license 2 0", ("apache license 2 0",)),
        ("apache license version 2 0 january 2004", ("apache license version 2 0",)),
        ("spdx license identifier apache 2 0", ("spdx license identifier apache 2",)),
    ),
    "bsd": (
        ("redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
        ("use of this source code is governed by a bsd style license", ("bsd style license",)),
        ("licensed under the bsd license", ("bsd license",)),
        ("spdx license identifier bsd", ("spdx license identifier bsd",)),
    ),
    "cc-by": (
        ("licensed under the creative commons attribution 4 0 international license", ("creative commons attribution",)),
        ("licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
        ("licensed under cc by 4 0", ("cc by 4 0",)),
        ("spdx license identifier cc by 4 0", ("spdx license identifier cc by 4 0",)),
    ),
    "cc-by-nc": (
        ("licensed under cc by nc 4 0", ("by nc",)),
        ("licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
        ("licensed under the creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
        ("spdx license identifier cc by nc 4 0", ("spdx license identifier cc by nc",)),
    ),
    "cc-by-sa": (
        ("licensed under cc by sa 4 0", ("by sa",)),
        ("licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
        ("licensed under the creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
        ("spdx license identifier cc by sa 4 0", ("spdx license identifier cc by sa",)),
    ),
    "gpl": (
        ("this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
        ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
        ("licensed under the gnu general public license", ("under the gnu general public license",)),
        ("spdx license identifier gpl", ("spdx license identifier gpl",)),
    ),
    "isc": (
        ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
        ("licensed under the isc license", ("isc license",)),
        ("spdx license identifier isc", ("spdx license identifier isc",)),
    ),
    "lgpl": (
        ("licensed under the gnu lesser general public license version 3", ("lesser general public license",)),
        ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
        ("spdx license identifier lgpl", ("spdx license identifier lgpl",)),
    ),
    "mit": (
        ("released under the mit license", ("mit license",)),
        ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("granted free of charge", "in the software without restriction")),
        ("licensed under the mit license", ("mit license",)),
        ("spdx license identifier mit", ("spdx license identifier mit",)),
    ),
    "mpl-2": (
        ("this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
        ("licensed under the mozilla public license version 2 0", ("mozilla public license",)),
        ("spdx license identifier mpl 2 0", ("spdx license identifier mpl 2",)),
    ),
    "unlicense": (
        ("this is free and unencumbered software released into the public domain", ("unencumbered software",)),
        ("spdx license identifier unlicense", ("spdx license identifier unlicense",)),
    ),
}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text whose A-Z are lowered; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def licence_words(templates: dict = TEMPLATES) -> list[str]:
    return sorted({w for notices in templates.values() for text, phrases in notices for part in (text, *phrases) for w in part.split()})


def document_frequencies(words: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Documents, and documents with each licence word; at most one row a licence word reaches the driver."""
    held = F.array_intersect("words", F.array(*map(F.lit, vocabulary)))
    # no word is empty: "" counts the documents
    seen = words.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    counts = {r["w"]: r["n"] for r in seen.collect()}
    return counts.get("", 0), {w: counts.get(w, 0) for w in vocabulary}


def _stands(words: Column, phrase: list[str], at: Column) -> Column:
    found = F.lit(True)
    for j, w in enumerate(phrase):
        found = found & F.coalesce(F.get(words, at + j) == w, F.lit(False))
    return found


def _places(words: Column, phrase: str, held: Column | None = None) -> Column:
    """Starts of a phrase, words from 0; texts without its rarest words (by held, their different words, if given) aren't walked."""
    parts = phrase.split()
    asked = F.lit(True)
    for w in sorted(parts, key=len, reverse=True):
        asked = asked & F.array_contains(words if held is None else held, w)
    last = F.size(words) - len(parts)
    return F.when(asked & (last >= 0), F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: _stands(words, parts, i))).otherwise(F.array().cast("array<int>"))


def anchors(listed: list[tuple[str, int]], idf: dict[str, float], least_score: float) -> list[tuple[str, int]]:
    """Places of the template's words of highest IDF, until the others together stay under the least score."""
    whole, out, rest = sum(idf[w] for w, _ in listed), [], sum(idf[w] for w, _ in listed)
    for w in sorted({w for w, _ in listed}, key=lambda w: (-idf[w], w)):
        if rest < (least_score - 1e-9) * whole:
            break
        out += [x for x in listed if x[0] == w]
        rest -= sum(idf[w] for x in listed if x[0] == w)
    return out


def scan_licenses(docs: DataFrame, templates: dict = TEMPLATES, least_score: float = 0.7) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for each row of docs(doc_id, text)."""
    read = docs.select("doc_id", words_of(F.col("text").cast("string")).alias("words"))
    vocabulary = licence_words(templates)
    n, df = document_frequencies(read, vocabulary)
    idf = {w: math.log((n + 1) / (c + 1)) + 1e-3 for w, c in df.items()}
    label = {f"{name} {i}": name for name, notices in templates.items() for i in range(len(notices))}
    listed_by = {f"{name} {i}": notice for name, notices in templates.items() for i, notice in enumerate(notices)}
    postings = {name: [(w, at) for at, w in enumerate(text.split())] for name, (text, _) in listed_by.items()}
    proposing = {name: anchors(listed, idf, least_score) for name, listed in postings.items()}
    named = sorted(listed_by)

    words, held = F.col("words"), F.col("held")
    places = [_places(words, p).alias(f"p{i}") for i, p in enumerate(BASE_PHRASES)]
    one = read.select("doc_id", "words", F.array_intersect(F.array(*map(F.lit, vocabulary)), "words").alias("held"), *places)

    def verified(name: str) -> Column:
        found = F.lit(True)
        for phrase in listed_by[name][1]:
            found = found & (F.size(_places(words, phrase, held)) > 0)
        return found

    #: of the templates whose mandatory phrases stand in the text, the anchors that do
    two = one.withColumn("asked", F.filter(F.array(*(F.when(verified(t), F.lit(t)) for t in named)), lambda x: x.isNotNull()))
    proposed = F.array_distinct(F.flatten(F.transform("asked", lambda t: F.element_at(F.create_map(*(x for t in named for x in (F.lit(t), F.array(*(F.lit(w) for w in sorted({w for w, _ in proposing[t]})))))), t))))
    rare = F.when(F.size("asked") > 0, F.array_intersect(proposed, "held")).otherwise(F.array().cast("array<string>"))
    two = two.withColumn("rare", rare)
    spots = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda s: F.array_contains("rare", s.w))
    two = two.withColumn("spots", F.when(F.size("rare") > 0, spots).otherwise(F.array().cast("array<struct<i:int,w:string>>")))

    def score(name: str) -> Column:
        """The best share of the template's IDF that stands in place, over all proposed beginnings."""
        whole = sum(idf[w] for w, _ in postings[name])
        table = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(at).alias("at")) for w, at in proposing[name]))
        begins = F.array_distinct(F.flatten(F.transform("spots", lambda s: F.transform(F.filter(table, lambda p: p.w == s.w), lambda p: s.i - p["at"]))))
        weights = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(at).alias("at"), F.lit(float(idf[w])).alias("idf")) for w, at in postings[name]))
        stands = lambda o, p: F.coalesce(F.when(o + p["at"] >= 0, F.get(words, F.greatest(o + p["at"], F.lit(0)))) == p.w, F.lit(False))
        weigh = lambda o: F.aggregate(weights, F.lit(0.0), lambda held, p: held + F.when(stands(o, p), p.idf).otherwise(0.0)) / whole
        return F.coalesce(F.array_max(F.transform(begins, weigh)), F.lit(0.0))

    scores = [F.when(F.array_contains("asked", t), score(t)).otherwise(0.0).alias(f"s_{i}") for i, t in enumerate(named)]
    three = two.select("doc_id", "words", *[f"p{i}" for i in range(len(places))], *scores)
    accepted = [F.when(F.col(f"s_{i}") >= least_score, F.struct(F.lit(label[t]).alias("label"), F.least(F.col(f"s_{i}"), F.lit(1.0)).alias("score"))) for i, t in enumerate(named)]
    by_method = F.filter(F.array(*accepted), lambda x: x.isNotNull()) if accepted else F.array().cast("array<struct<label:string,score:double>>")
    by_base = F.array_distinct(F.filter(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(name)) for i, name in enumerate(BASE_PHRASES.values()))), lambda x: x.isNotNull()))
    four = three.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.concat(*(f"p{i}" for i in range(len(places)))).alias("places"), by_base.alias("by_base"), by_method.alias("by_method")
    )
    return four.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("by_base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("by_base", F.col("by_method.label")))), ",").alias("labels"),
        F.when(F.size("by_base") > 0, 1.0).otherwise(F.round(F.coalesce(F.array_max("by_method.score"), F.lit(0.0)), 6)).alias("score"),
    )
