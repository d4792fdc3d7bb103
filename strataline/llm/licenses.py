"""License scans with a positional rare-token index, by DataFrame functions alone.

A template has mandatory key phrases, which must stand whole in their places wherever it counts. The index holds, for each
template, the places of its `anchors` mandatory words of highest IDF, counted over all documents: word -> postings
(template, place). Each occurrence of such a word in a document meets its postings, and place in the document less place in
the template is the offset at which that template would stand. Offsets on which all of a template's anchors agree are aligned:
its key phrases are verified, the template is compared word by word, and it counts where the share of its words reaches
`least`. As a template's own mandatory words stand in every place where it counts, nothing else in a text can hide it: the
findings are all (template, offset) with whole key phrases and enough coverage, however the index is chosen.

Phrases (base) are sought likewise; all their words must stand.

Cases: null and empty texts have no words; long texts are read whole; repeated rows are told apart by nothing and give
equal rows; a null doc_id is kept; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: A word, after A-Z are lower-cased: letters, digits and anything beyond ASCII; and the same in either case.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
ANY_CASE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

#: Base phrases and their labels. Fixed values.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


@dataclass(frozen=True)
class Template:
    """A licence text: its label, its words, and the key phrases that must stand whole in their places."""

    label: str
    text: str
    keys: tuple[str, ...]


_GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu {0}general public license as published by the free software foundation either version {1} of the license or at your option any later version"
_CC = "this work is licensed under a creative commons attribution {0}4 0 international license"

# Notices as they stand in files, and short forms that are their own key phrase; a label each. Fixed values, lower case, words alone.
TEMPLATES = (
    *(Template(f"gpl-{v}.0", text, (key,)) for v in (2, 3) for text, key in [
        (_GPL.format("", v), f"general public license as published by the free software foundation either version {v}"),
        (f"gnu general public license version {v}", f"gnu general public license version {v}"),
        (f"gnu general public license v{v}", f"gnu general public license v{v}"),
    ]),
    Template("lgpl-2.1", _GPL.format("lesser ", "2 1"), ("lesser general public license as published by the free software foundation either version 2 1",)),
    Template("lgpl-3.0", _GPL.format("lesser ", "3"), ("lesser general public license as published by the free software foundation either version 3",)),
    Template("agpl-3.0", _GPL.format("affero ", "3"), ("affero general public license as published by the free software foundation either version 3",)),
    Template("apache-2.0", "apache license version 2 0", ("apache license version 2 0",)),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("you may not use this file except in compliance with the license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee is hereby granted",)),
    Template("cc-by-nc-4.0", "cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-nc-4.0", _CC.format("noncommercial "), ("creative commons attribution noncommercial 4 0",)),
    Template("cc-by-sa-4.0", _CC.format("sharealike "), ("creative commons attribution sharealike 4 0",)),
    Template("cc-by-4.0", _CC.format(""), ("creative commons attribution 4 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)


@dataclass(frozen=True)
class Scan:
    """anchors: mandatory words of highest IDF that are looked up, of each template; least: share of a template's words that must stand."""

    anchors: int = 2
    least: float = 0.7
    templates: tuple[Template, ...] = TEMPLATES


def based(docs: DataFrame, scan: Scan, text: str = "text") -> DataFrame:
    """docs' doc_id with words (array, only where a licence could stand), n_words and the base findings.

    Phrases are sought in strings; only documents with one, or with a template's key phrase, are split into words.
    """
    c = F.col
    rows = docs.select("doc_id", F.coalesce(F.regexp_count(text, F.lit(ANY_CASE)), F.lit(0)).cast("long").alias("n_words"), ascii_lower(F.coalesce(text, F.lit(""))).alias("lower"))
    return rows.withColumn("words", F.when(_hinted(c("lower"), scan), F.regexp_extract_all("lower", F.lit(WORD), F.lit(0)))).drop("lower")


_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _hinted(lower: Column, scan: Scan) -> Column:
    """Whether a phrase, or a key phrase of any template, may stand in a text: first by plain strings, a long word of each phrase, then
    by its words side by side and whole."""
    phrases = sorted({*(p for p, _ in PHRASES), *(t.keys[0] for t in scan.templates)})
    long = {p: [w for w in p.split() if len(w) > 5] for p in phrases}
    common = sorted({w for ws in long.values() for w in ws}, key=lambda w: (-sum(w in ws for ws in long.values()), w))
    probes = {next(w for w in common if w in ws) for ws in long.values() if ws}
    short = [p for p in phrases if not long[p]]
    quick = [F.contains(lower, F.lit(w)) for w in sorted(probes)] + ([lower.rlike("|".join(sorted({_BREAK.join(p.split()[:2]) for p in short})))] if short else [])
    edge = r"0-9a-z\x{80}-\x{10FFFF}"
    whole = rf"(?<![{edge}])(?:{'|'.join(_BREAK.join(p.split()) for p in phrases)})(?![{edge}])"
    return reduce(lambda a, b: a | b, quick) & lower.rlike(whole)


def places(words: Column | str, phrase: str) -> Column:
    """Places where a phrase's words stand consecutively."""
    parts = phrase.split()
    words = F.col(words) if isinstance(words, str) else words
    firsts = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), lambda k: _stands(words, k, parts))
    return F.when(F.size(words) >= len(parts), firsts).otherwise(F.array().cast("array<int>"))


def _stands(words: Column, at: Column, parts: list[str]) -> Column:
    """Whether parts stand in words from place at; the first word is compared first."""
    found = F.lit(True)
    for k in reversed(range(len(parts))):
        found = F.when(F.get(words, at + k) == parts[k], found).otherwise(False)
    return found


def mandatory(template: Template) -> list[tuple[str, int]]:
    """(word, place) of a template's key phrases."""
    words = template.text.split()
    return sorted({(words[k], k) for key in template.keys for k in range(_at(template.text, key), _at(template.text, key) + len(key.split()))}, key=lambda x: x[1])


def index(scan: Scan, idf: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """word -> postings (template, place) of the templates' anchors."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, template in enumerate(scan.templates):
        for w, k in sorted(mandatory(template), key=lambda x: (-idf[x[0]], x))[: scan.anchors]:
            out.setdefault(w, []).append((t, k))
    return out


def scanned(docs: DataFrame, scan: Scan = Scan(), text: str = "text") -> DataFrame:  # noqa: B008
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and found:
    array<struct<label, at, coverage>> of the method's findings."""
    c = F.col
    rows = based(docs, scan, text)
    candidate = F.when(c("words").isNotNull(), _method(scan, _idf(docs, scan, text)))
    hits = [(places("words", p), label) for p, label in PHRASES]
    rows = rows.withColumns({f"_p{k}": F.when(c("words").isNotNull(), h) for k, (h, _) in enumerate(hits)})
    rows = rows.withColumn("found", F.coalesce(candidate, F.array().cast("array<struct<label:string,at:int,coverage:double>>")))
    none = F.array().cast("array<int>")
    every = F.concat(*(F.coalesce(c(f"_p{k}"), none) for k in range(len(PHRASES))))
    base = F.array_sort(F.array_compact(F.array(*(F.when(F.size(F.coalesce(c(f"_p{k}"), none)) > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)))))
    out = rows.withColumns({"_all": every, "_base": base})
    labels = F.array_sort(F.array_distinct(F.concat("_base", F.transform("found", lambda f: f["label"]))))
    score = F.greatest(F.coalesce(F.array_max(F.transform("found", lambda f: f["coverage"])), F.lit(0.0)), F.when(F.size("_base") > 0, 0.5).otherwise(0.0))
    return out.select("doc_id", "n_words", F.size("_all").cast("long").alias("n_base"), F.array_min("_all").cast("long").alias("first_word"), F.array_max("_all").cast("long").alias("last_word"), F.array_join("_base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "found")


def _idf(docs: DataFrame, scan: Scan, text: str) -> dict[str, float]:
    """Inverse document frequency of the templates' mandatory words over all documents.

    One row with a count for each of these words comes back.
    """
    words = sorted({w for t in scan.templates for w, _ in mandatory(t)})
    lower = docs.select(ascii_lower(F.coalesce(text, F.lit(""))).alias("lower"))
    distinct = lower.select(F.array_intersect(F.regexp_extract_all("lower", F.lit(WORD), F.lit(0)), F.array(*map(F.lit, words))).alias("known"))
    row = distinct.agg(F.count("*").alias("n"), *(F.count_if(F.array_contains("known", w)).alias(f"w{k}") for k, w in enumerate(words))).first()
    return {w: math.log((row["n"] + 1) / ((row[f"w{k}"] or 0) + 1)) + 1 for k, w in enumerate(words)}


def _method(scan: Scan, idf: dict[str, float]) -> Column:
    """Findings in the column words: anchors, postings at equal offsets, key phrases, word-by-word alignment."""
    postings = index(scan, idf)
    table = F.create_map(*(x for w in sorted(postings) for x in (F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in postings[w])))))
    needed = F.array(*(F.lit(min(scan.anchors, len(mandatory(t)))) for t in scan.templates))
    texts = F.array(*(F.array(*map(F.lit, t.text.split())) for t in scan.templates))
    labels = F.array(*(F.lit(t.label) for t in scan.templates))
    keys = F.array(*(F.array(*(F.struct(F.lit(_at(t.text, k)).alias("p"), F.array(*map(F.lit, k.split())).alias("words")) for k in t.keys)) for t in scan.templates))

    def code(t: Column, offset: Column) -> Column:
        """Template and offset as one number, so that equal ones stand together once sorted."""
        return t.cast("long") * F.lit(1 << 33) + offset.cast("long") + F.lit(4096)

    def template(q: Column) -> Column:
        return F.shiftright(q, 33).cast("int")

    def aligned(words: Column, q: Column) -> Column:
        t, offset = template(q), (q.bitwiseAND(F.lit((1 << 33) - 1)) - 4096).cast("int")
        same = F.size(F.filter(F.transform(F.get(texts, t), lambda w, k: w == F.get(words, offset + k)), lambda b: b))
        verified = F.forall(F.get(keys, t), lambda k: F.when(offset + k["p"] >= 0, F.slice(words, offset + k["p"] + 1, F.size(k["words"])) == k["words"]).otherwise(False))
        return F.struct(F.get(labels, t).alias("label"), offset.alias("at"), F.when(verified, same / F.size(F.get(texts, t))).otherwise(0.0).alias("coverage"))

    def found(words: Column) -> Column:
        met = F.filter(F.transform(words, lambda w, at: F.struct(table[w].alias("postings"), at.alias("at"))), lambda x: x["postings"].isNotNull())
        offsets = F.array_sort(F.flatten(F.transform(met, lambda x: F.transform(x["postings"], lambda y: code(y["t"], x["at"] - y["p"])))))
        agreed = let(offsets, lambda every: F.array_distinct(F.filter(every, lambda q, k: q == F.get(every, k + F.get(needed, template(q)) - 1))))
        return F.filter(F.transform(agreed, lambda q: aligned(words, q)), lambda f: f["coverage"] >= scan.least)

    return let(F.col("words"), found)


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _at(text: str, key: str) -> int:
    words, parts = text.split(), key.split()
    return next(k for k in range(len(words)) if words[k : k + len(parts)] == parts)
