"""License scans with a positional rare-token index.

Notices of known licenses are templates. Their words are indexed by position; how rare a word is follows from the
documents of the whole corpus that hold it. For each template, a text's rarest few words that the template holds are
looked up, and each hit proposes where the template would start. Where several words agree to within a quarter of the
template's length, its words are sought in order: words may be inserted (numbers of conditions), missing or changed. A
match needs a share of the template's words in their order there and each of its mandatory phrases near them.
The base phrases are templates of their own that must stand word for word; every place counts.

Words are runs of digits, a-z (A-Z in lower case) and all characters beyond ASCII. Texts are read whole. Null and empty
texts have no words and score 0. Rows that repeat are scanned alike; other columns are kept. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from pagelib.llm.common import query, table

# Phrases and labels of the base scan.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Opening words of well-known license notices, with the phrases that must stand in them.
TEMPLATES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation "
            "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
            ["free of charge", "without restriction"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies",
            ["with or without fee"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met redistributions of source code must retain the above copyright notice this "
            "list of conditions and the following disclaimer", ["source and binary forms"]),
    "apache": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance "
               "with the license you may obtain a copy of the license at", ["apache license"]),
    "gpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation", ["gnu general public license"]),
    "lgpl": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
             "general public license as published by the free software foundation", ["lesser general public license"]),
    "agpl": ("under the terms of the gnu affero general public license as published by the free software foundation",
             ["affero general public license"]),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was "
            "not distributed with this file you can obtain one at", ["mozilla public license"]),
    "unlicense": ("this is free and unencumbered software released into the public domain anyone is free to copy modify "
                  "publish use compile sell or distribute this software", ["public domain"]),
    "cc-by-nc": ("licensed under cc by nc 4 0", ["cc by nc"]),
    "cc-by-sa": ("licensed under cc by sa 4 0", ["cc by sa"]),
    "cc0": ("has waived all copyright and related or neighboring rights to this work cc0 public domain dedication", ["cc0"]),
}
RARE_WORDS = 8       # of a text, looked up for each template
LEAST_AGREE = 2      # looked-up words that must propose starts close to each other
LEAST_COVER = 0.75   # share of a template's words found in their order
SLACK = 4            # starts may differ by one part in so many of a template's words

_kept = frozenset(range(0x30, 0x3A)) | frozenset(range(0x61, 0x7B)) | frozenset(range(0x80, 0x100))
FOLD = bytes(b if b in _kept else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Index:
    """Template words by position, weighted by how rare they are."""

    def __init__(self, rarity: dict[str, float], templates=TEMPLATES):
        self.words = {name: t.encode().split() for name, (t, _) in templates.items()}
        self.phrases = {name: [b" " + p.encode() + b" " for p in ps] for name, (_, ps) in templates.items()}
        self.rarity = {w: rarity.get(w.decode(), math.inf) for ws in self.words.values() for w in ws}
        self.postings: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        for name, ws in self.words.items():
            for i, w in enumerate(ws):
                self.postings[w].append((name, i))
        self.vocabulary = frozenset(self.postings)
        self.masks: dict[str, dict[bytes, int]] = {name: defaultdict(int) for name in self.words}
        for name, ws in self.words.items():
            for i, w in enumerate(ws):
                self.masks[name][w] |= 1 << i

    def in_order(self, name: str, window: list[bytes]) -> int:
        """Length of the longest common subsequence of a template and `window`, a bit for each template word."""
        masks, every = self.masks[name], (1 << len(self.words[name])) - 1
        left = every
        for w in window:
            if w in masks and (u := left & masks[w]):
                left = ((left + u) | (left - u)) & every
        return len(self.words[name]) - left.bit_count()

    def matches(self, words: list[bytes]) -> dict[str, float]:
        """Label -> best share of its template's words found at one place."""
        held = self.vocabulary.intersection(words)
        by_template: dict[str, list[bytes]] = defaultdict(list)
        for w in sorted(held, key=lambda w: (-self.rarity[w], w)):
            for name in {n for n, _ in self.postings[w]}:
                by_template[name].append(w)
        # A template can only match where enough of its distinct words stand.
        by_template = {n: ws for n, ws in by_template.items() if len(ws) >= LEAST_COVER * len(set(self.words[n]))}
        if not by_template:
            return {}
        wanted = {w for ws in by_template.values() for w in ws[:RARE_WORDS]}
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in wanted:
                places[w].append(i)
        out = {}
        for name, ws in by_template.items():
            starts = Counter(p - i for w in ws[:RARE_WORDS] for n, i in self.postings[w] if n == name for p in places[w])
            n, best = len(self.words[name]), 0.0
            slack, places_of = n // SLACK, sorted(starts)
            agree, after = 0, 0      # hits from this start to `slack` words on
            for start in places_of:
                while after < len(places_of) and places_of[after] <= start + slack:
                    agree += starts[places_of[after]]
                    after += 1
                if agree >= LEAST_AGREE:
                    cover = self.in_order(name, words[max(start - slack, 0):max(start + n + slack, 0)]) / n
                    if cover >= LEAST_COVER and cover > best:
                        near = b" " + b" ".join(words[max(0, start - slack - 4):max(start + n + slack + 4, 0)]) + b" "
                        if all(p in near for p in self.phrases[name]):
                            best = cover
                agree -= starts[start]
            if best:
                out[name] = best
        return out


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(word number, label) of every place of a base phrase."""
    line = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in BASE.items():
        sought, at, seen, counted = b" " + phrase.encode() + b" ", -1, 0, 0
        while (at := line.find(sought, at + 1)) >= 0:
            counted += line.count(b" ", seen, at)
            seen = at
            out.append((counted, label))
    return out


def held_words(vocabulary: list[str]):
    """How many texts of a task hold each word of the templates."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought, n, held = frozenset(w.encode() for w in vocabulary), 0, Counter()
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                n += 1
                held.update(sought.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([""] + [w.decode() for w in held]), pa.array([n, *held.values()], pa.int64())],
                                         names=["word", "n"])

    return count


def rarity_of(docs: DataFrame, templates=TEMPLATES) -> dict[str, float]:
    """Inverse document frequency over all of `docs` of each word that a template holds; only these are collected."""
    vocabulary = sorted({w for t, _ in templates.values() for w in t.split()})
    rows = docs.select("text").mapInArrow(held_words(vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"]: r["n"] for r in rows}
    total = n.pop("", 0)
    return {w: math.log((total + 1) / (n.get(w, 0) + 1)) for w in vocabulary}


SCAN = StructType([StructField("n_words", LongType()), StructField("n_base", LongType()), StructField("first_word", LongType()),
                   StructField("last_word", LongType()), StructField("base_labels", StringType()),
                   StructField("labels", StringType()), StructField("score", DoubleType())])


def scan_text(index: Index, text: str | None):
    words = words_of(text.encode("utf-8", "surrogatepass") if text else None)
    base = base_places(words)
    found = index.matches(words)
    own = {label for _, label in base}
    places = [p for p, _ in base]
    return (len(words), len(base), min(places) if base else None, max(places) if base else None, ",".join(sorted(own)),
            ",".join(sorted(own | found.keys())), 1.0 if base else max(found.values(), default=0.0))


def scanner(rarity: dict[str, float], templates=TEMPLATES):
    @pandas_udf(SCAN)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = Index(rarity, templates)
        for texts in batches:
            rows = [scan_text(index, t) for t in texts]
            n, k, first, last, base, labels, score = zip(*rows) if rows else [()] * 7
            yield pd.DataFrame({"n_words": pd.Series(n, dtype="int64"), "n_base": pd.Series(k, dtype="int64"),
                                "first_word": pd.Series(first, dtype="Int64"), "last_word": pd.Series(last, dtype="Int64"),
                                "base_labels": pd.Series(base, dtype=object), "labels": pd.Series(labels, dtype=object),
                                "score": pd.Series(score, dtype="float64")})

    return scan


def with_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """`docs` with n_words, n_base, first_word, last_word, base_labels, labels and score; these names are replaced."""
    scanned = docs.withColumn("__scan", scanner(rarity_of(docs, templates), templates)(F.col("text")))
    return scanned.withColumns({f.name: F.col(f"__scan.{f.name}") for f in SCAN.fields}).drop("__scan")


@query("op2_licenses")
def op2_licenses(spark, folder):
    return with_licenses(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
