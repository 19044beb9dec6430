"""Licence scans with a positional rare-token index.

Index: for each file, the places of the words that any template holds. Search: the rarest of these words in the corpus
(by document frequency over all files) name, through the templates' postings, the places where a template could start;
the other postings are intersected at their relative positions; a template counts if the places found carry enough of
its weight and its mandatory phrase stands there word for word.
"""
from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.common import rows_mapped, stored, texts_of

# Base phrases and their labels.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

# Short passages of public licence texts; label, passage, mandatory phrase.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("artistic-2.0", "the artistic license 2 0", "artistic license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that",
     "redistribution and use in source and binary forms"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "released under the cc0 1 0 universal public domain dedication", "public domain dedication"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted", "permission to use copy modify"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     "permission is hereby granted free of charge"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
]

RAREST = 4
COVERAGE = 0.6
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or bytes([b]).lower() in [_KEEP[i:i + 1] for i in range(36)]
                   else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs of 0-9, a-z and characters above 127."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Index:
    """Templates and base phrases as word numbers, with postings (word -> template, position)."""

    def __init__(self, templates=None, base=None):
        self.base = [(label, p.split()) for label, p in sorted((base or BASE).items())]
        self.templates = [(label, p.split(), must.split()) for label, p, must in (templates or TEMPLATES)]
        every = [p for _, p in self.base] + [p for _, p, _ in self.templates] + [m for _, _, m in self.templates]
        self.number = {w.encode(): i for i, w in enumerate(sorted({w for p in every for w in p}))}
        code = {w.decode(): i for w, i in self.number.items()}
        self.base = [(label, [code[w] for w in p]) for label, p in self.base]
        self.templates = [(label, [code[w] for w in p], [code[w] for w in m]) for label, p, m in self.templates]

    def weigh(self, frequency: dict[int, int], files: int) -> "Search":
        return Search(self, [math.log((files + 1) / (frequency.get(i, 0) + 0.5)) for i in range(len(self.number))])


class Search:
    def __init__(self, index: Index, idf: list[float]):
        self.index, self.idf = index, idf
        rarest = lambda p: max(range(len(p)), key=lambda j: (idf[p[j]], -j))
        self.base = [(label, p, rarest(p)) for label, p in index.base]
        self.full = [sum(idf[w] for w in p) for _, p, _ in index.templates]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, (_, p, _) in enumerate(index.templates):
            for j in sorted(range(len(p)), key=lambda j: (-idf[p[j]], j))[:RAREST]:
                self.postings.setdefault(p[j], []).append((t, j))

    def places(self, positions: list[int], words: list[int]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """(start, label) of every base phrase; for each template label found, its best coverage."""
        at = dict(zip(positions, words))
        where: dict[int, list[int]] = {}
        for p, w in zip(positions, words):
            where.setdefault(w, []).append(p)
        found = []
        for label, phrase, j in self.base:
            for p in where.get(phrase[j], ()):
                if all(at.get(p - j + k) == w for k, w in enumerate(phrase)):
                    found.append((p - j, label))
        here = sorted((w for w in where if w in self.postings), key=lambda w: (-self.idf[w], w))
        best: dict[str, float] = {}
        tried: set[tuple[int, int]] = set()
        for w in here:
            for t, j in self.postings[w]:
                label, phrase, must = self.index.templates[t]
                for p in where[w]:
                    start = p - j
                    if (t, start) in tried:
                        continue
                    tried.add((t, start))
                    cover = sum(self.idf[v] for k, v in enumerate(phrase) if at.get(start + k) == v) / self.full[t]
                    if cover < COVERAGE or cover <= best.get(label, 0.0):
                        continue
                    if any(all(at.get(start + s + k) == v for k, v in enumerate(must)) for s in range(len(phrase))):
                        best[label] = min(1.0, cover)
        return found, best


def positional_index(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, n_words, positions, words): where each file has a word of any template; files without one have []."""
    number = index.number

    def one(_, doc_id, text):
        words = words_of(text)
        hits = [(i, w) for i, w in enumerate(words) if w in number]
        return doc_id, len(words), [i for i, _ in hits], [number[w] for _, w in hits]
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("positions", pa.list_(pa.int32())),
                        ("words", pa.list_(pa.int16()))])
    return texts_of(docs).mapInArrow(rows_mapped(schema, one, ["doc_id", "text"]),
                                     "doc_id long, n_words long, positions array<int>, words array<smallint>")


def scanned(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for each row of ``docs``.

    n_base counts all places of base phrases, first_word and last_word are the smallest and largest start (null without
    one). base_labels and labels are distinct, sorted and joined by commas, '' if none; labels has the base ones too.
    score: the largest coverage of a template found, 1 if only base phrases are found, 0 if nothing is. Null and empty
    texts have no words. Repeated rows stay; a null id stays null; other columns are not read. Word frequencies are
    counted over all rows; the driver sees one number for each word of the templates.
    """
    index = index or Index()
    places = stored(positional_index(docs, index), "licence-index")
    counted = (places.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").count().collect())
    search = index.weigh({r["w"]: r["count"] for r in counted}, places.count())

    def one(_, doc_id, n_words, positions, words):
        found, best = search.places(positions, words)
        starts = [p for p, _ in found]
        base = sorted({label for _, label in found})
        score = max(best.values(), default=1.0 if found else 0.0)
        return (doc_id, n_words, len(found), min(starts, default=None), max(starts, default=None), ",".join(base),
                ",".join(sorted({*base, *best})), float(score))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()),
                        ("score", pa.float64())])
    return places.mapInArrow(rows_mapped(schema, one, ["doc_id", "n_words", "positions", "words"]),
                             "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                             "base_labels string, labels string, score double")
