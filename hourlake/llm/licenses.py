"""Licence scan over a positional index of the rare words of licence templates."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hourlake.llm.common import map_texts, texts_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases that are found wherever their words stand consecutively, with their labels (fixed values).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: label, template, key phrases that must stand at their place; more wording around them may differ.
TEMPLATES = [
    ("gpl-3", "licensed under the gnu general public license version 3", ["general public license", "version 3"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["general public license", "version 2"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license", "version 2"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ["permission is hereby granted", "free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use", "source and binary forms"]),
    ("mpl", "subject to the terms of the mozilla public license", ["mozilla public license"]),
    ("epl", "made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike license", ["creative commons attribution sharealike"]),
    ("cc-by", "this work is licensed under a creative commons attribution license", ["creative commons attribution"]),
    ("cc0", "released into the public domain under creative commons zero", ["creative commons zero"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("isc", "permission to use copy modify and or distribute this software", ["permission to use copy modify"]),
]


def words_of(text: str) -> list[str]:
    """Words with A-Z lower-cased."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


class Index:
    """Postings of the templates' words, and of each the words that files are looked up by.

    A base phrase is a template all of whose words are its key phrase. ``keys`` are the ``rare`` words
    of highest IDF of each template; every place of a base phrase holds its rarest one.
    """

    def __init__(self, templates: list, base: dict[str, str], frequency: dict[str, int], n_docs: int, rare: int = 3):
        self.rows = [(label, t.split(), [p.split() for p in phrases], False) for label, t, phrases in templates]
        self.rows += [(label, p.split(), [p.split()], True) for p, label in base.items()]
        self.idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) + 1 for _, ws, _, _ in self.rows for w in ws}
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.keys: set[str] = set()
        self.full = []
        for n, (_, ws, phrases, is_base) in enumerate(self.rows):
            for i, w in enumerate(ws):
                self.postings[w].append((n, i))
            musts = {w for p in phrases for w in p}
            self.keys |= set(sorted(musts, key=lambda w: (-self.idf[w], w))[: 1 if is_base else rare])
            self.full.append(sum(self.idf[w] for w in ws))

    def scan(self, words: list[str], coverage: float) -> tuple[dict[int, list[int]], list[tuple[str, float]]]:
        """Starts of each base phrase, and (label, share of the template's weight) of verified templates."""
        base: dict[int, list[int]] = defaultdict(list)
        found: list[tuple[str, float]] = []
        rare = self.keys.intersection(words)
        if not rare:
            return base, found
        anchors = [(p, w) for p, w in enumerate(words) if w in rare]
        # Where a template would begin in the file: the difference of a word's two positions.
        starts = {(n, p - i) for p, w in anchors for n, i in self.postings[w]}
        for n, at in starts:
            label, ws, phrases, is_base = self.rows[n]
            if is_base:
                if at >= 0 and words[at : at + len(ws)] == ws:
                    base[n].append(at)
                continue
            hits = [at + i for i, w in enumerate(ws) if 0 <= at + i < len(words) and words[at + i] == w]
            share = sum(self.idf[words[p]] for p in hits) / self.full[n]
            low, high = max(0, at), at + len(ws)
            if share >= coverage and all(_holds(words, p, low, high) for p in phrases):
                found.append((label, share))
        return base, found


def _holds(words: list[str], phrase: list[str], low: int, high: int) -> bool:
    """Whether the phrase's words stand consecutively within the aligned part."""
    return any(words[i : i + len(phrase)] == phrase for i in range(low, min(high, len(words)) - len(phrase) + 1))


def license_words(docs: DataFrame, words: set[str], text: str = "text") -> tuple[dict[str, int], int]:
    """In how many documents each word of the templates stands, and the number of documents.

    Tasks send one row per word of the templates, so what comes to the driver has a fixed bound.
    """

    def make():
        def step(part: pa.RecordBatch) -> dict:
            seen: Counter[str] = Counter()
            for t in texts_of(part, text):
                seen.update(words.intersection(words_of(t)))
            seen[""] = part.num_rows
            return {"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())}

        return step

    rows = map_texts(docs.select(text), make, "word string, n bigint", text).groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    return found, found.pop("", 0)


def license_scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    templates: list = TEMPLATES,
    base: dict[str, str] = BASE,
    coverage: float = 0.6,
    rare: int = 3,
) -> DataFrame:
    """Licences of every whole text: ``key``, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The rarest words of a text that licences use (by their frequency over all documents) are looked up in
    the templates' postings. Postings that agree on where the template begins are one alignment; it counts
    if the aligned words have at least ``coverage`` of the template's IDF weight and its key phrases stand
    in the aligned part. A base phrase counts at every place where its words stand consecutively.
    score: the largest share, 1 for a base phrase, 0 if nothing is found. Null and empty texts have no
    words and no finds; repeated rows are scanned each; other columns are ignored.
    """
    vocabulary = {w for _, t, _ in templates for w in t.split()} | {w for p in base for w in p.split()}
    frequency, n_docs = license_words(docs, vocabulary, text)

    def make():
        index = Index(templates, base, frequency, n_docs, rare)

        def step(part: pa.RecordBatch) -> dict:
            rows = []
            for t in texts_of(part, text):
                words = words_of(t)
                places, found = index.scan(words, coverage)
                starts = [p for ps in places.values() for p in ps]
                own = {index.rows[n][0] for n in places}
                score = 1.0 if starts else max((s for _, s in found), default=0.0)
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x for x, _ in found})), min(score, 1.0)))
            out = dict(zip(NAMES, zip(*rows, strict=True), strict=True))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            return {key: part.column(key)} | {n: pa.array(out[n], k) for n, k in zip(NAMES, kinds, strict=True)}

        return step

    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return map_texts(docs.select(key, text), make, schema, text)


NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
