"""License notices: an exact set-similarity join of text blocks with notice templates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirepulse.llm.text import GROUP_BYTES, groups, map_texts, utf8

# Fixed phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Wordings that notices keep, and the labels that the join adds.
TEMPLATES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation": "gpl-notice",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-notice",
    "released under the mit license": "mit-release",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files": "mit-grant",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "this is free and unencumbered software released into the public domain": "unlicense",
}

#: A block holds a template from this share of its distinct words on: 9 / 10.
CONTAINED = (9, 10)
#: Blocks are windows of this many words, each half over the next, so that a notice of up to
#: half as many words stands whole in one of them.
BLOCK_WORDS = 64

_WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double"
)


def words_of(text: bytes) -> list[bytes]:
    """Words of the text with A-Z in lower case; all bytes above ASCII belong to words."""
    return text.translate(_WORD_BYTES).split()


def template_words(templates: dict[str, str] = TEMPLATES) -> set[bytes]:
    return {word for template in templates for word in words_of(template.encode())}


def word_order(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> list[bytes]:
    """The templates' words from rare to frequent, by how many documents of the table hold them.

    Each group of texts sends at most one row per template word, and the result is as long
    as the templates' vocabulary, whatever the table.
    """
    vocabulary = template_words(templates)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            texts = utf8(batch.column(0))
            for a, b in groups(texts, GROUP_BYTES):
                for text in texts[a:b]:
                    for word in vocabulary.intersection(words_of(text)):
                        held[word] += 1
        rows = [(word.decode(), n) for word, n in held.items() if n]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["word", "n"]
        )

    counted = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    seen = {row["word"].encode(): row["n"] for row in counted.collect()}
    return sorted(vocabulary, key=lambda word: (seen.get(word, 0), word))


@dataclass
class Joiner:
    """Templates as ascending word ranks, indexed by the words of their prefixes.

    A block that holds ``needed`` of a template's words holds one of its
    ``size - needed + 1`` rarest words; only these are indexed.
    """

    rank: dict[bytes, int]
    templates: list[tuple[frozenset[int], int, str]]
    prefixes: dict[int, list[tuple[int, int]]]


def build(order: list[bytes], templates: dict[str, str] = TEMPLATES) -> Joiner:
    rank = {word: at for at, word in enumerate(order)}
    listed: list[tuple[frozenset[int], int, str]] = []
    prefixes: dict[int, list[tuple[int, int]]] = {}
    for number, (template, label) in enumerate(templates.items()):
        ranks = sorted({rank[word] for word in words_of(template.encode())})
        needed = -(-CONTAINED[0] * len(ranks) // CONTAINED[1])
        listed.append((frozenset(ranks), needed, label))
        for position, one in enumerate(ranks[:len(ranks) - needed + 1]):
            prefixes.setdefault(one, []).append((number, position))
    return Joiner(rank, listed, prefixes)


def blocks(n_words: int) -> Iterator[tuple[int, int]]:
    half = BLOCK_WORDS // 2
    for start in range(0, max(1, n_words - half), half):
        yield start, min(start + BLOCK_WORDS, n_words)


def matches(joiner: Joiner, words: list[bytes]) -> dict[str, float]:
    """Label of each template that some block holds, with the largest share held."""
    rank = joiner.rank
    ranks = [rank.get(word, -1) for word in words]
    if joiner.prefixes.keys().isdisjoint(ranks):
        return {}
    found: dict[str, float] = {}
    for a, b in blocks(len(words)):
        block = sorted(set(ranks[a:b]) - {-1})
        candidates = set()
        for at, one in enumerate(block):
            for number, position in joiner.prefixes.get(one, ()):
                ranked, needed, _ = joiner.templates[number]
                # Length, then position: what may still follow in both must be enough.
                if len(block) >= needed and 1 + position + min(len(ranked) - position - 1, len(block) - at - 1) >= needed:
                    candidates.add(number)
        for number in candidates:
            ranked, needed, label = joiner.templates[number]
            shared = len(ranked.intersection(block))
            if shared >= needed:
                found[label] = max(found.get(label, 0.0), shared / len(ranked))
    return found


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """Start word and label of each place of a fixed phrase."""
    spaced = b" " + b" ".join(words) + b" "
    places = []
    for phrase, label in PHRASES.items():
        wanted = f" {phrase} ".encode()
        at = spaced.find(wanted)
        counted, n = 0, 0
        while at >= 0:
            n += spaced.count(b" ", counted, at)
            counted = at
            places.append((n, label))
            at = spaced.find(wanted, at + 1)
    return places


def _scanner(joiner: Joiner):
    def rows(ids: pa.Array, texts: list[bytes]) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name in SCHEMA.replace(",", "").split()[2::2]}
        for text in texts:
            words = words_of(text)
            places = phrase_places(words)
            joined = matches(joiner, words)
            base = {label for _, label in places}
            out["n_words"].append(len(words))
            out["n_base"].append(len(places))
            out["first_word"].append(min(places)[0] if places else None)
            out["last_word"].append(max(places)[0] if places else None)
            out["base_labels"].append(",".join(sorted(base)))
            out["labels"].append(",".join(sorted(base | joined.keys())))
            out["score"].append(1.0 if places else max(joined.values(), default=0.0))
        return {"doc_id": ids, **out}

    return rows


def license_report(docs: DataFrame) -> DataFrame:
    """One row per document: places of the fixed phrases, and the labels of both ways.

    The score is 1 with a fixed phrase, else the largest share of a template that a block
    holds, 0 if none holds enough. Null or empty texts have no words; repeated rows are
    read one by one; an empty table gives an empty result; columns other than ``doc_id``
    and ``text`` are not read. The texts are read twice: once for the word order, and once
    for the join with the templates, which are a fixed list and travel with the tasks.
    """
    joiner = build(word_order(docs))
    return map_texts(docs, _scanner(joiner), SCHEMA)
