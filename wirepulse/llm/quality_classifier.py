"""Quality scores from boosted trees over document statistics."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirepulse.llm.boosted_trees import Trees, fit
from wirepulse.llm.text import map_texts

#: Labelled rows that the trees are fitted on, at most: those with the smallest hash of id.
SAMPLE_ROWS = 20_000
#: Documents with this remainder of crc32(id) mod 4 are held out: their labels are not read.
HELD_OUT, PARTS = 2, 4
GOOD = 0.7

_STOP = {
    "the", "of", "and", "to", "in", "is", "that", "it", "on", "with", "der", "die", "und", "das", "den", "mit", "von",
    "de", "la", "el", "que", "los", "en", "le", "les", "des", "et", "du", "un",
}
_STOP_WORDS = frozenset(word.encode() for word in _STOP)
_UPPER, _LOWER = slice(65, 91), slice(97, 123)
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_MARKS = [ord(c) for c in "!?.,;:"]

FEATURES = (
    "log_words", "log_bytes", "word_length", "upper", "digits", "symbols", "marks", "shouts", "bars", "high_bytes", "blanks",
    "lines_per_word", "line_length", "repeated_lines", "distinct_words", "commonest_word", "distinct_pairs", "stop_words",
    "longest_word", "entropy", "ends_in_mark", "at_signs", "first_upper",
)


def statistics(text: bytes) -> list[float]:
    """The features of a text; all are finite, for empty texts too."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(1, len(text))
    words = text.split()
    n = len(words)
    some = max(1, n)
    held = Counter(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    share = counts[counts > 0] / size
    letters = max(1, int(counts[_UPPER].sum() + counts[_LOWER].sum()))
    return [
        np.log1p(n), np.log1p(len(text)), sum(map(len, words)) / some, counts[_UPPER].sum() / letters,
        counts[48:58].sum() / size, counts[_SYMBOLS].sum() / size, counts[_MARKS].sum() / size, counts[33] / some,
        counts[124] / some, counts[128:].sum() / size, (size - sum(map(len, words))) / size, len(lines) / some,
        n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), len(held) / some,
        max(held.values(), default=0) / some, len(set(zip(words, words[1:], strict=False))) / some,
        sum(held[word] for word in _STOP_WORDS if word in held) / some, max(map(len, held), default=0),
        float(-(share * np.log2(share)).sum()), sum(line.rstrip()[-1:] in b".!?" for line in lines) / max(1, len(lines)),
        counts[64] / some, sum(word[:1].isupper() for word in words) / some,
    ]


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(text) for text in texts], np.float64).reshape(len(texts), len(FEATURES))


def remainder(doc_id: object) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % PARTS


def _remainder(column: str) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % PARTS


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``limit`` labelled ids that are not held out.

    The limit bounds what is broadcast and what comes to the driver: an id gives one row
    however often it occurs, with its largest label and its smallest features.
    """
    chosen = (
        labels.where((_remainder("doc_id") != HELD_OUT) & F.col("quality").isin(0, 1))
        .groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    known = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")

    def rows(ids: pa.Array, texts: list[bytes]) -> dict[str, object]:
        return {"doc_id": ids, "x": matrix(texts).tolist()}

    measured = map_texts(known, rows, "doc_id long, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x"))
    table = measured.join(F.broadcast(chosen), "doc_id").select("x", "quality").toArrow()
    x = np.array(table["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return x, np.array(table["quality"].to_pylist(), np.float64)


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS, **settings) -> Trees:
    x, y = training_rows(docs, labels, limit)
    by = np.lexsort((*x.T, y))
    return fit(x[by], y[by], **settings)


def quality_scores(docs: DataFrame, trees: Trees) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    Only the text is looked at. A null or empty text is scored by the statistics of an
    empty text; repeated rows get equal scores; an empty table gives an empty result.
    Without labels the score is 0.5 throughout. A null ``doc_id`` is not held out.
    """

    def rows(ids: pa.Array, texts: list[bytes]) -> dict[str, object]:
        score = trees.score(matrix(texts))
        held = [remainder(doc_id) == HELD_OUT for doc_id in ids.to_pylist()]
        return {"doc_id": ids, "held_out": held, "score": score, "predicted": (score >= GOOD).astype(np.int32)}

    return map_texts(docs, rows, "doc_id long, held_out boolean, score double, predicted int")
