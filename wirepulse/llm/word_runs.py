"""Runs of periodically repeated words: recompression, and extensions read off its grammar.

A text's words are compressed in rounds. A block round gives every stretch of one symbol a
symbol of its own, a pair round every two neighbours of which the first is on the left side
and the second on the right one of a division of all symbols. Equal stretches are so cut
alike but for their ends, and how far two places of a text agree is found by climbing from
symbol to symbol while they are equal, and going down where they differ.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirepulse.llm.text import map_texts

#: A run is at least so many words long, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Places looked at together, which bounds the memory of texts that repeat everywhere.
PLACES = 1 << 17

RUNS = "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed binary"


@dataclass
class Round:
    """The symbols that a round compresses, and where they stand in the next one.

    ``up`` is the next round's symbol that begins with this one, or -1; ``down`` is the first
    symbol here of each of the next round. A block round has for each symbol its block's
    ``first`` symbol and the one ``after`` it.
    """

    symbols: np.ndarray
    up: np.ndarray
    down: np.ndarray
    first: np.ndarray | None = None
    after: np.ndarray | None = None

    def step(self, a: np.ndarray, b: np.ndarray, onward: bool) -> np.ndarray | int:
        """How many symbols can be passed at once from equal symbols after (before) ``a`` and ``b``."""
        if self.first is None:
            return 1
        if onward:
            return np.minimum(self.after[a] - a, self.after[b] - b)
        return np.minimum(a - self.first[a - 1], b - self.first[b - 1])


def _repeating(symbols: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """The symbols of texts that hold one of theirs twice."""
    key = np.sort(owners * (int(symbols.max()) + 1) + symbols)
    twice = key[1:][key[1:] == key[:-1]] // (int(symbols.max()) + 1)
    held = np.zeros(int(owners[-1]) + 1, bool)
    held[twice] = True
    return np.flatnonzero(held[owners])


def _side(symbols: np.ndarray, turn: int) -> np.ndarray:
    mixed = (symbols.astype(np.uint64) + np.uint64(turn * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63) == 1


def _named(key: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
    """A new symbol for each distinct key."""
    names, which = np.unique(key, return_inverse=True)
    return which + fresh, fresh + len(names)


def recompress(symbols: np.ndarray, owners: np.ndarray) -> list[Round]:
    """The rounds of some texts put one after the other, each ended by a symbol of its own.

    A text goes on until none of its symbols repeats: more rounds would not make two
    places of it agree.
    """
    fresh = int(symbols.max()) + 1 if len(symbols) else 0
    rounds: list[Round] = []
    turn = 0
    while len(symbols):
        kept = _repeating(symbols, owners)
        now, owner = symbols[kept], owners[kept]
        if not len(now):
            break
        joined = np.zeros(len(now), bool)
        joined[1:] = now[1:] == now[:-1]
        blocks = bool(joined.any())
        while not joined.any():
            turn += 1
            right = _side(now, turn)
            inner = np.append(owner[1:] == owner[:-1], False)
            pairs = [inner[:-1] & inner[1:] & (right[:-1] == side) & (right[1:] != side) for side in (False, True)]
            joined[1:] = max(pairs, key=np.count_nonzero)
        starts = np.flatnonzero(~joined)
        size = np.diff(np.append(starts, len(now)))
        merged = size > 1
        following = now[starts].copy()
        second = size[merged] if blocks else now[starts[merged] + 1]
        following[merged], fresh = _named(following[merged] * (int(second.max()) + 1) + second, fresh)
        up = np.full(len(symbols), -1, np.int64)
        up[kept[starts]] = np.arange(len(starts))
        this = Round(symbols, up, kept[starts])
        if blocks:
            this.first, this.after = np.arange(len(symbols)), np.arange(1, len(symbols) + 1)
            this.first[kept] = np.repeat(kept[starts], size)
            this.after[kept] = this.first[kept] + np.repeat(size, size)
        rounds.append(this)
        symbols, owners = following, owner[starts]
    rounds.append(Round(symbols, np.full(len(symbols), -1, np.int64), np.zeros(0, np.int64)))
    return rounds


def agreeing(rounds: list[Round], one: np.ndarray, other: np.ndarray, onward: bool) -> np.ndarray:
    """How many symbols are equal from two places on, or before them; the places differ."""
    sign, at = (1, 0) if onward else (-1, -1)
    x, y = one.copy(), other.copy()
    height = np.zeros(len(x), np.int64)
    climbing = np.arange(len(x))
    for h, level in enumerate(rounds):
        todo, risen = climbing, []
        while len(todo):
            a, b = x[todo], y[todo]
            ready = (level.up[a] >= 0) & (level.up[b] >= 0)
            risen.append(todo[ready])
            same = ~ready & (level.symbols[a + at] == level.symbols[b + at])
            height[todo[~ready & ~same]] = h
            todo, a, b = todo[same], a[same], b[same]
            step = sign * level.step(a, b, onward)
            x[todo], y[todo] = a + step, b + step
        if not risen or not len(climbing := np.concatenate(risen)):
            break
        x[climbing], y[climbing] = level.up[x[climbing]], level.up[y[climbing]]
    for h in range(int(height.max(initial=0)) - 1, -1, -1):
        level = rounds[h]
        todo = np.flatnonzero(height > h)
        x[todo], y[todo] = level.down[x[todo]], level.down[y[todo]]
        while len(todo):
            a, b = x[todo], y[todo]
            same = level.symbols[a + at] == level.symbols[b + at]
            todo, a, b = todo[same], a[same], b[same]
            step = sign * level.step(a, b, onward)
            x[todo], y[todo] = a + step, b + step
    return sign * (x - one)


def _grid(symbols: np.ndarray, owners: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods at which a run may be met, in slices; texts stand in order of falling size.

    In a run of period ``q`` at least ``3 q`` places in a row equal the one ``q`` later, so
    one of them is a multiple of ``3 q``: over all periods that makes a harmonic series.
    """
    ends = np.cumsum(sizes + 1)
    places, periods, held = [], [], 0
    for q in range(1, int(sizes[0]) // LEAST_PERIODS + 1):
        long = int(np.searchsorted(-sizes, -LEAST_PERIODS * q, side="right"))
        at = np.arange(0, ends[long - 1] - q, (LEAST_PERIODS - 1) * q)
        at = at[(symbols[at] == symbols[at + q]) & (owners[at] == owners[at + q])]
        places.append(at)
        periods.append(np.full(len(at), q))
        held += len(at)
        if held > PLACES:
            yield np.concatenate(places), np.concatenate(periods)
            places, periods, held = [], [], 0
    if held:
        yield np.concatenate(places), np.concatenate(periods)


def find_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """``start, length, period`` rows of each list of word numbers, by start, then period.

    A stretch that a smaller period explains too is met at that period with the same ends.
    """
    by = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    sizes = np.array([len(texts[k]) for k in by], np.int64)
    out = [np.zeros((0, 3), np.int64) for _ in texts]
    if not len(by) or sizes[0] < LEAST_WORDS:
        return out
    top = max(int(t.max()) for t in texts if len(t)) + 1
    symbols = np.concatenate([part for k, of in enumerate(by) for part in (texts[of], [top + k])])
    owners = np.repeat(np.arange(len(by)), sizes + 1)
    rounds = recompress(symbols, owners)
    found = [np.zeros((0, 3), np.int64)]
    for place, period in _grid(symbols, owners, sizes):
        onward = agreeing(rounds, place, place + period, True)
        before = agreeing(rounds, place, place + period, False)
        length = before + onward + period
        good = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        rows = np.stack([(place - before)[good], length[good], period[good]], axis=1)
        found.append(_smallest(rows))
    rows = _smallest(np.concatenate(found))
    starts = np.cumsum(sizes + 1) - sizes - 1
    owner = owners[rows[:, 0]]
    rows[:, 0] -= starts[owner]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0], owner))]
    cuts = np.searchsorted(np.sort(owner), np.arange(len(by) + 1))
    for k, of in enumerate(by):
        out[of] = rows[cuts[k]:cuts[k + 1]]
    return out


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of rows with the same ends the one with the smallest period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    again = np.zeros(len(rows), bool)
    again[1:] = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
    return rows[~again]


def _rows(ids: pa.Array, texts: list[bytes]) -> dict[str, object]:
    number: dict[bytes, int] = defaultdict(count().__next__)
    words = [text.split() for text in texts]
    found = find_runs([np.array([number[w] for w in listed], np.int64) for listed in words])
    collapsed = []
    for listed, rows in zip(words, found, strict=True):
        if len(rows):
            change = np.zeros(len(listed) + 1, np.int64)
            np.add.at(change, rows[:, 0] + rows[:, 2], 1)
            np.add.at(change, rows[:, 0] + rows[:, 1], -1)
            listed = [listed[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
        collapsed.append(b" ".join(listed))
    offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
    flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    starts, lengths, periods = (pa.ListArray.from_arrays(offsets, pa.array(flat[:, k])) for k in range(3))
    return {
        "doc_id": ids, "n_words": list(map(len, words)), "starts": starts, "lengths": lengths, "periods": periods,
        "collapsed": collapsed,
    }


def word_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every document; nothing is shuffled.

    A run is a stretch of words with smallest period ``q``, at least ``LEAST_WORDS`` long and
    ``LEAST_PERIODS`` times ``q``, that no neighbouring word extends. ``runs`` lists ``start,
    length, period`` by start, then period; ``collapsed`` joins the words that no run
    repeats (those after its first ``q``) by single spaces.

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``; rows are
    taken one by one, so repeated rows and ids are kept; an empty table gives an empty
    result; columns other than ``doc_id`` and ``text`` are not read.
    """
    rows = map_texts(docs, _rows, RUNS)
    runs = F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length"), F.col("periods").alias("period"))
    named = "array<struct<start:bigint,length:bigint,period:bigint>>"
    return rows.select("doc_id", "n_words", runs.cast(named).alias("runs"), F.col("collapsed").cast("string").alias("collapsed"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where the text of every tenth document, by a checksum of its id, ends periodically.

    With ``h`` the id's crc32, ``g = h div 10`` and ``n`` words, words from ``a = g % n`` on
    repeat the first ``1 + (n - a) div (3 + g % 8)`` of them. A null id plants nothing.
    """
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    planted = (
        docs.select("doc_id", "text", (checksum % 10 == 0).alias("_chosen"), F.floor(checksum / 10).alias("_g"))
        .withColumn("_words", F.when(F.col("_chosen"), words))
        .withColumn("_n", F.size("_words"))
        .withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
        .withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + _g % 8) AS int)"))
    )
    text = F.expr("""
        concat_ws(' ', slice(_words, 1, _a),
          slice(flatten(array_repeat(slice(_words, _a + 1, _p), cast((_n - _a) div _p + 1 AS int))), 1, _n - _a))""")
    return planted.select("doc_id", F.when(F.col("_chosen") & (F.col("_n") > 0), text).otherwise(F.col("text")).alias("text"))


def _hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def run_report(docs: DataFrame) -> DataFrame:
    """One row per document: its number of runs, the longest one, and digests of all and of what is left."""
    longest = F.expr("array_max(transform(runs, r -> named_struct('length', r.length, 'back', -r.start, 'less', -r.period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    found = word_runs(docs).withColumn("_longest", longest)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_longest.back")).alias("start"), "_longest.length", (-F.col("_longest.less")).alias("period"),
        F.expr("1000 * _longest.length div -_longest.less").alias("exponent_milli"),
        _hex(listed).alias("runs_sha256"), _hex(F.col("collapsed")).alias("collapsed_sha256"), "n_words",
    )


ORACLE_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(
      [4294967295::UBIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0])),
      lambda crc, x: CASE WHEN xor(crc, x) & 1 = 1 THEN xor(xor(crc, x) >> 1, 3988292384::UBIGINT) ELSE xor(crc, x) >> 1 END
    ), 4294967295::UBIGINT)::BIGINT END AS h
  FROM documents
), chosen AS (
  SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a FROM texts
), planted AS (
  SELECT no, doc_id, n, CASE WHEN a IS NULL THEN words
    ELSE list_transform(range(0, n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) END AS words
  FROM chosen
), tokens AS (
  SELECT no, n, unnest(words) AS word, unnest(range(0, n)) AS i FROM planted
), equal_pairs AS (
  SELECT one.no, one.i, other.i - one.i AS q
  FROM tokens one JOIN tokens other ON one.no = other.no AND one.word = other.word AND other.i > one.i AND other.i - one.i <= one.n // 4
), stretches AS (
  SELECT no, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY no, q ORDER BY i) AS island FROM equal_pairs) GROUP BY no, q, island
), runs AS (
  SELECT no, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY no, start, length
), listed AS (
  SELECT no, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listing,
    first({'start': start, 'length': length, 'period': period} ORDER BY length DESC, start, period) AS longest
  FROM runs GROUP BY no
), dropped AS (
  SELECT DISTINCT no, unnest(range(start + period, start + length)) AS i FROM runs
), collapsed AS (
  SELECT no, string_agg(word, ' ' ORDER BY i) AS text FROM tokens ANTI JOIN dropped USING (no, i) GROUP BY no
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, longest.start::BIGINT AS start, longest.length::BIGINT AS length,
  longest.period::BIGINT AS period, (1000 * longest.length // longest.period)::BIGINT AS exponent_milli,
  sha256(coalesce(listing, '')) AS runs_sha256, sha256(coalesce(collapsed.text, '')) AS collapsed_sha256, n::BIGINT AS n_words
FROM planted LEFT JOIN listed USING (no) LEFT JOIN collapsed USING (no)
"""
