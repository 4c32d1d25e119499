"""Token ids as files: documents in order of id, encoded in blocks, and read back.

A token table is a folder of Parquet files. Each row is one block of ``range_coder`` (own
magic, length and checksum) with the ids and lengths of its documents; ``part`` and
``block`` give its place. Spark's writer makes the files, so a lost executor leaves no
half-written table, and any store that Spark reaches will do.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirepulse.llm import range_coder
from wirepulse.llm.text import arrow_schema, slices
from wirepulse.session import scratch_path

END = 0
SPECIAL = "<|endoftext|>"

#: A block is complete from so many ids on; texts are encoded in slices of so many bytes.
BLOCK_IDS = 1 << 21
SLICE_BYTES = 4 << 20
#: Texts go to the library in lists of so many bytes.
LIBRARY_BYTES = 128 << 10
#: Bytes of words and ids in a worker's memory before it forgets the half not used for longest.
REMEMBERED_BYTES = 24 << 20
#: Pieces that the whole library encodes in one generation of it, and their letters; it keeps two.
PARTS, PARTS_LETTERS = 50_000, 1 << 20
#: What the pre-tokenizer may take a character for, and what an apostrophe may take along.
LETTER, NUMBER, SIGN, SPACE = 1, 2, 3, 4
TAKEN = [ord(letter) for letter in "stmdrvl"]

TABLE = "part long, block long, doc_ids array<long>, lengths array<long>, n_ids long, data binary"
DOCUMENTS = "part long, block long, place long, doc_id long, before long, n_tokens long, ids_crc32 long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _spelling() -> np.ndarray:
    """The letter by which byte-level vocabularies write each byte: printable ones as they are, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = np.zeros(256, "<u4")
    table[shown] = shown
    table[table == 0] = 256 + np.arange(256 - len(shown))
    return table


def _mask(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False).astype(bool)


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large strings, and where each begins in them, with the end."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64, len(texts) + 1, 8 * texts.offset)
    return np.frombuffer(data or b"", np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def _gathered(table: np.ndarray, first: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Stretches of ``held`` values from ``first`` on, one after the other."""
    ends = np.cumsum(held)
    at = np.repeat(first - (ends - held), held)
    at += np.arange(len(at))
    return table[at]


class Words:
    """Ids of words seen before, in Arrow and numpy: Python objects would take several times the room."""

    def __init__(self, limit: int) -> None:
        self.limit, self.turn, self.bytes = limit, 0, 0
        self.names = pa.array([], pa.large_string())
        self.flat, self.sizes, self.used = np.zeros(0, "<u4"), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def ids(self, words: pa.Array, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words one after the other, and how many each has; ``encode`` is asked for new ones."""
        self.turn += 1
        # The words asked for are fewer than those held, so the table to search is made of them.
        found = pc.index_in(self.names, value_set=words)
        held = found.is_valid()
        at = np.full(len(words), -1)
        at[found.filter(held).to_numpy()] = np.flatnonzero(_mask(held))
        fresh = at < 0
        if fresh.any():
            at[fresh] = len(self.names) + np.arange(np.count_nonzero(fresh))
            names = words.filter(pa.array(fresh))
            coded, counts = encode(names)
            self.names = pa.concat_arrays([self.names, names])
            self.flat = np.concatenate([self.flat, coded])
            self.sizes = np.concatenate([self.sizes, counts])
            self.used = np.concatenate([self.used, np.zeros(len(names), np.int32)])
            self.bytes = self.names.nbytes + self.flat.nbytes + self.sizes.nbytes + self.used.nbytes
        self.used[at] = self.turn
        starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        sizes = self.sizes[at].astype(np.int64)
        flat = _gathered(self.flat, starts[at], sizes)
        if self.bytes > self.limit:
            latest = np.argsort(-self.used, kind="stable")
            room = pc.binary_length(self.names).to_numpy() + 4 * self.sizes.astype(np.int64) + 16
            kept = np.sort(latest[np.cumsum(room[latest]) <= self.limit // 2])
            self.names = self.names.take(pa.array(kept))
            self.flat = _gathered(self.flat, starts[kept], self.sizes[kept].astype(np.int64))
            self.sizes, self.used = self.sizes[kept], self.used[kept]
        return flat, sizes


class Encoder:
    """Ids of texts from a byte-level BPE of the tokenizers library.

    Such a vocabulary never joins bytes across a single space between two other
    characters: the space starts a new piece. So texts are cut there, and every distinct
    piece is cut again where the library's own pre-tokenizer cuts: between letters, numbers,
    other signs and white space. What a character counts as is asked of the library once.
    Every distinct word so found goes to the library's BPE model, many at a time; texts are
    put together from the words' ids.
    Pieces with an apostrophe before a letter that it may take along, and all pieces of a
    vocabulary with another pre-tokenizer, are encoded by the whole library. Texts with other
    runs of white space around a space, or with the special token's name, go there uncut.

    Arrow cuts and numbers the pieces and numpy puts the ids together, so Python handles
    only words that are new.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.words = Words(REMEMBERED_BYTES)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.letters = 0
        cuts = self.library.pre_tokenizer
        self.plain = isinstance(cuts, pre_tokenizers.ByteLevel) and cuts.use_regex and not cuts.add_prefix_space and self.library.normalizer is None
        # The model alone, on words that are spelt in the vocabulary's letters for bytes already.
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.spelling = _spelling()
        vocabulary = self.library.get_vocab()
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.widths[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.kinds = np.zeros(0x110000, np.uint8)

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts from the library, a few texts at a time: what it returns takes a hundred times a text's size."""
        out: list[bytes] = []
        for a, b in slices(pa.array(texts, pa.large_string()), LIBRARY_BYTES):
            encoded = self.library.encode_batch_fast(texts[a:b], add_special_tokens=False)
            out += [np.array(one.ids, "<u4").tobytes() for one in encoded]
        return out

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that the pre-tokenizer leaves whole, one after the other, and how many each has."""
        flat, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int32)]
        for a, b in slices(words, LIBRARY_BYTES):
            data, ends = _letters(words.slice(a, b - a))
            spelt = np.insert(self.spelling[data], ends[1:-1], ord("\n")).tobytes().decode("utf-32-le")
            one = self.model.encode_batch_fast([spelt], add_special_tokens=False)[0]
            ids = np.array(one.ids, "<u4")
            reached = np.cumsum(self.widths[ids])
            upto = np.searchsorted(reached, ends[1:], side="right")
            if not np.array_equal(np.append(0, reached)[upto], ends[1:]):
                # A vocabulary without all bytes: its words say what they leave out.
                coded = self._encode(words.slice(a, b - a).to_pylist())
                ids, upto = np.frombuffer(b"".join(coded), "<u4"), np.cumsum([len(one) // 4 for one in coded])
            flat.append(ids)
            counts.append(np.diff(upto, prepend=0).astype(np.int32))
        return np.concatenate(flat), np.concatenate(counts)

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        """What the library's pre-tokenizer takes each code point for."""
        kinds = self.kinds[points]
        fresh = kinds == 0
        if fresh.any():
            cut = self.library.pre_tokenizer.pre_tokenize_str
            for point in np.unique(points[fresh]).tolist():
                self.kinds[point] = next((kind for kind, like in ((LETTER, "a"), (NUMBER, "1"), (SIGN, "!")) if len(cut(like + chr(point))) == 1), SPACE)
            kinds = self.kinds[points]
        return kinds

    def _cut(self, entries: pa.Array, spaced: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The words of entries, of which the first ``spaced`` begin with a space, and the entry each belongs to.

        And of every entry: whether it has white space at an end, beside the space that made
        it, so that the library has to see the text around it; and whether it is one for the
        whole library.
        """
        n = len(entries)
        data, ends = _letters(entries)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        kinds = self._kinds(points)
        first, full = np.searchsorted(at, ends[:-1]), np.diff(ends) > 0
        last = np.searchsorted(at, ends[1:]) - 1
        space = np.append(kinds == SPACE, True)
        blank = full & (space[last] | space[first + (np.arange(n) < spaced)])

        entry = np.repeat(np.arange(n, dtype=np.int32), last + 1 - first)
        begin, tail = np.zeros(len(points), bool), np.zeros(len(points), bool)
        begin[first[full]] = True
        tail[last[full]] = True
        lone = begin & (points == ord(" "))
        begin[1:] |= (kinds[1:] != kinds[:-1]) & ~lone[:-1]
        # Of several white spaces the last one stands alone.
        begin[1:-1] |= space[1:-2] & space[:-3] & ~space[2:-1]
        taken = np.flatnonzero((points[:-1] == ord("'")) & ~tail[:-1])
        known = np.zeros(n, bool)
        known[entry[taken[np.isin(points[taken + 1], TAKEN)]]] = True
        if not self.plain:
            known[:] = full
        cut = np.flatnonzero(begin)
        words = pa.LargeStringArray.from_buffers(len(cut), pa.py_buffer(np.append(at[cut], len(data))), pa.py_buffer(data))
        return words, entry[cut], blank, known

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        cut = pc.split_pattern(texts, " ")
        offsets = cut.offsets.to_numpy()
        starts, lengths = offsets[:-1] - offsets[0], np.diff(offsets)
        numbered = cut.flatten().dictionary_encode()
        names, which = numbered.dictionary, numbered.indices.to_numpy().copy()
        del cut, numbered
        firsts = names.take(pa.array(which[starts]))
        # Entries: pieces with their space, and first pieces, which have none before them.
        which[starts] = len(names) + np.arange(len(texts))
        space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        entries = pa.concat_arrays([pc.binary_join_element_wise(space, names, nothing), firsts])
        n = len(entries)
        words, owner, blank, known = self._cut(entries, len(names))
        odd = blank | (np.append(np.zeros(len(names), np.int32), lengths) > 1) & (pc.binary_length(entries).to_numpy() == 0)
        whole = (np.add.reduceat(odd[which], starts) > 0) | _mask(pc.match_substring(texts, SPECIAL))
        for text in np.flatnonzero(whole).tolist():
            which[starts[text]:starts[text] + lengths[text]] = n
        used = np.zeros(n + 1, bool)
        used[which] = True
        wanted = used[owner] & ~known[owner]
        owner, words = owner[wanted], words.filter(pa.array(wanted)).dictionary_encode()
        table, counts = self.words.ids(words.dictionary, self._encode_words)
        word = words.indices.to_numpy()
        flat = _gathered(table, (np.cumsum(counts) - counts)[word], counts[word])
        sizes = np.append(np.bincount(owner, counts[word], n).astype(np.int64), 0)

        # Ids of the whole library stand behind those of the words.
        pieces = np.flatnonzero(known & used[:n])
        alone = np.flatnonzero(whole)
        coded = self._learn(entries.take(pa.array(pieces)).to_pylist()) + self._encode(texts.take(pa.array(alone)).to_pylist())
        flat = np.concatenate([flat, np.frombuffer(b"".join(coded), "<u4")])
        begins = np.cumsum(sizes) - sizes
        more = np.array([len(one) // 4 for one in coded], np.int64)
        after = len(flat) - more.sum() + np.cumsum(more) - more
        begins, sizes = np.append(begins, after[len(pieces):]), np.append(sizes, more[len(pieces):])
        begins[pieces], sizes[pieces] = after[:len(pieces)], more[:len(pieces)]
        which[starts[alone]] = n + 1 + np.arange(len(alone))
        parts = [_gathered(flat, begins[some], sizes[some]) for some in np.array_split(which, (len(which) >> 17) + 1)]
        return np.concatenate(parts), np.add.reduceat(sizes[which], starts)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32."""
        flat, sizes = self.ids(pa.array(texts, pa.large_string()))
        return [part.tobytes() for part in np.split(flat, np.cumsum(sizes)[:-1])] if texts else []

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces from the whole library; the latest are kept."""
        fresh = list({piece for piece in pieces if piece not in self.known and piece not in self.before})
        found = dict(zip(fresh, self._encode(fresh), strict=True))
        found.update((piece, self.before[piece]) for piece in pieces if piece in self.before)
        self.known.update(found)
        self.letters += sum(map(len, found))
        out = [self.known[piece] for piece in pieces]
        if len(self.known) > PARTS or self.letters > PARTS_LETTERS:
            self.known, self.before, self.letters = {}, self.known, 0
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary, so that later tasks find its pieces known."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _blocks(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode, part, number = encoder(path), TaskContext.get().partitionId(), 0
    schema = arrow_schema(TABLE)
    names: list[pa.Array] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def block() -> pa.RecordBatch:
        data = range_coder.encode(np.concatenate([flat for flat, _ in held]))
        lengths = pa.array(np.concatenate([sizes for _, sizes in held]))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), one) for one in (pa.concat_arrays(names), lengths)]
        columns = [pa.array([part]), pa.array([number]), *lists, pa.array([size]), pa.array([data], pa.binary())]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        for a, b in slices(batch.column(1), SLICE_BYTES):
            flat, sizes = encode.ids(batch.column(1).slice(a, b - a))
            held.append((np.insert(flat, np.cumsum(sizes), END), sizes + 1))
            names.append(batch.column(0).slice(a, b - a))
            size += len(held[-1][0])
            if size >= BLOCK_IDS:
                yield block()
                names, held, size, number = [], [], 0, number + 1
    if held:
        yield block()


def write_tokens(docs: DataFrame, out_path: str, path: str | None = None) -> None:
    """Encode every whole text and write the token table to a new folder.

    Documents stand in ascending order of ``doc_id``, nulls last, equal ids in order of
    text; each ends with id 0, and a null or empty text is that id alone. The texts are
    dealt out by ranges of the order, so a range is one task's run of blocks.
    """
    path = path or vocabulary()
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    blocks = ordered.mapInArrow(lambda batches: _blocks(batches, path), TABLE)
    blocks.write.mode("errorifexists").parquet(out_path)


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(DOCUMENTS)
    for batch in batches:
        for row in batch.to_pylist():
            ids = range_coder.decode(row["data"]).astype("<u4", copy=False)
            lengths = np.array(row["lengths"], np.int64)
            ends = np.cumsum(lengths)
            n = len(lengths)
            if ends[-1] != len(ids):
                raise ValueError("token block with other lengths than its ids")
            checks = [zlib.crc32(ids[b - k:b].tobytes()) for b, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
            columns = [[row["part"]] * n, [row["block"]] * n, range(n), row["doc_ids"], ends - lengths, lengths, checks]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _token_lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema("doc_id long, ids array<long>")
    for batch in batches:
        for row in batch.to_pylist():
            parts = np.split(range_coder.decode(row["data"]).astype(np.int64), np.cumsum(row["lengths"])[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(parts, schema.field(1).type)], schema=schema)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, ids`` of a token table; a damaged block raises an error."""
    table = spark.read.schema(TABLE).parquet(path).select("doc_ids", "lengths", "data")
    return table.mapInArrow(_token_lists, "doc_id long, ids array<long>")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, decoded from a token table.

    ``start`` is added up in two steps, over the parts and over the blocks of a part.
    """
    table = spark.read.schema(TABLE).parquet(path)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    parts = parts.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_part_start"))
    above = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = table.select("part", "block", F.coalesce(F.sum("n_ids").over(above), F.lit(0)).alias("_block_start"))
    starts = blocks.join(parts, "part").select("part", "block", (F.col("_part_start") + F.col("_block_start")).alias("_start"))
    decoded = table.mapInArrow(_documents, DOCUMENTS)
    return decoded.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the documents as a token table, read it back, and describe each document.

    An empty table gives an empty result; repeated rows follow each other; columns other
    than ``doc_id`` and ``text`` are not read.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    write_tokens(docs, folder, path)
    return read_index(spark, folder)
