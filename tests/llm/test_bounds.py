"""What the operators hold at once, and how their work grows."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

from wirepulse.llm import decontamination, lm_scoring, text, token_files


def benchmark_texts() -> list[bytes]:
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
    return [" ".join(rng.choices(words, k=35)).encode() for _ in range(60)]


def index_of(texts: list[bytes]) -> decontamination.Index:
    parts = set().union(*(decontamination.cuts(decontamination.normal(t), decontamination.PASSAGE, decontamination.STRIDE) for t in texts))
    return decontamination.build_index([(part, part) for part in sorted(parts)])


def test_a_group_full_of_passages_is_searched_in_bounded_memory():
    items = benchmark_texts()
    index = index_of(items)
    dense = b" ".join(items)
    documents = [dense] * (1_500_000 // len(dense)) + [b" ".join([dense] * (1_500_000 // len(dense)))]
    few = decontamination.search(index, [dense])
    tracemalloc.start()
    found = decontamination.search(index, documents)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20
    assert {passage for _, passage, _ in few} == set(index.items)
    for number in range(len(documents)):
        assert {(p, e) for n, p, e in found if n == number} >= {(p, e) for _, p, e in few}


def test_a_long_text_is_searched_in_windows(monkeypatch):
    items = benchmark_texts()[:12]
    index = index_of(items)
    texts = [b" ".join(b"own%d" % (k * j) for j in range(90)) + items[k] + b" ".join(b"more%d" % (k + j * j) for j in range(60)) + items[k][7:70] for k in range(12)]
    whole = sorted(decontamination.search(index, [b" ".join(texts), *texts]), key=str)
    for size in (300, 1000, 4096):
        monkeypatch.setattr(decontamination, "WINDOW", size)
        assert sorted(decontamination.search(index, [b" ".join(texts), *texts]), key=str) == whole


def test_slices_of_a_column():
    column = pa.array(["a" * 10, None, "", "b" * 30, "c" * 5, "d" * 100, "e"])
    ranges = list(text.slices(column, 32))
    assert ranges[0][0] == 0 and ranges[-1][1] == len(column)
    assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    for a, b in ranges:
        held = sum(len(t or "") for t in column.slice(a, b - a).to_pylist())
        assert held <= 32 or b - a == 1
    assert list(text.slices(pa.array([], pa.string()), 5)) == []


def test_encoder_holds_few_bytes_of_what_it_has_seen(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED_BYTES", 40_000)
    monkeypatch.setattr(token_files, "PARTS_LETTERS", 20_000)
    encode = token_files.Encoder(token_files.vocabulary())
    for k in range(12):
        # Unseen words, texts without any space, and pieces with line ends.
        texts = [f"first{k}x{i}.\nline and word{k}y{i}, " + "z" * 5 + f"{k}{i}" for i in range(200)] + [f"{k}" + "語" * 500] * 2
        flat, sizes = encode.ids(pa.array(texts))
        want = [one.ids for one in encode.library.encode_batch(texts, add_special_tokens=False)]
        assert flat.tolist() == [i for ids in want for i in ids] and sizes.tolist() == list(map(len, want))
        assert encode.words.names.nbytes + encode.words.flat.nbytes <= 40_000
        held = [*encode.known.items(), *encode.before.items()]
        assert sum(len(name) for name, _ in held) <= 4 * 20_000
    assert len(encode.words.names) > 100


def test_encoder_remembers_words_in_little_room():
    encode = token_files.Encoder(token_files.vocabulary())
    encode.ids(pa.array(["a first text"]))
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    for k in range(5):
        encode.ids(pa.array([" ".join(f"w{k}q{i}" for i in range(12_000))]))
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert held < 60 * 60_000


@pytest.fixture(scope="module")
def chunk():
    texts = [one.decode() for one in benchmark_texts()] * 450
    n = len(texts)
    return pa.table({"chunk": pa.array([0] * n, pa.int64()), "doc_id": pa.array(range(n), pa.int64()), "text": texts})


def peak_of(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_chunk_of_the_language_model_is_worked_on_in_pieces(chunk):
    assert chunk["text"].nbytes > 5 << 20
    words, words_peak = peak_of(lambda: lm_scoring._chunk_words(chunk))
    found, grams_peak = peak_of(lambda: lm_scoring._chunk_grams(chunk))
    n, m = words.num_rows, found.num_rows
    known = pa.table({
        "chunk": pa.array([0] * (n + m), pa.int64()),
        "word": pa.chunked_array([words["word"].combine_chunks(), pa.nulls(m, pa.binary())]),
        "gram": pa.chunked_array([pa.nulls(n, pa.int64()), found["gram"].combine_chunks()]),
        "c": pa.chunked_array([words["n"].combine_chunks(), pa.array([0] * m, pa.int64())]),
        "value": pa.array([0.0] * n + [-1.0] * m),
        "fresh": pa.array([True] * n + [False] * m),
    })
    scored, scored_peak = peak_of(lambda: lm_scoring._score_chunk(chunk, known))
    lengths = [len(one) for one in chunk["text"].to_pylist()]
    assert scored["score"].to_pylist() == [*(-1.0 - length for length in lengths), None]
    assert max(words_peak, grams_peak, scored_peak) < 70 << 20


def test_four_grams_of_a_task_are_counted_in_pieces(chunk, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PENDING", 5000)
    batches = chunk.select(["doc_id", "text"]).to_batches(max_chunksize=20_000)
    (found,), peak = peak_of(lambda: list(lm_scoring._count_grams(batches)))
    assert peak < 70 << 20
    want, times = Counter(), Counter()
    for doc_id, one in zip(chunk["doc_id"].to_pylist(), chunk["text"].to_pylist(), strict=True):
        times[one.encode()] += lm_scoring.remainder(doc_id) != lm_scoring.HELD_OUT
    for one, c in times.items():
        for code in lm_scoring.grams([one])[0].tolist():
            want[code] += c
    assert dict(zip(found["gram"].to_pylist(), found["n"].to_pylist(), strict=True)) == want


def test_no_batches_count_no_four_grams():
    (found,) = lm_scoring._count_grams([])
    assert found.num_rows == 0 and found.schema.types == [pa.int64(), pa.int64()]
