"""Each operator on edge cases and, whole, against a plain version on a small table."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from tests.llm import brute
from wirepulse.llm import (
    boosted_trees,
    components,
    decontamination,
    license_scan,
    lm_scoring,
    mixing,
    near_dedup,
    pii,
    quality_classifier,
    quality_rules,
    range_coder,
    secret_scan,
    token_files,
)

SMALL = "/root/testdata/sf0.001"
COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, key string, root long, chunk int, "
    "word string, _source string, start long, score double"
)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {row["doc_id"]: row["text"] or "" for row in documents.select("doc_id", "text").collect()}


def edge_rows() -> list[tuple]:
    """Nulls everywhere, empty, blank and very long texts, ties and repeated rows."""
    prose = " ".join(f"w{k}" for k in range(60))
    rows = [
        (1, prose, "a"), (1, prose, "a"), (2, None, None), (3, "", "b"), (4, " \n\t ", "b"), (None, prose + " x", "a"),
        (None, None, None), (5, "one two", None), (6, " ".join(f"v{k % 5000}" for k in range(40_000)), "c"),
        (7, "x" * 200_000, "c"), (8, "ünï code \U0001f600 ñ", "é"),
    ]
    return [(i, text, "en", source, None, 9, "k", 0, 1, "w", "s", 2, 0.5) for i, text, source in rows]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), COLUMNS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(60))), (2, None), (3, ""), (4, "abc"), (None, None)], "item_id long, text string")


def test_edge_cases_and_empty_tables(spark, edges, nothing, benchmark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, None), (None, 1, 1), (6, None, 0)], "doc_id long, quality int, toxic int")
    trees = quality_classifier.fit_quality(edges, labels)
    for run in (
        pii.pii_report, mixing.mix_plan, secret_scan.secret_report, token_files.token_index, license_scan.license_report,
        near_dedup.near_classes, quality_rules.quality_measures, lm_scoring.lm_scores,
        lambda docs: decontamination.decontamination_report(docs, benchmark),
        lambda docs: quality_classifier.quality_scores(docs, trees),
    ):
        out = run(edges)
        rows = out.collect()
        assert len(rows) == len(edge_rows())
        ids = sorted(row["doc_id"] is None for row in rows)
        assert ids == [False] * 9 + [True] * 2
        empty = run(nothing)
        assert empty.columns == out.columns and empty.collect() == []
    for run in (quality_rules.keep_good, near_dedup.first_of_class, mixing.mixed, lambda docs: decontamination.without_leaks(docs, benchmark)):
        assert run(edges).columns == edges.columns
        assert run(nothing).collect() == []


def test_edge_results(edges, benchmark):
    classes = {}
    for row in near_dedup.near_classes(edges).collect():
        classes.setdefault(row["doc_id"], set()).add((row["class_id"], row["class_size"]))
    assert classes[1] == {(1, 3)} and classes[2] == classes[3] == {(2, 3)} and classes[4] == {(4, 1)}
    assert classes[None] == {(1, 3), (2, 3)}
    kept = sorted(row["doc_id"] or 0 for row in near_dedup.first_of_class(edges).collect())
    assert kept == [1, 2, 4, 5, 6, 7, 8]
    leaks = {(row["doc_id"], row["items"]) for row in decontamination.decontamination_report(edges, benchmark).collect()}
    assert {(1, "1"), (None, "1"), (2, "")} <= leaks and (6, "1") not in leaks
    left = [row["doc_id"] for row in decontamination.without_leaks(edges, benchmark).collect()]
    assert 1 not in left and 6 in left


def test_personal_data(documents, texts):
    for row in pii.pii_report(documents).collect():
        want = brute.private(texts[row["doc_id"]])
        assert row["base_sha256"] == brute.digest(want)
        assert [row[f"n_{k}"] for k in pii.BASE] == [sum(s[2] == k for s in want) for k in pii.BASE]
    rng = random.Random(1)
    for alphabet in ("ab@.-1 ", "12.3 -+()4", "0123456789 -", "@a.+1é İ"):
        for _ in range(2000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
            assert [s for s in pii.find(text) if s[2] in pii.BASE] == brute.private(text)
    added = {s[2] for s in pii.find("IBAN: GB82 WEST 1234 5698 7654 32, account no. 12345678, SSN 123-45-6789, https://bob:pw@h.com, 2001:db8::1")}
    assert added >= {"iban", "account", "national_id", "url_login", "ipv6"}


def test_personal_data_is_masked(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co now"), (2, None)], "doc_id long, text string")
    assert {tuple(r) for r in pii.masked(docs).collect()} == {(1, "mail [email] now"), (2, "")}


def test_mixing_matches_targets(spark, documents):
    rows = mixing.mix_plan(documents).toPandas()
    assert (rows["taken"] <= 3 * rows["size"]).all() and rows["target"].notna().all()
    again = mixing.mix_plan(documents.repartition(5)).toPandas()
    assert rows.sort_values("doc_id").values.tolist() == again.sort_values("doc_id").values.tolist()
    even = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', cast(5 + id % 7 AS int)) AS text", "concat('s', id % 4) AS source")
    taken = mixing.mix_plan(even).groupBy("target", "source_size").agg({"taken": "sum"}).collect()
    assert len(taken) == 4 or len({r["target"] for r in taken}) >= 2
    for row in mixing.mix_plan(even).join(even.select("doc_id", "source"), "doc_id").groupBy("source", "target").agg({"taken": "sum"}).collect():
        assert abs(row["sum(taken)"] - row["target"]) <= 12
    copies = mixing.mixed(even).count()
    assert copies == mixing.mix_plan(even).selectExpr("sum(taken / size)").first()[0]


def test_mixing_targets_stop_at_three_sizes(spark):
    sized = spark.createDataFrame([(1, "a", 1), (2, "b", 100), (3, None, 100)], "doc_id long, source string, size long")
    targets = {r["_source"]: r["target"] for r in mixing.targets(sized).collect()}
    assert targets == {"a": 3.0, "b": pytest.approx(132.0), "": pytest.approx(66.0)}


def test_secrets(documents, texts):
    for row in secret_scan.secret_report(documents).collect():
        assert row["base_sha256"] == brute.digest(brute.secret(texts[row["doc_id"]]))
    rng = random.Random(2)
    parts = ["PassWord", "token", "api_key", "APIKEY", " = ", ":", "'", '"', "AKIA", "ABCDEF0123456789XYZ", "0123456789abcdef", " ", "é", "ſecret"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    for text, spans in zip(made, secret_scan.find_all([t.encode() for t in made]), strict=True):
        assert [s for s in spans if s[2] in secret_scan.BASE] == brute.secret(text)


def test_trigram_queries():
    assert secret_scan.trigram_query("AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert secret_scan.trigram_query("[0-9a-f]{24,}") is None
    assert secret_scan.trigram_query("(abc|x)d*") is None
    assert secret_scan.trigram_query("(abc|bcd)+") == ("or", ("abc", "bcd"))


def test_token_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 3000):
        for top in (1, 2, 50257):
            for ids in (rng.integers(0, top, n), np.minimum((rng.pareto(1.0, n) * 3).astype(int), top - 1)):
                assert (range_coder.decode(range_coder.encode(ids)) == ids).all()
    block = range_coder.encode(rng.integers(0, 500, 5000))
    for at in (17, len(block) // 2, len(block) - 9):
        broken = bytearray(block)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            range_coder.decode(bytes(broken))


def test_repeated_ids_are_predicted():
    ids = np.tile(np.arange(1000), 100)
    assert len(range_coder.encode(ids)) < len(ids) / 2


def test_token_files(spark, documents, texts, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_files.vocabulary())
    ordered = sorted(texts)
    want, start = {}, 0
    for doc_id, one in zip(ordered, library.encode_batch([texts[i] for i in ordered], add_special_tokens=False), strict=True):
        ids = np.array([*one.ids, 0], "<u4")
        want[doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_index(documents).collect()}
    assert got == {i: w[:3] for i, w in want.items()}
    token_files.write_tokens(documents, str(tmp_path / "tokens"))
    lists = {r["doc_id"]: r["ids"] for r in token_files.read_tokens(spark, str(tmp_path / "tokens")).collect()}
    assert lists == {i: w[3] for i, w in want.items()}


def test_encoder_cuts_texts_like_the_library():
    encode = token_files.encoder(token_files.vocabulary())
    rng = random.Random(3)
    parts = ["the", "Ab", " ", "\n", ".", ",", "  ", "'s", "don't", "é", "7", "!!", "\t", "x", "<|endoftext|>", "日本", "a.\nb", " \n"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(16))) for _ in range(4000)]
    want = [np.array(one.ids, "<u4").tobytes() for one in encode.library.encode_batch(made, add_special_tokens=False)]
    assert encode(made) == want and encode(made) == want


def test_licenses(documents, texts):
    for row in license_scan.license_report(documents).collect():
        words = [w for w in license_scan.words_of(texts[row["doc_id"]].encode())]
        plain = [w.decode() for w in words]
        places = []
        for phrase, label in license_scan.PHRASES.items():
            parts = phrase.split()
            places += [(k, label) for k in range(len(plain) - len(parts) + 1) if plain[k:k + len(parts)] == parts]
        assert (row["n_words"], row["n_base"]) == (len(words), len(places))
        assert row["first_word"] == (min(places)[0] if places else None)
        assert row["last_word"] == (max(places)[0] if places else None)
        held = {label for _, label in places}
        for a, b in license_scan.blocks(len(plain)):
            block = set(plain[a:b])
            for template, label in license_scan.TEMPLATES.items():
                wanted = set(template.split())
                if 10 * len(wanted & block) >= 9 * len(wanted):
                    held.add(label)
        assert row["labels"] == ",".join(sorted(held))


def near_copies(rng: random.Random) -> list[tuple]:
    """A group of copies changed in up to a fifth of their words, among other texts."""
    base = [f"b{rng.randrange(10**6)}" for _ in range(60)]
    docs = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"c{rng.randrange(10**6)}"
        docs.append((k, " ".join(words)))
    docs += [(k, " ".join(f"d{rng.randrange(500)}" for _ in range(rng.randrange(1, 40)))) for k in range(150, 230)]
    docs += [(k, docs[k - 100][1]) for k in range(230, 250)]
    docs += [(250, "a b c"), (251, "a  b\nc"), (252, "a b d"), (253, "z " * 50), (254, "z " * 55), (255, "z " * 90)]
    return docs


@pytest.mark.parametrize("leaders", [1, 4])
def test_near_duplicates(spark, monkeypatch, leaders):
    monkeypatch.setattr(near_dedup, "LEADERS", leaders)
    docs = near_copies(random.Random(4))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(table).collect()}
    assert got == brute.near_classes(docs)


def test_near_duplicates_of_documents(documents, texts):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(documents).collect()}
    want = brute.near_classes(list(texts.items()))
    assert got == want
    assert {r["doc_id"] for r in near_dedup.first_of_class(documents).collect()} == set(want.values())


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(150):
        hashes = near_dedup.mix(rng.integers(0, 2**62, 80).astype(np.uint64))
        a, b = rng.integers(0, 20, 80), rng.integers(0, 20, 80)
        owners = np.repeat([0, 1], [np.count_nonzero(a), np.count_nonzero(b)])
        values = near_dedup.bag_minhash(
            np.concatenate([hashes[a > 0], hashes[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), owners, 2
        )
        errors.append((values[0] == values[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 101), (None, 3), (103, 102), (102, 104), (7, 8)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, **dict.fromkeys((102, 103, 104), 102)}


def test_decontamination(spark, documents, texts):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    got = {r["doc_id"]: r["items"] for r in decontamination.decontamination_report(documents, items).collect()}
    normal = {i: decontamination.normal(t.encode()) for i, t in texts.items()}
    for item, text in items.collect():
        wanted = decontamination.normal(text.encode())
        for i, held in normal.items():
            if wanted in held:
                assert str(item) in got[i].split(",")
    assert sum(map(bool, got.values())) < len(got) / 4


def test_edited_passages_are_found():
    rng = random.Random(6)
    passages = [(k, " ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(2, 8))) for _ in range(30))[:160].encode()) for k in range(20)]
    index = decontamination.build_index(passages)
    for _ in range(150):
        item, passage = rng.choice(passages)
        edited = bytearray(passage)
        for _ in range(rng.randrange(int(decontamination.EDIT_RATE * len(passage)) + 4)):
            at = rng.randrange(len(edited))
            rng.choice([lambda: edited.pop(at), lambda: edited.insert(at, 120), lambda: edited.__setitem__(at, 121)])()
        text = b"before it " + bytes(edited) + b" and after"
        found = {name: edits for _, name, edits in decontamination.search(index, [text])}
        least = brute.edits_within(passage, decontamination.normal(text))
        assert found.get(item) == (least if least <= int(decontamination.EDIT_RATE * len(passage)) else None)


def test_edited_passages_at_the_edges_of_documents():
    rng = random.Random(7)
    passages = [(k, " ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(2, 8))) for _ in range(30))[:rng.choice([60, 110, 160])].strip().encode()) for k in range(20)]
    index = decontamination.build_index(passages)
    for turn in range(200):
        item, passage = rng.choice(passages)
        budget = int(decontamination.EDIT_RATE * len(passage))
        edited = bytearray(passage)
        if turn % 2:
            del edited[:rng.randrange(budget + 2)]
        for _ in range(rng.randrange(budget + 2) * (1 - turn % 2)):
            edited.pop(rng.randrange(len(edited)))
        for text in (bytes(edited), bytes(edited) + b" and after", b"before " + bytes(edited)):
            found = {name: edits for _, name, edits in decontamination.search(index, [b"", text, b"next"])}
            least = brute.edits_within(passage, decontamination.normal(text))
            assert found.get(item) == (least if least <= budget else None)


def test_a_letter_missing_in_a_whole_document():
    passage = b"abcdefghijklmnopqrstuvwxyz"
    index = decontamination.build_index([(1, passage)])
    assert decontamination.search(index, [passage.replace(b"m", b"")]) == [(0, 1, 1)]


def test_excerpts_from_the_middle_of_items(spark):
    rng = random.Random(8)
    items = [(k, " ".join("".join(rng.choice("etaoins") for _ in range(rng.randrange(2, 9))) for _ in range(words))) for k, words in enumerate([18, 25, 40, 60, 90])]
    docs = []
    for k, text in items:
        for _ in range(6):
            size = rng.randrange(decontamination.PASSAGE + decontamination.STRIDE - 1, 121)
            start = rng.randrange(max(1, len(text) - size))
            docs.append((len(docs), "Some prose of its own, " + text[start:start + size] + " and more of it.", str(k)))
    docs.append((len(docs), " ".join(items[1][1].split()[:17]), "1"))
    docs.append((len(docs), " ".join(items[2][1].split()[10:30]), "2"))
    frame, benchmark = spark.createDataFrame(docs, "doc_id long, text string, item string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontamination.decontamination_report(frame, benchmark).collect()}
    assert got == {doc: item for doc, _, item in docs}


def test_an_edit_in_items_of_few_bytes():
    for item in (b"wind over sea", b"a kingly crown", b"the quick mouse"):
        index = decontamination.build_index([(1, item)])
        for at in range(len(item)):
            for edited in (item[:at] + item[at + 1:], item[:at] + b"~" + item[at + 1:], item[:at] + b"~" + item[at:]):
                least = brute.edits_within(item, decontamination.normal(edited))
                assert decontamination.search(index, [edited]) == ([(0, 1, least)] if least <= 1 else [])


def test_edits_at_one_place_of_an_item(spark):
    text = " ".join("".join(random.Random(k).choice("etaoinshr") for _ in range(5)) for k in range(19))[:110]
    benchmark = spark.createDataFrame([(1, text), (2, "wind over sea")], "item_id long, text string")
    docs = spark.createDataFrame([(1, text[:51] + text[59:]), (2, "some wind xver sea there"), (3, text[51:59])], "doc_id long, text string")
    rows = decontamination.decontamination_report(docs, benchmark).collect()
    assert {(r["doc_id"], r["items"], r["distance"]) for r in rows} == {(1, "1", 8), (2, "2", 1), (3, "", None)}


def test_repeated_items_are_indexed_once(spark, monkeypatch):
    text = " ".join(f"w{k * k}" for k in range(40))
    benchmark = spark.createDataFrame([(1, text)] * 300 + [(k, text) for k in range(2, 40)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "none of it")], "doc_id long, text string")
    built, build = [], decontamination.build_index
    monkeypatch.setattr(decontamination, "build_index", lambda rows: (built.extend(bytes(r[1]) for r in rows), build(rows))[1])
    got = sorted(((r["doc_id"] or 0, r["item_id"], r["distance"]) for r in decontamination.leaks(docs, benchmark).collect()))
    assert got == [(doc, item, 0) for doc in (0, 1) for item in range(1, 40)]
    assert len(built) == len(set(built)) > 0


def test_benchmark_in_blocks(spark, documents, monkeypatch):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    whole = {tuple(r) for r in decontamination.leaks(documents, items).collect()}
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 4000)
    assert {tuple(r)[:2] for r in decontamination.leaks(documents, items).collect()} == {w[:2] for w in whole}


def test_quality_rules(documents, texts):
    rows = quality_rules.quality_measures(documents).collect()
    for row in rows:
        want = brute.repeats(texts[row["doc_id"]])
        assert {name: row[name] for name in want} == want
        assert not (row["base_failed"] and row["kept"])
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert {r["doc_id"] for r in quality_rules.keep_good(documents).collect()} == kept


def test_longest_repeats():
    rng = random.Random(7)
    for _ in range(60):
        lists = [[rng.randrange(rng.choice([1, 2, 4, 30])) for _ in range(rng.randrange(30))] for _ in range(4)]
        want = []
        for one in lists:
            for i in range(len(one)):
                best = 0
                for j in range(len(one)):
                    k = 0
                    while i != j and max(i, j) + k < len(one) and one[i + k] == one[j + k]:
                        k += 1
                    best = max(best, k)
                want.append(best)
        owner = np.repeat(np.arange(4), [len(one) for one in lists])
        assert list(quality_rules.longest_repeats(np.array([x for one in lists for x in one], np.int64), owner)) == want


def test_language_model(documents, texts):
    want = brute.language_model(list(texts.items()))
    for row in lm_scoring.lm_scores(documents, chunk_bytes=100_000).collect():
        n, known, base, score = want["docs"][row["doc_id"]]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (n, known, want["train_tokens"])
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 7 == 2)
        assert math.isclose(row["base_score"], base, rel_tol=1e-9) and math.isclose(row["score"], score, rel_tol=1e-9)


def test_classifier_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scores = quality_classifier.quality_scores(docs, quality_classifier.fit_quality(docs, labels))
    rows = scores.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert np.mean([(r["score"] >= 0.5) == r["quality"] for r in rows]) > 0.95


def test_boosted_trees():
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(3000, 4))
    labels = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0.5)).astype(float)
    trees = boosted_trees.fit(rows[:2000], labels[:2000])
    assert ((trees.score(rows[2000:]) > 0.5) == labels[2000:]).mean() > 0.95
    same = boosted_trees.fit(rows[:10], np.ones(10))
    assert (same.score(rows) > 0.9).all()
    assert boosted_trees.fit(rows[:0], labels[:0]).score(rows[:2]) == pytest.approx([0.5, 0.5])


class CountingLibrary:
    """A tokenizer that counts the letters of the texts it is given."""

    def __init__(self, library):
        self.library, self.letters = library, 0

    def encode_batch_fast(self, texts, **options):
        self.letters += sum(map(len, texts))
        return self.library.encode_batch_fast(texts, **options)

    def __getattr__(self, name):
        return getattr(self.library, name)


def test_encoder_asks_the_whole_library_for_few_pieces():
    encode = token_files.Encoder(token_files.vocabulary())
    library = encode.library = CountingLibrary(encode.library)
    words = ["erenberbe", "Uneréierch", "enäüß", "706", "des", "日本"]
    made = [f"{a} {b}{sign}{c} {a}&&&" for a in words for b in words for c in words for sign in (".\n", "&&&", "\n\n", " ***\n(")]
    want = [one.ids for one in library.library.encode_batch(made, add_special_tokens=False)]
    assert encode(made) == [np.array(ids, "<u4").tobytes() for ids in want]
    assert library.letters == 0 and len(encode.words.names) < 40


def test_encoder_knows_every_kind_of_character():
    encode = token_files.Encoder(token_files.vocabulary())
    rng = random.Random(5)
    parts = [*"aZé日ßªʰ₂²Ⅷ٣0_'’-€😀\t\n\r\v\f\0\x1c\x1f\x85\xa0 ", *"̈ि᠎  ​‍  　﻿￾\U0001f1e6", "'s", "'ll", "'ve", "''t", "ab", " x"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(8000)]
    want = [np.array(one.ids, "<u4").tobytes() for one in encode.library.encode_batch(made, add_special_tokens=False)]
    assert encode(made) == want and encode(made) == want


def test_encoder_with_other_vocabularies(tmp_path):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    small = Tokenizer(models.BPE({"a": 0, "b": 1, "ab": 2, "Ġ": 3, "Ġa": 4, "Ċ": 5}, [("a", "b"), ("Ġ", "a")]))
    small.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    other = Tokenizer(Tokenizer.from_file(token_files.vocabulary()).model)
    cuts = pre_tokenizers.Split(Regex(r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"), "isolated")
    other.pre_tokenizer = pre_tokenizers.Sequence([cuts, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    rng = random.Random(6)
    made = ["".join(rng.choice(["a", "b", "z", " ", "\n", "zz", "'s", "é", "1234", "."]) for _ in range(rng.randrange(9))) for _ in range(2000)]
    for name, library in (("small", small), ("other", other)):
        library.save(str(tmp_path / name))
        want = [np.array(one.ids, "<u4").tobytes() for one in library.encode_batch(made, add_special_tokens=False)]
        assert token_files.Encoder(str(tmp_path / name))(made) == want
