"""Fill-in-middle, importance resampling and prefix counts: odd rows, empty tables, brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quorumlake.llm import infill, prefixes, queries, resampling, wavelet
from quorumlake.llm.common import text_bytes
from tests.compare import rows_of

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n long, form string, output string, n_tokens string, prefix_counts int, rank string, score map<string,int>"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
PARTS = ["a", "e", "n", "s", "th", "ing", "er", "'", "'s", "'re", "'ve", "'ll", "'d", "9", "7", ".", "!", "--", "==", "<|endoftext|>", "<|endof", "|>", " ", "  ", "\n", "\t"]
PARTS += ["é", "é", "́̂", "ß", "İ", "日", "本", "🎉", "👨‍👩", "ก็", " ", "한", "한ᆫ", "ſ", "Σ", "²", "٣", "ⅷ", "हि", "\x00", "$#@", "oo", "zz", "<P>", "<S", ">", "Ab"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(7)
    long_text = "".join(rng.choice(PARTS) for _ in range(40_000)) + "x" * 30_000
    texts = [None, "", " \n", "one", long_text, "a<P>b", "x <S> y", "q" * 5000, "Ä" * 300, "the cat sat on the mat " * 30]
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    rows = [(k, t, 5, "f", "o", "n", 3, "r", None) for k, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, "null id", None, None, None, None, None, None, None), (None, texts[9], None, None, None, None, None, None, {"a": 1})]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_wavelet_matrix_ranks_and_selects():
    rng = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 1000):
        row = rng.integers(0, 8, size).astype(np.uint8)
        matrix = wavelet.WaveletMatrix(row, 3)
        places = np.arange(size + 1)
        for a in range(9):
            for b in range(a, 9):
                expected = np.concatenate([[0], np.cumsum((row >= a) & (row < b))])
                assert (matrix.rank(range(a, b), places) == expected).all()
        found = matrix.select(range(2, 5), np.arange(1, 6), np.zeros(5), np.full(5, size))
        counted = np.concatenate([[0], np.cumsum((row >= 2) & (row < 5))])
        assert found.tolist() == [next((p for p in range(size + 1) if counted[p] >= n), size) for n in range(1, 6)]


def infilled(doc_id, text, unit="token"):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]" if unit == "token" else "(?s).", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    i, j = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (tokens[:i], tokens[i:j], tokens[j:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    spm = h[3] % 100 < 20
    return len(tokens), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["token", "character"])
def test_infill_equals_plain_loop(spark, odd, unit):
    made = infill.fill_in_middle(odd, unit=unit)
    assert made.columns == [*odd.columns, "_n", "_form", "prefix_chars", "middle_chars", "_output"]
    rows = made.withColumn("back", infill.restored(F.col("_output"), F.col("_form"))).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r._n, r._form, r.prefix_chars, r.middle_chars, r._output) == infilled(r.doc_id, r.text, unit), (r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r._form for r in rows} == {"plain", "psm", "spm"}


def test_infill_of_an_empty_table(empty):
    assert infill.fill_in_middle(empty).count() == 0
    assert infill.fill_in_middle(empty, keep=["doc_id"]).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_registered_infill(spark):
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op11_infill(spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(documents)
    for r in rows:
        n, form, p, m, output = infilled(r.doc_id, documents[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(documents[r.doc_id].encode()).hexdigest()


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return len(words), [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def resampled_plainly(documents, target, percent=5, least=20):
    def buckets(texts):
        out = Counter(zlib.crc32(f) % 10000 for t in texts for f in features(t)[1])
        return out, sum(out.values())

    s, all_s = buckets(t for _, t in documents)
    t, all_t = buckets(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    rows, eligible = [], []
    for doc_id, text in documents:
        n, found = features(text)
        weight = sum(gain[zlib.crc32(f) % 10000] for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None])
        if n >= least:
            eligible.append(rows[-1])
    order = sorted(eligible, key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(order[: percent * len(eligible) // 100], 1):
        r[4] = rank
    return sorted(map(repr, map(tuple, rows)))


def test_registered_resampling_equals_plain_loop(spark):
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    found = queries.op12_resampling(spark, FOLDER).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(repr(tuple(r)) for r in found.collect()) == resampled_plainly(documents, target)


def test_resampling_of_odd_rows(spark, odd, empty):
    target = spark.createDataFrame([(None,), ("the cat on a mat",), ("",)], "text string")
    documents = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = resampling.resampled(odd, target, percent=50, least_words=2).collect()
    assert sorted(repr(tuple(r)) for r in got) == resampled_plainly(documents, ["the cat on a mat"], 50, 2)
    assert resampling.resampled(empty, target).count() == 0
    assert resampling.resampled(odd, empty).count() == odd.count()


def test_head_and_tail_give_the_same_buckets(spark):
    rng = random.Random(5)
    words = ["the", "and", "Of", "é日", "x" * 61, "y" * 62, "z" * 63, "w" * 900, "b", "9", "tail1", "tail2"]
    texts = pa.array([None, "", *["".join(rng.choice(words) + rng.choice([" ", ", ", "\n"]) for _ in range(rng.randrange(50))) for _ in range(300)]])
    heads = [resampling._head([], []), resampling._head([b"the", b"of", "é日".encode(), b"y" * 62], [(0, 1), (1, 1), (3, 0), (2, 3)])]
    for head in heads:
        buckets, starts = resampling._Lot(texts, head).features()
        for k, text in enumerate(texts.to_pylist()):
            got = np.concatenate([b[s[k] : s[k + 1]] for b, s in zip(buckets, starts, strict=True)]).tolist()
            assert got == [zlib.crc32(f) % 10000 for f in features(text)[1]]


def test_frequent_words_and_pairs_are_in_the_head(spark):
    rng = random.Random(8)
    texts = [" ".join(["common"] * 3 + [f"rare{rng.random()}", "pair", "mate"]) for _ in range(200)]
    head = resampling.head_vocabulary(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), most=4, most_pairs=2)
    assert head.words.to_pylist()[0] == b"common"
    assert set(head.words.to_pylist()) >= {b"common", b"pair", b"mate"}
    first = {(a, b): int(head.pair_of[a, b]) for a, b in zip(*np.nonzero(head.pair_of >= 0), strict=True)}
    assert len(first) == 2 and (0, 0) in first


def test_prefix_counts_equal_the_tokenizer(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 12))) for _ in range(600)]
    counter = prefixes.PrefixCounts(public_tokenizers.path("word_bpe_49k.json"))
    differences, places = counter.of_texts(pa.array(texts))
    for k, text in enumerate(texts):
        expected = [len(TOKENIZER.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]
        assert np.cumsum(differences[places[k] : places[k + 1]]).tolist() == expected, text


def test_states_may_be_forgotten(monkeypatch):
    monkeypatch.setattr(prefixes, "HELD_PREFIXES", 20)
    monkeypatch.setattr(prefixes, "HELD_WORDS", 5)
    monkeypatch.setattr(prefixes, "HELD_LENGTH", 6)
    test_prefix_counts_equal_the_tokenizer(None)


def test_pieces_are_counted_together(spark, monkeypatch):
    made = []
    monkeypatch.setattr(prefixes.Run, "push", lambda *a, push=prefixes.Run.push: made.append(a[1]) or push(*a))
    counter = prefixes.PrefixCounts(public_tokenizers.path("word_bpe_49k.json"))
    texts = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    differences, places = counter.of_texts(pa.array(texts))
    assert not made
    assert np.add.reduceat(differences, places[:-1]).tolist() == [len(TOKENIZER.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counter.differences(pa.array(["don't", "x" * 49, "x" * 48])).value_lengths().to_pylist() == [5, 49, 48]
    assert b"x" * 49 in made and b"x" * 48 not in made


def test_pieces_up_to_the_held_length_and_beyond():
    rng = random.Random(12)
    letters = ["a", "e", "T", "S", "th", "ing", "er", "é", "É", "日", "ß", "ſ", "ñ"]
    breaks = ["7", "²", "...", "-", "日。", "🎉", "\xa0", "\x00"]
    words = []
    for size in [*range(1, 60), 95, 96, 97, 300]:
        word = "".join(rng.choice(letters) for _ in range(size))
        words += [word[:size], word[: size // 2] + rng.choice(breaks) + word[size // 2 :], word[: size - 1] + rng.choice(breaks) * 3]
    counter = prefixes.PrefixCounts(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(2):
        found = counter.differences(pa.array(words)).to_pylist()
        for word, steps in zip(words, found, strict=True):
            assert np.cumsum(steps).tolist() == [len(TOKENIZER.encode(word[:i], add_special_tokens=False).ids) for i in range(1, len(word) + 1)], word


def test_counts_of_odd_rows(spark, odd, empty):
    found = prefixes.prefix_counts(odd)
    assert found.columns == [*odd.columns, "_n_tokens", "_prefix_counts"]
    rows = found.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r._n_tokens == len(TOKENIZER.encode(r.text or "", add_special_tokens=False).ids)
        held = prefixes.counts(r._prefix_counts)
        assert len(held) == len(r.text or "") + 1 and held[-1] == r._n_tokens
    assert prefixes.prefix_counts(empty).count() == 0


def test_questions_to_the_stored_counts(spark, odd):
    held = prefixes.prefix_counts(odd.select("doc_id", "text"))
    budget, place = F.lit(7), F.lit(9)
    asked = held.select("text", prefixes.tokens_at("prefix_counts", place).alias("at"), prefixes.fitting("prefix_counts", budget).alias("fits"), prefixes.truncated(F.col("text"), F.col("prefix_counts"), budget).alias("cut"))
    for r in asked.collect():
        text = r.text or ""
        if len(text) > 3000:
            continue
        counted = [len(TOKENIZER.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert r["at"] == counted[min(9, len(text))]
        assert r.fits == max(i for i, n in enumerate(counted) if n <= 7)
        assert (r.cut or "") == text[: r.fits]
    nothing = held.select(prefixes.tokens_at("prefix_counts", F.lit(None).cast("long")).alias("a"), prefixes.fitting("prefix_counts", F.lit(-1)).alias("b")).first()
    assert nothing.a is None and nothing.b is None


def test_large_differences_are_stored():
    steps = np.array([0, 1, -1, 63, -64, 64, -65, 8191, 100_000, -2_000_000_000, 5], np.int32)
    held = prefixes.stored(steps, np.array([0, 4, 4, 11]))
    assert [np.diff(prefixes.counts(x)).tolist() for x in held.to_pylist()] == [steps[:4].tolist(), [], steps[4:].tolist()]


def test_registered_counts(spark):
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    columns, rows = rows_of(spark, queries.op13_tokens, FOLDER)
    assert columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    expected = []
    for doc_id, text in documents.items():
        n = len(TOKENIZER.encode(text, add_special_tokens=False).ids)
        expected.append(repr((doc_id, len(text.encode()), n, n > 2048)))
    assert rows == sorted(expected)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        prefixes.PrefixCounts(public_tokenizers.path("byte_bpe_50k.json"))


def test_bytes_of_texts_with_nulls_and_slices():
    texts = pa.array(["ab", None, "é", ""]).slice(1)
    data, bounds = text_bytes(texts)
    assert data.tobytes() == "é".encode() and bounds.tolist() == [0, 0, 2, 2]
