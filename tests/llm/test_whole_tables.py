"""Operators 2, 4, 5, 9 and 10 over a whole table against the libraries and plain re-implementations.

The re-implementations share the trained parameters and nothing else: they hash, count
and compress in their own, slower way.
"""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shopmetrics.llm import embedding_links, language, linear, quality, queries, toxicity
from shopmetrics.llm.folds import held_out

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_sentencepiece_equals_the_library(spark, documents):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def digests(text):
        ids = lib.encode(text, add_bos=True, add_eos=True)
        return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(lib.decode(ids).encode()).hexdigest())

    got = queries.op2_sentencepiece(spark, SF).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == \
        {i: digests(t) for i, t in documents.items()}


def test_packed_ids_equal_the_library(spark, documents):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))  # as read, nothing switched
    want = set()
    for i, text in documents.items():
        ids = lib.encode(text, add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start: start + 2048]
            want.add((i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    rows = queries.op10_best_fit_packing(spark, SF).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    filled = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert len(rows) == len(want) and max(filled.values()) <= 2048


def hashed(items, order):
    """Every n-gram's hash, by integers: the reference form of ``linear.ngram_counts``."""
    mix = int(linear.MIX)
    for i in range(len(items) - order + 1):
        h = items[i]
        for x in items[i + 1: i + order]:
            h = (h * mix + x) % 2 ** 32
        yield (h + order) % 2 ** 32


def ngrams(items, orders, bits):
    counts = Counter()
    for order in orders:
        for h in hashed(items, order):
            counts[int(linear.bucket(np.array([h], dtype=np.uint32), bits)[0])] += 1
    return counts


def test_language_equals_a_dense_model(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs.filter(~held_out(5, 0)))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op4_language_id(spark, SF).collect()}
    assert set(got) == set(documents)
    for i in sorted(documents)[::20]:  # the plain form is slow
        text = documents[i].lower()
        if not any(c.isalpha() for c in text):
            assert got[i] == ("und", 0.0)
            continue
        x = np.zeros(len(model.idf))
        for at, n in ngrams([ord(c) if c.isalpha() else 32 for c in text], language.ORDERS, language.BITS).items():
            x[at] = (1 + math.log(n)) * model.idf[at]
        x /= math.sqrt((x * x).sum())
        logits = (x @ model.weights.astype(float) + model.bias) / model.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        assert got[i][0] == model.languages[int(p.argmax())] and got[i][1] == pytest.approx(p.max(), abs=1e-4)


def test_document_frequencies_cover_every_learnable_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(~held_out(5, 0)).filter("lang IS NOT NULL AND text IS NOT NULL")
    n, df = language._document_frequencies(docs.repartition(5))
    want, rows = np.zeros(1 << language.BITS, dtype=int), 0
    for r in docs.select("text").collect():
        counts = language.letter_ngrams(r["text"])
        if counts is not None:
            rows += 1
            want += counts > 0
    assert n == rows and (df == want).all()


def test_toxicity_equals_plain_compression(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), labels.filter(~held_out(4, 2)))
    rows = {r["doc_id"]: r for r in queries.op5_toxicity(spark, SF).collect()}
    assert set(rows) == set(documents)
    lengths = {}

    def compressed(dictionary, window):
        if (dictionary, window) not in lengths:
            frame = zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(dictionary),
                                             write_content_size=False, write_checksum=False, write_dict_id=False)
            lengths[dictionary, window] = len(frame.compress((f" {window}" * 8 + " ").encode()))
        return lengths[dictionary, window]

    for i in sorted(documents)[::50]:
        found = set()
        for w in re.findall(r"\w+", documents[i].lower()):
            found |= {w} if len(w) <= 32 else {w[k: k + 32] for k in range(0, len(w) - 16, 16)}
        cells = Counter()
        for w in found:
            one, two = compressed(model.toxic, w), compressed(model.ordinary, w)
            place = [min(max(v, low), high) - low for v, (low, high) in
                     zip((len(w.encode()), one, one - two), ((2, 16), (12, 27), (-7, 3)))]
            cells[(place[0] * 16 + place[1]) * 11 + place[2]] += 1
        evidence = sum(k * math.log1p(model.ratio[c] / len(found)) for c, k in cells.items()) - model.extra
        want = 1 / (1 + math.exp(-min(max(model.slope * evidence + model.offset, -40), 40)))
        assert rows[i]["score"] == pytest.approx(want, abs=1e-9)
        assert rows[i]["predicted"] == int(want >= 0.3)


def test_quality_verdict_equals_a_dense_model(spark, documents):
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r["doc_id"]: r for r in queries.op9_quality_rules(spark, SF).collect()}
    assert set(rows) == set(documents)
    for i in sorted(documents)[::50]:
        text, words = documents[i], re.findall(r"[^\x20\x09-\x0D]+", documents[i])
        triples = Counter(zip(words, words[1:], words[2:]))
        twice = {k + j for k, t in enumerate(zip(words, words[1:], words[2:])) if triples[t] > 1 for j in range(3)}
        assert (rows[i]["n_words"], rows[i]["n_repeat_words"]) == (len(words), len(twice))
        failed = len(words) < 50 or 100 * len(twice) > 50 * len(words)
        assert rows[i]["base_failed"] == failed
        if failed:
            assert not rows[i]["kept"]
            continue
        total = model.bias
        for counts, at in ((ngrams([zlib.crc32(w.encode()) for w in words], (1, 2), quality.WORD_BITS), 0),
                           (ngrams([ord(c) for c in text], (2, 3, 4), quality.CHAR_BITS), 1 << quality.WORD_BITS)):
            tf = {k: 1 + math.log(n) for k, n in counts.items()}
            norm = math.sqrt(sum(v * v for v in tf.values()))
            total += sum(v / norm * float(model.weights[k + at]) for k, v in tf.items())
        p = 1 / (1 + math.exp(-(model.slope * total + model.offset)))
        assert abs(p - 0.5) < 1e-3 or rows[i]["kept"] == (p >= 0.5)


def test_unrelated_vectors_are_no_candidates():
    # false candidates would join the clusters of a large table into one
    x = np.random.default_rng(4).standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert not embedding_links.candidates(embedding_links.steps(x, 0.95), 0.95, 0.999).any()
    near = x + 0.01 * np.random.default_rng(5).standard_normal(x.shape)
    both = np.concatenate([x[:300], near[:300] / np.linalg.norm(near[:300], axis=1)[:, None]])
    found = embedding_links.candidates(embedding_links.steps(both, 0.95), 0.95, 0.999)
    assert found[np.arange(300), np.arange(300) + 300].all() and found.sum() == 600


def test_held_out_rows_are_marked(spark):
    for query, folds, fold in ((queries.op4_language_id, 5, 0), (queries.op5_toxicity, 4, 2)):
        got = query(spark, SF).select("doc_id", "held_out", F.crc32(F.col("doc_id").cast("string")).alias("c")).collect()
        assert all(r["held_out"] == (r["c"] % folds == fold) for r in got)
