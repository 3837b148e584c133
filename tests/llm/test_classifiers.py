"""Language, toxicity and quality: held-out accuracy, brute-force counts, edge rows, folds."""

import os
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopmetrics.llm import language, linear, quality, queries, toxicity
from shopmetrics.llm.folds import held_out, labelled_sample
from tests.llm.data import DOCUMENTS, edge_rows, with_clashes

SF = "/root/testdata/sf0.1"
given_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_folds(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"))
    got = rows.select("doc_id", held_out(5, 0).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id").select(held_out(5, 0)).first()[0] is True


def test_labelled_sample_is_bounded_and_one_row_per_id(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (4, 0), (None, 1)], "doc_id BIGINT, quality INT")
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(6)] + [(None, "x"), (2, None)], "doc_id BIGINT, text STRING")
    rows = labelled_sample(docs, labels, "quality", {0: 2, 1: 5}).collect()
    assert sum(r["label"] == 0 for r in rows) == 2 and [r["text"] for r in rows if r["label"] == 1] == ["t1"]


# -- linear models ---------------------------------------------------------------------------
def test_ftrl_separates_and_is_sparse():
    rng = np.random.default_rng(0)
    model = linear.FtrlSoftmax(50, 3, l1=2.0)
    for _ in range(600):
        label = int(rng.integers(3))
        at = np.array([label, 3 + int(rng.integers(47))])
        model.learn(at, np.ones(2), label)
    w = model.weights()
    assert [int(w[k].argmax()) for k in range(3)] == [0, 1, 2]
    assert (w[3:] == 0).mean() > 0.2


def test_temperature_and_platt():
    logits = np.array([[4.0, 0.0]] * 60 + [[0.0, 4.0]] * 40)
    labels = np.array([0] * 45 + [1] * 15 + [1] * 30 + [0] * 10)   # three in four are right
    assert abs(linear.softmax(logits / linear.temperature(logits, labels))[0, 0] - 0.75) < 0.01
    a, b = linear.platt(np.array([-2.0, -1.0, 1.0, 2.0] * 20), np.array([0, 0, 1, 1] * 20))
    assert a > 0 and abs(b) < 0.5
    assert linear.platt(np.array([1.0]), np.array([1])) == (1.0, 0.0)


# -- language --------------------------------------------------------------------------------
@given_tables
def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op4_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    r = got.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("acc"),
                                  F.avg("score").alias("score"), F.min("score"), F.max("score")).first()
    assert r["acc"] > 0.97 and abs(r["score"] - r["acc"]) < 0.03
    assert 0 <= r[2] and r[3] <= 1
    assert got.count() == docs.count()


def test_language_edge_rows(spark):
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, (t, lang) in enumerate(
        [("the cat and the dog", "en"), ("der hund und die katze", "de")] * 30)], DOCUMENTS)
    model = language.train(docs)
    edge = with_clashes(spark.createDataFrame(edge_rows(), DOCUMENTS))
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict(edge, model).collect()}
    assert {g for g in got if g[0] in (1, 2, 3)} == {(i, "und", 0.0) for i in (1, 2, 3)}
    assert all(0 <= g[2] <= 1 for g in got) and {g[1] for g in got} <= {"und", "en", "de"}
    assert model.predict("und die katze")[0] == "de" and model.predict("and the cat")[0] == "en"
    assert language.predict(edge, model).count() == len(edge_rows())
    assert language.predict(edge.limit(0), model).count() == 0


def test_language_without_learnable_rows(spark):
    docs = spark.createDataFrame([(1, "words", None, "s", 1), (2, None, "en", "s", 1)], DOCUMENTS)
    for rows in (docs, docs.limit(0)):
        model = language.train(rows)
        assert model.predict("words") == ("und", 0.0)


def test_language_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, f"text number {i} of a single id", "en", "s", 1) for i in range(300)]
                                 + [(2, "ein text", "de", "s", 1)], DOCUMENTS)
    assert set(language.train(docs, rows_per_language=5).languages) == {"en", "de"}


def test_every_language_is_learned(spark):
    rng = random.Random(8)
    letters = [chr(0x4E00 + i) for i in range(700)]  # ten of its own for each language

    def text(k):
        return " ".join("".join(rng.choices(letters[10 * k: 10 * k + 10], k=5)) for _ in range(20))

    names = [f"l{k:02}" for k in range(70)]
    docs = [(i, text(i % 70), names[i % 70], "s", 1) for i in range(1400)] + [(9, text(69), "one id", "s", 1)] * 3
    model = language.train(spark.createDataFrame(docs, DOCUMENTS), rows_per_language=20)
    assert model.languages == sorted([*names, "one id"])
    assert all(model.predict(text(k))[0] == names[k] for k in range(69))
    few = language.train(spark.createDataFrame(docs, DOCUMENTS), max_rows=71)  # LEAST_ROWS of each
    assert few.languages == model.languages and (few.weights != 0).any(axis=0).all()


# -- toxicity --------------------------------------------------------------------------------
@given_tables
def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op5_toxicity(spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    r = {(x["toxic"], x["predicted"]): x["count"] for x in
         got.join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()}
    recall = r[1, 1] / (r[1, 1] + r.get((1, 0), 0))
    false = r.get((0, 1), 0) / (r[0, 0] + r.get((0, 1), 0))
    assert recall > 0.8 and false < 0.02
    assert got.where("predicted != CAST(score >= 0.3 AS INT) OR score < 0 OR score > 1").count() == 0


def _toxic_tables(spark):
    rng = random.Random(3)
    parts = ("ban", "col", "dur", "fen", "gis", "hal", "jem", "kov", "lim", "mur", "ato", "ere", "ilo", "oma", "ust")
    plain = [f"{a}{b}" for a in parts for b in parts]
    bad = ["grubnok", "snarfle"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return (spark.createDataFrame(rows, "doc_id BIGINT, text STRING"),
            spark.createDataFrame(labels, "doc_id BIGINT, toxic INT"))


def test_one_toxic_word_is_found_anywhere(spark):
    docs, labels = _toxic_tables(spark)
    model = toxicity.train(docs, labels)
    clean = "banato colere durilo fenoma gisust " * 20
    assert model.score(clean) < 0.3 and model.score("") < 0.3
    assert model.score(clean + "grubnok") >= 0.3 and model.score("snarfle " + clean) >= 0.3
    edge = with_clashes(spark.createDataFrame(edge_rows(), DOCUMENTS))
    got = toxicity.score_texts(edge, model).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[1] == by_id[2] == by_id[3] == model.score("")
    assert toxicity.score_texts(edge.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs, labels = _toxic_tables(spark)
    for some in (labels.limit(0), labels.where("toxic = 0")):
        model = toxicity.train(docs, some)
        assert model is None
        assert toxicity.score_texts(docs.limit(3), model).collect()[0]["score"] == 0.0


def test_long_runs_are_cut_into_overlapping_windows():
    run = "".join(chr(97 + i % 26) for i in range(100))
    found = toxicity.windows(run)
    assert all(len(w) <= toxicity.LONGEST for w in found)
    assert all(any(run[i: i + 8] in w for w in found) for i in range(93))


# -- quality ---------------------------------------------------------------------------------
def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    windows = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab \n\t\r\x0b\x0c\x1c\x85\xa0#*é", max_size=80),
                 st.lists(st.sampled_from(["a", "b", "c\n", "é|", " "]), max_size=40).map(" ".join)))
def test_stats_equal_brute_force(text):
    text = text.encode("utf-8", "ignore").decode()
    got = quality.judge(text, None)
    want = brute_stats(text)
    assert got[:5] == want
    failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
    assert got[5] == failed and got[7] == (not failed) and got[6] is None


def test_repeated_windows_with_many_distinct_words():
    ids = np.array([0, 1, 2, 9, 0, 1, 2, 7])
    assert quality.repeated_window_words(ids, 10) == 6
    assert quality.repeated_window_words(ids, 1 << 22) == 6   # the wide-vocabulary path


@given_tables
def test_quality_verdicts(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op9_quality_rules(spark, SF).join(labels, "doc_id").where("NOT base_failed")
    r = {(x["quality"], x["kept"]): x["count"] for x in got.groupBy("quality", "kept").count().collect()}
    assert r.get((1, False), 0) / r[1, True] < 0.01 and r.get((0, True), 0) / r[0, False] < 0.05


def test_quality_edge_rows(spark):
    edge = with_clashes(spark.createDataFrame(edge_rows(), DOCUMENTS))
    got = quality.assess(edge, None).collect()
    assert len(got) == len(edge_rows())
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["base_failed"] and not by_id[i]["kept"] and by_id[i]["n_words"] == 0 for i in (1, 2, 3))
    assert by_id[4]["n_words"] == 60_000 and by_id[4]["kept"]
    assert quality.assess(edge.limit(0), None).count() == 0
    labels = spark.createDataFrame([], "doc_id BIGINT, quality INT")
    assert quality.train(edge, labels) is None
