"""Trained operators: exact code lengths, held-out accuracy, and awkward documents."""

import collections
import math

import numpy as np
import pyarrow as pa
import pytest

import cases
from tallyframe.llm import langid, lm_scoring, quality, toxicity
from tallyframe.llm.batches import flat

SF = "/root/testdata/sf0.01"


def plain_code_lengths(samples, texts):
    languages = sorted({lang for _, lang in samples})
    counted = {lang: [collections.defaultdict(collections.Counter) for _ in range(5)] for lang in languages}
    for text, lang in samples:
        data = b"\0" * 4 + text.lower().encode()
        for i in range(4, len(data)):
            for k in range(5):
                counted[lang][k][data[i - k : i]][data[i]] += 1
    out = []
    for text in texts:
        data, row = b"\0" * 4 + text.lower().encode(), []
        for lang in languages:
            bits = 0.0
            for i in range(4, len(data)):
                for k in range(4, -1, -1):
                    seen = counted[lang][k].get(data[i - k : i])
                    if not seen:
                        continue
                    total, kinds = sum(seen.values()), len(seen)
                    if data[i] in seen:
                        bits += math.log2((total + kinds) / seen[data[i]])
                        break
                    bits += math.log2((total + kinds) / kinds)
                else:
                    bits += 8
            row.append(bits)
        out.append(row)
    return np.array(out)


def test_code_lengths_are_exact():
    samples = [("the cat and the hat", "en"), ("le chat et le chapeau", "fr"), ("that is it", "en")]
    texts = ["the chat", "", "xyz", "日本", "le"]
    trees = langid.Trees.train(samples)
    assert trees.code_lengths(*flat(pa.array(texts))) == pytest.approx(plain_code_lengths(samples, texts), rel=1e-5)


def test_languages_of_held_out_documents(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in langid.op6_ppm_language(spark, SF).collect() if r.held_out]
    assert np.mean([langs[r.doc_id] == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_awkward_documents(spark):
    docs = cases.awkward(spark)
    trees = langid.train_trees(docs)
    assert trees.languages == ["en", "fr"]
    rows = langid.predict_languages(docs, trees).collect()
    assert len(rows) == len(cases.AWKWARD)
    named = {r.doc_id: r.lang_pred for r in rows}
    assert named[3] == named[4] == named[5] == "und" and named[1] == "en"
    assert langid.train_trees(cases.empty(spark)) is None
    assert {r.lang_pred for r in langid.predict_languages(docs, None).collect()} == {"und"}


def test_toxicity_of_held_out_documents(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [r for r in toxicity.op4_compression_toxicity(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    toxic = np.array([labels[r.doc_id] for r in rows])
    scores = np.array([r.score for r in rows])
    assert ((scores >= 0) & (scores <= 1)).all()
    assert [r.predicted for r in rows] == [int(s >= 0.3) for s in scores]
    order = scores[toxic == 1][:, None] - scores[toxic == 0][None, :]
    # 329 toxic documents to learn from; README has the figures of larger tables.
    assert ((order > 0) + 0.5 * (order == 0)).mean() > 0.65
    assert (scores[toxic == 0] >= 0.3).mean() < 0.05


def test_toxicity_of_awkward_documents(spark):
    docs = cases.awkward(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 0), (9, 1), (None, 1), (6, None), (10, 0), (10, 0)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == len(cases.AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.train(docs, labels.where("toxic = 0")) == 0.0
    assert toxicity.train(cases.empty(spark), labels) == 0.0
    assert toxicity.score_toxicity(cases.empty(spark), 0.5).collect() == []
    assert {r.predicted for r in toxicity.score_toxicity(docs, 0.5).collect()} == {1}


def test_quality_without_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in quality.op3_quality_classifier(spark, SF).collect() if r.doc_id in labels]
    good = [r.keep for r in rows if labels[r.doc_id] == 1]
    bad = [r.keep for r in rows if labels[r.doc_id] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.25


def test_em_finds_the_rates_of_labellers():
    random = np.random.default_rng(1)
    good = random.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.8, 0.7] + [0.9] * (len(quality.LABELLERS) - 4))
    said = np.where(random.random((len(good), len(right))) < right, good[:, None], ~good[:, None])
    prior, rates = quality.estimate(2 * said.astype(int), np.ones(len(good)))
    assert prior[1] == pytest.approx(0.8, abs=0.02)
    assert rates[1, :, 2] == pytest.approx(right, abs=0.03)


def test_quality_of_awkward_documents(spark):
    docs = cases.awkward(spark)
    model = quality.train(docs)
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == len(cases.AWKWARD)
    assert not any(r.keep for r in rows if r.doc_id in (3, 4, 5))
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in rows)
    assert quality.train(cases.empty(spark)) is None
    assert quality.keep_good(docs, None).count() == 0


def test_probabilities_of_the_network_add_up():
    network = lm_scoring.Network()
    around = np.full((4, lm_scoring.CODES), 7, dtype=np.int32)
    p = np.exp(network.log_probabilities(np.arange(lm_scoring.CODES), around))
    assert p.sum() == pytest.approx(1, abs=1e-3)


def test_gradient_of_the_network():
    random = np.random.default_rng(2)
    network = lm_scoring.Network()
    codes, around = random.integers(0, 4096, 300), random.integers(0, 4097, (4, 300))
    squares = np.full_like(network.flat, 1e-2)
    before = network.log_probabilities(codes, around).mean()
    for _ in range(30):
        network.train(codes, around, squares)
    assert network.log_probabilities(codes, around).mean() > before + 2


def test_neighbours_do_not_cross_texts():
    around = lm_scoring.contexts(np.array([1, 2, 3, 4]), np.array([0, 0, 1, 1]))
    none = lm_scoring.CODES
    assert around.tolist() == [[none] * 4, [none, 1, none, 3], [2, none, 4, none], [none] * 4]


def test_lm_scores_ordinary_text_above_shuffled_words(spark):
    sentence = "the house on the hill was old and grey".split()
    rows = [(i, " ".join(sentence * 30), "en") for i in range(60)]
    docs = cases.documents(spark, rows)
    model = lm_scoring.train(docs)
    shuffled = [sentence[(5 * k) % 9] for k in range(9)]
    scored = {
        r.doc_id: r for r in lm_scoring.score_documents(
            cases.documents(spark, [(1, " ".join(sentence), "en"), (2, " ".join(shuffled), "en"), (3, None, None)]), model
        ).collect()
    }
    assert scored[1].n_words == scored[2].n_words == 9
    assert scored[1].log_likelihood > scored[2].log_likelihood
    assert (scored[3].n_words, scored[3].log_likelihood, scored[3].mean_log_likelihood) == (0, 0.0, None)


def test_lm_on_awkward_documents(spark):
    docs = cases.awkward(spark)
    rows = lm_scoring.score_documents(docs, lm_scoring.train(docs)).collect()
    assert len(rows) == len(cases.AWKWARD) and all(r.log_likelihood <= 0 for r in rows)
    assert lm_scoring.train(cases.empty(spark)) is None
    assert lm_scoring.score_documents(docs, None).count() == len(cases.AWKWARD)


class Shared:
    def __init__(self, value):
        self.value = value


def test_lm_trains_on_every_word():
    texts = ["to be or not to be", None, "", "that is the question to be asked"]
    hashes, _ = lm_scoring.word_hashes(*flat(pa.array(texts)))
    coder = lm_scoring.Coder([int(h) for h in np.unique(hashes).view(np.int64)])
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    (made,) = lm_scoring._trained(Shared(lm_scoring.Network().flat), Shared(coder))(iter([batch]))
    assert set(made.column("n").to_pylist()) == {len(hashes)}


def test_lm_learns_from_a_table_of_few_words(spark):
    docs = cases.documents(spark, [(1, "a cat sat here", "en")])
    model = lm_scoring.train(docs)
    assert model is not None
    (row,) = lm_scoring.score_documents(docs, model).collect()
    assert row.mean_log_likelihood > -math.log(lm_scoring.CODES)


def test_lm_words_of_a_shared_code_have_probabilities_of_their_own(spark):
    common = [f"c{i}" for i in range(lm_scoring.COMMON)]
    rare = [f"r{i}" for i in range(400)]
    new = [f"new{'x' * (i % 7)}{i}" for i in range(400)]
    docs = cases.documents(spark, [(1, " ".join(common * 3 + rare[:200] * 2 + rare[200:]), "en")])
    model = lm_scoring.train(docs)
    words = rare + new
    hashes, _ = lm_scoring.word_hashes(*flat(pa.array(words)))
    pool = model.coder(hashes)
    assert (pool >= lm_scoring.COMMON).all()
    rows = lm_scoring.score_documents(cases.documents(spark, [(i, w, None) for i, w in enumerate(words)]), model).collect()
    said = {r.doc_id: r.log_likelihood for r in rows}
    assert len(rows) == len(words)
    for code in np.unique(pool):
        own = np.flatnonzero(pool == code)
        twice, once, never = ([said[i] for i in own if a <= i < b] for a, b in ((0, 200), (200, 400), (400, 800)))
        network = model.network.log_probabilities(np.array([code]), np.full((4, 1), lm_scoring.CODES))[0]
        counted = 2 * len(twice) + len(once)
        assert twice == pytest.approx([network + math.log(2 / (counted + len(twice) + len(once)))] * len(twice))
        assert once == pytest.approx([network + math.log(1 / (counted + len(twice) + len(once)))] * len(once))
        assert all(n < o for n in never for o in once)
        assert sum(math.exp(s - network) for s in twice + once + never) <= 1 + 1e-6
        longest = [len(words[i]) for i in own if i >= 400]
        assert len({round(s, 6) for s in never}) > 1 or len(set(longest)) < 2


def test_lm_keeps_repeated_rows_one_for_one(spark):
    text = " ".join(f"w{i}" for i in range(5000))
    docs = cases.documents(spark, [(1, text, "en"), (1, text, "en"), (1, "w1 w4999", "en"), (None, text, "en"), (None, text, "en")])
    rows = lm_scoring.score_documents(docs, lm_scoring.train(docs)).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in rows) == [(0, 5000), (0, 5000), (1, 2), (1, 5000), (1, 5000)]
    assert len({round(r.log_likelihood, 3) for r in rows}) == 2
