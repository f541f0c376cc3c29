"""Bounded samples of documents, whatever ids and sizes there are."""

import cases
from tallyframe.llm import quality, samples


def sample(spark, rows, per_label=5, max_bytes=1000):
    docs = cases.documents(spark, rows)
    return samples.labelled_sample(docs, samples.sized(docs, "lang"), "lang", per_label, max_bytes)


def test_a_hot_id_counts_once(spark):
    rows = [(i, f"text {i}", "en") for i in range(20)] + [(7, "text 7", "en")] * 300 + [(8, f"longer text {k}", "en") for k in range(200)]
    found = sample(spark, rows, per_label=30)
    assert sorted(found) == sorted((f"text {i}", "en") for i in range(20))
    assert sample(spark, rows, per_label=4) == sample(spark, rows[:20], per_label=4)


def test_the_smallest_document_of_a_label_is_always_taken(spark):
    rows = [(i, "x" * (2000 + i), "de") for i in range(9)] + [(50 + i, "short", "en") for i in range(3)]
    found = sample(spark, rows)
    assert [len(t) for t, lang in found if lang == "de"] == [2000]
    assert sum(lang == "en" for _, lang in found) == 3


def test_parts_do_not_change_the_sample(spark, monkeypatch):
    rows = [(i, f"text {i}", "en") for i in range(400)]
    one = sample(spark, rows, per_label=50, max_bytes=10**6)
    monkeypatch.setattr(samples, "PARTS", 3)
    assert sample(spark, rows, per_label=50, max_bytes=10**6) == one and len(one) == 50


def test_nothing_to_sample(spark):
    assert sample(spark, []) == sample(spark, [(1, None, "en"), (None, "x", "en"), (2, "x", None)]) == []


def test_quality_training_takes_an_id_once(spark):
    rows = [(i, f"Some words make a text {i}, and so it goes on." * (1 + i % 3), "en") for i in range(30)]
    model = quality.train(cases.documents(spark, rows))
    hot = quality.train(cases.documents(spark, rows + [rows[3]] * 200))
    assert (model.weights != 0).any() and hot.weights.shape == model.weights.shape
