"""Quality and toxicity scores against plain versions, word by word and window by window."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import cases
from tallyframe.llm import quality, toxicity
from tallyframe.llm.batches import flat, mix, span_hashes

MARKS = set(b"#$%&*!|<>{}[]^~@\\=_")


def texts():
    random.seed(5)
    words = ["plain", "WORDS", "Mixed", "a$b", "###", "end!", "123", "4x4", "été", "x", "UPPERl", "AAAAb", "日本"]
    made = [" ".join(random.choices(words, k=random.choice([1, 2, 7, 60]))) for _ in range(60)]
    return made + [t for _, t, *_ in cases.AWKWARD if t is not None and len(t) < 5000] + ["same same same", "a b", "\t"]


def words_of(text):
    return [w for w in re.split(rb"[\x20\x09-\x0d]+", text.encode()) if w]


def kinds(word):
    upper = sum(65 <= b <= 90 for b in word)
    lower = sum(97 <= b <= 122 or b >= 128 for b in word)
    return upper, lower, sum(b in MARKS for b in word)


def plain_measures(text):
    words = words_of(text)
    if not words:
        return [0.0] * len(quality.MEASURES)
    sums, seen, before = [0] * len(quality.MEASURES), set(), None
    for word in words:
        upper, lower, marks = kinds(word)
        letters = upper + lower
        votes = (
            upper > 1 and lower <= upper // 4, marks > 0, marks > 0 and letters > 0 and word[-1] in MARKS,
            marks > 0 and letters == 0, word in seen, word == before, letters > 0 and marks == 0,
        )
        sums = [s + v for s, v in zip(sums, votes)]
        seen.add(word)
        before = word
    return [s / len(words) for s in sums]


def plain_shapes(text):
    counts, words = [0] * quality.BUCKETS, words_of(text)
    for word in words:
        symbols = bytes(
            ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in word
        )
        shape = bytes(b for i, b in enumerate(symbols) if i == 0 or b != symbols[i - 1])
        hashed = span_hashes(np.frombuffer(shape, np.uint8), np.array([0]), np.array([len(shape)]))
        counts[int(mix(hashed)[0] % np.uint64(quality.BUCKETS))] += 1
    return [c / max(1, len(words)) for c in counts]


def test_measures_are_those_of_single_words():
    every = texts()
    measures, shapes = quality.measured(*flat(pa.array(every)))
    for text, own, shape in zip(every, measures, shapes):
        assert own.tolist() == pytest.approx(plain_measures(text)), text
        assert shape.tolist() == pytest.approx(plain_shapes(text)), text


def plain_vote(text):
    value = dict(zip(quality.MEASURES, plain_measures(text)))
    return [(vote + 1 if least <= value[name] < most else 1) for name, vote, least, most in quality.LABELLERS]


def plain_em(votes, rounds):
    """EM over single texts instead of patterns."""
    good = [1 / (1 + math.exp(-2 * (v.count(2) - 2 * v.count(0)))) for v in votes]
    for _ in range(rounds):
        weight = [[1 - g for g in good], good]
        prior = [(sum(w) + 1) / (len(good) + 2) for w in weight]
        rates = []
        for w in weight:
            per = []
            for j in range(len(votes[0])):
                cast = [sum(x for x, v in zip(w, votes) if v[j] == k) + 0.5 for k in range(3)]
                per.append([c / sum(cast) for c in cast])
            rates.append(per)
        odds = [
            math.log(prior[1] / prior[0]) + sum(math.log(rates[1][j][k] / rates[0][j][k]) for j, k in enumerate(v)) for v in votes
        ]
        good = [1 / (1 + math.exp(-max(-500, min(500, o)))) for o in odds]
    return good


def test_posteriors_and_scores_of_the_quality_model(spark):
    every = [t for t in texts() if words_of(t)]
    docs = cases.documents(spark, [(i, t, None) for i, t in enumerate(every)])
    model = quality.train(docs)
    got = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    believed = plain_em([plain_vote(t) for t in every], quality.EM_ROUNDS)
    for i, text in enumerate(every):
        row = [1.0, *[4 * math.sqrt(x) for x in plain_measures(text)], *[2 * math.sqrt(x) for x in plain_shapes(text)]]
        odds = sum(a * b for a, b in zip(row, model.weights))
        score = 1 / (1 + math.exp(-max(-30, min(30, odds))))
        assert got[i].posterior == pytest.approx(believed[i], abs=1e-5)
        assert got[i].score == pytest.approx(score, rel=1e-5) and got[i].keep == (got[i].score >= quality.LEAST_SCORE)


def test_toxicity_scores_are_those_of_single_windows(spark):
    random.seed(6)
    toxic_words, words = ["vile", "scum", "wretch", "filth"], ["river", "stone", "house", "garden", "letter", "summer"]

    def text(toxic):
        return " ".join(random.choices(words + toxic_words * 3 if toxic else words, k=random.choice([3, 30, 120])))

    samples = [(text(k % 2), k % 2) for k in range(200)]
    scorer = toxicity.fit(samples, 0.3)
    own = {label: toxicity._compressor(d) for label, d in ((1, scorer.toxic), (0, scorer.ordinary))}
    every = [t for t, _ in samples[:40]] + ["", "ß", "VILE SCUM", "x" * 500]
    got = {r.doc_id: r for r in toxicity.score_toxicity(cases.documents(spark, [(i, t, None) for i, t in enumerate(every)]), scorer).collect()}
    for i, t in enumerate(every):
        raw, gains, start = t.lower().encode(), [], 0
        while True:
            window = toxicity.MARKER + raw[start : start + toxicity.WINDOW]
            gains.append(len(own[0].compress(window)) - len(own[1].compress(window)))
            start += toxicity.STRIDE
            if start >= len(raw) - toxicity.WINDOW + toxicity.STRIDE:
                break
        reached = [sum(g >= step for g in gains) for step in toxicity.STEPS]
        top = sorted(gains)[-3:]
        row = [1.0, *[10 * c / len(gains) for c in reached], *[min(c, 10) / 10 for c in reached], max(top) / 8, sum(top) / len(top) / 8]
        odds = sum(a * b for a, b in zip(row, scorer.weights))
        score = 1 / (1 + math.exp(-max(-30, min(30, odds))))
        assert got[i].score == pytest.approx(score) and got[i].predicted == int(got[i].score >= 0.3)
