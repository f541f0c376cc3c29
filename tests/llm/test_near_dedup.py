"""Near duplicates against all pairs on full sets."""

import random
import re

import numpy as np
import pytest

import cases
from tallyframe.llm import near_dedup
from tallyframe.llm.components import components
from tallyframe.llm.fast_sketch import sketches


def word_sets(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < n else [tuple(words[i : i + n]) for i in range(len(words) - n + 1)])


def expected(rows, n, percent):
    sets = [word_sets(text, n) for _, text, *_ in rows]
    leads = {i: i for i, *_ in rows}

    def lead(i):
        while leads[i] != i:
            i = leads[i]
        return i

    for a, (i, *_) in enumerate(rows):
        for b, (j, *_) in enumerate(rows[:a]):
            x, y = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((lead(i), lead(j)))
                leads[high] = low
    return sorted(
        (str(i), len(s), str(lead(i) if i is not None else None), i is None or lead(i) == i) for (i, *_), s in zip(rows, sets)
    )


def found(table):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in table.collect())


def near_copies():
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(6):
        base = [random.choice(vocabulary) for _ in range(random.choice([12, 60, 150]))]
        for _ in range(14):
            copy = list(base)
            for _ in range(random.randrange(0, 1 + len(base) // 7)):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            rows.append((len(rows) + 1, " ".join(copy), "en"))
    return rows


@pytest.mark.parametrize("words", [2, 5])
def test_against_all_pairs(spark, words):
    rows = near_copies()
    assert found(near_dedup.near_duplicates(cases.documents(spark, rows), words)) == expected(rows, words, 80)


def test_large_buckets_are_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 4)
    rows = near_copies()
    assert found(near_dedup.near_duplicates(cases.documents(spark, rows), 2)) == expected(rows, 2, 80)


def test_more_candidates_than_the_bitmap_holds(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MAX_BITS", 1)
    rows = near_copies()[:30]
    assert found(near_dedup.near_duplicates(cases.documents(spark, rows), 2)) == expected(rows, 2, 80)


def test_awkward_documents(spark):
    assert found(near_dedup.near_duplicates(cases.awkward(spark), 2)) == expected(cases.AWKWARD, 2, 80)


def test_no_documents(spark):
    assert near_dedup.near_duplicates(cases.empty(spark)).collect() == []


def test_query_on_the_given_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert found(near_dedup.op1_minhash_near_dedup(spark, sf_dir)) == expected(rows, 2, 80)


def test_sketches_estimate_similarity():
    random_ = np.random.default_rng(0)
    for size in (5, 400):
        alike = []
        for _ in range(40):
            common = random_.integers(0, 2**63, 4 * size).astype(np.uint64)
            more = random_.integers(0, 2**63, size).astype(np.uint64)
            a, b = sketches([common, np.concatenate([common, more])], 128)
            assert (a != np.uint64(2**64 - 1)).all()
            alike.append((a == b).mean())
        assert np.mean(alike) == pytest.approx(0.8, abs=0.03)


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (8, 10)], "a long, b long")
    assert {(r.node, r.component) for r in components(links).collect()} == {
        (2, 2), (3, 2), (4, 2), (5, 2), (8, 8), (9, 8), (10, 8),
    }
    assert components(links.where("a < 0")).collect() == []


@pytest.mark.parametrize("count", [1, 2, 3, 4])
def test_a_single_document_of_few_words(spark, count):
    rows = [(1, " ".join("abcd"[:count]), "en")]
    assert found(near_dedup.near_duplicates(cases.documents(spark, rows), 5)) == expected(rows, 5, 80)


def test_rows_that_repeat_an_id_are_one_node(spark):
    text = {i: " ".join(f"w{(k * (1 + i // 3)) % 97}" for k in range(60 + i % 3)) for i in range(9)}
    rows = [(i, text[i], "en") for i in range(9)] + [(i % 2, text[i % 2], "en") for i in range(400)]
    assert found(near_dedup.near_duplicates(cases.documents(spark, rows), 5, 80)) == expected(rows, 5, 80)


def test_members_of_a_hubs_small_buckets_are_compared_once(spark):
    """40 buckets with hub 0, of which every pair of members stays apart; 5000 stands for an id with very many texts."""
    buckets = {b: [0, *range(1 + b % 20, 8 + b % 20)] for b in range(40)}
    buckets |= {100 + b: [5000, 5001 + b, 5002 + b] for b in range(near_dedup.BANDS + 1)}
    buckets |= {200: [0, *range(10_000, 10_000 + near_dedup.SMALL_BUCKET)], 201: [1, *range(20_000, 20_000 + 2 * near_dedup.CHUNK)]}
    rows = [(n, b, min(m), len(m)) for b, m in buckets.items() for n in m]
    shared = spark.createDataFrame(rows, "node long, bucket long, hub long, size long")
    blocks = near_dedup._still_apart(shared, spark.createDataFrame([(3, 0), (0, 0)], "node long, component long")).collect()
    together = {}
    for r in blocks:
        together.setdefault((r.merged, r.group, r.low, r.high), []).append(r)
    assert sorted(r.node for r in together[True, 0, 0, 0]) == [0, *range(1, 27)]
    assert {r.node: r.component for r in together[True, 0, 0, 0]}[3] == 0
    assert max(len(block) for block in together.values()) <= 2 * near_dedup.CHUNK + 200
    held = [({r.node for r in block if r.side < 1}, {r.node for r in block if r.side}) for block in together.values()]
    for members in buckets.values():
        few = members[:30]
        assert all(any((a in x and b in y) or (b in x and a in y) for x, y in held) for a in few for b in few if a < b)
