"""Spans of texts that make sums of powers collide, whatever the base."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

import cases
from tallyframe.llm import bpe, decontamination, near_dedup, substring_dedup
from tallyframe.llm.batches import same_bytes, span_hashes, window_hashes


def thue_morse(letters: int, a: str = "a", b: str = "b") -> str:
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(letters))


@pytest.mark.parametrize("letters", [64, 1024, 2048, 4096])
def test_hashes_of_equal_length_words_and_their_complements(letters):
    word, other = thue_morse(letters), thue_morse(letters, "b", "a")
    data = np.frombuffer((word + other + word).encode(), np.uint8)
    starts = np.arange(3) * letters
    a, b, c = span_hashes(data, starts, starts + letters)
    assert a != b and a == c
    windows = window_hashes(data, letters)
    assert windows[0] == windows[2 * letters] != windows[letters]
    lengths = np.full(2, letters)
    assert same_bytes(data, starts[:2], data, starts[[2, 2]], lengths).tolist() == [True, False]


def test_span_hashes_depend_on_the_bytes_alone():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    starts = rng.integers(0, 3900, 6000)
    ends = starts + rng.integers(0, 30, 6000)
    held = {}
    for a, b, h in zip(starts, ends, span_hashes(data, starts, ends)):
        assert held.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(held.values())) == len(held)


@pytest.mark.parametrize("letters", [1024, 2048])
def test_bpe_of_such_words(spark, letters):
    rows = [(1, thue_morse(letters), "en"), (2, thue_morse(letters, "b", "a"), "en"), (3, "x " + thue_morse(letters), "en")]
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.round_trip(cases.documents(spark, rows).coalesce(1)).collect()}
    for i, text, _ in rows:
        ids = np.array(library.encode_ordinary(text), dtype="<u4")
        assert got[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(bpe, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    own = bpe.Encoder(public_tokenizers.path(bpe.VOCABULARY))
    text = "one two  three one 😀 two"
    data = np.frombuffer(text.encode(), np.uint8)
    ids, _ = own.encode(data, np.array([0, len(data)]))
    assert own.decode(ids).tobytes() == text.encode()


@pytest.mark.parametrize("letters", [1024, 2048])
def test_such_words_are_no_copies(spark, letters):
    word, other = thue_morse(letters), thue_morse(letters, "b", "a")
    docs = cases.documents(spark, [(1, word, "en"), (2, other, "en"), (3, f"{word} {word} z", "en"), (4, f"{other} {other} z", "en")])
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs.coalesce(1), 2, 80).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    benchmark = spark.createDataFrame([(7, word)], "item_id long, text string")
    found = {r.doc_id: r.edits for r in decontamination.contaminated(docs, benchmark).collect()}
    assert found == {1: 0, 3: 0}


@pytest.mark.parametrize("letters", [1024, 2048])
def test_substrings_of_such_words(spark, letters):
    rows = [(1, thue_morse(letters), "en"), (2, thue_morse(letters, "b", "a"), "en"), (3, thue_morse(letters, "c", "d"), "en")]
    times = {}
    for _, text, _ in rows:
        for k in range(len(text) - 399):
            times[text[k : k + 400]] = times.get(text[k : k + 400], 0) + 1
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(cases.documents(spark, rows)).collect()}
    for i, text, _ in rows:
        gone = set()
        for k in range(len(text) - 399):
            if times[text[k : k + 400]] > 1:
                gone |= set(range(k, k + 400))
        assert got[i] == len(gone)
