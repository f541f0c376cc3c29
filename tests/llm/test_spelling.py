"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

import cases
from tallyframe.llm import spelling


def words_of(rows, spoilt):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            check = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if spoilt and check % spoilt == 0:
                at = check % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def expected(counts):
    forms, out = {}, []
    close = {w: [v for v in counts if v != w and near(w, v)] for w in counts}
    for word, others in close.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[word] = best if best is not None and counts[best] >= 5 * counts[word] else None
    for word, n in counts.items():
        root = word
        while forms[root] is not None:
            root = forms[root]
        out.append((word, forms[word], root, n, len(close[word]), counts.get(forms[word])))
    return sorted(out)


def found(table):
    assert dict(table.dtypes) == {
        "word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint",
    }
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in table.collect())


@pytest.mark.parametrize("letters", ["ab", "abcé", "aÿ÷×"])
def test_neighbours_are_those_of_all_pairs(spark, letters):
    random.seed(len(letters))
    words = {"".join(random.choice(letters) for _ in range(random.choice([6, 7, 8, 9, 10, 70, 71]))) for _ in range(250)}
    words |= {w[:i] + w[i + 1 :] for w in words if len(w) > 60 for i in (0, 30, 69)}
    counts = {w: random.choice([5, 6, 25, 30, 125, 150, 3000]) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling.spelling_variants(table)) == expected(counts)


def test_chains_of_forms_lead_to_the_last(spark):
    counts = {"stones": 5 * 5**6, "stonez": 5**6, "stonezz": 5**5, "stonezzz": 5**4, "stonezzzz": 5**3, "stonezzzzz": 25, "alone!": 5}
    got = found(spelling.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == expected(counts)
    assert {r[2] for r in got} == {"stones", "alone!"}


@pytest.mark.parametrize("spoilt", [None, 3, 199])
def test_words_of_whole_documents(spark, spoilt):
    random.seed(1)
    text = ["Straße", "strasse", "ÉLÈVE", "éléveur", "running", "Running", "short", "x" * 300, "naïvely", "naively", "日本語abcdefg"]
    rows = [(i, " ".join(random.choices(text, k=random.choice([0, 1, 40, 400]))), "en") for i in range(40)]
    rows += [rows[0], (None, "running " * 50, None), (None, None, None), (7, "naïvely/naively;straße", "de")]
    docs = cases.documents(spark, rows + cases.AWKWARD)
    counts = words_of(rows + cases.AWKWARD, spoilt)
    table = spelling.words_of(docs, spoilt)
    assert {r.word: r.n for r in table.collect()} == counts
    assert found(spelling.spelling_variants(table)) == expected(counts)


def test_empty_tables(spark):
    assert found(spelling.spelling_variants(spelling.words_of(cases.empty(spark), 199))) == []
    assert found(spelling.spelling_variants(spelling.words_of(cases.documents(spark, [(1, None, None)]), 199))) == []


def test_the_query_equals_all_pairs_on_a_small_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs.where("lang = 'en'").limit(60).write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()]
    counts = words_of(rows, spelling.SPOILT)
    assert found(spelling.op11_spelling_variants(spark, str(tmp_path))) == expected(counts)
