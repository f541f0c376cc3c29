"""Decontamination, top-k search, repeated substrings and the pipeline."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import cases
import corpus_pipeline
from tallyframe.llm import decontamination, substring_dedup, topk_search
from tallyframe.llm.batches import flat


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row


@pytest.fixture(scope="module")
def benchmark_items(spark, sf_dir):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id").collect()]


def planted(items, hosts, share, n=60):
    random.seed(5)
    texts, which = [], []
    for _ in range(n):
        k = random.randrange(len(items))
        letters = list(items[k])
        for _ in range(int(share * len(letters))):
            at, what = random.randrange(len(letters)), random.random()
            if what < 0.34:
                letters[at] = random.choice("etaoin")
            elif what < 0.67:
                del letters[at]
            else:
                letters.insert(at, random.choice("etaoin"))
        host = random.choice(hosts)
        cut = host.find(" ", len(host) // 2)
        texts.append(f"{host[:cut]} {''.join(letters)} {host[cut:]}")
        which.append(k)
    return texts, which


@pytest.mark.parametrize(("share", "recall"), [(0.0, 1.0), (0.02, 0.97), (0.05, 0.9)])
def test_recall_of_edited_items(spark, benchmark_items, share, recall):
    hosts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(200).collect() if len(r.text or "") > 300]
    texts, which = planted(benchmark_items, hosts, share)
    docs = cases.documents(spark, [(i, t, "en") for i, t in enumerate(texts)])
    items = spark.createDataFrame(list(enumerate(benchmark_items)), "item_id long, text string")
    found = decontamination.contaminated(docs, items).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    assert np.mean([(i, k) in pairs for i, k in enumerate(which)]) >= recall
    for r in found[:25]:
        window = decontamination.normalised(*flat(pa.array([texts[r.doc_id][r.start : r.end]])))[0].tobytes()
        item = decontamination.normalised(*flat(pa.array([benchmark_items[r.item_id]])))[0].tobytes()
        assert edits(item.strip(), window)[-1] == r.edits <= 0.1 * len(item)


def test_clean_documents_are_left_alone(spark, benchmark_items):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.createDataFrame(list(enumerate(benchmark_items)), "item_id long, text string")
    low = [" ".join(t.lower().split()) for t in benchmark_items]
    held = {r.doc_id for r in docs.collect() if any(t in " ".join((r.text or "").lower().split()) for t in low)}
    assert {r.doc_id for r in decontamination.contaminated(docs, items).collect()} == held
    assert decontamination.drop_contaminated(docs, items).count() == docs.count() - len(held)


def test_several_passes_over_a_large_benchmark(spark, benchmark_items, monkeypatch):
    monkeypatch.setattr(decontamination, "PASS_BYTES", 4000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.createDataFrame(list(enumerate(benchmark_items)), "item_id long, text string")
    several = {tuple(r) for r in decontamination.contaminated(docs, items).collect()}
    monkeypatch.setattr(decontamination, "PASS_BYTES", 1 << 20)
    assert {r[:2] for r in several} == {tuple(r)[:2] for r in decontamination.contaminated(docs, items).collect()}


def test_awkward_documents_and_items(spark):
    long = "a passage of a benchmark that is long enough to tell something"
    items = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (None, long), (4, long), (4, long), (5, long + " ")], "item_id long, text string")
    docs = cases.awkward(spark).unionByName(cases.documents(spark, [(20, f"x {long.upper()} y", "en"), (None, long, None), (21, long, None)]))
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}
    assert found == {(20, 4), (20, 5), (None, 4), (None, 5), (21, 4), (21, 5)}
    assert decontamination.drop_contaminated(docs, items).count() == len(cases.AWKWARD)
    assert decontamination.contaminated(docs, items.where("item_id < 0")).collect() == []
    assert decontamination.contaminated(cases.empty(spark), items).collect() == []


def test_items_that_follow_no_blank(spark):
    english = "what is the boiling point of water at the level of the sea?"
    chinese = "下列哪一个选项最准确地描述了水在海平面上的沸点以及它随高度的变化"
    edited = chinese.replace("准", "正").replace("高", "深")
    items = spark.createDataFrame([(1, english), (2, chinese)], "item_id long, text string")
    rows = [
        (1, f"question:{english} yes", {1}), (2, f"<b>{english}</b>", {1}), (3, f"xyzxyzxyz{english}", {1}), (4, f"a\u00a0{english}", {1}),
        (5, f"前面的句子没有空格{chinese}后面的句子", {2}), (6, f"前面的句子没有空格{edited}后面的句子", {2}), (7, f"前文\u3000{english}", {1}),
        (8, "question:" + english.replace("boiling", "boilin").replace("what", "that"), {1}), (9, "前面的句子没有空格后面的句子", set()),
    ]
    docs = cases.documents(spark, [(i, t, None) for i, t, _ in rows])
    found = decontamination.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, k) for i, _, held in rows for k in held}
    texts = {i: t for i, t, _ in rows}
    assert all(r.edits or texts[r.doc_id][r.start : r.end] in (english, chinese) for r in found)
    assert [r.doc_id for r in decontamination.drop_contaminated(docs, items).collect()] == [9]


def edited(text, edits, kinds, random_):
    """The text with so many bytes replaced, put in or taken out."""
    letters = list(text)
    for at in random_.sample(range(len(letters)), edits):
        kind = random_.choice(kinds)
        letters[at] = {"replaced": "q", "put in": letters[at] + "q", "taken out": ""}[kind]
    return "".join(letters)


@pytest.mark.parametrize("kinds", [["replaced"], ["replaced", "put in", "taken out"]], ids=["replaced", "mixed"])
@pytest.mark.parametrize("size", [10, 16, 24, 30, 40, 60, 100, 150, 200, 300, 390, 1000, 2000])
def test_recall_of_edited_items_by_length(size, kinds):
    random_ = random.Random(size)
    alphabet = "etaoinshrdlu "
    texts = []
    for _ in range(200 if size <= 400 else 60):
        texts.append("x" + "".join(random_.choice(alphabet) for _ in range(size - 2)).replace("  ", " e") + "z")
    data, offsets, _ = decontamination.normalised(*flat(pa.array(texts)))
    items = decontamination.Items(np.arange(len(texts)), data, offsets[:-1], np.diff(offsets))
    docs = [f"before it {edited(text, size // 10, kinds, random_)} and after it" for text in texts]
    found = decontamination.matches(items, *decontamination.normalised(*flat(pa.array(docs)))[:2])
    assert np.mean([k in found[1, found[0] == k] for k in range(len(docs))]) >= 0.93


def test_short_items_are_found_verbatim(spark):
    items = spark.createDataFrame([(1, "What is 2+2?"), (2, "Yes"), (3, "水的沸点")], "item_id long, text string")
    docs = cases.documents(spark, [(1, "q:what is  2+2?", None), (2, "yesterday eyes", None), (3, "oh yes.", None), (4, "他说水的沸点很高", None), (5, "yes", None)])
    found = {(r.doc_id, r.item_id, r.edits) for r in decontamination.contaminated(docs, items).collect()}
    assert found == {(1, 1, 0), (3, 2, 0), (4, 3, 0), (5, 2, 0)}


def plain_top(rows, k):
    """All rows are candidates; those of one id share a ranking."""
    out = []
    for q in sorted({i for i, _ in rows if i % 20 == 0}):
        asked = [v for i, v in rows if i == q]
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for own in asked for i, v in rows if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return out


def test_top_k_with_ties_and_gaps(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "GROUP_ROWS", 64)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 8)
    monkeypatch.setattr(topk_search, "BLOCK", 16)
    random_ = np.random.default_rng(3)
    rows = [(int(7 * i), [float(x) for x in random_.integers(-2, 3, 4)]) for i in range(300)]
    rows += [(5000 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(60)]
    odd = [(9001, None), (9002, [None, 1.0]), (9003, [float("nan")]), (9004, [float("inf")]), (None, [1.0]), (9005, [2.0]), (9006, [])]
    table = spark.createDataFrame(rows + odd + rows[:5], "vec_id long, embedding array<float>")
    vectors = topk_search.integer_vectors(table)
    whole = [(i, [64 * x for x in v]) for i, v in rows + rows[:5] + [(9005, [2.0]), (9006, [])]]
    found = topk_search.top_k(vectors.where("vec_id % 20 = 0"), vectors, 20).collect()
    assert sorted(map(tuple, found)) == plain_top(whole, 20)


def test_top_k_of_little(spark):
    table = spark.createDataFrame([(20, [0.5, -0.26]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    vectors = topk_search.integer_vectors(table)
    assert [tuple(r) for r in topk_search.top_k(vectors.where("vec_id % 20 = 0"), vectors, 20).collect()] == [(20, 1, 1, 960)]
    none = vectors.where("vec_id < 0")
    assert topk_search.top_k(none, vectors, 20).collect() == topk_search.top_k(vectors, none, 20).collect() == []


def test_search_query_against_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = sorted(duckdb.sql(topk_search.ORACLE).fetchall())
    assert sorted(map(tuple, topk_search.op7_block_topk_search(spark, sf_dir).collect())) == want


def plain_removal(texts):
    size, starts = substring_dedup.LENGTH, {}
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - size + 1):
            starts[d[i : i + size]] = starts.get(d[i : i + size], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, dtype=int)
        for i in range(len(d) - size + 1):
            if starts[d[i : i + size]] > 1:
                gone[i] += 1
                gone[i + size] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        begins = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out.append((len(d), int(gone.sum()), begins, hashlib.sha256(kept).hexdigest()))
    return out


def repeated_texts(spark):
    random.seed(4)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect() if len(r.text or "") < 4000][:90]
    passage = "".join(random.choice("abcdef ") for _ in range(900))
    for _ in range(50):
        a = random.randrange(0, 400)
        b = random.randrange(a + 380, 900)
        host = random.choice(texts[:60])
        cut = random.randrange(len(host) + 1)
        texts.append(host[:cut][:300] + passage[a:b] + host[cut:][:300])
    texts += ["a" * 1000, "ab" * 700, "ab" * 300 + "c" + "ab" * 300, None, "", "x" * 399, "x" * 400, "é" * 300, texts[0], texts[0], passage + passage]
    return texts


@pytest.mark.parametrize("group", [1 << 14, 3])
def test_repeats_against_all_strings(spark, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP_UNITS", group)
    texts = repeated_texts(spark)
    docs = cases.documents(spark, [(i, t, "en") for i, t in enumerate(texts)]).repartition(3)
    rows = sorted(map(tuple, substring_dedup.remove_repeats(docs).collect()))
    assert [r[1:] for r in rows] == plain_removal(texts)


def test_repeats_in_awkward_documents(spark):
    rows = substring_dedup.remove_repeats(cases.awkward(spark)).collect()
    want = plain_removal([t for _, t, _ in cases.AWKWARD])
    assert sorted((str(r.doc_id), *r[1:]) for r in rows) == sorted((str(i), *w) for (i, *_), w in zip(cases.AWKWARD, want))
    assert substring_dedup.remove_repeats(cases.empty(spark)).collect() == []


def test_repeats_query_on_the_given_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = dict(zip(texts, plain_removal(texts.values())))
    for r in substring_dedup.op10_repeated_substrings(spark, sf_dir).collect():
        assert tuple(r[1:]) == want[r.doc_id]


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "secret_scan", "bpe_encoding"]
    counts, at = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.stored(stage(spark, at, "/root/testdata/sf0.01"), name)
        assert at.schema.simpleString() == docs.schema.simpleString()
        counts.append(at.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4]
    last = corpus_pipeline.STAGES[-1][1](spark, at, "")
    assert last.count() == counts[4] and last.where("size(ids) <> n_tokens").count() == 0


def test_pipeline_stages_take_awkward_documents(spark):
    docs = cases.awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, "/root/testdata/sf0.001")
        assert made.columns == docs.columns, name
        assert made.count() <= len(cases.AWKWARD)
        assert stage(spark, cases.empty(spark), "/root/testdata/sf0.001").count() == 0
    near = {r.doc_id: r for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()}
    assert 2 not in near and 1 in near
    assert len([1 for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect() if r.doc_id == 7]) == 2


def test_top_k_over_repeated_ids_equals_its_sql(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(int(i), (rng.integers(-3, 4, 8) / 4).tolist(), 0) for i in rng.integers(0, 45, 160)]
    schema = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in topk_search.op7_block_topk_search(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(connection.execute(topk_search.ORACLE).fetchall())


def test_blocks_are_skipped_on_clustered_vectors(monkeypatch):
    rng = np.random.default_rng(7)
    centres = rng.integers(-60, 60, (32, 64))
    rows = centres[rng.integers(0, 32, 8192)] + rng.integers(-4, 5, (8192, 64))
    queries = rows[:50]
    ids = rng.permutation(8192)
    scored = []
    product = topk_search._product
    monkeypatch.setattr(topk_search, "_product", lambda a, b: scored.append(len(a) * len(b)) or product(a, b))

    def found(order):
        scored.clear()
        q, i, s = topk_search.search(queries, ids[:50], rows[order], ids[order], 20)
        held = sum(n for n in scored[2:])  # the first two are the bounds
        return sorted(zip(q.tolist(), i.tolist(), s.tolist())), held / (50 * 8192)

    by_curve, share = found(topk_search._along_curve(rows, ids))
    by_id, plain_share = found(np.argsort(ids))
    assert by_curve == by_id
    assert share < 0.2 < plain_share
