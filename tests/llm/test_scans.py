"""Secrets and byte-level BPE, against plain expressions and another library."""

import base64
import hashlib
import random
import re

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

import cases
from tallyframe.llm import bpe, secrets
from tallyframe.llm.batches import flat


def plain_spans(text):
    out = [("assign", m.start(), m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in secrets.ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def base(spans):
    return [tuple(s) for s in spans if s[0] in secrets.BASE_KINDS]


def test_spans_of_random_texts():
    random.seed(1)
    parts = ["password", "PASSWD", "Secret", "ſecret", "toKen", "toKen", "api_key", "apikey", "AKIA", "A", "K", "Z9", "é",
             "日", " ", "=", ":", '"', "'", "abcdef12", "0123456789abcdef" * 2, "f", "AKIAABCDEFGHIJKL", "\n", "İ"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 25))) for _ in range(4000)]
    assert [base(s) for s in secrets.spans_of(pa.array(texts))] == [plain_spans(t) for t in texts]


def test_checksums_decide_on_tokens_that_carry_one():
    body = "a1B2" * 7 + "zz"
    good, bad = f"ghp_{body}{secrets.checksum_digits(body)}", f"ghp_{body}AAAAAA"
    header = base64.urlsafe_b64encode(b'{"alg":"none"}').decode().rstrip("=")
    spans = secrets.spans_of(pa.array([f"x {good} {bad}", f"{header}.e30.sig", "eyJxx.e30.sig"]))
    assert spans[0] == [("checked_token", 2, 2 + len(good))]
    assert [s[0] for s in spans[1]] == ["web_token"] and spans[2] == []


def test_digest_of_awkward_documents(spark):
    made = secrets.digest(secrets.find_secrets(cases.awkward(spark)))
    assert made.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    found = sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in made.collect())
    want = []
    for i, text, _ in cases.AWKWARD:
        spans = plain_spans(text or "")
        counts = [sum(s[0] == kind for s in spans) for kind in secrets.BASE_KINDS]
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((str(i), *counts, hashlib.sha256(written.encode()).hexdigest()))
    assert found == sorted(want)
    assert secrets.find_secrets(cases.empty(spark)).collect() == []


def test_redaction_keeps_all_else(spark):
    docs = cases.awkward(spark)
    rows = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert docs.columns == secrets.redact(docs).columns and len(rows) == len({r[0] for r in cases.AWKWARD})
    assert rows[10].text == "[SECRET] [SECRET] [SECRET]" and rows[10].n_chars == len(rows[10].text)
    assert rows[3].text is None and rows[4].text == "" and rows[9].text == cases.AWKWARD[-2][1]
    assert secrets.redact(cases.empty(spark)).count() == 0


def test_query_against_plain_expressions(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in secrets.op2_secret_scan(spark, sf_dir).collect():
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()


@pytest.fixture(scope="module")
def other():
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_of_random_texts(other):
    own = bpe.encoder(public_tokenizers.path(bpe.VOCABULARY))
    random.seed(0)
    signs = "ab's'tre vll 1²\n\t  　é日!?.'😀‍<|endoftext|>\x00\x1c\x85"
    texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 30))) for _ in range(6000)]
    texts += ["<|endoftext|>", "", "", "'s", "a's", "!'s", " 's", "\n's", "x'll'd"]
    ids, at = own.encode(*flat(pa.array(texts)))
    for k, text in enumerate(texts):
        mine = ids[at[k] : at[k + 1]]
        assert mine.tolist() == other.encode_ordinary(text), repr(text)
        assert own.decode(mine).tobytes() == text.encode()


def test_offsets_cover_split_characters():
    own = bpe.encoder(public_tokenizers.path(bpe.VOCABULARY))
    text = "日😀a é"
    ids, _ = own.encode(*flat(pa.array([text])))
    spans = own.offsets(ids)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for token, (a, b) in zip(ids, spans):
        assert own.bytes_of[token] in text[a:b].encode()


def test_round_trip_of_awkward_documents(spark, other):
    found = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(cases.awkward(spark)).collect())
    want = []
    for i, text, _ in cases.AWKWARD:
        ids = other.encode_ordinary(text or "")
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((str(i), len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(want)
    encoded = bpe.encode(cases.awkward(spark))
    back = sorted((str(r.doc_id), r.text) for r in bpe.decode(encoded).collect())
    assert back == sorted((str(i), t or "") for i, t, _ in cases.AWKWARD)
    assert bpe.round_trip(cases.empty(spark)).collect() == bpe.decode(bpe.encode(cases.empty(spark))).collect() == []


def test_query_on_the_given_documents(spark, sf_dir, other):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in bpe.op9_bpe_round_trip(spark, sf_dir).collect():
        packed = b"".join(x.to_bytes(4, "little") for x in other.encode_ordinary(texts[r.doc_id]))
        assert r.ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
