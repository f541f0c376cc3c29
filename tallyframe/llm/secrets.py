"""Secret scan: an Aho-Corasick automaton finds keywords, anchored expressions run at its hits alone, and tokens that
carry a checksum are checked against it."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.batches import flat, id_and_text, lowered, read_table, runs, with_small_batches

#: Kinds in the order that breaks ties between spans with one start.
KINDS = ("assign", "access", "hex", "checked_token", "web_token")
BASE_KINDS = KINDS[:3]
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Prefixes of tokens whose last six characters are a checksum of the thirty before them.
CHECKED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
HEX_LENGTH = 32

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
WEB_TOKEN = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum_digits(body: str) -> str:
    """CRC-32 of the body in base 62, six digits."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = DIGITS[digit] + digits
    return digits


def is_json_header(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except ValueError:
        return False


@lru_cache(maxsize=1)
def keywords() -> ahocorasick.Automaton:
    """Over lower-cased text; each keyword names the kind it may begin."""
    made = ahocorasick.Automaton()
    found = [(w, "assign") for w in ASSIGN_WORDS] + [("akia", "access")]
    found += [(w, "checked_token") for w in CHECKED_PREFIXES] + [("eyj", "web_token")]
    for word, kind in found:
        made.add_word(word, (kind, len(word)))
    made.make_automaton()
    return made


def keyword_spans(text: str, low: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span that begins with a keyword; spans of one kind do not overlap.

    ``low`` is the text with A to Z lowered and all else as it is, so that positions agree.
    """
    spans, free = [], dict.fromkeys(KINDS, 0)
    # By start; the automaton reports ends.
    hits = sorted((end - size + 1, kind) for end, (kind, size) in keywords().iter(low))
    for start, kind in hits:
        if start < free[kind]:
            continue
        if kind == "assign":
            if match := ASSIGN.match(text, start):
                free[kind] = match.end()
                if len(match[2]) >= 8:
                    spans.append((kind, start, match.end()))
        elif kind == "access":
            if match := ACCESS.match(text, start):
                free[kind] = match.end()
                if len(match[0]) >= 16:
                    spans.append((kind, start, match.end()))
        elif kind == "checked_token":
            if (match := CHECKED.match(text, start)) and checksum_digits(match[1][:30]) == match[1][30:]:
                free[kind] = match.end()
                spans.append((kind, start, match.end()))
        elif (match := WEB_TOKEN.match(text, start)) and is_json_header(match[1]):
            free[kind] = match.end()
            spans.append((kind, start, match.end()))
    return spans


@lru_cache(maxsize=1)
def _hex_bytes() -> np.ndarray:
    inside = np.zeros(256, dtype=bool)
    inside[[*b"0123456789abcdef"]] = True
    return inside


def hex_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end (in bytes of the whole) of every longest run of lower-case hex digits of 32 or more."""
    inside = _hex_bytes()[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    long = ends - starts >= HEX_LENGTH
    starts, ends = starts[long], ends[long]
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def spans_of(texts: pa.Array) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) in characters of every secret of each text, by start, then kind as listed."""
    data, offsets = flat(texts)
    low = lowered(data).tobytes()
    found = [
        keyword_spans(text, low[a:b].decode()) if text else []
        for text, a, b in zip(texts.to_pylist(), offsets[:-1], offsets[1:])
    ]
    for row, start, end in zip(*hex_spans(data, offsets)):
        before = data[offsets[row] : start]
        at = int(((before & 0xC0) != 0x80).sum())
        found[row].append(("hex", at, at + int(end - start)))
    for spans in found:
        spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) in characters, of every row of ``docs`` (doc_id, text).

    Spans are ordered by start, then kind as listed; spans of one kind do not overlap, those of two kinds may. A null
    text counts as an empty one and has no spans. Rows are kept one for one, also those without doc_id and repeated
    ones; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch):
                found = spans_of(part.column("text"))
                at = np.concatenate([[0], np.cumsum([len(s) for s in found])])
                each = [{"kind": k, "start": a, "end": b} for spans in found for k, a, b in spans]
                spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(each, SPAN))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), spans], names=["doc_id", "spans"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, spans array<struct<kind string, start int, end int>>")


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` (doc_id, text, ...) with every secret in a text replaced by a mark; overlapping spans give one mark.

    All columns and rows stay; n_chars, if there, follows the text. Null texts stay null.
    """
    names = docs.columns
    text_at = names.index("text")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch):
                texts = part.column("text").to_pylist()
                found = [[s[1:] for s in spans] for spans in spans_of(part.column("text"))]
                cut = [_without(text, sorted(spans), mark) if spans else text for text, spans in zip(texts, found)]
                columns = part.columns
                columns[text_at] = pa.array(cut, part.schema.field(text_at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    made = with_small_batches(docs).mapInArrow(run, schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        made = made.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind)))
    return made


def _without(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, done = [], 0
    for start, end in spans:
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]])


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""

    def joined(spans):
        written = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.concat_ws(",", written)

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(joined(of(*BASE_KINDS)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents; nulls, empties and repeats are as for the scan."""
    return digest(find_secrets(read_table(spark, sf_dir, "documents")))
