"""Byte-level BPE with the tokenizers library: encoding with offsets, and decoding through the reversed byte table.

A text is split by the usual pattern (contractions, runs of letters, numbers and other signs each with one blank
before them, blanks). Each distinct piece of a run of texts goes through the tokenizers library once; ids and offsets
of whole texts are then put together from its pieces with numpy.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer, pre_tokenizers

from tallyframe.llm.batches import flat, id_and_text, read_table, runs, same_bytes, span_hashes, spread

VOCABULARY = "byte_bpe_50k.json"
#: Pieces whose ids a worker keeps between runs of texts.
KEPT_PIECES = 1 << 18
RUN_BYTES = 1 << 20
_LETTER, _NUMBER, _BLANK, _OTHER = range(4)


def byte_table() -> list[str]:
    """The character that stands for each byte: itself if it prints, or else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, following = [""] * 256, 256
    for byte in range(256):
        if byte in prints:
            table[byte] = chr(byte)
        else:
            table[byte], following = chr(following), following + 1
    return table


class Encoder:
    """Ids and byte offsets of texts. Made once in each worker."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        # The pieces come split already.
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.classes = np.full(sys.maxunicode + 1, 255, dtype=np.uint8)
        reverse = {char: byte for byte, char in enumerate(byte_table())}
        size = self.library.get_vocab_size()
        self.bytes_of = [
            bytes(map(reverse.__getitem__, token)) if set(token) <= reverse.keys() else token.encode()
            for token in map(self.library.id_to_token, range(size))
        ]
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.known: dict[bytes, np.ndarray] = {}

    def char_classes(self, points: np.ndarray) -> np.ndarray:
        found = self.classes[points]
        for point in np.unique(points[found == 255]):
            char = chr(point)
            if regex.match(r"\s", char):
                kind = _BLANK
            elif regex.match(r"\p{L}", char):
                kind = _LETTER
            elif regex.match(r"\p{N}", char):
                kind = _NUMBER
            else:
                kind = _OTHER
            self.classes[point] = kind
        return self.classes[points]

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where, in bytes, each piece of each text begins, as the pattern splits them."""
        if not len(data):
            return np.zeros(0, dtype=np.int64)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each character
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        kinds = self.char_classes(points)
        n = len(points)
        first = np.zeros(n, dtype=bool)  # of a text
        first[np.searchsorted(at, offsets[:-1][offsets[:-1] < len(data)])] = True
        last = np.append(first[1:], True)
        run_start = np.ones(n, dtype=bool)
        run_start[1:] = (kinds[1:] != kinds[:-1]) | first[1:]
        blank = kinds == _BLANK
        # Blanks before another sign: the last of them stands apart, and if it is a space it leads the next piece.
        ends_blanks = blank & ~last & np.append(~blank[1:], True)
        begins = run_start | ends_blanks
        leads = ends_blanks & (points == 32)
        begins[1:] &= ~leads[:-1]
        # Contractions take part of what follows an apostrophe that begins a piece.
        for q in np.flatnonzero((points == 39) & begins):
            if leads[q - 1] and q > 0 and not first[q]:
                continue
            self._contraction(points, first, begins, q)
        return at[begins]

    @staticmethod
    def _contraction(points: np.ndarray, first: np.ndarray, begins: np.ndarray, q: int) -> None:
        n = len(points)
        ends = [k for k in range(q + 1, min(q + 3, n)) if not first[q + 1 : k + 1].any()]
        said = "".join(chr(points[k]) for k in ends)
        size = 1 if said[:1] in ("s", "t", "m", "d") and said else 2 if said in ("re", "ve", "ll") else 0
        if not size:
            return
        begins[q + 1] = False
        after = q + size + 1
        if after < n:
            begins[q + 2 : after] = False
            begins[after] = True

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids begin."""
        starts = self.pieces(data, offsets)
        ends = np.append(starts[1:], len(data))
        raw = data.tobytes()
        one, which = self._alike(data, starts, ends)
        distinct = [raw[starts[i] : ends[i]] for i in one]
        missing = [piece for piece in distinct if piece not in self.known]
        made = self.library.encode_batch_fast([piece.decode() for piece in missing], add_special_tokens=False)
        fresh = {piece: np.array(e.ids, dtype=np.uint32) for piece, e in zip(missing, made)}
        ids_of = [self.known[p] if p in self.known else fresh[p] for p in distinct]
        if len(self.known) + len(fresh) > KEPT_PIECES:
            self.known = {}
        if len(fresh) <= KEPT_PIECES:
            self.known.update(fresh)
        counts = np.array([len(x) for x in ids_of], dtype=np.int64)
        held = np.concatenate([*ids_of, np.zeros(0, np.uint32)]).astype(np.uint32)
        where = np.concatenate([[0], np.cumsum(counts)])
        ids = held[spread(where[:-1][which], counts[which])]
        piece_at = np.concatenate([[0], np.cumsum(counts[which])])
        return ids, piece_at[np.searchsorted(starts, offsets)]

    @staticmethod
    def _alike(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One of each distinct piece, and which of these every piece is, byte for byte."""
        _, one, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        lengths, first = ends - starts, one[which]
        again = np.flatnonzero(first != np.arange(len(first)))
        if (lengths == lengths[first]).all() and same_bytes(data, starts[again], data, starts[first[again]], lengths[again]).all():
            return one, which
        raw, numbers = data.tobytes(), {}  # two pieces have one hash
        which = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(starts, ends)])
        return np.unique(which, return_index=True)[1], which

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.all_bytes[spread(self.starts[ids], self.lengths[ids])]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """(start, end) in characters of each token of one text; tokens that share a split character all cover it."""
        ends = np.cumsum(self.lengths[ids])
        data = self.decode(ids)
        leading = (data & 0xC0) != 0x80
        before = np.concatenate([[0], np.cumsum(leading)])
        starts = ends - self.lengths[ids]
        inside = np.append(~leading, False)[starts]  # begins within a character
        return np.stack([before[starts] - inside, before[ends]], axis=1)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) and offsets (array of start and end in characters) of every text.

    A null text counts as an empty one; an empty text has no ids. Rows are kept one for one, also those without
    doc_id and repeated ones; other columns are not read.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in runs(batch, run_bytes=RUN_BYTES):
                ids, at = own.encode(*flat(part.column("text")))
                spans = [own.offsets(ids[at[r] : at[r + 1]]) for r in range(part.num_rows)]
                flat_spans = np.concatenate([*spans, np.zeros((0, 2), np.int64)]).astype(np.int32)
                pairs = pa.StructArray.from_arrays(
                    [pa.array(flat_spans[:, 0].copy()), pa.array(flat_spans[:, 1].copy())], names=["start", "end"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pairs),
                    ],
                    names=["doc_id", "ids", "offsets"],
                )

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>, offsets array<struct<start int, end int>>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, data (binary) and text of every array ``ids``. Bytes that are no whole character read as U+FFFD in
    text; null ids count as none."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            made = [own.decode(np.array(ids or [], dtype=np.int64)).tobytes() for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(made, pa.binary()), pa.array([b.decode(errors="replace") for b in made])],
                names=["doc_id", "data", "text"],
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary, text string")


def round_trip(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers) and
    decoded_sha256 (of the bytes that the ids decode to); and the ids themselves where asked for.

    Nulls, empty texts and repeated rows are treated as by ``encode``.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in runs(batch, run_bytes=RUN_BYTES):
                ids, at = own.encode(*flat(part.column("text")))
                each = [ids[at[r] : at[r + 1]] for r in range(part.num_rows)]
                columns = [
                    part.column("doc_id"),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each]),
                    pa.array([hashlib.sha256(own.decode(x).tobytes()).hexdigest() for x in each]),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    return id_and_text(docs).mapInArrow(run, schema)


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of all documents; nulls, empties and repeats are as for ``encode``."""
    return round_trip(read_table(spark, sf_dir, "documents"))
