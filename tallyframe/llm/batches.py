"""Arrow batches of texts as flat byte arrays, and vectorised word splitting and hashing over them.

Text columns are processed whole. A null text counts as an empty one wherever an operator does not say otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Texts are handled in runs of rows of about this many bytes, so that work arrays stay small; one longer text is one run.
RUN_BYTES = 1 << 19
RUN_ROWS = 2048


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Text that Spark sends a Python worker at a time, and may hold there and in the JVM in several copies.
BATCH_BYTES = 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def with_small_batches(docs: DataFrame) -> DataFrame:
    """The same table, after its session's Arrow batches were limited to BATCH_BYTES, if they were larger. A limit given
    in another unit than bytes is someone's choice and stays."""
    spark = docs.sparkSession
    size = spark.conf.get(_SETTING).removesuffix("b")
    if size.isdigit() and int(size) > BATCH_BYTES:
        spark.conf.set(_SETTING, f"{BATCH_BYTES}b")
    return docs


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns every text operator needs, whatever else the table holds."""
    return with_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one more offset than texts)."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(batch: pa.RecordBatch, column: str = "text", run_bytes: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch cut into runs of at most RUN_ROWS rows and about ``run_bytes`` of text."""
    if not batch.num_rows:
        return
    _, offsets = flat(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + run_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), start + RUN_ROWS, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: an invertible scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Bytes that are hashed or compared at a time; longer spans than the second are compared one by one.
_GRAM, _LONG = 8, 1 << 10
_PLACE, _LENGTH, _JOIN = U64(0xD1342543DE82EF95), U64(0xA24BAED4963EE407), U64(0x9E3779B97F4A7C15)


def grams(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number, zeros after the end; a view that is read where it is indexed."""
    return np.ndarray((len(data),), "<u8", np.append(data, np.zeros(_GRAM, np.uint8)), strides=(1,))


def spread(left: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers left, left + 1, ... of each range, one range after the other."""
    return np.repeat(left - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans that depend on the bytes and their number alone.

    Eight bytes at a time are scrambled together with their place in the span, and the results are added up. A sum of
    powers of a base would be cheaper to take from running sums, but there are texts that make it collide for any base.
    """
    lengths = ends - starts
    counts = -(-lengths // _GRAM)
    held = grams(data)
    short = counts <= _FEW
    if short.all():
        out = _summed_by_place(held, starts, lengths)
    else:
        out = np.empty(len(starts), dtype=np.uint64)
        out[short] = _summed_by_place(held, starts[short], lengths[short])
        out[~short] = _summed_by_span(held, starts[~short], lengths[~short], counts[~short])
    return mix(out + lengths.astype(np.uint64) * _LENGTH)


#: Spans of so many grams, such as most words, are hashed gram by gram over all spans.
_FEW = 4
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(_GRAM + 1)], dtype=np.uint64)


def _summed_by_place(held: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), dtype=np.uint64)
    for low in range(0, len(starts), 1 << 14):  # work arrays stay in the processor's cache
        high, place = low + (1 << 14), 0
        which = np.flatnonzero(lengths[low:high]) + low
        while len(which):
            left = lengths[which] - _GRAM * place
            words = held[starts[which] + _GRAM * place] & _MASKS.take(np.minimum(left, _GRAM))
            place += 1
            out[which] += mix(words ^ mix(np.array([place], np.uint64) * _PLACE))
            which = which[left > _GRAM]
    return out


def _summed_by_span(held: np.ndarray, starts: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), dtype=np.uint64)
    for low, high in lots(counts, 1 << 20):  # work arrays stay small
        n = counts[low:high]
        place = spread(np.zeros(high - low, np.int64), n)
        left = np.repeat(lengths[low:high], n) - _GRAM * place
        words = held[np.repeat(starts[low:high], n) + _GRAM * place]
        words &= _MASKS.take(np.minimum(left, _GRAM))
        values = mix(words ^ mix((place + 1).astype(np.uint64) * _PLACE))
        out[low:high] = np.add.reduceat(values, np.cumsum(n) - n)
    return out


def lots(counts: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose counts add up to about ``most``; a larger one stands alone."""
    ends, low = np.cumsum(counts), 0
    while low < len(counts):
        high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, side="right"))
        high = max(high, low + 1)
        yield low, high
        low = high


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width`` bytes from each position on, eight at least: hashes of halves are scrambled together."""
    size = _GRAM
    held = mix(np.array(grams(data)[: max(0, len(data) - _GRAM + 1)]))
    while size < width:
        step = min(size, width - size)
        held = mix(held[: max(0, len(held) - step)] * _JOIN + held[step:])
        size += step
    return held


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether spans of two byte arrays are equal, byte for byte."""
    same = np.ones(len(lengths), dtype=bool)
    for i in np.flatnonzero(lengths > _LONG):
        same[i] = np.array_equal(a[a_at[i] : a_at[i] + lengths[i]], b[b_at[i] : b_at[i] + lengths[i]])
    of_a, of_b = grams(a), grams(b)
    open_, done = np.flatnonzero((lengths > 0) & (lengths <= _LONG)), 0
    while len(open_):
        left = np.minimum(lengths[open_] - done, _GRAM).astype(np.uint64)
        differ = of_a[a_at[open_] + done] ^ of_b[b_at[open_] + done]
        equal = (differ << (U64(8) * (U64(_GRAM) - left))) == 0
        same[open_[~equal]] = False
        done += _GRAM
        open_ = open_[equal]
        open_ = open_[lengths[open_] > done]
    return same


def lowered(data: np.ndarray) -> np.ndarray:
    """A to Z in lower case, all other bytes as they are."""
    return data + ((data - np.uint8(65)) < 26) * np.uint8(32)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal span of bytes other than blanks (0x20, 0x09 to 0x0D)."""
    inside = (data != 0x20) & ((data - np.uint8(0x09)) >= 5)
    edge = np.zeros(len(data) + 1, dtype=bool)
    if len(data):
        edge[0], edge[-1] = inside[0], inside[-1]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edges = np.flatnonzero(edge)
    # Where two texts meet within a span, the one ends and another starts.
    meet = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    meet = meet[inside[meet - 1] & inside[meet]].repeat(2)
    edges = np.insert(edges, np.searchsorted(edges, meet), meet)
    starts, ends = edges[::2], edges[1::2]
    return starts, ends, np.arange(len(offsets) - 1).repeat(np.diff(np.searchsorted(starts, offsets)))


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of n words; of all its words if there are fewer."""
    rows = len(offsets) - 1
    data = lowered(data)
    starts, ends, row = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    first = np.searchsorted(row, np.arange(rows + 1))
    joined = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(n):
        joined[: max(0, len(hashes) - k)] += hashes[k:] * U64((int(_JOIN) * (2 * k + 3)) & (2**64 - 1))
        joined = mix(joined) if k < n - 1 else joined
    joined = mix(joined)
    out = []
    for r in range(rows):
        a, b = first[r], first[r + 1]
        if b - a >= n:
            out.append(np.unique(joined[a : b - n + 1]))
        elif b > a:
            whole = U64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    whole = mix(np.array([whole * _JOIN + h], dtype=np.uint64))[0]
            out.append(np.array([whole], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
