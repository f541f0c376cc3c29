"""Language identification by partial matching: per language a tree of byte contexts of up to four bytes with escape
probabilities, frozen after training; the language whose tree gives a text the shortest code wins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.batches import U64, flat, id_and_text, read_table, runs
from tallyframe.llm.samples import labelled_sample, remainder, sized

#: Longest context in bytes.
ORDER = 4
#: Bounds of the training sample per language.
DOCS_PER_LANGUAGE = 600
BYTES_PER_LANGUAGE = 1 << 20
RUN_BYTES = 1 << 19


def grams(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """For each byte the number made of it and the n - 1 bytes before it; bytes before a text count as zero."""
    wide = data.astype(np.uint64)
    keys = wide.copy()
    since = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, n):
        before = np.zeros(len(data), dtype=np.uint64)
        before[k:] = wide[: max(0, len(data) - k)]
        before[since < k] = 0
        keys |= before << U64(8 * k)
    return keys


class Lookup:
    """Positions of 64-bit keys in a sorted array, through hash tables; -1 for keys that are not there."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.levels = keys, []
        left = np.arange(len(keys))
        while len(left):
            bits = max(4, int(4 * len(left)).bit_length())
            salt = U64(len(self.levels) + 1)
            slots = np.zeros(1 << bits, dtype=np.int32)
            at = self._slots(keys[left], salt, bits)
            slots[at] = left
            self.levels.append((salt, bits, slots))
            left = left[slots[at] != left]

    @staticmethod
    def _slots(keys: np.ndarray, salt: np.uint64, bits: int) -> np.ndarray:
        return ((keys + salt) * U64(0x9E3779B97F4A7C15) >> U64(64 - bits)).astype(np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        out = np.full(len(wanted), -1, dtype=np.int32)
        open_ = None
        for salt, bits, slots in self.levels:
            asked = wanted if open_ is None else wanted[open_]
            rows = slots[self._slots(asked, salt, bits)]
            hit = self.keys[rows] == asked
            if open_ is None:
                out[hit] = rows[hit]
                open_ = np.flatnonzero(~hit)
            else:
                out[open_[hit]] = rows[hit]
                open_ = open_[~hit]
            if not len(open_):
                break
        return out


class Trees:
    """Frozen code lengths, in bits, of every language."""

    def __init__(self, languages: list[str], symbols: list[tuple], contexts: list[tuple]):
        self.languages = languages
        self.symbols = [(Lookup(keys), costs) for keys, costs in symbols]  # by order, 0 first
        self.contexts = [(Lookup(keys), escapes) for keys, escapes in contexts]

    @classmethod
    def train(cls, samples: list[tuple[str, str]]) -> Trees:
        languages = sorted({lang for _, lang in samples})
        texts = {lang: flat(pa.array([t.lower() for t, own in samples if own == lang])) for lang in languages}
        symbols, contexts = [], []
        for order in range(ORDER + 1):
            counted = {lang: np.unique(grams(*texts[lang], order + 1), return_counts=True) for lang in languages}
            keys = np.unique(np.concatenate([k for k, _ in counted.values()]))
            above = np.unique(keys >> U64(8))
            costs = np.zeros((len(keys), len(languages)), dtype=np.float32)
            escapes = np.zeros((len(above), len(languages)), dtype=np.float32)
            below = np.full((len(keys), len(languages)), 8.0, dtype=np.float32)
            if order:
                shorter, known = symbols[-1]
                below = known[np.searchsorted(shorter, keys & U64((1 << 8 * order) - 1))]
            for column, lang in enumerate(languages):
                own, counts = counted[lang]
                seen = np.zeros(len(keys), dtype=np.int64)
                seen[np.searchsorted(keys, own)] = counts
                parent = np.searchsorted(above, keys >> U64(8))
                total = np.bincount(parent, seen, minlength=len(above))
                kinds = np.bincount(parent, seen > 0, minlength=len(above))
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
                    own_cost = np.log2((total + kinds)[parent] / seen)
                escapes[:, column] = escape
                costs[:, column] = np.where(seen > 0, own_cost, escape[parent] + below[:, column])
            symbols.append((keys, costs))
            contexts.append((above, escapes))
        return cls(languages, symbols, contexts)

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits that each language needs for each text."""
        bits = np.zeros((len(data), len(self.languages)), dtype=np.float32)
        keys = grams(data, offsets, ORDER + 1)
        left = np.arange(len(data))
        for order in range(ORDER, -1, -1):
            asked = keys[left] & U64((1 << 8 * (order + 1)) - 1)
            find, costs = self.symbols[order]
            rows = find(asked)
            hit = rows >= 0
            if hit.all() and order == ORDER:
                bits = costs[rows]
                left = left[:0]
                break
            bits[left[hit]] += costs[rows[hit]]
            left, asked = left[~hit], asked[~hit]
            if not len(left):
                break
            find, escapes = self.contexts[order]
            rows = find(asked >> U64(8))
            hit = rows >= 0
            bits[left[hit]] += escapes[rows[hit]]
        bits[left] += 8.0
        sums = np.zeros((len(offsets) - 1, len(self.languages)))
        filled = np.diff(offsets) > 0
        if filled.any():
            sums[filled] = np.add.reduceat(bits, offsets[:-1][filled], axis=0, dtype=np.float64)
        return sums


def predict_languages(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1: the posterior under equal priors) of every row of ``docs`` (doc_id, text).

    A null text, one without a letter, and every text if no language was learned, give ``und`` and 0. Texts are
    folded to lower case. Ties go to the first language in order. Rows are kept one for one; other columns are not
    read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in runs(batch, run_bytes=RUN_BYTES):
                texts = part.column("text").to_pylist()
                named, scores = ["und"] * len(texts), np.zeros(len(texts))
                lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], dtype=bool)
                if own and lettered.any():
                    bits = own.code_lengths(*flat(pc.utf8_lower(part.column("text"))))
                    best = bits.argmin(axis=1)
                    share = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
                    named = [own.languages[b] if ok else "und" for b, ok in zip(best, lettered)]
                    scores = np.where(lettered, share, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(named, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )

    return id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def train_trees(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Trees | None:
    """Trees of every non-null ``lang`` of ``docs`` (doc_id, text, lang), from a bounded sample of each; None without
    any. Rows with null doc_id, text or lang are left out."""
    samples = labelled_sample(docs, sized(docs, "lang"), "lang", docs_per_language, BYTES_PER_LANGUAGE)
    samples = [(text, lang) for text, lang in samples if any(map(str.isalpha, text))]
    return Trees.train(samples) if samples else None


def op6_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned outside the held-out fold; see ``train_trees`` and ``predict_languages`` for
    awkward rows."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = remainder(3) == 1
    trees = train_trees(docs.select("doc_id", "text", "lang").where(~held_out))
    made = predict_languages(docs, trees)
    return made.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
