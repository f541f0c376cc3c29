"""Toxicity by compression distance: one zstandard dictionary trained on toxic text and one on ordinary text; windows of
a text that shrink more with the toxic one speak for toxicity.

Ordinary prose fills toxic documents too, so each dictionary is trained on those stretches of its own class whose
byte sequences are over-represented against the other class. A marker that both dictionaries hold leads every window:
it makes zstandard write a compressed block for any window, so that lengths of two dictionaries compare.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.batches import U64, flat, id_and_text, read_table, runs
from tallyframe.llm.langid import grams
from tallyframe.llm.samples import labelled_sample, remainder, sized
from tallyframe.session import stored

#: Bounds of the labelled sample per class that dictionaries and calibration are fitted on.
DOCS_PER_CLASS = 3000
BYTES_PER_CLASS = 8 << 20
WINDOW, STRIDE = 32, 24
MARKER = bytes([1, 2, 3, 4, 5, 6, 7, 14])
DICTIONARY_BYTES = 6144
#: A sequence of this many bytes stands out if it occurs in so many documents of its class, in so large a share of
#: them, and in so many times the share of the other class.
SEQUENCE = 6
LEAST_DOCS, LEAST_SHARE, LEAST_RATIO = 6, 0.02, 20
#: Differences, in bytes, whose shares among the windows of a text are its features.
STEPS = (2, 3, 4, 6)
#: Features: a constant, shares at each step, capped counts at each step, largest, mean of the three largest.
N_FEATURES = 1 + 2 * len(STEPS) + 2
THRESHOLD = 0.3


def _document_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    each = [np.unique(grams(*flat(pa.array([t], pa.binary())), SEQUENCE)[SEQUENCE - 1 :]) for t in texts]
    return np.unique(np.concatenate([*each, np.zeros(0, np.uint64)]), return_counts=True)


def _standing_out(own, n_own: int, other, n_other: int) -> np.ndarray:
    keys, counts = own
    at = np.searchsorted(other[0], keys)
    found = np.append(other[0], U64(0))[at] == keys
    elsewhere = np.where(found, np.append(other[1], 0)[at], 0)
    often = counts >= max(LEAST_DOCS, LEAST_SHARE * n_own)
    return keys[often & (counts / n_own >= LEAST_RATIO * (elsewhere + 0.5) / n_other)]


def _stretches(texts: list[bytes], keys: np.ndarray) -> list[bytes]:
    out = []
    for text in texts:
        hits = np.isin(grams(*flat(pa.array([text], pa.binary())), SEQUENCE), keys)
        if not hits.any():
            continue
        covered = np.zeros(len(text) + 2, dtype=np.int8)
        for k in range(SEQUENCE):  # a hit stands at the last byte of its sequence
            covered[1 : len(text) + 1 - k] |= hits[k:]
        edges = np.flatnonzero(np.diff(covered))
        out += [text[a:b] for a, b in zip(edges[::2], edges[1::2])]
    return out


def _dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary's content; the samples themselves where they are too few to train on."""
    try:
        made = zstandard.train_dictionary(size, samples, k=32, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        made = b"".join(sorted(set(samples)))
    return MARKER + made[-size:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(
        compression_level=3, strategy=zstandard.STRATEGY_DFAST, min_match=4, search_log=4, target_length=32,
        window_log=17, hash_log=13, chain_log=13, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=settings)


class Windows:
    """Features of texts under a pair of dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(toxic).compress, _compressor(ordinary).compress

    def features(self, text: bytes) -> np.ndarray:
        toxic, ordinary = self.toxic, self.ordinary
        gains = []
        for start in range(0, max(1, len(text) - WINDOW + STRIDE), STRIDE):
            window = MARKER + text[start : start + WINDOW]
            gains.append(len(ordinary(window)) - len(toxic(window)))
        gain = np.array(gains)
        counts = np.array([(gain >= step).sum() for step in STEPS])
        top = np.sort(gain)[-3:]
        return np.concatenate(
            [[1.0], 10 * counts / len(gain), np.minimum(counts, 10) / 10, [top[-1] / 8, top.mean() / 8]]
        )


@dataclass
class Scorer:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        own = Windows(self.toxic, self.ordinary)
        rows = np.array([own.features(t) for t in texts]).reshape(len(texts), N_FEATURES)
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights, -30, 30)))


def fit_logistic(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton's method; column 0 is the constant and is hardly penalised."""
    ridge = np.full(rows.shape[1], penalty)
    ridge[0] = 1e-3
    found = np.zeros(rows.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ found, -30, 30)))
        slope = rows.T @ (weights * (p - labels)) + ridge * found
        curve = (rows * (weights * p * (1 - p))[:, None]).T @ rows + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        found -= step
        if np.abs(step).max() < 1e-8:
            break
    return found


def fit(samples: list[tuple[str, int]], share_toxic: float) -> Scorer:
    """Dictionaries from one half of the samples, calibration from the other; with under 40 of a class, from all.

    ``share_toxic`` is the share of toxic rows among all labelled ones; the sample may have another.
    """
    by = {label: [t.lower().encode() for t, own in samples if own == label] for label in (0, 1)}
    halved = min(map(len, by.values())) >= 40
    training = {label: texts[::2] if halved else texts for label, texts in by.items()}
    counted = {label: _document_counts(texts) for label, texts in training.items()}
    parts = {}
    for label, other in ((1, 0), (0, 1)):
        keys = _standing_out(
            counted[label], max(1, len(training[label])), counted[other], max(1, len(training[other]))
        )
        parts[label] = _stretches(training[label], keys)
    # The ordinary dictionary also holds ordinary text at large, lest chance matches favour the toxic one.
    parts[0] += [text[i : i + 8] for text in training[0][:600] for i in range(0, len(text), 64)]
    toxic = _dictionary(parts[1])
    ordinary = _dictionary(parts[0], max(256, len(toxic) - len(MARKER)))  # of the same size, or chances differ
    held = {label: texts[1::2] if halved else texts for label, texts in by.items()}
    own = Windows(toxic, ordinary)
    rows = np.array([own.features(t) for label in (0, 1) for t in held[label]]).reshape(-1, N_FEATURES)
    labels = np.repeat([0.0, 1.0], [len(held[0]), len(held[1])])
    shares = np.array([1 - share_toxic, share_toxic])
    weights = np.concatenate([np.full(len(held[k]), shares[k] / max(1, len(held[k]))) for k in (0, 1)])
    return Scorer(toxic, ordinary, fit_logistic(rows, labels, weights * len(labels)))


def train(docs: DataFrame, labels: DataFrame) -> Scorer | float:
    """A scorer fitted on a bounded sample of ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic); the share of toxic
    rows itself where one class is missing. Rows with null doc_id, text or label are left out. Of repeated labels of a
    document one is taken."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = stored(sized(docs).where("doc_id IS NOT NULL AND size IS NOT NULL").join(known, "doc_id"), "labelled")
    share = usable.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if share is None or share in (0.0, 1.0):
        return share or 0.0
    return fit(labelled_sample(docs, usable, "toxic", DOCS_PER_CLASS, BYTES_PER_CLASS), share)


def score_toxicity(docs: DataFrame, scorer: Scorer | float) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.3 on) of every row of ``docs`` (doc_id, text).

    A null text counts as an empty one, which is scored like any other. Rows are kept one for one; other columns
    are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in runs(batch):
                data, offsets = flat(pc.utf8_lower(part.column("text")))
                raw = data.tobytes()
                if isinstance(own, Scorer):
                    scores = own.scores([raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])])
                else:
                    scores = np.full(part.num_rows, own)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"]
                )

    made = id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return made.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels outside the held-out fold; see ``train`` and ``score_toxicity`` for
    awkward rows."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = remainder(4) == 2
    known = labels.select("doc_id", "toxic").where(~held_out)
    scorer = train(docs, known)
    made = score_toxicity(docs, scorer)
    return made.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
