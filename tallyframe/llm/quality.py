"""Quality by weak labels: heuristic labellers vote or abstain, expectation-maximisation estimates how each votes on good
and on bad texts, and the posterior labels train a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.batches import (
    U64, flat, id_and_text, mix, read_table, runs, span_hashes, with_small_batches, word_spans,
)

#: Measures of a text, each a share of its words.
MEASURES = ("shouted", "marked", "trailing_signs", "bare_signs", "repeated", "echoed", "lettered")
#: (measure, vote, least, most): a labeller votes for good (1) or bad (-1) if the measure lies within.
LABELLERS = (
    ("shouted", -1, 0.30, 2.0),
    ("marked", -1, 0.25, 2.0),
    ("trailing_signs", -1, 0.20, 2.0),
    ("bare_signs", -1, 0.15, 2.0),
    ("echoed", -1, 0.20, 2.0),
    ("repeated", -1, 0.75, 2.0),
    ("lettered", -1, -1.0, 0.50),
    ("lettered", 1, 0.90, 2.0),
    ("marked", 1, -1.0, 0.03),
    ("echoed", 1, -1.0, 0.03),
)
#: Hashed word shapes of the linear scorer, and how many documents it is fitted on at most.
BUCKETS = 512
TRAIN_DOCS = 8000
EM_ROUNDS = 200
LEAST_SCORE = 0.3

_UPPER, _LOWER, _DIGIT, _SIGN, _MARK = range(5)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _SIGN, dtype=np.uint8)
    kinds[65:91] = _UPPER
    kinds[97:123] = kinds[128:] = _LOWER
    kinds[48:58] = _DIGIT
    kinds[[*b"#$%&*!|<>{}[]^~@\\=_"]] = _MARK
    return kinds


KINDS = _byte_kinds()
#: Shapes: letters of one case, digits and each sign are one symbol, of which a run counts once.
SHAPES = np.where(KINDS == _UPPER, ord("A"), np.where(KINDS == _LOWER, ord("a"), np.where(KINDS == _DIGIT, ord("0"), np.arange(256)))).astype(np.uint8)


def measured(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the measures, and the shares of its words' hashed shapes. A text without words has zeros."""
    rows = len(offsets) - 1
    measures, shapes = np.zeros((rows, len(MEASURES))), np.zeros((rows, BUCKETS), dtype=np.float32)
    starts, ends, row = word_spans(data, offsets)
    if not len(starts):
        return measures, shapes
    words = np.bincount(row, minlength=rows)

    def share(per_word: np.ndarray) -> np.ndarray:
        return np.bincount(row, per_word, minlength=rows) / np.maximum(words, 1)

    kinds = KINDS[data]
    before = {kind: np.concatenate([[0], np.cumsum(kinds == kind)]) for kind in (_UPPER, _LOWER, _MARK)}
    upper, lower, marks = (before[k][ends] - before[k][starts] for k in (_UPPER, _LOWER, _MARK))
    hashes = span_hashes(data, starts, ends)
    same_row = np.append(False, row[1:] == row[:-1])
    order = np.lexsort((hashes, row))
    again = np.append(False, (hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1]))
    columns = (
        (upper > 1) & (lower <= upper // 4),
        marks > 0,
        (marks > 0) & (upper + lower > 0) & (KINDS[data[ends - 1]] == _MARK),
        (marks > 0) & (upper + lower == 0),
    )
    for k, column in enumerate(columns):
        measures[:, k] = share(column)
    measures[:, 4] = np.bincount(row[order], again, minlength=rows) / np.maximum(words, 1)
    measures[:, 5] = share(same_row & (hashes == np.append(U64(0), hashes[:-1])))
    measures[:, 6] = share((upper + lower > 0) & (marks == 0))

    shape = SHAPES[data]
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    inside = np.cumsum(inside)[:-1] > 0
    first = np.zeros(len(data), dtype=bool)
    first[starts] = True
    kept = inside & (first | (shape != np.append(np.uint8(0), shape[:-1])))
    at = np.concatenate([[0], np.cumsum(kept)])
    shape_hashes = span_hashes(shape[kept], at[starts], at[ends])
    bucket = (mix(shape_hashes) % U64(BUCKETS)).astype(np.int64)
    counts = np.bincount(row * BUCKETS + bucket, minlength=rows * BUCKETS).reshape(rows, BUCKETS)
    shapes[:] = counts / np.maximum(words, 1)[:, None]
    return measures, shapes


def features(measures: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(measures), 1)), 4 * np.sqrt(measures), 2 * np.sqrt(shapes)])


def votes(measures: np.ndarray) -> np.ndarray:
    """A digit per labeller: 0 bad, 1 no vote, 2 good; as one number per text."""
    code = np.zeros(len(measures), dtype=np.int64)
    for name, vote, least, most in LABELLERS:
        value = measures[:, MEASURES.index(name)]
        code = 3 * code + np.where((value >= least) & (value < most), vote + 1, 1)
    return code


def digits(codes: np.ndarray) -> np.ndarray:
    powers = 3 ** np.arange(len(LABELLERS) - 1, -1, -1)
    return codes[:, None] // powers % 3


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns (rows of digits) and how many texts have each: (share of bad and good texts, how often
    each labeller casts each vote on either). It starts from the majority of the votes cast."""
    balance = (patterns == 2).sum(axis=1) - 2.0 * (patterns == 0).sum(axis=1)
    good = 1 / (1 + np.exp(-2 * balance))
    for _ in range(EM_ROUNDS):
        weight = np.stack([counts * (1 - good), counts * good])
        prior = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
        rates = np.stack(
            [[(weight * (patterns[:, j] == v)).sum(axis=1) for v in range(3)] for j in range(patterns.shape[1])]
        ).transpose(2, 0, 1) + 0.5
        rates /= rates.sum(axis=2, keepdims=True)
        now = posterior(patterns, prior, rates)
        if np.abs(now - good).max() < 1e-9:
            break
        good = now
    return prior, rates


def posterior(patterns: np.ndarray, prior: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Probability that a text with each vote pattern is good."""
    said = np.stack([np.log(rates[c, np.arange(patterns.shape[1]), patterns]).sum(axis=1) for c in (0, 1)])
    odds = said[1] - said[0] + np.log(prior[1] / prior[0])
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_linear(rows: np.ndarray, targets: np.ndarray, penalty: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Logistic regression on soft labels, by accelerated gradient steps."""
    found, lead = np.zeros(rows.shape[1]), np.zeros(rows.shape[1])
    rate = 4 / max(1e-9, np.linalg.norm(rows, 2) ** 2 / len(rows) + 4 * penalty)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ lead, -30, 30)))
        now = lead - rate * (rows.T @ (p - targets) / len(rows) + penalty * lead)
        lead, found = now + k / (k + 3) * (now - found), now
    return found


def _measure_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in runs(batch):
            measures, _ = measured(*flat(part.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(votes(measures))], names=["votes"])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in runs(batch):
            measures, shapes = measured(*flat(part.column("text")))
            made = features(measures, shapes).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(votes(measures)), pa.array([row.tobytes() for row in made], pa.binary())],
                names=["doc_id", "votes", "features"],
            )


class Model:
    """Vote rates and scorer weights, frozen."""

    def __init__(self, prior: np.ndarray, rates: np.ndarray, weights: np.ndarray):
        self.prior, self.rates, self.weights = prior, rates, weights


def train(docs: DataFrame) -> Model | None:
    """Labellers are judged on the votes of all texts with a word; the scorer is fitted on up to TRAIN_DOCS of them,
    chosen by hashed doc_id, one for each id. None without any such text. Null ids and texts are left out."""
    usable = id_and_text(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]") & F.col("doc_id").isNotNull())
    counted = usable.mapInArrow(_measure_rows, "votes long").groupBy("votes").count().toArrow()  # at most 3 ** labellers
    if not counted.num_rows:
        return None
    order = np.argsort(counted["votes"].to_numpy())
    codes, counts = counted["votes"].to_numpy()[order], counted["count"].to_numpy()[order].astype(float)
    prior, rates = estimate(digits(codes), counts)
    chosen = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    ids = [r.doc_id for r in chosen.collect()]
    picked = usable.where(F.col("doc_id").isin(ids)).mapInArrow(_feature_rows, "doc_id long, votes long, features binary")
    picked = picked.groupBy("doc_id").agg(F.min(F.struct("votes", "features")).alias("least")).select("least.*").toArrow()
    raw = sorted(zip(picked["votes"].to_pylist(), picked["features"].to_pylist()))
    rows = np.stack([np.frombuffer(f, dtype=np.float32) for _, f in raw]).astype(np.float64)
    targets = posterior(digits(np.array([v for v, _ in raw])), prior, rates)
    return Model(prior, rates, fit_linear(rows, targets))


def scored(model: Model | None, measures: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """The linear scorer; 0 for texts without words."""
    if model is None:
        return np.zeros(len(shapes))
    odds = features(measures, shapes) @ model.weights
    return np.where(shapes.any(axis=1), 1 / (1 + np.exp(-np.clip(odds, -30, 30))), 0.0)


def score_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, posterior (of the votes), score (of the linear scorer) and keep (score of 0.3 or more) of every row of
    ``docs`` (doc_id, text).

    A text that is null, empty or blank has 0, 0 and is not kept, as has every text without a model. Rows are kept
    one for one, also those without doc_id and repeated ones; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in runs(batch):
                data, offsets = flat(part.column("text"))
                measures, shapes = measured(data, offsets)
                if own is None:
                    believed = scores = np.zeros(part.num_rows)
                else:
                    filled = shapes.any(axis=1)
                    believed = np.where(filled, posterior(digits(votes(measures)), own.prior, own.rates), 0.0)
                    scores = scored(own, measures, shapes)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(believed), pa.array(scores), pa.array(scores >= LEAST_SCORE)],
                    names=["doc_id", "posterior", "score", "keep"],
                )

    return id_and_text(docs).mapInArrow(run, "doc_id long, posterior double, score double, keep boolean")


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` (text, ...) that the scorer keeps, with all their columns; see ``score_quality``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in runs(batch):
                measures, shapes = measured(*flat(part.column("text")))
                yield part.filter(pa.array(scored(own, measures, shapes) >= LEAST_SCORE))

    return with_small_batches(docs).mapInArrow(run, docs.schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, by a scorer trained on them; nulls, empties and repeats are as for ``score_quality``."""
    docs = read_table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs))
