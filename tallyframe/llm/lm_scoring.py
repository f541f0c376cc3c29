"""Masked pseudo-likelihood: a network over the two words on either side of a word predicts it; the logarithms of these
probabilities, summed over all words, score a document.

Words are coded by frequency: the commonest each have a code, the rest share hashed ones. The probability of a word that
shares a code is that of the code times the word's share of it, from the counts of all words; a word never counted has its
spelling's part of what Witten and Bell set aside for such. A word's vector is weighted by where it stands. A code is a pair of digits, predicted one after the other, so that a softmax spans 64 classes. The network is trained in numpy where the texts
lie, on every word: partitions train from the same start and their weights are averaged, round by round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.batches import U64, flat, id_and_text, lowered, mix, read_table, runs, span_hashes, word_spans
from tallyframe.session import stored

DIGITS = 64
CODES = DIGITS * DIGITS
#: The last DIGITS codes are for words without a code of their own; code CODES stands beyond the ends of a text.
COMMON = CODES - DIGITS
SIDES = (-2, -1, 1, 2)
WIDTH = 24
#: Words that one partition trains on, at least and at about; and rounds of averaging, each over all words.
PART_EXAMPLES, ROUNDS = 1 << 16, 2
BATCH, RATE = 256, 0.15
#: Batches that are laid out at a time.
GROUP = 16
RUN_BYTES = 1 << 20
#: Words whose shares of a code every task is given, at most; those of all others are joined.
FREQUENT = 1 << 18
#: Words scored at a time, whose arrays stay in the processor's cache.
SCORED = 1 << 10
SHAPES = {
    "word": (CODES + 1, WIDTH), "side": (len(SIDES), WIDTH), "bias": (WIDTH,), "first": (WIDTH, DIGITS), "first_bias": (DIGITS,),
    "given": (DIGITS, WIDTH), "second": (WIDTH, DIGITS), "second_bias": (DIGITS, DIGITS),
}
#: Weights travel in so many pieces.
PIECES = 16


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The data in lower case, and hash, row, start and end of every word in it."""
    data = lowered(data)
    starts, ends, row = word_spans(data, offsets)
    return data, span_hashes(data, starts, ends), row, starts, ends


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, in lower case."""
    return words_of(data, offsets)[1:3]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, and with no word those of each byte in words and, as byte 256, of their ends."""
    letters, held, size = np.zeros(257, np.int64), [], 0
    for batch in batches:
        for part in runs(batch):
            data, hashes, _, starts, _ = words_of(*flat(part.column("text")))
            found = np.bincount(data, minlength=257)
            found[[0x20, *range(0x09, 0x0E)]], found[256] = 0, len(starts)
            letters += found
            held.append(np.unique(hashes, return_counts=True))
            size += len(held[-1][0])
            if size > HELD_WORDS:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > HELD_WORDS // 2:
                    yield _counted(*held[0])
                    held, size = [], 0
    if held:
        yield _counted(*_merged(held))
    yield pa.RecordBatch.from_arrays([pa.array(range(257), pa.int16()), pa.nulls(257, pa.int64()), pa.array(letters)], COUNTED)


def _merged(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the same words added up."""
    words, n = (np.concatenate(c) for c in zip(*counts))
    order = np.argsort(words)
    words = words[order]
    begins = np.flatnonzero(np.append(True, words[1:] != words[:-1])[: len(words)])
    return words[begins], np.add.reduceat(n[order], begins) if len(words) else n


def _counted(words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int16()), pa.array(words.view(np.int64)), pa.array(n)], COUNTED)


#: Counts of words that a task holds before it adds them up, and before it passes on half as many different ones.
HELD_WORDS = 1 << 19
COUNTED = ["byte", "word", "n"]


class Coder:
    """Codes of words, by the place of their hash among the commonest. The first bits of a hash tell where to look."""

    BITS = 16

    def __init__(self, words: list[int]):
        hashes = np.array(words, dtype=np.int64).view(np.uint64)
        self.codes = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.codes]
        tops = (self.hashes >> U64(64 - self.BITS)).astype(np.int64)
        self.begins = np.searchsorted(tops, np.arange(1 << self.BITS)).astype(np.int32)
        self.most = int(np.bincount(tops, minlength=1).max())

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, dtype=np.int32)
        if len(self.hashes):
            at, last = self.begins.take((hashes >> U64(64 - self.BITS)).view(np.int64)), len(self.hashes) - 1
            for _ in range(self.most):
                held = np.minimum(at, last)
                np.copyto(out, self.codes.take(held), where=self.hashes.take(held) == hashes)
                at += 1
        rare = np.flatnonzero(out < 0)
        out[rare] = COMMON + (mix(hashes[rare]) % U64(DIGITS)).astype(np.int32)
        return out


def _pools(coder):
    """Total and number of the words of each shared code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, n = coder.value(batch.column("word").to_numpy().view(np.uint64)), batch.column("n").to_numpy()
            pooled, pool = codes >= COMMON, codes - COMMON
            total = np.bincount(pool[pooled], n[pooled], minlength=DIGITS).astype(np.int64)
            kinds = np.bincount(pool[pooled], minlength=DIGITS)
            yield pa.RecordBatch.from_arrays([pa.array(range(DIGITS), pa.int32()), pa.array(total), pa.array(kinds)], ["pool", "n", "kinds"])

    return run


def _share(coder: Coder, pools: np.ndarray, words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of some counted words have a shared code, and logarithms of their shares of it."""
    codes = coder(words.view(np.uint64))
    pooled = codes >= COMMON
    return pooled, np.log(n[pooled]) - np.log(pools.sum(axis=0)[codes[pooled] - COMMON])


def _shares(coder, pools: np.ndarray):
    """Logarithm of each counted word's share of its shared code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pooled, share = _share(coder.value, pools, batch.column("word").to_numpy(), batch.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("word").filter(pa.array(pooled)), pa.array(share)], ["word", "share"])

    return run


def _frequent(counts: DataFrame, coder: Coder, pools: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the commonest words of shared codes, FREQUENT at most, and logarithms of their shares."""
    size = F.floor(F.log2("n") * 8)
    least, total = None, 0
    for row in counts.groupBy(size.alias("size")).agg(F.count("*").alias("words")).orderBy(F.desc("size")).collect():
        total += row.words
        if total > FREQUENT:
            break
        least = row.size
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0)
    held = counts.where(size >= least).toArrow()
    words = held.column("word").to_numpy()
    pooled, share = _share(coder, pools, words, held.column("n").to_numpy())
    words = words[pooled].view(np.uint64)
    order = np.argsort(words)
    return words[order], share[order]


def contexts(codes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Codes of the words at SIDES of each word; beyond its text the code for no word."""
    out = np.full((len(SIDES), len(codes)), CODES, dtype=np.int32)
    for k, side in enumerate(SIDES):
        to, of = (slice(-side, None), slice(None, side)) if side < 0 else (slice(None, -side), slice(side, None))
        same = row[to] == row[of]
        out[k, to] = np.where(same, codes[of], CODES)
    return out


class Network:
    """Weights in one flat array, seen by name."""

    def __init__(self, flat_weights: np.ndarray | None = None):
        sizes = [int(np.prod(s)) for s in SHAPES.values()]
        if flat_weights is None:
            flat_weights = np.random.default_rng(11).normal(0, 0.1, sum(sizes)).astype(np.float32)
            flat_weights[sizes[0] : sizes[0] + sizes[1]] += 1
        self.flat = flat_weights
        cuts = np.cumsum([0, *sizes])
        self.w = {name: self.flat[a:b].reshape(s) for (name, s), a, b in zip(SHAPES.items(), cuts, cuts[1:])}

    def hidden(self, around: np.ndarray) -> np.ndarray:
        vectors = self.w["word"].take(around, axis=0)
        total = np.einsum("knd,kd->nd", vectors, self.w["side"])
        total += self.w["bias"]
        return np.tanh(total, out=total)

    def log_probabilities(self, codes: np.ndarray, around: np.ndarray) -> np.ndarray:
        first, second = codes // DIGITS, codes % DIGITS
        h = self.hidden(around)
        given = self.w["given"].take(first, axis=0)
        given += h
        x = h @ self.w["first"]
        x += self.w["first_bias"]
        y = np.tanh(given, out=given) @ self.w["second"]
        y += self.w["second_bias"].take(first, axis=0)
        return _log_softmax(x, first) + _log_softmax(y, second)

    def train(self, codes: np.ndarray, around: np.ndarray, squares: np.ndarray) -> None:
        """One step of Adagrad on a batch."""
        Training(self, squares).steps(codes, around, len(codes))


class Batches:
    """Batches of ``size`` examples, with all that can be told of them before any step: places of the targets in arrays of
    probabilities, and which words stand around: those at one place, and the others place by place, sorted."""

    def __init__(self, codes: np.ndarray, around: np.ndarray, size: int):
        self.size, self.number = size, len(codes) // size
        codes = codes.astype(np.int64)
        self.first = codes // DIGITS
        row = np.arange(len(codes)) % size * DIGITS
        self.first_at, self.second_at = row + self.first, row + codes % DIGITS
        places = len(SIDES) * size
        near = around.astype(np.uint16).reshape(len(SIDES), self.number, size).transpose(1, 0, 2).reshape(self.number, places)
        self.near = near.astype(np.int64)
        order = np.argsort(near, axis=1, kind="stable")
        words = near.ravel().take(order + np.arange(self.number)[:, None] * places)
        fresh = np.ones((self.number, places + 1), dtype=bool)
        np.not_equal(words[:, 1:], words[:, :-1], out=fresh[:, 1:-1])
        once = fresh[:, :-1] & fresh[:, 1:]
        begins = fresh[:, :-1] & ~once
        words, order = words.ravel(), order.ravel()
        at = np.flatnonzero(~once)
        self.many, self.many_ends = order[at], np.cumsum(places - once.sum(axis=1))
        starts = begins.ravel()[at]
        self.own_many, self.many_ends_own = words[at[starts]].astype(np.int64), np.cumsum(begins.sum(axis=1))
        self.begins = np.flatnonzero(starts)
        at = np.flatnonzero(once)
        self.once, self.own_once, self.once_ends = order[at], words[at].astype(np.int64), np.cumsum(once.sum(axis=1))

    def __iter__(self):
        """Per batch: first digits, places of both digits, words around, places of words at several, where each begins
        among these, places of the others, and the words: first those at several places."""
        many = own = once = 0
        for k in range(self.number):
            low, high = k * self.size, (k + 1) * self.size
            many_end, own_end, once_end = int(self.many_ends[k]), int(self.many_ends_own[k]), int(self.once_ends[k])
            yield (
                self.first[low:high], self.first_at[low:high], self.second_at[low:high], self.near[k],
                self.many[many:many_end], self.begins[own:own_end] - many, self.once[once:once_end],
                np.concatenate([self.own_many[own:own_end], self.own_once[once:once_end]]),
            )
            many, own, once = many_end, own_end, once_end


class Training:
    """Adagrad on a network, with sums of squares of the slopes that are kept from batch to batch.

    Vectors of words are taken and put as one item each, all other weights are updated as one array.
    """

    ITEM = f"V{4 * WIDTH}"

    def __init__(self, network: Network, squares: np.ndarray):
        self.network, self.cut = network, (CODES + 1) * WIDTH
        self.words, self.word_squares = network.flat[: self.cut].view(self.ITEM), squares[: self.cut].view(self.ITEM)
        self.rest, self.rest_squares = network.flat[self.cut :], squares[self.cut :]
        self.slopes, self.work = Network(np.zeros_like(network.flat)), None

    def steps(self, codes: np.ndarray, around: np.ndarray, size: int = BATCH) -> None:
        """One step for each ``size`` examples, and one for the rest."""
        whole, some = len(codes) // size * size, GROUP * size
        cuts = [(low, min(low + some, whole), size) for low in range(0, whole, some)] + [(whole, len(codes), len(codes) - whole)]
        for low, high, n in cuts:
            if high > low:
                self.work = self.work if self.work and self.work.n == n else Work(n)
                for batch in Batches(codes[low:high], around[:, low:high], n):
                    self.step(self.work, *batch)

    def step(self, work, first, first_at, second_at, near, many, begins, once, own) -> None:
        w, s, n = self.network.w, self.slopes.w, len(first)
        p, q = work.p_and_q
        vectors = self.words.take(near).view(np.float32).reshape(len(SIDES), n, WIDTH)
        h, given = work.h_and_given
        np.einsum("knd,kd->nd", vectors, w["side"], out=h)
        h += w["bias"]
        np.tanh(h, out=h)
        np.matmul(h, w["first"], out=p)
        p += w["first_bias"]
        w["given"].take(first, axis=0, out=given, mode="clip")
        given += h
        np.tanh(given, out=given)
        np.matmul(given, w["second"], out=q)
        q += w["second_bias"].take(first, axis=0, out=work.chosen, mode="clip")
        _softmax(work.p_and_q)
        p.reshape(-1)[first_at] -= 1
        q.reshape(-1)[second_at] -= 1
        work.turned[0], work.turned[1] = w["first"].T, w["second"].T
        back_h, back = np.matmul(work.p_and_q, work.turned, out=work.back)
        slope = np.multiply(work.h_and_given, work.h_and_given, out=work.slope)
        np.subtract(1, slope, out=slope)
        back *= slope[1]
        back_h += back
        back_h *= slope[0]
        work.chosen.fill(0)
        work.chosen.reshape(-1)[first_at] = 1
        np.matmul(h.T, p, out=s["first"])
        np.matmul(work.ones, p, out=s["first_bias"])
        np.matmul(given.T, q, out=s["second"])
        np.matmul(work.ones, back_h, out=s["bias"])
        np.matmul(work.chosen.T, back, out=s["given"])
        np.matmul(work.chosen.T, q, out=s["second_bias"])
        np.einsum("nd,knd->kd", back_h, vectors, out=s["side"])
        # Only vectors of words that stand around have a slope.
        each = np.multiply(back_h, w["side"][:, None], out=work.each).reshape(-1).view(self.ITEM)
        sums = work.sums[: len(own)]
        if len(begins):
            # Pairs of numbers are added as complex ones, which takes half the calls.
            pairs = each.take(many).view(np.complex64).reshape(-1, WIDTH // 2)
            np.add.reduceat(pairs, begins, out=sums[: len(begins)].view(np.complex64))
        sums[len(begins) :].reshape(-1).view(self.ITEM)[:] = each.take(once)
        word, squares = self.words.take(own), self.word_squares.take(own)
        _adagrad(word.view(np.float32), sums.reshape(-1), squares.view(np.float32), work.square[: sums.size])
        self.words[own], self.word_squares[own] = word, squares
        slopes = self.slopes.flat[self.cut :]
        _adagrad(self.rest, slopes, self.rest_squares, work.rest)


class Work:
    """Arrays for steps of ``n`` examples."""

    def __init__(self, n: int):
        def array(*shape):
            return np.empty(shape, np.float32)

        self.n, places = n, len(SIDES) * n
        self.p_and_q, self.chosen, self.ones = array(2, n, DIGITS), array(n, DIGITS), np.ones(n, np.float32)
        self.h_and_given, self.back, self.slope = (array(2, n, WIDTH) for _ in range(3))
        self.turned = array(2, DIGITS, WIDTH)
        self.each, self.sums, self.square = array(len(SIDES), n, WIDTH), array(places, WIDTH), array(places * WIDTH)
        self.rest = array(sum(int(np.prod(shape)) for name, shape in SHAPES.items() if name != "word"))


def _adagrad(weights: np.ndarray, slopes: np.ndarray, squares: np.ndarray, work: np.ndarray) -> None:
    """A step down the slopes, in place."""
    squares += np.multiply(slopes, slopes, out=work)
    np.sqrt(squares, out=work)
    work += np.float32(1e-6)
    np.divide(slopes, work, out=work)
    work *= np.float32(RATE)
    weights -= work


#: Between these numbers no exp of 32 bits, nor a sum of DIGITS ones, overflows or vanishes.
LEAST, MOST = -80, 80
ONES = np.ones(DIGITS, np.float32)


def _safe(x: np.ndarray) -> np.ndarray | None:
    """What is to be taken off the rows of ``x`` before exp; None if nothing needs to be."""
    return None if x.min() > LEAST and x.max() < MOST else x.max(axis=-1, keepdims=True)


def _softmax(x: np.ndarray) -> np.ndarray:
    """Over the last axis, in place."""
    off = _safe(x)
    if off is not None:
        x -= off
    np.exp(x, out=x)
    x *= np.reciprocal(x @ ONES)[..., None]
    return x


def _log_softmax(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Of the chosen of each row; ``x`` is overwritten."""
    off = _safe(x)
    if off is not None:
        x -= off
    said = x.reshape(-1).take(np.arange(len(x)) * DIGITS + chosen)
    return said - np.log(np.exp(x, out=x) @ ONES)


def _trained(start, coder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, random = Network(start.value.copy()), 0, np.random.default_rng(7)
        training = Training(own, np.full_like(own.flat, 1e-2))
        for batch in batches:
            for part in runs(batch):
                hashes, row = word_hashes(*flat(part.column("text")))
                codes = coder.value(hashes)
                around = contexts(codes, row)
                order = random.permutation(len(codes))
                training.steps(codes[order], around.take(order, axis=1))
                seen += len(codes)
        if seen:
            pieces = np.array_split(own.flat, PIECES)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(PIECES), pa.int32()),
                    pa.array([seen] * PIECES, pa.int64()),
                    pa.array([(p * np.float32(seen)).tobytes() for p in pieces], pa.binary()),
                ],
                names=["piece", "n", "weights"],
            )

    return run


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(w, dtype=np.float32).astype(np.float64) for w in group["weights"])
    return pd.DataFrame({"piece": [group["piece"].iloc[0]], "n": [group["n"].sum()], "weights": [total.astype(np.float32).tobytes()]})


@dataclass
class Model:
    coder: Coder
    network: Network
    #: Counts of all words (word, n); counts and kinds of words by shared code; logarithms of the shares of bytes and ends.
    counts: DataFrame
    pools: np.ndarray
    spelling: np.ndarray
    #: Hashes and shares (as logarithms) of the commonest words of shared codes.
    frequent: tuple[np.ndarray, np.ndarray]

    def unseen(self) -> np.ndarray:
        """Logarithm of what each shared code leaves to words that were never counted."""
        total, kinds = self.pools
        return np.where(kinds > 0, np.log(np.maximum(kinds, 1)) - np.log(np.maximum(total + kinds, 1)), 0.0)


def train(docs: DataFrame) -> Model | None:
    """A coder from the counts of all words of ``docs``, and a network trained on every one of them with its neighbours;
    None if there is no word. Null texts count as empty."""
    texts, spark = id_and_text(docs).select("text"), docs.sparkSession
    made = texts.mapInArrow(_count_words, "byte short, word long, n long").groupBy("byte", "word").agg(F.sum("n").alias("n"))
    made = stored(made, "words")
    counts = made.where("byte IS NULL").select("word", "n")
    letters = np.ones(257, np.int64)
    for row in made.where("byte IS NOT NULL").collect():
        letters[row.byte] += row.n
    n = int(letters[256]) - 1
    if not n:
        return None
    common = counts.orderBy(F.desc("n"), "word").limit(COMMON).collect()
    coder = Coder([row.word for row in common])
    shared = spark.sparkContext.broadcast(coder)
    pools = np.zeros((2, DIGITS), np.int64)
    found = counts.mapInArrow(_pools(shared), "pool int, n long, kinds long").groupBy("pool")
    for row in found.agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect():
        pools[:, row.pool] = row.n, row.kinds
    network = Network()
    for _ in range(ROUNDS):
        start = spark.sparkContext.broadcast(network.flat)
        schema = "piece int, n long, weights binary"
        sums = texts.coalesce(-(-n // PART_EXAMPLES)).mapInArrow(_trained(start, shared), schema)
        for share in (32, 1):  # of many partitions, never all in one task
            lot = F.pmod(F.xxhash64("n", "weights"), F.lit(share)).alias("lot")
            sums = sums.groupBy("piece", lot).applyInPandas(_summed, schema)
        rows = sorted(sums.collect(), key=lambda r: r.piece)
        network = Network(np.concatenate([np.frombuffer(r.weights, dtype=np.float32) / np.float32(r.n) for r in rows]).astype(np.float32))
    return Model(coder, network, counts, pools, np.log(letters / letters.sum()), _frequent(counts, coder, pools))


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, n_words, log_likelihood (natural, summed over words) and mean_log_likelihood (null without words) of
    every row of ``docs`` (doc_id, text).

    Null, empty and blank texts have no words and 0. Without a model every word has the probability 1 / CODES. Rows
    are kept one for one, also those without doc_id and repeated ones; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        model and (model.coder, model.network.flat, model.unseen(), model.spelling, model.frequent)
    )
    names = ["row", "doc_id", "n_words", "word", "times", "amount"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with n_words have the amount of all codes of a text and of frequent words' shares; the others another word
        of a shared code, how often the text holds it, and the amount for once if it was never counted."""
        coder, weights, unseen, spelling, (frequent, share) = shared.value or (None, None, None, None, (None, None))
        own = Network(weights) if weights is not None else None
        next_row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in runs(batch, run_bytes=RUN_BYTES):
                data, hashes, row, starts, ends = words_of(*flat(part.column("text")))
                said = np.full(len(hashes), -np.log(CODES))
                ids = next_row + np.arange(part.num_rows)
                next_row += part.num_rows
                if own is not None and len(hashes):
                    codes = coder(hashes)
                    around = contexts(codes, row)
                    for low in range(0, len(codes), SCORED):
                        some = slice(low, low + SCORED)
                        said[some] = own.log_probabilities(codes[some], around[:, some])
                    pooled = np.flatnonzero(codes >= COMMON)
                    if len(frequent):
                        of_pooled = hashes[pooled]
                        at = np.minimum(np.searchsorted(frequent, of_pooled), len(frequent) - 1)
                        known = frequent.take(at) == of_pooled
                        said[pooled[known]] += share.take(at[known])
                        pooled = pooled[~known]
                    pooled = pooled[np.lexsort((hashes[pooled], row[pooled]))]
                    new = np.flatnonzero((np.diff(hashes[pooled], prepend=U64(0)) != 0) | (np.diff(row[pooled], prepend=-1) != 0))
                    times = np.diff(np.append(new, len(pooled)))
                    at = pooled[new]
                    letters = np.zeros(len(data) + 1)
                    np.cumsum(spelling.take(data), out=letters[1:])
                    spelled = letters[ends[at]] - letters[starts[at]] + spelling[256] + unseen[codes[at] - COMMON]
                    none = pa.nulls(len(at), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[row[at]]), none, none, pa.array(hashes[at].view(np.int64)), pa.array(times), pa.array(spelled)], names
                    )
                words = np.bincount(row, minlength=part.num_rows)
                total = np.bincount(row, said, minlength=part.num_rows).astype(np.float64)
                # These meet no word; a hash deals them out.
                dealt = mix(ids.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), part.column("doc_id"), pa.array(words, pa.int64()), pa.array(dealt), pa.nulls(len(ids), pa.int64()), pa.array(total)],
                    names,
                )

    made = id_and_text(docs).mapInArrow(run, "row long, doc_id long, n_words long, word long, times long, amount double")
    if model:
        coder = docs.sparkSession.sparkContext.broadcast(model.coder)
        shares = model.counts.mapInArrow(_shares(coder, model.pools), "word long, share double")
        amount = F.when(F.col("times").isNull(), F.col("amount")).otherwise(F.col("times") * F.coalesce("share", "amount"))
        made = made.join(shares, "word", "left").groupBy("row")
        made = made.agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum(amount).alias("amount"))
    made = made.select("doc_id", "n_words", F.col("amount").alias("log_likelihood"))
    return made.withColumn("mean_log_likelihood", F.try_divide("log_likelihood", F.col("n_words").cast("double")))


def op8_masked_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a network trained on them; awkward rows are as for its training and scoring."""
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs))
