"""Benchmark decontamination under edit distance: CGK random walks map edits to Hamming distance, bit-sampling LSH over
item-sized windows finds candidates, and a banded edit distance decides.

Windows begin at words, and at every character in scripts without blanks. Before the walks a count sifts them: k edits
leave a window with at least n + 1 - q (k + 1) of the sequences of q bytes of an item of n, and q is chosen so that this
is 1 or more; the sift loses nothing. Walks of long texts drift apart, so a long item is cut into pieces at its own words:
of a text with k edits in n bytes some piece has no more than its share of them. A piece that is found proposes where its
item may begin, and the whole item decides. Items that stand in a text byte for byte are found by their
first eight bytes and compared, wherever they begin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.batches import U64, flat, id_and_text, lots, mix, read_table, runs, same_bytes, spread, with_small_batches

#: A window matches an item if at most this share of the item's bytes is edited.
EDIT_SHARE = 0.10
#: The share of items with fewer bytes allows no edit, so that they are found byte for byte alone.
LEAST_BYTES = 10
#: Items with fewer bytes count as whole words only.
WHOLE_WORDS = 24
#: Items of twice as many bytes are cut into pieces of at least about so many.
PIECE_BYTES = 48
#: Independent walks, hash tables per walk, and sampled coordinates per table; and the same for pieces under WHOLE_WORDS
#: bytes, where one edit is much and a walk has little way to fall back into step.
WALKS, TABLES, SAMPLED = 4, 24, 5
WALKS_SHORT, SAMPLED_SHORT = 10, 3
#: Least share of equal bytes in two images for the edits to be counted; unrelated texts have about 0.07.
LEAST_ALIKE = 0.2
#: Items of lengths within this factor share tables.
CLASS_RATIO = 1.6
#: Items of one pass over the documents are sent to every executor; more bytes take more passes.
PASS_BYTES = 8 << 20
RUN_BYTES = 1 << 20
#: Size of a class's bitmap of sequences: a slot in so many is taken at most, up to the greatest number of slots.
BITMAP_ROOM, BITMAP_LEAST, BITMAP_MOST = 16, 16, 24
#: Sequences are counted by item, not only by class, unless one is held by more items than this on average.
MOST_HOLDERS = 16
#: Windows that walk at a time.
BLOCK = 1 << 14


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with Latin capitals lowered and every run of blanks made one space, none at the start of a text; where each
    text begins; and from which byte each one came."""
    data = data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    latin = np.zeros(len(data), dtype=bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data[latin] += 32
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    data[blank] = 32
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    after_blank = np.append(False, blank[:-1]) | first[:-1]
    keep = ~(blank & after_blank)
    at = np.concatenate([[0], np.cumsum(keep)])
    data, source = data[keep], np.flatnonzero(keep)
    return data, at[offsets], source


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q bytes from each position on, 9 at most."""
    padded = np.append(data, np.zeros(9, np.uint8))
    head = np.ndarray((len(data),), "<u8", padded, strides=(1,)).copy()
    if q < 8:
        head &= U64((1 << 8 * q) - 1)
    elif q > 8:
        head = head * U64(0x9E3779B97F4A7C15) + padded[8 : 8 + len(data)]
    return mix(head)


def bitmap_of(grams: np.ndarray) -> tuple[int, np.ndarray]:
    """A bitmap of hashes, by as many of their first bits as it says."""
    bits = int(np.clip(np.ceil(np.log2(BITMAP_ROOM * len(grams))), BITMAP_LEAST, BITMAP_MOST))
    bitmap = np.zeros(1 << bits, dtype=bool)
    bitmap[(grams >> U64(64 - bits)).astype(np.int64)] = True
    return bits, bitmap


@dataclass
class Spans:
    """Spans of one byte array, and the most edits that each may have."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    def __post_init__(self) -> None:
        self.edits = np.floor(EDIT_SHARE * self.lengths + 1e-9).astype(np.int64)


def cut(item: np.ndarray) -> np.ndarray:
    """Where the pieces of an item begin: at words, as evenly as these allow; at its start alone if it is short."""
    parts = len(item) // PIECE_BYTES
    if parts < 2:
        return np.zeros(1, np.int64)
    begins = window_begins(item, np.array([0, len(item)]))
    begins = begins[begins <= len(item) - PIECE_BYTES // 2]
    wanted = np.arange(1, parts) * len(item) / parts
    nearest = begins[np.abs(begins[None, :] - wanted[:, None]).argmin(axis=1)]
    at = np.unique(np.append(0, nearest))
    return at[np.append(True, np.diff(at) >= PIECE_BYTES // 2)]


@dataclass
class Items:
    """What a pass needs of its items, and of their pieces in classes of similar length and one size of sequences."""

    ids: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    def __post_init__(self) -> None:
        self.spans = Spans(self.data, self.starts, self.lengths)
        self.edits = self.spans.edits
        cuts = [cut(self.data[a : a + n]) for a, n in zip(self.starts, self.lengths)]
        counts = np.array([len(c) for c in cuts], dtype=np.int64)
        self.item_of = np.repeat(np.arange(len(cuts)), counts)
        self.place_of = np.concatenate([*cuts, np.zeros(0, np.int64)]).astype(np.int64)
        last = np.append(self.item_of[1:] != self.item_of[:-1], True)[: len(self.item_of)]
        ends = np.where(last, self.lengths[self.item_of], np.append(self.place_of[1:], 0)[: len(self.place_of)])
        self.whole = (counts == 1)[self.item_of]
        self.pieces = pieces = Spans(self.data, self.starts[self.item_of] + self.place_of, ends - self.place_of)
        long = pieces.lengths >= LEAST_BYTES
        kinds = np.floor(np.log(np.maximum(pieces.lengths, 1) / LEAST_BYTES) / np.log(CLASS_RATIO)).astype(int)
        sizes = np.minimum(8, (pieces.lengths - pieces.edits) // (pieces.edits + 1))  # of sequences; longer ones sift more
        kinds = 10 * kinds + sizes
        self.classes, self.sifts = [], []
        for kind in np.unique(kinds[long]):
            own = np.flatnonzero((kinds == kind) & long)
            n, k = pieces.lengths[own], pieces.edits[own]
            least, most, q = n.min(), n.max(), int(sizes[own[0]])
            needed = int((n + 1 - q * (k + 1)).min())
            grams, holders = [], []
            for i, a, size in zip(own, pieces.starts[own], n):
                grams.append(np.unique(gram_hashes(self.data[a : a + size], q)[: size - q + 1]))
                holders.append(np.full(len(grams[-1]), i))
            grams, holders = np.concatenate(grams), np.concatenate(holders)
            order = np.argsort(grams, kind="stable")
            grams, holders = grams[order], holders[order]
            self.sifts.append((q, *bitmap_of(grams), grams, holders))
            reach = most + k.max() - q + 1
            # Coordinates that a walk reaches before the shortest item of the class ends.
            steps = max(SAMPLED, int(1.6 * least))
            self.classes.append((own, int(reach), needed, steps))
        self.any = {
            q: bitmap_of(np.concatenate([sift[3] for sift in self.sifts if sift[0] == q])) for q in {sift[0] for sift in self.sifts}
        }
        self.steps = max((c[3] for c in self.classes), default=0)
        random = np.random.default_rng(5)
        self.tries = [(WALKS, SAMPLED) if pieces.lengths[own].min() >= WHOLE_WORDS else (WALKS_SHORT, SAMPLED_SHORT) for own, *_ in self.classes]
        self.walks = max((walks for walks, _ in self.tries), default=0)
        self.moves = random.integers(0, 2, (self.walks, max(1, self.steps), 256), dtype=np.uint8)
        self.samples = [
            np.sort(random.integers(0, c[3], (walks, TABLES, sampled)), axis=2)
            for c, (walks, sampled) in zip(self.classes, self.tries)
        ]
        self.tables, self.images = [], []
        ends = pieces.starts + pieces.lengths
        for (own, _, _, steps), samples in zip(self.classes, self.samples):
            tables = []
            self.images.append([])
            for w in range(len(samples)):
                image = self.walk(self.data, pieces.starts[own], ends[own], w, steps)
                self.images[-1].append(image)
                for coordinates in samples[w]:
                    keys = _packed(image, coordinates)
                    order = np.argsort(keys, kind="stable")
                    tables.append((keys[order], order))
            self.tables.append(tables)
        # Items by their first eight bytes, or all of them.
        first = np.ndarray((len(self.data),), "<u8", np.append(self.data, np.zeros(8, np.uint8)), strides=(1,))[self.starts]
        self.heads = []
        for size in np.unique(np.minimum(self.lengths, 8)):
            mask = U64((1 << 8 * int(size)) - 1)
            own = np.flatnonzero(np.minimum(self.lengths, 8) == size)
            own = own[np.argsort(first[own] & mask, kind="stable")]
            table = np.zeros(1 << 16, dtype=bool)
            table[(mix(first[own] & mask) >> U64(48)).astype(np.int64)] = True
            self.heads.append((mask, table, first[own] & mask, own))

    def walk(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, w: int, steps: int) -> np.ndarray:
        """CGK images: each step writes the byte under the pointer, and a random bit of (step, byte) moves it on."""
        image = np.empty((steps, len(starts)), dtype=np.uint8)
        at = starts.astype(np.int64).copy()
        padded = np.append(data, np.uint8(0))
        for j in range(steps):
            byte = padded[np.minimum(at, len(data))]
            byte[at >= ends] = 0
            image[j] = byte
            at += self.moves[w, j][byte]
        return image


def _packed(image: np.ndarray, coordinates: np.ndarray) -> np.ndarray:
    keys = np.zeros(image.shape[1], dtype=np.uint64)
    for j in coordinates:
        keys = keys << U64(8) | image[j].astype(np.uint64)
    return keys


def candidates(items: Items, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Columns (start, end of its text, piece, unlikeness) of windows that share a table entry with a piece; unlikeness
    is the least share, in thousandths, of bytes that differ in two images."""
    if not len(data) or not items.classes:
        return np.zeros((4, 0), np.int64)
    begins = window_begins(data, offsets)
    ends = offsets[np.searchsorted(offsets, begins, side="right")]
    dense = np.zeros((len(items.classes), len(begins)), dtype=bool)
    places, reaches = {}, {}
    for q, (bits, bitmap) in items.any.items():
        hashes = gram_hashes(data, q)
        hit = bitmap[(hashes >> U64(64 - bits)).astype(np.int64)]
        before = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        at = np.flatnonzero(hit)
        places[q] = at, hashes[at], before, before[begins]
    for kind, ((_, reach, least, _), (q, bits, bitmap, grams, holders)) in enumerate(zip(items.classes, items.sifts)):
        at, hashes, before, low = places[q]
        hit = bitmap[(hashes >> U64(64 - bits)).astype(np.int64)]
        hits = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        high = before[np.minimum(begins + reach, ends)]
        dense[kind] = hits[high] - hits[low] >= least
        own = np.flatnonzero(dense[kind])
        # Sequences in these windows alone, by the items that hold them.
        size = len(at) + 1
        inside = np.cumsum(np.bincount(low[own], minlength=size) - np.bincount(high[own], minlength=size))[:-1] > 0
        hit &= inside
        left = np.searchsorted(grams, hashes[hit], side="left")
        counts = np.searchsorted(grams, hashes[hit], side="right") - left
        if len(own) and counts.sum() <= MOST_HOLDERS * len(counts):
            piece, low, high = of_one_piece(items.pieces, q, np.repeat(at[hit], counts), holders[spread(left, counts)])
            first = piece * (len(data) + 1)
            reaches[kind] = first + low, np.maximum.accumulate(first + high)
            edges = np.bincount(low, minlength=len(data) + 1) - np.bincount(high + 1, minlength=len(data) + 1)
            dense[kind, own] = np.cumsum(edges)[begins[own]] > 0
    some = dense.any(axis=0)
    begins, ends, dense = begins[some], ends[some], dense[:, some]
    found = []
    for low in range(0, len(begins), BLOCK):
        block = slice(low, low + BLOCK)
        for w in range(items.walks):
            kinds = [kind for kind, (walks, _) in enumerate(items.tries) if w < walks]
            image = items.walk(data, begins[block], ends[block], w, max(items.classes[kind][3] for kind in kinds))
            for kind in kinds:
                own, _, _, steps = items.classes[kind]
                samples, tables, images = items.samples[kind], items.tables[kind], items.images[kind][w]
                columns = np.flatnonzero(dense[kind, block])
                if not len(columns):
                    continue
                seen, met = image[:steps, columns], []
                for t in range(TABLES):
                    keys, owners = tables[w * TABLES + t]
                    wanted = _packed(seen, samples[w][t])
                    left = np.searchsorted(keys, wanted, side="left")
                    at = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == wanted)
                    counts = np.searchsorted(keys, wanted[at], side="right") - left[at]
                    met.append(np.repeat(at, counts) * len(own) + owners[spread(left[at], counts)])
                column, owner = np.divmod(np.unique(np.concatenate(met)), len(own))
                if kind in reaches:  # the sift has passed the window for this very piece
                    good = within(reaches[kind], own[owner], begins[low + columns[column]], len(data))
                    column, owner = column[good], owner[good]
                for part in range(0, len(column), BLOCK):
                    some, piece = column[part : part + BLOCK], owner[part : part + BLOCK]
                    alike = (seen[:, some] == images[:, piece]).mean(axis=0)
                    near = alike >= LEAST_ALIKE
                    where, unlike = low + columns[some[near]], (1000 - 1000 * alike[near]).astype(np.int64)
                    found.append(np.stack([begins[where], ends[where], own[piece[near]], unlike]))
    if not found:
        return np.zeros((4, 0), np.int64)
    pairs = np.concatenate(found, axis=1)
    pairs = pairs[:, np.lexsort((pairs[3], pairs[0], pairs[2]))]
    return pairs[:, _new(pairs[[2, 0]])]


def window_begins(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a text begins, what follows a character that is neither letter nor digit, and, since many scripts have no
    blanks, every character of three or four bytes and what follows one; never a blank."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    byte = data[at]
    plain = ((byte >= 97) & (byte <= 122)) | ((byte >= 48) & (byte <= 57)) | ((byte >= 65) & (byte <= 90))
    second = data[np.minimum(at + 1, len(data) - 1)]
    sign = (byte == 0xC2) | ((byte == 0xC3) & ((second == 0x97) | (second == 0xB7)))
    open_after = ((byte < 0x80) & ~plain) | sign | (byte >= 0xE0)
    begins = np.zeros(len(data), dtype=bool)
    begins[at] = np.append(False, open_after[:-1]) | (byte >= 0xE0)
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(begins & (data != 32))


def of_one_piece(pieces: Spans, q: int, at: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Columns (piece, first, last) of bytes from which on a window holds enough sequences of a piece, given where (``at``)
    sequences of which pieces stand; sorted by piece and first."""
    order = np.lexsort((at, piece))
    at, piece = at[order], piece[order]
    needed = pieces.lengths[piece] + 1 - q * (pieces.edits[piece] + 1)
    last = np.arange(len(at)) + needed - 1
    whole = last < len(at)
    at_last = at[np.minimum(last, len(at) - 1)]
    whole &= piece[np.minimum(last, len(at) - 1)] == piece
    low = np.maximum(at_last - (pieces.lengths[piece] + pieces.edits[piece] - q), 0)
    whole &= low <= at
    found = np.stack([piece[whole], low[whole], at[whole]])
    return found[:, np.lexsort((found[1], found[0]))]


def within(reach: tuple[np.ndarray, np.ndarray], piece: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """Whether windows of pieces begin in what ``of_one_piece`` gave for them."""
    keys, ends = reach
    if not len(keys):
        return np.zeros(len(piece), bool)
    wanted = piece * (size + 1) + begin
    before = np.searchsorted(keys, wanted, side="right") - 1
    return (before >= 0) & (ends[np.maximum(before, 0)] >= wanted)


def verbatim(items: Items, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Columns (row, item, start) of every place where an item stands byte for byte. One under WHOLE_WORDS counts
    only where no ASCII letter or digit goes on before or after it."""
    found = [np.zeros((3, 0), np.int64)]
    heads = np.ndarray((len(data),), "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,)).copy()
    for mask, table, keys, owners in items.heads:
        masked = heads & mask
        at = np.flatnonzero(table[(mix(masked) >> U64(48)).astype(np.int64)])
        left = np.searchsorted(keys, masked[at], side="left")
        counts = np.searchsorted(keys, masked[at], side="right") - left
        for k in range(int(counts.max(initial=0))):
            more = counts > k
            start, item = at[more], owners[left[more] + k]
            row = np.searchsorted(offsets, start, side="right") - 1
            end = start + items.lengths[item]
            good = end <= offsets[row + 1]
            start, item, row, end = start[good], item[good], row[good], end[good]
            good = same_bytes(data, start, items.data, items.starts[item], items.lengths[item])
            found.append(np.stack([row[good], item[good], start[good]]))
    row, item, start = np.concatenate(found, axis=1)
    stands = in_words(data, offsets, row, start, start + items.lengths[item]) | (items.lengths[item] >= WHOLE_WORDS)
    return np.stack([row, item, start])[:, stands]


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes of normalised texts are ASCII letters or digits."""
    return ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))


def in_words(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether no ASCII letter or digit goes on over the ends of spans of texts."""
    if not len(row):
        return np.zeros(0, bool)
    letter, last = _letters(data), np.minimum(end, len(data) - 1)
    return ~((start > offsets[row]) & letter[start - 1] & letter[start] | (end < offsets[row + 1]) & letter[last] & letter[end - 1])


def _new(columns: np.ndarray) -> np.ndarray:
    """Which columns differ from the one before."""
    return np.append(True, (columns[:, 1:] != columns[:, :-1]).any(axis=0))[: columns.shape[1]]


def matches(items: Items, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Columns (row, item, edits, start, size) of items that occur in a text, one window of each: the first where it
    stands byte for byte; or else the most alike window if it is within the limit, or the closest of the others."""
    if not len(data):
        return np.zeros((5, 0), np.int64)
    exact = verbatim(items, data, offsets)
    exact = exact[:, np.lexsort(exact[::-1])]
    exact = exact[:, _new(exact[:2])]
    out = [np.stack([exact[0], exact[1], np.zeros_like(exact[0]), exact[2], items.lengths[exact[1]]])]
    start, end, piece, unlike = candidates(items, data, offsets)
    row, item = np.searchsorted(offsets, start, side="right") - 1, items.item_of[piece]
    open_ = ~np.isin(row * len(items.ids) + item, exact[0] * len(items.ids) + exact[1])
    start, end, piece, unlike, row, item = (x[open_] for x in (start, end, piece, unlike, row, item))
    whole = items.whole[piece]
    more = proposed(items, data, offsets, *(x[~whole] for x in (start, end, piece, row)))
    start, row = np.append(start[whole], more[0]), np.append(row[whole], more[1])
    item, unlike = np.append(item[whole], more[2]), np.append(unlike[whole], more[3])
    end = offsets[row + 1]
    order = np.lexsort((start, unlike, item, row))
    start, end, item, row = start[order], end[order], item[order], row[order]
    leads = _new(np.stack([row, item]))
    pair = np.cumsum(leads) - 1
    settled = np.zeros(int(leads.sum()), dtype=bool)
    for some in (np.flatnonzero(leads), None):
        some = np.flatnonzero(~leads & ~settled[pair]) if some is None else some
        edits, sizes = edit_distances(items.spans, data, start[some], end[some], item[some])
        good = np.flatnonzero(edits <= items.edits[item[some]])
        good = good[np.lexsort((start[some][good], edits[good], pair[some][good]))]
        at = some[good]
        out.append(np.stack([row[at], item[at], edits[good], start[at], sizes[good]])[:, _new(pair[at][None])])
        settled[pair[at]] = True
    return np.concatenate(out, axis=1)


def proposed(items: Items, data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray, row: np.ndarray):
    """Columns (start, row, item, unlikeness) of windows at which an item of several pieces may begin: all as far from
    where one of its pieces stands, within the piece's own share of edits, as the item's edits can shift it. Unlikeness
    is the shift."""
    edits, _ = edit_distances(items.pieces, data, start, end, piece)
    good = edits <= items.pieces.edits[piece]
    start, piece, row = start[good], piece[good], row[good]
    if not len(start):
        return np.zeros((4, 0), np.int64)
    item, guess = items.item_of[piece], start - items.place_of[piece]
    begins = window_begins(data, offsets)
    low = np.searchsorted(begins, np.maximum(guess - items.edits[item], offsets[row]), side="left")
    high = np.searchsorted(begins, np.minimum(guess + items.edits[item] + 1, offsets[row + 1]), side="left")
    counts = np.maximum(high - low, 0)
    at = begins[spread(low, counts)]
    each = np.repeat(np.arange(len(low)), counts)
    found = np.stack([at, row[each], item[each], np.abs(at - guess[each])])
    found = found[:, np.lexsort(found[[3, 0, 2, 1]])]
    return found[:, _new(found[:3])]


def edit_distances(spans: Spans, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray):
    """Least edits between each span and any prefix of what begins at its window, and the length of the prefix that has
    them and comes closest to the span's; edits beyond the span's limit are not told apart. A span under WHOLE_WORDS bytes
    must not end within a word."""
    letter = _letters(data)
    best, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    order = np.argsort(spans.lengths[which], kind="stable")
    for low, high in lots(np.maximum(spans.lengths[which[order]], 256)):
        part = order[low:high]
        own, at, stop = which[part], starts[part], ends[part]
        n = spans.lengths[own]
        k, most = int(spans.edits[own].max()), int(n.max())
        kind, huge = (np.int16, 10_000) if most < 20_000 else (np.int32, 1 << 29)
        spots = at[:, None] + np.arange(-k, most + k)[None, :]
        inside = (spots >= at[:, None]) & (spots < stop[:, None])
        text = np.where(inside, data[np.clip(spots, 0, len(data) - 1)], 0).T.copy()  # by position
        letters = spans.data[np.minimum(spans.starts[own][None, :] + np.arange(most)[:, None], len(spans.data) - 1)]
        # Row d of a table: the prefix is d - k bytes longer than what is read of the item.
        shift = np.arange(-k, k + 1, dtype=kind)[:, None]
        table = np.where(shift >= 0, shift, kind(huge)).repeat(len(part), axis=1)
        last = table.copy()
        for i in range(most):
            now = table + (text[i : i + 2 * k + 1] != letters[i]).astype(kind)
            np.minimum(now[:-1], table[1:] + kind(1), out=now[:-1])
            step = 1
            while step <= 2 * k:  # bytes put in: the least of all shorter prefixes, by doubling
                now[step:] = np.minimum(now[step:], now[:-step] + kind(step))
                step *= 2
            table = now
            done = n == i + 1
            last[:, done] = table[:, done]
        end = (at + n)[None, :] + shift
        last[end > stop[None, :]] = huge
        inner = (end < stop[None, :]) & letter[np.minimum(end, len(data) - 1)] & letter[np.clip(end - 1, 0, len(data) - 1)]
        last[inner & (n < WHOLE_WORDS)[None, :]] = huge
        column = (last.astype(np.int64) * (2 * k + 2) + np.abs(shift)).argmin(axis=0)
        best[part] = last[column, np.arange(len(part))]
        size[part] = n + column - k
    return best, size


def _found_in(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        for batch in batches:
            for part in runs(batch, run_bytes=RUN_BYTES):
                raw, raw_offsets = flat(part.column("text"))
                data, offsets, source = normalised(raw, raw_offsets)
                rows, which, edits, starts, sizes = matches(own, data, offsets)
                if not len(rows):
                    continue
                leading = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                begin = source[starts]
                end = source[starts + sizes - 1] + 1
                ids = part.column("doc_id").take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(own.ids[which], pa.int64()),
                        pa.array(edits, pa.int32()),
                        pa.array(leading[begin] - leading[raw_offsets[rows]], pa.int32()),
                        pa.array(leading[end] - leading[raw_offsets[rows]], pa.int32()),
                    ],
                    names=["doc_id", "item_id", "edits", "start", "end"],
                )

    return run


def _passes(benchmark: DataFrame) -> Iterator[Items]:
    """Items in passes of bounded size, by item_id. Only sizes are looked at beforehand."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["item_id", "text"])
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-2 * total // PASS_BYTES))
    for k in range(parts):
        table = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k).orderBy("item_id", "text").toArrow().combine_chunks()
        if not table.num_rows:
            continue
        data, offsets, _ = normalised(*flat(table["text"].chunk(0)))
        lengths = np.diff(offsets)
        lengths -= (lengths > 0) & (np.append(data, 0)[offsets[1:] - 1] == 32)  # a blank at the end
        usable = lengths > 0
        if usable.any():
            yield Items(table["item_id"].to_numpy()[usable], data, offsets[:-1][usable], lengths[usable])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document and item of ``benchmark`` (item_id, text) that occurs in it: doc_id, item_id, and the edits, start
    and end (in characters) of a window.

    Case and blanks are evened out. An item occurs if it stands in the text byte for byte, or if some window (see
    ``window_begins``) is within EDIT_SHARE of the item's bytes in edits. Items under WHOLE_WORDS bytes
    occur as whole words only. Verbatim items are always found, edited ones with the recall of the LSH (see the tests).
    Null or empty texts match nothing, nor do items that are empty or without id. Rows that repeat a doc_id
    give rows of their own; a null doc_id stays null. Other columns are not read.
    """
    docs = id_and_text(docs)
    schema = "doc_id long, item_id long, edits int, start int, end int"
    found = docs.sparkSession.createDataFrame([], schema)
    for items in _passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        found = found.unionByName(docs.mapInArrow(_found_in(shared), schema))
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text, ...) in which no item of ``benchmark`` occurs, with all their columns; see
    ``contaminated``."""

    def clean(items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = items.value
            for batch in batches:
                for part in runs(batch, run_bytes=RUN_BYTES):
                    data, offsets, _ = normalised(*flat(part.column("text")))
                    kept = np.ones(part.num_rows, dtype=bool)
                    kept[matches(own, data, offsets)[0]] = False
                    yield part.filter(pa.array(kept))

        return run

    for items in _passes(benchmark):
        docs = with_small_batches(docs).mapInArrow(clean(docs.sparkSession.sparkContext.broadcast(items)), docs.schema)
    return docs


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of ``benchmark`` in all documents; see ``contaminated`` for awkward rows."""
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
