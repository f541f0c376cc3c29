"""Fast similarity sketching: a sketch of t coordinates, of which two sets share each with probability their Jaccard
similarity, filled in rounds of hashed bin placement.

In round i every element falls into one bin of t with a value; a bin keeps the least value of the first round that
reached it. Rounds t to 2t - 1 send every element to bin i - t, so that after them no bin can be empty. Large sets
are done after one or two rounds; a set of one element needs about t log t.
"""

from __future__ import annotations

import numpy as np

from tallyframe.llm.batches import U64, mix

_EMPTY = np.uint64(2**64 - 1)


def sketches(sets: list[np.ndarray], t: int = 128, seed: int = 1) -> np.ndarray:
    """One row of t values per set; a row of an empty set holds no meaning. t is a power of two, 256 at most."""
    out = np.full((len(sets), t), _EMPTY, dtype=np.uint64)
    flat_out = out.reshape(-1)
    open_rows = np.array([r for r, s in enumerate(sets) if len(s)], dtype=np.int64)
    bits = U64(t.bit_length() - 1)
    for round_ in range(2 * t):
        if not len(open_rows):
            break
        elements = np.concatenate([sets[r] for r in open_rows])
        owner = np.repeat(open_rows, [len(sets[r]) for r in open_rows])
        salt = U64(((seed << 20) + round_ + 1) * 0x9E3779B97F4A7C15 % 2**64)
        hashed = mix(elements ^ mix(np.array([salt], dtype=np.uint64))[0])
        bins = (hashed & U64(t - 1)).astype(np.int64) if round_ < t else np.full(len(hashed), round_ - t)
        # The round leads each value, so that bins filled in earlier rounds hold smaller ones already.
        values = (hashed >> bits >> U64(9)) | (U64(round_) << U64(55))
        np.minimum.at(flat_out, owner * t + bins, values)
        open_rows = open_rows[(out[open_rows] == _EMPTY).any(axis=1)]
    return out


def band_keys(sketch: np.ndarray, rows_per_band: int) -> np.ndarray:
    """One key per band of coordinates, told apart by the band's place."""
    n, t = sketch.shape
    bands = t // rows_per_band
    parts = sketch[:, : bands * rows_per_band].reshape(n, bands, rows_per_band)
    keys = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
    for k in range(rows_per_band):
        keys = mix(keys * U64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys
