"""Runs of consecutive words as byte spans, and their 64-bit hashes for whole slices at once.

The words of a slice are laid out with one blank after each, so any run of
words of one text, joined by one blank, is a contiguous span of bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from tidegauge.llm.textbatch import LOWER, text_bytes

#: Bytes of words of letters, digits and everything beyond ASCII, [^\x00-\x2F\x3A-\x60\x7B-\x7F] and A-Z.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

#: Spans at least this long are hashed one by one, and so many are hashed at a time.
LONG_SPAN = 256
SPANS = 1 << 17
WINDOW_BYTES = 8 << 20

# The five odd factors of the published 64-bit xxHash.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


@dataclass(frozen=True)
class Laid:
    """Words of a slice in ``data``: word w is ``data[starts[w]:ends[w]]``; words ``docs[i]:docs[i + 1]`` belong to row i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All runs of ``n`` words: starts, ends, and the first run of each row (with the end)."""
        counts = np.maximum(np.diff(self.docs) - n + 1, 0)
        bounds = np.concatenate(([0], np.cumsum(counts)))
        first = np.arange(bounds[-1]) + np.repeat(self.docs[:-1] - bounds[:-1], counts)
        return self.starts[first], self.ends[first + n - 1], bounds


def laid_out(column: pa.Array, inside: np.ndarray, mapped: np.ndarray = LOWER) -> Laid:
    """The runs of bytes for which ``inside`` holds, as ``mapped`` writes them."""
    data, offsets = text_bytes(column)
    keep = inside[data]
    begins = keep.copy()
    begins[1:] &= ~keep[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = keep[first]
    at = np.flatnonzero(begins)
    kept = np.flatnonzero(keep)
    word = np.cumsum(begins[kept]) - 1
    out = np.full(len(kept) + len(at), 32, np.uint8)
    out[np.arange(len(kept)) + word] = mapped[data[kept]]
    starts = np.searchsorted(kept, at) + np.arange(len(at))
    ends = np.append(starts[1:] - 1, len(out) - 1) if len(at) else starts
    return Laid(out, starts, ends, np.searchsorted(at, offsets))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(state: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turned(state + lane * _P2, 31) * _P1


def _hashed(windows: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    """XXH64 of spans of one length; ``windows[i]`` holds the eight bytes from i on."""
    begin = np.uint64(seed)
    done = 0
    if length >= 32:
        states = [np.full(len(at), x) for x in (begin + _P1 + _P2, begin + _P2, begin, begin - _P1)]
        while done + 32 <= length:
            states = [_round(s, windows[at + done + 8 * i]) for i, s in enumerate(states)]
            done += 32
        value = sum(_turned(s, bits) for s, bits in zip(states, (1, 7, 12, 18)))
        for s in states:
            value = (value ^ _round(np.uint64(0), s)) * _P1 + _P4
    else:
        value = np.full(len(at), begin + _P5)
    value = value + np.uint64(length)
    while done + 8 <= length:
        value = _turned(value ^ _round(np.uint64(0), windows[at + done]), 27) * _P1 + _P4
        done += 8
    if done + 4 <= length:
        value = _turned(value ^ (windows[at + done] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
        done += 4
    while done < length:
        value = _turned(value ^ (windows[at + done] & np.uint64(255)) * _P5, 11) * _P1
        done += 1
    value = (value ^ (value >> np.uint64(33))) * _P2
    value = (value ^ (value >> np.uint64(29))) * _P3
    return value ^ (value >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of ``data[start:end]`` for all spans, which begin in ascending order."""
    out = np.empty(len(starts), np.uint64)
    lengths = ends - starts
    with np.errstate(over="ignore"):
        i = after = 0
        while after < len(starts):
            i = after
            after = max(i + 1, min(i + SPANS, int(np.searchsorted(starts, starts[i] + WINDOW_BYTES))))
            size, begin = lengths[i:after], starts[i:after]
            short = np.flatnonzero(size < LONG_SPAN)
            for j in np.flatnonzero(size >= LONG_SPAN):
                out[i + j] = xxhash.xxh64_intdigest(data[starts[i + j] : ends[i + j]], seed)
            if not len(short):
                continue
            low = int(begin[0])
            high = int((begin + size)[short].max())
            padded = np.zeros(high - low + 8, np.uint8)
            padded[: high - low] = data[low:high]
            windows = np.lib.stride_tricks.as_strided(padded.view(), (high - low + 1, 8), (1, 1)).copy().view("<u8").ravel()
            order = short[np.argsort(size[short].astype(np.uint16), kind="stable")]
            edges = np.flatnonzero(np.diff(size[order], prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(order)]):
                out[i + order[a:b]] = _hashed(windows, begin[order[a:b]] - low, int(size[order[a]]), seed)
    return out
