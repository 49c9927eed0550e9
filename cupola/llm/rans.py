"""Static range asymmetric numeral systems over token ids, for many interleaved blocks at once.

A segment of ids has one frequency table, scaled to a power of two, that all its blocks share. A block is coded
by LANES interleaved states into one stream of 32-bit words, independently of the other blocks. Every CHECKPOINT
steps a block records its states and its place in the stream, so decoding can start there as well as at its head.
A block carries the CRC-32 of its ids.

States stay in [2^31, 2^63) and give off at most one word a step. Symbols are coded last to first, so the decoder
runs forward. Arithmetic runs over all lanes of all blocks of a segment at once.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np

LANES = 32
#: Ids of a block; a multiple of LANES.
BLOCK = 1 << 15
#: Steps between checkpoints; a step codes LANES ids.
CHECKPOINT = 512
LOW = np.uint64(1 << 31)


@dataclass
class Segment:
    """What a file row holds: the shared table and the blocks."""

    n: int
    scale: int
    symbols: np.ndarray  # uint32, ascending
    freqs: np.ndarray  # uint32, their sum is 2^scale
    states: np.ndarray  # uint64 [blocks, LANES]: where decoding starts
    words: list[np.ndarray] = field(default_factory=list)  # uint32, the stream of each block
    crcs: list[int] = field(default_factory=list)
    checkpoints: list[np.ndarray] = field(default_factory=list)  # uint64 [k, 1 + LANES] of each block: place in the stream, states


def scaled(counts: np.ndarray, scale: int) -> np.ndarray:
    """Positive counts brought to a sum of 2^scale, each at least 1; what rounding leaves over goes to the largest."""
    total, goal = int(counts.sum()), 1 << scale
    freqs = np.maximum(1, counts * goal // total).astype(np.int64)
    over = int(freqs.sum()) - goal
    order = np.argsort(-freqs, kind="stable")
    if over < 0:
        freqs[order[0]] -= over
    i = 0
    while over > 0:  # take from the largest, at most half of each
        take = min(over, int(freqs[order[i]]) // 2)
        freqs[order[i]] -= take
        over -= take
        i = (i + 1) % len(order)
    return freqs


def encode(ids: np.ndarray) -> Segment:
    """One segment of any number of ids below 2^32."""
    ids = np.asarray(ids, np.uint32)
    if len(ids) and int(ids.max()) < 1 << 22:  # token ids: counting beats sorting
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts).astype(np.uint32)
        number = np.zeros(len(counts), np.int32)
        number[symbols] = np.arange(len(symbols), dtype=np.int32)
        index, counts = number[ids], counts[symbols]
    else:
        symbols, index, counts = np.unique(ids, return_inverse=True, return_counts=True)
    scale = max(16, int(2 * len(symbols)).bit_length())
    if not len(ids):
        return Segment(0, scale, symbols, np.zeros(0, np.uint32), np.zeros((0, LANES), np.uint64))
    freqs = scaled(counts, scale)
    blocks = -(-len(ids) // BLOCK)
    steps = -(-min(BLOCK, len(ids)) // LANES)
    # a last block is filled up with its segment's most frequent symbol; n tells what counts
    padded = np.full(blocks * steps * LANES, int(freqs.argmax()), np.int32)
    padded[: len(ids)] = index
    grid = padded.reshape(blocks, steps, LANES)
    f, start = freqs.astype(np.uint64), (np.cumsum(freqs) - freqs).astype(np.uint64)
    shift, limit = np.uint64(scale), np.uint64(63 - scale)
    x = np.full((blocks, LANES), LOW, np.uint64)
    gave = np.zeros((steps, blocks, LANES), bool)
    word = np.zeros((steps, blocks, LANES), np.uint32)
    marks = []
    for t in range(steps - 1, -1, -1):
        fs = f[grid[:, t]]
        big = x >= fs << limit
        gave[t] = big
        word[t] = x  # the low 32 bits
        x = np.where(big, x >> np.uint64(32), x)
        q = x // fs
        x = (q << shift) + (x - q * fs) + start[grid[:, t]]
        if t and t % CHECKPOINT == 0:
            marks.append((t, x.copy()))
    given = gave.sum(2)  # [steps, blocks]
    place = np.cumsum(given, 0)
    out = Segment(len(ids), scale, symbols, freqs.astype(np.uint32), x)
    for b in range(blocks):
        # the decoder takes lanes in order after each step
        out.words.append(word[:, b][gave[:, b]])
        own = ids[b * BLOCK : (b + 1) * BLOCK]
        out.crcs.append(zlib.crc32(own.astype("<u4").tobytes()))
        out.checkpoints.append(np.array([[place[t - 1, b], *s[b].tolist()] for t, s in marks[::-1]], np.uint64).reshape(-1, LANES + 1))
    return out


def _run(seg: Segment, x: np.ndarray, words: np.ndarray, at: np.ndarray, steps: int) -> np.ndarray:
    """steps x LANES ids of each row of states, its words read from at."""
    mask, shift = np.uint64((1 << seg.scale) - 1), np.uint64(seg.scale)
    f = seg.freqs.astype(np.uint64)
    start = np.cumsum(f) - f
    slot = np.repeat(np.arange(len(f), dtype=np.int32), seg.freqs)
    out = np.empty((len(x), steps, LANES), np.int32)
    words = np.append(words, np.uint32(0)).astype(np.uint64)
    last = len(words) - 1
    for t in range(steps):
        r = x & mask
        s = slot[r]
        out[:, t] = s
        x = f[s] * (x >> shift) + r - start[s]
        need = x < LOW
        rank = np.cumsum(need, 1)
        x = np.where(need, (x << np.uint64(32)) | words[np.minimum(at[:, None] + rank - 1, last)], x)
        at = at + rank[:, -1]
    return seg.symbols[out]


def decode(seg: Segment) -> np.ndarray:
    """All ids of a segment; raises ValueError if a block's checksum differs."""
    if not seg.n:
        return np.zeros(0, np.uint32)
    ends = np.cumsum([len(w) for w in seg.words])
    steps = -(-min(BLOCK, seg.n) // LANES)
    ids = _run(seg, seg.states.copy(), np.concatenate(seg.words), np.concatenate(([0], ends[:-1])), steps).reshape(-1)[: seg.n]
    for b, crc in enumerate(seg.crcs):
        if zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {b}: checksum differs")
    return ids


def decode_range(seg: Segment, start: int, end: int) -> np.ndarray:
    """Ids [start, end) of a segment: each block that holds any is entered at the last checkpoint before them."""
    end = min(end, seg.n)
    parts = []
    for b in range(start // BLOCK, -(-end // BLOCK) if end > start else 0):
        lo, hi = max(start, b * BLOCK) - b * BLOCK, min(end, (b + 1) * BLOCK) - b * BLOCK
        mark = lo // LANES // CHECKPOINT
        own = seg.checkpoints[b]
        x, at = (own[mark - 1, 1:], int(own[mark - 1, 0])) if mark else (seg.states[b], 0)
        first = mark * CHECKPOINT
        ids = _run(seg, x[None].copy(), seg.words[b], np.array([at]), -(-hi // LANES) - first).reshape(-1)
        parts.append(ids[lo - first * LANES : hi - first * LANES])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)
