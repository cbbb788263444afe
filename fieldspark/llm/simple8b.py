"""Simple-8b word-aligned integer coding in numpy, with escapes and per-block offsets."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids in a word and bits of each, by selector (the high four bits). Selector 1 is the escape: its low
#: 60 bits point into the segment's table of values that need more than 60 bits.
COUNTS = np.array([240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
ESCAPE = 1
BLOCK = 1024
PAD = 240
MAGIC = b"FS8B"
HEADER = struct.Struct("<4sIQIIQII")  # magic, version, ids, block size, blocks, words, escapes, crc32 of the rest
_ORDER = [s for s in range(16) if s != ESCAPE]  # from most ids in a word to fewest


def _widths(v: np.ndarray) -> np.ndarray:
    return np.frexp(v.astype(np.float64))[1].astype(np.uint8)


def _choose(widths: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best selector at every position of padded blocks: the largest count whose values, as far as the block goes, fit."""
    n = BLOCK
    maxima = {1: widths}
    size = 1
    while size < 128:
        prev = maxima[size]
        nxt = prev.copy()
        nxt[:, :-size] = np.maximum(prev[:, :-size], prev[:, size:])
        size *= 2
        maxima[size] = nxt
    best = np.full((len(widths), n), ESCAPE, np.uint8)
    free = np.ones((len(widths), n), bool)
    for s in _ORDER:
        c = int(COUNTS[s])
        p = 1 << (c.bit_length() - 1)
        m = maxima[p]
        top = np.maximum(m[:, :n], m[:, c - p : c - p + n])
        fits = free & (top <= BITS[s])
        best[fits] = s
        free &= ~fits
    return best


def _encode_blocks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, words in each block, escaped values (in order) of at most a few thousand blocks."""
    blocks = -(-len(values) // BLOCK)
    lengths = np.full(blocks, BLOCK, np.int64)
    lengths[-1] = len(values) - (blocks - 1) * BLOCK
    table = np.zeros((blocks, BLOCK + PAD), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[: len(values)] = values
    table[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    best = _choose(_widths(table), lengths)
    rows, pos, steps = np.arange(blocks), np.zeros(blocks, np.int64), []
    while len(rows):  # all blocks take their next word together
        sel = best[rows, pos]
        steps.append((rows, pos, sel))
        nxt = pos + COUNTS[sel]
        on = nxt < lengths[rows]
        rows, pos = rows[on], nxt[on]
    r, p, s = (np.concatenate([x[i] for x in steps]) for i in range(3))
    order = np.lexsort((p, r))
    r, p, s = r[order], p[order], s[order].astype(np.int64)
    words = s.astype(np.uint64) << np.uint64(60)
    for sel in np.unique(s):
        at = np.flatnonzero(s == sel)
        if sel == ESCAPE:
            continue
        c, b = int(COUNTS[sel]), int(BITS[sel])
        if b:
            got = table[r[at][:, None], p[at][:, None] + np.arange(c)]
            words[at] |= np.bitwise_or.reduce(got << (np.arange(c) * b).astype(np.uint64), axis=1)
    escaped = np.flatnonzero(s == ESCAPE)
    return words, np.bincount(r, minlength=blocks), table[r[escaped], p[escaped]]


def encode(values: np.ndarray) -> bytes:
    """A self-contained segment for an array of unsigned integers (any 64-bit values)."""
    values = np.asarray(values, np.uint64)
    words, sizes, extras, known = [], [], [], 0
    step = BLOCK * 1024
    for at in range(0, len(values), step):
        w, n, x = _encode_blocks(values[at : at + step])
        if len(x):
            w = w.copy()
            w[(w >> np.uint64(60)) == ESCAPE] |= np.arange(known, known + len(x), dtype=np.uint64)
            known += len(x)
        words.append(w), sizes.append(n), extras.append(x)
    words = np.concatenate(words) if words else np.zeros(0, np.uint64)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
    extras = np.concatenate(extras) if extras else np.zeros(0, np.uint64)
    body = offsets.astype("<u8").tobytes() + extras.astype("<u8").tobytes() + words.astype("<u8").tobytes()
    return HEADER.pack(MAGIC, 1, len(values), BLOCK, len(offsets) - 1, len(words), len(extras), zlib.crc32(body)) + body


def decode(segment: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The integers of blocks first_block to last_block (exclusive; default all), found by the block offsets."""
    magic, version, n, block, blocks, n_words, n_extra, crc = HEADER.unpack_from(segment)
    if magic != MAGIC or version != 1 or zlib.crc32(segment[HEADER.size :]) != crc:
        raise ValueError("not a segment, or damaged")
    at = HEADER.size
    offsets = np.frombuffer(segment, "<u8", blocks + 1, at).astype(np.int64)
    extras = np.frombuffer(segment, "<u8", n_extra, at + 8 * (blocks + 1))
    words = np.frombuffer(segment, "<u8", n_words, at + 8 * (blocks + 1 + n_extra))
    last_block = blocks if last_block is None else min(last_block, blocks)
    if first_block >= last_block:
        return np.zeros(0, np.uint64)
    offsets = offsets[first_block : last_block + 1]
    words = words[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    ends = np.minimum(np.arange(first_block + 1, last_block + 1) * block, n) - first_block * block
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[sel]
    before = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(ends)), np.diff(offsets))
    start = before - before[offsets[:-1]][owner] + owner * block
    stop = ends[owner]
    out = np.zeros(ends[-1] + PAD, np.uint64)
    for s in np.unique(sel):
        i = np.flatnonzero(sel == s)
        c, b = int(COUNTS[s]), int(BITS[s])
        low = words[i] & np.uint64((1 << 60) - 1)
        if s == ESCAPE:
            got = extras[low.astype(np.int64)][:, None]
        elif b == 0:
            continue
        else:
            got = (low[:, None] >> (np.arange(c) * b).astype(np.uint64)) & np.uint64((1 << b) - 1)
        to = start[i][:, None] + np.arange(c)
        keep = to < stop[i][:, None]
        out[to[keep]] = got[keep]
    return out[: ends[-1]]
