"""Hashes of the words of many texts at once, from the bytes of an Arrow column.

A word's hash chains a bijection over its 8-byte pieces, the last one filled up with zeros, and starts from its length:
words of up to 8 bytes never collide within a length, and longer ones no more than random 64-bit values. Words above
`LONG` bytes are hashed with BLAKE2. A second hash with other constants can be had for twice as many bits. Both depend
on the word alone, so equal words agree across blocks, tasks and reruns.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 2 << 20
STEP = 1 << 20
LONG = 256
_STARTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC6BC279692B5C323))
_SPREADS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
_TAILS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ROLL = np.uint64(0xD1342543DE82EF95)


class Alphabet(NamedTuple):
    """For each byte, whether it belongs to a word and the byte it counts as."""

    inside: np.ndarray
    value: np.ndarray


class Block(NamedTuple):
    """Words of documents `low` to `high` of a batch; document i has words first[i] to first[i + 1].

    `start` and `end` are byte positions in `data`, the bytes of the whole batch. Row k of `prefixes` has the hashes of
    the words' first bytes, as many as the k-th prefix length asked for, and 0 for words that are not longer. `others`
    has the second hashes, if they were asked for.
    """

    low: int
    high: int
    hashes: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    prefixes: np.ndarray
    others: np.ndarray


def _alphabet(inside: np.ndarray, fold: bool) -> Alphabet:
    value = np.arange(256, dtype=np.uint8)
    if fold:
        value[ord("A") : ord("Z") + 1] += np.uint8(32)
    return Alphabet(inside, value)


def spaced() -> Alphabet:
    """Words end at ASCII white space and are taken as they are."""
    inside = np.ones(256, dtype=bool)
    inside[[0x20, *range(0x09, 0x0E)]] = False
    return _alphabet(inside, fold=False)


def plain() -> Alphabet:
    """Words hold ASCII letters, digits and all non-ASCII characters; ASCII case is folded."""
    inside = np.zeros(256, dtype=bool)
    for low, high in (("0", "9"), ("A", "Z"), ("a", "z")):
        inside[ord(low) : ord(high) + 1] = True
    inside[128:] = True
    return _alphabet(inside, fold=True)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which nearby values look unrelated."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of byte ranges; `data` goes on for 8 bytes after the last."""
    pieces = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    size = end - start
    out = mixed(size.astype(np.uint64) * _STARTS[which] + _STARTS[1 - which])
    long = np.flatnonzero(size > LONG)
    at = np.flatnonzero(size <= LONG) if len(long) else np.arange(len(size))
    low = start
    while len(at):
        here = low[at]
        left = end[at] - here
        piece = pieces[here] & _TAILS[np.minimum(left, 8)]
        out[at] = mixed((out[at] ^ piece) * _SPREADS[which])
        at = at[left > 8]
        low = low + 8
    for k in long:
        digest = blake2b(data[start[k] : end[k]].tobytes(), digest_size=16).digest()
        out[k] = np.frombuffer(digest, "<u8")[which]
    return out


def _span_words(
    data: np.ndarray, low: int, high: int, edges: np.ndarray, alphabet: Alphabet, lengths: tuple[int, ...], second: bool
):
    part = data[low:high]
    inside = alphabet.inside[part]
    before, after = np.zeros(len(part), bool), np.zeros(len(part), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cut = edges[np.searchsorted(edges, low) : np.searchsorted(edges, high)] - low
    before[cut] = False
    after[cut[cut > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    folded = np.concatenate([alphabet.value[part], np.zeros(8, np.uint8)])
    hashes = byte_hashes(folded, start, end)
    others = byte_hashes(folded, start, end, 1) if second else hashes[:0]
    prefixes = np.zeros((len(lengths), len(start)), np.uint64)
    for k, length in enumerate(lengths):
        longer = np.flatnonzero(end - start > length)
        prefixes[k, longer] = byte_hashes(folded, start[longer], start[longer] + length)
    return hashes, start + low, end + low, prefixes, others


def _cuts(data: np.ndarray, low: int, high: int, alphabet: Alphabet) -> Iterator[tuple[int, int]]:
    """Cut a range of bytes into steps that end at a gap between words."""
    while low < high:
        end = min(low + STEP, high)
        if end < high:
            gaps = np.flatnonzero(~alphabet.inside[data[low:end]])
            if len(gaps):
                end = low + int(gaps[-1]) + 1
            else:
                later = np.flatnonzero(~alphabet.inside[data[end:high]])
                end = end + int(later[0]) + 1 if len(later) else high
        yield low, end
        low = end


def blocks(
    column: pa.Array, alphabet: Alphabet, size: int = BLOCK, prefix_lengths: tuple[int, ...] = (), second: bool = False
) -> Iterator[Block]:
    """The words of a string column, a few documents (about `size` bytes) at a time. Null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        edges = offsets[low : high + 1]
        parts = [
            _span_words(data, a, b, edges, alphabet, prefix_lengths, second)
            for a, b in _cuts(data, int(edges[0]), int(edges[-1]), alphabet)
        ]
        if parts:
            hashes, start, end, prefixes, others = (np.concatenate(x, axis=-1) for x in zip(*parts))
        else:
            hashes, start, end = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            prefixes, others = np.zeros((len(prefix_lengths), 0), np.uint64), hashes
        yield Block(low, high, hashes, np.searchsorted(start, edges), start, end, data, prefixes, others)
        low = high


def runs(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of `length` words inside one document: (unmixed hash, position of the first word, document)."""
    size = len(hashes) - length + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = hashes[:size].copy()
    for k in range(1, length):
        out *= _ROLL
        out += hashes[k : k + size]
    document = np.repeat(np.arange(len(first) - 1), np.diff(first))[:size]
    whole = np.flatnonzero(np.arange(size) + length <= first[document + 1])
    return out[whole], whole, document[whole]
