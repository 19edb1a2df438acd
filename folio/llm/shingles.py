"""Vectorised word-shingle sets.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z (other
letters stay as they are).  A text's shingles are its runs of ``width`` consecutive words; a text
of fewer words has one shingle, the whole sequence; a text without words has none.

A word's hash starts from its length and takes in its bytes by eights, each step followed by a full 64-bit finaliser (words of more than
64 bytes: BLAKE2b), so words of up to 8 bytes and one length never collide; a shingle's hash mixes the hashes of its words in
order.  All but long words is 64-bit numpy arithmetic over one whole Arrow batch.  Two different shingles of ordinary text share a hash with odds of
about 2**-64; the hash is not keyed, so a text made for the purpose could contain a collision.
"""

from __future__ import annotations

import hashlib

import numpy as np

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD1342543DE82EF95)
_BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Bytes beyond which a word is hashed by itself.
_LONG = 64


def _hash_words(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word, eight at a time for all words at once."""
    sizes = ends - starts
    eight = np.ndarray((len(part),), "<u8", buffer=np.concatenate([part, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix((sizes.astype(np.uint64) + np.uint64(1)) * _STEP)
    left = np.flatnonzero(sizes <= _LONG)
    for k in range(0, _LONG, 8):
        if k:
            left = left[sizes[left] > k]
        if not len(left):
            break
        h[left] = mix((h[left] ^ eight[starts[left] + k] & _MASKS[np.minimum(sizes[left] - k, 8)]) + _STEP)
    for i in np.flatnonzero(sizes > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(part[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch of texts, and per text the index of its first word.

    ``data`` holds the UTF-8 bytes of all texts, text *i* being ``data[offsets[i]:offsets[i + 1]]``.
    """
    out, text_of = [], []
    n, at = len(offsets) - 1, 0
    while at < n:  # texts are taken in blocks that bound the scratch arrays; a longer text is a block of its own
        upto = int(np.searchsorted(offsets, offsets[at] + _BLOCK, side="right")) - 1
        upto = min(max(upto, at + 1), n)
        lo, hi = int(offsets[at]), int(offsets[upto])
        part = _LOWER[data[lo:hi]] if lower else data[lo:hi]
        space = _SPACE[part]
        cuts = offsets[at:upto] - lo
        is_start = ~space
        is_start[1:] &= space[:-1]
        first = cuts[cuts < len(part)]
        is_start[first] = ~space[first]
        starts = np.flatnonzero(is_start)
        is_end = ~space
        is_end[:-1] &= space[1:]
        last = cuts[cuts > 0] - 1
        is_end[last] = ~space[last]
        out.append(_hash_words(part, starts, np.flatnonzero(is_end) + 1))
        text_of.append(np.searchsorted(starts, np.append(cuts, len(part)), side="left"))
        at = upto
    words = np.concatenate(out) if out else np.empty(0, np.uint64)
    first_word, base = [np.zeros(1, np.int64)], 0
    for bounds in text_of:
        first_word.append(bounds[1:] + base)
        base += int(bounds[-1])
    return words, np.concatenate(first_word).astype(np.int64)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, for every start where one fits in ``words``."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = (total + words[k : k + n]) * _STEP
    return mix(total + np.uint64(width))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5):
    """Yield, text by text, the sorted distinct shingle hashes (empty without words)."""
    words, first = word_hashes(data, offsets)
    all_shingles = shingle_hashes(words, width)
    for i in range(len(offsets) - 1):
        lo, hi = int(first[i]), int(first[i + 1])
        if hi - lo >= width:
            yield np.unique(all_shingles[lo : hi - width + 1])
        elif hi > lo:
            yield shingle_hashes(words[lo:hi], hi - lo)
        else:
            yield np.empty(0, np.uint64)


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
