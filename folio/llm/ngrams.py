"""Word trigrams in packed shards: numpy only, no Spark.

A text is two start symbols, its words' 64-bit hashes and an end symbol.  A triple ``(u, v, w)`` lives in the shard of its
middle word, where both of its pairs can be looked up: all triples with the context ``u v`` and all that hold ``v w`` have that middle word.
Even unigram continuation counts are local: the distinct left neighbours of ``v`` are its contexts' first words, since every
word is followed by another or by the end.

Between tasks triples travel in chunks: sorted distinct hashes (as differences) and codes into them, byte plane by byte plane under zstd.
"""

from __future__ import annotations

import numpy as np

from folio.llm.shingles import mix

START, END = np.uint64(2), np.uint64(3)


def pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize))], "<u8").tobytes()
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpack(raw: bytes) -> list[np.ndarray]:
    """The arrays as unsigned integers of their widths."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(raw)
    k = int(np.frombuffer(raw, "<u8", 1)[0])
    shapes, at, out = np.frombuffer(raw, "<u8", 2 * k, 8).reshape(k, 2).astype(np.int64), 8 + 16 * k, []
    for n, width in shapes:
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).reshape(-1).view(f"<u{width}"))
        at += n * width
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of ascending values, the first kept."""
    x = x.astype(np.uint64)
    return np.diff(x, prepend=np.uint64(0))


def unstep(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.uint64)


def shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    return (mix(words) >> np.uint64(32)).astype(np.int64) % shards


def sequences(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, the places of middle words, and the text of each of these; ``first``: where each text's words begin, and the end."""
    n = np.diff(first)
    starts = np.concatenate([[0], np.cumsum(n + 3)])
    out = np.empty(starts[-1], np.uint64)
    out[np.arange(len(words), dtype=np.int32) + np.repeat(3 * np.arange(len(n), dtype=np.int32) + 2, n)] = words
    out[starts[:-1]] = out[starts[:-1] + 1] = START
    out[starts[1:] - 1] = END
    middle = np.ones(len(out), bool)
    middle[starts[:-1]] = middle[starts[1:] - 1] = False
    return out, np.flatnonzero(middle).astype(np.int32), np.repeat(np.arange(len(n), dtype=np.int32), n + 1)


def dealt(symbols: np.ndarray, at: np.ndarray, shards: int):
    """Yield, for each shard with triples, its number, the sorted hashes that occur in it, codes of ``u, v, w``, and which of ``at`` they are."""
    names, code = np.unique(symbols, return_inverse=True)
    code = code.astype(np.int32)
    of = shard_of(names, shards)[code[at]]
    order = np.argsort(of.astype(np.uint16) if shards < 1 << 16 else of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(bounds)):
        which = order[bounds[s] : bounds[s + 1]]
        triple = [code[at[which] + k] for k in (-1, 0, 1)]
        used = np.zeros(len(names), bool)
        for c in triple:
            used[c] = True
        again = (np.cumsum(used) - 1).astype(np.uint32)
        yield int(s), names[used], *(again[c] for c in triple), which


def narrow(codes: np.ndarray, below: int) -> np.ndarray:
    return codes.astype("<u2" if below <= 1 << 16 else "<u4")


def counted_chunk(names: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> bytes:
    """A chunk of distinct triples with their counts."""
    k = len(names)
    if k < 1 << 21:  # three codes fit in 63 bits
        key, n = np.unique((v.astype(np.int64) * k + u) * k + w, return_counts=True)
        u, v, w = key // k % k, key // (k * k), key % k
    else:
        n = np.ones(len(u), np.int64)
    return pack(steps(names), narrow(u, k), narrow(v, k), narrow(w, k), n.astype("<u4"))


class Counts:
    """Distinct triples of one language and shard, and what follows from them by counting."""

    def __init__(self, words, contexts, of, last, n, pairs, c2, c1):
        #: ``contexts``: codes ``v * size + u``; ``of``, ``last``, ``n``: per triple its context, last word and count; ``pairs``: ``v * size + w``.
        self.words, self.contexts, self.of, self.last, self.n, self.pairs, self.c2, self.c1 = words, contexts, of, last, n, pairs, c2, c1

    @classmethod
    def gathered(cls, chunks: list[bytes]) -> Counts:
        parts = [unpack(c) for c in chunks]
        named = [unstep(p[0]) for p in parts]
        words = np.unique(np.concatenate(named))
        size = len(words)
        again = [np.searchsorted(words, d).astype(np.int64) for d in named]
        u, v, w = (np.concatenate([a[p[k]] for a, p in zip(again, parts, strict=True)]) for k in (1, 2, 3))
        n = np.concatenate([p[4] for p in parts]).astype(np.int64)
        contexts, of = np.unique(v * size + u, return_inverse=True)
        del u, v
        key = of * size + w
        del of, w
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.add.reduceat(n[order], new)
        key = key[new]
        of, last = key // size, key % size
        middle = contexts // size
        pairs, c2 = np.unique(middle[of] * size + last, return_counts=True)
        c1 = np.bincount(middle, minlength=size)
        c1[np.searchsorted(words, START) % size] *= words[np.searchsorted(words, START) % size] != START  # the start is no word
        return cls(words, contexts, of, last, n, pairs, c2, c1)

    def packed(self) -> bytes:
        return pack(steps(self.words), steps(self.contexts), steps(self.of).astype("<u4"), narrow(self.last, len(self.words)), self.n.astype("<u4"), steps(self.pairs), self.c2.astype("<u4"), self.c1.astype("<u4"))

    @classmethod
    def unpacked(cls, raw: bytes) -> Counts:
        words, contexts, of, last, n, pairs, c2, c1 = unpack(raw)
        return cls(unstep(words), unstep(contexts).astype(np.int64), unstep(of).astype(np.int64), last.astype(np.int64), n.astype(np.int64), unstep(pairs).astype(np.int64), c2.astype(np.int64), c1.astype(np.int64))

    def summary(self) -> list[int]:
        """Per order how many grams have counts 1 to 4; how many words, the sum of their counts, and of those before the end."""
        at = [np.bincount(np.minimum(x, 5), minlength=6)[1:5] for x in (self.c1, self.c2, self.n)]
        ends = np.searchsorted(self.words, END)
        before = int((self.pairs % len(self.words) == ends).sum()) if ends < len(self.words) and self.words[ends] == END else 0
        return [int(x) for x in np.concatenate(at)] + [int((self.c1 > 0).sum()), int(self.c1.sum()), before]

    def asked(self, shards: int) -> list[tuple[int, np.ndarray]]:
        """Per shard the codes of last words whose continuation counts it holds; the end is nobody's."""
        last = np.unique(self.pairs % len(self.words))
        last = last[self.words[last] != END]
        of = shard_of(self.words[last], shards)
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(shards + 1))
        return [(int(s), last[order[bounds[s] : bounds[s + 1]]]) for s in np.flatnonzero(np.diff(bounds))]


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Three discounts from counts of counts; where these are too few for the estimate, the usual 0.5, 1, 1.5."""
    if not (n1 and n2 and n3):
        return np.array([0.5, 1.0, 1.5])
    y, n = n1 / (n1 + 2 * n2), (n1, n2, n3, n4)
    return np.array([min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)])


class Language:
    """What all shards of a language's model share: discounts and the lowest order."""

    def __init__(self, summary: list[int]):
        ones, self.d2, self.d3 = list(summary[:4]), discounts(*summary[4:8]), discounts(*summary[8:12])
        words, total, ends = summary[12:15]
        if 1 <= ends <= 4:  # the end is a word of the lowest order too
            ones[ends - 1] += 1
        self.d1 = discounts(*ones)
        only = summary[:2]
        left = self.d1 @ [only[0], only[1], words - sum(only)] + (self.cut(self.d1, ends) if ends else 0)
        #: the probability of a word that was not seen; all such words are one more kind
        self.rest = left / (total + ends) / (words + bool(ends) + 1)
        self.total, self.base = total + ends, float(np.log(self.rest))
        self.end = float(self.p1(ends))
        self.end_gain = float(np.log(self.end) - self.base)

    @staticmethod
    def cut(d: np.ndarray, n):
        return d[np.minimum(n, 3) - 1]

    def p1(self, n):
        return np.where(n > 0, (n - self.cut(self.d1, np.maximum(n, 1))) / self.total, 0.0) + self.rest


class Model:
    """Log weights of one language and shard: ``value`` by middle word, ``back`` by context, ``gain2`` by pair, ``gain3`` by triple."""

    def __init__(self, words, value, contexts, back, pairs, gain2, triples, gain3):
        self.words, self.value, self.contexts, self.back, self.pairs, self.gain2, self.triples, self.gain3 = words, value, contexts, back, pairs, gain2, triples, gain3

    @classmethod
    def made(cls, c: Counts, c1_of: np.ndarray, lang: Language) -> Model:
        """``c1_of``: continuation counts of all words of the shard that end a pair (others 0)."""
        size = len(c.words)
        middle, last = c.pairs // size, c.pairs % size
        p1 = lang.p1(c1_of)
        p1[c.words == END] = lang.end
        cut = lang.cut(lang.d2, c.c2)
        total = np.bincount(middle, c.c2, size)
        left = np.bincount(middle, cut, size)
        seen = total > 0
        gamma = np.divide(left, total, where=seen, out=np.ones(size))
        rest = gamma[middle] * p1[last]
        p2 = (c.c2 - cut) / total[middle] + rest
        value = np.where(c.c1 > 0, np.log(lang.p1(c.c1)) - lang.base, 0.0) + np.log(gamma)
        gain2 = np.log(p2 / rest)
        cut = lang.cut(lang.d3, c.n)
        total3 = np.bincount(c.of, c.n, len(c.contexts))
        gamma3 = np.bincount(c.of, cut, len(c.contexts)) / total3
        low = p2[np.searchsorted(c.pairs, c.contexts[c.of] // size * size + c.last)]
        rest = gamma3[c.of] * low
        gain3 = np.log(((c.n - cut) / total3[c.of] + rest) / rest)
        return cls(c.words, value, c.contexts, np.log(gamma3), c.pairs, gain2, c.of * size + c.last, gain3)

    def packed(self) -> bytes:
        f4 = lambda x: x.astype("<f4").view("<u4")
        return pack(steps(self.words), f4(self.value), steps(self.contexts), f4(self.back), steps(self.pairs), f4(self.gain2), steps(self.triples), f4(self.gain3))

    @classmethod
    def unpacked(cls, raw: bytes) -> Model:
        a = unpack(raw)
        f = lambda x: x.view("<f4")
        return cls(unstep(a[0]), f(a[1]), unstep(a[2]).astype(np.int64), f(a[3]), unstep(a[4]).astype(np.int64), f(a[5]), unstep(a[6]).astype(np.int64), f(a[7]))

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values())

    @staticmethod
    def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)

    def weights(self, names: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of each triple what its log probability has above that of an unseen word; the lowest order counts for the middle word."""
        size = len(self.words)
        code, known = self._found(self.words, names)
        code = np.where(known, code, -1).astype(np.int64)
        u, v, w = code[u], code[v], code[w]
        out = np.where(v >= 0, self.value[v].astype(np.float64), 0.0)
        both = np.flatnonzero((v >= 0) & (w >= 0))
        at, hit = self._found(self.pairs, v[both] * size + w[both])
        out[both[hit]] += self.gain2[at[hit]]
        both = np.flatnonzero((v >= 0) & (u >= 0))
        at, hit = self._found(self.contexts, v[both] * size + u[both])
        both, at = both[hit], at[hit]
        out[both] += self.back[at]
        some = w[both] >= 0
        both, at = both[some], at[some]
        at, hit = self._found(self.triples, at * size + w[both])
        out[both[hit]] += self.gain3[at[hit]]
        return out
