"""Token ids of whole texts from a public tokenizer file, exactly as the library gives them.

``Encoder.encode(texts)`` returns one ``bytes`` per text: its ids as little-endian unsigned 32-bit
integers.  For a tokenizer that drops white space and splits letters from other characters before
merging, a text's ids are the concatenation of the ids of its pieces, so pieces are encoded once and
kept in a bounded table.  Texts (or parts of them) in which that cannot be seen from the characters
alone go through the library unchanged.  Null counts as empty; an empty text has no ids.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Entries of the piece table of one worker process, and characters beyond which a piece is not kept (a text without white space is one piece); some 130 MB
#: for words of ordinary length, 300 MB if all were as long as may be.
PIECES, LONG = 600_000, 64
#: Characters of the texts whose pieces are held at once.
GROUP = 1 << 20
#: ASCII without the apostrophe, and the letters of Latin-1, which need no normalisation but lower case.
_PLAIN = re.compile(r"[\t-\r -&(-~À-ÖØ-öø-ÿ]*")
#: Unicode white space, which such a tokenizer drops.
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[^\sa-zß-öø-ÿ]+")


def _splits_like_pieces(path: str) -> bool:
    """Whether white space is dropped and letters are split from the rest before merging."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal = json.dumps(spec.get("normalizer") or {})
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    return "Lowercase" in normal and first.get("behavior") == "Removed" and r"[\p{L}]+" in pattern and r"[^\s\p{L}\p{N}]+" in pattern


class Encoder:
    """One tokenizer of the ``tokenizers`` library; ``end_id`` is appended to each text unless None."""

    def __init__(self, path: str, end_id: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._lib = Tokenizer.from_file(path)
        self._pieces: dict[str, bytes] | None = {} if _splits_like_pieces(path) else None
        self._end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self._lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only, taken through the library as one text: cheaper than a call for each."""
        out = []
        for lo in range(0, len(words), 500):
            part = words[lo : lo + 500]
            got = self._lib.encode_batch([" ".join(part)], add_special_tokens=False)[0]
            word = got.word_ids
            if not word or None in word or word[-1] != len(part) - 1:  # it cut words otherwise than at the blanks
                out += self._library(part)
                continue
            raw = np.asarray(got.ids, dtype="<u4").tobytes()
            ends = (4 * np.searchsorted(word, np.arange(1, len(part) + 1))).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def _joined(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of texts from those of their pieces; pieces that are new go through the library once for all of them."""
        table = self._pieces
        missing = set().union(*texts).difference(table)
        if len(table) + len(missing) > PIECES:
            table.clear()
            missing = set().union(*texts)
        words, others = [p for p in missing if _LETTERS.fullmatch(p)], [p for p in missing if not _LETTERS.fullmatch(p)]
        table.update(zip(words, self._words(words), strict=True))
        table.update(zip(others, self._library(others), strict=True))
        out = [b"".join(map(table.__getitem__, pieces)) for pieces in texts]
        for p in missing:
            if len(p) > LONG:
                del table[p]
        return out

    def encode(self, texts) -> list[bytes]:
        if self._pieces is None:
            return [self._library([text or ""])[0] + self._end for text in texts]
        out, held, size = [], [], 0
        for text in texts:
            text = text or ""
            if _PLAIN.fullmatch(text) and "<|" not in text:
                held.append(_PIECE.findall(text.lower()))
            else:
                held.append([p for p in _WHITE.split(text) if p])
            size += len(text)
            if size >= GROUP:
                out += self._joined(held)
                held, size = [], 0
        return [ids + self._end for ids in out + self._joined(held)]


@lru_cache(maxsize=4)
def encoder(path: str, end_id: int | None = None) -> Encoder:
    """The encoder of this worker process; its piece table serves all tasks that run here."""
    return Encoder(path, end_id)


def release() -> None:
    """Give up this process's piece tables; tasks of other operators that run in it call this first."""
    encoder.cache_clear()


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
