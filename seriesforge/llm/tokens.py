"""Token ids of whole texts, by a public tokenizer, with a bounded cache of words per worker."""

from __future__ import annotations

from itertools import chain

import numpy as np
import regex

from seriesforge.llm.arrays import ranges, secret, words

# Fixed value: how the tokenizer cuts lower-cased text.
CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _letters() -> dict[int, str]:
    """Byte-level BPE's letters for each character up to 255: visible bytes stand for themselves,
    the others are moved past 255."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    letter = [chr(b) if b in visible else chr(next(moved)) for b in range(256)]
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


LETTERS = _letters()

#: Words that one worker process keeps; past this the cache starts anew.
CACHE_WORDS, CACHE_PARTS = 1_000_000, 50_000


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts as the tokenizer does, word by word.

    The tokenizer must drop white space and never join across it (as word_bpe_49k does), so that
    a text's ids are those of its words, one after another. A batch's words are told apart by a
    64-bit hash of their bytes, under a key that each worker draws for itself; each distinct word is looked up once.
    """

    _of: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, list[int]] = {}
        self.key = secret()
        self._clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def _clear(self) -> None:
        self.hashes, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # ascending hashes; their places
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.parts.clear()

    def _word(self, word: str) -> list[int]:
        try:
            latin = word.isascii() or bool(word.encode("latin-1"))
        except UnicodeEncodeError:
            latin = False
        if latin and word.isprintable():  # composed already; lower case is letter by letter
            low = word.lower()
            if low.isalpha():
                cut = (low,)
            elif low[:-1].isalpha() and low[-1] in ".,":
                cut = (low[:-1], low[-1])
            else:
                cut = CUT.findall(low)
            if not low.isascii():
                cut = [x.translate(LETTERS) for x in cut]
        else:
            normal = self.tokenizer.normalizer.normalize_str(word)
            cut = [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        out: list[int] = []
        for x in cut:
            if (ids := self.parts.get(x)) is None:
                ids = [t.id for t in self.tokenizer.model.tokenize(x)]
                if len(self.parts) < CACHE_PARTS:
                    self.parts[x] = ids
            out += ids
        return out

    def _learn(self, words: list[str], hashes: np.ndarray) -> None:
        found = [self._word(x) for x in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(sizes) - sizes))
        places = len(self.count) + np.arange(len(found))
        self.count = np.concatenate((self.count, sizes))
        self.ids = np.concatenate((self.ids, flat))
        spot = np.searchsorted(self.hashes, hashes)
        self.hashes, self.at = np.insert(self.hashes, spot, hashes), np.insert(self.at, spot, places)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another (uint32) and the number of ids of each text; null is empty."""
        raw = [(x or "").encode() for x in texts]
        data = b"\n".join(raw)
        start, end, h = words(data, key=self.key)
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE_WORDS:
            self._clear()
        place = np.searchsorted(self.hashes, distinct)
        new = np.flatnonzero(np.append(self.hashes, np.uint64(0))[place] != distinct) if len(self.hashes) else np.arange(len(distinct))
        if len(new):
            self._learn([data[s:e].decode() for s, e in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)], distinct[new])
            place = np.searchsorted(self.hashes, distinct)
        at = self.at[place[which]] if len(h) else which
        count = self.count[at]
        ids = self.ids[ranges(self.start[at], count)]
        ends = np.concatenate(([0], np.cumsum(count)))
        bounds = np.cumsum([len(x) + 1 for x in raw], dtype=np.int64)
        upto = ends[np.searchsorted(start, bounds)]
        return ids, np.diff(upto, prepend=0)
