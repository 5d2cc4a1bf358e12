"""Substring dedup by words: repeated-phrase automata.

1. Recurring phrases are confirmed across buckets of documents (recurrence.py): passages, and
   windows where passages overlap in part; each bucket is told which of its own phrases recur, and
   the first document of each.
2. Each bucket compiles its phrases into Aho-Corasick automata over word numbers, a bounded number of
   words in each. A phrase's words are read where it first stands in the bucket. A phrase goes to
   the automata of those buckets that hold it, so a text is read against the phrases that it can
   hold, and not against those of the whole corpus.
3. All documents of the bucket stream through its automata, which locate every occurrence of every
   phrase, inside longer passages too. An occurrence is removed if it stands after the phrase's
   first known place, by (doc_id, start); the first one stays wherever it is.

Every window that occurs earlier is covered by a phrase that is told so, and every occurrence after
a phrase's first known place does occur earlier; so the words removed are those asked for.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from seriesforge.llm import arrays as A
from seriesforge.llm import recurrence as R
from seriesforge.llm.common import NO_ID, bucketed, runs, text_width

WINDOW, GRAM = 20, 10
#: Words in the patterns of one automaton.
SHARD_WORDS = 1_000_000
#: Bits of a later symbol of a word's code, and how many first symbols each length of code has.
DIGIT_BITS, FIRSTS = 5, 16
U64 = np.uint64


def _words(texts: pa.Array, key: bytes = b""):
    """Parts of a bucket: first text, bytes, starts and ends of words, hashes, words per text."""
    for low, high in runs(texts, 2 << 20):
        raw = [(x or "").encode() for x in texts.slice(low, high - low).to_pylist()]
        data = b"\n".join(raw)
        start, end, h = A.words(data, key=key)
        edge = np.searchsorted(start, np.cumsum([0] + [len(x) + 1 for x in raw]))
        yield low, data, start, end, h, edge


def scheme(window: int = WINDOW, gram: int = GRAM, key: bytes = b"") -> R.Scheme:
    def cut(texts: pa.Array):
        for low, _, _, _, h, edge in _words(texts, key):
            yield low, h, edge[:-1], np.diff(edge)

    return R.Scheme(cut, window, gram)


@dataclass
class Codes:
    """Words of a bucket, by number, as codes of small symbols: the more frequent a word, the shorter its code.

    pyahocorasick searches the children of a node one by one, so no node should have a child for every word. A code of n symbols has
    one of FIRSTS first symbols of its own length and n - 1 later ones; first symbols occur nowhere else, so matches start
    and end at words.
    """

    symbol: np.ndarray  # of all words' codes, one after another
    at: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, number: np.ndarray) -> Codes:
        often = np.bincount(number)
        rank = np.empty(len(often), np.int64)
        rank[np.argsort(-often, kind="stable")] = np.arange(len(often))
        size = np.ones(len(often), np.int64)
        first, n = np.zeros(len(often), np.int64), 1
        low = 0  # ranks below have shorter codes
        while low + (room := FIRSTS << (DIGIT_BITS * (n - 1))) < len(often):
            low, n = low + room, n + 1
            longer = rank >= low
            size[longer], first[longer] = n, low
        at = np.cumsum(size) - size
        symbol = np.zeros(int(size.sum()), np.uint8)
        for m in range(1, n + 1):
            own = np.flatnonzero(size == m)
            value = rank[own] - first[own]
            symbol[at[own]] = (m - 1) * FIRSTS + (value >> (DIGIT_BITS * (m - 1)))
            for k in range(1, m):
                symbol[at[own] + k] = n * FIRSTS + ((value >> (DIGIT_BITS * (m - 1 - k))) & ((1 << DIGIT_BITS) - 1))
        return cls(symbol, at, size)

    def encode(self, number: np.ndarray, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of words, one after another, and where each word's end, from 0 on with the first one's start."""
        ends = np.concatenate(([0], np.cumsum(self.size[number])))
        parts = [self.symbol[A.ranges(self.at[x], self.size[x])] for x in (number[i : i + step] for i in range(0, len(number), step))]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint8), ends


def automata(patterns, symbol: np.ndarray, ends: np.ndarray, shard_words: int = SHARD_WORDS):
    """Aho-Corasick automata over the symbols of words, for patterns (start, words, label) in the text encoded.

    Each match tells the pattern's label.
    """
    held, made = 0, None
    for start, size, label in patterns:
        if made is None:
            made = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        made.add_word(tuple(symbol[ends[start] : ends[start + size]].tolist()), label)
        held += size
        if held >= shard_words:
            made.make_automaton()
            yield made
            held, made = 0, None
    if made is not None:
        made.make_automaton()
        yield made


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


@dataclass
class Phrases:
    """Confirmed phrases of a bucket: place and number of words of the first occurrence here, and the
    word from which on an occurrence is not the first."""

    start: np.ndarray
    size: np.ndarray
    after: np.ndarray


def confirmed(ids: np.ndarray, base: np.ndarray, texts: pa.Array, answers: pa.Table, scheme: R.Scheme) -> Phrases:
    """The bucket's phrases that recur: those told by others, and those that stand here twice.

    base: the place of each document's first word in the bucket.
    """
    one = answers.filter(pc.equal(answers.column("step"), 1))
    two = answers.filter(pc.equal(answers.column("step"), 2))
    every = scheme.runs(texts)
    shown = R.open_windows(texts, ids, one, scheme, inner=True)
    found = []
    for name, check, place, size, names in (
        (every.passage, every.check, base[every.doc] + every.first, every.last - every.first + scheme.window, R.told(one, R.SETTLED)),
        (shown.name, shown.check, base[shown.doc] + shown.at, np.full(len(shown.at), scheme.window), R.told(two, R.SETTLED)),
    ):
        if not len(name):
            continue
        order, starts = A.same_pairs(name, check)
        head, first = order[starts], np.minimum.reduceat(place[order], starts)
        often = np.diff(np.append(starts, len(order)))
        at, known = names.find(name[head], check[head])
        # Told of an earlier document: all that stands in later documents recurs. Else the first place here is the first.
        after = first + 1
        if known.any():
            beyond = np.append(base, np.iinfo(np.int64).max)[np.searchsorted(ids, names.doc[at[known]], side="right")]
            after[known] = np.minimum(after[known], beyond)
        on = known | (often > 1)
        found.append((first[on], size[head][on], after[on]))
    return Phrases(*(np.concatenate(c) for c in zip(*found, strict=True))) if found else Phrases(*[np.zeros(0, np.int64)] * 3)


def _remove(group: pa.Table, answers: pa.Table, window: int, gram: int, key: bytes) -> pa.Table:
    if not group.num_rows:
        return R.table([], RESULT)
    ids, texts = R.in_order(group)
    # The bucket's words are cut and hashed once: 16 bytes for each.
    cut = [(low, start.astype(np.int32), end.astype(np.int32), h, edge) for low, _, start, end, h, edge in _words(texts, key)]
    h, count = np.concatenate([x[3] for x in cut]), np.concatenate([np.diff(x[4]) for x in cut])
    base = np.cumsum(count) - count
    known = R.Scheme(lambda _: ((low, h, edge[:-1], np.diff(edge)) for low, _, _, h, edge in cut), window, gram)
    phrases = confirmed(ids, base, texts, answers, known)
    mask = np.zeros(len(h), bool)
    if len(phrases.start):
        _, number = np.unique(h, return_inverse=True)
        mask = _locate(phrases, number, base, count)
    rows = []
    for low, w_start, w_end, _, edge in cut:
        data = b"\n".join([(x or "").encode() for x in texts.slice(low, len(edge) - 1).to_pylist()])
        for i in range(len(edge) - 1):
            a, b = int(edge[i]), int(edge[i + 1])
            off = mask[base[low + i] : base[low + i] + b - a]
            kept = np.flatnonzero(~off) + a
            words = [data[s:e] for s, e in zip(w_start[kept].tolist(), w_end[kept].tolist(), strict=True)]
            doc = None if ids[low + i] == NO_ID else int(ids[low + i])
            rows.append((doc, b - a, int(off.sum()), hashlib.sha256(b" ".join(words)).hexdigest()))
    return R.table(rows, RESULT)


def _locate(phrases: Phrases, number: np.ndarray, base: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Words covered by an occurrence of a phrase after its first known place.

    The automata of a bucket share out its phrases; every document runs through all of them.
    """
    delta = np.zeros(len(number) + 1, np.int64)
    symbol, ends = Codes.of(number).encode(number)
    patterns = zip(phrases.start.tolist(), phrases.size.tolist(), range(len(phrases.start)), strict=True)
    for machine in automata(patterns, symbol, ends):
        for b, n in zip(base.tolist(), count.tolist(), strict=True):
            low = int(ends[b])
            found = list(machine.iter(tuple(symbol[low : ends[b + n]].tolist())))
            if found:
                last, label = np.array(found, np.int64).T
                begin = np.searchsorted(ends[b : b + n + 1], last + low + 1) + b - phrases.size[label]
                on = begin >= phrases.after[label]
                np.add.at(delta, begin[on], 1)
                np.add.at(delta, begin[on] + phrases.size[label[on]], -1)
    return np.cumsum(delta[:-1]) > 0


def remove_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document.

    Removed is each word covered by `window` consecutive words that also start earlier: in a
    smaller doc_id, or earlier in the same document; windows are judged on the input. Null and
    empty texts have no words. Rows of one doc_id are read one after another, by text, as one document.
    Rows without doc_id stand before all others, and are kept with a null id; an empty table gives
    none. Columns other than doc_id and text don't matter.
    """
    width, key = text_width(docs), A.secret()
    own = bucketed(docs, width, "text")
    told = R.answers(own, scheme(window, gram, key), width)
    return own.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(
        A.on_groups(lambda a, b: _remove(a, b, window, gram, key)), RESULT
    )
