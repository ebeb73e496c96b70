"""Packing of token sequences into fixed windows by harmonic classes.

A piece of length n belongs to the class k = capacity // n, and a bin of class k takes exactly
k pieces, whatever the other bins hold: workers need to know nothing of each other. What a document has beyond whole windows
stays one piece if k pieces of its length all but fill a bin. Otherwise a piece of the next class's full length,
capacity // (k + 1), is cut off, k + 1 of which fill a bin, and the rest is looked at in the same way. When a worker ends, what lies in its
open bins (fewer than k pieces a class) is placed again, longest first.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import Numbers, distinct_words, release, slices

CAPACITY = 2048
#: Share of a bin that pieces of one class may leave empty.
WASTE = 1 / 32
END = 1


class WordIds:
    """Token ids of texts, by way of the ids of their parts between white space.

    White space always ends a token of this vocabulary and leaves no id, so that a
    text's ids are those of its parts in a row; so does the border between letters and the
    punctuation after them. Parts already met are kept, until there are ``most`` of them or they have ``most_characters``.
    """

    def __init__(self, path: str, most: int = 800_000, most_characters: int = 16 << 20):
        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.most_characters = most, most_characters
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known = Numbers()
        self.starts, self.lengths, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(8192, np.uint32), 0

    def _store(self, numbers: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        need = len(self.known)
        if need > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * need), np.resize(self.lengths, 2 * need)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.used + len(ids)))
        self.starts[numbers] = self.used + np.cumsum(lengths) - lengths
        self.lengths[numbers] = lengths
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered parts in a row, and each one's count."""
        start, n = self.starts[numbers], self.lengths[numbers]
        end = np.cumsum(n, dtype=np.int64)
        return self.ids[np.repeat(start - (end - n), n) + np.arange(end[-1] if len(end) else 0)], n

    def _plain(self, words: list[str]) -> None:
        """Learns words one by one."""
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        lists = [e.ids for e in found]
        self._store(np.array([self.known[w] for w in words]), np.fromiter(map(len, lists), np.int64, len(lists)), np.fromiter((i for x in lists for i in x), np.uint32))

    def _letters(self, words: list[str], run: int = 200) -> None:
        """Learns words of letters, encoded together: each ends at its last token."""
        runs = [words[at : at + run] for at in range(0, len(words), run)]
        odd: list[str] = []
        for part, e in zip(runs, self.tokenizer.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            at = np.flatnonzero(self.ends[ids])
            if len(at) == len(part) and at[-1] == len(ids) - 1:
                self._store(np.array([self.known[w] for w in part]), np.diff(at, prepend=-1), ids)
            else:
                odd += part
        if odd:
            self._plain(odd)

    def _learn(self, fresh: list[str]) -> None:
        alone = pc.utf8_is_alpha(pa.array(fresh, pa.string())).to_numpy(zero_copy_only=False)
        letters, plain, both = [w for w, a in zip(fresh, alone.tolist()) if a], [], []
        for w in [w for w, a in zip(fresh, alone.tolist()) if not a]:
            stem = w.rstrip(TAIL)
            if len(stem) < len(w) and stem.isalpha() and (stem.isascii() or stem.lower().isalpha()):  # a few capitals become a letter and a mark
                both.append((w, stem, w[len(stem) :]))
            else:
                plain.append(w)
        if both:
            _, new = self.known.of(list({x: None for _, stem, tail in both for x in (stem, tail)}))
            for w in new:
                (letters if w.isalpha() else plain).append(w)
        for at in range(0, len(letters), 20_000):
            self._letters(letters[at : at + 20_000])
        for at in range(0, len(plain), 20_000):
            self._plain(plain[at : at + 20_000])
        if both:
            ids, n = self._gather(np.fromiter((self.known[x] for _, stem, tail in both for x in (stem, tail)), np.int64, 2 * len(both)))
            self._store(np.array([self.known[w] for w, _, _ in both]), n[::2] + n[1::2], ids)

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the texts' offsets into them; a null is empty."""
        if len(self.known) > self.most or self.known.characters > self.most_characters:
            self.clear()
        texts = texts.fill_null("") if texts.null_count else texts
        if pc.any(pc.match_substring_regex(texts, ODD)).as_py():
            parts = [SPACE.split(t) for t in texts.to_pylist()]
            offsets = np.cumsum([0] + list(map(len, parts)))
            words = pa.array([w for p in parts for w in p], pa.string())
        else:
            parts = pc.utf8_split_whitespace(texts)
            offsets, words = parts.offsets.to_numpy().astype(np.int64), parts.values
        place, different = distinct_words(words)
        numbers, fresh = self.known.of(different)
        if fresh:
            self._learn(fresh)
        ids, n = self._gather(numbers[place])
        return ids, np.append(0, np.cumsum(n))[offsets]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; a null is empty."""
        ids, at = self.encoded(pa.array(texts, pa.string()))
        return [ids[a:b] for a, b in zip(at[:-1], at[1:])]


#: Punctuation that stands as a token of its own behind letters.
TAIL = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: White space as the vocabulary's normaliser knows it; Python's also has U+001C to U+001F.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD = "[\x1c-\x1f]"


def cuts(length: int, capacity: int = CAPACITY, waste: float = WASTE) -> list[int]:
    """Lengths of the pieces of a document of ``length`` ids."""
    pieces = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        size = rest if k * rest >= capacity * (1 - waste) else capacity // (k + 1)
        pieces.append(size)
        rest -= size
    return pieces


class Harmonic:
    """Bins of one worker. ``add`` gives a piece's bin and offset once its bin is full; the pieces of
    open bins come from ``rest``. Bins are numbered from 0."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.open, self.bins = capacity, {}, 0

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for p in pieces:
            yield (*p, self.bins, at)
            at += p[2]
        self.bins += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        """``piece``: (key, start, length, ...)."""
        k = self.capacity // piece[2]
        waiting = self.open.setdefault(k, [])
        waiting.append(piece)
        if len(waiting) == k:
            del self.open[k]
            yield from self._close(waiting)

    def rest(self) -> Iterator[tuple]:
        """The open bins' pieces, longest first into the first bin with room."""
        left: list[tuple[int, list[tuple]]] = []
        for piece in sorted((p for x in self.open.values() for p in x), key=lambda p: -p[2]):
            for i, (room, held) in enumerate(left):
                if room >= piece[2]:
                    held.append(piece)
                    left[i] = (room - piece[2], held)
                    break
            else:
                left.append((self.capacity - piece[2], [piece]))
        self.open = {}
        for _, held in left:
            yield from self._close(held)


def packed(docs: DataFrame, tokenizer: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    No shuffle: each task packs the rows of its partition. A null or empty text is the end id
    alone; repeated rows are packed as often as they occur; an empty table has no
    pieces; other columns are not read. A task that is run again gives the same pieces and
    sequence ids, as they depend on its rows' order and its partition's number only.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    frame = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)] + [T.StructField(n, T.LongType()) for n in longs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        words, bins, kind, ending = held_tokenizer(path), Harmonic(capacity), None, np.uint32(end).astype("<u4").tobytes()

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:5]), pa.array([number + b for b in cols[5]], pa.int64()), pa.array(cols[6], pa.int64())], [key, *longs])

        for whole in batches:
            kind = whole.column(0).type
            for part in slices(whole, 1024):
                rows: list[tuple] = []
                ids, offsets = words.encoded(part.column(1))
                raw, offsets = ids.astype("<u4").tobytes(), offsets.tolist()
                for k, first, last in zip(part.column(0).to_pylist(), offsets[:-1], offsets[1:]):
                    at, total = 0, last - first + 1
                    for n in cuts(total, capacity):
                        here = zlib.crc32(raw[4 * (first + at) : 4 * min(first + at + n, last)])
                        at += n
                        rows.extend(bins.add((k, at - n, n, zlib.crc32(ending, here) if at == total else here, total)))
                if rows:
                    yield batch(rows)
        if rows := list(bins.rest()):
            yield batch(rows)
        release()

    return frame.mapInArrow(run, schema)


_held: dict[str, WordIds] = {}


def held_tokenizer(path: str) -> WordIds:
    """One for each worker process: what it has learned serves the next task too."""
    if path not in _held:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores have tasks of their own
        _held[path] = WordIds(path)
    return _held[path]


def packing_query(docs: DataFrame) -> DataFrame:
    return packed(docs)
