"""Sampled segmentations over a SentencePiece vocabulary, and lossless decoding.

A text becomes the lattice of all ways to spell it with the vocabulary's pieces. Forward filtering adds up the
probabilities of the paths to every place, backward sampling then draws a path piece by piece from the end.
Draws are numbered hashes of the row's key, so that a row has the same segmentation wherever it is
processed. No piece of such a vocabulary crosses from a word into the next one's leading space, so the lattice falls apart into words, and
the forward pass of a word serves all its occurrences.

The vocabulary has merge ranks, not probabilities; a piece of rank r weighs 1 / (r + 1) to the power of
``theta`` (1: Zipf's law; more: closer to the likeliest path). Characters without a piece are spelt in bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Grown, Numbers, distinct_words, map_arrow, slices

SPACE = 0x2581  # how pieces write a space
STRANGE = 0x110000  # beyond all characters: stands for a literal U+2581 of a text among its codes
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPACES = re.compile(" +[^ ]*")
#: A share of 1, in whole numbers: draws do not depend on what else a worker has met.
ONE = 1 << 32
#: Characters of new words whose lattices are built together.
AT_ONCE = 4_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """Lattices of the words met, at most about ``most`` of them and ``most_edges`` edges (24 bytes each), and samples from them."""

    def __init__(self, path: str, theta: float = 1.0, most: int = 250_000, most_edges: int = 8_000_000):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most, self.most_edges, self.size = most, most_edges, model.get_piece_size()
        self.byte = np.zeros(256, np.int64)
        normal: dict[str, int] = {}
        spelt: list[bytes] = []
        for i in range(self.size):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                spelt.append(bytes([int(p[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                spelt.append(b"")
            else:
                normal[p] = i
                spelt.append(p.replace(chr(SPACE), " ").encode())
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.spelt_size = np.array(list(map(len, spelt)), np.int64)
        self.spelt_at = np.cumsum(self.spelt_size) - self.spelt_size
        first = min(normal.values())
        self.cost = {i: theta * float(np.log(i - first + 1)) for i in normal.values()}
        self.per_byte = theta * float(np.log(self.size - first + 1)) + 1.0
        # prefixes of pieces by length: their hashes, and the piece where the prefix is one
        self.longest = max(map(len, normal))
        tables: list[dict[int, int]] = [{} for _ in range(self.longest + 1)]
        mask, step = (1 << 64) - 1, int(MULTIPLIER)
        for p, i in normal.items():
            h = 0
            for n, c in enumerate(p, 1):
                h = (h * step + ord(c) + 1) & mask
                tables[n].setdefault(h, -1)
            tables[len(p)][h] = i
        self.prefix = [np.array(sorted(t), np.uint64) for t in tables]
        self.piece = [np.array([t[h] for h in sorted(t)], np.int64) for t in tables]
        self.piece_cost = [np.array([self.cost.get(i, np.inf) for i in ids]) for ids in self.piece]
        self.clear()

    def clear(self) -> None:
        self.known = Numbers()
        self.first = Grown()  # by word: its first node; the last is that plus its length
        self.length = Grown()
        self.nodes = 0
        self.edge = Grown()  # by node: the first edge that ends there
        self.reach = Grown()  # by edge: the running share of the edges that end at the same node
        self.start = Grown()  # node that the edge comes from
        self.token = Grown()  # piece, or -1 - character for bytes

    def _lattices(self, words: list[str]) -> None:
        """Adds the lattices of new words; a word is its leading spaces and then its characters."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        chars[chars == SPACE] = STRANGE
        chars[chars == 0x20] = SPACE
        ends = np.cumsum(size)
        left = np.repeat(ends, size) - np.arange(len(chars))  # characters to the word's end
        node = np.arange(len(chars)) + np.repeat(np.arange(len(words)), size)  # a word has a node more than characters
        at, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        found: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []
        single = np.zeros(len(chars), bool)
        for n in range(1, self.longest + 1):
            inside = left[at] >= n
            at, h = at[inside], h[inside]
            if not len(at):
                break
            h = h * MULTIPLIER + (chars[at + n - 1] + 1).astype(np.uint64)
            k = np.minimum(np.searchsorted(self.prefix[n], h), len(self.prefix[n]) - 1)
            same = self.prefix[n][k] == h
            at, h, k = at[same], h[same], k[same]
            whole = self.piece[n][k] >= 0
            found.append((at[whole], n, self.piece[n][k[whole]], self.piece_cost[n][k[whole]]))
            if n == 1:
                single[at[whole]] = True
        strange = np.flatnonzero(~single)
        code = np.where(chars[strange] == STRANGE, SPACE, chars[strange])
        octets = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        found.append((strange, 1, -1 - code, octets * self.per_byte))
        source = np.concatenate([f[0] for f in found])
        target = node[source] + np.concatenate([np.full(len(f[0]), f[1]) for f in found])
        source = node[source]
        token, cost = np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])
        total = len(chars) + len(words)
        # nodes that no edge passes over: every path goes through them, and sums may start anew there
        over = np.zeros(total + 1, np.int64)
        np.add.at(over, source + 1, 1)
        np.add.at(over, target, -1)
        cut = np.cumsum(over)[:total] == 0
        since = np.arange(total) - np.maximum.accumulate(np.where(cut, np.arange(total), 0))
        # an edge's level: how far its end lies from the last such node at or before its start
        level = target - source + since[source]
        size_of, small = target - source, total < 1 << 25  # as one number, in which no two edges are alike, while it fits
        order = np.argsort(((level << 25) + target << 5) + size_of) if small else np.lexsort((size_of, target, level))
        source, target, token, cost, level = source[order], target[order], token[order], cost[order], level[order]
        alpha = np.zeros(total)
        value = np.empty(len(source))
        for a, b in zip(*self._runs(level)):
            v = np.where(cut[source[a:b]], 0.0, alpha[source[a:b]]) - cost[a:b]
            starts = np.flatnonzero(np.diff(target[a:b], prepend=-1))
            top = np.maximum.reduceat(v, starts)
            counts = np.diff(np.append(starts, b - a))
            v = np.exp(v - np.repeat(top, counts))
            sums = np.add.reduceat(v, starts)
            alpha[target[a:b][starts]] = top + np.log(sums)
            value[a:b] = v / np.repeat(sums, counts)
        parts = np.rint(value * ONE).astype(np.int64)  # whole numbers add up to the same in any company
        # by node, the likeliest edge first: a draw rarely looks further
        order = np.argsort((((target << 33) + ONE - parts) << 5) + target - source) if small else np.lexsort((target - source, -parts, target))
        source, target, token, parts = source[order], target[order], token[order], parts[order]
        run = np.cumsum(parts)
        starts = np.flatnonzero(np.diff(target, prepend=-1))
        counts = np.diff(np.append(starts, len(target)))
        run -= np.repeat(run[starts] - parts[starts], counts)
        run[starts + counts - 1] = ONE
        ending = np.zeros(total, np.int64)
        ending[target[starts]] = self.reach.size + starts
        self.edge.add(ending)
        self.first.add(self.nodes + ends - size + np.arange(len(words)))
        self.length.add(size)
        self.reach.add(np.minimum(run, ONE))
        self.start.add(self.nodes + source)
        self.token.add(token)
        self.nodes += total

    @staticmethod
    def _runs(level: np.ndarray) -> tuple[list[int], list[int]]:
        at = np.flatnonzero(np.diff(level, prepend=-1))
        return at.tolist(), [*at[1:].tolist(), len(level)]

    @staticmethod
    def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """The texts' words, each with the spaces before it (a text has one space put before it): offsets of the texts, every word's
        place among the different ones, and those."""
        runs = pc.any(pc.match_substring_regex(texts, "^ | $|  ")).as_py()
        if not runs:
            parts = pc.split_pattern(texts, " ")
            place, different = distinct_words(parts.values)
            return parts.offsets.to_numpy().astype(np.int64), place, [" " + w for w in different]
        parts = [SPACES.findall(" " + t) for t in texts.to_pylist()]
        place, different = distinct_words(pa.array([w for p in parts for w in p], pa.string()))
        return np.cumsum([0, *map(len, parts)]), place, different

    def sample(self, texts: pa.Array | list[str | None], seeds: np.ndarray, words: int = 200_000) -> list[np.ndarray]:
        """Ids of each text, drawn by its seed (uint64); a null or empty text has none. ``words`` are drawn
        at once."""
        if len(self.known) > self.most or self.reach.size > self.most_edges:
            self.clear()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        some = np.flatnonzero(pc.greater(pc.binary_length(texts).fill_null(0), 0).to_numpy(zero_copy_only=False))
        out = [np.zeros(0, np.int64)] * len(texts)
        offsets, place, different = self.words(texts.take(pa.array(some)))
        number, fresh = self.known.of(different)
        ends = np.cumsum([len(w) for w in fresh])
        for at in range(0, int(ends[-1]) if fresh else 0, AT_ONCE):
            if part := fresh[np.searchsorted(ends, at, "right") if at else 0 : np.searchsorted(ends, at + AT_ONCE, "right") if at + AT_ONCE < ends[-1] else None]:
                self._lattices(part)
        size = np.diff(offsets)
        owner, base = np.repeat(some, size), np.repeat(offsets[:-1], size)
        stream = mixed(seeds[owner] + (np.arange(len(place)) - base).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        ids, count = [], []
        for at in range(0, len(place), words):
            drawn, n = self._draw(number[place[at : at + words]], stream[at : at + words])
            ids.append(drawn)
            count.append(n)
        if len(some):
            every, ends = np.concatenate(ids), np.append(0, np.cumsum(np.concatenate(count)))[offsets]
            for i, first, last in zip(some.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
                out[i] = every[first:last]
        return out

    def _draw(self, number: np.ndarray, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, each drawn from its stream, and each word's count."""
        begin = self.first.data[number]
        place = begin + self.length.data[number]
        alive, steps, step = np.arange(len(number)), [], 0
        count = np.zeros(len(number), np.int64)
        while len(alive):
            u = (mixed(stream[alive] + np.uint64(step)) >> np.uint64(32)).astype(np.int64)
            edge = self.edge.data[place[alive]]
            behind = np.flatnonzero(self.reach.data[edge] <= u)
            while len(behind):
                edge[behind] += 1
                behind = behind[self.reach.data[edge[behind]] <= u[behind]]
            steps.append((alive, self.token.data[edge]))
            count[alive] += 1
            place[alive] = self.start.data[edge]
            alive = alive[place[alive] > begin[alive]]
            step += 1
        ids = np.empty(count.sum(), np.int64)
        last = np.cumsum(count) - 1
        for k, (who, token) in enumerate(steps):
            ids[last[who] - k] = token
        strange = np.flatnonzero(ids < 0)
        if len(strange):  # characters spelt in bytes
            codes, which = np.unique(-1 - ids[strange], return_inverse=True)
            spelt = [chr(c).encode("utf8", "surrogatepass") for c in codes.tolist()]
            octets = np.frombuffer(b"".join(o.ljust(4, b"\0") for o in spelt), np.uint8).reshape(-1, 4)[which]
            long = np.array(list(map(len, spelt)))[which]
            size = np.ones(len(ids), np.int64)
            size[strange] = long
            word = np.repeat(np.repeat(np.arange(len(number)), count), size)
            ids, at = np.repeat(ids, size), (np.cumsum(size) - size)[strange]
            for k in range(4):
                more = long > k
                ids[at[more] + k] = self.byte[octets[more, k]]
            count = np.bincount(word, minlength=len(number))
        return ids, count

    def decode(self, ids: np.ndarray) -> bytes:
        """The text in UTF-8: the pieces' bytes in a row without the space put before it."""
        n, at = self.spelt_size[ids], self.spelt_at[ids]
        end = np.cumsum(n)
        return self.spelt[np.repeat(at - (end - n), n) + np.arange(end[-1] if len(end) else 0)].tobytes()[1:]


_held: dict[tuple, Pieces] = {}


def held_pieces(path: str, theta: float) -> Pieces:
    """One for each worker process."""
    if (path, theta) not in _held:
        _held[path, theta] = Pieces(path, theta)
    return _held[path, theta]


def row_seeds(keys: list, seed: int) -> np.ndarray:
    """A 64-bit seed of each row key; a null key is one of its own."""
    base = np.array([zlib.crc32(repr(k).encode()) << 32 | zlib.crc32(b"." + repr(k).encode()) for k in keys], np.uint64)
    return mixed(base ^ mixed(np.array([seed], np.uint64)))


def encoded(docs: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text", theta: float = 1.0, seed: int = 0) -> DataFrame:
    """(key, ids array<int>): a sampled segmentation of every whole text. A null or empty text has no
    ids; rows with equal keys and texts have equal ids; an empty table gives no rows; other columns are not read."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pieces = held_pieces(path, theta)
        for part in slices(batch, 256):
            ids = pieces.sample(part.column(1), row_seeds(part.column(0).to_pylist(), seed))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))], [key, "ids"])

    return map_arrow(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, schema)


def decoded(rows: DataFrame, model: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of rows with ids; null or no ids: an empty text."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("text", T.StringType())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pieces = held_pieces(path, 1.0)
        texts = [pieces.decode(np.array(i or [], np.int64)).decode("utf8", "replace") for i in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return map_arrow(rows.select(F.col(key).alias("key"), F.col(ids).alias("ids")), run, schema)


def pieces_query(docs: DataFrame, theta: float = 1.0, seed: int = 0) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids), n_bytes of the decoded text, and whether it is the
    text again, byte by byte."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(n, T.LongType()) for n in ("n_tokens", "ids_crc32", "n_bytes")] + [T.StructField("lossless", T.BooleanType())]
    )

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pieces = held_pieces(path, theta)
        for part in slices(batch, 256):
            texts = part.column(1).to_pylist()
            rows = []
            for t, ids in zip(texts, pieces.sample(part.column(1), row_seeds(part.column(0).to_pylist(), seed))):
                back = pieces.decode(ids)
                rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(back), back == (t or "").encode("utf8", "surrogatepass")))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.bool_())], schema.names)

    return map_arrow(docs.select("doc_id", "text"), run, schema)
