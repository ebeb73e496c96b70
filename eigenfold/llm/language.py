"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts up to three bytes long with the counts of
the bytes that followed. The probability of a byte comes from the longest context
in the tree; an escape (method C: as many escapes as different bytes seen) leads to the next
shorter one, without the bytes already ruled out. Statistics are frozen, and held sparsely: the
code length of every string of one to four bytes that a language has, and what an escape from each
of its contexts costs. A text's code length is a sum over its different strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, map_arrow, slices, summed, utf8

UNKNOWN = "und"
NEWLINE = 10
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True
#: Bytes of letters, and of all characters beyond ASCII.
WORDY = ASCII_LETTER | (np.arange(256) >= 128)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Order:
    """What one order of context knows: ``strings`` (a context and the byte after it, packed, ascending) with the languages that have
    each and the bits the byte takes there, and ``contexts`` with the bits that an escape takes. Entries of
    string i: ``string_at[i]`` to ``string_at[i + 1]``."""

    strings: np.ndarray
    string_at: np.ndarray
    string_lang: np.ndarray
    string_bits: np.ndarray
    contexts: np.ndarray
    context_at: np.ndarray
    context_lang: np.ndarray
    context_bits: np.ndarray


def entries(keys: np.ndarray, at: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of the keys asked for, and which of ``asked`` (ascending) each belongs to."""
    where = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
    own = np.flatnonzero(keys[where] == asked) if len(keys) else np.zeros(0, np.int64)
    first, n = at[where[own]], at[where[own] + 1] - at[where[own]]
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0), np.repeat(own, n)


@dataclass
class ContextTrees:
    """The trees of all languages by order. ``usual``: by language, the median
    of the bits that a byte of letters takes, in texts kept out of the trees, in their own language."""

    languages: list[str]
    orders: list[Order]
    usual: np.ndarray | None = None

    def string_bits(self, strings: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each packed string of four bytes (ascending, different), a column a language."""
        total = np.full((len(strings), len(self.languages)), np.float32(8))
        for n, order in enumerate(self.orders):  # from the shortest context on: seen strings replace, seen contexts add an escape
            short, back = np.unique(strings & np.uint32((1 << 8 * (n + 1)) - 1), return_inverse=True)
            step = np.zeros((len(short), len(self.languages)), np.float32)
            seen = np.zeros(step.shape, bool)
            context, which = np.unique(short >> np.uint32(8), return_inverse=True)
            escape = np.zeros((len(context), len(self.languages)), np.float32)
            e, row = entries(order.contexts, order.context_at, context)
            escape[row, order.context_lang[e]] = order.context_bits[e]
            step += escape[which]
            e, row = entries(order.strings, order.string_at, short)
            step[row, order.string_lang[e]], seen[row, order.string_lang[e]] = order.string_bits[e], True
            total = np.where(seen[back], step[back], total + step[back])
        return total

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray, block: int | None = None) -> np.ndarray:
        """Bits that each language's tree takes for each text (rows by languages); a text begins as if after line ends."""
        return self.code_lengths_of(data, offsets, (np.ones(256, bool),), block)[0]

    def code_lengths_of(self, data: np.ndarray, offsets: np.ndarray, kinds: tuple[np.ndarray, ...], block: int | None = None) -> np.ndarray:
        """As ``code_lengths``, of the bytes of each of the kinds only; what stands before them is read all the same."""
        total = np.zeros((len(kinds), len(offsets) - 1, len(self.languages)))
        block = block or max(1 << 12, (1 << 22) // max(4, len(self.languages)))
        for at in range(0, len(data), block):
            end = min(len(data), at + block)
            back = min(at, 3)
            c = np.full(end - at + 3, NEWLINE, np.uint32)
            c[3 - back :] = LOWER[data[at - back : end]]
            first, last = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, end, "left")
            starts, ends = offsets[first:last], offsets[first + 1 : last + 1]
            string = c[:-3] << 24 | c[1:-2] << 16 | c[2:-1] << 8 | c[3:]
            for k in range(3):
                p = starts + k - at
                p = p[(p >= 0) & (p < end - at) & (starts + k < ends)]
                kept = np.uint32((1 << 8 * (k + 1)) - 1)
                string[p] = string[p] & kept | np.uint32(0x0A0A0A0A) & ~kept
            own, different = pd.factorize(string, sort=True)
            bits, within = self.string_bits(different), np.clip(np.append(starts, ends[-1]), at, end) - at
            for kind, lengths in zip(kinds, total):
                cost = bits * kind[different & np.uint32(255), None]
                lengths[first:last] += summed(cost[own], within)
        return total


def tree(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """One language's strings and their bits, contexts and their escapes' bits, by order."""
    pad = bytes([NEWLINE] * 3)
    x = LOWER[np.frombuffer(pad + pad.join(texts) + pad, np.uint8)].astype(np.uint32)
    out, shorter_keys, shorter = [], None, None
    escapes: list[tuple[np.ndarray, np.ndarray]] = []
    for n in range(4):
        strings = sum((x[i : len(x) - n + i] << np.uint32(8 * (n - i)) for i in range(n + 1)), np.zeros(len(x) - n, np.uint32))
        key, count = np.unique(strings, return_counts=True)
        context, which = np.unique(key >> np.uint32(8), return_inverse=True)
        kinds, all_of = np.bincount(which), np.bincount(which, count)
        # every shorter string of a string seen is seen, too: its probability there is one look-up
        under = np.full(len(key), 1 / 256) if n == 0 else shorter[np.searchsorted(shorter_keys, key & np.uint32((1 << 8 * n) - 1))]
        left = np.maximum(1 - np.bincount(which, under), 1e-12)
        probability = count / (all_of + kinds)[which]
        out.append((key, -np.log2(probability).astype(np.float32), context, -np.log2(kinds / (all_of + kinds) / left).astype(np.float32)))
        shorter_keys, shorter = key, probability
    return out


def learn(texts: dict[str, list[bytes]]) -> ContextTrees:
    """Trees of the given texts, with every context that they have."""
    languages = sorted(texts)
    trees = [tree(texts[k]) for k in languages]

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
        keys, bits = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        lang = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[0]) for p in parts])
        order = np.argsort(keys, kind="stable")
        different, at = np.unique(keys[order], return_index=True)
        return different, np.append(at, len(keys)), lang[order], bits[order]

    return ContextTrees(languages, [Order(*merged([t[n][:2] for t in trees]), *merged([t[n][2:] for t in trees])) for n in range(4)])


#: One of so many texts of a language is kept out of its tree while the usual bits a byte are measured.
KEPT_OUT = 5


def calibrated(texts: dict[str, list[bytes]]) -> ContextTrees:
    """Trees of all texts; the usual bits of each language are measured on every fifth text under trees without it. A language of fewer
    than ten texts takes the mean of the others, or no bound if there are none."""
    parts = {k: [t[i::KEPT_OUT] for i in range(KEPT_OUT)] for k, t in texts.items()}
    usual = np.full(len(texts), np.nan)
    known = [k for k in sorted(texts) if len(texts[k]) >= 2 * KEPT_OUT]
    if known:
        rest = learn({k: [t for p in parts[k][1:] for t in p] for k in known})
        for column, k in enumerate(known):
            own = parts[k][0]
            offsets = np.cumsum([0] + [len(t) for t in own])
            data = np.frombuffer(b"".join(own), np.uint8)
            n = summed(WORDY[data], offsets)
            bits = (rest.code_lengths_of(data, offsets, (WORDY,))[0][:, column] / np.maximum(n, 1))[n > 0]
            at = sorted(texts).index(k)
            if len(bits):
                usual[at] = np.median(bits)
    model = learn(texts)
    found = usual[~np.isnan(usual)]
    model.usual = np.where(np.isnan(usual), found.mean() if len(found) else np.inf, usual)
    return model


def train(docs: DataFrame, text: str = "text", lang: str = "lang", where=None, per_language: int = 250, bytes_per_language: int = 16 << 20, bytes_in_all: int = 64 << 20) -> ContextTrees | None:
    """Trees from about ``per_language`` different texts of each language, fewer where those would have more than
    ``bytes_per_language`` bytes, or the language's share of ``bytes_in_all`` (an equal one), taken by their hash: the bounds on what
    reaches the driver and, at 32 bytes a byte of sample if no string occurred twice, on what is broadcast. At least one text of
    each language. None if no row has both text and language. Copies of a text count once, both in the share drawn and in what is learned."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(text) > 0))
    rows = rows.where(where) if where is not None else rows
    hashed = F.xxhash64(F.col(text))
    draw = F.pmod(hashed, F.lit(1 << 30)) / F.lit(float(1 << 30))
    different = rows.select(F.col(lang).alias("lang"), hashed.alias("hash"), draw.alias("draw"), F.octet_length(text).alias("size")).distinct()
    counts = different.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.min("draw").alias("first")).collect()
    if not counts:
        return None
    bytes_per_language = min(bytes_per_language, bytes_in_all // len(counts))
    share = {r["lang"]: max(min(1.0, per_language / r["n"], bytes_per_language / r["size"]), np.nextafter(r["first"], 2.0)) for r in counts}
    shares = docs.sparkSession.createDataFrame([(k, float(n)) for k, n in share.items()], "lang string, share double")
    drawn = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), draw.alias("draw"))
    sample = drawn.join(F.broadcast(shares), "lang").where("draw < share").select("lang", "text").distinct()
    texts: dict[str, list[bytes]] = {}
    for k, t in sorted(map(tuple, sample.collect())):
        texts.setdefault(k, []).append(t.encode())
    return calibrated(texts) if texts else None


def predict_batch(model: ContextTrees | None, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, posterior probability (uniform prior) of every text, and the bits by which its letters exceed the usual ones of
    that language, with the number of the letters' bytes (two columns)."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    if model is None or n == 0:
        return [UNKNOWN] * n, np.zeros(n), np.zeros((n, 2))
    letters = summed(ASCII_LETTER[data], offsets) > 0
    for i in np.flatnonzero(~letters):  # letters beyond ASCII
        letters[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf8", "replace")))
    lengths, own = model.code_lengths_of(data, offsets, (np.ones(256, bool), WORDY))
    best = lengths.argmin(1)
    odds = np.exp2(np.maximum(lengths.min(1, keepdims=True) - lengths, -1000))
    score = np.where(letters, 1 / odds.sum(1), 0.0)
    size = summed(WORDY[data], offsets)
    excess = own[np.arange(n), best] - (np.zeros(n) if model.usual is None else np.where(size > 0, model.usual[best] * np.maximum(size, 1), 0))
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)], score, np.stack([excess, size], 1)


def identify(docs: DataFrame, model: ContextTrees | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row.

    A null or empty text and one without letters give ``und`` and score 0; a very long text is read whole, in blocks; equal code
    lengths give the language that sorts first; repeated rows give repeated results;
    other columns are not read, whatever their names.
    """
    frame = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):  # what is worked out of a text takes many times its bytes
            lang, score, _ = predict_batch(held.value, part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], [key, "lang_pred", "score"])

    return map_arrow(frame, run, schema)


def accepted(docs: DataFrame, model: ContextTrees | None, text: str = "text", least: float = 0.5, margin: float = 1.5, slack: float = 64.0) -> DataFrame:
    """The rows written in a language that was learned, with all their columns.

    Rejected are a null or empty text, one without letters, one between languages (a score below ``least``: rare, as whole texts
    nearly always score 0 or 1), and one whose letters take more bits in the likeliest language than texts of that language usually
    do: over ``margin`` bits a byte more, and ``slack`` bits in all beyond that, so that a name or a key in a short text is no
    reason. A very long text is judged whole, in blocks. Repeated rows are judged alike; an empty table gives none, as does a model that
    learned nothing; no other column is read, whatever its name.
    """
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            rows = zip(*predict_batch(held.value, part.column(at)))
            yield part.filter(pa.array([k != UNKNOWN and s >= least and excess <= margin * n + slack for k, s, (excess, n) in rows], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def language_query(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows outside fold 0."""
    model = train(docs, where=fold("doc_id", folds) != 0)
    return identify(docs, model).select("doc_id", F.coalesce(fold("doc_id", folds) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
