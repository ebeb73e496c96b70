"""Phrase collocations by pivot partitioning.

Words are counted first; a phrase can only be frequent if all its words are. The frequent words of all languages are numbered from 1, the most
frequent first. A phrase belongs to its pivot, the first of its words with the largest number (the rarest). Each occurrence of a word sends the
partition of that word a fragment: what of the three words on either side can belong to a phrase of which it is the pivot, rewritten as
numbers and cut at rarer words, infrequent words and the ends of the piece. Equal fragments of a block of texts travel as one with their number. A partition then mines its
own pivots: every phrase within a fragment that holds the occurrence, so that each phrase is counted once, in one place.

Texts are cut into blocks that are written once with their words as codes; the words' numbers come to a block by a join on its different words, so that
no vocabulary is broadcast. Pivots with more than ``SHARE`` occurrences are dealt to several partitions, whose counts are added up.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed, map_arrow, release, utf8

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 8 << 20
#: Occurrences of a pivot that one group may have.
SHARE = 400_000
#: Fragments that a task mines at once, but for a pivot's own.
AT_ONCE = 200_000
#: Phrases have two to four words: two numbers of 64 bits hold four of 32.
LONGEST = 4
WORD = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def tokens(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of texts that lie one after another in ``data`` and end at ``ends``: themselves, the texts they are of, and whether
    each is the first of its piece."""
    lower = data.copy()
    lower[(data >= 65) & (data <= 90)] |= 32
    kind = _KIND[lower]
    inside = kind == 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[ends[:-1][ends[:-1] < len(data)]] = inside[ends[:-1][ends[:-1] < len(data)]]
    at = np.flatnonzero(start)
    text = np.searchsorted(ends, at, side="right")
    breaks = np.cumsum(kind == 2)[at]
    first = np.ones(len(at), bool)
    first[1:] = (text[1:] != text[:-1]) | (breaks[1:] != breaks[:-1])
    letters = np.cumsum(inside)
    offsets = np.append(letters[at] - 1, letters[-1] if len(letters) else 0).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(lower[inside].tobytes()))
    return words, text, first


def _blocks(batch: pa.RecordBatch, block: int) -> Iterator[pa.RecordBatch]:
    size = utf8(batch.column("text"))[1][1:]
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(int(np.searchsorted(size, base + block, side="right")), at + 1)
        part = batch.slice(at, to - at)
        at = to
        data, offsets = utf8(part.column("text"))
        words, text, first = tokens(data, offsets[1:])
        if not len(words):
            continue
        coded = words.dictionary_encode()
        spoken = part.column("lang").dictionary_encode()
        spelled, names = coded.dictionary.cast(pa.string()), spoken.dictionary
        both = spoken.indices.to_numpy().astype(np.int64)[text] * len(spelled) + coded.indices.to_numpy()
        different, codes, count = np.unique(both, return_inverse=True, return_counts=True)
        # 0 stands between pieces, words are numbered from 1
        place = np.arange(len(codes)) + np.cumsum(first)
        line = np.zeros(len(codes) + int(first.sum()) + 1, np.uint32)
        line[place] = codes + 1
        line = line.astype(np.uint16) if len(different) < 1 << 16 else line
        vocabulary = pa.StructArray.from_arrays([names.take(pa.array(different // len(spelled))), spelled.take(pa.array(different % len(spelled))), pa.array(count)], ["lang", "word", "n"])
        lists = pa.ListArray.from_arrays(pa.array([0, len(vocabulary)], pa.int32()), vocabulary)
        yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([pa.compress(line.tobytes(), "zstd", asbytes=True)], pa.binary()), pa.array([line.itemsize]), pa.array([line.nbytes]), lists], ["block", "line", "width", "size", "words"])


BLOCKS = "block string, line binary, width long, size long, words array<struct<lang: string, word: string, n: long>>"


def blocks(docs: DataFrame, text: str, lang: str, block: int = BLOCK) -> DataFrame:
    """(block, line, width, size, words): texts as compressed codes of the block's words, which are listed with their languages and numbers of occurrences."""
    return checkpointed(map_arrow(docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang")), lambda batch: _blocks(batch, block), BLOCKS))


def numbered(words: DataFrame) -> DataFrame:
    """(lang, word, n, id): frequent words numbered from 1, most frequent first, by a sort in ranges whose sizes are put together."""
    placed = checkpointed(words.orderBy(F.col("n").desc(), "lang", "word").withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.shiftrightunsigned("id", 33)))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))  # a row a range
    placed = placed.join(F.broadcast(starts), "part").withColumn("id", F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("start") + 1)
    return placed.select("lang", "word", "n", F.when(F.col("id") < 1 << 31, F.col("id")).otherwise(F.raise_error(F.lit("more than 2^31 frequent words"))).cast("long").alias("id"))


def grouped(keys: list[np.ndarray], weight: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of the key columns and the sums of their weights."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    return [k[first] for k in keys], np.add.reduceat(weight[order], first) if len(first) else weight[:0]


def fragments(line: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Fragments of a line of numbers (0 between pieces and for infrequent words): pivot, three words before it from the nearest, three
    after it, 0 for none; packed by two, with how often each occurs. Before the pivot only smaller numbers count, after it equal ones too."""
    padded = np.concatenate([np.zeros(3, np.uint64), line.astype(np.uint64), np.zeros(3, np.uint64)])
    at = np.flatnonzero(padded)
    pivot = padded[at]
    around = []
    for side in (-1, 1):
        goes = np.ones(len(at), bool)
        for step in (1, 2, 3):
            word = padded[at + side * step]
            goes &= (word > 0) & ((word < pivot) if side < 0 else (word <= pivot))
            around.append(np.where(goes, word, np.uint64(0)))
    some = (around[0] > 0) | (around[3] > 0)
    pivot, (a, b, c, d, e, f) = pivot[some], [w[some] for w in around]
    return grouped([pivot << HALF | a, b << HALF | c, d << HALF | e, f << HALF], np.ones(len(pivot), np.int64))


def phrases(keys: list[np.ndarray], weight: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Phrases of two to four words in the fragments that hold the pivot, as two numbers each, and their occurrences."""
    pivot, a, b, c, d, e, f = keys[0] >> HALF, keys[0] & WORD, keys[1] >> HALF, keys[1] & WORD, keys[2] >> HALF, keys[2] & WORD, keys[3] >> HALF
    before, after = [a, b, c], [d, e, f]
    high, low, n = [], [], []
    for left in range(LONGEST):
        for right in range(LONGEST - left):
            if left + right:
                there = np.ones(len(pivot), bool)
                if left:
                    there &= before[left - 1] > 0
                if right:
                    there &= after[right - 1] > 0
                w = [x[there] for x in (*before[:left][::-1], pivot, *after[:right])] + [np.uint64(0)] * (LONGEST - 1 - left - right)
                high.append(w[0] << HALF | w[1])
                low.append(w[2] << HALF | w[3] if left + right > 1 else np.zeros(int(there.sum()), np.uint64))
                n.append(weight[there])
    return grouped([np.concatenate(high), np.concatenate(low)], np.concatenate(n))


def _rewritten(line: pa.Table, words: pa.Table, share: int) -> pa.Table:
    """A block's fragments, given its line and the numbers of its words; pivots with more than ``share`` occurrences in all are salted."""
    out = {"k0": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "k3": pa.int64(), "salt": pa.int32(), "n": pa.int64()}
    if not line.num_rows or not words.num_rows:
        return pa.table({k: pa.array([], t) for k, t in out.items()})
    width, size = line.column("width")[0].as_py(), line.column("size")[0].as_py()
    codes = np.frombuffer(pa.decompress(line.column("line")[0].as_py(), size, "zstd", asbytes=True), np.uint16 if width == 2 else np.uint32)
    code, number, total = (words.column(c).to_numpy() for c in ("code", "id", "n"))
    top = max(int(codes.max()), int(code.max()) + 1) + 1
    table = np.zeros(top, np.uint64)
    table[code + 1] = number
    keys, n = fragments(table[codes])
    order = np.argsort(number)
    groups = (-(-total[order] // share))[np.searchsorted(number[order], (keys[0] >> HALF).astype(np.int64))]
    mixed = keys[0]
    for k in keys[1:]:
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) ^ k
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    salt = np.where(groups > 1, (mixed >> np.uint64(33)).astype(np.int64) % np.maximum(groups, 1) + 1, 0)
    return pa.table([pa.array(k.view(np.int64)) for k in keys] + [pa.array(salt.astype(np.int32)), pa.array(n)], names=list(out))


def _mined(least: int, at_once: int):
    """A task's groups (pivot, salt) come one after another, cut only between groups as far as they are whole."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(keys: list[np.ndarray], salt: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for whole in (True, False):  # a pivot's only group knows its phrases' counts
                of = (salt == 0) == whole
                if of.any():
                    (high, low), a = phrases([k[of] for k in keys], n[of])
                    often = a >= (least if whole else 1)
                    if often.any():
                        yield pa.RecordBatch.from_arrays([pa.array(high[often].view(np.int64)), pa.array(low[often].view(np.int64)), pa.array(a[often])], ["high", "low", "a"])

        held: list[tuple] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(([batch.column(f"k{i}").to_numpy().view(np.uint64) for i in range(4)], batch.column("salt").to_numpy(), batch.column("n").to_numpy()))
            rows += batch.num_rows
            if rows < at_once:
                continue
            keys, salt, n = [np.concatenate([h[0][i] for h in held]) for i in range(4)], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            pivot = keys[0] >> HALF
            last = np.flatnonzero((pivot != pivot[-1]) | (salt != salt[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut == 0 and salt[-1] > 0:
                cut = len(n)
            if cut:
                yield from emit([k[:cut] for k in keys], salt[:cut], n[:cut])
            held = [([k[cut:] for k in keys], salt[cut:], n[cut:])]
            rows = len(n) - cut
        if rows:
            yield from emit([np.concatenate([h[0][i] for h in held]) for i in range(4)], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
        release()

    return mine


def word_at(k: int) -> Column:
    """The k-th of four numbers."""
    c = F.col("high" if k < 2 else "low")
    return F.shiftrightunsigned(c, 32) if k % 2 == 0 else c.bitwiseAND(F.lit(0xFFFFFFFF))


def packed(words: list[Column]) -> list[Column]:
    w = words + [F.lit(0).cast("long")] * (LONGEST - len(words))
    return [F.shiftleft(w[0], 32).bitwiseOR(w[1]), F.shiftleft(w[2], 32).bitwiseOR(w[3])]


def frequent(docs: DataFrame, text: str, lang: str, least: int, share: int = SHARE, block: int = BLOCK, at_once: int = AT_ONCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n), (lang, word, n, id), and (high, low, a) of the phrases with at least ``least`` occurrences."""
    lines = blocks(docs, text, lang, block)
    pairs = lines.select("block", F.posexplode("words").alias("code", "w")).select("block", F.col("code").cast("long").alias("code"), "w.lang", "w.word", "w.n")
    counts = checkpointed(pairs.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    vocabulary = checkpointed(numbered(counts.where(F.col("n") >= least)))
    known = pairs.drop("n").join(vocabulary, ["lang", "word"]).select(F.col("block").alias("of"), "code", "id", "n")
    sent = lines.select("block", "line", "width", "size").groupBy("block").cogroup(known.groupBy("of")).applyInArrow(lambda line, words: _rewritten(line, words, share), "k0 long, k1 long, k2 long, k3 long, salt int, n long")
    sent = sent.repartition(F.shiftrightunsigned("k0", 32), "salt").sortWithinPartitions(F.shiftrightunsigned("k0", 32), "salt")
    mined = sent.mapInArrow(_mined(least, at_once), "high long, low long, a long")
    return totals, vocabulary, checkpointed(mined.groupBy("high", "low").agg(F.sum("a").alias("a")).where(F.col("a") >= least))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, held: tuple[int, int] = (80, 100), scale: int = 2_000_000, most: int = 2000, **bounds: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``most`` highest-scoring phrases.

    Words are runs of characters but space and tab within pieces; pieces end at ``.,;:!?`` and line ends; A to Z become small. All counts are over
    all texts, overlaps included, whatever their length. A null text is empty, a null language is "und" (beside rows that say so), repeated
    rows count as often as they occur. Ties are broken by count and by the phrase's bytes. An empty table gives an empty one.
    ``bounds`` are those of ``frequent``: how work is cut, which the answer does not depend on.
    """
    totals, vocabulary, counted = frequent(docs, text, lang, least, **bounds)
    length = F.when(word_at(2) == 0, 2).when(word_at(3) == 0, 3).otherwise(4)
    w = [word_at(k) for k in range(LONGEST)]
    struct = lambda names, parts: F.struct(*[p.alias(n) for n, p in zip(names, parts)])
    # phrases that a longer candidate holds nearly always
    inner = {3: [w[0:2], w[1:3]], 4: [w[0:2], w[1:3], w[2:4], w[0:3], w[1:4]]}
    inside = F.when(length == 3, F.array(*[struct(("high", "low"), packed(p)) for p in inner[3]])).when(length == 4, F.array(*[struct(("high", "low"), packed(p)) for p in inner[4]]))
    longer = counted.where(length > 2).select(F.explode(inside).alias("of"), "a").groupBy("of.high", "of.low").agg(F.max("a").alias("longer"))
    exact = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by).cast("decimal(10,0)")
    kept = counted.join(longer, ["high", "low"], "left").where(F.col("longer").isNull() | (exact("longer", held[1]) < exact("a", held[0]))).select("high", "low", "a")
    # every cut's two parts
    cuts = [F.when(length > k, struct(("k", "lh", "ll", "rh", "rl"), [F.lit(k), *packed(w[:k]), *packed(w[k:])])) for k in range(1, LONGEST)]
    cut = kept.select("high", "low", "a", F.explode(F.array_compact(F.array(*cuts))).alias("cut")).select("high", "low", "a", "cut.*")
    parts = counted.unionByName(vocabulary.select(F.shiftleft("id", 32).alias("high"), F.lit(0).cast("long").alias("low"), F.col("n").alias("a")))
    left, right = (parts.select(F.col("high").alias(f"{s}h"), F.col("low").alias(f"{s}l"), F.col("a").alias(s)) for s in "lr")
    scored = cut.join(left, ["lh", "ll"]).join(right, ["rh", "rl"])
    scored = scored.withColumn("wide", exact("a", scale)).withColumn("score", F.expr("wide div (l + r)"))
    scored = scored.groupBy("high", "low", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("high", "low", "a", "cut.l", "cut.r", "cut.score")
    at = scored.select("high", "low", F.posexplode(F.array(*w)).alias("at", "id")).where("id > 0").join(vocabulary.drop("n"), "id")
    spelled = at.groupBy("high", "low").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = scored.join(spelled, ["high", "low"]).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")))
    return ranked.where(F.col("rank") <= most).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_query(documents: DataFrame) -> DataFrame:
    return collocations(documents)


COLLOCATIONS_SQL = r"""
WITH pieces AS (SELECT row_number() OVER () AS id, lang, piece FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
words AS MATERIALIZED (SELECT lang, w, len(w) AS k FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces) WHERE len(w) > 0),
totals AS (SELECT lang, sum(k)::BIGINT AS n FROM words GROUP BY lang),
grams AS (SELECT lang, w[i:i + g - 1] AS p FROM (SELECT lang, w, g, unnest(range(1, k - g + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS g) WHERE k >= g)),
counts AS MATERIALIZED (SELECT lang, p, len(p) AS g, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
inner_of AS (SELECT lang, p[i:i + h - 1] AS p, max(a) AS longer FROM (SELECT lang, p, a, g, h, unnest(range(1, g - h + 2)) AS i FROM counts, (SELECT unnest([2, 3]) AS h) WHERE g > h) GROUP BY 1, 2),
kept AS (SELECT c.* FROM counts c LEFT JOIN inner_of o ON c.lang = o.lang AND c.p = o.p WHERE g > 1 AND (longer IS NULL OR 100 * longer::HUGEINT < 80 * c.a::HUGEINT)),
cut AS (SELECT k.*, unnest(range(1, g)) AS c FROM kept k),
scored AS (SELECT cut.lang, cut.p, cut.a, cut.c, x.a AS l, y.a AS r, (2000000 * cut.a::HUGEINT // (x.a + y.a))::BIGINT AS score
  FROM cut JOIN counts x ON x.lang = cut.lang AND x.p = cut.p[1:c] JOIN counts y ON y.lang = cut.lang AND y.p = cut.p[c + 1:]),
best AS (SELECT lang, p, a, min_by({'l': l, 'r': r, 's': score}, (score, c)) AS b FROM scored GROUP BY lang, p, a),
ranked AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, b.l AS l, b.r AS r, b.s AS score FROM best)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) QUALIFY rank <= 2000
"""
